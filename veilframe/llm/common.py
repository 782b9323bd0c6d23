"""What the operators of this subpackage share: tables, scratch storage, word columns, text chunks."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, scratch_root  # noqa: F401  the operators take them from here

#: Code points \x09-\x0D and \x20, the white space of the corpus contracts.
ASCII_SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x09-\x0D\x20]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]``; an empty array for null and for text without words."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACES))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def chunks(texts: Iterable[str | None], budget: int = 1 << 20) -> Iterator[list[str]]:
    """The texts (null as empty) in order, in lists of about ``budget`` characters; a longer text is alone."""
    own: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if own and size + len(text) > budget:
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text)
    if own:
        yield own


_held: dict[str, Callable[[], object]] = {}


def take_worker(owner: str, forget: Callable[[], object]) -> None:
    """Called by an operator's code in a Python worker before it fills caches of its own.

    Spark gives a worker to one operator after the other; what the others have kept is forgotten first, so
    caches of several operators don't add up in one process.
    """
    others = [x for x in _held if x != owner]
    for other in others:
        _held.pop(other)()
    _held[owner] = forget
    if others:
        give_back()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which the memory that it has freed goes back to the system.

    A worker outlives its tasks, and an allocator keeps what they free in pieces, so without this the workers of
    one executor grow from task to task and still hold it when the next operator needs room.
    """

    def own(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    own.__annotations__ = dict(run.__annotations__)
    return own


def give_back() -> None:
    """Return freed memory to the system: after a fit on the driver, which goes on to plan large jobs, and after a worker's task."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU C library
        pass


def fraction_of(key: Column, share: Column, seed: str) -> Column:
    """True for about ``share`` of the keys, the same ones on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < share * (1 << 30)
