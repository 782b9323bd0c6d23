"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A pre-token's symbols are leaves of a tree; a leaf holds (rank, position) of the pair that starts there, and
every inner node the least of its two children.  The root is thus the leftmost pair of the lowest rank.
Merging it changes three leaves, each with logarithmic updates up to the root, until no pair is mergeable.
Short pre-tokens are merged many at a time: the trees of one width are the rows of an array and the same
updates run on all rows whose root still names a pair.  Long ones get a tree of their own.

Text is cut by the public pattern of byte-level BPE.  Strings of added tokens are cut out first, leftmost,
longest first in a tie, and stand for their ids.  Encoding needs no shuffle; each Python worker keeps the ids
of pre-tokens that it has met, up to about ``CACHE`` bytes, then starts anew, so memory is bounded and results
don't depend on what is kept.  A pass that also decodes does both in one worker and gives its rows out in
slices of about a million characters, whatever the size of the batches that come in.

Defined results: null text is empty text; empty text has no tokens; ids that the vocabulary lacks raise an
error when decoded.  Texts are handled one after the other whatever their length; repeated rows give repeated
results, empty tables empty ones.  Only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, table, take_worker, tidy

#: Fixed: the pattern of byte-level BPE pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pre-tokens and their ids that a worker keeps at most between chunks.
CACHE = 64 << 20
_NONE = np.int64(1) << 62
_POS = 20  # bits of a position in a leaf; wider pre-tokens go to the single tree
_WIDE = 32


def _byte_chars() -> list[str]:
    """The character that stands for each byte in vocabulary files: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class ByteBPE:
    """A byte-level BPE vocabulary read from a public tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        chars = _byte_chars()
        to_byte = {c: b for b, c in enumerate(chars)}
        vocab = file["model"]["vocab"]
        added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *added.values()])
        self.piece: list[bytes | None] = [None] * self.size
        for token, i in vocab.items():
            self.piece[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in added.items():
            self.piece[i] = token.encode()
        self.added = added
        self.first = np.array([vocab[c] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in pairs], np.int64) for k in (0, 1))
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(key.tolist(), range(len(pairs)), strict=True))
        self.cut = regex.compile(PATTERN)
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.kept: dict[str, bytes] = {}
        self.held = 0  # bytes of what is kept, about

    # -- merging ------------------------------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where the pair merges into nothing."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def _merge_rows(self, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of ``sym`` [n, w] (w a power of two); the symbols, and which positions are left."""
        n, w = sym.shape
        pos = np.arange(w)
        tree = np.full((n, 2 * w), _NONE, np.int64)
        rank = self._rank(sym[:, :-1], sym[:, 1:])
        tree[:, w : 2 * w - 1] = np.where((rank >= 0) & (pos[1:] < length[:, None]), rank << _POS | pos[:-1], _NONE)
        for lo in (1 << k for k in range(w.bit_length() - 2, -1, -1)):
            np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2], out=tree[:, lo : 2 * lo])
        after = np.broadcast_to(pos + 1, (n, w)).copy()
        before = np.broadcast_to(pos - 1, (n, w)).copy()
        alive = pos < length[:, None]
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            root = tree[rows, 1]
            i, made = root & ((1 << _POS) - 1), self.made[root >> _POS]
            j = after[rows, i]
            k = after[rows, j]
            sym[rows, i] = made
            alive[rows, j] = False
            after[rows, i] = k
            has_k = k < length[rows]
            before[rows[has_k], k[has_k]] = i[has_k]
            h = before[rows, i]
            nxt = np.where(has_k, self._rank(made, sym[rows, np.minimum(k, w - 1)]), -1)
            prv = np.where(h >= 0, self._rank(sym[rows, np.maximum(h, 0)], made), -1)
            tree[rows, w + j] = _NONE
            tree[rows, w + i] = np.where(nxt >= 0, nxt << _POS | i, _NONE)
            tree[rows[h >= 0], w + h[h >= 0]] = np.where(prv >= 0, prv << _POS | h, _NONE)[h >= 0]
            for leaf in (j, i, np.where(h >= 0, h, i)):
                node = (w + leaf) >> 1
                while node[0]:  # all leaves are equally deep
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] != _NONE]
        return sym, alive

    def _merge_one(self, sym: list[int]) -> list[int]:
        """Merge one long pre-token with a tree of its own."""
        n, size, rank_of, made = len(sym), self.size, self.rank_of, self.made
        none = (n + 1) * (len(made) + 1)
        w = 1 << max(1, (n - 1).bit_length())
        tree = [none] * (2 * w)
        for i in range(n - 1):
            r = rank_of.get(sym[i] * size + sym[i + 1])
            if r is not None:
                tree[w + i] = r * n + i
        for x in range(w - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            x = w + i
            tree[x] = value
            while x > 1:
                x >>= 1
                low = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == low:
                    break
                tree[x] = low

        while tree[1] != none:
            rank, i = divmod(tree[1], n)
            j = after[i]
            k = after[j]
            sym[i], sym[j] = int(made[rank]), -1
            after[i] = k
            put(j, none)
            if k < n:
                before[k] = i
            r = rank_of.get(sym[i] * size + sym[k]) if k < n else None
            put(i, none if r is None else r * n + i)
            if (h := before[i]) >= 0:
                r = rank_of.get(sym[h] * size + sym[i])
                put(h, none if r is None else r * n + h)
        return [s for s in sym if s >= 0]

    def _learn(self, fresh: list[str]) -> None:
        """Put the ids of new pre-tokens, as little-endian 32-bit bytes, into ``kept``."""
        raw = [t.encode() for t in fresh]
        self.held += sum(200 + 6 * len(t) for t in raw)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        for lo in (1, 2, 4, 8, 16):
            rows = np.flatnonzero((size > (lo if lo > 1 else 0)) & (size <= 2 * lo))
            for part in np.array_split(rows, max(1, len(rows) // 8192)) if len(rows) else ():
                w = 2 * lo
                flat = np.frombuffer(b"".join(raw[r].ljust(w, b"\0") for r in part), np.uint8).reshape(-1, w)
                sym, alive = self._merge_rows(self.first[flat], size[part])
                ids, n = sym[alive].astype("<u4").tobytes(), alive.sum(1).cumsum() * 4
                at = 0
                for r, end in zip(part.tolist(), n.tolist(), strict=True):
                    self.kept[fresh[r]] = ids[at:end]
                    at = end
        for r in np.flatnonzero(size > _WIDE).tolist():
            ids = self._merge_one(self.first[np.frombuffer(raw[r], np.uint8)].tolist())
            self.kept[fresh[r]] = np.array(ids, "<u4").tobytes()

    # -- texts --------------------------------------------------------------------------------------------

    def _parts(self, text: str) -> Iterator[str | int]:
        """Stretches of ordinary text, and ids of added tokens, in order."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield text[at : m.start()]
            yield self.added[m[0]]
            at = m.end()
        yield text[at:]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut, kept = self.cut.findall, self.kept
        if self.held > CACHE:
            kept.clear()
            self.held = 0
        plain = not any(t in text for t in self.added for text in texts)
        if plain:
            pre = [cut(text) for text in texts]
        else:
            pre = [[y for x in self._parts(text) for y in ([x] if isinstance(x, int) else cut(x))] for text in texts]
        fresh = {t for own in pre for t in own if t not in kept}
        if not plain:
            for i in self.added.values():
                kept[i] = i.to_bytes(4, "little")
        self._learn([t for t in fresh if isinstance(t, str)])
        get = kept.__getitem__
        return [b"".join(map(get, own)) for own in pre]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes([text or ""])[0], "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> str:
        """The text of ids given as little-endian 32-bit integers; bytes that are no UTF-8 become U+FFFD."""
        piece = self.piece
        return b"".join([piece[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, "<u4").tobytes())


@functools.lru_cache(maxsize=1)
def _loaded(path: str) -> ByteBPE:
    return ByteBPE(path)


def load(path: str) -> ByteBPE:
    take_worker("bpe", _loaded.cache_clear)
    return _loaded(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> object:
    """Column function text -> binary: the ids as little-endian unsigned 32-bit integers."""
    import pyarrow as pa

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for batch in batches:
            yield pa.array([ids for own in chunks(batch.to_pylist()) for ids in bpe.encode_bytes(own)], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tidy(run), T.BinaryType())


def token_ids(text: Column, path: str | None = None) -> Column:
    return encoder(path or default_path())(text)


def tokenized(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_tokens, ids (little-endian 32-bit) and decoded: encoded and decoded in one pass."""
    import pyarrow as pa

    path = path or default_path()
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            done = 0
            for own in chunks(x.as_py() for x in batch.column(0)):
                ids = bpe.encode_bytes(own)
                kept = [c.slice(done, len(own)) for c in batch.columns[1:]]
                done += len(own)
                yield pa.RecordBatch.from_arrays([*kept, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode_bytes, ids), pa.string())], names)

    return docs.select(F.col(text).cast("string").alias("_text"), *keep).mapInArrow(tidy(run), schema)


def round_trip(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, decoded from the ids' bytes, and both digested.

    One pass in Python; ids never leave the worker, so only digests come back.
    """
    import pyarrow as pa

    path = path or default_path()
    schema = T.StructType([docs.schema[doc_id].__class__("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for own in chunks(x.as_py() for x in batch.column(1)):
                for ids in bpe.encode_bytes(own):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode_bytes(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), schema)


def op2_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
