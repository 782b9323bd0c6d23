"""Interleaved document sequences: text and media in the order of the page, media by digest.

HTML is parsed into an ordered array of structs; a text run has its text, a media reference its source, the
digest that the source names (sha256:<hex>), its caption (the figcaption of its figure, else the alternative
text) and both their position.  Payloads are stored as 8-bit greyscale PNG in a table with a row per digest
and task; they are found again by a join on the digest.  What a query needs of a payload is computed where the
payload is stored, so the join moves narrow rows, and payloads are neither shuffled nor sent to the driver.

The query makes a page of each document: its lines are paragraphs, with the figure of its payload in their
middle.  The page is parsed whole; positions and captions are those of the figure among the text runs.

Defined results: null and empty HTML is an empty sequence; scripts and styles are left out; references without
a digest, or whose digest isn't stored, stay in the sequence with null media columns.  Null text is an empty
payload.  Repeated rows give repeated results and equal texts equal values; empty tables give empty results;
very long texts are pages like others.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks, table

BLOCK, WIDTH = 576, 192
ITEM = "struct<position:int,kind:string,text:string,source:string,digest:string,caption:string>"
_MEDIA = {"img", "video", "audio", "source", "embed"}
_DIGEST = re.compile(r"^sha256:([0-9a-f]{64})$")
#: Digests that a task remembers at most, to store copies once.
SEEN = 100_000
#: A digest named by more than one in so many references is salted.
PARTS = 1024


# -- HTML to sequences ------------------------------------------------------------------------------------


class _Parser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.figures: list[int] = []  # where each open figure's items begin
        self.hidden = 0
        self.caption: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figure":
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA and own.get("src"):
            found = _DIGEST.match(own["src"])
            self.items.append({"kind": "media", "text": None, "source": own["src"], "digest": found and found[1], "caption": own.get("alt") or None})

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            for item in self.items[self.figures[-1] if self.figures else len(self.items) :]:
                if item["kind"] == "media" and words:
                    item["caption"] = words
            self.caption = None
        elif tag == "figure" and self.figures:
            self.figures.pop()

    def handle_data(self, data):
        if self.hidden:
            return
        if self.caption is not None:
            self.caption.append(data)
        elif words := " ".join(data.split()):
            if self.items and self.items[-1]["kind"] == "text":
                self.items[-1]["text"].append(words)
            else:
                self.items.append({"kind": "text", "text": [words], "source": None, "digest": None, "caption": None})


def parse(html: str | None) -> list[dict]:
    """The sequence of a page."""
    if not html:
        return []
    parser = _Parser()
    parser.feed(html)
    parser.close()
    return [{**item, "position": i, "text": item["text"] and " ".join(item["text"])} for i, item in enumerate(parser.items)]


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, items: array of ITEM."""
    import pyarrow as pa

    kind = pages.schema[key].dataType.simpleString()
    item = pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "source", "digest", "caption"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for own in chunks(x.as_py() for x in batch.column(1)):
                front = batch.column(0).slice(done, len(own))
                done += len(own)
                yield pa.RecordBatch.from_arrays([front, pa.array(map(parse, own), pa.list_(item))], [key, "items"])

    return pages.select(key, F.col(html).alias("html")).mapInArrow(run, f"`{key}` {kind}, items array<{ITEM}>")


# -- payloads ---------------------------------------------------------------------------------------------


def pad(text: str | None) -> tuple[int, bytes]:
    """A text's bytes, filled up with 255 to a positive multiple of BLOCK, and how many were its own."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes, width: int = WIDTH) -> bytes:
    """8-bit greyscale PNG with unfiltered rows; ``samples`` is a positive multiple of ``width``."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples [height, width] of an 8-bit greyscale PNG whose rows are unfiltered or filtered by Sub or Up."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, width, height = 8, [], 0, 0
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
            if (depth, colour, laced) != (8, 0, 0):
                raise ValueError("not 8-bit greyscale")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    out = lines[:, 1:].copy()
    if not (kinds := lines[:, 0]).any():
        return out
    for y, f in enumerate(kinds.tolist()):
        if f == 1:
            out[y] = np.cumsum(out[y], dtype=np.uint64).astype(np.uint8)
        elif f == 2:
            out[y] += out[y - 1] if y else 0
        elif f:
            raise ValueError("row filter not supported")
    return out


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation and a 64-bit hash: which of 8 x 8 cells are brighter than the mean of the cells."""
    h, w = samples.shape
    rows, cols = np.arange(8) * h // 8, np.arange(8) * w // 8
    sums = np.add.reduceat(np.add.reduceat(samples.astype(np.int64), cols, axis=1), rows, axis=0)
    size = np.maximum(np.diff(np.r_[rows, h]), 1)[:, None] * np.diff(np.r_[cols, w])[None]
    cells = sums / size
    bits = int("".join("1" if b else "0" for b in (cells > cells.mean()).ravel()), 2)
    return f"gray8:{w}x{h}:{samples.mean():.3f}:{samples.std():.3f}:{bits:016x}"


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, digest, media: the payload of each document; null where the task has stored its digest already."""
    import pyarrow as pa

    kind = docs.schema[doc_id].dataType.simpleString()
    names, kinds = ["n_bytes", "digest", "media"], (pa.int64(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            rows, held = [], 0
            start = 0
            for i in range(batch.num_rows):
                n, payload = pad(batch.column(1)[i].as_py())
                own = hashlib.sha256(payload).hexdigest()
                media = None
                if own not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(own)
                    media = to_png(payload)
                    held += len(media)
                rows.append((n, own, media))
                if held > 16 << 20 or i == batch.num_rows - 1:
                    cols = [batch.column(0).slice(start, i + 1 - start), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", *names])
                    rows, held, start = [], 0, i + 1

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, digest string, media binary")


def page_of(text: Column, digest: Column, n_bytes: Column) -> Column:
    """The HTML of a document: a paragraph for each line, and the payload's figure after the first half of them."""
    plain = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.split(plain, "\n")
    half = F.floor((F.size(lines) + 1) / 2).cast("int")
    paragraphs = lambda part: F.concat(F.lit("<p>"), F.array_join(part, "</p><p>"), F.lit("</p>"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('" alt=""><figcaption>'), n_bytes.cast("string"), F.lit(" bytes</figcaption></figure>"))
    return F.concat(F.lit("<article>"), paragraphs(F.slice(lines, 1, half)), figure, paragraphs(F.slice(lines, half + 1, F.size(lines))), F.lit("</article>"))


def padded(text: Column) -> Column:
    """The payload of ``pad`` as an expression."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    more = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / BLOCK)) * BLOCK - F.octet_length(raw)
    return F.concat(raw, F.substring(F.lit(b"\xff" * BLOCK), F.lit(1), more.cast("int")))


def describe(store: DataFrame) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: one row per digest."""
    import pyarrow as pa

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, media in zip(batch.column(0), batch.column(1), strict=True):
                data = media.as_py()
                samples = from_png(data)
                raw = samples.tobytes()
                rows.append((own.as_py(), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    out = store.select("digest", "media").where("media is not null").mapInArrow(run, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True)))
    return out.groupBy("digest").agg(*[F.first(n).alias(n) for n in names[1:]])


def resolve(items: DataFrame, media: DataFrame, columns: list[str], parts: int = PARTS) -> DataFrame:
    """Exploded sequences with the ``columns`` of their media, by digest; ``items`` is read twice, so it should be a table.

    A digest that more than one in ``parts`` of the references name is dealt over as many salts as bring each to
    that share, and its media row is there for each of them.  At most ``parts`` digests can be so frequent, which
    bounds what is broadcast, and salts are at most twice as many.
    """
    total = items.count()
    often = items.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("digest").isNotNull() & (F.col("n") * parts > total))
    often = often.select(F.col("digest").alias("_hot"), F.least(F.ceil(F.col("n") * parts / max(total, 1)), F.col("n")).alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    left = items.join(F.broadcast(often), F.col("digest") == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts)).drop("_hot", "_salts")
    own = media.select(F.col("digest").alias("_digest"), *columns).join(F.broadcast(often), F.col("_digest") == F.col("_hot"), "left")
    own = own.withColumn("_own", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("_hot", "_salts")
    return left.join(own, (F.col("digest") == F.col("_digest")) & (F.col("_salt") == F.col("_own")), "left").drop("_digest", "_salt", "_own")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "media")
    stored = scratch.keep(pack(docs), "stored")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    pages = docs.select(F.struct("doc_id", n_bytes.alias("n_bytes")).alias("page"), page_of(F.col("text"), F.sha2(padded(F.col("text")), 256), n_bytes).alias("html"))
    text_of = F.array_join(F.transform(F.filter("items", lambda i: i["kind"] == "text"), lambda i: i["text"]), "\n")
    items = sequences(pages, "page").select("page.*", F.size("items").alias("n_items"), F.sha2(text_of, 256).alias("texts_sha256"), F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias("i"))
    items = items.select("doc_id", "n_bytes", "n_items", "texts_sha256", F.col("i.digest").alias("digest"), F.col("i.position").alias("position"), F.col("i.caption").alias("caption"))
    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return resolve(scratch.keep(items, "items"), describe(stored), columns).select("doc_id", "n_bytes", *columns, "position", "caption", "n_items", "texts_sha256")
