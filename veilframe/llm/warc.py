"""WARC archives as a PySpark Python data source, ``veilframe_warc``.

Writing: each task writes files of gzip members, one a record; a member's extra field holds its compressed
length.  Names carry a random part, and only files that the driver commits are listed in ``_manifest.json``,
so tasks that are retried or run twice leave nothing that a reader sees.  The manifest also lists offsets at
which members begin, about every ``split_bytes``.

Reading: partitions are planned from the manifest (byte ranges at those offsets) or, without one, from the
*.warc and *.warc.gz files of the folder.  Predicates on record_type, target_uri, payload_digest, refers_to and
record_id are pushed down.  Of a record the headers are parsed first; where they fail a predicate, the rest
isn't inflated but skipped by the member's length (by Content-Length in plain files).

Options: path; split_bytes, file_bytes (writing); payload = false leaves payloads out (reading).  Local paths
and file: are read with open(), other schemes through pyarrow's file systems.

Defined results: null payloads are empty; rows that repeat an id are records each, with equal record ids where
id and page are repeated, and of one payload all rows with the smallest id are responses; very long payloads are
records like others; null ids give records of their own; null URLs give an empty target;
line ends in a URL become blanks; empty tables give an archive without records, which reads as an empty table.
Columns beside page_id, url and html aren't read by the query.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import Scratch, table

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: What a frame that is written must have.
IN_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
DATE = "2020-01-01T00:00:00Z"


class _Files:
    """The little of a file system that archives need."""

    def __init__(self, path: str):
        scheme = urlparse(path).scheme
        if scheme in ("", "file"):
            self.fs, self.root = None, (urlparse(path).path if scheme else path)
        else:
            from pyarrow.fs import FileSystem

            self.fs, self.root = FileSystem.from_uri(path)

    def _at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, name: str):
        return open(self._at(name), "rb") if self.fs is None else self.fs.open_input_file(self._at(name))

    def write(self, name: str):
        if self.fs is None:
            os.makedirs(self.root, exist_ok=True)
            return open(self._at(name), "wb")
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(self._at(name))

    def names(self) -> list[tuple[str, int]]:
        if self.fs is None:
            return sorted((e.name, e.stat().st_size) for e in os.scandir(self.root) if e.is_file())
        from pyarrow.fs import FileSelector

        return sorted((x.base_name, x.size) for x in self.fs.get_file_info(FileSelector(self.root)) if x.is_file)

    def remove(self, name: str) -> None:
        os.remove(self._at(name)) if self.fs is None else self.fs.delete_file(self._at(name))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row: dict) -> bytes:
    """One record: a response with its HTTP block, or a revisit with the HTTP headers alone."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    n = row["payload_bytes"] if revisit and row["payload_bytes"] is not None else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {n}\r\n\r\n".encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((row['target_uri'] or '').split())}", f"WARC-Payload-Digest: sha1:{row['payload_digest'] or digest(payload)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field "sl" holds the lengths of the member and of the data."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 20 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + (20).to_bytes(2, "little") + b"sl" + (16).to_bytes(2, "little") + size.to_bytes(8, "little") + len(data).to_bytes(8, "little")
    return head + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


@dataclass
class _Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.split, self.most = int(options.get("split_bytes", 32 << 20)), int(options.get("file_bytes", 512 << 20))

    def write(self, iterator) -> _Written:
        files, done, out = _Files(self.path), [], None
        for batch in iterator:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(names)}
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, at, starts = files.write(name), 0, [0]
                if at - starts[-1] >= self.split:
                    starts.append(at)
                data = member(record(row))
                out.write(data)
                at += len(data)
                if at >= self.most:
                    out.close()
                    done.append({"name": name, "size": at, "starts": starts})
                    out = None
        if out is not None:
            out.close()
            done.append({"name": name, "size": at, "starts": starts})
        return _Written(done)

    def commit(self, messages) -> None:
        files = _Files(self.path)
        own = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
        if not self.overwrite:
            own = _manifest(files) + own
        with files.write("_manifest.json") as out:
            out.write(json.dumps({"files": own}).encode())

    def abort(self, messages) -> None:
        files = _Files(self.path)
        for m in messages:
            for f in m.files if m else ():
                files.remove(f["name"])


def _manifest(files: _Files) -> list[dict]:
    try:
        with files.read("_manifest.json") as f:
            return json.loads(f.read())["files"]
    except FileNotFoundError:
        return []


@dataclass
class _Range(InputPartition):
    name: str
    start: int
    end: int

    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _clean(column: str, value: str | None) -> str | None:
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if column == "payload_digest" else value


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.tests = options["path"], options.get("payload", "true") != "false", []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in _HEADER and isinstance(f, EqualTo):
                self.tests.append((column, "in", [f.value]))
            elif column in _HEADER and isinstance(f, In):
                self.tests.append((column, "in", list(f.value)))
            elif column in _HEADER and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif column in _HEADER and isinstance(f, IsNotNull):
                self.tests.append((column, "some", None))
            else:
                yield f

    def partitions(self):
        files = _Files(self.path)
        if own := _manifest(files):
            return [_Range(f["name"], a, b) for f in own for a, b in zip(f["starts"], [*f["starts"][1:], f["size"]], strict=True)]
        try:
            listed = files.names()
        except FileNotFoundError:
            listed = []
        return [_Range(n, 0, size) for n, size in listed if n.endswith((".warc", ".warc.gz"))] or [_Range("", 0, 0)]

    def wanted(self, head: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            own = _clean(column, head.get(_HEADER[column]))
            if own is None or kind == "in" and own not in value or kind == "starts" and not own.startswith(value):
                return False
        return True

    def read(self, partition):
        import pyarrow as pa

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        if partition.name:
            with _Files(self.path).read(partition.name) as f:
                records = _gzipped if partition.name.endswith(".gz") else _plain
                for head, block in records(f, partition.start, partition.end, self.wanted):
                    rows.append(self._row(head, block))
                    size += len(rows[-1][-1] or b"")
                    if len(rows) >= 4096 or size >= 8 << 20:
                        yield batch()
                        rows, size = [], 0
        yield batch()

    def _row(self, head: dict[str, str], block: bytes) -> tuple:
        inner, payload = {}, block
        if head.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            inner = _headers(top)
        own = {c: _clean(c, head.get(h)) for c, h in _HEADER.items()}
        if own["record_type"] == "revisit":
            n, payload = int(inner.get("content-length", 0)), None
        else:
            n = len(payload)
            if own["payload_digest"] and digest(payload) != own["payload_digest"]:
                raise ValueError(f"payload of {own['record_id']} doesn't have its digest")
        return (*own.values(), n, payload if self.payload else None)


def _plain(f, start: int, end: int, wanted) -> Iterator[tuple[dict, bytes]]:
    at, held = start, b""
    while at < end:
        f.seek(at)
        held = b""
        while (cut := held.find(b"\r\n\r\n")) < 0:
            more = f.read(1 << 13)
            if not more:
                return
            held += more
        head = _headers(held[:cut])
        n, begin = int(head["content-length"]), at + cut + 4
        if wanted(head):
            f.seek(begin)
            yield head, f.read(n)
        at = begin + n + 4


def _gzipped(f, start: int, end: int, wanted) -> Iterator[tuple[dict, bytes]]:
    at = start
    while at < end:
        f.seek(at)
        raw = f.read(1 << 13)
        size = None
        if len(raw) >= 32 and raw[3] & 4 and raw[12:14] == b"sl":
            size = int.from_bytes(raw[16:24], "little")
        unpack = zlib.decompressobj(16 + zlib.MAX_WBITS)
        held, taken = unpack.decompress(raw, 1 << 12), len(raw)

        def more() -> bytes:
            nonlocal taken
            if unpack.unconsumed_tail:
                return unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            data = f.read(1 << 16)
            if not data:
                raise ValueError(f"the member at {at} is cut short")
            taken += len(data)
            return unpack.decompress(data, 1 << 16)

        # A member of known length is one record; any other goes on until its data ends.
        while True:
            held = held.lstrip(b"\r\n")
            while (cut := held.find(b"\r\n\r\n")) < 0 and not unpack.eof:
                held = (held + more()).lstrip(b"\r\n")
            if not held:
                break
            if cut < 0:
                raise ValueError(f"the member at {at} has data behind its last record")
            head = _headers(held[:cut])
            want = wanted(head)
            if not want and size is not None:
                break
            n, parts = int(head["content-length"]), [held[cut + 4 :]]
            got = len(parts[0])
            while got < n and not unpack.eof:
                data = more()
                got += len(data)
                if want:
                    parts.append(data)
                else:
                    parts = [data]
            if got < n:
                raise ValueError(f"a record of the member at {at} is cut short")
            held = parts[-1][len(parts[-1]) - (got - n) :]
            if want:
                yield head, b"".join(parts)[:n]
        at += taken - len(unpack.unused_data) if size is None else size


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "veilframe_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def to_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Records of pages: of equal payloads of at least ``min_revisit_bytes`` the smallest id is the response.

    Ids and hex digests alone find the first of each payload that occurs twice.  These are joined to the pages,
    whose payloads go through that shuffle once; a digest that a third of the pages have is a skewed key of the
    left side, which AQE splits.
    """
    own = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("hex", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    firsts = own.where(F.col("id").isNotNull() & (F.col("payload_bytes") >= min_revisit_bytes)).groupBy(F.col("hex").alias("h"), F.col("payload_bytes").alias("b")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    both = own.join(firsts, (F.col("hex") == F.col("h")) & (F.col("payload_bytes") == F.col("b")), "left")
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    urn = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")))
    bits = F.array(*[F.conv(F.substring("hex", 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)])
    letter = lambda x: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), x + 1, F.lit(1))
    base32 = F.array_join(F.transform(bits, lambda x: F.concat(*[letter(F.shiftright(x, s).bitwiseAND(31)) for s in (15, 10, 5, 0)])), "")
    return both.select(
        urn(F.col("id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        base32.alias("payload_digest"),
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("veilframe_warc").option("payload", str(payload).lower()).load(path)


def op3_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """Write the archives; read responses with their payloads, and revisits by their headers alone."""
    register(spark)
    path = Scratch(spark, "warc").path("archives")
    to_records(table(spark, sf_dir, "pages")).write.format("veilframe_warc").mode("append").save(path)
    id_of = lambda c: F.try_element_at(F.split(c, ":"), F.lit(3)).try_cast("long")
    responses = read_archive(spark, path).where("record_type = 'response'").withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    revisits = read_archive(spark, path, payload=False).where("record_type = 'revisit'")
    both = responses.drop("payload").unionByName(revisits.drop("payload"))
    return both.select(id_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of(F.col("refers_to")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) b FROM pages),
h AS (SELECT page_id, octet_length(b) n, sha1(b) s, min(page_id) OVER (PARTITION BY b) f FROM p)
SELECT page_id, CAST(n AS BIGINT) payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') payload_digest,
CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id > f THEN f END refers_to FROM h
"""
