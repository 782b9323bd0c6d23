"""Sources and sinks of the engine's own records: JSON lines with a fixed schema, and attested bodies.

Reading is by declared schema, so nothing is inferred and only asked-for columns are parsed; lines that aren't
records are kept apart, not dropped.  What leaves is checked against its digest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: the columns of an event record.
EVENT = "event_id STRING, type STRING, ts LONG, tab LONG, payload STRING"
_BAD = "_bad"
#: Fixed: what stands for text that telemetry may not hold, and how long an identifier may be.
NO_TEXT, LONGEST = "[REDACTED_BY_I11]", 40


def read_events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """Records of JSON lines, with ``_bad`` for lines that aren't any; empty lines are skipped."""
    fields = [*T._parse_datatype_string(schema).fields, T.StructField(_BAD, T.StringType())]
    return spark.read.schema(T.StructType(fields)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).json(path)


def stream_events(spark: SparkSession, path: str, schema: str = EVENT, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def write_events(frame: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines, a file a task; null columns are left out, as readers declare their schema."""
    frame.write.mode(mode).option("compression", "gzip").json(path)


def attested(frame: DataFrame, body: str = "body", digest: str = "sha256") -> DataFrame:
    """The rows whose body has the digest beside it; what doesn't, or has none, may not leave."""
    return frame.where(F.coalesce(F.sha2(F.col(body), 256) == F.col(digest), F.lit(False)))


def write_attested(frame: DataFrame, path: str, body: str = "body", digest: str = "sha256", mode: str = "append") -> None:
    """The sink: one JSON line per attested row, the rest is never written."""
    attested(frame, body, digest).write.mode(mode).json(path)


def attested_sink(stream: DataFrame, path: str, checkpoint: str, body: str = "body", digest: str = "sha256"):
    """The sink of a stream: each batch has a folder of its own, so one that is tried again replaces itself.

    A writer to start; which batches it takes is up to its trigger.
    """
    return stream.writeStream.foreachBatch(lambda frame, n: write_attested(frame, f"{path}/batch={n}", body, digest, "overwrite")).option("checkpointLocation", checkpoint)


def clean_telemetry(events: DataFrame, meta: str = "meta", duration: str = "duration") -> DataFrame:
    """Of ``meta``, a map of strings, short values without a blank (ids, words, numbers) stay; durations have three decimals."""
    one = lambda v: F.when((F.length(v) <= LONGEST) & ~v.contains(" "), v).when(v.isNotNull(), NO_TEXT)
    return events.withColumn(meta, F.transform_values(meta, lambda k, v: one(v))).withColumn(duration, F.floor(F.col(duration) * 1000 + 0.5) / 1000)


class TelemetryStore:
    """Events by stage and cycle: a folder a stage, in it rows by cycle, so both lookups skip what they don't want.

    A stage is a folder pruned when planning; within it a cycle is found by the row groups' minima and maxima.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, events: DataFrame) -> None:
        """Events with columns cycle, stage, duration, meta and whatever else; cleaned before they're written."""
        clean_telemetry(events).repartition("stage", F.pmod(F.xxhash64("cycle"), F.lit(64))).sortWithinPartitions("stage", "cycle").write.mode("append").partitionBy("stage").parquet(self.path)

    def by_cycle(self, cycle: object) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("cycle") == F.lit(cycle))

    def by_stage(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("stage") == stage)


class KeyedStore:
    """A table of the latest value by key, as Parquet files of appended versions.

    ``put`` appends; ``get`` reads the highest version of each key.  Compaction rewrites the table into a new
    folder, so a reader of the old one isn't disturbed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, frame: DataFrame) -> None:
        """Columns key, value, version; null values delete."""
        frame.select(F.col("key").cast("string"), F.col("value").cast("string"), F.col("version").cast("long")).write.mode("append").parquet(self.path)

    def get(self, keys: DataFrame | None = None) -> DataFrame:
        """key, value, version of what is there, or of the ``keys`` asked for."""
        own = self.spark.read.schema("key string, value string, version long").parquet(self.path)
        if keys is not None:
            own = own.join(keys.select("key").distinct(), "key", "left_semi")
        last = own.groupBy("key").agg(F.max(F.struct("version", "value")).alias("r"))
        return last.select("key", "r.value", "r.version").where("value is not null")

    def compact(self, path: str) -> KeyedStore:
        self.get().write.mode("errorifexists").parquet(path)
        return KeyedStore(self.spark, path)

    def clear(self) -> None:
        """Every key is deleted by a version above its last."""
        self.put(self.get().select("key", F.lit(None).alias("value"), (F.col("version") + 1).alias("version")))


class SealedStore(KeyedStore):
    """Credentials: values are AES-GCM sealed with their key as associated data, so one can't stand in for another.

    ``secret`` is a Column of 16 or 32 bytes.  Values leave by ``opened`` alone.
    """

    def __init__(self, spark: SparkSession, path: str, secret: Column):
        super().__init__(spark, path)
        self.secret = secret

    def put(self, frame: DataFrame) -> None:
        own = F.base64(F.aes_encrypt(F.encode("value", "utf-8"), self.secret, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.encode(F.col("key").cast("string"), "utf-8")))
        super().put(frame.withColumn("value", own))

    def opened(self, keys: DataFrame | None = None) -> DataFrame:
        """key, value, version; a value that another key or secret sealed is an error."""
        own = F.aes_decrypt(F.unbase64("value"), self.secret, F.lit("GCM"), F.lit("DEFAULT"), F.encode("key", "utf-8"))
        return self.get(keys).select("key", own.cast("string").alias("value"), "version")

    def compact(self, path: str) -> SealedStore:
        super().compact(path)
        return SealedStore(self.spark, path, self.secret)
