"""Scratch storage in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset a folder of our own serves a local session; on a cluster, whose executors could not
    read it, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own_root.setdefault("root", "") or tempfile.mkdtemp(prefix="veilframe-")
        _own_root["root"] = root
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and lost executors lose nothing.

    ``keep`` writes and rereads a frame; ``drop`` removes one that no later plan reads.  What a lazy
    result still reads stays until the session's Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/veilframe/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._delete(self.path(name))

    def close(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # noqa: BLE001  the JVM may be gone when Python exits
            pass

    def _delete(self, where: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
