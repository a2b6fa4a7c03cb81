"""Shared-folder tables that cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session on one machine that names no ``spark.checkpoint.dir`` (tests, bench).
LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a session on a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or LOCAL_DIR


class Workspace:
    """A fresh sub-folder of the shared folder; ``table`` writes a DataFrame there and rereads it.

    Tables are Parquet written through Spark's commit protocol, so a lost executor costs a task
    retry and never the rows. The folder is deleted when the driver's JVM ends; ``drop`` deletes
    tables as soon as nothing reads them, ``keep`` all but the ones named.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self._n, self._paths = 0, {}
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def folder(self, name: str) -> str:
        """The path of a new folder for files that aren't tables."""
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def remove(self, path: str) -> None:
        """Delete a folder that ``folder`` named."""
        self._fs.delete(self._path(path), True)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self._paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``table`` returned; others are left alone."""
        for df in tables:
            path, _ = self._paths.pop(id(df), (None, None))
            if path:
                self._fs.delete(self._path(path), True)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        named = {id(df) for df in tables}
        self.drop(*[df for key, (_, df) in list(self._paths.items()) if key not in named])
