"""The blob cache as Parquet: answers and accesses are appended, a sweep writes the next generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fetching import FACTS, needs_touch
from ..operators.sweep import MAX_AGE, MAX_CACHE_BYTES, evict

SCHEMA = "key string, component string, fetched_at bigint, content binary, status int, content_type string"
TOUCHES = "key string, accessed_at bigint"
#: The setting that names the folder; ``off`` disables the cache.
SETTING = "spark.tessera.cache.dir"


class Cache:
    """``path`` holds generations of two folders each; without a path nothing is kept and every read is empty."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        named = path or spark.conf.get(SETTING, "off")
        self.spark, self.path = spark, None if named == "off" else named.rstrip("/")

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _generations(self) -> list[int]:
        root, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/blobs/_SUCCESS")))

    def _read(self, folder: str, schema: str) -> DataFrame:
        found = self._generations() if self.path else []
        where = f"{self.path}/{found[-1] if found else 0}/{folder}"
        if self.path and self._fs()[1].exists(self.spark._jvm.org.apache.hadoop.fs.Path(where)):
            return self.spark.read.schema(schema).parquet(where)
        return self.spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame, folder: str) -> None:
        if self.path:
            found = self._generations()
            rows.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/{found[-1] if found else 0}/{folder}")

    def entries(self) -> DataFrame:
        """(key, component, fetched_at, content, status, content_type, accessed_at): the newest answer of each key, and when it was last used."""
        newest = self._read("blobs", SCHEMA).groupBy("key").agg(F.max_by(F.struct("component", "fetched_at", "content", *FACTS), "fetched_at").alias("e"))
        used = self._read("touches", TOUCHES).groupBy("key").agg(F.max("accessed_at").alias("used"))
        rows = newest.join(used, "key", "left").select("key", "e.*", "used")
        return rows.withColumn("accessed_at", F.greatest("fetched_at", "used")).drop("used")

    def put(self, answers: DataFrame, component: str, now: int) -> None:
        """Keep ``answers(key, content[, status, content_type])`` fetched at ``now``; null bodies and keys aren't kept."""
        rows = answers.where("key IS NOT NULL AND content IS NOT NULL")
        facts = [(F.col(f) if f in answers.columns else F.lit(None)).cast(t).alias(f) for f, t in FACTS.items()]
        self._append(rows.select("key", F.lit(component).alias("component"), F.lit(now).cast("bigint").alias("fetched_at"), F.col("content").cast("binary").alias("content"), *facts), "blobs")

    def touch(self, keys: DataFrame, now: int) -> None:
        """Note that ``keys(key)`` were used, for entries not noted within a day."""
        due = self.entries().select("key", "accessed_at").join(keys.select("key").distinct(), "key").where(needs_touch("accessed_at", F.lit(now)))
        self._append(due.select("key", F.lit(now).cast("bigint").alias("accessed_at")), "touches")

    def sizes(self) -> DataFrame:
        """(component, entries, bytes) of what is held."""
        return self.entries().groupBy("component").agg(F.count("*").alias("entries"), F.sum(F.octet_length("content")).alias("bytes"))

    def sweep(self, now: int, max_age: int = MAX_AGE, max_bytes: int = MAX_CACHE_BYTES) -> DataFrame:
        """Write the generation without what is too old or too much, drop the former ones, and tell (key, evicted_by)."""
        marked = evict(self.entries().withColumn("bytes", F.octet_length("content").cast("bigint")), now, path="key", modified="accessed_at", max_age=max_age, max_bytes=max_bytes)
        if not self.path:
            return marked.select("key", "evicted_by")
        before = self._generations()
        new = f"{self.path}/{(before[-1] if before else 0) + 1}"
        marked.select("key", "evicted_by").write.mode("overwrite").parquet(f"{new}/swept")
        gone = self.spark.read.parquet(f"{new}/swept").where("evicted_by IS NOT NULL").select("key")
        left = self.entries().join(gone, "key", "left_anti")
        left.select("key", "accessed_at").write.mode("overwrite").parquet(f"{new}/touches")
        left.select("key", "component", "fetched_at", "content", *FACTS).write.mode("overwrite").option("compression", "zstd").parquet(f"{new}/blobs")  # last: its success makes the generation count
        for n in before:
            self._fs()[1].delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}"), True)
        return self.spark.read.parquet(f"{new}/swept")
