"""Readers for the formats that package indexes and batches come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BLANK, trim
from ..functions.udfs import maybe_gunzip, tar_member, unxz, unzstd
from ..operators.recognize import file_type


def files(spark: SparkSession, path: str, cap: int = 64 << 20) -> DataFrame:
    """Files as ``(path, content, text, file_type, error)``; one over ``cap`` bytes is a row with an error, its body unread."""
    found = spark.read.format("binaryFile").load(path)
    long = found.where(F.col("length") > cap).select("path", F.lit("too large").alias("error"))
    raw = found.where(F.col("length") <= cap)
    rows = raw.select("path", "content", F.expr("CASE WHEN is_valid_utf8(CAST(content AS STRING)) THEN CAST(content AS STRING) END").alias("text"))
    read = rows.withColumns({"file_type": file_type("path", F.substring_index("text", "\n", 1)), "error": F.lit(None).cast("string")})
    return read.unionByName(long.withColumn("file_type", file_type("path", F.lit(None).cast("string"))), allowMissingColumns=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its files give fewer tasks (a file of one row group is one task); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stanzas(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line separated blocks, one row each; compressed files are read by Spark's codecs."""
    return spark.read.option("lineSep", "\n\n").text(path).select(F.regexp_replace("value", r"^\n+|\n+$", "").alias("stanza")).where("stanza <> ''")


def split_stanzas(df: DataFrame, body: str) -> DataFrame:
    """The same for index bodies held in a column."""
    rest = [c for c in df.columns if c != body]
    return df.select(*rest, F.posexplode(F.filter(F.split(body, r"\r?\n(?:\r?\n)+"), lambda t: t != "")).alias("pos", "stanza"))


def xml_packages(spark: SparkSession, path: str, tag: str = "package") -> DataFrame:
    """Elements of an XML index, one row each."""
    return spark.read.format("xml").option("rowTag", tag).load(path)


def split_elements(df: DataFrame, body: str, tag: str = "package") -> DataFrame:
    """The same for XML bodies held in a column; elements stay text."""
    rest = [c for c in df.columns if c != body]
    return df.select(*rest, F.posexplode(F.regexp_extract_all(body, F.lit(f"(?s)(<{tag}[\\s>].*?</{tag}>)"), 1)).alias("pos", "element"))


def json_lines(df: DataFrame, body: str) -> DataFrame:
    """Lines that hold JSON, one row each; bad lines drop out."""
    rest = [c for c in df.columns if c != body]
    rows = df.select(*rest, F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    return rows.where(F.try_parse_json("line").isNotNull())


def listing(df: DataFrame, body: str) -> DataFrame:
    """File names of a directory listing: the last path segment of each blank-separated token."""
    rest = [c for c in df.columns if c != body]
    return df.select(*rest, F.explode(F.split(trim(body), f"[{BLANK}]+")).alias("token")).withColumn("file", F.substring_index("token", "/", -1)).drop("token")


def unpack(df: DataFrame, content: str, codec: str, member: str | None = None) -> DataFrame:
    """Decompress a binary column (``gzip``, ``xz``, ``zstd``) and optionally take a tar member; over-long bodies become null."""
    step = {"gzip": maybe_gunzip, "xz": unxz, "zstd": unzstd}[codec]()
    out = df.withColumn(content, step(content))
    return out.withColumn(content, tar_member(member)(content)) if member else out


def purl_lines(spark: SparkSession, path: str) -> DataFrame:
    """One package URL a line, blank lines left out, in order within a file."""
    return spark.read.text(path).select(trim("value").alias("purl")).where("purl <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, line): every line with a place that sorts as the lines stand in their files."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    return spark.read.text(path).select(place.alias("place"), F.col("value").alias("line"))


def write_json_lines(rows: DataFrame, path: str, place: str = "place") -> None:
    """One JSON object a row, in the order of ``place`` over all files of ``path``; nulls are written out."""
    rest = [c for c in rows.columns if c != place]
    rows.orderBy(place).select(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def envelopes(records: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """JSON lines ``{record, sources}``: bodies that are JSON go inline, others as base64."""
    parsed = F.try_parse_json("content")
    b64 = F.translate(F.base64(F.col("content").cast("binary")), "\r\n", "")
    each = F.struct("url", "status", "content_type", parsed.alias("body"), F.when(parsed.isNull(), b64).alias("body_b64"))
    grouped = sources.withColumn("__s", F.to_json(each)).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "__s"))), lambda x: x["__s"]).alias("__sources"))
    body = F.to_json(F.struct(*[c for c in records.columns if c != key]))
    rows = records.withColumn("__record", body).join(grouped, key, "left")
    return rows.select(key, F.concat(F.lit('{"record":'), "__record", F.lit(',"sources":['), F.array_join(F.coalesce("__sources", F.array()), ","), F.lit("]}")).alias("json"))
