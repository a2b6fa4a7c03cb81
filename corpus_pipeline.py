"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; its output is
written as Parquet and reread as the next stage's ``docs``. All stages take empty tables (and return
empty ones), texts of any length, repeated rows, bytes that aren't UTF-8, and further columns of any
name; what they do with nulls and ties is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.langid import fit, identify
from tessera.llm.linededup import line_dedup
from tessera.llm.mixing import mix_sources
from tessera.llm.packing import pack_documents
from tessera.llm.setsketch import near_dedup
from tessera.llm.workspace import Workspace


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the classifier accepts; ``lang`` stays as it came.

    Null, empty and letterless texts go. Repeated rows fare alike; ties between languages don't
    matter. Where no row is labelled there is nothing to learn, and all texts with a letter stay.
    """
    model = fit(docs)
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return identify(docs, model).where("NOT lang_rejected").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeated runs of lines from the texts; ``n_chars`` follows the text.

    The run in the smallest id stays (a null id before all others). Null texts stay null, with a null
    ``n_chars``; a text of which nothing is left stays as ''.
    """
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, the one of smallest id (a null id last).

    Of rows with equal id and text one stays. Texts without words, null ones too, are no duplicates.
    """
    return near_dedup(docs).select(*docs.columns)


#: Rests that wait together in packing: how far a document can be from its place in the mixture.
REACH = 256


def _in_order(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` in the order of the mixture: partition k holds the k-th stretch of positions, sorted."""
    parts, total = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, docs.count())
    stretch = F.floor(F.col("mix_position") * parts / total).cast("int")  # positions are gapless: equal stretches without sampling
    return mix_sources(docs).repartitionById(parts, stretch).sortWithinPartitions("mix_position").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put all documents in the order of the mixture: files, and rows in them, follow it.

    Null sources are one source; ties go by id, and repeated rows follow one another.
    """
    return _in_order(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mixture into sequences of 1024 ids; sequence ids follow the mixture.

    Readers deal files out by size, so the order is made again from the rows, of which it is a
    function; each task packs one stretch, ``REACH`` rests at a time. Null texts are packed as empty
    ones; null and repeated ids like others.
    """
    return pack_documents(_in_order(spark, docs), window=REACH)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_dup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, work.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        work.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
