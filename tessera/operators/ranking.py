"""One row of each group: the best by rank, the one asked for or else the first, the first repository's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col


def wheel_rank(filename) -> Column:
    """How portable a built archive is: 0 for any interpreter and platform, 1 for any platform, 2 else."""
    return F.when(col(filename).endswith("-py3-none-any.whl"), 0).when(col(filename).contains("-none-any."), 1).otherwise(2)


def best(rows: DataFrame, group: list[str], rank: Column, order: list[str]) -> DataFrame:
    """The row of lowest ``rank`` of each group, ties by ``order``; an aggregate, so a hot group is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in group]
    picked = rows.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(rank, *order)).alias("__best"))
    return picked.select(*group, *[F.col(f"__best.{c}").alias(c) for c in rest])


def asked_or_first(rows: DataFrame, group: list[str], asked: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Append ``out``: ``value`` of the first row of the group for which ``asked`` holds, else of its first row."""
    found = rows.groupBy(*group).agg(F.min_by(value, F.struct((~F.coalesce(asked, F.lit(False))).cast("int"), *order)).alias(out))
    return rows.join(found, group)


def first_repository(hits: DataFrame, key: list[str], rank: str = "repo_rank") -> DataFrame:
    """The hit of the first repository that has one, for each key."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(rank))
    return hits.withColumn("__n", nth).where("__n = 1").drop("__n")
