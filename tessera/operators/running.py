"""Running sums in the order of a whole group, whose rows may fill many tasks.

Rows are dealt into sorted ranges of (group, order) and written once. A first level adds up what each
range holds of each group, a second sums those totals over the ranges before (a row a range and
group), a third runs inside the ranges. So a group that holds all rows is as parallel as many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stages import cut

RANGE = "__range"


def ranged(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` in ranges of (group, order), the range's number under ``RANGE``; cut to a table, as ranges are drawn by sampling."""
    dealt = rows.repartitionByRange(*[F.col(c) for c in (*group, *order)])
    return cut(dealt.withColumn(RANGE, F.spark_partition_id()))


def running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Append to ``ranged`` rows, for each name in ``sums``, the sum over the rows before in the group, and as ``<name>_all`` the group's.

    Nulls count as nothing; null groups are one group. Rows that are equal in ``order`` should not be:
    which of them comes first is open.
    """
    values = {n: F.coalesce(v, F.lit(0)).cast("bigint") for n, v in sums.items()}
    totals = rows.groupBy(RANGE, *group).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    whole = Window.partitionBy(*group)
    before = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(RANGE).alias("__r"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__o_{n}") for n in sums], *[F.sum(n).over(whole).alias(f"__a_{n}") for n in sums])
    same = F.col(RANGE) == F.col("__r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(RANGE, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumns({f"__i_{n}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()}).join(offsets, same)
    out = found.withColumns({n: F.col(f"__o_{n}") + F.col(f"__i_{n}") for n in sums} | {f"{n}_all": F.col(f"__a_{n}") for n in sums})
    return out.drop("__r", *[f"__g{i}" for i in range(len(group))], *[f"__{x}_{n}" for x in "oai" for n in sums])
