"""Between the stages of a plan: tables in the folder that driver and executors share, and joins of growing tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there: a lost executor doesn't cost it, and it is computed once.

    The folder is the session's ``spark.checkpoint.dir``. Only a session on one machine may leave that
    unset; it gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two growing tables by shuffle, whatever their sizes are taken for.

    Spark takes a table made from a narrow column (exploded rows, long texts) for not much larger than the
    column, and would send it whole through the driver to all executors.
    """
    return left.join(right.hint("merge"), on, how)
