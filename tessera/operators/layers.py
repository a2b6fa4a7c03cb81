"""Flattening image layers: the topmost entry of a path wins unless a marker above it hides it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col

WHITEOUT, OPAQUE = ".wh.", ".wh..wh..opq"


def clean_path(path) -> Column:
    """A path anchored at the root: no empty and ``.`` parts, and ``..`` never leads above the root."""
    return F.aggregate(
        F.split(col(path), "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when((part == "") | (part == "."), acc).when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part))),
        lambda acc: F.array_join(acc, "/"),
    )


def _split(path: Column) -> tuple[Column, Column]:
    base = F.substring_index(path, "/", -1)
    return F.when(path.contains("/"), F.substring(path, F.lit(1), F.length(path) - F.length(base) - 1)).otherwise(F.lit("")), base


def flatten(entries: DataFrame, image: str = "image", layer: str = "layer_no", entry: list[str] | str = "entry_no", path: str = "path") -> DataFrame:
    """Entries of the flattened image: rows of ``entries`` with their cleaned path.

    A ``.wh.name`` marker hides the path and all below it, an opaque marker all below its folder, in
    lower layers only; markers and the root itself don't appear. Hiding is an equi-anti-join on each
    path's ancestors, with the layers compared as residual, so no pair of paths is compared.
    """
    order = [entry] if isinstance(entry, str) else entry
    rows = entries.withColumn(path, clean_path(path))
    folder, base = _split(F.col(path))
    rows = rows.withColumns({"__dir": folder, "__base": base})
    join = lambda name: F.when(F.col("__dir") == "", name).otherwise(F.concat(F.col("__dir"), F.lit("/"), name))
    marks = rows.where(F.col("__base").startswith(WHITEOUT))
    opaque = F.col("__base") == OPAQUE
    hidden = marks.select(F.col(image).alias("__image"), F.col(layer).alias("__above"), F.when(opaque, F.col("__dir")).otherwise(join(F.substr(F.col("__base"), F.lit(len(WHITEOUT) + 1)))).alias("__under"), opaque.alias("__opaque"))
    hidden = hidden.groupBy("__image", "__under", "__opaque").agg(F.max("__above").alias("__above"))
    real = rows.where(~F.col("__base").startswith(WHITEOUT) & (F.col(path) != ""))
    top = real.withColumn("__rank", F.row_number().over(Window.partitionBy(image, path).orderBy(F.col(layer).desc(), *order))).where("__rank = 1")
    parts = F.split(F.col(path), "/")
    over = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("p"), (n == F.size(parts)).alias("own")))
    ancestors = top.select(image, path, layer, F.explode(over).alias("a"))
    gone = ancestors.join(hidden, (F.col(image) == F.col("__image")) & (F.col("a.p") == F.col("__under")) & (F.col("__above") > F.col(layer)) & ~(F.col("a.own") & F.col("__opaque")))
    return top.join(gone.select(image, path).distinct(), [image, path], "left_anti").drop("__rank", "__dir", "__base")


def within_budget(layers: DataFrame, image: str = "image", size: str = "bytes", max_layers: int = 256, max_bytes: int = 2 << 30) -> DataFrame:
    """Images whose layers stay within the count and the aggregate size; the rest is refused whole."""
    return layers.groupBy(image).agg(F.count("*").alias("layers"), F.sum(size).alias("bytes")).where((F.col("layers") <= max_layers) & (F.col("bytes") <= max_bytes))
