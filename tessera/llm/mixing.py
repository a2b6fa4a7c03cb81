"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of documents. Block j of a source with weight w is released at
floor(j / w) and due at ceil((j + 1) / w); earliest-deadline-first over one block slot at a time meets
every window, so after any number of slots a source is less than one block away from its target.
Weights are exact fractions of the numbers given, never rounded to slots, and all blocks of all
sources are scheduled, so the error doesn't grow with the input.

Scale: the schedule is walked on the driver, two heap steps a block, and broadcast as two numbers a
block; ``MOST_BLOCKS`` bounds both, since blocks hold more documents from 8 million rows on. Ids alone
are ranked, inside hashed buckets of their source; texts are exchanged once, to meet their places.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents a block, at least; blocks at most (16 bytes each); rows a bucket in which ids are ranked, about.
BLOCK, MOST_BLOCKS, BUCKET_ROWS = 8, 1 << 20, 1 << 16


def walk(weights: list, blocks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, source number) of all blocks in order, by earliest deadline among released blocks.

    ``weights`` are relative and taken exactly. Ties on the deadline go to the window with the
    successor released early (its bit is set), then by number. Windows of all sources fit into one
    slot at a time, so every deadline is met; slots of sources that have run out stay empty. Sources
    of weight 0 have no deadline: they follow all others, one after another.
    """
    exact = [max(Fraction(0), Fraction(w)) for w in weights]
    scale = math.lcm(*[w.denominator for w in exact])
    share = [int(w * scale) for w in exact]
    total, now, slots, order = sum(share), 0, array("q"), array("q")
    done, ready, waiting = [0] * len(share), [], [(0, s) for s in range(len(share)) if blocks[s] and share[s]]
    while waiting or ready:
        if not ready:
            now = max(now, waiting[0][0])
        while waiting and waiting[0][0] <= now:
            s = heapq.heappop(waiting)[1]
            due, early = divmod(-(done[s] + 1) * total, share[s])
            heapq.heappush(ready, (-due, not early, s))
        due, _, s = heapq.heappop(ready)
        assert now < due, "a block missed its deadline"
        slots.append(now)
        order.append(s)
        done[s] += 1
        now += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (done[s] * total // share[s], s))
    for s in range(len(share)):
        if not share[s]:
            slots.extend(range(now, now + blocks[s]))
            order.extend([s] * blocks[s])
            now += blocks[s]
    return np.array(slots, np.int64), np.array(order, np.int64)


def _ranked(ids: DataFrame, buckets: int) -> DataFrame:
    """``ids(key, n)`` with ``rank``: how many rows of the source come before, in the order of a hash of the id.

    A source is dealt into ``buckets`` by hash, counted there (pre-aggregated), and ranked inside a
    bucket only; the offsets are a running sum over at most ``buckets`` counts a source.
    """
    drawn = ids.withColumn("h", F.xxhash64(F.lit("mixing"), F.col("key.id"))).withColumn("at", F.struct(F.col("key.pool").alias("pool"), F.pmod("h", F.lit(buckets)).alias("bucket")))
    counts = drawn.groupBy("at").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("at.pool").orderBy("at.bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("at", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("at").orderBy("h", "key.id").rowsBetween(Window.unboundedPreceding, -1)
    local = drawn.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(offsets, "at").select("key", "n", (F.col("local") + F.col("ahead")).alias("rank"))


def mix_sources(docs: DataFrame, weights: dict | None = None, *, id_col: str = "doc_id", source_col: str = "source", block: int | None = None, buckets: int | None = None) -> DataFrame:
    """Append ``mix_source``, ``mix_block``, ``mix_slot`` and ``mix_position`` (gapless from 0) to every row.

    ``weights`` gives target shares by source; sources it doesn't name, and those of weight 0, come
    after all others. Default weights are the square roots of the sources' document counts. ``block``
    is ``BLOCK`` documents, or more where a source's rows would else make over ``MOST_BLOCKS``.
    While every source lasts, each is less than one block from its target after any number of slots;
    when a source runs out its slots are left out and the others keep their proportions. Every row is
    placed once; null sources are one source of their own; ties of the hash go by id; repeated rows
    take neighbouring places; an empty table stays empty. Existing columns of the four names are
    replaced, all others stay, whatever they are called.
    """
    cols = [c for c in docs.columns if c not in ("mix_source", "mix_block", "mix_slot", "mix_position")]
    pool = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(source_col).cast("string").alias("source"), F.struct(pool.alias("pool"), F.col(id_col).alias("id")).alias("key"))
    ids = rows.groupBy("key").agg(F.count("*").alias("n"))
    held = {r[0]: r[1] for r in rows.groupBy(F.col("key.pool").alias("pool")).count().collect()}  # one count a source
    if weights is None:
        targets = {k: n**0.5 for k, n in held.items()}
    else:
        targets = {"null" if k is None else f"={k}": w for k, w in weights.items()}
    names = sorted(held)
    total = np.array([held[k] for k in names], np.int64)
    block = block or max(BLOCK, -(-int(total.sum()) // MOST_BLOCKS))
    blocks = -(-total // block)
    slots, order = walk([targets.get(k, 0) for k in names], blocks.tolist())
    # blocks are stored by source and number, each with its slot and the documents that run earlier
    first = np.cumsum(blocks) - blocks
    by_source = np.argsort(order, kind="stable")
    length = np.full(len(order), block, np.int64)
    length[by_source[first + blocks - 1]] = total - (blocks - 1) * block
    ahead = np.cumsum(length) - length
    shared = docs.sparkSession.sparkContext.broadcast((names, first, slots[by_source], ahead[by_source], block))

    @F.pandas_udf("block long, slot long, position long")
    def place(pool, rank):
        import pandas as pd

        names, first, slots, ahead, block = shared.value
        j, inside = np.divmod(rank.to_numpy(), block)
        at = first[pd.Index(names).get_indexer(pool)] + j
        return pd.DataFrame({"block": j, "slot": slots[at], "position": ahead[at] + inside})

    ranked = _ranked(ids, buckets or max(256, -(-int(total.sum()) // BUCKET_ROWS)))
    again = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))) - 1  # rows of one source and id
    placed = rows.join(ranked, "key").withColumn("rank", F.col("rank") + F.when(F.col("n") > 1, again).otherwise(0))
    placed = placed.select("row", "source", place("key.pool", "rank").alias("p"))
    return placed.select("row.*", F.col("source").alias("mix_source"), F.col("p.block").alias("mix_block"), F.col("p.slot").alias("mix_slot"), F.col("p.position").alias("mix_position"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mixture of all sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_sources(docs).select("doc_id", "source", "mix_source", "mix_block", "mix_slot", "mix_position")
