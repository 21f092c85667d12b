"""Uniform sharding with exact shard sizes: a hypergeometric communication matrix.

Rows sit in P partitions of known sizes and go to S shards of fixed sizes. A uniform permutation of all rows puts a
multivariate hypergeometric number of partition p's rows into shard s. That matrix is drawn; each partition permutes
its own rows over its row of the matrix, and the rows are exchanged once. In its shard a row's place is that of a
random key: a shard is cut into blocks by key that one task can sort, and slots follow from the blocks' sizes.

No process holds the matrix. Partitions are the leaves of a binary tree; at a node the shards' capacities are split
between its halves by draws seeded with the node, so a task walks from the root to its own leaf in S log P draws
and every task agrees with every other. Broadcast: one long a partition.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import scratch_root
from .shared import maybe_broadcast, unused

#: Rows of a shard that one task sorts, about.
BLOCK_ROWS = 1 << 17
#: Populations from here on are beyond numpy's sampler.
LARGE = 1_000_000_000


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric draw. Beyond numpy's sampler it comes from the table of probabilities in double precision, over
    12 standard deviations to each side of the mean."""
    if min(good, n) == 0:
        return 0
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(n, good)
    mean = n * (good / (good + bad))
    sd = math.sqrt(max(1.0, mean * (bad / (good + bad)) * (1 - n / (good + bad))))
    a, b = max(lo, int(mean - 12 * sd) - 12), min(hi, int(mean + 12 * sd) + 12)
    k = np.arange(a, b, dtype=np.float64)
    ratio = ((good - k) / (k + 1)) * ((n - k) / (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
    mass = np.exp(logs - logs.max())
    return a + int(np.searchsorted(np.cumsum(mass), rng.random() * mass.sum()))


def split(rng: np.random.Generator, capacities: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows, drawn from all, go to each shard: one multivariate hypergeometric draw."""
    rest = int(capacities.sum())
    if rest < LARGE:
        return rng.multivariate_hypergeometric(capacities, n, method="marginals")
    out = np.zeros_like(capacities)
    for t, c in enumerate(capacities.tolist()):
        out[t] = draw(rng, c, rest - c, n)
        n -= int(out[t])
        rest -= c
    return out


def matrix_row(sizes: np.ndarray, capacities: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Numbers of rows that partition p sends to each shard."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    lo, hi, cap = 0, len(sizes), capacities.astype(np.int64).copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        part = split(np.random.default_rng([seed, lo, hi]), cap, int(before[mid] - before[lo]))
        lo, hi, cap = (lo, mid, part) if p < mid else (mid, hi, cap - part)
    return cap


def shard(df: DataFrame, shards: int, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df's columns with shard (int) and slot (long, gapless from 0 within a shard): a uniform shuffle in which shard
    sizes differ by one row at most.

    Nulls, repeated rows, ties and very long texts need nothing special: a row's place depends on where it lies, not
    on what it holds. An empty table gives an empty result. Columns named shard or slot in df are replaced, all others
    stay, whatever their names. Equal texts are not kept together. The rows are checkpointed first, so that a retried
    task sees the same rows in the same partition.
    """
    df = df.drop("shard", "slot")
    block, key = unused(df, "_block"), unused(df, "_key")
    first = unused(df, "_first")
    spark = df.sparkSession
    scratch_root(spark)
    held = df.checkpoint()
    parts = held.rdd.getNumPartitions()
    sizes = np.zeros(parts, np.int64)
    for r in held.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect():
        sizes[r["p"]] = r["count"]
    n = int(sizes.sum())
    capacities = np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)
    blocks = np.maximum(1, -(-capacities // block_rows))
    sent = spark.sparkContext.broadcast((sizes, capacities, blocks))

    def deal(batches):
        sizes, capacities, blocks = sent.value
        p = TaskContext.get().partitionId()
        own = matrix_row(sizes, capacities, p, seed)
        rng = np.random.default_rng([seed, p, parts, 1])
        order = rng.permutation(np.repeat(np.arange(len(own), dtype=np.int32), own))
        at = 0
        for b in batches:
            n = b.num_rows
            to, keys = order[at : at + n], rng.integers(0, (1 << 63) - 1, n)
            # a key's upper 31 bits choose the block, so that blocks are ranges of keys
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to), pa.array(((keys >> 32) * blocks[to] >> 31).astype(np.int32)), pa.array(keys)], names=[*b.schema.names, "shard", block, key])
            at += n

    dealt = held.mapInArrow(deal, T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"shard int, {block} int, {key} bigint").fields]))
    counted = dealt.groupBy("shard", block).agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select("shard", block, F.coalesce(below, F.lit(0)).cast("long").alias(first))
    ranked = dealt.withColumn("slot", F.row_number().over(Window.partitionBy("shard", block).orderBy(key)).cast("long") - 1)
    out = ranked.join(maybe_broadcast(starts, int(blocks.sum()), 40), ["shard", block])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "shard", (F.col("slot") + F.col(first)).alias("slot"))
