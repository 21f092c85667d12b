"""Ordered work without one task that holds all rows.

Rows are sorted into ranges of the whole order, ties included, so that a key that many rows have is cut too; each
range is worked on by itself, and one total a range is summed over the ranges before it. The sorted rows are written
once, as ranges found by sampling must not move between two readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut

#: Rows of a range, about.
BLOCK = 1 << 17


def _ranges(df: DataFrame, order: list[str], block: int) -> DataFrame:
    """df with _p, its range, and _i, the row's place in it from 0."""
    parts = max(1, -(-df.count() // block))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    p = F.spark_partition_id()
    return cut(placed.withColumns({"_p": p, "_i": F.monotonically_increasing_id() - F.shiftleft(p.cast("long"), 33)}))


def _before(totals: DataFrame, columns: list[str]) -> DataFrame:
    """The sums of the ranges before each, one row a range."""
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("_p", *[F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long").alias(c) for c in columns]))


def sequence_ids(df: DataFrame, key: str, name: str = "seq", ties: list[str] | None = None, block: int = BLOCK, keys: list[str] | None = None) -> DataFrame:
    """df with gapless numbers from 0 in the order of key, then of the tie columns; by `keys` if given. Null keys come
    first."""
    keys = keys or []
    placed = _ranges(df, [*keys, key, *(ties or [])], block)
    numbered = placed.join(_before(placed.groupBy("_p").agg(F.count("*").alias("_n")), ["_n"]), "_p").withColumn(name, F.col("_i") + F.col("_n"))
    if keys:  # the first number of each group
        first = numbered.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(name).alias("_first"))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        numbered = numbered.join(first, same).withColumn(name, F.col(name) - F.col("_first"))
    return numbered.select(*df.columns, name)


def running_sums(df: DataFrame, key: str, sums: dict[str, Column], ties: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """df with running totals in the order of key: name -> whole-number expression."""
    names = {n: f"_s_{n}" for n in sums}
    placed = _ranges(df.withColumns({names[n]: c.cast("long") for n, c in sums.items()}), [key, *(ties or [])], block)
    offsets = _before(placed.groupBy("_p").agg(*[F.sum(s).alias(f"{s}_o") for s in names.values()]), [f"{s}_o" for s in names.values()])
    w = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({n: F.sum(s).over(w) for n, s in names.items()}).join(offsets, "_p")
    return out.select(*df.columns, *[(F.col(n) + F.col(f"{s}_o")).cast("long").alias(n) for n, s in names.items()])


def count_windows(df: DataFrame, key: str, size: int, aggregates: list[Column], ties: list[str] | None = None) -> DataFrame:
    """One row for each `size` rows in the order of key: window number and the aggregates."""
    return sequence_ids(df, key, "_seq", ties).groupBy(F.floor(F.col("_seq") / size).cast("long").alias("window")).agg(*aggregates)


def count_or_timeout_windows(df: DataFrame, keys: list[str], time: str, size: int, timeout_s: float, aggregates: list[Column], ties: list[str] | None = None) -> DataFrame:
    """Windows by key that end at `size` rows, or when the next row is more than timeout_s after the last one."""
    w = Window.partitionBy(*keys).orderBy(time, *(ties or []))
    gap = (F.unix_micros(F.col(time).cast("timestamp")) - F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(w)) > int(timeout_s * 1_000_000)
    spans = df.withColumn("_new", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("_span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "_span").orderBy(time, *(ties or []))
    return spans.withColumn("_part", F.floor((F.row_number().over(inner) - 1) / size)).groupBy(*keys, F.col("_span").cast("long").alias("span"), F.col("_part").cast("long").alias("part")).agg(*aggregates)


def tumbling_windows(df: DataFrame, time: str, width: str, aggregates: list[Column], keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(F.window(time, width).alias("_w"), *(keys or [])).agg(*aggregates).withColumn("window_start", F.col("_w.start")).drop("_w")


def zip_latest(left: DataFrame, right: DataFrame, keys: list[str], time: str, left_cols: list[str], right_cols: list[str], tie: str) -> DataFrame:
    """Every row of either side with the latest values of both sides up to it, once both sides have been seen."""
    a = left.select(*keys, time, tie, *left_cols, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right_cols])
    b = right.select(*keys, time, tie, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left_cols], *right_cols)
    w = Window.partitionBy(*keys).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).select(*keys, time, tie, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in [*left_cols, *right_cols]])
    return both.where(" and ".join(f"`{c}` is not null" for c in [left_cols[0], right_cols[0]]))
