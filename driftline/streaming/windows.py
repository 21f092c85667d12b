"""Stream forms of windows, sequence numbers, running centroids and model collection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tumbling(stream: DataFrame, time: str, width: str, delay: str, aggregates: list[Column], keys: list[str] | None = None) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *(keys or [])).agg(*aggregates)


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """Counts of lower-cased words, of a batch or a stream."""
    words = lines.select(F.explode(F.split(F.lower(F.col(column)), r"\W+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def count_or_timeout(stream: DataFrame, key: str, value: str, size: int, timeout_ms: int) -> DataFrame:
    """(key, n, total): a window of each key ends at `size` rows or `timeout_ms` of processing time after its last row."""
    out = T.StructType([stream.schema[key], T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])
    held = T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])

    def run(k, frames, state):
        rows = []
        if state.hasTimedOut:
            n, total = state.get
            state.remove()
            yield pd.DataFrame([(k[0], n, total)], columns=out.names)
            return
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            for v in f[value]:
                n, total = n + 1, total + float(v)
                if n >= size:
                    rows.append((k[0], n, total))
                    n, total = 0, 0.0
        if n:
            state.update((n, total))
            state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=out.names)

    return stream.select(key, value).groupBy(key).applyInPandasWithState(run, out, held, "append", "ProcessingTimeTimeout")


def numbered(stream: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, seq): rows of each key numbered on from 0, in the order of a column within a micro-batch."""
    out = T.StructType([stream.schema[key], stream.schema[order], T.StructField("seq", T.LongType())])

    def run(k, frames, state):
        n = state.get[0] if state.exists else 0
        parts = [f for f in frames if len(f)]
        pdf = pd.concat(parts).sort_values(order, kind="stable")[[key, order]] if parts else pd.DataFrame(columns=[key, order])
        pdf["seq"] = range(n, n + len(pdf))
        state.update((n + len(pdf),))
        yield pdf

    return stream.select(key, order).groupBy(key).applyInPandasWithState(run, out, T.StructType([T.StructField("n", T.LongType())]), "append", "NoTimeout")


def running_centroids(stream: DataFrame, key: str, val_col: str) -> DataFrame:
    """(key, n, center): the running mean of each key's vectors, a row a micro-batch."""
    out = T.StructType([stream.schema[key], T.StructField("n", T.LongType()), T.StructField("center", T.ArrayType(T.DoubleType()))])
    held = T.StructType([T.StructField("n", T.LongType()), T.StructField("sum", T.ArrayType(T.DoubleType()))])

    def run(k, frames, state):
        import numpy as np

        n, total = state.get if state.exists else (0, None)
        total = None if total is None else np.array(total)
        for f in frames:
            x = np.array(f[val_col].tolist(), float)
            if len(x):
                n, total = n + len(x), x.sum(axis=0) if total is None else total + x.sum(axis=0)
        state.update((n, total.tolist()))
        yield pd.DataFrame({key: [k[0]], "n": [n], "center": [(total / n).tolist()]})

    return stream.select(key, F.col(val_col).cast("array<double>").alias(val_col)).groupBy(key).applyInPandasWithState(run, out, held, "append", "NoTimeout")


def latest_pairs(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str) -> DataFrame:
    """Stream-stream join on a key, rows of both sides at most `within` apart; both sides need watermarks."""
    a, b = left.alias("a"), right.alias("b")
    gap = F.expr(f"a.{left_time} between b.{right_time} - interval {within} and b.{right_time} + interval {within}")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & gap)
