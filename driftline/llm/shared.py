"""Shared-folder scratch tables, row keys and size-checked joins used by the operators."""

from __future__ import annotations

import gc
import json
import re
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_root

#: A side is broadcast only when it has been counted and holds no more than this many bytes.
BROADCAST_BYTES = 48 << 20


#: Rows, and bytes, of text that go to a Python worker at once.
TEXT_ROWS, TEXT_BYTES = 1000, 8 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """df, after bounding its session's Arrow batches to TEXT_ROWS rows and TEXT_BYTES bytes (and one row more).

    Spark reads these limits when a plan runs, so they stay set; narrower ones are kept.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)):
        if not 0 < int(re.sub(r"\D", "", conf.get(key))) <= most:
            conf.set(key, str(most))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared folder and return the re-read table.

    It cuts the lineage: a lost executor costs the reader one file split, not the work before it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


#: Tables that cut() has written, for release().
_paths: dict[int, tuple[weakref.ref, str]] = {}


def delete(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing will read again."""
    for t in tables:
        ref, path = _paths.pop(id(t), (None, None))
        if ref is not None and ref() is t:
            jvm = t.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """delete(), and let Spark drop the shuffles behind the tables: its cleaner acts when the JVM has collected their
    handles, which an idle driver does late."""
    delete(*tables)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if rows * row_bytes is within BROADCAST_BYTES, else df for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: From so many rows on a key is joined by broadcast, so that they stay where they are.
HOT_ROWS = 5000


def matching(rows: DataFrame, counted: DataFrame, keys: list[str], row_bytes: int = 48, bring: tuple[str, ...] = ()) -> DataFrame:
    """The rows whose keys are in counted (keys, each once, and n, their number of rows; a stable table), with the
    columns to bring from there.

    counted is broadcast whole if its counted size is small. Otherwise only the keys of HOT_ROWS rows or more are, at
    most one for so many rows, and the others are shuffled: no task gets all rows of a hot key.
    """
    how = "inner" if bring else "left_semi"
    total = counted.count()
    if total * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(counted.select(*keys, *bring)), keys, how)
    hot = counted.where(F.col("n") >= HOT_ROWS).select(*keys, *bring)
    hot = maybe_broadcast(hot, hot.count(), row_bytes)
    rest = counted.where(F.col("n") < HOT_ROWS).select(*keys, *bring)
    return rows.join(hot, keys, how).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, from `name` by underscores before it."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def id_crc(col: str) -> Column:
    """crc32 of an id written as text, the number that assigns held-out folds. A null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(0))


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def local_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small driver-side list as a DataFrame, through a JSON literal, so no Python runs on executors."""
    names = [part.split()[0] for part in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = "array<struct<" + ",".join(":".join(part.split()) for part in schema.split(",")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def keep_rows(docs: DataFrame, keys: dict[str, Column], decisions: DataFrame) -> DataFrame:
    """The rows of docs that decisions keep, with docs' columns.

    keys: name -> expression over docs; decisions: the same names and a boolean `kept`, one row for each row of docs.
    Of rows that agree on all keys one stays if any of them is kept. Only keys that go are joined, and broadcast only
    when their counted size is small.
    """
    names = list(keys)
    own = {n: unused(docs, n) for n in names}
    by_key = cut(decisions.groupBy(*names).agg(F.max("kept").alias("_any"), F.count("*").alias("_n")).where("not _any or _n > 1"))
    sizes = {r["_any"]: r["count"] for r in by_key.groupBy("_any").count().collect()}
    out = docs.withColumns({own[n]: e for n, e in keys.items()})

    def match(side: DataFrame) -> Column:
        cond = F.lit(True)
        for n in names:
            cond = cond & out[own[n]].eqNullSafe(side[n])
        return cond

    again = {n: unused(docs, f"{n}_r") for n in names}
    repeated = by_key.where("_any").select(*[F.col(n).alias(again[n]) for n in names])
    if sizes.get(False):
        gone = by_key.where("not _any").select(*names)
        out = out.join(maybe_broadcast(gone, sizes[False], 64), match(gone), "left_anti")
    if sizes.get(True):
        same = F.lit(True)
        for n in names:
            same = same & F.col(own[n]).eqNullSafe(F.col(again[n]))
        many = maybe_broadcast(repeated, sizes[True], 64)
        out = out.join(many, same, "left_anti").unionByName(out.join(many, same, "left_semi").dropDuplicates(list(own.values())))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
