"""Parallel streaming: executors classify a micro-batch with the current model, the driver's machine takes what they
could not place.

The model a batch is classified with is as old as the batch before, which can only add unknowns. Matches never leave
the executors; the driver gets one count a cluster and all unknowns in order, a few at a time. State is
written under its batch number before a batch counts as done, so a repeated batch starts from the same state and
writes the same rows again.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nearest import Model, classify, collect_model
from ..plans.novelty import State, initial_state
from ..schema import OUTPUT, UNKNOWN, Params
from ..scratch import cut, scratch_root

#: Rows of the driver's machine that are written at once.
PART = 10_000


class ParallelDetector:
    """foreachBatch handler. sink(rows, batch_id) gets a DataFrame of schema.OUTPUT for each batch."""

    def __init__(self, spark: SparkSession, model: DataFrame, p: Params, sink: Callable[[DataFrame, int], None], id_col: str = "id", val_col: str = "val", state_path: str | None = None) -> None:
        self.spark, self.p, self.sink, self.id_col, self.val_col = spark, p, sink, id_col, val_col
        self.path = state_path or f"{scratch_root(spark)}/detector-{spark.sparkContext.applicationId}"
        self.state = initial_state(model, p)
        self.done = -1

    def _save(self, batch_id: int, before: State) -> None:
        blob = bytearray(pickle.dumps(before))
        self.spark.createDataFrame([(batch_id, blob)], "batch bigint, blob binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{batch_id}")

    def restore(self, batch_id: int) -> None:
        """Take up the state from before batch_id, as after a restart."""
        self.state = pickle.loads(bytes(self.spark.read.parquet(f"{self.path}/{batch_id}").first()["blob"]))
        self.done = batch_id - 1

    def _detect(self, missed: DataFrame, began: int) -> list[DataFrame]:
        """Take all unknowns in order of id, a round whenever the exact machine would run one, as of that id. Those that a
        cluster of an earlier round of this batch holds are reclassified instead of kept (identify_first). Rows beyond
        PART go to the shared folder, so the driver holds no more of them."""
        s, p = self.state, self.p
        end, latest, known = s.cur, s.latest.copy(), len(s)
        rows: list[tuple] = []
        part: list = []
        out: list[DataFrame] = []

        def take() -> None:
            s.cur = max(began, part[-1]["id"])
            ids, vals = np.array([r["id"] for r in part], np.int64), np.array([r["val"] for r in part], float)
            part.clear()
            if p.identify_first and len(s) > known:  # clusters that the executors did not have yet
                place, squared = s.nearest(vals, first=known)
                dist = np.sqrt(squared)
                inside = dist <= s.radius[place]
                np.add.at(s.n_matches, place[inside], 1)
                np.maximum.at(s.latest, place[inside], ids[inside])
                rows.extend(("reclassified", int(i), s.labels[c], float(d), int(c), None) for i, c, d in zip(ids[inside], place[inside], dist[inside], strict=True))
                ids, vals = ids[~inside], vals[~inside]
            s._keep_unknown(ids, vals)
            size = len(s.unknown_ids)
            if size >= p.buffer_size or (size >= p.trigger_size and s.cur - s.last_nd > p.trigger_size):
                rows.extend(s._round())

        for r in missed.toLocalIterator():
            part.append(r)
            if len(s.unknown_ids) + len(part) >= min(p.trigger_size, p.buffer_size):
                take()
            if len(rows) >= PART:
                out.append(cut(self.spark.createDataFrame(rows, OUTPUT)))
                rows.clear()
        if part:
            take()
        s.cur = end
        s.latest[: len(latest)] = np.maximum(s.latest[: len(latest)], latest)
        return [*out, self.spark.createDataFrame(rows, OUTPUT)] if rows else out

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.done:  # a repeated batch: back to where it began
            self.restore(batch_id)
        s, began = self.state, self.state.cur
        self._save(batch_id, s)
        if s.asleep.all():
            s.wake_all()
        awake = np.flatnonzero(~s.asleep)
        model = Model(awake, [s.labels[c] for c in awake], s.centers[awake], s.radius[awake], s.stddev[awake])
        points = batch.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.val_col).cast("array<double>").alias("val"))
        placed = classify(points, model).persist()
        counts = placed.groupBy("cluster_id").agg(F.count(F.when(F.col("label") != UNKNOWN, 1)).alias("hits"), F.count(F.when(F.col("label") == UNKNOWN, 1)).alias("misses"), F.max("id").alias("latest")).collect()
        for r in counts:
            c = r["cluster_id"]
            s.n_matches[c] += r["hits"]
            s.n_misses[c] += r["misses"]
            s.latest[c] = max(s.latest[c], r["latest"])
            s.cur = max(s.cur, r["latest"])
        s.fall_asleep()
        found = self._detect(placed.where(F.col("label") == UNKNOWN).orderBy("id").select("id", "val"), began)
        match = placed.select(F.lit("match").alias("kind"), "id", "label", "dist", "cluster_id", F.lit(None).cast("array<double>").alias("val"))
        unknown = placed.where(F.col("label") == UNKNOWN).select(F.lit("unknown").alias("kind"), "id", "label", "dist", "cluster_id", "val")
        out = match.unionByName(unknown)
        for more in found:
            out = out.unionByName(more)
        self.sink(out, batch_id)
        placed.unpersist()
        self.done = batch_id


class LateModel:
    """foreachBatch handler for a stream that begins before its model: until `need` clusters are known, batches are kept
    in the shared folder; then they are classified in their order, and so is every further batch at once.

    sink(rows, batch_id) gets the points with cluster_id, dist and label.
    """

    def __init__(self, spark: SparkSession, need: int, sink: Callable[[DataFrame, int], None]) -> None:
        self.spark, self.need, self.sink = spark, need, sink
        self.rows: DataFrame | None = None
        self.model: Model | None = None
        self.backlog: dict[int, DataFrame] = {}

    def add(self, clusters: DataFrame) -> None:
        """Take cluster rows (id, label, center, radius); rows of known ids are passed over."""
        if self.rows is None:
            self.rows = cut(clusters)
        else:
            self.rows = cut(self.rows.unionByName(clusters.join(self.rows.select("id"), "id", "left_anti")))
        if self.rows.count() >= self.need:
            self.model = collect_model(self.rows)
            waiting, self.backlog = self.backlog, {}
            for batch_id, batch in sorted(waiting.items()):
                self.sink(classify(batch, self.model), batch_id)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.model is None:
            self.backlog[batch_id] = cut(batch)  # a repeated batch replaces itself
        else:
            self.sink(classify(batch, self.model), batch_id)


def start(stream: DataFrame, detector: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    writer = stream.writeStream.foreachBatch(detector).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
