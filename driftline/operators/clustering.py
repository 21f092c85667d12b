"""k-means by class, its starts and its cluster statistics, and micro-cluster summaries of streams.

Points stay where they are: a pass sends the centres (few numbers, checked) to every executor, each partition adds up
its own points by cluster, and the sums are combined in Spark before the driver sees one row a cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..schema import CLUSTER, Params
from .nearest import Model, matrix, one_nearest, sent
from .ordered import sequence_ids

# ---- starts


def seeds_first(points: DataFrame, k: int, label: str = "label", id_col: str = "id") -> DataFrame:
    """The first k points of each class by id, with `place` from 0. Ranks above k are dropped before the shuffle."""
    w = Window.partitionBy(label).orderBy(id_col)
    return points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).withColumn("place", F.col("_r") - 1).drop("_r")


def seeds_spread(points: DataFrame, k: int, label: str = "label", id_col: str = "id", val_col: str = "val") -> DataFrame:
    """Every (n/k)-th point of a class in the order of distance from the origin, without the first."""
    far = points.withColumn("_d", vectors.norm(F.col(val_col))).withColumn("_key", F.floor(F.col("_d") * 1e9).cast("long"))
    ranked = sequence_ids(far, "_key", "_rank", ["_d", id_col], keys=[label])
    sizes = points.groupBy(label).agg(F.count("*").alias("_n"))
    step = F.greatest(F.floor(F.col("_n") / k), F.lit(1))
    return ranked.join(sizes, label).where((F.col("_rank") > 0) & (F.col("_rank") % step == 0)).withColumn("place", (F.col("_rank") / step - 1).cast("int")).where(F.col("place") < k).drop("_d", "_key", "_rank", "_n")


def seeds_farthest(points: DataFrame, k: int, id_col: str = "id", val_col: str = "val", measure: str = "euclidean") -> list[tuple[int, list[float]]]:
    """Farthest-first: the point of least id, then again and again the point farthest from its nearest seed (ties: least
    id). Each round is one pass with a grouped maximum; the seeds are k rows."""
    f = vectors.DISTANCES[measure]
    first = points.orderBy(id_col).select(id_col, val_col).first()
    seeds = [(first[0], list(first[1]))] if first else []
    while first and len(seeds) < k:
        nearest = F.least(*[f(F.col(val_col), F.array(*[F.lit(float(x)) for x in v])) for _, v in seeds], F.lit(float("inf")))
        r = points.select(F.struct(nearest.alias("d"), (-F.col(id_col)).alias("i"), F.col(val_col).alias("v")).alias("s")).agg(F.max("s").alias("s")).first()["s"]
        seeds.append((-r["i"], list(r["v"])))
    return seeds


def seeds_drawn(points: DataFrame, k: int, seed: int = 0, id_col: str = "id", val_col: str = "val") -> list[tuple[int, list[float]]]:
    """Greedy weighted start: each next seed has the greatest product of a number drawn by hash and the distance to the
    latest seed."""
    draw = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col(id_col)), F.lit(1 << 40)) + 1) / float(1 << 40)
    first = points.orderBy(draw(0).desc(), id_col).select(id_col, val_col).first()
    seeds = [(first[0], list(first[1]))] if first else []
    while first and len(seeds) < k:
        d = vectors.euclidean(F.col(val_col), F.array(*[F.lit(float(x)) for x in seeds[-1][1]]))
        r = points.select(F.struct((draw(len(seeds)) * d).alias("d"), (-F.col(id_col)).alias("i"), F.col(val_col).alias("v")).alias("s")).agg(F.max("s").alias("s")).first()["s"]
        seeds.append((-r["i"], list(r["v"])))
    return seeds


# ---- arrays: one class, or one detection round


def settled(rule: str, before: dict[str, float], now: dict[str, float], precision: float) -> bool:
    """Have Lloyd rounds settled? Of the summed distance, the summed farthest distances and the summed movement of the
    centres, before and now: by the change of the first ("distance"), its relative change ("relative"), the relative
    gain of the second ("farthest"), or the third as a share of the last one ("movement")."""
    if rule == "distance":
        return abs(before["total"] - now["total"]) <= precision
    if rule == "relative":
        return now["total"] == before["total"] or abs(now["total"] / before["total"] - 1) <= precision if before["total"] else True
    if rule == "farthest":
        return not now["far"] or before["far"] / now["far"] - 1 < precision
    if rule == "movement":
        return not before["moved"] or now["moved"] / before["moved"] < precision
    raise ValueError(f"no stop rule {rule}")


def _sums_by(own: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Summed rows of x by cluster, in the order of the rows; of few numbers all dimensions at once."""
    dim = x.shape[1]
    if x.size <= 1 << 16:
        return np.bincount((own[:, None] * dim + np.arange(dim)).ravel(), weights=x.ravel(), minlength=k * dim).reshape(k, dim)
    return np.stack([np.bincount(own, weights=x[:, d], minlength=k) for d in range(dim)], axis=1)


def kmeans_arrays(x: np.ndarray, seeds: np.ndarray, p: Params) -> np.ndarray:
    """Centres after Lloyd rounds from the seeds. A cluster without points keeps its centre. The first round's sums
    start with the seeds themselves under seed_bias. Rounds end when settled() says so."""
    centers = seeds.astype(np.float64).copy()
    before = {"total": float(x.shape[1] * len(seeds) * len(x) * 2), "far": np.inf, "moved": np.inf}
    for i in range(p.max_iterations):
        own, squared = one_nearest(x, centers)
        count = np.bincount(own, minlength=len(centers))
        sums = _sums_by(own, x, len(centers))
        if i == 0 and p.seed_bias:
            sums += centers
        full, old = count > 0, centers.copy()
        centers[full] = sums[full] / count[full, None]
        dist, far = np.sqrt(squared), np.zeros(len(centers))
        np.maximum.at(far, own, dist)
        now = {"total": float(dist.sum()), "far": float(far.sum()), "moved": float(np.sqrt(((centers - old) ** 2).sum(axis=1)).sum())}
        if settled(p.stop, before, now, p.precision):
            break
        before = now
    return centers


def cluster_arrays(x: np.ndarray, centers: np.ndarray, p: Params) -> dict[str, np.ndarray]:
    """n, avg, stddev, dmax and radius of each centre's points."""
    own, squared = one_nearest(x, centers)
    d = np.sqrt(squared)
    k = len(centers)
    n = np.bincount(own, minlength=k)
    avg = np.bincount(own, weights=d, minlength=k) / np.maximum(n, 1)
    dev = np.sqrt(np.bincount(own, weights=(d - avg[own]) ** 2, minlength=k) / (np.maximum(n, 1) if p.stddev_mode == "population" else 1))
    dmax = np.zeros(k)
    np.maximum.at(dmax, own, d)
    return {"n": n, "avg": avg, "stddev": dev, "dmax": dmax, "radius": p.radius_f * dev}


# ---- tables: all classes at once


def _own_cluster(x: np.ndarray, labels: list, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest cluster of each point's own class, and the distance."""
    place, dist = np.full(len(x), -1), np.zeros(len(x))
    names = np.array(labels, object)
    for label in dict.fromkeys(labels):
        rows = np.flatnonzero(names == label)
        members = np.array([k for k, g in enumerate(model.labels) if g == label], int)
        if len(members):
            near, squared = one_nearest(x[rows], model.centers[members])
            place[rows], dist[rows] = members[near], np.sqrt(squared)
    return place, dist


def _sums(points: DataFrame, model: Model, label: str, val_col: str) -> dict[int, tuple[int, float, np.ndarray]]:
    """cluster place -> (points, summed distance, greatest distance, summed vectors)."""
    dim = model.centers.shape[1]
    sent = points.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        n, d, far, ls = np.zeros(len(m), np.int64), np.zeros(len(m)), np.zeros(len(m)), np.zeros((len(m), dim))
        for b in batches:
            x = matrix(b.column(1), dim)
            place, dist = _own_cluster(x, b.column(0).to_pylist(), m)
            ok = place >= 0
            n += np.bincount(place[ok], minlength=len(m))
            d += np.bincount(place[ok], weights=dist[ok], minlength=len(m))
            np.maximum.at(far, place[ok], dist[ok])
            np.add.at(ls, place[ok], x[ok])
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full]), pa.array(d[full]), pa.array(far[full]), pa.array(ls[full].tolist(), pa.list_(pa.float64()))], names=["c", "n", "d", "far", "ls"])

    parts = points.select(label, val_col).mapInArrow(run, "c bigint, n bigint, d double, far double, ls array<double>")
    rows = parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.max("far").alias("far"), *[F.sum(F.col("ls")[i]).alias(f"v{i}") for i in range(dim)]).collect()
    sent.unpersist()
    return {r["c"]: (r["n"], r["d"], r["far"], np.array([r[f"v{i}"] for i in range(dim)])) for r in rows}


def kmeans(points: DataFrame, seeds: DataFrame, p: Params, label: str = "label", val_col: str = "val", callback: Callable[[int, Model], None] | None = None) -> Model:
    """Lloyd rounds for all classes together. seeds: (label, place, val). A class whose summed distance has settled is
    left as it is."""
    rows = sorted(seeds.select(label, "place", val_col).collect(), key=lambda r: (str(r[0]), r[1]))
    centers = np.array([r[2] for r in rows], np.float64)
    model = Model(np.arange(len(rows)), [r[0] for r in rows], centers, np.zeros(len(rows)), np.zeros(len(rows)))
    names = list(dict.fromkeys(model.labels))
    before: dict = {}
    open_ = set(names)
    for i in range(p.max_iterations):
        found = _sums(points, model, label, val_col)
        for name in list(open_):
            own = [k for k, g in enumerate(model.labels) if g == name]
            old = model.centers[own].copy()
            for k in own:
                if k in found:
                    n, _, _, ls = found[k]
                    model.centers[k] = (ls + model.centers[k]) / n if i == 0 and p.seed_bias else ls / n
            met = [found[k] for k in own if k in found]
            now = {"total": sum(m[1] for m in met), "far": sum(m[2] for m in met), "moved": float(np.sqrt(((model.centers[own] - old) ** 2).sum(axis=1)).sum())}
            first = {"total": float(centers.shape[1] * len(own) * sum(m[0] for m in met) * 2), "far": np.inf, "moved": np.inf}
            if settled(p.stop, before.get(name, first), now, p.precision):
                open_.discard(name)
            before[name] = now
        if callback:
            callback(i, model)
        if not open_:
            break
    return model


def assign(points: DataFrame, model: Model, label: str = "label", val_col: str = "val") -> DataFrame:
    """points with place and dist: the nearest cluster of the point's own class."""
    dim = model.centers.shape[1]
    sent = points.sparkSession.sparkContext.broadcast(model)
    at_label, at_val = points.columns.index(label), points.columns.index(val_col)

    def run(batches):
        for b in batches:
            place, dist = _own_cluster(matrix(b.column(at_val), dim), b.column(at_label).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(dist)], names=[*b.schema.names, "place", "dist"])

    from pyspark.sql import types as T

    return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("place", T.LongType()), T.StructField("dist", T.DoubleType())]))


def statistics(assigned: DataFrame, keys: list[str], radius_f: float = 0.25, stddev_mode: str = "sum", dist: str = "dist") -> DataFrame:
    """Points, mean, deviation (of the sum of squares, not divided, by default), maximum and radius by key, in one pass."""
    dev = F.sqrt(F.var_pop(dist) * F.count("*")) if stddev_mode == "sum" else F.stddev_pop(dist)
    return assigned.groupBy(*keys).agg(F.count("*").alias("n_matches"), F.avg(dist).alias("distance_avg"), dev.alias("distance_stddev"), F.max(dist).alias("distance_max")).withColumn("radius", F.col("distance_stddev") * radius_f)


def fill_empty(assigned: DataFrame, places: DataFrame) -> DataFrame:
    """(place, id) for each place without points: the point that lies nearest to it among all, as a filler. `places` is
    (place, center), few rows: more than MOST_SENT empty ones are an error."""
    empty = places.join(assigned.select("place").distinct(), "place", "left_anti")
    crossed = assigned.select("id", "val").crossJoin(sent(empty))
    return crossed.groupBy("place").agg(F.min(F.struct(vectors.euclidean(F.col("val"), F.col("center")), F.col("id").alias("id"))).alias("m")).select("place", F.col("m.id").alias("id"))


#: Bytes of one class's vectors up to which one task trains it.
CLASS_BYTES = 64 << 20


def _train_in_tasks(examples: DataFrame, p: Params, dim: int, label: str, val_col: str, id_col: str) -> list[tuple]:
    """(label, place, n, avg, stddev, dmax, radius, center) rows, each class trained whole by one task."""

    def run(table: pa.Table) -> pa.Table:
        x = matrix(table.sort_by("_id").column("_val").combine_chunks(), dim)
        centers = kmeans_arrays(x, x[: p.k], p)
        found = cluster_arrays(x, centers, p)
        k = len(centers)
        cols = [pa.array(table.column("_label")[0].as_py() for _ in range(k)).cast(pa.string()), pa.array(np.arange(k)), pa.array(found["n"]), *(pa.array(found[c]) for c in ("avg", "stddev", "dmax", "radius")), pa.array(centers.tolist(), pa.list_(pa.float64()))]
        return pa.Table.from_arrays(cols, names=["label", "place", "n", "avg", "stddev", "dmax", "radius", "center"])

    picked = examples.select(F.col(label).cast("string").alias("_label"), F.col(id_col).alias("_id"), F.col(val_col).alias("_val"))
    rows = picked.groupBy("_label").applyInArrow(run, "label string, place bigint, n bigint, avg double, stddev double, dmax double, radius double, center array<double>").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (str(r[0]), r[1]))


def train(examples: DataFrame, p: Params, label: str = "label", val_col: str = "val", id_col: str = "id") -> DataFrame:
    """A model of k clusters a class, numbered class after class. Every class needs k examples at least.

    Where the vectors of each class are counted and found to be CLASS_BYTES at most, a class is one task's work from
    start to end; otherwise a round is a pass over all classes. Both do the same sums, in another order.
    """
    sizes = {r[0]: r["count"] for r in examples.groupBy(label).count().collect()}
    if short := sorted(str(k) for k, n in sizes.items() if n < p.k):
        raise ValueError(f"classes with fewer than {p.k} examples: {', '.join(short)}")
    if not sizes:
        return examples.sparkSession.createDataFrame([], CLUSTER)
    dim = len(examples.select(val_col).first()[0])
    if max(sizes.values()) * dim * 8 <= CLASS_BYTES:
        found = _train_in_tasks(examples, p, dim, label, val_col, id_col)
        rows = [(i, name, n, 0, 0, None, False, avg, dev, far, radius, center) for i, (name, _, n, avg, dev, far, radius, center) in enumerate(found)]
        return examples.sparkSession.createDataFrame(rows, CLUSTER)
    model = kmeans(examples, seeds_first(examples, p.k, label, id_col), p, label, val_col)
    stats = {r["place"]: r for r in statistics(assign(examples.select(label, val_col), model, label, val_col), ["place"], p.radius_f, p.stddev_mode).collect()}
    rows = []
    for k, name in enumerate(model.labels):
        s = stats.get(k)
        rows.append((k, name, s["n_matches"] if s else 0, 0, 0, None, False, s["distance_avg"] if s else 0.0, s["distance_stddev"] if s else 0.0, s["distance_max"] if s else 0.0, s["radius"] if s else 0.0, model.centers[k].tolist()))
    return examples.sparkSession.createDataFrame(rows, CLUSTER)


def best_of(points: DataFrame, starts: list[DataFrame], p: Params, label: str = "label", val_col: str = "val") -> Model:
    """The k-means result of least summed squared distance among several starts."""
    best: tuple[float, Model] | None = None
    for seeds in starts:
        model = kmeans(points, seeds, p, label, val_col)
        cost = assign(points.select(label, val_col), model, label, val_col).agg(F.sum(F.col("dist") * F.col("dist"))).first()[0] or 0.0
        if best is None or cost < best[0]:
            best = (cost, model)
    return best[1]


# ---- micro-clusters


class MicroClusters:
    """At most q summaries (n, linear and square sums, time sums) of a stream of vectors. A vector joins the nearest
    summary if it lies within `factor` root-mean-square deviations of it; else it starts a summary, and room is made by
    dropping a summary not used for `horizon` steps, or by merging the two nearest ones."""

    def __init__(self, q: int, dim: int, factor: float = 2.0, horizon: int = 10_000) -> None:
        self.q, self.factor, self.horizon = q, factor, horizon
        self.n, self.lt = np.zeros(0), np.zeros(0)
        self.ls, self.ss = np.zeros((0, dim)), np.zeros((0, dim))
        self.last = np.zeros(0)

    def centers(self) -> np.ndarray:
        return self.ls / self.n[:, None]

    def add(self, x: np.ndarray, now: float) -> None:
        if len(self.n):
            c = self.centers()
            d = np.sqrt(((c - x) ** 2).sum(axis=1))
            j = int(d.argmin())
            if self.n[j] > 1:
                reach = self.factor * np.sqrt(np.maximum(self.ss[j] / self.n[j] - c[j] ** 2, 0).sum())
            else:
                others = np.delete(np.sqrt(((c - c[j]) ** 2).sum(axis=1)), j)
                reach = others.min() if len(others) else 0.0
            if d[j] <= reach:
                self.n[j] += 1
                self.ls[j] += x
                self.ss[j] += x * x
                self.lt[j] += now
                self.last[j] = now
                return
        if len(self.n) >= self.q:
            old = int(self.last.argmin())
            if now - self.last[old] > self.horizon:
                self._drop(old)
            else:
                c = self.centers()
                gaps = ((c[:, None] - c[None]) ** 2).sum(axis=2)
                np.fill_diagonal(gaps, np.inf)
                a, b = divmod(int(gaps.argmin()), len(c))
                for v in (self.n, self.ls, self.ss, self.lt):
                    v[a] += v[b]
                self.last[a] = max(self.last[a], self.last[b])
                self._drop(b)
        self.n, self.lt, self.last = np.append(self.n, 1.0), np.append(self.lt, now), np.append(self.last, now)
        self.ls, self.ss = np.vstack([self.ls, x]), np.vstack([self.ss, x * x])

    def _drop(self, j: int) -> None:
        self.n, self.lt, self.last = (np.delete(v, j) for v in (self.n, self.lt, self.last))
        self.ls, self.ss = np.delete(self.ls, j, axis=0), np.delete(self.ss, j, axis=0)


def micro_clusters(points: DataFrame, q: int, label: str = "label", val_col: str = "val", factor: float = 2.0, horizon: int = 10_000) -> DataFrame:
    """(label, n, ls, ss): up to q summaries of each class from each partition. Summaries add up, so parts of one class
    are summarised where they lie."""
    from pyspark.sql import types as T

    def run(batches):
        held: dict = {}
        now = 0
        for b in batches:
            for name, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array(v, np.float64)
                held.setdefault(name, MicroClusters(q, len(x), factor, horizon)).add(x, now)
                now += 1
        names = [k for k, m in held.items() for _ in range(len(m.n))]
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([m.n for m in held.values()]).astype(np.int64)), *(pa.array([r.tolist() for m in held.values() for r in getattr(m, c)], pa.list_(pa.float64())) for c in ("ls", "ss"))], names=[label, "n", "ls", "ss"])

    schema = T.StructType([points.schema[label], *T.StructType.fromDDL("n bigint, ls array<double>, ss array<double>").fields])
    return points.select(label, val_col).mapInArrow(run, schema)


def clustream(points: DataFrame, q: int, p: Params, label: str = "label", val_col: str = "val") -> DataFrame:
    """Micro-clusters of each class, then k macro clusters over their centres: (id, label, center). The driver holds q
    summaries a class and partition."""
    by: dict = {}
    for r in micro_clusters(points, q, label, val_col).collect():
        by.setdefault(r[0], []).append(np.array(r["ls"]) / r["n"])
    rows = []
    for name in sorted(by, key=str):
        x = np.array(sorted(map(tuple, by[name])))
        for c in kmeans_arrays(x, x[: min(p.k, len(x))], p):
            rows.append((len(rows), str(name), c.tolist()))
    return points.sparkSession.createDataFrame(rows, "id bigint, label string, center array<double>")


def distinct_clusters(model: DataFrame, digits: int = 9) -> DataFrame:
    """One cluster for each label and centre (rounded), the one of least id; clusters without points are dropped."""
    key = F.transform("center", lambda x: F.round(x, digits))
    first = model.where((F.col("n_matches") > 0) & (F.col("radius") > 0)).groupBy("label", key.alias("_c")).agg(F.min("id").alias("id"))
    return model.join(first.select("id"), "id", "left_semi")
