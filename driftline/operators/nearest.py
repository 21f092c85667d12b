"""Nearest-cluster joins.

The model is small by construction (k clusters a class), so its size is checked and it goes to every executor; points
never move. Squared distances come from one matrix product a batch, and every candidate within rounding of the least
is computed again exactly, so that ties and borders do not depend on the product's rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..schema import UNKNOWN

#: Numbers (clusters times dimensions) that a model may hold.
MAX_MODEL = 4_000_000
#: Points compared with all clusters at once.
STRETCH = 1 << 15


@dataclass
class Model:
    ids: np.ndarray
    labels: list
    centers: np.ndarray
    radius: np.ndarray
    stddev: np.ndarray
    groups: list | None = None

    def __len__(self) -> int:
        return len(self.ids)


#: Clusters that are sent to every executor for a product, at most.
MOST_SENT = 100_000


def sent(clusters: DataFrame) -> DataFrame:
    """clusters for a broadcast, after a check of their number."""
    n = clusters.count()
    if n > MOST_SENT:
        raise ValueError(f"{n} clusters are too many to send to every executor")
    return F.broadcast(clusters)


def collect_model(df: DataFrame, skip_sleep: bool = False, group_col: str | None = None) -> Model:
    """The clusters in order of id. Columns id and center; label, radius, distance_stddev, is_sleep where present."""
    if skip_sleep and "is_sleep" in df.columns:
        df = df.where(~F.coalesce(F.col("is_sleep"), F.lit(False)))
    n, dim = df.agg(F.count("*"), F.max(F.size("center"))).first()
    if n * max(1, dim or 1) > MAX_MODEL:
        raise ValueError(f"a model of {n} clusters of {dim} numbers is too large to send to every executor")
    rows = df.orderBy("id").collect()
    col = lambda name, other: [r[name] if name in df.columns else other for r in rows]
    return Model(np.array(col("id", 0), np.int64), col("label", None), np.array([r["center"] for r in rows], np.float64).reshape(len(rows), -1), np.array(col("radius", np.inf), np.float64), np.array(col("distance_stddev", 0.0), np.float64), col(group_col, None) if group_col else None)


def squared_distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Summed one dimension after the other, in the order of the dimensions."""
    out = np.zeros((len(points), len(centers)))
    for d in range(points.shape[1]):
        out += (points[:, d, None] - centers[None, :, d]) ** 2
    return out


def two_nearest(points: np.ndarray, centers: np.ndarray, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances), both (n, 2), nearest first; of equal ones the last (or first) cluster comes first.
    The second is -1 and inf if there is one cluster only."""
    n, k = len(points), len(centers)
    places, best = np.full((n, 2), -1), np.full((n, 2), np.inf)
    if n == 0 or k == 0:
        return places, best
    own, other = (points**2).sum(axis=1), (centers**2).sum(axis=1)
    rough = own[:, None] - 2 * points @ centers.T + other[None, :]
    second = np.partition(rough, min(1, k - 1), axis=1)[:, min(1, k - 1)]
    slack = 1e-9 * (own + other.max() + 1)
    row, col = np.nonzero(rough <= (second + slack)[:, None])
    exact = np.zeros(len(row))
    for d in range(points.shape[1]):
        exact += (points[row, d] - centers[col, d]) ** 2
    order = np.lexsort((-col if last else col, exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.searchsorted(row, np.arange(n))
    places[:, 0], best[:, 0] = col[first], exact[first]
    if k > 1:
        places[:, 1], best[:, 1] = col[first + 1], exact[first + 1]
    return places, best


def one_nearest(points: np.ndarray, centers: np.ndarray, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(place, squared distance) of the nearest centre only, as two_nearest() finds it."""
    if len(points) == 0 or len(centers) == 0:
        return np.full(len(points), -1), np.full(len(points), np.inf)
    if len(points) > STRETCH:  # the products of a stretch are held at once
        parts = [one_nearest(points[i : i + STRETCH], centers, last) for i in range(0, len(points), STRETCH)]
        return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    own, other = (points**2).sum(axis=1), (centers**2).sum(axis=1)
    rough = -2 * points @ centers.T
    rough += other
    place = rough.argmin(axis=1)
    least = rough[np.arange(len(points)), place]
    close = rough <= (least + 1e-9 * (own + other.max() + 1))[:, None]
    tied = np.flatnonzero(np.count_nonzero(close, axis=1) > 1)
    best = in_order(points, centers[place])
    if len(tied):
        row, col = np.nonzero(close[tied])
        exact = in_order(points[tied[row]], centers[col])
        order = np.lexsort((-col if last else col, exact, row))
        first = order[np.searchsorted(row[order], np.arange(len(tied)))]
        place[tied], best[tied] = col[first], exact[first]
    return place, best


#: Numbers of a product of points and centres that are held at once.
TILE = 1 << 19


class Growing:
    """The nearest of centres that more and more are added to, as one_nearest() finds it.

    Single precision and a bound of its error tell which centres may be the nearest; these are computed exactly. A tile
    of the product keeps only its least numbers, so memory does not grow with points times centres.
    """

    def __init__(self) -> None:
        self.n, self.most, self.rough = 0, 0.0, np.zeros((0, 0), np.float32)

    def follow(self, centers: np.ndarray) -> None:
        """Take the centres behind those known; the ones before are as they were."""
        k, dim = centers.shape
        if k <= self.n:
            return
        if k > len(self.rough):
            room = np.zeros((max(2 * len(self.rough), k, 64), dim + 1), np.float32)
            if self.n:
                room[: self.n] = self.rough[: self.n]
            self.rough = room
        new = centers[self.n :]
        other = (new**2).sum(axis=1)
        self.most = max(self.most, float(other.max())) if np.isfinite(other).all() else np.inf
        with np.errstate(over="ignore"):
            self.rough[self.n : k, :dim], self.rough[self.n : k, dim] = -2 * new, other
        self.n = k

    def nearest(self, points: np.ndarray, centers: np.ndarray, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place, squared distance) among centers, which follow() has been given; `without` has places, in order, that
        are left out."""
        n, k, dim = len(points), len(centers), centers.shape[1]
        without = without if without is not None else np.zeros(0, np.int64)
        own = (points**2).sum(axis=1)
        if not n or not self.most < 1e30 or not (own < 1e30).all():  # single precision ends at 3e38
            rest = np.delete(np.arange(k), without)
            near, best = one_nearest(points, centers[rest])
            return rest[near], best
        x = np.ones((n, dim + 1), np.float32)
        x[:, :dim] = points
        width = max(512, TILE // n)
        starts = range(0, k, width)
        tile, least = np.empty((n, min(width, k)), np.float32), np.empty((n, len(starts)), np.float32)

        def product(x: np.ndarray, out: np.ndarray, a: int) -> np.ndarray:
            b = min(a + width, k)
            out = out[: len(x), : b - a] if b - a == out.shape[1] else np.empty((len(x), b - a), np.float32)
            np.matmul(x, self.rough[a:b].T, out=out)
            off = without[np.searchsorted(without, a) : np.searchsorted(without, b)] - a
            if len(off):
                out[:, off] = np.inf
            return out

        for j, a in enumerate(starts):
            now = product(x, tile, a)
            now.min(axis=1, out=least[:, j])
        # a sum of dim + 1 rounded products of rounded numbers is off by (dim + 4) / 2**24 of the sum of their sizes at most
        slack = 2 * (dim + 8) / 2**24 * (own + 2 * self.most) + 1e-30
        limit = least.min(axis=1) + slack
        rows, cols = [], []
        for j, a in enumerate(starts):
            hit = np.flatnonzero(least[:, j] <= limit)
            if len(hit):
                now = tile[hit] if len(starts) == 1 else product(x[hit], tile, a)
                r, c = np.nonzero(now <= limit[hit, None])
                rows.append(hit[r])
                cols.append(c + a)
        row, col = np.concatenate(rows), np.concatenate(cols)
        exact = in_order(points[row], centers[col])
        order = np.lexsort((-col, exact, row))
        first = order[np.searchsorted(row[order], np.arange(n))]
        return col[first], exact[first]


def in_order(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances row by row, summed one dimension after the other."""
    gaps = np.ascontiguousarray((points - centers).T)
    gaps *= gaps
    out = np.zeros(gaps.shape[1])
    for g in gaps:
        out += g
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column as rows; null vectors and vectors of another length are an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if column.null_count or len(flat) != dim * len(column) or (np.diff(np.asarray(column.offsets)) != dim).any():
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), dim)


def nearest(points: DataFrame, model: Model, val_col: str = "val", second: bool = False, last: bool = True) -> DataFrame:
    """points with cluster_id, cluster_label, dist, and second_id, second_dist if asked for."""
    spark = points.sparkSession
    sent = spark.sparkContext.broadcast(model)
    where = points.columns.index(val_col)
    label = T.StringType()
    more = [("cluster_id", T.LongType()), ("cluster_label", label), ("dist", T.DoubleType())] + ([("second_id", T.LongType()), ("second_dist", T.DoubleType())] if second else [])
    schema = T.StructType([*points.schema.fields, *[T.StructField(n, t) for n, t in more]])

    def run(batches):
        m = sent.value
        labels = np.array([None if x is None else str(x) for x in m.labels] or [None], object)
        for b in batches:
            x = matrix(b.column(where), m.centers.shape[1])
            if second:
                places, squared = two_nearest(x, m.centers, last)
            else:
                places, squared = (v[:, None] for v in one_nearest(x, m.centers, last))
            ids = np.append(m.ids, -1)
            cols = [pa.array(ids[places[:, 0]]), pa.array(labels[places[:, 0]] if len(m) else [None] * b.num_rows, pa.string()), pa.array(np.sqrt(squared[:, 0]))]
            if second:
                cols += [pa.array(ids[places[:, 1]]), pa.array(np.sqrt(squared[:, 1]))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *[n for n, _ in more]])

    return points.mapInArrow(run, schema)


def classify(points: DataFrame, model: Model, val_col: str = "val", inside_only: bool = True, last: bool = True) -> DataFrame:
    """nearest() and `label`: the cluster's label if the point lies within its radius, border included, else unknown.
    Without inside_only the label is always the nearest cluster's."""
    out = nearest(points, model, val_col, last=last)
    if not inside_only:
        return out.withColumn("label", F.col("cluster_label"))
    radius = F.create_map(*[x for i, r in zip(model.ids.tolist(), model.radius.tolist(), strict=True) for x in (F.lit(i), F.lit(r))]) if len(model) else F.lit(None)
    return out.withColumn("label", F.when(F.col("dist") <= (radius[F.col("cluster_id")] if len(model) else radius), F.col("cluster_label")).otherwise(UNKNOWN))


def cross_distances(points: DataFrame, clusters: DataFrame, measure: str = "euclidean", val_col: str = "val") -> DataFrame:
    """(point columns, cluster_id, dist) for every pair: the full product with a checked, broadcast cluster table."""
    c = sent(clusters.select(F.col("id").alias("cluster_id"), F.col("center").alias("_c")))
    return points.crossJoin(c).withColumn("dist", vectors.DISTANCES[measure](F.col(val_col), F.col("_c"))).drop("_c")


def nearest_sql(val: Column, model: Model, measure: str = "euclidean", last: bool = True) -> Column:
    """struct(dist, cluster_id) of the nearest cluster as one expression without Python, for any of the measures."""
    f = vectors.DISTANCES[measure]
    entries = [F.struct(f(val, F.array(*[F.lit(float(x)) for x in c])).alias("dist"), F.lit(-k if last else k).alias("o"), F.lit(int(i)).cast("long").alias("cluster_id")) for k, (i, c) in enumerate(zip(model.ids, model.centers, strict=True))]
    return F.array_min(F.array(*entries))
