"""Every operator of the engine as a query over the stand-in tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, preprocess, vectors
from ..operators import clustering, evaluate, nearest, ordered
from ..plans import novelty, training
from ..schema import Params
from ..scratch import cut, scratch_root
from ..sources import formats
from ..streaming import exact, parallel, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIM, HELD_OUT, K = 64, 7, 4
PARAMS = Params(k=K, min_examples=3, trigger=40, forget_after=200, radius_f=0.25)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), vectors.doubles(F.col("embedding")).alias("val"))


def centroids(p: DataFrame) -> DataFrame:
    """(id, label, center): the mean of each label's vectors, numbered by label."""
    means = p.groupBy("label").agg(F.array(*[F.avg(F.col("val")[i]) for i in range(DIM)]).alias("center"))
    return means.withColumn("id", (F.row_number().over(Window.orderBy(F.col("label").cast("long"))) - 1).cast("long")).select("id", "label", "center")


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


E = "e AS (SELECT vec_id AS id, label::VARCHAR AS label, embedding::DOUBLE[] AS v FROM embeddings)"
U = "u AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e)"
C = "c AS (SELECT row_number() OVER (ORDER BY label) - 1 AS cid, label AS clabel, list(x ORDER BY d) AS c FROM (SELECT label, d, avg(x) AS x FROM u GROUP BY label, d) GROUP BY label)"
ECU = f"{E}, {U}, {C}"
NEAR = "n AS (SELECT id, label, cid, clabel, list_distance(v, c) AS dist, row_number() OVER (PARTITION BY id ORDER BY list_distance(v, c), cid DESC) AS r FROM e, c)"

# ---- vectors


@query(f"WITH {E}, o AS (SELECT v AS w FROM e WHERE id = 0) SELECT id, round(list_distance(v, w), 6) AS euclidean, round(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) ** 2)), 6) AS squared, round(list_sum(list_transform(list_zip(v, w), lambda p: abs(p[1] - p[2]))), 6) AS taxicab, round(list_cosine_similarity(v, w), 6) AS cosine FROM e, o")
def distance_family(spark, sf_dir):
    p = points(spark, sf_dir)
    one = F.broadcast(p.where("id = 0").select(F.col("val").alias("w")))
    v, w = F.col("val"), F.col("w")
    return p.crossJoin(one).select("id", F.round(vectors.euclidean(v, w), 6).alias("euclidean"), F.round(vectors.squared_euclidean(v, w), 6).alias("squared"), F.round(vectors.taxicab(v, w), 6).alias("taxicab"), F.round(vectors.cosine(v, w), 6).alias("cosine"))


@query(f"WITH {E} SELECT id, round(list_inner_product(v, v), 6) AS squared_norm, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(list_max(v), 6) AS greatest, round(list_sum(v), 6) AS total, round(list_sum(v) * 2 / 4, 6) AS scaled, round(-list_sum(v), 6) AS negated, round(0 * list_sum(v), 6) + 0 AS zero FROM e")
def vector_algebra(spark, sf_dir):
    v = F.col("val")
    return points(spark, sf_dir).select("id", F.round(vectors.squared_norm(v), 6).alias("squared_norm"), F.round(vectors.from_origin(v), 6).alias("norm"), F.round(vectors.greatest(v), 6).alias("greatest"), F.round(vectors.total(v), 6).alias("total"), F.round(vectors.total(vectors.divide(vectors.scale(v, 2.0), 4.0)), 6).alias("scaled"), F.round(vectors.total(vectors.negate(v)), 6).alias("negated"), (F.round(vectors.total(vectors.add(v, vectors.negate(v))), 6) + 0.0).alias("zero"))


# ---- nearest clusters


@query(f"WITH {ECU}, {NEAR}, s AS (SELECT label AS sl, 3 * sqrt(var_pop(dist)) AS radius FROM n WHERE label = clabel GROUP BY label) SELECT id, cid AS cluster_id, round(dist, 6) AS dist, CASE WHEN dist <= radius + 0.5 THEN clabel ELSE '-' END AS label FROM n JOIN s ON sl = clabel WHERE r = 1")
def nearest_centroid(spark, sf_dir):
    p = points(spark, sf_dir)
    c = centroids(p)
    spread = p.join(F.broadcast(c.select("label", "center")), "label").withColumn("dist", vectors.euclidean(F.col("val"), F.col("center")))
    radius = spread.groupBy("label").agg((F.sqrt(F.var_pop("dist")) * 3 + 0.5).alias("radius"))
    model = nearest.collect_model(c.join(radius, "label"))
    return nearest.classify(p.drop("label"), model).select("id", "cluster_id", r6("dist"), "label")


@query(f"WITH {ECU}, {NEAR} SELECT id, max(CASE WHEN r = 1 THEN cid END) AS cluster_id, round(max(CASE WHEN r = 1 THEN dist END), 6) AS dist, max(CASE WHEN r = 2 THEN cid END) AS second_id, round(max(CASE WHEN r = 2 THEN dist END), 6) AS second_dist FROM n WHERE r <= 2 GROUP BY id")
def nearest_two(spark, sf_dir):
    p = points(spark, sf_dir)
    return nearest.nearest(p, nearest.collect_model(centroids(p)), second=True).select("id", "cluster_id", r6("dist"), "second_id", r6("second_dist"))


@query(f"WITH {ECU}, q AS (SELECT id, cid, list_sum(list_transform(list_zip(v, c), lambda p: abs(p[1] - p[2]))) AS d FROM e, c) SELECT id, cid AS cluster_id, round(d, 6) AS dist FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cid) = 1")
def nearest_taxicab(spark, sf_dir):
    p = points(spark, sf_dir)
    s = nearest.nearest_sql(F.col("val"), nearest.collect_model(centroids(p)), "taxicab", last=False)
    return p.select("id", s.alias("s")).select("id", F.col("s.cluster_id").alias("cluster_id"), F.round("s.dist", 6).alias("dist"))


@query(f"WITH {ECU} SELECT id, cid AS cluster_id, round(list_distance(v, c), 6) AS dist FROM e, c")
def cross_distance(spark, sf_dir):
    p = points(spark, sf_dir)
    return nearest.cross_distances(p.select("id", "val"), centroids(p)).select("id", "cluster_id", r6("dist"))


# ---- clustering


@query(f"WITH {ECU}, d AS (SELECT label, list_distance(v, c) AS dist FROM e JOIN c ON label = clabel) SELECT label, count(*) AS n_matches, round(avg(dist), 6) AS distance_avg, round(sqrt(sum((dist - m) ** 2)), 6) AS distance_stddev, round(max(dist), 6) AS distance_max, round(0.25 * sqrt(sum((dist - m) ** 2)), 6) AS radius FROM (SELECT *, avg(dist) OVER (PARTITION BY label) AS m FROM d) GROUP BY label")
def cluster_stats(spark, sf_dir):
    p = points(spark, sf_dir)
    d = p.join(F.broadcast(centroids(p).select("label", "center")), "label").select("label", vectors.euclidean(F.col("val"), F.col("center")).alias("dist"))
    return clustering.statistics(d, ["label"]).select("label", "n_matches", r6("distance_avg"), r6("distance_stddev"), r6("distance_max"), r6("radius"))


@query(f"WITH {E} SELECT label, id, (row_number() OVER (PARTITION BY label ORDER BY id) - 1)::INTEGER AS place FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= 4")
def kmeans_init(spark, sf_dir):
    return clustering.seeds_first(points(spark, sf_dir), K).select("label", "id", "place")


@query(f"WITH {E}, w AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY floor(sqrt(list_sum(list_transform(v, lambda x: x * x))) * 1e9), id) - 1 AS r, greatest(count(*) OVER (PARTITION BY label) // 4, 1) AS s FROM (SELECT id, label, v FROM e)) SELECT label, count(*) AS n, min(place)::INTEGER AS first_place, max(place)::INTEGER AS last_place FROM (SELECT label, r // s - 1 AS place FROM w WHERE r > 0 AND r % s = 0) WHERE place < 4 GROUP BY label")
def kmeans_init_spread(spark, sf_dir):
    return clustering.seeds_spread(points(spark, sf_dir), K).groupBy("label").agg(F.count("*").alias("n"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))


def _far(k: int) -> str:
    parts = [f"{E}", "s0 AS (SELECT id, v FROM e ORDER BY id LIMIT 1)"]
    for j in range(1, k):
        gap = "least(" + ", ".join(f"list_distance(e.v, s{i}.v)" for i in range(j)) + ")" if j > 1 else "list_distance(e.v, s0.v)"
        parts.append(f"s{j} AS (SELECT e.id, e.v FROM e, {', '.join(f's{i}' for i in range(j))} ORDER BY {gap} DESC, e.id LIMIT 1)")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {j}::BIGINT AS place, id FROM s{j}" for j in range(k))


@query(_far(K))
def kmeans_init_farthest(spark, sf_dir):
    seeds = clustering.seeds_farthest(points(spark, sf_dir), K)
    return spark.createDataFrame([(j, i) for j, (i, _) in enumerate(seeds)], "place bigint, id bigint")


@query()
def kmeans_init_drawn(spark, sf_dir):
    seeds = clustering.seeds_drawn(points(spark, sf_dir), K, seed=5)
    return spark.createDataFrame([(j, i) for j, (i, _) in enumerate(seeds)], "place bigint, id bigint")


def _lloyd(rounds: int) -> str:
    parts = [E, U, "c0 AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS k, v AS c FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= 4)"]
    for i in range(rounds):
        parts.append(f"a{i} AS (SELECT e.id, e.label, k, list_distance(v, c) AS dist FROM e JOIN c{i} ON e.label = c{i}.label QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY list_distance(v, c), k DESC) = 1)")
        seed = "UNION ALL SELECT label, k, d, x, 0 FROM (SELECT label, k, unnest(c) AS x, generate_subscripts(c, 1) AS d FROM c0)" if i == 0 else ""
        parts.append(f"m{i} AS (SELECT label, k, d, sum(x) / greatest(sum(w), 1) AS x, sum(w) AS n FROM (SELECT a{i}.label, k, d, x, 1 AS w FROM a{i} JOIN u USING (id) {seed}) GROUP BY label, k, d)")
        parts.append(f"c{i + 1} AS (SELECT o.label, o.k, CASE WHEN max(n) > 0 THEN list(x ORDER BY d) ELSE first(o.c) END AS c FROM c{i} o LEFT JOIN m{i} USING (label, k) GROUP BY o.label, o.k)")
    parts.append(f"f AS (SELECT e.label, k, list_distance(v, c) AS dist FROM e JOIN c{rounds} z ON e.label = z.label QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY list_distance(v, c), k DESC) = 1)")
    return f"WITH {', '.join(parts)} SELECT label, k::BIGINT AS place, count(*) AS n, round(sum(dist), 6) AS total, round(max(dist), 6) AS farthest FROM f GROUP BY label, k"


@query(_lloyd(3))
def kmeans_3iter_per_class(spark, sf_dir):
    p = points(spark, sf_dir)
    model = clustering.kmeans(p, clustering.seeds_first(p, K), Params(k=K, max_iterations=3, precision=-1.0))
    first = {g: model.labels.index(g) for g in set(model.labels)}
    base = F.create_map(*[x for g, k in first.items() for x in (F.lit(g), F.lit(k))])
    return clustering.assign(p, model).groupBy("label", (F.col("place") - base[F.col("label")]).cast("long").alias("place")).agg(F.count("*").alias("n"), F.round(F.sum("dist"), 6).alias("total"), F.round(F.max("dist"), 6).alias("farthest"))


@query()
def train_model(spark, sf_dir):
    return training.fit(points(spark, sf_dir), PARAMS, digits=6).drop("center")


@query()
def micro_cluster_model(spark, sf_dir):
    return clustering.clustream(points(spark, sf_dir), 12, PARAMS).select("id", "label")


@query(f"WITH {ECU}, d AS (SELECT cid, label, list_distance(v, c) AS dist FROM e JOIN c ON label = clabel), s AS (SELECT cid, sqrt(sum((dist - m) ** 2)) AS dev FROM (SELECT *, avg(dist) OVER (PARTITION BY cid) AS m FROM d) GROUP BY cid), g AS (SELECT a.cid, min(list_distance(a.c, b.c)) AS near FROM c a JOIN c b ON a.cid >= 7 AND b.cid < 7 GROUP BY a.cid) SELECT cid AS id, round((near - dev) / greatest(near, dev), 6) AS silhouette FROM g JOIN s USING (cid) WHERE near > dev")
def silhouette_filter(spark, sf_dir):
    p = points(spark, sf_dir)
    c = centroids(p)
    d = p.join(F.broadcast(c.select("label", "center")), "label").select("label", vectors.euclidean(F.col("val"), F.col("center")).alias("dist"))
    rows = c.join(clustering.statistics(d, ["label"]), "label")
    return training.cohesive_candidates(rows.where(F.col("id") >= HELD_OUT), rows.where(F.col("id") < HELD_OUT), 1).select("id", r6("silhouette"))


# ---- novelty detection


@query(f"WITH {ECU}, d AS (SELECT cid, list_distance(v, c) AS dist FROM e JOIN c ON label = clabel), s AS (SELECT cid, count(*) AS n, sqrt(sum((dist - m) ** 2)) AS dev FROM (SELECT *, avg(dist) OVER (PARTITION BY cid) AS m FROM d) GROUP BY cid), g AS (SELECT a.cid, b.clabel, b.cid AS bid, list_distance(a.c, b.c) AS dist, row_number() OVER (PARTITION BY a.cid ORDER BY list_distance(a.c, b.c), b.cid DESC) AS r FROM c a JOIN c b ON a.cid >= 7 AND b.cid < 7) SELECT g.cid AS id, bid AS nearest_id, round(dist, 6) AS dist, CASE WHEN dist <= 1.4 * s.dev THEN 'extension' ELSE 'novelty' END AS kind FROM g JOIN s ON s.cid = bid JOIN s n ON n.cid = g.cid WHERE r = 1 AND n.n >= 3")
def novelty_candidates(spark, sf_dir):
    p = points(spark, sf_dir)
    c = centroids(p)
    d = p.join(F.broadcast(c.select("label", "center")), "label").select("label", vectors.euclidean(F.col("val"), F.col("center")).alias("dist"))
    rows = c.join(clustering.statistics(d, ["label"]), "label").persist()
    model = nearest.collect_model(rows.where(F.col("id") < HELD_OUT))
    found = nearest.nearest(rows.where((F.col("id") >= HELD_OUT) & (F.col("n_matches") >= 3)).select("id", F.col("center").alias("val")), model)
    dev = F.broadcast(rows.select(F.col("id").alias("cluster_id"), "distance_stddev"))
    return found.join(dev, "cluster_id").select("id", F.col("cluster_id").alias("nearest_id"), r6("dist"), F.when(F.col("dist") <= F.col("distance_stddev") * 1.4, "extension").otherwise("novelty").alias("kind"))


@query(f"WITH {ECU}, {NEAR}, m AS (SELECT clabel AS l, max(dist) AS far FROM n WHERE label = clabel GROUP BY clabel) SELECT id, CASE WHEN dist <= 0.9 * far THEN 'consumed' WHEN id < 100 THEN 'garbage' ELSE 'kept' END AS fate FROM n JOIN m ON l = clabel WHERE r = 1 AND label::INTEGER >= 7")
def unknown_consume_gc(spark, sf_dir):
    p = points(spark, sf_dir)
    c = centroids(p)
    far = p.join(F.broadcast(c.select("label", "center")), "label").groupBy("label").agg(F.max(vectors.euclidean(F.col("val"), F.col("center"))).alias("far"))
    model = nearest.collect_model(c)
    placed = nearest.nearest(p.where(F.col("label").cast("int") >= HELD_OUT).drop("label"), model)
    return placed.join(F.broadcast(far.withColumnRenamed("label", "cluster_label")), "cluster_label").select("id", F.when(F.col("dist") <= 0.9 * F.col("far"), "consumed").when(F.col("id") < 100, "garbage").otherwise("kept").alias("fate"))


def _known(p: DataFrame) -> DataFrame:
    return p.where(F.col("label").cast("int") < HELD_OUT)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, class, lag): embeddings of every tenth class id held out, matched by id arithmetic alone, so that the
    evaluation queries have SQL: label of the example, unknown, or a novelty number."""
    return points(spark, sf_dir).select("id", F.when(F.col("id") % 7 == 0, "-").when(F.col("id") % 5 == 0, F.concat(F.lit("1"), F.col("label"))).otherwise(F.when(F.col("id") % 3 == 0, "0").otherwise(F.col("label"))).alias("label"), F.col("label").alias("class"))


MATCHES = "m AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN '-' WHEN vec_id % 5 = 0 THEN '1' || label WHEN vec_id % 3 = 0 THEN '0' ELSE label::VARCHAR END AS label, label::VARCHAR AS class FROM embeddings)"
INITIAL = [str(i) for i in range(10)]
ASSIGNED = "t AS (SELECT label, class, count(*) AS n FROM m GROUP BY label, class), a AS (SELECT label, CASE WHEN label = '-' THEN '-' WHEN length(label) = 1 THEN label ELSE first(class ORDER BY n DESC, class) END AS assigned FROM t GROUP BY label)"


@query()
def online_replay(spark, sf_dir):
    p = points(spark, sf_dir)
    model = training.fit(_known(p), PARAMS)
    return novelty.replay(p, model, PARAMS).select("kind", "id", "label", r6("dist"), "cluster_id")


@query()
def online_replay_by_key(spark, sf_dir):
    p = points(spark, sf_dir)
    model = training.fit(_known(p), PARAMS)
    return novelty.replay_by_key(p.withColumn("source", (F.col("id") % 3).cast("string")), model, PARAMS, "source").select("source", "kind", "id", "label", "cluster_id")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a stream: the files of its folder, or the one file of that name among the tables."""
    reader = spark.readStream.schema(read(spark, sf_dir, "embeddings").schema)
    raw = reader.parquet(f"{sf_dir}/embeddings.parquet") if _is_folder(spark, sf_dir) else reader.option("pathGlobFilter", "embeddings.parquet").parquet(sf_dir)
    return raw.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("val"))


def _is_folder(spark: SparkSession, sf_dir: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/embeddings.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def _checkpoint(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/streams/{uuid.uuid4().hex}"


def _together(spark: SparkSession, batches: list[DataFrame], schema: str) -> DataFrame:
    """The rows of all batches; a stream without rows has no batch."""
    return reduce(DataFrame.unionByName, batches) if batches else spark.createDataFrame([], schema)


@query()
def streaming_exact(spark, sf_dir):
    model = training.fit(_known(points(spark, sf_dir)), PARAMS)
    out = exact.detect(_stream(spark, sf_dir), model, PARAMS)
    path = f"{scratch_root(spark)}/tables/{uuid.uuid4().hex}"
    out.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", _checkpoint(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path).select("kind", "id", "label", r6("dist"), "cluster_id")


@query()
def streaming_parallel(spark, sf_dir):
    model = training.fit(_known(points(spark, sf_dir)), PARAMS)
    rows: list[DataFrame] = []
    detector = parallel.ParallelDetector(spark, model, PARAMS, lambda df, _: rows.append(cut(df.select("kind", "id", "label", r6("dist"), "cluster_id"))))
    parallel.start(_stream(spark, sf_dir), detector, _checkpoint(spark)).awaitTermination()
    return _together(spark, rows, "kind string, id bigint, label string, dist double, cluster_id bigint")


# ---- evaluation


@query(f"WITH {MATCHES} SELECT label, class, count(*) AS n FROM m GROUP BY label, class")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_matches(spark, sf_dir))


@query(f"WITH {MATCHES} SELECT label, {', '.join(f'''count(*) FILTER (class = '{c}') AS c{c}''' for c in range(10))} FROM m GROUP BY label")
def confusion_wide(spark, sf_dir):
    return evaluate.confusion_wide(_matches(spark, sf_dir), INITIAL).select("label", *[F.col(c).alias(f"c{c}") for c in INITIAL])


@query(f"WITH {MATCHES}, {ASSIGNED} SELECT label, assigned, coalesce(sum(n), 0)::BIGINT AS hits FROM a LEFT JOIN t ON t.label = a.label AND t.class = a.assigned GROUP BY a.label, assigned".replace("SELECT label, assigned, coalesce", "SELECT a.label, assigned, coalesce"))
def assigned_class(spark, sf_dir):
    return evaluate.assigned(evaluate.confusion(_matches(spark, sf_dir)), INITIAL)


@query(f"WITH {MATCHES}, {ASSIGNED}, s AS (SELECT count(*) FILTER (m.label <> '-' AND assigned = class) AS hits, count(*) FILTER (m.label <> '-' AND assigned <> class) AS misses, count(*) FILTER (m.label = '-') AS unknowns, count(*) AS n FROM m JOIN a USING (label)) SELECT hits, misses, unknowns, 3::BIGINT AS reprocessed, round(hits / (n + 3) * 100, 6) AS hits_pct, round(misses / (n + 3) * 100, 6) AS misses_pct, round(unknowns / (n + 3) * 100, 6) AS unknowns_pct, round(3 / unknowns * 100, 6) AS reprocessed_pct FROM s")
def eval_summary(spark, sf_dir):
    m = _matches(spark, sf_dir)
    n = m.count()
    names = evaluate.assigned(evaluate.confusion(m), INITIAL)
    return evaluate.summary(m, names, n + 3, n).select("hits", "misses", "unknowns", "reprocessed", *[r6(c) for c in ("hits_pct", "misses_pct", "unknowns_pct", "reprocessed_pct")])


@query(f"WITH {MATCHES}, k AS (SELECT id, (label <> '-' AND label = class)::BIGINT AS h, (label <> '-' AND label <> class)::BIGINT AS s, (label = '-')::BIGINT AS u FROM m) SELECT id, sum(h) OVER w::BIGINT AS hits, sum(s) OVER w::BIGINT AS misses, sum(u) OVER w::BIGINT AS unknowns, round(sum(h) OVER w / count(*) OVER w, 6) AS hits_rate, round(sum(s) OVER w / count(*) OVER w, 6) AS misses_rate, round(sum(u) OVER w / count(*) OVER w, 6) AS unknowns_rate FROM k WINDOW w AS (ORDER BY id)".replace("sum(h) OVER w::BIGINT", "(sum(h) OVER w)::BIGINT").replace("sum(s) OVER w::BIGINT", "(sum(s) OVER w)::BIGINT").replace("sum(u) OVER w::BIGINT", "(sum(u) OVER w)::BIGINT"))
def running_rates(spark, sf_dir):
    return evaluate.running_rates(_matches(spark, sf_dir), INITIAL).select("id", "hits", "misses", "unknowns", r6("hits_rate"), r6("misses_rate"), r6("unknowns_rate"))


@query(f"WITH {MATCHES} SELECT label, min(id) AS first_id FROM m GROUP BY label")
def label_onset(spark, sf_dir):
    return evaluate.onsets(_matches(spark, sf_dir))


@query("WITH x AS (SELECT vec_id AS id, label::VARCHAR AS class FROM embeddings), m AS (SELECT vec_id AS id, label::VARCHAR AS label FROM embeddings WHERE vec_id % 3 > 0) SELECT x.id, class, coalesce(label, 'N') AS label FROM x LEFT JOIN m ON x.id = m.id")
def outer_merge(spark, sf_dir):
    p = points(spark, sf_dir)
    return evaluate.merge(p.select("id", F.col("label").alias("class")), p.where("id % 3 > 0").select("id", "label"))


@query("WITH p AS (SELECT vec_id % 100 AS id, min(label::VARCHAR) AS label FROM embeddings GROUP BY 1) SELECT vec_id AS id, e.label::VARCHAR AS class, p.label FROM embeddings e JOIN p ON p.id = vec_id")
def merge_consume(spark, sf_dir):
    p = points(spark, sf_dir)
    return evaluate.merge_once(p.select((F.col("id") % 100).alias("id"), "label"), p.select("id", F.col("label").alias("class")))


@query("SELECT round(avg((label = vec_id % 10)::INTEGER), 6) AS hit_ratio FROM embeddings")
def hit_ratio(spark, sf_dir):
    return evaluate.hit_ratio(points(spark, sf_dir).select("label", (F.col("id") % 10).cast("string").alias("class"))).select(r6("hit_ratio"))


@query("SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def repeated_match_ids(spark, sf_dir):
    return evaluate.repeated_ids(read(spark, sf_dir, "events").select(F.col("user_id").alias("id")))


@query("SELECT round(min(lag), 6) AS min_lag, round(max(lag), 6) AS max_lag, round(avg(lag), 6) AS mean_lag FROM (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS lag FROM events)")
def lag_stats(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lags = read(spark, sf_dir, "events").select(((F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)) / 1e6).alias("lag"))
    return evaluate.lag_summary(lags).select(r6("min_lag"), r6("max_lag"), r6("mean_lag"))


@query("SELECT label::VARCHAR AS label, sum(vec_id % 11)::BIGINT AS matches, sum(vec_id % 3)::BIGINT AS misses, count(*) AS clusters FROM embeddings GROUP BY label")
def label_match_stats(spark, sf_dir):
    return evaluate.match_counts(points(spark, sf_dir).select("label", (F.col("id") % 11).alias("n_matches"), (F.col("id") % 3).alias("n_misses")))


@query("SELECT vec_id AS id, vec_id % 11 AS matches_a, CASE WHEN vec_id % 4 > 0 THEN vec_id % 13 END AS matches_b FROM embeddings WHERE vec_id % 4 = 0 OR vec_id % 11 <> vec_id % 13")
def model_diff(spark, sf_dir):
    p = points(spark, sf_dir)
    return evaluate.model_difference(p.select("id", (F.col("id") % 11).alias("n_matches")), p.where("id % 4 > 0").select("id", (F.col("id") % 13).alias("n_matches")))


@query("SELECT label::VARCHAR AS label, count(*) AS n FROM embeddings GROUP BY label")
def class_count(spark, sf_dir):
    return points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


# ---- preparation


@query("WITH x AS (SELECT min(least(l_quantity, 25)) AS a, greatest(max(least(l_quantity, 25)), 0) AS b, min(l_extendedprice) AS c, greatest(max(l_extendedprice), 0) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, round((least(l_quantity, 25) - a) / (b - a), 6) AS l_quantity, round((l_extendedprice - c) / (d - c), 6) AS l_extendedprice FROM lineitem, x")
def minmax_normalize(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return preprocess.min_max(df, ["l_quantity", "l_extendedprice"], {"l_quantity": 25.0}).select("l_orderkey", "l_linenumber", r6("l_quantity"), r6("l_extendedprice"))


@query("SELECT 'l_quantity' AS field, min(l_quantity) + 0.0 AS min, max(l_quantity) + 0.0 AS max FROM lineitem UNION ALL SELECT 'l_discount', min(l_discount) + 0.0, max(l_discount) + 0.0 FROM lineitem")
def field_extremes(spark, sf_dir):
    return preprocess.extremes(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"]).select("field", (F.col("min") + 0.0).alias("min"), (F.col("max") + 0.0).alias("max"))


@query("SELECT event_id, round(least(value, 65) / 65, 6) AS scaled FROM events")
def clamp_scale(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(preprocess.clamp_scale(F.col("value"), 65.0), 6).alias("scaled"))


def _hot() -> str:
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(f"(l_returnflag = '{v}')::INTEGER AS l_returnflag_{v}" for v in "ANR") + " FROM lineitem"


@query(_hot())
def one_hot(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return preprocess.one_hot(df, "l_returnflag").drop("l_returnflag")


@query("SELECT " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{str(q).replace('.', '_')}" for q in (0.1, 0.5, 0.9, 0.99, 0.999)) + ", count(value) AS n, round(avg(value), 6) AS mean, count(DISTINCT event_type) AS kinds FROM events")
def quantiles(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    qs = (0.1, 0.5, 0.9, 0.99, 0.999)
    return df.agg(F.percentile("value", F.array(*[F.lit(q) for q in qs])).alias("q"), F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.countDistinct("event_type").alias("kinds")).select(*[F.round(F.col("q")[i], 6).alias(f"q{str(q).replace('.', '_')}") for i, q in enumerate(qs)], "n", "mean", "kinds")


@query("SELECT event_id, round((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 219660, 6) AS scaled FROM events")
def time_of_day_scale(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(preprocess.time_of_day(F.date_format("ts", "HH:mm:ss")), 6).alias("scaled"))


@query("""SELECT event_id, round((event_id % 65536) / 65535, 6) AS last_part, 8 AS parts, round((event_id % 1000) / 65535, 6) AS port,
round(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 12 END / 12, 6) AS flag, round(CASE event_id % 2 WHEN 0 THEN 116 ELSE 117 END / 255, 6) AS protocol, CASE WHEN event_id % 4 = 0 THEN 'N' ELSE 'A' END AS class FROM events""")
def network_features(spark, sf_dir):
    i = F.col("event_id")
    ip = F.concat(F.lit("fe80:0:0:0:1:2:3:"), F.lower(F.hex(i % 65536)))
    flag = F.when(i % 3 == 0, "OTH").when(i % 3 == 1, "SF").otherwise("SHR")
    parts = preprocess.ipv6_parts(ip)
    return read(spark, sf_dir, "events").select("event_id", F.round(parts[7], 6).alias("last_part"), F.size(parts).alias("parts"), F.round(preprocess.port(i % 1000), 6).alias("port"), F.round(preprocess.flag_ordinal(flag), 6).alias("flag"), F.round(preprocess.protocol(F.when(i % 2 == 0, "tcp").otherwise("udp")), 6).alias("protocol"), preprocess.traffic_class(F.when(i % 4 == 0, "1").otherwise("-1")).alias("class"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN l_returnflag || '_A' ELSE l_returnflag || '_N' END AS class FROM lineitem WHERE (l_returnflag <> 'N' AND l_linestatus = 'F') OR l_linestatus = 'O'")
def known_filter(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "0").otherwise(F.col("l_returnflag")).alias("ids"), F.when(F.col("l_linestatus") == "F", "-1").otherwise("1").alias("label"), "l_returnflag")
    kept = df.where(preprocess.known_attack_or_normal(F.col("ids"), F.col("label")))
    return kept.select("l_orderkey", "l_linenumber", preprocess.combined_class(F.col("label"), F.col("l_returnflag")).alias("class"))


@query("SELECT event_id, array_to_string(list_transform(string_split('ab' || event_id || '123,xy' || event_type || '(9)', ','), lambda x: left(x, greatest(length(x) - 3, 0))), ',') AS codes FROM events")
def alert_codes(spark, sf_dir):
    text = F.concat(F.lit("ab"), F.col("event_id").cast("string"), F.lit("123,xy"), F.col("event_type"), F.lit("(9)"))
    return read(spark, sf_dir, "events").select("event_id", preprocess.alert_codes(text).alias("codes"))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE n >= 3")
def threshold_filter(spark, sf_dir):
    return preprocess.frequent_keys(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], 3).select("event_id", "user_id")


@query("SELECT event_type, least(n, 100)::BIGINT AS offline, (n - least(n, 100))::BIGINT AS online FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def stratified_split(spark, sf_dir):
    off, on = preprocess.stratified_split(read(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], 100, "event_id", seed=1)
    both = off.withColumn("o", F.lit(1)).unionByName(on.withColumn("o", F.lit(0)))
    return both.groupBy("event_type").agg(F.sum("o").alias("offline"), F.sum(1 - F.col("o")).alias("online"))


# ---- order, windows, joins in time


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS seq FROM lineitem")
def seq_id(spark, sf_dir):
    return ordered.sequence_ids(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "seq", ["l_linenumber"])


@query('SELECT r // 100 AS "window", count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events) GROUP BY r // 100')
def count_window_avg(spark, sf_dir):
    return ordered.count_windows(read(spark, sf_dir, "events"), "event_id", 100, [F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf_dir):
    return ordered.tumbling_windows(read(spark, sf_dir, "events"), "ts", "1 hour", [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")], ["event_type"])


@query("WITH g AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000)::BIGINT, 0) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS span FROM g), p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, span ORDER BY ts, event_id) - 1) // 5 AS part FROM s) SELECT user_id, span, part, count(*) AS n, min(event_id) AS first_id FROM p GROUP BY user_id, span, part".replace("sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT", "(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT"))
def count_or_timeout_window(spark, sf_dir):
    return ordered.count_or_timeout_windows(read(spark, sf_dir, "events"), ["user_id"], "ts", 5, 3600.0, [F.count("*").alias("n"), F.min("event_id").alias("first_id")], ["event_id"])


@query("WITH t AS (SELECT user_id, ts, event_id, event_type = (SELECT min(event_type) FROM events) AS a, value FROM events), z AS (SELECT user_id, event_id, last_value(CASE WHEN a THEN value END IGNORE NULLS) OVER w AS left_value, last_value(CASE WHEN NOT a THEN value END IGNORE NULLS) OVER w AS right_value FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, event_id, round(left_value, 6) AS left_value, round(right_value, 6) AS right_value FROM z WHERE left_value IS NOT NULL AND right_value IS NOT NULL")
def latest_zip(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("f"))
    tagged = e.crossJoin(F.broadcast(first))
    pick = lambda c, n: tagged.where(c).select("user_id", "ts", "event_id", F.col("value").alias(n))
    return ordered.zip_latest(pick("event_type = f", "left_value"), pick("event_type <> f", "right_value"), ["user_id"], "ts", ["left_value"], ["right_value"], "event_id").select("user_id", "event_id", r6("left_value"), r6("right_value"))


@query("WITH l AS (SELECT user_id AS id, max(event_id) AS latest_match_id FROM events GROUP BY user_id), c AS (SELECT max(event_id) AS now FROM events) SELECT id, latest_match_id, now - latest_match_id > 500 AS is_sleep FROM l, c")
def forget_sleep(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    model = e.groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("latest_match_id")).withColumn("is_sleep", F.lit(False))
    return training.forgotten(model, e.agg(F.max("event_id")).first()[0], 500).select("id", "latest_match_id", "is_sleep")


@query(f"WITH {ECU}, s AS (SELECT cid, c, cid % 2 = 0 AS sleeps FROM c), h AS (SELECT DISTINCT cid FROM e, s WHERE sleeps AND list_distance(v, c) <= 0.85) SELECT s.cid AS id, sleeps AND h.cid IS NULL AS is_sleep FROM s LEFT JOIN h ON s.cid = h.cid")
def wake_sleepers(spark, sf_dir):
    p = points(spark, sf_dir)
    model = centroids(p).withColumns({"radius": F.lit(0.85), "is_sleep": F.col("id") % 2 == 0})
    return training.promoted(model, p).select("id", "is_sleep")


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_count(spark, sf_dir):
    return windows.word_count(read(spark, sf_dir, "documents"), "text")


# ---- formats and labels


@query("SELECT vec_id AS id, label::VARCHAR AS label, vec_id % 9 AS n_matches, 64 AS dims, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 3) AS total FROM embeddings")
def model_lines(spark, sf_dir):
    p = points(spark, sf_dir)
    zero = F.lit(0.0)
    model = p.select("id", "label", (F.col("id") % 9).alias("n_matches"), zero.alias("distance_avg"), zero.alias("distance_stddev"), zero.alias("radius"), F.col("val").alias("center"))
    back = formats.cluster_lines(formats.format_clusters(model))
    return back.select("id", "label", "n_matches", F.size("center").alias("dims"), F.round(vectors.taxicab(F.col("center"), vectors.zeros(F.size("center"))), 3).alias("total"))


@query("SELECT vec_id AS id, 64 AS dims, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def json_points(spark, sf_dir):
    p = points(spark, sf_dir).select("id", F.lit(1587740835488).alias("time"), F.col("val").alias("value"))
    return formats.points_from_json(formats.points_to_json(p)).select("id", F.size("value").alias("dims"), F.round(vectors.total(F.col("value")), 6).alias("total"))


@query("SELECT vec_id AS id, (vec_id % 10)::VARCHAR AS class, 64 AS dims FROM embeddings")
def labelled_lines(spark, sf_dir):
    lines = points(spark, sf_dir).select(F.concat_ws(",", F.col("id").cast("string"), F.transform("val", lambda x: x.cast("string")), (F.col("id") % 10).cast("string")).alias("value"))
    return formats.labelled_lines(lines, with_id=True).select("id", "class", F.size("val").alias("dims"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'cluster' WHEN 1 THEN 'unknown' WHEN 2 THEN 'comment' WHEN 3 THEN 'blank' ELSE 'example' END AS kind FROM events) GROUP BY kind")
def tagged_lines(spark, sf_dir):
    i = F.col("event_id") % 5
    lines = read(spark, sf_dir, "events").select(F.when(i == 0, "Cluster: 1, N").when(i == 1, "Unknown: 4, 0.1").when(i == 2, "# note").when(i == 3, " ").otherwise("0.1,0.2,N").alias("value"))
    return formats.tagged(lines).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 128 BETWEEN 65 AND 90 OR event_id % 128 BETWEEN 97 AND 122 OR event_id % 128 = 45 THEN chr((event_id % 128)::INTEGER) ELSE (event_id % 128)::VARCHAR END AS label, (event_id % 128)::INTEGER AS code FROM events")
def label_codec(spark, sf_dir):
    code = (F.col("event_id") % 128).cast("int")
    return read(spark, sf_dir, "events").select("event_id", labels.text_of(code).alias("label")).withColumn("code", labels.code_of(F.col("label")))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '-' WHEN 1 THEN 'A' WHEN 2 THEN '7' ELSE 'x' END AS label FROM events")
def clean_labels(spark, sf_dir):
    i = F.col("event_id") % 4
    return read(spark, sf_dir, "events").select("event_id", labels.cleaned(F.when(i == 0, "Unk").when(i == 1, "C A").when(i == 2, "ExtNov 7").otherwise("N x")).alias("label"))


@query("SELECT event_id, ((event_id % 3) * 3600 + (event_id % 60) * 60 + (event_id % 50))::DOUBLE AS elapsed_s FROM events")
def log_times(spark, sf_dir):
    i = F.col("event_id")
    line = F.concat(F.lit("took "), (i % 3).cast("string"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((i % 50).cast("string"), 2, "0"), F.lit(" elapsed"))
    lines = read(spark, sf_dir, "events").select("event_id", line.alias("value"))
    return lines.join(formats.log_times(lines.select("value").distinct()), "value").select("event_id", F.round("elapsed_s", 2).alias("elapsed_s"))


@query("SELECT user_id, count(*) AS kinds, round(sum(v), 6) AS total FROM (SELECT user_id, event_type, min(value) AS v FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def label_vectors(spark, sf_dir):
    v = formats.label_vectors(read(spark, sf_dir, "events"), "user_id", "event_type", "value")
    return v.select("user_id", F.size("values").cast("long").alias("kinds"), F.round(vectors.total(F.map_values("values")), 6).alias("total"))


@query("SELECT label::VARCHAR AS label, count(*) AS n, min(id) AS first_id FROM (SELECT label, vec_id % 3 AS c, min(vec_id) AS id FROM embeddings WHERE vec_id % 5 > 0 GROUP BY label, vec_id % 3) GROUP BY label")
def distinct_clusters(spark, sf_dir):
    p = points(spark, sf_dir)
    model = p.select("id", "label", (F.col("id") % 5).alias("n_matches"), F.lit(1.0).alias("radius"), F.array((F.col("id") % 3).cast("double")).alias("center"))
    return clustering.distinct_clusters(model).groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("SELECT event_id % 4 AS source, count(*) AS n FROM events GROUP BY 1")
def interleave(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id")
    return formats.interleave(*[e.where(F.col("event_id") % 4 == k) for k in range(4)]).groupBy(F.col("source").cast("long").alias("source")).agg(F.count("*").alias("n"))


# ---- a stream of the size of the workload that the engine was made for


def lineitem_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as examples of eight features in [0, 1], with the return flag as class."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    f = [F.col("l_quantity") / 50, F.least(F.col("l_extendedprice"), F.lit(1e5)) / 1e5, F.col("l_discount") * 10, F.col("l_tax") * 12.5, F.col("l_linenumber") / 7, F.greatest(day, F.lit(0)) / 2600, (F.col("l_partkey") % 97) / 97, (F.col("l_suppkey") % 89) / 89]
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("label"), F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in f]).alias("val"))


LINE_PARAMS = Params(k=100, max_iterations=8, radius_f=7.0, stddev_mode="population")


@query()
def online_lineitem(spark, sf_dir):
    e = lineitem_examples(spark, sf_dir)
    model = training.fit(e.where("label <> 'R'"), LINE_PARAMS)
    return novelty.replay(e, model, LINE_PARAMS).where("kind = 'match'").groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
