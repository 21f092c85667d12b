"""Queries over a model's life: training, rounds of detection, sinks, files, late models."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, preprocess, vectors
from ..operators import clustering, evaluate, nearest, ordered
from ..plans import novelty, training
from ..schema import Params
from ..scratch import cut, scratch_root
from ..sources import formats
from ..streaming import parallel
from .catalog import ECU, HELD_OUT, K, MATCHES, NEAR, SQL, _checkpoint, _lloyd, _matches, _stream, _together, centroids, points, query, r6, read

NOVELTY_F, GROUPS = 1.4, 4
INSIDE = 0.85


def _with_statistics(p: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """c (key, center, ...) with the statistics of its own points."""
    spread = p.join(F.broadcast(c.select(key, "center")), key).withColumn("dist", vectors.euclidean(F.col("val"), F.col("center")))
    return c.join(clustering.statistics(spread, [key]), key)


def _classified(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(points with cluster_id, dist and label; the model)."""
    p = points(spark, sf_dir)
    c = centroids(p).withColumns({"radius": F.lit(INSIDE), "n_matches": F.col("id") * 3, "distance_avg": F.lit(0.5), "distance_stddev": F.lit(0.25)})
    return nearest.classify(p.drop("label"), nearest.collect_model(c)), c


# ---- training


def _trained(rounds: int) -> str:
    lloyd = _lloyd(rounds).rsplit(" SELECT label, k::BIGINT", 1)[0]
    stats = "g AS (SELECT label, k, dist, avg(dist) OVER (PARTITION BY label, k) AS m FROM f), t AS (SELECT label, k, count(*) AS n, avg(dist) AS a, sqrt(sum((dist - m) ** 2)) AS s, max(dist) AS x FROM g GROUP BY label, k)"
    return f"{lloyd}, {stats} SELECT row_number() OVER (ORDER BY z.label, z.k) - 1 AS id, z.label, coalesce(n, 0)::BIGINT AS n_matches, round(coalesce(a, 0), 6) AS distance_avg, round(coalesce(s, 0), 6) AS distance_stddev, round(coalesce(x, 0), 6) AS distance_max, round(coalesce(s, 0) * 0.25, 6) AS radius FROM c{rounds} z LEFT JOIN t USING (label, k)"


@query(_trained(5))
def train_model_5iter(spark, sf_dir):
    model = training.fit(points(spark, sf_dir), Params(k=K, max_iterations=5, precision=-1.0))
    return model.select("id", "label", "n_matches", r6("distance_avg"), r6("distance_stddev"), r6("distance_max"), r6("radius"))


@query(f"WITH {ECU} SELECT cid AS place, id FROM e, c WHERE label::INT < {HELD_OUT} AND cid >= {HELD_OUT} QUALIFY row_number() OVER (PARTITION BY cid ORDER BY list_distance(v, c), id) = 1")
def fill_empty_places(spark, sf_dir):
    p = points(spark, sf_dir)
    c = centroids(p)
    assigned = p.where(F.col("label").cast("int") < HELD_OUT).join(F.broadcast(c.select("label", F.col("id").alias("place"))), "label").select("id", "val", "place")
    return clustering.fill_empty(assigned, c.select(F.col("id").alias("place"), "center"))


@query()
def train_best_of(spark, sf_dir):
    p = points(spark, sf_dir)
    model = clustering.best_of(p, [clustering.seeds_first(p, K), clustering.seeds_spread(p, K)], Params(k=K, max_iterations=5, stop="relative", precision=1e-3))
    return clustering.assign(p, model).groupBy("label", "place").agg(F.count("*").alias("n"))


# ---- rounds of detection


def _sequential() -> str:
    parts = [
        ECU,
        "d AS (SELECT cid, list_distance(v, c) AS dist FROM e JOIN c ON label = clabel)",
        "w AS (SELECT cid, sqrt(sum((dist - m) ** 2)) AS dev FROM (SELECT cid, dist, avg(dist) OVER (PARTITION BY cid) AS m FROM d) GROUP BY cid)",
        f"s0 AS MATERIALIZED (SELECT cid AS id, clabel AS label, c, dev FROM c JOIN w USING (cid) WHERE clabel::INT < {HELD_OUT})",
        f"q AS (SELECT id, (label::INT - {HELD_OUT}) * {GROUPS} + id % {GROUPS} AS cand, v FROM e WHERE label::INT >= {HELD_OUT})",
        "qc AS (SELECT cand, list(x ORDER BY d) AS c FROM (SELECT cand, d, avg(x) AS x FROM (SELECT cand, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM q) GROUP BY cand, d) GROUP BY cand)",
        "qd AS (SELECT cand, list_distance(v, c) AS dist FROM q JOIN qc USING (cand))",
        "k AS MATERIALIZED (SELECT cand, c, n, dev FROM qc JOIN (SELECT cand, count(*) AS n, sqrt(sum((dist - m) ** 2)) AS dev FROM (SELECT cand, dist, avg(dist) OVER (PARTITION BY cand) AS m FROM qd) GROUP BY cand) USING (cand))",
        f"x0 AS MATERIALIZED (SELECT {HELD_OUT} AS next)",
    ]
    total = (10 - HELD_OUT) * GROUPS
    for j in range(total):
        parts += [
            f"a{j} AS MATERIALIZED (SELECT k.c, k.dev, s.id AS nid, s.label AS nlabel, list_distance(k.c, s.c) AS dist, s.dev AS ndev FROM k, s{j} s WHERE k.cand = {j} AND k.n >= 3 ORDER BY dist, nid DESC LIMIT 1)",
            f"b{j} AS MATERIALIZED (SELECT c, dev, dist, CASE WHEN dist <= {NOVELTY_F} * ndev THEN nid END AS ext, CASE WHEN dist <= {NOVELTY_F} * ndev THEN nlabel ELSE next::VARCHAR END AS label, (SELECT max(id) + 1 FROM s{j}) AS id FROM a{j}, x{j})",
            f"s{j + 1} AS MATERIALIZED (SELECT id, label, c, dev FROM s{j} UNION ALL SELECT id, label, c, dev FROM b{j})",
            f"x{j + 1} AS MATERIALIZED (SELECT next + coalesce((SELECT (ext IS NULL)::INT FROM b{j}), 0) AS next FROM x{j})",
        ]
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {j}::BIGINT AS candidate, id::BIGINT AS id, label, ext::BIGINT AS extension_of, round(dist, 6) AS dist FROM b{j}" for j in range(total))


@query(_sequential())
def novelty_round_sequential(spark, sf_dir):
    """Parts of the held-out classes as the candidates of one round; each is compared with those accepted before it."""
    p = points(spark, sf_dir)
    model = _with_statistics(p, centroids(p), "label").where(F.col("id") < HELD_OUT)
    held = p.where(F.col("label").cast("int") >= HELD_OUT).withColumn("cand", (F.col("label").cast("int") - HELD_OUT) * GROUPS + F.col("id") % GROUPS)
    means = held.groupBy("cand").agg(F.array(*[F.avg(F.col("val")[i]) for i in range(64)]).alias("center"))
    found = _with_statistics(held, means, "cand").withColumn("id", F.col("cand").cast("long"))
    return novelty.sequential_round(found, model, Params(k=12, min_examples=3, novelty_f=NOVELTY_F)).select("candidate", "id", "label", "extension_of", r6("dist"))


_STATS = "d AS (SELECT cid, list_distance(v, c) AS dist FROM e JOIN c ON label = clabel), s AS (SELECT cid, sqrt(sum((dist - m) ** 2)) AS dev, max(dist) AS far FROM (SELECT cid, dist, avg(dist) OVER (PARTITION BY cid) AS m FROM d) GROUP BY cid)"


@query(f"WITH {ECU}, {_STATS}, g AS (SELECT a.cid, b.cid AS nid, list_distance(a.c, b.c) AS dist FROM c a, c b WHERE a.cid >= {HELD_OUT} AND b.cid < {HELD_OUT} QUALIFY row_number() OVER (PARTITION BY a.cid ORDER BY dist, b.cid DESC) = 1) SELECT g.cid AS id, nid AS nearest_id, dist <= 1.4 * dev AS by_deviation, dist < 1.4 * 0.25 * dev AS by_radius, dist < far AS by_farthest FROM g JOIN s ON s.cid = nid")
def extension_rules(spark, sf_dir):
    p = points(spark, sf_dir)
    rows = novelty.model_dicts(_with_statistics(p, centroids(p), "label"))
    states = {rule: novelty.initial_state(rows[:HELD_OUT], Params(extension_rule=rule)) for rule in ("deviation", "radius", "farthest")}
    out = []
    for r in rows[HELD_OUT:]:
        center = np.array(r["center"], np.float64)
        near = nearest.one_nearest(center[None], states["deviation"].centers)[0][0]
        out.append((r["id"], int(near), *(states[rule].extends(center)[0] is not None for rule in states)))
    return spark.createDataFrame(out, "id bigint, nearest_id bigint, by_deviation boolean, by_radius boolean, by_farthest boolean")


@query(f"WITH {ECU}, n AS (SELECT id, cid, list_distance(v, c) AS dist FROM e, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, cid) = 1), m AS (SELECT cid, count(*) AS n, max(id) AS l FROM n WHERE dist <= {INSIDE} GROUP BY cid) SELECT cid AS id, coalesce(n, 0)::BIGINT AS n_matches, (row_number() OVER (ORDER BY l IS NOT NULL, coalesce(l, cid)) - 1)::BIGINT AS place FROM c LEFT JOIN m USING (cid)")
def consume_in_order(spark, sf_dir):
    p = points(spark, sf_dir)
    model = centroids(p).withColumns({"place": F.col("id"), "radius": F.lit(INSIDE), "n_matches": F.lit(0).cast("long")})
    moved, _ = training.consumed(model, p.drop("label"))
    return moved.select("id", "n_matches", F.col("place").cast("long").alias("place"))


@query("WITH l AS (SELECT user_id AS id, max(event_id) AS latest, user_id % 2 = 0 AS sleeps FROM events GROUP BY user_id), c AS (SELECT max(event_id) AS now FROM events) SELECT id, latest AS latest_match_id FROM l, c WHERE NOT (sleeps AND now - latest > 500)")
def discard_sleepers(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    model = e.groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("latest_match_id")).withColumn("is_sleep", F.col("id") % 2 == 0)
    return training.discarded(model, e.agg(F.max("event_id")).first()[0], 500).select("id", "latest_match_id")


# ---- sinks and files

_PLACED = f"{ECU}, {NEAR}, p AS (SELECT id, cid, CASE WHEN dist <= {INSIDE} THEN clabel ELSE '-' END AS label FROM n WHERE r = 1)"


@query(f"WITH {_PLACED} SELECT 'match' AS kind, id, label, 0::BIGINT AS numbers FROM p UNION ALL SELECT 'unknown', id, NULL, 64 FROM p WHERE label = '-' UNION ALL SELECT 'cluster', cid, clabel, 64 FROM c")
def demux_lines(spark, sf_dir):
    """One output of lines with matches, unknowns and clusters, taken apart again."""
    placed, model = _classified(spark, sf_dir)
    lines = formats.format_clusters(model).unionByName(formats.format_unknowns(placed.where("label = '-'"))).unionByName(formats.format_matches(placed.withColumn("lag", F.lit(0.25))))
    kinds = formats.tagged(lines)
    matches = formats.match_lines(kinds.where("kind = 'example'")).select(F.lit("match").alias("kind"), "id", "label", F.lit(0).cast("long").alias("numbers"))
    unknowns = formats.unknown_lines(lines).select(F.lit("unknown").alias("kind"), "id", F.lit(None).cast("string").alias("label"), F.size("val").cast("long").alias("numbers"))
    clusters = formats.cluster_lines(lines).select(F.lit("cluster").alias("kind"), "id", "label", F.size("center").cast("long").alias("numbers"))
    return matches.unionByName(unknowns).unionByName(clusters)


@query(f"WITH {_PLACED}, o AS (SELECT 'match' AS kind, count(*) AS n FROM p UNION ALL SELECT 'unknown', count(*) FROM p WHERE label = '-' UNION ALL SELECT 'cluster', count(*) FROM c) SELECT mode::INTEGER AS mode, kind, n FROM o, (SELECT unnest([1, 2]) AS mode) WHERE (mode = 2 OR kind = 'match') AND n > 0")
def output_modes(spark, sf_dir):
    placed, model = _classified(spark, sf_dir)
    rows = placed.select(F.lit("match").alias("kind"), "id").unionByName(placed.where("label = '-'").select(F.lit("unknown").alias("kind"), "id")).unionByName(model.select(F.lit("cluster").alias("kind"), "id"))
    out = [x.withColumn("mode", F.lit(mode)) for mode in (0, 1, 2) for x in formats.outputs(rows, mode).values()]
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return both.groupBy("mode", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {ECU} SELECT f AS file, cid AS id, clabel AS label, cid * 3 AS n_matches, 64 AS dims, round(list_sum(list_transform(c, lambda x: abs(x))), 3) AS total FROM c, (SELECT unnest(['lines', 'table']) AS f)")
def model_files(spark, sf_dir):
    """A model written as lines and as a table, and read again."""
    _, c = _classified(spark, sf_dir)
    zero = F.lit(0).cast("long")
    model = c.select("id", "label", "n_matches", zero.alias("n_misses"), zero.alias("latest_match_id"), F.lit(None).cast("long").alias("extension_of"), F.lit(False).alias("is_sleep"), "distance_avg", "distance_stddev", F.lit(0.0).alias("distance_max"), "radius", "center")
    root = f"{scratch_root(spark)}/tables/{uuid.uuid4().hex}"
    out = []
    for name, text in (("lines", True), ("table", False)):
        formats.write_model(model, f"{root}-{name}", text)
        back = formats.read_model(spark, f"{root}-{name}", text)
        out.append(back.select(F.lit(name).alias("file"), "id", "label", "n_matches", F.size("center").alias("dims"), F.round(vectors.taxicab(F.col("center"), vectors.zeros(F.size("center"))), 3).alias("total")))
    return out[0].unionByName(out[1])


@query("WITH l AS (SELECT DISTINCT label FROM embeddings), m AS (SELECT row_number() OVER (ORDER BY label) - 1 AS id, label FROM l) SELECT id, label::VARCHAR AS label, TRUE AS interest FROM m")
def preload_model(spark, sf_dir):
    """A model's rows given twice are taken once."""
    c = centroids(points(spark, sf_dir)).select("id", "label")
    twice = c.withColumn("line", F.col("id")).unionByName(c.select("id", F.lit("again").alias("label"), (F.col("id") + 5).alias("line")).where("id < 5")).unionByName(c.select("id", F.lit("late").alias("label"), (F.col("id") + 100).alias("line")))
    ordered = twice.withColumn("line", F.col("line") * 2 + F.when(F.col("label") == "again", 1).otherwise(0))
    return novelty.preloaded(ordered, "line").select("id", "label", "interest")


@query(SQL["nearest_centroid"])
def late_model_stream(spark, sf_dir):
    """A stream read before its model is complete: the backlog is classified when it is."""
    p = points(spark, sf_dir)
    c = centroids(p)
    spread = p.join(F.broadcast(c.select("label", "center")), "label").withColumn("dist", vectors.euclidean(F.col("val"), F.col("center")))
    model = cut(c.join(spread.groupBy("label").agg((F.sqrt(F.var_pop("dist")) * 3 + 0.5).alias("radius")), "label"))
    rows: list[DataFrame] = []
    late = parallel.LateModel(spark, max(1, model.count()), lambda df, _: rows.append(cut(df.select("id", "cluster_id", r6("dist"), "label"))))
    late.add(model.where("id < 4"))
    parallel.start(_stream(spark, sf_dir), late, _checkpoint(spark)).awaitTermination()
    late.add(model)
    return _together(spark, rows, "id bigint, cluster_id bigint, dist double, label string")


# ---- fields and labels


@query("SELECT l_orderkey, l_linenumber, l_discount, l_quantity FROM lineitem")
def without_fields(spark, sf_dir):
    fields = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount"]
    moved = preprocess.last_columns(read(spark, sf_dir, "lineitem").select(*fields), ["l_quantity"])
    return preprocess.without_fields(moved, [3], fields)


@query(f"WITH {MATCHES} SELECT DISTINCT label FROM m WHERE label <> '-'")
def distinct_labels(spark, sf_dir):
    return evaluate.known_labels(_matches(spark, sf_dir))


@query(f"WITH {MATCHES}, l AS (SELECT DISTINCT label FROM m) SELECT label, (row_number() OVER (ORDER BY try_cast(label AS DOUBLE) IS NOT NULL, coalesce(try_cast(label AS DOUBLE), 0), label) - 1)::BIGINT AS place FROM l")
def ordered_labels(spark, sf_dir):
    found = _matches(spark, sf_dir).select("label").distinct()
    return found.withColumn("place", (F.row_number().over(Window.orderBy(labels.order_of(F.col("label")))) - 1).cast("long"))


@query(f"WITH {MATCHES}, s AS (SELECT count(*) FILTER (label <> '-' AND label = class) AS hits, count(*) FILTER (label <> '-' AND label <> class) AS misses, count(*) FILTER (label = '-') AS unknowns, count(*) AS n FROM m) SELECT hits, misses, unknowns, round(hits / n, 6) AS hits_rate, round(misses / n, 6) AS misses_rate, round(unknowns / n, 6) AS unknowns_rate FROM s")
def final_rates(spark, sf_dir):
    return evaluate.final_rates(_matches(spark, sf_dir), []).select("hits", "misses", "unknowns", r6("hits_rate"), r6("misses_rate"), r6("unknowns_rate"))


@query("SELECT user_id, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 6) AS seconds FROM events GROUP BY user_id")
def elapsed_by_user(spark, sf_dir):
    ends = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    return ends.select("user_id", F.round(preprocess.elapsed_seconds(F.col("a"), F.col("b")), 6).alias("seconds"))


@query("SELECT 0::BIGINT AS line, 'id,label' AS value UNION ALL SELECT row_number() OVER (ORDER BY vec_id), vec_id || ',' || label FROM embeddings")
def header_and_rows(spark, sf_dir):
    rows = ordered.sequence_ids(points(spark, sf_dir).select("id", F.concat_ws(",", F.col("id").cast("string"), "label").alias("value")), "id")
    return formats.with_header(rows, "id,label", "seq")
