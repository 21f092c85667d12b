from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.functions import labels, preprocess
from driftline.operators import clustering, evaluate, nearest, ordered
from driftline.plans import novelty, training
from driftline.schema import Params
from driftline.sources import formats
from driftline.streaming import parallel


def test_next_label_passes_over_letters_and_dash():
    assert [labels.next_label(n) for n in (44, 64, 96, 0, 127)] == [46, 91, 123, 1, 128]
    assert labels.next_label_ring(254) == 0
    assert labels.next_label_cycle("z") == "0" and labels.next_label_cycle("9") == "a"


@given(st.integers(0, 9999))
def test_label_round_trip(code):
    text = labels.to_text(code)
    assert labels.to_code(text) == code


def test_one_dimensional_kmeans():
    x = np.array([0, 1, 3, 7, 8, 9, 10, 12, 12.5, 12.7])[:, None]
    got = clustering.kmeans_arrays(x, np.array([[4.0], [9.0], [13.0]]), Params(k=3, seed_bias=False))
    assert np.allclose(sorted(got[:, 0]), [4 / 3, 8.5, 12.4])


def test_seed_bias_only_in_the_first_round():
    x = np.array([[0.0], [2.0], [10.0]])
    one = clustering.kmeans_arrays(x, x[:2].copy(), Params(k=2, max_iterations=1, precision=-1))
    assert np.allclose(one[:, 0], [0.0, (2 + 2 + 10) / 2])


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_nearest_agrees_with_plain_distances(seed):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(0, 4, (30, 3)).astype(float), rng.integers(0, 4, (rng.integers(1, 9), 3)).astype(float)
    d = nearest.squared_distances(x, c)
    for last in (True, False):
        place, best = nearest.one_nearest(x, c, last)
        two, both = nearest.two_nearest(x, c, last)
        want = [np.flatnonzero(r == r.min())[-1 if last else 0] for r in d]
        assert place.tolist() == want == two[:, 0].tolist()
        assert np.array_equal(best, d.min(axis=1)) and np.array_equal(both[:, 0], best)
        if len(c) > 1:
            assert np.array_equal(both[:, 1], np.sort(d, axis=1)[:, 1])


def _state(p, k, dim, rng):
    s = novelty.State(p, dim)
    z = np.zeros(k)
    s.add_clusters([chr(65 + i % 3) for i in range(k)], rng.normal(size=(k, dim)) * 3, rng.random(k) * 1.5, rng.random(k) * 2, z, z, np.ones(k, int), z.astype(int), [None] * k)
    return s


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10_000))
def test_stretches_equal_one_at_a_time(seed):
    rng = np.random.default_rng(seed)
    p = Params(k=int(rng.integers(1, 5)), min_examples=int(rng.integers(2, 6)), forget_after=int(rng.integers(20, 200)), trigger=int(rng.integers(10, 60)), reclassify=bool(seed % 2), stamp_new=seed % 3 == 0, drop_reclassified=seed % 4 == 1)
    a = _state(p, int(rng.integers(3, 25)), 3, rng)
    b = novelty.State.load(a.dump())
    x, ids = rng.normal(size=(1200, 3)) * 3, np.arange(1200)
    x[600:, 0] += 4
    plain = novelty.one_at_a_time(b, x, ids)
    at = int(rng.integers(1, 1199))
    quick = [*a.step(x[:at], ids[:at]), *a.step(x[at:], ids[at:])]
    tidy = lambda rows: [(r[0], r[1], r[2], round(r[3], 9) if r[3] is not None else None, r[4]) for r in rows]
    assert tidy(plain) == tidy(quick)
    assert (a.latest == b.latest).all() and (a.asleep == b.asleep).all() and a.next_label == b.next_label
    assert sum(r[0] == "match" for r in quick) == 1200
    assert len(a.unknown_ids) <= p.buffer_size


def test_drift_gives_a_novelty():
    rng = np.random.default_rng(1)
    p = Params(k=3, min_examples=20)
    s = novelty.State(p, 2)
    s.add_clusters(["N"] * 3, [[0, 0], [1, 0], [0, 1]], [1.0] * 3, [1.0] * 3, [0] * 3, [0] * 3, [9] * 3, [0] * 3, [None] * 3)
    old, new = rng.normal(0, 0.2, (300, 2)), rng.normal(0, 0.3, (300, 2)) + 12
    rows = list(s.step(np.vstack([old, new])))
    assert any(r[0] == "cluster" and r[2].isdigit() for r in rows)
    assert [r[2] for r in rows if r[0] == "match"][-1].isdigit()


def test_a_round_without_clusters_consumes_nothing():
    p = Params(k=2, min_examples=50, trigger=4)
    s = novelty.State(p, 1)
    s.add_clusters(["N"], [[0.0]], [0.1], [0.1], [0], [0], [1], [0], [None])
    list(s.step(np.arange(10, 16, dtype=float)[:, None]))
    assert len(s) == 1 and len(s.unknown_ids) == 6


def test_training_needs_k_examples_of_each_class(spark):
    df = spark.createDataFrame([(i, "a" if i else "b", [float(i)]) for i in range(6)], "id long, label string, val array<double>")
    with pytest.raises(ValueError, match="b"):
        training.fit(df, Params(k=2))


def test_table_kmeans_equals_array_kmeans(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4))
    df = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)], "id long, label string, val array<double>").repartition(5)
    p = Params(k=3)
    model = training.fit(df, p).orderBy("id").collect()
    for j, label in enumerate("ab"):
        own = x[j::2]
        centers = clustering.kmeans_arrays(own, own[:3], p)
        stats = clustering.cluster_arrays(own, centers, p)
        got = [r for r in model if r["label"] == label]
        assert np.allclose([r["center"] for r in got], centers)
        assert np.allclose([r["distance_stddev"] for r in got], stats["stddev"])
        assert [r["n_matches"] for r in got] == stats["n"].tolist()


def test_best_start_and_fillers(spark):
    df = spark.createDataFrame([(i, "a", [float(v)]) for i, v in enumerate([0, 1, 2, 50, 51, 52])], "id long, label string, val array<double>")
    one = clustering.seeds_first(df, 2)
    two = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [51.0])], "label string, place int, val array<double>")
    best = clustering.best_of(df, [one, two], Params(k=2, seed_bias=False))
    assert sorted(best.centers[:, 0].tolist()) == [1.0, 51.0]
    assigned = clustering.assign(df, best)
    places = spark.createDataFrame([(0, [1.0]), (1, [51.0]), (2, [30.0])], "place long, center array<double>")
    assert [tuple(r) for r in clustering.fill_empty(assigned, places).collect()] == [(2, 3)]


def test_golden_confusion(spark):
    cells = [("-", "A", 15396), ("-", "N", 4792), ("0", "A", 185), ("0", "N", 40), ("1", "A", 198), ("2", "A", 868), ("2", "N", 98), ("3", "N", 31), ("4", "A", 2), ("5", "A", 12), ("6", "N", 5), ("N", "A", 430518), ("N", "N", 201312)]
    merged = spark.createDataFrame(cells, "label string, class string, n int").select("label", "class", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("id"))
    names = evaluate.assigned(evaluate.confusion(merged), ["N"])
    hits = {r["label"]: (r["assigned"], r["hits"]) for r in names.collect()}
    assert hits["-"] == ("-", 0) and hits["2"] == ("A", 868) and hits["3"] == ("N", 31) and hits["N"] == ("N", 201312)
    total = sum(n for *_, n in cells)
    s = evaluate.summary(merged, names, total, total - 1).first()
    assert (s["hits"], s["misses"], s["unknowns"], s["reprocessed"]) == (202613, 430656, 20188, 1)


def test_ordered_work_does_not_depend_on_blocks(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.lit(1).alias("one"))
    for block in (3, 64, 10_000):
        seq = ordered.sequence_ids(df, "k", "s", block=block)
        assert seq.where("k <> s").count() == 0
        run = ordered.running_sums(df, "k", {"t": F.col("one")}, block=block)
        assert run.where("t <> k + 1").count() == 0


def test_order_of_hot_keys_nulls_and_groups(spark):
    rows = [(7, i, "a") for i in range(60)] + [(None, 500 + i, "b") for i in range(3)] + [(i, i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, t long, g string").repartition(3)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = ordered.sequence_ids(df, "k", "s", ["t"], block=8).orderBy("s").collect()
    assert [r["s"] for r in got] == list(range(len(rows))) and [r["k"] for r in got] == [r[0] for r in want]
    by = ordered.sequence_ids(df, "k", "s", ["t"], block=8, keys=["g"]).collect()
    for g, n in (("a", 60), ("b", 3), (None, 20)):
        assert sorted(r["s"] for r in by if r["g"] == g) == list(range(n))
    run = ordered.running_sums(df, "k", {"n": F.lit(1)}, ["t"], block=8).collect()
    assert sorted(r["n"] for r in run) == list(range(1, len(rows) + 1))
    assert ordered.sequence_ids(df.limit(0), "k", "s").count() == 0


def test_model_lines_and_fixtures(spark):
    line = "0,N,normal,502,0,0.04553028494064095,0.1736759823342961,[2.888834262948207E-4, 0.020268260292164667, 1.0, 0.0]"
    r = formats.bracket_clusters(spark.createDataFrame([(line,)], "value string")).first()
    assert (r["id"], r["label"], r["category"], r["matches"], r["radius"], len(r["center"])) == (0, "N", "normal", 502, 0.1736759823342961, 4)
    with pytest.raises(Exception, match="another length"):
        formats.bracket_clusters(spark.createDataFrame([(line,)], "value string"), dims=22).collect()
    x = formats.labelled_lines(spark.createDataFrame([("0.0,0.4,1,N",), ("",), ("# c",)], "value string")).collect()
    assert [(r["val"], r["class"]) for r in x] == [([0.0, 0.4, 1.0], "N")]
    u = formats.wire_unknowns(spark.createDataFrame([("Ex(id=        12, class=N, val=[0.5, 1.0]);",)], "value string")).first()
    assert (u["id"], u["class"], u["val"]) == (12, "N", [0.5, 1.0])
    o = formats.original_results(spark.createDataFrame([("Ex: 3\tA\tClasse X: ExtNov 7",)], "value string")).first()
    assert (o["id"], o["class"], o["label"]) == (2, "A", "7")


def test_model_files(spark, tmp_path):
    model = training.fit(spark.createDataFrame([(i, "a", [float(i), 1.0]) for i in range(9)], "id long, label string, val array<double>"), Params(k=3))
    formats.write_model(model, str(tmp_path / "t"), text=True)
    formats.write_model(model, str(tmp_path / "p"))
    text, own = formats.read_model(spark, str(tmp_path / "t"), text=True).orderBy("id").collect(), formats.read_model(spark, str(tmp_path / "p")).orderBy("id").collect()
    assert np.allclose([r["center"] for r in text], [r["center"] for r in own], rtol=1e-5)
    assert [r["n_matches"] for r in text] == [r["n_matches"] for r in own]


def test_connection_features(spark):
    row = [1.5, "http", 130.0, 94.0, 3.0, 1.0, 0.0, 0.0, 44.0, 48.0, 0.0, 0.0, 0.0, "SF", "0", "0", "0", "1", "fd95:ec1e:0:0:0:0:0:ffff", 65535, "fd95:0:0:0:0:0:0:1", 0, "01:01:00", "tcp"]
    f = preprocess.connection_features(spark.createDataFrame([row], formats.CONNECTION)).first()
    assert len(f) == 34 and f["class"] == "N"
    assert (f["duration"], f["source_bytes"], f["source_ip_7"], f["source_port"], f["destination_port"]) == (0.5, 1.0, 1.0, 1.0, 0.0)
    assert f["flag"] == pytest.approx(10 / 12) and f["start_time"] == pytest.approx(3660 / 219660)


def test_model_store(spark, tmp_path):
    from driftline.sources.streams import ModelStore

    store = ModelStore(spark, str(tmp_path / "store"))
    assert store.version() == 0
    df = spark.createDataFrame([(i, "a", [float(i), 1.0]) for i in range(9)], "id long, label string, val array<double>")
    model = training.fit(df, Params(k=3))
    assert store.append(model) == 1
    assert store.append(model.where("id = 2").withColumn("radius", F.lit(9.0))) == 2
    assert store.since(1).count() == 1 and store.since().count() == 4
    assert {r["id"]: r["version"] for r in store.latest().collect()} == {0: 1, 1: 1, 2: 2}


def test_stream_windows(spark, tmp_path):
    from driftline.sources.streams import labelled
    from driftline.streaming import windows

    for k in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.csv").write_text("\n".join(f"{10 * k + i},{i}.0,{k}.0,{'AN'[i % 2]}" for i in range(6)))

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(60)
        return spark.table(name).collect()

    source = lambda: labelled(spark, str(tmp_path / "in"), files_per_batch=1)
    seq = run(windows.numbered(source(), "class", "id"), "w_numbered")
    assert sorted((r["class"], r["id"], r["seq"]) for r in seq) == sorted((c, i, n) for c, own in (("A", [0, 2, 4, 10, 12, 14]), ("N", [1, 3, 5, 11, 13, 15])) for n, i in enumerate(own))
    last = max((r for r in run(windows.running_centroids(source(), "class", "val"), "w_centroids") if r["class"] == "A"), key=lambda r: r["n"])
    assert last["n"] == 6 and last["center"] == [2.0, 0.5]
    flat = source().select("class", F.col("val")[0].alias("x"))
    q = windows.count_or_timeout(flat, "class", "x", 2, 60_000).writeStream.format("memory").queryName("w_counted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(15)  # with timeouts a query never runs out of batches
    q.stop()
    counted = spark.table("w_counted").collect()
    assert all(r["n"] == 2 for r in counted) and len(counted) == 6


def test_parallel_detector_repeats_a_batch(spark, tmp_path):
    from driftline.streaming.parallel import ParallelDetector

    rng = np.random.default_rng(0)
    train = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(rng.normal(size=(40, 2)))], "id long, label string, val array<double>")
    p = Params(k=3, min_examples=3, trigger=10, radius_f=0.2)
    out = []
    d = ParallelDetector(spark, training.fit(train, p), p, lambda df, b: out.append((b, sorted(map(str, df.collect())))), state_path=str(tmp_path / "state"))
    batches = [spark.createDataFrame([(100 * b + i, (v + 6 * b).tolist()) for i, v in enumerate(rng.normal(size=(30, 2)))], "id long, val array<double>") for b in range(3)]
    for b, df in enumerate(batches):
        d(df, b)
    again = len(out)
    d(batches[2], 2)
    assert out[again] == out[2] and len(d.state) > 3


def test_parallel_detector_takes_all_unknowns(spark, tmp_path):
    from driftline.streaming.parallel import ParallelDetector

    p = Params(k=2, min_examples=5, trigger=20, most_unknowns=40, forget_after=10**6)
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(50, 0.1, (60, 2)), rng.normal(-50, 0.1, (300, 2))])
    batch = spark.createDataFrame([(i + 100, v.tolist()) for i, v in enumerate(vals)], "id long, val array<double>")
    known = spark.createDataFrame([(0, "a", [0.0, 0.0], 1.0, 1.0)], "id long, label string, center array<double>, radius double, distance_stddev double")
    out = []
    d = ParallelDetector(spark, known, p, lambda df, b: out.extend(df.where("kind = 'cluster'").collect()), state_path=str(tmp_path / "s"))
    d(batch, 0)
    assert {r["val"][0] > 0 for r in out} == {True, False}


def test_kmeans_stops_by_each_rule():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.3, (60, 3)) for c in (0, 2, 5)])
    for rule, precision in (("distance", 1e-8), ("relative", 1e-8), ("farthest", 1e-8), ("movement", 1e-4)):
        p = Params(k=3, stop=rule, precision=precision, seed_bias=False)
        got = clustering.kmeans_arrays(x, x[[0, 60, 120]], p)
        assert np.allclose(np.sort(got[:, 0]), [0, 2, 5], atol=0.3), rule
    with pytest.raises(ValueError):
        clustering.kmeans_arrays(x, x[:3], Params(stop="never"))
    before, now = {"total": 10.0, "far": 4.0, "moved": 2.0}, {"total": 9.0, "far": 4.0, "moved": 1e-5}
    assert [clustering.settled(r, before, now, 1e-4) for r in ("distance", "relative", "farthest", "movement")] == [False, False, True, True]


def test_classes_in_tasks_and_in_passes_train_alike(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, 5))
    df = spark.createDataFrame([(int(i), "AB"[i % 2], v.tolist()) for i, v in zip(rng.permutation(300), x, strict=True)], "id long, label string, val array<double>").repartition(5)
    p = Params(k=6, max_iterations=20)
    cols = ["n_matches", "distance_avg", "distance_stddev", "distance_max", "radius"]
    one = clustering.train(df, p).orderBy("id").collect()
    monkeypatch.setattr(clustering, "CLASS_BYTES", 0)
    two = clustering.train(df, p).orderBy("id").collect()
    assert [(r["id"], r["label"]) for r in one] == [(r["id"], r["label"]) for r in two] and len(one) == 12
    assert np.allclose([r["center"] for r in one], [r["center"] for r in two]) and np.allclose([[r[c] for c in cols] for r in one], [[r[c] for c in cols] for r in two])


def test_tables_and_arrays_stop_alike(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.5, (40, 2)) for c in (0, 3)])
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "id long, label string, val array<double>")
    for rule in ("distance", "relative", "farthest", "movement"):
        p = Params(k=4, stop=rule, precision=1e-3)
        model = clustering.kmeans(df, clustering.seeds_first(df, 4), p)
        assert np.allclose(model.centers, clustering.kmeans_arrays(x, x[:4], p)), rule


def test_extension_rules_at_their_borders():
    row = {"id": 0, "label": "A", "center": [0.0, 0.0], "radius": 1.0, "distance_stddev": 2.0, "distance_max": 3.0}
    for rule, reach, border in (("deviation", 2.8, True), ("radius", 1.4, False), ("farthest", 3.0, False)):
        s = novelty.initial_state([row], Params(extension_rule=rule))
        at = lambda d, s=s: s.extends(np.array([d, 0.0]))[0] is not None
        assert (at(reach - 1e-9), at(reach), at(reach + 1e-9)) == (True, border, False), rule


def test_a_novelty_may_be_extended_in_the_same_round(spark):
    model = spark.createDataFrame([(0, "A", [0.0, 0.0], 1.0, 0.5)], "id long, label string, center array<double>, radius double, distance_stddev double")
    rows = [(0, [9.0, 9.0], 30, 0.1, 2.0, 0.1, 0.2), (1, [9.5, 9.0], 30, 0.1, 2.0, 0.1, 0.2), (2, [5.0, 5.0], 1, 0.1, 2.0, 0.1, 0.2)]
    found = spark.createDataFrame(rows, "id long, center array<double>, n_matches long, radius double, distance_stddev double, distance_avg double, distance_max double")
    got = novelty.sequential_round(found, model, Params(min_examples=20)).collect()
    assert [(r["candidate"], r["id"], r["label"], r["extension_of"]) for r in got] == [(0, 1, "0", None), (1, 2, "0", 1)]
    assert novelty.sequential_round(found.limit(0), model, Params()).count() == 0
    with pytest.raises(ValueError):
        novelty.sequential_round(found, model, Params(k=2))


def test_preloaded_rows_follow_their_order(spark):
    rows = [(0, 0), (1, 0), (2, 1), (3, 5), (4, 1), (5, 2), (6, 4)]
    df = spark.createDataFrame(rows, "line long, id long")
    got = novelty.preloaded(df, "line", mode=1)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, False), (2, 1, False), (3, 5, False), (6, 4, False)]


def test_one_step_consumes_wakes_and_drops(spark):
    model = spark.createDataFrame([(0, "A", 0, [0.0], 1.0, 0, False, 0), (1, "B", 1, [5.0], 1.0, 0, False, 0), (2, "C", 2, [9.0], 1.0, 0, True, 0), (3, "D", 3, [20.0], 1.0, 0, True, -500)], "id long, label string, place int, center array<double>, radius double, n_matches long, is_sleep boolean, latest_match_id long")
    pts = spark.createDataFrame([(0, [5.2]), (1, [0.1]), (2, [0.3]), (3, [9.1]), (4, [50.0])], "id long, val array<double>")
    seen = []
    moved, rest = training.consumed(model.where("not is_sleep"), pts, seen.append)
    assert {r["id"]: (r["place"], r["n_matches"]) for r in moved.collect()} == {1: (0, 1), 0: (1, 2)}
    assert sorted(r["id"] for r in rest.collect()) == [3, 4] and seen[0].where("matched").count() == 3
    after, left = training.next_step(model, pts, 100, lambda m, rest: (m, rest), sleep_after=1000, drop_after=300)
    assert {r["id"]: r["is_sleep"] for r in after.collect()} == {0: False, 1: False, 2: False} and left.count() == 2


def test_unknowns_of_a_batch_meet_its_new_clusters(spark):
    p = Params(k=2, min_examples=3, trigger=10, radius_f=1.0, stddev_mode="population")
    model = spark.createDataFrame([(0, "A", [0.0], 0.5, 0.1), (1, "B", [1.0], 0.5, 0.1)], "id long, label string, center array<double>, radius double, distance_stddev double")
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(i, [float(20 + rng.normal(0, 1))]) for i in range(60)], "id long, val array<double>")
    kinds = {}
    for first in (True, False):
        rows = []
        parallel.ParallelDetector(spark, model, replace(p, identify_first=first), lambda df, _: rows.extend(df.collect()), state_path=f"{spark.conf.get('spark.checkpoint.dir')}/late-{first}")(pts, 0)
        kinds[first] = Counter(r["kind"] for r in rows)
    assert kinds[True]["reclassified"] > 0 and not kinds[False]["reclassified"]
    assert kinds[True]["unknown"] == kinds[False]["unknown"] == 60


def test_a_stream_waits_for_its_model(spark):
    rows = []
    late = parallel.LateModel(spark, 2, lambda df, b: rows.extend((b, r["id"], r["label"]) for r in df.collect()))
    pts = lambda *v: spark.createDataFrame([(int(x * 10), [x]) for x in v], "id long, val array<double>")
    model = spark.createDataFrame([(0, "A", [0.0], 0.5), (1, "B", [1.0], 0.5)], "id long, label string, center array<double>, radius double")
    late(pts(0.1, 0.9), 0)
    late.add(model.where("id = 0"))
    late(pts(0.2), 1)
    late(pts(0.2), 1)
    assert not rows
    late.add(model)
    late(pts(7.0), 2)
    assert sorted(rows) == [(0, 1, "A"), (0, 9, "B"), (1, 2, "A"), (2, 70, "-")]


def test_growing_centres_have_the_same_nearest():
    rng = np.random.default_rng(5)
    for scale, shift in ((1.0, 0.0), (1.0, 300.0), (1e-20, 0.0), (1e18, 0.0)):
        centers = rng.normal(size=(1500, 7)) * scale + shift
        centers[700:900] = centers[:200]  # ties: the last one wins
        x = np.vstack([rng.normal(size=(900, 7)) * scale + shift, centers[100:300]])
        index, out = nearest.Growing(), np.array([3, 150, 700, 1499])
        for k in (40, 41, 900, 1500):
            index.follow(centers[:k])
            got, want = index.nearest(x, centers[:k]), nearest.one_nearest(x, centers[:k])
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        rest = np.delete(np.arange(1500), out)
        got, want = index.nearest(x, centers, out), nearest.one_nearest(x, centers[rest])
        assert (got[0] == rest[want[0]]).all() and (got[1] == want[1]).all()


def test_an_event_does_not_compare_its_block_anew(monkeypatch):
    rng, pairs = np.random.default_rng(2), [0]
    p = Params(k=4, min_examples=3, trigger=40, forget_after=200)
    s = _state(p, 20, 8, rng)
    x = rng.normal(size=(6000, 8)) * 30
    for owner in (novelty, nearest.Growing):
        name = "one_nearest" if owner is novelty else "nearest"
        at, f = int(owner is not novelty), getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda *a, f=f, at=at: (pairs.__setitem__(0, pairs[0] + len(a[at]) * len(a[at + 1])), f(*a))[1])
    rows = list(s.step(x))
    assert sum(r[0] == "cluster" for r in rows) > 300
    assert pairs[0] <= 2 * len(x) * len(s)


def test_rows_of_a_batch_are_written_in_parts(spark, monkeypatch):
    p = Params(k=2, min_examples=3, trigger=10, radius_f=1.0, stddev_mode="population")
    model = spark.createDataFrame([(0, "A", [0.0], 0.5, 0.1)], "id long, label string, center array<double>, radius double, distance_stddev double")
    pts = spark.createDataFrame([(i, [float(20 + i % 7)]) for i in range(90)], "id long, val array<double>")
    got = []
    for part in (parallel.PART, 5):
        monkeypatch.setattr(parallel, "PART", part)
        rows = []
        parallel.ParallelDetector(spark, model, p, lambda df, _, rows=rows: rows.extend(map(str, df.collect())), state_path=f"{spark.conf.get('spark.checkpoint.dir')}/parts-{part}")(pts, 0)
        got.append(sorted(rows))
    assert got[0] == got[1] and len(got[0]) > 180
