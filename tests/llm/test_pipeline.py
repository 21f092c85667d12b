"""Each stage of the pipeline on its predecessor's rows, against plain versions."""

import random

import corpus_plain as plain
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from driftline.llm import toxicity

R = random.Random(21)


def words(n):
    return [R.choice(["tion", "the", "ing", "and", "er"]) + R.choice("abcdefgh") + str(R.randint(0, 400)) for _ in range(n)]


def documents():
    rows, labels, items = [], [], []
    base = [words(R.randint(30, 120)) for _ in range(160)]
    for i, w in enumerate(base):
        bad = R.random() < 0.25
        if bad:
            w = list(w)
            for _ in range(5):
                w[R.randrange(len(w))] = R.choice(["stupid", "idiot", "moron"])
        rows.append((i, " ".join(w), "en", "s", len(w)))
        labels.append((i, 1, int(bad)))
    for k in range(40):
        rows.append((1000 + k, rows[k][1].replace(" ", "\n", 3), "en", "s", 1))
        near = rows[k][1].split()
        near[R.randrange(len(near))] = "other"
        rows.append((2000 + k, " ".join(near), None, None, None))
    for k in range(10):
        w = words(14)
        items.append((k, " ".join(w)))
        rows.append((3000 + k, " ".join(words(20) + w + words(20)), "en", "s", 1))
    rows += [(4000, None, None, None, None), (4001, "", "en", "s", 0), (4002, " ".join(words(5000)), "en", "s", 1)]
    return rows, labels, items


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows, labels, items = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def near_kept(rows):
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if plain.jaccard(rows[a][1], rows[b][1]) >= 0.8:
                x, y = plain.find(parent, a), plain.find(parent, b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = plain.find(parent, i)
        least[r] = min(d, least.get(r, d))
    return set(least.values())


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if k < 4:
            assert after.columns == columns
            kept = {r["doc_id"] for r in after.collect()}
            assert len(kept) == after.count()
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            want = {r["doc_id"] for r in toxicity.scores(docs, model).where(F.col("score") < corpus_pipeline.TOXIC_FROM).collect()}
            assert kept == want
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
            assert len(toxic & kept) <= 0.2 * len(toxic) and {3000 + i for i in range(10)} <= kept
        elif name == "exact dedup":
            assert kept == {r[0] for r in plain.exact(before) if r[3]}
        elif name == "near dedup":
            assert kept == near_kept(before)
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert kept == {r[0] for r in plain.hits(before, items) if not r[5]}
        else:
            want = plain.pieces(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), before)
            got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after.collect()]
            assert sorted(got) == sorted(want)
        docs = after


def test_run_is_registered(spark, sf_dir):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_what_op10_rejects_goes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()}
    scored = toxicity.scores(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert not kept & {r["doc_id"] for r in scored.where("score >= 0.3").collect()}
    assert corpus_pipeline.TOXIC_FROM == 0.3
