"""Every query with SQL against DuckDB on the smallest tables; those without are run."""

import os

import duckdb
import pytest

from driftline.queries import QUERIES, SQL, catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR), duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    mine = sorted(str(tuple(r[c] for c in order)) for r in got.collect())
    assert mine == sorted(str(tuple(dict(zip(names, r, strict=True))[c] for c in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_stream_equals_replay(spark):
    cols = ["kind", "id", "label", "dist", "cluster_id"]
    rows = lambda n: sorted(map(str, QUERIES[n](spark, DIR).select(*cols).collect()))
    assert rows("streaming_exact") == rows("online_replay")


@pytest.fixture(scope="module")
def foldered(spark, tmp_path_factory):
    """The tables with embeddings as a folder of part files."""
    root = tmp_path_factory.mktemp("foldered")
    spark.read.parquet(f"{DIR}/embeddings.parquet").repartition(3).write.parquet(f"{root}/embeddings.parquet")
    return str(root)


def test_a_late_model_takes_a_folder_of_parts(spark, duck, foldered):
    got = QUERIES["late_model_stream"](spark, foldered).select("id", "cluster_id", "dist", "label").collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(SQL["late_model_stream"]).fetchall())


def test_a_late_model_may_have_few_labels(spark, tmp_path):
    spark.read.parquet(f"{DIR}/embeddings.parquet").where("label < 6").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = (sorted(map(str, QUERIES[n](spark, str(tmp_path)).select("id", "cluster_id", "dist", "label").collect())) for n in ("late_model_stream", "nearest_centroid"))
    assert got == want and got


@pytest.mark.parametrize("name", ["streaming_parallel", "streaming_exact"])
def test_a_stream_takes_a_folder_of_parts(spark, foldered, name):
    cols = ["kind", "id", "label", "dist", "cluster_id"]
    got, want = (sorted(map(str, QUERIES[name](spark, d).select(*cols).collect())) for d in (foldered, DIR))
    assert got == want and got


def test_a_stream_without_rows_has_no_result_rows(spark, monkeypatch):
    stream = catalog._stream
    monkeypatch.setattr(catalog, "_stream", lambda spark, d: stream(spark, f"{d}/none"))
    monkeypatch.setattr(catalog, "_is_folder", lambda spark, d: True)
    empty = spark.conf.get("spark.checkpoint.dir") + "/empty/none/embeddings.parquet"
    spark.read.parquet(f"{DIR}/embeddings.parquet").limit(0).coalesce(1).write.mode("overwrite").parquet(empty)
    monkeypatch.setattr(catalog, "points", lambda spark, d, points=catalog.points: points(spark, DIR))
    got = QUERIES["streaming_parallel"](spark, empty.removesuffix("/none/embeddings.parquet"))
    assert got.columns == ["kind", "id", "label", "dist", "cluster_id"] and got.count() == 0
