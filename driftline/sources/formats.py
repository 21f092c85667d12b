"""Text formats of examples, models, matches and unknowns, read and written as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import cleaned
from ..schema import CLUSTER

CONNECTION = "duration double, service string, source_bytes double, destination_bytes double, count double, same_srv_rate double, serror_rate double, srv_serror_rate double, dst_host_count double, dst_host_srv_count double, dst_host_same_src_port_rate double, dst_host_serror_rate double, dst_host_srv_serror_rate double, flag string, ids_detection string, malware_detection string, ashula_detection string, label string, source_ip_address string, source_port_number int, destination_ip_address string, destination_port_number int, start_time string, protocol string"


def _numbers(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.trim(x).cast("double"))


def labelled_lines(lines: DataFrame, value: str = "value", with_id: bool = False) -> DataFrame:
    """Lines `v0,...,vn,CLASS` (with_id: the first item is the id) as (id if given, val, class). Blank lines and lines
    that start with # are left out. The class is the last item's first character."""
    parts = F.split(F.col(value), ",")
    kept = lines.where((F.trim(value) != "") & ~F.col(value).startswith("#")).withColumn("_p", parts)
    first = 2 if with_id else 1
    vector = _numbers(F.slice("_p", F.lit(first), F.size("_p") - first)).alias("val")
    own = [F.trim(F.col("_p")[0]).cast("long").alias("id")] if with_id else []
    return kept.select(*own, vector, F.substring(F.trim(F.element_at("_p", -1)), 1, 1).alias("class"))


def read_labelled(spark: SparkSession, path: str, with_id: bool = False) -> DataFrame:
    return labelled_lines(spark.read.text(path), with_id=with_id)


def tagged(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines with their kind: cluster, unknown, comment, blank or example."""
    v = F.col(value)
    return lines.withColumn("kind", F.when(v.startswith("Cluster:"), "cluster").when(v.startswith("Unknown:"), "unknown").when(v.startswith("#"), "comment").when(F.trim(v) == "", "blank").otherwise("example"))


def cluster_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """`Cluster: id, label, n_matches, avg, stddev, radius, c0, ...` as cluster rows."""
    p = F.split(F.regexp_replace(value, r"^Cluster:\s*", ""), r"\s*,\s*")
    rows = lines.where(F.col(value).startswith("Cluster:")).withColumn("_p", p)
    num = lambda i: F.trim(F.col("_p")[i]).cast("double")
    zero = F.lit(0).cast("long")
    return rows.select(F.trim(F.col("_p")[0]).cast("long").alias("id"), F.trim(F.col("_p")[1]).alias("label"), F.trim(F.col("_p")[2]).cast("long").alias("n_matches"), zero.alias("n_misses"), zero.alias("latest_match_id"), F.lit(None).cast("long").alias("extension_of"), F.lit(False).alias("is_sleep"), num(3).alias("distance_avg"), num(4).alias("distance_stddev"), F.lit(0.0).alias("distance_max"), num(5).alias("radius"), _numbers(F.slice("_p", F.lit(7), F.size("_p") - 6)).alias("center")).select(*CLUSTER.names)


def unknown_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    p = F.split(F.regexp_replace(value, r"^Unknown:\s*", ""), r"\s*,\s*")
    return lines.where(F.col(value).startswith("Unknown:")).withColumn("_p", p).select(F.col("_p")[0].cast("long").alias("id"), _numbers(F.slice("_p", F.lit(2), F.size("_p") - 1)).alias("val"))


def wire_unknowns(lines: DataFrame, value: str = "value") -> DataFrame:
    """`Ex(id=..., class=c, val=[...]);` as (id, class, val)."""
    pattern = r"Ex\(id=\s*(\d+), class=(.), val=\[([^\]]*)\]\);"
    pick = lambda g: F.regexp_extract(value, pattern, g)
    return lines.where(F.col(value).rlike(pattern)).select(pick(1).cast("long").alias("id"), pick(2).alias("class"), _numbers(F.split(pick(3), ",")).alias("val"))


def _e(x: Column) -> Column:
    return F.format_string("%e", x)


def format_clusters(model: DataFrame) -> DataFrame:
    """(value): the model as lines, six decimals."""
    return model.select(F.concat(F.lit("Cluster: "), F.concat_ws(", ", F.col("id").cast("string"), "label", F.col("n_matches").cast("string"), _e(F.col("distance_avg")), _e(F.col("distance_stddev")), _e(F.col("radius")), F.transform("center", _e))).alias("value"))


def format_unknowns(unknowns: DataFrame) -> DataFrame:
    return unknowns.select(F.concat(F.lit("Unknown: "), F.concat_ws(", ", F.col("id").cast("string"), F.transform("val", _e))).alias("value"))


def format_matches(matches: DataFrame) -> DataFrame:
    return matches.select(F.concat_ws(",", F.col("id").cast("string"), "label", F.format_string("%f", F.col("lag"))).alias("value"))


def match_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    p = F.split(value, ",")
    return lines.where((F.trim(value) != "") & ~F.col(value).startswith("#")).select(p[0].cast("long").alias("id"), cleaned(p[1]).alias("label"), p[2].cast("double").alias("lag"))


def original_results(lines: DataFrame, value: str = "value") -> DataFrame:
    """`Ex: n<TAB>class<TAB>Classe ...: label`, ids from 1, as (id from 0, class, label)."""
    p = F.split(value, "\t")
    return lines.where(F.col(value).startswith("Ex:")).select((F.trim(F.regexp_replace(p[0], "Ex:", "")).cast("long") - 1).alias("id"), F.trim(p[1]).alias("class"), cleaned(F.trim(F.regexp_replace(p[2], "^[^:]*:", ""))).alias("label"))


def bracket_clusters(lines: DataFrame, value: str = "value", dims: int | None = None) -> DataFrame:
    """`id,label,category,matches,time,mean_distance,radius,[c0, ...]` (brackets optional) as rows; lines of another
    number of dimensions than `dims` are an error."""
    p = F.split(F.regexp_replace(value, r"[\[\]]", ""), r"\s*,\s*")
    rows = lines.where((F.trim(value) != "") & ~F.col(value).startswith("#")).withColumn("_p", p)
    center = _numbers(F.slice("_p", F.lit(8), F.size("_p") - 7))
    if dims is not None:
        center = F.when(F.size(center) == dims, center).otherwise(F.raise_error(F.lit("a centre of another length")).cast("array<double>"))
    c = lambda i, t: F.trim(F.col("_p")[i]).cast(t)
    return rows.select(c(0, "long").alias("id"), c(1, "string").alias("label"), c(2, "string").alias("category"), c(3, "long").alias("matches"), c(4, "long").alias("time"), c(5, "double").alias("mean_distance"), c(6, "double").alias("radius"), center.alias("center"))


def points_to_json(points: DataFrame) -> DataFrame:
    return points.select(F.to_json(F.struct("id", "time", "value")).alias("value"))


def points_from_json(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.select(F.from_json(value, "id bigint, time bigint, value array<double>").alias("p")).select("p.*").withColumn("time", F.timestamp_millis("time"))


def clusters_from_json(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.select(F.from_json(value, "id bigint, center struct<id: bigint, value: array<double>, time: bigint>, variance double, label string, category string, matches bigint, time bigint").alias("c")).select("c.*")


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """Raw connection records: tab-separated with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema=CONNECTION)


def outputs(rows: DataFrame, mode: int) -> dict[str, DataFrame]:
    """The sinks of an output mode: 0 none, 1 matches, 2 also unknowns and clusters."""
    kinds = {0: [], 1: ["match"], 2: ["match", "unknown", "cluster"]}[mode]
    return {k: rows.where(F.col("kind") == k) for k in kinds}


def with_header(rows: DataFrame, header: str, order: str) -> DataFrame:
    """(line, value): a header and then the rows (value) in their order, which is a number from 0."""
    first = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("line"), F.lit(header).alias("value"))
    return first.unionByName(rows.select((F.col(order) + 1).cast("long").alias("line"), "value"))


def interleave(*inputs: DataFrame) -> DataFrame:
    """Several inputs as one, with `source` numbering them."""
    out = inputs[0].withColumn("source", F.lit(0))
    for k, x in enumerate(inputs[1:], 1):
        out = out.unionByName(x.withColumn("source", F.lit(k)))
    return out


def write_model(model: DataFrame, path: str, text: bool = False) -> None:
    """A model as Parquet, or as lines in the order of id; a model is small, so lines are one file."""
    if text:
        format_clusters(model.orderBy("id")).coalesce(1).write.mode("overwrite").text(path)
    else:
        model.write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    return cluster_lines(spark.read.text(path)) if text else spark.read.schema(CLUSTER).parquet(path)


def log_times(lines: DataFrame, value: str = "value") -> DataFrame:
    """(elapsed_s) of log lines with an elapsed time as h:mm:ss or m:ss.ss."""
    pattern = r"(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)"
    g = lambda i: F.coalesce(F.regexp_extract(value, pattern, i).try_cast("double"), F.lit(0.0))
    return lines.where(F.col(value).rlike(pattern)).select(value, (g(1) * 3600 + g(2) * 60 + g(3)).alias("elapsed_s"))


def label_vectors(rows: DataFrame, key: str, label: str, value: str) -> DataFrame:
    """One row a key with a map from label to value; the least value stands for a label given twice."""
    single = rows.groupBy(key, label).agg(F.min(value).alias("_v"))
    return single.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label), F.col("_v"))))).alias("values"))
