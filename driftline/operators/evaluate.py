"""Evaluation of matches against true classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import UNKNOWN
from .ordered import running_sums


def merge(examples: DataFrame, matches: DataFrame, missing: str = "N") -> DataFrame:
    """(id, class, label): examples joined with their matches, an example without one labelled `missing`."""
    return examples.select("id", "class").join(matches.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", F.lit(missing)))


def merge_once(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Inner merge on id in which each true row is used once, by the first prediction."""
    first = predictions.groupBy("id").agg(F.min("label").alias("label"))
    return truth.select("id", "class").dropDuplicates(["id"]).join(first, "id")


def confusion(merged: DataFrame) -> DataFrame:
    """(label, class, n), one row for each cell that occurs."""
    return merged.groupBy("label", "class").agg(F.count("*").alias("n"))


def confusion_wide(merged: DataFrame, classes: list[str]) -> DataFrame:
    """One row a label, one column a class."""
    return merged.groupBy("label").agg(*[F.count(F.when(F.col("class") == c, 1)).alias(c) for c in classes])


def assigned(cells: DataFrame, initial: list[str]) -> DataFrame:
    """(label, assigned, hits): the class that each label stands for. Trained labels stand for themselves, unknown for
    nothing, a novelty for its most frequent class, the first by name if several are."""
    best = cells.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("class").alias("class"))).alias("b"), F.collect_list(F.struct("class", "n")).alias("cells"))
    stands = F.when(F.col("label") == UNKNOWN, F.lit(UNKNOWN)).when(F.col("label").isin(initial), F.col("label")).otherwise(F.col("b.class"))
    own = F.aggregate(F.filter("cells", lambda c: c["class"] == F.col("assigned")), F.lit(0).cast("long"), lambda s, c: s + c["n"])
    return best.withColumn("assigned", stands).select("label", "assigned", own.alias("hits"))


def summary(merged: DataFrame, names: DataFrame, n_matches: int, n_examples: int) -> DataFrame:
    """One row: hits, misses, unknowns, reprocessed, and the first three in % of the larger of matches and examples."""
    joined = merged.join(names.select("label", "assigned"), "label", "left")
    unknown = F.col("label") == UNKNOWN
    hit = ~unknown & (F.col("assigned") == F.col("class"))
    out = joined.agg(F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(~hit & ~unknown, 1)).alias("misses"), F.count(F.when(unknown, 1)).alias("unknowns"))
    base = float(max(n_matches, n_examples, 1))
    return out.withColumn("reprocessed", F.lit(n_matches - n_examples).cast("long")).withColumns({f"{c}_pct": F.col(c) / base * 100 for c in ("hits", "misses", "unknowns")}).withColumn("reprocessed_pct", F.when(F.col("unknowns") > 0, F.col("reprocessed") / F.col("unknowns") * 100))


def running_rates(merged: DataFrame, initial: list[str], names: DataFrame | None = None) -> DataFrame:
    """Rows with running hits, misses and unknowns in the order of id, and their shares so far."""
    stands: Column = F.col("label")
    if names is not None:
        merged = merged.join(names.select("label", "assigned"), "label", "left")
        stands = F.coalesce("assigned", "label")
    unknown = F.col("label") == UNKNOWN
    hit = ~unknown & (stands == F.col("class"))
    out = running_sums(merged, "id", {"hits": hit.cast("int"), "misses": (~hit & ~unknown).cast("int"), "unknowns": unknown.cast("int")})
    total = F.col("hits") + F.col("misses") + F.col("unknowns")
    return out.withColumns({f"{c}_rate": F.col(c) / total for c in ("hits", "misses", "unknowns")})


def final_rates(merged: DataFrame, initial: list[str]) -> DataFrame:
    """The last running rates, one row; without a pass in order, as only totals matter at the end."""
    unknown = F.col("label") == UNKNOWN
    hit = ~unknown & (F.col("label") == F.col("class"))
    out = merged.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("hits", hit), ("misses", ~hit & ~unknown), ("unknowns", unknown))])
    total = F.col("hits") + F.col("misses") + F.col("unknowns")
    return out.withColumns({f"{c}_rate": F.when(total > 0, F.col(c) / total) for c in ("hits", "misses", "unknowns")})


def onsets(matches: DataFrame) -> DataFrame:
    """First id of each label."""
    return matches.groupBy("label").agg(F.min("id").alias("first_id"))


def known_labels(rows: DataFrame) -> DataFrame:
    """The different labels, unknown left out."""
    return rows.where(F.col("label") != UNKNOWN).select("label").distinct()


def repeated_ids(matches: DataFrame) -> DataFrame:
    return matches.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def lag_summary(matches: DataFrame, lag: str = "lag") -> DataFrame:
    return matches.agg(F.min(lag).alias("min_lag"), F.max(lag).alias("max_lag"), F.avg(lag).alias("mean_lag"))


def hit_ratio(merged: DataFrame) -> DataFrame:
    return merged.agg(F.avg((F.col("label") == F.col("class")).cast("double")).alias("hit_ratio"))


def match_counts(model: DataFrame) -> DataFrame:
    """Matches and misses of a model's clusters by label."""
    return model.groupBy("label").agg(F.sum("n_matches").alias("matches"), F.sum("n_misses").alias("misses"), F.count("*").alias("clusters"))


def model_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Clusters of a whose matches differ in b (or that b lacks), with both counts."""
    return a.select("id", F.col("n_matches").alias("matches_a")).join(b.select("id", F.col("n_matches").alias("matches_b")), "id", "left").where(~F.col("matches_a").eqNullSafe(F.col("matches_b")))


def different_clusters(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of a that model_difference() names."""
    return a.join(model_difference(a, b).select("id"), "id", "left_semi")
