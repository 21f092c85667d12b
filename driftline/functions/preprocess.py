"""Feature preparation for connection records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the feature set: caps by column, and the order of connection flags.
CAPS = {"duration": 3.0, "source_bytes": 65.0, "destination_bytes": 188.0, "count": 9.0, "same_srv_rate": 1.0, "serror_rate": 1.0, "srv_serror_rate": 1.0, "dst_host_count": 88.0, "dst_host_srv_count": 96.0, "dst_host_same_src_port_rate": 1.0, "dst_host_serror_rate": 1.0, "dst_host_srv_serror_rate": 1.0}
FLAGS = ("OTH", "REJ", "RSTO", "RSTOS0", "RSTR", "RSTRH", "S0", "S1", "S2", "S3", "SF", "SH", "SHR")
DAY_SCALE = 219660.0
MINMAX_CAPS = {0: 25.0, 2: 2250.0, 3: 2900.0}


def clamp_scale(x: Column, cap: float) -> Column:
    return F.least(x, F.lit(cap)) / F.lit(cap)


def ipv6_parts(text: Column) -> Column:
    """Eight hextets divided by 65535."""
    return F.transform(F.split(text, ":"), lambda h: F.conv(h, 16, 10).cast("double") / 65535.0)


def port(x: Column) -> Column:
    return x.cast("double") / 65535.0


def time_of_day(text: Column) -> Column:
    p = F.split(text, ":")
    return (p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")) / F.lit(DAY_SCALE)


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds from one timestamp to another, with their microseconds."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def flag_ordinal(text: Column) -> Column:
    """Place of the flag in FLAGS, divided by the last place; null for another text."""
    place = F.array_position(F.array(*[F.lit(f) for f in FLAGS]), text)
    return F.when(place > 0, (place - 1).cast("double") / (len(FLAGS) - 1))


def protocol(text: Column) -> Column:
    return F.ascii(text).cast("double") / 255.0


def traffic_class(label: Column) -> Column:
    return F.when(F.substring(label, 1, 1) == "1", "N").otherwise("A")


def combined_class(label: Column, second: Column | None = None) -> Column:
    one = F.when(label == "-1", "A").otherwise("N")
    if second is None:
        return one
    return F.concat_ws("_", second, one)


def alert_codes(text: Column) -> Column:
    """Each comma-separated item without its last three characters."""
    return F.array_join(F.transform(F.split(text, ","), lambda x: F.substring(x, F.lit(1), F.greatest(F.length(x) - 3, F.lit(0)))), ",")


def known_attack_or_normal(ids: Column, label: Column) -> Column:
    return ((ids != "0") & (label == "-1")) | (label == "1")


def as_double(x: Column) -> Column:
    return x.try_cast("double")


def min_max(df: DataFrame, columns: list[str], caps: dict[str, float] | None = None) -> DataFrame:
    """Each column scaled to [0, 1] by its minimum and its maximum (at least 0), after its cap; constant columns give
    0. The extremes are one row, broadcast."""
    caps = caps or {}
    value = {c: F.least(F.col(c), F.lit(caps[c])) if c in caps else F.col(c) for c in columns}
    ends = df.agg(*[F.min(value[c]).alias(f"_lo_{c}") for c in columns], *[F.greatest(F.max(value[c]), F.lit(0.0)).alias(f"_hi_{c}") for c in columns])
    scaled = df.crossJoin(F.broadcast(ends)).withColumns({c: F.when(F.col(f"_hi_{c}") == F.col(f"_lo_{c}"), 0.0).otherwise((value[c] - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))) for c in columns})
    return scaled.select(*df.columns)


def extremes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, min, max), one row a column, from one pass."""
    one = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"lo_{c}").cast("double").alias("min"), F.col(f"hi_{c}").cast("double").alias("max")) for c in columns])))


#: Columns that one_hot makes at most.
MOST_VALUES = 10_000


def one_hot(df: DataFrame, column: str, values: list[str] | None = None) -> DataFrame:
    """df with one 0/1 column for each value, in alphabetical order; the values are those of the column if not given,
    and more than MOST_VALUES of them are an error."""
    if values is None:
        values = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_VALUES + 1).collect())
        if len(values) > MOST_VALUES:
            raise ValueError(f"more than {MOST_VALUES} values of {column}")
    return df.withColumns({f"{column}_{v}": (F.coalesce(F.col(column) == v, F.lit(False))).cast("int") for v in values})


def frequent_keys(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows whose key occurs at least `least` times. Keys are counted before they are joined, so a hot key is one row."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return df.join(counts.drop("_n"), keys, "left_semi")


def stratified_split(df: DataFrame, keys: list[str], per_key: int, id_col: str, seed: int = 0, multiple: int = 1) -> tuple[DataFrame, DataFrame]:
    """(offline, online): for each key `per_key` rows, rounded down to a multiple, in an order that depends on the seed
    and the id alone; the rest is online."""
    take = per_key - per_key % multiple
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order, id_col))).where(F.col("_r") <= take).select(id_col)
    return df.join(ranked, id_col, "left_semi"), df.join(ranked, id_col, "left_anti")


def last_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the given columns moved to the end."""
    return df.select(*[c for c in df.columns if c not in columns], *columns)


def without_fields(df: DataFrame, places: list[int], fields: list[str]) -> DataFrame:
    """df without the fields at the given places of `fields`, their order before any of them was moved."""
    gone = {fields[k] for k in places}
    return df.select(*[c for c in df.columns if c not in gone])


def connection_features(raw: DataFrame) -> DataFrame:
    """The 33 numbers and the class of a raw connection record, nominal columns dropped."""
    numbers = [clamp_scale(F.col(c).cast("double"), cap).alias(c) for c, cap in CAPS.items()]
    source, target = ipv6_parts(F.col("source_ip_address")), ipv6_parts(F.col("destination_ip_address"))
    return raw.select(
        *numbers,
        flag_ordinal(F.col("flag")).alias("flag"),
        *[source[i].alias(f"source_ip_{i}") for i in range(8)],
        port(F.col("source_port_number")).alias("source_port"),
        *[target[i].alias(f"destination_ip_{i}") for i in range(8)],
        port(F.col("destination_port_number")).alias("destination_port"),
        time_of_day(F.col("start_time")).alias("start_time"),
        protocol(F.col("protocol")).alias("protocol"),
        traffic_class(F.col("label")).alias("class"),
    )
