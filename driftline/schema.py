"""Record types and parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

UNKNOWN = "-"

_TYPES = {"bigint": T.LongType(), "string": T.StringType(), "timestamp": T.TimestampType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<double>": T.ArrayType(T.DoubleType())}


def struct(text: str) -> T.StructType:
    """A schema from "name type, ..." without a Spark session, so that executors can import it too."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(","))])


EXAMPLE = struct("id bigint, label string, time_in timestamp, val array<double>")
CLUSTER = struct("id bigint, label string, n_matches bigint, n_misses bigint, latest_match_id bigint, extension_of bigint, is_sleep boolean, distance_avg double, distance_stddev double, distance_max double, radius double, center array<double>")
MATCH = struct("id bigint, label string, dist double, cluster_id bigint, lag double")
OUTPUT = struct("kind string, id bigint, label string, dist double, cluster_id bigint, val array<double>")


@dataclass(frozen=True)
class Params:
    """k clusters a class or round; radius = radius_f * deviation; a cluster of min_examples may be kept; an extension
    lies within novelty_f deviations of the nearest cluster (extension_rule "radius": nearer than novelty_f radii,
    "farthest": nearer than its farthest point); k-means stops by `stop` (operators.clustering.settled); forget after `forget_after` ids; detect at `trigger` unknowns, hold `most_unknowns`."""

    k: int = 100
    radius_f: float = 0.25
    min_examples: int = 20
    novelty_f: float = 1.4
    forget_after: int = 10_000
    precision: float = 1e-8
    max_iterations: int = 100
    trigger: int | None = None
    most_unknowns: int | None = None
    stddev_mode: str = "sum"
    seed_bias: bool = True
    stamp_new: bool = False
    reclassify: bool = False
    final_flush: bool = False
    drop_reclassified: bool = False
    identify_first: bool = True
    extension_rule: str = "deviation"
    stop: str = "distance"

    @property
    def trigger_size(self) -> int:
        return self.trigger if self.trigger is not None else self.k * self.min_examples

    @property
    def buffer_size(self) -> int:
        return self.most_unknowns if self.most_unknowns is not None else 2 * self.trigger_size
