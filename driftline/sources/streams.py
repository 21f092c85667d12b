"""Streaming sources and sinks, and the table that models are shared through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLUSTER, struct
from .formats import labelled_lines


VERSIONED = type(CLUSTER)([*CLUSTER.fields, *struct("version bigint").fields])


def file_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of the files in a folder as they arrive; a smaller number of files a batch makes fresher models."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def labelled(spark: SparkSession, path: str, with_id: bool = True, files_per_batch: int | None = None) -> DataFrame:
    return labelled_lines(file_lines(spark, path, files_per_batch), with_id=with_id)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP server, for development: a socket cannot be read again after a failure."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def generated(spark: SparkSession, rows_per_second: int, dim: int, partitions: int = 4) -> DataFrame:
    """Examples of pseudo-random vectors at a fixed rate, for measurements."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).option("numPartitions", partitions).load()
    one = lambda d: F.pmod(F.xxhash64("value", F.lit(d)), F.lit(1 << 30)) / float(1 << 30)
    return rate.select(F.col("value").alias("id"), F.col("timestamp").alias("time_in"), F.array(*[one(d) for d in range(dim)]).alias("val"))


def kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A topic's values as lines; needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options)
    return reader.load().select(F.col("value").cast("string").alias("value"), "partition", "offset", "timestamp")


def to_kafka(lines: DataFrame, servers: str, topic: str, checkpoint: str):
    return lines.select("value").writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


class ModelStore:
    """Model rows shared between programs: an append-only Parquet table with a version for each append. Readers ask for
    what is newer than the version they know."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(VERSIONED).parquet(self.path)

    def version(self) -> int:
        """The latest version, 0 for a store without rows."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return 0
        return self._rows().agg(F.max("version")).first()[0] or 0

    def append(self, model: DataFrame) -> int:
        new = self.version() + 1
        model.select(*CLUSTER.names).withColumn("version", F.lit(new).cast("long")).write.mode("append").parquet(self.path)
        return new

    def since(self, version: int = 0) -> DataFrame:
        return self._rows().where(F.col("version") > version)

    def latest(self) -> DataFrame:
        """Each cluster as its latest version has it."""
        newest = self._rows().groupBy("id").agg(F.max("version").alias("version"))
        return self._rows().join(newest, ["id", "version"], "left_semi")
