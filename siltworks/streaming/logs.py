"""Append-only logs as streams."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.plans.runtime import delete_at_end, scratch


def hourly_counts(spark: SparkSession, path: str, late: str | None = None) -> DataFrame:
    """(hour, kind, events): tumbling hours (counted from the epoch) of the events of a Parquet log, once an event id, by a stream with an availableNow trigger.

    Each finished micro-batch appends its partial counts, which are added up at the end, so late rows count in their own hour. Repeated ids are dropped by state: of the whole log, or, late (for example "2 days"), within that time of each other, by which the state stays bounded. Rows without a time or an id are left out; an empty log gives no row."""
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    source = log_stream(spark, path)
    events = source.where("ts IS NOT NULL AND log_id IS NOT NULL").select("log_id", "kind", "ts")
    events = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["log_id"]) if late else events.dropDuplicates(["log_id"])

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.floor(F.unix_seconds("ts") / 3600).alias("hour"), "kind").agg(F.count(F.lit(1)).alias("events")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    events.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    delete_at_end(spark, folder)
    spark.createDataFrame([], "hour long, kind string, events long").write.mode("overwrite").parquet(f"{folder}/out/batch=none")
    return spark.read.schema("hour long, kind string, events long").parquet(f"{folder}/out").groupBy("hour", "kind").agg(F.sum("events").alias("events"))


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet log as a stream: a folder of files, or one file of a folder."""
    p = PurePosixPath(path)
    schema = spark.read.parquet(path).schema
    if _is_folder(spark, path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", p.name).parquet(str(p.parent))


def json_events(spark: SparkSession, folder: str, schema: str = "kind string, time string") -> DataFrame:
    """A folder of JSON-lines events as a stream; broken lines give rows of nulls."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
