"""Structured Streaming forms: rescans of changed files, rolling quotas, late deliveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changed_files(spark: SparkSession, folder: str, schema: str = "path string, text string, version bigint") -> DataFrame:
    """Stream of file versions that land in a folder as JSON lines."""
    return spark.readStream.schema(schema).json(folder)


def latest_versions(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """One row per path: the one of the greatest version (then text), over what is held and what arrived."""
    every = new if old is None else old.unionByName(new)
    rest = [c for c in every.columns if c not in ("path", "version")]
    return every.groupBy("path").agg(F.max(F.struct("version", *rest)).alias("m")).select("path", "m.*").select(*every.columns)


def rescan(stream: DataFrame, scan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Scan only the files of each micro-batch, each path once in its latest version, and append the findings, marked with the batch, to a
    Parquet folder. A batch that is run again overwrites its own part: results are exactly once."""

    def each(batch: DataFrame, number: int) -> None:
        scan(latest_versions(None, batch)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}/part")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_usage(stream: DataFrame, window: str = "24 hours", slide: str = "1 hour", late: str = "3 days") -> DataFrame:
    """Calls, tokens and cost per capability and sliding window; deliveries of one request count once, rows later than ``late`` are dropped by the
    watermark."""
    once = stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["request_id"])
    return once.groupBy(F.window("at", window, slide), "capability").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost"))
