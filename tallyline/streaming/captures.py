"""Captures as streams: incremental reads, late records, windows. Every function takes and gives streaming or plain frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import outside, sampled


def events(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder, or one file, as a stream with ``at`` as event time; the schema is read once, from the files.

    The path goes in as a glob that matches itself: a stream takes a plain path for a folder.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("at", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, key: str, delay: str) -> DataFrame:
    """Each key once within ``delay`` of event time; the state older than that is dropped (SS-1)."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark([key])


def bounded(stream: DataFrame, since: str, until: str) -> DataFrame:
    """With ``refused``: why a record is outside [since, until), null inside (SS-2). Late ones go to a side table by a filter on it."""
    return stream.withColumn("refused", outside(F.col("at"), since, until))


def sample(stream: DataFrame, key: Column, rate: float, seed: str) -> DataFrame:
    """The same records in every capture (SS-3)."""
    return stream.filter(sampled(key, rate, seed))


def per_window(stream: DataFrame, keys: list[str], length: str, slide: str | None = None, delay: str = "2 days") -> DataFrame:
    """Counts and sums by tumbling or sliding window of event time (SS-6, SS-7)."""
    w = F.window("at", length, slide) if slide else F.window("at", length)
    return stream.withWatermark("at", delay).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), *keys, "n", "value")


def sessions(stream: DataFrame, keys: list[str], gap: str, delay: str = "2 days") -> DataFrame:
    """Sessions of a key that end after ``gap`` without a record (SS-8)."""
    return stream.withWatermark("at", delay).groupBy(F.session_window("at", gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Reads what is there into a table under ``folder`` and ends; a second run continues from the checkpoint and adds nothing twice (SS-5).

    Append mode writes Parquet and needs aggregations to be closed by their watermark; complete mode replaces the
    table with each batch.
    """
    spark = stream.sparkSession
    out, check = f"{folder}/table", f"{folder}/checkpoint"
    if mode == "append":
        w = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        w = stream.writeStream.foreachBatch(replace).outputMode(mode)
    w.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def append_log(stream: DataFrame, folder: str, keys: list[str], order: str, keep: list[str]) -> DataFrame:
    """A log that only grows, read as the last state of each key (SS-4)."""
    log = run_once(stream.select(*keys, order, *keep), folder)
    return log.groupBy(*keys).agg(F.max(F.struct(order, *keep)).alias("m")).select(*keys, *(f"m.{k}" for k in keep))
