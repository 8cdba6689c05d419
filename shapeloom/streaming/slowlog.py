"""Slow logs as a stream: the same records and digests, aggregated in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import digests
from ..operators.rank import of_phase
from ..options import Options
from ..sources.slowlog import records


def lines(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """New files of a folder, line by line."""
    return spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files).text(folder)


def windowed(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes", phase: str = "query", options: Options = Options(), accuracy: int = 10_000) -> DataFrame:
    """(start, hash, sig, count, measured, total_ms, p95_ms, max_ms) of each window; p95 is approximate, its state bounded.

    Records without a readable time are left out: they belong to no window.
    """
    rows = of_phase(records(stream).filter("status = 'record'"), phase)
    ts = F.coalesce(F.try_to_timestamp(F.regexp_replace("ts", ",", "."), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")), F.try_to_timestamp(F.regexp_replace("ts", ",", "."), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSZ")))
    timed = digests(rows.withColumn("at", ts).filter("at is not null"), "source", "index", options).filter("error is null")
    found = timed.withWatermark("at", late).groupBy(F.window("at", window), "hash", "sig")
    found = found.agg(F.count("*").alias("count"), F.count("took_ms").alias("measured"), F.sum("took_ms").alias("total_ms"), F.percentile_approx("took_ms", 0.95, accuracy).alias("p95_ms"), F.max("took_ms").alias("max_ms"))
    return found.select(F.col("window.start").alias("start"), "hash", "sig", "count", "measured", "total_ms", "p95_ms", "max_ms")
