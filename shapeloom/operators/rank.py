"""Ranking of query shapes by what they cost: records, digests, one shuffle by fingerprint, the top of the order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import digest_names, digests
from ..options import InvalidOption, Options

SORTS = {"total": "total_ms", "count": "count", "p95": "p95_ms", "max": "max_ms", "mean": "mean_ms"}
PHASES = ("query", "fetch", "both")


def nearest_rank(value: str, share: float) -> Column:
    """The value of a column at rank ceil(share * n) of n in order; null without values."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def _of_phase(phase: str) -> Column:
    if phase not in PHASES:
        raise InvalidOption(f"a phase is one of {', '.join(PHASES)}, not {phase!r}")
    return F.lit(True) if phase == "both" else F.col("phase").isNull() | (F.col("phase") == phase)


def of_phase(records: DataFrame, phase: str = "query") -> DataFrame:
    """Records of a phase; those without one always stay."""
    return records.filter(_of_phase(phase))


def read_records(records: DataFrame, phase: str = "query", options: Options = Options()) -> DataFrame:
    """Slow-log records with their digests, which are null but for readable records of the phase (``chosen``).

    Nothing is filtered here: a filter on what a Python function returns would be moved below it and evaluate it once more.
    """
    chosen, source, new = F.coalesce(_of_phase(phase), F.lit(False)), F.col("source"), digest_names(records, "chosen", "text")
    if "status" in records.columns:
        chosen = chosen & (F.col("status") == "record")
    with_text = records.withColumn(new["chosen"], chosen).withColumn(new["text"], F.when(F.col(new["chosen"]), source))
    return digests(with_text, new["text"], "index", options).drop(new["text"]).withColumnRenamed(new["chosen"], "chosen")


def shapes(searches: DataFrame, place: str | None = None) -> DataFrame:
    """One row a fingerprint, of rows (hash, sig, idx, q, took_ms, ts).

    ``measured`` counts rows with a duration, of which total, mean, p95 (nearest rank), max and the slowest text are. The slowest
    is the first by ``place`` where several took as long; without any, the first text. ``first`` and ``last`` compare as text.
    """
    order = F.col(place) if place else F.lit(0)
    best = F.min_by("q", F.struct(F.col("took_ms").isNull().alias("none"), (-F.col("took_ms")).alias("t"), order.alias("at"), F.col("q").alias("q")))
    return searches.groupBy("hash").agg(
        F.min("sig").alias("sig"), F.min("idx").alias("idx"), F.count("*").alias("count"), F.count("took_ms").alias("measured"),
        F.sum("took_ms").alias("total_ms"), F.avg("took_ms").alias("mean_ms"), nearest_rank("took_ms", 0.95).alias("p95_ms"), F.max("took_ms").alias("max_ms"),
        F.min("ts").alias("first"), F.max("ts").alias("last"), best.alias("slowest"),
    )


def ranked(found: DataFrame, sort: str = "total", top: int | None = 20) -> DataFrame:
    """Shapes in order: the sort key down (null as 0), then count down, then fingerprint; the first ``top``, all for None."""
    if sort not in SORTS:
        raise InvalidOption(f"shapes sort by {', '.join(SORTS)}, not {sort!r}")
    in_order = found.orderBy(F.coalesce(F.col(SORTS[sort]), F.lit(0)).desc(), F.col("count").desc(), F.col("hash"))
    return in_order if top is None else in_order.limit(top)


def rank_shapes(records: DataFrame, phase: str = "query", sort: str = "total", top: int | None = 20, options: Options = Options(), place: str | None = None) -> DataFrame:
    """Ranked shapes of slow-log records (source, index, took_ms, ts, phase[, status])."""
    return ranked(readable(shapes(read_records(records, phase, options), place)), sort, top)


def readable(found: DataFrame) -> DataFrame:
    """Shapes without the one of what has no digest; by the signature, a filter on which stays above the aggregation."""
    return found.filter("sig is not null")


@dataclass(frozen=True)
class Summary:
    lines: int
    records: int
    shapes: int
    total_ms: float
    failed: int
    other_phase: int


def summary(lines: DataFrame, phase: str = "query", options: Options = Options()) -> Summary:
    """Counts over a slow log's lines (``sources.slowlog.records``): one pass, one row to the driver."""
    return counted(read_records(lines, phase, options))


def counted(read: DataFrame) -> Summary:
    """The counts over lines that ``read_records`` has read."""
    is_record, chosen = F.col("status") == "record", F.col("chosen")
    good = chosen & F.col("error").isNull()
    row = read.agg(
        F.count("*").alias("lines"), F.count_if("chosen").alias("records"), F.count_distinct(F.when(good, F.col("hash"))).alias("shapes"),
        F.coalesce(F.sum(F.when(good, F.col("took_ms"))), F.lit(0.0)).alias("total"),
        F.count_if(unreadable()).alias("failed"), F.count_if(is_record & ~chosen).alias("other"),
    ).first()
    return Summary(row["lines"], row["records"], row["shapes"], row["total"], row["failed"], row["other"])


def unreadable() -> Column:
    """Lines that hold a search that can't be read: cut ones, and records of the phase whose request is none."""
    return (F.col("status") == "cut") | (F.col("chosen") & F.col("error").isNotNull())


def failures(read: DataFrame) -> DataFrame:
    """The rows of ``read_records`` that can't be read, with the reason in ``error``."""
    return read.withColumn("error", F.when(F.col("status") == "cut", F.lit("the source doesn't end")).otherwise(F.col("error"))).filter(F.col("error").isNotNull() & (F.col("chosen") | (F.col("status") == "cut")))


def top_per_bucket(searches: DataFrame, bucket: str, n: int) -> DataFrame:
    """The n costliest shapes of each value of ``bucket``."""
    per = searches.groupBy(bucket, "hash").agg(F.min("sig").alias("sig"), F.sum("took_ms").alias("total_ms"), F.count("*").alias("count"))
    w = Window.partitionBy(bucket).orderBy(F.col("total_ms").desc_nulls_last(), F.col("count").desc(), "hash")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
