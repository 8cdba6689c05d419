"""Workload questions over the digest log: rows (ts timestamp, took, release, hash, sig).

Every plan is one aggregation by fingerprint, so one shuffle with partial aggregates; all shapes count, unless
``candidate_limit`` asks for only the most frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import nearest_rank

SCHEMA = "ts timestamp, took int, release string, os struct<hash:string,sig:string,q:string,idx:string>"


def flat(log: DataFrame) -> DataFrame:
    """A digest log's records as the flat rows that the plans take."""
    return log.select("ts", "took", "release", "os.hash", "os.sig", "os.idx", "os.q")


def _limited(found: DataFrame, order: list[Column], top: int | None) -> DataFrame:
    found = found.orderBy(*order)
    return found if top is None else found.limit(top)


def worst_p95(log: DataFrame, top: int | None = 3) -> DataFrame:
    """Shapes with the worst p95."""
    found = log.groupBy("hash").agg(F.min("sig").alias("sig"), F.count("*").alias("count"), nearest_rank("took", 0.95).alias("p95"))
    return _limited(found, [F.desc("p95"), F.col("hash")], top)


def worth_fixing(log: DataFrame, top: int | None = 5) -> DataFrame:
    """Shapes by the time they took altogether, with their median."""
    found = log.groupBy("hash").agg(F.min("sig").alias("sig"), F.count("*").alias("count"), F.sum("took").alias("total"), nearest_rank("took", 0.5).alias("median"))
    return _limited(found, [F.desc("total"), F.col("hash")], top)


def _when(split, start=None, end=None) -> tuple[Column, Column]:
    ts = F.col("ts")
    before, after = ts < F.lit(split).cast("timestamp"), ts >= F.lit(split).cast("timestamp")
    if start is not None:
        before = before & (ts >= F.lit(start).cast("timestamp"))
    if end is not None:
        after = after & (ts < F.lit(end).cast("timestamp"))
    return before, after


def _halves(log: DataFrame, before: Column, after: Column) -> DataFrame:
    seen = F.when(before | after, F.col("ts"))
    rows = log.select("hash", "sig", F.when(before, F.col("took")).alias("b"), F.when(after, F.col("took")).alias("a"), before.alias("inb"), after.alias("ina"), seen.alias("seen"))
    return rows.groupBy("hash").agg(F.min("sig").alias("sig"), F.count("*").alias("searches"), F.count_if("inb").alias("before"), F.count_if("ina").alias("after"), nearest_rank("b", 0.95).alias("p95_before"), nearest_rank("a", 0.95).alias("p95_after"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen")).filter("before > 0 or after > 0")


def regressed(log: DataFrame, split, start=None, end=None, top: int | None = 3, candidate_limit: int | None = None) -> DataFrame:
    """Shapes by p95 after over p95 before the split; those that weren't there before are left out, a p95 of 0 before gives 0."""
    found = _halves(log, *_when(split, start, end))
    if candidate_limit is not None:  # by all searches of the log, counted in the same pass
        found = found.orderBy(F.desc("searches"), "hash").limit(candidate_limit)
    found = found.filter("before > 0")
    ratio = F.coalesce(F.try_divide(F.col("p95_after"), F.col("p95_before")), F.lit(0.0)).alias("ratio")
    return _limited(found.select("hash", "sig", "p95_before", "p95_after", ratio), [F.desc("ratio"), F.col("hash")], top)


def new_shapes(log: DataFrame, split, start=None, end=None, top: int | None = None) -> DataFrame:
    """Shapes first seen after the split."""
    found = _halves(log, *_when(split, start, end)).filter("before = 0 and after > 0")
    return _limited(found.select("hash", "sig", "after", "first_seen"), [F.desc("after"), F.col("hash")], top)


def stopped_shapes(log: DataFrame, split, start=None, end=None, top: int | None = None) -> DataFrame:
    """Shapes that weren't seen after the split."""
    found = _halves(log, *_when(split, start, end)).filter("after = 0 and before > 0")
    return _limited(found.select("hash", "sig", "before", "last_seen"), [F.desc("before"), F.col("hash")], top)


def one_release_only(log: DataFrame, top: int | None = None) -> DataFrame:
    """Shapes seen under a single release."""
    # two bounds tell whether there is one value: no distinct aggregate, no second shuffle
    found = log.groupBy("hash").agg(F.min("sig").alias("sig"), F.count("*").alias("count"), F.min("release").alias("release"), F.max("release").alias("__last"))
    return _limited(found.filter("release = __last").drop("__last"), [F.desc("count"), F.col("hash")], top)


def time_by_shape(log: DataFrame, top: int | None = 10) -> DataFrame:
    """Where the time goes."""
    return worth_fixing(log, top)


def p95_over_time(log: DataFrame, interval: str = "1 hour", top: int = 5) -> DataFrame:
    """p95 in each interval of the shapes with the worst p95 of all."""
    # one pass: the log as counts of (shape, interval, time), from which both percentiles follow by running sums
    per = log.groupBy("hash", F.window("ts", interval)["start"].alias("bucket"), "took").agg(F.count("*").alias("n"))
    timed = F.when(F.col("took").isNotNull(), F.col("n")).otherwise(0)

    def p95(*by: str) -> Column:
        whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("took").rangeBetween(Window.unboundedPreceding, 0)
        return F.when(F.col("took").isNotNull() & (F.sum(timed).over(upto) >= F.ceil(F.sum(timed).over(whole) * F.lit(0.95))), F.col("took"))

    both = per.select("hash", "bucket", "n", p95("hash").alias("of_all"), p95("hash", "bucket").alias("of_bucket"))
    found = both.groupBy("hash", "bucket").agg(F.sum("n").alias("count"), F.min("of_bucket").alias("p95"), F.min("of_all").alias("all"))
    # a shape's intervals as one row, so that the worst are the first ``top`` rows of an order
    shape = found.groupBy("hash").agg(F.min("all").alias("worst"), F.collect_list(F.struct("bucket", "count", "p95")).alias("per"))
    worst = shape.orderBy(F.desc("worst"), "hash").limit(top)
    return worst.select(F.explode("per").alias("x"), "hash").select("x.bucket", "hash", "x.count", "x.p95").orderBy("bucket", "hash")


def against_shifted(log: DataFrame, start, end, shift: str = "1 hour", top: int | None = 10) -> DataFrame:
    """p95 of each shape in the window [start, end) and in the one a shift earlier; null where it wasn't seen."""
    ts, back = F.col("ts"), F.expr(f"interval {shift}")
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    found = _halves(log, (ts >= lo - back) & (ts < hi - back), (ts >= lo) & (ts < hi))
    ratio = F.when(F.col("before") > 0, F.coalesce(F.try_divide("p95_after", "p95_before"), F.lit(0.0)))
    found = found.select("hash", "sig", "before", "after", "p95_before", "p95_after", ratio.alias("ratio"))
    return _limited(found, [F.col("ratio").desc_nulls_last(), F.col("hash")], top)
