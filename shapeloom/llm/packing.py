"""Best-fit packing of documents into sequences of a fixed capacity, by exact-complement hashing.

A document's length is its number of white-space words, or a given column (tokens). One longer than the capacity is cut into
pieces: full sequences and a rest. The lengths below the capacity are counted, and the plan is made from those counts
alone, so its cost depends on the capacity and not on the number of documents:

1. From the longest length down, the gap that it leaves is looked up among single lengths, then sums of two,
   then sums of three (hash tables of sums; the entry with the longest member first comes first), and the
   combination is taken as often as the counts allow. Such sequences are exactly full.
2. What is left is placed best-fit decreasing: each piece in the fullest sequence that still holds it.

Documents get their places by rank: among pieces of one length, ordered by key and piece
(and document length where keys are repeated), those of rank a to b belong to one line of the plan. Ranks are counted in hash buckets
and then shifted, so no length is a partition of its own.

Defined cases: a null length or text, and a text without words, have length 0, no piece and a null ``bin_id``; equal
lengths are filled in order of key; repeated rows are packed each on its own; an empty table gives an empty
result; a null key sorts first; columns of the input other than key and length don't take part.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: A line of the plan: (lengths of one sequence in order of their placing, how many such sequences).
Line = tuple[tuple[int, ...], int]


def words(text: Column) -> Column:
    """Number of white-space words; 0 for null."""
    t = F.trim(F.regexp_replace(text, r"[\s]+", " "))
    return F.when(text.isNull() | (t == ""), 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def plan(counts: dict[int, int], capacity: int) -> list[Line]:
    """Sequences for pieces of the counted lengths (1 to ``capacity``)."""
    left = np.zeros(capacity + 1, dtype=object)
    for length, n in counts.items():
        left[length] = int(n)
    lines: list[Line] = []

    def take(group: tuple[int, ...]) -> None:
        need: dict[int, int] = defaultdict(int)
        for x in group:
            need[x] += 1
        times = min(left[x] // k for x, k in need.items())
        if times:
            lines.append((group, int(times)))
            for x, k in need.items():
                left[x] -= k * times

    there = lambda: np.flatnonzero(np.array(left > 0, dtype=bool))
    if left[capacity]:
        take((capacity,))
    for size in (1, 2, 3):
        lengths = there()
        if not len(lengths):
            break
        # sums of two that some pair of lengths has; for each, its longer members from the longest down
        for a in lengths[::-1].tolist():
            while left[a] > 0:
                gap, before = capacity - a, left[a]
                if gap < 1:
                    break
                if size == 1:
                    if left[gap]:
                        take((a, gap))
                elif size == 2:
                    live = there()
                    b = live[(live <= min(a, gap - 1)) & (2 * live >= gap)][::-1]
                    b = b[np.array(left[gap - b] > 0, dtype=bool)] if len(b) else b
                    for x in b.tolist():
                        take((a, x, gap - x))
                        if not left[a]:
                            break
                else:
                    _triples(a, gap, left, there, take)
                if left[a] == before:
                    break
    # best fit for the rest: open sequences by what they still hold
    bins: dict[int, list[list]] = defaultdict(list)  # gap -> [lengths, how many]
    gaps: list[int] = []
    def put(gap: int, group: tuple[int, ...], n: int) -> None:
        if gap and n:
            if gap not in bins or not bins[gap]:
                insort(gaps, gap)
            bins[gap].append([group, n])
        elif n:
            lines.append((group, n))

    for a in there()[::-1].tolist():
        n = left[a]
        while n:
            at = bisect_left(gaps, a)
            if at == len(gaps):
                each = capacity // a
                full, rest = divmod(n, each)
                # sequences that hold this length alone: the last one may hold fewer
                put(capacity - each * a, (a,) * each, full)
                if rest:
                    put(capacity - rest * a, (a,) * rest, 1)
                n = 0
                break
            gap = gaps[at]
            group, have = bins[gap].pop(0)
            if not bins[gap]:
                gaps.pop(at)
            each = gap // a
            full = min(have, n // each)
            put(gap - each * a, group + (a,) * each, full)
            n -= full * each
            have -= full
            if have and n and n < each:
                put(gap - n * a, group + (a,) * n, 1)
                have, n = have - 1, 0
            if have:
                if gap not in bins or not bins[gap]:
                    insort(gaps, gap)
                bins[gap].insert(0, [group, have])
    for gap in gaps:
        lines += [(group, n) for group, n in bins[gap]]
    return lines


def _triples(a: int, gap: int, left: np.ndarray, there, take) -> None:
    """Consumes sums of three lengths that fill ``gap`` behind ``a``, from the longest member down."""
    live = there()
    for b in live[(live <= min(a, gap - 2)) & (3 * live >= gap)][::-1].tolist():
        rest = gap - b
        c = live[(live <= min(b, rest - 1)) & (2 * live >= rest)][::-1]
        for x in c[np.array(left[rest - c] > 0, dtype=bool)].tolist() if len(c) else []:
            take((a, b, x, rest - x))
            if not left[a]:
                return
            if not left[b]:
                break


def places(lines: list[Line]) -> list[tuple[int, int, int, int, int, int]]:
    """Of each run of equal lengths in a line: (length, first rank, end rank, first bin, pieces a bin, first slot)."""
    used: dict[int, int] = defaultdict(int)
    out, first = [], 0
    for group, n in lines:
        at = 0
        while at < len(group):
            k = 1
            while at + k < len(group) and group[at + k] == group[at]:
                k += 1
            a = group[at]
            out.append((a, used[a], used[a] + n * k, first, k, at))
            used[a] += n * k
            at += k
        first += n
    return out


def pack(docs: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", length: str | None = None, buckets: int | None = None) -> DataFrame:
    """(key, piece, start, length, bin_id, slot): where each piece of each document goes.

    ``start``: first word of the piece in its document; ``slot``: its place in the sequence ``bin_id``.
    Only (key, length) is shuffled; the counts by length, at most ``capacity`` rows, reach the driver.
    """
    spark = docs.sparkSession
    size = F.col(length).cast("long") if length else words(F.col(text)).cast("long")
    base = materialise(docs.select(F.col(key).alias("__key"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).alias("__n")))
    # full pieces are bins of their own; the rest is one piece
    cut = base.select("__key", "__n", F.explode(F.when(F.col("__n") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / capacity)))).alias("__piece"))
    cut = cut.withColumn("__len", F.least(F.col("__n") - F.col("__piece") * capacity, F.lit(capacity)))
    n_buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cut = cut.withColumn("__b", F.pmod(F.xxhash64("__key", "__piece"), F.lit(n_buckets)))
    full = F.col("__len") > 0
    per = cut.filter(full).groupBy("__len", "__b").agg(F.count("*").alias("__c"))
    counts = {r["__len"]: r["n"] for r in cut.filter(full).groupBy("__len").agg(F.count("*").alias("n")).collect()}
    rows = places(plan(counts, capacity))
    before = Window.partitionBy("__len").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.select("__len", "__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__shift"))
    in_bucket = Window.partitionBy("__len", "__b").orderBy("__key", "__piece", "__n")
    ranked = cut.withColumn("__r", F.row_number().over(in_bucket) - 1).join(shift, ["__len", "__b"], "left").withColumn("__rank", F.col("__r") + F.col("__shift"))
    # the plan's runs of one length as one array a length, searched by rank: bounded by the capacity, not by the data
    by: dict[int, list] = defaultdict(list)
    for a, lo, hi, first, k, slot in rows:
        by[a].append((lo, hi, first, k, slot))
    table = spark.createDataFrame([(a, v, [x[0] for x in v]) for a, v in by.items()], "__len long, __runs array<struct<lo:long,hi:long,first:long,k:long,slot:int>>, __los array<long>")
    # places of numbers below the rank, by halving: as many steps as the longest array needs
    joined, at = ranked.join(table, "__len", "left"), F.lit(0)
    for step in [1 << k for k in range(max(map(len, by.values()), default=1).bit_length() - 1, -1, -1)]:
        joined = joined.withColumn("__at", F.when((at + step <= F.size("__runs")) & (F.get("__los", at + step - 1) <= F.col("__rank")), at + step).otherwise(at))
        at = F.col("__at")
    placed = joined.withColumn("__run", F.when(full, F.get("__runs", at - 1)))
    inner = F.col("__rank") - F.col("__run.lo")
    return placed.select(
        F.col("__key").alias(key),
        F.col("__piece").cast("int").alias("piece"),
        (F.col("__piece") * capacity).alias("start"),
        F.col("__len").alias("length"),
        (F.col("__run.first") + F.floor(inner / F.col("__run.k"))).alias("bin_id"),
        (F.col("__run.slot") + inner % F.col("__run.k")).cast("int").alias("slot"),
    )
