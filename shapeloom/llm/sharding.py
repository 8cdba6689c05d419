"""Sharding: weighted rendezvous hashing of stable record keys.

Every shard draws a number from the record's key and its own name, u in (0, 1), from 52 bits of an MD5; the shard of the
largest ``weight / -ln(u)`` takes the record. A shard's part of the records is its part of the weights, and a new, lost
or reweighted shard moves only records to or from itself. The placing is a projection: built-in functions alone,
no shuffle and no state, whatever the number of records.

Defined cases: the key is the columns given, as strings, joined by a separator that can't be mistaken; a null column is a
value of its own beside the empty string; records with equal keys share a shard; equal scores go to the shard named first;
an empty table gives an empty result; texts aren't read; a column with the added one's name is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shards of the registered query: sixteen, of which the last four have room for twice as much.
SHARDS: dict[int, float] = {i: 2.0 if i >= 12 else 1.0 for i in range(16)}


def record_key(*columns: str) -> Column:
    """The columns as one string: ``length:value`` for each, ``-`` for a null."""
    each = [F.coalesce(F.concat(F.length(c := F.col(name).cast("string")), F.lit(":"), c), F.lit("-")) for name in columns]
    return F.concat_ws("|", *each)


def shard_of(key: Column, shards: Mapping[int, float]) -> Column:
    """The shard's number for a key that isn't null."""
    usable = {k: float(w) for k, w in shards.items() if w > 0}
    if not usable:
        raise ValueError("no shard has a positive weight")

    def score(name: int, weight: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{name}"))), 1, 13), 16, 10).cast("double")
        return F.lit(weight) / -F.log((bits + 0.5) / F.lit(float(1 << 52)))

    ranked = [F.struct(score(k, w).alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, w) in enumerate(usable.items())]
    return (ranked[0] if len(ranked) == 1 else F.array_max(F.array(*ranked)))["k"].cast("int")


def assign(records: DataFrame, shards: Mapping[int, float] = SHARDS, key: str | tuple[str, ...] = "doc_id", to: str = "shard") -> DataFrame:
    """``records`` with the shard of each in the column ``to``."""
    names = (key,) if isinstance(key, str) else tuple(key)
    return records.withColumn(to, shard_of(record_key(*names), shards))


def write(records: DataFrame, path: str, shards: Mapping[int, float] = SHARDS, key: str | tuple[str, ...] = "doc_id", to: str = "shard", files: int = 8) -> None:
    """Writes each shard as a folder ``shard=N`` of up to ``files`` files.

    Records are spread over the shard's files by key, so that neither a shard nor a hot source is one task.
    """
    names = (key,) if isinstance(key, str) else tuple(key)
    spread = F.pmod(F.xxhash64(record_key(*names)), F.lit(files))
    assign(records, shards, key, to).repartition(F.col(to), spread).write.partitionBy(to).parquet(path)


def oracle(shards: Mapping[int, float] = SHARDS) -> str:
    """The registered query in DuckDB SQL."""
    rows = ", ".join(f"({i}, {k}, {float(w)!r}::DOUBLE)" for i, (k, w) in enumerate(shards.items()) if w > 0)
    return f"""
WITH shards(place, shard, weight) AS (VALUES {rows}),
keyed AS (SELECT row_number() OVER () AS r, doc_id, coalesce(length(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') AS k FROM documents),
scored AS (
  SELECT r, doc_id, shard, place,
         weight / -ln((('0x' || substr(md5(k || '#' || shard), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS score
  FROM keyed CROSS JOIN shards)
SELECT doc_id, shard::INTEGER AS shard FROM scored
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, place) = 1"""
