"""Digests as Spark columns.

One vectorised Python function reads, canonicalises and renders a batch of requests, and works out fingerprints and length caps of its
distinct ones; the same of single lines are built-in functions. Project the struct once and select its fields from there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import Options
from .alike import Shapes
from .request import InvalidRequest, describe
from .request import fingerprint as plain_fingerprint

LINE = "struct<idx:string,q:string,sig:string,full:string,notes:array<string>,error:string>"
RULES = "array<struct<rule:string,count:int,why:string,on:array<string>>>"
_RULES = pa.list_(pa.struct([("rule", pa.string()), ("count", pa.int32()), ("why", pa.string()), ("on", pa.list_(pa.string()))]))
#: Distinct requests of a batch up to which their lines are kept for the next.
FEW = 1000
_FIELDS = [pa.field("idx", pa.string()), pa.field("q", pa.string()), pa.field("sig", pa.string()), pa.field("full", pa.string()), pa.field("notes", pa.list_(pa.string())), pa.field("error", pa.string())]


SHOWN = LINE.replace("full", "hash")


def _fields(with_rules: bool) -> list[pa.Field]:
    return [*_FIELDS, pa.field("rules", _RULES)] if with_rules else _FIELDS


def _hashes(full: pa.Array, options: Options) -> pa.Array:
    found = pc.dictionary_encode(full)
    each = [None if x is None else plain_fingerprint(x, options) for x in found.dictionary.to_pylist()]
    return pa.array(each, pa.string()).take(found.indices)


def _cut(line: pa.Array, most: int | None) -> pa.Array:
    """``capped`` in an array."""
    if most is None or most <= 0 or (pc.max(pc.utf8_length(line)).as_py() or 0) <= most:
        return line
    return pc.if_else(pc.greater(pc.utf8_length(line), most), pc.binary_join_element_wise(pc.utf8_slice_codeunits(line, 0, max(1, most - 1)), "…", ""), line)


def _digested(lines: pa.StructArray, options: Options) -> pa.StructArray:
    """Lines with their caps of length and fingerprints in place of uncapped signatures."""
    idx, q, sig, full, *rest = lines.flatten()
    fields = [pa.field("hash", pa.string()) if f.name == "full" else f for f in lines.type]
    return pa.StructArray.from_arrays([idx, _cut(q, options.max_length), _cut(sig, options.max_length), _hashes(full, options), *rest], fields=fields)


def _singly(requests: list[str | None], index: str | None, options: Options, with_rules: bool) -> pa.StructArray:
    columns: list[list] = [[] for _ in range(7)]
    for request in requests:
        if request is None:
            row = (None, None, None, None, None, "the request is null", None)
        else:
            try:
                x = describe(request, index, options, with_rules)
                row = (x.idx, x.q, x.sig, x.full, x.notes or None, None, x.rules)
            except InvalidRequest as e:
                row = (None, None, None, None, None, str(e), None)
        for column, value in zip(columns, row):
            column.append(value)
    fields = _fields(with_rules)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)


def _batch(requests: pa.Array, indices: pa.Array, shapes: Shapes, finish: Callable[[pa.StructArray], pa.StructArray] = lambda lines: lines) -> pa.StructArray:
    """Each distinct (request, index) once, those of one shape together; ``finish`` is given the lines of these.

    Where they are few, the next batch looks for its own among them first.
    """
    r, i = (pc.dictionary_encode(x.cast(pa.string()), null_encoding="encode") for x in (requests, indices))
    r.dictionary.validate(full=True)
    width = len(i.dictionary)
    pairs = r.indices if width == 1 else pc.dictionary_encode(pc.add(pc.multiply(r.indices.cast(pa.int64()), width), i.indices.cast(pa.int64())))
    few = width == 1 and len(r.dictionary) <= FEW
    if few and shapes.last is not None and shapes.last[0] == i.dictionary[0].as_py():
        place = pc.index_in(r.dictionary, shapes.last[1])
        if not place.null_count:
            return shapes.last[2].take(place.take(r.indices))
    codes = np.arange(len(r.dictionary)) if width == 1 else np.asarray(pairs.dictionary)
    parts: list[tuple[np.ndarray, pa.StructArray]] = []
    of = codes % max(width, 1)
    order = np.argsort(of, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(codes) else ():
        index = i.dictionary[int(of[mine[0]])].as_py()
        texts = r.dictionary.take(pa.array(codes[mine] // width))
        found, rest = shapes.read(texts, index)
        parts += [(mine[at], lines) for at, lines in found]
        if len(rest):
            parts.append((mine[rest], _singly(texts.take(pa.array(rest)).to_pylist(), index, shapes.options, shapes.with_rules)))
    if not parts:
        return finish(pa.array([], pa.struct(_fields(shapes.with_rules))))
    lines = finish(pa.concat_arrays([x for _, x in parts]))
    place = np.empty(len(codes), np.int64)
    place[np.concatenate([at for at, _ in parts])] = np.arange(len(codes))
    if few:
        shapes.last = (i.dictionary[0].as_py(), r.dictionary, lines.take(pa.array(place)))
    return lines.take(pa.array(place[np.asarray(pairs if width == 1 else pairs.indices)]))


def _text(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fingerprint(full: str | Column, options: Options = Options()) -> Column:
    """The versioned fingerprint of an uncapped signature."""
    return F.concat(F.lit(f"{options.version}:"), F.substring(F.sha2(_text(full), 256), 1, options.hash_length))


def capped(line: str | Column, most: int | None) -> Column:
    """A line of at most so many characters, the last of a longer one being an ellipsis."""
    line = _text(line)
    if most is None or most <= 0:
        return line
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, max(1, most - 1)), F.lit("…"))).otherwise(line)


def index_pattern(index: str | Column) -> Column:
    """Rolling parts of index names as stars, by built-in functions alone."""
    blank = " \t\n\r\0\x0b"
    each = F.transform(F.split(F.btrim(_text(index), F.lit(blank)), ","), lambda x: F.btrim(x, F.lit(blank)))

    def collapse(x: Column) -> Column:
        x = F.regexp_replace(x, r"[0-9]{4}[-._]?[0-9]{2}[-._]?[0-9]{2}", "*")
        x = F.regexp_replace(x, r"(?<=^|[-._])[0-9]+(?=$|[-._])", "*")
        return F.regexp_replace(x, r"\*(?:[-._]?\*)+", "*")

    names = F.transform(F.filter(each, lambda x: x != ""), collapse)
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(names)), ","), F.lit(""))


def digest_names(df: DataFrame, *names: str) -> dict[str, str]:
    """Names for columns of our own that no column of ``df`` has."""
    taken, found = {c.lower() for c in df.columns}, {}
    for name in names:
        own = f"__{name}"
        while own in taken:
            own += "_"
        found[name] = own
    return found


def line(request: str | Column, index: str | Column | None = None, options: Options = Options(), with_rules: bool = False) -> Column:
    """struct<idx, q, sig, full, notes, error[, rules]>: the lines without caps of length. ``error``: why there are none."""
    return _read(LINE, request, index, options, with_rules, lambda lines: lines)


def _read(returns: str, request: str | Column, index: str | Column | None, options: Options, with_rules: bool, finish: Callable[[pa.StructArray], pa.StructArray]) -> Column:
    shapes = Shapes(options, with_rules, _fields(with_rules))

    @F.arrow_udf(returns[:-1] + f",rules:{RULES}>" if with_rules else returns)
    def read(requests: pa.Array, indices: pa.Array) -> pa.Array:
        return _batch(requests, indices, shapes, finish)

    return read(_text(request).cast("string"), (F.lit(None) if index is None else _text(index)).cast("string"))


def with_digest(df: DataFrame, request: str = "request", index: str | None = None, options: Options = Options(), to: str = "digest", with_rules: bool = False, dedupe: bool = False) -> DataFrame:
    """``df`` with a struct <idx, q, sig, hash, notes, error[, rules]> in the column ``to``.

    ``dedupe`` digests each distinct (request, index) once and joins the rest to it: for inputs whose bodies repeat across
    partitions much more than within batches.
    """
    place = F.col(index) if index else F.lit(None).cast("string")

    def shown(request: Column, index: Column) -> Column:
        return _read(SHOWN, request, index, options, with_rules, lambda lines: _digested(lines, options))

    new = digest_names(df, "request", "index", "hash")
    if not dedupe:
        return df.withColumn(to, shown(F.col(request), place))
    # joined by a hash of 128 bits: no text is a key, and a body that half of the rows have is one row of the other side
    hashed = F.struct(F.xxhash64(F.col(request), place), F.xxhash64(F.lit(1), place, F.col(request)), F.col(request).isNull(), place.isNull())
    once = df.select(hashed.alias(new["hash"]), F.col(request).alias(new["request"]), place.alias(new["index"])).dropDuplicates([new["hash"]])
    once = once.select(new["hash"], shown(F.col(new["request"]), F.col(new["index"])).alias(to))
    left = (df.drop(to) if to in df.columns and to not in (request, index) else df).withColumn(new["hash"], hashed)
    return left.join(once, new["hash"], "left").drop(new["hash"]).select(*[c for c in df.columns if c != to], to)


def digests(df: DataFrame, request: str = "request", index: str | None = None, options: Options = Options(), with_rules: bool = False, strict: bool = False) -> DataFrame:
    """``df`` with columns idx, q, sig, hash, notes, error, in place of columns of those names. ``strict`` fails the query on what is no request."""
    at = digest_names(df, "digest")["digest"]
    out = with_digest(df, request, index, options, at, with_rules)
    names = ["idx", "q", "sig", "hash", "notes", "error", *(["rules"] if with_rules else [])]
    out = out.select(*(c for c in df.columns if c.lower() not in names), *(F.col(f"{at}.{n}").alias(n) for n in names))
    if strict:
        out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")))
    return out


def register(spark: SparkSession, options: Options = Options(), name: str = "search_digest") -> None:
    """``search_digest(request, index)`` for SQL: struct<idx, q, sig, full, notes, error>; and ``search_digest_hash``."""
    shapes = Shapes(options, False, _fields(False))

    @F.arrow_udf(LINE)
    def read(requests: pa.Array, indices: pa.Array) -> pa.Array:
        return _batch(requests, indices, shapes)

    spark.udf.register(name, read)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_hash(line STRING) RETURNS STRING RETURN concat('{options.version}:', left(sha2(line, 256), {options.hash_length}))")
