"""Log records that carry a request: the request is replaced by its digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import digest_names, with_digest
from ..options import Options


def rewrite(records: DataFrame, request: str = "query", index: str = "index", options: Options = Options()) -> DataFrame:
    """``records`` with the JSON text in ``request`` as a JSON digest; what is no text (null) stays, what is no request becomes {error}.

    Other columns are untouched; without an index column the request's own is taken.
    """
    own = index if index in records.columns else None
    at = digest_names(records, "digest")["digest"]
    read = with_digest(records, request, own, options, at)
    d = F.col(at)
    shown = F.when(d["error"].isNotNull(), F.to_json(F.struct(d["error"].alias("error")))).otherwise(F.to_json(F.struct(d["idx"].alias("idx"), d["q"].alias("q"), d["sig"].alias("sig"), d["hash"].alias("hash"), d["notes"].alias("notes"))))
    return read.withColumn(request, F.when(F.col(request).isNotNull(), shown)).select(records.columns)


def as_line() -> Column:
    """A row as a line of a digest log: JSON without null fields."""
    return F.to_json(F.struct("*"), {"ignoreNullFields": "true"})


def log(searches: DataFrame, path: str) -> None:
    """Appends digests with their cost to a digest log of JSON lines."""
    searches.select(as_line().alias("value")).write.mode("append").text(path)
