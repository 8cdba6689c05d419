"""Quality rules: log-likelihood ratio of hashed n-grams between trusted text and the raw corpus.

Tokens are maximal runs of ASCII punctuation and maximal runs of any other characters but ASCII white space;
case counts. Unigrams and bigrams go to 65,536 buckets. Over all documents, and over all trusted ones, buckets
are counted; a document's score is the mean over its n-grams of log p_trusted - log p_raw with add-one smoothing,
rounded to four places. A document is kept if its score reaches the threshold. By default that is the
``quantile`` of all trusted documents' scores less ``margin``.

Defined cases: a null text, an empty text and one of white space alone have no n-grams and a null score, and are
rejected; very long texts are read whole; repeated rows count each time and score alike; scores at the threshold
are kept; an empty table gives an empty result, and without trusted documents every score is that of the raw
corpus against the uniform, with no threshold, so all with n-grams are kept; other columns aren't touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blob_rows, collect_blobs, discard, joined, lean, materialise, pieces, slots

BUCKETS = 1 << 16
#: Slots of the bitmap that spares documents without trusted key the way to the join.
SLOTS = 1 << 21
PRIME = (1 << 31) - 1
#: Powers that weigh the characters of a token by their place modulo 64.
POWERS = [pow(31, i, PRIME) for i in range(64)]
_PUNCT = np.zeros(0x110000, dtype=np.int8)
_PUNCT[list(map(ord, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))] = 1
_PUNCT[[9, 10, 12, 13, 32]] = 2  # white space


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each unigram, then of each bigram."""
    cp, starts = joined(texts)
    kind = _PUNCT[cp]
    begins = np.flatnonzero((kind != 2) & (np.concatenate(([2], kind[:-1])) != kind))
    if not len(begins):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = kind != 2
    token = np.cumsum(np.bincount(begins, minlength=len(cp))) - 1
    at = np.flatnonzero(inside)
    place = at - begins[token[at]]
    value = cp[at].astype(np.int64) * np.array(POWERS, dtype=np.int64)[place & 63]
    # sums below 2**63: a token of over 2**22 characters is reduced on the way
    first = np.searchsorted(at, begins)
    h = np.add.reduceat(value % PRIME, first) % PRIME
    doc = np.searchsorted(starts, begins, side="right") - 1
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    uni = (h * 1000003 + 17) % PRIME % BUCKETS
    bi = (h[pair] * 1000003 + h[pair + 1]) % PRIME % BUCKETS
    return np.concatenate([doc, doc[pair]]), np.concatenate([uni, bi])


def _slot(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """log p_trusted - log p_raw of every bucket, over all documents. ``trusted``: keys of the target's documents.

    One pass over the text, which isn't shuffled: of all documents one fixed array a task is sent. Documents whose hash slot
    holds a trusted key send their buckets (two bytes an n-gram), too; those meet the keys exactly, by merge join at any size.
    """
    kind = docs.schema[key].dataType
    good = trusted.select(F.col(key).cast(kind).alias("key")).dropna().distinct()
    marked = np.unpackbits(slots(good.select(_slot("key")), SLOTS)).astype(bool)
    both = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.when(F.col(key).isNotNull(), _slot(key)).otherwise(-1).alias("slot"))
    columns = ["part", "data", "key", "grams"]

    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for pdf in pieces(batches, "text"):
            doc, bucket = ngrams(pdf["text"].tolist())
            total += np.bincount(bucket, minlength=BUCKETS)
            slot = pdf["slot"].to_numpy(dtype=np.int64)
            maybe = np.flatnonzero((slot >= 0) & marked[slot])
            if len(maybe):
                order = np.argsort(doc, kind="stable")
                ends = np.cumsum(np.bincount(doc, minlength=len(pdf)))
                own = bucket[order].astype(np.uint16)
                grams = [own[(ends[i - 1] if i else 0) : ends[i]].tobytes() for i in maybe.tolist()]
                yield pd.DataFrame({"part": None, "data": None, "key": pdf["key"].to_numpy()[maybe], "grams": grams}, columns=columns)
        yield blob_rows(total).reindex(columns=columns).astype(object).where(lambda x: x.notna(), None)

    # written, for the text is to be read once: the counts, and the grams of what may be trusted
    once = materialise(both.mapInPandas(count, f"part int, data binary, key {kind.simpleString()}, grams binary"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for pdf in batches:
            for x in pdf["grams"]:
                total += np.bincount(np.frombuffer(x, dtype=np.uint16), minlength=BUCKETS)
        yield blob_rows(total)

    met = once.filter("grams is not null").select("key", "grams").join(good.hint("merge"), "key", "left_semi").select("grams")
    raw = collect_blobs(once.filter("part is not null").select("part", "data"), BUCKETS) + 1.0
    target = collect_blobs(met.mapInPandas(add, "part int, data binary"), BUCKETS) + 1.0
    discard(once)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    doc, bucket = ngrams(texts)
    n = np.bincount(doc, minlength=len(texts))
    with np.errstate(invalid="ignore"):
        return np.round(np.bincount(doc, weights=weights[bucket], minlength=len(texts)) / np.where(n, n, np.nan), 4)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, llr double): the score of every document."""

    @lean
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, "__text"):
            s = _scores(pdf["__text"].tolist(), weights)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "llr": pd.Series(s).astype(object).where(~np.isnan(s), None).to_numpy()})

    schema = T.StructType([docs.schema[key], T.StructField("llr", T.DoubleType())])
    return docs.select(F.col(key), F.col(text).alias("__text")).mapInPandas(work, schema)


def threshold(scores: DataFrame, trusted: DataFrame, key: str = "doc_id", quantile: float = 0.001, margin: float = 0.05) -> float:
    """The quantile of all trusted scores less the margin; -inf if there are none.

    Scores are rounded, so the distinct ones are few and fixed in number; only their counts reach the driver.
    """
    good = scores.join(trusted.select(key).dropna().distinct(), key, "left_semi").dropna()
    rows = sorted((r["s"], r["n"]) for r in good.groupBy(F.round(F.col("llr"), 2).alias("s")).agg(F.count("*").alias("n")).collect())
    if not rows:
        return float("-inf")
    upto = np.cumsum([n for _, n in rows])
    return round(float(rows[int(np.searchsorted(upto, quantile * upto[-1], side="right").clip(0, len(rows) - 1))][0]) - margin, 4)


def judged(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", quantile: float = 0.001, margin: float = 0.05) -> DataFrame:
    """(key, llr, keep) of every document. The scores are written once, for the threshold and the result."""
    scores = materialise(score(docs, ratios(docs, trusted, text, key), text, key))
    least = threshold(scores, trusted, key, quantile, margin)
    return scores.withColumn("keep", F.coalesce(F.col("llr") >= F.lit(least), F.lit(False)))


def accepted(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", quantile: float = 0.001, margin: float = 0.05) -> DataFrame:
    """The rows of ``docs``, unchanged, that reach the threshold; the text isn't shuffled, but scored where it lies."""
    weights = ratios(docs, trusted, text, key)
    least = threshold(score(docs, weights, text, key), trusted, key, quantile, margin)

    @lean
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, text):
            yield pdf[np.nan_to_num(_scores(pdf[text].tolist(), weights), nan=-np.inf) >= max(least, -1e300)]

    return docs.mapInPandas(work, docs.schema)
