"""The corpus operators as registered queries, with their production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, classifier, jaccard, langid, licenses, packing, pii, quality_rules, sharding


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, and whether they decode to it again."""
    coded = bpe.encode(_docs(spark, sf_dir).select("doc_id", "text"))
    back = bpe.decode(coded, to="restored")
    return back.select("doc_id", "n_tokens", "tokens", F.col("text").eqNullSafe(F.col("restored")).alias("exact"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_docs(spark, sf_dir).select("doc_id"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", "lang_id", "lang_share", "lang_words", "lang_spans")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_docs(spark, sf_dir), least=jaccard.NEAR)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return classifier.score(docs, classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")
    return quality_rules.judged(_docs(spark, sf_dir), trusted)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(_docs(spark, sf_dir), length="n_chars", count="n_entities")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours, among all rows, of the rows whose id 20 divides."""
    return ann.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), of=lambda i: i % 20 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_bpe": op2_bpe,
        "op3_sharding": op3_sharding,
        "op4_language_id": op4_language_id,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_license_scan": op7_license_scan,
        "op8_quality_rules": op8_quality_rules,
        "op9_pii": op9_pii,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "pipeline": pipeline,
    }


#: Classes and links of the n-gram join: sets of word bigrams, every two sets that share one, and the closure of links.
_CLASSES = """
WITH RECURSIVE worded AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
grams AS (SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS g FROM worded),
sets AS (SELECT g, min(doc_id) AS least, count(*) AS copies, row_number() OVER (ORDER BY min(r)) AS s, len(g) AS n FROM grams WHERE len(g) > 0 GROUP BY g),
entry AS (SELECT s, n, unnest(g) AS gram FROM sets),
pair AS (SELECT a.s AS x, b.s AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM entry a JOIN entry b ON a.gram = b.gram AND a.s < b.s GROUP BY ALL),
link AS (SELECT x, y FROM pair WHERE c::DOUBLE / (nx + ny - c) >= LEAST_ - 1e-12),
either AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(s, t) AS (SELECT s, s FROM sets UNION SELECT reach.s, either.y FROM reach JOIN either ON either.x = reach.t),
class AS (SELECT reach.s, min(sets.least) AS class_id FROM reach JOIN sets ON sets.s = reach.t GROUP BY reach.s),
degree AS (SELECT x AS s, count(*) AS links FROM either GROUP BY x)
SELECT grams.doc_id, class.class_id, coalesce(sets.copies, 0) AS copies, coalesce(degree.links, 0) AS links
FROM grams LEFT JOIN sets ON sets.g = grams.g LEFT JOIN class ON class.s = sets.s LEFT JOIN degree ON degree.s = sets.s""".replace("LEAST_", str(jaccard.NEAR))

#: Log-likelihood ratios: hashes by the same arithmetic, counts, the mean of the logarithms, the threshold by the trusted documents.
_RATIOS = """
WITH token AS (
  SELECT r, doc_id, list_transform(regexp_extract_all(text, '[!-/:-@\\[-`{-~]+|[^!-/:-@\\[-`{-~\\t\\n\\f\\r ]+'), lambda t:
    list_sum(list_transform(range(1, length(t) + 1), lambda i: unicode(substr(t, i, 1))::BIGINT * (POWERS_[((i - 1) % 64) + 1]) % PRIME_))::BIGINT % PRIME_) AS h
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
gram AS (
  SELECT r, doc_id, unnest(list_concat(list_transform(h, lambda x: (x * 1000003 + 17) % PRIME_ % 65536), list_transform(range(1, len(h)), lambda i: (h[i] * 1000003 + h[i + 1]) % PRIME_ % 65536))) AS b
  FROM token),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id IS NOT NULL),
bucket AS (
  SELECT b, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM good)) AS target FROM gram GROUP BY b),
whole AS (SELECT sum(raw) + 65536 AS raw, sum(target) + 65536 AS target FROM bucket),
weight AS (SELECT b, ln((bucket.target + 1) / whole.target::DOUBLE) - ln((bucket.raw + 1) / whole.raw::DOUBLE) AS v FROM bucket, whole),
scored AS (SELECT r, round(avg(v), 4) AS llr FROM gram JOIN weight USING (b) GROUP BY r),
judged AS (SELECT token.r, token.doc_id, scored.llr FROM token LEFT JOIN scored USING (r)),
trusted AS (SELECT round(llr::DECIMAL(18, 4), 2) AS s, count(*) AS n FROM judged WHERE doc_id IN (SELECT doc_id FROM good) AND llr IS NOT NULL GROUP BY 1),
upto AS (SELECT s, sum(n) OVER (ORDER BY s) AS u, sum(n) OVER () AS every FROM trusted),
least AS (SELECT coalesce((SELECT round(min(s)::DOUBLE - MARGIN_, 4) FROM upto WHERE u > QUANTILE_ * every), (SELECT round(max(s)::DOUBLE - MARGIN_, 4) FROM upto), '-inf'::DOUBLE) AS t)
SELECT doc_id, llr, coalesce(llr >= t, false) AS keep FROM judged, least""".replace("POWERS_", str(quality_rules.POWERS)).replace("PRIME_", str(quality_rules.PRIME)).replace("MARGIN_", "0.05").replace("QUANTILE_", "0.001")


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": sharding.oracle(), "op5_ngram_jaccard_join": _CLASSES, "op8_quality_rules": _RATIOS}
