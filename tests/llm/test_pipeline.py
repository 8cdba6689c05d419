"""The pipeline's stages one after another on a small table, and the query registry."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from shapeloom.llm import langid


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    base = "the house and the people that were there with them on the way to the town number {} of all with some words more and {} then"
    clean = [base.format(f"alpha{i} beta{i * 7} gamma{i * 3}", f"delta{i} eps{i * 5} zeta{i} eta{i * 2} theta{i}") for i in range(30)]
    clean[29] += " please write to anna@example.com"
    rows = [(i, t) for i, t in enumerate(clean)] + [(100, clean[3]), (101, clean[4] + " x"), (102, None), (103, ""), (104, "@@## $$%% " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    df.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(104, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, tables, tmp_path):
    docs, seen = spark.read.parquet(f"{tables}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_copies", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not seen["language_id"] & {102, 103, 104} and set(range(30)) <= seen["quality_rules"]
    assert seen["near_copies"] == seen["quality_rules"] - {100, 101}
    red = spark.read.parquet(str(tmp_path / "pii"))
    assert "<EMAIL>" in red.filter("doc_id = 29").first()["text"] and red.filter("n_chars <> length(text)").count() == 0
    assert seen["packing"] == seen["pii"]
    again = corpus_pipeline.run(spark, tables)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def test_copies_with_a_tenth_of_the_words_edited(spark, tmp_path):
    rng = random.Random(5)
    text = [f"w{rng.randrange(5000)}" for _ in range(300)]
    swapped = [f"new{i}" if i % 10 == 4 else w for i, w in enumerate(text)]
    dropped = [w for i, w in enumerate(text) if i % 12 != 4]
    other = [f"w{rng.randrange(5000)}" for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate([text, swapped, dropped, other])], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in entry.queries()["op5_ngram_jaccard_join"](spark, str(tmp_path)).collect()}
    assert [found[i]["class_id"] for i in range(4)] == [0, 0, 0, 3] and found[0]["links"] >= 2 and found[3]["links"] == 0 and all(r["copies"] == 1 for r in found.values())
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()} == {0, 3}


def test_one_query_an_operator():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def _written(spark, rows, labels, at):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "key1": F.lit(1), "llr": F.lit(2), "__set1": F.lit("x"), "slot": F.lit(3)})
    df.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return df


def test_awkward_tables(spark, tmp_path):
    """Null and repeated ids, rows that are equal, one id with unlike texts, columns with the names of inner ones, a very long text."""
    rng, known = random.Random(7), langid.SEEDS["en"].split()
    clean = [" ".join(rng.choice(known) for _ in range(60)) for _ in range(20)]
    rows = [*enumerate(clean), (None, clean[0]), (None, clean[1]), (3, clean[3]), (3, clean[3]), (4, " ".join(rng.choice(known) for _ in range(60))), (30, clean[5] + " and"), (31, " ".join(clean) * 40), (32, None), (33, "")]
    _written(spark, rows, [(i, 1, 0) for i in range(20)], tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            continue
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality_rules":
            before = [r["doc_id"] for r in docs.select("doc_id").collect()]
            assert before.count(3) == 3 and before.count(None) == 2 and {30, 31} <= set(before) and not {32, 33} & set(before)
            unlike = before.count(4)
    kept = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert sorted(x for x in kept if x is not None) == sorted([*range(20), *[4] * (unlike - 1), 31]) and kept.count(None) == 2
    assert {r["doc_id"] for r in out.collect()} == set(kept)


def test_an_empty_table(spark, tmp_path):
    _written(spark, [(0, "x")], [(0, 1, 0)], tmp_path / "one")
    empty = spark.read.parquet(f"{tmp_path}/one/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path / "one"))
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)
