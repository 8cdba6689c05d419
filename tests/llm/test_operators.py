"""The corpus operators against brute force, round trips and held-out accuracy, and each on awkward tables."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shapeloom.llm import ann, bpe, classifier, common, jaccard, langid, licenses, packing, pii, quality_rules, sharding

LONG = "the quick house and " * 8000
TEXTS = ["the cat sat on the mat and the dog", "", None, "   \n", "!!! ??", "the cat sat on the mat and the dog", LONG, "x" * 30000, "mail anna.b@example.com now", "Released under the MIT License.", "é\u0000ü 漢字 😀"]
#: Columns that have the names of added ones, and others.
CLASH = {c: 7 for c in "lang_id lang_share lang_spans shard tokens n_tokens restored llr keep bin_id piece start end length slot license containment quality toxic jaccard doc_a doc_b n_entities id key slot2 part data grams __x __h __key __tokens __set1 __set2 __rank class_id copies links".split()}


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in key and text, empty and very long texts, repeated rows and clashing columns."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", "s", 5), (None, TEXTS[0], None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in CLASH.items()})


def operators():
    """Each operator as a function of the documents."""
    trusted = lambda d: d.filter("doc_id < 3").select("doc_id")
    labels = lambda d: d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    return {
        "packing": lambda d: packing.pack(d, 64), "bpe": lambda d: bpe.decode(bpe.encode(d, far=20000), to="restored"), "sharding": sharding.assign,
        "langid": lambda d: langid.identify(d, langid.train(d)), "langid_kept": lambda d: langid.accepted(d, langid.train(d)),
        "jaccard": jaccard.join, "jaccard_kept": jaccard.representatives, "classifier": lambda d: classifier.score(d, classifier.train(d, labels(d), rounds=1)),
        "licenses": licenses.scan, "quality_rules": lambda d: quality_rules.judged(d, trusted(d)), "quality_kept": lambda d: quality_rules.accepted(d, trusted(d)),
        "pii": lambda d: pii.redact(d, length="n_chars", count="n_entities"),
    }


def same(a, b):
    """Equal, with NaN for null."""
    return (pd.isna(a) and pd.isna(b)) if not isinstance(a, (list, np.ndarray)) and (a is None or a != a) else a == b


@pytest.fixture(scope="module")
def done(edge):
    return {k: f(edge).toPandas() for k, f in operators().items()}


@pytest.mark.parametrize("name", operators())
def test_empty_table(spark, edge, name):
    assert operators()[name](edge.limit(0)).count() == 0


def test_rows_of_awkward_tables(done):
    n = len(TEXTS) + 2
    for name in ("bpe", "sharding", "langid", "classifier", "quality_rules", "pii"):
        assert len(done[name]) == n, name
    p = done["bpe"]
    assert [same(a, b) for a, b in zip(p["text"], p["restored"])] == [True] * n and pd.isna(p.set_index("doc_id").loc[2, "n_tokens"]) and p.set_index("doc_id").loc[1, "n_tokens"] == 0
    lang = done["langid"].drop_duplicates("doc_id").set_index("doc_id")
    assert lang.loc[0, "lang_id"] == "en" and lang.loc[1, "lang_id"] == lang.loc[2, "lang_id"] == "und" and lang.loc[2, "lang_words"] == 0
    assert sorted(done["langid_kept"]["doc_id"].dropna().unique())[:1] == [0] and 2 not in set(done["langid_kept"]["doc_id"])
    scores = done["classifier"].drop_duplicates("doc_id").set_index("doc_id")
    assert pd.isna(scores.loc[2, "quality"]) and not scores.loc[1, "keep"]
    q = done["quality_rules"].drop_duplicates("doc_id").set_index("doc_id")
    assert pd.isna(q.loc[1, "llr"]) and not q.loc[2, "keep"] and len(done["quality_kept"]) <= n - 3
    assert done["pii"].set_index("doc_id").loc[8, "text"] == "mail <EMAIL> now" and done["pii"].set_index("doc_id").loc[8, "n_entities"] == 1
    assert done["licenses"].to_dict("records") == [{"doc_id": 9, "license": "mit-notice", "start": 0, "end": 30, "containment": 1.0}]
    assert set(map(tuple, done["jaccard"][["doc_a", "doc_b"]].to_numpy().tolist())) == {(0, 5)}
    kept = done["jaccard_kept"]
    assert 5 not in set(kept["doc_id"]) and (kept["doc_id"] == 0).sum() == 1 and kept["doc_id"].isna().sum() == 1 and 2 in set(kept["doc_id"])
    packed = done["packing"]
    assert packed[packed["length"] == 0]["bin_id"].isna().all() and packed[packed["doc_id"] == 6]["length"].sum() == 32000 and packed["doc_id"].isna().sum() == 1


# packing

def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        b = min(fit, key=lambda x: x[0]) if fit else None
        if b is None:
            b = [capacity]
            bins.append(b)
        b[0] -= n
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_places_every_piece_and_no_worse_than_its_bound(lengths):
    lines = packing.plan(dict(Counter(lengths)), 40)
    placed = Counter(x for group, n in lines for x in group for _ in range(n))
    assert placed == Counter(lengths) and all(sum(g) <= 40 for g, _ in lines)
    assert sum(n for _, n in lines) <= len(best_fit(lengths, 40)) + 2


def test_plan_takes_exact_complements_under_their_counts():
    assert sorted(packing.plan({6: 2, 4: 1, 3: 1, 1: 1}, 10)) == [((6, 3, 1), 1), ((6, 4), 1)]
    assert packing.plan({5: 1, 2: 2, 1: 1}, 10) == [((5, 2, 2, 1), 1)]


def test_packed_table_is_the_plan(spark):
    rng = random.Random(1)
    lengths = [rng.choice([0, 1, 3, 7, 20, 33, 64, 65, 200]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    p = packing.pack(df, 64, length="n", buckets=3).toPandas()
    full = p[p["length"] > 0]
    assert full.groupby("bin_id")["length"].sum().max() <= 64 and not full.duplicated(["bin_id", "slot"]).any() and not full.duplicated(["doc_id", "piece"]).any()
    assert p.groupby("doc_id")["length"].sum().to_dict() == dict(enumerate(lengths))
    counts = Counter(full["length"].tolist())
    assert full["bin_id"].nunique() == sum(n for _, n in packing.plan(counts, 64))


# byte-pair encoding

@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeé ththe\n'sll012漢!", max_size=300), st.sampled_from([2, 3, 5, 16, 64]))
def test_tree_equals_the_library(text, leaf):
    own = bpe.codec(leaf=leaf)
    want = own.inner.encode_ordinary(text)
    assert own.encode(text).tolist() == want
    data = text.encode()
    assert own.piece(data) == (own.inner._encode_single_piece(data) if data else [])


def test_far_parts_join_and_decode(spark):
    rng = random.Random(4)
    run = lambda n: "".join(rng.choice("thaeionsr") for _ in range(n))
    texts = [run(5000), run(3000) + "   \n\n  " + run(2500) + " a b " + " " * 3000 + "x", "wörter " * 900 + run(1700), "short", "é" * 2500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = bpe.codec()
    for r in bpe.decode(bpe.encode(df, far=1024), to="back").collect():
        assert r["tokens"] == own.inner.encode_ordinary(r["text"]) and r["back"] == r["text"] and r["n_tokens"] == len(r["tokens"])


def test_blank_lines_before_a_far_run(spark):
    rng = random.Random(6)
    run = lambda n: "".join(rng.choice("thaeionsr") for _ in range(n))
    texts = ["words " * 150 + f"ab{blank}" + run(2000) + " and more" for blank in ("\n\n", "\n", "\n\n\n", " \n \n", "\n\n\t")] + ["\n\n" + run(3000)]
    own = bpe.codec()
    for r in bpe.decode(bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), far=1024), to="back").collect():
        assert r["tokens"] == own.inner.encode_ordinary(r["text"]) and r["back"] == r["text"]


def test_decoding_what_is_no_token(spark):
    df = spark.createDataFrame([(0, [1, None]), (1, [10**6]), (2, []), (3, None), (4, [255])], "i int, tokens array<int>")
    assert [r["text"] for r in bpe.decode(df).orderBy("i").collect()][:4] == [None, None, "", None]


# sharding

def test_shards_have_their_weights_and_few_records_move(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    shards = {i: 1.0 + (i == 3) for i in range(5)}
    both = sharding.assign(sharding.assign(df, shards, to="a"), {**shards, 9: 1.0}, to="b")
    n = Counter({r["a"]: r["n"] for r in both.groupBy("a").agg(F.count("*").alias("n")).collect()})
    assert all(abs(n[i] / 20000 - w / 6) < 0.02 for i, w in shards.items())
    moved = both.filter("a <> b")
    assert moved.filter("b <> 9").count() == 0 and abs(moved.count() / 20000 - 1 / 7) < 0.02
    with pytest.raises(ValueError):
        sharding.assign(df, {0: 0.0})


def test_shards_equal_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    df = spark.createDataFrame([(i,) for i in range(500)] + [(None,), (7,)], "doc_id long")
    df.write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(db.execute(sharding.oracle()).fetchall(), key=str) == sorted(map(tuple, sharding.assign(df).collect()), key=str)


# language

def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for k in (2, 3):
        for step in (np.full((k, k), -1.5) + 1.5 * np.eye(k), rng.normal(size=(k, k))):
            e, length = rng.normal(size=(9, k)), np.array([4, 0, 5])
            got, at = common.viterbi(e, length, step), 0
            value = lambda path, rows: sum(e[r, s] for r, s in zip(rows, path)) + sum(step[a, b] for a, b in zip(path, path[1:]))
            for n in length:
                rows = range(at, at + n)
                assert not n or math.isclose(value(got[at : at + n], rows), max(value(p, rows) for p in itertools.product(range(k), repeat=n)), rel_tol=1e-6)
                at += n


def test_spans_of_mixed_text(spark):
    model = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    text = "the house and the people that were there with them und der mann ist nicht mit ihnen auf dem weg durch die stadt Привет мир"
    found = [s for _, _, s in model.label([text])[0][3]]
    assert found == ["en", "de", "ru"]


def test_models_learn_from_whole_texts(spark):
    df = spark.createDataFrame([(0, "the house " * 400 + "qvxqvx " * 2000, "en")], "doc_id long, text string, lang string")
    assert langid.train(df).label(["qvxqvx qvxqvx qvxqvx"])[0][:2] == ("en", 1.0)


def test_mixed_texts_are_accepted_by_all_known_words(spark):
    model = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    some = lambda name, n: " ".join((langid.SEEDS[name].split() * 2)[:n])
    odd = lambda n: " ".join(["ሰላም"] * n)
    texts = [f"{some('en', 40)} {some('de', 35)} {some('fr', 25)}", f"{some('en', 48)} {some('fr', 48)} {odd(4)}", f"{some('en', 20)} {some('de', 20)} {odd(60)}", "", None, "123 !!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [share < 0.5 for _, share, _, _ in model.label(texts[:2])] == [True, True]
    assert {r["doc_id"] for r in langid.accepted(df, model).collect()} == {0, 1}


# n-gram Jaccard

def test_jaccard_is_exact(spark):
    rng = random.Random(3)
    words, texts = [f"w{i}" for i in range(60)], []
    for i in range(260):
        if i % 3 == 0:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 6, 10, 20, 40, 90, 300]))))
        else:
            w = rng.choice(texts).split()
            for _ in range(max(1, len(w) // rng.choice([8, 12, 20, 60]))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))

    def grams(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))}

    sets = [grams(t) for t in texts]
    want = {(i, j): len(a & b) / len(a | b) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if len(a & b) / len(a | b) >= 0.75 - 1e-12}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in jaccard.join(df).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want) and len(want) > 20
    group = list(range(len(texts)))
    for i, j in sorted(want):
        a, b = group[i], group[j]
        group = [min(a, b) if g in (a, b) else g for g in group]
    assert {r["doc_id"] for r in jaccard.representatives(df).collect()} == {i for i, g in enumerate(group) if i == g}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 400), min_size=1, max_size=80), min_size=2, max_size=2))
def test_sketches_never_tell_more_than_the_sets_differ(sets):
    gram = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    size = np.array([len(g) for g in gram])
    bits = np.frombuffer(b"".join(jaccard.sketches(np.concatenate(gram), size)), dtype=np.uint8)
    both = jaccard._Sketches([(np.array([1, 2]), size, bits)], 1)
    assert both.parted(np.array([0]), np.array([1]))[0] <= len(sets[0] ^ sets[1])


# classifier

def test_gradients(spark):
    net = classifier.Network(1)
    bucket, passage, size, n = classifier.bags(["one two three. four five", "six " * 70, "seven!"])
    y, w = np.array([[1.0, 0], [0, 1], [1, np.nan]]), np.ones((3, 2))

    def loss():
        h = net.encode(bucket, passage, size)[3]
        p = [1 / (1 + np.exp(-x[4].astype(np.float64))) for x in net.attend(h, n)]
        return -sum(np.nansum(np.where(np.isnan(y[:, k]), np.nan, y[:, k] * np.log(p[k]) + (1 - y[:, k]) * np.log(1 - p[k]))) for k in range(2)) / 3

    grad = net.step(bucket, passage, size, n, y, w)
    rng = np.random.default_rng(0)
    for name in net.p:
        flat, g = net.p[name].reshape(-1), grad[name].reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(g) >= np.quantile(np.abs(g), 0.9)), 3):
            old, eps = flat[i], 1e-2
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert math.isclose((up - down) / (2 * eps), g[i], rel_tol=0.05, abs_tol=2e-4), name


def test_held_out_accuracy():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "len", "su", "ka"]) for _ in range(rng.randint(1, 3)))

    def row():
        kind, words = rng.random(), [word() for _ in range(rng.randint(30, 300))]
        if kind < 0.3:
            words[rng.randrange(len(words))] = rng.choice(["vile", "nasty"])
            return " ".join(words), (1.0, 1.0)
        return (" ".join(w + "###" for w in words), (0.0, 0.0)) if kind < 0.5 else (" ".join(words), (1.0, 0.0))

    train, test = [row() for _ in range(700)], [row() for _ in range(300)]
    net = classifier.fit([t for t, _ in train], np.array([y for _, y in train]), rounds=8)
    hit = (net.scores([t for t, _ in test]) >= 0.5) == np.array([y for _, y in test]).astype(bool)
    assert hit[:, 0].mean() > 0.97 and hit[:, 1].mean() > 0.9


# licenses

def test_license_scan_equals_brute_force():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = []
    for _ in range(120):
        parts = [filler(rng.randint(0, 60))]
        for name in rng.sample(sorted(licenses.TEMPLATES), rng.randint(0, 2)):
            w = licenses.TEMPLATES[name].split()
            for _ in range(rng.choice([0, 0, len(w) // 40, len(w) // 8])):
                w[rng.randrange(len(w))] = "zz"
            parts += [" ".join(w), filler(rng.randint(5, 60))]
        texts.append(" ".join(parts))
    index = licenses.Index(licenses.TEMPLATES)
    got = {(d, name) for d, name, *_ in index.matches(texts)}
    gram = lambda t: [tuple(w[i : i + 3]) for w in [re.findall(r"[^\W_]+", t.lower())] for i in range(len(w) - 2)]
    sure, never = set(), set()
    for d, t in enumerate(texts):
        own = gram(t)
        for name, template in licenses.TEMPLATES.items():
            want = set(gram(template))
            n = len(gram(template))
            best = max((len(want & set(own[i : i + n])) for i in range(max(1, len(own) - n + 1))), default=0) / len(want)
            wide = max((len(want & set(own[i : i + 2 * n])) for i in range(len(own))), default=0) / len(want)
            (sure if best >= 0.8 else never if wide < 0.8 else set()).add((d, name))
    assert sure <= got and not never & got and len(sure) > 60


def test_two_copies_are_two_rows():
    notice = licenses.TEMPLATES["mit-notice"]
    assert [x[2:4] for x in licenses.Index(licenses.TEMPLATES).matches([notice + " and " * 40 + notice])] == [(0, 30), (231, 261)]
    assert licenses.bands_for(1.0, 2, 0.01) == 1 and 1 - (1 - 0.5**2) ** licenses.bands_for(0.5, 2, 1e-3) >= 0.999


# quality rules

def test_scores_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "bc.", "d!", "Ef"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 40, 3)] + [(999,)], "doc_id int")

    def grams(t):
        token = re.findall(r"[!-/:-@\[-`{-~]+|[^!-/:-@\[-`{-~\t\n\f\r ]+", t)
        h = [sum(ord(c) * quality_rules.POWERS[i & 63] % quality_rules.PRIME for i, c in enumerate(x)) % quality_rules.PRIME for x in token]
        return [(x * 1000003 + 17) % quality_rules.PRIME % quality_rules.BUCKETS for x in h] + [(x * 1000003 + y) % quality_rules.PRIME % quality_rules.BUCKETS for x, y in zip(h, h[1:])]

    raw, good = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        good.update(grams(t) if i % 3 == 0 else [])
    a, b = sum(good.values()) + quality_rules.BUCKETS, sum(raw.values()) + quality_rules.BUCKETS
    want = [sum(math.log((good[g] + 1) / a) - math.log((raw[g] + 1) / b) for g in grams(t)) / len(grams(t)) for t in texts]
    got = {r["doc_id"]: r for r in quality_rules.judged(df, trusted).collect()}
    assert all(abs(got[i]["llr"] - w) < 1e-4 for i, w in enumerate(want))
    assert {r["doc_id"] for r in quality_rules.accepted(df, trusted).collect()} == {i for i in got if got[i]["keep"]}


# personal data

def test_entities_of_unseen_rows():
    rows, field = pii.labelled(2, seed=99), pii.default_field()
    found = field.entities([t for t, _ in rows])
    right = sum(len(set(a) & set(b)) for a, (_, b) in zip(found, rows))
    assert right / sum(len(b) for _, b in rows) > 0.9 and right / sum(map(len, found)) > 0.9


def test_skipping_plain_tokens_changes_nothing():
    field = pii.default_field()
    assert field.reach is not None
    texts = [t for t, _ in pii.labelled(1, seed=5)] + ["plain words " * 40 + "a@b.example.com " + "plain words " * 40]
    fast = field.entities(texts)
    reach, field.reach = field.reach, None
    try:
        assert field.entities(texts) == fast
    finally:
        field.reach = reach


# nearest neighbours

@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [1.0] * 3), (2004, [float("nan")] * 24), (2005, [None] * 24), (None, [1.0] * 24)]
    return x, spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "rank": F.lit(2), "v": F.lit(3)})


def test_recall_against_brute_force(vectors):
    x, df = vectors
    got = defaultdict(list)
    for r in ann.neighbours(df, 10, shard_rows=600).orderBy("vec_id", "rank").collect():
        got[r["vec_id"]].append((r["neighbour"], r["distance"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    true = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), np.round(d, 5)), axis=1)[:, :10]
    assert set(got) == set(range(1500)) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({n for n, _ in got[i]} & set(true[i].tolist())) / 10 for i in range(1500)]) > 0.9
    assert [n for n, _ in got[120]] == list(range(100, 110)) and [n for n, _ in got[100]] == list(range(101, 111))
    assert all(a[1] <= b[1] for v in got.values() for a, b in zip(v, v[1:]))


def test_a_set_of_queries_against_all_rows(vectors):
    _, df = vectors
    every = {(r["vec_id"], r["rank"]): r["neighbour"] for r in ann.neighbours(df, 5, shard_rows=600).collect()}
    some = {(r["vec_id"], r["rank"]): r["neighbour"] for r in ann.neighbours(df, 5, shard_rows=600, of=lambda i: i % 20 == 0).collect()}
    assert some == {k: v for k, v in every.items() if k[0] % 20 == 0} and len(some) == 75 * 5


def test_few_vectors(spark, vectors):
    _, df = vectors
    assert ann.neighbours(df.limit(0)).count() == 0 and ann.neighbours(df.filter("vec_id < 1")).count() == 0
    assert sorted(map(tuple, ann.neighbours(df.filter("vec_id < 3")).select("vec_id", "rank").collect())) == [(i, k) for i in range(3) for k in (1, 2)]
    copies = ann.neighbours(df.filter("vec_id = 5").union(df.filter("vec_id = 5")).union(df.filter("vec_id = 6")))
    assert {(r["vec_id"], r["neighbour"]) for r in copies.collect()} == {(5, 6), (6, 5)}


def test_a_repeated_key_counts_once(spark, vectors):
    x, _ = vectors
    rows = [(7, x[0].tolist())] * 30 + [(i, x[0].tolist()) for i in range(8, 12)] + [(i, x[i].tolist()) for i in range(200, 230)]
    got = defaultdict(list)
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("vec_id", "rank").collect():
        got[r["vec_id"]].append(r["neighbour"])
    assert all(len(v) == len(set(v)) == 10 and k not in v for k, v in got.items()) and len(got) == 35
    assert got[7][:4] == [8, 9, 10, 11] and got[8][:4] == [7, 9, 10, 11]
