"""Operators against plain loops that share no code with them."""

import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shapeloom.llm import classifier, jaccard, langid, packing, pii


# n-gram join

def bigrams(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return frozenset(tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))) if w else frozenset()


def naive_classes(rows, least):
    """{row: (class, copies, links)} of (id, text) rows."""
    sets = [bigrams(t) for _, t in rows]
    one = list(dict.fromkeys(s for s in sets if s))
    near = {s: {o for o in one if o != s and len(s & o) / len(s | o) >= least - 1e-12} for s in one}
    name = {}
    for s in one:
        if s in name:
            continue
        todo, group = [s], {s}
        while todo:
            for o in near[todo.pop()] - group:
                group.add(o)
                todo.append(o)
        ids = [i for (i, _), x in zip(rows, sets) if x in group and i is not None]
        for o in group:
            name[o] = (min(ids, default=None), group)
    return [(i, name[s][0] if s else None, sets.count(s) if s else 0, len(near[s]) if s else 0) for (i, _), s in zip(rows, sets)]


def copies(rng, words, groups, edits):
    out = []
    for size in groups:
        base = [rng.choice(words) for _ in range(rng.choice([12, 40, 120]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [3, 2000])
def test_classes_equal_plain_loops(spark, block):
    """Groups of up to 40 near copies, in one block and in many; ids that are null, repeated or shared by unlike texts."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = copies(rng, words, [40, 25, 9, 4, 3, 2, 2, 1, 1, 1], 6) + ["", None, "one", "one", "ONE!", "two words", " ".join(words)]
    rows = [*enumerate(texts), (None, texts[0]), (None, "none like it " * 5), (5, "quite another text for the id five"), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.classes(df, least=0.6, block=block).select("doc_id", "class_id", "copies", "links").collect()]
    assert sorted(got, key=str) == sorted(naive_classes(rows, 0.6), key=str) and max(r[3] for r in got) >= 15


def test_pairs_within_and_between_blocks(spark):
    rng = random.Random(9)
    texts = copies(rng, [f"w{i}" for i in range(300)], [30, 12, 5, 1, 1], 5)
    want = {(i, j): len(bigrams(a) & bigrams(b)) / len(bigrams(a) | bigrams(b)) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in jaccard.join(df, least=0.6, block=4).collect()}
    assert got.keys() == {k for k, v in want.items() if v >= 0.6} and all(math.isclose(v, want[k]) for k, v in got.items())


def test_unlike_texts_of_one_id_stay(spark):
    a, b = "the first text that is here twice or more", "quite another one of which there is no copy"
    rows = [(3, a, 1), (7, a, 2), (7, b, 3), (8, b + " at all", 4), (9, a, 5), (9, a, 5), (None, a, 6), (10, "", 7), (10, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __set1 int")
    kept = jaccard.representatives(df, least=0.6)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, a, 1), (7, b, 3), (None, a, 6), (10, "", 7), (10, "", 7)], key=str)
    only = spark.createDataFrame([(1, a, 2), (1, a, 1), (1, a, 1), (2, b, 1)], "doc_id long, text string, n int")
    assert sorted(r["doc_id"] for r in jaccard.representatives(only).collect()) == [1, 2]


def test_neighbourhoods_meet_what_differs_enough_to_be_told():
    """Signatures of two sets meet if the sets are similar, whatever the frequencies say is cheap."""
    rng = np.random.default_rng(4)
    bands = jaccard.Bands(0.6, 1.67, 0.7)
    logdf = np.log(rng.random(1 << jaccard.DF_BITS)).astype(np.float32)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        keep = x[rng.random(len(x)) < 0.85]
        y = np.unique(np.concatenate([keep, rng.integers(0, 1 << 48, int(rng.integers(0, 1 + n // 6))).astype(np.uint64)]))
        if not len(y):
            continue
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        sig, doc, flag, _ = jaccard.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]), bands, logdf)
        entries = ((sig & np.uint64((1 << 28) - 1)) << np.uint64(28)) | (doc.astype(np.uint64) << np.uint64(4)) | flag
        met = [p for p in jaccard.meetings(entries, np.zeros(2, dtype=np.int64), np.array([len(x), len(y)]), 0.6)]
        if j >= 0.6:
            assert any(len(p) for p in met)


def stored(path, gram, size, key, bands):
    """A folder with the sketches of sets, as tasks of the join read them."""
    path.mkdir()
    table = pa.table({"band": pa.array(bands.of(size), pa.int32()), "key1": key, "size": size, "sketch": pa.array(jaccard.sketches(gram, size), pa.binary())})
    for k in range(2):
        pq.write_table(table.slice(k * len(size) // 2, (k + 1) * len(size) // 2 - k * len(size) // 2), path / f"{k}.parquet")
    return jaccard._Stored(f"file://{path}")


@pytest.mark.parametrize("limit", [1 << 30, 30_000, 5_000, 300])
def test_pairs_are_dropped_where_they_meet(tmp_path, limit):
    """Whatever is in memory at a time, the same pairs survive, each block's own and those between blocks; a set whose name isn't one set's is near all."""
    rng = np.random.default_rng(6)
    bands = jaccard.Bands(0.6)
    base = [np.sort(rng.choice(3000, int(n), replace=False)).astype(np.uint64) for n in rng.integers(5, 200, 60)]
    sets = [np.unique(np.where(rng.random(len(b)) < 0.1, rng.integers(0, 3000, len(b)), b).astype(np.uint64)) for b in base for _ in range(4)]
    gram, size = np.concatenate(sets), np.array([len(x) for x in sets])
    key = np.sort(rng.integers(-(1 << 62), 1 << 62, len(sets)))
    sig, doc, flag, _ = jaccard.signatures(gram, size, bands, np.log(rng.random(1 << jaccard.DF_BITS)).astype(np.float32))
    entries = ((sig & np.uint64(0xFFF)) << np.uint64(28)) | (doc.astype(np.uint64) << np.uint64(4)) | flag  # so few signatures that much meets by chance
    label = np.zeros(len(sets), dtype=np.int64)
    met = {p for x in jaccard.meetings(entries, label, size, 0.6) for p in x.tolist()}
    bits = np.frombuffer(b"".join(jaccard.sketches(gram, size)), dtype=np.uint8)
    pair = np.array(sorted(met))
    near = jaccard._Sketches([(key, size, bits)], 1).parted(pair >> 32, pair & 0xFFFFFFFF) <= bands.differ(size[pair >> 32], size[pair & 0xFFFFFFFF])
    got = [p for x in jaccard._survivors([entries], key, label, size, bands, stored(tmp_path / "all", gram, size, key, bands), limit) for p in x.tolist()]
    assert set(got) == set(pair[near].tolist()) and 100 < len(set(got)) < len(met) / 4
    of = np.repeat(np.arange(len(size)), size)
    lack = stored(tmp_path / "lack", gram[of != 7], np.delete(size, 7), np.delete(key, 7), bands)
    got = {p for x in jaccard._survivors([entries], key, label, size, bands, lack, limit) for p in x.tolist()}
    assert got == set(pair[near].tolist()) | {p for p in met if 7 in (p >> 32, p & 0xFFFFFFFF)}


def test_pairs_that_meet_take_little_more_time_than_a_sort():
    """What meets grows with the square of the documents: a pair has to be cheap."""
    rng = np.random.default_rng(8)
    n, docs = 3000, 40_000
    doc = rng.choice(docs, n, replace=False).astype(np.uint64)
    entries = (np.uint64(5) << np.uint64(28)) | (doc << np.uint64(4)) | np.uint64(jaccard.WHOLE | jaccard.ASK_WHOLE)
    label, size = np.zeros(docs, dtype=np.int64), np.full(docs, 100)

    def least(work):
        began = []
        for _ in range(3):
            at = time.perf_counter()
            got = work()
            began.append(time.perf_counter() - at)
        return min(began), got

    took, got = least(lambda: list(jaccard.meetings(entries, label, size, 0.6)))
    every = np.unique(np.concatenate(got))
    assert all((x[1:] > x[:-1]).all() for x in got) and len(every) == n * (n - 1) // 2
    assert np.isin(every >> 32, doc).all() and (every >> 32 < every & 0xFFFFFFFF).all()
    some = rng.integers(0, 1 << 62, n * n)
    sort, _ = least(lambda: np.sort(some))
    assert took < 12 * sort


@pytest.mark.parametrize("wide, short", [(2048, 2048), (512, 256), (64, 8), (8, 8), (8, 4), (64, 2)])
def test_sketches_fold_to_those_of_fewer_buckets(wide, short):
    rng = np.random.default_rng(9)
    bits = rng.integers(0, 256, (50, wide), dtype=np.uint8)
    kept = jaccard._Sketches([], 1)
    kept.row, kept.rows = np.arange(50), {wide: bits.view(np.uint64)}
    of = rng.integers(0, 50, 70)
    want = [[int(np.bitwise_xor.reduce(bits[x, k::short])) for k in range(short)] for x in of]
    assert kept._folded(of, wide, short).view(np.uint8).tolist() == want


def test_what_meets_by_chance_is_not_sent(spark, monkeypatch):
    """Unlike texts of few words, many of which meet: the join's next step gets pairs to verify, and few."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(300)] + copies(rng, words, [3, 2, 2], 4)
    sent, near = [], jaccard.Join._near
    monkeypatch.setattr(jaccard.Join, "_near", lambda self, met: (sent.append((met.columns, met.count())), near(self, met))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_a"], r["doc_b"]) for r in jaccard.join(df, least=0.6).collect()}
    assert got == {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if len(bigrams(a) & bigrams(b)) / len(bigrams(a) | bigrams(b)) >= 0.6}
    assert sent[0][0] == ["a", "b"] and sent[0][1] < 2 * len(texts)


# language

def test_labels_equal_all_paths():
    model = langid.Model(np.vstack([np.log(np.random.default_rng(1).dirichlet(np.full(4, 0.05), 1 << langid.BITS) + 1e-4).T, np.full((1, 1 << langid.BITS), -6.0)]).T, ["de", "en", "es", "fr"], 3.0)
    texts = ["das the el les", "Haus МИР house", "", None, "12 ab", "ηλιος sun mar ሰላም b"]

    def gram(prev, x, after):
        mask = (1 << 64) - 1
        h = (prev * 0x9E3779B97F4A7C15 & mask) ^ (x * 0xC2B2AE3D27D4EB4F & mask) ^ (after * 0x165667B19E3779F9 & mask)
        return ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> (64 - langid.BITS)

    def score(word, state):
        name = model.labels[state]
        first = ord(word[0])
        script = next((n for lo, hi, n in langid.SCRIPTS if lo <= first <= hi), None)
        latin = any(lo <= first <= hi for lo, hi in langid.LATIN)
        low = [0, *(ord(c.lower()) for c in word), 0]
        total = lambda k: sum(float(model.weights[gram(*low[i - 1 : i + 2]), k]) for i in range(1, len(low) - 1))
        if name == "und":
            return 0.0 if not latin and script is None else total(-1)
        return total(state) if latin and name in model.latin else 0.0 if script == name else -1e4

    for text, (label, share, n, spans) in zip(texts, model.label(texts)):
        words = [w for w in re.findall(r"[^\W\d_]+", text or "")]
        assert n == len(words)
        if not words:
            assert (label, share, spans) == ("und", 0.0, [])
            continue
        states = range(len(model.labels))
        can = [[s for s in states if score(w, s) > -1e3] for w in words]
        value = lambda p: sum(score(w, s) for w, s in zip(words, p)) - model.penalty * sum(a != b for a, b in zip(p, p[1:]))
        best = max(value(p) for p in itertools.product(*can))
        got = [model.labels.index(s) for a, b, s in spans for _ in re.findall(r"[^\W\d_]+", text[a:b])]
        assert math.isclose(value(got), best, abs_tol=1e-3)
        most = Counter(got).most_common()
        assert math.isclose(share, most[0][1] / n, abs_tol=1e-6) and got.count(model.labels.index(label)) == most[0][1]


# classifier

def test_scores_equal_plain_loops():
    net = classifier.Network(3)
    texts = ["one Two three! four " * 40, "a", "", None, "LOUD loud loud, " * 30 + "extraordinarily"]
    sig = lambda x: 1 / (1 + math.exp(-x))
    got = net.scores(texts)
    for text, row in zip(texts, got):
        bucket, passage, size, n = classifier.bags([text])
        if not n[0]:
            assert np.isnan(row).all()
            continue
        encoded = []
        for p in range(int(n[0])):
            v = [sum(float(net.p["E"][b, d]) for b, q in zip(bucket, passage) if q == p) / math.sqrt(size[p]) for d in range(classifier.DIM)]
            encoded.append([math.tanh(sum(x * float(net.p["A"][d, h]) for d, x in enumerate(v)) + float(net.p["a"][h])) for h in range(classifier.HIDDEN)])
        assert sum(size) == len(re.findall(r"""[!-/:-@\[-`{-~]+|[^!-/:-@\[-`{-~\s]+""", text)) and all(s == classifier.PASSAGE for s in size[:-1])
        for k in range(classifier.HEADS):
            dot = lambda name, h, g: sum(x * float(net.p[name][k, i, g]) for i, x in enumerate(h))  # noqa: E731, B023
            e = [sum(float(net.p["w"][k, g]) * math.tanh(dot("V", h, g)) * sig(dot("U", h, g)) for g in range(classifier.GATE)) for h in encoded]
            whole = sum(map(math.exp, e))
            z = [sum(math.exp(a) / whole * h[i] for a, h in zip(e, encoded)) for i in range(classifier.HIDDEN)]
            assert math.isclose(row[k], sig(sum(x * float(net.p["S"][k, i]) for i, x in enumerate(z)) + float(net.p["s"][k])), abs_tol=2e-5)


def test_long_labelled_documents_are_learned_from(spark):
    """What tells the two kinds apart stands at the end of texts of 100,000 characters."""
    rng = random.Random(2)
    filler = " ".join(rng.choice(["ta", "ri", "mo", "len"]) for _ in range(30_000))
    rows = [(i, filler[: 100_000 - i] + (" vile" if i % 2 else " fair") * 300) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(24)], "doc_id long, quality int, toxic int")
    net = classifier.train(docs, labels, rounds=4)
    p = net.scores(["vile " * 40, "fair " * 40])
    assert p[0, 0] < 0.5 < p[1, 0] and not net.used.all()


# personal data

def test_entities_equal_the_best_of_all_paths():
    field, texts = pii.default_field(), ["mail a.b@example.com", "call +1 415 555 0100 now", "plain words", "", None, "key 10.0.0.1 x"]
    k = len(pii.LABELS)
    for text, found in zip(texts, field.entities(texts)):
        words = list(re.finditer(r"\S+", text or ""))
        if not words:
            assert found == []
            continue
        cp = np.frombuffer((text + "\n").encode("utf-32-le"), dtype=np.uint32)
        begin, end = np.array([m.start() for m in words]), np.array([m.end() for m in words])
        own, marked = pii.shapes(cp, begin, end), pii.special(cp, begin, end)
        zero = np.zeros(pii.N_OWN)
        side = lambda i: own[i] if 0 <= i < len(words) and marked[i] else zero
        score = [np.concatenate([own[i], side(i - 1), side(i + 1)]) @ field.weights for i in range(len(words))]
        value = lambda p: sum(score[i][s] for i, s in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(k), repeat=len(words)), key=value) if k ** len(words) < 300_000 else None
        if best is None:
            continue
        kinds = [pii.LABELS[s] for s, _ in itertools.groupby(best) if s]
        assert [x for _, _, x in found] == kinds


# packing

def exact_complements(counts, capacity):
    """Lines of the exact fillings that single, pair and triple sums allow, longest first, by trying every one; what is left."""
    left, lines = dict(counts), []
    for a in sorted(counts, reverse=True):
        for size in (0, 1, 2, 3):
            for rest in sorted(itertools.combinations_with_replacement(sorted(counts, reverse=True), size), reverse=True):
                while sum(rest) == capacity - a and all(n <= a for n in rest) and all(left.get(n, 0) >= c for n, c in Counter((a, *rest)).items()):
                    for n in (a, *rest):
                        left[n] -= 1
                    lines.append((a, *rest))
    return lines, {n: c for n, c in left.items() if c}


def test_exact_fillings_are_as_many_as_by_trying():
    rng = random.Random(6)
    for _ in range(150):
        counts = Counter(rng.randint(1, 14) for _ in range(rng.randint(1, 25)))
        lines = packing.plan(dict(counts), 14)
        full = sum(n for g, n in lines if sum(g) == 14)
        by_trying, left = exact_complements(counts, 14)
        bins = sum(n for _, n in lines)
        assert full >= 0.8 * len(by_trying) and bins >= math.ceil(sum(a * n for a, n in counts.items()) / 14)
        assert bins <= len(by_trying) + len(left and [x for x, c in left.items() for _ in range(c)])
