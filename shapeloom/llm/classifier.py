"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` tokens (tokens: runs of punctuation, and runs of any other characters but white
space, in lower case). Every passage is encoded: the learned vectors of its tokens' features (hashed) are summed, scaled by
the root of the number of tokens and go through a tanh layer. Gated attention, softmax of w (tanh(V h) * sigmoid(U h)), weighs the
passages of a document; the weighted sum of their encodings is scored for two labels, good quality and toxic. Labels
are of documents only: what passage matters is learned.

One network of ``HEADS`` attentions, one a label, is trained by Adam on the driver, on a sample of labelled documents that
``per_class`` bounds for each pair of labels, so it costs the same at any size; every document is scored.

Defined cases: a null text, an empty one and one of white space alone have no passages, null scores and keep = false; very
long texts have all their passages scored; ties at a threshold are kept (quality) and rejected (toxic); repeated rows get equal
scores; labels that are null aren't learned from, of a document labelled twice each row counts; without labelled
rows of both kinds the label's score is the share of the one kind there is (0.5 without any); an empty table gives an
empty result; other columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, lean, mix, pieces, runs, table, word_hashes

BITS = 15
DIM = 16
HIDDEN = 16
GATE = 8
HEADS = 2
#: Steps of training at least, where the sample is small.
STEPS = 400
PASSAGE = 48
PREFIXES = (5, 7)
FEATURES = (1 << BITS) + 2
_KIND = np.zeros(0x110000, dtype=np.int8)
_KIND[list(map(ord, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))] = 1
_KIND[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 2


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features and the passage of each; tokens of each passage; passages of each text.

    A token's features: itself, its first five and first seven characters where it is longer, whether it repeats the
    token before it, and whether it is all capitals.
    """
    cp, starts = joined(texts)
    kind = _KIND[cp]
    s0, e0 = runs(kind == 0)
    s1, e1 = runs(kind == 1)
    begin, end = np.concatenate([s0, s1]), np.concatenate([e0, e1])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    doc = np.searchsorted(starts, begin, side="right") - 1
    count = np.bincount(doc, minlength=len(texts))
    n = -(-count // PASSAGE)
    size = np.minimum(PASSAGE, np.repeat(count, n) - (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * PASSAGE)
    passage = np.repeat(np.arange(len(size)), size)
    low = table("lower")[cp]
    top = np.uint64(64 - BITS)
    h = word_hashes(low, begin, end)
    found, where = [(h >> top).astype(np.int32)], [passage]
    for k in PREFIXES:
        long = np.flatnonzero(end - begin > k)
        found.append((mix(word_hashes(low, begin[long], begin[long] + k) + np.uint64(k)) >> top).astype(np.int32))
        where.append(passage[long])
    again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
    capital = np.concatenate(([0], np.cumsum(cp != low)))
    loud = np.flatnonzero((end - begin > 1) & (capital[end] - capital[begin] == end - begin))
    for k, x in enumerate((again, loud)):
        found.append(np.full(len(x), (1 << BITS) + k, dtype=np.int32))
        where.append(passage[x])
    return np.concatenate(found), np.concatenate(where), size, n


def _all_bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``bags`` of many texts, worked out in pieces of bounded memory."""
    done, passages = [], 0
    ends = np.cumsum([len(t or "") for t in texts])
    at = 0
    while at < len(texts) or not done:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, side="right")))
        bucket, passage, size, n = bags(texts[at:to])
        done.append((bucket, (passage + passages).astype(np.int32), size, n))
        passages, at = passages + len(size), to
    return tuple(np.concatenate(x) for x in zip(*done))


class Network:
    """Parameters: token vectors E, passage layer (A, a), gates V and U and attention w of each head, scores (S, s)."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
        #: features that have a vector
        self.used = np.ones(FEATURES, dtype=bool)
        self.p = {"E": (0.05 * rng.standard_normal((FEATURES, DIM))).astype(np.float32), "A": init(DIM, HIDDEN), "a": np.zeros(HIDDEN, dtype=np.float32)}
        self.p |= {"V": init(HEADS, HIDDEN, GATE), "U": init(HEADS, HIDDEN, GATE), "w": init(HEADS, GATE, 1)[..., 0], "S": init(HIDDEN, HEADS).T.copy(), "s": np.zeros(HEADS, dtype=np.float32)}
        #: for a label of which only one kind is known
        self.fixed: dict[int, float] = {}

    def encode(self, bucket: np.ndarray, passage: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The features that are used, their passages, what they sum to and the passages' encodings."""
        use = self.used[bucket]
        bucket, passage = bucket[use], passage[use]
        v = self.p["E"][bucket]
        pooled = np.stack([np.bincount(passage, weights=v[:, j], minlength=len(size)) for j in range(DIM)], 1).astype(np.float32) / np.sqrt(size, dtype=np.float32)[:, None]
        return bucket, passage, pooled, np.tanh(pooled @ self.p["A"] + self.p["a"])

    def attend(self, h: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Of each head: the two gates' values, the weights of the passages, the documents' representation and logit."""
        out = []
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(len(n)), n)
        for k in range(HEADS):
            t, g = np.tanh(h @ self.p["V"][k]), 1 / (1 + np.exp(-(h @ self.p["U"][k])))
            e = (t * g) @ self.p["w"][k]
            e = np.exp(e - np.maximum.reduceat(e, first)[of])
            alpha = e / np.add.reduceat(e, first)[of]
            z = np.add.reduceat(alpha[:, None] * h, first, axis=0)
            out.append((t, g, alpha, z, z @ self.p["S"][k] + self.p["s"][k]))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """(texts, HEADS) probabilities; NaN for a text without passages."""
        bucket, passage, size, n = bags(texts)
        out = np.full((len(texts), HEADS), np.nan)
        some = np.flatnonzero(n)
        if len(some):
            h = self.encode(bucket, passage, size)[3]
            for k, (_, _, _, _, logit) in enumerate(self.attend(h, n[some])):
                out[some, k] = self.fixed.get(k, 0) if k in self.fixed else np.round(1 / (1 + np.exp(-logit.astype(np.float64))), 6)
        return out

    def step(self, bucket: np.ndarray, passage: np.ndarray, size: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted cross-entropy over one batch; a label that is NaN takes no part."""
        bucket, passage, pooled, h = self.encode(bucket, passage, size)
        of = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        grad = {k: np.zeros_like(v) for k, v in self.p.items() if k != "E"}
        dh = np.zeros_like(h)
        for k, (t, g, alpha, z, logit) in enumerate(self.attend(h, n)):
            known = ~np.isnan(y[:, k])
            d = np.where(known, (1 / (1 + np.exp(-logit)) - np.nan_to_num(y[:, k])) * weight[:, k], 0).astype(np.float32) / max(1, len(n))
            grad["S"][k] = z.T @ d
            grad["s"][k] = d.sum()
            dz = d[:, None] * self.p["S"][k]
            along = (dz[of] * h).sum(1)
            de = alpha * (along - np.add.reduceat(alpha * along, first)[of])
            dh += alpha[:, None] * dz[of]
            grad["w"][k] = (t * g).T @ de
            dtg = de[:, None] * self.p["w"][k]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            grad["V"][k], grad["U"][k] = h.T @ dt, h.T @ dg
            dh += dt @ self.p["V"][k].T + dg @ self.p["U"][k].T
        du = dh * (1 - h * h)
        grad["A"], grad["a"] = pooled.T @ du, du.sum(0)
        dp = (du @ self.p["A"].T) / np.sqrt(size, dtype=np.float32)[:, None]
        each = dp[passage]
        grad["E"] = np.stack([np.bincount(bucket, weights=each[:, j], minlength=FEATURES) for j in range(DIM)], 1).astype(np.float32)
        return grad


def _telling(bucket: np.ndarray, doc: np.ndarray, labels: np.ndarray, keep: np.ndarray, least: float) -> np.ndarray:
    """Which features' share of documents differs between a label's two kinds by ``least`` standard errors; all if none does."""
    has = np.unique(doc.astype(np.int64) * FEATURES + bucket)
    doc, bucket = has // FEATURES, has % FEATURES
    used = np.zeros(FEATURES, dtype=bool)
    for k in range(HEADS):
        a, b = (labels[keep, k] == 1).sum(), (labels[keep, k] == 0).sum()
        if a and b:
            x, y = (np.bincount(bucket[labels[doc, k] == v], minlength=FEATURES) for v in (1, 0))
            p = (x + y + 0.5) / (a + b + 1)
            used |= np.abs(x / a - y / b) > least * np.sqrt(p * (1 - p) * (1 / a + 1 / b))
    return used if used.any() else ~used


def fit(texts: list[str], labels: np.ndarray, rounds: int = 6, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5, least: float = 4.0) -> Network:
    """A network for (texts, HEADS) labels of 0, 1 or NaN; each label's two kinds weigh alike.

    Vectors are learned for the features that stand out by ``least`` standard errors under either label.
    """
    return fit_bags(_all_bags(texts), labels, rounds, batch, rate, decay, seed, least)


def fit_bags(found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray, rounds: int = 6, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5, least: float = 4.0) -> Network:
    """``fit`` on what ``bags`` gives of the texts."""
    net = Network(seed)
    bucket, passage, size, n = found
    keep = np.flatnonzero(n)
    weight = np.ones((len(n), HEADS))
    for k in range(HEADS):
        ones, zeros = (labels[keep, k] == 1).sum(), (labels[keep, k] == 0).sum()
        if not ones or not zeros:
            net.fixed[k] = 0.5 if not ones and not zeros else float(bool(ones))
            weight[:, k] = 0
        else:
            weight[:, k] = np.where(labels[:, k] == 1, (ones + zeros) / (2 * ones), (ones + zeros) / (2 * zeros))
    if len(net.fixed) == HEADS:
        return net
    net.used = _telling(bucket, np.repeat(np.arange(len(n)), n)[passage], labels, keep, least)
    order = np.argsort(passage, kind="stable")
    bucket, passage = bucket[order], passage[order]
    stop = np.cumsum(n)
    token = np.searchsorted(passage, np.arange(len(size) + 1))
    rng = np.random.default_rng(seed)
    first, second = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    it = 0
    rounds = max(rounds, -(-STEPS // -(-len(keep) // batch)))
    total = rounds * -(-len(keep) // batch)
    for _ in range(rounds):
        order = rng.permutation(keep)
        for at in range(0, len(order), batch):
            mine = order[at : at + batch]
            passages = np.concatenate([np.arange(stop[i] - n[i], stop[i]) for i in mine])
            own = np.concatenate([np.arange(token[stop[i] - n[i]], token[stop[i]]) for i in mine])
            shift = np.repeat(np.cumsum(n[mine]) - n[mine] - (stop - n)[mine], [token[stop[i]] - token[stop[i] - n[i]] for i in mine])
            grad = net.step(bucket[own], passage[own] + shift, size[passages], n[mine], labels[mine], weight[mine])
            it += 1
            now = rate * (1 - 0.9 * it / total)
            for k, g in grad.items():
                g = g + decay * net.p[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.p[k] -= now * (first[k] / (1 - 0.9**it)) / (np.sqrt(second[k] / (1 - 0.99**it)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic", per_class: int = 1500, **options) -> Network:
    """A network from a bounded sample: of each pair of labels, in expectation ``per_class`` documents, with their whole texts.

    The sample is drawn by a hash of the key, so it doesn't depend on how the table is laid out. Its keys and labels are
    broadcast: at most nine pairs of labels, so about 9 * ``per_class`` rows.
    """
    known = labels.select(F.col(key).alias("__key"), F.col(quality).cast("double").alias("__q"), F.col(toxic).cast("double").alias("__t")).filter("__key is not null and (__q is not null or __t is not null)")
    keep = F.lit(False)
    for r in known.groupBy("__q", "__t").count().collect():
        share = int(min(1.0, per_class / r["count"]) * (1 << 30))
        keep = keep | (F.col("__q").eqNullSafe(F.lit(r["__q"])) & F.col("__t").eqNullSafe(F.lit(r["__t"])) & (F.pmod(F.xxhash64("__key"), F.lit(1 << 30)) < share))
    sample = known.filter(keep)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).filter(F.length("__text") > 0).join(F.broadcast(sample), "__key").select(F.xxhash64("__key", "__text").alias("o"), "__text", "__q", "__t")

    @lean
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, "__text"):
            bucket, passage, size, n = bags(pdf["__text"].tolist())
            order = np.argsort(passage, kind="stable")
            bucket, passage = bucket[order], passage[order]
            stop = np.cumsum(n)
            token = np.searchsorted(passage, np.concatenate([[0], stop]))
            own = [(bucket[token[i] : token[i + 1]].astype("<u2" if FEATURES <= 1 << 16 else "<i4").tobytes(), np.diff(np.searchsorted(passage, np.arange(e - k, e + 1))).astype("<i4").tobytes(), size[e - k : e].astype("u1").tobytes()) for i, (e, k) in enumerate(zip(stop.tolist(), n.tolist()))]
            yield pd.DataFrame({"o": pdf["o"].to_numpy(), "q": pdf["__q"].to_numpy(), "t": pdf["__t"].to_numpy(), "bucket": [x[0] for x in own], "many": [x[1] for x in own], "size": [x[2] for x in own]})

    # the features are worked out where the texts are: the driver gets those alone, of as many rows as the sample has
    told = rows.mapInPandas(read, "o long, q double, t double, bucket binary, many binary, size binary").toPandas().sort_values(["o", "q", "t"], kind="stable")
    n = np.array([len(x) for x in told["size"]], dtype=np.int64)
    join = lambda c, kind: np.frombuffer(b"".join(told[c]), dtype=kind)
    many = join("many", "<i4")
    found = join("bucket", "<u2" if FEATURES <= 1 << 16 else "<i4").astype(np.int32), np.repeat(np.arange(len(many), dtype=np.int32), many), join("size", "u1").astype(np.int64), n
    return fit_bags(found, told[["q", "t"]].to_numpy(dtype=np.float64).reshape(-1, 2), **options)


def score(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text", least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """(key, quality, toxic, keep) of every document. One pass, no shuffle."""

    @lean
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, "__text"):
            p = net.scores(pdf["__text"].tolist())
            some = ~np.isnan(p[:, 0])
            value = lambda k: pd.Series(p[:, k]).astype(object).where(some, None)
            keep = some & (np.nan_to_num(p[:, 0]) >= least_quality) & (np.nan_to_num(p[:, 1], nan=1) < most_toxic)
            yield pd.DataFrame({"__key": pdf["__key"].to_numpy(), "quality": value(0), "toxic": value(1), "keep": keep})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInPandas(work, f"__key {kind}, quality double, toxic double, keep boolean").withColumnRenamed("__key", key)
