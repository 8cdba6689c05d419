"""Language identification: script ranges narrow the candidates, Viterbi labels spans of mixed text.

Words are maximal runs of letters. The script of a word's first letter names its candidate languages; a script
with one language decides the word, Latin words get a log-probability from each language's character trigrams,
trained here. Viterbi with one penalty for any switch then gives each word of a text its label. ``und`` stands
beside every candidate with a flat score, and takes words of scripts that have no language.

Defined cases: a null or empty text, or one without letters, has language ``und``, share 0 and no spans; a very
long text is one chain of words, never cut; ties go to the state that was; repeated rows get equal results;
an empty table gives an empty result; other columns pass through untouched, and a column of the input with
the name of an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined, lean, pieces, runs, table, viterbi

#: Function words that stand in where a language has few labelled rows; they count as text beside the sample.
SEEDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn können schon",
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais comme ou si leur y dont aux avec cette ces son sa nous même être fait elle deux tout bien encore sans été peut aussi très après autres ont entre temps sous était où depuis moins",
}
#: (first, last code point, language) of scripts that name one language; Latin letters go to the trained models.
SCRIPTS = [
    (0x0370, 0x03FF, "el"), (0x0400, 0x052F, "ru"), (0x0530, 0x058F, "hy"), (0x0590, 0x05FF, "he"), (0x0600, 0x06FF, "ar"), (0x0750, 0x077F, "ar"),
    (0x0900, 0x097F, "hi"), (0x0980, 0x09FF, "bn"), (0x0B80, 0x0BFF, "ta"), (0x0E00, 0x0E7F, "th"), (0x10A0, 0x10FF, "ka"), (0x1100, 0x11FF, "ko"), (0x3040, 0x30FF, "ja"), (0x3400, 0x9FFF, "zh"), (0xAC00, 0xD7AF, "ko"),
]
LATIN = [(0x0041, 0x024F), (0x1E00, 0x1EFF)]
BITS = 15
SPANS = "array<struct<start:int,end:int,lang:string>>"


def _trigrams(low: np.ndarray) -> np.ndarray:
    """A bucket for each position with its neighbours; neighbours that are no letters count as one border."""
    x = np.where(table("alpha")[low], low, 0).astype(np.uint64)
    prev, after = np.concatenate(([0], x[:-1])).astype(np.uint64), np.concatenate((x[1:], [0])).astype(np.uint64)
    h = (prev * np.uint64(0x9E3779B97F4A7C15)) ^ (x * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x165667B19E3779F9))
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32)


class Model:
    """``weights``: (2**BITS, latin languages + 1) log-probabilities of trigrams, the last column that of ``und``."""

    def __init__(self, weights: np.ndarray, latin: list[str], penalty: float):
        self.latin, self.penalty = latin, penalty
        self.labels = [*latin, *sorted({x for _, _, x in SCRIPTS} - set(latin)), "und"]
        self.weights = weights.astype(np.float32)

    def _script(self, first: np.ndarray) -> np.ndarray:
        """State of the one language of each word's script, -1 for Latin, -2 for none."""
        out = np.full(len(first), -2, dtype=np.int32)
        for lo, hi in LATIN:
            out[(first >= lo) & (first <= hi)] = -1
        for lo, hi, name in SCRIPTS:
            out[(first >= lo) & (first <= hi)] = self.labels.index(name)
        return out

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words of all texts: document, start and end in it, and scores of the states."""
        cp, starts = joined(texts)
        low = table("lower")[cp]
        start, end = runs(table("alpha")[cp])
        doc = np.searchsorted(starts, start, side="right") - 1
        k = len(self.latin)
        score = np.full((len(start), len(self.labels)), -1e4, dtype=np.float32)
        if len(start):
            gram = _trigrams(low)
            length = end - start
            at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            total = np.add.reduceat(self.weights[gram[at]], np.cumsum(length) - length)
            script = self._script(cp[start])
            latin = script == -1
            score[latin, :k] = total[latin, :k]
            score[:, -1] = total[:, -1]
            one = script >= 0
            score[np.flatnonzero(one), script[one]] = 0
            none = script == -2
            score[none, -1] = 0
        return doc, start - starts[doc], end - starts[doc], score

    def states(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words document, start, end and state; each text's number of words, and of its words in each state."""
        doc, start, end, score = self.words(texts)
        used = np.flatnonzero((score > -1e3).any(0))  # states that no word of the batch can take are left out
        n = np.bincount(doc, minlength=len(texts))
        k = len(used)
        state = used[viterbi(score[:, used], n, np.full((k, k), -self.penalty) + np.eye(k) * self.penalty)] if len(doc) else np.zeros(0, dtype=int)
        share = np.bincount(doc * len(self.labels) + state, minlength=len(texts) * len(self.labels)).reshape(len(texts), -1)
        return doc, start, end, state, n, share

    def known(self, texts: list[str | None]) -> np.ndarray:
        """Share of each text's words in known languages, all of them together; 0 without words."""
        *_, n, share = self.states(texts)
        return share[:, :-1].sum(1) / np.maximum(n, 1)

    def label(self, texts: list[str | None]) -> list[tuple[str, float, int, list[tuple[int, int, str]]]]:
        """Language, its share of the words, words, spans of each text."""
        doc, start, end, state, n, share = self.states(texts)
        # first words of spans: another document or another state than the word before
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (state[1:] != state[:-1])))) if len(doc) else np.zeros(0, dtype=int)
        last = np.concatenate((new[1:], [len(doc)])) - 1 if len(new) else new
        spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for d, a, b, s in zip(doc[new].tolist(), start[new].tolist(), end[last].tolist(), state[new].tolist()):
            spans[d].append((a, b, self.labels[s]))
        top = share.argmax(1)
        return [(self.labels[t] if m else "und", round(float(row[t]) / m, 6) if m else 0.0, int(m), s) for t, m, row, s in zip(top.tolist(), n.tolist(), share, spans)]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400, penalty: float = 6.0) -> Model:
    """Trigram models of the languages of ``SEEDS``, from a bounded sample of labelled rows.

    The sample is the documented bound: rows whose hash of ``key`` falls under ``per_language`` in expectation of each
    language's rows, whole. Only counts of trigrams, of fixed size, reach the driver.
    """
    latin = sorted(SEEDS)
    n = {r[lang]: r["n"] for r in docs.filter(F.col(lang).isin(latin)).groupBy(lang).agg(F.count("*").alias("n")).collect()}
    counts = np.zeros((len(latin), 1 << BITS))
    for i, name in enumerate(latin):
        counts[i] += 20 * np.bincount(_trigrams(table("lower")[(c := joined([SEEDS[name]])[0])])[table("alpha")[c]], minlength=1 << BITS)
    if n:
        keep: Column = F.lit(False)
        for name, rows in n.items():
            keep = keep | ((F.col(lang) == name) & (F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < int(min(1.0, per_language / rows) * (1 << 30))))
        sample = docs.filter(keep).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

        @lean
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(latin), 1 << BITS), dtype=np.int64)
            for pdf in pieces(batches, "text"):
                for i, name in enumerate(latin):
                    cp, _ = joined(pdf.loc[pdf["lang"] == name, "text"].tolist())
                    total[i] += np.bincount(_trigrams(table("lower")[cp])[table("alpha")[cp]], minlength=1 << BITS)
            yield pd.DataFrame({"at": pd.Series(at := np.flatnonzero(total), dtype="int32"), "n": total.ravel()[at]})

        for r in sample.mapInPandas(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            counts.ravel()[r["at"]] += r["n"]
    smooth = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])
    flat = np.full((1, counts.shape[1]), -13.0)
    return Model(np.vstack([np.log(smooth), flat]).T, latin, penalty)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_id, lang_share, lang_words and lang_spans (offsets in characters). One pass, no shuffle."""
    added = {"lang_id": "string", "lang_share": "double", "lang_words": "int", "lang_spans": SPANS}
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType(kept + [T.StructField(k, T.DataType.fromDDL(v)) for k, v in added.items()])
    names = [f.name for f in kept]

    @lean
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, text):
            found = model.label(pdf[text].tolist())
            out = pdf[names].copy()
            out["lang_id"], out["lang_share"], out["lang_words"] = ([x[i] for x in found] for i in range(3))
            out["lang_spans"] = [[{"start": a, "end": b, "lang": s} for a, b, s in x[3]] for x in found]
            yield out

    return docs.mapInPandas(work, schema)


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, unchanged, of which at least ``least`` of the words are in known languages, whichever they are. One pass, no shuffle."""

    @lean
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, text):
            known = model.known(pdf[text].tolist())
            yield pdf[(known > 0) & (known >= least)]

    return docs.mapInPandas(work, docs.schema)
