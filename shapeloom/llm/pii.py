"""Personal data and secrets: a linear-chain conditional random field over word shapes, decoded by Viterbi.

Tokens are runs of anything but white space. A token's features are its shape: counts of digits, letters, cases and
marks, in classes, and those of its two neighbours. The field is trained by gradient ascent on the likelihood of a small
labelled table (``labelled``), a fixed text in this module whose slots are filled from a seeded generator.

Decoding is exact: tokens without digit or mark have one shape, and where enough of them stand together the middle one
is ``O`` whatever stands around them (how many is found from the trained weights). The chains between such tokens
are decoded on their own, all of a batch at once in numpy.

Entities are maximal runs of tokens of one label, without the punctuation around them; each is replaced by its
label in angle brackets. Defined cases: a null text stays null; an empty one, or one without entities, stays as it is;
very long texts and tokens are read whole; repeated rows get equal results; an empty table gives an empty result;
other columns pass through, and an added column replaces one of its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import joined, lean, pieces, runs, viterbi

LABELS = ["O", "EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN", "SECRET"]
_SPACE = np.zeros(0x110000, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
#: Class of a character: 1 digit, 2 upper, 3 lower or other letter, then one for each mark that PII is made of, 0 anything else.
_MARKS = "@.-:=()+_/"
_CLASS = np.zeros(0x110000, dtype=np.int8)
_CLASS[0x80:] = 3
_CLASS[ord("0") : ord("9") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("a") : ord("z") + 1] = 3
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 4 + _i
_HEX = np.zeros(0x110000, dtype=bool)
_HEX[list(map(ord, "0123456789abcdefABCDEF"))] = True
#: What makes a token worth a look: a digit, or a mark that no plain word carries.
_SPECIAL = np.zeros(0x110000, dtype=bool)
_SPECIAL[list(map(ord, "0123456789@=_+"))] = True

WORDS = "the and of that on for with from please call write about our meeting report then under next was sent by Anna Miller to Berlin office today as we said before more of it in this line der die und nicht mit von le les des pour dans una los con para por que thwhat ouneaer erstion Èqueairetretion éclairement Übertragungseinheit Verantwortlichkeiten internacionalización Öffnung niñosamente constitutionnellement".split()
#: The labelled table: {LABEL:pattern}; in a pattern 9 is a digit, a a lower letter, A an upper one, x hex, N letter or digit; w a word.
TABLE = """w {EMAIL:aaaa.aaa@aaaa.aaa} w w
w w {EMAIL:aaa99@aaaaaa.aaaaaaa.aaa}, w w
w {EMAIL:aaaaaa_aaa@aaaaaaaa.aa}. w
w {EMAIL:Aaaa.Aaaaa@aaa-aaa.aaa} w {EMAIL:a.aaa+aa@aaaaa.aa}
w w {EMAIL:aaaaaa.99@aaaa9.aaaaaaa.aaa} w
w w <{EMAIL:aaaaaaaa@aaa.aa.aa}> w
w {EMAIL:aa99aa@aaaaa.aaa}; w
w {PHONE:+9 (999) 999-9999} w w
w w {PHONE:+9 (999) 999-9999}. w
w {PHONE:+9 999-999-9999} w
w {PHONE:(999) 999-9999} w w
w {PHONE:999-999-9999}, w
w {PHONE:+99 99 9999 9999} w
w {PHONE:+99 999 9999999} w
w {PHONE:+99 9 99 99 99 99} w
w {PHONE:999.999.9999} w
w {PHONE:+99999999999} w {PHONE:+9-999-999-9999} w
w {IP:99.99.999.999} w w
w {IP:999.9.9.99}, w
w w {IP:99.999.999.99}. w {IP:9.9.9.9} w
w {IP:999.999.9.9:9999} w
w {IP:999.99.99.999} w {IP:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx} w
w {IP:xxxx:xx9::xx9x:xxxx} w
w {CARD:9999999999999999} w w
w w {CARD:9999999999999999}. w
w {CARD:9999 9999 9999 9999} w
w {CARD:9999-9999-9999-9999}, w
w {CARD:999999999999999} w {CARD:9999 999999 99999} w
w {SSN:999-99-9999} w
w w {SSN:999-99-9999}. w
w {IBAN:AA99999999999999999999} w
w {IBAN:AA99AAAA99999999999999}, w
w {IBAN:AA99 9999 9999 9999 9999 99} w
w {IBAN:AA99 AAAA 9999 9999 9999 99} w
w {SECRET:AAAAAAAA99AAA9AA99AA} w w
w w {SECRET:AAAAAA9AA9AAAAAA9AAA}, w
w {SECRET:AAAAAAAAAAAAAAAAAA9A} w {SECRET:AAAA999A9A9AAA99A9AA} w
w {SECRET:aaaaaaaa=x9xx9xxxx9xx9xxxxx} w
w {SECRET:aaaaaaaa=x9xx9xxxx9} w {SECRET:aaaaaaa=aaaa99aaaa} w
w {SECRET:aaaaaaaa=AaaaaA99} w {SECRET:aaaaaaaa=aaaaaaaa} w
w {SECRET:aaaaaa_aaa=NNNNNNNNNNN9NNNNNNNN9} w
w {SECRET:aaaaa=NNNNNNN9NNNNNNNNNNNN}. w
w {SECRET:aa-NN9NNNNNNNNNNNNN9NNNNNNNNNNNNNNN} w
w {SECRET:aaa_NNNNNN9NNNNNNNNNNNN9NNNNNNNNNNNNNNN} w
w {SECRET:x9xxx9xxxxxx9xxxxxxx9xxxxxxx9xxxx} w
w {SECRET:AAA9NNNNNNNN.NNNNN9NNNNNNN.NNNNNNN9NNNNN} w
w w w w
w w, w. w
Aaaa w w. Aaaaa w
AAAA!! AAA!! AA!!
w*** w$$$ w### w%%%
w | w | w | w, | w.
w 9 w 99 w 999 w
w 99. w 9, w
w 9999 w 99999 w
w 9.9. w 99.9 w 9.99% w
w Version 9.9. w 9.9.9 w
w v9.9.99 w 99:99 w 99:99:99 w
w 9999-99-99 w 99.99.9999 w
w 99/99/9999 w 9999-9999 w
w 999,999 w $9,999.99 w 99% w
w a-aaa w AA-AA 9.9. w
w a=a w a/a w (w w) w (9) w [99] w
w aaa-9 w AAAA-99 w A99 w a9 w 9aa w 99aa w
w page_aaa w aaa_aaa w aaaaa: w
w http://aaa.aaaa.aaa/aa/99 w aaa.aa/aaa w
w No. 99 w 99 (999) w 9-9 w 99-99 w
w 999 999 w 99 999 999 w
w 9999 w w 9999 9999 w
w AAAA w AAAAAAAA w AAAAAAAAAAAAAAAAAAAA w
w @aaaa w w @ w
w aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa w Aaaaaaaaaaaaaaaaa. w
w 99999999 w 9999999 w 999999. w"""


def labelled(copies: int = 4, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The small labelled table: rows (text, entities as (start, end, label))."""
    rng = np.random.default_rng(seed)
    of = {"9": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "x": "0123456789abcdef", "N": "0123456789abcdefghijkLMNOPQRSTUVWXYZ"}

    def fill(s: str) -> str:
        return "".join(of[c][int(rng.integers(len(of[c])))] if c in of else c for c in s)

    rows = []
    for line in TABLE.split("\n") * copies:
        text, found = "", []
        for k, part in enumerate(re.split(r"(\{[A-Z]+:[^}]*\})", line)):
            if k % 2:
                label, pattern = part[1:-1].split(":", 1)
                got = "AKIA" + fill(pattern[4:]) if pattern.startswith("AKIA") else fill(pattern)
                found.append((len(text), len(text) + len(got), label))
                text += got
            else:
                for bit in re.split(r"(\bw\b|\s+)", part):
                    text += " ".join(rng.choice(WORDS, int(rng.integers(1, 3)))) if bit == "w" else bit if not bit.strip() else bit if re.fullmatch(r"Version|No\.|page_aaa|http.*", bit) else fill(bit)
        rows.append((text, found))
    return rows


def keyed(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a token opens as a well-known kind of access key does."""
    ok = end - start >= 16
    for i, c in enumerate("AKIA"):
        ok &= cp[np.minimum(start + i, len(cp) - 1)] == ord(c)
    return ok


def special(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a token has a digit, two marks or one that no plain word carries, or the opening of a key."""
    if not len(start):
        return np.zeros(0, dtype=bool)
    sums = np.concatenate(([0], np.cumsum(_SPECIAL[cp], dtype=np.int32)))
    marks = np.concatenate(([0], np.cumsum((_CLASS[cp] > 3) & (_CLASS[cp] != 5), dtype=np.int32)))
    return (sums[end] > sums[start]) | (marks[end] - marks[start] > 1) | keyed(cp, start, end)


def shapes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(tokens, features) of 0 and 1: each token's own shape."""
    if not len(start):
        return np.zeros((0, 0), dtype=np.float32)
    length = end - start
    first = np.cumsum(length) - length
    at = np.repeat(start - first, length) + np.arange(int(length.sum()))
    c = cp[at]
    kind = _CLASS[c]
    n = np.stack([np.add.reduceat((kind == k).astype(np.int32), first) for k in range(4 + len(_MARKS))], 1)
    hexes = np.add.reduceat(_HEX[c].astype(np.int32), first)
    digit, upper, lower = n[:, 1], n[:, 2], n[:, 3]
    mark = {m: n[:, 4 + i] for i, m in enumerate(_MARKS)}
    letters = upper + lower
    head, tail = kind[first], kind[first + length - 1]
    core = length - n[:, 0]
    out = [np.ones(len(start), dtype=bool), letters == core, (digit == 0) & (upper > 0), (upper >= 2) & (lower == 0)]
    out += [digit == 0, digit == 1, digit == 2, digit == 3, digit == 4, (digit >= 5) & (digit <= 6), (digit >= 7) & (digit <= 9), digit == 10, (digit >= 11) & (digit <= 12), (digit >= 13) & (digit <= 19), digit >= 20]
    out += [(digit > 0) & (letters == 0), (digit > 0) & (upper > 0) & (lower == 0), (digit > 0) & (lower > 0) & (upper == 0), (digit > 0) & (lower > 0) & (upper > 0)]
    out += [mark["@"] == 1, (mark["@"] == 1) & (mark["."] >= 1) & (letters >= 3), mark["."] == 1, mark["."] == 2, mark["."] == 3, mark["."] >= 4]
    out += [mark["-"] == 1, mark["-"] == 2, mark["-"] >= 3, mark[":"] == 1, mark[":"] >= 2, mark["="] == 1, mark["="] >= 2, mark["("] > 0, mark[")"] > 0, mark["+"] > 0, mark["_"] > 0, mark["/"] > 0]
    out += [head == 11, head == 9, head == 1, tail == 1, head == 2, length >= 8, length >= 12, length >= 16, length >= 20, length >= 28, (hexes >= 16) & (hexes + n[:, 0] + mark["."] == length), n[:, 0] > 0]
    out += [(mark["."] == 3) & (letters == 0) & (digit >= 4), (mark["-"] == 2) & (digit == 9) & (letters == 0), (upper >= 2) & (digit >= 2) & (lower == 0) & (length >= 15), (mark["="] == 1) & (lower >= 3) & (length >= 12), (mark[":"] >= 2) & (hexes + mark[":"] == length) & (length >= 8)]
    out += [(upper >= 2) & (digit >= 1) & (digit <= 2) & (length <= 5), (digit == 4) & (length == 4), (digit == 3) & (length <= 5) & (mark["("] > 0)]
    out += [(mark["-"] == 1) & (digit == 7) & (letters == 0), (digit == 10) & (letters == 0) & (mark["-"] + mark["."] >= 2)]
    out += [keyed(cp, start, end)]
    x = np.stack(out, 1).astype(np.float32)
    x[~special(cp, start, end), 1:] = 0  # plain tokens have one shape
    return x


_one = np.array([ord("a")], dtype=np.uint32)
N_OWN = shapes(_one, np.array([0]), np.array([1])).shape[1]


def features(own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Own shapes beside those of the neighbours: zeros for a plain one and at the ends of a text."""
    return np.concatenate([own, before, after], 1)


class Field:
    """``weights``: (3 * N_OWN, K); ``step``: (K, K)."""

    def __init__(self, weights: np.ndarray, step: np.ndarray):
        self.weights, self.step = weights, step
        #: plain tokens to either side that make a plain token surely O, whatever stands beyond; None if no such number is found
        self.reach = next((h for h in range(1, 13) if self._sure(weights[0], h)), None)

    def _sure(self, plain: np.ndarray, h: int) -> bool:
        """Whether O is best in the middle of 2 h + 1 plain tokens between any states, or fewer at an end of the text."""
        times = lambda a, b: (a[:, :, None] + b[None]).max(1)
        left, right = self.step + plain, self.step
        for _ in range(h):
            left, right = times(left, self.step + plain), times(self.step + plain, right)
        a, b = plain[None], np.zeros((len(plain), 1))
        lefts, rights = [left, a], [right, b]
        for _ in range(h):
            a, b = times(a, self.step + plain), times(self.step + plain, b)
            lefts.append(a)
            rights.append(b)
        total = np.concatenate(lefts)[:, :, None] + np.concatenate(rights, 1)[None]
        return bool((total[:, 0] > total[:, 1:].max(1)).all())

    def entities(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, label) in characters, in order, of each text."""
        cp, starts = joined(texts)
        begin, end = runs(~_SPACE[cp])
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(begin):
            return found
        doc = np.searchsorted(starts, begin, side="right") - 1
        marked = special(cp, begin, end)
        n = len(begin)
        if self.reach is not None:
            near = np.concatenate(([0], np.cumsum(marked, dtype=np.int32)))
            place, h = np.arange(n), self.reach + 1
            look = near[np.minimum(place + h + 1, n)] > near[np.maximum(place - h, 0)]
            use = look.copy()  # one certain token on either side closes the chain
            use[1:] |= look[:-1]
            use[:-1] |= look[1:]
        else:
            look = use = np.ones(n, dtype=bool)
        at = np.flatnonzero(use)
        if not len(at):
            return found
        around = np.unique(np.concatenate([at, np.maximum(at - 1, 0), np.minimum(at + 1, n - 1)]))
        own = shapes(cp, begin[around], end[around])
        where = np.searchsorted(around, at)
        prev = np.where(((at > 0) & (doc[at] == doc[np.maximum(at - 1, 0)]) & marked[np.maximum(at - 1, 0)])[:, None], own[np.searchsorted(around, np.maximum(at - 1, 0))], 0)
        after = np.where(((at < n - 1) & (doc[at] == doc[np.minimum(at + 1, n - 1)]) & marked[np.minimum(at + 1, n - 1)])[:, None], own[np.searchsorted(around, np.minimum(at + 1, n - 1))], 0)
        score = features(own[where], prev, after) @ self.weights
        score[~look[at], 1:] = -1e6
        cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (doc[at][1:] != doc[at][:-1]))))
        state = viterbi(score, np.diff(np.concatenate([cut, [len(at)]])), self.step)
        edge = np.concatenate(([True], (state[1:] != state[:-1])))
        edge[cut] = True
        first = np.flatnonzero(edge)
        last = np.concatenate([first[1:], [len(at)]]) - 1
        for f, t in zip(first[state[first] > 0], last[state[first] > 0]):
            a, b, d = begin[at[f]], end[at[t]], doc[at[f]]
            while b > a and chr(cp[b - 1]) in ".,;:!?\"'()<>[]*$#%&|":
                b -= 1
            while a < b and chr(cp[a]) in ".,;:!?\"')<>[]*$#%&|":
                a += 1
            if a < b:
                found[d].append((int(a - starts[d]), int(b - starts[d]), LABELS[state[f]]))
        return found


def fit(rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 150, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """Maximum likelihood of the labelled rows, by Adam over forward and backward sums of all rows at once."""
    texts = [t for t, _ in rows]
    cp, starts = joined(texts)
    begin, end = runs(~_SPACE[cp])
    doc = np.searchsorted(starts, begin, side="right") - 1
    own = shapes(cp, begin, end)
    same, marked = doc[1:] == doc[:-1], special(cp, begin, end)
    prev = np.concatenate([np.zeros((1, N_OWN)), np.where((same & marked[:-1])[:, None], own[:-1], 0)])
    after = np.concatenate([np.where((same & marked[1:])[:, None], own[1:], 0), np.zeros((1, N_OWN))])
    x = features(own, prev, after).astype(np.float64)
    k = len(LABELS)
    gold = np.zeros(len(begin), dtype=int)
    for d, (_, found) in enumerate(rows):
        for a, b, label in found:
            gold[(doc == d) & (begin < starts[d] + b) & (end > starts[d] + a)] = LABELS.index(label)
    n = np.bincount(doc, minlength=len(texts))
    longest = int(n.max())
    place = np.arange(len(doc)) - np.concatenate(([0], np.cumsum(n)[:-1]))[doc]
    real = np.zeros((len(texts), longest), dtype=bool)
    real[doc, place] = True
    joint = np.zeros((k, k))
    for i in range(1, len(doc)):
        if doc[i] == doc[i - 1]:
            joint[gold[i - 1], gold[i]] += 1
    target = np.zeros((len(doc), k))
    target[np.arange(len(doc)), gold] = 1
    w, step = np.zeros((x.shape[1], k)), np.zeros((k, k))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(step), np.zeros_like(step)]

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))

    for it in range(1, rounds + 1):
        e = np.zeros((len(texts), longest, k))
        e[doc, place] = x @ w
        fwd = np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = lse(fwd[:, t - 1, :, None] + step, 1) + e[:, t]
            fwd[:, t] = np.where(real[:, t, None], new, fwd[:, t - 1])
        total = lse(fwd[:, -1], 1)
        back = np.zeros_like(e)
        gj = np.zeros((k, k))
        for t in range(longest - 2, -1, -1):
            inner = step + (e[:, t + 1] + back[:, t + 1])[:, None, :]
            live = real[:, t + 1]
            back[:, t] = np.where(live[:, None], lse(inner, 2), 0)
            gj += np.exp(fwd[live, t][:, :, None] + inner[live] - total[live][:, None, None]).sum(0)
        p = np.exp(fwd + back - total[:, None, None])[doc, place]
        for j, (value, grad) in enumerate(((w, x.T @ (target - p) / len(texts) - decay * w), (step, (joint - gj) / len(texts) - decay * step))):
            m, v = moments[2 * j], moments[2 * j + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    return Field(w, step)


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field of the labelled table; trained once a process in about two seconds."""
    return fit(labelled())


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, label in found:
        out += [text[at:a], f"<{label}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None, text: str = "text", length: str | None = None, count: str | None = None) -> DataFrame:
    """``docs`` with entities in ``text`` replaced. One pass, no shuffle.

    ``length`` names a column that gets the new text's characters; ``count`` one that gets the entities replaced.
    """
    field = field or default_field()
    fields = [f for f in docs.schema.fields if f.name != count] + ([T.StructField(count, T.IntegerType())] if count else [])
    names = [f.name for f in fields if f.name != count]

    @lean
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, text):
            texts = pdf[text].tolist()
            found = field.entities(texts)
            out = pdf[names].copy()
            out[text] = [redacted(t, f) if f else t for t, f in zip(texts, found)]
            if length:
                changed = np.array([bool(f) for f in found])
                out[length] = out[length].where(~changed, out[text].str.len())
            if count:
                out[count] = [len(f) for f in found]
            yield out

    return docs.mapInPandas(work, T.StructType(fields))
