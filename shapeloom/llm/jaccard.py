"""Exact n-gram Jaccard self-join by partition and enumeration over a hashed universe.

A document is the set of its word n-grams (words: runs of letters and digits, in lower case; a text of fewer than n words is
one gram of all of them), as 48-bit hashes. Two sets of sizes r <= s with Jaccard at least t differ in at most
(1 - t) / (1 + t) * (r + s) grams. Sizes fall into geometric bands. In a band whose largest size is h, the universe is
hashed into m segments. Two similar sets can't differ by more than the threshold in all that are looked up: pigeonhole. A set is indexed in its own band with all its segments, and probes its own and every larger band that
a partner may lie in, with

* threshold 0: the segment's subset, that must be met exactly;
* threshold 1: the subset and its one-deletion neighbourhood, that meets any subset within one gram, all of which are indexed with
  theirs; two subsets that each lack a gram of their own aren't within one, and don't meet;
* threshold -1: no lookup.

A probe's thresholds need to sum, plus one each, to one more than it may differ in. m is ``slack`` times that for sets of size h, a half at least,
so thresholds of 1 always suffice. They are allocated by cost, the cheapest lookups first until the sum is reached: a subset
costs the document frequency of its rarest gram, lowered a little by the others' (counted over all documents in a hashed table
of fixed size; grams of a shared passage come together, so their product alone would say too little), a neighbourhood what its subsets cost.
An empty subset costs all documents: it is looked up only where nothing is left to pay with.

Groups of copies would meet in every segment, all with all. So sets are first put together by what their minima under 32 hash
functions share (``_loose``). That only says where a pair is looked at, and any such grouping gives the same result: pairs within
a group are all looked at in the group's cells, a block of sets against a block, and pairs that meet in the index are
passed on only where they aren't of one group. A group of any size is work for as many cells as it has pairs of blocks.

Meeting pairs whose sketches (parities of bucket counts) differ in more places than the sets may are no
candidates; that is exact, too. They are dropped in the task that they meet in, which reads its sets' sketches from the shared folder: what
meets grows with the square of the documents, and is never sent. The others are verified on the sets. Equal sets are joined by their 128-bit hash, not by the index.

Signatures travel packed, 28 bits each, in blobs by task that name each document once.

Defined cases: a null or empty text, or one without words, has no set, no class and no links; very long texts are read whole;
ties don't arise, the result is exact; an empty table gives an empty result; other columns don't take part. Rows that repeat an
id are rows of their own in ``classes`` and keep what their own text says; in the pairs of ``join``, rows of one id aren't
partners of each other, and rows without id have none.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import NativeFile
from pyarrow.fs import FileSelector, FileSystem
from pyarrow.parquet import FileMetaData, ParquetFile, RowGroupMetaData
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import blob_rows, collect_blobs, discard, fresh, in_slots, joined, lean, materialise, mix, pieces, runs, slots, table, word_hashes

#: Bits of a gram's hash; the rest of a word holds the document's place in a batch, of which there are 2**16 at most.
GRAM_BITS = 48
#: Bits of a signature beside its task.
SIG_BITS = 28
DF_BITS = 18
#: The Jaccard of near copies in production: bigram sets of copies with a tenth of the words edited share two thirds and more,
#: and the distribution over the documents has its gap at 0.55 to 0.6.
NEAR = 0.6
#: Slots of the bitmap of documents whose texts are verified on.
SLOTS = 1 << 23
#: Pairs that one numpy pass over a bucket's posting lists emits at a time.
PAIRS = 2_000_000
#: Pairs that a task keeps to tell which it has sent before.
HELD = 2_000_000
#: Bytes of sketches that a task has in memory at a time.
SKETCHED = 96_000_000
#: Entries that a task or bucket has in memory at a time, and buckets that one task takes after one another.
ENTRIES = 1_000_000
TOGETHER = 12
#: Entries that a task of the index has in memory before it sends them.
SENT = 500_000
#: Minima of a set, minima a band of them, and how many have to agree for two sets to be put together.
MINIMA = 32
ROWS = 4
AGREE = 14
#: Sets of a block of a group, and first members that a shared band of minima is compared with.
BLOCK = 2000
FIRSTS = 16
#: How much of a subset's cost is what independent grams would have, in the logarithm.
TOGETHERNESS = 0.3
#: What is indexed and what is looked up; ``flag >> 2 & flag``: the first looks for the second. What an entry may have.
WHOLE, LESS, ASK_WHOLE, ASK_LESS = 1, 2, 4, 8
KINDS = np.array([1, 5, 13, 2, 6, 4, 12], dtype=np.uint8)
_ODD = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of all texts in order of document and hash, and each document's number of them."""
    cp, starts = joined(texts)
    cp = table("lower")[cp]
    start, end = runs(table("alnum")[cp])
    doc = np.searchsorted(starts, start, side="right") - 1
    h = word_hashes(cp, start, end)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    size = np.where(count, np.maximum(count - n + 1, 1), 0)
    of = np.repeat(np.arange(len(texts)), size)
    place = first[of] + np.arange(len(of)) - (np.cumsum(size) - size)[of]
    gram = np.zeros(len(of), dtype=np.uint64)
    stop = (first + count)[of]
    for i in range(n):
        at = place + i
        inside = at < stop
        gram[inside] = mix(gram[inside] * np.uint64(0x9E3779B97F4A7C15) + h[at[inside]])
    # one sort by document and hash together
    one = np.sort((of.astype(np.uint64) << np.uint64(GRAM_BITS)) | (gram >> np.uint64(64 - GRAM_BITS)))
    one = one[np.concatenate(([True], one[1:] != one[:-1]))] if len(one) else one
    return one & np.uint64((1 << GRAM_BITS) - 1), np.bincount((one >> np.uint64(GRAM_BITS)).astype(np.int64), minlength=len(texts))


def set_keys(gram: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for an empty one."""
    out = []
    some = np.flatnonzero(size)
    first = (np.cumsum(size) - size)[some]
    for salt in (0x1234567, 0x89ABCDE):
        h = np.zeros(len(size), dtype=np.uint64)
        if len(some):
            h[some] = mix(np.add.reduceat(mix(gram ^ np.uint64(salt)), first) + size[some].astype(np.uint64))
        out.append(h.view(np.int64))
    return out[0], out[1]


def minima(gram: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set, a byte of its minimum under each of ``MINIMA`` hash functions, and a hash of every ``ROWS`` of the minima."""
    low = np.zeros((len(size), MINIMA), dtype=np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        first = (np.cumsum(size) - size)[some]
        for k in range(MINIMA):
            low[some, k] = np.minimum.reduceat((gram << np.uint64(64 - GRAM_BITS)) * _ODD[k], first)
    low = mix(low)
    band = np.zeros((len(size), MINIMA // ROWS), dtype=np.uint64)
    for k in range(ROWS):
        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + low[:, k::ROWS] + np.arange(band.shape[1], dtype=np.uint64))
    return (low >> np.uint64(56)).astype(np.uint8), band.view(np.int64)


def sketches(gram: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Of each set, the parities of its grams' counts in 2**k >= 2 * size buckets (8 at least), as packed bits.

    Two sets' parities differ in no more places than the sets do in grams; a longer sketch folds to a shorter one.
    """
    wide = np.maximum(8, 2 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    base = np.cumsum(wide) - wide
    of = np.repeat(np.arange(len(size)), size)
    place = base[of] + (gram.astype(np.int64) & (wide[of] - 1))
    packed = np.packbits((np.bincount(place, minlength=int(wide.sum())) & 1).astype(np.uint8)).tobytes()
    return [packed[b >> 3 : (b + w) >> 3] for b, w in zip(base.tolist(), wide.tolist())]


class Bands:
    """Sizes in geometric bands, and what each band's segments are."""

    def __init__(self, least: float, ratio: float = 1.67, slack: float = 0.7):
        self.least, self.ratio, self.slack = least, ratio, slack
        self.rate = (1 - least) / (1 + least)
        self.top = [1]
        while self.top[-1] < 1 << 40:
            self.top.append(max(self.top[-1] + 1, int(self.top[-1] * ratio)))
        self.high = np.array(self.top)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, size, side="left")

    def differ(self, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The most that similar sets of at most these sizes differ in."""
        return np.floor(self.rate * (r + s) + 1e-9).astype(np.int64)

    def segments(self, band: np.ndarray) -> np.ndarray:
        return np.ceil((self.differ(self.high[band], self.high[band]) + 1) * self.slack).astype(np.int64)

    def widest(self, r: np.ndarray) -> np.ndarray:
        """The last band in which a larger partner of a set of size r may lie."""
        return self.of(np.floor(r / self.least + 1e-9).astype(np.int64))


def _segmented(gram: np.ndarray, of: np.ndarray, base: np.ndarray, m: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each gram's segment in a flat array of all documents' segments, and the gram's mixed value."""
    u = mix(gram ^ salt[of])
    seg = ((u >> np.uint64(32)) * m[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    return base[of] + seg, mix(u + np.uint64(0x632BE59BD9B4E019))


def _sums(place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of uint64 values by place, modulo 2**64."""
    low = np.bincount(place, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n).astype(np.uint64)
    high = np.bincount(place, weights=(value >> np.uint64(32)).astype(np.float64), minlength=n).astype(np.uint64)
    return low + (high << np.uint64(32))


def _order(first: np.ndarray, value: np.ndarray, reverse: bool = False) -> np.ndarray:
    """The order by ``first`` (below 2**24), then by ``value`` (below 2**16) and place: one sort of packed numbers. ``reverse``: the greatest value first."""
    v = value.astype(np.uint64)
    if reverse:
        v = np.uint64(0xFFFF) - v
    packed = np.sort((first.astype(np.uint64) << np.uint64(40)) | (v << np.uint64(24)) | np.arange(len(first), dtype=np.uint64)) if len(first) < 1 << 24 and first.max(initial=0) < 1 << 24 else None
    return np.lexsort((v, first)) if packed is None else (packed & np.uint64(0xFFFFFF)).astype(np.int64)


def signatures(gram: np.ndarray, size: np.ndarray, bands: Bands, logdf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, document, flags, band) of all sets, each document and signature once in a band.

    Flags: ``WHOLE`` and ``LESS`` for a subset, and one without a gram, that is indexed in the set's own band; ``ASK_WHOLE`` and ``ASK_LESS`` for what it looks up.
    """
    some = np.flatnonzero(size)
    out_sig, out_doc, out_role, out_band = [], [], [], []

    def give(sig: np.ndarray, doc: np.ndarray, role: np.ndarray) -> None:
        out_sig.append(mix(sig))
        out_doc.append(doc)
        out_role.append(role.astype(np.uint8))
        out_band.append(band[np.searchsorted(d, doc)].astype(np.uint8))

    if not len(some):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.uint8)
    s = size[some].astype(np.int64)
    own, widest = bands.of(s), bands.widest(s)
    lf = logdf[(gram >> np.uint64(GRAM_BITS - DF_BITS)).astype(np.int64)]
    starts = np.cumsum(size) - size
    for step in range(int((widest - own).max()) + 1):
        part = np.flatnonzero(own + step <= widest)
        d, r, band = some[part], s[part], (own + step)[part]
        m = bands.segments(band)
        base = np.cumsum(m) - m
        total = int(m.sum())
        if step == 0:
            g, f = gram, lf
            of = np.repeat(np.arange(len(d)), r)
        else:
            of = np.repeat(np.arange(len(d)), r)
            at = starts[d][of] + np.arange(len(of)) - (np.cumsum(r) - r)[of]
            g, f = gram[at], lf[at]
        salt = mix(band.astype(np.uint64) + np.uint64(77))
        place, value = _segmented(g, of, base, m, salt)
        owner = np.repeat(np.arange(len(d)), m)
        number = np.arange(total) - base[owner]
        tag = mix(salt[owner] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sums = _sums(place, value, total)
        many = np.bincount(place, minlength=total)
        # a subset's cost, the documents that share it: at most those of its rarest gram, at least what independent grams would have
        by = _order(place, np.minimum(-f * 4096, 0xFFFF), reverse=True)
        ordered, to = f[by].astype(np.float64), place[by]
        begins = np.concatenate(([True], to[1:] != to[:-1])) if len(to) else np.zeros(0, dtype=bool)
        least, second = np.zeros(total), np.zeros(total)
        least[to[begins]] = ordered[begins]
        next_ = np.flatnonzero(begins[:-1] & ~begins[1:]) + 1 if len(to) else np.zeros(0, dtype=int)
        second[to[next_]] = ordered[next_]
        product = np.bincount(place, weights=f, minlength=total)
        price = lambda rarest, every: np.exp(rarest + TOGETHERNESS * (every - rarest))
        rest = np.where(begins, second[to], least[to]) if len(to) else ordered
        one = price(least, product)  # 1 for an empty segment: all documents
        more = np.bincount(to, weights=price(rest, product[to] - ordered), minlength=total)
        # each of the first lookups counts one towards the need, a neighbourhood one more: the cheapest that suffice
        need = bands.differ(r, np.minimum(bands.high[band], np.floor(r / bands.least + 1e-9).astype(np.int64))) + 1
        cost = np.concatenate([one, np.maximum(one, more)])
        order = _order(np.tile(owner, 2), np.minimum(np.log(np.maximum(cost, 1e-12)) * 1500 + 41_500, 0xFFFF))
        rank = np.empty(2 * total, dtype=np.int64)
        rank[order] = np.arange(2 * total) - 2 * base[owner[order % total]]
        chosen = rank < np.tile(need[owner], 2)
        chosen, wide = chosen[:total], chosen[total:]
        # a neighbourhood: subsets without one gram that are whole ones of others, and the whole one that is others' without one gram
        flags = np.where(chosen, ASK_WHOLE, 0) | np.where(wide, ASK_LESS, 0) | (WHOLE if step == 0 else 0)
        use = np.flatnonzero(flags)
        give(sums[use] + tag[use], d[owner[use]], flags[use])
        flags = np.where(wide, ASK_WHOLE, 0) | (LESS if step == 0 else 0)
        gone = np.flatnonzero(flags[place])
        give(sums[place[gone]] - value[gone] + tag[place[gone]], d[of[gone]], flags[place[gone]])
    return np.concatenate(out_sig), np.concatenate(out_doc), np.concatenate(out_role), np.concatenate(out_band)


def _halves(low: np.ndarray) -> bytes:
    """28-bit numbers, two in seven bytes."""
    two = np.zeros(len(low) + (len(low) & 1), dtype="<u8")
    two[: len(low)] = low
    return (two[::2] | (two[1::2] << np.uint64(28))).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _wholes(data: bytes, n: int) -> np.ndarray:
    both = np.zeros((len(data) // 7, 8), dtype=np.uint8)
    both[:, :7] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 7)
    both = both.view("<u8").ravel()
    return np.stack([both & np.uint64((1 << 28) - 1), both >> np.uint64(28)], 1).ravel()[:n].astype(np.uint32)


def _packed(task: np.ndarray, low: np.ndarray, doc: np.ndarray, flag: np.ndarray, keys: np.ndarray, labels: np.ndarray, sizes: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows (task, keys, labels, sizes, counts, body): of each task, its documents' keys, groups (none if no document has one) and sizes, how many entries of each kind each has, and 3.5 bytes an entry.

    A signature keeps 28 bits beside its task: what meets by chance is sorted out when it is verified.
    """
    kind = np.zeros(16, dtype=np.uint64)
    kind[KINDS] = np.arange(len(KINDS), dtype=np.uint64)
    place = (task.astype(np.uint64) << np.uint64(44)) | (doc.astype(np.uint64) << np.uint64(24)) | (kind[flag] << np.uint64(20))
    order = np.argsort(place)
    place, low = place[order] >> np.uint64(20), low[order]
    head = np.flatnonzero(np.concatenate(([True], place[1:] >> np.uint64(4) != place[:-1] >> np.uint64(4)))) if len(place) else np.zeros(0, dtype=int)
    row = np.repeat(np.arange(len(head)), np.diff(np.concatenate([head, [len(place)]])))
    counts = np.bincount(row * len(KINDS) + (place & np.uint64(15)).astype(np.int64), minlength=len(head) * len(KINDS)).reshape(-1, len(KINDS)).astype("<u4")
    own, task = ((place[head] >> np.uint64(4)) & np.uint64(0xFFFFF)).astype(np.int64), (place[head] >> np.uint64(24)).astype(np.int64)
    first = np.concatenate([head, [len(place)]])
    cut = np.concatenate([np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1]))), [len(head)]]) if len(head) else [0]
    rows = []
    for i, j in zip(cut[:-1], cut[1:]):
        at, n = own[i:j], counts[i:j]
        rows.append((int(task[i]), keys[at].tobytes(), labels[at].tobytes() if labels[at].any() else b"", sizes[at].astype("<u4").tobytes(), (n.astype("<u2") if n.max() < 1 << 16 else n).tobytes(), _halves(low[first[i] : first[j]])))
    for at in range(0, len(rows), 50):
        yield pd.DataFrame(rows[at : at + 50], columns=["task", "keys", "labels", "sizes", "counts", "body"])


def _index(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], bands: Bands, logdf: np.ndarray, edge: np.ndarray) -> Iterator[pd.DataFrame]:
    """The packed index of (grams, sizes, groups); a set that a task meets again soon isn't indexed twice.

    A band's entries go to the tasks between its two ``edge`` values, by hash: so a document is named in few tasks, and a pair meets in few.
    """
    held: list[tuple[np.ndarray, ...]] = []
    names: list[tuple[np.ndarray, ...]] = []
    have = docs = 0
    known: set[int] = set()
    for gram, size, label in batches:
        key, _ = set_keys(gram, size)
        if len(known) > HELD // 4:
            known.clear()
        fresh = np.zeros(len(key), dtype=bool)
        for i, k in enumerate(key.tolist()):
            fresh[i] = size[i] > 0 and k not in known
            known.add(k)
        gram, size, key, label = gram[np.repeat(fresh, size)], size[fresh], key[fresh], label[fresh]
        sig, doc, role, band = signatures(gram, size, bands, logdf)
        held.append(((edge[band] + (sig >> np.uint64(32)).astype(np.float64) / 2.0**32 * (edge[band + 1] - edge[band])).astype(np.int64), (sig & np.uint64((1 << SIG_BITS) - 1)).astype(np.uint32), (doc + docs).astype(np.int32), role))
        names.append((key, label, size))
        have, docs = have + len(sig), docs + len(size)
        if have > SENT:
            yield from _packed(*(np.concatenate(x) for x in zip(*held)), *(np.concatenate(x) for x in zip(*names)))
            held, names, have, docs = [], [], 0, 0
    if held:
        yield from _packed(*(np.concatenate(x) for x in zip(*held)), *(np.concatenate(x) for x in zip(*names)))


def _short(gram: np.ndarray) -> bytes:
    """Grams in six bytes each."""
    return gram.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : GRAM_BITS // 8].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // GRAM_BITS, 8), dtype=np.uint8)
    out[:, : GRAM_BITS // 8] = np.frombuffer(data, dtype=np.uint8).reshape(-1, GRAM_BITS // 8)
    return out.view("<u8").ravel()


def _unique(pairs: np.ndarray) -> np.ndarray:
    """Distinct rows of pairs, in order."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))] if len(pairs) else pairs


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct numbers, in order, by sorting them: ``np.unique`` puts them into a hash table first, which takes many times as long where most are distinct."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def meetings(entries: np.ndarray, label: np.ndarray, size: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Pairs of different documents, of which one looks for what the other has, but those of one group (``label``, 0: none) and those whose sizes tell that they aren't similar.

    ``entries``: signature << 28 | document << 4 | flags; ``label`` and ``size`` by document. Pairs are a << 32 | b for a < b, distinct and in order within a pass.
    """
    entries = np.sort(entries)
    sig = (entries >> np.uint64(28)).astype(np.uint32)
    head = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, dtype=int)
    many = np.diff(np.concatenate([head, [len(sig)]]))
    both = np.bitwise_or.reduceat((entries & np.uint64(15)).astype(np.uint8), head) if len(head) else np.zeros(0, dtype=np.uint8)
    use = np.repeat((many > 1) & ((both >> 2) & both > 0), many)
    entries, sig = entries[use], sig[use]
    if not len(entries):
        return
    flag = (entries & np.uint64(15)).astype(np.uint8)
    doc = ((entries >> np.uint64(4)) & np.uint64(0xFFFFFF)).astype(np.int64)
    list_ = np.cumsum(np.concatenate(([0], sig[1:] != sig[:-1])))
    # what asks against what is indexed, but the index's run of its own group
    known, group = np.unique(np.concatenate([[0], label]), return_inverse=True)
    zero, group, width = group[0], group[1:], len(known)
    code = list_ * width + group[doc]
    for ask, has in ((ASK_WHOLE, WHOLE), (ASK_LESS, LESS)):
        asks, entry = np.flatnonzero(flag & ask), np.flatnonzero(flag & has)
        own = code[entry]
        if (own[1:] < own[:-1]).any():
            order = np.argsort(own, kind="stable")
            entry, own = entry[order], own[order]
        start = list_[asks] * width
        low, high = np.searchsorted(own, start), np.searchsorted(own, start + width)
        free = group[doc[asks]] == zero
        left = np.where(free, low, np.searchsorted(own, code[asks]))
        right = np.where(free, low, np.searchsorted(own, code[asks], side="right"))
        for a, b in ((low, left), (right, high)):
            ahead = b - a
            some = np.flatnonzero(ahead > 0)
            upto = np.cumsum(ahead[some])
            at = 0
            while at < len(some):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
                mine = some[at:to]
                n = ahead[mine]
                x = np.repeat(doc[asks[mine]], n)
                y = doc[entry[np.repeat(a[mine] - (np.cumsum(n) - n), n) + np.arange(len(x))]]
                r, s = size[x], size[y]
                ok = (x != y) & (np.minimum(r, s) >= least * np.maximum(r, s) - 1e-9)
                x, y = x[ok], y[ok]
                yield _distinct((np.minimum(x, y) << 32) | np.maximum(x, y))
                at = to


def _matrix(grams: list[np.ndarray], left: int) -> np.ndarray:
    """How many grams each of the first ``left`` sets shares with each of the others; with each of them all where ``left`` is their number."""
    n = len(grams)
    size = np.array([len(g) for g in grams])
    of = np.repeat(np.arange(n), size)
    token, inverse, df = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    rows, columns = left, n if left == n else n - left
    out = np.zeros((rows, columns), dtype=np.float32)
    dense = df > max(1, n // 8)
    number = np.cumsum(dense) - 1
    hit = dense[inverse]
    where, row = number[inverse[hit]], of[hit]
    width = int(dense.sum())
    for a in range(0, width, 1024):  # grams of many: a product of matrices
        some = (where >= a) & (where < a + 1024)
        m = np.zeros((n, min(1024, width - a)), dtype=np.float32)
        m[row[some], where[some] - a] = 1
        out += m[:left] @ (m if left == n else m[left:]).T
    rare = np.flatnonzero(~dense[inverse] & (df[inverse] > 1))  # grams of few: each pair of them
    if len(rare):
        rare = rare[np.argsort(inverse[rare], kind="stable")]
        t, r = inverse[rare], of[rare]
        stop = np.searchsorted(t, t, side="right")
        ahead = stop - np.arange(len(t)) - 1
        use = np.flatnonzero(ahead > 0)
        upto = np.cumsum(ahead[use])
        at, flat = 0, out.reshape(-1)
        while at < len(use):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            mine = use[at:to]
            i = np.repeat(mine, ahead[mine])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(ahead[mine]) - ahead[mine], ahead[mine])
            x, y = r[i], r[j]
            if left == n:
                place = np.concatenate([x * columns + y, y * columns + x])
            else:
                across = (x < left) != (y < left)
                place = np.minimum(x, y)[across] * columns + np.maximum(x, y)[across] - left
            flat += np.bincount(place, minlength=len(flat)).astype(np.float32)
            at = to
    return out


def _forest(linked: np.ndarray, square: bool) -> list[tuple[int, int]]:
    """Pairs (first, other) that connect what a matrix of links connects; columns of one that isn't square are numbered after its rows."""
    rows, columns = linked.shape
    n = rows if square else rows + columns
    left = np.ones(n, dtype=bool)
    out = []
    for root in range(rows):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            if square:
                reach = linked[front].any(0)
            else:
                reach = np.zeros(n, dtype=bool)
                reach[rows:] = linked[front[front < rows]].any(0)
                reach[:rows] = linked[:, front[front >= rows] - rows].any(1)
            front = np.flatnonzero(reach & left)
            left[front] = False
            out += [(root, int(x)) for x in front]
    return out


def _wide(size: np.ndarray) -> np.ndarray:
    """Bytes of the sketches of sets of these sizes."""
    return np.maximum(8, 2 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)) >> 3


class _Sketches:
    """The sketches of sets, in the order that they come in; ``mb``: megabytes of them that a pass over pairs takes."""

    def __init__(self, blobs: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], mb: int):
        self.mb = mb
        keys, wides, rows = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], {}
        for key, size, bits in blobs:
            wide = _wide(size)
            first = np.cumsum(wide) - wide
            for w in np.unique(wide).tolist():
                at = np.flatnonzero(wide == w)
                step = max(1, 1_000_000 // w)
                rows.setdefault(w, []).extend(bits[(first[at[u : u + step], None] + np.arange(w)).ravel()].reshape(-1, w) for u in range(0, len(at), step))
            keys.append(key)
            wides.append(wide)
        self.key, self.wide = np.concatenate(keys), np.concatenate(wides)
        # the sketches of each width, a row each, in words
        self.widths = np.array(sorted(rows), dtype=np.int64)
        self.kind = np.searchsorted(self.widths, self.wide).astype(np.uint8)
        self.row, self.rows = np.zeros(len(self.key), dtype=np.int64), {}
        for k, w in enumerate(self.widths.tolist()):
            at = np.flatnonzero(self.kind == k)
            self.row[at] = np.arange(len(at))
            self.rows[w] = np.concatenate(rows.pop(w)).view(np.uint64 if w >= 8 else np.uint8)

    def parted(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places in which the sketches of each pair differ, the longer folded to the shorter: at most the grams that the sets differ in."""
        out = np.zeros(len(x), dtype=np.int64)
        code = (self.kind[x].astype(np.uint16) << np.uint16(8)) | self.kind[y]
        for c in np.flatnonzero(np.bincount(code, minlength=1)).tolist():
            i, j = divmod(c, 256)
            a, b = int(self.widths[i]), int(self.widths[j])
            at, short = np.flatnonzero(code == c), min(a, b)
            step = max(1, self.mb * 1_000_000 // max(a, b))
            for u in range(0, len(at), step):
                some = at[u : u + step]
                p, q = self._folded(x[some], a, short), self._folded(y[some], b, short)
                out[some] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
        return out

    def _folded(self, of: np.ndarray, wide: int, short: int) -> np.ndarray:
        rows = self.rows[wide][self.row[of]]
        while short >= 8 and rows.shape[1] * 8 > short:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        if wide > short and short < 8:
            rows = np.bitwise_xor.reduce(rows.view(np.uint8).reshape(len(of), wide // short, short), axis=1)
        return rows if short < 8 or rows.dtype == np.uint64 else np.ascontiguousarray(rows).view(np.uint64)


class _Stored:
    """A written table (band, key1, size, sketch), of which tasks read the sketches of some bands and keys, in a thread only and a megabyte at a time."""

    def __init__(self, path: str):
        self.system, at = FileSystem.from_uri(path)
        self.parts = [(x.path, self._open(x.path)[1].metadata) for x in self.system.get_file_info(FileSelector(at)) if x.path.endswith(".parquet")]

    def _open(self, path: str, known: FileMetaData | None = None) -> tuple[NativeFile, ParquetFile]:
        file = self.system.open_input_file(path)
        return file, ParquetFile(file, metadata=known, buffer_size=1 << 20, pre_buffer=False)

    @staticmethod
    def _span(group: RowGroupMetaData, name: str) -> tuple[float, float]:
        """The least and greatest value of a column in a group of rows."""
        found = next(x.statistics for x in map(group.column, range(group.num_columns)) if x.path_in_schema == name)
        return (found.min, found.max) if found is not None and found.has_min_max else (-math.inf, math.inf)

    def read(self, bands: np.ndarray, ranges: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, sizes, bits) of the sets of these bands whose keys lie in one of the ranges, both ends included."""
        for path, known in self.parts:
            groups = []
            for g in range(known.num_row_groups):
                (a, b), (lo, hi) = (self._span(known.row_group(g), x) for x in ("band", "key1"))
                if ((bands >= a) & (bands <= b)).any() and any(x <= hi and y >= lo for x, y in ranges):
                    groups.append(g)
            if not groups:
                continue
            file, part = self._open(path, known)
            with file:
                for batch in part.iter_batches(8192, row_groups=groups, columns=["band", "key1", "size", "sketch"], use_threads=False):
                    key = batch.column("key1").to_numpy()
                    keep = np.isin(batch.column("band").to_numpy(), bands) & np.logical_or.reduce([(key >= x) & (key <= y) for x, y in ranges])
                    batch = batch.filter(pa.array(keep))
                    if not len(batch):
                        continue
                    sketch = batch.column("sketch")
                    _, ends, bits = sketch.buffers()
                    ends = np.frombuffer(ends, dtype=np.int32)[sketch.offset : sketch.offset + len(sketch) + 1]
                    yield key[keep], batch.column("size").to_numpy(), np.frombuffer(bits, dtype=np.uint8)[ends[0] : ends[-1]]


def _survivors(buckets: list[np.ndarray], key: np.ndarray, label: np.ndarray, size: np.ndarray, bands: Bands, stored: _Stored, limit: int = SKETCHED) -> Iterator[np.ndarray]:
    """Of the pairs that meet in ``buckets`` of entries (their documents: places in ``key``), those whose sketches don't tell that they differ in too much: a << 32 | b.

    Where the sketches are of more than ``limit`` bytes, keys are in blocks of half of that, and looked at two blocks at a time. ``buckets`` is emptied.
    """
    upto = np.cumsum(_wide(size))
    n = 1 if upto[-1] <= limit else max(2, math.ceil(2 * upto[-1] / limit))
    block = np.minimum((upto - 1) * n // upto[-1], n - 1)
    own = np.unique(bands.of(size))
    for i, j in [(i, j) for i in range(n) for j in range(i + 1, n)] or [(0, 0)]:
        mine = (block == i) | (block == j)
        ranges = [(int(key[at[0]]), int(key[at[-1]])) for at in (np.flatnonzero(block == k) for k in {i, j}) if len(at)]
        if not ranges:
            continue
        bits = _Sketches(stored.read(own, ranges), 1)
        # a set with another of its name, or without a sketch, is near all that it meets
        place = np.searchsorted(key, bits.key)
        there = key[np.minimum(place, len(key) - 1)] == bits.key
        row, times = np.zeros(len(key), dtype=np.int64), np.bincount(place[there], minlength=len(key))
        row[place[there]] = np.flatnonzero(there)
        for k in range(len(buckets)):
            entries = buckets[k]
            if n > 1:
                entries = entries[mine[((entries >> np.uint64(4)) & np.uint64(0xFFFFFF)).astype(np.int64)]]
            else:
                buckets[k] = entries[:0]
            for pairs in meetings(entries, label, size, bands.least):
                a, b = pairs >> 32, pairs & 0xFFFFFFFF
                if n > 1:  # a block's own pairs are looked at with the next block's, the last one's with those before
                    fit = (block[a] != block[b]) | ((j == i + 1) & ((block[a] == i) | (j == n - 1)))
                    pairs, a, b = pairs[fit], a[fit], b[fit]
                sure = (times[a] == 1) & (times[b] == 1)
                near = ~sure
                x, y = (a, b) if sure.all() else (a[sure], b[sure])
                near[sure] = bits.parted(row[x], row[y]) <= bands.differ(size[x], size[y])
                yield pairs[near]
        del bits


class Join:
    """The self-join's tables: ``ids`` (id, key1, key2, size), one row a document with a set, and what was found on distinct sets."""

    def __init__(self, docs: DataFrame, n: int = 2, least: float = 0.75, key: str = "doc_id", text: str = "text", ratio: float = 1.67, slack: float = 0.7, block: int = BLOCK):
        self.n, self.least, self.id_type = n, least, docs.schema[key].dataType
        self.docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        self.bands = Bands(least, ratio, slack)
        self.block = block
        once = materialise(self._ids())
        some = once.filter("key1 is not null")
        self.ids = some.select("id", "key1", "key2", "size")
        #: documents without a set
        self.none = once.filter("key1 is null and part is null").select("id")
        counted = collect_blobs(once.filter("part is not null").select("part", "data"), (1 << DF_BITS) + 1 + len(self.bands.top))
        #: documents of each bucket of grams, over all documents, their number, and the grams of each band's
        self.df, self.n_docs, self.grams = counted[: 1 << DF_BITS], int(counted[1 << DF_BITS]), counted[(1 << DF_BITS) + 1 :]
        self.grouped = self._grouped(self._loose(some.select("key1", "low", "bands")))
        self.ids, self.none = materialise(self.ids), materialise(self.none)
        stored = materialise(self._stored(some))
        discard(once)
        near = materialise(self._near(self._candidates(stored)))
        #: pairs of sets that aren't of one group
        placed = materialise(self._placed(near))
        self.apart = materialise(self._verified(placed))
        discard(stored, near, placed)

    def _ids(self) -> DataFrame:
        """In one pass over the texts, a row for each document that has a set, and each task's document frequencies."""
        n, bands = self.n, self.bands
        columns = ["id", "key1", "key2", "size", "sketch", "low", "bands", "part", "data"]

        @lean
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, docs, grams = np.zeros(1 << DF_BITS, dtype=np.int64), 0, np.zeros(len(bands.top), dtype=np.int64)
            for pdf in pieces(batches, "text"):
                gram, size = gram_sets(pdf["text"].tolist(), n)
                total += np.bincount((gram >> np.uint64(GRAM_BITS - DF_BITS)).astype(np.int64), minlength=1 << DF_BITS)
                docs += int((size > 0).sum())
                grams += np.bincount(bands.of(size), weights=size, minlength=len(grams)).astype(np.int64)
                a, b = set_keys(gram, size)
                low, band = minima(gram, size)
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "key1": a, "key2": b, "size": size, "sketch": sketches(gram, size), "low": [x.tobytes() for x in low], "bands": [x.tobytes() for x in band], "part": None, "data": None})[size > 0]
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[size == 0]}, columns=columns).astype(object).where(lambda x: x.notna(), None)
            yield blob_rows(np.concatenate([total, [docs], grams])).reindex(columns=columns).astype(object).where(lambda x: x.notna(), None)

        return self.docs.mapInPandas(work, f"id {self.id_type.simpleString()}, key1 long, key2 long, size long, sketch binary, low binary, bands binary, part int, data binary")

    def _loose(self, rows: DataFrame) -> DataFrame:
        """(key1, label, blocks): sets that are put together, the groups' names and in how many blocks they are.

        Sets with a band of minima in common are compared, by all their minima, with the first of those that have it; a task does so with
        its own rows before they are sent, so that a group of any size is sent a few times a task.
        """

        def compared(batches: Iterator[pd.DataFrame], firsts: int) -> Iterator[pd.DataFrame]:
            """Of rows in order of sig, those that begin a group, and (key, leader) for those that join one."""
            at, lead = None, []
            for pdf in batches:
                sig, key, leader, low = pdf["sig"].to_numpy(), pdf["key"].to_numpy(), pdf["leader"].tolist(), pdf["low"].tolist()
                alone = np.ones(len(sig), dtype=bool)
                same = sig[1:] == sig[:-1]
                alone[1:] &= ~same
                alone[:-1] &= ~same
                alone[[0, -1]] = False
                keep = alone.copy()
                to: list = [None] * len(sig)
                for i in np.flatnonzero(~alone).tolist():
                    if low[i] is None:  # an edge that is known
                        keep[i], to[i] = True, leader[i]
                        continue
                    if sig[i] != at:
                        at, lead = sig[i], []
                    mine = np.frombuffer(low[i], dtype=np.uint8)
                    for k, x in lead:
                        if k == key[i]:
                            break
                        if int((x == mine).sum()) >= AGREE:
                            keep[i], to[i] = True, k
                            break
                    else:
                        keep[i] = True
                        if len(lead) < firsts:
                            lead.append((int(key[i]), mine))
                yield pd.DataFrame({"sig": sig[keep], "key": key[keep], "low": [x if y is None else None for x, y, k in zip(low, to, keep) if k], "leader": np.array([y or 0 for y, k in zip(to, keep) if k], dtype=np.int64)})

        @lean
        def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def told() -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    pdf = pdf.drop_duplicates("key1")
                    band = np.frombuffer(b"".join(pdf["bands"]), dtype=np.int64).reshape(len(pdf), -1)
                    key = np.repeat(pdf["key1"].to_numpy(), band.shape[1])
                    order = np.lexsort((key, band.ravel()))
                    yield pd.DataFrame({"sig": band.ravel()[order], "key": key[order], "low": pdf["low"].to_numpy().repeat(band.shape[1])[order], "leader": 0})

            for pdf in told():
                yield from compared(iter([pdf]), FIRSTS)

        @lean
        def theirs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in compared((x for x in batches if len(x)), FIRSTS):
                edge = pdf[pdf["low"].isna()]
                yield pd.DataFrame({"x": edge["key"], "y": edge["leader"]})

        schema = "sig long, key long, low binary, leader long"  # leader: where there are no minima
        sent = rows.mapInPandas(mine, schema)
        edge = sent.repartition("sig").sortWithinPartitions("sig", "key").mapInPandas(theirs, "x long, y long").filter("x <> y")
        edge = materialise(edge.union(edge.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
        # any labels will do: a few rounds, whether they have settled or not
        label = edge.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("v"), F.least("x", "m").alias("l"))
        for _ in range(3):
            label = materialise(label)
            label = _hooked(edge, label).select("v", F.col("new").alias("l"))
        label = materialise(label)
        blocks = label.groupBy("l").agg(F.ceil(F.count("*") / F.lit(self.block)).cast("int").alias("blocks"), F.count("*").alias("c"))
        return materialise(label.join(blocks, "l").filter("c > 1").select(F.col("v").alias("key1"), F.when(F.col("l") == 0, 1).otherwise(F.col("l")).alias("label"), "blocks"))

    def _sets(self, keys: DataFrame, extra: tuple[str, ...] = ()) -> tuple[np.ndarray, DataFrame]:
        """A bitmap of documents, one for each set whose key1 is in ``keys``, and the sets (key1, key2, size, grams) of all documents in it.

        The bitmap has a fixed size: it spares other documents the work and the way to a join, which is what decides.
        """
        n = self.n
        one = self.ids.groupBy("key1", "key2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("x")).join(keys.select("key1"), "key1", "left_semi").select(F.col("x.id").alias("id"))
        slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int").alias("slot")
        packed = slots(one.select(slot), SLOTS)

        @lean
        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            marked = np.unpackbits(packed).astype(bool)
            known: set[int] = set()
            for pdf in pieces((x[marked[x["slot"].to_numpy(dtype=np.int64)]] for x in batches), "text"):
                gram, size = gram_sets(pdf["text"].tolist(), n)
                a, b = set_keys(gram, size)
                ends = np.cumsum(size)
                fresh = size > 0
                for i, k in enumerate(a.tolist()):
                    fresh[i] &= k not in known
                known.update(a.tolist() if len(known) < HELD // 4 else ())
                some = np.flatnonzero(fresh)
                yield pd.DataFrame({"key1": a[some], "key2": b[some], "size": size[some], "grams": [_short(gram[ends[i] - size[i] : ends[i]]) for i in some]})

        return packed, self.docs.select("text", slot).mapInPandas(sets, "key1 long, key2 long, size long, grams binary")

    def _grouped(self, labels: DataFrame) -> DataFrame:
        """(key1, key2, size, grams, label, blocks) of the sets that are in a group; also sets ``slots_of``, the bitmap of theirs."""
        self.slots_of, sets = self._sets(labels)
        return materialise(sets.join(labels, "key1", "left"))

    def _stored(self, rows: DataFrame) -> DataFrame:
        """(band, key1, size, sketch) of each set, in order of band and key, so that a task reads little but what it asks for."""
        band = F.size(F.filter(F.array(*map(F.lit, self.bands.top)), lambda x: x < F.col("size"))).alias("band")
        once = rows.dropDuplicates(["key1", "key2"]).select(band, "key1", "size", "sketch")
        return once.repartitionByRange("band", "key1").sortWithinPartitions("band", "key1")

    def _candidates(self, stored: DataFrame) -> DataFrame:
        """(a, b): the pairs that meet and whose sketches don't tell that they differ in too much, of each task's once, mostly. No similar pair is lost."""
        spark = self.docs.sparkSession
        df, n_docs = self.df, self.n_docs
        logdf = np.log(np.minimum(1.0, (df + 1.0) / max(1, n_docs))).astype(np.float32)
        n, bands, packed = self.n, self.bands, self.slots_of
        path = next((x.rsplit("/", 1)[0] for x in stored.inputFiles()), None)
        # tasks grow with the grams, so that each has about TOGETHER million entries, which it takes a million at a time; a gram has
        # about 1.7 entries in its set's band and 0.8 in the next
        share = 1.7 * self.grams + 0.8 * np.concatenate([[0], self.grams[:-1]])
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 3, math.ceil(share.sum() / (TOGETHER * ENTRIES)), 1)
        edge = np.concatenate([[0], np.cumsum(share)]) / max(share.sum(), 1) * (tasks - 1e-6)

        @lean
        def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            marked = np.unpackbits(packed).astype(bool)
            told = (gram_sets(pdf["text"].tolist(), n) for pdf in pieces((x[~marked[x["slot"].to_numpy(dtype=np.int64)]] for x in batches), "text"))
            yield from _index(((gram, size, np.zeros(len(size), dtype=np.int64)) for gram, size in told), bands, logdf, edge)

        @lean
        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            told = (pdf.iloc[at : at + 500] for pdf in batches for at in range(0, len(pdf), 500))
            yield from _index(((_long(b"".join(pdf["grams"])), pdf["size"].to_numpy(dtype=np.int64), pdf["label"].to_numpy(dtype=np.int64)) for pdf in told), bands, logdf, edge)

        @lean
        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, labels, sizes, docs = [], [], [], 0
            held: list[list[np.ndarray]] = [[] for _ in range(TOGETHER)]
            for pdf in batches:
                for k, g, z, c, body in zip(pdf["keys"], pdf["labels"], pdf["sizes"], pdf["counts"], pdf["body"]):
                    m = len(k) // 8
                    count = np.frombuffer(c, dtype="<u4" if len(c) == 4 * m * len(KINDS) else "<u2").astype(np.int64)
                    keys.append(np.frombuffer(k, dtype=np.int64))
                    labels.append(np.frombuffer(g, dtype=np.int64) if g else np.zeros(m, dtype=np.int64))
                    sizes.append(np.frombuffer(z, dtype="<u4"))
                    low = _wholes(body, int(count.sum()))
                    mine = np.repeat((np.arange(docs, docs + m, dtype=np.uint64)[:, None] << np.uint64(4) | KINDS).ravel(), count) | (low.astype(np.uint64) << np.uint64(28))
                    part = low % np.uint32(TOGETHER)
                    for i in range(TOGETHER):
                        held[i].append(mine[part == i])
                    docs += m
            if not keys:
                return
            # a set has one place, however many blobs name it
            key, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            label = np.zeros(len(key), dtype=np.int64)
            known = np.concatenate(labels)
            some = np.flatnonzero(known)
            label[place[some]] = known[some]
            size, place = np.concatenate(sizes)[first].astype(np.int64), place.astype(np.uint64)
            del keys, labels, sizes, first
            for i in range(TOGETHER):
                entries = np.concatenate(held[i])
                held[i] = (entries & np.uint64(0xFFFFFFFFF000000F)) | (place[((entries >> np.uint64(4)) & np.uint64(0xFFFFFF)).astype(np.int64)] << np.uint64(4))
            del place, entries

            def told(pairs: np.ndarray) -> pd.DataFrame:
                return pd.DataFrame({"a": key[pairs >> 32], "b": key[pairs & 0xFFFFFFFF]})

            known, have = [np.zeros(0, dtype=np.int64)], 0
            for pairs in _survivors(held, key, label, size, bands, _Stored(path)):
                known.append(pairs)
                have += len(pairs)
                if have > 2 * HELD:  # pairs have no bound: no more than these are held
                    known = [_distinct(np.concatenate(known))]
                    have = len(known[0])
                    if have > HELD:
                        yield told(known[0])
                        known, have = [np.zeros(0, dtype=np.int64)], 0
            yield told(_distinct(np.concatenate(known)))

        schema = "task int, keys binary, labels binary, sizes binary, counts binary, body binary"
        slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int").alias("slot")
        blobs = self.docs.select("text", slot).mapInPandas(texts, schema).unionByName(self.grouped.select("grams", "size", F.coalesce("label", F.lit(0)).alias("label")).mapInPandas(sets, schema))
        return blobs.repartitionById(tasks, "task").mapInPandas(meet, "a long, b long")

    def _near(self, met: DataFrame) -> DataFrame:
        """(a, b): each pair to be verified, once."""
        # sets whose first hashes are equal and second ones not: too rare to see, but theirs is the right to be verified
        same = self.ids.groupBy("key1").agg(F.min("key2").alias("lo"), F.max("key2").alias("hi")).filter("lo <> hi").select(F.col("key1").alias("a"), F.col("key1").alias("b"))
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same).distinct()

    def _placed(self, near: DataFrame) -> DataFrame:
        """The pairs (a, b) with the cell that each is verified in.

        Sets with the same least partner lie together, 2,048 at most, so that a set is copied to the cells that its partners
        lie in, one mostly, and not to each partner. Cells grow with the pairs, 300,000 in each in the mean at most.
        """
        least_of = F.least("a", "b").alias("l")
        label = near.select(F.col("a").alias("k"), least_of).union(near.select("b", least_of)).groupBy("k").agg(F.min("l").alias("l"))
        many = label.groupBy("l").agg(F.ceil(F.count("*") / 2048).alias("n"))
        label = materialise(label.join(many, "l").select("k", F.xxhash64("l", F.pmod(F.xxhash64("k"), F.col("n"))).alias("at")))
        cells = max(4 * int(near.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(near.count() / 3e5))
        placed = near.join(label.withColumnsRenamed({"k": "a", "at": "la"}), "a").join(label.withColumnsRenamed({"k": "b", "at": "lb"}), "b")
        return placed.select("a", "b", F.pmod(F.xxhash64(F.least("la", "lb"), F.greatest("la", "lb")), F.lit(cells)).alias("cell"))

    @staticmethod
    def _sent(placed: DataFrame, to: DataFrame) -> DataFrame:
        """Rows of sets, once for each cell that a pair of theirs is looked at in."""
        wanted = placed.select(F.col("a").alias("key1"), F.col("cell").alias("at")).union(placed.select("b", "cell")).distinct()
        return to.join(wanted, "key1")

    def _verified(self, placed: DataFrame) -> DataFrame:
        """(a1, a2, b1, b2, jaccard): pairs of different sets by their hashes; a before b."""
        least = self.least
        keys = placed.select(F.col("a").alias("key1")).union(placed.select("b")).distinct()
        sent = self._sent(placed, materialise(self._sets(materialise(keys))[1]))

        def verify(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
            by: dict[int, list[tuple[int, np.ndarray]]] = {}
            for (k1, k2), g in {(k1, k2): g for k1, k2, g in zip(sets["key1"], sets["key2"], sets["grams"])}.items():
                by.setdefault(k1, []).append((k2, _long(g)))
            out = []
            pairs = pairs.sort_values("a")
            a_of, b_of = pairs["a"].to_numpy(), pairs["b"].to_numpy()
            cut = np.concatenate([np.flatnonzero(np.concatenate(([True], a_of[1:] != a_of[:-1]))), [len(a_of)]]) if len(a_of) else [0]
            for i, j in zip(cut[:-1], cut[1:]):
                a = int(a_of[i])
                for a2, x in by.get(a, ()):
                    others = [(int(b), b2, y) for b in b_of[i:j] for b2, y in by.get(int(b), ()) if (int(b) != a or b2 > a2) and min(len(x), len(y)) >= least * max(len(x), len(y)) - 1e-9]
                    for at in range(0, len(others), 2000):
                        some = others[at : at + 2000]
                        n_of = np.array([len(y) for _, _, y in some])
                        every = np.concatenate([y for _, _, y in some])
                        hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
                        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n_of) - n_of)
                        j_of = both / (len(x) + n_of - both)
                        out += [(a, a2, b, b2, v) for (b, b2, _), v in zip(some, j_of.tolist()) if v >= least - 1e-12]
            return pd.DataFrame(out, columns=["a1", "a2", "b1", "b2", "jaccard"]).astype({"a1": "int64", "a2": "int64", "b1": "int64", "b2": "int64", "jaccard": "float64"})

        schema = "a1 long, a2 long, b1 long, b2 long, jaccard double"
        return placed.groupBy("cell").cogroup(sent.groupBy("at")).applyInPandas(verify, schema)

    def _within(self, pairs: bool) -> DataFrame:
        """Of the groups: (a1, a2, b1, b2, jaccard) of all pairs of their sets, or else, with jaccard null, pairs that connect what is connected, and (a1, a2, links) of each set."""
        least = self.least
        blocks = F.col("blocks")
        own = F.pmod(F.xxhash64("key1", "key2"), blocks)
        sets = self.grouped.filter("label is not null").withColumn("own", own.cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), blocks - 1)))
        sets = sets.select("key1", "key2", "grams", "label", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") > F.least("own", "k")).alias("right"))

        def look(rows: list[tuple]) -> pd.DataFrame | None:
            rows = sorted({(r[4], r[0], r[1]): r for r in rows}.items())
            left = sum(not right for (right, _, _), _ in rows)
            square = bool(rows) and rows[0][1][5] == rows[0][1][6]
            if len(rows) < 2 or not left or (not square and left == len(rows)):
                return None
            grams = [_long(r[2]) for _, r in rows]
            size = np.array([len(g) for g in grams], dtype=np.float64)
            x, y = size[:left], size if square else size[left:]
            both = _matrix(grams, left)
            value = both / (x[:, None] + y[None, :] - both)
            if square:
                np.fill_diagonal(value, -1)
            hit = value >= least - 1e-12
            k1, k2 = np.array([k[1] for k, _ in rows]), np.array([k[2] for k, _ in rows])
            if pairs:
                a, b = np.nonzero(np.triu(hit) if square else hit)
                v = value[a, b]
                b = b if square else b + left
                return pd.DataFrame({"a1": k1[a], "a2": k2[a], "b1": k1[b], "b2": k2[b], "jaccard": v, "links": 0})
            joins = np.array(_forest(hit, square), dtype=np.int64).reshape(-1, 2)
            links = hit.sum(1) if square else np.concatenate([hit.sum(1), hit.sum(0)])
            some = np.flatnonzero(links)
            a, b = np.concatenate([joins[:, 0], some]), np.concatenate([joins[:, 1], np.full(len(some), -1)])
            there = b >= 0
            return pd.DataFrame({"a1": k1[a], "a2": k2[a], "b1": np.where(there, k1[b], 0), "b2": np.where(there, k2[b], 0), "jaccard": None, "links": np.concatenate([np.zeros(len(joins), dtype=np.int64), links[some]])})

        @lean
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, held, out = None, [], []
            for pdf in batches:
                for r in zip(pdf["key1"].tolist(), pdf["key2"].tolist(), pdf["grams"].tolist(), pdf["label"].tolist(), pdf["right"].tolist(), pdf["i"].tolist(), pdf["j"].tolist()):
                    now = (r[3], r[5], r[6])
                    if now != at:
                        out.append(look(held))
                        at, held = now, []
                    held.append(r)
                if out := [x for x in out if x is not None]:
                    yield pd.concat(out)
                    out = []
            if (x := look(held)) is not None:
                yield x

        schema = "a1 long, a2 long, b1 long, b2 long, jaccard double, links long"
        return sets.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInPandas(work, schema)

    def close(self) -> None:
        """Deletes the tables that only pairs are told from."""
        discard(self.grouped, self.apart)

    def pairs(self) -> DataFrame:
        """(a1, a2, b1, b2, jaccard) of all pairs of different sets that are similar, by their hashes."""
        return self.apart.unionByName(self._within(True).drop("links"))

    def rows(self) -> DataFrame:
        """(doc_a, doc_b, jaccard) of all pairs of documents with ids a < b, those with equal sets included."""
        ids = self.ids.filter("id is not null").select("id", "key1", "key2").distinct()
        a, b = ids.select(F.col("id").alias("ia"), F.col("key1").alias("a1"), F.col("key2").alias("a2")), ids.select(F.col("id").alias("ib"), F.col("key1").alias("b1"), F.col("key2").alias("b2"))
        near = self.pairs().join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).filter("ia <> ib").select(F.least("ia", "ib").alias("doc_a"), F.greatest("ia", "ib").alias("doc_b"), "jaccard")
        equal = a.join(b, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("ia") < F.col("ib"))).select(F.col("ia").alias("doc_a"), F.col("ib").alias("doc_b"), F.lit(1.0).alias("jaccard"))
        every = near.unionByName(equal)
        # a pair comes twice only where an id has several sets
        repeated = ids.groupBy("id").count().filter("count > 1").limit(1).count()
        return every.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard")) if repeated else every

    def vertices(self) -> DataFrame:
        """(key1, key2, name, class_id, copies, links) of every set: the name of what links connect it with, the least id in that, its documents, and the other sets it is similar to."""
        within = materialise(self._within(False))
        struct = lambda x: F.struct(F.col(f"{x}1").alias("k1"), F.col(f"{x}2").alias("k2"))
        one = lambda x: self.apart.select(F.col(f"{x}1").alias("key1"), F.col(f"{x}2").alias("key2"), F.lit(1).cast("long").alias("links"))
        links = within.filter("links > 0").select(F.col("a1").alias("key1"), F.col("a2").alias("key2"), "links").union(one("a")).union(one("b")).groupBy("key1", "key2").agg(F.sum("links").alias("links"))
        edge = within.filter("links = 0").select(struct("a").alias("x"), struct("b").alias("y")).union(self.apart.select(struct("a"), struct("b")))
        label = components(edge).select(F.col("v.k1").alias("key1"), F.col("v.k2").alias("key2"), "l")
        every = self.ids.groupBy("key1", "key2").agg(F.min("id").alias("least"), F.count("*").alias("copies")).join(links, ["key1", "key2"], "left")
        every = materialise(every.join(label, ["key1", "key2"], "left"))
        named = every.filter("l is not null").groupBy("l").agg(F.min("least").alias("class_id"))
        found = every.join(named, "l", "left")
        name = F.coalesce("l", F.struct(F.col("key1").alias("k1"), F.col("key2").alias("k2"))).alias("name")
        out = materialise(found.select("key1", "key2", name, F.coalesce("class_id", "least").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links")))
        discard(within, every)
        return out


def _hooked(edge: DataFrame, label: DataFrame) -> DataFrame:
    """(v, new, old): each vertex's label goes to its neighbours' least one and then jumps to that one's own."""
    near = edge.join(label.withColumnsRenamed({"v": "y", "l": "ly"}), "y").groupBy(F.col("x").alias("v")).agg(F.min("ly").alias("n"))
    hooked = label.join(near, "v").select("v", "l", F.least("l", "n").alias("k"))
    return hooked.join(label.withColumnsRenamed({"v": "k", "l": "kl"}), "k", "left").select("v", F.least("k", F.coalesce("kl", "k")).alias("new"), F.col("l").alias("old"))


def components(edge: DataFrame) -> DataFrame:
    """(v, l): each vertex of edges (x, y) with the least vertex that edges connect it with.

    Labels go to the least neighbour's label and then jump (pointer doubling), each round a written table, until nothing changes.
    """
    edge = materialise(edge.union(edge.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = materialise(edge.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("v"), F.least("x", "m").alias("l")))
    while True:
        jumped = materialise(_hooked(edge, label))
        discard(label)
        moved = jumped.filter("new <> old").limit(1).count()
        label = jumped.select("v", F.col("new").alias("l"))
        if not moved:
            return label
        label = materialise(label)
        discard(jumped)


def join(docs: DataFrame, **options) -> DataFrame:
    """(doc_a, doc_b, jaccard): all pairs of documents whose n-gram sets have Jaccard of at least ``least``; as many rows as there are pairs."""
    return Join(docs, **options).rows()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, class_id, copies, links), a row for every row of ``docs``.

    ``links``: how many other sets have Jaccard of at least ``least`` with the document's; all are counted. ``class_id``: the least id of the
    documents that links and equal sets connect it with, ``copies``: documents with its set, itself included. Without words the class is null and both are 0.
    """
    found = Join(docs, key=key, text=text, **options)
    vertices = found.vertices()
    found.close()
    every = found.ids.join(vertices, ["key1", "key2"]).select(F.col("id").alias(key), "class_id", "copies", "links")
    none = found.none.select(F.col("id").alias(key), F.lit(None).cast(found.id_type).alias("class_id"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"))
    return every.unionByName(none)


def _keyed(docs: DataFrame, key: str, text: str, n: int) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, the hashes of each row's set (0 without one), and their names."""
    one, two = fresh(docs, "__set1"), fresh(docs, "__set2")

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            a, b = [], []
            for pdf in pieces(iter([pd.DataFrame({"t": texts})]), "t"):
                gram, size = gram_sets(pdf["t"].tolist(), n)
                x, y = set_keys(gram, size)
                a.append(x)
                b.append(y)
            empty = [np.zeros(0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(a or empty)), pa.array(np.concatenate(b or empty))], [*batch.schema.names, one, two])

    fields = [*docs.schema.fields, StructField(one, LongType()), StructField(two, LongType())]
    return docs.mapInArrow(work, StructType(fields)), one, two


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, unchanged, without all but the first of each group of near copies.

    The first is that of the least id, and of rows of one id with unlike sets that of the least hash; those of another group stay. Of rows
    that repeat both id and set one stays, the least by text and then by the hash of all columns. Rows without id, and those without words, stay.
    Only rows that share a bitmap's slot with one that is decided on are sent to the join.
    """
    found = Join(docs, key=key, text=text, **options)
    some = found.vertices().filter("copies > 1 or links > 0").select("key1", "key2", "name")
    found.close()
    mine = found.ids.filter("id is not null").join(some, ["key1", "key2"]).groupBy("id", "key1", "key2").agg(F.first("name").alias("name"), F.count("*").alias("n"))
    mine = materialise(mine)
    first = mine.groupBy("name").agg(F.min(F.struct("id", "key1", "key2")).alias("f"))
    told = materialise(mine.join(first, "name").withColumn("go", F.col("f") != F.struct("id", "key1", "key2")).filter("go or n > 1").select(F.col("id").alias("__i"), F.col("key1").alias("__a"), F.col("key2").alias("__b"), F.col("go").alias("__g")))
    slot = F.pmod(F.xxhash64("__i"), F.lit(SLOTS)).cast("int").alias("slot")
    packed = slots(told.select(slot), SLOTS)
    marked = in_slots(packed)(F.pmod(F.xxhash64(key), F.lit(SLOTS)))
    clear = docs.filter(~marked)
    keyed, one, two = _keyed(docs.filter(marked), key, text, found.n)
    at = (keyed[key] == told["__i"]) & (keyed[one] == told["__a"]) & (keyed[two] == told["__b"])
    kept = keyed.join(told.filter("__g"), at, "left_anti")
    again = told.filter("not __g")
    if again.limit(1).count():
        at = (kept[key] == again["__i"]) & (kept[one] == again["__a"]) & (kept[two] == again["__b"])
        rank = fresh(kept, "__rank")
        order = Window.partitionBy(key, one, two).orderBy(F.col(text), F.xxhash64(*docs.columns))
        once = kept.join(again, at, "left_semi").withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).drop(rank)
        kept = kept.join(again, at, "left_anti").unionByName(once)
    return clear.unionByName(kept.select(docs.columns))
