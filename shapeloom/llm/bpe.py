"""Byte-pair encoding and decoding with the vocabulary of a public tokenizer; nothing is trained.

A text is cut by the vocabulary's pattern, and each piece is merged by rank. A piece that the pattern leaves long (no spaces,
or nothing but spaces) is encoded as a tree: halves down to ``leaf`` bytes on their own, then joined. At each join
the tokens around it are encoded again together, in a window that doubles until its first token is the one the left half
has there and its last token the one the right half has; then all that lies outside is right, too: a sequence is the
encoding of its bytes if every two neighbours are the encoding of theirs, and each pair lies in the left half, the
window or the right half.

Texts of up to ``far`` bytes are encoded where they lie, without a shuffle. Longer ones are cut, at places where the pattern
starts a new piece or, in a longer piece, anywhere; the parts are encoded as rows of their own in parallel, and come
together by the text's hash to be joined as above.

Defined cases: a null text has null tokens, an empty one no tokens; nothing is cut off; special tokens' names are ordinary
text; repeated rows get equal tokens; an empty table gives an empty result; other columns pass through, and a column
with the name of an added one is replaced. Decoding null gives null, no tokens an empty text; an id that the vocabulary
lacks, or a null among the ids, makes the text null; bytes that aren't UTF-8 become U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of vocabulary files; a parameter of every function here.
from .common import fresh

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that belongs to it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that go through one pass of a task.
PASS = 4_000_000


class Codec:
    """A vocabulary in memory. Made once a process by ``codec``."""

    def __init__(self, path: str, pattern: str, leaf: int):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.inner = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.pattern = leaf, regex.compile(pattern)
        self.long = regex.compile(r"\S{%d,}+|\s{%d,}+" % (max(1, leaf // 4), max(1, leaf // 4)))
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for b, i in ranks.items():
            self.bytes[i] = b
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.length = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.known = self.length > 0

    def piece(self, data: bytes) -> list[int]:
        """Tokens of a piece that the pattern doesn't cut."""
        if len(data) <= max(2, self.leaf):
            return self.inner._encode_single_piece(data) if data else []
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two neighbouring parts' bytes together, from the tokens of each."""
        if not left or not right:
            return left or right
        width = 4
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.inner._encode_single_piece(b"".join(self.bytes[t] for t in left[i:]) + b"".join(self.bytes[t] for t in right[:j]))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            width *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Parts of one piece joined pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def encode(self, text: str) -> np.ndarray:
        if len(text) * 4 <= self.leaf or not self.long.search(text):
            return self.inner.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        out: list[int] = []
        for m in self.pattern.finditer(text):
            out += self.piece(m.group().encode("utf-8", "surrogatepass"))
        return np.array(out, dtype=np.int32)

    def decode(self, tokens: np.ndarray, count: np.ndarray) -> list[bytes | None]:
        """Bytes of each of several token lists, which lie one after another; None where an id isn't known."""
        inside = (tokens >= 0) & (tokens < self.size)
        safe = np.where(inside, tokens, 0)
        inside &= self.known[safe]
        n = np.where(inside, self.length[safe], 0)
        first = np.cumsum(n) - n
        data = self.flat[np.repeat(self.start[safe] - first, n) + np.arange(int(n.sum()))].tobytes()
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(count)))]
        wrong = np.concatenate(([0], np.cumsum(~inside)))[np.concatenate(([0], np.cumsum(count)))]
        return [None if w else data[a:b] for a, b, w in zip(ends[:-1].tolist(), ends[1:].tolist(), np.diff(wrong).tolist())]

    def cuts(self, text: str, size: int) -> list[tuple[int, bytes]]:
        """The text in parts of about ``size`` bytes: (number of the piece if the part is of one, else -1; bytes)."""
        out: list[tuple[int, bytes]] = []
        held: list[bytes] = []
        have = 0
        for number, m in enumerate(self.pattern.finditer(text)):
            data = m.group().encode("utf-8", "surrogatepass")
            if len(data) > size:
                # white space before it goes piece by piece: alone at the end of a part, its pieces would be one
                tail = len(held)
                while tail and held[tail - 1].decode("utf-8", "surrogatepass").isspace():
                    tail -= 1
                if tail:
                    out.append((-1, b"".join(held[:tail])))
                out += [(number - len(held) + k, held[k]) for k in range(tail, len(held))]
                held, have = [], 0
                out += [(number, data[k : k + size]) for k in range(0, len(data), size)]
                continue
            held.append(data)
            have += len(data)
            if have >= size and not m.group().isspace():  # never between white-space pieces: alone they would be one
                out.append((-1, b"".join(held)))
                held, have = [], 0
        if held:
            out.append((-1, b"".join(held)))
        return out


@lru_cache(maxsize=4)
def codec(path: str = VOCABULARY, pattern: str = PATTERN, leaf: int = 4096) -> Codec:
    return Codec(path, pattern, leaf)


def _passes(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch cut between rows, so that each part has about ``PASS`` characters."""
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PASS, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    """Arrow lists of int32 from arrays; None is null."""
    count = np.array([0 if p is None else len(p) for p in parts], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    values = pa.array(np.concatenate([p for p in parts if p is not None] or [np.zeros(0, dtype=np.int32)]), pa.int32())
    mask = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask) if len(parts) else pa.array([], pa.list_(pa.int32()))


def encode(docs: DataFrame, text: str = "text", to: str = "tokens", count: str = "n_tokens", path: str = VOCABULARY, pattern: str = PATTERN, leaf: int = 4096, far: int = 1 << 22) -> DataFrame:
    """``docs`` with the tokens of ``text`` and their number."""
    fields = [f for f in docs.schema.fields if f.name not in (to, count)]
    names = [f.name for f in fields]
    schema = T.StructType(fields + [T.StructField(to, T.ArrayType(T.IntegerType())), T.StructField(count, T.IntegerType())])
    base = docs.select(names)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, leaf)
        for batch in batches:
            sizes = np.array([len(t) if t is not None else 0 for t in batch.column(text).to_pylist()], dtype=np.int64)
            for part in _passes(batch, sizes):
                tokens = [None if t is None else own.encode(t) for t in part.column(text).to_pylist()]
                n = pa.array([None if t is None else len(t) for t in tokens], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(tokens), n], names=[*names, to, count])

    is_far = F.coalesce(F.octet_length(F.col(text)) > far, F.lit(False))
    done = base.filter(~is_far).mapInArrow(near, schema)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern, leaf)
        for pdf in batches:
            for t in pdf["t"]:
                h = hashlib.sha256(t.encode("utf-8")).hexdigest()
                parts = own.cuts(t, max(1, far // 4))
                for at in range(0, len(parts), 16):
                    some = parts[at : at + 16]
                    yield pd.DataFrame({"h": h, "k": range(at, at + len(some)), "piece": [p for p, _ in some], "data": [b for _, b in some]})

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern, leaf)
        for pdf in batches:
            for h, k, piece, data in zip(pdf["h"], pdf["k"], pdf["piece"], pdf["data"]):
                tokens = own.encode(data.decode("utf-8", "surrogatepass")) if piece < 0 else own.piece(data)
                yield pd.DataFrame({"h": [h], "k": [k], "piece": [piece], "tokens": [np.array(tokens, dtype=np.int32).tobytes()]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        own = codec(path, pattern, leaf)
        pdf = pdf.sort_values("k")
        out: list[np.ndarray] = []
        held: list[list[int]] = []
        at = -1
        for piece, data in zip([*pdf["piece"], -1], [*pdf["tokens"], b""]):
            if held and piece != at:
                out.append(np.array(own.tree(held), dtype=np.int32))
                held = []
            at = piece
            tokens = np.frombuffer(data, dtype=np.int32)
            if piece < 0:
                out.append(tokens)
            else:
                held.append(tokens.tolist())
        return pd.DataFrame({"h": [pdf["h"].iloc[0]], "tokens": [np.concatenate(out)]})

    long = base.filter(is_far)
    once = long.select(F.col(text).alias("t")).distinct()
    rows = once.mapInPandas(cut, "h string, k long, piece long, data binary").repartition("h", "k")
    joined = rows.mapInPandas(leaves, "h string, k long, piece long, tokens binary").groupBy("h").applyInPandas(whole, "h string, tokens array<int>")
    h, own, found = fresh(base, "__h"), fresh(base, "__key"), fresh(base, "__tokens")
    joined = joined.select(F.col("h").alias(h), F.col("tokens").alias(found))
    long = long.withColumn(own, F.sha2(F.col(text), 256)).join(joined, F.col(own) == F.col(h)).select(*names, F.col(found).alias(to), F.size(found).alias(count))
    return done.unionByName(long)


def decode(docs: DataFrame, tokens: str = "tokens", to: str = "text", path: str = VOCABULARY, pattern: str = PATTERN, leaf: int = 4096) -> DataFrame:
    """``docs`` with the text of ``tokens``. One pass, no shuffle."""
    fields = [f for f in docs.schema.fields if f.name != to]
    names = [f.name for f in fields]
    schema = T.StructType(fields + [T.StructField(to, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, leaf)
        for batch in batches:
            lists = batch.column(tokens)
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64) * 4
            for part in _passes(batch, sizes):
                lists = part.column(tokens)
                values = lists.flatten()
                n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
                ids = values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                gone = lists.is_null().to_pylist()
                found = [None if g or b is None else b.decode("utf-8", "replace") for b, g in zip(own.decode(ids, n), gone)]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(found, pa.string())], names=[*names, to])

    return docs.mapInArrow(work, schema)


def default_path(folder: str = os.path.dirname(VOCABULARY), name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a vocabulary in a folder of public tokenizers."""
    return os.path.join(folder, name)
