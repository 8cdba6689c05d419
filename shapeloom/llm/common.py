"""Shared pieces of the corpus operators: batching, code-point arrays, durable intermediate tables.

Conventions of every operator here: text is never cut, rows are handled in Arrow batches, and nothing
that grows with the corpus is sent to the driver or broadcast.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one numpy pass takes; a longer document is a pass of its own.
BATCH_CHARS = 1_000_000
#: Rows that one numpy pass takes at most.
ROWS = 60_000
#: Spark's setting for deleting the shuffle files of a plan that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is made, in local mode only; a cluster must name one.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="shapeloom-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the plan's own shuffle files go when it is written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for path in df.inputFiles()[:1]:
            at = jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with marks until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lean(work: Callable) -> Callable:
    """A function of batches that gives the memory it has freed back to the system when it ends: an executor's tasks keep their Python."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        trim()

    return run


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches: Iterator[pd.DataFrame], text: str, limit: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """The batches cut between rows so that each has about ``limit`` characters of text; empty ones are left out."""
    for pdf in batches:
        if not len(pdf):
            continue
        ends = np.cumsum(pdf[text].fillna("").str.len().to_numpy(dtype=np.int64))
        at = 0
        while at < len(pdf):
            base = ends[at - 1] if at else 0
            to = min(at + ROWS, max(at + 1, int(np.searchsorted(ends, base + limit, side="right"))))
            yield pdf.iloc[at:to]
            at = to


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a newline after each, and where each text starts (and the end). Null is empty."""
    filled = [t if isinstance(t, str) else "" for t in texts]
    cp = np.frombuffer(("\n".join(filled) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(filled) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in filled], out=starts[1:])
    return cp, starts


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_tables: dict[str, np.ndarray] = {}


def table(kind: str) -> np.ndarray:
    """Lookup by code point: ``alpha``, ``alnum`` (bool) or ``lower`` (the code point in lower case)."""
    if kind not in _tables:
        chars = [chr(i) for i in range(0x110000)]
        if kind == "lower":
            low = [c.lower() for c in chars]
            _tables[kind] = np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], dtype=np.uint32)
        else:
            test = str.isalpha if kind == "alpha" else str.isalnum
            _tables[kind] = np.array([test(c) for c in chars], dtype=bool)
    return _tables[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def word_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``cp[start:end]``: polynomials in an odd base modulo 2**64, mixed.

    Differences of one running sum, brought to a common place by powers of the base's inverse.
    """
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    if not _powers or len(_powers[0]) < len(cp):
        size = max(len(cp), 1 << 20)
        _powers[:] = [np.cumprod(np.full(size, x, dtype=np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    up, down = _powers
    total = np.empty(len(cp) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def add_blobs(df: DataFrame, dtype: str = "int64", bits: bool = False) -> DataFrame:
    """Sums binary arrays by ``part``: rows (part int, data binary) to one row a part. Streams; memory is one array a part.

    With ``bits`` they are joined by OR instead.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for part, data in zip(pdf["part"], pdf["data"]):
                x = np.frombuffer(data, dtype=dtype)
                total[part] = (total[part] | x if bits else total[part] + x) if part in total else x
        yield pd.DataFrame({"part": pd.Series(list(total), dtype="int32"), "data": [x.tobytes() for x in total.values()]})

    return df.repartition("part").mapInPandas(add, "part int, data binary")


def blob_rows(array: np.ndarray, size: int = 8192) -> pd.DataFrame:
    """``array`` cut into rows (part, data) of ``size`` values."""
    cut = range(0, len(array), size)
    return pd.DataFrame({"part": pd.Series(range(len(cut)), dtype="int32"), "data": [array[i : i + size].tobytes() for i in cut]})


def collect_blobs(df: DataFrame, n: int, dtype: str = "int64", bits: bool = False) -> np.ndarray:
    """The summed array of ``n`` values (fixed by a parameter, not by the data); zeros where nothing was counted."""
    rows = {r["part"]: np.frombuffer(r["data"], dtype=dtype) for r in add_blobs(df, dtype, bits).collect()}
    out = np.zeros(n, dtype=dtype)
    size = 8192
    for part, x in rows.items():
        out[part * size : part * size + len(x)] = x
    return out


def viterbi(emission: np.ndarray, length: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best state of every position of many chains at once.

    ``emission``: (positions, K), the chains one after another; ``length``: positions of each chain;
    ``step[i, j]``: score of going from state i to j. On a tie a uniform chain stays, any other takes the lower state.
    """
    n, k = emission.shape
    best = np.zeros(n, dtype=np.int16)
    length = np.asarray(length, dtype=np.int64)
    first = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    if not len(order):
        return best
    length, first = length[order], first[order]
    back = np.zeros((n, k), dtype=np.int8 if k < 127 else np.int16)
    uniform = bool(np.all(np.diag(step) == 0) and len(np.unique(step[~np.eye(k, dtype=bool)])) <= 1)
    penalty = step[0, 1] if uniform and k > 1 else 0
    score = emission[first].astype(np.float64)
    last = np.zeros((len(order), k))
    alive = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
    own = np.arange(k)
    for t in range(1, int(length[0])):
        m = int(alive[t])
        if m < len(score):
            last[m : len(score)] = score[m:]
            score = score[:m]
        at = first[:m] + t
        if uniform:
            top = score.argmax(1)
            peak = score[np.arange(m), top][:, None] + penalty
            stay = score >= peak
            back[at] = np.where(stay, own, top[:, None])
            score = np.where(stay, score, peak) + emission[at]
        else:
            full = score[:, :, None] + step
            came = full.argmax(1)
            back[at] = came
            score = np.take_along_axis(full, came[:, None, :], 1)[:, 0] + emission[at]
    last[: len(score)] = score
    state = last.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        m = int(alive[t])
        at = first[:m] + t
        best[at] = state[:m]
        if t:
            state[:m] = back[at, state[:m]]
    return best


def slots(marks: DataFrame, n: int) -> np.ndarray:
    """A bitmap (packed) of the slots in the one column of ``marks``: fixed in size, whatever the number of rows."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(n, dtype=np.uint8)
        for pdf in batches:
            seen[pdf.iloc[:, 0].to_numpy(dtype=np.int64)] = 1
        yield blob_rows(np.packbits(seen))

    return collect_blobs(marks.mapInPandas(mark, "part int, data binary"), n // 8, "uint8", bits=True)


def in_slots(packed: np.ndarray) -> Callable[[Column], Column]:
    """A test of slot numbers against a bitmap; only the numbers go to Python."""

    @F.pandas_udf("boolean")
    def test(slot: pd.Series) -> pd.Series:
        at = slot.to_numpy(dtype=np.int64)
        return pd.Series((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    return test
