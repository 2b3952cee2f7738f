"""Shared pieces: table reading, materialising in the shared folder, vectorised words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text handled at once by the vectorised helpers (a longer text is handled alone).
SLICE_BYTES = 500_000
#: Texts handled at once at most.
SLICE_ROWS = 1_000

_M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own
    (tests), and a cluster an error, since no machine-local folder is shared."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that scratch() has open, the innermost last.
_SCRATCH: list[str] = []
#: While a table is written: its shuffle files go when the write has ended (nothing reads them again), and Arrow batches are small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside go when it ends: for jobs whose result has been written by then."""
    _SCRATCH.append(f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        delete(spark, _SCRATCH.pop())


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in any store that Spark writes to."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{_SCRATCH[-1] if _SCRATCH else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> DataFrame:
    """df, a table just written: the driver lets go of the plans, broadcast tables and generated classes behind it, as Spark's cleaner has
    it do from time to time. Of a job of many small tables they would else fill its heap to the brim."""
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def shielded(docs: DataFrame, own: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) whose other columns than own have names of their own inside, so that none can clash with what work uses. They come back
    under their names, in their order, before what work adds; one that has the name of an added column gives way to it."""
    others = [c for c in docs.columns if c not in own]
    given = docs.select(*[F.col(f"`{c}`") for c in own], *[F.col(f"`{c}`").alias(f"_given{i}") for i, c in enumerate(others)])
    out = work(given)
    added = [c for c in out.columns if c not in own and not c.startswith("_given")]
    names = {c: c for c in own if c in out.columns} | {c: f"_given{i}" for i, c in enumerate(others) if c not in added}
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns if c in names], *added)


def dropped(*tables: DataFrame) -> None:
    """Remove the files of materialised tables that nothing reads any more."""
    for df in tables:
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        for path in folders:
            delete(df.sparkSession, path)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), bijective."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POW = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the usual slice size."""
    if n > _POW.get("n", 0):
        n = max(n, SLICE_BYTES + 100_000)
        out = []
        for b in (_BASE, _INV):
            a = np.full(n, b & _M64, dtype=np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        if n > 4 * SLICE_BYTES:
            return out[0], out[1]
        _POW.update(n=n, p=out[0], q=out[1])
    return _POW["p"], _POW["q"]


class Words:
    """The words of some texts: byte ranges in data, 64-bit hashes, and first[i]:first[i+1] of text i."""

    __slots__ = ("data", "offsets", "start", "end", "first", "hash")

    def __init__(self, texts: pa.Array, lower: bool = False, hashed: bool = True) -> None:
        self.data, self.offsets = utf8(texts)
        d = self.data
        if lower:
            d = np.where((d >= 65) & (d <= 90), d + np.uint8(32), d).astype(np.uint8)
        word = ~((d == 32) | ((d >= 9) & (d <= 13)))
        n = len(d)
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        prev = np.zeros(n, dtype=bool)
        prev[1:] = word[:-1]
        start = np.flatnonzero(word & (~prev | cut[:n]))
        nxt = np.zeros(n, dtype=bool)
        nxt[:-1] = word[1:]
        end = np.flatnonzero(word & (~nxt | cut[1:])) + 1
        self.start, self.end = start, end
        self.first = np.searchsorted(start, self.offsets)
        if hashed:
            p, q = _powers(n + 1)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[d] * p[:n], out=sums[1:])
            self.hash = mix((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each (null: empty)."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most SLICE_ROWS rows and SLICE_BYTES of text, or one row that is longer."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and (total + size > SLICE_BYTES or i - begin == SLICE_ROWS):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    yield batch.slice(begin)


#: The C library's call that returns free memory to the system, where it has one.
_TRIM = getattr(ctypes.pythonapi, "malloc_trim", None)


def give_back() -> None:
    """Free memory goes back to the system; a worker process, which is used again, would else hold it from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow(), with give_back() when it has ended and its arrays are gone."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def _windows(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    mult = 1
    for i in range(k):
        mult = (mult * 0x9FB21C651E98DF25 + 2 * i + 2) & _M64 | 1
        out += hashes[i : n + i] * np.uint64(mult)
    return mix(out + np.uint64(k))


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of each k-word window; of the whole sequence where it is shorter; none of none."""
    return _windows(hashes, min(k, len(hashes))) if len(hashes) else hashes


def shingles_of(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of every text, one text after the other, and the number of the text each belongs to."""
    size = np.diff(words.first)
    text = np.repeat(np.arange(len(size)), size)
    if (size >= k).any():
        whole = text[: len(text) - k + 1] == text[k - 1 :]
        found, of = _windows(words.hash, k)[whole], text[: len(text) - k + 1][whole]
    else:
        found, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        more = np.array([_windows(words.hash[words.first[i] : words.first[i + 1]], int(size[i]))[0] for i in short], np.uint64)
        at = np.searchsorted(of, short)
        found, of = np.insert(found, at, more), np.insert(of, at, short)
    return found, of
