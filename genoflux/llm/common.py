"""Helpers that the operators of this subpackage share: scratch tables in the cluster's shared folder, and a numpy
word and shingle kernel over Arrow string columns.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows and bytes of an Arrow batch of texts, so that a worker holds few texts at a time however long they are.
BATCH_ROWS, BATCH_BYTES = 1000, "4m"


def lean_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches; a tighter bound on rows that is set already stays."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_held: dict = {}


def held_by_worker(key, make):
    """make()'s object, which a Python worker holds for its next tasks. It holds one such object at a time."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Called where a task needs no such object: what earlier operators left in this worker is freed, and handed back to the system."""
    if not _held:
        return
    import ctypes
    import gc

    import pyarrow as pa

    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, in local mode (tests), a
    temporary folder of this machine. On a cluster an unset folder is an error, as executors don't see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='genoflux-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder. They cut lineage: a lost executor costs a reread, not a recomputation. Those that
    aren't dropped before are deleted when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/genoflux-{uuid.uuid4().hex}"
        self.n = 0

    def _path(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def new_path(self) -> str:
        """A path of this object that isn't written yet."""
        self.n += 1
        if self.n == 1:
            top, files = self._path(self.root)
            files.mkdirs(top)  # only what exists can be marked
            files.deleteOnExit(top)
        return f"{self.root}/{self.n}"

    def write(self, df: DataFrame) -> DataFrame:
        path = self.new_path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            path, files = self._path(t.scratch_path)
            files.delete(path, True)


# --- words and shingles -------------------------------------------------------------------------------------------


def byte_table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z, on UTF-8 bytes.
ALNUM_WORDS = byte_table(lambda b: b >= 0x80 or chr(b).isalnum())
#: Words [^\x20\x09-\x0D]+.
SPACE_WORDS = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A random value for each byte; upper-case letters share that of their lower case.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))[_LOWER]
_M = 0x9E3779B97F4A7C15
_MINV = pow(_M, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            out[done : 2 * done] = out[:done] * step
            done *= 2
        have = out
        if size <= 1 << 20:  # larger ones, for very long texts, aren't kept
            _powers[base] = have
    return have[:n]


class Words:
    """The words of consecutive texts: begin and end byte of each, its 64-bit hash, and where each text's words start."""

    __slots__ = ("begin", "end", "hash", "first", "data", "text_start")

    def __init__(self, data: np.ndarray, text_start: np.ndarray, table: np.ndarray):
        """text_start: offset of each text, and the end of the last."""
        self.data, self.text_start = data, text_start
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = table[data]
        before, after = inside[:-2].copy(), inside[2:].copy()
        starts = text_start[:-1][text_start[:-1] < n]
        before[starts] = False
        ends = text_start[1:][text_start[1:] > 0] - 1
        after[ends] = False
        self.begin = np.flatnonzero(inside[1:-1] & ~before)
        self.end = np.flatnonzero(inside[1:-1] & ~after) + 1
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[data] * powers(_M, n), out=total[1:])
            self.hash = mix((total[self.end] - total[self.begin]) * powers(_MINV, n + 1)[self.begin])
        self.first = np.searchsorted(self.begin, text_start)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether all k lie in one text."""
        n = len(self.hash)
        out = np.zeros(n, np.uint64)
        ok = np.zeros(n, bool)
        if n >= k:
            with np.errstate(over="ignore"):
                acc = np.zeros(n - k + 1, np.uint64)
                for j in range(k):
                    acc = acc * np.uint64(0xBF58476D1CE4E5B9) + self.hash[j : n - k + 1 + j]
                out[: n - k + 1] = mix(acc)
            last = np.repeat(self.first[1:], np.diff(self.first))
            ok = np.arange(n) + k <= last
        return out, ok

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, lower-cased and joined by a space."""
        low, data = _LOWER, self.data
        return b" ".join(low[data[b:e]].tobytes() for b, e in zip(self.begin[i:j].tolist(), self.end[i:j].tolist()))


def string_buffers(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An Arrow string column's bytes, its offsets (n + 1 long, from 0) and which rows are null; a null has no bytes."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type) or not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    null = np.asarray(column.is_null())
    if null.any():
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) > 1 else np.empty(0, np.uint8)
    return raw, off - off[0], null


def chunks(offsets: np.ndarray, most: int = 1 << 19):
    """Row ranges of about `most` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_chunks(column, table: np.ndarray):
    """(first row, end row, Words) over an Arrow string column, in pieces that fit the CPU's cache."""
    raw, off, _ = string_buffers(column)
    for i, j in chunks(off):
        yield i, j, Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], table)
