"""Shared pieces: shared-folder materialisation and word arithmetic on Arrow buffers."""

from __future__ import annotations

import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the space and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that are worked on at once in a Python worker; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints; a temporary one only where none is set and the session is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of materialised tables by application and scope, for tables made within a scope.
_tables: dict[tuple[str, str], list[str]] = {}
_scope: list[str] = []


@contextmanager
def scope(name: str, frame: DataFrame):
    """Tables materialised inside belong to a named scope; earlier ones of it that the frame does not read are deleted first."""
    spark = frame.sparkSession
    mine = _tables.setdefault((spark.sparkContext.applicationId, name), [])
    if mine:
        read = {found[1] for f in frame.inputFiles() if (found := re.search(r"/tables/([0-9a-f]{32})/", f))}
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in [p for p in mine if p.rsplit("/", 1)[1] not in read]:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
            mine.remove(path)
    _scope.append(name)
    try:
        yield
    finally:
        _scope.pop()


def materialize(frame: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there and lost executors cost nothing done before."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    if _scope:
        _tables.setdefault((spark.sparkContext.applicationId, _scope[-1]), []).append(path)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once per application, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='package-')}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches small enough for texts of any length; workers can import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_key(text: str) -> list:
    """Columns that identify a text: two 64-bit hashes and the length, null read as empty."""
    text = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text, F.octet_length(text)).alias("k2")]


def give_back() -> None:
    """Return freed memory of a Python worker to the system; idle workers are kept for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """A function over Arrow batches whose worker gives its memory back at the end of each task."""

    @wraps(run)
    def lean_run(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean_run


# ---- Arrow buffers ---------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges (i, j) of consecutive rows of at most ``most`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n + 1 offsets into them by row."""
    word = ~_IS_SPACE[data]
    before = np.zeros(len(word) + 1, bool)
    before[1:] = word
    after = before[1:].copy()
    after[:-1] = word[1:]
    after[-1:] = False
    inner = offsets[:-1][offsets[:-1] < len(word)]
    before[inner] = False
    ends = offsets[1:][offsets[1:] > 0]
    after[ends - 1] = False
    starts, stops = np.flatnonzero(word & ~before[:-1]), np.flatnonzero(word & ~after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n + 1:
        size = max(n + n // 4 + 1, 2 * CHUNK_BYTES)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _powers.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


class RangeHash:
    """64-bit hashes of any byte ranges of a buffer, by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.sums[stops] - self.sums[starts]) * self.down[starts] + (stops - starts).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Of every range of ``size`` bytes."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_shingles(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its runs of ``words`` words; fewer words make one shingle, none make none."""
    starts, stops, rows = word_spans(data, offsets)
    hashes = RangeHash(data).of(starts, stops)
    out = []
    if len(hashes) >= words:
        joined = hashes[: len(hashes) - words + 1].copy()
        for j in range(1, words):
            joined = mix(joined) + hashes[j : len(hashes) - words + 1 + j]
        joined = mix(joined)
    for i, j in zip(rows[:-1], rows[1:], strict=True):
        if j - i >= words:
            out.append(np.unique(joined[i : j - words + 1]))
        elif j > i:
            value = hashes[i : i + 1].copy()
            for k in range(i + 1, j):
                value = mix(value) + hashes[k]
            out.append(mix(value + np.uint64(j - i)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
