"""What several operators share: written tables in the shared folder, free column names, vectorised words."""

from __future__ import annotations

import gc
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

DEFAULT_SHARED = "/tmp/checkpoints/rowpact-llm"
#: Bytes of text that one vectorised step takes at once (a longer text is a step of its own).
STEP_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local default where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + DEFAULT_SHARED


class Scratch:
    """Tables and files that an operator writes to cut its lineage, below the shared folder.

    What an operator returns reads them, so they stay until the caller is done and calls drop().
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/rowpact-llm-{uuid.uuid4().hex}"
        self._written: dict[str, str] = {}
        self._count = 0

    def stage(self, frame: DataFrame, name: str, **options: str) -> DataFrame:
        """Writes the frame as Parquet and reads it again; its lineage ends there. Options are the writer's."""
        self._count += 1  # names may come again: operators can share a scratch
        to = self._written[name] = f"{self.path}/{self._count:03d}-{name}"
        frame.write.mode("overwrite").options(**options).parquet(to)
        return self.spark.read.schema(frame.schema).parquet(to)

    def tidy(self, *names: str) -> None:
        """Removes written tables that nothing reads any more, and lets Spark's cleaner find the shuffle files of finished work:
        it drops them when the driver's garbage is collected, which may otherwise take half an hour. Twice, as events of the
        query that has just ended may hold its plan for a moment, and with it the largest files."""
        for name in names:
            self._delete(self._written.pop(name))
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)

    def drop(self) -> None:
        self._delete(self.path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Names that no column of the frame has, whatever its extra columns are called."""
    taken = {c.lower() for c in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each value starts (one more than rows); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, starts, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(starts, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(batch: pa.RecordBatch, column: str, step_bytes: int = STEP_BYTES):
    """The batch in slices of a bounded number of text bytes."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // step_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


#: ASCII white space; words are what stands between.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text; is_word says so for each of 256 bytes."""
    inside = is_word[data]
    first, last = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    before[first] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[last] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, at)


_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each of 64 bits over all."""
    h = (h ^ (h >> np.uint64(33))) * _C1
    h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each word, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left, at = end - start, start
    h = mix(left.astype(np.uint64) + np.uint64(1))
    live = None
    while len(left):
        part = mix((h if live is None else h[live]) * np.uint64(0x9E3779B97F4A7C15) + (eight[at] & _MASK[np.minimum(left, 8)]))
        if live is None:
            h = part
        else:
            h[live] = part
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        left, at = left[more] - 8, at[more] + 8
    return h


_ODD = np.random.default_rng(20240607).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """For each start, a hash of that many consecutive word hashes in order."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total += h[j : j + n] * _ODD[j]
    return mix(total)


#: Rows of a lookup table up to which it is broadcast; its rows are counted first, and are narrow.
BROADCAST_ROWS = 50_000


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a written table of one row per key; null equals null.

    A table of more than BROADCAST_ROWS rows is joined by shuffle. Nothing above that join needs the rows of a key together, so
    Spark splits the partitions of a key that a third of all rows share (spark.sql.adaptive.skewJoin).
    """
    names = {k: f"lookup_{n}_{k}" for n, k in enumerate(keys)}
    small = right.withColumnsRenamed(names)
    if right.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return left.join(small, [left[k].eqNullSafe(small[names[k]]) for k in keys], "left").drop(*names.values())


def filesystem(uri: str):
    """The file system of a path in the shared folder, for what tasks write and read themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def read_range(uri: str, start: int, length: int) -> bytes:
    """Bytes of a file; a negative start counts from its end."""
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        size = f.size()
        start = max(0, size + start) if start < 0 else start
        f.seek(start)
        return f.read(min(length, size - start))
