"""What the operators share: staging in the cluster's folder, Arrow batches, and hashes of words in numpy.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``. UTF-8 never uses those bytes inside a
longer character, so words are cut on the raw Arrow buffer without building one Python string per word.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch handed to Python.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
#: Words longer than so many bytes are hashed one at a time.
LONG = 128
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# --------------------------------------------------------------------------- staging


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local one is made, which only a local master allows."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexspark-"))
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage is cut, and a lost executor costs nothing.

    Shuffle files of the finished write are of no use to anybody afterwards and are removed with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexspark_path = path
    return out


def unstage(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_lexspark_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lower the rows and bytes of an Arrow batch where the session allows more: texts can be long."""
    for key, most, default in (("maxRecordsPerBatch", rows, "10000"), ("maxBytesPerBatch", size, "67108864b")):
        key = "spark.sql.execution.arrow." + key
        now = int(spark.conf.get(key, default).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch; empty batches are skipped."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df bears it, whatever the case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


# --------------------------------------------------------------------------- hashes

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = (np.uint64(x) for x in (30, 27, 31))
_BOTH = np.uint64(0xD1342543DE82EF95)
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the low n bytes of eight

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if at is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = _SOLID[data]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[edge] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: its length, then its bytes eight at a time, mixed after each step. Different seeds give
    unrelated hashes. Words of more than LONG bytes go through BLAKE2, so a step serves many words or none."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    length = ends - starts
    out = mix((length.astype(np.uint64) + np.uint64(seed)) * _BOTH)
    live, at = np.flatnonzero(length <= LONG), 0
    while len(live):
        out[live] = mix(out[live] ^ (eight[starts[live] + at] & _TAIL[np.minimum(length[live] - at, 8)]))
        at += 8
        live = live[length[live] > at]
    for j in np.flatnonzero(length > LONG).tolist():
        raw = hashlib.blake2b(data[starts[j] : ends[j]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[j] = int.from_bytes(raw, "little")
    return out


def hash_runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k consecutive words, put together of runs of doubled length, each step mixed; runs across
    texts are the caller's to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, level, size = None, 0, words, 1
    while True:
        if k & size:
            out = level[: len(words) - size + 1] if out is None else mix(out[: len(words) - have - size + 1] * _BOTH + level[have:])
            have += size
        if have == k:
            return out[:n]
        level, size = mix(level[:-size] * _BOTH + level[size:]), 2 * size


class Words:
    """Word hashes of the texts of one Arrow column. lower: A-Z count as a-z."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = buffers(column)
        if lower:
            self.data = LOWER[self.data]
        self.starts, self.ends, self.first = cut_words(self.data, self.offsets)

    @cached_property
    def hashes(self) -> np.ndarray:
        return hash_words(self.data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.first) - 1

    def count(self, i: int) -> int:
        return int(self.first[i + 1] - self.first[i])

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def numbers(self) -> np.ndarray:
        """A number for each word, the same for the same bytes and for no others."""
        solid = self.data[_SOLID[self.data]]
        ends = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=ends[1:])
        column = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(solid)])
        return np.asarray(column.dictionary_encode().indices)

    def joined(self, i: int) -> tuple[bytes, np.ndarray]:
        """The words of a text joined by one space, and where each starts there; one more for the end and a space."""
        data = self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()
        starts, ends = self.spans(i)
        at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts + 1, out=at[1:])
        return b" ".join(data.translate(_SPACES).split()), at

    def spans(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[self.first[i] : self.first[i + 1]], self.ends[self.first[i] : self.first[i + 1]]


_SPACES = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of numpy arrays."""
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))
