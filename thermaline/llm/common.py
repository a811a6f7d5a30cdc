"""What the training-data operators share: session settings, written cut points, word rules, packing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in the operators that split on ASCII white space; bytes.split() splits on just these.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_written: list[str] = []


def session(df: DataFrame) -> SparkSession:
    """The session of a frame, with Arrow batches bounded in rows and bytes so that long texts don't fill a worker."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


_tuned: list[int] = []


def _tune() -> None:
    """Once in a worker: large arrays get pages of their own, which freeing them returns; Arrow uses the same allocator."""
    if os.getpid() not in _tuned:
        _tuned.append(os.getpid())
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which otherwise grows to 32 MB
            libc.mallopt(-8, 1)  # M_ARENA_MAX
        pa.set_memory_pool(pa.system_memory_pool())


def _give_back() -> None:
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def mapped(df: DataFrame, apply, schema) -> DataFrame:
    """df.mapInArrow(apply, schema) whose idle workers don't hold on to the memory of their largest task."""

    def run(batches):
        _tune()
        try:
            yield from apply(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='thermaline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession) -> str:
    """A folder name of its own in the shared folder, which purge() deletes."""
    _written.append(f"{shared_dir(spark)}/thermaline-{uuid.uuid4().hex}")
    return _written[-1]


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the frame as Parquet to the shared folder and reads it again."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """materialise(df), and what the metrics (aggregate expressions) say of its rows, without a job of their own."""
    seen = Observation()
    got = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()]))
    return got, seen.get


def purge(spark: SparkSession) -> None:
    """Deletes the cut points written so far. Call it only when every result built on them has been consumed."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def text_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text as binary, null as empty) and nothing else, so that other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * MIX1
    return h ^ (h >> np.uint64(32))


class WordHash(dict):
    """word -> 64-bit hash, filled on demand and emptied when it has LIMIT words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value
        return value

    def many(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def pack(*parts: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays or bytes in one compressed string; unpack() gives them back in order."""
    import zstandard

    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts]
    head = np.array([len(raw), *map(len, raw)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=level).compress(b"".join([head, *raw]))


def unpack(payload: bytes) -> list[bytes]:
    import zstandard

    data = memoryview(zstandard.ZstdDecompressor().decompress(payload))
    n = int(np.frombuffer(data[:8], "<i8")[0])
    sizes = np.frombuffer(data[8 : 8 * (n + 1)], "<i8")
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... lengths[0] of them, then the next, as one array."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])


_BYTE = np.random.default_rng(2).integers(1, 1 << 63, (3, 256), dtype=np.uint64) | np.uint64(1)
_INVERSE = np.uint64(pow(int(MIX2), -1, 1 << 64))
#: Bytes whose words are hashed at once, and those whose powers a worker keeps.
_PIECE = 1 << 18
_USUAL = 2 * _PIECE
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of MIX2 and of its inverse, kept by the worker for pieces of usual length."""
    if len(_powers[0]) < n:
        size = max(n, _USUAL)
        both = [np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, x))) for x in (MIX2, _INVERSE)]
        if n > 2 * _USUAL:
            return both
        _powers[:] = both
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of each word, the same in any block. Sums and powers are as long as a piece of the data and not as
    the block: what lies before a word cancels out."""
    if (np.diff(starts) < 0).any():
        by = np.argsort(starts, kind="stable")
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        return word_hashes(data, starts[by], ends[by], seed)[back]
    out = np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + _PIECE + 1, _PIECE)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            low, high = int(starts[a]), int(ends[a:b].max())
            up, down = _powers_to(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE[seed][data[low:high]] * up[: high - low], out=sums[1:])
            s, e = starts[a:b] - low, ends[a:b] - low
            out[a:b] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as spans of bytes: a place of each distinct word, frequent ones first, the number of each word, and the hashes of
    the distinct ones. Words of one hash are compared byte by byte; where two differ another hash is taken."""
    h = word_hashes(data, starts, ends, seed)
    by = np.argsort(h, kind="stable")
    new = np.append(True, h[by[1:]] != h[by[:-1]])
    at = np.flatnonzero(new)
    rank = np.empty(len(at), np.int64)
    frequent = np.argsort(-np.diff(np.append(at, len(by))), kind="stable")
    rank[frequent] = np.arange(len(at))
    number = np.empty(len(by), np.int64)
    number[by] = rank[np.cumsum(new) - 1]
    first = by[at][frequent]
    same, size = first[number], ends - starts
    other = np.flatnonzero(same != np.arange(len(same)))
    for one in np.split(other, range(1 << 17, len(other), 1 << 17)):
        two = same[one]
        if (size[one] != size[two]).any() or (data[ranges(starts[one], size[one])] != data[ranges(starts[two], size[two])]).any():
            return distinct_words(data, starts, ends, seed + 1)
    return first, number, h[first] if seed == 0 else word_hashes(data, starts[first], ends[first])
