"""Exact dedup: a counting quotient filter for each partition, merged without loss, then byte verification.

The 64-bit fingerprint of a text is cut into slice (high bits), quotient and remainder. A partition writes one filter a
slice: a bitmap of the quotients that occur, a bitmap that marks the end of each quotient's run, the sorted remainders
and the counters above one. Filters of a slice merge by their sorted remainders, counts add up. Only rows whose
fingerprint has a count above one go on to the comparison of whole texts, which groups by the bytes themselves.

Defined cases: a null text is the empty text; rows with equal text and equal largest doc_id are all marked as kept, and
dedup() returns one of them; null doc_ids lose against any other, a group of null ids only keeps its rows' mark; an
empty table gives no rows; other columns are carried in a struct and can't clash; a very long text is compared whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialise, session, union

SLICE_BITS = 8
#: Rows of a slice that one task merges (some 200 MB): beyond 2^8 times as many, a fingerprint's slice has more bits.
SLICE_ROWS = 4_000_000
#: Rows of a group that meet in one task; larger groups are dealt over tasks by doc_id.
HOT = 200
MAX_SHARES = 10_000
#: Fingerprints that a worker gathers before it sorts them.
SORT_ROWS = 1 << 20
#: Fingerprints with copies are sent to all executors up to this many (16 bytes each), and shuffled beyond.
BROADCAST_ROWS = 1_000_000


def encode_filter(values: np.ndarray, counts: np.ndarray, bits: int = SLICE_BITS) -> bytes:
    """values: sorted distinct fingerprints without their slice bits."""
    n = len(values)
    q = 16 if n >= 1 << 16 else 8 if n >= 1 << 8 else 0
    width = -(-(64 - bits - q) // 8)
    quotient = (values >> np.uint64(8 * width)).astype(np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True)
    remainder = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    many = np.flatnonzero(counts > 1)
    head = np.array([q, n, len(many), width], "<i8")
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (head, np.packbits(occupied), np.packbits(ends), remainder, many.astype("<u4"), counts[many].astype("<i8")))


def decode_filter(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    q, n, k, width = np.frombuffer(data, "<i8", 4).tolist()
    at = 32
    occupied = np.unpackbits(np.frombuffer(data, np.uint8, ((1 << q) + 7) // 8, at), count=1 << q).astype(bool)
    at += ((1 << q) + 7) // 8
    ends = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n)
    at += (n + 7) // 8
    remainder = np.zeros((n, 8), np.uint8)
    remainder[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    run = np.cumsum(ends) - ends
    values = (np.flatnonzero(occupied)[run].astype(np.uint64) << np.uint64(8 * width)) | remainder.view("<u8").ravel()
    counts = np.ones(n, np.int64)
    counts[np.frombuffer(data, "<u4", k, at)] = np.frombuffer(data, "<i8", k, at + 4 * k)
    return values, counts


def merge_filters(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The filter of all rows: equal remainders of a quotient become one, with the sum of their counts."""
    return _counted([decode_filter(x) for x in filters])


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the sums of their counts."""
    values, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], np.add.reduceat(counts, first)


def _build(bits: int):
    def apply(batches):
        parts, held, shift = [], 0, np.uint64(64 - bits)
        for batch in batches:
            new = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if len(new):
                parts.append((new, np.ones(len(new), np.int64)))
                held += len(new)
            if held > max(SORT_ROWS, 2 * len(parts[0][0]) if parts else 0):
                parts = [_counted(parts)]
                held = len(parts[0][0])
        if not parts:
            return
        values, counts = _counted(parts)
        slices = (values >> shift).astype(np.int64)
        at = np.flatnonzero(np.append(True, slices[1:] != slices[:-1]))
        low = values & ((np.uint64(1) << shift) - np.uint64(1))
        for i in range(0, len(at), 4096):
            part = at[i : i + 4096]
            data = [encode_filter(low[a:b], counts[a:b], bits) for a, b in zip(part.tolist(), [*at[i + 1 : i + 4097].tolist(), len(values)][: len(part)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slices[part], pa.int32()), pa.array(data, pa.binary())], ["slice", "filter"])

    return apply


def _merge(bits: int):
    def apply(key, filters):
        values, counts = merge_filters(filters.column("filter").to_pylist())
        full = values[counts > 1] | (np.uint64(key[0].as_py()) << np.uint64(64 - bits))
        return pa.table({"fp": full.view(np.int64), "n": counts[counts > 1]})

    return apply


def repeated_fingerprints(fps: DataFrame) -> DataFrame:
    """fp, n of the fingerprints that more than one row of fps (one bigint column fp) has."""
    bits = min(24, max(SLICE_BITS, (-(-fps.count() // SLICE_ROWS)).bit_length()))
    built = mapped(fps.select("fp"), _build(bits), "slice int, filter binary")
    return built.groupBy("slice").applyInArrow(_merge(bits), "fp long, n long")


def _classify(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    session(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("fp"), *[F.struct("*").alias("row")] * carry)
    dups = materialise(repeated_fingerprints(base))
    small = dups.count() <= BROADCAST_ROWS
    dups = F.broadcast(dups) if small else dups
    rest = [F.col("row")] * carry
    alone = base.join(dups, "fp", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("ties"), F.sha2("text", 256).alias("text_sha256"), *rest)
    shares = F.least(F.floor(F.col("n") / HOT) + 1, F.lit(MAX_SHARES)).cast("int")  # of a fingerprint's rows: one, but for large groups
    some = base.join(dups, "fp").withColumn("shares", shares).withColumn("share", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("shares")).cast("int")).drop("n")
    groups = (
        some.groupBy("fp", "shares", "text", "doc_id").agg(F.count("*").alias("m"))
        .groupBy("fp", "shares", "text").agg(F.max("doc_id").alias("keep_id"), F.sum("m").alias("group_size"), F.max(F.struct("doc_id", "m"))["m"].alias("ties"))
        .withColumn("text_sha256", F.sha2("text", 256)).withColumn("share", F.explode(F.expr("sequence(0, shares - 1)")))
    )
    same = some.alias("a").join(groups.alias("g"), (F.col("a.fp") == F.col("g.fp")) & (F.col("a.share") == F.col("g.share")) & (F.col("a.text") == F.col("g.text")))
    same = same.select("a.doc_id", "g.keep_id", "g.group_size", F.col("a.doc_id").eqNullSafe(F.col("g.keep_id")).alias("kept"), "g.ties", "g.text_sha256", *[F.col("a.row")] * carry)
    return union(alone, same)


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return _classify(docs, id_col, text_col, False).drop("ties")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one for each text, with the columns of docs."""
    got = _classify(docs, id_col, text_col, True).where("kept")
    sole, tied = got.where("ties = 1"), got.where("ties > 1").dropDuplicates(["doc_id", "text_sha256"])
    return union(sole, tied).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mark(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
