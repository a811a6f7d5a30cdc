"""Windows of words dealt by minimisers: what both substring operators share.

A minimiser of a window of WINDOW words is the least hash of its GRAM-word runs, so equal windows have equal minimisers.
First scan: count how often each minimiser is selected; those selected twice or more set a bit of a bitmap of fixed size
(BITMAP_BITS), which is all that is broadcast. A minimiser that is selected once in the whole corpus can't belong to a
repeated window; a bitmap that fills up only lets more through. Second scan: the slices of text around the remaining
selections are packed by bucket of the minimiser; equal slices of a batch travel once, with the list of their places.
Minimisers selected more than `hot` times are split: their windows travel alone and are dealt by their whole content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX1, MIX2, WordHash, mapped, materialise, mix64, pack, session, union, unpack

WINDOW, GRAM = 50, 8
BITMAP_BITS = 1 << 27
BUCKET_BYTES = 8 << 20
#: At most so many minimisers are treated as hot: `hot` is raised until this bound holds by arithmetic.
HOT_LIST = 100_000
HOT = 20_000
#: Texts that lose words and are sent to all executors by id (16 bytes each); beyond, all texts are shuffled.
BROADCAST_ROWS = 1_000_000
_hash = WordHash()


def base_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (equal for equal texts: it tells apart rows with one doc_id), text as binary."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))


class Words:
    """The words of a batch in one row, with the hashes of grams and the selections."""

    def __init__(self, texts: list[bytes], window: int, gram: int, positions: bool):
        split = [t.split() for t in texts]
        self.words = [w for x in split for w in x]
        self.sizes = np.array(list(map(len, split)), np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        n = len(self.words)
        self.at = self.value = self.count = self.pivot = self.doc = np.zeros(0, np.int64)
        self.hashes = _hash.many(self.words)
        valid = np.concatenate([np.arange(s, e - window + 1) for s, e in zip(self.starts, self.ends, strict=True)]) if n else np.zeros(0, np.int64)
        if not len(valid):
            return
        grams = self.hash_runs(gram)
        best = np.arange(len(grams))
        span, width = 1, window - gram + 1
        while span < width:
            step = min(span, width - span)
            a, b = best[:-step], best[step:]
            best = np.where(grams[a] <= grams[b], a, b)
            span += step
        doc = np.repeat(np.arange(len(texts)), self.sizes)[valid]
        pivot = best[valid]
        value = grams[pivot]
        same = pivot[1:] == pivot[:-1] if positions else value[1:] == value[:-1]
        first = np.flatnonzero(np.append(True, ~same | (doc[1:] != doc[:-1])))
        self.at, self.value, self.doc, self.pivot = valid[first], value[first], doc[first], pivot[first]
        self.count = np.diff(np.append(first, len(valid)))

    def hash_runs(self, size: int) -> np.ndarray:
        """Hash of each run of size words, in place order; the words' borders of documents are the caller's matter."""
        n = len(self.hashes) - size + 1
        out = np.zeros(max(n, 0), np.uint64)
        for i in range(size):
            out = out * MIX2 + self.hashes[i : i + n]
        return mix64(out)


def selected_often(base: DataFrame, window: int, gram: int, positions: bool, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap of minimisers selected twice or more, and the sorted hot minimisers."""

    def values(batches):
        for b in batches:
            got, n = np.unique(Words(b.column("text").to_pylist(), window, gram, positions).value, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.uint64).view(np.int64)), pa.array(n, pa.int64())], ["v", "n"])

    counted = materialise(mapped(base.select("text"), values, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).where("n > 1"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = max(hot, total // HOT_LIST)
    bits = counted.selectExpr(f"shiftright(v & {BITMAP_BITS - 1}L, 6) AS w", "shiftleft(1L, cast(v & 63 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    bitmap[bits["w"].to_numpy()] = bits["b"].to_numpy()
    return bitmap.view(np.uint64), np.sort(counted.where(F.col("n") > hot).select("v").toArrow()["v"].to_numpy().view(np.uint64))


def slices(docs_base: DataFrame, positions: bool, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """bucket, data: packed slices (see Slices) around the minimisers selected more than once; a bucket is in one task."""
    spark = session(docs_base)
    base = docs_base.where("doc_id IS NOT NULL")
    sent = spark.sparkContext.broadcast(selected_often(base, window, gram, positions, hot))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, -(-size // BUCKET_BYTES))

    def deal(batches):
        bitmap, hot_values = sent.value
        for b in batches:
            x = Words(b.column("text").to_pylist(), window, gram, positions)
            docs, keys = b.column("doc_id").to_numpy(), b.column("key").to_numpy()
            slot = x.value.astype(np.uint64) & np.uint64(BITMAP_BITS - 1)
            keep = (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            at, count, doc, pivot, value = (y[keep] for y in (x.at, x.count, x.doc, x.pivot, x.value.astype(np.uint64)))
            if not len(at):
                continue
            if positions:
                lo = np.maximum(pivot - (window - gram), x.starts[doc])
                hi = np.minimum(pivot + window, x.ends[doc])
            else:
                lo, hi = at, at + count + window - 1
            if len(hot_values):
                burn = np.isin(value, hot_values)
                n = count[burn]
                alone = np.repeat(at[burn] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                whole = x.hash_runs(window)
                lo, hi = np.append(lo[~burn], alone), np.append(hi[~burn], alone + window)
                doc, pivot = np.append(doc[~burn], np.repeat(doc[burn], n)), np.append(pivot[~burn], np.repeat(pivot[burn], n))
                value = np.append(value[~burn], whole[alone])
            bucket = (mix64(value) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            occupied, borders = np.unique(bucket[order], return_index=True)
            rows = []
            for k, own in zip(occupied.tolist(), np.split(order, borders[1:]), strict=True):
                number: dict = {}
                which = [number.setdefault((b" ".join(x.words[s:e]), p), len(number)) for s, e, p in zip(lo[own].tolist(), hi[own].tolist(), (pivot - lo)[own].tolist(), strict=True)]
                text = b"\n".join(t for t, _ in number)
                rows.append((k, pack(text, np.array([p for _, p in number], "<i4"), np.array(which, "<i4"), docs[doc[own]].astype("<i8"), keys[doc[own]].astype("<i8"), (lo - x.starts[doc])[own].astype("<i4"))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"])

    dealt = mapped(base, deal, "bucket int, data binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket")


class Slices:
    """The slices of a bucket: words as numbers (0 is none), one row after another, and the places of each slice."""

    def __init__(self, payloads: list[bytes]):
        number: dict[bytes, int] = {}
        ids, sizes, pivot, which, doc, key, start = ([] for _ in range(7))
        known: dict = {}
        for data in payloads:
            text, p, w, d, k, s = unpack(data)
            p = np.frombuffer(p, "<i4").tolist()
            own = []
            for line, at in zip(bytes(text).split(b"\n"), p, strict=True):
                row = known.get((line, at))
                if row is None:
                    row = known[line, at] = len(sizes)
                    words = line.split()
                    sizes.append(len(words))
                    pivot.append(at)
                    ids += [number.setdefault(x, len(number) + 1) for x in words]
                own.append(row)
            which.append(np.array(own, np.int64)[np.frombuffer(w, "<i4")])
            doc.append(np.frombuffer(d, "<i8"))
            key.append(np.frombuffer(k, "<i8"))
            start.append(np.frombuffer(s, "<i4"))
        self.ids, self.sizes, self.pivot = np.array(ids, np.int64), np.array(sizes, np.int64), np.array(pivot, np.int64)
        self.which, self.doc, self.key, self.start = (np.concatenate(x) for x in (which, doc, key, start))
        self.least = np.full(len(sizes), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.which, self.doc)


def spans(dealt: DataFrame, judge) -> DataFrame:
    """doc_id, key, a, b: runs of words that judge(Slices) finds covered; judge gives (place, first word, end) arrays."""

    def apply(batches):
        now, rows = None, []

        def done():
            x = Slices(rows)
            place, a, b = judge(x)
            return pa.RecordBatch.from_arrays([pa.array(x.doc[place]), pa.array(x.key[place]), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc_id", "key", "a", "b"])

        for b in batches:
            for bucket, data in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist(), strict=True):
                if bucket != now and rows:
                    yield done()
                    rows = []
                now = bucket
                rows.append(data)
        if rows:
            yield done()

    return mapped(dealt, apply, "doc_id long, key long, a int, b int")


def runs_of(flags: np.ndarray, owner: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that start at `at` (ascending within an owner) and are flagged, joined to runs of words."""
    keep = np.flatnonzero(flags)
    owner, at = owner[keep], at[keep]
    if not len(keep):
        return owner, at, at
    first = np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1))
    last = np.append(first[1:], True)
    return owner[first], at[first], at[last] + window


def remove(base: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    covered = found.groupBy("doc_id", "key").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def apply(batches):
        for b in batches:
            n, gone, kept = [], [], []
            for text, a, e in zip(*(b.column(c).to_pylist() for c in ("text", "a", "b")), strict=True):
                words = text.split()
                n.append(len(words))
                if a:
                    step = np.bincount(a, minlength=len(words) + 1) - np.bincount(e, minlength=len(words) + 1)
                    stay = np.cumsum(step)[: len(words)] == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    schema = "doc_id long, n_words long, n_removed long, kept binary"
    covered = materialise(covered)
    if covered.count() > BROADCAST_ROWS:
        return mapped(base.join(covered, ["doc_id", "key"], "left").select("doc_id", "text", "a", "b"), apply, schema)
    # Only texts that lose words are shuffled.
    hit = F.broadcast(covered.select("doc_id", "key"))
    some = base.join(hit, ["doc_id", "key"], "left_semi").join(covered, ["doc_id", "key"]).select("doc_id", "text", "a", "b")
    none = F.lit(None).cast("array<int>")
    return mapped(union(some, base.join(hit, ["doc_id", "key"], "left_anti").select("doc_id", "text", none.alias("a"), none.alias("b"))), apply, schema)


def brute(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept) by a table of all windows, for tests."""
    split = [(d, (t or "").encode().split()) for d, t in docs]
    least: dict = {}
    for d, w in split:
        for i in range(len(w) - window + 1 if d is not None else 0):
            g = tuple(w[i : i + window])
            least[g] = min(least.get(g, d), d)
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - window + 1 if d is not None else 0) if least[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out
