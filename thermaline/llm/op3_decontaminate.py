"""Benchmark decontamination: a broadcast hash set of the items' word n-grams, scanned by windows of each document.

Words are lower-cased (A-Z) runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. A window is N consecutive words of an item, or all of
a shorter item. Document words become numbers of the benchmark's vocabulary (0: not in it), a rolling hash over zero-free
windows looks up the set, and a hit is verified by the words themselves.

The benchmark is sent to the executors in slices of SLICE_WORDS words at most, whatever its size: each slice is a scan of
its own, and what the slices found is merged by row.

Defined cases: null texts have no words; documents without words have no hits; null doc_ids and repeated rows give a row
each; null item_ids are the text 'null'; an empty benchmark hits nothing; other columns are carried in a struct; a very long
text is scanned whole, in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, session, table

N = 10
#: Bound of what is broadcast: words of benchmark text in one slice (about 100 MB as tables of a worker).
SLICE_WORDS = 1_000_000
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Grams:
    """The windows of some items: vocabulary, for each length the sorted hashes, and for each window its items."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[bytes, set[str]] = {}
        rows: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                window = ids[i : i + size]
                key = window.tobytes()
                if key not in self.items:
                    self.items[key] = set()
                    rows.setdefault(size, []).append(window)
                self.items[key].add(item)
        self.hashes = {size: np.unique(self.hash(np.stack(x))) for size, x in rows.items()}

    @staticmethod
    def hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for column in rows.T:
            h = (h + column.astype(np.uint64)) * P
            h ^= h >> np.uint64(31)
        return h

    def scan(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, set[str]]]:
        """For each text: words, the numbers of the words hit, and the items found."""
        get, sizes, ids = self.vocabulary.get, [], [np.zeros(N, np.int32)]
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            ids.append(np.fromiter([get(w, 0) for w in words], np.int32, len(words)))
            ids.append(np.zeros(1, np.int32))
        flat = np.concatenate([*ids, np.zeros(N, np.int32)])
        starts = N + np.cumsum([0, *(s + 1 for s in sizes[:-1])])
        zeros = np.append(0, np.cumsum(flat == 0))
        mark, found = np.zeros(len(flat) + 1, np.int32), {}
        for size, hashes in self.hashes.items():
            at = np.flatnonzero(zeros[size:] == zeros[:-size])
            for part in np.array_split(at, len(at) // 200_000 + 1):
                rows = np.lib.stride_tricks.sliding_window_view(flat, size)[part]
                h = self.hash(rows)
                near = np.searchsorted(hashes, h)
                near[near == len(hashes)] = 0
                for i in np.flatnonzero(hashes[near] == h).tolist():
                    if items := self.items.get(rows[i].tobytes()):
                        mark[part[i]] += 1
                        mark[part[i] + size] -= 1
                        found.setdefault(int(np.searchsorted(starts, part[i], "right")) - 1, set()).update(items)
        hit = np.cumsum(mark) > 0
        return [(s, np.flatnonzero(hit[a : a + s]), found.get(k, set())) for k, (a, s) in enumerate(zip(starts.tolist(), sizes, strict=True))]


def _slices(benchmark: DataFrame, id_col: str, text_col: str):
    """Items in slices of bounded size, one after another: rows are taken from the cluster one partition at a time, and the
    driver holds no more than one slice of them."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    items, words = [], 0
    for item, text in rows.toLocalIterator():
        words += (size := len(words_of(bytes(text))))
        if words > SLICE_WORDS and items:
            yield items
            items, words = [], size
        items.append((item, bytes(text)))
    yield items


def scan(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, set[str]]]:
        """For each text: words, the numbers of the words hit, and the items found."""
        get, sizes, ids = self.vocabulary.get, [], [np.zeros(N, np.int32)]
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            ids.append(np.fromiter([get(w, 0) for w in words], np.int32, len(words)))
            ids.append(np.zeros(1, np.int32))
        flat = np.concatenate([*ids, np.zeros(N, np.int32)])
        starts = N + np.cumsum([0, *(s + 1 for s in sizes[:-1])])
        zeros = np.append(0, np.cumsum(flat == 0))
        mark, found = np.zeros(len(flat) + 1, np.int32), {}
        for size, hashes in self.hashes.items():
            at = np.flatnonzero(zeros[size:] == zeros[:-size])
            for part in np.array_split(at, len(at) // 200_000 + 1):
                rows = np.lib.stride_tricks.sliding_window_view(flat, size)[part]
                h = self.hash(rows)
                near = np.searchsorted(hashes, h)
                near[near == len(hashes)] = 0
                for i in np.flatnonzero(hashes[near] == h).tolist():
                    if items := self.items.get(rows[i].tobytes()):
                        mark[part[i]] += 1
                        mark[part[i] + size] -= 1
                        found.setdefault(int(np.searchsorted(starts, part[i], "right")) - 1, set()).update(items)
        hit = np.cumsum(mark) > 0
        return [(s, np.flatnonzero(hit[a : a + s]), found.get(k, set())) for k, (a, s) in enumerate(zip(starts.tolist(), sizes, strict=True))]


def _slices(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple[str, bytes]]]:
    """Items in slices of bounded size; rows are taken from the cluster one partition at a time."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    out, words = [[]], 0
    for item, text in rows.toLocalIterator():
        words += (size := len(words_of(bytes(text))))
        if words > SLICE_WORDS and out[-1]:
            out.append([])
            words = size
        out[-1].append((item, bytes(text)))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_words, hit_words (numbers of the words inside a window), items (sorted), and with carry the row of docs."""
    spark = session(docs)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *[F.struct("*").alias("row")] * carry)
    state = base.withColumns({"n_words": F.lit(0).cast("long"), "hit_words": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    schema = state.schema
    for items in _slices(benchmark, "item_id", "text"):
        sent = spark.sparkContext.broadcast(Grams(items, n))

        def apply(batches, sent=sent):
            for b in batches:
                got = sent.value.scan(b.column("text").to_pylist())
                old = zip(b.column("hit_words").to_pylist(), b.column("items").to_pylist(), strict=True)
                both = [(w, np.union1d(h, np.array(oh, np.int64)) if oh else h, sorted(i.union(oi))) for (w, h, i), (oh, oi) in zip(got, old, strict=True)]
                new = {"n_words": pa.array([x[0] for x in both], pa.int64()), "hit_words": pa.array([x[1].astype(np.int32) for x in both], pa.list_(pa.int32())), "items": pa.array([x[2] for x in both], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(c, b.column(c) if c not in new else None) for c in b.schema.names], b.schema.names)

        state = mapped(state, apply, schema)
    return state.drop("text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of docs without a hit word, with the columns of docs."""
    return scan(docs, benchmark, n, carry=True).where(F.size("hit_words") == 0).select("row.*")


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def brute(docs: list[tuple], items: list[tuple], n: int = N) -> dict:
    """The same by nested loops, for tests: doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    split = [(str(i), words_of((t or "").encode())) for i, t in items]
    out = {}
    for doc, text in docs:
        words, hit, got = words_of((text or "").encode()), set(), set()
        for item, w in split:
            size = min(n, len(w))
            for i in range(len(w) - size + 1 if size else 0):
                for j in range(len(words) - size + 1):
                    if words[j : j + size] == w[i : i + size]:
                        hit.update(range(j, j + size))
                        got.add(item)
        out[doc] = (len(words), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit))
    return out


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least({N}, len(w)) AS size, array_to_string(w[i:i + least({N}, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least({N}, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS r(i) WHERE len(w) >= size),
hits AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (size, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + size)) AS r(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
