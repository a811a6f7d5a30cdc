"""Substring dedup by super-k-mers.

Consecutive windows of a document that share a minimiser travel as one string to the minimiser's bucket (minimisers.py).
In the bucket every window gets a rolling hash over exact word numbers, windows are sorted by it, neighbours with equal
hashes are compared word by word, and each distinct window learns the smallest doc_id that has it. Words covered by a
window that a smaller doc_id has are removed.

Defined cases: null texts have no words; rows with a null doc_id lose nothing and take nothing from others; rows with one
doc_id are judged each on its own text and don't count as smaller; documents under WINDOW words are kept whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX1, mix64, ranges, session, table
from .minimisers import HOT, WINDOW, Slices, base_of, remove, runs_of, slices, spans


def window_names(ids: np.ndarray, at: np.ndarray, window: int, seed: int = 1) -> np.ndarray:
    """A number for each window of ids that starts at `at`: equal if and only if the words are."""
    step = np.full(len(ids) + 1, MIX1)
    step[0] = 1
    power = np.multiply.accumulate(step)
    sums = np.append(np.uint64(0), np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(seed)) * power[:-1]))
    h = (sums[at + window] - sums[at]) * power[len(ids) - at]  # brought to one power, wherever the window starts
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order[1:]] != h[order[:-1]])
    name = np.empty(len(at), np.int64)
    name[order] = np.cumsum(new) - 1
    first = order[np.flatnonzero(new)][name]
    other = np.flatnonzero(first != np.arange(len(at)))
    for part in np.array_split(other, len(other) // 200_000 + 1):
        if any((ids[at[part] + i] != ids[at[first[part]] + i]).any() for i in range(window)):
            return window_names(ids, at, window, seed + 1)
    return name


def judge(x: Slices, window: int = WINDOW):
    n = x.sizes - window + 1
    first = np.cumsum(x.sizes) - x.sizes
    at = ranges(first, n)
    owner = np.repeat(np.arange(len(n)), n)
    name = window_names(x.ids, at, window)
    least = np.full(name.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, name, x.least[owner])
    least = least[name]
    begin = np.cumsum(n) - n
    place = np.flatnonzero(np.minimum.reduceat(least, begin)[x.which] < x.doc)
    which = x.which[place]
    index = ranges(begin[which], n[which])
    whose = np.repeat(place, n[which])
    return runs_of(least[index] < x.doc[whose], whose, x.start[whose].astype(np.int64) + ranges(np.zeros(len(which), np.int64), n[which]), window)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept."""
    session(docs)
    base = base_of(docs, id_col, text_col)
    return remove(base, spans(slices(base, False, hot=hot), judge))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM d, unnest(range(1, len(w) - 48)) AS r(i) WHERE len(w) >= 50),
m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
gone AS (SELECT DISTINCT g.doc_id, p FROM g JOIN m USING (g), unnest(range(i, i + 50)) AS r(p) WHERE m.first < g.doc_id),
words AS (SELECT doc_id, i AS p, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS kept, count(gone.p) AS n FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
