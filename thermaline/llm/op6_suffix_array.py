"""Suffix-array dedup on sparse suffixes.

Only suffixes that start at content-selected positions are retained: the leftmost minimiser of each window of WINDOW words
(minimisers.py), whose selection two equal windows share. A bucket holds all suffixes of its minimisers, each with the
words to its left. Suffixes are sorted and neighbours compared, which gives the common prefix of any two; the words to the
left, read backwards, are sorted and compared likewise. A match of WINDOW words that reaches L words to the left and R to
the right is a pair of names, the group of suffixes that share R words and the group that shares L backward words, so all
matches of WINDOW words come out exactly. A longer match is a run of these. The smallest doc_id keeps a passage; the
words covered in other documents are removed.

Defined cases: as in op5_substring_dedup, whose result this one equals.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, table
from .minimisers import GRAM, HOT, WINDOW, Slices, base_of, remove, runs_of, slices, spans


def sort_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the common prefix of each with the one before it in that order (0 for the first)."""
    order = np.argsort(np.ascontiguousarray(rows.astype(">u4")).view(f"V{4 * rows.shape[1]}").ravel(), kind="stable")
    sorted_rows = rows[order]
    differs = np.column_stack([sorted_rows[1:] != sorted_rows[:-1], np.ones(len(rows) - 1, bool)])
    return order, np.append(0, differs.argmax(1))


def names(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row a number shared by the rows with the same first `depth` words."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def judge(x: Slices, window: int = WINDOW, gram: int = GRAM):
    first = np.cumsum(x.sizes) - x.sizes
    left_most, n = window - gram, len(x.sizes)
    ids = np.append(x.ids, 0)
    steps = np.arange(window)
    right = np.where(steps < (x.sizes - x.pivot)[:, None], ids[np.minimum((first + x.pivot)[:, None] + steps, len(ids) - 1)], 0)
    steps = np.arange(left_most)
    left = np.where(steps < x.pivot[:, None], ids[np.maximum((first + x.pivot - 1)[:, None] - steps, 0)], 0)
    right, left = sort_suffixes(right), sort_suffixes(left)
    flags = np.zeros((len(x.which), left_most + 1), bool)
    for reach in range(left_most + 1):
        fits = np.flatnonzero((x.pivot >= reach) & (x.sizes - x.pivot >= window - reach))
        if not len(fits):
            continue
        both = names(*right, window - reach)[fits] * (n + 1) + names(*left, reach)[fits]
        _, group = np.unique(both, return_inverse=True)
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, x.least[fits])
        of = np.full(n, np.iinfo(np.int64).max)
        of[fits] = least[group]
        flags[:, left_most - reach] = of[x.which] < x.doc
    place, step = np.nonzero(flags)
    at = (x.start + x.pivot[x.which])[place] - left_most + step
    return runs_of(np.ones(len(at), bool), place, at, window)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept."""
    session(docs)
    base = base_of(docs, id_col, text_col)
    return remove(base, spans(slices(base, True, hot=hot), judge))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


from .op5_substring_dedup import ORACLE  # noqa: E402, F401  the same rows
