"""Connected components of links: up to ONE_TASK links in one task, beyond by alternating large and small stars, where edges
stay distributed. Both give the same classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialise, measured

#: Links that one task holds (some 200 MB of a worker).
ONE_TASK = 1_000_000


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to u's least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _least(down)
    return down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least number of each number's component, for links u, v of numbers below n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not (new == (further := new[new])).all():
            new = further
        if (new == label).all():
            return label
        label = new


def _at_once(batches):
    """All links, which are in one task."""
    parts = list(batches)
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    both = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks]).combine_chunks().dictionary_encode()
    both = both.chunk(0) if isinstance(both, pa.ChunkedArray) else both
    order = pc.sort_indices(both.dictionary)
    nodes, rank = both.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    at = rank[both.indices.to_numpy()]
    label = roots(at[: len(table)], at[len(table) :], len(nodes))
    for i in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([nodes[i : i + 50_000], nodes.take(pa.array(label[i : i + 50_000]))], ["node", "label"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """links: u, v of any ordered type. Gives node, label (the least node of its component) for nodes that have a link."""
    edges, seen = measured(links.where("u <> v").select("u", "v").distinct())
    if seen["rows"] <= one_task:
        kind = links.schema["u"].dataType.simpleString()
        return mapped(edges.coalesce(1), _at_once, f"node {kind}, label {kind}")
    total, before = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), None
    while True:
        edges, now = measured(_small(_large(_small(_large(edges)))), total=total)  # two steps a cut
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return materialise(nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
