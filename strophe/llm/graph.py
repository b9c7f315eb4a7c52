"""Connected components: contraction within tasks, and alternating star contractions over what that leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.store import Workspace

#: Edges that one task contracts at a time; a forest of no more is finished in one task.
SMALL = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.where("dst > src").join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    moved = down.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node reachable over the edges a[i], b[i]."""
    least = np.arange(n)
    while True:
        x, y = least[a], least[b]
        open_ = x != y
        if not open_.any():
            return least
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]


def _contract(limit: int, centres: bool):
    """Stars in place of the edges (src, dst), for each run of `limit` edges of a task; each node points to its star's least node."""

    def stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        src, dst = (pa.concat_arrays([p.column(c) for p in parts]) for c in (0, 1))
        kind, m = src.type, len(src)
        nodes, at = np.unique(pa.concat_arrays([src, dst]).to_numpy(zero_copy_only=False), return_inverse=True)
        least = least_reachable(at[:m], at[m:], len(nodes))
        keep = np.arange(len(nodes)) if centres else np.flatnonzero(least != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep], kind), pa.array(nodes[least[keep]], kind)], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= limit:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return run


def connected_components(work: Workspace, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of edges (src, dst); component is the smallest node reachable.

    Ids are longs or strings. Edges with a null end and self-loops join nothing. Every task first replaces
    its edges by stars, `small` edges at a time. What is left is finished in one task if it has at most
    `small` edges; else star rounds go on, each written, so no plan grows. There a hub costs no more than
    its edge count, because only its minimum is gathered and skewed joins are split by AQE.
    """
    kind = edges.schema["src"].dataType.simpleString()
    contract = lambda e: e.mapInArrow(_contract(small, False), f"src {kind}, dst {kind}")
    now = work.save(contract(edges.where("src <> dst").select("src", "dst")))
    before = None
    while now.count() > small:
        nxt = work.save(contract(_small_star(_large_star(now))))
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        work.drop(now)
        now = nxt
        if mark == before:
            return work.save(now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()))
        before = mark
    last = now.coalesce(1).mapInArrow(_contract(2 * small, True), f"src {kind}, dst {kind}")
    return work.save(last.select(F.col("src").alias("node"), F.col("dst").alias("component")))
