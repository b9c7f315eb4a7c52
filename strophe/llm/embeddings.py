"""Near-duplicate vectors by an epsilon-grid-order join.

Unit vectors are within cosine c exactly if they are within eps = sqrt(2 - 2 c) of each other. Vectors
are put on a grid of width eps over the leading principal dimensions and sorted by cell; the order is
cut into intervals with bounding boxes. Interval pairs meet over the cells of the grid that touch, are
skipped if their boxes are provably further apart than eps, and are halved recursively under the same
test down to leaves, where cosines are computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import frames
from strophe.llm.graph import connected_components
from strophe.llm.store import Workspace

GRID_DIMENSIONS, BOX_DIMENSIONS, INTERVAL, LEAF = 3, 8, 1024, 128


def unit_vectors(column: pa.Array) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Float64 vectors scaled to length 1, None where null, empty, zero or with null or non-finite parts."""
    out: list[np.ndarray | None] = []
    values, ends = column.flatten(), np.r_[0, np.cumsum(np.asarray(column.value_lengths().fill_null(0)))]
    plain = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null part is nan
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        v = plain[a:b]
        top = np.abs(v).max() if b > a else 0.0
        out.append(None if not (np.isfinite(top) and top > 0) else (u := v / top) / math.sqrt(float(u @ u)))
    return out, ends


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vectors, _ = unit_vectors(b.column(1))
        label = b.column(2)
        ok = [v is not None and m.is_valid for v, m in zip(vectors, label, strict=True)]
        packed = pa.array([v.astype("<f8").tobytes() if good else None for v, good in zip(vectors, ok, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), label, packed], names=["vec_id", "label", "vector"])


def _moments(dims: int):
    """Sums of x and of x x' of the vectors with this many dimensions, by index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), "<f8").reshape(-1, dims)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "s"])

    return run


def principal_axes(vectors: DataFrame, dims: int, k: int) -> np.ndarray:
    """(dims, k) leading principal axes over all rows of vectors (vector binary of dims doubles)."""
    rows = vectors.select("vector").mapInArrow(_moments(dims), "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((dims + 1) ** 2)
    for r in rows:
        m[r.i] = r.s
    m = m.reshape(dims + 1, dims + 1)
    mean = m[-1, :-1] / max(m[-1, -1], 1)
    _, axes = np.linalg.eigh(m[:-1, :-1] / max(m[-1, -1], 1) - np.outer(mean, mean))
    return axes[:, ::-1][:, : min(k, dims)]


def _project(axes: dict[int, np.ndarray], eps: float, grid: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, cells = [], []
            for v in b.column(3).to_pylist():
                p = np.frombuffer(v, "<f8") @ axes[len(v) // 8]
                places.append(p.tolist())
                c = np.floor(p[:grid] / eps).astype(int).tolist()
                cells.append(c + [0] * (grid - len(c)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.float64()))], names=[*b.schema.names, "cell", "place"])

    return run


def _cut(size: int):
    """Runs of rows of one label and dimension count, as intervals with their boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []

        def close() -> pa.RecordBatch:
            places = np.array([r[4] for r in open_])
            one = [
                [open_[0][1]], [len(open_[0][3])], [[r[0] for r in open_]], [[r[2] for r in open_]], [b"".join(r[3] for r in open_)],
                [np.ascontiguousarray(places).tobytes()], [places.min(axis=0).tolist()], [places.max(axis=0).tolist()],
                [sorted({tuple(r[5]) for r in open_})],
            ]
            open_.clear()
            kinds = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, kinds, strict=True)], names=["label", "bytes", "ids", "times", "vectors", "places", "low", "high", "cells"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "label", "times", "vector", "place", "cell")), strict=True):
                if open_ and (len(open_) >= size or open_[0][1] != row[1] or len(open_[0][3]) != len(row[3])):
                    yield close()
                open_.append(row)
        if open_:
            yield close()

    return run


def _apart(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float(gap @ gap) > (eps + 1e-9) ** 2


def interval_join(x, px, y, py, same: bool, cosine: float, eps: float, emit) -> None:
    """Recursive join of two sequence intervals; emit(first x, first y, link matrix) for each leaf."""

    def go(a0: int, a1: int, b0: int, b1: int) -> None:
        if same and b1 <= a0 or a0 == a1 or b0 == b1 or _apart(px[a0:a1], py[b0:b1], eps):
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            emit(a0, b0, x[a0:a1] @ y[b0:b1].T >= cosine)
            return
        am, bm = ((a0 + a1) // 2 if a1 - a0 > LEAF else a1), ((b0 + b1) // 2 if b1 - b0 > LEAF else b1)
        for a, a_ in ((a0, am), (am, a1)):
            for b, b_ in ((b0, bm), (bm, b1)):
                go(a, a_, b, b_)

    go(0, len(x), 0, len(y))


def _join(cosine: float, eps: float):
    """For each interval pair: links of each vector by count, and edges that keep its components (id, peer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(i)[r].as_py() for i, c in enumerate(b.schema.names)}
                same = row["same"]
                ids = np.array(row["ids"] + ([] if same else row["ids2"]), np.int64)
                times = np.array(row["times"] + ([] if same else row["times2"]), np.int64)
                n, d = len(row["ids"]), row["bytes"] // 8
                x = np.frombuffer(row["vectors"], "<f8").reshape(n, d)
                px = np.frombuffer(row["places"], "<f8").reshape(n, -1)
                y, py, base = (x, px, 0) if same else (np.frombuffer(row["vectors2"], "<f8").reshape(-1, d), np.frombuffer(row["places2"], "<f8").reshape(-1, px.shape[1]), n)
                links, root = np.zeros(len(ids), np.int64), list(range(len(ids)))

                def find(i: int) -> int:
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                def emit(a0: int, b0: int, near: np.ndarray) -> None:
                    if same:
                        i, j = np.arange(a0, a0 + near.shape[0]), np.arange(b0, b0 + near.shape[1])
                        near &= i[:, None] < j[None]
                    if not near.any():
                        return
                    left, right = np.nonzero(near)
                    left, right = left + a0, right + b0 + base
                    np.add.at(links, left, times[right])
                    np.add.at(links, right, times[left])
                    for i, j in zip(left.tolist(), right.tolist(), strict=True):
                        i, j = find(i), find(j)
                        if i != j:
                            root[max(i, j)] = min(i, j)

                interval_join(x, px, y, py, same, cosine, eps, emit)
                hit = np.flatnonzero(links)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[[find(i) for i in hit.tolist()]])], names=["id", "links", "peer"])

    return run


def _around(cell: Column) -> Column:
    """The cells that touch a cell, itself included."""
    steps = product((-1, 0, 1), repeat=GRID_DIMENSIONS)
    return F.array(*[F.array(*[(F.get(cell, k) + s).cast("int") for k, s in enumerate(step)]) for step in steps])


def near_vectors(spark: SparkSession, embeddings: DataFrame, cosine: float = 0.93) -> DataFrame:
    """One row per row of embeddings (vec_id, embedding, label): n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at
    least `cosine`. Null, empty or zero vectors, vectors with null or non-finite parts, and vectors of
    different dimension counts do not link. Repeated rows link with each other. A null vec_id counts as
    larger than any other; kept compares null-safe. Labels are of any type that has a text form. Other columns are not read.
    """
    eps = math.sqrt(2 - 2 * cosine)
    work = Workspace(spark, "vectors")
    rows = frames.pick(embeddings, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), F.col("label").cast("string").alias("label"))
    named = work.save(rows.mapInArrow(_name, "vec_id long, label string, vector binary"))
    classes = named.where("vector is not null").groupBy("label", "vector").agg(F.count("*").alias("times"), F.min("vec_id").alias("least"))
    classes = work.save(classes.select(F.monotonically_increasing_id().alias("id"), "label", "times", "vector", "least"))
    sizes = [r[0] for r in classes.select(F.length("vector")).distinct().collect()]
    axes = {n // 8: principal_axes(classes.where(F.length("vector") == n), n // 8, BOX_DIMENSIONS) for n in sizes}
    placed = classes.drop("least").mapInArrow(_project(axes, eps, GRID_DIMENSIONS), "id long, label string, times long, vector binary, cell array<int>, place array<double>")
    order = [F.length("vector").alias("n"), "label", "cell", "place", "id"]
    sequence = placed.repartitionByRange("label", "cell", "place", "id").sortWithinPartitions("label", *order[:1], "cell", "place", "id")
    schema = "label string, bytes int, ids array<long>, times array<long>, vectors binary, places binary, low array<double>, high array<double>, cells array<array<int>>"
    intervals = work.save(sequence.mapInArrow(_cut(INTERVAL), schema).withColumn("interval", F.monotonically_increasing_id()))
    box = intervals.select("interval", "label", "bytes", "low", "high", "cells")
    left = box.select("interval", "label", "bytes", "low", "high", F.explode("cells").alias("cell"))
    right = box.select(F.col("interval").alias("other"), "label", "bytes", F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(F.array_distinct(F.flatten(F.transform("cells", _around)))).alias("cell"))
    gap = F.aggregate(F.sequence(F.lit(0), F.size("low") - 1), F.lit(0.0), lambda s, i: s + F.pow(F.greatest(F.lit(0.0), F.get("low", i) - F.get("high2", i), F.get("low2", i) - F.get("high", i)), 2))
    pairs = left.join(right, ["label", "bytes", "cell"]).where("interval <= other").where(gap <= (eps + 1e-9) ** 2).select("interval", "other").distinct()
    a = intervals.select("interval", "bytes", "ids", "times", "vectors", "places")
    b = intervals.select(F.col("interval").alias("other"), F.col("ids").alias("ids2"), F.col("times").alias("times2"), F.col("vectors").alias("vectors2"), F.col("places").alias("places2"))
    joined = pairs.join(a, "interval").join(b, "other").withColumn("same", F.col("interval") == F.col("other"))
    found = work.save(joined.mapInArrow(_join(cosine, eps), "id long, links long, peer long"))
    groups = connected_components(work, found.select(F.col("id").alias("src"), F.col("peer").alias("dst")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = classes.join(counts, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    of = of.select("label", "vector", "least", "times", F.coalesce("component", "id").alias("g"), F.coalesce("links", F.lit(0)).alias("links"))
    of = work.save(of)
    work.only(named, of)
    small = of.groupBy("g").agg(F.min("least").alias("component_id"))
    of = of.join(small, "g").select("label", "vector", (F.col("times") - 1 + F.col("links")).alias("links"), F.col("component_id").alias("c"), F.lit(True).alias("in"))
    out = named.join(of, ["label", "vector"], "left")
    component = F.when(F.col("in"), F.col("c")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
