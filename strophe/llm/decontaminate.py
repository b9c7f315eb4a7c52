"""Benchmark decontamination with SimHash over item-sized windows.

Words are runs of letters, digits and non-ASCII characters, lower-cased (A-Z and the Latin-1 letters),
so punctuation and case hide nothing. An item of n words is sought in windows of n words of a text, and
in the whole of a shorter text that holds enough shingles to reach the similarity.
Windows and items have 128-bit SimHashes of their 5-word shingles, weighted by multiplicity. A
multi-index over the items' fingerprints (8 blocks of 16 bits, each entered with all values within
radius // 8 errors) returns every item of the window's size within `radius` bits; each such pair is
verified by weighted Jaccard similarity. Windows that hold too few shingles of any item to reach the
similarity are not fingerprinted: no item can be found in them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strophe.llm import frames
from strophe.llm import words as W
from strophe.llm.store import Workspace

SHINGLE, SIMILARITY, RADIUS, BITS, BLOCKS = 5, 0.8, 31, 128, 8
#: Items and bytes of text of one pass over the documents; a larger benchmark takes more passes.
PASS_ITEMS, PASS_BYTES = 4096, 8 << 20

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
for _a, _b in ((48, 57), (97, 122)):
    _PLAIN[_a : _b + 1] = np.arange(_a, _b + 1)
_PLAIN[65:91] = np.arange(97, 123)


def plain(buf: np.ndarray) -> np.ndarray:
    """Lower case, and a blank for each ASCII byte that is no letter or digit."""
    out = _PLAIN[buf]
    if len(out) > 1:
        latin = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][latin] += 32
    return out


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """(n, BITS) vote sums to (n, BLOCKS) uint16 blocks."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def votes(shingles: np.ndarray) -> np.ndarray:
    """(n, BITS) of -1 and 1."""
    parts = np.stack([W.mix(shingles, 101 + i) for i in range(BITS // 64)], axis=1)
    bits = np.unpackbits(np.ascontiguousarray(parts).view(np.uint8), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def _ball(errors: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for e in range(errors + 1) for c in combinations(range(16), e)], np.uint16)


class Items:
    """Index of one pass of benchmark items: (position, text) pairs."""

    def __init__(self, texts: list[str], shingle: int, radius: int, similarity: float):
        self.shingle, self.radius, self.similarity = shingle, radius, similarity
        self.bags: list[dict[int, int]] = []
        self.lengths = np.zeros(len(texts), np.int64)
        prints = np.zeros((len(texts), BLOCKS), np.uint16)
        for i, t in enumerate(texts):
            buf = plain(np.frombuffer(t.encode(), np.uint8))
            w = W.split_words(buf, np.array([0, len(buf)]))
            n = self.lengths[i] = len(w.starts)
            grams = W.window_hashes(w.hashes(), int(min(n, shingle))) if n else np.zeros(0, np.uint64)
            values, times = np.unique(grams, return_counts=True)
            self.bags.append(dict(zip(values.tolist(), times.tolist(), strict=True)))
            if n:
                prints[i] = fingerprints(votes(grams).sum(axis=0, dtype=np.int32)[None])[0]
        self.prints = prints
        self.known = {min(int(n), shingle): np.unique(np.array([g for i in np.flatnonzero(np.minimum(self.lengths, shingle) == min(n, shingle)) for g in self.bags[i]], np.uint64)) for n in np.unique(self.lengths) if n}
        ball = _ball(radius // BLOCKS)
        full = np.flatnonzero(self.lengths)
        keys, owner = [], []
        for b in range(BLOCKS):
            near = prints[full, b][:, None] ^ ball[None]
            keys.append(self._key(self.lengths[full][:, None], b, near).ravel())
            owner.append(np.repeat(full, len(ball)))
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]

    @staticmethod
    def _key(length, block, value):
        return (np.asarray(length, np.int64) << 20) | (block << 16) | np.asarray(value, np.int64)

    def within(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius among items of this length."""
        pairs = []
        for b in range(BLOCKS):
            key = self._key(length, b, prints[:, b])
            lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            n = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            pairs.append(np.repeat(np.arange(len(prints)), n) * np.int64(len(self.lengths)) + self.owner[at])
        pair = np.unique(np.concatenate(pairs))
        win, item = pair // len(self.lengths), pair % len(self.lengths)
        distance = np.bitwise_count(prints[win] ^ self.prints[item]).sum(axis=1)
        ok = distance <= self.radius
        return win[ok], item[ok], distance[ok]

    def weighted_similarity(self, grams: np.ndarray, item: int) -> float:
        bag = self.bags[item]
        values, times = np.unique(grams, return_counts=True)
        both = sum(min(c, bag.get(v, 0)) for v, c in zip(values.tolist(), times.tolist(), strict=True))
        return both / (len(grams) + sum(bag.values()) - both)

    def find(self, w: W.Words) -> list[tuple[int, int, float, int, int, int]]:
        """(text, item, similarity, first word, words, distance): of each text and item the best window, then the first."""
        h, offsets = w.hashes(), w.offsets
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        best: dict[tuple[int, int], tuple] = {}
        for size, known in self.known.items():
            grams = W.window_hashes(h, size)
            if not len(grams):
                continue
            k = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            hit = known[k] == grams
            hit &= text_of[: len(grams)] == text_of[size - 1 :]
            if not hit.any():
                continue
            counts = np.r_[0, np.cumsum(hit)]
            for n in np.unique(self.lengths[(np.minimum(self.lengths, self.shingle) == size) & (self.lengths > 0)]).tolist():
                m = n - size + 1  # shingles of a window
                # texts shorter than the item are one window each
                own = np.diff(offsets) - size + 1
                whole = np.flatnonzero((own > 0) & (own < m) & (own >= self.similarity * m - 1e-9))
                shared = counts[offsets[whole] + own[whole]] - counts[offsets[whole]]
                whole = whole[shared >= np.maximum(1, self.similarity / (1 + self.similarity) * (own[whole] + m) - 1e-9)]
                for t in whole.tolist():
                    bag = grams[offsets[t] : offsets[t] + own[t]]
                    _, item, distance = self.within(fingerprints(votes(bag).sum(axis=0, dtype=np.int32)[None]), n)
                    for i, d in zip(item.tolist(), distance.tolist(), strict=True):
                        s = self.weighted_similarity(bag, i)
                        if s >= self.similarity:
                            found = (-s, 0, int(offsets[t + 1] - offsets[t]), d)
                            best[t, i] = min(best.get((t, i), found), found)
                if len(h) < n:
                    continue
                least = math.ceil(2 * self.similarity / (1 + self.similarity) * m - 1e-9)  # shared by two bags of m at this similarity
                p = np.flatnonzero(counts[m:] - counts[:-m] >= max(1, least))
                p = p[text_of[p] == text_of[p + n - 1]]
                for part in (p[i : i + 4096] for i in range(0, len(p), 4096)):
                    # votes only of the shingles that these windows have
                    need = np.zeros(len(grams) + 1, np.int32)
                    np.add.at(need, part, 1)
                    np.add.at(need, part + m, -1)
                    used = np.flatnonzero(np.cumsum(need[:-1]) > 0)
                    sums = np.zeros((len(used) + 1, BITS), np.int32)
                    np.cumsum(votes(grams[used]), axis=0, dtype=np.int32, out=sums[1:])
                    a = np.searchsorted(used, part)
                    win, item, distance = self.within(fingerprints(sums[a + m] - sums[a]), n)
                    for x, i, d in zip(win.tolist(), item.tolist(), distance.tolist(), strict=True):
                        q = int(part[x])
                        s = self.weighted_similarity(grams[q : q + m], i)
                        if s >= self.similarity:
                            t = int(text_of[q])
                            found = (-s, q - int(offsets[t]), n, d)
                            best[t, i] = min(best.get((t, i), found), found)
        return [(t, i, -s, q, n, d) for (t, i), (s, q, n, d) in sorted(best.items())]


def _search(items: Items, ids: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("decontaminate")
        for b in batches:
            for i, _, buf, offsets in W.pieces(b.column(1)):
                found = items.find(W.split_words(plain(buf), offsets))
                if found:
                    text, item, s, q, n, d = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text) if not i else pa.array([t + i for t in text])), ids.take(pa.array(item)), pa.array(s), pa.array(q, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.int32())], names=["doc_id", "item_id", "similarity", "start", "n_words", "distance"])

    return run


def _keep_clean(items: Items, text_at: int):
    """Rows without a found item in the text at this place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("decontaminate")
        for b in batches:
            bad = [i + f[0] for i, _, buf, offsets in W.pieces(b.column(text_at)) for f in items.find(W.split_words(plain(buf), offsets))]
            keep = np.ones(b.num_rows, bool)
            keep[bad] = False
            yield b.filter(pa.array(keep))

    return run


def _passes(benchmark: DataFrame, shingle: int, radius: int, similarity: float) -> Iterator[tuple[Items, pa.Array, bool]]:
    """Indexes over slices of the benchmark, one after the other, each of bounded size, and whether there are several."""
    rows = frames.pick(benchmark, "item_id", "text").where(F.col("text").isNotNull())
    size = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    n = max(1, -(-(size[0] or 0) // (PASS_ITEMS // 2)), -(-int(size[1] or 0) // (PASS_BYTES // 2)))
    kind = to_arrow_type(rows.schema["item_id"].dataType)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).distinct().collect()
        if part:
            yield Items([r[1] for r in part], shingle, radius, similarity), pa.array([r[0] for r in part], kind), n > 1


def leaks(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per document row and benchmark item found in it.

    doc_id, item_id (as benchmark has them, of any type), similarity (weighted Jaccard of the best window, the first of equal ones), start and n_words (that window, in
    words as normalised here), distance (bits). Items of fewer than five words are one shingle, so they
    match exactly; null items and items without words match nothing, null and empty texts hold nothing. Repeated
    documents are each reported; repeated rows of benchmark count once. Other columns are not read. A benchmark
    of more than PASS_ITEMS / 2 items takes several passes over documents, each written before the next is indexed.
    """
    kinds = [(f.name, f.dataType) for f in (frames.pick(documents, "doc_id").schema[0], frames.pick(benchmark, "item_id").schema[0])]
    schema = T.StructType([T.StructField(*k) for k in kinds] + list(T.StructType.fromDDL("similarity double, start long, n_words long, distance int")))
    out, work = spark.createDataFrame([], schema), Workspace(spark, "leaks")
    for items, ids, several in _passes(benchmark, shingle, radius, similarity):
        found = frames.pick(documents, "doc_id", "text").mapInArrow(_search(items, ids), schema)
        out = out.unionByName(work.save(found) if several else found)
    return out


def drop_contaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """documents without the rows in which an item of benchmark is found; all columns stay, whatever their names. Null and empty texts stay."""
    work, rows = Workspace(spark, "clean"), frames.numbered(documents)
    for items, _, several in _passes(benchmark, shingle, radius, similarity):
        kept = rows.mapInArrow(_keep_clean(items, frames.place(documents, "text")), rows.schema)
        rows = work.save(kept, "snappy") if several else kept
        if several:
            work.only(rows)
    return rows.select(*frames.named(rows, documents.columns))
