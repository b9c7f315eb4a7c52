"""Substring dedup by recompression.

Every text is parsed in rounds that name runs of equal symbols and pairs of a left-class and a
right-class symbol. A name is a hash of what it stands for, so all tasks give one name to one
content: naming is global without a dictionary. With every symbol goes its context, the words that
its parse depended on; wherever these words stand again, the same symbol stands there. A repeated
window therefore shares every symbol whose context lies within it. The highest of these (longest,
then by name) stands for the window; windows in a row with the same symbol form a run. Runs are kept
whose symbol occurs again, and verified: equal runs repeat as a whole, and of different runs one per
content is expanded into its windows, which are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm import frames
from strophe.llm import words as W
from strophe.llm.store import Workspace

ROUNDS = 4
_FAR = np.int64(1) << np.int64(40)
KEY = ("k1", "k2")


def recompress(h: np.ndarray, first: np.ndarray, rounds: int) -> list[tuple[np.ndarray, ...]]:
    """(name, start, end, low, high) of the symbols over the words h before all rounds and after each.

    first marks the first word of each text. low:high is the symbol's context in words; it passes the
    text's ends (by _FAR) where the parse depended on the text ending there.
    """
    levels = []
    name, s = h, np.arange(len(h), dtype=np.int64)
    e, lo, hi = s + 1, s.copy(), s + 1
    for r in range(rounds):
        levels.append((name, s, e, lo, hi))
        # runs of equal symbols
        head = np.ones(len(name), bool)
        head[1:] = (name[1:] != name[:-1]) | first[1:]
        at = np.flatnonzero(head)
        k = np.diff(np.r_[at, len(name)])
        tail = at + k - 1
        rs, re = s[at], e[tail]
        low, high = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
        starts = first[at]
        ends = np.r_[starts[1:], True]
        word_before, word_after = np.maximum(rs - 1, 0), np.minimum(re, len(h) - 1)
        near = np.where(h[word_before] != h[re - 1], rs - 1, lo[np.maximum(at - 1, 0)])
        low = np.minimum(low, np.where(starts, -_FAR, near))
        near = np.where(h[word_after] != h[rs], re + 1, hi[np.minimum(tail + 1, len(name) - 1)])
        high = np.maximum(high, np.where(ends, _FAR, near))
        name = np.where(k > 1, W.mix(name[at] + k.astype(np.uint64) * np.uint64(0xA24BAED4963EE407), 2 * r + 1), name[at])
        s, e, lo, hi, first = rs, re, low, high, starts
        # pairs of a left and a right symbol
        right = (W.mix(name, 0x5BF03635 + r) >> np.uint64(63)).astype(bool)
        joined = np.zeros(len(name), bool)  # with the next one
        joined[:-1] = ~right[:-1] & right[1:] & ~first[1:]
        second = np.r_[False, joined[:-1]]
        alone = ~joined & ~second
        before = np.where(first, -_FAR, np.r_[-_FAR, lo[:-1]])
        after = np.where(np.r_[first[1:], True], _FAR, np.r_[hi[1:], _FAR])
        lo2 = np.where(alone & right, np.minimum(lo, before), lo)
        hi2 = np.where(alone & ~right, np.maximum(hi, after), hi)
        i = np.flatnonzero(joined)
        lo2[i] = np.minimum(lo[i], lo[i + 1])
        hi2[i] = np.maximum(hi[i], hi[i + 1])
        e2, name2 = e.copy(), name.copy()
        e2[i] = e[i + 1]
        name2[i] = W.mix(W.mix(name[i], 2 * r + 2) + name[i + 1])
        stay = ~second
        name, s, e, lo, hi, first = name2[stay], s[stay], e2[stay], lo2[stay], hi2[stay], first[stay]
    return [*levels, (name, s, e, lo, hi)]


def window_symbols(h: np.ndarray, offsets: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, symbol name) of the runs of windows; positions count from the text's start.

    A window has the highest symbol whose context lies within it: of the last round that has any, the longest, then by name. Before all
    rounds the words are symbols, so every window has one.
    """
    counts = np.diff(offsets)
    first = np.zeros(len(h) + 1, bool)
    first[offsets[:-1]] = True
    levels = recompress(h, first[:-1], rounds)
    text = np.repeat(np.arange(len(counts)), counts)
    best, base = np.full(len(h), -1, np.int64), np.cumsum([0, *(len(x[0]) for x in levels)])
    name, s, e, lo, hi = levels[-1]
    ok = np.flatnonzero(hi - lo <= window)
    ok = ok[np.lexsort((name[ok], (e - s)[ok]))]
    a = np.maximum(hi[ok] - window, offsets[text[s[ok]]])
    b = np.minimum(lo[ok], offsets[text[s[ok]] + 1] - window)
    n = np.maximum(b - a + 1, 0)
    shift = np.r_[0, np.cumsum(n)[:-1]]
    best[np.arange(n.sum()) - np.repeat(shift - a, n)] = np.repeat(ok + base[-2], n)
    inside = np.arange(len(h)) + window <= np.repeat(offsets[1:], counts)
    for k in range(len(levels) - 2, -1, -1):
        left = np.flatnonzero(inside & (best < 0))
        if not len(left):
            break
        name, s, e, lo, hi = levels[k]
        x = np.searchsorted(s, left)
        n = np.searchsorted(s, left + window) - x
        at = np.repeat(x, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(left, n)
        ok = np.flatnonzero((lo[at] >= of) & (hi[at] <= of + window))
        ok = ok[np.lexsort((name[at[ok]], (e - s)[at[ok]], of[ok]))]
        best[of[ok]] = at[ok] + base[k]  # a window's last one stays
    name = np.concatenate([x[0] for x in levels])
    p = np.flatnonzero(inside)
    new = np.ones(len(p), bool)
    if len(p):
        new[1:] = (best[p][1:] != best[p][:-1]) | (text[p][1:] != text[p][:-1])
    at = np.flatnonzero(new)
    p0, p1 = p[at], p[np.r_[at[1:], len(p)] - 1] if len(p) else p
    return text[p0], p0, p1, name[best[p0]]


def _spans(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of words a:b."""
    up, down = W._WORDS.get(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    return W.mix(W.mix((sums[b] - sums[a]) * down[a]) + (b - a).astype(np.uint64))


def _runs(window: int, rounds: int):
    """One row per text, symbol and content: the content's starts in the text, and how many windows follow each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("substring")
        for b in batches:
            for i, j, buf, offsets in W.pieces(b.column(0)):
                w = W.split_words(buf, offsets)
                counts = w.counts()
                if not len(counts) or counts.max() < window:
                    continue
                h = w.hashes()
                text, p0, p1, name = window_symbols(h, w.offsets, window, rounds)
                body = _spans(h, p0, p1 + window)
                order = np.lexsort((body, name, text))
                text, p0, p1, name, body = (x[order] for x in (text, p0, p1, name, body))
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (name[1:] != name[:-1]) | (body[1:] != body[:-1])
                at = np.flatnonzero(new)
                starts = pa.array((p0 - w.offsets[text]).astype(np.int32))
                starts = pa.ListArray.from_arrays(pa.array(np.r_[at, len(text)].astype(np.int32)), starts)
                keys = [b.column(c + 1).slice(i, j - i).to_numpy()[text[at]] for c in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(name[at].view(np.int64)), pa.array(body[at].view(np.int64)), *map(pa.array, keys), pa.array((p1 - p0)[at].astype(np.int32)), starts], names=["sym", "body", *KEY, "more", "starts"])

    return run


def _expand(window: int):
    """Windows of the runs listed beside a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("substring")
        for b in batches:
            for i, j, buf, offsets in W.pieces(b.column(0)):
                w = W.split_words(buf, offsets)
                grams = W.window_hashes(w.hashes(), window, second=True)
                listed = b.column(1).slice(i, j - i)
                n = np.diff(listed.offsets.to_numpy())
                flat = listed.flatten()
                sym, body, times, p0, p1 = (flat.field(f).to_numpy() for f in ("sym", "body", "times", "p0", "p1"))
                size = (p1 - p0 + 1).astype(np.int64)
                first = np.repeat(w.offsets[:-1], n) + p0
                step = np.arange(size.sum()) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(sym, size)), pa.array(np.repeat(body, size)), pa.array(np.repeat(times, size)), pa.array(step.astype(np.int32)), pa.array(grams[np.repeat(first, size) + step].view(np.int64))],
                    names=["sym", "body", "times", "step", "gram"],
                )

    return run


def _cut(window: int, joined: bool):
    """(row, text, words, removed) of rows (row, text, spans): the words covered by the marked windows are out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("substring")
        for b in batches:
            for i, j, buf, offsets in W.pieces(b.column(1)):
                texts, n_removed = [], np.zeros(j - i, np.int64)
                w = W.split_words(buf, offsets)
                raw = buf.tobytes()
                marks = b.column(2).slice(i, j - i)
                ends = marks.offsets.to_numpy()
                flat = marks.flatten()
                p0, p1 = flat.field("p0").to_numpy(), flat.field("p1").to_numpy()
                for r in range(j - i):
                    x, y = ends[r] - ends[0], ends[r + 1] - ends[0]
                    whole = raw[offsets[r] : offsets[r + 1]]
                    if x == y:
                        texts.append(b" ".join(whole.split()) if joined else whole)
                        continue
                    a, z = w.offsets[r], w.offsets[r + 1]
                    delta = np.zeros(z - a + 1, np.int64)
                    np.add.at(delta, p0[x:y], 1)
                    np.add.at(delta, p1[x:y] + window, -1)
                    kept = np.flatnonzero(np.cumsum(delta[:-1]) == 0)
                    n_removed[r] = z - a - len(kept)
                    if joined:
                        parts = whole.split()
                        texts.append(b" ".join([parts[q] for q in kept.tolist()]))
                        continue
                    until = np.r_[w.starts[a + 1 : z], offsets[r + 1]]  # a kept word keeps the white space behind it
                    cut = np.flatnonzero(np.diff(kept) != 1)
                    heads, tails = np.r_[kept[:1], kept[cut + 1]], np.r_[kept[cut], kept[-1:]]
                    texts.append(b"".join(raw[w.starts[a + q] : until[t]] for q, t in zip(heads.tolist(), tails.tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(w.counts()), pa.array(n_removed)], names=["row", "text", "words", "removed"])

    return run


def repeated_windows(spark: SparkSession, documents: DataFrame, window: int = 35, rounds: int = ROUNDS) -> DataFrame:
    """(k1, k2, spans): for each text with repeated windows, the ranges p0..p1 of their first words.

    k1 = xxhash64(text), k2 = hash(text) name the text; texts that are equal share a row. A window is
    repeated if its words also start anywhere else, the same text and repeated rows included. Null and
    short texts have no window.
    """
    work = Workspace(spark, "substring")
    texts = documents.where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"))
    runs = work.save(texts.mapInArrow(_runs(window, rounds), "sym long, body long, k1 long, k2 int, more int, starts array<int>"), "snappy")
    counted = runs.groupBy("sym").agg(F.sum(F.size("starts")).alias("c"), F.min("body").alias("b0"), F.max("body").alias("b1"))
    # a table of its own, so that the join's sides are dealt apart from the counting and a hot symbol's rows can be split
    again = work.save(counted.where("c > 1").select("sym", (F.col("b0") != F.col("b1")).alias("mixed")))
    held = work.save(runs.join(again, "sym"), "snappy")
    work.drop(runs, again)
    mixed = held.where("mixed")
    one = F.min(F.struct(*KEY, F.col("starts")[0].alias("p0"), (F.col("starts")[0] + F.col("more")).alias("p1")))
    bodies = work.save(mixed.groupBy("sym", "body").agg(F.sum(F.size("starts")).alias("times"), one.alias("one")))
    listed = bodies.groupBy(F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2")).agg(F.collect_list(F.struct("sym", "body", "times", F.col("one.p0").alias("p0"), F.col("one.p1").alias("p1"))).alias("runs"))
    sources = texts.join(listed.hint("shuffle_hash"), list(KEY)).select("text", "runs")
    grams = work.save(sources.mapInArrow(_expand(window), "sym long, body long, times long, step int, gram long").distinct())
    more = grams.groupBy("sym", "gram").agg(F.sum("times").alias("all")).where("all > 1")
    steps = grams.where("times = 1").join(more, ["sym", "gram"]).groupBy("sym", "body").agg(F.collect_set("step").alias("steps"))
    steps = steps.unionByName(bodies.where("times > 1").select("sym", "body", F.lit(None).cast("array<int>").alias("steps")))
    partly = mixed.join(steps, ["sym", "body"]).select(*KEY, "more", "starts", "steps")
    found = partly.unionByName(held.where("not mixed").select(*KEY, "more", "starts", F.lit(None).cast("array<int>").alias("steps")))
    every = "transform(starts, p -> struct(p AS p0, p + more AS p1))"
    some = "flatten(transform(starts, p -> transform(steps, x -> struct(p + x AS p0, p + x AS p1))))"
    found = found.select(*KEY, F.expr(f"if(steps IS NULL, {every}, {some})").alias("spans"))
    spans = work.save(found.groupBy(*KEY).agg(F.flatten(F.collect_set("spans")).alias("spans")))
    work.only(spans)
    return spans


def drop_repeats(spark: SparkSession, documents: DataFrame, window: int = 35, rounds: int = ROUNDS, joined: bool = False, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """documents with every word taken out that a repeated window covers, plus n_words and n_removed.

    Words are runs of anything but ASCII white space and count unchanged. White space around kept words
    stays, or becomes one space each if joined. Null texts stay null and have no words; texts that lose
    all words become empty. Repeated rows repeat each other's words, so both lose them. Other columns may have any
    names; those called as `counts` says are replaced.
    """
    at = frames.place(documents, "text")
    spans = repeated_windows(spark, frames.pick(documents, "text"), window, rounds)
    others = [i for i, c in enumerate(documents.columns) if i != at and c not in counts]
    text = F.col(f"c{at}")
    # the row travels as one struct, so its columns clash with no name used here
    row = F.struct(F.isnull(text).alias("none"), *[F.col(f"c{i}") for i in others]).alias("row")
    rows = frames.numbered(documents).select(row, text.alias("whole"), F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"))
    marked = rows.join(spans.hint("shuffle_hash"), F.expr("t1 = k1 and t2 = k2 and whole is not null"), "left")
    marked = marked.select("row", F.coalesce("whole", F.lit("")).alias("whole"), F.coalesce("spans", F.array().cast("array<struct<p0:int,p1:int>>")).alias("spans"))
    done = marked.mapInArrow(_cut(window, joined), T.StructType([rows.schema["row"], *T.StructType.fromDDL("text string, words long, removed long")]))
    out = [F.when(~F.col("row.none"), F.col("text")).alias(c) if i == at else F.col(f"row.c{i}").alias(c) for i, c in enumerate(documents.columns) if i == at or i in others]
    return done.select(*out, F.col("words").alias(counts[0]), F.col("removed").alias(counts[1]))
