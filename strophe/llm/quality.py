"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are measured on its bytes and words, and on those of the lines
before and after it; a 2 x 2 table of transitions ties neighbouring lines. Training lines carry their
document's label. A document's quality is the length-weighted mean of its lines' forward-backward
marginals, put on the scale of a probability by a two-parameter logistic fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm import frames
from strophe.llm import words as W

#: The labelled rows that a fit may use at most (taken in the order of a hash of doc_id).
SAMPLE = 6000
STEPS, PENALTY = 150, 1e-3
#: The lines in a row that a text gives to a fit at most, from a place that a hash of its lines draws; scores are of whole texts.
LINES = 128

_CLASS = np.zeros(256, np.uint8)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 symbol, 6 non-ASCII, 7 white space
_CLASS[33:127] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 7
BASE = 14


@dataclass
class Lines:
    """Non-blank lines of consecutive texts; text i has lines offsets[i]:offsets[i + 1]."""

    features: np.ndarray
    sizes: np.ndarray
    offsets: np.ndarray


def _per(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return total / np.maximum(n, 1)


def lines_of(buf: np.ndarray, offsets: np.ndarray) -> Lines:
    """Lines end at 0x0A; blank ones don't count."""
    brk = np.flatnonzero(buf == 10)
    cuts = np.unique(np.r_[offsets, brk, brk + 1])
    a, b = cuts[:-1], cuts[1:]
    kind = _CLASS[buf]
    upto = lambda mask: np.r_[0, np.cumsum(mask)]
    ink = upto(kind != 7)
    full = ink[b] > ink[a]
    a, b = a[full], b[full]
    doc = np.searchsorted(a, offsets)
    w = W.split_words(buf, offsets)
    first, last = np.searchsorted(w.starts, a), np.searchsorted(w.starts, b)
    n, size = last - first, (ink[b] - ink[a]).astype(float)
    h = w.hashes()
    line = np.repeat(np.arange(len(a)), n)
    order = np.lexsort((h, line))
    again = np.r_[False, (h[order][1:] == h[order][:-1]) & (line[order][1:] == line[order][:-1])]
    repeats = np.bincount(line[order], weights=again, minlength=len(a))[: len(a)]
    twin = np.r_[False, (h[1:] == h[:-1]) & (line[1:] == line[:-1])]
    twins = np.bincount(line, weights=twin, minlength=len(a))[: len(a)]
    ends = kind[w.ends - 1] == 5 if len(h) else np.zeros(0, bool)
    marked = np.bincount(line, weights=ends, minlength=len(a))[: len(a)]
    lengths = w.ends - w.starts
    short = np.bincount(line, weights=lengths <= 3, minlength=len(a))[: len(a)]
    capital = np.bincount(line, weights=kind[w.starts] == 2 if len(h) else None, minlength=len(a))[: len(a)] if len(h) else np.zeros(len(a))
    share = lambda k: _per((c := upto(kind == k))[b] - c[a], size)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(doc))
    name = np.add.reduceat(np.r_[W.mix(h + np.uint64(1)), np.uint64(0)], first) if len(a) else np.zeros(0, np.uint64)
    seen = np.lexsort((name, text))
    same = np.zeros(len(a), bool)
    if len(a) > 1:
        eq = (name[seen][1:] == name[seen][:-1]) & (text[seen][1:] == text[seen][:-1])
        same[seen[1:][eq]] = True
        same[seen[:-1][eq]] = True
    x = np.stack([
        np.log1p(size), np.log1p(n), _per(size, n), _per(repeats, n), _per(twins, n), _per(marked, n), _per(short, n), _per(capital, n),
        share(2), share(3), share(4), share(5), share(6), same.astype(float),
    ], axis=1) if len(a) else np.zeros((0, BASE))
    return Lines(_beside(x, doc), size, doc)


def _beside(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after (the own ones at an end), and end marks."""
    if not len(x):
        return np.zeros((0, 3 * BASE + 2))
    n = np.diff(offsets)
    first, last = offsets[:-1][n > 0], offsets[1:][n > 0] - 1
    before, after = np.arange(len(x)) - 1, np.arange(len(x)) + 1
    before[first], after[last] = first, last
    marks = np.zeros((len(x), 2))
    marks[first, 0], marks[last, 1] = 1, 1
    return np.hstack([x, x[before], x[after], marks])


def forward_backward(unary: np.ndarray, offsets: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of chains with log-potentials (bad 0, good unary) and trans: P(good) of each line, expected transitions, sum of log Z."""
    n = np.diff(offsets)
    good = np.zeros(len(unary))
    pairs, log_z = np.zeros((2, 2)), 0.0
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if not len(order):
        return good, pairs, log_z
    starts, lengths = offsets[:-1][order], n[order]
    alpha = np.zeros((len(unary), 2))
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # chains with more than t lines
    now = np.zeros((len(order), 2))
    for t, k in enumerate(live.tolist()):
        at = starts[:k] + t
        now = now[:k]
        if t:
            m = now[:, :, None] + trans[None]
            now = np.logaddexp(m[:, 0], m[:, 1])
        else:
            now = np.zeros((k, 2))
        now[:, 1] += unary[at]
        alpha[at] = now
    z = np.zeros(len(unary))
    ends = starts + lengths - 1
    zs = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    log_z = float(zs.sum())
    beta = np.zeros((len(unary), 2))
    for t in range(len(live) - 2, -1, -1):
        k = live[t + 1]
        at, nxt = starts[:k] + t, starts[:k] + t + 1
        out = beta[nxt].copy()
        out[:, 1] += unary[nxt]
        m = trans[None] + out[:, None, :]
        beta[at] = np.logaddexp(m[:, :, 0], m[:, :, 1])
        pairs += np.exp(alpha[at][:, :, None] + m - zs[:k, None, None]).sum(axis=0)
    z[np.concatenate([np.arange(s, s + c) for s, c in zip(starts, lengths, strict=True)])] = np.repeat(zs, lengths)
    good = np.exp(alpha[:, 1] + beta[:, 1] - z)
    return good, pairs, log_z


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    slope: float
    shift: float
    empty: float

    def marginals(self, lines: Lines) -> np.ndarray:
        unary = ((lines.features - self.mean) / self.scale) @ self.weights + self.bias
        return forward_backward(unary, lines.offsets, self.trans)[0]

    def raw(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean marginal of each text; nan without lines."""
        total = np.r_[0, np.cumsum(self.marginals(lines) * lines.sizes)]
        size = np.r_[0, np.cumsum(lines.sizes)]
        n = size[lines.offsets[1:]] - size[lines.offsets[:-1]]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 0, (total[lines.offsets[1:]] - total[lines.offsets[:-1]]) / n, np.nan)

    def scores(self, lines: Lines) -> np.ndarray:
        raw = np.clip(self.raw(lines), 1e-4, 1 - 1e-4)
        score = 1 / (1 + np.exp(-(self.slope * np.log(raw / (1 - raw)) + self.shift)))
        return np.where(np.isnan(score), self.empty, score)


def fit_lines(lines: Lines, labels: np.ndarray) -> QualityModel:
    """The field's maximum-likelihood fit (Adam on the exact gradient, L2) where every line has its text's label."""
    n = np.diff(lines.offsets)
    rate = (labels.sum() + 1) / (len(labels) + 2)
    blank = labels[n == 0]
    empty = (blank.sum() + 2 * rate) / (len(blank) + 2)
    mean = lines.features.mean(axis=0) if len(lines.features) else np.zeros(3 * BASE + 2)
    scale = lines.features.std(axis=0) + 1e-6 if len(lines.features) else np.ones(3 * BASE + 2)
    model = QualityModel(mean, scale, np.zeros(3 * BASE + 2), 0.0, np.zeros((2, 2)), 1.0, 0.0, float(empty))
    if len(lines.features):
        x = (lines.features - mean) / scale
        y = np.repeat(labels, n).astype(float)
        inner = np.ones(len(x), bool)
        inner[lines.offsets[1:][n > 0] - 1] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at].astype(int), y[at + 1].astype(int)), 1)
        p = np.zeros(x.shape[1] + 5)
        m, v, docs = np.zeros_like(p), np.zeros_like(p), max(1, int((n > 0).sum()))
        for t in range(1, STEPS + 1):
            good, pairs, _ = forward_backward(x @ p[:-5] + p[-5], lines.offsets, p[-4:].reshape(2, 2))
            d = good - y
            g = np.r_[x.T @ d, d.sum(), (pairs - seen).ravel()] / docs + PENALTY * p
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        model.weights, model.bias, model.trans = p[:-5], float(p[-5]), p[-4:].reshape(2, 2)
        raw = model.raw(lines)
        known = ~np.isnan(raw)
        raw, target = np.clip(raw[known], 1e-4, 1 - 1e-4), labels[known].astype(float)
        u = np.stack([np.log(raw / (1 - raw)), np.ones(len(raw))], axis=1)
        q = np.array([1.0, 0.0])
        for _ in range(30):  # Newton steps of a logistic fit, held near slope 1
            s = 1 / (1 + np.exp(-u @ q))
            g = u.T @ (s - target) + 0.1 * (q - [1.0, 0.0])
            q -= np.linalg.solve((u * (s * (1 - s))[:, None]).T @ u + 0.1 * np.eye(2), g)
        model.slope, model.shift = float(max(q[0], 0.01)), float(q[1])
    return model


def _drawn(sizes: np.ndarray, s: int, e: int, lines: int) -> tuple[int, int]:
    """At most so many lines in a row of lines s to e, from a place that their sizes draw."""
    if e - s <= lines:
        return s, e
    at = s + zlib.crc32(sizes.astype("<f8").tobytes()) % (e - s - lines + 1)
    return at, at + lines


def _features(lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("quality")
        yield from _each(batches, lines)

    return run


def _each(batches: Iterator[pa.RecordBatch], lines: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, buf, offsets in W.pieces(b.column(1)):
            x = lines_of(buf, offsets)
            spans = [_drawn(x.sizes[s:e], s, e, lines) for s, e in zip(x.offsets[:-1].tolist(), x.offsets[1:].tolist(), strict=True)]
            parts = [(x.features[s:e].astype("<f4").tobytes(), x.sizes[s:e].astype("<f4").tobytes()) for s, e in spans]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], names=["label", "features", "sizes"])


def fit_quality(spark: SparkSession, documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> QualityModel:
    """A model from documents (doc_id, text) with labels (doc_id, quality), at most `sample` of them and `lines` lines of each, which bounds what reaches the driver.

    Used are rows whose crc32 of doc_id as text, modulo 4, is not 2. Null labels don't count; several
    labels of a document are averaged, and of several rows of a doc_id the one whose text has the least hash is used. Without labels every text scores 0.5 or near it.
    """
    documents = frames.pick(documents, "doc_id", "text")
    known = frames.pick(labels, "doc_id", "quality").where("quality is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    some = known.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one = documents.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = one.select("label", "t.text").mapInArrow(_features(lines), "label int, features binary, sizes binary").collect()
    rows.sort(key=lambda r: (r[1], r[0]))
    width = 3 * BASE + 2
    features = np.frombuffer(b"".join(r[1] for r in rows), "<f4").reshape(-1, width).astype(float)
    sizes = np.frombuffer(b"".join(r[2] for r in rows), "<f4").astype(float)
    offsets = np.r_[0, np.cumsum([len(r[2]) // 4 for r in rows])].astype(np.int64)
    return fit_lines(Lines(features, sizes, offsets), np.array([r[0] for r in rows], np.int64))


def _score(model: QualityModel, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("quality")
        for b in batches:
            out = [model.scores(lines_of(buf, offsets)) for _, _, buf, offsets in W.pieces(b.column(text_at))]
            yield b.append_column("score", pa.array(np.concatenate(out) if out else np.zeros(0)))

    return run


def score_quality(documents: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """documents with a score of 0 to 1 in column `name`, replaced if there; other columns may have any names.

    Null and blank texts get the model's score of such texts. Repeated rows get the same score.
    """
    rows = frames.numbered(documents)
    scored = rows.mapInArrow(_score(model, frames.place(documents, "text")), T.StructType([*rows.schema, T.StructField("score", T.DoubleType())]))
    return scored.select(*[c for c, n in zip(frames.named(scored, documents.columns), documents.columns, strict=True) if n != name], F.col("score").alias(name))
