"""Periodic runs of words by Lyndon arrays.

A run's Lyndon root starts the longest Lyndon word at its place, under the order of words or under the reverse
one. For both orders one pass over a text finds, for every word, where the next smaller suffix begins, and how far the
two agree. What has matched once isn't compared again: within the farthest match so far the answers are those of the
matched place, and only beyond its end are words compared. Words are compared by rank alone.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm import frames
from strophe.llm import words as W

#: Texts of more words keep the pass's four tables as packed integers.
PACKED = 1 << 20


def _table(n: int, value: int) -> Sequence[int]:
    return [value] * n if n <= PACKED else array("q", [value]) * n


def lyndon_words(t: Sequence[int]) -> tuple[Sequence[int], Sequence[int]]:
    """(ends, match): where the longest Lyndon word from each i ends, and how far the text from i agrees with the text from that end.

    t ends with a -1, which is no symbol of the text.
    """
    n = len(t) - 1
    ends, match = _table(n, n), _table(n, 0)
    before, agree = _table(n, -1), _table(n, 0)  # the last smaller suffix before i, and how far the two agree
    far = low = shift = 0  # t[x] == t[x - shift] for low <= x < far
    for i in range(1, n):
        c, x = i - 1, t[i]
        while c >= 0 and t[c] > x:
            ends[c] = i
            c = before[c]
        if c < 0:
            continue
        if t[c] < x:
            before[i] = c
            continue
        m, known = 0, False
        while True:
            if not known:  # c and i agree on m symbols and one more
                if i < far and low <= c:
                    b, j = c - shift, i - shift
                    e = match[b] if ends[b] == j else agree[j] if before[j] == b else m
                    if i + e >= far:
                        e = far - i
                    if e > m:
                        m = e
                while t[c + m] == t[i + m]:
                    m += 1
                if i + m > far:
                    low, far, shift = i, i + m, i - c
            if t[c + m] < t[i + m]:
                before[i], agree[i] = c, m
                break
            ends[c], match[c] = i, m
            k, c = agree[c], before[c]
            if c < 0:
                break
            if k < m:
                before[i], agree[i] = c, k
                break
            known = k > m or t[c + m] != t[i + m]
    return ends, match


def find_runs(ranks: Sequence[int], exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least `exponent` (2 or more) periods and `least` symbols, by start, then period."""
    n, top = len(ranks), max(ranks, default=0)
    found = set()
    for reverse in (False, True):
        if n < 2:
            break
        t = [top - x for x in ranks] if reverse else list(ranks)
        t.append(-1)
        ends, match = lyndon_words(t)
        for i in [i for i, m in enumerate(match) if m]:
            q = ends[i] - i
            if match[i] <= (exponent - 2) * q or (i >= q and ends[i - q] == i and match[i - q] >= q):
                continue  # too few periods from here on, or the root stands one period earlier as well
            k = 0
            while k < i and t[i - 1 - k] == t[i + q - 1 - k]:  # less than a period
                k += 1
            length = k + q + match[i]
            if length >= max(least, exponent * q):
                found.add((i - k, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _ranks(words: list[bytes]) -> list[int]:
    rank = {w: k for k, w in enumerate(sorted(set(words)))}
    return [rank[w] for w in words]


def _collapse(exponent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("runs")
        for b in batches:
            found, kept, counts, removed, seen = [], [], [], [], 0
            for t in b.column(1).cast(pa.binary()):
                whole = t.as_py() or b""
                seen += len(whole)
                words = whole.split()
                runs = find_runs(_ranks(words), exponent, least)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                counts.append(len(words))
                if runs:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s, n, q in runs:
                        gone[s + q] += 1
                        gone[s + n] -= 1
                    words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=["row", "runs", "collapsed", "n_words", "n_removed"])
            W.release(seen)

    return run


def collapse_runs(documents: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, runs, collapsed, n_words, n_removed.

    Words are runs of anything but ASCII white space. A run is a stretch of words with smallest period q, at least `exponent` times q
    and `least` words long, that no neighbouring word extends; runs holds (start, length, period), ordered by start, then period.
    collapsed is the text without the words that some run holds after its first q words, joined by one space. Null and empty texts have
    no words, no runs and an empty collapsed text; repeated rows and null ids are each kept; other columns are not read. A text is
    worked on whole in one task, in time linear in its words but for the steps from a root back to its run's start.
    """
    documents = frames.pick(documents, "doc_id", "text")
    kind = T.StructType([documents.schema["doc_id"], *T.StructType.fromDDL("runs array<struct<start: long, length: long, period: long>>, collapsed string, n_words long, n_removed long")])
    return documents.mapInArrow(_collapse(exponent, least), kind)


def run_digest(collapsed: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest one (ties: smallest start, then period; nulls without runs), and digests of all runs and of the kept words."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = collapsed.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    milli = F.floor(F.expr("(1000 * best.length) div (-best.period)")).cast("long")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def plant_periods(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text), a tenth of them, by a checksum of doc_id, with words that repeat from some word on.

    With h = crc32 of the decimal doc_id and g = h div 10, where h is a multiple of 10 and the text has n > 0 words, word i >= a becomes
    word a + (i - a) mod p, a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Rows of null ids or texts stay as they are.
    """
    rows = frames.pick(documents, "doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    rows = rows.withColumn("n", F.when(F.size("w") > 0, F.size("w")))
    rows = rows.withColumn("a", F.expr("int((h div 10) % n)")).withColumn("p", F.expr("int(1 + (n - a) div (3 + (h div 10) % 8))"))
    again = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), int((n - a) div p) + 1)), 1, n - a)")
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(F.concat(F.expr("slice(w, 1, a)"), again), " ")).otherwise(F.col("text")).alias("text"))
