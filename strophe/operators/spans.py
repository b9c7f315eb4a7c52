"""Spans of anticipated events by composing the maps of a two-state machine.

Outside a span the machine waits for a time; the first event at or past it begins a span, which lasts DELTA ticks; the first event at or
past its end leaves it and draws the next wait. What a chunk of a track does to the state that enters depends only on the first of its events at
or past the state's time. So each chunk is turned into a map by itself, of an entry for each event at most; one look into each of a track's maps,
as they stream by in order, gives the state that enters each chunk; and the chunks are marked by themselves. No task holds a whole track.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.functions import vocab as V
from strophe.llm.store import small_batches
from strophe.plans.scratch import stored

#: Places of a track that a chunk takes.
CHUNK = 4096
#: Chunks that a task looks at together.
TOGETHER = 64
#: A state: in a span or not, and the time that ends this.
State = tuple[bool, int]
START: State = (True, 0)
_SIDE = "array<struct<upto: long, on: boolean, time: long>>"


def chunk_map(times: np.ndarray, waits: np.ndarray, delta: int) -> tuple[list, list]:
    """What a chunk of events in order of time does to states outside a span and within one.

    Each side is a list of (time, state): states whose time is at most that, and past the one before, leave the chunk as this state.
    Later ones leave as they came.
    """
    n = len(times)
    resume = np.maximum(np.searchsorted(times, times + waits), np.arange(n)).tolist()  # the event that begins a span after a wait drawn here
    leave = np.searchsorted(times, times + delta).tolist()  # the event that leaves a span begun here
    t, w = times.tolist(), waits.tolist()
    begun: list[State] = [START] * n  # the state at the end if a span begins, or is left, at this event
    left: list[State] = [START] * n
    for j in range(n - 1, -1, -1):
        begun[j] = (True, t[j] + delta) if leave[j] == n else left[leave[j]]
        left[j] = (False, t[j] + w[j]) if resume[j] == n else begun[resume[j]]
    sides = []
    for states in (begun, left):
        side: list[tuple[int, State]] = []
        for j in range(n):
            if j and t[j] == t[j - 1]:
                continue  # the first event of a time is the one that counts
            if side and side[-1][1] == states[j]:
                side[-1] = (t[j], states[j])
            else:
                side.append((t[j], states[j]))
        sides.append(side)
    return sides[0], sides[1]


def _through(state: State, bounds: Sequence[int], out: list[State]) -> State:
    at = int(np.searchsorted(bounds, state[1])) if len(bounds) else 0
    return out[at] if at < len(bounds) else state


def marked(state: State, times: np.ndarray, waits: np.ndarray, delta: int) -> np.ndarray:
    """Which events lie in spans, given the state that enters; the turns alone are looked for one after the other."""
    on, until = state
    hit, i = np.zeros(len(times), bool), 0
    while i < len(times):
        j = i + int(np.searchsorted(times[i:], until))
        if on:
            hit[i:j] = True
        i = j
        if i < len(times):
            on, until = (False, int(times[i] + waits[i])) if on else (True, int(times[i]) + delta)
    return hit


def _events(rows: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(times, waits, places in the list) of each list's events."""
    cuts = rows.offsets.to_numpy()
    flat = rows.flatten()
    kind = flat.field("kind").to_numpy(zero_copy_only=False) == "event"
    time, wait = (flat.field(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("time", "wait"))
    for a, b in zip((cuts[:-1] - cuts[0]).tolist(), (cuts[1:] - cuts[0]).tolist(), strict=True):
        at = np.flatnonzero(kind[a:b])
        yield time[a:b][at].astype(np.int64), wait[a:b][at].astype(np.int64), at


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of them stays as small however many chunks a batch has."""
    for b in batches:
        for i in range(0, b.num_rows, TOGETHER):
            yield b.slice(i, TOGETHER)


def _packed(side: list[tuple[int, State]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([u for u, _ in side], np.int64), np.array([s[0] for _, s in side], bool), np.array([s[1] for _, s in side], np.int64)


def _lists(sides: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.ListArray:
    cuts = pa.array(np.cumsum([0, *(len(x[0]) for x in sides)]).astype(np.int32))
    return pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*sides, strict=True)], names=["upto", "on", "time"]))


def _sides(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(upto, on, time) of each list."""
    cuts, flat = lists.offsets.to_numpy(), lists.flatten()
    columns = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("upto", "on", "time")]
    for a, b in zip((cuts[:-1] - cuts[0]).tolist(), (cuts[1:] - cuts[0]).tolist(), strict=True):
        yield tuple(c[a:b] for c in columns)


def _maps(delta: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            off, on = zip(*(map(_packed, chunk_map(times, waits, delta)) for times, waits, _ in _events(b.column("rows"))), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("track"), b.column("chunk"), _lists(off), _lists(on)], names=["track", "chunk", "off", "on"])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that enters each chunk; rows (track, chunk, off, on) stand sorted by track and chunk."""
    track, state = None, START
    for b in batches:
        states = []
        for key, off, on in zip(b.column("track").to_pylist(), _sides(b.column("off")), _sides(b.column("on")), strict=True):
            if key != track:
                track, state = key, START
            states.append(state)
            upto, *ends = on if state[0] else off
            state = _through(state, upto, list(zip(*(x.tolist() for x in ends), strict=True)))
        yield pa.RecordBatch.from_arrays([b.column("track"), b.column("chunk"), pa.array([s[0] for s in states], pa.bool_()), pa.array([s[1] for s in states], pa.int64())], names=["track", "chunk", "on", "until"])


def _mark(delta: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            rows, hits = b.column("rows"), []
            sizes = np.diff(rows.offsets.to_numpy()).tolist()
            for n, on, until, (times, waits, at) in zip(sizes, b.column("on").to_pylist(), b.column("until").to_pylist(), _events(rows), strict=True):
                hit = np.zeros(n, bool)
                hit[at] = marked((on, until), times, waits, delta)
                hits.append(hit)
            flat = pa.array(np.concatenate(hits) if hits else np.zeros(0, bool))
            cuts = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("track"), rows, pa.ListArray.from_arrays(cuts, flat)], names=["track", "rows", "hits"])

    return run


def extract_spans(df: DataFrame, mean_wait: int, seed: str = "0", delta: int = V.DELTA) -> DataFrame:
    """Events in spans of `delta` ticks become controls; waits between spans are exponential with this mean in ticks.

    Tracks are sorted by time. The machine begins within a span that ends at time 0, so the first event draws a wait. Other rows stay.
    """
    small_batches(df.sparkSession)
    rows = df.withColumn("wait", F.floor(-F.ln(1 - V.uniform(seed, "span", F.col("track"), F.col("pos"))) * mean_wait).cast("long"))
    cell = F.struct("pos", "kind", "time", "dur", "instr", "pitch", "wait")
    chunks = stored(rows.groupBy("track", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(cell)).alias("rows")))
    key = [chunks.schema["track"], chunks.schema["chunk"]]
    maps = chunks.mapInArrow(_maps(delta), T.StructType([*key, *T.StructType.fromDDL(f"off {_SIDE}, on {_SIDE}")]))
    entries = maps.repartition("track").sortWithinPartitions("track", "chunk").mapInArrow(_entries, T.StructType([*key, *T.StructType.fromDDL("on boolean, until long")]))
    done = chunks.join(stored(entries), ["track", "chunk"]).select("track", "rows", "on", "until")
    done = done.mapInArrow(_mark(delta), T.StructType([key[0], chunks.schema["rows"], *T.StructType.fromDDL("hits array<boolean>")]))
    hit = lambda r, i: r.withField("kind", F.when(F.get("hits", i), "control").otherwise(r["kind"])).dropFields("wait")
    return done.select("track", F.inline(F.transform("rows", hit))).select(*V.NOTE_COLUMNS)
