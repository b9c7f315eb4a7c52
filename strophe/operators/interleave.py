"""Padding, interleaving and separators of all copies of a track in one pass over its sorted rows.

The rows of a task's tracks stream by in order of track and time, each track behind a head that says what its copies are. Every copy keeps
what it must: the time of its last event, its place, and the rows that a later control may still come before, which all lie within delta
ticks. So memory doesn't grow with a track's length. Results leave as pieces of a sequence, arrays of at most PIECE triples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.functions import vocab as V

PIECE = 4096
#: What a piece holds besides its shard and track: its first place in the sequence, the sequence's flag, and times, durations and note tokens.
PIECES = "start long, flag int, time array<int>, dur array<int>, note array<int>"


class _Copy:
    """One copy of a track. Rows wait as columns key, rank (0 control, 1 event or rest), time, duration, note."""

    def __init__(self, k: int, density: int, delta: int):
        self.k, self.density, self.delta = k, density, delta
        self.last, self.at = 0, 1  # the time of the last event or rest; the separator has place 0
        self.wait = np.zeros((5, 0), np.int64)
        self.on, self.next, self.end = True, 0, 0
        self.head = True  # the separator is still to come

    def in_span(self, times: np.ndarray, waits: np.ndarray) -> np.ndarray:
        """Which of these events lie in spans; the turns alone are looked for one after the other."""
        hit = np.zeros(len(times), bool)
        i = 0
        while i < len(times):
            if self.on:
                j = i + int(np.searchsorted(times[i:], self.end))
                hit[i:j] = True
                if j == len(times):
                    break
                self.on, self.next = False, int(times[j] + waits[j])
                i = j
            else:
                i += int(np.searchsorted(times[i:], self.next))
                if i == len(times):
                    break
                self.on, self.end = True, int(times[i]) + self.delta
        return hit

    def rests(self, time: int) -> None:
        """Rests up to a time that no later event lies before."""
        n = max(0, (time - self.last - 1) // self.density)
        if n:
            times = self.last + self.density * np.arange(1, n + 1)
            self._add(np.r_[self.last, times[:-1]], 1, times, np.zeros(n, np.int64), np.full(n, V.REST))
            self.last = int(times[-1])

    def _add(self, key, rank, time, dur, note) -> None:
        self.wait = np.concatenate([self.wait, np.stack([key, np.full(len(key), rank), time, dur, note])], 1)

    def feed(self, times: np.ndarray, durs: np.ndarray, notes: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Rows (time, duration, note) that are final after these events, of which `hit` are controls."""
        self._add(times[hit] - self.delta, 0, times[hit], durs[hit], notes[hit] + V.CONTROL_OFFSET)
        t = times[~hit]
        if len(t):
            before = np.r_[self.last, t[:-1]]
            n = np.maximum((t - before - 1) // self.density, 0)
            ends = np.cumsum(n + 1)
            padded = np.repeat(before - self.density * (ends - n - 2), n + 1) + self.density * np.arange(ends[-1])
            dur, note = np.zeros(ends[-1], np.int64), np.full(ends[-1], V.REST)
            padded[ends - 1], dur[ends - 1], note[ends - 1] = t, durs[~hit], notes[~hit]
            self._add(np.r_[self.last, padded[:-1]], 1, padded, dur, note)
            self.last = int(t[-1])
        self.rests(int(times[-1]))
        return self._out(int(times[-1]) - self.delta)

    def close(self, end: int) -> np.ndarray:
        self.rests(end)
        return self._out(None)

    def _out(self, before: int | None) -> np.ndarray:
        rows = self.wait[:, np.lexsort((self.wait[1], self.wait[0]))]
        if before is None:  # controls behind the last event stay out
            events = np.flatnonzero(rows[1])
            n = int(events[-1]) + 1 if len(events) else 0
            self.wait = rows[:, :0]
        else:
            n = int(np.count_nonzero((rows[0] < before) & (rows[0] <= self.last)))
            self.wait = rows[:, n:]
        return rows[2:, :n]


class _Pieces:
    """Collects the pieces of sequences."""

    fields = ("shard", "track", "end_time", "copies", "rates", "parts")

    def __init__(self, shard: pa.DataType, track: pa.DataType):
        self.types = (shard, pa.struct([("track", track), ("k", pa.int64())]), pa.int64(), pa.int32())
        self.held: list[tuple] = []
        self.size = 0

    def start(self, head: dict, copies: list[_Copy]) -> None:
        pass

    def put(self, head: dict, copy: _Copy, rows: np.ndarray) -> None:
        for x in range(0, rows.shape[1], PIECE):
            some = rows[:, x : x + PIECE].astype(np.int32)
            self.held.append((head["shard"], {"track": head["track"], "k": copy.k}, copy.at + x, _flag(copy), some))
        self.size += rows.shape[1]

    def end(self, head: dict, copies: list[_Copy]) -> None:
        pass

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns = [pa.array([x[c] for x in self.held], kind) for c, kind in enumerate(self.types)]
            yield pa.RecordBatch.from_arrays([*columns, *_lists([x[4] for x in self.held])], names=["shard", "track", "start", "flag", "time", "dur", "note"])
        self.held.clear()
        self.size = 0


class _Sizes:
    """Collects the tracks' heads and how many triples each copy has."""

    fields = _Pieces.fields

    def __init__(self, shard: pa.DataType, track: pa.DataType):
        longs = pa.list_(pa.int64())
        self.types = {"shard": shard, "track": track, "end_time": pa.int64(), "copies": longs, "rates": pa.list_(pa.int32()), "parts": pa.list_(longs), "sizes": longs}
        self.held: list[dict] = []
        self.size = 0

    def start(self, head: dict, copies: list[_Copy]) -> None:
        pass

    def put(self, head: dict, copy: _Copy, rows: np.ndarray) -> None:
        pass

    def end(self, head: dict, copies: list[_Copy]) -> None:
        self.held.append(head | {"sizes": [c.at for c in copies]})
        self.size += 32

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in self.held], kind) for c, kind in self.types.items()], names=list(self.types))
        self.held.clear()
        self.size = 0


class _Chunks:
    """Collects rows of `width` triples, cut from the sequences of a shard end to end, whose places are known.

    Rows that a track has alone leave finished, with their flag where that doesn't hang on another track's rows; of rows that tracks share, each
    gives its part. A track holds, for every copy, its first row and the parts of the rows that it shares with the copies before and behind it.
    """

    fields = (*_Pieces.fields, "base", "sizes")

    def __init__(self, shard: pa.DataType, width: int, max_time: int):
        self.types = (shard, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        self.width, self.max_time = width, max_time
        self.held: list[tuple] = []
        self.size = 0

    def start(self, head: dict, copies: list[_Copy]) -> None:
        bases = np.cumsum([head["base"], *head["sizes"]]).tolist()
        self.rest = {c.k: (base, np.zeros((3, 0), np.int64)) for c, base in zip(copies, bases, strict=False)}  # from which place on, what
        self.known: dict[int, tuple] = {}  # the last row of each copy: its number, whether it is discarded, its flag
        self.wait: dict[int, list] = {}  # by row: place, flag and triples of its parts

    def put(self, head: dict, copy: _Copy, rows: np.ndarray) -> None:
        at, before = self.rest[copy.k]
        rows = np.concatenate([before, rows], 1)
        n = -at % self.width
        if n and rows.shape[1] >= n:
            self._part(copy, at, rows[:, :n])
            at, rows, n = at + n, rows[:, n:], 0
        many = 0 if n else rows.shape[1] // self.width
        if many:
            first = at // self.width
            block = rows[:, : many * self.width].reshape(3, many, self.width)
            for i, (cut, least, lost, time) in enumerate(self._finished(block[0], block[2])):
                last, own = self.known.get(copy.k), _flag(copy)
                flag = own if cut == 1 or last and not last[1] else last and last[2]
                if last is None and flag is None:
                    self._part(copy, at, block[:, 0].copy())
                else:
                    self._row(head, first + i, own, flag, cut, least, lost, np.stack([time, block[1, i], block[2, i]]))
                self.known[copy.k] = (first + i, lost, flag)
        self.rest[copy.k] = (at + many * self.width, rows[:, many * self.width :])

    def _finished(self, time: np.ndarray, note: np.ndarray):
        """(place of the first separator from 1 or one more than all, least time before it, discarded, times relative to that) of each row."""
        seps = note == V.SEPARATOR
        cut = np.where(seps.any(1), seps.argmax(1), self.width)
        ahead = np.arange(self.width) < cut[:, None]
        least = np.where(cut > 0, np.where(ahead, time, np.iinfo(np.int64).max).min(1), 0)
        time = time - np.where(ahead, least[:, None], 0)
        return zip((cut + 1).tolist(), least.tolist(), (time.max(1) >= self.max_time).tolist(), time, strict=True)

    def _part(self, copy: _Copy, at: int, rows: np.ndarray) -> None:
        self.wait.setdefault(at // self.width, []).append((at % self.width, _flag(copy), rows))

    def _row(self, head: dict, chunk: int, own: int, flag: int | None, cut: int, least: int, lost: bool, rows: np.ndarray) -> None:
        self.held.append((head["shard"], chunk, 0, own, flag, cut, least, lost, rows.astype(np.int32)))
        self.size += rows.shape[1]

    def end(self, head: dict, copies: list[_Copy]) -> None:
        if not copies:
            return
        if [c.at for c in copies] != head["sizes"]:
            raise ValueError(f"the notes of track {head['track']} are not the same when they are read again")
        for c in copies:
            at, rows = self.rest[c.k]
            if rows.shape[1]:
                self._part(c, at, rows)
        before = {chunk: (lost, flag) for chunk, lost, flag in self.known.values()}
        for chunk in sorted(self.wait):
            parts = sorted(self.wait[chunk], key=lambda x: x[0])
            rows, own = np.concatenate([x[2] for x in parts], 1), parts[0][1]
            if rows.shape[1] < self.width:
                self.held.append((head["shard"], chunk, parts[0][0], own, None, None, None, None, rows.astype(np.int32)))
                self.size += rows.shape[1]
                continue
            [(cut, least, lost, time)] = self._finished(rows[:1], rows[2:])
            last = before.get(chunk - 1)
            flag = own if cut == 1 or last and not last[0] else last and last[1]
            before[chunk] = (lost, flag)
            self._row(head, chunk, own, flag, cut, least, lost, np.stack([time, rows[1], rows[2]]))

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns = [pa.array([x[c] for x in self.held], kind) for c, kind in enumerate(self.types)]
            names = ["shard", "chunk", "q", "own", "flag", "cut", "start", "discarded", "time", "dur", "note"]
            yield pa.RecordBatch.from_arrays([*columns, *_lists([x[8] for x in self.held])], names=names)
        self.held.clear()
        self.size = 0


def _flag(copy: _Copy) -> int:
    return V.ANTICIPATE if copy.k % 10 else V.AUTOREGRESS


def _lists(rows: list[np.ndarray]) -> list[pa.Array]:
    cuts = pa.array(np.r_[0, np.cumsum([x.shape[1] for x in rows])].astype(np.int32))
    flat = np.concatenate(rows, 1)
    return [pa.ListArray.from_arrays(cuts, pa.array(flat[c]), type=pa.list_(pa.int32())) for c in range(3)]


def _pass(ks: dict[int, str], density: int, delta: int, collector: Callable[[], _Pieces | _Sizes | _Chunks]):
    random, spans, parts = ([k for k in ks if ks[k] == mode] for mode in ("random", "span", "instrument"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict | None = None
        copies: list[_Copy] = []
        out = collector()

        def put(copy: _Copy, rows: np.ndarray) -> None:
            if copy.head:
                rows = np.concatenate([np.array([[0], [0], [V.SEPARATOR]]), rows], 1)
                copy.head, copy.at = False, 0
            out.put(head, copy, rows)
            copy.at += rows.shape[1]

        def finish() -> None:
            if head is not None:
                for c in copies:
                    put(c, c.close(head["end_time"]))
                out.end(head, copies)

        for b in batches:
            heads = np.flatnonzero(b.column("rank").to_numpy() == 0)
            time, dur, note, instr = (b.column(c).to_numpy(zero_copy_only=False) for c in ("time", "dur", "note", "instr"))
            draws = [b.column(c).flatten().to_numpy().reshape(-1, max(n, 1)) if n else None for c, n in (("u", len(random)), ("wait", len(spans)))]
            seen = 0  # events of this batch so far; heads have no draws
            cuts = np.r_[0, heads, b.num_rows].tolist()
            for nth, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if nth:  # what stands before the first head belongs to the batch before
                    finish()
                    head = {c: b.column(c)[x].as_py() for c in out.fields} | {"of": b.column("track")[x]}
                    copies = [_Copy(k, density, delta) for k in head["copies"] or ()]
                    if copies:
                        out.start(head, copies)
                    x += 1
                if x == y:
                    continue
                if head is None or not b.column("track")[x] == b.column("track")[y - 1] == head["of"]:
                    raise ValueError("events of a track without its head")
                u, wait = (d[seen : seen + y - x] if d is not None else None for d in draws)
                seen += y - x
                t, d, n = (c[x:y].astype(np.int64) for c in (time, dur, note))
                for c in copies:
                    mode = ks[c.k]
                    if mode == "random":
                        at = random.index(c.k)
                        hit = u[:, at] < head["rates"][at] / 10
                    elif mode == "span":
                        hit = c.in_span(t, wait[:, spans.index(c.k)])
                    elif mode == "instrument":
                        hit = np.isin(instr[x:y], head["parts"][parts.index(c.k)])
                    else:
                        hit = np.zeros(y - x, bool)
                    put(c, c.feed(t, d, n, hit))
                if out.size >= 1 << 18:
                    yield from out.flush()
        finish()
        yield from out.flush()

    return run


def _starts(heads: DataFrame, ks: dict[int, str], seed: str) -> DataFrame:
    """heads with what is drawn by track: rates of the copies by chance, instruments of those by instruments."""

    def drawn(k: int) -> Column:
        order = F.array_sort(F.transform("parts", lambda i: F.struct(V.uniform(seed, "instrument", _of(k), i).alias("u"), i.alias("i"))))
        n = F.when(F.size("parts") > 1, 1 + F.floor(V.uniform(seed, "instruments", _of(k)) * (F.size("parts") - 1))).otherwise(0).cast("int")
        return F.slice(F.transform(order, lambda x: x["i"]), 1, n)

    parts = [k for k in ks if ks[k] == "instrument"]
    return heads.select(
        "track", "shard", "end_time", "copies",
        _numbers("int", [1 + F.floor(V.uniform(seed, "rate", _of(k)) * 9) for k in ks if ks[k] == "random"]).alias("rates"),
        (F.array(*[drawn(k) for k in parts]) if parts else F.array()).cast("array<array<long>>").alias("parts"),
    )


def _of(k: int) -> Column:
    return F.struct(F.col("track").alias("track"), F.lit(k).cast("long").alias("k"))


def _numbers(kind: str, columns: list[Column]) -> Column:
    return (F.array(*columns) if columns else F.array()).cast(f"array<{kind}>")


def _streamed(events: DataFrame, starts: DataFrame, ks: dict[int, str], seed: str, span_wait: int, tasks: int | None) -> DataFrame:
    """Tracks, each its head and its events in order, with the events' draws. One exchange by track."""
    random, spans = ([k for k in ks if ks[k] == mode] for mode in ("random", "span"))
    rows = events.select("track", F.lit(1).alias("rank"), "pos", "time", "dur", "instr", (V.NOTE_OFFSET + F.col("instr") * V.MAX_PITCH + F.col("pitch")).alias("note"))
    both = rows.unionByName(starts.withColumn("rank", F.lit(0)), allowMissingColumns=True)
    both = (both.repartition(tasks, "track") if tasks else both.repartition("track")).sortWithinPartitions("track", "rank", "time", "pos")
    # an event's draws follow from its track and place, so they are made behind the exchange, which they would more than double
    u = _numbers("double", [V.uniform(seed, "random", _of(k), F.col("pos")) for k in random])
    wait = _numbers("long", [F.floor(-F.ln(1 - V.uniform(seed, "span", _of(k), F.col("pos"))) * span_wait) for k in spans])
    return both.withColumns({"u": F.when(F.col("rank") == 1, u), "wait": F.when(F.col("rank") == 1, wait)})


def interleaved(events: DataFrame, heads: DataFrame, ks: dict[int, str], seed: str, span_wait: int, density: int = V.RESOLUTION, delta: int = V.DELTA) -> DataFrame:
    """Pieces (shard, track, start, flag, time, dur, note) of the sequences of every copy; track is (track, k).

    events: (track, pos, time, dur, instr, pitch). heads: (track, shard, end_time, copies, parts), one for every track that has events; tracks
    whose copies are null give nothing. parts lists a track's instruments. ks says how copy k is augmented. One exchange by track.
    """
    kinds, shard, track = _kinds(heads)
    both = _streamed(events, _starts(heads, ks, seed), ks, seed, span_wait, None)
    out = T.StructType([kinds["shard"], T.StructField("track", T.StructType([kinds["track"], T.StructField("k", T.LongType())])), *T.StructType.fromDDL(PIECES)])
    return both.mapInArrow(_pass(ks, density, delta, lambda: _Pieces(shard, track)), out)


def sized(events: DataFrame, heads: DataFrame, ks: dict[int, str], seed: str, span_wait: int, tasks: int | None = None, density: int = V.RESOLUTION, delta: int = V.DELTA) -> DataFrame:
    """The heads of interleaved() with rates and parts drawn, and sizes, the triples of each copy's sequence."""
    kinds, shard, track = _kinds(heads)
    both = _streamed(events, _starts(heads, ks, seed), ks, seed, span_wait, tasks)
    out = T.StructType([kinds["shard"], kinds["track"], *T.StructType.fromDDL("end_time long, copies array<long>, rates array<int>, parts array<array<long>>, sizes array<long>")])
    return both.mapInArrow(_pass(ks, density, delta, lambda: _Sizes(shard, track)), out)


def chunked(events: DataFrame, placed: DataFrame, ks: dict[int, str], seed: str, span_wait: int, width: int, max_time: int, tasks: int | None = None, density: int = V.RESOLUTION, delta: int = V.DELTA) -> DataFrame:
    """Rows (shard, chunk, q, own, flag, cut, start, discarded, time, dur, note) of `width` triples of the sequences, end to end by shard.

    placed: what sized() gave, with base, the triples of the shard before the track. own is the flag of the sequence that the row begins in, cut
    the place of its first separator from 1 (width + 1 without one). flag is null where it hangs on rows that the track doesn't have alone. Of a
    row that tracks share each gives the part from place q on as it is, cut, start and discarded null.
    """
    kinds, shard, _ = _kinds(placed)
    both = _streamed(events, placed, ks, seed, span_wait, tasks)
    out = T.StructType([kinds["shard"], *T.StructType.fromDDL("chunk long, q int, own int, flag int, cut int, start int, discarded boolean, time array<int>, dur array<int>, note array<int>")])
    return both.mapInArrow(_pass(ks, density, delta, lambda: _Chunks(shard, width, max_time)), out)


def _kinds(heads: DataFrame) -> tuple[dict[str, T.StructField], pa.DataType, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {c: T.StructField(c, heads.schema[c].dataType) for c in ("shard", "track")}
    return kinds, to_arrow_type(kinds["shard"].dataType), to_arrow_type(kinds["track"].dataType)
