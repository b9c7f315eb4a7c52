"""Generation with a caller's model, many tracks at a time, and the arithmetic of where it starts and ends.

A track's steps depend on each other, so its loop runs within one task, but the loops of a task's tracks go on together: each asks for the
next token's logits, the model is called once for all that ask, and a track that has ended makes room for another. A model is a
function, sent to the tasks, from the tokens so far of several tracks to an array of the logits of each one's next token; `each` makes one of a
function for a single track.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Generator, Hashable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import vocab as V
from strophe.operators import sampling
from strophe.operators import sequence as S

Model = Callable[[list[list[int]]], np.ndarray]
Triple = tuple[int, int, int]
#: A loop gives the tokens so far, takes the next one's logits, and returns its triples.
Loop = Generator[list[int], np.ndarray, list[Triple]]
#: Triples that the model sees besides those it is drawing; instruments of a track; tracks that go on together.
HISTORY, CAP, OPEN = 339, 15, 64
#: Tokens whose logit is less than the best one's by more than this have a probability of 0 in double precision; they aren't sorted.
NOTHING = 746.0


def each(model: Callable[[list[int]], np.ndarray]) -> Model:
    """A model for several tracks that calls `model` for one after the other."""
    return lambda histories: np.stack([np.asarray(model(h), float) for h in histories])


def in_steps(model: Model, loops: Iterator[tuple[Hashable, Loop]], at_once: int = OPEN) -> Iterator[tuple[Hashable, list[Triple]]]:
    """(key, result) of each loop as it ends; in every step the model is called once for at most `at_once` open loops."""
    live: list[tuple[Hashable, Loop, list[int]]] = []
    loops = iter(loops)
    while True:
        while len(live) < at_once and (nxt := next(loops, None)) is not None:
            key, loop = nxt
            try:
                live.append((key, loop, next(loop)))
            except StopIteration as done:
                yield key, done.value
        if not live:
            return
        logits = np.asarray(model([history for *_, history in live]), float)
        if len(logits) != len(live):
            raise ValueError(f"the model gave {len(logits)} rows of logits for {len(live)} tracks")
        asked, live = live, []
        for (key, loop, _), row in zip(asked, logits, strict=True):
            try:
                live.append((key, loop, loop.send(row)))
            except StopIteration as done:
                yield key, done.value


class _Track:
    """Triples so far and the instruments among them; controls count under their instrument, rests as 129."""

    def __init__(self, triples: list[Triple]):
        self.triples: list[Triple] = []
        self.seen: set[int] = set()
        for t in triples:
            self.add(t)

    def add(self, t: Triple) -> None:
        self.triples.append(t)
        if t[2] < V.SEPARATOR:
            self.seen.add((t[2] - V.NOTE_OFFSET - (V.CONTROL_OFFSET if t[2] >= V.CONTROL_OFFSET else 0)) // V.MAX_PITCH)


def _time(t: Triple) -> int:
    return t[0] - V.CONTROL_OFFSET if t[0] >= V.CONTROL_OFFSET else t[0]


def allowed(slot: int, now: int, seen: set[int]) -> np.ndarray:
    """The tokens that may be drawn in a slot: its own kind or a rest, no time before now, and with CAP instruments seen no other."""
    ok = np.zeros(V.VOCAB, bool)
    ok[V.REST] = True
    if slot == 0:
        ok[V.TIME_OFFSET + max(0, now) : V.TIME_OFFSET + V.MAX_TIME] = True
    elif slot == 1:
        ok[V.DUR_OFFSET : V.DUR_OFFSET + V.MAX_DUR] = True
    elif len(seen) < CAP:
        ok[V.NOTE_OFFSET : V.NOTE_OFFSET + V.MAX_NOTE] = True
    else:
        for i in seen - {V.MAX_INSTR}:
            ok[V.NOTE_OFFSET + i * V.MAX_PITCH : V.NOTE_OFFSET + (i + 1) * V.MAX_PITCH] = True
    return ok


def draw(logits: np.ndarray, ok: np.ndarray, top_p: float, rng: np.random.Generator) -> int:
    """A token by its probability among those allowed and in the nucleus."""
    at = np.flatnonzero(ok)
    at = at[logits[at] >= logits[at].max() - NOTHING]
    order = at[np.argsort(-logits[at], kind="stable")]
    p = np.exp(logits[order] - logits[order[0]])
    p /= p.sum()
    if top_p < 1:
        p = np.where(np.r_[0.0, np.cumsum(p)[:-1]] <= top_p, p, 0.0)
        p /= p.sum()
    return int(rng.choice(order, p=p))


def next_triple(flag: int, track: _Track, now: int, top_p: float, rng: np.random.Generator) -> Generator[list[int], np.ndarray, Triple]:
    """One more triple: the last HISTORY ones, moved to their least time, are what the model sees."""
    recent = track.triples[-HISTORY:]
    base = min(map(_time, recent), default=0)
    history = [flag, *(x for t in recent for x in (t[0] - base, t[1], t[2]))]
    new: list[int] = []
    for slot in range(3):
        logits = yield history + new
        new.append(draw(logits, allowed(slot, now - base, track.seen), top_p, rng))
    return new[0] + base, new[1], new[2]


def anticipatory(flag: int, prompt: list[Triple], waiting: list[Triple], start: int, end: int, top_p: float, delta: int, rng: np.random.Generator) -> Loop:
    """The prompt and what the model adds before `end`; controls come in as soon as the time is within delta of theirs."""
    track, ahead = _Track(prompt), 0
    now = max((_time(t) for t in prompt if t[2] < V.CONTROL_OFFSET), default=0)
    while True:
        while ahead < len(waiting) and now >= _time(waiting[ahead]) - delta:
            track.add(waiting[ahead])
            ahead += 1
        new = yield from next_triple(flag, track, max(start, now), top_p, rng)
        if new[0] >= end:
            return track.triples
        track.add(new)
        now = new[0]


def autoregressive(prompt: list[Triple], later: list[Triple], start: int, end: int, top_p: float, rng: np.random.Generator) -> Loop:
    """The prompt and what the model adds before `end`; later events come in before the first new one that passes them, and the next of them at the end."""
    track, ahead = _Track(prompt), 0
    now = max(map(_time, prompt), default=0)
    while True:
        new = yield from next_triple(V.AUTOREGRESS, track, max(start, now), top_p, rng)
        if new[0] >= end:
            return track.triples + later[ahead : ahead + 1]
        now = new[0]
        while ahead < len(later) and now >= _time(later[ahead]):
            track.add(later[ahead])
            ahead += 1
        track.add(new)


def _listed(df: DataFrame, name: str) -> DataFrame:
    packed = S.encode_events(df).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("x"))
    return packed.select("track", F.transform("x", lambda x: x["tokens"]).alias(name))


def _run(tracks: DataFrame, model: Model, loop: Callable[..., Loop], seed: int, at_once: int) -> DataFrame:
    """Rows of the triples that loop(flag, prompt, ahead, start, end, rng) gives for each track."""

    def loops(frames: Iterator) -> Iterator[tuple[Hashable, Loop]]:
        for f in frames:
            for r in f.itertuples():
                lists = [[tuple(map(int, t)) for t in x] if x is not None else [] for x in (r.prompt, r.ahead)]
                yield r.track, loop(int(r.flag), *lists, int(r.start), int(r.end), np.random.default_rng(zlib.crc32(f"{seed}:{r.track}".encode())))

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for track, triples in in_steps(model, loops(frames), at_once):
            yield pd.DataFrame({"track": [track], "t": [[list(t) for t in triples]]})

    made = tracks.mapInPandas(run, "track long, t array<array<int>>").select("track", F.posexplode("t").alias("pos", "tokens"))
    return S.decode_events(made.withColumn("pos", F.col("pos").cast("long")))


def generate(inputs: DataFrame, controls: DataFrame, model: Model, start: int, end: int, top_p: float = 1.0, delta: int = V.DELTA, seed: int = 0, at_once: int = OPEN) -> DataFrame:
    """Events of each track: the inputs up to `start`, what the model adds from there to `end` (ticks) and the inputs behind `start`.

    These and the controls are anticipated, not played again. Once a track has CAP instruments - those of its controls so far count, and rests
    as one - no other is drawn. A task calls the model for at most `at_once` tracks together; results don't depend on it.
    """
    prompt, waiting, flags = sampling.prompt_assembly(inputs, start, controls, delta)
    rows = flags.join(_listed(prompt, "prompt"), "track", "left").join(_listed(waiting, "ahead"), "track", "left").withColumn("start", F.lit(start)).withColumn("end", F.lit(end))
    made = _run(rows, model, lambda flag, p, a, s, e, rng: anticipatory(flag, p, a, s, e, top_p, delta, rng), seed, at_once)
    return sampling.output_assembly(made, inputs.where(F.col("time") > start))


def generate_autoregressive(inputs: DataFrame, controls: DataFrame, model: Model, start: int, end: int, top_p: float = 1.0, seed: int = 0, at_once: int = OPEN) -> DataFrame:
    """As generate(), with controls as events and nothing anticipated.

    Later events that came in among the new ones stand there and, as all later events, once more.
    """
    rows = S.combine(inputs, controls)
    tracks = rows.select("track").distinct()
    prompt = S.pad(S.clip(rows, 0, start, clip_duration=False, seconds=False), tracks.withColumn("end_time", F.lit(start)))
    later = rows.where(F.col("time") > start)
    packed = tracks.join(_listed(prompt, "prompt"), "track", "left").join(_listed(later, "ahead"), "track", "left")
    packed = packed.withColumns({"flag": F.lit(V.AUTOREGRESS), "start": F.lit(start), "end": F.lit(end)})
    made = _run(packed, model, lambda flag, p, a, s, e, rng: autoregressive(p, a, s, e, top_p, rng), seed, at_once)
    return sampling.output_assembly(made, later)


def generation_window(
    tracks: DataFrame, bpm: float, beats: int, start_bar: int | None = None, end_bar: int | None = None, bars: int | None = None,
    from_end: bool = False, snap: bool = False, input_bars: int | None = None, allow_silence: bool = False,
) -> DataFrame:
    """(track, start, end) in seconds, of tracks (track, last_onset, last_end, length in seconds).

    from_end: from the last note's end, with snap from the next bar. input_bars: bars are so many equal parts of the input.
    Else from start_bar. The end is `bars` bars on, or the end of end_bar. An end that isn't after its start is an error, and, unless
    silence is allowed, a start more than half a bar behind the input's end.
    """
    bar = 60.0 / bpm * beats
    at = lambda n: F.lit((n - 1) * bar)
    if from_end:
        start = (F.floor(F.col("last_end") / bar) + 1) * bar if snap else F.col("last_end")
    elif input_bars:
        start = (start_bar - 1) * F.greatest("length", "last_end") / input_bars
    else:
        start = at(start_bar)
    if input_bars and not from_end:
        end = end_bar * F.greatest("length", "last_end") / input_bars
    else:
        end = F.col("start") + bars * bar if bars is not None else at(end_bar + 1)
    late = F.col("start") > F.greatest("last_onset", "last_end") + 0.5 * bar
    rows = tracks.withColumn("start", start.cast("double")).withColumn("end", end.cast("double"))
    checked = F.when(F.col("end") <= F.col("start"), F.raise_error(F.lit("the end is not after the start")).cast("double"))
    if not allow_silence:
        checked = checked.when(late, F.raise_error(F.lit("the start is far behind the input's end")).cast("double"))
    return rows.withColumn("start", checked.otherwise(F.col("start"))).select("track", "start", "end")


def continue_from(rows: DataFrame, model: Model, start: float, end: float, **options) -> DataFrame:
    """Continuation: the rows up to `start` seconds are the prompt, what is behind goes."""
    a, b = V.ticks(start), V.ticks(end)
    prompt = S.clip(rows, 0, a, clip_duration=False, seconds=False)
    return generate(prompt, rows.limit(0), model, a, b, **options)


def accompany(rows: DataFrame, instruments: list[int], model: Model, start: float, end: float, keep: list[int] | None = None, **options) -> DataFrame:
    """The parts of `instruments` are controls for the whole length; the others play up to `start` and are generated from there.

    keep: of the result only these instruments, such as [128] for drums, before the controls are put back.
    """
    a, b = V.ticks(start), V.ticks(end)
    marked = S.to_controls(rows, F.col("instr").isin(instruments))
    others, controls = S.split(marked)
    made = generate(S.clip(others, 0, a, clip_duration=False, seconds=False), controls, model, a, b, **options)
    return S.combine(S.keep_instruments(made, keep) if keep is not None else made, controls)


def append_new(original: DataFrame, made: DataFrame, start: float) -> DataFrame:
    """The original rows with what was generated more than a tick behind `start`: for inputs that were put on a grid only for the model."""
    new = made.where(F.col("time") >= V.ticks(start + 0.01)).withColumn("src", F.lit(1))
    both = original.withColumn("src", F.lit(0)).unionByName(new)
    return both.withColumn("pos", (F.row_number().over(Window.partitionBy("track").orderBy("time", "src", "pos")) - 1).cast("long")).select(*V.NOTE_COLUMNS)
