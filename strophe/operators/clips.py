"""Clips for listening tests: windows of tracks, candidates and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import vocab as V
from strophe.operators import sequence as S
from strophe.plans.scratch import stored


def random_windows(notes: DataFrame, length: int, seed: str = "0", draw: str = "clip") -> DataFrame:
    """(track, start, rows of the window moved to 0) of one window of `length` ticks in each track that is as long; draws of other names differ."""
    ends = S.max_time(notes).where(F.col("max_time") >= length)
    start = F.floor((F.col("max_time") - length) * V.uniform(seed, draw, F.col("track"))).cast("long")
    rows = notes.join(ends.select("track", start.alias("start")), "track").where(F.col("time").between(F.col("start"), F.col("start") + length))
    return rows.withColumn("dur", F.least("dur", F.col("start") + length - F.col("time"))).withColumn("time", F.col("time") - F.col("start"))


def clip_candidates(windows: DataFrame, prompt: int, max_instruments: int = 15, min_events: int = 10) -> DataFrame:
    """(track, start, parts, n) of windows with few enough instruments and enough events in the prompt."""
    a = windows.where("kind = 'event'").groupBy("track", "start").agg(F.count_distinct("instr").alias("parts"), F.count_if(F.col("time") <= prompt).alias("n"))
    return a.where((F.col("parts") <= max_instruments) & (F.col("n") >= min_events))


def windows_at(notes: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The rows of windows (track, ..., start) of `length` ticks, moved to 0, beside what places says of them."""
    rows = notes.join(places, "track").where(F.col("time").between(F.col("start"), F.col("start") + length))
    return rows.withColumn("dur", F.least("dur", F.col("start") + length - F.col("time"))).withColumn("time", F.col("time") - F.col("start"))


def sample_until(notes: DataFrame, n: int, length: int, prompt: int, seed: str = "0", tries: int = 16, max_instruments: int = 15, min_events: int = 10) -> DataFrame:
    """(track, attempt, draw, start, parts, n): the first n windows in order of draw that clip_candidates() would accept, or all that there are.

    Each track as long as `length` is tried `tries` times, at places of their own; so a track may come more than once. Attempts stand in the order
    of a hash, draw. Rounds go through it: each takes as many attempts as the share accepted so far says that the rest needs, and half as many more. A round
    joins its attempts with the notes and counts, both by track.
    """
    notes = stored(notes.where("kind = 'event'"))
    ends = stored(S.max_time(notes).where(F.col("max_time") >= length))
    total = ends.count() * tries
    draw = V.uniform(seed, "attempt", F.col("track"), F.col("attempt"))
    start = F.floor((F.col("max_time") - length) * V.uniform(seed, "start", F.col("track"), F.col("attempt"))).cast("long")
    all_ = ends.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("attempt", F.col("attempt").cast("long")).withColumn("draw", draw)
    found, rounds, low, high = 0, [], 0.0, min(1.0, 2 * n / total) if total else 1.0
    while total and n:
        part = all_.where((F.col("draw") >= low) & (F.col("draw") < high)).select("track", "attempt", "draw", start.alias("start"))
        rows = windows_at(notes, part, length)
        counted = rows.groupBy("track", "attempt", "draw", "start").agg(F.count_distinct("instr").alias("parts"), F.count_if(F.col("time") <= prompt).alias("n"))
        rounds.append(stored(counted.where((F.col("parts") <= max_instruments) & (F.col("n") >= min_events))))
        found += rounds[-1].count()
        if found >= n or high >= 1:
            break
        low, high = high, min(1.0, high + 1.5 * (n - found) * high / max(found, 1))
    out = ends.select("track", F.lit(0).cast("long").alias("attempt"), F.lit(0.0).alias("draw"), *[F.lit(0).cast("long").alias(c) for c in ("start", "parts", "n")]).limit(0)
    for r in rounds:
        out = out.unionByName(r)
    return out.orderBy("draw", "track", "attempt").limit(n)


def melody_candidates(windows: DataFrame, melody: DataFrame, prompt: int, length: int, parts: tuple[int, int] = (4, 10), min_notes: int = 20) -> DataFrame:
    """(track, melody) of windows with 4 to 10 parts besides drums whose melody has enough notes, starts in the prompt and lasts."""
    m = windows.join(melody.select("track", F.col("instr").alias("melody")), "track")
    a = m.where("kind = 'event'").groupBy("track", "melody").agg(
        F.count_distinct(F.when(F.col("instr") != V.DRUMS, F.col("instr"))).alias("k"),
        F.count_if(F.col("instr") == F.col("melody")).alias("n"),
        F.min(F.when(F.col("instr") == F.col("melody"), F.col("time"))).alias("a"),
        F.max(F.when(F.col("instr") == F.col("melody"), F.col("time"))).alias("b"),
    )
    return a.where(F.col("k").between(*parts) & (F.col("n") >= min_notes) & (F.col("a") <= prompt) & (F.col("b") >= length - 2 * V.RESOLUTION)).select("track", "melody")


def accompaniment(windows: DataFrame, melody: DataFrame, prompt: int) -> DataFrame:
    """Melody of the whole window with the other parts of the prompt alone: the condition of an accompaniment task."""
    m = windows.join(melody.select("track", F.col("instr").alias("melody")), "track")
    return m.where((F.col("instr") == F.col("melody")) | (F.col("time") <= prompt)).drop("melody")


def paired_clips(continuation: DataFrame, prompt: DataFrame, ground: DataFrame, length: int, prompt_range: tuple[int, int] = (400, 600)) -> DataFrame:
    """The continuation's first `length` ticks, of tracks whose continuation and ground truth are as long and whose prompt ends in range."""
    long = lambda df: S.max_time(df).where(F.col("max_time") >= length).select("track")
    near = S.max_time(prompt).where(F.col("max_time").between(*prompt_range)).select("track")
    kept = long(continuation).join(near, "track", "left_semi").join(long(ground), "track", "left_semi")
    return S.clip(continuation.join(kept, "track", "left_semi"), 0, length, seconds=False)


def retrieved(windows: DataFrame, others: DataFrame, melody: DataFrame, prompt: int, length: int) -> DataFrame:
    """A retrieval baseline for the accompaniment task: another window of the same track plays in the model's place.

    The window's melody goes on; its other parts play up to the prompt's end, and from there on those of the other window.
    """
    lead = melody.select("track", F.col("instr").alias("melody"))
    own = windows.join(lead, "track")
    rest = others.join(lead, "track").where((F.col("instr") != F.col("melody")) & F.col("time").between(prompt, length))
    rest = rest.withColumn("dur", F.least("dur", length - F.col("time")))
    parts = own.where((F.col("instr") != F.col("melody")) & (F.col("time") <= prompt)).withColumn("src", F.lit(0))
    parts = parts.select("src", *V.NOTE_COLUMNS).unionByName(rest.join(own.select("track").distinct(), "track", "left_semi").withColumn("src", F.lit(1)).select("src", *V.NOTE_COLUMNS))
    order = F.row_number().over(Window.partitionBy("track").orderBy("src", "pos"))
    events = parts.withColumn("pos", order.cast("long")).select(*V.NOTE_COLUMNS)
    return S.combine(events, own.where("instr = melody").select(*V.NOTE_COLUMNS))


def take_accepted(candidates: DataFrame, key: str, count: int, seed: str = "0") -> DataFrame:
    """(idx, ...) the first `count` of the accepted candidates in a seeded order, numbered from 0."""
    order = V.uniform(seed, "take", F.col(key))
    first = candidates.withColumn("u", order).orderBy("u", key).limit(count)
    return first.withColumn("idx", (F.row_number().over(Window.orderBy("u", key)) - 1).cast("long")).drop("u")


def trim(notes: DataFrame, start: float, length: float) -> DataFrame:
    """The rows from start on for `length` seconds, durations cut, moved so that each track's first is at 0."""
    cut = S.clip(notes, start, start + length)
    return cut.withColumn("time", F.col("time") - F.min("time").over(Window.partitionBy("track")))


def preview(events: DataFrame, melody: DataFrame, start: float, end: float) -> DataFrame:
    """A proposal with its melody from start to end, moved to 0."""
    return trim(S.combine(events, melody), start, end - start)


def revert(proposal: DataFrame, to: float) -> DataFrame:
    """The proposal up to a point in seconds, notes uncut."""
    return S.clip(proposal, 0, to, clip_duration=False)


def piano_roll(notes: DataFrame) -> DataFrame:
    """(track, tick, pitch, part) of every cell that a note other than drums covers before the track's last onset; the later note wins.

    part is the instrument's place among the track's, from 1.
    """
    rows = notes.where(f"kind = 'event' and instr <> {V.DRUMS}")
    rank = F.dense_rank().over(Window.partitionBy("track").orderBy("instr"))
    ends = S.max_time(notes)
    cells = rows.withColumn("part", rank).join(ends, "track").withColumn("until", F.least(F.col("time") + F.col("dur"), F.col("max_time")) - 1).where("until >= time")
    cells = cells.select("track", "pos", "pitch", "part", F.explode(F.sequence("time", "until")).alias("tick"))
    return cells.groupBy("track", "tick", "pitch").agg(F.max_by("part", "pos").cast("long").alias("part"))
