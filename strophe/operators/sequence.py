"""Operators on ordered event sequences.

Every operator takes and returns rows (track, pos, kind, time, dur, instr, pitch): kind is event, control,
rest or sep, times are ticks, and pos orders a track. All work within a track's window, so operators in a
row share one exchange and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strophe.functions import vocab as V


def _track() -> WindowSpec:
    return Window.partitionBy("track").orderBy("pos")


def _renumber(df: DataFrame, *order: str | Column) -> DataFrame:
    row = F.row_number().over(Window.partitionBy("track").orderBy(*order)) - 1
    return df.withColumn("__pos", row.cast("long")).drop("pos").withColumnRenamed("__pos", "pos").select(*V.NOTE_COLUMNS)


def segment() -> Column:
    """Separators seen so far in the track."""
    return F.coalesce(F.sum(F.when(F.col("kind") == "sep", 1).otherwise(0)).over(_track().rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))


def clip(df: DataFrame, start: float, end: float, clip_duration: bool = True, seconds: bool = True) -> DataFrame:
    """Rows with start <= time <= end; durations past the end are cut there if clip_duration."""
    a, b = (V.ticks(start), V.ticks(end)) if seconds else (start, end)
    kept = df.where(F.col("time").between(a, b))
    return kept.withColumn("dur", F.when(F.lit(clip_duration) & (F.col("time") + F.col("dur") > b), b - F.col("time")).otherwise(F.col("dur")).cast("long"))


def mask(df: DataFrame, start: float, end: float) -> DataFrame:
    """Without the rows strictly between start and end, in seconds."""
    at = F.col("time") / float(V.RESOLUTION)
    return df.where(~((at > start) & (at < end)))


def delete(df: DataFrame, criterion: Column) -> DataFrame:
    return df.where(~criterion)


def keep_instruments(df: DataFrame, instruments: list[int]) -> DataFrame:
    """Events of these instruments; controls go."""
    return df.where((F.col("kind") == "event") & F.col("instr").isin(instruments))


def unpad(df: DataFrame) -> DataFrame:
    return df.where("kind <> 'rest'")


def sort(df: DataFrame) -> DataFrame:
    """By time, otherwise as before."""
    return _renumber(df, "time", "pos")


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events and rests, controls and separators)."""
    return df.where("kind in ('event', 'rest')"), df.where("kind in ('control', 'sep')")


def to_controls(df: DataFrame, which: Column) -> DataFrame:
    return df.withColumn("kind", F.when(which & (F.col("kind") == "event"), "control").otherwise(F.col("kind")))


def to_events(df: DataFrame) -> DataFrame:
    return df.withColumn("kind", F.when(F.col("kind") == "control", "event").otherwise(F.col("kind")))


def pad(df: DataFrame, end_time: int | DataFrame | None = None, density: int = V.RESOLUTION) -> DataFrame:
    """Rests every `density` ticks in gaps longer than that, and up to end_time (the track's last time if none).

    end_time may differ by track: rows (track, end_time), one for each track, also for those without events.
    """
    prev = F.coalesce(F.lag("time").over(_track()), F.lit(0))
    gaps = lambda t, p: F.greatest(F.lit(0), F.floor((t - p - 1) / density)).cast("int")
    rests = df.select("track", "pos", "time", prev.alias("prev")).select("track", "pos", F.col("prev"), gaps(F.col("time"), F.col("prev")).alias("n"))
    if isinstance(end_time, DataFrame):
        tail = end_time.join(df.groupBy("track").agg((F.max("pos") + 1).alias("pos"), F.max_by("time", "pos").alias("prev")), "track", "left").withColumn("prev", F.coalesce("prev", F.lit(0)))
        rests = rests.unionByName(tail.select("track", F.coalesce("pos", F.lit(0)).alias("pos"), "prev", gaps(F.col("end_time"), F.col("prev")).alias("n")))
    elif end_time:
        tail = df.groupBy("track").agg(F.max("pos").alias("pos"), F.max_by("time", "pos").alias("prev"))
        rests = rests.unionByName(tail.select("track", (F.col("pos") + 1).alias("pos"), "prev", gaps(F.lit(end_time), F.col("prev")).alias("n")))
    rests = rests.where("n > 0").select("track", "pos", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("j"), "prev")
    null = F.lit(None).cast("long")
    rests = rests.select("track", "pos", "j", F.lit("rest").alias("kind"), (F.col("prev") + F.col("j") * density).cast("long").alias("time"), F.lit(0).cast("long").alias("dur"), null.alias("instr"), null.alias("pitch"))
    real = df.select("track", "pos", F.lit(1 << 30).alias("j"), "kind", "time", "dur", "instr", "pitch")
    return _renumber(real.unionByName(rests), "pos", "j")


def anticipate(df: DataFrame, delta: int = V.DELTA) -> tuple[DataFrame, DataFrame]:
    """(merged, controls left over) of tracks sorted by time.

    A control comes out before the first event whose predecessor is at or past its time less delta;
    controls that no event releases are left over. Tracks without controls pass unchanged.
    """
    own = Window.partitionBy("track", F.col("kind") == "control").orderBy("pos")
    control = F.col("kind") == "control"
    key = F.when(control, F.col("time") - delta).otherwise(F.coalesce(F.lag("time").over(own), F.lit(0)))
    keyed = df.withColumn("key", key).withColumn("last", F.when(control, 0).otherwise(1))
    keyed = keyed.withColumn("order", F.row_number().over(Window.partitionBy("track").orderBy("key", "last", "pos")))
    keyed = keyed.withColumn("end", F.max(F.when(~control, F.col("order"))).over(Window.partitionBy("track")))
    left = control & (F.col("order") > F.coalesce("end", F.lit(0)))
    return _renumber(keyed.where(~left), "order"), keyed.where(left).select(*V.NOTE_COLUMNS)


def translate(df: DataFrame, dt: int) -> DataFrame:
    """Times before the first separator moved by dt; a negative time is an error."""
    moved = F.col("time") + dt
    moved = F.when(moved < 0, F.raise_error(F.lit("negative time")).cast("long")).otherwise(moved)
    return df.withColumn("time", F.when((segment() == 0) & (F.col("kind") != "sep"), moved).otherwise(F.col("time")))


def combine(events: DataFrame, controls: DataFrame) -> DataFrame:
    """Events with the controls as events among them, by time; at equal times events first."""
    both = events.withColumn("src", F.lit(0)).unionByName(to_events(controls).withColumn("src", F.lit(1)))
    return _renumber(both, "time", "src", "pos")


def min_time(df: DataFrame) -> DataFrame:
    """(track, min_time): least time before the first separator, 0 without one."""
    return df.withColumn("seg", segment()).groupBy("track").agg(F.coalesce(F.min(F.when((F.col("seg") == 0) & (F.col("kind") != "sep"), F.col("time"))), F.lit(0)).cast("long").alias("min_time"))


def max_time(df: DataFrame) -> DataFrame:
    return df.groupBy("track").agg(F.greatest(F.coalesce(F.max(F.when(F.col("kind") != "sep", F.col("time"))), F.lit(0)), F.lit(0)).cast("long").alias("max_time"))


def sparsity(df: DataFrame) -> DataFrame:
    """(track, sparsity): the longest gap between times in a row, from 0; separators are passed over."""
    gap = F.col("time") - F.coalesce(F.lag("time").over(_track()), F.lit(0))
    return df.where("kind <> 'sep'").withColumn("gap", gap).groupBy("track").agg(F.greatest(F.max("gap"), F.lit(0)).cast("long").alias("sparsity"))


def instruments(df: DataFrame, count_rest: bool = True) -> DataFrame:
    """(track, instr, n, first): notes of each instrument, controls among them, and the pos it first has; rests count as 129 unless told not to."""
    rows = df.where("kind in ('event', 'control', 'rest')" if count_rest else "kind in ('event', 'control')")
    return rows.groupBy("track", F.when(F.col("kind") == "rest", V.MAX_INSTR).otherwise(F.col("instr")).cast("long").alias("instr")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def note_end(df: DataFrame) -> DataFrame:
    """(track, first_onset, last_end) in seconds."""
    return df.where("kind = 'event'").groupBy("track").agg((F.min("time") / 100.0).alias("first_onset"), (F.max(F.col("time") + F.col("dur")) / 100.0).alias("last_end"))


def stack_segments(df: DataFrame) -> DataFrame:
    """Segments one after the other: each is moved behind the ends of all before it; separators go."""
    rows = df.withColumn("seg", segment()).where("kind <> 'sep'")
    ends = rows.groupBy("track", "seg").agg(F.max(F.col("time") + F.col("dur")).alias("end"))
    before = Window.partitionBy("track").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    shift = ends.select("track", "seg", F.coalesce(F.sum("end").over(before), F.lit(0)).alias("shift"))
    return rows.join(shift, ["track", "seg"]).withColumn("time", F.col("time") + F.col("shift")).select(*V.NOTE_COLUMNS)


def rescale(df: DataFrame, scale: float) -> DataFrame:
    """Times and durations times scale, half to even."""
    if abs(scale - 1) < 1e-9:
        return df
    new = lambda c: F.when(F.col("kind") == "sep", F.col(c)).otherwise(F.rint(F.col(c) * scale).cast("long"))
    return df.withColumns({"time": new("time"), "dur": F.greatest(new("dur"), F.lit(0).cast("long"))})


def quantize(df: DataFrame, bpm: float, fraction: int) -> DataFrame:
    """Times and durations on the grid of 1/fraction notes; durations of one step at least; then sorted."""
    grid = max(1, round(60 / bpm * 4 / fraction * V.RESOLUTION))
    near = lambda c: (F.rint(F.col(c) / grid) * grid).cast("long")
    return sort(df.withColumns({"time": near("time"), "dur": F.greatest(near("dur"), F.lit(grid).cast("long"))}))


def encode_events(df: DataFrame) -> DataFrame:
    """(track, pos, tokens) with durations clamped. Notes outside the vocabulary - a negative time, a pitch of 128 or more, an instrument of 129 or more - are errors."""
    out = (F.col("pitch") < 0) | (F.col("pitch") >= V.MAX_PITCH) | (F.col("instr") < 0) | (F.col("instr") >= V.MAX_INSTR) | (F.col("time") < 0)
    says = F.concat(F.lit("no such note in track "), F.col("track").cast("string"), F.lit(": time, instrument, pitch "), F.concat_ws(", ", *[F.col(c).cast("string") for c in ("time", "instr", "pitch")]))
    time = F.when(out & F.col("kind").isin("event", "control"), F.raise_error(says).cast("long")).otherwise(F.col("time"))
    return df.select("track", "pos", V.encode(F.col("kind"), time, V.clamp_dur(F.col("dur")), F.col("instr"), F.col("pitch")).alias("tokens"))


def decode_events(df: DataFrame) -> DataFrame:
    return df.select("track", "pos", V.decode(F.col("tokens")).alias("e")).select("track", "pos", "e.*").select(*V.NOTE_COLUMNS)


def truncations(df: DataFrame) -> DataFrame:
    return df.where("kind = 'event'").groupBy("track").agg(F.count_if(F.col("dur") >= V.MAX_DUR).alias("truncated"))


def integrity(df: DataFrame, delta: int = V.DELTA) -> DataFrame:
    """(track, kind of violation, n): times that go back within a segment, controls that come late, too many instruments."""
    rows = df.withColumn("seg", segment()).where("kind <> 'sep'")
    lane = Window.partitionBy("track", "seg", F.col("kind") == "control").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    back = rows.withColumn("high", F.max("time").over(lane)).where("time < high").groupBy("track", F.when(F.col("kind") == "control", "control_order").otherwise("event_order").alias("violation")).agg(F.count("*").alias("n"))
    following = Window.partitionBy("track", "seg").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    late = rows.withColumn("next", F.first(F.when(F.col("kind") != "control", F.col("time")), True).over(following)).where(f"kind = 'control' and time > next + {delta}")
    late = late.groupBy("track").agg(F.count("*").alias("n")).select("track", F.lit("late_control").alias("violation"), "n")
    many = rows.where("kind <> 'rest'").groupBy("track").agg(F.count_distinct("instr").alias("n")).where(f"n > {V.MAX_TRACK_INSTR}").select("track", F.lit("instruments").alias("violation"), "n")
    return back.unionByName(late).unionByName(many)
