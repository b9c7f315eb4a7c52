"""Codecs between message streams and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import vocab as V
from strophe.operators import sequence as S


def current_program(messages: DataFrame) -> DataFrame:
    """Messages (track, pos, type, channel, program, ...) with instr: the channel's last program so far, 0 at first, 128 on channel 9."""
    far = Window.partitionBy("track", "channel").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("type") == "program", F.col("program")), True).over(far)
    return messages.withColumn("instr", F.when(F.col("channel") == 9, V.DRUMS).otherwise(F.coalesce(last, F.lit(0))).cast("long"))


def pair_notes(messages: DataFrame) -> DataFrame:
    """Notes of note messages (track, pos, time, on, instr, pitch, channel): ons and offs matched first in, first out.

    An off without an open note is ignored; a note without an off has dur -1. Notes come in order of their ons.
    """
    key = ["track", "instr", "pitch", "channel"]
    far = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = messages.withColumn("s", F.sum(F.when(F.col("on"), 1).otherwise(-1)).over(far))
    s = s.withColumn("low", F.least(F.lit(0), F.coalesce(F.min("s").over(before), F.lit(0))))
    s = s.where(F.col("on") | (F.col("s") >= F.col("low"))).withColumn("k", F.row_number().over(Window.partitionBy(*key, "on").orderBy("pos")))
    until = F.lead("time").over(Window.partitionBy(*key, "k").orderBy(F.col("on").desc()))
    notes = s.withColumn("dur", F.coalesce(until - F.col("time"), F.lit(-1)).cast("long")).where("on")
    order = F.row_number().over(Window.partitionBy("track").orderBy("pos")) - 1
    return notes.select("track", order.cast("long").alias("pos"), F.lit("event").alias("kind"), F.col("time").cast("long").alias("time"), "dur", F.col("instr").cast("long").alias("instr"), F.col("pitch").cast("long").alias("pitch"))


def interarrival(messages: DataFrame) -> DataFrame:
    """(track, pos, token): a delta token where time passes, then a note-on or note-off token, for each note message."""
    own = Window.partitionBy("track").orderBy("pos")
    delta = F.least(F.col("time") - F.coalesce(F.lag("time").over(own), F.lit(0)), F.lit(V.MAX_DELTA))
    note = F.when(F.col("on"), V.MIDI_ON).otherwise(V.MIDI_OFF) + 128 * F.col("instr") + F.col("pitch")
    rows = messages.select("track", "pos", F.filter(F.array(F.when(delta > 0, delta), note), lambda t: t.isNotNull()).alias("t"))
    rows = rows.select("track", "pos", F.posexplode("t").alias("j", "token"))
    order = F.row_number().over(Window.partitionBy("track").orderBy("pos", "j")) - 1
    return rows.select("track", order.cast("long").alias("pos"), F.col("token").cast("long").alias("token"))


def note_messages(notes: DataFrame) -> DataFrame:
    """Ons and offs of notes in playing order: (track, pos, time, on, instr, pitch, channel); ons before offs at a time."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("t"), F.col("time").alias("at")), F.struct(F.lit(1).alias("t"), (F.col("time") + F.col("dur")).alias("at"))))
    rows = notes.where("kind = 'event'").select("track", F.col("pos").alias("src"), "instr", "pitch", both.alias("m")).select("track", "src", "instr", "pitch", "m.*")
    order = F.row_number().over(Window.partitionBy("track").orderBy("at", "t", "src")) - 1
    return rows.select("track", order.cast("long").alias("pos"), F.col("at").alias("time"), (F.col("t") == 0).alias("on"), "instr", "pitch", F.when(F.col("instr") == V.DRUMS, 9).otherwise(0).alias("channel"))


def with_channels(rows: DataFrame) -> DataFrame:
    """Messages (track, pos, time, on, instr, pitch) with channel and delta within their instrument's part.

    All parts are numbered in order of their first onsets, passing over 9; drums take a number too, but play on 9.
    Offs before the first onset of their instrument are passed over. A file has 16 channels: a part that would need a seventeenth is an error.
    """
    own = Window.partitionBy("track", "instr").orderBy("pos")
    first = F.min(F.when(F.col("on"), F.col("pos"))).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    delta = F.col("time") - F.when(F.col("pos") > F.col("first"), F.lag("time").over(own)).otherwise(0)
    known = rows.withColumn("first", first).withColumn("delta", delta).where(F.col("on") | (F.col("pos") > F.col("first")))
    r = F.dense_rank().over(Window.partitionBy("track").orderBy("first", "instr")) - 1
    pitched = F.when(r >= 9, r + 1).otherwise(r)
    many = F.raise_error(F.concat(F.lit("more than 16 channels in track "), F.col("track").cast("string"))).cast("int")
    channel = F.when(F.col("instr") == V.DRUMS, 9).when(pitched > 15, many).otherwise(pitched)
    return known.select("track", "pos", "time", "on", "instr", "pitch", channel.cast("long").alias("channel"), F.col("delta").cast("long").alias("delta"))


def midi_schedule(notes: DataFrame) -> DataFrame:
    """Messages of notes with channel and delta within their instrument's part."""
    return with_channels(note_messages(notes).drop("channel"))


def trim_interarrival(tokens: DataFrame) -> DataFrame:
    """Tokens (track, pos, token) up to the last note-on."""
    on = (F.col("token") >= V.MIDI_ON) & (F.col("token") < V.MIDI_OFF)
    last = F.max(F.when(on, F.col("pos"))).over(Window.partitionBy("track"))
    return tokens.withColumn("last", last).where("pos <= last").drop("last")


def delta_truncations(messages: DataFrame) -> DataFrame:
    """(track, truncated): deltas of note messages (track, pos, time) that inter-arrival tokens cut."""
    delta = F.col("time") - F.coalesce(F.lag("time").over(Window.partitionBy("track").orderBy("pos")), F.lit(0))
    return messages.withColumn("delta", delta).groupBy("track").agg(F.count_if(F.col("delta") > V.MAX_DELTA).alias("truncated"))


def _by_file(messages: DataFrame, parts: int | None) -> DataFrame:
    """Notes and programs of decoded message rows, dealt by file: all windows that follow do with this one exchange. track is the path."""
    rows = messages.withColumnRenamed("path", "track").where("type in ('note', 'program')")
    return rows.repartition("track") if parts is None else rows.repartition(parts, "track")


def midi_notes(messages: DataFrame, parts: int | None = None) -> DataFrame:
    """Notes of decoded message rows (path, pos, time, type, ...): programs followed, ons and offs paired; track is the path.

    parts: over how many tasks the files are dealt; the session's number if it is not given.
    """
    return pair_notes(current_program(_by_file(messages, parts)).where("type = 'note'"))


def midi_interarrival(messages: DataFrame, parts: int | None = None) -> DataFrame:
    """Inter-arrival tokens of decoded message rows; each delta is rounded by itself from the seconds between note messages."""
    rows = current_program(_by_file(messages, parts)).where("type = 'note'")
    own = Window.partitionBy("track").orderBy("pos")
    delta = F.rint((F.col("seconds") - F.coalesce(F.lag("seconds").over(own), F.lit(0.0))) * V.RESOLUTION).cast("long")
    step = rows.withColumn("delta", delta)
    return interarrival(step.withColumn("time", F.sum("delta").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))))


def interarrival_schedule(tokens: DataFrame) -> DataFrame:
    """Messages (track, pos, time, on, instr, pitch) of inter-arrival tokens (track, pos, token): deltas add up; separators and
    offs of instruments that haven't played are passed over."""
    own = Window.partitionBy("track").orderBy("pos")
    t, is_on = F.col("token"), (F.col("token") >= V.MIDI_ON) & (F.col("token") < V.MIDI_OFF)
    rows = tokens.withColumn("time", F.sum(F.when(t < V.MIDI_ON, t).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    plain = F.when(is_on, t - V.MIDI_ON).otherwise(t - V.MIDI_OFF)
    rows = rows.where((t >= V.MIDI_ON) & (t != V.MIDI_SEPARATOR)).select("track", "pos", "time", is_on.alias("on"), F.floor(plain / 128).cast("long").alias("instr"), F.pmod(plain, F.lit(128)).cast("long").alias("pitch"))
    first = F.min(F.when(F.col("on"), F.col("pos"))).over(Window.partitionBy("track", "instr"))
    rows = rows.withColumn("first", first).where(F.col("on") | (F.col("pos") > F.col("first")))
    return rows.select("track", (F.row_number().over(own) - 1).cast("long").alias("pos"), F.col("time").cast("long").alias("time"), "on", "instr", "pitch")


def files_to_events(messages: DataFrame, parts: int | None = None) -> DataFrame:
    """(track, pos, tokens) of decoded message rows: notes with their durations clamped, as event triples; track is the path."""
    return S.encode_events(midi_notes(messages, parts))


def events_to_schedule(tokens: DataFrame) -> DataFrame:
    """Messages with channels of event triples (track, pos, tokens), as files are written from; controls play as events."""
    return midi_schedule(S.sort(S.stack_segments(S.to_events(S.unpad(S.decode_events(tokens))))))
