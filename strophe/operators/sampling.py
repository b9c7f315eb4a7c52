"""Model-free parts of sampling: masks over logits, nucleus, prompts, batches; the model is a callable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import vocab as V
from strophe.operators import sequence as S


def slot_mask(logits: DataFrame) -> DataFrame:
    """logits (seq, idx, token, logit) without controls, specials and the other two slots' tokens; a rest fits every slot."""
    t, slot = F.col("token"), F.col("idx") % 3
    time, dur, note = t < V.DUR_OFFSET, (t >= V.DUR_OFFSET) & (t < V.NOTE_OFFSET), (t >= V.NOTE_OFFSET) & (t < V.NOTE_OFFSET + V.MAX_NOTE)
    fits = F.when(slot == 0, time).when(slot == 1, dur).otherwise(note)
    return logits.where((t < V.CONTROL_OFFSET) & (fits | (t == V.REST)))


def future_mask(logits: DataFrame, now: int) -> DataFrame:
    return logits.where((F.col("token") >= V.DUR_OFFSET) | (F.col("token") >= V.TIME_OFFSET + now))


def instrument_cap(logits: DataFrame, seen: DataFrame, limit: int = 15) -> DataFrame:
    """With `limit` instruments seen in a sequence (seq, instr), its notes of others go."""
    full = seen.groupBy("seq").agg(F.count_distinct("instr").alias("k")).where(F.col("k") >= limit).select("seq")
    note = (F.col("token") >= V.NOTE_OFFSET) & (F.col("token") < V.NOTE_OFFSET + V.MAX_NOTE)
    rows = logits.withColumn("instr", F.when(note, F.floor((F.col("token") - V.NOTE_OFFSET) / 128)).cast("long"))
    marked = rows.join(full.withColumn("full", F.lit(True)), "seq", "left").join(seen.select("seq", F.col("instr").cast("long").alias("instr")).distinct().withColumn("ok", F.lit(True)), ["seq", "instr"], "left")
    return marked.where(F.col("full").isNull() | F.col("instr").isNull() | F.col("ok").isNotNull()).select(*logits.columns)


def nucleus(logits: DataFrame, p: float) -> DataFrame:
    """Tokens of each (seq, idx) before which less than or exactly p of the probability lies; p >= 1 keeps all."""
    if p >= 1:
        return logits
    own = Window.partitionBy("seq", "idx")
    weight = F.exp(F.col("logit") - F.max("logit").over(own))
    before = F.coalesce(F.sum("w").over(own.orderBy(F.desc("logit"), "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return logits.withColumn("w", weight).withColumn("all", F.sum("w").over(own)).withColumn("before", before / F.col("all")).where(F.col("before") <= p).select(*logits.columns)


def history(df: DataFrame, triples: int = 339) -> DataFrame:
    """The last rows of each track, relative to their least time."""
    last = df.withColumn("r", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("pos")))).where(F.col("r") <= triples).drop("r")
    return last.withColumn("time", F.col("time") - F.min("time").over(Window.partitionBy("track")))


def contexts(df: DataFrame, triples: int = 339) -> DataFrame:
    """df with base: the least time of the last `triples` rows of the track up to each row, which a context that ends there is relative to.

    Rows are cut into blocks of that many. A context is the end of one block and the start of the next (or one whole block), so its least time is
    that of two running minima, one from each side: the work doesn't grow with `triples`.
    """
    track = Window.partitionBy("track").orderBy("pos")
    rows = df.withColumn("__i", F.row_number().over(track) - 1).withColumn("__b", F.floor(F.col("__i") / triples))
    ahead = Window.partitionBy("track", "__b").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("track", "__b").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__a", F.min("time").over(ahead)).withColumn("__z", F.min("time").over(behind))
    return rows.withColumn("base", F.least("__a", F.lag("__z", triples - 1).over(track))).drop("__i", "__b", "__a", "__z")


def prompt_assembly(inputs: DataFrame, start: int, controls: DataFrame, delta: int = V.DELTA, least: int = V.DELTA // V.RESOLUTION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prompt, waiting, flags) of tracks sorted by time.

    The inputs up to `start` are padded to it. Their later rows become controls; the given controls count from tick `least` on, and
    at equal times come first. prompt has the controls that are due among its events, waiting the others; flags (track, flag) is
    ANTICIPATE for tracks with any, else AUTOREGRESS.
    """
    upto = S.clip(inputs, 0, start, clip_duration=False, seconds=False)
    tracks = inputs.select("track").unionByName(controls.select("track")).distinct()
    prompt = S.pad(upto, tracks.withColumn("end_time", F.lit(start)))
    later = S.to_controls(inputs.where(F.col("time") > start), F.lit(True))
    ahead = controls.where(F.col("time") >= least).withColumn("src", F.lit(0)).unionByName(later.withColumn("src", F.lit(1)))
    order = F.row_number().over(Window.partitionBy("track").orderBy("time", "src", "pos"))
    ahead = ahead.withColumn("pos", order.cast("long")).drop("src")
    merged, waiting = S.anticipate(prompt.unionByName(ahead), delta)
    some = ahead.select("track", F.lit(V.ANTICIPATE).alias("a")).distinct()
    return merged, waiting, tracks.join(some, "track", "left").select("track", F.coalesce("a", F.lit(V.AUTOREGRESS)).cast("long").alias("flag"))


def output_assembly(generated: DataFrame, future: DataFrame) -> DataFrame:
    events, _ = S.split(generated)
    return S.combine(S.unpad(events), future)


def collate(rows: DataFrame, *batch: str, ignore: int = -100) -> DataFrame:
    """tokens of each batch padded to its longest with 0, labels with `ignore`."""
    longest = F.max(F.size("tokens")).over(Window.partitionBy(*batch))
    short = longest - F.size("tokens")
    return rows.select("*", F.concat("tokens", F.array_repeat(F.lit(ignore), short.cast("int"))).alias("labels"), F.concat("tokens", F.array_repeat(F.lit(0), short.cast("int"))).alias("input_ids"))
