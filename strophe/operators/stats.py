"""Corpus statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import vocab as V

EVENTS_PER_HOUR = 663555310 / 8943  # fixed values of the public corpus the hours refer to


def gate_report(status: DataFrame) -> DataFrame:
    """(status, n, share) of gate(); share in percent of all tracks."""
    a = status.groupBy("status").agg(F.count("*").alias("n"), F.sum("n").alias("events"))
    return a.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def upper_quantile(values: Column, num: int, den: int) -> Column:
    """The order statistic at n * num // den, from 0; no interpolation."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) * num / den).cast("int"))


def group_quantiles(counts: DataFrame, group: str, value: str, shares: tuple[int, ...] = ()) -> DataFrame:
    """Per group: count, mean, least, quartiles and median as order statistics, most, and the shares in percent of values from each of `shares` on.

    Values are counted first, so a group's list has one entry for each distinct value only.
    """
    by = counts.groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum("c").over(Window.partitionBy(group))
    cum = by.withColumn("cum", F.sum("c").over(w)).withColumn("n", n)
    at = lambda num, den: F.min(F.when(F.col("cum") > F.floor(F.col("n") * num / den), F.col(value)))
    return cum.groupBy(group).agg(
        F.max("n").alias("n"), F.round(F.sum(F.col(value) * F.col("c")) / F.max("n"), 6).alias("mean"), F.min(value).alias("low"),
        at(1, 4).alias("p25"), at(1, 2).alias("median"), at(3, 4).alias("p75"), F.max(value).alias("high"),
        *[F.round(100.0 * F.sum(F.when(F.col(value) >= k, F.col("c")).otherwise(0)) / F.max("n"), 6).alias(f"share_{k}") for k in shares],
    )


def histogram(df: DataFrame, value: str, edges: list[int]) -> DataFrame:
    """(bin, n, share) over half-open bins [edges[i], edges[i + 1]); the last is open."""
    place = F.lit(None).cast("long")
    for i, e in enumerate(edges):
        place = F.when(F.col(value) >= e, F.lit(i).cast("long")).otherwise(place)
    a = df.select(place.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    return a.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def share_of(df: DataFrame, group: str, value: str, big: tuple[str, ...]) -> DataFrame:
    total, part = F.sum(value), F.sum(F.when(F.col(group).isin(*big), F.col(value)).otherwise(0))
    return df.agg(F.round(100.0 * part / total, 6).alias("big_share"), F.round(100.0 - 100.0 * part / total, 6).alias("other_share"))


def compare_shares(subset: DataFrame, full: DataFrame, group: str, value: str) -> DataFrame:
    """(group, subset_share, full_share, delta) in percent; groups of either."""
    share = lambda d, c: d.groupBy(group).agg(F.sum(value).alias("v")).select(group, (100.0 * F.col("v") / F.sum("v").over(Window.partitionBy())).alias(c))
    a = share(subset, "s").join(share(full, "f"), group, "full_outer").fillna(0.0, ["s", "f"])
    return a.select(group, F.round("s", 6).alias("subset_share"), F.round("f", 6).alias("full_share"), F.round(F.col("s") - F.col("f"), 6).alias("delta"))


def compound_stats(notes: DataFrame, status: DataFrame) -> DataFrame:
    """(status, tracks, tokens, seconds_last, seconds_max): sizes and lengths by gate status; seconds_last takes the last note's end."""
    a = notes.where("kind = 'event'").groupBy("track").agg((3 * F.count("*")).alias("tokens"), F.max_by(F.col("time") + F.col("dur"), F.col("pos")).alias("last"), F.max(F.col("time") + F.col("dur")).alias("most"))
    return a.join(status.select("track", "status"), "track").groupBy("status").agg(F.count("*").alias("tracks"), F.sum("tokens").alias("tokens"), F.round(F.sum("last") / 100.0, 2).alias("seconds_last"), F.round(F.sum("most") / 100.0, 2).alias("seconds_max"))


def compound_summary(notes: DataFrame, status: DataFrame) -> DataFrame:
    """One row: tracks and tokens, those of status 0 and their shares in percent, hours of status 0, and mean and population deviation of its
    seconds (to the last note's end) and tokens."""
    a = notes.where("kind = 'event'").groupBy("track").agg((3 * F.count("*")).alias("tokens"), (F.max_by(F.col("time") + F.col("dur"), F.col("pos")) / 100.0).alias("seconds"))
    good = lambda c: F.when(F.col("status") == 0, F.col(c))
    return a.join(status.select("track", "status"), "track").agg(
        F.count("*").alias("tracks"), F.sum("tokens").alias("tokens"), F.count_if(F.col("status") == 0).alias("kept"), F.sum(good("tokens")).alias("kept_tokens"),
        F.round(F.try_divide(100.0 * F.count_if(F.col("status") == 0), F.count("*")), 6).alias("kept_share"), F.round(F.try_divide(100.0 * F.sum(good("tokens")), F.sum("tokens")), 6).alias("kept_token_share"),
        F.round(F.sum(good("seconds")) / 3600, 6).alias("hours"), F.round(F.avg(good("seconds")), 6).alias("mean_seconds"), F.round(F.stddev_pop(good("seconds")), 6).alias("std_seconds"),
        F.round(F.avg(good("tokens")), 6).alias("mean_tokens"), F.round(F.stddev_pop(good("tokens")), 6).alias("std_tokens"),
    )


def discard_rate(files: DataFrame, bad: Column) -> DataFrame:
    """(processed, discarded, rate) with rate in percent of all files, null of none."""
    return files.agg(F.count_if(~bad).alias("processed"), F.count_if(bad).alias("discarded"), F.round(F.try_divide(100.0 * F.count_if(bad), F.count("*")), 2).alias("rate"))


#: Size of the public corpus that others are compared with.
CORPUS = {"files": 178165, "events": 663555310, "tokens": 1990665930, "hours": 8943}


def compare_corpus(totals: DataFrame) -> DataFrame:
    """(metric, reference, value, ratio) of one row of totals (files, events, tokens, hours); rates have no ratio."""
    rate = lambda a, b: (a + "_per_" + b, CORPUS[a] / CORPUS[b], F.try_divide(F.col(a), F.col(b)), F.lit(None).cast("double"))
    sizes = [(k, float(v), F.col(k).cast("double"), F.col(k) / float(v)) for k, v in CORPUS.items()]
    rows = [*sizes, rate("events", "hours"), rate("tokens", "hours"), rate("events", "files")]
    return totals.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.lit(r), 6).alias("reference"), F.round(v, 6).alias("value"), F.round(q, 6).alias("ratio")) for m, r, v, q in rows])))


def token_stats(lines: DataFrame) -> DataFrame:
    """(lines, tokens, events, hours) of token rows (tokens array): separators don't count, three tokens an event, rows under two tokens are passed over."""
    kept = lines.where(F.size("tokens") >= 2).select(F.size(F.filter("tokens", lambda t: t != V.SEPARATOR)).alias("n"))
    a = kept.agg(F.count("*").alias("lines"), F.sum("n").alias("tokens"), F.sum(F.floor(F.col("n") / 3)).alias("events"))
    return a.withColumn("hours", F.round(F.col("events") / EVENTS_PER_HOUR, 9))


def loss_metrics(losses: DataFrame, hours: float, subsample: int = 1) -> DataFrame:
    """Mean loss, bits a second and perplexities of losses (seq, i, ce): i modulo 3 is onset, duration, note."""
    part = lambda k: F.exp(F.avg(F.when(F.col("i") % 3 == k, F.col("ce"))))
    mean = F.avg("ce")
    bits = subsample * mean * math.log2(math.e) * F.count("*") / (3600 * hours)
    names = ("onset_ppl", "dur_ppl", "note_ppl")
    return losses.agg(F.round(mean, 6).alias("loss"), F.round(bits, 6).alias("bps"), F.round(F.exp(3 * mean), 3).alias("event_ppl"), *[F.round(part(k), 3).alias(n) for k, n in enumerate(names)])


def extrapolate(sample: DataFrame, value: str, population: int) -> DataFrame:
    return sample.agg(F.count("*").alias("n"), F.round(F.sum(value) * population / F.count("*"), 6).alias("total"))


def timings(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))


def melody_instrument(notes: DataFrame) -> DataFrame:
    """(track, instr): the instrument of highest mean pitch, the first seen on ties; 0, 9 and 112 to 128 don't count."""
    able = notes.where("kind = 'event' and instr not in (0, 9) and instr < 112")
    a = able.groupBy("track", "instr").agg(F.sum("pitch").alias("s"), F.count("*").alias("c"), F.min("pos").alias("first"))
    top = F.row_number().over(Window.partitionBy("track").orderBy(F.desc(F.col("s") / F.col("c")), "first"))
    return a.withColumn("r", top).where("r = 1 and s > 0").select("track", "instr")


def top_groups(df: DataFrame, group: str, value: str, k: int = 3) -> DataFrame:
    """(strategy, group, value, place) of the k largest groups of each strategy, and of the k smallest with places from -1 down."""
    place = lambda order: F.row_number().over(Window.partitionBy("strategy").orderBy(order, group)).cast("long")
    ranked = df.withColumn("high", place(F.desc(value))).withColumn("low", place(F.asc(value))).where(F.least("high", "low") <= k)
    places = F.filter(F.array("high", -F.col("low")), lambda x: F.abs(x) <= k)
    return ranked.select("strategy", group, value, F.explode(places).alias("place"))


def part_names(parts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(track, instr, name) of the parts (track, instr, first) of tracks: the given name (track, instr, name) or else the program's;
    names a track has already are numbered from 2 in order of first use."""
    own = V.gm_name(F.col("instr"))
    base = parts.withColumn("base", own) if names is None else parts.join(names.withColumnRenamed("name", "given"), ["track", "instr"], "left").withColumn("base", F.coalesce(F.when(F.col("given") != "", F.col("given")), own))
    n = F.row_number().over(Window.partitionBy("track", "base").orderBy("first", "instr"))
    return base.withColumn("n", n).select("track", "instr", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws(" ", "base", F.col("n").cast("string"))).alias("name"))


def sequence_stats(lines: DataFrame) -> DataFrame:
    """(sequences, tokens, hours, rate, mean_rate, std_rate) of token rows (tokens: flag, then triples) cut at separators.

    rate is all tokens by all seconds; mean and population deviation are over sequences, those of no length left out.
    Each row is folded in place, so nothing is exchanged but the sums.
    """
    triples = F.transform(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / 3).cast("int") - 1), lambda i: F.get("tokens", i * 3 + 1))
    time = lambda t: F.when(t >= V.CONTROL_OFFSET, t - V.CONTROL_OFFSET).otherwise(t).cast("long")
    done = lambda s: F.when(s["n"] > 0, F.concat(s["out"], F.array(F.struct(s["n"].alias("n"), s["t"].alias("t"))))).otherwise(s["out"])
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("n"), zero.alias("t"), F.array().cast("array<struct<n:bigint,t:bigint>>").alias("out"))

    def step(s, t):
        sep = t == V.SEPARATOR
        return F.struct(F.when(sep, zero).otherwise(s["n"] + 3).alias("n"), F.when(sep, zero).otherwise(F.greatest(s["t"], time(t))).alias("t"), F.when(sep, done(s)).otherwise(s["out"]).alias("out"))

    rows = lines.where(F.size("tokens") > 3).select(F.inline(F.aggregate(triples, start, step, done)))
    rate = F.when(F.col("t") > 0, 100.0 * F.col("n") / F.col("t"))
    return rows.agg(
        F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.round(F.sum("t") / 360000.0, 6).alias("hours"),
        F.round(100.0 * F.sum("n") / F.sum("t"), 6).alias("rate"), F.round(F.avg(rate), 6).alias("mean_rate"), F.round(F.stddev_pop(rate), 6).alias("std_rate"),
    )


def filter_report(files: DataFrame, kept: Column, tracks: str = "num_tracks") -> DataFrame:
    """(files, kept, keep_rate, low, high, mean): the share kept, and the track counts of what is kept."""
    n = F.when(kept, F.col(tracks))
    return files.agg(F.count("*").alias("files"), F.count_if(kept).alias("kept"), F.round(F.try_divide(100.0 * F.count_if(kept), F.count("*")), 6).alias("keep_rate"), F.min(n).alias("low"), F.max(n).alias("high"), F.round(F.avg(n), 6).alias("mean"))


def split_counts(files: DataFrame, split: Column) -> DataFrame:
    """(split, n, share) with share in percent."""
    a = files.groupBy(split.alias("split")).agg(F.count("*").alias("n"))
    return a.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def selection_profile(selected: DataFrame, counts: DataFrame, tokens_per_note: int = 3) -> tuple[DataFrame, DataFrame]:
    """Of selected files (md5, total_notes) and their tracks by group (md5, grp, n): totals (files, notes, tokens, hours) and
    (grp, tracks, share, files) of each group."""
    notes = F.sum("total_notes")
    totals = selected.agg(F.count("*").alias("files"), notes.alias("notes"), (notes * tokens_per_note).alias("tokens"), F.round(notes / EVENTS_PER_HOUR, 9).alias("hours"))
    a = counts.join(selected.select("md5"), "md5", "left_semi").groupBy("grp").agg(F.sum("n").alias("tracks"), F.count_distinct("md5").alias("files"))
    return totals, a.select("grp", "tracks", F.round(100.0 * F.col("tracks") / F.sum("tracks").over(Window.partitionBy()), 6).alias("share"), "files")


def context_bars(events: Column, bars: Column, triples: int = 339) -> Column:
    """How many bars of a track fit the model's context."""
    return triples / (events / bars)
