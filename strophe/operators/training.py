"""From tracks to fixed-length training rows: gate, augmentation, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import vocab as V
from strophe.operators import interleave
from strophe.operators import sequence as S
from strophe.operators.spans import extract_spans as extract_spans
from strophe.plans.scan import scan
from strophe.plans.scratch import stored


def gate(df: DataFrame) -> DataFrame:
    """(track, n, end, status): 0 good, 1 too short, 2 too long, 3 too many instruments, tested in this order."""
    return _measured(df).select("track", "n", "end", "status")


def _measured(df: DataFrame) -> DataFrame:
    """gate() with parts, the track's instruments: a set of 129 at most, so it is put together before the exchange."""
    a = df.where("kind = 'event'").groupBy("track").agg(F.count("*").alias("n"), F.max("time").alias("end"), F.array_sort(F.collect_set("instr")).alias("parts"))
    status = F.when((F.col("n") < V.MIN_TRACK_EVENTS) | (F.col("end") < V.MIN_TRACK_TIME), 1).when(F.col("end") > V.MAX_TRACK_TIME, 2).when(F.size("parts") > V.MAX_TRACK_INSTR, 3).otherwise(0)
    return a.withColumn("status", status.cast("long"))


def extract_random(df: DataFrame, rate: int | Column, seed: str = "0") -> DataFrame:
    """Events become controls with chance rate / 10."""
    hit = V.uniform(seed, "random", F.col("track"), F.col("pos")) < rate / 10
    return df.withColumn("kind", F.when(hit & (F.col("kind") == "event"), "control").otherwise(F.col("kind")))


def augment(tracks: DataFrame, factor: int) -> DataFrame:
    """(track, ..., k, mode) of each copy: k mod 10 is 0 none, 1 span, 2 to 5 random, 6 to 9 instruments."""
    mode = F.element_at(F.array(*[F.lit(x) for x in ["none", "span", *["random"] * 4, *["instrument"] * 4]]), (F.col("k") % 10 + 1).cast("int"))
    return tracks.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn("mode", mode).withColumn("k", F.col("k").cast("long"))


def mode_of(k: int) -> str:
    return "none" if k % 10 == 0 else "span" if k % 10 == 1 else "random" if k % 10 < 6 else "instrument"


def sequences(notes: DataFrame, shards: DataFrame, factor: int = 1, unchanged: tuple = (), seed: str = "0", span_wait: int = 2000) -> DataFrame:
    """Pieces (shard, track, start, flag, time, dur, note) of the sequences of all copies of the tracks that pass the gate.

    shards: (track, shard), a row for each track; tracks of the `unchanged` shards (validation and test) have their one unchanged copy.
    Copy k of `factor` is augmented as mode_of(k) says: unchanged, in spans, by chance (rate 1 to 9 tenths) or by instruments. Each copy is padded
    to the track's end, its controls are interleaved, and a separator put before it; its sequence is the pair (track, k). Events count in
    order of time, then pos.
    """
    events, heads = _tracks(notes, shards, factor, unchanged)
    return interleave.interleaved(events, heads, {k: mode_of(k) for k in range(factor)}, seed, span_wait)


def _tracks(notes: DataFrame, shards: DataFrame, factor: int, unchanged: tuple) -> tuple[DataFrame, DataFrame]:
    """Events and heads of tracks as interleave wants them."""
    events = notes.where("kind = 'event'").withColumn("dur", V.clamp_dur(F.col("dur")).cast("long"))
    all_copies, one = (F.array(*[F.lit(k).cast("long") for k in range(n)]) for n in (factor, 1))
    copies = F.when(F.col("shard").isin(*unchanged), one).otherwise(all_copies) if unchanged else all_copies
    heads = _measured(notes).join(shards, "track", "left")
    return events, heads.select("track", "shard", F.col("end").alias("end_time"), F.when((F.col("status") == 0) & F.col("shard").isNotNull(), copies).alias("copies"), "parts")


def tokenize(notes: DataFrame, shards: DataFrame, factor: int = 1, unchanged: tuple = (), seed: str = "0", size: int = V.M, max_time: int = V.MAX_TIME, span_wait: int = 2000, tasks: int | None = None) -> DataFrame:
    """Training rows (shard, chunk, flag, start, discarded, tokens) of sequences(notes, shards, factor, unchanged, seed, span_wait).

    The copies are many times the notes, so they aren't shuffled: a first pass over the notes counts their triples, and a second one, which knows
    each sequence's place in its shard, cuts them into rows where they are made. Only rows that tracks share, two at most for each track, and
    rows whose flag hangs on these are exchanged. `tasks` says over how many tasks the tracks are dealt.
    """
    events, heads = _tracks(notes, shards, factor, unchanged)
    how = ({k: mode_of(k) for k in range(factor)}, seed, span_wait)
    total = F.coalesce(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n), F.lit(0))
    placed = scan(stored(interleave.sized(events, heads, *how, tasks)), "shard", "track", sums={"base": total})
    made = stored(interleave.chunked(events, placed, *how, size, max_time, tasks))
    dealt = lambda df: df.repartition(tasks, "shard", "chunk") if tasks else df
    alone = made.where("cut is not null")
    shared = stored(_joined(dealt(made.where("cut is null").withColumn("flag", F.col("own"))), size, max_time))
    flags = _flags(alone.select(*_NARROW).unionByName(shared.select(*_NARROW)))
    late = dealt(alone.where("flag is null").select(*shared.columns).unionByName(shared)).join(flags, ["shard", "chunk"])
    return _rows(alone.where("flag is not null").select(*late.columns).unionByName(late))


def tokenization_report(notes: DataFrame, pieces: DataFrame, rows: DataFrame, size: int = V.M) -> DataFrame:
    """One row of seven counters and two ratios of a tokenization.

    notes: what went in; pieces: what sequences() gave; rows: what they were packed into. sequences, rests put in (and their share of triples in
    percent), tracks too short, too long and with too many instruments, rows discarded, durations cut (of every copy, and their share). Rests
    count wherever their triple went, also in a shard's last short row. Shares are null without rows.
    """
    counts = _measured(notes).agg(*[F.count_if(F.col("status") == k).alias(n) for k, n in enumerate(("good", "short", "long", "instruments"))]).drop("good")
    copies = pieces.where("start = 0").groupBy(F.col("track.track").alias("track")).agg(F.count("*").alias("copies"))
    cut = S.truncations(notes).join(copies, "track").agg(F.coalesce(F.sum(F.col("truncated") * F.col("copies")), F.lit(0)).alias("truncated"))
    rests = pieces.agg(F.coalesce(F.sum(F.size(F.filter("note", lambda t: t == V.REST))), F.lit(0)).alias("rests"))
    made = rows.agg(F.count_if(~F.col("discarded")).alias("sequences"), F.count_if(F.col("discarded")).alias("discarded"))
    share = lambda c: F.round(F.try_divide(100.0 * F.col(c), F.col("sequences") * size), 2)
    one = lambda df: df.withColumn("one", F.lit(1))
    all_ = one(made).join(one(rests), "one").join(one(counts), "one").join(one(cut), "one")
    return all_.select("sequences", "rests", "short", "long", "instruments", "discarded", "truncated", share("rests").alias("rest_share"), share("truncated").alias("cut_share"))


def with_separator(df: DataFrame) -> DataFrame:
    """Each track with a separator before its first row."""
    n = F.row_number().over(Window.partitionBy("track").orderBy("pos")).cast("long")
    fields = ("pos", "kind", "time", "dur", "instr", "pitch")
    row = F.struct(*[F.col(c) for c in fields])
    null = F.lit(None).cast("long")
    sep = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("sep").alias("kind"), *[null.alias(c) for c in fields[2:]])
    both = df.withColumn("pos", n).select("track", F.explode(F.when(F.col("pos") == 1, F.array(sep, row)).otherwise(F.array(row))).alias("r"))
    return both.select("track", "r.*").select(*V.NOTE_COLUMNS)


def pack(rows: DataFrame, flags: DataFrame, size: int = V.M, max_time: int = V.MAX_TIME) -> DataFrame:
    """Cut the sequences of every shard, end to end, into rows of `size` triples.

    rows: (shard, track, pos, kind, time, dur, instr, pitch); sequences follow in order of track. flags:
    (shard, track, flag). A cut may fall inside a sequence; the last short row of a shard goes. Times are
    taken relative to the least one before the row's first separator; rows that still reach max_time go.
    Returns (shard, chunk, flag, start, discarded, tokens). The flag is that of the sequence that owns the
    first triple, but after a discarded row it stays that row's until a row starts with a sequence.
    Places come from running sums over the sequences' sizes that many tasks share, so no task sees a whole shard.
    """
    note = F.when(F.col("kind") == "sep", V.SEPARATOR).when(F.col("kind") == "rest", V.REST).otherwise(V.NOTE_OFFSET + F.col("instr") * V.MAX_PITCH + F.col("pitch") + F.when(F.col("kind") == "control", V.CONTROL_OFFSET).otherwise(0))
    cell = F.struct("pos", F.coalesce("time", F.lit(0)).cast("int").alias("time"), F.coalesce("dur", F.lit(0)).cast("int").alias("dur"), note.cast("int").alias("note"))
    # a sequence in pieces, so that a long one isn't one array
    pieces = rows.groupBy("shard", "track", F.floor(F.col("pos") / interleave.PIECE).alias("__piece")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    pieces = pieces.join(flags, ["shard", "track"]).select("shard", "track", F.get("c", F.lit(0))["pos"].alias("start"), F.col("flag").cast("int").alias("flag"), *[_field("c", f).alias(f) for f in ("time", "dur", "note")])
    return pack_pieces(stored(pieces), size, max_time)


def _field(structs: str, name: str) -> Column:
    return F.transform(structs, lambda x: x[name])


def _cuts(pieces: DataFrame, size: int, arrays: tuple[str, ...]) -> DataFrame:
    """(shard, chunk, q, ...) of pieces (shard, track, start, ...) cut at every `size` of the shard's places; q is the first place in the chunk."""
    pieces = pieces.withColumn("__n", F.size(arrays[0]))
    placed = scan(pieces.groupBy("shard", "track").agg(F.sum("__n").alias("__n")), "shard", "track", sums={"__base": F.col("__n")}).drop("__n")
    at = pieces.join(placed, ["shard", "track"]).withColumn("__p", F.col("__base") + F.col("start")).where("__n > 0")
    chunks = F.sequence(F.floor(F.col("__p") / size), F.floor((F.col("__p") + F.col("__n") - 1) / size))
    at = at.withColumn("chunk", F.explode(chunks)).withColumn("__from", F.greatest(F.col("chunk") * size - F.col("__p"), F.lit(0)).cast("int"))
    at = at.withColumn("__count", F.least(F.col("__n"), (F.col("chunk") + 1) * size - F.col("__p")).cast("int") - F.col("__from"))
    others = [c for c in pieces.columns if c not in ("shard", "track", "start", "__n", *arrays)]
    return at.select("shard", "chunk", (F.col("__p") + F.col("__from") - F.col("chunk") * size).cast("int").alias("q"), *others, *[F.slice(c, F.col("__from") + 1, F.col("__count")).alias(c) for c in arrays])


def pack_pieces(pieces: DataFrame, size: int = V.M, max_time: int = V.MAX_TIME) -> DataFrame:
    """pack() of sequences that come as pieces (shard, track, start, flag, time, dur, note): arrays of the triples from place start on."""
    chunks = stored(_joined(_cuts(pieces, size, _ARRAYS), size, max_time))
    return _rows(chunks.join(_flags(chunks.select(*_NARROW)), ["shard", "chunk"]))


_ARRAYS = ("time", "dur", "note")
_NARROW = ("shard", "chunk", "discarded", "cut", "own")


def _joined(cut: DataFrame, size: int, max_time: int) -> DataFrame:
    """Chunks (shard, chunk, own, time, dur, note, cut, start, discarded) of their parts (shard, chunk, q, flag, time, dur, note); short ones go."""
    chunks = cut.groupBy("shard", "chunk").agg(F.array_sort(F.collect_list(F.struct("q", "flag", *_ARRAYS))).alias("c"))
    chunks = chunks.select("shard", F.col("chunk").cast("long").alias("chunk"), F.get("c", F.lit(0))["flag"].alias("own"), *[F.flatten(_field("c", f)).alias(f) for f in _ARRAYS])
    chunks = chunks.where(F.size("note") == size).withColumn("sep", F.array_position("note", V.SEPARATOR).cast("int"))
    chunks = chunks.withColumn("cut", F.when(F.col("sep") == 0, size + 1).otherwise(F.col("sep")))
    chunks = chunks.withColumn("start", F.coalesce(F.array_min(F.slice("time", 1, F.col("cut") - 1)), F.lit(0)))
    head = F.transform(F.slice("time", 1, F.col("cut") - 1), lambda t: t - F.col("start"))
    chunks = chunks.withColumn("time", F.concat(head, F.slice("time", F.col("cut"), size))).drop("sep")
    # a separator's time is not one, but nothing is less than 0
    return chunks.withColumn("discarded", F.array_max("time") >= max_time)


def _flags(narrow: DataFrame) -> DataFrame:
    """(shard, chunk, flag) of all chunks (shard, chunk, discarded, cut, own)."""
    after = narrow.select("shard", (F.col("chunk") + 1).alias("chunk"), F.col("discarded").alias("lost"))
    fresh = ~F.coalesce("lost", F.lit(False)) | (F.col("cut") == 1)
    return scan(narrow.join(after, ["shard", "chunk"], "left"), "shard", "chunk", lasts={"flag": F.when(fresh, F.col("own"))}).select("shard", "chunk", "flag")


def _rows(chunks: DataFrame) -> DataFrame:
    def triple(x: Column) -> Column:
        shift = F.when(x["note"] >= V.CONTROL_OFFSET, V.CONTROL_OFFSET).otherwise(0)
        sep = x["note"] == V.SEPARATOR
        return F.array(F.when(sep, V.SEPARATOR).otherwise(x["time"] + V.TIME_OFFSET + shift), F.when(sep, V.SEPARATOR).otherwise(x["dur"] + V.DUR_OFFSET + shift), x["note"])

    tokens = F.concat(F.array(F.col("flag")), F.flatten(F.transform(F.arrays_zip(*_ARRAYS), triple)))
    return chunks.select("shard", "chunk", F.col("flag").cast("long").alias("flag"), F.col("start").cast("long").alias("start"), "discarded", tokens.alias("tokens"))


def tokenize_interarrival(tokens: DataFrame, status: DataFrame, shards: DataFrame, size: int = V.CONTEXT) -> DataFrame:
    """Rows (shard, chunk, tokens) of the inter-arrival tokens (track, pos, token) of tracks whose gate status is 0, a separator before each track."""
    good = tokens.join(status.where("status = 0").select("track"), "track", "left_semi")
    # put before a track's first row and not by a union, which would lose how the tracks are dealt
    row = F.struct((F.col("pos") + 1).alias("pos"), F.col("token").cast("long").alias("token"))
    sep = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(V.MIDI_SEPARATOR).cast("long").alias("token"))
    first = F.row_number().over(Window.partitionBy("track").orderBy("pos")) == 1
    rows = good.withColumn("first", first).select("track", F.explode(F.when(F.col("first"), F.array(sep, row)).otherwise(F.array(row))).alias("r")).select("track", "r.*")
    return pack_tokens(rows.join(shards, "track"), size)


def pack_tokens(tokens: DataFrame, size: int = V.CONTEXT) -> DataFrame:
    """Inter-arrival tokens (shard, track, pos, token) cut into rows of `size`; the last short row goes."""
    tokens = tokens.withColumn("token", F.col("token").cast("int"))
    pieces = tokens.groupBy("shard", "track", F.floor(F.col("pos") / interleave.PIECE).alias("__piece")).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("c"))
    pieces = stored(pieces.select("shard", "track", F.get("c", F.lit(0))["pos"].alias("start"), F.transform("c", lambda x: x["token"]).alias("tokens")))
    rows = _cuts(pieces, size, ("tokens",)).groupBy("shard", "chunk").agg(F.array_sort(F.collect_list(F.struct("q", "tokens"))).alias("c"))
    return rows.select("shard", "chunk", F.flatten(_field("c", "tokens")).cast("array<long>").alias("tokens")).where(F.size("tokens") == size)
