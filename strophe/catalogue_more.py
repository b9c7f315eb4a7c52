"""Queries of files, sinks, reports, listening-test tasks and generation, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.catalogue import _GATE, _GATES, _MELODY, _SPLIT, COLS, GENRES, WINDOWS, U, _both, _marked, _messages, _pack_sql, _packable, query
from strophe.functions import vocab as V
from strophe.operators import clips, codec, corpus, generation, sequence, stats, training
from strophe.plans import bind
from strophe.plans.bind import FILES, NOTES
from strophe.plans.scratch import folder as scratch
from strophe.plans.scratch import stored
from strophe.sources import files as tree
from strophe.sources import listing, midi, text


# sinks read back


@query(_pack_sql(1) + " SELECT list_prepend(flag, toks)::INT[] AS tokens FROM packed WHERE NOT discarded")
def token_lines(spark, d):
    path = scratch(spark)
    text.write_token_lines(training.pack(*_packable(spark, d)).where("not discarded"), path)
    return text.read_token_lines(spark, path, 2)


@query(f"WITH {NOTES} SELECT md5(CAST(track AS VARCHAR)) AS md5, pos, time, dur, pitch, instr, (pitch * 7) % 128 AS velocity FROM notes")
def compound_files(spark, d):
    path = scratch(spark)
    text.write_compound(bind.notes(spark, d).withColumn("velocity", F.col("pitch") * 7 % 128), path)
    rows = text.read_compound(spark, f"{path}/[0-9a-f]/*.compound.txt")
    return rows.withColumn("md5", F.regexp_extract("path", "/([0-9a-f]+)[.]compound", 1)).select("md5", "pos", "time", "dur", "pitch", "instr", "velocity")


@query("SELECT md5(CAST(o_orderkey AS VARCHAR)) AS md5, 'train' AS split, 0::BIGINT AS num_tracks, o_orderpriority AS title, '' AS artist, CAST(o_totalprice AS DOUBLE) AS duration, '' AS time_signature, 0.0::DOUBLE AS tempo FROM orders")
def json_records(spark, d):
    rows = bind.read(spark, d, "orders").select(
        F.md5(F.col("o_orderkey").cast("string")).alias("md5"), F.lit(None).cast("int").alias("num_tracks"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("artist"),
        F.col("o_totalprice").alias("duration"), F.lit(None).cast("string").alias("time_signature"), F.lit(None).cast("double").alias("tempo"),
    )
    path = scratch(spark)
    text.write_json(corpus.records(rows, "train"), path)
    return spark.read.schema("md5 string, split string, num_tracks long, title string, artist string, duration double, time_signature string, tempo double").json(path)


@query(f"WITH {WINDOWS} SELECT track, count(DISTINCT instr) AS parts FROM win GROUP BY track HAVING count(DISTINCT instr) <= 15 AND count(*) FILTER (WHERE time <= 500) >= 10 AND track % 10 BETWEEN 2 AND 6")
def index_csv(spark, d):
    """Candidates indexed by track, five of every ten read back and joined with the tracks they name."""
    rows = clips.clip_candidates(clips.random_windows(bind.notes(spark, d), 2000), 500)
    path = scratch(spark)
    text.write_csv(rows.select((F.col("track") % 10).alias("idx"), F.col("track").cast("string").alias("original"), "parts"), path)
    files = bind.notes(spark, d).select(F.col("track").cast("string").alias("name")).distinct()
    return text.index_files(text.read_index(spark, path, 2, 5), files).select(F.col("name").cast("long").alias("track"), F.col("parts").cast("long").alias("parts"))


@query("SELECT l_linenumber AS step, round(avg(l_discount * 10), 3) AS loss FROM lineitem GROUP BY l_linenumber")
def loss_csv(spark, d):
    path = scratch(spark)
    text.write_csv(bind.read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("step")).agg(F.round(F.avg(F.col("l_discount") * 10), 3).alias("loss")), path)
    return spark.read.schema("step int, loss double").csv(path, header=True)


@query("SELECT count(*) AS total_files, CAST(sum(o_totalprice > 100000) AS BIGINT) AS kept FROM orders")
def stats_json(spark, d):
    path = scratch(spark)
    text.write_json(bind.read(spark, d, "orders").agg(F.count("*").alias("total_files"), F.count_if(F.col("o_totalprice") > 100000).alias("kept")), path)
    return spark.read.schema("total_files long, kept long").json(path)


@query(f"SELECT split, CAST(length(lines) AS BIGINT) AS bytes, md5(lines) AS md5 FROM (SELECT {_SPLIT} AS split, string_agg(v || chr(10), '' ORDER BY md5) AS lines FROM (SELECT md5(CAST(c_custkey AS VARCHAR)) AS md5, CAST(c_custkey AS VARCHAR) AS v FROM customer) GROUP BY 1)")
def split_files(spark, d):
    """One file for each split, whose lines follow the md5: hex shard after hex shard. The file's bytes are compared."""
    return text.write_splits(bind.read(spark, d, "customer").select(F.md5(F.col("c_custkey").cast("string")).alias("md5"), F.col("c_custkey").cast("string").alias("value")), scratch(spark))


@query("SELECT md5(CAST(c_custkey AS VARCHAR)) AS md5, c_custkey, substr(md5(CAST(c_custkey AS VARCHAR)), 1, 1) AS hex FROM customer")
def hex_shards(spark, d):
    """Half of the rows written, then all of them: those that are there are passed over."""
    path = scratch(spark)
    rows = bind.read(spark, d, "customer").select(F.md5(F.col("c_custkey").cast("string")).alias("md5"), "c_custkey")
    text.write_sharded(rows.where("c_custkey % 2 = 0"), path, text.existing_md5(spark, path))
    text.write_sharded(rows, path, text.existing_md5(spark, path))
    return text.read_shards(spark, path).select("md5", "c_custkey", F.col("hex").cast("string").alias("hex"))


# files


_TRACKS = "SELECT md5(CAST(l_suppkey AS VARCHAR)) AS md5 FROM lineitem GROUP BY l_suppkey"


def _files(spark: SparkSession, d: str, broken: bool = False) -> str:
    """Every track as a file in a folder of its split and hex digit."""
    root = scratch(spark)
    made = midi.write_files(codec.midi_schedule(bind.notes(spark, d)))
    named = made.select(F.md5(F.col("track").cast("string")).alias("md5"), "content")
    named = named.select(F.concat_ws("/", corpus.hash_split(F.col("md5")), corpus.hex_shard(F.col("md5")), F.concat("md5", F.lit(".mid"))).alias("name"), "content")
    if broken:
        named = named.unionByName(spark.range(3).select(F.concat(F.lit("train/0/bad"), F.col("id").cast("string"), F.lit(".mid")).alias("name"), F.encode(F.lit("no header"), "UTF-8").alias("content")))
    midi.write_raw(named, root).where("written").count()
    return root


def _md5():
    return F.regexp_extract("path", "([^/]+)[.]mid$", 1).alias("md5")


@query(f"WITH {NOTES} SELECT md5(CAST(track AS VARCHAR)) AS md5, time, instr, pitch FROM notes")
def midi_files(spark, d):
    """Notes to files and back: onsets are exact."""
    notes = codec.midi_notes(midi.decode(midi.read_files(spark, _files(spark, d))), bind.parts(spark, d))
    return notes.withColumnRenamed("track", "path").select(_md5(), "time", "instr", "pitch")


@query(f"WITH {NOTES} SELECT md5(CAST(track AS VARCHAR)) AS md5, count(*) AS note_events, count(DISTINCT instr) + 1 AS tracks FROM notes GROUP BY track UNION ALL SELECT 'bad' || i, NULL, NULL FROM range(3) t(i)")
def midi_raw_counts(spark, d):
    return midi.raw_counts(midi.read_files(spark, _files(spark, d, True))).select(_md5(), "note_events", "tracks")


@query(f"WITH {NOTES} SELECT md5(CAST(track AS VARCHAR)) AS md5, count(*) AS note_ons, round(max(time + dur) / 100.0, 4) AS seconds, round(max(time + dur) / 100.0, 4) AS seconds_at_120 FROM notes GROUP BY track")
def midi_durations(spark, d):
    files = midi.read_files(spark, _files(spark, d))
    return midi.durations(midi.decode(files), midi.divisions(files)).select(_md5(), "note_ons", F.round("seconds", 4).alias("seconds"), F.round("seconds_at_120", 4).alias("seconds_at_120"))


@query(f"WITH {NOTES}, f AS (SELECT track, count(*) AS n, max(time + dur) AS t FROM notes GROUP BY track) SELECT count(*) AS files, 3::BIGINT AS errors, CAST(sum(n) AS BIGINT) AS notes, CAST(3 * sum(n) AS BIGINT) AS tokens, round(sum(t) / 360000.0, 6) AS hours FROM f")
def midi_totals(spark, d):
    files = midi.read_files(spark, _files(spark, d, True))
    return midi.scan_totals(midi.raw_counts(files), midi.durations(midi.decode(files), midi.divisions(files))).withColumn("hours", F.round("hours", 6))


@query(f"SELECT {_SPLIT} AS split, count(*) AS files FROM (SELECT md5(CAST(l_suppkey AS VARCHAR)) AS md5 FROM lineitem GROUP BY l_suppkey) GROUP BY 1")
def midi_by_split(spark, d):
    return midi.file_sizes(midi.read_files(spark, _files(spark, d)), ("train", "valid", "test")).select("split", "files")


@query(f"SELECT md5, {_SPLIT} AS split FROM (SELECT md5(CAST(l_suppkey AS VARCHAR)) AS md5 FROM lineitem GROUP BY l_suppkey)")
def midi_local(spark, d):
    rows = text.local_files(spark, _files(spark, d), ("train", "valid", "test"), ())
    return rows.select("md5", F.regexp_extract("path", "/(train|valid|test)/", 1).alias("split"))


@query(f"WITH {NOTES} SELECT md5(CAST(track AS VARCHAR)) AS md5, 96.0::DOUBLE AS bpm, '3/4' AS signature, round(max(time + dur) * 0.625 / 62, 3) AS seconds FROM notes GROUP BY track")
def midi_retimed(spark, d):
    """Tempo and signature of every file rewritten."""
    rows = midi.file_summary(midi.decode(midi.rewrite_timing(midi.read_files(spark, _files(spark, d)), 96, 3)))
    return rows.select(_md5(), F.get("bpms", F.lit(0)).alias("bpm"), F.get("signatures", F.lit(0)).alias("signature"), F.round("seconds", 3).alias("seconds"))


@query(f"WITH {NOTES} SELECT md5(CAST(track AS VARCHAR)) AS md5, instr, count(*) AS note_ons FROM notes GROUP BY track, instr")
def midi_parts(spark, d):
    """Of every file's parts their note-ons, by the program that the part's summary names."""
    rows = midi.part_summary(midi.decode(midi.read_files(spark, _files(spark, d)))).where("note_ons > 0")
    program = F.when(F.array_contains("channels", 9), V.DRUMS).otherwise(F.element_at(F.split(F.get("programs", F.lit(0)), ":"), 2).cast("int"))
    return rows.select(_md5(), program.cast("long").alias("instr"), "note_ons")


@query("SELECT CAST(c_custkey AS VARCHAR) AS md5, c_name AS title, 'say \"' || c_mktsegment || '\", twice' AS style FROM customer")
def metadata_csv(spark, d):
    path = scratch(spark)
    rows = bind.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("md5"), F.col("c_name").alias("title"), F.concat(F.lit('say "'), "c_mktsegment", F.lit('", twice')).alias("style"))
    rows.write.csv(path, header=True, escape='"')
    return text.read_metadata(spark, path)


@query("SELECT md5(CAST(o_orderkey AS VARCHAR)) AS md5, o_orderpriority AS title, CAST(o_custkey AS BIGINT) AS num_tracks FROM orders")
def record_lists(spark, d):
    """Files that hold one list of records each, as JSON over several lines."""
    rows = bind.read(spark, d, "orders").select(F.md5(F.col("o_orderkey").cast("string")).alias("md5"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("num_tracks"))
    path = scratch(spark)
    lists = rows.groupBy(corpus.hex_shard(F.col("md5")).alias("hex")).agg(F.to_json(F.collect_list(F.struct("md5", "title", "num_tracks")), {"pretty": "true"}).alias("content"))
    tree.write_tree(lists.select(F.concat("hex", F.lit(".json")).alias("name"), F.encode("content", "UTF-8").alias("content")), path)
    return text.read_records(spark, path).select("md5", "title", "num_tracks")


@query(f"""WITH t AS ({_TRACKS}), c AS (SELECT md5, s, k FROM t, (VALUES (0, 'train'), (1, 'valid'), (2, 'test')) a(s, sn), (VALUES (0, 'plain'), (1, 'drums')) b(k, kn)
  WHERE substr(md5, 1 + s * 2 + k, 1) < '8') SELECT md5, min_by(s * 2 + k, s * 2 + k) AS first FROM c GROUP BY md5""")
def local_categories(spark, d):
    """A file lies in some of six folders; the first of these in the order of splits, then categories, counts, hidden ones do not."""
    splits, kinds = ("train", "valid", "test"), ("plain", "drums")
    md5 = bind.read(spark, d, "lineitem").select(F.md5(F.col("l_suppkey").cast("string")).alias("md5")).distinct()
    places = F.array(*[F.when(F.substring("md5", 1 + i * 2 + k, 1) < "8", F.lit(f"{s}/{c}/")) for i, s in enumerate(splits) for k, c in enumerate(kinds)])
    named = md5.select(F.explode(F.filter(places, lambda x: x.isNotNull())).alias("folder"), "md5")
    named = named.select(F.concat("folder", "md5", F.lit(".mid")).alias("name")).unionByName(named.select(F.concat(F.lit("__MACOSX/train/plain/"), "md5", F.lit(".mid")).alias("name")).distinct())
    root = scratch(spark)
    tree.write_tree(named.withColumn("content", F.encode(F.lit("x"), "UTF-8")), root)
    rank = sum((F.when(F.col("path").contains(f"/{n}/"), w * i).otherwise(0) for names, w in ((splits, 2), (kinds, 1)) for i, n in enumerate(names)), F.lit(0))
    return text.local_files(spark, root, splits, kinds).select("md5", rank.cast("long").alias("first"))


@query(f"WITH {NOTES}, l AS (SELECT track, list(11000 + 128 * instr + pitch ORDER BY pos) AS t, count(*) AS n FROM notes WHERE pos < (track * 7) % 40 GROUP BY track) SELECT track, t[1:24] AS tokens FROM l WHERE n > 10")
def token_dataset(spark, d):
    """Lines of more than 10 tokens, cut at 24; each begins with what tells it apart."""
    rows = bind.notes(spark, d).where(F.col("pos") < (F.col("track") * 7) % 40).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("pos", (V.NOTE_OFFSET + 128 * F.col("instr") + F.col("pitch")).alias("t")))).alias("x"))
    path = scratch(spark)
    text.write_token_lines(rows.select(F.concat(F.array("track"), F.transform("x", lambda x: x["t"])).alias("tokens")), path)
    lines = text.read_token_lines(spark, path, 11, 25)
    return lines.select(F.col("tokens")[0].cast("long").alias("track"), F.slice("tokens", 2, 24).cast("array<long>").alias("tokens"))


@query(f"WITH {NOTES}, u AS (SELECT DISTINCT track, instr FROM notes) SELECT md5(CAST(track AS VARCHAR)) AS md5, instr, 'part ' || instr AS name FROM u")
def source_track_names(spark, d):
    """Files whose tracks have names, and the names of the instruments in them."""
    schedule = codec.midi_schedule(bind.notes(spark, d))
    names = schedule.select("track", "instr").distinct().select("track", "instr", F.concat(F.lit("part "), F.col("instr").cast("string")).alias("name"))
    files = midi.write_files(schedule, names).select(F.md5(F.col("track").cast("string")).alias("path"), "content")
    return midi.source_names(midi.decode(files)).select(F.col("path").alias("md5"), F.col("instr").cast("long").alias("instr"), "name")


@query("""SELECT o_orderkey AS k, [CAST(o_custkey AS DOUBLE), 12.5, -1.0] AS scores, [o_orderpriority, 'it is'] AS groups, 0 AS bad FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, [], [], 0 FROM orders WHERE o_orderkey % 3 = 0""")
def literal_lists(spark, d):
    """Lists written as Python literals; a third can't be read."""
    bad = F.col("o_orderkey") % 3 == 0
    number = F.when(bad, F.lit("[1, None, 3]")).otherwise(F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit(", 12.5, -1]")))
    words = F.when(bad, F.lit("['a', None")).otherwise(F.concat(F.lit("['"), "o_orderpriority", F.lit("', 'it is']")))
    rows = bind.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), number.alias("n"), words.alias("w"))
    kept = lambda c: F.when(F.exists(c, lambda x: x.isNull()), F.array().cast(f"array<{'double' if c == 'scores' else 'string'}>")).otherwise(F.col(c))
    rows = rows.select("k", corpus.parse_number_list(F.col("n")).alias("scores"), corpus.parse_string_list(F.col("w")).alias("groups"))
    return rows.select("k", kept("scores").alias("scores"), kept("groups").alias("groups"), F.lit(0).alias("bad"))


@query(f"WITH {NOTES}, m AS (SELECT track, time, instr, pitch, 1 AS is_on, pos FROM notes) SELECT md5(CAST(track AS VARCHAR)) AS md5, count(*) AS ons, CAST(sum(1000 + 128 * instr + pitch) AS BIGINT) AS total FROM m GROUP BY track")
def midi_to_interarrival(spark, d):
    """Files to inter-arrival tokens: the note-ons among them, as numbers and sum."""
    tokens = codec.midi_interarrival(midi.decode(midi.read_files(spark, _files(spark, d))), bind.parts(spark, d))
    ons = tokens.where((F.col("token") >= V.MIDI_ON) & (F.col("token") < V.MIDI_OFF))
    rows = ons.groupBy(F.col("track").alias("path")).agg(F.count("*").alias("ons"), F.sum("token").alias("total"))
    return rows.select(_md5(), "ons", "total")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS line, CAST(c_custkey AS VARCHAR) || ' ' || c_name AS value FROM customer QUALIFY (row_number() OVER (ORDER BY c_custkey) - 1) % 10 = 0")
def every_tenth_line(spark, d):
    """Lines of several files are numbered as they stand there."""
    path = scratch(spark)
    rows = bind.read(spark, d, "customer").select("c_custkey", F.concat_ws(" ", "c_custkey", "c_name").alias("value"))
    rows.repartitionByRange(5, "c_custkey").sortWithinPartitions("c_custkey").select("value").write.text(path)
    return text.every_line(spark, path)


@query(f"WITH {NOTES}, f AS (SELECT track, count(*) AS n, max(time + dur) AS t FROM notes GROUP BY track) SELECT count(*) AS files, 3::BIGINT AS errors, CAST(sum(n) AS BIGINT) AS notes, CAST(3 * sum(n) AS BIGINT) AS tokens, round(sum(t) / 360000.0, 6) AS hours FROM f")
def scan_report(spark, d):
    """The totals of a scan as a JSON report, read back."""
    files, path = midi.read_files(spark, _files(spark, d, True)), scratch(spark)
    text.write_json(midi.scan_totals(midi.raw_counts(files), midi.durations(midi.decode(files), midi.divisions(files))), path)
    return spark.read.schema("files long, errors long, notes long, tokens long, hours double").json(path).withColumn("hours", F.round("hours", 6))


@query(f"WITH {NOTES}, p AS (SELECT track, instr, row_number() OVER (PARTITION BY track ORDER BY min(pos)) AS part, count(*) AS n FROM notes GROUP BY track, instr) SELECT md5(CAST(track AS VARCHAR)) AS md5, part, CASE WHEN part % 2 = 1 THEN 'voice ' || part ELSE NULL END AS name, n AS note_ons FROM p")
def renamed_tracks(spark, d):
    """Every other track of the files gets a name; the notes stay."""
    files = midi.read_files(spark, _files(spark, d))
    parts = midi.part_summary(midi.decode(files)).where("note_ons > 0 and part % 2 = 1").select("path", "part", F.concat(F.lit("voice "), F.col("part").cast("string")).alias("name"))
    rows = midi.part_summary(midi.decode(midi.rename_tracks(files, parts, bind.parts(spark, d)))).where("note_ons > 0")
    return rows.select(_md5(), F.col("part").cast("long").alias("part"), "name", "note_ons")


@query(f"WITH {NOTES}, c AS (SELECT md5(CAST(track AS VARCHAR)) AS md5, count(*) AS note_events, count(DISTINCT instr) + 1 AS tracks FROM notes GROUP BY track) SELECT md5, {_SPLIT} AS split, note_events, tracks FROM c WHERE {_SPLIT} IN ('train', 'test') AND substr(md5, 1, 1) IN ('0', '3', '5', '8', 'b', 'f')")
def files_of_folders(spark, d):
    """Counts of the files in some folders; only these are listed and opened."""
    rows = listing.read_tree(spark, _files(spark, d), "counts").where("split in ('train', 'test') and hex in ('0', '3', '5', '8', 'b', 'f')")
    return rows.select("md5", "split", "note_events", "tracks")


_TRACK_SAMPLE = "SELECT md5, {} AS draw FROM (SELECT *, row_number() OVER (ORDER BY md5('{}:' || md5), md5) AS k, count(*) OVER () AS n FROM t) WHERE k <= greatest(1, floor(n * 0.001))"


@query(f"WITH t AS ({_TRACKS}) {_TRACK_SAMPLE.format(1, 42)} UNION ALL {_TRACK_SAMPLE.format(2, 43)}")
def parsing_samples(spark, d):
    """One file in a thousand, one at least, and a second sample by the next seed."""
    files = bind.read(spark, d, "lineitem").select(F.md5(F.col("l_suppkey").cast("string")).alias("md5")).distinct()
    one, two = (corpus.exact_sample(files, "md5", 0.001, seed=42 + k, min_one=True).select("md5", F.lit(k + 1).alias("draw")) for k in (0, 1))
    return one.unionByName(two)


@query(f"WITH {NOTES} SELECT DISTINCT track, CAST((track % 32) * 2.5 AS DOUBLE) AS seconds, CAST(track % 7 + 1 AS INT) AS fraction FROM notes")
def bar_seconds(spark, d):
    rows = bind.notes(spark, d).select("track").distinct()
    fraction = V.quantize_fraction(F.concat(F.lit(" 1/"), (F.col("track") % 7 + 1).cast("string")))
    return rows.select("track", V.bar_to_seconds(F.col("track") % 32 + 1, 96, 4, 4).cast("double").alias("seconds"), fraction.alias("fraction"))


@query("WITH n AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem) SELECT n AS processed, 3::BIGINT AS discarded, round(300.0 / (n + 3), 2) AS rate FROM n")
def discard_rate(spark, d):
    rows = midi.raw_counts(midi.read_files(spark, _files(spark, d, True)))
    return stats.discard_rate(rows, F.col("note_events").isNull())


@query(f"WITH {NOTES} SELECT track, time, 11000 + 128 * instr + pitch AS note FROM notes")
def midi_events(spark, d):
    """Notes to event triples to a schedule to files and back to triples."""
    tokens = sequence.encode_events(bind.notes(spark, d))
    files = midi.write_files(codec.events_to_schedule(tokens)).select(F.col("track").cast("string").alias("path"), "content")
    back = codec.files_to_events(midi.decode(files), bind.parts(spark, d))
    return back.select(F.col("track").cast("long").alias("track"), F.get("tokens", F.lit(0)).cast("long").alias("time"), F.get("tokens", F.lit(2)).cast("long").alias("note"))


# reports


@query(f"""WITH {_GATES}, u AS (SELECT track, pos, time, dur FROM notes UNION ALL SELECT track + 1000000, pos, time, dur FROM feed),
l AS (SELECT u.track, any_value({_GATE}) AS status, 3 * count(*) AS tokens, max_by(time + dur, pos) / 100.0 AS seconds FROM u JOIN g ON g.track = u.track GROUP BY u.track)
SELECT count(*) AS tracks, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE status = 0) AS kept, CAST(sum(tokens) FILTER (WHERE status = 0) AS BIGINT) AS kept_tokens,
  round(100.0 * count(*) FILTER (WHERE status = 0) / count(*), 6) AS kept_share, round(100.0 * sum(tokens) FILTER (WHERE status = 0) / sum(tokens), 6) AS kept_token_share, round(sum(seconds) FILTER (WHERE status = 0) / 3600, 6) AS hours,
  round(avg(seconds) FILTER (WHERE status = 0), 6) AS mean_seconds, round(stddev_pop(seconds) FILTER (WHERE status = 0), 6) AS std_seconds, round(avg(tokens) FILTER (WHERE status = 0), 6) AS mean_tokens, round(stddev_pop(tokens) FILTER (WHERE status = 0), 6) AS std_tokens FROM l""")
def compound_summary(spark, d):
    both = _both(spark, d)
    return stats.compound_summary(both, training.gate(both))


@query("SELECT p_type AS grp, round(100.0 * sum(CASE WHEN l_quantity >= 20 THEN 1 ELSE 0 END) / count(*), 6) AS share_20, round(100.0 * sum(CASE WHEN l_quantity >= 30 THEN 1 ELSE 0 END) / count(*), 6) AS share_30 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type")
def group_shares(spark, d):
    part = bind.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("grp"))
    return stats.group_quantiles(bind.read(spark, d, "lineitem").join(part, "l_partkey").select("grp", F.col("l_quantity").cast("long").alias("v")), "grp", "v", (20, 30)).select("grp", "share_20", "share_30")


_METRICS = "('files', 178165.0, files, files / 178165.0), ('events', 663555310.0, events, events / 663555310.0), ('tokens', 1990665930.0, tokens, tokens / 1990665930.0), ('hours', 8943.0, hours, hours / 8943.0), ('events_per_hours', 663555310 / 8943.0, events / hours, NULL), ('tokens_per_hours', 1990665930 / 8943.0, tokens / hours, NULL), ('events_per_files', 663555310 / 178165.0, events / files, NULL)"


@query(f"WITH {NOTES}, t AS (SELECT CAST(count(DISTINCT track) AS DOUBLE) AS files, CAST(count(*) AS DOUBLE) AS events, 3.0 * count(*) AS tokens, sum(dur) / 360000.0 AS hours FROM notes) SELECT m AS metric, round(CAST(r AS DOUBLE), 6) AS reference, round(CAST(v AS DOUBLE), 6) AS value, round(CAST(q AS DOUBLE), 6) AS ratio FROM t, LATERAL (VALUES {_METRICS}) x(m, r, v, q)")
def corpus_comparison(spark, d):
    return stats.compare_corpus(bind.notes(spark, d).agg(F.count_distinct("track").alias("files"), F.count("*").alias("events"), (3 * F.count("*")).alias("tokens"), (F.sum("dur") / 360000.0).alias("hours")))


@query(f"WITH {NOTES} SELECT track, count(*) FILTER (WHERE delta > 999) AS truncated FROM (SELECT track, time * 40 - coalesce(lag(time * 40) OVER (PARTITION BY track ORDER BY pos), 0) AS delta FROM notes) GROUP BY track")
def delta_truncations(spark, d):
    rows = _messages(bind.notes(spark, d))
    return codec.delta_truncations(rows.withColumn("time", F.col("time") * 40))


@query()
def tokenization_report(spark, d):
    rows = _both(spark, d).where("time >= 0")
    shards = rows.select("track", (F.col("track") % 4).alias("shard")).distinct()
    pieces = stored(training.sequences(rows, shards, 2, (3,)))
    return training.tokenization_report(rows, pieces, training.pack_pieces(pieces))


# selection


@query(f"WITH {FILES} SELECT md5 FROM files WHERE list_has_any(styles, ['BUILDING', 'machinery'])")
def style_filter(spark, d):
    return bind.files(spark, d).where(corpus.style(F.col("styles"), ("BUILDING", "machinery"))).select("md5")


@query(f"WITH {FILES} SELECT md5 FROM files WHERE len(list_filter(list_append(styles, CASE WHEN total_notes % 2 = 0 THEN 'Machinery' END), lambda s: lower(s) IN ('building', 'machinery'))) > 0")
def genre_scraped(spark, d):
    return bind.files(spark, d).where(corpus.genre(F.col("styles"), F.when(F.col("total_notes") % 2 == 0, "Machinery"), GENRES)).select("md5")


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 9) WHERE o_totalprice > 100000")
def limit_scanned(spark, d):
    rows = bind.read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return corpus.limit_per_split(rows, "o_orderpriority", "o_orderkey", 9, F.col("o_totalprice") > 100000).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0")
def every_tenth(spark, d):
    return corpus.subsample(bind.read(spark, d, "orders"), "o_orderkey").select("o_orderkey")


_TAKE = U.format("'0', 'take', track")


@query(f"WITH {WINDOWS}, c AS (SELECT track FROM win GROUP BY track HAVING count(DISTINCT instr) <= 15 AND count(*) FILTER (WHERE time <= 500) >= 10) SELECT track, row_number() OVER (ORDER BY {_TAKE}, track) - 1 AS idx FROM c QUALIFY idx < 7")
def take_accepted(spark, d):
    rows = clips.clip_candidates(clips.random_windows(bind.notes(spark, d), 2000), 500)
    return clips.take_accepted(rows, "track", 7).select("track", "idx")


# listening-test tasks and edits

_OTHER = WINDOWS.split("notes AS", 1)[1].split(", ends AS", 1)[1].replace("'clip'", "'again'").replace("starts", "starts2").replace("ends", "ends2").replace("win AS", "win2 AS")


@query(f"""WITH {WINDOWS}, ends2 AS{_OTHER}, {_MELODY}, own AS (SELECT w.*, m.instr AS melody FROM win w JOIN melody m ON m.track = w.track),
p AS (SELECT 0 AS src, track, pos, time, dur, instr, pitch FROM own WHERE instr <> melody AND time <= 500
  UNION ALL SELECT 1, w.track, pos, time, least(dur, 2000 - time), w.instr, pitch FROM win2 w JOIN melody m ON m.track = w.track WHERE w.instr <> m.instr AND time BETWEEN 500 AND 2000
  UNION ALL SELECT 2, track, pos, time, dur, instr, pitch FROM own WHERE instr = melody)
SELECT track, row_number() OVER (PARTITION BY track ORDER BY time, src, pos) - 1 AS pos, 'event' AS kind, time, dur, instr, pitch FROM p""")
def retrieved_clip(spark, d):
    rows = bind.notes(spark, d)
    return clips.retrieved(clips.random_windows(rows, 2000), clips.random_windows(rows, 2000, "0", "again"), stats.melody_instrument(rows), 500, 2000)


@query(f"WITH {NOTES}, c AS (SELECT track, pos, kind, time, CASE WHEN time + dur > 4000 THEN 4000 - time ELSE dur END AS dur, instr, pitch FROM notes WHERE time BETWEEN 1000 AND 4000) SELECT track, pos, kind, time - min(time) OVER (PARTITION BY track) AS time, dur, instr, pitch FROM c")
def trim_clip(spark, d):
    return clips.trim(bind.notes(spark, d), 10.0, 30.0)


@query(f"WITH {NOTES}, c AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY time, CASE WHEN instr IN (0, 8) THEN 1 ELSE 0 END, pos) - 1 AS pos, kind, time, dur, instr, pitch FROM notes), k AS (SELECT track, pos, kind, time, CASE WHEN time + dur > 3000 THEN 3000 - time ELSE dur END AS dur, instr, pitch FROM c WHERE time BETWEEN 500 AND 3000) SELECT track, pos, kind, time - min(time) OVER (PARTITION BY track) AS time, dur, instr, pitch FROM k")
def preview_clip(spark, d):
    return clips.preview(*sequence.split(_marked(bind.notes(spark, d))), 5.0, 30.0)


@query(f"WITH {NOTES} SELECT {COLS} FROM notes WHERE time BETWEEN 0 AND 2500")
def revert_clip(spark, d):
    return clips.revert(bind.notes(spark, d), 25.0)


@query(f"""WITH {NOTES}, m AS (SELECT track, max(time) AS fin FROM notes GROUP BY track), n AS (SELECT notes.track, pos, pitch, time, least(time + dur // 25, fin) AS until, dense_rank() OVER (PARTITION BY notes.track ORDER BY instr) AS part FROM notes JOIN m ON m.track = notes.track WHERE instr <> 128),
c AS (SELECT track, pos, pitch, part, unnest(range(time, until)) AS tick FROM n) SELECT track, tick, pitch, CAST(max_by(part, pos) AS BIGINT) AS part FROM c GROUP BY track, tick, pitch""")
def piano_roll(spark, d):
    return clips.piano_roll(bind.notes(spark, d).withColumn("dur", F.floor(F.col("dur") / 25)))


@query(f"""WITH t AS ({_TRACKS}), w AS (SELECT md5, true AS held FROM t UNION ALL SELECT md5('none' || i), false FROM range(4) r(i))
SELECT md5, CASE WHEN held THEN 'written' ELSE 'missing' END AS first, CASE WHEN held THEN 'exists' ELSE 'missing' END AS again, held AS listed FROM w""")
def copied_files(spark, d):
    """Wanted files are copied, then once more; four have no local file."""
    local = text.local_files(spark, _files(spark, d), ("train", "valid", "test"), ())
    wanted = local.select("md5").unionByName(spark.range(4).select(F.md5(F.concat(F.lit("none"), F.col("id").cast("string"))).alias("md5")))
    root = scratch(spark)
    first, again = (tree.copy_wanted(wanted, local, root).withColumnRenamed("status", c) for c in ("first", "again"))
    listed = tree.list_tree(spark, root).select(F.regexp_extract("name", "^[0-9a-f]/([0-9a-f]{32})[.]mid$", 1).alias("md5"), F.lit(True).alias("listed"))
    return first.join(again, "md5").join(listed, "md5", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


@query(f"SELECT md5, {_SPLIT} || '/' || substr(md5, 1, 1) || '/' || md5 || '.mid' AS name FROM ({_TRACKS})")
def restructured_files(spark, d):
    """Files of one folder are moved into folders of their split and hex digit."""
    flat, root = scratch(spark), scratch(spark)
    made = midi.write_files(codec.midi_schedule(bind.notes(spark, d))).select(F.concat(F.md5(F.col("track").cast("string")), F.lit(".mid")).alias("name"), "content")
    tree.write_tree(made, flat)
    tree.restructure(text.local_files(spark, flat, (), ()), root, "move")
    return tree.list_tree(spark, root).select(F.regexp_extract("name", "([^/]+)[.]mid$", 1).alias("md5"), "name")


@query(f"""WITH r AS (SELECT md5, substr(md5, 1, 1) AS hex FROM ({_TRACKS})), k AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY md5('42:' || md5 || '.mid'), md5) AS k, count(*) OVER (PARTITION BY hex) AS n FROM r)
SELECT {_SPLIT} || '/' || hex || '/' || md5 || '.mid' AS name, 'written' AS status FROM k WHERE k <= greatest(1, floor(n * 0.3))""")
def mirrored_files(spark, d):
    """A share of each hex digit's files is copied to the same place below another root."""
    source, root = _files(spark, d), scratch(spark)
    done = tree.mirror_sample(tree.list_tree(spark, source, "*.mid"), source, root, 0.3)
    return done.join(tree.list_tree(spark, root).select("name"), "name")


@query(f"WITH {NOTES} SELECT md5(CAST(track AS VARCHAR)) AS md5, count(*) AS note_ons, max(time) AS last_on FROM notes WHERE dur % 3 <> 0 GROUP BY track")
def interarrival_files(spark, d):
    """Inter-arrival tokens to files in hex folders by a committed sink, and read back."""
    schedule = codec.with_channels(codec.interarrival_schedule(codec.interarrival(_messages(bind.notes(spark, d)))))
    md5 = F.md5(F.col("track").cast("string"))
    root = scratch(spark)
    tree.write_tree(midi.write_files(schedule).select(F.concat_ws("/", corpus.hex_shard(md5), F.concat(md5, F.lit(".mid"))).alias("name"), "content"), root)
    rows = midi.decode(midi.read_files(spark, root))
    return rows.where("type = 'note' and on").groupBy("path").agg(F.count("*").alias("note_ons"), F.max("time").alias("last_on")).select(_md5(), "note_ons", "last_on")


_TRY = U.format("'0', '{}', track, attempt")


@query(f"""WITH {NOTES}, e AS (SELECT track, max(time) AS fin FROM notes GROUP BY track HAVING max(time) >= 2000), a AS (SELECT track, fin, unnest(range(16)) AS attempt FROM e),
d AS (SELECT track, attempt, {_TRY.format('attempt')} AS draw, CAST(floor((fin - 2000) * {_TRY.format('start')}) AS BIGINT) AS start FROM a),
c AS (SELECT d.track, attempt, draw, start, count(DISTINCT instr) AS parts, count(*) FILTER (WHERE time - start <= 500) AS n FROM d JOIN notes ON notes.track = d.track AND time BETWEEN start AND start + 2000 GROUP BY ALL)
SELECT * FROM c WHERE parts <= 15 AND n >= 25 ORDER BY draw, track, attempt LIMIT 40""")
def clips_until(spark, d):
    """The first 40 accepted windows of up to 16 in each track."""
    return clips.sample_until(bind.notes(spark, d), 40, 2000, 500, min_events=25)


# generation


#: Logits by the distance from the wanted token, for any of them.
_AWAY = -50.0 * np.abs(np.arange(-V.VOCAB, V.VOCAB))


def _steady(tokens: list[int], instr: int = 40) -> np.ndarray:
    """The next event comes 40 ticks after the last, 20 ticks long, always the same note or, where that may not be, the nearest."""
    slot = (len(tokens) - 1) % 3
    if slot == 0:
        times = [t for t, n in zip(tokens[1::3], tokens[3::3], strict=True) if n < V.CONTROL_OFFSET]
        want = max(times, default=0) + 40
    else:
        want = V.DUR_OFFSET + 20 if slot == 1 else V.NOTE_OFFSET + 128 * instr + 60
    return _AWAY[V.VOCAB - want :][: V.VOCAB]


#: Models for tests.
steady = generation.each(_steady)
wanting = generation.each(lambda tokens: _steady(tokens, 126))


_STEADY = """last AS (SELECT track, t + 100 * CAST(greatest(0, floor((3000 - t - 1) / 100.0)) AS BIGINT) AS t FROM (SELECT track, coalesce(max(time) FILTER (WHERE time <= 3000 {who}), 0) AS t FROM notes GROUP BY track)),
made AS (SELECT track, unnest(range(greatest(t + 40, 3000), 3400, 40)) AS time FROM last)"""


@query(f"""WITH {NOTES}, {_STEADY.format(who="AND instr NOT IN (0, 8)")}, a AS (SELECT 0 AS src, track, pos, time, least(dur, 999) AS dur, instr, pitch FROM notes WHERE instr NOT IN (0, 8) AND time <= 3000
  UNION ALL SELECT 0, track, 1000000, time, 20, 40, 60 FROM made UNION ALL SELECT 1, track, pos, time, dur, instr, pitch FROM notes WHERE instr NOT IN (0, 8) AND time > 3000)
SELECT track, row_number() OVER (PARTITION BY track ORDER BY time, src, pos) - 1 AS pos, 'event' AS kind, time, dur, instr, pitch FROM a""")
def generate_anticipatory(spark, d):
    events, controls = sequence.split(_marked(bind.notes(spark, d)))
    return generation.generate(sequence.sort(events), controls, steady, 3000, 3400)


@query(f"""WITH {NOTES}, {_STEADY.format(who="")}, a AS (SELECT track, pos, time, least(dur, 999) AS dur, instr, pitch FROM notes WHERE time <= 3000 UNION ALL SELECT track, 1000000, time, 20, 40, 60 FROM made)
SELECT track, row_number() OVER (PARTITION BY track ORDER BY time, pos) - 1 AS pos, 'event' AS kind, time, dur, instr, pitch FROM a""")
def continuation(spark, d):
    return generation.continue_from(bind.notes(spark, d), steady, 30.0, 34.0)


@query(f"""WITH {NOTES}, {_STEADY.format(who="AND instr NOT IN (0, 8)")}, a AS (SELECT 0 AS src, track, time, CAST(20 AS BIGINT) AS dur, CAST(40 AS BIGINT) AS instr, CAST(60 AS BIGINT) AS pitch, 0 AS pos FROM made
  UNION ALL SELECT 0, track, time, least(dur, 999), instr, pitch, pos - 1000000 FROM notes WHERE instr = 40 AND time <= 3000 UNION ALL SELECT 1, track, time, dur, instr, pitch, pos FROM notes WHERE instr IN (0, 8))
SELECT track, row_number() OVER (PARTITION BY track ORDER BY time, src, pos) - 1 AS pos, 'event' AS kind, time, dur, instr, pitch FROM a""")
def accompany_parts(spark, d):
    return generation.accompany(bind.notes(spark, d), [0, 8], steady, 30.0, 34.0, [40])


_MANY = "n AS (SELECT track, pos, kind, time, dur, CASE WHEN instr = 128 THEN instr ELSE pitch % 16 END AS instr, pitch FROM notes)"


@query(f"""WITH {NOTES}, {_MANY}, s AS (SELECT track, count(DISTINCT instr) FILTER (WHERE instr >= 6 OR time <= 3400) >= 15 AND bool_or(instr = 128) AS full FROM n WHERE time <= 3500 AND (instr < 6 OR time <= 3000) GROUP BY track),
{_STEADY.replace("{who}", "AND instr >= 6").replace("FROM notes GROUP", "FROM n GROUP")}, a AS (SELECT 0 AS src, track, pos, time, least(dur, 999) AS dur, instr, pitch FROM n WHERE instr >= 6 AND time <= 3000
  UNION ALL SELECT 0, m.track, 1000000, time, 20, CASE WHEN s.full THEN 128 ELSE 126 END, CASE WHEN s.full THEN 0 ELSE 60 END FROM made m JOIN s ON s.track = m.track
  UNION ALL SELECT 1, track, pos, time, dur, instr, pitch FROM n WHERE instr >= 6 AND time > 3000)
SELECT track, row_number() OVER (PARTITION BY track ORDER BY time, src, pos) - 1 AS pos, 'event' AS kind, time, dur, CAST(instr AS BIGINT) AS instr, CAST(pitch AS BIGINT) AS pitch FROM a""")
def capped_generation(spark, d):
    """The model wants instrument 126; 10 instruments, drums and 6 of controls are there, so the nearest note of theirs comes."""
    rows = bind.notes(spark, d).withColumn("instr", F.when(F.col("instr") == 128, F.col("instr")).otherwise(F.col("pitch") % 16))
    events, controls = sequence.split(sequence.to_controls(rows, F.col("instr") < 6))
    return generation.generate(sequence.sort(events), controls, wanting, 3000, 3400)


def _ends(spark: SparkSession, d: str) -> DataFrame:
    return bind.notes(spark, d).groupBy("track").agg((F.max("time") / 100.0).alias("last_onset"), (F.max(F.col("time") + F.col("dur")) / 100.0).alias("last_end"), ((F.max(F.col("time") + F.col("dur")) + 150) / 100.0).alias("length"))


@query(f'WITH {NOTES}, e AS (SELECT track, max(time + dur) / 100.0 AS t FROM notes GROUP BY track) SELECT track, (floor(t / 2.5) + 1) * 2.5 AS start, (floor(t / 2.5) + 1) * 2.5 + 4 * 2.5 AS "end" FROM e')
def window_from_end(spark, d):
    return generation.generation_window(_ends(spark, d), 96, 4, bars=4, from_end=True, snap=True, allow_silence=True)


@query(f'WITH {NOTES} SELECT DISTINCT track, 10.0::DOUBLE AS start, 20.0::DOUBLE AS "end" FROM notes')
def window_by_bars(spark, d):
    return generation.generation_window(_ends(spark, d), 96, 4, 5, 8)


@query(f'WITH {NOTES}, e AS (SELECT track, (max(time + dur) + 150) / 100.0 / 16 AS bar FROM notes GROUP BY track) SELECT track, round(4 * bar, 6) AS start, round(8 * bar, 6) AS "end" FROM e')
def window_by_parts(spark, d):
    return generation.generation_window(_ends(spark, d), 96, 4, 5, 8, input_bars=16).select("track", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(f"""WITH {NOTES}, g AS (SELECT track, pos, CAST(round_even(time / 12.0, 0) * 12 AS BIGINT) AS time, greatest(CAST(round_even(dur / 12.0, 0) * 12 AS BIGINT), 12) AS dur, instr, pitch FROM notes),
q AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY time, pos) AS pos, time, dur, instr, pitch FROM g),
a AS (SELECT 0 AS src, track, pos, time, dur, instr, pitch FROM notes UNION ALL SELECT 1, track, pos, time, dur, instr, pitch FROM q WHERE time >= 3001)
SELECT track, row_number() OVER (PARTITION BY track ORDER BY time, src, pos) - 1 AS pos, 'event' AS kind, time, dur, instr, pitch FROM a""")
def append_generated(spark, d):
    rows = bind.notes(spark, d)
    return generation.append_new(rows, sequence.quantize(rows, 120, 16), 30.0).withColumn("kind", F.lit("event"))
