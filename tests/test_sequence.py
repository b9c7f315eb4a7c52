import pytest
from pyspark.sql import functions as F

from strophe.operators import codec, corpus, sequence, training
from strophe.sources import midi

SCHEMA = "track long, pos long, kind string, time long, dur long, instr long, pitch long"


def rows(spark, *cells):
    return spark.createDataFrame([(1, i, *c) for i, c in enumerate(cells)], SCHEMA)


def note(time, dur=5, kind="event", instr=0, pitch=60):
    return (kind, time, dur, instr, pitch)


def times(df):
    return [(r.kind, r.time) for r in df.orderBy("pos").collect()]


def test_pad_fills_gaps_but_not_exact_ones(spark):
    assert times(sequence.pad(rows(spark, note(0), note(250)), 250)) == [("event", 0), ("rest", 100), ("rest", 200), ("event", 250)]
    assert times(sequence.pad(rows(spark, note(0), note(100), note(200)), 200)) == [("event", 0), ("event", 100), ("event", 200)]


def test_anticipate_releases_and_leaves_over(spark):
    got, left = sequence.anticipate(rows(spark, note(0), note(300), note(700), note(800, kind="control")))
    assert times(got) == [("event", 0), ("event", 300), ("control", 800), ("event", 700)] and not left.count()
    got, left = sequence.anticipate(rows(spark, note(0), note(100), note(700, kind="control")))
    assert times(got) == [("event", 0), ("event", 100)] and left.count() == 1


def test_clip_and_mask_ends(spark):
    assert times(sequence.clip(rows(spark, note(0), note(10), note(20)), 0.1, 0.2)) == [("event", 10), ("event", 20)]
    assert times(sequence.mask(rows(spark, note(10), note(15), note(20)), 0.1, 0.2)) == [("event", 10), ("event", 20)]


def test_translate_min_max_over_separators(spark):
    sep = ("sep", None, None, None, None)
    df = rows(spark, note(5), sep, note(7))
    assert times(sequence.translate(df, -5)) == [("event", 0), ("sep", None), ("event", 7)]
    df = rows(spark, note(5), note(9), sep, note(2), note(40))
    assert sequence.min_time(df).first().min_time == 5 and sequence.max_time(df).first().max_time == 40


def test_clamp_and_round_trip(spark):
    df = rows(spark, *[note(0, d) for d in (-1, 999, 1000, 5000)], note(3, 4, "control", 128, 7), ("rest", 9, 0, None, None), ("sep", None, None, None, None))
    back = sequence.decode_events(sequence.encode_events(df)).orderBy("pos").collect()
    assert [r.dur for r in back] == [25, 999, 999, 999, 4, 0, None] and (back[4].instr, back[4].pitch, back[4].kind) == (128, 7, "control")
    assert sequence.truncations(df).first().truncated == 2


def test_stacking(spark):
    df = rows(spark, note(0, 50), note(100, 20), ("sep", None, None, None, None), note(10, 5))
    assert [t for _, t in times(sequence.stack_segments(df))] == [0, 100, 130]


def test_pairing_first_in_first_out(spark):
    on = [(0, True), (10, True), (20, False), (30, False), (40, False)]
    msg = spark.createDataFrame([(1, i, t, o, 0, 60, 0) for i, (t, o) in enumerate(on)], "track long, pos long, time long, on boolean, instr long, pitch long, channel int")
    assert [(r.time, r.dur) for r in codec.pair_notes(msg).orderBy("pos").collect()] == [(0, 20), (10, 20)]


def test_gate(spark):
    df = spark.range(3).selectExpr("id as track").crossJoin(spark.range(100).selectExpr("id as pos")).selectExpr("track", "pos", "'event' as kind", "pos * case track when 0 then 10 when 1 then 11 else 4000 end as time", "5L as dur", "0L as instr", "1L as pitch")
    assert {r.track: r.status for r in training.gate(df).collect()} == {0: 1, 1: 0, 2: 2}


def test_pack_stale_flag(spark):
    data = [(0, t, p, "sep" if p == 0 else "event", None if p == 0 else time, 1, 0, 1) for t, ts in ((0, [0, 0]), (1, [0, 20000, 0, 0]), (2, [0, 1, 2])) for p, time in enumerate(ts)]
    df = spark.createDataFrame(data, "shard long, track long, pos long, kind string, time long, dur long, instr long, pitch long")
    flags = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3)], "shard long, track long, flag int")
    got = training.pack(df, flags, size=2, max_time=1000).orderBy("chunk").collect()
    assert [r.discarded for r in got] == [False, True, False, False] and [r.flag for r in got] == [1, 2, 2, 3]


def test_midi_round_trip(spark):
    data = midi.encode([(0, True, 0, 60, 0), (10, True, 128, 35, 9), (20, False, 0, 60, 0), (30, False, 128, 35, 9)])
    assert midi.count_raw(data) == (2, 3) and midi.count_raw(b"RIFF") is None
    got = midi.decode(spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"junk"))], "path string, content binary"))
    assert got.where("type = 'bad'").count() == 1
    notes = [(r.time, r.on, r.channel, r.pitch) for r in got.where("type = 'note'").orderBy("pos").collect()]
    assert notes == [(0, True, 0, 60), (10, True, 9, 35), (20, False, 0, 60), (30, False, 9, 35)]


def test_samples(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("md5"))
    assert corpus.exact_sample(df, "md5", 0.1).count() == 10 and corpus.exact_sample(df, "md5", 0.001, min_one=True).count() == 1
    lists = spark.createDataFrame([("['a', 'b']", "[1, 12]"), ("oops", None)], "s string, n string")
    assert [(r.s, r.n) for r in lists.select(corpus.parse_string_list(F.col("s")).alias("s"), corpus.parse_number_list(F.col("n")).alias("n")).collect()] == [(["a", "b"], [1.0, 12.0]), ([], [])]


def test_notes_outside_the_vocabulary_are_errors(spark):
    for bad in ((-1, 0, 60), (0, 129, 60), (0, 0, 128), (0, -1, 60)):
        df = spark.createDataFrame([(1, 0, "event", bad[0], 5, bad[1], bad[2])], "track long, pos long, kind string, time long, dur long, instr long, pitch long")
        with pytest.raises(Exception, match="no such note in track 1"):
            sequence.encode_events(df).collect()
