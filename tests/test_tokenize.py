"""The whole way from notes to training rows against a sequential version, and MIDI summaries."""

import hashlib
import math

from pyspark.sql import functions as F

from strophe.functions import vocab as V
from strophe.operators import codec, stats, training
from strophe.sources import midi

NOTES = "track long, pos long, kind string, time long, dur long, instr long, pitch long"


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / float(1 << 32)


def copies(track, events, k, seed="0"):
    """(events, controls) of one augmented copy; events are (pos, time, dur, instr, pitch)."""
    key, mode = f"{{{track}, {k}}}", training.mode_of(k)
    hit = set()
    if mode == "span":
        on, nxt, end = True, 0, 0
        for e in events:
            if on and e[1] >= end:
                on, nxt = False, e[1] + math.floor(-math.log(1 - uniform(seed, "span", key, e[0])) * 2000)
            if not on and e[1] >= nxt:
                on, end = True, e[1] + V.DELTA
            if on:
                hit.add(e[0])
    elif mode == "random":
        rate = 1 + math.floor(uniform(seed, "rate", key) * 9)
        hit = {e[0] for e in events if uniform(seed, "random", key, e[0]) < rate / 10}
    elif mode == "instrument":
        parts = sorted({e[3] for e in events}, key=lambda i: (uniform(seed, "instrument", key, i), i))
        if len(parts) > 1:
            drawn = parts[: 1 + math.floor(uniform(seed, "instruments", key) * (len(parts) - 1))]
            hit = {e[0] for e in events if e[3] in drawn}
    return [e for e in events if e[0] not in hit], [e for e in events if e[0] in hit]


def triples(events, controls, end):
    """Padded, interleaved and encoded, after a separator."""
    rows, last = [], 0
    for e in [*events, None]:
        t = end if e is None else e[1]
        rows += [("rest", r, 0, None, None) for r in range(last + 100, t, 100)]
        if e is not None:
            rows.append(("event", *e[1:]))
            last = t
    out, before, waiting = [("sep",)], 0, list(controls)
    for r in rows:
        while waiting and before >= waiting[0][1] - V.DELTA:
            out.append(("control", *waiting.pop(0)[1:]))
        out.append(r)
        before = r[1]
    assert not waiting
    return out


def encoded(row):
    if row[0] == "sep":
        return [V.SEPARATOR] * 3
    shift = V.CONTROL_OFFSET if row[0] == "control" else 0
    return [row[1] + shift, V.DUR_OFFSET + row[2] + shift, V.REST if row[0] == "rest" else V.NOTE_OFFSET + 128 * row[3] + row[4] + shift]


def sequential(tracks, factor, size, max_time):
    rows, waiting, flag = [], [], None
    for track, events in tracks:
        for k in range(factor):
            own = V.AUTOREGRESS if k % 10 == 0 else V.ANTICIPATE
            if not waiting:
                flag = own
            waiting += triples(*copies(track, events, k), max(e[1] for e in events))
            while len(waiting) >= size:
                cut, waiting = waiting[:size], waiting[size:]
                n = next((i for i, r in enumerate(cut) if r[0] == "sep"), size)
                least = min((r[1] for r in cut[:n]), default=0)
                cut = [(r[0], r[1] - least, *r[2:]) if i < n else r for i, r in enumerate(cut)]
                if max((r[1] for r in cut if r[0] != "sep"), default=0) >= max_time:
                    continue
                rows.append([flag] + [t for r in cut for t in encoded(r)])
                flag = own
    return rows


def test_tokenize_is_the_sequential_result(spark):
    tracks = []
    for t in range(4):
        at, events = 0, []
        for i in range(130):
            at += int(uniform("gap", t, i) ** 4 * 900) + 3 * (i % 2)
            events.append((i, at, int(uniform("dur", t, i) * 1500), int(uniform("part", t, i) * (1 if t == 2 else 5)) * 8, i % 128))
        tracks.append((t, events))
    data = [(t, e[0], "event", *e[1:]) for t, events in tracks for e in events] + [(9, 0, "event", 5, 5, 0, 60)]
    shards = spark.range(10).select(F.col("id").alias("track"), F.lit(0).cast("long").alias("shard"))
    got = training.tokenize(spark.createDataFrame(data, NOTES), shards, 11, size=41, max_time=4000).where("not discarded").orderBy("chunk").collect()
    clamped = [(t, [(e[0], e[1], min(e[2], 999), e[3], e[4]) for e in events]) for t, events in tracks]
    want = sequential(clamped, 11, 41, 4000)
    assert [r.tokens for r in got] == want and len(want) > 50


def made_tracks(lengths, gap):
    out = []
    for t, n in enumerate(lengths):
        at = 0
        for i in range(n):
            at += int(uniform("gap", t, i // 7) * gap)
            out.append((t, i, "event", at, int(uniform("dur", t, i) * 1500), int(uniform("part", t, i) * 6) * 8, int(uniform("pitch", t, i) * 128)))
    return out


def test_rows_cut_where_they_are_made_are_those_of_packed_pieces(spark):
    """Rows of one track, of two, of many; discarded ones, also one behind the other and where tracks meet; shards that begin and end anywhere."""
    notes = spark.createDataFrame(made_tracks([110, 400, 5, 121, 130, 700, 120, 140, 160], 30), NOTES)
    shards = spark.createDataFrame([(t, f"s{t % 3}") for t in range(9) if t != 4], "track long, shard string")
    lost = 0
    for size, max_time, factor in ((41, 650, 11), (341, 4500, 7), (1500, 10**6, 10), (1, 1, 2)):
        want = training.pack_pieces(training.sequences(notes, shards, factor, ("s1",)), size, max_time)
        got = training.tokenize(notes, shards, factor, ("s1",), size=size, max_time=max_time)
        assert got.schema == want.schema
        rows = sorted(got.collect())
        assert rows == sorted(want.collect()) and len(rows) >= 2
        lost += sum(r.discarded and not s.discarded for r, s in zip(rows[:-1], rows[1:], strict=True))
    assert lost > 20
    assert sorted(training.tokenize(notes, shards, factor, ("s1",), size=size, max_time=max_time, tasks=3).collect()) == rows


def test_copies_are_not_shuffled(spark):
    """Notes are, and of the rows only those that tracks share: 1.3 bytes a token here, 3.4 when all copies went through three shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))

    notes = spark.createDataFrame(made_tracks([2500] * 6, 5), NOTES)
    shards = spark.createDataFrame([(t, t % 2) for t in range(6)], "track long, shard int")
    before = shuffled()
    n = training.tokenize(notes, shards, 10).agg(F.sum(F.size("tokens"))).first()[0]
    assert n > 100_000 and shuffled() - before < 2 * n


def test_running_status_outlasts_meta_events_and_cut_tracks_are_only_counted():
    body = b"\x00\xc0\x05\x00\x90\x3c\x40\x00\xff\x03\x03Sax\x0a\x3e\x40\x0a\x3c\x00\x00\xff\x58\x04\x03\x02\x18\x08\x00\xff\x2f\x00"
    head = b"MThd\x00\x00\x00\x06\x00\x01\x00\x02\x00\x32"
    data = head + b"MTrk" + len(body).to_bytes(4, "big") + body
    kinds = [(m[2], m[5], m[7], m[9]) for m in midi.messages(data) if m[2] in ("note", "name", "signature")]
    assert kinds == [("note", 60, True, None), ("name", None, None, "Sax"), ("note", 62, True, None), ("note", 60, False, None), ("signature", None, None, "3/4")]
    assert midi.count_raw(data + b"MTrk\x00\x00\xff\xff\x00\x90\x3c\x40") == (2, 2)


def test_midi_summaries_names_and_round_trip(spark):
    ticks, tempo = midi.beat_ticks(90)
    assert (ticks, tempo) == (67, 666667)
    notes = [(0, True, 5, 60, 0), (10, True, 128, 35, 9), (20, False, 5, 60, 0), (30, False, 128, 35, 9)]
    data = midi.encode(notes, 50, 500000, 3, {5: ("Lead", "Electric Piano 2"), 128: ("", "Kit")})
    rows = midi.decode(spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"junk"))], "path string, content binary")).cache()
    one = midi.file_summary(rows).collect()
    assert [(r.path, r.parts, r.has_tempo, r.bpms, r.signatures, r.channels) for r in one] == [("a", 3, True, [120.0], ["3/4"], [0, 9])]
    parts = midi.part_summary(rows).orderBy("part").collect()
    assert [(r["name"], r.note_ons, r.channels, r.programs) for r in parts][1:] == [("Lead", 1, [0], ["0:5"]), ("", 1, [9], [])]
    assert {r.instr: r["name"] for r in midi.source_names(rows).collect()} == {5: "Lead", 128: "Kit"}
    got = codec.midi_notes(rows).orderBy("pos").collect()
    assert [(r.time, r.dur, r.instr, r.pitch) for r in got] == [(0, 20, 5, 60), (10, 20, 128, 35)]
    tokens = codec.midi_interarrival(rows)
    assert [r.token for r in tokens.orderBy("pos").collect()] == [1000 + 5 * 128 + 60, 10, 1000 + 128 * 128 + 35, 10, V.MIDI_OFF + 5 * 128 + 60, 10, V.MIDI_OFF + 128 * 128 + 35]
    assert [(r.time, r.on) for r in codec.interarrival_schedule(tokens).orderBy("pos").collect()] == [(0, True), (10, True), (20, False), (30, False)]


def test_part_names_are_numbered(spark):
    parts = spark.createDataFrame([(1, 0, 0), (1, 5, 3), (1, 128, 4), (1, 200, 9)], "track long, instr long, first long")
    given = spark.createDataFrame([(1, 0, "Keys"), (1, 5, "Keys"), (1, 200, "")], "track long, instr long, name string")
    assert {r.instr: r["name"] for r in stats.part_names(parts, given).collect()} == {0: "Keys", 5: "Keys 2", 128: "Drums", 200: "Instrument 200"}
    assert spark.range(1).select(V.quantize_fraction(F.lit("1/16")).alias("n")).first().n == 16
