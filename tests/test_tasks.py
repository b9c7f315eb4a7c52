"""Schedules, prompts, generation, selections and reports against sequential versions, and plans that must stay narrow."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strophe.catalogue_more import steady
from strophe.functions import vocab as V
from strophe.operators import clips, codec, corpus, generation, sampling, sequence, spans, stats, training
from strophe.plans import scratch
from strophe.plans.scan import scan
from strophe.sources import midi, text

NOTES = "track long, pos long, kind string, time long, dur long, instr long, pitch long"


def song(seed, n=60, parts=10, last=4000, dur=(1, 300)):
    rng = random.Random(seed)
    times = sorted(rng.randrange(0, last, 2) for _ in range(n))
    return [(t, rng.randint(*dur), rng.choice([128, *range(0, 8 * parts, 8)]), rng.randrange(128)) for t in times]


def frame(spark, songs, kind="event"):
    return spark.createDataFrame([(k, i, kind, *e) for k, es in songs.items() for i, e in enumerate(es)], NOTES)


def sequential_schedule(notes):
    """(time, on, instr, pitch, channel, delta) in playing order."""
    index = collections.defaultdict(list)
    for time, dur, instr, pitch in notes:
        index[time, 0].append((instr, pitch))
        index[time + dur, 1].append((instr, pitch))
    out, parts, number = [], {}, 0
    for time, off in sorted(index):
        for instr, pitch in index[time, off]:
            if instr not in parts:
                if off:
                    continue
                parts[instr] = [9 if instr == 128 else number, 0]
                number += 1
                if number == 9:
                    number += 1
            channel, before = parts[instr]
            parts[instr][1] = time
            out.append((time, not off, instr, pitch, channel, time - before))
    return out


def test_schedule_numbers_every_part(spark):
    songs = {1: [(0, 10, 128, 35), (5, 10, 0, 60)], 2: song(1), 3: song(2, 200, 14), 4: [(9, -1, 16, 60), (9, 4, 0, 61)]}
    got = collections.defaultdict(list)
    for r in codec.midi_schedule(frame(spark, songs)).orderBy("track", "pos").collect():
        got[r.track].append((r.time, r.on, r.instr, r.pitch, r.channel, r.delta))
    assert got == {k: sequential_schedule(v) for k, v in songs.items()}
    assert got[1][1][4] == 1  # piano behind drums


def test_inter_arrival_tokens_make_files(spark):
    songs = {1: song(5, 40, 6), 2: song(6, 40, 4)}
    tokens = codec.interarrival(codec.note_messages(frame(spark, songs).withColumn("time", F.col("time") % 900)))
    files = midi.write_files(codec.with_channels(codec.interarrival_schedule(tokens)))
    back = codec.midi_notes(midi.decode(files.select(F.col("track").cast("string").alias("path"), "content")))
    want = collections.Counter((str(k), i, p) for k, es in songs.items() for _, _, i, p in es)
    assert collections.Counter((r.track, r.instr, r.pitch) for r in back.collect()) == want
    many = spark.createDataFrame([(1, 0, 0), (1, 1, 5000), (1, 2, 5999), (1, 3, 7000)], "track long, pos long, time long")
    assert codec.delta_truncations(many).first().truncated == 2


def padded(events, end):
    out, last = [], 0
    for e in [*events, None]:
        t = end if e is None else e[0]
        out += [("rest", r, 0, None, None) for r in range(last + 100, t, 100)]
        if e is not None:
            out.append(("event", *e))
            last = t
    return out


def sequential_prompt(inputs, controls, start):
    """(merged rows, waiting rows, flag)."""
    prompt = padded([e for e in inputs if 0 <= e[0] <= start], start)
    ahead = [e for e in controls if e[0] >= 5] + [e for e in inputs if e[0] > start]
    ahead.sort(key=lambda e: e[0])
    flag = V.ANTICIPATE if ahead else V.AUTOREGRESS
    out, before = [], 0
    for r in prompt:
        while ahead and before >= ahead[0][0] - V.DELTA:
            out.append(("control", *ahead.pop(0)))
        out.append(r)
        before = r[1]
    return out, [("control", *e) for e in ahead], flag


def prompts():
    inputs = {k: song(10 + k, 50) for k in range(4)} | {4: [e for e in song(30) if e[0] <= 2000], 5: [(100, 5, 0, 60)]}
    controls = {k: song(20 + k, 30) for k in (0, 1, 3)} | {2: [(3, 5, 0, 60), (1000, 5, 0, 61), (2990, 5, 0, 62), (3900, 5, 0, 63)]}
    return inputs, controls


def test_prompts(spark):
    inputs, controls = prompts()
    merged, waiting, flags = sampling.prompt_assembly(frame(spark, inputs), 3000, frame(spark, controls, "control"))
    rows = lambda df: {k: [tuple(r)[2:] for r in g] for k, g in grouped(df).items()}
    got, left, flag = rows(merged), rows(waiting), {r.track: r.flag for r in flags.collect()}
    for k in inputs:
        assert (got.get(k, []), left.get(k, []), flag[k]) == sequential_prompt(inputs[k], controls.get(k, []), 3000)
    assert {r[1] for r in got[2] if r[0] == "control"} >= {1000, 2990}  # controls before the start stay


def grouped(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("track", "pos").collect():
        out[r.track].append(r)
    return out


def steady_after(times, start):
    return max(max(times, default=0) + 40, start)


def test_generation_with_controls(spark):
    inputs, controls = prompts()
    got = grouped(generation.generate(frame(spark, inputs), frame(spark, controls, "control"), steady, 3000, 3300))
    for k, events in inputs.items():
        merged, _, _ = sequential_prompt(events, controls.get(k, []), 3000)
        times = [r[1] for r in merged if r[0] != "control"]
        made = []
        while (t := steady_after(times, 3000)) < 3300:
            times.append(t)
            made.append(("event", t, 20, 40, 60))
        own = [("event", *r[1:]) for r in merged if r[0] == "event"] + made + [("event", *e) for e in events if e[0] > 3000]
        assert [tuple(r)[2:] for r in got[k]] == sorted(own, key=lambda r: r[1])


def test_generation_of_plain_events(spark):
    inputs, controls = prompts()
    got = grouped(generation.generate_autoregressive(frame(spark, inputs), frame(spark, controls, "control"), steady, 3000, 3300))
    for k in inputs:
        events = sorted([*inputs[k], *controls.get(k, [])], key=lambda e: e[0])
        prompt, later = padded([e for e in events if e[0] <= 3000], 3000), [e for e in events if e[0] > 3000]
        out, ahead, times = [r for r in prompt if r[0] == "event"], list(later), [r[1] for r in prompt]
        now = max(times, default=0)
        while (t := steady_after(times, max(now, 3000))) < 3300:
            now = t
            while ahead and now >= ahead[0][0]:
                times.append(ahead[0][0])
                out.append(("event", *ahead.pop(0)))
            out.append(("event", t, 20, 40, 60))
            times.append(t)
        out += [("event", *e) for e in ahead[:1]] + [("event", *e) for e in later]
        assert [tuple(r)[2:] for r in got[k]] == sorted(out, key=lambda r: r[1]), k


def hashed(histories):
    """Logits that depend on all a track has so far."""
    out = np.zeros((len(histories), V.VOCAB))
    for row, h in zip(out, histories, strict=True):
        rng = np.random.default_rng(abs(hash(tuple(h))))
        row[:] = rng.normal(size=V.VOCAB)
        if len(h) % 3 == 1:  # times near those seen
            row[300 + max([t for t, n in zip(h[1::3], h[3::3], strict=True) if n < V.CONTROL_OFFSET], default=0) :] = -1e9
    return out


def test_generation_in_steps_is_generation_one_by_one():
    def loops():
        for k in range(30):
            prompt = [(20 * i, V.DUR_OFFSET + 5, V.NOTE_OFFSET + 128 * (i % 5) + i) for i in range(k % 7)]
            ahead = [(V.CONTROL_OFFSET + 50 * i, V.CONTROL_OFFSET + V.DUR_OFFSET + 5, V.CONTROL_OFFSET + V.NOTE_OFFSET + 128 * (20 + i % 3)) for i in range(k % 4 * 5)]
            yield k, generation.anticipatory(V.ANTICIPATE, prompt, ahead, 100, 400 + 40 * k, 0.9, 50, np.random.default_rng(k))

    calls = []

    def counting(histories):
        calls.append(len(histories))
        return hashed(histories)

    alone = dict(generation.in_steps(hashed, loops(), 1))
    together = dict(generation.in_steps(counting, loops(), 30))
    assert alone == together and len(alone) == 30
    assert calls[0] == 30 and len(calls) < sum(calls) / 4  # a call a step, not a call a step and track
    calls.clear()
    few = dict(generation.in_steps(counting, loops(), 8))
    assert few == alone and max(calls) == 8 and calls[: len(calls) // 2].count(8) == len(calls) // 2  # ended tracks make room


def test_instruments_of_controls_count_for_the_cap():
    want = generation.each(lambda h: -np.abs(np.arange(V.VOCAB) - (V.NOTE_OFFSET + 128 * 40)).astype(float))
    ahead = [(V.CONTROL_OFFSET + i, V.CONTROL_OFFSET + V.DUR_OFFSET + 5, V.CONTROL_OFFSET + V.NOTE_OFFSET + 128 * i) for i in range(15)]
    for n, instr in ((14, 40), (15, 14)):
        loop = generation.anticipatory(V.ANTICIPATE, [], ahead[:n], 0, V.MAX_TIME, 1.0, V.DELTA, np.random.default_rng(0))
        history = next(loop)
        for _ in range(3):
            last, history = history, loop.send(want([history])[0])
        assert (history[-1] - V.NOTE_OFFSET) // 128 == instr and len(last) == 3 * n + 3


def test_draws_follow_the_masks_and_the_nucleus():
    rng = np.random.default_rng(0)
    assert generation.allowed(0, 50, set()).sum() == V.MAX_TIME - 50 + 1 and generation.allowed(1, 0, set()).sum() == V.MAX_DUR + 1
    assert generation.allowed(2, 0, set(range(15))).sum() == 15 * 128 + 1 and generation.allowed(2, 0, set(range(14))).sum() == V.MAX_NOTE + 1
    logits = np.full(V.VOCAB, -100.0)
    logits[[3, 7, 9]] = np.log([0.7, 0.2, 0.1])
    drawn = collections.Counter(generation.draw(logits, generation.allowed(0, 0, set()), 0.75, rng) for _ in range(300))
    assert set(drawn) == {3, 7} and 0.6 < drawn[3] / 300 < 0.95
    assert generation.draw(logits, generation.allowed(0, 8, set()), 1.0, rng) == 9


def test_windows_of_generation(spark):
    t = spark.createDataFrame([(1, 9.0, 11.5, 12.0)], "track long, last_onset double, last_end double, length double")
    one = lambda *a, **k: tuple(round(x, 6) for x in generation.generation_window(t, 120, 4, *a, **k).select("start", "end").first())
    assert one(5, 6) == (8.0, 12.0) and one(5, bars=3) == (8.0, 14.0) and one(from_end=True, bars=2) == (11.5, 15.5)
    assert one(from_end=True, bars=2, snap=True) == (12.0, 16.0) and one(2, 3, input_bars=6) == (2.0, 6.0)
    for bad in (dict(start_bar=9, end_bar=10), dict(from_end=True, end_bar=2)):
        with pytest.raises(Exception, match="the start is far|the end is not"):
            one(**bad)
    assert one(9, 10, allow_silence=True) == (16.0, 20.0)


def test_candidates_count_the_prompts_end(spark):
    rows = [(1, 0, i, "event", 50 * i, 5, 0, 60) for i in range(11)] + [(2, 0, i, "event", 51 * i, 5, 0, 60) for i in range(11)]
    w = spark.createDataFrame(rows, "track long, start long, pos long, kind string, time long, dur long, instr long, pitch long")
    assert [(r.track, r.n) for r in clips.clip_candidates(w, 450).collect()] == [(1, 10)]
    m = spark.createDataFrame([(1, 5), (2, 5)], "track long, instr long")
    assert clips.accompaniment(w, m, 450).groupBy("track").count().orderBy("track").collect()[0]["count"] == 10


def test_inter_arrival_rows_have_separators_and_a_gate(spark):
    songs = {1: song(1, 150, 5), 2: song(2, 20, 5), 3: song(3, 120, 5)}
    rows = frame(spark, songs)
    tokens = codec.interarrival(codec.note_messages(rows))
    shards = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "track long, shard int")
    got = training.tokenize_interarrival(tokens, training.gate(rows), shards, 64).orderBy("chunk").collect()
    flat = []
    for k in (1, 3):
        flat.append(V.MIDI_SEPARATOR)
        before = 0
        for time, on, instr, pitch, _, _ in sequential_schedule(songs[k]):
            flat += [min(time - before, V.MAX_DELTA)] * (time > before) + [(V.MIDI_ON if on else V.MIDI_OFF) + 128 * instr + pitch]
            before = time
    assert [r.tokens for r in got] == [flat[i : i + 64] for i in range(0, len(flat) - 63, 64)]


def test_valid_and_test_shards_are_not_augmented(spark):
    songs = {k: song(40 + k, 130, 5) for k in range(4)}
    rows, shards = frame(spark, songs), spark.createDataFrame([(k, k % 2) for k in range(4)], "track long, shard int")
    whole = {r.shard: r.n for r in training.tokenize(rows, shards, 3, (1,), size=50).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    one = {r.shard: r.n for r in training.tokenize(rows, shards, 1, size=50).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert whole[1] == one[1] and whole[0] > 2 * one[0]
    notes = rows.unionByName(frame(spark, {9: song(9, 5)})).unionByName(frame(spark, {8: [(0, 1500, 0, 60)] * 120 + [(2000, 1, 0, 60)]}))
    pieces = training.sequences(notes, shards.unionByName(spark.createDataFrame([(8, 0)], "track long, shard int")), 3, (1,)).cache()
    report = training.tokenization_report(notes, pieces, training.pack_pieces(pieces, 50), 50).first()
    assert report.sequences + report.discarded > sum(whole.values()) and (report.short, report.long, report.instruments, report.truncated) == (1, 0, 0, 360)


def test_rests_count_as_they_go_in(spark):
    """Also those of a shard's last short row, which no row holds."""
    notes = frame(spark, {1: [(120 * (i // 10), 5, 0, 60) for i in range(400)]})
    pieces = training.sequences(notes, spark.createDataFrame([(1, 0)], "track long, shard int")).cache()
    report = training.tokenization_report(notes, pieces, training.pack_pieces(pieces)).first()
    assert (report.sequences, report.rests, report.rest_share) == (1, 39, round(3900 / 341, 2))
    empty = training.tokenization_report(notes.limit(0), pieces.limit(0), training.pack_pieces(pieces.limit(0))).first()
    assert (empty.sequences, empty.rests, empty.truncated, empty.rest_share) == (0, 0, 0, None)


def test_interleaving_long_tracks_in_any_batches(spark):
    """Batches of a few rows give what whole tracks give; a copy waits for delta ticks of rows alone."""
    songs = {k: [(7 * i + (300 * (i // 50)), 5, i % 5, 60) for i in range(900)] for k in range(3)}
    rows, shards = frame(spark, songs), spark.createDataFrame([(k, 0) for k in range(3)], "track long, shard int")
    found = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    for n in (found, "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        got.append([tuple(r) for r in training.tokenize(rows, shards, 11, size=64, max_time=10**6).orderBy("chunk").collect()])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", found)
    assert got[0] == got[1] and len(got[0]) > 400


def greedy(files, caps, big):
    """The files that fit, one after the other."""
    order = {frozenset(big[:2]): 0, frozenset(big[1:2]): 1, frozenset(big[:1]): 2}
    ranked = sorted(files, key=lambda f: (-f[2], f[0]))
    others = [f for f in ranked if set(f[1]) - set(big)]
    rest = sorted((f for f in ranked if not set(f[1]) - set(big)), key=lambda f: order.get(frozenset(set(f[1]) & set(big[:2])), 3))
    used, out = collections.Counter(), []
    for phase, part in enumerate((others, rest)):
        for md5, groups, _ in part:
            if all((caps.get(g, 0) == 0 and phase == 0) or used[g] + n <= caps.get(g, 0) for g, n in groups.items()):
                out.append(md5)
                used.update(groups)
    return out


def test_greedy_selection_and_calibration(spark):
    rng = random.Random(1)
    files = [(f"{i:03x}", {g: rng.randint(1, 3) for g in rng.sample("PGDXYZ", rng.randint(1, 3))}, rng.randint(1, 40)) for i in range(200)]
    caps = {"P": 40, "G": 30, "D": 20, "X": 25, "Y": 0}
    counts = spark.createDataFrame([(m, g, n) for m, gs, _ in files for g, n in gs.items()], "md5 string, grp string, n long").repartition(4)
    notes = spark.createDataFrame([(m, t) for m, _, t in files], "md5 string, total_notes long")
    limits = spark.createDataFrame(list(caps.items()), "grp string, target long")
    got = [r.md5 for r in corpus.select_balanced(spark, counts, notes, limits, ("P", "G", "D")).collect()]
    assert got == greedy(files, caps, ("P", "G", "D")) and 20 < len(got) < 200
    size, goal = {m: t for m, _, t in files}, 1500
    a, b, best = 0.001, 20.0, None
    for _ in range(30):
        scale = (a + b) / 2
        total = sum(size[m] for m in greedy(files, {g: max(1, int(t * scale)) for g, t in caps.items()}, ("P", "G", "D")))
        if best is None or abs(total - goal) < best[0]:
            best = (abs(total - goal), scale, total)
        if abs(total - goal) / goal < 0.005:
            break
        a, b = (scale, b) if total < goal else (a, scale)
    row = corpus.calibrate(spark, counts, notes, limits, ("P", "G", "D"), spark.createDataFrame([(goal,)], "goal long")).first()
    assert (row.scale, row.total) == best[1:]
    tied = notes.withColumn("total_notes", F.lit(5).cast("long")).withColumn("row", 200 - F.conv("md5", 16, 10).cast("long"))
    by_row = [r.md5 for r in corpus.select_balanced(spark, counts, tied, limits.limit(0), ("P", "G", "D")).collect()]
    assert by_row == sorted((m for m, g, _ in files if set(g) - set("PGD") and not set(g) & set()), reverse=True)


def test_folds_over_files_hold_a_batch_of_them(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BATCH_FILES", 50)
    counts = spark.range(0, 3000, 1, 6).select(F.md5(F.col("id").cast("string")).alias("md5"), F.concat(F.lit("G"), F.col("id") % 5).alias("grp"), F.lit(1).cast("long").alias("n"))
    notes = counts.select("md5", F.lit(7).cast("long").alias("total_notes"))
    caps = spark.createDataFrame([(f"G{k}", 100) for k in range(5)], "grp string, target long")
    read = corpus._in_order(corpus._phases(counts, notes, ("P", "G", "D")), caps, "md5")
    sizes, seen = [], []
    for _ in range(2):  # as often as it likes
        batches = [list(b) for b in read()]
        sizes.append([len(b) for b in batches])
        seen.append([x for b in batches for x in b])
    assert seen[0] == seen[1] and max(sizes[0]) <= 50 and len(sizes[0]) >= 60
    assert seen[0][0] == (-1, {f"G{k}": 100 for k in range(5)}, "") and [x[2] for x in seen[0][1:]] == sorted(r.md5 for r in counts.collect())
    row = corpus.calibrate(spark, counts, notes, caps, ("P", "G", "D"), spark.createDataFrame([(7 * 1500,)], "goal long")).first()
    assert abs(row.total - 10500) / 10500 < 0.005 and row.files * 7 == row.total


def test_exact_samples_of_any_size(spark):
    df = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("md5"), (F.col("id") % 3).alias("s")).repartition(5)
    order = [r.md5 for r in df.orderBy(corpus.hash_order(F.col("md5")), "md5").collect()]
    for fraction in (0.0, 0.0001, 0.1, 0.37, 1.0):
        assert {r.md5 for r in corpus.exact_sample(df, "md5", fraction).collect()} == set(order[: int(5000 * fraction)])
    assert corpus.exact_sample(df, "md5", 0.0001, min_one=True).count() == 1 and corpus.exact_sample(df.limit(0), "md5", 0.5).count() == 0
    by = collections.Counter(r.s for r in corpus.stratified_sample(df, "s", "md5", 0.1).collect())
    assert by == {0: 166, 1: 166, 2: 166}


def test_tokenizing_reads_notes_twice_and_windows_no_shard(spark, tmp_path, monkeypatch):
    songs = {k: song(60 + k, 130, 5) for k in range(4)}
    path = str(tmp_path / "notes")
    frame(spark, songs).write.parquet(path)
    rows, plans = spark.read.parquet(path), []
    shards = spark.createDataFrame([(k, 0) for k in range(4)], "track long, shard int")
    monkeypatch.setattr(training, "stored", lambda df: plans.append(df) or scratch.stored(df))
    plans.append(training.tokenize(rows, shards, 10))
    text = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert text[0].count("FileScan parquet") == 2 and text[0].count("Exchange ") <= 5 and "Window" not in text[0]
    windows = [x for t in text for x in t.split("\n") if "Window [" in x]
    assert all("__p" in x.split("], [")[1] or "__part" in x for x in windows)


def test_running_sums_and_carried_values(spark):
    rows = [(g, i, (i * 7) % 5, (i if i % 6 == 1 else None)) for g in (None, 1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, i int, v int, m int").repartition(5)
    got = {(r.g, r.i): (r.s, r.l) for r in scan(df, "g", "i", {"s": F.col("v")}, {"l": F.col("m")}).collect()}
    for g in (None, 1, 2):
        total, last = 0, None
        for _, i, v, m in (r for r in rows if r[0] == g):
            last = m if m is not None else last
            assert got[g, i] == (total, last)
            total += v


def test_styles_and_records(spark):
    df = spark.createDataFrame([("a", ["Rock"], "Latin", b"x"), ("b", ["rock"], None, b""), ("c", None, "gospel", None)], "md5 string, styles array<string>, scraped string, content binary")
    assert [r.md5 for r in df.where(corpus.style(F.col("styles"), ("Rock",))).collect()] == ["a"]
    assert [r.md5 for r in df.where(corpus.genre(F.col("styles"), F.col("scraped"), ("latin", "gospel"))).collect()] == ["a", "c"]
    assert [r.md5 for r in corpus.with_content(df).collect()] == ["a"]


def test_compound_of_files_keeps_velocity(spark, tmp_path):
    data = midi.encode([(0, True, 0, 60, 0), (10, True, 0, 60, 0), (20, False, 0, 60, 0), (30, False, 0, 60, 0)])
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"junk"))], "path string, content binary")
    rows, bad = text.compound_of_files(midi.decode(files))
    assert [tuple(r)[2:] for r in rows.orderBy("pos").collect()] == [(0, 20, 60, 0, 72), (10, 20, 60, 0, 72)] and [r.path for r in bad.collect()] == ["b"]
    text.write_compound(rows, f"{tmp_path}/c")
    assert [tuple(r)[1:] for r in text.read_compound(spark, f"{tmp_path}/c/*/*.txt").orderBy("pos").collect()] == [(0, 0, 20, 60, 0, 72), (1, 10, 20, 60, 0, 72)]


def test_durations_take_each_files_own_header(spark):
    body = [(0, True, 0, 60, 0), (100, False, 0, 60, 0)]
    files = spark.createDataFrame([(str(t), bytearray(midi.encode(body, t))) for t in (50, 25)] + [("0", bytearray(midi.encode(body, 0)))], "path string, content binary")
    got = {r.path: (r.seconds_at_120, r.note_ons) for r in midi.durations(midi.decode(files), midi.divisions(files)).collect()}
    assert got == {"50": (1.0, 1), "25": (2.0, 1), "0": (0.0, 1)}
    totals = midi.scan_totals(midi.raw_counts(files), midi.durations(midi.decode(files), midi.divisions(files))).first()
    assert (totals.files, totals.errors, totals.notes, totals.tokens) == (3, 0, 3, 9) and math.isclose(totals.hours, 3 / 3600, abs_tol=1e-9)


def test_corpus_comparison(spark):
    one = spark.createDataFrame([(178165.0, 663555310.0 * 2, 1990665930.0, 8943.0)], "files double, events double, tokens double, hours double")
    got = {r.metric: r.ratio for r in stats.compare_corpus(one).collect()}
    assert got["files"] == 1.0 and got["events"] == 2.0 and got["events_per_hours"] is None


def test_statistics_of_nothing_are_null(spark):
    none = frame(spark, {1: song(1)}).limit(0)
    assert tuple(stats.discard_rate(none, F.col("time") > 0).first()) == (0, 0, None)
    files = spark.createDataFrame([], "num_tracks int")
    assert stats.filter_report(files, F.col("num_tracks") > 0).first().keep_rate is None
    assert stats.compound_summary(none, training.gate(none)).first().kept_share is None
    totals = spark.createDataFrame([(0, 5, 15, 0.0)], "files long, events long, tokens long, hours double")
    assert {r.metric: r.value for r in stats.compare_corpus(totals).collect()}["events_per_hours"] is None


def test_controls_and_rests_count_as_instruments(spark):
    rows = spark.createDataFrame([(1, 0, "event", 0, 5, 0, 60), (1, 1, "control", 5, 5, 33, 60), (1, 2, "rest", 100, 0, None, None), (1, 3, "sep", None, None, None, None)], NOTES)
    assert {r.instr: (r.n, r["first"]) for r in sequence.instruments(rows).collect()} == {0: (1, 0), 33: (1, 1), 129: (1, 2)}
    assert {r.instr for r in sequence.instruments(rows, count_rest=False).collect()} == {0, 33}


def test_a_seventeenth_channel_is_an_error(spark):
    notes = lambda n: frame(spark, {1: [(10 * i, 5, i, 60) for i in range(n)] + [(500, 5, 128, 40)]})
    held = codec.midi_schedule(notes(15)).where("instr <> 128").agg(F.max("channel").alias("m"), F.count_distinct("channel").alias("n")).first()
    assert tuple(held) == (15, 15)
    with pytest.raises(Exception, match="more than 16 channels in track 1"):
        codec.midi_schedule(notes(16)).collect()
    with pytest.raises(ValueError, match="channel"):
        midi.encode([(0, True, 5, 60, 16)])


def test_spans_of_composed_chunks_are_the_sequential_ones(spark, monkeypatch):
    def sequential(times, waits, delta):
        on, nxt, end, out = True, 0, 0, []
        for t, w in zip(times, waits, strict=True):
            if on and t >= end:
                on, nxt = False, t + w
            if not on and t >= nxt:
                on, end = True, t + delta
            out.append(on)
        return out

    rng = random.Random(8)
    for _ in range(400):
        n = rng.randint(0, 60)
        times = np.array(sorted(rng.randrange(rng.choice([5, 60, 900])) for _ in range(n)), np.int64)
        waits = np.array([rng.choice([0, 1, 3, 40, 200]) for _ in range(n)], np.int64)
        want, state, got = sequential(times.tolist(), waits.tolist(), 20), spans.START, []
        cuts = [0, *sorted(rng.randint(0, n) for _ in range(4)), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            got += spans.marked(state, times[a:b], waits[a:b], 20).tolist()
            side = spans.chunk_map(times[a:b], waits[a:b], 20)[state[0]]
            state = spans._through(state, [x for x, _ in side], [s for _, s in side])
        assert got == want
    songs = {k: song(70 + k, 300, 5) for k in range(3)}
    whole = sorted(map(tuple, training.extract_spans(frame(spark, songs), 200).collect()))
    monkeypatch.setattr(spans, "CHUNK", 16)
    assert sorted(map(tuple, training.extract_spans(frame(spark, songs), 200).collect())) == whole and {r[2] for r in whole} == {"event", "control"}


def test_clips_are_drawn_until_there_are_enough(spark, monkeypatch):
    songs = {k: song(200 + k, 150, 6) for k in range(12)} | {50: [(5, 5, 0, 60)], 51: song(3, 40, 1, 1500)}
    rows = frame(spark, songs)
    every = clips.sample_until(rows, 10**6, 1000, 300, min_events=12).collect()
    assert len({r.track for r in every}) > 3 and len({(r.track, r.attempt) for r in every}) == len(every) < 14 * 16
    rounds = []
    monkeypatch.setattr(clips, "stored", lambda df: rounds.append(1) or scratch.stored(df))
    for n in (0, 1, 7, len(every), len(every) + 5):
        rounds.clear()
        got = clips.sample_until(rows, n, 1000, 300, min_events=12).collect()
        assert got == every[:n] and len(rounds) <= 2 + 8
    for r in every:
        inside = [e for e in songs[r.track] if r.start <= e[0] <= r.start + 1000]
        assert (r.parts, r.n) == (len({e[2] for e in inside}), sum(e[0] - r.start <= 300 for e in inside)) and r.n >= 12
    assert clips.sample_until(rows.limit(0), 5, 1000, 300).count() == 0


def test_maps_are_made_in_slices_of_chunks():
    cell = pa.struct([("kind", pa.string()), ("time", pa.int64()), ("wait", pa.int64())])
    chunks = [[{"kind": "event", "time": 10 * (20 * c + i), "wait": (7 * i) % 90} for i in range(20)] for c in range(150)]
    given = pa.RecordBatch.from_arrays([pa.array([1] * 150), pa.array(range(150)), pa.array(chunks, pa.list_(cell))], names=["track", "chunk", "rows"])
    made = list(spans._maps(20)(iter([given])))
    assert [b.num_rows for b in made] == [64, 64, 22]
    state, states = spans.START, []
    for c in chunks:
        states.append(state)
        side = spans.chunk_map(np.array([x["time"] for x in c]), np.array([x["wait"] for x in c]), 20)[state[0]]
        state = spans._through(state, [u for u, _ in side], [x for _, x in side])
    got = [s for b in spans._entries(iter(made)) for s in zip(b.column("on").to_pylist(), b.column("until").to_pylist(), strict=True)]
    assert got == states


def test_tokens_without_probability_are_not_sorted(monkeypatch):
    sizes, sort = [], np.argsort
    monkeypatch.setattr(generation.np, "argsort", lambda a, **k: (sizes.append(len(a)), sort(a, **k))[1])
    ok = generation.allowed(0, 0, set())
    for seed in range(20):
        logits = steady([[0]])[0] if seed % 2 else np.random.default_rng(seed).normal(size=V.VOCAB) * 400
        at = np.flatnonzero(ok)
        order = at[sort(-logits[at], kind="stable")]
        p = np.exp(logits[order] - logits[order[0]])
        assert generation.draw(logits, ok, 1.0, np.random.default_rng(seed)) == np.random.default_rng(seed).choice(order, p=p / p.sum())
    assert max(sizes) < len(at) and sizes[1] < 50
