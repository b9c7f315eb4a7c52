"""The committed sink of file trees, and files copied, moved and linked."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strophe import catalogue_more
from strophe.functions import vocab as V
from strophe.operators import codec, interleave, training
from strophe.plans import bind, scratch
from strophe.sources import files as tree
from strophe.sources import listing, midi


def names(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, found in os.walk(root) for f in found)


def contents(root):
    return {n: open(os.path.join(root, n), "rb").read() for n in names(root)}


def test_a_tree_is_written_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.range(0, 60, 1, 5).select(F.concat_ws("/", (F.col("id") % 4).cast("string"), F.concat(F.lit("f"), F.col("id").cast("string"))).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    bad = rows.withColumn("content", F.when(F.col("name") == "3/f59", F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="stop"):
        tree.write_tree(bad, root)
    assert names(root) == []
    tree.write_tree(rows, root)
    want = {f"{i % 4}/f{i}": str(i).encode() for i in range(60)}
    assert contents(root) == want and sorted(os.listdir(root)) == ["0", "1", "2", "3"]
    more = rows.limit(2).withColumn("content", F.lit("new").cast("binary")).unionByName(spark.createDataFrame([("z/x", bytearray(b"x"))], "name string, content binary"))
    tree.write_tree(more, root)  # what is there stays
    assert contents(root) == want | {"z/x": b"x"}
    tree.write_tree(more, root, overwrite=True)
    assert sum(c == b"new" for c in contents(root).values()) == 2
    listed = {r["name"]: r.bytes for r in tree.list_tree(spark, root).collect()}
    assert listed == {n: len(c) for n, c in contents(root).items()}
    tree.write_tree(rows.limit(0), str(tmp_path / "none"))
    for name in ("../up", "/top", ""):
        with pytest.raises(Exception, match="file"):
            tree.write_tree(spark.createDataFrame([(name, bytearray(b"x"))], "name string, content binary"), root)


@pytest.mark.parametrize("how", ["copy", "move", "link"])
def test_actions(spark, tmp_path, how):
    for n in "abc":
        (tmp_path / n).write_text(n)
    at = lambda n: f"file://{tmp_path}/{n}"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "there").write_text("old")
    rows = [(at("a"), at("t/x/a")), (at("b"), at("t/there")), (at("gone"), at("t/gone")), (at("c"), at("t/x/c")), (at("zzz"), at("t/x/c")), (None, at("t/none"))]
    df = spark.createDataFrame(rows, "source string, target string").repartition(3)
    want = ["written", "exists", "missing", "written", "exists", "missing"]
    got = {(r.source, r.target): r.status for r in tree.file_actions(df, how).collect()}
    assert [got[r] for r in rows] == want
    assert contents(tmp_path / "t") == {"there": b"old", "x/a": b"a", "x/c": b"c"}
    assert os.path.islink(tmp_path / "t/x/a") == (how == "link") and (tmp_path / "a").exists() == (how != "move")
    again = {(r.source, r.target): r.status for r in tree.file_actions(df, how).collect()}
    assert [again[r] for r in rows] == ["exists", "exists", "missing", "exists", "exists", "missing"]
    assert tree.file_actions(df.limit(0), how).count() == 0
    with pytest.raises(ValueError, match="copy, move, link"):
        tree.file_actions(df, "erase")


def test_errors_have_their_reason(spark, tmp_path):
    (tmp_path / "a").write_text("a")
    (tmp_path / "file").write_text("no folder")
    df = spark.createDataFrame([(f"{tmp_path}/a", f"{tmp_path}/file/under")], "source string, target string")
    assert tree.file_actions(df).first().status.startswith("error: ")


def test_only_the_files_asked_for_are_opened(spark, tmp_path):
    data = midi.encode([(0, True, 5, 60, 0), (10, False, 5, 60, 0)])
    held = {}
    for k, (split, digits) in enumerate((("train", "012"), ("valid", "e"), ("test", "f"))):
        for d in digits:
            for i in range(4):
                folder = tmp_path / "m" / split / d
                folder.mkdir(parents=True, exist_ok=True)
                md5 = d + f"{k}{i}" * 15 + "0"
                (folder / f"{md5}.mid").write_bytes(data if i else b"junk")
                held[split, d, md5] = len(data) if i else 4
    (tmp_path / "m/train/0/._x.mid").write_bytes(b"x")
    (tmp_path / "m/train/0/y.txt").write_bytes(b"x")
    root, log = str(tmp_path / "m"), tmp_path / "log"

    def run(where, read="content"):
        log.write_text("")
        rows = listing.read_tree(spark, root, read, 200, str(log)).where(where).collect()
        return rows, len(log.read_text().split())

    rows, opened = run("true")
    assert {(r.split, r.hex, r.md5): r.bytes for r in rows} == held and opened == len(held) == 20
    assert all(bytes(r.content) in (data, b"junk") and r.path.endswith(f"{r.split}/{r.hex}/{r.md5}.mid") for r in rows)
    some = sorted(held)[7][2]
    for where, n in (("split = 'test'", 4), ("split in ('test', 'valid') and hex = 'e'", 4), (f"md5 = '{some}'", 1), ("split = 'none'", 0), ("split = 'test' and bytes > 10", 3), ("hex = '1' or split = 'test'", 8)):
        rows, opened = run(where)
        assert len(rows) == n, where
        assert opened == {3: 4, 8: 20}.get(n, n), where  # what isn't about the place is looked at later
    rows, opened = run("split = 'train'", "counts")
    assert opened == 12 and sorted({(r.note_events, r.tracks) for r in rows}, key=str) == [(1, 2), (None, None)]
    assert run("hex = 'f'", "none")[1] == 0 and listing.read_tree(spark, root, "none", 200).rdd.getNumPartitions() > 3
    assert listing.read_tree(spark, str(tmp_path / "empty")).count() == 0


def test_tracks_are_dealt_once_from_notes_to_files_and_back(spark):
    rows = spark.createDataFrame([(t, p, "event", 10 * p, 5, 8 * (p % 3), 60 + p % 5) for t in range(3) for p in range(20)], "track long, pos long, kind string, time long, dur long, instr long, pitch long")
    rows = rows.repartition(7, "track")
    files = midi.write_files(codec.midi_schedule(rows))
    assert exchanges(files) == 1
    notes = codec.midi_notes(midi.decode(files.select(F.col("track").cast("string").alias("path"), "content")), 5)
    assert exchanges(notes) == 2 and notes.count() == 60 and notes.rdd.getNumPartitions() <= 5


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_decoded_files_come_in_small_batches(spark, monkeypatch):
    content = midi.encode([(t, on, 0, 60, 0) for t in range(20) for on in (True, False)])
    given = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(6)] + ["none"], "content": [content] * 6 + [b"x"]})
    monkeypatch.setattr(midi, "BATCH_ROWS", 10)
    assert [b.num_rows for b in midi.decoded(iter([given]), 100)] == [42] * 6 + [1]
    rows = midi.decode(spark.createDataFrame(given.to_pylist(), "path string, content binary"))
    assert rows.groupBy("path").count().count() == 7 and rows.where("type = 'bad'").count() == 1


def test_files_to_rename_are_dealt_by_number(spark, monkeypatch):
    plans = []
    real = midi.rename_tracks
    monkeypatch.setattr(bind, "TASK_ROWS", 500)
    monkeypatch.setattr(midi, "rename_tracks", lambda *given: plans.append(real(*given)) or plans[-1])
    d = "/root/testdata/sf0.001"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # many names, as those of a large tree
    try:
        rows = catalogue_more.renamed_tracks(spark, d)
        assert plans[0].rdd.getNumPartitions() == bind.parts(spark, d) > 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows.agg(F.sum("note_ons")).first()[0] == bind.read(spark, d, "lineitem").count()


def test_a_tasks_share_of_notes_does_not_grow(spark, monkeypatch):
    monkeypatch.setattr(bind, "TASK_ROWS", 500)
    d = "/root/testdata/sf0.001"
    notes = bind.notes(spark, d)
    assert bind.parts(spark, d) == -(-bind.read(spark, d, "lineitem").count() // 500) > 4
    assert notes.rdd.getNumPartitions() == bind.parts(spark, d) and exchanges(notes) == 1


def test_shares_stay_small_where_spark_would_put_partitions_together(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(bind, "TASK_ROWS", 500)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # more than the table's shares
    try:
        notes = bind.notes(spark, d)
        assert bind.parts(spark, d) == notes.rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = [bind.read(spark, d, t).count() for t in ("lineitem", "events")]
    assert bind.parts(spark, d, "lineitem", "events") == -(-sum(rows) // 500)


def test_tracks_stay_dealt_on_their_way_to_inter_arrival_rows(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(training, "stored", lambda df: plans.append(df) or scratch.stored(df))
    tokens = spark.range(4000).select((F.col("id") % 8).alias("track"), F.floor(F.col("id") / 8).alias("pos"), (F.col("id") % 900 + 1).alias("token")).repartition(16, "track")
    status = spark.range(7).select(F.col("id").alias("track"), F.lit(0).alias("status")).hint("merge")
    shards = spark.range(8).select(F.col("id").alias("track"), (F.col("id") % 2).alias("shard")).hint("merge")
    rows = training.tokenize_interarrival(tokens, status, shards, 10)
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in text and text.count(", 16)") == 2  # the tokens' own and the shards'; no other exchange behind the first
    assert text.index("Window") < text.index("REPARTITION_BY_NUM") and text[: text.index("Window")].count("Exchange ") == 0
    got = [(r.shard, t) for r in rows.orderBy("shard", "chunk").collect() for t in r.tokens]
    want = [(s, t) for s in (0, 1) for k in range(s, 7, 2) for t in [V.MIDI_SEPARATOR, *[(8 * p + k) % 900 + 1 for p in range(500)]]]
    assert got == [x for s in (0, 1) for x in [y for y in want if y[0] == s][: len([y for y in want if y[0] == s]) // 10 * 10]]


def test_draws_are_not_shuffled(spark):
    events = spark.createDataFrame([(t, p, 10 * p, 5, 0, 60) for t in range(2) for p in range(5)], "track long, pos long, time long, dur long, instr long, pitch long")
    heads = spark.createDataFrame([(t, 0, 40, [1, 2], [0]) for t in range(2)], "track long, shard int, end_time long, copies array<long>, parts array<long>")
    rows = interleave.interleaved(events, heads, {1: "span", 2: "random"}, "0", 2000)
    above = rows._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0]
    assert above.count("md5(") >= 2 and rows.select("track").distinct().count() == 4
