"""Queries of the library's own operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions import vocab as V
from strophe.operators import clips, codec, corpus, sampling, sequence, stats, training
from strophe.plans import bind
from strophe.plans.bind import FEED, FILES, NOTES
from strophe.plans.scratch import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COLS = "track, pos, kind, time, dur, instr, pitch"
GENRES = ("building", "machinery")
SCORE = 40
U = "(('0x' || substr(md5(concat_ws(':', {})), 1, 8))::BIGINT / 4294967296.0)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _marked(df: DataFrame) -> DataFrame:
    """Notes of instruments 0 and 8 as controls."""
    return sequence.to_controls(df, F.col("instr").isin(0, 8))


def _segments(df: DataFrame, every: int = 97) -> DataFrame:
    """Every 97th row as a separator."""
    sep = F.col("pos") % every == every - 1
    blank = {c: F.when(~sep, F.col(c)) for c in ("time", "dur", "instr", "pitch")}
    return df.withColumns(blank | {"kind": F.when(sep, "sep").otherwise(F.col("kind"))})


MARKED = f"{NOTES}, marked AS (SELECT track, pos, CASE WHEN instr IN (0, 8) THEN 'control' ELSE kind END AS kind, time, dur, instr, pitch FROM notes)"
SEGMENTS = f"{NOTES}, segs AS (SELECT track, pos, CASE WHEN s THEN 'sep' ELSE kind END AS kind, CASE WHEN NOT s THEN time END AS time, CASE WHEN NOT s THEN dur END AS dur, CASE WHEN NOT s THEN instr END AS instr, CASE WHEN NOT s THEN pitch END AS pitch, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY pos) AS seg FROM (SELECT *, pos % 97 = 96 AS s FROM notes))"


@query(f"WITH {NOTES} SELECT track, pos, kind, time, CASE WHEN time + dur > 4000 THEN 4000 - time ELSE dur END AS dur, instr, pitch FROM notes WHERE time BETWEEN 1000 AND 4000")
def clip(spark, d):
    return sequence.clip(bind.notes(spark, d), 10.0, 40.0)


@query(f"WITH {NOTES} SELECT {COLS} FROM notes WHERE time BETWEEN 1000 AND 4000")
def clip_no_trim(spark, d):
    return sequence.clip(bind.notes(spark, d), 1000, 4000, clip_duration=False, seconds=False)


@query(f"WITH {NOTES} SELECT {COLS} FROM notes WHERE NOT (time / 100.0 > 10.0 AND time / 100.0 < 90.0)")
def mask(spark, d):
    return sequence.mask(bind.notes(spark, d), 10.0, 90.0)


@query(f"WITH {NOTES} SELECT {COLS} FROM notes WHERE NOT instr = 128")
def delete_instr(spark, d):
    return sequence.delete(bind.notes(spark, d), F.col("instr") == V.DRUMS)


@query(f"WITH {MARKED} SELECT {COLS} FROM marked WHERE kind = 'event' AND instr IN (16, 24, 128)")
def keep_instr(spark, d):
    return sequence.keep_instruments(_marked(bind.notes(spark, d)), [16, 24, 128])


@query(f"WITH {NOTES}, t AS (SELECT track, pos, kind, time % 50 AS time, dur, instr, pitch FROM notes) SELECT track, row_number() OVER (PARTITION BY track ORDER BY time, pos) - 1 AS pos, kind, time, dur, instr, pitch FROM t")
def sort_stable(spark, d):
    return sequence.sort(bind.notes(spark, d).withColumn("time", F.col("time") % 50))


@query(f"WITH {MARKED} SELECT track, pos, kind, time, dur, instr, pitch FROM marked WHERE kind IN ('control', 'sep')")
def split_controls(spark, d):
    return sequence.split(_marked(bind.notes(spark, d)))[1]


_PAD = """{src}, g AS (SELECT track, pos, time, coalesce(lag(time) OVER (PARTITION BY track ORDER BY pos), 0) AS prev FROM {of}),
t AS (SELECT track, pos, time, prev FROM g UNION ALL SELECT track, max(pos) + 1, {end}, max_by(time, pos) FROM {of} GROUP BY track),
r AS (SELECT track, pos, prev, unnest(range(1, CAST(greatest(0, floor((time - prev - 1) / {density}.0)) AS BIGINT) + 1)) AS j FROM t),
a AS (SELECT track, pos, j, 'rest' AS kind, prev + j * {density} AS time, CAST(0 AS BIGINT) AS dur, CAST(NULL AS BIGINT) AS instr, CAST(NULL AS BIGINT) AS pitch FROM r
  UNION ALL SELECT track, pos, 1073741824, kind, time, dur, instr, pitch FROM {of})
SELECT track, row_number() OVER (PARTITION BY track ORDER BY pos, j) - 1 AS pos, kind, time, dur, instr, pitch FROM a"""


@query("WITH " + _PAD.format(src=NOTES, of="notes", end=10000, density=20))
def pad(spark, d):
    return sequence.pad(bind.notes(spark, d), 10000, 20)


@query("WITH " + _PAD.format(src=FEED, of="feed", end=9000, density=100))
def pad_feed(spark, d):
    return sequence.pad(bind.feed(spark, d), 9000, 100)


@query(f"WITH {NOTES} SELECT {COLS} FROM notes")
def unpad(spark, d):
    return sequence.sort(sequence.unpad(sequence.pad(bind.notes(spark, d), 10000, 20)))


_KEYED = f"""WITH {MARKED}, k AS (SELECT *, CASE WHEN kind = 'control' THEN time - 500 ELSE coalesce(lag(time) OVER (PARTITION BY track, kind = 'control' ORDER BY pos), 0) END AS key FROM marked),
o AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY key, CASE WHEN kind = 'control' THEN 0 ELSE 1 END, pos) AS ord FROM k),
e AS (SELECT *, coalesce(max(CASE WHEN kind <> 'control' THEN ord END) OVER (PARTITION BY track), 0) AS fin FROM o)"""


@query(f"{_KEYED} SELECT track, row_number() OVER (PARTITION BY track ORDER BY ord) - 1 AS pos, kind, time, dur, instr, pitch FROM e WHERE kind <> 'control' OR ord <= fin")
def anticipate(spark, d):
    return sequence.anticipate(_marked(bind.notes(spark, d)))[0]


_LATE = _KEYED.replace(MARKED, MARKED.replace("kind END AS kind, time,", "kind END AS kind, CASE WHEN instr IN (0, 8) THEN time * 2 ELSE time END AS time,"))


@query(f"{_LATE} SELECT {COLS} FROM e WHERE kind = 'control' AND ord > fin")
def anticipate_leftover(spark, d):
    rows = _marked(bind.notes(spark, d))
    return sequence.anticipate(rows.withColumn("time", F.when(F.col("kind") == "control", F.col("time") * 2).otherwise(F.col("time"))))[1]


@query(f"WITH {SEGMENTS} SELECT track, pos, kind, CASE WHEN seg = 0 AND kind <> 'sep' THEN time + 700 ELSE time END AS time, dur, instr, pitch FROM segs")
def translate(spark, d):
    return sequence.translate(_segments(bind.notes(spark, d)), 700)


@query(f"WITH {MARKED} SELECT track, row_number() OVER (PARTITION BY track ORDER BY time, CASE WHEN kind = 'control' THEN 1 ELSE 0 END, pos) - 1 AS pos, 'event' AS kind, time, dur, instr, pitch FROM marked")
def combine(spark, d):
    return sequence.combine(*sequence.split(_marked(bind.notes(spark, d))))


@query(f"WITH {SEGMENTS} SELECT track, greatest(max(gap), 0) AS sparsity FROM (SELECT track, time - coalesce(lag(time) OVER (PARTITION BY track ORDER BY pos), 0) AS gap FROM segs WHERE kind <> 'sep') GROUP BY track")
def sparsity(spark, d):
    return sequence.sparsity(_segments(bind.notes(spark, d)))


@query(f"WITH {SEGMENTS} SELECT track, coalesce(min(CASE WHEN seg = 0 THEN time END), 0) AS min_time FROM segs GROUP BY track")
def min_time(spark, d):
    return sequence.min_time(_segments(bind.notes(spark, d)))


@query(f"WITH {SEGMENTS} SELECT track, greatest(coalesce(max(time), 0), 0) AS max_time FROM segs GROUP BY track")
def max_time(spark, d):
    return sequence.max_time(_segments(bind.notes(spark, d)))


@query(f"WITH p AS (WITH {_PAD.format(src=MARKED, of='marked', end=10000, density=20)}) SELECT track, CASE WHEN kind = 'rest' THEN 129 ELSE instr END AS instr, count(*) AS n, min(pos) AS first FROM p GROUP BY ALL")
def instrument_counts(spark, d):
    """Of events, controls and rests together."""
    return sequence.instruments(sequence.pad(_marked(bind.notes(spark, d)), 10000, 20))


@query(f"WITH {NOTES} SELECT track, min(time) / 100.0 AS first_onset, max(time + dur) / 100.0 AS last_end FROM notes GROUP BY track")
def note_ends(spark, d):
    return sequence.note_end(bind.notes(spark, d))


_CLAMP = "CASE WHEN dur = -1 THEN 25 ELSE least(dur, 999) END"


@query(f"WITH {MARKED} SELECT track, pos, CAST([time + s, {_CLAMP} + 10000 + s, 11000 + 128 * instr + pitch + s] AS INT[]) AS tokens FROM (SELECT *, CASE WHEN kind = 'control' THEN 27513 ELSE 0 END AS s FROM marked)")
def encode_events(spark, d):
    return sequence.encode_events(_marked(bind.notes(spark, d)))


@query(f"WITH {MARKED} SELECT track, pos, kind, time, {_CLAMP} AS dur, instr, pitch FROM marked")
def decode_events(spark, d):
    return sequence.decode_events(sequence.encode_events(_marked(bind.notes(spark, d))))


@query(f"WITH {NOTES} SELECT track, count(*) FILTER (WHERE dur >= 1000) AS truncated FROM notes GROUP BY track")
def dur_truncations(spark, d):
    return sequence.truncations(bind.notes(spark, d))


@query(f"""WITH {SEGMENTS}, e AS (SELECT track, seg, max(time + dur) AS fin FROM segs WHERE kind <> 'sep' GROUP BY track, seg),
h AS (SELECT track, seg, CAST(coalesce(sum(fin) OVER (PARTITION BY track ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM e)
SELECT s.track, pos, kind, time + shift AS time, dur, instr, pitch FROM segs s JOIN h ON h.track = s.track AND h.seg = s.seg WHERE kind <> 'sep'""")
def segment_stack(spark, d):
    return sequence.stack_segments(_segments(bind.notes(spark, d)))


@query(f"WITH {NOTES} SELECT track, pos, kind, CAST(round_even(time * CAST(1.37 AS DOUBLE), 0) AS BIGINT) AS time, CAST(round_even(dur * CAST(1.37 AS DOUBLE), 0) AS BIGINT) AS dur, instr, pitch FROM notes")
def rescale(spark, d):
    return sequence.rescale(bind.notes(spark, d), 1.37)


@query(f"""WITH {NOTES}, q AS (SELECT track, pos, kind, CAST(round_even(time / 12.0, 0) * 12 AS BIGINT) AS time, greatest(CAST(round_even(dur / 12.0, 0) * 12 AS BIGINT), 12) AS dur, instr, pitch FROM notes)
SELECT track, row_number() OVER (PARTITION BY track ORDER BY time, pos) - 1 AS pos, kind, time, dur, instr, pitch FROM q""")
def quantize_grid(spark, d):
    return sequence.quantize(bind.notes(spark, d), 120, 16)


@query(f"WITH {NOTES} SELECT track, pos, CAST(floor(time / 100.0 * 2.0 / 4) + 1 AS BIGINT) AS bar, CAST(floor((time / 100.0 * 2.0) % 4) + 1 AS BIGINT) AS beat FROM notes")
def bar_beat(spark, d):
    bar, beat = V.seconds_to_bar_beat(F.col("time") / 100.0, 120, 4)
    return bind.notes(spark, d).select("track", "pos", bar.cast("long").alias("bar"), beat.cast("long").alias("beat"))


@query(f"""WITH {MARKED}, b AS (SELECT track, CASE WHEN kind = 'control' THEN 'control_order' ELSE 'event_order' END AS violation, time % 1000 AS time, max(time % 1000) OVER (PARTITION BY track, kind ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM marked),
n AS (SELECT track, kind, time % 1000 AS time, first(CASE WHEN kind <> 'control' THEN time % 1000 END IGNORE NULLS) OVER (PARTITION BY track ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM marked)
SELECT track, violation, count(*) AS n FROM b WHERE time < high GROUP BY track, violation
UNION ALL SELECT track, 'late_control', count(*) FROM n WHERE kind = 'control' AND time > nx + 500 GROUP BY track
UNION ALL SELECT track, 'instruments', count(DISTINCT instr) FROM marked GROUP BY track HAVING count(DISTINCT instr) > 16""")
def integrity_violations(spark, d):
    return sequence.integrity(_marked(bind.notes(spark, d)).withColumn("time", F.col("time") % 1000))


def _messages(df: DataFrame) -> DataFrame:
    """Notes as messages: every third of a key is an off."""
    return df.select("track", "pos", "time", (F.col("dur") % 3 != 0).alias("on"), (F.col("instr") % 3).alias("instr"), (F.col("pitch") % 8).alias("pitch"), F.lit(0).alias("channel"))


MESSAGES = f"{NOTES}, msg AS (SELECT track, pos, time, dur % 3 <> 0 AS is_on, instr % 3 AS instr, pitch % 8 AS pitch FROM notes)"


@query(f"""WITH {MESSAGES}, s AS (SELECT *, sum(CASE WHEN is_on THEN 1 ELSE -1 END) OVER (PARTITION BY track, instr, pitch ORDER BY pos) AS s FROM msg),
l AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY track, instr, pitch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY track, instr, pitch, is_on ORDER BY pos) AS k FROM l WHERE is_on OR s >= low)
SELECT a.track, row_number() OVER (PARTITION BY a.track ORDER BY a.pos) - 1 AS pos, 'event' AS kind, a.time, coalesce(b.time - a.time, -1) AS dur, a.instr, a.pitch
FROM r a LEFT JOIN r b ON NOT b.is_on AND a.track = b.track AND a.instr = b.instr AND a.pitch = b.pitch AND a.k = b.k WHERE a.is_on""")
def note_pairing(spark, d):
    return codec.pair_notes(_messages(bind.notes(spark, d)))


@query(f"""WITH {MESSAGES}, t AS (SELECT track, pos, least(time - coalesce(lag(time) OVER (PARTITION BY track ORDER BY pos), 0), 999) AS delta, CASE WHEN is_on THEN 1000 ELSE 17512 END + 128 * instr + pitch AS note FROM msg),
u AS (SELECT track, pos, 0 AS j, delta AS token FROM t WHERE delta > 0 UNION ALL SELECT track, pos, 1, note FROM t)
SELECT track, row_number() OVER (PARTITION BY track ORDER BY pos, j) - 1 AS pos, token FROM u""")
def interarrival(spark, d):
    return codec.interarrival(_messages(bind.notes(spark, d)))


@query(f"""WITH {NOTES}, m AS (SELECT track, pos AS src, instr, pitch, time AS tm, 0 AS t FROM notes UNION ALL SELECT track, pos, instr, pitch, time + dur, 1 FROM notes),
o AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY tm, t, src) - 1 AS pos FROM m),
f AS (SELECT track, instr, min(pos) AS first FROM o WHERE t = 0 GROUP BY track, instr),
c AS (SELECT track, instr, first, CASE WHEN instr = 128 THEN 9 WHEN r >= 9 THEN r + 1 ELSE r END AS channel FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY first) - 1 AS r FROM f))
SELECT o.track, o.pos, o.tm AS time, o.t = 0 AS "on", o.instr, o.pitch, c.channel, o.tm - coalesce(lag(o.tm) OVER (PARTITION BY o.track, o.instr ORDER BY o.pos), 0) AS delta FROM o JOIN c ON c.track = o.track AND c.instr = o.instr WHERE o.t = 0 OR o.pos > c.first""")
def midi_schedule(spark, d):
    return codec.midi_schedule(bind.notes(spark, d))


_GATE = "CASE WHEN n < 100 OR fin < 1000 THEN 1 WHEN fin > 360000 THEN 2 WHEN k > 16 THEN 3 ELSE 0 END"
_GATES = f"{NOTES}, {FEED}, both_ AS (SELECT track, time, instr FROM notes UNION ALL SELECT track + 1000000, time, instr FROM feed), g AS (SELECT track, count(*) AS n, max(time) AS fin, count(DISTINCT instr) AS k FROM both_ GROUP BY track)"


def _both(spark: SparkSession, d: str) -> DataFrame:
    return bind.notes(spark, d).unionByName(bind.feed(spark, d).withColumn("track", F.col("track") + 1000000))


@query(f'WITH {_GATES} SELECT track, n, fin AS "end", {_GATE} AS status FROM g')
def gate_status(spark, d):
    return training.gate(_both(spark, d))


@query(f"WITH {_GATES}, s AS (SELECT {_GATE} AS status, n FROM g) SELECT status, count(*) AS n, CAST(sum(n) AS BIGINT) AS events, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY status")
def gate_report(spark, d):
    return stats.gate_report(training.gate(_both(spark, d)))


@query(f"WITH {NOTES} SELECT track, pos, CASE WHEN {U.format(chr(39) + '0' + chr(39) + ', ' + chr(39) + 'random' + chr(39) + ', track, pos')} < 0.4 THEN 'control' ELSE kind END AS kind, time, dur, instr, pitch FROM notes")
def extract_random(spark, d):
    return training.extract_random(bind.notes(spark, d), 4)


@query(f"WITH {MARKED} SELECT {COLS} FROM marked")
def extract_instruments(spark, d):
    return _marked(bind.notes(spark, d))


_WAIT = f"w AS (SELECT *, CAST(floor(-ln(1 - {U.format(chr(39) + '0' + chr(39) + ', ' + chr(39) + 'span' + chr(39) + ', track, pos')}) * 2000) AS BIGINT) AS wait FROM notes)"


#: An event that leaves a span, the one that begins the next at or past the time drawn there, and the one that leaves that.
@query(f"""WITH RECURSIVE {NOTES}, {_WAIT}, turns(track, n, pos, time, begins) AS (
  SELECT track, 0, pos, time + wait, false FROM w WHERE pos = 0
  UNION ALL SELECT track, n + 1, f.pos, CASE WHEN begins THEN f.time + f.wait ELSE f.time + 500 END, NOT begins
    FROM (SELECT t.track, t.n, t.begins, min(struct_pack(pos := w.pos, time := w.time, wait := w.wait)) AS f FROM turns t JOIN w ON w.track = t.track AND w.pos >= t.pos AND w.time >= t.time GROUP BY ALL)),
s AS (SELECT track, pos AS a, begins, lead(pos) OVER (PARTITION BY track ORDER BY n) AS b FROM turns),
h AS (SELECT track, a, coalesce(b, 1000000000) AS b FROM s WHERE begins)
SELECT n.track, n.pos, CASE WHEN h.track IS NULL THEN n.kind ELSE 'control' END AS kind, n.time, n.dur, n.instr, n.pitch FROM notes n LEFT JOIN h ON h.track = n.track AND n.pos >= h.a AND n.pos < h.b""")
def extract_spans(spark, d):
    return training.extract_spans(bind.notes(spark, d), 2000)


@query("SELECT l_suppkey AS track, k, CASE WHEN k % 10 = 0 THEN 'none' WHEN k % 10 = 1 THEN 'span' WHEN k % 10 < 6 THEN 'random' ELSE 'instrument' END AS mode FROM (SELECT DISTINCT l_suppkey FROM lineitem), (SELECT unnest(range(0, 10)) AS k)")
def augment_fanout(spark, d):
    return training.augment(bind.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("track")).distinct(), 10).select("track", "k", "mode")


def _packable(spark: SparkSession, d: str, scale: int = 1) -> tuple[DataFrame, DataFrame]:
    rows = training.with_separator(sequence.anticipate(_marked(bind.notes(spark, d)))[0]).withColumn("shard", F.col("track") % 4)
    rows = rows.withColumn("dur", V.clamp_dur(F.col("dur"))).withColumn("time", F.col("time") * scale)
    flags = bind.notes(spark, d).select((F.col("track") % 4).alias("shard"), "track").distinct().withColumn("flag", F.when(F.col("track") % 3 == 0, V.AUTOREGRESS).otherwise(V.ANTICIPATE))
    return rows, flags


def _pack_sql(scale: int) -> str:
    return f"""{_KEYED}, seq AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY ord) AS pos, kind, time * {scale} AS time, {_CLAMP} AS dur, instr, pitch FROM e WHERE kind <> 'control' OR ord <= fin
  UNION ALL SELECT DISTINCT track, 0, 'sep', NULL, NULL, NULL, NULL FROM marked),
p AS (SELECT *, track % 4 AS shard, CASE WHEN track % 3 = 0 THEN 55026 ELSE 55027 END AS flag, row_number() OVER (PARTITION BY track % 4 ORDER BY track, pos) - 1 AS p FROM seq),
q AS (SELECT *, p // 341 AS chunk, p % 341 AS q, count(*) OVER (PARTITION BY shard, p // 341) AS n, sum(CASE WHEN kind = 'sep' THEN 1 ELSE 0 END) OVER (PARTITION BY shard, p // 341 ORDER BY p) AS seg FROM p),
m AS (SELECT *, coalesce(min(CASE WHEN seg = 0 THEN time END) OVER (PARTITION BY shard, chunk), 0) AS start FROM q WHERE n = 341),
r AS (SELECT shard, chunk, q, kind, flag, start, CASE WHEN seg = 0 THEN time - start ELSE time END AS time, dur, instr, pitch, CASE WHEN kind = 'control' THEN 27513 ELSE 0 END AS s FROM m),
c AS (SELECT shard, chunk, max(start) AS start, coalesce(max(time), 0) >= 10000 AS discarded, max(CASE WHEN q = 0 THEN flag END) AS own, bool_or(q = 0 AND kind = 'sep') AS heads,
  flatten(list(CASE WHEN kind = 'sep' THEN [55025, 55025, 55025] ELSE [time + s, dur + 10000 + s, 11000 + 128 * instr + pitch + s] END ORDER BY q)) AS toks FROM r GROUP BY shard, chunk),
f AS (SELECT *, CASE WHEN heads OR NOT coalesce(lag(discarded) OVER (PARTITION BY shard ORDER BY chunk), FALSE) THEN own END AS z FROM c),
packed AS (SELECT shard, chunk, last_value(z IGNORE NULLS) OVER (PARTITION BY shard ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flag, start, discarded, toks FROM f)"""


@query(_pack_sql(1) + " SELECT shard, chunk, flag, list_prepend(flag, toks)::INT[] AS tokens FROM packed WHERE NOT discarded")
def pack_rows(spark, d):
    return training.pack(*_packable(spark, d)).where("not discarded").select("shard", "chunk", "flag", "tokens")


@query(_pack_sql(8) + " SELECT shard, chunk, flag, start, discarded FROM packed")
def pack_flags(spark, d):
    return training.pack(*_packable(spark, d, 8)).select("shard", "chunk", "flag", "start", "discarded")


@query(f"""WITH {_GATES}, st AS (SELECT track FROM g WHERE {_GATE} = 0), all_ AS (SELECT track, pos, time, dur, instr, pitch FROM notes UNION ALL SELECT track + 1000000, pos, time, dur, instr, pitch FROM feed),
msg AS (SELECT track, pos, time, dur % 3 <> 0 AS is_on, instr % 3 AS instr, pitch % 8 AS pitch FROM all_ WHERE track IN (SELECT track FROM st)),
t AS (SELECT track, pos, least(time - coalesce(lag(time) OVER (PARTITION BY track ORDER BY pos), 0), 999) AS delta, CASE WHEN is_on THEN 1000 ELSE 17512 END + 128 * instr + pitch AS note FROM msg),
u AS (SELECT track, pos, 0 AS j, delta AS token FROM t WHERE delta > 0 UNION ALL SELECT track, pos, 1, note FROM t UNION ALL SELECT track, -1, 0, 34024 FROM st),
p AS (SELECT track % 4 AS shard, token, row_number() OVER (PARTITION BY track % 4 ORDER BY track, pos, j) - 1 AS p FROM u) SELECT shard, p // 1024 AS chunk, list(token ORDER BY p) AS tokens FROM p GROUP BY shard, p // 1024 HAVING count(*) = 1024""")
def pack_interarrival(spark, d):
    both = _both(spark, d)
    shards = both.select("track", (F.col("track") % 4).alias("shard")).distinct()
    dealt = both.repartition(bind.parts(spark, d, "lineitem", "events"), "track")
    return training.tokenize_interarrival(codec.interarrival(_messages(dealt)), training.gate(both), shards)


_ANY = f"len(list_filter(nomml, lambda n: n >= {SCORE})) > 0"
_GENRE = "len(list_filter(styles, lambda s: lower(s) IN ('building', 'machinery'))) > 0"


@query(f"WITH {FILES} SELECT md5, {_ANY} AS expressive, num_tracks BETWEEN 1 AND 16 AS in_range FROM files")
def expressive_filter(spark, d):
    return bind.files(spark, d).select("md5", corpus.expressive(F.col("nomml"), SCORE).alias("expressive"), corpus.track_range(F.col("num_tracks")).alias("in_range"))


@query(f"WITH {FILES} SELECT md5 FROM files WHERE {_GENRE}")
def genre_filter(spark, d):
    return bind.files(spark, d).where(corpus.genre(F.col("styles"), None, GENRES)).select("md5")


def _subset(name: str, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return corpus.subset(bind.files(spark, d), name, SCORE, GENRES).select("md5", "num_tracks", "total_notes")

    run.__name__ = f"subset_{name}"
    pick = f"WITH {FILES}, r AS (SELECT * FROM files WHERE {where})"
    f = corpus.SUBSET_FRACTION.get(name)
    limit = f", h AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || md5), md5) AS k, count(*) OVER () AS n FROM r) SELECT md5, num_tracks, total_notes FROM h WHERE k <= CAST(floor(n * {f}) AS BIGINT)" if f else " SELECT md5, num_tracks, total_notes FROM r"
    query(pick + limit)(run)


for _name, _where in {"s1": "TRUE", "s2": f"num_tracks BETWEEN 1 AND 16 AND {_ANY}", "s3": "TRUE", "s4": f"num_tracks BETWEEN 1 AND 16 AND {_ANY}", "s8": _GENRE, "s11": f"{_GENRE} AND {_ANY}"}.items():
    _subset(_name, _where)


@query("SELECT md5(CAST(o_orderkey AS VARCHAR)) AS md5, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) AS hex, CASE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) WHEN 'e' THEN 'valid' WHEN 'f' THEN 'test' ELSE 'train' END AS split FROM orders")
def hash_split(spark, d):
    m = F.md5(F.col("o_orderkey").cast("string"))
    return bind.read(spark, d, "orders").select(m.alias("md5"), corpus.hex_shard(m).alias("hex"), corpus.hash_split(m).alias("split"))


@query(f"WITH {FILES}, r AS (SELECT md5, substr(md5, 1, 1) AS hex FROM files), k AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY md5('42:' || md5), md5) AS k, count(*) OVER (PARTITION BY hex) AS n FROM r) SELECT md5, hex FROM k WHERE k <= greatest(1, floor(n * 0.05))")
def stratified_sample(spark, d):
    return corpus.stratified_sample(bind.files(spark, d).select("md5", corpus.hex_shard(F.col("md5")).alias("hex")), "hex", "md5", 0.05)


@query("SELECT o_orderkey, o_custkey FROM orders")
def global_shuffle(spark, d):
    return corpus.global_shuffle(bind.read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_targets(spark, d):
    wanted = bind.read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return bind.read(spark, d, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_existing(spark, d):
    return bind.read(spark, d, "customer").join(bind.read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set_intersect(spark, d):
    part = lambda f: bind.read(spark, d, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return part("R").intersect(part("A"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7")
def set_except(spark, d):
    return bind.read(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(bind.read(spark, d, "lineitem").where("l_returnflag = 'R' and l_linenumber = 7").select("l_partkey"))


@query("""SELECT CASE WHEN x.k IS NOT NULL THEN 'skipped' WHEN l.k IS NOT NULL THEN 'found' ELSE 'missing' END AS status, count(*) AS n FROM part
LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') l ON l.k = p_partkey LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linenumber = 7) x ON x.k = p_partkey GROUP BY 1""")
def copy_status(spark, d):
    li = bind.read(spark, d, "lineitem").withColumn("md5", F.col("l_partkey"))
    wanted = bind.read(spark, d, "part").select(F.col("p_partkey").alias("md5"))
    return corpus.with_status(wanted, li.where("l_returnflag = 'R'"), li.where("l_linenumber = 7")).groupBy("status").agg(F.count("*").alias("n"))


ZIPPED = f"{FILES}, z AS (SELECT md5, unnest(groups) AS grp, unnest(list_filter(nomml, lambda n: n <> -1)) AS s FROM files), counts AS (SELECT md5, grp, count(*) AS n FROM z WHERE s >= {SCORE} GROUP BY md5, grp), avail AS (SELECT grp, CAST(sum(n) AS BIGINT) AS tracks, count(DISTINCT md5) AS files FROM counts GROUP BY grp)"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.zip_groups(bind.files(spark, d), SCORE)


@query(f"WITH {ZIPPED} SELECT md5, grp, n FROM counts")
def zip_groups(spark, d):
    return _counts(spark, d)


@query(f"WITH {ZIPPED} SELECT md5, total_notes FROM files WHERE total_notes >= 50 AND {_ANY} AND len(groups) > 0 AND md5 IN (SELECT md5 FROM counts)")
def balanced_gate(spark, d):
    return corpus.balanced_gate(bind.files(spark, d), 50, SCORE).select("md5", "total_notes")


@query(f"WITH {ZIPPED} SELECT grp, tracks, files FROM avail")
def group_available(spark, d):
    return corpus.group_available(_counts(spark, d))


@query(f"""WITH {ZIPPED}, a AS (SELECT md5, bool_or(grp NOT IN ('STANDARD', 'MEDIUM', 'PROMO')) AS o, bool_or(grp = 'STANDARD') AS a, bool_or(grp = 'MEDIUM') AS b FROM counts GROUP BY md5)
SELECT md5, CASE WHEN o THEN 'other' WHEN a AND b THEN 'first+second' WHEN a THEN 'first-only' WHEN b THEN 'second-only' ELSE 'third-only' END AS category FROM a""")
def file_category(spark, d):
    return corpus.file_category(_counts(spark, d), bind.BIG)


_SHARE = "tracks / sum(tracks) OVER ()"
_TARGET = {
    "b": "CASE WHEN grp IN ('STANDARD', 'MEDIUM', 'PROMO') THEN 100.0 ELSE tracks * 0.1 END",
    "c1": "least(floor(min(tracks) OVER () * 0.1), tracks)",
    "c2": "tracks * 0.1",
    "c3": "sum(tracks) OVER () * sqrt(tracks) / sum(sqrt(tracks)) OVER ()",
    "c4": "all_ * ln(1 + 100.0 * tracks / all_) / sum(ln(1 + 100.0 * tracks / all_)) OVER ()",
    "c5": f"sum(tracks) OVER () * (0.25 * {_SHARE} + 0.75 / count(*) OVER ())",
    "c6": "least(floor(all_ * 0.1) + floor((all_ - floor(all_ * 0.1) * count(*) OVER ()) * tracks / all_ + 1e-9), tracks)",
}
_AVAIL = "(SELECT *, sum(tracks) OVER () AS all_ FROM avail)"


def _targets(spark: SparkSession, d: str, strategy: str, available: DataFrame | None = None) -> DataFrame:
    return corpus.targets(corpus.group_available(_counts(spark, d)) if available is None else available, strategy, 10, bind.BIG, 100)


def _target_query(strategy: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _targets(spark, d, strategy)

    run.__name__ = f"targets_{strategy}"
    query(f"WITH {ZIPPED} SELECT grp, tracks, CAST(floor(({_TARGET[strategy]}) + 1e-9) AS BIGINT) AS target FROM {_AVAIL}")(run)


for _name in _TARGET:
    _target_query(_name)

_ALL_TARGETS = " UNION ALL ".join(f"SELECT '{s}' AS strategy, grp, tracks, CAST(floor(({e}) + 1e-9) AS BIGINT) AS target FROM {_AVAIL}" for s, e in _TARGET.items())


def _every_target(spark: SparkSession, d: str) -> DataFrame:
    out, available = None, stored(corpus.group_available(_counts(spark, d)))  # a row a group: the files are read once for all strategies
    for s in _TARGET:
        part = _targets(spark, d, s, available).withColumn("strategy", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {ZIPPED}, t AS ({_ALL_TARGETS}), h AS (SELECT *, 100.0 * target / sum(target) OVER (PARTITION BY strategy) AS share FROM t),
a AS (SELECT strategy, bool_and(target <= tracks) AS feasible, round(max(share) - min(share), 6) AS spread FROM h GROUP BY strategy)
SELECT strategy, feasible, spread, row_number() OVER (ORDER BY spread, strategy) AS place FROM a""")
def feasible_rank(spark, d):
    return corpus.feasible(_every_target(spark, d))


@query()
def greedy_select(spark, d):
    return corpus.select_balanced(spark, _counts(spark, d), bind.files(spark, d), _targets(spark, d, "c2"), bind.BIG)


@query()
def calibrate(spark, d):
    goal = bind.read(spark, d, "lineitem").agg(F.floor(F.sum(F.col("l_quantity").cast("long")) / 20).alias("goal"))
    return corpus.calibrate(spark, _counts(spark, d), bind.files(spark, d), _targets(spark, d, "c2"), bind.BIG, goal)


@query("""WITH l AS (SELECT p_type AS grp, CAST(l_quantity AS BIGINT) AS v FROM lineitem JOIN part ON p_partkey = l_partkey), s AS (SELECT grp, list_sort(list(v)) AS x, count(*) AS n FROM l GROUP BY grp)
SELECT grp, n, round(list_avg(x), 6) AS mean, x[1] AS low, x[n // 4 + 1] AS p25, x[n // 2 + 1] AS median, x[3 * n // 4 + 1] AS p75, x[n] AS high FROM s""")
def group_quantiles(spark, d):
    part = bind.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("grp"))
    return stats.group_quantiles(bind.read(spark, d, "lineitem").join(part, "l_partkey").select("grp", F.col("l_quantity").cast("long").alias("v")), "grp", "v")


@query("SELECT bin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 20 THEN 2 WHEN l_quantity >= 5 THEN 1 WHEN l_quantity >= 1 THEN 0 END AS bin FROM lineitem) WHERE bin IS NOT NULL GROUP BY bin")
def histogram_bins(spark, d):
    return stats.histogram(bind.read(spark, d, "lineitem"), "l_quantity", [1, 5, 20, 40])


@query(f"WITH {ZIPPED}, t AS (SELECT sum(tracks) AS t, sum(CASE WHEN grp IN ('STANDARD', 'MEDIUM', 'PROMO') THEN tracks ELSE 0 END) AS b FROM avail) SELECT round(100.0 * b / t, 6) AS big_share, round(100.0 - 100.0 * b / t, 6) AS other_share FROM t")
def big3_share(spark, d):
    return stats.share_of(corpus.group_available(_counts(spark, d)), "grp", "tracks", bind.BIG)


@query("""WITH f AS (SELECT p_type AS grp, count(*) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), s AS (SELECT p_type AS grp, count(*) AS v FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 40 GROUP BY 1),
p AS (SELECT coalesce(f.grp, s.grp) AS grp, coalesce(100.0 * s.v / (SELECT sum(v) FROM s), 0) AS a, coalesce(100.0 * f.v / (SELECT sum(v) FROM f), 0) AS b FROM f FULL JOIN s ON f.grp = s.grp)
SELECT grp, round(a, 6) AS subset_share, round(b, 6) AS full_share, round(a - b, 6) AS delta FROM p""")
def compare_shares(spark, d):
    part = bind.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("grp"))
    rows = bind.read(spark, d, "lineitem").join(part, "l_partkey").withColumn("v", F.lit(1))
    return stats.compare_shares(rows.where("l_quantity >= 40"), rows, "grp", "v")


@query(_pack_sql(1) + """, t AS (SELECT len(list_filter(list_prepend(flag, toks), lambda x: x <> 55025)) AS n FROM packed WHERE NOT discarded)
SELECT count(*) AS lines, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n // 3) AS BIGINT) AS events, round(sum(n // 3) / (663555310 / 8943), 9) AS hours FROM t""")
def token_stats(spark, d):
    return stats.token_stats(training.pack(*_packable(spark, d)).where("not discarded"))


@query(f"""WITH {_GATES}, u AS (SELECT track, pos, time, dur FROM notes UNION ALL SELECT track + 1000000, pos, time, dur FROM feed),
l AS (SELECT track, 3 * count(*) AS tokens, max_by(time + dur, pos) AS last, max(time + dur) AS most FROM u GROUP BY track)
SELECT {_GATE} AS status, count(*) AS tracks, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(last) / 100.0, 2) AS seconds_last, round(sum(most) / 100.0, 2) AS seconds_max FROM l JOIN g ON g.track = l.track GROUP BY 1""")
def compound_stats(spark, d):
    both = _both(spark, d)
    return stats.compound_stats(both, training.gate(both))


@query("""WITH l AS (SELECT l_linenumber AS i, l_discount * 10 AS ce FROM lineitem)
SELECT round(avg(ce), 6) AS loss, round(avg(ce) * log2(exp(1)) * count(*) / 3600, 6) AS bps, round(exp(3 * avg(ce)), 3) AS event_ppl, round(exp(avg(ce) FILTER (WHERE i % 3 = 0)), 3) AS onset_ppl,
  round(exp(avg(ce) FILTER (WHERE i % 3 = 1)), 3) AS dur_ppl, round(exp(avg(ce) FILTER (WHERE i % 3 = 2)), 3) AS note_ppl FROM l""")
def loss_metrics(spark, d):
    return stats.loss_metrics(bind.read(spark, d, "lineitem").select(F.col("l_linenumber").alias("i"), (F.col("l_discount") * 10).alias("ce")), 1.0)


@query("SELECT count(*) AS n, round(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) * 1000000 / count(*), 6) AS total FROM lineitem")
def extrapolate(spark, d):
    return stats.extrapolate(bind.read(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("q")), "q", 1_000_000)


@query("SELECT l_linenumber AS parts, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY l_linenumber")
def timing_stats(spark, d):
    return stats.timings(bind.read(spark, d, "lineitem").withColumn("parts", F.col("l_linenumber")), "parts", "l_quantity")


_MELODY = "melody AS (SELECT track, instr FROM (SELECT track, instr, row_number() OVER (PARTITION BY track ORDER BY sum(pitch) / count(*) DESC, min(pos)) AS r, sum(pitch) AS s FROM notes WHERE instr NOT IN (0, 9) AND instr < 112 GROUP BY track, instr) WHERE r = 1 AND s > 0)"


@query(f"WITH {NOTES}, {_MELODY} SELECT track, instr FROM melody")
def melody_argmax(spark, d):
    return stats.melody_instrument(bind.notes(spark, d))


_QUOTED = "'0', 'clip', track"
WINDOWS = f"""{NOTES}, ends AS (SELECT track, greatest(max(time), 0) AS fin FROM notes GROUP BY track HAVING greatest(max(time), 0) >= 2000),
starts AS (SELECT track, CAST(floor((fin - 2000) * {U.format(_QUOTED)}) AS BIGINT) AS start FROM ends),
win AS (SELECT n.track, pos, kind, time - start AS time, least(dur, start + 2000 - time) AS dur, instr, pitch, start FROM notes n JOIN starts s ON s.track = n.track WHERE time BETWEEN start AND start + 2000)"""


@query(f"WITH {WINDOWS} SELECT track, start, count(DISTINCT instr) AS parts, count(*) FILTER (WHERE time <= 500) AS n FROM win GROUP BY track, start HAVING count(DISTINCT instr) <= 15 AND count(*) FILTER (WHERE time <= 500) >= 10")
def clip_candidates(spark, d):
    return clips.clip_candidates(clips.random_windows(bind.notes(spark, d), 2000), 500)


@query(f"""WITH {WINDOWS}, {_MELODY} SELECT w.track, m.instr AS melody FROM win w JOIN melody m ON m.track = w.track GROUP BY w.track, m.instr
HAVING count(DISTINCT CASE WHEN w.instr <> 128 THEN w.instr END) BETWEEN 4 AND 12 AND count(*) FILTER (WHERE w.instr = m.instr) >= 5 AND min(w.time) FILTER (WHERE w.instr = m.instr) <= 500 AND max(w.time) FILTER (WHERE w.instr = m.instr) >= 1800""")
def melody_candidates(spark, d):
    rows = bind.notes(spark, d)
    return clips.melody_candidates(clips.random_windows(rows, 2000), stats.melody_instrument(rows), 500, 2000, (4, 12), 5)


@query(f"WITH {WINDOWS}, {_MELODY} SELECT w.track, w.pos, w.kind, w.time, w.dur, w.instr, w.pitch, w.start FROM win w JOIN melody m ON m.track = w.track WHERE w.instr = m.instr OR w.time <= 500")
def accompaniment(spark, d):
    rows = bind.notes(spark, d)
    return clips.accompaniment(clips.random_windows(rows, 2000), stats.melody_instrument(rows), 500).select(*V.NOTE_COLUMNS, "start")


def _logits(spark: SparkSession, d: str) -> DataFrame:
    """Line items as logits: an order is a position."""
    li = bind.read(spark, d, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 50).alias("seq"), (F.col("l_orderkey") % 7).cast("long").alias("idx"), (F.col("l_partkey") * 37 % 30000).alias("token")).agg((F.max("l_quantity") / 10).alias("logit"))


LOGITS = "lg AS (SELECT l_orderkey % 50 AS seq, l_orderkey % 7 AS idx, l_partkey * 37 % 30000 AS token, max(l_quantity) / 10 AS logit FROM lineitem GROUP BY 1, 2, 3)"


@query(f"WITH {LOGITS} SELECT seq, idx, token FROM lg WHERE token < 27513 AND (token = 27512 OR CASE idx % 3 WHEN 0 THEN token < 10000 WHEN 1 THEN token BETWEEN 10000 AND 10999 ELSE token BETWEEN 11000 AND 27511 END)")
def slot_mask(spark, d):
    return sampling.slot_mask(_logits(spark, d)).select("seq", "idx", "token")


@query(f"WITH {LOGITS} SELECT seq, idx, token FROM lg WHERE token >= 10000 OR token >= 4000")
def future_mask(spark, d):
    return sampling.future_mask(_logits(spark, d), 4000).select("seq", "idx", "token")


@query(f"""WITH {LOGITS}, seen AS (SELECT DISTINCT l_orderkey % 50 AS seq, l_partkey % (3 + l_orderkey % 50) AS instr FROM lineitem), full_ AS (SELECT seq FROM seen GROUP BY seq HAVING count(*) >= 15)
SELECT seq, idx, token FROM lg WHERE NOT (token BETWEEN 11000 AND 27511) OR seq NOT IN (SELECT seq FROM full_) OR EXISTS (SELECT 1 FROM seen s WHERE s.seq = lg.seq AND s.instr = (token - 11000) // 128)""")
def instr_cap(spark, d):
    seen = bind.read(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("seq"), (F.col("l_partkey") % (3 + F.col("l_orderkey") % 50)).alias("instr")).distinct()
    return sampling.instrument_cap(_logits(spark, d), seen).select("seq", "idx", "token")


@query(f"""WITH {LOGITS}, w AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY seq, idx)) AS w FROM lg),
b AS (SELECT seq, idx, token, coalesce(sum(w) OVER (PARTITION BY seq, idx ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER (PARTITION BY seq, idx) AS before FROM w)
SELECT seq, idx, token FROM b WHERE before <= 0.98765""")
def nucleus(spark, d):
    return sampling.nucleus(_logits(spark, d), 0.98765).select("seq", "idx", "token")


@query(f"WITH {NOTES}, h AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY pos DESC) AS r FROM notes) SELECT track, pos, kind, time - min(time) OVER (PARTITION BY track) AS time, dur, instr, pitch FROM h WHERE r <= 339")
def history(spark, d):
    return sampling.history(bind.notes(spark, d))


@query(f"WITH {NOTES} SELECT track, pos, min(time % 700) OVER (PARTITION BY track ORDER BY pos ROWS BETWEEN 338 PRECEDING AND CURRENT ROW) AS base FROM notes")
def context_bases(spark, d):
    """Times that go up and down, so that the least one is anywhere."""
    return sampling.contexts(bind.notes(spark, d).withColumn("time", F.col("time") % 700)).select("track", "pos", "base")


_PROMPT = f"""WITH {MARKED}, up AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY time, pos) AS p FROM marked WHERE kind = 'event' AND time BETWEEN 0 AND 3000),
trk AS (SELECT DISTINCT track FROM marked), gap AS (SELECT track, p, time, coalesce(lag(time) OVER (PARTITION BY track ORDER BY p), 0) AS prev FROM up
  UNION ALL SELECT t.track, 1000000, 3000, coalesce(max(u.time), 0) FROM trk t LEFT JOIN up u ON u.track = t.track GROUP BY t.track),
res AS (SELECT track, p, prev + 100 * unnest(range(1, CAST(greatest(0, floor((time - prev - 1) / 100.0)) AS BIGINT) + 1)) AS time FROM gap),
ev AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY p, j, time) AS p, kind, time, dur, instr, pitch FROM (
  SELECT track, p, 1 AS j, kind, time, dur, instr, pitch FROM up UNION ALL SELECT track, p, 0, 'rest', time, 0, NULL, NULL FROM res)),
ctl AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY time, src, pos) AS p, 'control' AS kind, time, dur, instr, pitch FROM (
  SELECT *, 0 AS src FROM marked WHERE kind = 'control' AND time >= 5 UNION ALL SELECT *, 1 FROM marked WHERE kind = 'event' AND time > 3000)),
k AS (SELECT *, coalesce(lag(time) OVER (PARTITION BY track ORDER BY p), 0) AS key, 1 AS last FROM ev UNION ALL SELECT *, time - 500, 0 FROM ctl),
o AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY key, last, p) AS ord FROM k),
e AS (SELECT *, coalesce(max(CASE WHEN kind <> 'control' THEN ord END) OVER (PARTITION BY track), 0) AS fin FROM o)"""


def _prompt(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events, controls = sequence.split(_marked(bind.notes(spark, d)))
    return sampling.prompt_assembly(sequence.sort(events), 3000, controls)


@query(f"{_PROMPT} SELECT track, row_number() OVER (PARTITION BY track ORDER BY ord) - 1 AS pos, kind, time, dur, instr, pitch FROM e WHERE kind <> 'control' OR ord <= fin")
def prompt_assembly(spark, d):
    return _prompt(spark, d)[0]


@query(f"{_PROMPT} SELECT track, kind, time, dur, instr, pitch FROM e WHERE kind = 'control' AND ord > fin")
def prompt_waiting(spark, d):
    return _prompt(spark, d)[1].drop("pos")


@query(f"{_PROMPT} SELECT track, CASE WHEN track IN (SELECT track FROM ctl) THEN 55027 ELSE 55026 END AS flag FROM trk")
def prompt_flags(spark, d):
    return _prompt(spark, d)[2]


@query(_pack_sql(1) + ", c2 AS (SELECT shard, chunk, list_prepend(flag, toks)::INT[] AS t FROM packed WHERE NOT discarded) SELECT shard, chunk, len(t) AS n, t[1] AS first FROM c2")
def collate(spark, d):
    rows = training.pack(*_packable(spark, d)).where("not discarded").select("shard", "chunk", "tokens")
    rows = rows.withColumn("batch", F.floor(F.col("chunk") / 8))
    return sampling.collate(rows, "shard", "batch").select("shard", "chunk", F.size("labels").alias("n"), F.get("input_ids", F.lit(0)).alias("first"))


_NAMES = "[" + ", ".join("'" + n + "'" for n in V.GM_NAMES) + "]"
_NAME = f"CASE WHEN instr = 128 THEN 'Drums' WHEN instr BETWEEN 0 AND 127 THEN {_NAMES}[instr + 1] ELSE 'Instrument ' || instr END"


@query(f"WITH {NOTES} SELECT track, instr, n, {_NAME} AS name FROM (SELECT track, instr, count(*) AS n FROM notes GROUP BY track, instr)")
def instrument_names(spark, d):
    return sequence.instruments(bind.notes(spark, d)).select("track", "instr", "n", V.gm_name(F.col("instr")).alias("name"))


@query(f"""WITH {NOTES}, p AS (SELECT track, instr, min(pos) AS first FROM notes GROUP BY track, instr), b AS (SELECT track, instr, first, CASE WHEN instr % 16 = 0 THEN 'Part ' || (instr % 3) ELSE {_NAME} END AS base FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY track, base ORDER BY first, instr) AS k FROM b) SELECT track, instr, CASE WHEN k = 1 THEN base ELSE base || ' ' || k END AS name FROM k""")
def part_names(spark, d):
    parts = sequence.instruments(bind.notes(spark, d))
    given = parts.where("instr % 16 = 0").select("track", "instr", F.concat(F.lit("Part "), (F.col("instr") % 3).cast("string")).alias("name"))
    return stats.part_names(parts, given)


_SHOWN = "CASE WHEN kind = 'sep' THEN pos || ' SEPARATOR' WHEN kind = 'rest' THEN pos || ' ' || time || ' REST' ELSE concat_ws(' ', pos, time, dur, instr, pitch, CASE WHEN kind = 'control' THEN '(A)' END) END"


@query(f"WITH {MARKED} SELECT track, pos, {_SHOWN} AS line FROM (SELECT track, pos, CASE WHEN pos % 97 = 96 THEN 'sep' ELSE kind END AS kind, time, dur, instr, pitch FROM marked)")
def show_rows(spark, d):
    rows = _segments(_marked(bind.notes(spark, d)))
    return rows.select("track", "pos", V.shown(*[F.col(c) for c in ("pos", "kind", "time", "dur", "instr", "pitch")]).alias("line"))


@query(_pack_sql(1) + """, u AS (SELECT shard, chunk, unnest(range(0, 341)) AS i, toks FROM packed WHERE NOT discarded), t AS (SELECT shard, chunk, i, toks[3 * i + 1] AS t FROM u),
g AS (SELECT *, sum(CASE WHEN t = 55025 THEN 1 ELSE 0 END) OVER (PARTITION BY shard, chunk ORDER BY i) AS seg FROM t),
s AS (SELECT 3 * count(*) AS n, max(greatest(CASE WHEN t >= 27513 THEN t - 27513 ELSE t END, 0)) AS t FROM g WHERE t <> 55025 GROUP BY shard, chunk, seg)
SELECT count(*) AS sequences, CAST(sum(n) AS BIGINT) AS tokens, round(sum(t) / 360000.0, 6) AS hours, round(100.0 * sum(n) / sum(t), 6) AS rate, round(avg(100.0 * n / t) FILTER (WHERE t > 0), 6) AS mean_rate, round(stddev_pop(100.0 * n / t) FILTER (WHERE t > 0), 6) AS std_rate FROM s""")
def sequence_stats(spark, d):
    return stats.sequence_stats(training.pack(*_packable(spark, d)).where("not discarded"))


@query(f"WITH {FILES} SELECT count(*) AS files, count(*) FILTER (WHERE k) AS kept, round(100.0 * count(*) FILTER (WHERE k) / count(*), 6) AS keep_rate, min(num_tracks) FILTER (WHERE k) AS low, max(num_tracks) FILTER (WHERE k) AS high, round(avg(num_tracks) FILTER (WHERE k), 6) AS mean FROM (SELECT num_tracks, num_tracks BETWEEN 1 AND 16 AND {_ANY} AS k FROM files)")
def filter_report(spark, d):
    return stats.filter_report(bind.files(spark, d), corpus.track_range(F.col("num_tracks")) & corpus.expressive(F.col("nomml"), SCORE))


_SPLIT = "CASE substr(md5, 1, 1) WHEN 'e' THEN 'valid' WHEN 'f' THEN 'test' ELSE 'train' END"


@query(f"SELECT {_SPLIT} AS split, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS md5 FROM orders) GROUP BY 1")
def split_counts(spark, d):
    return stats.split_counts(bind.read(spark, d, "orders"), corpus.hash_split(F.md5(F.col("o_orderkey").cast("string"))))


_PICKED = f"WITH {ZIPPED}, sel AS (SELECT md5, total_notes FROM files WHERE num_tracks BETWEEN 1 AND 16 AND {_ANY})"


def _profile(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return stats.selection_profile(corpus.subset(bind.files(spark, d), "s4", SCORE).select("md5", "total_notes"), _counts(spark, d))


@query(f"{_PICKED} SELECT count(*) AS files, CAST(sum(total_notes) AS BIGINT) AS notes, CAST(3 * sum(total_notes) AS BIGINT) AS tokens, round(sum(total_notes) / (663555310 / 8943), 9) AS hours FROM sel")
def profile_totals(spark, d):
    return _profile(spark, d)[0]


@query(f"{_PICKED} SELECT grp, CAST(sum(n) AS BIGINT) AS tracks, round(100.0 * sum(n) / sum(sum(n)) OVER (), 6) AS share, count(DISTINCT md5) AS files FROM counts WHERE md5 IN (SELECT md5 FROM sel) GROUP BY grp")
def profile_groups(spark, d):
    return _profile(spark, d)[1]


_TOP = "SELECT strategy, grp, target, row_number() OVER (PARTITION BY strategy ORDER BY target {}, grp) AS place FROM t QUALIFY place <= 3"


@query(f"WITH {ZIPPED}, t AS ({_ALL_TARGETS}), a AS ({_TOP.format('DESC')}), low AS ({_TOP.format('ASC')}) SELECT * FROM a UNION ALL SELECT strategy, grp, target, -place FROM low")
def top_groups(spark, d):
    return stats.top_groups(_every_target(spark, d), "grp", "target")


@query(f"""WITH {NOTES}, c AS (SELECT track FROM notes GROUP BY track HAVING max(time) >= 5000), g AS (SELECT track FROM notes WHERE instr IN (0, 16) GROUP BY track HAVING max(time) >= 5000),
p AS (SELECT track FROM notes WHERE time <= 550 GROUP BY track HAVING greatest(max(time), 0) BETWEEN 400 AND 600)
SELECT track, pos, kind, time, CASE WHEN time + dur > 5000 THEN 5000 - time ELSE dur END AS dur, instr, pitch FROM notes WHERE time BETWEEN 0 AND 5000 AND track IN (SELECT track FROM c) AND track IN (SELECT track FROM g) AND track IN (SELECT track FROM p)""")
def paired_clips(spark, d):
    rows = bind.notes(spark, d)
    return clips.paired_clips(rows, rows.where("time <= 550"), rows.where("instr in (0, 16)"), 5000)


@query(f"""WITH {NOTES}, m AS (SELECT track, pos, CASE WHEN dur % 3 = 0 THEN 'program' ELSE 'note' END AS type, CAST(pitch % 12 AS BIGINT) AS channel, instr AS program FROM notes)
SELECT track, pos, type, channel, CASE WHEN channel = 9 THEN 128 ELSE coalesce(last_value(CASE WHEN type = 'program' THEN program END IGNORE NULLS) OVER (PARTITION BY track, channel ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) END AS instr FROM m""")
def current_program(spark, d):
    rows = bind.notes(spark, d).select("track", "pos", F.when(F.col("dur") % 3 == 0, "program").otherwise("note").alias("type"), (F.col("pitch") % 12).alias("channel"), F.col("instr").alias("program"))
    return codec.current_program(rows).select("track", "pos", "type", "channel", "instr")


_TOKENS = f"""WITH {MESSAGES}, t AS (SELECT track, pos, least(time - coalesce(lag(time) OVER (PARTITION BY track ORDER BY pos), 0), 999) AS delta, CASE WHEN is_on THEN 1000 ELSE 17512 END + 128 * instr + pitch AS note FROM msg),
u AS (SELECT track, pos, 0 AS j, delta AS token FROM t WHERE delta > 0 UNION ALL SELECT track, pos, 1, note FROM t),
toks AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY pos, j) - 1 AS pos, token FROM u)"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return codec.interarrival(_messages(bind.notes(spark, d)))


@query(f"{_TOKENS} SELECT track, pos, token FROM (SELECT *, max(CASE WHEN token BETWEEN 1000 AND 17511 THEN pos END) OVER (PARTITION BY track) AS last FROM toks) WHERE pos <= last")
def trim_interarrival(spark, d):
    return codec.trim_interarrival(_tokens(spark, d))


@query(f"""{_TOKENS}, r AS (SELECT track, pos, token BETWEEN 1000 AND 17511 AS is_on, token - CASE WHEN token < 17512 THEN 1000 ELSE 17512 END AS plain, token, CAST(sum(CASE WHEN token < 1000 THEN token ELSE 0 END) OVER (PARTITION BY track ORDER BY pos) AS BIGINT) AS time FROM toks),
f AS (SELECT *, min(CASE WHEN is_on THEN pos END) OVER (PARTITION BY track, plain // 128) AS first FROM r WHERE token >= 1000)
SELECT track, row_number() OVER (PARTITION BY track ORDER BY pos) - 1 AS pos, time, is_on AS "on", plain // 128 AS instr, plain % 128 AS pitch FROM f WHERE is_on OR pos > first""")
def interarrival_schedule(spark, d):
    return codec.interarrival_schedule(_tokens(spark, d))


@query("SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 5")
def limit_per_split(spark, d):
    return corpus.limit_per_split(bind.read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 5)


_PATH = "'/data/' || CASE o_orderstatus WHEN 'F' THEN 'training-V1.1-80%' WHEN 'O' THEN 'validation-V1.1-10%' ELSE 'other' END || '/' || o_orderkey"


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation' END AS split FROM orders WHERE o_orderstatus IN ('F', 'O')")
def native_split(spark, d):
    return bind.read(spark, d, "orders").select("o_orderkey", corpus.native_split(F.expr(_PATH)).alias("split")).where("split is not null")


@query("SELECT c_custkey, [c_mktsegment, c_name] AS strings, [CAST(c_custkey AS VARCHAR), '-1'] AS numbers FROM customer")
def python_lists(spark, d):
    rows = bind.read(spark, d, "customer")
    quoted = F.format_string("['%s', '%s']", "c_mktsegment", "c_name")
    return rows.select("c_custkey", corpus.parse_python_list(quoted).alias("strings"), corpus.parse_python_list(F.format_string("[%d, -1]", "c_custkey")).alias("numbers"))


@query(f"WITH {NOTES} SELECT track, round(339 / (count(*) / ((max(time) + 200) / 200.0)), 6) AS bars FROM notes GROUP BY track")
def context_bars(spark, d):
    return bind.notes(spark, d).groupBy("track").agg(F.round(stats.context_bars(F.count("*"), (F.max("time") + 200) / 200.0), 6).alias("bars"))


@query()
def tokenize(spark, d):
    rows = bind.notes(spark, d).where("time >= 0")
    return training.tokenize(rows, rows.select("track", (F.col("track") % 4).alias("shard")).distinct(), 10, tasks=bind.parts(spark, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_rows(spark, sf_dir)


from strophe import catalogue_more  # noqa: E402, F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
