"""Standard MIDI files: decoding to message rows, encoding, and scans."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Message rows in a batch of decoded files.
BATCH_ROWS = 1 << 15
MESSAGE_SCHEMA = "path string, pos long, tick long, seconds double, time long, type string, channel int, program int, pitch long, velocity int, on boolean, part int, text string"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, length) of *.mid and *.midi files below folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{mid,midi}").load(folder)


def quantity(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place) of a variable-length quantity."""
    value = 0
    while at < len(data):
        byte = data[at]
        at += 1
        value = value << 7 | byte & 127
        if byte < 128:
            break
    return value, at


def tracks(data: bytes) -> tuple[int, list[bytes]]:
    """(ticks a quarter note, track bodies); an unreadable file is an error, a track past the end is cut."""
    if len(data) < 14 or data[:4] != b"MThd":
        raise ValueError("no MIDI header")
    size, _, _, division = struct.unpack(">IHHH", data[4:14])
    at, found = 8 + size, []
    while at + 8 <= len(data):
        n = struct.unpack(">I", data[at + 4 : at + 8])[0]
        if data[at : at + 4] == b"MTrk":
            found.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return division, found


def events(body: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(absolute tick, status, data) of a track, with running status, which meta events don't end; they have their kind first in data."""
    at = tick = running = 0
    while at < len(body):
        delta, at = quantity(body, at)
        tick += delta
        if at >= len(body):
            return
        status = running
        if body[at] >= 128:
            status = body[at]
            at += 1
            if status != 255:
                running = status
        if status < 128:
            raise ValueError("data without a status")
        if status == 255:
            kind = body[at : at + 1]
            n, at = quantity(body, at + 1)
            yield tick, 255, kind + body[at : at + n]
            at += n
        elif status in (240, 247):
            n, at = quantity(body, at)
            at += n
        else:
            n = 1 if status & 240 in (192, 208) else 2
            yield tick, status, body[at : at + n]
            at += n


def messages(data: bytes) -> list[tuple]:
    """(tick, seconds, type, channel, program, pitch, velocity, on, part, text) of all tracks merged by tick, tempo map applied.

    type is note, program, tempo (program: microseconds a beat), signature (text: 3/4), name, instrument (text) or other.
    """
    division, bodies = tracks(data)
    merged = sorted(((tick, k, i, status, d) for k, b in enumerate(bodies) for i, (tick, status, d) in enumerate(events(b))), key=lambda x: x[:3])
    tempo, last, seconds, out = 500000, 0, 0.0, []
    for tick, part, _, status, d in merged:
        frames = division & 0x8000
        seconds += (tick - last) / (((256 - (division >> 8)) * (division & 255)) or 1) if frames else (tick - last) * tempo / 1e6 / (division or 1)
        last = tick
        kind, channel = status & 240, status & 15
        row = lambda what, c=None, p=None, pitch=None, v=None, on=None, text=None: (tick, seconds, what, c, p, pitch, v, on, part, text)  # noqa: B023, E731
        if status == 255 and d[:1] == b"\x51" and len(d) >= 4:
            tempo = int.from_bytes(d[1:4], "big")
            out.append(row("tempo", p=tempo))
        elif status == 255 and d[:1] == b"\x58" and len(d) >= 3:
            out.append(row("signature", text=f"{d[1]}/{1 << d[2]}"))
        elif status == 255 and d[:1] in (b"\x03", b"\x04"):
            out.append(row("name" if d[0] == 3 else "instrument", text=d[1:].decode("latin-1").strip()))
        elif kind == 192 and d:
            out.append(row("program", channel, d[0]))
        elif kind in (128, 144) and len(d) == 2:
            out.append(row("note", channel, None, d[0], d[1], kind == 144 and d[1] > 0))
        elif 128 <= kind < 240:
            out.append(row("other", channel))
    return out


def decoded(batches: Iterator[pa.RecordBatch], resolution: int) -> Iterator[pa.RecordBatch]:
    """Batches of message rows of batches of files (path, content), of BATCH_ROWS and one file's more at most."""
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in MESSAGE_SCHEMA.split(", ")])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names=schema.names)

    rows: list[tuple] = []
    for b in batches:
        for path, content in zip(b.column(0), b.column(1), strict=True):
            path = path.as_py()
            try:
                found = messages(content.as_py())
                rows += [(path, i, t, s, round(s * resolution), *rest) for i, (t, s, *rest) in enumerate(found)]
            except (ValueError, IndexError, struct.error, TypeError):
                rows.append((path, 0, None, None, None, "bad", *[None] * 7))
            if len(rows) >= BATCH_ROWS:
                yield batch(rows)
                rows = []
    if rows:
        yield batch(rows)


def decode(files: DataFrame, resolution: int = 100) -> DataFrame:
    """Message rows of files (path, content); unreadable files give one row of type 'bad'. Times are ticks, half to even."""
    return files.select("path", "content").mapInArrow(lambda batches: decoded(batches, resolution), MESSAGE_SCHEMA)


def count_raw(data: bytes) -> tuple[int, int] | None:
    """(note-ons, tracks) without a tempo map; null if it is no MIDI file. A track that ends past the file is counted, not read."""
    if len(data) < 14 or data[:4] != b"MThd":
        return None
    at, notes, found = 8 + struct.unpack(">I", data[4:8])[0], 0, 0
    while at + 8 <= len(data):
        n = struct.unpack(">I", data[at + 4 : at + 8])[0]
        if data[at : at + 4] == b"MTrk":
            found += 1
            if at + 8 + n <= len(data):
                try:
                    notes += sum(1 for _, status, d in events(data[at + 8 : at + 8 + n]) if status & 240 == 144 and len(d) == 2 and d[1] > 0)
                except (ValueError, IndexError):
                    pass
        at += 8 + n
    return notes, found


def raw_counts(files: DataFrame) -> DataFrame:
    """(path, note_events, tracks) of files (path, content); nulls for what is no MIDI file."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            got = [count_raw(bytes(c)) if c is not None else None for c in f.content]
            yield pd.DataFrame({"path": f.path, "note_events": pd.array([g and g[0] for g in got], "Int64"), "tracks": pd.array([g and g[1] for g in got], "Int64")})

    return files.select("path", "content").mapInPandas(run, "path string, note_events long, tracks long")


def file_sizes(files: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """(split, files, bytes) of files (path, length) whose path has a folder of a split; hidden files don't count."""
    split = F.coalesce(*[F.when(F.col("path").contains(f"/{s}/"), s) for s in splits])
    rows = files.where("path like '%.mid' and not path like '%/._%'").select(split.alias("split"), "length").where("split is not null")
    return rows.groupBy("split").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def part_summary(rows: DataFrame) -> DataFrame:
    """(path, part, name, note_ons, channels, programs) of each track of message rows; programs are 'channel:program', the last of each channel."""
    programs = rows.where("type = 'program'").groupBy("path", "part", "channel").agg(F.max_by("program", "pos").alias("p"))
    programs = programs.groupBy("path", "part").agg(F.array_sort(F.collect_list(F.struct("channel", "p"))).alias("programs"))
    a = rows.where("type <> 'bad'").groupBy("path", "part").agg(
        F.max_by(F.when(F.col("type") == "name", F.col("text")), F.when(F.col("type") == "name", F.col("pos"))).alias("name"),
        F.count_if(F.coalesce("on", F.lit(False))).alias("note_ons"), F.array_sort(F.collect_set("channel")).alias("channels"),
    )
    shown = F.coalesce(F.transform("programs", lambda x: F.concat_ws(":", x["channel"], x["p"])), F.array().cast("array<string>"))
    return a.join(programs, ["path", "part"], "left").withColumn("programs", shown).select("path", "part", "name", "note_ons", "channels", "programs")


def file_summary(rows: DataFrame) -> DataFrame:
    """(path, parts, seconds, has_tempo, bpms, signatures, channels): bpms and signatures in the order of the file."""
    listed = lambda kind, value: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("pos", value.alias("v"))))), lambda x: x["v"])
    return rows.where("type <> 'bad'").groupBy("path").agg(
        F.count_distinct("part").alias("parts"), F.max("seconds").alias("seconds"), (F.count_if(F.col("type") == "tempo") > 0).alias("has_tempo"),
        listed("tempo", F.round(60e6 / F.col("program"), 3)).alias("bpms"), listed("signature", F.col("text")).alias("signatures"), F.array_sort(F.collect_set("channel")).alias("channels"),
    )


def source_names(rows: DataFrame) -> DataFrame:
    """(path, instr, name): each instrument with the name of the first named track that uses it; 128 is channel 9."""
    first = lambda kind: F.min_by(F.when(F.col("type") == kind, F.col("text")), F.when((F.col("type") == kind) & (F.col("text") != ""), F.col("pos")))
    named = rows.groupBy("path", "part").agg(F.coalesce(first("name"), first("instrument")).alias("name")).where("name is not null")
    used = rows.where("type in ('note', 'program')").groupBy("path", "part", "channel").agg(F.max_by("program", F.when(F.col("type") == "program", F.col("pos"))).alias("p"))
    used = used.withColumn("instr", F.when(F.col("channel") == 9, 128).otherwise(F.coalesce("p", F.lit(0))))
    return used.join(named, ["path", "part"]).groupBy("path", "instr").agg(F.min_by("name", F.struct("part", "channel")).alias("name"))


def divisions(files: DataFrame) -> DataFrame:
    """(path, ticks_per_beat) as the headers of files (path, content) say."""
    return files.select("path", F.conv(F.hex(F.substring("content", 13, 2)), 16, 10).cast("int").alias("ticks_per_beat"))


def durations(message_rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(path, note_ons, seconds, seconds_at_120) of each file; headers: (path, ticks_per_beat).

    seconds follows the tempo map, and is that without one where the map gives nothing; seconds_at_120 passes it over, and is 0 for
    a header of 0 ticks a beat.
    """
    a = message_rows.where("type <> 'bad'").groupBy("path").agg(F.count_if(F.coalesce("on", F.lit(False))).alias("note_ons"), F.max("seconds").alias("seconds"), F.max("tick").alias("tick"))
    plain = F.when(F.col("ticks_per_beat") > 0, F.col("tick") * 500000 / F.col("ticks_per_beat") / 1e6).otherwise(0.0)
    return a.join(headers, "path").select("path", "note_ons", F.coalesce("seconds", plain).alias("seconds"), plain.alias("seconds_at_120"))


def scan_totals(raw: DataFrame, lengths: DataFrame, tokens_per_note: int = 3) -> DataFrame:
    """(files, errors, notes, tokens, hours) of raw_counts() rows and durations(); files that can't be read are errors."""
    a = raw.join(lengths.select("path", "seconds_at_120"), "path", "left")
    ok = F.col("note_events").isNotNull()
    notes = F.coalesce(F.sum("note_events"), F.lit(0))
    return a.agg(F.count_if(ok).alias("files"), F.count_if(~ok).alias("errors"), notes.alias("notes"), (notes * tokens_per_note).alias("tokens"), F.round(F.coalesce(F.sum(F.when(ok, F.col("seconds_at_120"))), F.lit(0.0)) / 3600, 9).alias("hours"))


def put_quantity(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(reversed(out))


def beat_ticks(bpm: float) -> tuple[int, int]:
    """(ticks a beat, microseconds a beat) that keep a tick at a hundredth of a second at this tempo."""
    tempo = round(60e6 / bpm)
    return max(1, round(tempo / 10000)), tempo


def encode(schedule: list[tuple[int, bool, int, int, int]], ticks_per_beat: int = 50, tempo: int = 500000, beats: int | None = None, names: dict[int, tuple[str, str]] | None = None) -> bytes:
    """A file from (time, on, instrument, pitch, channel) rows in order: one track for each instrument in order of first use.

    beats: a time signature of so many quarters; names: (track name, instrument name) by instrument. Channels are 0 to 15; others raise ValueError.
    """
    meta = lambda kind, body: b"\x00\xff" + bytes([kind]) + put_quantity(len(body)) + body
    parts: dict[int, list] = {}
    for time, on, instr, pitch, channel in schedule:
        parts.setdefault(instr, []).append((time, on, pitch, channel))
    bodies = [meta(0x51, tempo.to_bytes(3, "big")) + (meta(0x58, bytes([beats, 2, 24, 8])) if beats else b"") + meta(0x2F, b"")]
    for instr, rows in parts.items():
        channel, last = rows[0][3], 0
        if not all(0 <= c <= 15 for *_, c in rows):
            raise ValueError(f"instrument {instr} is on a channel that files don't have")
        body = b"".join(meta(3 + i, text.encode("latin-1", "replace")) for i, text in enumerate((names or {}).get(instr, ())))
        body += b"" if channel == 9 else b"\x00" + bytes([192 | channel, instr])
        for time, on, pitch, c in rows:
            body += put_quantity(time - last) + bytes([(144 if on else 128) | c, pitch, 72 if on else 0])
            last = time
        bodies.append(body + b"\x00\xff\x2f\x00")
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(bodies), ticks_per_beat) + b"".join(b"MTrk" + struct.pack(">I", len(b)) + b for b in bodies)


def write_files(schedule: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(track, content) of the MIDI files of schedule rows (track, pos, time, on, instr, pitch, channel); names: (track, instr, name) of their tracks."""
    rows = schedule.select("track", "pos", "time", "on", "instr", "pitch", "channel").groupBy("track")

    def made(track: pa.Scalar, table: pa.Table, called: dict[int, tuple[str]] | None) -> pa.Table:
        columns = table.sort_by("pos").select(["time", "on", "instr", "pitch", "channel"]).to_pydict()
        content = encode(list(zip(*columns.values(), strict=True)), names=called)
        return pa.table({"track": pa.array([track.as_py()], pa.int64()), "content": pa.array([content], pa.binary())})

    if names is None:
        return rows.applyInArrow(lambda key, table: made(key[0], table, None), "track long, content binary")
    listed = names.select("track", F.col("instr").cast("long").alias("instr"), "name").groupBy("track")

    def both(key: tuple[pa.Scalar, ...], table: pa.Table, given: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"track": pa.array([], pa.int64()), "content": pa.array([], pa.binary())})
        called = {i: (n,) for i, n in zip(given["instr"].to_pylist(), given["name"].to_pylist(), strict=True)}
        return made(key[0], table, called)

    return rows.cogroup(listed).applyInArrow(both, "track long, content binary")


def raw_events(body: bytes) -> Iterator[tuple[int, bytes]]:
    """(absolute tick, event with its status) of a track, whatever it is."""
    at = tick = running = 0
    while at < len(body):
        delta, at = quantity(body, at)
        tick += delta
        if at >= len(body):
            return
        status, start = running, at
        if body[at] >= 128:
            status, start = body[at], at + 1
            running = status if status < 240 else running
        if status < 128:
            raise ValueError("data without a status")
        if status >= 240:
            n, end = quantity(body, start + (status == 255))
            end += n
        else:
            end = start + (1 if status & 240 in (192, 208) else 2)
        yield tick, bytes([status]) + body[start:end]
        at = end


def retimed(data: bytes, bpm: float, beats: int) -> bytes:
    """The file with one tempo and one signature, first in its first track, in place of all it has; its ticks stay and last a hundredth of a second."""
    _, bodies = tracks(data)
    ticks, tempo = beat_ticks(bpm)
    out = []
    for k, body in enumerate(bodies):
        kept = [(t, e) for t, e in raw_events(body) if e[:2] not in (b"\xff\x51", b"\xff\x58")]
        if k == 0:
            kept = [(0, b"\xff\x51\x03" + tempo.to_bytes(3, "big")), (0, b"\xff\x58\x04" + bytes([beats, 2, 24, 8])), *kept]
        made, last = b"", 0
        for t, e in kept:
            made += put_quantity(t - last) + e
            last = t
        out.append(made)
    return b"MThd" + struct.pack(">IHHH", 6, int.from_bytes(data[8:10], "big"), len(out), ticks) + b"".join(b"MTrk" + struct.pack(">I", len(b)) + b for b in out)


def renamed(data: bytes, names: dict[int, str]) -> bytes:
    """The file with new names of the tracks that names lists by their number, first in the track, in place of those they have."""
    _, bodies = tracks(data)
    out = []
    for k, body in enumerate(bodies):
        if k in names:
            kept = [(t, e) for t, e in raw_events(body) if e[:2] != b"\xff\x03"]
            text = names[k].encode("latin-1", "replace")
            made, last = b"", 0
            for t, e in [(0, b"\xff\x03" + put_quantity(len(text)) + text), *kept]:
                made += put_quantity(t - last) + e
                last = t
            body = made
        out.append(body)
    return b"MThd" + struct.pack(">IHH", 6, int.from_bytes(data[8:10], "big"), len(out)) + data[12:14] + b"".join(b"MTrk" + struct.pack(">I", len(b)) + b for b in out)


def rename_tracks(files: DataFrame, names: DataFrame, parts: int | None = None) -> DataFrame:
    """(path, content) of files whose tracks are called as names (path, part, name) says; null content for what is no MIDI file. Other files stay.

    parts: over how many tasks the files are dealt; the session's number if it is not given.
    """
    # both sides are dealt: a join takes the number of the one that needs no exchange, which is that of the grouped names
    files, names = (rows if parts is None else rows.repartition(parts, "path") for rows in (files.select("path", "content"), names))
    listed = names.groupBy("path").agg(F.collect_list(F.struct(F.col("part").cast("int").alias("part"), "name")).alias("names"))

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            made = []
            for c, given in zip(f.content, f.names, strict=True):
                try:
                    made.append(renamed(bytes(c), {x["part"]: x["name"] for x in given}) if given is not None else bytes(c))
                except (ValueError, IndexError, struct.error, TypeError):
                    made.append(None)
            yield pd.DataFrame({"path": f.path, "content": made})

    return files.join(listed, "path", "left").mapInPandas(run, "path string, content binary")


def rewrite_timing(files: DataFrame, bpm: float, beats: int) -> DataFrame:
    """(path, content) of files with their tempo and signature rewritten; null content for what is no MIDI file."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            made = []
            for c in f.content:
                try:
                    made.append(retimed(bytes(c), bpm, beats))
                except (ValueError, IndexError, struct.error, TypeError):
                    made.append(None)
            yield pd.DataFrame({"path": f.path, "content": made})

    return files.select("path", "content").mapInPandas(run, "path string, content binary")


def write_raw(files: DataFrame, root: str) -> DataFrame:
    """(name, written) of files (name, content), each written to root/name unless it is there; nothing happens before the result is read.

    A file appears under its name only when it is whole, so a task may run again. The folder is one that all tasks see.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        disk, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        for f in frames:
            done = []
            for name, content in zip(f.name, f.content, strict=True):
                path = f"{base}/{name}"
                done.append(disk.get_file_info(path).type == fs.FileType.NotFound)
                if done[-1]:
                    disk.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    part = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                    with disk.open_output_stream(part) as out:
                        out.write(bytes(content))
                    disk.move(part, path)
            yield pd.DataFrame({"name": f.name, "written": done})

    return files.select("name", "content").mapInPandas(run, "name string, written boolean")
