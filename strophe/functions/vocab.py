"""Token vocabulary of event triples: constants, and encode/decode expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the token format.
CONTEXT, M = 1024, 341
RESOLUTION, DELTA = 100, 500  # ticks a second, ticks a control is moved ahead
MAX_TIME, MAX_DUR, MAX_PITCH, MAX_INSTR, MAX_NOTE = 10000, 1000, 128, 129, 16512
TIME_OFFSET, DUR_OFFSET, NOTE_OFFSET, REST = 0, 10000, 11000, 27512
CONTROL_OFFSET, SEPARATOR, AUTOREGRESS, ANTICIPATE, VOCAB = 27513, 55025, 55026, 55027, 55028
MIDI_ON, MIDI_OFF, MIDI_SEPARATOR, MAX_DELTA = 1000, 17512, 34024, 999
DRUMS, UNKNOWN_DUR, MAX_TRACK_INSTR = 128, 25, 16
MIN_TRACK_EVENTS, MIN_TRACK_TIME, MAX_TRACK_TIME = 100, 1000, 360000

NOTE_COLUMNS = ("track", "pos", "kind", "time", "dur", "instr", "pitch")


def ticks(seconds: float) -> int:
    """Seconds to ticks, toward zero."""
    return int(RESOLUTION * seconds)


def clamp_dur(dur: Column) -> Column:
    return F.when(dur == -1, UNKNOWN_DUR).otherwise(F.least(dur, F.lit(MAX_DUR - 1)))


def encode(kind: Column, time: Column, dur: Column, instr: Column, pitch: Column) -> Column:
    """array(time, duration, note) tokens of a row; separators are three of the same token."""
    shift = F.when(kind == "control", CONTROL_OFFSET).otherwise(0)
    note = F.when(kind == "rest", REST).otherwise(NOTE_OFFSET + 128 * instr + pitch + shift)
    triple = F.array(time + TIME_OFFSET + shift, dur + DUR_OFFSET + shift, note)
    return F.when(kind == "sep", F.array(*[F.lit(SEPARATOR)] * 3)).otherwise(triple).cast("array<int>")


def decode(tokens: Column) -> Column:
    """Struct (kind, time, dur, instr, pitch) of an encoded triple."""
    note, shift = F.get(tokens, 2), F.when(F.get(tokens, 2) >= CONTROL_OFFSET, CONTROL_OFFSET).otherwise(0)
    kind = F.when(note == SEPARATOR, "sep").when(note == REST, "rest").when(note >= CONTROL_OFFSET, "control").otherwise("event")
    plain = note - shift - NOTE_OFFSET
    real = kind.isin("event", "control")
    return F.struct(
        kind.alias("kind"),
        F.when(kind != "sep", F.get(tokens, 0) - shift - TIME_OFFSET).cast("long").alias("time"),
        F.when(kind != "sep", F.get(tokens, 1) - shift - DUR_OFFSET).cast("long").alias("dur"),
        F.when(real, F.floor(plain / 128)).cast("long").alias("instr"),
        F.when(real, F.pmod(plain, F.lit(128))).cast("long").alias("pitch"),
    )


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a hash of the parts, the same in every engine."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("double") / float(1 << 32)


def bar_to_seconds(bar: Column, bpm: float, num: int, den: int) -> Column:
    return (bar - 1) * F.lit(60.0 / bpm * num * 4.0 / den)


def seconds_to_bar_beat(seconds: Column, bpm: float, beats: int) -> tuple[Column, Column]:
    total = seconds * F.lit(bpm / 60.0)
    return F.floor(total / beats) + 1, F.floor(total % beats) + 1


# The public General MIDI names of programs 0 to 127.
GM_NAMES = (
    "Acoustic Grand Piano", "Bright Acoustic Piano", "Electric Grand Piano", "Honky-tonk Piano", "Electric Piano 1", "Electric Piano 2", "Harpsichord", "Clavinet",
    "Celesta", "Glockenspiel", "Music Box", "Vibraphone", "Marimba", "Xylophone", "Tubular Bells", "Dulcimer",
    "Drawbar Organ", "Percussive Organ", "Rock Organ", "Church Organ", "Reed Organ", "Accordion", "Harmonica", "Tango Accordion",
    "Acoustic Guitar (nylon)", "Acoustic Guitar (steel)", "Electric Guitar (jazz)", "Electric Guitar (clean)", "Electric Guitar (muted)", "Overdriven Guitar", "Distortion Guitar", "Guitar Harmonics",
    "Acoustic Bass", "Electric Bass (finger)", "Electric Bass (pick)", "Fretless Bass", "Slap Bass 1", "Slap Bass 2", "Synth Bass 1", "Synth Bass 2",
    "Violin", "Viola", "Cello", "Contrabass", "Tremolo Strings", "Pizzicato Strings", "Orchestral Harp", "Timpani",
    "String Ensemble 1", "String Ensemble 2", "SynthStrings 1", "SynthStrings 2", "Choir Aahs", "Voice Oohs", "Synth Voice", "Orchestra Hit",
    "Trumpet", "Trombone", "Tuba", "Muted Trumpet", "French Horn", "Brass Section", "SynthBrass 1", "SynthBrass 2",
    "Soprano Sax", "Alto Sax", "Tenor Sax", "Baritone Sax", "Oboe", "English Horn", "Bassoon", "Clarinet",
    "Piccolo", "Flute", "Recorder", "Pan Flute", "Blown Bottle", "Shakuhachi", "Whistle", "Ocarina",
    "Lead 1 (square)", "Lead 2 (sawtooth)", "Lead 3 (calliope)", "Lead 4 (chiff)", "Lead 5 (charang)", "Lead 6 (voice)", "Lead 7 (fifths)", "Lead 8 (bass+lead)",
    "Pad 1 (new age)", "Pad 2 (warm)", "Pad 3 (polysynth)", "Pad 4 (choir)", "Pad 5 (bowed)", "Pad 6 (metallic)", "Pad 7 (halo)", "Pad 8 (sweep)",
    "FX 1 (rain)", "FX 2 (soundtrack)", "FX 3 (crystal)", "FX 4 (atmosphere)", "FX 5 (brightness)", "FX 6 (goblins)", "FX 7 (echoes)", "FX 8 (sci-fi)",
    "Sitar", "Banjo", "Shamisen", "Koto", "Kalimba", "Bag pipe", "Fiddle", "Shanai",
    "Tinkle Bell", "Agogo", "Steel Drums", "Woodblock", "Taiko Drum", "Melodic Tom", "Synth Drum", "Reverse Cymbal",
    "Guitar Fret Noise", "Breath Noise", "Seashore", "Bird Tweet", "Telephone Ring", "Helicopter", "Applause", "Gunshot",
)


def gm_name(instr: Column) -> Column:
    """The name of a program; 128 is Drums, others are numbered."""
    known = F.when(instr.between(0, 127), F.get(F.array(*[F.lit(n) for n in GM_NAMES]), instr.cast("int")))
    return F.when(instr == DRUMS, "Drums").otherwise(F.coalesce(known, F.concat(F.lit("Instrument "), instr.cast("string"))))


def shown(pos: Column, kind: Column, time: Column, dur: Column, instr: Column, pitch: Column) -> Column:
    """A row as a line of text: its place and fields, (A) behind a control."""
    note = F.concat_ws(" ", pos, time, dur, instr, pitch, F.when(kind == "control", "(A)"))
    return F.when(kind == "sep", F.concat_ws(" ", pos, F.lit("SEPARATOR"))).when(kind == "rest", F.concat_ws(" ", pos, time, F.lit("REST"))).otherwise(note)


def quantize_fraction(text: Column) -> Column:
    """N of '1/N'; another form is an error."""
    n = F.regexp_extract(text, r"^\s*1\s*/\s*([1-9][0-9]*)\s*$", 1)
    return F.when(n == "", F.raise_error(F.concat(F.lit("not 1/N: "), text)).cast("int")).otherwise(n.try_cast("int"))
