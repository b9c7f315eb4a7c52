"""Corpus selection over metadata: predicates, splits, exact samples, quotas."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.plans.scratch import folder
from strophe.sources import files as tree

EXPRESSIVE = 12
#: Files that a fold over all of them holds at a time.
BATCH_FILES = 1 << 13
GENRES = ("gospel", "latin")
NATIVE_SPLITS = {"training-V1.1-80%": "train", "validation-V1.1-10%": "validation", "test-V1.1-10%": "test"}  # fixed values: folder names


def native_split(path: Column, names: dict[str, str] | None = None) -> Column:
    """The split whose marker a path contains; null (a row to drop) without one."""
    out = F.lit(None).cast("string")
    for marker, split in reversed((names or NATIVE_SPLITS).items()):
        out = F.when(path.contains(marker), split).otherwise(out)
    return out


def expressive(nomml: Column, threshold: int = EXPRESSIVE) -> Column:
    return F.coalesce(F.exists(nomml, lambda n: F.coalesce(n >= threshold, F.lit(False))), F.lit(False))


def genre(styles: Column, scraped: Column | None = None, genres: tuple[str, ...] = GENRES) -> Column:
    """Any style, in any case, among the genres; with scraped, that style counts too."""
    every = F.coalesce(styles, F.array().cast("array<string>"))
    if scraped is not None:
        every = F.concat(every, F.array(scraped))
    return F.exists(every, lambda s: F.coalesce(F.lower(s).isin(*genres), F.lit(False)))


def style(styles: Column, wanted: tuple[str, ...]) -> Column:
    """Any style exactly, case included, among the wanted ones."""
    return F.coalesce(F.arrays_overlap(styles, F.array(*[F.lit(x) for x in wanted])), F.lit(False))


def records(files: DataFrame, split: str | Column) -> DataFrame:
    """The record of each file of metadata: missing texts are empty, missing numbers 0."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    number = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return files.select(text("md5"), (split if isinstance(split, Column) else F.lit(split)).alias("split"), number("num_tracks", "long"), text("title"), text("artist"), number("duration", "double"), text("time_signature"), number("tempo", "double"))


def track_range(n: Column, low: int = 1, high: int = 16) -> Column:
    return F.coalesce(n, F.lit(0)).between(low, high)


def subset_predicate(name: str, threshold: int = EXPRESSIVE, genres: tuple[str, ...] = GENRES) -> Column:
    """The rows of a named subset, before sampling, of files (md5, num_tracks, nomml, styles)."""
    good, style = expressive(F.col("nomml"), threshold), genre(F.col("styles"), None, genres)
    of = {"s1": F.lit(True), "s2": track_range(F.col("num_tracks")) & good, "s3": F.lit(True), "s4": track_range(F.col("num_tracks")) & good, "s8": style, "s11": style & good}
    return of[name] & (F.coalesce("md5", F.lit("")) != "")


def with_content(files: DataFrame) -> DataFrame:
    """Files whose bytes (content) are there and not empty."""
    return files.where(F.coalesce(F.length("content"), F.lit(0)) > 0)


SUBSET_FRACTION = {"s1": 0.1, "s2": 0.1, "s3": 0.2}


def hex_shard(md5: Column) -> Column:
    return F.lower(F.substring(md5, 1, 1))


def hash_split(md5: Column, unknown: str = "train") -> Column:
    c = hex_shard(md5)
    return F.when(c == "e", "valid").when(c == "f", "test").when(c.rlike("^[0-9a-d]$"), "train").otherwise(unknown)


def hash_order(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key))


def _ranked_low(df: DataFrame, by: list[str], key: str, take: Callable[[Column], Column], seed: int) -> DataFrame:
    """The rows of each group that come first in the seeded order, take(n) of its n.

    Rows are counted by the leading digits of their order; those under the cut's digits stay by that alone, and only rows that
    share the cut's digits are ranked.
    """
    digits = 4 if not by else 3
    rows = df.withColumn("__h", hash_order(F.col(key), seed)).withColumn("__b", F.substring("__h", 1, digits))
    counts = rows.groupBy(*by, "__b").agg(F.count("*").alias("__c"))
    own = Window.partitionBy(*by)
    before = F.sum("__c").over(own.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__c")
    cuts = counts.withColumn("__before", before).withColumn("__k", take(F.sum("__c").over(own))).where("__before < __k")
    near = rows.join(cuts, [*by, "__b"])
    whole = F.col("__before") + F.col("__c") <= F.col("__k")
    rank = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", key))
    last = near.where(~whole).withColumn("__r", rank).where("__before + __r <= __k").drop("__r")
    return near.where(whole).unionByName(last).select(*df.columns)


def exact_sample(df: DataFrame, key: str, fraction: float, seed: int = 42, min_one: bool = False) -> DataFrame:
    """int(n * fraction) rows without replacement, those first in an order that depends on the seed and the key alone."""
    least = 1 if min_one else 0
    return _ranked_low(df, [], key, lambda n: F.greatest(F.lit(least), F.floor(n * fraction)), seed)


def stratified_sample(df: DataFrame, stratum: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """max(1, int(n * fraction)) rows of every stratum."""
    return _ranked_low(df, [stratum], key, lambda n: F.greatest(F.lit(1), F.floor(n * fraction)), seed)


def subset(df: DataFrame, name: str, threshold: int = EXPRESSIVE, genres: tuple[str, ...] = GENRES, seed: int = 42) -> DataFrame:
    rows = df.where(subset_predicate(name, threshold, genres))
    return exact_sample(rows, "md5", SUBSET_FRACTION[name], seed) if name in SUBSET_FRACTION else rows


def global_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in one seeded order over all partitions."""
    return df.orderBy(hash_order(F.col(key).cast("string"), seed), key)


def subsample(df: DataFrame, seq: str, every: int = 10) -> DataFrame:
    return df.where(F.col(seq) % every == 0)


def limit_per_split(df: DataFrame, split: str, key: str, n: int, accepted: Column | None = None) -> DataFrame:
    """The first n rows of each split; with accepted, those of the first n scanned that it accepts (give accepted rows alone to count these)."""
    if accepted is not None:
        return limit_per_split(df, split, key, n).where(accepted)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(split).orderBy(key))).where(F.col("__r") <= n).drop("__r")


def zip_groups(files: DataFrame, threshold: int = EXPRESSIVE) -> DataFrame:
    """(md5, grp, n): tracks of each group with a score of at least threshold; groups pair with scores other than -1 in order."""
    pairs = F.arrays_zip(F.col("groups").alias("g"), F.filter("nomml", lambda n: n != -1).alias("s"))
    rows = files.select("md5", F.explode(pairs).alias("p")).select("md5", F.col("p.g").alias("grp"), F.col("p.s").alias("s"))
    return rows.where((F.col("s") >= threshold) & F.col("grp").isNotNull()).groupBy("md5", "grp").agg(F.count("*").alias("n"))


def balanced_gate(files: DataFrame, min_notes: int = 50, threshold: int = EXPRESSIVE) -> DataFrame:
    some = files.where((F.col("total_notes") >= min_notes) & expressive(F.col("nomml"), threshold) & (F.size("groups") > 0))
    return some.join(zip_groups(some, threshold).select("md5").distinct(), "md5", "left_semi")


def group_available(counts: DataFrame) -> DataFrame:
    return counts.groupBy("grp").agg(F.sum("n").alias("tracks"), F.count_distinct("md5").alias("files"))


def file_category(counts: DataFrame, big: tuple[str, str, str]) -> DataFrame:
    """(md5, category) by the groups a file has: other, or one of the mixes of the big three (piano, guitar, drums)."""
    has = [F.max(F.when(F.col("grp") == g, 1).otherwise(0)) for g in big]
    other = F.max(F.when(F.col("grp").isin(*big), 0).otherwise(1))
    a = counts.groupBy("md5").agg(other.alias("o"), *[h.alias(f"b{i}") for i, h in enumerate(has)])
    kind = F.when(F.col("o") == 1, "other").when((F.col("b0") == 1) & (F.col("b1") == 1), "first+second").when(F.col("b0") == 1, "first-only").when(F.col("b1") == 1, "second-only").otherwise("third-only")
    return a.select("md5", kind.alias("category"))


def targets(available: DataFrame, strategy: str, pct: float, big: tuple[str, ...] = (), big_cap: int = 0) -> DataFrame:
    """(grp, tracks, target) of available (grp, tracks) under a quota strategy.

    b: big_cap for the big groups, pct of the rest; c1: the smallest group's pct for each, at most what there is; c2: pct of each;
    c3, c4: all tracks shared out by the square root, or the log of 1 + percent, of a group's share; c5: shares a quarter as far
    from an even share as they are; c6: pct of all tracks for each group and the rest by size, at most what there is, and no
    rows where the groups' floors are more than all tracks.
    """
    w = Window.partitionBy()
    n = F.col("tracks").cast("double")
    total, k, least = F.sum(n).over(w), F.count("*").over(w), F.min(n).over(w)
    share, floor = n / total, F.floor(total * pct / 100)
    rows = available.select("grp", "tracks", share.alias("share"), total.alias("total"), floor.alias("floor"), k.alias("k"), least.alias("least"))
    of = {
        "b": F.when(F.col("grp").isin(*big), float(big_cap)).otherwise(n * pct / 100),
        "c1": F.least(F.floor(F.col("least") * pct / 100).cast("double"), n),
        "c2": n * pct / 100,
        "c3": F.col("total") * F.sqrt("share") / F.sum(F.sqrt("share")).over(w),
        "c4": F.col("total") * F.log1p(F.col("share") * 100) / F.sum(F.log1p(F.col("share") * 100)).over(w),
        "c5": F.col("total") * (1 / F.col("k") + (F.col("share") - 1 / F.col("k")) * 0.25),
        "c6": F.least(F.col("floor") + F.floor((F.col("total") - F.col("floor") * F.col("k")) * n / F.col("total") + 1e-9), n),
    }
    if strategy == "c6":
        rows = rows.where(F.col("floor") * F.col("k") <= F.col("total"))
    return rows.select("grp", "tracks", F.floor(of[strategy] + 1e-9).cast("long").alias("target"))


def feasible(targets_: DataFrame) -> DataFrame:
    """One row per strategy (strategy, grp, tracks, target): whether each target can be met, and the spread of shares, best first."""
    share = 100.0 * F.col("target") / F.sum("target").over(Window.partitionBy("strategy"))
    a = targets_.withColumn("share", share).groupBy("strategy").agg(F.bool_and(F.col("target") <= F.col("tracks")).alias("feasible"), F.round(F.max("share") - F.min("share"), 6).alias("spread"))
    return a.withColumn("place", F.row_number().over(Window.orderBy("spread", "strategy")).cast("long"))


def _phases(counts: DataFrame, notes: DataFrame, big: tuple[str, str, str]) -> DataFrame:
    """(phase, place, notes, row, md5, g) of every file with counts: files with another group than the big three first, then by category
    second and first, second only, first only, the others; by notes, then as `row` says (the order of the list, if notes has it)."""
    row = F.col("row") if "row" in notes.columns else F.lit(0)
    groups = F.map_from_entries(F.collect_list(F.struct("grp", "n")))
    has = lambda k: F.max(F.when(F.col("grp") == big[k], 1).otherwise(0))
    a = counts.groupBy("md5").agg(groups.alias("g"), F.min(F.when(F.col("grp").isin(*big), 1).otherwise(0)).alias("phase"), has(0).alias("b0"), has(1).alias("b1"))
    place = F.when(F.col("phase") == 0, 0).when((F.col("b0") == 1) & (F.col("b1") == 1), 0).when(F.col("b1") == 1, 1).when(F.col("b0") == 1, 2).otherwise(3)
    return a.join(notes.select("md5", F.col("total_notes").alias("notes"), row.cast("long").alias("row")), "md5").select("phase", place.alias("place"), "notes", "row", "md5", "g")


def _fits(used: dict[str, int], groups: dict[str, int], caps: dict[str, int], phase: int) -> bool:
    """Take a file's tracks if no group passes its cap; in the first phase a cap of 0 is none."""
    if not all((caps.get(g, 0) == 0 and phase == 0) or used.get(g, 0) + n <= caps.get(g, 0) for g, n in groups.items()):
        return False
    for g, n in groups.items():
        used[g] = used.get(g, 0) + n
    return True


def _with_caps(files: DataFrame, caps: DataFrame) -> DataFrame:
    """The files in their order, behind one row that has the caps (grp, target) in g."""
    head = caps.agg(F.map_from_entries(F.collect_list(F.struct("grp", F.col("target").cast("long")))).alias("g"))
    head = head.select(F.lit(-1).alias("phase"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("notes"), F.lit(0).cast("long").alias("row"), F.lit("").alias("md5"), "g")
    return head.unionByName(files).orderBy("phase", "place", F.desc("notes"), "row", "md5")


def _in_order(files: DataFrame, caps: DataFrame, *columns: str) -> Callable[[], Iterator[Iterator[tuple]]]:
    """What a task reads the files from, as often as it likes, in their order behind the row of caps: batches of (phase, groups, *columns).

    All tasks sort, each writes its range, and the ranges' files are read one after the other: neither the sort's rows nor the read ones pile up in the reader.
    """
    path = folder(files.sparkSession)
    _with_caps(files, caps).write.parquet(path)

    def read() -> Iterator[Iterator[tuple]]:
        import numpy as np
        import pyarrow.parquet as pq

        system, root = tree.place(path)
        parts = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-")]
        for part in sorted(parts, key=lambda p: (int(p.rsplit("/", 1)[1].split("-")[1]), p)):
            with system.open_input_file(part) as f:
                for b in pq.ParquetFile(f).iter_batches(BATCH_FILES, columns=["phase", "g", *columns]):
                    g = b.column("g")
                    known = g.keys.dictionary_encode()
                    keys = np.array(known.dictionary.to_pylist(), object)[known.indices.to_numpy()].tolist()
                    cuts, n = g.offsets.to_pylist(), g.items.to_pylist()
                    groups = (dict(zip(keys[x:y], n[x:y], strict=True)) for x, y in itertools.pairwise(cuts))
                    yield zip(b.column("phase").to_pylist(), groups, *(b.column(c).to_pylist() for c in columns), strict=True)

    return read


def select_balanced(spark: SparkSession, counts: DataFrame, notes: DataFrame, caps: DataFrame, big: tuple[str, str, str]) -> DataFrame:
    """(md5) of the greedy quota selection over counts (md5, grp, n), notes (md5, total_notes[, row]) and caps (grp, target).

    Whether a file fits depends on all taken before it, so the fold is one task's; the sort before it is not, and the task reads
    the sorted rows as a stream and holds the groups' sums alone.
    """
    read = _in_order(_phases(counts, notes, big), caps, "md5")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for _ in frames:  # the one row that starts it
            used: dict[str, int] = {}
            limit: dict[str, int] = {}
            for batch in read():
                out = []
                for phase, g, md5 in batch:
                    if phase < 0:
                        limit = g
                    elif _fits(used, g, limit, phase):
                        out.append(md5)
                yield pd.DataFrame({"md5": out}, dtype="object")

    return spark.range(0, 1, 1, 1).mapInPandas(run, "md5 string")


def calibrate(spark: SparkSession, counts: DataFrame, notes: DataFrame, targets_: DataFrame, big: tuple[str, str, str], goal: DataFrame, low: float = 0.001, high: float = 20.0, rounds: int = 30, tolerance: float = 0.005) -> DataFrame:
    """(scale, total, files): the bisected scale of the targets (grp, target) whose selection has closest to the one row `goal` (goal) of notes.

    Every round folds over all files, and the next one's scale depends on its sum. So one task folds; it reads the sorted files anew in each
    round and holds the groups' sums alone.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for _ in frames:  # the one row that starts it
            a, b, best = low, high, None
            for _ in range(rounds):
                scale, used, caps, want, total, taken = (a + b) / 2, {}, {}, 0, 0, 0
                for batch in read():
                    for phase, g, place, n in batch:
                        if phase < 0:
                            caps, want = ({k: max(1, int(t * scale)) for k, t in g.items()}, want) if place == 0 else (caps, n)
                        elif _fits(used, g, caps, phase):
                            total, taken = total + n, taken + 1
                error = abs(total - want) / max(1, want)
                if best is None or error < best[0]:
                    best = (error, scale, total, taken)
                if error < tolerance:
                    break
                a, b = (scale, b) if total < want else (a, scale)
            yield pd.DataFrame({"scale": [best[1]], "total": [best[2]], "files": [best[3]]})

    files = _phases(counts, notes, big)
    aim = goal.select(F.lit(-1).alias("phase"), F.lit(1).alias("place"), F.col("goal").cast("long").alias("notes"), F.lit(0).cast("long").alias("row"), F.lit("").alias("md5"), F.create_map().cast("map<string,bigint>").alias("g"))
    read = _in_order(files.unionByName(aim), targets_, "place", "notes")
    return spark.range(0, 1, 1, 1).mapInPandas(run, "scale double, total long, files long")


def parse_number_list(text: Column) -> Column:
    """A list written as a Python literal; [] where it can't be read."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


def parse_string_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>", {"allowSingleQuotes": "true"}), F.array().cast("array<string>"))


def parse_python_list(text: Column) -> Column:
    """The quoted strings of a list written as a Python literal, or else its integers as text; never fails."""
    strings = F.regexp_extract_all(text, F.lit("'([^']*)'"), 1)
    return F.coalesce(F.when(F.size(strings) > 0, strings).otherwise(F.regexp_extract_all(text, F.lit("-?[0-9]+"), 0)), F.array().cast("array<string>"))


def with_status(wanted: DataFrame, local: DataFrame, existing: DataFrame) -> DataFrame:
    """Each wanted md5 as skipped (already there), found or missing."""
    rows = wanted.select("md5").distinct().join(local.select("md5", F.lit(1).alias("l")).distinct(), "md5", "left").join(existing.select("md5", F.lit(1).alias("x")).distinct(), "md5", "left")
    return rows.select("md5", F.when(F.col("x").isNotNull(), "skipped").when(F.col("l").isNotNull(), "found").otherwise("missing").alias("status"))
