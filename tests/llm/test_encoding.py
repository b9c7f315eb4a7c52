"""Periodic runs, token files and the alignment of two tokenizers against brute force, on small and on hard tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.llm import alignment, encoders, queries, runs, tokenfiles, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HARD = [
    (1, None), (2, ""), (3, " "), (4, "  "), (5, "a▁b"), (6, "a  b "), (7, " x\n y \n\n z"), (8, "<|endoftext|> <s> </s>x<|endoftext|>"), (9, "é é ﬁ ａ 漢字 　 x\xa0 y"),
    (9, "dup dup"), (9, "dup dup"), (10, "\x00 \x1c a"), (11, "a  b \x85 c"), (None, "null id"), (12, "x" * 5000), (13, "ab " * 3000), (14, "it's don't  \t  1234 😀 😀😀"), (-3, "a b c d " * 9),
]


def hard(spark, rows=HARD):
    """With columns that clash with names that operators use."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit(7).alias(c) for c in ("Text", "row", "ids", "batch", "kind", "b", "n", "start", "h", "w", "runs", "info")])


# --- periodic runs


def brute_runs(t, exponent, least):
    best = {}
    for q in range(1, len(t) // exponent + 1):
        i = 0
        while i + q < len(t):
            s = i
            while i + q < len(t) and t[i] == t[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, exponent * q):
                best.setdefault((s, i + q - s), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_lyndon_words_and_runs_against_all_suffixes():
    rng = random.Random(3)
    for k in range(1500):
        t = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 30))]
        if k % 2 and t:
            s, p = rng.randrange(len(t)), rng.randint(1, 4)
            t[s:] = [t[s + (i % p)] if s + i % p < len(t) else 0 for i in range(len(t) - s)]
        ends, match = runs.lyndon_words([*t, -1])
        for i in range(len(t)):
            j = next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t))
            assert ends[i] == j and match[i] == len(os.path.commonprefix([t[i:], t[j:]])), t
        for exponent, least in ((2, 2), (3, 3), (4, 6)):
            assert runs.find_runs(t, exponent, least) == brute_runs(t, exponent, least), t


def test_lyndon_words_look_at_each_symbol_a_few_times():
    class Counted(list):
        looks = 0

        def __getitem__(self, i):
            Counted.looks += 1
            return super().__getitem__(i)

    n, a, b = 8_000, [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    for t in ([0] * n, b[:n], [i % 2 for i in range(n)], sum(([0] * k + [1] for k in range(125)), []), [i & -i for i in range(1, n)], [bin(i).count("1") & 1 for i in range(n)]):
        for u in (t, [max(t) - x for x in t]):
            Counted.looks = 0
            runs.lyndon_words(Counted([*u, -1]))
            assert Counted.looks < 16 * len(t)


def brute_collapse(words):
    found = brute_runs(words, 4, 6)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return found, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_collapsed_texts(spark):
    rows = [*HARD, (20, "a b c " * 3 + "a b c a"), (21, "z " + "go " * 6 + "stop"), (22, ("x " * 7 + "y ") * 5), (23, " ".join("pq"[i % 2] for i in range(70_000)))]
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed, r.n_words, r.n_removed) for r in runs.collapse_runs(hard(spark, rows)).collect())
    want = []
    for d, t in rows:
        w = WORD.findall(t or "")
        found, kept = brute_collapse(w) if len(w) < 9000 else ([(0, 70_000, 2)], "p q")
        want.append((str(d), found, kept, len(w), len(w) - len(WORD.findall(kept))))
    assert got == sorted(want)
    assert runs.collapse_runs(hard(spark, rows).where("false")).count() == 0


def test_planted_periods_and_digest(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for i in range(300)] + HARD
    got = {}
    for r in runs.run_digest(runs.collapse_runs(runs.plant_periods(hard(spark, rows)))).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    planted = 0
    for d, t in rows:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            planted += 1
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found, kept = brute_collapse(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want = (len(found), *best, best[1] * 1000 // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        assert want in got[d]
    assert planted > 20


# --- token files


@pytest.mark.parametrize("top", [1, 2, 300, 60_000, 1 << 32, (1 << 60) - 2, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
def test_words_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, np.uint64, endpoint=True)
    ids[: n // 4] = 0
    if top > 1 << 60 and n:
        ids[-1] = (1 << 60) - 1
    words, per, escapes, lost = tokenfiles.encode_ids(ids)
    assert per.sum() == len(words) and lost.sum() == len(escapes) == (ids >= (1 << 60) - 1).sum() and len(per) == -(-n // 1024)
    sizes = np.minimum(1024, n - np.arange(len(per)) * 1024)
    assert np.array_equal(tokenfiles.decode_ids(words, per, escapes, sizes), ids)
    first = np.cumsum(per) - per  # blocks stand alone
    for k in range(len(per)):
        held = escapes[lost[:k].sum() : lost[: k + 1].sum()]
        assert np.array_equal(tokenfiles.decode_ids(words[first[k] : first[k] + per[k]], per[k : k + 1], held, sizes[k : k + 1]), ids[k * 1024 : k * 1024 + sizes[k]])


def test_words_hold_as_many_ids_as_fit():
    for bits, count in ((1, 60), (2, 30), (3, 20), (6, 10), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1)):
        words, *_ = tokenfiles.encode_ids(np.full(600, (1 << bits) - (bits == 60) - 1, np.uint64))
        assert len(words) == -(-600 // count)
    assert len(tokenfiles.encode_ids(np.zeros(960, np.uint64))[0]) == 4


def token_rows(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    return [(d, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for d, t in rows]


def test_token_files(spark, tmp_path, monkeypatch):
    rows = [*HARD, *((100 + i, f"text {i} " * (i % 40)) for i in range(200))]
    path, tokenizer = f"file://{tmp_path}/out", queries.tokenizer_path("byte_bpe_50k.json")
    tokenfiles.write_documents(hard(spark, rows), path, tokenizer)
    want = {}
    for d, ids in token_rows(rows):
        want.setdefault(d, []).append(ids.tolist())
    got = tokenfiles.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        assert r.start == start and r.ids in want[r.doc_id]
        start += len(r.ids)
    marks = tokenfiles.read_documents(spark, path, ids=False).orderBy("start").collect()
    assert [tuple(r) for r in marks] == [(r.doc_id, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got]
    # written again in place of it; nothing of the first job stays
    before = set(os.listdir(tmp_path / "out"))
    tokenfiles.write_documents(hard(spark, rows).where("doc_id < 3"), path, tokenizer)
    after = set(os.listdir(tmp_path / "out"))
    assert not before & after - {"_manifest.json"} and tokenfiles.read_documents(spark, path).count() == 3
    tokenfiles.write_documents(hard(spark, rows).where("false"), path, tokenizer)
    assert tokenfiles.read_documents(spark, path).count() == 0 and os.listdir(tmp_path / "out") == ["_manifest.json"]


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    spark.dataSource.register(tokenfiles.TokenFiles)
    bad = F.expr("if(id = 399, raise_error('stop'), array(1, 2, 3))")
    df = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), F.array(F.lit(1)).alias("ids"))
    with pytest.raises(Exception, match="stop"):
        df.withColumn("id", F.col("doc_id")).select("doc_id", bad.alias("ids")).write.format("simple8b").mode("append").save(path)
    assert not any(f.endswith(".s8b") for f in os.listdir(tmp_path / "out"))
    df.write.format("simple8b").mode("append").save(path)
    held = set(os.listdir(tmp_path / "out"))
    with pytest.raises(Exception, match="already"):
        df.write.format("simple8b").mode("append").save(path)
    assert set(os.listdir(tmp_path / "out")) == held


def test_files_roll_and_bad_files_are_found(tmp_path, monkeypatch):
    import pyarrow as pa

    system, place = tokenfiles._place(str(tmp_path))
    monkeypatch.setattr(tokenfiles, "BUFFER", 4096)
    monkeypatch.setattr(tokenfiles, "READ_IDS", 2048)
    rng = np.random.default_rng(0)
    counts = np.r_[0, rng.integers(0, 5000, 40), 0, 0]
    ids = rng.integers(0, 50_000, counts.sum()).astype(np.uint32)
    out = tokenfiles.FileWriter(system, f"{place}/a.s8b", pa.int64())
    cut = int(counts[:20].sum())
    out.add(pa.array(range(20), pa.int64()), counts[:20], ids[:cut])
    out.add(pa.array(range(20, 43), pa.int64()), counts[20:], ids[cut:])
    assert out.close() == {"file": "a.s8b", "n_docs": 43, "n_ids": len(ids)}
    read = list(tokenfiles.read_file(system, f"{place}/a.s8b"))
    assert len(read) > 5 and np.array_equal(np.concatenate([x for *_, x in read]), ids) and np.array_equal(np.concatenate([c for _, c, _ in read]), counts)
    assert [k for keys, *_ in read for k in keys.to_pylist()] == list(range(43))
    raw = (tmp_path / "a.s8b").read_bytes()
    for k, broken in enumerate((raw[:-1], raw[:5], raw[:100] + bytes([raw[100] ^ 1]) + raw[101:])):
        (tmp_path / f"{k}.s8b").write_bytes(broken)
        with pytest.raises(ValueError, match="token file|differ"):
            list(tokenfiles.read_file(system, f"{place}/{k}.s8b"))


@pytest.mark.parametrize("plain", [False, True])
def test_part_ids_are_the_librarys(plain, monkeypatch):
    coder = encoders.PartIds(queries.tokenizer_path("byte_bpe_50k.json"), plain)
    rng = random.Random(5)
    texts = [t or "" for _, t in HARD]
    texts += ["".join(rng.choice(["a", "bc", " ", "  ", "\n", "\t", "\xa0", "\x1c", " ", "'s", "12", "<|endoftext|>", ".", ",", "x,", "é", "​"]) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    want = coder.encode(texts)
    for _ in range(2):  # from the library, then from memory
        ids, counts = coder.texts(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    import pyarrow as pa

    buf, offsets = words.string_parts(pa.array(texts))
    coder2 = encoders.ByteIds(queries.tokenizer_path("byte_bpe_50k.json"), plain)
    for _ in range(2):
        ids, counts = coder2.buffer(buf[: offsets[-1]], offsets)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert coder2.table.size > 100
    monkeypatch.setattr(encoders, "REMEMBERED", 10)
    assert coder.texts(texts[:9])[0].tolist() == sum(want[:9], [])


# --- alignment


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    back = alignment._byte_of()
    a_bytes = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in a_tok.get_vocab().items()}

    def b_bytes(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()

    out, count = [], Counter()
    for d, t in rows:
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        x, y = [a_bytes[i] for i in a], [b_bytes(i) for i in b]
        groups, links, i, j = [], [], 0, 0
        if t and b"".join(x) == b"".join(y) == (" " + t).encode():
            a_end, b_end = ({int(e): k for k, e in enumerate(np.cumsum([len(p) for p in z]))} for z in (x, y))
            for e in sorted(a_end.keys() & b_end.keys()):
                groups.append(",".join(map(str, a[i : a_end[e] + 1])) + "|" + ",".join(map(str, b[j : b_end[e] + 1])))
                links.append((a[a_end[e]], b[b_end[e]]))
                i, j = a_end[e] + 1, b_end[e] + 1
        else:
            a, b = [], []
        count.update(links)
        out.append((d, len(a), len(b), groups, links))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted((str(d), a, b, len(g), len(k), ";".join(g), sum(count[p] == top[p[1]] for p in k), sum(count[p] for p in k)) for d, a, b, g, k in out), count


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, small, monkeypatch):
    if small:  # many batches, ids dealt over several tasks
        for name, value in (("BATCH_DOCS", 2), ("BATCH_LINKS", 50), ("HELD", 20), ("SHARE", 3)):
            monkeypatch.setattr(alignment, name, value)
    rng = random.Random(2)
    vocabulary = ["the", "theatre", "walk", "walking", "naïve", "x1", "\n", "foo-bar", "Überfluß", "。"]
    rows = HARD + [(50 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    paths = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    want, count = brute_alignment(rows)
    got = alignment.align_documents(spark, hard(spark, rows), *paths)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    if not small:
        assert {(r.a, r.b): r.total for r in alignment.pair_counts(spark, hard(spark, rows), *paths).collect()} == dict(count)
        marks = alignment.align_documents(spark, hard(spark, rows), *paths, digest=True).select("n_groups", "groups").collect()
        assert {r.groups for r in marks} == {hashlib.sha256(w[5].encode()).hexdigest() if w[5] else "" for w in want}
        assert alignment.align_documents(spark, hard(spark, rows).where("false"), *paths).count() == 0
