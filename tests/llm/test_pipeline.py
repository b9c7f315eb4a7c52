"""The pipeline's stages on a small folder of tables, each against a plain version on what the one before it kept."""

import collections
import zlib

import numpy as np
import pytest
from test_llm import DOCS, components_of, corpus
from tokenizers import Tokenizer

import corpus_pipeline
from strophe.llm import queries, quality

EXTRA = "k1 string, Score string, __quality string, n_words int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    item = " ".join(f"word{i}" for i in range(30))
    good = [(1000 + i, "\n".join(" ".join(f"t{i}l{k}w{j}" for j in range(12)) + "." for k in range(3)), "en", "s", 1) for i in range(120)]
    bad = [(2000 + i, "\n".join([f"buy{i} buy{i} now{i} now{i}"] * 8), "en", "s", 1) for i in range(120)]
    rows = corpus() + good + bad + [(5000, f"clean text before {item} and after", "en", "s", 1), (None, "text without an id but with some words", "en", "s", None)]
    rows = [(*r, "k", "s", "q", 5) for r in rows]
    spark.createDataFrame(rows, f"{DOCS}, {EXTRA}").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 2000)) for i in [*range(1000, 1120), *range(2000, 2120)]], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def kept(spark, folder, tmp_path_factory):
    """What goes into every stage, and what comes out of the last."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage"))
        stage(spark, out[-1], folder).write.mode("overwrite").parquet(path)
        out.append(spark.read.parquet(path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out[-1].columns == docs.columns
    return [sorted(map(tuple, x.collect()), key=repr) for x in out]


def words(text):
    return (text or "").encode().split()


def test_quality_stage(spark, folder, kept):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = quality.fit_quality(spark, docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {(r.doc_id, r.text) for r in quality.score_quality(docs, model).where("score >= 0.7").collect()}
    assert kept[1] == [r for r in kept[0] if r[:2] in good]
    ids = {r[0] for r in kept[1] if r[0] is not None}
    assert len(ids & set(range(1000, 1120))) >= 115 and len(ids & set(range(2000, 2120))) <= 5


def test_near_duplicate_stage(kept):
    rows = {i: [w.lower() for w in words(r[1])] for i, r in enumerate(kept[1])}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in rows.items()}
    groups = collections.defaultdict(list)
    for i, least in components_of(sets, 80).items():
        groups[least].append(kept[1][i])
    stay = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert kept[2] == sorted(stay, key=repr) and len(kept[2]) < len(kept[1])


def test_substring_stage(kept):
    texts = [words(r[1]) for r in kept[2]]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    want = collections.Counter()
    for r, w in zip(kept[2], texts, strict=True):
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        want[r[0], tuple(x for k, x in enumerate(w) if k not in gone)] += 1
    assert collections.Counter((r[0], tuple(words(r[1]))) for r in kept[3]) == want
    assert sum(len(words(r[1])) for r in kept[3]) < sum(map(len, texts)) and all(r[4] == len(r[1]) or r[0] is None for r in kept[3] if r[1] != next((x[1] for x in kept[2] if x[0] == r[0]), None))


def test_decontamination_stage(kept):
    assert [r for r in kept[3] if r[0] != 5000] == kept[4] and any(r[0] == 5000 for r in kept[3])


def test_packing_stage(spark, kept):
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = collections.Counter()
    for r in kept[4]:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for p, k in enumerate(range(0, len(ids), 4096)):
            want[r[0], p, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert collections.Counter(r[:5] for r in kept[5]) == want
    by = collections.defaultdict(list)
    for r in kept[5]:
        by[r[5]].append((r[6], r[3]))
    assert all([o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 4096 for b in by.values())
    assert len(by) <= -(-sum(r[3] for r in kept[5]) // 4096) + 1


def test_run_is_the_stages_in_a_row(spark, folder, kept):
    out = corpus_pipeline.run(spark, folder)
    assert collections.Counter(tuple(r)[:5] for r in out.collect()) == collections.Counter(r[:5] for r in kept[5])


def test_empty_documents(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
