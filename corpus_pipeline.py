"""A training corpus from raw documents: STAGES in order, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import decontaminate, frames, minhash, packing, quality, store, substring
from strophe.llm.queries import REJECT_BELOW, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores below 0.7 go."""
    store.small_batches(spark)
    model = quality.fit_quality(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = frames.fresh("quality", docs)
    scored = frames.numbered(quality.score_quality(docs, model, score))
    return scored.where(F.col(f"c{len(docs.columns)}") >= REJECT_BELOW).select(*frames.named(scored, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays (five words, similarity 0.8)."""
    return minhash.drop_near_duplicates(spark, docs, 5, 80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows of 35 words go; n_chars follows where a text changed."""
    cut = frames.numbered(substring.drop_repeats(spark, docs, 35, counts=(frames.fresh("n_words", docs), frames.fresh("n_removed", docs))))
    cols = frames.named(cut, docs.columns)
    if "n_chars" in docs.columns:
        at, text, removed = docs.columns.index("n_chars"), frames.place(docs, "text"), len(docs.columns) + 1
        cols[at] = F.when(F.col(f"c{removed}") > 0, F.char_length(f"c{text}").cast(docs.schema[at].dataType)).otherwise(F.col(f"c{at}")).alias("n_chars")
    return cut.select(*cols)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    store.small_batches(spark)
    return decontaminate.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes in sequences of 4096 tokens."""
    return packing.pack(spark, docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The first and last stages are a trained model and a search; no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = store.Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.save(docs, "snappy")
    return docs
