"""The corpus pipeline: quality rules, language, near-duplicates, repeated passages, packing.

Each stage takes the documents that the one before it has kept, as a table in shared storage,
and is judged by its own input. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wavelane.llm.language_id import LanguageModel, keep_identified, labelled_texts
from wavelane.llm.near_dup import near_duplicates
from wavelane.llm.packing import pack
from wavelane.llm.quality import fit_field, keep_content
from wavelane.llm.sentence_spans import RUN_WORDS, remove_repeats
from wavelane.llm.shared import documents, fold, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content; null and empty texts go, repeated rows stay or go together."""
    return keep_content(docs, fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, learned from three quarters of the stage's input; texts without a letter go."""
    return keep_identified(docs, LanguageModel.fit(labelled_texts(docs, fold("doc_id", 4) != 2)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; documents without an id stay.

    Shingles of five words and a similarity of 0.8.
    """
    gone = near_duplicates(docs, size=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences, and runs of over 50 words, that came earlier; n_chars is counted again.

    Null and empty texts stay as they are, and so do rows without a doc_id; all other columns are kept, whatever their names.
    """
    names = ["_n_sentences", "_n_removed", "_n_cut", "_removed"]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    left = remove_repeats(docs, run_words=RUN_WORDS, names=tuple(names))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 2048; null and empty texts have the end id only, repeated rows are packed each."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: The stages can't be expressed in SQL; run() is tested against brute-force versions of them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
