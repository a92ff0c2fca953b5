"""The queries of the operators for training text, one for each, with production parameters, and the SQL of those that have any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wavelane.llm import context_mixing
from wavelane.llm.filter_audit import interaction_audit
from wavelane.llm.fingerprint import fingerprints
from wavelane.llm.language_id import LanguageModel, identify, labelled_texts
from wavelane.llm.near_dup import near_duplicates
from wavelane.llm.oracles import ORACLES
from wavelane.llm.packing import pack
from wavelane.llm.piece_codec import round_trips
from wavelane.llm.quality import assess, fit_field
from wavelane.llm.sentence_spans import RUN_WORDS, remove_repeats
from wavelane.llm.shared import documents, fold
from wavelane.llm.spelling import spelling_variants
from wavelane.llm.suffix_levels import remove_repeated_bytes
from wavelane.llm.token_counts import count_tokens
from wavelane.llm.toxicity import fit_classifier, score_texts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_classifier(docs, labels, fold("doc_id", 5) != 0)
    return score_texts(docs, model, fold("doc_id", 5) == 0)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


def op4_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(documents(spark, sf_dir)).drop("removed")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = LanguageModel.fit(labelled_texts(docs, fold("doc_id", 4) != 2))
    return identify(docs, model).withColumn("held_out", fold("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score", "n_bytes", "bits")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return assess(docs, fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), rate=0.1, seed=17)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), run_words=RUN_WORDS).select("doc_id", "n_sentences", "n_removed", "n_cut", "text")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only words that the lexicon lacks leave their document; training is on four fifths of the documents, scoring on all."""
    held_out = fold("doc_id", 5) == 1
    return context_mixing.score_texts(documents(spark, sf_dir), ~held_out, held_out)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_packing, op4_suffix_levels, op5_language_id, op6_quality_rules, op7_merge_dropout, op8_fingerprints, op9_sentence_spans, op10_near_dup, op11_spelling_variants, op12_context_mixing, op13_filter_audit)}

__all__ = ["ORACLES", "QUERIES"]
