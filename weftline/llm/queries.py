"""Registered queries of the training-data operators, with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, conversations, language, lexical, licenses, mixing, multiset_hash, ordinal, packing, pii, quality_rules, repeats, simhash
from weftline.llm.common import table
from weftline.llm.sql import CONVERSATIONS, LEXICAL, LICENSES, MIXING, QUALITY_RULES

#: Name of the vocabulary file in the folder of public tokenizers.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, folder, "documents"), tokenizer_path()))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = table(spark, folder, "documents")
    found = language.identify(docs, F.coalesce(~held_out, F.lit(True)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return multiset_hash.fingerprints(table(spark, folder, "documents"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove(table(spark, folder, "documents")).drop("kept")


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return ordinal.rate(table(spark, folder, "documents"), ordinal.graded(table(spark, folder, "labels")))


def op10_mix_to_target_weights(spark: SparkSession, folder: str) -> DataFrame:
    counts = mixing.mix_counts(table(spark, folder, "documents"), mixing.text_size(F.col("text")))
    return counts.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    rows = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path(), decoded="decoded")
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, folder, "conversations")))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_quality_rules,
        op3_language_id,
        op4_simhash_near_dedup,
        op5_document_fingerprints,
        op6_license_scan,
        op7_pii,
        op8_suffix_array_dedup,
        op9_quality_classifier,
        op10_mix_to_target_weights,
        op11_lexical_search,
        op12_bpe_round_trip,
        op13_conversation_repair,
    )
}

SQL: dict[str, str] = {
    "op2_quality_rules": QUALITY_RULES,
    "op6_license_scan": LICENSES,
    "op10_mix_to_target_weights": MIXING,
    "op11_lexical_search": LEXICAL,
    "op13_conversation_repair": CONVERSATIONS,
}
