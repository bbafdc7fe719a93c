"""The queries of this subpackage, with the parameters they run with, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chatrepair, decontam, filteraudit, hostrules, linededup, mixing, ngramjoin, oracles, packing, pii, secret_scan, tokencount, urlrules


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), vocabulary=vocabulary("word_bpe_49k.json")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup(docs)
    return out.select("doc_id", "text", F.size("removed_lines").cast("long").alias("n_removed"), F.array_join(F.transform("removed_lines", lambda n: n.cast("string")), ",").alias("removed"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents")).drop("key")


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.geoloom.pii.key", None)
    return pii.digest(pii.protect(table(spark, sf_dir, "documents"), key.encode() if key else pii.OPEN_KEY, open_key=key is None))


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.rotate(table(spark, sf_dir, "conversations")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatrepair.digest(chatrepair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict:
    return {
        "op1_harmonic_packing": op1_harmonic_packing,
        "op2_secret_scan": op2_secret_scan,
        "op3_decontamination": op3_decontamination,
        "op4_line_dedup": op4_line_dedup,
        "op5_url_rules": op5_url_rules,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_pii_pseudonyms": op7_pii_pseudonyms,
        "op8_perspective_rotation": op8_perspective_rotation,
        "op9_token_counts": op9_token_counts,
        "op10_host_rules": op10_host_rules,
        "op11_filter_audit": op11_filter_audit,
        "op12_source_mix": op12_source_mix,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for all but packing, token counts, guess costs and keyed pseudonyms, which SQL can't express; tests hold those against brute force."""
    return {
        "op3_decontamination": oracles.OP3,
        "op4_line_dedup": oracles.OP4,
        "op5_url_rules": oracles.OP5,
        "op6_ngram_jaccard_join": oracles.OP6,
        "op8_perspective_rotation": oracles.OP8,
        "op10_host_rules": oracles.OP10,
        "op11_filter_audit": oracles.OP11,
        "op12_source_mix": oracles.OP12,
        "op13_conversation_repair": oracles.OP13,
    }
