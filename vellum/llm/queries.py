"""The queries of this subpackage: ``opN_<name>`` over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, linededup, merkle, packing, pitmanyor, quality, reshard, rules, simhash, suffixes, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, fingerprints within two bits."""
    out = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without any string of 200 bytes that occurs more than once."""
    out = suffixes.repeats(_table(spark, sf_dir, "documents"), length=200, keep="none")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that contain four fifths of a benchmark item's five-word shingles."""
    found = decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned outside the fold crc32(doc_id) mod 5 = 0."""
    docs = _table(spark, sf_dir, "documents")
    scores = toxicity.toxicity_scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    held = F.coalesce(quality.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned outside the fold crc32(doc_id) mod 4 = 2."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all documents and the verdict of the latest policy."""
    entries = rules.ledger(_table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rules.failing("base").alias("base_failed"), rules.passes("v2").alias("kept"), "failed",
    )


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes, moving as few bytes as can be."""
    placed = reshard.reshard(_table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeats of line runs of fifty words or more."""
    out = linededup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash trees of all documents by source, every document's path, and the roots after tampering."""
    return merkle.checked(_table(spark, sf_dir, "documents"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, learned outside the fold crc32(doc_id) mod 7 = 2."""
    return pitmanyor.held_out_scores(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged for fill-in-middle training, and rebuilt, as digests."""
    return fim.digests(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_suffix_dedup, op3_decontamination, op4_token_counts, op5_toxicity, op6_quality, op7_packing, op8_quality_rules, op9_resharding, op10_line_dedup, op11_merkle_manifest, op12_lm_scores, op13_fill_in_middle)}

ORACLE_SQL: dict[str, str] = {"op3_decontamination": decontaminate.oracle_sql(), "op10_line_dedup": linededup.oracle_sql(), "op11_merkle_manifest": merkle.oracle_sql(), "op13_fill_in_middle": fim.oracle_sql()}
