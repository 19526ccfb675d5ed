"""The registered query of each corpus operator: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, langid, manifest, merkle, packing, pii, secret_scan, sharding, simhash, suffix_dedup, toxicity
from .common import joined_spans, read_table


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.scan(_documents(spark, sf_dir), "doc_id")
    counts = [_count("findings", k) for k in ("assign", "access", "hex")]
    base = F.filter("findings", lambda s: s.kind.isin(*(r.kind for r in secret_scan.RULES)))
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("findings")).alias("spans"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_documents(spark, sf_dir))


def op3_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op4_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_matrices(_documents(spark, sf_dir))


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_edits(_documents(spark, sf_dir))


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_documents(spark, sf_dir).select("doc_id", "text"))
    counts = [_count("pii", k) for k in pii.BASE]
    # In the order of spans: the prior of the kind, or more with a context word.
    scores = F.array_join(F.transform("pii", lambda s: F.format_string("%.3f", s.score)), ",")
    base = F.filter("pii", lambda s: s.kind.isin(*pii.BASE))
    return found.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("pii")).alias("spans"), scores.alias("scores"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op12_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    records = _documents(spark, sf_dir).select("doc_id", sharding.text_size(text).alias("size"), crc, sharding.text_group(text).alias("group"))
    return sharding.place(records).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.document_manifest(_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_suffix_array_dedup, op3_simhash_bk_tree, op4_packed_matrices, op5_merkle_fingerprints, op6_toxic_segments, op7_pii, op8_decontaminate, op9_best_fit_packing,
        op10_language_id, op11_collocations, op12_sampled_shards, op13_merkle_manifest,
    )
}
