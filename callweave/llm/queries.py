"""The registered queries of this subpackage: thin projections of its operators onto their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, jaccard, linkgraph, manifest, mixing, oracles, periodic, pii, quality, simhash, suffixes, toxicity, warc
from .common import scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path, F.col("html"), F.col("page_id"), F.col("url"))
    records = warc.salvaged(spark, path, scratch_path(spark, "warc-log"), with_payload=False)
    return records.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.lower("payload_digest").alias("payload_digest"),
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"), radius=3, shingle=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linkgraph.judge_urls(table(spark, sf_dir, "pages"), linkgraph.RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, sf_dir, "documents"), n=4, percent=85)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, of which every tenth by its id's checksum first repeats its own words."""
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = periodic.periodic_runs(table(spark, sf_dir, "documents"), seed=seed, rewrite=periodic.planted)
    return out.drop("n_words")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; those whose id has an even checksum are checked with their line ends deleted."""
    fields = lambda text: [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = F.when(even & F.contains("text", F.lit("\n")), manifest.leaf_digest(fields(F.replace("text", F.lit("\n")))))
    return manifest.manifest(table(spark, sf_dir, "documents"), "doc_id", "source", manifest.leaf_digest(fields(F.col("text"))), altered)


def queries() -> dict[str, Query]:
    found = (op1_mix_sources, op2_warc_salvage, op3_pii_spans, op4_main_text, op5_suffix_dedup, op6_simhash_classes, op7_toxicity, op8_url_verdicts, op9_quality_rules, op10_decontaminate, op11_jaccard_join, op12_periodic_runs, op13_merkle_manifest)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The other queries are held against brute force in the tests."""
    return {"op2_warc_salvage": oracles.WARC, "op9_quality_rules": oracles.QUALITY, "op11_jaccard_join": oracles.JACCARD, "op13_merkle_manifest": oracles.MANIFEST}
