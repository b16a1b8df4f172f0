"""One query for each operator of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoweave.llm import decontam, langid, licenses, lines, manifest, mixing, neardup, quality, resample, secrets, sharding, toolcalls, urlrules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed n-gram log-likelihood ratio with deterministic thresholding."""
    return quality.quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates as token automata, and the places of the base phrases."""
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte convolutional network over fixed-length windows of whole texts."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CGK embeddings and bit-sampling LSH, confirmed by exact edit distance: one row per leak."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of all conversations, hash-joined, ordered, validated, as canonical JSON."""
    return toolcalls.link(*toolcalls.from_turns(table(spark, sf_dir, "conversations")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental blob ledger, begun anew: every distinct text is scanned once."""
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort-merge range join of reversed-host keys with nested rules."""
    return urlrules.judge(table(spark, sf_dir, "pages"))


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal counts along a Hilbert curve over size, source and language."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempered source weights, realised as budgeted block permutations."""
    return mixing.mixed_ids(table(spark, sf_dir, "documents"))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd sketches over MinHash samples, confirmed on full sets of 2-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle trees by language under one root, with a proof for every row and the fold of tampered ones."""
    return manifest.manifest(table(spark, sf_dir, "documents")).drop("lang", "place", "path")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by hashed n-gram importance weights towards the benchmark's texts."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in the one with the largest id."""
    return lines.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_license_scan, op3_language_id, op4_benchmark_decontamination, op5_tool_call_linking,
        op6_secret_scan, op7_url_filter, op8_hilbert_sharding, op9_temperature_mixing, op10_minhash_neardup,
        op11_merkle_manifest, op12_importance_resampling, op13_line_dedup,
    )
}
ORACLE: dict[str, str] = {
    "op6_secret_scan": secrets.oracle(),
    "op7_url_filter": urlrules.oracle(),
    "op11_merkle_manifest": manifest.oracle(),
    "op12_importance_resampling": resample.oracle(),
    "op13_line_dedup": lines.oracle(),
}
