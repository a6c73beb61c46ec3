"""Queries over the synthetic tables, one per operator; ``ORACLES`` is the SQL that checks those it can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed_codes, katz_lm, line_dedup, mixing, repeats, sharding, simhash_vp, toxicity, url_graph
from .oracles import ORACLES


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_template_dedup(spark, sf_dir):
    out = line_dedup.drop_recurring_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_katz_backoff(spark, sf_dir):
    return katz_lm.score_corpus(_read(spark, sf_dir, "documents"))


def op3_byte_prefix_shards(spark, sf_dir):
    out = sharding.shard_by_bytes(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_prefix_free_repeats(spark, sf_dir):
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"))


def op5_prefix_filtered_decontamination(spark, sf_dir):
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_host_trust(spark, sf_dir):
    return url_graph.judge_urls(_read(spark, sf_dir, "pages"))


def op7_simhash_vantage_tree(spark, sf_dir):
    out = simhash_vp.simhash_components(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_rotated_codes(spark, sf_dir):
    return embed_codes.near_embeddings(_read(spark, sf_dir, "embeddings"))


def op9_temperature_mixing(spark, sf_dir):
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op10_compression_toxicity(spark, sf_dir):
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_line_template_dedup, op2_katz_backoff, op3_byte_prefix_shards, op4_prefix_free_repeats, op5_prefix_filtered_decontamination, op6_host_trust, op7_simhash_vantage_tree, op8_rotated_codes, op9_temperature_mixing, op10_compression_toxicity)}

__all__ = ["ORACLES", "QUERIES"]
