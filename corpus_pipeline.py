"""The corpus pipeline: toxicity, near copies, benchmark passages, source weights, shards.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of documents
(the last one adds the shard). Between stages the rows are written as Parquet in the shared folder and read again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeloom.llm import decontam, mixing, near_copies, sharding, toxicity
from scopeloom.llm.common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(docs: DataFrame) -> DataFrame:
    """Each row also as one struct, which operators carry along whatever its columns are called."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    scored = toxicity.score_documents(_whole(docs), _table(spark, sf_dir, "labels"), keep=["row"])
    return scored.where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (Jaccard similarity of five-word shingles 0.8 or more; candidates from SimHash and vantage-point
    trees first, MinHash bands for those beyond its reach), the document with the smallest id stays."""
    return near_copies.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a whole window of a benchmark item go."""
    judged = decontam.contamination(_whole(docs), _table(spark, sf_dir, "benchmark"), keep=["row"])
    return judged.where("not contaminated").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated by their temperature weights; every document stays at least once."""
    return mixing.repeat_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contiguous shards of nearly equal bytes, with every row's place in its shard."""
    return sharding.shard_by_bytes(docs, carry=True)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_benchmark), ("mixing", mix), ("sharding", shard)]

#: Compression lengths and XXH64 fingerprints have no SQL form; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = _table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            scratch.drop(before)
        before = name.replace(" ", "-")
    return docs
