"""Shared pieces of the training-data operators: scratch tables, connected components, text helpers.

Intermediate results are written as Parquet below the shared folder that ``spark.checkpoint.dir`` names, so that a lost
executor never takes the only copy along. Only where that setting is absent (tests) a local folder is made.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, shared_dir, ship

__all__ = ["Scratch", "ascii_lower", "broadcast_if_small", "carried", "connected_components", "merge", "roots", "shared_dir", "ship", "shuffle_partitions", "uncarried"]

ship(__name__)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept. ``lower`` does so where no other character has a lower case; ``translate`` is slow."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, low))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes up to which the small side of a join is broadcast.
BROADCAST_BYTES = 64_000_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if its rows, as text, have at most ``most`` bytes in sum; else Spark chooses a shuffle join."""
    return F.broadcast(df) if (df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16)).first()[0] or 0) <= most else df


def carried(docs: DataFrame, used: list[str], keep: list[str] | None) -> DataFrame:
    """The columns ``used`` as they are, and those in ``keep`` as one struct ``_kept``, where no name of theirs can clash."""
    keep = [F.col(f"`{c}`") for c in keep or []]
    return docs.select(*[F.col(f"`{c}`") for c in used], F.struct(*keep, F.lit(0).alias("_")).alias("_kept"))


def uncarried(df: DataFrame, first: list[str], keep: list[str] | None, made: list[str]) -> DataFrame:
    """``first``, the columns that ``carried`` put away, and ``made``, which replaces columns of the same name."""
    taken = {c.lower() for c in (*first, *made)}
    back = [F.col("_kept").getField(c).alias(c) for c in keep or [] if c.lower() not in taken]
    return df.select(*first, *back, *made)


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (a, b): the smallest node that it reaches.

    Alternating large and small stars on written tables: each round shrinks the depth of every tree by a constant factor,
    all state stays distributed, and the neighbourhood of a hub is only aggregated with ``min`` (partial sums first) and
    joined, never gathered. A self loop keeps its node.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both if large else both.where("v <= u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = near.join(least, "u")
        out = joined.where("v > u" if large else "v < u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not large:  # the node itself joins the smallest neighbour
            out = out.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.where("a < b").distinct()

    nodes = scratch.table(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct(), "cc-nodes")
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    before, k = None, 0
    while True:
        now = scratch.table(now if k == 0 else star(star(now, True), False), f"cc-{k}")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if k > 1:
            scratch.drop(f"cc-{k - 2}")
        if tuple(mark) == before:
            break
        before, k = tuple(mark), k + 1
        if k > max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now.select(F.col("b").alias("node"), F.col("a").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of index pairs; roots are the smallest indices."""
    while len(a):
        parent = roots(parent)
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    return roots(parent)
