"""Frequency distributions: counts, counts of counts, quantiles by rounded rank."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch


def distribution(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))


def frequencies(dist: DataFrame) -> DataFrame:
    return dist.groupBy(F.col("n").alias("value")).agg(F.count("*").alias("n"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("value").agg(F.sum("n").alias("n"))


def running_total(dist: DataFrame, scratch: Scratch, parts: int = 32) -> DataFrame:
    """``dist`` with the sum of ``n`` up to each value. Values are dealt to ranges; totals of ranges, as many as there are, give
    each its offset, and no task holds more than a range."""
    ranged = scratch.table(dist.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("part").agg(F.sum("n").alias("inside"))
    before = before.select("part", (F.sum("inside").over(Window.orderBy("part")) - F.col("inside")).alias("before"))
    inner = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    return ranged.join(F.broadcast(before), "part").select("value", "n", (F.col("before") + inner).alias("cum"))


def quantiles(dist: DataFrame, q: int) -> DataFrame:
    """(k, value) for k = 0..q: the least value, then the least whose cumulative count reaches total * k / q, rounded. No rows
    for q = 0 or no data."""
    spark = dist.sparkSession
    cum = running_total(dist, Scratch(spark, "quantiles"))
    total = cum.agg(F.max("cum").alias("total"))
    ks = spark.range(q + 1 if q else 0).select(F.col("id").cast("int").alias("k")).crossJoin(F.broadcast(total)).where("total is not null")  # one row of totals
    need = ks.select("k", F.greatest(F.lit(1), F.round(F.col("total") * F.col("k") / q)).alias("need"))
    reached = F.filter(F.col("needs"), lambda x: x["need"] <= F.col("cum"))
    needs = need.agg(F.collect_list(F.struct("k", "need")).alias("needs"))  # q + 1 entries
    rows = cum.crossJoin(F.broadcast(needs)).select("value", F.explode(reached).alias("x"))
    return rows.groupBy(F.col("x.k").alias("k")).agg(F.min("value").alias("value"))


def quartiles_row(dists: DataFrame, by: str) -> DataFrame:
    """(by, total, min, q1, median, q3, max) of distributions (``by``, value, n): a line of a report each."""
    w = Window.partitionBy(by).orderBy("value")
    cum = dists.withColumns({"cum": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy(by))})
    at = lambda k: F.min(F.when(F.col("cum") >= F.greatest(F.lit(1), F.round(F.col("total") * k / 4)), F.col("value")))
    return cum.groupBy(by).agg(F.first("total").alias("total"), *[at(k).alias(n) for k, n in enumerate(("min", "q1", "median", "q3", "max"))])


def per_file(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, nodes, edges): what indexing a file made. ``edges`` have the file that they belong to."""
    n = nodes.groupBy("file").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("file").agg(F.count("*").alias("edges"))
    return n.join(e, "file", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
