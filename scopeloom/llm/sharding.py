"""Contiguous, byte-balanced shards from global prefix sums."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, carried, ship, shuffle_partitions, uncarried

ship(__name__)


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, carry: bool = False) -> DataFrame:
    """Cut the documents, in order of id, into ``n_shards`` runs of nearly equal bytes.

    One range shuffle puts rows into global order. Each partition reports its bytes and rows (a few numbers per partition,
    so the driver's share is bounded by the number of partitions, not of rows); their prefix sums give each partition its
    offset, and each row the bytes before it. A row goes to the shard in which its middle byte falls: shard sizes differ by
    at most about one row.

    Returns id, size (UTF-8 bytes plus ``overhead``), text_crc32, shard, slot (position in its shard, from 0), and with
    ``carry`` all columns of ``docs`` besides.

    Null text: size ``overhead``, checksum 0. Null id: before all others. Rows of one id are ordered by size and
    checksum; equal rows are interchangeable, each gets a slot of its own. Empty table: empty result. Further columns are
    ignored, or with ``carry`` kept; those with the names of result columns are replaced.
    """
    spark = docs.sparkSession
    made = ["size", "text_crc32", "shard", "slot"]
    size = (F.coalesce(F.octet_length(F.col("_text")), F.lit(0)).cast("long") + overhead).alias("size")
    crc = F.crc32(F.coalesce(F.col("_text"), F.lit("")).cast("binary")).alias("text_crc32")
    kept = docs.columns if carry else []
    keyed = carried(docs, [id_col, text_col], kept).toDF("_id", "_text", "_kept").select("_id", size, crc, "_kept")
    order = [F.col("_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    sorted_ = keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    schema = StructType([*sorted_.schema.fields]).add("_bytes", "long").add("_row", "long")

    def within(batches):
        """Bytes and rows before each row in its partition."""
        n_bytes, n_rows = 0, 0
        for b in batches:
            size = b.column("size").to_numpy(zero_copy_only=False)
            ends = n_bytes + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - size), pa.array(np.arange(n_rows, n_rows + len(size)))], schema.names)
            n_bytes, n_rows = int(ends[-1]) if len(ends) else n_bytes, n_rows + len(size)

    # range bounds are sampled anew in each run: the order is fixed by writing it, together with the places in it
    placed = Scratch(spark, "shards").table(sorted_.mapInArrow(within, schema), "placed")
    totals = sorted(placed.groupBy("_part").agg(F.sum("size"), F.count("*")).collect())
    offsets, n_bytes, n_rows = [], 0, 0
    for part, b, n in totals:
        offsets.append((part, n_bytes, n_rows))
        n_bytes, n_rows = n_bytes + b, n_rows + n
    # as many rows as there are partitions
    joined = placed.join(F.broadcast(spark.createDataFrame(offsets, "_part int, _bytes_before long, _rows_before long")), "_part")
    twice_middle = (2 * (F.col("_bytes") + F.col("_bytes_before")) + F.col("size")).cast("decimal(28,0)")
    shard = F.least(F.lit(n_shards - 1), F.floor(twice_middle * F.lit(n_shards).cast("decimal(9,0)") / F.lit(max(2 * n_bytes, 1)).cast("decimal(28,0)")).cast("int"))
    cut = joined.select("_id", "_kept", "size", "text_crc32", shard.alias("shard"), (F.col("_row") + F.col("_rows_before")).alias("_row"))
    first = {r[0]: r[1] for r in cut.groupBy("shard").agg(F.min("_row")).collect()}  # n_shards numbers
    start = F.element_at(F.array(*[F.lit(first.get(i, 0)).cast("long") for i in range(n_shards)]), F.col("shard") + 1)
    numbered = cut.withColumn("slot", F.col("_row") - start)
    return uncarried(numbered, [], kept, made) if carry else numbered.select(F.col("_id").alias(id_col), *made)
