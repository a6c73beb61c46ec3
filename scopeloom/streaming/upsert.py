"""Re-indexing on change: a stream of file versions kept as the latest version per key, and folders that come and go."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import path_descendant_of
from ..sources.versions import Versions


class Upsert:
    """``foreachBatch`` target: a table by key in ``path``, replaced where a batch brings a newer version.

    The folder is the only state, and a commit names its batch: after a restart the table goes on from the last commit, and a
    batch that is run again after a failure changes nothing. A batch rewrites the buckets of its keys only.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], schema: str, buckets: int = 16):
        self.key, self.order, self.versions = key, order, Versions(spark, path, {"rows": schema}, key, buckets)

    def table(self) -> DataFrame:
        return self.versions.read("rows")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        done = self.versions.manifest()["note"]
        if done is not None and batch_id <= done:
            return
        batch = batch.persist()
        try:
            rows = self.versions.read_keys("rows", batch)
            rows = rows.unionByName(batch.select(*rows.columns))
            rest = [c for c in rows.columns if c != self.key]
            latest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("r")).select(self.key, "r.*")
            self.versions.replace(batch, {"rows": latest}, batch_id)
        finally:
            batch.unpersist()


def run(stream: DataFrame, target: Upsert, checkpoint: str) -> DataFrame:
    """Process what is there, and return the table."""
    q = stream.writeStream.foreachBatch(target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return target.table()


def change_folders(index, removed: list[str], added: list[str], files: DataFrame) -> DataFrame:
    """Files at or below removed folders leave the index; the result are the files (file, ...) below added ones, to be indexed."""
    for folder in removed:
        index.clean(folder)
    wanted = F.lit(False)
    for folder in added:
        wanted |= path_descendant_of(F.col("file"), F.lit(folder))
    return files.where(wanted)
