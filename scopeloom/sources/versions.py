"""Tables kept by key in buckets, changed by commits: a change rewrites the buckets that it touches and no others.

A bucket is a folder written once; a commit is a small file that names, for each table, the version of every bucket. Readers
see one commit. Two writers can't both make the same one: its file is created once, and the other fails.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], key: str = "file", buckets: int = 64):
        self.spark, self.path, self.tables, self.key, self.buckets = spark, path.rstrip("/"), tables, key, buckets
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def current(self) -> int:
        """The number of the last commit, 0 before the first."""
        if not self._fs.exists(self._at("")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(""))]
        return max((int(n[8:]) for n in names if n.startswith("_commit-")), default=0)

    def manifest(self) -> dict:
        """The last commit: versions of the buckets by table, and the note that came with it."""
        v = self.current()
        if not v:
            return {"buckets": {t: {} for t in self.tables}, "note": None}
        stream = self._fs.open(self._at(f"_commit-{v}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, table: str, only: list[int] | None = None) -> DataFrame:
        """A table, or those of its buckets that are in ``only``."""
        where = self.manifest()["buckets"][table]
        paths = [f"{self.path}/{table}/v{v}/_bucket={k}" for k, v in where.items() if only is None or int(k) in only]
        return self.spark.read.schema(self.tables[table]).parquet(*paths) if paths else self.spark.createDataFrame([], self.tables[table])

    def read_keys(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of some keys: their buckets only are read."""
        only = [r[0] for r in keys.select(self.bucket(F.col(self.key))).distinct().collect()]  # at most as many as there are buckets
        return self.read(table, only).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def replace(self, keys: DataFrame, new: dict[str, DataFrame], note=None) -> None:
        """The rows of ``keys`` in all tables by those in ``new`` (a table that isn't named keeps its rows)."""
        v, last = self.current() + 1, self.manifest()
        keys = keys.select(self.key).distinct()
        touched = [r[0] for r in keys.select(self.bucket(F.col(self.key))).distinct().collect()]
        for table, rows in new.items():
            old = self.read(table, touched).join(keys, self.key, "left_anti")
            both = old.unionByName(rows.select(*old.columns)).withColumn("_bucket", self.bucket(F.col(self.key)))
            both.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{table}/v{v}")
            held = [f.getPath().getName() for f in self._fs.listStatus(self._at(f"{table}/v{v}")) if f.isDirectory()]
            where = last["buckets"][table]
            for k in touched:
                where.pop(str(k), None)
            where |= {n.removeprefix("_bucket="): v for n in held if n.startswith("_bucket=")}
        self._commit(v, {"buckets": last["buckets"], "note": note})

    def clear(self, tables: list[str] | None = None, note=None) -> None:
        """All rows of some tables, or of all."""
        v, last = self.current() + 1, self.manifest()
        self._commit(v, {"buckets": last["buckets"] | {t: {} for t in tables or self.tables}, "note": note})

    def _commit(self, v: int, manifest: dict) -> None:
        out = self._fs.create(self._at(f"_commit-{v}"), False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
