"""Session helpers: the folder shared by driver and executors, written intermediate tables, code for Python workers."""

import atexit
import contextlib
import shutil
import sys
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship(module: str) -> None:
    """Send a module's functions to Python workers by value: executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


_local: list[str] = []
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, one of this machine serves sessions of this machine
    alone (``local[n]``, as in tests); on a cluster that is an error, as no other host would see the files."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="scopeloom-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


#: Bytes of files up to which Spark may broadcast a table.
PACKED = 256_000


class Scratch:
    """Written tables of one run. ``drop`` frees those no longer needed; the rest go at the session's end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def table(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """``df`` written and read again. The shuffles that made it are deleted with the write: the table replaces them."""
        path = f"{self.base}/{name}"
        before = self.spark.conf.get(_CLEAN_UP, None)
        self.spark.conf.set(_CLEAN_UP, "true")
        try:
            writer = df.write.option("compression", "zstd")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        finally:
            self.spark.conf.unset(_CLEAN_UP) if before is None else self.spark.conf.set(_CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def joined(self, df: DataFrame, name: str) -> DataFrame:
        """``table``, for a table that is joined: never sent whole to the driver if it is large (``sized``)."""
        return self.sized(self.table(df, name), [name])

    def sized(self, df: DataFrame, names: list[str]) -> DataFrame:
        """Spark takes the bytes of a table's files for its size, and ids and flags pack to a two-hundredth: over ``PACKED`` bytes
        of files, joins with ``df`` are by shuffle."""
        context = self.spark.sparkContext
        paths = [context._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{n}") for n in names]
        packed = sum(p.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in paths)
        return df.hint("merge") if packed > PACKED else df

    def read(self, names: list[str], like: DataFrame) -> DataFrame:
        """The columns of ``like`` from several tables, as one scan."""
        return self.spark.read.schema(like.schema).parquet(*[f"{self.base}/{n}" for n in names])

    def drop(self, name: str = "") -> None:
        """Frees one table, or all."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def _at_exit(self) -> None:
        """At the interpreter's end the session may be gone; the folder is the cluster's scratch space then."""
        with contextlib.suppress(Py4JError, OSError, AttributeError):
            self.drop()
