"""The file index: per file its tag or error, its graph and its summary, replaced file by file, and read for searches."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import path_descendant_of
from ..operators.lookup import root_candidates, storage_key
from ..schema import EDGES_DDL, NODES_DDL, PATHS_DDL, ROOT, singletons
from ..session import Scratch
from .versions import Versions


def status(requests: DataFrame, graphs: DataFrame) -> DataFrame:
    """missing, indexed or error per requested file (and tag, where the request has one)."""
    g = graphs.select(F.col("file").alias("g_file"), F.col("tag").alias("g_tag"), F.col("error").alias("g_error"))
    on = (F.col("file") == F.col("g_file")) & (F.col("tag").isNull() | (F.col("tag") == F.col("g_tag")))
    return requests.join(g, on, "left").select("file", "tag", F.when(F.col("g_file").isNull(), "missing").when(F.col("g_error").isNotNull(), "error").otherwise("indexed").alias("status"))


def unchanged(files: DataFrame, graphs: DataFrame) -> DataFrame:
    """Files whose content tag is stored already: these are skipped."""
    return files.join(graphs.select("file", "tag"), ["file", "tag"], "left_semi")


def changed(files: DataFrame, graphs: DataFrame) -> DataFrame:
    return files.join(graphs.select("file", "tag"), ["file", "tag"], "left_anti")


def replace(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of files in ``new`` replaced (also after an error, so that no file has two rows)."""
    return old.join(new.select("file").distinct(), "file", "left_anti").unionByName(new)


def clean(table: DataFrame, path: str) -> DataFrame:
    """Without the files at or below ``path``."""
    return table.where(~path_descendant_of(F.col("file"), F.lit(path)))


def listing(graphs: DataFrame, path: str | None = None) -> DataFrame:
    rows = graphs.select("file", "tag", "error")
    return rows if path is None else rows.where(path_descendant_of(F.col("file"), F.lit(path)))


class FileIndex:
    """The index in a folder, as tables by file: ``graphs`` (tag, error), ``nodes``, ``edges``, ``paths``, and ``roots``, the
    summaries' paths that start at the root, by the symbols that they ask for."""

    TABLES = {"graphs": "file string, tag string, error string", "nodes": NODES_DDL, "edges": "file string, " + EDGES_DDL, "paths": PATHS_DDL, "roots": PATHS_DDL + ", root_key string"}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.versions = spark, Versions(spark, path, self.TABLES, "file", buckets)

    @classmethod
    def temporary(cls, spark: SparkSession, buckets: int = 8) -> "FileIndex":
        """An index that goes with the session."""
        return cls(spark, Scratch(spark, "index").base, buckets)

    # ---- writing

    def store(self, graphs: DataFrame, nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> None:
        """Replace the files in ``graphs`` (file, tag, error) with their nodes, edges and partial paths; files with an error have
        none of these. An edge belongs to the file of its source or, from the root, of its sink. A path must start in its file
        or at the root; root paths that ask for nothing are never found and not kept."""
        fine = graphs.where("error is null").select("file")
        wrong = paths.where((F.col("start_nid") != ROOT) & ~F.startswith("start_nid", F.concat("file", F.lit("("))))
        if not wrong.isEmpty():
            raise ValueError("a partial path starts outside of its file")
        file_of = lambda c: F.regexp_extract(c, r"^(.*)\(\d+\)$", 1)
        owned = edges.withColumn("file", F.coalesce(F.nullif(file_of("source"), F.lit("")), file_of("sink")))
        of = lambda df: df.join(fine, "file", "left_semi")
        at_root = F.col("start_nid") == ROOT
        roots = paths.where(at_root & (F.size("sym_pre.symbols") > 0)).withColumn("root_key", storage_key("sym_pre"))
        self.versions.replace(graphs, {"graphs": graphs, "nodes": of(nodes), "edges": of(owned), "paths": of(paths.where(~at_root)), "roots": of(roots)})

    def store_errors(self, errors: DataFrame) -> None:
        """Files (file, tag, error) that could not be indexed: what was there of them goes."""
        none = lambda t: self.spark.createDataFrame([], self.TABLES[t])
        self.versions.replace(errors, {"graphs": errors, **{t: none(t) for t in ("nodes", "edges", "paths", "roots")}})

    def clean(self, path: str | None = None) -> int:
        """Drop the files at or below ``path``, or all; returns how many."""
        gone = listing(self.graphs(), path).select("file")
        n = gone.count()
        if path is None:
            self.versions.clear()
        elif n:
            self.versions.replace(gone, {t: self.spark.createDataFrame([], ddl) for t, ddl in self.TABLES.items()})
        return n

    def clear_paths(self) -> None:
        """Drop the summaries; graphs stay."""
        self.versions.clear(["paths", "roots"])

    # ---- reading

    def graphs(self) -> DataFrame:
        return self.versions.read("graphs")

    def listing(self, path: str | None = None) -> DataFrame:
        return listing(self.graphs(), path)

    def status(self, requests: DataFrame) -> DataFrame:
        return status(requests, self.graphs())

    def graph(self, path: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes (with those of no file) and edges of a file, of all files below a folder, or of all. An indexing error of the
        file itself is raised."""
        rows = self.listing(path)
        if path is not None:
            failed = rows.where((F.col("file") == path) & F.col("error").isNotNull()).collect()
            if failed:
                raise ValueError(f"{path}: {failed[0]['error']}")
        files = rows.where("error is null").select("file")
        of = lambda t: self.versions.read(t) if path is None else self.versions.read_keys(t, files)
        return of("nodes").unionByName(self.spark.createDataFrame(singletons(), NODES_DDL)), of("edges").drop("file")

    def paths_for_nodes(self, nodes: DataFrame) -> DataFrame:
        """The partial paths that start at nodes (nid): only their files' buckets are read."""
        asked = nodes.select("nid", F.regexp_extract("nid", r"^(.*)\(\d+\)$", 1).alias("file")).distinct()
        return self.versions.read_keys("paths", asked).join(asked.select(F.col("nid").alias("start_nid")), "start_nid", "left_semi")

    def paths_for_roots(self, stacks: DataFrame, stack: str = "sym_post") -> DataFrame:
        """The root paths that fit any of the symbol stacks: equal ones, those whose variable takes the rest, and, where the stack
        has a variable, longer ones. Keys are joined by equality."""
        asked = stacks.select(F.col(stack).alias("sym_post")).distinct()
        found = root_candidates(asked, self.versions.read("roots"))
        return found.select(*[F.col(f"r_{c}").alias(c) for c in self.versions.read("roots").columns if c != "root_key"]).distinct()

    def paths(self) -> DataFrame:
        return self.versions.read("paths").unionByName(self.versions.read("roots").drop("root_key"))

    def stats(self) -> DataFrame:
        """Rows by table."""
        out = None
        for t in self.TABLES:
            n = self.versions.read(t).agg(F.lit(t).alias("table"), F.count("*").alias("n"))
            out = n if out is None else out.unionByName(n)
        return out
