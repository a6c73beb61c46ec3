"""Entry points: languages, indexing of changed files, go to definition, test runs, cancellation."""

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import content_tag, matches_file, path_filename
from ..operators import assertions, graph
from ..operators.places import nodes_at
from ..schema import EDGES_DDL, NODES_DDL, singletons
from ..session import Scratch
from ..sources.index import FileIndex, changed
from .closure import Cancelled, Config, partial_paths, resolve_paths

# ---- cancellation: a flag is called once a phase, and raises


def cancel_after(duration: float) -> Callable[[], None]:
    """A flag that is raised ``duration`` seconds from now."""
    end = time.monotonic() + duration

    def check():
        if time.monotonic() > end:
            raise Cancelled(f"over {duration} s")

    return check


class Flag:
    """A flag that another thread raises."""

    def __init__(self):
        self._raised = threading.Event()

    def cancel(self) -> None:
        self._raised.set()

    def __call__(self) -> None:
        if self._raised.is_set():
            raise Cancelled("cancelled")


def any_of(*flags: Callable[[], None]) -> Callable[[], None]:
    def check():
        for f in flags:
            f()

    return check


# ---- languages

#: (files: file, path, content; globals by file: file, name, value) -> nodes, edges, errors (file, error)
Analyzer = Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]


@dataclass
class Language:
    """A front-end and the files that are its: by extension, and by a pattern in their content (the longest first match wins),
    or by name, for special files. ``builtins`` is a graph that every file of the language sees."""

    name: str
    analyze: Analyzer
    extensions: list[str] = field(default_factory=list)
    content_regex: str | None = None
    file_names: list[str] = field(default_factory=list)
    builtins: tuple[DataFrame, DataFrame] | None = None

    def score(self):
        s = matches_file(F.col("file"), F.col("content"), self.extensions, self.content_regex)
        special = path_filename(F.col("file")).isin(*self.file_names) if self.file_names else F.lit(False)
        return F.when(special, F.lit(1 << 30)).otherwise(s)


def best_language(files: DataFrame, languages: list[Language]) -> DataFrame:
    """``files`` (file, content) with the language of the highest score, the first of equal ones; null without any."""
    best = F.greatest(*[F.coalesce(x.score(), F.lit(-1)) for x in languages], F.lit(-1))
    name = F.lit(None).cast("string")
    for x in reversed(languages):
        name = F.when(F.coalesce(x.score(), F.lit(-1)) == best, F.lit(x.name)).otherwise(name)
    return files.withColumn("language", F.when(best >= 0, name))


# ---- indexing


def index_all(index: FileIndex, files: DataFrame, languages: list[Language], force: bool = False, config: Config | None = None) -> DataFrame:
    """Index the changed ones of ``files`` (file, content); the result is a report: (file, status, error).

    A file whose content has the stored tag is skipped (unless ``force``), one without a language too. The others are given to
    their language's front-end, all at once; their graphs and summaries are stored together, or the error is.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "indexing")
    known = scratch.table(best_language(files.withColumn("tag", content_tag(F.col("content"))), languages), "files")
    todo = known.where("language is not null")
    if not force:
        todo = changed(todo, index.graphs())
    todo = scratch.table(todo, "todo")
    nodes, edges = spark.createDataFrame(singletons(), NODES_DDL), spark.createDataFrame([], EDGES_DDL)
    errors = spark.createDataFrame([], "file string, error string")
    for x in languages:
        n, e, wrong = x.analyze(todo.where(F.col("language") == x.name))
        nodes, edges, errors = nodes.unionByName(n.where("file is not null")), edges.unionByName(e), errors.unionByName(wrong)
    errors = scratch.table(errors.groupBy("file").agg(F.min("error").alias("error")), "errors")
    nodes = scratch.table(nodes.join(errors, "file", "left_anti"), "nodes")
    edges = scratch.table(edges, "edges")
    paths = scratch.table(partial_paths(nodes, edges, config), "paths")
    graphs = todo.select("file", "tag").join(errors, "file", "left").select("file", "tag", "error")
    if not graphs.isEmpty():
        index.store(graphs, nodes.where("file is not null"), edges, paths)
    done = graphs.select("file", F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"), "error")
    skipped = known.join(todo.select("file"), "file", "left_anti").select("file", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))
    return scratch.table(done.unionByName(skipped), "report")


def report(outcome: DataFrame, say: Callable[[str], None], most: int = 1000) -> None:
    """Says what became of each file, failures first, ``most`` lines at most; then the counts."""
    for r in outcome.orderBy(F.col("status") != "failed", "file").limit(most).collect():
        say(f"{r['file']}: {r['status']}" + (f" ({r['error']})" if r["error"] else ""))
    for r in outcome.groupBy("status").count().orderBy("status").collect():
        say(f"{r['count']} {r['status']}")


# ---- queries


def definitions(nodes: DataFrame, paths: DataFrame, places: DataFrame, config: Config | None = None) -> DataFrame:
    """Where the references at ``places`` (place, file, line, column) lead: (place, reference, definition, file, symbol, span,
    definiens_span). Only references at the places are searched for; answers that others shadow are left out. A place without
    references has no row."""
    scratch = Scratch(nodes.sparkSession, "query")
    at = scratch.table(nodes_at(nodes.where("is_reference"), places, inclusive=True).select("place", F.col("nid").alias("start_nid")).distinct(), "at")
    found = graph.drop_shadowed(resolve_paths(nodes, paths, at.select(F.col("start_nid").alias("nid")).distinct(), config))
    ends = nodes.where("is_definition").select(F.col("nid").alias("end_nid"), "file", "symbol", "span", "definiens_span")
    reached = at.join(found.select("start_nid", "end_nid"), "start_nid").join(ends, "end_nid")
    return reached.select("place", F.col("start_nid").alias("reference"), F.col("end_nid").alias("definition"), "file", "symbol", "span", "definiens_span").distinct()


def goto_definition(index: FileIndex, places: DataFrame, timeout: float | None = None) -> DataFrame:
    """``definitions`` over an index; over ``timeout`` seconds it raises ``Cancelled``."""
    nodes, _ = index.graph()
    return definitions(nodes, index.paths(), places, Config(check=cancel_after(timeout) if timeout else None))


def find_paths(nodes: DataFrame, paths: DataFrame, references: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """All complete paths, with the phase's callbacks of ``config``."""
    return resolve_paths(nodes, paths, references, config)


def run_tests(nodes: DataFrame, edges: DataFrame, asserted: DataFrame, timeout: float | None = 60.0) -> DataFrame:
    """Outcomes of all assertions over a graph (``assertions.run``), within ``timeout`` seconds."""
    scratch = Scratch(nodes.sparkSession, "tests")
    config = Config(check=cancel_after(timeout) if timeout else None)
    nodes = scratch.table(nodes, "nodes")
    places = asserted.where("kind = 'defined'").select("place", "file", "line", "column")
    at = nodes_at(nodes.where("is_reference"), places).select("nid").distinct()
    paths = scratch.table(partial_paths(nodes, scratch.table(edges, "edges"), config), "paths")
    found = scratch.table(graph.drop_shadowed(resolve_paths(nodes, paths, at, config)), "found")
    return assertions.run(asserted, nodes, found)


def register_functions(spark: SparkSession, functions: dict[str, tuple[Callable, str]]) -> None:
    """Further functions for rules, by name: a vectorized Python function and its result type, for use in SQL."""
    for name, (function, result) in functions.items():
        spark.udf.register(name, F.pandas_udf(function, result))
