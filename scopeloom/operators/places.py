"""Nodes at positions of a source, and what assertions about them find."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import positions as pos

#: Lines of a file that are looked up together.
BLOCK_LINES = 64


def compare(expected: DataFrame, actual: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per key: values missing from, and unexpected in, ``actual``."""
    e, a = expected.select(*key, value).distinct(), actual.select(*key, value).distinct()
    missing = e.join(a, [*key, value], "left_anti").withColumn("what", F.lit("missing"))
    return missing.unionByName(a.join(e, [*key, value], "left_anti").withColumn("what", F.lit("unexpected")))


def nodes_at(nodes: DataFrame, places: DataFrame, inclusive: bool = False) -> DataFrame:
    """Nodes whose span covers a place (place, file, line, column), by byte column; ``inclusive``: also one at the span's end.

    Nodes and places meet by file and block of lines (a span has a row for each that it touches), so that a place is compared
    with the nodes around it and not with all of its file."""
    p = places.select("place", F.col("file").alias("p_file"), F.col("line").alias("p_line"), F.col("column").alias("p_column")).withColumn("p_block", F.floor(F.col("p_line") / BLOCK_LINES))
    blocks = F.sequence(F.floor(F.col("span.start.line") / BLOCK_LINES), F.floor(F.col("span.end.line") / BLOCK_LINES))
    ends = [F.col(f"span.{end}.{part}") for end in ("start", "end") for part in ("line", "utf8")]
    test = pos.within if inclusive else pos.contains
    rows = nodes.where("span is not null").withColumn("n_block", F.explode(blocks))
    return rows.join(p, (F.col("file") == F.col("p_file")) & (F.col("n_block") == F.col("p_block")) & test(*ends, F.col("p_line"), F.col("p_column"))).drop("p_file", "p_line", "p_column", "p_block", "n_block")


def symbols_at(nodes: DataFrame, places: DataFrame, flag: str) -> DataFrame:
    """(place, symbol) of the definitions (``is_definition``) or references (``is_reference``) at each place."""
    return nodes_at(nodes.where(flag), places).select("place", "symbol").distinct()


def assert_symbols(nodes: DataFrame, places: DataFrame, expected: DataFrame, flag: str) -> DataFrame:
    """(place, symbol, what): expected symbols (place, symbol) that are missing, and found ones that are unexpected."""
    return compare(expected, symbols_at(nodes, places, flag), ["place"], "symbol")


def assert_defined(found: DataFrame, nodes: DataFrame, places: DataFrame, targets: DataFrame) -> DataFrame:
    """(place, line, what) for references at places: lines of ``targets`` (place, file, line) that no answer has, lines of
    answers that are no target, and ``no references`` for a place without any. ``found``: paths from references to definitions
    after shadowing."""
    at = nodes_at(nodes.where("is_reference"), places).select("place", F.col("nid").alias("start_nid")).distinct()
    ends = nodes.where("is_definition").select(F.col("nid").alias("end_nid"), F.col("file").alias("e_file"), F.col("span.start.line").alias("first"), F.col("span.end.line").alias("last"))
    reached = at.join(found.select("start_nid", "end_nid"), "start_nid").join(ends, "end_nid").select("place", "e_file", "first", "last").distinct()
    fits = (reached.place == targets.place) & (F.col("e_file") == targets.file) & targets.line.between(F.col("first"), F.col("last"))
    missing = targets.join(reached, fits, "left_anti").join(at.select("place").distinct(), "place", "left_semi").select("place", "line", F.lit("missing").alias("what"))
    unexpected = reached.join(targets, fits, "left_anti").select("place", F.col("first").alias("line"), F.lit("unexpected").alias("what"))
    nothing = places.join(at, "place", "left_anti").select("place", F.lit(None).cast("int").alias("line"), F.lit("no references").alias("what"))
    return missing.unionByName(unexpected).unionByName(nothing)
