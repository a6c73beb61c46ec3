"""The assertion language of annotated sources: fragments, globals, assertions, their errors and outcomes."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import positions as pos
from . import places

# The syntax of annotations, found anywhere in a line.
FRAGMENT = r"---\s*path:\s*([^\s]+)\s*---"
GLOBAL = r"---\s*global:\s*([^\s]+)=([^\s]+)\s*---"
ASSERTION = r"\^\s*(\w+):\s*([^\s,]+(?:\s*,\s*[^\s,]+)*)?"
KINDS = ["defined", "defines", "refers"]


def fragments(lines: DataFrame, key: str) -> DataFrame:
    """Lines (key, line, line_text) with the path of the fragment that they belong to: null before the first header, and in files
    without any, which are one fragment of their own. ``is_header`` marks headers, ``global`` (name, value) globals."""
    header = F.col("line_text").rlike(FRAGMENT)
    w = Window.partitionBy(key).orderBy("line")
    given = F.col("line_text").rlike(GLOBAL) & ~header
    value = F.struct(F.regexp_extract("line_text", GLOBAL, 1).alias("name"), F.regexp_extract("line_text", GLOBAL, 2).alias("value"))
    path = F.when(header, F.regexp_extract("line_text", FRAGMENT, 1))
    return lines.withColumn("fragment", F.last(path, ignorenulls=True).over(w)).withColumns({"is_header": header, "global": F.when(given, value)})


def fragment_errors(parts: DataFrame, key: str) -> DataFrame:
    """(key, line, error) of ``fragments``: a path or a fragment's global given twice, a global before the first of several."""
    heads = parts.where("is_header")
    again = heads.withColumn("n", F.row_number().over(Window.partitionBy(key, "fragment").orderBy("line"))).where("n > 1").select(key, "line", F.concat(F.lit("duplicate path "), "fragment").alias("error"))
    named = parts.where("global is not null").select(key, "line", "fragment", F.col("global.name").alias("name"))
    twice = named.withColumn("n", F.row_number().over(Window.partitionBy(key, "fragment", "name").orderBy("line"))).where("n > 1").select(key, "line", F.concat(F.lit("duplicate global "), "name").alias("error"))
    early = named.where("fragment is null").join(heads.select(key).distinct(), key, "left_semi").select(key, "line", F.lit("global before first fragment").alias("error"))
    return again.unionByName(twice).unionByName(early)


def globals_of(parts: DataFrame, key: str) -> DataFrame:
    return parts.where("global is not null").select(key, "fragment", "line", "global.name", "global.value")


def assertions(lines: DataFrame, key: str) -> DataFrame:
    """One row per assertion: the last line above it that is none, the caret's column in graphemes, the kind, the values (line
    numbers from 1 for ``defined``, else names), and what is wrong with it, if anything."""
    is_assertion = F.col("line_text").rlike(ASSERTION)
    w = Window.partitionBy(key).orderBy("line")
    plain = F.when(~is_assertion, F.struct("line", F.col("line_text").alias("text")))
    rows = lines.withColumns({"above": F.last(plain, ignorenulls=True).over(w), "is_assertion": is_assertion}).where("is_assertion")
    kind, said = F.regexp_extract("line_text", ASSERTION, 1), F.regexp_extract("line_text", ASSERTION, 2)
    # the first match decides; its caret follows the text before it
    before = F.substring(F.col("line_text"), F.lit(1), F.length("line_text") - F.length(F.regexp_replace("line_text", f"^.*?(?={ASSERTION})", "")))
    values = F.when(kind == "defined", F.regexp_extract_all(said, F.lit(r"\d+"), F.lit(0))).otherwise(F.regexp_extract_all(said, F.lit(r"[^\s,]+"), F.lit(0)))
    out = rows.select(key, "line", "above", F.col("above.line").alias("target_line"), pos.grapheme_len(before).alias("column"), kind.alias("kind"), values.alias("values"))
    error = F.when(F.col("above").isNull(), "no source line above").when(F.col("column") >= pos.grapheme_len(F.col("above.text")), "column beyond the line above").when(~F.col("kind").isin(*KINDS), F.concat(F.lit("unknown kind "), "kind"))
    return out.withColumn("error", error).drop("above")


def compare(expected: DataFrame, actual: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per key: values missing from, and unexpected in, ``actual``."""
    return places.compare(expected, actual, key, value)


def run(asserted: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The outcome of every assertion: (place, kind, passed, failures). ``asserted`` has place, file, line and column (bytes) of
    what is asserted, kind, values, and for ``defined`` the targets' file (``target_file``; lines are ``values``, from 1).
    ``found``: paths from references to definitions, after shadowing."""
    at = asserted.select("place", "kind", "file", "line", "column")
    names = lambda kind: asserted.where(F.col("kind") == kind).select("place", F.explode("values").alias("symbol"))
    symbols = [places.assert_symbols(nodes, at.where(F.col("kind") == kind), names(kind), flag) for kind, flag in (("defines", "is_definition"), ("refers", "is_reference"))]
    targets = asserted.where("kind = 'defined'").select("place", F.col("target_file").alias("file"), F.explode("values").alias("line")).withColumn("line", F.col("line").cast("int") - 1)
    lines = places.assert_defined(found, nodes, at.where("kind = 'defined'"), targets).select("place", F.col("line").cast("string").alias("value"), "what")
    wrong = lines
    for s in symbols:
        wrong = wrong.unionByName(s.select("place", F.col("symbol").alias("value"), "what"))
    failures = wrong.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("what", "value"))).alias("failures"))
    return asserted.select("place", "kind").join(failures, "place", "left").withColumn("passed", F.col("failures").isNull())


def results(*outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of assertions, passed and failed, over any number of runs: (tests, passed, failed), per ``by`` if given."""
    every = outcomes[0]
    for more in outcomes[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    return every.groupBy(*(by or [])).agg(F.count("*").alias("tests"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
