"""Dropping recurring lines by a tree of line templates, all in DataFrame operations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small

ANY = "<*>"
#: Shares of a leaf's documents that must have a token at its place for it to be constant; lines are judged once by each.
SHARES = (0.1, 0.5)


def _masked(text_col: str):
    """The lines of a text with white space evened and tokens that hold a digit masked."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    even = F.regexp_replace(F.regexp_replace(text, r"[ \t\x0B\f\r]+", " "), r" ?\n ?", "\n")
    return F.split(F.trim(F.regexp_replace(even, r"(?<!\S)[^\s0-9]*+[0-9]\S*", ANY)), "\n")  # trim takes spaces only: places stay those of the text's lines


def _places(docs: DataFrame, depth: int, id_col: str, text_col: str) -> DataFrame:
    """Every line that is not empty: its document (a number of the row), place, leaf and hashes; whether it stands there for the
    first time in its document (``once``), and if so, whether another line of the document has the same leaf before (``extra``)."""
    lines = F.filter(F.transform(_masked(text_col), lambda m, i: F.struct(m.alias("m"), i.alias("line"))), lambda s: s["m"] != "")
    tokens = lambda m: F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1
    leaf = lambda m: F.xxhash64(tokens(m), F.substring_index(m, " ", depth))
    ordered = F.sort_array(F.transform(lines, lambda s: F.struct(leaf(s["m"]).alias("leaf"), s["m"].alias("m"), s["line"].alias("line"))))
    key = [F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("k")]
    texts = docs.select(F.monotonically_increasing_id().alias("row"), *key, ordered.alias("s"))

    def entry(s, j):
        before = F.get(F.col("s"), j - 1)
        once = F.coalesce((before["m"] != s["m"]) | (before["leaf"] != s["leaf"]), F.lit(True))
        return F.struct(s["m"].alias("m"), s["line"].alias("line"), s["leaf"].alias("leaf"), once.alias("once"), (once & F.coalesce(before["leaf"] == s["leaf"], F.lit(False))).alias("extra"))

    rows = texts.select("row", "_id", "k", F.inline(F.transform("s", entry)))
    return rows.withColumns({"n": tokens(F.col("m")), "h1": F.xxhash64("m"), "h2": F.xxhash64(F.lit(3), "m")})


def recurring_lines(places: DataFrame, scratch: Scratch, min_docs: int = 3, least_constant: float = 0.5, depth: int = 3) -> DataFrame:
    """Hashes (h1, h2) of the masked lines (``_places``) whose template recurs in ``min_docs`` documents or more.

    A line's leaf in the tree is its token count and its first tokens (named by a 64-bit hash), tokens with a digit being
    variable from the start. Within a leaf a token is constant at its place if ``min_docs`` documents have it there, else a
    variable field; constants and fields make up the template. Templates with a smaller share of constants than
    ``least_constant`` say nothing and are left alone.

    In a large leaf the values of a field come in ``min_docs`` documents as well, and each combination of two such fields
    would be a template of its own. So lines are judged again with tokens constant only if a share of the leaf's documents
    (``SHARES``) has them; a line recurs if any of its templates does. As the first ``depth`` tokens are the leaf's own, the
    share of constants must hold among the others too, else all short lines of a large corpus that begin alike would go.

    Everything is counted in documents: a leaf, a token at its place or a template that several lines of one document have
    counts once there. Counts of lines are aggregated first; then what documents with several lines of a leaf count too often
    (for each leaf, token or template their number of lines in it less one) is taken off, so that only those documents' lines
    are ever looked at one by one.

    Leaves in too few documents, nearly all of ordinary text, are found from hashes alone, so that the words of ordinary
    lines are never shuffled; leaves with a single line are settled without looking at their tokens.
    """
    each = places.where("once")
    leaves = each.groupBy("leaf").agg(F.count_if(~F.col("extra")).alias("leaf_docs"), (F.min("h1") == F.max("h1")).alias("alone")).where(F.col("leaf_docs") >= min_docs)
    leaves = scratch.table(leaves.select("leaf", "leaf_docs", "alone"), "leaves")
    small = broadcast_if_small(leaves)
    kept = each.select("leaf", "n", "m").join(small, "leaf").groupBy("leaf", "n", "m").agg(F.first("alone").alias("alone"), F.first("leaf_docs").alias("total"), F.count("*").alias("docs"))
    kept = scratch.table(kept, "candidates")
    constants = F.size(F.filter(F.split("m", " "), lambda t: t != ANY))
    alone = kept.where("alone").where(constants >= least_constant * F.col("n")).select("m")
    several = kept.where("not alone").select("leaf", "n", "total", "docs", "m")
    place = ["leaf", "n", "pos", "token"]

    def tokens_of(lines: DataFrame, *columns: str) -> DataFrame:
        spread = lines.select("leaf", "n", *columns, F.posexplode(F.split("m", " ")).alias("pos", "t")).where(F.col("t") != ANY)
        return spread.select("leaf", "n", *columns, "pos", F.xxhash64("t").alias("token"))

    common = tokens_of(several, "docs").groupBy(*place).agg(F.sum("docs").alias("s")).where(F.col("s") >= min_docs)
    common = scratch.table(common, "constants")
    # a leaf with constants at too few places has no template that counts: most leaves that prose falls into end here
    rich = common.select("leaf", "n", "pos").distinct().groupBy("leaf", "n").agg(F.count("*").alias("places")).where(F.col("places") >= least_constant * F.col("n"))
    rich = scratch.table(rich.drop("places"), "rich")
    few = broadcast_if_small(rich)
    left = scratch.table(several.join(few, ["leaf", "n"]), "in-rich-leaves")

    # documents with several lines of such a leaf
    crowded = places.where("extra").select("row", "leaf", "n").join(few, ["leaf", "n"]).select("row", "leaf").distinct()
    crowd = scratch.table(each.select("row", "leaf", "n", "m").join(few, ["leaf", "n"]).join(crowded, ["row", "leaf"]), "crowded")

    def counted_twice(rows: DataFrame, keys: list[str]) -> DataFrame:
        again = rows.groupBy("row", *keys).agg((F.count("*") - 1).alias("again")).where("again > 0")
        return again.groupBy(*keys).agg(F.sum("again").alias("again"))

    once = common.join(counted_twice(tokens_of(crowd, "row"), place), place, "left").withColumn("s", F.col("s") - F.coalesce("again", F.lit(0)))
    common = scratch.table(once.where(F.col("s") >= min_docs).drop("again"), "constants-by-document")
    spread = left.select("leaf", "n", "total", "docs", F.xxhash64("m").alias("id"), F.posexplode(F.split("m", " ")).alias("pos", "t")).withColumn("token", F.xxhash64("t"))
    fielded = spread.join(common, place, "left")
    # a line's tokens meet again as one row: their number is the line's own length
    words = F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("s").isNotNull(), F.col("token")).alias("token"), "s")))
    line = fielded.groupBy("leaf", "n", "id").agg(F.first("docs").alias("docs"), F.first("total").alias("total"), words.alias("t"))

    def judged(share: float):
        """The tokens that are constant at this share, null for fields; null if they are too few."""
        t = F.transform("t", lambda x: F.when(x["s"] >= F.greatest(F.lit(min_docs), share * F.col("total")), x["token"]))
        known = lambda a: F.size(F.filter(a, lambda x: x.isNotNull()))
        enough = known(t) >= least_constant * F.col("n")
        if share:
            rest = F.slice(t, depth + 1, F.greatest(F.size(t) - depth, F.lit(0)))
            enough &= (F.size(rest) > 0) & (known(rest) >= least_constant * F.size(rest))
        return F.when(enough, F.struct(F.lit(share).alias("share"), t.alias("t")))

    template = line.select("leaf", "n", "id", "docs", F.explode(F.array(*[judged(x) for x in (0.0, *SHARES)])).alias("x")).where("x is not null")
    template = template.select("leaf", "n", "id", "docs", F.xxhash64("x").alias("t1"), F.xxhash64(F.lit(5), "x").alias("t2"))
    template = scratch.table(template, "templates")
    kind = ["leaf", "n", "t1", "t2"]
    twice = counted_twice(crowd.select("row", "leaf", "n", F.xxhash64("m").alias("id")).join(template, ["leaf", "n", "id"]), kind)
    often = template.groupBy(*kind).agg(F.sum("docs").alias("s")).join(twice, kind, "left").where(F.col("s") - F.coalesce("again", F.lit(0)) >= min_docs)
    ids = template.join(often.select(*kind), kind).select("leaf", "n", "id")
    within = left.withColumn("id", F.xxhash64("m")).join(ids, ["leaf", "n", "id"], "left_semi").select("m")
    return scratch.table(alone.union(within).select(F.xxhash64("m").alias("h1"), F.xxhash64(F.lit(3), "m").alias("h2")).distinct(), "recurring")


def drop_recurring_lines(docs: DataFrame, depth: int = 3, min_docs: int = 3, least_constant: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every row: the text without its recurring lines.

    Null text: no lines, kept_text null. Empty lines are kept. Repeated rows count as documents of their own. Null ids are
    kept. A text whose lines all recur keeps the empty text. Very long texts: a row holds its text's lines, and work grows as
    their number times its logarithm. Empty table: empty result. Further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    places = scratch.table(_places(docs, depth, id_col, text_col), "places")  # texts are masked once
    recurring = recurring_lines(places, scratch, min_docs, least_constant, depth)
    small = broadcast_if_small(recurring)
    slim = places.select("_id", "k", "line", "h1", "h2")
    hits = scratch.table(slim.join(small, ["h1", "h2"]).groupBy("_id", "k").agg(F.collect_set("line").alias("drop")), "hits")
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("_k"))
    # the documents with hits grow with the corpus: one plan for every size
    joined = text.join(hits.hint("merge"), (F.col("_k") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    # the lines are bound once: inside of a lambda an expression would be worked out for each place
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("drop"))  # noqa: E731  (by a hash set, in order)
    rest = F.get(F.transform(F.array(lines), lambda x: F.array_join(F.transform(left(x), lambda i: F.get(x, i)), "\n")), F.lit(0))
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(rest)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.select("doc_id", n_lines.alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"), kept.alias("kept_text"))
