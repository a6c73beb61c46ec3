"""Benchmark decontamination: a prefix-filtered containment join, all in DataFrame operations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, broadcast_if_small, carried, uncarried

#: Characters that end a word: ASCII other than letters and digits.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def _shingles(df: DataFrame, keys: list[str], order: int) -> DataFrame:
    """One row per position of ``w`` with the hash of ``order`` words from there on."""
    n = F.size("w")
    lists = [F.slice("w", k + 1, F.greatest(n - (order - 1), F.lit(0))) for k in range(order)]
    rows = df.where(n >= order).select(*keys, F.posexplode(F.arrays_zip(*[x.alias(f"w{k}") for k, x in enumerate(lists)])).alias("pos", "s"))
    return rows.select(*keys, "pos", F.xxhash64(*[F.col("s")[f"w{k}"] for k in range(order)]).alias("h"))


def _verified(w: Column, c: Column, window: int) -> Column:
    """Positions of ``w`` hit by windows of candidate ``c`` (item_id, shift, words) laid at its shift."""
    length = F.size(c["words"])
    wide = F.least(F.lit(window), length)
    same = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.coalesce(F.get(w, c["shift"] + i) == F.get(c["words"], i), F.lit(False)))
    starts = F.filter(F.sequence(F.lit(0), length - wide), lambda s: F.forall(F.slice(same, s + 1, wide), lambda x: x))
    return F.flatten(F.transform(starts, lambda s: F.sequence(c["shift"] + s, c["shift"] + s + wide - 1)))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and the columns in ``keep``).

    1. Every shingle of the benchmark gets its frequency in the whole corpus (a count over all documents).
    2. Containment asks for all shingles of a window, so one necessary prefix token is enough: its rarest shingle.
    3. Documents' shingles are joined with these few tokens. A match fixes where the item would lie (position bound); its
       windows must fit into the document (length bound). Alignments are distinct: a passage is verified once however many
       tokens found it.
    4. Each alignment's windows are compared word for word with the text; only whole windows count.

    Null or empty texts have no words and no hits; null or wordless items have no windows; an item without id hits but isn't
    listed. Items that share an id (or have none) are told apart by a hash of their words. Repeated documents each return;
    repeated items count once. Item ids of any type are read as strings. Very long texts: a row holds its text's words. Empty
    tables: no hits, or no rows. Further columns are ignored; those in ``keep`` may have any name, but a result replaces one of
    its own name.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    docs = carried(docs, ["doc_id", "text"], keep)
    items = scratch.table(benchmark.select(F.col("item_id").cast("string"), words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct().withColumn("item", F.xxhash64("w")), "items")
    orders = [r[0] for r in items.select(F.least(F.lit(shingle), F.size("w"))).distinct().collect()]  # at most ``shingle`` numbers
    corpus = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), words(F.col("text")).alias("w"))

    def union(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    found = None
    if orders:
        sized = {k: items.where(F.least(F.lit(shingle), F.size("w")) == k).withColumn("n", F.size("w")) for k in orders}
        tokens = scratch.table(union([_shingles(sized[k], ["item_id", "item", "n"], k).withColumn("k_words", F.lit(k)) for k in orders]), "tokens")
        counts = []
        for k in orders:
            known = broadcast_if_small(tokens.where(F.col("k_words") == k).select("h").distinct())
            counts.append(_shingles(corpus, [], k).join(known, "h").groupBy("h").agg(F.count("*").alias("df")).withColumn("k_words", F.lit(k)))
        counts = scratch.table(union(counts), "counts")  # a token that no document has can't be in a contained window
        # each window's rarest token; windows with a token that occurs nowhere need no look-up, so the inner join may lose them
        by_window = tokens.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - (window - F.col("k_words"))), F.least(F.col("pos"), F.greatest(F.lit(0), F.col("n") - window)))).alias("start"))
        rare = by_window.join(counts, ["h", "k_words"], "left").fillna({"df": 0})
        first = rare.groupBy("item_id", "item", "n", "start", "k_words").agg(F.min_by(F.struct("h", "pos", "df"), F.struct("df", "h", "pos")).alias("t"))
        prefix = scratch.table(first.where("t.df > 0").select("item_id", "item", "k_words", F.col("t.h").alias("h"), F.col("t.pos").alias("item_pos"), "n").distinct(), "prefix")
        parts = []
        for k in orders:
            side = broadcast_if_small(prefix.where(F.col("k_words") == k).select("h", "item_id", "item", "item_pos", "n"))
            near = _shingles(corpus.withColumn("n_doc", F.size("w")), ["doc_id", "k", "n_doc"], k).join(side, "h")
            shift = F.col("pos") - F.col("item_pos")
            wide = F.least(F.lit(window), F.col("n"))
            parts.append(near.where((shift + F.col("n") >= wide) & (shift <= F.col("n_doc") - wide)).select("doc_id", "k", "item_id", "item", shift.alias("shift")).distinct())
        aligned = scratch.table(union(parts).distinct(), "aligned")
        texts = items.select(F.col("item_id").alias("_id_of"), F.col("item").alias("_item"), F.col("w").alias("words"))
        joined = aligned.join(broadcast_if_small(texts), (F.col("item") == F.col("_item")) & F.col("item_id").eqNullSafe(F.col("_id_of")))
        found = joined.groupBy(F.col("doc_id").alias("_id"), "k").agg(F.collect_list(F.struct("item_id", "shift", "words")).alias("c"))
        found = broadcast_if_small(scratch.table(found, "found"))
    base = docs.select("doc_id", "_kept", F.xxhash64("doc_id", "text").alias("k"), words(F.col("text")).alias("w"))
    if found is None:
        base = base.withColumn("c", F.expr("cast(null as array<struct<item_id string, shift int, words array<string>>>)"))
    else:
        hit = found.withColumnRenamed("k", "_k")
        base = base.join(hit, (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    w, c = F.col("w"), F.coalesce(F.col("c"), F.array().cast("array<struct<item_id:string,shift:int,words:array<string>>>"))
    judged = base.select("doc_id", "_kept", F.size(w).cast("long").alias("n_words"), F.filter(F.transform(c, lambda x: F.struct(x["item_id"].alias("item_id"), _verified(w, x, window).alias("at"))), lambda x: F.size(x["at"]) > 0).alias("v"))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("v", lambda x: x["item_id"]), lambda x: x.isNotNull())))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("v", lambda x: x["at"])))).cast("long")
    made = {"n_hit": n_hit, "n_items": F.size(ids).cast("long"), "items_sha256": F.sha2(F.array_join(ids, ",").cast("binary"), 256), "contaminated": n_hit > 0}
    return uncarried(judged.withColumns(made), ["doc_id"], keep, ["n_words", *made])
