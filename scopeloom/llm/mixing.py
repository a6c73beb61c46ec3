"""Mixing sources by temperature: exponent, weights, repetition and budgeted block permutations, all in DataFrame operations."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, carried, uncarried

#: Of a hash of 60 bits, those that order rows; buckets and groups of buckets are ranges of it.
_BITS = 60


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Equal rows as one (_id, _source, _tokens, _text, copies). ``_source`` never is null: it names what it stands for."""
    tokens = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    # rows of a key may be a third of all: partial counts come before the shuffle
    rows = docs.select(F.col(id_col).alias("_id"), source.alias("_source"), F.greatest(tokens, F.lit(1)).cast("long").alias("_tokens"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_text"))
    return rows.groupBy("_id", "_source", "_tokens", "_text").agg(F.count("*").alias("copies"))


def _source_name(column: str):
    return F.when(F.col(column) != "null", F.substring(column, 2, 1 << 30))


def _order(seed: int, epoch):
    """A row's place in the permutation of an epoch, from 60 bits of a hash of what it holds."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_text")).cast("binary"))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long")


def solve_exponent(totals: DataFrame, target_entropy: float, max_repeats: float, rounds: int = 4, grid: int = 64) -> float:
    """The largest exponent in [0, 1] whose weights (share ** exponent, normalised) reach ``target_entropy`` (a fraction of
    the largest possible), raised where the rarest source would be repeated over ``max_repeats`` times.

    Entropy falls and repetition falls as the exponent grows, so both limits are bisected: each round evaluates ``grid``
    exponents in one aggregate over the sources and keeps the bracket, six halvings at once. Only the grid's sums reach the
    driver, however many sources there are.
    """
    k, big, small = totals.agg(F.count("*"), F.max("tokens"), F.min("tokens")).first()
    if not k or k == 1 or big == small:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        step = (hi - lo) / grid
        points = totals.select(F.log(F.col("tokens") / F.lit(float(big))).alias("l"), F.explode(F.array(*[F.lit(lo + step * i) for i in range(grid + 1)])).alias("a"))
        sums = points.groupBy("a").agg(F.sum(F.exp(F.col("a") * F.col("l"))).alias("z"), F.sum(F.exp(F.col("a") * F.col("l")) * F.col("a") * F.col("l")).alias("e")).collect()
        good = [r["a"] for r in sums if math.log(r["z"]) - r["e"] / r["z"] >= target_entropy * math.log(k) - 1e-12]
        lo = max(good, default=0.0)
        hi = min(1.0, lo + step)
    limit = 1 - math.log(max_repeats) / math.log(big / small) if max_repeats > 1 else 1.0
    return max(lo, limit, 0.0)


def mixture(rows: DataFrame, scratch: Scratch, target_entropy: float = 0.95, max_repeats: float = 4.0) -> DataFrame:
    """One row per source of ``rows`` (``_sized``): tokens, share, exponent, weight, repeats (1 for the source that needs the
    fewest, so that nothing is dropped), budget (tokens)."""
    totals = scratch.table(rows.groupBy("_source").agg(F.sum(F.col("_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("rows")), "totals")
    alpha = solve_exponent(totals, target_entropy, max_repeats)
    n, big = totals.agg(F.sum("tokens"), F.max("tokens")).first()
    z = totals.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(n or 1)), F.lit(alpha)))).first()[0] or 1.0
    share = F.col("tokens") / F.lit(float(n or 1))
    repeats = F.pow(F.lit(float(big or 1)) / F.col("tokens"), F.lit(1 - alpha))
    out = totals.select("_source", "tokens", "rows", share.alias("share"), F.lit(alpha).alias("exponent"), (F.pow(share, F.lit(alpha)) / F.lit(z)).alias("weight"), F.greatest(F.lit(1.0), repeats).alias("repeats"))
    return scratch.table(out.withColumn("budget", F.round(F.col("repeats") * F.col("tokens")).cast("long")), "mixture")


def _joined(df: DataFrame, plan: DataFrame) -> DataFrame:
    return df.join(broadcast_if_small(plan), "_source")


def block_permutation(rows: DataFrame, plan: DataFrame, scratch: Scratch, block_tokens: int = 1_000_000, bucket_rows: int = 512, group_buckets: int = 4_096, seed: int = 17) -> DataFrame:
    """Rows (_id, _source, _tokens, epoch, h, block, slot): each source's documents, permuted anew in each epoch until its
    budget is spent, dealt into blocks so that every block holds the sources by weight.

    A document's place in its source is a prefix sum of tokens over the permutation. It is summed in three steps, totals of
    groups of hash buckets first, then of buckets, then the rows of a bucket, so that no task holds a source: a bucket has
    about ``bucket_rows`` distinct rows whatever the source's share. Equal rows are one until their places are known; they
    stand or fall together at the end of a budget.
    """
    total = plan.agg(F.sum("budget")).first()[0] or 1
    n_blocks = max(1, round(total / block_tokens))
    each = _joined(rows, plan.select("_source", F.col("tokens").alias("n"), "rows", "repeats", "budget"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("repeats") - 1e-9).cast("int") - 1)).alias("epoch"))
    buckets = F.ceil(F.col("rows") / bucket_rows)
    bucket = F.floor(F.col("h") / F.lit(float(1 << _BITS)) * buckets).cast("long")
    each = each.withColumn("h", _order(seed, F.col("epoch"))).withColumn("bucket", bucket).withColumn("group", F.floor(F.col("bucket") / group_buckets))
    each = scratch.table(each.select("_id", "_source", "_tokens", "_text", "copies", "epoch", "n", "budget", "h", "bucket", "group"), "dealt")
    by = ["_source", "epoch", "group"]
    sums = scratch.table(each.groupBy(*by, "bucket").agg(F.sum(F.col("_tokens") * F.col("copies")).alias("inside")), "buckets")
    upto = lambda keys, order: F.sum("inside").over(Window.partitionBy(*keys).orderBy(order)) - F.col("inside")
    groups = sums.groupBy(*by).agg(F.sum("inside").alias("inside")).select(*by, upto(by[:2], "group").alias("before_group"))
    before = sums.select(*by, "bucket", upto(by, "bucket").alias("before_bucket")).join(groups, by)
    rest = Window.partitionBy(*by, "bucket").orderBy("h", "_id", "_tokens", "_text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("epoch") * F.col("n") + F.col("before_group") + F.col("before_bucket") + F.coalesce(F.sum(F.col("_tokens") * F.col("copies")).over(rest), F.lit(0))
    placed = each.join(before, [*by, "bucket"]).withColumn("start", start).where(F.col("start") < F.col("budget"))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("at", F.col("start") + F.col("copy") * F.col("_tokens"))
    dealt = placed.withColumn("block", F.least(F.lit(n_blocks - 1), F.floor(F.col("at") / F.col("budget") * n_blocks)).cast("int"))
    slot = F.row_number().over(Window.partitionBy("block").orderBy("h", "_source", "_id", "epoch", "_text", "copy")) - 1
    return dealt.select("_id", "_source", "_tokens", "epoch", "h", "block", slot.cast("long").alias("slot"))


def mix_sources(docs: DataFrame, target_entropy: float = 0.95, max_repeats: float = 4.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixed sequence of ``docs``: doc_id, source, tokens, epoch, block, slot, and its source's exponent, weight, repeats.

    Null source: a source of its own (returned as null). Null or empty text counts one token. Null ids are kept. Repeated
    rows are dealt each. Very long texts: a block holds at least one row. One source: weight 1, one epoch. Empty table: empty
    result. Further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.table(_sized(docs, id_col, source_col, text_col), "rows")
    plan = mixture(rows, scratch, target_entropy, max_repeats)
    dealt = block_permutation(rows, plan, scratch, **options)
    named = _joined(dealt, plan.select("_source", "exponent", "weight", "repeats"))
    return named.select(F.col("_id").alias("doc_id"), _source_name("_source").alias("source"), F.col("_tokens").alias("tokens"), "epoch", "block", "slot", "exponent", "weight", "repeats")


def repeat_documents(docs: DataFrame, target_entropy: float = 0.95, max_repeats: float = 4.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with as many copies of each row as ``mix_sources`` deals: the whole epochs of its source, and one more for rows
    before the budget's end in the last epoch's permutation. No row is dropped; columns, of any name, are unchanged. Texts are
    not shuffled: a row's own hash tells whether it stands before the end. Nulls, empty texts and tables as in ``mix_sources``.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.table(_sized(docs, id_col, source_col, text_col), "rows")
    plan = mixture(rows, scratch, target_entropy, max_repeats)
    dealt = scratch.table(block_permutation(rows, plan, scratch, **options), "mixed")
    last = plan.select("_source", (F.ceil(F.col("repeats") - 1e-9).cast("int") - 1).alias("last"))
    cut = _joined(dealt, last).where("epoch = last").groupBy("_source").agg(F.max("h").alias("cut"))
    limits = Scratch(docs.sparkSession, "mixing").table(last.join(cut, "_source", "left"), "limits")
    scratch.drop()
    text = carried(docs, [id_col, text_col], docs.columns).toDF("_id", "_body", "_kept")
    source = F.coalesce(F.concat(F.lit("="), F.col("_kept").getField(source_col).cast("string")), F.lit("null"))
    each = _joined(text.select("_id", "_kept", source.alias("_source"), F.md5(F.coalesce("_body", F.lit("")).cast("binary")).alias("_text")), limits)
    own = _order(options.get("seed", 17), F.col("last"))
    times = F.greatest(F.col("last") + F.coalesce((own <= F.col("cut")).cast("int"), F.lit(0)), F.lit(1))
    return uncarried(each.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))), [], docs.columns, [])
