"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash find candidates, the shingles themselves decide."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash_vp
from .common import Scratch, broadcast_if_small, carried, connected_components, ship, uncarried

ship(__name__)

_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bands and hashes in each: a pair of similarity 0.8 shares no band with probability (1 - 0.8^4)^32, about 5e-8.
BANDS, ROWS = 32, 4


def shingles(text: str | None, words: int = 5) -> set[bytes]:
    """The distinct shingles of a text (ASCII letters lower-cased); a shorter text is one shingle, an empty one has none."""
    tokens = (text or "").encode("utf-8", "replace").translate(_LOW).split()
    if not tokens:
        return set()
    return {b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))}


def signature(hashes: np.ndarray, block: int = 2_048) -> np.ndarray:
    """One key per band from sorted distinct 64-bit hashes, taken in blocks so that memory doesn't grow with the text."""
    rng = np.random.default_rng(17)
    flip, turn = rng.integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
    turn |= np.uint64(1)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), block):
        low = np.minimum(low, ((hashes[i : i + block, None] ^ flip) * turn).min(0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _hashes(text: str | None, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    import xxhash

    return np.array(sorted(xxhash.xxh64_intdigest(s, 42) for s in shingles(text, words)), np.uint64)


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """Per row: number of distinct shingles, two hashes of their set, its SimHash and the bands' keys."""

    def run(batches):
        import xxhash

        for b in batches:
            n, h1, h2, fp, keys = [], [], [], [], []
            for t in b.column(1).to_pylist():
                h = _hashes(t, words)
                n.append(len(h))
                raw = h.tobytes()
                h1.append(xxhash.xxh64_intdigest(raw, 1)), h2.append(xxhash.xxh64_intdigest(raw, 2))
                fp.append(simhash_vp.majority([h], len(h)) if len(h) else 0)
                keys.append(signature(h) if len(h) else np.zeros(BANDS, np.int64))
            flat = pa.array(np.concatenate(keys)) if keys else pa.array([], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * BANDS, BANDS, dtype=np.int32)), flat)
            hashed = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2, fp)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *hashed, lists], ["row", "n", "h1", "h2", "fp", "keys"])

    return rows.select("row", "text").mapInArrow(run, "row long, n long, h1 long, h2 long, fp long, keys array<long>")


def _numbered(rows: DataFrame, wanted: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows whose number (``row``) is in ``wanted``, without a shuffle of their texts: numbers of neighbouring rows are sent as
    one string of bits. A row costs a bit or so, where ids of eight bytes soon are too many to be sent to every task. Over
    ``BROADCAST_BYTES`` of bits, Spark chooses a shuffle join."""
    at = F.bitmap_bit_position("row")
    bits = wanted.groupBy(F.bitmap_bucket_number("row").alias("_bucket")).agg(F.bitmap_construct_agg(at).alias("bits"), F.max(at).alias("last"))
    bits = scratch.table(bits.select("_bucket", F.substring("bits", F.lit(1), F.floor(F.col("last") / 8).cast("int") + 1).alias("_bits")), name)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(F.coalesce(byte, F.lit(0)), (at % 8).cast("int")) == 1
    return rows.join(broadcast_if_small(bits), (F.bitmap_bucket_number("row") == F.col("_bucket")) & hit, "left_semi")


def _sets(rows: DataFrame, wanted: DataFrame, words: int, scratch: Scratch, name: str) -> DataFrame:
    """(point, set) of the rows in ``wanted`` (point): their shingles' hashes, made of the texts again. Sets are larger than most
    texts and few are compared, so they are neither kept nor sent for the others."""

    def run(batches):
        for b in batches:
            sets = [_hashes(t, words).view(np.int64) for t in b.column(1).to_pylist()]
            ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))], ["point", "set"])

    found = _numbered(rows.select("row", "text"), wanted.select(F.col("point").alias("row")), scratch, f"{name}-wanted")
    return scratch.table(found.mapInArrow(run, "point long, set array<long>"), f"{name}-sets")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles (``point``, ``set``) have a Jaccard similarity of ``least`` or more."""
    left = sets.select(F.col("point").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("point").alias("b"), F.col("set").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    joined = pairs.join(right, "b").join(left, "a")
    return joined.where(both >= F.lit(least) * (F.size("left") + F.size("right") - both)).select("a", "b")


def _common(x: list[np.ndarray], y: list[np.ndarray], width: int = 8_192) -> np.ndarray:
    """Numbers of common shingles of each of ``x`` with each of ``y``: products of 0/1 rows, some shingles at a time."""
    known, column = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    twice = np.bincount(column, minlength=len(known)) > 1  # a shingle of one set alone is common to none
    place = np.cumsum(twice) - 1
    owner, column = owner[twice[column]], place[column[twice[column]]]
    out = np.zeros((len(x), len(y)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(twice.sum()), width):
        s = slice(*np.searchsorted(column, (at, at + width)))
        rows = np.zeros((len(x) + len(y), width), np.float32)
        rows[owner[s], column[s] - at] = 1
        out += rows[: len(x)] @ rows[len(x) :].T
    return out


def _blocks(groups: DataFrame, columns: list[str], block: int = 256) -> DataFrame:
    """Bands (``key``) of any size cut into blocks, a row for each pair of blocks (i, j) that a point (of block ``own``) is in."""
    sizes = groups.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")
    dealt = groups.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *columns)


def _related(groups: DataFrame) -> DataFrame:
    """(key, point) of a band's points that share another band too with a point of another component, in the first band of the
    pair, which is where ``_within`` compares it. A pair of similarity 0.8 shares one band alone with a probability of 1.1e-6;
    most points that meet by chance do, and their sets need not be sent."""

    def find(key, t):
        point, component, own = (t.column(c).to_numpy() for c in ("point", "component", "own"))
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(point), BANDS)
        x, y = np.flatnonzero(own == key[1].as_py()), np.flatnonzero(own == key[2].as_py())
        same = keys[x][:, None, :] == keys[y][None, :, :]
        hit = (same.sum(2) > 1) & (same.argmax(2) == (keys[x] == key[0].as_py()).argmax(1)[:, None]) & (component[x][:, None] != component[y][None, :])
        found = np.union1d(point[x[hit.any(1)]], point[y[hit.any(0)]])
        return pa.table({"key": pa.array(np.full(len(found), key[0].as_py(), np.int64)), "point": pa.array(found.astype(np.int64))})

    return _blocks(groups, ["point", "component", "keys"]).groupBy("key", "i", "j").applyInArrow(find, "key long, point long").distinct()


def _within(groups: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join the points of each band (``key``, ``point``, ``component``, ``set``, ``keys``) as those of all pairs
    of different components would. A pair is compared in the first band that it shares. A task returns one link per point it
    joins, not the pairs."""
    dealt = _blocks(groups, ["point", "component", "set", "keys"])

    def compare(key, t):
        band, i, j = (k.as_py() for k in key)
        point, component, own = (t.column(c).to_numpy() for c in ("point", "component", "own"))
        names, parent = np.unique(component, return_inverse=True)
        if len(names) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(point), BANDS)
        lists = t.column("set").combine_chunks()
        sets = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        n = np.array([len(s) for s in sets], np.float32)
        both = _common([sets[k] for k in x], [sets[k] for k in y])
        hit = both >= np.float32(least) * (n[x][:, None] + n[y][None, :] - both) - np.float32(1e-3)
        e, f = (z[w] for z, w in zip((x, y), np.nonzero(hit)))
        first = keys[e] == keys[f]
        differ = (component[e] != component[f]) & (first.argmax(1) == (keys[e] == band).argmax(1))
        a, b = [], []
        for p, q in zip(e[differ].tolist(), f[differ].tolist()):
            if parent[p] != parent[q]:
                both_ = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if both_ >= least * (n[p] + n[q] - both_):
                    parent[parent == parent[q]] = parent[p]
                    a.append(int(point[p])), b.append(int(point[q]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def classes(rows: DataFrame, scratch: Scratch, least: float = 0.8, words: int = 5) -> DataFrame:
    """(row, component) of every row of ``rows`` (row, text; written, row numbers distinct): the connected classes of texts
    whose sets of shingles have a Jaccard similarity of ``least`` or more.

    Rows with equal sets are one point. First candidates are the neighbours at three bits or fewer of the points' SimHash, by
    vantage-point trees (``simhash_vp``), and of each MinHash band the smallest and the largest point, which joins a large group
    of copies by few comparisons; then, of each band that is still in several classes, the point that shares most with others,
    which joins the variants of one text. Last, all pairs of such a band that are in different classes are compared, block by
    block (``_within``), so the classes are those of all pairs. Each candidate is decided by its shingles, named by 64-bit
    hashes, which are made for the candidates' texts only. (SimHash alone would need a reach of some 16 bits for a similarity of 0.8, where triangle bounds prune nothing.)
    Only groups of texts that are alike but below ``least`` cost all their pairs. Texts without words are one class. What
    ``scratch`` holds is needed until the result is written.
    """
    sketches = scratch.table(_sketches(rows, words), "sketches")
    sets = scratch.table(sketches.groupBy("h1", "h2").agg(F.min("row").alias("point")), "sets")
    points = sketches.where("n > 0").join(sets.select(F.col("point").alias("row")), "row", "left_semi").withColumnRenamed("row", "point")
    points = scratch.table(points.drop("h1", "h2"), "points")
    bands = scratch.table(points.select("point", "n", F.explode("keys").alias("key")), "bands")
    shared = bands.groupBy("key").agg(F.min("point").alias("low"), F.max("point").alias("high"), F.count("*").alias("size")).where("low < high")
    bands = scratch.table(bands.join(shared, "key"), "shared")
    scratch.drop("bands")
    sizes = lambda x, y: F.least(x, y) >= F.lit(least) * F.greatest(x, y) - 1e-9

    def tried(ends: DataFrame, name: str) -> DataFrame:
        """Links among (point, end, n): each pair once, if its sizes allow it."""
        both = ends.distinct().join(points.select(F.col("point").alias("end"), F.col("n").alias("m")), "end")
        both = both.where(sizes(F.col("n"), F.col("m"))).select(F.least("point", "end").alias("a"), F.greatest("point", "end").alias("b")).distinct()
        both = scratch.table(both, f"{name}-pairs")
        shingled = _sets(rows, both.select(F.explode(F.array("a", "b")).alias("point")), words, scratch, name)
        links = scratch.table(_verified(both, shingled, least), name)
        scratch.drop(f"{name}-sets")
        return links

    def often(ends: DataFrame) -> DataFrame:
        """Points that meet an end in several bands: similar texts do so in 13 of 32, texts with some lines in common in one or two.
        This only spares comparisons: what it leaves out is compared in the end."""
        return ends.where("point <> end").groupBy("point", "end", "n").agg(F.count("*").alias("bands")).where(F.col("bands") >= 3).drop("bands")

    def named(links: DataFrame, name: str) -> DataFrame:
        """Bands with the components of their points, those alone that have several."""
        own = Scratch(scratch.spark, f"near-{name}")
        found = connected_components(links, own)
        each = bands.join(found.withColumnRenamed("node", "point"), "point", "left").withColumn("component", F.coalesce("component", "point"))
        each = scratch.table(each, name)
        own.drop()
        return each.join(each.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("key"), "key")

    prints = scratch.table(points.groupBy("fp").agg(F.min("point").alias("least")), "prints")
    linked = simhash_vp.link_fingerprints(prints.select("fp"), scratch)
    linked = linked.join(prints.select(F.col("fp").alias("a"), F.col("least").alias("end")), "a").join(prints.select(F.col("fp").alias("b"), F.col("least").alias("point")), "b").select("point", "end")
    alike = points.select("point", "fp").join(prints, "fp").where("point <> least").select("point", F.col("least").alias("end"))
    alike = alike.unionByName(linked).join(points.select("point", "n"), "point").select("point", "end", "n")
    links = tried(often(bands.select("point", F.explode(F.array("low", "high")).alias("end"), "n")).unionByName(alike), "ends")

    open_ = named(links, "after-ends")
    weight = bands.groupBy("point").agg(F.sum("size").alias("weight"))
    heads = open_.join(weight, "point").groupBy("key").agg(F.max_by("point", F.struct("weight", "point")).alias("end"))
    links = scratch.table(links.unionByName(tried(often(open_.join(heads, "key").select("point", "end", "n")), "heads")), "ends-and-heads")

    left = scratch.table(named(links, "after-heads").select("key", "point", "component").join(points.select("point", "keys"), "point"), "open")
    for done in ("points", "shared", "after-ends", "after-heads", "prints", "routed"):
        scratch.drop(done)
    related = scratch.table(left.join(_related(left), ["key", "point"], "left_semi"), "related")
    shingled = _sets(rows, related, words, scratch, "related")
    links = scratch.table(links.unionByName(_within(related.join(shingled, "point"), least)), "all-links")
    scratch.drop("related-sets")
    found = connected_components(links, scratch)
    joined = sketches.select("row", "h1", "h2").join(sets, ["h1", "h2"]).join(found.withColumnRenamed("node", "point"), "point", "left")
    return joined.select("row", F.coalesce("component", "point").alias("component"))


def drop_near_copies(docs: DataFrame, least: float = 0.8, words: int = 5) -> DataFrame:
    """``docs`` with exactly one row of each class: the smallest id (null ids last), then the smallest hash of the text, then
    the smallest number of the row in a written copy of ``docs``. Repeated rows and ids are rows like any other; texts without
    words, null or empty, are one class. Very long texts: memory grows with their shingles. Empty table: empty result.
    Further columns of any name are kept."""
    scratch, found = Scratch(docs.sparkSession, "near-copies"), Scratch(docs.sparkSession, "near-classes")
    rows = scratch.table(carried(docs, [], docs.columns).withColumn("row", F.monotonically_increasing_id()), "rows")
    keyed = rows.select("row", *[F.col("_kept").getField(c).alias(c) for c in ("doc_id", "text")])  # each text is written once
    named = classes(keyed, found, least, words).join(keyed.select("row", "doc_id", F.xxhash64("text").alias("t")), "row")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "row")).alias("first"))
    kept = _numbered(rows, first.select(F.col("first.row").alias("row")), scratch, "kept")
    found.drop()
    return uncarried(kept, [], docs.columns, [])
