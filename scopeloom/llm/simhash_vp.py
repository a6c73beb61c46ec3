"""SimHash fingerprints and exact Hamming neighbours by vantage-point trees."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, merge, roots, ship

ship(__name__)

_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SEED = 0x9E3779B97F4A7C15


def simhash(text: str | None, words: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """Majority bits of the shingles' XXH64, counted in blocks so that memory doesn't grow with the text."""
    import xxhash

    tokens = (text or "").encode("utf-8", "replace").translate(_LOW).split()
    if not tokens:
        return 0
    whole = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(([digest(whole[a:b], seed) for a, b in zip(starts[i : i + block], stops[i : i + block])] for i in range(0, len(starts), block)), len(starts))


def majority(hashes, n: int) -> int:
    """The bits that more than half of ``n`` hashes have, which come in blocks."""
    total = np.zeros(64, np.int64)
    for h in hashes:
        total += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 3) -> DataFrame:
    """doc_id and fingerprint (a signed 64-bit long) of each whole text."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([simhash(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return slim.mapInArrow(run, "doc_id long, fp long")


class Tree:
    """Vantage points and radii of the upper levels, level order: node k has children 2k+1 (within the radius) and 2k+2."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels, self.points, self.radii = levels, [], []
        groups = [sample]
        for _ in range(levels):
            below = []
            for g in groups:
                v = np.uint64(((len(self.points) + 1) * _SEED) & 0xFFFFFFFFFFFFFFFF)
                d = np.bitwise_count(g ^ v)
                r = int(np.median(d)) if len(d) else 32
                self.points.append(v)
                self.radii.append(r)
                below += [g[d <= r], g[d > r]]
            groups = below

    def home(self, x: np.ndarray) -> np.ndarray:
        k = np.zeros(len(x), np.int64)
        v, r = np.array(self.points, np.uint64), np.array(self.radii)
        for _ in range(self.levels):
            k = 2 * k + 1 + (np.bitwise_count(x ^ v[k]) > r[k])
        return k

    def visits(self, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into x, leaf) of every leaf that can hold a point within ``reach``: triangle bounds prune the others."""
        i, k = np.arange(len(x)), np.zeros(len(x), np.int64)
        if not self.levels:
            return i, k
        v, r = np.array(self.points, np.uint64), np.array(self.radii)
        for _ in range(self.levels):
            d = np.bitwise_count(x[i] ^ v[k]).astype(np.int64)
            inner, outer = d - reach <= r[k], d + reach > r[k]
            i, k = np.concatenate([i[inner], i[outer]]), np.concatenate([2 * k[inner] + 1, 2 * k[outer] + 2])
        return i, k


def near_pairs(points: np.ndarray, queries: np.ndarray, reach: int, leaf: int = 64):
    """Yields index arrays (point, query) of all pairs within ``reach``: a vantage-point tree built and searched at once.

    Each split sends a query to the sides that its distance to the vantage point leaves possible. Leaves, and nodes where
    nothing is split off any more, are compared in blocks.
    """
    stack = [(np.arange(len(points)), np.arange(len(queries)), 0)]
    rng = np.random.default_rng(len(points))
    while stack:
        p, q, depth = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > leaf and depth < 40:
            v = points[p[rng.integers(len(p))]]
            dp, dq = np.bitwise_count(points[p] ^ v).astype(np.int16), np.bitwise_count(queries[q] ^ v).astype(np.int16)
            r = np.int16(np.median(dp))
            inner = dp <= r
            if inner.all():
                r = np.int16(r - 1) if (dp < r).any() else r
                inner = dp <= r
            if inner.any() and not inner.all():
                stack.append((p[inner], q[dq - reach <= r], depth + 1))
                stack.append((p[~inner], q[dq + reach > r], depth + 1))
                continue
        a = points[p]
        step = max(1, (1 << 18) // len(a))
        for i in range(0, len(q), step):
            hit = np.bitwise_count(queries[q[i : i + step]][:, None] ^ a[None, :]) <= reach
            if hit.any():
                y, x = np.nonzero(hit)
                yield p[x], q[i + y]


def link_fingerprints(distinct: DataFrame, scratch: Scratch, reach: int = 3, per_shard: int = 65_536, sample: int = 8_192, least_levels: int = 4) -> DataFrame:
    """Edges (a, b) that join exactly the connected classes of fingerprints at ``reach`` or fewer differing bits.

    ``distinct`` has one row per fingerprint (``fp``). The tree has as many levels as bring a shard to ``per_shard`` points.
    Radii come from a bounded sample; every row is indexed: it lives in one shard, and visits as a query all shards that the
    triangle bounds leave possible. A shard's visitors are dealt over as many tasks as their number asks for, each with the
    shard's points. A task returns the links of its local classes, one per member, rather than all pairs of a dense group.
    """
    n = distinct.count()
    levels = max(least_levels, int(np.ceil(np.log2(max(1, n / per_shard)))))
    # the rows with the least hashes, about ``sample`` of them, by a filter: a sorted limit would send as many from each partition
    h = F.xxhash64("fp", F.lit(7))
    drawn = distinct if n <= sample else distinct.where(h < int((sample / n - 0.5) * 2**64))
    some = sorted(r[0] for r in drawn.select("fp").collect())
    tree = Tree(np.array(some, np.int64).view(np.uint64), levels)

    def route(batches):
        for b in batches:
            x = b.column("fp").to_numpy(zero_copy_only=False)
            u = x.view(np.uint64)
            i, leaf = tree.visits(u, reach)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(x[i]), pa.array(tree.home(u)[i] == leaf)], ["leaf", "fp", "home"])

    routed = scratch.table(distinct.select("fp").mapInArrow(route, "leaf int, fp long, home boolean"), "routed")
    sizes = routed.groupBy("leaf").agg(F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("home")) / (4 * per_shard))).cast("int").alias("tasks"))
    own = F.sequence(F.lit(0), F.col("tasks") - 1)
    task = F.when(F.col("home"), own).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("tasks")).cast("int")))
    dealt = routed.join(sizes, "leaf").select("leaf", "fp", "home", F.explode(task).alias("task"))

    def search(key, t):
        x = t.column("fp").to_numpy()
        home = t.column("home").to_numpy()
        order = np.argsort(x, kind="stable")  # so that a root is the smallest fingerprint
        x, home = x[order], home[order]
        u, at = x.view(np.uint64), np.flatnonzero(home)
        parent = np.arange(len(x))
        for p, q in near_pairs(u[at], u, reach):
            p = at[p]
            keep = p != q
            if keep.any():
                parent = merge(parent, p[keep], q[keep])
        parent = roots(parent)
        child = np.flatnonzero(parent != np.arange(len(x)))
        return pa.table({"a": x[parent[child]], "b": x[child]})

    return scratch.table(dealt.groupBy("leaf", "task").applyInArrow(search, "a long, b long"), "links")


def simhash_components(docs: DataFrame, reach: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id per row of ``docs``: near-duplicate classes of whole texts.

    Equal fingerprints are one point of the search; classes are found between points and carried back by a join, so groups
    of copies are never paired. Null and empty texts have fingerprint zero and link like any other. Null ids keep their row
    (their class takes the smallest id that isn't null, else null). Repeated rows each return. A very long text is hashed in
    blocks. Empty table: empty result. Further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table(fingerprints(docs, text_col, id_col, words), "fp")
    points = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    linked = connected_components(link_fingerprints(points.select("fp"), scratch, reach), scratch)
    named = points.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = scratch.table(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")
