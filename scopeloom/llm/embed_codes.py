"""Near-duplicate embeddings by rotated binary codes with stored correction factors."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, merge, ship

ship(__name__)

#: Cells that are sent and searched together.
CELLS_A_PACK = 4


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float64)


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows of ``x`` rotated, their sign codes (bits), and each code's inner product with its own vector: the factor that
    makes ``code . q / factor`` an unbiased estimate of ``x . q``."""
    y = x @ turn.T
    bits = y > 0
    factor = np.abs(y).sum(1) / np.sqrt(x.shape[1])
    return y, bits, factor


def error_bound(factor: np.ndarray, dim: int, sigmas: float) -> np.ndarray:
    """Half width of the estimate's confidence interval; the error's deviation falls with the root of the dimension."""
    return sigmas * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1))


def centroids(sample: np.ndarray, k: int, rounds: int = 5, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, near, sample)
        n = np.linalg.norm(s, axis=1)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1e-12)[:, None], c)
    return c


def near_embeddings(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", cell_rows: int = 2_000, block_rows: int = 2_048, sample: int = 16_000, sigmas: float = 4.0) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Equal vectors are one point with a count. A point lives in the nearest of a number of cells that grows with the table
    (centroids are fitted on a bounded sample; every point is indexed), and visits every other cell that can hold a vector
    within the angle of ``least``: the plane between the two centroids is no farther than that, nor is the cap that holds the
    cell's points. So no pair is missed for want of a common cell, however dense a group; where the bounds prune nothing, as
    among random directions, all pairs are compared. Neighbouring numbers of cells share a pack, so that a point is sent to
    it once; of two packs, the one of the smaller number visits, hence a pair is judged once. A pack of any size is cut into
    blocks, and each pair of blocks is a task. A pair's inner product is estimated from one point's code and the other's
    rotated vector; only where the upper confidence bound (``sigmas`` deviations) reaches ``least`` is the cosine computed,
    in double precision, and it alone links.

    A task returns numbers of links per point and one edge per member of its local classes, not the pairs. Vectors that are
    null, empty, zero or hold null, infinite or NaN components link with nothing; vectors of different lengths never link.
    Rows without id keep their row and link like any other; a class's id is the smallest that isn't null (else null, and its
    rows without id are kept). Repeated rows are rows. Empty table: empty result. Further columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "embed")
    v = F.col(vec_col)
    kind = "float" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "double"
    norm = F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    fine = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm > 0), F.lit(False))
    keyed = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, v.cast(f"array<{kind}>")).alias("v"))
    keyed = scratch.table(keyed.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(11), "v").alias("h2")), "rows")
    points = scratch.table(keyed.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"), F.first("v").alias("v")).withColumns({"dim": F.size("v"), "point": F.monotonically_increasing_id()}), "points")
    dims = [(r[0], r[1]) for r in points.groupBy("dim").count().orderBy("dim").collect()]
    found = None

    def search(dim: int, n: int) -> DataFrame:
        part = points.where(F.col("dim") == dim)
        # the rows with the least hashes, about ``sample`` of them, by a filter: a sorted limit would send as many from each partition
        drawn = part if n <= sample else part.where(F.col("h1") < int((sample / n - 0.5) * 2**64))
        some = np.array([r[0] for r in sorted(drawn.select("v", "h1", "h2").collect(), key=lambda r: (r[1], r[2]))], np.float64)
        some /= np.linalg.norm(some, axis=1, keepdims=True)
        k = int(max(1, min(len(some) // 4, -(-n // cell_rows)))) if len(some) >= 8 else 1
        centers, turn = centroids(some, k), rotation(dim)
        between = np.sqrt(np.maximum(2 - 2 * centers @ centers.T, 0))
        reach = np.arccos(np.clip(least, -1, 1)) + 1e-6
        tile = block_rows * CELLS_A_PACK

        def slices(b):
            """Unit rows, their inner products with the centroids and their home cells, some rows at a time."""
            x = np.array(b.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            for at in range(0, len(u), 1_024):
                near = u[at : at + 1_024] @ centers.T
                yield near, near.argmax(1)

        def caps(batches):
            low = np.full(k, 2.0)
            for b in batches:
                for near, home in slices(b):
                    np.minimum.at(low, home, near[np.arange(len(home)), home])
            cells = np.flatnonzero(low < 2)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(low[cells])], ["cell", "low"])

        # one small row for each of the fitted centroids
        width = np.full(k, -np.inf)
        for cell, low in part.select("v").mapInArrow(caps, "cell long, low double").groupBy("cell").agg(F.min("low")).collect():
            width[cell] = np.arccos(np.clip(low, -1, 1))

        def route(batches):
            for b in batches:
                homes, counts, packs = [], [], []
                for near, home in slices(b):
                    own = near[np.arange(len(home)), home]
                    beyond = own[:, None] - near > np.sin(min(reach, np.pi / 2)) * between[home] + 1e-9
                    may = ~beyond & (np.arccos(np.clip(near, -1, 1)) <= width + reach)
                    may = np.pad(may, ((0, 0), (0, -k % CELLS_A_PACK))).reshape(len(home), -1, CELLS_A_PACK).any(2)
                    may &= np.arange(may.shape[1]) > (home // CELLS_A_PACK)[:, None]
                    homes.append(home // CELLS_A_PACK), counts.append(may.sum(1)), packs.append(np.nonzero(may)[1])
                if homes:
                    ends = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int32)
                    visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(packs).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column("point"), b.column("mult"), b.column("v"), pa.array(np.concatenate(homes).astype(np.int32)), visits], ["point", "mult", "v", "home", "visits"])

        routed = scratch.table(part.select("point", "mult", "v").mapInArrow(route, f"point long, mult long, v array<{kind}>, home int, visits array<int>"), f"routed-{dim}")
        sent = routed.select("home", F.explode(F.concat(F.array("home"), "visits")).alias("pack"))
        blocks = lambda here: F.ceil(F.sum((F.col("home") == F.col("pack") if here else F.col("home") != F.col("pack")).cast("long")) / tile).cast("int")
        sizes = sent.groupBy("pack").agg(blocks(True).alias("homes"), blocks(False).alias("guests"))
        dealt = routed.withColumn("pack", F.explode(F.concat(F.array("home"), "visits"))).join(F.broadcast(sizes), "pack")
        lives = F.col("home") == F.col("pack")
        dealt = dealt.withColumn("own", F.when(lives, F.pmod(F.xxhash64("point"), "homes")).otherwise(F.col("homes") + F.pmod(F.xxhash64("point"), "guests")).cast("int"))
        others = F.sequence(F.lit(0), F.when(lives, F.col("homes") + F.col("guests")).otherwise(F.col("homes")) - 1)
        dealt = dealt.withColumn("other", F.explode(others)).select("pack", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "point", "mult", "v")

        def cosine(x, e, f):
            return np.einsum("nd,nd->n", x[e], x[f]) / np.sqrt(np.einsum("nd,nd->n", x[e], x[e]) * np.einsum("nd,nd->n", x[f], x[f]))

        def compare(key, t):
            _, i, j = (k.as_py() for k in key)
            t = t.sort_by("point")
            point, mult, own = (t.column(c).to_numpy() for c in ("point", "mult", "own"))
            x = t.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            y, bits, factor = encode(u, turn)
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            codes = (np.where(bits[b], 1.0, -1.0) / np.sqrt(dim) / factor[b][:, None]).astype(np.float32).T
            need = (least - error_bound(factor[b], dim, sigmas)).astype(np.float32)
            links, parent = np.zeros(len(point), np.int64), np.arange(len(point))
            for s in range(0, len(a), 512):
                q = a[s : s + 512]
                row, col = np.nonzero(y[q].astype(np.float32) @ codes >= need)
                if i == j:
                    later = q[row] < b[col]
                    row, col = row[later], col[later]
                e, f = q[row], b[col]
                if len(e) * 32 > len(q) * len(b):  # a dense group: all products at once, those near the limit again
                    exact = (u[q] @ u[b].T)[row, col]
                    close = np.abs(exact - least) < 1e-9
                    exact[close] = cosine(x, e[close], f[close])
                else:
                    exact = cosine(x, e, f)
                e, f = e[exact >= least], f[exact >= least]
                np.add.at(links, e, mult[f])
                np.add.at(links, f, mult[e])
                parent = merge(parent, e, f)
            child, linked = np.flatnonzero(parent != np.arange(len(point))), np.flatnonzero(links)
            return pa.table({"a": pa.array(np.r_[point[parent[child]], point[linked]]), "b": pa.array(np.r_[point[child], np.full(len(linked), -1)]), "n": pa.array(np.r_[np.zeros(len(child), np.int64), links[linked]])})

        return dealt.groupBy("pack", "i", "j").applyInArrow(compare, "a long, b long, n long")

    for dim, n in dims:
        got = search(dim, n)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = scratch.table(found, "found")
    links = found.where("n > 0").groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("others"))
    classes = connected_components(found.where("n = 0").select("a", "b"), scratch).select(F.col("node").alias("point"), "component")
    known = points.select("h1", "h2", "point", "mult", "least").join(links, "point", "left").join(classes, "point", "left")
    known = scratch.table(known.withColumn("component", F.coalesce("component", "point")), "known")
    named = known.join(known.groupBy("component").agg(F.min("least").alias("component_id")), "component").drop("component", "least", "point")
    rows = keyed.join(named, ["h1", "h2"], "left")
    fine = F.col("v").isNotNull()
    n_links = F.when(fine, F.col("mult") - 1 + F.coalesce("others", F.lit(0))).otherwise(0).cast("long")
    component = F.when(fine, F.col("component_id")).otherwise(F.col("vec_id"))
    return rows.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
