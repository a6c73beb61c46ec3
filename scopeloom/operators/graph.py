"""Building and changing graphs, predicates, degrees, filters, local nodes, and the shadowing of paths."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import JUMP, ROOT
from ..session import Scratch


def first_wins(edges: DataFrame) -> DataFrame:
    """One edge per (source, sink): the first inserted keeps its precedence."""
    return edges.groupBy("source", "sink").agg(F.min_by("precedence", "ord").alias("precedence"), F.min("ord").alias("ord"))


def set_precedence(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with new precedences where ``changes`` (source, sink, precedence) has one; unknown edges are ignored."""
    new = changes.select("source", "sink", F.col("precedence").alias("new"))
    return edges.join(new, ["source", "sink"], "left").withColumn("precedence", F.coalesce("new", "precedence")).drop("new")


def add_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert; ids that are taken, or given before in ``new``, are refused."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(key), key, "left_anti"))


def get_or_create(files: DataFrame, names: DataFrame) -> DataFrame:
    """(file, existed) for every distinct name: rows that are there stay, the others are made."""
    return names.select("file").distinct().join(files.select("file", F.lit(True).alias("existed")).distinct(), "file", "left").fillna({"existed": False})


def symbols(nodes: DataFrame) -> DataFrame:
    """The distinct symbols of a graph: an added symbol that is there already is the one that is there."""
    return nodes.where(F.col("symbol").isNotNull()).select("symbol").distinct()


def strings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct strings that a graph says of its nodes and edges: syntax types, lines, names, keys and values."""
    plain = nodes.select(F.explode(F.array_compact(F.array("syntax_type", "containing_line", "fully_qualified_name"))).alias("string"))
    said = nodes.select("debug_info").unionByName(edges.select("debug_info")).select(F.explode("debug_info").alias("d"))
    return plain.union(said.select(F.explode(F.array("d.key", "d.value")))).distinct()


def files(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("file").isNotNull()).select("file").distinct()


def get_file(nodes: DataFrame, name: str) -> DataFrame:
    """One row if the graph has the file, else none."""
    return files(nodes).where(F.col("file") == name)


def nodes_for_file(nodes: DataFrame, file: str) -> DataFrame:
    """The nodes of a file, without those of no file."""
    return nodes.where(F.col("file") == file)


def node_for_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes that (file, local_id) name."""
    return nodes.join(ids.select("file", "local_id").distinct(), ["file", "local_id"], "left_semi")


def outgoing_edges(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return edges.join(sources.select(F.col("nid").alias("source")).distinct(), "source", "left_semi")


def merge_graphs(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of both; an error if a file is in both."""
    clash = a[0].select("file").join(b[0].select("file"), "file").where("file is not null").select("file").limit(1).collect()
    if clash:
        raise ValueError(f"file {clash[0][0]} is in both graphs")
    return a[0].unionByName(b[0].where("file is not null")), a[1].unionByName(b[1])


def new_node_ids(nodes: DataFrame) -> DataFrame:
    return nodes.where("file is not null").groupBy("file").agg((F.max("local_id") + 1).alias("next_id"))


def is_endpoint() -> Column:
    return F.col("is_definition") | F.col("is_exported") | F.col("is_reference") | (F.col("kind") == "root")


def degrees(edges: DataFrame) -> DataFrame:
    """Incoming edges per node, and the count saturated at 2 (none, one, multiple)."""
    return edges.groupBy(F.col("sink").alias("nid")).agg(F.count("*").alias("n")).withColumn("degree", F.least("n", F.lit(2)).cast("int"))


def add_degrees(*tables: DataFrame) -> DataFrame:
    """Degrees of several graphs' parts as one: counts add up, and are saturated again."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return both.groupBy("nid").agg(F.sum("n").alias("n")).withColumn("degree", F.least("n", F.lit(2)).cast("int"))


def path_degrees(paths: DataFrame) -> DataFrame:
    """How many stored paths end at each node."""
    return degrees(paths.select(F.col("end_nid").alias("sink")))


def joining_degrees(frontier: DataFrame, known: DataFrame) -> DataFrame:
    """Frontier rows with the degree of the node where they end: 0 none, 1 one, 2 several."""
    d = known.select(F.col("nid").alias("d_nid"), "degree")
    return frontier.join(d, F.col("end_nid") == F.col("d_nid"), "left").withColumn("degree", F.coalesce("degree", F.lit(0))).drop("d_nid")


def mark_local(local: DataFrame, nodes: DataFrame) -> DataFrame:
    return local.select("nid").union(nodes.select("nid")).distinct()


def are_local(nodes: DataFrame, local: DataFrame) -> DataFrame:
    """``nodes`` with a flag for those among ``local``."""
    return nodes.join(local.select("nid", F.lit(True).alias("local")).distinct(), "nid", "left").withColumn("local", F.coalesce("local", F.lit(False)))


def close_filter(nodes: DataFrame, edges: DataFrame, paths: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of a graph and its paths when only ``files`` are shown: nodes of these files and those of none, edges with
    both ends, paths all of whose steps are shown edges."""
    n = nodes.join(files.select("file"), "file", "left_semi").unionByName(nodes.where("file is null"))
    ids = n.select(F.col("nid"))
    e = edges.join(ids, edges.source == ids.nid, "left_semi").join(ids, edges.sink == ids.nid, "left_semi")
    steps = paths.withColumn("_key", F.xxhash64("start_nid", "end_nid", "edges")).select("_key", F.posexplode(F.expr("zip_with(edges.source, slice(array_append(edges.source, end_nid), 2, size(edges)), (a, b) -> struct(a, b))")).alias("i", "s"))
    lost = steps.join(e, (F.col("s.a") == e.source) & (F.col("s.b") == e.sink), "left_anti").select("_key").distinct()
    return n, e, paths.withColumn("_key", F.xxhash64("start_nid", "end_nid", "edges")).join(lost, "_key", "left_anti").drop("_key")


def reach(edges: DataFrame, seeds: DataFrame, scratch: Scratch, max_rounds: int = 1000) -> DataFrame:
    """(seed, nid): all nodes that each seed reaches, itself included."""
    seen = new = scratch.table(seeds.select(F.col("nid").alias("seed"), "nid"), "reach-0")
    for k in range(1, max_rounds):
        step = new.join(edges, new.nid == edges.source).select("seed", F.col("sink").alias("nid")).distinct().join(seen, ["seed", "nid"], "left_anti")
        new = scratch.table(step, f"reach-{k}")
        if new.isEmpty():
            return seen
        seen = seen.union(new)
    raise RuntimeError("reachability did not settle")


def local_nodes(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of partial paths that neither are reached from the root or jump node nor reach them."""
    steps = paths.select(F.col("start_nid").alias("source"), F.col("end_nid").alias("sink"))
    hubs = paths.sparkSession.createDataFrame([(ROOT,), (JUMP,)], "nid string")
    back = steps.select(F.col("sink").alias("source"), F.col("source").alias("sink"))
    far = reach(steps, hubs, scratch).select("nid").union(reach(back, hubs, Scratch(paths.sparkSession, "back")).select("nid"))
    every = steps.select(F.col("source").alias("nid")).union(steps.select("sink")).distinct()
    return every.join(far, "nid", "left_anti")


def shadows(mine: str, other: str) -> Column:
    """Whether the path with edge list ``mine`` shadows that with ``other``: walking both while the sources agree, it takes an
    edge of higher precedence somewhere."""
    pairs = f"zip_with({mine}, {other}, (a, b) -> struct(a.source <=> b.source as same, a.precedence > b.precedence as higher))"
    until = f"coalesce(nullif(array_position(transform({pairs}, x -> x.same), false), 0) - 1, least(size({mine}), size({other})))"
    return F.expr(f"exists(slice({pairs}, 1, cast({until} as int)), x -> x.higher)")


def drop_shadowed(paths: DataFrame, key: str = "start_nid") -> DataFrame:
    """Paths that no other path of the same reference shadows.

    A path is shadowed if at some edge another one, whose sources agree so far, has a higher precedence. So paths meet by
    reference and prefix of sources, and each edge's precedence is compared with the highest there: no pair of paths is made.
    """
    steps = paths.select(F.col(key).alias("s_key"), F.col("edges").alias("s_edges"), F.posexplode("edges").alias("i", "e"))
    steps = steps.select("s_key", "s_edges", F.expr("transform(slice(s_edges, 1, i + 1), x -> x.source)").alias("prefix"), F.col("e.precedence").alias("precedence"))
    best = steps.groupBy("s_key", "prefix").agg(F.max("precedence").alias("best"), F.min("precedence").alias("least")).where("best > least").drop("least")
    lost = steps.join(best, ["s_key", "prefix"]).where("precedence < best").select("s_key", "s_edges").distinct()
    return paths.join(lost, (F.col(key) == F.col("s_key")) & (F.col("edges") == F.col("s_edges")), "left_anti")
