"""Queries about parts of graphs: access, predicates, orders, filters, positions in text, searches' limits and statistics."""

from pyspark.sql import functions as F

from ..functions import paths as pf
from ..functions import positions as pos
from ..operators import assertions, graph, kernel, stacks
from ..operators import predicates as pr
from ..schema import EDGES_DDL, NODES_DDL, PATHS_DDL, ROOT, SCOPES
from ..session import Scratch
from ..sources import builder, exchange
from . import adapters as ad
from .closure import Config, Stats, partial_paths, resolve_edges
from .queries import _GEO, _PATH, _RING, _answers, _local, _paths, query

# ---- access

_SUPPLIED = "SELECT s_suppkey, n_nationkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_PLACES = "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


def _suppliers(spark, sf_dir):
    s = Scratch(spark, "suppliers")
    return tuple(s.table(df, n) for df, n in zip(ad.geo(spark, sf_dir, "supplier"), ("nodes", "edges")))


@query(f"SELECT r_name AS symbol FROM region UNION SELECT '.' FROM region UNION SELECT n_name FROM ({_PLACES})")
def iter_symbols(spark, sf_dir):
    return graph.symbols(_suppliers(spark, sf_dir)[0])


@query("SELECT p_type AS string FROM part UNION SELECT p_name FROM part UNION SELECT p_brand FROM part UNION SELECT 'size' UNION SELECT p_size::VARCHAR FROM part")
def iter_strings(spark, sf_dir):
    debug = F.array(F.struct(F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")))
    nodes = ad.table(spark, sf_dir, "part").select(F.col("p_type").alias("syntax_type"), F.col("p_name").alias("containing_line"), F.col("p_brand").alias("fully_qualified_name"), debug.alias("debug_info"))
    return graph.strings(nodes, nodes.select("debug_info").limit(0))


@query(f"SELECT r_name AS file FROM region UNION SELECT 'supplier/' || n_name FROM ({_SUPPLIED})")
def iter_files(spark, sf_dir):
    return graph.files(_suppliers(spark, sf_dir)[0])


@query("SELECT r_name AS file FROM region WHERE r_name = 'ASIA'")
def get_file(spark, sf_dir):
    return graph.get_file(_suppliers(spark, sf_dir)[0], "ASIA")


@query(f"SELECT 'ASIA(0)' AS nid UNION ALL SELECT 'ASIA(1)' UNION ALL SELECT 'ASIA(' || n_nationkey + 10 || ')' FROM ({_PLACES}) WHERE r_name = 'ASIA'")
def nodes_for_file(spark, sf_dir):
    return graph.nodes_for_file(_suppliers(spark, sf_dir)[0], "ASIA").select("nid")


@query("SELECT r_name || '(0)' AS nid, r_name AS symbol FROM region")
def node_for_id(spark, sf_dir):
    ids = ad.table(spark, sf_dir, "region").select(F.col("r_name").alias("file"), F.lit(0).alias("local_id"))
    return graph.node_for_id(_suppliers(spark, sf_dir)[0], ids).select("nid", "symbol")


@query(f"SELECT n_name AS file, n_name IN (SELECT n_name FROM ({_SUPPLIED}) WHERE s_suppkey % 5 = 0) AS existed FROM nation")
def get_or_create_file(spark, sf_dir):
    n = ad.table(spark, sf_dir, "nation")
    there = ad.table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return graph.get_or_create(there.select(F.col("n_name").alias("file")), n.select(F.col("n_name").alias("file")))


@query("SELECT l_orderkey AS source, l_suppkey AS sink FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def outgoing_edges(spark, sf_dir):
    e = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("sink"))
    return graph.outgoing_edges(e, ad.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("nid")))


@query("SELECT nid, sum(n)::BIGINT AS n, least(sum(n), 2)::INTEGER AS degree FROM (SELECT o_custkey AS nid, 1 AS n FROM orders UNION ALL SELECT c_custkey, 1 FROM customer) GROUP BY nid")
def degree_sum(spark, sf_dir):
    parts = [graph.degrees(ad.table(spark, sf_dir, t).select(F.col(c).alias("sink"))) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"))]
    return graph.add_degrees(*parts)


@query("SELECT c_custkey AS custkey, least(count(o_orderkey), 2)::INTEGER AS degree FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def joining_degree(spark, sf_dir):
    known = graph.path_degrees(ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("end_nid")))
    return graph.joining_degrees(ad.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("end_nid")), known).select(F.col("c_custkey").alias("custkey"), "degree")


@query("SELECT n_nationkey AS nid, n_regionkey IN (1, 2) AS local FROM nation")
def local_marks(spark, sf_dir):
    n = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nid"), "n_regionkey")
    return graph.are_local(n.select("nid"), graph.mark_local(n.where("n_regionkey = 1"), n.where("n_regionkey = 2")))


# ---- predicates

_STATED = """WITH n AS (SELECT n_nationkey AS k, n_nationkey % 5 = 0 AS def, n_nationkey % 5 = 1 AS ref, n_nationkey % 5 = 2 AS exp, n_nationkey % 5 = 3 AS root, n_nationkey % 5 = 4 AS jump FROM nation),
p AS (SELECT o_orderkey AS orderkey, o_custkey % 25 AS s, o_orderkey % 25 AS e, o_orderkey % 3 AS pre, o_custkey % 2 AS post, (o_orderkey % 4 <> 0)::INTEGER AS sco FROM orders) """


def _stated(spark, sf_dir):
    """Paths between nations, whose kind is by number, with stacks of a few symbols."""
    k = F.col("n_nationkey") % 5
    kind = F.when(k == 0, "pop_symbol").when(k == 1, "push_symbol").when(k == 2, "scope").when(k == 3, "root").otherwise("jump_to")
    nodes = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("nid"), kind.alias("kind"), (k == 0).alias("is_definition"), (k == 1).alias("is_reference"), (k == 2).alias("is_exported"), F.col("n_regionkey").cast("string").alias("file"))
    many = lambda n: F.slice(F.array(F.lit("a"), F.lit("b")), 1, n)
    scopes = lambda n: F.struct(many(n).alias("scopes"), F.lit(1).alias("variable"))
    o = ad.table(spark, sf_dir, "orders")
    pre, post, sco = (F.col("o_orderkey") % 3).cast("int"), (F.col("o_custkey") % 2).cast("int"), (F.col("o_orderkey") % 4 != 0).cast("int")
    paths = o.select(
        "o_orderkey", (F.col("o_custkey") % 25).cast("string").alias("start_nid"), (F.col("o_orderkey") % 25).cast("string").alias("end_nid"),
        ad.stack_of(many(pre)).alias("sym_pre"), ad.stack_of(many(post), 1).alias("sym_post"), scopes(sco).alias("sco_pre"), scopes(F.lit(0)).alias("sco_post"),
        F.transform(many(pre), lambda x: F.struct(x.alias("source"), F.lit(0).alias("precedence"))).alias("edges"),
    )
    return nodes, paths


@query(_STATED + """SELECT orderkey, a.ref AND pre = 0 AND sco = 0 AS from_reference, b.def AND post = 0 AS to_definition, a.ref AND pre = 0 AND sco = 0 AND b.def AND post = 0 AS complete,
a.def OR a.ref OR a.exp OR a.root AS from_endpoint, b.def OR b.ref OR b.exp OR b.root AS to_endpoint, b.jump AS to_jump, (a.def OR a.ref OR a.exp OR a.root) AND (b.def OR b.ref OR b.exp OR b.root OR b.jump) AS enough
FROM p JOIN n a ON a.k = s JOIN n b ON b.k = e""")
def path_predicates(spark, sf_dir):
    nodes, paths = _stated(spark, sf_dir)
    named = {"from_reference": pr.starts_at_reference(), "to_definition": pr.ends_at_definition(), "complete": pr.is_complete(), "from_endpoint": pr.starts_at_endpoint(), "to_endpoint": pr.ends_at_endpoint(), "to_jump": pr.ends_in_jump(), "enough": pr.as_complete_as_necessary()}
    return pr.with_ends(paths, nodes).select(F.col("o_orderkey").alias("orderkey"), *[c.alias(n) for n, c in named.items()])


@query(_STATED + "SELECT orderkey FROM p JOIN n a ON a.k = s JOIN n b ON b.k = e WHERE a.ref AND pre = 0 AND sco = 0 AND b.def AND post = 0")
def is_complete_filter(spark, sf_dir):
    nodes, paths = _stated(spark, sf_dir)
    return pr.with_ends(paths, nodes).where(pr.is_complete()).select(F.col("o_orderkey").alias("orderkey"))


@query(_STATED + "SELECT orderkey, pre AS n_pre, post AS n_post, sco AS n_scopes, pre = 0 AS pre_empty, pre = 0 AS pre_only_empty, post = 0 AS post_empty, false AS post_only_empty, sco = 0 AS scopes_empty, pre > 0 AS holds, true AS open FROM p")
def stack_predicates(spark, sf_dir):
    _, p = _stated(spark, sf_dir)
    n = {"n_pre": pr.stack_length("sym_pre").cast("bigint"), "n_post": pr.stack_length("sym_post").cast("bigint"), "n_scopes": pr.stack_length("sco_pre"), "pre_empty": pr.can_match_empty("sym_pre"), "pre_only_empty": pr.can_only_match_empty("sym_pre"), "post_empty": pr.can_match_empty("sym_post"), "post_only_empty": pr.can_only_match_empty("sym_post"), "scopes_empty": pr.can_match_empty("sco_pre"), "holds": pr.contains_items("sym_pre"), "open": pr.has_variable("sco_pre")}
    return p.select(F.col("o_orderkey").alias("orderkey"), *[c.alias(k) for k, c in n.items()])


@query("SELECT n_nationkey AS nid, n_nationkey % 5 = 3 AS root, n_nationkey % 5 = 4 AS jump, n_regionkey = 2 AS inside FROM nation")
def node_predicates(spark, sf_dir):
    nodes, _ = _stated(spark, sf_dir)
    return nodes.select(F.col("nid").cast("bigint").alias("nid"), pr.is_root().alias("root"), pr.is_jump_to().alias("jump"), pr.is_in_file(F.lit("2")).alias("inside"))


@query(_STATED + "SELECT s::VARCHAR AS start_nid, count(*) AS n FROM (SELECT DISTINCT s, e, pre, post, sco FROM p) GROUP BY s")
def similar_states(spark, sf_dir):
    """Paths that are equal in all but their edges count once."""
    _, p = _stated(spark, sf_dir)
    return p.select(*pr.STATE).distinct().groupBy("start_nid").agg(F.count("*").alias("n"))


@query(_STATED + "SELECT s::VARCHAR AS start_nid, arg_min(orderkey, rpad(e::VARCHAR, 3, ' ') || pre || post || sco || lpad(orderkey::VARCHAR, 12, '0')) AS orderkey FROM p GROUP BY s")
def path_order_first(spark, sf_dir):
    """The first path of each start in the order of paths (the order number breaks ties)."""
    _, p = _stated(spark, sf_dir)
    return p.groupBy("start_nid").agg(F.min_by("o_orderkey", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(pr.path_order())], "o_orderkey")).alias("orderkey"))


# ---- path algebra


def _structs(paths, name):
    columns = ["file", "start_nid", "end_nid", "sym_pre", "sco_pre", "sym_post", "sco_post", "edges"]
    return F.struct(*[F.col(c) for c in columns]).alias(name)


@query(f"SELECT s_suppkey AS supplier, r_name || '(0)' AS end_nid, '.' || n_name AS left_over, 4::BIGINT AS edges FROM ({_SUPPLIED})")
def path_concatenate(spark, sf_dir):
    """Every supplier's way to the root followed by every way from the root on: only that to its own region joins."""
    s = Scratch(spark, "concatenate")
    paths = s.table(partial_paths(*_suppliers(spark, sf_dir)), "paths")
    left, right = paths.where(F.col("end_nid") == ROOT).select(_structs(paths, "left")), paths.where(F.col("start_nid") == ROOT).select(_structs(paths, "right"))
    made = kernel.concatenated(left.join(right, F.col("left.end_nid") == F.col("right.start_nid")).withColumn("kind", F.lit("root")))
    rest = F.array_join(F.transform("sym_post.symbols", lambda x: x["symbol"]), "")
    return made.select((_local("start_nid") / 3).cast("bigint").alias("supplier"), "end_nid", rest.alias("left_over"), F.size("edges").cast("bigint").alias("edges"))


@query("SELECT n_nationkey AS nation, CASE n_nationkey % 4 WHEN 0 THEN 'strengthens_precondition' WHEN 1 THEN 'strengthens_postcondition' WHEN 2 THEN NULL ELSE 'strengthens_postcondition' END AS cyclicity FROM nation")
def path_cycles(spark, sf_dir):
    """Paths from a node to itself that take a symbol, leave one, take another than they leave, and take and leave the same."""
    k, none = F.col("n_nationkey") % 4, F.array().cast("array<string>")
    pre = F.when(k == 0, F.array(F.lit("a"))).when(k == 1, none).otherwise(F.array(F.lit("a")))
    post = F.when(k == 0, none).when(k == 2, F.array(F.lit("b"))).otherwise(F.array(F.lit("a")))
    scopes = F.expr("named_struct('scopes', cast(array() as array<string>), 'variable', 1)")
    rows = ad.table(spark, sf_dir, "nation").select(
        "n_nationkey", F.lit("f").alias("file"), F.lit("n").alias("start_nid"), F.lit("n").alias("end_nid"), ad.stack_of(pre, 1).alias("sym_pre"), scopes.alias("sco_pre"), ad.stack_of(post, 1).alias("sym_post"), scopes.alias("sco_post"),
        F.array(F.struct(F.lit("n").alias("source"), F.lit(0).alias("precedence"))).alias("edges"),
    )
    found = kernel.cycles(rows.select("n_nationkey", _structs(rows, "path"), F.lit("scope").alias("kind")), "n_nationkey")
    return found.withColumnRenamed("n_nationkey", "nation")


@query(_STATED + "SELECT orderkey, repeat('x', 1) || substr('ab', 1, pre) AS front, substr('ab', 1, pre) || 'x' AS back, CASE WHEN pre > 0 THEN 'a' END AS first, substr('ab', 2, greatest(pre - 1, 0)) AS rest, CASE WHEN pre > 0 THEN substr('ab', pre, 1) END AS last, substr('ab', 1, greatest(pre - 1, 0)) AS before, CASE WHEN sco > 0 THEN 'a' END AS scope, pre + 1 AS edges FROM p")
def stack_ends(spark, sf_dir):
    """Stacks and edge lists, pushed to and popped from both ends."""
    _, p = _stated(spark, sf_dir)
    x = F.struct(F.lit("x").alias("symbol"), F.lit(None).cast(SCOPES).alias("scopes"))
    names = lambda c: F.array_join(F.transform(c["symbols"], lambda s: s["symbol"]), "")
    (first, rest), (last, before) = stacks.pop_front("sym_pre"), stacks.pop_back("sym_pre")
    edges = stacks.edges_push("edges", F.struct(F.lit("x").alias("source"), F.lit(0).alias("precedence")), True)
    return p.select(
        F.col("o_orderkey").alias("orderkey"), names(stacks.push_front("sym_pre", x)).alias("front"), names(stacks.push_back("sym_pre", x)).alias("back"), first["symbol"].alias("first"), names(rest).alias("rest"), last["symbol"].alias("last"), names(before).alias("before"),
        stacks.pop_front("sco_pre")[0].alias("scope"), F.size(edges).cast("bigint").alias("edges"),
    )


@query(_STATED + "SELECT orderkey, 0::INTEGER AS symbol_variable, 1::INTEGER AS scope_variable, 2::INTEGER AS fresh, 6::INTEGER AS moved, substr('ab', 1, post) || substr('ab', 1, pre) AS bound FROM p")
def stack_variables(spark, sf_dir):
    """Largest variables, variables moved on, and a variable bound to another stack."""
    _, p = _stated(spark, sf_dir)
    joined = stacks.bound("sym_post", "sym_pre")
    return p.select(
        F.col("o_orderkey").alias("orderkey"), stacks.largest_symbol_variable().alias("symbol_variable"), stacks.largest_scope_variable().alias("scope_variable"), stacks.fresh_scope_variable().alias("fresh"),
        stacks.renamed("sco_pre", F.lit(0), F.lit(5))["variable"].alias("moved"), F.array_join(F.transform(joined["symbols"], lambda s: s["symbol"]), "").alias("bound"),
    )


# ---- filters


@query(f"SELECT '[root]' AS source, 'ASIA(0)' AS sink UNION ALL SELECT 'ASIA(0)', 'ASIA(1)' UNION ALL SELECT 'ASIA(1)', 'ASIA(' || n_nationkey + 10 || ')' FROM ({_PLACES}) WHERE r_name = 'ASIA'")
def file_filter(spark, sf_dir):
    nodes, edges = _suppliers(spark, sf_dir)
    return pr.file_filter("ASIA").apply(nodes, edges, spark.createDataFrame([], PATHS_DDL))[1].select("source", "sink")


@query(f"SELECT count(*) * 3 AS nodes FROM ({_SUPPLIED})")
def no_filter(spark, sf_dir):
    nodes, edges = _suppliers(spark, sf_dir)
    return pr.no_filter().apply(nodes, edges, spark.createDataFrame([], PATHS_DDL))[0].where("file like 'supplier/%'").agg(F.count("*").alias("nodes"))


@query(f"SELECT r_name || '(' || n_nationkey + 10 || ')' AS end_nid, count(*) AS n FROM ({_SUPPLIED}) GROUP BY 1")
def visualization_filter(spark, sf_dir):
    """Of all answers, those worth a line in a picture."""
    nodes, edges, found = _found(spark, sf_dir)
    return pr.with_ends(found, nodes).where(pr.visualization_filter().paths).groupBy("end_nid").agg(F.count("*").alias("n"))


# ---- searches: limits, statistics, cycles


def _found(spark, sf_dir, **config):
    nodes, edges = _suppliers(spark, sf_dir)
    return nodes, edges, resolve_edges(nodes, edges, config=Config(**config))


def _nations(found, nodes):
    return _answers(found, nodes).select((_local("start_nid") / 3).cast("bigint").alias("person"), F.col("symbol").alias("nation"), F.col("end_file").alias("region"))


@query(_GEO.format(k="s", c="supp", t="supplier"))
def search_bounded_work(spark, sf_dir):
    nodes, _, found = _found(spark, sf_dir, max_work=40)
    return _nations(found, nodes)


@query(_GEO.format(k="s", c="supp", t="supplier"))
def search_at_join_nodes(spark, sf_dir):
    nodes, _, found = _found(spark, sf_dir, only_at_joins=True)
    return _nations(found, nodes)


@query(f"SELECT k::INTEGER AS phase, n AS frontier, CASE WHEN k < 7 THEN n ELSE 0 END AS candidates, CASE WHEN k < 7 THEN n ELSE 0 END AS accepted, 0::BIGINT AS similar FROM (SELECT count(*) AS n FROM ({_SUPPLIED})), range(1, 8) AS r(k)")
def search_stats(spark, sf_dir):
    stats = Stats()
    _found(spark, sf_dir, stats=stats)
    return stats.table(spark)


@query(_RING + "SELECT seed AS nation FROM r WHERE nid = 0")
def cycle_cutoff(spark, sf_dir):
    """References into a ring of scopes, one of which leads to a definition: the search ends, and finds it from wherever it is
    reached."""
    n, k = ad.table(spark, sf_dir, "nation"), F.col("n_nationkey")
    ring, x = F.lit("ring"), F.lit("x")
    nodes = ad.union(ad.nodes_of(n, ring, k, "scope"), ad.nodes_of(n, ring, k + 100, "push_symbol", x, True), ad.nodes_of(n.where("n_nationkey = 0"), ring, F.lit(200), "pop_symbol", x, True))
    to = (k * 3 + 1) % 25
    edges = ad.union(ad.edges_of(n, ad.node_id(ring, k), ad.node_id(ring, to)), ad.edges_of(n, ad.node_id(ring, k + 100), ad.node_id(ring, k)), ad.edges_of(n.where("n_nationkey = 0"), ad.node_id(ring, k), F.lit("ring(200)")))
    found = resolve_edges(ad.with_singletons(spark, nodes), edges)
    return found.select((_local("start_nid") - 100).cast("bigint").alias("nation"))


@query("SELECT n_nationkey AS nation, 1::BIGINT AS kept, 5::BIGINT AS every FROM nation")
def similar_dedup(spark, sf_dir):
    """Five ways from a reference to its definition that differ in their edges only: one answer, or all five if asked for."""
    n, r, k = ad.table(spark, sf_dir, "nation"), ad.table(spark, sf_dir, "region"), F.col("n_nationkey")
    file = F.concat(F.lit("n"), k)
    ways = n.crossJoin(F.broadcast(r.select("r_regionkey")))  # regions are five
    nodes = ad.union(ad.nodes_of(n, file, F.lit(0), "push_symbol", F.col("n_name"), True), ad.nodes_of(ways, file, F.col("r_regionkey") + 1, "scope"), ad.nodes_of(n, file, F.lit(9), "scope"), ad.nodes_of(n, file, F.lit(10), "pop_symbol", F.col("n_name"), True))
    at = lambda x: ad.node_id(file, x)
    edges = ad.union(ad.edges_of(ways, at(F.lit(0)), at(F.col("r_regionkey") + 1)), ad.edges_of(ways, at(F.col("r_regionkey") + 1), at(F.lit(9))), ad.edges_of(n, at(F.lit(9)), at(F.lit(10))))
    nodes, out = ad.with_singletons(spark, nodes), []
    for name, similar in (("kept", True), ("every", False)):
        found = resolve_edges(nodes, edges, config=Config(detect_similar=similar))
        out.append(found.groupBy(F.substring(F.substring_index("start_nid", "(", 1), 2, 9).cast("bigint").alias("nation")).agg(F.count("*").alias(name)))
    return out[0].join(out[1], "nation")


# ---- positions in text


@query("SELECT conv_id, turn, i::INTEGER AS i, strlen(p)::INTEGER AS utf8, (length(p) + length(regexp_replace(p, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::INTEGER AS utf16, length_grapheme(p)::INTEGER AS grapheme FROM (SELECT conv_id, turn, i, substr(text, 1, i) AS p FROM conversations, unnest(range(0, length(text) + 1)) AS u(i))")
def char_offsets(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    return pos.all_chars(c, "k", "text").select("k.conv_id", "k.turn", "i", "utf8", "utf16", "grapheme")


_SECOND = "SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text LIKE '%' || chr(10) || '%'"


@query(f"SELECT doc_id, l[2] AS content, strlen(l[1])::BIGINT + 1 AS first, strlen(l[1])::BIGINT + 1 + strlen(l[2]) AS last, length_grapheme(l[2])::BIGINT AS graphemes FROM ({_SECOND})")
def line_at_offset(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").where(F.contains("text", F.lit("\n")))
    start = F.octet_length(F.substring_index("text", "\n", 1)) + 1
    x = d.select("doc_id", pos.from_line(F.col("text"), start).alias("x"))
    return x.select("doc_id", "x.content", F.col("x.utf8_bounds.start").cast("bigint").alias("first"), F.col("x.utf8_bounds.end").cast("bigint").alias("last"), F.col("x.grapheme_length").cast("bigint").alias("graphemes"))


@query(f"SELECT doc_id, l[1] AS content, strlen(l[1])::BIGINT AS last FROM ({_SECOND})")
def byte_range(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").where(F.contains("text", F.lit("\n")))
    end = F.octet_length(F.substring_index("text", "\n", 1))
    return d.select("doc_id", pos.from_range(F.col("text"), F.lit(0), end).alias("x")).select("doc_id", "x.content", F.col("x.utf8_bounds.end").cast("bigint").alias("last"))


@query("SELECT conv_id, turn, strlen(left_grapheme(t, 7))::BIGINT AS utf8, least(7, length_grapheme(t))::BIGINT AS grapheme, length_grapheme(t)::BIGINT AS whole FROM (SELECT conv_id, turn, string_split(text, chr(10))[1] AS t FROM conversations)")
def grapheme_position(spark, sf_dir):
    t = F.substring_index("text", "\n", 1)
    p = ad.table(spark, sf_dir, "conversations").select("conv_id", "turn", pos.at_grapheme(F.lit(0), t, F.lit(7)).alias("p"), pos.at_column(F.lit(0), t, F.octet_length(t)).alias("e"))
    return p.select("conv_id", "turn", F.col("p.utf8").cast("bigint").alias("utf8"), F.col("p.grapheme").cast("bigint").alias("grapheme"), F.col("e.grapheme").cast("bigint").alias("whole"))


@query("SELECT doc_id, 3 + strlen(text) - strlen(ltrim(text, ' ' || chr(9) || chr(10) || chr(12) || chr(13))) AS first, 3 + strlen(text) - strlen(ltrim(text, ' ' || chr(9) || chr(10) || chr(12) || chr(13))) + strlen(trim(text, ' ' || chr(9) || chr(10) || chr(12) || chr(13))) AS last FROM documents")
def trimmed_bounds(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").select("doc_id", pos.trimmed(F.lit(3), F.col("text")).alias("b"))
    return d.select("doc_id", F.col("b.start").cast("bigint").alias("first"), F.col("b.end").cast("bigint").alias("last"))


def _order_spans(spark, sf_dir):
    point = lambda line, at: F.struct(line.cast("int").alias("line"), at.cast("int").alias("utf8"), at.cast("int").alias("utf16"), at.cast("int").alias("grapheme"))
    k = F.col("o_orderkey")
    span = F.struct(point(k % 7, k % 5).alias("start"), point(k % 7 + k % 2, k % 5 + 3).alias("end"))
    return ad.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", span.alias("span"))


@query("SELECT o_custkey AS custkey, arg_min(o_orderkey, lpad((o_orderkey % 7)::VARCHAR, 2, ' ') || o_orderkey % 5 || lpad((o_orderkey % 7 + o_orderkey % 2)::VARCHAR, 2, ' ') || lpad(o_orderkey::VARCHAR, 12, '0')) AS orderkey FROM orders GROUP BY 1")
def span_order(spark, sf_dir):
    s = _order_spans(spark, sf_dir)
    return s.groupBy(F.col("o_custkey").alias("custkey")).agg(F.min_by("o_orderkey", F.struct(pos.span_order(F.col("span")).alias("k"), "o_orderkey")).alias("orderkey"))


@query("SELECT o_orderkey AS orderkey, (o_orderkey % 5)::INTEGER AS first, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 5 + 3)::INTEGER END AS last FROM orders")
def first_line_columns(spark, sf_dir):
    c = _order_spans(spark, sf_dir).select(F.col("o_orderkey").alias("orderkey"), pos.first_line_columns(F.col("span")).alias("c"))
    return c.select("orderkey", F.col("c.start").alias("first"), F.col("c.end").alias("last"))


# ---- paths of files

_NAMED = f"WITH x AS (SELECT page_id, {_PATH} AS p FROM pages), z AS (SELECT page_id, p, list_filter(string_split(p, '/'), lambda c: c <> '' AND c <> '.') AS c FROM x) "


@query(_NAMED + "SELECT page_id, 'out/' || CASE WHEN len(c) > 2 THEN array_to_string(c[2:-2], '/') ELSE '.' END || '/' || CASE WHEN regexp_matches(c[-1], '^.+\\.[^.]*$') THEN regexp_extract(c[-1], '^(.+)\\.[^.]*$', 1) || '%' || '.' || regexp_extract(c[-1], '\\.([^.]*)$', 1) ELSE c[-1] || '%' END AS v FROM z WHERE len(c) > 1")
def format_path(spark, sf_dir):
    rows = _paths(spark, sf_dir).where(F.size(pf.path_split(F.col("p"))) > 1)
    return rows.select("page_id", pf.format_path("out/%d/%n%%%e", F.get(pf.path_split(F.col("p")), F.lit(0)), F.col("p")).alias("v"))


@query(_NAMED + "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN array_to_string(['..'] || c, '/') ELSE array_to_string(c[:-2], '/') END AS v, page_id % 3 = 1 AS escapes FROM z")
def relative_path(spark, sf_dir):
    p, k = F.col("p"), F.col("page_id") % 3
    given = F.when(k == 0, F.concat(F.lit("/"), p)).when(k == 1, F.concat(F.lit("./../"), p)).otherwise(F.concat(p, F.lit("/..")))
    v = pf.relative_normalize(given)
    return _paths(spark, sf_dir).select("page_id", v.alias("v"), F.coalesce(pf.escapes(v), F.lit(False)).alias("escapes"))


# ---- builder, exchange, assertions


@query("SELECT conv_id, turn, strlen(left_grapheme(t, 3))::BIGINT AS utf8, least(3, length_grapheme(t))::BIGINT AS grapheme, t AS line, turn % 2 = 0 AS empty FROM (SELECT conv_id, turn, string_split(text, chr(10))[1] AS t FROM conversations WHERE length(text) > 0) WHERE length_grapheme(t) >= 3")
def source_info(spark, sf_dir):
    """Spans of the first three characters of each turn's first line; every other one ends where it starts."""
    t = F.substring_index("text", "\n", 1)
    c = ad.table(spark, sf_dir, "conversations").where(F.length("text") > 0).where(pos.grapheme_len(t) >= 3)
    c = c.withColumns({"file": F.concat_ws("-", "conv_id", "turn"), "local_id": F.lit(0), "p": pos.at_grapheme(F.lit(0), t, F.lit(3))})
    place = F.concat(F.lit("0:0-0:"), F.col("p.utf8"))
    rows = c.select("file", "local_id", F.create_map(F.lit("source_node"), place, F.lit("empty_source_span"), (F.col("turn") % 2 == 0).cast("string")).alias("attributes"))
    nodes = builder.source_info(builder.nodes_from_attributes(rows), rows, c.select("file", "text"))
    named = nodes.join(c.select("file", "conv_id", "turn", "p"), "file")
    empty = F.col("span.start") == F.col("span.end")
    return named.select("conv_id", "turn", F.when(empty, F.col("p.utf8")).otherwise(F.col("span.end.utf8")).cast("bigint").alias("utf8"), F.when(empty, F.col("p.grapheme")).otherwise(F.col("span.end.grapheme")).cast("bigint").alias("grapheme"), F.col("containing_line").alias("line"), empty.alias("empty"))


@query("SELECT n_name AS file, '[root]' AS source, n_name || '(' || n_nationkey || ')' AS sink FROM nation UNION ALL SELECT n_name, n_name || '(' || n_nationkey || ')', 'shared' FROM nation")
def inject_nodes(spark, sf_dir):
    n = ad.table(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), F.col("n_nationkey").cast("string").alias("k"))
    rows = n.select("file", F.lit("ROOT_NODE").alias("source"), F.col("k").alias("sink")).union(n.select("file", "k", F.lit("builtin")))
    return builder.inject(rows, n.select("file", F.lit("builtin").alias("name"), F.lit("shared").alias("nid"))).select("file", "source", "sink")


@query(f"SELECT s_suppkey AS person, r_name || '(' || n_nationkey + 10 || ')' AS target, 7::BIGINT AS steps FROM ({_SUPPLIED})")
def path_json_roundtrip(spark, sf_dir):
    """All answers, written as JSON with their graph and read again."""
    nodes, edges, found = _found(spark, sf_dir)
    lines = exchange.database_to_json(nodes, edges, found.select(*[c.split(" ")[0] for c in ("file", "start_nid", "end_nid", "sym_pre", "sco_pre", "sym_post", "sco_post", "edges")]))
    _, _, back = exchange.database_from_json(Scratch(spark, "json").table(lines, "lines"), NODES_DDL, EDGES_DDL)
    return back.select((_local("start_nid") / 3).cast("bigint").alias("person"), F.col("end_nid").alias("target"), (F.size("edges") + 1).cast("bigint").alias("steps"))


@query(f"SELECT 'ASIA(1)' AS source, 'ASIA(' || n_nationkey + 10 || ')' AS sink FROM ({_PLACES}) WHERE r_name = 'ASIA' UNION ALL SELECT 'ASIA(0)', 'ASIA(1)' UNION ALL SELECT '[root]', 'ASIA(0)'")
def graph_json_filtered(spark, sf_dir):
    nodes, edges = _suppliers(spark, sf_dir)
    return exchange.graph_from_json(exchange.graph_to_json(nodes, edges, pr.file_filter("ASIA")), NODES_DDL, EDGES_DDL)[1].select("source", "sink")


_NOTES = "CASE WHEN turn = 0 THEN '--- global: x=' || role || ' ---' WHEN turn % 4 = 1 THEN 'code --- path: ' || role || '.x --- more' WHEN turn % 4 = 2 THEN '---global:y=1---' ELSE 'plain' END"


def _notes(spark, sf_dir):
    k = F.col("turn") % 4
    text = F.when(F.col("turn") == 0, F.concat(F.lit("--- global: x="), "role", F.lit(" ---"))).when(k == 1, F.concat(F.lit("code --- path: "), "role", F.lit(".x --- more"))).when(k == 2, F.lit("---global:y=1---")).otherwise(F.lit("plain"))
    c = ad.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line"), text.alias("line_text"))
    return assertions.fragments(c, "conv_id")


_PARTS = f"WITH l AS (SELECT conv_id, turn AS line, role, {_NOTES} AS t FROM conversations), f AS (SELECT *, last_value(CASE WHEN t LIKE 'code%' THEN role || '.x' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line) AS fragment, t LIKE 'code%' AS head, t LIKE '%global%' AS given FROM l) "


@query(_PARTS + "SELECT conv_id, line, fragment, CASE WHEN line = 0 THEN 'x' ELSE 'y' END AS name, CASE WHEN line = 0 THEN role ELSE '1' END AS value FROM f WHERE given")
def fragment_globals(spark, sf_dir):
    return assertions.globals_of(_notes(spark, sf_dir), "conv_id")


@query(_PARTS + """SELECT conv_id, line, 'duplicate path ' || fragment AS error FROM f WHERE head QUALIFY row_number() OVER (PARTITION BY conv_id, fragment ORDER BY line) > 1
UNION ALL SELECT conv_id, line, 'duplicate global y' FROM f WHERE given AND line > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, fragment ORDER BY line) > 1
UNION ALL SELECT conv_id, line, 'global before first fragment' FROM f WHERE given AND fragment IS NULL AND conv_id IN (SELECT conv_id FROM f WHERE head)""")
def fragment_errors(spark, sf_dir):
    return assertions.fragment_errors(_notes(spark, sf_dir), "conv_id")


@query("""WITH l AS (SELECT conv_id, turn AS line, CASE WHEN turn % 3 = 0 THEN '0123456789' END AS plain, turn FROM conversations), a AS (SELECT *, last_value(CASE WHEN plain IS NOT NULL THEN line END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line) AS above FROM l)
SELECT conv_id, line, above AS target_line, CASE WHEN turn % 3 = 1 THEN 4 ELSE 12 END AS column, CASE WHEN turn % 3 = 1 THEN 'refers' ELSE 'denies' END AS kind, CASE WHEN above IS NULL THEN 'no source line above' WHEN turn % 3 = 2 THEN 'column beyond the line above' END AS error FROM a WHERE turn % 3 > 0""")
def assertion_errors(spark, sf_dir):
    k = F.col("turn") % 3
    text = F.when(k == 0, F.lit("0123456789")).when(k == 1, F.lit("x() ^ refers: a, b # c")).otherwise(F.lit("            ^denies: a"))
    c = ad.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line"), text.alias("line_text"))
    return assertions.assertions(c, "conv_id").select("conv_id", "line", "target_line", "column", "kind", "error")


