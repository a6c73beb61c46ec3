"""Queries over the synthetic tables, one per operator, and equivalent SQL for DuckDB."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as pf
from ..functions import positions as pos
from ..operators import assertions, graph, lookup, stats
from ..schema import EDGES_DDL, NODES_DDL, ROOT
from ..session import Scratch
from ..sources import exchange, index
from ..streaming import upsert
from . import adapters as ad
from .closure import partial_paths, resolve_edges, resolve_paths

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _answers(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where references lead: start and end with the end's symbol."""
    names = nodes.where("is_definition").select(F.col("nid").alias("end_nid"), "symbol", F.col("file").alias("end_file"))
    return found.join(names, "end_nid")


def _local(c: str):
    return F.regexp_extract(c, r"\((\d+)\)$", 1).cast("bigint")


# ---- searches

_GEO = "SELECT {k}_{c}key AS person, n_name AS nation, r_name AS region FROM {t} JOIN nation ON {k}_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _geo(spark, sf_dir, who, stitched):
    nodes, edges = ad.geo(spark, sf_dir, who)
    s = Scratch(spark, "geo")
    nodes, edges = s.table(nodes, "nodes"), s.table(edges, "edges")
    found = resolve_paths(nodes, partial_paths(nodes, edges)) if stitched else resolve_edges(nodes, edges)
    return _answers(found, nodes).select((_local("start_nid") / 3).cast("bigint").alias("person"), F.col("symbol").alias("nation"), F.col("end_file").alias("region"))


@query(_GEO.format(k="c", c="cust", t="customer"))
def geo_resolve(spark, sf_dir):
    return _geo(spark, sf_dir, "customer", True)


@query(_GEO.format(k="s", c="supp", t="supplier"))
def geo_resolve_supplier(spark, sf_dir):
    return _geo(spark, sf_dir, "supplier", True)


@query(_GEO.format(k="c", c="cust", t="customer"))
def geo_raw_edges(spark, sf_dir):
    return _geo(spark, sf_dir, "customer", False)


@query("""SELECT '<' || r_name || ',%1>' AS pre, r_name || '(0)' AS target, '<%1>' AS post, 1::BIGINT AS n FROM region
UNION ALL SELECT '<' || r_name || '.' || n_name || ',%1>', r_name || '(' || (n_nationkey + 10) || ')', '<%1>', 1 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT '<%1>', '[root]', '<' || r_name || '.' || n_name || ',%1>', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def geo_partial_paths(spark, sf_dir):
    """Summaries of the region and supplier files."""
    nodes, edges = ad.geo(spark, sf_dir, "supplier")
    s = Scratch(spark, "geo")
    from ..operators.stacks import symbols_text

    paths = partial_paths(s.table(nodes, "nodes"), s.table(edges, "edges"))
    # a path within a region's file starts at the region's definition; its symbol is part of what the file asks for
    return paths.select(symbols_text("sym_pre").alias("pre"), F.col("end_nid").alias("target"), symbols_text("sym_post").alias("post")).groupBy("pre", "target", "post").agg(F.count("*").alias("n"))


def _history(spark, sf_dir):
    nodes, edges = ad.history(spark, sf_dir)
    s = Scratch(spark, "history")
    nodes, edges = s.table(nodes, "nodes"), s.table(edges, "edges")
    return s.table(resolve_edges(nodes, edges), "found"), nodes


def _orders(found, nodes):
    return _answers(found, nodes).select(F.substring("end_file", 2, 20).cast("bigint").alias("custkey"), F.col("symbol").alias("priority"), (_local("end_nid") - 10).alias("rank"))


_RANKED = "WITH r AS (SELECT o_custkey AS custkey, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders) "


@query(_RANKED + "SELECT custkey, priority, max(rank) AS rank FROM r GROUP BY custkey, priority")
def shadow_latest(spark, sf_dir):
    found, nodes = _history(spark, sf_dir)
    return _orders(graph.drop_shadowed(found), nodes)


@query(_RANKED + "SELECT custkey, priority, rank FROM r")
def shadow_all(spark, sf_dir):
    return _orders(*_history(spark, sf_dir))


@query("SELECT p_partkey AS part, 'part' || p_partkey AS target FROM part UNION ALL SELECT p_partkey, p_brand FROM part")
def alias_chain(spark, sf_dir):
    nodes, edges = ad.alias(spark, sf_dir)
    s = Scratch(spark, "alias")
    nodes, edges = s.joined(nodes, "nodes"), s.joined(edges, "edges")
    found = resolve_edges(nodes, edges)
    return _answers(found.where("start_nid <> end_nid"), nodes).withColumn("k", _local("start_nid")).where("k % 3 = 0").select((F.col("k") / 3).cast("bigint").alias("part"), F.col("symbol").alias("target"))


_RING = "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), r AS (SELECT n_nationkey AS seed, n_nationkey AS nid FROM nation UNION SELECT seed, b FROM r JOIN e ON nid = a) "


@query(_RING + "SELECT seed::VARCHAR AS seed, nid::VARCHAR AS nid FROM r")
def ring_reach(spark, sf_dir):
    e = ad.ring(spark, sf_dir)
    return graph.reach(e, e.select(F.col("source").alias("nid")), Scratch(spark, "ring"))


@query(_RING + "SELECT n_nationkey::VARCHAR AS nid FROM nation WHERE n_nationkey NOT IN (SELECT nid FROM r WHERE seed = 0) AND n_nationkey NOT IN (SELECT seed FROM r WHERE nid = 0)")
def ring_local(spark, sf_dir):
    """Nations that neither are reached from nation 0, which stands for the root, nor reach it."""
    e = ad.ring(spark, sf_dir)
    to = lambda c: F.when(F.col(c) == "0", ROOT).otherwise(F.col(c))
    return graph.local_nodes(e.select(to("source").alias("start_nid"), to("sink").alias("end_nid")), Scratch(spark, "ring")).select("nid")


# ---- lookups

_WEB = "WITH u AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') AS s FROM pages), d AS (SELECT DISTINCT list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '')[1:2] AS s FROM pages) "


def _web(spark, sf_dir):
    pages = ad.table(spark, sf_dir, "pages")
    parts = F.array_remove(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/"), "")
    q = pages.select("page_id", parts.alias("s"))
    return q, q.select(F.slice("s", 1, 2).alias("s")).distinct()


def _root_pairs(spark, sf_dir, q_var, p_var):
    q, d = _web(spark, sf_dir)
    stored = d.select(F.lit(ROOT).alias("start_nid"), ad.stack_of(F.col("s"), p_var).alias("sym_pre"))
    found = lookup.root_candidates(q.select("page_id", ad.stack_of(F.col("s"), q_var).alias("sym_post")), stored)
    return found.select("page_id", F.array_join(F.expr("transform(r_sym_pre.symbols, x -> x.symbol)"), "/").alias("stored"))


@query(_WEB + "SELECT page_id, array_to_string(d.s, '/') AS stored FROM u, d WHERE u.s[1:len(d.s)] = d.s")
def root_prefix_lookup(spark, sf_dir):
    return _root_pairs(spark, sf_dir, None, 1)


@query(_WEB + "SELECT page_id, array_to_string(d.s, '/') AS stored FROM u, d WHERE u.s[1:2] = d.s")
def root_exact_lookup(spark, sf_dir):
    """Queries of a host and a folder find what is stored under just these."""
    q, d = _web(spark, sf_dir)
    stored = d.select(F.lit(ROOT).alias("start_nid"), ad.stack_of(F.col("s")).alias("sym_pre"))
    found = lookup.root_candidates(q.select("page_id", ad.stack_of(F.slice("s", 1, 2)).alias("sym_post")), stored)
    return found.select("page_id", F.array_join(F.expr("transform(r_sym_pre.symbols, x -> x.symbol)"), "/").alias("stored"))


@query(_WEB + "SELECT page_id, array_to_string(d.s, '/') AS stored FROM u, d WHERE d.s = u.s[1:1] OR d.s[1:1] = u.s[1:1]")
def root_extension_lookup(spark, sf_dir):
    """Queries of one host with a variable find all that is stored under it."""
    q, d = _web(spark, sf_dir)
    stored = d.select(F.lit(ROOT).alias("start_nid"), ad.stack_of(F.col("s")).alias("sym_pre"))
    found = lookup.root_candidates(q.select("page_id", ad.stack_of(F.slice("s", 1, 1), 2).alias("sym_post")), stored)
    return found.select("page_id", F.array_join(F.expr("transform(r_sym_pre.symbols, x -> x.symbol)"), "/").alias("stored"))


@query("SELECT o_orderkey AS orderkey, l_linenumber::BIGINT AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def node_lookup(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_orderkey").cast("string").alias("end_nid"))
    li = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("start_nid"), "l_linenumber")
    return lookup.node_candidates(o, li).select(F.col("o_orderkey").alias("orderkey"), F.col("r_l_linenumber").cast("bigint").alias("line"))


@query("SELECT page_id, 'X␞' || array_to_string(s, '␟') AS key FROM (" + _WEB + "SELECT * FROM u)")
def storage_keys(spark, sf_dir):
    q, _ = _web(spark, sf_dir)
    return q.select("page_id", ad.stack_of(F.col("s")).alias("st")).select("page_id", lookup.storage_key("st").alias("key"))


# ---- edges, degrees, filters

_E = "WITH e AS (SELECT l_orderkey AS source, l_suppkey AS sink, l_linenumber AS precedence, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS ord FROM lineitem) "


def _edges(spark, sf_dir):
    li = ad.table(spark, sf_dir, "lineitem")
    o = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("sink"), F.col("l_linenumber").alias("precedence"), o.alias("ord"))


@query(_E + "SELECT source, sink, arg_min(precedence, ord) AS precedence FROM e GROUP BY source, sink")
def edge_first_wins(spark, sf_dir):
    return graph.first_wins(_edges(spark, sf_dir)).drop("ord")


@query("SELECT l_orderkey AS source, l_suppkey AS sink, CASE WHEN s_suppkey IS NULL THEN l_linenumber ELSE 99 END AS precedence FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal < 0")
def edge_set_precedence(spark, sf_dir):
    e = _edges(spark, sf_dir).drop("ord")
    poor = ad.table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("sink"))
    return graph.set_precedence(e, e.join(poor, "sink").select("source", "sink", F.lit(99).alias("precedence")).distinct())


@query("SELECT l_suppkey AS nid, count(*) AS n FROM lineitem GROUP BY 1")
def degree_in(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir)).select("nid", "n")


@query("SELECT o_custkey AS nid, least(count(*), 2)::INTEGER AS degree FROM orders GROUP BY 1")
def degree_saturated(spark, sf_dir):
    return graph.degrees(ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sink"))).select("nid", "degree")


@query("SELECT p_partkey AS nid FROM part WHERE p_size % 4 <> 3 OR p_size = 7")
def endpoint_filter(spark, sf_dir):
    s = F.col("p_size") % 4
    p = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("nid"), (s == 0).alias("is_definition"), (s == 1).alias("is_reference"), (s == 2).alias("is_exported"), F.when(F.col("p_size") == 7, "root").otherwise("scope").alias("kind"))
    return p.where(graph.is_endpoint()).select("nid")


@query("SELECT o_orderkey AS source, o_custkey AS sink FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_mktsegment = 'BUILDING'")
def implication_filter(spark, sf_dir):
    """Edges order → customer, shown where both nodes' files are."""
    o, c = ad.table(spark, sf_dir, "orders"), ad.table(spark, sf_dir, "customer")
    n = o.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("nid"), F.col("o_orderstatus").alias("file")).union(c.select(F.concat(F.lit("c"), F.col("c_custkey")), "c_mktsegment"))
    e = o.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("source"), F.concat(F.lit("c"), F.col("o_custkey")).alias("sink"), F.lit(0).alias("precedence"))
    p = spark.createDataFrame([], "start_nid string, end_nid string, edges array<struct<source:string,precedence:int>>")
    shown = graph.close_filter(n, e, p, spark.createDataFrame([("O",), ("BUILDING",)], "file string"))[1]
    return shown.select(*[F.substring(x, 2, 20).cast("bigint").alias(x) for x in ("source", "sink")])


@query("SELECT n_regionkey::BIGINT AS file, (max(n_nationkey) + 1)::BIGINT AS next_id FROM nation GROUP BY 1")
def new_node_ids(spark, sf_dir):
    n = ad.table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("bigint").alias("file"), F.col("n_nationkey").cast("bigint").alias("local_id"))
    return graph.new_node_ids(n)


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def insert_new(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"))
    s = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    return graph.add_rows(c, s, "id").select("id", "name")


# ---- statistics


@query("SELECT l_linenumber::BIGINT AS value, count(*) AS n FROM lineitem GROUP BY 1")
def freq_dist(spark, sf_dir):
    return stats.distribution(ad.table(spark, sf_dir, "lineitem"), "l_linenumber").select(F.col("value").cast("bigint").alias("value"), "n")


@query("SELECT n AS value, count(*) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def freq_of_freq(spark, sf_dir):
    return stats.frequencies(stats.distribution(ad.table(spark, sf_dir, "lineitem"), "l_orderkey"))


@query("SELECT value, sum(n)::BIGINT AS n FROM (SELECT o_custkey AS value, 1 AS n FROM orders UNION ALL SELECT c_custkey, 1 FROM customer) GROUP BY 1")
def freq_merge(spark, sf_dir):
    return stats.merge(stats.distribution(ad.table(spark, sf_dir, "orders"), "o_custkey"), stats.distribution(ad.table(spark, sf_dir, "customer"), "c_custkey"))


@query("WITH d AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT v, sum(n) OVER (ORDER BY v) AS cum FROM d), t AS (SELECT max(cum) AS total FROM c) SELECT k::INTEGER AS k, min(v) AS value FROM range(5) AS r(k), t, c WHERE cum >= greatest(1, round(total * k / 4.0)) GROUP BY k")
def quantiles(spark, sf_dir):
    return stats.quantiles(stats.distribution(ad.table(spark, sf_dir, "lineitem"), "l_quantity"), 4)


@query("SELECT o_custkey AS file, count(DISTINCT o_orderkey) AS nodes, count(l_orderkey) AS edges FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def stats_per_file(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), "o_orderkey")
    li = ad.table(spark, sf_dir, "lineitem").select("l_orderkey")
    return stats.per_file(o, o.join(li, F.col("o_orderkey") == F.col("l_orderkey")))


@query("SELECT DISTINCT lower(substr(c_name, 1, 8)) AS symbol FROM customer UNION SELECT lower(substr(s_name, 1, 8)) FROM supplier")
def symbols(spark, sf_dir):
    names = [ad.table(spark, sf_dir, t).select(F.lower(F.substring(f"{t[0]}_name", 1, 8)).alias("symbol")) for t in ("customer", "supplier")]
    return graph.symbols(names[0].union(names[1]))


# ---- positions and paths


@query("SELECT doc_id, (i - 1)::BIGINT AS line, strlen(l[i])::BIGINT AS n FROM (SELECT doc_id, CASE WHEN text LIKE '%\n' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents WHERE length(text) > 0), unnest(range(1, len(l) + 1)) AS u(i)")
def lines_offsets(spark, sf_dir):
    rows = pos.lines(ad.table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.col("line").cast("bigint").alias("line"), (F.col("end") - F.col("start")).cast("bigint").alias("n"))


@query("SELECT doc_id, strlen(text)::INTEGER AS utf8, (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::INTEGER AS utf16, length_grapheme(text)::INTEGER AS grapheme FROM documents")
def utf8_utf16_len(spark, sf_dir):
    t = F.col("text")
    return ad.table(spark, sf_dir, "documents").select("doc_id", pos.utf8_len(t).alias("utf8"), pos.utf16_len(t).alias("utf16"), pos.grapheme_len(t).alias("grapheme"))


_SPAN = "SELECT a.o_orderkey AS pos, b.o_orderkey AS span FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE b.o_orderkey % 100 <= a.o_orderkey % 100 AND a.o_orderkey % 100 {op} b.o_orderkey % 100 + 20"


def _spans(spark, sf_dir, test):
    o = ad.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 100).alias("at"))
    a, b = o.select("o_custkey", F.col("o_orderkey").alias("pos"), F.col("at").alias("p")), o.select("o_custkey", F.col("o_orderkey").alias("span"), F.col("at").alias("s"))
    zero = F.lit(0)
    return a.join(b, "o_custkey").where(test(zero, F.col("s"), zero, F.col("s") + 20, zero, F.col("p"))).select("pos", "span")


@query(_SPAN.format(op="<"))
def span_contains_excl(spark, sf_dir):
    return _spans(spark, sf_dir, pos.contains)


@query(_SPAN.format(op="<="))
def span_contains_incl(spark, sf_dir):
    return _spans(spark, sf_dir, pos.within)


_PATH = "regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"


def _paths(spark, sf_dir):
    return ad.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("p"))


def _path_query(name, sql, f):
    def run(spark, sf_dir):
        return _paths(spark, sf_dir).select("page_id", f(F.col("p")).alias("v"))

    QUERIES[name] = run
    ORACLES[name] = f"WITH x AS (SELECT page_id, {_PATH} AS p FROM pages), y AS (SELECT page_id, p, list_filter(string_split(p, '/'), lambda c: c <> '' AND c <> '.') AS c FROM x), z AS (SELECT *, c[-1] AS name FROM y) SELECT page_id, {sql} AS v FROM z"


_path_query("path_filename", "name", pf.path_filename)
_path_query("path_dir", "array_to_string(c[:-2], '/')", pf.path_dir)
_path_query("path_fileext", "CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '\\.([^.]*)$', 1) END", pf.path_fileext)
_path_query("path_filestem", "CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^(.+)\\.[^.]*$', 1) ELSE name END", pf.path_filestem)
_path_query("path_split", "array_to_string(c, '|')", lambda p: F.array_join(pf.path_split(p), "|"))
_path_query("path_join", "rtrim(p, '/') || '/x/y'", lambda p: pf.path_join(p, F.lit("x/y")))
_path_query("path_normalize", "array_to_string(c[:-2] || ['z'], '/')", lambda p: pf.path_normalize(F.concat(p, F.lit("/./../z"))))
_path_query("path_descendant", "c[1] = 'tionsh.example.net' AND c[2] = 'fr'", lambda p: pf.path_descendant_of(p, F.lit("tionsh.example.net/fr")))


@query("SELECT doc_id, rtrim(to_base64(unhex(sha1(text))), '=') AS tag FROM documents")
def content_tag(spark, sf_dir):
    return ad.table(spark, sf_dir, "documents").select("doc_id", pf.content_tag(F.col("text")).alias("tag"))


@query("WITH s AS (SELECT page_id, 'plain' AS lang, 0 AS score, 0 AS p FROM pages WHERE url LIKE '%.html' UNION ALL SELECT page_id, 'nav', length(regexp_extract(html, '<nav>', 0)), 1 FROM pages WHERE url LIKE '%.html' AND regexp_matches(html, '<nav>')) SELECT page_id, arg_max(lang, score * 10 - p) AS lang FROM s GROUP BY 1")
def language_match(spark, sf_dir):
    """The language with the highest score for a file; the first of equal ones."""
    rows = ad.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    score = [("plain", pf.matches_file(F.col("url"), F.col("html"), ["html"])), ("nav", pf.matches_file(F.col("url"), F.col("html"), ["html"], "<nav>"))]
    each = rows.select("page_id", F.explode(F.array(*[F.struct(F.lit(n).alias("lang"), s.alias("score"), F.lit(k).alias("p")) for k, (n, s) in enumerate(score)])).alias("s")).where("s.score is not null")
    return each.groupBy("page_id").agg(F.max_by("s.lang", F.struct("s.score", -F.col("s.p"))).alias("lang"))


# ---- index

_LOG = "WITH e AS (SELECT 'u/' || user_id AS file, rtrim(to_base64(unhex(sha1(coalesce(props, '')))), '=') AS tag, CASE WHEN event_type = 'error' THEN event_type END AS error, event_id AS version FROM events), g AS (SELECT file, arg_max(tag, version) AS tag, max_by(coalesce(error, ''), version) AS error FROM e WHERE version % 2 = 0 GROUP BY file) "


def _graphs(spark, sf_dir, even=True):
    log = ad.log(spark, sf_dir).where("version % 2 = 0") if even else ad.log(spark, sf_dir)
    return log.groupBy("file").agg(F.max_by(F.struct("tag", "error"), "version").alias("r")).select("file", "r.*")


@query(_LOG + "SELECT DISTINCT e.file, CASE WHEN g.file IS NULL THEN 'missing' WHEN g.error <> '' THEN 'error' ELSE 'indexed' END AS status FROM e LEFT JOIN g ON e.file = g.file")
def index_status(spark, sf_dir):
    asked = ad.log(spark, sf_dir).select("file").distinct().withColumn("tag", F.lit(None).cast("string"))
    return index.status(asked, _graphs(spark, sf_dir)).select("file", "status")


@query(_LOG + "SELECT e.file, e.version FROM e JOIN g ON e.file = g.file AND e.tag = g.tag")
def index_skip_unchanged(spark, sf_dir):
    return index.unchanged(ad.log(spark, sf_dir), _graphs(spark, sf_dir)).select("file", "version")


@query("WITH e AS (SELECT 'u/' || user_id AS file, rtrim(to_base64(unhex(sha1(coalesce(props, '')))), '=') AS tag, event_id AS version FROM events) SELECT file, coalesce(arg_max(tag, version) FILTER (version % 2 = 1), arg_max(tag, version)) AS tag FROM e GROUP BY file")
def index_replace(spark, sf_dir):
    new = ad.log(spark, sf_dir).where("version % 2 = 1").groupBy("file").agg(F.max_by("tag", "version").alias("tag"))
    return index.replace(_graphs(spark, sf_dir).select("file", "tag"), new)


@query("SELECT DISTINCT 'u/' || user_id AS file FROM events WHERE event_id % 2 = 0 AND user_id <> 7")
def index_clean_dir(spark, sf_dir):
    return index.clean(_graphs(spark, sf_dir), "u/7").select("file")


@query(_LOG + "SELECT file, tag, nullif(error, '') AS error FROM g")
def index_list(spark, sf_dir):
    return index.listing(_graphs(spark, sf_dir), "u")


# ---- assertions and the test language


def _compare_sql(a, b):
    return f"SELECT *, 'missing' AS what FROM ({a} EXCEPT {b}) UNION ALL SELECT *, 'unexpected' FROM ({b} EXCEPT {a})"


@query(_compare_sql("SELECT DISTINCT o_custkey AS k, o_orderpriority AS v FROM orders WHERE o_orderstatus = 'O'", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'"))
def missing_and_unexpected(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), "o_orderstatus")
    return assertions.compare(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), ["k"], "v")


@query("WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '--- path: ' || role || ' ---' ELSE text END AS t FROM conversations) SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN regexp_extract(t, 'path: (.*) ---', 1) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS fragment FROM l")
def fragment_split(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations")
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("--- path: "), F.col("role"), F.lit(" ---"))).otherwise(F.col("text"))
    rows = assertions.fragments(c.select("conv_id", F.col("turn").alias("line"), F.regexp_replace(t, "[\\r\\n]+", " ").alias("line_text")), "conv_id")
    return rows.select("conv_id", F.col("line").alias("turn"), "fragment")


@query("SELECT conv_id, turn, max(CASE WHEN turn % 2 = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS target_line, [turn::VARCHAR, role] AS values FROM (SELECT conv_id, turn, role FROM conversations) QUALIFY turn % 2 = 1")
def assertion_parse(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations")
    t = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("  # ^ defines: "), F.col("turn"), F.lit(", "), F.col("role"))).otherwise("x")
    rows = assertions.assertions(c.select("conv_id", F.col("turn").alias("line"), t.alias("line_text")), "conv_id")
    return rows.select("conv_id", F.col("line").alias("turn"), "target_line", "values")


# ---- exchange and streams


@query("SELECT p_partkey AS k, p_name AS name, x AS dependency FROM part, unnest([p_brand, p_type]) AS u(x) WHERE p_brand <> p_type")
def manifest_deps(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part").where("p_brand <> p_type")
    m = p.select(F.col("p_partkey").alias("k"), F.to_json(F.struct(F.col("p_name").alias("name"), F.create_map(F.col("p_brand"), F.lit("1"), F.col("p_type"), F.lit("2")).alias("dependencies"))).alias("c"))
    return exchange.dependencies(m, "k", "c").select("k", "name", "dependency")


_SUPPLIED = "SELECT 'supplier/' || n_name AS file, s_suppkey * 3 AS k, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"""WITH s AS ({_SUPPLIED}), p AS (SELECT n_nationkey + 10 AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_name AS file, 0::BIGINT AS local_id, r_name AS symbol FROM region UNION ALL SELECT r_name, 1, '.' FROM region UNION ALL SELECT r_name, k, n_name FROM p
UNION ALL SELECT file, k, n_name FROM s UNION ALL SELECT file, k + 1, '.' FROM s UNION ALL SELECT file, k + 2, r_name FROM s
UNION ALL SELECT '[root]', NULL, r_name || '(0)' FROM region UNION ALL SELECT r_name || '(0)', NULL, r_name || '(1)' FROM region UNION ALL SELECT r_name || '(1)', NULL, r_name || '(' || k || ')' FROM p
UNION ALL SELECT file || '(' || k || ')', NULL, file || '(' || k + 1 || ')' FROM s UNION ALL SELECT file || '(' || k + 1 || ')', NULL, file || '(' || k + 2 || ')' FROM s UNION ALL SELECT file || '(' || k + 2 || ')', NULL, '[root]' FROM s""")
def graph_json_roundtrip(spark, sf_dir):
    back, edges = exchange.graph_from_json(exchange.graph_to_json(*ad.geo(spark, sf_dir, "supplier")), NODES_DDL, EDGES_DDL)
    nodes = back.where("file is not null").select("file", F.col("local_id").cast("bigint").alias("local_id"), "symbol")
    return nodes.union(edges.select("source", F.lit(None).cast("bigint"), "sink"))


@query("SELECT user_id AS k, max(event_id) AS version, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_upsert(spark, sf_dir):
    s = Scratch(spark, "stream")
    source = ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("version"), "event_type")
    s.table(source.repartition(4, "version"), "in")
    target = upsert.Upsert(spark, f"{s.base}/table", "k", ["version"], "k bigint, version bigint, event_type string")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(f"{s.base}/in")
    return upsert.run(stream, target, f"{s.base}/offsets")
