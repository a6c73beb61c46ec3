"""Queries about sources: graphs from attributes, nodes at positions, choice of files."""

from pyspark.sql import functions as F

from ..functions import paths as pf
from ..functions import positions as pos
from ..functions import selection
from ..operators import places, stats
from ..sources import builder
from . import adapters as ad
from .queries import _path_query, _paths, query

_BUILT = "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'pop_symbol' WHEN 1 THEN 'push_symbol' ELSE 'scope' END AS kind, CASE WHEN p_size % 3 < 2 THEN p_name END AS symbol, p_size % 3 = 0 AS is_definition, p_size % 3 = 1 AS is_reference, p_size % 3 = 2 AS is_exported, p_type AS debug FROM part"


def _attributes(spark, sf_dir):
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    common = [entry("debug_made", F.col("p_type")), entry("colour", F.col("p_brand"))]
    by_size = [[entry("type", F.lit("pop_symbol")), entry("symbol", F.col("p_name")), entry("is_definition", F.lit("true"))], [entry("type", F.lit("push_symbol")), entry("symbol", F.col("p_name")), entry("is_reference", F.lit("true"))]]
    s = F.col("p_size") % 3
    entries = F.when(s == 0, F.array(*common, *by_size[0])).when(s == 1, F.array(*common, *by_size[1])).otherwise(F.array(*common, entry("is_endpoint", F.lit("true"))))
    return ad.table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("local_id"), F.map_from_entries(entries).alias("attributes"))


@query(_BUILT)
def build_nodes(spark, sf_dir):
    n = builder.nodes_from_attributes(_attributes(spark, sf_dir))
    return n.select(F.col("ord").alias("id"), "kind", "symbol", "is_definition", "is_reference", "is_exported", F.get(F.col("debug_info"), F.lit(0))["value"].alias("debug"))


@query("SELECT p_partkey AS id, 'colour' AS attribute FROM part")
def build_unexpected_attributes(spark, sf_dir):
    return builder.unexpected_attributes(_attributes(spark, sf_dir)).select(F.col("local_id").cast("bigint").alias("id"), "attribute")


def _spanned(spark, sf_dir):
    """Orders as nodes of their customers' files, 20 columns wide; customers as places."""
    o, at = ad.table(spark, sf_dir, "orders"), (F.col("o_orderkey") % 100).cast("int")
    point = lambda c: F.struct(F.lit(0).alias("line"), c.alias("utf8"))
    nodes = o.select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("symbol"), (F.col("o_orderstatus") == "F").alias("is_definition"), (F.col("o_orderstatus") == "O").alias("is_reference"), F.struct(point(at).alias("start"), point(at + 20).alias("end")).alias("span"))
    c = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), F.col("c_custkey").alias("file"), F.lit(0).alias("line"), (F.col("c_custkey") % 100).cast("int").alias("column"))
    return nodes, c, c.select("place", F.lit("1-URGENT").alias("symbol"))


def _assert_sql(status: str) -> str:
    found = f"SELECT DISTINCT c_custkey AS place, o_orderpriority AS symbol FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = '{status}' AND o_orderkey % 100 <= c_custkey % 100 AND c_custkey % 100 < o_orderkey % 100 + 20"
    wanted = "SELECT c_custkey AS place, '1-URGENT' AS symbol FROM customer"
    return f"SELECT *, 'missing' AS what FROM ({wanted} EXCEPT {found}) UNION ALL SELECT *, 'unexpected' FROM ({found} EXCEPT {wanted})"


@query(_assert_sql("F"))
def assert_defines(spark, sf_dir):
    return places.assert_symbols(*_spanned(spark, sf_dir), "is_definition")


@query(_assert_sql("O"))
def assert_refers(spark, sf_dir):
    return places.assert_symbols(*_spanned(spark, sf_dir), "is_reference")


@query("WITH d AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT v, sum(n) OVER (ORDER BY v) AS cum FROM d), t AS (SELECT max(cum)::BIGINT AS total FROM c), q AS (SELECT k, min(v) AS value FROM range(5) AS r(k), t, c WHERE cum >= greatest(1, round(total * k / 4.0)) GROUP BY k) SELECT max(value) FILTER (k = 0) AS least, max(value) FILTER (k = 1) AS p25, max(value) FILTER (k = 2) AS p50, max(value) FILTER (k = 3) AS p75, max(value) FILTER (k = 4) AS most, (SELECT total FROM t) AS n FROM q")
def quartile_row(spark, sf_dir):
    d = stats.distribution(ad.table(spark, sf_dir, "lineitem"), "l_quantity").withColumn("of", F.lit("quantity"))
    names = dict(zip(("min", "q1", "median", "q3", "max"), ("least", "p25", "p50", "p75", "most")))
    return stats.quartiles_row(d, "of").select(*[F.col(a).alias(b) for a, b in names.items()], F.col("total").alias("n"))


@query("SELECT page_id FROM pages WHERE string_split(url, '/') >= string_split((SELECT url FROM pages WHERE url IS NOT NULL ORDER BY page_id LIMIT 1), '/')")
def resume_walk(spark, sf_dir):
    pages = ad.table(spark, sf_dir, "pages").select("page_id", "url")
    return selection.resume(pages, "url", pages.where("url is not null").orderBy("page_id").first()["url"]).select("page_id")


@query("WITH x AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages) SELECT page_id FROM x WHERE regexp_matches(p, '^[^/]*/(en|fr)/.*[.]html$') AND NOT regexp_matches(p, '/1[^/]*$')")
def input_files(spark, sf_dir):
    return selection.input_files(_paths(spark, sf_dir), "p", [], ["*/en/**", "*/fr/**"], ["**/1*"], ["html"]).select("page_id")


@query("WITH x AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages), y AS (SELECT *, page_id % 3 > 0 AND NOT contains(p, ':') AS good FROM x) SELECT page_id, CASE WHEN good THEN p END AS path, CASE WHEN good THEN page_id % 3 - 1 END::INTEGER AS line, CASE WHEN good THEN 1 END::INTEGER AS col FROM y")
def parse_position(spark, sf_dir):
    at = pos.parse_position(F.concat("p", F.lit(":"), F.col("page_id") % 3, F.lit(":2")))
    return _paths(spark, sf_dir).select("page_id", at.alias("at")).select("page_id", "at.path", "at.line", F.col("at.column").alias("col"))


_path_query("path_common_prefix", "CASE WHEN c[1] = 'tionsh.example.net' THEN CASE WHEN c[2] = 'fr' THEN 'tionsh.example.net/fr' ELSE c[1] END END", lambda p: pf.longest_common_prefix(p, F.lit("tionsh.example.net/fr")))
