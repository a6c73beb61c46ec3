"""Queries about the index, the entry points and the manifests."""

from pyspark.sql import functions as F

from ..operators import assertions, graph
from ..operators.places import assert_defined as check_defined
from ..schema import EDGES_DDL, PATHS_DDL, ROOT, SPAN
from ..session import Scratch
from ..sources import manifests
from ..sources.index import FileIndex
from ..streaming import upsert
from . import adapters as ad
from . import service
from .closure import partial_paths, resolve_edges
from .queries import _GEO, _local, query

_PLACES = "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


def _placed(spark, sf_dir):
    """The suppliers' graph with a span for every node: line its local id, columns 0 to 5."""
    nodes, edges = ad.geo(spark, sf_dir, "supplier")
    point = lambda at: F.struct(F.col("local_id").alias("line"), *[F.lit(at).alias(c) for c in ("utf8", "utf16", "grapheme")])
    span = F.when(F.col("file").isNotNull(), F.struct(point(0).alias("start"), point(5).alias("end"))).cast(SPAN)
    return nodes.withColumn("span", span), edges


def _index(spark, sf_dir):
    s, index = Scratch(spark, "placed"), FileIndex.temporary(spark)
    nodes, edges = (s.table(df, n) for df, n in zip(_placed(spark, sf_dir), ("nodes", "edges")))
    paths = s.table(partial_paths(nodes, edges), "paths")
    files = nodes.where("file is not null").select("file").distinct()
    index.store(files.select("file", F.lit("t").alias("tag"), F.lit(None).cast("string").alias("error")), nodes.where("file is not null"), edges, paths)
    return index


def _references(spark, sf_dir):
    """A place in the middle of each supplier's reference."""
    n = ad.table(spark, sf_dir, "nation")
    s = ad.table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("place"), F.concat(F.lit("supplier/"), "n_name").alias("file"), (F.col("s_suppkey") * 3).cast("int").alias("line"), F.lit(2).alias("column"), "n_nationkey", "n_regionkey")


# ---- go to definition


@query(_GEO.format(k="s", c="supp", t="supplier").replace("AS person", "AS place").replace("AS nation", "AS symbol").replace("AS region", "AS file, (n_nationkey + 10)::BIGINT AS line"))
def goto_definition(spark, sf_dir):
    """By position, over the index: places of references to the nations' definitions."""
    found = service.goto_definition(_index(spark, sf_dir), _references(spark, sf_dir).select("place", "file", "line", "column"))
    return found.select("place", "symbol", "file", F.col("span.start.line").cast("bigint").alias("line"))


@query(f"SELECT r_name AS file, n_nationkey + 10 AS id FROM ({_PLACES}) WHERE r_name = 'ASIA' UNION ALL SELECT 'ASIA', 0 UNION ALL SELECT 'ASIA', 1")
def load_graph(spark, sf_dir):
    nodes, _ = _index(spark, sf_dir).graph("ASIA")
    return nodes.where("file is not null").select("file", F.col("local_id").cast("bigint").alias("id"))


@query("SELECT s_suppkey AS supplier, 1::BIGINT AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def load_paths_for_nodes(spark, sf_dir):
    """The stored paths that start at each supplier's reference."""
    index = _index(spark, sf_dir)
    asked = _references(spark, sf_dir).select(F.concat("file", F.lit("("), F.col("place") * 3, F.lit(")")).alias("nid"))
    return index.paths_for_nodes(asked).groupBy((_local("start_nid") / 3).cast("bigint").alias("supplier")).agg(F.count("*").alias("n"))


@query("SELECT r_name || '(0)' AS target, 1::BIGINT AS n FROM region WHERE r_name = 'ASIA'")
def load_paths_for_roots(spark, sf_dir):
    """What is stored for a stack of a region, a dot and a nation: the region's own definition; the nation is reached from it."""
    index = _index(spark, sf_dir)
    stack = spark.range(1).select(ad.stack_of(F.array(F.lit("ASIA"), F.lit("."), F.lit("CHINA"))).alias("sym_post"))
    return index.paths_for_roots(stack).groupBy(F.col("end_nid").alias("target")).agg(F.count("*").alias("n"))


@query("SELECT 'graphs' AS \"table\", (SELECT count(*) FROM region) + (SELECT count(DISTINCT s_nationkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) AS n UNION ALL SELECT 'roots', count(*) FROM region")
def index_stats(spark, sf_dir):
    return _index(spark, sf_dir).stats().where(F.col("table").isin("graphs", "roots"))


@query("SELECT 'n/' || n_name AS file, CASE WHEN n_nationkey % 3 = 1 THEN 'b' ELSE 'a' END AS tag, CASE WHEN n_nationkey % 3 = 1 THEN 'broken' END AS error FROM nation WHERE n_nationkey % 3 <> 2")
def index_store(spark, sf_dir):
    """Files stored, some of them again as errors, and a part cleaned."""
    index, n = FileIndex.temporary(spark), ad.table(spark, sf_dir, "nation")
    file = F.concat(F.when(F.col("n_nationkey") % 3 == 2, "old/").otherwise("n/"), "n_name")
    nodes = ad.nodes_of(n, file, F.col("n_nationkey"), "pop_symbol", F.col("n_name"), True)
    none = lambda ddl: spark.createDataFrame([], ddl)
    index.store(n.select(file.alias("file"), F.lit("a").alias("tag"), F.lit(None).cast("string").alias("error")), nodes, none(EDGES_DDL), none(PATHS_DDL))
    index.store_errors(n.where("n_nationkey % 3 = 1").select(file.alias("file"), F.lit("b").alias("tag"), F.lit("broken").alias("error")))
    index.clean("old")
    return index.listing()


# ---- indexing with front-ends


def _packages(spark, sf_dir, changed=False):
    """A manifest per nation, that needs its region; the project is the nation's key."""
    n = ad.table(spark, sf_dir, "nation").join(ad.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat("n_name", F.when(F.lit(changed) & (F.col("n_nationkey") % 2 == 0), "2").otherwise(""))
    content = F.to_json(F.struct(name.alias("name"), F.lit("./lib/main.js").alias("main"), F.create_map("r_name", F.lit("1")).alias("dependencies")))
    return n.select(F.concat(F.lit("p/"), "n_name", F.lit("/package.json")).alias("file"), content.alias("content"), F.col("n_nationkey").cast("string").alias("project"))


def _npm(files):
    wrong = files.where(F.from_json("content", "name string").isNull()).select("file", F.lit("not a manifest").alias("error"))
    nodes, edges = manifests.npm_packages(files.select("file", "content", F.lit("p").alias("project")))
    return nodes, edges, wrong


@query(f"SELECT 'p/' || n_name || '/package.json' AS file, 'succeeded' AS first, CASE WHEN n_nationkey % 2 = 0 THEN 'succeeded' ELSE 'skipped' END AS second FROM ({_PLACES})")
def index_all(spark, sf_dir):
    """All manifests indexed, and again after every other one changed."""
    index, s = FileIndex.temporary(spark), Scratch(spark, "all")
    language = service.Language("npm", _npm, file_names=["package.json"])
    one, two = (s.table(service.index_all(index, _packages(spark, sf_dir, c).select("file", "content"), [language]), f"r{c}") for c in (False, True))
    return one.select("file", F.col("status").alias("first")).join(two.select("file", F.col("status").alias("second")), "file")


_NPM = """SELECT n_nationkey, unnest(['GUARD:PKG_INTERNAL', n_nationkey::VARCHAR, 'GUARD:PKG_INTERNAL', n_nationkey::VARCHAR, 'GUARD:MODULE', 'GUARD:PKG', n_name, 'lib', 'main', 'GUARD:PKG', 'GUARD:PKG', r_name, r_name]) AS symbol,
unnest(['pop', 'pop', 'push', 'push', 'push', 'pop', 'pop', 'push', 'push', 'pop', 'push', 'pop', 'push']) AS kind, unnest(range(13)) AS id"""


@query(f"SELECT 'p/' || n_name || '/package.json' AS file, id, symbol, kind || '_symbol' AS kind FROM ({_NPM}, n_name FROM ({_PLACES}))")
def npm_nodes(spark, sf_dir):
    nodes, _ = manifests.npm_packages(_packages(spark, sf_dir))
    return nodes.select("file", F.col("local_id").cast("bigint").alias("id"), "symbol", "kind")


@query(f"""SELECT 'p/' || n_name || '/package.json' AS file, a, b FROM ({_PLACES}), unnest([{{'a': -1, 'b': 0}}, {{'a': 0, 'b': 1}}, {{'a': 2, 'b': -1}}, {{'a': 3, 'b': 2}}, {{'a': 4, 'b': 3}}, {{'a': -1, 'b': 5}}, {{'a': 5, 'b': 6}}, {{'a': 7, 'b': 4}}, {{'a': 8, 'b': 7}}, {{'a': 1, 'b': 9}}, {{'a': 10, 'b': -1}},
{{'a': 9, 'b': 11}}, {{'a': 12, 'b': 10}}, {{'a': 6, 'b': 4}}, {{'a': 6, 'b': 8}}, {{'a': 11, 'b': 12}}]) AS u(x), (SELECT 1), LATERAL (SELECT x.a::BIGINT AS a, x.b::BIGINT AS b)""")
def npm_edges(spark, sf_dir):
    _, edges = manifests.npm_packages(_packages(spark, sf_dir))
    number = lambda c: F.when(F.col(c) == ROOT, F.lit(-1).cast("bigint")).otherwise(_local(c))
    own = F.when(F.col("source") == ROOT, F.col("sink")).otherwise(F.col("source"))
    return edges.select(F.substring_index(own, "(", 1).alias("file"), number("source").alias("a"), number("sink").alias("b"))


@query(f"SELECT n_nationkey AS project, list_sort(['%Proj', n_nationkey::VARCHAR, '%Proj', n_nationkey::VARCHAR, '%NonRelM', n_name, '%PkgM', '%M', 'lib', 'main', '%NonRelM', r_name, '%NonRelM', r_name]) AS symbols, 15::BIGINT AS n FROM ({_PLACES})")
def npm_namespaced(spark, sf_dir):
    p = _packages(spark, sf_dir)
    nodes, _ = manifests.npm_packages_namespaced(p)
    of = p.select("file", F.col("project").cast("bigint").alias("project"))
    return nodes.join(of, "file").groupBy("project").agg(F.array_sort(F.collect_list("symbol")).alias("symbols"), F.count("*").alias("n"))


def _projects(spark, sf_dir):
    """A project per nation: composite ones, ones with a root directory, and others; a source per customer, by segment."""
    n, k = ad.table(spark, sf_dir, "nation"), F.col("n_nationkey") % 4
    content = F.when(k == 0, '{"compilerOptions": {"composite": true}}').when(k == 1, '{"compilerOptions": {"rootDir": "./a/../src"}}').when(k == 2, '{"compilerOptions": {"baseUrl": "lib", "paths": {"@x/*": ["y/*", "z"], "w": ["../v", "/abs"], "../out": ["u"]}, "rootDirs": ["r1", "../r2"]}}').otherwise('{"include": ["src/*"], "exclude": ["src/**/*BUILD*"], "files": ["extra.ts"]}')
    configs = n.select(F.concat(F.lit("w/"), "n_name", F.lit("/tsconfig.json")).alias("file"), content.alias("content"), F.col("n_name").alias("project"))
    c = ad.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return configs, c.select(F.concat(F.lit("w/"), "n_name", F.lit("/src/"), "c_mktsegment", F.lit("/c"), "c_custkey", F.lit(".ts")).alias("path"))


_SEGMENTS = "SELECT n_nationkey, n_name, count(DISTINCT c_mktsegment) AS n, min(c_mktsegment) AS one FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2"


@query(f"SELECT 'w/' || n_name || '/tsconfig.json' AS file, CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'src' WHEN 2 THEN CASE WHEN n > 1 THEN 'src' WHEN n = 1 THEN 'src/' || one ELSE '' END ELSE '' END AS root FROM ({_SEGMENTS})")
def project_root_dirs(spark, sf_dir):
    configs, paths = _projects(spark, sf_dir)
    return manifests.root_dirs(manifests.configurations(configs), paths)


@query("SELECT 'w/' || n_name || '/tsconfig.json' AS file, source, target FROM nation, unnest([{'s': '@x', 't': 'lib/y'}, {'s': 'w', 't': 'v'}]) AS u(m), LATERAL (SELECT m.s AS source, m.t AS target) WHERE n_nationkey % 4 = 2")
def project_path_mappings(spark, sf_dir):
    configs, _ = _projects(spark, sf_dir)
    return manifests.path_mappings(manifests.configurations(configs)).select("file", "source", "target")


@query("SELECT 'w/' || n_name || '/tsconfig.json' AS file, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 4 < 3 GROUP BY 1")
def project_input_files(spark, sf_dir):
    """Sources of each project; the last kind lists patterns that none of these fits."""
    configs, paths = _projects(spark, sf_dir)
    return manifests.input_files(manifests.configurations(configs), paths).groupBy("file").agg(F.count("*").alias("n"))


@query("""SELECT 'w/' || n_name || '/tsconfig.json' AS file, list_sort(['%Proj', n_name, '%Proj', n_name, '%PkgM', '%M', '%NonRelM', '%M'] || CASE n_nationkey % 4 WHEN 1 THEN ['src'] WHEN 2 THEN ['lib', '%RelM', '%M', 'r1', '%NonRelM', '@x', '%M', 'lib', 'y', '%NonRelM', 'w', '%M', 'v'] || CASE WHEN n > 1 THEN ['src'] WHEN n = 1 THEN ['src', one] ELSE [] END ELSE [] END) AS symbols FROM (""" + _SEGMENTS + ")")
def project_nodes(spark, sf_dir):
    nodes, _ = manifests.project_configurations(*_projects(spark, sf_dir))
    return nodes.groupBy("file").agg(F.array_sort(F.collect_list("symbol")).alias("symbols"))


@query("SELECT page_id, CASE WHEN NOT url LIKE '%.html' THEN NULL WHEN regexp_matches(html, '<nav>') THEN 'nav' ELSE 'plain' END AS language FROM pages")
def best_language(spark, sf_dir):
    none = lambda files: None
    languages = [service.Language("plain", none, ["html"]), service.Language("nav", none, ["html"], "<nav>")]
    files = ad.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file"), F.col("html").alias("content"))
    return service.best_language(files, languages).select("page_id", "language")


# ---- assertions

_TOLD = "SELECT s_suppkey AS place, n_nationkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _told(spark, sf_dir):
    """At each reference, the line of its definition (from 0); of every third supplier another line."""
    at = _references(spark, sf_dir).join(ad.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.col("n_nationkey") + 10 + F.when(F.col("place") % 3 == 0, 100).otherwise(0)
    return at.select("place", "file", "line", "column", F.col("r_name").alias("target_file"), line.cast("int").alias("target"))


def _outcome(spark, sf_dir):
    s, told = Scratch(spark, "told"), _told(spark, sf_dir)
    nodes, edges = (s.table(df, n) for df, n in zip(_placed(spark, sf_dir), ("nodes", "edges")))
    found = s.table(graph.drop_shadowed(resolve_edges(nodes, edges)), "found")
    targets = told.select("place", F.col("target_file").alias("file"), F.col("target").alias("line"))
    return check_defined(found, nodes, told.select("place", "file", "line", "column"), targets)


@query(f"SELECT place, CASE WHEN what = 'missing' THEN k + 110 ELSE k + 10 END::BIGINT AS line, what FROM ({_TOLD}), (VALUES ('missing'), ('unexpected')) AS v(what) WHERE place % 3 = 0")
def assert_defined(spark, sf_dir):
    return _outcome(spark, sf_dir).withColumn("line", F.col("line").cast("bigint"))


@query(f"SELECT place, (k + 110)::BIGINT AS line FROM ({_TOLD}) WHERE place % 3 = 0")
def missing_targets(spark, sf_dir):
    return _outcome(spark, sf_dir).where("what = 'missing'").select("place", F.col("line").cast("bigint").alias("line"))


@query(f"SELECT place, (k + 10)::BIGINT AS line FROM ({_TOLD}) WHERE place % 3 = 0")
def unexpected_targets(spark, sf_dir):
    return _outcome(spark, sf_dir).where("what = 'unexpected'").select("place", F.col("line").cast("bigint").alias("line"))


_TESTS = f"SELECT kind, count(*) AS tests, count(*) FILTER (place % 3 > 0) AS passed, count(*) FILTER (place % 3 = 0) AS failed FROM ({_TOLD}), (VALUES ('defined'), ('refers')) AS v(kind) GROUP BY kind"


@query(_TESTS)
def run_tests(spark, sf_dir):
    """Assertions about where references lead, and about their names, of which every third is wrong."""
    told = _told(spark, sf_dir).withColumn("name", F.when(F.col("place") % 3 == 0, "?").otherwise(F.regexp_replace("file", "^supplier/", "")))
    kinds = [("defined", F.array((F.col("target") + 1).cast("string"))), ("refers", F.array("name"))]
    asserted = ad.union(*[told.select(F.concat(F.lit(k), "place").alias("place"), F.lit(k).alias("kind"), "file", "line", "column", "target_file", v.alias("values")) for k, v in kinds])
    nodes, edges = _placed(spark, sf_dir)
    return assertions.results(service.run_tests(nodes, edges, asserted), by=["kind"])


# ---- changes


@query("SELECT user_id AS k, max(event_id) AS version, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_restart(spark, sf_dir):
    """Half of the events, then a new process with the others: the table goes on from its folder."""
    s = Scratch(spark, "restart")
    source = ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("version"), "event_type")
    schema = "k bigint, version bigint, event_type string"
    out = None
    for half in (0, 1):
        source.where(F.col("version") % 2 == half).write.mode("append").parquet(f"{s.base}/in")
        target = upsert.Upsert(spark, f"{s.base}/table", "k", ["version"], schema)
        out = upsert.run(spark.readStream.schema(source.schema).parquet(f"{s.base}/in"), target, f"{s.base}/offsets")
    return out


@query("SELECT 'n/' || n_regionkey || '/' || n_name AS file FROM nation WHERE n_regionkey NOT IN (1) UNION ALL SELECT 'added: n/' || n_regionkey || '/' || n_name FROM nation WHERE n_regionkey = 4")
def change_folders(spark, sf_dir):
    index, n = FileIndex.temporary(spark), ad.table(spark, sf_dir, "nation")
    files = n.select(F.concat_ws("/", F.lit("n"), "n_regionkey", "n_name").alias("file"))
    index.store_errors(files.select("file", F.lit("t").alias("tag"), F.lit("none").alias("error")))
    todo = upsert.change_folders(index, ["n/1"], ["n/4"], files)
    return index.listing().select("file").union(todo.select(F.concat(F.lit("added: "), "file")))

