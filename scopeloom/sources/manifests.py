"""Graphs of package and project manifests, for all manifests at once.

A manifest's graph is made of chains: pops that lead away from a node, and pushes that lead to one. A chain (or a
scope, without symbols) is a row with its symbols; chains become nodes and edges by position, and links join the ends of two chains.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as pf
from ..functions.selection import glob_regex
from ..operators.graph import first_wins
from ..plans.adapters import edges_of, node_id, nodes_of, union
from ..schema import ROOT

# The symbols under which packages and modules are found.
GUARD_INTERNAL, GUARD_PACKAGE, GUARD_MODULE = "GUARD:PKG_INTERNAL", "GUARD:PKG", "GUARD:MODULE"
MODULE, NON_RELATIVE, PROJECT, RELATIVE, PACKAGE = "%M", "%NonRelM", "%Proj", "%RelM", "%PkgM"

_CHAIN = "array<struct<chain:string,kind:string,anchor:string,symbols:array<string>>>"
_LINK = "array<struct<source:string,sink:string>>"


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))


def module_chain(df: DataFrame, key: str, path: str, kind: str) -> DataFrame:
    """One node per component of a module path: (key, pos, symbol, kind, before), each leading to the next."""
    rows = df.select(key, F.posexplode(components(F.col(path))).alias("pos", "symbol"))
    return rows.select(key, "pos", "symbol", F.lit(kind).alias("kind"), F.when(F.col("pos") > 0, F.col("pos") - 1).alias("before"))


def _chain(name, kind: str, anchor, symbols: Column) -> Column:
    name, anchor = (F.lit(x) if isinstance(x, str) else x for x in (name, anchor))
    return F.struct(name.alias("chain"), F.lit(kind).alias("kind"), anchor.alias("anchor"), symbols.alias("symbols"))


def _link(source, sink) -> Column:
    source, sink = (F.lit(x) if isinstance(x, str) else x for x in (source, sink))
    return F.struct(source.alias("source"), sink.alias("sink"))


def _one(*symbols) -> Column:
    return F.array(*[F.lit(s) if isinstance(s, str) else s for s in symbols])


def graph_of(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of (file, chains, links). An anchor is a chain's name, or the root; a chain without symbols ends where it
    is anchored. Local ids number a file's nodes in the order of its chains; debug information holds the chain's name."""
    rows = manifests.select("file", F.posexplode("chains").alias("c", "x")).select("file", "c", "x.*")
    each = rows.select("file", "c", "chain", "kind", "anchor", F.size("symbols").alias("n"), F.posexplode("symbols").alias("pos", "symbol"))
    each = each.withColumn("id", (F.row_number().over(Window.partitionBy("file").orderBy("c", "pos")) - 1).cast("int"))
    last = each.where("pos = n - 1").select("file", "chain", node_id(F.col("file"), F.col("id")).alias("end"))
    root = manifests.select("file", F.lit(ROOT).alias("chain"), F.lit(ROOT).alias("end"))
    ends = last.unionByName(root)
    empty = rows.where(F.size("symbols") == 0).select("file", F.col("chain").alias("name"), F.col("anchor").alias("chain"))
    ends = ends.unionByName(empty.join(ends, ["file", "chain"]).select("file", F.col("name").alias("chain"), "end"))
    kinds = [nodes_of(each.where(F.col("kind") == k), F.col("file"), F.col("id"), n, None if k == "scope" else F.col("symbol")) for k, n in (("pop", "pop_symbol"), ("push", "push_symbol"), ("scope", "scope"))]
    named = each.select(node_id(F.col("file"), F.col("id")).alias("nid"), F.array(F.struct(F.lit("name").alias("key"), F.concat("chain", F.when(F.col("n") > 1, F.format_string("[%d]", "pos")).otherwise("")).alias("value"))).alias("debug_info"))
    nodes = union(*kinds).drop("debug_info").join(named, "nid")
    here = node_id(F.col("file"), F.col("id"))
    steps = each.join(ends.select("file", F.col("chain").alias("anchor"), F.col("end").alias("at")), ["file", "anchor"])
    before = F.when(F.col("pos") == 0, F.col("at")).otherwise(node_id(F.col("file"), F.col("id") - 1))
    inner = edges_of(steps, F.when(F.col("kind") == "push", here).otherwise(before), F.when(F.col("kind") == "push", before).otherwise(here))
    links = manifests.select("file", F.explode("links").alias("l")).select("file", "l.*")
    s, t = (ends.select("file", F.col("chain").alias(x), F.col("end").alias(f"{x}_end")) for x in ("source", "sink"))
    joined = links.join(s, ["file", "source"]).join(t, ["file", "sink"]).where("source_end <> sink_end")
    outer = edges_of(joined, F.col("source_end"), F.col("sink_end"))
    edges = first_wins(inner.unionByName(outer)).withColumn("debug_info", F.expr("cast(array() as array<struct<key:string,value:string>>)"))
    return nodes, edges.select("source", "sink", "precedence", "ord", "debug_info")


_PACKAGE = "name string, main string, dependencies map<string,string>"


def _package(manifests: DataFrame) -> DataFrame:
    m = manifests.select("file", "project", F.from_json("content", _PACKAGE).alias("m"))
    main = F.when(F.coalesce(F.col("m.main"), F.lit("")) != "", pf.relative_normalize(F.col("m.main")))
    names = F.array_sort(F.filter(F.map_keys("m.dependencies"), lambda x: x != ""))
    return m.select("file", "project", F.coalesce("m.name", F.lit("")).alias("name"), pf.without_extension(F.coalesce(main, F.lit("index"))).alias("main"), F.coalesce(names, F.array().cast("array<string>")).alias("needs"))


def _made(df: DataFrame, chains: list[Column], links: list[Column]) -> DataFrame:
    return df.select("file", F.concat(*[c.cast(_CHAIN) for c in chains]).alias("chains"), F.concat(*[x.cast(_LINK) for x in links]).alias("links"))


def npm_packages(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs of package manifests (file, content, project): the package's insides from its internal name (``project``, empty
    without one), its exports and main module from its name, and its dependencies from its insides."""
    p = _package(manifests).withColumn("project", F.coalesce("project", F.lit("")))
    named = F.col("name") != ""
    nothing = F.array().cast(_CHAIN)
    base = F.array(
        _chain("pkg_internal_guard_pop", "pop", ROOT, _one(GUARD_INTERNAL)), _chain("pkg_internal_name_pop", "pop", "pkg_internal_guard_pop", _one(F.col("project"))),
        _chain("pkg_internal_guard_push", "push", ROOT, _one(GUARD_INTERNAL)), _chain("pkg_internal_name_push", "push", "pkg_internal_guard_push", _one(F.col("project"))),
    )
    own = F.array(
        _chain("main_guard", "push", "pkg_internal_name_push", _one(GUARD_MODULE)), _chain("pkg_guard_pop", "pop", ROOT, _one(GUARD_PACKAGE)),
        _chain("pkg_name_pop", "pop", "pkg_guard_pop", components(F.col("name"))), _chain("main_push", "push", "main_guard", components(F.col("main"))),
    )
    guards = F.array(_chain("dep_guard_pop", "pop", "pkg_internal_name_pop", _one(GUARD_PACKAGE)), _chain("dep_guard_push", "push", ROOT, _one(GUARD_PACKAGE)))
    name = lambda k, x: F.concat(F.lit(f"dep_name_{k}:"), x)
    needs = F.flatten(F.transform("needs", lambda x: F.array(_chain(name("pop", x), "pop", "dep_guard_pop", components(x)), _chain(name("push", x), "push", "dep_guard_push", components(x)))))
    own_links = F.array(_link("pkg_name_pop", "main_guard"), _link("pkg_name_pop", "main_push"))
    need_links = F.transform("needs", lambda x: _link(name("pop", x), name("push", x)))
    return graph_of(_made(p, [base, F.when(named, own).otherwise(nothing), guards, needs], [F.when(named, own_links).otherwise(F.array().cast(_LINK)), need_links]))


def _scoped(prefix: str) -> tuple[Column, Column, Column]:
    """Chains of a project's scope, the anchor that the rest of its manifest uses, and links: the scope is reached by the
    project's name and reaches others by theirs; without a name all hangs on the root."""
    known = F.col("project").isNotNull()
    chains = F.array(
        _chain(f"{prefix}.proj_def", "pop", ROOT, _one(PROJECT, F.col("project"))), _chain(f"{prefix}.proj_scope", "scope", f"{prefix}.proj_def", _one("")),
        _chain(f"{prefix}.proj_ref", "push", ROOT, _one(PROJECT, F.col("project"))),
    )
    links = F.array(_link(f"{prefix}.proj_scope", f"{prefix}.proj_ref"))
    return F.when(known, chains).otherwise(F.array().cast(_CHAIN)), F.when(known, F.lit(f"{prefix}.proj_scope")).otherwise(ROOT), F.when(known, links).otherwise(F.array().cast(_LINK))


def npm_packages_namespaced(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for typed sources: module paths are found under namespaces, and a project's insides under its name."""
    p = _package(manifests)
    scope, anchor, scope_links = _scoped("npm_package")
    named = F.col("name") != ""
    ns = lambda x, path: F.concat(F.array(F.lit(x)), components(path))
    own = F.array(
        _chain("npm_package.pkg_def", "pop", ROOT, ns(NON_RELATIVE, F.col("name"))), _chain("npm_package.pkg_ref", "push", anchor, _one(PACKAGE)),
        _chain("npm_package.main_ref", "push", anchor, ns(MODULE, F.col("main"))),
    )
    name = lambda k, x: F.concat(F.lit(f"npm_package.dep_{k}:"), x)
    needs = F.flatten(F.transform("needs", lambda x: F.array(_chain(name("def", x), "pop", anchor, ns(NON_RELATIVE, x)), _chain(name("ref", x), "push", ROOT, ns(NON_RELATIVE, x)))))
    own_links = F.array(_link("npm_package.pkg_def", "npm_package.pkg_ref"), _link("npm_package.pkg_def", "npm_package.main_ref"))
    need_links = F.transform("needs", lambda x: _link(name("def", x), name("ref", x)))
    return graph_of(_made(p, [scope, F.when(named, own).otherwise(F.array().cast(_CHAIN)), needs], [scope_links, F.when(named, own_links).otherwise(F.array().cast(_LINK)), need_links]))


# ---- project configurations

_CONFIG = "compilerOptions struct<allowJs:boolean,baseUrl:string,composite:boolean,paths:map<string,array<string>>,rootDir:string,rootDirs:array<string>>, files array<string>, include array<string>, exclude array<string>"
_EXTENSIONS = ["ts", "tsx", "d.ts"]


def _inner(p: Column) -> Column:
    """A relative path that stays inside, normalized; else null."""
    n = pf.relative_normalize(p)
    return F.when(~pf.escapes(n), n)


def configurations(manifests: DataFrame) -> DataFrame:
    """(file, project, folder and what the configuration says) of (file, content, project)."""
    m = manifests.select("file", "project", F.coalesce(pf.path_dir(F.col("file")), F.lit("")).alias("folder"), F.from_json("content", _CONFIG).alias("m"))
    o = "m.compilerOptions."
    return m.select(
        "file", "project", "folder", F.coalesce(F.col(o + "allowJs"), F.lit(False)).alias("allow_js"), F.coalesce(_inner(F.col(o + "baseUrl")), F.lit("")).alias("base_url"), F.coalesce(F.col(o + "composite"), F.lit(False)).alias("composite"),
        _inner(F.col(o + "rootDir")).alias("root_dir"), F.coalesce(F.filter(F.transform(o + "rootDirs", _inner), lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("root_dirs"),
        F.col(o + "paths").alias("paths"), F.col("m.files").alias("files"), F.col("m.include").alias("include"), F.col("m.exclude").alias("exclude"),
    )


def path_mappings(configs: DataFrame) -> DataFrame:
    """(file, source, target, is_prefix): module paths and where they lead, the base applied; ``*`` at the end of both maps all
    that begins so, and is taken off. Mappings that leave the project are left out."""
    rows = configs.where("paths is not null").select("file", "base_url", F.explode("paths").alias("source", "targets"))
    rows = rows.withColumn("source", _inner(F.col("source"))).where("source is not null")
    prefix = lambda c: pf.path_filename(F.col(c)) == "*"
    joined = F.when(F.startswith("t", F.lit("/")), F.lit(None)).otherwise(pf.path_normalize(pf.path_join(F.col("base_url"), F.col("t"))))
    each = rows.select("file", "source", F.coalesce(prefix("source"), F.lit(False)).alias("is_prefix"), "base_url", F.explode("targets").alias("t"))
    each = each.select("file", "source", "is_prefix", joined.alias("target")).where("target is not null").where(~F.col("is_prefix") | F.coalesce(prefix("target"), F.lit(False)))
    cut = lambda c: F.when(F.col("is_prefix"), F.coalesce(pf.path_dir(F.col(c)), F.lit(""))).otherwise(F.col(c))
    return each.select("file", cut("source").alias("source"), cut("target").alias("target"), "is_prefix")


def _below(paths: DataFrame, configs: DataFrame) -> DataFrame:
    """(file, path): every source path with the configurations in folders above it, the path relative to the folder. Paths and
    folders meet by the path's ancestors, an equi-join."""
    parts = pf.path_split(F.col("path"))
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(pf.join_components(F.slice(parts, 1, k)).alias("folder"), pf.join_components(F.slice(parts, k + 1, F.size(parts))).alias("rest")))
    rows = paths.select(F.explode(up).alias("u")).select("u.folder", F.col("u.rest").alias("path"))
    return configs.join(rows, "folder")


def _patterns(patterns: Column, allow_js: Column) -> Column:
    """Patterns without an extension stand for one of each kind of source."""
    more = F.when(allow_js, F.array(*[F.lit(x) for x in [*_EXTENSIONS, "js", "jsx"]])).otherwise(F.array(*[F.lit(x) for x in _EXTENSIONS]))

    def one(p):
        whole = F.when(pf.path_filename(p).isNull() | (pf.path_filename(p) == "**"), F.concat(F.rtrim(p, F.lit("/")), F.lit("/*"))).otherwise(p)
        return F.when(pf.path_fileext(p).isNotNull(), F.array(p)).otherwise(F.transform(more, lambda e: F.concat(whole, F.lit("."), e)))

    return F.flatten(F.transform(patterns, one))


def _as_regex(glob: Column) -> Column:
    """``glob_regex`` for patterns in a column."""
    quoted = F.regexp_replace(glob, r"[.+^$(){}\[\]|\\]", r"\\$0")
    for mark, regex in (("**/", "\u0001"), ("**", "\u0002"), ("*", "[^/]*"), ("?", "[^/]"), ("\u0001", "(?:[^/]+/)*"), ("\u0002", ".*")):
        quoted = F.replace(quoted, F.lit(mark), F.lit(regex))
    return F.concat(F.lit("^"), quoted, F.lit("$"))


def input_files(configs: DataFrame, paths: DataFrame) -> DataFrame:
    """(file, path) of each configuration's sources: those listed, and those that an include pattern fits and no exclude pattern
    does; without a list or patterns, all of its kinds of source. Paths are relative to the configuration's folder."""
    empty = F.array().cast("array<string>")
    default = F.when(F.col("files").isNotNull(), empty).otherwise(F.array(F.lit("**/*")))
    rules = configs.withColumns({"inc": F.transform(_patterns(F.coalesce("include", default), F.col("allow_js")), _as_regex), "exc": F.transform(_patterns(F.coalesce("exclude", empty), F.col("allow_js")), _as_regex)})
    rows = _below(paths, rules).withColumn("path", pf.relative_normalize(F.col("path")))
    listed = F.array_contains(F.coalesce("files", empty), F.col("path"))
    fits = lambda c: F.exists(c, lambda r: F.regexp_like("path", r))
    return rows.where(listed | (fits("inc") & ~fits("exc"))).select("file", "path")


def root_dirs(configs: DataFrame, paths: DataFrame) -> DataFrame:
    """(file, root): what a configuration says, the project itself if it is composite, else the folder that all of its sources
    share. The longest common prefix of many paths is that of the least and the greatest of them."""
    parts = pf.path_split(F.coalesce(pf.path_dir(F.col("path")), F.lit("")))
    ends = input_files(configs, paths).groupBy("file").agg(F.min(parts).alias("a"), F.max(parts).alias("b"))
    n = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size("a"), F.size("b")), F.lit(1))), lambda k: F.slice("a", 1, k) == F.slice("b", 1, k)))
    common = ends.select("file", F.when(F.size("a") == 0, "").otherwise(pf.join_components(F.slice("a", 1, n))).alias("common"))
    root = F.coalesce("root_dir", F.when(F.col("composite"), ""), "common", F.lit(""))
    return configs.join(common, "file", "left").select("file", root.alias("root"))


def project_configurations(manifests: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs of project configurations (file, content, project), with all source paths (path): the root directory from the
    package, relative modules by the further roots, others by the base and the path mappings."""
    configs = configurations(manifests)
    mapped = path_mappings(configs).groupBy("file").agg(F.array_sort(F.collect_set(F.struct("source", "target"))).alias("maps"))
    c = configs.join(root_dirs(configs, paths).withColumnRenamed("root", "root_of"), "file").join(mapped, "file", "left")
    c = c.withColumn("maps", F.coalesce("maps", F.array().cast("array<struct<source:string,target:string>>")))
    scope, anchor, scope_links = _scoped("tsconfig")
    ns = lambda x, path: F.concat(F.array(F.lit(x)), components(path))
    name = lambda k, x: F.concat(F.lit(f"tsconfig.{k}:"), x)
    base = F.array(
        _chain("tsconfig.pkg_def", "pop", anchor, _one(PACKAGE)), _chain("tsconfig.root_dir.ref", "push", anchor, ns(MODULE, F.col("root_of"))),
        _chain("tsconfig.base_url.def", "pop", anchor, _one(NON_RELATIVE)), _chain("tsconfig.base_url.ref", "push", anchor, ns(MODULE, F.col("base_url"))),
    )
    roots = F.flatten(F.transform(F.array_distinct("root_dirs"), lambda x: F.array(_chain(name("root_dirs.def", x), "pop", anchor, _one(RELATIVE)), _chain(name("root_dirs.ref", x), "push", anchor, ns(MODULE, x)))))
    sources = F.transform(F.array_distinct(F.transform("maps", lambda m: m["source"])), lambda x: _chain(name("paths.from", x), "pop", anchor, ns(NON_RELATIVE, x)))
    to = lambda m: F.concat(F.lit("tsconfig.paths.to:"), m["source"], F.lit(" "), m["target"])
    targets = F.transform("maps", lambda m: _chain(to(m), "push", anchor, ns(MODULE, m["target"])))
    links = [
        scope_links, F.array(_link("tsconfig.pkg_def", "tsconfig.root_dir.ref"), _link("tsconfig.base_url.def", "tsconfig.base_url.ref")),
        F.transform(F.array_distinct("root_dirs"), lambda x: _link(name("root_dirs.def", x), name("root_dirs.ref", x))), F.transform("maps", lambda m: _link(name("paths.from", m["source"]), to(m))),
    ]
    return graph_of(_made(c, [scope, base, roots, sources, targets], links))


def merged(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    return tuple(reduce(lambda a, b: a.unionByName(b), parts) for parts in zip(*graphs))


__all__ = ["components", "configurations", "glob_regex", "graph_of", "input_files", "merged", "module_chain", "npm_packages", "npm_packages_namespaced", "path_mappings", "project_configurations", "root_dirs"]
