"""Graphs from attribute rows: what a front-end states of nodes and edges, checked and made into the tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import positions as pos
from ..plans.adapters import node_id, with_singletons
from ..schema import JUMP, KINDS, NODES_DDL, ROOT, SPAN

MADE = [k for k in KINDS if k not in ("root", "jump_to")]
#: Attributes with an effect, by kind of node; those that name the place in the source fit every kind.
PLACE = ["type", "source_node", "empty_source_span", "definiens_node", "syntax_type"]
EFFECT = {"scope": ["is_exported", "is_endpoint"], "drop_scopes": [], "pop": ["symbol", "is_definition"], "push": ["symbol", "is_reference", "scope"]}


def _attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def _flag(*names: str) -> Column:
    return F.coalesce(*[F.when(_attribute(n) == "true", True) for n in names], F.lit(False))


def _kind() -> Column:
    kind = F.coalesce(_attribute("type"), F.lit("scope"))
    return F.when(kind.isin(*MADE), kind).otherwise(F.raise_error(F.concat(F.lit("unknown node type "), kind)).cast("string"))


def _debug() -> Column:
    entries = F.map_entries(F.map_filter("attributes", lambda k, v: F.startswith(k, F.lit("debug_"))))
    return F.array_sort(F.transform(entries, lambda e: F.struct(F.substring(e["key"], 7, 1 << 20).alias("key"), e["value"].alias("value"))))


def nodes_from_attributes(rows: DataFrame) -> DataFrame:
    """Nodes from (file, local_id, attributes map<string,string>).

    No type: a scope. An unknown type, or a push or pop without symbol, is an error. A flag counts on the kinds that have it.
    ``debug_*`` attributes become debug information without their prefix. ``scope`` is a local id of the same file.
    """
    n = rows.withColumn("kind", _kind())
    stack = F.col("kind").rlike("^(push|pop)_")
    symbol = F.when(stack, F.coalesce(_attribute("symbol"), F.raise_error(F.concat(F.lit("no symbol on node "), node_id(F.col("file"), F.col("local_id")))).cast("string")))
    return n.select(
        node_id(F.col("file"), F.col("local_id")).alias("nid"), "file", F.col("local_id").cast("int").alias("local_id"), "kind", symbol.alias("symbol"),
        F.when(F.col("kind") == "push_scoped_symbol", node_id(F.col("file"), _attribute("scope"))).alias("scope"),
        (F.startswith("kind", F.lit("pop")) & _flag("is_definition")).alias("is_definition"), (F.startswith("kind", F.lit("push")) & _flag("is_reference")).alias("is_reference"),
        ((F.col("kind") == "scope") & _flag("is_exported", "is_endpoint")).alias("is_exported"), F.col("local_id").cast("bigint").alias("ord"), _attribute("syntax_type").alias("syntax_type"), _debug().alias("debug_info"),
    )


def edges_from_attributes(rows: DataFrame) -> DataFrame:
    """Edges from (source, sink, attributes): precedence 0 unless given."""
    return rows.select("source", "sink", F.coalesce(_attribute("precedence").cast("int"), F.lit(0)).alias("precedence"), F.lit(0).cast("bigint").alias("ord"), _debug().alias("debug_info"))


def wrong_scopes(nodes: DataFrame) -> DataFrame:
    """Push-scoped nodes whose attached scope is no exported scope; a graph with any is refused."""
    exported = nodes.where("is_exported").select(F.col("nid").alias("scope"))
    return nodes.where("kind = 'push_scoped_symbol'").join(exported, "scope", "left_anti").select("nid", "scope")


def unexpected_attributes(rows: DataFrame) -> DataFrame:
    """(file, local_id, attribute) of attributes that say nothing on a node of this kind; for warnings."""
    kind = F.regexp_extract(F.coalesce(_attribute("type"), F.lit("scope")), "^(scope|drop_scopes|push|pop)", 1)
    known = F.create_map(*[x for k, v in EFFECT.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in [*PLACE, *v]]))])
    names = F.filter(F.map_keys("attributes"), lambda k: ~F.startswith(k, F.lit("debug_")))
    return rows.select("file", "local_id", F.explode(F.array_except(names, F.try_element_at(known, kind))).alias("attribute"))


# ---- where nodes come from

_PLACE = r"^(\d+):(\d+)-(\d+):(\d+)$"


def _places(rows: DataFrame, attribute: str) -> DataFrame:
    """(file, local_id, place) of rows whose attribute names a piece of the source, ``line:column-line:column`` in bytes from 0.
    ``#null`` and no attribute mean none; anything else is an error."""
    text = _attribute(attribute)
    said = rows.where(text.isNotNull() & (text != "#null"))
    part = lambda k: F.regexp_extract(text, _PLACE, k).cast("int")
    good = F.when(text.rlike(_PLACE), part(1)).otherwise(F.raise_error(F.concat(F.lit("not a place in the source: "), text)).cast("int"))
    return said.select("file", "local_id", "attributes", good.alias("start_line"), part(2).alias("start_column"), part(3).alias("end_line"), part(4).alias("end_column"))


def source_info(nodes: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``nodes`` with span, containing line and, for definitions, the span of what they define, from the attributes ``source_node``
    and ``definiens_node`` of ``rows`` and the texts of ``sources`` (file, text). ``empty_source_span`` ends a span where it
    starts."""
    own = pos.node_spans(_places(rows, "source_node"), sources, "file")
    end = F.when(_flag("empty_source_span"), F.col("span.start")).otherwise(F.col("span.end"))
    own = own.select("file", "local_id", F.struct(F.col("span.start").alias("start"), end.alias("end")).cast(SPAN).alias("new_span"), F.col("containing_line").alias("new_line"))
    body = pos.node_spans(_places(rows, "definiens_node"), sources, "file").select("file", "local_id", F.col("span").cast(SPAN).alias("new_body"))
    out = nodes
    for c, kind in (("span", SPAN), ("containing_line", "string"), ("definiens_span", SPAN)):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    out = out.join(own, ["file", "local_id"], "left").join(body, ["file", "local_id"], "left")
    new = {"span": F.coalesce("new_span", "span"), "containing_line": F.coalesce("new_line", "containing_line"), "definiens_span": F.when(F.col("is_definition"), F.coalesce("new_body", "definiens_span"))}
    return out.withColumns(new).drop("new_span", "new_line", "new_body")


def inject(rows: DataFrame, injected: DataFrame) -> DataFrame:
    """Edges' ends by name: ``rows`` (file, source, sink, attributes) name nodes by local id or by an injected name (file, name,
    nid); the root and the jump node are injected everywhere, as ROOT_NODE and JUMP_TO_SCOPE_NODE."""
    fixed = rows.select("file").distinct().withColumn("x", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("nid")) for n, i in (("ROOT_NODE", ROOT), ("JUMP_TO_SCOPE_NODE", JUMP))]))).select("file", "x.*")
    names = injected.select("file", "name", "nid").unionByName(fixed)
    out = rows
    for end in ("source", "sink"):
        known = names.select("file", F.col("name").alias(end), F.col("nid").alias(f"{end}_nid"))
        out = out.join(known, ["file", end], "left").withColumn(end, F.coalesce(f"{end}_nid", node_id(F.col("file"), F.col(end)))).drop(f"{end}_nid")
    return out


def build(nodes: DataFrame, edges: DataFrame, sources: DataFrame, injected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A graph from what a front-end states: nodes (file, local_id, attributes), edges (file, source, sink, attributes), texts
    (file, text). Attached scopes that aren't exported are an error."""
    spark = nodes.sparkSession
    made = source_info(nodes_from_attributes(nodes), nodes, sources)
    schema = spark.createDataFrame([], NODES_DDL).schema
    made = made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    wrong = wrong_scopes(made).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['nid']}: {wrong[0]['scope']} is no exported scope")
    injected = injected if injected is not None else spark.createDataFrame([], "file string, name string, nid string")
    return with_singletons(spark, made), edges_from_attributes(inject(edges, injected))
