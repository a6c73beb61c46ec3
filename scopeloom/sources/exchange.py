"""JSON import and export of graphs, paths and databases, manifests' dependencies, and an HTML page of a graph."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.predicates import Filter
from ..schema import PATHS_DDL


def _lines(df: DataFrame, what: str) -> DataFrame:
    return df.select(F.lit(what).alias("what"), F.to_json(F.struct(*df.columns)).alias("json"))


def _rows(lines: DataFrame, what: str, ddl: str) -> DataFrame:
    return lines.where(F.col("what") == what).select(F.from_json("json", ddl).alias("r")).select("r.*")


def _known(ends: DataFrame, nodes: DataFrame, what: str) -> None:
    lost = ends.distinct().join(nodes.select("nid"), "nid", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"{what} to unknown node {lost[0][0]}")


def graph_to_json(nodes: DataFrame, edges: DataFrame, shown: Filter | None = None) -> DataFrame:
    """One JSON line per node and edge; nulls are left out. ``shown`` limits what is written, and what needs it."""
    if shown is not None:
        none = nodes.sparkSession.createDataFrame([], PATHS_DDL)
        nodes, edges, _ = shown.apply(nodes, edges, none)
    return _lines(nodes, "node").unionByName(_lines(edges, "edge"))


def graph_from_json(lines: DataFrame, nodes_ddl: str, edges_ddl: str) -> tuple[DataFrame, DataFrame]:
    """The tables back; an edge with an unknown end is an error."""
    n, e = _rows(lines, "node", nodes_ddl), _rows(lines, "edge", edges_ddl)
    _known(e.select(F.col("source").alias("nid")).union(e.select("sink")), n, "edge")
    return n, e


def paths_to_json(paths: DataFrame) -> DataFrame:
    return _lines(paths, "path")


def paths_from_json(lines: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Paths back; with the nodes that there are, a path that starts, ends or goes elsewhere is an error."""
    p = _rows(lines, "path", PATHS_DDL)
    if nodes is not None:
        _known(p.select(F.explode(F.concat(F.array("start_nid", "end_nid"), "edges.source")).alias("nid")), nodes, "path")
    return p


def database_to_json(nodes: DataFrame, edges: DataFrame, paths: DataFrame, shown: Filter | None = None) -> DataFrame:
    """A graph and its stored paths, as far as they are shown."""
    if shown is not None:
        nodes, edges, paths = shown.apply(nodes, edges, paths)
    return graph_to_json(nodes, edges).unionByName(paths_to_json(paths))


def database_from_json(lines: DataFrame, nodes_ddl: str, edges_ddl: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = graph_from_json(lines, nodes_ddl, edges_ddl)
    return nodes, edges, paths_from_json(lines, nodes)


def save(lines: DataFrame, folder: str) -> None:
    """JSON lines as text files."""
    lines.select(F.to_json(F.struct("what", "json")).alias("value")).write.mode("overwrite").text(folder)


def load(spark, folder: str) -> DataFrame:
    return spark.read.text(folder).select(F.from_json("value", "what string, json string").alias("r")).select("r.*")


def dependencies(manifests: DataFrame, key: str, content: str) -> DataFrame:
    """(key, name, main, dependency) of package manifests; without dependencies one row with null."""
    parsed = manifests.select(key, F.from_json(content, "name string, main string, dependencies map<string,string>").alias("m"))
    return parsed.select(key, "m.name", "m.main", F.explode_outer(F.map_keys("m.dependencies")).alias("dependency"))


_SCRIPT = """const byId = id => document.getElementById(id);
const ends = e => [e.source, e.sink];
const text = n => n.nid + ' ' + n.kind + (n.symbol ? ' ' + n.symbol : '');
const fill = (id, rows) => { byId(id).replaceChildren(...rows.map(([t, on]) => { const r = document.createElement('li'); r.textContent = t; r.onclick = on; return r; })); };
const show = nid => {
  byId('at').textContent = nid || 'all';
  fill('nodes', graph.nodes.filter(n => !nid || n.nid === nid).map(n => [text(n), () => show(n.nid)]));
  fill('edges', graph.edges.filter(e => !nid || ends(e).includes(nid)).map(e => [ends(e).join(' \\u2192 ') + (e.precedence ? ' (' + e.precedence + ')' : ''), () => show(e.source === nid ? e.sink : e.source)]));
  fill('paths', graph.paths.filter(p => !nid || [p.start_nid, p.end_nid].includes(nid)).map(p => [p.start_nid + ' \\u21d2 ' + p.end_nid, () => show(p.start_nid === nid ? p.end_nid : p.start_nid)]));
};
byId('all').onclick = () => show(null);
byId('find').oninput = e => { const q = e.target.value; fill('nodes', graph.nodes.filter(n => text(n).includes(q)).map(n => [text(n), () => show(n.nid)])); };
show(null);"""


def to_html(nodes: DataFrame, edges: DataFrame, paths: DataFrame, title: str, most: int = 5000, shown: Filter | None = None) -> str:
    """A page of a small graph, to be walked by clicking nodes, edges and paths; over ``most`` rows of any it is an error."""
    if shown is not None:
        nodes, edges, paths = shown.apply(nodes, edges, paths)
    data = {}
    for name, df in (("nodes", nodes), ("edges", edges), ("paths", paths)):
        rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"over {most} {name} to show")
        data[name] = rows
    body = json.dumps(data).replace("</", "<\\/")
    lists = "".join(f"<section><h2>{n}</h2><ul id='{n}'></ul></section>" for n in data)
    safe = title.replace("&", "&amp;").replace("<", "&lt;")
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{safe}</title><h1>{safe}: <span id='at'></span></h1><button id='all'>all</button><input id='find' placeholder='find a node'>{lists}<script>const graph = {body};\n{_SCRIPT}</script>"
