"""Small graphs for tests, in the notation `1 reference x; 2 push_symbol .`, with their expected answers."""

import re

from pyspark.sql import SparkSession

from scopeloom.schema import EDGES_DDL, NODES_DDL, nid, node_row, singletons

SHORT = {"definition": ("pop_symbol", True), "reference": ("push_symbol", True), "internal_scope": ("scope", False), "exported_scope": ("scope", True)}


def frames(spark: SparkSession, nodes: dict[str, str], edges: str):
    rows = singletons()
    for file, text in nodes.items():
        for part in text.split(";"):
            m = re.fullmatch(r"\s*(\d+) (\w+)(?: (\S+))?(?: scope=(\d+))?\s*", part)
            kind, flag = SHORT.get(m[2], (m[2], False))
            rows.append(node_row(file, int(m[1]), kind, m[3], m[4] and nid(file, int(m[4])), flag, len(rows)))
    made = []
    for part in edges.split(";"):
        m = re.fullmatch(r"\s*(\S+)→(\S+)(?: \(precedence (\d+)\))?\s*", part)
        a, b = ({"root": "[root]", "jump": "[jump]"}.get(x, x) for x in (m[1], m[2]))
        made.append((a, b, int(m[3] or 0), len(made), []))
    return spark.createDataFrame(rows, NODES_DDL), spark.createDataFrame(made, EDGES_DDL)


def read(spark: SparkSession, path: str, name: str):
    """A graph of the fixtures document."""
    text = open(path, encoding="utf-8").read()
    part = re.search(rf"### `{name}`.*?\n\n(.*?)\n\n", text, re.S)[1]
    nodes = {m[1]: m[2].replace("`", "") for m in re.finditer(r"- nodes `(.*?)`: (.*)", part)}
    return frames(spark, nodes, re.search(r"- edges: (.*)", part)[1])


def golden(path: str, title: str) -> set[str]:
    text = open(path, encoding="utf-8").read()
    return set(re.search(rf"\*\*{title}\*\*.*?```\n(.*?)\n```", text, re.S)[1].split("\n"))
