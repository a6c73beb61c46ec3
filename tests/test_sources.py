"""Graphs from attribute rows, assertions about places, choice of files."""

import pytest
from pyspark.sql import functions as F

from scopeloom.functions import selection
from scopeloom.operators import places
from scopeloom.sources import builder

ROWS = "file string, local_id int, attributes map<string,string>"


def test_builder(spark):
    rows = [("a", 0, {"is_endpoint": "true"}), ("a", 1, {"type": "push_scoped_symbol", "symbol": "x", "scope": "0", "is_reference": "true", "debug_b": "2", "debug_a": "1"}), ("a", 2, {"type": "push_scoped_symbol", "symbol": "y", "scope": "1", "is_exported": "true"}), ("a", 3, {})]
    df = spark.createDataFrame(rows, ROWS)
    nodes = builder.nodes_from_attributes(df)
    got = {r.local_id: r for r in nodes.collect()}
    assert [got[k].kind for k in range(4)] == ["scope", "push_scoped_symbol", "push_scoped_symbol", "scope"]
    assert got[0].is_exported and got[1].is_reference and not got[2].is_exported and not got[3].is_exported
    assert got[1].scope == "a(0)" and [tuple(d) for d in got[1].debug_info] == [("a", "1"), ("b", "2")]
    assert [r.nid for r in builder.wrong_scopes(nodes).collect()] == ["a(2)"]
    assert [tuple(r) for r in builder.unexpected_attributes(df).collect()] == [("a", 2, "is_exported")]
    edges = spark.createDataFrame([("a(0)", "a(1)", {"precedence": "3"}), ("a(0)", "a(2)", {})], "source string, sink string, attributes map<string,string>")
    assert sorted(r.precedence for r in builder.edges_from_attributes(edges).collect()) == [0, 3]


@pytest.mark.parametrize("attributes", [{"type": "thing"}, {"type": "pop_symbol"}])
def test_builder_refuses(spark, attributes):
    with pytest.raises(Exception, match="unknown node type|no symbol"):
        builder.nodes_from_attributes(spark.createDataFrame([("a", 0, attributes)], ROWS)).collect()


def test_assert_defined(spark):
    span = lambda line: ((line, 0), (line, 5))
    ddl = "nid string, file string, is_reference boolean, is_definition boolean, span struct<start:struct<line:int,utf8:int>,end:struct<line:int,utf8:int>>"
    nodes = spark.createDataFrame([("r", "a", True, False, span(0)), ("d1", "a", False, True, span(3)), ("d2", "a", False, True, span(4))], ddl)
    found = spark.createDataFrame([("r", "d1"), ("r", "d2")], "start_nid string, end_nid string")
    at = spark.createDataFrame([("p", "a", 0, 1), ("q", "a", 9, 1), ("end", "a", 0, 5)], "place string, file string, line int, column int")
    targets = spark.createDataFrame([("p", "a", 3), ("p", "a", 7)], "place string, file string, line int")
    got = {tuple(r) for r in places.assert_defined(found, nodes, at, targets).collect()}
    assert got == {("p", 7, "missing"), ("p", 4, "unexpected"), ("q", None, "no references"), ("end", None, "no references")}
    assert places.nodes_at(nodes, at, inclusive=True).where("place = 'end'").count() == 1


def test_selection(spark):
    names = ["a/b/c.py", "a/b.py", "a-b/c.py", "x.py", "a/skip/d.py", "a/e.txt"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    of = lambda d: {r.p for r in d.collect()}
    assert of(selection.input_files(df, "p", ["x.py"], ["a/**"], ["**/skip/*"], ["py"])) == {"x.py", "a/b/c.py", "a/b.py"}
    assert [r.p for r in df.orderBy(selection.walk_key(F.col("p"))).collect()] == ["a/b/c.py", "a/b.py", "a/e.txt", "a/skip/d.py", "a-b/c.py", "x.py"]
    assert of(selection.resume(df, "p", "a/e.txt")) == {"a/e.txt", "a/skip/d.py", "a-b/c.py", "x.py"}
    assert of(selection.resume(df, "p", "none")) == set()
