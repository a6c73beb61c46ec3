"""The index, the entry points, limits of searches, exchange and restarts, on the golden graphs and small tables."""

import json
import re
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scopeloom.functions import paths as pf
from scopeloom.functions import positions as pos
from scopeloom.operators import assertions, graph
from scopeloom.operators import predicates as pr
from scopeloom.operators.stacks import display
from scopeloom.plans import service
from scopeloom.plans.closure import Cancelled, Config, Stats, partial_paths, resolve_edges, resolve_paths
from scopeloom.schema import EDGES_DDL, NODES_DDL
from scopeloom.sources import exchange
from scopeloom.sources.index import FileIndex
from scopeloom.streaming import upsert

from graphs import frames, golden, read

DOC = str(Path(__file__).resolve().parents[1] / "FIXTURES.md")
NAME = "sequenced_import_star"


@pytest.fixture(scope="module")
def world(spark):
    nodes, edges = (df.cache() for df in read(spark, DOC, NAME))
    return nodes, edges, partial_paths(nodes, edges).cache()


def texts(paths, nodes):
    return {r.text for r in display(paths, nodes).select("text").collect()}


def test_limits_and_statistics_leave_the_answers(world):
    nodes, edges, paths = world
    want = golden(DOC, NAME)
    stats = Stats()
    assert texts(resolve_edges(nodes, edges, config=Config(max_work=3, stats=stats)), nodes) == want
    assert stats.initial == nodes.where("is_reference").count() and all(a <= c for _, _, c, a, _ in stats.rows())
    assert texts(resolve_paths(nodes, paths, config=Config(only_at_joins=True)), nodes) == want
    phases = []
    resolve_paths(nodes, paths, config=Config(on_phase=lambda k, df: phases.append((k, df.count())))).count()
    assert [k for k, _ in phases] == list(range(1, len(phases) + 1))


def test_cancellation(world):
    nodes, edges, _ = world
    flag = service.Flag()
    service.any_of(service.cancel_after(100), flag)()
    with pytest.raises(Cancelled):
        resolve_edges(nodes, edges, config=Config(check=service.cancel_after(-1)))
    threading.Thread(target=flag.cancel).start()
    with pytest.raises(Cancelled):
        while True:
            service.any_of(service.cancel_after(100), flag)()


def test_index_gives_back_what_was_stored(spark, world):
    nodes, edges, paths = world
    index = FileIndex.temporary(spark)
    files = nodes.where("file is not null").select("file").distinct()
    graphs = files.select("file", F.lit("t").alias("tag"), F.lit(None).cast("string").alias("error"))
    index.store(graphs, nodes.where("file is not null"), edges, paths)
    back, back_edges = index.graph()
    assert {r.nid for r in back.collect()} == {r.nid for r in nodes.collect()}
    assert {(r.source, r.sink) for r in back_edges.collect()} == {(r.source, r.sink) for r in edges.collect()}
    assert texts(resolve_paths(back, index.paths()), back) == golden(DOC, NAME)
    one = files.orderBy("file").first()["file"]
    assert {r.file for r in index.graph(one)[0].where("file is not null").collect()} == {one}
    starts = back.where("is_reference").select("nid")
    assert {r.start_nid for r in index.paths_for_nodes(starts).collect()} <= {r.nid for r in starts.collect()}
    wanted = paths.where("end_nid = '[root]'").select("sym_post")
    assert index.paths_for_roots(wanted).count() > 0
    index.store_errors(spark.createDataFrame([(one, "u", "broken")], "file string, tag string, error string"))
    with pytest.raises(ValueError, match="broken"):
        index.graph(one)
    asked = spark.createDataFrame([(one, None), (one, "t"), ("none", None)], "file string, tag string")
    assert {(r.file, r.tag): r.status for r in index.status(asked).collect()} == {(one, None): "error", (one, "t"): "missing", ("none", None): "missing"}
    assert index.clean(one) == 1 and index.clean(one) == 0
    index.clear_paths()
    assert index.paths().count() == 0 and index.graphs().count() == files.count() - 1
    assert index.clean() == files.count() - 1 and index.stats().agg(F.sum("n")).first()[0] == 0
    with pytest.raises(ValueError, match="outside"):
        index.store(graphs, nodes, edges, paths.withColumn("start_nid", F.lit("elsewhere(1)")))


def test_json_and_pages(spark, world, tmp_path):
    nodes, edges, paths = world
    exchange.save(exchange.database_to_json(nodes, edges, paths), f"{tmp_path}/db")
    lines = exchange.load(spark, f"{tmp_path}/db")
    n, e, p = exchange.database_from_json(lines, NODES_DDL, EDGES_DDL)
    assert texts(p, n) == texts(paths, nodes) and e.count() == edges.count()
    file = nodes.where("file is not null").first()["file"]
    shown = exchange.database_from_json(exchange.database_to_json(nodes, edges, paths, pr.file_filter(file)), NODES_DDL, EDGES_DDL)
    assert {r.file for r in shown[0].collect()} == {file, None}
    with pytest.raises(ValueError, match="unknown node"):
        exchange.paths_from_json(exchange.paths_to_json(paths), nodes.where("file is null")).count()
    page = exchange.to_html(nodes, edges, paths, "a <b>")
    data = json.loads(re.search(r"const graph = (.*);\n", page)[1])
    assert len(data["nodes"]) == nodes.count() and "a &lt;b>" in page
    with pytest.raises(ValueError, match="over 2"):
        exchange.to_html(nodes, edges, paths, "t", most=2)


def test_shadowing_is_that_of_pairs(spark):
    import itertools
    import random

    rng = random.Random(1)
    rows = [(f"r{rng.randrange(3)}", [(s, rng.randrange(3)) for s in "".join(rng.choice("ab") for _ in range(rng.randrange(4)))]) for _ in range(40)]

    def shadowed(mine, other):
        for (s, p), (t, q) in zip(other, mine):
            if s != t:
                return False
            if p > q:
                return True
        return False

    want = sorted((k, e) for k, e in rows if not any(j == k and shadowed(e, o) for j, o in rows))
    got = graph.drop_shadowed(spark.createDataFrame(rows, "start_nid string, edges array<struct<source:string,precedence:int>>"))
    assert sorted((r[0], [tuple(e) for e in r[1]]) for r in got.collect()) == want
    assert list(itertools.islice(want, 1))


def test_assertion_syntax(spark):
    lines = ["  x() # not yet", "--- path: b.py ---", "--- global: a=1 ---", "# ---path:  c.py  --- tail", "y = éx()", "#   ^ defined: 3, 7", "    ^refers:a,b", "^ knows: z", "    ^ defines:"]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(lines)], "key string, line int, line_text string")
    parts = {r.line: r for r in assertions.fragments(df, "key").collect()}
    assert [parts[i].fragment for i in (0, 1, 2, 3, 8)] == [None, "b.py", "b.py", "c.py", "c.py"] and tuple(parts[2]["global"]) == ("a", "1")
    got = {r.line: r for r in assertions.assertions(df, "key").collect()}
    assert {k: (r.target_line, r.column, r.kind, r["values"], r.error) for k, r in got.items()} == {
        5: (4, 4, "defined", ["3", "7"], None), 6: (4, 4, "refers", ["a", "b"], None), 7: (4, 0, "knows", ["z"], "unknown kind knows"), 8: (4, 4, "defines", [], None),
    }


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    schema = "k long, version long, v string"
    make = lambda: upsert.Upsert(spark, f"{tmp_path}/table", "k", ["version"], schema, buckets=4)
    one, two = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema), spark.createDataFrame([(2, 2, "c"), (3, 1, "d"), (1, 0, "old")], schema)
    make()(one, 0)
    make()(two, 1)
    make()(two.withColumn("v", F.lit("again")).withColumn("version", F.lit(9).cast("long")), 1)
    assert {(r.k, r.v) for r in make().table().collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_index_all_reports(spark):
    files = spark.createDataFrame([("a.x", "one"), ("b.x", "bad"), ("c.y", "two")], "file string, content string")

    def analyze(rows):
        wrong = rows.where("content = 'bad'").select("file", F.lit("cannot parse").alias("error"))
        names = [r.file for r in rows.where("content <> 'bad'").collect()]
        nodes, edges = frames(spark, {n: "0 definition d; 1 reference d" for n in names}, "; ".join(f"{n}(1)→{n}(0)" for n in names) or "root→root")
        return nodes, edges, wrong

    index, language = FileIndex.temporary(spark), service.Language("x", analyze, ["x"])
    assert {(r.file, r.status, r.error) for r in service.index_all(index, files, [language]).collect()} == {("a.x", "succeeded", None), ("b.x", "failed", "cannot parse"), ("c.y", "skipped", None)}
    out = service.index_all(index, files.withColumn("content", F.when(F.col("file") == "b.x", "good").otherwise(F.col("content"))), [language])
    assert {(r.file, r.status) for r in out.collect()} == {("a.x", "skipped"), ("b.x", "succeeded"), ("c.y", "skipped")}
    said = []
    service.report(out, said.append)
    assert said[-2:] == ["2 skipped", "1 succeeded"]


def test_small_functions(spark):
    df = spark.createDataFrame([("12", "/r", "/r/a/b/n.tar.gz", "éx\U0001f1e9\U0001f1eay"), ("x", "/q", "/r/n", "")], "s string, root string, full string, t string")
    rows = df.select(pf.seconds(F.col("s")).alias("d"), pf.milliseconds(F.col("s")).alias("ms"), pf.format_path("%r-%d-%n-%e-%%", F.col("root"), F.col("full")).alias("p"), pos.grapheme_starts(F.col("t")).alias("g"), pos.at_grapheme(F.lit(2), F.col("t"), F.lit(3)).alias("at")).collect()
    assert rows[0].d.total_seconds() == 12 and rows[0].ms.total_seconds() == 0.012 and rows[1].d is None
    assert (rows[0].p, rows[1].p) == ("/r-a/b-n.tar-.gz-%", None)
    assert rows[0].g == [0, 2, 3, 5] and tuple(rows[0].at) == (2, 12, 7, 3) and rows[1].g == []
    with pytest.raises(ValueError, match="placeholder"):
        pf.format_path("%z", F.col("root"), F.col("full"))
    service.register_functions(spark, {"shout": (lambda s: s.str.upper(), "string")})
    assert spark.sql("SELECT shout('a') AS x").first().x == "A"
