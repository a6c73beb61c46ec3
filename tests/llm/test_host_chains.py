"""Trust and distrust over many hops, with the defaults."""

from scopeloom.llm import url_graph


def test_distrust_reaches_the_end_of_a_chain(spark):
    """Thirty hosts, each linking to the next, the last one to a blocked host: all are distrusted."""
    hosts = [f"h{i}.net" for i in range(30)] + ["z.com"]
    rows = [(i, f"http://{a}/p", f'<a href="http://{b}/">') for i, (a, b) in enumerate(zip(hosts, hosts[1:]))] + [(30, "http://z.com/de/1", ""), (31, "http://other.net/", "")]
    got = {r.page_id: r.verdict for r in url_graph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: "block" for i in range(31)}, 31: "allow"}
