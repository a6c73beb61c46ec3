"""The queries against their SQL on a random table with every odd row that the SQL defines."""

import math
import random

import duckdb
import numpy as np
import pytest

from scopeloom.llm import queries

NAMES = ["op1_line_template_dedup", "op2_katz_backoff", "op3_byte_prefix_shards", "op4_prefix_free_repeats", "op6_host_trust", "op9_temperature_mixing"]


def rows():
    rng = random.Random(23)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
    fields = ["ann", "bob", "cid", "dan", "eve"]
    template = lambda: f"page {rng.choice(fields)} was edited by {rng.choice(fields)} on {rng.randint(1, 99)} of may"
    docs = []
    for i in range(120):
        parts = [line() for _ in range(rng.randint(1, 8))] + [template() for _ in range(rng.randint(0, 3))] + ["the footer line"] * rng.randint(0, 2)
        rng.shuffle(parts)
        docs.append((i, "\n".join(parts), rng.choice(["a", "a", "a", "b", "c", None])))
    docs += [(200, None, "a"), (201, "", "b"), (202, " \t x1 \r\n\n y ", None), (203, docs[4][1], "a"), (204, docs[4][1] + "\n" + docs[5][1], "c")]
    hosts = [f"h{i}.net" for i in range(12)] + ["a.org", "b.com", "m.example.org"]
    pages = []
    for i in range(80):
        links = "".join(f'<A href="https://{rng.choice(hosts)}/x">' for _ in range(rng.randint(0, 4)))
        pages.append((i, f"http://{rng.choice(hosts)}{rng.choice(['/de/1', '/fr/', '/en/12', '/es/x', '', '/q?a'])}", rng.choice([links, links, links, None])))
    return docs, pages + [(90, None, "x"), (91, "none", None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, (docs, pages) = tmp_path_factory.mktemp("tables"), rows()
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{path}/pages.parquet")
    return path


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return float(f"{float(x):.9g}") if isinstance(x, (float, np.floating)) else x.item() if isinstance(x, np.generic) else x


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, folder, name):
    got = queries.QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want
    if name == "op6_host_trust":
        assert {"allow", "block"} <= {r[columns.index("verdict")] for r in want if r[columns.index("rule")] is None}
