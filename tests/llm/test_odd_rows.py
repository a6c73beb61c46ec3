"""One table of odd rows through every operator and stage: null and repeated ids, equal rows, empty and very long texts, ties,
and extra columns named like the operators' own."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scopeloom.llm import decontam, embed_codes, katz_lm, line_dedup, mixing, near_copies, repeats, sharding, simhash_vp, toxicity, url_graph

EXTRA = "_id _k _kept _row _part _source _tokens _text _copy k w c v s m row n n_words last cut score held_out predicted size shard slot block blob point component least fp keys text_crc32 copies h at".split()


def odd_rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(40), f"s{i % 3}") for i in range(40)]
    rows += [rows[3], rows[3], (3, text(30), "s0"), (None, text(30), None), (None, rows[5][1], None), (None, None, "∅"), (None, None, "∅"), (70, None, ""), (71, "", "s1"), (72, "", "s1"), (73, " \t\n", "s1")]
    rows += [(80, text(450_000), "s2"), (81, "x" * 300_000, "s2"), (82, "word " * 60_000, "s2")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, source string").repartition(3)
    return df.withColumns({"lang": F.lit("en"), "n_chars": F.length("text"), **{c: F.lit(f"<{c}>") for c in EXTRA}}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = odd_rows()
    items = [("a", " ".join(rows[7][1].split()[5:30])), ("b,c", None), (None, rows[9][1]), ("a", "..."), ("long", " ".join(rows[-3][1].split()[1000:1020]))]
    return spark.createDataFrame(items, "item_id string, text string")


IDS = Counter(str(r[0]) for r in odd_rows())


def ids(df, column="doc_id"):
    return Counter(str(r[0]) for r in df.select(column).collect())


def test_operators_return_each_row(odd, labels, benchmark):
    assert ids(line_dedup.drop_recurring_lines(odd)) == IDS
    assert ids(katz_lm.score_corpus(odd, block_bytes=200_000)) == IDS
    assert ids(sharding.shard_by_bytes(odd)) == IDS
    assert ids(repeats.remove_repeats(odd, block_bytes=200_000)) == IDS
    assert ids(simhash_vp.simhash_components(odd)) == IDS
    assert ids(toxicity.score_documents(odd, labels)) == IDS
    judged = {(r.doc_id, r.n_words): r for r in decontam.contamination(odd, benchmark).collect()}
    assert judged[7, 40].contaminated and judged[9, 40].contaminated and judged[9, 40].n_items == 0 and judged[80, 450_000].n_hit == 20
    mixed = mixing.mix_sources(odd)
    assert set(ids(mixed)) == set(IDS)
    assert {r.source for r in mixed.select("source").distinct().collect()} == {"s0", "s1", "s2", None, "∅", ""}


def test_very_long_texts_are_scored_whole(odd):
    words = {r.doc_id: r.n_tokens for r in katz_lm.score_corpus(odd).where("doc_id >= 80").collect()}
    assert words == {80: 450_001, 81: 2, 82: 60_001}
    kept = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.remove_repeats(odd).where("doc_id >= 80").collect()}
    assert kept[81] == (300_000, 299_999) and kept[82] == (300_000, 299_995)
    assert {r.doc_id: r.size for r in sharding.shard_by_bytes(odd).where("doc_id > 80").collect()} == {81: 300_008, 82: 300_008}


def test_stages_keep_columns_of_any_name(spark, odd, labels, benchmark, tmp_path):
    for name, df in (("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    rows = Counter(map(str, odd.collect()))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        got = out.select(*odd.columns).collect() if name != "sharding" else out.drop("size", "text_crc32", "shard", "slot").collect()
        assert out.columns[: len(odd.columns)] == odd.columns or name == "sharding", name
        if name != "sharding":
            assert set(map(str, got)) <= set(rows), name
        assert len(got) == odd.count() if name == "sharding" else got


def test_the_pipeline_against_brute_force(spark, tmp_path):
    """Each stage's decisions, one after the other, on a small corpus with all that they look for."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(500)]
    bad = ["grumbol", "snarfing", "vexolent"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, labels = [], []
    for i in range(240):
        w = text(60)
        if i % 4 == 0:
            w[::20] = bad
        rows.append((i, " ".join(w), f"s{min(3, i % 9)}"))
        labels.append((i, 1, int(i % 4 == 0)))
    passage = text(14)
    rows += [(300 + i, " ".join(text(20) + passage + text(20)), "s0") for i in range(5)]
    near = text(200)
    rows += [(400, " ".join(near), "s1"), (401, " ".join(near[:-1] + ["other"]), "s1"), (402, " ".join(near[:100] + ["other"] + near[101:]), "s2"), (400, " ".join(near), "s1"), (None, "", "s1"), (None, None, "s1")]
    tables = {"documents": spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long"), "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = Counter(r.doc_id for r in out)
    want = {i for i, t, _ in rows if i is None or not (i < 240 and i % 4 == 0 or 300 <= i < 310 or i in (401, 402))}
    assert set(left) == want
    assert {s for s, n in Counter((r.source, r.doc_id) for r in out).items() if n > 4} == set()
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in sorted({r.shard for r in out}) for k in range(sum(x.shard == s for x in out))]
    assert all(r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in out)
    ordered = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id is not None and r.doc_id for r in ordered] == sorted((r.doc_id is not None and r.doc_id for r in out), key=lambda x: -1 if x is False else x)


def test_embeddings_without_ids(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.01]), (9007199254740993, [0.0, 1.0]), (9007199254740995, [0.01, 1.0]), (None, [0.0, 1.0]), (None, None), (5, [-1.0, 0.0]), (5, [-1.0, 0.0])]
    got = embed_codes.near_embeddings(spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, point string, least int")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter({(None, 1, None, True): 2, (9007199254740993, 2, 9007199254740993, True): 1, (9007199254740995, 2, 9007199254740993, False): 1, (None, 2, 9007199254740993, False): 1, (None, 0, None, True): 1, (5, 1, 5, True): 2})


def test_recall_with_many_isolated_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    a = rng.standard_normal((6_000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((6_000, 32))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.r_[a, 0.952 * a + np.sqrt(1 - 0.952**2) * b]
    got = embed_codes.near_embeddings(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), cell_rows=200)
    assert sum(r.n_links for r in got.collect()) >= 0.999 * len(x)


def test_empty_pages(spark):
    assert url_graph.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert near_copies.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lines_of_one_document_count_once(spark):
    logged = "\n".join(f"user {n} logged in from {c} today" for n, c in (("ann", "rome"), ("bob", "oslo"), ("cid", "bonn")))
    docs = spark.createDataFrame([(1, logged, "x"), (2, logged.replace("ann", "dan"), "x")], "doc_id long, text string, extra string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.drop_recurring_lines(docs, depth=1).collect()} == {1: 0, 2: 0}
    third = spark.createDataFrame([(3, "user eve logged in from kiel today", "x")], docs.schema)
    assert {r.doc_id: r.n_dropped for r in line_dedup.drop_recurring_lines(docs.union(third), depth=1).collect()} == {1: 3, 2: 3, 3: 1}
