"""The pipeline's near-copy stage against the Jaccard similarity of all pairs."""

import random
from pathlib import Path

import corpus_pipeline
from scopeloom.llm import mixing, near_copies
from scopeloom.llm.common import shared_dir

SCHEMA = "doc_id long, text string, source string"


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(x, y):
    return not x and not y or bool(x and y) and len(x & y) >= 0.8 * len(x | y)


def brute_kept(rows):
    """Indexes of the rows that stay: of each class, the smallest id (ids before null), then any one row."""
    sets = [shingle_set(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and alike(sets[i], sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return [[i for i in range(len(rows)) if label[i] == c] for c in sorted(set(label))]


def near_corpus(seed=5, n=40):
    """Texts of 120 to 400 words, each with copies in which some words are replaced: similarities from about 0.6 to 1."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(n):
        w = [word() for _ in range(rng.randint(120, 400))]
        texts.append(" ".join(w))
        for share in (0.004, 0.012, 0.018, 0.022, 0.04):
            c = list(w)
            for k in rng.sample(range(len(c)), max(1, int(share * len(c)))):
                c[k] = word()
            texts.append(" ".join(c))
    return texts + ["", None, "one", "ONE", "a b c"]


def test_near_copies_of_similarity_eight_tenths_go(spark):
    rows = [(i, t, "s") for i, t in enumerate(near_corpus())]
    sets = [shingle_set(t) for _, t, _ in rows]
    between = [len(x & y) / len(x | y) for i, x in enumerate(sets) for y in sets[:i] if x & y]
    assert sum(0.8 <= v < 0.9 for v in between) > 30 and sum(0.5 < v < 0.8 for v in between) > 30
    got = sorted(r.doc_id for r in near_copies.drop_near_copies(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    assert got == sorted(min(rows[i][0] for i in c) for c in brute_kept(rows))
    assert near_copies.drop_near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_row_of_each_class_stays(spark):
    a, b, c = near_corpus(n=3)[0:18:6]
    copy = b.rsplit(" ", 1)[0]  # alike, with another text
    rows = [(1, a, "s"), (1, a, "s"), (1, b, "s"), (2, copy, "s"), (None, c, "s"), (None, c, "s"), (None, a, "s"), (3, "", "s"), (None, None, "s")]
    got = near_copies.drop_near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (1, b), (0, c), (3, "")])
    assert len(got) == len(brute_kept(rows))


def test_sets_of_shingles_are_written_for_candidates_only(spark, monkeypatch):
    """Texts that meet no other leave their sketch behind, not their shingles, which take more room than the text itself."""
    rng, written, table = random.Random(1), {}, near_copies.Scratch.table

    def measured(self, df, name, *more):
        out = table(self, df, name, *more)
        written[name] = sum(f.stat().st_size for f in Path(f"{self.base}/{name}".removeprefix("file://")).rglob("*.parquet"))
        return out

    monkeypatch.setattr(near_copies.Scratch, "table", measured)
    texts = [" ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") for _ in range(2000)) for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate([*texts, texts[7] + " end", texts[8] + " end"])]
    got = sorted(r.doc_id for r in near_copies.drop_near_copies(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect())
    assert got == list(range(60))
    assert sum(size for name, size in written.items() if name != "rows") < 60 * 2000 * 8 / 3


def left_behind(spark):
    return {str(f) for f in Path(shared_dir(spark).removeprefix("file://")).glob("*/*")}


def test_texts_are_neither_shuffled_nor_kept_twice(spark):
    """Whether or not Spark would broadcast the ids of the rows that stay: rows are told apart where they lie."""
    rng = random.Random(4)
    texts = [" ".join(str(rng.random()) for _ in range(200)) for _ in range(90)]
    rows = [(i, t, "s") for i, t in enumerate([*texts, *[t + " end" for t in texts[::9]]])]
    docs, before = spark.createDataFrame(rows, SCHEMA).repartition(3), left_behind(spark)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = near_copies.drop_near_copies(docs)
        made = left_behind(spark) - before
        assert sorted(r.doc_id for r in out.collect()) == list(range(90))
        assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {Path(f).name for f in made} == {"rows", "kept"}
    names = [spark.read.parquet(f).columns for f in made if f.endswith("/rows")]
    assert names == [["_kept", "row"]]


def test_numbers_of_rows_as_bits(spark):
    """Rows of several partitions, at the ends of the strings of bits, and of numbers that none of the wanted share a string with."""
    numbers = [0, 1, 2, 8, 9, 32768, 32769, 40000, 65537, (1 << 33) - 1, 1 << 33, (1 << 33) + 1, (5 << 33) + 7, (9 << 33) + 32767]
    scratch = near_copies.Scratch(spark, "bits")
    rows = spark.createDataFrame([(n,) for n in numbers], "row long")
    for k, wanted in enumerate(([], numbers[::2], numbers[1::2], numbers, [n + 1 for n in numbers])):
        found = near_copies._numbered(rows, spark.createDataFrame([(n,) for n in [*wanted, *wanted]], "row long"), scratch, f"wanted-{k}")
        assert sorted(r.row for r in found.collect()) == sorted({*numbers} & {*wanted})


def test_mixing_leaves_no_tables_of_rows_behind(spark):
    docs, before = spark.createDataFrame([(i, f"text {i}", f"s{i % 3 % 2}") for i in range(60)], SCHEMA), left_behind(spark)
    out = mixing.repeat_documents(docs)
    assert {Path(f).name for f in left_behind(spark) - before} == {"limits"}
    assert {r.doc_id for r in out.collect()} == set(range(60))


def test_a_run_keeps_the_last_table_only(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "text", "s") for i in range(5)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, lambda _, docs, at: docs.withColumn("n", docs["doc_id"] + 1)) for name in ("one", "two stages", "three")])
    before = left_behind(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {Path(f).name for f in left_behind(spark) - before} == {"three"}
    assert sorted(r.n for r in out.collect()) == [1, 2, 3, 4, 5]
