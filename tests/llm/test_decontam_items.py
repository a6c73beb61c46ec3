"""Items that share an id or have none."""

from scopeloom.llm import decontam


def test_items_of_one_id_and_equal_lengths_are_told_apart(spark):
    word = lambda s, n: " ".join(f"{s}{chr(97 + k)}" for k in range(n))
    items = [(None, word("p", 12)), (None, word("q", 12)), (None, word("never", 12)), (4, word("r", 9)), (4, word("s", 9)), (4, word("absent", 9))]
    docs = [(1, "x " + word("p", 12)), (2, word("q", 12) + " y"), (3, word("r", 9)), (4, "z " + word("s", 9)), (5, "nothing here at all")]
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (12, 0), 2: (12, 0), 3: (9, 1), 4: (9, 1), 5: (0, 0)}
