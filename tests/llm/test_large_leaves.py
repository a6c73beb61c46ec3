"""Boilerplate with fields of small vocabularies goes from large corpora as from small ones."""

import random

from scopeloom.llm import line_dedup


def test_two_fields_of_few_values_in_thousands_of_documents(spark):
    rng = random.Random(6)
    name = lambda k, s: s + "".join(chr(97 + int(c)) for c in f"{k:03d}")
    rows = [(i, f"This page was edited by {name(rng.randrange(300), 'n')} in {name(rng.randrange(200), 'c')} office") for i in range(3000)]
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(150)]
    rows += [(5000 + i, "It was the " + " ".join(rng.choice(words) for _ in range(6))) for i in range(3000)]  # prose that begins alike
    got = line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    dropped = {r.doc_id for r in got if r.n_dropped}
    assert sum(i < 3000 for i in dropped) == 3000
    assert sum(i >= 5000 for i in dropped) == 0
