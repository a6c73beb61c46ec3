"""The operators against brute-force versions on small tables with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from scopeloom.llm import decontam, embed_codes, katz_lm, line_dedup, mixing, repeats, sharding, simhash_vp, toxicity, url_graph

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long"


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 90))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [t + " " + passage for t in texts[:8]] + [passage + "\n" + t for t in texts[8:14]] + texts[:5] * 3
    texts += ["a" * 700, "", None, "A b", "x", "word " * 5000, texts[3][:-4] + "Zz", texts[3].upper(), "ab" * 300]
    return [(i, t, "en", ("s0", "s1", "s2", None)[min(3, i % 7)], len(t or ""), 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repeats(docs, empty):
    seen, want = set(), {}
    for i, t, *_ in corpus():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    for size, frequent in ((6_000_000, None), (3_000, None), (3_000, 1)):
        got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(docs, block_bytes=size, frequent=frequent).collect()}
        assert got == want
    assert repeats.remove_repeats(empty).collect() == []


def test_long_texts_are_cut_with_overlap(monkeypatch):
    texts = [bytes(random.Random(3).choices(b"abcd", k=5000)), b"x" * 99, b"y" * 100]
    starts = [(k, at + j) for raw, where in repeats.pieces(texts, 100, 700) for k, at, off, n in where for j in range(n)]
    assert sorted(starts) == [(0, j) for j in range(4901)] + [(2, 0)]
    for raw, where in repeats.pieces(texts, 100, 700):
        for k, at, off, n in where:
            assert raw[off : off + n + 99] == texts[k][at : at + n + 99]


def test_repeats_in_long_and_periodic_texts(spark):
    """Texts above a chunk, with far repeats, periods and equal phrases in differing surroundings, against brute force."""
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    far = long[:700_000] + long[100_000:250_000] + "é" * 400 + long[650_000:900_000]
    rows = [(5, far), (3, long[200_000:260_000]), (None, long[:300]), (7, "abc" * 500), (7, "abc" * 500), (9, "z" * 99), (2, "cab" * 200 + long[:150]), (8, None)]
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = hash(b[s : s + 100])
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[np.frombuffer(bytes(gone), np.uint8) == 0])
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for size, frequent in ((6_000_000, None), (100_000, 2)):
        got = [tuple(r) for r in repeats.remove_repeats(table, block_bytes=size, frequent=frequent).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_suffix_ranks_are_the_suffix_arrays():
    text = bytes(random.Random(4).choices(b"ab", k=600))
    at = np.arange(500)
    for depth in (5, 8, 20, 100):
        names = sorted({text[i : i + depth] for i in at})
        assert repeats.suffix_ranks(text, at, depth).tolist() == [names.index(text[i : i + depth]) for i in at]


def test_simhash(docs, empty):
    def print_of(t):
        w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0

    rows = [(i, print_of(t)) for i, t, *_ in corpus()]
    label = {i: i for i, _ in rows}
    while True:
        new = {i: min(label[j] for j, g in rows if (f ^ g).bit_count() <= 3) for i, f in rows}
        new = {i: min(new[i], label[new[i]]) for i in new}
        if new == label:
            break
        label = new
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash_vp.simhash_components(docs).collect()}
    assert got == {i: (f, label[i]) for i, f in rows}
    assert simhash_vp.simhash_components(empty).collect() == []


def test_vantage_trees_find_every_pair():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    x = np.unique(np.r_[x, x[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))])
    want = {(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3).tolist()}
    assert {(a, b) for p, q in simhash_vp.near_pairs(x, x, 3, leaf=8) for a, b in zip(p.tolist(), q.tolist())} == want
    tree = simhash_vp.Tree(x[:500], 5)
    i, leaf = tree.visits(x, 3)
    visited, home = set(zip(i.tolist(), leaf.tolist())), tree.home(x)
    assert all((a, home[b]) in visited for a, b in want)


def test_decontamination(spark, docs, empty):
    text = dict((r[0], r[1]) for r in corpus())
    items = [(1, " ".join(text[2].split()[:25])), (2, "ab"), (3, None), (4, "..."), (5, "x"), (2, "ab"), (None, text[9]), (7, " ".join(text[60].split()[-30:]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
    want = {}
    for i, t in text.items():
        w, hit, ids = cut(t), set(), set()
        for item, it in set(items):
            iw = cut(it)
            n = min(10, len(iw))
            wins = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)} if n else set()
            at = [s for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in wins] if n else []
            hit |= {s + k for s in at for k in range(n)}
            if at and item is not None:
                ids.add(str(item))
        want[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    assert {r[0]: tuple(r)[1:] for r in decontam.contamination(docs, bench).collect()} == want
    assert decontam.contamination(empty, bench).collect() == []
    assert not any(r.contaminated for r in decontam.contamination(docs, bench.limit(0)).collect())


def test_sharding(docs, empty):
    rows = sharding.shard_by_bytes(docs, n_shards=6).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [i for i, *_ in corpus()]
    assert all(r.size == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode()) for r, (_, t, *_) in zip(rows, corpus()))
    shards = [r.shard for r in rows]
    assert shards == sorted(shards)
    for s in set(shards):
        assert [r.slot for r in rows if r.shard == s] == list(range(shards.count(s)))
    total, at = sum(r.size for r in rows), 0
    for r in rows:
        assert r.shard == min(5, int((at + r.size / 2) * 6 / total))
        at += r.size
    assert sharding.shard_by_bytes(empty).collect() == []


def brute_katz(train, order):
    """p(word, history) of a Katz model, from dictionaries of counts."""
    grams = [None, Counter(w for d in train for w in d)]
    for k in range(2, order + 1):
        grams.append(Counter(tuple(x[i : i + k]) for d in train for x in [[0, *d]] for i in range(len(x) - k + 1)))
    n = sum(grams[1].values())
    disc = [None, *(katz_lm.discounts(np.bincount(np.minimum(list(c.values()), 7), minlength=8)[:8]) for c in grams[1:])]
    taken = lambda k, r: (disc[k][r] if r <= 5 else 1.0) * r
    mass = sum(taken(1, r) for r in grams[1].values()) / n
    rest = max(1 - mass, 0.5 / n)
    after = {}
    for k in range(2, order + 1):
        for g, r in grams[k].items():
            after.setdefault(g[:-1], {})[g[-1]] = r

    def p(w, h):
        if not h:
            return (1 - rest) / mass * taken(1, grams[1][w]) / n if grams[1][w] else rest
        if h not in after:
            return p(w, h[1:])
        k = len(h) + 1
        count, used = sum(after[h].values()), sum(taken(k, r) for r in after[h].values())
        total = count if count - used > 1e-9 else count + 0.5
        if w in after[h]:
            return taken(k, after[h][w]) / total
        return (1 - used / total) / (1 - sum(p(x, h[1:]) for x in after[h])) * p(w, h[1:])

    return p, grams[1], n, after


@pytest.mark.parametrize("order, sizes", [(2, {}), (3, {}), (3, {"block_bytes": 4_000, "partition_bytes": 9_000, "split": 20}), (4, {"block_bytes": 9_000, "split": 7})])
def test_katz_is_normalised_and_right(docs, empty, order, sizes):
    def words(t):
        return [*(t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split(), 1]

    train = [words(t) for i, t, *_ in corpus() if not katz_lm.held_out(i)]
    p, one, n, after = brute_katz(train, order)
    for h in [(), (0,), *list(after)[:3], *[h for h in after if len(h) == order - 1][:3]]:
        assert sum(p(w, h) for w in one) + p(b"\0never", h) == pytest.approx(1)
    known = {}
    got = {r.doc_id: r for r in katz_lm.score_corpus(docs, order, **sizes).collect()}
    for i, t, *_ in corpus():
        w = words(t)
        x, r = [0, *w], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(one[v] > 0 for v in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((one[v] + 1) / (n + len(one) + 1)) for v in w))
        want = 0.0
        for k in range(1, len(x)):
            key = x[k], tuple(x[max(0, k - order + 1) : k])
            if key not in known:
                known[key] = math.log10(p(*key))
            want += known[key]
        assert r.score == pytest.approx(want)
    assert katz_lm.score_corpus(empty, order).collect() == []


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 24))
    near = base[:90] + 0.05 * rng.standard_normal((90, 24))
    rows = [[float(a) for a in x] for x in np.r_[base, near, base[:20], base[:10] * 3]] + [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    table = spark.createDataFrame([(i, x, 0) for i, x in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    fine = {i: np.array(x, np.float32).astype(float) for i, x in enumerate(rows) if x and all(a is not None and math.isfinite(a) for a in x) and any(x)}
    links = {i: {j for j, y in fine.items() if j != i and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95} for i, x in fine.items()}
    got = {r.vec_id: r for r in embed_codes.near_embeddings(table, cell_rows=60, block_rows=40).collect()}
    assert len(got) == len(rows)
    found, real = sum(got[i].n_links for i in fine), sum(map(len, links.values()))
    assert 0.95 * real <= found <= real and all(got[i].n_links <= len(links[i]) for i in fine)
    whole = {r.vec_id: r for r in embed_codes.near_embeddings(table).collect()}
    for i in range(len(rows)):
        reach, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in links.get(k, ()) if j not in reach and not reach.add(j)]
        assert (whole[i].n_links, whole[i].component_id, whole[i].kept) == (len(links.get(i, ())), min(reach), min(reach) == i)
    assert embed_codes.near_embeddings(table.limit(0)).collect() == []


def test_toxicity(spark, empty):
    rng = random.Random(2)
    mild = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(200)]
    bad = ["grumbol", "snarfing", "vexolent"]
    rows, labels = [(900, None, None), (901, "", None)], []
    for i in range(400):
        w = [rng.choice(mild) for _ in range(60)]
        if i % 4 == 0:
            for b in bad:
                w.insert(rng.randrange(60), b)
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(i % 4 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, extra string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, known).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [i for i in range(400) if got[i].held_out]
    assert {i for i in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[900].score == got[901].score
    assert toxicity.score_documents(docs, known.limit(0)).count() == 402


def test_mixing(spark, docs, empty):
    out = mixing.mix_sources(docs, target_entropy=0.99, max_repeats=3.0, block_tokens=2000).collect()
    tokens = {i: max(1, len((t or "").split())) for i, t, *_ in corpus()}
    source = {i: s for i, _, _, s, *_ in corpus()}
    assert {r.doc_id for r in out} == set(tokens) and all(r.tokens == tokens[r.doc_id] and r.source == source[r.doc_id] for r in out)
    have = Counter()
    for i, n in tokens.items():
        have[source[i]] += n
    spent, rep = Counter(), {}
    for r in out:
        spent[r.source] += r.tokens
        rep[r.source] = r.repeats
    for s in have:
        assert rep[s] <= 3.0001 and have[s] * rep[s] - 1 <= spent[s] <= have[s] * rep[s] + max(tokens.values())
    assert len({(r.block, r.slot) for r in out}) == len(out) and all(len({r.epoch for r in out if r.doc_id == i}) == sum(r.doc_id == i for r in out) for i in tokens)
    total = sum(have.values())
    w = {s: (n / total) ** out[0].exponent for s, n in have.items()}
    assert all(r.weight == pytest.approx(w[r.source] / sum(w.values())) for r in out)
    again = Counter(r.doc_id for r in mixing.repeat_documents(docs, 0.99, 3.0).collect())
    assert again == Counter(r.doc_id for r in mixing.mix_sources(docs, 0.99, 3.0).collect())
    assert mixing.mix_sources(empty).collect() == [] and mixing.repeat_documents(empty).collect() == []


def test_line_templates(spark, empty):
    rows = [(i, f"Own sentence number {chr(97 + i)} stands here alone\nUser {n} logged in from host h{i} today\n\nfooter", None) for i, n in enumerate(["ann", "bob", "cid", "dan"])] + [(9, None, "z"), (10, "", "z"), (11, "footer", "z")]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string, n long".replace("n long", "n string")), depth=1).collect()}
    for i in range(4):
        assert got[i].n_dropped in (2, 3) and "logged" not in got[i].kept_text and "footer" not in got[i].kept_text and got[i].n_lines == 4
    assert (got[9].kept_text, got[9].n_lines, got[10].kept_text, got[11].kept_text) == (None, 0, "", "")
    assert line_dedup.drop_recurring_lines(empty).collect() == []


def test_unlike_lines_stay(spark):
    rows = [(i, " ".join(f"w{chr(97 + (i * 7 + k * k) % 26)}{chr(97 + k)}{chr(97 + i)}" for k in range(12))) for i in range(20)]
    assert all(r.n_dropped == 0 for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_urls(spark):
    link = lambda *h: "".join(f'<a HREF="https://{x}/p">' for x in h)
    rows = [
        (1, "https://a.ORG/x?q#f", link("b.net", "b.net"), 0), (2, "http://b.net/q", link("c.net"), 0), (3, "http://z.com/de/1", "", 0), (4, "http://y.net/p", link("z.com"), 0),
        (5, "http://m.example.org/en/12", None, 0), (6, "http://m.example.org/fr/1", None, 0), (7, None, "x", 0), (8, "nothing", "", 0), (9, "http://xorg/a", "", 0), (10, "http://c.net", "", 0), (11, "http://a.org", "", 0),
    ]
    got = {r[0]: tuple(r)[1:] for r in url_graph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, rule int")).collect()}
    assert got == {
        1: ("a.org", "/x", "org/", "allow"), 2: ("b.net", "/q", None, "allow"), 3: ("z.com", "/de/1", "com/de/", "block"), 4: ("y.net", "/p", None, "block"), 5: ("m.example.org", "/en/12", "example.org/en/1", "block"),
        6: ("m.example.org", "/fr/1", "org/", "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("xorg", "/a", None, "allow"), 10: ("c.net", "", None, "allow"), 11: ("a.org", "", None, "allow"),
    }


def test_trust_is_personalised_pagerank(spark):
    from scopeloom.llm.common import Scratch

    m = {"a": {"b": 0.5, "c": 0.5}, "b": {"c": 1.0}, "c": {"a": 1.0}, "d": {"a": 1.0}}
    edges = spark.createDataFrame([(a, b, s) for a, r in m.items() for b, s in r.items()], "a string, b string, share double")
    got = {r.host: r.score for r in url_graph.spread(edges, spark.createDataFrame([("a", 0.75), ("d", 0.25)], "host string, seed double"), Scratch(spark, "t"), "x", rounds=60, least_change=1e-9).collect()}
    x = dict.fromkeys("abcd", 0.25)
    for _ in range(300):
        flow = {b: 0.85 * sum(x[a] * r.get(b, 0) for a, r in m.items()) for b in x}
        back = 1 - sum(flow.values())
        x = {b: flow[b] + back * {"a": 0.75, "d": 0.25}.get(b, 0) for b in x}
    assert all(got[h] == pytest.approx(x[h], abs=1e-6) for h in x)
