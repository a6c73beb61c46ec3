"""Katz backoff language model of any order: Good-Turing discounted counts, exactly normalised backoff weights, tables by
partition, evaluated recursively per token."""

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import QUESTION, answer, ask, deal, mix64, pack, questions, to_batches, unpack, with_replies
from .common import Scratch, ship, shuffle_partitions

ship(__name__)

_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CUT = 5  # counts up to this one are discounted
_BLOCK = pa.schema([("block", pa.int64()), ("part", pa.string()), ("blob", pa.binary())])


def held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == fold if doc_id is not None else False


def encode_blocks(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, n_parts: int, block_bytes: int = 6_000_000) -> DataFrame:
    """The corpus as blocks of local word numbers; the texts are read and split once. Words are numbered in the order in which
    they are dealt, so that later steps need only the bounds of the partitions, not the words' hashes (a part of their own)."""

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        def close(ids, codes, lengths, words, number):
            names = [b"\x00<s>", b"\x00</s>", *words]
            hashes = np.array([xxhash.xxh64_intdigest(w, 7) for w in names], np.uint64)
            train = np.array([not held_out(i) for i in ids])
            order, bounds = deal(hashes, n_parts)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            code = rank[np.array(codes, np.uint32)]
            counts = np.bincount(code[np.repeat(train, lengths)], minlength=len(names)).astype(np.int64)
            counts[rank[0]] = train.sum()
            blob = pack({"ids": np.array([-1 if i is None else i for i in ids], np.int64), "null": np.array([i is None for i in ids]), "code": code, "len": np.array(lengths, np.int64), "train": train, "bos": int(rank[0]), "bounds": bounds})
            block = (TaskContext.get().partitionId() << 32) + number
            return [(block, "words", pack((hashes[order], counts))), (block, "text", blob)]

        ids, codes, lengths, words, size, number = [], [], [], {}, 0, 0

        def rows():
            nonlocal ids, codes, lengths, words, size, number
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    tokens = (t.as_py() or "").encode("utf-8", "replace").translate(_LOW).split()
                    codes += [words.setdefault(w, len(words) + 2) for w in tokens]
                    codes.append(1)
                    ids.append(i)
                    lengths.append(len(tokens) + 1)
                    size += sum(map(len, tokens)) + len(tokens) + 8
                    if size > block_bytes:
                        yield from close(ids, codes, lengths, words, number)
                        ids, codes, lengths, words, size, number = [], [], [], {}, 0, number + 1
            if ids:
                yield from close(ids, codes, lengths, words, number)

        yield from to_batches(rows(), _BLOCK, 8_000_000)

    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return scratch.table(slim.mapInArrow(run, "block long, part string, blob binary"), "blocks", "part")


def discounts(n: np.ndarray) -> np.ndarray:
    """Factors for counts 1.._CUT from the numbers of types with count 1.._CUT+1 (Good-Turing, as Katz scales them). Where the
    counts of counts give no proper factor (small corpora), half a count is taken off each."""
    plain = np.array([1.0] + [(r - 0.5) / r for r in range(1, _CUT + 1)])
    if n[1] == 0 or (n[1 : _CUT + 2] == 0).any():
        return plain
    rest = (_CUT + 1) * n[_CUT + 1] / n[1]
    d = np.array([1.0] + [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if rest != 1 else 0 for r in range(1, _CUT + 1)])
    return d if ((d[1:] > 0) & (d[1:] < 1)).all() else plain


def _classes(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts[counts > 0], _CUT + 2), minlength=_CUT + 3)[: _CUT + 3]


def _drops(counts: np.ndarray) -> np.ndarray:
    """Counts in the order of their words' numbers as small differences: numbers are given out by falling count."""
    d = np.diff(counts, prepend=0)
    return ((d << 1) ^ (d >> 63)).astype(np.uint64)


def _undrop(d: np.ndarray) -> np.ndarray:
    return np.cumsum((d >> np.uint64(1)).astype(np.int64) ^ -(d & np.uint64(1)).astype(np.int64))


@dataclass
class Gram:
    """The distinct n-grams of one length in a block. ``history`` and ``lower`` (an n-gram without its last, or first, word) are
    indexes into the next shorter ones; ``at`` is the n-gram that ends at each token, -1 at a text's start."""

    at: np.ndarray
    history: np.ndarray | None = None
    word: np.ndarray | None = None
    lower: np.ndarray | None = None
    mine: np.ndarray | None = None  # training count in this block
    count: np.ndarray | None = None  # training count in the corpus
    number: np.ndarray | None = None
    solo: np.ndarray | None = None  # in this block only
    total: np.ndarray | None = None  # per history: what its probabilities are divided by
    alpha: np.ndarray | None = None  # per history: its backoff weight
    asked: dict = field(default_factory=dict)


def _shift(at: np.ndarray, starts: np.ndarray, first: int) -> np.ndarray:
    out = np.empty(len(at), np.int64)
    out[1:] = at[:-1]
    out[starts] = first
    return out


def _longer(b: dict, grams: list[Gram]) -> Gram:
    """The n-grams one word longer than the last of ``grams``."""
    n_words, last = int(b["bounds"][-1]), grams[-1]
    starts = np.cumsum(b["len"]) - b["len"]
    history = _shift(last.at, starts, b["bos"] if len(grams) == 1 else -1)
    have = np.flatnonzero(history >= 0)
    distinct, which = np.unique(history[have] * n_words + b["code"][have], return_inverse=True)
    at = np.full(len(history), -1)
    at[have] = which
    lower = np.empty(len(distinct), np.int64)
    lower[which] = last.at[have]
    h, w = np.divmod(distinct, n_words)
    return Gram(at, h, w, lower, np.bincount(which[b["trained"][have]], minlength=len(distinct)))


def _deal_grams(g: Gram, grams: list[Gram], n_parts: int, split: int) -> None:
    """Puts n-grams whose history other blocks have too, and these histories, in the order of the partitions that answer.

    A history's continuations go to one partition, or by their word to as many as its count asks for; each of these is asked
    for its share of the history's sums."""
    last, words = grams[-1], grams[0]
    ask = np.flatnonzero(~last.solo[g.history])
    some = np.unique(g.history[ask])
    home = mix64(last.number[some]) % np.uint64(n_parts)
    spread = np.minimum(1 + last.count[some] // split, n_parts)
    first = np.cumsum(spread) - spread
    who = np.repeat(np.arange(len(some)), spread)
    to = (home[who] + (np.arange(len(who)) - first[who]).astype(np.uint64)) % np.uint64(n_parts)
    order = np.lexsort((last.number[some[who]], to))
    spot = np.empty(len(who), np.int64)
    spot[order] = np.arange(len(who))
    # the n-grams by (partition, history), then by word
    of = np.searchsorted(some, g.history[ask])
    share = (mix64(words.number[g.word[ask]] + np.uint64(1)) % spread[of].astype(np.uint64)).astype(np.int64)
    rank = np.empty(len(words.number), np.int64)
    rank[np.argsort(words.number)] = np.arange(len(rank))
    key = spot[first[of] + share] * len(rank) + rank[g.word[ask]]
    by = np.argsort(key)
    at, bounds = key[by] // max(len(rank), 1), np.arange(n_parts + 1, dtype=np.uint64)
    who, to = who[order], to[order]
    g.asked = {"ask": ask[by], "of_part": np.searchsorted(to[at], bounds), "histories": some[who], "to_part": np.searchsorted(to, bounds), "per": np.bincount(at, minlength=len(who)), "split": spread[who] > 1}


def _sums(counts: np.ndarray, of: np.ndarray, mass: np.ndarray, n: int) -> list[np.ndarray]:
    """Of n histories: numbers of continuations seen 1.._CUT times, occurrences of the others, lower-order mass of all of them."""
    seen = counts > 0
    by_class = [np.bincount(of, counts == k, n).astype(np.uint32) for k in range(1, _CUT + 1)]
    return [*by_class, np.bincount(of, np.where(counts > _CUT, counts, 0), n).astype(np.int64), np.bincount(of, np.where(seen, mass, 0.0), n)]


class Model:
    """What is known of the model so far: discounts of each order, and the unigrams."""

    def __init__(self, n_train: int, n_types: int, classes: np.ndarray):
        self.n_train, self.n_types, self.d = n_train, n_types, [None, discounts(classes)]
        frequent = n_train - sum(r * classes[r] for r in range(1, _CUT + 1))
        mass = (sum(self.d[1][r] * r * classes[r] for r in range(1, _CUT + 1)) + frequent) / n_train if n_train else 1.0
        self.unseen = max(1 - mass, 0.5 / max(n_train, 1)) if n_train else 1.0
        self.scale = (1 - self.unseen) / mass if n_train else 0.0

    def discounted(self, order: int, c: np.ndarray) -> np.ndarray:
        return np.where(c <= _CUT, self.d[order][np.minimum(c, _CUT)], 1.0) * c

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * self.discounted(1, c) / max(self.n_train, 1), self.unseen)

    def lower(self, order: int, c: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams of ``order`` that were seen."""
        return self.unigram(c) if order == 1 else self.discounted(order, c) / total

    def weigh(self, order: int, sums: list[np.ndarray], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each history, the divisor and the backoff weight: the discounted mass over the lower-order mass of words not seen
        after it. A history all of whose continuations are frequent has nothing taken off: half a count more leaves room."""
        used = sum(self.d[order][k] * k * sums[k - 1] for k in range(1, _CUT + 1)) + sums[_CUT]
        total = count + 0.5 * (count - used <= 1e-9)
        return total, np.where(count > 0, (1 - used / np.maximum(total, 1)) / np.maximum(1 - sums[_CUT + 1], 1e-300), 1.0)


def _resolve(b: dict, replies: dict, model: Model | None, n_parts: int, split: int, orders: int) -> list[Gram]:
    """The block's n-grams of the first ``orders`` orders with all that the replies tell of them."""
    number, count = np.zeros(b["bounds"][-1], np.uint64), np.zeros(b["bounds"][-1], np.int64)
    solo = np.zeros(b["bounds"][-1], bool)
    for r, (n, drops, alone) in replies.get(1, {}).items():
        s = slice(b["bounds"][r], b["bounds"][r + 1])
        number[s], solo[s] = n, alone
        c = np.empty(len(n), np.int64)
        c[np.argsort(n)] = _undrop(drops)
        count[s] = c
    b["trained"] = np.repeat(b["train"], b["len"])
    grams = [Gram(b["code"].astype(np.int64), count=count, number=number, solo=solo)]
    for order in range(2, orders + 1):
        last, g = grams[-1], _longer(b, grams)
        _deal_grams(g, grams, n_parts, split)
        n = len(g.word)
        g.count, g.number, g.solo = g.mine.copy(), np.zeros(n, np.uint64), np.ones(n, bool)
        alone = np.flatnonzero(last.solo[g.history])  # settled here: no other block has their history
        low = _lower_total(grams, len(last.count))
        mass = np.zeros(n)
        mass[alone] = model.lower(order - 1, grams[-1].count[g.lower[alone]], low[g.history[alone]])
        sums = _sums(np.where(last.solo[g.history], g.mine, 0), g.history, mass, len(last.count))
        a, full, brief = g.asked, np.zeros(len(last.count), bool), np.zeros(len(last.count), bool)
        for r, (total, single, steps, whole, rest, *told) in replies.get(order, {}).items():
            mine = a["ask"][a["of_part"][r] : a["of_part"][r + 1]]
            g.count[mine], g.solo[mine] = total, single
            g.number[mine[~single]] = np.cumsum(steps, dtype=np.uint64) * np.uint64(n_parts) + np.uint64(r)
            whose = a["histories"][a["to_part"][r] : a["to_part"][r + 1]]
            whole, rest = (np.unpackbits(x, count=len(whose)).astype(bool) for x in (whole, rest))
            brief[whose[~whole]], full[whose] = True, rest
            for s, t in zip(sums, told):
                s[whose[whole]] += t
        g.total, g.alpha = model.weigh(order, sums, last.count)
        g.total = np.where(brief, last.count + 0.5 * full, g.total)
        grams.append(g)
    return grams


def _lower_total(grams: list[Gram], n: int) -> np.ndarray:
    """Per history of the next order: the divisor of the history without its first word (one, where that is empty)."""
    return np.ones(n) if len(grams) == 1 else grams[-1].total[grams[-1].lower]


def score_corpus(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = 24_000_000, block_bytes: int = 6_000_000, split: int = 200_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    The model is a Katz model of ``order`` words (2 or more): p(w|h) = d(r) r / c(h) for n-grams seen r times, else
    alpha(h) p(w|h'), h' being h without its first word, down to p(w), which is discounted likewise and leaves its rest to
    unseen words. alpha(h) makes each history's distribution over all words sum to one exactly: the discounted mass over the
    lower-order mass of words not seen after h, both summed over all of h's continuations.

    The counts of each order are a table dealt by history. A block of documents asks it for its distinct n-grams
    (``blocks``), so an n-gram that is everywhere costs one entry a block, and the continuations of a history that occurs more
    than ``split`` times are dealt over several partitions. What a single block has (most longer n-grams) is settled there: an n-gram whose history is in
    no other block can't be in one either, and its counts are already whole. Then every token is evaluated, order by order.

    Null texts are empty: one token, the end. Rows without id belong to the training part. Repeated rows count and return
    each. A very long text is a block of its own: memory grows with the longest text. Empty table: empty result. Further
    columns are ignored.
    """
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_parts = max(shuffle_partitions(spark), int(size // partition_bytes) + 1)
    blocks = encode_blocks(docs, scratch, id_col, text_col, n_parts, block_bytes)
    slim = blocks.where("part = 'text'").select("block", "blob")
    tasks = max(shuffle_partitions(spark), slim.count())

    def ask_words(row):
        hashes, counts = unpack(row["blob"])
        yield from questions(row["block"], *deal(hashes, n_parts), [hashes, counts])

    import xxhash

    bos = np.uint64(xxhash.xxh64_intdigest(b"\x00<s>", 7))

    def count_words(r, names, cols):
        keys, which = np.unique(np.concatenate([c[0] for c in cols]), return_inverse=True)
        counts = np.bincount(which, np.concatenate([c[1] for c in cols]), len(keys)).astype(np.int64)
        alone = np.bincount(which) == 1
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(keys))  # small numbers for frequent words
        number = (rank * n_parts + r).astype(np.uint64)
        at = 0
        for name, c in zip(names, cols):
            w = which[at : at + len(c[0])]
            at += len(c[0])
            yield name, pack([number[w], _drops(counts[w][np.argsort(number[w])]), alone[w]])
        real = counts[keys != bos]
        yield -1, pack([real.sum(), (real > 0).sum(), _classes(real)])

    def stats(table):
        """A few numbers a partition."""
        return [unpack(bytes(x[0])) for x in table.where("block = -1").select("blob").toLocalIterator()]

    told = lambda df, tag: df.where("block >= 0").select("block", "r", "blob", F.lit(tag).alias("tag"))
    words = answer(ask(blocks.where("part = 'words'").select("block", "blob"), ask_words), scratch, "words", count_words, n_parts)
    scratch.drop("blocks/part=words")
    known = stats(words)
    model = Model(int(sum(s[0] for s in known)), int(sum(s[1] for s in known)), sum((s[2] for s in known), np.zeros(_CUT + 3, np.int64)))
    replies = told(words, 1)

    def by_tag(rows):
        out = {}
        for t, r, x in rows:
            out.setdefault(t, {})[r] = x
        return out

    def ask_grams(k: int, model: Model):
        def run(row, rows):
            b = unpack(row["blob"])
            grams = _resolve(b, by_tag(rows), model, n_parts, split, k - 1)
            last, g = grams[-1], _longer(b, grams)
            _deal_grams(g, grams, n_parts, split)
            a, low = g.asked, _lower_total(grams, len(last.count))
            alone = _classes(g.mine[last.solo[g.history]])
            for r in range(n_parts):
                ours, mine = slice(a["to_part"][r], a["to_part"][r + 1]), a["ask"][a["of_part"][r] : a["of_part"][r + 1]]
                here = row["block"] % n_parts == r
                if ours.start == ours.stop and not here:
                    continue
                h = a["histories"][ours]
                # sorted histories: differences are small; divisors are whole or half numbers
                yield int(r), row["block"], pack([np.diff(last.number[h], prepend=np.uint64(0)), a["per"][ours].astype(np.uint32), np.rint(2 * low[h]).astype(np.int64), grams[0].number[g.word[mine]], g.mine[mine].astype(np.uint32), last.count[g.lower[mine]], alone if here else alone * 0, np.packbits(a["split"][ours])])

        return run

    def count_grams(k: int, model: Model):
        def run(r, names, cols):
            h = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in cols])
            low, alone = np.concatenate([c[2] for c in cols]) / 2, sum(c[6] for c in cols)
            every = np.repeat(h, np.concatenate([c[1] for c in cols]))
            w, n, below = (np.concatenate([c[i] for c in cols]) for i in (3, 4, 5))
            by = np.lexsort((w, every))
            first = np.r_[True, (every[by][1:] != every[by][:-1]) | (w[by][1:] != w[by][:-1])] if len(by) else np.zeros(0, bool)
            which = np.empty(len(by), np.int64)
            which[by] = np.cumsum(first) - 1
            n_grams = int(first.sum())
            total = np.bincount(which, n, n_grams).astype(np.int64)
            single = np.bincount(which, minlength=n_grams) == 1
            histories, some = np.unique(h, return_index=True)
            one = by[first]
            of = np.searchsorted(histories, every[one])
            sums = _sums(total, of, model.lower(k - 1, below[one], low[some][of]), len(histories))
            at = 0
            for name, c in zip(names, cols):
                mine = which[at : at + len(c[3])]
                at += len(c[3])
                whose = np.searchsorted(histories, np.cumsum(c[0], dtype=np.uint64))
                shared = mine[~single[mine]] if k < order else mine[:0]
                # a history's sums are for n-grams that were never seen; a block without such needs to know only if it is full
                whole = np.unpackbits(c[7], count=len(whose)).astype(bool)
                whole[np.repeat(np.arange(len(whose)), c[1])[total[mine] == 0]] = True
                rest = sum(x[whose] for x in sums[:_CUT]) == 0
                yield name, pack([total[mine].astype(np.uint32), single[mine] if k < order else np.ones(len(mine), bool), np.diff(shared, prepend=0).astype(np.uint64), np.packbits(whole), np.packbits(rest), *[x[whose[whole]] for x in sums]])
            yield -1, pack([alone + _classes(total)])

        return run

    question = pa.schema([("r", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])
    for k in range(2, order + 1):
        asked = with_replies(slim, replies, ask_grams(k, model), QUESTION, question, tasks)
        table = answer(asked, scratch, f"grams-{k}", count_grams(k, model), n_parts)
        model.d.append(discounts(sum((s[0] for s in stats(table)), np.zeros(_CUT + 3, np.int64))))
        replies = replies.unionByName(told(table, k))

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def evaluate(row, rows):
        b = unpack(row["blob"])
        grams = _resolve(b, by_tag(rows), model, n_parts, split, order)
        count = grams[0].count
        p = model.unigram(count)
        token = p[grams[0].at]
        for k, g in enumerate(grams[1:], 2):
            p = np.where(g.count > 0, model.discounted(k, g.count) / np.maximum(g.total[g.history], 0.5), g.alpha[g.history] * p[g.lower])
            token = np.where(g.at >= 0, p[g.at], token)
        base = np.log10((count + 1) / (model.n_train + model.n_types + 1))[b["code"]]
        at = np.cumsum(b["len"]) - b["len"]
        cols = [[None if z else i for i, z in zip(b["ids"].tolist(), b["null"].tolist())], (~b["train"]).tolist(), b["len"].tolist()]
        cols += [np.add.reduceat((count[b["code"]] > 0).astype(np.int64), at).tolist(), [model.n_train] * len(at), np.add.reduceat(base, at).tolist(), np.add.reduceat(np.log10(token), at).tolist()]
        yield from zip(*cols)

    return with_replies(slim, replies, evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", schema, tasks)
