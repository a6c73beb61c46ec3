"""Removal of repeated passages of 100 bytes and more by prefix-free parsing."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import QUESTION, answer, deal, mix64, pack, to_batches, unpack, with_replies
from .common import Scratch, ship, shuffle_partitions

ship(__name__)

_CHUNK = 1 << 18
_LAST = np.iinfo(np.int64).max
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D | 1
_powers: list = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 (the base is odd)."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, _CHUNK + 4096), b, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def rolling(buf: np.ndarray):
    """A function that gives the hashes of substrings [start, stop)."""
    up, down = _power(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=sums[1:])
    return lambda start, stop: mix64((sums[stop] - sums[start]) * down[start])


def pieces(texts: list[bytes], width: int, most: int = _CHUNK):
    """The texts as chunks: (bytes, [(text, offset in text, offset in chunk, starts)]); a long text is cut with an overlap, so
    that each start of ``width`` bytes lies whole in one chunk."""
    held, where, size = [], [], 0
    for k, t in enumerate(texts):
        at = 0
        while len(t) - at >= width:
            n = min(len(t) - at - width + 1, max(1, most - width))
            if size and size + n + width > most:
                yield b"".join(held), where
                held, where, size = [], [], 0
            part = t[at : at + n + width - 1]
            where.append((k, at, size, n))
            held.append(part)
            size += len(part)
            at += n
    if held:
        yield b"".join(held), where


def phrases(raw: bytes, where: list, width: int, trigger: int):
    """Parse a chunk. A ``trigger``-byte string whose rolling hash is least among those of a window of ``width`` bytes ends a
    phrase: equal windows hold the same trigger at the same place, wherever they are. A phrase is the run of windows with one
    trigger; with its look-ahead it is the substring [lo, lo + n - 1 + width), so that no string of ``width`` bytes leaves the
    phrase in which it starts.

    Returns per phrase: lo, number n of its windows, the trigger's place in it and hash, the phrase's hash, the index in
    ``where``.
    """
    buf = np.frombuffer(raw, np.uint8)
    hashes, i = rolling(buf), np.arange(len(buf) - trigger + 1)
    th = hashes(i, i + trigger)
    low = (th & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(th), dtype=np.uint64)
    span, reach, least = width - trigger + 1, 1, low
    while reach * 2 <= span:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :]) if span > reach else least
    first = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the trigger of the window that starts here
    offsets, counts = np.array([w[2] for w in where]), np.array([w[3] for w in where])
    starts = np.arange(counts.sum()) + np.repeat(offsets - (np.cumsum(counts) - counts), counts)
    piece = np.repeat(np.arange(len(where)), counts)
    t = first[starts]
    head = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (piece[1:] != piece[:-1])])
    lo, at, n = starts[head], t[head], np.diff(np.r_[head, len(starts)])
    return lo, n, at - lo, th[at], hashes(lo, lo + n - 1 + width), piece[head]


def parse(texts: list[bytes], width: int, trigger: int) -> dict:
    """The phrases of all texts, in order: text, lo, n, place of the trigger, its hash, the phrase's."""
    cols = [[np.zeros(0, np.int64)] for _ in range(4)] + [[np.zeros(0, np.uint64)] for _ in range(2)]
    for raw, where in pieces(texts, width):
        lo, n, place, th, xh, piece = phrases(raw, where, width, trigger)
        text, shift = np.array([w[0] for w in where])[piece], np.array([w[1] - w[2] for w in where])[piece]
        for c, x in zip(cols, (text, lo + shift, n, place, th, xh)):
            c.append(x)
    return dict(zip(("text", "lo", "n", "place", "key", "phrase"), map(np.concatenate, cols)))


def suffix_ranks(text: bytes, at: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes that start ``at``, all of ``depth`` bytes or more, in the suffix array of ``text`` as far as
    ``depth`` bytes tell them apart: equal ranks are equal strings of ``depth`` bytes. Built by prefix doubling."""
    buf = np.frombuffer(text + bytes(depth + 8), np.uint8)
    rank = np.zeros(len(buf) - 7, np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | buf[k : len(rank) + k]
    known = min(8, depth)
    if depth < 8:
        return np.unique(rank[at] >> np.uint64(8 * (8 - depth)), return_inverse=True)[1]
    rank = np.unique(rank, return_inverse=True)[1]
    while known * 2 <= depth:  # ranks by the first half, then by the second
        n = len(rank) - known
        rank = np.unique(rank[:n] * (int(rank.max()) + 1) + rank[known:], return_inverse=True)[1]
        known *= 2
    rest = depth - known
    return np.unique(rank[at] * (int(rank.max()) + 1) + rank[at + rest], return_inverse=True)[1]


def first_holders(phrases_: list[bytes], keys: list[bytes], holder: np.ndarray, width: int, most: int = 1 << 20) -> list[np.ndarray | None]:
    """For each of the dictionary's distinct phrases, which of its windows no other phrase has earlier: None for all of them,
    else flags. ``keys`` are their triggers, ``holder`` the places of their first occurrences in corpus order.

    Only phrases with a common trigger can share windows. A trigger with one phrase is settled; the others' phrases, some at
    a time, are joined to a text, whose suffix ranks find equal windows; each is the first occurrence's."""
    groups: dict = {}
    for k, t in enumerate(keys):
        groups.setdefault(t, []).append(k)
    out: list = [None] * len(phrases_)
    held, size = [], 0

    def settle():
        nonlocal held, size
        if not held:
            return
        which = np.array(held)
        lengths = np.array([len(phrases_[k]) for k in held])
        n = lengths - width + 1
        start = np.cumsum(lengths) - lengths
        at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        rank = suffix_ranks(b"".join(phrases_[k] for k in held), at, width)
        own = np.repeat(holder[which], n)
        order = np.lexsort((own, rank))
        first = np.r_[True, rank[order][1:] != rank[order][:-1]]
        wins = np.zeros(len(at), bool)
        wins[order[first]] = True
        for k, flags in zip(held, np.split(wins, np.cumsum(n)[:-1])):
            out[k] = None if flags.all() else flags
        held, size = [], 0

    for members in groups.values():
        if len(members) > 1:
            held += members
            size += sum(len(phrases_[k]) for k in members)
            if size > most:
                settle()
    settle()
    return out


class Block:
    """A block of texts in order of (id, place in the table), with their phrases."""

    def __init__(self, row: dict, width: int):
        self.ids, self.texts, p, self.bounds = unpack(row["blob"])
        self.order = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        self.text, self.n, self.place, self.key = (p[c].astype(np.int64) for c in ("text", "n", "place", "key"))
        # a text's phrases follow each other without a gap
        end = np.cumsum(self.n)
        new = np.r_[True, self.text[1:] != self.text[:-1]] if len(end) else np.zeros(0, bool)
        self.lo = end - self.n - np.repeat((end - self.n)[new], np.diff(np.r_[np.flatnonzero(new), len(end)]))
        self.width = width

    def repeated(self, replies: dict, n_parts: int) -> dict:
        """The phrases whose trigger occurs again, in corpus order: text, lo, n, place of the trigger, partition, and the
        distinct ones with their first occurrence. Those of a frequent trigger are cut into their windows, dealt each by its
        own bytes."""
        state = np.zeros(int(self.bounds[-1]), np.uint8)
        for r, (flags,) in replies.items():
            state[self.bounds[r] : self.bounds[r + 1]] = flags
        state = state[self.key]
        which = np.flatnonzero(state)
        cut = state[which] == 2
        times = np.where(cut, self.n[which], 1)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        which, cut = np.repeat(which, times), np.repeat(cut, times)
        text, lo, n, place = self.text[which], self.lo[which] + step, np.where(cut, 1, self.n[which]), self.place[which] - step
        found: dict = {}
        for k, t, a, b in zip(range(len(text)), text.tolist(), lo.tolist(), (lo + n - 1 + self.width).tolist()):
            found.setdefault(self.texts[t][a:b], k)
        at = np.array(list(found.values()), np.int64)
        part = np.searchsorted(self.bounds, self.key[which[at]], "right") - 1
        for j in np.flatnonzero(cut[at]).tolist():
            lo_ = lo[at[j]]
            part[j] = zlib.crc32(self.texts[text[at[j]]][lo_ : lo_ + self.width]) % n_parts
        return {"text": text, "lo": lo, "n": n, "place": place, "found": found, "at": at, "part": part}


def remove_repeats(docs: DataFrame, width: int = 100, trigger: int = 40, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, block_bytes: int = 3_000_000, partition_bytes: int = 24_000_000, frequent: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, with ``keep_text``).

    A byte goes if a string of ``width`` bytes that covers it also starts earlier, in the order of (id, place). Strings are
    judged on the input; matches never cross documents.

    1. Rolling-hash triggers parse each text into phrases (``phrases``); equal strings lie in phrases with equal triggers.
       A text is parsed once, and kept with its parse.
    2. Triggers that occur once in the corpus, nearly all of unique text, end here: only 48 bits of their hash are
       exchanged, since a chance agreement costs a phrase sent in vain and no error.
    3. The dictionary: the distinct phrases of the others, by trigger, byte for byte. Where one trigger has several phrases,
       their suffix ranks to the depth of ``width`` order all windows (``first_holders``). Phrases overlap, so that no order
       beyond the phrase is needed, and the parse adds what the dictionary lacks: which occurrence comes first in the corpus.
       A trigger with more than ``frequent`` phrases (as many as fill a partition: the edge of a passage that very many
       texts share) is dealt by windows, so that no partition holds it.
    4. Every phrase of the parse is the first holder of some of its windows, or repeats them.

    Groups of copies meet once per block of texts and never in pairs. Null texts are empty (not changed, digest of nothing);
    texts under ``width`` bytes stay. Null ids come after all others; rows of one id are ordered by their place in the
    table. A very long text is a block of its own, parsed in chunks: memory grows with the longest text. Empty table: empty
    result. Further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_parts = max(shuffle_partitions(spark), int(size // partition_bytes) + 1)
    frequent = frequent or partition_bytes // (2 * width)

    def cut(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32

        def close(ids, texts, number):
            order = sorted(range(len(ids)), key=lambda k: _LAST if ids[k] is None else ids[k])  # stable: rows of one id keep the table's order
            texts = [texts[k] for k in order]
            p = parse(texts, width, trigger)
            keys, back = np.unique(p["key"] >> np.uint64(16), return_inverse=True)
            many = np.bincount(back, minlength=len(keys)) > 1
            by = np.lexsort((p["phrase"], back))
            new = np.r_[True, (back[by][1:] != back[by][:-1]) | (p["phrase"][by][1:] != p["phrase"][by][:-1])] if len(by) else np.zeros(0, bool)
            kinds = np.bincount(back[by][new], minlength=len(keys)).astype(np.uint32)
            order_, bounds = deal(keys, n_parts)
            rank = np.empty(len(keys), np.int64)
            rank[order_] = np.arange(len(keys))
            p = {"text": p["text"].astype(np.uint32), "n": p["n"].astype(np.uint32), "place": p["place"].astype(np.uint16), "key": rank[back].astype(np.uint32)}
            return part + number, pack((keys[order_], many[order_], kinds[order_], bounds)), pack(([ids[k] for k in order], texts, p, bounds))

        def rows():
            ids, texts, size, number = [], [], 0, 0
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    ids.append(i)
                    texts.append((t.as_py() or "").encode("utf-8", "replace"))
                    size += len(texts[-1]) + 16
                    if size > block_bytes:
                        yield close(ids, texts, number)
                        ids, texts, size, number = [], [], 0, number + 1
            if ids:
                yield close(ids, texts, number)

        yield from to_batches(rows(), pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("blob", pa.binary())]), 4_000_000)

    blocks = scratch.table(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, "block long, keys binary, blob binary"), "blocks")
    tasks = max(shuffle_partitions(spark), blocks.count())
    question = pa.schema([("r", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])

    def emit_triggers(batches):
        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    keys, many, kinds, bounds = unpack(row["keys"])
                    for r in np.flatnonzero(np.diff(bounds)):
                        s = slice(bounds[r], bounds[r + 1])
                        yield int(r), row["block"], pack([np.diff(keys[s], prepend=np.uint64(0)), many[s], kinds[s]])  # sorted: differences are smaller

        yield from to_batches(rows(), question)

    def judge_triggers(r, names, cols):
        keys, which = np.unique(np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in cols]), return_inverse=True)
        again = (np.bincount(which) > 1) | (np.bincount(which, np.concatenate([c[1] for c in cols])) > 0)
        again = again * (1 + (np.bincount(which, np.concatenate([c[2] for c in cols])) > frequent)).astype(np.uint8)
        at = 0
        for n, c in zip(names, cols):
            yield n, pack([again[which[at : at + len(c[0])]]])
            at += len(c[0])

    slim = blocks.select("block", "blob")
    triggers = answer(blocks.select("block", "keys").mapInArrow(emit_triggers, QUESTION), scratch, "triggers", judge_triggers, n_parts)
    told = lambda df, tag: df.select("block", "r", "blob", F.lit(tag).alias("tag"))

    def emit_phrases(row, replies):
        b = Block(row, width)
        u = b.repeated({r: x for t, r, x in replies if t == "t"}, n_parts)
        names, by = list(u["found"]), np.argsort(u["part"], kind="stable")
        for mine in np.split(by, np.flatnonzero(np.diff(u["part"][by])) + 1) if len(by) else []:
            k = u["at"][mine]
            yield int(u["part"][mine[0]]), row["block"], pack([np.diff(b.order[u["text"][k]], prepend=0), u["n"][k].astype(np.uint32), u["place"][k].astype(np.uint16), np.frombuffer(b"".join(names[x] for x in mine.tolist()), np.uint8)])

    asked = with_replies(slim, told(triggers, "t"), emit_phrases, QUESTION, question, tasks)

    def judge_phrases(r, names, cols):
        known, triggers, of = {}, [], []
        for _, n, place, raw in cols:
            raw, at = raw.tobytes(), 0
            for length, p in zip((n.astype(np.int64) + width - 1).tolist(), place.tolist()):
                x = raw[at : at + length]
                at += length
                k = known.setdefault(x, len(known))
                if k == len(triggers):
                    triggers.append(x[p : p + trigger])
                of.append(k)
        of = np.array(of)
        sizes = [len(c[1]) for c in cols]
        rank, seq = np.concatenate([np.cumsum(c[0]) for c in cols]), np.concatenate([np.arange(n) for n in sizes])
        order = np.lexsort((seq, np.repeat(np.array(names), sizes), rank))  # corpus order
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        holder = np.full(len(known), len(order))
        np.minimum.at(holder, of, place)
        flags = first_holders(list(known), triggers, holder, width)
        mine = place == holder[of]
        at = 0
        for name, size in zip(names, sizes):
            s = slice(at, at + size)
            at += size
            some = [flags[k] for k, first in zip(of[s].tolist(), mine[s].tolist()) if first]
            state = mine[s].astype(np.uint8)  # 0: a repeat as a whole, 1: the first holder, 2: of the windows flagged
            state[mine[s]] = [1 if f is None else 2 for f in some]
            bits = [f for f in some if f is not None]
            yield name, pack([state, np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8)])

    dictionary = answer(asked, scratch, "dictionary", judge_phrases, n_parts)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep_text:
        fields, schema = [*fields, ("kept", pa.binary())], schema + ", kept binary"

    def finish(row, replies):
        b = Block(row, width)
        u = b.repeated({r: x for t, r, x in replies if t == "t"}, n_parts)
        at, text, lo, n = u["at"], u["text"], u["lo"], u["n"]
        spans = [[] for _ in b.texts]  # (from, to) of windows that repeat
        gone = np.ones(len(text), bool)  # a later occurrence of a phrase repeats all its windows
        gone[at] = False
        for tag, r, x in replies:
            if tag == "t":
                continue
            state, bits = x
            mine = at[u["part"] == r]
            gone[mine[state == 0]] = True
            some = mine[state == 2]
            again = np.flatnonzero(~np.unpackbits(bits, count=int(n[some].sum())).astype(bool))
            whose = np.repeat(np.arange(len(some)), n[some])[again]
            start = lo[some][whose] + again - (np.cumsum(n[some]) - n[some])[whose]
            for t, a in zip(text[some][whose].tolist(), start.tolist()):
                spans[t].append((a, a + width))
        for t, a, c in zip(text[gone].tolist(), lo[gone].tolist(), (lo + n - 1 + width)[gone].tolist()):
            spans[t].append((a, c))
        for i, t, cuts in zip(b.ids, b.texts, spans):
            kept, removed, runs, end = [], 0, 0, 0
            for lo, hi in sorted(cuts):
                if lo > end or not runs:
                    runs += 1
                    kept.append(t[end:lo])
                    end = lo
                removed += max(0, hi - end)
                end = max(end, hi)
            kept = t if not cuts else b"".join([*kept, t[end:]])
            yield (i, len(t), int(removed), runs, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else []))

    return with_replies(slim, told(triggers, "t").unionByName(told(dictionary, "d")), finish, schema, pa.schema(fields), tasks)
