"""Toxicity by compression distance: a zstandard dictionary of toxic and one of ordinary text, trained apart."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import carried, ship, uncarried

ship(__name__)

_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_EDGE = bytes(c for c in range(128) if not chr(c).isalnum())
#: Around each window, so that a match inside of another word needs a literal more.
SEP = b" "
N_FEATURES = 5


def windows(text: str | None) -> list[bytes]:
    """The whole text in windows of one word, trimmed of ASCII marks."""
    return [w for x in (text or "").encode("utf-8", "replace").translate(_LOW).split() if (w := x.strip(_EDGE))]


class Scorer:
    """Compares how far each dictionary compresses a window. Calibration turns pairs of lengths into log-odds, and what a text's
    windows have of them into a probability."""

    def __init__(self, toxic: bytes, ordinary: bytes, level: int = 9, repeat: int = 3, memo: int = 400_000):
        self.toxic, self.ordinary, self.level, self.repeat, self.limit = toxic, ordinary, level, repeat, memo
        self.mean = self.scale = self.weights = None
        self.odds = {}
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _open(self):
        import zstandard as zs

        def one(raw):
            d = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
            p = zs.ZstdCompressionParameters.from_level(self.level, window_log=21, chain_log=19, hash_log=19, search_log=8, min_match=5, write_content_size=0, write_dict_id=0, write_checksum=0)
            return zs.ZstdCompressor(dict_data=d, compression_params=p).compress

        self._ready = one(self.toxic), one(self.ordinary), {}

    def lengths(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """Per window: the bytes that the toxic dictionary saves over the ordinary one, the bytes it needs, the window's own."""
        if self._ready is None:
            self._open()
        t, o, memo = self._ready
        if len(memo) > self.limit:
            memo.clear()  # results don't depend on it
        out = []
        for w in words:
            g = memo.get(w)
            if g is None:
                s = (SEP + w) * self.repeat + SEP
                short = len(t(s))
                g = memo[w] = len(o(s)) - short, short, min(len(w), 20)
            out.append(g)
        return out

    def features(self, words: list[bytes]) -> list[float]:
        odds = [self.odds.get(c, 0.0) for c in self.lengths(list(dict.fromkeys(words))) if c[0] > 0]
        return [max(odds, default=0.0), math.log1p(sum(x for x in odds if x > 0)), math.log1p(sum(x > 1 for x in odds)), math.log1p(sum(x > 2 for x in odds)), math.log1p(len(words))]

    def weigh(self, docs: list[tuple[list[bytes], int]]) -> None:
        """Log-odds of each triple of lengths, from the numbers of documents of either label with such windows."""
        seen, n = (Counter(), Counter()), [0, 0]
        for words, y in docs:
            n[y] += 1
            seen[y].update({c for c in self.lengths(list(set(words))) if c[0] > 0})
        rate = lambda c, y: (seen[y][c] + 0.5) / (n[y] + 1)
        self.odds = {c: math.log(rate(c, 1) / rate(c, 0)) for c in seen[0] | seen[1]}

    def calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> None:
        """Logistic regression by Newton steps."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        b = np.zeros(z.shape[1])
        keep = np.diag([1e-6] + [ridge] * (z.shape[1] - 1))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ b)
            b += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = b

    def score(self, text: str | None) -> float:
        f = (np.array(self.features(windows(text))) - self.mean) / self.scale
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] + float(f @ self.weights[1:]))))))


def _distinct(texts: list[list[bytes]]) -> list[list[bytes]]:
    """Word lists without copies and near copies, a third of whose five-word shingles came before: copies would vouch for themselves."""
    seen, out = set(), []
    for w in texts:
        h = {zlib.crc32(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))}
        if len(h & seen) * 3 <= len(h):
            out.append(w)
        seen |= h
    return out


def dictionary(texts: list[list[bytes]], size: int, least_docs: int = 2) -> bytes:
    """The class's words by the number of texts that hold them, up to ``size`` bytes, the most frequent last, where zstandard
    reaches them by the shortest offsets."""
    count = Counter(w for words in texts for w in set(words) if len(w) > 2)
    out, n = [], 0
    for w, k in sorted(count.items(), key=lambda x: (-x[1], x[0])):
        n += len(w) + len(SEP)
        if k < least_docs or n > size:
            break
        out.append(w)
    return SEP + SEP.join(out[::-1]) + SEP * 16  # the last few bytes of a dictionary aren't indexed


def train(rows: list[tuple[str | None, int]], toxic_bytes: int = 8_000, ordinary_bytes: int = 400_000) -> Scorer:
    """Fit on labelled texts: the dictionaries, each of its own class, on one half (every other row), the calibration on the
    other half, whose texts the dictionaries have not seen. Sizes are bounds of the model: some 1,000 words of a class are
    enough for the smaller one, and ordinary words that it holds must be in the larger one."""
    words = [(windows(t), y) for t, y in rows]
    halves = [[(w, y) for w, y in words[k::2]] for k in (0, 1)]
    toxic, plain = (_distinct([w for w, y in halves[0] if y == k and w]) for k in (1, 0))
    fit = halves[1] if {y for _, y in halves[1]} == {0, 1} else words
    if not toxic or not plain or {y for _, y in fit} != {0, 1}:
        s = Scorer(SEP * 16, SEP * 16)
        share = sum(y for _, y in words) / len(words) if words else 0.0
        s.mean, s.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        s.weights = np.r_[math.log((share + 1e-6) / (1 - share + 1e-6)), np.zeros(N_FEATURES)]
        return s
    scorer = Scorer(dictionary(toxic, toxic_bytes), dictionary(plain, ordinary_bytes))
    scorer.weigh([(w, y) for k in (0, 1) for w, y in zip(_distinct([w for w, z in fit if z == k]), iter(lambda k=k: k, None))])
    scorer.calibrate(np.array([scorer.features(w) for w, _ in fit]), np.array([float(y) for _, y in fit]))
    return scorer


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = 3000, folds: int = 5, fold: int = 0) -> list[tuple[str | None, int]]:
    """At most ``per_class`` training texts of each label (ids whose checksum modulo ``folds`` is not ``fold``), in the order
    of a hash of the id: a bounded share for the driver whatever the corpus. Of each whole text its distinct tokens are sent."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc % folds != fold)).select("doc_id", "toxic")
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    picked = parts[0].union(parts[1])
    tokens = F.array_join(F.array_distinct(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")), " ")
    text = docs.select("doc_id", tokens.alias("tokens"))
    # the sample's size is bounded by per_class, so it can be broadcast
    got = text.join(F.broadcast(picked), "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "tokens", "toxic").collect()
    return [(r["tokens"], int(r["toxic"])) for r in sorted(got)]


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **sample) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) of every whole text; with ``keep``, those columns besides.

    Learns from a bounded sample (see ``labelled_sample``) of labelled rows that are not held out. Null and empty texts get
    the score of a text without windows. No labels of one class: every text gets the prior. Repeated rows score alike each.
    Very long texts: time and memory grow with their words. Empty table: empty result. Further columns are ignored; columns
    in ``keep`` may have any name: where one is that of a result, the result replaces it.
    """
    scorer = train(labelled_sample(docs, labels, **sample))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    slim = carried(docs, ["doc_id", "text"], keep).withColumn("held_out", F.coalesce(crc % 5 == 0, F.lit(False)))
    schema = StructType([slim.schema["doc_id"], slim.schema["_kept"], slim.schema["held_out"]]).add("score", "double").add("predicted", "integer")

    def score(batches):
        for b in batches:
            s = [scorer.score(t) for t in b.column("text").to_pylist()]
            made = [b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_kept"), *made], schema.names)

    return uncarried(slim.mapInArrow(score, schema), ["doc_id"], keep, ["held_out", "score", "predicted"])
