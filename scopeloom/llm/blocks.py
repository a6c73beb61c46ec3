"""Packed exchanges: what a block of documents asks about its keys is shuffled as arrays, not as a row per key.

A block is a bounded piece of the corpus. It deals its distinct keys to partitions; each partition answers the blocks in
the order of their questions, so that an answer needs no key. Frequent keys cost one entry per block.
"""

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Scratch, ship

ship(__name__)


#: First of the three parts that stand for an array in packed data.
_MARK = "byte planes"


def _planes(x):
    """Arrays of wider integers byte by byte: the upper bytes, nearly all zero, then compress to nothing."""
    if isinstance(x, (list, tuple)):
        return type(x)(map(_planes, x))
    if isinstance(x, dict):
        return {k: _planes(v) for k, v in x.items()}
    if isinstance(x, np.ndarray) and x.dtype.kind in "iu" and x.dtype.itemsize > 1 and x.ndim == 1 and len(x):
        return (_MARK, x.dtype.str, np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())
    return x


def _joined(x):
    if isinstance(x, tuple) and len(x) == 3 and isinstance(x[0], str) and x[0] == _MARK:
        kind = np.dtype(x[1])
        return np.ascontiguousarray(np.frombuffer(x[2], np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()
    if isinstance(x, (list, tuple)):
        return type(x)(map(_joined, x))
    if isinstance(x, dict):
        return {k: _joined(v) for k, v in x.items()}
    return x


def pack(x) -> bytes:
    import zstandard

    return zstandard.compress(pickle.dumps(_planes(x), 5), 1)


def unpack(b: bytes):
    import zstandard

    return _joined(pickle.loads(zstandard.decompress(b)))


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def deal(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts distinct ``keys`` by partition and then by key, and the bounds of the partitions in it."""
    part = keys % np.uint64(n)
    order = np.lexsort((keys, part))
    return order, np.searchsorted(part[order], np.arange(n + 1, dtype=np.uint64))


def questions(block: int, order: np.ndarray, bounds: np.ndarray, columns: list[np.ndarray]):
    """(partition, block, packed columns) for each partition that has keys of this block."""
    cols = [c[order] for c in columns]
    for r in np.flatnonzero(np.diff(bounds)):
        yield int(r), block, pack([c[bounds[r] : bounds[r + 1]] for c in cols])


def answers(replies: dict[int, list[np.ndarray]], order: np.ndarray, bounds: np.ndarray, kinds: list) -> list[np.ndarray]:
    """The columns of all partitions' replies, in the order of the keys as they were before ``deal``."""
    out = []
    for i, kind in enumerate(kinds):
        col = np.zeros(len(order), kind)
        for r, cols in replies.items():
            col[order[bounds[r] : bounds[r + 1]]] = cols[i]
        out.append(col)
    return out


def to_batches(rows, schema: pa.Schema, most: int = 16_000_000):
    """Record batches of a bounded size from tuples that end with bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


REPLY, QUESTION = "block long, r int, blob binary", "r int, block long, blob binary"


def ask(blocks: DataFrame, emit) -> DataFrame:
    """Questions of each block. ``emit`` takes a row (a dict) and yields (partition, block, bytes)."""

    def run(batches):
        for b in batches:
            yield from to_batches((q for row in b.to_pylist() for q in emit(row)), pa.schema([("r", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())]))

    return blocks.mapInArrow(run, QUESTION)


def with_replies(blocks: DataFrame, replies: DataFrame, emit, schema: str, arrow: pa.Schema, tasks: int) -> DataFrame:
    """Each block together with its replies: ``emit(row, [(tag, r, arrays), ...])`` yields tuples of ``schema``. Blocks are
    spread over ``tasks``, a number that grows with theirs, so that a task holds few of them at any size."""

    def run(key, left, right):
        told = [(t, r, unpack(b)) for t, r, b in zip(right.column("tag").to_pylist(), right.column("r").to_pylist(), right.column("blob").to_pylist())] if right.num_rows else []
        rows = [x for row in left.to_pylist() for x in emit(row, told)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow) if rows else arrow.empty_table()

    return blocks.repartition(tasks, "block").groupBy("block").cogroup(replies.repartition(tasks, "block").groupBy("block")).applyInArrow(run, schema)


def answer(asked: DataFrame, scratch: Scratch, name: str, reduce, n_parts: int) -> DataFrame:
    """Replies of all ``n_parts`` partitions, written; as many tasks, so that the largest stays the same at any size.
    ``reduce`` takes (partition, blocks, lists of columns) and yields (block, bytes); block -1 and below hold what is not for a
    block."""
    out = pa.schema([("block", pa.int64()), ("r", pa.int32()), ("blob", pa.binary())])

    def run(key, t):
        r = key[0].as_py()
        blocks, cols = t.column("block").to_pylist(), [unpack(b) for b in t.column("blob").to_pylist()]
        rows = [(b, r, x) for b, x in reduce(r, blocks, cols)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out) if rows else out.empty_table()

    return scratch.table(asked.repartition(n_parts, "r").groupBy("r").applyInArrow(run, REPLY), name)
