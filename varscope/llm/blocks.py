"""Questions about all texts, asked and answered by block.

Texts are dealt once by a hash into blocks of about 2 MB; every later step works on whole blocks.
A block sends one message to a bucket: the distinct hashes it holds that belong there. So a
hash that millions of documents share reaches its bucket once a block, not once a document, and
its bucket answers once a block. All plans below use one and the same exchange of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, longs, make_room, raw, shuffle_partitions, text_bytes
from .hashing import member

BLOCK_BYTES = 2 << 20
U = np.uint64
MESSAGE = "bucket int, block int, hashes binary, firsts binary"
ANSWER = "block int, hashes binary, hot binary"


def in_blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_row: bool = False) -> tuple[DataFrame, int]:
    """(block, doc_id, text, th: their hash) dealt by block, and how many buckets to use. Null ids: :data:`NULL_ID`.
    ``keep_row``: also ``row``, a struct of all columns but the text."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    count = max(n, -(-text_bytes(docs, text) // BLOCK_BYTES))
    row = []
    if keep_row:
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
        kind = docs.select(whole.alias("row")).schema["row"].dataType.toNullable()   # as rows come back from Python
        row = [whole.cast(kind).alias("row")]
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"), *row)
    d = d.withColumn("th", F.xxhash64("doc_id", "text"))
    d = d.select(F.pmod("th", F.lit(count)).cast("int").alias("block"), *d.columns)
    return d.repartition(n, "block"), count


def ordered(t: pa.Table) -> pa.Table:
    """A block's rows in the order of (id, text)."""
    return t.take(pc.sort_indices(t, [("doc_id", "ascending"), ("text", "ascending")]))


def contents(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """block, ids, bytes and offsets of an ordered block's texts."""
    make_room()
    data, off = raw(t["text"])
    return t["block"][0].as_py(), longs(t["doc_id"]), data, off


def squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)


def deal(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indexes of its hashes) for distinct hashes; indexes ascend by hash."""
    to = ((h * U(0x9FB21C651E98DF25)) >> U(33)) % U(buckets)
    order = np.lexsort((h, to))
    cuts = np.flatnonzero(np.diff(to[order], prepend=U(1 << 63)))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(to[order[lo]]), order[lo:hi]


def send(block: int, h: np.ndarray, buckets: int, *more: np.ndarray) -> pa.Table:
    """The messages of a block: its distinct hashes, each with the values of ``more``."""
    rows = [(b, block, h[k].tobytes(), squeeze(*(m[k] for m in more)) if more else b"") for b, k in deal(h, buckets)]
    cols = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()),
                     pa.array(cols[3], pa.binary())], names=["bucket", "block", "hashes", "firsts"])


def answers(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    rows = [r for r in rows if len(r[1])]
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary()),
                     pa.array([r[2].tobytes() for r in rows], pa.binary())], names=["block", "hashes", "hot"])


def shared(messages: DataFrame, hot: int) -> DataFrame:
    """To each block those of its hashes that another block sent too, and of these the ones that
    occur ``hot`` times or more; ``firsts`` has how often a block holds each (255 at most)."""
    def run(t: pa.Table) -> pa.Table:
        blocks = t["block"].to_pylist()
        hs = [np.frombuffer(x, U) for x in t["hashes"].to_pylist()]
        counts = np.concatenate([np.frombuffer(unsqueeze(x), np.uint8) for x in t["firsts"].to_pylist()])
        every = np.concatenate(hs)
        order = np.argsort(every, kind="stable")
        s = every[order]
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(begin, len(s)))
        twice = s[begin[size > 1]]
        many = s[begin[np.add.reduceat(counts[order].astype(np.int64), begin) >= hot]]
        both = np.union1d(twice, many)
        return answers([(b, h[member(h, both)], h[member(h, many)]) for b, h in zip(blocks, hs)])

    return messages.groupBy("bucket").applyInArrow(run, ANSWER)


def earlier(messages: DataFrame, by_place: bool) -> DataFrame:
    """To each block those of its hashes whose first occurrence, over all blocks, is before the
    block's own first one: in a smaller document or, ``by_place``, also earlier in the same one."""
    def run(t: pa.Table) -> pa.Table:
        blocks = t["block"].to_pylist()
        hs = [np.frombuffer(x, U) for x in t["hashes"].to_pylist()]
        n = np.array([len(h) for h in hs])
        rest = [np.frombuffer(unsqueeze(x), np.int64).reshape(2, -1) for x in t["firsts"].to_pylist()]
        every, (doc, pos) = np.concatenate(hs), np.concatenate(rest, axis=1)
        order = np.lexsort((pos, doc, every))
        s = every[order]
        begin = np.concatenate([[True], s[1:] != s[:-1]])
        first = order[np.flatnonzero(begin)][np.cumsum(begin) - 1]     # of each, in sorted order
        late = doc[first] < doc[order]
        if by_place:
            late |= (doc[first] == doc[order]) & (pos[first] < pos[order])
        flag = np.zeros(len(every), bool)
        flag[order] = late
        ends = np.cumsum(n)
        return answers([(b, h[flag[e - k:e]], h[:0]) for b, h, e, k in zip(blocks, hs, ends, n)])

    return messages.groupBy("bucket").applyInArrow(run, ANSWER)


def told(t: pa.Table, column: str = "hashes") -> np.ndarray:
    """All hashes of a block's answers, sorted."""
    parts = [np.frombuffer(x, U) for x in t[column].to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, U)


def with_answers(blocks: DataFrame, replies: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of each block's texts and answers; blocks without answers too."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right).select(names)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)
