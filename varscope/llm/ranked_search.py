"""Ranked lexical search: exact inner products over sparse ball trees, integer scores at the leaves.

A document is a sparse vector over the items' terms: w * ((10^9 tf) div (1000 tf + 8 m)); an item is the
indicator of its terms, so a score is their inner product. A task deals its documents into blocks of bounded
size and builds a ball tree of each: a node has the mean of its documents' vectors and the largest distance
of one from it. For an item of k terms no document below a node scores more than
``mean . item + sqrt(k) * radius`` (Cauchy-Schwarz); means are rounded up and the sum is taken with a margin
for rounding, so the bound is safe in doubles. The tree is visited best bound first until the bound falls
below the item's tenth score so far; leaves are scored in 64-bit integers. A task carries its items' best rows
from block to block, so later blocks prune more. Ranks come from the tasks' best rows, at most ten an item and task.

Jobs: one over the texts writes each document's term count and frequencies of the items' terms to the shared
folder; one sums document frequencies; one searches. Items go in blocks of :data:`ITEM_BYTES` of text, so that
what tasks are sent is bounded; more items are more scans, each of the whole table.

Rules: a null text has no terms and scores nothing; documents are rows (repeated ids are separate documents,
in any order among equal rows); a null doc_id sorts after others. Rows of one item_id are one item with the
terms of all; a null item_id is an item. Fewer than ten documents above 0: all; none: no row. Other columns
are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, batch, longs, slices, written

#: Fixed values of the score: scale, saturation, weight of length in percent.
SCALE, SATURATION, LENGTH = 1_000_000_000, 8, 90
#: Bytes of the items' text that tasks are sent at once; a single longer item goes alone.
ITEM_BYTES = 8 << 20
#: Terms in a block of documents, and documents in a leaf.
BLOCK_TERMS = 1 << 19
LEAF = 24
#: A bound is raised by this share, far above what rounding of its sums can take away.
MARGIN = 1e-9
#: Fixed rule: bytes of a term are digits, letters and all beyond ASCII; only A-Z are lower-cased.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of ``n`` terms."""
    return 100 - LENGTH + (LENGTH * n * n_docs) // n_terms


class BallTree:
    """Sparse integer vectors (CSR: ``start``, ``col``, ``val``) over ``width`` columns."""

    def __init__(self, start: np.ndarray, col: np.ndarray, val: np.ndarray, width: int):
        self.start, self.col, self.val, self.width = start, col, val, width
        n = len(start) - 1
        self.norm2 = np.add.reduceat(np.append(val.astype(np.float64) ** 2, 0.0), start[:-1]) if n else np.zeros(0)
        self.norm2[start[:-1] == start[1:]] = 0.0
        self.nodes: list[tuple[np.ndarray, np.ndarray, float, object]] = []   # mean's columns, values, radius, children or rows
        self.root = self._build(np.arange(n)) if n else None

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the rows' entries, and where each row begins among them."""
        size = self.start[rows + 1] - self.start[rows]
        first = np.cumsum(size) - size
        return np.repeat(self.start[rows] - first, size) + np.arange(size.sum()), first

    def products(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Inner product of each row with a dense vector."""
        at, first = self.entries(rows)
        values = self.val[at] * dense[self.col[at]]
        out = np.add.reduceat(np.append(values, 0), first)
        out[self.start[rows] == self.start[rows + 1]] = 0
        return out

    def _build(self, rows: np.ndarray) -> int:
        at, _ = self.entries(rows)
        mean = np.bincount(self.col[at], self.val[at], self.width) / len(rows)
        here = np.flatnonzero(mean)
        own = float((mean[here] ** 2).sum())
        away = self.norm2[rows] - 2 * self.products(rows, mean) + own
        # rounding of this difference is far below the margin's share of the squares that it is made of
        radius = float(np.sqrt((np.maximum(away, 0) + MARGIN * (self.norm2[rows] + own)).max()))
        k = len(self.nodes)
        self.nodes.append((here, mean[here], radius, rows))
        if len(rows) > LEAF:
            one = rows[int(away.argmax())]
            far = self.norm2[rows] - 2 * self.products(rows, self._dense(one)) + self.norm2[one]
            two = rows[int(far.argmax())]
            near = far - (self.norm2[rows] - 2 * self.products(rows, self._dense(two)) + self.norm2[two])
            cut = near < 0
            if not LEAF // 4 <= cut.sum() <= len(rows) - LEAF // 4:
                cut = np.zeros(len(rows), bool)      # far out ones alone: halves by distance keep the tree flat
                cut[np.argsort(near, kind="stable")[:len(rows) // 2]] = True
            self.nodes[k] = (here, mean[here], radius, (self._build(rows[cut]), self._build(rows[~cut])))
        return k

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        out[self.col[self.start[row]:self.start[row + 1]]] = self.val[self.start[row]:self.start[row + 1]]
        return out

    def bounds(self, items: list[np.ndarray]) -> np.ndarray:
        """(item, node): no row below the node has a larger product with the item."""
        out = np.empty((len(items), len(self.nodes)))
        size = np.array([len(q) for q in items])
        flat, first, root = np.concatenate(items), np.cumsum(size) - size, np.sqrt(size)
        dense = np.zeros(self.width)
        for k, (here, mean, radius, _) in enumerate(self.nodes):
            dense[here] = mean
            out[:, k] = np.add.reduceat(dense[flat], first) + root * radius
            dense[here] = 0.0
        return out * (1 + MARGIN) + MARGIN


def search(tree: BallTree, items: list[np.ndarray], ids: np.ndarray, best: list[list[tuple[int, int]]], top: int) -> int:
    """Adds a block's rows to ``best``: per item a heap of (score, -id), the worst first. Returns rows scored."""
    if tree.root is None:
        return 0
    bounds, scored = tree.bounds(items), 0
    dense = np.zeros(tree.width, np.int64)
    for q, bound, heap in zip(items, bounds, best):
        dense[q] = 1
        queue = [(-bound[tree.root], tree.root)]
        while queue:
            upper, node = heapq.heappop(queue)
            if len(heap) == top and -upper < heap[0][0]:
                break
            below = tree.nodes[node][3]
            if isinstance(below, tuple):
                for c in below:
                    if len(heap) < top or bound[c] >= heap[0][0]:
                        heapq.heappush(queue, (-bound[c], c))
                continue
            scores = tree.products(below, dense)
            scored += len(below)
            for i in np.flatnonzero(scores >= (heap[0][0] if len(heap) == top else 1)).tolist():
                row = (int(scores[i]), -int(ids[below[i]]))
                if len(heap) < top:
                    heapq.heappush(heap, row)
                elif row > heap[0]:
                    heapq.heapreplace(heap, row)
        dense[q] = 0
    return scored


def _frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): rows with a term; ``term`` and ``tf`` as little-endian 32-bit arrays, terms of the items only."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in slices(batches, "text"):
            out: list[list] = [[], [], [], []]
            for doc, text in zip(longs(b.column("doc_id"), -NULL_ID - 1).tolist(), b.column("text").to_pylist()):
                words = terms(text)
                if not words:
                    continue
                tf = Counter(map(get, words))
                tf.pop(None, None)
                keys = np.array(sorted(tf), "<i4")
                for o, v in zip(out, (doc, len(words), keys.tobytes(), np.array([tf[k] for k in keys.tolist()], "<i4").tobytes())):
                    o.append(v)
            yield batch(["doc_id", "n", "term", "tf"], [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                                        pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())])

    return docs.mapInArrow(task, "doc_id long, n long, term binary, tf binary")


def _document_frequencies(rows: DataFrame) -> DataFrame:
    """(term, df); a task sends a row per term."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for data in b.column("term").to_pylist():
                t = np.frombuffer(data, "<i4")
                if len(t):
                    if t[-1] >= len(total):
                        total = np.concatenate([total, np.zeros(int(t[-1]) + 1 + len(total), np.int64)])
                    total[t] += 1
        here = np.flatnonzero(total)
        yield batch(["term", "df"], [here.astype(np.int32), total[here]])

    return rows.select("term").mapInArrow(task, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _block(docs: DataFrame, items: list[tuple[object, list[bytes]]], top: int, id_type: str) -> DataFrame:
    """The best documents of a bounded set of items: item, doc_id, score."""
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, ts in items for t in ts}))}
    rows = written(_frequencies(docs, vocabulary), "term-frequencies")
    n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in _document_frequencies(rows).collect():       # a row per term of the items
        weights[term] = weight(n_docs, df)
    sets = [np.array(sorted(vocabulary[t] for t in set(ts)), np.int64) for _, ts in items]
    shared = spark.sparkContext.broadcast((weights, sets))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sets = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in sets]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            ids, size, col, val = (np.concatenate(x) for x in zip(*held))
            tree = BallTree(np.concatenate([[0], np.cumsum(size)]), col, val, len(weights))
            search(tree, sets, ids, best, top)
            held.clear()

        for b in batches:
            ids, n = longs(b.column("doc_id")), longs(b.column("n"))
            m = length_factor(n, n_docs, n_terms)
            cols = [np.frombuffer(x, "<i4") for x in b.column("term").to_pylist()]
            size = np.array([len(c) for c in cols], np.int64)
            if not size.sum():
                continue
            col = np.concatenate(cols).astype(np.int64)
            tf = np.concatenate([np.frombuffer(x, "<i4") for x in b.column("tf").to_pylist()]).astype(np.int64)
            val = weights[col] * ((SCALE * tf) // (1000 * tf + SATURATION * np.repeat(m, size)))
            keep = val > 0
            size = np.add.reduceat(np.append(keep, 0), np.cumsum(size) - size) * (size > 0)
            col, val = col[keep], val[keep]
            some = size > 0
            held.append((ids[some], size[some], col, val))
            if sum(len(h[2]) for h in held) >= BLOCK_TERMS:
                flush()
        if held:
            flush()
        found = [(i, -doc, score) for i, heap in enumerate(best) for score, doc in heap]
        if found:
            i, doc, score = zip(*found)
            yield batch(["item", "doc_id", "score"], [pa.array(i, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())])

    found = rows.mapInArrow(task, "item int, doc_id long, score long")
    first = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    found = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], f"item int, item_id {id_type}")
    doc = F.when(F.col("doc_id") != -NULL_ID - 1, F.col("doc_id"))
    return found.join(F.broadcast(names), "item").select("item_id", "rank", doc.alias("doc_id"), "score")


def rank(docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Each item's ``top`` highest-scoring documents: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = next(t for c, t in items.dtypes if c == item_id)
    items = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        texts: dict[object, list[bytes]] = {}
        for row in part.collect():                                # at most about ITEM_BYTES
            texts.setdefault(row["item_id"], []).extend(terms(row["text"]))
        wanted = [(i, ts) for i, ts in texts.items() if ts]
        if wanted:
            out = out.unionByName(_block(docs, wanted, top, kind))
    return out
