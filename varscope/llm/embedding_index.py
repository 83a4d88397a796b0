"""Embedding near-duplicates through an inverted multi-index.

Vectors are scaled to length one and cut into halves; k-means on each half of a bounded sample
gives two codebooks, whose product is a grid of cells. Every vector is indexed in its cell. A
vector visits cells in the order of the sum of its halves' distances to the two centres (the
multi-sequence order) until the target recall: the number of cells to visit is the quantile of
the place at which vectors of exactly the threshold's cosine, in random directions from sample
vectors, are met. Every visit is verified by the cosine in double precision.

Of two cells only the vector in the lower one visits the other, so that a pair is met once.
A cell and its visitors are compared in blocks of :data:`BLOCK` by :data:`BLOCK`, however many
there are. A block returns no pairs: how many links each vector has in it, and one edge for each
vector to the least vector of its component in the block. Equal vectors are one entry with a count.

Vectors of different lengths do not link. Each length has an index and a sample of its own; of a length
with at most :data:`PER_CELL` different vectors all are in one cell.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; a null vec_id sorts before all others;
rows of one id are counted one by one; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, longs, raw, written
from .components import components

SAMPLE = 20_000
TRIALS = 2_000
#: Vectors that a cell should hold on average, which sets the size of the codebooks.
PER_CELL = 200
MAX_CODES = 1024
#: Cells that an index has at most.
CELLS = MAX_CODES ** 2
RECALL = 0.99
BLOCK = 2_000
ROUNDS = 12


def kmeans(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centres).argmin(axis=1)
        for j in range(len(centres)):
            own = x[near == j]
            if len(own):
                centres[j] = own.mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, less the vectors' own squares."""
    return (centres ** 2).sum(axis=1) - 2 * x @ centres.T


class MultiIndex:
    """Two codebooks, and how many cells to visit."""

    def __init__(self, sample: np.ndarray, threshold: float, codes: int, recall: float = RECALL, seed: int = 1):
        self.half = sample.shape[1] // 2
        self.books = (kmeans(sample[:, :self.half], codes, seed), kmeans(sample[:, self.half:], codes, seed + 1))
        rng = np.random.default_rng(seed + 2)
        x = sample[rng.choice(len(sample), min(len(sample), TRIALS), replace=False)]
        step = rng.normal(size=x.shape)
        step -= (step * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(step, axis=1, keepdims=True)
        other = threshold * x + np.sqrt(1 - threshold ** 2) * step / np.where(size > 0, size, 1)
        cost, own = self.costs(x), self.cells(other)
        place = (cost < np.take_along_axis(cost, own[:, None], axis=1)).sum(axis=1) + 1
        self.visits = int(np.quantile(place, recall, method="higher"))

    def costs(self, x: np.ndarray) -> np.ndarray:
        """The sum of both halves' distances for each cell."""
        a, b = nearest(x[:, :self.half], self.books[0]), nearest(x[:, self.half:], self.books[1])
        return (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = nearest(x[:, :self.half], self.books[0]), nearest(x[:, self.half:], self.books[1])
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def visited(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the first cells of each vector's multi-sequence. The k-th cell of the order
        pairs an i-th and a j-th nearest centre with i * j <= k, so only those pairs are looked at."""
        a, b = nearest(x[:, :self.half], self.books[0]), nearest(x[:, self.half:], self.books[1])
        na, nb = np.argsort(a, axis=1), np.argsort(b, axis=1)
        t = min(self.visits, a.shape[1] * b.shape[1])
        i, j = np.array([(i, j) for i in range(a.shape[1]) for j in range(min(b.shape[1], t // (i + 1)))]).T
        cost = np.take_along_axis(a, na[:, i], axis=1) + np.take_along_axis(b, nb[:, j], axis=1)
        first = np.argpartition(cost, t - 1, axis=1)[:, :t]
        cell = np.take_along_axis(na[:, i], first, axis=1) * b.shape[1] + np.take_along_axis(nb[:, j], first, axis=1)
        return np.repeat(np.arange(len(x)), t), cell.ravel()


def _units(blobs: np.ndarray, off: np.ndarray) -> np.ndarray:
    return _scaled(blobs.view("<f8").reshape(len(off) - 1, -1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(table: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, blob): components as doubles in bytes, null where a vector links with nothing."""
    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x = np.array([np.nan if e is None else e for e in v], "<f8") if v else np.zeros(0)
                out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "blob"])

    return table.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), vector).mapInArrow(run, "id long, blob binary")


def _index(same: DataFrame, width: int, n: int, threshold: float, recall: float) -> MultiIndex:
    """The index of ``n`` vectors of ``width`` bytes."""
    sample = same.orderBy(F.xxhash64("blob")).select("blob").limit(SAMPLE).collect()
    x = np.frombuffer(b"".join(r["blob"] for r in sample), "<f8").reshape(-1, width // 8)
    codes = int(np.clip(round((n / PER_CELL) ** 0.5), 2, MAX_CODES))
    return MultiIndex(_scaled(x), threshold, codes, recall)


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.95,
                    recall: float = RECALL) -> DataFrame:
    """One row per vector: id, n_links, component_id (least id that links reach), kept."""
    every = written(vectors(table, id_col, vector), "vectors")
    classes = written(every.filter("blob is not null").groupBy("blob").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("times")),
                      "distinct-vectors")
    widths = {r["w"]: r["n"] for r in classes.groupBy(F.octet_length("blob").alias("w")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy("w").collect()}                                        # a row a length
    null = F.lit(NULL_ID)
    if not widths:
        return every.select(F.nullif("id", null).alias(id_col), F.lit(0).cast("long").alias("n_links"),
                            F.nullif("id", null).alias("component_id"), F.lit(True).alias("kept"))
    indexes = {w: _index(classes.filter(F.octet_length("blob") == w), w, n, threshold, recall)
               for w, n in widths.items() if n > PER_CELL}

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            blobs, off = raw(b.column("blob"))
            width = np.diff(off)
            own, rows, cells = np.empty(len(width), np.int64), [], []
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                own[at] = w * CELLS                       # cells of different lengths have different numbers
                if w not in indexes:                      # few vectors: all in one cell
                    continue
                u = _units(*raw(b.column("blob").take(pa.array(at))))
                own[at] += indexes[w].cells(u)
                row, cell = indexes[w].visited(u)
                row, cell = at[row], w * CELLS + cell
                later = cell > own[row]
                rows.append(row[later])
                cells.append(cell[later])
            row, cell = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, cells))
            pick = np.concatenate([np.arange(len(own)), np.arange(len(own)), row])
            kind = np.repeat([0, 1, 2], [len(own), len(own), len(row)]).astype(np.int8)   # member, own visitor, visitor
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([own, own, cell]), pa.int64()), pa.array(kind), b.column("node").take(pa.array(pick)),
                 b.column("times").take(pa.array(pick)), b.column("blob").take(pa.array(pick))],
                ["cell", "kind", "node", "times", "blob"])

    placed = classes.select("node", "times", "blob").mapInArrow(place, "cell long, kind byte, node long, times long, blob binary")
    sizes = written(placed.groupBy("cell").agg(F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).alias("members"),
                                               F.sum(F.when(F.col("kind") > 0, 1).otherwise(0)).alias("visitors"))
                    .filter("members > 0")                                    # a row a cell
                    .select(F.col("cell").alias("_c"), F.ceil(F.col("members") / BLOCK).cast("int").alias("m"),
                            F.ceil(F.col("visitors") / BLOCK).cast("int").alias("v")), "cells")
    # a member is in one of m rows of blocks and all v columns, a visitor in one column and all rows
    spread = F.pmod(F.xxhash64("node"), F.when(F.col("kind") == 0, F.col("m")).otherwise(F.col("v")))
    dealt = (placed.join(sizes, F.col("cell") == F.col("_c"))
             .withColumn("own", spread).withColumn("other", F.explode(F.sequence(
                 F.lit(0), F.when(F.col("kind") == 0, F.col("v")).otherwise(F.col("m")) - 1)))
             .select("cell", F.when(F.col("kind") == 0, F.col("own")).otherwise(F.col("other")).cast("int").alias("row"),
                     F.when(F.col("kind") == 0, F.col("other")).otherwise(F.col("own")).cast("int").alias("column"),
                     "kind", "node", "times", "blob"))

    def compare(t: pa.Table) -> pa.Table:
        kind = t["kind"].to_numpy()
        node, times = longs(t["node"]), longs(t["times"])
        m, v = np.flatnonzero(kind == 0), np.flatnonzero(kind > 0)
        blobs, off = raw(t["blob"])
        u = _units(blobs, off)
        hit = u[v] @ u[m].T >= threshold
        hit &= node[v][:, None] != node[m][None, :]
        links = np.concatenate([hit @ times[m], (hit & (kind[v] == 2)[:, None]).T @ times[v]])
        who = np.concatenate([node[v], node[m]])
        # least node of each component of the block: repeat the least of what is linked until it stays
        label_v, label_m = node[v].copy(), node[m].copy()
        i, j = np.nonzero(hit)
        while len(i):
            before = label_v.sum(dtype=object), label_m.sum(dtype=object)
            least = np.minimum(label_v[i], label_m[j])
            np.minimum.at(label_v, i, least)
            np.minimum.at(label_m, j, least)
            if before == (label_v.sum(dtype=object), label_m.sum(dtype=object)):
                break
        least = np.concatenate([label_v, label_m])
        some = links > 0
        return pa.table({"node": who[some], "links": links[some].astype(np.int64), "least": least[some]})

    met = written(dealt.groupBy("cell", "row", "column").applyInArrow(compare, "node long, links long, least long"), "links")
    counts = met.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "_n")
    labels = components(met.select(F.col("node").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "_l")
    found = (classes.join(counts, F.col("node") == F.col("_n"), "left").join(labels, F.col("node") == F.col("_l"), "left")
             .select(F.col("blob").alias("_b"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n"),
                     F.coalesce("label", "node").alias("c")))
    out = every.join(found, F.col("blob") == F.col("_b"), "left")
    component = F.coalesce("c", "id")
    return out.select(F.nullif("id", null).alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                      F.nullif(component, null).alias("component_id"), (F.col("id") == component).alias("kept"))
