"""Best-fit packing of token sequences by few-document patterns.

Pieces of documents are packed into sequences of ``capacity`` tokens. Only the histogram of
piece lengths (at most ``capacity`` numbers, whatever the input) is brought to the driver:

1. enumerate the patterns of two and three lengths that fill a sequence exactly;
2. fit how often to repeat each by non-negative least squares against the histogram;
3. round down, never using more pieces of a length than there are;
4. pack the residual histogram best-fit, longest first, by counts.

The plan says which ranks of which length go to which sequence and place. Each piece learns
its rank among the pieces of its length from counts by (input partition, length), so pieces
are never gathered by length, and the plan is looked up in each task.

Defined results: null text is an empty text, a piece with the end id alone; a longer document
is cut into pieces of ``capacity``, of which the first may be shorter; rows with equal or null
doc_id are packed one by one; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import batch, make_room, raw, slices, written
from .token_files import END_ID, tokenize
from .tokens import codec

CAPACITY = 1024
NNLS_STEPS = 300


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (a, b, c), a <= b <= c, of present lengths with a + b + c = capacity; a is 0 in pairs."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    present[0] = True
    a, b = np.meshgrid(np.arange(capacity // 3 + 1), np.arange(capacity // 2 + 1), indexing="ij")
    c = capacity - a - b
    ok = (a <= b) & (b <= c) & (b > 0) & present[a] & present[b] & present[np.clip(c, 0, capacity)]
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def fit(rows: np.ndarray, histogram: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """Repeats x >= 0 of the patterns that minimise |Ax - histogram|^2, by multiplicative updates."""
    target = histogram.astype(float)
    target[0] = 0
    size = len(histogram)

    def spread(x):
        out = sum(np.bincount(rows[:, k], x, size) for k in range(3))
        out[0] = 0
        return out

    def gather(h):
        return h[rows].sum(axis=1)

    x = np.maximum(gather(target), 1e-12)
    x *= target.sum() / max(spread(x).sum(), 1e-12)
    up = gather(target)
    for _ in range(steps):
        x *= up / np.maximum(gather(spread(x)), 1e-12)
    return x


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (lengths in a sequence, how many such sequences)."""
    room: dict[int, list] = defaultdict(list)      # free tokens -> [(lengths, count)]
    done = []
    for n in range(capacity, 0, -1):
        left = int(histogram[n])
        while left:
            free = next((f for f in range(n, capacity) if room.get(f)), None)
            if free is None:
                each = min(capacity // n, left)
                lengths, count = (n,) * each, left // each
                left -= each * count
            else:
                base, have = room[free].pop()
                count = min(have, left)
                if count < have:
                    room[free].append((base, have - count))
                lengths = (*base, n)
                left -= count
            rest = capacity - sum(lengths)
            if rest:
                room[rest].append((lengths, count))
            else:
                done.append((lengths, count))
    return done + [x for v in room.values() for x in v]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences) for all pieces of the histogram."""
    left = histogram.astype(np.int64).copy()
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    rows = patterns(np.flatnonzero(left), capacity)
    if len(rows):
        x = fit(rows, left)
        for k in np.argsort(-x, kind="stable"):
            times = int(x[k])
            if not times:
                break
            used = [int(v) for v in rows[k] if v]
            times = min([times, *(int(left[v]) // used.count(v) for v in used)])
            if times:
                for v in used:
                    left[v] -= times
                out.append((tuple(used), times))
    return out + best_fit(left, capacity)


def places(packed: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For each run of ranks of a length: (length << 44 | first rank), its first sequence, its offset."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, count in packed:
        at = 0
        for n in lengths:
            rows.append((n << 44 | taken[n], sequence, at))
            taken[n] += count
            at += n
        sequence += count
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3


def pieces(docs: DataFrame, tokenizer: str, cut: str, capacity: int = CAPACITY, end_id: int = END_ID,
           keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, [ids], part, nth (among the pieces of its length in its part)."""
    enc = codec(tokenizer, cut)
    wide = enc.dtype.str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            values, off = raw(b.column("ids"))
            values, ends = values.view(wide).astype("<u4"), off[1:] // np.dtype(wide).itemsize
            total = np.diff(ends, prepend=0)
            count = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = total - (count - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            at = (ends - total)[row] + start
            order = np.argsort(length, kind="stable")
            runs = np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(seen, runs)
            seen += runs
            crc = [zlib.crc32(values[s:s + n]) for s, n in zip(at, length)]
            cols = [b.column("doc_id").take(pa.array(row)), piece.astype(np.int32), start, length, pa.array(crc, pa.int64()),
                    np.full(len(row), part, np.int32), nth]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if keep_ids:
                offsets = np.concatenate([at, ends[-1:]])
                cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view("<i4"))))
                names.append("ids")
            yield batch(names, cols)
        make_room(tokenizers=False)

    return tokenize(docs, tokenizer, cut, end_id).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, tokenizer: str, cut: str = "byte", capacity: int = CAPACITY, end_id: int = END_ID,
         keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset."""
    cutup = written(pieces(docs, tokenizer, cut, capacity, end_id, keep_ids), "pieces")
    counts = written(cutup.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():      # at most ``capacity`` rows
        histogram[r["length"]] = r["n"]
    key, sequence, offset = places(plan(histogram, capacity))
    before = (counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n"))
              .select(F.col("part").alias("_p"), F.col("length").alias("_l"), "before"))
    ranked = cutup.join(before, (F.col("part") == F.col("_p")) & (F.col("length") == F.col("_l"))) \
        .withColumn("rank", F.col("before") + F.col("nth"))
    keep = [c for c in cutup.columns if c not in ("part", "nth")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                want = b.column("length").to_numpy() << 44 | b.column("rank").to_numpy()
                k = np.searchsorted(key, want, side="right") - 1
                yield batch([*keep, "sequence_id", "offset"],
                            [*[b.column(c) for c in keep], sequence[k] + (want - key[k]), offset[k]])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cutup.schema if f.name in keep)
    return ranked.select(*keep, "rank").mapInArrow(place, schema + ", sequence_id long, offset long")
