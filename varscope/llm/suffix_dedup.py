"""Substring dedup over bytes by a hash-compared suffix sort.

Every window of ``length`` bytes has a seed: of the windows of ``seed`` bytes in it, the leftmost
with the least hash. Equal windows have equal seeds at the same place, so:

1. each block of documents asks which of its seeds occur elsewhere; seeds that occur once
   anywhere end here;
2. for the others, the stretch of text around the seed that holds all windows of this seed goes
   to the bucket of the seed, once a block if the block holds it more than once;
3. a bucket sorts, for each seed, the suffixes that begin at the windows by merge sort. Two
   suffixes are compared by their common extension, found by binary search over prefix
   polynomial hashes, and the byte after it; neighbours with a common extension of ``length``
   are verified byte by byte. In each class of equal windows all but the first are repeats.
   Whole stretches that are equal are sorted once.

Seeds with more than ``hot`` occurrences (a line that a third of all documents share has a
different stretch in each) would gather in one bucket. Their windows are dealt one by one, by
the windows' own hashes, once a block each, and the first occurrence is found there.

Defined results: null text is empty; a text shorter than ``length`` can still lose windows only
if it has some, so it loses nothing; a null doc_id sorts before all others; equal rows (same id,
same text) are not before each other, so both stay; an empty table gives an empty table; other
columns are kept in ``row``. Matches never cross documents; a window may repeat an earlier one of
its own document, also an overlapping one. The text of a span may end inside a character: the
kept bytes are binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import MESSAGE, contents, in_blocks, ordered, send, shared, squeeze, told, unsqueeze
from .common import NULL_ID
from .hashing import Prefix, anchors, cover, member, mix

WINDOW = 100
SEED = 32
HOT = 256
VERIFY = 200_000
U = np.uint64
LETTER = "bucket int, block int, windows binary, firsts binary, stretches binary, hot binary"
REPLY = "block int, windows binary, stretches binary, masks binary, hot binary"


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, ``count`` times."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def bucket_of(seeds: np.ndarray, buckets: int) -> np.ndarray:
    return (((seeds * U(0x9FB21C651E98DF25)) >> U(33)) % U(buckets)).astype(np.int64)


class Seeds:
    """The seeds of a block: hash, place, first window and number of windows, and the stretch's hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int, seed: int):
        self.prefix = Prefix(data)
        grams = self.prefix.grams(seed)
        self.at, self.first, last = anchors(grams, off, length, seed)
        self.count = last - self.first + 1
        self.hash = grams[self.at]
        del grams
        size = self.count + (length - 1)
        shape = (self.at - self.first).astype(U) << U(32) | size.astype(U)
        self.stretch = mix(self.prefix.of(self.first, self.first + size) ^ mix(shape + U(1)) ^ self.hash)
        self.doc = np.searchsorted(off, self.at, side="right") - 1

    def windows(self, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of some seeds."""
        starts = spread(self.first[rows], self.count[rows])
        return starts, mix(self.prefix.of(starts, starts + length))


def longest(prefix: Prefix, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common extensions of the suffixes at ``a`` and ``b``, ``limit`` at most: binary search over hashes."""
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), limit)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = prefix.of(a, a + mid) == prefix.of(b, b + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def suffix_sort(prefix: Prefix, data: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes within their groups by their first ``limit`` bytes: a bottom-up merge
    sort of all groups at once; each element's place in the merge is its rank in the other run,
    found by binary search with comparisons by :func:`longest`."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(g)))
    size, begin = np.repeat(size, size), np.repeat(begin, size)
    rank = np.arange(len(g)) - begin
    width, most = 1, int(size.max(initial=0))
    while width < most:
        run = rank // width
        lo = begin + (run ^ 1) * width
        act = np.flatnonzero(lo < begin + size)
        end = begin + size
        place = begin + (run // 2) * 2 * width + rank - run * width
        low, high = lo[act], np.minimum(lo[act] + width, end[act])
        base, own, right = low.copy(), starts[order[act]], (run[act] & 1).astype(bool)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            other, mine = starts[order[mid]], own[open_]
            ext = longest(prefix, other, mine, limit)
            at = np.minimum(ext, limit - 1)
            a, b = data[other + at], data[mine + at]
            before = np.where(ext < limit, a < b, right[open_])      # equal ones: the left run's go first
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        place[act] += low - base
        moved = np.empty_like(order)
        moved[place] = order
        order = moved
        width *= 2
    return order


def repeats(data: np.ndarray, starts: np.ndarray, group: np.ndarray, turn: np.ndarray, length: int) -> np.ndarray:
    """Which windows equal one of their group with a smaller ``turn``."""
    if not len(starts):
        return np.zeros(0, bool)
    prefix = Prefix(data)
    order = suffix_sort(prefix, data, starts, group, length)
    s, g = starts[order], group[order]
    same = np.zeros(len(s), bool)
    same[1:] = g[1:] == g[:-1]
    k = np.flatnonzero(same)
    same[k] = longest(prefix, s[k - 1], s[k], length) == length
    k = np.flatnonzero(same)
    for lo in range(0, len(k), VERIFY):                    # collisions of the hashes end here
        part = k[lo:lo + VERIFY]
        span = np.arange(length)
        same[part] = (data[s[part - 1][:, None] + span] == data[s[part][:, None] + span]).all(axis=1)
    begin = np.flatnonzero(~same)
    least = np.minimum.reduceat(turn[order], begin)
    out = np.empty(len(s), bool)
    out[order] = least[np.cumsum(~same) - 1] < turn[order]
    return out


def _stretches(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """The arrays of :func:`deduplicate`'s stretches of several blocks, one after the other."""
    parts = [[] for _ in range(7)]
    for blob in blobs:
        raw = unsqueeze(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        head = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
        shape = np.frombuffer(raw, np.int32, 2 * n, 8 + 24 * n).reshape(2, n)
        parts[0].append(head[0].view(U)), parts[1].append(head[1]), parts[2].append(head[2])
        parts[3].append(shape[0]), parts[4].append(shape[1])
        parts[5].append(np.frombuffer(raw, np.uint8, -1, 8 + 32 * n))
        parts[6].append(np.full(1, n))
    return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)


def compare(seed: np.ndarray, doc: np.ndarray, pos: np.ndarray, lead: np.ndarray, count: np.ndarray, text: np.ndarray,
            length: int, seed_size: int) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of several blocks: their hashes and, a row each, which windows are repeats."""
    size = count + (length - 1)
    begin = np.cumsum(size) - size
    prefix = Prefix(text)
    shape = lead.astype(U) << U(32) | size.astype(U)
    name = mix(prefix.of(begin, begin + size) ^ mix(shape + U(1)) ^ seed)
    del prefix
    mask = np.zeros((len(seed), length - seed_size + 1), bool)
    order = np.lexsort((pos, doc, name, seed))
    s, c = seed[order], name[order]
    new_seed = np.concatenate([[True], s[1:] != s[:-1]])
    new = new_seed | np.concatenate([[True], c[1:] != c[:-1]])
    leader = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    late = np.empty(len(order), bool)
    late[order] = (doc[leader] < doc[order]) | (doc[leader] == doc[order]) & (pos[leader] < pos[order])
    head = order[new]                                       # one of each distinct stretch, its first
    per = np.diff(np.append(np.flatnonzero(new_seed[new]), len(head)))
    several = head[np.repeat(per > 1, per)]
    turn = np.empty(len(seed), np.int64)
    turn[np.lexsort((pos, doc))] = np.arange(len(seed))
    n = count[several]
    row = np.repeat(several, n)
    j = spread(np.zeros(len(several), np.int64), n)
    key = seed[row] ^ mix((lead[row] - j).astype(U) + U(7))       # equal windows hold the seed at the same place
    flag = repeats(text, begin[row] + j, np.unique(key, return_inverse=True)[1], turn[row], length)
    mask[row, j] = flag
    mask[order] = np.where(late[order][:, None], np.arange(mask.shape[1]) < count[order][:, None], mask[leader])
    return name, mask


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = WINDOW, seed: int = SEED,
                hot: int = HOT, keep_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and,
    with ``keep_bytes``, ``kept`` (binary), ``spans`` (array of start and end) and ``row``."""
    blocks, buckets = in_blocks(docs, id_col, text, keep_row=keep_bytes)

    def ask(t: pa.Table) -> pa.Table:
        block, _, data, off = contents(ordered(t))
        h, n = np.unique(Seeds(data, off, length, seed).hash, return_counts=True)
        return send(block, h, buckets, np.minimum(n, 255).astype(np.uint8))

    def tell(t: pa.Table, survivors: pa.Table) -> pa.Table:
        block, ids, data, off = contents(ordered(t))
        seeds = Seeds(data, off, length, seed)
        own, back, n = np.unique(seeds.hash, return_inverse=True, return_counts=True)
        many = told(survivors, "hot")
        is_hot = member(own, many)[back]
        alive = (member(own, told(survivors)) | (n > 1))[back] & ~is_hot
        rows: dict[int, list] = {}
        # hot seeds: windows by their own hash, the first of each in this block
        starts, h = seeds.windows(np.flatnonzero(is_hot), length)
        h, k = np.unique(h, return_index=True)
        doc = np.searchsorted(off, starts[k], side="right") - 1
        for r in send(block, h, buckets, ids[doc], starts[k] - off[doc]).to_pylist():
            rows[r["bucket"]] = [r["hashes"], r["firsts"], None]
        # the others: each distinct stretch, its first in this block
        at = np.flatnonzero(alive)
        at = at[np.unique(seeds.stretch[at], return_index=True)[1]]
        to = bucket_of(seeds.hash[at], buckets)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
            r = at[order[lo:hi]]
            size = seeds.count[r] + (length - 1)
            blob = squeeze(np.array([len(r)]), seeds.hash[r], ids[seeds.doc[r]], seeds.at[r] - off[seeds.doc[r]],
                           (seeds.at - seeds.first)[r].astype(np.int32), seeds.count[r].astype(np.int32),
                           data[spread(seeds.first[r], size)])
            rows.setdefault(int(to[order[lo]]), [b"", b"", None])[2] = blob
        hot_own = own[member(own, many)].tobytes()
        if hot_own:
            rows.setdefault(block % buckets, [b"", b"", None])
        return pa.table([pa.array(list(rows), pa.int32()), pa.array([block] * len(rows), pa.int32()),
                         pa.array([x[0] for x in rows.values()], pa.binary()), pa.array([x[1] for x in rows.values()], pa.binary()),
                         pa.array([x[2] for x in rows.values()], pa.binary()),
                         pa.array([hot_own if hot_own and b == block % buckets else None for b in rows], pa.binary())],
                        names=[f.split()[0] for f in LETTER.split(", ")])

    def judge(t: pa.Table) -> pa.Table:
        block = t["block"].to_pylist()
        out = [[b, b"", b"", b"", x or b""] for b, x in zip(block, t["hot"].to_pylist())]
        hs = [np.frombuffer(x, U) for x in t["windows"].to_pylist()]
        every = np.concatenate(hs)
        if len(every):
            firsts = [np.frombuffer(unsqueeze(x), np.int64).reshape(2, -1) for x in t["firsts"].to_pylist() if x]
            doc, pos = np.concatenate(firsts, axis=1)
            order = np.lexsort((pos, doc, every))
            s = every[order]
            new = np.concatenate([[True], s[1:] != s[:-1]])
            lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            late = np.empty(len(every), bool)
            late[order] = (doc[lead] < doc[order]) | (doc[lead] == doc[order]) & (pos[lead] < pos[order])
            end = 0
            for r, h in zip(out, hs):
                r[1] = h[late[end:end + len(h)]].tobytes()
                end += len(h)
        blobs = t["stretches"].to_pylist()
        have = [k for k, x in enumerate(blobs) if x]
        if have:
            seed_hash, doc, pos, lead, count, body, n = _stretches([blobs[k] for k in have])
            name, mask = compare(seed_hash, doc, pos, lead.astype(np.int64), count.astype(np.int64), body, length, seed)
            said = mask.any(axis=1)
            bits = np.packbits(mask, axis=1)
            for k, e, m in zip(have, np.cumsum(n), n):
                pick = np.flatnonzero(said[e - m:e]) + e - m
                out[k][2], out[k][3] = name[pick].tobytes(), bits[pick].tobytes()
        out = [r for r in out if r[1] or r[2] or r[4]]
        return pa.table([pa.array([r[k] for r in out], pa.int32() if not k else pa.binary()) for k in range(5)],
                        names=[f.split()[0] for f in REPLY.split(", ")])

    def remove(t: pa.Table, reply: pa.Table) -> pa.Table:
        t = ordered(t)
        _, ids, data, off = contents(t)
        seeds = Seeds(data, off, length, seed)
        wide = length - seed + 1
        flagged = []
        # hot seeds
        many = np.unique(told(reply, "hot"))
        starts, h = seeds.windows(np.flatnonzero(member(seeds.hash, many)), length)
        if len(starts):
            flag = member(h, told(reply, "windows")) | _after_first(h, starts, ids, off)
            flagged.append(starts[flag])
        # the others
        cold = np.flatnonzero(~member(seeds.hash, many))
        name = seeds.stretch[cold]
        again = _after_first(name, seeds.at[cold], ids, off)
        mask = np.arange(wide) < (seeds.count[cold] * again)[:, None]
        names = np.concatenate([np.frombuffer(x, U) for x in reply["stretches"].to_pylist()] or [np.zeros(0, U)])
        if len(names):
            bits = np.concatenate([np.frombuffer(x, np.uint8) for x in reply["masks"].to_pylist()]).reshape(len(names), -1)
            by = np.argsort(names)
            k = by[np.minimum(np.searchsorted(names[by], name), len(names) - 1)]
            hit = names[k] == name
            mask[hit] |= np.unpackbits(bits[k[hit]], axis=1, count=wide).astype(bool)
        r, j = np.nonzero(mask)
        flagged.append(seeds.first[cold][r] + j)
        gone = cover(np.concatenate(flagged), length, len(data))
        return _result(t, ids, data, off, gone, keep_bytes)

    replies = shared(blocks.groupBy("block").applyInArrow(ask, MESSAGE), hot)
    names = [f.split()[0] for f in LETTER.split(", ")]
    letters = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        lambda a, b: tell(a, b).select(names), LETTER)
    verdicts = letters.groupBy("bucket").applyInArrow(judge, REPLY)
    schema = T.StructType()
    for name, kind in [("doc_id", "long"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")]:
        schema.add(name, kind)
    if keep_bytes:
        schema.add("kept", "binary").add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("row", blocks.schema["row"].dataType)
    out = blocks.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(remove, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def _after_first(h: np.ndarray, at: np.ndarray, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which of a block's occurrences come after the block's first one of the same hash: texts
    stand in the order of ids, so only those of equal id need their places compared."""
    d = np.searchsorted(off, at, side="right") - 1
    doc, pos = ids[d], at - off[d]
    order = np.lexsort((pos, doc, h))
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])[:len(s)]
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(h), bool)
    out[order] = (doc[lead] < doc[order]) | (pos[lead] < pos[order])
    return out


def _result(t: pa.Table, ids: np.ndarray, data: np.ndarray, off: np.ndarray, gone: np.ndarray, keep_bytes: bool) -> pa.Table:
    before = np.concatenate([[0], np.cumsum(gone)])
    edge = np.zeros(len(data), bool)
    edge[off[:-1][off[:-1] < len(data)]] = True
    begins = gone.copy()
    begins[1:] &= ~gone[:-1] | edge[1:]
    spans_before = np.concatenate([[0], np.cumsum(begins)])
    lost, spans = np.diff(before[off]), np.diff(spans_before[off])
    ends = gone.copy()
    ends[:-1] &= ~gone[1:] | edge[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sha, kept, where = [], [], []
    for d in range(len(ids)):
        lo, hi = off[d], off[d + 1]
        body = (data[lo:hi][~gone[lo:hi]] if lost[d] else data[lo:hi]).tobytes()
        sha.append(hashlib.sha256(body).hexdigest())
        if keep_bytes:
            kept.append(body)
            k = slice(spans_before[lo], spans_before[hi])
            where.append([{"start": int(a - lo), "end": int(b - lo)} for a, b in zip(first[k], last[k])])
    cols = {"doc_id": pa.array(ids), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(lost.astype(np.int64)),
            "n_spans": pa.array(spans.astype(np.int64)), "kept_sha256": pa.array(sha, pa.string())}
    if keep_bytes:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        cols |= {"kept": pa.array(kept, pa.binary()), "spans": pa.array(where, kind), "row": t["row"]}
    return pa.table(cols)
