"""Exact self-join of documents by Jaccard similarity of word n-grams.

Candidates by the pigeonhole on a partition of the universe. For two sets of similarity
``threshold`` whose larger one is in a size band, the symmetric difference is at most D, known
from the band. Shingles are hashed into D + 1 + e segments, so at least e + 1 segments hold the
same subset in both sets, of which one is not empty if at most e are; a set with more empty
segments than e also sends its empty ones. Where segments would hold too few shingles to tell
sets apart, half of D + 1, and e more, are used, each sent with its subset and all its one-deletion
neighbours, as e + 1 segments must differ by at most one shingle; here segments of at most one
shingle, whose neighbour is the empty set, count as the empty ones. The cheaper allocation is taken
for each band, by the number of signatures and the collisions to expect. A set sends the
signatures of its own band and of the bands that larger partners can be in.

1. Blocks of documents ask which signatures occur more than once. A set in a band must share
   as many as the e + 1 equal segments leave beside its own empty ones.
2. Sets with enough shared signatures ask which of their shingles occur in another such set. A set
   with less than ``threshold`` of its shingles in others links with nothing, and two sets of
   which one has too few such shingles for their sizes don't link. This takes the many variants
   of one text apart without comparing them.
3. The sets that are left are compared exactly: first each with the least set, the hub, of each
   of its signatures. Pairs within a component need no further look. Signatures count on whose
   other sets are of several components. Sets that link share as many of them as step 1 asks,
   so a set leaves out its most frequent ones, all but one of that number (in one order for all
   sets, those that two sets keep then meet); with fewer it is done. Common lines end here. For
   the signatures that are left, sets are told apart by how they differ from the hub T. Let d(x)
   be the symmetric difference of x and T, and a(x) = |d(x)| - (1-t)/(1+t) |x|. Two sets x, z link
   only if d(x) and d(z) share at least (a(x) + a(z)) / 2 elements, which is above 0 if one of
   them doesn't link with T. What x must share follows from its own sizes and those of T alone.
   So a prefix filter over d, rarest elements first, finds all pairs that may link: variants of
   one text with changes of their own share next to nothing in d. A pair whose lists are too
   short from the place on where they meet is left out at once.

Equal sets are one node (128-bit sums of shingle hashes); copies never make pairs.

Defined results: null or wordless text is an empty set and links with nothing; a text of fewer
than ``n`` words is one shingle; a null doc_id sorts before all others; equal rows are in one
component; an empty table gives an empty table; other columns are kept by
:func:`distinct_documents`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blocks import MESSAGE, contents, in_blocks, ordered, send, shared, told
from .common import NULL_ID, binaries, batch, make_room, raw, slices, written
from .components import components
from .hashing import Prefix, Words, member, mix

U = np.uint64
#: Greatest width of a size band in steps of the threshold, and as a ratio if a step is small enough: the differences
#: that a band allows follow from its largest set, and would fill the segments of its least one.
BAND_STEPS, BAND_RATIO = 3, 1.4
#: Differing elements that a task holds at once.
ELEMENTS = 200_000
#: Bytes of shingle hashes whose signatures a task makes at once.
SIGNED_BYTES = 2 << 20
#: Bytes of sets that go to Python at once.
SET_BYTES = 4 << 20
#: Segments beyond those that empty ones need: so many more signatures must agree.
SPARE = 4
#: What a signature that collides by chance costs, in signatures.
COLLISION = 20.0


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    segments: int
    empty: int          # segments that need not be sent: empty ones or, with deletions, of one shingle at most
    deletions: bool


@lru_cache
def bands(num: int, den: int, largest: int) -> tuple[Band, ...]:
    """Size bands for the threshold num / den up to a set size."""
    out, low = [], 1
    step = den / num
    steps = BAND_STEPS if step == 1 else max(1, min(BAND_STEPS, int(math.log(BAND_RATIO) / math.log(step))))
    while low <= largest:
        high = max(low, math.ceil(low * step ** steps) - 1)
        diff = (den - num) * 2 * high // (den + num)
        lam = low * num / den / (diff + 1)
        mean = (diff + 1) * math.exp(-lam)
        empty = 0 if not diff else math.ceil(mean + 2 * math.sqrt(mean)) + SPARE
        whole = diff + 1 + empty
        half, small = -(-(diff + 1) // 2), 0
        for _ in range(3):
            lam = low * num / den / (half + small)
            mean = (half + small) * (1 + lam) * math.exp(-lam)
            small = round(mean + 2 * math.sqrt(mean))
        half += small
        cost = whole * (1 + COLLISION * math.exp(-low / whole))
        cost_half = (half + high) * (1 + COLLISION * math.exp(-low / half))
        out.append(Band(low, high, half, small, True) if diff and cost_half < cost else Band(low, high, whole, empty, False))
        low = high + 1
    return tuple(out)


class Sets:
    """The shingle sets of a block's texts: hashes sorted within each text, sizes, keys of 128 bits."""

    def __init__(self, data: np.ndarray, off: np.ndarray, n: int):
        words = Words(data, off, lower=True)
        count = np.diff(words.offsets)
        prefix = Prefix(words.hash)
        many = np.maximum(count - n + 1, (count > 0).astype(np.int64))
        text = np.repeat(np.arange(len(count)), many)
        start = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + words.offsets[:-1][text]
        size = np.minimum(count, n)[text]
        h = mix(prefix.of(start, start + size) + size.astype(U))
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(text[order].astype(np.int32), kind="stable")]
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        self.hash, self.text = h[new], text[new]
        self.size = np.bincount(self.text, minlength=len(count))
        self.ends = np.cumsum(self.size)
        self.k1 = self._sum(mix(self.hash ^ U(0x51ED270B9F3A1C77)))
        self.k2 = self._sum(mix(self.hash ^ U(0xB5297A4D3F84D5B5)))

    @classmethod
    def of(cls, hashes: np.ndarray, off: np.ndarray) -> Sets:
        """Sets whose hashes are known; for :meth:`signatures`."""
        out = cls.__new__(cls)
        out.hash, out.size, out.ends = hashes, np.diff(off), off[1:]
        return out

    def _sum(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
        return total[self.ends] - total[self.ends - self.size]

    def distinct(self) -> np.ndarray:
        """The first text of each distinct set that is not empty."""
        k = np.flatnonzero(self.size)
        key = self.k1[k] ^ mix(self.k2[k])
        return np.sort(k[np.unique(key, return_index=True)[1]])

    def signatures(self, texts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, signature, group) of the given texts; a group is a text in a band, and the last array
        has how many signatures of a group must agree with those of a partner."""
        size = self.size[texts]
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        table = bands(num, den, 1 << int(int(size.max()) * den // num).bit_length())
        low = np.array([b.low for b in table])
        own = np.searchsorted(low, size, side="right") - 1
        top = np.searchsorted(low, size * den // num, side="right") - 1     # the last band of a larger partner
        rows, sigs, groups, needs = [], [], [], []
        for step in range(int((top - own).max()) + 1):
            use = np.flatnonzero(own + step <= top)
            band = (own + step)[use]
            for deletions in (False, True):
                part = np.array([table[b].deletions == deletions for b in band], bool)
                if part.any():
                    r, s, need = self._segment(texts[use[part]], band[part], table, deletions)
                    groups.append(r + sum(map(len, needs)))
                    rows.append(texts[use[part]][r]), sigs.append(s), needs.append(need)
        return np.concatenate(rows), np.concatenate(sigs), np.concatenate(groups), np.concatenate(needs)

    def _segment(self, texts: np.ndarray, band: np.ndarray, table: tuple, deletions: bool) -> tuple[np.ndarray, ...]:
        m = np.array([table[b].segments for b in band])
        size = self.size[texts]
        owner = np.repeat(np.arange(len(texts)), size)
        at = np.arange(len(owner)) + np.repeat(self.ends[texts] - size - (np.cumsum(size) - size), size)
        h = self.hash[at]
        base = np.cumsum(m) - m
        slot = base[owner] + (mix(h ^ U(0x2545F4914F6CDD1D)) % m[owner].astype(U)).astype(np.int64)
        value = mix(h + U(0x632BE59BD9B4E019))
        acc = np.zeros(int(m.sum()), U)
        np.add.at(acc, slot, value)
        filled = np.bincount(slot, minlength=len(acc))
        row = np.repeat(np.arange(len(texts)), m)
        name = mix(((band[row].astype(U) << U(40)) | (np.arange(len(acc)) - base[row]).astype(U)) + U(1))
        bare = filled <= deletions
        allowed = np.array([table[b].empty for b in band])
        count = np.bincount(row[bare], minlength=len(texts))
        many = count > allowed
        send_ = ~bare | many[row]
        if deletions:
            row, acc, name, one = (np.concatenate([x, y[slot]]) for x, y in
                                   ((row, row), (acc, acc), (name, name), (send_ | (filled == 1), send_)))
            acc[len(filled):] -= value
            return row[one], mix(acc[one] + name[one]), allowed + 1 - np.minimum(count, allowed)
        # of the allowed + 1 segments that a partner has alike, all but the empty ones are sent by both
        return row[send_], mix(acc[send_] + name[send_]), allowed + 1 - np.minimum(count, allowed)


def _live_sets(docs: DataFrame, id_col: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """One row per document: doc_id, th, n_shingles, k1, k2 and, for one document of a block with a
    set that may have links, hashes (8 bytes each, sorted)."""
    blocks, buckets = in_blocks(docs, id_col, text)

    def ask_signatures(t: pa.Table) -> pa.Table:
        block, _, data, off = contents(ordered(t))
        sets = Sets(data, off, n)
        h, c = np.unique(sets.signatures(sets.distinct(), num, den)[1], return_counts=True)
        return send(block, h, buckets, np.minimum(c, 255).astype(np.uint8))

    def ask_shingles(t: pa.Table, reply: pa.Table) -> pa.Table:
        block, _, data, off = contents(ordered(t))
        sets = Sets(data, off, n)
        row, sig, group, need = sets.signatures(sets.distinct(), num, den)
        own, back, count = np.unique(sig, return_inverse=True, return_counts=True)
        alike = np.bincount(group[(member(own, told(reply)) | (count > 1))[back]], minlength=len(need))
        some = np.zeros(len(sets.size), bool)
        some[row[(alike >= need)[group]]] = True
        h, c = np.unique(sets.hash[some[sets.text]], return_counts=True)
        return send(block, h, buckets, np.minimum(c, 255).astype(np.uint8))

    def tell(t: pa.Table, reply: pa.Table) -> pa.Table:
        t = ordered(t)
        _, ids, data, off = contents(t)
        sets = Sets(data, off, n)
        first = sets.distinct()
        one = np.zeros(len(sets.size), bool)
        one[first] = True
        own, back, count = np.unique(sets.hash, return_inverse=True, return_counts=True)
        local = np.bincount(back[one[sets.text]], minlength=len(own))
        common = (member(own, told(reply)) | (local > 1))[back]
        in_others = np.bincount(sets.text[common], minlength=len(sets.size))
        live = one & (den * in_others >= num * sets.size)
        mine = live[sets.text]
        return pa.table({
            "doc_id": pa.array(ids), "th": t["th"], "n_shingles": pa.array(sets.size.astype(np.int64)),
            "k1": pa.array(sets.k1.view(np.int64)), "k2": pa.array(sets.k2.view(np.int64)), "live": pa.array(live),
            "common": pa.array(in_others.astype(np.int64)),
            "hashes": binaries(sets.hash[mine].view(np.uint8), 8 * np.concatenate([[0], np.cumsum(sets.size * live)]))})

    replies = shared(blocks.groupBy("block").applyInArrow(ask_signatures, MESSAGE), hot=1 << 62)
    asked = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(ask_shingles, MESSAGE)
    common = shared(asked, hot=1 << 62)
    return written(blocks.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(
        tell, "doc_id long, th long, n_shingles long, k1 long, k2 long, live boolean, common long, hashes binary"), "sets")


def _verify(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity. Sets are sorted hashes, 8 bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for b in batches:
            x, xo = raw(b.column("x"))
            y, yo = raw(b.column("y"))
            x, y, xo, yo = x.view(U), y.view(U), xo // 8, yo // 8
            ok = np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                p, q = x[xo[k]:xo[k + 1]], y[yo[k]:yo[k + 1]]
                both = int(member(p, q).sum())
                ok[k] = den * both >= num * (len(p) + len(q) - both)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    x = nodes.select(F.col("node").alias("_a"), F.col("hashes").alias("x"))
    y = nodes.select(F.col("node").alias("_b"), F.col("hashes").alias("y"))
    both = pairs.join(x, F.col("a") == F.col("_a")).select("a", "b", "x").join(y, F.col("b") == F.col("_b"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _mixed(met: DataFrame) -> DataFrame:
    """Rows (sig, node, label) of the signatures that sets of several components have; ``times``: how many sets."""
    mixed = (met.groupBy("sig").agg(F.count(F.lit(1)).alias("times"), F.min("label").alias("lo"), F.max("label").alias("hi"))
             .filter("lo != hi").select(F.col("sig").alias("_s"), "times"))
    return met.join(mixed, F.col("sig") == F.col("_s")).drop("_s")


def _cross_candidates(signed: DataFrame, labels: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b), a > b, of different components that share a signature and may link, but for pairs with a hub."""
    named = (signed.select("sig", "node", "grp", "need").join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
             .select("sig", "node", "grp", "need", F.coalesce("label", "node").alias("label")))
    hubs = (named.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                     F.min(F.struct("node", "label")).alias("hub")).filter("lo != hi")
            .select(F.col("sig").alias("_s"), F.col("hub.node").alias("hub"), F.col("hub.label").alias("hub_label")))
    met = _mixed(named.join(hubs, F.col("sig") == F.col("_s")).drop("_s").filter("node != hub"))
    own = W.partitionBy("node", "grp")
    met = (met.withColumn("listed", F.count(F.lit(1)).over(own)).withColumn("nth", F.row_number().over(own.orderBy("times", "sig")))
           .filter("nth <= listed - need + 1").drop("times"))
    arms = written(_mixed(met).select("hub", "node", "label", "hub_label").distinct(), "arms")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for b in batches:
            x, xo = raw(b.column("x"))
            y, yo = raw(b.column("y"))
            x, y, xo, yo = x.view(U), y.view(U), xo // 8, yo // 8
            apart = b.column("label").to_numpy() != b.column("hub_label").to_numpy()
            parts, first, held = [], 0, 0
            for k in range(b.num_rows):
                p, q = x[xo[k]:xo[k + 1]], y[yo[k]:yo[k + 1]]
                parts.append(np.concatenate([p[~member(p, q)], q[~member(q, p)]]))
                held += len(parts[-1])
                if held >= ELEMENTS or k == b.num_rows - 1:              # a batch out holds about so many
                    n = np.array([len(d) for d in parts])
                    size, of_hub = np.diff(xo)[first:k + 1], np.diff(yo)[first:k + 1]
                    excess = n * (num + den) - (den - num) * size        # a(x), times num + den
                    # the least that a partner z can have: a(z) is above (1-t)/(1+t) |T| for one that doesn't link with T,
                    # not below its negative for others; and d(z) is no smaller than d(x) by more than x and z may differ
                    near = (den - num) * of_hub
                    other = np.where(apart[first:k + 1], -near, near + 1)
                    other = np.maximum(other, n * (num + den) - (den - num) * (size + 2 * (size * den // num)))
                    need = np.maximum(-(-(excess + other) // (2 * (num + den))), 1)
                    n[n < need] = 0
                    row = pa.array(np.repeat(np.arange(first, k + 1), n))
                    kept = [d[:m] for d, m in zip(parts, n)]
                    yield batch(["hub", "node", "label", "size", "excess", "need", "g"],
                                [b.column(c).take(row) for c in ("hub", "node", "label")]
                                + [np.repeat(v, n) for v in (size, excess, need)] + [np.concatenate(kept).view(np.int64)])
                    parts, first, held = [], k + 1, 0

    x = nodes.select(F.col("node").alias("_a"), F.col("hashes").alias("x"))
    y = nodes.select(F.col("node").alias("_b"), F.col("hashes").alias("y"))
    both = (arms.join(x, F.col("node") == F.col("_a")).drop("_a").join(y, F.col("hub") == F.col("_b"))
            .select("hub", "node", "label", "hub_label", "x", "y"))
    parts = written(both.mapInArrow(differ, "hub long, node long, label long, size long, excess long, need long, g long"), "differences", SET_BYTES)
    # elements that sets of one component alone have are in no intersection of a pair to be found
    holders, own = W.partitionBy("hub", "g"), W.partitionBy("hub", "node")
    common = (parts.withColumns({"times": F.count(F.lit(1)).over(holders), "lo": F.min("label").over(holders), "hi": F.max("label").over(holders)})
              .filter("lo != hi"))
    index = written(common.withColumns({"listed": F.count(F.lit(1)).over(own), "nth": F.row_number().over(own.orderBy("times", "g"))})
                    .filter("nth <= listed - need + 1")
                    .select("hub", "g", "node", "label", "size", "excess", (F.col("listed") - F.col("nth") + 1).alias("rest")), "prefixes")
    other = index.select(F.col("hub").alias("_h"), F.col("g").alias("_g"), F.col("node").alias("b"), F.col("label").alias("label_b"),
                         *[F.col(c).alias(f"{c}_b") for c in ("size", "excess", "rest")])
    # a pair that links meets in the first element that both list: all that they share stands from there on in both lists
    close = ((F.least("size", "size_b") * den >= F.greatest("size", "size_b") * num)
             & (F.least("rest", "rest_b") * (2 * (num + den)) >= F.col("excess") + F.col("excess_b")))
    return (index.join(other, (F.col("hub") == F.col("_h")) & (F.col("g") == F.col("_g")) & (F.col("label") != F.col("label_b"))
                       & (F.col("node") > F.col("b")) & close)
            .select(F.col("node").alias("a"), "b").distinct())


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(node, label) of the components after ``more`` links: only the components that these join are labelled anew."""
    if more.isEmpty():
        return labels
    of = labels.withColumnsRenamed({"node": "_n", "label": "_l"})
    ends = more
    for end in ("a", "b"):
        ends = ends.join(of, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_l", end)).drop("_n", "_l")
    anew = written(components(ends), "labels").withColumnsRenamed({"node": "_n", "label": "_l"})
    # a node without links so far is the label of its own component
    known = labels.join(anew, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))
    return written(known.union(anew.select(F.col("_n").alias("node"), F.col("_l").alias("label"))).distinct(), "labels")


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 80,
                          den: int = 100) -> DataFrame:
    """One row per document: doc_id, th (hash of id and text), n_shingles and component_id, the least doc_id
    that links reach; similarity num / den or more is a link."""
    sets = _live_sets(docs, id_col, text, n, num, den)
    classes = sets.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    live = sets.filter("live").groupBy("k1", "k2").agg(F.first("hashes").alias("hashes"), F.max("common").alias("common"))
    nodes = written(live.join(classes, ["k1", "k2"]).select("node", "common", "hashes"), "nodes")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for b in slices(batches, "hashes", SIGNED_BYTES):
            hashes, off = raw(b.column("hashes"))
            sets = Sets.of(hashes.view(U), off // 8)
            row, sig, group, need = sets.signatures(np.arange(b.num_rows), num, den)
            yield batch(["sig", "node", "size", "common", "grp", "need"],
                        [sig.view(np.int64), b.column("node").take(pa.array(row)), sets.size[row],
                         b.column("common").take(pa.array(row)), group, need[group]])

    signed = written(nodes.mapInArrow(explode, "sig long, node long, size long, common long, grp long, need long"), "signatures", SET_BYTES)
    # shingles that no other set has are in no intersection, so both sets must have enough of the others
    enough = num * (F.col("size") + F.col("size_b"))
    close = ((F.least("size", "size_b") * den >= F.greatest("size", "size_b") * num)
             & (F.least("common", "common_b") * (den + num) >= enough))
    hubs = (signed.groupBy("sig").agg(F.min(F.struct("node", "size", "common")).alias("hub"), F.max("node").alias("last"))
            .filter(F.col("hub.node") != F.col("last"))
            .select(F.col("sig").alias("_s"), F.col("hub.node").alias("b"), F.col("hub.size").alias("size_b"), F.col("hub.common").alias("common_b")))
    stars = (signed.join(hubs, F.col("sig") == F.col("_s")).filter((F.col("node") != F.col("b")) & close)
             .select(F.col("node").alias("a"), "b").distinct())
    stars = written(stars, "stars")
    links = written(_verify(stars, nodes, num, den), "links", SET_BYTES)
    labels = written(components(links), "labels")

    cross = written(_cross_candidates(signed, labels, nodes, num, den), "cross")
    more = written(_verify(cross.join(stars, ["a", "b"], "left_anti"), nodes, num, den), "links", SET_BYTES)
    final = classes.join(_joined(labels, more).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left") \
        .select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.coalesce("label", "node").alias("component_id"))
    out = sets.join(final, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (F.col("n_shingles") > 0), "left")
    null = F.lit(NULL_ID)
    return out.select(F.nullif(F.col("doc_id"), null).alias("doc_id"), "th", "n_shingles",
                      F.nullif(F.coalesce("component_id", "doc_id"), null).alias("component_id"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 80,
                       den: int = 100) -> DataFrame:
    """The rows of one document of each component, that of the least id, with all their columns."""
    null = F.lit(NULL_ID)
    found = written(similarity_components(docs, id_col, text, n, num, den).withColumns(
        {"doc_id": F.coalesce("doc_id", null), "component_id": F.coalesce("component_id", null)}), "components")
    least = found.filter("doc_id = component_id")
    # documents without a word are in no component; of rows of one id and component the least hash stays
    stay = (least.groupBy(F.col("component_id").alias("_id"), F.when(F.col("n_shingles") == 0, F.col("th")).alias("_bare"))
            .agg(F.min("th").alias("_th")))
    times = least.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.count(F.lit(1)).alias("_times"))
    stay = stay.join(times, (F.col("_id") == F.col("_d")) & (F.col("_th") == F.col("_t"))).select("_id", "_th", "_times")
    key = docs.withColumns({"_rid": F.coalesce(F.col(id_col).cast("long"), null),
                            "_rth": F.xxhash64(F.coalesce(F.col(id_col).cast("long"), null), F.coalesce(F.col(text), F.lit("")))})
    kept = key.join(stay, (F.col("_rid") == F.col("_id")) & (F.col("_rth") == F.col("_th")))
    once = kept.filter("_times = 1").select(*docs.columns)
    repeated = kept.filter("_times > 1").dropDuplicates(["_id", "_th"]).select(*docs.columns)
    return once.union(repeated)
