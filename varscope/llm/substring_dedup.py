"""Substring dedup over words by level-wise doubling.

A window of ``length`` words is repeated only if both its halves are. Level one asks which
windows of half the length occur more than once anywhere; windows of twice that length (the
halves overlap by a word if ``length`` is odd) are named only where level one's survived, by the
pair of their halves' names, and level two asks in which document each occurs first. The ladder
ends at ``length``: a window that survives there is removed from every later document.

Level one need not look at every half window: in each window of ``length`` only the half window
with the least hash is asked for. Equal windows choose alike, so none is missed, and about a
quarter of the positions is sent.

Names are 64-bit hashes of words and of pairs of names, kept apart further by bucket. Every
question is asked once a block of documents (see ``blocks``), so a passage that a third of all
documents share is answered once a block.

Defined results: null text has no words; a text shorter than a window loses nothing; a null
doc_id sorts before all others; among rows of equal doc_id none is before the other, so each
keeps its text; an empty table gives an empty table; other columns are kept by
:func:`deduplicate`, of which ``row`` holds all but the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import MESSAGE, contents, earlier, in_blocks, ordered, send, shared, told, with_answers
from .common import NULL_ID
from .hashing import Prefix, Words, anchors, cover, member, mix, window_starts

WINDOW = 13
U = np.uint64


def _names(words: Words, half: int) -> np.ndarray:
    return Prefix(words.hash).grams(half)


def _doubled(names: np.ndarray, starts: np.ndarray, length: int, half: int) -> np.ndarray:
    """Names of the windows of ``length`` at ``starts`` from the names of their halves."""
    return mix(names[starts] * U(0x9E3779B97F4A7C15) + names[starts + length - half])


def _runs(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    n = last - first + 1
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = WINDOW,
                keep_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by
    one blank) and, with ``keep_text``, ``text`` without the removed words, in its own layout, and ``row``."""
    half = -(-length // 2)
    blocks, buckets = in_blocks(docs, id_col, text, keep_row=keep_text)

    def level_one(t: pa.Table) -> pa.Table:
        block, _, data, off = contents(ordered(t))
        words = Words(data, off)
        names = _names(words, half)
        h, n = np.unique(names[anchors(names, words.offsets, length, half)[0]], return_counts=True)
        return send(block, h, buckets, np.minimum(n, 255).astype(np.uint8))

    def level_two(t: pa.Table, survivors: pa.Table) -> pa.Table:
        block, ids, data, off = contents(ordered(t))
        words = Words(data, off)
        names = _names(words, half)
        at, first, last = anchors(names, words.offsets, length, half)
        own, back, n = np.unique(names[at], return_inverse=True, return_counts=True)
        alive = (member(own, told(survivors)) | (n > 1))[back]
        starts = _runs(first[alive], last[alive])
        h, k = np.unique(_doubled(names, starts, length, half), return_index=True)
        return send(block, h, buckets, ids[words.text[starts[k]]], np.zeros(len(k), np.int64))

    def remove(t: pa.Table, later: pa.Table) -> pa.Table:
        t = ordered(t)
        _, ids, data, off = contents(t)
        words = Words(data, off)
        starts = window_starts(words.offsets, length)
        names = _names(words, half)
        h = _doubled(names, starts, length, half)
        flag = member(h, told(later))
        doc = ids[words.text[starts]]
        order = np.argsort(h, kind="stable")
        s = h[order]
        begin = np.concatenate([[True], s[1:] != s[:-1]])[:len(s)]
        first = doc[order][np.flatnonzero(begin)][np.cumsum(begin) - 1]
        flag[order] |= first < doc[order]
        gone = cover(starts[flag], length, len(words.start))
        return _result(t, words, off, ids, gone, keep_text)

    replies = shared(blocks.groupBy("block").applyInArrow(level_one, MESSAGE), hot=1 << 62)
    later = earlier(with_answers(blocks, replies, level_two, MESSAGE), by_place=False)
    schema = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if keep_text:
        schema.add("text", "string").add("row", blocks.schema["row"].dataType)
    names = schema.names
    out = blocks.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(
        lambda left, right: remove(left, right).select(names), schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def _result(t: pa.Table, words: Words, off: np.ndarray, ids: np.ndarray, gone: np.ndarray, keep_text: bool) -> pa.Table:
    n_docs = len(ids)
    total = np.diff(words.offsets)
    gone_before = np.concatenate([[0], np.cumsum(gone)])
    lost = np.diff(gone_before[words.offsets])
    # a word owns its bytes and the white space byte after it; the layout text owns all white space after it
    owner = np.zeros(len(words.data) + 1, np.int64)
    owner[words.start] = 1
    owner = np.cumsum(owner[:-1]) - 1
    owner[owner < np.repeat(words.offsets[:-1], np.diff(off))] = -1      # white space before a text's first word
    keep_word = np.append(~gone, True)                     # index -1 stays
    kept = keep_word[owner]
    after = np.zeros(len(words.data), bool)
    after[words.end[words.end < off[words.text + 1]]] = True
    plain = words.data.copy()
    plain[after] = 32
    joined = kept & (words.solid | after)
    sha, texts = [], []
    data = words.data
    for d in range(n_docs):
        lo, hi = off[d], off[d + 1]
        part = joined[lo:hi]
        body = plain[lo:hi][part].tobytes()
        # the separator of the last kept word does not belong to the result; words hold no blank
        sha.append(hashlib.sha256(body[:-1] if body.endswith(b" ") else body).hexdigest())
        if keep_text:
            texts.append(data[lo:hi][kept[lo:hi]].tobytes().decode() if lost[d] else data[lo:hi].tobytes().decode())
    cols = {"doc_id": pa.array(ids), "n_words": pa.array(total.astype(np.int64)), "n_removed": pa.array(lost.astype(np.int64)),
            "kept_sha256": pa.array(sha, pa.string())}
    if keep_text:
        cols |= {"text": pa.array(texts, pa.string()), "row": t["row"]}
    return pa.table(cols)


def deduplicated_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = WINDOW) -> DataFrame:
    """All rows with all their columns; later copies of repeated windows are cut from the texts."""
    out = deduplicate(docs, id_col, text, length)
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
