"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text (what toxic
documents hold far more often than ordinary ones). A window of words is
compressed with the ordinary dictionary alone and with the toxic one put before it; how many
bytes the toxic dictionary saves is the window's distance. Thresholds on the distance give
counts and shares of windows, and a logistic regression calibrates them to a probability.

The model is fitted on the driver from at most :data:`MAX_TOXIC` and :data:`MAX_ORDINARY`
labelled documents, the first of each class by a hash of their id, :data:`MAX_CHARS` characters
of each: a bounded sample, whatever the input. The calibration sees each text through
dictionaries of the other folds, weighted to the class shares of all labelled rows that may be
learnt from; scoring uses dictionaries of all folds, takes whole texts and nothing but texts.

Defined results: null and empty texts get the score of a text without windows; without toxic or
without ordinary labels the score is the share of toxic labels for all (0 without labels);
equal texts have equal scores; rows are scored one by one; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch

MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 2000, 4000, 20_000
TOXIC_BYTES, ORDINARY_BYTES = 4096, 8192
FOLDS, MAX_WINDOWS = 3, 40_000
WINDOW = 8
GRAM, LONGEST, RATIO = 5, 7, 30
#: Share of toxic texts that must hold a stretch of GRAM bytes, and a longer beginning of a word.
SHARE, LONG_SHARE = 0.005, 0.02
STEPS = (1, 2, 3, 5)
THRESHOLD = 0.3


def _words(text: str) -> list[bytes]:
    return text.lower().encode().split()


def _grams(word: bytes) -> dict[bytes, int]:
    """Where in a word its stretches of :data:`GRAM` bytes are, and its longer beginnings."""
    out = {word[i:i + GRAM]: i for i in range(max(1, len(word) - GRAM + 1))}
    return out | {word[:n]: 0 for n in range(GRAM + 1, min(len(word), LONGEST) + 1)}


def _windows(text: str) -> list[bytes]:
    w = _words(text)
    return [b" " + b" ".join(w[i:i + WINDOW]) + b" " for i in range(0, len(w), WINDOW)]


def marked(toxic: list[str], ordinary: list[str]) -> set[bytes]:
    """Stretches of words that toxic texts hold :data:`RATIO` times as often as ordinary ones."""
    seen = []
    for texts in (toxic, ordinary):
        c: Counter = Counter()
        for t in texts:
            c.update(set().union(*(_grams(b" " + w + b" ") for w in set(_words(t)))))
        seen.append(c)
    a, b = seen
    least = {n: max(3, (SHARE if n <= GRAM else LONG_SHARE) * len(toxic)) for n in range(LONGEST + 1)}
    return {g for g, n in a.items() if n >= least[len(g)] and n / len(toxic) > RATIO * (b[g] + 0.5) / len(ordinary)}


def toxic_stretches(texts: list[str], grams: set[bytes]) -> list[bytes]:
    """The parts of words that marked stretches cover."""
    out = []
    for t in texts:
        for w in _words(t):
            w = b" " + w + b" "
            end = -1
            for i, g in sorted((i, g) for g, i in _grams(w).items() if g in grams):
                if i <= end:
                    out[-1] += w[end:i + len(g)]
                else:
                    out.append(g)
                end = max(end, i + len(g))
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a zstandard dictionary. The trainer leaves out much of few samples: what room
    it leaves is filled with the most frequent samples that it left out."""
    try:
        data = zstandard.train_dictionary(size, samples).as_bytes()
        data = data[max(data.find(b" ", 120), 0):]       # without its header and entropy tables
    except zstandard.ZstdError:
        data = b""
    more = []
    for s, _ in Counter(samples).most_common():
        if len(data) + sum(map(len, more)) + len(s) > size:
            break
        if s not in data:
            more.append(s)
    return b"".join(more) + data


@dataclass
class Model:
    base: float
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def compressors(self) -> tuple:
        out = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters(
                format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
                min_match=GRAM, strategy=zstandard.STRATEGY_GREEDY, window_log=18, hash_log=17, chain_log=17, search_log=7,
                target_length=8)
            d.precompute_compress(compression_params=p)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
        return tuple(out)

    def score(self, features: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(features), self.base)
        x = (features - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def features(texts: list[str], compressors: tuple) -> np.ndarray:
    """A row a text: log counts and shares of windows whose distance reaches each step, log of windows."""
    plain, toxic = (c.compress for c in compressors)
    out = np.zeros((len(texts), 2 * len(STEPS) + 1))
    for k, t in enumerate(texts):
        w = _windows(t)
        d = np.fromiter((len(plain(x)) - len(toxic(x)) for x in w), np.int64, len(w))
        n = np.array([(d >= s).sum() for s in STEPS], float)
        out[k] = [*np.log1p(n), *(n / max(len(w), 1)), np.log1p(len(w))]
    return out


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""
    stretches = toxic_stretches(toxic, marked(toxic, ordinary))
    windows = [w for t in ordinary for w in _windows(t)]
    for s in (stretches, windows):
        random.Random(7).shuffle(s)
    return trained(windows[:MAX_WINDOWS], ORDINARY_BYTES), trained(stretches, TOXIC_BYTES)


def fit(rows: list[tuple[str, int]], share: float) -> Model:
    """``share``: of toxic ones among all labelled rows that may be learnt from."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    random.Random(7).shuffle(rows)
    toxic, ordinary = ([t for t, y in rows if y == k] for k in (1, 0))
    if not toxic or not ordinary:
        return Model(base=share)
    x, y = [], []
    for k in range(FOLDS):                                       # features of texts that their dictionaries don't know
        kept = [[t for i, t in enumerate(v) if i % FOLDS != k or len(v) < FOLDS] for v in (toxic, ordinary)]
        left = [[t for i, t in enumerate(v) if i % FOLDS == k] for v in (toxic, ordinary)]
        part = Model(share, *dictionaries(*kept))
        x.append(features(left[0] + left[1], part.compressors()))
        y += [1.0] * len(left[0]) + [0.0] * len(left[1])
    x, y = np.concatenate(x), np.array(y)
    model = Model(share, *dictionaries(toxic, ordinary))
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    design = np.column_stack([np.ones(len(x)), (x - model.mean) / model.scale])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = np.zeros(design.shape[1])
    ridge = np.diag([1e-6, *np.full(len(w) - 1, 1.0)])
    for _ in range(50):                                          # Newton steps
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = design.T @ (design * (weight * p * (1 - p))[:, None]) + ridge
        step = np.linalg.solve(h, design.T @ (weight * (y - p)) - ridge @ w)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on labelled rows that are not held out."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))) \
        .select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in usable.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [usable.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
              for y, n in ((1, MAX_TOXIC), (0, MAX_ORDINARY))]
    sample = picked[0].union(picked[1])
    rows = (docs.select(id_col, text).join(F.broadcast(sample), F.col(id_col) == F.col("_id"))    # bounded by the limits
            .select(F.substring(F.coalesce(F.col(text), F.lit("")), 1, MAX_CHARS).alias("t"), "_y")
            .limit(MAX_TOXIC + MAX_ORDINARY).collect())
    total = sum(counts.values())
    return fit([(r["t"], r["_y"]) for r in rows], counts.get(1, 0) / total if total else 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors() if len(model.weights) else None
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            s = model.score(features(texts, pair) if pair else np.zeros((len(texts), 1)))
            yield batch([id_col, "held_out", "score", "predicted"],
                        [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))])

    return docs.select(id_col, held_out(F.col(id_col)).alias("held_out"), text).mapInArrow(
        run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
