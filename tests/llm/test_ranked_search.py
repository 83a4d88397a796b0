"""op12 against a plain scoring of all pairs and against its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from varscope.llm import oracles, ranked_search
from varscope.llm.queries import REGISTRY

from .data import documents, frame, sentences

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def brute(docs, items, top=10):
    rows = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t, *_ in docs]
    rows = [(d, c, sum(c.values())) for d, c in rows if c]
    n_docs, n_terms = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, q in wanted.items():
        scores = []
        for d, c, n in rows:
            m = 10 + (90 * n * n_docs) // n_terms
            s = sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, k, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def benchmark():
    rng = random.Random(9)
    texts = [t for _, t, *_ in sorted(documents(), key=str) if t and len(t) > 60]
    items = [(k, " ".join(sentences(rng, 20)) if k % 3 else texts[k % len(texts)][:150]) for k in range(25)]
    return [*items, (25, "one ONE word; Word"), (26, None), (27, ""), (28, "zzzz"), (None, "the line that documents share"), (3, "word too")]


@pytest.fixture
def folder(spark, tmp_path):
    rows = documents(n=150)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark(), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def result(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_all_pairs(spark, folder, monkeypatch):
    path, rows = folder
    want = brute(rows, benchmark())
    assert result(REGISTRY["op12_ranked_search"][0](spark, path)) == want
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 700)            # several blocks of items
    docs, items = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    assert result(ranked_search.rank(docs, items)) == want
    assert result(ranked_search.rank(docs.limit(0), items)) == result(ranked_search.rank(docs, items.limit(0))) == []


def test_sql_agrees(folder):
    path, rows = folder
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    assert sorted(con.sql(oracles.RANKED).fetchall(), key=str) == brute(rows, benchmark())


@pytest.mark.parametrize("seed", range(6))
def test_tree(seed):
    """Bounds hold for every node, the search is exact, and trees of copies prune."""
    rng = np.random.default_rng(seed)
    width, n = 60, 700
    sets = [np.sort(rng.choice(width, rng.integers(0, 12), replace=False)) for _ in range(n // 7)] * 7
    size = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    col = np.concatenate(sets).astype(np.int64)
    val = rng.integers(1, 10**10, len(col))
    if seed % 2:
        val = np.repeat(10**9, len(col))
    tree = ranked_search.BallTree(start, col, val, width)
    items = [np.sort(rng.choice(width, rng.integers(1, 9), replace=False)) for _ in range(20)]
    full = np.zeros((n, width), np.int64)
    full[np.repeat(np.arange(n), size), col] = val
    scores = np.stack([full[:, q].sum(1) for q in items])
    bounds = tree.bounds(items)

    def below(k):
        rows = tree.nodes[k][3]
        return np.concatenate([below(c) for c in rows]) if isinstance(rows, tuple) else rows
    for k in range(len(tree.nodes)):
        assert (scores[:, below(k)].max(1) <= bounds[:, k]).all()
    best = [[] for _ in items]
    scored = ranked_search.search(tree, items, np.arange(n), best, 10)
    for q, heap in enumerate(best):
        want = sorted(((s, -i) for i, s in enumerate(scores[q].tolist()) if s > 0), reverse=True)[:10]
        assert sorted(heap, reverse=True) == want
    assert not seed % 2 or scored < n * len(items)
