"""Operators on documents against brute force over the cases of ``data``."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.data import CLASH, DOC_SCHEMA, documents, frame, sentences
from varscope.llm import blocks, common, components, mixing, ngram_join, oracles, packing, quality_rules, substring_dedup, suffix_dedup, token_files, tokens
from varscope.llm.queries import REGISTRY
from varscope.llm.tokens import Codec, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = -(1 << 62)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def in_order():
    return sorted(documents(), key=lambda r: (LOW if r[0] is None else r[0], r[1] or ""))


def test_quality_rules(docs, empty):
    want = []
    for i, t, *_ in documents():
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {k for j in range(len(w) - 2) if grams[tuple(w[j:j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), base))
    out = quality_rules.assess(docs)
    assert rows_of(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) \
        == sorted(want, key=str)
    assert out.filter("base_failed and kept").count() == 0
    kept = quality_rules.clean_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == out.filter("kept").count() > 20
    assert quality_rules.assess(empty).count() == quality_rules.clean_documents(empty).count() == 0


def test_quality_line_rules():
    good = "\n".join(sentences(random.Random(1), 120))
    assert quality_rules.judge(good.encode())[0][6]
    for bad in ("Home | News | Sport | Shop | About", "##### $$$ %%% words ***** &&&", "ALL OF THIS IS LOUD TEXT",
                "All rights reserved.", "no sentence mark in this quite long line at all"):
        assert quality_rules.line_rule(bad.encode(), bad.encode().split())
        assert quality_rules.judge((good + "\n" + bad).encode())[0][6]
        assert quality_rules.cleaned_text(good + "\n" + bad) == good


def test_substring_dedup(docs, empty):
    first: dict[tuple, int] = {}
    for i, t, *_ in in_order():
        w = WORD.findall(t or "")
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j:j + 13]), LOW if i is None else i)
    want = []
    for i, t, *_ in documents():
        w = WORD.findall(t or "")
        gone = {k for j in range(len(w) - 12) if first[tuple(w[j:j + 13])] < (LOW if i is None else i) for k in range(j, j + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert rows_of(substring_dedup.deduplicate(docs, keep_text=False)) == sorted(want, key=str)
    out = substring_dedup.deduplicated_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert sorted((r["doc_id"], hashlib.sha256(" ".join(WORD.findall(r["text"])).encode()).hexdigest()) for r in out.collect()
                  if r["doc_id"] is not None) == sorted((x[0], x[3]) for x in want if x[0] is not None)
    assert {tuple(r) for r in out.select(*CLASH).distinct().collect()} == {tuple(f"own {c}" for c in CLASH)}
    assert substring_dedup.deduplicated_documents(empty).count() == 0


@pytest.mark.parametrize("hot", [256, 2])
def test_suffix_dedup(docs, empty, hot):
    first: dict[bytes, tuple] = {}
    for i, t, *_ in in_order():
        b = (t or "").encode()
        for j in range(len(b) - 99):
            at = (LOW if i is None else i, j)
            first[b[j:j + 100]] = min(first.get(b[j:j + 100], at), at)
    want = []
    for i, t, *_ in documents():
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for j in range(len(b) - 99):
            if first[b[j:j + 100]] < (LOW if i is None else i, j):
                gone[j + 1:j + 101] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        want.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    assert rows_of(suffix_dedup.deduplicate(docs, keep_bytes=False, hot=hot)) == sorted(want, key=str)
    if hot == 256:
        full = suffix_dedup.deduplicate(docs).collect()
        for r in full:
            b = (r["row"] and next(t or "" for i, t, *_ in documents() if i == r["doc_id"])).encode() if r["doc_id"] is not None else None
            if b is not None:
                cut = b"".join(b[x:y] for x, y in zip([0, *[s["end"] for s in r["spans"]]], [*[s["start"] for s in r["spans"]], len(b)]))
                assert cut == bytes(r["kept"])
        assert suffix_dedup.deduplicate(empty).count() == 0


def _components(n, num, den):
    lower = {k: k + 32 for k in range(65, 91)}
    sets = []
    for i, t, *_ in in_order():
        w = WORD.findall((t or "").translate(lower))
        sets.append((i, frozenset(tuple(w[j:j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()))
    label = [LOW if i is None else i for i, _ in sets]
    own = list(label)
    linked = defaultdict(set)
    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and den * len(x & y) >= num * len(x | y):
                linked[a].add(b), linked[b].add(a)
    while True:
        new = [min([label[a], *(label[b] for b in linked[a])]) for a in range(len(sets))]
        new = [min(v for v, o in zip(new, own) if o == own[a]) if sets[a][1] else new[a] for a in range(len(sets))]
        if new == label:
            return [(i, len(s), None if c == LOW else c) for (i, s), c in zip(sets, label)]
        label = new


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(docs, empty, n, num):
    got = ngram_join.similarity_components(docs, n=n, num=num, den=100).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == sorted(_components(n, num, 100), key=str)


def test_ngram_join_distinct(docs, empty):
    out = ngram_join.distinct_documents(docs)
    assert out.columns == docs.columns
    want = {i for i, s, c in _components(5, 80, 100) if i == c and i is not None}
    ids = [r["doc_id"] for r in out.select("doc_id").collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted(want)
    assert ngram_join.distinct_documents(empty).count() == 0
    assert ngram_join.similarity_components(empty).count() == 0


def test_bands_cover_all_pairs():
    for num in (50, 80, 90):
        bands = ngram_join.bands(num, 100, 5000)
        assert [b.low for b in bands[1:]] == [b.high + 1 for b in bands[:-1]]
        for b in bands:
            diff = (100 - num) * 2 * b.high // (100 + num)
            assert b.deletions and 2 * b.segments > diff or b.segments >= diff + 1 + b.empty


def test_signatures_of_unlike_sets_rarely_agree():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, int(k))).encode() for k in rng.integers(20, 300, 300)]
    sets = ngram_join.Sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), 5)
    _, sig, group, need = sets.signatures(np.arange(len(texts)), 80, 100)
    _, back, count = np.unique(sig, return_inverse=True, return_counts=True)
    alike = np.bincount(group[count[back] > 1], minlength=len(need))
    assert (alike >= need).mean() < 0.05


@pytest.mark.parametrize("num", [50, 80, 90, 100])
def test_alike_sets_share_the_signatures_they_need(num):
    rng = np.random.default_rng(num)
    for size in [*range(1, 140, 3), 237, 457, 900]:
        for cut in rng.integers(0, size * (100 - num) // 100 + 1, 4).tolist():
            more = 100 * (size - cut) // num - size                     # as many own elements as the similarity lets
            base = rng.integers(1, 1 << 63, size + more, dtype=np.uint64)
            a, b = np.sort(base[:size]), np.sort(base[cut:])
            sets = ngram_join.Sets.of(np.concatenate([a, b]), np.cumsum([0, len(a), len(b)]))
            row, sig, group, need = sets.signatures(np.arange(2), num, 100)
            assert any(len(np.intersect1d(sig[group == x], sig[group == y])) >= max(need[x], need[y])
                       for x in set(group[row == 0]) for y in set(group[row == 1])), (size, cut, more)


def test_ngram_join_links_away_from_the_hub(spark):
    rng = random.Random(8)
    common = [" ".join(f"c{j}w{k}" for k in range(9)) for j in range(6)]
    texts = []
    for f in range(6):                                                  # families: drafts of a base, copies of a draft
        base = [f"f{f}w{k}" for k in range(rng.choice([40, 150, 500]))]
        for d in range(5):
            draft = [w if rng.random() > 0.06 else f"d{d}{w}" for w in base]
            for _ in range(3):
                copy = list(draft)
                for _ in range(max(1, len(copy) // 40)):
                    copy[rng.randrange(len(copy))] = f"n{rng.random()}"
                texts.append(" ".join([*copy, *rng.sample(common, 4)]))
    order = rng.sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split(" ") for t in texts)]
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j in range(i):
                if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.similarity_components(docs, n=5, num=80, den=100)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == list(enumerate(label))


def test_blocks_give_back_what_tokenizers_hold():
    tokens.codec(tokenizer_path("byte_bpe_50k.json"), "byte").encode(["some words"])
    assert tokens._CODECS
    block = pa.table({"block": [7], "doc_id": [1], "text": ["some words"]})
    assert blocks.contents(block)[0] == 7 and not tokens._CODECS
    assert tokens.codec(tokenizer_path("byte_bpe_50k.json"), "byte").encode(["some words"])[0]


def test_mixing(spark, docs, empty):
    out = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for i, t, _, s, _ in documents():
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    biggest = {s: max(len(WORD.findall(t or "")) for _, t, _, q, _ in documents() if q == s) for s in order}
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * biggest[s]       # a repeated row counts twice
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in out)
    assert mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0


def test_mixing_takes_by_quality(spark):
    rows = [(i, ("good words here " if i % 2 else "### bad $$$ words %%% ") * 10, "en", "a" if i < 2000 else "b", 0) for i in range(2400)]
    rows = [(i, t, l, s, c) for i, t, l, s, c in rows]
    out = mixing.mix(spark.createDataFrame(rows, DOC_SCHEMA), weights=(1, 5)).filter("source = 'a'").collect()
    good = sum(r["copies"] for r in out if r["id"] % 2)
    bad = sum(r["copies"] for r in out if not r["id"] % 2)
    assert good > bad


def test_token_files(spark, docs, empty):
    path = tokenizer_path("word_bpe_49k.json")
    tok = Codec(path, "space").tok
    files = token_files.write_token_files(docs, path, "space")
    got = token_files.read_token_files(spark, files).collect()
    want, start = [], 0
    by_id = sorted(documents(), key=lambda r: LOW if r[0] is None else r[0])
    ids = {(i, t): [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in by_id}
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got if r["doc_id"] is not None) \
        == sorted((i, tuple(ids[i, t])) for i, t, *_ in by_id if i is not None)
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
        want.append(LOW if r["doc_id"] is None else r["doc_id"])
    assert want == sorted(want)
    none = token_files.write_token_files(empty, path, "space")
    assert token_files.read_token_files(spark, none).count() == 0


def test_token_coding_round_trip():
    rng = np.random.default_rng(1)
    n = np.array([0, 1, 5, 4, 1000, 0, 3])
    ranks = (rng.integers(0, 1 << 32, n.sum(), dtype=np.uint64) >> rng.integers(0, 32, n.sum(), dtype=np.uint64)).astype(np.uint32)
    control, ctl_off, data, data_off = token_files.encode_ranks(ranks, np.cumsum(n))
    assert (token_files.decode_ranks(control, ctl_off, data, n) == ranks).all()
    assert data_off[-1] == len(data) and ctl_off[-1] == len(control)


@pytest.mark.parametrize("name,cut", [("word_bpe_49k.json", "space"), ("byte_bpe_50k.json", "byte")])
def test_codec_equals_tokenizer(name, cut):
    codec = Codec(tokenizer_path(name), cut)
    texts = [t or "" for _, t, *_ in documents()] + [" lead", "trail ", "a\nb", "\n", "\n\na", "a\n b", "a \nb", "\x02 \x02a", "don't we'll\x1c x",
                                                     "İstanbul ΣΑΣ", "é ́", "日本 語 123"]
    for _ in range(2):
        assert codec.encode(texts) == codec._encode(texts)


@pytest.mark.parametrize("name,cut,ends", [("word_bpe_49k.json", "space", 49407), ("byte_bpe_50k.json", "byte", 50256)])
def test_added_tokens_as_the_library_has_them(spark, name, cut, ends):
    from tokenizers import Tokenizer
    path = tokenizer_path(name)
    plain = Tokenizer.from_file(path)                       # nothing set on it
    mark = "<|endoftext|>"
    texts = [mark, f"a {mark}", f"{mark}b", f"one. {mark} two\nthree", f"x{mark}{mark}y", f" {mark} ", "<|endof text|>", "<|ENDOFTEXT|>", "<|endoftext|",
             "<|startoftext|> go", f"{mark} " * 1500, "no mark at all", *(t or "" for _, t, *_ in documents())]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [ends]
    codec = Codec(path, cut)
    for _ in range(2):
        assert [np.frombuffer(x, codec.dtype).tolist() for x in codec.encode(texts)] == want
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    files = token_files.write_token_files(docs, path, cut)
    got = token_files.read_token_files(spark, files).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: [*x, 2] for i, x in enumerate(want)}
    pieces = defaultdict(list)
    for r in sorted(packing.pack(docs, path, cut).collect(), key=lambda r: r["piece"]):
        pieces[r["doc_id"]] += r["ids"]
    assert pieces == {i: [*x, 2] for i, x in enumerate(want)}


def test_packing(docs, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    tok = Codec(path, "byte").tok
    out = packing.pack(docs, path).collect()
    pieces = []
    for i, t, *_ in documents():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) - (len(ids) - 1) // 1024 * 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        pieces += [(i, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in out), key=str) == sorted(pieces, key=str)
    at = defaultdict(int)
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]] and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 1024
    assert len(at) <= -(-sum(at.values()) // 1024) + 2
    assert packing.pack(empty, path).count() == 0


def test_packing_plan_is_tight():
    rng = np.random.default_rng(5)
    for spread in (1024, 400, 700):
        histogram = np.bincount(rng.integers(1, spread, 20_000), minlength=1025)[:1025]
        plan = packing.plan(histogram)
        used = np.zeros(1025, int)
        for lengths, count in plan:
            assert sum(lengths) <= 1024
            for n in lengths:
                used[n] += count
        assert (used == histogram).all()
        least = -(-int((np.arange(1025) * histogram).sum()) // 1024)
        assert sum(c for _, c in plan) <= 1.01 * least + 1


def test_mixing_keeps_the_order_of_keys_of_any_weight(spark, tmp_path):
    """Texts of symbols (least weight) give large keys: the order and the cells must hold there too."""
    rows = [(i, "# $ % &" if i % 3 else "plain words here", "en", f"s{i % 2}", 7) for i in range(6000)]
    spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["taken"] for r in REGISTRY["op2_mixing"][0](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == dict(con.sql(f"SELECT doc_id, taken FROM ({oracles.MIXING})").fetchall())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    place = mixing.with_keys(docs, "doc_id", "text", "source", None).select("_source", "_place.*")
    cells = place.groupBy("_source", "d1", "d2").count().agg(F.max("count")).first()[0]
    assert cells <= 30                                            # 1 % of a source
    rows = place.orderBy("_source", "key").collect()
    assert all((a["d1"], a["d2"]) <= (b["d1"], b["d2"]) for a, b in zip(rows, rows[1:]) if a["_source"] == b["_source"])


def test_mixing_of_rows_without_an_id_and_with_clashing_columns(spark):
    rows = [(None, f"text {i} of some words", "en", f"s{i % 2}", 7, f"own {i}", 1, 2) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA + ", _source string, _key int, _id int")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r["_source"].startswith("own") and r["_key"] == 1 and r["_id"] == 2 for r in rows)
    taken = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect()
    assert all(abs(r["t"] - r["target"]) <= 5 for r in taken) and len(rows) * 5 == sum(r["t"] for r in taken)


def test_mark_is_searched_by_its_own_character():
    behind = re.compile(r"(?<=[^\W_])[.,](?=\s|\Z)")
    texts = ["", ".", "a.", "a. b", "a.b c,", "_. 9, é. ... a.. x, y. ².", "word " * 3 + "end.\nnext, line.", "日本. 語,"]
    for t in texts:
        assert [m.span() for m in tokens.MARK.finditer(t)] == [m.span() for m in behind.finditer(t)]
    long = "some words of a text, and its end. " * 20_000

    def seconds(p):
        took = []
        for _ in range(5):
            t = time.process_time()
            p.sub(r" \g<0>", long)
            took.append(time.process_time() - t)
        return min(took)

    assert seconds(tokens.MARK) < 0.8 * seconds(behind)


def test_components_stop_at_stars(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(components, "written", lambda df, name: (passes.append(name), common.written(df, name))[1])

    def labels(links):
        passes.clear()
        return sorted(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))

    assert labels([(2, 1), (3, 1), (1, 3), (5, 4), (6, 6)]) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert len(passes) == 1                                     # stars need no pass
    assert labels([(k, k + 1) for k in range(40)]) == [(k, 0) for k in range(41)]
    assert labels([(9, 3), (9, 4), (8, 4), (7, 1)]) == [(1, 1), (3, 3), (4, 3), (7, 1), (8, 3), (9, 3)]
    assert labels([]) == []


def test_ngram_join_lists_differences_without_joins(spark, monkeypatch):
    """Variants of one text with changes of their own, some of which link with each other but not with the least one."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(30):
        words = list(base)
        for at in range(k % 6 * 7, 300, 42):
            words[at] = f"v{k % 6}" + ("" if k % 3 else f"u{k}")
        for at in rng.sample(range(300), 1 + k % 3):
            words[at] = f"o{k}"
        rows.append((k, " ".join(words)))
    plans, counts = {}, {}

    def seen(df, name, *more):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        out = common.written(df, name, *more)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", seen)
    got = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=80, den=100)
    sets = [{tuple(t.split()[i:i + 3]) for i in range(298)} for _, t in rows]
    label = list(range(30))
    for _ in range(30):
        for a in range(30):
            for b in range(30):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert 1 < len(set(label)) < 30
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == list(enumerate(label))
    assert counts["differences"] and "Join" not in plans["prefixes"]


def test_batches_to_python_hold_few_bytes(spark):
    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    wide = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 10_000).cast("binary").alias("data"))
    before = spark.conf.get(common.BATCH_BYTES)
    sizes = [r["n"] for r in common.written(wide.mapInArrow(count, "n long"), "batches", 100_000).collect()]
    assert sum(sizes) == 400 and max(sizes) <= 20
    assert spark.conf.get(common.BATCH_BYTES) == before
