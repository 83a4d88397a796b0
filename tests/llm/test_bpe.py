"""op11: ids and text as the library gives them, streaming, lookahead by brute force."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from varscope.llm import bpe
from varscope.llm.tokens import tokenizer_path

from .data import documents, frame

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def library_ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def random_text(rng: random.Random) -> str:
    def part(n):
        kind = rng.randrange(6)
        if kind == 0:
            return "".join(rng.choices("abcde", k=n))
        if kind == 1:
            return "".join(rng.choices(" \t\n\r'’s!a1é　\x85", k=n))
        if kind == 2:
            return "".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x300, 0xD800), rng.randrange(0x1C80, 0x1C90),
                                           rng.randrange(0xE000, 0x30000)])) for _ in range(n))
        if kind == 3:
            return rng.choice(" \n=x-") * n
        if kind == 4:
            return " ".join(rng.choices(["it's", "we'll", "'re", "<|endoftext|>", "<|endof", "text|>"], k=n // 4 + 1))
        return "".join(rng.choices(["guarantee", "ing", "initions", "ri", "the", "in", "er", "ation", " "], k=n // 4 + 1))
    return "".join(part(rng.choice([1, 3, 20, 200])) for _ in range(rng.randint(1, 4)))


def test_streaming_in_any_pieces_gives_the_librarys_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "STEP", 64)
    monkeypatch.setattr(bpe, "HELD", 50)
    voc, rng = bpe.Vocabulary(PATH), random.Random(5)
    enc, dec = bpe.Encoder(voc), bpe.Decoder(voc)
    for _ in range(600):
        text = random_text(rng)
        want = library_ids(library, text)
        out, k = b"", 0
        while k < len(text):
            n = rng.choice([1, 2, 7, 100, 1000])
            out += enc.feed(text[k:k + n])
            k += n
        assert out + enc.finish() == want
        assert bpe.encode_texts(voc, [text, "", text]) == [want, b"", want]
        back = "".join(dec.feed([i]) for i in np.frombuffer(want, "<u4").tolist()) + dec.finish()
        assert back == text


def test_ids_that_no_text_gives_decode_as_in_the_library(library):
    voc, rng = bpe.vocabulary(PATH), random.Random(6)
    for _ in range(500):
        ids = [rng.randrange(50257) if rng.random() < 0.5 else rng.choice(voc.byte_ids) for _ in range(20)]
        want = library.decode(ids, skip_special_tokens=False)
        assert bpe.decode_ids(voc, np.array(ids, "<u4").tobytes()).decode() == want
    assert bpe.decode_ids(voc, np.array([70000, 64], "<u4").tobytes()) == b"a"


def test_kinds_of_characters_are_the_librarys(library):
    voc, rng = bpe.vocabulary(PATH), random.Random(7)
    odd = bpe.unsure_characters()
    unsure = rng.sample([c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if odd.match(c)], 3000)
    some = [chr(c) for c in rng.sample([*range(0x20, 0xD800), *range(0xE000, 0x110000)], 6000)] + unsure
    for c in some:
        text = f"a{c}1{c}! {c}{c}x"
        assert voc.pieces(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def plain_bpe(merges, text):
    rank = {m: k for k, m in enumerate(merges)}
    parts = list(text)
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not found:
            return parts
        _, i = min(found)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def ends(parts):
    return set(np.cumsum([len(p) for p in parts]).tolist())


@pytest.mark.parametrize("seed", range(12))
def test_lookahead_is_sufficient(seed):
    """No continuation changes a token that ends so far before the end of what was read."""
    rng = random.Random(seed)
    pieces, merges = list("abc"), []
    while len(merges) < 14:
        pair = rng.choice(pieces), rng.choice(pieces)
        if len(pair[0] + pair[1]) <= 6 and pair[0] + pair[1] not in pieces:
            merges.append(pair)
            pieces.append(pair[0] + pair[1])
    look = bpe.sufficient_lookahead(merges)
    seen = 0
    for _ in range(1500):
        text = "".join(rng.choices("abc", k=rng.randint(1, 40)))
        more = text + "".join(rng.choices("abc", k=rng.randint(1, 12)))
        a, b = ends(plain_bpe(merges, text)), ends(plain_bpe(merges, more))
        assert {e for e in a if e <= len(text) - look} == {e for e in b if e <= len(text) - look}
        same = max([0, *(e for e in a & b if {x for x in a if x <= e} == {x for x in b if x <= e})])
        seen = max(seen, len(text) - same)
    assert seen <= look


def test_memory_of_a_run_is_the_window(library):
    voc = bpe.vocabulary(PATH)
    enc, out, text = bpe.Encoder(voc), b"", "abcdefghij" * 30_000
    for k in range(0, len(text), 1000):
        out += enc.feed(text[k:k + 1000])
        assert len(enc.window) <= voc.lookahead + bpe.STEP + bpe.HELD and len(enc.rest) <= bpe.HELD
    assert out + enc.finish() == library_ids(library, text)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(tokenizer_path("word_bpe_49k.json"))


def test_rows(spark, library):
    docs = frame(spark).withColumnRenamed("size", "ids").withColumnRenamed("node", "ids ")
    got = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert set(got.columns) == {*docs.columns, "decoded"}
    rows = got.collect()
    assert len(rows) == len(documents())
    for r in rows:
        assert bytes(r["ids"]) == library_ids(library, r["text"] or "") and r["decoded"] == (r["text"] or "")
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_query(spark, library, tmp_path):
    from varscope.llm.queries import REGISTRY
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in REGISTRY["op11_bpe"][0](spark, str(tmp_path)).collect()]
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = [(d, len(ids) // 4, sha(ids), sha((t or "").encode())) for d, t, *_ in documents() for ids in [library_ids(library, t or "")]]
    assert sorted(got, key=str) == sorted(want, key=str)
