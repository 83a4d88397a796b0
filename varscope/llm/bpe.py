"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

How far back can text that is still to come change the tokens of the text read so far? Run the merges over
the text with and without the rest and follow the last boundary left of which both runs agree. It starts
where the read text ends, and moves left over ``u`` when a merge ``(u, x)`` crosses it in one run only. The
next such merge ``(u2, x2)`` has a later rank, and ``x2`` begins with ``u`` or with the merged ``ux``, whichever
stands there. So the boundary moves by the lengths of the ``u`` in a chain of merges of rising rank, and the
longest chain is the sufficient lookahead (:func:`sufficient_lookahead`): a token that ends so many bytes
before the end of what was read is final. The encoder emits such tokens, drops their bytes (what follows a
token boundary is encoded on its own) and so needs the same memory for a run of any length. The cut of a text
into words streams as well: at most the last two pieces wait for more text, a long run is handed on as it comes.

The decoder holds the bytes of an unfinished character, at most three.

Rules: a null text is an empty one, an empty text has no ids. The string of an added token is that token's id.
Bytes that are no UTF-8 (ids in an order that no text gives) decode to U+FFFD as the library does; ids that
the vocabulary lacks, null included, decode to nothing. Rows are independent: null or repeated ids, ties and
other columns of any name pass through; an output column replaces one of its own name.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import binaries, raw, slices

#: Fixed value: the cut of text into pieces that byte-level vocabularies of this kind use.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: How a run that has begun goes on, by the kind of its last character.
RUNS = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "O": regex.compile(r"[^\s\p{L}\p{N}]*"),
        "S": regex.compile(r"\s*")}
KIND = regex.compile(r"(\p{L})|(\p{N})|(\s)|[^\s\p{L}\p{N}]", regex.DOTALL)
STANDS_FOR = {"L": "a", "N": "0", "O": "!", "S": "\t"}
#: Characters that are fed at once; bytes that a window takes beyond the lookahead.
FEED = 1 << 16
STEP = 2048
#: A held piece of more characters is handed on before its end is seen.
HELD = 4096
#: Bytes of a window that is merged together with others of its length; longer ones are merged alone.
TOGETHER = 48
#: Bytes of text whose new pieces are merged together.
MERGED_BYTES = 1 << 20
#: Pieces that a worker remembers at most, and the longest one that it remembers.
CACHE_PIECES = 400_000
NO_RANK = 1 << 40
_LOADED: dict[str, "Vocabulary"] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in files of byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    others = (b for b in range(256) if b not in out)
    out |= {b: chr(256 + k) for k, b in enumerate(others)}
    return [out[b] for b in range(256)]


def sufficient_lookahead(merges: Iterable[tuple[str, str]], size=len) -> int:
    """Bytes before the end of the read text within which its tokens may still change.

    ``merges`` in the order of their ranks; ``size`` gives a piece's bytes.
    """
    reach: dict[str, int] = {}           # a piece: the longest chain that ends where it begins
    splits: dict[str, list[str]] = {}    # a merged piece: the pieces that it begins with
    longest = 0
    for u, x in merges:
        far, todo = 0, [x]
        while todo:
            piece = todo.pop()
            far = max(far, reach.get(piece, 0))
            todo += splits.get(piece, ())
        far += size(u)
        splits.setdefault(u + x, []).append(u)
        for piece in (u, u + x):
            reach[piece] = max(reach.get(piece, 0), far)
        longest = max(longest, far)
    return longest


def unsure_characters() -> re.Pattern:
    """Characters whose kind depends on the version of Unicode."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    unsure: set[str] = set()
    for name, kind in (("L", r"\p{L}"), ("N", r"\p{N}")):
        here = set(regex.findall(kind, every))
        unsure |= here.symmetric_difference(c for c in every if unicodedata.category(c)[0] == name)
    codes = np.array(sorted(map(ord, unsure)))
    runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
    return re.compile("[" + "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs if len(r)) + "]")


class Vocabulary:
    """Tokens, ranks and lookahead of a tokenizer's file; ``ValueError`` if it isn't byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) \
                or pre.get("add_prefix_space") or model["type"] != "BPE" or any(
                    model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        self.path = path
        letters = byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, k in vocab.items():
            self.tokens[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        for token, k in self.added.items():
            self.tokens[k] = token.encode()
        self.byte_ids = [vocab[c] for c in letters]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            if made.get(a, -1) >= rank or made.get(b, -1) >= rank:
                raise ValueError("a merge uses a piece that a later merge makes")
            made.setdefault(a + b, rank)
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        later = {p for a, b in merges for p in (a, b) if len(p) > 1 and p not in made}
        if later:
            raise ValueError("a merge uses a piece that no merge makes")
        self.lookahead = max(sufficient_lookahead(merges), max((len(a + b) for a, b in merges), default=1))
        pairs = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in self.ranks.items())
        self.pair_keys, self.pair_ranks, self.pair_news = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else [np.zeros(0, np.int64)] * 3
        self.known: dict[str, bytes] = {}
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._unsure: re.Pattern | None = None
        self._kinds: dict[str, str] = {}
        self._library = None

    def merged(self, ids: list[int]) -> list[int]:
        """All merges over bytes' ids: lowest rank first, equal ranks from the left."""
        return self._by_heap(ids) if len(ids) > 40 else self._by_scan(ids)

    def _by_scan(self, ids: list[int]) -> list[int]:
        get, none = self.ranks.get, (1 << 60, -1)
        while len(ids) > 1:
            found = [get(p, none) for p in zip(ids, ids[1:])]
            best = min(found)
            if best is none:
                break
            k, out, n = 0, [], len(ids)
            while k < n:
                if k < n - 1 and found[k] == best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        ids, n, get = list(ids), len(ids), self.ranks.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if m := get((new, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, new, ids[after[i]], m[1]))
            if (h := before[i]) >= 0 and (m := get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [t for t in ids if t >= 0]

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and new id of each pair of ids; rank :data:`NO_RANK` for a pair that no merge has."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], NO_RANK), self.pair_news[at]

    def merged_together(self, windows: list[bytes]) -> list[bytes]:
        """:meth:`merged` for many short windows of bytes: a row each, one merge a row and round."""
        out: list[bytes] = [b""] * len(windows)
        order = sorted(range(len(windows)), key=lambda k: len(windows[k]))
        for lo in range(0, len(order), 8192):
            part = order[lo:lo + 8192]
            size = np.array([len(windows[k]) for k in part])
            w = int(size.max())
            ids = np.full((len(part), w + 1), -1, np.int64)
            inside = np.arange(w + 1) < size[:, None]
            ids[inside] = np.array(self.byte_ids)[np.frombuffer(b"".join([windows[k] for k in part]), np.uint8)]
            if len(self.pair_keys) and w > 1:
                self._merge_rows(ids, size)
            inside = np.arange(w + 1) < size[:, None]
            data = ids[inside].astype("<u4").tobytes()
            ends = (np.cumsum(size) * 4).tolist()
            for k, a, b in zip(part, [0, *ends], ends):
                out[k] = data[a:b]
        return out

    def _merge_rows(self, ids: np.ndarray, size: np.ndarray) -> None:
        ranks, news = self._ranks_of(ids[:, :-1], ids[:, 1:])
        place = np.arange(ids.shape[1])
        rows = np.arange(len(ids))
        while len(rows):
            at = ranks[rows].argmin(1)
            more = ranks[rows, at] < NO_RANK
            rows, at = rows[more], at[more]
            if not len(rows):
                break
            moved = place + (place > at[:, None])         # what stands right of the pair moves left by one
            now = np.take_along_axis(ids[rows], np.minimum(moved, len(place) - 1), 1)
            now[:, -1] = -1
            r = np.take_along_axis(ranks[rows], np.minimum(moved[:, :-1], len(place) - 2), 1)
            n = np.take_along_axis(news[rows], np.minimum(moved[:, :-1], len(place) - 2), 1)
            r[:, -1] = NO_RANK
            k = np.arange(len(rows))
            now[k, at] = news[rows, at]
            size[rows] -= 1
            right = np.minimum(at, len(place) - 2)
            r[k, right], n[k, right] = self._ranks_of(now[k, right], now[k, right + 1])
            left, has = np.maximum(at - 1, 0), at > 0
            lr, ln = self._ranks_of(now[k, left], now[k, left + 1])
            r[k[has], left[has]], n[k[has], left[has]] = lr[has], ln[has]
            ids[rows], ranks[rows], news[rows] = now, r, n

    def ids_of(self, texts: list[list[str | bytes]]) -> list[bytes]:
        """The ids of each text's parts: pieces, or ids that are final already. New pieces are merged together."""
        get = self.known.get
        found = [list(map(get, parts)) for parts in texts]
        missing = []
        for parts, ids in zip(texts, found):
            i = -1
            for _ in range(ids.count(None)):
                i = ids.index(None, i + 1)
                if isinstance(parts[i], bytes):
                    ids[i] = parts[i]
                else:
                    missing.append((ids, i, parts[i]))
        new = list(dict.fromkeys(m[2] for m in missing))
        local = dict(zip(new, self.merged_together([p.encode() for p in new])))
        for ids, i, piece in missing:
            ids[i] = local[piece]
        room = max(CACHE_PIECES - len(self.known), 0)
        self.known.update((p, local[p]) for p in new[:room])
        return [b"".join(ids) for ids in found]

    def kind(self, c: str) -> str:
        """L, N, O or S as the library's cut sees an unsure character."""
        if c not in self._kinds:
            if self._library is None:
                from tokenizers import Tokenizer
                self._library = Tokenizer.from_file(self.path).pre_tokenizer
            together = [k for k in "LNO" if len(self._library.pre_tokenize_str(STANDS_FOR[k] + c)) == 1]
            self._kinds[c] = together[0] if together else "S"
        return self._kinds[c]

    def plain(self, text: str) -> str:
        """The text for the cut: a character of unsure kind is replaced by a sure one of its kind."""
        if text.isascii():
            return text
        if self._unsure is None:
            self._unsure = unsure_characters()
        if not self._unsure.search(text):
            return text
        return self._unsure.sub(lambda m: STANDS_FOR[self.kind(m[0])], text)

    def pieces(self, text: str) -> list[str]:
        plain = self.plain(text)
        found = PIECES.findall(plain)
        if plain is text or plain == text:
            return found
        ends = np.cumsum([len(p) for p in found]).tolist()
        return [text[a:b] for a, b in zip([0, *ends], ends)]


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    """Text in pieces of any size to ids as little-endian unsigned 32-bit integers; reusable after finish().

    :meth:`parts` and :meth:`last_parts` give what :meth:`feed` and :meth:`finish` resolve: finished pieces of at
    most :data:`TOGETHER` bytes as strings, final ids of all else as bytes.
    """

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self.maybe_added = ""            # may begin an added token
        self.rest = ""                   # pieces that more text may change
        self.run: str | None = None      # kind of the piece that has been handed on in part
        self.window: list[int] = []      # ids of its bytes that aren't emitted

    def feed(self, text: str) -> bytes:
        return self.voc.ids_of([self.parts(text)])[0]

    def finish(self) -> bytes:
        return self.voc.ids_of([self.last_parts()])[0]

    def parts(self, text: str) -> list[str | bytes]:
        out: list[str | bytes] = []
        text = self._over_added(self.maybe_added + text, out)
        hold = max((k for a in self.voc.added for k in range(1, min(len(a), len(text) + 1)) if text.endswith(a[:k])), default=0)
        self.maybe_added = text[len(text) - hold:]
        self._cut(text[:len(text) - hold], False, out)
        return out

    def last_parts(self) -> list[str | bytes]:
        out: list[str | bytes] = []
        text = self._over_added(self.maybe_added, out)
        self.maybe_added = ""
        self._cut(text, True, out)
        return out

    def _over_added(self, text: str, out: list[str | bytes]) -> str:
        """Emits up to the last added token in ``text``; returns what follows it."""
        at = 0
        for m in self.voc.split_added.finditer(text) if self.voc.split_added else ():
            self._cut(text[at:m.start()], True, out)
            out.append(_ids([self.voc.added[m[0]]]))
            at = m.end()
        return text[at:]

    def _cut(self, text: str, final: bool, out: list[str | bytes]) -> None:
        text, self.rest = self.rest + text, ""
        if self.run:
            n = RUNS[self.run].match(self.voc.plain(text)).end()
            ended = n < len(text) or final
            if self.run == "S" and not (n == len(text) and final):
                n = max(n - 1, 0)        # the last white space may belong to what follows
            out.append(self._push(text[:n], ended))
            text = text[n:]
            if not ended:
                self.rest = text
                return
            self.run = None
        pieces = self.voc.pieces(text)
        if not final:
            self.rest = "".join(pieces[-2:])
            if len(self.rest) > HELD and len(pieces[-1]) > 3:
                last = pieces[-1]
                self.run = {1: "L", 2: "N", 3: "S", None: "O"}[KIND.match(self.voc.plain(last[-1])).lastindex]
                keep = len(last) - (self.run == "S")
                self.rest = last[keep:]
                self._finished(pieces[:-1], out)
                out.append(self._push(last[:keep], False))
                return
            pieces = pieces[:-2]
        self._finished(pieces, out)

    def _finished(self, pieces: list[str], out: list[str | bytes]) -> None:
        if pieces and 4 * max(map(len, pieces)) <= TOGETHER:
            out += pieces
        else:
            out += [p if 4 * len(p) <= TOGETHER or len(p.encode()) <= TOGETHER else self._push(p, True) for p in pieces]

    def _push(self, text: str, final: bool) -> bytes:
        """Bytes of one piece through the window: what ends ``lookahead`` bytes before its end is final."""
        voc, data = self.voc, self.window
        ids = voc.byte_ids
        data += [ids[b] for b in text.encode()]
        look, size, out, at = voc.lookahead, voc.lookahead + STEP, [], 0
        while len(data) - at > size:
            end, stable = 0, 0
            for t in voc.merged(data[at:at + size]):
                end += len(voc.tokens[t])
                if end > size - look:
                    break
                out.append(t)
                stable = end
            at += stable
        self.window = data[at:]
        if final:
            out += voc.merged(self.window)
            self.window = []
        return _ids(out)


class Decoder:
    """Ids in pieces of any size to text; holds the bytes of an unfinished character."""

    def __init__(self, voc: Vocabulary):
        self.tokens = voc.tokens
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        tokens, n = self.tokens, len(self.tokens)
        return self.state.decode(b"".join([tokens[i] for i in ids if 0 <= i < n]))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


def encode_texts(voc: Vocabulary, texts: list[str]) -> list[bytes]:
    """The ids of each text. Texts go in chunks of :data:`FEED` characters, short ones many at a time."""
    out, several, held = [], [], 0
    for text in texts:
        enc, parts = Encoder(voc), []
        for k in range(0, len(text), FEED):
            parts += enc.parts(text[k:k + FEED])
            if k:                          # a long text: its ids are made as it is read
                parts = [voc.ids_of([parts])[0]]
        several.append([*parts, *enc.last_parts()])
        held += len(text)
        if held >= MERGED_BYTES:
            out += voc.ids_of(several)
            several, held = [], 0
    return out + voc.ids_of(several)


def decode_ids(voc: Vocabulary, data: bytes | np.ndarray) -> bytes:
    """UTF-8 of the text of ids (little-endian unsigned 32-bit integers)."""
    ids, dec = np.frombuffer(data, "<u4"), Decoder(voc)
    out = [dec.feed(ids[k:k + FEED].tolist()).encode() for k in range(0, len(ids), FEED)]
    return b"".join([*out, dec.finish().encode()])


def _column(df: DataFrame, source: str, out: str, kind, work) -> DataFrame:
    """``df`` with column ``out`` = ``work`` of each value of column ``source``; other columns pass through."""
    fields = [f for f in df.schema.fields if f.name != out]
    if len({f.name for f in fields}) < len(fields):
        raise ValueError("columns need names of their own")
    schema = StructType([*fields, StructField(out, kind, False)])
    source = source if source != out else f"{out} "
    inner = df.select(*[F.col(f"`{f.name}`") for f in fields], *([F.col(f"`{out}`").alias(source)] if source[-1] == " " else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, source):
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), work(b.column(source))],
                                             [*(f.name for f in fields), out])

    return inner.mapInArrow(run, schema)


def _joined(values: list[bytes], kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=off[1:])
    return binaries(np.frombuffer(b"".join(values), np.uint8), off).cast(kind)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with a binary column of each text's ids, four bytes an id, little-endian."""
    def work(col: pa.Array) -> pa.Array:
        voc = vocabulary(path)
        return _joined(encode_texts(voc, [t or "" for t in col.to_pylist()]), pa.binary())
    return _column(df, text, out, BinaryType(), work)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of a binary column of ids."""
    def work(col: pa.Array) -> pa.Array:
        voc = vocabulary(path)
        data, off = raw(col)
        return _joined([decode_ids(voc, data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.string())
    return _column(df, ids, out, StringType(), work)
