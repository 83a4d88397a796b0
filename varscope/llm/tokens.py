"""Public tokenizers inside tasks: whole texts to ids, with a cache of pieces.

Both tokenizers cut a text before they merge, and never merge across the cuts, so a text
may be encoded piece by piece and equal pieces once. Texts are cut only where the cut of
the tokenizer is certain; a text with any other white space goes to it whole, and so does one
with the string of an added token (<|endoftext|>), which is one id as the library has it.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Pieces that a worker remembers at most, and the longest one that it remembers.
CACHE_PIECES = 500_000
CACHE_CHARS = 48
_CODECS: dict[tuple[str, str], "Codec"] = {}
#: Two white space characters in a row: here a blank may not open the next piece.
UNSURE = re.compile(r"\s\s")
INNER = re.compile(r"\s")
#: A lone mark between a letter or digit and white space: always cut from the word by the tokenizers. The mark stands
#: first in the expression, so that the search skips to marks and does not look behind every character.
MARK = re.compile(r"[.,](?<=[^\W_][.,])(?=\s|\Z)")
#: New pieces that are encoded in one text.
JOINED = 50


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


class Codec:
    """``cut``: "space" if white space belongs to no id, "byte" if a blank belongs to the word after it."""

    def __init__(self, path: str, cut: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        # the library gives an added token's string one id, so a text that holds one goes to it whole
        added = self.tok.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        if self.tok.normalizer and any(t.normalized for t in added):
            self.added = [""]          # told only after normalizing: every text goes whole
        self.cut = cut
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() < 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        # stands between new pieces that are encoded together; must be one id
        self.mark = "\n" if cut == "byte" else "\x02"
        mark = self.tok.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = mark[0] if len(mark) == 1 else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, texts: list[str]) -> list[bytes]:
        """Like :meth:`_encode` for many short pieces: in one text, told apart by the mark's id."""
        if self.cut == "byte":
            plain = [t != " " and t != "" and not INNER.search(t, 1) and t[0] != "\n" for t in texts]
        else:
            plain = [self.mark not in t for t in texts]
        out: list[bytes] = [b""] * len(texts)
        rest = [k for k, x in enumerate(plain) if not x or self.mark_id is None]
        good = [k for k, x in enumerate(plain) if x and self.mark_id is not None]
        groups = [good[i:i + JOINED] for i in range(0, len(good), JOINED)]
        glue = self.mark if self.cut == "byte" else f" {self.mark} "
        size = self.dtype.itemsize
        for g, data in zip(groups, self._encode([glue.join(texts[k] for k in g) for g in groups])):
            cuts = np.flatnonzero(np.frombuffer(data, self.dtype) == self.mark_id)
            if len(cuts) != len(g) - 1:
                rest += g
                continue
            begin = [0, *((cuts + 1) * size).tolist()]
            for k, lo, hi in zip(g, begin, [*(cuts * size).tolist(), len(data)]):
                out[k] = data[lo:hi]
        for k, data in zip(rest, self._encode([texts[k] for k in rest])):
            out[k] = data
        return out

    def pieces(self, text: str) -> list[str]:
        """Keys of :attr:`known`; after NUL a piece stands as it is, a line end is its own, others follow a
        blank. A mark that ends a word is a piece of its own, so that the word is known with any mark."""
        if self.cut == "space":
            return MARK.sub(r" \g<0>", text.replace("\n", " ")).split(" ")
        if "\0" in text or UNSURE.search(text):
            return ["\0" + text]
        return ("\0" + MARK.sub(" \0\\g<0>", text).replace("\n", " \n \0")).split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``dtype``."""
        whole = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        if not whole:
            return self._encode_cut(texts)
        ids = dict(zip(whole, self._encode([texts[k] for k in whole])))
        others = iter(self._encode_cut([t for k, t in enumerate(texts) if k not in ids]))
        return [ids[k] if k in ids else next(others) for k in range(len(texts))]

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        known, get = self.known, self.known.get
        cut = [self.pieces(t) for t in texts]
        found = [list(map(get, p)) for p in cut]
        places, words = [], []
        for p, v in zip(cut, found):
            i = -1
            for _ in range(v.count(None)):
                i = v.index(None, i + 1)
                places.append((v, i))
                words.append(p[i])
        new = list(dict.fromkeys(words))
        plain = new if self.cut == "space" else [p[1:] if p[:1] == "\0" else p if p == "\n" else " " + p for p in new]
        local = dict(zip(new, self._encode_new(plain)))
        for (v, i), w in zip(places, words):
            v[i] = local[w]
        room = CACHE_PIECES - len(known)
        known.update((w, local[w]) for w in new[:max(room, 0)] if len(w) <= CACHE_CHARS)
        return [b"".join(v) for v in found]


def codec(path: str, cut: str) -> Codec:
    if (path, cut) not in _CODECS:
        _CODECS[path, cut] = Codec(path, cut)
    return _CODECS[path, cut]


def forget() -> None:
    """Drops the tokenizers and their pieces; the next text loads them again."""
    _CODECS.clear()
