"""Quality rules, line first: rules judge each line, failing lines go, and a document
that loses too much of its text is rejected.

Line rules (a line of one or two words passes all but ``duplicate`` and ``boilerplate``):

* ``duplicate``: equal to an earlier line of the document
* ``boilerplate``: a short line with a phrase of site furniture or a licence notice
* ``navigation``: separators (``|``, ``>``, bullets) at every few words
* ``symbols``: more symbols than a third of its words
* ``shouting``: capitals only
* ``repetition``: many words equal the word before, or few distinct words
* ``punctuation``: a long line without any sentence punctuation

Defined results: null text is a text without words; empty and wordless lines are neither
judged nor counted; equal rows give equal results; an empty table gives an empty table;
extra input columns are kept by :func:`clean_documents` and ignored by :func:`assess`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_room

MIN_WORDS = 50
#: Texts that are Python strings at once.
TEXTS = 256
MAX_REPEAT_PCT = 50
#: A document is rejected when its failing lines hold more than this share of its words.
MAX_LOST = 0.5
SHORT_LINE = 25
SYMBOLS = b"#*$%&|<>"

BOILERPLATE = re.compile(
    rb"(?i)\b(all rights reserved|licen[sc]ed under|under the mit licen[sc]e|cookie policy|accept cookies|use of cookies"
    rb"|privacy policy|terms of (use|service)|sign (up|in)|log in|subscribe|newsletter|click here|read more|share this"
    rb"|follow us|skip to content|enable javascript|lorem ipsum|powered by)\b|\xc2\xa9 ?(19|20)\d\d")
SEPARATORS = {s.encode() for s in "|>»›•·"}
SENTENCE = re.compile(rb"[.!?;:]|\xe2\x80\xa6|\xe3\x80\x82")

COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, n_lines long, n_lines_removed long, n_words_removed long, rules string")


def line_rule(line: bytes, words: list[bytes]) -> str | None:
    """The first rule that the line fails, None if it passes."""
    n = len(words)
    if n <= SHORT_LINE and BOILERPLATE.search(line):
        return "boilerplate"
    if n <= 2:
        return None
    if 4 * sum(w in SEPARATORS for w in words) > n:
        return "navigation"
    if 3 * (len(line) - len(line.translate(None, SYMBOLS))) > n:
        return "symbols"
    if n >= 4 and line.decode("utf-8", "replace").isupper():
        return "shouting"
    if n >= 8 and (3 * sum(map(eq, words, words[1:])) > n or 4 * len(set(words)) < n and n < 400):
        return "repetition"
    if n >= 8 and not SENTENCE.search(line):
        return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words in a 3-word window found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == n - 2:
        return 0
    counts = Counter(grams)
    covered, end = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def judge(text: bytes, max_lost: float = MAX_LOST) -> tuple:
    """The row of :data:`COLUMNS` for one text, and the numbers of the lines that stay."""
    seen: set[bytes] = set()
    words: list[bytes] = []
    removed = dup = lost = n_lines = 0
    rules: Counter = Counter()
    stay = []
    for k, line in enumerate(text.split(b"\n")):
        own = line.split()           # ASCII white space, as in [^\x20\x09-\x0D]+
        if not own:
            stay.append(k)
            continue
        n_lines += 1
        words += own
        if line in seen:
            dup += 1
            why = "duplicate"
        else:
            seen.add(line)
            why = line_rule(line, own)
        if why:
            rules[why] += 1
            removed += 1
            lost += len(own)
        else:
            stay.append(k)
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    repeat = repeated_words(words)
    base = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PCT * n
    kept = not base and lost <= max_lost * n
    row = (n, chars, len(text) - len(text.translate(None, SYMBOLS)), dup, repeat, base, kept, n_lines, removed, lost,
           ",".join(f"{k}:{v}" for k, v in sorted(rules.items())))
    return row, stay


def assess(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """One row per document: ``id_col`` and the columns of :data:`COLUMNS`."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(c.split()[0] for c in COLUMNS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge((t or "").encode(), max_lost)[0] for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) or [[]] * (len(names) - 1)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names)

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, {COLUMNS}")


def clean_documents(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The rows whose verdict is to keep, with all their columns and their text unchanged."""
    @F.arrow_udf("boolean")
    def keeps(col: pa.Array) -> pa.Array:
        make_room()
        some = (col.slice(k, TEXTS).to_pylist() for k in range(0, len(col), TEXTS))
        return pa.array([judge((t or "").encode(), max_lost)[0][6] for part in some for t in part], pa.bool_())

    return docs.filter(keeps(F.coalesce(F.col(text), F.lit(""))))


def cleaned_text(text: str | None, max_lost: float = MAX_LOST) -> str:
    """The text without its failing lines."""
    data = (text or "").encode()
    lines = data.split(b"\n")
    return b"\n".join(lines[k] for k in judge(data, max_lost)[1]).decode()
