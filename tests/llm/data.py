"""Small documents with the cases that operators must define: nulls, empties, ties, repeats, long texts."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASH = ["block", "row", "bucket", "size", "node", "label", "kept", "target", "part", "place"]


def sentences(rng: random.Random, n: int) -> list[str]:
    pool = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiouéü") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    out = []
    while n > 0:
        k = min(n, rng.randint(4, 14))
        out.append(" ".join(rng.choices(pool, k=k)).capitalize() + ".")
        n -= k
    return out


def documents(seed: int = 3, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars)."""
    rng = random.Random(seed)
    passage = " ".join(sentences(rng, 60))
    texts: list[str | None] = []
    for i in range(n):
        body = sentences(rng, rng.choice([3, 20, 60, 120, 200]))
        if i % 4 == 0:
            body.insert(len(body) // 2, passage)
        if i % 5 == 0:
            body.insert(0, "One line that many documents share, word for word, from first to last.")
        texts.append("\n".join(body))
    base = texts[4].split(" ")
    for k in range(6):                                        # near copies and exact ones
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[2]] * 3 + [texts[2].upper()]
    texts += ["", None, " \n\t ", "word", "two words", "ab " * 3000, "x" * 5000, "a  b\x0b c\x85d e \U0001f600",
              "\n".join(["Same line here."] * 30), "it's <|endoftext|> 12\x00 34\r\n\r\nlast  ", " | ".join(["nav"] * 80)]
    rows = [(i, t, "en", f"src{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[0], (None, passage, None, None, None), (None, None, None, "src9", None)]


def frame(spark, rows: list[tuple] | None = None, clash: bool = True):
    df = spark.createDataFrame(documents() if rows is None else rows, DOC_SCHEMA).repartition(3)
    if clash:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASH})
    return df
