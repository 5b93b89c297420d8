"""Small documents with every case that the operators define."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, bucket int, h long"


def documents(spark, seed: int = 1, n: int = 60):
    """Random prose with copies, near copies, shared passages, nulls, empty and long texts, odd characters, repeated rows, clashing columns."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéßñ漢") for _ in range(r.randint(1, 7))) for _ in range(300)]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = line(40)
    texts: list[str | None] = [None, "", "   \n\t", "x", "... 123 !!", "🙂🙂 \\ </s> [INST] ▁ \x0b\x0c"]
    for k in range(n):
        t = "\n".join(line(r.randint(1, 30)) for _ in range(r.randint(1, 6)))
        kind = k % 6
        if kind == 1 and k > 10:
            t = texts[-5] or ""
        elif kind == 2 and k > 10:
            base = (texts[-2] or "").split(" ")
            base[len(base) // 2 :] = [*base[len(base) // 2 : -1], "changed"]
            t = " ".join(base)
        elif kind == 3:
            t = line(10) + "\n" + passage + "\n" + line(10)
        elif kind == 4:
            t = t.replace(" ", "  ")
        texts.append(t)
    texts.append(line(6000))
    texts.append("ab" * 2000)
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{min(i % 5, 3)}", None, 0.5, True, 1, 2) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "a null id with words", "en", "s1", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df) -> list[tuple]:
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
