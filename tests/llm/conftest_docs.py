from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, tk string, text_key bigint"


def prose(seed: str, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(n)]
    return " ".join(w + ("." if i % 12 == 11 else "") for i, w in enumerate(words)) + "."


def documents() -> list[tuple]:
    """Nulls in every column, empty, one-word and long texts, copies, near copies, a shared passage, repeated rows."""
    base, passage, long = prose("base", 200), prose("passage", 70), prose("long", 20_000)
    near = base.replace(base.split()[100], "changed", 1)
    texts = [base, base, near, None, "", "   \n\t ", "word", passage + " " + prose("a", 80), prose("b", 90) + " " + passage, long, prose("c", 120), "été größe naïve — 中文 \U0001f600 ok.", "<|endoftext|> and <|startoftext|>"]
    rows = [(i, t, ("en", "fr", None)[i % 3], "s", len(t or ""), 0.5, "clash", 7) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (13, prose("d", 60), "en", None, None, None, None, None)]
    return rows
