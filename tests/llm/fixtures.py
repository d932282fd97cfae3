"""Small tables with the edge cases that every operator has to define."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "Eta", "théta", "iota,", "kappa.", "lambda", "mu"]


def texts(seed: int = 7, n: int = 60) -> list[str | None]:
    r = random.Random(seed)
    prose = lambda k: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(k))
    base, passage, line = prose(120), prose(50), "This line is on very many pages of the corpus."
    out: list[str | None] = [None, "", "   \n\t", "one", "two words", "\n", base, base, base + " end", "42 17 !!", "x" * 3000]
    for i in range(n):
        kind = i % 6
        if kind == 0:
            words = base.split()
            for _ in range(r.randrange(1, 4)):
                words[r.randrange(len(words))] = prose(1)
            out.append(" ".join(words))
        elif kind == 1:
            out.append(prose(r.randrange(1, 40)) + "\n" + line + "\n" + prose(10))
        elif kind == 2:
            out.append(prose(20) + " " + passage + " " + prose(20))
        elif kind == 3:
            out.append("\n".join([line.upper(), prose(30), "  " + line + " ", "", "short"]))
        elif kind == 4:
            out.append(prose(r.randrange(30, 400)))
        else:
            out.append(" ".join(["again and again"] * r.randrange(1, 40)))
    return out


def rows(seed: int = 7, n: int = 60) -> list[tuple]:
    out = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts(seed, n))]
    return out


def odd_rows() -> list[tuple]:
    """Null ids and columns, a repeated row, one id with two texts."""
    same = (500, "a repeated row with a few words in it, twice over", "en", "s", 10)
    return [(None, "no id here but some words to keep it company", None, None, None), (None, None, None, None, None), same, same, (501, "first text of an id", "en", None, 1), (501, "second text of an id", "en", None, 1)]
