"""Read-only SQL over the relations of a run history."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

#: What isn't part of a statement's own words: quoted text, quoted names, comments.
_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.S)


def guarded(sql: str) -> str:
    """The one statement of sql, without the semicolon behind it; ValueError unless it is a single SELECT, WITH in front or not."""
    bare = _QUOTED.sub(lambda m: " " if m[0][:2] in ("--", "/*") else "x" * len(m[0]), sql)
    first, *rest = re.split(r";", bare)
    if any(part.strip() for part in rest):
        raise ValueError("one statement: another follows the first")
    if not re.match(r"\s*(select|with)\b", first, re.I):
        raise ValueError("reads only: one SELECT, or WITH and a SELECT")
    # what a WITH leads to stands outside all brackets
    outer, before = first, None
    while outer != before:
        before, outer = outer, re.sub(r"\([^()]*\)", " ", outer)
    if re.search(r"\b(insert|update|delete|merge|create|drop|alter|set|add|cache)\b\s+\w", outer, re.I) or not re.search(r"\bselect\b", outer, re.I):
        raise ValueError("reads only: one SELECT, or WITH and a SELECT")
    return re.sub(r";\s*$", "", _QUOTED.sub(lambda m: " " if m[0][:2] in ("--", "/*") else m[0], sql).strip())


def ask(relations: dict[str, DataFrame], sql: str, json: bool = False) -> DataFrame:
    """The rows of one guarded statement over relations by name.

    The names hold for this statement alone: they are bound in a session of
    its own, so no view stays behind. As JSON a row holds one value for each
    name, so a name that comes twice is an error.
    """
    text = guarded(sql)
    session = next(iter(relations.values())).sparkSession
    for name, rows in relations.items():
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a name: {name}")
    # the plans move into a temporary namespace by WITH, each as its own view of this statement
    tag = f"_ask_{abs(hash(text)) % 10**12}"
    try:
        for name, rows in relations.items():
            rows.createOrReplaceTempView(f"{tag}_{name}")
        own = re.match(r"\s*with\s+(recursive\s+)?", text, re.I)
        named = ", ".join(f"`{name}` AS (SELECT * FROM `{tag}_{name}`)" for name in relations)
        out = session.sql(f"WITH {own[1] or ''}{named}, {text[own.end():]}" if own else f"WITH {named} {text}")
    finally:
        for name in relations:
            session.catalog.dropTempView(f"{tag}_{name}")
    twice = [name for name, n in Counter(out.columns).items() if n > 1]
    if json and twice:
        raise ValueError(f"column {twice[0]} is named twice; name each with AS")
    return out
