"""Text rules for names, paths and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def printable(text: Column) -> Column:
    r"""Control characters as \xNN; a plain chain of replacements, so it stays in generated code."""
    for code in [*range(1, 32), 127]:
        text = F.replace(text, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return text


def markdown_cell(text: Column, most: int = 80) -> Column:
    """A table cell: bars escaped that aren't yet, each line break as one space, cut with an ellipsis.

    An odd number of backslashes before a bar has escaped it already.
    """
    flat = F.regexp_replace(F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\|", r"$1\\|"), r"\r\n|\r|\n", " ")
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 1)), F.lit("…"))).otherwise(flat)


def static_prefix(pattern: Column) -> Column:
    """The directory part of a glob before its first special character, with its slash."""
    return F.regexp_extract(pattern, r"^([^*?{\[]*/)", 1)


def relative(path: Column, directory: Column) -> Column:
    """path below directory; `..` parts for what the two don't share."""
    a, b = F.split(path, "/"), F.split(directory, "/")
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(n))
    up = F.repeat(F.lit("../"), F.size(b) - same)
    return F.concat(up, F.array_join(F.slice(a, same + 1, F.size(a)), "/"))


#: Fixed value: what a terminal's colour code looks like.
COLOUR = r"\x1b\[[\d;]*m"


def bound(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """value through steps, each evaluated once however often the next one names it."""
    for step in steps:
        value = F.get(F.transform(F.array(value), step), F.lit(0))
    return value


def _numbers(word: Column, body: Column) -> Column:
    return F.regexp_extract_all(F.substring(word, F.length(body) + 1, F.length(word)), F.lit(r"\d+"), F.lit(0))


def normal_path(path: Column) -> Column:
    """A path without empty and `.` parts, `..` taken back where there is something to take back. A leading slash stays."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    back = lambda acc, x: (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("..")) != "..")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(back(acc, x), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def every_file_location(text: Column) -> Column:
    """array<struct<path, line, col>> of the files that a text names, each once, in order of first appearance.

    Words are cut at whatever can't be in a path; a colour code stays as a
    mark. Of a word the first stretch between marks may be a path: the parts
    up to the last one with an extension, a letter first in it. Its place is
    line:column or (line,column) right behind. A path also named with a line
    loses its bare mention. Paths are normal; whether a file exists is not
    looked up.
    """
    mark = "\x1b"
    # an unfinished code belongs to no word, nor does what it runs into
    marked = F.regexp_replace(F.regexp_replace(text, f"(?:{COLOUR})+", "\x00"), r"\x1b\[[\d;]*[\w./@+\-]*", " ")
    words = F.regexp_extract_all(F.translate(marked, "\x00", mark), F.lit(r"[\w./@+\-\x1b]+(?::\d+(?::\d+)?|\(\d+,\d+\))?"), F.lit(0))
    # most words of a text hold no extension, so they name nothing and aren't taken apart
    words = F.filter(words, lambda word: F.rlike(word, F.lit(r"[.][A-Za-z]")))
    spot = r"(?::\d+(?::\d+)?|\(\d+,\d+\))$"

    def parted(word: Column) -> Column:
        body = F.regexp_replace(word, spot, "")
        return F.struct(F.regexp_extract(body, r"^\x1b*([^\x1b]+)", 1).alias("first"), F.regexp_extract(body, r"^(\x1b*)", 1).alias("marks"), body.alias("body"), _numbers(word, body).alias("numbers"))

    def found_in(x: Column) -> Column:
        parts = F.split(x["first"], "/")
        # a part without a name ends the path, but for the slash it may begin with
        upto = F.array_position(F.slice(parts, 2, F.size(parts)), "").cast("int")
        return F.struct(x.alias("x"), F.when(upto > 0, F.slice(parts, 1, upto)).otherwise(parts).alias("parts"))

    def name_of(x: Column) -> Column:
        named = F.transform(x["parts"], lambda part: F.regexp_extract(part, r"^[^.].*[.][A-Za-z][A-Za-z0-9]{0,9}", 0))
        at = F.array_max(F.transform(named, lambda name, k: F.when(name != "", k)))
        return F.struct(x["x"].alias("x"), at.alias("at"), F.concat_ws("/", F.slice(x["parts"], 1, F.coalesce(at, F.lit(0))), F.get(named, at)).alias("path"))

    def placed(x: Column) -> Column:
        # a place belongs to a path that ends right before it
        near = F.concat(x["x"]["marks"], x["path"]) == x["x"]["body"]
        # without leading zeros, so that one place is one string
        number = lambda k: F.coalesce(F.when(near, F.regexp_replace(F.get(x["x"]["numbers"], F.lit(k)), r"^0+(?=\d)", "")), F.lit(""))
        return F.when(x["at"].isNotNull(), F.concat_ws(":", normal_path(x["path"]), number(0), number(1)))

    located = lambda word: bound(word, parted, found_in, name_of, placed)

    # path:line:col as one string: sets of strings are hashed, those of structs compared pair by pair
    found = F.array_distinct(F.array_compact(F.transform(words, located)))
    lined = F.filter(found, lambda x: ~x.endswith("::"))
    kept = F.array_except(found, F.transform(lined, lambda x: F.concat(F.substring_index(x, ":", 1), F.lit("::"))))
    number = lambda x, k: F.get(F.split(x, ":"), k).try_cast("long")
    return F.transform(kept, lambda x: F.struct(F.substring_index(x, ":", 1).alias("path"), number(x, 1).alias("line"), number(x, 2).alias("col")))


def file_locations(text: Column, most: int = 50) -> Column:
    """The first of every_file_location, as many as one message shows; no query takes these."""
    return F.slice(every_file_location(text), 1, most)


def nearest(name: Column, candidates: list[str]) -> Column:
    """The candidate that a mistyped name most likely meant; null for none, or if the name is one itself.

    The same letters in another case come first, then the fewest edits, two at
    most; for up to four letters two edits only if they keep the letters. Ties
    go to the earlier candidate. The list is short, so it is part of the plan.
    """
    letters = lambda c: F.sort_array(F.split(c, ""))
    short = F.length(F.regexp_replace(name, "^-+", "")) <= 4
    ranked = []
    for place, c in enumerate(map(F.lit, candidates)):
        edits = F.levenshtein(name, c)
        near = (edits <= 2) & (edits < F.greatest(F.length(name), F.length(c))) & ~(short & (edits == 2) & (letters(name) != letters(c)))
        rank = F.when((name != c) & (F.lower(name) == F.lower(c)), -1).when(near, edits)
        ranked.append(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.lit(place).alias("place"), c.alias("candidate"))))
    return F.nullif(F.array_min(F.array_compact(F.array(*ranked)))["candidate"], name)


#: Fixed value: the mark that switches the stream of a log.
RS = "\x1e"


def log_of(chunks: Column) -> Column:
    """One string for array<struct<err boolean, text string>>: RS + e / o where the stream switches, RS itself doubled."""

    def step(acc: Column, c: Column) -> Column:
        mark = F.when(c["err"] == acc["err"], "").when(c["err"], RS + "e").otherwise(RS + "o")
        return F.struct(c["err"].alias("err"), F.concat(acc["out"], mark, F.replace(c["text"], F.lit(RS), F.lit(RS * 2))).alias("out"))

    return F.aggregate(chunks, F.struct(F.lit(False).alias("err"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def chunks_of_log(log: Column) -> Column:
    """What log_of wrote, text of one stream joined. An RS before anything else is the text's own."""
    tokens = F.regexp_extract_all(log, F.lit(f"{RS}[eo{RS}]?|[^{RS}]+"), F.lit(0))
    closed = lambda acc: F.when(acc["text"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["err"].alias("err"), acc["text"].alias("text")))))

    def step(acc: Column, t: Column) -> Column:
        switch = t.isin(RS + "e", RS + "o")
        text = F.concat(acc["text"], F.when(t == RS * 2, RS).otherwise(t))
        return F.struct(
            F.when(switch, t == RS + "e").otherwise(acc["err"]).alias("err"), F.when(switch, "").otherwise(text).alias("text"), F.when(switch, closed(acc)).otherwise(acc["done"]).alias("done")
        )

    start = F.struct(F.lit(False).alias("err"), F.lit("").alias("text"), F.array().cast("array<struct<err:boolean,text:string>>").alias("done"))
    return F.aggregate(tokens, start, step, closed)


def sorted_json(text: Column) -> Column:
    """JSON with the keys of every object in order, all the way down; a variant keeps its fields that way."""
    return F.to_json(F.parse_json(text))


def definition_hash(task: Column, command: Column, define: Column) -> Column:
    """What a task is for its history: its id, command and given values in order of name; null without a command."""
    pairs = F.to_json(F.transform(F.array_sort(F.map_entries(define)), lambda e: F.array(e["key"], e["value"])))
    return F.sha2(F.concat(task, F.lit("\x1f"), command, F.lit("\x1f"), F.coalesce(pairs, F.lit("[]"))), 256)


def hex64(number: Column) -> Column:
    """A 64-bit number as 16 hex digits."""
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def seeded_hash(parts: Column, seed: Column) -> Column:
    """A 64-bit fold over an array of texts that carries the seed on: hash(state and part) xor state, null parts passed over.

    The state goes into each step twice, as what is hashed and by xor, so two
    states that differ stay apart by what they differ in even where their
    hashed halves meet. The number is signed, as Spark's are.
    """
    digest = lambda h, x: F.conv(F.left(F.sha2(F.concat(hex64(h), x), 256), F.lit(16)), 16, -10).cast("long")
    return F.aggregate(parts, seed, lambda h, x: F.when(x.isNull(), h).otherwise(digest(h, x).bitwiseXOR(h)))
