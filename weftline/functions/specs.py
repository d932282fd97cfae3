"""Small languages of a workspace as columns: project filters, task dependencies, brace alternatives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, normal_path

_CONTROL = r"[\x00-\x1f\x7f-\x9f]"
_FILTER = (
    "error string, negate boolean, with_deps boolean, with_dependents boolean, only_deps boolean, only_dependents boolean, "
    "kind string, matcher string, within string, since string, since_via_deps boolean"
)


def _behind(text: Column, n: Column | int) -> Column:
    """text without its first n characters."""
    return F.substring(text, F.lit(n) + 1 if isinstance(n, int) else n + 1, F.length(text))


def _before(text: Column, n: int) -> Column:
    """text without its last n characters."""
    return F.left(text, F.greatest(F.length(text) - n, F.lit(0)))


def _path(form: Column) -> Column:
    """A path form below the root; `..` first means that it left the root."""
    return normal_path(F.concat(F.lit("./"), form))


def _outside(path: Column) -> Column:
    return (path == "..") | path.startswith("../")


def filter_spec(raw: Column) -> Column:
    """One struct for a project filter as typed; error says what is wrong with it, and is null for a good one.

    kind is name, tag, path, root or changed (a git range alone). matcher is a
    name or tag pattern, or a path below the root. within is the directory
    that a name is narrowed to, since a git ref, since_via_deps that a
    project whose dependency changed counts as changed. The order of the
    steps is part of the language: `!` first, then the walks at both ends,
    then the ref, then what the rest names.
    """
    head = bound(
        F.struct(raw.startswith("!").alias("negate"), F.when(raw.startswith("!"), _behind(raw, 1)).otherwise(raw).alias("s")),
        lambda x: F.struct(x["negate"], x["s"].startswith("...").alias("up"), F.when(x["s"].startswith("..."), _behind(x["s"], 3)).otherwise(x["s"]).alias("s")),
        lambda x: F.struct(x["negate"], x["up"], (x["up"] & x["s"].startswith("^")).alias("up_only"), F.when(x["up"] & x["s"].startswith("^"), _behind(x["s"], 1)).otherwise(x["s"]).alias("s")),
        lambda x: F.struct(
            x["negate"], x["up"], x["up_only"], x["s"].endswith("^...").alias("down_only"), (x["s"].endswith("...") & ~x["s"].endswith("^...")).alias("down"),
            F.when(x["s"].endswith("^..."), _before(x["s"], 4)).when(x["s"].endswith("..."), _before(x["s"], 3)).otherwise(x["s"]).alias("s"),
        ),
    )

    def ref(x: Column) -> Column:
        s, before = x["s"], F.regexp_extract(x["s"], r"^(?s)(.+)\[[^\]]+\]$", 1)
        bare = s.startswith("[") & s.endswith("]")
        ranged = ~bare & (before != "") & ~before.startswith("./") & (before != ".")
        return F.struct(
            x.alias("x"), bare.alias("bare"), F.when(bare, F.substring(s, 2, F.greatest(F.length(s) - 2, F.lit(0)))).when(ranged, F.regexp_extract(s, r"\[([^\]]+)\]$", 1)).alias("since"),
            (ranged & before.endswith("^...")).alias("wrong_end"), (ranged & before.endswith("...")).alias("via"),
            F.when(ranged, F.when(before.endswith("..."), _before(before, 3)).otherwise(before)).otherwise(s).alias("s"),
        )

    def named(x: Column) -> Column:
        s, name_part = x["s"], F.regexp_extract(x["s"], r"^([^{}]+)\{[^{}]*\}$", 1)
        braced, dotted = s.startswith("{") & s.endswith("}"), s.startswith("./") | (s == ".")
        tag = s.startswith("tag:")
        inside = ~tag & (name_part != "") & ~name_part.startswith("./") & (name_part != ".")
        form = F.when(inside, F.regexp_extract(s, r"\{([^{}]*)\}$", 1)).when(tag | (s == "//"), None).when(dotted, s).when(braced, F.substring(s, 2, F.greatest(F.length(s) - 2, F.lit(0))))
        kind = F.when(x["bare"], "changed").when(s == "//", "root").when(tag, "tag").when(inside, "name").when(dotted | braced, "path").otherwise("name")
        return F.struct(x.alias("x"), kind.alias("kind"), F.when(~x["bare"], form).alias("form"), inside.alias("inside"), F.when(inside, name_part).when(tag, _behind(s, 4)).otherwise(s).alias("rest"))

    def whole(y: Column) -> Column:
        x, kind, rest = y["x"], y["kind"], y["rest"]
        # a name with a slash outside a scope may turn out to be a directory
        as_dir = (kind == "name") & ~y["inside"] & F.contains(rest, F.lit("/")) & ~rest.startswith("@")
        path = F.when(y["form"].isNotNull(), _path(y["form"])).when(as_dir, _path(rest))
        error = (
            F.when(F.regexp_like(raw, F.lit(_CONTROL)), "control character").when(x["bare"], None).when(x["wrong_end"], "^... before a ref").when(x["s"] == "", "names no project")
            .when((kind == "tag") & (rest == ""), "names no tag").when(F.trim(y["form"]) == "", "names no project").when(_outside(path), "outside the root")
        )
        matcher = F.when(kind.isin("changed", "root"), "").when(kind == "path", path).otherwise(rest)
        w = x["x"]
        values = [w["negate"], w["down"], w["up"], w["down_only"], w["up_only"], kind, matcher, F.when(y["inside"], path), x["since"], x["via"]]
        names = [f.split()[0] for f in _FILTER.split(", ")][1:]
        return bound(F.struct(error.alias("error"), *[v.alias(n) for n, v in zip(names, values, strict=True)]), lambda z: F.struct(z["error"].alias("error"), *[F.when(z["error"].isNull(), z[n]).alias(n) for n in names]))

    return bound(head, ref, named, whole)


def dependency_spec(raw: Column) -> Column:
    """One struct for an entry of a task's dependencies: error, kind, project, task, negated.

    kind is self (`name`), deps (`^name`), cross (`pkg#name`), wildcardSelf
    (only stars) or wildcardDeps (`^` and stars). `!` negates any of them.
    """
    negated = raw.startswith("!")

    def read(s: Column) -> Column:
        caret = s.startswith("^")
        rest = F.when(caret, _behind(s, 1)).otherwise(s)
        return F.struct(s.alias("s"), caret.alias("caret"), rest.alias("rest"), F.regexp_like(rest, F.lit(r"^\*+$")).alias("stars"), F.instr(s, "#").alias("hash"))

    def whole(x: Column) -> Column:
        caret, rest, stars, hash_ = x["caret"], x["rest"], x["stars"], x["hash"]
        project, task = F.left(x["s"], F.greatest(hash_ - 1, F.lit(0))), _behind(x["s"], hash_)
        error = (
            F.when(raw == "", "empty").when(x["s"] == "", "negation with no body").when(caret & (rest == ""), "no task name").when(caret & ~stars & (hash_ > 0), "^ and # together")
            .when(~caret & ~stars & (hash_ > 0) & ((project == "") | (task == "")), "no project or no task")
        )
        kind = F.when(caret, F.when(stars, "wildcardDeps").otherwise("deps")).when(stars, "wildcardSelf").when(hash_ > 0, "cross").otherwise("self")
        made = F.struct(error.alias("error"), kind.alias("kind"), project.alias("project"), F.when(kind == "cross", task).otherwise(rest).alias("task"))
        good = lambda z, c: F.when(z["error"].isNull(), c)
        return bound(
            made,
            lambda z: F.struct(
                z["error"].alias("error"), good(z, z["kind"]).alias("kind"), good(z, F.when(z["kind"] == "cross", z["project"])).alias("project"),
                good(z, F.when(z["kind"].isin("cross", "deps", "self"), z["task"])).alias("task"), good(z, negated).alias("negated"),
            ),
        )

    return bound(F.when(negated, _behind(raw, 1)).otherwise(raw), read, whole)


#: Names that a range may stand for; a longer one is left as it is written.
RANGE_LIMIT = 1024
#: Stand-ins for { } and , that belong to the text: escaped, in a class, unpaired, or around what names no alternatives.
_OPEN, _CLOSE, _COMMA = "\ue000", "\ue001", "\ue002"


def _ranged(body: Column) -> Column:
    """The names of `1..3`, `01..03`, `1..10..3` or `a..c` as an array; null for anything else."""
    numbers = r"^(-?\d{1,15})\.\.(-?\d{1,15})(?:\.\.(-?\d{1,15}))?$"
    letters = r"^(?:([a-z])\.\.([a-z])|([A-Z])\.\.([A-Z]))(?:\.\.(-?\d{1,15}))?$"
    num = F.regexp_like(body, F.lit(numbers))
    low, high = F.regexp_extract(body, numbers, 1), F.regexp_extract(body, numbers, 2)
    letter = lambda k: F.concat(F.regexp_extract(body, letters, k), F.regexp_extract(body, letters, k + 2))
    start = F.when(num, low.try_cast("long")).otherwise(F.ascii(letter(1)).cast("long"))
    end = F.when(num, high.try_cast("long")).otherwise(F.ascii(letter(2)).cast("long"))
    asked = F.abs(F.coalesce(F.when(num, F.regexp_extract(body, numbers, 3)).otherwise(F.regexp_extract(body, letters, 5)).try_cast("long"), F.lit(1)))
    step = F.when(asked == 0, F.lit(1)).otherwise(asked)
    padded = num & (F.regexp_like(low, F.lit(r"^-?0\d")) | F.regexp_like(high, F.lit(r"^-?0\d")))
    width = F.when(padded, F.greatest(F.length(low), F.length(high))).otherwise(0)
    # numbers longer than asked for are kept whole: lpad would cut them
    wide = lambda text, w: F.when(F.length(text) >= w, text).otherwise(F.lpad(text, w, "0"))
    shown = lambda i: F.when(~num, F.char(i)).when(i < 0, F.concat(F.lit("-"), wide((-i).cast("string"), width - 1))).otherwise(wide(i.cast("string"), width))
    fits = (num | F.regexp_like(body, F.lit(letters))) & (F.abs(end - start) / step < RANGE_LIMIT)
    return F.when(fits, F.transform(F.sequence(start, end, F.when(start <= end, step).otherwise(-step)), shown))


def brace_alternatives(pattern: Column) -> Column:
    """The patterns that one with brace groups stands for, each once, as an array.

    Groups hold two or more alternatives or a range and may be nested; one
    that holds neither stays. Braces and commas behind a backslash or in a
    class are text, and from a brace that never closes on all is text. An
    expression: a fold over the groups, the innermost ones first.
    """
    hide = lambda text: F.translate(text, "{},", _OPEN + _CLOSE + _COMMA)
    # braces, escapes and classes one by one, what lies between them as a whole
    tokens = F.regexp_extract_all(pattern, F.lit(r"(?s)\\.|\[.[^\]]*\]|[{}]|[^\\\[{}]+|."), F.lit(0))
    tokens = F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit("\\")) | F.startswith(t, F.lit("[")), hide(t)).otherwise(t))

    def folded(tokens: Column) -> Column:
        # where the last group opened while none was open, and how many still are at the end
        depth = F.aggregate(
            tokens, F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("at")),
            lambda acc, t: F.struct(
                (acc["i"] + 1).alias("i"), F.when(t == "{", acc["depth"] + 1).when(t == "}", F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"]).alias("depth"),
                F.when((t == "{") & (acc["depth"] == 0), acc["i"]).otherwise(acc["at"]).alias("at"),
            ),
        )
        return F.struct(tokens.alias("tokens"), depth.alias("depth"))

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x["tokens"], lambda t, i: F.when((x["depth"]["depth"] > 0) & (i >= x["depth"]["at"]), hide(t)).otherwise(t)), "")

    def grown(x: Column) -> Column:
        names = F.when(F.contains(x["body"], F.lit(",")), F.split(x["body"], ",")).otherwise(_ranged(x["body"]))
        return F.coalesce(F.transform(names, lambda n: F.concat(x["head"], n, x["tail"])), F.array(F.concat(x["head"], F.lit(_OPEN), x["body"], F.lit(_CLOSE), x["tail"])))

    def expanded(p: Column) -> Column:
        # the first group with no other in it
        cut = F.struct(*[F.regexp_extract(p, r"(?s)^(.*?)\{([^{}]*)\}(.*)$", k).alias(n) for k, n in ((1, "head"), (2, "body"), (3, "tail"))])
        return F.when(F.regexp_like(p, F.lit(r"\{[^{}]*\}")), bound(cut, grown)).otherwise(F.array(p))

    groups = F.length(pattern) - F.length(F.replace(pattern, F.lit("{"), F.lit("")))
    every = lambda text: F.aggregate(F.sequence(F.lit(1), F.greatest(groups, F.lit(1))), F.array(text), lambda acc, _: F.array_distinct(F.flatten(F.transform(acc, expanded))))
    shown = lambda every: F.array_distinct(F.transform(every, lambda p: F.translate(p, _OPEN + _CLOSE + _COMMA, "{},")))
    # most patterns have no group
    return F.when(~F.contains(pattern, F.lit("{")), F.array(pattern)).otherwise(bound(tokens, folded, joined, every, shown))
