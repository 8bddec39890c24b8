"""Route patterns written as regular expressions, turned into path templates as columns.

A pattern is taken apart into literals, escapes and groups without nesting; anything else makes it dynamic (null). Literals that may be
missing, that repeat, or that stand for one another are written out first, as patterns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.urls import encode_literal

UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"  # fixed value
MOST_EXPANSIONS = 16  # fixed value: patterns that one is written out to, at most
GROUP = r"\((?:\?P<\w+>|\?:)?(?:\\.|\[(?:\\.|[^\]])*+\]|[^()\\\[])*+\)"
CLASS = r"\[(?:\\.|[^\]])*+\]"
PLAIN = r"(?:\\[^\w]|[^\\()\[\]*+?{}|.^$])"  # a character that stands for itself
ITEM = rf"(?:{GROUP}|\\.|{CLASS}|[^\\()\[\]])(?:[*+?]\??|\{{\d+(?:,\d*)?\}})?"
PIECE = r"\((?:\?P<\w+>|\?:)?(?:\\.|\[(?:\\.|[^\]])*+\]|[^()\\\[])*+\)|\\.|\[[^\]]*\]|[^\\()\[\]]"


def parameter_kind(inner: Column) -> Column:
    """What a group takes: int, slug, uuid, path (anything with slashes), none (a whole segment) or regex."""
    return (
        F.when(F.lower(inner) == UUID, "uuid")
        .when(inner.rlike(r"^(\\d|\[0-9\]|\[\\d\])\+$"), "int")
        .when(inner.rlike(r"^\[(-a-zA-Z0-9_|a-zA-Z0-9_-|-\\w|\\w-)\]\+$"), "slug")
        .when(inner.isin("[^/]+", "[^/]*"), "none")
        .when(inner.isin(".+", ".*"), "path")
        .otherwise("regex")
    )


def expansions(pattern: Column) -> Column:
    """The patterns that one is written out to, in order: a literal with ? is missing or there, one with {n} stands n times, and alternatives of a
    group and of a class of plain characters stand for themselves. Null beyond MOST_EXPANSIONS; a slash with ? at the end is left as it is.
    """
    tail = F.regexp_extract(pattern, r"(/\?)?(\$|\\Z)?$", 0)
    items = F.regexp_extract_all(F.substring(pattern, F.lit(1), F.length(pattern) - F.length(tail)), F.lit(ITEM), F.lit(0))

    def options(x: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(x, r"^\((\?P<\w+>|\?:)?", ""), r"\)\??$", "")
        told = F.split(F.regexp_replace(inner, rf"((?:\\.|{CLASS}|[^|\\\[])*+)\|", "$1\u0001"), "\u0001", -1)
        single = rf"^(?:\\[dw]|{CLASS})(?:\+|\{{\d+\}})?$"  # one parameter
        readable = F.forall(told, lambda t: t.rlike(rf"^{PLAIN}*$") | t.rlike(single))
        each = F.transform(told, lambda t: F.when(t.rlike(single), F.concat(F.lit("("), t, F.lit(")"))).otherwise(t))
        times = F.regexp_extract(x, r"\{(\d+)\}$", 1).cast("int")
        return (
            F.when(x.rlike(rf"^{GROUP}$") & (F.size(told) > 1) & readable, each)
            .when(x.rlike(rf"^\(\?:{PLAIN}+\)\?$"), F.array(F.lit(""), inner))
            .when(x.rlike(rf"^{PLAIN}\?$"), F.array(F.lit(""), F.regexp_replace(x, r"\?$", "")))
            .when(x.rlike(rf"^{PLAIN}\{{\d{{1,3}}\}}$"), F.array(F.repeat(F.regexp_replace(x, r"\{\d+\}$", ""), times)))
            .when(x.rlike(r"^\[[^\]^\\-][^\]\\-]*\]$"), F.transform(F.split(F.substring(x, F.lit(2), F.length(x) - 2), ""), lambda c: F.when(c.rlike(r"^[*+?{}|.^$()\[]$"), F.concat(F.lit("\\"), c)).otherwise(c)))
            .otherwise(F.array(x))
        )

    def cross(done: Column, more: Column) -> Column:
        many = done.isNull() | (F.size(done) * F.size(more) > MOST_EXPANSIONS)
        return F.when(~many, F.flatten(F.transform(done, lambda d: F.transform(more, lambda m: F.concat(d, m)))))

    whole = F.length(F.array_join(items, "")) == F.length(pattern) - F.length(tail)
    made = F.aggregate(F.transform(items, options), F.array(F.lit("")), cross)
    return F.when(~whole, F.array(pattern)).otherwise(F.transform(made, lambda m: F.concat(m, tail)))


def pieces(pattern: Column) -> Column:
    """An array of (text, kind): kind is literal, a parameter's kind, or null for what can't be read."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"^\^", ""), r"(\$|\\Z|/\?\$)$", "")
    found = F.regexp_extract_all(body, F.lit(PIECE), F.lit(0))

    def one(p: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(p, r"^\((\?P<\w+>|\?:)?", ""), r"\)$", "")
        kind = parameter_kind(inner)
        group = p.startswith("(")
        plain = F.when(p.startswith("\\"), F.when(p.rlike(r"^\\[^\w]$"), F.substring(p, 2, 1))).when(p.startswith("["), None).when(p.rlike(r"^[.*+?|{}^$]$"), None).otherwise(p)
        # a group that can take a slash is no parameter of one segment
        outside = F.regexp_replace(inner, r"\[(?:\\.|[^\]])*\]", "")
        wide = (kind == "regex") & (outside.rlike(r"(?<!\\)\.|\\[WSDs]|/") | inner.rlike(r"\[\^(?![^\]]*/)|\[[^\^\]][^\]]*/|\[/|\[[^\]]*\\[WSD]"))
        open_ = group & (p.startswith("(?:") | inner.contains("|") | wide)
        return F.struct(F.when(group, F.lit("{}")).otherwise(plain).alias("text"), F.when(open_, None).when(group, kind).when(plain.isNotNull(), "literal").alias("kind"))

    whole = F.length(F.array_join(found, "")) == F.length(body)
    return F.when(whole, F.transform(found, one))


def pattern_template(pattern: Column) -> Column:
    """The template of a whole-path pattern, / in front; null if it can't be told."""
    parts = pieces(pattern)
    fine = F.forall(parts, lambda p: p["kind"].isNotNull())
    text = F.array_join(F.transform(parts, lambda p: F.when(p["kind"] == "literal", encode_literal(p["text"])).when(p["kind"] == "path", F.lit("{**}")).otherwise(F.lit("{}"))), "")
    full = F.concat(F.when(text.startswith("/"), F.lit("")).otherwise(F.lit("/")), text)
    bad = full.rlike(r"\{\*\*\}.") | full.rlike(r"[^/]\{\*\*\}") | full.rlike(r"\{\}[^/]*\{\}")
    return F.when(F.coalesce(fine, F.lit(False)) & ~bad, full)


def pattern_templates(pattern: Column) -> Column:
    """The templates of a whole-path pattern with its alternatives written out, each once; null if one can't be told."""
    each = F.transform(expansions(pattern), pattern_template)
    return F.when(F.forall(each, lambda t: t.isNotNull()), F.array_distinct(each))


def pattern_rules(pattern: Column, endpoint: Column) -> Column:
    """Path rules (as of path()) that take what a pattern takes of the path that is left, one for each way to write it out, and
    two where its last slash may be missing; null if one can't be told.
    """
    each = F.transform(expansions(pattern), lambda p: _rules(p, endpoint))
    return F.when(F.forall(each, lambda r: r.isNotNull()), F.array_distinct(F.flatten(each)))


def _rules(pattern: Column, endpoint: Column) -> Column:
    """Rules of one pattern without alternatives.

    A pattern of a view has to end with $, which makes it take all that is left; one of an include has to start with ^ and not to end with $.
    """
    ends = pattern.rlike(r"(?<!\\)\$$|\\Z$")
    parts = pieces(pattern)
    one = lambda p, i: F.when(p["kind"] == "literal", p["text"]).otherwise(F.concat(F.lit("<"), F.when(p["kind"].isin("int", "slug", "uuid", "path"), F.concat(p["kind"], F.lit(":"))).otherwise(F.lit("")), F.lit("p"), i.cast("string"), F.lit(">")))
    text = F.array_join(F.transform(parts, one), "")
    fine = F.forall(parts, lambda p: p["kind"].isNotNull() & ~((p["kind"] == "literal") & p["text"].isin("<", ">"))) & F.when(endpoint, ends).otherwise(pattern.startswith("^") & ~ends)
    return F.when(F.coalesce(fine, F.lit(False)), F.when(endpoint & optional_slash(pattern), F.array(text, F.concat(text, F.lit("/")))).otherwise(F.array(text)))


def optional_slash(pattern: Column) -> Column:
    return pattern.rlike(r"/\?\$$")


def pattern_kinds(pattern: Column) -> Column:
    """Kinds of the parameters that are narrowed, in order, comma-joined."""
    narrow = F.filter(pieces(pattern), lambda p: p["kind"].isin("int", "slug", "uuid", "path", "regex"))
    return F.array_join(F.transform(narrow, lambda p: p["kind"]), ",")
