"""Format strings as columns: what a template holds between its values, and where the values go.

A piece is (text, key, plain): literal text has no key; a value's place has its position or name as key, and is plain if the value stands there as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a conversion of the % operator is made of
CONVERSION = r"%(?:\(([^)]*)\))?([-#0 +]*)(\*|\d+)?(?:\.(\*|\d+))?[hlL]?([diouxXeEfFgGcrsa])"
# of str.format: a place with its name, conversion and specification, which may hold places itself
PLACE = r"\{([^{}!:]*)(?:!([^{}]))?(?::((?:[^{}]|\{[^{}]*\})*))?\}"
PIECES = "array<struct<text:string,key:string,plain:boolean>>"
LONGEST_EXPRESSION = 200  # fixed value: characters of an expression that is shown


def _piece(text: Column, key: Column, plain: Column) -> Column:
    return F.struct(text.cast("string").alias("text"), key.cast("string").alias("key"), plain.alias("plain"))


def _literal(text: Column) -> Column:
    return _piece(text, F.lit(None), F.lit(None).cast("boolean"))


def _numbered(tokens: Column, counts) -> Column:
    """(t, n): each token with how many before it ``counts`` is true of."""
    start = F.struct(F.array().cast("array<struct<t:string,n:int>>").alias("out"), F.lit(0).alias("n"))
    step = lambda s, t: F.struct(F.array_append(s["out"], F.struct(t.alias("t"), s["n"].alias("n"))).alias("out"), (s["n"] + F.when(counts(t), 1).otherwise(0)).alias("n"))
    return F.aggregate(tokens, start, step, lambda s: s["out"])


def percent_pieces(template: Column, keyed: bool) -> Column:
    """Pieces of a template of the % operator; ``keyed`` if its values come by name.

    Null if it can't be told: a stray percent sign, a width or precision that is a value itself, names where positions are asked for, or the other way round.
    """
    tokens = F.regexp_extract_all(template, F.lit(rf"(?s)%%|{CONVERSION}|[^%]+|%"), F.lit(0))
    place = lambda t: t.startswith("%") & (t != "%%")
    part = lambda t, k: F.regexp_extract(t, f"^{CONVERSION}$", k)
    named = lambda t: t.startswith("%(")
    bad = lambda t: place(t) & ((t == "%") | (part(t, 3) == "*") | (part(t, 4) == "*") | (named(t) != F.lit(keyed)))

    def one(x: Column) -> Column:
        t = x["t"]
        plain = t.rlike(r"^%(\([^)]*\))?[hlL]?s$")
        key = part(t, 1) if keyed else x["n"].cast("string")
        return F.when(place(t), _piece(F.lit(None), key, plain)).when(t == "%%", _literal(F.lit("%"))).otherwise(_literal(t))

    return F.when(~F.exists(tokens, bad), F.transform(_numbered(tokens, place), one)).cast(PIECES)


def format_pieces(template: Column) -> Column:
    """Pieces of a template of str.format; null if its braces don't match or a place looks into its value."""
    tokens = F.regexp_extract_all(template, F.lit(rf"(?s)\{{\{{|\}}\}}|{PLACE}|[^{{}}]+|[{{}}]"), F.lit(0))
    place = lambda t: t.startswith("{") & ~t.isin("{", "{{")
    part = lambda t, k: F.regexp_extract(t, f"(?s)^{PLACE}$", k)
    bad = lambda t: t.isin("{", "}") | (place(t) & part(t, 1).rlike(r"[.\[]"))

    def one(x: Column) -> Column:
        t = x["t"]
        name = part(t, 1)
        key = F.when(name == "", x["n"].cast("string")).when(name.rlike(r"^\d+$"), F.regexp_replace(name, r"^0+(?=\d)", "")).otherwise(name)
        plain = (part(t, 3) == "") & part(t, 2).isin("", "s")
        return F.when(place(t), _piece(F.lit(None), key, plain)).when(t.isin("{{", "}}"), _literal(F.substring(t, 1, 1))).otherwise(_literal(t))

    return F.when(~F.exists(tokens, bad), F.transform(_numbered(tokens, lambda t: place(t) & (part(t, 1) == "")), one)).cast(PIECES)


def pieces_text(pieces: Column) -> Column:
    """Pieces as one text, values as {key} and those that aren't plain as {!key}."""
    return F.array_join(F.transform(pieces, lambda p: F.when(p["key"].isNull(), p["text"]).otherwise(F.concat(F.when(p["plain"], F.lit("{")).otherwise(F.lit("{!")), p["key"], F.lit("}")))), "")


def shown(expression: Column, longest: int = LONGEST_EXPRESSION) -> Column:
    """Source of an expression with its white space as single spaces, cut with an ellipsis to ``longest`` characters."""
    plain = F.trim(F.regexp_replace(expression, r"(?U)\s+", " "))
    return F.when(F.length(plain) > longest, F.concat(F.substring(plain, 1, longest - 1), F.lit("…"))).otherwise(plain)
