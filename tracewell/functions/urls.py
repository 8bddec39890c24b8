"""URL composition and path templates as columns.

A path is text in which a value stands as the mark VALUE; templates write it as {}.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "￼"
# fixed values: characters that stand for themselves in a path segment (RFC 3986 pchar without %), and those never encoded
LITERAL = r"A-Za-z0-9\-._~!$&'()*+,;=:@"
UNRESERVED = r"A-Za-z0-9\-._~"
LONGEST_TEMPLATE = 2048
MASK_LENGTH = 16
MASK_ALL, MASK_AFTER = ("hooks.slack.com",), ("discord.com", "discordapp.com")


def _fold(array: Column, start: Column, step) -> Column:
    return F.aggregate(array, start, step)


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 section 5.2.4 for a path that starts with a slash."""
    segments = F.slice(F.split(path, "/"), 2, 1_000_000)
    last = F.size(segments) - 1
    numbered = F.transform(segments, lambda s, i: F.struct(s.alias("s"), (i == last).alias("last")))
    none = F.array().cast("array<string>")

    def step(out: Column, x: Column) -> Column:
        up = F.when(F.size(out) > 0, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(out)
        base = F.when(x["s"] == "..", up).when(x["s"] == ".", out).otherwise(F.array_append(out, x["s"]))
        return F.when(x["last"] & x["s"].isin(".", ".."), F.array_append(base, F.lit(""))).otherwise(base)

    return F.concat(F.lit("/"), F.array_join(_fold(numbered, none, step), "/"))


def split_url(url: Column) -> Column:
    """(kind, authority, path): of a literal URL; kind is absolute, relative or dynamic."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(raw) + 1, F.length(rest))
    host = F.lower(F.regexp_replace(F.regexp_replace(raw, r"^.*@", ""), ":$", ""))
    fine = host.rlike(r"^(\[[0-9a-f:.]+\]|[a-z0-9\-._~%!$&'()*+,;=]+)(:[0-9]*)?$")
    path = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    kind = F.when(scheme.isin("http", "https"), "absolute").when((scheme != "") | url.startswith("//") | (url == ""), "dynamic").otherwise("relative")
    return F.struct(kind.alias("kind"), F.when((kind == "absolute") & fine, host).alias("authority"), F.when(kind == "absolute", path).when(kind == "relative", url).alias("path"))


def cut_query(path: Column) -> Column:
    """The path before its first ? or #."""
    return F.regexp_replace(path, r"(?s)[?#].*$", "")


def has_query(path: Column) -> Column:
    return path.rlike("[?#]")


def normalize_path(path: Column) -> Column:
    """Upper-case hex, no encoding of unreserved characters, all else that a segment can't hold encoded as UTF-8; slashes stay."""
    token = rf"(?s)%[0-9A-Fa-f]{{2}}|."

    def one(t: Column) -> Column:
        pair = F.unhex(F.substring(t, 2, 2))
        plain = F.decode(pair, "US-ASCII")
        coded = F.regexp_replace(F.hex(F.encode(t, "UTF-8")), "(..)", "%$1")
        return F.when(t.rlike("^%[0-9A-Fa-f]{2}$"), F.when((F.hex(pair) < "80") & plain.rlike(rf"^[{UNRESERVED}]$"), plain).otherwise(F.upper(t))).when(t.rlike(rf"^[{LITERAL}/]$"), t).otherwise(coded)

    return F.array_join(F.transform(F.regexp_extract_all(path, F.lit(token), F.lit(0)), one), "")


def encode_literal(text: Column) -> Column:
    """A decoded literal in template form; a percent sign is a character like others."""
    return normalize_path(F.replace(text, F.lit("%"), F.lit("%25")))


def join_path(style: str, base: Column | None, path: Column, version: tuple[int, int] | None = None) -> Column:
    """(raw, ambiguous): ``path`` on ``base`` (null: unknown; empty: host alone) in a client's way."""
    shape = lambda raw, ambiguous=None: F.struct(raw.alias("raw"), (F.lit(False) if ambiguous is None else ambiguous).alias("ambiguous"))
    none = shape(F.lit(None).cast("string"), F.lit(True))
    base = F.lit(None).cast("string") if base is None else base
    bare = F.regexp_replace(path, "^/+", "")

    def tail(p: Column) -> Column:
        segments = F.split(p, "/")
        last = F.size(segments) - 1
        kept = F.filter(F.transform(segments, lambda s, i: F.when((s == ".") & (i < last), F.lit(None).cast("string")).when(s == ".", F.lit("")).otherwise(s)), lambda s: s.isNotNull())
        return F.when((p == "") | F.array_contains(segments, ".."), none).otherwise(shape(F.concat(F.lit("/"), F.array_join(kept, "/"))))

    rfc = (
        F.when(path.startswith("/"), shape(remove_dot_segments(path)))
        .when(base.isNull(), tail(path))
        .when(path == "", shape(remove_dot_segments(F.when(base == "", "/").otherwise(base))))
        .when(base == "", shape(remove_dot_segments(F.concat(F.lit("/"), path))))
        .otherwise(shape(remove_dot_segments(F.concat(F.regexp_extract(base, r"^(?s)(.*/)?", 0), path))))
    )
    if style == "rfc3986":
        out = rfc
    elif style == "httpx-base-url":
        out = F.when(base.isNull(), tail(bare)).otherwise(shape(remove_dot_segments(F.concat(F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/"))), bare))))
    elif style == "aiohttp-base-url":
        modern = version is not None and version >= (3, 11)
        stuck = F.lit(False)
        if not modern:
            stuck = (base.isNotNull() & ~base.isin("", "/")) | ~path.startswith("/")
        else:
            stuck = base.isNotNull() & ~base.isin("", "/") & ~base.endswith("/")
        out = F.when(F.coalesce(stuck, F.lit(False)), none).otherwise(rfc)
    elif style == "slash-join":
        out = F.when(base.isNull(), shape(F.concat(F.lit("/"), bare))).otherwise(shape(F.concat(F.regexp_replace(base, "/?/$", ""), F.lit("/"), bare)))
    elif style == "dio-concat":
        whole = shape(remove_dot_segments(F.replace(F.concat(base, path), F.lit("//"), F.lit("/"))))
        out = F.when(base.isNull() & path.startswith("/"), shape(path)).when(base.isNull() | ((base == "") & ~path.startswith("/")), none).otherwise(whole)
    elif style == "no-base":
        out = shape(F.lit(None).cast("string"))
    else:
        raise ValueError(f"unknown join style {style}")
    return F.when(path.startswith("//"), none).otherwise(out)


def mask_template(template: Column, authority: Column) -> Column:
    """(template, masked): secret-looking segments, and those of web hooks, become {}; and how many."""
    host = F.when(authority.startswith("["), authority).otherwise(F.regexp_replace(F.coalesce(authority, F.lit("")), r":[^:]*$", ""))
    segments = F.split(template, "/")
    hook = host.isin(*MASK_AFTER) & (F.get(segments, F.lit(1)) == "api") & (F.get(segments, F.lit(2)) == "webhooks")

    def hidden(s: Column, i: Column) -> Column:
        plain = F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
        secret = (F.length(plain) >= MASK_LENGTH) & plain.rlike("[A-Za-z]") & plain.rlike("[0-9]")
        return (i > 0) & (s != "") & ~s.contains("{}") & (host.isin(*MASK_ALL) | (F.coalesce(hook, F.lit(False)) & (i >= 3)) | secret)

    marked = F.transform(segments, lambda s, i: F.struct(F.when(hidden(s, i), "{}").otherwise(s).alias("s"), hidden(s, i).cast("int").alias("m")))
    return F.struct(F.array_join(F.transform(marked, lambda x: x["s"]), "/").alias("template"), F.aggregate(marked, F.lit(0), lambda a, x: a + x["m"]).alias("masked"))


def template_problem(template: Column) -> Column:
    """The first thing, from left to right, that a canonical template can't hold; null if there is none."""
    code = r"%(?:[0189A-F][0-9A-F]|2[0-9A-C F]|3[A-F]|[46]0|5[B-E]|7[B-DF])".replace(" ", "")
    unit = rf"(?:[{LITERAL}]|{code})"
    segments = F.slice(F.split(template, "/"), 2, 1_000_000)
    last = F.size(segments) - 1

    def of(s: Column, i: Column) -> Column:
        head = F.regexp_replace(s, rf"^{unit}*+", "")  # from the first character that is no plain one
        param = head.startswith("{}")
        rest = F.when(param, F.regexp_replace(head, rf"^\{{\}}{unit}*+", "")).otherwise(head)
        pair = F.substring(rest, 2, 2)
        problem = (
            F.when(s == "{**}", F.when(i != last, "catch-all-not-last"))
            .when(rest == "", None)
            .when(rest.startswith("{**}"), "catch-all-partial")
            .when(rest.startswith("{}"), "multiple-parameters")
            .when(rest.startswith("{") | rest.startswith("}"), "stray-brace")
            .when(rest.startswith("%"), F.when(~pair.rlike("^[0-9A-Fa-f]{2}$"), "malformed-percent").when(pair != F.upper(pair), "lowercase-percent-hex").otherwise("encoded-unreserved"))
            .otherwise("invalid-character")
        )
        return problem

    found = F.filter(F.transform(segments, of), lambda p: p.isNotNull())
    return F.when(F.length(template) > LONGEST_TEMPLATE, "too-long").when(~template.startswith("/"), "not-rooted").otherwise(F.get(found, F.lit(0)))
