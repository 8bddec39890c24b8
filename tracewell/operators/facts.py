"""Fact tables: exact duplicates, order, limitation counts, scopes and registration order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.urls import template_problem
from tracewell.operators.ranking import numbered

# fixed values: bounds of a document
MOST_FACTS, MOST_SCOPES, LONGEST_GROUP, LARGEST_INDEX = 100_000, 1_000, 256, 2**53 - 1
HTTP_METHODS = ("GET", "HEAD", "POST", "PUT", "DELETE", "CONNECT", "OPTIONS", "TRACE", "PATCH")  # fixed values


# fixed values: what names of a document can't hold, and white space at the ends of a text
CONTROL = r"[\x00-\x1F\x7F-\x9F\u2028\u2029]"
ENDS = r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$"


class LimitError(ValueError):
    """A document would be larger than it may be."""


def unique_sorted(facts: DataFrame, *order: str) -> DataFrame:
    """Facts without exact duplicates, in order; an error if there are more than a document holds."""
    once = facts.dropDuplicates()
    if once.limit(MOST_FACTS + 1).count() > MOST_FACTS:
        raise LimitError(f"more than {MOST_FACTS} facts")
    return once.orderBy(*(F.coalesce(F.col(c), F.lit("")) if c == "channel" else F.col(c) for c in order))


def limitation_counts(gaps: DataFrame) -> DataFrame:
    """(prefix, sentence): one sentence for each prefix and message, with its count in place of {count}."""
    counts = gaps.groupBy("prefix", "message").agg(F.count("*").alias("n"))
    return counts.select("prefix", F.concat(F.col("prefix"), F.lit(": "), F.replace("message", F.lit("{count}"), F.col("n").cast("string"))).alias("sentence"))


# a scope's fields, and the form of comparison that each asks for
SCOPE_PATHS = ("templates", "template_prefixes", "template_suffixes")


def scope_problem(*, templates: Column, template_prefixes: Column, template_suffixes: Column, methods: Column) -> Column:
    """What is first wrong with a scope, of arrays that are null where it doesn't name them; null if nothing is."""
    fields = dict(zip(SCOPE_PATHS, (templates, template_prefixes, template_suffixes), strict=True))

    def of(name: str, values: Column) -> Column:
        def one(t: Column) -> Column:
            out = F.when(t.isNull() | template_problem(t).isNotNull(), f"{name}: not canonical")
            if name != "templates":
                out = out.when(t.contains("{**}"), f"{name}: catch-all")
            if name == "template_prefixes":
                out = out.when((t != "/") & t.endswith("/"), f"{name}: ends with a slash")
            return out.when(t == "/", f"{name}: only a slash") if name == "template_suffixes" else out

        first = F.get(F.filter(F.transform(values, one), lambda p: p.isNotNull()), F.lit(0))
        return F.when(values.isNotNull(), F.when(F.size(values) == 0, f"{name}: empty").otherwise(first))

    bad = F.exists(methods, lambda m: ~F.coalesce(m.isin(*HTTP_METHODS), F.lit(False)))
    verbs = F.when(methods.isNotNull(), F.when(F.size(methods) == 0, "methods: empty").when(bad, "methods: unknown").when(F.size(F.array_distinct(methods)) < F.size(methods), "methods: repeated"))
    nowhere = F.when(templates.isNull() & template_prefixes.isNull() & template_suffixes.isNull(), "no paths")
    return F.coalesce(nowhere, *(of(name, c) for name, c in fields.items()), verbs)


def limitations(gaps: DataFrame) -> DataFrame:
    """(limitation_index, sentence, templates, template_prefixes, template_suffixes, methods): what a document tells of gaps, in order.

    Gaps are (prefix, message) and those four arrays. Gaps without a scope, or with one that has a problem, count by prefix and message;
    of others, each scope has a sentence of its own. Beyond MOST_SCOPES scopes, each only adds to the count: wider, never narrower.
    """
    names = [*SCOPE_PATHS, "methods"]
    fine = F.coalesce(*SCOPE_PATHS).isNotNull() & scope_problem(**{c: F.col(c) for c in names}).isNull()
    told = gaps.select("prefix", "message", fine.alias("scoped"), *(F.when(fine, F.col(c)).alias(c) for c in names))
    scoped = told.where("scoped").distinct()
    if scoped.limit(MOST_SCOPES + 1).count() > MOST_SCOPES:
        scoped = scoped.select("prefix", "message", F.lit(False).alias("scoped"), *(F.lit(None).cast("array<string>").alias(c) for c in names))
    sentence = lambda n: F.concat("prefix", F.lit(": "), F.replace("message", F.lit("{count}"), n.cast("string"))).alias("sentence")
    open_ = told.where("NOT scoped").unionByName(scoped.where("NOT scoped")).groupBy("prefix", "message").agg(F.count("*").alias("n"))
    rows = open_.select(sentence(F.col("n")), *(F.lit(None).cast("array<string>").alias(c) for c in names)).unionByName(scoped.where("scoped").select(sentence(F.lit(1)), *names))
    rows = rows.withColumn("scope", F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "true"}))
    return numbered(rows, "sentence", "scope", name="limitation_index").drop("scope")


def _relation_uses(uses: DataFrame) -> DataFrame:
    bad = lambda c: F.col(c).rlike(CONTROL)
    column = F.col("column_name").isNull() | ((F.col("column_name") != "") & ~bad("column_name"))
    static = ~F.col("dynamic") & F.forall(F.split("channel", r"\.", -1), lambda s: s != "") & ~bad("channel") & column
    static = F.coalesce(static, F.lit(False))
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("channel", F.lit("")), CONTROL, " "), ENDS, "")
    channel = F.when(static, F.col("channel")).when(plain == "", "<dynamic>").otherwise(plain)
    return uses.select(channel.alias("channel"), F.when(static, F.col("column_name")).alias("method"), (~static).alias("dynamic"), "path", "line", "column", "usr", (~static & ~F.col("dynamic")).alias("demoted"))


def relation_uses(uses: DataFrame) -> DataFrame:
    """(channel, method, dynamic, path, line, column, usr), each once: uses (channel, column_name, dynamic, path, line, column, usr) as a document carries them.

    A name with an empty part or a control character becomes dynamic, without its column; an empty dynamic text becomes <dynamic>.
    """
    return _relation_uses(uses).drop("demoted").distinct()


def relation_use_limits(uses: DataFrame) -> DataFrame:
    """(prefix, sentence): how many uses became dynamic, and how many facts have no declaration around them; no row for none."""
    n = F.count("*").alias("n")
    demoted = _relation_uses(uses).where("demoted").agg(n).select(F.lit("invalid-relation-names").alias("prefix"), "n", F.lit("names the exchange format cannot carry became dynamic").alias("message"))
    missing = relation_uses(uses).where("usr IS NULL").agg(n).select(F.lit("missing-relation-usrs").alias("prefix"), "n", F.lit("facts are outside any function or class").alias("message"))
    return demoted.unionByName(missing).where("n > 0").select("prefix", F.concat("prefix", F.lit(": "), F.col("n").cast("string"), F.lit(" "), "message").alias("sentence"))


def emitted_methods(methods: Column) -> Column:
    """Upper-cased verbs, each once in order; HEAD goes where GET is."""
    once = F.array_distinct(F.transform(methods, F.upper))
    return F.when(F.array_contains(once, "GET"), F.array_remove(once, "HEAD")).otherwise(once)


def longest_prefix(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(name, label) by the longest dotted prefix in ``prefixes`` (prefix, label); null for none.

    Each name's own prefixes (as many as it has parts) are joined by equality; no range join.
    """
    parts = F.split("name", r"\.")
    own = names.select("name").distinct().select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("prefix"))
    best = own.join(prefixes, "prefix").groupBy("name").agg(F.max_by("label", F.length("prefix")).alias("label"))
    return names.select("name").join(best, "name", "left")


def agreement(rows: DataFrame, key: str, value: str, proven: str) -> DataFrame:
    """(key, value): the one value that all rows of a key prove; null where they differ or any is unproven."""
    return rows.groupBy(key).agg(F.when(F.bool_and(proven) & (F.count_distinct(value) == 1), F.min(value)).alias(value))


def client_agreement(assigned: DataFrame) -> DataFrame:
    """(name, library, style, base, base_known) of names that clients are assigned to, rows (name, library, style, base, base_known).

    Clients of several libraries make a name nothing; those of one library that differ leave its base unknown, and for requests, which has none, its style too.
    """
    kind = F.struct("style", F.struct(F.col("base_known").alias("known"), F.when(F.col("base_known"), F.col("base")).alias("base")).alias("b"))
    told = assigned.groupBy("name").agg(F.count_distinct("library").alias("libraries"), F.count_distinct(kind).alias("kinds"), F.min("library").alias("library"), F.min("style").alias("least"), F.max("style").alias("most"), F.min(kind).alias("k"))
    one = F.col("kinds") == 1
    style = F.when(one, F.col("k.style")).when(F.col("library") == "requests", "no-base").when(F.col("least") == F.col("most"), F.col("least"))
    return told.where("libraries = 1").select("name", "library", style.alias("style"), F.when(one, F.col("k.b.base")).alias("base"), (one & F.col("k.b.known")).alias("base_known"))


def segments(template: Column, anchor: Column | None = None) -> Column:
    """A template's segments, one slash at the end ignored; * stands for any number of segments."""
    parts = F.slice(F.split(F.regexp_replace(template, "/$", ""), "/"), 2, 1_000_000)
    parts = F.transform(parts, lambda s: F.when(s == "{**}", "*").otherwise(F.lower(s)))
    return parts if anchor is None else F.when(anchor == "base", F.concat(F.array(F.lit("*")), parts)).otherwise(parts)


def _fits(a: Column, b: Column) -> Column:
    """True if two segments can be the same text; {} is any text, inside a segment too."""
    literal = lambda lit, part: (F.length(lit) >= F.length(part) - 2) & lit.startswith(F.substring_index(part, "{}", 1)) & lit.endswith(F.substring_index(part, "{}", -1))
    return F.when(a.contains("{}") & b.contains("{}"), True).when(a.contains("{}"), literal(b, a)).when(b.contains("{}"), literal(a, b)).otherwise(a == b)


def overlaps(a: Column, b: Column) -> Column:
    """True if two segment arrays, each with any number of *, can be the same path: reachable pairs of positions, row by row of ``a``."""
    width = F.size(b)
    star = lambda x: x == "*"

    def spread(row: Column) -> Column:
        """A * in b may take no segment: a reachable place before it reaches the one after."""
        start = F.struct(F.array().cast("array<boolean>").alias("out"), F.lit(False).alias("on"))
        pairs = F.transform(row, lambda r, j: F.struct(r.alias("r"), F.coalesce(star(F.get(b, j - 1)), F.lit(False)).alias("skip")))
        return F.aggregate(pairs, start, lambda s, x: F.struct(F.array_append(s["out"], x["r"] | (x["skip"] & s["on"])).alias("out"), (x["r"] | (x["skip"] & s["on"])).alias("on")), lambda s: s["out"])

    first = spread(F.transform(F.sequence(F.lit(0), width), lambda j: j == 0))

    def step(row: Column, x: Column) -> Column:
        # x takes a segment of b, or nothing if it is *, or many; a * of b may take x
        taken = F.transform(
            row,
            lambda r, j: (star(x) & r)
            | F.coalesce(star(F.get(b, j)) & r, F.lit(False))
            | F.coalesce(F.get(row, j - 1) & ~star(x) & (j > 0) & _fits(x, F.get(b, j - 1)) & ~star(F.get(b, j - 1)), F.lit(False)),
        )
        wide = F.aggregate(F.transform(taken, lambda t, j: F.struct(t.alias("t"), j.alias("j"))), F.struct(F.array().cast("array<boolean>").alias("out"), F.lit(False).alias("on")), lambda s, p: F.struct(F.array_append(s["out"], p["t"] | (star(x) & s["on"])).alias("out"), (p["t"] | (star(x) & s["on"])).alias("on")), lambda s: s["out"])
        return spread(wide)

    return F.element_at(F.aggregate(a, first, step), width + 1)


def method_applies(methods: Column, method: Column, side: Column) -> Column:
    """True if a scope's verbs (null: all) cover a fact's verb (null: unknown)."""
    has = lambda m: F.array_contains(methods, m)
    declared = (method == "ANY") | has(method) | ((method == "GET") & has("HEAD")) | has("OPTIONS")
    called = F.when(method.isNull() | (method == "OPTIONS"), True).when(method == "HEAD", has("HEAD") | has("GET")).otherwise(has(method))
    return F.when(methods.isNull(), True).when(side == "declaration", F.coalesce(declared, F.lit(False))).otherwise(called)


def scope_applies(facts: DataFrame, scopes: DataFrame) -> DataFrame:
    """Pairs of ``facts`` (fact_id, template, anchor, method, side) and ``scopes`` (scope_id, form, template, methods) that can meet.

    ``form`` is exact, prefix or suffix. Scopes with a plain first segment meet facts of that first segment by an equi join; the rest,
    MOST_SCOPES at most, are broadcast. That bound is checked.
    """
    if scopes.select("scope_id").distinct().limit(MOST_SCOPES + 1).count() > MOST_SCOPES:
        raise LimitError(f"more than {MOST_SCOPES} scopes")
    own = segments(F.col("template"))
    star = F.array(F.lit("*"))
    scope = scopes.select("scope_id", "methods", F.when(F.col("form") == "prefix", F.concat(own, star)).when(F.col("form") == "suffix", F.concat(star, own)).otherwise(own).alias("pattern"))
    fact = facts.withColumn("own", segments(F.col("template"), F.col("anchor")))
    plain = lambda c: (F.size(c) > 0) & ~F.coalesce(F.get(c, F.lit(0)).contains("{}") | (F.get(c, F.lit(0)) == "*"), F.lit(True))
    meets = method_applies(F.col("methods"), F.col("method"), F.col("side")) & overlaps(F.col("own"), F.col("pattern"))
    keyed = fact.where(plain(F.col("own"))).withColumn("first", F.get("own", F.lit(0)))
    fast = keyed.join(F.broadcast(scope.where(plain(F.col("pattern"))).withColumn("first", F.get("pattern", F.lit(0)))), "first").where(meets)
    loose = keyed.join(F.broadcast(scope.where(~plain(F.col("pattern")))), F.lit(True)).where(meets)
    other = fact.where(~plain(F.col("own"))).join(F.broadcast(scope), F.lit(True)).where(meets)
    take = ("fact_id", "scope_id")
    return fast.select(*take).unionByName(loose.select(*take)).unionByName(other.select(*take)).distinct()


def order_problems(facts: DataFrame) -> DataFrame:
    """(fact_id, problem) of registration orders: shape, a group of several services, an index at several places, a catch-all without its origin.

    Facts have fact_id, service, method, usr, channel, path, line, column, group, index and catch_all.
    """
    group = F.col("group")
    ordered = facts.where(group.isNotNull() | F.col("index").isNotNull())
    safe = (F.length(group) > 0) & ~group.rlike(ENDS) & (F.octet_length(F.encode(group, "UTF-16LE")) <= 2 * LONGEST_GROUP) & ~group.rlike(CONTROL)
    shape = ordered.select("fact_id", F.when(~F.coalesce(safe, F.lit(False)), "group").when(~F.coalesce(F.col("index").between(0, LARGEST_INDEX), F.lit(False)), "index").alias("problem")).where("problem is not null")
    shared = ordered.groupBy("group").agg(F.count_distinct(F.coalesce("service", F.lit("\u0000"))).alias("n")).where("n > 1")
    service = ordered.join(shared.select("group"), "group", "left_semi").select("fact_id", F.lit("shared-group").alias("problem"))
    spread = ordered.groupBy("group", "index").agg(F.count_distinct(F.struct("path", "line", "column")).alias("n")).where("n > 1")
    place = ordered.join(spread.select("group", "index"), ["group", "index"], "left_semi").select("fact_id", F.lit("shared-index").alias("problem"))
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in ("method", "usr", "service", "group", "index")]
    origin = F.concat_ws("\u0001", *key, F.when(F.col("catch_all"), F.concat(F.when(F.col("channel") == "/", "").otherwise(F.col("channel")), F.lit("/{**}"))).otherwise(F.col("channel")))
    keyed = facts.withColumn("key", origin)
    alone = keyed.where("catch_all").join(keyed.where("NOT catch_all").select("key").distinct(), "key", "left_anti").select("fact_id", F.lit("catch-all-origin").alias("problem"))
    return shape.unionByName(service).unionByName(place).unionByName(alone)


def registration_order(spark, tree_view: str, most_depth: int = 32) -> DataFrame:
    """(id, piece, ordinal): leaves of a tree of (id, parent, place, piece, leaf) in depth-first order, with the pieces on the way joined.

    A recursive query over a view; the path of places sorts as the walk goes.
    """
    walked = spark.sql(
        f"""WITH RECURSIVE walk(id, piece, leaf, way, depth) AS (
          SELECT id, piece, leaf, array(place), 1 FROM {tree_view} WHERE parent IS NULL
          UNION ALL SELECT t.id, concat(w.piece, t.piece), t.leaf, array_append(w.way, t.place), w.depth + 1 FROM walk w JOIN {tree_view} t ON t.parent = w.id WHERE w.depth < {most_depth})
        SELECT id, piece, way FROM walk WHERE leaf"""
    )
    return numbered(walked, "way").select("id", "piece", F.col("ordinal").cast("int").alias("ordinal"))
