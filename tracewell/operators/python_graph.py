"""Names, classes and calls of Python sources resolved by joins over their raw facts.

Definitions, imports and classes are tables; resolution is equality joins on (scope, name), where the scope is a module or the
definition that binds the name, a few rounds for names that are handed on by imports and aliases, and closures over the class table. Nothing is gathered on the driver, so a code base is as large as its tables.
"""

from __future__ import annotations

import builtins

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.edges import merge_edges
from tracewell.operators.joins import by_key, spread_nulls
from tracewell.operators.traversal import closure
from tracewell.sources.python_sources import module_name
from tracewell.storage import materialize

MOST_HOPS = 16  # fixed value: how often a name may be handed on
BUILTINS = tuple(sorted(n for n in dir(builtins) if not n.startswith("_")))  # names that every scope sees
OVERLOADS = ("overload", "typing.overload")


def definitions(raw: DataFrame) -> DataFrame:
    """(id, kind, path, name, parent, line, col): one row for a dotted path, at its first place; stubs of overloads count only if nothing else is there."""
    d = raw.where("fact = 'definition'")
    stubs = raw.where("fact = 'decorator'").where(F.col("name").isin(*OVERLOADS)).select(F.col("extra").alias("id"), "path", (F.col("line") + 1).alias("line")).withColumn("stub", F.lit(1))
    place = Window.partitionBy("id").orderBy(F.col("stub").asc_nulls_first(), "place")
    return d.join(by_key(stubs.dropDuplicates(["id", "line"])), ["id", "path", "line"], "left").withColumn("n", F.row_number().over(place)).where("n = 1").select("id", F.col("value").alias("kind"), "path", "name", F.col("extra").alias("parent"), "line", "col")


UNKNOWN = "unknown:"  # what a parameter or a value that can't be followed stands for


def import_source() -> Column:
    """The module that an import's row names, in full: dots at its start are packages above its file."""
    here = module_name(F.col("path"))
    package = F.when(F.col("path").endswith("__init__.py"), here).otherwise(F.regexp_replace(here, r"\.?[^.]*$", ""))
    level = F.length(F.regexp_extract("value", r"^\.*", 0))
    base = F.array_join(F.slice(F.split(package, r"\."), F.lit(1), F.greatest(F.size(F.split(package, r"\.")) - level + 1, F.lit(0))), ".")
    rest = F.regexp_replace("value", r"^\.+", "")
    return F.when(level == 0, F.col("value")).otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(rest, F.lit(""))))


def module_bindings(raw: DataFrame, defs: DataFrame) -> DataFrame:
    """(module, name, target): what a name of a module, or of a definition's own scope, stands for: a definition's id, or module:<name>.

    Names bound to several things stand for nothing known, and neither do parameters and values that can't be followed.
    """
    modules = defs.where("kind = 'module'").select(module_name(F.col("path")).alias("module"), "path")
    here = module_name(F.col("path"))
    inside = lambda c: F.when(F.col(c).endswith("#<module>"), here).otherwise(F.col(c))
    source = import_source()
    own = defs.where("parent IS NOT NULL").select(inside("parent").alias("module"), "name", F.col("id").alias("target"))
    own = own.unionByName(raw.where("fact IN ('shadow', 'instance')").select(inside("id").alias("module"), "name", F.lit(UNKNOWN).alias("target")).distinct())
    imports = raw.where("fact = 'import' AND name <> '*'").select(inside("id").alias("module"), "name", source.alias("from"), F.col("extra").alias("member"))
    whole = imports.where("member = ''").select("module", "name", F.concat(F.lit("module:"), "from").alias("target"))
    # from x import y: a submodule, or a name of x, which may itself be imported there
    sub = imports.where("member <> ''").join(by_key(modules.select(F.col("module").alias("sub"))), F.concat_ws(".", F.nullif("from", F.lit("")), "member") == F.col("sub"), "left")
    known = own.unionByName(whole).unionByName(sub.where("sub IS NOT NULL").select("module", "name", F.concat(F.lit("module:"), "sub").alias("target")))
    open_ = sub.where("sub IS NULL").select("module", "name", "from", "member")
    # another name of the same file; what stands for a member of something else isn't followed
    alias = raw.where("fact = 'alias'").select(inside("id").alias("module"), "name", F.coalesce("scope", here).alias("from"), F.col("value").alias("member"))
    known = known.unionByName(alias.where("member LIKE '%.%'").select("module", "name", F.lit(UNKNOWN).alias("target")))
    alias = alias.where("member NOT LIKE '%.%'")
    open_ = open_.unionByName(alias)
    stars = raw.where("fact = 'import' AND name = '*'").select(inside("id").alias("module"), source.alias("from"), "place")
    if not stars.isEmpty():
        bound = own.select("module", "name").unionByName(imports.select("module", "name")).unionByName(raw.where("fact = 'alias'").select(inside("id").alias("module"), "name"))
        open_ = open_.unionByName(star_names(stars, bound, raw.where("fact = 'export' AND name IS NOT NULL").select(here.alias("from"), F.col("name").alias("member")).distinct()))
    known = materialize(known.distinct(), "names")
    for _ in range(MOST_HOPS):
        found = open_.join(by_key(known.select(F.col("module").alias("from"), F.col("name").alias("member"), "target")), ["from", "member"])
        new = materialize(found.select("module", "name", "target").join(by_key(known), ["module", "name", "target"], "left_anti").distinct(), "names")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    internal = modules.select(F.col("module").alias("from"))
    outside = open_.join(by_key(alias), ["module", "name", "from", "member"], "left_anti").join(by_key(internal), "from", "left_anti").select("module", "name", F.concat(F.lit("external:"), "from", F.lit("."), "member").alias("target"))
    return known.unionByName(outside).groupBy("module", "name").agg(F.when(F.count_distinct("target") == 1, F.min("target")).alias("target")).where(F.col("target") != UNKNOWN)


def star_names(stars: DataFrame, bound: DataFrame, exports: DataFrame) -> DataFrame:
    """(module, name, from, member) that star imports (module, from, place) bring: what __all__ lists, or names without a leading underscore where there is none.

    Names that a module binds itself come first, then those of shorter chains of stars, then the last star's. Chains end after MOST_HOPS.
    """
    listed = exports.select("from").distinct()
    new = bound = materialize(bound.distinct(), "bound")
    out = None
    for _ in range(MOST_HOPS):
        seen = new.select(F.col("module").alias("from"), F.col("name").alias("member"))
        public = seen.join(by_key(listed), "from", "left_anti").where(~F.col("member").startswith("_")).unionByName(seen.join(by_key(exports), ["from", "member"], "left_semi"))
        step = stars.join(by_key(public), "from").withColumn("name", F.col("member")).join(by_key(bound), ["module", "name"], "left_anti")
        step = materialize(step.groupBy("module", "name").agg(F.max_by("from", "place").alias("from")).select("module", "name", "from", F.col("name").alias("member")), "stars")
        if out is not None and step.isEmpty():
            break
        out = step if out is None else out.unionByName(step)
        new = step.select("module", "name")
        bound = bound.unionByName(new)
    return out


def resolve(rows: DataFrame, bindings: DataFrame, column: str = "name") -> DataFrame:
    """``rows`` (path, a dotted name, and the scope that binds its first part, where it isn't the module) with target and rest: the longest
    start of the name that stands for something, and what is left of it."""
    parts = F.split(column, r"\.")
    rows = rows.withColumn("_mod", F.coalesce("scope", module_name(F.col("path"))) if "scope" in rows.columns else module_name(F.col("path"))).withColumn("_first", F.get(parts, F.lit(0))).withColumn("_rest", F.array_join(F.slice(parts, 2, 100), "."))
    known = bindings.select(F.col("module").alias("_km"), F.col("name").alias("_kn"), "target")
    out = rows.join(by_key(known), (F.col("_mod") == F.col("_km")) & (F.col("_first") == F.col("_kn")), "left").drop("_km", "_kn")
    # module:a, then b of it, and so on: only distinct names that are handed on take part, until none moves
    inner = bindings.select(F.col("module").alias("_bm"), F.col("name").alias("_bn"), F.col("target").alias("_bt"))
    subs = packages(bindings).withColumnRenamed("module", "_sub")
    out = materialize(out, "resolved")
    onward = F.col("target").startswith("module:") & (F.col("_rest") != "")
    state = out.where(onward).select(F.col("target").alias("_t0"), F.col("_rest").alias("_r0"), "target", "_rest").distinct()
    for _ in range(MOST_HOPS):
        step = state.withColumn("_m", F.when(onward, F.substring("target", 8, 10_000)))
        step = step.withColumn("_n", F.regexp_extract("_rest", r"^[^.]*", 0)).withColumn("_left", F.regexp_replace("_rest", r"^[^.]*\.?", ""))
        step = step.join(by_key(inner), (spread_nulls("_m", "_t0", "_r0") == F.col("_bm")) & (F.col("_n") == F.col("_bn")), "left").join(by_key(subs), spread_nulls(F.when(F.col("_m").isNotNull(), F.concat_ws(".", "_m", "_n")), "_t0", "_r0") == F.col("_sub"), "left")
        to = F.coalesce("_bt", F.concat(F.lit("module:"), "_sub"))
        step = step.select("_t0", "_r0", F.coalesce(to, "target").alias("target"), F.when(to.isNotNull(), F.col("_left")).otherwise(F.col("_rest")).alias("_rest"), to.isNotNull().alias("_moved"))
        step = materialize(step, "resolved")
        state = step.drop("_moved")
        if step.where("_moved").isEmpty():
            break
    ends = state.select("_t0", "_r0", F.col("target").alias("_t1"), F.col("_rest").alias("_r1"))
    out = out.join(by_key(ends), (spread_nulls(F.when(onward, F.col("target")), "_mod", "_first") == F.col("_t0")) & (F.col("_rest") == F.col("_r0")), "left").withColumn("target", F.coalesce("_t1", "target")).withColumn("_rest", F.coalesce("_r1", "_rest"))
    return out.drop("_t0", "_r0", "_t1", "_r1").withColumnRenamed("_rest", "rest").drop("_mod", "_first")


def packages(bindings: DataFrame) -> DataFrame:
    """(module): modules that bind a name, and the packages above them."""
    parts = F.split("module", r"\.")
    return bindings.where(~F.col("module").contains("#")).select("module").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("module")).distinct()


def c3(classes: list[str], bases: list[list[str]], start: str) -> list[str]:
    """C3 linearisation of ``start``; where there is none, depth first with the last place of each class.

    Only classes that ``start`` reaches take part, and the order of each is worked out once, so the time is polynomial however they inherit.
    """
    parents = dict(zip(classes, bases, strict=True))
    orders: dict[str, list[str] | None] = {}

    def merged(c: str) -> list[str] | None:
        above = parents.get(c, [])
        if any(orders.get(b) is None for b in above):
            return None
        lines, out = [list(orders[b]) for b in above] + [list(above)], [c]
        while lines := [x for x in lines if x]:
            later = {name for x in lines for name in x[1:]}
            head = next((x[0] for x in lines if x[0] not in later), None)
            if head is None:
                return None
            out.append(head)
            lines = [x[1:] if x[0] == head else x for x in lines]
        return out

    todo, open_ = [start], set()
    while todo:
        c = todo[-1]
        ahead = [b for b in parents.get(c, []) if b not in orders and b not in open_]
        if c in orders:
            todo.pop()
        elif ahead and c not in open_:
            open_.add(c)
            todo += ahead
        else:  # its bases are known, or it is among its own ancestors
            todo.pop()
            open_.discard(c)
            orders[c] = merged(c)
    if orders[start] is not None:
        return orders[start]

    # the last place in a walk: the reverse of a walk from the right that keeps first places
    seen: set[str] = set()
    out: list[str] = []
    stack: list[tuple[str, int]] = [(start, 0)]
    while stack:
        c, k = stack.pop()
        if k == 0:
            if c in seen:
                continue
            seen.add(c)
        below = parents.get(c, [])
        if k < len(below):
            stack += [(c, k + 1), (below[len(below) - 1 - k], 0)]
        else:
            out.append(c)
    return out[::-1]


def class_table(raw: DataFrame, defs: DataFrame, bindings: DataFrame) -> DataFrame:
    """(id, place, base): bases of project classes that are project classes, in order; others have a null base."""
    rows = resolve(raw.where("fact = 'base'").select("path", "id", "name", "scope", F.col("value").cast("int").alias("at")), bindings)
    classes = defs.where("kind = 'class'").select(F.col("id").alias("_c"))
    full = F.when(F.col("rest") == "", F.col("target")).otherwise(F.concat_ws(".", "target", "rest"))
    return rows.withColumn("_full", full).join(by_key(classes), spread_nulls("_full", "id", F.col("at").cast("string")) == F.col("_c"), "left").select("id", F.col("at").alias("place"), F.col("_c").alias("base"))


def mro(bases: DataFrame, defs: DataFrame) -> DataFrame:
    """(id, ordinal, owner): each class's method resolution order, itself first.

    A class's group is its own ancestors, which a closure finds; the order is worked out group by group.
    """
    direct = bases.where("base IS NOT NULL")
    listed = direct.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "base"))), lambda x: x["base"]).alias("bases"))
    classes = defs.where("kind = 'class'").select("id").join(by_key(listed), "id", "left").withColumn("bases", F.coalesce("bases", F.array().cast("array<string>")))
    above = closure(direct.select(F.col("id").alias("child"), F.col("base").alias("parent"))).select(F.col("node").alias("id"), F.col("root").alias("owner")).unionByName(classes.select("id", F.col("id").alias("owner")))
    grouped = above.join(by_key(classes.select(F.col("id").alias("owner"), "bases")), "owner").groupBy("id").agg(F.collect_list("owner").alias("owners"), F.collect_list("bases").alias("lists"))

    @F.pandas_udf("array<string>")
    def order(ids: pd.Series, owners: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([c3(list(o), [list(b) for b in ls], i) for i, o, ls in zip(ids, owners, lists, strict=True)])

    return grouped.select("id", F.posexplode(order("id", "owners", "lists")).alias("ordinal", "owner"))


def lookup(asked: DataFrame, orders: DataFrame, defs: DataFrame) -> DataFrame:
    """``asked`` (cls, member, after) with found: the first definition of the member in the class's order, after a place in it."""
    members = defs.where("kind IN ('method', 'class', 'function')").select(F.col("parent").alias("owner"), F.col("name").alias("member"), F.col("id").alias("member_id"))
    rows = asked.select("cls", "member", "after").distinct()
    hit = rows.join(by_key(orders.withColumnRenamed("id", "cls")), "cls").where("ordinal >= after").join(by_key(members), ["owner", "member"])
    best = hit.groupBy("cls", "member", "after").agg(F.min_by("member_id", "ordinal").alias("found"))
    return asked.join(by_key(best), ["cls", "member", "after"], "left")


def graph(raw: DataFrame, bound: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, merged edges, call outcomes) of raw facts; ``bound``: what ``value_flow.bound_edges`` finds, whose calls count as linked.

    Calls of names and of module members are direct, and so are those of members of an object whose class its scope tells; self.m(), super().m(), and members of annotated parameters and of what annotated functions
    give back are looked up in the class's order, and overrides in subclasses are candidates (not for super()); members of a parameter of an outside class are external; a class that is called is new, through __init__ where the project has one; a definition that is passed on is a callback.
    """
    raw = materialize(raw, "raw-facts")
    defs = materialize(definitions(raw), "definitions")
    bindings = materialize(module_bindings(raw, defs), "bindings")
    bases = materialize(class_table(raw, defs, bindings), "classes")
    orders = materialize(mro(bases, defs), "orders")
    kinds = defs.select(F.col("id").alias("target_id"), F.col("kind").alias("target_kind"))

    sites = raw.where("fact IN ('call', 'argument', 'decorator') AND name IS NOT NULL").select("path", "fact", "id", "name", "extra", "scope", "line", "col", "place")
    own = F.col("name").rlike(r"^(self|cls|super\(\))\.[^.]+$")
    named = resolve(sites.where(~own), bindings)
    full = F.when(F.col("rest") == "", F.col("target")).otherwise(F.concat_ws(".", "target", "rest"))
    place = ("path", F.col("place").cast("string"))
    named = named.withColumn("_full", full).join(by_key(kinds), spread_nulls("_full", *place) == F.col("target_id"), "left").withColumn("target_id", F.col("_full")).drop("_full")
    named = named.join(by_key(packages(bindings).select(F.concat(F.lit("module:"), "module").alias("_own"))), spread_nulls("target", *place) == F.col("_own"), "left")
    taken = raw.where("fact IN ('shadow', 'instance', 'alias', 'import') AND id LIKE '%#<module>'").select(F.col("path").alias("_bp"), F.col("name").alias("_bn")).distinct()
    first = F.substring_index("name", ".", 1)
    named = named.join(by_key(taken), (F.col("path") == F.col("_bp")) & (first == F.col("_bn")) & F.col("scope").isNull(), "left")
    builtin = F.col("target").isNull() & F.col("scope").isNull() & F.col("_bn").isNull() & first.isin(*BUILTINS)
    lost = F.col("_own").isNotNull() & (F.col("rest") != "")  # of a module of the project
    status = F.when(F.col("target_kind").isNotNull(), "resolved").when(lost, "unresolved").when(F.col("target").startswith("external:") | F.col("target").startswith("module:") | builtin, "external").otherwise("unresolved")
    named = named.withColumn("status", status).drop("_own", "_bp", "_bn")

    # names that stand for one new object of a class: its members are that class's; annotations tell a class, or one below it
    told = resolve(raw.where("fact IN ('instance', 'typed', 'returned')").select("path", "fact", F.col("id").alias("space"), F.col("name").alias("object"), F.col("value").alias("name"), "scope"), bindings)
    told = told.join(by_key(kinds), spread_nulls(full, "space", "object") == F.col("target_id"), "left")
    given = told.where("fact = 'returned' AND target_kind = 'class'").select(F.col("space").alias("_by"), F.col("target_id").alias("_given")).dropDuplicates(["_by"])
    made_of = told.where("fact = 'instance'").join(by_key(given), spread_nulls("target_id", "space", "object") == F.col("_by"), "left").withColumn("cls", F.when(F.col("target_kind") == "class", F.col("target_id")).otherwise(F.col("_given")))
    other = raw.where("fact IN ('shadow', 'alias', 'import')").select(F.col("id").alias("space"), F.col("name").alias("object")).unionByName(defs.select(F.col("parent").alias("space"), F.col("name").alias("object"))).distinct()
    objects = made_of.join(by_key(other), ["space", "object"], "left_anti").groupBy("space", "object").agg(F.when((F.count_distinct("cls") == 1) & (F.count("cls") == F.count("*")), F.min("cls")).alias("cls"), F.when(F.max("_given").isNull(), "object").otherwise("typed").alias("via")).where("cls IS NOT NULL")
    typed = told.where("fact = 'typed'").withColumn("_out", F.col("target").startswith("external:") | (F.col("target").startswith("module:") & (F.col("rest") != "")) | (F.col("target").isNull() & F.col("scope").isNull() & F.col("name").isin(*BUILTINS)))
    typed = typed.join(by_key(packages(bindings).select(F.concat(F.lit("module:"), "module").alias("_inside"))), spread_nulls("target", "space", "object") == F.col("_inside"), "left")
    outer = typed.where(F.col("_out") & F.col("_inside").isNull() & F.col("target_kind").isNull()).select("space", "object").distinct()
    objects = objects.unionByName(typed.where("target_kind = 'class'").groupBy("space", "object").agg(F.when(F.count_distinct("target_id") == 1, F.min("target_id")).alias("cls")).where("cls IS NOT NULL").withColumn("via", F.lit("typed")))
    space = F.coalesce("scope", F.concat("path", F.lit("#<module>")))
    held = sites.where((F.col("fact") == "call") & F.col("name").rlike(r"^[^.()]+\.[^.]+$") & ~own).select("path", F.col("id").alias("scope_id"), F.substring_index("name", ".", 1).alias("object"), F.substring_index("name", ".", -1).alias("member"), "line", "col", "place", space.alias("space"))
    beyond = held.join(by_key(outer), ["space", "object"]).select("path", "line", "col", F.lit("call").alias("fact"), F.lit(True).alias("_beyond")).distinct()
    held = held.join(by_key(objects), ["space", "object"]).select("path", F.col("scope_id").alias("scope"), "via", "member", "line", "col", "place", "cls")
    named = named.join(by_key(held.select("path", "line", "col", F.lit("call").alias("fact")).distinct()), ["path", "line", "col", "fact"], "left_anti")
    named = named.join(by_key(beyond), ["path", "line", "col", "fact"], "left").withColumn("status", F.when(F.col("_beyond"), "external").otherwise(F.col("status"))).drop("_beyond")

    method = defs.where("kind = 'method'").select(F.col("id").alias("scope"), F.col("parent").alias("cls"))
    through = sites.where(own & (F.col("fact") == "call")).select("path", F.col("id").alias("scope"), F.substring_index("name", ".", 1).alias("via"), F.substring_index("name", ".", -1).alias("member"), "line", "col", "place").join(by_key(method), "scope", "left").unionByName(held)
    through = materialize(lookup(through.withColumn("after", F.when(F.col("via") == "super()", 1).otherwise(0)), orders, defs), "self-calls")

    inits = lookup(named.where("fact = 'call' AND target_kind = 'class'").select(F.col("target_id").alias("cls"), F.lit("__init__").alias("member"), F.lit(0).alias("after")).distinct(), orders, defs).select("cls", F.col("found").alias("init"))
    direct = lambda source, target, kind: (F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("kind"), F.lit("direct").alias("evidence"))
    called = named.where("fact = 'call' AND status = 'resolved'")
    edges = called.where("target_kind <> 'class'").select(*direct("id", "target_id", "call"))
    made = called.where("target_kind = 'class'").join(by_key(inits), F.col("target_id") == F.col("cls"), "left").withColumn("made", F.coalesce("init", "target_id"))
    edges = edges.unionByName(made.select(*direct("id", "made", "new")))
    edges = edges.unionByName(named.where("fact = 'argument' AND status = 'resolved'").select(*direct("id", "target_id", "callback")))
    edges = edges.unionByName(named.where("fact = 'decorator' AND status = 'resolved'").select(*direct("extra", "target_id", "decorator")))
    edges = edges.unionByName(bases.where("base IS NOT NULL").select(*direct("id", "base", "inherit")))
    edges = edges.unionByName(through.where("found IS NOT NULL").select(*direct("scope", "found", "call")))
    below = orders.where("ordinal > 0").select(F.col("owner").alias("cls"), F.col("id").alias("sub"))
    members = defs.where("kind = 'method'").select(F.col("parent").alias("sub"), F.col("name").alias("member"), F.col("id").alias("override"))
    wider = through.where("via IN ('self', 'cls', 'typed')").join(by_key(below), "cls").join(by_key(members), ["sub", "member"]).where("found IS NULL OR override <> found")
    edges = edges.unionByName(wider.select(F.col("scope").alias("source"), F.col("override").alias("target"), F.lit("call").alias("kind"), F.lit("candidate").alias("evidence")))

    nodes = defs.select("id", "kind", "path", "line", "col")
    linked = F.lit(False)
    if bound is not None:
        edges = edges.unionByName(bound.select("source", "target", "kind", "evidence"))
        led = bound.select("path", "line", "col", F.substring_index("target", ".", -1).alias("_member"), F.lit(True).alias("_led")).distinct()
        named = named.withColumn("_member", F.substring_index("name", ".", -1)).join(by_key(led), ["path", "line", "col", "_member"], "left")
        linked = F.coalesce(F.col("_led") & (F.col("status") == "unresolved"), F.lit(False))
    outcomes = named.where("fact = 'call'").select(F.col("id").alias("node"), "status", F.when(F.col("status") == "unresolved", "name").alias("reason"), linked.alias("linked"))
    many = wider.select("scope", "line", "col").distinct().withColumn("more", F.lit(1))
    mine = through.join(by_key(many), ["scope", "line", "col"], "left").select(F.col("scope").alias("node"), F.when(F.col("found").isNull(), "unresolved").when(F.col("more") == 1, "partial").otherwise("resolved").alias("status"), F.when(F.col("found").isNull(), "self").when(F.col("more") == 1, "override").alias("reason"))
    return nodes, merge_edges(edges, nodes), outcomes.unionByName(mine.withColumn("linked", F.lit(False)))
