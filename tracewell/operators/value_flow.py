"""Bound dispatch: calls of methods on values whose classes the whole program tells.

Slots (``sources/python_flow.py``) take values from other slots. A value is a class of the project, whose instance it is, or OPEN, which absorbs all else: a value that can't be followed. The program is settled in
rounds: a slot's values are known once those of all that it takes from are. What an attribute or the result of a method is taken from depends on the classes of its base, so these edges are made
when the base is settled, and slots of (class, attribute) only as they are asked for. A slot that depends on itself is never settled, and neither is one further than MOST_ROUNDS steps from what it comes from: both are open.

A round is a few joins on slots, dealt by key, over tables that are written once and hold only what isn't settled yet, so a slot takes part in as many rounds as it waits for. Nothing but whether a round settled something comes to the driver.

What may come from outside opens a slot: parameters of methods other than __init__, and of functions and constructors that are handed on as values, decorated, named in a string, called with stars or never; results of
generators, coroutines and decorated functions; classes with hooks for attributes or with bases that aren't in the project, where these stand before what is looked up. An attribute takes from the class bodies in its class's order, from writes to self there, and
from writes to a base that may be of its class or is unknown. Writes of names that are computed aren't followed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import python_graph as G
from tracewell.operators.joins import by_key, spread_nulls
from tracewell.sources.python_flow import KEPT_AS_IS, RESULT
from tracewell.sources.python_sources import NOWHERE, module_name
from tracewell.storage import materialize

OPEN = "?"
MOST_ROUNDS = 64  # fixed value: steps that a value is followed
HOOKS = ("__getattr__", "__getattribute__", "__setattr__", "__delattr__")
INPUTS, CONSTS = "dst string, src string", "dst string, value string"


def _named(rows: DataFrame, bindings: DataFrame, kinds: DataFrame) -> DataFrame:
    """``rows`` (path, dotted, scope) with target, rest, and full and kind where the whole name is a definition."""
    known = G.resolve(rows.select("path", "dotted", "scope").distinct(), bindings, "dotted")
    full = F.when(F.col("rest") == "", F.col("target")).otherwise(F.concat_ws(".", "target", "rest"))
    known = known.withColumn("_full", full).join(by_key(kinds), spread_nulls("_full", "path", "dotted", "scope") == F.col("full"), "left").select(F.col("path").alias("_p"), F.col("dotted").alias("_d"), F.col("scope").alias("_s"), "target", "rest", "full", "kind")
    return rows.join(by_key(known), (F.col("path") == F.col("_p")) & (F.col("dotted") == F.col("_d")) & F.col("scope").eqNullSafe(F.col("_s")), "left").drop("_p", "_d", "_s")


class Program:
    """The tables of a program: definitions, names, class orders, and what slots take."""

    def __init__(self, raw: DataFrame):
        self.raw = raw = materialize(raw, "raw-facts")
        self.defs = defs = materialize(G.definitions(raw), "definitions")
        bindings = materialize(G.module_bindings(raw, defs), "bindings")
        bases = materialize(G.class_table(raw, defs, bindings), "classes")
        self.orders = materialize(G.mro(bases, defs), "orders")
        kinds = defs.select(F.col("id").alias("full"), "kind")
        rows = raw.where("fact IN ('flow', 'site', 'use')")
        dotted = F.when((F.col("fact") == "flow") & F.col("name").isin("name", "call"), F.col("value")).when(F.col("fact").isin("site", "use"), F.col("name"))
        named = materialize(_named(rows.withColumn("dotted", dotted).where("dotted IS NOT NULL"), bindings, kinds), "flow-names")
        self.names = named.where("fact = 'flow' AND name = 'name'")
        self.calls = named.where("fact = 'flow' AND name = 'call'")
        self.sites = named.where("fact = 'site'")
        self.uses = named.where("fact = 'use' AND kind IN ('function', 'class')").select(F.col("full").alias("id")).distinct()
        # the first place in a class's order after which something outside the project may stand
        foreign = bases.where("base IS NULL").join(by_key(raw.where("fact = 'base'").select("id", F.col("value").cast("int").alias("place"), F.col("name").alias("said"))), ["id", "place"]).where("said IS NULL OR said <> 'object'").select(F.col("id").alias("owner")).distinct()
        self.limits = self.orders.join(by_key(foreign), "owner").groupBy("id").agg(F.min("ordinal").alias("limit"))
        hooked = defs.where(F.col("name").isin(*HOOKS)).select(F.col("parent").alias("owner")).distinct()
        self.dirty = materialize(self.orders.join(by_key(hooked), "owner").select(F.col("id").alias("cls")).distinct(), "dirty")
        self.writes = materialize(raw.where("fact = 'write'").select(F.col("id").alias("mine"), F.col("name").alias("attr"), F.col("value").alias("base"), F.col("extra").alias("src")), "writes")
        self.tables()

    def tables(self) -> None:
        """Once, for all rounds: the method that an instance of exactly a class has, where that is known, and what attributes of its instances take from self and class bodies."""
        own = self.defs.where("kind IN ('method', 'class', 'function')").select(F.col("parent").alias("owner"), F.col("name").alias("member"), F.col("id").alias("found"), F.col("kind").alias("found_kind"))
        every = self.orders.withColumnRenamed("id", "cls").join(by_key(own), "owner").groupBy("cls", "member").agg(F.min_by(F.struct("found", "found_kind", "ordinal"), "ordinal").alias("m")).select("cls", "member", "m.*")
        self.members = every = materialize(every, "members")
        known = every.where("found_kind = 'method'").join(by_key(self.limits.withColumnRenamed("id", "cls")), "cls", "left").where("limit IS NULL OR ordinal <= limit").join(by_key(self.dirty), "cls", "left_anti")
        mine = self.writes.where("mine IS NOT NULL").select(F.col("mine").alias("owner"), "attr", "src")
        mine = materialize(self.orders.withColumnRenamed("id", "cls").join(by_key(mine), "owner").select("cls", "attr", "src").distinct(), "self-writes")
        other = self.writes.where("mine IS NULL").select(F.col("attr").alias("member")).distinct()
        self.vtable = materialize(known.join(by_key(mine.select("cls", F.col("attr").alias("member")).distinct()), ["cls", "member"], "left_anti").join(by_key(other), "member", "left_anti").select("cls", "member", "found"), "methods")
        bodies = self.raw.where("fact = 'flow' AND name <> 'none' AND id LIKE '%$%'").select(F.col("id").alias("src")).distinct()
        bodies = bodies.select(F.substring_index("src", "$", 1).alias("owner"), F.substring_index("src", "$", -1).alias("attr"), "src")
        body = self.orders.withColumnRenamed("id", "cls").join(by_key(bodies), "owner").select("cls", "attr", "src")
        self.attributes = materialize(mine.unionByName(body).distinct(), "attributes")

    def methods(self, asked: DataFrame) -> DataFrame:
        """``asked`` (cls, member) with found: null where it isn't known what a call runs."""
        return asked.join(by_key(self.vtable), ["cls", "member"], "left")

    def callees(self) -> DataFrame:
        """(slot, value, src, callee): arguments of calls of functions and constructors; a call by name of an unknown receiver may be one of any function of that name."""
        at = self.sites.select(F.col("id").alias("slot"), F.col("value"), F.col("extra").alias("src"), "dotted", "kind", "full", "target", "path")
        plain = at.where("kind = 'function'").withColumn("callee", F.col("full"))
        made = at.where("kind = 'class'").select("slot", "value", "src", F.col("full").alias("cls"), F.lit("__init__").alias("member"), F.lit(0).alias("after"))
        method = self.defs.where("kind = 'method'").select(F.col("id").alias("site"), F.col("parent").alias("cls"))
        up = self.raw.where("fact = 'site' AND name = 'super().__init__'").select(F.col("id").alias("slot"), "value", F.col("extra").alias("src"), "path", "line", "col")
        where = self.raw.where("fact = 'call' AND name = 'super().__init__'").select("path", "line", "col", F.col("id").alias("site"))
        up = up.join(by_key(where), ["path", "line", "col"]).join(by_key(method), "site").select("slot", "value", "src", "cls", F.lit("__init__").alias("member"), F.lit(1).alias("after"))
        built = G.lookup(made.unionByName(up), self.orders, self.defs).where("found IS NOT NULL").withColumn("callee", F.col("found"))
        unknown = at.where("target IS NULL AND dotted LIKE '%.%'").withColumn("last", F.substring_index("dotted", ".", -1))
        functions = self.defs.where("kind = 'function'").select(F.col("name").alias("last"), F.col("id").alias("callee"))
        columns = ("slot", "value", "src", "callee")
        return plain.select(*columns).unionByName(built.select(*columns)).unionByName(unknown.join(by_key(functions), "last").select(*columns))

    def exposed(self) -> DataFrame:
        """(id): functions and constructors that may be called from where no call is seen."""
        raw, defs = self.raw, self.defs
        decorated = raw.where("fact = 'decorator'").where(F.col("name").isNull() | ~F.col("name").isin(*KEPT_AS_IS)).select(F.col("extra").alias("id"))
        said = defs.join(by_key(raw.where("fact = 'mention'").select("name").distinct()), "name", "left_semi").select("id")
        outside = self.limits.select("id")
        odd = self.uses.unionByName(decorated).unionByName(said).unionByName(outside).distinct()
        classes = defs.where("kind = 'class'").select("id").join(by_key(odd), "id", "left_semi").select(F.col("id").alias("cls"))
        # a class that is handed on may be constructed anywhere, and so may its constructor's parameters come from there
        inits = G.lookup(classes.withColumn("member", F.lit("__init__")).withColumn("after", F.lit(0)), self.orders, defs).where("found IS NOT NULL").select(F.col("found").alias("id"))
        return odd.unionByName(inits).distinct()

    def taken(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(inputs, consts, gated) that don't depend on any value."""
        raw, defs = self.raw, self.defs
        flow = raw.where("fact = 'flow'")
        inputs = flow.where("name = 'copy'").select(F.col("id").alias("dst"), F.col("extra").alias("src"))
        below = self.orders.select(F.col("owner").alias("value"), F.col("id").alias("cls"))
        consts = flow.where("name = 'self'").select(F.col("id").alias("dst"), "value").join(by_key(below), "value").select("dst", F.col("cls").alias("value"))
        consts = consts.unionByName(flow.where("name = 'open'").select(F.col("id").alias("dst"), F.lit(OPEN).alias("value")))
        gone = lambda df: df.select(F.col("id").alias("dst"), F.lit(OPEN).alias("value"))

        # names: of a definition or from outside, of a module's variable, or of a variable in reach
        names = self.names.withColumn("one", ~F.col("dotted").contains("."))
        consts = consts.unionByName(gone(names.where(F.col("kind").isNotNull() | F.col("target").startswith("external:") | (F.col("scope") == NOWHERE))))
        modules = defs.where("kind = 'module'").select(F.concat(F.lit("module:"), module_name(F.col("path"))).alias("target"), F.col("id").alias("module_id"))
        free = names.where(F.col("kind").isNull() & (F.col("scope").isNull() | (F.col("scope") != NOWHERE)))
        there = free.where("rest <> '' AND rest NOT LIKE '%.%'").join(by_key(modules), "target").select(F.col("id").alias("dst"), F.concat_ws("$", "module_id", "rest").alias("src"))
        local = free.where("one AND target IS NULL").select(F.col("id").alias("dst"), F.concat(F.coalesce("scope", F.concat("path", F.lit("#<module>"))), F.lit("$"), "dotted").alias("src"))
        whole = names.where("target IS NOT NULL").select("id").unionByName(names.where(F.col("scope") == NOWHERE).select("id"))
        handed = raw.where("fact = 'import' AND name <> '*' AND extra <> ''").select(F.concat_ws("$", "id", "name").alias("dst"), F.concat(F.lit("module:"), G.import_source()).alias("target"), F.col("extra").alias("member")).join(by_key(modules), "target").select("dst", F.concat_ws("$", "module_id", "member").alias("src"))
        inputs = inputs.unionByName(there).unionByName(local).unionByName(handed)

        # calls: what a class makes, what a function returns, and what can't be told
        made = self.calls.where("kind = 'class'").select(F.col("id").alias("dst"), F.col("full").alias("value"))
        returned = self.calls.where("kind = 'function'").select(F.col("id").alias("dst"), F.concat(F.col("full"), F.lit(f"${RESULT}")).alias("src"))
        held = flow.where("name = 'mcall'").select("id").distinct()
        lost = self.calls.where("target IS NOT NULL AND (kind IS NULL OR kind NOT IN ('class', 'function'))").select("id").unionByName(self.calls.where("target IS NULL").select("id").join(by_key(held), "id", "left_anti"))
        consts = consts.unionByName(made).unionByName(gone(lost))
        inputs = inputs.unionByName(returned)
        told = self.calls.where("target IS NOT NULL").select("id")

        # parameters
        params = raw.where("fact = 'param'").select("id", F.concat_ws("$", "id", "name").alias("dst"), "name", F.col("value").alias("at"), F.col("extra").alias("given"))
        callees = materialize(self.callees(), "callees")
        closed = defs.where("kind = 'function' OR name = '__init__'").select("id").join(by_key(self.exposed()), "id", "left_anti").join(by_key(callees.select(F.col("callee").alias("id")).distinct()), "id", "left_semi").join(by_key(callees.where("value = '*'").select(F.col("callee").alias("id"))), "id", "left_anti")
        consts = consts.unionByName(params.join(by_key(closed), "id", "left_anti").select("dst", F.lit(OPEN).alias("value")))
        known = params.join(by_key(closed), "id")
        inputs = inputs.unionByName(known.join(by_key(callees), (F.col("id") == F.col("callee")) & ((F.col("value") == F.col("at")) | (F.col("value") == F.concat(F.lit("="), "name")))).select("dst", "src"))
        inputs = inputs.unionByName(known.where("given IS NOT NULL").select("dst", F.col("given").alias("src")))

        gated = flow.where("name = 'attr'").select(F.col("id").alias("dst"), F.col("extra").alias("base"), F.lit("read").alias("kind"), F.col("value").alias("x"), F.lit(None).cast("string").alias("y")).join(by_key(whole.select(F.col("id").alias("dst"))), "dst", "left_anti")
        gated = gated.unionByName(flow.where("name = 'mcall'").select(F.col("id").alias("dst"), F.col("extra").alias("base"), F.lit("result").alias("kind"), F.col("value").alias("x"), F.lit(None).cast("string").alias("y")).join(by_key(told.select(F.col("id").alias("dst"))), "dst", "left_anti"))
        return inputs.where("src IS NOT NULL").distinct(), consts.distinct(), gated.distinct()

    def attribute(self, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(inputs, consts, gated) of slots cls@attr for ``asked`` (cls, attr)."""
        slot = F.concat_ws("@", "cls", "attr")
        both = asked.join(by_key(self.attributes), ["cls", "attr"]).select(slot.alias("dst"), "src")
        other = asked.join(by_key(self.writes.where("mine IS NULL")), "attr").select(slot.alias("dst"), "base", F.lit("write").alias("kind"), F.col("cls").alias("x"), F.coalesce("src", F.lit(OPEN)).alias("y"))
        method = self.members.select("cls", F.col("member").alias("attr"))
        odd = self.limits.select(F.col("id").alias("cls")).unionByName(self.dirty).distinct()
        shut = asked.join(by_key(method), ["cls", "attr"], "left_semi").unionByName(asked.join(by_key(odd), "cls", "left_semi")).select(slot.alias("dst")).unionByName(both.where("src IS NULL").select("dst"))
        return both.where("src IS NOT NULL"), shut.select("dst", F.lit(OPEN).alias("value")).distinct(), other


def settle(program: Program, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(dst, value) of all slots whose values are known; one that holds nothing but None has no row with a value, but one with null."""
    inputs, consts, gated = (materialize(t, n) for t, n in zip(program.taken(), ("inputs", "consts", "gated"), strict=True))
    slots = inputs.select("dst").unionByName(consts.select("dst")).unionByName(gated.select("dst")).unionByName(program.raw.where("fact = 'flow'").select(F.col("id").alias("dst"))).distinct()
    named = lambda df: df.select(F.col("src").alias("dst")).unionByName(gated.select(F.col("base").alias("dst")))
    # what nothing is told of can't be followed
    consts = consts.unionByName(named(inputs).distinct().join(by_key(slots), "dst", "left_anti").select("dst", F.lit(OPEN).alias("value")))
    waiting = materialize(slots.unionByName(named(inputs)).distinct(), "waiting")
    consts, asked, done = materialize(consts, "consts"), None, None
    for _ in range(most_rounds):
        left = waiting if asked is None else waiting.unionByName(asked.select(F.concat_ws("@", "cls", "attr").alias("dst")))
        left = left if done is None else left.join(by_key(done.select("dst").distinct()), "dst", "left_anti")
        ready = left.join(by_key(inputs.select("dst").unionByName(gated.select("dst")).distinct()), "dst", "left_anti")
        found = ready.join(by_key(consts.distinct()), "dst", "left").groupBy("dst").agg(F.max((F.col("value") == OPEN).cast("int")).alias("open"), F.collect_set("value").alias("values"))
        found = materialize(found.select("dst", F.explode_outer(F.when(F.col("open") == 1, F.array(F.lit(OPEN))).otherwise(F.col("values"))).alias("value")), "settled")
        if found.isEmpty():
            break
        done = found if done is None else done.unionByName(found)
        # edges that are made by what is settled now
        seen = materialize(gated.join(by_key(done.select(F.col("dst").alias("base"), "value")), "base").where(F.col("value").isNotNull()), "due")
        shut = seen.where(f"value = '{OPEN}' AND kind <> 'write'").select("dst", F.lit(OPEN).alias("value"))
        writes = seen.where(f"kind = 'write' AND (value = '{OPEN}' OR value = x)")
        reads = seen.where(f"kind = 'read' AND value <> '{OPEN}'").select("dst", F.col("value").alias("cls"), F.col("x").alias("attr"))
        results = materialize(program.methods(seen.where(f"kind = 'result' AND value <> '{OPEN}'").select("dst", F.col("value").alias("cls"), F.col("x").alias("member"))), "results")
        shut = shut.unionByName(results.where("found IS NULL").select("dst", F.lit(OPEN).alias("value"))).unionByName(writes.where(f"y = '{OPEN}'").select("dst", F.lit(OPEN).alias("value")))
        more = reads.select("dst", F.concat_ws("@", "cls", "attr").alias("src")).unionByName(results.where("found IS NOT NULL").select("dst", F.concat(F.col("found"), F.lit(f"${RESULT}")).alias("src"))).unionByName(writes.where(f"y <> '{OPEN}'").select("dst", F.col("y").alias("src")))
        new = materialize(reads.select("cls", "attr").distinct() if asked is None else reads.select("cls", "attr").distinct().join(by_key(asked), ["cls", "attr"], "left_anti"), "asked")
        asked = new if asked is None else asked.unionByName(new)
        slots_in, slots_open, slots_gated = (materialize(t, n) for t, n in zip(program.attribute(new), ("slots-in", "slots-open", "slots-gated"), strict=True))
        fresh = new.select(F.concat_ws("@", "cls", "attr").alias("dst"))
        bare = fresh.join(by_key(slots_in.select("dst").unionByName(slots_open.select("dst")).unionByName(slots_gated.select("dst"))), "dst", "left_anti").select("dst", F.lit(OPEN).alias("value"))
        inputs = inputs.unionByName(more).unionByName(slots_in).distinct()
        passed = inputs.join(by_key(done.select(F.col("dst").alias("src"), "value")), "src")
        consts = materialize(consts.join(by_key(found.select("dst").distinct()), "dst", "left_anti").unionByName(passed.where("value IS NOT NULL").select("dst", "value")).unionByName(shut).unionByName(slots_open).unionByName(bare).distinct(), "consts")
        ended = done.select("dst").distinct()
        inputs = materialize(inputs.join(by_key(ended.withColumnRenamed("dst", "src")), "src", "left_anti"), "inputs")
        gated = materialize(gated.join(by_key(ended.withColumnRenamed("dst", "base")), "base", "left_anti").unionByName(slots_gated), "gated")
    return done if done is not None else consts.limit(0)


def bound_edges(raw: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(source, target, kind, evidence, slot, path, line, col) of calls x.m() where x holds instances of project classes alone, and each has m."""
    program = Program(raw)
    values = materialize(settle(program, most_rounds), "values")
    mine = program.raw.where("fact = 'flow' AND name = 'self'").select(F.col("id").alias("base"))
    static = program.calls.where("kind IS NOT NULL OR target LIKE 'external:%' OR target LIKE 'module:%'").select(F.col("id").alias("slot")).distinct()
    sites = program.raw.where("fact = 'receiver'").select("path", F.col("id").alias("source"), F.col("name").alias("member"), F.col("value").alias("slot"), F.col("extra").alias("base"), "line", "col").join(by_key(mine), "base", "left_anti").join(by_key(static), "slot", "left_anti")
    held = sites.join(by_key(values.select(F.col("dst").alias("base"), F.col("value").alias("cls"))), "base").where("cls IS NOT NULL")
    found = program.methods(held)
    bad = found.where("found IS NULL").select("base", "member").distinct()
    kept = found.join(by_key(bad), ["base", "member"], "left_anti")
    return kept.select("source", F.col("found").alias("target"), F.lit("call").alias("kind"), F.lit("bound").alias("evidence"), "slot", "path", "line", "col").distinct()
