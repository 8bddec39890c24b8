"""Texts of Python expressions, put together from literals, formats and names that are bound once, across modules.

Expressions are nodes of a graph: a part of one is a literal, a value, or another node, its own or the one a name stands for. Nodes settle in rounds, each once however many
name it: those whose parts are all known are put together, and hand their text to the parts that wait for them. Rounds hold only what isn't settled yet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import formats, urls
from tracewell.operators.python_graph import MOST_HOPS, definitions, module_bindings, resolve
from tracewell.sources.python_texts import TEMPLATE
from tracewell.storage import drop, materialize

MOST_PARTS = 4096  # fixed value: parts of one text
MOST_CHARACTERS = 64 * 1024  # fixed value: literal characters of one text


def constants(raw: DataFrame) -> DataFrame:
    """(id, path, owner, name, node): names of modules, functions and classes that are bound once, to a text.

    Left out, as they may be bound once more: names that an inner scope declares global or nonlocal, names that an attribute of anything but self
    or cls is written under anywhere (whatever it belongs to), and all of a module that asks for its own namespace.
    """
    told = raw.where("fact = 'text' AND name LIKE '=%'").select("path", F.col("id").alias("owner"), F.expr("substring(name, 2)").alias("name"), F.col("value").alias("node"))
    again = raw.where("fact = 'rewritten'")
    told = told.join(again.where("id <> ''").select(F.col("id").alias("owner"), "name").distinct(), ["owner", "name"], "left_anti").join(again.where("id = ''").select("name").distinct(), "name", "left_anti")
    told = told.join(raw.where("fact = 'namespace'").select(F.col("id").alias("owner")).distinct(), "owner", "left_anti")
    whole = F.when(F.col("owner").endswith("#<module>"), F.concat_ws("#", "path", "name")).otherwise(F.concat_ws(".", "owner", "name"))
    return told.select(whole.alias("id"), "path", "owner", "name", "node")


def _parts(raw: DataFrame) -> DataFrame:
    """(node, kind, place, slot, text, n, child): each part with its text, or the node that it waits for."""
    known = materialize(constants(raw), "constants")
    # a constant takes the place of what its name stood for
    replaced = known.select(F.col("owner").alias("id"), "name")
    rest = raw.where("fact IN ('shadow', 'alias', 'instance')").join(replaced, ["id", "name"], "left_anti").unionByName(raw.where("fact NOT IN ('shadow', 'alias', 'instance')"))
    none = F.lit(None).cast("int")
    defs = definitions(raw).unionByName(known.select("id", F.lit("constant").alias("kind"), "path", "name", F.col("owner").alias("parent"), none.alias("line"), none.alias("col")))
    names = resolve(raw.where("fact = 'part-name'").select("path", "id", "name", "scope", "place", "extra"), module_bindings(rest, defs))
    names = names.withColumn("to", F.concat_ws(".", "target", F.nullif("rest", F.lit("")))).join(known.select(F.col("id").alias("to"), F.col("node").alias("child")), "to", "left")
    names = names.select("id", "place", "extra", F.when(F.col("child").isNull(), urls.VALUE).alias("text"), "child")
    null = F.lit(None).cast("string")
    other = raw.where("fact IN ('part-text', 'part-value', 'part-inner')").select("id", "place", "extra", F.when(F.col("fact") == "part-text", F.col("value")).when(F.col("fact") == "part-value", urls.VALUE).alias("text"), F.when(F.col("fact") == "part-inner", F.col("value")).otherwise(null).alias("child"))
    kinds = raw.where("fact = 'text-node'").select(F.col("id").alias("node"), F.col("name").alias("kind"))
    return names.unionByName(other).withColumnRenamed("id", "node").join(kinds, "node").select("node", "kind", "place", F.col("extra").alias("slot"), "text", F.when(F.col("text").isNotNull(), 1).alias("n"), "child")


def _pieces(parts: Column, kind: Column) -> Column:
    """What a node's known parts make, as texts in order; null if its template can't be told."""
    template = F.get(F.filter(parts, lambda p: p["slot"] == TEMPLATE), F.lit(0))["text"]
    given = F.map_from_entries(F.transform(F.filter(parts, lambda p: p["slot"] != TEMPLATE), lambda p: F.struct(p["slot"], p["text"])))
    read = F.when(kind == "percent", formats.percent_pieces(template, False)).when(kind == "keyed", formats.percent_pieces(template, True)).otherwise(formats.format_pieces(template))
    filled = F.transform(read, lambda p: F.when(p["key"].isNull(), p["text"]).when(p["plain"], F.coalesce(F.try_element_at(given, p["key"]), F.lit(urls.VALUE))).otherwise(urls.VALUE))
    return F.when(kind == "join", F.transform(parts, lambda p: p["text"])).otherwise(filled)


def _letters(text: Column) -> Column:
    return F.length(F.replace(text, F.lit(urls.VALUE), F.lit(""))).cast("long")


def _together(ready: DataFrame) -> DataFrame:
    """(node, text, n) of nodes whose parts are all known. One of too many parts or characters is a value; its parts are not gathered."""
    size = ready.groupBy("node").agg(F.sum("n").alias("n"), F.sum(_letters(F.col("text"))).alias("letters"))
    over = (F.col("n") > MOST_PARTS) | (F.col("letters") > MOST_CHARACTERS)
    value = F.lit(urls.VALUE)
    fine = ready.drop("n").join(size.where(~over).select("node", "n"), "node").groupBy("node", "kind", "n").agg(F.array_sort(F.collect_list(F.struct("place", "slot", "text"))).alias("parts"))
    fine = fine.select("node", "n", _pieces(F.col("parts"), F.col("kind")).alias("pieces"))
    letters = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, t: s + _letters(t))
    fine = fine.withColumn("kept", F.coalesce((letters <= MOST_CHARACTERS) & (F.size("pieces") <= MOST_PARTS), F.lit(False)))
    fine = fine.select("node", F.when(F.col("kept"), F.array_join("pieces", "")).otherwise(value).alias("text"), F.when(F.col("kept"), F.col("n")).otherwise(1).alias("n"))
    return fine.unionByName(size.where(over).select("node", value.alias("text"), F.lit(1).cast("long").alias("n")))


def settled(raw: DataFrame) -> DataFrame:
    """(node, text) of all nodes. What hasn't settled after MOST_HOPS rounds, as what is on a cycle, is a value in those that take it."""
    open_ = materialize(_parts(raw), "parts")
    done = []
    for _ in range(MOST_HOPS):
        waiting = open_.where("text IS NULL").select("node").distinct()
        new = materialize(_together(open_.join(waiting, "node", "left_anti")), "texts")
        if new.isEmpty():
            break
        done.append(new)
        told = new.select(F.col("node").alias("child"), F.col("text").alias("_text"), F.col("n").alias("_n"))
        rest = open_.join(waiting, "node", "left_semi").join(told, "child", "left")
        last, open_ = open_, materialize(rest.withColumn("text", F.coalesce("text", "_text")).withColumn("n", F.coalesce("n", "_n")).drop("_text", "_n"), "parts")
        drop(last)
        if open_.isEmpty():
            break
    rest = open_.withColumns({"text": F.coalesce("text", F.lit(urls.VALUE)), "n": F.coalesce("n", F.lit(1))})
    return reduce(DataFrame.unionByName, [*done, _together(rest)]).select("node", "text")


def arguments(raw: DataFrame) -> DataFrame:
    """(at, first, second, url, base_url): texts of a call's arguments, where names or formats take part in them, by the place of the call's row."""
    asked = raw.where("fact = 'text' AND name NOT LIKE '=%'").select(F.col("id").alias("at"), F.col("name").alias("role"), F.col("value").alias("node"))
    texts = asked.join(settled(raw), "node")
    role = {"first": "0", "second": "1", "url": "url", "base_url": "base_url"}
    return texts.groupBy("at").agg(*(F.max(F.when(F.col("role") == k, F.col("text"))).alias(c) for c, k in role.items()))
