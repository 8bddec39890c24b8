"""Documents out: facts and traversals as JSON rows, absent fields left out, with the bounds that a document has."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.change import changed_files
from tracewell.operators.facts import MOST_FACTS, LimitError, limitations, unique_sorted
from tracewell.operators.ranking import numbered
from tracewell.operators.traversal import MOST_UNRESOLVED, Reached

LONGEST = 16 * 2**20  # fixed values: characters of a document, and of a graph
LONGEST_GRAPH = 256 * 2**20


def timestamp_text(column):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def as_json(rows: DataFrame) -> DataFrame:
    """(json): each row as an object, keys in order of name, without its nulls."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "true"}).alias("json"))


def write_facts(facts: DataFrame, path: str, *order: str, longest: int = LONGEST) -> None:
    """Unique facts in order, as lines of JSON; an error, and nothing written, if they are longer than a document may be."""
    lines = as_json(unique_sorted(facts, *order))
    if (lines.agg(F.sum(F.length("json") + 1)).first()[0] or 0) > longest:
        raise LimitError(f"longer than {longest} characters")
    lines.write.mode("overwrite").text(path)


def graph_digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(digest) of a graph's nodes and edges, whatever their order: SHA-256 over hashes of sorted parts."""
    lines = as_json(nodes).unionByName(as_json(edges)).select(F.sha2("json", 256).alias("h"))
    parts = lines.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))


_BARE = {"ignoreNullFields": "true"}
# fixed values: names of the formats, and kinds of facts by role
FACTS_FORMAT, TRAVERSAL_FORMAT = "bridge-facts", "language-traversal"
ROLES = {"server": "route-decl", "client": "route-call", "persistence": "relation-use"}


def _object(**fields: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in sorted(fields.items())))


def _place(path: Column, line: Column, column: Column) -> Column:
    return _object(path=path, line=line, column=column)


def fact_object(role: str, facts: DataFrame, service: str | None = None) -> Column:
    """A fact as a document has it, from its columns; those that ``facts`` lacks, or that are null, are left out.

    Columns: channel, method, dynamic, anchor, path, line, column, id (declaration), name (its full name, if there is no id), service,
    trailing_slash, constraints, catch_all_prefix, test_source, group, index, authority, prefix.
    """
    have = set(facts.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    flag = lambda c: F.when(F.col(c), True) if c in have else F.lit(None).cast("boolean")
    dynamic = F.coalesce(F.col("dynamic"), F.lit(False))
    name = F.coalesce(col("id"), col("name"))
    fields = {
        "kind": F.lit(ROLES[role]),
        "channel": col("channel"),
        "dynamic": dynamic,
        "method": col("method"),
        "location": _place(F.col("path"), F.col("line"), F.col("column")),
        "symbol": F.when(name.isNotNull(), _object(qualifiedName=name, usr=col("id"))),
    }
    if role != "persistence":
        fields |= {"pathAnchor": col("anchor"), "service": F.coalesce(col("service"), F.lit(service)), "testSource": flag("test_source")}
    if role == "server":
        fields |= {"trailingSlash": F.when(~dynamic, col("trailing_slash")), "catchAllPrefix": F.when(col("id").isNotNull(), flag("catch_all_prefix"))}
        if "constraints" in have:
            fields["paramConstraints"] = F.when(~dynamic & (F.size("constraints") > 0), F.col("constraints"))
        if "group" in have:
            fields["order"] = F.when(F.col("group").isNotNull(), _object(group=F.col("group"), index=F.col("index")))
    if role == "client":
        fields |= {"methodDynamic": F.when(col("method").isNull(), True), "authority": col("authority"), "channelPrefix": col("prefix")}
    return _object(**fields)


def fact_lines(role: str, facts: DataFrame, gaps: DataFrame, project: str, generated_at: Column, service: str | None = None, tests: bool = False) -> DataFrame:
    """(part, place, json): a document of facts, its parts header, facts, limitations (plain sentences) and scopes, each in order from 0.

    Exactly equal facts are one; more than MOST_FACTS are an error. The service is the document's only if no fact has another.
    """
    line = F.to_json(fact_object(role, facts, service), _BARE)
    keys = [F.coalesce("channel", F.lit("")), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("method", "anchor") if c in facts.columns), F.col("dynamic"), F.col("path"), F.col("line"), F.col("column")]
    rows = facts.select(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))).alias("key"), line.alias("json")).dropDuplicates(["json"])
    if rows.limit(MOST_FACTS + 1).count() > MOST_FACTS:
        raise LimitError(f"more than {MOST_FACTS} facts")
    shared = service if service is not None and ("service" not in facts.columns or facts.where(F.col("service") != service).isEmpty()) else None
    head = {"format": FACTS_FORMAT, "version": 1, "tool": {"name": "tracewell"}, "platform": "python", "target": "sql" if role == "persistence" else "http", "roles": [role], "sourceSets": {"tests": "included" if tests else "excluded"}, "project": project, "service": shared}
    head = json.dumps({k: v for k, v in head.items() if v is not None}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    spark = facts.sparkSession
    header = spark.range(1).select(F.lit("header").alias("part"), F.lit(0).cast("long").alias("place"), F.concat(F.lit(head[:-1] + ',"generatedAt":"'), timestamp_text(generated_at), F.lit('"}')).alias("json"))
    told = limitations(gaps)
    scope = _object(limitationIndex=F.col("limitation_index"), templates=F.col("templates"), templatePrefixes=F.col("template_prefixes"), templateSuffixes=F.col("template_suffixes"), methods=F.col("methods"))
    scoped = F.coalesce("templates", "template_prefixes", "template_suffixes").isNotNull()
    return (
        header.unionByName(numbered(rows, "key", "json", name="place").select(F.lit("facts").alias("part"), "place", "json"))
        .unionByName(told.select(F.lit("limitations").alias("part"), F.col("limitation_index").alias("place"), F.col("sentence").alias("json")))
        .unionByName(told.where(scoped).select(F.lit("scopes").alias("part"), F.col("limitation_index").alias("place"), F.to_json(scope, _BARE).alias("json")))
    )


def _open_calls(dispatch: str) -> Column:
    n = F.least(F.col(f"mode_{dispatch}"), F.lit(MOST_UNRESOLVED))
    return F.when(n > 0, n)


def traversal_lines(found: Reached, roots: DataFrame, nodes: DataFrame, open_calls: DataFrame, direction: str = "dependencies", dispatch: str = "direct") -> DataFrame:
    """(part, place, json): a document of a traversal: header, roots as they were asked for, reached nodes in order, limitations.

    ``nodes`` are (id, kind, path, line, column), ``open_calls`` as of ``edges.unresolved_by_mode``. Roots that are no nodes have their id alone.
    """
    calls = open_calls.select(F.col("node").alias("id"), F.col(f"mode_{dispatch}"))
    head = found.meta.select(F.lit("header").alias("part"), F.lit(0).cast("long").alias("place"), F.to_json(_object(format=F.lit(TRAVERSAL_FORMAT), version=F.lit(1), platform=F.lit("python"), dispatch=F.lit(dispatch), direction=F.lit(direction), truncated=F.col("truncated"), rootsTruncated=F.when(F.col("roots_truncated"), True), truncationReasons=F.when(F.col("reasons") != "", F.sort_array(F.split("reasons", ",")))), _BARE).alias("json"))
    known = roots.join(nodes.select("id", F.lit(True).alias("there")), "id", "left").join(calls, "id", "left")
    asked = known.select(F.lit("roots").alias("part"), F.col("root_idx").cast("long").alias("place"), F.to_json(_object(id=F.col("id"), symbol=F.when(F.col("there"), _object(usr=F.col("id"), qualifiedName=F.col("id"))), unresolvedCalls=F.when(F.col("there"), _open_calls(dispatch))), _BARE).alias("json"))
    rows = found.rows.join(nodes.select("id", F.col("kind").alias("_kind"), _place(F.col("path"), F.col("line"), F.col("column")).alias("_at")), "id").join(calls, "id", "left")
    entry = _object(symbol=_object(usr=F.col("id"), qualifiedName=F.col("id"), kind=F.col("_kind"), location=F.col("_at")), via=F.col("via"), depth=F.col("depth"), roots=F.col("roots"), evidence=F.col("evidence"), relationships=F.when(F.size("relationships") > 0, F.col("relationships")), unresolvedCalls=_open_calls(dispatch))
    listed = numbered(rows.select("depth", F.encode("id", "UTF-16BE").alias("_key"), F.to_json(entry, _BARE).alias("json")), "depth", "_key", name="place")
    missing = known.where("there IS NULL").agg(F.count("*").alias("n")).where("n > 0").select(F.concat(F.lit("root-not-found: "), F.col("n").cast("string"), F.lit(" of the roots asked for are no nodes of the graph; they are listed by id alone")).alias("s"), F.lit(0).alias("k"))
    touched = roots.select("id").unionByName(found.rows.select("id")).join(calls, "id").where(F.col(f"mode_{dispatch}") > MOST_UNRESOLVED)
    capped = touched.agg(F.count("*").alias("n")).where("n > 0").select(F.concat(F.lit("unresolved-calls-capped: "), F.col("n").cast("string"), F.lit(f" symbols have more than {MOST_UNRESOLVED} open calls; {MOST_UNRESOLVED} are told")).alias("s"), F.lit(1).alias("k"))
    notes = missing.unionByName(capped).select(F.lit("limitations").alias("part"), F.col("k").cast("long").alias("place"), F.col("s").alias("json"))
    return head.unionByName(asked).unionByName(listed.select(F.lit("reached").alias("part"), "place", "json")).unionByName(notes)


def change_lines(before: DataFrame, after: DataFrame, sides: dict[str, Reached], unmapped: dict[str, DataFrame]) -> DataFrame:
    """(side, part, json): a report of a change: its status, changed files, and of each side what is reached and which changed files hold nothing.

    The status is always incomplete: what is reached is what can be shown, and calls that stay open may reach more.
    """
    changes = changed_files(before, after)
    counts = changes.agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("added", "deleted", "modified")))
    out = counts.select(F.lit("both").alias("side"), F.lit("header").alias("part"), F.to_json(_object(status=F.lit("incomplete"), added=F.col("added"), deleted=F.col("deleted"), modified=F.col("modified"))).alias("json"))
    out = out.unionByName(changes.select(F.lit("both").alias("side"), F.lit("files").alias("part"), F.to_json(_object(path=F.col("path"), status=F.col("status"), renameCandidate=F.col("rename_from")), _BARE).alias("json")))
    for side, found in sides.items():
        entry = _object(id=F.col("id"), via=F.col("via"), depth=F.col("depth"), evidence=F.col("evidence"), path=F.col("path"), testCandidate=F.when(F.col("test_candidate"), True))
        out = out.unionByName(found.rows.select(F.lit(side).alias("side"), F.lit("reached").alias("part"), F.to_json(entry, _BARE).alias("json")))
        out = out.unionByName(found.meta.select(F.lit(side).alias("side"), F.lit("bounds").alias("part"), F.to_json(_object(**{c: F.col(c) for c in found.meta.columns}), _BARE).alias("json")))
        out = out.unionByName(unmapped[side].select(F.lit(side).alias("side"), F.lit("unmapped").alias("part"), F.to_json(_object(path=F.col("path"), status=F.col("status"))).alias("json")))
    return out
