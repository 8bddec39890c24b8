"""Merging raw edges into a graph, and counts over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: evidence from strong to weak, and the weakest that each dispatch mode follows
TIERS = ("direct", "bound", "candidate")
MODES = {"direct": 0, "bound": 1, "candidates": 2}


def tier(evidence: Column) -> Column:
    return F.when(evidence == "direct", 0).when(evidence == "bound", 1).when(evidence == "candidate", 2)


def pair_edges(raw: DataFrame, nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(source, target, bits): of each pair, a bit for each kind and tier of its edges, where ``kinds`` lists all that there are.

    Edges whose ends aren't both nodes go. Numbers are combined as they come and ends are looked up in hash tables of the nodes, so
    edges are dealt once by each end and sorted by none.
    """
    if len(kinds) * len(TIERS) > 63:
        raise ValueError("more kinds than a number has bits for")
    names = sorted(kinds)
    # an edge of a kind or evidence that isn't listed is an error: it would be lost
    of_kind = F.coalesce(*(F.when(F.col("kind") == k, i) for i, k in enumerate(names)), F.raise_error(F.concat(F.lit("a kind that is not listed: "), F.coalesce("kind", F.lit("null")))).cast("int"))
    of_tier = F.coalesce(tier(F.col("evidence")), F.raise_error(F.lit("unknown evidence")).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), of_kind + of_tier * len(names))
    known = nodes.select("id").distinct()
    end = lambda name: known.withColumnRenamed("id", name).hint("shuffle_hash")
    from_known = raw.select("source", "target", bit.alias("bits")).join(end("source"), "source")
    return from_known.groupBy("source", "target").agg(F.bit_or("bits").alias("bits")).join(end("target"), "target").select("source", "target", "bits")


def _held(bits: Column, kinds: tuple[str, ...]) -> Column:
    """The kinds whose bits are set, in order of name: looked up in a list of all sets of eight kinds at a time."""
    names = sorted(kinds)
    parts = []
    for low in range(0, len(names), 8):
        own = ["'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'" for k in names[low : low + 8]]
        sets = ("array(" + ", ".join(k for i, k in enumerate(own) if n >> i & 1) + ")" for n in range(1 << len(own)))
        listed = F.expr("array(CAST(array() AS array<string>), " + ", ".join(list(sets)[1:]) + ")")
        parts.append(F.get(listed, F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << len(own)) - 1)).cast("int")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _tiers(bits: Column, kinds: tuple[str, ...]) -> list[Column]:
    """For each tier, the number of its kinds."""
    return [F.shiftrightunsigned(bits, t * len(kinds)).bitwiseAND(F.lit((1 << len(kinds)) - 1)) for t in range(len(TIERS))]


def merge_edges(raw: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(source, target, kinds, evidence): of each pair, the kinds by tier; a tier that adds no kind to the stronger ones that are kept is left out.

    Edges whose ends aren't both nodes go. Where ``kinds`` lists all that there are, pairs are merged as numbers; else as sets.
    """
    if kinds is not None:
        direct, bound, candidate = _tiers(F.col("bits"), kinds)
        adds = lambda these, old: these.bitwiseAND(F.bitwise_not(old)) != 0
        covered = F.when(adds(bound, direct), direct.bitwiseOR(bound)).otherwise(direct)
        kept = F.array(
            F.when(direct != 0, F.struct(direct.alias("own"), F.lit("direct").alias("evidence"))),
            F.when(adds(bound, direct), F.struct(bound.alias("own"), F.lit("bound").alias("evidence"))),
            F.when(adds(candidate, covered), F.struct(candidate.alias("own"), F.lit("candidate").alias("evidence"))),
        )
        told = pair_edges(raw, nodes, kinds).select("source", "target", F.explode(kept).alias("e")).where("e IS NOT NULL")
        return told.select("source", "target", _held(F.col("e.own"), kinds).alias("kinds"), "e.evidence")
    known = nodes.select("id").distinct()
    raw = raw.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    sets = [F.collect_set(F.when(F.col("evidence") == t, F.col("kind"))).alias(t) for t in TIERS]
    pairs = raw.groupBy("source", "target").agg(*sets)
    direct = F.col("direct")
    new_bound = F.size(F.array_except("bound", direct)) > 0
    covered = F.when(new_bound, F.array_union(direct, F.col("bound"))).otherwise(direct)
    kept = F.array(
        F.when(F.size(direct) > 0, F.struct(F.lit("direct").alias("evidence"), F.sort_array(direct).alias("kinds"))),
        F.when(new_bound, F.struct(F.lit("bound").alias("evidence"), F.sort_array("bound").alias("kinds"))),
        F.when(F.size(F.array_except("candidate", covered)) > 0, F.struct(F.lit("candidate").alias("evidence"), F.sort_array("candidate").alias("kinds"))),
    )
    return pairs.select("source", "target", F.explode(F.filter(kept, lambda x: x.isNotNull())).alias("e")).select("source", "target", "e.kinds", "e.evidence")


def adjacency(edges: DataFrame, direction: str = "dependencies", weakest: int = 0) -> DataFrame:
    """(src, dst, kinds, tier): edges up to a tier, turned round for dependents, with a pair's kinds together and its strongest tier."""
    src, dst = ("source", "target") if direction == "dependencies" else ("target", "source")
    strength = tier(F.col("evidence"))
    followed = edges.where(strength <= weakest).select(F.col(src).alias("src"), F.col(dst).alias("dst"), strength.alias("tier"), F.explode("kinds").alias("kind"))
    return followed.groupBy("src", "dst").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.min("tier").alias("tier"))


def pair_adjacency(pairs: DataFrame, kinds: tuple[str, ...], direction: str = "dependencies", weakest: int = 0) -> DataFrame:
    """What ``adjacency`` gives, of ``pair_edges``: a pair is one row already."""
    src, dst = ("source", "target") if direction == "dependencies" else ("target", "source")
    own = _tiers(F.col("bits"), kinds)[: weakest + 1]
    together = own[0]
    for o in own[1:]:
        together = together.bitwiseOR(o)
    strongest = F.coalesce(*(F.when(o != 0, F.lit(t)) for t, o in enumerate(own)))
    return pairs.where(together != 0).select(F.col(src).alias("src"), F.col(dst).alias("dst"), _held(together, kinds).alias("kinds"), strongest.alias("tier"))


def unresolved_by_mode(outcomes: DataFrame) -> DataFrame:
    """(node, mode_direct, mode_bound, mode_candidates): calls left open under each mode."""
    total = lambda c: F.sum(c.cast("long"))
    status, linked = F.col("status"), F.col("linked")
    base = total(status.isin("unresolved", "partial"))
    bound = base - total(status.isin("unresolved", "partial") & linked)
    loose = base - total(status == "partial") - total((status == "unresolved") & linked)
    return outcomes.groupBy("node").agg(base.alias("mode_direct"), bound.alias("mode_bound"), loose.alias("mode_candidates"))


def reason_histogram(outcomes: DataFrame) -> DataFrame:
    """(node, reasons): counts of open calls by reason, as reason=count in order of name."""
    counts = outcomes.where(F.col("status").isin("unresolved", "partial")).groupBy("node", "reason").agg(F.count("*").alias("n"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("reason", "n"))), lambda x: F.concat_ws("=", x["reason"], x["n"].cast("string")))
    return counts.groupBy("node").agg(F.array_join(entries, ",").alias("reasons"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, name, n): nodes by kind, edges by kind (an edge counts for each of its kinds) and by evidence."""
    return (
        nodes.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("nodes").alias("part"), "name", "n")
        .unionByName(edges.select(F.explode("kinds").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("edges").alias("part"), "name", "n"))
        .unionByName(edges.groupBy(F.col("evidence").alias("name")).agg(F.count("*").alias("n")).select(F.lit("evidence").alias("part"), "name", "n"))
    )


def call_statistics(outcomes: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(part, name, n): call sites by status, open and partial ones by reason, and, of ``linked`` (reason, linked), those that program analysis links and leaves by reason.

    One pass over the outcomes: a site counts for its status and, if it isn't whole, for its reason.
    """
    pair = lambda part, name: F.struct(F.lit(part).alias("part"), name.alias("name"))
    reason = F.when(F.col("status") == "unresolved", pair("unresolved_calls", F.col("reason"))).when(F.col("status") == "partial", pair("partial_calls", F.col("reason")))
    sites = outcomes.select(F.explode(F.array_compact(F.array(pair("call_sites", F.col("status")), reason))).alias("x"))
    if linked is not None:
        sites = sites.unionByName(linked.select(F.struct(F.when(F.col("linked"), "bound_linked").otherwise("bound_open").alias("part"), F.col("reason").alias("name")).alias("x")))
    return sites.groupBy(F.col("x.part").alias("part"), F.col("x.name").alias("name")).agg(F.count("*").alias("n"))
