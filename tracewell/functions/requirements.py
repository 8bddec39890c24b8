"""Version requirements against a version, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAUSE = r"^(~=|==|!=|<=|>=|<|>)\s*([0-9]{1,4}(?:\.[0-9]{1,4}){0,2})(\.\*)?$"  # fixed value: a clause that is read


def _release(numbers: Column) -> Column:
    """Three numbers that compare like a version; missing ones are 0."""
    return F.struct(*(F.coalesce(F.get(numbers, F.lit(k)), F.lit(0)).alias(f"v{k}") for k in range(3)))


def requirement_status(requirement: Column, runtime: Column) -> Column:
    """not-evaluated, runtime-below-minimum or minimum-not-newer, of a requirement and a version of three numbers (text, 3.12.1).

    Only lower bounds are compared with the version. A requirement without one, with a clause of another form, that no version meets, or that leaves out just this version isn't evaluated.
    """
    of = lambda v: F.transform(F.split(v, r"\."), lambda n: n.cast("int"))
    now = _release(of(runtime))

    def clause(text: Column) -> Column:
        op, numbers, wild = F.regexp_extract(text, CLAUSE, 1), of(F.regexp_extract(text, CLAUSE, 2)), F.regexp_extract(text, CLAUSE, 3) != ""
        family = (op == "~=") | wild  # all versions that begin alike
        kept = F.when(op == "~=", F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(1)))).otherwise(numbers)
        after = F.transform(kept, lambda n, i: F.when(i == F.size(kept) - 1, n + 1).otherwise(n))
        return F.struct(
            op.alias("op"),
            ((op == "") | (wild & ~op.isin("==", "!=")) | ((op == "~=") & (F.size(numbers) < 2))).alias("odd"),
            F.when(op.isin(">=", ">", "==", "~="), _release(numbers)).alias("low"),
            (op != ">").alias("low_in"),
            F.when(op.isin("<=", "<"), _release(numbers)).when(op.isin("==", "~="), F.when(family, _release(after)).otherwise(_release(numbers))).alias("high"),
            ((op == "<=") | ((op == "==") & ~wild)).alias("high_in"),
            ((op == "!=") & F.when(wild, F.slice(of(runtime), 1, F.size(numbers)) == numbers).otherwise(_release(numbers) == now)).alias("left_out"),
        )

    parts = F.transform(F.split(requirement, ",", -1), lambda t: clause(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")))
    low, high = F.filter(parts, lambda p: p["low"].isNotNull()), F.filter(parts, lambda p: p["high"].isNotNull())
    clash = F.exists(low, lambda b: F.exists(high, lambda t: (t["high"] < b["low"]) | ((t["high"] == b["low"]) & ~(t["high_in"] & b["low_in"]))))
    below = F.exists(low, lambda b: (now < b["low"]) | ((now == b["low"]) & ~b["low_in"]))
    unread = requirement.isNull() | F.exists(parts, lambda p: p["odd"]) | (F.size(low) == 0) | clash
    return F.when(unread, "not-evaluated").when(below, "runtime-below-minimum").when(F.exists(parts, lambda p: p["left_out"]), "not-evaluated").otherwise("minimum-not-newer")
