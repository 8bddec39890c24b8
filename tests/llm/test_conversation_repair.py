import hashlib
import itertools
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import conversation_repair as C

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damage(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = BLANK.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired roles and texts) by a shortest-path search whose states carry the whole list."""
    best = {(0, 0): (0, "", ())}
    order, done = [(0, 0)], {}
    goes = {"": "u", "s": "u", "u": "a", "a": "u"}
    states = ["", "s", "u", "a"]
    while best:
        k, s = min(best, key=lambda x: best[x][:2])
        value = done[k, s] = best.pop((k, s))
        cost, audit, said = value
        options = [(k, states.index(goes[states[s]]), cost + 5, "I", ({"u": "user", "a": "assistant"}[goes[states[s]]], ""))]
        if k < len(rows):
            _, role, text = rows[k]
            options.append((k + 1, s, cost + 2, "D", None))
            if found[k] not in ("blank", "duplicate"):
                more = 5 * (found[k] == "truncated")
                to = role[:1]
                if to and (to == goes[states[s]] or (to == "s" and states[s] == "")):
                    options.append((k + 1, states.index(to), cost + more, "K", (role, text)))
                to = goes[states[s]]
                options.append((k + 1, states.index(to), cost + 1 + more, "R", ({"u": "user", "a": "assistant"}[to], text)))
        for k2, s2, c, letter, spoken in options:
            new = (c, audit + letter, said + ((spoken,) if spoken else ()))
            if (k2, s2) not in done and ((k2, s2) not in best or new[:2] < best[k2, s2][:2]):
                best[k2, s2] = new
    return min((done[len(rows), s] for s in (0, 3)), key=lambda v: v[:2])


def brute(table):
    out = []
    for conv in {r[0] for r in table}:
        rows = damage(conv, [r[1:] for r in table if r[0] == conv])
        found = faults(rows)
        turns = {r[0] for r in rows if r[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, said = cheapest(rows, found)
        text = "\n".join(f"{r}:{t}" for r, t in said)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("conv_id", *C.COUNTS, "cost", "audit", "repaired_sha256")) for r in df.collect()), key=repr)


def test_whole_table_against_brute_force(spark):
    table = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(C.query(spark, "/root/testdata/sf0.01")) == brute(table)


ODD = [
    (None, 1, "user", "A null id."), (None, None, None, None), (1, None, "user", "No turn."), (1, None, "assistant", "None either."), (1, 3, None, "x"), (1, 3, "", "y."), (1, 3, "user", None),
    (2, 0, "system", "S."), (2, 5, "system", "S."), (2, 9, "tool", "\x0b \t"), (2, 9, "tool", "\xa0"), (2, 10, "assistant", "é!  \n"), (3, 1, "user", ""), (4, 2, "user", "same."), (4, 2, "user", "same."), (4, 2, "user", "same."),
    *((5, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(300)), *((6, k, "tool", f"turn {k}") for k in range(120)), *((k, 0, "user", "w" * 9000) for k in range(7, 60)),
]


def test_odd_rows(spark):
    shape = "conv_id long, turn long, role string, text string, hash int, there int"
    rows = spark.createDataFrame([(*r, 1, 2) for r in ODD], shape).repartition(3)
    narrow = rows.select("conv_id", "turn", "role", "text")
    assert got(C.repair(C.damaged(narrow, C.F.col("conv_id"), C.F.col("turn")))) == brute(ODD)
    assert got(C.repair(C.damaged(narrow.limit(0), C.F.col("conv_id"), C.F.col("turn")))) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suaox"), st.sampled_from(["", "truncated", "blank"])), max_size=9))
def test_costs_and_initials(rows):
    texts = [(None, {"x": ""}.get(c, c), "") for c, _ in rows]
    found = [f for _, f in rows]
    cost, audit, _ = cheapest(texts, found)
    signature = bytes(C.GONE if f == "blank" else ("suao".find(c) if c in "sua" else 3) + 4 * (f == "truncated") for c, f in rows)
    assert next(C.walk(iter([signature])))[:2] == (cost, audit)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 9 for x in b)), max_size=30))
def test_a_shared_prefix_is_computed_once(signatures):
    signatures = sorted(signatures)
    together = list(C.walk(iter(signatures)))
    assert [t[:2] for t in together] == [next(C.walk(iter([s])))[:2] for s in signatures]
    assert sum(t[2] for t in together) == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})
