import math
import random

import pytest

from tracewell.llm import mixing as M


def table(spark, sizes, extra="z"):
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, source, extra))
            k += 1
    return spark.createDataFrame(rows, "doc_id long, source string, mix_pos string")


def earliest_deadline_first(weights, blocks):
    """(slot, source, block) of all blocks in plain Python, a slot at a time; weights are whole numbers."""
    total, done, out, t = sum(weights), [0] * len(weights), [], 0
    while sum(done) < sum(blocks):
        ready = [(-(-(done[i] + 1) * total // w), i) for i, w in enumerate(weights) if done[i] < blocks[i] and done[i] * total // w <= t]
        if ready:
            k = min(ready)[1]
            out.append((t, k, done[k]))
            done[k] += 1
        t += 1
    return out


def parts(weights):
    """Weights in parts of WHOLE, as the operator takes them."""
    q = [max(1, math.floor(w / sum(weights) * M.WHOLE)) for w in weights]
    q[q.index(max(q))] += M.WHOLE - sum(q)
    return q


def sources(spark, sizes, weights=None):
    counts = spark.createDataFrame(sorted(sizes.items()), "src string, n long")
    return M.shares(counts, weights)


def deviation(shared, slots):
    """The most that a source is away from its exact share, while none has run out."""
    known = {r.k: (r.q / M.WHOLE, -(-r.n // M.BLOCK)) for r in shared.collect()}
    at, most, seen = {slot: k for slot, k, _ in slots}, 0.0, [0] * len(known)
    for t in range(max(at) + 1):
        if any(seen[k] >= n for k, (_, n) in known.items()):
            return most, t
        seen[at[t]] += 1  # no slot is empty
        most = max(most, max(abs(seen[k] - (t + 1) * w) for k, (w, _) in known.items()))
    return most, t


@pytest.mark.parametrize("fan", [3, 64])
def test_schedule_against_brute_force(spark, monkeypatch, fan):
    monkeypatch.setattr(M, "FAN", fan)
    rng = random.Random(fan)
    cases = [{"a": 64 * 40, "b": 64 * 13 + 1}, {"one": 700}, {f"s{k:02}": 64 * 3 for k in range(9)}]
    cases += [{f"s{k:02}": rng.choice([1, 64, 500, 2000, 5000]) for k in range(rng.randint(2, 12))} for _ in range(2)]
    for sizes in cases if fan == 64 else cases[-2:]:
        weights = {s: rng.choice([rng.random() + 0.01, 1.0, 2.0, 0.001]) for s in sizes}
        shared = sources(spark, sizes, weights)
        rows = shared.orderBy("k").collect()
        want = earliest_deadline_first([r.q for r in rows], [-(-r.n // M.BLOCK) for r in rows])
        assert sum(r.q for r in rows) == M.WHOLE and [r.q for r in rows] == parts([weights[s] for s in sorted(sizes)])
        assert sorted(map(tuple, M.schedule(shared).collect())) == want


@pytest.mark.parametrize("sizes", [{"a": 300_000, "b": 210_000, "c": 120_000, "d": 70_000, "e": 40_000}, {"big": 400_000} | {f"s{k:03}": 900 + 41 * k for k in range(300)}], ids=[5, 301])
def test_less_than_one_block_from_exact_shares(spark, sizes):
    shared = sources(spark, sizes)
    total = sum(n**0.5 for n in sizes.values())
    assert all(abs(r.q / M.WHOLE - r.n**0.5 / total) < 2.0**-30 for r in shared.collect())
    slots = sorted(map(tuple, M.schedule(shared).collect()))
    assert len(slots) == len({s for s, _, _ in slots}) == sum(-(-n // M.BLOCK) for n in sizes.values())
    most, ended = deviation(shared, slots)
    assert most < 1 and ended > 1000


def test_thousands_of_sources(spark):
    rng = random.Random(5)
    sizes = {f"s{k:04}": 64 * rng.randint(1, 12) for k in range(M.MOST_SOURCES)}
    shared = sources(spark, sizes, {s: 1.0 + rng.random() for s in sizes})
    known = {r.k: r.q for r in shared.collect()}
    slots = M.schedule(shared).collect()
    assert len({r.slot for r in slots}) == len(slots) == sum(n // 64 for n in sizes.values())
    assert all(r.j * M.WHOLE // known[r.k] <= r.slot < -(-(r.j + 1) * M.WHOLE // known[r.k]) for r in slots)


def test_every_document_has_one_place_and_shares_hold(spark):
    docs = table(spark, {"hot": 900, "b": 300, "c": 120, None: 5, "": 3})
    out = M.mix(docs, block=4).orderBy("mix_pos").collect()
    assert [r.mix_pos for r in out] == list(range(docs.count()))
    assert len({r.doc_id for r in out}) == docs.count()
    sizes = {"": 8, "b": 300, "c": 120, "hot": 900}
    want = earliest_deadline_first(parts([n**0.5 for n in sizes.values()]), [-(-n // 4) for n in sizes.values()])
    assert sorted({(r.mix_slot, list(sizes).index(r.source or ""), r.mix_block) for r in out}) == want
    assert [r.mix_slot for r in out] == sorted(r.mix_slot for r in out)


def test_given_weights_and_odd_tables(spark):
    docs = table(spark, {"a": 10, "b": 10, "c": 4})
    out = M.mix(docs, {"a": 3.0, "b": 1.0}, block=1).orderBy("mix_pos").collect()
    assert [r.mix_pos for r in out] == list(range(24))
    assert "".join(r.source for r in out[:8]).count("a") == 6 and {r.source for r in out[20:]} == {"c"}
    assert [r.source for r in M.mix(docs, {}).orderBy("mix_pos").collect()] == ["a"] * 10 + ["b"] * 10 + ["c"] * 4
    assert M.mix(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, "a", "y"), (None, None, None)], "doc_id long, source string, text string")
    assert sorted(r.mix_pos for r in M.mix(same).collect()) == [0, 1, 2, 3]


def test_rare_weights_leave_empty_slots_and_a_shuffled_schedule_is_the_same(spark, monkeypatch):
    docs = table(spark, {"a": 7, "b": 5})
    weights = {"a": 1.0, "b": 1e-9}
    out = M.mix(docs, weights, block=1).orderBy("mix_pos").collect()
    assert [r.mix_pos for r in out] == list(range(12)) and max(r.mix_slot for r in out) > 10**8
    want = [(t, k, j) for t, k, j in earliest_deadline_first(parts([1.0, 1e-9]), [7, 1])]
    assert [(r.mix_slot, "ab".index(r.source), r.mix_block) for r in out[:8]] == want
    monkeypatch.setattr(M, "BROADCAST_BLOCKS", 0)
    assert sorted(map(tuple, M.mix(docs, weights, block=1).collect())) == sorted(map(tuple, out))


def test_stage_keeps_rows_in_order(spark, tmp_path):
    docs = table(spark, {"a": 300, "b": 100}).drop("mix_pos")
    out = M.stage(spark, docs, "")
    place = {r.doc_id: r.mix_pos for r in M.mix(docs).collect()}
    got = [place[r.doc_id] for r in out.collect()]
    assert got == sorted(got) and len(got) == 400 and out.columns == docs.columns
