import random

import pytest

from tracewell.operators.budget import within_budget


def fold(sizes, budget):
    out = []
    for s in sizes:
        out.append(s is not None and s <= budget)
        budget -= s if out[-1] else 0
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_sequential_fold(spark, seed):
    r = random.Random(seed)
    kinds = (lambda: r.randint(0, 9), lambda: r.choice((1, 2, 500)), lambda: None if r.random() < 0.1 else r.randint(1, 100), lambda: int(r.paretovariate(0.7)))
    sizes = [kinds[seed]() for _ in range(400)]
    rows = spark.createDataFrame([(f"p{k:05d}", s, "x") for k, s in enumerate(sizes)], "path string, length long, _size2 string").repartition(3)
    for budget in (7, sum(s or 0 for s in sizes) // 3):
        got = [r.taken for r in within_budget(rows, "length", budget, "path", block=16).orderBy("path").collect()]
        assert got == fold(sizes, budget)


def test_odd_input(spark):
    none = spark.createDataFrame([], "path string, length long")
    assert within_budget(none, "length", 5, "path").collect() == []
    with pytest.raises(ValueError):
        within_budget(none, "length", -1, "path")


def test_large_files_and_budget_give_failure_rows(spark, tmp_path):
    from tracewell.sources import python_sources as S

    for k in range(6):
        (tmp_path / f"m{k}.py").write_text("x = 1\n" * (k + 1))
    (tmp_path / "big.py").write_text("#" * (S.MOST_BYTES + 1))
    (tmp_path / "bad.py").write_text("def (:\n" * 9)
    files = S.read_project(spark, str(tmp_path))
    raw = S.facts(files)
    assert {r.outcome: r.n for r in S.outcomes(raw).collect()} == {"parsed": 6, "too-large": 1, "syntax-error": 1}
    kept = S.budgeted(raw, files, 50)  # 6, 12 and 18 bytes; the others are larger than the 14 that are left
    assert {r.outcome: r.n for r in S.outcomes(kept).collect()} == {"parsed": 3, "source-budget": 3, "too-large": 1, "syntax-error": 1}
    assert {r.path for r in kept.where("value = 'source-budget'").collect()} == {"m3.py", "m4.py", "m5.py"}
