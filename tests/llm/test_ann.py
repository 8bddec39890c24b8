import numpy as np

from tracewell.llm import ann as A


def brute(rows, every=A.EVERY, nearest=A.NEAREST):
    """Exact neighbours by whole comparison."""
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in rows:
        if i % every == 0:
            scored = {j: float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))) for j, v in rows if j != i}
            out[i] = sorted(((-s, j) for j, s in scored.items()))[:nearest]
    return out


def test_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(rows), {}
    vectors = {i: np.array(v, float) for i, v in rows}
    for r in A.query(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        q, v = vectors[r.query_id], vectors[r.vec_id]
        assert abs(r.score - q @ v / np.linalg.norm(q) / np.linalg.norm(v)) < 1e-12
    assert got.keys() == want.keys() and all(g == sorted(g) and len(g) == A.NEAREST for g in got.values())
    found = sum(len({j for _, j in want[i]} & {j for _, j in got[i]}) for i in want)
    assert found >= 0.9 * sum(map(len, want.values()))


def test_hot_vector_ties_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_ROWS", 50)
    random = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) if i % 3 == 0 else (i, random.normal(size=3).tolist()) for i in range(400)]
    got = {}
    data = A.usable_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    exact = [(r.vec_id, r.v) for r in data.collect()]
    for r in A.search(data, data.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {i: [j for _, j in x] for i, x in brute(exact).items()}
    assert got[0] == [3, 6, 9, 12, 15] == want[0] and got[150] == want[150] == [0, 3, 6, 9, 12]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1e30, 1e30]), (None, [1.0, 1.0]), (7, []), (8, [1.0]), (50, [float("inf"), 1.0])]
    data = A.usable_rows(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int"))
    out = A.search(data, data.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in out] == [(0, 1, 1), (0, 2, 6)] and abs(out[1].score - 0.5**0.5) < 1e-12
    assert A.search(data.limit(0), data.limit(0)).collect() == []


def test_copies_of_rows_take_no_places(spark):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=4).tolist()) for i in range(600)]
    shape = "vec_id long, embedding array<float>"
    asked = lambda data: sorted(map(tuple, A.search(data, data.where("vec_id % 50 = 0")).collect()))
    once, often = (asked(A.usable_rows(spark.createDataFrame(rows * n, shape))) for n in (1, 5))
    assert often == once and len(once) == 12 * A.NEAREST


def test_an_id_of_many_vectors_takes_one_place():
    rows = np.array([[1.0, 0.01 * k] for k in range(6)] + [[1.0, 0.5], [1.0, 0.6], [1.0, 0.7], [1.0, 0.8]])
    block = A.Block(np.array([7] * 6 + [1, 2, 3, 4]), rows, np.zeros(10, np.int64))
    found = block.best(np.array([[1.0, 0.0]]), np.array([99]), [[0]], 5)
    assert [x for _, x in found[0]] == [7, 1, 2, 3, 4]


def test_very_large_and_small_numbers_and_other_lengths(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-170, 0.0]), (2, [3e-320, 3e-320]), (3, [1.0, 1.0, 1.0]), (50, [2.0, 1.0, 1.0]), (4, [-1e300, 1e300])]
    data = A.usable_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = A.search(data, data.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in out] == [(0, 2), (0, 1), (0, 4), (50, 3)]
    assert np.allclose([r.score for r in out], [1.0, 0.5**0.5, 0.0, 4 / 18**0.5])


def test_blocks_hold_a_bounded_number_of_rows():
    counts = {0: 30, 1: 30, 2: 250, 3: 90, 4: 5, 5: 5}
    assert A.blocks_of(counts, 100) == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (4, 1), 4: (4, 1), 5: (4, 1)}


def test_share_of_rows_compared_falls_with_the_table():
    """Clustered vectors: four times the rows have about four times the leaves, and a query compares a smaller share of the rows."""
    random, shares = np.random.default_rng(6), []
    centers = random.normal(size=(400, 16))
    for n in (2000, 8000, 32000):
        points = A.unit(centers[random.integers(0, 400, n)] + 0.3 * random.normal(size=(n, 16)))
        tree = A.Tree(points)
        shares.append(A.calibrate(tree, points) / tree.leaves)
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.1


def test_an_id_of_vectors_in_many_leaves(spark):
    random = np.random.default_rng(4)
    rows = [(i, random.normal(size=4).tolist()) for i in range(300)] + [(i, random.normal(size=4).tolist()) for i in range(1, 300, 3)]
    data = A.usable_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = {}
    for r in A.search(data, data.where("vec_id % 50 = 0 AND vec_id % 3 <> 1")).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found and all(len(x) == len(set(x)) == A.NEAREST for x in found.values())
