import pytest

from tracewell.llm import token_counts as T

SHAPE = "source string, lang string, tokenizer string, kind string, tokens long, old_tokens long"


def test_signed_batches_and_retries(spark, tmp_path):
    r = T.Rollup(spark, f"{tmp_path}/r")
    assert r.totals().collect() == [] and r.committed() == []
    one = spark.createDataFrame([("a", "en", "v1", "insert", 10, None), ("a", "en", "v1", "insert", 5, None), (None, None, "v1", "insert", None, None), ("b", "de", "v2", "insert", 3, None)], SHAPE)
    two = spark.createDataFrame([("a", "en", "v1", "delete", 10, None), ("a", "en", "v1", "revise", 9, 5), ("b", "de", "v2", "delete", 3, None)], SHAPE)
    assert r.commit("1", one) and not r.commit("1", one) and r.commit("2", two) and not r.commit("2", two) and r.commit("3", one.limit(0))
    assert r.committed() == ["1", "2", "3"]
    assert sorted(map(tuple, r.totals().collect()), key=str) == sorted([("a", "en", "v1", 1, 9), (None, None, "v1", 1, 0)], key=str)


def test_a_failed_batch_leaves_no_trace(spark, tmp_path):
    r = T.Rollup(spark, f"{tmp_path}/r")
    with pytest.raises(Exception, match="unknown kind"):
        r.commit("1", spark.createDataFrame([("a", "en", "v1", "upsert", 1, None)], SHAPE))
    assert r.committed() == [] and r.totals().collect() == [] and not list(tmp_path.glob("r/_made-*"))
    assert r.commit("1", spark.createDataFrame([("a", "en", "v1", "insert", 1, None)], SHAPE)) and r.totals().count() == 1


def test_of_writers_at_once_one_wins(spark, tmp_path):
    """All write the batch before any puts it in place, as all have seen that it isn't there."""
    from concurrent.futures import ThreadPoolExecutor

    rows = T.deltas(spark.createDataFrame([("a", "en", "v1", "insert", 10, None)], SHAPE))
    r = T.Rollup(spark, f"{tmp_path}/r")
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda _: T.Rollup(spark, f"{tmp_path}/r")._put("1", rows), range(4)))
    assert sorted(won) == [False, False, False, True] and r.committed() == ["1"]
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 1, 10)]
    assert not list(tmp_path.glob("r/**/_made-*"))


def test_repeated_ids_and_texts_against_sql(spark):
    import duckdb

    rows = [(1, "same text"), (5, "same text"), (5, "other words here"), (1, "same text"), (None, "same text"), (None, None), (3, None), (3, ""), (7, "x\ny " * 9000), (None, "alone\n")]
    docs = spark.createDataFrame([(t, "en", "a", d, 5, 6) for d, t in rows], "text string, lang string, source string, doc_id long, row int, hash int").repartition(3)
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, text VARCHAR)")
    for d, t in rows:
        c.execute("INSERT INTO documents VALUES (?, 'a', 'en', ?)", [d, t])
    order = ("source", "lang", "tokenizer", "documents", "tokens")
    want = c.sql(f"SELECT {', '.join(order)} FROM ({T.ORACLE_SQL})").fetchall()
    assert sorted(tuple(r[k] for k in order) for r in T.rolled(spark, docs).collect()) == sorted(want)
    assert T.rolled(spark, docs.limit(0)).collect() == []
