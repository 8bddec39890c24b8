"""Queries with SQL give the rows that DuckDB gives; all are there, and stages take odd rows."""

import duckdb
import pytest

import corpus_pipeline
from tracewell.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, got = c.sql(registry.ORACLES[name]), registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda found, columns: sorted(repr(tuple(r[list(columns).index(k)] for k in sorted(columns))) for r in found)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_all_are_registered():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near copies", "secrets", "mixture", "tokens"]


# names that stages use inside, too: such columns must come out with their own values
CLASH = "rep _row score lang_pred held_out told mix_block mix_slot mix_pos _rank rank _k k _key key _id id _place place doc live new body src h tie b before n j tk slot ahead late u v a c l token component_id n_shingles class_id position _file _at _d _g row owner found hash salt copied".split()
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH)
ODD = [
    (1, "the thing of that and more words here " * 20, "en", "a", 780),
    (1, "the thing of that and more words here " * 20, "en", "a", 780),
    (2, "the thing of that and more words here " * 20, None, None, None),
    (3, None, None, None, None),
    (None, "token = abcdef123456 of the words and things", "en", "a", 44),
    (4, "", "de", "b", 0),
    (5, "w" * 200_000 + " token = abcdef123457", "en", "a", 200_000),
    (6, "123 456 !!!", "en", "a", 11),
]


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(*r, *range(700, 700 + len(CLASH))) for r in ODD], SHAPE)
    for rows in (docs, docs.limit(0)):
        at = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, "")
            if k < 4:
                assert out.columns == docs.columns
            path = f"{tmp_path}/{k}-{rows is docs}"
            out.write.parquet(path)
            at = spark.read.parquet(path)
            if k < 4:
                assert {tuple(r) for r in at.select(*CLASH).collect()} <= {tuple(range(700, 700 + len(CLASH)))}
                assert dict(at.dtypes) == dict(docs.dtypes)
        ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in at.collect())
        assert ids == ([(False, 0), (True, 1), (True, 5)] if rows is docs else [])
