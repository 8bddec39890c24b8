import pytest

from tracewell.operators import sql_text as S

VECTORS = [
    # names of common table expressions, where they hold and where they don't
    ("with late as (select no from parcel where due < 3) select count(*) from late join depot on depot.no = late.no", {"parcel", "depot"}),
    ("WITH RECURSIVE up(k) AS (SELECT boss FROM crew UNION SELECT s.boss FROM up, crew s WHERE s.k = up.k) SELECT k FROM up", {"crew"}),
    ("WITH x1 AS MATERIALIZED (SELECT 2), x2 AS NOT MATERIALIZED (SELECT w FROM weather) SELECT w FROM x1, x2, city", {"weather", "city"}),
    ("WITH gone AS (DELETE FROM queue_item RETURNING *) INSERT INTO archive.item SELECT * FROM gone", {"queue_item", "archive.item"}),
    ("WITH q AS (SELECT 5 AS v) SELECT v FROM q; DELETE FROM q", {"q"}),
    # FROM inside a function's arguments
    ("SELECT extract(hour FROM seen_at), overlay(code PLACING 'x' FROM 2) FROM sighting", {"sighting"}),
    ("SELECT trim(LEADING '0' FROM serial) FROM device WHERE position('a' IN serial) > 0", {"device"}),
    # subqueries
    ("SELECT t.c FROM (SELECT c FROM ledger UNION ALL SELECT c FROM ledger_old) t", {"ledger", "ledger_old"}),
    ("SELECT name, (SELECT min(paid) FROM fee WHERE fee.member = m.id) FROM member m WHERE EXISTS (SELECT FROM visit v)", {"member", "fee", "visit"}),
    ("SELECT * FROM (SELECT a FROM t1 x, (SELECT b FROM t2) y) z, t3 JOIN (SELECT c FROM t4) w ON (w.c = z.a)", {"t1", "t2", "t3", "t4"}),
    # DISTINCT FROM compares
    ("SELECT 1 FROM probe WHERE was IS DISTINCT FROM now_is AND low IS NOT DISTINCT FROM high", {"probe"}),
    # lists, aliases, quotes
    ("SELECT * FROM north n, south AS s, \"We.st\" LEFT JOIN east ON true", {"north", "south", "east", "We%2Est"}),
    ("UPDATE ONLY depot.shelf SET free = free - 1 FROM parcel WHERE parcel.shelf = shelf.no", {"depot.shelf", "parcel"}),
    ("update your address soon", set()),
    ("INSERT INTO note (body) VALUES ('copied from draft') -- JOIN nothing\n /* FROM nowhere */", {"note"}),
    ("SELECT * FROM [long name] JOIN `tick` USING (k) JOIN unnest(a) u ON true", {"long name", "tick"}),
    # statements about tables
    ("TRUNCATE TABLE ONLY hr.pay.slip", {"hr.pay.slip"}),
    ("DROP TABLE IF EXISTS old_a; CREATE TABLE new_a (k int); ALTER TABLE ONLY kept_a ADD k int", {"old_a", "new_a", "kept_a"}),
    ("CREATE UNIQUE INDEX by_k ON kept_b (k); CREATE TRIGGER t AFTER INSERT ON kept_c EXECUTE FUNCTION f()", {"kept_b", "kept_c"}),
    ("GRANT INSERT, SELECT ON TABLE safe TO clerk; REVOKE ALL ON open_door FROM clerk", {"safe", "open_door"}),
    ("GRANT CREATE ON SCHEMA depot TO clerk; GRANT USAGE ON SEQUENCE ids TO clerk", set()),
    ("we joined the club by the sea", set()),
    (" ", set()),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, sql) for i, (sql, _) in enumerate(VECTORS)] + [(99, None)], "id long, sql string")
    out = {}
    for r in S.relations(rows).collect():
        out.setdefault(r.id, set()).add(r.name)
    return out


@pytest.mark.parametrize("i", range(len(VECTORS)))
def test_vectors(found, i):
    assert found.get(i, set()) == VECTORS[i][1]


def test_strict_keywords(spark):
    rows = spark.createDataFrame([(0, "select from a"), (1, "SELECT * FROM a join b"), (2, "DELETE FROM c")], "id long, sql string")
    assert {(r.id, r.name) for r in S.relations(rows, strict=True).collect()} == {(1, "a"), (2, "c")}


def test_texts_are_dealt_by_their_length(spark):
    """A task's share of text is bounded: more texts are more partitions, and all windows are in them."""
    from tracewell.operators import sql_text

    texts = spark.range(40_000, numPartitions=1).selectExpr("id", "concat('SELECT a FROM t', id, repeat(' ', 100)) AS sql")
    assert sql_text.dealt(texts).rdd.getNumPartitions() == 1 + texts.selectExpr("sum(length(sql) + 16)").first()[0] // sql_text.PER_TASK > 6
    found = sql_text.relations(texts.where("id < 50"))
    assert sorted((r.id, r.name) for r in found.collect()) == [(k, f"t{k}") for k in range(50)]


def _plan(spark, strict):
    texts = spark.range(10).selectExpr("id", "concat('SELECT a FROM t', id) AS sql")
    return S.relations(texts, strict)._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_told_once(spark):
    """Texts are dealt once and no table of tokens is joined: stages, and what the driver keeps of their tasks, are as many as partitions."""
    plan = _plan(spark, False)
    assert "Join" not in plan and plan.count("Exchange ") == 1


def test_tokens_are_told_once_strict(spark):
    plan = _plan(spark, True)
    assert "Join" not in plan and plan.count("Exchange ") == 1


def test_sites_of_one_model_are_not_one_task(spark):
    from tracewell.operators.catalog import walk_lookups

    sites = spark.range(100).selectExpr("id AS site", "'M' AS model", "'a__in' AS path")
    found = walk_lookups(sites, spark.createDataFrame([("M", "a", "m", "a", None)], "model string, name string, table_name string, column_name string, target string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted(map(tuple, found.collect())) == [(k, "m", "a") for k in range(100)]
