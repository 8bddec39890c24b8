"""Queries for the column functions and fact operators, each with the same answer in DuckDB SQL where it can be told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import formats, naming, patterns, requirements, urls
from tracewell.operators import change, facts, sql_text
from tracewell.operators.traversal import closure
from tracewell.sources import documents
from tracewell.sources.entity_graph import dealt, table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-like names of parts: words joined in capitals, with the type's letters in between."""
    words = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")).select("p_partkey", F.concat(words, F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.concat(F.substring("p_type", 1, 2), F.col("p_size").cast("string"))), words).alias("name"))


NAMES_SQL = """names AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') AS w,
  CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE substr(p_type, 1, 2) || p_size END AS m FROM part), input AS (SELECT p_partkey, w || m || w AS name FROM names)"""


def name_snake_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", naming.snake_case(F.col("name")).alias("name"))


def name_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", *(naming.truncate_name(F.repeat("name", 3), n).alias(b) for b, n in naming.BACKENDS))


def name_backend_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", naming.agreed_name(F.col("name")).alias("agreed"), naming.agreed_name(F.repeat("name", 2), generated=True).alias("generated"))


def url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = urls.split_url(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", s["kind"].alias("kind"), s["authority"].alias("authority"), urls.cut_query(s["path"]).alias("path"), urls.has_query(s["path"]).cast("int").alias("tail"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with dot segments, slashes and relative starts, from page urls."""
    tail = urls.cut_query(urls.split_url(F.col("url"))["path"])
    k = F.col("page_id") % 8
    raw = F.when(k == 0, tail).when(k == 1, F.concat(F.lit("/a/./b/.."), tail, F.lit("/."))).when(k == 2, F.concat(F.lit("/x/../.."), tail, F.lit("/.."))).when(k == 3, F.concat(tail, F.lit("/"))).when(k == 4, F.substring(tail, 2, 1000)).when(k == 5, F.concat(F.lit("./"), F.substring(tail, 2, 1000))).when(k == 6, F.concat(F.lit("../"), F.substring(tail, 2, 1000))).otherwise(F.lit(""))
    base = F.when(F.col("page_id") % 3 == 0, F.lit("/v1")).when(F.col("page_id") % 3 == 1, F.lit("/api/v2/")).otherwise(F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", raw.alias("path"), base.alias("base"))


_TAIL = "regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '^$', '/')"
PATHS_SQL = f"""tails AS (SELECT page_id, {_TAIL} AS t FROM pages),
  paths AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN t WHEN 1 THEN '/a/./b/..' || t || '/.' WHEN 2 THEN '/x/../..' || t || '/..' WHEN 3 THEN t || '/' WHEN 4 THEN substr(t, 2) WHEN 5 THEN './' || substr(t, 2) WHEN 6 THEN '../' || substr(t, 2) ELSE '' END AS path,
    CASE page_id % 3 WHEN 0 THEN '/v1' WHEN 1 THEN '/api/v2/' ELSE '' END AS base FROM tails)"""


def dots_sql(x: str) -> str:
    """RFC 3986 section 5.2.4 in DuckDB."""
    return f"""('/' || array_to_string(list_concat(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({x}, '/')[2:], lambda s: [s])), lambda a, b: CASE b[1] WHEN '..' THEN a[:len(a) - 1] WHEN '.' THEN a ELSE list_concat(a, b) END),
      CASE WHEN string_split({x}, '/')[-1] IN ('.', '..') THEN [''] ELSE [] END), '/'))"""


def url_dot_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(F.col("path").startswith("/")).select("page_id", urls.remove_dot_segments(F.col("path")).alias("path"))


def url_join(style: str, version: tuple[int, int] | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        j = urls.join_path(style, F.col("base"), F.col("path"), version)
        return _paths(spark, sf_dir).select("page_id", j["raw"].alias("raw"), j["ambiguous"].cast("int").alias("ambiguous"))

    return run


_RFC = f"CASE WHEN path LIKE '/%' THEN {dots_sql('path')} WHEN path = '' THEN {dots_sql('''(CASE base WHEN '' THEN '/' ELSE base END)''')} WHEN base = '' THEN {dots_sql('''('/' || path)''')} ELSE {dots_sql('''(regexp_extract(base, '^(.*/)?') || path)''')} END"
_JOINS = {
    "rfc3986": (_RFC, "false"),
    "httpx-base-url": (dots_sql("(CASE WHEN base LIKE '%/' THEN base ELSE base || '/' END || regexp_replace(path, '^/+', ''))"), "false"),
    "aiohttp-base-url": (_RFC, "base NOT IN ('', '/') AND base NOT LIKE '%/'"),
    "slash-join": ("regexp_replace(base, '/?/$', '') || '/' || regexp_replace(path, '^/+', '')", "false"),
    "dio-concat": (dots_sql("replace(base || path, '//', '/')"), "base = '' AND path NOT LIKE '/%'"),
}


def join_sql(style: str) -> str:
    raw, stuck = _JOINS[style]
    return f"WITH {PATHS_SQL} SELECT page_id, CASE WHEN path LIKE '//%' OR ({stuck}) THEN NULL ELSE {raw} END AS raw, CAST(path LIKE '//%' OR ({stuck}) AS INT) AS ambiguous FROM paths"


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 12
    tail = urls.cut_query(urls.split_url(F.col("url"))["path"])
    end = F.element_at(F.array(*map(F.lit, ("/{}", "/{**}", "/{**}/x", "/a{**}", "/{a}", "/{}{}", "/}", "/%2f", "/%2", "/%41", "/ü", "/p{}s%2F"))), (k + 1).cast("int"))
    secret = F.when(k == 0, F.concat(F.lit("/"), F.md5(F.encode(F.col("page_id").cast("string"), "UTF-8")))).when(k == 1, F.lit("/api/webhooks/12/abc")).otherwise(F.lit("/abcdefghijklmnopq1/short1/{}"))
    host = F.when(k == 1, "discord.com:443").when(k == 2, "hooks.slack.com").otherwise("h.example")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(tail, end).alias("template"), F.concat(F.when(k == 1, F.lit("")).otherwise(tail), secret).alias("path"), host.alias("host"))


TEMPLATES_SQL = f"""tails AS (SELECT page_id, {_TAIL} AS t, page_id % 12 AS k FROM pages),
  templates AS (SELECT page_id, t || ['/{{}}', '/{{**}}', '/{{**}}/x', '/a{{**}}', '/{{a}}', '/{{}}{{}}', '/}}', '/%2f', '/%2', '/%41', '/ü', '/p{{}}s%2F'][k + 1] AS template,
    CASE k WHEN 1 THEN '' ELSE t END || CASE k WHEN 0 THEN '/' || md5(CAST(page_id AS VARCHAR)) WHEN 1 THEN '/api/webhooks/12/abc' ELSE '/abcdefghijklmnopq1/short1/{{}}' END AS path,
    CASE k WHEN 1 THEN 'discord.com:443' WHEN 2 THEN 'hooks.slack.com' ELSE 'h.example' END AS host FROM tails)"""


def template_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templates(spark, sf_dir).select("page_id", urls.template_problem(F.col("template")).alias("problem"))


_UNIT = r"(?:[A-Za-z0-9\-._~!$&''()*+,;=:@]|%(?:[0189A-F][0-9A-F]|2[0-9A-CF]|3[A-F]|[46]0|5[B-E]|7[B-DF]))*"
GRAMMAR_SQL = f"""WITH {TEMPLATES_SQL}, segs AS (SELECT page_id, unnest(string_split(template, '/')[2:]) AS s, generate_subscripts(string_split(template, '/')[2:], 1) AS i, len(string_split(template, '/')) - 1 AS n FROM templates),
  heads AS (SELECT *, regexp_replace(s, '^{_UNIT}', '') AS h FROM segs), rests AS (SELECT *, CASE WHEN h LIKE '{{}}%' THEN regexp_replace(substr(h, 3), '^{_UNIT}', '') ELSE h END AS r FROM heads),
  told AS (SELECT page_id, i, CASE WHEN s = '{{**}}' THEN CASE WHEN i <> n THEN 'catch-all-not-last' END WHEN r = '' THEN NULL WHEN r LIKE '{{**}}%' THEN 'catch-all-partial' WHEN r LIKE '{{}}%' THEN 'multiple-parameters' WHEN r LIKE '{{%' OR r LIKE '}}%' THEN 'stray-brace'
    WHEN r LIKE '\\%%' ESCAPE '\\' THEN CASE WHEN NOT regexp_matches(r, '^%[0-9A-Fa-f][0-9A-Fa-f]') THEN 'malformed-percent' WHEN substr(r, 2, 2) <> upper(substr(r, 2, 2)) THEN 'lowercase-percent-hex' ELSE 'encoded-unreserved' END ELSE 'invalid-character' END AS p FROM rests)
  SELECT page_id, (SELECT min_by(p, i) FROM told WHERE told.page_id = t.page_id AND p IS NOT NULL) AS problem FROM templates t"""


def url_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = urls.mask_template(F.col("path"), F.col("host"))
    return _templates(spark, sf_dir).select("page_id", m["template"].alias("template"), m["masked"].alias("masked"))


MASK_SQL = f"""WITH {TEMPLATES_SQL}, segs AS (SELECT page_id, host, string_split(path, '/') AS a FROM templates),
  flags AS (SELECT page_id, a, list_transform(range(1, len(a) + 1), lambda i: i > 1 AND a[i] <> '' AND NOT contains(a[i], '{{}}') AND (host = 'hooks.slack.com' OR (host LIKE 'discord.com%' AND a[2] = 'api' AND a[3] = 'webhooks' AND i > 3) OR (length(a[i]) >= 16 AND regexp_matches(a[i], '[A-Za-z]') AND regexp_matches(a[i], '[0-9]')))) AS f FROM segs)
  SELECT page_id, array_to_string(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN f[i] THEN '{{}}' ELSE a[i] END), '/') AS template, CAST(list_sum(list_transform(f, lambda x: CAST(x AS INT))) AS INT) AS masked FROM flags"""

# id, form, template, verbs
SCOPES = ((0, "exact", "/en/{}", None), (1, "prefix", "/fr", "GET,POST"), (2, "suffix", "/1{}", "HEAD"), (3, "exact", "/DE/2{}/", "GET"), (4, "prefix", "/{}/9{}", "OPTIONS"), (5, "exact", "/es", None))


def scope_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = spark.createDataFrame([(i, f, t, m.split(",") if m else None) for i, f, t, m in SCOPES], "scope_id int, form string, template string, methods array<string>")
    tail = urls.cut_query(urls.split_url(F.col("url"))["path"])
    verb = F.element_at(F.array(*map(F.lit, ("GET", "HEAD", "POST", "DELETE", "OPTIONS"))), (F.col("page_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("fact_id"), tail.alias("template"), F.lit("root").alias("anchor"), verb.alias("method"), F.lit("call").alias("side"))
    return facts.scope_applies(rows, scopes)


SCOPES_SQL = f"""WITH scopes AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{f}', string_split(lower(regexp_replace('{t}', '/$', '')), '/')[2:], {'NULL' if m is None else 'string_split(' + repr(m) + ', ' + repr(',') + ')'})" for i, f, t, m in SCOPES)}) x(scope_id, form, p, methods)),
  facts AS (SELECT page_id AS fact_id, string_split(lower(regexp_replace({_TAIL}, '/$', '')), '/')[2:] AS a, ['GET', 'HEAD', 'POST', 'DELETE', 'OPTIONS'][page_id % 5 + 1] AS m FROM pages),
  pairs AS (SELECT *, CASE form WHEN 'suffix' THEN a[len(a) - len(p) + 1:] ELSE a[:len(p)] END AS b FROM facts, scopes WHERE (len(a) = len(p) OR (form <> 'exact' AND len(a) >= len(p))) AND (methods IS NULL OR m = 'OPTIONS' OR list_contains(methods, m) OR (m = 'HEAD' AND list_contains(methods, 'GET'))))
  SELECT fact_id, scope_id FROM pairs WHERE len(list_filter(range(1, len(p) + 1), lambda i: CASE WHEN contains(p[i], '{{}}') THEN length(b[i]) >= length(p[i]) - 2 AND starts_with(b[i], split_part(p[i], '{{}}', 1)) AND ends_with(b[i], split_part(p[i], '{{}}', 2)) ELSE b[i] = p[i] END)) = len(p)"""


def order_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact_id"),
        F.when(F.col("l_suppkey") % 50 == 0, "other").otherwise("main").alias("service"),
        F.when(F.col("l_returnflag") == "R", "GET").otherwise("POST").alias("method"),
        F.col("l_partkey").cast("string").alias("usr"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("/p"), F.col("l_partkey").cast("string"), F.lit("/{**}"))).otherwise(F.concat(F.lit("/p"), F.col("l_partkey").cast("string"))).alias("channel"),
        F.concat(F.lit("f"), (F.col("l_orderkey") % 97).cast("string")).alias("path"),
        F.col("l_linenumber").alias("line"),
        F.lit(1).alias("column"),
        F.when(F.col("l_orderkey") % 200 == 0, " g").otherwise(F.concat(F.lit("g"), (F.col("l_orderkey") % 300).cast("string"))).alias("group"),
        (F.col("l_linenumber") - F.when(F.col("l_orderkey") % 500 == 1, 9).otherwise(0)).cast("long").alias("index"),
        (F.col("l_linestatus") == "O").alias("catch_all"),
    )
    return facts.order_problems(line).groupBy("problem").agg(F.count_distinct("fact_id").alias("facts"))


ORDER_SQL = """WITH f AS (SELECT l_orderkey || '-' || l_linenumber AS fact_id, CASE WHEN l_suppkey % 50 = 0 THEN 'other' ELSE 'main' END AS service, CASE l_returnflag WHEN 'R' THEN 'GET' ELSE 'POST' END AS method, l_partkey AS usr,
    l_linestatus = 'O' AS catch_all, 'f' || (l_orderkey % 97) AS path, CASE WHEN l_orderkey % 200 = 0 THEN ' g' ELSE 'g' || (l_orderkey % 300) END AS g, l_linenumber - CASE WHEN l_orderkey % 500 = 1 THEN 9 ELSE 0 END AS i FROM lineitem),
  p AS (SELECT fact_id, 'group' AS problem FROM f WHERE g = ' g' UNION SELECT fact_id, 'index' FROM f WHERE g <> ' g' AND i < 0
    UNION SELECT fact_id, 'shared-group' FROM f WHERE g IN (SELECT g FROM f GROUP BY g HAVING count(DISTINCT service) > 1)
    UNION SELECT fact_id, 'shared-index' FROM f WHERE (g, i) IN (SELECT (g, i) FROM (SELECT DISTINCT g, i, path, l FROM (SELECT *, split_part(fact_id, '-', 2) AS l FROM f)) GROUP BY g, i HAVING count(*) > 1)
    UNION SELECT fact_id, 'catch-all-origin' FROM f WHERE catch_all AND NOT EXISTS (SELECT 1 FROM f o WHERE NOT o.catch_all AND o.usr = f.usr AND o.method = f.method AND o.service = f.service AND o.g = f.g AND o.i = f.i))
  SELECT problem, count(DISTINCT fact_id) AS facts FROM p GROUP BY problem"""


def limitation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = table(spark, sf_dir, "events").select(F.col("event_type").alias("prefix"), F.when(F.col("value") < 50, "{count} small values").otherwise("{count} large values").alias("message"))
    return facts.limitation_counts(gaps)


def facts_dedupe_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("channel"), F.col("l_linestatus").alias("method"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("column"))
    return facts.unique_sorted(rows, "channel", "method", "line", "column")


def longest_prefix_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts turned round to dotted names, labelled by known suffixes of hosts."""
    names = table(spark, sf_dir, "pages").select(F.array_join(F.reverse(F.split(urls.split_url(F.col("url"))["authority"], r"\.")), ".").alias("name")).distinct()
    apps = spark.createDataFrame([("com", "commerce"), ("com.example", "shop"), ("net.example", "net"), ("org", "org")], "prefix string, label string")
    return facts.longest_prefix(names, apps)


PREFIX_SQL = """WITH n AS (SELECT DISTINCT array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')), '.') AS name FROM pages),
  a AS (SELECT * FROM (VALUES ('com', 'commerce'), ('com.example', 'shop'), ('net.example', 'net'), ('org', 'org')) x(prefix, label))
  SELECT name, (SELECT max_by(label, length(prefix)) FROM a WHERE name = prefix OR starts_with(name, prefix || '.')) AS label FROM n"""


def subclass_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    return closure(supplier.unionByName(nation))


CLOSURE_SQL = """WITH RECURSIVE p AS (SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
  w AS (SELECT child AS node, parent AS root, 1 AS depth FROM p UNION SELECT p.child, w.root, w.depth + 1 FROM w JOIN p ON p.parent = w.node)
  SELECT node, root, min(depth) AS depth FROM w GROUP BY node, root"""


def registration_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) AS id", "CAST(NULL AS STRING) AS parent", "CAST(r_regionkey AS BIGINT) AS place", "concat('/', lower(r_name)) AS piece", "false AS leaf"),
        table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)", "CAST(n_nationkey AS BIGINT)", "concat('/', lower(n_name))", "false"),
        table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey)", "concat('n', s_nationkey)", "s_suppkey", "concat('/', s_suppkey)", "true"),
    ]
    tree = parts[0].union(parts[1]).union(parts[2])
    tree.createOrReplaceTempView("route_tree")
    return facts.registration_order(spark, "route_tree")


REGISTRATION_SQL = """SELECT 's' || s_suppkey AS id, '/' || lower(r_name) || '/' || lower(n_name) || '/' || s_suppkey AS piece, row_number() OVER (ORDER BY r_regionkey, n_nationkey, s_suppkey) - 1 AS ordinal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL written from customers' keys: eight shapes, in capitals for the first four."""
    k, n = F.col("c_custkey") % 8, F.col("c_custkey").cast("string")
    seg = F.lower("c_mktsegment")
    sql = (
        F.when(k == 0, F.concat(F.lit("SELECT a, 'from x' FROM t"), n, F.lit(" u, "), seg, F.lit(" WHERE b IS DISTINCT FROM c")))
        .when(k == 1, F.concat(F.lit("WITH w AS (SELECT * FROM t"), n, F.lit(") INSERT INTO "), seg, F.lit(" SELECT * FROM w")))
        .when(k == 2, F.concat(F.lit("UPDATE s.t"), n, F.lit(' SET x = (SELECT EXTRACT(YEAR FROM d) FROM "'), seg, F.lit('.x")')))
        .when(k == 3, F.concat(F.lit("CREATE TABLE IF NOT EXISTS t"), n, F.lit(" (a int); GRANT SELECT ON "), seg, F.lit(" TO bob")))
        .when(k == 4, F.concat(F.lit("select * from t"), n, F.lit(" join "), seg, F.lit(" on true -- from gone")))
        .when(k == 5, F.concat(F.lit("delete from t"), n, F.lit("; truncate table "), seg))
        .when(k == 6, F.concat(F.lit("the "), seg, F.lit(" merged into nothing")))
        .otherwise(F.concat(F.lit("select * from (select * from t"), n, F.lit(") as q where r in (select 1 from "), seg, F.lit(")")))
    )
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), sql.alias("sql"))


def sql_relations(strict: bool):
    return lambda spark, sf_dir: sql_text.relations(_statements(spark, sf_dir), strict)


def _relations_sql(strict: bool) -> str:
    kinds = (0, 1, 2, 3) if strict else (0, 1, 2, 3, 4, 5, 7)
    return f"""SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 2 THEN 's.t' ELSE 't' END || c_custkey AS name FROM customer WHERE c_custkey % 8 IN {kinds}
      UNION ALL SELECT c_custkey, lower(c_mktsegment) || CASE c_custkey % 8 WHEN 2 THEN '%2Ex' ELSE '' END FROM customer WHERE c_custkey % 8 IN {kinds}"""


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of relations by parts: names that a document carries, and of five kinds that it doesn't."""
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    channel = F.when(k == 0, F.concat(F.lit("shop.t"), n)).when(k == 1, F.concat(F.lit("a.."), n)).when(k == 2, F.concat(F.lit(" f("), n, F.lit(") "))).when(k == 3, F.concat(F.lit("bad\n"), n)).when(k == 4, F.lit(" \t")).otherwise(F.concat(F.lit("t"), n))
    return table(spark, sf_dir, "part").select(
        channel.alias("channel"), F.when(k == 5, "c").when((k == 0) & (F.col("p_size") % 2 == 0), "").alias("column_name"), k.isin(2, 4).alias("dynamic"),
        F.concat(F.lit("f"), (F.col("p_size") % 10).cast("string")).alias("path"), F.col("p_size").cast("int").alias("line"), F.lit(1).alias("column"), F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("u"), n)).alias("usr"),
    )


def relation_use_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.relation_uses(_uses(spark, sf_dir)).withColumn("dynamic", F.col("dynamic").cast("int"))


def relation_use_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.relation_use_limits(_uses(spark, sf_dir))


_USES_SQL = """u AS (SELECT p_partkey % 6 AS k, CAST(p_size AS INT) AS n, k = 5 OR (k = 0 AND n % 2 <> 0) AS static FROM part),
  f AS (SELECT DISTINCT CASE k WHEN 0 THEN 'shop.t' || n WHEN 1 THEN 'a..' || n WHEN 2 THEN 'f(' || n || ')' WHEN 3 THEN 'bad ' || n WHEN 4 THEN '<dynamic>' ELSE 't' || n END AS channel, CASE k WHEN 5 THEN 'c' END AS method, CAST(NOT static AS INT) AS dynamic,
    'f' || (n % 10) AS path, n AS line, 1 AS "column", CASE WHEN n % 7 <> 0 THEN 'u' || n END AS usr FROM u)"""


def sql_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _statements(spark, sf_dir)
    return s.select("id", sql_text.looks_like_sql(F.col("sql")).cast("int").alias("loose"), sql_text.looks_like_sql(F.col("sql"), strict=True).cast("int").alias("strict"))


def _shapes(spark: SparkSession, sf_dir: str, *shapes: str) -> DataFrame:
    """(p_partkey, t): of each part one of the texts, with its key in place of #."""
    k = (F.col("p_partkey") % len(shapes) + 1).cast("int")
    return dealt(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", F.replace(F.element_at(F.array(*map(F.lit, shapes)), k), F.lit("#"), F.col("p_partkey").cast("string")).alias("t"))


def _shapes_sql(*told: str | None, name: str = "told") -> str:
    cases = " ".join(f"WHEN {k} THEN " + ("NULL" if t is None else "replace('" + t.replace("'", "''") + "', '#', CAST(p_partkey AS VARCHAR))") for k, t in enumerate(told))
    return f"SELECT p_partkey, CASE p_partkey % {len(told)} {cases} END AS {name} FROM part"


# texts, and what they are told as
PERCENTS = {"/p#/%s/%d": "/p#/{0}/{!1}", "#%% of %s": "#% of {0}", "/%(a)s/#": None, "%*d#": None, "# at 5%": None, "%.2f-%s-#": "{!0}-{1}-#"}
KEYED = {"/%(id)s/#": "/{id}/#", "%(n)05d#": "{!n}#", "%s#": None, "#%%": "#%"}
BRACES = {"/{}/{}/#": "/{0}/{1}/#", "{2}{name}#": "{2}{name}#", "{a.b}#": None, "#{a[0]}": None, "{{#}}{x!r}": "{#}{!x}", "#}": None, "{k:>{w}}#": "{!k}#"}
ALTERNATIVES = {
    "^(en|fr)/p#/$": "/en/p#/ /fr/p#/",
    r"^p#(?:/all)?/(\d+|new)$": "/p#/{} /p#/new /p#/all/{} /p#/all/new",
    "^[ab]{2}#$": None,
    "^x{3}[yz]#/?$": "/xxxy# /xxxz#",
    "^[ab][cd][ef][gh][ij]#$": None,
    "^files/(?P<rest>.*)$": "/files/{**}",
}
REQUIREMENTS = {">=3.8": "minimum-not-newer", ">=3.13,<4": "runtime-below-minimum", ">3.12.1": "runtime-below-minimum", "~=3.12": "minimum-not-newer", "<4": "not-evaluated", ">=3.8,!=3.12.*": "not-evaluated", ">=3.9,<3.8": "not-evaluated", ">=3.8;x": "not-evaluated", "==3.12.*": "minimum-not-newer"}
PATHS = {"src/f#.py": "1", "../f#": "0", "a//#": "0", ".GIT/#": "0", "con.#/x": "0", "console/#": "1", "f#.": "0", "a:#": "0", "": "0"}


def format_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir, *PERCENTS).select("p_partkey", formats.pieces_text(formats.percent_pieces(F.col("t"), False)).alias("told"))


def format_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir, *KEYED).select("p_partkey", formats.pieces_text(formats.percent_pieces(F.col("t"), True)).alias("told"))


def format_braces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir, *BRACES).select("p_partkey", formats.pieces_text(formats.format_pieces(F.col("t"))).alias("told"))


def route_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir, *ALTERNATIVES).select("p_partkey", F.array_join(patterns.pattern_templates(F.col("t")), " ").alias("told"))


def requirement_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir, *REQUIREMENTS).select("p_partkey", requirements.requirement_status(F.col("t"), F.lit("3.12.1")).alias("told"))


def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir, *PATHS).select("p_partkey", change.is_safe_path(F.col("t")).cast("int").cast("string").alias("told"))


def expression_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.concat(F.lit(" "), F.repeat(F.concat("p_name", F.lit("\n\t ")), 1 + F.col("p_partkey").cast("int") % 9))
    return table(spark, sf_dir, "part").select("p_partkey", formats.shown(words).alias("told"))


# scopes as (templates, template_prefixes, template_suffixes, methods), and their problem
SCOPE_SHAPES = (
    (["/a/{}"], None, None, ["GET", "POST"], None),
    (None, None, None, ["GET"], "no paths"),
    ([], None, None, None, "templates: empty"),
    (["/a", "a"], None, None, None, "templates: not canonical"),
    (["/a/{**}"], ["/b/{**}"], None, None, "template_prefixes: catch-all"),
    (None, ["/b/"], None, None, "template_prefixes: ends with a slash"),
    (None, ["/"], ["/"], None, "template_suffixes: only a slash"),
    (None, ["/"], ["/x"], [], "methods: empty"),
    (["/a"], None, None, ["GET", "ANY"], "methods: unknown"),
    (["/a"], None, None, ["GET", "GET"], "methods: repeated"),
    (None, None, ["/x/"], None, None),
)
_SCOPE_TYPES = "k int, templates array<string>, template_prefixes array<string>, template_suffixes array<string>, methods array<string>"


def _scoped(spark: SparkSession, rows: DataFrame, key) -> DataFrame:
    """``rows`` with one of SCOPE_SHAPES each."""
    shapes = spark.createDataFrame([(k, *s[:4]) for k, s in enumerate(SCOPE_SHAPES)], _SCOPE_TYPES)
    return rows.withColumn("k", (key % len(SCOPE_SHAPES)).cast("int")).join(F.broadcast(shapes), "k")


def scope_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scoped(spark, table(spark, sf_dir, "part").select("p_partkey"), F.col("p_partkey"))
    return rows.select("p_partkey", facts.scope_problem(**{c: F.col(c) for c in (*facts.SCOPE_PATHS, "methods")}).alias("told"))


def document_limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of events by type, with a scope of each shape."""
    gaps = _scoped(spark, table(spark, sf_dir, "events").select(F.col("event_type").alias("prefix"), F.lit("{count} routes").alias("message"), "event_id"), F.col("event_id"))
    told = facts.limitations(gaps.drop("k", "event_id"))
    return told.select("limitation_index", "sentence", F.coalesce("templates", "template_prefixes", "template_suffixes").isNotNull().cast("int").alias("scoped"))


_GOOD = [k for k, s in enumerate(SCOPE_SHAPES) if s[4] is None]
LIMITS_SQL = f"""WITH g AS (SELECT event_type AS p, CASE WHEN event_id % {len(SCOPE_SHAPES)} IN ({', '.join(map(str, _GOOD))}) THEN event_id % {len(SCOPE_SHAPES)} END AS k FROM events),
  t AS (SELECT p || ': ' || count(*) || ' routes' AS sentence, 0 AS scoped FROM g WHERE k IS NULL GROUP BY p UNION ALL SELECT p || ': 1 routes', 1 FROM (SELECT DISTINCT p, k FROM g WHERE k IS NOT NULL))
  SELECT row_number() OVER (ORDER BY sentence, scoped) - 1 AS limitation_index, sentence, scoped FROM t"""


def client_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients that customers' orders assign, of a library by the customer, some of several."""
    c, o = F.col("o_custkey") % 5, F.col("o_orderkey") % 3
    library = F.when(c == 0, "requests").when(c < 3, "httpx").when((c == 4) & (o == 1), "requests").otherwise("aiohttp")
    base = F.when(c == 2, F.concat(F.lit("/"), o.cast("string"))).otherwise(F.lit("/v1"))
    style = F.when(c == 0, F.when(o == 0, "no-base").otherwise("rfc3986")).when(c < 3, "httpx-base-url").otherwise("aiohttp-base-url")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), library.alias("library"), style.alias("style"), base.alias("base"), (o >= 0).alias("base_known"))
    return facts.client_agreement(rows).withColumn("base_known", F.col("base_known").cast("int"))


CLIENTS_SQL = """WITH r AS (SELECT o_custkey AS name, o_custkey % 5 AS c, o_orderkey % 3 AS o FROM orders), n AS (SELECT name, c, count(DISTINCT o) AS n, count(DISTINCT o = 0) AS z, count(DISTINCT o = 1) AS x, min(o) AS o FROM r GROUP BY name, c)
  SELECT name, CASE WHEN c = 0 OR (c = 4 AND o = 1) THEN 'requests' WHEN c < 3 THEN 'httpx' ELSE 'aiohttp' END AS library, CASE WHEN c = 0 THEN CASE WHEN z > 1 OR o = 0 THEN 'no-base' ELSE 'rfc3986' END WHEN c < 3 THEN 'httpx-base-url' ELSE 'aiohttp-base-url' END AS style,
    CASE WHEN c = 2 AND n > 1 THEN NULL WHEN c = 2 THEN '/' || o WHEN c = 0 AND z > 1 THEN NULL ELSE '/v1' END AS base, CASE WHEN (c = 2 AND n > 1) OR (c = 0 AND z > 1) THEN 0 ELSE 1 END AS base_known
  FROM n WHERE NOT (c = 4 AND x > 1)"""


def route_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of a route for each supplier, some dynamic, twice each, and of gaps by nation."""
    s = table(spark, sf_dir, "supplier")
    even = F.col("s_suppkey") % 2 == 0
    rows = s.select(
        F.when(even, F.concat(F.lit("/s"), F.col("s_suppkey").cast("string"))).alias("channel"), F.lit("GET").alias("method"), F.lit("root").alias("anchor"), (~even).alias("dynamic"),
        F.format_string("n%d.py", "s_nationkey").alias("path"), F.col("s_suppkey").alias("line"), F.lit(1).alias("column"), F.format_string("n%d.py#f%d", "s_nationkey", "s_suppkey").alias("id"),
        F.when(even, "required").alias("trailing_slash"), F.lit("g").alias("group"), F.col("s_suppkey").alias("index"),
    )
    gaps = _scoped(spark, s.select(F.lit("opaque").alias("prefix"), F.lit("{count} views").alias("message"), "s_suppkey"), F.lit(0)).drop("k", "s_suppkey")
    lines = documents.fact_lines("server", rows.union(rows), gaps, "shop", F.lit("2024-01-02 03:04:05.678").cast("timestamp"), service="main")
    return lines.withColumn("place", F.col("place").cast("int"))


DOCUMENT_SQL = """WITH f AS (SELECT s_suppkey AS s, 'n' || s_nationkey || '.py' AS p, s_suppkey % 2 = 0 AS even FROM supplier),
  j AS (SELECT CASE WHEN even THEN '/s' || s ELSE '' END AS c, NOT even AS d, p, s, '{' || CASE WHEN even THEN '"channel":"/s' || s || '",' ELSE '' END || '"dynamic":' || CASE WHEN even THEN 'false' ELSE 'true' END || ',"kind":"route-decl","location":' || to_json({'column': 1, 'line': s, 'path': p}) || ',"method":"GET","order":'
    || to_json({'group': 'g', 'index': s}) || ',"pathAnchor":"root","service":"main","symbol":' || to_json({'qualifiedName': p || '#f' || s, 'usr': p || '#f' || s}) || CASE WHEN even THEN ',"trailingSlash":"required"' ELSE '' END || '}' AS x FROM f)
  SELECT 'header' AS part, 0 AS place, '{"format":"bridge-facts","platform":"python","project":"shop","roles":["server"],"service":"main","sourceSets":{"tests":"excluded"},"target":"http","tool":{"name":"tracewell"},"version":1,"generatedAt":"2024-01-02T03:04:05.678Z"}' AS json
  UNION ALL SELECT 'facts', CAST(row_number() OVER (ORDER BY c, d, p, s) - 1 AS INT), x FROM j
  UNION ALL SELECT 'limitations', 0, 'opaque: 1 views' UNION ALL SELECT 'scopes', 0, '{"limitationIndex":0,"methods":["GET","POST"],"templates":["/a/{}"]}'"""


QUERIES = {
    "format_percent": format_percent,
    "format_keyed": format_keyed,
    "format_braces": format_braces,
    "route_alternatives": route_alternatives,
    "requirement_status": requirement_status,
    "path_safety": path_safety,
    "expression_shown": expression_shown,
    "scope_validate": scope_validate,
    "document_limitations": document_limitations,
    "client_agreement": client_agreement,
    "route_document": route_document,
    "name_snake_case": name_snake_case,
    "name_truncate": name_truncate,
    "name_backend_agreement": name_backend_agreement,
    "url_split": url_split,
    "url_dot_segments": url_dot_segments,
    "url_join_rfc3986": url_join("rfc3986"),
    "url_join_httpx": url_join("httpx-base-url"),
    "url_join_aiohttp": url_join("aiohttp-base-url", (3, 12)),
    "url_join_slash": url_join("slash-join"),
    "url_join_dio": url_join("dio-concat"),
    "url_mask": url_mask,
    "template_grammar": template_grammar,
    "scope_overlap": scope_overlap,
    "order_validate": order_validate,
    "limitation_counts": limitation_counts,
    "facts_dedupe_sort": facts_dedupe_sort,
    "longest_prefix_label": longest_prefix_label,
    "subclass_closure": subclass_closure,
    "registration_order_flatten": registration_order,
    "sql_relations_loose": sql_relations(False),
    "sql_relations_strict": sql_relations(True),
    "sql_likeness": sql_likeness,
    "relation_use_facts": relation_use_facts,
    "relation_use_limits": relation_use_limits,
}
ORACLES = {
    "format_percent": _shapes_sql(*PERCENTS.values()),
    "format_keyed": _shapes_sql(*KEYED.values()),
    "format_braces": _shapes_sql(*BRACES.values()),
    "route_alternatives": _shapes_sql(*ALTERNATIVES.values()),
    "requirement_status": _shapes_sql(*REQUIREMENTS.values()),
    "path_safety": _shapes_sql(*PATHS.values()),
    "expression_shown": f"WITH t AS (SELECT p_partkey, trim(repeat(p_name || ' ', CAST(1 + p_partkey % 9 AS INT))) AS x FROM part) SELECT p_partkey, CASE WHEN length(x) > {formats.LONGEST_EXPRESSION} THEN substr(x, 1, {formats.LONGEST_EXPRESSION - 1}) || '…' ELSE x END AS told FROM t",
    "scope_validate": _shapes_sql(*(s[4] for s in SCOPE_SHAPES)),
    "document_limitations": LIMITS_SQL,
    "client_agreement": CLIENTS_SQL,
    "route_document": DOCUMENT_SQL,
    "name_snake_case": f"WITH {NAMES_SQL} SELECT p_partkey, lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')) AS name FROM input",
    "name_truncate": f"WITH {NAMES_SQL}, long AS (SELECT p_partkey, repeat(name, 3) AS n FROM input) SELECT p_partkey, n AS sqlite, {', '.join(f'CASE WHEN length(n) <= {n} THEN n ELSE substr(n, 1, {n} - 4) || substr(md5(n), 1, 4) END AS {b}' for b, n in naming.BACKENDS if n)} FROM long",
    "name_backend_agreement": f"WITH {NAMES_SQL} SELECT p_partkey, CASE WHEN length(name) <= 30 THEN name END AS agreed, CASE WHEN 2 * length(name) <= 30 THEN repeat(name, 2) END AS generated FROM input",
    "url_split": f"SELECT page_id, 'absolute' AS kind, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS authority, {_TAIL} AS path, CAST(regexp_matches(url, '[?#]') AS INT) AS tail FROM pages",
    "url_dot_segments": f"WITH {PATHS_SQL} SELECT page_id, {dots_sql('path')} AS path FROM paths WHERE path LIKE '/%'",
    "url_join_rfc3986": join_sql("rfc3986"),
    "url_join_httpx": join_sql("httpx-base-url"),
    "url_join_aiohttp": join_sql("aiohttp-base-url"),
    "url_join_slash": join_sql("slash-join"),
    "url_join_dio": join_sql("dio-concat"),
    "url_mask": MASK_SQL,
    "template_grammar": GRAMMAR_SQL,
    "scope_overlap": SCOPES_SQL,
    "order_validate": ORDER_SQL,
    "limitation_counts": "SELECT event_type AS prefix, event_type || ': ' || count(*) || CASE WHEN value < 50 THEN ' small values' ELSE ' large values' END AS sentence FROM events GROUP BY event_type, value < 50",
    "facts_dedupe_sort": "SELECT DISTINCT l_returnflag AS channel, l_linestatus AS method, l_linenumber AS line, l_quantity AS \"column\" FROM lineitem",
    "longest_prefix_label": PREFIX_SQL,
    "subclass_closure": CLOSURE_SQL,
    "registration_order_flatten": REGISTRATION_SQL,
    "sql_relations_loose": _relations_sql(False),
    "sql_relations_strict": _relations_sql(True),
    "relation_use_facts": f"WITH {_USES_SQL} SELECT * FROM f",
    "relation_use_limits": f"""WITH {_USES_SQL} SELECT * FROM (SELECT 'invalid-relation-names' AS prefix, 'invalid-relation-names: ' || count(*) || ' names the exchange format cannot carry became dynamic' AS sentence FROM u WHERE NOT static AND k NOT IN (2, 4) HAVING count(*) > 0
      UNION ALL SELECT 'missing-relation-usrs', 'missing-relation-usrs: ' || count(*) || ' facts are outside any function or class' FROM f WHERE usr IS NULL HAVING count(*) > 0)""",
    "sql_likeness": "SELECT c_custkey AS id, CAST(c_custkey % 8 <> 6 AS INT) AS loose, CAST(c_custkey % 8 < 4 AS INT) AS strict FROM customer",
}
