from pyspark.sql import functions as F

from tracewell.functions import naming, urls
from tracewell.operators import facts


def values(spark, column, *rows, names="a"):
    shape = ", ".join(f"{c} string" for c in names)
    data = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {shape}")
    return [r.x for r in data.select("i", column.alias("x")).orderBy("i").collect()]


def test_snake_case(spark):
    a = F.col("a")
    assert values(spark, naming.snake_case(a), "HTTPRequest", "User2FA", "simple", "AbC", "A", "userID") == ["http_request", "user2_fa", "simple", "ab_c", "a", "user_id"]
    assert values(spark, naming.snake_case_runs(a), "HTTPRequest", "User2FA", "CamelCase", "A1") == ["http_request", "user2FA", "camel_case", "a1"]


def test_truncated_names(spark):
    import hashlib

    long = "x" * 40
    assert values(spark, naming.truncate_name(F.col("a"), 30), "short", long, f'"s"."{long}"') == ["short", "x" * 26 + hashlib.md5(long.encode()).hexdigest()[:4], 's"."' + "x" * 26 + hashlib.md5(long.encode()).hexdigest()[:4]]
    assert values(spark, naming.agreed_name(F.col("a")), "plain", "a.b", long, '"quoted"') == ["plain", "a%2Eb", None, None]


def test_normalised_paths(spark):
    a = F.col("a")
    assert values(spark, urls.normalize_path(a), "/%7euser/%2f%2F", "/a b/é", "/{x}", "/%zz") == ["/~user/%2F%2F", "/a%20b/%C3%A9", "/%7Bx%7D", "/%25zz"]
    assert values(spark, urls.encode_literal(a), "/50%/x") == ["/50%25/x"]


def test_template_grammar(spark):
    cases = {"/a/{}": None, "a": "not-rooted", "/" + "x" * 2048: "too-long", "/{**}": None, "/{**}/a": "catch-all-not-last", "/a{**}": "catch-all-partial", "/{a": "stray-brace", "/}": "stray-brace", "/{}x{}": "multiple-parameters", "/%G1": "malformed-percent", "/%2f": "lowercase-percent-hex", "/%41": "encoded-unreserved", "/%20": None, "/é": "invalid-character", "/é{": "invalid-character", "/": None}
    assert values(spark, urls.template_problem(F.col("a")), *cases) == list(cases.values())


def test_joins(spark):
    def join(style, base, path, version=None):
        j = urls.join_path(style, F.col("a"), F.col("b"), version)
        return values(spark, F.concat_ws("|", j["raw"], j["ambiguous"].cast("string")), (base, path), names="ab")[0]

    assert join("rfc3986", "/v1/x", "y") == "/v1/y|false" and join("rfc3986", None, "../y") == "true" and join("rfc3986", None, "./y/.") == "/y/|false"
    assert join("httpx-base-url", "/v1", "//y") == "true" and join("httpx-base-url", "/v1", "/y") == "/v1/y|false"
    assert join("aiohttp-base-url", "/v1/", "y", (3, 11)) == "/v1/y|false" and join("aiohttp-base-url", "/v1/", "y", (3, 10)) == "true"
    assert join("slash-join", "/v1//", "/y") == "/v1/y|false" and join("dio-concat", "/v1/", "/y") == "/v1/y|false" and join("dio-concat", "", "y") == "true" and join("no-base", "/v1", "y") == "false"


def test_mask(spark):
    m = urls.mask_template(F.col("a"), F.col("b"))
    assert values(spark, m["template"], ("/abcdefghijklmnop1/x", None), ("/services/T0/B1", "hooks.slack.com"), ("/api/webhooks/1/a", "discord.com:443"), ("/abcdefghijklmnopq", "h"), names="ab") == ["/{}/x", "/{}/{}/{}", "/api/webhooks/{}/{}", "/abcdefghijklmnopq"]


def test_overlaps_by_brute_force(spark):
    """All short patterns over a small alphabet against a search over paths."""
    from itertools import product

    words = ("a", "b", "*", "{}", "a{}")

    def fits(segment, text):
        return segment == "{}" or (segment == "a{}" and text.startswith("a")) or segment == text

    def takes(pattern, path):
        if not pattern:
            return not path
        if pattern[0] == "*":
            return takes(pattern[1:], path) or (bool(path) and takes(pattern, path[1:]))
        return bool(path) and fits(pattern[0], path[0]) and takes(pattern[1:], path[1:])

    paths = [p for n in range(5) for p in product(("a", "b", "ab"), repeat=n)]
    patterns = [p for n in range(3) for p in product(words, repeat=n)]
    rows = [(list(x), list(y)) for x in patterns for y in patterns]
    got = {(tuple(r.a), tuple(r.b)): r.x for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", facts.overlaps(F.col("a"), F.col("b")).alias("x")).collect()}
    for x in patterns:
        for y in patterns:
            assert got[x, y] == any(takes(x, p) and takes(y, p) for p in paths), (x, y)


def test_methods(spark):
    data = spark.createDataFrame([(0, ["get", "HEAD", "Get"]), (1, ["head"]), (2, [])], "i int, m array<string>")
    assert [r.x for r in data.select("i", facts.emitted_methods(F.col("m")).alias("x")).orderBy("i").collect()] == [["GET"], ["HEAD"], []]


def test_agreement(spark):
    data = spark.createDataFrame([("a", "x", True), ("a", "x", True), ("b", "x", True), ("b", "y", True), ("c", "x", False)], "k string, v string, p boolean")
    assert {r.k: r.v for r in facts.agreement(data, "k", "v", "p").collect()} == {"a": "x", "b": None, "c": None}


def test_small_files_of_many_rows_are_dealt(spark):
    """One partition of many rows becomes several, whatever the size of the file; no row is lost."""
    from tracewell.sources.entity_graph import dealt

    rows = dealt(spark.range(50_000, numPartitions=1))
    assert rows.rdd.getNumPartitions() == 3 and rows.distinct().count() == 50_000
