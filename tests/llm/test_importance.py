import hashlib
import math
import re
import zlib
from collections import Counter

from tracewell.llm import importance as I


def features(text):
    words = re.findall(I.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target):
    """Rows of resample by plain Python; documents as (doc_id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for doc, text in docs:
        n, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([n, doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1] is not None, r[1] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((*r[1:], rank.get(id(r))) for r in rows), key=repr)


def test_whole_table_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in I.query(spark, small).collect()), key=repr) == brute(docs, target)


ODD = [(None, "the words of it " * 9), (1, None), (1, "Same Text twice. " * 9), (1, "Same Text twice. " * 9), (2, ""), (3, "...  !"), (4, "w" * 50_000), (5, "éa Ünï 漢字 a1 1a " * 5), (6, "a b " * 40_000), (7, "one"), (8, "É\x00z{q"), *((k, f"word{k} the of " * 8) for k in range(9, 30))]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(t, d, 5, 6) for d, t in ODD], "text string, doc_id long, row int, bucket int").repartition(3)
    target = spark.createDataFrame([("the words of a target",), (None,), ("",)], "text string")
    assert sorted((tuple(r) for r in I.resample(docs, target).collect()), key=repr) == brute(ODD, ["the words of a target", None, ""])


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert I.resample(none, some.select("text")).collect() == []
    assert [tuple(r) for r in I.resample(some, none.select("text")).collect()] == brute([(1, "a b c")], [])


def test_no_words_are_shuffled_and_no_python_runs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text", I.F.col("doc_id").alias("row"))
    plan = I.document_buckets(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Generate" in plan and "Window" in plan
