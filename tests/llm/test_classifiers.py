import zlib

from pyspark.sql import functions as F

from tracewell.llm import language_id, quality


def test_language_on_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = language_id.query(spark, small)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == docs.count()
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_out_of_place_by_brute_force(spark, small):
    """Distances of one text from dictionaries of n-grams, counted in plain Python."""
    from collections import Counter

    docs = spark.read.parquet(f"{small}/documents.parquet")
    profiles = language_id.fit(docs, profile=50)
    text = docs.orderBy("doc_id").first().text
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    grams = Counter()
    line = " " + " ".join(words) + " "
    for i in range(len(line)):
        grams[line[i]] += line[i] != " "
        if i + 1 < len(line):
            grams[line[i : i + 2]] += 1
        if i + 2 < len(line):
            grams[line[i : i + 3]] += line[i + 1] != " "
    pack = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    top = [g for _, g in sorted((-n, pack(g)) for g, n in grams.items() if n)][:50]
    far = {}
    for lang, profile in profiles.items():
        place = {g: k for k, g in enumerate(profile.tolist())}
        far[lang] = sum(abs(place[g] - k) if g in place else 50 for k, g in enumerate(top))
    best = min(sorted(far), key=far.get)
    got = language_id.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), profiles, 50).first()
    assert got.lang_pred == best and abs(got.score - (1 - far[best] / (50 * len(top)))) < 1e-12


def test_language_of_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, "en", 1), (None, "123 !!", "en", 2), (3, "", None, 3), (4, "Ünder " * 3000, None, 4), (4, "Ünder " * 3000, None, 4), (5, "the thing of that", "en", 5)], "doc_id long, text string, lang string, score int")
    known = odd.union(spark.createDataFrame([(k, "the thing of that", "en", 6) for k in range(10, 20)], odd.schema))
    out = language_id.predict(odd, language_id.fit(known)).collect()
    assert len(out) == 6 and {r.doc_id for r in out if r.lang_pred == "und"} == {1, None, 3}
    assert language_id.predict(odd.limit(0), language_id.fit(odd.limit(0))).count() == 0
    assert language_id.predict(odd, {}).where("lang_pred <> 'und'").count() == 0
    kept = language_id.stage(spark, known, "")
    assert kept.columns == odd.columns and sorted(r.score for r in kept.collect()) == [4, 4, 5] + [6] * 10


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    wins = sum(g > b for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.93
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(k, ("good words here %d " % k) * 9 if k % 2 else "bad $$$ ### %d " % k * 9, 1) for k in range(80)] + [(None, None, 1), (200, "", 1), (200, "", 1), (201, "w" * 3_000_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(None, 1), (7, None)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert min(r.score for r in out if r.doc_id is not None and r.doc_id < 80 and r.doc_id % 2) > max(r.score for r in out if r.doc_id is not None and r.doc_id < 80 and not r.doc_id % 2)
    none = quality.score(docs, quality.fit(docs, labels.limit(0))).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).agg(F.count("*")).first()[0] == 0


def test_training_steps_and_scores_against_plain_python(spark):
    """Follow-the-regularised-leader, one coordinate after the other in dictionaries, and scores as sparse dot products."""
    import math

    import numpy as np
    import pyarrow as pa

    texts = [("good plain words in a row number %d of many" if k % 2 else "bad $$$ bad ### %d $$$ buy") % k for k in range(30)]
    rows = []
    for first, count, of, bucket, value in quality._features(pa.array(texts, pa.large_string())):
        for k in range(count):
            rows.append((np.append(bucket[of == k], quality.BUCKETS), np.append(value[of == k], 1.0), float((first + k) % 2)))
    z, n, order = {}, {}, np.random.default_rng(7)

    def weight(i):
        far = abs(z.get(i, 0.0)) - quality.L1
        return 0.0 if far <= 0 else -math.copysign(far, z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(3):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = [weight(i) for i in at.tolist()]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x.tolist()))))
            for i, v, a in zip(at.tolist(), x.tolist(), w):
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * a
                n[i] = n.get(i, 0.0) + g * g
    trained = quality.train(rows, epochs=3)
    want = {i: weight(i) for i in z}
    assert all(abs(trained[i] - w) < 1e-9 for i, w in want.items()) and np.count_nonzero(trained) == sum(w != 0 for w in want.values()) > 0
    scored = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), trained).collect()}
    for k, (at, x, _) in enumerate(rows):
        assert abs(scored[k] - 1 / (1 + math.exp(-sum(want.get(i, 0.0) * v for i, v in zip(at.tolist(), x.tolist()))))) < 1e-9


def test_language_stage_without_labels_keeps_what_has_letters(spark):
    from tracewell.llm import language_id

    docs = spark.createDataFrame([(1, "some words", None), (2, "123 ...", None), (3, None, None), (4, "", None), (5, "漢字", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language_id.stage(spark, docs, "").collect()) == [1, 5]
