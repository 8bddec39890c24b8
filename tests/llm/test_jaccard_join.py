import random
import re

import pytest

from tracewell.llm import jaccard_join as J


def brute(rows, words=J.WORDS, percent=J.PERCENT):
    """(doc_id, size, component) by comparing all sets."""
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index = {}
    for k, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    seen = set()
    for members in index.values():
        for p, a in enumerate(members):
            for b in members[p + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    x, y = rows[a][0], rows[b][0]
                    both = len(sets[a] & sets[b])
                    if x is not None and y is not None and 100 * both >= percent * len(sets[a] | sets[b]):
                        low, high = sorted((root(x), root(y)))
                        up[high] = low
    return sorted((str(i), len(s), str(None if i is None else root(i))) for (i, _), s in zip(rows, sets, strict=True))


def got(out):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out.collect())


def corpus(seed, base=12, copies=9, words=(1, 90), edits=4):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("xyzuvw") + r.choice("12")
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(base):
        own = [word() for _ in range(r.randint(*words))]
        if r.random() < 0.5:
            own = own[:10] + passage + own[10:]
        for _ in range(r.randint(1, copies)):
            w = list(own)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = word()
            texts.append((" " if r.random() < 0.5 else "\n").join(w))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_random_corpora_against_brute_force(spark, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(J, "FEW", 0)  # go through the rounds of stars
        monkeypatch.setattr(J, "STARS", 1 + seed // 2)
    rows = list(enumerate(corpus(seed)))
    out = J.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out) == brute(rows)


def test_small_thresholds_against_brute_force(spark):
    rows = list(enumerate(corpus(9, edits=8)))
    assert got(J.join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)) == brute(rows, 5, 80)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two"), (7, "one two three"), (None, "one two"), (8, "É a b c d"), (9, "é a b c d"), (10, "w " * 50_000), (11, "w " * 40_000), (4, "One two")]
    data = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n long, rep string")
    assert got(J.join(data)) == sorted((str(i), 0 if not (t or "").strip() else 2 if "a b" in t else 1, str({5: 4, 11: 10}.get(i, i))) for i, t in rows)
    assert J.join(data.limit(0)).collect() == []
    kept = sorted(str(r.doc_id) for r in J.stage(spark, data, "").collect())
    assert kept == sorted(["1", "2", "3", "4", "6", "7", "None", "8", "9", "10"]) and J.stage(spark, data, "").columns == data.columns


def test_one_id_with_two_texts_joins_their_groups(spark):
    a, b = "a b c d e f g", "p q r s t u v"
    rows = [(1, a), (2, b), (3, a), (3, b), (4, "x y z w")]
    assert {(r.doc_id, r.component_id) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_one_id_with_three_texts_joins_all_their_groups(spark):
    a, b, c = "a b c d e f g", "p q r s t u v", "k l m n o i j"
    rows = [(1, a), (2, b), (3, c), (5, a), (5, b), (5, c), (6, a), (6, a), (7, "x y z w")]
    found = {(r.doc_id, r.component_id) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (7, 7)}


def test_ids_of_several_texts_of_one_size_against_brute_force(spark):
    rows = [(k % 23, t) for k, t in enumerate(corpus(21, edits=6))] + [(3, "a b c d e"), (3, "e d c b a")]
    assert got(J.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70)) == brute(rows, 3, 70)


def test_whole_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert got(J.query(spark, small)) == brute(rows)
