import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tracewell.llm import fingerprint as M


def brute_leaves(text):
    """Leaf strings as nested lists."""
    sections, at = [], 0
    for i in range(1, len(text)):
        if re.search(r"\n[ \t]{0,8}\n\Z", text[max(0, i - 10) : i]) and not re.match(r"[ \t]*\n", text[i:]):
            sections.append(text[at:i])
            at = i
    sections.append(text[at:])
    return [[re.findall(r"(?:\S+\s*|\s+){1,8}", p) for p in re.findall(r"[^\n]*\n|[^\n]+\Z|\A\Z", s)] for s in sections]


def dice(a, b):
    x, y = ({w for s in brute_leaves(t) for p in s for w in p} for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


TEXTS = [None, "", "one", "one two three\nfour\n\nfive six. " * 6, "one two three\nfour\n\nfive six. " * 6, " lead\n\n\n\nlate ", "é😀 " * 300, "w" * 60_000 + " " + "x y " * 20_000, "\n\n"]


def pairs(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    return [(a[0], a[1] or "", b[1] or "") for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True)]


def check(rows, out):
    want = []
    for i, t, after in pairs(rows):
        k = len(t) // 4
        e = t[: len(t) - k] + after[:k]
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), round(dice(t, e), 9), round(dice(t, after), 9)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out) == sorted(want)
    changed = []
    for i, t, after in pairs(rows):
        k = len(t) // 4
        x, y = brute_leaves(t), brute_leaves(t[: len(t) - k] + after[:k])
        at = [(s, p) for s in range(max(len(x), len(y))) for p in range(max(len(z[s]) if s < len(z) else 0 for z in (x, y))) if [z[s][p] if s < len(z) and p < len(z[s]) else None for z in (x, y)].count(None) or x[s][p] != y[s][p]]
        changed.append((str(i), len(t), len(at), at[0] if at else None))
    assert sorted(((str(r.doc_id), r.n_chars, r.edited_paragraphs, r.first_edited and tuple(r.first_edited)) for r in out), key=str) == sorted(changed, key=str)


@pytest.mark.parametrize("size", [1, 3, 100])
def test_against_brute_force(spark, size, monkeypatch):
    rows = [(i * 7, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (21, TEXTS[3])]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, next string")
    whole = M.with_next
    monkeypatch.setattr(M, "with_next", lambda *a: whole(*a, rows=size))
    out = M.report(docs).collect()
    check(rows, out)
    seen = {}
    for r in out:
        seen.setdefault(r.fingerprint, set()).add(r.n_chars)
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == len({t or "" for _, t in rows})


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], M.query(spark, small).collect())


def test_one_row_none_and_where_an_edit_is(spark):
    docs = spark.createDataFrame([(1, "only one here")], "doc_id long, text string")
    assert M.report(docs).first().near_next == 1.0 and M.report(docs.limit(0)).collect() == []
    both = spark.createDataFrame([("a b\nc d\n\ne f\n", "a b\nc X\n\ne f\n")], "a string, b string")
    found = both.select(M.located(*(M.paragraphs(M.tree(F.col(c))) for c in "ab")).alias("x")).first().x
    assert [(r.section, r.paragraph) for r in found] == [(0, 1)]
