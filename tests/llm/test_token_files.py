import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import token_files as T


def brute(docs):
    """(doc_id, start, n_tokens, crc) by whole texts through the tokenizer, in order."""
    tokenizer, at, out = T._tokenizer(T.vocabulary()), 0, []
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_table_against_the_tokenizer(spark, small):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    assert sorted(tuple(r) for r in T.query(spark, small).collect()) == brute(docs)


ODD = [(None, "null id"), (None, None), (1, "Same text, twice."), (1, "Same text, twice."), (2, ""), (3, None), (4, "w" * 50_000 + " don't 'S 12 a1b Ünï İ ǅ é ́x"), (5, "a<|endoftext|>b <|ENDOFTEXT|> end. . ..., '' it's\x1cwhat\x0bis this 漢字 ñandú. straße!"), (9, "x\ty\nz")]


@pytest.mark.parametrize("shard_ids", [1, 50, T.SHARD_IDS])
def test_odd_rows_and_shards(spark, tmp_path, shard_ids):
    docs = spark.createDataFrame([(t, d, 7, 8) for d, t in ODD], "text string, doc_id long, part int, seq int").repartition(3)
    T.write(docs, f"{tmp_path}/{shard_ids}", shard_ids=shard_ids)
    got = [tuple(r) for r in T.digests(T.files(spark, f"{tmp_path}/{shard_ids}")).orderBy("start").collect()]
    assert sorted(got[2:]) == brute([("null", "null id"), ("null", None), *ODD[2:]])[2:]
    assert [g[0] for g in got[:2]] == [None, None] and sorted(g[2:] for g in got[:2]) == sorted(x[2:] for x in brute(ODD[:2]))


def test_empty_table(spark, tmp_path):
    T.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none")
    assert T.digests(T.files(spark, f"{tmp_path}/none")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), min_size=1, max_size=8), st.integers(2, 4))
def test_round_trip_and_random_access(docs, least):
    docs = [[*d, 1] for d in docs]
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    shard = T.Shard(T.compress(np.array(sum(docs, []), np.uint32), starts, least))
    assert shard.all().tolist() == sum(docs, []) and shard.starts.tolist() == starts.tolist()
    for k, d in enumerate(docs):
        for a in range(0, len(d) + 1, 7):
            for b in (a, a + 1, a + 9, None, -1):
                assert shard.document(k, a, b).tolist() == d[a:b]
    for k, (x, y) in enumerate(shard.rules):
        parts = [1 if z < shard.base else int(shard.lengths[z - shard.base]) for z in (x, y)]
        assert shard.lengths[k] == sum(parts)


def test_frequent_pairs_become_rules():
    ids = np.array(([5, 6, 7, 8] * 500 + [1]) * 4, np.uint32)
    payload = T.compress(ids, np.arange(5) * 2001)
    assert len(payload) < len(ids) * 4 / 20  # three levels of rules or more
    with pytest.raises(ValueError):
        T.Shard(payload[:-1])
    with pytest.raises(ValueError):
        T.Shard(b"XXXX" + payload[4:])


def test_memory_of_words_is_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(T, "CACHED", 3)
    encoder = T.Encoder(T.vocabulary())
    for text in ("one two three four", "five six", "one seven"):
        assert encoder.encode(pa.array([text]))[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 9
