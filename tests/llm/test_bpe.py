import base64

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import bpe

RANKS = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HARD = ["", " ", "a" * 5000, "ab" * 777, "\n" * 300, " " * 999, "0123456789" * 50, "überä" * 200, "漢字" * 300, "😀" * 50 + "x", "the" * 400 + "!!" * 90, "<|endoftext|>", "A1b2" * 300]


@pytest.mark.parametrize("text", HARD)
def test_same_ids_as_the_library(text):
    ids = CODEC.encode(text)
    assert list(ids) == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabbcdeth ngionsABC09.,é漢\n"), max_size=400))
def test_random_texts(text):
    assert list(CODEC.encode(text)) == REFERENCE.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(0, 300))
def test_joining_is_the_encoding_of_the_whole(piece, at):
    at = min(at, len(piece))
    left, right = CODEC.merged(piece[:at]), CODEC.merged(piece[at:])
    assert CODEC.join(left, right) == CODEC.merged(piece) == CODEC.merged_long(piece) == CODEC.tree(piece)


def test_query_against_the_library(spark, small):
    import hashlib
    import struct

    rows = {r.doc_id: r for r in bpe.query(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = REFERENCE.encode_ordinary(d.text)
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_nulls_extra_columns_and_no_rows(spark):
    path = public_tokenizers.path(bpe.VOCABULARY)
    docs = spark.createDataFrame([(1, None, "x"), (2, "", None), (2, "", None)], "doc_id long, text string, n_tokens string")
    out = bpe.digests(docs, path, public_tokenizers.PATTERN).collect()
    assert [r.n_tokens for r in out] == [0, 0, 0]
    assert bpe.digests(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0
    assert [bytes(r.decoded) for r in bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect()] == [b"", b"", b""]
    assert base64.b64encode(CODEC.decode([RANKS[b"a"]])) == b"YQ=="


def test_position_of_files_with_a_column_of_their_metadata_s_name(spark, tmp_path):
    docs = spark.range(5).selectExpr("id AS doc_id", "'a' AS source", "'en' AS lang", "'text' AS text", "1 AS _metadata")
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    out = bpe.stage(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()
    assert sorted((r.doc_id, r.position) for r in out) == [(k, k) for k in range(5)]
    assert {r.position for r in bpe.stage(spark, docs, "").collect()} == {None}
