import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_jaccard_join import brute
from tests.llm.test_mixing import earliest_deadline_first, parts
from tracewell.llm import bpe, mixing, secret_scan


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = stages[0](spark, docs, sf)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if re.search(r"[^\W\d_]", r.text)}
    one = stages[1](spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == {int(i) for i, _, c in brute([(i, r.text) for i, r in rows.items()], 5, 80) if i == c}
    struck = {r.doc_id: r for r in stages[2](spark, docs, sf).collect()}
    live = {r.doc_id: r.live_spans for r in secret_scan.report(docs).collect()}
    assert struck.keys() == rows.keys()
    for i, r in struck.items():
        assert (r.text == rows[i].text) == (not live[i]) and r.n_chars == (len(r.text) if live[i] else rows[i].n_chars)
    assert {r.doc_id for r in stages[3](spark, docs, sf).collect()} == rows.keys()


def test_run_is_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    near = {int(i) for i, _, c in brute([(i, r.text) for i, r in rows.items()], 5, 80) if i == c}
    live = {r.doc_id for r in secret_scan.report(spark.createDataFrame([(i, rows[i].source, rows[i].text) for i in sorted(near)], "doc_id long, source string, text string")).collect() if r.live_spans}
    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    got = {r.doc_id: r for r in out.collect()}
    assert got.keys() == near
    for i, r in got.items():
        if i not in live:
            assert r.n_tokens == len(encoding.encode_ordinary(rows[i].text)) and r.source == rows[i].source


def test_mixture_reaches_the_result(spark, tmp_path, monkeypatch):
    sizes = {"a": 700, "b": 260, "c": 90}
    rows = [(k, f"word {k}", "en", s, 8) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    # the schedule by plain Python: ranks by hash within a source, blocks by earliest deadline first
    ranked = {s: sorted((r[0] for r in rows if r[3] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for s in sizes}
    want = []
    for _, k, j in earliest_deadline_first(parts([n**0.5 for n in sizes.values()]), [-(-n // mixing.BLOCK) for n in sizes.values()]):
        want += ranked["abc"[k]][j * mixing.BLOCK : (j + 1) * mixing.BLOCK]
    path = f"{tmp_path}/mixed"
    mixed = mixing.mix(docs).repartitionByRange(5, "mix_pos").sortWithinPartitions("mix_pos").select(*docs.columns)
    mixed.write.parquet(path)
    out = bpe.stage(spark, spark.read.parquet(path), "").collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.position)] == want and sorted(r.position for r in out) == list(range(1050))
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    run = corpus_pipeline.run(spark, f"{tmp_path}/in").collect()
    assert [r.doc_id for r in sorted(run, key=lambda r: r.position)] == want
