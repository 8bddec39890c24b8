import json
import subprocess

import pytest

from tracewell.operators import change
from tracewell.sources import documents, roots, snapshots, wrappers
from tracewell.streaming import file_versions


def test_git_and_folder_snapshots(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_text("y = 1\n")
    (tmp_path / "notes.txt").write_text("no\n")
    git("add", ".")
    git("commit", "-qm", "one")
    before = snapshots.commit(spark, str(tmp_path))
    rows = {r.path: r for r in before.collect()}
    assert rows.keys() == {"pkg/a.py", "b.py"} and bytes(rows["b.py"].content) == b"y = 1\n"
    assert rows["b.py"].identity == git("rev-parse", "HEAD:b.py").strip()
    (tmp_path / "b.py").rename(tmp_path / "c.py")
    (tmp_path / "pkg" / "a.py").write_text("x = 2\n")
    work = spark.createDataFrame([(p, bytearray((tmp_path / p).read_bytes())) for p in ("c.py", "pkg/a.py")], "path string, content binary").select("path", change.git_blob_id(snapshots.F.col("content")).alias("identity"))
    got = {(r.path, r.status, r.rename_from) for r in change.changed_files(before, work).collect()}
    assert got == {("c.py", "added", "b.py"), ("b.py", "deleted", None), ("pkg/a.py", "modified", None)}
    folder = {r.path for r in snapshots.folder(spark, str(tmp_path / "pkg")).collect()}
    assert folder == {"a.py"}


def test_roots(spark, tmp_path):
    (tmp_path / "ids.json").write_text(json.dumps(["b", "a", "c"]))
    (tmp_path / "doc.json").write_text(json.dumps({"facts": [{"symbol": {"usr": "z"}}, {"symbol": {}}, {"symbol": {"usr": "a"}}]}))
    ids = lambda *a: [r.id for r in roots.collect_roots(spark, *a).orderBy("root_idx").collect()]
    assert ids(["a", "x", "a"], str(tmp_path / "ids.json")) == ["a", "x", "b", "c"]
    assert ids([], str(tmp_path / "doc.json")) == ["z", "a"]
    for bad in ([], ["ok", ""], ["a\nb"]):
        with pytest.raises(roots.RootError):
            roots.collect_roots(spark, bad)


def test_wrappers(spark, tmp_path):
    good = tmp_path / "w.json"
    good.write_text(json.dumps({"wrappers": [{"language": "python", "kind": "function", "name": "fetch", "pathArg": {"index": 0}, "methodEnum": {"G": "GET"}}]}))
    row = wrappers.load_wrappers(spark, str(good)).first()
    assert row.name == "fetch" and row.pathArg["index"] == 0 and row.methodEnum == {"G": "GET"}
    bad = tmp_path / "b.json"
    bad.write_text(json.dumps({"wrappers": [{"name": "x", "pathArg": {"index": 0}, "what": 1}]}))
    with pytest.raises(wrappers.WrapperError):
        wrappers.load_wrappers(spark, str(bad))


def test_documents(spark, tmp_path):
    rows = spark.createDataFrame([("/b", "GET", 2), ("/a", "GET", 1), ("/a", "GET", 1), (None, "ANY", 3)], "channel string, method string, line int")
    documents.write_facts(rows, str(tmp_path / "out"), "channel", "method", "line")
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == [{"line": 3, "method": "ANY"}, {"channel": "/a", "line": 1, "method": "GET"}, {"channel": "/b", "line": 2, "method": "GET"}]
    with pytest.raises(documents.LimitError):
        documents.write_facts(rows, str(tmp_path / "no"), "channel", longest=10)
    digest = lambda d: documents.graph_digest(d, rows).first().digest
    assert digest(rows) == digest(rows.orderBy("line")) != digest(rows.limit(1))
    assert change.content_digest(spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "path string, content binary")).first().digest != change.content_digest(spark.createDataFrame([("a", bytearray(b"2")), ("b", bytearray(b"1"))], "path string, content binary")).first().digest


def test_stream_of_versions(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    put = lambda rows: spark.createDataFrame(rows, file_versions.SHAPE).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: file_versions.follow(spark.readStream.schema(file_versions.SHAPE).parquet(source), folder).awaitTermination()
    put([("a", "1", 1), ("b", "1", 1), ("a", "2", 2)])
    stream()
    put([("a", "2", 3), ("b", None, 3), ("c", "9", 3)])
    stream()
    got = {(r.path, r.identity, r.status) for r in file_versions.state(spark, folder).collect()}
    assert got == {("a", "2", "added"), ("b", "1", "added"), ("b", None, "deleted"), ("c", "9", "added")}
