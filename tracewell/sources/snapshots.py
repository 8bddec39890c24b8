"""Snapshots of a file tree: of a folder, or of a commit through git, as rows of path and content."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracewell.operators.change import git_blob_id, is_analyzed

# fixed values: bounds of a capture
MOST_FILES, MOST_FILE_BYTES, MOST_BYTES = 20_000, 4 * 2**20, 128 * 2**20
BATCH = 200


class CaptureError(ValueError):
    """A capture would be larger than it may be."""


def folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, identity) of the analysed files under ``root``; links aren't followed out of it by Spark's reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "^(file:/*)?/?" + root.strip("/").replace(".", r"\.") + "/"
    rows = files.where(F.col("length") <= MOST_FILE_BYTES).select(F.regexp_replace("path", base, "").alias("path"), "content", "length").where(is_analyzed(F.col("path")))
    checked(rows.agg(F.count("*").alias("n"), F.sum("length").alias("b")).first())
    return rows.select("path", "content", git_blob_id(F.col("content")).alias("identity"))


def checked(totals) -> None:
    if totals.n > MOST_FILES or (totals.b or 0) > MOST_BYTES:
        raise CaptureError(f"{totals.n} files of {totals.b} bytes")


def _git(repository: str, *args: str, given: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repository, "-c", "core.fsmonitor=false", *args], check=True, capture_output=True, input=given, timeout=300).stdout


class _Batch(InputPartition):
    def __init__(self, rows: list[tuple[str, str]]):
        super().__init__(0)
        self.rows = rows


class _CommitReader(DataSourceReader):
    def __init__(self, options):
        self.repository, self.revision = options["path"], options.get("revision", "HEAD")

    def partitions(self):
        """One listing of the commit; blobs are read in batches by the tasks."""
        rows = []
        for entry in _git(self.repository, "ls-tree", "-r", "-z", "--full-tree", self.revision).split(b"\0"):
            head, _, path = entry.partition(b"\t")
            mode, kind, blob = (head.decode().split() + ["", "", ""])[:3]
            if kind == "blob" and mode in ("100644", "100755"):
                rows.append((path.decode("utf-8", "replace"), blob))
        return [_Batch(rows[i : i + BATCH]) for i in range(0, len(rows), BATCH)] or [_Batch([])]

    def read(self, partition):
        answer = _git(self.repository, "cat-file", "--batch", given="".join(f"{b}\n" for _, b in partition.rows).encode()) if partition.rows else b""
        at = 0
        for path, blob in partition.rows:
            stop = answer.index(b"\n", at)
            size = int(answer[at:stop].split()[2])
            yield path, answer[stop + 1 : stop + 1 + size], blob
            at = stop + size + 2


class GitCommit(DataSource):
    """spark.read.format("git_commit").option("revision", ...).load(repository): (path, content, identity) of a commit's files."""

    @classmethod
    def name(cls) -> str:
        return "git_commit"

    def schema(self) -> str:
        return "path string, content binary, identity string"

    def reader(self, schema):
        return _CommitReader(self.options)


def commit(spark: SparkSession, repository: str, revision: str = "HEAD") -> DataFrame:
    """(path, content, identity) of the analysed files of a commit; the repository must be readable by the tasks."""
    spark.dataSource.register(GitCommit)
    return spark.read.format("git_commit").option("revision", revision).load(repository).where(is_analyzed(F.col("path")))
