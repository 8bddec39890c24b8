"""Declared versions of packages, from requirement and lock files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: names of files that declare packages
MANIFEST = r"(^|/)(requirements[^/]*\.txt|pyproject\.toml|setup\.cfg|Pipfile|Pipfile\.lock|poetry\.lock|uv\.lock|pdm\.lock)$"
LINE = r"""(?m)^[\s"',]*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?["']?\s*(?:=\s*)?["']?\s*((?:===|==|~=|>=|<=|!=|>|<|\^)\s*[0-9][^"'\s;#]*)"""


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the manifests under ``root``."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.where(F.col("path").rlike(MANIFEST))


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def declarations(manifests: DataFrame) -> DataFrame:
    """(package, spec): each declared requirement of ``manifests`` (text)."""
    rows = manifests.select(F.explode(F.regexp_extract_all("text", F.lit(LINE), F.lit(0))).alias("line"))
    return rows.select(normal_name(F.regexp_extract("line", LINE, 1)).alias("package"), F.regexp_replace(F.regexp_extract("line", LINE, 2), r"\s", "").alias("spec")).where("package <> ''").distinct()


def minimum(spec: Column) -> Column:
    """(major, minor) that a requirement starts at: the largest lower bound of its parts; null if it has none."""
    bounds = F.filter(F.transform(F.split(spec, ","), lambda p: F.struct(F.regexp_extract(p, r"^(===|==|~=|>=|>|\^)", 1).alias("op"), F.regexp_extract(p, r"^[=~<>!^]+v?(\d+)", 1).alias("major"), F.regexp_extract(p, r"^[=~<>!^]+v?\d+\.(\d+)", 1).alias("minor"))), lambda b: (b["op"] != "") & (b["major"] != ""))
    return F.array_max(F.transform(bounds, lambda b: F.struct(b["major"].cast("int").alias("major"), F.coalesce(F.nullif(b["minor"], F.lit("")).cast("int"), F.lit(0)).alias("minor"))))


def minimums(declared: DataFrame) -> DataFrame:
    """(package, major, minor): the least start of all of a package's requirements; null if one of them has none."""
    rows = declared.withColumn("m", minimum(F.col("spec")))
    low = rows.groupBy("package").agg(F.min("m").alias("m"), F.bool_and(F.col("m").isNotNull()).alias("known"))
    return low.select("package", F.when(F.col("known"), F.col("m.major")).alias("major"), F.when(F.col("known"), F.col("m.minor")).alias("minor"))
