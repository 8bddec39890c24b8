"""Declarations of HTTP wrapper functions, read with a strict schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARGUMENT = "struct<index:int,label:string>"
SCHEMA = f"language string, kind string, owner string, name string, methodArg {ARGUMENT}, pathArg {ARGUMENT}, defaultMethod string, methodEnum map<string,string>, pathAnchor string, service string"
MOST = 10_000  # fixed value


class WrapperError(ValueError):
    """A declaration file can't be used."""


def load_wrappers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each declaration; a field that isn't known, a value of another type or a row without name or pathArg is an error."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.from_json("value", f"wrappers array<struct<{', '.join(':'.join(c.split(' ', 1)) for c in SCHEMA.split(', '))}>>", {"mode": "FAILFAST"})["wrappers"].alias("w")).select(F.explode("w").alias("w")).select("w.*")
    keys = text.select(F.explode(F.from_json("value", "wrappers array<map<string,string>>")["wrappers"]).alias("m")).select(F.explode(F.map_keys("m")).alias("key")).distinct()
    known = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    unknown = keys.where(~F.col("key").isin(*known)).limit(1).collect()
    if unknown:
        raise WrapperError(f"unknown field {unknown[0].key}")
    found = rows.agg(F.count("*").alias("n"), F.sum((F.col("name").isNull() | F.col("pathArg").isNull()).cast("int")).alias("bad")).first()
    if found.n > MOST or found.bad:
        raise WrapperError("too many declarations" if found.n > MOST else "a declaration lacks name or pathArg")
    return rows
