"""Secret scans with corpus-wide ownership frequency.

Three kinds of candidates are found in every whole text: assignments to a secret's name, access key ids, and long runs of
hexadecimal digits. Each candidate's value is hashed, and over the whole corpus each hash is counted by the distinct
repositories and the distinct owners that hold it. A value that several owners share is a widely copied example; one
that a single owner holds is live-looking. Spans are kept either way; the counts say which are which. Where a live-looking value stands elsewhere without a name before it, as a word by itself in any text of the
corpus, that place is a span too, of kind ``copy``: words that could be one (ECHO, with a digit, outside base spans) are joined to the live values by hash.

All of it is DataFrame functions: the text between matches (split) and the matches themselves give each span's place.

Here a document is its own repository and ``source`` is its owner; both are parameters.

Defined cases: a null text is taken as empty: no spans, the hash of the empty string. A null owner counts as one owner of
its own. Repeated rows each get a row; as they share repository and owner, they don't make a value copied. Equal starts
go by kind in the order assign, access, hex, copy. A live value with other characters than ECHO's, without a digit or shorter is looked for nowhere else, as it may be a word of the language. Texts are taken whole; other columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# fixed values: the kinds in order, each with its pattern, the group that is the value, and the least characters of it
KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
# what a text must hold for a kind to be looked for: cheaper to find, and never missing where the kind is found
HINTS = {"assign": "[:=]", "access": "AKIA", "hex": "[0-9a-f]{24}"}
ECHO = ("copy", r"[A-Za-z0-9+/_-]+", 0, 12)  # what stands elsewhere: as KINDS
HINTS["copy"] = "[A-Za-z0-9+/_-]{12}"
MOST_OWNERS = 1  # owners of a live-looking value, at most
CHUNK = 128  # spans that are gathered before they go to the others of their text
SALTS = 16  # tasks that the holders of one copied value are dealt over
MASK = "********"
COPIES = 3  # repositories from which a value that several owners share counts as widely copied


def quick(pattern: str, group: int, least: int) -> str:
    """The pattern in a form that is quicker and leaves the same matches.

    Possessive repetition is safe, as nothing follows that could want a character back. Where the whole match is the
    value, it is a run that can't start later and be longer, so the least length can stand in the pattern.
    """
    if group == 0:
        fixed = len(re.sub(r"\[[^]]*\]\+$", "", pattern))
        return f"{pattern[:-1]}{{{least - fixed},}}+"
    return pattern.replace("]+", "]++")


SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_chunks(items: Column, state: Column, step, kind: str) -> Column:
    """All that ``step(state, item)`` makes, a (next state, array of ``kind``) for each item in order.

    Arrays grow chunk by chunk, so the work stays near linear in the items: appending to one array would copy it for each.
    """

    def one(s: Column, x: Column) -> Column:
        return _bound(step(s["state"], x), lambda made: F.struct(made["state"].alias("state"), F.concat(s["out"], made["out"]).alias("out")))

    def chunk(s: Column, part: Column) -> Column:
        start = F.struct(s["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return _bound(F.aggregate(part, start, one), lambda made: F.struct(made["state"].alias("state"), F.array_append(s["out"], made["out"]).alias("out")))

    def whole(all_items: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / CHUNK).cast("int")), lambda i: F.slice(all_items, i * CHUNK + 1, F.lit(CHUNK)))
        start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(all_items) > 0, F.flatten(F.aggregate(parts, start, chunk, lambda s: s["out"]))).otherwise(F.array().cast(f"array<{kind}>"))

    return _bound(items, whole)


def _spans(text: Column, rank: int, name: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind: (start, rank, end, kind, value), start and end in code points."""
    pattern = quick(pattern, group, least)
    whole, value = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast(f"array<{SPAN}>")

    def step(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        end = start + F.length(x["whole"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(name).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("state"), F.when(F.length(x["value"]) >= least, F.array(one).cast(f"array<{SPAN}>")).otherwise(empty).alias("out"))

    # zipped, so that each array is made once; there is one gap more than matches
    rows = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")), lambda x: x["whole"].isNotNull())
    return F.when(text.rlike(HINTS[name]) & text.rlike(pattern), _in_chunks(rows, F.lit(0), step, SPAN)).otherwise(empty)


def _echoes(text: Column, found: Column) -> Column:
    """Words that could be a secret's other place: runs of ECHO's characters with a digit that no base span touches."""
    runs = F.filter(_spans(text, len(KINDS), *ECHO), lambda x: x["value"].rlike("[0-9]"))
    none, base = F.array().cast(f"array<{SPAN}>"), lambda x: x["rank"] < len(KINDS)

    def ahead(at: Column, x: Column) -> Column:  # at: the last end of base spans that start before
        return F.struct(F.when(base(x), F.greatest(at, x["end"])).otherwise(at).alias("state"), F.when(base(x) | (x["start"] >= at), F.array(x)).otherwise(none).alias("out"))

    def back(at: Column, x: Column) -> Column:  # at: the first start of base spans that start later
        return F.struct(F.when(base(x), F.least(at, x["start"])).otherwise(at).alias("state"), F.when(~base(x) & (x["end"] <= at), F.array(x)).otherwise(none).alias("out"))

    def apart(some: Column) -> Column:
        both = _in_chunks(F.array_sort(F.concat(found, some)), F.lit(0), ahead, SPAN)
        return F.when(F.size(some) > 0, _in_chunks(F.reverse(both), F.lit(2**31 - 1), back, SPAN)).otherwise(none)

    return _bound(runs, apart)


def scan(docs: DataFrame, text: str = "text", owner: str = "source", key: str | None = None, echoes: bool = False) -> DataFrame:
    """(doc_id, owner, row, found) of every row, and ``key`` and ``echo`` if asked for: ``found`` has the base spans in order, ``echo`` words that may be values. Holds no texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.array_sort(F.concat(*(_spans(body, k, *kind) for k, kind in enumerate(KINDS))))
    rows = docs.select("doc_id", F.col(owner).alias("owner"), F.monotonically_increasing_id().alias("row"), found.alias("found"), *([F.col(key).alias("key")] if key else []), *([body.alias("body")] if echoes else []))
    return rows.withColumn("echo", _echoes(F.col("body"), F.col("found"))).drop("body") if echoes else rows


def echoed(scanned: DataFrame, most_owners: int = MOST_OWNERS, copies: int = COPIES) -> DataFrame:
    """(row, more): the words of each row that are a live-looking value of the corpus. Holders of one value are dealt over tasks by salt; a value stands SALTS times."""
    hits = scanned.where(F.size("found") > 0).select("doc_id", "owner", F.explode("found").alias("s")).where(F.col("s.value").rlike(f"^{ECHO[1]}$") & F.col("s.value").rlike("[0-9]") & (F.length("s.value") >= ECHO[3]))
    known = ownership(hits.select("doc_id", "owner", F.sha2(F.col("s.value"), 256).alias("hash")))
    live = known.where(~((F.col("owners") > most_owners) & (F.col("repositories") >= copies))).select("hash", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    words = scanned.where(F.size("echo") > 0).select("row", F.explode("echo").alias("s")).withColumn("hash", F.sha2(F.col("s.value"), 256)).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    return words.join(live, ["hash", "salt"], "left_semi").groupBy("row").agg(F.collect_list("s").alias("more"))


def ownership(hits: DataFrame) -> DataFrame:
    """(value hash, repositories, owners) over the corpus, from (hash, repository, owner) rows.

    Distinct first, then counted, both with partial sums before the shuffle: a value that a third of all rows hold
    is one row from each task.
    """
    owners = hits.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("owners"))
    repositories = hits.groupBy("hash", "doc_id").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("repositories"))
    return owners.join(repositories, "hash")


def classify(scanned: DataFrame, most_owners: int = MOST_OWNERS, copies: int = COPIES) -> DataFrame:
    """(row, n_live, n_copied, live_spans) of the rows that have a candidate."""
    hits = scanned.where(F.size("found") > 0).select("row", "doc_id", "owner", F.explode("found").alias("s")).withColumn("hash", F.sha2(F.col("s.value"), 256))
    known = ownership(hits)
    # values that aren't copied need no row; those that are may have very many holders, so each stands SALTS times
    copies_of = known.where((F.col("owners") > most_owners) & (F.col("repositories") >= copies)).select("hash", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(True).alias("copied"))
    joined = hits.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(copies_of, ["hash", "salt"], "left")
    copied = F.coalesce("copied", F.lit(False))
    live = F.sort_array(F.collect_list(F.when(~copied, F.struct("s.start", "s.rank", "s.end", "s.kind", F.length("s.value").alias("size")))))  # spans of one document
    return joined.groupBy("row").agg(F.sum((~copied).cast("long")).alias("n_live"), F.sum(copied.cast("long")).alias("n_copied"), live.alias("live"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Spans of each row and how many of them are live-looking or copied."""
    scanned = common.materialize(scan(docs, echoes=True), "secrets")  # ids of rows stay as they are from here on
    told = scanned.drop("echo").join(classify(scanned), "row", "left").join(echoed(scanned), "row", "left")
    more = F.coalesce("more", F.array().cast(f"array<{SPAN}>"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return told.select(
        "doc_id",
        *(count(k[0]).alias(f"n_{k[0]}") for k in KINDS),
        F.sha2(_joined(F.col("found")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("found", more))).alias("spans"),
        F.size(more).cast("long").alias("n_copy"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce(_joined(F.col("live")), F.lit("")).alias("live_spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.read(spark, sf_dir, "documents"))


def struck(text: Column, live: Column) -> Column:
    """``text`` with eight asterisks for each value of ``live`` (start, rank, end, kind, size; by start). Overlapping values are struck once."""
    pieces = "struct<lead:string,at:int>"

    def part(base: Column, chunk: Column) -> Column:
        """Pieces of a chunk's stretch of text, from ``base`` on: short strings are cut, not the whole text each time."""
        last = F.array_max(F.transform(chunk, lambda x: x["end"]))

        def cut(stretch: Column) -> Column:
            def one(s: Column, x: Column) -> Column:
                start = F.greatest(x["end"] - x["size"], s["at"])
                made = F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(F.concat(stretch.substr(s["at"] - base + 1, start - s["at"]), F.lit(MASK)))).alias("out"))
                return F.when(x["end"] <= s["at"], s).otherwise(made)

            start = F.struct(base.alias("at"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(chunk, start, one, lambda s: F.struct(F.array_join(s["out"], "").alias("lead"), s["at"].alias("at")))

        return _bound(text.substr(base + 1, F.greatest(last - base, F.lit(0))), cut)

    def chunked(spans: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")), lambda i: F.slice(spans, i * CHUNK + 1, F.lit(CHUNK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{pieces}>").alias("out"))

        def step(s: Column, chunk: Column) -> Column:
            return _bound(part(s["at"], chunk), lambda p: F.struct(p["at"].alias("at"), F.array_append(s["out"], p).alias("out")))

        return F.aggregate(parts, start, step, lambda s: F.concat(F.array_join(F.transform(s["out"], lambda p: p["lead"]), ""), text.substr(s["at"] + 1, F.length(text))))

    return F.when(F.size(live) > 0, _bound(live, chunked)).otherwise(text)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each live-looking value struck out (eight asterisks stand for it), and n_chars to match. No document goes.

    Only documents that hold a candidate are shuffled, to be joined with their live spans by id and text hash (rows alike in
    both are struck alike); all others pass straight through. Columns of any names pass, as they travel in a struct of their own.
    """
    body, holds = F.coalesce(F.col("text"), F.lit("")), F.lit(False)
    for name, *rest in KINDS:
        holds = holds | (body.rlike(HINTS[name]) & body.rlike(quick(*rest)))
    some = docs.where(holds).select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("body"))
    narrow = some.select(F.col("id").alias("doc_id"), F.col("doc.text").alias("text"), F.col("doc.source").alias("owner"), F.col("body").alias("key"))
    scanned = common.materialize(scan(narrow, owner="owner", key="key"), "secrets-stage")
    live = classify(scanned).where("n_live > 0").join(scanned.select("row", "doc_id", "key"), "row")
    live = live.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.min("live").alias("live"))
    changed = some.join(live, F.col("id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_key")), "left")
    new = F.when(F.col("live").isNull(), F.col("doc.text")).otherwise(struck(F.col("doc.text"), F.col("live")))
    changed = changed.select("doc", "live", new.alias("new"))
    made = {"text": F.col("new"), "n_chars": F.when(F.col("live").isNull(), F.col("doc.n_chars")).otherwise(F.length("new")) if "n_chars" in docs.columns else None}
    out = [made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return docs.where(~holds).unionByName(changed.select(*out))


def _oracle() -> str:
    """The same rows in DuckDB SQL."""
    parts = []
    for k, (name, pattern, group, least) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        parts.append(f"""
  {name}_m AS (SELECT doc_id, rid, source, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS whole, regexp_extract_all(t, '{p}', {group}) AS value FROM d WHERE regexp_matches(t, '{p}')),
  {name}_i AS (SELECT doc_id, rid, source, gaps, whole, value, unnest(range(1, len(whole) + 1)) AS i FROM {name}_m),
  {name}_s AS (SELECT doc_id, rid, source, {k} AS rank, '{name}' AS kind, value[i] AS value,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS s, length(whole[i]) AS n FROM {name}_i WHERE length(value[i]) >= {least})""")
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, source, coalesce(text, '') AS t FROM documents),{','.join(parts)},
  hits AS ({' UNION ALL '.join(f'SELECT doc_id, rid, source, rank, kind, value, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM {k[0]}_s' for k in KINDS)}),
  known AS (SELECT value, count(DISTINCT coalesce(source, '-null-')) AS owners, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '-null-')) AS repositories FROM hits GROUP BY value),
  told AS (SELECT hits.*, (owners > {MOST_OWNERS} AND repositories >= {COPIES}) AS copied FROM hits JOIN known USING (value)),
  live AS (SELECT DISTINCT value FROM told WHERE NOT copied AND regexp_full_match(value, '{ECHO[1]}') AND regexp_matches(value, '[0-9]') AND length(value) >= {ECHO[3]}),
  echo_m AS (SELECT rid, regexp_split_to_array(t, '{ECHO[1]}') AS gaps, regexp_extract_all(t, '{ECHO[1]}') AS whole FROM d WHERE regexp_matches(t, '{HINTS["copy"]}')),
  echo_i AS (SELECT rid, whole[i] AS value, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM echo_m) WHERE whole[i] IN (SELECT value FROM live)),
  echo AS (SELECT rid, s, s + length(value) AS e FROM echo_i x WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.rid = x.rid AND h.s < x.s + length(x.value) AND x.s < h.e)),
  every AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, count(*) FILTER (kind = 'copy') AS n_copy FROM (SELECT rid, kind, s, e, rank FROM hits UNION ALL SELECT rid, 'copy', s, e, {len(KINDS)} FROM echo) GROUP BY rid),
  agg AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (NOT copied), '') AS live_spans FROM told GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(agg.spans, '')) AS base_sha256, coalesce(every.spans, '') AS spans, coalesce(n_copy, 0) AS n_copy,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(live_spans, '') AS live_spans
FROM d LEFT JOIN agg USING (rid) LEFT JOIN every USING (rid)"""


ORACLE_SQL = _oracle()
