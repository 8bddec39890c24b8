"""Relation names in SQL text, as windows over a table of tokens.

A text becomes rows of tokens (strings and comments go); statements are running counts of semicolons, parentheses give each token its
innermost group, and a relation stands where a group goes on after a keyword that asks for one, or after a comma of its list.
Texts are independent, so all windows are by text. Texts are dealt by id once, in so many partitions that each holds a bounded length of text,
however many there are: a row of a token is wide, and partitions that are joined by the bytes of a shuffle would be large in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: words by what they do
CLAUSE = "where set on group order by having limit offset union intersect except values returning as left right inner outer full cross natural lateral using and or not null select insert delete from join into update truncate with for in is case when then else end distinct asc desc if exists only between like to grant revoke option cascade restrict privileges the an".split()
TABLE_VERBS = "alter drop create truncate rename lock unlock describe desc analyze vacuum".split()
INTO_VERBS = "insert select merge replace".split()
CREATE_ON = "index trigger policy".split()
PRIVILEGES = "select insert update delete truncate references trigger execute usage create connect temporary temp maintain all".split()
GRANT_TABLES = "table tables view materialized".split()
GRANT_OTHERS = "all sequence schema database domain type function procedure routine foreign server wrapper language large publication subscription statistics tablespace collation conversion extension aggregate operator policy cast fdw parser template dictionary configuration".split()
MODIFIERS = "only if not exists".split()
SUBQUERY = "select with values".split()

VERBS = "select insert delete create alter drop replace merge lock unlock rename describe desc analyze vacuum grant revoke".split()
HEAD_VERBS = ("update", "truncate")

TOKEN = r"""--[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|'(?:[^'\\]++|''|\\(?s:.))*+'?|"[^"]*+"?|`[^`]*+`?|\[[^\]]*+\]?|[\p{L}_][\p{L}\p{N}_$]*+|[.,();{}$?:@]"""


PER_TASK = 1 << 17  # characters of texts for each partition, about


def dealt(texts: DataFrame) -> DataFrame:
    """``texts`` (id, sql) by id, in partitions of about PER_TASK characters."""
    total = texts.agg(F.sum(F.length("sql") + 16)).first()[0] or 0
    return texts.select("id", "sql").repartition(1 + total // PER_TASK, "id")


def tokens(texts: DataFrame) -> DataFrame:
    """(id, pos, text, quoted, word): tokens of ``texts`` (id, sql) that aren't strings or comments; word is lower-cased, of plain names only."""
    found = texts.select("id", F.posexplode(F.filter(F.regexp_extract_all("sql", F.lit(TOKEN), F.lit(0)), lambda t: ~(t.startswith("--") | t.startswith("/*") | t.startswith("'")))).alias("pos", "raw"))
    quoted = F.substring("raw", 1, 1).isin('"', "`", "[")
    inner = F.regexp_replace(F.substring("raw", F.lit(2), F.length("raw")), r'["`\]]$', "")
    plain = ~quoted & F.col("raw").rlike(r"^[\p{L}_]")
    return found.select("id", "pos", F.when(quoted, inner).otherwise(F.col("raw")).alias("text"), quoted.alias("quoted"), F.when(plain, F.lower("raw")).alias("word"))


def looks_like_sql(text: Column, strict: bool = False) -> Column:
    """True if a text holds a verb that opens statements; update and truncate count as its first word alone. ``strict``: in upper case alone. Null gives null."""
    words = F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: t.rlike(r"^[\p{L}_]"))
    loud = lambda w: (w == F.upper(w)) if strict else F.lit(True)
    head = F.get(words, F.lit(0))
    return F.exists(words, lambda w: F.lower(w).isin(*VERBS) & loud(w)) | F.coalesce(F.lower(head).isin(*HEAD_VERBS) & loud(head), F.lit(False))


def relations(texts: DataFrame, strict: bool = False) -> DataFrame:
    """(id, name): relations that each text (id, sql) names. ``strict``: keywords count in upper case alone.

    Tokens are told once, and all that follows is windows within a text: no row is dealt again, and no table of tokens is joined with itself.
    """
    by_id = Window.partitionBy("id").orderBy("pos")
    t = tokens(dealt(texts))
    symbol = lambda s: ~F.col("quoted") & (F.col("text") == s)
    loud = (F.col("text") == F.upper("text")) if strict else F.lit(True)
    t = t.withColumn("key", F.when(F.col("word").isNotNull() & loud, F.col("word")))
    beside = F.struct("text", "quoted", "word")
    sides = {(f"p{-k}" if k < 0 else f"n{k}"): (F.lead(beside, k) if k > 0 else F.lag(beside, -k)).over(by_id) for k in (-3, -2, -1, 1, 2, 3, 4, 5)}
    before = by_id.rowsBetween(Window.unboundedPreceding, -1)
    stmt = F.coalesce(F.sum(symbol(";").cast("int")).over(before), F.lit(0))
    name_before = F.last(F.when(F.col("word").isNotNull(), F.coalesce("key", F.lit(""))), ignorenulls=True).over(before)
    t = t.select("*", stmt.alias("stmt"), name_before.alias("name_before"), *(c.alias(side) for side, c in sides.items()))
    near = lambda side, *words: F.coalesce(F.col(f"{side}.word").isin(*words), F.lit(False))
    mark = lambda side, s: F.coalesce(~F.col(f"{side}.quoted") & (F.col(f"{side}.text") == s), F.lit(False))

    def fine(side: str) -> Column:
        return F.coalesce(F.when(F.col(f"{side}.quoted"), F.lit(True)).otherwise(F.col(f"{side}.word").isNotNull() & ~near(side, *CLAUSE)), F.lit(False))

    # all that neighbours tell, so that they go no further: the name that starts here, if a relation does
    escaped = lambda text, quoted: F.when(quoted, F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("."), F.lit("%2E"))).otherwise(F.replace(text, F.lit("%"), F.lit("%25")))
    two = mark("n1", ".") & fine("n2")
    three = two & mark("n3", ".") & fine("n4")
    part = lambda side: F.concat(F.lit("."), escaped(F.col(f"{side}.text"), F.col(f"{side}.quoted")))
    name = F.concat(escaped(F.col("text"), F.col("quoted")), F.when(two, part("n2")).otherwise(F.lit("")), F.when(three, part("n4")).otherwise(F.lit("")))
    called = F.when(three, mark("n5", "(")).when(two, mark("n3", "(")).otherwise(mark("n1", "("))
    # common table expressions: the name before AS [NOT] [MATERIALIZED] (, or before its column list
    has_body = mark("n1", "(") | (near("n1", "materialized") & mark("n2", "(")) | (near("n1", "not") & near("n2", "materialized") & mark("n3", "(")) | (near("n1", "not") & mark("n2", "("))
    before_it = F.when(F.col("p1.quoted"), F.col("p1.text")).otherwise(F.col("p1.word"))
    listed = mark("p2", ",") | near("p2", "with") | (near("p2", "recursive") & near("p3", "with"))
    label = mark("n1", ":") & ~mark("n2", ":")
    t = t.select(
        "id", "pos", "text", "quoted", "word", "key", "stmt", "name_before",
        name.alias("name"), called.alias("called"), (~two).alias("alone"),
        ((F.col("word") == "as") & has_body).alias("makes"), mark("p1", ")").alias("after_list"), F.when(listed & (before_it != ""), before_it).alias("cte"),
        # groups that hold a function's arguments: a FROM in them names no relation
        (symbol("(") & F.col("p1.word").isNotNull() & ~near("p1", *CLAUSE) & ~near("n1", *SUBQUERY)).alias("calls"),
        F.when(symbol("(") & near("p1", "materialized"), F.when(near("p2", "as"), 2).when(near("p2", "not") & near("p3", "as"), 3)).alias("made_by"),
        (near("p1", "distinct") & (near("p2", "is") | (near("p2", "not") & near("p3", "is")))).alias("distinct_from"),
        near("p1", "truncate").alias("truncates"), near("p1", "on", *GRANT_TABLES).alias("after_on"),
        F.when(F.col("word").isNotNull() & ~label, F.col("pos")).alias("name_pos"),
    )

    # head of each statement: its first name that is no label
    in_stmt = Window.partitionBy("id", "stmt").orderBy("pos")
    whole = Window.partitionBy("id", "stmt")
    seen = lambda words: F.coalesce(F.max(F.when(F.col("key").isin(*words), 1)).over(in_stmt.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    t = t.withColumn("level", F.sum(F.when(symbol("("), 1).when(symbol(")"), -1).otherwise(0)).over(in_stmt) + F.when(symbol(")"), 1).otherwise(0))
    t = t.withColumn("after_into", seen(INTO_VERBS)).withColumn("after_privilege", seen(PRIVILEGES)).withColumn("after_kind", seen(CREATE_ON))
    t = t.withColumn("head", F.min("name_pos").over(whole)).withColumn("last_set", F.max(F.when(F.col("key") == "set", F.col("pos"))).over(whole))
    t = t.withColumn("verb", F.max(F.when(F.col("pos") == F.col("head"), F.col("key"))).over(whole)).drop("name_pos")

    # parentheses belong to the group outside for this, so those of a list of columns stand side by side
    t = t.withColumn("place", F.when(symbol("(") | symbol(")"), F.col("level") - 1).otherwise(F.col("level")))
    at_place = Window.partitionBy("id", "stmt", "place").orderBy("pos")
    of_list = F.when(F.col("level") >= 0, F.lag("cte", 2).over(at_place))
    t = t.withColumn("cte", F.when(F.col("makes"), F.when(F.col("after_list"), of_list).otherwise(F.col("cte"))))
    made = F.when(F.col("made_by") == 2, F.lag("cte", 2).over(at_place)).when(F.col("made_by") == 3, F.lag("cte", 3).over(at_place))
    t = t.withColumn("calls", F.col("calls") & made.isNull()).drop("makes", "after_list", "made_by")
    # a group is named by the parenthesis that opened it, which has a row inside too
    t = t.withColumn("opens", F.explode(F.when(symbol("("), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    t = t.withColumn("place", F.when(F.col("opens"), F.col("level")).otherwise(F.col("place")))
    opener = F.last(F.when(F.col("opens"), F.struct("pos", "calls")), ignorenulls=True).over(Window.partitionBy("id", "stmt", "place").orderBy("pos", "opens"))
    t = t.withColumn("opener", opener).where("NOT opens").withColumn("inner", F.coalesce("opener.pos", F.lit(0))).withColumn("call", (F.col("level") > 0) & F.coalesce("opener.calls", F.lit(False)))

    grants = F.coalesce(F.col("verb").isin("grant", "revoke"), F.lit(False))
    key = F.col("key")
    fires = (
        F.when(key == "update", (F.col("pos") == F.col("head")) & (F.col("last_set") > F.col("pos")))
        .when(key == "truncate", F.col("pos") == F.col("head"))
        .when(key == "into", F.col("after_into"))
        .when(key == "table", F.col("name_before").isin(*TABLE_VERBS) & (F.col("name_before") != "truncate"))
        .when(key == "on", (grants & F.col("after_privilege")) | ((F.col("verb") == "create") & F.col("after_kind")))
        .when(key == "join", ~grants)
        .when(key == "from", ~grants & ~F.col("distinct_from") & ~F.col("call"))
    )
    fires = F.coalesce(fires, F.lit(False))
    # a word between a keyword and its relation
    passed = F.col("word").isin(*MODIFIERS) | ((F.col("word") == "table") & F.col("truncates")) | (grants & F.col("word").isin(*GRANT_TABLES) & F.col("after_on"))
    step = F.when(fires, F.lit("fire")).when(F.coalesce(passed, F.lit(False)), F.lit("pass")).when(symbol(","), F.lit("comma")).when(F.col("word").isin(*(w for w in CLAUSE if w != "as")), F.lit("stop")).when(symbol(";"), F.lit("stop"))
    t = t.select("id", "pos", "stmt", "place", "inner", "text", "quoted", "word", "key", "name", "called", "alone", "cte", grants.alias("grants"), step.alias("step"))
    group = Window.partitionBy("id", "stmt", "place", "inner").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("list", F.last(F.when(F.col("step").isin("fire", "stop"), F.struct("step", F.col("key").alias("by"))), ignorenulls=True).over(group))
    t = t.withColumn("chain", F.last(F.when(~F.coalesce(F.col("step") == "pass", F.lit(False)), F.coalesce("step", F.lit(""))), ignorenulls=True).over(group))
    starts = F.col("chain").isin("fire", "comma") & (F.col("list.step") == "fire") & F.col("step").isNull()
    segment = F.when(F.col("quoted"), F.col("text") != "").otherwise(F.col("word").isNotNull() & ~F.col("word").isin(*CLAUSE))
    function = F.col("list.by").isin("from", "join") & F.col("called")
    other = F.col("grants") & (F.col("list.by") == "on") & F.coalesce(F.col("word").isin(*GRANT_OTHERS), F.lit(False))
    names = F.coalesce(starts & segment & ~function & ~other, F.lit(False))
    # names of a statement and of its common table expressions
    own = F.when(F.col("alone"), F.when(F.col("quoted"), F.col("text")).otherwise(F.col("word")))
    told = t.select("id", "stmt", "name", names.alias("names"), F.col("cte").isNotNull().alias("made"), F.coalesce("cte", F.when(names, own)).alias("own")).where("names OR made")
    told = told.withColumn("inside", F.max("made").over(Window.partitionBy("id", "stmt", "own")))
    return told.where("names AND NOT inside").select("id", "name").distinct()
