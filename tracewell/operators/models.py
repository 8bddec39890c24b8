"""ORM models of Python sources as a catalogue of tables and columns, and what queries on their managers name.

Models are the classes under the ORM's own base; a closure over bases tells which, and what each takes over. Fields, targets and
queries are resolved in one pass with the other names, and lookup paths are walked over the catalogue (``operators/catalog.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import naming
from tracewell.operators.catalog import walk_lookups
from tracewell.operators.python_graph import resolve
from tracewell.operators.traversal import closure
from tracewell.sources.python_sources import module_name
from tracewell.storage import materialize

# fixed values: names of the ORM
MODEL_BASES = ("django.db.models.Model", "django.db.models.base.Model")
RELATIONS = {"ForeignKey": "fk", "OneToOneField": "o2o", "ManyToManyField": "m2m", "ForeignObject": "unknown"}
QUERYSET_METHODS = "all filter exclude order_by values values_list only defer select_related prefetch_related annotate alias distinct reverse none using select_for_update union intersection difference extra complex_filter dates datetimes".split()
LOOKUP_METHODS = "filter exclude get get_or_create update_or_create".split()
FIELD_METHODS = "create update".split()
PATH_METHODS = "order_by values values_list only defer select_related prefetch_related distinct latest earliest".split()
NO_FIELDS = ("defaults", "create_defaults")
OPTIONS = "db_column primary_key related_name related_query_name db_table through".split()


def is_migration_path(path: Column) -> Column:
    """True for files of a migrations folder, and of versions under alembic or migrations."""
    return path.rlike(r"(^|/)(migrations|alembic/versions)/")


def _field_kind(name: Column) -> Column:
    """column, fk, o2o, m2m or unknown by the full name of an outside class; null if it is no field of a model."""
    last = F.substring_index(name, ".", -1)
    known = F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv))[last]
    kind = F.when(name.startswith("django."), F.coalesce(known, F.when(last.endswith("Field"), "column"))).when(last.endswith("Field"), "unknown")
    return F.when(~name.rlike(r"(^|\.)forms\."), kind)


def resolved_names(raw: DataFrame, bindings: DataFrame) -> DataFrame:
    """(path, fact, id, place, line, own, extra, to): bases, values bound to names, relation targets and queried models with what their names stand for."""
    first = F.when(F.col("fact").isin("base", "query"), F.col("name")).otherwise(F.col("value"))
    rows = raw.where("fact IN ('base', 'bind', 'first', 'query')").select("path", "fact", "id", "place", "line", "scope", F.col("name").alias("own"), F.col("value").alias("given"), "extra", first.alias("name")).where("name IS NOT NULL")
    to = F.when(F.col("rest") == "", F.col("target")).otherwise(F.concat_ws(".", "target", "rest"))
    return materialize(resolve(rows, bindings).select("path", "fact", "id", "place", "line", "own", "given", "extra", to.alias("to")), "model-names")


def catalogue(raw: DataFrame, defs: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(models, fields). Models: id, name, label, abstract, proxy, table_name (null if it is abstract or its name can't be told), tables (its own and those of concrete classes above).

    Fields: model, name, table_name, column_name, target, as ``walk_lookups`` takes them: own ones, those of abstract classes above as if
    they were own, those of concrete classes above in their tables, primary keys (pk too), columns of foreign keys by their own names, and
    reverse relations. Where a name comes twice, the nearest class's counts. A many-to-many field names its table in between and the column
    of the other side. Meta is read of the class itself alone; models of libraries and of other settings than the sources show have no rows.
    """
    outside = lambda c: F.when(F.col(c).rlike("^(external|module):"), F.regexp_replace(c, "^(external|module):", ""))
    classes = defs.where("kind = 'class'").select("id", "path", F.substring_index("id", "#", -1).alias("name"))
    bases = names.where("fact = 'base'").select("id", F.col("given").cast("int").alias("at"), "to")
    inner = materialize(bases.join(classes.select(F.col("id").alias("to")), "to").select(F.col("id").alias("child"), F.col("to").alias("parent"), "at"), "model-bases")
    above = closure(inner).select(F.col("node").alias("id"), F.col("root").alias("over"), "depth")
    above = materialize(above.unionByName(classes.select("id", F.col("id").alias("over"), F.lit(0).alias("depth"))), "model-above")
    starts = bases.withColumn("out", outside("to"))
    is_model = above.join(starts.where(F.col("out").isin(*MODEL_BASES)).select(F.col("id").alias("over")).distinct(), "over", "left_semi").select("id").distinct()
    field_classes = above.join(starts.select(F.col("id").alias("over"), _field_kind(F.col("out")).alias("kind")).where("kind IS NOT NULL"), "over").groupBy("id").agg(F.min_by("kind", "depth").alias("kind"))

    # what Meta says
    of = F.regexp_replace("id", r"\.Meta$", "").alias("id")
    flags = raw.where("fact = 'constant' AND id LIKE '%.Meta' AND value = 'True'").groupBy(of).agg(F.max(F.col("name") == "abstract").alias("abstract"), F.max(F.col("name") == "proxy").alias("proxy"))
    texts = raw.where("fact = 'bind' AND id LIKE '%.Meta'").where(F.col("name").isin("db_table", "app_label", "default_related_name"))
    told = lambda n: F.max_by(F.when(F.col("name") == n, F.col("extra")), F.when(F.col("name") == n, F.col("place")))
    texts = texts.groupBy(of).agg(told("db_table").alias("db_table"), F.max(F.col("name") == "db_table").alias("has_table"), told("app_label").alias("app_label"), told("default_related_name").alias("related"))
    label = F.regexp_replace(F.regexp_replace(module_name(F.col("path")), r"\.models(\..*)?$", ""), r"^.*\.", "")
    models = classes.join(is_model, "id").join(flags, "id", "left").join(texts, "id", "left").fillna(False, ["abstract", "proxy", "has_table"])
    models = models.withColumn("label", F.coalesce("app_label", label))
    generated = naming.agreed_name(F.concat_ws("_", "label", F.lower("name")), generated=True)
    own_table = F.when(F.col("abstract") | F.col("db_table").contains("￼"), None).when(F.col("has_table"), naming.agreed_name(F.col("db_table"))).otherwise(generated)
    models = materialize(models.select("id", "path", "name", "label", "abstract", "proxy", "related", own_table.alias("own_table")), "models")

    # a proxy stands for the nearest class above that has a table
    plain = models.where("NOT abstract AND NOT proxy").select(F.col("id").alias("over"), F.col("own_table").alias("t"))
    concrete = models.where("NOT abstract").select("id").join(above, "id").join(plain, "over").groupBy("id").agg(F.min_by(F.struct("over", "t"), F.struct("depth", "over")).alias("c"), F.collect_set("t").alias("tables"))
    models = materialize(models.join(concrete, "id", "left").select("id", "path", "name", "label", "abstract", "proxy", "related", F.col("c.over").alias("concrete"), F.col("c.t").alias("table_name"), "tables"), "models")

    # fields as the classes declare them, the last of a name
    out = outside("to")
    made = names.where("fact = 'bind'").withColumn("kind", _field_kind(out)).join(field_classes.select(F.col("id").alias("to"), F.col("kind").alias("k2")), "to", "left").withColumn("kind", F.coalesce("kind", "k2")).where("kind IS NOT NULL")
    made = made.groupBy("id", F.col("own").alias("field")).agg(F.max_by("kind", "place").alias("kind"))
    option = raw.where("fact = 'keyword'").where(F.col("name").isin(*OPTIONS)).groupBy(F.col("id").alias("key")).agg(*(F.max(F.when(F.col("name") == o, F.col("value"))).alias(o) for o in OPTIONS))
    firsts = raw.where("fact = 'first'").groupBy("id", F.col("name").alias("field")).agg(F.max_by("extra", "place").alias("text"))
    aims = names.where("fact = 'first'").groupBy("id", F.col("own").alias("field")).agg(F.max_by("to", "place").alias("aim"))
    declared = made.withColumn("key", F.concat_ws(".", "id", "field")).join(option, "key", "left").join(firsts, ["id", "field"], "left").join(aims, ["id", "field"], "left").drop("key")

    # abstract classes hand their fields down; a way goes on through abstract classes alone
    abstract = models.where("abstract").select(F.col("id").alias("parent"))
    kin = inner.join(models.select(F.col("id").alias("child")), "child", "left_semi")
    handed = closure(kin.join(abstract, "parent", "left_semi")).select("node", F.col("root").alias("id"), "depth").unionByName(models.select(F.col("id").alias("node"), "id", F.lit(0).alias("depth")))
    handed = materialize(handed, "model-handed")
    nearest = Window.partitionBy("node", "field").orderBy("depth", "id")
    owned = handed.join(declared, "id").withColumn("n", F.row_number().over(nearest)).where("n = 1").drop("n", "id")
    owned = owned.join(models.where("NOT abstract").select(F.col("id").alias("node"), F.lower("name").alias("low"), "label", "related", "table_name", "proxy"), "node")
    by_label = models.where("NOT abstract").groupBy(F.col("label").alias("t_app"), F.lower("name").alias("t_name")).agg(F.min("id").alias("by_label"))
    known = models.select(F.col("id").alias("aim"), F.lit(1).alias("is_model"))
    app = F.when(F.col("text").contains("."), F.substring_index("text", ".", 1)).otherwise(F.col("label"))
    owned = owned.join(known, "aim", "left").withColumn("t_app", app).withColumn("t_name", F.lower(F.substring_index("text", ".", -1))).join(by_label, ["t_app", "t_name"], "left")
    target = F.when(F.col("kind").isin("fk", "o2o", "m2m"), F.when(F.col("text") == "self", F.col("node")).when(F.col("text").isNotNull(), F.col("by_label")).when(F.col("is_model") == 1, F.col("aim")))
    owned = owned.withColumn("target", target).join(models.select(F.col("id").alias("target"), F.lower("name").alias("target_low")), "target", "left")
    between = F.when(F.col("through").isNotNull(), None).when(F.col("db_table").isNotNull(), naming.agreed_name(F.col("db_table"))).otherwise(naming.agreed_name(F.concat_ws("_", "table_name", "field"), generated=True))
    other = F.concat(F.when(F.col("target") == F.col("node"), "to_").otherwise(F.lit("")), "target_low", F.lit("_id"))
    column = F.when(F.col("kind") == "column", F.coalesce("db_column", "field")).when(F.col("kind").isin("fk", "o2o"), F.coalesce("db_column", F.concat("field", F.lit("_id")))).when(F.col("kind") == "m2m", other)
    owned = materialize(owned.withColumn("column_name", column).withColumn("table_name", F.when(F.col("kind") == "m2m", between).otherwise(F.col("table_name"))), "model-fields")

    row = lambda model, name, priority, target=F.col("target"): (F.col(model).alias("model"), name.alias("name"), "table_name", "column_name", target.cast("string").alias("target"), F.lit(priority).alias("priority"))
    fields = owned.select(*row("node", F.col("field"), 0))
    fields = fields.unionByName(owned.where("kind IN ('fk', 'o2o')").select(*row("node", F.concat("field", F.lit("_id")), 1, F.lit(None))))
    # keys: the declared one, a link to the first concrete class above, or id
    links = handed.join(kin.select(F.col("child").alias("id"), F.col("parent").alias("up"), "at"), "id").join(models.where("NOT abstract").select(F.col("id").alias("up"), F.lower("name").alias("up_low"), F.col("concrete").alias("up_c")), "up")
    links = links.join(models.where("NOT abstract AND NOT proxy").select(F.col("id").alias("node"), "table_name"), "node").withColumn("field", F.concat("up_low", F.lit("_ptr"))).withColumn("column_name", F.concat("field", F.lit("_id")))
    links = materialize(links.select("node", "depth", "at", "field", "table_name", "column_name", F.col("up_c").alias("target")), "model-links")
    fields = fields.unionByName(links.select(*row("node", F.col("field"), 1)))
    fields = fields.unionByName(links.join(models.select(F.col("id").alias("node"), F.lower("name").alias("low")), "node").select(*row("target", F.col("low"), 2, F.col("node"))))
    chosen = owned.where("primary_key = 'True'").groupBy("node").agg(F.min_by(F.struct("column_name", "target"), "field").alias("p"))
    linked = links.groupBy("node").agg(F.min_by(F.struct("column_name", "target"), F.struct("depth", "at")).alias("l"))
    keys = models.where("NOT abstract AND NOT proxy").select(F.col("id").alias("node"), "table_name").join(chosen, "node", "left").join(linked, "node", "left")
    key = F.coalesce("p", "l", F.struct(F.lit("id").alias("column_name"), F.lit(None).cast("string").alias("target")))
    keys = keys.select("node", "table_name", key.alias("k"), (F.col("p").isNull() & F.col("l").isNull()).alias("auto")).select("node", "table_name", "k.*", "auto")
    fields = fields.unionByName(keys.select(*row("node", F.lit("pk"), 0))).unionByName(keys.where("auto").select(*row("node", F.lit("id"), 1)))
    # the other way round, under the name that queries use
    given = F.coalesce("related_query_name", "related_name", "related", "low")
    given = F.replace(F.replace(F.replace(given, F.lit("%(class)s"), F.col("low")), F.lit("%(model_name)s"), F.col("low")), F.lit("%(app_label)s"), F.lower("label"))
    back = owned.where("target IS NOT NULL AND NOT proxy").where(~F.coalesce(F.col("related_name").endswith("+"), F.lit(False)))
    fields = fields.unionByName(back.select(*row("target", given, 2, F.col("node"))))
    # all of that again for what is below; a class's own rows are nearer
    seen = above.select(F.col("id").alias("see"), F.col("over").alias("model"), "depth").join(models.select(F.col("id").alias("see")), "see", "left_semi").join(fields, "model")
    place = Window.partitionBy("see", "name").orderBy("depth", "priority", "model", "table_name", "column_name")
    fields = seen.withColumn("n", F.row_number().over(place)).where("n = 1").select(F.col("see").alias("model"), "name", "table_name", "column_name", "target")
    return models.select("id", "name", "label", "abstract", "proxy", "table_name", "tables"), materialize(fields, "model-fields")


def model_uses(raw: DataFrame, names: DataFrame, models: DataFrame, fields: DataFrame) -> DataFrame:
    """(id, line, relation, column_name) that chains of calls on models' managers name: each model's tables without a column, and the tables and columns of lookups,
    ordering, values and writes. A model or a path that can't be told gives a row without a relation. Rows are unique.

    Managers are ``objects``, ``_default_manager`` and ``_base_manager``; query sets in variables aren't followed.
    """
    methods = F.split("given", r"\.")
    chains = names.where("fact = 'query'").withColumn("methods", methods).where(F.forall(F.slice("methods", 1, F.greatest(F.size("methods") - 1, F.lit(0))), lambda m: m.isin(*QUERYSET_METHODS)))
    chains = chains.join(models.select(F.col("id").alias("model"), "tables"), F.col("to") == F.col("model"), "left")
    chains = materialize(chains.select("path", "id", "line", "place", "model", "tables", F.element_at("methods", -1).alias("method")), "model-chains")
    whole = chains.select("id", "line", F.explode_outer("tables").alias("relation"), F.lit(None).cast("string").alias("column_name"))

    args = raw.where("fact IN ('lookup', 'field-path')").select("path", F.col("extra").cast("int").alias("place"), "fact", F.col("value").alias("asked"), F.col("place").alias("arg"))
    named = chains.where("model IS NOT NULL").join(args, ["path", "place"])
    keyword = (F.col("fact") == "lookup") & F.col("method").isin(*LOOKUP_METHODS, *FIELD_METHODS) & ~F.col("asked").isin(*NO_FIELDS)
    listed = (F.col("fact") == "field-path") & F.col("method").isin(*PATH_METHODS) & (F.col("asked") != "?")
    sites = materialize(named.where(keyword | listed).select(F.concat_ws(":", "path", "arg").alias("site"), "model", F.regexp_replace("asked", "^-", "").alias("path"), "id", "line"), "model-sites")
    walked = walk_lookups(sites.select("site", "model", "path"), fields).join(sites.select("site", "id", "line"), "site")
    return whole.unionByName(walked.select("id", "line", F.col("table_name").alias("relation"), "column_name")).distinct()
