"""Routes, HTTP calls and database relations of Python sources, from their raw facts by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import naming, patterns, urls
from tracewell.operators import facts, sql_text
from tracewell.operators.python_graph import resolve
from tracewell.operators.ranking import numbered
from tracewell.sources.python_sources import module_name
from tracewell.storage import materialize

MOST_DEPTH = 32  # fixed value: how deep includes and blueprints are followed
# fixed values: converters of path rules with the kind of parameter they take
CONVERTERS = {"int": "int", "slug": "slug", "uuid": "uuid", "path": "path"}
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
RULE = r"<(?:([a-zA-Z_]\w*)(?:\([^)]*\))?:)?[a-zA-Z_]\w*>"


def rule_template(rule: Column) -> Column:
    """A path rule's canonical template: parameters are {}, a path parameter that is the whole last segment {**}; null if a segment can't be written so."""
    marked = F.regexp_replace(F.regexp_replace(rule, r"<path(?:\([^)]*\))?:[a-zA-Z_]\w*>$", "￾"), RULE, urls.VALUE)
    coded = urls.encode_literal(marked)
    value, rest = "%EF%BF%BC", "%EF%BF%BE"
    out = F.replace(F.replace(coded, F.lit(value), F.lit("{}")), F.lit(rest), F.lit("{**}"))
    bad = out.rlike(r"[^/]\{\*\*\}") | out.rlike(r"\{\}[^/]*\{\}") | F.regexp_replace(rule, r"<path(?:\([^)]*\))?:[a-zA-Z_]\w*>$", "").contains("<path")
    return F.when(~bad, out)


def rule_constraints(rule: Column) -> Column:
    """(segment, kind) of a rule's parameters that a converter narrows, as text segment:kind."""
    segments = F.slice(F.split(rule, "/"), 2, 1000)
    kinds = F.transform(segments, lambda s, i: F.when(F.regexp_extract(s, RULE, 1).isin(*CONVERTERS), F.concat_ws(":", i.cast("string"), F.regexp_extract(s, RULE, 1))))
    return F.array_join(F.filter(kinds, lambda k: k.isNotNull()), ",")


def _joined_prefix(parent: Column, child: Column) -> Column:
    return F.when(parent == "", child).when(child == "", parent).otherwise(F.concat(F.regexp_replace(parent, "/+$", ""), F.lit("/"), F.regexp_replace(child, "^/+", "")))


def flask_routes(raw: DataFrame, bindings: DataFrame) -> DataFrame:
    """(method, template, id, constraints, path, line) of rules on applications and on blueprints where they are registered.

    Blueprints nest: registrations are followed level by level, and one that is already on the way is not followed.
    """
    made = raw.where("fact = 'bind' AND value IS NOT NULL").select("path", "id", "name", "value", "line")
    kinds = resolve(made.select("path", "id", F.col("value").alias("made"), F.col("name").alias("object"), F.col("value").alias("name")), bindings)
    kind = F.when((F.col("target") == "external:flask.Flask") | ((F.col("target") == "module:flask") & (F.col("rest") == "Flask")), "app").when((F.col("target") == "external:flask.Blueprint") | ((F.col("target") == "module:flask") & (F.col("rest") == "Blueprint")), "blueprint")
    objects = kinds.withColumn("kind", kind).where("kind IS NOT NULL").select("path", "object", "kind", F.concat_ws("#", "path", "object").alias("key"))
    prefix = raw.where("fact = 'keyword' AND name = 'url_prefix'").select(F.regexp_replace("id", r"#<module>\.", "#").alias("key"), F.col("value").alias("own"))
    objects = materialize(objects.join(prefix.dropDuplicates(["key"]), "key", "left").withColumn("own", F.coalesce("own", F.lit(""))), "flask-objects")

    # names of objects, here or imported
    exported = objects.select(module_name(F.col("path")).alias("m"), F.col("object").alias("o"), "key")

    def found(rows: DataFrame, column: str) -> DataFrame:
        here = rows.join(objects.select(F.col("path").alias("_p"), F.col("object").alias("_o"), F.col("key").alias("_k")), (F.col("path") == F.col("_p")) & (F.col(column) == F.col("_o")), "left").drop("_p", "_o")
        there = raw.where("fact = 'import' AND extra <> ''").select(F.col("path").alias("_ip"), F.col("name").alias("_in"), F.regexp_replace("value", r"^\.+", "").alias("_im"), F.col("extra").alias("_io"), F.col("value").startswith(".").alias("_rel"))
        out = here.join(there, (F.col("path") == F.col("_ip")) & (F.col(column) == F.col("_in")), "left")
        package = F.regexp_replace(module_name(F.col("path")), r"\.?[^.]*$", "")
        source = F.when(F.col("_rel"), F.concat_ws(".", F.nullif(package, F.lit("")), F.nullif(F.col("_im"), F.lit("")))).otherwise(F.col("_im"))
        return out.withColumn("_src", source).join(exported.withColumnRenamed("key", "_ek"), (F.col("_src") == F.col("m")) & (F.col("_io") == F.col("o")), "left").withColumn("key", F.coalesce("_k", "_ek")).drop("_k", "_ip", "_in", "_im", "_io", "_rel", "_src", "m", "o", "_ek")

    calls = raw.where("fact = 'call' AND name LIKE '%.register_blueprint'").select("path", "line", "col", F.regexp_replace("name", r"\.register_blueprint$", "").alias("on"))
    args = raw.where("fact = 'argument' AND value LIKE '%.register_blueprint'").select("path", "line", F.col("name").alias("what"))
    option = raw.where("fact = 'keyword' AND name = 'url_prefix' AND extra LIKE '%.register_blueprint'").select("path", F.split("id", ":")[1].cast("int").alias("line"), F.col("value").alias("given"))
    registered = calls.join(args, ["path", "line"]).join(option, ["path", "line"], "left")
    registered = found(found(registered, "on").withColumnRenamed("key", "above"), "what").withColumnRenamed("key", "below").where("above IS NOT NULL AND below IS NOT NULL")
    registered = materialize(registered.join(objects.select(F.col("key").alias("below"), "own"), "below").select("above", "below", F.coalesce("given", "own").alias("prefix")), "flask-registered")

    at = materialize(objects.where("kind = 'app'").select("key", F.lit("").alias("prefix"), F.array("key").alias("way")), "flask-at")
    every = at
    for _ in range(MOST_DEPTH):
        at = materialize(at.join(registered.withColumnRenamed("prefix", "more"), F.col("key") == F.col("above")).where(~F.array_contains("way", F.col("below"))).select(F.col("below").alias("key"), _joined_prefix(F.col("prefix"), F.col("more")).alias("prefix"), F.array_append("way", F.col("below")).alias("way")), "flask-at")
        if at.isEmpty():
            break
        every = every.unionByName(at)

    decorated = raw.where("fact = 'decorator' AND value IS NOT NULL").select("path", "line", F.col("extra").alias("handler"), F.substring_index("name", ".", 1).alias("object"), F.substring_index("name", ".", -1).alias("verb"), F.col("value").alias("rule"))
    decorated = decorated.where(F.col("verb").isin("route", *VERBS))
    methods = raw.where("fact = 'keyword' AND name = 'methods'").select(F.col("id").alias("handler"), F.split("value", ",").alias("methods")).dropDuplicates(["handler"])
    rules = found(decorated, "object").where("key IS NOT NULL").join(methods, "handler", "left")
    # add_url_rule(rule, view_func=..., methods=[...])
    option = lambda name: raw.where((F.col("fact") == "keyword") & (F.col("name") == name) & F.col("extra").endswith(".add_url_rule")).select(F.col("id").alias("site"), F.col("value").alias(name)).dropDuplicates(["site"])
    added = raw.where("fact = 'call' AND name LIKE '%.add_url_rule' AND value IS NOT NULL").select("path", "line", "scope", F.concat_ws(":", "path", "line", "col").alias("site"), F.regexp_replace("name", r"\.add_url_rule$", "").alias("object"), F.lit("route").alias("verb"), F.col("value").alias("rule"))
    added = added.join(option("view_func"), "site").join(option("methods"), "site", "left")
    if not added.isEmpty():
        views = resolve(added.withColumnRenamed("view_func", "name"), bindings)
        views = views.select("path", "line", F.when(F.col("rest") == "", F.col("target")).otherwise(F.concat_ws(".", "target", "rest")).alias("handler"), "object", "verb", "rule", F.split("methods", ",").alias("methods"))
        rules = rules.unionByName(found(views, "object").where("key IS NOT NULL"))
    verbs = facts.emitted_methods(F.when(F.col("verb") != "route", F.array(F.col("verb"))).otherwise(F.coalesce("methods", F.array(F.lit("GET")))))
    placed = rules.join(every, "key").withColumn("full", _joined_prefix(F.col("prefix"), F.col("rule"))).withColumn("method", F.explode(verbs))
    return placed.where(F.col("method").isin(*facts.HTTP_METHODS)).select("method", rule_template(F.col("full")).alias("template"), F.col("handler").alias("id"), rule_constraints(F.col("full")).alias("constraints"), "path", "line").distinct()


def django_routes(raw: DataFrame, bindings: DataFrame, root: str) -> DataFrame:
    """(template, id, constraints, ordinal) of path() and re_path() entries reached from the module ``root`` through include(), in order of registration.

    Entries of lists, of += and of append() and extend() count; a pattern that can't be told, or below one, gives a null template.
    """
    items = raw.where("fact = 'item' AND name = 'urlpatterns'").select(module_name(F.col("path")).alias("module"), "path", "place", F.split("value", r"\|", 2).alias("call"), F.split("extra", r"\|").alias("to"))
    items = items.withColumn("maker", F.substring_index(F.col("call")[0], ".", -1)).where("maker IN ('path', 're_path')").select("module", "path", "place", "maker", F.col("call")[1].alias("route"), F.col("to")[0].alias("kind"), F.col("to")[1].alias("name"))
    items = items.withColumn("route", F.explode_outer(F.when(F.col("maker") == "re_path", patterns.pattern_rules(F.col("route"), F.col("kind") == "view")).otherwise(F.array("route"))))
    views = resolve(items.where("kind = 'view'"), bindings)
    views = materialize(views.select("module", "place", "route", F.when(F.col("rest") == "", F.col("target")).otherwise(F.concat_ws(".", "target", "rest")).alias("id")), "django-views")
    includes = materialize(items.where("kind = 'include'").select("module", "place", "route", F.col("name").alias("into")), "django-includes")
    at = materialize(includes.limit(1).selectExpr(f"'{root}' AS module", "'/' AS prefix", "CAST(array() AS array<int>) AS way", f"array('{root}') AS seen").union(views.limit(1).selectExpr(f"'{root}'", "'/'", "CAST(array() AS array<int>)", f"array('{root}')")).limit(1), "django-at")
    every = at
    for _ in range(MOST_DEPTH):
        at = materialize(at.join(includes, "module").where(~F.array_contains("seen", F.col("into"))).select(F.col("into").alias("module"), F.concat("prefix", "route").alias("prefix"), F.array_append("way", F.col("place")).alias("way"), F.array_append("seen", F.col("into")).alias("seen")), "django-at")
        if at.isEmpty():
            break
        every = every.unionByName(at)
    full = every.join(views, "module").withColumn("rule", F.concat("prefix", "route")).withColumn("order", F.array_append("way", F.col("place")))
    return numbered(full, "order").select(rule_template(F.col("rule")).alias("template"), "id", rule_constraints(F.col("rule")).alias("constraints"), F.col("ordinal").cast("int").alias("ordinal"))


# fixed values: functions that send a request by themselves, their verb in the name or in the first argument, and classes of clients with how they join a path
SENDERS = {**{f"{library}.{verb}": verb for library in ("requests", "requests.api", "httpx") for verb in (*VERBS, "request")}, "httpx.stream": "request", "aiohttp.request": "request"}
CLIENTS = {
    **dict.fromkeys(("requests.Session", "requests.session", "requests.sessions.Session", "requests.sessions.session"), ("requests", "no-base")),
    **dict.fromkeys(("httpx.Client", "httpx.AsyncClient"), ("httpx", "httpx-base-url")),
    **dict.fromkeys(("aiohttp.ClientSession", "aiohttp.client.ClientSession"), ("aiohttp", "aiohttp-base-url")),
}


def _full_name() -> Column:
    """The dotted name of what a resolved row stands for outside of the project."""
    return F.concat_ws(".", F.regexp_replace("target", "^(external|module):", ""), F.nullif("rest", F.lit("")))


def _requests(known: DataFrame, path: Column, anchor: Column, host: Column, fine: Column) -> DataFrame:
    """Facts of calls: ``path`` becomes a template where ``fine``; else the path is unknown."""
    # steps are columns of their own, so that no expression holds another one many times
    known = known.withColumns({"_path": path, "_host": host, "_fine": fine, "_anchor": anchor})
    path, host = F.col("_path"), F.col("_host")
    known = known.withColumn("_fine", F.coalesce(~path.rlike(r"[^/]￼|￼[^/]") & path.startswith("/") & F.col("_fine"), F.lit(False)))
    known = known.withColumn("_path", F.replace(urls.remove_dot_segments(urls.normalize_path(path)), F.lit("%EF%BF%BC"), F.lit("{}")))
    known = known.withColumn("_masked", urls.mask_template(path, host))
    masked, fine = F.col("_masked"), F.col("_fine")
    return known.select("method", F.when(fine, masked["template"]).alias("template"), F.when(fine, F.col("_anchor")).otherwise("base").alias("anchor"), host.alias("authority"), F.when(fine, masked["masked"]).otherwise(0).alias("masked"), "id", "line")


def _verb_and_url(calls: DataFrame, verb: Column) -> DataFrame:
    named = verb.isin("request", "stream")
    return calls.withColumn("url", F.when(named, F.col("second")).otherwise(F.col("first"))).withColumn("method", F.upper(F.when(named, F.col("first")).otherwise(verb)))


def _sent(known: DataFrame) -> DataFrame:
    """Facts of calls with a ``url`` of their own."""
    dynamic_host = F.col("url").rlike(r"^https?://[^/?#]*￼")
    leading = F.col("url").startswith(urls.VALUE)
    split = urls.split_url(F.col("url"))
    path = F.when(dynamic_host, F.regexp_replace("url", r"^https?://[^/?#]*", "")).when(leading, F.substring("url", 2, 100_000)).otherwise(split["path"])
    return _requests(known, urls.cut_query(path), F.when(dynamic_host | leading, "base").otherwise("root"), F.when(~dynamic_host & ~leading, split["authority"]), dynamic_host | leading | (split["kind"] == "absolute"))


def _with_texts(calls: DataFrame, texts: DataFrame | None) -> DataFrame:
    """Calls (path, place, verb, first, second) with what names and formats in their arguments make, and a url that is given by name."""
    if texts is None:
        return calls
    told = texts.select("at", *(F.col(c).alias(f"_{c}") for c in ("first", "second", "url")))
    calls = calls.withColumn("at", F.concat_ws(":", "path", "place")).join(told, "at", "left")
    named = F.col("verb").isin("request", "stream")
    over = lambda c: F.when(F.col(f"_{c}").isNotNull(), F.nullif(f"_{c}", F.lit(urls.VALUE))).otherwise(F.col(c))
    first = F.when(named, over("first")).otherwise(F.coalesce(over("first"), "_url"))
    second = F.when(named, F.coalesce(over("second"), "_url")).otherwise(over("second"))
    return calls.withColumns({"first": first, "second": second}).drop("at", "_first", "_second", "_url")


def client_calls(raw: DataFrame, bindings: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(method, template, anchor, authority, masked, id, line) of calls of HTTP client functions; an unknown path has no template.

    ``texts``: what ``texts.arguments`` tells of the same facts; without it, names and formats in a URL are values.
    """
    calls = resolve(raw.where("fact = 'call' AND name IS NOT NULL").select("path", "id", "name", "scope", "line", "col", "place", F.col("value").alias("first"), F.col("extra").alias("second")), bindings)
    verb = F.create_map(*(F.lit(x) for pair in SENDERS.items() for x in pair))[_full_name()]
    return _sent(_verb_and_url(_with_texts(calls.withColumn("verb", verb).where("verb IS NOT NULL"), texts), F.col("verb")))


def client_objects(raw: DataFrame, bindings: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(owner, name, library, style, base, base_known): names of a scope, and attributes of a class's self, that only clients are assigned to.

    The base is a literal URL, or one that ``texts`` knows; one that is given in another way is unknown. An attribute that a subclass assigns is the subclass's own.
    """
    made = raw.where("fact = 'made'").select("path", F.col("id").alias("owner"), F.col("name").alias("object"), F.col("value").alias("name"), "scope", "line", "col", "place", F.col("extra").alias("first"))
    kinds = F.create_map(*(x for k, v in CLIENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    found = resolve(made, bindings).withColumn("kind", kinds[_full_name()]).where("kind IS NOT NULL")
    given = raw.where("fact = 'keyword' AND name = 'base_url'").select(F.col("id").alias("at"), F.col("value").alias("asked"), F.lit(True).alias("named"))
    found = found.withColumn("at", F.format_string("%s:%d:%d", "path", "line", "col")).join(given.dropDuplicates(["at"]), "at", "left")
    if texts is not None:
        told = texts.select(F.col("at").alias("_at"), F.col("first").alias("_first"), F.col("base_url").alias("_base"))
        found = found.join(told, F.concat_ws(":", "path", "place") == F.col("_at"), "left").withColumns({"asked": F.coalesce("_base", "asked"), "first": F.coalesce("_first", "first")})
    text = F.when(F.col("named"), F.col("asked")).otherwise(F.when(F.col("kind")[0] == "aiohttp", F.col("first")))
    literal = text.rlike("^https?://[^/?#]+") & ~text.contains(urls.VALUE) & ~urls.has_query(text)
    style = F.col("kind")[1]
    bare = F.col("named").isNull() & ((style != "aiohttp-base-url") | (F.col("first") == ""))  # only aiohttp takes a base by position
    rows = found.select(F.concat_ws("\u0001", "owner", "object").alias("name"), F.col("kind")[0].alias("library"), style.alias("style"), F.when(literal, text).alias("base"), F.coalesce(literal | bare, F.lit(False)).alias("base_known"))
    told = materialize(rows, "clients")
    own = told.groupBy("name").agg(F.count("*").alias("clients"))
    every = raw.where("fact IN ('shadow', 'alias', 'instance', 'attribute', 'import', 'definition')")
    # a definition's row names its parent in extra, as the scope that binds it
    bound = every.groupBy(F.concat_ws("\u0001", F.when(F.col("fact") == "definition", F.col("extra")).otherwise(F.col("id")), "name").alias("name")).agg(F.count("*").alias("bound"))
    sure = own.join(bound, "name").where("bound = clients").select("name")
    key = F.split("name", "\u0001")
    return facts.client_agreement(told.join(sure, "name", "left_semi")).select(key[0].alias("owner"), key[1].alias("name"), "library", "style", "base", "base_known")


def session_calls(raw: DataFrame, bindings: DataFrame, aiohttp_version: tuple[int, int] | None = None, texts: DataFrame | None = None) -> DataFrame:
    """As ``client_calls``, of methods of client objects: those that a scope or an enclosing one makes, that a module imports by name, and attributes of self.

    A path on a client with a known base has its host; on one with an unknown base, only its own part. What a client does with a URL of its own host depends
    for aiohttp on the version, so such calls of sessions with a base have no template.
    """
    objects = materialize(client_objects(raw, bindings, texts), "client-objects")
    # names of other modules' clients
    imports = raw.where("fact = 'import' AND extra <> '' AND value NOT LIKE '.%'").select("id", "name", F.col("value").alias("m"), F.col("extra").alias("member"))
    outer = objects.where("owner LIKE '%#<module>'").withColumn("m", module_name(F.substring_index("owner", "#", 1))).withColumnRenamed("name", "member").drop("owner")
    objects = objects.unionByName(imports.join(outer, ["m", "member"]).select(F.col("id").alias("owner"), "name", "library", "style", "base", "base_known"))
    once = objects.groupBy("owner", "name").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("library", "style", "base", "base_known"))).where("n = 1").drop("n")
    calls = raw.where("fact = 'call' AND name LIKE '%.%'").withColumn("verb", F.substring_index("name", ".", -1)).where(F.col("verb").isin(*VERBS, "request", "stream"))
    object_ = F.regexp_replace("name", r"\.[^.]*$", "")
    owner = F.when(object_.startswith("self."), F.regexp_replace("id", r"\.[^.]*$", "")).otherwise(F.coalesce("scope", F.concat("path", F.lit("#<module>"))))
    calls = calls.select(owner.alias("owner"), object_.alias("name"), "verb", "id", "line", "path", "place", F.col("value").alias("first"), F.col("extra").alias("second"))
    known = calls.join(once, ["owner", "name"]).where("verb <> 'stream' OR library = 'httpx'")
    known = materialize(_verb_and_url(_with_texts(known, texts), F.col("verb")), "session-calls")
    # a relative path on a client that may have a base
    joins = F.col("style").isin("httpx-base-url", "aiohttp-base-url") & (F.col("base").isNotNull() | ~F.col("base_known"))
    alone = ~F.col("url").rlike(r"^https?://") & ~F.col("url").startswith(urls.VALUE)
    relative = F.coalesce(joins & alone, F.lit(False))
    stuck = F.coalesce((F.col("library") == "aiohttp") & joins & ~alone, F.lit(False))
    base = urls.split_url(F.col("base"))
    root = F.when(F.col("base").isNotNull(), F.regexp_replace(base["path"], "^/$", ""))
    joined = {style: urls.join_path(style, root, urls.cut_query(F.col("url")), aiohttp_version if style == "aiohttp-base-url" else None) for style in ("httpx-base-url", "aiohttp-base-url")}
    raw_path = F.when(F.col("style") == "httpx-base-url", joined["httpx-base-url"]["raw"]).otherwise(joined["aiohttp-base-url"]["raw"])
    based = _requests(known.where(relative), raw_path, F.when(F.col("base").isNotNull(), "root").otherwise("base"), base["authority"], raw_path.isNotNull())
    own = _sent(known.where(~relative & ~stuck))
    unknown = known.where(stuck).select("method", F.lit(None).cast("string").alias("template"), F.lit("base").alias("anchor"), F.lit(None).cast("string").alias("authority"), F.lit(0).alias("masked"), "id", "line")
    return based.unionByName(own).unionByName(unknown)


def declared_tables(raw: DataFrame, defs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(id, table): classes with a table of their own: a literal __tablename__, a Meta.db_table, or by class and application of a Django model.

    ``ancestors``: (id, base) with the full names of all outside bases of a class and of those above it.
    """
    binds = raw.where("fact = 'bind' AND extra IS NOT NULL").select("id", "name", F.col("extra").alias("text"))
    own = binds.where("name = '__tablename__'").select("id", F.col("text").alias("table"))
    meta = binds.where("name = 'db_table' AND id LIKE '%.Meta'").select(F.regexp_replace("id", r"\.Meta$", "").alias("id"), F.col("text").alias("meta"))
    label = F.regexp_replace(F.regexp_replace(module_name(F.col("path")), r"\.models(\..*)?$", ""), r"^.*\.", "")
    models = ancestors.where("base = 'django.db.models.Model'").select("id").distinct().join(defs.select("id", "path", "name"), "id").join(meta, "id", "left")
    django = models.select("id", F.coalesce("meta", naming.truncate_name(F.concat_ws("_", label, F.lower("name")), 63)).alias("table"))
    return own.unionByName(django).distinct()


def sql_uses(raw: DataFrame) -> DataFrame:
    """(id, line, relation) of SQL texts passed to execute()."""
    texts = raw.where("fact = 'call' AND value IS NOT NULL AND (name LIKE '%.execute' OR name LIKE '%.executemany' OR name LIKE '%.raw')")
    texts = texts.select(F.concat_ws(":", "id", "line", "col").alias("id"), F.regexp_replace(F.col("value"), r"%s|%\(\w+\)s|￼", "?").alias("sql"), F.col("id").alias("scope"), "line")
    return sql_text.relations(texts).join(texts.select("id", "scope", "line"), "id").select(F.col("scope").alias("id"), "line", F.col("name").alias("relation"))


# fixed values: what a router makes of a view set: method name, verb, and whether it is about one object
ROUTED = (("list", "GET", False), ("create", "POST", False), ("retrieve", "GET", True), ("update", "PUT", True), ("partial_update", "PATCH", True), ("destroy", "DELETE", True))
VIEW_SETS = {"ModelViewSet": [r[0] for r in ROUTED], "ReadOnlyModelViewSet": ["list", "retrieve"]}  # fixed values


def router_routes(raw: DataFrame, bindings: DataFrame, defs: DataFrame) -> DataFrame:
    """(method, template, id) of view sets registered on routers: their own handlers, those of the generic view set they start from, and extra actions.

    Registrations are joined with a small table of what a router makes of each handler.
    """
    calls = raw.where("fact = 'call' AND name LIKE '%.register' AND value IS NOT NULL").select("path", "line", F.col("value").alias("prefix"))
    args = raw.where("fact = 'argument' AND value LIKE '%.register'").select("path", "line", "name")
    full = F.when(F.col("rest") == "", F.col("target")).otherwise(F.concat_ws(".", "target", "rest"))
    sets = resolve(calls.join(args, ["path", "line"]), bindings).select("prefix", full.alias("cls"))
    own = defs.where("kind = 'method'").select(F.col("parent").alias("cls"), F.col("name").alias("handler"))
    generic = resolve(raw.where("fact = 'base'").select("path", F.col("id").alias("cls"), "name"), bindings)
    generic = generic.withColumn("kind", F.substring_index(F.concat_ws(".", "target", F.nullif("rest", F.lit(""))), ".", -1))
    given = generic.select("cls", F.explode(F.create_map(*(x for k, v in VIEW_SETS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.col("kind")]).alias("handler"))
    table = F.explode(F.array(*(F.struct(F.lit(h).alias("handler"), F.lit(v).alias("method"), F.lit(o).alias("one")) for h, v, o in ROUTED))).alias("r")
    made = sets.select("prefix", "cls", table).select("prefix", "cls", "r.*").join(own.unionByName(given).distinct(), ["cls", "handler"])
    base = F.concat(F.lit("/"), urls.encode_literal(F.col("prefix")), F.lit("/"))
    routes = made.select("method", F.concat(base, F.when(F.col("one"), F.lit("{}/")).otherwise(F.lit(""))).alias("template"), F.concat_ws(".", "cls", "handler").alias("id"))
    # @action(detail=..., methods=[...], url_path=...)
    option = lambda name: raw.where((F.col("fact") == "keyword") & (F.col("name") == name) & (F.substring_index("extra", ".", -1) == "action")).select("id", F.col("value").alias(name)).dropDuplicates(["id"])
    actions = raw.where("fact = 'decorator'").where(F.substring_index("name", ".", -1) == "action").select(F.col("extra").alias("id")).distinct()
    for name in ("detail", "methods", "url_path"):
        actions = actions.join(option(name), "id", "left")
    actions = actions.withColumn("cls", F.regexp_replace("id", r"\.[^.]*$", "")).join(sets, "cls").withColumn("method", F.explode(facts.emitted_methods(F.split(F.coalesce("methods", F.lit("get")), ","))))
    tail = F.concat(urls.encode_literal(F.coalesce("url_path", F.substring_index("id", ".", -1))), F.lit("/"))
    return routes.unionByName(actions.select("method", F.concat(base, F.when(F.col("detail") == "True", F.lit("{}/")).otherwise(F.lit("")), tail).alias("template"), "id")).distinct()


def wrapped_calls(raw: DataFrame, bindings: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(method, template, anchor, service, id, line) of calls of declared wrapper functions. ``wrappers``: target (a definition's id), path_index, method_index, default_method, anchor, service."""
    full = F.when(F.col("rest") == "", F.col("target")).otherwise(F.concat_ws(".", "target", "rest"))
    calls = resolve(raw.where("fact = 'call' AND name IS NOT NULL").select("path", "id", "name", "scope", "line", F.col("value").alias("first"), F.col("extra").alias("second")), bindings).withColumn("to", full)
    at = lambda i: F.when(F.col(i) == 0, F.col("first")).when(F.col(i) == 1, F.col("second"))
    known = calls.join(wrappers.withColumnRenamed("target", "to"), "to").withColumn("url", urls.cut_query(at("path_index")))
    whole = F.col("url").startswith("/") & ~F.col("url").rlike(r"[^/]￼|￼[^/]")
    template = F.replace(urls.remove_dot_segments(urls.normalize_path(F.col("url"))), F.lit("%EF%BF%BC"), F.lit("{}"))
    return known.select(F.upper(F.coalesce(at("method_index"), "default_method")).alias("method"), F.when(whole, template).alias("template"), "anchor", "service", "id", "line")


def unresolved_wrappers(wrappers: DataFrame, calls: DataFrame, defs: DataFrame) -> DataFrame:
    """(target, calls) of declarations that name nothing, or that nothing calls. ``calls``: target of each call."""
    used = calls.groupBy("target").agg(F.count("*").alias("calls"))
    there = wrappers.select("target").join(defs.select(F.col("id").alias("target"), F.lit(1).alias("known")), "target", "left").join(used, "target", "left")
    return there.where("known IS NULL OR calls IS NULL").select("target", F.coalesce("calls", F.lit(0)).alias("calls"))
