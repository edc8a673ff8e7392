"""Diagrams for results of connectors: an envelope in JSON becomes the text of a star, a tree or a schema diagram.

Every connector's actions are rows of a plan-time table of expressions, so a table of envelopes of all kinds is decorated in
one projection. Envelopes that did not succeed, or have nothing to draw, yield null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.functions.text import escape_label, node_id, package_dependencies, requirements

# How many items a diagram draws.
ISSUES, RESULTS, DEPENDENCIES = 40, 30, 40
ROUND, BOX, STADIUM = ('("', '")'), ('["', '"]'), ('(["', '"])')


def at(env: Column, path: str) -> Column:
    return F.get_json_object(env, f"$.{path}")


def given(env: Column, path: str, default: str) -> Column:
    return F.coalesce(F.when(at(env, path) != "", at(env, path)), F.lit(default))


def items(env: Column, path: str) -> Column:
    """The list at a path as an array of maps; scalars become maps with one key."""
    raw = at(env, path)
    maps = F.from_json(raw, "array<map<string,string>>")
    return F.when(raw.rlike(r"^\s*\[\s*\{"), maps).otherwise(F.transform(F.from_json(raw, "array<string>"), lambda x: F.create_map(F.lit("value"), x)))


def node(i: Column, label: Column, shape=BOX) -> Column:
    return F.concat(F.lit("  "), node_id(i), F.lit(shape[0]), escape_label(label), F.lit(shape[1]))


def star(direction: str, title: Column, root: Column, root_label: Column, ids: Column, labels: Column, shape=BOX) -> Column:
    """struct(title, text) of a root and its leaves; null without leaves."""
    pairs = F.arrays_zip(ids.alias("i"), labels.alias("l"))
    nodes = F.array_join(F.transform(pairs, lambda p: node(p["i"], p["l"], shape)), "\n")
    edges = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("  "), node_id(root), F.lit(" --> "), node_id(i))), "\n")
    text = F.concat_ws("\n", F.lit(f"graph {direction}"), node(root, root_label, ROUND), nodes, edges)
    return F.when(F.size(ids) > 0, F.struct(title.alias("title"), text.alias("text")))


def indexed(prefix: str, a: Column) -> Column:
    return F.transform(a, lambda x, i: F.concat(F.lit(prefix), i.cast("string")))


def field(x: Column, name: str, default: Column) -> Column:
    return F.coalesce(x[name], default)


def engine_label(name: Column, engine: Column, more: Column, sep: str) -> Column:
    e, m = F.coalesce(engine, F.lit("")), F.coalesce(more, F.lit(""))
    return F.when((e == "") & (m == ""), name).otherwise(F.concat(name, F.lit(" ("), e, F.when(m != "", F.concat(F.lit(sep), m)).otherwise(F.lit("")), F.lit(")")))


def issue_tree(env: Column) -> Column:
    """Issues under their status, statuses in order of appearance."""
    a = items(env, "data.issues")
    status = lambda x: F.coalesce(F.when(x["status"] != "", x["status"]), F.lit("unknown"))
    label = lambda x, i: F.concat(field(x, "key", F.concat(F.lit("I"), i.cast("string"))), F.when(F.coalesce(x["summary"], F.lit("")) != "", F.concat(F.lit(": "), F.substring(x["summary"], 1, 40))).otherwise(F.lit("")))
    kinds = F.array_distinct(F.transform(a, status))
    order = F.flatten(F.transform(kinds, lambda k: F.transform(F.filter(a, lambda x: status(x) == k), lambda x: F.struct(k.alias("k"), x.alias("x")))))
    drawn = F.slice(order, 1, ISSUES)
    shown = F.array_distinct(F.transform(drawn, lambda d: d["k"]))
    sid = lambda k: F.concat(F.lit("s"), (F.array_position(shown, k) - 1).cast("string"))
    parts = F.concat(F.array(node(F.lit("root"), F.lit("Issues"), ROUND)), F.transform(shown, lambda k: node(sid(k), k)), F.transform(drawn, lambda d, i: node(F.concat(F.lit("i"), i.cast("string")), label(d["x"], i))), F.transform(shown, lambda k: F.concat(F.lit("  root --> "), sid(k))), F.transform(drawn, lambda d, i: F.concat(F.lit("  "), sid(d["k"]), F.lit(" --> i"), i.cast("string"))))
    return F.when(F.size(a) > 0, F.struct(F.lit("Issue Status Tree").alias("title"), F.concat(F.lit("graph TB\n"), F.array_join(parts, "\n")).alias("text")))


def page_tree(env: Column) -> Column:
    """Pages under their space; pages without a space are left out where there are several spaces."""
    a = items(env, "data.pages")
    keys = F.array_distinct(F.filter(F.transform(a, lambda x: F.coalesce(x["space_key"], F.lit(""))), lambda k: k != ""))
    top = F.slice(a, 1, RESULTS)
    title = lambda x, i: F.substring(field(x, "title", F.concat(F.lit("page "), i.cast("string"))), 1, 60)
    single = star("TB", F.lit("Page Hierarchy"), F.lit("space"), F.coalesce(F.get(keys, 0), F.lit("Results")), indexed("p", top), F.transform(top, title))
    sid = lambda k: F.concat(F.lit("s"), (F.array_position(keys, k) - 1).cast("string"))
    with_key = F.filter(F.transform(top, lambda x, i: F.struct(F.coalesce(x["space_key"], F.lit("")).alias("k"), title(x, i).alias("t"), i.alias("i"))), lambda p: F.array_contains(keys, p["k"]))
    pid = lambda p: F.concat(F.lit("p"), p["i"].cast("string"))
    parts = F.concat(F.transform(keys, lambda k: node(sid(k), k, ROUND)), F.transform(with_key, lambda p: node(pid(p), p["t"])), F.transform(with_key, lambda p: F.concat(F.lit("  "), sid(p["k"]), F.lit(" --> "), pid(p))))
    many = F.struct(F.lit("Page Hierarchy").alias("title"), F.concat(F.lit("graph TB\n"), F.array_join(parts, "\n")).alias("text"))
    return F.when(F.size(a) > 0, F.when(F.size(keys) <= 1, single).otherwise(many))


def schema_diagram(env: Column) -> Column:
    tables = F.from_json(at(env, "tables"), "array<struct<name:string,columns:array<struct<name:string,data_type:string,is_primary_key:boolean>>>>")
    column = lambda c: F.concat(F.lit("    "), F.regexp_replace(F.coalesce(F.when(c["data_type"] != "", c["data_type"]), F.lit("string")), r"\W+", "_"), F.lit(" "), node_id(c["name"]), F.when(c["is_primary_key"], F.lit(" PK")).otherwise(F.lit("")))
    body = F.array_join(F.transform(tables, lambda t: F.concat(F.lit("  "), node_id(t["name"]), F.lit(" {\n"), F.array_join(F.transform(t["columns"], column), "\n"), F.lit("\n  }"))), "\n")
    return F.when(F.size(tables) > 0, F.struct(F.lit("Database Schema").alias("title"), F.concat(F.lit("erDiagram\n"), body).alias("text")))


def diagram(connector: Column, env: Column) -> Column:
    """struct(title, text) for an envelope of a connector."""
    ok = at(env, "status") == "success"
    action = at(env, "action")
    region, project = given(env, "data.region", "region"), given(env, "data.project_id", "project")
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    fns, buckets, svcs, topics = items(env, "data.functions"), items(env, "data.buckets"), items(env, "data.services"), items(env, "data.topics")
    db, instance = given(env, "data.db_identifier", "db"), given(env, "data.instance_id", "instance")
    deps = F.slice(F.when(F.lower(at(env, "data.path")).endswith("package.json"), package_dependencies(at(env, "data.content"))).when(F.lower(at(env, "data.path")).endswith("requirements.txt"), requirements(at(env, "data.content"))), 1, DEPENDENCIES)
    found = F.slice(items(env, "data.results"), 1, RESULTS)
    base = given(env, "data.database_id", "database")
    short = F.when(F.length(base) > 8, F.concat(F.substring(base, 1, 8), F.lit("…"))).otherwise(base)
    page = F.substring(given(env, "data.title", "page"), 1, 60)
    space = given(env, "data.space_key", "")
    lone = F.struct(F.lit("Page Hierarchy").alias("title"), F.concat(F.lit("graph TB\n"), node(F.lit("page"), page)).alias("text"))
    rows: list[tuple[str, str, Column]] = [
        ("aws", "list_functions", star("TB", say("AWS Lambda Functions — ", region), say("region_", region), say("Region: ", region), F.transform(fns, lambda x: say("fn_", x["name"])), F.transform(fns, lambda x: say(x["name"], " (", F.coalesce(F.when(x["runtime"] != "", x["runtime"]), F.lit("unknown")), ")")))),
        ("aws", "describe_db", star("TB", say("AWS RDS — ", db), say("region_", region), say("Region: ", region), F.array(say("db_", db)), F.array(engine_label(db, at(env, "data.engine"), at(env, "data.instance_class"), ", ")), STADIUM)),
        ("aws", "list_buckets", star("TB", F.lit("AWS S3 Buckets"), F.lit("account"), F.lit("AWS Account"), F.transform(buckets, lambda x: say("bucket_", x["name"])), F.transform(buckets, lambda x: x["name"]))),
        ("gcp", "list_services", star("TB", say("GCP Services — ", project), say("proj_", project), say("Project: ", project), indexed("svc_", svcs), F.transform(svcs, lambda x: F.coalesce(F.when(x["title"] != "", x["title"]), x["name"])))),
        ("gcp", "describe_db", star("TB", say("GCP Cloud SQL — ", instance), say("proj_", project), say("Project: ", project), F.array(say("db_", instance)), F.array(engine_label(instance, at(env, "data.engine"), at(env, "data.version"), " ")), STADIUM)),
        ("gcp", "list_topics", star("TB", say("GCP Pub/Sub Topics — ", project), say("proj_", project), say("Project: ", project), indexed("topic_", topics), F.transform(topics, lambda x: x["value"]))),
        ("jira", "jql_search", issue_tree(env)),
        ("confluence", "cql_search", page_tree(env)),
        ("confluence", "get_page", F.when(space != "", star("TB", F.lit("Page Hierarchy"), F.lit("space"), space, F.array(F.lit("page")), F.array(page))).otherwise(lone)),
        ("notion", "search", star("TB", F.lit("Notion Search Hierarchy"), F.lit("root"), F.lit("Search Results"), indexed("r", found), F.transform(found, lambda x, i: say(F.substring(field(x, "object_type", F.lit("page")), 1, 20), " ", F.substring(field(x, "id", say("r", i.cast("string"))), 1, 8))))),
        ("notion", "query_database", star("TB", F.lit("Notion Page Tree"), F.lit("db"), say("DB ", short), indexed("p", found), F.transform(found, lambda x, i: F.substring(field(x, "title", say("row ", i.cast("string"))), 1, 60)))),
        ("github", "get_file", star("LR", F.lit("Dependency Graph"), F.lit("root"), given(env, "data.path", "repo"), indexed("dep_", deps), deps)),
    ]
    out = F.when((connector == "db") & (at(env, "status") == "ok"), schema_diagram(env))
    for name, what, made in rows:
        out = out.when((connector == name) & ok & (action == what), made)
    return out


def decorate(results: DataFrame) -> DataFrame:
    """results (connector, envelope, error) and ``diagram``; rows with an error pass as they are."""
    return results.withColumn("diagram", F.when(F.col("error").isNull(), diagram(F.col("connector"), F.col("envelope"))))
