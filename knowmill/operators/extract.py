"""Facts from source files by profiles: endpoints, clients, queues, entities, external sources, services.

Profiles are plan parameters. Built-in ones are rules on the calls that a file makes; a user's own ones may be expressions over
lines. Both stand behind a test for the profile's markers on the whole file. Entities need offsets over lines and use a vectorised function that holds one batch of files.
"""

from __future__ import annotations

import glob as globs
import os
import re
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowmill.functions.code import with_calls
from knowmill.functions.paths import concat_prefix, http_verb, looks_like_url_or_path, matches_any, some, url_host
from knowmill.functions.text import redact_credentials
from knowmill.operators.discovery import library_deps, services
from knowmill.operators.page_graph import cut
from knowmill.operators.registry import classify
from knowmill.profiles.builtin import BUILTIN

# Configuration and source files, addresses of databases, and marks of cloud clients.
CONFIG_FILES = ["**/application*.yml", "**/application*.yaml", "**/application*.properties", "**/bootstrap*.yml", "**/bootstrap*.yaml", "**/*.env", ".env"]
SOURCE_FILES = ["**/*.java", "**/*.kt", "**/*.ts", "**/*.js", "**/*.py", "**/*.go", "**/*.cs"]
DB_URL = r"(?i)(jdbc:[^\s\"']+|(?:postgres|postgresql|mysql|mariadb|mongodb(?:\+srv)?|redis|rediss|sqlserver|oracle|r2dbc)://[^\s\"']*)"
CLOUD = {"aws": r"software\.amazon\.awssdk|com\.amazonaws|@aws-sdk/|aws-sdk|boto3|aws-sdk-go|Amazon\.(?:S3|DynamoDB)", "gcp": r"com\.google\.cloud|@google-cloud/|google\.cloud|cloud\.google\.com/go|Google\.Cloud"}


#: The name of a public class that ends with Controller, without that ending.
CONTROLLER = r"(?m)^[^/*\n]*\bpublic\b[^{;\n]*\bclass\s+(\w+?)Controller\b"


def load_profiles(kind: str, folder: str | None = None, only: list[str] | None = None) -> list[dict]:
    """Built-in profiles of a kind and those of a folder; a later one of the same name replaces the earlier."""
    found = {p["name"]: p for p in BUILTIN[kind]}
    for path in sorted(globs.glob(os.path.join(folder, "*.yaml"))) if folder else []:
        with open(path) as f:
            p = yaml.safe_load(f)
        found[p["name"]] = check_profile(p)
    return [p for n, p in found.items() if only is None or n in only]


def check_profile(p: dict) -> dict:
    """A profile with its expressions compiled once, so that a bad one fails here and names its profile."""
    for key in ("name", "file_patterns", "markers"):
        if not p.get(key):
            raise ValueError(f"profile {p.get('name')!r} has no {key}")
    for x in [*[q["regex"] for q in p.get("patterns", [])], *[p[k] for k in ("class", "table", "column", "schema", "prefix") if p.get(k)]]:
        try:
            re.compile(x)
        except re.error as e:
            raise ValueError(f"profile {p['name']!r}: {x!r}: {e}") from e
    return p


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """(path, line, text) with 1-based line numbers."""
    return files.select("path", *keep, F.posexplode(F.split("content", "\n")).alias("_n", "text")).select("path", *keep, (F.col("_n") + 1).alias("line"), "text")


def has_marker(p: dict) -> Column:
    out = F.lit(False)
    for m in p["markers"]:
        out = out | F.col("content").contains(m)
    return out


def group(regex: str, n: int) -> Column:
    return F.regexp_extract("text", regex, n)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def taken(q: dict, text: Column, n: int, default: str = "") -> Column:
    """Group n of a match, or the default for group 0."""
    return F.regexp_extract(text, ("(?s)" if q.get("multiline") else "") + q["regex"], n) if n else F.lit(default)


def multiline_hits(files: DataFrame, q: dict, n: int) -> DataFrame:
    """files and (line, text) of each match of a pattern over the whole content; the line is that of group n. Matches are set
    apart by control characters, so their places follow from the parts before them."""
    regex, open_, close = "(?s)" + q["regex"], "\u0001", "\u0002"
    parts = F.split(F.regexp_replace("content", regex, f"{open_}$0{close}"), open_)
    each = files.where(F.col("content").rlike(regex)).select("*", parts.alias("parts"), F.posexplode(parts).alias("k", "part")).where("k > 0")
    each = each.withColumn("text", F.substring_index("part", close, 1))
    inner = F.substring(F.col("text"), F.lit(1), F.greatest(F.instr("text", F.regexp_extract("text", regex, n)) - 1, F.lit(0)))
    before = F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("k")), ""), inner)
    return each.withColumn("line", F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).drop("parts", "k", "part")


def on(profiles: list[dict]) -> Column:
    """Which profiles apply to a file."""
    return F.array(*[matches_any("path", p["file_patterns"]) & has_marker(p) for p in profiles])


def argument(args: Column, keys: Column, pos: Column, accept) -> Column:
    """The first argument that has one of the keys, or stands at a place without a key, and is acceptable."""
    return F.get(F.filter(args, lambda a: (F.array_contains(keys, a["key"]) | ((a["key"] == "") & (a["pos"] == pos))) & accept(a)), 0)


def file_setting(r: dict) -> Column:
    """The value that the first call of a rule in the file has; "" if there is none."""
    value = lambda c: argument(c["args"], F.array(*[F.lit(k) for k in r["keys"]]).cast("array<string>"), F.lit(r["pos"]), lambda a: a["kind"] == "text")["value"]
    owned = lambda c: F.lit(True) if not r["owners"] else some_true([c["owner"].endswith(o) for o in r["owners"]])
    called = lambda c: F.lit(True) if "" in r["names"] else c["name"].isin(*r["names"])
    aimed = lambda c: c["target"].endswith(r.get("target", ""))
    return F.coalesce(value(F.get(F.filter("_calls", lambda c: called(c) & owned(c) & aimed(c) & value(c).isNotNull()), 0)), F.lit(""))


def some_true(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


RULE = "i int, framework string, name string, what string, owners array<string>, sep string, keys array<string>, pos int, verb_pos int, verb_key string, after string, without string, optional boolean, least int, most int, word boolean"
HIT = ("file", "line", "framework", "what", "value", "is_name")


def call_hits(files: DataFrame, profiles: list[dict], settings: tuple[str, ...]) -> DataFrame:
    """HIT and the settings of calls that a rule of a profile names. The calls of a file are found once, where the file is read;
    rules are rows, joined by the call's name. They are parameters of the plan, some hundreds, and so are broadcast."""
    at = [F.array(*[file_setting(p["settings"][k]) if k in p.get("settings", {}) else F.lit("") for p in profiles]).alias(k) for k in settings]
    f = files.select("path", "content", on(profiles).alias("_on")).where(F.exists("_on", lambda x: x))
    f = with_calls(f)
    each = f.select("path", "_on", *at, F.explode("_calls").alias("c"))
    rows = [(i, p["name"], name, what, *[q[k] for k in RULE_KEYS]) for i, p in enumerate(profiles) for q in p["rules"] for name, what in q["names"].items()]
    rules = F.broadcast(files.sparkSession.createDataFrame(rows, RULE))
    j = each.withColumn("name", F.explode(F.array("c.name", F.lit("")))).join(rules, "name").where(F.get("_on", F.col("i")) & (F.col("sep") == F.col("c.sep")))
    owner = (F.size("owners") == 0) | F.exists("owners", lambda o: F.when(o == "*", F.col("c.owner") != "").otherwise(F.col("c.owner").endswith(o)))
    args = F.col("c.args")
    n = F.coalesce(F.array_max(F.transform(args, lambda a: a["pos"])), F.lit(-1)) + 1
    value = argument(args, F.col("keys"), F.col("pos"), lambda a: (a["kind"] == "text") | (F.col("word") & (a["kind"] == "word") & a["value"].rlike("^[A-Z]")))
    verb = argument(args, F.when(F.col("verb_key") != "", F.array("verb_key")), F.col("verb_pos"), lambda a: a["key"].isNotNull())
    tail = F.when((F.col("after") != "") & F.contains(verb["value"], F.col("after")), F.call_function("substring_index", verb["value"], F.col("after"), F.lit(-1))).when(verb["kind"] == "text", verb["value"])
    told = F.upper(F.regexp_extract(F.coalesce(tail, F.lit("")), r"^\w+", 0))
    asks = (F.col("verb_pos") >= 0) | (F.col("verb_key") != "")
    hit = j.where(owner & (n >= F.col("least")) & (n <= F.col("most"))).select("*", value.alias("v"), F.when(asks & (told != ""), told).otherwise(F.col("what")).alias("_what"))
    good = F.coalesce((F.col("v.value") != "") & ((F.col("without") == "") | ~F.contains(F.col("v.value"), F.col("without"))), F.col("optional"))
    return hit.where(good & (F.col("_what") != "")).select(
        F.col("path").alias("file"), F.coalesce("v.line", "c.line").alias("line"), "framework", F.col("_what").alias("what"), F.coalesce("v.value", F.lit("")).alias("value"), F.coalesce(F.col("v.kind") == "word", F.lit(False)).alias("is_name"), *[F.get(k, F.col("i")).alias(k) for k in settings]
    )


RULE_KEYS = [c.split(" ")[0] for c in RULE.split(", ")][4:]


def pattern_hits(files: DataFrame, profiles: list[dict], settings: tuple[str, ...], group_: str) -> DataFrame:
    """HIT and the settings of what the expressions of a user's own profiles match.

    Files are read once: a file's flags say which profiles apply, its lines are exploded once, and every pattern that applies
    yields its matches. Patterns over several lines look at whole files of their own profile."""
    pick = lambda k: F.array(*[F.regexp_extract("content", p[k], 1) if p.get(k) else F.lit("") for p in profiles])
    f = files.select("path", "content", on(profiles).alias("_on"), *[pick(k).alias(k) for k in settings]).where(F.exists("_on", lambda x: x))
    wide = f.select("path", "_on", *settings, F.posexplode(F.split("content", "\n")).alias("_n", "_text"))

    def made(i: int, p: dict, q: dict):
        what = lambda m: F.lit(q["role"]) if "role" in q else taken(q, m, q["method"], q.get("default", ""))
        return lambda m: F.struct(F.lit(p["name"]).alias("framework"), what(m).alias("what"), taken(q, m, q[group_]).alias("value"), F.lit(bool(q.get("resolve"))).alias("is_name"), *[F.get(k, i).alias(k) for k in settings])

    pairs = [(i, p, q) for i, p in enumerate(profiles) for q in p["patterns"]]
    found = [F.when(F.get("_on", i) & F.col("_text").rlike(q["regex"]), F.transform(F.regexp_extract_all("_text", F.lit(q["regex"]), 0), made(i, p, q))) for i, p, q in pairs if not q.get("multiline")]
    rows = [wide.select("path", (F.col("_n") + 1).alias("line"), F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("_m"))] if found else []
    for i, p, q in pairs:
        if q.get("multiline"):
            rows.append(multiline_hits(f.where(F.get("_on", i)), q, q[group_]).select("path", "line", made(i, p, q)(F.col("text")).alias("_m")))
    return union(rows).select(F.col("path").alias("file"), F.col("line").cast("int").alias("line"), "_m.*")


def profile_hits(files: DataFrame, profiles: list[dict], group_: str, settings: tuple[str, ...] = ()) -> DataFrame:
    """HIT and the settings: by rules on calls for profiles that have them, by expressions for the others."""
    ruled, others = [p for p in profiles if "rules" in p], [p for p in profiles if p.get("patterns")]
    out = ([call_hits(files, ruled, settings)] if ruled else []) + ([pattern_hits(files, others, settings, group_)] if others else [])
    return union(out).select(*HIT, *settings)


def rest_endpoints(files: DataFrame, profiles: list[dict] | None = None) -> DataFrame:
    """(framework, method, path, file, line), each once."""
    ps = profiles or load_profiles("rest")
    token = [p["name"] for p in ps if p.get("controller_token")]
    named = F.lower(F.regexp_extract("content", CONTROLLER, 1)) if token else F.lit("")
    h = profile_hits(files.select("path", "content"), ps, "path", ("prefix",))
    if token:
        whose = files.where(F.col("content").contains("[controller]")).select(F.col("path").alias("file"), named.alias("_name"))
        at = h.where(F.col("framework").isin(*token) & F.col("prefix").contains("[controller]"))
        rest = h.where(~(F.col("framework").isin(*token) & F.col("prefix").contains("[controller]")))
        at = at.join(whose, "file", "left").withColumn("prefix", F.when(F.col("_name") != "", F.expr("replace(prefix, '[controller]', _name)")).otherwise(F.col("prefix"))).drop("_name")
        h = rest.unionByName(at)
    raw, prefix = F.col("value"), F.col("prefix")
    path = F.when(raw.startswith("/") | (prefix == ""), raw).when(raw == "", prefix).otherwise(concat_prefix(prefix, raw))
    return h.select("framework", F.upper("what").alias("method"), path.alias("path"), "file", "line").distinct()


def http_clients(files: DataFrame, profiles: list[dict] | None = None) -> DataFrame:
    """(framework, method, target_ref, path, file, line) of calls that name an address or a path; what they reach is the
    call's own host, or else the address or service that the file sets for all its calls."""
    h = profile_hits(files, profiles or load_profiles("client"), "path", ("url", "service", "prefix"))
    path = F.when(F.col("prefix") != "", concat_prefix(F.col("prefix"), F.col("value"))).otherwise(F.col("value"))
    target = F.coalesce(some(url_host(F.col("value"))), some(F.col("url")), some(F.col("service")), F.lit(""))
    h = h.select("framework", http_verb("what").alias("method"), target.alias("target_ref"), path.alias("path"), "file", "line")
    h = h.where((F.col("method") != "") & (F.col("path") != "") & looks_like_url_or_path("path"))
    return h.dropDuplicates(["framework", "file", "line", "method", "path"])


def queue_endpoints(files: DataFrame, constants: DataFrame | None = None, profiles: list[dict] | None = None) -> DataFrame:
    """(framework, role, queue_name, file, line), each once; names of constants (name, value) are resolved, unknown ones stay."""
    found = profile_hits(files, profiles or load_profiles("queue"), "name").where(F.col("value") != "").withColumnsRenamed({"what": "role", "value": "raw"})
    if constants is None:
        return found.select("framework", "role", F.col("raw").alias("queue_name"), "file", "line").distinct()
    c = constants.select(F.col("name").alias("_name"), F.col("value").alias("_value"))
    j = found.withColumn("_name", F.when(F.col("is_name"), F.substring_index("raw", ".", -1))).join(c, "_name", "left")
    return j.select("framework", "role", F.coalesce("_value", "raw").alias("queue_name"), "file", "line").distinct()


def constants(files: DataFrame) -> DataFrame:
    """(name, value) of string constants; the last file and line win."""
    r = r"\b(?:static\s+final\s+String|const(?:\s+val)?|final\s+String)\s+([A-Z][A-Z0-9_]*)\s*(?::\s*\w+)?\s*=\s*[\"']([^\"']*)[\"']"
    rows = lines(files).where(F.col("text").rlike(r)).select(group(r, 1).alias("name"), group(r, 2).alias("value"), F.struct("path", "line").alias("at"))
    return rows.groupBy("name").agg(F.max_by("value", "at").alias("value"))


def properties(files: DataFrame) -> DataFrame:
    """(name, value) of .properties files; the last file and line win."""
    r = r"^\s*([\w.-]+)\s*[=:]\s*(.*?)\s*$"
    rows = lines(files.where(F.col("path").endswith(".properties"))).where(~F.col("text").rlike(r"^\s*[#!]") & F.col("text").rlike(r)).select(group(r, 1).alias("name"), group(r, 2).alias("value"), F.struct("path", "line").alias("at"))
    return rows.groupBy("name").agg(F.max_by("value", "at").alias("value"))


def resolve_references(refs: DataFrame, known: DataFrame, column: str = "ref") -> DataFrame:
    """refs and ``value``: "${key}tail" by property, CONST or Type.CONST by constant, other literals as they are; null where
    an interpolation or bare name is not known."""
    key = F.regexp_extract(column, r"^\$\{([^}:]+)[^}]*\}", 1)
    bare = F.when(F.col(column).rlike(r"^(?:\w+\.)*[A-Z][A-Z0-9_]*$"), F.substring_index(column, ".", -1))
    r = refs.withColumn("_k", F.coalesce(F.when(key != "", key), bare))
    j = r.join(known.select(F.col("name").alias("_k"), F.col("value").alias("_v")), "_k", "left")
    tail = F.regexp_replace(column, r"^\$\{[^}]*\}", "")
    return j.select(*refs.columns, F.when(F.col("_k").isNull(), F.col(column)).when(F.col(column).startswith("${"), F.concat("_v", tail)).otherwise(F.col("_v")).alias("value"))


def queue_bindings(files: DataFrame, constants: DataFrame | None = None) -> DataFrame:
    """(queue_name, exchange, routing_key, file, line), each once, of bind(...).to(...).with(...) chains and of @QueueBinding
    annotations, over any number of lines; the line is the first call's.

    An argument is a text, ``new X(text)``, a name or a call without arguments. The last two stand for the bean of that name in
    the file (``beans``), or else for a constant (name, value); what neither has is "". Bindings without a queue or an exchange
    go. A call names its places in the file's array, so chains are followed where the file is read; only the arguments that make a
    binding are shuffled, and those that are names are joined."""
    facts = cut(broker_facts(files))
    told = facts.where(F.col("role").isin("queue", "exchange", "key")).withColumn("_name", F.when(F.col("kind") != "text", F.regexp_replace("value", r"\(\)$", "")))
    of_text = told.where("_name is null").withColumn("value", F.when(F.col("kind") == "text", F.col("value")))
    j = told.where("_name is not null").drop("value").join(beans(facts).select("path", F.col("bean").alias("_name"), F.col("name").alias("value")), ["path", "_name"], "left")
    if constants is not None:
        j = j.withColumn("_last", F.substring_index("_name", ".", -1)).join(constants.select(F.col("name").alias("_last"), F.col("value").alias("_constant")), "_last", "left").withColumn("value", F.coalesce("value", "_constant"))
    j = j.select("path", "at", "line", "role", "value").unionByName(of_text.select("path", "at", "line", "role", "value"))
    of = lambda role: F.coalesce(F.max(F.when(F.col("role") == role, F.col("value"))), F.lit(""))
    b = j.groupBy(F.col("path").alias("file"), "at", "line").agg(of("queue").alias("queue_name"), of("exchange").alias("exchange"), of("key").alias("routing_key"))
    return b.where("queue_name <> '' AND exchange <> ''").select("queue_name", "exchange", "routing_key", "file", "line").distinct()


# The classes of queues and exchanges.
BROKER_CLASSES = ("Queue", "TopicExchange", "DirectExchange", "FanoutExchange")


def broker_facts(files: DataFrame) -> DataFrame:
    """(path, role, id, at, line, kind, value), each file being read through once: the queue, exchange or key that an argument names
    for the binding whose first call is ``at``; and for beans, heads (role head) and texts (role made) of queues and exchanges."""
    call = lambda k: F.get("_calls", k)
    is_ = lambda c, name: (c["name"] == name) & ~c["owner"].endswith("new")
    first = lambda c: F.get(F.filter(c["args"], lambda a: (a["pos"] == 0) & a["key"].isin("", "value")), 0)
    said = lambda c, k: F.when(first(c)["value"].startswith("new "), first(call(c["inner"]))[k]).otherwise(first(c)[k])
    fact = lambda role, x, at, kind, value: F.struct(F.lit(role).alias("role"), x["id"].alias("id"), at["id"].alias("at"), at["line"].alias("line"), kind.alias("kind"), value.alias("value"))

    def binding(x: Column) -> Column:
        up, over, key = call(x["receiver"]), call(x["parent"]), F.get(F.filter(x["args"], lambda a: a["key"] == "key"), 0)
        part = lambda role, at: fact(role, x, at, said(x, "kind"), said(x, "value"))
        chained = F.when(is_(x, "bind"), part("queue", x)).when(is_(x, "to") & is_(up, "bind"), part("exchange", up)).when(is_(x, "with") & is_(up, "to") & is_(call(up["receiver"]), "bind"), part("key", call(up["receiver"])))
        noted = chained.when(is_(x, "@Queue") & is_(over, "@QueueBinding"), part("queue", over)).when(is_(x, "@Exchange") & is_(over, "@QueueBinding"), part("exchange", over))
        return noted.when(is_(x, "@QueueBinding"), fact("key", x, x, key["kind"], key["value"]))

    def bean(x: Column) -> Column:
        text = F.get(x["args"], 0)
        made = x["name"].isin(*BROKER_CLASSES) & x["owner"].endswith("new") & (text["kind"] == "text")
        return F.when(made, fact("made", x, x, text["kind"], text["value"])).when(~made & x["type"].isin(*BROKER_CLASSES), fact("head", x, x, F.lit("word"), x["name"]))

    c = with_calls(files.select("path", "content").where(F.col("content").rlike("bind|@QueueBinding|@Bean")))
    facts = F.concat(F.transform("_calls", binding), F.transform("_calls", bean))
    return c.select("path", F.explode(F.filter(facts, lambda x: x["kind"].isNotNull())).alias("f")).select("path", "f.*")


def beans(facts: DataFrame) -> DataFrame:
    """(path, bean, name) from ``broker_facts``: a method of a queue's or exchange's class and the first text that its body makes
    one of; a head is a call whose name follows the class, a body runs to the next head."""
    rows = facts.where(F.col("role").isin("head", "made")).select("path", "id", F.when(F.col("role") == "made", F.col("value")).alias("name"), F.when(F.col("role") == "head", F.col("value")).alias("bean"))
    each = rows.withColumn("bean", F.last("bean", True).over(Window.partitionBy("path").orderBy("id"))).where("bean IS NOT NULL AND name IS NOT NULL")
    return each.groupBy("path", "bean").agg(F.min_by("name", "id").alias("name"))


def bean_names(files: DataFrame) -> DataFrame:
    """(bean, name) of ``beans``."""
    return beans(broker_facts(files)).select("bean", "name")


def code_clients(files: DataFrame, patterns: tuple[tuple[str, str], ...] = (("gather", r"\bgather\s*\("), ("fetchWithCaps", r"\bfetchWithCaps\s*\("))) -> DataFrame:
    rows = lines(files.where(matches_any("path", ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.mjs", "**/*.cjs", "**/*.py"])))
    return union([rows.where(F.col("text").rlike(p)).select(F.lit(k).alias("kind"), F.col("path").alias("file"), "line") for k, p in patterns])


def external_sources(files: DataFrame) -> DataFrame:
    """(kind, detail, connector_id, configured, file, line): database addresses in configuration, cloud clients in code;
    one of a kind for each line."""
    db = lines(files.where(matches_any("path", CONFIG_FILES))).select("path", "line", F.get(F.regexp_extract_all("text", F.lit(DB_URL), 1), 0).alias("url")).where("url is not null")
    out = [db.select(F.lit("database").alias("kind"), redact_credentials("url").alias("detail"), classify(F.col("url")).alias("connector_id"), F.lit(False).alias("configured"), F.col("path").alias("file"), "line")]
    code = lines(files.where(matches_any("path", SOURCE_FILES)))
    for kind, r in CLOUD.items():
        out.append(code.where(F.col("text").rlike(r)).select(F.lit(kind).alias("kind"), F.regexp_extract("text", f"({r})", 1).alias("detail"), F.lit(kind).alias("connector_id"), F.lit(False).alias("configured"), F.col("path").alias("file"), "line"))
    return union(out)


def detect_orm(files: DataFrame, profiles: list[dict] | None = None) -> DataFrame:
    """(profile, score): markers that any file holds as they stand; one pass over the files."""
    ps = profiles or load_profiles("orm")
    flags = [F.max(F.col("content").contains(m).cast("int")).alias(f"{i}_{j}") for i, p in enumerate(ps) for j, m in enumerate(p["markers"])]
    row = files.agg(*flags)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p["name"]).alias("profile"), sum((F.coalesce(F.col(f"{i}_{j}"), F.lit(0)) for j in range(len(p["markers"]))), F.lit(0)).alias("score")) for i, p in enumerate(ps)]))
    return row.select(rows.alias("x")).select("x.*").where("score > 0").orderBy(F.desc("score"), "ord").select("profile", "score")


ENTITY = "class_name string, table_name string, schema_name string, source_file string, columns array<string>, relationships array<struct<type:string,target_entity:string,through_table:string>>"


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def through_of(tail: str) -> str:
    """The junction table named within the call that just opened."""
    depth, end = 1, len(tail)
    for i, c in enumerate(tail):
        depth += (c == "(") - (c == ")")
        if not depth:
            end = i
            break
    m = re.search(r"secondary\s*=\s*['\"]?([\w.]+)", tail[:end])
    return m[1] if m else ""


def target_of(tail: str) -> str:
    for r in (r"=>\s*([A-Z]\w*)", r"^\s*['\"]?([A-Z]\w*)", r"<\s*([A-Z]\w*)\s*>", r"(?:private|public|protected)\s+([A-Z]\w*)\s+\w+"):
        if m := re.search(r, tail):
            return m[1]
    return ""


def entities_of(path: str, content: str, p: dict) -> list[tuple]:
    found = list(re.finditer(p["class"], content, re.M))
    out = []
    for k, m in enumerate(found):
        text = content[m.start() : found[k + 1].start() if k + 1 < len(found) else len(content)]
        t = re.search(p["table"], text, re.S) if p.get("table") else None
        s = re.search(p["schema"], text, re.S) if p.get("schema") else None
        name = t[1] if t else {"snake_case": snake(m[1]), "snake_case_plural": snake(m[1]) + "s", "lower_case": m[1].lower()}.get(p.get("table_from_class", ""), m[1])
        columns = list(dict.fromkeys(c[1] for c in re.finditer(p["column"], text))) if p.get("column") else []
        rel = []
        for q in p.get("relationships", []):
            for r in re.finditer(q["regex"], text):
                tail = text[r.end() : r.end() + 300]
                through = through_of(tail)
                rel.append({"type": "many_to_many" if through else q["type"], "target_entity": target_of(tail), "through_table": through})
        out.append((m[1], name, s[1] if s else "", path, columns, rel))
    return out


def orm_entities(files: DataFrame, profile: dict) -> DataFrame:
    """Entities of each class: its text runs to the next class."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [e for path, content in zip(p["path"], p["content"], strict=True) for e in entities_of(path, content or "", profile)]
            yield pd.DataFrame(rows, columns=["class_name", "table_name", "schema_name", "source_file", "columns", "relationships"])

    return files.where(matches_any("path", profile["file_patterns"])).select("path", "content").mapInPandas(run, ENTITY)


def class_windows(matches: DataFrame) -> DataFrame:
    """matches (file, start, name, length) and where each one's text ends: at the next match or the end of the file."""
    w = Window.partitionBy("file").orderBy("start")
    return matches.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("length")))


def of_service(facts: DataFrame, services_: DataFrame, column: str = "file") -> DataFrame:
    """facts and service_id: the deepest root above the file."""
    from knowmill.functions.paths import ancestors

    f = cut(facts.withColumn("_row", F.monotonically_increasing_id()))
    hit = f.select("_row", F.explode(ancestors(column)).alias("root")).join(services_.select("root", "id"), "root").groupBy("_row").agg(F.max_by("id", F.length("root")).alias("service_id"))
    return f.join(hit, "_row").drop("_row")


# Where a resource server names the issuer of its tokens.
ISSUERS = ("spring.security.oauth2.resourceserver.jwt.issuer-uri", "spring.security.oauth2.resourceserver.jwt.issuer_uri")


def yaml_properties(files: DataFrame) -> DataFrame:
    """(path, name, value) of the scalars in YAML files, by dotted name; broken documents have none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def walk(x, at: str):
            if isinstance(x, dict):
                for k, v in x.items():
                    yield from walk(v, f"{at}.{k}" if at else str(k))
            elif x is not None and not isinstance(x, list):
                yield at, str(x).lower() if isinstance(x, bool) else str(x)

        for p in parts:
            rows = []
            for path, content in zip(p["path"], p["content"], strict=True):
                try:
                    rows += [(path, k, v) for d in yaml.safe_load_all(content or "") for k, v in walk(d, "")]
                except yaml.YAMLError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "name", "value"])

    return files.where(F.col("path").rlike(r"(^|/)(application|bootstrap)[^/]*\.ya?ml$")).select("path", "content").mapInPandas(run, "path string, name string, value string")


def auth_issuers(files: DataFrame, services_: DataFrame) -> DataFrame:
    """(service_id, issuer) of services that name the issuer of their tokens, in properties or YAML."""
    r = r"^\s*([\w.-]+)\s*[=:]\s*(.*?)\s*$"
    plain = lines(files.where(F.col("path").endswith(".properties"))).where(F.col("text").rlike(r)).select("path", group(r, 1).alias("name"), group(r, 2).alias("value"))
    hit = plain.unionByName(yaml_properties(files)).where(F.col("name").isin(*ISSUERS) & (F.col("value") != ""))
    rank = F.array_position(F.array(*[F.lit(x) for x in ISSUERS]), F.col("name"))
    return of_service(hit.withColumnRenamed("path", "file"), services_).groupBy("service_id").agg(F.max_by("value", F.struct(-rank, F.col("file"))).alias("issuer"))


def inventory(files: DataFrame, gitmodules: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of an inventory. ``ord`` is the place of a service among the ids, of which there are few."""
    s = cut(services(files, gitmodules).withColumn("ord", F.row_number().over(Window.orderBy("id", "root"))))
    known_constants = constants(files)
    rest, clients, queues = rest_endpoints(files), http_clients(files), queue_endpoints(files, known_constants)
    orm = union([orm_entities(files.where(has_marker(p)), p) for p in load_profiles("orm")])
    known = properties(files)
    target = resolve_references(of_service(clients, s).withColumn("ref", F.when(F.col("target_ref").startswith("${"), F.col("target_ref"))), known).withColumnRenamed("value", "resolved_target").drop("ref")
    return {
        "services": s,
        "rest_endpoints": of_service(rest, s),
        "http_clients": target,
        "queue_endpoints": of_service(queues, s).withColumn("message_type", F.lit("")),
        "queue_bindings": of_service(queue_bindings(files, known_constants), s),
        "orm_entities": of_service(orm, s, "source_file"),
        "external_sources": of_service(external_sources(files), s),
        "library_deps": library_deps(files, s),
        "auth_issuers": auth_issuers(files, s),
    }


def symbol_plan(spark, profiles: list[dict] | None = None) -> DataFrame:
    """(profile, language, kind, pattern, file_pattern, relationship_type): what to look up, a row for each expression of a
    profile and each of its file patterns."""
    rows = []
    for p in profiles or load_profiles("orm"):
        asks = [("entity_class", p.get("class"), None), ("table_name", p.get("table"), None), ("column", p.get("column"), None), *[("relationship", q["regex"], q["type"]) for q in p.get("relationships", [])]]
        rows += [(p["name"], p.get("language") or "", kind, pattern, file, relation) for kind, pattern, relation in asks if pattern for file in p["file_patterns"]]
    return spark.createDataFrame(rows, "profile string, language string, kind string, pattern string, file_pattern string, relationship_type string")
