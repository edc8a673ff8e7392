"""The service graph: calls, queues, tables, libraries and external sources joined into typed edges.

Inputs are the flat tables of an inventory; ``ord`` is the order of rows where the first of several counts. Profiles,
services and their names are small against clients and endpoints, so joins on names are left to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowmill.functions.paths import candidates, ext_host, is_synthetic, normalize_path, path_matches, table_key

EDGE = ("from_service", "to_service", "kind", "detail", "confidence", "evidence_file", "evidence_line")


def names(services: DataFrame) -> DataFrame:
    """(name, id, ord): a service's id and aliases in lower case; the first service has a name."""
    n = services.select("id", "ord", F.explode(F.array_distinct(F.transform(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.lower(x)))).alias("name"))
    return n.groupBy("name").agg(F.min_by("id", "ord").alias("id"), F.min("ord").alias("ord"))


def resolved(clients: DataFrame, services: DataFrame) -> DataFrame:
    """clients (with ``row``) and target_id, via_ref: the reference that resolves first; of its candidates, the first service."""
    n = names(services)
    refs = F.array(F.struct(F.lit(0).alias("p"), F.coalesce("resolved_target", "target_ref").alias("r")), F.struct(F.lit(1).alias("p"), F.col("target_ref").alias("r")), F.struct(F.lit(2).alias("p"), F.col("path").alias("r")))
    each = clients.select("row", F.explode(refs).alias("x")).select("row", "x.p", F.explode(candidates(F.col("x.r"))).alias("name"))
    hit = each.join(n, "name").groupBy("row").agg(F.min_by(F.struct("p", "ord", "id"), F.struct("p", "ord")).alias("t"))
    return clients.join(hit, "row", "left").select(clients["*"], F.col("t.id").alias("target_id"), (F.col("t.p") < 2).alias("via_ref"))


def numbered(df: DataFrame) -> DataFrame:
    """A number for each row, from its place in the input."""
    return df if "row" in df.columns else df.withColumn("row", F.monotonically_increasing_id())


def client_edges(clients: DataFrame, services: DataFrame, endpoints: DataFrame) -> DataFrame:
    """calls of resolved clients, external sources of the others."""
    from knowmill.operators.page_graph import cut

    c = resolved(cut(numbered(clients)), services).withColumn("np", normalize_path("path"))
    e = endpoints.select(F.col("service_id").alias("e_service"), F.upper("method").alias("e_method"), F.split(normalize_path("path"), "/").alias("parts"), normalize_path("path").alias("e_path")).distinct()
    wide = c.where(F.col("target_id").isNotNull() & (F.col("target_id") != F.col("service_id")))
    # equal segment counts make a hash key of what would be a nested loop
    on = (F.col("target_id") == F.col("e_service")) & (F.upper("method") == F.col("e_method")) & (F.size(F.split("np", "/")) == F.size("parts")) & path_matches("np", "e_path")
    matched = wide.join(e, on, "left_semi").select("row").withColumn("matched", F.lit(True))
    calls = wide.join(matched, "row", "left").withColumn("matched", F.coalesce("matched", F.lit(False))).where(F.col("via_ref") | F.col("matched"))
    calls = calls.select("row", F.col("service_id").alias("from_service"), F.col("target_id").alias("to_service"), F.lit("calls").alias("kind"), F.concat_ws(" ", "method", "np").alias("detail"), F.when(F.col("matched"), "high").otherwise("medium").alias("confidence"), F.col("file").alias("evidence_file"), F.col("line").alias("evidence_line"))
    host = F.coalesce(F.when(ext_host("target_ref") != "", ext_host("target_ref")), ext_host("path"))
    out = c.where(F.col("target_id").isNull()).withColumn("host", host).where(F.col("host") != "")
    out = out.select("row", F.col("service_id").alias("from_service"), F.concat(F.lit("ext:http:"), "host").alias("to_service"), F.lit("external_source").alias("kind"), F.concat_ws(" ", F.lit("http"), "method", "host").alias("detail"), F.lit("medium").alias("confidence"), F.col("file").alias("evidence_file"), F.col("line").alias("evidence_line"))
    return calls.unionByName(out)


def first_edges(edges: DataFrame) -> DataFrame:
    """Of edges that agree in ends, kind and detail, the first (by ``row``)."""
    return edges.groupBy("from_service", "to_service", "kind", "detail").agg(F.min_by(F.struct("confidence", "evidence_file", "evidence_line"), "row").alias("x")).select("from_service", "to_service", "kind", "detail", "x.*")


def edge(row: Column, a, b, kind: str, detail, file="file", line="line", confidence: str = "high") -> list[Column]:
    return [row.alias("row"), a.alias("from_service"), b.alias("to_service"), F.lit(kind).alias("kind"), detail.alias("detail"), F.lit(confidence).alias("confidence"), (F.col(file) if isinstance(file, str) else file).alias("evidence_file"), (F.col(line) if isinstance(line, str) else line).cast("bigint").alias("evidence_line")]


def queue_edges(endpoints: DataFrame, bindings: DataFrame) -> DataFrame:
    """produces and consumes; a producer reaches its own queue, and queues bound by that routing key or exchange."""
    q = numbered(endpoints)
    bound = bindings.where(F.col("queue_name") != "")
    by = lambda key: bound.where(F.col(key) != "").select(F.col(key).alias("name"), F.col("queue_name").alias("queue"))
    bridge = by("routing_key").union(by("exchange")).distinct()
    made = q.where(F.col("role") == "producer")
    own = made.select("row", "service_id", "file", "line", F.col("queue_name").alias("queue"))
    far = made.join(bridge, made["queue_name"] == bridge["name"]).select("row", "service_id", "file", "line", "queue")
    node = F.concat(F.lit("queue:"), "queue")
    p = own.union(far).distinct().select(*edge(F.col("row"), F.col("service_id"), node, "produces", node))
    c = q.where(F.col("role") != "producer").withColumn("queue", F.col("queue_name")).select(*edge(F.col("row"), node, F.col("service_id"), "consumes", node))
    return p.unionByName(c)


def table_edges(entities: DataFrame) -> DataFrame:
    t = table_key("schema_name", "table_name")
    return numbered(entities).select(*edge(F.col("row"), F.col("service_id"), F.concat(F.lit("table:"), t), "reads_table", F.concat(F.lit("entity "), "class_name", F.lit(" → "), t), "source_file", F.lit(0)))


def external_edges(sources: DataFrame) -> DataFrame:
    name = F.when(F.coalesce("connector_id", F.lit("")) != "", F.col("connector_id")).otherwise(F.col("kind"))
    detail = F.concat(F.col("kind"), F.when(F.col("configured"), " (configured)").otherwise(""), F.lit(": "), name, F.lit(" "), F.col("detail"))
    return numbered(sources).select(*edge(F.col("row"), F.col("service_id"), F.concat(F.lit("ext:"), name), "external_source", detail))


def library_edges(deps: DataFrame) -> DataFrame:
    return numbered(deps).select(*edge(F.col("row"), F.col("service_id"), F.col("library_id"), "depends_on", F.concat(F.lit("lib:"), "library_id"), F.lit(""), F.lit(0)))


def auth_edges(issuers: DataFrame) -> DataFrame:
    host = F.coalesce(F.when(F.col("issuer").rlike("^https?://[^/]"), F.regexp_extract("issuer", "^https?://([^/]+)", 1)), F.col("issuer"))
    return numbered(issuers.where(F.coalesce("issuer", F.lit("")) != "")).select(*edge(F.col("row"), F.col("service_id"), F.concat(F.lit("auth:"), host), "auth_via", F.concat(F.lit("issuer:"), "issuer"), F.lit(""), F.lit(0)))


def transitive_calls(direct: DataFrame, deps: DataFrame, lib_calls: DataFrame) -> DataFrame:
    """One hop: a service calls what its library calls, unless it is the service itself or called directly.
    ``lib_calls`` has library_id, to_service, detail, file, line, row."""
    j = deps.join(lib_calls, "library_id").where(F.col("service_id") != F.col("to_service"))
    j = j.join(direct.select(F.col("from_service").alias("service_id"), "to_service").distinct(), ["service_id", "to_service"], "left_anti")
    return j.select(*edge(F.col("row"), F.col("service_id"), F.col("to_service"), "calls", F.concat(F.lit("via lib "), "library_id", F.lit(" ("), "detail", F.lit(")")), confidence="medium"))


def service_graph(inv: dict[str, DataFrame]) -> DataFrame:
    """All edges of an inventory of tables: services, http_clients, rest_endpoints, and, where given, queue_endpoints,
    queue_bindings, orm_entities, external_sources, library_deps, auth_issuers."""
    parts = []
    calls = first_edges(client_edges(inv["http_clients"], inv["services"], inv["rest_endpoints"]))
    parts.append(calls)
    if "queue_endpoints" in inv:
        parts.append(first_edges(queue_edges(inv["queue_endpoints"], inv["queue_bindings"])))
    for name, make in (("orm_entities", table_edges), ("external_sources", external_edges), ("library_deps", library_edges), ("auth_issuers", auth_edges)):
        if name in inv:
            parts.append(first_edges(make(inv[name])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if "library_deps" in inv:
        libs = inv["services"].where(F.col("kind") == "library").select(F.col("id").alias("service_id"))
        c = resolved(numbered(inv["http_clients"].join(libs, "service_id", "left_semi")), inv["services"]).where(F.col("target_id").isNotNull() & (F.col("target_id") != F.col("service_id")))
        lib = c.select("row", F.col("service_id").alias("library_id"), F.col("target_id").alias("to_service"), F.concat_ws(" ", "method", normalize_path("path")).alias("detail"), "file", "line")
        out = out.unionByName(first_edges(transitive_calls(calls.where("kind = 'calls'"), inv["library_deps"].select("service_id", "library_id"), lib)))
    # external sources can come from clients and from configuration
    w = Window.partitionBy("from_service", "to_service", "kind", "detail").orderBy(F.desc("confidence"))
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def inbound_rank(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'calls'").groupBy(F.col("to_service").alias("service")).agg(F.count(F.lit(1)).alias("n_calls")).orderBy(F.desc("n_calls"), "service")


def client_registry(edges: DataFrame) -> DataFrame:
    """Per target of real calls: distinct callers and methods."""
    c = edges.where((F.col("kind") == "calls") & ~is_synthetic("to_service")).withColumn("method", F.regexp_extract("detail", r"^([A-Z]+) ", 1))
    return c.groupBy("to_service").agg(F.count_distinct("from_service").alias("n_callers"), F.array_join(F.array_sort(F.collect_set("from_service")), ", ").alias("callers"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("method") != "", F.col("method")))), ", ").alias("methods"))


def dependency_matrix(edges: DataFrame, targets: list[str]) -> DataFrame:
    """Calls by caller and target; the targets are given, so the pivot needs no pass of its own."""
    return edges.where("kind = 'calls'").groupBy("from_service").pivot("to_service", targets).count()


def queue_registry(endpoints: DataFrame) -> DataFrame:
    """Per queue: distinct publishers and consumers, and the first message type."""
    of = lambda role: F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("service_id")))), ", ")
    return numbered(endpoints).groupBy("queue_name").agg(of("producer").alias("publishers"), of("consumer").alias("consumers"), F.min_by(F.when(F.col("message_type") != "", F.col("message_type")), F.when(F.col("message_type") != "", F.col("row"))).alias("message_type"))


def library_matrix(edges: DataFrame, least: int = 2) -> DataFrame:
    """Libraries of at least so many consumers."""
    return edges.where("kind = 'depends_on'").groupBy(F.col("to_service").alias("library")).agg(F.count_distinct("from_service").alias("n_consumers"), F.array_join(F.array_sort(F.collect_set("from_service")), ", ").alias("consumers")).where(F.col("n_consumers") >= least)


def service_map(edges: DataFrame) -> DataFrame:
    """Per source: direct targets and those reached through libraries."""
    c = edges.where("kind = 'calls'").withColumn("via", F.col("detail").startswith("via lib "))
    of = lambda v: F.array_join(F.array_sort(F.collect_set(F.when(F.col("via") == v, F.col("to_service")))), ", ")
    return c.groupBy("from_service").agg(of(False).alias("direct"), of(True).alias("transitive"))


def db_traces(entities: DataFrame) -> DataFrame:
    return entities.groupBy("service_id").agg(F.count(F.lit(1)).alias("n_entities"), F.array_join(F.array_sort(F.collect_set(table_key("schema_name", "table_name"))), ", ").alias("tables"))


def real_services(services: DataFrame) -> DataFrame:
    return services.agg(F.count_if(~is_synthetic("id") & (F.col("kind") != "library")).alias("n_services"))


def page_predicates(services: DataFrame, edges: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """One row: which generated pages have something to show."""
    e = edges.agg(
        F.coalesce(F.bool_or((F.col("kind") == "calls") & ~is_synthetic("to_service")), F.lit(False)).alias("clients"),
        F.coalesce(F.bool_or(F.col("kind").isin("produces", "consumes") & (F.col("from_service").startswith("queue:") | F.col("to_service").startswith("queue:"))), F.lit(False)).alias("queues"),
    )
    libs = library_matrix(edges).agg((F.count(F.lit(1)) > 0).alias("libraries"))
    db = (entities.agg((F.count(F.lit(1)) > 0).alias("db"))) if entities is not None else services.limit(1).agg(F.lit(False).alias("db"))
    n = real_services(services)
    one = n.join(F.broadcast(e), how="left").join(F.broadcast(libs), how="left").join(F.broadcast(db), how="left")  # one row each
    return one.select(((F.col("n_services") >= 2) | F.col("clients")).alias("topology"), "clients", "queues", "db", "libraries")


def api_prefix(endpoints: DataFrame, depth: int = 2) -> DataFrame:
    """Per service the longest leading path that all its routes share, of at most ``depth`` segments; "—" if none."""
    p = endpoints.select("service_id", F.filter(F.split(normalize_path("path"), "/"), lambda x: x != "").alias("s"))
    ask = []
    for k in range(1, depth + 1):
        head = F.when((F.size("s") >= k) & ~F.array_contains(F.slice("s", 1, k), "{}"), F.array_join(F.slice("s", 1, k), "/"))
        ask.append(F.when((F.min(head) == F.max(head)) & (F.count(head) == F.count(F.lit(1))), F.min(head)).alias(f"p{k}"))
    g = p.groupBy("service_id").agg(*ask)
    longest = F.coalesce(*[F.col(f"p{k}") for k in range(depth, 0, -1)])
    return g.select("service_id", F.coalesce(F.concat(F.lit("/"), longest), F.lit("—")).alias("api_prefix"))


def match_names(gold: DataFrame, detected: DataFrame) -> DataFrame:
    """Detected ids for gold names: equal, else one's "-" tokens lead the other's; the closest length, then the alphabet.
    Leading token runs are the join key, so no pair is tried that does not share one."""
    runs = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(c, "-"))), lambda k: F.array_join(F.slice(F.split(c, "-"), F.lit(1), k), "-"))).alias("run")
    g, d = gold.select("name", runs("name")), detected.select("id", runs("id"))
    pair = g.where("run = name").join(d, "run").union(g.join(d.where("run = id"), "run").select("run", "name", "id")).select("name", "id").distinct()
    gap = F.abs(F.size(F.split("name", "-")) - F.size(F.split("id", "-")))
    return pair.groupBy("name").agg(F.min_by("id", F.struct((F.col("id") != F.col("name")).alias("other"), gap.alias("gap"), F.col("id"))).alias("id"))


def recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Percent of gold pairs (a, b) that are found, and of found pairs among gold names that are gold."""
    known = gold.select("a").union(gold.select(F.col("b").alias("a"))).distinct()
    inside = found.select("a", "b").distinct().join(known, "a", "left_semi").join(known.select(F.col("a").alias("b")), "b", "left_semi")
    hits = gold.select("a", "b").distinct().join(found.select("a", "b").distinct(), ["a", "b"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    n = gold.select("a", "b").distinct().agg(F.count(F.lit(1)).alias("gold"))
    m = inside.agg(F.count(F.lit(1)).alias("found"))
    one = hits.join(F.broadcast(n), how="left").join(F.broadcast(m), how="left")  # one row each
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) * 100.0 / F.col(b)).otherwise(0.0)
    return one.select("hits", "gold", "found", part("hits", "gold").alias("recall"), part("hits", "found").alias("precision"))
