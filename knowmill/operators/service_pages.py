"""Generated pages about services: a page is a row (slug, body) and is there only if it has something to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.functions.paths import is_synthetic
from knowmill.operators import services as V
from knowmill.operators.page_graph import cyclic_clusters
from knowmill.operators.render import graph, listed

# Fixed value: what marks a page as generated; others are never replaced or pruned.
MARK = "<!-- generated: cross-service -->"


def topology(services: DataFrame, edges: DataFrame) -> DataFrame:
    """The diagram of direct calls between services, each pair once."""
    nodes = services.select("ord", "id", F.when(F.col("kind") == "service", F.col("id")).otherwise(F.concat("id", F.lit("<br/>("), "kind", F.lit(")"))).alias("label"))
    ids = services.select("id")
    direct = edges.where((F.col("kind") == "calls") & ~is_synthetic("from_service") & ~is_synthetic("to_service") & ~F.col("detail").startswith("via lib "))
    direct = direct.join(ids.withColumnRenamed("id", "from_service"), "from_service", "left_semi").join(ids.withColumnRenamed("id", "to_service"), "to_service", "left_semi")
    pairs = direct.select(F.col("from_service").alias("from"), F.col("to_service").alias("to")).distinct().select(F.concat_ws(" ", "from", "to").alias("ord"), "from", "to", F.lit("").alias("label"))
    return graph(nodes, pairs, "Service topology")


def page(slug: str, title: str, lines: DataFrame, order: str = "o") -> DataFrame:
    """(slug, body) from lines (o, line); no row without lines."""
    body = F.concat(F.lit(f"{MARK}\n# {title}\n\n"), listed(F.col("line"), F.col(order)), F.lit("\n"))
    return lines.agg(F.count(F.lit(1)).alias("n"), body.alias("body")).where("n > 0").select(F.lit(slug).alias("slug"), "body")


def row(*cells) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def pages(services: DataFrame, edges: DataFrame, queue_endpoints: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """All generated pages of a service graph."""
    m = V.service_map(edges)
    out = [page("service-map", "Service map", m.select(F.col("from_service").alias("o"), row("from_service", "direct", "transitive").alias("line")))]
    c = V.client_registry(edges)
    out.append(page("client-registry", "Client registry", c.select(F.col("to_service").alias("o"), row("to_service", "callers", "methods").alias("line"))))
    cycles = cyclic_clusters(edges.where("kind = 'calls'").select(F.col("from_service").alias("from"), F.col("to_service").alias("to"))).groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("node")), ", ").alias("nodes"))
    rank = V.inbound_rank(edges)
    deps = rank.select(F.concat(F.lit("0 "), F.lpad((1_000_000_000 - F.col("n_calls")).cast("string"), 12, "0"), "service").alias("o"), row("service", F.col("n_calls").cast("string")).alias("line"))
    out.append(page("service-dependencies", "Service dependencies", deps.unionByName(cycles.select(F.concat(F.lit("1 "), "component").alias("o"), F.concat(F.lit("- cycle: "), "nodes").alias("line")))))
    out.append(page("shared-libraries", "Shared libraries", V.library_matrix(edges).select(F.col("library").alias("o"), row("library", "consumers").alias("line"))))
    if queue_endpoints is not None:
        q = V.queue_registry(queue_endpoints)
        out.append(page("queue-registry", "Queue registry", q.select(F.col("queue_name").alias("o"), row("queue_name", "publishers", "consumers", F.coalesce("message_type", F.lit("—"))).alias("line"))))
    if entities is not None:
        out.append(page("db-traces", "Database traces", V.db_traces(entities).select(F.col("service_id").alias("o"), row("service_id", "tables").alias("line"))))
    all_ = out[0]
    for p in out[1:]:
        all_ = all_.unionByName(p)
    return all_


def merged(existing: DataFrame, made: DataFrame) -> DataFrame:
    """Pages (slug, body) with generated ones renewed: hand-written pages stay, generated ones without a successor go."""
    hand = existing.where(~F.col("body").startswith(MARK))
    return hand.unionByName(made.join(hand.select("slug"), "slug", "left_anti").select("slug", "body"))


def pruned(existing: DataFrame) -> DataFrame:
    return existing.where(~F.col("body").startswith(MARK))
