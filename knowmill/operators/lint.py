"""Lint rules over pages: each is a predicate or an anti-join that yields issues (severity, category, page, detail).

Pages have path, content, body and fm, the frontmatter as JSON text; null where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.functions.text import brackets_balanced, page_links, resolve_link
from knowmill.operators import page_graph

# Required frontmatter fields, page types, pages that need no link, diagram types.
REQUIRED = ("title", "type", "tags", "sources", "created", "updated", "quality", "summary")
PAGE_TYPES = ("concept", "entity", "summary", "index", "lecture", "claim", "synthesis")
NEVER_ORPHAN = ("index.md", "summaries.md", "overview.md")
DIAGRAMS = ("erDiagram", "sequenceDiagram", "graph", "flowchart", "classDiagram", "stateDiagram", "gantt", "pie", "gitgraph")
STALE_DAYS = 90


def issue(severity, category: str, page, detail) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [lit(severity).alias("severity"), F.lit(category).alias("category"), F.col(page).alias("page") if isinstance(page, str) else page.alias("page"), lit(detail).alias("detail")]


def field(name: str) -> Column:
    return F.get_json_object("fm", f"$.{name}")


def base_name(path) -> Column:
    return F.substring_index(path, "/", -1)


def link_rows(pages: DataFrame) -> DataFrame:
    """(path, link) for each link of each page."""
    return pages.select("path", F.explode(page_links("content")).alias("link"))


def local_links(pages: DataFrame) -> DataFrame:
    return link_rows(pages).where(~F.col("link").startswith("http") & ~F.col("link").startswith("#"))


def broken_links(pages: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Links to pages that do not exist; ``existing`` (path) defaults to the pages."""
    links = local_links(pages).where(F.col("link").endswith(".md")).withColumn("target", resolve_link("path", "link"))
    there = (existing if existing is not None else pages).select(F.col("path").alias("target"))
    return links.join(there, "target", "left_anti").select(*issue("error", "broken_links", "path", F.concat(F.lit("Link to "), "link", F.lit(" not found"))))


def frontmatter(pages: DataFrame) -> DataFrame:
    none = pages.where(F.col("fm").isNull() | (F.coalesce(F.size(F.json_object_keys("fm")), F.lit(0)) <= 0))
    some = pages.join(none.select("path"), "path", "left_anti")
    missing = some.select("path", F.explode(F.array_except(F.array(*[F.lit(x) for x in REQUIRED]), F.json_object_keys("fm"))).alias("f"))
    typed = some.withColumn("t", field("type")).where(F.col("t").isNotNull() & ~F.col("t").isin(*PAGE_TYPES))
    return (
        none.select(*issue("error", "missing_frontmatter", "path", "No frontmatter found (missing --- delimiters)"))
        .unionByName(missing.select(*issue("error", "missing_frontmatter", "path", F.concat(F.lit("Missing required frontmatter field: "), "f"))))
        .unionByName(typed.select(*issue("error", "missing_frontmatter", "path", F.concat(F.lit("type '"), "t", F.lit("' is not one of " + "|".join(PAGE_TYPES))))))
    )


def orphans(pages: DataFrame) -> DataFrame:
    """Pages whose base name no link of any page ends with, their own included."""
    linked = local_links(pages).select(base_name(F.col("link")).alias("name")).distinct()
    named = pages.select("path", base_name(F.col("path")).alias("name")).where(~F.col("name").isin(*NEVER_ORPHAN))
    return named.join(linked, "name", "left_anti").select(*issue("warning", "orphan_page", "path", "Page is not linked from any other page"))


def isolated_nodes(edges: DataFrame, pages: DataFrame) -> DataFrame:
    return page_graph.isolated(edges, pages.select(F.col("path").alias("page"))).select(*issue("warning", "isolated_node", "page", "Node has degree <= 1 in the knowledge graph"))


def code_ref_drift(pages: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (page, file, content_hash) against files (path, content)."""
    f = files.select(F.col("path").alias("file"), F.sha2(F.col("content").cast("binary"), 256).alias("now"))
    j = refs.join(f, "file", "left")
    gone = F.concat(F.lit("Referenced file "), "file", F.lit(" not found"))
    moved = F.concat(F.lit("Content hash mismatch for "), "file")
    return j.where(F.col("now").isNull() | (F.col("now") != F.col("content_hash"))).select(*issue(F.when(F.col("now").isNull(), "error").otherwise("warning"), "code_ref_drift", "page", F.when(F.col("now").isNull(), gone).otherwise(moved)))


def references_inventory(refs: DataFrame, *known: DataFrame) -> DataFrame:
    """Referenced files that no table of the inventory (file) knows."""
    files = known[0].select("file")
    for k in known[1:]:
        files = files.union(k.select("file"))
    return refs.join(files.distinct(), "file", "left_anti").select(*issue("warning", "references_inventory", "page", F.concat(F.lit("Reference "), "file", F.lit(" is not in the inventory"))))


def provenance(edges: DataFrame) -> DataFrame:
    """Edges whose record (raw JSON) has no provenance key; a null value is one."""
    return edges.where(~F.array_contains(F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>")), "provenance")).select(*issue("warning", "provenance", F.concat(F.col("from"), F.lit(" -> "), F.col("to")), "Edge has no provenance"))


def ambiguity_rate(edges: DataFrame, limit: float = 0.2) -> DataFrame:
    a = page_graph.ambiguity(edges, limit).where("warn")
    return a.select(*issue("warning", "high_ambiguity", F.lit("graph"), F.concat(F.bround(F.col("rate") * 100).cast("bigint").cast("string"), F.lit("% of edges are AMBIGUOUS"))))


def index_coverage(pages: DataFrame, index: str = "index.md") -> DataFrame:
    """Pages that the index does not link."""
    linked = local_links(pages.where(base_name(F.col("path")) == index)).select(resolve_link("path", "link").alias("path")).distinct()
    return pages.where(~base_name(F.col("path")).isin(*NEVER_ORPHAN)).join(linked, "path", "left_anti").select(*issue("warning", "index_coverage", "path", "Page is not linked from the index"))


def summaries_sync(pages: DataFrame, summaries: str = "summaries.md") -> DataFrame:
    """Pages with a summary_hash that the summaries page lacks, or has otherwise."""
    s = pages.where(base_name(F.col("path")) == summaries)
    entry = F.explode(F.regexp_extract_all("content", F.lit(r"(\[[^\]]*\]\([^)]+\.md\)\s*`[^`\s]+`)"), 1)).alias("e")
    e = s.select(F.col("path").alias("at"), entry).select(resolve_link("at", F.regexp_extract("e", r"\]\(([^)]+\.md)\)", 1)).alias("path"), F.regexp_extract("e", r"`([^`\s]+)`", 1).alias("stored")).groupBy("path").agg(F.max("stored").alias("stored"))
    p = pages.where(~base_name(F.col("path")).isin(*NEVER_ORPHAN)).withColumn("h", field("summary_hash")).where(F.coalesce("h", F.lit("")) != "")
    j = p.join(e, "path", "left").where(F.col("stored").isNull() | (F.col("stored") != F.col("h")))
    return j.select(*issue(F.when(F.col("stored").isNull(), "error").otherwise("warning"), "summaries_sync", "path", F.when(F.col("stored").isNull(), F.lit(f"Page is missing from {summaries}")).otherwise(F.concat(F.lit("summary_hash mismatch: page has "), "h", F.lit(", summaries.md has "), "stored"))))


def stale(pages: DataFrame, now, days: int = STALE_DAYS) -> DataFrame:
    age = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(field("updated")))) / 86400)
    p = pages.withColumn("age", age).where(F.unix_timestamp(F.try_to_timestamp(field("updated"))) < F.unix_timestamp(F.lit(now).cast("timestamp")) - days * 86400)
    return p.select(*issue("info", "stale_content", "path", F.concat(F.lit("Page is "), F.col("age").cast("string"), F.lit(f" days old (threshold {days})"))))


def deprecated_claims(pages: DataFrame) -> DataFrame:
    claim, reason = F.coalesce(field("type") == "claim", F.lit(False)), F.trim(F.coalesce(field("failure_reason"), F.lit("")))
    gone = claim & F.coalesce(field("status") == "deprecated", F.lit(False))
    conf = field("confidence").try_cast("double")
    p = pages.withColumn("gone", gone).withColumn("reason", reason).withColumn("conf", conf).withColumn("claim", claim)
    return (
        p.where(F.col("gone") & (F.col("reason") == "")).select(*issue("error", "deprecated_claims", "path", "Claim is deprecated but failure_reason is missing or empty."))
        .unionByName(p.where(F.col("gone") & (F.col("conf") > 0.3)).select(*issue("warning", "deprecated_claims", "path", F.concat(F.lit("Deprecated claim has confidence "), F.col("conf").cast("string"), F.lit(" (expected <= 0.3).")))))
        .unionByName(p.where(~F.col("gone") & (F.col("reason") != "")).select(*issue("warning", "deprecated_claims", "path", F.when(F.col("claim"), "failure_reason is set but claim is not deprecated; it will be ignored.").otherwise("failure_reason is set but non-claim pages should not carry it."))))
    )


def thin(edges: DataFrame, least: int = 3) -> DataFrame:
    return page_graph.thin_clusters(edges, least).select(*issue("warning", "thin_clusters", "component", F.concat(F.lit("Cluster has "), F.col("n_nodes").cast("string"), F.lit(f" page(s) (min {least})"))))


def diagrams(pages: DataFrame) -> DataFrame:
    """(path, line, block, kind) of each fenced diagram; line is that of the fence."""
    parts = F.split("content", r"```mermaid\s*\n")
    each = pages.select("path", "content", F.posexplode(parts).alias("k", "part"), parts.alias("parts")).where("k > 0")
    before = F.array_join(F.slice("parts", F.lit(1), F.col("k")), "```mermaid\n")
    done = each.where(F.instr("part", "```") > 0).select("path", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), F.substring_index("part", "```", 1).alias("block"))
    return done.withColumn("kind", F.regexp_extract("block", r"^\s*(\S+)", 1))


def diagram_syntax(pages: DataFrame) -> DataFrame:
    d = diagrams(pages)
    at = lambda text: F.concat(F.lit("Line "), F.col("line").cast("string"), F.lit(": "), text)
    empty = d.where(F.trim("block") == "").select(*issue("error", "mermaid_syntax", "path", at(F.lit("Empty mermaid block"))))
    full = d.where(F.trim("block") != "")
    kind = full.where(~F.col("kind").isin(*DIAGRAMS)).select(*issue("error", "mermaid_syntax", "path", at(F.concat(F.lit("Unrecognized diagram type '"), "kind", F.lit("'")))))
    pair = full.where((F.col("kind") != "erDiagram") & ~brackets_balanced("block")).select(*issue("error", "mermaid_syntax", "path", at(F.lit("Brackets are not balanced"))))
    return empty.unionByName(kind).unionByName(pair)


def mapping_freshness(pages: DataFrame, files: DataFrame, page: str = "database-mapping.md") -> DataFrame:
    """The mapping page is older than the newest source (path, mtime), or has no stamp."""
    newest = files.agg(F.max("mtime").alias("newest"))
    m = pages.where(base_name(F.col("path")) == page).withColumn("at", F.try_to_timestamp(field("generated_at"))).join(F.broadcast(newest), how="left")  # one row
    return m.where(F.col("at").isNull() | (F.col("newest") > F.col("at"))).select(*issue("warning", "orm_mapping_freshness", "path", F.when(F.col("at").isNull(), "generated_at is missing or unparseable").otherwise("ORM sources are newer than the mapping")))


def lint(pages: DataFrame, edges: DataFrame, now, category: str | None = None, page: str | None = None, refs: DataFrame | None = None, files: DataFrame | None = None, inventory: list[DataFrame] | None = None) -> DataFrame:
    """All rules in one table, perhaps of one category or page (path, suffix or pattern). Rules about sources need ``refs``
    (page, file, content_hash) with ``files`` (path, content, mtime) or the ``inventory``'s tables (file); provenance needs
    edges with their record (raw)."""
    rules = [broken_links(pages), frontmatter(pages), orphans(pages), isolated_nodes(edges, pages), diagram_syntax(pages), index_coverage(pages), summaries_sync(pages), ambiguity_rate(edges), stale(pages, now), deprecated_claims(pages), thin(edges)]
    if "raw" in edges.columns:
        rules.append(provenance(edges))
    if refs is not None and files is not None:
        rules.append(code_ref_drift(pages, refs, files))
    if refs is not None and inventory:
        rules.append(references_inventory(refs, *inventory))
    if files is not None and "mtime" in files.columns:
        rules.append(mapping_freshness(pages, files))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    if category is not None:
        out = out.where(F.col("category") == category)
    if page is not None:
        from knowmill.functions.paths import matches_any

        out = out.where((F.col("page") == page) | F.col("page").endswith(page) | matches_any("page", [page]))
    return out


def validate(pages: DataFrame, edges: DataFrame, now, page: str, **sources) -> DataFrame:
    """(category, message) of what the rules find on one page; no row if it is clean."""
    return lint(pages, edges, now, page=page, **sources).select("category", F.col("detail").alias("message"))


def severities(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
