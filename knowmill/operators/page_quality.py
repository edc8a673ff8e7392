"""Quality of pages: a tier by words, plus and minus signals, within [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.functions.text import crossref_links, word_count
from knowmill.operators import page_graph
from knowmill.operators.lint import REQUIRED, field

# Tags that call for a diagram.
DIAGRAM_TAGS = ("database", "schema", "architecture", "service", "infrastructure", "erd", "topology", "troubleshooting", "runbook", "pipeline", "workflow", "commands")


def tier(words: Column) -> Column:
    return F.when(words < 50, 0.1).when(words < 150, 0.3).when(words < 500, 0.6).otherwise(0.8)


def signals(degree: Column | None = None, threshold: Column | None = None) -> dict[str, Column]:
    """Delta of each signal, null where it does not hold; pages have body and fm (JSON)."""
    keys = F.coalesce(F.json_object_keys("fm"), F.array().cast("array<string>"))
    items = lambda name: F.from_json(field(name), "array<string>")
    given = lambda x, d: F.when(x, F.lit(d))
    sources = F.coalesce(field("sources"), F.lit(""))
    tags = items("tags")
    n = lambda a: F.coalesce(F.size(a), F.lit(0))
    claim = F.coalesce(field("type") == "claim", F.lit(False))
    diagram = F.coalesce(F.col("body"), F.lit("")).rlike(r"(?s)```mermaid\s*\n.*?```")
    expected = F.coalesce(F.exists(tags, lambda t: F.lower(t).isin(*DIAGRAM_TAGS)), F.lit(False))
    out = {
        "word_count": tier(word_count("body")),
        "complete_frontmatter": given(F.size(F.array_except(F.array(*[F.lit(x) for x in REQUIRED]), keys)) == 0, 0.1),
        "missing_title": given(~F.array_contains(keys, "title"), -0.3),
        "no_sources": given(sources.isin("", "[]", "0", "false"), -0.2),
        "no_summary": given(~F.array_contains(keys, "summary"), -0.1),
        "crossref_links": given(F.size(crossref_links("body")) >= 3, 0.1),
        "concept_tags": given(n(tags) >= 4, 0.05),
        "claim_has_evidence": given(claim & (n(items("evidence")) > 0), 0.1),
        "deprecated_no_reason": given(claim & F.coalesce(field("status") == "deprecated", F.lit(False)) & (F.coalesce(field("failure_reason"), F.lit("")) == ""), -0.2),
        "has_mermaid": given(diagram, 0.05),
        "missing_mermaid": given(~diagram & expected, -0.1),
    }
    if degree is not None:
        out["god_node"] = given((degree >= threshold) & (degree > 1), 0.1)
        out["isolated_node"] = given(degree <= 1, -0.2)
    return out


def total(deltas: dict[str, Column]) -> Column:
    s = F.lit(0.0)
    for d in deltas.values():
        s = s + F.coalesce(d, F.lit(0.0))
    return F.floor(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) * 10000 + 0.5) / 10000


def score(pages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(path, quality, signals). A page's degree is that of the first node that ends its path or ends with its name; both
    are equalities of path ends, so the join is by key."""
    deg = thr = None
    if edges is not None:
        d = page_graph.degrees(edges)
        # node is a suffix of the path, or the path's base name is a suffix of the node; ties by first appearance
        tails = pages.select("path", F.explode(F.array_distinct(F.flatten(F.array(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.concat_ws("/", F.slice(F.split("path", "/"), k, F.lit(10_000)))), F.array(F.concat(F.lit("*"), F.substring_index("path", "/", -1))))))).alias("key"))
        nodes = d.select("degree", "first", F.explode(F.array_distinct(F.array(F.col("node"), F.concat(F.lit("*"), F.substring_index("node", "/", -1))))).alias("key"))
        of = tails.join(nodes, "key").groupBy("path").agg(F.min_by("degree", "first").alias("_degree"))
        pages = pages.join(of, "path", "left").join(F.broadcast(page_graph.top_decile(d)), how="left")  # one row
        deg, thr = F.coalesce("_degree", F.lit(0)), F.coalesce("threshold", F.lit(0))
    s = signals(deg, thr)
    named = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("signal"), v.cast("double").alias("delta"))) for k, v in s.items()]))
    return pages.select("path", total(s).alias("quality"), named.alias("signals"))


def score_all(pages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    return score(pages, edges).orderBy(F.desc("quality"), "path")
