"""Rows to text: diagrams, tables, bundles and marked blocks. Ordered lists are gathered for each output text only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowmill.functions.text import escape_label, node_id, phase_label

# Rank of relationship kinds when two entities are related more than once.
RANKS = ("many_to_many", "one_to_many", "one_to_one", "relationship", "many_to_one", "foreign_key")


def listed(value: Column, order: Column, sep: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), sep)


def graph(nodes: DataFrame, edges: DataFrame, title: str, direction: str = "TB") -> DataFrame:
    """One text: nodes (ord, id, label) once each, edges (ord, from, to, label) in order."""
    n = nodes.groupBy("id").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"))
    top = n.agg(listed(F.concat(F.lit("  "), node_id("id"), F.lit('["'), escape_label("label"), F.lit('"]')), F.col("ord")).alias("n"))
    arrow = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" -->|"), escape_label("label"), F.lit("| "))).otherwise(" --> ")
    bottom = edges.agg(listed(F.concat(F.lit("  "), node_id("from"), arrow, node_id("to")), F.col("ord")).alias("e"))
    return top.join(F.broadcast(bottom), how="left").select(F.lit(title).alias("title"), F.concat_ws("\n", F.lit(f"graph {direction}"), F.when(F.col("n") != "", F.col("n")), F.when(F.col("e") != "", F.col("e"))).alias("text"))  # one row each


def phase_flow(nodes: DataFrame, edges: DataFrame, title: str, classes: DataFrame | None = None) -> DataFrame:
    """One text: a flow of phases from nodes (ord, id, label, shape, class_name), edges (ord, from, to, label) and classes (ord,
    name, fill, stroke). Of nodes with one id the first is drawn; each class lists its nodes, classes in order of their first."""
    label = lambda c: F.trim(phase_label(c))
    n = nodes.withColumn("node", node_id("id")).groupBy("node").agg(F.min("ord").alias("ord"), F.min_by(F.struct("label", "shape"), "ord").alias("x"))
    box = F.when(F.col("x.shape") == "diamond", F.concat(F.lit('{"'), label("x.label"), F.lit('"}'))).otherwise(F.concat(F.lit('["'), label("x.label"), F.lit('"]')))
    drawn = n.agg(listed(F.concat(F.lit("    "), "node", box), F.col("ord")).alias("n"))
    arrow = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" -- "), label("label"), F.lit(" --> "))).otherwise(" --> ")
    lines = edges.agg(listed(F.concat(F.lit("    "), node_id("from"), arrow, node_id("to")), F.col("ord")).alias("e"))
    members = nodes.where(F.coalesce("class_name", F.lit("")) != "").groupBy("class_name").agg(listed(node_id("id"), F.col("ord"), ",").alias("ids"), F.min("ord").alias("ord"))
    groups = members.agg(listed(F.concat(F.lit("    class "), "ids", F.lit(" "), "class_name"), F.col("ord")).alias("g"))
    one = drawn.join(F.broadcast(lines), how="left").join(F.broadcast(groups), how="left")  # one row each
    styles = F.lit("")
    if classes is not None:
        style = F.concat(F.lit("    classDef "), "name", F.lit(" fill:"), "fill", F.lit(",stroke:"), "stroke")
        one, styles = one.join(F.broadcast(classes.agg(listed(style, F.col("ord")).alias("c"))), how="left"), F.col("c")
    some = lambda c: F.when(c != "", c)
    return one.select(F.lit(title).alias("title"), F.concat_ws("\n", F.lit("flowchart TD"), some(F.col("n")), some(F.col("e")), some(styles), some(F.col("g"))).alias("text"))


def pick_relations(rel: DataFrame) -> DataFrame:
    """Of relations (source, target, type) each once, and for each unordered pair the one of the lowest rank."""
    table = F.create_map(*[F.lit(x) for i, r in enumerate(RANKS) for x in (r, i)])
    r = rel.select("source", "target", "type").distinct().withColumn("rank", F.coalesce(F.element_at(table, F.col("type")), F.lit(len(RANKS))))
    w = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy("rank", "source", "target")
    return r.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("source", "target", "type")


def er_diagram(columns: DataFrame, relations: DataFrame, title: str) -> DataFrame:
    """One text from columns (table, ord, name, data_type, is_pk) and relations (source, target, type)."""
    line = F.concat(F.lit("    "), F.regexp_replace("data_type", r"\W+", "_"), F.lit(" "), node_id("name"), F.when(F.col("is_pk"), " PK").otherwise(""))
    t = columns.groupBy("table").agg(listed(line, F.col("ord")).alias("c")).agg(listed(F.concat(F.lit("  "), node_id("table"), F.lit(" {\n"), "c", F.lit("\n  }")), F.col("table")).alias("t"))
    mark = F.when(F.col("type") == "many_to_many", "}o--o{").when(F.col("type") == "one_to_many", "||--o{").when(F.col("type") == "one_to_one", "||--||").otherwise("}o--||")
    e = pick_relations(relations).agg(listed(F.concat(F.lit("  "), node_id("source"), F.lit(" "), mark, F.lit(" "), node_id("target"), F.lit(" : "), "type"), F.concat_ws(" ", "source", "target")).alias("e"))
    return t.join(F.broadcast(e), how="left").select(F.lit(title).alias("title"), F.concat_ws("\n", F.lit("erDiagram"), F.when(F.col("t") != "", F.col("t")), F.when(F.col("e") != "", F.col("e"))).alias("text"))  # one row each


def bundle(pages: DataFrame, key: str, text: str = "content", limit: int | None = None) -> DataFrame:
    """Texts by key in order of path, each under its path and perhaps cut to ``limit`` characters."""
    body = F.col(text) if limit is None else F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n[truncated]"))).otherwise(F.col(text))
    return pages.groupBy(key).agg(listed(F.concat(F.lit("## "), "path", F.lit("\n\n"), body), F.col("path"), "\n\n").alias("text"), F.count(F.lit(1)).alias("n_pages"))


def keyword_lines(pages: DataFrame, pattern: str) -> DataFrame:
    """(path, line, text) of lines that match."""
    rows = pages.select("path", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    return rows.where(F.col("text").rlike(pattern)).select("path", (F.col("n") + 1).alias("line"), "text")


def summaries_block(pages: DataFrame, limit: int = 160) -> DataFrame:
    """One text: an entry for each page, in order of path."""
    from knowmill.functions.text import truncate_summary

    entry = F.concat(F.lit("- ["), "title", F.lit("]("), "path", F.lit(") `"), F.col("summary_hash"), F.lit("`: "), truncate_summary("summary", limit))
    return pages.agg(listed(entry, F.col("path")).alias("text"))


def inject_titled(body: Column, title: str, block: Column) -> Column:
    """A block between markers of its title, replaced or appended."""
    from knowmill.functions.text import splice_block

    return splice_block(body, block, f"<!-- diagram:{title}:start -->", f"<!-- diagram:{title}:end -->")


def marked(text: Column, start: str, end: str) -> Column:
    """What stands between markers that are there exactly once; null otherwise."""
    once = (F.size(F.split(text, start.replace("|", "\\|"))) == 2) & (F.size(F.split(text, end.replace("|", "\\|"))) == 2)
    a, z = F.instr(text, start), F.instr(text, end)
    return F.when(once & (z > a), F.substring(text, a + len(start), z - a - len(start)))


def replace_marked(text: Column, block: Column, start: str, end: str) -> Column:
    """The text with another block between its markers; an error unless they are there exactly once."""
    a, z = F.instr(text, start), F.instr(text, end)
    new = F.concat(F.substring(text, F.lit(1), a + len(start) - 1), F.lit("\n"), block, F.lit("\n"), F.substring(text, z, F.length(text)))
    return F.when(marked(text, start, end).isNotNull(), new).otherwise(F.raise_error(F.lit("markers must be there exactly once")))


def gap_report(gaps: DataFrame) -> DataFrame:
    """One text: missing facets by topic."""
    t = gaps.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_set("facet")), ", ").alias("f"))
    return t.agg(F.concat(F.lit("# Gaps\n\n"), listed(F.concat(F.lit("- "), "topic", F.lit(": "), "f"), F.col("topic"))).alias("text"))
