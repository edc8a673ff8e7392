"""Links between pages when pages move, and small rules over pages, folders and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.functions.text import resolve_link

LINK = r"\[([^\]]+)\]\(([^)]+)\)"
# Audiences of facets; headings after which a block is inserted.
AUDIENCES = {"getting-started": "new-user", "commands": "operator", "configuration": "operator", "operations": "operator", "architecture": "contributor", "data-model": "contributor", "environments": "contributor", "overview": "contributor", "api": "integrator", "integrations": "integrator", "deploy": "integrator", "troubleshooting": "debugger"}
MODES = ("rewrite", "remove", "leave")


def relative_to(page: Column, target: Column) -> Column:
    """A path as seen from a page's folder."""
    base, goal = F.slice(F.split(page, "/"), F.lit(1), F.size(F.split(page, "/")) - 1), F.split(target, "/")
    shared = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.least(F.size(base), F.size(goal) - 1)), lambda k: F.when(F.slice(base, F.lit(1), k) == F.slice(goal, F.lit(1), k), k)), lambda x: x.isNotNull()))
    shared = F.when((F.size(base) == 0) | (F.size(goal) <= 1), 0).otherwise(shared)
    up = F.array_repeat(F.lit(".."), F.size(base) - shared)
    return F.array_join(F.concat(up, F.slice(goal, shared + 1, F.size(goal))), "/")


def rewrite_inbound(pages: DataFrame, moved: DataFrame, mode: str = "rewrite", back: bool = False) -> DataFrame:
    """Pages (path, content) with links to moved pages (from, to) led there and called archived, or reduced to their labels;
    with ``back`` the other way. Fenced code stays. Links are rows: their targets join the moves by key, then each page is put
    together from its parts in order."""
    if mode not in MODES:
        raise ValueError(f"invalid mode {mode!r}; expected one of {', '.join(MODES)}")
    if mode == "leave":
        return pages
    cut, sep = "\u0001", "\u0002"
    marked = F.regexp_replace("content", r"(?s)(```.*?```|~~~.*?~~~)", f"{sep}$1{sep}")
    parts = pages.select("path", F.posexplode(F.split(marked, sep)).alias("seg", "text"))
    code = F.col("text").rlike("^(```|~~~)")
    bits = parts.select("path", "seg", F.posexplode(F.when(code, F.array("text")).otherwise(F.split(F.regexp_replace("text", LINK, f"{cut}$0{cut}"), cut))).alias("bit", "t"), code.alias("code"))
    whole = f"^{LINK}$"
    link = ~F.col("code") & F.col("t").rlike(whole)
    raw = F.regexp_extract("t", whole, 2)
    bits = bits.withColumn("label", F.when(link, F.regexp_extract("t", whole, 1))).withColumn("tail", F.regexp_extract(raw, r"([#?].*)$", 1)).withColumn("key", F.when(link, resolve_link("path", F.regexp_replace(raw, r"[#?].*$", ""))))
    m = moved.select(F.col("to" if back else "from").alias("key"), F.col("from" if back else "to").alias("goal"))
    done = F.col("label").endswith(" (archived)")
    j = bits.join(m, "key", "left").withColumn("hit", F.col("goal").isNotNull() & (done if back else ~(done & F.col("key").contains("_archive/"))))
    name = F.regexp_replace("label", r" \(archived\)$", "") if back else F.concat("label", F.lit(" (archived)"))
    new = F.concat(F.lit("["), name, F.lit("]("), relative_to(F.col("path"), F.col("goal")), F.col("tail"), F.lit(")")) if mode == "rewrite" else F.col("label")
    text = F.when(F.col("hit"), new).otherwise(F.col("t"))
    return j.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "bit", text.alias("x")))), lambda b: b["x"]), "").alias("content"), F.count_if("hit").alias("n_rewritten"))


def audience(facet: Column, given: Column) -> Column:
    """The page's own audience, or that of its facet."""
    table = F.create_map(*[F.lit(x) for kv in AUDIENCES.items() for x in kv])
    return F.coalesce(F.when(given != "", given), F.element_at(table, facet), F.lit("contributor"))


def folder_signatures(paths: DataFrame) -> DataFrame:
    """(folder, signature): "D" and "F" lines of what lies in each folder, in order of names."""
    p = paths.select(F.split("path", "/").alias("s"))
    each = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda k: F.struct(F.array_join(F.slice("s", F.lit(1), k - 1), "/").alias("folder"), F.get("s", k - 1).alias("name"), (k < F.size("s")).alias("dir")))).alias("x")).select("x.*").distinct()
    return each.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("name", "dir"))), lambda e: F.concat(F.when(e["dir"], "D ").otherwise("F "), e["name"])), "\n").alias("signature"))


def overlay(base: Column, top: Column) -> Column:
    """A map with the entries of another over it."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.coalesce(F.map_contains_key(top, k), F.lit(False))), top)


def cross_service(disable: Column, enable: Column, config: Column, n_services: Column) -> Column:
    return F.when(disable, False).when(enable, True).otherwise(F.coalesce(config, n_services >= 2))


def insert_markers(text: Column, placeholder: str, start: str, end: str, headings: tuple[str, ...] = (r"^ {0,3}#{1,6}\s+(install|installation|getting started|quick ?start|setup|usage)\b",)) -> Column:
    """A marked block after the first heading that fits outside fences, else after the first "##", else at the end."""
    lines = F.split(text, "\n")
    fence = lambda i: F.size(F.filter(F.slice(lines, F.lit(1), i), lambda x: x.rlike(r"^\s*(```|~~~)"))) % 2 == 0
    at = lambda r: F.get(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r) & fence(i), i)), lambda i: i.isNotNull()), 0)
    where = F.coalesce(*[at("(?i)" + h) for h in headings], at(r"^ {0,3}##\s+"))
    block = f"{start}\n{placeholder}\n{end}"
    after = F.slice(lines, where + 2, F.size(lines))
    mid = F.concat(F.array_join(F.slice(lines, F.lit(1), where + 1), "\n"), F.lit("\n\n" + block), F.when(F.array_join(after, "\n") != "", F.concat(F.lit("\n"), F.array_join(after, "\n"))).otherwise(F.lit("")))
    return F.when(where.isNull(), F.concat(text, F.lit(f"\n{block}\n"))).otherwise(mid)


def fold_symbols(matches: DataFrame) -> DataFrame:
    """(class_name, columns, relationships) from matches (ord, kind, name, enclosing_class): children under their class."""
    c = matches.where("kind = 'class'").select(F.col("name").alias("class_name")).distinct()
    kids = matches.where("kind <> 'class'").select(F.col("enclosing_class").alias("class_name"), "kind", "name", "ord")
    of = lambda k: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("ord", "name")))), lambda x: x["name"]))
    return c.join(kids, "class_name", "left").groupBy("class_name").agg(of("column").alias("columns"), of("relationship").alias("relationships"))
