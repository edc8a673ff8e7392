"""Operators over page graphs, which are edge tables (ord, from, to, type, provenance, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowmill.functions.paths import excluded_node

# Edge types and provenance levels.
EDGE_TYPES = ("supports", "contradicts", "extends", "supersedes")
PROVENANCE = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
MAX_ROUNDS = 60


def live_edges(edges: DataFrame) -> DataFrame:
    """Edges neither end of which lies in a folder that begins with an underscore."""
    return edges.where(~excluded_node("from") & ~excluded_node("to"))


def list_edges(edges: DataFrame, kind: str | None = None) -> DataFrame:
    return edges if kind is None else edges.where(F.col("type") == kind)


def ends(edges: DataFrame, *more: str) -> DataFrame:
    """A row for each end of each edge."""
    return edges.select(F.posexplode(F.array("from", "to")).alias("side", "node"), *more)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, first): a self-loop counts twice; first is where the node appears first."""
    e = ends(live_edges(edges), "ord")
    return e.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.min(F.col("ord") * 2 + F.col("side")).alias("first"))


def god_nodes(edges: DataFrame, n: int = 10, exclude: tuple[str, ...] = ("index", "summary")) -> DataFrame:
    d = degrees(edges)
    for word in exclude:
        d = d.where(~F.lower("node").contains(word.lower()))
    return d.orderBy(F.desc("degree"), "first").limit(n).select("node", "degree")


def isolated(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages (page) of degree 1 at most, among them those without an edge."""
    d = degrees(edges).withColumnRenamed("node", "page")
    return pages.join(d, "page", "left").where(F.coalesce("degree", F.lit(0)) <= 1).select("page", F.coalesce("degree", F.lit(0)).alias("degree"))


def path_graph(edges: DataFrame) -> DataFrame:
    """One edge for each pair: the place of the first, the payload of the last."""
    rest = [c for c in edges.columns if c not in ("from", "to", "ord")]
    return live_edges(edges).groupBy("from", "to").agg(F.min("ord").alias("ord"), *[F.max_by(c, "ord").alias(c) for c in rest])


def shared_dir(spark) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary folder serves a local session; other sessions
    fail, since executors do not see the driver's folders."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not named:
            import tempfile

            named = tempfile.mkdtemp(prefix="knowmill-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computed once, reread from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, src: str = "from", dst: str = "to") -> DataFrame:
    """(node, component) of the undirected graph; component is its smallest node. Alternating stars, so rounds are few
    and every step is a join or an aggregation; raises if it has not settled in MAX_ROUNDS."""
    e = cut(edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).distinct())
    loops = e.where("a = b").select("a")
    e = e.where("a <> b")
    mark = None
    for _ in range(MAX_ROUNDS):
        new = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
        e = cut(large.join(least, "a").select(F.explode(pairs).alias("x")).select("x.a", "x.b").where("a <> b").distinct())
    else:
        raise RuntimeError("components have not settled")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")))
    alone = loops.join(nodes.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return nodes.union(alone).distinct()


def clusters(edges: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(component, n_nodes), with pages that have no edge as clusters of one."""
    c = components(live_edges(edges))
    if pages is not None:
        lone = pages.select(F.col("page").alias("node")).join(c, "node", "left_anti").select("node", F.col("node").alias("component"))
        c = c.unionByName(lone)
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


def thin_clusters(edges: DataFrame, least: int = 3) -> DataFrame:
    return clusters(edges).where(F.col("n_nodes") < least)


def all_paths(edges: DataFrame, source: str, target: str, n: int = 5, hops: int = 12) -> DataFrame:
    """The first n simple paths (path, complete), in the order of their edges' first appearance; ``complete`` is false if the
    bound ``hops`` may have left paths out."""
    from knowmill.operators.reach import search_paths

    return search_paths(edges, source, target, hops).orderBy("ords").limit(n).select("path", "complete")


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int = 6, via: str | None = None) -> list[str]:
    """The nodes of a shortest directed path, ties by the earliest edge; empty if there is none within the bound, which
    ``reach.search_shortest`` tells from none at all."""
    from knowmill.operators.reach import search_shortest

    if via is not None:
        a, b = shortest_path(edges, source, via, max_hops), shortest_path(edges, via, target, max_hops)
        return a + b[1:] if a and b else []
    return search_shortest(edges, source, target, max_hops)[0]


def cyclic_clusters(edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) of strongly connected components of at least two nodes, and of self-loops, for edges (from, to)."""
    from knowmill.operators.reach import strongly_connected

    return strongly_connected(edges, rounds)


def ambiguity(edges: DataFrame, limit: float = 0.2) -> DataFrame:
    """The share of ambiguous edges, and whether it is above the limit."""
    rate = F.avg(F.when(F.col("provenance") == "AMBIGUOUS", 1.0).otherwise(0.0))
    return edges.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(rate, F.lit(0.0)).alias("rate")).withColumn("warn", F.col("rate") > limit)


def top_decile(degree: DataFrame) -> DataFrame:
    """The degree at place max(1, ceil(n / 10)) from the top; one row, from the counts of each degree."""
    w = Window.orderBy(F.desc("degree"))  # one row for each distinct degree
    by = degree.groupBy("degree").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return by.where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))).agg(F.max("degree").alias("threshold"))


def check_enum(value: Column, allowed: tuple[str, ...], what: str) -> Column:
    """The value, or an error if it is none of those allowed."""
    return F.when(value.isin(*allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"{what} must be one of {', '.join(allowed)}, not "), F.coalesce(value, F.lit("null")))))


def without_first(edges: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    """Edges without the first that matches."""
    hit = (F.col("from") == source) & (F.col("to") == target) & (F.col("type") == kind)
    first = edges.where(hit).agg(F.min("ord").alias("_o"))
    return edges.join(F.broadcast(first), F.col("ord") == F.col("_o"), "left_anti")
