"""Reachability in directed edge tables (from, to): strongly connected components and searches for paths.

Components: every node learns the first node, in an order by hash, that it reaches. Each round looks along the edges and at
what the node found so far has found itself; since the order is random, the part of the graph that a node has seen grows by
a factor each round. Before, nodes with a single edge out are followed to the next fork by doubling, so that rings and chains
take rounds by the logarithm of their length. Nodes that found the same one form a colour, whose first node they all
reach. The same search against the edges of a colour gives what that node reaches; where both agree, they are its
component, which is peeled off, and the edges left within a colour go on. A round is linear in nodes and edges; there is no
closure, and no node or colour is gathered in one task. Joins of components are merged, since a broadcast in each of many rounds
would send most tables through the driver.

Edges with a null end are left out. A search that has not settled within its rounds raises.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.operators.page_graph import MAX_ROUNDS, cut, path_graph, shared_dir


class Written:
    """Tables in the shared folder, of which some go when others are written. Unlike a checkpoint, a table that is read
    again brings no constraints along; those of many rounds of joins would take the optimizer ever longer."""

    def __init__(self, df: DataFrame):
        self.spark, self.folders = df.sparkSession, []

    def put(self, df: DataFrame) -> DataFrame:
        folder = f"{shared_dir(self.spark)}/reach-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        table = self.spark.read.parquet(folder)
        self.folders.append((table, folder))
        return table

    def drop(self, *but: DataFrame) -> None:
        """Deletes all tables but these."""
        for table, folder in self.folders:
            if not any(table is t for t in but):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folders = [x for x in self.folders if any(x[0] is t for t in but)]


def label(node: str) -> Column:
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("node"))


def first_reached(edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, first): of the nodes that a node of edges (from, to) reaches, itself included, the first in an order by hash."""
    nodes = edges.select(F.explode(F.array("from", "to")).alias("node")).distinct()
    written, mark = Written(edges), None
    lone = written.put(edges.groupBy("from").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to")).where("n = 1").select("from", "to", label("from").alias("first")))
    for _ in range(lone.count().bit_length()):  # after i rounds, the first of 2**i nodes on the way, and where it leads
        on = lone.select(F.col("from").alias("to"), F.col("to").alias("then"), F.col("first").alias("other"))
        lone = written.put(lone.join(on.hint("merge"), "to", "left").select("from", F.coalesce("then", "to").alias("to"), F.least("first", "other").alias("first")))
        written.drop(lone)
    edges = edges.join(lone.select("from").hint("merge"), "from", "left_anti").unionByName(lone.select("from", "to"))
    edges = written.put(edges.select("from", "to"))
    found = written.put(nodes.join(lone.select(F.col("from").alias("node"), "first").hint("merge"), "node", "left").select("node", F.coalesce("first", label("node")).alias("first")))
    written.drop(edges, found)
    for _ in range(rounds):
        ahead = edges.join(found.withColumnRenamed("node", "to").hint("merge"), "to").select(F.col("from").alias("node"), "first")
        seen = found.select(F.col("first.node").alias("node")).distinct().join(found.hint("merge"), "node").select(F.col("node").alias("seen"), F.col("first").alias("further"))
        further = found.join(seen.hint("merge"), F.col("first.node") == F.col("seen")).select("node", F.col("further").alias("first"))
        new = written.put(found.unionByName(ahead).unionByName(further).groupBy("node").agg(F.min("first").alias("first")))
        written.drop(new, edges)
        found = new
        now = found.agg(F.sum(F.xxhash64("node", "first.node").cast("decimal(38,0)"))).first()
        if now == mark:
            out = cut(found)
            written.drop()
            return out
        mark = now
    written.drop()
    raise RuntimeError(f"the search has not settled in {rounds} rounds")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges both ends of which have an edge in and an edge out."""
    both = edges.select("from").distinct().join(edges.select(F.col("to").alias("from")).hint("merge"), "from", "left_semi")
    return edges.join(both.hint("merge"), "from", "left_semi").join(both.withColumnRenamed("from", "to").hint("merge"), "to", "left_semi").select("from", "to")


def strongly_connected(edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) of strongly connected components of at least two nodes, and of self-loops; component is the
    smallest node."""
    written = Written(edges)
    e = written.put(edges.select("from", "to").where("`from` is not null and `to` is not null").distinct())
    loops = cut(e.where(F.col("from") == F.col("to")).select(F.col("from").alias("node"), F.col("from").alias("component")))
    e, peeled = e.where(F.col("from") != F.col("to")), []
    end = lambda t, side, name: t.select(F.col("node").alias(side), F.col("first").alias(name)).hint("merge")
    for _ in range(rounds):
        e = written.put(trimmed(e))
        written.drop(e)
        if e.isEmpty():
            break
        ahead = first_reached(e, rounds)
        inside = written.put(e.join(end(ahead, "from", "a"), "from").join(end(ahead, "to", "b"), "to").where("a = b").select("from", "to"))
        behind = first_reached(inside.select(F.col("to").alias("from"), F.col("from").alias("to")), rounds)
        both = cut(behind.withColumnRenamed("first", "back").join(ahead.hint("merge"), "node"))
        peeled.append(both.where("back = first").select("node", F.col("first.node").alias("root")))
        left = both.where("back <> first").select("node", F.col("back").alias("first"))
        e = inside.join(end(left, "from", "a"), "from").join(end(left, "to", "b"), "to").where("a = b").select("from", "to")
    else:
        written.drop()
        raise RuntimeError(f"the components have not settled in {rounds} rounds")
    written.drop()
    if not peeled:
        return loops
    members = cut(functools.reduce(DataFrame.unionByName, peeled))
    named = members.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    out = members.join(named.hint("merge"), "root").select("node", "component")
    return out.unionByName(loops.join(out.select("node").hint("merge"), "node", "left_anti"))


def distances(graph: DataFrame, target: str, hops: int) -> tuple[DataFrame, bool]:
    """(node, left): the edges from a node to the target, as far as ``hops``; and whether no node is farther."""
    seen = front = cut(graph.sparkSession.createDataFrame([(target, 0)], "node string, left int"))
    for left in range(1, hops + 1):
        step = graph.join(front.select(F.col("node").alias("t")), "t").select(F.col("f").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").select("node", F.lit(left).alias("left")))
        if front.isEmpty():
            return seen, True
        seen = cut(seen.unionByName(front))
    beyond = graph.join(front.select(F.col("node").alias("t")), "t").select(F.col("f").alias("node"))
    return seen, beyond.join(seen, "node", "left_anti").isEmpty()


def search_paths(edges: DataFrame, source: str, target: str, hops: int) -> DataFrame:
    """Simple paths (path, ords, complete) of at most ``hops`` edges, level by level. Before, every node learns how far the
    target is; a prefix is only kept while the target can be reached within the bound, so that no level holds a prefix that
    leads nowhere. ``complete``: no prefix was given up for the bound, so there are no other simple paths; if it is false
    there may be longer ones. No row tells either; ask ``distances`` then. The number of paths itself can double with each
    hop: give a bound that the graph can bear."""
    g = cut(path_graph(edges).select(F.col("from").alias("f"), F.col("to").alias("t"), "ord").where("f <> t"))
    near, all_known = distances(g, target, hops)
    near = near.select(F.col("node").alias("t"), "left")
    front = g.where(F.lit(source) != F.lit(target)).where(F.col("f") == source).select(F.array("f").alias("path"), F.array().cast("array<bigint>").alias("ords"), "t", "ord")
    found, complete = None, True
    for depth in range(1, hops + 1):
        step = cut(front.join(near, "t", "left").select(F.concat("path", F.array("t")).alias("path"), F.concat("ords", F.array(F.col("ord").cast("bigint"))).alias("ords"), "t", "left"))
        late = F.col("left").isNull() if not all_known else F.lit(False)
        complete = complete and step.where(late | (F.col("left") + depth > hops)).isEmpty()
        step = step.where(F.col("left") + depth <= hops)
        done = step.where(F.col("t") == target).select("path", "ords")
        found = done if found is None else found.unionByName(done)
        step = step.where(F.col("t") != target).select("path", "ords", F.col("t").alias("f"))
        if step.isEmpty():
            break
        front = step.join(g, "f").where(~F.array_contains("path", F.col("t"))).select("path", "ords", "t", "ord")
    return found.withColumn("complete", F.lit(complete))


def reached(edges: DataFrame, source: str, hops: int, target: str | None = None) -> tuple[DataFrame, bool]:
    """(node, depth, parent) by breadth first, the parent being that of the earliest edge, until the target is found; and
    whether the bound left nothing out."""
    from pyspark.sql import Window

    g = path_graph(edges).select(F.col("from").alias("f"), F.col("to").alias("t"), "ord")
    seen = front = edges.sparkSession.createDataFrame([(source, 0, None, [])], "node string, depth int, parent string, rank array<bigint>")
    for depth in range(1, hops + 1):
        first = F.min(F.struct(F.concat("rank", F.array(F.col("ord").cast("bigint"))).alias("rank"), F.col("f").alias("parent"))).alias("x")
        step = front.join(g, F.col("node") == F.col("f")).groupBy("t").agg(first).join(seen.select(F.col("node").alias("t")), "t", "left_anti")
        front = cut(step.select(F.col("t").alias("node"), F.lit(depth).alias("depth"), "x.parent", "x.rank"))
        if front.isEmpty():
            return seen.select("node", "depth", "parent"), True
        seen = cut(seen.unionByName(front))
        if target is not None and not front.where(F.col("node") == target).isEmpty():
            break
    beyond = front.join(g, F.col("node") == F.col("f")).select(F.col("t").alias("node")).join(seen, "node", "left_anti")
    return seen.select("node", "depth", "parent"), beyond.isEmpty()


def search_shortest(edges: DataFrame, source: str, target: str, max_hops: int = 6) -> tuple[list[str], bool]:
    """The nodes of a shortest directed path, ties by the earliest edge, or an empty list; and whether that is certain. It is
    not if the bound was met before the target."""
    up, certain = reached(edges, source, max_hops, target)
    out, node = [], target
    while True:  # as many lookups as the path has nodes
        row = up.where(F.col("node") == node).select("parent").first()
        if row is None:
            return [], certain
        out.append(node)
        if node == source:
            return out[::-1], True
        node = row.parent
