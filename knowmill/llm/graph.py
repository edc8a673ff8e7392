"""Connected components of an edge table, by alternating stars; nothing is gathered in one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowmill.llm.common import cut, lean

#: Edges that a task contracts at once.
CONTRACT = 1 << 20


def contract(edges: DataFrame) -> DataFrame:
    """Each task's edges (a, b) as stars of what they connect; the same components with fewer edges."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)]))
            size += b.num_rows
            if size >= CONTRACT:
                yield star(np.concatenate(held, 1))
                held, size = [], 0
        if size:
            yield star(np.concatenate(held, 1))

    def star(e):
        nodes, flat = np.unique(e, return_inverse=True)
        a, b = flat.reshape(e.shape)
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        keep = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[label[keep]])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(lean(run), "a bigint, b bigint")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node that can be reached."""
    e = cut(contract(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct())
    mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        if not mark[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        e = cut(small.where("a <> b").distinct())
        new = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components have not settled")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
