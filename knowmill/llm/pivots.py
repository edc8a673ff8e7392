"""Approximate nearest neighbours by a permutation index.

Index: ``pivots`` are vectors of the table, the first PIVOT_ROOT * sqrt(n) by a hash of their ids, at least LEAST_PIVOTS and
at most MOST_PIVOTS. A vector is represented by its ORDER nearest pivots, nearest first. Every vector is indexed. Vectors
are laid out by their nearest pivot in blocks of about BLOCK rows (a frequent pivot has several blocks), and each block's
pivot inverted file is posted in a table: (pivot, block, least position of the pivot in any vector of the block).

Search: two vectors' closeness is the sum over shared pivots of m - max(i, j), where m is ORDER and i, j are the pivot's
positions; the footrule distance, with missing pivots at position m, is m(m + 1) less twice that. A query reads the posted
lists of its pivots, which bound its closeness to all vectors of a block, and visits the blocks that can hold a
vector within the radius. There it adds up the closeness along the postings of its pivots, and those within the radius,
in order of footrule distance, are reranked by the measure itself. The radius is fitted: for SAMPLE queries, chosen by a
hash, the true neighbours are found among all rows, and the radius is the footrule distance within which TARGET percent of
them lie. There is no cap on candidates. Queries with fewer than k candidates, and all of them if TARGET percent share no
pivot with their neighbours, are compared with every row, block by block.

The measure is the inner product in double precision, summed component by component on the vectors as they are. Since the
nearest pivots only say something about neighbours if norms are equal, both are compared in one more dimension: rows get
sqrt(M**2 - |x|**2), M the greatest norm, and queries 0; the product with a query is the same.

Vectors that are null, empty or zero, hold a null or non-finite component or have another length than most take no part.
Rows that repeat an id are candidates each, none is a neighbour of a query of its own id, and of queries that repeat an id
each is answered. Ties go to the smaller id, null ids last. Fewer than k rows: all of them.
Empty table: empty result. Norms and products may overflow to infinity; a product that is no number ranks last. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowmill.llm.common import cut, delete, lean, new_folder, table
from knowmill.llm.vectors import common_length, matrix, sound

K = 20
EVERY = 20
#: Pivots, of which a sample is drawn whose size is bounded, and how many of the nearest represent a vector.
PIVOT_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 2, 128, 8192
ORDER = 64
#: Rows of a block, and queries that a block answers in one task.
BLOCK, CHUNK = 4096, 4096
#: Blocks whose posted lists a task reads side by side, and queries that it asks them for.
TILE, ASKED = 256, 1 << 16
#: Queries by which the radius is fitted, and percent of their neighbours that it must hold.
SAMPLE, TARGET = 256, 95

FOUND = "_q bigint, _qid bigint, _id bigint, _score double, _n bigint"
#: Sorts after all ids, for rows without one.
NO_ID = np.iinfo(np.int64).max


def orders(v: np.ndarray, pivots: np.ndarray, most: float, m: int) -> np.ndarray:
    """The m nearest pivots of each vector, nearest first, ties to the lower number. most: the greatest norm, 0 for queries."""
    scale = np.abs(pivots).max(initial=0) or 1.0
    p = pivots / scale
    with np.errstate(over="ignore", invalid="ignore"):
        near = (v / scale) @ p[:, :-1].T
        if most:
            x = np.sqrt(np.maximum((most / scale) ** 2 - np.square(v / scale).sum(1), 0))
            near += x[:, None] * p[:, -1]
    return np.argsort(-np.nan_to_num(near), axis=1, kind="stable")[:, :m].astype(np.uint16)


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Pivots with the dimension that makes norms equal."""
    scale = most or 1.0
    rest = np.sqrt(np.maximum(1 - np.square(v / scale).sum(1), 0)) * scale
    return np.concatenate([v, rest[:, None]], 1)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with q, summed in the order of components."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(x.shape[1]):
            total += x[:, i] * q[i]
    return total


def leading(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of the largest products with q, ties to the smaller of ids, and the products; of the rows ``some``, if given."""
    rows = np.arange(len(x)) if some is None else some
    own = x if some is None else x[some]
    with np.errstate(over="ignore", invalid="ignore"):
        rough = own @ q
        slack = 1e-12 * x.shape[1] * np.abs(own).max(initial=0) * np.abs(q).sum()
    if len(rows) > k and np.isfinite(rough).all() and np.isfinite(slack):
        rows = rows[rough >= np.partition(rough, -k)[-k] - 2 * slack]
    score = products(x[rows], q)
    first = np.lexsort((ids[rows], -np.where(np.isnan(score), -np.inf, score)))[:k]
    return rows[first], score[first]


def packed(order: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(order.to_pylist()), np.uint16).reshape(len(order), -1)


def prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(_id, _v) of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.where(sound(vector)).select(F.col(f"`{key}`").cast("bigint").alias("_id"), v.alias("_v")).where(F.exists("_v", lambda x: x != 0))
    return rows.where(F.size("_v") == common_length(rows, "_v"))


class Index:
    """A permutation index of df in the shared folder; ``drop`` deletes it."""

    def __init__(self, df: DataFrame, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.folders = df.sparkSession, []
        rows = prepared(df, key, vector)
        norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
        got = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most")).first()
        self.n, self.most = got.n, got.most if got.most is not None and np.isfinite(got.most) else 0.0
        wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(PIVOT_ROOT * self.n**0.5)))
        drawn = rows.orderBy(F.xxhash64("_id"), "_id", "_v").limit(wanted).collect()  # at most MOST_PIVOTS vectors
        self.pivots = lifted(np.array([r._v for r in drawn], float), self.most) if drawn else np.empty((0, 1))
        self.order = min(ORDER, len(self.pivots))
        placed = self._stored(self._placed(self._ordered(rows)), "pivot-index")
        self.rows = placed
        self.posted = self._stored(self._postings(placed), "pivot-lists")

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        self.folders.append(new_folder(self.spark, name))
        df.write.parquet(self.folders[-1])
        return self.spark.read.parquet(self.folders[-1])

    def drop(self) -> None:
        while self.folders:
            delete(self.spark, self.folders.pop())

    def _ordered(self, rows: DataFrame, query: bool = False) -> DataFrame:
        pivots, most, m = self.pivots, 0.0 if query else self.most, self.order

        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    some = b.slice(i, 1024)
                    order = orders(matrix(some.column(1)), pivots, most, m)
                    blobs = pa.array([r.tobytes() for r in order], pa.binary())
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), blobs, pa.array(order[:, 0].astype(np.int32))], names=["_id", "_v", "_order", "_home"])

        return rows.select("_id", "_v").mapInArrow(lean(run), "_id bigint, _v array<double>, _order binary, _home int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their blocks: pivots' rows, in the order of pivots, fill blocks; a pivot of more rows has several."""
        rows = self._stored(rows, "pivot-orders")
        start, at = {}, 0
        for r in sorted(rows.groupBy("_home").count().collect()):  # at most MOST_PIVOTS rows
            start[r[0]] = (at // BLOCK, -(-r[1] // BLOCK)) if r[1] > BLOCK else (at // BLOCK, 1)
            at = (at // BLOCK + start[r[0]][1]) * BLOCK if r[1] > BLOCK else at + r[1]
        places = self.spark.createDataFrame([(h, b, k) for h, (b, k) in start.items()], "_home int, _from bigint, _many bigint")
        spread = F.pmod(F.xxhash64("_id", "_order", "_v"), F.col("_many"))
        return rows.join(F.broadcast(places), "_home").select("_id", "_v", "_order", (F.col("_from") + spread).alias("_block"))

    def _postings(self, rows: DataFrame) -> DataFrame:
        """(pivot, block, least): the pivot inverted files of the blocks, one row for each list."""
        size = len(self.pivots)

        def run(batches):
            least: dict[int, np.ndarray] = {}
            for b in batches:
                blocks, order = b.column(0).to_numpy(), packed(b.column(1))
                for block in np.unique(blocks):
                    own = least.setdefault(int(block), np.full(size, 1 << 15))
                    mine = order[blocks == block]
                    np.minimum.at(own, mine.ravel(), np.tile(np.arange(mine.shape[1]), len(mine)))
                if len(least) >= 64:
                    yield from told(least)
                    least = {}
            yield from told(least)

        def told(least):
            for block, own in least.items():
                there = np.flatnonzero(own < 1 << 15)
                yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(np.full(len(there), block, np.int64)), pa.array(own[there].astype(np.int32))], names=["pivot", "block", "least"])

        lists = rows.select("_block", "_order").mapInArrow(lean(run), "pivot int, block bigint, least int")
        return lists.groupBy("pivot", "block").agg(F.min("least").alias("least"))

    def fitted(self, queries: DataFrame, k: int) -> int:
        """The closeness that TARGET percent of a sample's true neighbours reach; 0 if that is without a shared pivot."""
        drawn = queries.orderBy(F.xxhash64("_qid"), "_qid", "_q").limit(SAMPLE).collect()
        if not drawn:
            return 1
        q, qid = np.array([r._v for r in drawn]), [r._qid for r in drawn]
        marks = [np.frombuffer(r._order, np.uint16) for r in drawn]
        m, size = self.order, len(self.pivots)

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    some = b.slice(at, 2048)
                    ids = some.column(0).fill_null(NO_ID).to_numpy()
                    x, order = matrix(some.column(1)), packed(some.column(2)).astype(np.int64)
                    out = [[], [], [], []]
                    for i in range(len(q)):
                        own = qid[i] is not None and (ids == qid[i]).any()
                        rows, score = leading(x, ids, q[i], k, np.flatnonzero(ids != qid[i]) if own else None)
                        weight = np.zeros((size, m), np.int32)
                        weight[marks[i]] = m - np.maximum(np.arange(m)[:, None], np.arange(m))
                        for o, a in zip(out, (np.full(len(rows), i, np.int32), ids[rows], score, weight[order[rows], np.arange(m)].sum(1).astype(np.int32)), strict=True):
                            o.append(a)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["q", "id", "score", "close"])

        near = self.rows.select("_id", "_v", "_order").mapInArrow(lean(run), "q int, id bigint, score double, close int")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(ranked("score"), "id", F.desc("close")))
        closes = sorted(r.close for r in near.select("close", rank.alias("rank")).where(F.col("rank") <= k).collect())  # at most SAMPLE * k rows
        return closes[len(closes) * (100 - TARGET) // 100] if closes else 1

    def search(self, df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
        """(query_id, rank, key, score): the k nearest of each row of df, without rows of its own id."""
        queries = prepared(df, key, vector)
        if not len(self.pivots) or (length := common_length(queries, "_v")) != self.pivots.shape[1] - 1 and length:
            return named(self.spark.createDataFrame([], FOUND), key, k)
        queries = self._stored(self._ordered(queries, query=True).select(F.monotonically_increasing_id().alias("_q"), F.col("_id").alias("_qid"), "_v", "_order"), "pivot-queries")
        radius = self.fitted(queries, k)
        every = queries.select("_q", F.explode(F.sequence(F.lit(0), F.lit(self._last()))).alias("_block"))
        if radius < 1:
            return named(cut(self._visit(queries, every, 0, k)), key, k)
        found = cut(self._visit(queries, self._routes(queries, radius), radius, k))
        counts = found.groupBy("_q").agg(F.sum("_n").alias("n"))
        short = cut(queries.join(counts, "_q", "left").where(F.coalesce("n", F.lit(0)) < k).select("_q"))
        if short.limit(1).count():
            rest = self._visit(queries, every.join(short, "_q"), 0, k)
            found = cut(found.join(short, "_q", "left_anti").unionByName(rest))
        return named(found, key, k)

    def _last(self) -> int:
        return self.rows.agg(F.max("_block")).first()[0] or 0

    def _routes(self, queries: DataFrame, radius: int) -> DataFrame:
        """(_q, _block) of the blocks that can hold a vector within the radius of a query: the posted lists of TILE blocks,
        side by side, are read at the pivots of up to ASKED queries at a time."""
        m, size = self.order, len(self.pivots)
        parts = -(-queries.count() // ASKED)
        part = lambda: F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))).alias("part")
        tile = F.floor(F.col("block") / TILE).cast("int")
        lists = self.posted.select(tile.alias("tile"), part(), "pivot", "block", "least")
        tiles = F.explode(F.sequence(F.lit(0), F.lit(self._last() // TILE).cast("int"))).alias("tile_of")
        asked = queries.select(tiles, F.pmod(F.xxhash64("_q"), F.lit(max(parts, 1))).cast("int").alias("part_of"), "_q", "_order")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            q, block = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            if left.num_rows and right.num_rows:
                first = int(left.column("tile")[0].as_py()) * TILE
                least = np.full((size, TILE), m, np.int16)
                least[left.column("pivot").to_numpy(), left.column("block").to_numpy() - first] = left.column("least").to_numpy()
                numbers, place = right.column("_q").to_numpy(), np.arange(m)[:, None]
                for n, marks in zip(numbers, packed(right.column("_order")), strict=True):
                    there = np.flatnonzero((m - np.maximum(least[marks], place)).sum(0) >= radius)
                    q.append(np.full(len(there), n))
                    block.append(there + first)
            return pa.table({"_q": np.concatenate(q), "_block": np.concatenate(block)})

        return lists.groupBy("tile", "part").cogroup(asked.groupBy("tile_of", "part_of")).applyInArrow(run, "_q bigint, _block bigint")

    def _visit(self, queries: DataFrame, visits: DataFrame, radius: int, k: int) -> DataFrame:
        """The nearest of each block for each query that visits it, and how many rows came into question there. A block that
        many queries visit is read in several tasks, each of which answers some of them."""
        m, size = self.order, len(self.pivots)
        visits = cut(visits)
        chunks = visits.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_many"))
        asked = visits.join(chunks, "_block").select("_q", "_block", F.pmod(F.xxhash64("_q"), "_many").cast("int").alias("_chunk"))
        asked = asked.join(queries, "_q").select("_block", "_chunk", "_q", "_qid", F.col("_v").alias("_qv"), F.col("_order").alias("_marks"))
        held = self.rows.join(chunks, "_block").select("_block", F.explode(F.sequence(F.lit(0), F.col("_many").cast("int") - 1)).alias("_chunk"), "_id", "_v", "_order")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            if left.num_rows and right.num_rows:
                x, flat = matrix(left.column("_v").combine_chunks()), packed(left.column("_order")).ravel()
                ids = left.column("_id").fill_null(NO_ID).to_numpy()
                by = np.argsort(flat, kind="stable")  # the block's lists, one after another
                starts = np.searchsorted(flat[by], np.arange(size + 1))
                vector, place = by // m, by % m
                q, marks = matrix(right.column("_qv").combine_chunks()), packed(right.column("_marks")).astype(np.int64)
                for i, (qn, qid) in enumerate(zip(right.column("_q").to_pylist(), right.column("_qid").to_pylist(), strict=True)):
                    low, high = starts[marks[i]], starts[marks[i] + 1]
                    spot = np.concatenate([place[a:b] for a, b in zip(low, high, strict=True)])
                    hit = np.concatenate([vector[a:b] for a, b in zip(low, high, strict=True)])
                    close = np.bincount(hit, m - np.maximum(np.repeat(np.arange(m), high - low), spot), len(x))
                    some = np.flatnonzero((close >= radius) & (ids != qid) if qid is not None else close >= radius)
                    few, score = leading(x, ids, q[i], k, some)
                    n = len(few)
                    for o, a in zip(out, (np.full(n, qn), np.full(n, NO_ID if qid is None else qid), ids[few], score, np.where(np.arange(n) == 0, len(some), 0)), strict=True):
                        o.append(a)
            cols = [np.concatenate(o) if o else np.empty(0) for o in out]
            whole = lambda c: pa.array(c.astype(np.int64), mask=c == NO_ID)
            return pa.Table.from_arrays([whole(cols[0]), whole(cols[1]), whole(cols[2]), pa.array(cols[3].astype(np.float64)), whole(cols[4])], names=["_q", "_qid", "_id", "_score", "_n"])

        asked = asked.select(F.col("_block").alias("_b"), F.col("_chunk").alias("_c"), "_q", "_qid", "_qv", "_marks")
        return held.groupBy("_block", "_chunk").cogroup(asked.groupBy("_b", "_c")).applyInArrow(run, FOUND)


def ranked(score: str) -> Column:
    return F.when(F.isnan(score), F.lit(float("-inf"))).otherwise(F.col(score)).desc()


def named(found: DataFrame, key: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(ranked("_score"), F.asc_nulls_last("_id")))
    return found.select("*", rank.alias("rank")).where(F.col("rank") <= k).select(F.col("_qid").alias("query_id"), "rank", F.col("_id").alias(key), F.col("_score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = Index(rows)
    out = cut(index.search(rows.where(F.col("vec_id") % EVERY == 0)))
    index.drop()
    return out
