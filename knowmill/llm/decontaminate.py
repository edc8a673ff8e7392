"""Benchmark passages in documents, found by Wu-Manber search over words.

A pattern is a window of consecutive words of a benchmark item. For each length m of windows, a shift table over blocks
of two words says how far the search may advance, m - 1 words where the block is in no window, so most words are never
looked at; where the shift is 0, the bucket of the block (the window's suffix) holds the windows to compare directly.

A benchmark of at most BLOCK_BYTES, counted first, goes to the tasks as a broadcast, and the documents are read once, without
a shuffle. A larger one stays in the cluster: it is written in blocks of about BLOCK_BYTES to the shared folder, every part
of the documents is searched for every block by a task that builds the block's tables once, and what is found, keyed by
the text's MD5, is merged and joined to the documents. A task holds a batch of documents and one block either way, and a
document is never cut.

Null or wordless texts: no word, nothing hit. Wordless items: no window. Items with a null id mark words but are not
listed. Repeated items count once. Empty tables: empty result, or nothing hit.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowmill.llm.common import cut, lean, new_folder, place, uri_of

WINDOW = 10
#: A window takes some 600 bytes of a task.
BLOCK_BYTES = 2 << 20
#: Texts with hits that may be broadcast.
SMALL_ROWS = 100_000
#: In lower-cased UTF-8, the bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

OUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType())))])
ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("runs", pa.list_(pa.list_(pa.int64())))])


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []  # bytes.lower() changes A-Z only


class Search:
    """Windows of one length."""

    def __init__(self, m: int):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}

    def add(self, window: tuple, item: str | None) -> None:
        b = self.block
        for end in range(b, self.m + 1):
            key = window[end - b : end]
            self.shift[key] = min(self.shift.get(key, self.far), self.m - end)
        self.bucket.setdefault(window[-b:], {}).setdefault(window, set()).add(item)

    def find(self, w: list, runs: list, items: set) -> None:
        m, b, far, shift, bucket = self.m, self.block, self.far, self.shift.get, self.bucket
        i, n = m, len(w)
        while i <= n:
            key = tuple(w[i - b : i])
            if s := shift(key, far):
                i += s
                continue
            found = bucket[key].get(tuple(w[i - m : i]))
            if found is not None:
                runs.append((i - m, i))
                items |= found
            i += 1


def build(rows: list[tuple]) -> list[Search]:
    """Searches for (item_id, text as bytes)."""
    by: dict[int, Search] = {}
    for item, text in rows:
        w = words(text)
        m = min(WINDOW, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by.setdefault(m, Search(m)).add(tuple(w[i : i + m]), None if item is None else str(item))
    return list(by.values())


def joined(runs: list[tuple]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def search(each: list[list], tables: list[Search]) -> list[dict]:
    """What tables find in lists of words."""
    rows = []
    for w in each:
        runs: list[tuple] = []
        items: set = set()
        for s in tables:
            s.find(w, runs, items)
        merged = joined(runs)
        rows.append({"n_words": len(w), "n_hit": sum(z - a for a, z in merged), "items": sorted(x for x in items if x is not None), "runs": merged})
    return rows


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "_hits", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs and a struct ``out``: n_words, n_hit, items (ids sorted as strings) and runs of hit words [from, to)."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.encode(F.col(f"`{item_text}`"), "UTF-8").alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if total > block_bytes:
        return scan_blocks(docs, rows, 1 + total // block_bytes, text, out)
    sent = docs.sparkSession.sparkContext.broadcast([(r.i, None if r.t is None else bytes(r.t)) for r in rows.collect()])  # at most block_bytes
    at = docs.columns.index(text)

    def run(batches):
        tables = build(sent.value)
        for batch in batches:
            found = search([words(t) for t in batch.column(at).cast(pa.binary()).to_pylist()], tables)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, ARROW)], names=[*batch.schema.names, out])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(out, OUT)]))


def scan_blocks(docs: DataFrame, rows: DataFrame, n: int, text: str, out: str) -> DataFrame:
    """scan() with ``n`` blocks of the benchmark's rows (i, t); nothing of it comes to the driver."""
    folder = uri_of(new_folder(docs.sparkSession, "benchmark"))
    rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n))).repartition("block").write.partitionBy("block").parquet(folder)
    texts = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null")

    def block(k: int):
        def run(batches):
            store, local = place(f"{folder}/block={k}")
            try:
                names = [f.path for f in store.get_file_info(fs.FileSelector(local)) if f.path.endswith(".parquet")]
            except FileNotFoundError:  # no row fell into the block
                names = []
            tables = build([r for name in names for r in zip(*pq.read_table(name, filesystem=store, columns=["i", "t"]).to_pydict().values(), strict=True)])
            for batch in batches:
                blobs = batch.column(0).cast(pa.binary()).to_pylist()
                hits = [(hashlib.md5(t).hexdigest(), r["items"], r["runs"]) for t, r in zip(blobs, search([words(t) for t in blobs], tables), strict=True) if r["n_hit"]]
                yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], kind) for c, kind in enumerate((pa.string(), ARROW.field("items").type, ARROW.field("runs").type))], names=["md5", "items", "runs"])

        return texts.mapInArrow(lean(run), "md5 string, items array<string>, runs array<array<bigint>>")

    found = reduce(DataFrame.unionByName, [block(k) for k in range(n)])
    one = found.groupBy("md5").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.flatten(F.collect_set("runs")).alias("runs"))

    def merge(batches):
        for b in batches:
            runs = [joined([tuple(r) for r in x]) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(runs, ARROW.field("runs").type), pa.array([sum(z - a for a, z in x) for x in runs], pa.int64())], names=["_md5", "_items", "_runs", "_n_hit"])

    hits = cut(one.mapInArrow(merge, "_md5 string, _items array<string>, _runs array<array<bigint>>, _n_hit bigint"))
    n_words = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")).cast("bigint")
    value = F.struct(n_words.alias("n_words"), F.coalesce("_n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"), F.coalesce("_runs", F.array().cast("array<array<bigint>>")).alias("runs"))
    side = F.broadcast(hits) if hits.count() <= SMALL_ROWS else hits
    return docs.withColumn("_md5", F.md5(F.col(f"`{text}`").cast("binary"))).join(side, "_md5", "left").select(*[F.col(f"`{c}`") for c in docs.columns], value.alias(out))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    return scan(docs, benchmark).where("_hits.n_hit = 0").drop("_hits")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    from knowmill.llm.common import table

    hits = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "_hits.n_words",
        "_hits.n_hit",
        F.size("_hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("_hits.n_hit") > 0).alias("contaminated"),
    )


def oracle() -> str:
    low = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {low('text')} AS w FROM documents),
    b AS (SELECT item_id, w, least(len(w), {WINDOW}) AS m FROM (SELECT item_id, {low('text')} AS w FROM benchmark) WHERE len(w) > 0),
    p AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
    x AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)),
    h AS (SELECT rid, item_id, m, i FROM x JOIN p USING (m, g)),
    n AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT rid, i, m FROM h)) GROUP BY rid),
    t AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)"""
