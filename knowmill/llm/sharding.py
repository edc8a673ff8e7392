"""Shards by jump consistent hashing: a stable integer key and the number of shards decide, without a ring table.

With one more shard a key either stays or moves into the new shard, and 1/(n+1) of the keys move. The generator is the
64-bit linear congruential one of the published algorithm, here in decimals so that products do not overflow.

``slot`` numbers the rows of a shard from 0 without gaps. A shard is cut into BINS by a hash of key, checksum and size;
rows are ordered within a bin, and the bins' counts, of which there are at most shards * BINS whatever the input, give
each bin its offset. No task gets a whole shard, nor all rows of a key that differ.

Null key: as key 0. Null text: no bytes (size 8, CRC 0). Equal keys share a shard, and rows with equal texts too share a bin. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
BINS = 4096
FACTOR = 2862933555777941757


def integer_key(df: DataFrame, key: str) -> Column:
    """A key of integers as it is, of anything else as 60 bits of its MD5."""
    kind, c = dict(df.dtypes)[key], F.col(f"`{key}`")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    return F.coalesce(F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def unsigned(k: Column) -> Column:
    return F.when(k < 0, k.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(k.cast("decimal(20,0)")).cast("decimal(20,0)")


def draw(k: Column) -> Column:
    """The generator's next state."""
    return (((k * F.lit(str(FACTOR)).cast("decimal(19,0)")).cast("decimal(38,0)") + F.lit(1)).cast("decimal(38,0)") % F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")


def jump(k: Column, shards: int) -> Column:
    """struct(shard, grown): the shard of key k among ``shards`` and among one more; each step jumps to a higher shard."""
    n, long = shards + 1, "bigint"
    state = lambda k, j, a, b: F.struct(k.cast("decimal(20,0)").alias("k"), j.cast(long).alias("j"), a.cast(long).alias("a"), b.cast(long).alias("b"))

    def step(s: Column, _: Column) -> Column:
        nxt = draw(s["k"])
        high = F.call_function("div", nxt, F.lit("8589934592").cast("decimal(20,0)")).cast("double") + 1
        to = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / high))
        return F.when(s["j"] < n, state(nxt, to, F.when(s["j"] < shards, s["j"]).otherwise(s["a"]), s["j"])).otherwise(s)

    start = state(unsigned(k), F.lit(0), F.lit(0), F.lit(0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda s: F.struct(s["a"].cast("int").alias("shard"), s["b"].cast("int").alias("grown")))


def shard(df: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """df with shard and grown_shard (among one more); replaces columns of these names."""
    j = df.withColumn("_jump", jump(integer_key(df, key), shards))
    return j.withColumn("shard", F.col("_jump.shard")).withColumn("grown_shard", F.col("_jump.grown")).drop("_jump")


def place(df: DataFrame, key: str, shards: int = SHARDS, order: tuple[str, ...] = ()) -> DataFrame:
    """df with shard, grown_shard and slot. A bin is chosen by key and ``order``, in which rows of a bin are ordered, so that
    rows of one key are in one bin only if they agree in all of it. Carry only narrow columns through it; df is read twice."""
    digest = F.md5(F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in (key, *order)]))
    rows = shard(df, key, shards).withColumn("_bin", (F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % BINS).cast("int"))
    counts = rows.groupBy("shard", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("_from"))
    w = Window.partitionBy("shard", "_bin").orderBy(key, *order)
    rows = rows.withColumn("_at", F.row_number().over(w))
    return rows.join(F.broadcast(offsets), ["shard", "_bin"]).withColumn("slot", (F.col("_from") + F.col("_at") - 1).cast("bigint")).drop("_from", "_at", "_bin")  # at most shards * BINS rows


def query(spark, sf_dir: str) -> DataFrame:
    from knowmill.llm.common import cut, table

    text = F.coalesce(F.col("text"), F.lit(""))
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))  # each text is read once
    return place(docs, "doc_id", SHARDS, ("text_crc32", "size")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def oracle() -> str:
    """The same in DuckDB: CRC-32 from its polynomial, and the jumps by recursion."""
    return f"""
    WITH RECURSIVE bits(i, c, n) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8),
    crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE n = 8),
    d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
    m AS (SELECT rid, doc_id, (strlen(x) + 8)::BIGINT AS size,
                 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM d, crc),
    jumps(rid, k, j) AS (
        SELECT rid, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END, 0::BIGINT FROM d
        UNION ALL
        SELECT rid, k, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k // 8589934592)::DOUBLE + 1)))::BIGINT
        FROM (SELECT rid, j, (k * {FACTOR}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k FROM jumps WHERE j <= {SHARDS})),
    s AS (SELECT rid, (max(j) FILTER (j < {SHARDS}))::INT AS shard, (max(j) FILTER (j <= {SHARDS}))::INT AS grown_shard FROM jumps GROUP BY rid),
    b AS (SELECT *, ('0x' || substr(md5(concat_ws(chr(9), doc_id, text_crc32, size)), 1, 7))::BIGINT % {BINS} AS bin FROM m JOIN s USING (rid))
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bin, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM b"""
