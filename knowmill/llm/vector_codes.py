"""Compression of vectors to short codes: a vector is cut into parts, and each part is replaced by the index of the
nearest entry of that part's codebook. Codebooks are fitted by Lloyd's rounds with Elkan's bounds.

Components become integers, floor(SCALE * x), and all distances that decide are squared Euclidean distances of integers,
so that results do not hang on the order of rows or on how they are split. Between rounds each row keeps, for each part,
its entry, an upper bound of the distance to it, and one lower bound for each entry, in half precision and rounded to the
safe side. When entries move, bounds are shifted by how far. An entry is passed over only if the lower bound, or half the
distance between the two entries, is strictly greater than the upper bound; all others are measured in integers, and ties
go to the lower index. So no tie is ever decided by a bound.

Rows and bounds are written to the shared folder after each round, and the round before is deleted; a lost executor costs
a task of one round. Sums of entries leave a task once for each entry, in limbs of 60 bits, and are added by Spark as
decimals: exact at any size. The driver holds the codebooks only.

Rows with a null vector, or one with a null or non-finite component, are dropped, and so are those without components or of
another length than most. A codebook begins as that part of the rows with the smallest ids (null ids last, ties by
vector); with fewer rows than entries it has fewer entries. Parts differ by one component at most if the length is no
multiple of their number. Rows that repeat an id are rows like any other. Empty table: empty result. Components beyond
2**25 are computed in integers of any size and without bounds; an error beyond 64 bits is returned as null. Other columns
are returned only if asked for with ``keep``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowmill.llm.common import cut, delete, lean, new_folder, table
from knowmill.llm.vectors import common_length, matrix, sound

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Integers whose squared distances are computed in 64 bits.
SAFE = 1 << 25
#: Bits of a limb of a sum.
LIMB = 60
#: Sums of labels that may be broadcast, and copies of them beyond that.
SMALL_LABELS, SALTS = 50_000, 64

SUMS = "array<struct<part:int,entry:int,at:int,limb:int,value:bigint>>"
_SUMS = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))
_whole = np.frompyfunc(lambda x: int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE), 1, 1)


def integers(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * v), as Python's integers where 64 bits might not do for distances."""
    if v.size and np.abs(v).max() >= SAFE / SCALE:
        return _whole(v)
    return np.floor(v * SCALE).astype(np.int64)


def cuts(length: int, parts: int) -> list[slice]:
    ends = [length * i // parts for i in range(parts + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def below(x) -> np.ndarray:
    """Half precision, not above x."""
    x = np.nextafter(x, -np.inf)
    with np.errstate(over="ignore"):
        h = x.astype(np.float16)
    return np.maximum(np.where(h > x, np.nextafter(h, np.float16(-np.inf)), h), np.float16(0))


def above(x) -> np.ndarray:
    """Half precision, not below x."""
    x = np.nextafter(x, np.inf)
    with np.errstate(over="ignore"):
        h = x.astype(np.float16)
    return np.where(h < x, np.nextafter(h, np.float16(np.inf)), h)


def root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Codebook:
    """The entries of one part, how far each has moved, and half the distances between them."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries, self.exact = entries, entries.dtype != object and (not entries.size or np.abs(entries).max() < SAFE)
        if self.exact:
            gaps = root(((entries[:, None] - entries[None]) ** 2).sum(2)) / 2
            self.half = np.nextafter(gaps, 0)
            self.near = np.where(np.eye(len(entries), dtype=bool), np.inf, self.half).min(1)
            self.moved = np.nextafter(root(((entries - before) ** 2).sum(1)), np.inf) if before is not None and before.dtype != object else np.full(len(entries), np.inf)

    def measure(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of all rows to all entries."""
        c = self.entries
        if x.dtype != object and self.exact:
            out = np.empty((len(x), len(c)), np.int64)
            for j in range(len(c)):
                d = x - c[j]
                out[:, j] = np.einsum("ij,ij->i", d, d)
            return out
        out = np.zeros((len(x), len(c)), object)
        for j, entry in enumerate(c.astype(object)):
            for i in range(x.shape[1]):
                out[:, j] += (x[:, i].astype(object) - entry[i]) ** 2
        return out

    def assign(self, x: np.ndarray, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
        """The nearest entries and their bounds, from those of the round before if there was one."""
        if x.dtype == object or not self.exact:
            code = self.measure(x).argmin(1)
            return code, np.full(len(x), np.inf, np.float16), np.zeros((len(x), len(self.entries)), np.float16)
        if code is None:
            squares = self.measure(x)
            code = squares.argmin(1)
            return code, above(root(squares[np.arange(len(x)), code])), below(root(squares))
        upper = above(upper.astype(np.float64) + self.moved[code])
        lower = below(np.maximum(lower.astype(np.float64) - self.moved, 0))
        rows = np.flatnonzero(upper >= self.near[code])
        a, u = code[rows], upper[rows, None]
        left = (lower[rows] <= u) & (self.half[a] <= u)
        left[np.arange(len(rows)), a] = False
        some = left.any(1)
        rows, a, left = rows[some], a[some], left[some]
        d = x[rows] - self.entries[a]
        own = np.einsum("ij,ij->i", d, d)
        upper[rows], lower[rows, a] = above(root(own)), below(root(own))
        u = upper[rows, None]
        left &= (lower[rows] <= u) & (self.half[a] <= u)
        i, j = np.nonzero(left)
        d = x[rows[i]] - self.entries[j]
        squares = np.full(left.shape, np.iinfo(np.int64).max)
        squares[np.arange(len(rows)), a] = own
        squares[i, j] = np.einsum("ij,ij->i", d, d)
        lower[rows[i], j] = below(root(squares[i, j]))
        code[rows] = squares.argmin(1)
        upper[rows] = above(root(squares.min(1))) if len(rows) else upper[rows]
        return code, upper, lower

    def error(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Squared distances of rows to their own entries, as Python's integers."""
        if x.dtype != object and self.exact:
            d = x - self.entries[code]
            return np.einsum("ij,ij->i", d, d).astype(object)
        d = x.astype(object) - self.entries.astype(object)[code]
        return (d * d).sum(1) if d.shape[1] else np.zeros(len(x), object)


def books(entries: list[np.ndarray], before: list[np.ndarray] | None) -> list[Codebook]:
    return [Codebook(e, before[p] if before else None) for p, e in enumerate(entries)]


def limbs(total: int):
    """(limb, value) whose values times 2**(LIMB * limb) add up to total."""
    i = 0
    while not -(1 << 62) < total < 1 << 62:
        total, low = divmod(total, 1 << LIMB)
        yield i, low
        i += 1
    yield i, total


def round_of(rows: DataFrame, length: int, parts: int, entries: list[np.ndarray], before: list[np.ndarray] | None, last: bool) -> DataFrame:
    """One assignment: rows with their new entries and bounds, and a row of sums for each task; or, at last, codes and errors."""
    kept = rows.schema["_keep"].dataType.simpleString()
    head = f"_id bigint, _keep {kept}, "
    where, first = cuts(length, parts), before is None
    schema = head + ("code string, error bigint" if last else f"_v array<double>, _code binary, _upper binary, _lower binary, _sums {SUMS}")

    def run(batches):
        made, k = books(entries, before), len(entries[0])
        sums = [np.zeros((k, w.stop - w.start), object) for w in where]
        counts = np.zeros((parts, k), np.int64)
        batch = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            v = matrix(col("_v"))
            old = None if first else [np.frombuffer(b"".join(col(c).to_pylist()), t) for c, t in (("_code", np.uint8), ("_upper", np.float16), ("_lower", np.float16))]
            code, error = np.empty((n, parts), np.uint8), np.zeros(n, object)
            upper, lower = np.empty((n, parts), np.float16), np.empty((n, parts, k), np.float16)
            for p, w in enumerate(where):
                x = integers(v[:, w])
                state = (None, None, None) if first else (old[0].reshape(n, parts)[:, p].astype(np.int64), old[1].reshape(n, parts)[:, p], old[2].reshape(n, parts, k)[:, p])
                own, upper[:, p], lower[:, p] = made[p].assign(x, *state)
                code[:, p] = own
                if last:
                    error += made[p].error(x, own)
                    continue
                counts[p] += np.bincount(own, minlength=k)
                if x.dtype == object:
                    for c, row in zip(own, x, strict=True):
                        sums[p][c] += row
                else:
                    sums[p] += ((own == np.arange(k)[:, None]).astype(np.float64) @ x.astype(np.float64)).astype(np.int64)  # exact: below 2**53
            if last:
                errors = [e if e < 1 << 63 else None for e in error.tolist()]
                yield pa.RecordBatch.from_arrays([col("_id"), col("_keep"), pa.array([bytes(c).hex() for c in code]), pa.array(errors, pa.int64())], names=["_id", "_keep", "code", "error"])
            else:
                packed = [pa.array([bytes(r) for r in np.ascontiguousarray(a.reshape(n, -1)).view(np.uint8)], pa.binary()) for a in (code, upper, lower)]
                yield pa.RecordBatch.from_arrays([col("_id"), col("_keep"), col("_v"), *packed, pa.nulls(n, _SUMS)], names=["_id", "_keep", "_v", "_code", "_upper", "_lower", "_sums"])
        if last or batch is None:
            return
        out = [dict(part=p, entry=e, at=i, limb=m, value=x) for p in range(parts) for e in range(k) if counts[p, e] for i, total in enumerate([int(counts[p, e]), *map(int, sums[p][e])], -1) for m, x in limbs(total)]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.schema.field(i).type) for i in range(3)] + [pa.nulls(1, pa.binary())] * 3 + [pa.array([out], _SUMS)], names=["_id", "_keep", "_v", "_code", "_upper", "_lower", "_sums"])

    return rows.mapInArrow(lean(run), schema)


def moved(sums: DataFrame, entries: list[np.ndarray]) -> list[np.ndarray]:
    """Entries replaced by their parts' floored means; unused ones stay. At most a row for each component and limb comes back."""
    x = F.explode("_sums").alias("x")
    got: dict[tuple[int, int, int], int] = {}
    for r in sums.where("_sums is not null").select(x).select("x.*").groupBy("part", "entry", "at", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        key = (r.part, r.entry, r.at)
        got[key] = got.get(key, 0) + (int(r.value) << (LIMB * r.limb))
    out = []
    for p, old in enumerate(entries):
        new = old.astype(object)
        for e in range(len(old)):
            if n := got.get((p, e, -1)):
                new[e] = [got[p, e, i] // n for i in range(old.shape[1])]
        out.append(narrow(new))
    return out


def narrow(entries: np.ndarray) -> np.ndarray:
    """64-bit integers, if all are small enough."""
    return entries if any(abs(x) >= SAFE for x in entries.flat) else entries.astype(np.int64)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(key, *keep, code, error) of each row with a sound vector, and the codebooks, one array of entries for each part."""
    if not 0 < entries <= 256:
        raise ValueError("a code has a byte for each part, so entries must be from 1 to 256")
    spark = df.sparkSession
    rows = df.where(sound(vector))
    length = common_length(rows, vector)
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    rows = rows.where(F.size(F.col(f"`{vector}`")) == length).select(F.col(f"`{key}`").cast("bigint").alias("_id"), kept.alias("_keep"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).collect()
    start = integers(np.array([r._v for r in first], float).reshape(len(first), length))
    now, before, folder = [narrow(start[:, w].astype(object)) for w in cuts(length, parts)], None, None
    if len(start):
        for _ in range(rounds):
            new = new_folder(spark, "codes")
            round_of(rows, length, parts, now, before, last=False).write.parquet(new)
            if folder:
                delete(spark, folder)
            folder, state = new, spark.read.parquet(new)
            now, before = moved(state, now), now
            rows = state.where("_sums is null").drop("_sums")
        out = cut(round_of(rows, length, parts, now, before, last=True))
    else:
        out = rows.select("_id", "_keep", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    if folder:
        delete(spark, folder)
    return out.select(F.col("_id").alias(key), *[F.col(f"_keep.`{c}`").alias(c) for c in keep], "code", "error"), now


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for c in codebooks for x in c.flat).encode()).hexdigest()


def with_group_error(codes: DataFrame, label: str) -> DataFrame:
    """codes with label_error, the errors' sum over rows of one label, nulls together; null if it needs more than 64 bits.
    Labels' sums are broadcast if they are few; else they are copied SALTS times, so that a large label is not one task."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.when(F.count(F.lit(1)) == F.count("error"), total)
    sums = cut(codes.groupBy(F.col(label).alias("_label")).agg(whole.try_cast("bigint").alias("label_error")))
    if sums.count() <= SMALL_LABELS:
        return codes.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    salted = codes.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    copies = sums.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_part"))).drop("_label", "_salt", "_part")


def query(spark, sf_dir: str) -> DataFrame:
    codes, entries = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), keep=("label",))
    return with_group_error(codes, "label").select("vec_id", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))


def oracle() -> str:
    """Plain Lloyd rounds in DuckDB, every part against every entry."""
    nearest = lambda i: f"""a{i} AS MATERIALIZED (SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
        SELECT x.rid, x.part, c.entry, sum((x.x - c.x) * (x.x - c.x))::HUGEINT AS d FROM x JOIN c{i} c USING (part, pos) GROUP BY x.rid, x.part, c.entry) GROUP BY rid, part)"""  # noqa: E731
    update = lambda i: f"""m{i + 1} AS MATERIALIZED (SELECT x.part, entry, pos, floor_div(sum(x.x)::HUGEINT, count(*)) AS x FROM x JOIN a{i} USING (rid, part) GROUP BY x.part, entry, pos),
    c{i + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i + 1} m USING (part, entry, pos))"""  # noqa: E731
    rounds = ",\n    ".join(nearest(i) + ",\n    " + update(i) for i in range(ROUNDS))
    rounds = rounds.replace("floor_div(sum(x.x)::HUGEINT, count(*))", "(sum(x.x)::HUGEINT - ((sum(x.x)::HUGEINT % count(*)) + count(*)) % count(*)) // count(*)")
    return f"""
    WITH s AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding::DOUBLE[]) AS rid, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    t AS (SELECT len(v) AS d FROM s GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
    k AS (SELECT row_number() OVER (ORDER BY rid) AS rid, vec_id, label, v, d FROM s, t WHERE len(v) = d),
    e AS (SELECT rid, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS f, d FROM k),
    p AS (SELECT part, d * part // {PARTS} AS low, d * (part + 1) // {PARTS} AS high FROM t, range({PARTS}) r(part)),
    x AS MATERIALIZED (SELECT rid, part, i - low AS pos, floor({SCALE} * f)::HUGEINT AS x FROM e JOIN p ON i >= low AND i < high),
    c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, x FROM x WHERE rid <= {ENTRIES}),
    {rounds},
    {nearest(ROUNDS)},
    r AS (SELECT rid, string_agg(printf('%02x', entry::BIGINT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid),
    h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{ROUNDS})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN r USING (rid), h"""
