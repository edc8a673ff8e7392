"""State writes. A table is replaced as a whole or appended to; rows are never changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowmill.operators.page_graph import EDGE_TYPES, PROVENANCE, check_enum


def append_edges(edges: DataFrame, path: str) -> None:
    """Edges with a known type and provenance, stamped with the day unless they have a date."""
    e = edges.withColumn("type", check_enum(F.col("type"), EDGE_TYPES, "type")).withColumn("provenance", check_enum(F.col("provenance"), PROVENANCE, "provenance"))
    date = F.coalesce("date", F.current_date().cast("string")) if "date" in edges.columns else F.current_date().cast("string")
    e.withColumn("date", date).write.mode("append").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Events as JSON lines, stamped with UTC time unless they have one."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    events.withColumn("ts", F.coalesce("ts", now) if "ts" in events.columns else now).write.mode("append").json(path)


def persist(df: DataFrame, root: str, run: str, name: str) -> str:
    """A document of a run: one JSON folder for each run and name."""
    path = f"{root.rstrip('/')}/{run}/{name}"
    df.write.mode("overwrite").json(path)
    return path


def replace_table(df: DataFrame, path: str) -> int:
    """A table anew, from rows that may come from that very table; the number of rows."""
    from knowmill.operators.page_graph import cut

    out = cut(df)
    out.write.mode("overwrite").parquet(path)
    return out.count()


def record_unit(state: DataFrame, op: str, unit: str) -> DataFrame:
    """state (op, done) with a completed id, once."""
    there = state.withColumn("done", F.when(F.col("op") == op, F.array_union("done", F.array(F.lit(unit)))).otherwise(F.col("done")))
    new = state.sparkSession.createDataFrame([(op, [unit])], "op string, done array<string>").join(state.select("op"), "op", "left_anti")
    return there.unionByName(new)


def clear_op(state: DataFrame, op: str) -> DataFrame:
    return state.where(F.col("op") != op)


def archive(pages: DataFrame, decided: DataFrame, run: str, ts: str) -> DataFrame:
    """Pages with those decided on (path, reason) moved into the archive, as a logical move; the journal follows from it."""
    j = pages.join(decided, "path", "left")
    gone = F.col("reason").isNotNull()
    return j.withColumn("archived_from", F.when(gone, F.col("path"))).withColumn("path", F.when(gone, F.concat(F.lit("_archive/"), "path")).otherwise(F.col("path"))).withColumn("archived_at", F.when(gone, F.lit(ts))).withColumn("archive_run", F.when(gone, F.lit(run)))


def write_texts(rows: DataFrame, path: str) -> None:
    """(slug, body) as one text file for each slug's folder."""
    rows.select("slug", F.col("body").alias("value")).write.mode("overwrite").partitionBy("slug").text(path)


STATE = "op string, done array<string>"


def write_state(state: DataFrame, path: str) -> int:
    """The state of all operations (op, done), as a whole."""
    return replace_table(state.select("op", "done"), path)


def read_state(spark, path: str) -> DataFrame:
    """The state that was written, or an empty one."""
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], STATE)


def exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cache_version(spark, root: str) -> str:
    """The version that a cache states, or "0"."""
    path = f"{root.rstrip('/')}/VERSION"
    return spark.read.text(path, wholetext=True).first()[0].strip() if exists(spark, path) else "0"


def set_cache_version(spark, root: str, version: str) -> None:
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/VERSION")


def without_entries(cache: DataFrame, key: str | None = None, version: str | None = None) -> DataFrame:
    """A cache (key, version, ...) without the entries of a key, of a version, or of both; without any if neither is given."""
    gone = F.lit(True)
    for name, value in (("key", key), ("version", version)):
        if value is not None:
            gone = gone & F.col(name).eqNullSafe(F.lit(value))
    return cache.where(~gone)
