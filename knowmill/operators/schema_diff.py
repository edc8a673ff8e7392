"""Differences between entities in code and tables in a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowmill.functions.paths import table_key


def match(entities: DataFrame, catalog: DataFrame) -> DataFrame:
    """(entity, table) for entities (class_name, schema_name, table_name): the qualified name, or without a schema the first
    table of that name; null where there is none."""
    t = catalog.select("schema", "table", table_key("schema", "table").alias("key")).distinct()
    w = Window.partitionBy("table").orderBy(F.coalesce("schema", F.lit("")))
    bare = t.withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("table").alias("table_name"), F.col("key").alias("bare"))
    e = entities.select(F.col("class_name").alias("entity"), "table_name", F.coalesce("schema_name", F.lit("")).alias("s"), table_key("schema_name", "table_name").alias("key"))
    j = e.join(t.select("key", F.col("key").alias("exact")), "key", "left").join(bare, "table_name", "left")
    return j.select("entity", F.coalesce("exact", F.when(F.col("s") == "", F.col("bare"))).alias("table"))


def diff(entities: DataFrame, columns: DataFrame, catalog: DataFrame) -> DataFrame:
    """(kind, entity, table, field, reason). columns (class_name, name) are the entities'; catalog has schema, table, column."""
    m = match(entities, catalog)
    hit = m.where(F.col("table").isNotNull()).distinct()
    code = hit.join(columns.select(F.col("class_name").alias("entity"), F.col("name").alias("field")).distinct(), "entity")
    db = hit.join(catalog.select(table_key("schema", "table").alias("table"), F.col("column").alias("field")).distinct(), "table")
    code, db = code.select("entity", "table", "field"), db.select("entity", "table", "field")
    none = F.lit(None).cast("string")
    part = lambda df, kind, reason: df.select(F.lit(kind).alias("kind"), "entity", "table", "field", F.lit(reason).alias("reason"))
    tables = catalog.select(table_key("schema", "table").alias("table")).distinct().join(hit.select("table"), "table", "left_anti")
    return (
        part(code.join(db, ["entity", "table", "field"], "left_anti"), "mismatch", "missing_in_db")
        .unionByName(part(db.join(code, ["entity", "table", "field"], "left_anti"), "mismatch", "missing_in_code"))
        .unionByName(part(hit.withColumn("field", none), "matched", "matched"))
        .unionByName(part(m.where(F.col("table").isNull()).withColumn("field", none), "orphan", "no_table"))
        .unionByName(part(tables.select(none.alias("entity"), "table", none.alias("field")), "unmapped", "no_entity"))
    )
