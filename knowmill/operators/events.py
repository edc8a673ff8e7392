"""Operators over event logs: statistics, daily summaries, rolling costs, recent errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.functions.text import round2

# Operations that statistics leave out unless asked.
ARCHIVE_OPS = ("archive", "unarchive")
ROLLING, DEFAULT_COST = 50, 0.20
RECENT_ERRORS = 30


def has(df: DataFrame, name: str, kind: str = "double") -> Column:
    """A column if the log has it, else null; logs rarely have all fields."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def cost(df: DataFrame) -> Column:
    return F.coalesce(has(df, "cost_usd"), has(df, "total_cost_usd"), F.lit(0.0))


def tokens(df: DataFrame) -> Column:
    return F.coalesce(has(df, "tokens"), has(df, "total_tokens"), F.coalesce(has(df, "tokens_in"), F.lit(0.0)) + F.coalesce(has(df, "tokens_out"), F.lit(0.0)))


def duration_ms(df: DataFrame) -> Column:
    d = F.coalesce(has(df, "duration_ms"), has(df, "total_duration_ms"), has(df, "total_duration_seconds") * 1000)
    return F.when(d >= 0, d)


def read_since(events: DataFrame, since: str | None) -> DataFrame:
    """Events from a bound on; a bound that is no timestamp filters nothing, an event without one fails it."""
    bound = F.try_to_timestamp(F.lit(since))
    return events if since is None else events.where(bound.isNull() | (F.try_to_timestamp(F.col("ts").cast("string")) >= bound))


def counted(events: DataFrame, archived: bool = False) -> DataFrame:
    return events if archived else events.where(~F.coalesce(F.col("op"), F.lit("")).isin(*ARCHIVE_OPS))


def stats_by_op(events: DataFrame, archived: bool = False) -> DataFrame:
    """op, events, cost, tokens (null without any) and mean duration."""
    e = counted(events, archived).select(F.coalesce(F.col("op"), F.lit("unknown")).alias("op"), cost(events).alias("c"), tokens(events).alias("t"), duration_ms(events).alias("d"))
    return e.groupBy("op").agg(F.count(F.lit(1)).alias("n_events"), F.sum("c").alias("cost_usd"), F.sum(F.when(F.col("t") > 0, F.col("t"))).alias("tokens"), round2(F.avg("d")).alias("avg_duration_ms"))


def percentile_95(values: Column) -> Column:
    """Element min(floor(0.95 n), n - 1) of the sorted values, which is not a discrete percentile."""
    s = F.sort_array(values)
    return F.get(s, F.least(F.floor(F.size(s) * 0.95).cast("int"), F.size(s) - 1))


def value_stats(events: DataFrame, value: str = "reduction_ratio", *keys: str) -> DataFrame:
    """n, mean, median and 95th of a value by key, exact; the log is read once.

    The log becomes a histogram by key and value, which is dealt out by ranges. A row's rank is its place within its range
    after the counts of the ranges before it, so neither a key nor its distinct values are gathered in one task."""
    from pyspark.sql import Window

    from knowmill.operators.page_graph import cut

    counts = events.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    h = cut(counts.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()))
    inside = F.sum("_n").over(Window.partitionBy("_range", *keys).orderBy("_v"))
    by_key = Window.partitionBy(*keys, F.lit(0))
    ranges = h.groupBy("_range", *keys).agg(F.sum("_n").alias("_c"))
    before = F.coalesce(F.sum("_c").over(by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_range", *keys, before.alias("_before"), F.sum("_c").over(by_key).alias("_total"))
    on = F.lit(True)
    r = ranges.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_range").alias("_at"), "_before", "_total")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_{i}"))
    ranked = h.withColumn("_upto", inside).join(r, on & (F.col("_range") == F.col("_at"))).withColumn("_upto", F.col("_upto") + F.col("_before"))
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_v")))
    total = F.col("_total")
    mid = (at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / 2
    return ranked.groupBy(*keys).agg(F.sum("_n").alias("n"), (F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"), mid.alias("p50"), at(F.least(F.floor(total * 0.95), total - 1)).alias("p95"))


def cost_by_agent(events: DataFrame) -> DataFrame:
    """Full cost of the event to its agent, and the cost of each call to the agent called; sums may exceed the total."""
    own = events.where(F.coalesce(has(events, "agent", "string"), F.lit("")) != "").select(has(events, "agent", "string").alias("agent"), cost(events).alias("c"))
    if "agent_calls" in events.columns:
        calls = events.select(F.explode("agent_calls").alias("x")).select(F.col("x.agent").alias("agent"), F.col("x.cost_usd").cast("double").alias("c"))
        own = own.unionByName(calls.where("agent is not null and agent <> '' and c is not null"))
    return own.groupBy("agent").agg(F.sum("c").alias("cost_usd"))


def roll_up_calls(events: DataFrame) -> DataFrame:
    """Totals of agent_calls where the event has none of its own."""
    out = events
    for name in ("tokens_in", "tokens_out", "cost_usd"):
        total = F.aggregate("agent_calls", F.lit(0.0), lambda a, x, name=name: a + F.coalesce(x[name].cast("double"), F.lit(0.0)))
        out = out.withColumn(name, F.coalesce(has(events, name), F.when(F.size("agent_calls") > 0, total)))
    return out


def daily_counts(events: DataFrame) -> DataFrame:
    """Per day and operation: events, cost_usd (never total_cost_usd) and tokens."""
    day = F.substring(F.col("ts").cast("string"), 1, 10).alias("day")
    zero = lambda c: F.coalesce(has(events, c), F.lit(0.0))
    return events.select(day, "op", zero("cost_usd").alias("c"), zero("tokens_in").alias("i"), zero("tokens_out").alias("o")).groupBy("day", "op").agg(F.count(F.lit(1)).alias("n_events"), F.sum("c").alias("cost_usd"), F.sum("i").alias("tokens_in"), F.sum("o").alias("tokens_out"))


def daily_summary(events: DataFrame, date: str) -> DataFrame:
    """One row for a day: totals and the operation counts in order of their names."""
    d = daily_counts(events.where(F.col("ts").cast("string").startswith(date)))
    return d.agg(
        F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"),
        F.coalesce(F.sum(F.when(F.col("op") == "ingest", F.col("n_events"))), F.lit(0)).alias("ingests"),
        F.coalesce(F.sum(F.when(F.col("op") == "lint", F.col("n_events"))), F.lit(0)).alias("lints"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.sum("tokens_in"), F.lit(0.0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0.0)).alias("tokens_out"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op", "n_events"))), lambda x: F.concat_ws(": ", x["op"], x["n_events"])), "\n").alias("ops"),
    )


def rolling_cost(events: DataFrame, op: str, n: int = ROLLING, default: float = DEFAULT_COST) -> DataFrame:
    """Mean of the last n costs of an operation that are not negative; a top-n, then one row."""
    last = events.where((F.col("op") == op) & (cost(events) >= 0)).select("pos", cost(events).alias("c")).orderBy(F.desc("pos")).limit(n)
    return last.agg(F.coalesce(F.avg("c"), F.lit(default)).alias("avg_cost"), F.count(F.lit(1)).alias("n"))


def recent(events: DataFrame, condition: Column, n: int = RECENT_ERRORS) -> DataFrame:
    """The last n events that meet a condition, oldest first."""
    return events.where(condition).orderBy(F.desc("pos")).limit(n).orderBy("pos")


def is_error(rec: Column) -> Column:
    """Over a JSON text: an error that is not null, or a status of failure, at the top or in details."""
    get = lambda p: F.get_json_object(rec, p)
    bad = lambda s: F.coalesce(F.lower(s).isin("failed", "error"), F.lit(False))
    return get("$.error").isNotNull() | get("$.details.error").isNotNull() | bad(get("$.status")) | bad(get("$.details.status"))


def last_per_op(events: DataFrame, *fields: str) -> DataFrame:
    return events.groupBy("op").agg(F.max("pos").alias("pos"), *[F.max_by(f, "pos").alias(f) for f in fields])


def month_index(events: DataFrame, *order: str) -> DataFrame:
    """Rows by month of their timestamp, newest first within it."""
    return events.withColumn("month", F.date_format("ts", "yyyy-MM")).orderBy(F.desc("month"), F.desc("ts"), *order)


def estimate_cost(plan: DataFrame, avg_cost: float, globals_: int = 0) -> DataFrame:
    """From rows with ``cached``: what ingesting the rest will cost."""
    n = plan.agg(F.count_if(~F.col("cached")).alias("uncached"), F.count_if(F.col("cached")).alias("cached"))
    return n.select("uncached", "cached", round2(F.col("uncached") * avg_cost).alias("ingest_usd"), round2(F.lit(globals_ * DEFAULT_COST)).alias("globals_usd"), round2(F.col("uncached") * avg_cost + globals_ * DEFAULT_COST).alias("total_usd"))
