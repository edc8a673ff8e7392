"""Queries of the library over the driver's tables, each with its SQL twin where SQL can express it.

Each binds an operator to columns that play its roles (events as a log, orders and lines as edges, documents as pages), and
runs it over whole tables. Keys that SQL needs for ties are part of every ordering.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowmill.functions import paths as P
from knowmill.functions import text as X
from knowmill.operators import events as E
from knowmill.operators import lifecycle as L
from knowmill.operators import links as K
from knowmill.operators import lint as N
from knowmill.operators import page_graph as G
from knowmill.operators import page_quality as Q
from knowmill.operators import registry as R
from knowmill.operators import render as D
from knowmill.operators import schema_diff as S
from knowmill.operators import services as V
from knowmill.plans import gate as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Roles -------------------------------------------------------------------------------------------------------------------


def log(spark: SparkSession, d: str) -> DataFrame:
    """events as a log: value is the cost, the user the agent."""
    return table(spark, d, "events").select(F.col("event_id").alias("pos"), "ts", F.col("event_type").alias("op"), F.col("user_id").cast("string").alias("agent"), F.col("value").alias("cost_usd"), "props")


def trade(spark: SparkSession, d: str) -> DataFrame:
    """An edge for each pair of customer nation and supplier nation that trade, in order of their names."""
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    e = j.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n_lines"))
    a, b = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("from")), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("to"))
    return e.join(a, "c_nationkey").join(b, "s_nationkey").select((F.col("c_nationkey") * 100 + F.col("s_nationkey")).cast("bigint").alias("ord"), "from", "to", F.lit("extends").alias("type"), "n_lines")


TRADE = """trade AS (SELECT c_nationkey * 100 + s_nationkey AS ord, a.n_name AS f, b.n_name AS t, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey GROUP BY ALL)"""


def orders_graph(spark: SparkSession, d: str) -> DataFrame:
    """customer -> supplier edges through order lines; ord is the line's place."""
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "R", "AMBIGUOUS").when(F.col("l_returnflag") == "A", "INFERRED").otherwise("EXTRACTED")
    return j.select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey")).alias("ord"), F.concat(F.lit("c"), "o_custkey").alias("from"), F.concat(F.lit("s"), "l_suppkey").alias("to"), F.lit("supports").alias("type"), kind.alias("provenance"))


EDGES = """edges AS (SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS ord, 'c' || o_custkey AS f, 's' || l_suppkey AS t, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def doc_pages(spark: SparkSession, d: str) -> DataFrame:
    """documents as pages: source, language and size are their frontmatter."""
    t = table(spark, d, "documents")
    fm = F.to_json(F.struct(F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("Page "), "doc_id")).alias("title"), F.lit("concept").alias("type"), F.array("source", "lang").alias("sources"), F.array(F.when(F.col("doc_id") % 3 == 0, F.lit("schema")).otherwise(F.lit("prose")), "lang").alias("tags"), F.when(F.col("doc_id") % 5 != 0, F.lit("s")).alias("summary")))
    return t.select("doc_id", F.concat(F.lit("wiki/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"), F.col("text").alias("body"), fm.alias("fm"))


def web_links(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, link) of every address in a page."""
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), 1)).alias("link"))


# Events ------------------------------------------------------------------------------------------------------------------


@query("SELECT event_type AS op, count(*) AS n_events, round(sum(value), 4) AS cost_usd, round(avg(value), 6) AS mean, round(median(value), 6) AS p50, round(list_sort(list(value))[least(floor(count(value) * 0.95)::INT, count(value) - 1) + 1], 6) AS p95 FROM events GROUP BY event_type")
def event_stats_by_op(spark, d):
    e = log(spark, d)
    v = E.value_stats(e, "cost_usd", "op")
    s = E.stats_by_op(e).select("op", "n_events", "cost_usd")
    return s.join(v, "op").select("op", "n_events", F.round("cost_usd", 4).alias("cost_usd"), F.round("mean", 6).alias("mean"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT event_type AS op, count(*) AS n_events, round(sum(value), 4) AS cost_usd FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type <> 'archive' GROUP BY event_type")
def event_stats_since(spark, d):
    return E.stats_by_op(E.read_since(log(spark, d), "2024-01-15")).select("op", "n_events", F.round("cost_usd", 4).alias("cost_usd"))


@query("SELECT user_id::VARCHAR AS agent, round(sum(value), 4) AS cost_usd FROM events GROUP BY user_id")
def event_cost_by_agent(spark, d):
    return E.cost_by_agent(log(spark, d)).select("agent", F.round("cost_usd", 4).alias("cost_usd"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS op, count(*) AS n_events, round(sum(value), 4) AS cost_usd FROM events GROUP BY ALL")
def daily_event_counts(spark, d):
    return E.daily_counts(log(spark, d)).select("day", "op", "n_events", F.round("cost_usd", 4).alias("cost_usd"))


@query("SELECT sum(n)::BIGINT AS n_events, round(sum(c), 4) AS cost_usd, string_agg(event_type || ': ' || n, chr(10) ORDER BY event_type) AS ops FROM (SELECT event_type, count(*) AS n, sum(value) AS c FROM events WHERE ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-13' GROUP BY event_type)")
def daily_summary(spark, d):
    return E.daily_summary(log(spark, d), "2024-01-12").select("n_events", F.round("cost_usd", 4).alias("cost_usd"), "ops")


@query("SELECT round(coalesce(avg(value), 0.2), 6) AS avg_cost, count(*) AS n FROM (SELECT value FROM events WHERE event_type = 'purchase' AND value >= 0 ORDER BY event_id DESC LIMIT 50)")
def rolling_ingest_avg(spark, d):
    return E.rolling_cost(log(spark, d), "purchase").select(F.round("avg_cost", 6).alias("avg_cost"), "n")


@query("SELECT event_id AS pos, user_id::VARCHAR AS agent, value AS cost_usd FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 30")
def recent_errors(spark, d):
    return E.recent(log(spark, d), F.col("op") == "error").select("pos", "agent", "cost_usd")


@query("SELECT event_type AS op, max(event_id) AS pos, max_by(user_id, event_id)::VARCHAR AS agent FROM events GROUP BY event_type")
def last_event_per_op(spark, d):
    return E.last_per_op(log(spark, d), "agent")


@query("SELECT event_type AS op, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, max((props->>'$.k')::BIGINT) AS k_max FROM events GROUP BY event_type")
def props_rollup(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return log(spark, d).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_orders, max(o_orderkey) AS last_key, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def archive_month_index(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderkey").alias("last_key"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT count(*) FILTER (o_orderstatus <> 'F') AS uncached, count(*) FILTER (o_orderstatus = 'F') AS cached, floor(count(*) FILTER (o_orderstatus <> 'F') * 0.25 * 100 + 0.5) / 100 AS ingest_usd, floor((count(*) FILTER (o_orderstatus <> 'F') * 0.25 + 0.8) * 100 + 0.5) / 100 AS total_usd FROM orders")
def cost_estimate(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("cached"))
    return E.estimate_cost(o, 0.25, 4).select("uncached", "cached", "ingest_usd", "total_usd")


# Page graphs -------------------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT f AS node FROM edges UNION ALL SELECT t FROM edges) GROUP BY node")
def node_degrees(spark, d):
    return G.degrees(orders_graph(spark, d)).select("node", "degree")


@query(f"WITH {EDGES} SELECT node, degree FROM (SELECT node, count(*) AS degree, min(o) AS first FROM (SELECT f AS node, ord * 2 AS o FROM edges UNION ALL SELECT t, ord * 2 + 1 FROM edges) GROUP BY node) ORDER BY degree DESC, first LIMIT 10")
def god_nodes(spark, d):
    return G.god_nodes(orders_graph(spark, d))


@query("SELECT 'c' || c_custkey AS page, count(l_orderkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey HAVING count(l_orderkey) <= 1")
def isolated_nodes(spark, d):
    return G.isolated(orders_graph(spark, d), table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("page")))


@query(f"WITH {EDGES} SELECT count(*) AS n_edges, avg((l_returnflag = 'R')::INT)::DOUBLE AS rate, avg((l_returnflag = 'R')::INT) > 0.2 AS warn FROM edges")
def ambiguity_rate(spark, d):
    return G.ambiguity(orders_graph(spark, d))


@query(f"WITH {EDGES}, d AS (SELECT node, count(*) AS degree FROM (SELECT f AS node FROM edges UNION ALL SELECT t FROM edges) GROUP BY node) SELECT degree AS threshold FROM d ORDER BY degree DESC LIMIT 1 OFFSET (SELECT greatest(1, ceil(count(*) * 0.1))::BIGINT - 1 FROM d)")
def top_decile_threshold(spark, d):
    return G.top_decile(G.degrees(orders_graph(spark, d)))


@query(f"WITH {EDGES} SELECT f AS \"from\", t AS \"to\", min(ord) AS ord, max_by(l_returnflag, ord) = 'R' AS last_returned FROM edges GROUP BY f, t")
def path_graph(spark, d):
    return G.path_graph(orders_graph(spark, d)).select("from", "to", "ord", (F.col("provenance") == "AMBIGUOUS").alias("last_returned"))


def region_edges(spark, d):
    """Parts that follow each other in brand and size: a sparse graph of many components."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_size")
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand", "p_size").orderBy("k")
    return p.withColumn("n", F.lead("k").over(w)).where("n is not null").select(F.col("k").alias("ord"), F.concat(F.lit("p"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("from"), F.concat(F.lit("p"), F.lpad(F.col("n").cast("string"), 9, "0")).alias("to"), F.lit("extends").alias("type"))


@query("SELECT 'p' || lpad(min(p_partkey)::VARCHAR, 9, '0') AS component, count(*) AS n_nodes FROM part GROUP BY p_brand, p_size HAVING count(*) > 1")
def page_clusters(spark, d):
    return G.clusters(region_edges(spark, d))


@query("SELECT 'p' || lpad(min(p_partkey)::VARCHAR, 9, '0') AS component, count(*) AS n_nodes FROM part GROUP BY p_brand, p_size HAVING count(*) = 2")
def thin_clusters(spark, d):
    return G.thin_clusters(region_edges(spark, d))


def ring(spark, d):
    """nation -> the next nation of its region by key, and the last of a region -> the first of the next region."""
    from pyspark.sql import Window

    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    w = Window.orderBy("n_regionkey", "n_nationkey")  # the 25 nations of the fixed table
    return n.withColumn("to", F.lead("n_name").over(w)).where("to is not null").select(F.col("n_nationkey").cast("bigint").alias("ord"), F.col("n_name").alias("from"), "to", F.lit("extends").alias("type"))


@query("WITH r AS (SELECT n_name, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS i FROM nation) SELECT string_agg(n_name, ' > ' ORDER BY i) AS path, count(*) - 1 AS hops FROM r WHERE i BETWEEN 3 AND 8")
def shortest_path(spark, d):
    rows = [r[0] for r in table(spark, d, "nation").orderBy("n_regionkey", "n_nationkey").select("n_name").limit(8).collect()]
    p = G.shortest_path(ring(spark, d), rows[2], rows[7])
    return spark.createDataFrame([(" > ".join(p), len(p) - 1)], "path string, hops bigint")


@query("WITH r AS (SELECT n_name, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS i FROM nation) SELECT string_agg(n_name, ' > ' ORDER BY i) AS path, true AS complete FROM r WHERE i BETWEEN 1 AND 5")
def all_paths(spark, d):
    rows = [r[0] for r in table(spark, d, "nation").orderBy("n_regionkey", "n_nationkey").select("n_name").limit(5).collect()]
    return G.all_paths(ring(spark, d), rows[0], rows[4]).select(F.array_join("path", " > ").alias("path"), "complete")


@query("SELECT event_type AS node, (SELECT min(event_type) FROM events) AS component FROM events GROUP BY event_type")
def cyclic_clusters(spark, d):
    """Types that follow each other in a user's log reach one another."""
    from pyspark.sql import Window

    e = log(spark, d).withColumn("to", F.lead("op").over(Window.partitionBy("agent").orderBy("pos"))).where("to is not null").select(F.col("op").alias("from"), "to").distinct()
    return G.cyclic_clusters(e)


@query(
    """WITH RECURSIVE l AS (SELECT l_quantity AS q, l_returnflag AS r, 'c' || o_custkey AS c, 's' || l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    e AS (SELECT DISTINCT c AS f, s AS t FROM l WHERE q >= 49 AND r = 'R' UNION SELECT DISTINCT s, c FROM l WHERE q >= 49 AND r = 'A'),
    w(f, t) AS (SELECT f, t FROM e UNION SELECT w.f, e.t FROM w JOIN e ON w.t = e.f)
    SELECT a.f AS node, min(a.t) AS component FROM w a JOIN w b ON a.f = b.t AND a.t = b.f GROUP BY a.f"""
)
def trade_cycles(spark, d):
    """Customers and suppliers that reach one another: large lines returned lead to the supplier, those accepted back."""
    li, o = table(spark, d, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_suppkey", "l_returnflag"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    ends = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("c"), F.concat(F.lit("s"), "l_suppkey").alias("s"), "l_returnflag")
    there = ends.where("l_returnflag = 'R'").select(F.col("c").alias("from"), F.col("s").alias("to"))
    back = ends.where("l_returnflag = 'A'").select(F.col("s").alias("from"), F.col("c").alias("to"))
    return G.cyclic_clusters(there.unionByName(back))


#: Statuses that types of events stand for.
STATUS = {"view": "running", "click": "rate-limited", "error": "error", "signup": "passed", "purchase": "ran"}
PATIENCE, KEEP = "6 hours", "2 days"


@query(
    f"""WITH RECURSIVE r AS (SELECT user_id::VARCHAR AS run, event_id AS pos, epoch_ms(ts) AS ms, {" ".join(["CASE event_type"] + [f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()] + ["END"])} AS status FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ms, pos) AS i, ms + CASE WHEN status IN ('running', 'error', 'rate-limited') THEN 21600000 ELSE 172800000 END AS due FROM r WHERE run IS NOT NULL AND status IS NOT NULL AND ms IS NOT NULL),
    m AS (SELECT run, i, pos, ms, status, 'accepted' AS outcome, status AS held, due, pos AS hpos, NULL::BIGINT AS gone, NULL::VARCHAR AS was, NULL::BIGINT AS gpos FROM n WHERE i = 1
        UNION ALL SELECT n.run, n.i, n.pos, n.ms, CASE WHEN keep THEN m.held ELSE n.status END, CASE WHEN keep THEN 'refused' ELSE 'accepted' END,
            CASE WHEN keep THEN m.held ELSE n.status END, CASE WHEN keep THEN m.due ELSE n.due END, CASE WHEN keep THEN m.hpos ELSE n.pos END, CASE WHEN m.due < n.ms THEN m.due END, CASE WHEN m.due < n.ms THEN m.held END, m.hpos
        FROM (SELECT m.*, held IN ('passed', 'ran') AS over FROM m) m JOIN n ON n.run = m.run AND n.i = m.i + 1, LATERAL (SELECT m.over AND m.due >= n.ms AS keep) k),
    e AS (SELECT run, gpos AS pos, gone AS ms, was FROM m WHERE gone IS NOT NULL
        UNION ALL SELECT run, hpos, due, held FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY i DESC) AS z FROM m) WHERE z = 1 AND due < (SELECT max(ms) FROM r))
    SELECT run, pos, ms AS "at", status, outcome FROM m
    UNION ALL SELECT run, pos, ms, CASE WHEN was IN ('passed', 'ran') THEN NULL ELSE 'pending' END, CASE WHEN was IN ('passed', 'ran') THEN 'expired' ELSE 'reverted' END FROM e"""
)
def run_states(spark, d):
    """Events as records of their users' runs, replayed as a stream."""
    import uuid

    from knowmill.streaming.runs import replay

    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("event_type"))
    roles = lambda e: e.select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("pos"), status.alias("status"), F.col("ts").alias("time"))
    return replay(spark, f"{d.rstrip('/')}/events.parquet", roles, PATIENCE, KEEP, f"{G.shared_dir(spark)}/runs-{uuid.uuid4().hex}")


# Services ----------------------------------------------------------------------------------------------------------------


def trade_calls(spark, d):
    t = trade(spark, d)
    return t.select(F.col("from").alias("from_service"), F.col("to").alias("to_service"), F.lit("calls").alias("kind"), F.when(F.col("n_lines") % 2 == 0, "GET /lines").otherwise("POST /lines").alias("detail"))


@query(f"WITH {TRADE} SELECT t AS service, count(*) AS n_calls FROM trade GROUP BY t")
def service_inbound_rank(spark, d):
    return V.inbound_rank(trade_calls(spark, d))


@query(f"WITH {TRADE} SELECT t AS to_service, count(DISTINCT f) AS n_callers, string_agg(DISTINCT f, ', ' ORDER BY f) AS callers, array_to_string(list_sort(list(DISTINCT CASE WHEN n_lines % 2 = 0 THEN 'GET' ELSE 'POST' END)), ', ') AS methods FROM trade GROUP BY t")
def client_registry(spark, d):
    return V.client_registry(trade_calls(spark, d))


@query(f"WITH {TRADE} SELECT f AS from_service, nullif(count(*) FILTER (t = 'NATION_0'), 0) AS n0, nullif(count(*) FILTER (t = 'NATION_1'), 0) AS n1, nullif(count(*) FILTER (t = 'NATION_2'), 0) AS n2 FROM trade GROUP BY f")
def dependency_matrix(spark, d):
    names = ["NATION_0", "NATION_1", "NATION_2"]
    return V.dependency_matrix(trade_calls(spark, d), names).select("from_service", *[F.col(n).alias(f"n{i}") for i, n in enumerate(names)])


@query(f"WITH {TRADE} SELECT f AS from_service, string_agg(t, ', ' ORDER BY t) AS direct, '' AS transitive FROM trade GROUP BY f")
def service_map(spark, d):
    return V.service_map(trade_calls(spark, d))


def queue_rows(spark, d):
    """Suppliers produce to a part's brand, customers of a segment consume it by type."""
    li, p = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey"), table(spark, d, "part").select("p_partkey", "p_brand")
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    made = j.select(F.concat(F.lit("s"), F.col("l_suppkey") % 10).alias("service_id"), F.lit("producer").alias("role"), F.col("p_brand").alias("queue_name")).distinct()
    used = j.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("service_id"), F.lit("consumer").alias("role"), F.col("p_brand").alias("queue_name")).distinct()
    return made.unionByName(used).withColumn("message_type", F.lit("")).withColumn("file", F.lit("")).withColumn("line", F.lit(0))


QUEUES = """q AS (SELECT DISTINCT 's' || l_suppkey % 10 AS s, 'producer' AS role, p_brand AS q FROM lineitem JOIN part ON l_partkey = p_partkey
    UNION SELECT DISTINCT c_mktsegment, 'consumer', p_brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query(f"WITH {QUEUES} SELECT q AS queue_name, string_agg(s, ', ' ORDER BY s) FILTER (role = 'producer') AS publishers, string_agg(s, ', ' ORDER BY s) FILTER (role = 'consumer') AS consumers FROM q GROUP BY q")
def queue_registry(spark, d):
    return V.queue_registry(queue_rows(spark, d)).select("queue_name", "publishers", "consumers")


@query(f"""WITH {QUEUES}, b AS (SELECT DISTINCT q, 'bound-' || q AS bq FROM q)
    SELECT s AS from_service, 'queue:' || q AS to_service, 'produces' AS kind FROM q WHERE role = 'producer' UNION SELECT s, 'queue:' || bq, 'produces' FROM q JOIN b USING (q) WHERE role = 'producer' UNION SELECT 'queue:' || q, s, 'consumes' FROM q WHERE role = 'consumer'""")
def exchange_bridge(spark, d):
    q = queue_rows(spark, d)
    b = q.select(F.concat(F.lit("bound-"), "queue_name").alias("queue_name"), F.col("queue_name").alias("routing_key"), F.lit("").alias("exchange")).distinct()
    return V.first_edges(V.queue_edges(q, b)).select("from_service", "to_service", "kind")


@query(f"""WITH {TRADE}, dep AS (SELECT 'R' || n_regionkey AS s, n_name AS lib FROM nation), direct AS (SELECT 'R' || n_regionkey AS s, n_name AS t FROM nation WHERE n_nationkey % 5 = 0)
    SELECT DISTINCT s AS from_service, t AS to_service FROM dep JOIN trade ON lib = f WHERE NOT EXISTS (SELECT 1 FROM direct WHERE direct.s = dep.s AND direct.t = trade.t)""")
def transitive_calls(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("service_id"), F.col("n_name").alias("library_id"), "n_nationkey")
    lib = trade(spark, d).select(F.col("from").alias("library_id"), F.col("to").alias("to_service"), F.lit("GET /").alias("detail"), F.lit("").alias("file"), F.lit(0).alias("line"), F.col("ord").alias("row"))
    direct = n.where("n_nationkey % 5 = 0").select(F.col("service_id").alias("from_service"), F.col("library_id").alias("to_service"))
    return V.transitive_calls(direct, n.select("service_id", "library_id"), lib).select("from_service", "to_service").distinct()


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+', ''), '[?#].*$', '') AS p FROM pages)
    SELECT page_id, CASE WHEN p = '' THEN '/' ELSE '/' || array_to_string(list_filter(string_split(p, '/'), lambda x: x <> ''), '/') END AS path FROM p""")
def normalize_paths(spark, d):
    return table(spark, d, "pages").select("page_id", P.normalize_path("url").alias("path"))


@query("""WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS s FROM pages)
    SELECT page_id, CASE s[1] WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' END AS endpoint FROM p WHERE len(s) = 2 AND s[1] IN ('en', 'de')""")
def client_endpoint_join(spark, d):
    e = spark.createDataFrame([("english", "/en/{id}"), ("german", "/de/{id}")], "endpoint string, route string").select("endpoint", P.normalize_path("route").alias("route"))
    c = table(spark, d, "pages").select("page_id", P.normalize_path("url").alias("np"))
    on = (F.size(F.split("np", "/")) == F.size(F.split("route", "/"))) & (F.element_at(F.split("np", "/"), 2) == F.element_at(F.split("route", "/"), 2)) & P.path_matches("np", "route")
    return c.join(e, on).select("page_id", "endpoint")


@query("SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9_+.-]*://([^/:?#]+)', 1) AS ext_host FROM pages")
def url_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", P.url_host("url").alias("host"), P.ext_host("url").alias("ext_host"))


@query("""SELECT page_id, CASE WHEN h = 'example.org' OR h LIKE '%.example.org' THEN CASE WHEN p LIKE '/fr/%' THEN 'org-french' ELSE 'org' END WHEN h LIKE '%.example.net' THEN 'net' ELSE '' END AS connector
    FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)) AS h, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def source_classify(spark, d):
    table_ = (("net", ("net://",), (("*.example.net", "", ""),)), ("org", (), (("*.example.org", "", ""),)), ("org-french", (), (("*.example.org", "/fr/", ""),)))
    return table(spark, d, "pages").select("page_id", R.classify(F.col("url"), table_).alias("connector"))


@query("""WITH s AS (SELECT c_mktsegment AS id, replace(lower(c_mktsegment), ' ', '-') || '-service' AS name FROM (SELECT DISTINCT c_mktsegment FROM customer))
    SELECT name AS service_id, regexp_replace(name, '-service$', '') || '-service.url, ' || name || '-service.url, ' || regexp_replace(name, '-service$', '') AS aliases FROM s""")
def service_aliases(spark, d):
    s = table(spark, d, "customer").select(F.concat(F.lower(F.regexp_replace("c_mktsegment", " ", "-")), F.lit("-service")).alias("service_id")).distinct()
    return s.select("service_id", F.array_join(P.service_aliases("service_id"), ", ").alias("aliases"))


@query("""WITH p AS (SELECT regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS s, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/]+', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS p FROM pages)
    SELECT s AS service_id, coalesce('/' || CASE WHEN min(p[1] || '/' || p[2]) = max(p[1] || '/' || p[2]) AND count(p[2]) = count(*) THEN min(p[1] || '/' || p[2]) WHEN min(p[1]) = max(p[1]) AND count(p[1]) = count(*) THEN min(p[1]) END, '—') AS api_prefix FROM p GROUP BY s""")
def api_prefix(spark, d):
    return V.api_prefix(table(spark, d, "pages").select(P.url_host("url").alias("service_id"), F.col("url").alias("path")))


# Pages and texts ---------------------------------------------------------------------------------------------------------


@query("SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def page_links(spark, d):
    return web_links(spark, d)


@query("""WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS link FROM pages), t AS (SELECT DISTINCT '/' || n AS link FROM (SELECT unnest(['the', 'The', 'and', 'of', 'de', 'la', 'La', 'De']) AS n))
    SELECT link FROM l ANTI JOIN t USING (link)""")
def broken_links(spark, d):
    known = spark.createDataFrame([("/" + x,) for x in ("the", "The", "and", "of", "de", "la", "La", "De")], "link string")
    return web_links(spark, d).select("link").distinct().join(known, "link", "left_anti")


@query("""WITH l AS (SELECT DISTINCT regexp_extract(link, '[^/]*$') AS name FROM (SELECT unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS link FROM pages)), p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS name FROM part)
    SELECT p_partkey FROM p ANTI JOIN l USING (name)""")
def orphan_pages(spark, d):
    linked = web_links(spark, d).select(F.substring_index("link", "/", -1).alias("name")).distinct()
    return table(spark, d, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("name")).join(linked, "name", "left_anti").select("p_partkey")


@query("""WITH d AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS w FROM documents)
    SELECT doc_id, floor(least(greatest((CASE WHEN w < 50 THEN 0.1 WHEN w < 150 THEN 0.3 WHEN w < 500 THEN 0.6 ELSE 0.8 END)::DOUBLE + CASE WHEN doc_id % 7 = 0 THEN -0.3 ELSE 0 END::DOUBLE + CASE WHEN doc_id % 5 = 0 THEN -0.1 ELSE 0 END::DOUBLE + CASE WHEN doc_id % 3 = 0 THEN -0.1 ELSE 0 END::DOUBLE, 0), 1) * 10000 + 0.5) / 10000 AS quality FROM d""")
def page_quality(spark, d):
    p = doc_pages(spark, d)
    return p.select("doc_id", Q.total(Q.signals()).alias("quality"))


@query("WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents) SELECT doc_id, hash, count(*) OVER (PARTITION BY hash) > 1 AS hit FROM h")
def content_hash_cache(spark, d):
    h = table(spark, d, "documents").select("doc_id", X.content_hash("text").alias("hash"))
    n = h.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", F.lit(True).alias("hit"))
    return h.join(n, "hash", "left").select("doc_id", "hash", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey")
def duplicate_diagram_pairs(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.array("p_brand").alias("sources"), F.array("p_type").alias("titles"))
    return L.duplicate_diagrams(p).select("a", "b")


@query("""WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) <= 160 THEN s ELSE rtrim(substr(s, 1, 159)) || '…' END AS summary FROM s""")
def summary_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate_summary("text", 160).alias("summary"))


@query("""WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations) SELECT conv_id, turn, array_to_string(list_transform(string_split(regexp_replace(t, '\\b([0-9a-fA-F]{7,40})\\b', '[sha-removed]', 'g'), chr(10)), lambda x: CASE WHEN regexp_matches(x, '(?i)\\b(?:fixed|closed|resolved)\\s+(?:by|in|via)\\b') THEN '[line-removed]' ELSE x END), chr(10)) AS text
    FROM s""")
def sanitize_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", L.sanitize_issue(F.col("text"), F.lit(100), digits=True)["text"].alias("text"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t\\r\\f\\x0B]+(\\n|$)', '\\1', 'g'), '\\n\\n\\n+', chr(10) || chr(10), 'g'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS text FROM documents")
def extract_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_extracted("text").alias("text"))


@query("SELECT doc_id, i AS line, l AS text FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) WHERE regexp_matches(l, '(?i)licen[sc]e')")
def keyword_lines(spark, d):
    return D.keyword_lines(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content")), "(?i)licen[sc]e").select(F.col("path").alias("doc_id"), F.col("line").cast("bigint").alias("line"), "text")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::INT AS n_words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_count("text").alias("n_words"))


@query("SELECT c_custkey, lower(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM (SELECT c_custkey, regexp_replace(c_name, '[#]', 'Key') AS n FROM customer)")
def snake_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.snake_case(F.regexp_replace("c_name", "#", "Key")).alias("snake"))


@query("SELECT o_orderkey, floor(o_totalprice * 100 + 0.5) / 100 AS r2 FROM orders")
def round_half_up(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.round2("o_totalprice").alias("r2"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g') AS node FROM pages")
def node_ids(spark, d):
    return table(spark, d, "pages").select("page_id", X.node_id("url").alias("node"))


@query()
def bracket_lint(spark, d):
    """Whether the brackets of each text balance; a stack fold."""
    return table(spark, d, "documents").select("doc_id", X.brackets_balanced("text").alias("balanced"))


@query("""WITH r AS (SELECT unnest(['title', 'type', 'tags', 'sources', 'created', 'updated', 'quality', 'summary']) AS f), d AS (SELECT 'wiki/' || lang || '/' || doc_id || '.md' AS path, doc_id FROM documents)
    SELECT path AS page, 'Missing required frontmatter field: ' || f AS detail FROM d, r WHERE f IN ('created', 'updated', 'quality') OR (f = 'title' AND doc_id % 7 = 0) OR (f = 'summary' AND doc_id % 5 = 0)""")
def frontmatter_lint(spark, d):
    return N.frontmatter(doc_pages(spark, d)).select("page", "detail")


# Life of pages -----------------------------------------------------------------------------------------------------------


@query("""WITH e(class_name, table_name) AS (VALUES ('Order', 'orders'), ('Line', 'lineitem'), ('Ghost', 'ghosts')), cc(class_name, name) AS (VALUES ('Order', 'o_orderkey'), ('Order', 'o_note'), ('Line', 'l_orderkey')),
    db(t, c) AS (VALUES ('orders', 'o_orderkey'), ('orders', 'o_custkey'), ('lineitem', 'l_orderkey'), ('region', 'r_name'))
    SELECT 'mismatch' AS kind, 'Order' AS entity, 'orders' AS "table", 'o_note' AS field, 'missing_in_db' AS reason UNION ALL SELECT 'mismatch', 'Order', 'orders', 'o_custkey', 'missing_in_code' UNION ALL SELECT 'matched', class_name, table_name, NULL, 'matched' FROM e WHERE table_name IN (SELECT t FROM db)
    UNION ALL SELECT 'orphan', class_name, NULL, NULL, 'no_table' FROM e WHERE table_name NOT IN (SELECT t FROM db) UNION ALL SELECT DISTINCT 'unmapped', NULL, t, NULL, 'no_entity' FROM db WHERE t NOT IN (SELECT table_name FROM e)""")
def schema_diff(spark, d):
    e = spark.createDataFrame([("Order", "", "orders"), ("Line", "", "lineitem"), ("Ghost", "", "ghosts")], "class_name string, schema_name string, table_name string")
    c = spark.createDataFrame([("Order", "o_orderkey"), ("Order", "o_note"), ("Line", "l_orderkey")], "class_name string, name string")
    k = spark.createDataFrame([("", "orders", "o_orderkey"), ("", "orders", "o_custkey"), ("", "lineitem", "l_orderkey"), ("", "region", "r_name")], "schema string, table string, column string")
    return S.diff(e, c, k)


@query("""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', ''), '/$', '') AS path FROM pages)
    SELECT path, CASE WHEN path LIKE 'blog.%' AND path LIKE '%/en/%' THEN 'stale' WHEN path LIKE '%/fr/%' OR path LIKE '%/fr' THEN 'uncovered' ELSE 'unrelated' END AS class FROM p""")
def stale_classify(spark, d):
    f = table(spark, d, "pages").select(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-zA-Z]+://", ""), "[?#].*$", ""), "/$", "").alias("path")).distinct()
    hosts = f.select(F.substring_index("path", "/", 1).alias("h")).where(F.col("h").startswith("blog.")).distinct()
    index = hosts.select(F.lit(0).alias("ord"), F.concat(F.lit("page-"), "h").alias("page"), F.array(F.concat("h", F.lit("/en/"))).alias("sources"))
    return L.classify_changes(f, index, ["fr"]).select("path", "class")


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS m FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS page, coalesce(n, 0) AS n_local, coalesce(m, 0) AS n_missing, CASE WHEN coalesce(m, 0) = 0 THEN 'live' WHEN m = n THEN 'orphan' WHEN m::DOUBLE / n >= 0.5 THEN 'candidate' ELSE 'live' END AS status FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def source_existence(spark, d):
    o = table(spark, d, "orders")
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("page")).join(o.groupBy(F.col("o_custkey").alias("page")).agg(F.collect_list(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string"))).alias("sources")), "page", "left")
    return L.source_existence(p, o.where("o_orderstatus <> 'O'").select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"))).select("page", "n_local", "n_missing", "status")


@query("""SELECT r_name AS topic, s AS facet FROM region, (SELECT DISTINCT c_mktsegment AS s FROM customer) EXCEPT SELECT r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9900""")
def gap_matrix(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    pages = c.where("c_acctbal > 9900").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("topic"), F.col("c_mktsegment").alias("facet"))
    return L.gaps(r.select(F.col("r_name").alias("topic")), c.select(F.col("c_mktsegment").alias("facet")).distinct(), pages)


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'bot-author' WHEN coalesce(length(text), 0) < 200 THEN 'thin-body' WHEN n_chars >= 4000 THEN 'too-large' WHEN lang <> 'en' THEN 'no-test-changes' WHEN source = 'src3' THEN 'no-source-changes' ELSE 'ok' END AS reason FROM documents""")
def eligibility(spark, d):
    t = table(spark, d, "documents")
    one = F.lit(1)
    reason = L.eligibility(F.coalesce(F.length("text"), F.lit(0)), F.col("doc_id") % 11 == 0, F.lit("2024-01-01").cast("timestamp"), "2023-01-01", F.col("n_chars") / 10, (F.col("lang") == "en").cast("int"), (F.col("source") != "src3").cast("int"), one, F.lit(False))
    return t.select("doc_id", reason.alias("reason"))


@query("""WITH r AS (SELECT 'quality' AS arm, quality = 1 AS ok FROM labels UNION ALL SELECT 'toxic', toxic = 0 FROM labels) SELECT arm, count(*) AS graded, count(*) FILTER (ok) AS passed, floor(count(*) FILTER (ok) * 100.0::DOUBLE / count(*) + 0.5)::BIGINT AS rate FROM r GROUP BY arm""")
def arm_report(spark, d):
    t = table(spark, d, "labels")
    s = lambda c: F.when(c, "passed").otherwise("failed")
    runs = t.select(F.lit("quality").alias("arm"), s(F.col("quality") == 1).alias("status")).unionByName(t.select(F.lit("toxic").alias("arm"), s(F.col("toxic") == 0).alias("status"))).withColumn("cost_usd", F.lit(0.0))
    return L.arm_report(runs).select("arm", "graded", "passed", "rate")


@query("SELECT o_custkey AS id, bool_and(o_orderstatus = 'F') AS cached FROM orders GROUP BY o_custkey")
def plan_cached(spark, d):
    o = table(spark, d, "orders")
    entries = o.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("sources"))
    cache = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("hash"), F.lit("1").alias("version"))
    return L.cached(entries, cache, "1")


@query("SELECT o_custkey AS hash, max(o_orderdate) AS stored_at, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS metadata FROM orders GROUP BY o_custkey")
def cache_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("hash"), F.struct(F.col("o_orderdate").alias("at"), "o_orderkey").alias("at"), F.col("o_orderpriority").alias("metadata"))
    return L.upsert(o.where("hash % 2 = 0"), o.where("hash % 2 = 1"), order="at").select("hash", F.col("at.at").alias("stored_at"), "metadata")


@query("SELECT 'fact' AS audience, count(*) AS n_pages, sum(length(text))::BIGINT AS n_chars FROM benchmark")
def overview_bundle(spark, d):
    b = table(spark, d, "benchmark").select(F.lit("fact").alias("audience"), F.lpad(F.col("item_id").cast("string"), 9, "0").alias("path"), F.col("text").alias("content"))
    head = F.lit(3 + 9 + 2)
    out = D.bundle(b, "audience")
    return out.select("audience", "n_pages", (F.length("text") - F.col("n_pages") * head - (F.col("n_pages") - 1) * 2).cast("bigint").alias("n_chars"))


# Gated statements --------------------------------------------------------------------------------------------------------

STATEMENTS = (
    ("SELECT 1", "auto", "read", "allow"),
    ("SELECT * FROM t", "auto", "read", "escalate"),
    ("SELECT * FROM t WHERE a = 1", "confirm_each", "read", "escalate"),
    ("SELECT a FROM t LIMIT 5", "grant_required", "read", "deny"),
    ("INSERT INTO t VALUES (1)", "auto", "dml", "present_only"),
    ("DROP TABLE t", "auto", "ddl", "deny"),
    ("GRANT ALL ON t", "auto", "privilege", "deny"),
    ("VACUUM t", "auto", "ddl", "deny"),
    ("/* c */ DELETE FROM t", "auto", "dml", "present_only"),
    ("SELECT * FROM a CROSS JOIN b", "auto", "read", "escalate"),
    ("SELECT * FROM a JOIN b ON a.x = b.x", "auto", "read", "allow"),
    ("WITH x AS (SELECT 1) SELECT * FROM x", "auto", "read", "allow"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{op}', '{dec}')" for s, _, op, dec in STATEMENTS) + ") AS v(sql, op, decision)")
def sql_policy(spark, d):
    s = spark.createDataFrame([(a, m) for a, m, _, _ in STATEMENTS], "sql string, mode string")
    x = A.decision(F.col("sql"), F.col("mode"))
    return s.select("sql", x["op"].alias("op"), x["decision"].alias("decision"))


def gated(spark, d, sql, *names):
    for n in names:
        table(spark, d, n).createOrReplaceTempView(n)
    return A.QueryGate(spark).frame(sql)


TPCH = {
    "gated_pricing": (("lineitem",), "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus"),
    "gated_shipping": (("lineitem", "orders", "customer"), "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 20"),
    "gated_local_supply": (("lineitem", "orders", "customer", "supplier", "nation", "region"), "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IS NOT NULL GROUP BY n_name"),
    "gated_forecast": (("lineitem",), "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"),
    "gated_rollup": (("orders",), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IS NOT NULL GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "gated_window": (("orders",), "SELECT o_custkey, o_orderkey, CAST(rn AS BIGINT) AS rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) AS x WHERE rn <= 3"),
    "gated_set_ops": (("customer", "supplier"), "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0"),
    "gated_exists": (("customer", "orders"), "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment"),
}


def gated_query(name: str):
    names, sql = TPCH[name]

    def run(spark, d):
        return gated(spark, d, sql, *names)

    run.__name__ = name
    return query(sql)(run)


for _name in TPCH:
    gated_query(_name)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 1001")
def doc_envelope_find(spark, d):
    e = '{"collection": "orders", "op": "find", "filter": {"o_orderstatus": "F", "o_totalprice": {"$gt": 100000}}, "projection": {"o_orderkey": 1, "o_totalprice": 1}, "sort": {"o_totalprice": -1, "o_orderkey": 1}}'
    return A.document_query({"orders": table(spark, d, "orders")}, e)


@query("SELECT o_orderpriority AS _id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderpriority")
def doc_envelope_aggregate(spark, d):
    e = {"collection": "orders", "op": "aggregate", "pipeline": [{"$match": {"o_orderstatus": {"$in": ["F", "O"]}}}, {"$group": {"_id": "$o_orderpriority", "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}}}]}
    return A.document_query({"orders": table(spark, d, "orders")}, e).select("_id", "n", F.round("total", 2).alias("total"))


@query("SELECT count(*) AS count FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 150000")
def doc_envelope_count(spark, d):
    return A.document_query({"orders": table(spark, d, "orders")}, {"collection": "orders", "op": "count", "filter": {"o_totalprice": {"$gte": 50000, "$lt": 150000}}})


@query("SELECT * FROM nation WHERE n_regionkey = 2")
def key_value_scan(spark, d):
    return A.key_value_query({"nation": table(spark, d, "nation")}, {"table": "nation", "op": "scan", "filter": {"n_regionkey": 2}})


# More operators over the same roles ---------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/([^/?#]+)', 1) AS s FROM pages)
    SELECT h AS folder, string_agg('F ' || s, chr(10) ORDER BY s) AS signature FROM p WHERE s <> '' GROUP BY h""")
def folder_signatures(spark, d):
    u = table(spark, d, "pages").select(F.concat_ws("/", P.url_host("url"), F.nullif(F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+/([^/?#]+)", 1), F.lit(""))).alias("path")).where(F.col("path").contains("/"))
    return K.folder_signatures(u).where("folder <> ''")


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'integrator' WHEN 'de' THEN 'debugger' WHEN 'fr' THEN 'new-user' ELSE 'contributor' END AS audience FROM documents WHERE source <> 'src1'
    UNION ALL SELECT doc_id, 'own' FROM documents WHERE source = 'src1'""")
def page_audience(spark, d):
    facet = F.when(F.col("lang") == "en", "api").when(F.col("lang") == "de", "troubleshooting").when(F.col("lang") == "fr", "getting-started").otherwise("else")
    given = F.when(F.col("source") == "src1", "own").otherwise("")
    return table(spark, d, "documents").select("doc_id", K.audience(facet, given).alias("audience"))


@query("""WITH s AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN '[a](../x/' || source || '.md) b [c](c.md)' ELSE 'none' END AS t FROM documents)
    SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN replace(t, '[a](../x/' || source || '.md)', '[a (archived)](../_archive/x/' || source || '.md)') ELSE t END AS content FROM s""")
def link_rewrite(spark, d):
    t = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("[a](../x/"), "source", F.lit(".md) b [c](c.md)"))).otherwise("none")
    p = t.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.alias("content"))
    m = spark.createDataFrame([(f"x/{s}.md", f"_archive/x/{s}.md") for s in ("src1", "src2")], "from string, to string")
    return K.rewrite_inbound(p, m).select(F.regexp_extract("path", r"d/(-?\d+)\.md", 1).cast("bigint").alias("doc_id"), "content")


@query("""WITH g AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'),
    f AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity < 10), k AS (SELECT a FROM g UNION SELECT b FROM g),
    n AS (SELECT (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM f WHERE a IN (SELECT a FROM k) AND b IN (SELECT a FROM k)) AS found, (SELECT count(*) FROM g JOIN f USING (a, b)) AS hits)
    SELECT hits, gold, found, hits * 100.0::DOUBLE / gold AS recall, hits * 100.0::DOUBLE / found AS precision FROM n""")
def recall_precision(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = lambda c: li.where(c).select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"))
    return V.recall(pairs("l_returnflag = 'R'"), pairs("l_quantity < 10"))


@query("""WITH s AS (SELECT c_custkey AS page, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)
    SELECT CASE WHEN n > 0 AND m = n THEN 'pending' WHEN n > 0 AND m::DOUBLE / n >= 0.5 THEN 'candidate' ELSE 'kept' END AS action, count(*) AS n_pages FROM s GROUP BY ALL""")
def archive_sweep(spark, d):
    o = table(spark, d, "orders")
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("page")).join(o.groupBy(F.col("o_custkey").alias("page")).agg(F.collect_list(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string"))).alias("sources")), "page", "left")
    e = L.source_existence(p, o.where("o_orderstatus <> 'O'").select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path")))
    return L.sweep(e).groupBy("action").agg(F.count(F.lit(1)).alias("n_pages"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'error' WHEN doc_id % 4 = 1 THEN 'rate-limited' ELSE 'ok' END AS session FROM documents""")
def session_classes(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 1, '{"is_error": true, "result": "Usage limit reached"}').otherwise("{}").alias("r"), F.when(F.col("doc_id") % 4 == 0, 2).otherwise(0).alias("x"))
    return t.select("doc_id", L.session_class(F.col("r"), F.col("x"), F.lit("")).alias("session"))


@query("""WITH r AS (SELECT doc_id AS issue, count(*) AS n FROM (SELECT doc_id, 1 AS arm FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 2 FROM labels WHERE toxic = 0) GROUP BY doc_id), j AS (SELECT d.doc_id AS issue, coalesce(n, 0) AS n FROM documents d LEFT JOIN r ON issue = d.doc_id)
    SELECT issue, 0 AS rank FROM j WHERE n = 1 UNION ALL SELECT issue, 1 FROM (SELECT issue FROM j WHERE n = 0 ORDER BY issue LIMIT 20)""")
def next_pairs(spark, d):
    t = table(spark, d, "labels")
    runs = t.where("quality = 1").select(F.col("doc_id").alias("issue"), F.lit("a").alias("arm"), F.lit("passed").alias("status")).union(t.where("toxic = 0").select("doc_id", F.lit("b"), F.lit("failed")))
    return L.next_pairs(runs, table(spark, d, "documents").select(F.col("doc_id").alias("issue"), F.col("doc_id").alias("ord")), 20).select("issue", "rank")


@query("SELECT p_partkey AS path, p_name AS title, p_type AS failure_reason, p_size AS updated FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_size DESC, p_partkey LIMIT 50")
def banlist(spark, d):
    p = table(spark, d, "part")
    low = p.agg(F.min("p_brand").alias("b"))
    return L.banlist(p.join(F.broadcast(low), F.col("p_brand") == F.col("b")).select(F.col("p_partkey").alias("path"), F.col("p_name").alias("title"), F.lit("claim").alias("type"), F.lit("deprecated").alias("status"), F.col("p_type").alias("failure_reason"), F.col("p_size").alias("updated")))


@query("SELECT c_mktsegment AS facet, min('p' || lpad(c_custkey::VARCHAR, 9, '0')) AS path FROM customer GROUP BY c_mktsegment")
def routing_table(spark, d):
    p = table(spark, d, "customer").select(F.concat(F.lit("p"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("path"), F.col("c_mktsegment").alias("facet"), F.lit("").alias("topic"))
    return L.routing(p, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")).select("facet", "path")


@query("""WITH r AS (SELECT DISTINCT a.n_name AS source, b.n_name AS target, CASE WHEN l_quantity < 10 THEN 'many_to_many' WHEN l_quantity < 30 THEN 'one_to_many' ELSE 'foreign_key' END AS type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey),
    k AS (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY CASE type WHEN 'many_to_many' THEN 0 WHEN 'one_to_many' THEN 1 ELSE 5 END, source, target) AS n FROM r) SELECT source, target, type FROM k WHERE n = 1""")
def er_relations(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    kind = F.when(F.col("l_quantity") < 10, "many_to_many").when(F.col("l_quantity") < 30, "one_to_many").otherwise("foreign_key")
    r = li.select("c_nationkey", "s_nationkey", kind.alias("type")).distinct()
    a, b = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("source")), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("target"))
    return D.pick_relations(r.join(a, "c_nationkey").join(b, "s_nationkey").select("source", "target", "type"))


@query("SELECT user_id AS file, event_id AS start, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000000) AS \"end\" FROM events")
def class_windows(spark, d):
    from knowmill.operators.extract import class_windows as windows

    e = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("start"), F.lit(1_000_000_000).cast("bigint").alias("length"))
    return windows(e).select("file", "start", "end")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'r-' || 'URGENT' || '/x' WHEN o_orderpriority LIKE '2%' THEN NULL WHEN o_orderpriority LIKE '3%' THEN 'M' ELSE 'plain' END AS value FROM orders""")
def resolve_references(spark, d):
    from knowmill.operators.extract import resolve_references as resolve

    ref = F.when(F.col("o_orderpriority").startswith("1"), "${u.k}/x").when(F.col("o_orderpriority").startswith("2"), "${none}").when(F.col("o_orderpriority").startswith("3"), "Names.MEDIUM").otherwise("plain")
    known = spark.createDataFrame([("u.k", "r-URGENT"), ("MEDIUM", "M")], "name string, value string")
    return resolve(table(spark, d, "orders").select("o_orderkey", ref.alias("ref")), known).select("o_orderkey", "value")


def source_files(spark, d):
    """Orders as one-line source files of two frameworks."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3).alias("k"))
    text = F.when(F.col("k") == 0, F.concat(F.lit('import org.springframework;\n@GetMapping("/c/'), "o_custkey", F.lit('")\n'))).when(F.col("k") == 1, F.concat(F.lit("import requests\nrequests.post('http://h/c/"), "o_custkey", F.lit("')\n"))).otherwise("nothing")
    return o.select(F.concat(F.lit("s"), (F.col("o_orderkey") % 10).cast("string"), F.lit("/f"), F.col("o_orderkey").cast("string"), F.when(F.col("k") == 0, ".java").otherwise(".py")).alias("path"), text.alias("content"))


@query("SELECT 'spring' AS framework, 'GET' AS method, '/c/' || o_custkey AS path, 's' || o_orderkey % 10 || '/f' || o_orderkey || '.java' AS file, 2::INT AS line FROM orders WHERE o_orderkey % 3 = 0")
def rest_endpoints(spark, d):
    from knowmill.operators import extract

    return extract.rest_endpoints(source_files(spark, d))


@query("SELECT 'requests' AS framework, 'POST' AS method, 'h' AS target_ref, 'http://h/c/' || o_custkey AS path, 's' || o_orderkey % 10 || '/f' || o_orderkey || '.py' AS file, 2::INT AS line FROM orders WHERE o_orderkey % 3 = 1")
def http_clients(spark, d):
    from knowmill.operators import extract

    return extract.http_clients(source_files(spark, d))


@query("""WITH v(o, s) AS (VALUES (0, 'service a'), (1, 'x')) SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'postgres://h/' || p_partkey ELSE 'https://h/' END AS detail FROM part WHERE p_size % 2 = 0""")
def external_sources(spark, d):
    from knowmill.operators import extract

    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("a/"), F.col("p_partkey").cast("string"), F.lit("/application.yml")).alias("path"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("url: postgres://u:p@h/"), F.col("p_partkey").cast("string"))).otherwise("url: https://h/").alias("content"))
    return extract.external_sources(p).select(F.regexp_extract("file", r"a/(\d+)/", 1).cast("bigint").alias("p_partkey"), "detail")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'fine' END AS kind FROM events")
def error_events(spark, d):
    rec = F.to_json(F.struct(F.when(F.col("event_type") == "error", "Failed").otherwise("ok").alias("status")))
    return table(spark, d, "events").select("event_id", F.when(E.is_error(rec), "failed").otherwise("fine").alias("kind"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, (o_orderdate - INTERVAL 2 DAY) AS since FROM orders")
def iso_times(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", X.format_iso(t).alias("iso"), X.since(F.lit("2d"), t.cast("timestamp")).cast("timestamp_ntz").alias("since"))


@query("SELECT CASE WHEN t.c_custkey % 2 = 0 THEN 'aws' ELSE 'github' END AS connector, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'AWS S3 Buckets' ELSE 'Dependency Graph' END AS title, CASE WHEN c_custkey % 2 = 0 THEN 'graph TB' || chr(10) || '  account(\"AWS Account\")' || chr(10) || '  bucket_' || replace(c_name, '#', '_') || '[\"' || c_name || '\"]' || chr(10) || '  account --> bucket_' || replace(c_name, '#', '_') ELSE 'graph LR' || chr(10) || '  root(\"requirements.txt\")' || chr(10) || '  dep_0[\"a\"]' || chr(10) || '  root --> dep_0' END AS text FROM customer t")
def connector_diagrams(spark, d):
    from knowmill.operators import decorate

    even = F.col("c_custkey") % 2 == 0
    env = F.when(even, F.concat(F.lit('{"status": "success", "action": "list_buckets", "data": {"buckets": [{"name": "'), "c_name", F.lit('"}]}}'))).otherwise(F.lit('{"status": "success", "action": "get_file", "data": {"path": "requirements.txt", "content": "a==1"}}'))
    t = table(spark, d, "customer").select("c_custkey", F.when(even, "aws").otherwise("github").alias("connector"), env.alias("envelope"), F.lit(None).cast("string").alias("error"))
    return decorate.decorate(t).select("connector", "c_custkey", "diagram.title", "diagram.text")


@query("SELECT c_mktsegment AS service_id, count(*) AS n_entities, string_agg(DISTINCT 's.' || c_name, ', ' ORDER BY 's.' || c_name) AS tables FROM customer GROUP BY c_mktsegment")
def db_traces(spark, d):
    e = table(spark, d, "customer").select(F.col("c_mktsegment").alias("service_id"), F.lit("s").alias("schema_name"), F.col("c_name").alias("table_name"))
    return V.db_traces(e)


# Extraction, discovery, joins and rules over whole tables -------------------------------------------------------------------


@query("SELECT p_brand AS queue_name, 'x.' || p_type AS exchange, 'k.' || p_size AS routing_key, 'b/' || p_partkey || '.java' AS file, 7::INT AS line FROM part")
def queue_bindings(spark, d):
    """A file for each part: a bean, a constant, and a binding written over lines."""
    from knowmill.operators import extract

    text = F.format_string('import org.springframework.amqp;\n// bind(x).to(y).with(z)\nstatic final String K%d = "k.%d";\n@Bean\nQueue q() { return new Queue("%s"); }\nBinding b() { return BindingBuilder\n  .bind(q())\n  .to(new TopicExchange("x.%s"))\n  .with(K%d); }\n', "p_size", "p_size", "p_brand", "p_type", "p_size")
    f = table(spark, d, "part").select(F.format_string("b/%d.java", "p_partkey").alias("path"), text.alias("content"))
    return extract.queue_bindings(f, extract.constants(f))


def examples_sql() -> str:
    from knowmill.profiles.examples import EXAMPLES

    text = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {', '.join(map(text, (k, f, p, a, b)))})" for i, (k, f, p, _, a, b) in enumerate(EXAMPLES))
    return f"SELECT kind, framework, c_custkey || '/' || file AS file, first, second FROM customer JOIN (VALUES {rows}) AS t(i, kind, framework, file, first, second) ON c_custkey % {len(EXAMPLES)} = i"


@query(examples_sql())
def framework_profiles(spark, d):
    """Every built-in profile on files of its framework: each customer has a file, whose text is that of one of the examples, a
    parameter table, since no table of the driver holds source code."""
    from knowmill.operators import extract
    from knowmill.profiles.examples import EXAMPLES

    e = spark.createDataFrame([(i, p, c) for i, (_, _, p, c, _, _) in enumerate(EXAMPLES)], "i int, file string, content string")
    f = table(spark, d, "customer").withColumn("i", (F.col("c_custkey") % len(EXAMPLES)).cast("int")).join(F.broadcast(e), "i").select(F.concat_ws("/", F.col("c_custkey").cast("string"), "file").alias("path"), "content")
    fact = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), "framework", "file", F.col(a).alias("first"), F.col(b).alias("second"))
    found = [fact(extract.rest_endpoints(f), "rest", "method", "path"), fact(extract.http_clients(f), "client", "method", "path"), fact(extract.queue_endpoints(f), "queue", "role", "queue_name")]
    for p in extract.load_profiles("orm"):
        e = extract.orm_entities(f.where(extract.has_marker(p)), p).select(F.lit(p["name"]).alias("framework"), F.col("source_file").alias("file"), "class_name", "table_name")
        found.append(fact(e, "orm", "class_name", "table_name"))
    return extract.union(found)


def tree(spark, d):
    """A folder for each customer, with a manifest of one of five kinds."""
    k, id_ = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    pom = F.concat(F.lit("<project><artifactId>art-"), id_, F.lit("</artifactId><dependency><artifactId>art-"), (F.col("c_custkey") + 1).cast("string"), F.lit("</artifactId></dependency></project>"))
    path = F.when(k == 0, F.concat(F.lit("s"), id_, F.lit("-service/pom.xml"))).when(k == 1, F.concat(F.lit("libs/l"), id_, F.lit("/pom.xml"))).when(k == 2, F.concat(F.lit("w"), id_, F.lit("/package.json"))).when(k == 3, F.concat(F.lit("n"), id_, F.lit("/app/go.mod"))).otherwise(F.concat(F.lit("x"), id_, F.lit("/deep/er/go.mod")))
    return table(spark, d, "customer").select(path.alias("path"), F.when(k < 2, pom).when(k == 2, '{"devDependencies": {"vue": "3"}}').otherwise("").alias("content"))


@query("""SELECT CASE c_custkey % 5 WHEN 0 THEN 's' || c_custkey || '-service' WHEN 1 THEN 'l' || c_custkey WHEN 2 THEN 'w' || c_custkey ELSE 'n' || c_custkey END AS id,
    CASE c_custkey % 5 WHEN 0 THEN 's' || c_custkey || '-service' WHEN 1 THEN 'libs/l' || c_custkey WHEN 2 THEN 'w' || c_custkey ELSE 'n' || c_custkey END AS root,
    CASE c_custkey % 5 WHEN 1 THEN 'library' WHEN 2 THEN 'frontend' ELSE 'service' END AS kind, CASE c_custkey % 5 WHEN 2 THEN 'typescript' WHEN 3 THEN 'go' ELSE 'java' END AS language,
    CASE c_custkey % 5 WHEN 0 THEN 's' || c_custkey || '-service.url,s' || c_custkey || '-service-service.url,s' || c_custkey || ',art-' || c_custkey WHEN 1 THEN 'l' || c_custkey || '-service.url,art-' || c_custkey WHEN 2 THEN 'w' || c_custkey || '-service.url' ELSE 'n' || c_custkey || '-service.url' END AS aliases
    FROM customer WHERE c_custkey % 5 < 4""")
def service_discovery(spark, d):
    from knowmill.operators import discovery

    return discovery.services(tree(spark, d)).select("id", "root", "kind", "language", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT 's' || c_custkey || '-service' AS service_id, 'l' || (c_custkey + 1) AS library_id FROM customer WHERE c_custkey % 5 = 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)")
def library_dependencies(spark, d):
    from knowmill.operators import discovery
    from knowmill.operators.page_graph import cut

    f = tree(spark, d)
    return discovery.library_deps(f, cut(discovery.services(f))).select("service_id", "library_id")


def calls(spark, d):
    """services by nation, a route of each, and a client for each order: its customer's nation calls that of the next number,
    or a host outside."""
    n = table(spark, d, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").cast("bigint").alias("ord"), F.array().cast("array<string>").alias("aliases"), F.lit("service").alias("kind"))
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey") % 3
    target = F.when(k == 2, "https://api.far.example/x").otherwise(F.concat(F.lit("http://s"), ((F.col("c_nationkey") + 1) % 25).cast("string"), F.lit("/")))
    c = o.select(F.col("o_orderkey").cast("bigint").alias("row"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("service_id"), target.alias("target_ref"), F.lit(None).cast("string").alias("resolved_target"), F.when(k == 0, "GET").otherwise("POST").alias("method"), F.lit("/orders/{id}").alias("path"), F.lit("f").alias("file"), F.lit(1).alias("line"))
    return {"services": n, "http_clients": c, "rest_endpoints": n.select(F.col("id").alias("service_id"), F.lit("GET").alias("method"), F.lit("/orders/{key}").alias("path"))}


@query("""SELECT o_orderkey AS row, 's' || c_nationkey AS from_service, CASE o_orderkey % 3 WHEN 2 THEN 'ext:http:api.far.example' ELSE 's' || (c_nationkey + 1) % 25 END AS to_service,
    CASE o_orderkey % 3 WHEN 2 THEN 'external_source' ELSE 'calls' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'GET /orders/{}' WHEN 1 THEN 'POST /orders/{}' ELSE 'http POST api.far.example' END AS detail,
    CASE o_orderkey % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS confidence FROM orders JOIN customer ON o_custkey = c_custkey""")
def client_edges(spark, d):
    t = calls(spark, d)
    return V.client_edges(t["http_clients"], t["services"], t["rest_endpoints"]).select("row", "from_service", "to_service", "kind", "detail", "confidence")


@query("""SELECT DISTINCT 's' || c_nationkey AS from_service, CASE o_orderkey % 3 WHEN 2 THEN 'ext:http:api.far.example' ELSE 's' || (c_nationkey + 1) % 25 END AS to_service, CASE o_orderkey % 3 WHEN 2 THEN 'external_source' ELSE 'calls' END AS kind,
    CASE o_orderkey % 3 WHEN 0 THEN 'GET /orders/{}' WHEN 1 THEN 'POST /orders/{}' ELSE 'http POST api.far.example' END AS detail FROM orders JOIN customer ON o_custkey = c_custkey""")
def service_graph_edges(spark, d):
    return V.service_graph(calls(spark, d)).select("from_service", "to_service", "kind", "detail")


def pages_of(spark, d):
    """documents as pages: frontmatter by number, a link to the page before."""
    i = F.col("doc_id")
    fm = F.to_json(F.struct(F.lit("t").alias("title"), F.when(i % 4 == 0, "claim").otherwise("concept").alias("type"), F.when(i % 8 == 0, "deprecated").alias("status"), F.when(i % 16 == 0, "why").alias("failure_reason"), F.when(i % 3 == 0, "2024-01-01").otherwise("2024-05-30").alias("updated"), F.concat(F.lit("h"), i.cast("string")).alias("summary_hash")))
    return table(spark, d, "documents").select(i.alias("doc_id"), F.concat(F.lit("d/p"), i.cast("string"), F.lit(".md")).alias("path"), F.lit("").alias("content"), F.lit("").alias("body"), fm.alias("fm"))


@query("""SELECT 'info' AS severity, 'stale_content' AS category, 'd/p' || doc_id || '.md' AS page, 'Page is 152 days old (threshold 90)' AS detail FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT 'error', 'deprecated_claims', 'd/p' || doc_id || '.md', 'Claim is deprecated but failure_reason is missing or empty.' FROM documents WHERE doc_id % 16 = 8""")
def page_rules(spark, d):
    p = pages_of(spark, d)
    return N.stale(p, "2024-06-01").unionByName(N.deprecated_claims(p))


@query("""SELECT CASE o_orderkey % 3 WHEN 0 THEN 'error' ELSE 'warning' END AS severity, 'code_ref_drift' AS category, 'p' || o_custkey AS page, CASE o_orderkey % 3 WHEN 0 THEN 'Referenced file f' || o_orderkey || ' not found' ELSE 'Content hash mismatch for f' || o_orderkey END AS detail FROM orders WHERE o_orderkey % 3 < 2
    UNION ALL SELECT 'warning', 'references_inventory', 'p' || o_custkey, 'Reference f' || o_orderkey || ' is not in the inventory' FROM orders WHERE o_orderkey % 3 = 0""")
def source_rules(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("page"), (F.col("o_orderkey") % 3).alias("k"), F.col("o_orderpriority").alias("content"))
    refs = o.select("page", "file", F.when(F.col("k") == 1, "other").otherwise(F.sha2(F.col("content").cast("binary"), 256)).alias("content_hash"))
    files = o.where("k > 0").select(F.col("file").alias("path"), "content")
    return N.code_ref_drift(o, refs, files).unionByName(N.references_inventory(refs, files.select(F.col("path").alias("file"))))


@query("""WITH m AS (SELECT c_custkey, c_custkey % 6 AS s, c_custkey % 4 AS k FROM customer)
    SELECT c_custkey, CASE s WHEN 0 THEN NULL WHEN 1 THEN 'read' WHEN 2 THEN 'read' WHEN 3 THEN 'dml' WHEN 4 THEN 'ddl' ELSE 'privilege' END AS op,
    CASE WHEN s IN (0, 4, 5) THEN 'deny' WHEN s = 3 THEN 'present_only' WHEN s = 2 THEN 'escalate' WHEN k = 0 THEN 'allow' WHEN k = 3 THEN 'deny' ELSE 'escalate' END AS decision FROM m""")
def policy_by_mode(spark, d):
    s, k = F.col("c_custkey") % 6, F.col("c_custkey") % 4
    sql = F.when(s == 0, " -- nothing").when(s == 1, "SELECT a FROM t WHERE b = 1").when(s == 2, "select * from t").when(s == 3, "UPDATE t SET a = 1").when(s == 4, "DROP TABLE t").otherwise("GRANT x TO y")
    mode = F.when(k == 0, "auto").when(k == 1, "confirm_once").when(k == 2, "confirm_each").otherwise("grant_required")
    return table(spark, d, "customer").select("c_custkey", A.decision(sql, mode).alias("x")).select("c_custkey", "x.op", "x.decision")


@query("SELECT 'flowchart TD' || chr(10) || (SELECT string_agg('    n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '{\"' ELSE '[\"' END || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '\"}' ELSE '\"]' END, chr(10) ORDER BY n_nationkey) FROM nation) || chr(10) || (SELECT string_agg('    n' || n_regionkey || ' -- ' || n_name || ' --> n' || n_nationkey, chr(10) ORDER BY n_nationkey) FROM nation) || chr(10) || (SELECT string_agg('    class ' || ids || ' c' || n_regionkey, chr(10) ORDER BY first) FROM (SELECT n_regionkey, string_agg('n' || n_nationkey, ',' ORDER BY n_nationkey) AS ids, min(n_nationkey) AS first FROM nation GROUP BY n_regionkey)) AS text")
def phase_flow(spark, d):
    n = table(spark, d, "nation")
    id_ = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    nodes = n.select(F.col("n_nationkey").alias("ord"), id_("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 2 == 0, "diamond").alias("shape"), F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("class_name"))
    edges = n.select(F.col("n_nationkey").alias("ord"), id_("n_regionkey").alias("from"), id_("n_nationkey").alias("to"), F.col("n_name").alias("label"))
    return D.phase_flow(nodes, edges, "Phases").select("text")
