import functools
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from knowmill.functions import paths as P
from knowmill.functions import text as X
from knowmill.operators import events as E
from knowmill.operators import extract, lifecycle, lint, page_graph, page_quality, reach, registry, render, schema_diff, services
from knowmill.plans import gate
from knowmill.sources import files as FS
from knowmill.sources import sinks
from knowmill.streaming import events as ST
from knowmill.streaming import runs


def one(spark, expr, **values):
    return spark.createDataFrame([Row(**values)]).select(expr.alias("x")).first().x


@pytest.fixture(scope="module")
def six(spark):
    rows = [(0, "A", "B", "extends", "EXTRACTED"), (1, "B", "C", "extends", "EXTRACTED"), (2, "C", "D", "extends", "EXTRACTED"), (3, "A", "E", "supports", "INFERRED"), (4, "E", "D", "extends", "EXTRACTED"), (5, "E", "F", "contradicts", "AMBIGUOUS")]
    return spark.createDataFrame(rows, "ord bigint, from string, to string, type string, provenance string")


def test_degrees_and_god_nodes(six):
    assert {r.node: r.degree for r in page_graph.degrees(six).collect()} == {"A": 2, "B": 2, "C": 2, "D": 2, "E": 3, "F": 1}
    assert [r.node for r in page_graph.god_nodes(six).collect()] == ["E", "A", "B", "C", "D", "F"]


def test_paths(six):
    assert page_graph.shortest_path(six, "A", "D") == ["A", "E", "D"]
    assert page_graph.shortest_path(six, "A", "D", via="B") == ["A", "B", "C", "D"]
    assert page_graph.shortest_path(six, "A", "nowhere") == []
    assert [tuple(r) for r in page_graph.all_paths(six, "A", "D").collect()] == [(["A", "B", "C", "D"], True), (["A", "E", "D"], True)]
    assert [tuple(r) for r in page_graph.all_paths(six, "A", "D", hops=2).collect()] == [(["A", "E", "D"], False)]
    assert reach.search_shortest(six, "A", "D") == (["A", "E", "D"], True)
    assert reach.search_shortest(six, "A", "C", 1) == ([], False) and reach.search_shortest(six, "A", "nowhere") == ([], True)


def test_path_prefixes_lead_to_the_target(spark):
    """Of a wide tree below the source, only what leads to the target is followed."""
    e = [("s", f"x{i}") for i in range(50)] + [(f"x{i}", f"y{i}_{j}") for i in range(50) for j in range(20)] + [("x7", "m"), ("m", "t")]
    edges = spark.createDataFrame([(i, a, b, "supports", "EXTRACTED") for i, (a, b) in enumerate(e)], "ord bigint, from string, to string, type string, provenance string")
    assert [tuple(r) for r in page_graph.all_paths(edges, "s", "t").collect()] == [(["s", "x7", "m", "t"], True)]


def test_components_and_ambiguity(spark, six):
    assert page_graph.clusters(six).collect() == [Row(component="A", n_nodes=6)]
    r = page_graph.ambiguity(six).first()
    assert abs(r.rate - 1 / 6) < 1e-9 and not r.warn
    more = six.union(spark.createDataFrame([(6, "X", "X", "extends", "EXTRACTED"), (7, "w/_archive/x.md", "A", "extends", "EXTRACTED")], six.schema))
    assert {(r.component, r.n_nodes) for r in page_graph.clusters(more).collect()} == {("A", 6), ("X", 1)}
    assert page_graph.degrees(more).where("node = 'X'").first().degree == 2


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("d", "f")], "from string, to string")
    assert {(r.node, r.component) for r in page_graph.cyclic_clusters(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("e", "e")}


def test_long_cycles(spark):
    """Two rings, longer than MAX_ROUNDS hops and than twice as many; a bound that does not suffice is told."""
    ring = lambda p, n: [(f"{p}{i:03}", f"{p}{(i + 1) % n:03}") for i in range(n)]
    e = spark.createDataFrame(ring("a", 70) + ring("b", 130) + [("a000", "b000")], "from string, to string")
    assert {(r.node, r.component) for r in page_graph.cyclic_clusters(e).collect()} == {(f"{p}{i:03}", f"{p}000") for p, n in (("a", 70), ("b", 130)) for i in range(n)}
    dense = spark.range(3000).selectExpr("cast(id as string) as `from`", "explode(array(cast((id + 1) % 3000 as string), cast(id * 7 % 3000 as string))) as `to`")
    with pytest.raises(RuntimeError, match="settled"):
        page_graph.cyclic_clusters(dense, rounds=2)


def test_ring_of_many_nodes(spark):
    n = 100_000
    e = spark.range(n).selectExpr("cast(id as string) as `from`", f"cast((id + 1) % {n} as string) as `to`")
    assert [tuple(r) for r in reach.strongly_connected(e).groupBy("component").count().collect()] == [("0", n)]


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    edges = {(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(60)}
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    far = lambda a: functools.reduce(lambda seen, _: seen | {y for x in seen for y in to.get(x, ())}, range(40), to.get(a, set()))
    reach_of = {x: far(x) for x in {n for e in edges for n in e}}
    want = {(x, min(y for y in r if x in reach_of[y])) for x, r in reach_of.items() if x in r}
    e = spark.createDataFrame([*edges, (None, "n01"), ("n01", None)], "from string, to string")
    assert {tuple(r) for r in reach.strongly_connected(e).collect()} == want
    assert reach.strongly_connected(e.limit(0)).count() == 0


def test_components_do_not_broadcast(spark):
    """No table of a round goes through the driver, however small."""
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "from string, to string")
    plans = [reach.trimmed(e), reach.strongly_connected(e)]
    assert not any("Broadcast" in d._jdf.queryExecution().executedPlan().toString() for d in plans)


def test_run_states_do_not_hang_on_batches(spark, tmp_path):
    """The same outcomes whether records come as one file or as many."""
    rows = [("a", 0, "running", "01 00:00"), ("a", 1, "passed", "01 01:00"), ("a", 2, "running", "01 02:00"), ("a", 3, "running", "05 00:00"), ("b", 4, "error", "01 00:00"), ("b", 5, "ran", "02 00:00"), ("c", 6, "pending", "06 00:00"), (None, 7, "ran", "01 00:00")]
    df = spark.createDataFrame([(r, p, s, f"2024-01-{t}:00") for r, p, s, t in rows], "run string, pos bigint, status string, t string").select("run", "pos", "status", F.to_timestamp("t").alias("time"))
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    for i in range(len(rows)):
        df.where(f"pos = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "many"))
    got = {}
    for name in ("one", "many"):
        out = runs.replay(spark, str(tmp_path / name), lambda x: x, "6 hours", "2 days", str(tmp_path / f"{name}-out"))
        got[name] = {(r.run, r.pos, r.status, r.outcome) for r in out.collect()}
    assert got["one"] == got["many"]
    assert got["one"] == {("a", 0, "running", "accepted"), ("a", 1, "passed", "accepted"), ("a", 2, "passed", "refused"), ("a", 1, None, "expired"), ("a", 3, "running", "accepted"), ("a", 3, "pending", "reverted"), ("b", 4, "error", "accepted"), ("b", 4, "pending", "reverted"), ("b", 5, "ran", "accepted"), ("b", 5, None, "expired"), ("c", 6, "pending", "accepted")}


def test_run_states_round_times_and_hear_all_records(spark, tmp_path):
    """Halves of a millisecond go away from zero; a record without a run or a status moves the time on."""
    rows = [("a", 0, "running", 1500), ("b", 1, "ran", 2500), ("c", 2, "ran", 2499), (None, 3, "ran", 100 * 3_600_000_000), ("d", 4, None, 5)]
    df = spark.createDataFrame(rows, "run string, pos bigint, status string, us bigint").select("run", "pos", "status", F.timestamp_micros("us").alias("time"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = runs.replay(spark, str(tmp_path / "in"), lambda x: x, "6 hours", "2 days", str(tmp_path / "out"))
    hour = 3_600_000
    assert {(r.run, r.at, r.outcome) for r in out.collect()} == {("a", 2, "accepted"), ("a", 6 * hour + 2, "reverted"), ("b", 3, "accepted"), ("b", 48 * hour + 3, "expired"), ("c", 2, "accepted"), ("c", 48 * hour + 2, "expired")}


def test_duplicate_diagrams_equal_brute_force(spark):
    """Any size of the blocks gives the same pairs; repeated pages, nulls and several shared keys count once. Pairs are not shuffled."""
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(60):02}", [rng.choice("abc") for _ in range(rng.randrange(4))], [rng.choice("xy") for _ in range(rng.randrange(3))]) for _ in range(90)]
    pages = spark.createDataFrame([*rows, (None, ["a"], ["x"]), ("q", [None, "a"], ["x", None]), ("r", None, ["x"])], "page string, sources array<string>, titles array<string>")
    keys = {}
    for p, ss, ts in [*rows, ("q", ["a"], ["x"])]:
        keys.setdefault(p, set()).update((s, t) for s in ss for t in ts)
    both = {(a, b): keys[a] & keys[b] for a in keys for b in keys if a < b and keys[a] & keys[b]}
    want = sorted((a, b, sorted({s for s, _ in v}), sorted({t for _, t in v})) for (a, b), v in both.items())
    for cell in (1, 7, 1000):
        assert sorted(tuple(r) for r in lifecycle.duplicate_diagrams(pages, cell).collect()) == want
    many = spark.range(200).selectExpr("id as page", "array('s') as sources", "array('t') as titles")
    plan = lifecycle.duplicate_diagrams(many)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" not in plan and "collect_set(source" not in plan
    assert lifecycle.duplicate_diagrams(many, 16).count() == 200 * 199 // 2


def test_log_positions_do_not_hang_on_splits(spark, tmp_path):
    for f, (low, high) in {"a.jsonl": (0, 500), "b.jsonl": (500, 1200)}.items():
        (tmp_path / f).write_text("".join(f"line {i}\n" + ("\n" if i % 100 == 0 else "") for i in range(low, high)))
    old, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    for size in ("128m", "200"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        lines = FS.numbered_lines(spark, str(tmp_path))
        seen.append((lines.rdd.getNumPartitions(), [tuple(r) for r in lines.orderBy("pos").collect()]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen[0][1] == seen[1][1] and seen[1][0] > 30 > seen[0][0]
    assert [v for _, v in seen[0][1]] == [f"line {i}" for i in range(1200)] and seen[0][1][-1][0] == 1211


def test_remove_first_edge(spark, six):
    twice = six.union(spark.createDataFrame([(9, "A", "B", "extends", "INFERRED")], six.schema))
    left = sinks_edges = page_graph.without_first(twice, "A", "B", "extends")
    assert left.where("from = 'A' and to = 'B'").first().ord == 9 and sinks_edges.count() == 6


@pytest.mark.parametrize(
    "raw,want",
    [("http://h/a//b/{id}?x=1", "/a/b/{}"), ("", "/"), ("/x/:id/${k}", "/x/{}/{}"), ("/v{n}/y", "/{}/y"), ("https://h", "/")],
)
def test_normalize_path(spark, raw, want):
    assert one(spark, P.normalize_path("p"), p=raw) == want


def test_path_match_is_not_symmetric(spark):
    assert one(spark, P.path_matches("a", "b"), a="/o/1", b="/o/{}")
    assert not one(spark, P.path_matches("a", "b"), a="/o/{}", b="/o/1")


def test_text_expressions(spark):
    assert one(spark, X.snake_case("p"), p="OrderLineItem") == "order_line_item"
    assert one(spark, X.round2("p"), p=1.005) == 1.0
    assert one(spark, X.percent_half_even("p"), p=0.125) == 12
    assert one(spark, X.thousands("p"), p=1234567) == "1,234,567"
    assert one(spark, X.truncate_summary("p", 10), p="a  b\nc d e f g h i") == "a b c d e…"
    assert one(spark, X.brackets_balanced("p"), p="a[b(c)]{}") and not one(spark, X.brackets_balanced("p"), p="(]")
    assert one(spark, X.tldr("p"), p="x\n## TL;DR\nshort\n## Next\ny") == "short"
    assert one(spark, X.tldr("p"), p="## TL;DR\nlast words") == "last words"
    assert one(spark, X.resolve_link("p", "q"), p="wiki/a/b.md", q="../c.md") == "wiki/c.md"
    assert one(spark, X.package_dependencies("p"), p='{"dependencies": {"a": "1"}, "devDependencies": {"b": "1", "a": "2"}}') == ["a", "b"]
    assert one(spark, X.requirements("p"), p="# x\nnumpy==1\n pandas>=2\n") == ["numpy", "pandas"]
    assert one(spark, X.maven_id("p"), p="<parent><artifactId>x</artifactId></parent><artifactId> y </artifactId>") == "y"
    assert one(spark, X.since("p", F.lit("2024-01-10 00:00:00").cast("timestamp")), p="2d").isoformat() == "2024-01-08T00:00:00"


def test_event_statistics(spark, tmp_path):
    lines = [
        {"ts": "2026-04-08T10:00:00+00:00", "op": "ingest", "cost_usd": 0.05, "reduction_ratio": 0.6, "agent": "x"},
        {"ts": "2026-04-08T11:00:00+00:00", "op": "query", "total_cost_usd": 0.03, "reduction_ratio": 0.4, "tokens_in": 10, "tokens_out": 5},
        {"ts": "2026-04-09T10:00:00+00:00", "op": "ingest", "cost_usd": 0.06, "reduction_ratio": 0.8, "duration_ms": 100, "agent_calls": [{"agent": "y", "cost_usd": 0.01}]},
        {"ts": "2026-04-10T10:00:00+00:00", "op": "lint", "cost_usd": 0.02, "reduction_ratio": 0.5},
        {"ts": "2026-04-10T10:00:00+00:00", "op": "archive", "cost_usd": 9.0},
    ]
    p = tmp_path / "events.jsonl"
    p.write_text("\n".join([*map(json.dumps, lines), "{broken", ""]))
    log = FS.event_log(spark, str(p))
    assert log.count() == 5
    s = {r.op: r for r in E.stats_by_op(log).collect()}
    assert {k: r.n_events for k, r in s.items()} == {"ingest": 2, "query": 1, "lint": 1}
    assert abs(sum(r.cost_usd for r in s.values()) - 0.16) < 1e-9
    assert s["query"].tokens == 15 and s["lint"].tokens is None and s["ingest"].avg_duration_ms == 100
    v = E.value_stats(log).first()
    assert abs(v["mean"] - 0.575) < 1e-9 and abs(v.p50 - 0.55) < 1e-9 and v.p95 == 0.8
    late = E.counted(E.read_since(log, "2026-04-09"))
    assert late.count() == 2
    assert {r.agent: r.cost_usd for r in E.cost_by_agent(log).collect()} == {"x": 0.05, "y": 0.01}
    assert E.daily_summary(log, "2026-04-10").first().n_events == 2


def test_p95_is_an_index(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)], "v double")
    assert E.value_stats(df, "v").first().p95 == 19.0
    assert df.agg(E.percentile_95(F.collect_list("v")).alias("x")).first().x == 19.0


def test_service_graph(spark):
    S = spark.createDataFrame([(0, "orders-service", ["orders-service.url", "orders"], "service"), (1, "payments-service", ["payments"], "service"), (2, "web-ui", [], "frontend"), (3, "common", [], "library")], "ord int, id string, aliases array<string>, kind string")
    C = spark.createDataFrame([("web-ui", "axios", "GET", "", None, "/api/orders/5", "a.ts", 1), ("orders-service", "rest", "POST", "${payments.url}", None, "/pay", "B.java", 2), ("orders-service", "rest", "GET", "https://stripe.com/x", None, "https://stripe.com/x", "B.java", 3), ("web-ui", "axios", "GET", "", None, "/api/orders/none/x", "a.ts", 4), ("common", "rest", "GET", "payments", None, "/pay", "c", 1)], "service_id string, framework string, method string, target_ref string, resolved_target string, path string, file string, line int")
    R = spark.createDataFrame([("orders-service", "spring", "get", "/api/orders/{id}", "f", 1)], "service_id string, framework string, method string, path string, file string, line int")
    Qe = spark.createDataFrame([("orders-service", "amqp", "producer", "key", "M", "f", 1), ("payments-service", "amqp", "consumer", "jobs", "", "f", 2)], "service_id string, framework string, role string, queue_name string, message_type string, file string, line int")
    Qb = spark.createDataFrame([("payments-service", "jobs", "ex", "key", "f", 1)], "service_id string, queue_name string, exchange string, routing_key string, file string, line int")
    O = spark.createDataFrame([("payments-service", "Charge", "charge", "billing", "f")], "service_id string, class_name string, table_name string, schema_name string, source_file string")  # noqa: E741
    X_ = spark.createDataFrame([("orders-service", "database", "jdbc:x", "db", False, "f", 3)], "service_id string, kind string, detail string, connector_id string, configured boolean, file string, line int")
    D = spark.createDataFrame([("web-ui", "common"), ("payments-service", "common"), ("orders-service", "common")], "service_id string, library_id string")
    g = services.service_graph({"services": S, "http_clients": C, "rest_endpoints": R, "queue_endpoints": Qe, "queue_bindings": Qb, "orm_entities": O, "external_sources": X_, "library_deps": D})
    got = {(r.from_service, r.to_service, r.kind, r.confidence) for r in g.collect()}
    assert ("web-ui", "orders-service", "calls", "high") in got
    assert ("orders-service", "payments-service", "calls", "medium") in got
    assert ("orders-service", "ext:http:stripe.com", "external_source", "medium") in got
    assert ("orders-service", "queue:key", "produces", "high") in got and ("orders-service", "queue:jobs", "produces", "high") in got
    assert ("queue:jobs", "payments-service", "consumes", "high") in got
    assert ("payments-service", "table:billing.charge", "reads_table", "high") in got
    assert ("orders-service", "ext:db", "external_source", "high") in got
    assert ("web-ui", "common", "depends_on", "high") in got
    assert ("web-ui", "payments-service", "calls", "medium") in got  # through the library
    assert not any(a == b for a, b, _, _ in got)
    assert services.inbound_rank(g).first().service == "payments-service"
    assert services.library_matrix(g).first().n_consumers == 3
    p = services.page_predicates(S, g, O).first()
    assert p.topology and p.clients and p.queues and p.db and p.libraries


def test_match_names_and_recall(spark):
    gold = spark.createDataFrame([("orders",), ("pay-gate",), ("zzz",)], "name string")
    det = spark.createDataFrame([("orders-service",), ("orders-service-x",), ("pay",)], "id string")
    assert {r.name: r.id for r in services.match_names(gold, det).collect()} == {"orders": "orders-service", "pay-gate": "pay"}
    g = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    f = spark.createDataFrame([("a", "b"), ("a", "c"), ("x", "y")], "a string, b string")
    r = services.recall(g, f).first()
    assert r.recall == 50.0 and r.precision == 50.0


PAGES = [
    ("wiki/auth/session.md", "x [a](jwt.md) [b](../db/schema.md) [c](gone.md)\n```mermaid\nsequenceDiagram\nA->B: (x)\n```\n", {"title": "S", "type": "concept", "tags": ["a", "b", "c", "d"], "sources": ["s"], "created": "2026-01-01", "updated": "2020-01-01", "quality": 0.5, "summary": "s"}),
    ("wiki/auth/jwt.md", "y", {"type": "weird", "tags": [], "sources": ["s"], "created": "x", "updated": "2099-01-01", "quality": 1, "summary": "s"}),
    ("wiki/db/schema.md", "z\n```mermaid\nboo\nA[\n```", {"title": "D", "type": "claim", "status": "deprecated", "confidence": 0.9, "tags": ["Database"], "sources": [], "created": "x", "updated": "2099-01-01", "quality": 1, "summary": "s"}),
    ("wiki/index.md", "[s](auth/session.md)", None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(p, c, c, json.dumps(f) if f else None) for p, c, f in PAGES], "path string, content string, body string, fm string")


def test_lint(spark, pages):
    edges = spark.createDataFrame([(0, "wiki/auth/session.md", "wiki/auth/jwt.md", "extends", "AMBIGUOUS")], "ord bigint, from string, to string, type string, provenance string")
    got = {(r.category, r.page, r.severity) for r in lint.lint(pages, edges, "2026-01-01").collect()}
    assert ("broken_links", "wiki/auth/session.md", "error") in got
    assert ("missing_frontmatter", "wiki/index.md", "error") in got and ("missing_frontmatter", "wiki/auth/jwt.md", "error") in got
    assert not any(c == "orphan_page" for c, _, _ in got)
    assert ("mermaid_syntax", "wiki/db/schema.md", "error") in got and ("mermaid_syntax", "wiki/auth/session.md", "error") not in got
    assert ("stale_content", "wiki/auth/session.md", "info") in got
    assert ("deprecated_claims", "wiki/db/schema.md", "error") in got and ("deprecated_claims", "wiki/db/schema.md", "warning") in got
    assert ("high_ambiguity", "graph", "warning") in got and ("thin_clusters", "wiki/auth/jwt.md", "warning") in got
    assert ("index_coverage", "wiki/auth/jwt.md", "warning") in got
    assert lint.lint(pages, edges, "2026-01-01", category="stale_content").count() == 1
    assert {r.line for r in lint.diagrams(pages).collect()} == {2}


def test_drift_and_provenance(spark, pages):
    refs = spark.createDataFrame([("p", "a.py", "bad"), ("p", "none.py", "x")], "page string, file string, content_hash string")
    files = spark.createDataFrame([("a.py", "x")], "path string, content string")
    assert {r.severity for r in lint.code_ref_drift(pages, refs, files).collect()} == {"error", "warning"}
    e = spark.createDataFrame([("a", "b", '{"from": "a"}'), ("a", "c", '{"provenance": null}')], "from string, to string, raw string")
    assert [r.page for r in lint.provenance(e).collect()] == ["a -> b"]


def test_page_quality(spark, pages):
    q = {r.path: r for r in page_quality.score(pages).collect()}
    assert abs(q["wiki/auth/session.md"].quality - 0.4) < 1e-9
    assert {s.signal for s in q["wiki/db/schema.md"].signals} >= {"no_sources", "deprecated_no_reason"}
    edges = spark.createDataFrame([(i, "wiki/auth/session.md", f"n{i}", "extends", "x") for i in range(5)], "ord bigint, from string, to string, type string, provenance string")
    q = {r.path: {s.signal for s in r.signals} for r in page_quality.score(pages, edges).collect()}
    assert "god_node" in q["wiki/auth/session.md"] and "isolated_node" in q["wiki/auth/jwt.md"]


def test_lifecycle(spark):
    files = spark.createDataFrame([("src/auth/a.ts",), ("src/pay/b.ts",), ("x.md",)], "path string")
    index = spark.createDataFrame([("P", 0, ["src/auth/"]), ("Q", 1, ["src/auth/a.ts"])], "page string, ord int, sources array<string>")
    got = {r.path: (r["class"], r.page or r.topic) for r in lifecycle.classify_changes(files, index, ["pay"]).collect()}
    assert got == {"src/auth/a.ts": ("stale", "P"), "src/pay/b.ts": ("uncovered", "pay"), "x.md": ("unrelated", None)}
    pages = spark.createDataFrame([("a", ["x", "http://u"]), ("b", ["gone"]), ("c", None), ("d", ["x", "gone"])], "page string, sources array<string>")
    there = spark.createDataFrame([("x",)], "path string")
    s = {r.page: r.status for r in lifecycle.source_existence(pages, there).collect()}
    assert s == {"a": "live", "b": "orphan", "c": "live", "d": "candidate"}
    c = spark.createDataFrame([("e1", ["h1", "h2"]), ("e2", ["h1"]), ("e3", [])], "id string, sources array<string>")
    cache = spark.createDataFrame([("h1", "1"), ("h2", "0")], "hash string, version string")
    assert {r.id: r.cached for r in lifecycle.cached(c, cache, "1").collect()} == {"e1": False, "e2": True, "e3": False}


def test_sanitize(spark):
    t = "see https://github.com/a/b/pull/99 and #12 and #50 and o/r#77 GH-60 abcdef1 1234567\nfixed by x\nok"
    r = one(spark, lifecycle.sanitize_issue(F.col("t"), F.lit(40)), t=t)
    assert r.text == "see [link-removed] and #12 and #[ref-removed] and [ref-removed] GH-[ref-removed] [sha-removed] 1234567\n[line-removed]\nok"
    assert len(r.redactions) == 6


def test_sanitize_neighbours(spark):
    texts = {
        "a#50 x&#50 (#50) #39 #12345678 #50x": "a#50 x&#50 (#[ref-removed]) #39 #12345678 #50x",
        "x/o/r#60, -a/b#41. o/#50": "x/[ref-removed], -[ref-removed]. o/#[ref-removed]",
        "o/r#60#99 #60#99": "[ref-removed]#[ref-removed] #[ref-removed]#99",
        "gh-41 foo-GH-60x GH-39 GH-40": "GH-[ref-removed] foo-GH-60x GH-39 GH-[ref-removed]",
        "(http://github.com/a/b/commit/abc.) https://github.com/pull/1": "([link-removed].) https://github.com/pull/1",
        "deadbeef cafe 12345678 DEADBEEF1": "[sha-removed] cafe 12345678 [sha-removed]",
        "Resolved\tvia it\nresolved, by it": "[line-removed]\nresolved, by it",
        "": "",
        None: "",
    }
    d = spark.createDataFrame([(k,) for k in texts], "t string").select("t", lifecycle.sanitize_issue(F.col("t"), F.lit(40)).alias("r"))
    assert {r.t: r.r.text for r in d.collect()} == texts
    long = one(spark, lifecycle.sanitize_issue(F.repeat(F.lit("#41 a/b#39 "), 20000), F.lit(40)))
    assert len(long.redactions) == 20000


def test_sanitize_leaves_plain_texts(spark):
    """Texts without anything to look at are not cut into tokens: 36 MB of them take a few seconds."""
    import time

    d = spark.range(60_000, numPartitions=4).select(F.concat("id", F.repeat(F.lit(" plain words, all of them"), 24)).alias("t"))
    start = time.time()
    assert d.where(lifecycle.sanitize_issue(F.col("t"), F.lit(40))["text"] != F.col("t")).count() == 0
    assert time.time() - start < 30


def test_unbounded_statements(spark):
    from knowmill.plans import gate

    cases = {"select * from t": True, "SELECT a FROM t WHERE a": False, "select a from t join u on x": False, "select a from t join u using (x)": True, "select a\nfrom t group  by a": False, "select from_x from(t)": False, "select*from t": False, "with x as (select 1) select * from x": False, "": False, "select a from t limit1": True}
    d = spark.createDataFrame([(k,) for k in cases], "q string").select("q", gate.unbounded(F.col("q")).alias("u"))
    assert {r.q: r.u for r in d.collect()} == cases == {q: gate.is_unbounded(q) for q in cases}


def test_schema_diff(spark):
    e = spark.createDataFrame([("U", "public", "users"), ("L", "", "lines"), ("G", "x", "lines")], "class_name string, schema_name string, table_name string")
    c = spark.createDataFrame([("U", "id"), ("U", "extra")], "class_name string, name string")
    k = spark.createDataFrame([("public", "users", "id"), ("public", "users", "email"), ("public", "lines", "id"), ("public", "rest", "id")], "schema string, table string, column string")
    got = {(r.kind, r.entity, r.table, r.field) for r in schema_diff.diff(e, c, k).collect()}
    assert ("mismatch", "U", "public.users", "extra") in got and ("mismatch", "U", "public.users", "email") in got
    assert ("matched", "L", "public.lines", None) in got and ("orphan", "G", None, None) in got and ("unmapped", None, "public.rest", None) in got


def test_gate(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("orders")
    g = gate.QueryGate(spark)
    r = g.execute("SELECT o_orderkey FROM orders WHERE o_orderkey > :k", {"k": 0}, max_rows=5)
    assert r["status"] == "ok" and r["row_count"] == 5 and r["truncated"]
    assert g.execute("DROP TABLE orders")["status"] == "deny"
    assert g.execute("SELECT nope FROM orders LIMIT 1")["status"] == "error"
    assert g.healthy() and any(t["table"] == "orders" for t in g.schema())
    p = gate.Policy("grant_required")
    assert p.check("SELECT 1")[0] == "deny"
    p.grant("read")
    assert p.check("SELECT 1")[0] == "allow"
    with pytest.raises(ValueError):
        gate.Policy("never")


def test_documents_and_inference(spark):
    d = spark.createDataFrame([(1, "a", 5.0), (2, "b", 7.0), (3, "a", 9.0)], "k int, s string, v double")
    q = lambda e: gate.document_query({"d": d}, e)
    assert q({"collection": "d", "op": "find", "filter": {"$or": [{"s": "b"}, {"v": {"$gte": 9}}]}, "projection": {"k": 1}, "sort": {"k": -1}}).collect() == [Row(k=3), Row(k=2)]
    assert q({"collection": "d", "op": "aggregate", "pipeline": [{"$group": {"_id": "$s", "m": {"$max": "$v"}}}, {"$sort": {"_id": 1}}, {"$limit": 1}]}).collect() == [Row(_id="a", m=9.0)]
    with pytest.raises(PermissionError):
        q({"collection": "d", "op": "deleteMany"})
    assert gate.key_value_query({"d": d}, {"table": "d", "op": "get", "key": {"k": 2}}).first().s == "b"
    j = spark.createDataFrame([('{"_id": 1, "a": null}',), ('{"a": "x", "b": [1]}',)], "json string")
    assert {r.name: r.data_type for r in gate.infer_fields(j).collect()} == {"_id": "number", "a": "string", "b": "array"}


def test_registry(spark):
    df = spark.createDataFrame([(0, "https://a.atlassian.net/wiki/x"), (1, "https://a.atlassian.net/browse/K-1"), (2, "gh://o/r"), (3, "https://EXAMPLE.com"), (4, "jdbc:pg"), (5, "src/a.py"), (6, "gh://o/r"), (7, "notes.md")], "ord int, source string")
    got = [r.c for r in df.select("ord", registry.classify(F.col("source")).alias("c")).orderBy("ord").collect()]
    assert got == ["confluence", "jira", "github", "", "db", "", "github", ""]
    rows = [(r.source, r.kind, r.hint) for r in registry.deeper_rows(df, ("jira", "confluence")).collect()]
    assert rows.count(("gh://o/r", "connector", True)) == 2 and ("src/a.py", "code", False) in rows and ("notes.md", "file", False) in rows


REPO = {
    "orders/pom.xml": "<project><artifactId>orders</artifactId></project>",
    "orders/src/Api.java": 'import org.springframework;\n@RestController\n@GetMapping("/orders/{id}")\nclass A {}\n',
    "orders/src/Bus.java": 'import org.springframework.amqp;\nstatic final String Q_NAME = "jobs";\nx.convertAndSend(Q_NAME, m);\n@RabbitListener(\n  queues = \"in\")\n',
    "orders/src/application.properties": "spring.datasource.url=jdbc:postgresql://u:p@h/db\n",
    "web/package.json": '{"dependencies": {"vue": "3"}}',
    "web/src/a.ts": "import axios from 'axios'\naxios.get('/api/orders/5')\n",
    "pay/pyproject.toml": "[project]\nname='pay'\n",
    "pay/m.py": "class User(Base):\n    __tablename__ = 'users'\n    id = Column(Integer)\n    roles = relationship('Role', secondary='user_roles')\nclass Role(Base):\n    name = Column(String)\n",
}


def test_extraction(spark):
    f = spark.createDataFrame(list(REPO.items()), "path string, content string")
    assert [(r.method, r.path, r.line) for r in extract.rest_endpoints(f).collect()] == [("GET", "/orders/{id}", 3)]
    assert [(r.method, r.path) for r in extract.http_clients(f).collect()] == [("GET", "/api/orders/5")]
    assert {(r.role, r.queue_name, r.line) for r in extract.queue_endpoints(f, extract.constants(f)).collect()} == {("producer", "jobs", 3), ("consumer", "in", 5)}
    anchored = spark.createDataFrame([("a.java", 'import org.springframework.cloud.openfeign;\n@FeignClient(name = "pay", path = "/v1")\n@GetMapping("/x")\n'), ("b.java", 'WebClient w = b.baseUrl("http://h:1/").build();\nw.post()\n .uri("/y")\n'), ("c.cs", '[ApiController]\n[Route("api/[controller]")]\npublic class UserController : ControllerBase {\n[HttpGet]\n[HttpPost("{id}")]\n')], "path string, content string")
    assert {(r.framework, r.method, r.target_ref, r.path, r.line) for r in extract.http_clients(anchored).collect()} == {("feign", "GET", "pay", "/v1/x", 3), ("webclient", "POST", "http://h:1/", "/y", 3)}
    assert {(r.method, r.path, r.line) for r in extract.rest_endpoints(anchored).collect()} >= {("GET", "api/user", 4), ("POST", "api/user/{id}", 5)}
    x = extract.external_sources(f).collect()
    assert [(r.kind, r.connector_id, r.detail) for r in x] == [("database", "db", "jdbc:postgresql://h/db")]
    p = next(p for p in extract.load_profiles("orm") if p["name"] == "sqlalchemy")
    e = {r.class_name: r for r in extract.orm_entities(f, p).collect()}
    assert e["User"].table_name == "users" and e["User"].relationships[0].through_table == "user_roles" and e["User"].relationships[0].type == "many_to_many"
    assert e["Role"].table_name == "role" and e["Role"].columns == ["name"]
    assert extract.detect_orm(f).first().profile == "sqlalchemy"
    s = {r.id: (r.kind, r.language) for r in extract.services(f).collect()}
    assert s == {"orders": ("service", "java"), "web": ("frontend", "typescript"), "pay": ("service", "python")}
    inv = extract.inventory(f)
    assert {r.service_id for r in inv["rest_endpoints"].collect()} == {"orders"}
    with pytest.raises(ValueError):
        extract.check_profile({"name": "x", "file_patterns": ["*"], "markers": ["m"], "patterns": [{"regex": "("}]})


def test_calls_over_lines(spark):
    from knowmill.functions.code import calls

    text = """// app.get('/no', f)
app
  .post(
    "/a/:id", // first
    async (req, res) => { other('x', { topic: 'no' }) })
const q = new Queue<Job>('mail')
w.Topic = "t"
"""
    found = [(f[6], f[7], f[8], f[4], f[3], f[9][0][3] if f[9] else "") for f in calls("a.ts", text)]
    assert found[0] == ("app", "(", "post", "", 3, "/a/:id") and ("new", "(", "Queue", "q", 6, "mail") in found and ("w", "=", "Topic", "", 7, "t") in found
    assert all(f[2] != "get" for f in found)
    odd = ["", "f(", "))]}", "'", '"', "`", "/*", "a.b.", "f(g(h(", "x = ", "[", "f(,,)", "f<a>(", ">(" * 50, "\u0000\u0001("]
    for suffix in (".ts", ".py", ".rb", ".go", ".java", ".unknown"):
        for x in odd:
            assert isinstance(calls("a" + suffix, x), list)
    deep = calls("a.js", "f(" * 3000 + "'x'" + ")" * 3000)
    assert len(deep) == 3000 and deep[-1][9][0][3] == "x"


def test_calls_of_odd_files_and_rules(spark):
    files = [
        ("a.js", "const x = require('express')\napp.get(\n  '/multi',\n  f)\n/* app.put('/gone', f) */\n"),
        ("b.py", "from flask import Flask\n@app.route('/p',\n  methods=['PUT'])\n@app.route('/q')\n"),
        ("c.ts", "fetch('/w', {\n  headers: { a: 'b' },\n  method: 'POST' })\nfetch(`/i/${x}`)\n"),
        ("d.go", 'import "net/http"\nhttp.NewRequestWithContext(ctx, http.MethodPut, "/ctx", nil)\n'),
        ("e.java", None),
        ("f.java", ""),
    ]
    f = spark.createDataFrame(files, "path string, content string")
    assert {(r.method, r.path, r.file, r.line) for r in extract.rest_endpoints(f).collect()} == {("GET", "/multi", "a.js", 3), ("PUT", "/p", "b.py", 2), ("GET", "/q", "b.py", 4)}
    assert {(r.framework, r.method, r.path) for r in extract.http_clients(f).collect()} == {("fetch", "POST", "/w"), ("go_nethttp", "PUT", "/ctx")}
    own = {"name": "own", "file_patterns": ["**/*.js"], "markers": ["express"], "patterns": [{"regex": r"app\.(get)", "method": 1, "path": 1}]}
    assert {(r.framework, r.path) for r in extract.rest_endpoints(f, [own]).collect()} == {("own", "get")}
    assert extract.rest_endpoints(f.limit(0)).count() == 0


def test_calls_are_held_by_parts(spark):
    """Calls go to Spark by parts of the text, not by batches of files; the parts tell the same as the whole."""
    from knowmill.functions import code

    assert list(code.parts(["abc", None, "x" * 50, "", "y"], 8)) == [(0, 3), (3, 5)]
    f = spark.range(40, numPartitions=2).selectExpr("concat(id, '.py') as path", "repeat(concat('g(', id, ')\n'), int(id)) as content", "id")
    for size in (1, 64, code.PART):
        assert [(r.id, len(r._calls)) for r in code.with_calls(f, size).orderBy("id").collect()] == [(i, i) for i in range(40)]


def test_queue_bindings_shuffle_no_calls(spark):
    """Chains are followed in their file; what is written, joined and shuffled holds no arguments or arrays."""
    f = spark.createDataFrame([("B.java", 'class B { Binding c() { return BindingBuilder.bind(new Queue("a")).to(new FanoutExchange("b")).with("k"); } }')], "path string, content string")
    assert extract.broker_facts(f).columns == ["path", "role", "id", "at", "line", "kind", "value"]
    assert [tuple(r) for r in extract.queue_bindings(f).collect()] == [("a", "b", "k", "B.java", 1)]
    assert "receiver" not in extract.queue_bindings(f)._jdf.queryExecution().executedPlan().toString()


def test_queue_bindings(spark):
    text = """class B {
  static final String KEY = "k.one";
  @Bean
  public Queue jobs() { return new Queue("jobs.q"); }
  @Bean TopicExchange ex() {
    return new TopicExchange("ex.t", true, false);
  }
  Binding b() { return BindingBuilder
      .bind(jobs())
      .to(ex())
      .with(Names.KEY); }
  Binding c() { return BindingBuilder.bind(new Queue("nq")).to(new FanoutExchange("fan")); }
  Binding d() { return BindingBuilder.bind(unknown).to(ex()).with("x"); }
  @RabbitListener(bindings = @QueueBinding(
     value = @Queue(value = "aq", durable = "true"), // (
     exchange = @Exchange("ae"),
     key = "rk"))
}"""
    f = spark.createDataFrame([("B.java", text), ("C.java", None), ("D.java", "bind(")], "path string, content string")
    got = {(r.queue_name, r.exchange, r.routing_key, r.line) for r in extract.queue_bindings(f, extract.constants(f)).collect()}
    assert got == {("jobs.q", "ex.t", "k.one", 9), ("nq", "fan", "", 12), ("aq", "ae", "rk", 14)}
    assert {(r.bean, r.name) for r in extract.bean_names(f).collect()} == {("jobs", "jobs.q"), ("ex", "ex.t")}
    assert {r.routing_key for r in extract.queue_bindings(f).collect()} == {"", "rk"}


def test_scan_ignore_and_pages(spark, tmp_path):
    for path, text in {"a/x.py": "1", "a/.gitignore": "*.log\n!keep.log\n", "a/b.log": "", "a/keep.log": "", ".gitignore": "out2/\n", "out2/z.py": "", "node_modules/q.py": "", "wiki/p.md": "---\ntitle: T\nd: 2024-01-01\n---\nbody", "wiki/_archive/o.md": "old", "wiki/bad.md": "---\r\ntitle: x\r\n---\r\n"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    f = FS.scan_files(spark, str(tmp_path))
    left = {r.path for r in FS.without_ignored(f, FS.ignore_rules(f)).collect()}
    assert "a/x.py" in left and "a/keep.log" in left and "a/b.log" not in left and "out2/z.py" not in left and "node_modules/q.py" not in left
    pg = {r.path: r for r in FS.pages(f).collect()}
    assert set(pg) == {"wiki/p.md", "wiki/bad.md"} and json.loads(pg["wiki/p.md"].fm)["d"] == "2024-01-01" and pg["wiki/p.md"].body == "body" and pg["wiki/bad.md"].fm is None
    assert {r.path for r in FS.pages(f, archived=True).collect()} == {"wiki/_archive/o.md"}
    assert FS.scan_files(spark, str(tmp_path), ["**/*.py"]).count() == 2


def test_edge_log_fails_on_a_bad_line(spark, tmp_path):
    p = tmp_path / "e.jsonl"
    p.write_text('{"from": "a", "to": "b"}\n{oops\n')
    with pytest.raises(Exception):  # noqa: B017
        FS.edge_log(spark, str(p)).collect()


def test_binary_documents(spark, tmp_path):
    import zipfile

    w = tmp_path / "d.docx"
    with zipfile.ZipFile(w, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>hi</w:t></w:r></w:p></w:document>')
    s = tmp_path / "s.pptx"
    with zipfile.ZipFile(s, "w") as z:
        for i in (10, 2):
            z.writestr(f"ppt/slides/slide{i}.xml", f'<a:x xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:t>n{i}</a:t></a:p></a:x>')
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    raw = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = {r.path.rsplit("/", 1)[-1]: r for r in FS.document_text(raw).collect()}
    assert got["d.docx"].text == "hi" and got["s.pptx"].text == "## Slide 2\n\nn2\n\n## Slide 10\n\nn10" and got["bad.docx"].error


def test_sinks(spark, tmp_path, six):
    p = str(tmp_path / "edges")
    sinks.append_edges(six.drop("ord"), p)
    assert spark.read.json(p).count() == 6
    with pytest.raises(Exception):  # noqa: B017
        sinks.append_edges(six.drop("ord").withColumn("type", F.lit("nonsense")), p)
    state = spark.createDataFrame([("ingest", ["a"])], "op string, done array<string>")
    two = sinks.record_unit(sinks.record_unit(state, "ingest", "a"), "lint", "b")
    assert {(r.op, tuple(r.done)) for r in two.collect()} == {("ingest", ("a",)), ("lint", ("b",))}


def test_render(spark, six):
    n = spark.createDataFrame([(0, "a b", 'x "y"'), (1, "a b", "z"), (2, "9", "nine")], "ord int, id string, label string")
    e = spark.createDataFrame([(0, "a b", "9", "go")], "ord int, from string, to string, label string")
    assert render.graph(n, e, "t").first().text == 'graph TB\n  a_b["x &quot;y&quot;"]\n  _9["nine"]\n  a_b -->|go| _9'
    r = spark.createDataFrame([("A", "B", "foreign_key"), ("B", "A", "one_to_many"), ("A", "B", "foreign_key")], "source string, target string, type string")
    assert [tuple(x) for x in render.pick_relations(r).collect()] == [("B", "A", "one_to_many")]
    t = "x\n<s>\nold\n<e>\ny"
    assert one(spark, render.replace_marked(F.col("t"), F.lit("new"), "<s>", "<e>"), t=t) == "x\n<s>\nnew\n<e>\ny"
    assert one(spark, X.splice_block(F.col("t"), F.lit("b"), "<s>", "<e>"), t="plain") == "plain\n\n<s>\nb\n<e>\n"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-0{1 + i % 3}T00:00:00Z", "op": "x", "cost_usd": 1.0}) for i in range(9)))
    q = ST.sink(ST.windowed(ST.event_stream(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.exception() is None
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(r.n_events for r in rows) >= 3


def test_decorate(spark):
    from knowmill.operators import decorate

    env = [
        ("aws", {"status": "success", "action": "list_functions", "data": {"region": "eu", "functions": [{"name": "f", "runtime": "py"}, {"name": "g"}]}}, None),
        ("aws", {"status": "error", "action": "list_functions", "data": {}}, None),
        ("gcp", {"status": "success", "action": "list_topics", "data": {"topics": ["t1"]}}, None),
        ("jira", {"status": "success", "action": "jql_search", "data": {"issues": [{"key": "K-1", "status": "Open", "summary": "s"}, {"key": "K-2", "status": "Done"}, {"key": "K-3", "status": "Open"}]}}, None),
        ("confluence", {"status": "success", "action": "cql_search", "data": {"pages": [{"space_key": "A", "title": "x"}, {"space_key": "B", "title": "y"}, {"title": "z"}]}}, None),
        ("notion", {"status": "success", "action": "query_database", "data": {"database_id": "123456789", "results": [{"title": "r"}]}}, None),
        ("github", {"status": "success", "action": "get_file", "data": {"path": "package.json", "content": '{"dependencies": {"a": "1"}}'}}, None),
        ("db", {"status": "ok", "tables": [{"name": "t", "columns": [{"name": "id", "data_type": "int", "is_primary_key": True}]}]}, None),
        ("db", {"status": "ok", "tables": []}, None),
        ("aws", {"status": "success", "action": "list_buckets", "data": {"buckets": [{"name": "b"}]}}, "failed"),
    ]
    df = spark.createDataFrame([(i, c, json.dumps(e), x) for i, (c, e, x) in enumerate(env)], "i int, connector string, envelope string, error string")
    got = [r.diagram for r in decorate.decorate(df).orderBy("i").collect()]
    assert got[0].text == 'graph TB\n  region_eu("Region: eu")\n  fn_f["f (py)"]\n  fn_g["g (unknown)"]\n  region_eu --> fn_f\n  region_eu --> fn_g'
    assert got[1] is None and got[8] is None and got[9] is None
    assert got[2].text.endswith("proj_project --> topic_0")
    assert got[3].text == 'graph TB\n  root("Issues")\n  s0["Open"]\n  s1["Done"]\n  i0["K-1: s"]\n  i1["K-3"]\n  i2["K-2"]\n  root --> s0\n  root --> s1\n  s0 --> i0\n  s0 --> i1\n  s1 --> i2'
    assert got[4].text == 'graph TB\n  s0("A")\n  s1("B")\n  p0["x"]\n  p1["y"]\n  s0 --> p0\n  s1 --> p1'
    assert 'db("DB 12345678…")' in got[5].text and 'dep_0["a"]' in got[6].text and got[7].text == "erDiagram\n  t {\n    int id PK\n  }"


def test_projects(spark):
    from knowmill.operators import projects

    f = spark.createDataFrame([("pyproject.toml", "[project]\nname='p'\nversion='2'\n"), ("package.json", '{"name": "w", "engines": {"node": ">=18"}}'), ("Cargo.toml", "[bad"), ("sub/go.mod", "module x")], "path string, content string")
    r = projects.metadata(f).first()
    assert (r.name, r.version, r.language, r.runtime, r.manifests) == ("w", "2", "typescript", "node@18", ["package.json", "pyproject.toml"]) and len(r.notes) == 1
    runs = spark.createDataFrame([(1, "a", "running"), (1, "b", "passed")], "issue int, arm string, status string")
    assert {r.status for r in projects.loaded_runs(runs).collect()} == {"pending", "passed"}
    assert projects.set_runs(runs, spark.createDataFrame([(1, "a", "ran"), (2, "a", "pending")], runs.schema)).count() == 3
    with pytest.raises(Exception):  # noqa: B017
        projects.set_runs(runs, spark.createDataFrame([(1, "b", "pending")], runs.schema)).collect()


def test_links(spark):
    from knowmill.operators import links

    p = spark.createDataFrame([("a/x.md", "see [old](../b/old.md#s) and [y](y.md)\n```\n[old](../b/old.md)\n```\nend [old](../b/old.md)"), ("b/z.md", "none")], "path string, content string")
    m = spark.createDataFrame([("b/old.md", "_archive/b/old.md")], "from string, to string")
    got = {r.path: (r.content, r.n_rewritten) for r in links.rewrite_inbound(p, m).collect()}
    assert got["a/x.md"] == ("see [old (archived)](../_archive/b/old.md#s) and [y](y.md)\n```\n[old](../b/old.md)\n```\nend [old (archived)](../_archive/b/old.md)", 2)
    assert got["b/z.md"] == ("none", 0)
    there = links.rewrite_inbound(p, m).select("path", "content")
    assert {r.path: r.content for r in links.rewrite_inbound(there, m, back=True).collect()} == {r.path: r.content for r in p.collect()}
    assert links.rewrite_inbound(p, m, "remove").where("path = 'a/x.md'").first().content.startswith("see old and [y]")
    f = spark.createDataFrame([("r/b/x",), ("r/a",)], "path string")
    assert {r.folder: r.signature for r in links.folder_signatures(f).collect()} == {"": "D r", "r": "F a\nD b", "r/b": "F x"}
    t = "# T\n```\n## Install\n```\n## Usage\nx"
    assert one(spark, links.insert_markers(F.col("t"), "P", "<s>", "<e>"), t=t) == "# T\n```\n## Install\n```\n## Usage\n\n<s>\nP\n<e>\nx"
    assert one(spark, links.insert_markers(F.col("t"), "P", "<s>", "<e>"), t="plain") == "plain\n<s>\nP\n<e>\n"
    assert one(spark, links.overlay(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2))), t=1) == {"a": 1, "b": 2}
    assert one(spark, links.audience(F.col("f"), F.lit("")), f="api") == "integrator"


def test_service_pages(spark):
    from knowmill.operators import service_pages

    s = spark.createDataFrame([(0, "a", "service"), (1, "b", "service"), (2, "l", "library")], "ord int, id string, kind string")
    e = spark.createDataFrame([("a", "b", "calls", "GET /"), ("b", "a", "calls", "GET /x"), ("a", "l", "depends_on", "lib:l"), ("b", "l", "depends_on", "lib:l")], "from_service string, to_service string, kind string, detail string")
    got = {r.slug: r.body for r in service_pages.pages(s, e).collect()}
    assert set(got) == {"service-map", "client-registry", "service-dependencies", "shared-libraries"} and "- cycle: a, b" in got["service-dependencies"]
    old = spark.createDataFrame([("service-map", "mine"), ("gone", service_pages.MARK)], "slug string, body string")
    new = {r.slug: r.body for r in service_pages.merged(old, service_pages.pages(s, e)).collect()}
    assert new["service-map"] == "mine" and "gone" not in new and service_pages.pruned(old).count() == 1
    assert service_pages.topology(s, e).first().text.count("-->") == 2


DISCOVERED = {
    "a/pom.xml": "<project><parent><artifactId>p</artifactId></parent><groupId>x.shared</groupId><artifactId>a-lib</artifactId></project>",
    "web/package.json": '{"dependencies": {"react": "1"}}',
    "feed/project/pom.xml": "<project><artifactId>feeder</artifactId><dependencies><dependency><artifactId>a-lib</artifactId></dependency></dependencies></project>",
    "feed/src/main/resources/application.yml": "spring:\n  security:\n    oauth2:\n      resourceserver:\n        jwt:\n          issuer-uri: https://idp/x\n",
    "libs/one/go.mod": "",
    "core-shared/pom.xml": "<packaging>pom</packaging><modules><module>m</module></modules>",
    "core-shared/m/pom.xml": "<artifactId>m</artifactId>",
    "two/app/go.mod": "",
    "two/server/go.mod": "",
    "mod/x/Cargo.toml": "",
    ".hidden/go.mod": "",
}


def test_service_discovery_and_inventory(spark):
    f = spark.createDataFrame(list(DISCOVERED.items()), "path string, content string")
    g = spark.createDataFrame([('[submodule "x"]\n\tpath = mod/x\n',)], "content string")
    got = {r.root: (r.id, r.kind, r.identity_source, r.language) for r in extract.services(f, g).collect()}
    assert got == {"a": ("a", "library", "dir-name", "java"), "web": ("web", "frontend", "dir-name", "typescript"), "feed": ("feed", "service", "dir-name", "java"), "libs/one": ("one", "service", "dir-name", "go"), "core-shared/m": ("m", "library", "dir-name", "java"), "mod/x": ("x", "service", "submodule", "rust")}
    inv = extract.inventory(f, g)
    edges = {(r.from_service, r.to_service, r.kind) for r in services.service_graph(inv).collect()}
    assert edges == {("feed", "a", "depends_on"), ("feed", "auth:idp", "auth_via")}


def test_value_stats_of_groups(spark):
    import random
    import statistics

    rng = random.Random(3)
    rows = [(k, None if rng.random() < 0.1 else float(rng.randint(0, 30))) for k in ("a", "b", None) for _ in range(200)] + [("none", None)]
    got = {r.k: r for r in E.value_stats(spark.createDataFrame(rows, "k string, v double"), "v", "k").collect()}
    for k in ("a", "b", None):
        v = sorted(x for y, x in rows if y == k and x is not None)
        assert (got[k].n, got[k].p50, got[k].p95) == (len(v), statistics.median(v), v[min(int(len(v) * 0.95), len(v) - 1)]) and abs(got[k]["mean"] - statistics.mean(v)) < 1e-9
    assert got["none"].n == 0 and got["none"].p50 is None


def test_cycles_of_long_rings(spark):
    ring = [(i, f"n{i:03}", f"n{(i + 1) % 200:03}") for i in range(200)]
    e = spark.createDataFrame(ring, "ord bigint, from string, to string")
    rows = page_graph.cyclic_clusters(e).collect()
    assert len({tuple(r) for r in rows}) >= 1 and "n199" in str(rows) and "n000" in str(rows)


def test_state_versions_and_grants(spark, tmp_path):
    state = sinks.record_unit(sinks.read_state(spark, str(tmp_path / "s")), "atlas", "u1")
    assert sinks.write_state(state, str(tmp_path / "s")) == 1
    assert [(r.op, list(r.done)) for r in sinks.read_state(spark, str(tmp_path / "s")).collect()] == [("atlas", ["u1"])]
    assert sinks.cache_version(spark, str(tmp_path / "c")) == "0"
    sinks.set_cache_version(spark, str(tmp_path / "c"), "7")
    assert sinks.cache_version(spark, str(tmp_path / "c")) == "7"
    cache = spark.createDataFrame([("k", "1"), ("k", "2"), ("j", "1")], "key string, version string")
    assert sinks.without_entries(cache, "k", "1").count() == 2 and sinks.without_entries(cache, version="1").count() == 1 and sinks.without_entries(cache).count() == 0
    p = gate.Policy("grant_required")
    assert p.check("SELECT 1") == ("deny", "No active read grant")
    p.grant_from({"grant_duration_hours": 1}, "read")
    assert p.check("SELECT 1") == ("allow", "active read grant")
    assert gate.DRIVERS["mssql"] == "jdbc:sqlserver" and len(gate.DRIVERS) == 9
    columns = gate.key_schema({"KeySchema": [{"AttributeName": "id"}], "AttributeDefinitions": [{"AttributeName": "at", "AttributeType": "N"}, {"AttributeName": "id", "AttributeType": "S"}]})
    assert [(c["name"], c["data_type"], c["is_primary_key"]) for c in columns] == [("id", "string", True), ("at", "number", False)]
    late = gate.QueryGate(spark).execute("SELECT count(*) FROM range(3000000000000) WHERE id % 7 = 3 AND hash(id) = 1", timeout=2)
    assert late["status"] == "timeout"
    (tmp_path / "r" / ".git").mkdir(parents=True)
    (tmp_path / "r" / "a").mkdir()
    assert FS.repo_root(str(tmp_path / "r" / "a")) == str(tmp_path / "r")
    plan = extract.symbol_plan(spark, extract.load_profiles("orm", only=["jpa"])).collect()
    assert {r.kind for r in plan} == {"entity_class", "table_name", "column", "relationship"} and len(plan) == 7


def test_lint_of_a_page(spark):
    pages = spark.createDataFrame([("a.md", "[x](gone.md)", "", '{"title": "t"}'), ("b.md", "", "", None)], "path string, content string, body string, fm string")
    edges = spark.createDataFrame([(0, "a.md", "b.md", "supports", "EXTRACTED", '{"from": "a.md"}')], "ord bigint, from string, to string, type string, provenance string, raw string")
    refs = spark.createDataFrame([("a.md", "f", "0")], "page string, file string, content_hash string")
    files = spark.createDataFrame([("g", "x")], "path string, content string")
    found = {(r.category, r.message) for r in lint.validate(pages, edges, "2024-01-01", "a.md", refs=refs, files=files, inventory=[files.select(F.col("path").alias("file"))]).collect()}
    assert ("broken_links", "Link to gone.md not found") in found and ("code_ref_drift", "Referenced file f not found") in found and ("references_inventory", "Reference f is not in the inventory") in found
    assert {r.category for r in lint.lint(pages, edges, "2024-01-01").collect()} >= {"provenance", "missing_frontmatter"}
