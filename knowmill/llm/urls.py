"""URL verdicts: fixed host and path rules first, then association rules mined from labels.

A URL becomes a basket of tokens (scheme, host labels, path segments with digits as one, file type, query keys and
key=value pairs, fragment). Labelled pages add the token BAD if their label is toxic or of no quality. FP-growth mines the
frequent baskets. A rule that concludes BAD stays if at least MIN_ROWS bad pages and MIN_SUPPORT of all labelled pages
support it, if MIN_CONFIDENCE of the pages that it fits are bad and this is MIN_LIFT times the share of bad pages, and if
no rule with fewer tokens implies it. All rules that pass stay, however many. They are matched through an inverted index
from each rule's rarest token, so a page looks only at rules that share such a token with it: up to SMALL_RULES the index
is a literal, beyond it a table that is joined with the tokens of the distinct URLs. Labels carry ids of ``documents``;
the page of the same id takes the label.

Tokens of one URL template occur in the same labelled pages, and all their subsets would be rules. So frequent tokens that
occur in exactly the same pages are one item, named by the least of them; a page has an item if it has any of its tokens,
which is what all those rules together say. What is left to FP-growth are items that differ somewhere; the number of
frequent sets of these is the size of its result.

Everything is built-in expressions and Spark's own FP-growth. Null URLs or URLs without "://": empty host and path, no tokens but of what is there, no
fixed rule. Null or contradicting labels: bad if any row says so. Empty tables: no mined rules, or an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.llm.common import cut

#: (rule, verdict): a host, which stands for its subdomains too, and the start of a path. The longest rule wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BAD = "label:bad"
MIN_ROWS = 20
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.5
#: Rules that the driver holds, and URLs that may be broadcast.
SMALL_RULES, SMALL_ROWS = 1000, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    """What follows the first "://"; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    full, host, path = F.coalesce(url, F.lit("")), host_of(url), path_of(url)
    tag = lambda prefix, x: F.when(x != "", F.concat(F.lit(prefix), x))
    segments = F.split(F.regexp_replace(path, "[0-9]+", "0"), "/")
    query = F.regexp_extract(full, "[?]([^#]*)", 1)
    pairs = F.split(query, "&")
    keys = F.transform(pairs, lambda x: F.regexp_extract(x, "^([^=]*)", 1))
    one = F.array(
        tag("scheme:", F.translate(F.regexp_extract(full, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1), UPPER, LOWER)),
        tag("type:", F.regexp_extract(path, "[.]([A-Za-z0-9]{1,8})$", 1)),
        F.when(path.rlike(".+/$"), F.lit("folder")),
        F.when(full.contains("#"), F.lit("fragment")),
    )
    many = F.concat(F.transform(F.split(host, "[.]"), lambda x: tag("host:", x)), F.transform(segments, lambda x: tag("path:", x)), F.transform(keys, lambda x: tag("query:", x)), F.transform(pairs, lambda x: F.when(x.contains("="), F.concat(F.lit("pair:"), x))))
    return F.array_distinct(F.filter(F.concat(one, many), lambda x: x.isNotNull()))


def alike(baskets: DataFrame, least: float) -> DataFrame:
    """(token, item): frequent tokens that share the item of their baskets; of baskets (row, items)."""
    one = baskets.select("row", F.explode("items").alias("token")).where(F.col("token") != BAD)
    sign = F.sum(F.xxhash64("row").cast("decimal(38,0)"))
    marks = one.groupBy("token").agg(F.count(F.lit(1)).alias("n"), sign.alias("sign"), F.min("row").alias("first")).where(F.col("n") >= least)
    item = marks.groupBy("n", "sign", "first").agg(F.min("token").alias("item"))
    return marks.join(item, ["n", "sign", "first"]).select("token", "item")


def mine(labelled: DataFrame, min_rows: int = MIN_ROWS, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """(key, rule, tokens): the irredundant antecedents of rules that conclude BAD, sorted, of each the item that the fewest
    rules share, and the tokens of each item in the order of the rule; from rows of (url, bad)."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    given = F.when(F.col("bad"), F.concat(tokens(F.col("url")), F.array(F.lit(BAD)))).otherwise(tokens(F.col("url")))
    rows = cut(labelled.select(F.monotonically_increasing_id().alias("row"), given.alias("items")))
    count = rows.count()
    support = max(min_support, min_rows / max(count, 1))
    if support > 1:  # fewer rows than a rule needs
        return spark.createDataFrame([], "key string, rule array<string>, tokens array<array<string>>")
    same = cut(alike(rows, support * count))
    bad = rows.where(F.array_contains("items", BAD)).select("row", F.lit(BAD).alias("item"))
    whole = rows.select("row", F.explode("items").alias("token")).join(same, "token").select("row", "item").unionByName(bad)
    # rows without a frequent token count for the support and the lift too
    baskets = cut(rows.select("row").join(whole.groupBy("row").agg(F.collect_set("item").alias("items")), "row", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD) & (F.col("lift") >= min_lift))
    rules = cut(found.select(F.array_sort("antecedent").alias("rule")))
    every = rules.select("rule", F.explode("rule").alias("key"))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keyed = every.join(shared, "key").groupBy("rule").agg(F.min(F.struct("n", "key"))["key"].alias("key"))
    wider = every.join(keyed.withColumnRenamed("rule", "less"), "key").where((F.size("less") < F.size("rule")) & (F.size(F.array_except("less", "rule")) == 0))
    kept = keyed.join(wider.select("rule").distinct(), "rule", "left_anti")
    members = same.groupBy("item").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    spelled = kept.select("key", "rule", F.explode("rule").alias("item")).join(members, "item").groupBy("key", "rule").agg(F.array_sort(F.collect_list(F.struct("item", "tokens"))).alias("x"))
    return cut(spelled.select("key", "rule", F.transform("x", lambda x: x["tokens"]).alias("tokens")))


def matches(found: Column, rules: list[tuple[str, list[str], list[list[str]]]]) -> Column:
    """Whether one of the rules (key, rule, tokens) holds for a URL's tokens, by inverted index from the rules' keys."""
    index: dict[str, list[list[str]]] = {}
    item: dict[str, str] = {}
    for key, rule, spelled in sorted(rules):
        index.setdefault(key, []).append(rule)
        item.update({t: i for i, ts in zip(rule, spelled, strict=True) for t in ts})
    if not index:
        return F.lit(False)
    table = F.create_map(*[x for k, rs in index.items() for x in (F.lit(k), F.array(*[F.array(*[F.lit(t) for t in r]) for r in rs]))])
    names = F.create_map(*[F.lit(x) for pair in item.items() for x in pair])
    items = F.transform(found, lambda t: F.element_at(names, t))
    holds = lambda r: F.size(F.array_except(r, items)) == 0
    return F.exists(items, lambda t: F.coalesce(F.exists(F.element_at(table, t), holds), F.lit(False)))


def matching(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct values of the column url for which one of the rules (key, rule, tokens) holds, by joins with the index."""
    named = rules.select(F.explode(F.arrays_zip("rule", "tokens")).alias("x")).select(F.col("x.rule").alias("item"), F.explode("x.tokens").alias("token")).distinct()
    one = urls.select("url").distinct().select("url", F.explode(tokens(F.col("url"))).alias("token"))
    items = one.join(named, "token").groupBy("url").agg(F.collect_set("item").alias("items"))
    tried = items.select("url", "items", F.explode("items").alias("key")).join(rules.select("key", "rule"), "key")
    return tried.where(F.size(F.array_except("rule", "items")) == 0).select("url").distinct()


def fixed(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def judge(pages: DataFrame, labels: DataFrame | None = None, page_id: str = "page_id", url: str = "url", small_rules: int = SMALL_RULES, **limits) -> DataFrame:
    """pages and a struct ``_url``: host, path, rule, verdict. Names that begin with ``_url`` are reserved."""
    u = F.col(f"`{url}`")
    out, bad_url = pages, F.lit(False)
    if labels is not None:
        bad = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)).alias("bad"))
        rows = pages.select(F.col(f"`{page_id}`").alias("id"), u.alias("url")).join(bad, "id").select("url", "bad")
        rules = mine(rows, **limits)
        if rules.count() <= small_rules:
            bad_url = matches(tokens(u), [(r.key, list(r.rule), [list(t) for t in r.tokens]) for r in rules.collect()])
        else:
            hit = cut(matching(pages.select(u.alias("url")), rules).select(F.col("url").alias("_url_u"), F.lit(True).alias("_url_bad")))
            side = F.broadcast(hit) if hit.count() <= SMALL_ROWS else hit
            out, bad_url = pages.join(side, u.eqNullSafe(F.col("_url_u")), "left"), F.coalesce(F.col("_url_bad"), F.lit(False))
    host, path = host_of(u), path_of(u)
    rule = fixed(host, path)
    verdict = F.coalesce(rule["verdict"], F.when(bad_url, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], F.struct(host.alias("host"), path.alias("path"), rule["rule"].alias("rule"), verdict.alias("verdict")).alias("_url"))


def query(spark, sf_dir: str) -> DataFrame:
    from knowmill.llm.common import table

    got = judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))
    return got.select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict")


def oracle() -> str:
    """Hosts, paths and fixed rules. Labels of the given tables do not depend on the pages' addresses, so no rule is mined
    from them and every other verdict is allow; the tests plant a relation in the whole tables."""
    fits = lambda rule: (lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}'))")(*rule.split("/", 1))
    by_length = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    pick = lambda k: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[k]}'" for r in by_length) + " END"
    return f"""
    WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
    SELECT page_id, host, path, {pick(0)} AS rule, coalesce({pick(1)}, 'allow') AS verdict FROM h"""
