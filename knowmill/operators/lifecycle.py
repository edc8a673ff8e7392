"""Operators over the life of pages: stale sources, existence, archives, caches, gaps, tickets and runs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowmill.functions.paths import REMOTE_SCHEMES, ancestors, has_prefix, topic_of


def match_pages(files: DataFrame, index: DataFrame) -> DataFrame:
    """(path, page): the first page (by ord) a source of which is the file or a folder above it. Ancestors of the file make
    the prefix join a join by key."""
    src = index.select("page", "ord", F.explode("sources").alias("s")).select("page", "ord", F.regexp_replace("s", "/$", "").alias("key"))
    return files.select("path", F.explode(ancestors("path")).alias("key")).join(src, "key").groupBy("path").agg(F.min_by("page", "ord").alias("page"))


def match_topic(path, topics: DataFrame | list[str]) -> Column:
    """The first topic that is a component of the path."""
    parts = F.split(path, "/")
    return F.get(F.filter(F.array(*[F.lit(t) for t in topics]), lambda t: F.array_contains(parts, t)), 0)


def classify_changes(files: DataFrame, index: DataFrame, topics: list[str]) -> DataFrame:
    """(path, class, page, topic): stale wins over uncovered, the rest is unrelated."""
    j = files.select("path").distinct().join(match_pages(files, index), "path", "left").withColumn("topic", match_topic(F.col("path"), topics) if topics else F.lit(None).cast("string"))
    kind = F.when(F.col("page").isNotNull(), "stale").when(F.col("topic").isNotNull(), "uncovered").otherwise("unrelated")
    return j.select("path", kind.alias("class"), "page", F.when(F.col("page").isNull(), F.col("topic")).alias("topic"))


def source_existence(pages: DataFrame, files: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per page (page, sources): local sources, those missing, their share and a status."""
    s = pages.select("page", F.explode_outer("sources").alias("path")).where(F.col("path").isNotNull() & ~has_prefix("path", REMOTE_SCHEMES))
    j = s.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    n = j.groupBy("page").agg(F.count(F.lit(1)).alias("n_local"), F.count_if(F.col("there").isNull()).alias("n_missing"))
    out = pages.select("page").join(n, "page", "left").select("page", F.coalesce("n_local", F.lit(0)).alias("n_local"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"))
    ratio = F.when(F.col("n_local") > 0, F.col("n_missing") / F.col("n_local")).otherwise(0.0)
    status = F.when(F.col("ratio") == 0, "live").when(F.col("ratio") == 1, "orphan").when(F.col("ratio") >= threshold, "candidate").otherwise("live")
    return out.withColumn("ratio", ratio).withColumn("status", status)


def sweep(existence: DataFrame, autonomy: str = "balanced") -> DataFrame:
    """What happens to each page: orphans by autonomy, candidates are named."""
    decide = {"conservative": "reported", "balanced": "pending", "autonomous": "archived", "auto": "archived"}[autonomy]
    return existence.select("page", "status", F.when(F.col("status") == "orphan", decide).when(F.col("status") == "candidate", "candidate").otherwise("kept").alias("action"))


def archive_index(journal: DataFrame, files: DataFrame) -> DataFrame:
    """Archive events whose file is there still, by month, newest first."""
    live = journal.where(F.col("op") == "archive").join(files.select(F.col("path").alias("to")), "to", "left_semi")
    return live.select(F.substring("ts", 1, 7).alias("month"), "ts", "from", "to", "reason").orderBy(F.desc("month"), F.desc("ts"), "to")


def cached(entries: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Plan entries (id, sources as hashes) all of whose sources the cache (hash, version) has; none if there are none."""
    s = entries.select("id", F.explode_outer("sources").alias("hash"))
    j = s.join(cache.where(F.col("version") == version).select("hash").distinct().withColumn("hit", F.lit(True)), "hash", "left")
    return j.groupBy("id").agg((F.bool_and(F.coalesce("hit", F.lit(False))) & (F.count("hash") > 0)).alias("cached"))


def cache_lookup(keys: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """keys (hash) and the metadata of their entry, if it has the current version."""
    return keys.join(cache.where(F.col("version") == version).select("hash", "metadata"), "hash", "left")


def upsert(cache: DataFrame, new: DataFrame, key: str = "hash", order: str = "stored_at") -> DataFrame:
    """The latest row of each key."""
    both = cache.unionByName(new)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def gaps(topics: DataFrame, facets: DataFrame, pages: DataFrame) -> DataFrame:
    """Topic and facet pairs without a page. Both lists are plan settings; the facets go into an array, so no rows are crossed."""
    all_ = facets.agg(F.collect_set("facet").alias("f"))
    grid = topics.join(F.broadcast(all_), how="left").select("topic", F.explode("f").alias("facet"))  # one row
    return grid.join(pages.select("topic", "facet").distinct(), ["topic", "facet"], "left_anti")


def manifest(entities: DataFrame, endpoints: DataFrame, topics: list[str]) -> DataFrame:
    """Files of entities (data-model) and endpoints (api) by the topic of their path."""
    f = entities.select(F.lit("data-model").alias("facet"), F.col("source_file").alias("file")).union(endpoints.select(F.lit("api"), "file"))
    return f.withColumn("topic", topic_of("file")).where(F.col("topic").isin(*topics)).groupBy("topic").pivot("facet", ["api", "data-model"]).agg(F.array_sort(F.collect_set("file")))


#: Pages of one source and title that are compared at once.
CELL = 1000


def duplicate_diagrams(pages: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs of pages (page, sources, titles) that share a source and a diagram title; joined on both keys at once.

    The pairs of a source and title grow with the square of its pages. Its pages are dealt into blocks of about ``cell``, and a task
    holds two blocks at a time; pairs are not shuffled or gathered, each is told where its first source and title meet."""
    k = pages.where("page is not null").select("page", F.explode("sources").alias("source"), "titles").select("page", "source", F.explode("titles").alias("title"))
    keys = k.where("source is not null and title is not null").groupBy("page").agg(F.collect_set(F.struct("source", "title")).alias("keys"))
    each = keys.select("page", "keys", F.explode("keys").alias("key"))
    large = each.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("n")).where("n > 1")
    n = F.coalesce("n", F.lit(1))
    each = each.join(large, "key", "left").select("page", "keys", "key", n.alias("n"), F.pmod(F.xxhash64("page"), n).cast("int").alias("k"))
    a = each.select("key", F.col("page").alias("x"), F.col("keys").alias("of_x"), F.col("k").alias("i"), F.explode(F.sequence("k", F.col("n") - 1)).alias("j"))
    b = each.select("key", F.col("page").alias("y"), F.col("keys").alias("of_y"), F.col("k").alias("j"), F.explode(F.sequence(F.lit(0), "k")).alias("i"))
    shared = F.array_intersect("of_x", "of_y")
    first = (F.size("of_x") == 1) | (F.size("of_y") == 1) | (F.col("key") == F.array_min(shared))
    pairs = a.join(b.hint("merge"), ["key", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))) & first)
    of = lambda part: F.array_sort(F.array_distinct(F.transform(shared, lambda s: s[part])))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), of("source").alias("sources"), of("title").alias("titles"))


def wiki_state(pages: DataFrame, events: DataFrame, least: int = 3) -> DataFrame:
    p = pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.coalesce("atlas_run_id", F.lit("")) != "").alias("atlas"))
    e = events.agg(F.coalesce(F.bool_or(F.col("op") == "atlas"), F.lit(False)).alias("ran"))
    one = p.join(F.broadcast(e), how="left")  # one row each
    return one.select("pages", "atlas", "ran", F.when((F.col("atlas") >= least) & F.col("ran"), "existing").when((F.col("pages") > 0) & ~F.col("ran"), "hybrid").otherwise("fresh").alias("state"))


def eligibility(body_length: Column, is_bot: Column, merged_at: Column, floor: str, changed: Column, n_test: Column, n_src: Column, n_run: Column, excluded: Column) -> Column:
    """The first reason against a ticket; "ok" if there is none."""
    return (
        F.when(is_bot, "bot-author")
        .when(body_length < 200, "thin-body")
        .when(merged_at < F.lit(floor).cast("timestamp"), "before-ticket-after")
        .when(changed >= 400, "too-large")
        .when(n_test == 0, "no-test-changes")
        .when(n_src == 0, "no-source-changes")
        .when(n_run == 0, "no-runnable-tests")
        .when(excluded, "excluded-test-paths")
        .otherwise("ok")
    )


def split_files(files: DataFrame, test_patterns: list[str]) -> DataFrame:
    """Per ticket: test and source files."""
    from knowmill.functions.paths import matches_any

    t = matches_any("path", test_patterns)
    return files.groupBy("number").agg(F.array_sort(F.collect_list(F.when(t, F.col("path")))).alias("test"), F.array_sort(F.collect_list(F.when(~t, F.col("path")))).alias("src"), F.sum(F.col("additions") + F.col("deletions")).alias("changed"))


def session_class(result: Column, exit_code: Column, stderr: Column) -> Column:
    low = F.lower(F.concat_ws(" ", F.coalesce(result, F.lit("")), F.coalesce(stderr, F.lit(""))))
    bad = F.coalesce(F.get_json_object(result, "$.is_error") == "true", F.lit(False))
    return F.when((bad | (exit_code != 0)) & low.rlike("rate.?limit|usage limit|429|overloaded"), "rate-limited").when(bad | (exit_code != 0), "error").otherwise("ok")


def grade(exit_code: Column) -> Column:
    return F.when(exit_code.isin(0, 5), "pass").when(exit_code.isin(10, 20), "fail").otherwise(F.raise_error(F.concat(F.lit("unexpected exit code "), exit_code.cast("string"))))


def arm_report(runs: DataFrame) -> DataFrame:
    """Per arm: graded, passed, rate in percent and cost."""
    graded = F.col("status").isin("passed", "failed")
    g = runs.groupBy("arm").agg(F.count_if(graded).alias("graded"), F.count_if(F.col("status") == "passed").alias("passed"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"))
    return g.withColumn("rate", F.when(F.col("graded") > 0, F.floor(F.col("passed") * 100.0 / F.col("graded") + 0.5)).otherwise(F.lit(0)).cast("bigint"))


def next_pairs(runs: DataFrame, issues: DataFrame, batch: int) -> DataFrame:
    """Tickets with one arm run first, then at most ``batch`` fresh ones, in order."""
    done = runs.where(~F.col("status").isin("pending", "running")).groupBy("issue").agg(F.count_distinct("arm").alias("n"))
    j = issues.join(done, "issue", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    partial = j.where("n = 1").select(F.lit(0).alias("rank"), "ord", "issue")
    return partial.unionByName(j.where("n = 0").select(F.lit(1).alias("rank"), "ord", "issue").orderBy("ord").limit(batch)).orderBy("rank", "ord")


def banlist(pages: DataFrame, n: int = 50) -> DataFrame:
    """Deprecated claims that say why, latest first."""
    return pages.where((F.col("type") == "claim") & (F.col("status") == "deprecated") & (F.trim(F.coalesce("failure_reason", F.lit(""))) != "")).orderBy(F.desc("updated"), "path").limit(n).select("path", "title", "failure_reason", "updated")


def routing(pages: DataFrame, singletons: tuple[str, ...] = ()) -> DataFrame:
    """Rows by facet; of a singleton facet the page of the smallest path."""
    r = pages.where(F.col("facet").isNotNull())
    first = r.where(F.col("facet").isin(*singletons)).groupBy("facet").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in pages.columns]), "path").alias("_x")).select("_x.*")
    out = r.where(~F.col("facet").isin(*singletons)).unionByName(first) if singletons else r
    return out.orderBy("facet", F.coalesce("topic", F.lit("")), "path")


# Hosts of links, what a link names, and the words that name a fix.
HOSTS = ("https://github.com/", "http://github.com/")
LINKED, DONE, BY = ("pull", "issues", "commit"), ("fixed", "closed", "resolved"), ("by", "in", "via")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def runs(text: Column, kind: str) -> Column:
    """The text as runs of characters of a kind and runs of others."""
    other = kind[1:] if kind[0] == "^" else f"^{kind}"
    return F.regexp_extract_all(text, F.lit(f"([{kind}]+|[{other}]+)"), 1)


def at(tokens: Column, i: Column) -> Column:
    return F.coalesce(F.get(tokens, i), F.lit(""))


def small_number(token: Column) -> Column:
    """The number of at most seven digits that the token's first word is."""
    word = F.regexp_extract(token, r"^\w*", 0)
    return F.when((F.length(word) <= 7) & (F.translate(word, "0123456789", "") == ""), word.try_cast("bigint"))


def repository(token: Column) -> Column:
    """owner/name at the end of a token; "" if it does not end with one."""
    parts = F.split(token, "/")
    owner, name = F.ltrim(F.try_element_at(parts, F.lit(-2)), F.lit(".-")), F.element_at(parts, -1)
    return F.when((owner != "") & (name != ""), F.concat_ws("/", owner, name)).otherwise("")


def cut_link(token: Column) -> Column:
    """struct(text, found): a link to a change, up to a dot or comma behind what it names, within a token without spaces."""
    first = F.array_min(F.filter(F.array(*[F.instr(token, h) for h in HOSTS]), lambda x: x > 0))
    path = F.regexp_replace(F.substring(token, first, F.length(token)), "^https?://[^/]*/", "")

    def named(parts: Column) -> Column:
        """What follows the last of LINKED that has something before and something after it."""
        good = lambda x, i: x.isin(*LINKED) & (i > 0) & ((i > 1) | (F.get(parts, F.lit(0)) != "")) & ~F.coalesce(F.get(parts, i + 1).rlike("^[.,]"), F.lit(True)) & (F.length(F.array_join(F.slice(parts, i + 2, F.size(parts)), "/")) > 0)
        last = F.array_max(F.filter(F.transform(parts, lambda x, i: F.when(good(x, i), i)), lambda x: x.isNotNull()))
        return F.array_join(F.slice(parts, last + 2, F.size(parts)), "/")

    def made(rest: Column) -> Column:
        stop = F.regexp_instr(rest, F.lit("[.,]"))
        after = F.when(stop > 0, F.substring(rest, stop, F.length(rest))).otherwise("")
        found = F.substring(token, first, F.length(token) - first + 1 - F.length(after))
        return F.when(rest.isNull(), F.struct(token.alias("text"), F.lit(None).cast("string").alias("found"))).otherwise(F.struct(F.concat(F.substring(token, F.lit(1), first - 1), F.lit("[link-removed]"), after).alias("text"), found.alias("found")))

    return let(let(F.split(path, "/"), named), made)


def cut_references(tokens: Column, number: Column) -> Column:
    """Tokens of word characters, dots, slashes and hyphens, and others between them: struct(text, slug, plain) for each. A
    number behind "#" goes if it is not below the bound; so does a repository in front, with the "#"."""
    late = lambda token: F.coalesce(small_number(token) >= number, F.lit(False))

    def stem(k: Column) -> Column:
        """A token without the number that goes with a repository in front."""
        x = at(tokens, k)
        return F.when((at(tokens, k - 1) == "#") & late(x) & (repository(at(tokens, k - 2)) != ""), F.regexp_replace(x, "^[0-9]+", "")).otherwise(x)

    def made(x: Column, i: Column) -> Column:
        mark, before = at(tokens, i - 1), stem(i - 2)
        slug = (mark == "#") & (repository(before) != "")
        plain = F.when(mark == "#", ~F.substring(before, -1, 1).rlike(r"\w")).otherwise(mark.endswith("#") & (F.substring(mark, -2, 1) != "&"))
        leads = (at(tokens, i + 1) == "#") & late(at(tokens, i + 2)) & (repository(stem(i)) != "")
        hit = late(x) & (slug | plain) & ~(leads & (repository(stem(i)) == x))
        digits = F.regexp_extract(x, "^[0-9]*", 0)
        kept = F.when(hit, F.concat(F.lit("[ref-removed]"), F.substring(x, F.length(digits) + 1, F.length(x)))).otherwise(x)
        kept = F.when(leads, F.substring(kept, F.lit(1), F.length(kept) - F.length(repository(stem(i))))).when((x == "#") & late(at(tokens, i + 1)) & (repository(stem(i - 1)) != ""), "").otherwise(kept)
        return F.struct(kept.alias("text"), F.when(hit & slug, F.concat(repository(before), F.lit("#"), digits)).alias("slug"), F.when(hit & ~slug, F.concat(F.lit("#"), digits)).alias("plain"))

    return F.transform(tokens, made)


def cut_words(tokens: Column, number: Column, digits: bool = False) -> Column:
    """Words and what stands between them: struct(text, ticket, hash) for each. GH-number goes from the bound on, and so do
    hexadecimal words of 7 to 40 characters with a letter; with ``digits``, those without one too."""

    def made(x: Column, i: Column) -> Column:
        ticket = lambda k: (F.lower(at(tokens, k)) == "gh") & (at(tokens, k + 1) == "-") & F.coalesce(small_number(at(tokens, k + 2)) >= number, F.lit(False)) & (at(tokens, k + 2) != "")
        digest = F.length(x).between(7, 40) & (F.translate(F.lower(x), "0123456789abcdef", "") == "")
        if not digits:
            digest = digest & (F.translate(x, "0123456789", "") != "")
        text = F.when(ticket(i), "GH").when(ticket(i - 2), "[ref-removed]").when(digest, "[sha-removed]").otherwise(x)
        return F.struct(text.alias("text"), F.when(ticket(i - 2), F.concat(at(tokens, i - 2), F.lit("-"), x)).alias("ticket"), F.when(digest & ~ticket(i - 2), x).alias("hash"))

    return F.transform(tokens, made)


def names_fix(line: Column) -> Column:
    """Whether a word for an end stands before one for its cause."""
    pair = lambda w: F.exists(F.transform(w, lambda x, i: x.isin(*DONE) & (F.trim(F.translate(at(w, i + 1), "\t\r\f", "   ")) == "") & at(w, i + 2).isin(*BY)), lambda x: x)
    return let(runs(F.lower(line), r"\w"), pair)


def sanitize_issue(text: Column, number: Column, digits: bool = False) -> Column:
    """struct(text, redactions): links, references from the issue's own number on, hashes and lines that name a fix. Null counts
    as empty. With ``digits``, words of digits alone count as hashes too, as those of a commit may be.

    The text is cut into tokens three times, by what each rule looks at, and every rule sees a token and its neighbours only, so
    the work is linear in the text and nothing leaves the JVM. References that follow each
    other without a space are told by the two before. A rule is left out for texts that lack what every match of it has; most texts
    are not cut at all."""
    def some(conditions: list[Column]) -> Column:
        return functools.reduce(lambda a, b: a | b, conditions)

    def joined(tokens: Column, columns: tuple[str, ...], log: list[Column]) -> Column:
        return F.struct(F.array_join(tokens["text"], "").alias("text"), F.concat(*log, *[F.filter(tokens[c], lambda x: x.isNotNull()) for c in columns]).alias("log"))

    none = F.array().cast("array<string>")
    kept = lambda x, log: F.struct(x.alias("text"), log.alias("log"))
    said = F.coalesce(text, F.lit(""))
    has = lambda x, *words: some([F.contains(x, F.lit(w)) for w in words])
    linked = F.when(has(said, *HOSTS), let(F.transform(runs(said, r"^\s)"), cut_link), lambda t: joined(t, ("found",), []))).otherwise(kept(said, none))
    referred = let(linked, lambda r: F.when(has(r["text"], "#"), let(let(runs(r["text"], r"\w./-"), lambda w: cut_references(w, number)), lambda t: joined(t, ("slug", "plain"), [r["log"]]))).otherwise(r))
    worded = let(referred, lambda r: F.when(r["text"].rlike("(?i)gh-|[0-9a-f]{7}"), let(let(runs(r["text"], r"\w"), lambda w: cut_words(w, number, digits)), lambda t: joined(t, ("ticket", "hash"), [r["log"]]))).otherwise(r))

    def lined(r: Column) -> Column:
        done = lambda t: F.struct(F.array_join(F.transform(t, lambda x: F.when(x["fix"], F.lit("[line-removed]")).otherwise(x["line"])), "\n").alias("text"), F.concat(r["log"], F.transform(F.filter(t, lambda x: x["fix"]), lambda x: F.trim(x["line"]))).alias("redactions"))
        return let(F.transform(F.split(r["text"], "\n"), lambda x: F.struct(x.alias("line"), names_fix(x).alias("fix"))), done)

    ended = "(?i)" + "|".join(DONE)
    return let(worded, lambda r: F.when(r["text"].rlike(ended), lined(r)).otherwise(F.struct(r["text"].alias("text"), r["log"].alias("redactions"))))
