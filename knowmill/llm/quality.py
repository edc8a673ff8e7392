"""Quality rules with thresholds that adapt to each language and source.

The measures are integers, so every threshold is exact and repeatable. A sketch of a group is a histogram over
logarithmic buckets with 32 steps an octave (a quantile is off by 1/32 of its value at most). Sketches merge by adding
counts: tasks merge into groups, sources into languages and languages into the corpus, in one aggregation each. A group
of fewer than ``min_rows`` documents takes the thresholds of its language, or else those of the corpus.

A document fails a measure if it lies beyond q75 + fence * max(q75 - q25, least) of its group, or, for the mean word
length, below q25 - fence * max(q75 - q25, least) too. The group's own quantiles set both place and width; ``least`` is
what the measure can resolve at all (RESOLUTION), so that a group whose documents agree to the last character does not
reject the smallest possible deviation.

Only built-in expressions are used. Each text is read and measured once; the counters are written to the shared folder
beside the columns that the caller needs, and sketches and verdicts come from there. Only counters of sketches are
shuffled. The thresholds, a row for each language and source, are broadcast if counted to be at most SMALL_GROUPS;
otherwise they are copied SALTS times and joined by group and salt, so that no group is one task.

Null text: no words, base_failed. Null language or source: a group of its own, apart from that of the empty string.
Empty table: empty result. Repeated rows each get the same verdict. Other columns, whatever their names, are returned as
they are by ``filter_quality``; names that begin with ``_quality`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowmill.llm.common import cut, table, written

#: Measure: the least width of its fence, about its smallest step. A character in a document of MIN_WORDS words of about 5
#: characters is 4 per mille; a 3-word window that is found twice, of these words, 100; a bucket is a 32nd of its value
#: wide, of all lines or of words of about 5 characters.
RESOLUTION = {"symbols": 4, "marks": 4, "capitals": 4, "dup_lines": 32, "repeats": 100, "word_length": 16}
FENCE = 3
MIN_ROWS = 40
MIN_WORDS = 50
#: Thresholds that may be broadcast, and copies of them beyond that.
SMALL_GROUPS, SALTS = 50_000, 64
GAP = r"[ \t\n\x0B\f\r]+"
WORD = r"[^ \t\n\x0B\f\r]+"


def bucket(x: Column) -> Column:
    """Bucket of a non-negative integer: itself below 64, then 32 buckets an octave."""
    e = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return (32 * e + F.call_function("shiftright", x, e)).cast("int")


def bucket_low(b: Column) -> Column:
    e = F.greatest(F.floor(b / 32).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (b - 32 * e).cast("bigint"), e)


def words(text: Column) -> Column:
    """Words of a text; no text or no word: an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, "")).cast("bigint")


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return F.aggregate(F.array(lines), F.lit(0).cast("bigint"), lambda acc, a: acc + F.size(a) - F.size(F.array_distinct(a)))


def let(x: Column, f) -> Column:
    """f(x) with x computed once for each row."""
    return F.element_at(F.transform(F.array(x), f), 1)


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more in an array of words.

    Windows are sorted with their positions; equal neighbours mark positions, and the marked windows are measured
    without counting an overlap twice. n log n in the length of the text.
    """

    def marked(keys: Column) -> Column:
        def cover(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        def hits(heads: Column) -> Column:
            def pick(x: Column, i: Column) -> Column:
                same = (x == F.get(heads, i + 1)) | (x == F.get(heads, i - 1))
                return F.when(same, F.substring_index(F.get(keys, i), "\t", -1).cast("int"))

            return F.sort_array(F.filter(F.transform(heads, pick), lambda x: x.isNotNull()))

        return let(let(F.transform(keys, lambda x: F.substring_index(x, "\t", 1)), hits), cover)

    def windows(a: Column) -> Column:
        return F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(a, i + 1), F.get(a, i + 2)))

    def count(t: Column) -> Column:
        keys = F.sort_array(F.transform(t, lambda x, i: F.concat_ws("\t", x, i.cast("string"))))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("bigint")).otherwise(let(keys, marked))

    return let(let(w, windows), count)


def counters(text: Column) -> dict[str, Column]:
    full = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.regexp_count(full, F.lit(WORD)).cast("bigint"),
        "word_chars": word_chars(text),
        "n_symbols": F.regexp_count(full, F.lit("[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": dup_lines(text),
        "n_repeat_words": repeat_words(words(text)),
        "n_marks": F.regexp_count(full, F.lit("[!-/:-@\\[-`{-~]")).cast("bigint"),
        "n_capitals": F.regexp_count(full, F.lit("\\p{Lu}")).cast("bigint"),
        "n_lines": F.regexp_count(full, F.lit("(?m)^[^\n]*[^ \t\n\x0B\f\r]")).cast("bigint"),
    }


def measures(c: dict[str, Column]) -> dict[str, Column]:
    per = lambda a, b, k: F.call_function("div", k * a, F.greatest(b, F.lit(1)))
    return {
        "symbols": per(c["n_symbols"], c["word_chars"], 1000),
        "marks": per(c["n_marks"], c["word_chars"], 1000),
        "capitals": per(c["n_capitals"], c["word_chars"], 1000),
        "dup_lines": per(c["n_dup_lines"], c["n_lines"], 1000),
        "repeats": per(c["n_repeat_words"], c["n_words"], 1000),
        "word_length": per(c["word_chars"], c["n_words"], 100),
    }


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of docs (all, unless given), the group as _quality_l and _quality_s, and the counters as
    _quality_c; computed once and written to the shared folder."""
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
    c = F.struct(*[v.alias(k) for k, v in counters(F.col(f"`{text}`")).items()])
    keep = [F.col(f"`{x}`") for x in (docs.columns if carry is None else carry)]
    return written(docs.select(*keep, group(lang).alias("_quality_l"), group(source).alias("_quality_s"), c.alias("_quality_c")), "quality")


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of all rows of ``counted`` with at least MIN_WORDS words."""
    c = {k: F.col(f"_quality_c.{k}") for k in rows.schema["_quality_c"].dataType.names}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in measures(c).items()]))
    base = rows.where(c["n_words"] >= MIN_WORDS).select(F.col("_quality_l").alias("lang"), F.col("_quality_s").alias("source"), each.alias("m"))
    return base.select("lang", "source", "m.*").groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def limits(sketches: DataFrame, *keys: str, min_rows: int = MIN_ROWS, fence: int = FENCE) -> DataFrame:
    """Keys, and a low and a high limit for each measure. A group has some hundred buckets, however many documents."""
    w = Window.partitionBy(*keys, "measure")
    run = sketches.withColumn("below", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("below") * 100 >= F.col("total") * q, F.col("bucket")))
    q = run.groupBy(*keys, "measure").agg(at(25).alias("b25"), at(75).alias("b75"), F.max("total").alias("total")).where(F.col("total") >= min_rows)
    q = q.select(*keys, "measure", bucket_low(F.col("b25")).alias("q25"), bucket_low(F.col("b75") + 1).alias("q75"))
    least = F.element_at(F.create_map(*[F.lit(x) for kv in RESOLUTION.items() for x in kv]), F.col("measure"))
    step = fence * F.greatest(F.col("q75") - F.col("q25"), least)
    q = q.select(*keys, "measure", F.struct((F.col("q25") - step).alias("lo"), (F.col("q75") + step).alias("hi")).alias("f"))
    return q.groupBy(*keys).agg(F.struct(*[F.max(F.when(F.col("measure") == k, F.col("f"))).alias(k) for k in RESOLUTION]).alias("limits"))


def thresholds(rows: DataFrame, min_rows: int = MIN_ROWS, fence: int = FENCE) -> DataFrame:
    """(lang, source, limits) for each group of the rows of ``counted``; the wider sketches are merged from the narrow ones."""
    fine = cut(sketch(rows))  # some hundred rows a group
    by_lang = merge(fine, "lang")
    whole = merge(by_lang)
    groups = fine.select("lang", "source").distinct()
    out = groups.join(limits(fine, "lang", "source", min_rows=min_rows, fence=fence).withColumnRenamed("limits", "own"), ["lang", "source"], "left")
    out = out.join(limits(by_lang, "lang", min_rows=min_rows, fence=fence).withColumnRenamed("limits", "wide"), "lang", "left")
    out = out.join(F.broadcast(limits(whole, min_rows=1, fence=fence).withColumnRenamed("limits", "all")), how="left")  # one row
    return out.select("lang", "source", F.coalesce("own", "wide", "all").alias("limits"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_rows: int = MIN_ROWS, fence: int = FENCE, carry: list[str] | None = None, small_groups: int = SMALL_GROUPS) -> DataFrame:
    """The columns ``carry`` of docs (all, unless given) and a struct ``_quality`` of counters, base_failed and kept."""
    rows = counted(docs, text, lang, source, carry)
    names = [x for x in rows.columns if not x.startswith("_quality")]
    t = cut(thresholds(rows, min_rows, fence).select(F.col("lang").alias("_quality_l"), F.col("source").alias("_quality_s"), F.col("limits").alias("_quality_t")))
    if t.count() <= small_groups:
        joined = rows.join(F.broadcast(t), ["_quality_l", "_quality_s"], "left")
    else:
        salted = t.withColumn("_quality_x", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("_quality_c", *[F.col(f"`{x}`") for x in names if dict(rows.dtypes)[x] in ("bigint", "int", "string")]), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("_quality_x", salt).join(salted, ["_quality_l", "_quality_s", "_quality_x"], "left")
    at = {k: F.col(f"_quality_c.{k}") for k in rows.schema["_quality_c"].dataType.names}
    m = measures(at)
    bad = F.coalesce(m["word_length"] < F.col("_quality_t.word_length.lo"), F.lit(False))
    for k in RESOLUTION:
        bad = bad | F.coalesce(m[k] > F.col(f"_quality_t.{k}.hi"), F.lit(False))
    failed = (at["n_words"] < MIN_WORDS) | (100 * at["n_repeat_words"] > 50 * at["n_words"])
    q = F.struct(*[v.alias(k) for k, v in at.items()], failed.alias("base_failed"), (~failed & ~bad).alias("kept"))
    return joined.select(*[F.col(f"`{x}`") for x in names], q.alias("_quality"))


def filter_quality(docs: DataFrame, **kw) -> DataFrame:
    """The documents that pass, with the columns that they came with. They are read from the written table, which stays in
    the shared folder until the run that owns it ends (common.owned)."""
    return judge(docs, **kw).where("_quality.kept").drop("_quality")


def query(spark, sf_dir: str) -> DataFrame:
    q = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), carry=["doc_id"])
    return q.select("doc_id", *[f"_quality.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def oracle() -> str:
    """The same in DuckDB: windows and lines by unnesting, quantiles from the same histogram."""
    ws = "[ \\t\\n\\x0B\\f\\r]"
    bucket_sql = lambda x: f"(32 * greatest(length(bin({x})) - 6, 0) + ({x} >> greatest(length(bin({x})) - 6, 0)))"
    low = lambda b: f"(({b} - 32 * greatest({b} // 32 - 1, 0)) << greatest({b} // 32 - 1, 0)::INT)"
    exprs = {
        "symbols": "1000 * n_symbols // greatest(word_chars, 1)",
        "marks": "1000 * n_marks // greatest(word_chars, 1)",
        "capitals": "1000 * n_capitals // greatest(word_chars, 1)",
        "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
        "repeats": "1000 * n_repeat_words // greatest(n_words, 1)",
        "word_length": "100 * word_chars // greatest(n_words, 1)",
    }
    spread = "CASE measure " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RESOLUTION.items()) + " END"

    def limit(src: str, keys: str, least: int) -> str:
        by = f"{keys}, " if keys else ""
        part = f"PARTITION BY {by}measure"
        return f"""SELECT {by}measure, {low('b25')} - {FENCE} * greatest({low('(b75 + 1)')} - {low('b25')}, {spread}) AS lo, {low('(b75 + 1)')} + {FENCE} * greatest({low('(b75 + 1)')} - {low('b25')}, {spread}) AS hi
            FROM (SELECT {by}measure, min(bucket) FILTER (below * 100 >= total * 25) AS b25, min(bucket) FILTER (below * 100 >= total * 75) AS b75, max(total) AS total
                  FROM (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS below, sum(n) OVER ({part}) AS total FROM {src}) GROUP BY {by}measure) WHERE total >= {least}"""

    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source FROM documents),
    w AS (SELECT rid, list_filter(regexp_split_to_array(t, '{ws}+'), lambda x: x <> '') AS w FROM d),
    tri AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
    rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid),
    ln AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY rid),
    f AS (SELECT d.rid, doc_id, lang, source, len(w.w)::BIGINT AS n_words, length(regexp_replace(t, '{ws}+', '', 'g'))::BIGINT AS word_chars,
                 len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(ln.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
                 len(regexp_extract_all(t, '[!-/:-@\\[-`{{-~]'))::BIGINT AS n_marks, len(regexp_extract_all(t, '\\p{{Lu}}'))::BIGINT AS n_capitals, coalesce(ln.n, 0)::BIGINT AS n_lines
          FROM d JOIN w USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
    m AS ({' UNION ALL '.join(f"SELECT rid, lang, source, n_words, '{k}' AS measure, {e} AS v FROM f" for k, e in exprs.items())}),
    s AS (SELECT lang, source, measure, {bucket_sql('v')} AS bucket, count(*) AS n FROM m WHERE n_words >= {MIN_WORDS} GROUP BY ALL),
    s1 AS (SELECT lang, measure, bucket, sum(n) AS n FROM s GROUP BY ALL), s0 AS (SELECT measure, bucket, sum(n) AS n FROM s GROUP BY ALL),
    l2 AS ({limit('s', 'lang, source', MIN_ROWS)}), l1 AS ({limit('s1', 'lang', MIN_ROWS)}), l0 AS ({limit('s0', '', 1)}),
    g AS (SELECT DISTINCT lang, source, measure FROM s),
    lim AS (SELECT lang, source, measure, coalesce(l2.lo, l1.lo, l0.lo) AS lo, coalesce(l2.hi, l1.hi, l0.hi) AS hi FROM g LEFT JOIN l2 USING (lang, source, measure) LEFT JOIN l1 USING (lang, measure) LEFT JOIN l0 USING (measure)),
    bad AS (SELECT rid, bool_or(coalesce(v > hi OR (measure = 'word_length' AND v < lo), FALSE)) AS bad FROM m LEFT JOIN lim USING (lang, source, measure) GROUP BY rid),
    o AS (SELECT f.*, bad.bad, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f JOIN bad USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT bad) AS kept FROM o"""
