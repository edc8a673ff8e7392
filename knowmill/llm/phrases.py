"""Frequent phrases that hold together, by hierarchical pair naming.

A frequent word of a language gets an id. Two adjacent frequent (k-1)-grams that overlap in all but their outer words make
a k-gram: the pair of their ids, which gets an id of its own if it is frequent. The pair is also the k-gram's parents, the
phrase without its last and without its first word; so the counts of all beginnings and endings, which cuts need, come
from the parents' own, and a phrase that lies in a longer one is a parent on the way down.

Tasks turn texts into blocks of at most BLOCK positions: an array of local numbers, and what they stand for with its count
in the block, dealt into buckets by hash and packed. A bucket's task adds the counts of all blocks, names what is frequent
and answers each block with the names of what it has; so a phrase travels once for each block that has it, not for each
occurrence, and its name only if it is frequent. Buckets are as many as make BUCKET entries in each. A block that ends within
a text carries the next words as context, which are named but not counted. So no task holds more than a block, or a bucket
in which a phrase has one entry for each BLOCK positions of the corpus, however long a text or frequent a phrase is.

Pieces of text between separators hold phrases; words of different pieces are not adjacent. A candidate is a phrase of 2
to ``longest`` words found at least ``least`` times. Cut after k words, it scores floor(UNIT * a * a / (l * r)) for its own
count a and those of its parts; its lowest cut counts, ties to the smallest k. It is dropped if a longer candidate that
contains it, itself dropped or not, has at least ``share`` percent of its count. Since a phrase is no more frequent than
what it contains, only those longer by one word must be asked. Of each language the first ``top`` are returned, by score,
count and UTF-8 bytes. Products are decimals of 38 digits, exact below 10**16 occurrences.

Null or empty text: no words. Null language: ``und``, together with rows that say so. Repeated rows count each. Empty table:
empty result. Other columns are not read. Ties in the order cannot be, since phrases differ.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowmill.llm.common import cut, delete, lean, new_folder, table

LONGEST = 3
LEAST = 10
SHARE = 50
TOP = 2000
UNIT = 1_000_000
#: Positions of a block, bytes of a text that are split into words at once, and bytes of rows that leave a task at once.
BLOCK = 1 << 20
SLICE = 1 << 20
BATCH = 8 << 20
#: Entries of a bucket, and buckets at least.
BUCKET, LEAST_BUCKETS = 1 << 19, 48
MARK = b"."
#: Upper-case letters fold, separators of pieces become the mark, and a tab a space.
FOLD = bytes(MARK[0] if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: bytes, size: int):
    """Lists of a text's words and marks between pieces; a list ends where a word ends."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            while end < len(text) and text[end : end + 1] not in (b" ", MARK):
                gaps = [i for i in (text.find(b" ", end), text.find(MARK, end)) if i >= 0]
                end = min(gaps, default=len(text))
        yield text[at:end].replace(MARK, b" . ").split()
        at = end


class Names(dict):
    """Local numbers of (language, word); 0 is the mark."""

    def __init__(self):
        self.words: list[tuple[str, bytes] | None] = [None]
        self.of: dict[str, Names.Own] = {}

    class Own(dict):
        def __init__(self, names: Names, lang: str):
            self.names, self.lang = names, lang
            self[MARK] = 0

        def __missing__(self, word: bytes) -> int:
            n = self[word] = len(self.names.words)
            self.names.words.append((self.lang, word))
            return n

    def __missing__(self, lang: str) -> Names.Own:
        own = self[lang] = Names.Own(self, lang)
        return own


#: Blocks (own, codes) and their buckets' entries (at, n, a, b): local numbers, counts, and words or first ids, languages or
#: second ids.
PARTS = "block bigint, own int, codes binary, totals array<struct<lang:string,n:bigint>>, bucket bigint, at binary, n binary, a binary, b binary, langs array<string>"
_PARTS = pa.schema([("block", pa.int64()), ("own", pa.int32()), ("codes", pa.binary()), ("totals", pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))), ("bucket", pa.int64()), ("at", pa.binary()), ("n", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("langs", pa.list_(pa.string()))])
#: Answers to blocks (at, ids), and the names that a bucket gives.
NAMED = "block bigint, at binary, ids binary, names array<struct<id:bigint,left:bigint,right:bigint,lang:string,word:binary,f:bigint>>"
_NAMES = pa.list_(pa.struct([("id", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("f", pa.int64())]))
_NAMED = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("ids", pa.binary()), ("names", _NAMES)])


def flat(x: np.ndarray, kind: type) -> bytes:
    """Numbers as bytes, all first bytes first; so shuffle and file compression find the equal ones together."""
    x = np.ascontiguousarray(x, kind)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def whole(x: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def rows_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def dealt(block: int, bucket: np.ndarray, n: np.ndarray, pack) -> list[dict]:
    """A block's entries by bucket; pack gives a, b and langs of some entries."""
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
    return [dict(block=block, bucket=int(bucket[at[0]]), at=flat(at, np.int32), n=flat(n[at], np.int32), **pack(at)) for at in np.split(order, ends[:-1]) if len(at)]


def some_at_once(rows: list[dict]):
    """Batches of a bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r.values() if isinstance(v, bytes))
        if size >= BATCH:
            yield rows_of(held, _PARTS)
            held, size = [], 0
    if held:
        yield rows_of(held, _PARTS)


def word_blocks(docs: DataFrame, text: str, lang: str, context: int, buckets: int) -> DataFrame:
    """Blocks of words: local numbers by position (-1: a mark) and how many of them are the block's own; and the words."""

    def run(batches):
        part, made = TaskContext.get().partitionId() << 32, 0
        names, held, size = Names(), [], 0

        def block(codes: np.ndarray, own: int):
            nonlocal made
            used, at = np.unique(codes, return_inverse=True)
            n = np.bincount(at[:own], minlength=len(used))
            if used[0] == 0:  # the mark has no entry
                used, n, at = used[1:], n[1:], at - 1
            words = [names.words[i] for i in used]
            langs = {x: i for i, x in enumerate(dict.fromkeys(w[0] for w in words))}
            which = np.array([langs[w[0]] for w in words], np.int16)
            totals = np.bincount(which, n, len(langs))
            bucket = np.fromiter((zlib.crc32(w[1], langs_crc(w[0])) for w in words), np.int64, len(words)) % buckets
            pack = lambda some: {"a": b" ".join(words[i][1] for i in some.tolist()), "b": flat(which[some], np.int16), "langs": list(langs)}
            head = {"block": part + made, "own": own, "codes": flat(at, np.int32), "totals": [{"lang": x, "n": int(totals[i])} for x, i in langs.items()]}
            yield from some_at_once([head, *dealt(part + made, bucket, n, pack)])
            made += 1

        for b in batches:
            for i in range(0, b.num_rows, 1000):
                some = b.slice(i, 1000)
                for t, code in zip(some.column(0).cast(pa.binary()).to_pylist(), some.column(1).to_pylist(), strict=True):
                    code = "und" if code is None else code
                    own = names[code]
                    for words in tokens((t or b"").translate(FOLD), SLICE):
                        held.append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
                        size += len(words)
                        while size >= BLOCK + context:
                            codes = np.concatenate(held)
                            yield from block(codes[: BLOCK + context], BLOCK)
                            old, names = names.words, Names()
                            again = np.zeros(len(old), np.int32)
                            for j in np.unique(codes[BLOCK:]).tolist():
                                if j:
                                    again[j] = names[old[j][0]][old[j][1]]
                            held, size = [again[codes[BLOCK:]]], size - BLOCK
                            own = names[code]
                    held.append(np.zeros(1, np.int32))
                    size += 1
        if size:
            codes = np.concatenate(held)
            yield from block(codes, len(codes))

    return docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).mapInArrow(lean(run), PARTS)


@functools.lru_cache(1 << 12)
def langs_crc(lang: str) -> int:
    return zlib.crc32(lang.encode())


def named(parts: DataFrame, least: int, words: bool, answer: bool) -> DataFrame:
    """Each bucket's names of what is found at least so often, and its answers to the blocks that have it."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        col = lambda name: rows.column(name).to_pylist()
        ats = [whole(x, np.int32) for x in col("at")]
        n = np.concatenate([whole(x, np.int32) for x in col("n")])
        if words:
            text = pa.array([w for x in col("a") for w in x.split(b" ")], pa.binary()).dictionary_encode()
            langs = [x for some in col("langs") for x in some]
            known = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            a = np.concatenate([np.array([known[x] for x in some])[whole(b, np.int16)] for some, b in zip(col("langs"), col("b"), strict=True)])
            b = text.indices.to_numpy()
        else:
            a, b = (np.concatenate([whole(x, np.int64) for x in col(c)]) for c in "ab")
        order = np.lexsort((b, a))
        fresh = np.flatnonzero(np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))
        total = np.add.reduceat(n[order].astype(np.int64), fresh)
        often = np.flatnonzero(total >= least)
        one = order[fresh[often]]
        if words:  # ids follow the order of words, so that a lost task gives the same ones again
            of, word = list(known), text.dictionary
            keys = [(of[a[i]], word[int(b[i])].as_py()) for i in one.tolist()]
            by = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
            often, one = often[by], one[by]
        ids = (key[0].as_py() << 32) + np.arange(len(often))
        names = [{"id": i, "f": f, **({"lang": of[a[j]], "word": word[int(b[j])].as_py()} if words else {"left": int(a[j]), "right": int(b[j])})} for i, j, f in zip(ids.tolist(), one.tolist(), total[often].tolist(), strict=True)]
        out = [{"names": names}]
        if answer:
            of_group = np.full(len(fresh), -1, np.int64)
            of_group[often] = ids
            of_entry = np.empty(len(n), np.int64)
            of_entry[order] = np.repeat(of_group, np.diff(fresh, append=len(n)))
            start = 0
            for block, at in zip(col("block"), ats, strict=True):
                own = of_entry[start : start + len(at)]
                start += len(at)
                if (own >= 0).any():
                    out.append({"block": block, "at": flat(at[own >= 0], np.int32), "ids": flat(own[own >= 0], np.int64)})
        return pa.Table.from_batches([rows_of(out, _NAMED)])

    return parts.where("bucket is not null").select("bucket", "block", "at", "n", "a", "b", "langs").groupBy("bucket").applyInArrow(run, NAMED)


def pair_blocks(parts: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Blocks one level up: adjacent named entries as pairs of their ids."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PARTS.empty_table()
        codes, own, block = whole(left.column("codes")[0].as_py(), np.int32), left.column("own")[0].as_py(), left.column("block")[0].as_py()
        at, ids = (np.concatenate([whole(x, t) for x in right.column(c).to_pylist()]) for c, t in (("at", np.int32), ("ids", np.int64)))
        local = np.full(int(max(codes.max(initial=-1), at.max())) + 2, -1, np.int64)
        local[at] = np.arange(len(at))
        codes = local[codes]  # the last element is the mark's
        there = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
        pairs, which = np.unique(codes[there] * len(at) + codes[there + 1], return_inverse=True)
        n = np.bincount(which[there < own], minlength=len(pairs))
        up = np.full(len(codes), -1, np.int32)
        up[there] = which
        a, b = ids[pairs // len(at)], ids[pairs % len(at)]
        bucket = ((a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) % np.uint64(buckets)
        pack = lambda some: {"a": flat(a[some], np.int64), "b": flat(b[some], np.int64)}
        return pa.Table.from_batches(list(some_at_once([{"block": block, "own": own, "codes": flat(up, np.int32)}, *dealt(block, bucket.astype(np.int64), n, pack)])))

    answers = answers.where("block is not null").select(F.col("block").alias("of"), "at", "ids")
    return parts.where("codes is not null").select("block", "own", "codes").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(run, PARTS)


def buckets_for(entries: int) -> int:
    return max(LEAST_BUCKETS, -(-entries // BUCKET))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first phrases."""
    spark, folders = docs.sparkSession, []

    def stored(df: DataFrame, name: str) -> DataFrame:
        folders.append(new_folder(spark, name))
        df.write.option("compression", "zstd").parquet(folders[-1])
        return spark.read.parquet(folders[-1])

    def done(name: str) -> None:
        for folder in [f for f in folders if f"/{name}-" in f][:-1]:
            folders.remove(folder)
            delete(spark, folder)

    def names_of(answers: DataFrame) -> DataFrame:
        return answers.where("names is not null").select(F.explode("names").alias("x")).select("x.*")

    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    parts = stored(word_blocks(docs, text, lang, longest - 1, buckets_for(size // 6)), "phrase-blocks")
    totals = parts.select(F.explode("totals").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n"))
    totals = cut(totals)  # a row for each language
    places = parts.agg(F.sum("own")).first()[0] or 0
    answers = stored(named(parts, least, True, longest > 1), "phrase-names")
    none = F.array().cast("array<bigint>")
    names = names_of(answers).select("id", "lang", F.col("word").alias("phrase"), "f", none.alias("heads"), none.alias("tails"))
    levels = []
    for k in range(2, longest + 1):
        parts = stored(pair_blocks(parts, answers, buckets_for(places)), "phrase-blocks")
        done("phrase-blocks")
        answers = stored(named(parts, least, False, k < longest), "phrase-names")
        one = names.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("first"), F.concat("heads", F.array("f")).alias("heads"))
        # a phrase's last word is what follows the last space of its second parent
        other = names.select(F.col("id").alias("right"), F.substring_index(F.col("phrase").cast("string"), " ", -1).cast("binary").alias("last"), F.concat("tails", F.array("f")).alias("tails"))
        pairs = names_of(answers).select("id", "left", "right", "f").join(one, "left").join(other, "right")
        names = stored(pairs.select("id", "left", "right", "lang", F.concat("first", F.lit(b" "), "last").alias("phrase"), "f", "heads", "tails"), "phrase-levels")
        done("phrase-names")
        levels.append(names)
    kept = []
    for k, level in enumerate(levels, 2):
        number = lambda c: c.cast("decimal(38,0)")

        def cutting(i: int, k=k):
            l, r = F.get("heads", F.lit(i)), F.get("tails", F.lit(k - 2 - i))
            score = F.call_function("div", number(F.lit(UNIT)) * number(F.col("f")) * number(F.col("f")), number(l) * number(r))
            return F.struct(score.cast("bigint").alias("score"), F.lit(i).alias("cut"), l.alias("l"), r.alias("r"))

        best = F.array_min(F.array(*[cutting(i) for i in range(k - 1)])).alias("best")
        if k <= len(levels):
            above = levels[k - 1].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("most"))
            level = level.join(above, "id", "left").where(F.coalesce(100 * F.col("most") < share * F.col("f"), F.lit(True)))
        kept.append(level.select("id", "lang", "phrase", F.col("f").alias("a"), best))
    ranked = first_of(functools.reduce(DataFrame.union, kept).select("id", "lang", "phrase", "a", "best.score", "best.l", "best.r"), top)
    out = cut(ranked.join(totals, "lang").select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score"))
    for folder in folders:
        delete(spark, folder)
    return out


def first_of(phrases: DataFrame, top: int) -> DataFrame:
    """Each language's first phrases with their ranks. Parts of a language are ranked first, as many of them as make the last
    ranking no larger than the first ones."""
    phrases = cut(phrases)
    parts = max(1, int((phrases.count() / top) ** 0.5))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    part = F.pmod(F.xxhash64("id", "phrase"), F.lit(parts)).alias("part")
    few = phrases.select("*", part).select("*", rank("lang", "part").alias("_at")).where(F.col("_at") <= top)
    return few.select("*", rank("lang").cast("bigint").alias("rank")).where(F.col("rank") <= top)


def query(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents").select("text", "lang"))


def oracle() -> str:
    """All n-grams of all texts in DuckDB, without pruning."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT doc, lang, generate_subscripts(x, 1) AS piece, unnest(x) AS t FROM (SELECT doc, lang, regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]') AS x FROM d)),
    w AS (SELECT lang, list_filter(regexp_split_to_array(t, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
    g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w), range(1, {LONGEST + 1}) r(k) WHERE i + k - 1 <= len(w)),
    f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k > 1 AND a >= {LEAST}),
    s AS (SELECT c.*, j, x.a AS l, y.a AS r, {UNIT} * c.a * c.a // (x.a * y.a) AS score
        FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
    m AS (SELECT lang, phrase, any_value(a) AS a, arg_min(struct_pack(l := l, r := r, score := score), (score, j)) AS b FROM s GROUP BY lang, phrase),
    z AS (SELECT DISTINCT o.lang, i.phrase FROM c o, unnest(range(2, o.k)) u(k), unnest(range(1, o.k - u.k + 2)) v(i), c i
        WHERE i.lang = o.lang AND i.phrase = array_to_string(o.w[v.i:v.i + u.k - 1], ' ') AND 100 * o.a >= {SHARE} * i.a),
    q AS (SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY b.score DESC, a DESC, m.phrase) AS rank, m.phrase, a, b FROM m ANTI JOIN z ON z.lang = m.lang AND z.phrase = m.phrase)
    SELECT q.lang, rank, phrase, a::BIGINT AS a, b.l::BIGINT AS l, b.r::BIGINT AS r, n::BIGINT AS n, b.score::BIGINT AS score FROM q JOIN n USING (lang) WHERE rank <= {TOP}"""
