"""Near-duplicate documents: an exact set-similarity join on word shingles, and the groups that its links form.

1. Documents with equal shingle sets form a class, named by the set's hash, so copies are never paired.
2. A pair can only link if it shares a token of both documents' prefixes (the first n - ceil(t n) + 1 of n tokens in an
   order that all documents share). The order begins with a quarter of all tokens, chosen by hash, without the most
   frequent ones. All documents' quarter tokens are counted in packed buckets; a document whose prefix is made of tokens
   that no other class has cannot link, and takes no further part.
3. The others' tokens are counted among themselves, and prefixes taken anew, rarest tokens first. Their tokens give stars
   from each token's smallest class. What the stars connect is compared in one cell of bounded size, or, if it is
   larger, block by block.
4. A cell is joined with adaptive multi-match prefixes: an l-prefix is l - 1 tokens longer, and two documents that link
   share l tokens of theirs. Each document lengthens its prefix while the verification that it would spare is worth more
   than the postings to read. Candidates are verified on whole sets, and those that are already connected are passed.
   Every link between different components is found, so components are exact.

Shingles are compared by 64-bit hashes; a set of a million differs in effect with a probability below 1e-7.

The size of shingles in words and the percentage of their union that two documents must share are parameters; op5 takes
4 words and 85 percent, the pipeline 5 words and 80 percent.

Null text or no word: no shingle, linked with nothing. Fewer words than a shingle: the whole sequence is one shingle. For
``near_duplicates``, rows that repeat a doc_id are one node, whatever their texts, and rows with a null doc_id are returned
with a null component and connect nothing. ``keep_one`` decides on each row's text, rows without an id included. Empty table:
empty result. Names that begin with ``_near`` are reserved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowmill.llm.common import cut, lean
from knowmill.llm.graph import components

#: Words of a shingle and least percentage of op5.
SIZE = 4
PERCENT = 85
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: One in so many tokens (a power of two) comes first in the order of tokens.
QUARTER = 4
#: Tokens that a task holds before it deals them out.
BUCKET = 1 << 20
#: Tokens of a bucket. Small buckets: a document then has a row for about each token that it shares, however large the input.
DEALT = 1 << 18
#: A task reports tokens that it has seen in so many classes; so many of the most frequent of them come last in the order.
OFTEN, HEAVY, HEAVIEST = 8, 64, 100_000
#: Tokens of a cell.
CELL = 2 << 20
#: The place of heavy tokens in the order by frequency.
LAST = (1 << 32) - 1
#: Candidates that may be broadcast.
SMALL_ROWS = 500_000
#: Words whose hashes are kept.
KEPT = 1 << 18
MAX_LEVEL = 8

A = np.uint64(0x9E3779B97F4A7C15)
B = np.uint64(0xBF58476D1CE4E5B9)


class Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(text: bytes | None, hashes: Hashes, size: int = SIZE) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    words = WORD.findall(text.lower()) if text else []  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    k = min(size, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        x = (x ^ h[i : len(h) - k + 1 + i]) * A
        x ^= x >> np.uint64(29)
    x *= B
    x ^= x >> np.uint64(32)
    return np.unique(x)


def signature(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def first(s: np.ndarray) -> np.ndarray:
    """The tokens that come first in the order."""
    return s[(s & np.uint64(QUARTER - 1)) == 0]


def need(n, percent: int = PERCENT):
    """The least overlap that a set of n tokens needs with any other."""
    return (percent * n + 99) // 100


def texts(batches) -> Iterator[tuple[int | None, bytes | None]]:
    for b in batches:
        for i in range(0, b.num_rows, 1000):  # a part of a batch as Python objects at a time
            part = b.slice(i, 1000)
            yield from zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


ROWS = "kind int, doc_id bigint, n bigint, m bigint, sig bigint"


def survey(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """kind 0: a document's id, set size, tokens that come first and signature; kind 1: a token and its classes in a task."""

    def run(batches):
        hashes, seen, out, held, total = Hashes(), set(), [], [], 0
        for d, t in texts(batches):
            s = shingles(t, hashes, size)
            sig = signature(s) if len(s) else None
            f = first(s)
            out.append((0, d, len(s), len(f), sig))
            if sig is not None and sig not in seen:
                seen.add(sig)
                held.append(f)
                total += len(f)
            if total >= BUCKET:
                out += often(held)
                held, total = [], 0
            if len(out) >= 20_000:
                yield table(out)
                out = []
        yield table(out + often(held))

    def often(held):
        t, c = np.unique(np.concatenate([*held, np.empty(0, np.uint64)]), return_counts=True)
        hot = c >= OFTEN
        return [(1, None, int(k), 0, int(x)) for x, k in zip(t[hot].view(np.int64), c[hot], strict=True)]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.int64()) for i in range(5)], names=["kind", "doc_id", "n", "m", "sig"])

    return cut(docs.mapInArrow(lean(run), ROWS))


def heavy_tokens(counts: DataFrame) -> np.ndarray:
    """At most HEAVIEST of the tokens (sig, n in a task) that many classes share; which ones changes the work, never the
    result."""
    top = counts.groupBy("sig").agg(F.sum("n").alias("c")).where(F.col("c") >= HEAVY).orderBy(F.desc("c"), "sig").limit(HEAVIEST).select("sig").collect()
    return np.sort(np.array([r.sig for r in top], np.int64).view(np.uint64))


def shared_tokens(docs: DataFrame, total: int, heavy, size: int = SIZE) -> DataFrame:
    """(sig, shared): for each class how many of its first tokens other classes have too, or are among the heavy ones."""
    buckets = max(1, -(-total // DEALT))

    def deal(batches):
        hashes, seen, tokens, sigs, hot, n = Hashes(), set(), [], [], [], 0
        for _, t in texts(batches):
            s = shingles(t, hashes, size)
            if not len(s) or (sig := signature(s)) in seen:
                continue
            seen.add(sig)
            f = first(s)
            light = f[~np.isin(f, heavy.value, assume_unique=True)]
            if len(light) < len(f):
                hot.append((sig, len(f) - len(light)))
            tokens.append(light)
            sigs.append(np.full(len(light), sig, np.int64))
            n += len(light)
            if n >= BUCKET:
                yield from packed(tokens, sigs, hot)
                tokens, sigs, hot, n = [], [], [], 0
        yield from packed(tokens, sigs, hot)

    def packed(tokens, sigs, hot):
        t, s = np.concatenate([*tokens, np.empty(0, np.uint64)]), np.concatenate([*sigs, np.empty(0, np.int64)])
        at = ((t >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        t, s, at = t[order], s[order], at[order]
        keys, starts = np.unique(at, return_index=True)
        ends = np.append(starts[1:], len(at))[: len(keys)]
        rows = [(int(k), t[a:z].tobytes(), s[a:z].tobytes(), False) for k, a, z in zip(keys, starts, ends, strict=True)]
        if hot:
            rows.append((int(hot[0][0] % buckets), np.array([c for _, c in hot], np.uint64).tobytes(), np.array([x for x, _ in hot], np.int64).tobytes(), True))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.bool_()))], names=["bucket", "t", "s", "hot"])

    def count(group: pa.Table) -> pa.Table:
        hot = group.column("hot").to_numpy()
        load = lambda c, kind, rows: np.concatenate([np.frombuffer(x, kind) for x, h in zip(group.column(c).to_pylist(), hot, strict=True) if h == rows] + [np.empty(0, kind)])
        t, s = load("t", np.uint64, False), load("s", np.int64, False)
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        new = np.append(True, (t[1:] != t[:-1]) | (s[1:] != s[:-1]))[: len(t)]
        t, s = t[new], s[new]
        same = np.append(False, t[1:] == t[:-1])[: len(t)]
        twice = same | np.append(same[1:], False)[: len(t)]
        sig, c = np.unique(s[twice], return_counts=True)
        hs, hc = load("s", np.int64, True), load("t", np.uint64, True)
        return pa.table({"sig": np.concatenate([sig, hs]), "c": np.concatenate([c, np.zeros(len(hs), np.int64)]).astype(np.int64), "h": np.concatenate([np.zeros(len(sig), np.int64), hc.astype(np.int64)])})

    dealt = docs.mapInArrow(lean(deal), "bucket bigint, t binary, s binary, hot boolean")
    return dealt.groupBy("bucket").applyInArrow(count, "sig bigint, c bigint, h bigint").groupBy("sig").agg((F.sum("c") + F.max("h")).alias("shared"))


def full_sets(docs: DataFrame, left: DataFrame, size: int = SIZE) -> DataFrame:
    """(cls, n, tokens) of the classes that may link, from the text of the smallest id. Rows may repeat. Classes of which no
    row has an id are found among the rows without one."""
    small = left.count() <= SMALL_ROWS
    side = F.broadcast(left) if small else left
    rows = docs.join(side.select(F.col("rep").alias("doc_id"), F.col("sig").alias("_sig")), "doc_id").select("text", "_sig")

    def run(batches):
        hashes = Hashes()
        for b in batches:
            ids, ns, blobs = [], [], []
            for t, g in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(t, hashes, size)
                if len(s) and (g is None or signature(s) == g):
                    ids.append(signature(s))
                    ns.append(len(s))
                    blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(blobs, pa.binary())], names=["cls", "n", "tokens"])

    made = "cls bigint, n bigint, tokens binary"
    sets = rows.mapInArrow(lean(run), made)
    nameless = left.where("rep is null").select(F.col("sig").alias("cls"))
    if nameless.count():
        every = docs.where("doc_id is null").select("text", F.lit(None).cast("bigint").alias("_sig")).mapInArrow(lean(run), made)
        once = every.groupBy("cls").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
        sets = sets.unionByName(once.join(F.broadcast(nameless) if small else nameless, "cls", "left_semi"))
    return cut(sets)


def often_in(sets: DataFrame) -> DataFrame:
    """(sig, n): tokens that a task has seen in OFTEN sets of about BUCKET tokens together."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for t in b.column(0):
                held.append(np.frombuffer(t.as_buffer(), np.uint64))
                size += len(held[-1])
                if size >= BUCKET:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    def counted(held):
        t, c = np.unique(np.concatenate([*held, np.empty(0, np.uint64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([signed(t[c >= OFTEN]), pa.array(c[c >= OFTEN].astype(np.int64))], names=["sig", "n"])

    return sets.select("tokens").mapInArrow(lean(run), "sig bigint, n bigint")


TOKENS, SIZES = 0, 1


def packed_rows(at: np.ndarray, kind: int, *columns: np.ndarray) -> list[tuple]:
    """A row (at, kind, bytes of each column) for each value of ``at``."""
    order = np.argsort(at, kind="stable")
    at, columns = at[order], [c[order] for c in columns]
    keys, starts = np.unique(at, return_index=True)
    ends = np.append(starts[1:], len(at))[: len(keys)]
    return [(int(k), kind, *[c[a:z].tobytes() for c in columns]) for k, a, z in zip(keys, starts, ends, strict=True)]


def loaded(rows: list[tuple], kind: int, column: int, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[column], dtype) for r in rows if r[1] == kind] + [np.empty(0, dtype)])


def batch_of(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * (len(names) - 2))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))


def prefix_tokens(sets: DataFrame, total: int, heavy, percent: int = PERCENT) -> DataFrame:
    """(t, cls): the prefix tokens that a set shares with others. The order is by frequency among these sets, heavy tokens
    last; a set's own tokens come first and lead to nobody, so only what it shares is looked at, after as many places as it
    has own tokens. Both steps deal tokens out in packed buckets, first by token to count them, then by set."""
    buckets = max(1, -(-total // DEALT))

    def deal(batches):
        tokens, reps, hot_t, hot_r, ids, ns, size = [], [], [], [], [], [], 0

        def flush():
            t, s = np.concatenate([*tokens, np.empty(0, np.uint64)]), np.concatenate([*reps, np.empty(0, np.int64)])
            ht, hr = np.concatenate([*hot_t, np.empty(0, np.uint64)]), np.concatenate([*hot_r, np.empty(0, np.int64)])
            i, n = np.array(ids, np.int64), np.array(ns, np.int64)
            rows = packed_rows(((t >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), TOKENS, t, s, np.zeros(len(t), np.uint32))
            rows += packed_rows(i % buckets, SIZES, n.view(np.uint64), i, np.zeros(len(i), np.uint32))
            # heavy tokens are not counted, so that no bucket has all their sets: they travel with their sets
            rows += [(k, SIZES + 1, *rest) for k, _, *rest in packed_rows(hr % buckets, TOKENS, ht, hr, np.full(len(ht), LAST, np.uint32))]
            return batch_of(rows, ("bucket", "kind", "t", "s", "f"))

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = np.frombuffer(t, np.uint64)
                hot = np.isin(s, heavy.value, assume_unique=True)
                tokens.append(s[~hot])
                reps.append(np.full(len(tokens[-1]), d, np.int64))
                hot_t.append(s[hot])
                hot_r.append(np.full(len(hot_t[-1]), d, np.int64))
                ids.append(d)
                ns.append(len(s))
                size += len(s)
                if size >= BUCKET:
                    yield flush()
                    for x in (tokens, reps, hot_t, hot_r, ids, ns):
                        x.clear()
                    size = 0
        yield flush()

    def count(group: pa.Table) -> pa.Table:
        rows = list(zip(*[group.column(c).to_pylist() for c in ("bucket", "kind", "t", "s", "f")], strict=True))
        t, s = loaded(rows, TOKENS, 2, np.uint64), loaded(rows, TOKENS, 3, np.int64)
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        new = np.append(True, (t[1:] != t[:-1]) | (s[1:] != s[:-1]))[: len(t)]
        t, s = t[new], s[new]
        head = np.append(True, t[1:] != t[:-1])[: len(t)]
        f = np.diff(np.append(np.flatnonzero(head), len(t)))[np.cumsum(head) - 1].astype(np.uint32)
        t, s, f = t[f > 1], s[f > 1], f[f > 1]
        hot = [loaded(rows, SIZES + 1, i, k) for i, k in ((2, np.uint64), (3, np.int64), (4, np.uint32))]
        t, s, f = np.concatenate([t, hot[0]]), np.concatenate([s, hot[1]]), np.concatenate([f, hot[2]])
        i, n = loaded(rows, SIZES, 3, np.int64), loaded(rows, SIZES, 2, np.uint64)
        out = packed_rows(s % buckets, TOKENS, t, s, f) + packed_rows(i % buckets, SIZES, n, i, np.zeros(len(i), np.uint32))
        return pa.Table.from_batches([batch_of(out, ("dest", "kind", "t", "s", "f"))])

    def choose(group: pa.Table) -> pa.Table:
        rows = list(zip(*[group.column(c).to_pylist() for c in ("dest", "kind", "t", "s", "f")], strict=True))
        t, s, f = loaded(rows, TOKENS, 2, np.uint64), loaded(rows, TOKENS, 3, np.int64), loaded(rows, TOKENS, 4, np.uint32)
        order = np.lexsort((t, f, s))
        t, s = t[order], s[order]
        new = np.append(True, (t[1:] != t[:-1]) | (s[1:] != s[:-1]))[: len(t)]  # repeated rows of a set bring heavy tokens twice
        t, s = t[new], s[new]
        ids, at = np.unique(loaded(rows, SIZES, 3, np.int64), return_index=True)
        n = loaded(rows, SIZES, 2, np.uint64).view(np.int64)[at]
        reps, starts, shared = np.unique(s, return_index=True, return_counts=True)
        size = n[np.searchsorted(ids, reps)]
        places = np.maximum(size - need(size, percent) + 1 - (size - shared), 0)
        keep = np.arange(len(s)) - np.repeat(starts, shared) < np.repeat(places, shared)
        return pa.table({"t": signed(t[keep]), "cls": pa.array(s[keep])})

    packed = "kind int, t binary, s binary, f binary"
    dealt = sets.select("cls", "tokens").mapInArrow(lean(deal), f"bucket bigint, {packed}")
    by_set = dealt.groupBy("bucket").applyInArrow(count, f"dest bigint, {packed}")
    return by_set.groupBy("dest").applyInArrow(choose, "t bigint, cls bigint")


def stars(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges from the smallest class of each prefix token to the others."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    heavy = sets.sparkSession.sparkContext.broadcast(heavy_tokens(often_in(sets)))  # at most HEAVIEST numbers
    e = prefix_tokens(sets, total, heavy, percent)
    low = e.groupBy("t").agg(F.min("cls").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("t", "a")
    return e.join(low, "t").select("a", F.col("cls").alias("b")).where("a <> b")


def verified(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    n = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    i = int((both[1:] == both[:-1]).sum())
    return 100 * i >= percent * (n - i)


def join(sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between the sets that connect whatever links connect; with ``side``, only links between its two values."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order])
    flat = np.concatenate([sets[k] for k in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    _, number, df = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))  # rare tokens first
    token = rank[number]
    by = np.lexsort((token, owner))
    token, at = token[by], np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(token)) - np.repeat(at[:-1], sizes)
    level = np.maximum(1, place - np.repeat(sizes - need(sizes, percent), sizes) + 1)  # of the shortest l-prefix that has the token
    use = np.flatnonzero((level <= MAX_LEVEL) & (df[np.argsort(df, kind="stable")][token] > 1))
    post = use[np.lexsort((owner[use], token[use]))]
    p_token, p_doc, p_level = token[post], owner[post], level[post]
    label, links = np.arange(len(order)), []
    mine = None if side is None else side[order]
    for r in range(len(order)):
        own = slice(at[r], at[r + 1])
        t, lv = token[own][level[own] <= MAX_LEVEL], level[own][level[own] <= MAX_LEVEL]
        a, z = np.searchsorted(p_token, t), np.searchsorted(p_token, t, "right")
        least = np.searchsorted(sizes, need(sizes[r], percent))  # shorter sets cannot overlap enough
        count, length, cand = np.zeros(len(order), np.int32), 1, np.empty(0, int)
        docs, levels, mine_level = [], [], []
        while True:
            for k in np.flatnonzero(lv == length):
                docs.append(p_doc[a[k] : z[k]])
                levels.append(p_level[a[k] : z[k]])
            d = np.concatenate([*docs, np.empty(0, int)]).astype(int)
            fit = (np.concatenate([*levels, np.empty(0, int)]) <= length) & (d < r) & (d >= least)
            count[:] = 0
            np.add.at(count, d[fit], 1)
            cand = np.flatnonzero(count >= length)
            cand = cand[label[cand] != label[r]]
            if mine is not None:
                cand = cand[mine[cand] != mine[r]]
            nxt = np.flatnonzero(lv == length + 1)
            # a verification reads two sets; one more match is worth it while postings to read are fewer
            if length >= MAX_LEVEL or not len(nxt) or len(cand) * sizes[r] <= 2 * (len(d) + int((z[nxt] - a[nxt]).sum())):
                break
            length += 1
        for c in cand[np.argsort(-count[cand], kind="stable")]:
            if label[c] != label[r] and verified(sets[order[c]], sets[order[r]], percent):
                links.append((order[c], order[r]))
                label[label == label[c]] = label[r]
    return links


def links(sets: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified edges (a, b) between classes that connect all that link."""
    sized = sets.select("cls", "n").join(groups, sets["cls"] == groups["node"]).groupBy("component").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("c")).where("c > 1")
    sized = cut(sized)
    total = sized.agg(F.sum("total")).first()[0] or 0
    cells = max(1, -(-8 * total // CELL))
    blocks = F.when(F.col("total") > CELL, F.ceil(2 * F.col("total") / CELL)).otherwise(F.lit(1)).cast("bigint")
    keyed = groups.join(sized.select("component", blocks.alias("k")), "component").select(F.col("node").alias("cls"), "component", "k", F.pmod(F.xxhash64("node"), F.col("k")).alias("block"))
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j"))))
    keyed = keyed.select("cls", "component", "k", "block", pair.alias("x")).select("cls", "component", "block", "x.i", "x.j", F.when(F.col("k") == 1, F.pmod(F.xxhash64("component"), F.lit(cells))).otherwise(-1 - F.abs(F.xxhash64("component", "x.i", "x.j") / 2).cast("bigint")).alias("cell"))

    def run(group: pa.Table) -> pa.Table:
        comp, i, j, block, cls = (group.column(c).to_numpy() for c in ("component", "i", "j", "block", "cls"))
        blobs = group.column("tokens")
        a, b = [], []
        order = np.lexsort((cls, j, i, comp))
        cuts = np.flatnonzero((np.diff(comp[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        for part in np.split(order, cuts):
            part = part[np.append(True, np.diff(cls[part]) != 0)]  # repeated rows
            sets_ = [np.frombuffer(blobs[int(k)].as_py(), np.uint64) for k in part]
            side = block[part] if i[part[0]] != j[part[0]] else None
            for x, y in join(sets_, side, percent):
                a.append(int(cls[part[x]]))
                b.append(int(cls[part[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sets.join(keyed, "cls").select("cell", "component", "i", "j", "block", "cls", "tokens").groupBy("cell").applyInArrow(run, "a bigint, b bigint")


def grouped(docs: DataFrame, size: int, percent: int, by_text: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, m, sig) of each row, and (sig, id, cls): the smallest id of each class's group and the class that has it.
    ``by_text``: rows are told apart by their texts alone, and rows without an id take part, with an id after all others;
    otherwise rows of one id are one node, and those without an id are left out."""
    sc = docs.sparkSession.sparkContext
    rows = survey(docs, size)
    heavy = sc.broadcast(heavy_tokens(rows.where("kind = 1")))  # at most HEAVIEST numbers
    known = rows.where("kind = 0").select("doc_id", "n", "m", "sig")
    own = known.where("sig is not null")
    if not by_text:
        docs, own = docs.where("doc_id is not null"), own.where("doc_id is not null")
    classes = own.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("m").alias("m"))
    total = known.agg(F.sum("m")).first()[0] or 0
    shared = shared_tokens(docs, total, heavy, size)
    prefix = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    left = cut(classes.join(shared, "sig", "left").where(F.col("m") - F.coalesce("shared", F.lit(0)) < prefix).select("rep", "sig"))
    sets = full_sets(docs, left, size)
    edges = cut(links(sets, components(stars(sets, percent)), percent))  # else the next step's workers would run beside these
    if not by_text:
        several = own.groupBy("doc_id").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).where("a <> b").select("doc_id", "a")
        edges = edges.unionByName(own.join(several, "doc_id").select("a", F.col("sig").alias("b")).where("a <> b"))
    linked = classes.select("sig", "rep").join(components(edges).withColumnRenamed("node", "sig"), "sig")
    least = linked.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("last"), F.col("rep").alias("id"), F.col("sig").alias("cls"))).alias("x"))
    of = linked.select("sig", "component").join(least, "component").select("sig", "x.id", "x.cls")
    of = classes.select("sig", "rep").join(of, "sig", "left")
    return known, of.select("sig", F.when(F.col("cls").isNull(), F.col("rep")).otherwise(F.col("id")).alias("id"), F.coalesce("cls", "sig").alias("cls"))


def prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs, by shingles of ``size`` words of which ``percent`` agree."""
    known, of = grouped(prepared(docs, doc_id, text), size, percent, by_text=False)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id"))
    return known.join(of, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, rows without one last. Rows of one id with different
    texts are judged apart; of rows with one id and the same shingles, that with the least text stays. Rows without words
    are in no group; of those that repeat an id one stays, and all that have none."""
    known, of = grouped(prepared(docs, "doc_id", "text"), size, percent, by_text=True)
    judged = cut(known.join(of, "sig", "left").select("doc_id", "sig", (F.col("cls").isNull() | (F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("cls") == F.col("sig")))).alias("stays")))
    gone = cut(judged.where("doc_id is not null and not stays").select("doc_id").distinct())
    small = lambda t: F.broadcast(t) if t.count() <= SMALL_ROWS else t
    again = cut(judged.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    nameless = judged.where("doc_id is null").limit(1).count()
    if not nameless and not again.count():
        return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    once = docs.where("doc_id is not null").join(small(gone.union(again)), "doc_id", "left_anti").select(*docs.columns)
    odd = docs.where("doc_id is null").unionByName(docs.join(small(again), "doc_id", "left_semi").select(*docs.columns))
    signed_ = odd.select("*", signature_of(size)(F.col("text")).alias("_near_sig"))
    empty = signed_.where("doc_id is null and _near_sig is null").select(*docs.columns)
    stay = judged.where("stays and (doc_id is not null or sig is not null)").select(F.col("doc_id").alias("_near_id"), F.col("sig").alias("_near_of")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col("text"), F.to_json(row))
    # equal rows meet map-side first, so that many copies are a row for each task
    least = signed_.where("doc_id is not null or _near_sig is not null").groupBy(F.col("doc_id").alias("_near_id"), F.col("_near_sig")).agg(F.min_by(row, order).alias("_near_row"))
    held = least.alias("l").join(stay.alias("s"), F.col("l._near_id").eqNullSafe(F.col("s._near_id")) & F.col("_near_sig").eqNullSafe(F.col("_near_of")), "left_semi")
    return once.unionByName(held.select("_near_row.*")).unionByName(empty)


def signature_of(size: int):
    """The signature of a text's shingles as a column; null without words."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        hashes = Hashes()
        sets = (shingles(t, hashes, size) for t in texts.cast(pa.binary()).to_pylist())
        return pa.array([signature(s) if len(s) else None for s in sets], pa.int64())

    return of


def query(spark, sf_dir: str) -> DataFrame:
    from knowmill.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
