"""Vector codes, phrases and the permutation index against brute force, on planted and odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from knowmill.llm import phrases, pivots, vector_codes

EMB = "vec_id bigint, embedding array<float>, label int, code string"


# Vector codes


def lloyd(rows, parts, entries, rounds, scale=vector_codes.SCALE):
    """Codes and errors by Python's integers, each part against each entry."""
    rows = sorted((r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    lengths = Counter(len(r[1]) for r in rows)
    size = max(lengths, key=lambda d: (lengths[d], d))
    rows = [r for r in rows if len(r[1]) == size]
    whole = lambda x: (Fraction(float(x)) * scale).__floor__()
    ends = [size * i // parts for i in range(parts + 1)]
    cut = [[[whole(x) for x in r[1][a:b]] for a, b in zip(ends, ends[1:], strict=False)] for r in rows]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    gap = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for turn in range(rounds + 1):
        near = [[min((gap(v[p], c), j) for j, c in enumerate(books[p])) for p in range(parts)] for v in cut]
        if turn < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    own = [cut[i][p] for i in range(len(cut)) if near[i][p][1] == j]
                    if own:
                        books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = sorted((r[0], "".join(f"{j:02x}" for _, j in n), sum(d for d, _ in n)) for r, n in zip(rows, near, strict=True) if r[0] is not None)
    return codes, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


@pytest.mark.parametrize("grid", [True, False])
def test_codes_equal_plain_lloyd(spark, grid):
    """On a grid nearly all distances tie."""
    rng = random.Random(3)
    draw = (lambda: rng.choice([-1, 0, 1]) / 4096) if grid else (lambda: rng.gauss(0, 0.2))
    rows = [(i, [float(np.float32(draw())) for _ in range(18)], i % 3) for i in range(300)]
    rows += [(7, rows[3][1], None), (None, rows[4][1], None), (900, None, 1), (901, [None] * 18, 1), (902, [float("nan")] * 18, 1), (903, [1.0] * 5, 1), (904, [], 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], EMB)
    codes, books = vector_codes.compress(df, parts=4, entries=5, rounds=4)
    want, digest = lloyd([r[:2] for r in rows], 4, 5, 4)
    got = codes.collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got if r.vec_id is not None) == want
    assert sum(r.vec_id is None for r in got) == 1 and vector_codes.digest(books) == digest


def test_codes_of_large_components(spark):
    """Sums and squares beyond 64 bits, and errors that no 64 bits hold."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 10.0 ** rng.choice([0, 3, 12, 30])) for _ in range(8)]) for i in range(60)]
    codes, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), parts=2, entries=4, rounds=3)
    want, digest = lloyd(rows, 2, 4, 3)
    assert sorted((r.vec_id, r.code) for r in codes.collect()) == [w[:2] for w in want] and vector_codes.digest(books) == digest
    assert sorted((r.vec_id, r.error) for r in codes.collect()) == [(i, e if e < 1 << 63 else None) for i, _, e in want]


def test_codes_of_few_rows_and_group_errors(spark, monkeypatch):
    df = spark.createDataFrame([(1, [0.5] * 8, None, "x"), (2, [0.25] * 8, None, "x"), (3, [0.1] * 8, 5, "x")], EMB)
    codes, _ = vector_codes.compress(df, keep=("label",))
    for bound in (50_000, 0):
        monkeypatch.setattr(vector_codes, "SMALL_LABELS", bound)
        assert [r.label_error for r in vector_codes.with_group_error(codes, "label").collect()] == [0, 0, 0]
    assert vector_codes.compress(df.limit(0))[0].count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(df, entries=300)


def test_codes_on_odd_rows_equal_their_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5]) for _ in range(16)], rng.choice([1, 2, None])) for i in range(80)]
    rows += [(200, None, 1), (201, [float("inf")] * 16, None), (202, [None] * 16, 2), (203, [0.1] * 3, 2)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = connect(str(tmp_path))
    con.sql(f"create or replace view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    same(spark, con, str(tmp_path), vector_codes.query, vector_codes.oracle())


# Phrases


def brute_phrases(rows, longest, least, share, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = {(lang, w[i : i + k]) for (lang, w), a in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= share * f[lang, w[i : i + k]]}
    by = defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            by[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, some in by.items() for i, (s, a, p, x, y) in enumerate(sorted(some)[:top], 1))


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_phrases_equal_brute_force(spark, monkeypatch, longest):
    """Texts that blocks and slices cut anywhere, in languages that share words."""
    rng = random.Random(longest)
    words = ["a", "B", "c", "é", "dd", "ß.", "x,y", " ", "z\n"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 300))), rng.choice(["en", "de", None, "und", ""])) for _ in range(30)]
    rows += [(None, "en"), ("", None), ("  \t", "en"), ("a b " * 400, "en"), ("nogap" * 300, "xx")] + [rows[0]] * 3
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, block int").repartition(3)
    want = brute_phrases(rows, longest, 4, 50, 40)
    for block, piece, bucket in ((1 << 20, 1 << 20, 1 << 19), (50, 64, 100)):
        monkeypatch.setattr(phrases, "BLOCK", block)
        monkeypatch.setattr(phrases, "SLICE", piece)
        monkeypatch.setattr(phrases, "BUCKET", bucket)
        got = phrases.mine(df, longest=longest, least=4, top=40).collect()
        assert sorted(tuple(r) for r in got) == want and len(want) > 20


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert phrases.mine(df).count() == 0
    assert phrases.mine(spark.createDataFrame([(None, None), ("one two", "en")], df.schema)).count() == 0


# Permutation index


def nearest(rows, queries, k):
    out = {}
    for qid, q in queries:
        some = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != qid)
        out[qid] = [i for _, i in some[:k]]
    return out


def test_index_recall_and_scores(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = dict(rows)
    got = defaultdict(list)
    for r in pivots.query(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    want = nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert set(got) == set(want)
    assert np.mean([len({r.vec_id for r in got[q]} & set(w)) / len(w) for q, w in want.items()]) >= 0.9
    for q, rs in got.items():
        assert [r.rank for r in rs] == list(range(1, len(rs) + 1)) and all(r.vec_id != q for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        assert all(abs(r.score - np.dot(x[q], x[r.vec_id])) < 1e-12 for r in rs)


@pytest.mark.parametrize("norms", [False, True])
def test_index_finds_planted_neighbours(spark, monkeypatch, norms):
    """Clusters, of which one has a third of all rows and many copies of one vector; blocks of few rows."""
    monkeypatch.setattr(pivots, "BLOCK", 64)
    monkeypatch.setattr(pivots, "CHUNK", 7)
    monkeypatch.setattr(pivots, "TILE", 3)
    monkeypatch.setattr(pivots, "ORDER", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    rows = []
    for i in range(900):
        v = centres[0 if i % 3 == 0 else rng.integers(12)] + 0.3 * rng.normal(size=24)
        rows.append((i, [float(y) for y in (v if i % 9 else centres[0]) * (rng.uniform(0.2, 3) if norms else 1)]))
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] * 24), (1020, [1.0] * 3), (1040, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id bigint, embedding array<double>, rank int").repartition(4)
    index = pivots.Index(df)
    got = defaultdict(list)
    for r in index.search(df.where("vec_id % 20 = 0"), k=10).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    index.drop()
    want = nearest(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({i for _, i in got[q]} & set(w)) / 10 for q, w in want.items()]) >= 0.9


def test_index_of_few_rows(spark):
    """All candidates, if fewer than k; ties by id; rows that repeat an id; null ids; nothing."""
    schema = "vec_id bigint, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (2, [0.5, 0.0]), (1, [0.5, 0.0]), (3, [-1.0, 2.0]), (20, [0.0, 1.0]), (None, [9.0, 9.0])], schema)
    rows = pivots.Index(df).search(df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(None, 9.0), (20, 1.0), (1, 0.5), (2, 0.5), (20, 0.0), (3, -1.0)]
    twice = pivots.Index(df).search(df.where("vec_id = 20")).collect()
    assert len(twice) == 10 and all(r.vec_id != 20 for r in twice)
    empty = pivots.Index(df.limit(0))
    assert empty.search(df).count() == 0 and pivots.Index(df).search(df.limit(0)).count() == 0
    assert pivots.Index(df.limit(1)).search(df.limit(1)).count() == 0
