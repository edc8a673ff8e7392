"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (characters to characters, white space to the piece
mark), the pieces (strings to ids) and byte fallback (a character that no piece holds to the ids of its bytes). They are
composed with an input into a lattice, and the tropical-semiring shortest path is taken: weights add along a path, the
least total wins.

Unigram models: a piece's weight is its negated log-probability. Byte-pair models are not shortest paths over single
pieces; here the piece machine is composed with an acceptor of pairs, in which two neighbours weigh 0 if merging would
leave that boundary alone and infinity otherwise. A sequence is what merging yields exactly if all its neighbours are
such pairs, so exactly one path has a finite weight; it is found left to right, with one live state per position, for
all new words of a length at once: the piece machine is a transition table, the pair acceptor a sorted table that grows.

No piece of the supported models holds the mark after another character, so a text is cut before each run of marks, and
at characters that no piece holds; words' paths are kept in tables of bounded size while a task runs. Time is linear in the text. Null or empty text: no ids,
decoded as the empty text (null ids are decoded as null). Texts are never cut short. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from knowmill.llm.common import lean

MARK = "▁"
#: Bytes, about, of the paths in each of two generations of words, and pairs that are kept.
KEPT_BYTES, ENTRY_BYTES = 12 << 20, 240
KEPT_PAIRS = 1 << 20
#: Words of a length that are composed together.
TOGETHER = 20_000
#: Pairs that are gathered before the table of pairs is sorted anew.
FRESH = 50_000
#: Longer words are encoded each time.
KEPT_CHARS = 48
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# The piece types and model types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, BPE = 1, 2


def fields(data: bytes):
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            v = varint()
        elif kind == 2:
            n = varint()
            v = data[at : at + n]
            at += n
        elif kind == 5:
            v = struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        else:
            v = data[at : at + 8]
            at += 8
        yield key >> 3, v


class Normaliser:
    """The normaliser as a machine over two classes of characters, compiled to what it does to whole runs of them.

    It begins before any text, and is then within text, or in a gap that may turn out to be the text's end. ``step`` has
    the next state and what is put out before the character that was read; a space itself is never put out.
    """

    BEFORE, TEXT, GAP = range(3)

    def __init__(self, prefix: bool, squeeze: bool):
        first = MARK if prefix else ""
        if squeeze:
            space = {self.BEFORE: (self.BEFORE, ""), self.TEXT: (self.GAP, ""), self.GAP: (self.GAP, "")}
            other = {self.BEFORE: (self.TEXT, first), self.TEXT: (self.TEXT, ""), self.GAP: (self.TEXT, MARK)}
        else:
            space = {self.BEFORE: (self.TEXT, first + MARK), self.TEXT: (self.TEXT, MARK), self.GAP: (self.TEXT, MARK)}
            other = {self.BEFORE: (self.TEXT, first), self.TEXT: (self.TEXT, ""), self.GAP: (self.TEXT, "")}
        self.step = {True: space, False: other}
        self.repeats = not squeeze

    def run(self, state: int, text: str) -> tuple[int, str]:
        """The state after a text, and the output, character by character."""
        out = []
        for c in text:
            state, put = self.step[c == " "][state]
            out.append(put if c == " " else put + c)
        return state, "".join(out)

    def apply(self, text: str) -> str:
        if not text:
            return ""
        if self.repeats:  # every space puts out the mark
            return self.run(self.BEFORE, text[0])[1] + text[1:].replace(" ", MARK)
        parts = [p for p in text.split(" ") if p]  # a gap puts out one mark when text follows, nothing before or after all text
        return self.step[False][self.BEFORE][1] + self.step[False][self.GAP][1].join(parts) if parts else ""


class Model:
    """The compiled machines."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.prefix, self.squeeze, self.charsmap = UNIGRAM, True, True, b""
        for k, v in fields(data):
            if k == 1:
                p = dict(fields(v))
                self.pieces.append(p.get(1, b"").decode())
                self.scores.append(p.get(2, 0.0))
                self.types.append(p.get(3, NORMAL))
            elif k == 2:
                self.kind = dict(fields(v)).get(3, UNIGRAM)
            elif k == 3:
                n = dict(fields(v))
                self.charsmap, self.prefix, self.squeeze = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1))
        if self.charsmap:
            raise ValueError("only identity normalisation is compiled here")
        if USER in self.types:
            raise ValueError("user-defined pieces, which come before all others, are not compiled here")
        self.normaliser = Normaliser(self.prefix, self.squeeze)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are compiled here")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece holds the mark after another character")
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.is_byte = np.array([t == BYTE for t in self.types])
        self.is_control = np.array([t == CONTROL for t in self.types])
        self.byte_of = np.zeros(len(self.pieces), np.uint8)
        for b, i in self.bytes.items():
            self.byte_of[i] = b
        self.longest = max(map(len, self.ids))
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        # no merge crosses a character that no piece holds, so those of ASCII bound words too
        alone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in self.ids and c != 32))
        self.WORD = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        if self.kind == BPE:
            order = sorted(self.ids.values(), key=lambda i: -self.scores[i])
            self.rank = {i: r + 1 for r, i in enumerate(order)}
            self.halves: dict[int, tuple[int, int]] = {}
            self.live = {i for p, i in self.ids.items() if self._grows(p, i)}
            self._tables()

    def _grows(self, piece: str, i: int) -> bool:
        """Whether merging makes this piece of its characters; keeps its last merge."""
        if len(piece) == 1:
            return True
        parts = list(piece)
        if any(c not in self.ids for c in parts):
            return False
        while len(parts) > 1:
            best = min(((self.rank[j], k) for k in range(len(parts) - 1) if (j := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return False
            k = best[1]
            if len(parts) == 2:
                self.halves[i] = (self.ids[parts[0]], self.ids[parts[1]])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    def _tables(self) -> None:
        """The piece machine: ``step`` from state and character class to state, ``final`` from state to piece or -1."""
        live = [(p, i) for p, i in self.ids.items() if i in self.live]
        letters = sorted({c for p, _ in live if len(p) > 1 for c in p})
        self.class_of = np.zeros(0x110000, np.int32)
        self.single = np.full(0x110000, -1, np.int32)
        for k, c in enumerate(letters):
            self.class_of[ord(c)] = k + 1
        states: dict[str, int] = {"": 1}  # 0 is dead
        edges, final = [], {}
        for p, i in live:
            if len(p) == 1:
                self.single[ord(p)] = i
            if any(c not in states and self.class_of[ord(c)] == 0 for c in p):
                continue
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states) + 1
                    edges.append((states[p[: k - 1]], self.class_of[ord(p[k - 1])], states[p[:k]]))
            final[states[p]] = i
        self.step = np.zeros((len(states) + 1, len(letters) + 1), np.uint16 if len(states) < 65535 else np.int32)
        a = np.array(edges)
        self.step[a[:, 0], a[:, 1]] = a[:, 2]
        self.final = np.full(len(states) + 1, -1, np.int32)
        self.final[list(final)] = list(final.values())
        self.pair_keys, self.pair_ok = np.array([-1], np.int64), np.array([False])
        self.fresh: dict[int, bool] = {}

    def all_stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """stays() of many pairs: the sorted table knows most, ``fresh`` what has come since it was last merged."""
        n = len(self.pieces)
        keys = a.astype(np.int64) * n + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        ok, new = self.pair_ok[at], np.flatnonzero(self.pair_keys[at] != keys)
        if len(new):
            fresh = self.fresh
            some, back = np.unique(keys[new], return_inverse=True)
            found = []
            for k in some.tolist():
                v = fresh.get(k)
                if v is None:
                    v = fresh[k] = self.stays(*divmod(k, n))
                found.append(v)
            ok[new] = np.array(found)[back]
            if len(fresh) >= FRESH:
                kept = None if len(self.pair_keys) < KEPT_PAIRS else 1
                keys = np.concatenate([self.pair_keys[:kept], np.fromiter(fresh.keys(), np.int64, len(fresh))])
                oks = np.concatenate([self.pair_ok[:kept], np.fromiter(fresh.values(), bool, len(fresh))])
                order = np.argsort(keys)
                self.pair_keys, self.pair_ok = keys[order], oks[order]
                fresh.clear()
        return ok

    def paths(self, words: list[str]) -> list[bytes]:
        """path() of words of one length, together."""
        count, n = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(count, n)
        classes, single = self.class_of[codes], self.single[codes]
        piece = np.full((n, n + 1, count), -1, np.int32)  # of [j, i)
        for j in range(n):
            state = np.ones(count, np.int64)
            for i in range(j, min(n, j + self.longest)):
                state = self.step[state, classes[:, i]].astype(np.int64)
                if not state.any():
                    break
                piece[j, i + 1] = self.final[state]
            piece[j, j + 1] = single[:, j]
        # min-plus: an arc weighs 0 if its piece may follow the one before, and infinity if not; one path is finite
        cost = np.full((n + 1, count), np.inf, np.float32)
        cost[0] = 0
        last = np.full((n + 1, count), -1, np.int32)  # -1: fallback
        begin = np.zeros((n + 1, count), np.int32)
        for i in range(1, n + 1):
            none = single[:, i - 1] < 0
            cost[i, none], begin[i, none] = 0, i - 1
            for j in range(max(0, i - self.longest), i):
                t = piece[j, i]
                at = np.flatnonzero((t >= 0) & (cost[j] < cost[i]))  # nothing is below 0
                if not len(at):
                    continue
                arc = np.zeros(len(at), np.float32)
                if j:
                    before = last[j, at]
                    pairs = np.flatnonzero(before >= 0)
                    arc[pairs] = np.where(self.all_stay(before[pairs], t[at[pairs]]), 0, np.inf)
                total = cost[j, at] + arc
                less = total < cost[i, at]
                at = at[less]
                cost[i, at], last[i, at], begin[i, at] = total[less], t[at], j
        if np.isinf(cost[n]).any():
            raise AssertionError(f"no path for {words[int(np.argmax(np.isinf(cost[n])))]!r}")
        # back along the paths, from the right end of each row of ``got``
        got, at, rows, used = np.empty((count, n), np.int32), np.full(count, n), np.arange(count), np.zeros(count, np.int64)
        while len(rows):
            t = last[at[rows], rows]
            used[rows] += 1
            got[rows, n - used[rows]] = t
            at[rows] = begin[at[rows], rows]
            rows = rows[at[rows] > 0]
        data, width = got.tobytes(), 4 * n
        out = [data[e - 4 * m : e] for e, m in zip(range(width, width * count + 1, width), used.tolist(), strict=True)]
        for k in np.flatnonzero((classes == 0).any(1) & (single < 0).any(1)):  # a path with fallbacks
            out[k] = self.path(words[k])
        return out

    def stays(self, a: int, b: int) -> bool:
        """The pair acceptor: whether merging never crosses the boundary between pieces a and b.

        The boundary's two sides are taken apart, latest merge first; a merge across it that would have come before
        the merges still standing refutes the pair.
        """
        limit = float("inf")
        pieces, ids, rank, halves = self.pieces, self.ids, self.rank, self.halves
        while True:
            j = ids.get(pieces[a] + pieces[b])
            if j is not None and rank[j] < limit:
                return False
            ra, rb = rank[a] if a in halves else 0, rank[b] if b in halves else 0
            if not ra and not rb:
                return True
            if ra > rb:
                limit, a = ra, halves[a][1]  # at equal rank the left merge comes first
            else:
                limit, b = rb + 0.5, halves[b][0]

    def fallback(self, c: str) -> tuple[int, ...]:
        return tuple(self.bytes[x] for x in c.encode()) if self.bytes else (self.unknown,)

    def path(self, word: str) -> bytes:
        """The shortest path through the lattice of one word, as 32-bit numbers."""
        return np.array(self._pairs_path(word) if self.kind == BPE else self._sum_path(word), np.int32).tobytes()

    def _pairs_path(self, w: str) -> tuple[int, ...]:
        n, ids, live, longest = len(w), self.ids, self.live, self.longest
        whole = ids.get(w)
        if whole is not None and whole in live:
            return (whole,)
        last: list[tuple[int, int] | None] = [None] * (n + 1)  # (piece, where it begins) of the only finite path; -1: fallback
        for i in range(1, n + 1):
            c = w[i - 1]
            if c not in ids:
                last[i] = (-1, i - 1)
                continue
            for j in range(max(0, i - longest), i):
                t = ids.get(w[j:i])
                if t is None or t not in live or j and last[j] is None:
                    continue
                if j == 0 or last[j][0] < 0 or self.stays(last[j][0], t):
                    last[i] = (t, j)
                    break
        out, i = [], n
        while i:
            if last[i] is None:
                raise AssertionError(f"no path to {i} of {w[:50]!r}")
            t, j = last[i]
            out.append((t,) if t >= 0 else self.fallback(w[i - 1]))
            i = j
        return tuple(x for part in reversed(out) for x in part)

    def _sum_path(self, w: str) -> tuple[int, ...]:
        n, ids = len(w), self.ids
        worst = min(self.scores[i] for i in ids.values()) - 10
        cost: list[float] = [0.0] + [float("inf")] * n
        last: list[tuple[int, int]] = [(-1, 0)] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                t = ids.get(w[j:i])
                x = cost[j] - (self.scores[t] if t is not None else worst if j == i - 1 else float("-inf"))
                if x < cost[i]:
                    cost[i], last[i] = x, (-1 if t is None else t, j)
        out, i = [], n
        while i:
            t, j = last[i]
            out.append((t,) if t >= 0 else self.fallback(w[j:i]))
            i = j
        return tuple(x for part in reversed(out) for x in part)

    def normalise(self, text: str) -> str:
        return self.normaliser.apply(text)

    def learn(self, texts: list[list[str]]) -> None:
        """Paths of the words of a batch that are not in the table yet. A full table becomes the old one, from which words
        that still occur come back."""
        if self.held > KEPT_BYTES:
            self.old, self.words, self.held = self.words, {}, 0
        words, old = self.words, self.old
        by: dict[int, set] = {}
        for t in texts:
            for w in t:
                if w not in words and len(w) <= KEPT_CHARS:
                    if (p := old.get(w)) is not None:
                        words[w] = p
                        self.held += ENTRY_BYTES
                    else:
                        by.setdefault(len(w), set()).add(w)
        for new in by.values():
            new = list(new)
            self.held += ENTRY_BYTES * len(new)
            for i in range(0, len(new), TOGETHER):
                part = new[i : i + TOGETHER]
                words.update(zip(part, self.paths(part) if self.kind == BPE else map(self.path, part), strict=True))

    def forget(self) -> None:
        """Empties the tables that grow with the texts."""
        self.words, self.old, self.held = {}, {}, 0
        if self.kind == BPE:
            self.pair_keys, self.pair_ok = np.array([-1], np.int64), np.array([False])
            self.fresh = {}

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.WORD.findall(self.normalise(t)) if t else [] for t in texts]
        self.learn(cut)
        known = self.words
        return [np.frombuffer(b"".join([known[w] if w in known else self.path(w) for w in t]), np.int32) for t in cut]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        """The inverse machine: ids to pieces and bytes, marks to spaces, without the mark that the normaliser added."""
        ids = np.asarray(ids, np.int64)
        ids = ids[~self.is_control[ids]]
        of_byte = self.is_byte[ids]
        get = self.pieces.__getitem__
        if not of_byte.any():
            text = "".join(map(get, ids.tolist()))
        else:
            cuts = np.flatnonzero(np.diff(of_byte)) + 1
            runs = zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True)
            text = "".join([bytes(self.byte_of[ids[a:z]]).decode("utf-8", "replace") if of_byte[a] else "".join(map(get, ids[a:z].tolist())) for a, z in runs])
        text = text.replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_loaded: dict[str, Model] = {}


def load(data: bytes) -> Model:
    """The compiled model of each Python process; one file's at a time."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Model(data)
    return _loaded[key]


def compiled(sent, run):
    """``run(model, batches)`` for mapInArrow. What the model has learnt of the texts goes with the task, since an idle
    worker stays for a while and the next stage's run beside it."""

    def task(batches):
        m = load(sent.value)
        try:
            yield from run(m, batches)
        finally:
            m.forget()

    return lean(task)


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:  # read on the driver, sent to the tasks
        return f.read()


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, out: str = "token_ids", check: str | None = None) -> DataFrame:
    """docs and the ids of ``text``, and in ``check``, if given, whether decoding them gives the text; columns of these
    names are replaced."""
    docs = docs.drop(*[c for c in (out, check) if c is not None and c != text])
    at, sent = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model_bytes(model))  # the size of a model file

    def run(m, batches):
        for b in batches:
            for s in slices(b, at):
                texts = s.column(at).to_pylist()
                ids = m.encode_all(texts)
                more = [] if check is None else [pa.array([m.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*s.columns, lists(ids), *more], names=[*s.schema.names, out, *[check] * len(more)])

    made = [T.StructField(out, T.ArrayType(T.IntegerType())), *([] if check is None else [T.StructField(check, T.BooleanType())])]
    return docs.mapInArrow(compiled(sent, run), T.StructType([*docs.schema.fields, *made]))


def lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))


def decode(docs: DataFrame, ids: str = "token_ids", model: str = MODEL, out: str = "decoded") -> DataFrame:
    """docs and the text of ``ids``."""
    docs = docs.drop(out)
    at, sent = docs.columns.index(ids), docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(m, batches):
        for b in batches:
            texts = [m.decode(x.values.to_numpy()) if x.is_valid else None for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return docs.mapInArrow(compiled(sent, run), T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def slices(b: pa.RecordBatch, at: int, size: int = 4 << 20):
    """Pieces of a batch with about ``size`` bytes of text each, so that lists of ids stay small."""
    n = max(1, b.num_rows * size // max(size, b.column(at).nbytes))
    for i in range(0, b.num_rows, n):
        yield b.slice(i, n)


DIGEST = "doc_id bigint, n_tokens bigint, n_bytes bigint, ids_sha256 string, round_trip boolean"


def query(spark, sf_dir: str) -> DataFrame:
    """Per document: ids, those of single bytes, SHA-256 of the ids as little-endian 32-bit numbers, and whether decoding
    gives the text."""
    from pyspark.sql import functions as F

    from knowmill.llm.common import table

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text")
    sent = spark.sparkContext.broadcast(model_bytes())

    def run(m, batches):
        for b in (s for b in batches for s in slices(b, 1)):
            rows = []
            texts = b.column(1).to_pylist()
            for d, t, ids in zip(b.column(0).to_pylist(), texts, m.encode_all(texts), strict=True):
                rows.append((d, len(ids), int(m.is_byte[ids].sum()), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), m.decode(ids) == (t or "")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.mapInArrow(compiled(sent, run), DIGEST)
