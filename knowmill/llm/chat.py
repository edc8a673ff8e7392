"""Chat formatting with a grammar round trip.

    conversation = turn*          turn = "### " role ": " text "</turn>" LF

The parser is deterministic and strict: it reads a role up to the first ": " and a text up to the first "</turn>", which a
line feed must follow; a "### " anywhere else in a turn is an error. It then takes one backslash out of each "<\\.../turn>"
and "\\...### " of the text, and the "%" escapes out of the role. A turn is first rendered as it is; if the parser does not
recover it, its control strings are escaped, in the text and then in the role too, until it does. So no text of the output
holds a bare "</turn>" or "### ".

Rendering is done where the rows lie. Conversations are then gathered by id, sorted and streamed, so that even one with
a third of all turns needs the memory of one part only: an output row holds whole turns up to PART_CHARS, and a longer
conversation has several parts.

Null text or role: empty. Turns are ordered by turn (null first), then role and text; repeated rows are all kept. Rows
with a null id form a conversation of their own. Empty table: empty result. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, END = "### ", "</turn>"
PART_CHARS = 1 << 20
#: Control strings with the backslashes before them; each start is tried once, so long runs of backslashes cost no more.
STUFF = ((re.compile(r"<(\\*+)/turn>"), r"<\\\1/turn>"), (re.compile(r"(?<!\\)(\\*+)### "), r"\\\1### "))
UNSTUFF = ((re.compile(r"<\\(\\*+)/turn>"), r"<\1/turn>"), (re.compile(r"(?<!\\)\\(\\*+)### "), r"\1### "))
BARE = re.compile(r"(?<!\\)### ")
ROLE = {"%": "%p", ":": "%c", "\n": "%n", "#": "%h", "<": "%l"}
ROLE_BACK = {v[1]: k for k, v in ROLE.items()}


def substituted(text: str, rules) -> str:
    for pattern, by in rules:
        text = pattern.sub(by, text)
    return text


def unescape(text: str) -> str:
    return substituted(text, UNSTUFF)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, from, to) of each turn; from and to bound the text as it stands."""
    out, at = [], 0
    while at < len(text):
        colon = text.index(": ", at + len(MARK))
        end = text.index(END, colon + 2)
        role, body = text[at + len(MARK) : colon], text[colon + 2 : end]
        if not text.startswith(MARK, at) or not text.startswith(END + "\n", end) or MARK in role or END in role or BARE.search(body):
            raise ValueError(f"no turn at {at}")
        out.append((re.sub("%([pcnhl])", lambda m: ROLE_BACK[m[1]], role), unescape(body), colon + 2, end))
        at = end + len(END) + 1
    return out


def recovered(piece: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(piece)] == [(role, text)]
    except ValueError:
        return False


def render(role: str, text: str) -> str:
    stuffed = substituted(text, STUFF)
    for a, b in ((role, text), (role, stuffed), ("".join(ROLE.get(c, c) for c in role), stuffed)):
        piece = f"{MARK}{a}: {b}{END}\n"
        if recovered(piece, role, text):
            return piece
    raise AssertionError("the escapes are not reversible")


PIECES = "conv_id bigint, turn bigint, role string, text string, piece string"


def pieces(conversations: DataFrame) -> DataFrame:
    """A rendered piece for each row."""
    full = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), full("role"), full("text"))

    def run(batches):
        for b in batches:
            made = [render(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "piece"])

    return rows.mapInArrow(run, PIECES)


PARTS = "conv_id bigint, part bigint, formatted string, mask array<array<bigint>>"


def format_conversations(conversations: DataFrame, loss_role: str = "assistant", part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, formatted, mask): the text of each conversation and the [from, to) spans that count for the loss."""
    rows = pieces(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "piece")

    def run(batches):
        conv, part, held, mask, size, any_ = None, 0, [], [], 0, False
        ready: list[tuple] = []
        mass = 0
        for b in batches:
            for c, role, piece in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if any_ and (c != conv or size + len(piece) > part_chars):
                    ready.append((conv, part, "".join(held), mask))
                    mass += size
                    part, held, mask, size = (part + 1 if c == conv else 0), [], [], 0
                conv, any_ = c, True
                if role == loss_role:
                    _, _, a, z = parse(piece)[0]
                    mask.append([size + a, size + z])
                held.append(piece)
                size += len(piece)
                if mass >= 8 << 20:
                    yield batch(ready)
                    ready, mass = [], 0
        if any_:
            ready.append((conv, part, "".join(held), mask))
        yield batch(ready)

    def batch(ready):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in ready], t) for k, t in enumerate(kinds)], names=["conv_id", "part", "formatted", "mask"])

    return rows.mapInArrow(run, PARTS)


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of what the parser finds in the parts, which must come as format_conversations leaves them: whole
    conversations in a partition, in order."""

    def run(batches):
        state, ready = None, []
        for b in batches:
            for c, part, text, mask in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if part == 0:
                    if state:
                        ready.append(close(state))
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, t, _, _ in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{t}\n".encode())
                for a, z in mask:
                    t = unescape(text[a:z])
                    state[3] += len(t)
                    state[4].update(t.encode())
                state[5] += len(text)
            yield batch(ready)
            ready = []
        yield batch([close(state)] if state else [])

    def close(s):
        return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

    def batch(ready):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in ready], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in READ.split(", ")])

    return parts.mapInArrow(run, READ)


#: The conversation that the contract adds.
PLANTED = r"\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    from knowmill.llm.common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_conversations(rows.unionByName(extra)))


def oracle() -> str:
    return rf"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
    r AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '(\\*)### ', '\\\1### ', 'g') AS e FROM c)
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(4 + length(role) + 2 + length(e) + 8)::BIGINT AS formatted_chars
    FROM r GROUP BY conv_id"""
