"""Calls in source text: what a file calls, annotates and sets, as an array of structs.

The helper below knows strings, comments and brackets, nothing of frameworks; what a call means is decided by the plans that
read the array. The calls of PART characters of text, or of one file, are held at a time; those of a file are linear in its text.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: ``sep`` is "(" for calls and annotations, "[" for attributes without brackets, " " for statements, "=" for settings.
#: ``owner`` is what stands before the name: names, "new", "[", "#[", or "name()" for the call whose result is used.
#: ``receiver`` is the ``id`` of that call, ``parent`` that of the call in whose arguments it stands. Of ``args``, ``key`` is the name of a named one; lists and objects count as parts
#: of their argument; ``target`` is the name that the result is given to, ``type`` a word before the name, as in a method's
#: head; ``inner`` is the first call with "new" among its arguments. Ids are places in the array. ``kind``: text (starts with a string; ``whole`` if that is all), word (a dotted name) or code.
FACT = "id int, receiver int, parent int, line int, target string, type string, owner string, sep string, name string, args array<struct<pos:int,key:string,kind:string,value:string,whole:boolean,line:int>>, inner int"

# How languages write comments and strings, by file suffix.
HASH = {".py", ".rb", ".ex", ".exs"}
SLASH = {".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".go", ".rs", ".cs", ".php", ".java", ".kt", ".swift", ".prisma"}
ONE_QUOTE = {".go", ".rs", ".cs", ".java", ".kt", ".swift"}
BARE = {".rb", ".ex", ".exs"}

JOINS = (".", "::", "->", "?.")
CLOSES = {"(": ")", "[": "]", "{": "}"}


def lexer(suffix: str) -> re.Pattern:
    """Comments, strings, words and marks of a language; a character between single quotes is a mark where strings have none."""
    comments = [r"\#[^\n]*"] * (suffix in HASH) + [r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"] * (suffix not in HASH)
    strings = ['"""(?P<t3>.*?)"""', '"(?P<t2>(?:\\\\.|[^"\\\\])*)"', "`(?P<t4>(?:\\\\.|[^`\\\\])*)`"]
    single = [r"'(?:\\.|[^'\\\n])'"] if suffix in ONE_QUOTE else ["'''(?P<t5>.*?)'''", r"'(?P<t1>(?:\\.|[^'\\\n])*)'"]
    marks = {".py": "[frbuFRBU]*", ".rs": "[br]*", ".cs": "[$@]*"}.get(suffix, "")
    if suffix in ONE_QUOTE:
        single = [f"(?P<char>{single[0]})"]
    words = r"(?P<word>[@$]?[A-Za-z_]\w*[?!]?(?<![?!](?=[.=]))|\$)" if suffix in BARE else r"(?P<word>[@$]?[A-Za-z_]\w*|\$)"
    return re.compile(f"(?P<skip>{'|'.join(comments)})|(?P<text>{marks}(?:{'|'.join(strings + single)}))|{words}|(?P<mark>::|->|=>|==|\\?\\.|\\d[\\w.]*|\\S)", re.S)


LEXERS = {s: lexer(s) for s in HASH | SLASH}


def tokens(content: str, suffix: str):
    """(kind, text, line, whether it is the first of its line)."""
    line, at, last = 1, 0, 0
    for m in LEXERS.get(suffix, LEXERS[".js"]).finditer(content):
        line += content.count("\n", at, m.start())
        at = m.start()
        if m["skip"] is None:
            groups = m.groupdict() if m["text"] is not None else {}
            kind = "text" if groups and groups.get("char") is None else "word" if m["word"] is not None else "mark"
            yield kind, next((v for g, v in groups.items() if g[0] == "t" and g != "text" and v is not None), "") if kind == "text" else m[0], line, line != last
            last = line


class Frame:
    """An open bracket: its call (its own, or the one that it is a part of), and the argument that is being read."""

    __slots__ = ("mark", "call", "own", "pos", "key", "part", "first")

    def __init__(self, mark: str, call: dict | None, own: bool, pos: int = 0, key: str = ""):
        self.mark, self.call, self.own, self.pos, self.key, self.part, self.first = mark, call, own, pos, key, [], key


def finish(f: Frame) -> None:
    """The argument that ends here joins its call."""
    part, f.part = f.part, []
    if f.call is None or not part:
        return
    key = f.key
    if len(part) > 1 and part[0][0] in ("word", "text") and part[1][1] in ("=", ":", "=>"):
        key, part = part[0][1], part[2:]
    if part and part[0][1] not in CLOSES:
        kind = "text" if part[0][0] == "text" else "word" if all(k == "word" or t in JOINS for k, t, _ in part) else "code"
        value = part[0][1] if kind == "text" else "".join(" " * (k == b == "word") + t for (k, t, _), (b, _, _) in zip(part, [("", "", 0), *part[:-1]], strict=True))
        f.call["args"].append((f.pos, key, kind, value, len(part) == 1, part[0][2]))


def owner_of(seen: list, closed: dict, k: int) -> tuple[str, int, str]:
    """What stands before token k, the call whose result it is, and the name that is set to it."""
    names, call = [], None
    while k >= 1 and seen[k - 1][0] == "mark" and seen[k - 1][1] in JOINS:
        k -= 1
        if k < 1 or seen[k - 1][0] != "word":
            call = closed.get(k - 1)
            break
        k -= 1
        names.append(seen[k][1])
    before = lambda n: seen[k - n][1] if k >= n else ""
    if before(1) in ("new", "await"):
        names += ["new"] * (before(1) == "new" and not names)
        k -= 1
    elif not names and call is None and before(1) == "[":
        names = ["#[" if before(2) == "#" else "["]
    target = before(2) if before(1) == "=" and k >= 2 and seen[k - 2][0] == "word" else ""
    start = [f"{call['name']}()"] if call else []
    return ".".join(start + names[::-1]), call["id"] if call else -1, target


def name_before(seen: list) -> int:
    """The place of the name that an opening bracket follows, past one list of type parameters; -1 if there is none."""
    k = len(seen) - 1
    if k > 0 and seen[k][1] == ">":
        depth = 1
        while depth and k > 0 and seen[k - 1][1] not in (";", "(", ")", "{", "}"):
            k -= 1
            depth += (seen[k][1] == ">") - (seen[k][1] == "<")
        k = k - 1 if not depth else -1
    return k if k >= 0 and seen[k][0] == "word" else -1


def calls(path: str, content: str) -> list[tuple]:
    suffix = os.path.splitext(path)[1]
    seen: list[tuple] = []
    facts: list[dict] = []
    closed: dict[int, dict] = {}
    frames = [Frame("", None, False)]

    def fact(k: int, sep: str) -> dict:
        owner, receiver, target = owner_of(seen, closed, k)
        facts.append({"id": len(facts), "receiver": receiver, "parent": frames[-1].call["id"] if frames[-1].call else -1, "line": seen[k][2], "target": target, "type": seen[k - 1][1] if k and seen[k - 1][0] == "word" else "", "owner": owner, "sep": sep, "name": seen[k][1], "args": [], "inner": -1})
        if owner.endswith("new") and frames[-1].call and frames[-1].call["inner"] < 0:
            frames[-1].call["inner"] = len(facts) - 1
        return facts[-1]

    for kind, text, line, fresh in tokens(content, suffix):
        top, before = frames[-1], seen[-1] if seen else ("mark", "", 0)
        setting = before[1] == "=" and before[0] == "mark" and len(seen) > 1 and seen[-2][0] == "word"
        if setting and (kind == "text" or (kind == "word" and text not in ("new", "await"))):
            fact(len(seen) - 2, "=")["args"].append((0, "", kind, text, True, line))
        if suffix in BARE and kind == "text" and before[0] == "word" and not fresh:
            frames[-1].part = []
            frames.append(Frame(" ", fact(len(seen) - 1, " "), True))
            top = frames[-1]
        if fresh and top.mark == " " and before[1] != ",":
            finish(frames.pop())
            top = frames[-1]
        if kind == "mark" and text in CLOSES:
            k = name_before(seen) if text == "(" else -1
            if k >= 0:
                call = fact(k, "(")
                frames.append(Frame(text, call, True))
            else:
                body = text == "{" and before[1] in ("=>", ")", "->")
                part = top.part
                key = part[0][1] if len(part) > 1 and part[1][1] in ("=", ":", "=>") else top.key
                frames.append(Frame(text, None if body else top.call, False, top.pos, key))
            top.part.append((kind, text, line))
        elif kind == "mark" and text in CLOSES.values():
            while len(frames) > 1 and frames[-1].mark == " ":
                finish(frames.pop())
            if len(frames) > 1:
                finish(frames[-1])
                if CLOSES[frames[-1].mark] == text:
                    f = frames.pop()
                    if f.own:
                        closed[len(seen)] = f.call
            if text == "]" and len(seen) > 1 and before[0] == "word" and seen[-2][1] == "[":
                fact(len(seen) - 1, "[")
            frames[-1].part.append((kind, text, line))
        elif kind == "mark" and text in (",", ";"):
            finish(top)
            top.pos += top.own
        else:
            top.part.append((kind, text, line))
        seen.append((kind, text, line))
    for f in reversed(frames):
        finish(f)
    return [tuple(f[k] for k in ("id", "receiver", "parent", "line", "target", "type", "owner", "sep", "name", "args", "inner")) for f in facts]


#: Characters of text whose calls are held at once.
PART = 1 << 18
ARG = ("pos", "key", "kind", "value", "whole", "line")
NAMES = [c.split(" ")[0] for c in FACT.split(", ")]


def parts(texts: list[str | None], size: int):
    """(start, end) of stretches of about ``size`` characters, or of one longer text."""
    start = n = 0
    for i, t in enumerate(texts):
        n += len(t or "") + 1
        if n >= size:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def with_calls(files: DataFrame, size: int = PART) -> DataFrame:
    """The columns of files (path, content, ...) but the content, and ``_calls``: the facts of a file in the order of its text;
    null content has none, an open bracket or string ends with the file."""
    fact = T.ArrayType(T.StructType.fromDDL(FACT))
    kept = [f for f in files.schema.fields if f.name != "content"]

    def run(batches):
        kind = None
        for batch in batches:
            for start, end in parts(batch.column("content").to_pylist(), size):
                piece = batch.slice(start, end - start)
                found = []
                for p, c in zip(piece.column("path").to_pylist(), piece.column("content").to_pylist(), strict=True):
                    found.append([dict(zip(NAMES, (*f[:9], [dict(zip(ARG, a, strict=True)) for a in f[9]], *f[10:]), strict=True)) for f in calls(p or "", c or "")])
                if kind is None:
                    from pyspark.sql.pandas.types import to_arrow_type

                    kind = to_arrow_type(fact)
                yield pa.RecordBatch.from_arrays([*[piece.column(f.name) for f in kept], pa.array(found, kind)], names=[*[f.name for f in kept], "_calls"])

    return files.mapInArrow(run, T.StructType([*kept, T.StructField("_calls", fact)]))
