"""Scans: code trees, pages, JSON-lines logs, JSON documents, JDBC, and text of binary documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowmill.functions.paths import compile_glob, matches_any
from knowmill.functions.text import normalize_extracted

# Folders that scans leave out.
IGNORED = frozenset(("node_modules", ".git", "dist", "build", "out", "target", "vendor", "__pycache__", ".venv", "venv", ".next", ".cache", "coverage"))

EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("from", "to", "type", "provenance", "evidence", "source_file", "date")])
CALL = T.StructType([T.StructField("agent", T.StringType()), T.StructField("model", T.StringType()), T.StructField("tokens_in", T.DoubleType()), T.StructField("tokens_out", T.DoubleType()), T.StructField("cost_usd", T.DoubleType()), T.StructField("elapsed_ms", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("note", T.StringType())])
NUMBERS = ("cost_usd", "total_cost_usd", "tokens", "total_tokens", "tokens_in", "tokens_out", "duration_ms", "total_duration_ms", "total_duration_seconds", "reduction_ratio")
EVENT = T.StructType([T.StructField(n, T.StringType()) for n in ("ts", "op", "source", "agent")] + [T.StructField(n, T.DoubleType()) for n in NUMBERS] + [T.StructField("agent_calls", T.ArrayType(CALL))])


def list_files(spark: SparkSession, root: str) -> list[tuple[str, str, int, int]]:
    """(uri, path below the root, size, mtime in ms) of every file, hidden ones included, which Spark's readers pass over.
    The driver lists names; contents are read by tasks."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.resolvePath(top).toUri().getPath().rstrip("/") + "/"
    out, it = [], fs.listFiles(top, True)
    while it.hasNext():
        f = it.next()
        path = f.getPath().toUri().getPath()
        out.append((f.getPath().toString(), path.removeprefix(base), f.getLen(), f.getModificationTime()))
    return out


def read_bytes(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def scan_files(spark: SparkSession, root: str, patterns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(path, content, mtime, size) of text files below a root, without ignored folders; unreadable ones are left out."""
    rows = [(u, p, n, t) for u, p, n, t in list_files(spark, root) if not IGNORED & set(p.split("/")[:-1])]
    names = spark.createDataFrame(rows, "uri string, path string, size bigint, ms bigint")
    names = names.where(matches_any("path", patterns)) if patterns else names
    names = names if limit is None else names.orderBy("path").limit(limit)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples(index=False):  # a file at a time
                try:
                    text = read_bytes(r.uri).decode("utf-8", "replace")
                except OSError:
                    continue
                yield pd.DataFrame([(r.path, text, r.ms, r.size)], columns=["path", "content", "ms", "size"])

    parts = max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    read = names.repartition(parts).mapInPandas(run, "path string, content string, ms bigint, size bigint")
    return read.select("path", "content", F.timestamp_millis("ms").alias("mtime"), "size")


def targets(files: DataFrame, names: str | None, folders: list[str]) -> DataFrame:
    """Paths of top-level files whose name matches, and of all files in the named folders."""
    keep = F.lit(False)
    if names:
        keep = keep | (~F.col("path").contains("/") & F.col("path").rlike(names))
    for d in folders:
        keep = keep | F.col("path").startswith(d.rstrip("/") + "/")
    return files.where(keep).select("path").distinct().orderBy("path")


def ignore_rules(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """(dir, seq, regex, negated, folder) of every ignore file; a rule holds below its folder."""
    rows = files.where(F.substring_index("path", "/", -1) == name).select(F.regexp_replace("path", r"/?[^/]+$", "").alias("dir"), F.posexplode(F.split("content", r"\r?\n")).alias("seq", "line"))
    rows = rows.where(~F.trim("line").isin("") & ~F.col("line").startswith("#"))

    @F.pandas_udf("regex string, negated boolean")
    def compiled(lines: pd.Series) -> pd.DataFrame:
        out = []
        for line in lines:
            p = line.rstrip()
            negated = p.startswith("!")
            p = p.removeprefix("!")
            anchored = "/" in p.rstrip("/")
            body = compile_glob(p.strip("/"))[len("(?:^|/)") : -1]
            out.append((("^" if anchored else "(?:^|/)") + body + ("/" if p.endswith("/") else "(?:/|$)"), negated))
        return pd.DataFrame(out, columns=["regex", "negated"])

    return rows.withColumn("c", compiled("line")).select("dir", "seq", "c.regex", "c.negated")


def without_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that no ignore file ignores. Within one file the last matching rule counts; a deeper file never takes back.
    Folders above a file are its join keys, so a rule meets only what lies below it."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    each = files.select("path", F.explode(dirs).alias("dir")).withColumn("below", F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)")))
    hit = each.join(rules, "dir").where(F.expr("below rlike regex")).groupBy("path", "dir").agg(F.max_by("negated", "seq").alias("negated"))
    return files.join(hit.where(~F.col("negated")).select("path").distinct(), "path", "left_anti")


def split_frontmatter() -> tuple[Column, Column]:
    """YAML text (null unless the file begins with "---" and a line feed) and body."""
    whole = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
    c = F.coalesce("content", F.lit(""))
    return F.when(c.rlike(whole), F.regexp_extract(c, whole, 1)), F.when(c.rlike(whole), F.regexp_extract(c, whole, 2)).otherwise(c)


@F.pandas_udf(T.StringType())
def yaml_json(text: pd.Series) -> pd.Series:
    """YAML mappings as JSON; null for anything else. Dates become ISO texts."""
    import json

    import yaml

    def one(t):
        try:
            x = yaml.safe_load(t) if t is not None else None
        except yaml.YAMLError:
            return None
        return json.dumps(x, default=str, ensure_ascii=False) if isinstance(x, dict) else None

    return text.map(one)


def pages(files: DataFrame, archived: bool = False) -> DataFrame:
    """(path, content, fm, body) of pages: live ones lie in no folder that begins with an underscore."""
    md = files.where(F.col("path").endswith(".md"))
    md = md.where(F.col("path").rlike("(^|/)_archive/")) if archived else md.where(~F.col("path").rlike("(^|/)_[^/]*/"))
    head, body = split_frontmatter()
    out = md.select("path", "content", yaml_json(head).alias("fm"), body.alias("body"))
    return out.select("path", "content", "fm", F.when(F.col("fm").isNull(), F.col("content")).otherwise(F.col("body")).alias("body")).orderBy("path")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of the lines of one log, or of logs in order of name; pos counts all lines before, and so does not hang on
    how files are split. A split is known by its file and first byte; its lines are counted first, and a line's place in it
    follows from the rows' ids, which a task gives one after another. One row for each split comes back to be summed up."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_file", "_from").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).collect()
    starts, at = [], 0
    for r in sorted(splits, key=lambda r: (r._file, r._from)):
        starts.append((r._file, r._from, at - r._first))
        at += r._n
    offsets = spark.createDataFrame(starts, "_file string, _from bigint, _shift bigint")
    placed = lines.join(F.broadcast(offsets), ["_file", "_from"])  # a row for each split
    return placed.where(F.trim("value") != "").select((F.col("_id") + F.col("_shift")).alias("pos"), "value")


def edge_log(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a log with ``ord`` and the raw record; a malformed line fails the scan."""
    rows = numbered_lines(spark, path).select(F.col("pos").alias("ord"), F.col("value").alias("raw"), F.from_json("value", EDGE, {"mode": "FAILFAST"}).alias("e"))
    return rows.select("ord", "e.*", "raw")


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a log; malformed lines are left out."""
    rows = numbered_lines(spark, path).where(F.try_parse_json("value").isNotNull())
    return rows.select("pos", F.from_json("value", EVENT).alias("e"), F.col("value").alias("raw")).where("e is not null").select("pos", "e.*", "raw")


def json_document(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """A JSON document as one row; none if it is malformed or a required field is missing."""
    df = spark.read.schema(schema.add("_bad", T.StringType()) if "_bad" not in schema.names else schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    ok = F.col("_bad").isNull()
    for r in required:
        ok = ok & F.col(r).isNotNull()
    return df.where(ok).drop("_bad")


def changed_since(changes: DataFrame, since: str | None) -> DataFrame:
    """Distinct paths of changes (path, ts) from a time on."""
    c = changes if since is None else changes.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return c.select("path").distinct().orderBy("path")


def jdbc(spark: SparkSession, url: str, query: str, rows: int = 1000, timeout: int = 30, **options) -> DataFrame:
    """A query against a database, one row more than asked for so that a cut can be told."""
    return spark.read.format("jdbc").options(url=url, query=query, queryTimeout=timeout, **options).load().limit(rows + 1)


NS = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join("".join(t.text or "" for t in p.iter(f"{WORD_NS}t")) for p in root.iter(f"{WORD_NS}p"))


def pptx_text(data: bytes) -> str:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in slides:
            paragraphs = ["".join(t.text or "" for t in p.iter(f"{NS}t")) for p in ElementTree.fromstring(z.read(name)).iter(f"{NS}p")]
            out.append(f"## Slide {number}\n\n" + "\n".join(p for p in paragraphs if p.strip()))
    return "\n\n".join(out)


def pdf_text(data: bytes) -> str:
    from pypdf import PdfReader  # optional

    return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)


READERS = {"docx": docx_text, "pptx": pptx_text, "pdf": pdf_text}


def document_text(files: DataFrame) -> DataFrame:
    """(path, text, error) of binary documents (path, content) by extension; one file is in memory at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content in zip(p["path"], p["content"], strict=True):
                read = READERS.get(path.rsplit(".", 1)[-1].lower())
                try:
                    rows.append((path, read(bytes(content)) if read else None, None if read else "unsupported format"))
                except Exception as e:  # noqa: BLE001  a damaged file is a row, not a failure
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    out = files.select("path", "content").mapInPandas(run, "path string, text string, error string")
    return out.select("path", F.when(F.col("text").isNotNull(), normalize_extracted("text")).alias("text"), "error")


def media_kind(source: Column) -> Column:
    """How a multimodal source would be read, by its address or extension."""
    low = F.lower(source)
    return F.when(low.rlike(r"^https?://(www\.)?(youtube\.com|youtu\.be)/"), "youtube").when(low.rlike(r"\.(png|jpe?g|gif|webp|bmp|svg)$"), "vision").when(low.rlike(r"\.(mp3|wav|m4a|flac|ogg|mp4|mov|mkv|webm|avi)$"), "audio_video").otherwise("skipped")


def repo_root(start: str) -> str | None:
    """The nearest folder at or above ``start``, on the driver, that has a .git entry."""
    import os

    at = os.path.abspath(start)
    while not os.path.exists(os.path.join(at, ".git")):
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)
    return at
