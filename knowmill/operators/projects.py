"""Project metadata from manifests, and the states of benchmark runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowmill.functions.text import maven_id

# Manifests in order of precedence, and run states.
ORDER = ("package.json", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts")
#: Properties of a pom that name the Java version.
JDK = ("java.version", "maven.compiler.target", "maven.compiler.release")
TRANSIENT, TERMINAL = ("running", "error", "rate-limited"), ("passed", "failed", "ran")


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "version", "runtime", "note")]))
def toml_fields(kind: pd.Series, text: pd.Series) -> pd.DataFrame:
    """Name, version and runtime of TOML manifests; a note where one cannot be read."""
    import tomllib

    out = []
    for k, t in zip(kind, text, strict=True):
        try:
            x = tomllib.loads(t) if k.endswith(".toml") else {}
        except tomllib.TOMLDecodeError as e:
            out.append((None, None, None, f"{k} unparseable: {e}"))
            continue
        p = {**x.get("tool", {}).get("poetry", {}), **x.get("project", {})} if k == "pyproject.toml" else x.get("package", {})
        s = lambda v: v if isinstance(v, str) and v else None
        rust = s(p.get("rust-version"))
        out.append((s(p.get("name")), s(p.get("version")), "python" if k == "pyproject.toml" else f"rust@{rust}" if rust else "rust", None))
    return pd.DataFrame(out, columns=["name", "version", "runtime", "note"])


def metadata(files: DataFrame) -> DataFrame:
    """(name, version, language, runtime, manifests, notes) of files at the top: the first manifest that has a value gives it."""
    language = F.create_map(*[F.lit(x) for kv in {"package.json": "typescript", "pyproject.toml": "python", "go.mod": "go", "Cargo.toml": "rust", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java"}.items() for x in kv])
    m = files.where(F.col("path").isin(*ORDER)).select("path", "content", (F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("path")) - 1).alias("ord"), toml_fields("path", "content").alias("t"))
    c, get = F.col("content"), lambda p: F.get_json_object("content", p)
    found = lambda r: F.nullif(F.regexp_extract(c, r, 1), F.lit(""))
    js, go, pom = F.col("path") == "package.json", F.col("path") == "go.mod", F.col("path") == "pom.xml"
    bad = F.when(js & F.try_parse_json(c).isNull(), "package.json unparseable").otherwise(F.col("t.note"))
    major = F.nullif(F.regexp_extract(get("$.engines.node"), r"(\d+)", 1), F.lit(""))
    version = F.nullif(maven_id("content", "version"), F.lit(""))
    jdk = found("<(?:" + "|".join(x.replace(".", "[.]") for x in JDK) + ")>" + r"\s*([0-9.]+)")
    rows = m.select(
        "path",
        "ord",
        bad.alias("note"),
        F.when(js, get("$.name")).when(go, found(r"(?m)^module\s+(\S+)")).when(pom, F.nullif(maven_id("content"), F.lit(""))).otherwise(F.col("t.name")).alias("name"),
        F.when(js, get("$.version")).when(pom, version).otherwise(F.col("t.version")).alias("version"),
        F.when(js, F.coalesce(F.concat(F.lit("node@"), major), F.lit("node"))).when(go, F.coalesce(F.concat(F.lit("go@"), found(r"(?m)^go\s+([\d.]+)")), F.lit("go"))).when(pom, F.coalesce(F.concat(F.lit("java@"), jdk), F.lit("java"))).when(F.col("path").startswith("build.gradle"), "java").otherwise(F.col("t.runtime")).alias("runtime"),
        F.element_at(language, F.col("path")).alias("language"),
    )
    good = F.col("note").isNull()
    first = lambda v: F.min_by(v, F.when(good & F.col(v).isNotNull(), F.col("ord")))
    return rows.agg(
        F.coalesce(first("name"), F.lit("")).alias("name"),
        F.coalesce(first("version"), F.lit("")).alias("version"),
        F.coalesce(first("language"), F.lit("unknown")).alias("language"),
        F.coalesce(first("runtime"), F.lit("")).alias("runtime"),
        F.transform(F.array_sort(F.collect_list(F.when(good, F.struct("ord", "path")))), lambda x: x["path"]).alias("manifests"),
        F.array_sort(F.collect_list("note")).alias("notes"),
    )


def loaded_runs(runs: DataFrame) -> DataFrame:
    """Runs as they are taken up again: what was under way is pending."""
    return runs.withColumn("status", F.when(F.col("status").isin(*TRANSIENT), "pending").otherwise(F.col("status")))


def set_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Runs (issue, arm, status, ...) with new records; an error where one would replace a finished run."""
    j = new.join(runs.select("issue", "arm", F.col("status").alias("_was")), ["issue", "arm"], "left")
    said = F.concat_ws(" ", F.lit("refusing to overwrite run"), F.col("issue").cast("string"), "arm", "_was")
    ok = j.withColumn("status", F.when(F.coalesce(F.col("_was").isin(*TERMINAL), F.lit(False)), F.raise_error(said)).otherwise(F.col("status"))).drop("_was")
    return runs.join(new.select("issue", "arm"), ["issue", "arm"], "left_anti").unionByName(ok)
