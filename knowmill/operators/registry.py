"""Sources to connectors: patterns over hosts and paths, then schemes; the more specific wins, then the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.functions.paths import DB_SCHEMES, has_prefix

# Connectors with their schemes and (host, path prefix, path part).
CONNECTORS = (
    ("jira", ("jira://",), (("*.atlassian.net", "/browse/", ""),)),
    ("confluence", ("confluence://",), (("*.atlassian.net", "/wiki/", ""), ("*.atlassian.net", "", "/spaces/"))),
    ("github", ("gh://", "github://"), (("github.com", "", ""), ("*.github.com", "", ""))),
    ("notion", ("notion://",), (("notion.so", "", ""), ("*.notion.site", "", ""))),
    ("gcp", ("gcp://",), (("*.cloud.google.com", "", ""), ("*.googleapis.com", "", ""))),
    ("aws", ("aws://",), (("*.amazonaws.com", "", ""), ("*.aws.amazon.com", "", ""))),
    ("gitlab", ("gitlab://",), (("gitlab.com", "", ""), ("*.gitlab.com", "", ""))),
    ("linear", ("linear://",), (("linear.app", "", ""),)),
    ("db", ("db://",), ()),
)


def host_fits(pattern: str, host: Column) -> Column:
    if pattern.startswith("*."):
        return host.endswith(pattern[1:]) | (host == pattern[2:])
    return host == pattern


def connector(source: Column, connectors=CONNECTORS) -> Column:
    """The connector of a source, null without one. The table is a parameter of the plan, so this is one expression."""
    s = F.trim(source)
    host = F.lower(F.regexp_extract(s, r"(?i)^https?://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    path = F.regexp_extract(s, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    scheme = F.concat(F.lower(F.regexp_extract(s, r"(?i)^([a-z]+)://", 1)), F.lit("://"))
    web = s.rlike(r"(?i)^https?://")
    first: list[tuple[Column, str]] = []
    for name, _, urls in connectors:
        first += [(web & host_fits(h, host) & (path.startswith(p) if p else path.contains(c)), name) for h, p, c in urls if p or c]
    for name, _, urls in connectors:
        first += [(web & host_fits(h, host), name) for h, p, c in urls if not p and not c]
    for name, schemes, _ in connectors:
        first += [(~web & scheme.isin(*schemes), name)]
    out = None
    for cond, name in first:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def classify(source: Column, connectors=CONNECTORS) -> Column:
    """The connector, "db" for a database address, or empty."""
    return F.coalesce(connector(source, connectors), F.when(has_prefix(F.trim(source), DB_SCHEMES), "db"), F.lit(""))


def deeper(source: Column, connectors=CONNECTORS) -> Column:
    """connector, external, code or file; null for an empty source."""
    s = F.trim(source)
    code = s.rlike(r"(?i)\.(ts|tsx|js|jsx|py|java|kt|go|rs|rb|cs|php|swift|sql)$")
    return F.when(s == "", F.lit(None).cast("string")).when(connector(s, connectors).isNotNull(), "connector").when(s.rlike("(?i)^https?://"), "external").when(code, "code").otherwise("file")


def with_connector(df: DataFrame, column: str = "source") -> DataFrame:
    return df.withColumn("connector", classify(F.col(column)))


def deeper_rows(sources: DataFrame, enabled: tuple[str, ...] | None = None) -> DataFrame:
    """(source, kind, connector, hint) for sources (ord, source): each once, but those of a disabled connector always, as hints."""
    r = sources.withColumn("kind", deeper(F.col("source"))).withColumn("connector", connector(F.col("source"))).where(F.col("kind").isNotNull())
    off = F.col("connector").isNotNull() & ~F.col("connector").isin(*enabled) if enabled is not None else F.lit(False)
    r = r.withColumn("hint", off)
    once = r.where(~F.col("hint")).groupBy("source").agg(F.min_by(F.struct("ord", "kind", "connector"), "ord").alias("x")).select("x.ord", "source", "x.kind", "x.connector", F.lit(False).alias("hint"))
    return once.unionByName(r.where("hint").select("ord", "source", "kind", "connector", "hint")).orderBy("ord").select("source", "kind", "connector", "hint")
