"""Column expressions over paths, URLs and service references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HTTP_VERBS = "get|post|put|delete|patch|head|options"
# Schemes of databases, of remote sources, and of synthetic graph nodes.
DB_SCHEMES = ("jdbc:", "postgres://", "postgresql://", "mysql://", "mariadb://", "mongodb://", "mongodb+srv://", "redis://", "rediss://", "oracle:", "sqlserver://", "jdbc:sqlserver", "r2dbc:")
REMOTE_SCHEMES = ("http:", "https:", "jira:", "github:", "confluence:", "notion:", "aws:", "gcp:")
SYNTHETIC = ("ext:", "queue:", "table:", "auth:")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def some(x: Column) -> Column:
    """Null for an empty string."""
    return F.when(x != "", x)


def normalize_path(raw) -> Column:
    """A route without authority, query and fragment, every parameter segment as "{}"."""
    p = F.regexp_replace(F.trim(col(raw)), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+", "")
    p = F.regexp_replace(p, r"[?#].*$", "")
    whole = r"^(\{.*\}|:.+|\$\{.*\}|<.*>|\[.*\])$"
    part = lambda s: F.when(s.rlike(whole) | (s.rlike(r"[{:<\[]") & s.rlike(r"[}>\]]")), F.lit("{}")).otherwise(s)
    segments = F.transform(F.filter(F.split(p, "/"), lambda s: s != ""), part)
    return F.when(p == "", F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(segments, "/")))


def path_matches(client, endpoint) -> Column:
    """Equal segment counts, and each endpoint segment is "{}" or equals the client's. Not symmetric."""
    c, e = F.split(col(client), "/"), F.split(col(endpoint), "/")
    same = F.forall(F.zip_with(c, e, lambda x, y: (y == "{}") | x.eqNullSafe(y)), lambda b: b)
    return (F.size(c) == F.size(e)) & same


def ext_host(ref) -> Column:
    """First label of an authority, or the key of a leading placeholder; empty otherwise."""
    r = col(ref)
    key = some(F.regexp_extract(r, r"^\$\{([\w.-]+)\}", 1))
    host = some(F.regexp_extract(r, r"^[a-zA-Z][\w+.-]*://([^/:?#]+)", 1))
    return F.coalesce(key, host, F.lit(""))


def url_host(raw) -> Column:
    """Authority of an absolute URL, with its port."""
    return F.regexp_extract(col(raw), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)


def http_verb(raw) -> Column:
    return F.upper(F.regexp_extract(F.lower(col(raw)), rf"^({HTTP_VERBS})", 1))


def looks_like_url_or_path(p) -> Column:
    x = col(p)
    return x.contains("/") | x.rlike(r"(?i)^https?:") | x.startswith("${")


def concat_prefix(prefix, path) -> Column:
    """Prefix and path with one slash between them, whatever the path begins with."""
    a, b = F.regexp_replace(F.coalesce(col(prefix), F.lit("")), "/+$", ""), F.regexp_replace(col(path), "^/+", "")
    return F.when(F.coalesce(col(prefix), F.lit("")) == "", col(path)).otherwise(F.concat(a, F.lit("/"), b))


def resolve_path(path, prefix) -> Column:
    """An absolute path as it is, others under the file's prefix."""
    p = col(path)
    return F.when(p.startswith("/") | F.coalesce(col(prefix), F.lit("")).eqNullSafe(F.lit("")), p).otherwise(concat_prefix(prefix, path))


def service_aliases(service_id) -> Column:
    """Short forms of a service id and its "-service.url" keys, without the id itself."""
    i = col(service_id)
    short = F.regexp_replace(i, r"(?i)-(module|service|svc|orchestrator|api|app)$", "")
    return F.array_except(F.array_distinct(F.array(F.concat(short, F.lit("-service.url")), F.concat(i, F.lit("-service.url")), short)), F.array(i))


def candidates(ref) -> Column:
    """Lower-case names that a client's reference may stand for."""
    r = F.coalesce(col(ref), F.lit(""))
    key = F.regexp_extract(r, r"^\$\{([\w.-]+)\}", 1)
    url = r"^[a-zA-Z][\w+.-]*://([^/]+)(/[^?#]*)?"
    label = F.substring_index(F.substring_index(F.regexp_extract(r, url, 1), ":", 1), ".", 1)
    bare = F.regexp_replace(F.regexp_replace(label, "^app-", ""), "-(api|svc|service)$", "")
    tail = F.when(r.rlike(r"^[a-zA-Z][\w+.-]*://[^/]+"), F.regexp_extract(r, url, 2)).otherwise(r)
    seg = F.regexp_extract(tail, r"/api/([\w-]+)", 1)
    names = F.array(r, key, F.regexp_replace(key, r"(?i)\.(url|uri|host|endpoint)$", ""), label, bare, seg)
    return F.array_distinct(F.transform(F.filter(names, lambda x: x != ""), lambda x: F.lower(x)))


def excluded_node(node) -> Column:
    """Whether a directory of the path begins with an underscore; the last component is exempt."""
    return F.replace(col(node), F.lit("\\"), F.lit("/")).rlike(r"(^|/)_[^/]*/")


def hostname_matches(pattern, host) -> Column:
    p, h = col(pattern), col(host)
    return (p == h) | (p.startswith("*.") & (h.endswith(F.substring(p, 2, 10_000)) | (h == F.substring(p, 3, 10_000))))


def has_prefix(x, prefixes) -> Column:
    """Case-insensitive test for one of the given prefixes."""
    low, out = F.lower(col(x)), F.lit(False)
    for p in prefixes:
        out = out | low.startswith(p)
    return out


def is_synthetic(node) -> Column:
    return has_prefix(node, SYNTHETIC)


def table_key(schema, name) -> Column:
    return F.concat_ws(".", some(F.coalesce(col(schema), F.lit(""))), col(name))


def topic_of(path) -> Column:
    """The component after a source root, canonical; null unless another component follows."""
    t = F.regexp_extract(col(path), r"(?:^|/)(?:src|app|apps|services|lib|internal|pkg|packages|modules|cmd)/([^/]+)/.", 1)
    return some(canonical_topic(t))


def canonical_topic(raw) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(raw)), r"[_\s]+", "-"), "-(service|svc|module)$", "")


def ancestors(path) -> Column:
    """The path itself and every directory above it; a prefix join becomes an equality join on these."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def compile_glob(pattern: str) -> str:
    """A glob as an expression that is anchored at the end, and at the beginning or a slash."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + pattern[i] if pattern[i] in ".+^${}()|[]\\" else pattern[i]), i + 1
    return f"(?:^|/){out}$"


def matches_any(path, patterns) -> Column:
    return F.replace(col(path), F.lit("\\"), F.lit("/")).rlike("|".join(map(compile_glob, patterns))) if patterns else F.lit(False)
