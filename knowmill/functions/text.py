"""Column expressions over texts, numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knowmill.functions.paths import col, some


def snake_case(name) -> Column:
    return F.lower(F.regexp_replace(col(name), r"(?<=[a-z0-9])([A-Z])", "_$1"))


def class_to_table(name, convention) -> Column:
    n, c = col(name), col(convention)
    return F.when(c == "snake_case", snake_case(n)).when(c == "snake_case_plural", F.concat(snake_case(n), F.lit("s"))).when(c == "lower_case", F.lower(n)).otherwise(n)


def content_hash(text) -> Column:
    return F.sha2(F.coalesce(col(text), F.lit("")).cast("binary"), 256)


def validation_key(page_hash, source_hash) -> Column:
    return F.sha2(F.concat_ws(":", col(page_hash), col(source_hash)).cast("binary"), 256)


def round2(x) -> Column:
    """floor(100 x + 0.5) / 100, which is not round(x, 2)."""
    return F.floor(col(x) * 100 + 0.5) / 100


def percent_half_even(rate) -> Column:
    return F.bround(col(rate) * 100).cast("bigint")


def fixed_half_even(x, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(col(x) * 10.0**digits) / 10.0**digits)


def thousands(x) -> Column:
    return F.format_number(col(x), 0)


def truncate_summary(raw, limit: int) -> Column:
    s = F.trim(F.regexp_replace(F.coalesce(col(raw), F.lit("")), r"\s+", " "))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…")))


def word_count(text) -> Column:
    return F.size(F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda w: w != ""))


def page_links(content) -> Column:
    """Every target of a markdown link."""
    return F.regexp_extract_all(F.coalesce(col(content), F.lit("")), F.lit(r"\[.*?\]\(([^)]+)\)"), 1)


def crossref_links(body) -> Column:
    """Targets of links to other pages."""
    return F.filter(page_links(body), lambda x: ~x.startswith("http") & ~x.startswith("#") & x.endswith(".md"))


def resolve_link(page, link) -> Column:
    """A link from a page as a path; each ".." takes the component before it."""
    base = F.regexp_replace(col(page), r"[^/]*$", "")
    parts = F.filter(F.split(F.when(col(link).startswith("/"), col(link)).otherwise(F.concat(base, col(link))), "/"), lambda x: (x != "") & (x != "."))
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    done = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(col(page).startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(done, "/"))


def normalize_extracted(text) -> Column:
    """No spaces at line ends, at most one empty line, trimmed."""
    t = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[ \t\r\f\x0B]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_pr_template(body) -> Column:
    """Without comments, an impact section and what follows it, and checklists."""
    t = F.regexp_replace(F.coalesce(col(body), F.lit("")), r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?im)^#{1,6}\s+Impact\b[\s\S]*\z", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*[-*]\s+\[[ xX]\].*$", "")
    return normalize_extracted(t)


def redact_credentials(url) -> Column:
    return F.regexp_replace(col(url), r"(://)[^/@\s]*@", "$1")


def escape_label(label) -> Column:
    """Characters that a diagram label cannot hold, as references."""
    out = col(label)
    for c, ref in (("&", "&amp;"), ('"', "&quot;"), ("|", "&#124;"), ("[", "&#91;"), ("]", "&#93;"), ("{", "&#123;"), ("}", "&#125;")):
        out = F.replace(out, F.lit(c), F.lit(ref))
    return F.regexp_replace(out, r"[\r\n]+", " ")


def node_id(raw) -> Column:
    x = F.regexp_replace(F.regexp_replace(col(raw), "[^A-Za-z0-9_]", "_"), "_+", "_")
    return F.when(x.rlike("^[0-9]"), F.concat(F.lit("_"), x)).otherwise(x)


def iso_timestamp(s) -> Column:
    """Null where the text is no timestamp."""
    return F.try_to_timestamp(col(s))


def format_iso(ts) -> Column:
    """UTC with "+00:00"; microseconds only if there are any."""
    t = col(ts)
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(t, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(t, "SSSSSS"))).otherwise(F.lit("")), F.lit("+00:00"))


def since(text, now) -> Column:
    """A duration of days, hours or minutes before ``now``, or the timestamp that the text is."""
    t, n = col(text), col(now)
    num = F.regexp_extract(t, r"^(\d+)[dhm]$", 1).try_cast("int")
    back = F.make_dt_interval(F.when(t.endswith("d"), num).otherwise(0), F.when(t.endswith("h"), num).otherwise(0), F.when(t.endswith("m"), num).otherwise(0))
    return F.when(num.isNotNull(), n - back).otherwise(iso_timestamp(t))


def brackets_balanced(text) -> Column:
    """A stack fold over the brackets of a text; quotes do not hide brackets."""
    chars = F.split(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[^\[\](){}]", ""), "")
    pair = F.create_map(*[F.lit(x) for x in (")", "(", "]", "[", "}", "{")])
    step = lambda s, c: F.when(c == "", s).when(s == "!", s).when(c.isin("(", "[", "{"), F.concat(s, c)).when(F.right(s, F.lit(1)) == F.element_at(pair, c), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(F.lit("!"))
    return F.aggregate(chars, F.lit(""), step) == ""


def tldr(body) -> Column:
    """The text of the TL;DR section, up to the next section or the end."""
    return F.trim(F.regexp_extract(F.coalesce(col(body), F.lit("")), r"(?s)(?:^|\n)## TL;DR[^\n]*\n(.*?)(?=\n## |$(?!.))", 1))


def splice_block(existing: Column, block: Column, start: str, end: str) -> Column:
    """``existing`` with what stands between the markers replaced, or the block appended."""
    a, z = F.instr(existing, start), F.instr(existing, end)
    inner = F.concat(F.lit(start + "\n"), block, F.lit("\n" + end))
    swapped = F.concat(F.substring(existing, F.lit(1), a - 1), inner, F.substring(existing, z + len(end), F.length(existing)))
    appended = F.concat(F.regexp_replace(existing, r"\s+$", ""), F.lit("\n\n"), inner, F.lit("\n"))
    return F.when((a > 0) & (z > a), swapped).otherwise(appended)


# Characters that a quoted label of a phase cannot hold.
PHASE_MARKS = (("&", "&amp;"), ('"', "&quot;"), ("|", "&#124;"), ("[", "&#91;"), ("]", "&#93;"), ("{", "&#123;"), ("}", "&#125;"))


def phase_label(label) -> Column:
    """A label for a quoted box: marks as references, line ends as breaks."""
    c = col(label)
    for mark, reference in PHASE_MARKS:
        c = F.replace(c, F.lit(mark), F.lit(reference))
    return F.regexp_replace(c, "\r\n|\n|\r", "<br/>")


def maven_own(pom) -> Column:
    return F.regexp_replace(col(pom), r"(?si)<parent>.*?</parent>", "")


def maven_id(pom, tag: str = "artifactId") -> Column:
    """The first artifact or group id that does not belong to the parent or a dependency before it."""
    return F.trim(F.regexp_extract(maven_own(pom), rf"(?i)<{tag}>\s*([^<\s]+)\s*</{tag}>", 1))


def maven_aggregator(pom) -> Column:
    return maven_own(pom).rlike(r"(?i)<packaging>\s*pom\s*</packaging>|<modules>")


def maven_dependencies(pom) -> Column:
    return F.regexp_extract_all(col(pom), F.lit(r"(?s)<dependency>(?:(?!</dependency>).)*?<artifactId>\s*([^<]+?)\s*</artifactId>"), 1)


def package_dependencies(content) -> Column:
    """Names in dependencies, then devDependencies, each once."""
    keys = lambda k: F.coalesce(F.json_object_keys(F.get_json_object(col(content), f"$.{k}")), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(keys("dependencies"), keys("devDependencies")))


def requirements(content) -> Column:
    lines = F.transform(F.split(F.coalesce(col(content), F.lit("")), "\n"), lambda x: F.regexp_extract(F.trim(x), r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1))
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def submodule_paths(gitmodules) -> Column:
    return F.regexp_extract_all(F.coalesce(col(gitmodules), F.lit("")), F.lit(r"(?m)^\s*path\s*=\s*(\S+)\s*$"), 1)


def spring_name(config) -> Column:
    """spring.application.name of a YAML or properties file."""
    c = col(config)
    return F.coalesce(some(F.trim(F.regexp_extract(c, r"(?m)^spring\.application\.name\s*[=:]\s*(\S+)", 1))), some(F.trim(F.regexp_extract(c, r"(?s)\bspring:\s.*?\bapplication:\s.*?\bname:\s*[\"']?([^\s\"']+)", 1))))


def relationship_target(context) -> Column:
    """Arrow function, call argument, generic, then field type; the first that is there."""
    c = col(context)
    get = lambda p: some(F.regexp_extract(c, p, 1))
    return F.coalesce(get(r"=>\s*([A-Z]\w*)"), get(r"(?:relationship|ForeignKey|OneToOneField|ManyToManyField)\(\s*[\"']?([A-Z]\w*)"), get(r"(?:List|Set|Collection|ICollection|Array|Promise)<\s*([A-Z]\w*)\s*>"), get(r"(?:private|public|protected)\s+([A-Z]\w*)\s+\w+"))
