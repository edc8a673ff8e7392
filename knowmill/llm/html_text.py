"""Main text of web pages by line-block distribution.

Markup is stripped to lines first: a block-level tag ends a line. What is no text of an article by its element or by an
unmistakable class, id or role (scripts, styles, menus, site headers, footers, asides, forms, reader comments, cookie
notices) is stripped with the markup and leaves WINDOW empty lines; the edge of an article, or of an element whose class
hints at an advert, a notice or the like, leaves as many; other containers' edges leave one, never WINDOW in a row.

The line-block distribution decides on the rest. A line's size is its length without links, 0 if it is mostly links, and
a quarter where text stands in a bare container although the page has paragraphs, or outside the page's articles. Sizes
are summed over windows of WINDOW lines. The threshold comes from the page itself: SURGE times the mean size of its lines,
of those in articles or else paragraphs if there are any. In each stretch, which ends where a sum falls to 0, the first sum that reaches the threshold is the surge, the last one the
dive; lines that adjoin them without a gap belong to them. Everything between is kept, whatever containers, tables and
lists it lies in, and a stretch without a surge is dropped. A line of an article reaches the threshold by itself.

Time is linear in the page, however malformed: tags are read once, elements are matched on stacks, and an element that is
never closed only loses its tag. Character references are decoded once, white space inside a line becomes one space,
lines are trimmed and empty ones dropped; nothing is capped. Null html: empty text. A page without text: empty. Repeated
rows: same text. Empty table: empty result. A column that has the output's name is replaced.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowmill.llm.common import lean

WINDOW = 3
SURGE = 0.3
LINKS = 0.5
BARE = 4

# Element names of HTML.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SCOPE = frozenset("table ul ol dl".split())
CONTAINER = frozenset("aside body div footer form header main nav section table ul ol dl".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt pre blockquote caption figcaption summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe".split())
DROP = frozenset("nav footer aside form button menu dialog template svg math object canvas audio video select".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog".split())
#: Classes and ids that no text of an article has, and parts of their names that only hint at something else.
CERTAIN = re.compile(r"(?:^|[\s_-])(?:cookies?[_-](?:notice|banner|consent|bar|message|popup|wall|law|overlay|info)|consent|gdpr|sidebar|navbar|navigation|breadcrumbs?|pagination|site-?footer|page-?footer|comments?-?(?:list|section|area|thread|wrap(?:per)?)?|(?:adverts?|advertisements?|ads|adsense|ad[_-](?:banner|box|block|slot|unit|container|wrapper)|sponsored(?:[_-](?:content|links?|posts?))?|newsletter(?:[_-](?:signup|sign-up|form|box|banner|subscribe|subscription))?|subscribe(?:[_-](?:box|form|banner))?|(?:social[_-])?shar(?:e|ing)(?:[_-](?:bar|box|buttons?|icons?|links?|tools?))?|social[_-](?:bar|buttons?|icons?|links?)|related[_-](?:posts?|articles?|stories|links?|content|reading))|disqus\w*|respond)$", re.I)
HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|notices?|alert|popup|modal|overlay|newsletter|subscribe|side|widget|menu|nav|pager|header|masthead|footer|replies|discussion|share|sharing|social|related|recommend\w*|login|search|cookies?|consent|comments?)(?:$|[\s_-])", re.I)
NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
ARTICLE = re.compile(r"<article[\s/>]", re.I)
STOP = re.compile("[>\"']")
CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}

KEEP, HINTED, STRIPPED = range(3)


def kind_of(name: str, attrs: str, inside: bool) -> int:
    """Whether an element is stripped, hinted at to be something else, or kept; ``inside`` an article hints count for nothing."""
    if name in DROP or name == "header" and not inside:
        return STRIPPED
    if not attrs or name in ("body", "html", "article", "main"):
        return KEEP
    out = KEEP
    for which, v in NAMED.findall(attrs):
        v = v.strip("\"'")
        if v.lower() in ROLES if which.lower() == "role" else any(CERTAIN.search(x) for x in v.split()):
            return STRIPPED
        if not inside and HINT.search(v):
            out = HINTED
    return out


class Tags:
    """Finds the ends of tags. A ">" in a quoted value does not end one; if quotes run to the end of the page, the first ">"
    does. Quotes that were followed to the end once are not followed again, so that all searches together are linear."""

    def __init__(self, page: str):
        self.page, self.last, self.lost = page, page.rfind(">"), set()

    def end(self, at: int) -> int:
        """Where the ">" of the tag is whose name ends before ``at``, or -1."""
        page, i, seen = self.page, at, []
        while i <= self.last:
            m = STOP.search(page, i)
            if m is None or m.start() in self.lost:
                break
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            i = page.find(m[0], m.end()) + 1
            if not i:
                break
        self.lost.update(seen)
        return page.find(">", at) if at <= self.last else -1


GAP, WIDE = ("", 0, False, False), (None, 0, False, False)


def lines(page: str) -> list[tuple[str | None, int, bool, bool]]:
    """(text, length of link text, in a paragraph, in an article) for each line. An empty text stands for a container's edge,
    None for a place that ends every stretch."""
    out: list[tuple[str | None, int, bool, bool]] = []
    held: list[str] = []
    open_: dict[str, list] = {}  # by name: None, "|" for a list's start, or (number, kind, where its lines begin)
    live: list[int] = []  # numbers of the stripped elements that are open
    saved: list[int] = []  # ``para`` around each list and table
    number = link = links = article = para = at = 0
    tags = Tags(page)

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, min(links, len(text)), para > 0, article > 0))
        links = 0

    def close(entry) -> None:
        if entry is None:
            return
        n, kind, start = entry
        if kind == STRIPPED:
            if (k := bisect_left(live, n)) == len(live) or live[k] != n:
                return  # it lay in an element that is stripped already
            del live[k:], out[start:]
        out.append(WIDE)

    def close_last(name: str) -> None:
        nonlocal para
        flush()
        close(open_[name].pop())
        para = max(0, para - 1)

    while True:
        lt = page.find("<", at)
        if piece := page[at : lt if lt >= 0 else len(page)]:
            held.append(piece)
            if link:
                links += len(piece.strip())
        if lt < 0:
            break
        if page[lt + 1 : lt + 2] in ("!", "?"):
            mark = "-->" if page.startswith("!--", lt + 1) else "]]>" if page.startswith("![CDATA[", lt + 1) else ">"
            end = page.find(mark, lt + 2)
            at = len(page) if end < 0 else end + len(mark)
            continue
        m = NAME.match(page, lt + 1)
        if m is None:
            held.append("<")
            at = lt + 1
            continue
        gt = tags.end(m.end())
        if gt < 0:  # no tag ends here or later
            held.append(page[lt:])
            break
        at, name, attrs = gt + 1, m[2].lower(), page[m.end() : gt]
        if m[1]:
            if name in BLOCK:
                flush()
            if name in ("ul", "ol") and (items := open_.get("li")):
                while items and (x := items.pop()) != "|":
                    close(x)
            if name in SCOPE and saved:
                para = saved.pop()
            if name == "a":
                link = 0
            if (entries := open_.get(name)) and entries[-1] != "|":
                flush()
                close(entries.pop())
                if name in PARAGRAPH:
                    para = max(0, para - 1)
                elif name == "article":
                    article -= 1
                    if not article:
                        out.append(WIDE)
                elif name in CONTAINER:
                    out.append(GAP)
            continue
        if name in RAW:
            end = CLOSE[name].search(page, at)
            at = len(page) if end is None else end.end()
            continue
        if name in BLOCK:
            flush()
            if name != "br" and open_.get("p"):  # a block ends a paragraph
                close_last("p")
            if name == "li" and (open_.get("li") or "|")[-1] != "|":
                close_last("li")
        if name in VOID:
            continue
        if name in SCOPE:
            saved.append(para)
        if name in ("ul", "ol"):
            open_.setdefault("li", []).append("|")
        kind = kind_of(name, attrs, article > 0)
        if kind != KEEP:
            flush()
            number += 1
            open_.setdefault(name, []).append((number, kind, len(out)))
            if kind == STRIPPED:
                live.append(number)
            else:
                out.append(WIDE)
        elif name in BLOCK:
            open_.setdefault(name, []).append(None)
        if name in PARAGRAPH:
            para += 1
        elif name == "article":
            if not article:
                out.append(WIDE)
            article += 1
        elif name in CONTAINER:
            out.append(GAP)
        elif name == "a":
            link = 1
    flush()
    return out


def sizes(rows: list[tuple[str | None, int, bool, bool]], articles: bool) -> tuple[list[int], float]:
    """The size of each line (without links, a quarter outside paragraphs or articles if the page has any) and the page's
    threshold: SURGE times the mean size of the lines in articles, or else in paragraphs, or else of all lines."""
    paragraphs, out = any(r[2] for r in rows), []
    for text, link, para, article in rows:
        size = len(text or "")
        if not article:
            size = 0 if link > LINKS * size else size - link
            if paragraphs and not para:
                size //= BARE
            if articles:
                size //= BARE
        out.append(size)
    for place in ((3,) if articles else (2, 0)):
        if some := [x for x, r in zip(out, rows, strict=True) if x and r[place]]:
            return out, SURGE * sum(some) / len(some)
    return out, float("inf")


def stretch(lengths: list, threshold: float) -> tuple[int, int]:
    """[surge, dive) of lines between two wide gaps; no line if no sum of WINDOW lines reaches the threshold."""
    n = len(lengths)
    high = [i for i in range(n) if threshold <= sum(lengths[i : i + WINDOW])]
    if not high:
        return 0, 0
    first, last = ([k for k in range(i, min(n, i + WINDOW)) if lengths[k]] for i in (high[0], high[-1]))
    # a line that reaches the threshold alone, or else the lines next to the text; and what adjoins it without a gap
    a = next((k for k in first if lengths[k] >= threshold), first[-1])
    while a and lengths[a - 1]:
        a -= 1
    z = next((k for k in reversed(last) if lengths[k] >= threshold), last[0])
    while z + 1 < n and lengths[z + 1]:
        z += 1
    return min(a, z), max(a, z) + 1


def extract(page: str | None) -> str:
    if not page:
        return ""
    rows = lines(page)
    lengths, threshold = sizes(rows, ARTICLE.search(page) is not None)
    out: list[str] = []
    part: list[int] = []
    for k, (text, _, _, article) in enumerate([*rows, WIDE]):
        if text is not None:
            if text or sum(not rows[i][0] for i in part[1 - WINDOW :]) < WINDOW - 1:  # edges in a row are no wide gap
                part.append(k)
            if article and text:
                lengths[k] = max(lengths[k], threshold)  # by itself
            continue
        a, z = stretch([lengths[i] for i in part], threshold)
        out += [t for i in part[a:z] if (t := rows[i][0])]
        part = []
    return "\n".join(out)


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages without ``html``, and the main text; a column named ``out`` is replaced."""
    rows = pages.drop(out) if out in pages.columns and out != html else pages
    keep = [c for c in rows.columns if c != html]
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("_html"))

    def run(batches):
        for b in batches:
            made = [extract(p) for p in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.string())], names=[*keep, out])

    return rows.mapInArrow(lean(run), T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    from knowmill.llm.common import table

    text = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def oracle() -> str:
    """For these pages, in which the article is marked as such and knows four named references."""
    decode = "x"
    for ref, c in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        decode = f"replace({decode}, '{ref}', '{c}')"
    return f"""
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
    l AS (SELECT page_id, url, list_transform(string_split_regex(a, '</?(?:h1|p|br)[^>]*>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS l FROM a),
    t AS (SELECT page_id, url, list_filter(list_transform(l, lambda x: trim(regexp_replace({decode}, '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+', ' ', 'g'))), lambda x: x <> '') AS l FROM l)
    SELECT page_id, url, array_to_string(l, chr(10)) AS text, length(array_to_string(l, chr(10)))::BIGINT AS n_chars FROM t"""
