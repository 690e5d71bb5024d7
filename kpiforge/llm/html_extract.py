"""Main text of HTML pages by line-block distribution.

1. ``markup_lines`` (a small helper, row by row) strips markup and returns one line per
   block with the number of its characters that are no link text. Blocks that say what they
   are (navigation, page header and footer, sidebar, form, script, advert or comment
   classes ...) become ``BLOCK`` empty lines, as does the edge of an article; inside an
   article they only go.
2. Spark's higher-order functions do the rest: sums over sliding windows of ``BLOCK`` lines,
   surge points (a window with text after empty ones) and dive points (an empty window after
   text), and the text between them. A stretch counts if its highest window reaches
   ``min(min_chars, half the page's highest window)``. <article> and <main> are a weight, no
   choice: the lines inside count more by the share of the page's text that is inside.

Edge cases: null, empty or text-free html gives ""; unclosed and stray tags, cut-off
entities and quotes are read leniently; the columns page_id and url may be null or repeated.
"""

from __future__ import annotations

import html as html_lib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, MIN_CHARS = 3, 80
LINES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType()),
                                  T.StructField("inside", T.BooleanType())]))

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""",
    re.S)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
#: A slash of its own at a tag's end, not one of an unquoted value.
CLOSED = re.compile(r"""(?:^|[\s"'])/>?$""")
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul").split())
RAW = frozenset("script style textarea title template noscript iframe svg xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button select head".split())
BOILER_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices comment comments "
    "disqus reply replies respond share sharing social related recommended newsletter subscribe popup modal overlay "
    "widget toolbar pagination pager masthead skip contentinfo complementary search alert "
    "cookie-notice cookie-banner cookie-consent main-nav main-menu nav-bar site-nav site-footer page-footer side-bar "
    "comment-list comments-area related-posts related-articles share-buttons social-share social-links skip-link "
    "search-form newsletter-signup ad-slot ad-container").split())
HEADER_WORDS = frozenset(("header", "topbar", "site-header", "page-header"))
COMMENT_WORDS = frozenset(("comment", "comments", "comment-body"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def is_boiler(tag: str, attrs: str, inside: bool, article: bool) -> bool:
    """Whole class and role names count, and whole ids outside articles that are no heading's
    (ids are often made from titles: "related-work", "search")."""
    if tag in BOILER_TAGS or (tag == "header" and not inside):
        return True
    if tag in ("main", "body", "html") or len(attrs) < 3:
        return False
    found = {}
    for k, a, b, c in ATTRIBUTE.findall(attrs):
        found.setdefault(k.lower(), (a or b or c).lower())
    names = frozenset(found.get("class", "").split() + found.get("role", "").split())
    if tag == "article":
        return bool(names & COMMENT_WORDS)
    if "hidden" in found or found.get("aria-hidden") == "true":
        return True
    if not article and tag not in HEADINGS:
        names |= {found.get("id", "").strip()}
    return bool(names & BOILER_WORDS) or (not inside and bool(names & HEADER_WORDS))


def markup_lines(page: str) -> list[dict]:
    """Lines of a page in order: text, characters outside links, inside an article or not."""
    lines: list[dict] = []
    parts: list[str] = []
    plain = links = 0
    stack: list[tuple[str, bool]] = []  # open blocks and boilerplate: (tag, boiler)
    boiler = inside = articles = 0
    gap = [{"text": "", "n": 0, "inside": False}] * BLOCK

    def end_line():
        nonlocal plain, parts
        text = " ".join("".join(parts).split())
        if text:
            lines.append({"text": text, "n": plain, "inside": inside > 0})
        parts, plain = [], 0

    def leave(tag: str, was_boiler: bool):
        nonlocal boiler, inside, articles
        end_line()
        boiler -= was_boiler
        inside -= tag in ("article", "main")
        articles -= tag == "article"
        if (was_boiler or tag in ("article", "main")) and not inside:
            lines.extend(gap)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not boiler:
            chunk = page[at:stop]
            if "&" in chunk:
                chunk = html_lib.unescape(chunk)
            parts.append(chunk)
            if not links:
                plain += len(chunk.strip())
        if not m:
            break
        at = m.end()
        closing, tag, attrs = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not tag:
            continue
        if closing:
            if tag == "a":
                links = 0
            held = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if held is not None:
                while len(stack) > held:
                    leave(*stack.pop())
            continue
        if tag in RAW and not (tag == "svg" and CLOSED.search(attrs)):  # a slash closes no other of these tags
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
            if tag in BLOCKS:
                end_line()
            continue
        if tag in VOID:
            if tag == "hr":
                end_line()
            else:
                parts.append(" " if not boiler else "")
            continue
        if tag == "a":
            links = int(any(k.lower() == "href" for k, *_ in ATTRIBUTE.findall(attrs)))
        marks = is_boiler(tag, attrs, inside > 0, articles > 0)
        if tag in BLOCKS or marks:
            if stack and stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option") or (
                    stack and stack[-1][0] == "p" and tag in BLOCKS):
                leave(*stack.pop())
            end_line()
            links = 0  # an anchor left open ends with its block
            if (marks or tag in ("article", "main")) and not inside:
                lines.extend(gap)
            stack.append((tag, marks))
            boiler += marks
            inside += tag in ("article", "main")
            articles += tag == "article"
    end_line()
    return lines


@F.pandas_udf(LINES)
def _lines(pages: pd.Series) -> pd.Series:
    return pd.Series([markup_lines(p) for p in pages])


def main_text(html: Column | str, page_columns: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``page_columns`` plus ``text``: the main text of the html column."""
    col = F.col(html) if isinstance(html, str) else html
    out = page_columns.withColumn("__lb_lines", _lines.asNondeterministic()(F.coalesce(col.cast("string"), F.lit(""))))
    lines = F.col("__lb_lines")
    size = lambda x: F.length(x["text"])
    total = F.aggregate(lines, F.lit(0), lambda a, x: a + size(x))
    marked = F.aggregate(lines, F.lit(0), lambda a, x: a + F.when(x["inside"], size(x)).otherwise(0))
    share = F.coalesce(F.try_divide(marked, total), F.lit(0.0))
    # one-element array: the share is computed once a page, not once a line
    weighed = F.transform(F.array(share), lambda w: F.transform(lines, lambda x: F.struct(
        x["text"].alias("text"),
        (x["n"] + F.when(x["inside"], F.ceil(w * size(x)).cast("int")).otherwise(0)).alias("n"))))
    out = out.withColumn("__lb_lines", F.get(weighed, F.lit(0)))
    sums = F.transform(lines, lambda x, i: F.aggregate(
        F.slice(lines, i + 1, BLOCK), F.lit(0), lambda a, y: a + y["n"]))
    out = out.withColumn("__lb_sums", sums)
    peak = F.coalesce(F.array_max("__lb_sums"), F.lit(0))
    out = out.withColumn("__lb_need", F.greatest(F.lit(1), F.least(F.lit(min_chars), (peak / 2).cast("int"))))
    stretch = "struct<surge:int,dive:int,peak:int>"
    start = F.struct(F.array().cast(f"array<{stretch}>").alias("done"),
                     F.lit(None).cast(stretch).alias("cur"), F.lit(0).alias("i"))

    def step(acc: Column, s: Column) -> Column:
        grown = F.struct(F.coalesce(acc["cur"]["surge"], acc["i"]).alias("surge"), acc["i"].alias("dive"),
                         F.greatest(F.coalesce(acc["cur"]["peak"], F.lit(0)), s).alias("peak"))
        closed = F.when(acc["cur"].isNotNull(), F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        return F.struct(F.when(s > 0, acc["done"]).otherwise(closed).alias("done"),
                        F.when(s > 0, grown).alias("cur"), (acc["i"] + 1).alias("i"))

    found = F.aggregate("__lb_sums", start, step, lambda acc: F.when(
        acc["cur"].isNotNull(), F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))
    out = out.withColumn("__lb_found", F.filter(found, lambda x: x["peak"] >= F.col("__lb_need")))
    # a window starts up to BLOCK - 1 lines before its first text; those lines carry none
    kept = F.flatten(F.transform("__lb_found", lambda r: F.slice(lines, r["surge"] + 1, r["dive"] - r["surge"] + 1)))
    kept = F.filter(kept, lambda x: size(x) > 0)
    out = out.withColumn("text", F.array_join(F.transform(kept, lambda x: x["text"]), "\n\n"))
    return out.drop("__lb_lines", "__lb_sums", "__lb_need", "__lb_found")


def extract_pages(pages: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``op1``: page_id, url, text, n_chars."""
    light = pages.select("page_id", "url", F.col("html").alias("__lb_html"))
    return main_text("__lb_html", light, min_chars).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
