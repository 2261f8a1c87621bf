"""Main text of web pages: site template removal and structural rules.

Element subtrees of every page are hashed (tag, class, id, role, texts, children)
and counted by host in distinct pages. Subtrees that recur on many pages of their
host are deleted, and so are elements whose name, role or class says that they are
menus, headers, footers, sidebars, notices, adverts, forms, scripts or reader
comments. What is left of the page's main container (main or article, else the
body) is the text.

A class or id counts by its whole name: ``site-footer`` and ``share-bar`` name boilerplate,
``share-price`` and ``entry-header`` do not. Paragraphs, headings, quotes and tables of the
article stay whatever such a name says, and so does a form around the article or most of the page's prose.

A paragraph, heading, list or table inside an article is never deleted for
recurring: a passage that many articles share is part of each of them.

Pages are parsed twice, once for the counts and once for the text, each a page at a time.

Defined results
* null or empty html, or a page without text: an empty text;
* a null URL, or one without a host: pages of the host ``""``;
* copies of one page count as one page of the host, so a page is no template of itself;
* repeated rows: one result each; rows that share a page_id are extracted apart; empty table: empty result;
* columns besides the three are ignored; cut off pages are read to their end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_tree as H

#: A subtree is template on at least this many pages of its host, however large the host.
MIN_PAGES = 10
#: A form is a wrapper, not a form, if it holds this many characters of prose and most of the page's.
MIN_PROSE = 250

# Element names, roles and words of class names that mark what is not the article.
TAGS = frozenset("""script style noscript template iframe object embed applet svg math canvas audio video head nav
footer aside form button select input textarea fieldset dialog menu datalist noembed noframes title search
""".split())
ROLES = frozenset("""navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar
toolbar status""".split())
WORDS = frozenset("""nav navbar navigation menu submenu sidebar footer header masthead topbar breadcrumb breadcrumbs
pagination pager cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay
newsletter subscribe subscription signup signin login register share sharing sharebar social disclaimer copyright
toolbar search form widget widgets skip paywall banner""".split())
STRONG = frozenset("""comment comments commentlist disqus reply replies respond ad ads advert adverts advertisement
advertising adsbygoogle adsense adslot adbox sponsor sponsored promo promotion promoted related recommended
recommendations""".split())
#: Words that only place or group a box, so a name made of them and the words above is still boilerplate.
PLACES = frozenset("""site page main global local top bottom left right primary secondary sticky fixed box bar wrap wrapper
container block inner outer section list item items link links button buttons btn area panel row col column group slot
unit icon icons field input post article content text body holder zone the and""".split())
WRAPPERS = frozenset("form fieldset".split())
SAYS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figure figcaption".split())
NEGATED = frozenset("has with no without is not".split())
PROSE = frozenset("""p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th figure
figcaption caption""".split())
SKIP = frozenset("#root html body".split())
MAIN = frozenset(("main", "article"))


def _marks(e: H.Element) -> tuple[bool, bool]:
    """(class or id names boilerplate, names it beyond doubt); also for roles and hidden elements."""
    if not e.attrs:
        return False, False
    a = e.attributes()
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(
            r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()):
        return True, True
    if a.get("role", "").lower() in ROLES:
        return True, False
    weak = strong = False
    for name in (a.get("class", "") + " " + a.get("id", "")).split():
        parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        if parts and parts[0] in NEGATED:
            continue
        weak |= bool(WORDS.intersection(parts)) and all(x in WORDS or x in STRONG or x in PLACES for x in parts)
        strong |= bool(STRONG.intersection(parts))
    return weak, strong


def _is_main(e: H.Element) -> bool:
    return e.tag in MAIN or bool(e.attrs) and "role" in e.attrs and e.attributes().get("role", "").lower() == "main"


def _wrappers(elements: list[tuple[H.Element, bool]]) -> set[int]:
    """Forms that hold most of the page's prose."""
    if not any(e.tag in WRAPPERS for e, _ in elements):
        return set()
    says: set[int] = set()
    for e, _ in elements:
        if e.tag in SAYS or id(e.parent) in says:
            says.add(id(e))
    size: dict[int, int] = {}
    for e, _ in reversed(elements):  # children before parents
        own = sum(len(x) for x in e.items if x.__class__ is str) if id(e) in says and e.tag not in H.RAW else 0
        size[id(e)] = own + sum(size[id(x)] for x in e.items if x.__class__ is H.Element)
    total = sum(size[id(e)] for e, _ in elements if e.parent.parent is None)
    return {id(e) for e, _ in elements if e.tag in WRAPPERS and size[id(e)] >= MIN_PROSE and 2 * size[id(e)] > total}


def _may_be_template(e: H.Element, inside: bool) -> bool:
    """Whether the subtree may be deleted for recurring: blocks outside the article, and marked boxes in it."""
    if e.tag in SKIP or e.tag in MAIN or e.tag not in H.BLOCK:
        return False
    return not inside or (e.tag not in PROSE and bool(e.attrs))


def _scan(html: str) -> tuple[H.Element, list[tuple[H.Element, bool]]]:
    """The tree, and its elements (parents first) with whether each lies in the article."""
    root = H.parse(html)
    elements = H.walk(root)
    inside: dict[int, bool] = {id(root): False}
    out = []
    for e in elements[1:]:
        now = inside[id(e.parent)] or e.tag in MAIN
        inside[id(e)] = now
        out.append((e, inside[id(e.parent)]))
    return root, out


def subtree_hashes(html: str) -> list[int]:
    """Distinct hashes of the subtrees that may be templates and hold something."""
    _, elements = _scan(html)
    return list({_number(e) for e, inside in elements if e.items and _may_be_template(e, inside)})


def _number(e: H.Element) -> int:
    return int.from_bytes(H.subtree_digest(e), "big", signed=True)


def main_text(html: str, templates: set[int]) -> str:
    """The page's text without the given subtrees and without what the structural rules drop."""
    root, elements = _scan(html)
    holds_main: set[int] = set()
    for e, _ in elements:
        if _is_main(e):
            p = e.parent
            while p is not None and id(p) not in holds_main:
                holds_main.add(id(p))
                p = p.parent
    wraps = _wrappers(elements)
    for e, inside in elements:
        if e.tag in SKIP:
            continue
        weak, strong = _marks(e)
        keep = e.tag in MAIN or id(e) in holds_main or id(e) in wraps
        weak = weak and not keep and not (inside and e.tag in SAYS)
        if (e.tag in TAGS and not (keep and e.tag in WRAPPERS)) or strong or weak or (
                e.tag == "header" and not inside and not keep):
            e.drop = True
        elif templates and not keep and e.items and _may_be_template(e, inside) and _number(e) in templates:
            e.drop = True
    mains = []
    todo = [root]
    while todo:
        e = todo.pop()
        if e.drop:
            continue
        if _is_main(e):
            mains.append(e)
            continue
        todo.extend(x for x in reversed(e.items) if isinstance(x, H.Element))
    out = H.blocks(mains) if mains else []
    return "\n".join(out or H.blocks([root]))


def _slim(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")),
                                    r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col(key).alias("k"), F.col(url).alias("u"), host.alias("host"),
                        F.coalesce(F.col(html), F.lit("")).alias("h")).withColumn("sum", F.xxhash64("h"))


def templates(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
              min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """(page content, subtree) rows: host, sum, t; and the recurring subtrees per host: host, t, n."""
    def hashes(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for host, s, h in zip(b.column("host"), b.column("sum"), b.column("h")):
                found = subtree_hashes(h.as_py())
                n = len(found)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([host.as_py()] * n, pa.string()),
                                                      pa.array([s.as_py()] * n, pa.int64()),
                                                      pa.array(found, pa.int64())], names=["host", "sum", "t"])
    slim = _slim(pages, key, url, html)
    each = slim.select("host", "sum", "h").mapInArrow(_grouped(hashes), "host string, sum long, t long")
    recurring = each.distinct().groupBy("host", "t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    return each, recurring


def _grouped(fn, rows: int = 4096):
    """Joins the many small batches of ``fn`` to batches of a few thousand rows."""
    def run(batches):
        held, n = [], 0
        for b in fn(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return run


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
            min_pages: int = MIN_PAGES) -> DataFrame:
    """Per row: key, url, text, n_chars."""
    each, recurring = templates(pages, key, url, html, min_pages)
    # a page's list is bounded by its own elements
    drop = (each.join(recurring.select("host", "t"), ["host", "t"]).groupBy(F.col("host").alias("h2"),
                                                                           F.col("sum").alias("s2"))
            .agg(F.collect_set("t").alias("drop")))
    slim = _slim(pages, key, url, html)
    rows = slim.join(drop, (F.col("host") == F.col("h2")) & (F.col("sum") == F.col("s2")), "left")
    types = dict(pages.dtypes)

    def text(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out, at, size = [], 0, 0
            for i, (h, d) in enumerate(zip(b.column("h"), b.column("drop"))):
                out.append(main_text(h.as_py(), set(d.as_py() or ())))
                size += len(out[-1])
                if size > 8 << 20 or i + 1 == b.num_rows:
                    n = i + 1 - at
                    yield pa.RecordBatch.from_arrays(
                        [b.column("k").slice(at, n), b.column("u").slice(at, n), pa.array(out, pa.string()),
                         pa.array([len(x) for x in out], pa.int64())], names=[key, url, "text", "n_chars"])
                    out, at, size = [], i + 1, 0
    return rows.select("k", "u", "h", "drop").mapInArrow(
        text, f"`{key}` {types[key]}, `{url}` {types[url]}, text string, n_chars long")
