"""Main text of pages by wrapper induction over the pages of a host.

Pages are dealt to groups of one host, large hosts to many groups by a digest of the page, so no task holds a host. In
a group, each page tree is aligned with several others by simple tree matching: text nodes that are constant on most of
them are the host's template, varying slots are content. A page's article, where its markup names one, is its content slot
without template nodes if it holds most of what varies; otherwise what is left of the body when template nodes, link lists and sections for menus, notices, adverts, forms or comments are taken away.

Null html gives an empty text. A null url is a host of its own. Every row gives a row, repeated rows too. An empty table gives
an empty result; only page_id, url and html are read, so extra columns never clash.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import maybe_broadcast, settle
from quern.llm.html_tree import BLOCK, Node, induce, measure, parse, texts

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Pages aligned in one group, about.
GROUP = 64
#: Partners on which a node of a named article must be constant to be template.
SEVERAL = 2
#: Hosts beyond this many are joined by a shuffle, not broadcast.
BROADCAST_HOSTS = 50_000
#: Fixed lists: elements and sections that are never main text.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea input dialog menu object embed applet title datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
SECTION = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-header|page-header|comments?|comment-list|disqus|replies|social|share|sharing|related|recommended|recommendations|widget|pagination|pager|toolbar|login|signup)(?:$|[\s_-])",
    re.I,
)


def dropped(node: Node, inside: bool) -> bool:
    """Whether an element is a section that is never main text; a header within an article holds its title."""
    if node.tag in DROPPED or node.tag == "header" and not inside:
        return True
    if not node.attributes:
        return False
    if node.has("hidden") or set(node.get("role").lower().split()) & ROLES:
        return True
    return node.tag not in ("html", "body", "article", "main") and bool(SECTION.search(node.get("class", "id")))


def is_article(node: Node) -> bool:
    return node.tag == "article" or "articlebody" in node.get("itemprop").lower()


def is_main(node: Node) -> bool:
    return node.tag == "main" or node.get("role").lower() == "main"


def outermost(root: Node, wanted) -> list[Node]:
    """Outermost wanted elements in page order that lie in no dropped section."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag == "#text":
            continue
        if wanted(x):
            out.append(x)
        elif not dropped(x, False):
            todo += reversed(x.children)
    return out


def blocks(roots: list[Node], agreed: int, inside: bool) -> list[str]:
    """Texts of blocks in page order, without nodes that are constant on `agreed` partners or more; `inside` an article headers stay."""
    out: list[str] = []
    now: list[str] = []

    def cut() -> None:
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    for root in roots:
        cut()
        todo: list[Node | None] = [root]
        while todo:
            x = todo.pop()
            if x is None:
                cut()
            elif x.tag == "#text":
                if x.constant < agreed:
                    now.append(x.text)
            elif x is not root and dropped(x, inside):
                if x.tag in BLOCK:
                    cut()
            elif x.tag in ("br", "td", "th", "img", "wbr"):
                now.append("" if x.tag == "wbr" else " ")
                todo += reversed(x.children)
            elif x.tag in BLOCK:
                cut()
                todo.append(None)
                todo += reversed(x.children)
            else:
                todo += reversed(x.children)
    cut()
    return out


def link_list(node: Node) -> bool:
    """A list whose text is mostly that of links."""
    total = linked = 0
    todo = [(node, False)]
    while todo:
        x, inside = todo.pop()
        if x.tag == "#text":
            n = len(x.text.strip())
            total += n
            linked += n if inside else 0
        else:
            todo += [(c, inside or x.tag == "a") for c in x.children]
    return total > 0 and linked > 0.7 * total


def named_slot(root: Node) -> list[Node]:
    """Elements that the markup names as the article, or else as the main part."""
    return outermost(root, is_article) or outermost(root, is_main)


def main_text(root: Node) -> str:
    """What varies in the named slot if that holds most of what varies on the page; else all that varies in the body.

    In a named slot a node must be constant on several partners to be template, so that a passage that two articles share is kept.
    """
    found = named_slot(root)
    named = blocks(found, SEVERAL, True)
    if found and not any(x.constant for x in texts(root)):
        return "\n\n".join(named)
    body = outermost(root, lambda x: x.tag == "body") or [root]
    todo = list(body)
    while todo:
        x = todo.pop()
        x.children = [c for c in x.children if not (c.tag in ("ul", "ol", "dl", "table") and link_list(c))]
        todo += x.children
    rest = blocks(body, 1, False)
    if found and 2 * sum(map(len, named)) >= sum(map(len, rest)):
        rest = named
    return "\n\n".join(rest)


def extract_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one group of same-host pages, by SCHEMA."""
    pdf = pdf.sort_values(["page_id", "url", "html"], kind="stable", ignore_index=True)
    trees, shapes = [parse(h or "") for h in pdf["html"]], {}
    for t in trees:
        measure(t, shapes)
    induce(trees, [named_slot(t) for t in trees])
    text = [main_text(t) for t in trees]
    return pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})


def host() -> Column:
    """Host of the url column, in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """One row per page, by SCHEMA."""
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    sizes = settle(pages.select(host().alias("host")).groupBy("host").agg(F.ceil(F.count("*") / group).alias("groups")))
    rows = rows.join(maybe_broadcast(sizes, sizes.count(), BROADCAST_HOSTS), "host")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.col("groups")))
    return dealt.groupBy("host", "part").applyInPandas(extract_group, SCHEMA)
