"""Saved pages to records, with the standard library's parser, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug

#: Fixed value: what relative links of the listing are resolved against.
BASE = "https://books.toscrape.com/catalogue/"
#: Marks of a page that asks for more than a request.
GATES = (
    "verify_human", "verify you are human", "captcha", "cf-challenge", "just a moment", "access denied",
    "enable javascript and cookies",
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def walk(self) -> Iterator[Node]:
        left = [c for c in self.children[::-1] if c.__class__ is Node]
        while left:
            node = left.pop()
            yield node
            if node.children:
                left += [c for c in node.children[::-1] if c.__class__ is Node]

    def has(self, name: str) -> bool:
        return name in self.attributes.get("class", "").split()

    def find(self, tag: str, name: str | None = None) -> Node | None:
        return next(self.all(tag, name), None)

    def all(self, tag: str, name: str | None = None) -> Iterator[Node]:
        return (x for x in self.walk() if x.tag == tag and (name is None or x.has(name)))

    def text(self) -> str:
        parts, left = [], list(reversed(self.children))
        while left:
            x = left.pop()
            if isinstance(x, str):
                parts.append(x.strip())
            else:
                left += reversed(x.children)
        return "".join(parts)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def updatepos(self, i, j):  # lines are not counted
        return j

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def text_of(node: Node | None) -> str:
    return node.text() if node else ""


def listing(html: str | None) -> list[dict[str, str]]:
    out = []
    for block in tree(html).all("article", "product_pod"):
        head = block.find("h3")
        link, stars = head.find("a") if head else None, block.find("p", "star-rating")
        names = [n for n in stars.attributes.get("class", "").split() if n != "star-rating"] if stars else []
        href = link.attributes.get("href") if link else None
        out.append({
            "title": link.attributes.get("title", "").strip() if link else "",
            "price": text_of(block.find("p", "price_color")),
            "rating": names[0] if names else "",
            "availability": text_of(block.find("p", "availability")),
            "detail_url": "" if href is None else urljoin(BASE, href),
        })
    return out


#: The labels of a detail page's table.
DETAIL = {
    "upc": "UPC", "price_excl_tax": "Price (excl. tax)", "price_incl_tax": "Price (incl. tax)", "tax": "Tax",
    "stock": "Availability", "review_count": "Number of reviews",
}


def detail(html: str | None) -> list[dict[str, str]]:
    """One record per page; what a page lacks is empty."""
    nodes, info = list(tree(html).walk()), {}
    for table in (x for x in nodes if x.tag == "table" and x.has("table-striped")):
        for row in table.all("tr"):
            if label := text_of(row.find("th")):
                info[label] = text_of(row.find("td"))
    heading = next((x for x in nodes if x.attributes.get("id") == "product_description"), None)
    description = ""
    if heading:
        after = heading.parent.children[heading.parent.children.index(heading) + 1 :]
        description = text_of(next((x for x in after if isinstance(x, Node) and x.tag == "p"), None))
    crumbs = [text_of(a) for ul in nodes if ul.tag == "ul" and ul.has("breadcrumb") for li in ul.all("li") for a in li.all("a")]
    return [{k: info.get(v, "") for k, v in DETAIL.items()} | {"category": crumbs[-1] if len(crumbs) >= 3 else "", "description": description}]


def quotes(html: str | None) -> list[dict[str, str]]:
    return [
        {
            "author": text_of(block.find("small", "author")),
            "text": text_of(block.find("span", "text")),
            "tags": ";".join(a.text() for a in block.all("a", "tag")),
        }
        for block in tree(html).all("div", "quote")
    ]


def links(html: str | None) -> list[dict[str, str]]:
    return [{"href": a.attributes["href"], "anchor": a.text()} for a in tree(html).all("a") if "href" in a.attributes]


def page_title(html: str | None) -> list[dict[str, str]]:
    return [{"title": text_of(tree(html).find("title"))}]


def breadcrumbs(html: str | None) -> list[dict[str, str]]:
    return [{"crumb": a.text()} for ul in tree(html).all("ul", "breadcrumb") for a in ul.all("a")]


FIELDS: dict[Callable, tuple[str, ...]] = {
    listing: ("title", "price", "rating", "availability", "detail_url"),
    detail: (*DETAIL, "category", "description"),
    quotes: ("author", "text", "tags"),
    links: ("href", "anchor"),
    page_title: ("title",),
    breadcrumbs: ("crumb",),
}


def parse(pages: DataFrame, parser: Callable, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row per record of each page: ``key``, ``position`` in the page and the parser's fields, all text."""
    fields = FIELDS[parser]

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *[r[f] for f in fields]) for k, h in zip(b[key], b[html]) for i, r in enumerate(parser(h))]
            yield pd.DataFrame(rows, columns=[key, "position", *fields])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInPandas(parsed, f"{key} {kind}, position int, " + ", ".join(f"{f} string" for f in fields))


def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, html) of all ``*.html`` below a folder; refuses an empty one."""
    from ..operators.blocking import Refused

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").load(folder)
    pages = raw.select("path", F.decode("content", "UTF-8").alias("html"))
    if not pages.head(1):
        raise Refused(f"no pages in {folder}")
    return pages


def merge_details(records: DataFrame, details: DataFrame, fields: tuple[str, ...] = (*DETAIL, "category", "description")) -> DataFrame:
    """Listing records with their page's fields, joined by slug; empty, and ``missing``, where there is no page."""
    known = details.select("slug", *fields).withColumn("_found", F.lit(True))
    rows = records.withColumn("slug", slug("detail_url")).join(known, "slug", "left")
    kept = [c for c in records.columns if c not in fields]
    return rows.select(*kept, *[F.coalesce(known[f], F.lit("")).alias(f) for f in fields], F.col("_found").isNull().alias("missing"))


def gates(html: Column | str) -> Column:
    page = F.lower(F.col(html) if isinstance(html, str) else html)
    return F.filter(F.array(*[F.lit(g) for g in GATES]), lambda g: F.contains(page, g))


def verdict(found: Column, plain: Column, rendered: Column) -> Column:
    """How a site can be read, from its gates and the number of records with and without a browser."""
    return (
        F.when(F.size(found) > 0, "do not scrape")
        .when(plain == 0, "browser")
        .when(F.abs(plain - rendered) < 0.2 * rendered, "plain")
        .otherwise("browser")
    )


def before_first_empty(pages: DataFrame, page: str = "page", records: str = "n_records") -> DataFrame:
    """The pages of a numbered crawl before the first one without records."""
    end = pages.agg(F.min(F.when(F.col(records) == 0, F.col(page))).alias("_end"))
    return pages.join(F.broadcast(end)).where(F.col("_end").isNull() | (F.col(page) < F.col("_end"))).drop("_end")


def still_to_fetch(wanted: DataFrame, done: DataFrame, url: str = "detail_url") -> DataFrame:
    """Addresses whose page isn't saved yet, by slug."""
    todo = wanted.where(F.coalesce(F.col(url), F.lit("")) != "").select(F.col(url).alias("url"), slug(url).alias("slug"))
    return todo.join(done.select("slug").distinct(), "slug", "left_anti")


def crawl(todo: DataFrame, fetch: Callable[[str], str]) -> DataFrame:
    """``todo`` (url, slug) with the page of each address, or the failure it ended in; no failure stops the others."""

    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, name in zip(b["url"], b["slug"]):
                try:
                    rows.append((url, name, fetch(url), None))
                except Exception as e:  # whatever an address does to its reader
                    rows.append((url, name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "slug", "html", "failure"])

    return todo.select("url", "slug").mapInPandas(fetched, "url string, slug string, html string, failure string")
