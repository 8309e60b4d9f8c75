"""The sites that can be read: plain configuration, looked up by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..operators.blocking import Refused
from . import html


@dataclass(frozen=True)
class Site:
    name: str
    needs_browser: bool
    parser: Callable
    pages: int
    page_url: str
    fields: tuple[str, ...]
    required: tuple[str, ...]
    detail_parser: Callable | None = None

    def urls(self) -> list[str]:
        return [self.page_url.format(page=i) for i in range(1, self.pages + 1)]


#: Addresses, numbers of pages and fields of the sites.
SITES = {
    "books": Site(
        "books", False, html.listing, 50, "https://books.toscrape.com/catalogue/page-{page}.html",
        html.FIELDS[html.listing], ("title", "price", "rating", "availability", "detail_url"), html.detail,
    ),
    "quotes": Site(
        "quotes", True, html.quotes, 20, "https://quotes.toscrape.com/js/page/{page}/",
        html.FIELDS[html.quotes], ("author", "text"),
    ),
}


def site(name: str) -> Site:
    if name not in SITES:
        raise Refused(f"no site {name!r}; there are {sorted(SITES)}")
    return SITES[name]
