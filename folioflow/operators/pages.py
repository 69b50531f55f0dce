"""Main text of HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SKIP = {"script", "style", "table", "nav", "footer", "header", "aside", "form", "noscript"}
_BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "section", "article", "ul", "ol", "tr"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.deep = 0

    def handle_starttag(self, tag: str, attrs: object) -> None:
        self.deep += tag in _SKIP
        if tag in _BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.deep = max(0, self.deep - (tag in _SKIP))
        if tag in _BLOCK:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.deep:
            self.out.append(data)


def page_text(html: str | None) -> str | None:
    """Text outside tables, scripts and page furniture, a line a block; None for null and pages without text."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = [" ".join(x.split()) for x in "".join(parser.out).split("\n")]
    return "\n".join(x for x in lines if x) or None


def html_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([page_text(p) for p in pages], dtype=object)

    return run(html)
