"""Main text of an HTML page.

The page parser of the standard library does the tag work for one page; Spark hands it pages in
Arrow batches and spreads those over the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements that hold no article text, class hints, shortest useful body.
NOISE_TAGS = ("script", "style", "nav", "header", "footer")
CLASS_HINTS = ("article", "content", "body")
MIN_BODY_LENGTH = 100

_VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)


class _Regions(HTMLParser):
    """Collects the text pieces below each candidate region in one pass over the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.noise = 0
        self.data: list[str] = []
        self.live: dict[str, int] = {"page": 0}
        self.pieces: dict[str, list[str]] = {"page": []}

    def _region(self, tag: str, attrs: list[tuple[str, str | None]]) -> str | None:
        if tag == "div":
            classes = (dict(attrs).get("class") or "").lower()
            if not any(hint in classes for hint in CLASS_HINTS):
                return None
        elif tag not in ("article", "main", "body"):
            return None
        return None if tag in self.pieces else tag

    def _flush(self) -> None:
        text = "".join(self.data).strip()
        self.data.clear()
        if text:
            for region, outer_noise in self.live.items():
                if self.noise == outer_noise:
                    self.pieces[region].append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        if tag in _VOID_TAGS:
            return
        region = self._region(tag, attrs)
        if region:
            self.pieces[region] = []
            self.live[region] = self.noise
        self.open.append((tag, region))
        self.noise += tag in NOISE_TAGS

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if not any(name == tag for name, _ in self.open):
            return
        while self.open:
            name, region = self.open.pop()
            self.noise -= name in NOISE_TAGS
            if region:
                del self.live[region]
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        self.data.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def close(self) -> None:
        super().close()
        self._flush()


def main_text(page: str) -> str:
    """Text of the article element, else main, else the first content-like div, else the body."""
    parser = _Regions()
    parser.feed(page)
    parser.close()
    for region in ("article", "main", "div", "body", "page"):
        if region in parser.pieces:
            return " ".join(parser.pieces[region])
    return ""


@F.pandas_udf(StringType())
def _main_text_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(main_text, na_action="ignore")


def body_or_summary(body: Column, summary: Column, min_length: int = MIN_BODY_LENGTH) -> Column:
    """The extracted body, or the summary where the body is missing or too short."""
    return F.when(F.length(body) >= min_length, body).otherwise(F.coalesce(summary, F.lit("")))


def page_text(html: Column) -> Column:
    return _main_text_batches(html)
