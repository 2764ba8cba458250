"""HTML pages: the visible text of the document region, its length and its lines."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose text is no text of the page, and those that end a line.
UNSEEN = {"script", "style", "nav", "header", "footer", "aside", "noscript", "template", "head"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "blockquote", "pre"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}


class _Region(HTMLParser):
    """Collects visible text, apart for <main>, <article> and the whole."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.text: dict[str, list[str]] = {"main": [], "article": [], "body": []}

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS:
            self._say("\n")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if tag in BREAKS:
            self._say("\n")

    def handle_data(self, data):
        self._say(data)

    def _say(self, data: str) -> None:
        if not UNSEEN.intersection(self.open):
            self.text["body"].append(data)
            for region in ("main", "article"):
                if region in self.open:
                    self.text[region].append(data)


def region_text(html: str | None) -> tuple[str, str]:
    """The name of the region read and its lines, blanks collapsed: main, else article, else the body."""
    parser = _Region()
    parser.feed(html or "")
    parser.close()
    for name in ("main", "article", "body"):
        lines = [" ".join(line.split()) for line in "".join(parser.text[name]).split("\n")]
        held = "\n".join(line for line in lines if line)
        if held or name == "body":
            return name, held
    return "body", ""


@F.pandas_udf(T.StructType([T.StructField("region", T.StringType()), T.StructField("text", T.StringType())]))
def _read(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([region_text(h) for h in html], columns=["region", "text"])


def read_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("r", _read("html")).select("page_id", "url", "r.region", "r.text")


def measured(pages: DataFrame) -> DataFrame:
    """Region, visible characters, lines, and whether the page counts as a document (a section sign and 300 characters)."""
    text = F.col("text")
    return read_pages(pages).select(
        "page_id",
        "region",
        F.length(text).cast("long").alias("n_chars"),
        F.when(F.length(text) > 0, F.size(F.split(text, "\n"))).otherwise(0).cast("long").alias("n_lines"),
        (F.contains(text, F.lit("§")) & (F.length(text) >= 300)).alias("is_document"),
    )
