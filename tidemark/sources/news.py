"""News feeds and article pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed pattern: the publication time that ends an unquoted headline.
PUBLISHED = r"\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}(?:\s.\d{4})?"
_LINE = rf"(?s)^([^,]*),([^,]*),([^,]*),(?:(.*?),)?({PUBLISHED}),([^,]*)(?:,(.*))?$"
PREAMBLE_LINES = 2


def parse_news(lines: DataFrame) -> DataFrame:
    """Repair unquoted feed lines ``company,ticker,code,headline,time,url,description``.

    The headline runs up to the first field that is a time; commas inside
    headline and description vanish. A line without description keeps the
    text ``NULL`` if its url is a link, lines without a time are dropped, and
    equal lines count once. ``line_in_file`` starts at 0.
    """
    bare = F.translate("value", "'`\"", "")
    part = lambda i: F.regexp_extract("bare", _LINE, i)
    parsed = (
        lines.filter(F.col("line_in_file") >= PREAMBLE_LINES)
        .select(bare.alias("bare"))
        .filter(F.col("bare").rlike(_LINE))
        .select(
            part(1).alias("company"),
            part(2).alias("ticker"),
            part(3).alias("code"),
            F.replace(part(4), F.lit(","), F.lit("")).alias("headline"),
            part(5).alias("published"),
            part(6).alias("url"),
            F.replace(part(7), F.lit(","), F.lit("")).alias("rest"),
        )
    )
    description = F.when(F.col("rest") != "", F.col("rest")).when(F.contains("url", F.lit("http")), "NULL")
    return parsed.withColumn("description", description).drop("rest").filter("description is not null").distinct()


# Elements that end an open paragraph, and entities to decode.
_BLOCKS = (
    "address|article|aside|blockquote|body|div|dl|fieldset|footer|form|h[1-6]|header|hr|html|main|nav|ol|pre|"
    "section|table|tbody|td|th|tr|ul"
)
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
_OPEN, _CLOSE = "\u0001", "\u0002"


def paragraph_text(html: Column) -> Column:
    """Text of all paragraphs joined by a space, built from regular expressions only."""
    body = F.regexp_replace(html, r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    body = F.regexp_replace(body, r"(?i)<p(\s[^>]*)?>", _OPEN)
    body = F.regexp_replace(body, rf"(?i)</p\s*>|</?(?:{_BLOCKS})(\s[^>]*)?/?>", _CLOSE)
    joined = F.array_join(F.regexp_extract_all(body, F.lit(f"{_OPEN}([^{_OPEN}{_CLOSE}]*)"), F.lit(1)), " ")
    text = F.regexp_replace(joined, r"(?i)<br[^>]*>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, character in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    text = F.trim(F.regexp_replace(F.replace(text, F.lit("'"), F.lit("")), r"\s+", " "))
    return F.when(text != "", text)


class _Paragraphs(HTMLParser):
    _skip = ("script", "style")
    _blocks = set(_BLOCKS.replace("h[1-6]", "h1|h2|h3|h4|h5|h6").split("|"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.open, self.skipped = [], False, 0

    def handle_starttag(self, tag, attrs):
        if tag in self._skip:
            self.skipped += 1
        elif tag == "p":
            self.open = True
            self.parts.append("")
        elif tag in self._blocks:
            self.open = False
        elif tag == "br" and self.open:
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        if tag in self._skip:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "p" or tag in self._blocks:
            self.open = False

    def handle_data(self, data):
        if self.open and not self.skipped:
            self.parts[-1] += data


def _strict(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Paragraphs()
    parser.feed(html)
    text = " ".join(" ".join(parser.parts).replace("'", "").split())
    return text or None


@F.pandas_udf(T.StringType())
def paragraph_text_strict(html: pd.Series) -> pd.Series:
    """Paragraph text through a tolerant HTML parser, for markup the patterns cannot follow."""
    return html.map(_strict)


def extract_articles(pages: DataFrame, html: str = "html", strict: bool = False) -> DataFrame:
    """Adds ``content`` and the ``redirected`` flag to landed pages."""
    text = paragraph_text_strict(F.col(html)) if strict else paragraph_text(F.col(html))
    return pages.withColumn("content", text).withColumn(
        "redirected", F.lower(F.trim(F.col(html))) == "redirect"
    )
