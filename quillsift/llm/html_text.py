"""Main text of web pages: text-to-tag ratios of lines, smoothed and thresholded.

The standard library's parser streams a page's events; block tags end a line.  A line's ratio is its
text length over its tags; ratios are smoothed with a Gaussian and the threshold splits them in two
clusters.  The regions that lines above it lie in are content: a region is the innermost article or main element
around a line, all of whose lines then belong to it, or, on pages without, the stretch from the first
such line to the last.  Lines inside menus, headers, footers, sidebars, notices, adverts, forms,
comments of readers and the like, by tag, role or class, count for the smoothing and are never content.

White space inside a block is one space (a line break too), blocks are joined by one newline.

Edge cases: null and empty pages give an empty text, as do pages without content; markup that is not closed
ends with its parent; repeated rows give equal rows; an empty table gives no rows; extra columns are not
carried.  Nothing is cut or capped.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: HTML element names, ARIA roles, and words that class and id attributes use for page furniture
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template head title nav footer aside form button select textarea iframe object svg canvas audio video map menu dialog search datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split())
#: A start tag here ends an open paragraph or an open element of its own kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

SIGMA = 1.0
words = re.compile(r"[A-Za-z]+").findall


class Lines(HTMLParser):
    """Lines of a page: [text parts, tags, excluded, landmark number]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, excluded, landmark
        self.lines: list[list] = []
        self.marks = 0
        self.new_line()

    def new_line(self) -> None:
        excluded, mark = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, 0)
        self.line = [[], 0, excluded, mark]
        self.lines.append(self.line)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            if self.stack and self.stack[-1][0] == "p":
                self.stack.pop()
            for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 3), -1):
                if self.stack[i][0] in CLOSES.get(tag, ()):
                    del self.stack[i:]
                    break
        if tag not in VOID:
            _, excluded, mark = self.stack[-1] if self.stack else ("", False, 0)
            if tag in ("article", "main") and not excluded:
                self.marks += 1
                mark = self.marks
            self.stack.append((tag, excluded or self.furniture(tag, attrs, mark), mark))
        if tag in BLOCKS:
            self.new_line()
        elif tag == "br":
            self.line[0].append(" ")
        self.line[1] += 1

    def furniture(self, tag: str, attrs: list, mark: int) -> bool:
        if tag in NEVER or tag == "header" and not mark:
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        for key, value in attrs:
            if key == "hidden" or key == "role" and (value or "").strip().lower() in ROLES:
                return True
            if key in ("class", "id") and value and not FURNITURE.isdisjoint(words(re.sub("([a-z])([A-Z])", r"\1 \2", value).lower())):
                return True
        return False

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
        if tag in BLOCKS:
            self.new_line()
        self.line[1] += 1

    def handle_data(self, data: str) -> None:
        top = self.stack[-1][1] if self.stack else False
        if top and not self.line[2]:
            if not data.strip():
                return
            if not any(part.strip() for part in self.line[0]):
                self.line[2] = True  # an inline element that is furniture, alone in its line
            else:
                return
        elif self.line[2] and not top:
            self.new_line()
        self.line[0].append(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[d + reach], values[i + d]) for d in range(-reach, reach + 1) if 0 <= i + d < len(values)]
        out.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    return out


def threshold(values: list[float]) -> float:
    """Midpoint of two clusters (2-means on the line, from the extremes)."""
    lo, hi = min(values), max(values)
    for _ in range(50):
        cut = (lo + hi) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not above:
            break
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = [(text, tags, excluded, mark) for parts, tags, excluded, mark in parser.lines for text in [" ".join("".join(parts).split())] if text]
    if not lines:
        return ""
    ratios = smooth([len(text) / max(1, tags) for text, tags, _, _ in lines])
    cut = threshold(ratios)
    free = [i for i, line in enumerate(lines) if not line[2]]
    content = [i for i in free if ratios[i] >= cut] or free
    marks = {lines[i][3] for i in content if lines[i][3]}
    if not marks:  # a page whose article has short lines only, beside long ones of furniture
        marks = {lines[i][3] for i in free if lines[i][3]}
    if marks:
        chosen = [i for i in free if lines[i][3] in marks]
    else:
        chosen = [i for i in free if content[0] <= i <= content[-1]] if content else []
    return "\n".join(lines[i][0] for i in chosen)


def extract(html):
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return F.pandas_udf(run, "string")(html)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    out = pages.select("page_id", "url", extract(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
