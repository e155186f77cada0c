"""Main text of web pages by text-to-tag ratios of lines.

The parser of the standard library streams events; text between block tags makes a
line, with the number of tags that it holds. The ratios of a page's lines are smoothed
with a Gaussian, and lines above a threshold from their spread cluster into content.
A cluster marks its nearest article, main or body part as content region, and all
lines of the regions are kept, also short ones. What a page declares as menu, header,
footer, sidebar, notice, advert, form, script, style or comment never counts.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.llm.common import batches

BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 "
    "hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never content, with all that is inside.
DROPPED = frozenset(
    "aside audio button canvas dialog footer form head header iframe input label map math menu nav noscript object option "
    "picture script select style svg template textarea title video".split())
#: Words in class, id or role that say the same of any element.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|byline|comments?|commentlist|complementary|consent|"
    r"contentinfo|cookies?|disqus|footer|gdpr|header|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|"
    r"notification|pagination|pager|popup|promo|promoted|recommended|related|replies|respond|share|sharing|sidebar|sidenav|"
    r"signup|skip|social|sponsor|sponsored|subscribe|subscription|toolbar|topbar|widget)s?(?=$|[\s_-])", re.IGNORECASE)
REGIONS = frozenset("article main body".split())
#: Elements that a new block or an own kind ends without an end tag.
CLOSES = {"p": BLOCKS, "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]),
          "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
SPACE = re.compile(r"\s+")
SIGMA = 1.0


class Lines(HTMLParser):
    """Collects (text, tags, region) of every line outside dropped elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.open: list[tuple[str, bool, int]] = []  # name, dropped, region
        self.parts: list[str] = []
        self.tags, self.regions = 0, 0

    def end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, self.open[-1][2] if self.open else 0))
        self.parts.clear()
        self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        dropped, region = self.open[-1][1:] if self.open else (False, 0)
        if tag in BLOCKS or tag in DROPPED:
            if not dropped:
                self.end_line()
            while self.open and tag in CLOSES.get(self.open[-1][0], ()):
                self.open.pop()
            dropped, region = self.open[-1][1:] if self.open else (False, 0)
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in REGIONS:
            self.regions += 1
            region = self.regions
        named = tag not in REGIONS and tag != "html" and any(
            k in ("class", "id", "role") and v and MARKED.search(v) for k, v in attrs)
        self.open.append((tag, dropped or tag in DROPPED or named, region))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        if any(name in BLOCKS or name in DROPPED for name, _, _ in self.open[at:]):
            if tag not in BLOCKS and tag not in DROPPED:
                return  # an inline end tag does not close blocks around it
            if not self.open[-1][1]:
                self.end_line()
            else:
                self.parts.clear()
        self.tags += 1
        del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.parts.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Skip a marked section; the standard one stops at unknown kinds."""
        end = self.rawdata.find(">", i)
        return -1 if end < 0 else end + 1


def smoothed(ratios: np.ndarray) -> np.ndarray:
    reach = int(np.ceil(2 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    weights = np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return np.convolve(ratios, kernel)[reach:-reach] / weights


def content_lines(lines: list[tuple[str, int, int]]) -> list[str]:
    """The lines of the regions that text-rich clusters of lines mark."""
    ratios = np.array([len(text) / max(1, tags) for text, tags, _ in lines])
    smooth = smoothed(ratios)
    rich = smooth >= min(smooth.std(), smooth.max())
    regions = np.array([r for _, _, r in lines])
    weight = np.bincount(regions, weights=np.where(rich, [len(t) for t, _, _ in lines], 0))
    # nested and plain parts: an article outweighs the page around it unless that has most of the text
    chosen = weight >= 0.2 * weight.max()
    if len(weight) > 2 and weight[2:].sum() >= 0.5 * weight.sum():
        chosen[:2] = False
    return [text for (text, _, r) in lines if chosen[r]]


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return "\n\n".join(content_lines(parser.lines)) if parser.lines else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Missing and empty pages, and pages without text, give an empty text. Repeated rows
    stay; other columns are ignored.
    """

    def run(rows: dict[str, list]) -> dict[str, list]:
        texts = [main_text(h) for h in rows["html"].to_pylist()]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return batches(columns, run, "page_id long, url string, text string, n_chars long")
