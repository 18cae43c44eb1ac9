"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing, clustering.

The standard library's parser streams events into blocks (a line of the page: the text between two
block tags, with the number of tags and of link characters in it). Blocks inside elements that are
never content (menus, forms, scripts, adverts, comments, by tag, role, class or id) are out. The
text-to-tag ratios of the others (text outside links, by tags), smoothed by a Gaussian over neighbouring blocks,
are clustered by their standard deviation. Where the upper cluster's text stands mostly in articles,
all blocks of the page's articles are kept. Else all of the page's are, less those that hold nothing
but links and are not in the upper cluster: a menu without a mark, but not a link between paragraphs.

Defined results
    null or empty html      empty text, 0 characters
    broken markup           what the parser reads up to the end; open elements end with the page;
                            a declaration that it refuses, or that never ends, is left out up to
                            its first >
    very long page          one row at a time; the work is linear in the page
    repeated rows, null ids every row on its own
    empty table             an empty result
    extra columns           not read
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

#: Elements by what they are to a reader.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("head script style noscript template nav footer aside form button select option textarea iframe object svg canvas audio video dialog menu datalist title".split())
BLOCKS = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
REGIONS = set("article blockquote body div dl figure html main ol section table td tr ul".split())
ENDS_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in a class or id that mark something else than the article.
MARKS = set(
    "nav navbar navigation menu menubar header masthead topbar footer sidebar aside rail ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert disclaimer comment comments commentlist disqus "
    "reply replies respond responses discussion share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup login search breadcrumb breadcrumbs pagination pager popup popover modal overlay toolbar widget widgets copyright skip".split()
)
#: Beside these, a mark says what the element has around it or is the article's own head.
AROUND, OWN = {"with", "has", "no", "without", "is"}, {"article", "post", "entry", "content", "story"}
SIGMA = 1.0
_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-2, 3)]
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def marked(value: str) -> bool:
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        hit = words & MARKS
        if hit and not words & AROUND and not (hit == {"header"} and words & OWN):
            return True
    return False


class Block:
    """A line of the page: its text, the tags in it, its characters in links (without spaces)."""

    __slots__ = ("article", "links", "tags", "text")

    def __init__(self, text: str, tags: int, links: int, article: bool):
        self.text, self.tags, self.links, self.article = text, tags, links, article

    @property
    def plain(self) -> int:
        return len(self.text.replace(" ", "")) - self.links


class Reader(HTMLParser):
    """Parser events -> blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []  # tag, whether it is out
        self.out = self.link = self.articles = 0
        self.blocks: list[Block] = []
        self.tags = self.linked = 0
        self.parts: list[str] = []
        self.endless: set[str] = set()  # beginnings of marked sections that have no end in the rest of the page

    def parse_marked_section(self, i, report=1):
        begin = self.rawdata[i + 3 : i + 6].lower()
        end = -1
        if begin not in self.endless:
            try:
                end = super().parse_marked_section(i, report)
            except AssertionError:  # an unknown keyword, or none
                pass
            else:
                if end < 0:
                    self.endless.add(begin)
        return end if end >= 0 else self.parse_bogus_comment(i, report)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.tags, self.linked, self.articles > 0))
                self.tags = 0
            self.parts.clear()
            self.linked = 0

    def leave(self, to: int) -> None:
        """Ends the open elements from position ``to`` on."""
        for tag, out in self.open[to:]:
            self.out -= out
            self.link -= tag == "a"
            self.articles -= tag in ("article", "main")
        del self.open[to:]

    def find(self, tags, stop) -> int | None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                return k
            if self.open[k][0] in stop:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if not self.out:
            self.tags += 1
        if tag in VOID:
            return
        if tag in ENDS_ITSELF and (at := self.find(ENDS_ITSELF[tag], REGIONS if tag not in ("tr", "td", "th") else {"table"})) is not None:
            self.leave(at)
        elif tag == "body" and (at := self.find({"head"}, ())) is not None:
            self.leave(at)
        out = tag in NEVER or (tag == "header" and not self.articles)
        if attrs and not out and tag not in ("html", "body", "article", "main"):
            for key, value in attrs:
                value = value or ""
                out |= key == "hidden" or (key in ("class", "id") and marked(value)) or (key == "role" and value.lower() in ROLES)
                out |= (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower())
        elif attrs and not out and tag in ("article", "main"):
            out = any(key in ("class", "id") and {w.lower() for w in _WORDS.findall(value or "")} & {"comment", "comments", "ad", "advert", "sponsored", "related"} for key, value in attrs)
        self.out += out
        self.link += tag == "a"
        self.articles += tag in ("article", "main")
        self.open.append((tag, out))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        if not self.out:
            self.tags += 1
        # An inline end tag doesn't end the region that it stands in.
        at = self.find({tag}, () if tag in BLOCKS and tag != "p" else REGIONS)
        if at is not None:
            self.leave(at)

    def handle_data(self, data):
        if not self.out:
            self.parts.append(data)
            if self.link:
                self.linked += len("".join(data.split()))


def smooth(values: list[float]) -> list[float]:
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for d, w in zip(range(-2, 3), _KERNEL, strict=True):
            if 0 <= i + d < n:
                total += w * values[i + d]
                weight += w
        out.append(total / weight)
    return out


def select(blocks: list[Block]) -> list[Block]:
    """The blocks of the content regions.

    Where the upper cluster's text stands mostly in articles, the articles are the regions, and
    whole. Else the page is, less its menus: blocks of links alone that are not in the upper cluster.
    """
    if not blocks:
        return []
    ratio = smooth([b.plain / max(1, b.tags) for b in blocks])
    mean = sum(ratio) / len(ratio)
    bound = min(math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio)), max(ratio))
    upper = [r >= bound and r > 0 for r in ratio]
    held = [len(b.text) * u for b, u in zip(blocks, upper, strict=True)]
    if 2 * sum(n for n, b in zip(held, blocks, strict=True) if b.article) > sum(held):
        return [b for b in blocks if b.article]
    return [b for b, u in zip(blocks, upper, strict=True) if u or b.plain]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return "\n".join(b.text for b in select(reader.blocks))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with the page's text and its length in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(len(keep))]
            found = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *found], [*keep, "text", "n_chars"])

    df = pages.select(*keep, F.col(html).alias(fresh(pages, "html_")))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{kinds}, text string, n_chars long")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_text": op8_html_text}
ORACLES: dict[str, str] = {}
