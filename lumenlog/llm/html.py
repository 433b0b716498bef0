"""Main text of web pages: parser events to blocks, text-to-tag ratios smoothed and clustered to content regions."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenlog.llm.common import batches, table

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set("head script style noscript template nav footer header aside form button select option textarea input iframe object embed canvas svg math audio video map dialog menu".split())
MAIN = {"article", "main"}
#: Words of class, id or role that name what is not the article.
NOISE = set("ad ads adbox advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar widget".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPACE = re.compile(r"[ \t\n\r\f\v  -     　]+")
NAMES = re.compile(r"[a-z0-9]+")
#: Words beside those in the name of a part of the page; a name with other words as well ("notice-of-motion") may tell a topic.
LAYOUT = set("area aside bar block body bottom box card col column container content entry feed footer form head header inner item items left line link links list main module outer page panel post posts right row section site slot stack strip thread title top unit user wrap wrapper zone".split())
#: Names that start so tell of a wrapper; a name with "header" and other words names a page's head only with these.
STATES = set("has with without no is not show hide".split())
HEADS = set("header site global top".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEAVES = HEADINGS | set("p li ul ol dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th caption hgroup header".split())
SURE = (0,)
SIGMA = 1.0
OUTSIDE = 0.25  # weight of a block outside of article and main, where there are such
NAMED = 0.5  # weight of a block with a word of NOISE in the longer name of an element around it
ALIKE = math.log(3)  # ratios within this factor are one cluster
REGION = 0.9  # of the content in the element that is taken


class Blocks(HTMLParser):
    """A text split at block-level tags: `blocks` holds (text, tags in it, main region or 0, dropped, container, heading, share of links, named).

    What drops a block is (0,), or the number of the innermost element around it whose name alone speaks against it;
    `named` is the number of the innermost one whose name only has a noise word among others, or 0."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, tuple, int, bool, float, int]] = []
        self.stack: list[tuple[str, tuple, int, int, int]] = []  # tag, what drops from here, main region, container, named
        self.open: dict[str, int] = {}  # elements of each tag on the stack
        self.doubts: dict[int, int] = {}  # what drops around each element that does, or 0
        self.names: dict[int, int] = {}  # the same for those that are named
        self.parts: list[str] = []
        self.tags, self.regions, self.opened = 0, 0, 0
        self.in_link, self.linked = False, 0
        self.around: dict[int, int] = {}  # container of each container, 0: the page
        self.bodies: set[int] = {0}  # containers that are the page as a whole

    def _state(self) -> tuple[tuple, int, int]:
        return (self.stack[-1][1], self.stack[-1][2], self.stack[-1][4]) if self.stack else ((), 0, 0)

    def _close(self, i: int) -> None:
        for element in self.stack[i:]:
            self.open[element[0]] -= 1
        del self.stack[i:]

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip(" ")
        dropped, region, named = self._state()
        if text:
            self.blocks.append((text, self.tags, region, dropped, self.stack[-1][3] if self.stack else 0, any(e[0] in HEADINGS for e in self.stack[-2:]), min(1.0, self.linked / len(text)), named))
            self.tags = 0
        self.parts, self.in_link, self.linked = [], False, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        self.in_link = self.in_link or tag == "a"
        while self.stack and self.stack[-1][0] in CLOSES.get(tag, ()):
            self._close(len(self.stack) - 1)
        dropped, region, named = before, _, outer = self._state()
        self.opened += 1
        if tag in MAIN and dropped != SURE:
            if not region:
                self.regions += 1
                region = self.regions
            elif tag == "article" and self.open.get("article"):
                dropped = SURE  # an article inside an article is a comment
        if dropped != SURE:
            noise = 2 if tag in DROPPED and not (tag == "header" and region) else self._noise(tag, attrs, region)
            if noise >= 1:
                self.doubts[self.opened] = sum(before)
                dropped = SURE if noise == 2 else (self.opened,)
            elif noise:
                named = self.opened
                self.names[named] = outer
        if tag in INLINE and dropped == before and named == outer:
            return  # inline tags are often left open
        if dropped != before or named != outer:
            self.flush()
        container = self.stack[-1][3] if self.stack and tag in LEAVES else self.opened if tag not in LEAVES else 0
        if container == self.opened:
            self.around[container] = self.stack[-1][3] if self.stack else 0
            if tag in ("html", "body"):
                self.bodies.add(container)
        self.stack.append((tag, dropped, region, container, named))
        self.open[tag] = self.open.get(tag, 0) + 1

    @staticmethod
    def _noise(tag: str, attrs: list, region: int) -> float:
        """2: not the article; 1: not the article unless it holds most of the text; 0.5: lowers the ratio; 0: nothing speaks against it."""
        if tag in ("html", "body", "article", "main"):
            return 0
        found = 0
        for name, value in attrs:
            if value and name in ("class", "id"):
                for words in map(NAMES.findall, value.lower().split()):
                    noise = NOISE.intersection(words)
                    if not noise or words[0] in STATES or noise == {"header"} and (region or not HEADS.issuperset(words)):
                        continue
                    if NOISE.issuperset(words):
                        found = 2
                    elif all(w in NOISE or w in LAYOUT or w.isdigit() for w in words):
                        found = max(found, 1)
                    else:
                        found = max(found, 0.5)
            if value and name == "role" and value.lower() in ROLES:
                return 2
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return 2
        return found

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.in_link = False
        if tag not in INLINE:
            self.flush()
        if not self.open.get(tag):
            return
        if self._state()[0] or self._state()[2]:
            self.flush()
        i = len(self.stack) - 1
        while self.stack[i][0] != tag:
            i -= 1
        self._close(i)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.in_link:
            self.linked += len(data)


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over neighbouring blocks."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for k, w in enumerate(kernel):
            j = i + k - reach
            if 0 <= j < len(ratios):
                total += w * ratios[j]
                weight += w
        out.append(total / weight)
    return out


def two_clusters(values: list[float]) -> float:
    """The value that parts the low cluster from the high one (two means); the least value if all are much alike."""
    low, high = min(values), max(values)
    if high - low < ALIKE:
        return low
    for _ in range(32):
        middle = (low + high) / 2
        below, above = [v for v in values if v < middle], [v for v in values if v >= middle]
        means = sum(below) / len(below), sum(above) / len(above)
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The article of a page, its blocks joined by one space; empty if there is none.

    1. A block is a line of the method: the text between two block-level tags. Those that tags or names tell to be no
       part of an article are left out; an element that holds most of the page's text isn't, if its name has a noise word
       and words of layout. A noise word in a name with other words ("notice-of-motion") only halves the ratio, if the element
       does not hold most of the text.
    2. The ratio of a block is the characters of its text by the tags in and before it, a quarter of that outside of
       `article` and `main` where a page has them. Ratios are smoothed over neighbours (`sigma`), then lowered by the share
       of links in the block's own text and by names, and two clusters of their logarithms tell content from the rest.
    3. The content region is the innermost element with nearly all of the content. It is taken with
       the content and headings next to it; inside, blocks of the low cluster go if their weight is lowered by a name or
       if three or more in a row are links alone, and all others stay, as nothing else of an article may be dropped. Where that is the page itself, the
       blocks from the first to the last of the content are taken, with the headings before them and those next to
       them in a container of theirs.
    """
    if not html:
        return ""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    blocks = [b for b in parser.blocks if b[3] != SURE]
    held = dict.fromkeys(parser.doubts, 0)
    for b in blocks:
        for k in b[3]:
            held[k] += len(b[0])
    _sum_outwards(held, parser.doubts)
    most = sum(len(b[0]) for b in blocks) / 2
    lines = [b for b in blocks if all(held[k] > most for k in b[3])]
    if not lines:
        return ""
    under = dict.fromkeys(parser.names, 0)
    for b in lines:
        if b[7]:
            under[b[7]] += len(b[0])
    _sum_outwards(under, parser.names)
    most = sum(len(b[0]) for b in lines) / 2
    named = [b[7] > 0 and under[b[7]] <= most for b in lines]
    semantic = any(b[2] for b in lines)
    ratio = smoothed([len(b[0]) / max(1, b[1]) * (OUTSIDE if semantic and not b[2] else 1) for b in lines], sigma)
    score = [math.log1p(r * (1 - b[6]) * (NAMED if n else 1)) for r, b, n in zip(ratio, lines, named, strict=True)]
    threshold = two_clusters(score)
    content = [i for i, r in enumerate(score) if r >= threshold]
    weight = dict.fromkeys(parser.around, 0)
    for i in content:
        if lines[i][4]:
            weight[lines[i][4]] += len(lines[i][0])
    _sum_outwards(weight, parser.around)
    enough = REGION * sum(len(lines[i][0]) for i in content)
    region = max((c for c, n in weight.items() if n >= enough), default=0)  # inner elements are opened later
    first, last = content[0], content[-1]
    if region not in parser.bodies:
        inside = {region}
        for c, outer in parser.around.items():  # outer ones come first
            if outer in inside:
                inside.add(c)
        taken = [i for i, b in enumerate(lines) if b[4] in inside]
        first, last = taken[0], taken[-1]
        while last + 1 < len(lines) and score[last + 1] >= threshold:
            last += 1
            taken.append(last)
    else:
        inside = {b[4] for b in lines[first : last + 1]} - parser.bodies
        while first and lines[first - 1][4] in inside:
            first -= 1
        while last + 1 < len(lines) and lines[last + 1][4] in inside:
            last += 1
        taken = list(range(first, last + 1))
    while first and (lines[first - 1][5] or score[first - 1] >= threshold):
        first -= 1
        taken.insert(0, first)
    return " ".join(lines[i][0] for i in taken if score[i] >= threshold or not named[i] and not _menu(lines, i))


def _sum_outwards(totals: dict[int, int], around: dict[int, int]) -> None:
    """Adds the total of each element to that of the one around it, inner ones (opened later) first."""
    for k in sorted(totals, reverse=True):
        if around[k]:
            totals[around[k]] += totals[k]


def _menu(lines: list[tuple], i: int) -> bool:
    """Whether a block stands in a row of three or more, all of which are links and nothing else."""

    def link(j: int) -> bool:
        return 0 <= j < len(lines) and lines[j][6] == 1

    return link(i) and any(link(j) and link(j + 1) and link(j + 2) for j in (i - 2, i - 1, i))


def _extract(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(items, "html"):
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id").combine_chunks(), batch.column("url").combine_chunks(), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars` per row of `pages(page_id, url, html)`, in one pass without a shuffle.

    Null or empty html gives an empty text; broken markup is read as far as it goes; rows that repeat are extracted
    each; an empty table gives no rows; other columns are ignored. Whole pages of any length are read, in time linear in
    it and its nesting; rows are regrouped by bytes, so memory depends on the longest page. Equal scores are one cluster."""
    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
