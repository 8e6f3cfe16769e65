"""Main text of web pages by text-to-tag ratios.

The standard library's parser is read as a stream of events. Block tags cut the page into
lines; each line knows its text, its tags, its link text and the containers it lies in. What
is a menu, header, footer, sidebar, notice, advert, form, script, style or reader comment by
its tag, role, class or id is left out with all it holds. A class or id names such a part by
its whole or its last word before words of layout (`sidebar`, `cookie-notice`, `comments-area`).
It is not followed for what holds the article or most of the clustered text, nor where nothing
would be left of the page; a form is such a part too, so a page inside one form keeps its text.
The text-to-tag ratios of the other
lines are smoothed by a Gaussian and cut by a threshold into clusters of content. The content
region is the `article` or `main` around most of the clustered text, or without one the
smallest container of all clustered lines that are not lists of links. An article loses the runs
of link lines that lie for the most part outside the clusters, and the lists of links that
smoothing alone brought into one; another region loses single link lines of that kind too.

Character references are decoded. White space inside a line becomes one space, lines are
trimmed and joined in page order by one space, nothing is shortened.
Time grows in proportion to the page, however deep or broken its markup is. A null or empty
page, and a page without text, has an empty text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.5
#: share of the clustered text that the content region must hold
MOST = 0.7
#: share of link text from which a line outside the clusters is a link list
LINKED = 0.6

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split())
_OUT = frozenset(
    "aside button datalist dialog footer head iframe input label legend menu nav noscript object option script "
    "select style svg template textarea title canvas audio video math".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar note".split())
_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "cookie cookies consent copyright disqus disclaimer footer form gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination popup promo promotion related recommended respond "
    "search share sharing sidebar signup sponsor sponsored social subscribe toolbar topbar widget widgets".split())
# what readers wrote is no article, however long it is
_READERS = frozenset("comment comments commentlist disqus respond".split())
# words of layout that may follow a name, and words of state that make it say something else
_LAYOUT = frozenset(
    "area bar block body bottom box buttons col column container content group holder inner items left link links list "
    "outer panel posts primary region right row secondary section slot tertiary top unit wrap wrapper zone".split())
_STATE = frozenset("has have is no not with without".split())
_WHOLE = frozenset(("article", "main"))
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
# controls that are left out, but for those in the middle of a sentence
_CONTROLS = frozenset(("button", "label"))
# a tag that cannot stand inside an open one of its kind closes it
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",)}
_WORDY = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _left_out(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element is no part of an article; `inside` an article its own header is."""
    if tag in _OUT or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if tag == "header" and not inside:
        return True
    return attrs.get("role", "").strip().lower() in _ROLES


def _named(tag: str, attrs: dict[str, str], inside: bool) -> str:
    """The name by which a class or id says that an element is no part of an article, or nothing."""
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if names == " " or tag in ("html", "body", "article", "main") or inside and tag in ("header", "h1", "h2", "h3"):
        return ""
    for name in names.split():
        parts = [n.rstrip("0123456789") for n in _SPLIT.split(_WORDY.sub("-", name).lower())]
        parts = [n for n in parts if n]
        while len(parts) > 1 and parts[-1] in _LAYOUT:
            parts.pop()
        if parts and parts[-1] in _NAMES and parts[0] not in _STATE:
            return parts[-1]
    return ""


_Line = tuple[str, int, int, int]


class _Reader(HTMLParser):
    """Lines as (text, tags by part, link characters, innermost container, part).

    Containers are numbered in the order they open, so those inside one have the numbers that
    follow its own; `parent` names the next one out. So are the parts, the elements whose names
    say that they are left out; what is in none of them is in part 0.
    """

    def __init__(self, by_name: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.by_name = by_name
        self.lines: list[tuple[str, dict[int, int], int, int, int]] = []
        self.part = 0
        self.around: list[int] = [0]                      # of each part: the next one out
        self.readers: list[bool] = [False]                # whether readers wrote it
        self.within: list[bool] = [False]                 # whether it lies in an article or main
        self.holds: list[set[str]] = [set()]              # which of article and main it holds
        self.outside: set[str] = set()                    # which of them have text that is in no part
        self.kind: list[str] = ["page"]
        self.parent: list[int] = [0]
        self.open: list[tuple[str, bool, int, int]] = []  # tag, left out, its container or -1, part around it
        self.counts: Counter[str] = Counter()
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # where in `open` each tag stands
        self.blocks: list[int] = []                       # where in `open` the blocks stand
        self.box = 0
        self.text: list[str] = []
        self.tags: dict[int, int] = {}
        self.linked = self.skipped = self.links = 0

    def read(self, page: str) -> None:
        self.feed(page)
        self.close()
        self.cut()

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.box, self.part))
            self.tags = {}
            if not self.part:
                self.outside.update(t for t in _WHOLE if self.counts[t])
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for other in _CLOSES.get(tag, ()):
            if self.open and self.open[-1][0] == other:
                self.leave()
        if tag in _BLOCK:
            self.cut()
        self.count()
        if tag in _VOID:
            return
        inside, values = any(self.counts[t] for t in _WHOLE), {k: v or "" for k, v in attrs}
        amid = tag in _CONTROLS and any(not t.isspace() for t in self.text)
        out, part = not amid and _left_out(tag, values, inside), self.part
        name = ""
        if not out and not self.skipped:
            name = "form" if tag == "form" else _named(tag, values, inside) if self.by_name else ""
        if tag in _WHOLE and not self.skipped:
            at = part
            while at and tag not in self.holds[at]:
                self.holds[at].add(tag)
                at = self.around[at]
        here = -1
        if tag in _BLOCK and tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "tr", "pre"):
            here = len(self.kind)
            self.kind.append(tag)
            self.parent.append(self.box)
            self.box = here
        if out or name:
            self.cut()
        if name:
            self.part = len(self.around)
            self.around.append(part)
            self.readers.append(name in _READERS)
            self.within.append(inside)
            self.holds.append(set())
        self.places[tag].append(len(self.open))
        if tag in _BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((tag, out, here, part))
        self.counts[tag] += 1
        self.skipped += out
        self.links += tag == "a"

    def count(self) -> None:
        if not self.skipped:
            self.tags[self.part] = self.tags.get(self.part, 0) + 1

    def leave(self) -> None:
        tag, out, here, part = self.open.pop()
        self.places[tag].pop()
        if tag in _BLOCK:
            self.blocks.pop()
        if tag in _BLOCK or out or part != self.part:
            self.cut()
        self.part = part
        if here >= 0:
            self.box = self.parent[here]
        self.counts[tag] -= 1
        self.skipped -= out
        self.links -= tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.count()
        if not self.counts[tag]:
            if tag in _BLOCK:
                self.cut()
            return
        if tag not in _BLOCK and self.blocks and self.blocks[-1] > self.places[tag][-1]:
            return                                       # an inline end tag does not close blocks
        while True:
            last = self.open[-1][0]
            self.leave()
            if last == tag:
                return

    def without(self, out: list[bool]) -> list[_Line]:
        """(text, tags, link characters, container) of the lines in no part that is `out`."""
        found, tags = [], 0
        for text, counts, linked, at, part in self.lines:
            tags += sum(n for p, n in counts.items() if not out[p])
            if not out[part]:
                found.append((text, tags, linked, at))
                tags = 0
        return found

    def kept(self) -> list[_Line]:
        """The lines that are left when the parts are taken out that are foreign indeed.

        A part stays that holds the `main`, the article, or most of the clustered text. Where an
        article has text elsewhere, an article in a part is a teaser or a comment.
        """
        out = [False] * len(self.around)
        lines = self.without(out)
        if len(out) == 1 or not lines:
            return lines
        size = [0] * len(out)
        for (text, *_, part), content in zip(self.lines, clustered(lines), strict=True):
            size[part] += len(text) * bool(content)
        for part in range(len(out) - 1, 0, -1):
            size[self.around[part]] += size[part]
        for part in range(1, len(out)):
            holds, readers = self.holds[part], self.readers[part]
            stays = "main" in holds or (
                "article" in holds and not (self.outside if readers else "article" in self.outside)) or (
                not readers and size[part] >= MOST * size[0] and (self.within[part] or "article" not in self.outside))
            out[part] = out[self.around[part]] or not stays
        return self.without(out)

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def _closable(page: str) -> str:
    """The page without openings that nothing after them closes, for whose end the parser would look each time.

    An open comment or marked section hides nothing, a `<` after the last `>` is text.
    """
    for opening, closing, instead in (("<![", "]", ""), ("<!--", "-->", ""), ("<", ">", "&lt;")):
        past = page.rfind(closing) + len(closing) if closing in page else 0
        page = page[:past] + page[past:].replace(opening, instead)
    return page


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian, ends extended by their own value."""
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), weights / weights.sum(), mode="valid")


def clustered(lines: list[_Line]) -> np.ndarray:
    """Whether each line is in a cluster; clusters are the runs of such lines."""
    smooth = smoothed(np.array([len(text) / max(tags, 1) for text, tags, _, _ in lines]))
    return smooth >= min(smooth.std(), smooth.max())


def link_lists(lines: list[_Line], linked: np.ndarray, content: np.ndarray, dense: list[bool]) -> np.ndarray:
    """Whether each line is in a list of links that is no content.

    Link lines of one container that follow each other are a list. It is left out where most of
    its lines are outside the clusters, or where its container is `dense`, so that smoothing
    alone brought them in. A link line of its own is none.
    """
    out = np.zeros(len(lines), bool)
    start = 0
    for k in range(1, len(lines) + 1):
        if k < len(lines) and linked[k] and linked[start] and lines[k][3] == lines[start][3]:
            continue
        if linked[start] and k - start > 1:
            out[start:k] = dense[lines[start][3]] or 2 * content[start:k].sum() < k - start
        start = k
    return out


def _read(html: str, by_name: bool) -> _Reader:
    reader = _Reader(by_name)
    try:
        reader.read(html)
    except AssertionError:                               # a marked section the parser has no name for
        reader = _Reader(by_name)
        reader.read(html.replace("<![", "<! ["))
    return reader


def main_text(html: str) -> str:
    """The main text of one page."""
    html = _closable(html)
    reader = _read(html, True)
    lines = reader.kept()
    if not lines and reader.lines:                       # the names took all there is
        reader = _read(html, False)
        lines = reader.kept()
    if not lines:
        return ""
    content = clustered(lines)
    size = np.array([len(text) for text, _, _, _ in lines]) * content
    linked = np.array([n >= LINKED * len(text) for text, _, n, _ in lines])
    own = content & ~linked
    held, last, chars, links, mine = ([0] * len(reader.kind) for _ in range(5))
    for k, (text, _, n, at) in enumerate(lines):
        last[at] = at
        held[at] += int(size[k])
        chars[at] += len(text)
        links[at] += n
        mine[at] += int(own[k])
    for at in range(len(held) - 1, 0, -1):               # what a container holds, its parent holds too
        out = reader.parent[at]
        last[at] = max(last[at], at)
        last[out] = max(last[out], last[at])
        for sums in (held, chars, links, mine):
            sums[out] += sums[at]
    # containers are numbered from the page down, so the last that holds enough is the smallest
    box = max(at for at, n in enumerate(held) if n >= MOST * size.sum())
    whole = box
    while whole and reader.kind[whole] not in _WHOLE:
        whole = reader.parent[whole]
    if whole:
        dense = [links[at] >= LINKED * chars[at] and at != whole for at in range(len(held))]
        lists = link_lists(lines, linked, content, dense)
        return " ".join(text for k, (text, _, _, at) in enumerate(lines) if whole <= at <= last[whole] and not lists[k])
    region = max(at for at, n in enumerate(mine) if n == mine[0]) if mine[0] else box
    return " ".join(
        text for k, (text, _, _, at) in enumerate(lines)
        if region <= at <= last[region] and (not linked[k] or content[k] and (
            box <= at <= last[box] or links[at] < LINKED * chars[at])))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py() or "") for page in batch.column(batch.num_columns - 1)]
        kept = [batch.column(k) for k in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])


def extracted(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The `keep` columns and the main text of every row of `pages`."""
    rows = pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_extract, rows.schema)
