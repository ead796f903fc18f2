"""HTML extraction (operator 1): the article's text from a stream of parser events.

1. The standard library's parser gives start tags, end tags and text one by one; nothing builds a tree.
   End tags that HTML lets authors omit (of paragraphs, list items, table parts, options, the head, links) are
   implied. Block elements end lines.
2. For every line the ratio of its characters to its tags is taken, and the ratios are smoothed with a Gaussian
   along the page, which has no text before its first line and behind its last.
3. A line's prior is 0 in parts that their element, role or whole class or id name marks as menu, header, footer,
   sidebar, notice, advert, form or comments, else 1. Lines whose smoothed ratio times prior reaches the threshold,
   one standard deviation of the smoothed ratios, cluster into content regions; marked lines that do not are no text.
4. Regions are completed by the containers around them, as short lines of an article fall below any threshold. Every
   ``article`` (else ``main``, else block of a class or id such as ``content``) counts, in page order, unless links
   hold over half of each of its lines; the one that holds most of the regions counts anyway. Of the ``main`` or
   block around, the own lines count that are no links; of others, and of what is beside all containers, paragraphs in
   regions, and other lines that are dense by themselves in a region that reaches into a container, with the headings
   above; an ``h1`` above the containers counts if they hold none. Of a
   container, every line counts, but for marked ones. On pages without such a container the regions are the text,
   with the lines between lines of one region.

Ids of headings, paragraphs and inline elements mark nothing, those of sections only where they name an
advert, share bar or comments. Where such a word is but a part of a block's name (``related-work``), the block is
doubtful and the regions decide: it is left out if links hold over half of its characters, or if it has links and
no line in a region; outside of a container also if less than half of its characters are in regions.

Character references are decoded; white space becomes one space; lines are joined by one space. Null
html is empty and gives an empty text, as does a page without content. A comment, declaration or tag without an end reaches to the page's end and is no text. Null ids and repeated rows are
pages like others; an empty table gives no rows; there are no ties; other columns, whatever their names, are not read. Long pages are read whole: every event costs the same however
many elements are open.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: Elements without text of the page, elements that are never part of an article, elements without an end tag, elements inside a line.
TEXTLESS = frozenset("script style noscript template iframe object svg math canvas head title audio video map".split())
OUTSIDE = frozenset("nav footer aside form button select textarea input label dialog menu".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Words that mark an advert, a notice of the site, a share bar or comments wherever they are a whole class or id.
STRONG = (
    r"ads?\d*|ad(?:box|slot|unit|block|wrap\w*)|advert(?:s|isements?)?|adsense|cookie(?!s)\w*|gdpr|newsletter|share|"
    r"comments?(?:list|area|form|section|thread)?|respond|disqus|paywall|popup|modal"
)
#: Words that mark such parts and menus as a class, but stand in slugs of an article's sections too.
WEAK = (
    r"advert\w*|sponsor\w*|promo\w*|banner|cookies|consent|notice\w*|alert|subscribe|\w*menu|\w*nav|navbar|navigation|breadcrumbs?|sidebar|aside|widget|"
    r"replies|footer|login|signup|toolbar|pagination|pager|copyright|disclaimer"
)
#: Words that are doubtful even alone.
VAGUE = r"side|related|recommended|sharing|social|subscription|search|skip|legal|tags"
#: Words beside them that leave a name a part's whole name: ``reader-comments``, but not ``side-effects``.
PLAIN = (
    r"box|bar|block|slot|unit|wrap|wrapper|container|section|area|list|items?|links?|buttons?|btns?|form|panel|text|title|heading|head|header|inner|outer|body|"
    r"content|top|bottom|left|right|reader|user|site|page|main|posts?|articles?|entry|entries|story|stories|icons?|tools?|message|thread|overlay|label|count|this|row|\d+"
)


def _whole(words: str, before: str) -> re.Pattern:
    rest = f"{STRONG}|{WEAK}|{VAGUE}|{PLAIN}"
    return re.compile(rf"(?!(?:content|main|page)[_-]+side)(?:(?:{before})[_-]+)*(?:{words})(?:[_-]+(?:{rest}))*", re.I)


WHOLE_STRONG = _whole(STRONG, f"{VAGUE}|{PLAIN}")
WHOLE = _whole(f"{STRONG}|{WEAK}", f"{VAGUE}|{PLAIN}")
WHOLE_VAGUE = _whole(VAGUE, PLAIN)
#: A word anywhere in a name: a doubtful part, about which its links and the clusters decide.
MARKED = re.compile(rf"(?:^|[\s_-])(?:{STRONG}|{WEAK}|{VAGUE})(?:$|[\s_-])", re.I)
COMMENT = re.compile(rf"(?:(?:{PLAIN}|div)[_-]+)*(?:comments?|repl(?:y|ies))(?:[_-]+(?:{PLAIN}))*", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose id is an anchor or a slug of the article's words.
NAMED = HEADINGS | INLINE | {"p", "section"}
#: Elements of running text.
PROSE = frozenset("p blockquote pre".split())
SURE, DOUBTFUL = 2, 1
#: Marks a site's header, but outside an article only: inside it may hold the article's title.
SITE = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|branding)(?:$|[\s_-])", re.I)
#: Marks what holds an article on pages without ``article`` and ``main``.
HOLDER = re.compile(r"(?:^|[\s_-])(?:content|article|post|entry|story)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Start tags that end an open paragraph.
ENDS_P = HEADINGS | frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section "
    "summary table ul".split()
)
_CELLS = frozenset("table td th caption".split())
_BLOCKS = _CELLS | frozenset("ul ol menu dir dl article section main aside nav blockquote form fieldset figure header footer details body".split())
_ROWS = frozenset("caption colgroup tr td th".split())
_GROUPS = _ROWS | {"tbody", "thead", "tfoot"}
#: Of a start tag: the open elements that it ends, as HTML lets authors omit their end tags, and those beyond which it ends none.
IMPLIED = {
    "li": (frozenset({"li"}), _BLOCKS),
    **dict.fromkeys(("dd", "dt"), (frozenset({"dd", "dt"}), _BLOCKS)),
    **dict.fromkeys(("td", "th"), (_ROWS - {"tr"}, frozenset({"table", "tr"}))),
    "tr": (_ROWS, frozenset({"table"})),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (_GROUPS, frozenset({"table"}))),
    "colgroup": (frozenset({"caption", "colgroup"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    **dict.fromkeys(("rt", "rp"), (frozenset({"rt", "rp"}), frozenset({"ruby"}))),
}
P, BEYOND_P = frozenset({"p"}), _CELLS | {"article", "main", "body", "button", "object"}
#: What a head may hold; another start tag or text ends it.
IN_HEAD = frozenset("html head base link meta title noscript style script template".split())
#: Elements out of which an end tag of another kind does not lead.
TABULAR = _GROUPS | {"table"}
WALLS, OUTER, LISTS = frozenset("article main body".split()), frozenset("html body main article".split()), frozenset("ul ol menu".split())
#: What an element leaves out: nothing, its lines unless a region holds them, its text.
KEPT, LINE, TEXT = 0, 1, 2
SIGMA = 1.0
#: A container inside another counts as its own only if it says more.
RANK = {"page": 0, "holder": 1, "main": 2, "article": 3}


@lru_cache(4096)
def marked(tag: str, classes: str, ident: str) -> int:
    """Whether an element's names mark it: ``SURE`` for a part's whole name, ``DOUBTFUL`` for a word in a name, else 0."""
    tokens, ident = classes.split(), ident.strip()
    if tag in HEADINGS or tag in INLINE:
        return SURE * any(map(WHOLE_STRONG.fullmatch, tokens))
    if any(map(WHOLE.fullmatch, tokens)) or tag != "p" and WHOLE_STRONG.fullmatch(ident):
        return SURE
    return DOUBTFUL * (any(map(WHOLE_VAGUE.fullmatch, tokens)) or tag not in NAMED and MARKED.search(f"{classes} {ident}") is not None)


class Lines(HTMLParser):
    """Lines of a page: [text, tags, container, links, characters in links, doubtful part, heading or paragraph around it, marked].

    Of the open elements, those inside a line are kept only if they are links or leave text out. ``places`` holds the
    places of each name among them, so that no event walks the open elements.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.text: list[str] = []
        self.tags = 0
        self.links = 0
        self.linked = 0
        self.open: list[tuple[str, int, bool, int, int]] = []  # name, what it leaves out, link, container and doubtful part around it
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []  # places of the elements that are not inside a line
        self.containers: list[str] = ["page"]
        self.around: list[int] = [0]  # of each container the one around it
        self.out = [0, 0, 0]  # open elements of each kind: KEPT, LINE, TEXT
        self.anchors = 0
        self.within = 0
        self.doubt = 0
        self.doubts = 0

    def end_line(self) -> None:
        if self.text or self.tags:
            prose = self.open[self.blocks[-1]][0] if self.text and self.blocks else ""
            self.lines.append(["".join(self.text), self.tags, self.within, self.links, self.linked, self.doubt, prose, self.out[LINE] > 0])
            self.text, self.tags, self.links, self.linked = [], 0, 0, 0

    def last(self, names: frozenset[str]) -> int:
        """The place of the innermost open element of the names; -1 without one."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def forget(self, k: int) -> None:
        _, out, link, _, _ = self.open[k]
        self.out[out] -= 1
        self.anchors -= link

    def shut(self, k: int) -> None:
        """Closes the open elements from the k-th on."""
        self.within, self.doubt = self.open[k][3:]
        while len(self.open) > k:
            at = len(self.open) - 1
            self.forget(at)
            name = self.open.pop()[0]
            if name:
                self.places[name].pop()
            if self.blocks and self.blocks[-1] == at:
                self.blocks.pop()

    def shut_alone(self, k: int) -> None:
        """Ends the k-th element, which is inside a line; the blocks in it go on."""
        if k == len(self.open) - 1:
            self.shut(k)
            return
        self.forget(k)
        name, _, _, within, doubt = self.open[k]
        self.places[name].remove(k)
        self.open[k] = ("", KEPT, False, within, doubt)

    def imply(self, names: frozenset[str], beyond: frozenset[str]) -> None:
        """Closes the open ``names`` that are not around one of ``beyond``."""
        k = self.last(names)
        if k < 0 or k < (wall := self.last(beyond)):
            return
        self.shut(min(p for n in names for p in self.places.get(n, ())[-1:] if p > wall))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.end_line()
        elif tag == "a" and self.places.get("a"):
            self.shut_alone(self.places["a"][-1])
        if tag in IMPLIED:
            self.imply(*IMPLIED[tag])
        if tag in ENDS_P:
            self.imply(P, BEYOND_P)
        if self.open:
            last = self.open[-1][0]
            if last == "head" and tag not in IN_HEAD or last in HEADINGS and tag in HEADINGS:
                self.shut(len(self.open) - 1)
        self.tags += 1
        self.links += tag == "a"
        if tag in EMPTY:
            return
        classes, ident = (next((v for k, v in attrs if k == name and v), "") for name in ("class", "id"))
        names = f"{classes} {ident}".strip()
        role = next((v for k, v in attrs if k == "role" and v), "").lower()
        outside = tag in OUTSIDE or role in ROLES or any(k in ("hidden", "aria-hidden") and v != "false" for k, v in attrs)
        outside = outside or tag == "header" and not self.within
        mark = 0
        if names and tag not in ("html", "body", "article", "main"):
            mark = marked(tag, classes, ident)
            outside = outside or mark == SURE or not self.within and SITE.search(names) is not None
        outside = outside or tag == "article" and bool(self.within) and any(map(COMMENT.fullmatch, names.split()))
        out = TEXT if tag in TEXTLESS or outside and tag in INLINE else LINE if outside else KEPT
        inside, kind = self.within, ""
        if tag in ("article", "main") or role == "main":
            kind = "article" if tag == "article" else "main"
        elif tag in ("div", "section", "td") and not out and HOLDER.search(names):
            kind = "holder"
        link = tag == "a" and any(k == "href" for k, _ in attrs)
        if tag in INLINE and not (out or link):
            return
        self.places[tag].append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((tag, out, link, self.within, self.doubt))
        if kind and RANK[kind] > RANK[self.containers[inside]]:
            self.containers.append(kind)
            self.around.append(inside)
            inside = len(self.containers) - 1
            self.doubt = 0  # what is around a container says nothing about it
        elif mark == DOUBTFUL and not out:
            self.doubts += 1
            self.doubt = self.doubts
        self.out[out] += 1
        self.anchors += link
        self.within = inside

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        if not self.places.get(tag):
            return
        k = self.places[tag][-1]
        if tag in INLINE:
            if k > self.last(WALLS | _CELLS):
                self.shut_alone(k)
            return
        if tag not in OUTER and (k < self.last(WALLS) or tag not in TABULAR and k < self.last(_CELLS) or tag == "li" and k < self.last(LISTS)):
            return  # a stray end tag closes nothing beyond the article, the cell or the list
        self.shut(k)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.shut(len(self.open) - 1)
        if not self.out[TEXT]:
            self.text.append(data)
            if self.anchors:
                self.linked += len(data.strip())
        elif data.strip():
            self.text.append(" ")

    def done(self) -> list[list]:
        if re.match(r"<[!?/A-Za-z]", self.rawdata):  # a tag, comment or declaration that the page's end cuts off
            self.rawdata = ""
        self.close()
        self.end_line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios smoothed with a Gaussian of radius 3 sigma; before and behind the page there is no text."""
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, r), k / k.sum(), "valid")


def in_regions(lines: list[tuple]) -> tuple[list[bool], list[bool]]:
    """Which lines cluster: their smoothed ratio of characters to tags, times their prior, reaches one standard deviation; and which reach it unsmoothed."""
    own = np.array([len(t) / max(1, tags) for t, tags, *_ in lines])
    ratios = smoothed(np.pad(own, 1))
    prior = np.array([0.0 if row[-1] else 1.0 for row in lines])
    bar = ratios.std() or np.inf  # lines that are all alike, as none has text, are no region
    return (ratios[1:-1] * prior >= bar).tolist(), (own >= bar).tolist()


def doubtful_menus(lines: list[tuple], content: list[bool]) -> set[int]:
    """The doubtful parts that are no text: links hold over half of their characters, or they have links and no line in a cluster.

    Outside of containers most of a doubtful part's characters must be in clusters as well.
    """
    parts: dict[int, list[int]] = {}
    for (t, _, within, links, linked, doubt, *_), good in zip(lines, content):
        if doubt and t:
            p = parts.setdefault(doubt, [0, 0, 0, 0, within])
            p[0] += len(t)
            p[1] += linked
            p[2] += links
            p[3] += len(t) * good
    return {d for d, (size, linked, links, good, within) in parts.items() if 2 * linked > size or links and not good or not within and 2 * good < size}


def in_containers(lines: list[tuple], content: list[bool], dense: list[bool], parser: Lines) -> list[bool]:
    """Which lines of a page with containers count: see the module's docstring."""
    kinds, around = parser.containers, parser.around
    light = [bool(t) and 2 * linked <= len(t) for t, _, _, linked, _ in lines]
    weight, whole, good = Counter(), Counter(), Counter()
    texts = set()
    for (t, within, *_), c, few in zip(lines, content, light):
        if t and within:
            weight[within] += len(t) * c
            whole[within] += len(t)
            good[within] += len(t) * (c and few)
            if few:
                texts.add(within)
    top = max(RANK[kinds[c]] for c in whole)
    first = [c for c in whole if RANK[kinds[c]] == top]
    kept = {c for c in first if c in texts} | {max(first, key=lambda c: (weight[c], whole[c], -c))}
    outer = set()
    for c in kept:
        while c := around[c]:
            outer.add(c)
    more = {c for c in whole if RANK[kinds[c]] < top and c not in outer and 2 * good[c] > whole[c]}
    found = [bool(t) and (within in kept or within in outer and few or within in more and c) for (t, within, *_), c, few in zip(lines, content, light)]
    # beside the containers: paragraphs and dense lines in regions with the headings above them, and the title if the containers have none
    start, titled = found.index(True), any(f and row[4] == "h1" for f, row in zip(found, lines))
    region = np.cumsum(~np.array(content)).tolist()
    held = {r for r, f, c in zip(region, found, content) if f and c}
    heads = False
    for i in range(len(lines) - 1, -1, -1):
        t, within, _, _, prose = lines[i]
        if within or not light[i]:
            heads = heads and not t
        elif prose in HEADINGS:
            found[i] = heads or prose == "h1" and i < start and not titled
            titled = titled or found[i] and prose == "h1"
        else:
            found[i] = heads = bool(t) and content[i] and (prose in PROSE or dense[i] and region[i] in held)
    return found


def main_text(html: str) -> str:
    """The main text of a page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = [(" ".join(text.split()), *rest) for text, *rest in parser.done()]
    if not any(t for t, *_ in lines):
        return ""
    content, dense = in_regions(lines)
    lines = [("" if out and not good else t, *rest, out) for (t, *rest, out), good in zip(lines, content)]
    menus = doubtful_menus(lines, content)
    lines = [("" if doubt in menus else t, within, links, linked, prose) for t, _, within, links, linked, doubt, prose, _ in lines]
    if any(t and within for t, within, *_ in lines):
        return " ".join(row[0] for row, found in zip(lines, in_containers(lines, content, dense, parser)) if found)
    inside = [(t, content[i], links) for i, (t, _, links, _, _) in enumerate(lines) if t]
    good = [i for i, (_, c, _) in enumerate(inside) if c]
    first, last = (good[0], good[-1]) if good else (0, len(inside) - 1)
    while first > 0 and not inside[first - 1][2]:
        first -= 1
    while last + 1 < len(inside) and not inside[last + 1][2]:
        last += 1
    return " ".join(t for t, _, _ in inside[first : last + 1])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html = batch.column("html")
        for a in range(0, len(html), 256):
            texts = [main_text(h.as_py()) for h in html[a : a + 256]]
            columns = [batch.column(c).slice(a, 256) for c in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
