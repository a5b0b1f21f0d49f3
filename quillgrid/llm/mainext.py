"""Main text of web pages: parser events, text-to-tag ratios per line, smoothing, and a choice of content regions.

The standard library's parser streams a page's events. A line is the text between two block tags, so pages written on
one source line work as well. Lines whose smoothed ratio of characters to tags exceeds the page's threshold form the
content cluster. The innermost element that holds nearly all of the cluster is the core of the content; it is widened to
the article or main element around it (with sibling articles), or to the elements around it whose further lines are
text and not links. All lines of that region that are not in menus, notices and the like are the text, short ones included.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.tables import bounded_batches

#: Gaussian kernel in lines, and the part of the cluster's text that the core must hold.
SIGMA, RADIUS = 1.0, 2
HOLDS = 0.9
_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold one block of text; the other block elements hold blocks.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th caption figcaption summary".split())
_HOLDERS = _BREAKS - _LEAVES - {"hr", "tr"}
#: Never text, whatever surrounds them.
_DEAD = frozenset("head title script style noscript template svg iframe object canvas select textarea button".split())
#: What can stand in a head; any other start tag ends it.
_IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: Dead elements whose end tags are sometimes forgotten.
_LOOSE = re.compile("<(/?)(noscript|template|svg|iframe|object|canvas|select|button)(?=[\\s/>])", re.IGNORECASE)
_ASIDE = frozenset("nav footer aside form dialog".split())
_LISTS = frozenset("ul ol menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: Words of class names and ids that mark what is not the article, and those that mark reader comments.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising nav navbar navigation menu menus sidebar footer header masthead breadcrumb breadcrumbs "
    "sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent notice notices popup popups modal newsletter subscribe "
    "signup login share sharing social related recommend recommended recommendations widget widgets toolbar pagination pager skip".split()
)
#: Of these, the words that mean other things in longer names (`related-work`, `elementor-widget`): there, what a block holds decides.
_DOUBTFUL = frozenset("header banner banners promo promos notice notices share sharing social related recommend recommended recommendations widget widgets skip".split())
#: Characters in a line that is more than a label.
_SENTENCE = 80
_COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: First words that make a class name say something of its element's surroundings (`with-sidebar`).
_MODIFIERS = frozenset("with without no has have is not hide show js".split())
_PLAIN, _DOUBT, _MARKED, _REMARK, _OUT = range(5)


def _mark(name: str, value: str, leaf: bool) -> int:
    """What a class or id attribute says of its element; of a block of text only a name of that very word counts."""
    found = _PLAIN
    for token in re.sub("([a-z])([A-Z])", r"\1-\2", value).lower().split():
        parts = [x for x in re.split("[-_]+", token) if x]
        if not parts or parts[0] in _MODIFIERS or (leaf and len(parts) > 1):
            continue
        if parts[0] in _COMMENTS or parts[-1] in _COMMENTS:
            return _REMARK
        if parts[:2] in (["side", "bar"], ["sign", "up"]) or len(parts) == 1 and parts[0] in _MARKS or {parts[0], parts[-1]} & (_MARKS - _DOUBTFUL):
            found = _MARKED
        elif parts[0] in _DOUBTFUL or parts[-1] in _DOUBTFUL:
            found = max(found, _DOUBT)
    return found


class _Page(HTMLParser):
    """Collects lines as (text, tags, element, characters in links), and elements by number, a parent's before its
    children's: tags, parents, what their attributes say, and whether their end tags came."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        tags = Counter((name.lower(), end) for end, name in _LOOSE.findall(html))
        self.unended = {name for name, _ in tags if tags[name, ""] > tags[name, "/"]}
        self.lines: list[tuple[str, int, int, int]] = []
        self.tag_of, self.parents, self.says, self.ended = [""], [-1], [_PLAIN], [True]
        self.stack = [0]
        self.held: list[str] = []
        self.tags = self.links = self.linked = 0
        self.dead: list[str] = []  # open dead elements
        self.within: Counter[str] = Counter()  # elements opened in the outermost of them and not ended

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.lines.append((text, self.tags, self.stack[-1], min(self.linked, len(text))))
                self.tags = 0
            self.held, self.linked = [], 0

    def revive(self) -> None:
        """Dead elements end here, whatever has become of their end tags."""
        self.dead.clear()
        self.within.clear()

    def imply(self, names: frozenset[str], until: frozenset[str]) -> None:
        """The end of the innermost open element of these names, unless one of `until` is open within it."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.tag_of[self.stack[i]]
            if tag in names:
                del self.stack[i:]
                return
            if tag in until:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.dead and ((self.dead[-1] == "head" and tag not in _IN_HEAD) or (self.dead[-1] in self.unended and tag in _BREAKS) or tag == "body"):
            self.revive()
        if tag in _DEAD:
            self.flush()
            self.dead.append(tag)
            return
        if self.dead:
            if tag not in _VOID:
                self.within[tag] += 1
            return
        if tag in _BREAKS:
            self.flush()
            self.imply(_P, _HOLDERS)
            if tag in _IMPLIED:
                self.imply(*_IMPLIED[tag])
            elif tag in ("article", "main"):
                self.imply(_TOP, _CONTENT)
        self.tags += 1
        if tag == "br":
            self.held.append(" ")
        if tag == "a":
            self.links += 1
        if tag in _VOID:
            return
        says = _PLAIN
        for name, value in attrs:
            if name == "hidden" or (name == "role" and value and value.strip().lower() in _ROLES):
                says = _OUT
            elif value and name in ("class", "id") and tag not in ("html", "body", "main"):
                says = max(says, _mark(name, value, tag in _LEAVES or tag not in _BREAKS))
        if tag == "article" and says in (_DOUBT, _MARKED):
            says = _PLAIN
        if tag in _BREAKS and tag != "hr" or says:
            if says:
                self.flush()
            self.stack.append(len(self.parents))
            self.tag_of.append(tag)
            self.parents.append(self.stack[-2])
            self.says.append(says)
            self.ended.append(False)

    def handle_endtag(self, tag: str) -> None:
        if tag in _DEAD:
            if tag in self.dead:
                del self.dead[len(self.dead) - 1 - self.dead[::-1].index(tag) :]
                if not self.dead:
                    self.within.clear()
            return
        if self.dead:
            if self.within[tag] or self.dead[-1] not in self.unended or tag not in _BREAKS:
                self.within[tag] -= self.within[tag] > 0
                return
            self.revive()  # the end of an element around it
        if tag in _BREAKS:
            self.flush()
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        for i in range(len(self.stack) - 1, 0, -1):
            own = self.tag_of[self.stack[i]]
            if own == tag:
                self.flush()
                self.ended[self.stack[i]] = True
                del self.stack[i:]
                return
            if tag in _LEAVES and own in _HOLDERS:
                return

    def handle_data(self, data: str) -> None:
        if not self.dead:
            self.held.append(data)
            if self.links:
                self.linked += len(data.strip())


_P, _CONTENT, _TOP = frozenset(["p"]), frozenset(["article", "main"]), frozenset(["nav", "header"])
_TABLE = frozenset(["table"])
#: Start tags that end an element before them: its names, and what keeps it open.
_IMPLIED = {
    "li": (frozenset(["li"]), _LISTS), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), _TABLE | {"tr"}), "th": (frozenset(["td", "th"]), _TABLE | {"tr"}), "tr": (frozenset(["tr"]), _TABLE),
}


def smoothed_ratios(lines: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Characters per tag of each line, smoothed over its neighbours by a Gaussian kernel."""
    ratios = np.array([len(line[0]) / max(1, line[1]) for line in lines])
    weight = np.convolve(np.ones(len(ratios)), _KERNEL, mode="full")[RADIUS : RADIUS + len(ratios)]
    return np.convolve(ratios, _KERNEL, mode="full")[RADIUS : RADIUS + len(ratios)] / weight


def _summed(parents: list[int], own: np.ndarray) -> np.ndarray:
    """own, with every element's children added."""
    total = own.copy()
    for element in range(len(parents) - 1, 0, -1):
        total[parents[element]] += total[element]
    return total


def _left_out(page: _Page) -> list[bool]:
    """Of each element, whether its text is not part of an article: menus, notices, forms and the like.

    A wrapper is not left out for its class if it holds an article, a main element or a first-level heading, or, unless
    it says it holds comments, half of the page's text; nor is a form that does. A doubtful name counts for a block that is
    mostly links or, outside of articles, only labels.
    """
    tags, parents = page.tag_of, page.parents
    size = np.zeros(len(tags))
    linked, longest = np.zeros(len(tags)), np.zeros(len(tags))
    for text, _, element, links in page.lines:
        size[element] += len(text)
        linked[element] += links
        longest[element] = max(longest[element], len(text))
    size, linked = _summed(parents, size), _summed(parents, linked)
    for e in range(len(tags) - 1, 0, -1):
        longest[parents[e]] = max(longest[parents[e]], longest[e])
    holds = _summed(parents, np.array([float(t in ("article", "main", "h1")) for t in tags])) - np.array([float(t in ("article", "main", "h1")) for t in tags])
    inside = [False] * len(tags)  # of an article or main element
    out = [False] * len(tags)
    for e in range(1, len(tags)):
        tag, up, says = tags[e], parents[e], page.says[e]
        inside[e] = inside[up] or tag in _CONTENT
        wraps = holds[e] > 0 or tag in _CONTENT or tag == "h1"
        own = says == _OUT or (says == _REMARK and not wraps) or (says == _MARKED and not wraps and 2 * size[e] < size[0])
        own |= says == _REMARK and tag == "article"
        own |= says == _DOUBT and not wraps and 2 * size[e] < size[0] and (2 * linked[e] >= size[e] or (longest[e] < _SENTENCE and not inside[e]))
        if tag == "header":
            own |= not inside[e]
        elif tag == "form":
            own |= not (wraps or 2 * size[e] >= size[0])
        elif tag == "nav":
            own |= page.ended[e]
        elif tag in _ASIDE:
            own = True
        # Of a menu that is never closed only the lists are out.
        own |= tag in _LISTS and tags[up] == "nav" and not page.ended[up]
        out[e] = out[up] or own
    return out


def main_text(html: str) -> str:
    """The main text of a page: its content regions' blocks in page order, joined by line feeds; empty if none."""
    if not html:
        return ""
    page = _Page(html)
    page.feed(html)
    page.close()
    page.flush()
    out, tags, parents = _left_out(page), page.tag_of, page.parents
    lines = [line for line in page.lines if not out[line[2]]]
    if not lines:
        return ""
    ratios = smoothed_ratios(lines)
    cluster = ratios >= min(ratios.max(), max(ratios.std(), 0.5 * ratios.mean()))
    own, size, linked = np.zeros(len(parents)), np.zeros(len(parents)), np.zeros(len(parents))
    for chosen, (text, _, element, links) in zip(cluster.tolist(), lines, strict=True):
        own[element] += len(text) if chosen else 0
        size[element] += len(text)
        linked[element] += links
    weight, whole, links = _summed(parents, own), _summed(parents, size), _summed(parents, linked)
    region = max((e for e in range(len(parents)) if weight[e] >= HOLDS * own.sum()), default=0)
    above = [region]
    while above[-1] > 0:
        above.append(parents[above[-1]])
    around = [e for e in above if tags[e] == "article"][-1:] or [e for e in above if tags[e] == "main"][-1:]
    if around:
        regions = around + [e for e in range(len(parents)) if tags[e] == "article" and parents[e] == parents[around[0]] and weight[e] > 0]
    else:
        for up in above[1:]:
            more, more_links = whole[up] - whole[region], links[up] - links[region]
            if tags[up] in ("body", "html", ""):  # the page: only for blocks of text that stand in it by themselves
                direct = sum(size[e] for e in range(len(parents)) if (e == up or (parents[e] == up and tags[e] in _LEAVES)) and not out[e])
                if more > direct:
                    break
            if more_links * 2 > more:
                break
            region = up
        regions = [region]
    held = np.zeros(len(parents), dtype=bool)
    held[regions] = True
    for element in range(1, len(parents)):
        held[element] |= held[parents[element]]
    return "\n".join(text for text, _, element, _ in lines if held[element])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py() or "") for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row of pages (columns page_id, url, html).

    Null or empty html gives an empty text; all rows stay, repeated ones too.
    """
    plain = bounded_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
