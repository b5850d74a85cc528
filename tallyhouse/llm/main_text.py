"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path: the tags above it with
their classes and ids. For every path the text length and the punctuation per
block are summed up, less what is linked; along the page these ratios are
smoothed over neighbouring blocks, the less the further apart they are in the
tree, and fused with the path's own. Two more things weigh in: where one
container holds most of the text, what stands beside it counts by its share of
text; and a class or id that names side matter counts as a small factor. A path
whose fused ratio reaches a share of the greatest is content. Where the container so found is an article element, all its paths are
content but those that a class or id puts in doubt: the ratios choose the article, and don't cut short or linked blocks out of it. Elements that are
menus, forms, hidden or scripts by their tag or role are never read.

Paths are numbers (a parent's number and a label), so a page takes time linear in
its length, however deep it is nested.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from math import exp, log1p, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|(!--)|[!?/][^>]*+>)""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title noembed noframes xmp annotation annotation-xml desc metadata".split())
_INLINE = frozenset("""a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp select small span strike strong sub sup time tt u var wbr
    math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics
    svg g tspan textpath""".split())  # fmt: skip
_BOILERPLATE = frozenset("nav footer aside form button select option fieldset input dialog menu head".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or id: what is never an article's own text, and what may be its topic too.
_STRANGE = frozenset("ad ads advert adverts advertisement sponsored cookie cookies consent newsletter comment comments commentlist respond replies".split())
_DOUBTFUL = frozenset("sidebar menu nav navbar breadcrumb footer header masthead share social related banner notice promo popup widget".split())
#: no-sidebar, has-ads: what follows in the name is not what the element is.
_ABOUT = frozenset("no not non has with without".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of a text, which never are the container of a page's article.
_OF_TEXT = _HEADINGS | frozenset("p pre ul ol li dl dt dd blockquote figure figcaption address details summary caption".split())
_UNNAMED = _HEADINGS | {"html", "body", "main", "article"}
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these, up to the nearest of the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: The share of the greatest fused ratio from which a path is content.
THRESHOLD = 0.12
#: Blocks on either side that a ratio is smoothed over; beyond siblings each step in the tree halves a neighbour's weight.
WINDOW = 2
#: More punctuation in a block than that doesn't speak for prose.
MOST_POINTS = 10
#: Factors of names: strange ones, and doubtful ones outside and inside an article or main.
STRANGE, DOUBTFUL, DOUBTFUL_INSIDE = 0.05, 0.2, 0.5
#: A container with that share of a level's text holds the article; an article or main counts its text so many times.
DOMINANT, NAMED_ARTICLE = 0.5, 4.0


class Page:
    """A page's paths and blocks.

    Paths are numbered from 0, the whole page, parents before children. A block is
    [path, number, texts, raw length, raw length in links, depth of the lowest
    path between it and the block before].
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.depth, self.factor = [0], [""], [0], [1.0]
        self.number: dict[tuple[int, str], int] = {}
        self.blocks: list[list] = []
        self._read(page)

    def path(self, parent: int, tag: str, label: str, factor: float) -> int:
        found = self.number.setdefault((parent, label), len(self.parent))
        if found == len(self.parent):
            self.parent.append(parent)
            self.tag.append(tag)
            self.depth.append(self.depth[parent] + 1)
            self.factor.append(self.factor[parent] * factor)
        return found

    def _read(self, page: str) -> None:
        stack = [("", 0, False, False, False)]  # tag, path, boilerplate, in an article or main, in a link
        places: dict[str, list[int]] = defaultdict(list)  # of open elements by tag
        block, low, at, n, lower = 0, 0, 0, len(page), None

        def text(raw: str) -> None:
            nonlocal low
            _, path, boilerplate, _, link = stack[-1]
            if boilerplate:
                return
            size = len(raw.strip())
            if not (self.blocks and self.blocks[-1][1] == block and self.blocks[-1][0] == path):
                if not size and not (self.blocks and self.blocks[-1][1] == block):
                    return
                self.blocks.append([path, block, [], 0, 0, min(low, self.depth[path])])
                low = self.depth[path]
            own = self.blocks[-1]
            own[2].append(html.unescape(raw))  # references end with their text
            own[3] += size
            own[4] += size if link else 0

        def cut(k: int) -> None:
            nonlocal low
            for closed in stack[k:]:
                places[closed[0]].pop()
            del stack[k:]
            low = min(low, self.depth[stack[-1][1]])

        def close(targets: set[str], until: set[str]) -> None:
            nearest = lambda tags: max((places[t][-1] for t in tags if places[t]), default=0)
            k = nearest(targets)
            if k > nearest(until):
                cut(k)

        last = page.rfind(">")
        while at < n:
            if at > last:  # no tag ends from here on
                to = page.find("<!--", at)
                text(page[at:] if to < 0 else page[at:to])
                break
            m = _TAG.search(page, at)
            if m is None:
                text(page[at:])
                break
            if at < m.start():
                text(page[at : m.start()])
            at = m.end()
            if m[7]:  # a comment
                to = page.find("-->", m.start() + 2)
                at = n if to < 0 else max(to + 3, m.end())
                continue
            end, tag, attributes = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], (m[5] or "").lower(), m[6] or "")
            if not tag:
                continue
            if tag == "br":
                text(" ")
                continue
            if tag not in _INLINE:
                block += 1
            if end:
                if places[tag]:
                    cut(places[tag][-1])
                continue
            closed = attributes.rstrip().endswith("/")
            if tag in _RAW:
                if closed and tag in ("annotation", "annotation-xml", "desc", "metadata"):
                    continue
                lower = lower if lower is not None else re.sub(r"[A-Z]+", lambda x: x[0].lower(), page)  # keeps its length
                to = lower.find(f"</{tag}", at)
                stop = page.find(">", to) if to >= 0 else -1
                at = n if stop < 0 else stop + 1
                continue
            if tag in _CLOSES_P:
                close({"p"}, {"table", "td", "button"})
            if tag in _CLOSES:
                close(*_CLOSES[tag])
            if tag in _VOID or closed:
                continue
            _, path, boilerplate, inside, link = stack[-1]
            label, factor = tag, 1.0
            if not boilerplate:
                quoted = tag == "footer" and inside and bool(places["blockquote"])  # whose words they are
                boilerplate = (tag in _BOILERPLATE and not quoted) or (tag == "header" and not inside)
                if attributes.strip():
                    hidden, label, factor = _marks(tag, attributes, inside)
                    boilerplate = boilerplate or hidden
            if not boilerplate and (tag not in _INLINE or factor < 1):
                path = self.path(path, tag, label, factor)
            places[tag].append(len(stack))
            stack.append((tag, path, boilerplate, inside or tag in ("article", "main"), link or tag == "a"))


def _marks(tag: str, attributes: str, inside: bool) -> tuple[bool, str, float]:
    """Whether an element is hidden or boilerplate by its attributes, its label and the factor of its names."""
    names, words = [tag], set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True, tag, 1.0
        if name == "role" and value.lower() in _BOILERPLATE_ROLES:
            return True, tag, 1.0
        if name in ("class", "id") and value:
            names.append(re.sub(r"\d+", "0", value.lower()))
            for one in value.split():
                for w in map(str.lower, _PART.findall(one)):
                    if w in _ABOUT:
                        break
                    words.add(w)
    label = " ".join(names)
    if tag in _UNNAMED:
        return False, label, 1.0
    if words & _STRANGE:
        return False, label, STRANGE
    return False, label, (DOUBTFUL_INSIDE if inside else DOUBTFUL) if words & _DOUBTFUL else 1.0


def _ratio(chars: float, points: float, linked: float, n: int) -> float:
    """A path's ratio: text length and punctuation per block, less what is linked."""
    return log1p(chars / n) * (1 + log1p(min(points / n, MOST_POINTS))) * (1 - linked / chars)


def _beside(page: Page, chars: list[float], count: list[int]) -> tuple[list[float], dict[int, float], int]:
    """The factor of each path for standing beside a container that holds most of the text, that of
    the text directly in a path, and the innermost such container. chars and count: unlinked text and blocks of each path itself."""
    n = len(page.parent)
    mass, blocks, children = [c * f for c, f in zip(chars, page.factor, strict=True)], list(count), defaultdict(list)
    own = list(mass)
    for p in range(n - 1, 0, -1):
        mass[page.parent[p]] += mass[p]
        blocks[page.parent[p]] += blocks[p]
        if blocks[p]:
            children[page.parent[p]].append(p)
    weight = lambda p: mass[p] * (NAMED_ARTICLE if page.tag[p] in ("article", "main") else 1.0)
    factor, direct, at = [1.0] * n, {}, 0
    while page.tag[at] != "article":
        held = [p for p in children[at] if (blocks[p] > max(1, count[p]) and page.tag[p] not in _OF_TEXT) or page.tag[p] in ("article", "main")]
        best = max(held, key=lambda p: (weight(p), -p), default=None)
        if best is None or weight(best) <= 0 or weight(best) < DOMINANT * (own[at] + sum(map(weight, children[at]))):
            break
        for p in children[at]:
            if p != best and page.tag[p] not in _HEADINGS:
                factor[p] = min(1.0, sqrt(weight(p) / weight(best)))
        direct[at] = min(1.0, sqrt(own[at] / weight(best)))
        at = best
    for p in range(1, n):
        factor[p] *= factor[page.parent[p]]
    return factor, direct, at


def _own_paths(page: Page, region: int) -> set[int]:
    """The paths of an article element that no class or id puts in doubt; none of another container. An article within it (a reader's
    comment, a teaser) is left to the ratios."""
    own = {region} if page.tag[region] == "article" else set()
    for p in range(region + 1, len(page.parent) if own else 0):
        if page.parent[p] in own and page.tag[p] != "article" and page.factor[p] == page.factor[region]:
            own.add(p)
    return own


def path_scores(page: Page, texts: list[str]) -> tuple[dict[int, float], int]:
    """The fused ratio of every path that holds text, and the path of the container that holds most of it; texts are those of the page's blocks."""
    n = len(page.parent)
    chars, points, linked, count = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n
    for (path, _, _, size, in_links, _), text in zip(page.blocks, texts, strict=True):
        if text:
            chars[path] += len(text)
            points[path] += len(_PUNCTUATION.findall(text))
            linked[path] += len(text) * in_links / max(size, 1) * (0.5 if page.tag[path] in _HEADINGS else 1.0)
            count[path] += 1
    ratio = {p: _ratio(chars[p], points[p], linked[p], count[p]) for p in range(n) if count[p]}
    along, low = [], 0
    for (path, *_, between), text in zip(page.blocks, texts, strict=True):
        low = min(low, between) if along else between
        if text:
            along.append((path, low))
            low = page.depth[path]
    total: dict[int, float] = defaultdict(float)
    for i, (path, _) in enumerate(along):
        summed, weights = ratio[path], 1.0
        for step in (-1, 1):
            shared = page.depth[path]
            for k in range(1, WINDOW + 1):
                j = i + step * k
                if not 0 <= j < len(along):
                    break
                shared = min(shared, along[j if step > 0 else j + 1][1])
                apart = page.depth[path] + page.depth[along[j][0]] - 2 * shared
                weight = exp(-0.5 * k * k) * 0.5 ** max(0, apart - 2)
                summed += weight * ratio[along[j][0]]
                weights += weight
        total[path] += sqrt(ratio[path] * summed / weights)
    factor, direct, region = _beside(page, [c - x for c, x in zip(chars, linked, strict=True)], count)
    return {p: total[p] / count[p] * page.factor[p] * factor[p] * direct.get(p, 1.0) for p in ratio}, region


def main_text(markup: str | None, threshold: float = THRESHOLD, whole_article: bool = False) -> str:
    """The content blocks of a page, in order, one to a line; empty if it has none. With whole_article the threshold
    decides nothing within an article element that the ratios have chosen, unless a class or id is in doubt."""
    if not markup:
        return ""
    page = Page(markup)
    shown = lambda parts: " ".join("".join(parts).split())
    scores, region = path_scores(page, [shown(b[2]) for b in page.blocks])
    best = max(scores.values(), default=0.0)
    own = _own_paths(page, region) if whole_article else set()
    blocks: dict[int, list[str]] = defaultdict(list)
    for path, block, parts, *_ in page.blocks:
        if path in own or scores.get(path, -1.0) >= threshold * best:
            blocks[block].extend(parts)
    return "\n".join(filter(None, map(shown, blocks.values())))


def extract_main_text(pages: DataFrame, page: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """One row per page: page, url, text, n_chars (code points of text).

    Null, empty and unreadable pages give the empty text, an empty table gives an empty one. A page of any length is read
    whole, in time linear in it. Repeated rows give repeated results, in no order; other columns are ignored, also those
    named text or n_chars.
    """
    slim = pages.select(F.col(page), F.col(url), F.col(markup).cast("string").alias("__html"))
    kinds = [f.dataType.simpleString() for f in slim.schema.fields[:2]]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x, whole_article=True) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[page, url, "text", "n_chars"])

    return slim.mapInArrow(run, f"`{page}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long")
