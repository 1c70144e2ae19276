"""HTML main-text extraction by tag-path ratios.

A page is read into text blocks, each with its root-to-leaf tag path (class and id
names included), its length, punctuation and linked length. Per path the unlinked text
length and the punctuation are summed over the page and divided by the path's nodes.
The two ratios are smoothed over neighbouring blocks, the less the further apart their
paths branch, and fused as their geometric mean, times the path's share of unlinked
text. What tags, classes, ids and roles say of menus, headers, footers, notices, adverts
or forms shifts a path's score by one factor of ``doubt``, which is moderate: the ratios
decide. It counts for more only on a page of little text, where ratios rest on few
characters (the exponent is 1 and ``little`` characters over those of the page). Two
kinds of prose look like an article's by any ratio, that of sidebars and of readers'
comments; elements that say so shift by ``other_prose``, unless the page's title, its
main element or all of its text is inside. Inside an article or main element an id is an
anchor, and casts doubt only if all its words do.

Paths at or above ``threshold`` times the page's mean, which takes every block by its
weight, are content nodes, and they alone choose the region: the least element that
holds all of them and the headings before the first of them, widened to the article or
main elements in which they stand. Blocks of the region that are neither content nodes
nor doubtful (shifted, or mostly links) belong to it, short ones included; so do
paragraphs, headings and lists that stand free beside it or its parents. Where the
region is a whole page or table, only parts that hold content or stand between two that
do belong to it.

Defined results: null, empty or text-free html gives an empty text. Hidden elements
are no text. Unclosed tags end with their parents; unclosed comments, scripts and
styles run to the end. Work is linear in a page's length, however deep it nests.
Repeated rows are extracted alike. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, inline elements, elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video".split())
DROPPED = RAW | frozenset("head nav footer aside form button select textarea option dialog menu input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold running text, and stand free if no other element parts them from the article's parents.
FLOW = INLINE | HEADINGS | frozenset("p blockquote pre ul ol li dl dt dd figure figcaption".split())
#: Names that mark a part as no content, as whole words of a class, id or role.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead topbar footer foot bottom sidebar side aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login form search comment comments commentlist disqus respond reply replies share sharing social related recommended pagination pager "
    "toolbar skip legal copyright complementary contentinfo dialog".split()
)
#: Names of an article's own parts; beside one, a name of layout alone doesn't mark noise.
CONTENT = frozenset("article body content entry main post story text".split())
LAYOUT = frozenset("ad ads banner bottom header legal masthead search share sharing side skip social".split())
#: Names of what readers wrote, which may be longer than the article.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Names of what stands beside an article and may be prose like it.
BESIDE = frozenset("sidebar side aside related recommended newsletter subscribe subscription complementary widget".split())
#: First words of names that tell what an element has, not what it is.
STATES = frozenset("has with without no not".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"']+)))?|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)""")
_WORDS = re.compile(r"[^a-z0-9]+")
#: Signs that end a sentence or a part of one, not those inside of names and numbers.
_SIGNS = re.compile(r"[.,;:!?…](?=\s|\Z)|[。、！？]")


class Element(NamedTuple):
    """An element of the page; ``path`` numbers its tag path, on which inline elements are no step."""

    name: str
    number: int
    path: int
    linked: bool
    in_article: bool
    doubted: bool
    hidden: bool


class Block(NamedTuple):
    text: str
    path: int
    parent: int
    linked: int


class Page(NamedTuple):
    """A page's text blocks in order, and its elements and paths by number (0 stands above all); parents precede children."""

    blocks: list[Block]
    tags: list[str]
    above: list[int]
    article: list[int]
    doubted: list[bool]
    prose: list[bool]
    path_above: list[int]
    path_depth: list[int]


def _names(rest: str, in_article: bool = False) -> tuple[str, frozenset[str], bool]:
    """The class, id and role of a tag as one string, the words in them that cast doubt, and whether the tag is hidden."""
    words, anchors, marks, hidden = [], [], set(), False
    for key, a, b, c in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), (a or b or c).strip().lower()
        if key == "hidden":
            hidden |= value in ("", "hidden")
        elif key == "aria-hidden" and value == "true":
            marks.add(key)
        elif key == "id" and in_article and not all(w in NOISE or not w.isalpha() for w in _WORDS.split(value)):
            anchors += value.split()
        elif key in ("class", "id", "role"):
            words += value.split()
    parts = [p for p in map(_WORDS.split, words) if p[0] not in STATES]
    said = {w for p in parts for w in p}
    noise = said & NOISE
    return ".".join(words + anchors), frozenset(marks | (noise - LAYOUT if said & CONTENT else noise)), hidden


def _around_all(blocks: list[Block], tags: list[str], above: list[int], marked: dict[int, frozenset[str]]) -> set[int]:
    """Marked elements that hold the page's title, its main element or all of its unlinked text: no sidebar and no comments."""
    weight, holds = [0] * len(tags), [False] * len(tags)
    shown = {b.parent for b in blocks}
    title = False
    for e in range(1, len(tags)):
        # the first shown h1 is the title; an article is a page's own if nothing above it says that readers wrote it
        if tags[e] == "main" or (tags[e] == "h1" and not title):
            holds[e] = True
            title |= tags[e] == "h1"
    for b in blocks:
        weight[b.parent] += len(b.text) - b.linked
    article = [e for e in range(1, len(tags)) if tags[e] == "article"]
    for e in range(len(tags) - 1, 0, -1):
        weight[above[e]] += weight[e]
        holds[above[e]] |= holds[e]
    if article and shown:
        e = max(article, key=lambda e: weight[e])
        while e := above[e]:
            holds[e] |= e in marked and not marked[e] & READERS and 2 * weight[e] > weight[0]
    return {e for e in marked if holds[e] or weight[e] == weight[0]}


def read_page(page: str) -> Page:
    """The text blocks of a page, in page order, hidden elements left out."""
    root = Element("", 0, 0, False, False, False, False)
    stack: list[Element] = [root]
    open_names: Counter[str] = Counter()
    blocks: list[Block] = []
    tags, above, own_doubt, own_prose = [""], [0], [False], [False]
    path_above, path_depth, paths = [0], [0], {}
    marked: dict[int, frozenset[str]] = {}
    text: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join("".join(text).split())
            if joined and not stack[-1].hidden:
                blocks.append(Block(joined, stack[-1].path, stack[-1].number, min(linked, len(joined))))
            text, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text.append(html.unescape(raw))
            if stack[-1].linked:
                linked += len(text[-1])

    def cut(i: int) -> None:
        for e in stack[i:]:
            open_names[e.name] -= 1
        del stack[i:]

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if m["cdata"]:
            text.append(m["cdata"])
        if not name:
            continue
        if name not in INLINE:
            flush()
        if m["end"]:
            if open_names[name]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        if any(e.name not in INLINE for e in stack[i:]):
                            flush()
                        cut(i)
                        break
                    if stack[i].name in ("article", "main", "body") and name in INLINE | {"p", "li"}:
                        break
            continue
        if name in RAW and not m["rest"].endswith("/"):
            close = re.compile(rf"</{name}\s*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name == "br":
            text.append(" ")
        if name in VOID or m["rest"].endswith("/"):
            continue
        if name not in INLINE:
            # a new block ends an open paragraph; an item or cell ends its elder sibling
            for closing in ("p", name if name in ("li", "dt", "dd", "tr", "td", "th", "option") else "p"):
                if open_names[closing]:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].name == closing:
                            cut(i)
                            break
                        if stack[i].name not in INLINE:
                            break
        up = stack[-1]
        called, marks, hidden = _names(m["rest"], up.in_article)
        number = len(tags)
        tags.append(name)
        above.append(up.number)
        own_doubt.append((name in DROPPED and name != "form") or (name == "header" and not up.in_article))
        own_prose.append(name == "aside")
        if name == "form":
            marks |= {"form"}
        if marks and name not in ("html", "body", "article", "main", "h1", "h2", "h3"):
            marked[number] = marks
        path = up.path
        if name not in INLINE:
            step = (up.path, f"{name}.{called}" if called else name)
            path = paths.setdefault(step, len(path_above))
            if path == len(path_above):
                path_above.append(up.path)
                path_depth.append(path_depth[up.path] + 1)
        stack.append(Element(name, number, path, up.linked or name == "a", up.in_article or name in ("article", "main"), up.doubted or own_doubt[-1], up.hidden or hidden))
        open_names[name] += 1
    flush()
    waived = _around_all(blocks, tags, above, marked)
    for e, words in marked.items():
        if e not in waived:
            own_prose[e] |= bool(words & (READERS | BESIDE))
            own_doubt[e] = True
    prose, doubted = own_prose, own_doubt
    article = [0] * len(tags)
    for e in range(1, len(tags)):
        doubted[e] |= doubted[above[e]]
        prose[e] |= prose[above[e]]
        article[e] = article[above[e]] or (e if tags[e] in ("article", "main") else 0)
    return Page(blocks, tags, above, article, doubted, prose, path_above, path_depth)


def _apart(a: int, b: int, page: Page, most: int = 6) -> int:
    """Steps from one path to another over where they branch, ``most`` at most."""
    steps = 0
    while a != b and steps < most:
        if page.path_depth[a] >= page.path_depth[b]:
            a = page.path_above[a]
        else:
            b = page.path_above[b]
        steps += 1
    return steps


def doubts(page: Page, doubt: float = 0.5, other_prose: float = 0.02, little: int = 1200) -> list[float]:
    """By what factor each element's marks shift the scores of its blocks."""
    text = sum(len(b.text) - b.linked for b in page.blocks)
    own = doubt ** (1 + little / max(1, text))
    return [other_prose if other else own if doubted else 1.0 for doubted, other in zip(page.doubted, page.prose)]


def path_scores(page: Page, shifts: list[float], smoothing: int = 1) -> dict[int, float]:
    """Each path's fused ratio: geometric mean of its smoothed text and punctuation ratios, by its unlinked share, shifted as most of its blocks are."""
    length, signs, nodes, all_ = defaultdict(float), defaultdict(float), defaultdict(int), defaultdict(int)
    shift: dict[int, list[float]] = defaultdict(list)
    for b in page.blocks:
        own = max(0, len(b.text) - b.linked) / len(b.text)
        all_[b.path] += len(b.text)
        length[b.path] += len(b.text) * own
        signs[b.path] += len(_SIGNS.findall(b.text)) * own
        nodes[b.path] += 1
        shift[b.path].append(shifts[b.parent])
    ratios = {p: (length[p] / n, signs[p] / n + 0.1) for p, n in nodes.items()}
    near: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for i, b in enumerate(page.blocks):
        for other in page.blocks[max(0, i - smoothing) : i + smoothing + 1]:
            weight = 0.5 ** _apart(b.path, other.path, page)
            sums, (x, y) = near[b.path], ratios[other.path]
            sums[0] += weight
            sums[1] += weight * x
            sums[2] += weight * y
    # neither links nor doubtful parts gain from neighbours
    whole = sum(all_.values())
    return {p: (x / w * y / w * length[p] / whole) ** 0.5 * length[p] / all_[p] * sorted(shift[p])[(nodes[p] - 1) // 2] for p, (w, x, y) in near.items()}


def _holder(held: list[Block], page: Page) -> int:
    """The least element around all of ``held``: that of a lone text element's parent, or the article that it is in."""
    count = [0] * len(page.tags)
    for b in held:
        count[b.parent] += 1
    for e in range(len(count) - 1, 0, -1):
        count[page.above[e]] += count[e]
    # elements around all of them lie on one line, and the deepest has the highest number
    holder = max(e for e in range(len(count)) if count[e] == len(held))
    holder = page.article[holder] or holder
    while holder and page.tags[holder] in FLOW:
        holder = page.above[holder]
    return holder


def main_text(page: str | None, threshold: float = 0.25) -> str:
    """The article's text: blocks joined by a line feed."""
    read = read_page(page or "")
    blocks, tags, above = read.blocks, read.tags, read.above
    if not blocks:
        return ""
    shifts = doubts(read)
    scores = path_scores(read, shifts)
    weights = [(len(b.text) - b.linked + 1) * shifts[b.parent] for b in blocks]
    least = threshold * sum(w * scores[b.path] for w, b in zip(weights, blocks)) / sum(weights)
    chosen = [scores[b.path] >= least for b in blocks]
    open_ = [not good and not read.doubted[b.parent] and b.linked < 0.8 * len(b.text) for b, good in zip(blocks, chosen)]

    heading = [False] * len(tags)
    for e in range(1, len(tags)):
        heading[e] = heading[above[e]] or tags[e] in HEADINGS
    first, last = chosen.index(True), len(chosen) - chosen[::-1].index(True)
    held = [chosen[i] or (i < first and open_[i] and heading[b.parent]) for i, b in enumerate(blocks)]
    holder = _holder([b for i, b in enumerate(blocks) if held[i]], read)
    articles = {read.article[b.parent] for i, b in enumerate(blocks) if chosen[i]} - {0}
    around, e = {0}, holder
    while e:
        around.add(e)
        e = above[e]
    # a whole page or table is no article: of its parts, those count that hold content or stand between two that do
    whole = tags[holder] in ("", "html", "body", "table", "tbody", "tr")
    inside, beside = [holder == 0] + [False] * (len(tags) - 1), [True] + [False] * (len(tags) - 1)
    for e in range(1, len(tags)):
        inside[e] = e == holder or e in articles or inside[above[e]]
        beside[e] = e in around or (tags[e] in FLOW and beside[above[e]])
    part, holds = [0] * len(tags), [False] * len(tags)
    for e in range(1, len(tags)):
        part[e] = part[above[e]] if tags[e] in FLOW else e
    for i, b in enumerate(blocks):
        holds[part[b.parent]] |= held[i]

    def belongs(i: int, b: Block) -> bool:
        if beside[b.parent]:
            return True
        return inside[b.parent] and (not whole or read.article[b.parent] in articles or first < i < last or holds[part[b.parent]])

    return "\n".join(b.text for i, b in enumerate(blocks) if held[i] or (open_[i] and belongs(i, b)))


def extracted(column: str = "html", threshold: float = 0.25) -> Column:
    """The main text of a column of pages."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, threshold) for p in pages], dtype=object)

    return of(F.col(column))


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", extracted().alias("text"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
