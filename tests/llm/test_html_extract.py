"""Main text of pages of several makes."""

import os
import re
import time
from html.parser import HTMLParser

import pytest

from claimloom.llm import html_extract
from claimloom.llm.html_extract import extracted, main_text

LONG = "A first sentence, with a comma. A second one follows; it is longer, too."
PAGES = [
    ("", ""),
    (None, ""),
    ("<p>", ""),
    ("just text, no markup.", "just text, no markup."),
    (f"<html><head><title>No</title></head><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p><b>{LONG}<br><p>End.</article><footer>&copy; us</footer>", f"Title & more\n{LONG}\nEnd."),
    (f"<body><div id='menu'><ul><li><a>One</a><li><a>Two</a></ul></div><div class=content><p>{LONG}</p>\n<p>Two\n  words.&nbsp; x</p></div><div class='comments'><p>{LONG}</p></div><p class='cookie-notice'>We use cookies, yes.</p></body>", f"{LONG}\nTwo words. x"),
    (f"<body><header>Top</header><main><p>{LONG}</p><aside>{LONG}</aside><form><p>Name, please.</p></form><script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p>Last one.</main></body>", f"{LONG}\nLast one."),
    (f"<article><p title='a > b'>{LONG}</p><div class=\"ad\">Buy, now.</div><ul><li>One<li>Two</ul></article>", f"{LONG}\nOne\nTwo"),
    (f"<article><header class='post-header'><h1>T</h1></header><div class='article-body has-ads'><p>{LONG}</p></div><section class='post-comments'><p>{LONG}</p></section></article>", f"T\n{LONG}"),
    (f"<article><p>{LONG}</p><script>never closed <p>x</p>", LONG),
    (f"<article><p>{LONG}</p><!-- never closed <p>x</p>", LONG),
    ("<article><p>1 &lt; 2 &#233; &eacute; &bogus; a &amp;lt; b</p></article>", "1 < 2 é é &bogus; a &lt; b"),
    (f"<div><div><p>{LONG}</p><p>{LONG}</p></div><div><a href=1>One link</a> <a href=2>Two link</a></div></div>", f"{LONG}\n{LONG}"),
]


#: Wrappers of whole pages whose names or attributes look like noise, and noise beside or in them.
REST = f"<div class='sidebar'><p>{LONG}</p></div>"
WRAPPED = [
    (f"<body style='overflow:hidden'><div style=\"overflow:hidden\"><p>{LONG}</p></div></body>", LONG),
    (f"<body><main title='the hidden side'><p data-id=\"ad-1\">{LONG}</p></main></body>", LONG),
    (f"<body><div data-note='x class=ad'><p>{LONG}</p></div><div hidden><p>{LONG}</p></div></body>", LONG),
    (f"<body><div class='layout has-sidebar'><p>{LONG}</p>{REST}</div></body>", LONG),
    (f"<body><div id=page class='sidebar-page'><article><h1>T</h1><p>{LONG}</p></article>{REST}{REST}</div>{REST * 4}</body>", f"T\n{LONG}"),
    (f"<body><form id=aspnetForm action=x><div class=content><p>{LONG}</p><p>{LONG}</p></div><form class=search><p>Find, here.</p></form></form></body>", f"{LONG}\n{LONG}"),
    (f"<body><div id=page class='with-nav' aria-hidden=true><main><p>{LONG}</p></main></div></body>", LONG),
    (f"<body><div class=post><h1>T</h1><p>{LONG}</p></div><div class=comments>{f'<p>{LONG}</p>' * 3}</div></body>", f"T\n{LONG}"),
    (f"<body><article><p>{LONG}</p></article><div class=related><article><p>{LONG}</p></article></div></body>", LONG),
]


@pytest.mark.parametrize("page,text", WRAPPED)
def test_wrappers(page, text):
    assert main_text(page) == text


#: Pages without article or main whose title, lead or end stand outside the element of the long text.
BODY = f"<div class=post-content>{f'<p>{LONG}</p>' * 12}</div>"
TEXT = "\n".join([LONG] * 12)
OUTSIDE = [
    ("<p><a href=x>Only a link.</a></p>", "Only a link."),
    (f"<div class=post><h1>Title</h1><p>Lead.</p>{BODY}<p>Short end.</p></div>", f"Title\nLead.\n{TEXT}\nShort end."),
    (f"<body><div class=top><a href=/>Home</a></div><div class=post><p>Lead.</p>{BODY}<p>Short end.</p></div><div>Small print</div></body>", f"Lead.\n{TEXT}\nShort end."),
    (f"<body><h2>Title</h2>{BODY}<ul><li>Last</ul><div class=footer>{LONG}</div></body>", f"Title\n{TEXT}\nLast"),
    (f"<h1>T</h1><p>A.</p><p>{LONG}</p><h2>U</h2><p>B</p><p>{LONG}</p><p>C</p>", f"T\nA.\n{LONG}\nU\nB\n{LONG}\nC"),
    (f"<body><div><h1>T</h1></div><div><div><p>{LONG}</p></div><div><p>Short.</p></div><div><p>{LONG}</p></div></div></body>", f"T\n{LONG}\nShort.\n{LONG}"),
]


@pytest.mark.parametrize("page,text", OUTSIDE)
def test_parts_outside(page, text):
    assert main_text(page) == text


#: Pages on which the ratios alone decide: no name or tag says what is content.
MENU = "<ul>" + "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(8)) + "</ul>"
UNNAMED = [
    (f"<body><div>{MENU}</div><div><b>Buy now.</b></div><div><h1>Title</h1>{f'<p>{LONG}</p>' * 4}<p>Be.</p></div><div>All rights kept.</div></body>", "\n".join(["Title", *[LONG] * 4, "Be."])),
    (f"<article><h1>Title</h1><p>{LONG}</p>{MENU}<p>{LONG}</p><p>End.</p></article>", f"Title\n{LONG}\n{LONG}\nEnd."),
    (f"<body><table><tr><td>{MENU}<td><div><p>{LONG}</p><div><p>{LONG}</p></div></div><td><p>Stocks up</p></table></body>", f"{LONG}\n{LONG}"),
    (f"<body><section><div>{LONG}</div><div>{LONG}</div></section><section><p>x</p></section></body>", f"{LONG}\n{LONG}"),
    (f"<article><section id='side-effects'><h2>Side effects</h2><p>{LONG}</p></section><div id='related-work'><p>{LONG}</p></div><div id='comments'><p>{LONG}</p></div></article>", f"Side effects\n{LONG}\n{LONG}"),
    (f"<article><p data-id='comment-12'>{LONG}</p></article><div class=ad>{LONG}</div>", LONG),
]


#: A footer whose name is short, and a layout table with a menu that isn't linked.
UNNAMED += [
    (f"<body><div class=entry><h1>T</h1>{f'<p>{LONG}</p>' * 6}<div class=foot><p>Subscribe to our newsletter, it is free.</p></div></div></body>", "\n".join(["T", *[LONG] * 6])),
    (f"<body><table><tr><td>Home News Contact</td><td><h1>T</h1>{f'<p>{LONG}</p>' * 6}</td></tr></table></body>", "\n".join(["T", *[LONG] * 6])),
]


@pytest.mark.parametrize("page,text", UNNAMED)
def test_unnamed(page, text):
    assert main_text(page) == text


def flat(page, shifts, smoothing=1):
    """Scores that know nothing but what names and tags say."""
    return {b.path: shifts[b.parent] for b in page.blocks}


def test_scores_select(monkeypatch):
    """With equal scores every path is content: the text of most pages changes, and no name or tag stands in for the ratios."""
    pages = [(p, t) for p, t in [*PAGES, *WRAPPED, *OUTSIDE, *UNNAMED] if t and p.count("<") > 8]
    scores = html_extract.path_scores
    monkeypatch.setattr(html_extract, "path_scores", lambda *a, **k: dict.fromkeys(scores(*a, **k), 1.0))
    assert sum(main_text(p) != t for p, t in pages) > 0.6 * len(pages)


GIVEN = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def given():
    if not os.path.exists(GIVEN):
        pytest.skip("no given pages")
    import pyarrow.parquet as pq

    return pq.read_table(GIVEN, columns=["html"]).column("html").to_pylist()


def test_names_alone_do_not_select_on_given_pages(monkeypatch, given):
    """Flat scores that keep the doubt change most pages: menus, adverts or footers come in."""
    now = [main_text(p) for p in given]
    monkeypatch.setattr(html_extract, "path_scores", flat)
    assert sum(main_text(p) != t for p, t in zip(given, now)) > 0.6 * len(given)


class Plain(HTMLParser):
    """Blocks with whole paths, for pages as the given ones are: paragraphs may stay open, all else is closed."""

    def __init__(self):
        super().__init__()
        self.path, self.blocks, self.text, self.linked, self.skip = [], [], "", 0, 0

    def flush(self):
        text = " ".join(self.text.split())
        if text and not self.skip:
            self.blocks.append((text, tuple(x for x in self.path if x not in ("a", "b")), min(self.linked, len(text))))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attributes):
        if tag == "br":
            self.text += " "
        elif tag not in ("meta",):
            if tag not in ("a", "b"):
                self.flush()
                if "p" in self.path:
                    del self.path[self.path.index("p") :]
            name = dict(attributes).get("class")
            self.path.append(f"{tag}.{name}" if name else tag)
            self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.path) - 1, -1, -1) if self.path[i].split(".")[0] == tag), None)
        if at is not None:
            if any(x not in ("a", "b") for x in self.path[at:]):
                self.flush()
            self.skip -= tag in ("script", "style")
            del self.path[at:]

    def handle_data(self, data):
        self.text += data
        self.linked += len(data) if "a" in self.path else 0


def plain_text(page, threshold=0.25):
    """The blocks from the first to the last whose path's score is high enough, scored with whole paths, block by block."""
    reader = Plain()
    reader.feed(page)
    reader.flush()
    blocks = reader.blocks
    own = lambda path: [b for b in blocks if b[1] == path]
    free = lambda b: (len(b[0]) - b[2]) / len(b[0])
    noisy = lambda b: {"nav", "footer", "head", "div.ad"} & set(b[1])
    text, whole = sum(len(b[0]) - b[2] for b in blocks), sum(len(b[0]) for b in blocks)
    shift = lambda b: 0.5 ** (1 + 1200 / max(1, text)) if noisy(b) else 1.0
    ratio = lambda path: (sum(len(b[0]) * free(b) for b in own(path)) / len(own(path)), sum(len(re.findall(r"[.,;:!?\u2026](?=\s|$)|[\u3002\u3001\uff01\uff1f]", b[0])) * free(b) for b in own(path)) / len(own(path)) + 0.1)
    ratios = {b[1]: ratio(b[1]) for b in blocks}

    def apart(x, y):
        shared = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        return min(6, len(x) + len(y) - 2 * shared)

    scores = {}
    for path in ratios:
        w = x = y = 0.0
        for i, b in enumerate(blocks):
            if b[1] == path:
                for c in blocks[max(0, i - 1) : i + 2]:
                    weight = 0.5 ** apart(path, c[1])
                    w, x, y = w + weight, x + weight * ratios[c[1]][0], y + weight * ratios[c[1]][1]
        unlinked, length = sum(len(b[0]) * free(b) for b in own(path)), sum(len(b[0]) for b in own(path))
        scores[path] = (x / w * y / w * unlinked / whole) ** 0.5 * unlinked / length * shift(own(path)[0])
    weights = [(len(b[0]) - b[2] + 1) * shift(b) for b in blocks]
    least = threshold * sum(w * scores[b[1]] for w, b in zip(weights, blocks)) / sum(weights)
    chosen = [scores[b[1]] >= least for b in blocks]
    # on these pages the region is the article, or what of it is chosen and what stands between
    inside = [good or ("article" in b[1] and not noisy(b)) for good, b in zip(chosen, blocks)]
    return "\n".join(b[0] for b, good in zip(blocks, inside) if good)


def test_given_pages_equal_a_plain_version(given):
    assert [main_text(p) for p in given] == [plain_text(p) for p in given]


def test_names_are_one_feature_only(monkeypatch):
    monkeypatch.setattr(html_extract, "NOISE", frozenset())
    assert all(main_text(p) == t for p, t in UNNAMED[:4])


def test_deep_nesting_is_linear():
    def seconds(n):
        began = time.process_time()
        assert main_text("<div>".join(["Some text. "] * n)) and main_text("<b>a</i><p>x" * n) and main_text(f"<ul>{'<li>x<ul>' * n}")
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 12 * seconds(2_000) + 1


@pytest.mark.parametrize("page,text", PAGES)
def test_pages(page, text):
    assert main_text(page) == text


def test_very_long_page():
    assert main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>").count(LONG) == 20_000


def test_column(spark):
    df = spark.createDataFrame([(i, "u", p, "x") for i, (p, _) in enumerate([*PAGES, PAGES[4]])], "page_id long, url string, html string, text string")
    got = df.select("page_id", extracted().alias("out")).collect()
    assert [r["out"] for r in sorted(got, key=lambda r: r["page_id"])] == [t for _, t in [*PAGES, PAGES[4]]]
    assert df.limit(0).select(extracted()).count() == 0
