from html.parser import HTMLParser

import numpy as np
import pytest

from ledgerloom.llm import html


def text_of(page):
    return [b.text for b in html.blocks(page)]


def test_blocks():
    assert text_of("<p>a <b>b</b>\n c<br>d</p>x<div>&amp;&eacute;&#65; &am <!-- no --> e") == ["a b c d", "x", "&éA &am e"]
    assert text_of('<head><title>t</title><meta x></head><body><script>var t="</p>";</script><style>p{}</style><p>one<p>two') == ["one", "two"]
    assert text_of("<p>cut off <b") == ["cut off"] and text_of("<!-- never closed <p>x") == [] and text_of("") == [] and text_of("a < b") == ["a < b"]
    assert text_of('<p title="a>b">x</p><script>never closed') == ["x"] and text_of("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]
    paths = [b.path for b in html.blocks('<div class="ad x1"><a href=#>l</a></div><p><b>t<br><p>u')]
    assert paths == [("div", ".ad", ".x", "a"), ("p", "b"), ("p",)]


def test_gradients():
    net, rng = html.Labeller(1), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((5, 3, html.INPUT))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    y = rng.integers(0, 2, (5, 3)).astype(float)
    _, g = net.gradients(x, mask, y)
    for name, at in (("wf", (3, 7)), ("wf", (html.INPUT + 2, 30)), ("wb", (5, 50)), ("bf", (25,)), ("bb", (61,)), ("wo", (30, 0)), ("bo", (0,))):
        old, sides = net.p[name][at], []
        for step in (1e-3, -1e-3):
            net.p[name][at] = old + step
            sides.append(net.gradients(x, mask, y)[0])
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-3, rel=0.05, abs=1e-5), name


@pytest.fixture(scope="module")
def net():
    return html.trained()


def test_unseen_made_pages(net):
    maker, features = html.Maker(4242), html.Features()
    right, total = {False: 0, True: 0}, {False: 0, True: 0}
    for _ in range(300):
        blocks, marks = maker.page()
        if blocks:
            right[maker.vague] += (net.label([features.of(blocks)])[0] == marks).sum()
            total[maker.vague] += len(marks)
    # Vague pages have no element or name that tells what it holds.
    assert right[False] >= 0.985 * total[False] and right[True] >= 0.95 * total[True]


class Articles(HTMLParser):
    """Another reading of pages: the text blocks within <article>."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts, self.out = 0, [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.out += [text] if text and self.depth else []
        self.parts.clear()

    def handle_starttag(self, tag, attrs):
        if tag not in html.INLINE and tag != "br":
            self.flush()
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag not in html.INLINE:
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        self.parts.append(data)


def test_pages(spark, net):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html.extract(pages, net).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        other = Articles()
        other.feed(r["html"])
        other.close()
        assert [b.text for b in html.blocks(r["html"]) if "article" in b.path] == other.out
    wrong = sum(got[r["page_id"]]["text"] != "\n".join(b.text for b in html.blocks(r["html"]) if "article" in b.path) for r in pages.collect())
    assert wrong <= 2 and all(len(r["text"]) == r["n_chars"] for r in got.values())


def test_odd_rows(spark, net):
    long = "<article>" + "<p>Words of an article that is long.</p>" * 3000 + "</article>"
    rows = [(1, "u", None, 1), (2, None, "", 1), (3, "u", "no tags at all", 1), (4, "u", long, 1), (4, "u", long, 1), (None, "u", "<nav><a>Home</a></nav>", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(html.extract(frame, net).collect(), key=str)
    assert len(got) == 6 and [r["text"] for r in got if r["page_id"] in (1, 2, None)] == ["", "", ""]
    assert all(r["n_chars"] == len(r["text"]) > 90_000 for r in got if r["page_id"] == 4)
    assert html.extract(frame.limit(0), net).count() == 0


def test_closed_and_custom_elements_mute_nothing():
    from ledgerloom.llm import html

    for tag in ("<svg class='x'/>", "<math />", "<object data='a'/>", "<title-bar>", "<select-x>"):
        assert [b.text for b in html.blocks(f"<body><p>one</p>{tag}<p>two</p></body>")] == ["one", "two"], tag
    assert [b.text for b in html.blocks("<p>one</p><svg><path/>no</svg><title\n>no</title><p>two</p>")] == ["one", "two"]


SAYS = "says that the work went on through the winter, and the men who came each day did not stop until the river froze over."
PAGE = (
    '<html><body><div class="hd"><h1>My site</h1></div><div class="links"><a href=/a/>Home</a> <a href=/b/>About</a> <a href=/c/>Contact</a></div>{}'
    '<div class="recent"><ul><li><a href=/1>Old post</a></li><li><a href=/2>Older post</a></li><li><a href=/3>Oldest</a></li></ul></div>'
    '<div class="bottom">Copyright 2020 My site. All rights reserved.</div></body></html>'
)


@pytest.mark.parametrize("wrapper", ['<div class="single">{}</div>', '<article>{}</article><section class="responses"><div><p>Anna: great post, thank you!</p></div><div><p>Bob: I disagree with this.</p></div></section>'])
def test_pages_written_by_hand(net, wrapper):
    main = ["How we built the bridge", *(f"Paragraph {i} {SAYS}" for i in range(5))]
    found = html.blocks(PAGE.format(wrapper.format(f"<h2>{main[0]}</h2>" + "".join(f"<p>{p}</p>" for p in main[1:]))))
    labels = net.label([html.Features().of(found)])[0]
    assert [b.text for b, keep in zip(found, labels, strict=True) if keep] == main


def test_links_and_deep_pages():
    assert [b.linked for b in html.blocks("<p><a href=/x/>text</a> more<p><a name='q'/>rest")] == [4, 0]
    page = "<div>x" * 50_000
    found = html.blocks(page)
    assert len(found) == 50_000 and html.Features().of(found).shape == (50_000, html.INPUT) and len(found[-1].path) == 50_000


PROSE = "".join(f"<p>Paragraph {i} {SAYS}</p>" for i in range(5))
MENU = '<div class="links"><a href=/a/>Home</a> <a href=/b/>About</a> <a href=/c/>Contact</a></div>'
FOOT = "<footer>Copyright 2020 My site. All rights reserved.</footer>"
LIST = "<ul>" + "".join(f"<li>Point {i} of the list</li>" for i in range(12)) + "</ul>"
#: Pages that the maker doesn't make, and how their main text begins and how many blocks it has.
BY_HAND = {
    "one paragraph": ("<p>One paragraph that stands alone on its page</p>", "One paragraph", 1), "no wrapper": (f"<h1>How we built it</h1>{PROSE}", "How we", 6), "no wrapper among others": (f"{MENU}<h1>How we built it</h1>{PROSE}{FOOT}", "How we", 6),
    "list": (f"<nav><a href=/>Home</a></nav><article><h1>How we built</h1><p>{SAYS}</p>{LIST}<p>{SAYS}</p></article>{FOOT}", "How we", 15), "list alone": (f"<nav><a href=/>Home</a></nav><article><h1>How we built</h1>{LIST}</article>{FOOT}", "How we", 13),
    "forum": ("".join(f'<div class="t">Question {i}</div><div class="b">{SAYS}</div>' for i in range(4)), "Question 0", 8), "formula": (f"{MENU}<article><h1>Title</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be given</p>{PROSE}</article>{FOOT}", "Title\nLet x=2 be given\n", 7),
    "table layout": (f"<table><tr><td>{MENU}</td></tr><tr><td><h1>Title of it</h1>{PROSE}</td></tr></table>", "Title of it", 6), "canvas left open": (f"{MENU}<article><h1>Title of it</h1><canvas><p>{SAYS}</p>{PROSE}</article>{FOOT}", "Title of it", 7),
    "own elements": (f"{MENU}<my-article><h1>Title of it</h1>{PROSE}</my-article>{FOOT}", "Title of it", 6),
}


@pytest.mark.parametrize("name", BY_HAND)
def test_ordinary_pages(net, name):
    page, begin, n = BY_HAND[name]
    found = html.blocks(f"<html><head><title>Title</title></head><body>{page}</body></html>")
    main = [b.text for b, keep in zip(found, net.label([html.Features().of(found)])[0], strict=True) if keep]
    assert "\n".join(main).startswith(begin) and len(main) == n and not any("Home" in x or "Copyright" in x for x in main)


def test_open_elements_swallow_nothing():
    for tag in ("canvas", "object", "select", "svg", "math", "annotation"):
        assert text_of(f"<p>one</p><{tag}><p>two</p>") == ["one", "two"], tag
    assert text_of("<p>one</p><select><option>no</select><canvas>no</canvas><p>two") == ["one", "two"]
    assert text_of("<p>a <math><msup><mi>x</mi><mn>2</mn></msup><annotation>x^2</annotation></math> b") == ["a x2 b"]
