"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: text between block-level tags, inline tags left out. Each block is read as a vector of
its tag path (element names with their classes, ids and roles, hashed), of its hashed words, and of a few sizes. A
bidirectional LSTM, in numpy, runs over the page's blocks and labels each with the whole page in view.

It is trained here, on pages that are made here: articles in many kinds of wrappers among menus, headers, footers,
sidebars, notices, adverts, forms and comments. The made pages and the first weights come from a fixed seed.

Defined results: null or empty html, or a page without a main block, has empty text; comments, scripts, styles and
what stands in the head are never text; a tag, comment,
script or the like that isn't closed ends with the page, and a drawing, object or choice that isn't is like other
elements; formulas are text; character
references that aren't known stay as they are; repeated rows are extracted alike; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.base import slices, table, texts

PATH_SIZE, WORD_SIZE, SIZES = 64, 24, 6
INPUT = PATH_SIZE + WORD_SIZE + SIZES
HIDDEN = 20
MADE_PAGES, EPOCHS, BATCH, RATE, SEED = 3600, 12, 30, 0.01, 11
#: Pages that are labelled together.
PAGES_AT_ONCE = 64
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mspace mstyle mpadded mphantom mfenced menclose semantics".split()
)
#: An opening tag of the first ends an open element of the second within the same container.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("article aside body div section main td th table ul ol dl nav header footer form blockquote figure html details fieldset".split())
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:svg|math|object)(?=[\s/>])[^>]*/>|<(?:(?P<mute>script|style|noscript|template|iframe|textarea|title)(?=[\s/>]|\Z)[^>]*(?:>.*?(?:</(?P=mute)\s*>|\Z)|\Z))|<(?P<drawn>svg|select|object|canvas|annotation|annotation-xml)(?=[\s>])[^>]*>.*?</(?P=drawn)\s*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*|[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


class Node:
    """A place in the tree of tag paths that pages share: an open element's labels below its parent's. So a path costs
    the same at any depth, and its vector is made once."""

    __slots__ = ("parent", "labels", "size", "below", "vector")

    def __init__(self, parent: Node | None, labels: tuple[str, ...]) -> None:
        self.parent, self.labels, self.size = parent, labels, len(labels) + (parent.size if parent else 0)
        self.below: dict[tuple[str, ...], Node] = {}
        self.vector: np.ndarray | None = None


class Paths:
    """Grows with the pages; starts afresh when it has many nodes."""

    MOST = 50_000

    def __init__(self) -> None:
        self.root, self.made = Node(None, ()), 0

    def child(self, node: Node, labels: tuple[str, ...]) -> Node:
        if (found := node.below.get(labels)) is None:
            found = node.below[labels] = Node(node, labels)
            self.made += 1
        return found

    def start(self) -> Node:
        if self.made > self.MOST:
            self.__init__()
        return self.root


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int) -> None:
        self.node, self.text, self.linked = node, text, linked

    @property
    def path(self) -> tuple[str, ...]:
        parts, node = [], self.node
        while node is not None:
            parts.append(node.labels)
            node = node.parent
        return tuple(x for labels in reversed(parts) for x in labels)


def _labels(name: str, rest: str) -> tuple[str, ...]:
    if "=" not in rest:
        return (name,)
    found = [p for kind, a, b, c in _NAMES.findall(rest) for p in _PART.findall((a or b or c).lower())]
    return (name, *("." + p for p in found))


def _is_closed(rest: str) -> bool:
    """Whether a tag closes itself; the slash may also end an attribute's value."""
    rest = rest.rstrip()
    return rest[-1:] == "/" and (len(rest) == 1 or rest[-2].isspace() or rest[-2] in "\"'")


def blocks(page: str, paths: Paths | None = None) -> list[Block]:
    """The page's leaf blocks in order, with white space turned into single spaces."""
    paths = paths or Paths()
    root = paths.start()
    out: list[Block] = []
    stack: list[tuple[str, Node]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0
    in_link = in_head = 0
    path: Node | None = None

    def add(text: str) -> None:
        nonlocal path, linked
        if not text or in_head:
            return
        if path is None and not text.isspace():
            path = stack[-1][1] if stack else root
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    def flush() -> None:
        nonlocal path, linked
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(path or root, text, linked))
            parts.clear()
        path, linked = None, 0

    def close(at: int) -> None:
        nonlocal in_link, in_head
        for name, _ in stack[at:]:
            opened[name] -= 1
            in_link -= name == "a"
            in_head -= name == "head"
        del stack[at:]

    at = 0
    for m in _TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if m["end"]:
            if not opened[name]:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if name == "body":
            close(next((k for k, x in enumerate(stack) if x[0] == "head"), len(stack)))
        if name not in INLINE:
            ends = ENDS.get(name, ("p",))
            for k in range(len(stack) - 1, -1, -1) if any(opened[e] for e in ends) else ():
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in CONTAINERS:
                    break
        if name not in VOID and not _is_closed(m["rest"] or ""):
            stack.append((name, paths.child(stack[-1][1] if stack else root, _labels(name, m["rest"] or ""))))
            opened[name] += 1
            in_link += name == "a"
            in_head += name == "head"
    add(page[at:])
    flush()
    return out


class Features:
    """Vectors of blocks; paths, labels and words are hashed once in each worker."""

    def __init__(self) -> None:
        self.paths = Paths()
        self.labels: dict[str, tuple[int, int, int, int]] = {}
        self.words: dict[str, int] = {}

    def label(self, x: str) -> tuple[int, int, int, int]:
        if (found := self.labels.get(x)) is None:
            if len(self.labels) > 200_000:
                self.labels.clear()
            a, b = zlib.crc32(x.encode()), zlib.crc32(b"2" + x.encode())
            found = self.labels[x] = (a % PATH_SIZE, 1 if a >> 16 & 1 else -1, b % PATH_SIZE, 1 if b >> 16 & 1 else -1)
        return found

    def path(self, node: Node) -> np.ndarray:
        """The sum of the labels' vectors from the root on."""
        todo = []
        while node.vector is None:
            todo.append(node)
            if node.parent is None:
                break
            node = node.parent
        for n in reversed(todo):
            v = np.zeros(PATH_SIZE, np.float32) if n.parent is None else n.parent.vector.copy()
            for x in n.labels:
                a, s, b, t = self.label(x)
                v[a] += s
                v[b] += t
            n.vector = v
        return todo[0].vector if todo else node.vector

    def word_vector(self, words: list[str]) -> np.ndarray:
        known = self.words
        try:
            at = [known[w] for w in words]
        except KeyError:
            if len(known) > 200_000:
                known.clear()
            for w in words:
                known.setdefault(w, zlib.crc32(w.lower().encode()) % WORD_SIZE)
            at = [known[w] for w in words]
        return np.bincount(at, minlength=WORD_SIZE)[:WORD_SIZE] / max(1, len(at)) ** 0.5

    def of(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), INPUT), np.float32)
        for i, b in enumerate(page):
            words = b.text.split(" ")
            out[i, :PATH_SIZE] = self.path(b.node)
            out[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = self.word_vector(words)
            size = np.log1p(len(words))
            out[i, PATH_SIZE + WORD_SIZE :] = (size / 3, min(1, b.linked / len(b.text)), b.text[-1] in ".!?…", i == 0, i + 1 == len(page), min(b.node.size, 60) / 10)
        np.clip(out[:, :PATH_SIZE], -2, 2, out=out[:, :PATH_SIZE])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one in each direction, and a logistic layer over both."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        wide = lambda a, b: (rng.standard_normal((a, b)) / a**0.5).astype(np.float32)
        self.p = {"wf": wide(INPUT + HIDDEN, 4 * HIDDEN), "bf": np.zeros(4 * HIDDEN, np.float32), "wb": wide(INPUT + HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN, np.float32), "wo": wide(2 * HIDDEN, 1), "bo": np.zeros(1, np.float32)}
        self.p["bf"][HIDDEN : 2 * HIDDEN] = self.p["bb"][HIDDEN : 2 * HIDDEN] = 1

    def _run(self, x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, keep: list | None) -> np.ndarray:
        """x: (time, page, input). Masked steps leave the state as it is."""
        steps, n, _ = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        given = x.reshape(steps * n, -1) @ w[:INPUT]
        given = given.reshape(steps, n, -1) + b
        for t in range(steps):
            z = given[t] + h @ w[INPUT:]
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c1 = f * c + i * u
            th = np.tanh(c1)
            if keep is not None:
                keep.append((h, c, i, f, o, u, th, m))
            h = np.where(m, o * th, h)
            c = np.where(m, c1, c)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        a = self._run(x, mask, self.p["wf"], self.p["bf"], keep and keep[0])
        b = self._run(x[::-1], mask[::-1], self.p["wb"], self.p["bb"], keep and keep[1])[::-1]
        both = np.concatenate([a, b], 2)
        return _sigmoid(both @ self.p["wo"] + self.p["bo"])[:, :, 0], both

    def _back(self, x: np.ndarray, kept: list, grad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dw, db = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
        dh = np.zeros_like(grad[0])
        dc = np.zeros_like(grad[0])
        for t in range(len(kept) - 1, -1, -1):
            h, c, i, f, o, u, th, m = kept[t]
            dh = dh + grad[t]
            do, dc1 = dh * th, dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc1 * u * i * (1 - i), dc1 * c * f * (1 - f), do * o * (1 - o), dc1 * i * (1 - u * u)], 1) * m
            dw[:INPUT] += x[t].T @ dz
            dw[INPUT:] += h.T @ dz
            db += dz.sum(0)
            dh = np.where(m, dz @ w[INPUT:].T, dh)
            dc = np.where(m, dc1 * f, dc)
        return dw, db

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the unmasked blocks, and its gradients."""
        keep: tuple[list, list] = ([], [])
        s, both = self.scores(x, mask, keep)
        n = mask.sum()
        d = ((s - y) * mask / n).astype(np.float32)
        s = np.clip(s, 1e-7, 1 - 1e-7)
        loss = float(-((y * np.log(s) + (1 - y) * np.log(1 - s)) * mask).sum() / n)
        g = {"wo": np.einsum("tnh,tn->h", both, d)[:, None], "bo": np.array([d.sum()], np.float32)}
        dboth = d[:, :, None] * self.p["wo"][:, 0]
        g["wf"], g["bf"] = self._back(x, keep[0], dboth[:, :, :HIDDEN], self.p["wf"])
        g["wb"], g["bb"] = self._back(x[::-1], keep[1], dboth[::-1, :, HIDDEN:], self.p["wb"])
        return loss, g

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        for a in range(0, len(order), PAGES_AT_ONCE):
            part = [k for k in order[a : a + PAGES_AT_ONCE] if len(pages[k])]
            if part:
                x, mask = padded([pages[k] for k in part])
                s, _ = self.scores(x, mask)
                for col, k in enumerate(part):
                    out[k] = s[: len(pages[k]), col] > 0.5
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), INPUT), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


class Maker:
    """Pages with labelled blocks. Each text starts with a mark, M for main and B for the rest, that is taken off again."""

    WRAPPERS = ("article", "main", "section", 'div class="content"', 'div class="post"', 'div id="article"', 'div class="entry-content"', 'div class="story text"', 'div role="main"', 'div class="article-body"', "div", "body")
    MENUS = ("nav", "nav", 'div class="menu"', 'ul class="navigation"', 'div id="nav"', 'div class="breadcrumb"', 'div role="navigation"', 'div class="topbar links"')
    HEADERS = ("header", 'div id="header"', 'div class="masthead"', 'div class="site-header"')
    FOOTERS = ("footer", "footer", 'div id="footer"', 'div class="footer"', 'div class="copyright legal"')
    ADS = ('div class="ad"', 'div class="ad"', 'div class="ads"', 'div class="advert"', 'aside class="promo"', 'div id="banner"', 'div class="sponsored"', 'section class="advertisement"')
    NOTICES = ('div class="cookie"', 'div class="cookie-banner"', 'div class="notice"', 'div id="consent"', 'div class="alert"', 'div role="dialog"', 'div class="newsletter popup"', 'div role="alert"')
    SIDES = ("aside", "aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'aside class="widget"', 'div class="share social"', 'section class="related-posts"', 'div role="complementary"')
    COMMENTS = ('section class="responses"', 'div class="reactions"', 'section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="comments"', 'div class="reader-comments"', 'section id="discussion" class="replies"')

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        #: Whether the page's elements and class names don't tell what they hold.
        self.vague = False
        #: Whether its main text has long lists.
        self.listed = False
        self.syllables = ["".join(self.r.choices("bcdfghklmnprstvwz", k=self.r.choice((0, 1, 2)))) + self.r.choice("aeiouéäñ") + self.r.choice(("", "n", "r", "s", "t")) for _ in range(120)]

    def words(self, n: int) -> str:
        out = ["".join(self.r.choices(self.syllables, k=self.r.choice((1, 1, 2, 3)))) for _ in range(n)]
        for i in range(0, n, self.r.randint(4, 14)):
            out[i] = out[i].capitalize()
            out[i - 1] += "." if i else ""
        return " ".join(out) + self.r.choice((".", ".", ".", ""))

    #: Class names of a page's own that may stand for anything; most tell nothing.
    PLAIN = ("hd", "bd", "ft", "links", "single", "recent", "bottom", "top", "left", "right", "box", "row", "col", "inner", "outer", "block", "section", "item", "x", "wrap", "c")

    def within(self, tag: str, inside: str) -> str:
        if self.vague and tag != "body" and not tag.startswith(("form", "ul", "ol")):
            tag = f'div class="{self.r.choice(self.PLAIN)}{self.r.choice(("", "", str(self.r.randint(1, 9))))}"' if self.r.random() < 0.8 else "div"
        return f"<{tag}>{inside}" + ("" if self.r.random() < 0.03 else f"</{tag.split()[0]}>")

    def text(self, mark: str, low: int, high: int) -> str:
        return mark + " " + self.words(self.r.randint(low, high))

    def items(self, mark: str, link: float) -> str:
        made = [self.text(mark, 1, 4) for _ in range(self.r.randint(2, 8))]
        made = [f'<a href="/{k}">{x}</a>' if self.r.random() < link else x for k, x in enumerate(made)]
        kind = self.r.choice(("ul", "ul", "ol", "", "line"))
        if kind == "line":  # one block
            return mark + " " + self.r.choice((" ", " | ", " · ")).join(x.replace(mark + " ", "") for x in made)
        return f"<{kind}>" + "".join(f"<li>{x}</li>" for x in made) + f"</{kind}>" if kind else "".join(f"<div>{x}</div>" for x in made)

    def rest(self, kinds: tuple[str, ...], prose: float = 0.5, name: str = "") -> str:
        tag = self.r.choice(kinds)
        if tag.startswith(("ul", "ol")):
            return self.within(tag, "".join(f"<li>{self.text('B', 1, 30)}</li>" for _ in range(self.r.randint(1, 5))))
        if kinds == self.HEADERS and self.r.random() < 0.4:
            inner = "<{0}>{1}</{0}>".format(self.r.choice(("h1", "h1", "h2", "p")), self.text("B", 1, 5)) + (self.items("B", 0.9) if self.r.random() < 0.3 else "")
        elif self.r.random() < prose:
            inner = "".join(self.r.choice(("<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>", "{}")).format(self.text("B", 2, 40)) for _ in range(self.r.choice((1, 1, 2, 4))))
        else:
            inner = self.items("B", 0.8)
        return self.within(tag, inner)

    def form(self) -> str:
        return self.within(self.r.choice(("form", 'form class="search"', 'form id="subscribe"')), "".join(f"<label>{self.text('B', 1, 4)}</label><input name=q>" for _ in range(self.r.randint(1, 3))) + f"<p>{self.text('B', 1, 12)}</p><button>{self.text('B', 1, 2)}</button>")

    def main(self) -> str:
        out = [f"<{h}>{self.text('M', 2, 12)}</{h}>" for h in (self.r.choice(("h1", "h1", "h2")),) if self.r.random() < 0.85]
        for _ in range(self.r.choice((1, 1, 2, 3, 5, 8, 12, 20, 40))):
            kind = self.r.random()
            t = self.text("M", 1, self.r.choice((4, 20, 60, 120)))
            if self.listed and kind < 0.3:
                out.append("<{0}>{1}</{0}>".format(self.r.choice(("ul", "ol", "dl")), "".join(f"<li>{self.text('M', 1, self.r.choice((3, 10, 30)))}</li>" for _ in range(self.r.randint(4, 20)))))
                continue
            out.append(
                f"<p>{t}</p>" if kind < 0.68 else f"<p><b>{t}<br>" if kind < 0.76 else f"<h2>{t}</h2>" if kind < 0.82 else self.items("M", 0.1) if kind < 0.86 else f"<blockquote><p>{t}</p></blockquote>" if kind < 0.9
                else f"<div>{t}</div>" if kind < 0.93 else f"<pre>{t}</pre>" if kind < 0.95 else f"<table><tr><td>{t}</td><td>{self.text('M', 1, 6)}</td></tr></table>" if kind < 0.97 else f"<figure><img src=x><figcaption>{t}</figcaption></figure>"
            )
            if self.r.random() < 0.02:
                out.append(self.r.choice((lambda: self.rest(self.ADS), lambda: self.rest(self.SIDES), self.form, lambda: self.rest(self.NOTICES)))())
        return "".join(out)

    def posts(self) -> str:
        """Titles and texts in elements whose names tell nothing, such as a forum's."""
        title, body = (f'div class="{self.r.choice(("t", "b", "m", "q", "msg", "txt", *self.PLAIN))}"' for _ in range(2))
        return "".join(self.within(title, self.text("M", 1, 8)) + self.within(body, self.text("M", 8, 80)) for _ in range(self.r.randint(1, 8)))

    def page(self) -> tuple[list[Block], np.ndarray]:
        r = self.r
        self.vague = r.random() < 0.35
        self.listed = r.random() < 0.15
        before = [f for p, f in ((0.4, lambda: self.rest(self.HEADERS)), (0.75, lambda: self.rest(self.MENUS, 0.1)), (0.25, lambda: self.rest(self.NOTICES, 0.9)), (0.5, lambda: self.rest(self.ADS, 0.8)), (0.1, self.form), (0.2, lambda: self.rest(self.SIDES))) if r.random() < p]
        after = [f for p, f in ((0.35, lambda: self.rest(self.SIDES)), (0.25, lambda: self.rest(self.COMMENTS, 0.9)), (0.2, lambda: self.rest(self.ADS, 0.8)), (0.15, self.form), (0.1, lambda: self.rest(self.NOTICES, 0.9)), (0.1, lambda: self.rest(self.MENUS, 0.1))) if r.random() < p]
        r.shuffle(before)
        r.shuffle(after)
        tag = r.choice((*self.WRAPPERS, "article", "article"))
        main = self.posts() if r.random() < 0.07 else self.main()
        bare = r.random() < 0.1  # nothing but the text
        if bare:
            before, after, tag = before[: r.random() < 0.2], [], r.choice(("body", "body", tag))
            main = main if r.random() < 0.6 else f"<p>{self.text('M', 3, 60)}</p>"
        if not bare and r.random() < 0.06:
            main += self.rest(self.COMMENTS, 0.9)
        inside = main if tag == "body" else self.within(tag, main)
        if r.random() < 0.25:
            inside = self.within(r.choice(("div", "main", 'div class="container"', 'div id="page"', 'div class="wrapper"')), inside)
        foot = self.rest(self.FOOTERS, 0.8) if r.random() < (0.15 if bare else 0.85) else ""
        body = "".join(f() for f in before) + inside + "".join(f() for f in after) + foot
        found = blocks(f"<!DOCTYPE html><html><head><title>B {self.words(4)}</title></head><body>{body}")
        marks = np.array([b.text[:1] == "M" for b in found], bool)
        for b in found:
            b.text = b.text[2:] if len(b.text) > 2 else "."
            if b.node.labels[-1:] == ("footer",) and self.r.random() < 0.6:
                b.text = "© " + b.text
        return found, marks


def train(pages: int = MADE_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    maker, features, net = Maker(seed), Features(), Labeller(seed)
    data = sorted(((features.of(b), m) for b, m in (maker.page() for _ in range(pages)) if b), key=lambda x: len(x[1]))
    batches = [data[a : a + BATCH] for a in range(0, len(data), BATCH)]
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            x, mask = padded([f for f, _ in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for col, (_, m) in enumerate(batches[k]):
                y[: len(m), col] = m
            _, g = net.gradients(x, mask, y)
            step += 1
            rate = RATE * (1 if epoch < epochs - 2 else 0.25)
            for name, v in g.items():
                v = np.clip(v, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.99 * second[name] + 0.01 * v * v
                net.p[name] = (net.p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


@cache
def trained() -> Labeller:
    """The labeller of the made pages, once for a process."""
    return train()


def extract(pages: DataFrame, net: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches, "html", 4 << 20):
            found = [blocks(x, features.paths) for x in texts(batch, "html")]
            labels = net.label([features.of(x) for x in found])
            out = ["\n".join(b.text for b, keep in zip(page, label.tolist(), strict=True) if keep) for page, label in zip(found, labels, strict=True)]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(main_text, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), trained())
