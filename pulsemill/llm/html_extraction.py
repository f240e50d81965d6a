"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags, with character references decoded
and white space folded. Features are the ancestors' tags, class words, ids and roles, and the shape of the text (length,
links, stops), never its words. The chain's two labels, kept and left out, are decoded by Viterbi; kept blocks are joined in
page order. Training maximises the likelihood of labelled pages by forward-backward and AdaGrad. Without pages labelled
by hand it learns from `labelled_pages`, a generator of layouts with known main text, of bounded size (`pages`).

Edge cases: null and empty html, and pages without kept blocks, give an empty text; unclosed and misplaced tags are
closed as browsers do for the common cases, so a head left open ends at the first tag or text of a body; scripts, styles,
templates and heads are never text; what a video, an object, a drawing or the like holds is left out if it is closed, and
read as text if its end is missing; formulas are text; any depth of nesting takes time in proportion; repeated rows each
get a row; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kinds of elements and closing rules of the HTML standard.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation annotation-xml".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template title annotation annotation-xml".split())
#: What these hold stands in for them. If they end, it is left out; if their end is missing, it may be the page's text.
FALLBACK = frozenset("noscript svg iframe object canvas audio video".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: A start tag of the key ends open elements of the value, up to the nearest list or table.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table select menu".split())
END_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
END_DRAWING = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
FEATURE_BITS = 16
TRAINING_PAGES, EPOCHS, SEED = 2000, 6, 7


class Node:
    """An element that isn't inline, with the one around it."""

    __slots__ = ("tag", "words", "up", "fresh", "numbers", "total")

    def __init__(self, tag: str, words: tuple[str, ...], up: Node | None, fresh: tuple[str, ...]):
        self.tag, self.words, self.up, self.fresh = tag, words, up, fresh  # fresh: the words that no element around has
        self.numbers: tuple[list[int], list[int]] | None = None
        self.total: tuple[float, float] | None = None


class Block(NamedTuple):
    text: str
    node: Node | None
    linked: int  # characters in links

    @property
    def tag(self) -> str:
        return self.node.tag if self.node else ""

    @property
    def path(self) -> tuple[tuple[str, ...], ...]:
        """Feature words of each ancestor, outermost first."""
        return tuple(x.words for x in reversed(list(_upwards(self.node))))


def _upwards(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.up


class _Open(NamedTuple):
    tag: str
    node: Node | None  # None for inline elements
    mark: int  # blocks before it


class _Blocks(HTMLParser):
    """Leaf blocks of a page, in time that grows with the page: what is open is found by tag, never by search."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[Block] = []
        self.stack: list[_Open] = []
        self.spots: dict[str, list[int]] = defaultdict(list)  # places of each open tag in the stack
        self.solid: list[int] = []  # of elements that aren't inline
        self.scopes: list[int] = []
        self.held: dict[str, int] = defaultdict(int)  # feature words of open elements
        self.parts: list[str] = []
        self.linked = self.unseen = 0
        self.at: Node | None = None
        self.begun = False

    def node(self) -> Node | None:
        return self.stack[self.solid[-1]].node if self.solid else None

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text and self.begun:
                self.out.append(Block(text, self.at, self.linked))
            self.parts.clear()
        self.linked, self.at, self.begun = 0, None, False

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, node, _ = self.stack.pop()
            self.spots[tag].pop()
            self.unseen -= tag in UNSEEN
            if node is not None:
                self.solid.pop()
                if tag in SCOPES:
                    self.scopes.pop()
                for word in node.words:
                    self.held[word] -= 1

    def opened(self, *tags: str) -> int:
        """The highest place of one of the tags, or -1."""
        return max((self.spots[t][-1] for t in tags if self.spots.get(t)), default=-1)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append("\n")
            return
        if self.spots.get("head") and tag not in IN_HEAD and not self.spots.get("template"):
            self.close_to(self.opened("head"))  # a head left open ends here
        drawing = self.opened("svg", "math")
        if drawing >= 0 and tag in END_DRAWING and self.opened("foreignobject", "annotation-xml", "mtext", "mi", "mo", "mn", "ms") < drawing:
            self.end(drawing)
        if tag not in INLINE and tag not in UNSEEN:
            self.flush()
            scope = self.scopes[-1] if self.scopes else -1
            hit = self.opened(*ENDS[tag]) if tag in ENDS else -1
            if hit > scope:
                self.close_to(hit)
            if tag in END_P and self.solid and self.stack[self.solid[-1]].tag == "p":
                self.close_to(self.solid[-1])
        if tag in VOID:
            return
        place = len(self.stack)
        node = None
        if tag not in INLINE:
            words = [f"tag:{tag}"]
            for name, value in attrs:
                if value and name in ("class", "id", "role"):
                    for word in value.lower().split():
                        words.append(f"{name}:{word}")
                        words += [f"part:{x}" for x in re.split(r"[-_]", word)]
            node = Node(tag, tuple(words), self.node(), tuple(x for x in dict.fromkeys(words) if not self.held[x]))
            for word in words:
                self.held[word] += 1
            self.solid.append(place)
            if tag in SCOPES:
                self.scopes.append(place)
        self.stack.append(_Open(tag, node, len(self.out)))
        self.spots[tag].append(place)
        self.unseen += tag in UNSEEN

    def end(self, place: int) -> None:
        """Close the element at a place of the stack by its own end tag, or as a drawing that text follows."""
        if self.stack[place].tag in FALLBACK:
            self.flush()
            del self.out[self.stack[place].mark :]
        self.close_to(place)

    def handle_endtag(self, tag):
        if tag not in INLINE and tag not in UNSEEN and tag != "br":
            self.flush()
        place = self.opened(tag)
        if place >= 0 and (tag not in INLINE or not self.solid or place > self.solid[-1]):
            self.end(place)

    def handle_startendtag(self, tag, attrs):
        drawn = self.opened("svg", "math") >= 0
        self.handle_starttag(tag, attrs)
        # in html the slash says nothing, but in drawings and formulas it does, and of what has no text nothing is lost
        if (drawn or tag in ("svg", "math") or tag in UNSEEN or tag in FALLBACK) and tag not in VOID and self.stack and self.stack[-1].tag == tag:
            self.close_to(len(self.stack) - 1)

    def handle_data(self, data):
        if self.stack and self.stack[-1].tag == "head" and not data.isspace():
            self.close_to(len(self.stack) - 1)
        if self.unseen:
            return
        self.parts.append(data)
        if not self.begun and not data.isspace():
            self.at, self.begun = self.node(), True
        if self.spots.get("a"):
            self.linked += len(data)


def blocks_of(html: str) -> list[Block]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.out


@lru_cache(maxsize=1 << 16)
def _number(feature: str) -> int:
    return crc32(feature.encode()) & ((1 << FEATURE_BITS) - 1)


def _around(node: Node) -> tuple[list[int], list[int]]:
    """Numbers of the features that an element gives to all blocks in it, and to those that it is the nearest of."""
    if node.numbers is None:
        near = [f"by {x}" for x in node.words]
        if node.up:
            near += [f"over {x}" for x in node.up.words]
            low = node
            for _ in range(3):
                if low.up is None:
                    break
                near.append(f"step {low.up.words[0]}>{low.words[0]}")
                low = low.up
        node.numbers = [_number(f"in {x}") for x in node.fresh], [_number(x) for x in near]
    return node.numbers


def _local(b: Block, k: int, n: int) -> list[int]:
    """Numbers of the features of a block's own text and place."""
    words = b.text.count(" ") + 1
    size = min(7, words.bit_length())
    links = min(4, 4 * b.linked // max(1, len(b.text)))
    stops = min(3, sum(b.text.count(x) for x in ".!?"))
    end = b.text[-1] in ".!?\"'”»"
    found = ["bias", f"tag={b.tag}", f"size={size}", f"links={links}", f"stops={stops}", f"end={end}", f"tag,size={b.tag},{size}", f"links,size={links},{size}"]
    if k == 0:
        found.append("first")
    if k == n - 1:
        found.append("last")
    low = b.text.lower()
    if "©" in low or "copyright" in low or "all rights" in low:
        found.append("copyright")
    if words < 8 and any(c.isdigit() for c in low):
        found.append("short with digits")
    return [_number(x) for x in found]


def features(blocks: list[Block]) -> list[np.ndarray]:
    """Numbers of all features of each block."""
    out = []
    for k, b in enumerate(blocks):
        found = _local(b, k, len(blocks))
        if b.node:
            found += _around(b.node)[1]
        for node in _upwards(b.node):
            found += _around(node)[0]
        out.append(np.array(found))
    return out


class Field(NamedTuple):
    state: np.ndarray  # (features, 2)
    step: np.ndarray  # (2, 2)

    def scores(self, x: list[np.ndarray]) -> np.ndarray:
        if not x:
            return np.zeros((0, 2))
        flat, starts = np.concatenate(x), np.cumsum([0, *map(len, x[:-1])])
        return np.add.reduceat(self.state[flat], starts)

    def of_blocks(self, blocks: list[Block]) -> np.ndarray:
        """The same scores straight from a page's blocks; what elements add is summed once for all blocks in them."""
        if not blocks:
            return np.zeros((0, 2))
        out = self.scores([np.array(_local(b, k, len(blocks))) for k, b in enumerate(blocks)])
        near: dict[int, np.ndarray] = {}
        for k, b in enumerate(blocks):
            if b.node is None:
                continue
            way = []
            for node in _upwards(b.node):
                if node.total is not None:
                    break
                way.append(node)
            for node in reversed(way):
                above = node.up.total if node.up else (0.0, 0.0)
                own = self.state[_around(node)[0]].sum(0) if node.fresh else (0.0, 0.0)
                node.total = (above[0] + own[0], above[1] + own[1])
            if id(b.node) not in near:
                near[id(b.node)] = self.state[_around(b.node)[1]].sum(0) + b.node.total
            out[k] += near[id(b.node)]
        return out

    def decode(self, x: list[np.ndarray]) -> list[int]:
        return self.best(self.scores(x))

    def best(self, scores: np.ndarray) -> list[int]:
        """Viterbi."""
        s = scores.tolist()
        if not s:
            return []
        (t00, t01), (t10, t11) = self.step.tolist()
        a, b = s[0]
        back = []
        for u, v in s[1:]:
            from0, from1 = b + t10 > a + t00, b + t11 > a + t01
            back.append((from0, from1))
            a, b = (b + t10 if from0 else a + t00) + u, (b + t11 if from1 else a + t01) + v
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(pages: Iterable[tuple[list[np.ndarray], list[int]]], epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-5) -> Field:
    """Conditional likelihood by forward-backward, AdaGrad on single pages."""
    pages = [p for p in pages if p[0]]
    field = Field(np.zeros((1 << FEATURE_BITS, 2)), np.zeros((2, 2)))
    sq_state, sq_step = np.full_like(field.state, 1e-8), np.full((2, 2), 1e-8)
    order = random.Random(SEED)
    for _ in range(epochs):
        order.shuffle(pages)
        for x, y in pages:
            s, n = field.scores(x), len(x)
            fore, back = np.empty((n, 2)), np.zeros((n, 2))
            fore[0] = s[0]
            for k in range(1, n):
                fore[k] = s[k] + np.logaddexp(fore[k - 1, 0] + field.step[0], fore[k - 1, 1] + field.step[1])
            for k in range(n - 2, -1, -1):
                ahead = field.step + (s[k + 1] + back[k + 1])
                back[k] = np.logaddexp(ahead[:, 0], ahead[:, 1])
            total = np.logaddexp(*fore[-1])
            node = np.exp(fore + back - total)
            node[np.arange(n), y] -= 1
            flat, row = np.concatenate(x), np.repeat(np.arange(n), [len(v) for v in x])
            g = node[row] + decay * field.state[flat]
            np.add.at(sq_state, flat, g * g)
            np.subtract.at(field.state, flat, rate * g / np.sqrt(sq_state[flat]))
            if n > 1:
                edge = np.exp(fore[:-1, :, None] + field.step + (s[1:] + back[1:])[:, None, :] - total).sum(0)
                np.subtract.at(edge, (np.array(y[:-1]), np.array(y[1:])), 1)
                sq_step += edge * edge
                field.step[:] -= rate * edge / np.sqrt(sq_step)
    return field


# ---- labelled pages


def labelled_pages(pages: int = TRAINING_PAGES, seed: int = SEED) -> Iterator[tuple[str, list[str]]]:
    """(html, texts of the main blocks) of generated layouts."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ten", "ra", "sul", "vor", "ne", "pi", "dra", "gos", "ul"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    phrase = lambda n: " ".join(word() for _ in range(n))
    sentence = lambda: (phrase(rng.randint(1, 22)).capitalize() + rng.choice(["."] * 6 + ["!", "?", ""]))
    prose = lambda most=12: " ".join(sentence() for _ in range(rng.randint(1, most)))
    pick = rng.choice
    link = lambda: f'<a href="/{word()}">{phrase(rng.randint(1, 3))}</a>'
    utility = ["flex", "flex-col", "p-4", "m-2", "w-full", "bg-x", "text-y", "rounded", "grid", "mx-auto", "items-center", "gap-3", "h-8", "shadow", "relative", "block", "font-bold", "md:w-64", "border", "leading-6"]

    def styled(words):
        """Many class words, the telling one anywhere."""
        many = rng.sample(utility, rng.randint(6, 14))
        if words:
            many.insert(pick([rng.randint(0, len(many)), len(many)]), pick(words))
        return f' class="{" ".join(many)}"'

    attr = lambda words: styled(words) if rng.random() < 0.15 else pick([f' class="{pick(words)}"', f' id="{pick(words)}"', f' class="{word()} {pick(words)}"', f' class="{pick(words)}-{pick(["box", "wrap", "area", "list", "1", "links", "bar", "section"])}"'])

    def boxed(tags, names, inner):
        tag = pick(tags)
        if tag == "p":  # holds no blocks
            inner = re.sub(r"</?(p|div|h\d|li|ul|ol)\b[^>]*>", " ", inner)
        return f"<{tag}{attr(names)}>{inner}</{tag}>"

    def links(low=3, high=9):
        items = "".join(f"<li>{link()}{pick(['', '</li>', '</li>'])}" for _ in range(rng.randint(low, high)))
        return pick([f"<ul>{items}</ul>", f"<ol>{items}</ol>", pick([" | ", "<br>", " "]).join(link() for _ in range(rng.randint(low, high)))])

    def listed(names):
        return f"<{pick(['ul', 'ol'])}{attr(names)}>{''.join(f'<li>{link()}</li>' for _ in range(rng.randint(2, 7)))}</ul>"

    def titled():
        level = rng.randint(2, 4)
        return f"<h{level}>{phrase(rng.randint(1, 3))}</h{level}>{links()}"

    def crumbs():
        return f"<div{attr(['breadcrumb', 'breadcrumbs', 'crumbs', 'path'])}>{pick([' » ', ' / ', ' > ', ' ']).join(link() for _ in range(rng.randint(2, 4)))}</div>"

    def share():
        return f"<div{attr(['share', 'social', 'sharing', 'social-share', 'buttons', 'tools', 'tags'])}>{pick(['', phrase(1) + ': '])}{pick([' ', ', ', ' | ']).join(link() for _ in range(rng.randint(1, 5)))}</div>"

    def contents():
        return f"<div{attr(['toc', 'contents', 'table-of-contents'])}>{titled()}</div>"

    def seealso():
        tag = pick(["section", "div", "aside"])
        return f"<{tag}{attr(['related', 'related-links', 'more', 'see-also', 'recommended', 'more-links'])}>{titled()}</{tag}>"

    def hint():
        tag = pick(["div", "p"])
        return f"<{tag}{attr(['notice', 'hint', 'noprint', 'skip', 'note-box', 'alert'])}>{pick([phrase(rng.randint(2, 7)), sentence()])}</{tag}>"

    def menu():
        return pick([lambda: f"<nav>{links()}</nav>", lambda: listed(["menu", "nav", "breadcrumb", "breadcrumbs", "pagination", "toc", "navigation"]), lambda: f"<nav{attr(['main', 'site', 'top'])}>{links()}</nav>", lambda: f"<div{attr(['menu', 'nav', 'navbar', 'topnav', 'breadcrumb', 'breadcrumbs', 'navigation', 'pagination'])}>{links()}</div>", lambda: f"<div>{links(5, 12)}</div>", lambda: f'<div role="navigation">{links()}</div>', lambda: pick([f"<nav>{titled()}</nav>", f'<div role="navigation">{titled()}</div>'])])()

    def head():
        inner = pick([f"<h1>{phrase(2)}</h1>", f"<div>{phrase(3)}</div>", f"<p>{sentence()}</p>", f"<h2>{link()}</h2>"]) + pick(["", menu()])
        return pick([f"<header>{inner}</header>", f"<div{attr(['header', 'masthead', 'banner', 'top', 'site-header', 'logo'])}>{inner}</div>", f'<div role="banner">{inner}</div>'])

    def foot():
        inner = pick([f"&copy; {word()}.example {pick(['', '&middot; '])}{sentence()}", f"<p>&copy; {rng.randint(1990, 2030)} {phrase(3)}</p>", f"<p>{prose(3)}</p>{links(2, 5)}", f"copyright {phrase(2)}. {sentence()}", f"<p>{' '.join(sentence() for _ in range(rng.randint(6, 12)))} {pick(['&copy;', 'Copyright', 'All rights reserved'])} {phrase(3)}.</p>", sentence(), prose(3)])
        return pick([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{attr(['footer', 'copyright', 'bottom', 'site-footer', 'legal', 'colophon'])}>{inner}</div>", f'<div role="contentinfo">{inner}</div>', f"<address>{inner}</address>"])

    def side():
        inner = pick([f"<h3>{phrase(2)}</h3>{links()}", f"<p>{prose(3)}</p>", f"<h4>{phrase(2)}</h4><p>{sentence()}</p>{links(2, 5)}", f"<div>{sentence()}</div>"])
        if rng.random() < 0.2:
            return listed(["tags", "related", "share", "social", "popular", "links"])
        return pick([f"<aside>{inner}</aside>", f"<section{attr(['related', 'sidebar', 'recommended', 'more'])}>{inner}</section>", f"<div{attr(['sidebar', 'side', 'related', 'widget', 'popular', 'recommended', 'share', 'social', 'tags', 'promo', 'toc'])}>{inner}</div>", f'<div role="complementary">{inner}</div>'])

    def notice():
        inner = pick([f"<p>{prose(3)}</p>", prose(2), f"<p>{sentence()}</p><button>{phrase(1)}</button>"])
        if rng.random() < 0.15:
            return pick([f"<dialog>{inner}</dialog>", f'<div role="alert">{inner}</div>', f'<div role="dialog">{inner}</div>'])
        return boxed(["div", "section", "aside", "p"], ["cookie", "cookies", "notice", "consent", "gdpr", "popup", "modal", "alert", "overlay", "banner", "privacy", "paywall", "warning", "message"], inner)

    def advert():
        inner = pick([prose(3), f"<p>{prose(3)}</p>", f"<a href='/x'>{prose(2)}</a>", sentence()])
        return boxed(["div", "div", "aside", "section", "p", "figure"], ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "adsbox", "banner"], inner)

    def form():
        inner = pick([f"<label>{phrase(2)}</label><input><button>{phrase(1)}</button>", f"<p>{sentence()}</p><input type=text><select><option>{word()}<option>{word()}</select>", f"{phrase(3)} <input> <textarea>{phrase(2)}</textarea>"])
        return pick([f"<form>{inner}</form>", f"<div{attr(['search', 'newsletter', 'subscribe', 'login', 'signup', 'form'])}><form>{inner}</form></div>"])

    def remarks():
        one = lambda: pick([f'<div class="comment"><b>{word()}</b> {prose(4)}</div>', f"<li><p>{prose(4)}</p></li>", f'<div class="comment"><p>{prose(5)}</p><span>{word()} {rng.randint(1, 30)}</span></div>', f"<article><p>{prose(4)}</p></article>"])
        return boxed(["section", "div", "ol", "aside"], ["comments", "comment", "commentlist", "responses", "discussion", "disqus", "replies", "reader-comments"], f"<h3>{phrase(2)}</h3>{''.join(one() for _ in range(rng.randint(1, 4)))}")

    aside = [menu, side, notice, advert, form, remarks]
    for _ in range(pages):
        main: list[str] = []

        def keep(text: str) -> str:
            main.append(text)
            return text

        if rng.random() < 0.03:  # the text and nothing else
            text = keep(pick([prose(), phrase(rng.randint(40, 200))]))
            yield f"{pick(['<article>', '<main>', f'<div{attr(["content", "post", "text"])}>'])}<p>{text}", main
            continue

        def part(noisy=True):
            kind = rng.random()
            if noisy and kind < 0.08:
                return pick([*aside, seealso, share, contents])()
            if kind < 0.15:
                level = rng.randint(2, 4)
                return f"<h{level}>{keep(phrase(rng.randint(1, 9)))}</h{level}>"
            if kind < 0.19:
                tag, short = pick(["ul", "ol"]), rng.random() < 0.5
                return f"<{tag}>{''.join(f'<li>{keep(phrase(rng.randint(1, 7)) + pick(["", "."]) if short else prose(2))}</li>' for _ in range(rng.randint(1, 5)))}</{tag}>"
            if kind < 0.22:
                return f"<blockquote>{pick(['<p>', ''])}{keep(prose(4))}</blockquote>"
            if kind < 0.23:
                return f"<figure><img src=a><figcaption>{keep(sentence())}</figcaption></figure>"
            if kind < 0.24:
                return f"<dl><dt>{keep(phrase(2))}</dt><dd>{keep(prose(2))}</dd></dl>"
            if kind < 0.25:
                return f"<table><tr><td>{keep(phrase(2))}</td><td>{keep(phrase(3))}</td></tr></table>"
            if kind < 0.27:
                return f"<pre>{keep(phrase(6))}</pre>"
            if kind < 0.28:
                return f"<p>{keep(f'{prose(6)} {phrase(3)} copyright {prose(4)}')}</p>"
            if kind < 0.30:
                return f"<div{pick(['', styled([])])}>{keep(prose())}</div>"
            if kind < 0.36:
                text = keep(prose(4))
                at = text.find(" ")
                return f"<p>{text[:at]} <a href='/y'>{text[at + 1:]}</a></p>" if at > 0 else f"<p>{text}</p>"
            return f"<p>{pick(['', '', '', '<b>'])}{keep(prose(pick([1, 2, 6, 12])))}{pick(['</p>', '</p>', '', '<br>'])}"

        def section(noisy):
            if rng.random() < 0.8:
                return part(noisy)
            inner = "".join(part(noisy) for _ in range(rng.randint(1, 4)))
            tag = pick(["section", "section", "div"])
            return f"<{tag}{pick(['', '', attr(['section', 'chapter', 'paragraph', 'text', 'row'])])}>{inner}</{tag}>"

        noisy = rng.random() < 0.5
        title = keep(phrase(rng.randint(1, 10)))
        ahead = crumbs() if rng.random() < 0.15 else hint() if rng.random() < 0.1 else ""
        under = pick([share, contents, hint])() if rng.random() < 0.2 else ""
        body = ahead + pick([f"<h1>{title}</h1>"] * 4 + [f"<h2>{title}</h2>"] * 2 + [f"<header><h1>{title}</h1></header>"]) + under + "".join(section(noisy) for _ in range(rng.randint(1, 14)))
        if rng.random() < 0.2:
            body += remarks()
        shell = rng.random()
        body = (
            f"<article>{body}</article>" if shell < 0.4 else f"<main>{body}</main>" if shell < 0.5
            else f"<main><article{attr(['post', 'entry'])}>{body}</article></main>" if shell < 0.6
            else f"<div{attr(['content', 'post', 'entry', 'article', 'main', 'story', 'text', 'body', 'article-body', 'page', 'post-content'])}>{body}</div>" if shell < 0.85
            else f"<div>{body}</div>" if shell < 0.95 else f"<table><tr><td>{links()}<td>{body}</table>"
        )
        ahead = "".join(rng.sample([x() for x in (menu, head, notice, advert, form, menu)], rng.randint(0, 4)))
        after = "".join(rng.sample([x() for x in (side, remarks, advert, notice, form, menu)], rng.randint(0, 3)))
        wrap = pick([lambda x: x, lambda x: f"<div{attr(['wrapper', 'container', 'page', 'site', 'outer'])}>{x}</div>"])
        yield f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{wrap(ahead + body + after + pick([foot(), foot(), '']))}{pick(['</body></html>', ''])}", main


def labelled_blocks(html: str, main: list[str]) -> tuple[list[np.ndarray], list[int]]:
    """Features and labels of a page; a block is kept if it is the next of the main texts."""
    blocks, left = blocks_of(html), [" ".join(x.split()) for x in main]
    labels, at = [], 0
    for b in blocks:
        hit = at < len(left) and b.text == left[at]
        labels.append(int(hit))
        at += hit
    return features(blocks), labels


@lru_cache(maxsize=2)
def default_field(pages: int = TRAINING_PAGES, seed: int = SEED) -> Field:
    return train(labelled_blocks(*p) for p in labelled_pages(pages, seed))


def main_text(html: str, field: Field) -> str:
    blocks = blocks_of(html)
    return " ".join(b.text for b, y in zip(blocks, field.best(field.of_blocks(blocks))) if y)


def extracted(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of `pages`."""
    field = field or default_field()
    used = np.flatnonzero(field.state.any(1))
    weights, step = field.state[used], field.step

    @F.arrow_udf("string")
    def text(htmls: pa.Array) -> pa.Array:
        state = np.zeros((1 << FEATURE_BITS, 2))
        state[used] = weights
        own = Field(state, step)
        return pa.array([main_text(h.as_py() or "", own) for h in htmls], pa.string())

    return pages.select("page_id", "url", text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
