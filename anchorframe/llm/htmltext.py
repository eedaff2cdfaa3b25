"""Main-text extraction from HTML by boosted trees over DOM nodes.

A page is parsed into a tree of block elements (with the usual implied end tags) whose leaves are its text blocks: runs of
text without a block-level tag in between. Gradient-boosted trees judge every node - element or block - by its tag, by
what its hashed attribute tokens have meant in training, by those of its ancestors, by depth, by text and link density of
its subtree and by its place among siblings: how likely does it hold any main text? Decoding is hierarchical. A dropped
node drops its whole subtree, a kept node leaves the choice to its children, and the most probable labelling of that form
is found from the leaves up, so an ancestor and a descendant never contradict each other.

The tokeniser reads a page once, from left to right, in time proportional to its length whatever the markup: quotes
matter only where a value starts, a tag that never ends takes the rest of the page, a quoted value that never ends is
taken as unquoted, and elements nested deeper than DEPTH become siblings.

No table labels DOM nodes, so the trees are trained on pages that this module writes itself (:func:`training_page`):
articles with surroundings of every kind the operator must remove, under semantic tags or attribute tokens, part of them
tokens without any meaning, so that structure has to tell. Attribute tokens are hashed into BUCKETS; one half of the pages
teaches how often the nodes of a bucket hold main text, the other half, with these rates as features, grows the trees. The
training set is fixed by its seed and size, and does not depend on the data. Its marks are read by the training parser
only; an attribute of that name in an input page means nothing.

Scripts, styles and other invisible elements never count as text. Character references are decoded, white space within
a block becomes one space, blocks are trimmed and joined by a line feed in page order.

Defined results: null and empty pages have empty text; markup that is not closed is closed by its ancestors' end or the
page's; invisible elements that never end are ignored (scripts, styles and their like take the rest); plain text without markup is judged as a block; repeated rows have equal results; extra columns are untouched.
"""

from __future__ import annotations

import html as _html
import random
import re
import zlib
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import boosting
from .common import map_rows, struct_array

PAGES, TREES, SEED = 3600, 90, 5
DEPTH, BUCKETS = 512, 4096
#: Attribute that carries the truth in training pages.
MARK = "data-truth"

_TAG = re.compile(r"""([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""")
_ATTR = re.compile(r"""([^\s/=>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_UNQUOTED_END = re.compile(r"""=\s*+[^\s"'>][^\s>]*/\Z""")
_COMMENT_END = re.compile(r"--!?>")
_LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML: element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
HIDDEN = frozenset("svg math template canvas object select button datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes these open elements (up to the listed boundary).
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
#: End tags of other elements do not reach out of these.
CELL = frozenset("td th caption table".split())
TABLE = frozenset("table caption tbody td tfoot th thead tr html body".split())

# What attribute tokens mean in training pages; the parser and the features know none of them.
TOKENS = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense",
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager tabs toc skip",
    "head": "header masthead topbar logo brand",
    "foot": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside rail widget widgets related recommended trending popular complementary",
    "note": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup overlay paywall announcement",
    "comm": "comment comments reply replies disqus discussion respond responses thread",
    "form": "form search login contact",
    "share": "share social sharing follow",
    "main": "content main article post entry story body text prose single",
    "part": "title headline lead intro byline author date caption summary paragraph heading quote",
}
TAGS = ["article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset", "table tbody thead tr td th", "blockquote figure pre", "#text"]
TAG = {t: i for i, v in enumerate(TAGS) for t in v.split()}
_NT = len(TAGS)


class Node:
    __slots__ = ("tag", "parent", "kids", "tokens", "text", "chars", "links", "words", "stops", "blocks", "tags", "depth", "start", "mark")

    def __init__(self, tag: str, parent: Node | None, tokens: tuple[int, ...] = (), mark: int = 0):
        self.tag, self.parent, self.kids, self.tokens, self.text = tag, parent, [], tokens, ""
        self.chars = self.links = self.words = self.stops = self.blocks = self.tags = 0
        self.depth, self.mark = (parent.depth + 1, mark or parent.mark) if parent else (0, mark)


@lru_cache(1 << 16)
def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


def _tokens(attrs: str, marks: bool) -> tuple[tuple[int, ...], int]:
    """Hashed tokens of class, id, role and the like; the mark, if asked for."""
    out, mark = [], 0
    for name, a, b, c in _ATTR.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-component"):
            out += [bucket(t.lower()) for t in _LETTERS.findall(a or b or c)]
        elif name == "hidden":
            out.append(bucket("*hidden"))
        elif marks and name == MARK:
            mark = int(a or b or c)
    return tuple(set(out)), mark


def parse(page: str, marks: bool = False) -> Node:
    """The page's tree of block elements; text blocks are nodes of tag ``#text``."""
    root = Node("#root", None)
    stack, open_ = [root], {}  # open block elements, and how many there are of each tag
    buffer, linked = [], 0  # text of the block, characters of it in links
    link = 0  # height of the stack at which the open link began, 0 if none is
    hidden, nested = "", 0
    ends: dict[str, int] = {}  # where the last end tag of an invisible element starts

    def flush():
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                leaf = Node("#text", stack[-1])
                leaf.text, leaf.links = text, min(len(text), linked)
                stack[-1].kids.append(leaf)
            buffer.clear()
            linked = 0

    def close(depth: int):
        nonlocal link
        for n in stack[depth:]:
            open_[n.tag] -= 1
        del stack[depth:]
        if link > depth:
            link = 0

    def ends_after(tag: str, at: int) -> bool:
        if tag not in ends:
            ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
        return ends[tag] >= at

    def say(text: str):
        nonlocal linked
        if not hidden:
            buffer.append(text)
            if link:
                linked += len(text)

    pos, size = 0, len(page)
    while pos < size:
        at = page.find("<", pos)
        if at != pos:
            text = page[pos : at if at >= 0 else size]
            say(_html.unescape(text) if "&" in text else text)
            if at < 0:
                break
            pos = at
        after = page[pos + 1 : pos + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", pos):
                if page.startswith(">", pos + 4) or page.startswith("->", pos + 4):
                    pos = page.index(">", pos + 4) + 1
                    continue
                m = _COMMENT_END.search(page, pos + 4)
                pos = m.end() if m else size
            else:
                pos = page.find(">", pos) + 1 or size
            continue
        ending = after == "/"
        m = _TAG.match(page, pos + 1 + ending)
        if m is None:
            letter = page[pos + 1 + ending : pos + 2 + ending]
            if letter.isascii() and letter.isalpha():
                break  # a tag that never ends
            if ending:
                pos = page.find(">", pos) + 1 or size
            else:
                say("<")
                pos += 1
            continue
        pos, tag, attrs = m.end(), m.group(1).lower(), m.group(2)
        if hidden:
            if tag == hidden:
                closed = not ending and hidden in ("svg", "math") and attrs.endswith("/") and not _UNQUOTED_END.search(attrs)
                nested += -1 if ending else 0 if closed else 1
                hidden = hidden if nested else ""
            elif tag in RAW and not ending:
                e = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, pos) if ends_after(tag, pos) else None
                pos = e.start() if e else size
            continue
        if ending:
            if tag == "a":
                link = 0
            elif tag == "br":
                say(" ")
            elif tag in BLOCK:
                flush()
                if open_.get(tag) and tag not in ("body", "html"):
                    for d in range(len(stack) - 1, 0, -1):
                        t = stack[d].tag
                        if t == tag:
                            close(d)
                            break
                        if t in CELL and tag not in TABLE:
                            break
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                say(" ")
            continue
        if tag in RAW:
            e = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, pos) if ends_after(tag, pos) else None
            pos = e.start() if e else size
            continue
        if tag in HIDDEN:
            closed = tag in ("svg", "math") and attrs.endswith("/") and not _UNQUOTED_END.search(attrs)
            if not closed and ends_after(tag, pos):
                hidden, nested = tag, 1
            continue
        if tag == "a":
            link = len(stack)
        elif tag in BLOCK:
            flush()
            if tag in ("html", "body") and open_.get(tag):
                continue
            if tag in IMPLIED:
                what, edge = IMPLIED[tag]
                for d in range(len(stack) - 1, 0, -1):
                    if stack[d].tag in edge:
                        break
                    if stack[d].tag in what:
                        close(d)
                        if tag != "tr":
                            break
            if stack[-1].tag == "p" or len(stack) > DEPTH:
                close(len(stack) - 1)
            tokens, mark = _tokens(attrs, marks) if attrs else ((), 0)
            n = Node(tag, stack[-1], tokens, mark)
            stack[-1].kids.append(n)
            stack.append(n)
            open_[tag] = open_.get(tag, 0) + 1
    flush()
    return root


def _order(root: Node) -> list[Node]:
    """Nodes, each before its descendants, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(reversed(n.kids))
    return out


#: Meaning of attribute tokens where none is known, as for tokens never seen in training.
UNKNOWN = np.zeros(BUCKETS)


def features(root: Node, meaning: np.ndarray = UNKNOWN) -> tuple[list[Node], np.ndarray]:
    """Nodes in page order and their features; ``meaning`` is the log odds of main text by token bucket."""
    nodes = _order(root)
    for n in nodes:
        if n.tag == "#text":
            n.chars, n.words, n.blocks = len(n.text), n.text.count(" ") + 1, 1
            n.stops = sum(map(n.text.count, ".,;"))
    for n in reversed(nodes):
        if n.parent is not None:
            p = n.parent
            p.chars += n.chars
            p.links += n.links
            p.words += n.words
            p.stops += n.stops
            p.blocks += n.blocks
            p.tags += n.tags + (n.tag != "#text")
    total = max(root.chars, 1)
    above: dict[int, tuple[int, float, float]] = {}
    out = []
    for n in nodes:
        up_tags, up_low, up_high = above[id(n.parent)] if n.parent is not None else (0, 0.0, 0.0)
        t = TAG.get(n.tag, -1)
        m = [meaning[b] for b in n.tokens] or [0.0]
        low, high = min(m), max(m)
        above[id(n)] = (up_tags | (1 << t if t >= 0 else 0), min(up_low, low), max(up_high, high))
        p, chars = n.parent, max(n.chars, 1)
        out.append(
            (
                t, up_tags, low, high, up_low, up_high, n.depth, np.log1p(n.chars), n.links / chars, n.chars / total, n.chars / max(p.chars if p else total, 1), n.words / max(n.blocks, 1),
                n.stops / max(n.words, 1), n.tags / max(n.words, 1), len(n.kids), len(p.kids) if p else 1, n.blocks, len(n.tokens),
            )
        )
    raw = np.array(out, np.float64)
    tags = (raw[:, :1] == np.arange(_NT)).astype(np.float64)
    ups = ((raw[:, 1].astype(np.int64)[:, None] >> np.arange(_NT)) & 1).astype(np.float64)
    return nodes, np.concatenate([tags, ups, raw[:, 2:]], 1)


def decode(nodes: list[Node], logit: np.ndarray) -> list[str]:
    """Text blocks of the most probable labelling in which a dropped node drops its subtree and a kept one keeps some of it."""
    keep, drop = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    at = {id(n): i for i, n in enumerate(nodes)}
    best, gone = keep.copy(), drop.copy()
    gain, first = np.full(len(nodes), -np.inf), np.full(len(nodes), -1)  # of the child that is kept most readily
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].tag != "#text":
            best[i] += min(gain[i], 0.0)
        if i:
            p, more = at[id(nodes[i].parent)], best[i] - gone[i]
            best[p] += max(best[i], gone[i])
            gone[p] += gone[i]
            if more >= gain[p]:
                gain[p], first[p] = more, i
    out, todo = [], [0] if best[0] >= gone[0] else []
    while todo:
        i = todo.pop()
        if nodes[i].tag == "#text":
            out.append(nodes[i].text)
        kids = [k for k in (at[id(n)] for n in nodes[i].kids) if best[k] >= gone[k]]
        todo.extend(reversed(kids or ([first[i]] if first[i] >= 0 else [])))
    return out


def _sentence(r: random.Random, n: int) -> str:
    w = ["".join(r.choice("aeioubdklmnrst") for _ in range(r.randint(1, 9))) for _ in range(n)]
    return (" ".join(w)).capitalize() + r.choice(["", ".", ".", ".", "!", "!!", ";"])


def _prose(r: random.Random, least: int = 1, most: int = 8) -> str:
    return " ".join(_sentence(r, r.randint(1, 18)) for _ in range(r.randint(least, most)))


@cache
def _nameless() -> list[str]:
    """Words without meaning, few enough to leave most token buckets to words never seen."""
    r = random.Random(1)
    return ["".join(r.choice("abcdefghjklmnopqrstuvwxz") for _ in range(r.randint(1, 7))) for _ in range(300)]


def _attr(r: random.Random, group: str, always: bool = False) -> str:
    if not always and r.random() < 0.4:
        return ""
    if r.random() < {"main": 0.5, "part": 0.5, "plain": 1.0}.get(group, 0.2):  # a name without meaning, of which main text has as many
        t = r.choice(["-", "_"]).join(r.choice(_nameless()) for _ in range(r.choice([1, 1, 2, 3]))) + r.choice(["", "", str(r.randint(1, 99))])
    else:
        t = r.choice(TOKENS[group].split())
    t = r.choice([t, t, f"{t}-{r.randint(1, 9)}", f"page-{t}", f"{t}_wrap", f"js-{t} c{r.randint(1, 99)}"])
    quote = r.choice(['"', '"', "'", ""] if " " not in t else ['"', "'"])
    return f" {r.choice(['class', 'class', 'id'])}={quote}{t}{quote}"


def training_page(r: random.Random) -> str:
    """A page whose main text lies under data-truth="1" and its other text under data-truth="2".

    Where things stand must say little: a good part of the pages begins or ends with the main text or has nothing else,
    titles lie within or before it, and paragraphs are p, div or lines, with or without a wrapper.
    """
    style = r.choices(["p", "div", "br"], [66, 22, 12])[0]

    def links(n):
        return "".join(f'<li><a href="/{i}">{_sentence(r, r.randint(1, 3))}</a></li>' for i in range(n))

    def box(group, tag, inner):
        semantic = tag and r.random() < 0.6
        name = tag if semantic else r.choice(["div", "div", "section"])
        return f'<{name}{_attr(r, group, not semantic)} {MARK}="2">{inner}</{name}>'

    def few(wrap="p"):
        return "".join(f"<{wrap}>{_prose(r, 1, 3)}</{wrap}>" if r.random() < 0.7 else _prose(r, 1, 2) for _ in range(r.randint(1, 3)))

    def nav():
        return box("nav", "nav", f"<ul>{links(r.randint(2, 9))}</ul>")

    def ad():
        return box("ad", None, _prose(r, 1, 3))

    def head():
        return box("head", "header", (f"<h1>{_sentence(r, 3)}</h1>" if r.random() < 0.3 else "") + (nav() if r.random() < 0.5 else _prose(r, 1, 1)))

    def foot():
        return box("foot", "footer", "&copy; " + _prose(r, 1, 4) + (f"<ul>{links(3)}</ul>" if r.random() < 0.3 else ""))

    def side():
        return box("side", "aside", f"<h3>{_sentence(r, 2)}</h3>" + (f"<ul>{links(r.randint(2, 6))}</ul>" if r.random() < 0.6 else few()))

    def note():
        return box("note", None, few())

    def form():
        return f'<form{_attr(r, "form")} {MARK}="2"><label>{_sentence(r, 2)}</label><input>{_prose(r, 1, 2) if r.random() < 0.5 else ""}</form>'

    def comments():
        one = lambda: f"<{(t := r.choice(['div', 'li', 'p', 'article']))}{_attr(r, 'comm')}>{few() if t != 'p' else _prose(r)}</{t}>"
        return box("comm", None, f"<h3>{_sentence(r, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 6))))

    def share():
        return box("share", None, f"<ul>{links(3)}</ul>")

    truth = f' {MARK}="1"'

    def part(tag, inner, odds=0.12):
        return f"<{tag}{_attr(r, 'part', True) if r.random() < odds else ''}{truth}>{inner}</{tag}>"

    def open_part(tag, inner):
        return f"<{tag}{truth}>{inner}"

    body = [part("h1", _prose(r, 1, 2)) if r.random() < 0.85 else part(r.choice(["div", "p"]), _sentence(r, r.randint(2, 8)), 0.9)] if r.random() < 0.9 else []
    if body and r.random() < 0.2:
        body = [f"<header{truth}>{body[0]}" + (part("p", _sentence(r, 5), 0.4) if r.random() < 0.5 else "") + "</header>"]
    if body and r.random() < 0.15:
        body.append(part(r.choice(["p", "div"]), _sentence(r, r.randint(2, 7)), 0.7))
    tiny = r.random() < 0.2  # a short text beside surroundings of any length
    prose = lambda: _prose(r, 1, 1 if tiny else 8)
    for _ in range(1 if tiny else r.choice([1, 1, 1, 2, 3, 5, 9, 18])):
        x = r.random()
        if x < 0.7 and style == "p":
            body.append(part("p", prose(), 0.03) if r.random() < 0.7 else open_part("p", f"<b>{prose()}<br>"))
        elif x < 0.7 and style == "div":
            body.append(part("div", prose() if r.random() < 0.8 else f"<span>{prose()}</span>", 0.04))
        elif x < 0.7:
            body.append(f"<{(t := r.choice(['div', 'p', 'td', 'font', 'div']).replace('td', 'span'))}{truth}>" + r.choice(["<br>", "<br><br>", "<br />\n"]).join(prose() for _ in range(r.randint(1, 4))) + f"</{t}>")
        elif x < 0.78:
            body.append(part(r.choice(["h2", "h2", "h3"]), _sentence(r, 4)))
        elif x < 0.84:
            tag = r.choice(["ul", "ul", "ol"])
            body.append(f"<{tag}{truth}>" + "".join(f"<li>{_prose(r, 1, 2)}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>")
        elif x < 0.88:
            body.append(part("blockquote", prose()))
        elif x < 0.91:
            body.append(f"<table{truth}>" + "".join(f"<tr><td>{_sentence(r, 2)}</td><td>{_sentence(r, 2)}</td></tr>" for _ in range(3)) + "</table>")
        elif x < 0.93:
            body.append(f"<figure{truth}><img src=a.png>{part('figcaption', _sentence(r, 6))}</figure>")
        elif x < 0.97:
            body.append(part("div", prose()))
        else:
            body.append(part("p", f'{prose()} <a href="/x">{_sentence(r, 3)}</a> {prose()}'))
    if len(body) > 3 and r.random() < 0.2:  # a chapter of its own
        at = r.randint(1, len(body) - 1)
        body = [*body[:at], f"<section{_attr(r, 'plain', r.random() < 0.6)}{truth}>{part(r.choice(['h2', 'h3']), _sentence(r, 3))}{''.join(body[at:])}</section>"]
    title = body.pop(0) if len(body) > 1 and r.random() < 0.4 else ""
    bare = r.random() < 0.3
    for extra, odds in ((ad, 0.2), (share, 0.15), (comments, 0.12), (note, 0.1), (side, 0.1), (form, 0.08)):
        if not bare and r.random() < odds:
            body.insert(r.randint(1, len(body)) if body else 0, extra())
    if len(body) > 2 and r.random() < 0.15:  # in pieces
        at = r.randint(1, len(body) - 1)
        tag = r.choice(["section", "div"])
        body = [f"<{tag}{_attr(r, 'main')}{truth}>{''.join(x)}</{tag}>" for x in (body[:at], body[at:])]
    shape = r.random()
    if shape < 0.15:  # nothing around it
        main = "".join(body)
    elif shape < 0.2:  # a cell of a layout table
        main = f'<table><tr><td{_attr(r, "nav", True)} {MARK}="2"><ul>{links(r.randint(2, 6))}</ul></td><td{_attr(r, "main", True)}{truth}>{"".join(body)}</td></tr></table>'
    else:
        name = r.choice(["article", "article", "main", "div", "section"])
        main = f'<{name}{_attr(r, "main", name in ("div", "section"))}{truth}>{"".join(body)}</{name}>'
        if r.random() < 0.2:
            main = f"<main{_attr(r, 'main')}>{main}</main>"
    def wrapped(inner, marked=False):
        """Up to four boxes around it, mostly with names without meaning."""
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
            tag = r.choice(["div", "div", "div", "section"])
            name = _attr(r, "plain", r.random() < 0.6)
            inner = f"<{tag}{name}{truth if marked and r.random() < 0.5 else ''}>{inner}</{tag}>"
        return inner

    main = wrapped(main, True)
    if not bare and r.random() < 0.3:  # a column beside it
        column = wrapped(r.choice([side, nav, ad, share])())
        main = wrapped(main + column if r.random() < 0.6 else column + main)
    before = [f() for f, odds in ((nav, 0.7), (head, 0.5), (ad, 0.4), (note, 0.25), (side, 0.2), (form, 0.1)) if r.random() < odds]
    after = [f() for f, odds in ((comments, 0.35), (side, 0.35), (ad, 0.25), (form, 0.2), (share, 0.2), (note, 0.15), (nav, 0.15)) if r.random() < odds]
    r.shuffle(before)
    r.shuffle(after)
    if bare or r.random() < 0.2:
        before = []
    after = [] if bare or r.random() < 0.25 else [*after, foot() if r.random() < 0.9 else ""]
    if title and r.random() < 0.4:
        title = f"<{(t := r.choice(['div', 'header', 'section']))}{_attr(r, r.choice(['part', 'main']))}{truth}>{title}</{t}>"
    if title and r.random() < 0.3:  # before all else
        before.insert(0, title)
        title = ""
    page = "".join([*before, title, main, *after])
    if r.random() < 0.3:
        page = f"<div{r.choice(['', ' id=page', ' class=wrapper'])}>{page}</div>"
    return f"<html><head><title>t</title></head><body>{page}</body></html>"


@dataclass
class Model:
    meaning: np.ndarray  # by token bucket
    forest: boosting.Forest

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.forest.logit(x)


def wanted(nodes: list[Node]) -> np.ndarray:
    """Which nodes of a marked page hold main text."""
    good: dict[int, bool] = {}
    for n in reversed(nodes):
        good[id(n)] = (n.tag == "#text" and n.mark == 1) or any(good[id(k)] for k in n.kids)
    return np.array([good[id(n)] for n in nodes])


@cache
def model(pages: int = PAGES, trees: int = TREES, seed: int = SEED) -> Model:
    r = random.Random(seed)
    kept, seen = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for _ in range(pages // 2):
        nodes = _order(parse(training_page(r), marks=True))
        for n, good in zip(nodes, wanted(nodes), strict=True):
            for b in n.tokens:
                kept[b] += good
                seen[b] += 1
    prior = (kept.sum() + 1) / (seen.sum() + 2)
    rate = (kept + 12 * prior) / (seen + 12)
    meaning = np.where(seen > 0, np.log(rate / (1 - rate)) - np.log(prior / (1 - prior)), 0.0)
    xs, ys = [], []
    for _ in range(pages - pages // 2):
        nodes, x = features(parse(training_page(r), marks=True), meaning)
        xs.append(x)
        ys.append(wanted(nodes))
    return Model(meaning, boosting.fit(np.concatenate(xs), np.concatenate(ys).astype(float), trees, depth=6))


def texts(pages: list[str | None], judge: Model) -> list[str]:
    trees = [features(parse(p), judge.meaning) if p else None for p in pages]
    full = [t for t in trees if t is not None]
    if not full:
        return ["" for _ in pages]
    logit = judge.logit(np.concatenate([x for _, x in full]))
    out, at = [], 0
    for t in trees:
        if t is None:
            out.append("")
        else:
            out.append("\n".join(decode(t[0], logit[at : at + len(t[0])])))
            at += len(t[0])
    return out


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Columns ``row`` (all of ``pages``) and ``res``: text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(model())

    def run(rows: pa.StructArray) -> pa.StructArray:
        col, out = rows.field(html_col), []
        for s in range(0, len(col), 64):  # few trees are alive at a time
            out += texts(col.slice(s, 64).to_pylist(), sent.value)
        return struct_array({"text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())})

    return map_rows(pages, run, RESULT)


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("row.page_id", "row.url", "res.text", F.col("res.n_chars").alias("n_chars"))
