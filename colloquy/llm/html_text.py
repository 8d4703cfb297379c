"""Main text of web pages: boosted trees over DOM nodes, decoded so that a dropped node drops all below it."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import trees

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TOKENS = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Fixed values of HTML: elements without an end, elements that hold nothing but characters up to their end tag, other
# elements whose content is never shown as text or is a control of a form, and those of them that can hold themselves,
# what can stand in a head, elements that open a block, what closes an open p, and what ends an svg but for within some
# elements of its own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
DROPPED = frozenset("noscript template svg canvas select button head".split())
NESTS = frozenset("template svg".split())
HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template head html".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot caption".split())
FOREIGN = frozenset("svg".split())
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
WITHIN = frozenset("foreignobject desc title".split())
#: The next tag of an element, with a slash if it is an end tag; and the next end tag.
NEXT = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in RAW | DROPPED}
END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}

# What class names, ids and roles say of an element, by kind.
SAYS = {
    "menu": "nav navigation navbar menu menus breadcrumb breadcrumbs crumbs topbar tabs toc pager pagination links".split(),
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner adsense dfp".split(),
    "comment": "comment comments commentlist reply replies respond response responses disqus discussion reviews feedback".split(),
    "foot": "footer foot copyright legal imprint colophon credits bottom".split(),
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular rail secondary complementary teaser more".split(),
    "notice": "notice notices cookie cookies consent gdpr alert warning popup modal overlay message disclaimer announcement subscribe paywall".split(),
    "share": "share sharing social follow facebook twitter tags tag meta byline author rating".split(),
    "form": "form search searchform login signin signup register newsletter contact subscription input".split(),
    "head": "header head masthead logo branding site title topper tagline".split(),
    "main": "article content main post entry story text body page document prose copy read articlebody maincontent paragraph".split(),
}
WORDS = {w: k for k, ws in enumerate(SAYS.values()) for w in ws}
KINDS = len(SAYS)
MAIN = list(SAYS).index("main")
#: Bins that the tokens of names are hashed to, and what an element without names says.
BINS = 24
NONE = (0,) * KINDS, 0
#: Characters, but for spaces and links, that a block holds itself at least to count as prose.
PROSE = 60
MAIN_TAGS = frozenset("article main h1".split())
TAGS = ["article main", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu dir", "li dd dt", "div center section", "nav", "header hgroup", "footer", "aside", "form fieldset legend", "table tbody thead tfoot tr", "td th caption", "blockquote pre figure figcaption", "details dialog summary address"]
TAG = {t: k for k, ts in enumerate(TAGS) for t in ts.split()}
OUTER = {"nav": 0, "footer": 3, "aside": 4, "form": 7, "header": 8, "dialog": 5, "article": MAIN, "main": MAIN}


class Node:
    """A block, or an inline element that has a telling name or is none of HTML's own; nth: its place among its siblings."""

    __slots__ = ("tag", "parent", "depth", "says", "items", "text", "own", "link", "tags", "stops", "prose", "runs", "first", "bins", "kids", "at", "row", "nth", "block")

    def __init__(self, tag: str, parent: Node | None, told: tuple, at: int, block: bool = True):
        self.tag, self.parent, (self.says, self.bins), self.at, self.block = tag, parent, told, at, block
        self.nth = len(parent.kids) if parent else 0
        self.depth = parent.depth + 1 if parent else 0
        self.items: list = []
        self.kids: list[Node] = []
        self.text = self.own = self.link = self.tags = self.stops = self.prose = self.runs = 0
        self.first = tag in MAIN_TAGS
        self.row = -1


def says(attributes: str, memo: dict = {}) -> tuple:  # noqa: B006
    """How many tokens of an element's names are of each kind, and the bins that all its tokens are hashed to, as bits."""
    found = memo.get(attributes)
    if found is None:
        counts, bins = [0] * KINDS, 0
        for m in ATTRIBUTE.finditer(attributes):
            for w in TOKENS.findall(m[1] or m[2] or m[3] or ""):
                if (k := WORDS.get(w.lower())) is not None:
                    counts[k] += 1
                bins |= 1 << zlib.crc32(w.lower().encode()) % BINS
        if len(memo) > 10_000:
            memo.clear()
        found = memo[attributes] = tuple(counts), bins
    return found


def parse(page: str) -> Node:
    """The blocks of a page; inline elements only leave their text and whether it is a link's.

    Text of RAW elements ends at their next end tag only, or with the page, as in browsers; what else is dropped ends
    with its parent at the latest, and at the next block if it has no end tag. A head ends where something stands that
    can't be in one.
    """
    root = Node("html", None, NONE, 0)
    stack: list[tuple[str, Node | None]] = [("html", root)]  # open elements, and the block that text in them belongs to
    links = 0
    drop, loose = 0, False  # where the outermost dropped element but a head stands, and whether it lacks an end tag
    at = 0
    while at < len(page):
        for m in TOKEN.finditer(page, at):
            name = m[1]
            if name is None:
                piece = m[0]
                if piece[0] == "<" and len(piece) > 1:
                    continue
                node = stack[-1][1]
                if node is None:
                    if stack[-1][0] != "head" or piece.isspace():
                        continue
                    del stack[1:]
                    node = root
                text = html.unescape(piece) if "&" in piece else piece
                node.items.append(text)
                n = len(text) - text.count(" ") if not text.isspace() else 0
                node.own += n
                node.stops += text.count(". ") + text.count(", ") + text.count(".\n") + (text[-1:] == ".")
                if links:
                    node.link += n
                continue
            name, close = name.lower(), m[0][1] == "/"
            if not close:
                if drop and ended(stack, drop, loose, name):
                    links -= sum(t == "a" for t, _ in stack[drop:])
                    del stack[drop:]
                    drop = 0
                if len(stack) > 1 and stack[1][0] == "head" and (name == "body" or (stack[-1][0] == "head" and name not in HEAD)):
                    links -= sum(t == "a" for t, _ in stack)
                    del stack[1:]
                    drop = 0
                if name in RAW:
                    if m[2].endswith("/") and not ((hit := NEXT[name].search(page, m.end())) and hit[1]):
                        continue
                    end = END[name].search(page, m.end())
                    at = end.end() if end else len(page)
                    break
                node = stack[-1][1]
                if name in DROPPED and (node or name != "head"):
                    if m[2].endswith("/") or (name == "head" and (len(stack) > 1 or root.own or root.kids)):
                        continue
                    if not drop and name != "head":
                        hit = NEXT[name].search(page, m.end())
                        drop, loose = len(stack), not (hit and (hit[1] or name in NESTS))
                    stack.append((name, None))
                    continue
                if node is None:
                    if name not in VOID and name not in ("html", "head", "body") and not m[2].endswith("/"):
                        links += name == "a"
                        stack.append((name, None))
                    continue
                node.tags += 1
                if name in VOID:
                    if name in ("br", "hr"):
                        node.items.append(" ")
                    continue
                if name in ("html", "body"):
                    continue
                if name in CLOSES_P:
                    links = closed(stack, {"p"}, {"table", "td", "th", "div", "article", "section", "main", "body"}, links)
                if name in SAME:
                    links = closed(stack, *SAME[name], links)
                node = stack[-1][1]
                block, told = name in BLOCKS, says(m[2]) if m[2] else NONE
                links += name == "a"
                if block or any(told[0]) or "-" in name or name == "ins":
                    kid = Node(name, node, told, m.start(), block)
                    node.items.append(kid)
                    node.kids.append(kid)
                    node = kid
                stack.append((name, node))
            elif len(stack) > 1:
                for k in range(len(stack) - 1, 0, -1):
                    t = stack[k][0]
                    if t == name:
                        links -= sum(t == "a" for t, _ in stack[k:])
                        del stack[k:]
                        if drop >= k:
                            drop = 0
                        break
                    if name not in BLOCKS and name not in DROPPED and (t in BLOCKS or t in DROPPED):
                        break
        else:
            break
    return root


def ended(stack: list, drop: int, loose: bool, name: str) -> bool:
    """Whether a start tag ends the dropped element at that place of the stack."""
    outer = stack[drop][0]
    if outer in FOREIGN and name in BREAKS:
        return not any(t in WITHIN for t, _ in stack[drop + 1 :])
    return (loose and name in BLOCKS) or (name == outer and name not in NESTS)


def closed(stack: list, what: set, within: set, links: int) -> int:
    """Closes the innermost open element of `what`, unless one of `within` stands before it; repeated for table rows."""
    k = len(stack) - 1
    cut = None
    while k > 0 and stack[k][0] not in within:
        if stack[k][0] in what:
            cut = k
        k -= 1
    if cut is not None:
        links -= sum(t == "a" for t, _ in stack[cut:])
        del stack[cut:]
    return links


def in_order(root: Node) -> list[Node]:
    """All nodes, each before those below it; sums over their subtrees are made on the way."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        n.row = len(out)
        out.append(n)
        todo.extend(reversed(n.kids))
    for n in reversed(out):
        n.text += n.own
        if (said := n.own - min(n.own, n.link)) >= PROSE:
            n.prose += said
            n.runs += 1
        n.tags += 1
        if n.parent:
            p = n.parent
            p.text += n.text
            p.link += n.link
            p.tags += n.tags
            p.stops += n.stops
            p.prose += n.prose
            p.runs += n.runs
            p.first |= n.first
    return out


def node_features(nodes: list[Node], size: int) -> np.ndarray:
    """Subtree densities, names, depth and siblings of each node, and the names of what stands around it.

    Names around it are counted twice: of all it stands in, and of what holds less than half the page's prose. A wrapper
    of most of the page says little about a part of it.
    """
    whole, prose = nodes[0].text + 1, nodes[0].prose + 1
    rows = []
    outer: list[tuple[tuple, tuple]] = []
    top = next((n.at for n in nodes if n.tag == "h1"), -1)
    # the innermost article or main element that holds most of the prose, and what stands in it
    core = next((n for n in reversed(nodes) if n.tag in ("article", "main") and n.prose * 2 >= prose), None)
    inside: list[bool] = []
    for n in nodes:
        inside.append(n is core or bool(n.parent and inside[n.parent.row]))
        above, near = outer[n.parent.row] if n.parent else (NONE[0], NONE[0])
        mine = list(n.says)
        if (k := OUTER.get(n.tag)) is not None:
            mine[k] += 1
        told = tuple(a + (b > 0) for a, b in zip(above, mine))
        outer.append((told, near if n.prose * 2 >= prose else tuple(a + (b > 0) for a, b in zip(near, mine))))
        kin = n.parent.kids if n.parent else [n]
        at = n.nth
        before, after = (kin[at - 1] if at else None), (kin[at + 1] if at + 1 < len(kin) else None)
        links = n.link / (n.text + 1)
        t, over = TAG.get(n.tag, -1), n.parent or n
        rows.append((
            n.depth, n.text, n.own, links, n.text / n.tags, len(n.kids), at / len(kin), len(kin), n.text / (over.text + 1), before.text if before else 0, after.text if after else 0,
            n.text / whole, n.stops / (n.text + 20), n.at / size, TAG.get(over.tag, -1) if n.parent else -2, n.block,
            n.prose / prose, n.prose / (n.text + 1), n.runs, over.prose / prose, over.runs, over.link / (over.text + 1), n.first, n.at > top >= 0, core is not None, inside[-1], core is not None and n.row <= core.row and n.prose >= core.prose,
            before.tag == n.tag if before else -1, after.tag == n.tag if after else -1, before.prose > 0 if before else -1, after.prose > 0 if after else -1,
            *(t == k for k in range(len(TAGS))), *n.says, *above, sum(mine) - mine[MAIN], sum(above) - above[MAIN], *near, sum(near) - near[MAIN], *(n.bins >> k & 1 for k in range(BINS)),
        ))
    x = np.array(rows, dtype=float)
    for k in (1, 2, 4, 9, 10):
        x[:, k] = np.log1p(x[:, k])
    return x


def agreed(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Odds of which blocks of prose that stand in one block, with one tag and the same names, have the mean: the last paragraph of an article is judged as the others are."""
    groups: dict[tuple, list[int]] = {}
    for n in nodes:
        if n.parent and n.own - min(n.own, n.link) >= PROSE:
            groups.setdefault((n.parent.row, n.tag, n.says, n.bins), []).append(n.row)
    out = np.array(odds)
    for rows in groups.values():
        if len(rows) > 1:
            out[rows] = odds[rows].mean()
    return out


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes stay: the likeliest choice in which whatever stands below a dropped node is dropped."""
    keep_log, drop_log = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best, drop = np.array(keep_log), np.array(drop_log)
    for n in reversed(nodes):  # a node's kids have been added to it by now
        if n.parent:
            p = n.parent.row
            drop[p] += drop[n.row]
            best[p] += max(best[n.row], drop[n.row])
    stays = np.zeros(len(nodes), dtype=bool)
    stays[0] = True
    for n in nodes[1:]:
        stays[n.row] = stays[n.parent.row] and best[n.row] >= drop[n.row]
    return stays


def text_of(root: Node, stays: np.ndarray) -> str:
    out: list[str] = []
    todo: list = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif stays[item.row]:
            if item.block:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(item.items))
    return " ".join("".join(out).split())


# --- pages to learn from -------------------------------------------------------------------------------------------

#: Characters of pages whose nodes are held together.
PORTION = 2 << 20
#: Pages that are made up for the trees to learn from.
PAGES, TREES = 1500, 100
PAGE = re.compile(r"\x01(/?)")


def made_up_page(rng: random.Random) -> str:
    """A page whose main text stands between marks \\x01 and \\x01/; what else it has varies in kind, place and naming."""
    letters = "abcdefghilmnoprstuvéüñ"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    some = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))
    sentence = lambda: some(2, 18).capitalize() + rng.choice([".", ".", ".", ",", "!", ""])
    prose = lambda lo=1, hi=8: " ".join(sentence() for _ in range(rng.randint(lo, hi)))
    telling = rng.choice([0.0, 0.4, 0.8, 1.0])  # share of a page's names that say what they name

    def name(kind: str) -> str:
        own = rng.choice(SAYS[kind]) if rng.random() < telling else word()
        return f' {rng.choice(["class", "class", "id", "role"])}="{rng.choice([word() + " ", "", "", "site-", "the_"])}{own}{rng.choice(["", "", "-box", " " + word(), "-1", "Wrap"])}"'

    plain = lambda: rng.choice(["", "", f' class="{word()}"', f' id="{word()}"'])
    told = lambda: rng.choice(SAYS[rng.choice([k for k in SAYS if k != "main"])])

    def wrapping() -> str:
        """Names of what holds the main text, of which some token says something else."""
        own = rng.choice([rng.choice(SAYS["main"]), word(), word()])
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(["{0} {2}-{1}", "{2}-{1} {0}", "{0} {1}", "{0}-{1}-{3}", "{1}-{0}", "{0} {2}-{1} {2}-{4}", "{2}_{1}"]).format(own, told(), rng.choice(["with", "has", "no", word()]), rng.choice(SAYS["main"]), told())}"'
    link = lambda n=3: f'<a href="/{word()}">{some(1, n)}</a>'
    items = lambda n=3: "".join(f"<li>{link(n)}</li>" if rng.random() < 0.9 else f"<li>{link(n)}" for _ in range(rng.randint(2, 9)))
    box = lambda kind, inner: f"<{(t := rng.choice(['div', 'div', 'section', 'p' if '<' not in inner else 'div']))}{name(kind)}>{inner}</{t}>"
    para = lambda: rng.choice(["<p>{}</p>", "<div>{}</div>"]).format(prose(1, 4)) if rng.random() < 0.6 else prose(1, 4)

    def menu() -> str:
        return rng.choice([lambda: f"<nav{plain()}><ul>{items()}</ul></nav>", lambda: f"<ul{name('menu')}>{items()}</ul>", lambda: box("menu", " | ".join(link() for _ in range(5))), lambda: f"<header{plain()}><h1>{some(1, 4)}</h1><nav>{items()}</nav></header>"])()

    def head() -> str:
        return rng.choice([lambda: f"<header{plain()}><h2>{some(1, 4)}</h2><p>{prose(1, 2)}</p></header>", lambda: f"<header>{some(1, 6)}</header>", lambda: f"<header{plain()}><h1>{rng.choice([some(1, 4), link()])}</h1></header>", lambda: f"<div{name('head')}><p>{some(1, 7)}</p></div>"])()

    def advert() -> str:
        inline = rng.choice(["ins", "span", f"{word()}-{word()}", "a"])
        return rng.choice([lambda: box("advert", prose(1, 4)), lambda: box("advert", para()), lambda: f"<{inline}{name('advert')}>{prose(1, 2)}</{inline}>", lambda: box("advert", link(6))])()

    def side() -> str:
        return rng.choice([lambda: f"<aside{plain()}><h3>{some(1, 3)}</h3>{para()}</aside>", lambda: f"<aside><ul>{items(8)}</ul></aside>", lambda: box("side", f"<h3>{some(1, 3)}</h3><ul>{items(7)}</ul>"), lambda: box("side", para() + para())])()

    def notice() -> str:
        return rng.choice([lambda: box("notice", prose(1, 4)), lambda: box("notice", para() + "<button>ok</button>"), lambda: f'<div role="alert">{prose(1, 3)}</div>', lambda: f"<dialog open>{para()}</dialog>"])()

    def form() -> str:
        inner = f"<label>{some(1, 4)}</label><input type=text>{rng.choice(['', '<p>' + prose(1, 2) + '</p>'])}<button>{word()}</button>"
        return rng.choice([lambda: f"<form{plain()} action=/x>{inner}</form>", lambda: f"<form>{sentence()}{rng.choice(['', para()])}</form>", lambda: box("form", f"<form>{inner}</form>"), lambda: box("form", para())])()

    def comments() -> str:
        each = [f"<{(t := rng.choice(['div', 'li', 'article', 'p']))}{name('comment') if rng.random() < 0.6 else plain()}>{rng.choice(['', '<b>' + word() + '</b> '])}{prose(1, 6) if t == 'p' else para()}</{t}>" for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 14]))]
        return rng.choice(["<section{n}>{h}{c}</section>", "<div{n}>{h}{c}</div>", "<ol{n}>{c}</ol>"]).format(n=name("comment"), h=rng.choice(["", f"<h3>{some(1, 3)}</h3>"]), c="".join(each))

    def share() -> str:
        return box("share", " ".join(link(1) for _ in range(4)))

    def foot() -> str:
        text = f"&copy; {word()}.example {rng.choice(['&middot; ', ''])}{prose(1, 3)}"
        return rng.choice([lambda: f"<footer{plain()}>{text}</footer>", lambda: f"<footer><p>{text}</p><ul>{items()}</ul></footer>", lambda: f"<div{name('foot')}>{text}</div>"])()

    def block() -> str:
        inline = lambda: prose(1, 9) if rng.random() < 0.7 else f"{sentence()} <b>{some(1, 3)}</b> {sentence()} {link()} {prose(1, 3)}"
        r = rng.random()
        if r < 0.6:
            return rng.choice(["<p{}>{}</p>", "<p{}>{}</p>", "<p{}>{}"]).format(plain() if rng.random() < 0.3 else "", inline())
        if r < 0.66:
            return f"<p>{sentence()} <{(t := rng.choice(['span', 'em', 'x-' + word()]))} class=\"{rng.choice([word(), rng.choice(SAYS[rng.choice(list(SAYS))])])}\">{some(1, 5)}</{t}> {sentence()}</p>"
        if r < 0.68:
            return f"{inline()}<br><br>{inline()}"
        if r < 0.76:
            return "<h{0}>{1}</h{0}>".format(rng.randint(2, 4), some(1, 8))
        if r < 0.82:
            return f"<ul>{''.join(f'<li>{some(1, 14)}</li>' for _ in range(rng.randint(1, 6)))}</ul>"
        if r < 0.87:
            return f"<blockquote>{rng.choice(['<p>' + inline() + '</p>', inline()])}</blockquote>"
        if r < 0.91:
            return f"<table>{''.join(f'<tr><td>{some(1, 4)}</td><td>{some(1, 4)}</td></tr>' for _ in range(rng.randint(1, 4)))}</table>"
        if r < 0.94:
            return f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>"
        if r < 0.96:
            return f"<pre>{some(3, 20)}</pre>"
        return f"<div{plain()}>{inline()}</div>"

    inside = [advert, share, notice, side, form, comments]
    body = []
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])):
        body.append(block())
        if rng.random() < 0.2:
            body.append(f"\x01/{rng.choice(inside)()}\x01")
    title = rng.choice([lambda: f"<h1>{some(1, 12)}</h1>", lambda: f"<h1{plain()}>{some(1, 9)}.</h1>", lambda: ""])()
    if rng.random() < 0.1:
        title = f"<header>{title}</header>" if title else ""
    main = f"\x01{title}{''.join(body)}\x01/"
    if rng.random() < 0.25:
        main += rng.choice([comments, share, form, advert])()
    main = rng.choice([
        lambda: f"<article{plain()}>{main}</article>", lambda: f"<article{name('main')}>{main}</article>", lambda: f"<main{plain()}>{main}</main>", lambda: f"<main><article>{main}</article></main>", lambda: f"<div{name('main')}>{main}</div>",
        lambda: f"<div{name('main')}><div{plain()}>{main}</div></div>", lambda: f"<section{name('main')}>{main}</section>", lambda: f"<table><tr><td>{main}</td></tr></table>", lambda: f"<div{plain()}>{main}</div>", lambda: f"<section>{main}</section>", lambda: main,
        lambda: f"<div{wrapping()}>{main}</div>", lambda: f"<div{wrapping()}><article{plain()}>{main}</article></div>", lambda: f"<section{wrapping()}><div{rng.choice([plain, wrapping])()}>{main}</div></section>",
    ])()
    early = [f() for f in (menu, head, advert, notice, form, side) if rng.random() < 0.4]
    late = [f() for f in (side, advert, comments, share, form, notice, menu) if rng.random() < 0.3]
    rng.shuffle(early)
    rng.shuffle(late)
    if rng.random() < 0.12:
        early, late = [], []
    if rng.random() < 0.25:
        late = []
    page = "".join(early) + main + "".join(late) + (foot() if rng.random() < 0.6 and (early or late) else "")
    if rng.random() < 0.5:
        page = f"<div{rng.choice([plain(), wrapping(), ' class=\"page\"', ' id=\"wrapper\"', ' class=\"container\"'])}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{some(1, 5)}</title><style>p{{x:y}}</style></head><body>{page}</body></html>"


def learning_rows(pages: int = PAGES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(features, 1 where a node has main text below it) of made-up pages."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        marked = made_up_page(rng)
        page = marked.replace("\x01/", "").replace("\x01", "")
        spans, cut, start = [], 0, None
        for m in PAGE.finditer(marked):
            at = m.start() - cut
            cut += len(m[0])
            if m[1]:
                spans.append((start, at))
            else:
                start = at
        nodes = in_order(parse(page))
        y = np.zeros(len(nodes))
        for n in reversed(nodes):
            y[n.row] = y[n.row] or any(lo <= n.at < hi for lo, hi in spans)
            if n.parent and y[n.row]:
                y[n.parent.row] = 1
        xs.append(node_features(nodes, len(page)))
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache
def learnt(pages: int = PAGES) -> trees.BoostedTrees:
    """The trees, fitted once in a session."""
    return trees.fit(*learning_rows(pages), trees=TREES)


def extracted(pages: list[str], model: trees.BoostedTrees) -> list[str]:
    """The main texts of whole pages."""
    found = [in_order(parse(p)) for p in pages]
    x = [node_features(nodes, len(p) + 1) for nodes, p in zip(found, pages)]
    odds = model.log_odds(np.concatenate(x)) if x else np.zeros(0)
    ends = np.cumsum([len(n) for n in found])
    return [text_of(nodes[0], decode(nodes, agreed(nodes, odds[hi - len(nodes) : hi]))) for nodes, hi in zip(found, ends)]


def portions(pages: list[str], most: int = PORTION) -> Iterator[list[str]]:
    """The pages in turn, as many as hold `most` characters together, or one."""
    held: list[str] = []
    size = 0
    for p in pages:
        if held and size + len(p) > most:
            yield held
            held, size = [], 0
        held.append(p)
        size += len(p)
    if held:
        yield held


def extract(pages: DataFrame, model: trees.BoostedTrees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): each page's main text, character references decoded, one space between blocks.

    Trees are learnt from made-up pages, a fixed number, before. A null or empty page gives the empty text; rows with
    equal or null ids are each extracted; an empty table gives an empty result; other columns don't matter. A task holds
    the nodes of PORTION characters of pages at a time, or of one page.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or learnt())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t for p in portions([h or "" for h in b.column(2).to_pylist()]) for t in extracted(p, shared.value)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
