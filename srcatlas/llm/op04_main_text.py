"""HTML extraction: gradient-boosted trees over DOM-node features with
hierarchical decoding.

A page is parsed into its block elements. Each has features of its subtree
(text, density, links, lists, controls), its attribute tokens and those of its
ancestors, its depth and its siblings. Boosted trees give the odds that a
block holds main text. Decoding then takes the best labelling of the tree in
which a block is kept only where its parent is: no ancestor is dropped over a
kept descendant.

Training reads a bounded sample: the ``FIT_PAGES`` pages (lowest by a hash of
page_id, of at most ``FIT_BYTES``) that mark one article or main element. Its
text is the main text. As such pages look alike, each is also dressed anew:
its blocks are set into other layouts, with menus, side bars, notices, adverts,
forms and comments around and within them, so that the trees learn from
structure and not from one template. Extraction is per page, without a
shuffle.

Defined results: null or empty html, and pages without main text, give an
empty text and 0 characters; broken markup is read as browsers do in the
common cases (implied end tags, unknown end tags, open comments); repeated
rows are extracted each; an empty table gives an empty result; without any
page to learn from, the text of all blocks outside of elements that say what
they are (menus and the like) is kept; only ``page_id``, ``url`` and ``html``
are read.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import map_batches

FIT_PAGES = 250
FIT_BYTES = 200_000
#: Layouts that each training page is set into.
DRESSINGS = 4

#: Fixed values of HTML: elements without content, with raw text, whose text
#: is never shown as text, and inline elements (all others are blocks).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head noscript template svg math button select option optgroup datalist object audio video canvas map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTROLS = frozenset("input button select textarea label".split())
#: An opening tag of the key closes an open element of the value, unless one
#: of the elements after it stands between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "thead": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
          "body": ({"head"}, {"body"})}
#: Blocks that may stand within a paragraph's place: all but these close <p>.
_BOUNDARY = {"table", "td", "th", "button", "object", "caption", "html"}

#: Attribute tokens by what they say of a block.
TOKENS = {
    "content": "article articlebody body blog content contents entry hentry main maincontent page post posting postbody prose story text textbody",
    "menu": "breadcrumb breadcrumbs hamburger links menu menubar nav navbar navigation navi pager paging pagination skip sitemap tabs toc topnav toolbar",
    "header": "banner brand header hero logo masthead sitename site-header tagline top topbar",
    "footer": "bottom colophon contentinfo copyright credits footer foot imprint legal",
    "side": "aside complementary rail right sidebar side sidebars widget widgets",
    "ad": "ad ads adsbygoogle advert advertisement adverts advertorial adbox dfp promo promoted promotion sponsor sponsored sponsors teads taboola outbrain",
    "notice": "alert announcement consent cookie cookies dialog gdpr infobar interstitial message modal notice notification overlay paywall popup privacy toast warning",
    "form": "contact form login newsletter optin register search searchbox signin signup subscribe subscription survey",
    "comment": "comment commentary comments commentlist discuss discussion disqus feedback forum replies reply respond responses reviews",
    "share": "bookmark facebook follow like likes share sharing shares social tweet twitter whatsapp",
    "related": "also latest more popular recent recommend recommendations recommended related suggestions tags trending",
    "byline": "author byline bio date dateline meta metadata postmeta published timestamp",
    "hidden": "hidden invisible sr-only screen-reader visuallyhidden offscreen",
}
GROUPS = list(TOKENS)
_GROUP_OF = {t: 1 << i for i, g in enumerate(GROUPS) for t in TOKENS[g].split()}
#: Elements and roles that say the same as a token.
_ELEMENT_GROUP = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form",
                  "dialog": "notice", "article": "content", "main": "content", "address": "byline"}
_ROLE_GROUP = {"navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form",
               "form": "form", "dialog": "notice", "alert": "notice", "alertdialog": "notice", "main": "content", "article": "content",
               "menu": "menu", "menubar": "menu"}
_BIT = {g: 1 << i for i, g in enumerate(GROUPS)}
#: Kinds of elements, as features.
KINDS = ("p", "heading", "list", "li", "table", "cell", "article", "main", "section", "div", "nav", "header", "footer",
         "aside", "form", "figure", "quote", "pre", "other")
_KIND = {"p": "p", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
         "ul": "list", "ol": "list", "dl": "list", "li": "li", "dt": "li", "dd": "li", "table": "table", "tr": "table", "tbody": "table",
         "td": "cell", "th": "cell", "article": "article", "main": "main", "section": "section", "div": "div", "nav": "nav",
         "header": "header", "footer": "footer", "aside": "aside", "form": "form", "figure": "figure", "figcaption": "figure",
         "blockquote": "quote", "pre": "pre"}

_MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r"[.,;:!?]")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


def _groups(attrs: str) -> int:
    """Bits of the token groups that class, id and role speak of."""
    if "=" not in attrs and "hidden" not in attrs:
        return 0
    bits = 0
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            for word in value.split():
                low = word.lower()
                bits |= _GROUP_OF.get(low, 0)
                for t in _TOKEN.findall(word):
                    bits |= _GROUP_OF.get(t.lower(), 0)
        elif name == "role":
            g = _ROLE_GROUP.get(value.strip().lower())
            bits |= _BIT[g] if g else 0
        elif name == "itemprop" and value.lower() in ("articlebody", "text"):
            bits |= _BIT["content"]
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(
                r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            bits |= _BIT["hidden"]
    return bits


@dataclass
class Page:
    """Blocks of a page in document order, parents first; 0 is the root."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    groups: list[int] = field(default_factory=lambda: [0])
    above: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    unseen: list[bool] = field(default_factory=lambda: [False])
    tags: list[int] = field(default_factory=lambda: [0])
    controls: list[int] = field(default_factory=lambda: [0])
    #: (node, run of text without a block's edge, text, inside a link)
    texts: list[tuple[int, int, str, bool]] = field(default_factory=list)


def parse(source: str) -> Page:
    page = Page()
    stack, run, at, link, n = [0], 0, 0, False, len(source)

    def add_text(text: str) -> None:
        if text:
            page.texts.append((stack[-1], run, html_lib.unescape(text) if "&" in text else text, link))

    def close(i: int) -> None:
        nonlocal run
        del stack[i:]
        run += 1

    while at < n:
        m = _MARKUP.search(source, at)
        if m is None:
            add_text(source[at:])
            break
        start = m.start()
        add_text(source[at:start])
        if source.startswith("<!--", start):
            end = _COMMENT_END.search(source, start + 4) if not source.startswith(("<!-->", "<!--->"), start) else None
            at = end.end() if end else (source.index(">", start) + 1 if source.startswith(("<!-->", "<!--->"), start) else n)
            continue
        if source[start + 1] in "!?":
            end = source.find(">", start)
            at = end + 1 if end >= 0 else n
            continue
        t = _TAG.match(source, start)
        if t is not None:
            closing, name, attrs, at = t[1], t[2].lower(), t[3], t.end()
        else:                                           # an open quote: up to the next >
            end = source.find(">", start)
            if end < 0:
                break
            inner = source[start + 1:end].lstrip("/").split(None, 1)
            closing, name, attrs, at = source[start + 1] == "/", inner[0].lower(), "", end + 1
        if closing:
            if name == "a":
                link = False
            elif name == "br":
                run += 1
            elif name not in INLINE:
                for i in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[i]] == name:
                        close(i)
                        break
            continue
        node = stack[-1]
        page.tags[node] += 1
        if name in CONTROLS:
            page.controls[node] += 1
        if name == "a":
            link = True
            continue
        if name in VOID:
            run += name in ("br", "hr")
            continue
        if name in INLINE:
            continue
        if name in RAW:
            end = _RAW_END[name].search(source, at)
            at = end.end() if end else n
            continue
        # implied ends
        if "p" in (page.tag[i] for i in stack[1:]):
            for i in range(len(stack) - 1, 0, -1):
                if page.tag[stack[i]] == "p":
                    close(i)
                    break
                if page.tag[stack[i]] in _BOUNDARY:
                    break
        if name in CLOSES:
            ends, stops = CLOSES[name]
            cut = None
            for i in range(len(stack) - 1, 0, -1):
                if page.tag[stack[i]] in ends:
                    cut = i
                elif page.tag[stack[i]] in stops:
                    break
            if cut is not None:
                close(cut)
        if name in ("html", "body") and name in (page.tag[i] for i in stack):
            continue
        top = stack[-1]
        g = _groups(attrs) if attrs else 0
        if name in _ELEMENT_GROUP:
            g |= _BIT[_ELEMENT_GROUP[name]]
        if name in ("html", "body"):
            g &= _BIT["hidden"]
        page.parent.append(top)
        page.tag.append(name)
        page.groups.append(g)
        page.above.append(page.above[top] | page.groups[top])
        page.depth.append(page.depth[top] + 1)
        page.unseen.append(page.unseen[top] or name in UNSEEN)
        page.tags.append(0)
        page.controls.append(0)
        run += 1
        if not attrs.endswith("/") or name in _KIND:
            stack.append(len(page.parent) - 1)
    return page


N_BASE = 24
N_FEATURES = N_BASE + len(KINDS) + 2 * len(GROUPS)
_KIND_AT = {k: i for i, k in enumerate(KINDS)}


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all blocks, and the characters of text of their own."""
    n = len(page.parent)
    parent = np.array(page.parent)
    own, links, marks, words, blocks = (np.zeros(n) for _ in range(5))
    first = np.zeros(n)
    seen, last = 0, -1
    before = np.zeros(n)
    known = np.zeros(n, bool)
    for node, run, text, link in page.texts:
        if page.unseen[node]:
            continue
        k = len(text.split())
        if not k:
            continue
        size = len(text.strip())
        if not known[node]:
            known[node], first[node] = True, seen
        own[node] += size
        words[node] += k
        marks[node] += len(_MARKS.findall(text))
        if link:
            links[node] += size
        if run != last:
            blocks[node] += 1
            last = run
        seen += size
    p = np.array([t == "p" for t in page.tag], float)
    li = np.array([t in ("li", "td", "dd") for t in page.tag], float)
    head = np.array([_KIND.get(t) == "heading" for t in page.tag], float)
    sums = np.stack([own, links, marks, words, blocks, np.array(page.tags, float) + 1, np.array(page.controls, float), p, li, head], 1)
    start = np.where(known, first, np.inf)
    for i in range(n - 1, 0, -1):                       # children come after their parents
        sums[parent[i]] += sums[i]
        start[parent[i]] = min(start[parent[i]], start[i])
    start = np.where(np.isinf(start), seen, start)
    chars, link, mark, word, block, tags, ctrl, ps, lis, heads = sums.T
    total = max(1.0, seen)
    lchars = np.log1p(chars)
    # siblings
    count, index = np.zeros(n), np.zeros(n)
    total_l, prev, nxt = np.zeros(n), np.zeros(n), np.zeros(n)
    last_kid: dict[int, int] = {}
    for i in range(1, n):
        q = parent[i]
        index[i] = count[q]
        count[q] += 1
        total_l[q] += lchars[i]
        if q in last_kid:
            prev[i] = lchars[last_kid[q]]
            nxt[last_kid[q]] = lchars[i]
        last_kid[q] = i
    q = np.maximum(parent, 0)
    siblings = np.maximum(count[q], 1)
    safe = np.maximum(chars, 1)
    base = np.stack([
        lchars, np.log1p(own), link / safe, chars / tags, np.array(page.depth, float), start / total,
        1 - np.minimum(1, (start + chars) / total), chars / total, np.log1p(ps), np.log1p(lis), np.log1p(ctrl),
        mark / safe, word / np.maximum(block, 1), siblings, index / siblings, total_l[q] / siblings, prev, nxt,
        link[q] / np.maximum(chars[q], 1), chars / np.maximum(chars[q], 1), np.log1p(heads), np.log1p(block),
        np.log1p(tags), np.log1p(chars[q])], 1)
    kinds = np.zeros((n, len(KINDS)))
    kinds[np.arange(n), [_KIND_AT[_KIND.get(t, "other")] for t in page.tag]] = 1
    bits = np.arange(len(GROUPS))
    mine = (np.array(page.groups)[:, None] >> bits) & 1
    above = (np.array(page.above)[:, None] >> bits) & 1
    return np.hstack([base, kinds, mine, above]), own


#: Evidence that it takes to part two neighbouring blocks of running text.
PARTING = 12.0
_RUNNING = frozenset(("p", "heading", "list", "quote", "pre", "table"))


def decode(page: Page, log_odds: np.ndarray, own: np.ndarray, chars: np.ndarray) -> list[bool]:
    """Best labelling in which kept blocks have kept parents.

    A block counts by its evidence times the weight of its text; a dropped
    block drops its whole subtree; neighbouring siblings of running text
    without attribute tokens are parted at a cost."""
    n = len(page.parent)
    weight = np.sqrt(1 + own) + 0.5
    lo = np.clip(log_odds, -12, 12)
    keep = (-np.logaddexp(0, -lo) * weight).tolist()    # log p and log (1-p)
    drop = (-np.logaddexp(0, lo) * weight).tolist()     # of the whole subtree
    running = [_KIND.get(t) in _RUNNING and not g for t, g in zip(page.tag, page.groups)]
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        if chars[i] and not page.unseen[i]:             # no text: says nothing
            kids[page.parent[i]].append(i)
    choice: list[list[tuple[bool, bool]]] = [[] for _ in range(n)]
    end: list[bool] = [True] * n
    for q in range(n - 1, -1, -1):
        best_keep = best_drop = 0.0
        before = -1
        for i in kids[q]:
            drop[q] += drop[i]
            part = PARTING if before >= 0 and running[i] and running[before] else 0.0
            stay_k, stay_d = best_keep >= best_drop - part, best_drop >= best_keep - part
            if before < 0:
                stay_k = stay_d = True
            choice[q].append((stay_k, not stay_d))      # was the one before kept?
            best_keep, best_drop = (keep[i] + max(best_keep, best_drop - part), drop[i] + max(best_drop, best_keep - part))
            before = i
        if kids[q]:
            end[q] = best_keep >= best_drop
            keep[q] += max(best_keep, best_drop)
    kept = [False] * n
    kept[0] = True
    for q in range(n):
        if kept[q]:
            label = end[q]
            for i, (if_kept, if_dropped) in zip(reversed(kids[q]), reversed(choice[q])):
                kept[i] = label
                label = if_kept if label else if_dropped
    return kept


def text_of(page: Page, kept: list[bool]) -> str:
    """Text of the kept blocks: white space within a run becomes one space,
    runs are joined by one."""
    runs: list[str] = []
    last, parts = None, []
    for node, run, text, _ in page.texts:
        if not kept[node]:
            continue
        if run != last:
            runs.append("".join(parts))
            last, parts = run, []
        parts.append(text)
    runs.append("".join(parts))
    return " ".join(" ".join(runs).split())


def subtree_chars(page: Page, own: np.ndarray) -> np.ndarray:
    out = own.copy()
    for i in range(len(out) - 1, 0, -1):
        out[page.parent[i]] += out[i]
    return out


# --- training pages ---------------------------------------------------------

def _marked(source: str) -> tuple[Page, list[bool]] | None:
    """A page and which blocks hold main text, if it marks one article (or
    main) element."""
    page = parse(source)
    for name in ("article", "main"):
        found = [i for i, t in enumerate(page.tag) if t == name]
        if len(found) == 1:
            break
    else:
        return None
    inside = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        inside[i] = i == found[0] or inside[page.parent[i]]
    # within the article, elements that say that they are something else
    side = sum(_BIT[g] for g in GROUPS if g not in ("content", "byline", "header"))
    for i in range(1, len(page.tag)):
        inside[i] = inside[i] and not page.groups[i] & side and (i == found[0] or inside[page.parent[i]])
    return page, inside


def labels_of(page: Page, inside: list[bool], own: np.ndarray) -> np.ndarray:
    """1 where a subtree holds main text, 0 where it holds other text only."""
    main = np.where(inside, own, 0.0)
    return (subtree_chars(page, main) > 0).astype(float)


def _blocks(page: Page, inside: list[bool]) -> list[tuple[str, str]]:
    """(element, text) of the main blocks."""
    runs: dict[tuple[int, int], str] = {}
    for node, run, text, _ in page.texts:
        if inside[node]:
            runs[node, run] = runs.get((node, run), "") + text
    return [(page.tag[node], " ".join(t.split())) for (node, _), t in runs.items() if t.strip()]


_MAIN_MARK = "data-main"


def dress(blocks: list[tuple[str, str]], pool: list[str], rng: random.Random) -> str:
    """The blocks in another layout, with other parts around and within. The
    main blocks carry an attribute that only the labelling reads."""
    esc = html_lib.escape

    def words(lo: int, hi: int) -> str:
        t = rng.choice(pool).split()
        k = rng.randint(lo, hi)
        i = rng.randrange(max(1, len(t) - k + 1))
        return esc(" ".join(t[i:i + k]) or "x")

    def sentence() -> str:
        return words(6, 60) + rng.choice([".", ".", "!", "", "?"])

    def attr(*names: str, share: float = 0.85) -> str:
        if rng.random() > share:
            return ""
        name = rng.choice(names)
        name = rng.choice([name, name, f"site-{name}", f"{name}-box", f"{name}-wrapper", f"c-{name}", f"{name}_1"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def links(lo: int, hi: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.randint(lo, hi)))

    def menu() -> str:
        items = links(3, 9)
        return rng.choice([f"<nav><ul>{items}</ul></nav>", f'<div{attr("menu", "nav", "navbar", "breadcrumb")}><ul>{items}</ul></div>',
                           f'<ul{attr("nav", "menu", "pagination")}>{items}</ul>', f'<div role="navigation">{items}</div>',
                           f'<div{attr("nav", "topnav", "menu")}>' + " | ".join(f'<a href="#">{words(1, 2)}</a>' for _ in range(5)) + "</div>"])

    def header() -> str:
        inner = rng.choice([f'<a href="/">{words(1, 3)}</a><p>{words(2, 8)}</p>', f"<h1>{words(1, 4)}</h1>", f"<div>{words(1, 4)}</div><p>{sentence()}</p>"])
        return rng.choice([f"<header>{inner}{menu() if rng.random() < .5 else ''}</header>", f'<div{attr("header", "masthead", "banner", "topbar")}>{inner}</div>'])

    def footer() -> str:
        inner = rng.choice([f"&copy; {words(1, 3)} &middot; {sentence()}", f"<p>{sentence()}</p><ul>{links(2, 6)}</ul>", f"<small>{words(2, 12)}</small>", f"<p>{sentence()}</p>"])
        return rng.choice([f"<footer>{inner}</footer>", f'<div{attr("footer", "colophon", "copyright", "bottom")}>{inner}</div>'])

    def advert() -> str:
        inner = rng.choice([sentence(), f"<p>{sentence()}</p>", f'<a href="/x">{words(2, 10)}</a>', f"<h4>{words(1, 4)}</h4><p>{sentence()}</p>"])
        return f'<{(e := rng.choice(["div", "div", "section", "aside"]))}{attr("ad", "ads", "advert", "sponsored", "promo", share=1)}>{inner}</{e}>'

    def notice() -> str:
        inner = f"<p>{sentence()}</p>" + rng.choice(["", f"<button>{words(1, 2)}</button>", f'<a href="#">{words(1, 2)}</a>'])
        return rng.choice([f'<div{attr("cookie", "consent", "notice", "alert", "popup", "modal", share=1)}>{inner}</div>', f'<div role="alert">{inner}</div>',
                           f'<p{attr("notice", "cookie", "warning", share=1)}>{sentence()}</p>', f"<dialog open>{inner}</dialog>"])

    def form() -> str:
        inner = f'<label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button>'
        return rng.choice([f"<form>{inner}</form>", f"<form><p>{sentence()}</p>{inner}</form>",
                           f'<div{attr("newsletter", "subscribe", "search", "signup", "login", share=1)}><h3>{words(1, 4)}</h3><p>{sentence()}</p><form>{inner}</form></div>'])

    def comments() -> str:
        each = [f"<p>{sentence()}</p>" * 1 for _ in range(rng.randint(1, 6))]
        body = rng.choice(["".join(f'<div class="comment"><b>{words(1, 2)}</b>{c}</div>' for c in each),
                           "<ol>" + "".join(f"<li>{c}</li>" for c in each) + "</ol>", "".join(each)])
        return rng.choice([f'<div{attr("comments", "responses", "discussion", "replies", share=1)}><h3>{words(1, 3)}</h3>{body}</div>',
                           f'<section{attr("comments", "comment-list", "feedback", share=1)}>{body}</section>'])

    def side() -> str:
        inner = rng.choice([f"<h3>{words(1, 3)}</h3><ul>{links(2, 7)}</ul>", f"<h3>{words(1, 3)}</h3><p>{sentence()}</p>", f"<p>{sentence()}</p><p>{sentence()}</p>", advert()])
        return rng.choice([f"<aside>{inner}</aside>", f'<div{attr("sidebar", "widget", "side", "rail", share=1)}>{inner}</div>'])

    def related() -> str:
        return rng.choice([f'<div{attr("related", "recommended", "share", "social", "popular", share=1)}><h3>{words(1, 3)}</h3><ul>{links(2, 6)}</ul></div>',
                           f'<div{attr("share", "social", share=1)}>' + " ".join(f'<a href="#">{words(1, 2)}</a>' for _ in range(3)) + "</div>"])

    mark = f" {_MAIN_MARK}"
    body: list[str] = []
    for tag, text in blocks:
        t = esc(text)
        heading = tag in ("h1", "h2", "h3") or len(text) < 40
        if rng.random() < .1:
            t = t.replace(" ", ' <a href="/l">', 1) + "</a>"
        if heading:
            body.append(rng.choice([f"<h1{mark}>{t}</h1>", f"<h2{mark}>{t}</h2>", f"<h2{mark}>{t}</h2>"]))
        else:
            body.append(rng.choice([f"<p{mark}>{t}</p>"] * 8 + [
                f"<p{mark}>{t}", f"<ul><li{mark}>{t}</li></ul>", f"<blockquote{mark}>{t}</blockquote>", f"<div{mark}>{t}</div>",
                f"<pre{mark}>{t}</pre>", f"<table><tr><td{mark}>{t}</td></tr></table>", f"<section><p{mark}>{t}</p></section>"]))
        if rng.random() < .06:
            body.append(rng.choice([advert, side, related, form, notice])())
    if rng.random() < .3:                               # a run of short lines, as verses and lists have
        line = f"<p{mark}>{words(1, 4)}</p>"
        at = rng.choice([len(body), len(body), rng.randint(1, len(body))])
        body[at:at] = [line if rng.random() < .7 else f"<p{mark}>{words(1, 5)}</p>" for _ in range(rng.randint(2, 9))]
    inner = "".join(body)
    if rng.random() < .25:
        inner = f"<header><h1{mark}>{esc(blocks[0][1])}</h1></header>" + "".join(body[1:]) if len(body) > 1 else inner
    if rng.random() < .2:
        inner += rng.choice([comments, related, form])()
    wrapped = rng.choice([f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
                          f'<div{attr("content", "post", "article", "entry", "story", "main", share=1)}>{inner}</div>',
                          f'<div{attr("content", "post", "article", "entry")}>{inner}</div>', f"<section>{inner}</section>",
                          f"<div>{inner}</div>", f'<div role="main">{inner}</div>', inner])
    top = [f() for f in rng.sample([menu, header, notice, advert, form, header, menu], rng.randint(1, 4))]
    end = [f() for f in rng.sample([comments, related, side, footer, notice, advert, form, comments, menu], rng.randint(1, 4))] + [footer()]
    mid = [f() for f in rng.sample([side, advert, related, menu], rng.randint(0, 2))]
    parts = mid + [wrapped] if rng.random() < .5 else [wrapped] + mid
    core = "".join(parts)
    for _ in range(rng.randint(0, 3)):
        core = f'<div{attr("container", "wrapper", "page", "row", "layout", "content", "main")}>{core}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title></head><body>{''.join(top)}{core}{''.join(end)}</body></html>"


def _dressed(source: str) -> tuple[Page, list[bool]]:
    """The page of a dressed source, and its marked blocks."""
    marked: list[bool] = [False]
    plain = parse(source.replace(f" {_MAIN_MARK}", ""))
    with_marks = parse(source.replace(f" {_MAIN_MARK}", ' role="mainmark"'))
    marked = [False] * len(plain.tag)
    # the same elements in the same order; a mark is found again by its role
    order = [m.group(0) for m in re.finditer(r"<([a-z][a-z0-9]*)([^>]*)>", source) if m[1] not in INLINE | VOID | RAW]
    at = 0
    for i in range(1, len(plain.tag)):
        while at < len(order) and not re.match(rf"<{plain.tag[i]}[\s>]", order[at]):
            at += 1
        marked[i] = at < len(order) and _MAIN_MARK in order[at]
        at += 1
    assert len(with_marks.tag) == len(plain.tag)
    return plain, marked


def train(sources: list[str], seed: int = 11) -> gbt.BoostedTrees | None:
    """Boosted trees from pages that mark their main element."""
    known = [m for m in map(_marked, sources) if m is not None]
    known = [(p, i, b) for p, i in known if (b := _blocks(p, i))]
    if not known:
        return None
    pool = [t for _, _, blocks in known for _, t in blocks if len(t.split()) > 4] or ["some words of a page that says nothing"]
    rng = random.Random(seed)
    xs, ys, ws = [], [], []

    def learn(page: Page, inside: list[bool], weight: float = 1.0) -> None:
        x, own = features(page)
        chars = subtree_chars(page, own)
        use = np.flatnonzero((chars > 0) & ~np.array(page.unseen))
        use = use[use > 0]
        xs.append(x[use])
        ys.append(labels_of(page, inside, own)[use])
        ws.append(np.full(len(use), weight / np.sqrt(max(1, len(use)))))

    for page, inside, blocks in known:
        learn(page, inside, DRESSINGS)
        for _ in range(DRESSINGS):
            some = blocks if rng.random() < .6 else blocks[:rng.randint(1, 4)]
            learn(*_dressed(dress(some, pool, rng)))
    x, y, w = np.concatenate(xs), np.concatenate(ys), np.concatenate(ws)
    if y.min() == y.max():
        return None
    return gbt.fit(x, y, w * len(w) / w.sum())


_PLAIN_SIDE = sum(_BIT[g] for g in GROUPS if g not in ("content", "byline"))


def extract(source: str | None, model: gbt.BoostedTrees | None) -> str:
    """Main text of one page."""
    return extract_all([source], model)[0]


def extract_all(sources: list[str | None], model: gbt.BoostedTrees | None) -> list[str]:
    pages = [parse(s) if s else None for s in sources]
    made = [features(p) if p else None for p in pages]
    if model is None:
        odds = iter([np.where([(g | a) & _PLAIN_SIDE for g, a in zip(p.groups, p.above)], -5.0, 5.0) for p in pages if p])
    else:
        rows = [x for m in made if m for x in (m[0],)]
        every = model.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
        odds = iter(np.split(every, np.cumsum([len(r) for r in rows])[:-1]) if rows else [])
    out = []
    for page, m in zip(pages, made):
        if page is None:
            out.append("")
            continue
        lo, own = next(odds), m[1]
        out.append(text_of(page, decode(page, lo, own, subtree_chars(page, own))))
    return out


def fit_pages(pages: DataFrame) -> gbt.BoostedTrees | None:
    """The model, from a bounded sample of ``pages``."""
    marks = F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.octet_length("html") <= FIT_BYTES)
    known = pages.select("page_id", "html").where(marks).withColumn("key", F.xxhash64("page_id", "html"))
    # numbers are ranked; then the chosen pages alone are fetched
    by = [F.xxhash64("page_id"), F.col("page_id"), F.col("key")]
    keys = [r["key"] for r in known.select("page_id", "key").distinct().orderBy(*by).limit(FIT_PAGES).collect()]
    chosen = known.where(F.col("key").isin(keys)).groupBy("key").agg(F.first("html").alias("html")).collect() if keys else []
    html = {r["key"]: r["html"] for r in chosen}
    return train([html[k] for k in keys if k in html])


def main_texts(pages: DataFrame, model: gbt.BoostedTrees | None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            texts = extract_all(b.column(2).to_pylist(), shared.value)
            yield [b.column(0), b.column(1), texts, [len(t) for t in texts]]

    return map_batches(pages.select(F.col("page_id").cast("long"), "url", "html"),
                       "page_id long, url string, text string, n_chars long", run)
