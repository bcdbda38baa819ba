"""Main text of web pages by composite text density.

Every DOM node gets its link-adjusted characters per tag; a node's density sum is that of its children. The node of
the largest sum is content; the least density on its path to the body is the threshold that other subtrees must reach,
each of which then gives its own largest-sum node. What all these have in common below the body, or
the article around it, is the main text. Without an article, headings, paragraphs and plain lists that stand beside it or beside one of
its ancestors are part of it, however short. Parts that say they are something else (menus, adverts, forms, comments ...)
by tag, role, class or id are taken out first and belong to no text. Tag and role decide alone, but a form or fieldset around most of a
page's text stays, and a label goes only with a control. A class or id does not
where it names a topic (ids of headings, names in an article), states a layout (no-, has-, with-), or where its node
holds most of a page without an article, at a density that reaches the threshold.

Null and empty pages, and pages without text, give the empty text. Broken markup is closed as browsers do, a tag cut
off at the end is dropped. Pages are independent: repeated rows repeat, ties go to the first node in page order, an
empty table stays empty. Columns named like an output are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from studylake.llm.common import append

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr "
    "ul title".split()
)
#: Elements whose start ends an open one of the second kind, unless one of the third lies between.
CLOSES = {
    **{tag: (frozenset({"p"}), frozenset({"table", "button"})) for tag in BLOCK - {"body", "html", "head", "tr", "tbody", "thead", "tfoot"}},
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Tags and roles that are never main text, and words of class or id that say so.
DROP_TAGS = frozenset(
    "head script style noscript template nav aside footer button select textarea iframe object svg canvas audio video "
    "dialog menu map input".split()
)
FORMS = frozenset({"form", "fieldset"})
CONTROLS = frozenset("input select textarea button".split())
#: Characters outside links for each control from which a form around most of the text is a page in a form.
FORM_TEXT = 80
#: Elements that, beside the main text, are part of it; those of the second kind only without links.
BESIDE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
BESIDE_PLAIN = frozenset("ul ol dl".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent gdpr notice popup modal overlay newsletter "
    "subscribe subscription paywall signup login share sharing social related recommended recommendations teaser widget "
    "comment comments disqus respond replies reply pagination pager skip toolbar".split()
)
#: Of these, the ones that hold for an article too.
DROP_ARTICLES = frozenset("ad ads advert advertisement sponsored promo related recommended teaser comment comments reply".split())
#: Words that, with those above, make a name that is no topic; words after which a name states the layout.
NEUTRAL_WORDS = frozenset(
    "section list area container box wrapper wrap block bar form content main inner outer the of and article articles post posts page site "
    "body link links slot item items card text title header head left right top bottom module unit group row col column panel feed "
    "thread user users button buttons icon icons label msg message js css wp id div".split()
)
LAYOUT_WORDS = frozenset("no not has have with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Page(HTMLParser):
    """The nodes of a page, parents before children, and its text pieces in order (None where a block starts or ends)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.attrs = ["#root"], [-1], [{}]
        self.pieces: list[tuple[int, str] | None] = []
        self.stack = [0]
        self.open: Counter[str] = Counter()
        self.feed(html)
        if self.rawdata.lstrip()[:1] == "<":
            self.rawdata = ""
        self.close()

    def _pop(self, kinds: frozenset[str], until: frozenset[str] = frozenset()) -> None:
        """End the innermost open node of ``kinds``, and all in it, unless one of ``until`` comes first."""
        if not any(self.open[k] for k in kinds):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[at]]
            if tag in kinds:
                break
            if tag in until:
                return
        else:
            return
        for node in self.stack[at:]:
            self.open[self.tags[node]] -= 1
            if self.tags[node] in BLOCK:
                self.pieces.append(None)
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES:
            self._pop(*CLOSES[tag])
        if tag == "body" and self.open["head"]:
            self._pop(frozenset({"head"}))
        if tag in BLOCK:
            self.pieces.append(None)
        elif tag in ("br", "td", "th"):
            self.pieces.append((self.stack[-1], " "))
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.attrs.append({k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "style", "for")})
        if tag not in VOID:
            self.stack.append(len(self.tags) - 1)
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._pop(frozenset({tag}))

    def handle_data(self, data: str) -> None:
        self.pieces.append((self.stack[-1], data))


def _says(name: str) -> set[str]:
    """The words of a class name or id, less those that a layout modifier stands before."""
    words = [w.lower() for w in _WORD.findall(name)]
    return {w for before, w in zip(["", *words], words) if before not in LAYOUT_WORDS}


def _topic(words: set[str]) -> bool:
    """Whether a name says what its text is about."""
    return any(w not in DROP_WORDS and w not in NEUTRAL_WORDS and len(w) > 1 and not w.isdigit() for w in words)


def _names(tag: str, attrs: dict[str, str], in_article: bool, listing: bool) -> set[str]:
    """The words by which a node may be taken out; ``listing``: its text is mostly links."""
    names = attrs.get("class", "").split()
    if not (tag in HEADINGS or in_article and tag == "p"):  # there, an id is an anchor, made of the text
        names += attrs.get("id", "").split()
    said = [_says(name) for name in names]
    return set().union(*(words for words in said if not in_article or listing or not _topic(words)))


def _plain(page: Page, gone: list[bool]) -> tuple[list[int], list[int]]:
    """Characters of each node, and those outside links."""
    n = len(page.tags)
    linked, chars, plain = [False] * n, [0] * n, [0] * n
    for i in range(1, n):
        linked[i] = page.tags[i] == "a" or linked[page.parents[i]]
    for piece in page.pieces:
        if piece and not gone[piece[0]]:
            size = len("".join(piece[1].split()))
            chars[piece[0]] += size
            plain[piece[0]] += size * (not linked[piece[0]])
    for i in range(n - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
        plain[page.parents[i]] += plain[i]
    return chars, plain


def dropped(page: Page) -> list[bool]:
    """Whether each node is, or lies in, something that is not main text by its own word."""
    n = len(page.tags)
    holds = [False] * n  # an article or main element inside
    for i in range(n - 1, 0, -1):
        if page.tags[i] in ("article", "main") or holds[i]:
            holds[page.parents[i]] = True
    hard, in_article, controls, beside = [False] * n, [False] * n, [0] * n, [False] * n
    for i in range(n - 1, 0, -1):
        beside[page.parents[i]] |= page.tags[i] in CONTROLS
        controls[i] += page.tags[i] in CONTROLS
        controls[page.parents[i]] += controls[i]
    for i in range(1, n):
        tag, attrs, up = page.tags[i], page.attrs[i], page.parents[i]
        in_article[i] = in_article[up] or tag in ("article", "main")
        hard[i] = hard[up] or tag in DROP_TAGS or tag == "header" and not in_article[i]
        hard[i] |= tag == "label" and ("for" in attrs or controls[i] > 0 or beside[up])
        if not hard[i] and attrs:
            hard[i] = attrs.get("role", "").lower() in DROP_ROLES or "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    if not FORMS.isdisjoint(page.tags):
        _, plain = _plain(page, hard)
        for i in range(1, n):
            whole = holds[i] or 2 * plain[i] > plain[0] and plain[i] >= FORM_TEXT * controls[i]
            hard[i] = hard[i] or hard[page.parents[i]] or page.tags[i] in FORMS and not whole
    chars, plain = _plain(page, hard)
    named: dict[int, set[str]] = {}
    for i in range(1, n):
        tag, attrs = page.tags[i], page.attrs[i]
        if not hard[i] and attrs and not holds[i] and tag not in ("html", "body", "main"):
            words = _names(tag, attrs, in_article[page.parents[i]], 2 * plain[i] < chars[i])
            words &= DROP_ARTICLES if tag == "article" else DROP_WORDS
            if words:
                named[i] = words
    articles = any(tag in ("article", "main") and chars[i] and not hard[i] and i not in named for i, tag in enumerate(page.tags))
    if not articles and any(2 * plain[i] > plain[0] for i in named):
        density, _, threshold = _path(page, hard)
        for i in [i for i in named if 2 * plain[i] > plain[0] and density[i] >= threshold]:
            # Adverts and comments may be longer than the text: they are the text only of a page that has no other.
            if not named[i] & DROP_ARTICLES or plain[i] == plain[0]:
                del named[i]
    out = [False] * n
    for i in range(1, n):
        out[i] = hard[i] or out[page.parents[i]] or i in named
    return out


def densities(page: Page, gone: list[bool]) -> tuple[list[float], list[float]]:
    """Composite text density of each node, and the sum over its children (a leaf's sum is its own)."""
    n = len(page.tags)
    chars, tags, link_chars, link_tags = ([0] * n for _ in range(4))
    linked = [False] * n
    for i in range(1, n):
        linked[i] = page.tags[i] == "a" or linked[page.parents[i]]
    for piece in page.pieces:
        if piece and not gone[piece[0]]:
            size = len("".join(piece[1].split()))
            chars[piece[0]] += size
            link_chars[piece[0]] += size * linked[piece[0]]
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            up = page.parents[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (page.tags[i] == "a")
    share = link_chars[0] / max(1, chars[0])
    density, total, children = [0.0] * n, [0.0] * n, [0] * n
    for i in range(n):
        if chars[i] and not gone[i]:
            c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], link_tags[i]
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[i] = c / t * math.log(c / max(1, lc) * t / max(1, lt)) / max(1.0, math.log(base))
            if i:
                total[page.parents[i]] += density[i]
                children[page.parents[i]] += 1
    return density, [s if k else d for s, k, d in zip(total, children, density)]


def _path(page: Page, gone: list[bool]) -> tuple[list[float], list[int], float]:
    """Densities, the node of the largest sum in each subtree, and the least density from the page's one to the body."""
    n = len(page.tags)
    density, total = densities(page, gone)
    body = _body(page)
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        if not gone[i] and (total[best[i]], -best[i]) > (total[best[up]], -best[up]):
            best[up] = best[i]
    threshold, at = density[best[0]], best[0]
    while at > 0:
        threshold = min(threshold, density[at])
        at = page.parents[at] if at != body else -1
    return density, best, threshold


def _body(page: Page) -> int:
    return page.tags.index("body") if "body" in page.tags else 0


def _beside(page: Page, gone: list[bool], roots: set[int], body: int) -> set[int]:
    """Headings, paragraphs and lists beside the ``roots`` or beside one of their ancestors, up to the body.

    A heading stays out where the text has one of its own of the same rank or above.
    """
    n = len(page.tags)
    chars, plain = _plain(page, gone)
    inside, parents = [False] * n, set()
    for i in range(1, n):
        inside[i] = inside[page.parents[i]] or i in roots
    ranks = [int(page.tags[i][1]) for i in range(1, n) if inside[i] and page.tags[i] in HEADINGS and chars[i]]
    for at in roots:
        while at > body:
            at = page.parents[at]
            parents.add(at)
    out = set()
    for i in range(1, n):
        tag = page.tags[i]
        if page.parents[i] in parents and not inside[i] and not gone[i] and chars[i]:
            if tag in HEADINGS:
                ok = int(tag[1]) < min(ranks, default=7) and 2 * plain[i] > chars[i]
            else:
                ok = tag in BESIDE and 2 * plain[i] > chars[i] or tag in BESIDE_PLAIN and plain[i] == chars[i]
            if ok:
                out.add(i)
    return out


def content_of(page: Page, gone: list[bool]) -> list[bool]:
    """Whether each node is main text."""
    n, body = len(page.tags), _body(page)
    density, best, threshold = _path(page, gone)
    top = best[0]
    marked = {top} | {best[i] for i in range(body + 1, n) if not gone[i] and density[i] >= threshold > 0}
    # What the marked nodes have in common.
    inside = [0] * n
    for i in marked:
        inside[i] = 1
    for i in range(n - 1, 0, -1):
        inside[page.parents[i]] += inside[i]
    root = max(i for i in range(n) if inside[i] == len(marked))
    around, at = root, root
    while at > 0:
        if page.tags[at] in ("article", "main") and page.tags[around] != "article":
            around = at
        at = page.parents[at]
    roots = {around} if around > body else marked
    if around <= body:  # nothing but the body holds all: the articles of the marked nodes, or these themselves
        roots = set()
        for i in marked:
            at = i
            while at > body and page.tags[at] not in ("article", "main"):
                at = page.parents[at]
            roots.add(at if at > body else i)
    if not any(page.tags[i] in ("article", "main") for i in roots):
        roots |= _beside(page, gone, roots, body)
    out = [False] * n
    for i in range(n):
        out[i] = not gone[i] and (i in roots or i > 0 and out[page.parents[i]])
    return out


def extract(html: str | None) -> str:
    """The blocks of the main text, white space made single spaces, joined by a line feed."""
    if not html:
        return ""
    page = Page(html)
    gone = dropped(page)
    if not any(p and not gone[p[0]] and p[1].strip() for p in page.pieces):
        return ""
    content = content_of(page, gone)
    blocks, parts = [], []
    for piece in [*page.pieces, None]:
        if piece is None:
            if words := "".join(parts).split():
                blocks.append(" ".join(words))
            parts = []
        elif content[piece[0]]:
            parts.append(piece[1])
    return "\n".join(blocks)


def main_text(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` without its pages' source, with ``text``, the main text."""

    def make():
        return lambda batch: [[extract(v) for v in batch.column(html).to_pylist()]]

    return append(df, "text string", make, drop=(html,))
