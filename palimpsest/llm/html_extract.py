"""Main-text extraction by equivalence-class template deduction.

The pages of a host share a template. Tokens are containers, named by the containers above them, and block texts with
their container. For every host the tokens' occurrence vectors over its pages are compared by a commutative digest, so
that tokens with equal vectors form an equivalence class without any page leaving its partition. Classes that are
large and frequent enough are valid; their containers that stand once on a page are the template's skeleton, nested by
their parents. What lies between is a slot: text that varies from body to body. From the slots' masses, the share of
links in them, their headings and the kinds of elements around them, ``choose`` takes those that hold the article, and
the deepest skeleton node above them is the host's article node. A page's main text is what it has there, without
constant texts of the template, slots that were turned down, and boilerplate elements. A page that its host's template
does not fit, or whose host has no other page, is its own template.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, small_batches, whole_text

#: A class is valid on at least this share of a host's pages, and on two pages.
SUPPORT = 0.5
#: A text is the template's on at least this share of a host's distinct bodies, and on two.
CONSTANT = 0.9
#: A slot without a heading is the article's from this share of the largest slot's text on.
SHARE = 0.1
#: A slot with a larger share of its text in links is a menu.
LINKS = 0.5
#: Templates of so many hosts with so many constant texts in all are small: some 20 MB.
SMALL_HOSTS, SMALL_CONSTANTS = 50_000, 500_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|template|textarea|iframe|select|button)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)

# HTML's element kinds.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark output q s samp small span "
    "strike strong sub sup time tt u var wbr "
    # Formulas and drawings stand in a line of text, with all their parts.
    "math annotation maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt "
    "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics "
    "svg circle defs desc ellipse g line lineargradient path polygon polyline rect stop symbol text textpath title tspan use".split()
)
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 dt dd pre br hr td th caption figcaption summary legend address".split())
_HEADING = frozenset("h1 h2 h3".split())
_BOILER = frozenset("head nav header footer aside menu dialog".split())
_ARTICLE = frozenset("article main".split())
# Roles of elements that are no part of an article.
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())
# Words in class and id names outside the article that mark adverts, menus, notices and comments.
_MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner popup modal nav "
    "navbar navigation menu breadcrumb breadcrumbs masthead topbar header footer sidebar aside widget comment comments "
    "disqus notice notices cookie cookies consent gdpr newsletter subscribe subscription share sharing pagination pager "
    "toolbar copyright signup login".split()
)
# Whole class and id names of reader comments, and of adverts and notices inside a text.
_COMMENTS = frozenset(
    "comment comments comment-list comments-list comment-section comments-section reader-comments user-comments disqus replies respond".split()
)
_NAMED = _COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo popup modal cookie cookies consent gdpr newsletter subscribe "
    "subscription share-buttons social-links pagination pager breadcrumb breadcrumbs signup login".split()
)
_NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

#: Flags of a container: no article text ever; a marked name; a name that counts inside an article too; an article; the
#: page or its body; a form, which is the page's container if most of the text is in it.
OFF, MARKED, NAMED, ARTICLE, PAGE_WIDE, FORM = 1, 2, 4, 8, 16, 32


def _described(tag: str, attrs: str) -> tuple[str, int]:
    """(signature, flags) of an opening tag; runs of three digits or more in names are one sign."""
    flag = OFF * (tag in _BOILER) | ARTICLE * (tag in _ARTICLE) | PAGE_WIDE * (tag in ("html", "body")) | FORM * (tag == "form")
    if not attrs or attrs.isspace():
        return tag, flag
    names = []
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            flag |= OFF
        elif key == "role":
            flag |= OFF * (value.lower() in _ROLES) | ARTICLE * (value.lower() in _ARTICLE)
        elif key in ("class", "id"):
            names.append(f"{key}={re.sub('[0-9]{3,}', '#', value)}")
            if not flag & PAGE_WIDE:
                # An article element can be a reader's comment, but no advert.
                flag |= NAMED * any(x in (_COMMENTS if flag & ARTICLE else _NAMED) for x in value.lower().split())
            if not flag & (ARTICLE | PAGE_WIDE):
                flag |= MARKED * (tag != "section" and any(x.lower() in _MARKED for x in _NAME_PARTS.findall(value)))
    return " ".join([tag, *names]), flag


def _number(x: str, above: int = 0) -> int:
    """A 64-bit number for a token below another."""
    b = x.encode("utf-8", "surrogatepass")
    return (zlib.crc32(b, above & 0xFFFFFFFF) << 32 | zlib.crc32(b[::-1], above >> 32 & 0xFFFFFFFF)) - (1 << 63)


class Block(NamedTuple):
    text: str
    node: int
    #: Characters in links.
    links: int
    heading: bool


class Page:
    """A page's containers, each behind the one around it, and its blocks in page order.

    Container 0 is the page. token names a container by its signature and those around it; parent, depth and flag are
    what they say. Inline elements and leaf blocks are no containers; a closing tag closes up to its element, or
    nothing. White space in a block becomes one space, empty blocks go, character references are decoded. Time and
    memory are linear in the page at any depth.
    """

    def __init__(self, html: str):
        self.token, self.parent, self.depth, self.flag = [_number("")], [-1], [0], [PAGE_WIDE]
        self.blocks: list[Block] = []
        part: list[str] = []
        stack: list[tuple[str, int]] = []
        open_: dict[str, int] = {}
        node = links = 0
        in_link = heading = False
        for m in _TOKEN.finditer(html):
            if (text := m["text"]) is not None:
                part.append(text)
                links += len(text) * in_link
                continue
            if m["tag"] is None:
                continue
            tag = m["tag"].lower()
            if tag in _INLINE:
                in_link = (not m["close"]) if tag == "a" else in_link
                continue
            self._flush(part, node, links, heading)
            links, in_link, heading = 0, False, tag in _HEADING and not m["close"]
            if tag in _VOID or tag in _LEAF:
                continue
            if m["close"]:
                if open_.get(tag):
                    while True:
                        last = stack.pop()[0]
                        open_[last] -= 1
                        if last == tag:
                            break
            else:
                if tag in ("li", "tr") and stack and stack[-1][0] == tag:
                    stack.pop()
                    open_[tag] -= 1
                above = stack[-1][1] if stack else 0
                signature, flag = _described(tag, m["attrs"])
                self.token.append(_number(signature, self.token[above]))
                self.parent.append(above)
                self.depth.append(self.depth[above] + 1)
                self.flag.append(flag)
                if not m["attrs"].endswith("/"):
                    stack.append((tag, len(self.token) - 1))
                    open_[tag] = open_.get(tag, 0) + 1
            node = stack[-1][1] if stack else 0
        self._flush(part, node, links, heading)
        self._settle_forms()

    def masses(self) -> list[int]:
        """For each container the characters of the texts in it, at any depth, but for those in boilerplate elements."""
        mass = [0] * len(self.token)
        off = self.under(lambda i: bool(self.flag[i] & OFF))
        for b in self.blocks:
            mass[b.node] += len(b.text) * (not off[b.node])
        for i in range(len(mass) - 1, 0, -1):
            mass[self.parent[i]] += mass[i]
        return mass

    def under(self, test) -> list[bool]:
        """For each container whether the test holds for it or for one around it."""
        found = [test(0)]
        for i in range(1, len(self.token)):
            found.append(found[self.parent[i]] or test(i))
        return found

    def _settle_forms(self) -> None:
        """A form is boilerplate unless it holds more of the page's text than stands outside it."""
        forms = [i for i, f in enumerate(self.flag) if f & FORM]
        if forms:
            mass = self.masses()
            for i in forms:
                if 2 * mass[i] <= mass[0]:
                    self.flag[i] |= OFF

    def _flush(self, part: list[str], node: int, links: int, heading: bool) -> None:
        if part:
            text = " ".join(html_lib.unescape("".join(part)).split())
            part.clear()
            if text:
                self.blocks.append(Block(text, node, links, heading))

    def counts(self) -> dict[int, int]:
        """How often each token stands on the page."""
        found: dict[int, int] = {}
        for t in self.token:
            found[t] = found.get(t, 0) + 1
        return found

    def single(self) -> list[int]:
        """For each container the nearest one, from itself outwards, whose token stands once."""
        n, near = self.counts(), [0]
        for i in range(1, len(self.token)):
            near.append(i if n[self.token[i]] == 1 else near[self.parent[i]])
        return near

    def off(self) -> list[bool]:
        """For each container whether it is a boilerplate element or lies in one."""
        return self.under(lambda i: bool(self.flag[i] & OFF))

    def boiler(self) -> list[bool]:
        """For each container whether it is boilerplate by its element or its name, or lies in one that is."""
        article = self.under(lambda i: bool(self.flag[i] & ARTICLE))
        return self.under(lambda i: i > 0 and (bool(self.flag[i] & (OFF | NAMED)) or bool(self.flag[i] & MARKED) and not article[i]))

    def text_token(self, b: Block) -> int:
        return _number("\0" + b.text, self.token[b.node])


def host_of(url: str) -> str:
    """Lower-case host without user and port; "" if there is none."""
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url, re.IGNORECASE)
    return m[1].lower() if m else ""


class Node(NamedTuple):
    """A skeleton node; mass and links are the characters of its slot, 0 where it has none."""

    token: int
    parent: int
    depth: int
    flag: int
    mass: int
    links: int
    heading: bool


class Choice(NamedTuple):
    """article: the token of the article node. core: that of the slot with most text. semantic: whether only what is
    in article elements counts. rejected: slots that are no article text. spared: marked nodes that hold the core.
    doubtful: small slots that count where they stand among the article's other text."""

    article: int
    core: int
    semantic: bool
    rejected: list[int]
    spared: list[int]
    doubtful: list[int]


def _weightiest(slots: list[Node]) -> Node:
    return max(slots, key=lambda n: (n.mass, -n.depth, -n.token))


def choose(nodes: list[Node]) -> Choice | None:
    """The article's place in a skeleton; None if it has no slot outside boilerplate elements.

    The core is the slot with most text that is no menu, comment or advert. A marked name turns it down only for a slot
    of like mass, at least half, without one. Slots in article elements are the article's if the core is in one; else
    the core, headings, and all slots of some size or, if no heading tells where the article begins, of any size.
    """
    nodes = sorted(nodes, key=lambda n: (n.depth, n.token))
    by = {n.token: n for n in nodes}
    off, article, marked, named = {}, {}, {}, {}
    for n in nodes:
        p = n.parent
        off[n.token] = off.get(p, False) or bool(n.flag & OFF)
        article[n.token] = article.get(p, False) or bool(n.flag & ARTICLE)
        named[n.token] = named.get(p, False) or bool(n.flag & NAMED)
        marked[n.token] = marked.get(p, False) or bool(n.flag & NAMED) or bool(n.flag & MARKED) and not article[n.token]
    slots = [n for n in nodes if n.mass > 0 and not off[n.token]]
    menu = {n.token for n in slots if n.links > LINKS * n.mass and not article[n.token]}
    fit = [n for n in slots if n.token not in menu] or slots
    if not fit:
        return None
    semantic = any(article[n.token] and not named[n.token] for n in fit)
    if semantic:
        fit = [n for n in fit if article[n.token]]
    core = _weightiest([n for n in fit if not named[n.token]] or fit)
    if marked[core.token] and (plain := [n for n in fit if not marked[n.token] and 2 * n.mass >= core.mass]):
        core = _weightiest(plain)
    own = [n for n in fit if n.token == core.token or not marked[n.token]]
    headed = any(n.heading for n in own)
    content = {n.token for n in own if semantic or n.heading or not headed or n.mass >= SHARE * core.mass} | {core.token}
    # The deepest node that holds all of them: counts are summed from the bottom up.
    held = dict.fromkeys(by, 0)
    top = None
    for n in reversed(nodes):
        held[n.token] += n.token in content
        if held[n.token] == len(content):
            top = n
            break
        if n.parent in held:
            held[n.parent] += held[n.token]
    if top is None:
        return None
    under_core, under_top = {}, {}
    for n in nodes:
        under_core[n.token] = under_core.get(n.parent, False) or n.token == core.token
        under_top[n.token] = under_top.get(n.parent, False) or n.token == top.token
    wide = bool(top.flag & PAGE_WIDE)
    small = {n.token for n in own} - content
    out = [
        n.token for n in nodes
        if n.mass > 0 and n.token not in content and not under_core[n.token] and not (semantic and article[n.token])
        and (n.token in menu or wide or not under_top[n.token]) and n.token != top.token
    ]
    doubtful = [t for t in out if t in small and under_top[t]]
    spared, at = [], core.token
    while at in by and at != top.token:
        if by[at].flag & (MARKED | NAMED):
            spared.append(at)
        at = by[at].parent
    return Choice(top.token, core.token, semantic, [t for t in out if t not in doubtful], spared, doubtful)


def own_choice(page: Page, constants: frozenset[int]) -> Choice | None:
    """The article's place by the page alone: its containers that stand once are the skeleton."""
    near = page.single()
    # Texts of two words at least; without any, all texts; without these, the template's too.
    fits = [lambda b: " " in b.text and page.text_token(b) not in constants, lambda b: page.text_token(b) not in constants, lambda b: True]
    for fit in fits:
        mass: dict[int, list] = {}
        for b in filter(fit, page.blocks):
            own = mass.setdefault(near[b.node], [0, 0, False])
            own[0] += len(b.text)
            own[1] += b.links
            own[2] |= b.heading
        nodes = [
            Node(page.token[i], page.token[near[page.parent[i]]] if i else 0, page.depth[i], page.flag[i], *mass.get(i, (0, 0, False)))
            for i in range(len(page.token)) if near[i] == i
        ]
        if (found := choose(nodes)) is not None:
            return found
    return None


def _named_parts(page: Page, choice: Choice) -> list[bool]:
    """For each container whether it is a part that its name marks inside an article too: a name alone does not do. The
    name has to stand more than once on the page, on it or in it, or the part has less than half of the text."""
    flag, n = page.flag, len(page.token)
    if not any(f & NAMED for f in flag):
        return [False] * n
    mass, counts = page.masses(), page.counts()
    repeats = [bool(flag[i] & NAMED) and counts[page.token[i]] > 1 for i in range(n)]
    inner = list(repeats)
    for i in range(n - 1, 0, -1):
        inner[page.parent[i]] |= inner[i]
    article = max((mass[i] for i in range(n) if page.token[i] == choice.article), default=mass[0])
    return [bool(flag[i] & NAMED) and page.token[i] not in choice.spared and (inner[i] or 2 * mass[i] < article) for i in range(n)]


def main_text(html: str, choice: Choice | None, constants: frozenset[int]) -> str:
    """The page's main text under its host's template."""
    page = Page(html)
    if choice is None or choice.article not in page.token:
        choice = own_choice(page, constants)
    if choice is None:
        return ""
    token, parent, flag, n = page.token, page.parent, page.flag, len(page.token)
    rejected, spared, doubtful = frozenset(choice.rejected), frozenset(choice.spared), frozenset(choice.doubtful)
    named = _named_parts(page, choice)
    article, core, under, bad = [False] * n, [False] * n, [False] * n, [False] * n
    own_bad = [False] * n
    for i in range(n):
        p, t = max(parent[i], 0), token[i]
        article[i] = article[p] or bool(flag[i] & ARTICLE)
        core[i] = core[p] or t == choice.core
        own_bad[i] = bool(flag[i] & OFF) or t in rejected or named[i] or t not in spared and bool(flag[i] & MARKED) and not article[i] and not core[i]
        under[i] = under[p] or t == choice.article
        # What lies around the article node does not mark it.
        bad[i] = t != choice.article and (bad[p] or own_bad[i])
    constant = [not article[b.node] and page.text_token(b) in constants for b in page.blocks] if constants else [False] * len(page.blocks)
    beside = [
        b.node for b, c in zip(page.blocks, constant, strict=True)
        if not choice.semantic and not c and not under[b.node] and not bad[b.node] and " " in b.text
    ]
    if beside:
        # The page has text of its own beside the article node: the deepest node that holds both.
        held = [0] * n
        for i in [*beside, *(i for i in range(n) if token[i] == choice.article)]:
            held[i] += 1
        need = sum(held)
        for i in range(n - 1, -1, -1):
            if held[i] == need:
                top = i
                break
            held[parent[i]] += held[i]
        for i in range(n):
            under[i] = i == top or i > 0 and under[parent[i]]
    inside = [
        (b, c) for b, c in zip(page.blocks, constant, strict=True)
        if under[b.node] and not bad[b.node] and (article[b.node] or not choice.semantic)
    ]
    if doubtful:
        # Small slots of a whole page count from its first heading or larger slot to the last.
        unsure = page.under(lambda i: token[i] in doubtful)
        sure = [k for k, (b, c) in enumerate(inside) if not unsure[b.node] and not c]
        inside = [x for k, x in enumerate(inside) if not unsure[x[0].node] or sure and sure[0] < k < sure[-1]]
    inside = [(b.text, c) for b, c in inside]
    kept = [text for text, c in inside if not c]
    # Constants that outweigh the rest are an article in several versions rather than a template.
    if 2 * sum(map(len, kept)) < sum(len(text) for text, _ in inside):
        kept = [text for text, _ in inside]
    return " ".join(kept)


#: The token that every page has.
_WHOLE = _number("\0")
_ROW = "host string, page long, token long, n int, parent long, depth int, flag int, slot long, chars long, links long, heading boolean, body long"


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each page its distinct tokens and how often they stand there.

    slot is the token of the once-standing container around a text outside boilerplate, if it has two words or more.
    body is a digest of the page's text outside boilerplate; it stands at that text's tokens and at the page's own.
    """
    for batch in batches:
        rows = []
        for host, page_id, html in zip(batch["host"], batch["page"], batch["html"], strict=True):
            page = Page(html)
            counts, near, boiler, off = page.counts(), page.single(), page.boiler(), page.off()
            texts: dict[int, list] = {}
            for b in page.blocks:
                key, out = page.text_token(b), boiler[b.node]
                slot = None if off[b.node] or " " not in b.text else page.token[near[b.node]]
                if key in texts:
                    texts[key][0] += 1
                else:
                    texts[key] = [1, slot, len(b.text), b.links, b.heading, out]
            body = _number(" ".join(str(k) for k, t in texts.items() if not t[5]))
            rows.append((host, page_id, _WHOLE, 1, None, None, None, None, None, None, None, body))
            first: dict[int, int] = {}
            for i, t in enumerate(page.token):
                first.setdefault(t, i)
            rows += [(host, page_id, t, counts[t], page.token[max(page.parent[i], 0)] if i else 0, page.depth[i], page.flag[i], None, None, None, None, 0) for t, i in first.items()]
            rows += [(host, page_id, k, n, None, None, None, slot, chars, links, head, 0 if out else body) for k, (n, slot, chars, links, head, out) in texts.items()]
        # As objects: a null would turn the other numbers of its column to doubles.
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ROW.split(", ")], dtype=object)


def _is_constant() -> Column:
    return (F.col("bodies") >= 2) & (F.col("bodies") >= CONSTANT * F.col("all_bodies"))


def _choices(key: tuple, skeleton: pd.DataFrame) -> pd.DataFrame:
    """One host's choice. A skeleton node is on half of the host's pages or more, so these are at most twice as many as
    a page has on average."""
    columns = ["token", "parent", "depth", "flag", "mass", "links", "heading"]
    found = choose([Node(*r) for r in skeleton[columns].itertuples(index=False)])
    return pd.DataFrame([] if found is None else [(key[0], *found)], columns=["host", "article", "core", "semantic", "rejected", "spared", "doubtful"])


def templates(pages: DataFrame, small_hosts: int = SMALL_HOSTS) -> DataFrame:
    """(host, article, core, semantic, rejected, spared, doubtful, constants): the choice for each host, null without a skeleton,
    and the numbers of the template's texts, which are at most 1 / CONSTANT times as many as a page has on average.

    pages: host, page (a number for each row) and html.
    """
    tokens = pages.mapInPandas(_tokens, _ROW)
    most = lambda *names: [F.max(c).alias(c) for c in names]
    own = most("parent", "depth", "flag", "slot", "chars", "links", "heading")
    bodies = tokens.groupBy("host", "token", "body").agg(
        F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"), F.count("*").alias("pages"), *most("n"), *own
    )
    vectors = cut(
        bodies.groupBy("host", "token").agg(F.sum("vector").alias("vector"), F.sum("pages").alias("pages"), F.count("*").alias("bodies"), *most("n"), *own)
    )
    sizes = cut(vectors.where(F.col("token") == _WHOLE).select("host", F.col("pages").alias("all_pages"), F.col("bodies").alias("all_bodies")))
    # A row for each host: sent to the tokens while it is small, so that a large host's tokens stay spread.
    if sizes.count() <= small_hosts:
        sizes = F.broadcast(sizes)
    # Rare tokens cannot be in a valid class, and they are the many: they go before the classes are formed.
    frequent = cut(
        vectors.where(F.col("parent").isNotNull()).join(sizes, "host").where((F.col("pages") >= 2) & (F.col("pages") >= SUPPORT * F.col("all_pages")))
    )
    classes = frequent.groupBy("host", "vector").agg(F.count("*").alias("size"))
    valid = frequent.join(classes, ["host", "vector"]).where((F.col("size") >= 2) | (F.col("pages") == F.col("all_pages")))
    texts = vectors.where(F.col("parent").isNull() & (F.col("token") != _WHOLE)).join(sizes, "host")
    slots = texts.where(F.col("slot").isNotNull() & ~_is_constant()).groupBy("host", F.col("slot").alias("token")).agg(
        F.sum(F.col("chars") * F.col("bodies")).alias("mass"), F.sum(F.col("links") * F.col("bodies")).alias("links"), F.max("heading").alias("heading")
    )
    node = valid.where(F.col("n") == 1).select("host", "token", "parent", "depth", "flag").join(slots, ["host", "token"], "left")
    node = node.na.fill(0, ["mass", "links"]).na.fill(False, ["heading"])
    chosen = node.groupBy("host").applyInPandas(_choices, "host string, article long, core long, semantic boolean, rejected array<long>, spared array<long>, doubtful array<long>")
    constant = texts.where(_is_constant()).groupBy("host").agg(F.collect_list("token").alias("constants"))
    return chosen.join(constant, "host", "full_outer")


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", small_hosts: int = SMALL_HOSTS, small_constants: int = SMALL_CONSTANTS) -> DataFrame:
    """Adds the main text to every page.

    All columns stay as they are, whatever their names; only one named as ``out`` is replaced. Null and empty pages give
    an empty text; pages with a null url or without a host form one group of their own; repeated pages count as pages
    each; of slots with equal text the outer one, then the one of smaller number, is the core. A host with a single page
    has no template: the page's own structure decides. Long and deep pages take time in proportion to their length.

    Up to small_hosts hosts with small_constants constant texts the templates are broadcast, and no page moves; beyond,
    pages and templates are joined by host. Both give the same rows.
    """
    spark = pages.sparkSession
    small_batches(spark)

    @F.pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return urls.map(host_of)

    named = host(F.coalesce(F.col(url).cast("string"), F.lit(""))).alias("host")
    found = cut(templates(pages.select(named, F.xxhash64(url, html).alias("page"), whole_text(html).alias("html")), small_hosts))

    @F.pandas_udf("string")
    def column(texts: pd.Series, article: pd.Series, core: pd.Series, semantic: pd.Series, rejected: pd.Series, spared: pd.Series, doubtful: pd.Series, constants: pd.Series) -> pd.Series:
        sets: dict[bytes, frozenset] = {}
        rows = []
        for t, a, c, s, r, p, d, x in zip(texts, article, core, semantic, rejected, spared, doubtful, constants, strict=True):
            key = x.tobytes() if x is not None else b""
            if key not in sets:
                sets[key] = frozenset(x.tolist()) if x is not None else frozenset()
            rows.append(main_text(t, None if pd.isna(a) else Choice(int(a), int(c), bool(s), list(r), list(p), list(d)), sets[key]))
        return pd.Series(rows)

    size = F.coalesce(F.sum(F.greatest(F.size("constants"), F.lit(0)) + F.greatest(F.size("rejected"), F.lit(0))), F.lit(0))
    hosts, constants_ = found.agg(F.count("*"), size).first()
    if hosts <= small_hosts and constants_ <= small_constants:
        found = F.broadcast(found)
    # The page's own columns travel as one, so that no name of theirs can clash with the template's.
    rows = pages.select(F.struct("*").alias("row"), named)
    joined = rows.join(found, "host", "left")
    names = ("article", "core", "semantic", "rejected", "spared", "doubtful", "constants")
    # A null would turn a column of numbers to doubles: the numbers travel as text.
    text = column(F.coalesce(F.col(f"row.`{html}`").cast("string"), F.lit("")), *[F.col(c).cast("string") if c in ("article", "core") else F.col(c) for c in names])
    kept = [F.col(f"row.`{c}`") for c in pages.columns if c.lower() != out.lower()]
    return joined.select(*kept, text.alias(out))
