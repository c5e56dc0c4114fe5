"""Main text of web pages by wrappers: union-free expressions inferred from the token streams of each layout of a host.

The expression tells where an article is: where the text that differs from page to page is densest. Names of tags, roles and classes only take
out what lies inside an article without being part of it (share buttons, comments, adverts).
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, work_folder

#: Tags whose content is never text of the page.
_SILENT = set("script style noscript template svg iframe object canvas audio video select textarea title annotation annotation-xml".split())
#: Those among them that go on to the end of the page if nothing ends them; others without an end are passed over.
_SILENT_TO_END = {"script", "style"}
#: Tags that only mark up text inside a block; the rest are blocks.
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture source input "
              "math mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mphantom menclose semantics".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A block that opens inside one of these ends it.
_ENDED_BY_BLOCK = {"p"}
_SAME_ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
#: Blocks around the article, by tag, by ARIA role, and by a word of class or id.
_ASIDE_TAGS = set("nav footer aside form button dialog menu search fieldset".split())
_ASIDE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar status".split())
#: Words that name such a block in a class or id, with words of page building around them only (a "related-work" or "share-price" isn't meant),
#: and words that do so only alone (with "side" a "side-by-side" isn't meant). Headings, paragraphs and lists are never named away.
_PARTS = r"(?:site|page|main|top|bottom|left|right|post|entry|article|blog|user|reader|social|box|bar|buttons?|links?|lists?|section|area|blocks?|widgets?|container|wrapper|wrap|banner|notice|form|posts?|articles?|stories|items?|icons?|menu|nav|panel|thread|slot|unit|zone|message|popup|modal|tools|header|footer|inner|outer|js|\d+)"
_ASIDE_WORDS = re.compile(
    rf"(?:{_PARTS}[_-])*(?:advert\w*|adsbox|sponsor\w*|breadcrumbs?|masthead|topbar|site-?header|page-?header|site-?footer|sidebar|comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|newsletter|subscribe|signup|pagination|pager|copyright|"
    rf"navbar|navigation|popup|modal|recommend\w*|related|share|sharing|social|widgets?|toolbar|promos?|banner|footer)(?:[_-]{_PARTS})*",
    re.I,
)
_ASIDE_ALONE = re.compile(r"(?:ads?|ad-\w+|nav|menu|side|aside|notices?|alert|overlay|login|skip|skip-\w+|\w+-nav|\w+-menu|\w+-notice|\w+-ads?)", re.I)
#: Blocks that stand for the page: their classes tell of its state and key, not of its layout.
_PAGE_TAGS = {"html", "body", "main", "article"}
#: Tags of blocks that hold text themselves, and of headings.
_TEXTUAL = set("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre table figure figcaption details summary address center".split())
_HEADING = set("h1 h2 h3 h4 h5 h6".split())
#: A block with one of these tags, roles or names is an article, whatever is densest inside.
_ARTICLE_NAMES = re.compile(r"(?:article|post|entry|story|hentry)(?:[_-]?(?:body|content|text))?", re.I)

#: A tag ends at the first ">" outside of quoted values; one that meets a "<" before isn't a tag, and nothing is read twice.
_TOKEN = re.compile(
    r"<!--|<!\[CDATA\[|<[!?]|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<text>[^<]++|<)", re.S
)
_END_OF = {t: re.compile(rf"</{t}\s*>", re.I) for t in _SILENT}
_DIGIT = re.compile(r"\d")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Different pages of a host, about, that are folded one after another into wrappers, and wrappers that are joined at once on the way up.
LEAF_PAGES, JOINED = 64, 32
#: Samples that must agree before a block counts as part of the template.
TEMPLATE_PAGES = 4
#: A block that holds this share of its parent's text is where the article is; a sibling of this share of the largest one belongs to it.
DENSEST, BESIDE = 0.6, 0.25
#: Blocks nested deeper than this only separate texts of the block at this depth.
DEEPEST = 200
#: Bits of a table that aligns two lists of blocks, about, that are held at once; a larger one is made in parts.
ALIGNED = 400_000_000


class Text(str):
    """A text with plain white space, and how many of its characters are links."""

    link: int = 0


@dataclass
class Node:
    """A block of a page. children: nodes and texts, in page order. size, link and mark: characters of its text without asides, those in links, a checksum."""

    sign: str
    aside: bool = False
    main: bool = False
    children: list = field(default_factory=list)
    size: int = -1
    link: int = 0
    mark: int = 0

    @property
    def tag(self) -> str:
        return self.sign.split(".", 1)[0]


def _traits(tag: str, rest: str) -> tuple[str, bool, bool]:
    """The signature of a block, whether tag and attributes put it beside the article, and whether they say that it is one."""
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest.strip() else {}
    names, role = f"{a.get('class', '')} {a.get('id', '')}".split(), a.get("role", "").lower()
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    named = tag not in _PAGE_TAGS and tag not in _TEXTUAL and any(_ASIDE_WORDS.fullmatch(x) or _ASIDE_ALONE.fullmatch(x) for x in names)
    aside = hidden or tag in _ASIDE_TAGS or role in _ASIDE_ROLES or named
    main = tag == "article" or role == "article" or tag not in _TEXTUAL and any(map(_ARTICLE_NAMES.fullmatch, names))
    # Names with digits count pages or posts: they would tell each page of a host from the others.
    classes = [] if tag in _PAGE_TAGS else sorted(x for x in a.get("class", "").split() if not _DIGIT.search(x))
    return ".".join([tag, *classes]), aside, main and not aside


def measure(node: Node, hints: bool = True) -> Node:
    """Sets size, link and mark of a block and of all blocks in it."""
    stack = [(node, False)]
    while stack:
        x, ready = stack.pop()
        inner = [c for c in x.children if isinstance(c, Text) or not (hints and c.aside)]
        if not ready:
            stack.append((x, True))
            stack += [(c, False) for c in x.children if not isinstance(c, Text)]
            continue
        x.size = sum(len(c) if isinstance(c, Text) else c.size for c in inner)
        x.link = sum(c.link for c in inner)
        x.mark = 0
        for c in inner:
            x.mark = zlib.crc32(c.encode("utf-8", "replace") if isinstance(c, Text) else c.mark.to_bytes(4, "little"), x.mark)
    return node


def _tokens(page: str) -> Iterator[tuple[str | None, str, str]]:
    """Texts (None, text, "") and tags (name, "/" or "", attributes) of a page from left to right; comments, declarations and silent elements are passed over."""
    at, lacking = 0, set()  # ends that come nowhere behind

    def end(mark: str, start: int) -> int:
        """Behind the next mark; -1 if there is none any more."""
        if mark in lacking:
            return -1
        found = page.find(mark, start)
        if found < 0:
            lacking.add(mark)
            return -1
        return found + len(mark)

    while (m := _TOKEN.match(page, at)) is not None:
        at = m.end()
        if m["text"] is not None:
            yield None, m["text"], ""
        elif m["tag"] is None:
            sign = m[0]
            to = end("-->", m.start() + 2) if sign == "<!--" else end("]]>", at) if sign == "<![CDATA[" else end(">", at)
            if to >= 0:
                at = to
            elif sign in ("<!--", "<![CDATA["):
                return
            else:
                at = m.start() + 1
                yield None, "<", ""
        else:
            tag = m["tag"].lower()
            if tag not in _SILENT:
                yield tag, m["close"], m["rest"]
            elif not m["close"] and tag not in lacking:
                if (to := _END_OF[tag].search(page, at)) is not None:
                    at = to.end()
                elif tag in _SILENT_TO_END:
                    return
                else:
                    lacking.add(tag)


class _Open:
    """The elements that are open at a place of a page, and the blocks that their texts go to."""

    def __init__(self, root: Node):
        self.tags, self.blocks, self.depths, self.places = ["#page"], [root], [0], {}

    def last(self, names: set[str]) -> int:
        """The place of the innermost open element of these names, or 0."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def cut(self, place: int) -> None:
        """Ends the element at a place and all in it."""
        while len(self.tags) > place:
            self.places[self.tags.pop()].pop()
            self.blocks.pop()
            self.depths.pop()

    def add(self, tag: str, node: Node, stays: bool) -> None:
        deep = self.depths[-1]
        if deep < DEEPEST or node.aside and deep == DEEPEST:
            self.blocks[-1].children.append(node)
            deep += 1
        else:
            node = self.blocks[-1]
        if stays:
            self.places.setdefault(tag, []).append(len(self.tags))
            self.tags.append(tag)
            self.blocks.append(node)
            self.depths.append(deep)


def parse(page: str) -> Node:
    """The blocks of a page; inline markup is dropped, missing end tags are supplied, white space is one space."""
    root = Node("#page")
    at, held, linked, inside = _Open(root), [], 0, False

    def flush() -> None:
        nonlocal linked
        if held:
            text = Text(" ".join(html.unescape("".join(held)).split()))
            if text:
                text.link = min(linked, len(text))
                at.blocks[-1].children.append(text)
            held.clear()
            linked = 0

    for tag, what, rest in _tokens(page):
        if tag is None:
            held.append(what)
            linked += len(what.strip()) if inside else 0
            continue
        if tag in _INLINE:
            if tag == "a":
                inside = not what
            if tag in ("br", "img", "input"):
                held.append(" ")
            continue
        flush()
        if what:
            if at.places.get(tag):
                at.cut(at.places[tag][-1])
            continue
        while at.tags[-1] in _ENDED_BY_BLOCK:
            at.cut(len(at.tags) - 1)
        if tag in _SAME_ENDS:
            same = at.last({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag})
            if same > at.last(_SAME_ENDS[tag]):
                at.cut(same)
        sign, aside, main = _traits(tag, rest)
        at.add(tag, Node(sign, aside, main), tag not in _VOID and not rest.rstrip().endswith("/"))
    flush()
    return root


class _Masks:
    """The places of each signature of a list as the bits of a whole number; numbers of ALIGNED bits together are kept."""

    def __init__(self, b: list[str]):
        self.size, self.most, self.known = len(b) // 8 + 1, max(1, ALIGNED // (len(b) + 1)), {}
        self.places: dict[str, list[int]] = {}
        if len(b) <= 256:
            for j, x in enumerate(b):
                self.known[x] = self.known.get(x, 0) | 1 << j
            return
        for j, x in enumerate(b):
            self.places.setdefault(x, []).append(j)

    def of(self, x: str) -> int:
        if (out := self.known.get(x)) is not None:
            return out
        at = self.places.get(x)
        if at is None:
            return 0
        if len(at) <= 4:
            return sum(1 << j for j in at)  # quick to make; lists whose signatures all differ would keep one number for each
        bits = np.zeros(self.size * 8, np.uint8)
        bits[at] = 1
        out = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[x] = out
        return out


def _align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence of two signature lists (-1: only in the other).

    Rows of the table of lengths are whole numbers whose bits tell where the length doesn't grow, so that lists of thousands are quick. Of a table with more
    than ALIGNED bits some rows are kept, and the rows between two of them are made again when the way back comes there.
    """
    masks = _Masks(b)
    full = (1 << len(b)) - 1
    out, i, j = [], len(a), len(b)

    def rows_of(low: int, high: int, row: int) -> Iterator[int]:
        """Rows low + 1 to high, as far as the way back needs them, from row low."""
        cut = (1 << j) - 1
        v = row & cut
        for x in a[low:high]:
            u = v & masks.of(x)
            v = (v + u | v - u) & cut
            yield v

    kept = [(0, full)]
    while i and j:
        low, row = kept[-1]
        if low == i:
            kept.pop()
            continue
        if (i - low) * j > ALIGNED and i - low > 1:
            step = max(1, -(-(i - low) // max(2, ALIGNED // j)))
            kept += [(low + k, v) for k, v in enumerate(rows_of(low, i - 1, row), 1) if k % step == 0]
            if kept[-1][0] > low:
                continue
        rows = [row, *rows_of(low, i, row)]
        length = lambda i, j: j - (rows[i - low] & (1 << j) - 1).bit_count()  # noqa: B023, E731
        while i > low and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif length(i - 1, j) == length(i, j):
                i -= 1
                out.append((i, -1))
            else:
                j -= 1
                out.append((-1, j))
    out += [(k, -1) for k in range(i - 1, -1, -1)]
    out += [(-1, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def _fold(items: list) -> list[tuple[str, list]]:
    """Successive blocks of one signature as one run: (signature, members). Texts stand for themselves."""
    out: list[tuple[str, list]] = []
    for x in items:
        sign = "#text" if isinstance(x, Text) else x.sign
        if out and out[-1][0] == sign and sign != "#text":
            out[-1][1].append(x)
        else:
            out.append((sign, [x]))
    return out


def _pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """As _align; common ends first, as most lists differ in little."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    middle = _align(a[low : len(a) - high], b[low : len(b) - high])
    return (
        [(i, i) for i in range(low)]
        + [(i + low if i >= 0 else -1, j + low if j >= 0 else -1) for i, j in middle]
        + [(len(a) - high + i, len(b) - high + i) for i in range(high)]
    )


class Wrapper:
    """A union-free expression over blocks: constants, text slots, optional ("?") and repeated ("+") groups.

    Each group is {"s": signature, "n": samples that have it, "k": its blocks in a row (0: any number, a repeated group), "o": optional, "t": its constant
    text (null: a slot; of texts only), "main", "aside", and for each of its blocks (one for all, if repeated) "w": characters over all samples, "l": those in links,
    "m": checksum of the text if all samples agree, else -1, "c": groups inside}. Samples are aligned with it one after another; wrappers of different pages are joined.
    """

    def __init__(self, groups: list[dict] | None = None, pages: int = 0):
        self.groups, self.pages = groups or [], pages
        self._ways: list | None = None

    def add(self, page: Node, hints: bool = True) -> None:
        measure(page, hints)
        self.groups = self._merge(self.groups, _fold(page.children), self.pages > 0)
        self.pages += 1
        self._ways = None

    def join(self, other: Wrapper) -> None:
        """Takes in what another wrapper of the same layout has seen."""
        self.groups = _joined(self.groups, other.groups) if self.pages and other.pages else self.groups or other.groups
        self.pages += other.pages
        self._ways = None

    def _new(self, sign: str, members: list, optional: bool) -> dict:
        if sign == "#text":
            x = members[0]
            return {"s": sign, "n": 1, "k": 1, "o": optional, "t": str(x), "main": False, "aside": False, "w": [len(x)], "l": [x.link], "m": [0], "c": [[]]}
        first = members[0]
        return {
            "s": sign, "n": 1, "k": len(members), "o": optional, "t": None, "main": first.main, "aside": first.aside, "w": [x.size for x in members], "l": [x.link for x in members], "m": [x.mark for x in members],
            "c": [self._merge([], _fold(x.children), False) for x in members],
        }

    def _merge(self, groups: list[dict], found: list[tuple[str, list]], seen: bool) -> list[dict]:
        out = []
        for i, j in _pairs([g["s"] for g in groups], [s for s, _ in found]):
            if j < 0:
                out.append(groups[i] | {"o": True})
            elif i < 0:
                out.append(self._new(*found[j], seen))
            else:
                out.append(self._with(groups[i], found[j][1]))
        return out

    def _with(self, g: dict, members: list) -> dict:
        n = g["n"] + 1
        if g["s"] == "#text":
            return g | {"n": n, "t": g["t"] if g["t"] == members[0] else None, "w": [g["w"][0] + len(members[0])], "l": [g["l"][0] + members[0].link]}
        if g["k"] == len(members):
            return g | {
                "n": n, "w": [w + x.size for w, x in zip(g["w"], members)], "l": [w + x.link for w, x in zip(g["l"], members)], "m": [m if m == x.mark else -1 for m, x in zip(g["m"], members)],
                "c": [self._merge(c, _fold(x.children), True) for c, x in zip(g["c"], members)],
            }
        # Another number of blocks: a repeated group, all of whose blocks are samples of one expression.
        inner = g["c"][0]
        for c in g["c"][1:]:
            inner = _joined(inner, c)
        for x in members:
            inner = self._merge(inner, _fold(x.children), True)
        return g | {"n": n, "k": 0, "w": [sum(g["w"]) + sum(x.size for x in members)], "l": [sum(g["l"]) + sum(x.link for x in members)], "m": [-1], "c": [inner]}

    def to_json(self) -> str:
        return json.dumps({"pages": self.pages, "groups": self.groups}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Wrapper:
        x = json.loads(text)
        return cls(x["groups"], x["pages"])

    def expression(self, groups: list[dict] | None = None) -> str:
        """The wrapper in the usual notation, for people."""
        parts = []
        for g in self.groups if groups is None else groups:
            for c in g["c"]:
                body = ("#PCDATA" if g["t"] is None else g["t"]) if g["s"] == "#text" else f"<{g['s']}>{self.expression(c)}</{g['s'].split('.')[0]}>"
                parts.append(f"({body})" + ("+" if g["k"] == 0 else "") + ("?" if g["o"] else "") if g["k"] == 0 or g["o"] else body)
        return " ".join(parts)

    def ways(self, hints: bool = True) -> list[dict]:
        """The way down to the article: for each level which block leads on, and which of its siblings belong to the article.

        One level down leads a block (not a text) that isn't repeated, has no text of its own, stands in nearly every page and holds most of the level's text;
        what all samples have alike counts once. A block that says it is an article ends the way, and so does a level without such a block.
        """
        if self._ways is None:
            self._ways, groups, pages, top = [], self.groups, self.pages, True
            while True:
                level = [x for i, g in enumerate(groups) for x in self._entries(i, g, hints)]
                whole = sum(x["share"] for x in level)
                best = max(level, key=lambda x: x["share"], default=None)
                on = best is not None and best["tag"] not in _TEXTUAL | {"#text"} and not best["repeated"] and not best["text"] and best["n"] * 10 >= pages * 9 and best["share"] >= DENSEST * whole and best["share"] > 0
                if not on:
                    self._ways.append({"on": None, "keep": None if not top else {x["at"] for x in level if self._belongs(x, best)}, "least": BESIDE * best["share"] if best and top else 0})
                    return self._ways
                self._ways.append({"on": best["at"], "keep": {x["at"] for x in level if x is not best and self._belongs(x, best)}, "least": BESIDE * best["share"]})
                g = groups[best["at"][0]]
                top = top and best["tag"] in ("html", "body", "#page")
                if hints and g["main"]:
                    self._ways.append({"on": None, "keep": None, "least": 0})
                    return self._ways
                groups, pages = g["c"][best["at"][1]], g["n"]
        return self._ways

    def _entries(self, i: int, g: dict, hints: bool) -> list[dict]:
        """The blocks of a group, with the characters a page that has it holds there."""
        if hints and g["aside"]:
            return []
        out = []
        for j, (w, link, mark, c) in enumerate(zip(g["w"], g["l"], g["m"], g["c"])):
            same = g["n"] >= TEMPLATE_PAGES and (g["t"] is not None if g["s"] == "#text" else mark != -1)
            out.append({
                "at": (i, j), "tag": g["s"].split(".", 1)[0], "n": g["n"], "same": same, "share": w / g["n"] / (g["n"] if same else 1), "links": link * 2 > w, "repeated": g["k"] == 0, "main": g["main"],
                "text": any(x["s"] == "#text" for x in c), "heading": g["s"].split(".", 1)[0] in _HEADING or bool(c) and all(x["s"].split(".", 1)[0] in _HEADING for x in c),
            })
        return out

    @staticmethod
    def _belongs(x: dict, best: dict | None) -> bool:
        """Whether a block beside the densest one is part of the article: not what all pages share; articles, headings, paragraphs and texts are, and blocks of some size that aren't links."""
        if x["same"] or best is None:
            return False
        if x["main"] or x["heading"] or x["tag"] in ("p", "#text", "blockquote", "pre", "figure"):
            return True
        return x["tag"] != "header" and not x["links"] and x["share"] >= BESIDE * best["share"]


def _joined(a: list[dict], b: list[dict]) -> list[dict]:
    """Two expressions of samples of one block as one."""
    out = []
    for i, j in _pairs([g["s"] for g in a], [g["s"] for g in b]):
        if i < 0 or j < 0:
            out.append((a[i] if j < 0 else b[j]) | {"o": True})
            continue
        g, h = a[i], b[j]
        if g["s"] == "#text":
            out.append(g | {"n": g["n"] + h["n"], "t": g["t"] if g["t"] == h["t"] else None, "w": [g["w"][0] + h["w"][0]], "l": [g["l"][0] + h["l"][0]]})
        elif g["k"] == h["k"] and g["k"]:
            c = [_joined(x, y) for x, y in zip(g["c"], h["c"])]
            out.append(g | {"n": g["n"] + h["n"], "o": g["o"] or h["o"], "w": [x + y for x, y in zip(g["w"], h["w"])], "l": [x + y for x, y in zip(g["l"], h["l"])], "m": [x if x == y else -1 for x, y in zip(g["m"], h["m"])], "c": c})
        else:
            inner = g["c"][0]
            for c in [*g["c"][1:], *h["c"]]:
                inner = _joined(inner, c)
            out.append(g | {"n": g["n"] + h["n"], "o": g["o"] or h["o"], "k": 0, "w": [sum(g["w"]) + sum(h["w"])], "l": [sum(g["l"]) + sum(h["l"])], "m": [-1], "c": [inner]})
    return out


def layout_of(page: Node) -> int:
    """A number for the kinds of blocks that a page has in its first levels, never 0."""
    paths, level = set(), [("", page)]
    for _ in range(4):
        level = [(f"{at}>{x.sign}", x) for at, node in level for x in node.children if not isinstance(x, Text) and node.tag not in _TEXTUAL]
        paths.update(at for at, x in level if x.tag not in _TEXTUAL)
    return int.from_bytes(hashlib.blake2b("\0".join(sorted(paths)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) or 1


def _texts(node: Node, hints: bool) -> list[str]:
    """All texts of a block without asides, in page order."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, Text):
            out.append(str(x))
        elif not (hints and x.aside):
            stack += reversed(x.children)
    return out


def main_blocks(page: Node, wrapper: Wrapper | None = None, hints: bool = True) -> list[str]:
    """Texts of the article's blocks in page order.

    The page is aligned with the wrapper of its layout, level by level on the wrapper's way to the article. Blocks that lead on are followed, blocks that belong
    to the article give all their texts but asides, the rest goes. A page that its wrapper leaves without text, or that has none, is a sample of its own.
    """
    if wrapper is not None:
        out = _taken(page, wrapper.groups, wrapper.ways(hints), hints)
        if out or not hints:
            return out
    alone = Wrapper()
    alone.add(page, hints)
    return _taken(page, alone.groups, alone.ways(hints), hints)


def _taken(page: Node, groups: list[dict], ways: list[dict], hints: bool) -> list[str]:
    out: list[str] = []

    def level(node: Node, groups: list[dict], depth: int) -> None:
        way = ways[depth]
        if way["keep"] is None:  # the article itself
            for x in node.children:
                out.extend(_texts(x, hints))
            return
        found = _fold(node.children)
        for i, j in _pairs([g["s"] for g in groups], [s for s, _ in found]):
            if j < 0:
                continue
            members = found[j][1]
            for at, x in enumerate(members):
                place = (i, at if i >= 0 and groups[i]["k"] == len(members) else 0)
                if not isinstance(x, Text) and hints and x.aside:
                    continue
                if i >= 0 and place == way["on"] and not isinstance(x, Text):
                    level(x, groups[i]["c"][place[1]], depth + 1)
                elif i >= 0 and place in way["keep"]:
                    out.extend(_texts(x, hints))
                elif i < 0 and not isinstance(x, Text) and (x.main or x.tag in _HEADING or x.tag == "p" or x.tag != "header" and way["least"] and sum(map(len, _texts(x, hints))) >= way["least"] and measure(x, hints).link * 2 <= x.size):
                    out.extend(_texts(x, hints))  # what no sample has

    level(page, groups, 0)
    return out


def _inferred(docs: DataFrame, work: str) -> DataFrame:
    """host, layout, wrapper: the expression of every layout of a host, from all its different pages (host, page).

    Pages of a host are dealt to buckets of about LEAF_PAGES by a hash and folded there in the order of their hashes; wrappers of buckets are joined in a
    tree, JOINED at a time. So one large host is spread over all tasks, a task holds wrappers and not pages, and the result hangs on the pages alone,
    not on their order or partitions. Each task passes a page on once, however many copies it has.
    """
    rows = docs.filter("host <> '' AND page <> ''").select("host", F.xxhash64("page").alias("h"), "page")
    many = rows.groupBy("host").agg(F.ceil(F.approx_count_distinct("h") / LEAF_PAGES).alias("buckets")).filter("buckets > 1")
    many = stored(many, work, "hosts")  # few: their size is known then, and pages needn't be dealt by host
    widest = many.agg(F.max("buckets")).first()[0] or 1

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for b in batches:
            fresh = []
            for at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fresh.append(at not in seen)
                seen.add(at)
            if len(seen) > 1_000_000:
                seen.clear()
            yield b.filter(pa.array(fresh, pa.bool_()))

    dealt = rows.mapInArrow(once, "host string, h long, page string").join(many, "host", "left").withColumn("bucket", F.pmod("h", F.coalesce("buckets", F.lit(1))).cast("long"))
    dealt = dealt.select("host", "bucket", "h", "page").repartition("host", "bucket").sortWithinPartitions("host", "bucket", "h", "page")
    out = "host string, layout long, bucket long, wrapper string"

    def told(host: str, bucket: int, found: dict[int, Wrapper]) -> pa.RecordBatch:
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array(found, pa.int64()), pa.array([bucket] * n, pa.int64()), pa.array([w.to_json() for w in found.values()], pa.string())], ["host", "layout", "bucket", "wrapper"])

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, before, found = None, None, {}
        for b in batches:
            for host, bucket, _, text in zip(*(c.to_pylist() for c in b.columns)):
                if group != (host, bucket):
                    if group is not None:
                        yield told(*group, found)
                    group, before, found = (host, bucket), None, {}
                if text != before:  # copies from other tasks come one after another
                    page = parse(text)
                    found.setdefault(layout_of(page), Wrapper()).add(page)
                before = text
        if group is not None:
            yield told(*group, found)

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        w = Wrapper()
        for text in table.column("wrapper").to_pylist():
            w.join(Wrapper.from_json(text))
        return pa.table([*(table.column(c).slice(0, 1) for c in ("host", "layout")), pa.array([table.column("bucket")[0].as_py() // JOINED], pa.int64()), pa.array([w.to_json()], pa.string())], ["host", "layout", "bucket", "wrapper"])

    each = stored(dealt.mapInArrow(infer, out), work, "leaves")
    single = each.join(F.broadcast(many.select("host")), "host", "left_anti") if widest > 1 else each
    large = each.join(F.broadcast(many.select("host")), "host", "left_semi")
    width = widest
    while width > 1:
        large = large.withColumn("parent", F.floor(F.col("bucket") / JOINED)).groupBy("host", "layout", "parent").applyInArrow(lambda t: join(t.drop_columns("parent")), out)
        width = -(-width // JOINED)
    return (single.unionByName(large) if widest > 1 else single).select("host", "layout", "wrapper")


def extract_text(docs: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """The main text of every page: blocks in page order, joined with an empty line. Returns key, url, text, n_chars (long).

    Every page is looked at for its layout (the blocks of its first levels). A wrapper is inferred from all different pages of each layout of a host and applied
    to them. Of different pages with one text only one counts.

    Null and empty pages give the empty text. Pages without a host (or a null url) and layouts with a single page use no wrapper: the same rules see the page
    alone. Repeated rows are pages of their own. An empty table gives an empty result.
    """
    work = work_folder(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = docs.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(page).alias("page"), host.alias("host"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            layouts = [layout_of(parse(x)) if x and host else None for x, host in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(layouts, pa.int64())], ["k", "u", "page", "host", "layout"])

    laid = rows.mapInArrow(lay, f"k {kind}, u string, page string, host string, layout long")
    wrappers = stored(_inferred(rows, work), work, "wrappers")  # its size is known then: pages needn't be dealt by host

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], Wrapper] = {}
        for b in batches:
            texts = []
            for text, *at, w in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                at = tuple(at)
                if w is not None and at not in known:
                    if len(known) > 500:
                        known.clear()
                    known[at] = Wrapper.from_json(w)
                own = known[at] if w is not None else None
                texts.append("\n\n".join(main_blocks(parse(text), own if own is not None and own.pages > 1 else None)) if text else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["k", "u", "text", "n_chars"])

    out = laid.join(wrappers, ["host", "layout"], "left").select("k", "u", "page", "host", "layout", "wrapper").mapInArrow(extract, f"k {kind}, u string, text string, n_chars long")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")
