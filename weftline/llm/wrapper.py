"""Wrappers of HTML pages: union-free regular expressions over token streams.

The reader balances a page's block-level tags, so a token stream is a tree.  A wrapper is a tree of the same kind: an
element's content is a sequence of items, each a text slot, an element or a group of several, and each required or
optional, single or repeated.  Pages of one host are aligned to the wrapper one after the other: texts that differ
make a slot variable, items that stand on one side only become optional, and runs and squares of equal items become
repeated elements and groups.  Slots add up how much text they hold, so a wrapper tells which of its parts carries
the host's varying prose: that part is the article, and texts that never vary are the template.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from html import unescape

#: HTML elements by role.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "svg", "object", "audio", "video", "canvas", "label"}
HELD = BLOCK - {"p", "li", "dt", "dd", "tr", "td", "th", "hr", "option", "thead", "tbody", "tfoot", "h1", "h2", "h3", "h4", "h5", "h6"}
NOT_TEXT = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "svg", "object", "audio", "video", "canvas", "search", "option", "label", "fieldset"} | RAW
MAIN = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form", "note", "status"}
#: Words in class and id names of what is not the article.
NOT_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "dropdown", "footer", "foot", "form", "gdpr", "header", "legal", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "sidenav", "signup", "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "teaser", "toolbar", "topbar", "trending", "widget", "widgets"}
NAMES_IN_MAIN = {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "teaser", "related"}

#: Elements whose start ends an open element of the same kind, up to the element that holds them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TEXTUAL = {"p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "option", "caption", "legend", "figcaption", "summary"}

KINDS = dict.fromkeys(BLOCK, "block") | dict.fromkeys(RAW, "raw") | {"br": "br", "a": "a", "hr": "hr"}

QUOTED = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[a-zA-Z/!?])")
BLIND = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[a-zA-Z/!?])")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Deepest nesting kept (what lies deeper belongs to the element at that depth), items in a repeated group's body, items
#: of an element before they are told apart by tag alone, and elements of a wrapper before its depths are summed up.
DEPTH, PERIOD, WIDE, LIMIT = 48, 6, 128, 4_096


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)} if text.strip(" /\n\t\r\f") else {}


def is_aside(name: str, attrs: dict[str, str]) -> bool:
    """Whether an element's name, role, class or id marks what does not belong to the article."""
    if name in NOT_TEXT:
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    words = {w.lower() for w in NAME_WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")}
    return bool(words & (NAMES_IN_MAIN if name in MAIN or name in ("body", "html") else NOT_NAMES))


class Text:
    """A stretch of text: its place in the page, its value with white space made single, and characters in links."""

    __slots__ = ("at", "value", "links")
    tag = key = "#"

    def __init__(self, at: int, value: str, links: int) -> None:
        self.at, self.value, self.links = at, value, links


class Element:
    __slots__ = ("tag", "mark", "aside", "main", "kids", "items", "key")

    def __init__(self, tag: str, mark: str = "", aside: bool = False, main: bool = False) -> None:
        self.tag, self.mark, self.aside, self.main, self.kids, self.items, self.key = tag, mark, aside, main, [], None, tag


def read(html: str) -> Element:
    """The page's block-level elements and texts as a tree, in time linear in its length.

    Inline tags join the text around them.  Unclosed and crossed elements are borne: an end tag closes up to its
    nearest open element, and one that has none is passed over.  A tag whose quotes never close ends at its first
    ">", and from there on quotes no longer count."""
    root = Element("")
    stack, over, held, n_texts = [root], {}, [], 0
    in_link = links = 0
    last = html.rfind(">")

    def flush() -> None:
        nonlocal links, n_texts
        if held:
            value = " ".join(unescape("".join(held)).split())
            held.clear()
            if value:
                n_texts += 1
                stack[-1].kids.append(Text(n_texts, value, min(links, len(value))))
            links = 0

    at, n = 0, len(html)
    search, kinds = QUOTED.search, KINDS.get
    while True:
        m = search(html, at)
        low = m.start() if m else n
        if low > last:
            low = n
        if low > at:
            held.append(html[at:low])
            if in_link:
                links += low - at
        if low == n:
            break
        closing, name, rest = m.groups()
        if name is None:
            if html.startswith("<!--", low):
                end = html.find("-->", low + 4)
                at = n if end < 0 else end + 3
            elif html[low + 1] in "!?":
                at = html.find(">", low) + 1
            elif html[low + 1] == "/" or search is BLIND.search:
                held.append("<")
                at = low + 1
            else:  # a tag that its quotes run away with
                search, at = BLIND.search, low
            continue
        at = m.end()
        kind = kinds(name)
        if kind is None:
            name = name.lower()
            kind = kinds(name)
            if kind is None:
                continue
        if kind == "a":
            in_link = 0 if closing else 1
            continue
        if closing:
            if over and over.get(name):
                over[name] -= 1
            elif kind == "block":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name:
                        flush()
                        del stack[k:]
                        break
                else:
                    flush()
            continue
        if kind == "br":
            held.append("\n")
            continue
        flush()
        if kind == "raw":
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            end = html.find(">", found.end()) if found else -1
            at = n if end < 0 else end + 1
            continue
        if stack[-1].tag == "p":
            del stack[-1]
        if name in ENDS:
            like, within = ENDS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in within:
                    break
                if stack[k].tag in like:
                    del stack[k:]
                    break
        if kind == "hr":
            continue
        if len(stack) > DEPTH:
            over[name] = over.get(name, 0) + 1
            continue
        if rest:
            attrs = attributes(rest)
            mark = re.sub(r"\d+", "0", ".".join(x for x in (attrs.get("class", ""), attrs.get("id", "")) if x))
            aside = is_aside(name, attrs)
            main = not aside and (name in MAIN or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop") == "articleBody")
            new = Element(name, mark, aside, main)
        else:
            new = Element(name, "", name in NOT_TEXT, name in MAIN)
        stack[-1].kids.append(new)
        if not rest.endswith("/"):
            stack.append(new)
    flush()
    return root


def texts_of(e: Element | Text) -> list[Text]:
    """The texts of an element; elements marked as asides are left out."""
    if isinstance(e, Text):
        return [e]
    if e.aside:
        return []
    if len(e.kids) == 1:
        return texts_of(e.kids[0])
    return [t for k in e.kids for t in texts_of(k)]


@dataclass(slots=True)
class Slot:
    """A place of text: the checksum of its one text, or None once texts differ; pages, characters, those in links."""

    constant: int | None
    pages: int
    chars: int
    links: int
    key: str = field(default="#", init=False)
    tag: str = field(default="#", init=False)


#: Stands for any text where texts are not counted.
BLANK = Slot(None, 0, 0, 0)


class Node:
    """An element of a wrapper.  ``general``: its items are told apart by tag alone; ``flat``: they are summed up in
    one slot.  ``asides`` and ``mains`` count the pages that mark it so."""

    __slots__ = ("tag", "key", "items", "pages", "asides", "mains", "general", "flat", "keep", "_told")

    def __init__(self, tag: str, key: str, items: list[Item], pages: int = 1, asides: int = 0, mains: int = 0, general: bool = False, flat: bool = False, keep: bool = False) -> None:
        self.tag, self.key, self.items, self.pages, self.asides, self.mains, self.general, self.flat, self.keep = tag, key, items, pages, asides, mains, general, flat, keep
        self._told: tuple[bool, bool] | None = None

    def told(self) -> tuple[bool, bool]:
        """Whether anything below is kept of itself, and whether anything below is dropped; once marks are final."""
        if self._told is None:
            below = [x.node.told() for x in self.items if isinstance(x.node, Node)]
            self._told = self.keep or any(k for k, _ in below), any(x.drop for x in self.items) or any(d for _, d in below)
        return self._told


class Item:
    """``node`` between ``least`` and ``most`` times; ``members`` are a page's own elements or texts under it."""

    __slots__ = ("node", "least", "most", "members", "drop")

    def __init__(self, node: Node | Slot, least: int = 1, most: int = 1, members: list | None = None, drop: bool = False) -> None:
        self.node, self.least, self.most, self.members, self.drop = node, least, most, members, drop

    @property
    def key(self) -> str:
        return self.node.key


def key_of(tag: str, mark: str, items: list[Item]) -> str:
    """Elements of text are told apart by tag and mark, others by what they hold as well."""
    sign = f"{tag} {mark}" if mark else tag
    if tag in TEXTUAL:
        return sign
    if len(items) == 1 and items[0].most == 1:
        return f"{sign}{{{items[0].node.tag}}}"
    return f"{sign}{{{','.join(sorted({f'{x.node.tag}+' if x.most > 1 else x.node.tag for x in items}))}}}"


def fold(e: Element) -> Node:
    """A page's element as a wrapper of its own, runs and squares of equal items folded; ``items`` are kept in it."""
    items: list[Item] = []
    for kid in e.kids:
        node = Slot(zlib.crc32(kid.value.encode("utf-8", "surrogatepass")), 1, len(kid.value), kid.links) if isinstance(kid, Text) else fold(kid)
        last = items[-1] if items else None
        if last is not None and last.node.key == node.key and node.key != "#":
            last.node, last.most = merge(last.node, node, False), last.most + 1
            last.members.append(kid)
        else:
            items.append(Item(node, 1, 1, [kid]))
    if len(items) > 3:
        items = squares(items)
    if len(items) > WIDE:
        items = by_tag(items)
    e.items, e.key = items, key_of(e.tag, e.mark, items)
    return Node(e.tag, e.key, [Item(x.node, x.least, x.most) for x in items], 1, int(e.aside), int(e.main), len(items) > WIDE)


def outline(e: Element) -> list[Item]:
    """What ``fold`` gives as a page's items, without counting its texts: elements of text are not looked into."""
    if e.items is None:
        items: list[Item] = []
        for kid in e.kids:
            if isinstance(kid, Text):
                key, node = "#", BLANK
            else:
                if kid.tag in TEXTUAL:
                    kid.key = f"{kid.tag} {kid.mark}" if kid.mark else kid.tag
                else:
                    outline(kid)
                key, node = kid.key, None
            if items and key != "#" and items[-1].node.key == key:
                items[-1].most += 1
                items[-1].members.append(kid)
            else:
                items.append(Item(node or Node(kid.tag, key, []), 1, 1, [kid]))
        if len(items) > 3:
            items = squares(items)
        if len(items) > WIDE:
            items = by_tag(items)
        e.items, e.key = items, key_of(e.tag, e.mark, items)
    return e.items


def group(items: list[Item]) -> Item:
    """Several items as one group that stands once."""
    bundle = Element("(")
    bundle.kids = [k for x in items for k in x.members or ()]
    bundle.items = items
    bundle.key = "(" + "|".join(x.key for x in items) + ")"
    return Item(Node("(", bundle.key, [Item(x.node, x.least, x.most) for x in items]), 1, 1, [bundle])


def squares(items: list[Item]) -> list[Item]:
    """Bodies of 2 to PERIOD items that repeat directly behind each other as repeated groups."""
    out, i = [], 0
    keys = [x.key for x in items]
    while i < len(items):
        for p in range(2, PERIOD + 1):
            if i + p < len(keys) and keys[i] == keys[i + p]:
                n = 1
                while keys[i + n * p : i + (n + 1) * p] == keys[i : i + p]:
                    n += 1
                if n > 1:
                    first = group(items[i : i + p])
                    for k in range(1, n):
                        more = group(items[i + k * p : i + (k + 1) * p])
                        first = Item(merge(first.node, more.node, False), 1, k + 1, first.members + more.members)
                    out.append(first)
                    i += n * p
                    break
        else:
            out.append(items[i])
            i += 1
    return out


def merge(a: Node | Slot, b: Node | Slot, pages: bool = True) -> Node | Slot:
    """Two nodes as one, of two wrappers (then their pages add up) or of one page."""
    if isinstance(a, Slot):
        return Slot(a.constant if a.constant == b.constant else None, a.pages + b.pages if pages else a.pages, a.chars + b.chars, a.links + b.links)
    if len(a.items) == len(b.items) == 1 and a.key == b.key and a.items[0].key == b.items[0].key and not (a.general or b.general or a.flat or b.flat):
        items = [joined(a.items[0], b.items[0], pages)]
        return Node(a.tag, a.key, items, a.pages + b.pages, a.asides + b.asides, a.mains + b.mains) if pages else Node(a.tag, a.key, items, a.pages, max(a.asides, b.asides), max(a.mains, b.mains))
    add = (lambda x, y: x + y) if pages else max
    general, flat = a.general or b.general, a.flat or b.flat
    items = [Item(summed([*a.items, *b.items]))] if flat else align(a.items, b.items, pages, general)
    general = general or len(items) > WIDE
    if general and not flat:
        items = by_tag(items)
    key = a.key if a.key == b.key else key_of(a.tag, "", items)
    return Node(a.tag, key, items, add(a.pages, b.pages), add(a.asides, b.asides), add(a.mains, b.mains), general, flat)


def joined(a: Item, b: Item, pages: bool) -> Item:
    if pages:
        return Item(merge(a.node, b.node), min(a.least, b.least), max(a.most, b.most))
    return Item(merge(a.node, b.node, False), min(a.least, b.least), max(a.most, b.most), (a.members or []) + (b.members or []) or None)


def by_tag(items: list[Item]) -> list[Item]:
    """One optional, repeated item a tag, by tag: however unlike the items are, they are no more than tags."""
    out: dict[str, Item] = {}
    for x in items:
        if x.node.tag not in out:
            out[x.node.tag] = Item(x.node, 0, max(2, x.most), x.members)
        else:
            have = out[x.node.tag]
            out[x.node.tag] = Item(merge(have.node, x.node, False), 0, max(2, have.most + x.most), (have.members or []) + (x.members or []) or None)
    for x in out.values():
        if isinstance(x.node, Node):
            x.node = Node(x.node.tag, x.node.tag, x.node.items, x.node.pages, x.node.asides, x.node.mains, x.node.general, x.node.flat)
    return [out[t] for t in sorted(out)]


def summed(items: list[Item]) -> Slot:
    out = Slot(None, 0, 0, 0)
    for x in items:
        s = x.node if isinstance(x.node, Slot) else summed(x.node.items)
        out = Slot(None, max(out.pages, s.pages), out.chars + s.chars, out.links + s.links)
    return out


def pair(xs: list[Item], ys: list[Item], general: bool = False) -> tuple[list[Item], list[Item], list[tuple[int, int]]]:
    """Which items of two sequences stand for each other: first those of equal key, then between these those of equal
    tag, both in order.  Items that equal a group's body on the other side are bundled first."""
    if general:
        xs, ys = by_tag(xs), by_tag(ys)
    a, b = [x.key for x in xs], [y.key for y in ys]
    if a == b:
        return xs, ys, [(i, i) for i in range(len(a))]
    for mine, other in ((xs, ys), (ys, xs)):
        for g in mine:
            if g.node.tag == "(":
                other[:] = bundled(other, [x.key for x in g.node.items], g.key)
    a, b = [x.key for x in xs], [y.key for y in ys]
    out, i, j = [], 0, 0
    for x, y, n in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        if x > i and y > j:
            tags_a, tags_b = [z.node.tag for z in xs[i:x]], [z.node.tag for z in ys[j:y]]
            for u, v, m in SequenceMatcher(None, tags_a, tags_b, autojunk=False).get_matching_blocks():
                out += [(i + u + k, j + v + k) for k in range(m) if tags_a[u + k] != "("]
        out += [(x + k, y + k) for k in range(n)]
        i, j = x + n, y + n
    return xs, ys, out


def bundled(items: list[Item], body: list[str], key: str) -> list[Item]:
    out, i, n = [], 0, len(body)
    keys = [x.key for x in items]
    while i < len(items):
        if keys[i : i + n] == body:
            out.append(group(items[i : i + n]))
            i += n
        else:
            out.append(items[i])
            i += 1
    return out


def align(xs: list[Item], ys: list[Item], pages: bool = True, general: bool = False) -> list[Item]:
    """One sequence of items that both match; what stands on one side only is optional."""
    xs, ys, pairs = pair(list(xs), list(ys), general)
    out: list[Item] = []
    i = j = 0

    def lone(some: list[Item]) -> None:
        for x in some:
            if out and out[-1].key == x.key and x.key != "#":
                out[-1] = Item(merge(out[-1].node, x.node, False), out[-1].least, out[-1].most + x.most, (out[-1].members or []) + (x.members or []) or None)
            else:
                out.append(Item(x.node, 0, x.most, x.members))

    for u, v in [*pairs, (len(xs), len(ys))]:
        lone(xs[i:u])
        lone(ys[j:v])
        if u < len(xs):
            out.append(joined(xs[u], ys[v], pages))
        i, j = u + 1, v + 1
    return out


def size(node: Node | Slot) -> int:
    return 1 if isinstance(node, Slot) else 1 + sum(size(x.node) for x in node.items)


def flattened(node: Node, depth: int) -> Node:
    if depth == 0:
        return Node(node.tag, node.key, [Item(summed(node.items))], node.pages, node.asides, node.mains, node.general, True)
    return Node(node.tag, node.key, [Item(x.node if isinstance(x.node, Slot) else flattened(x.node, depth - 1), x.least, x.most) for x in node.items], node.pages, node.asides, node.mains, node.general, node.flat)


def bounded(node: Node) -> Node:
    """A wrapper of at most LIMIT elements and slots: the deepest levels are summed up until it is."""
    depth = DEPTH
    while size(node) > LIMIT and depth:
        depth = depth // 2
        node = flattened(node, depth)
    return node


def add_page(wrapper: Node | None, page: Node) -> Node:
    """The wrapper of a wrapper and one page more (or of two wrappers)."""
    return bounded(page if wrapper is None else merge(wrapper, page))


#: Pages that must show a text unchanged in one slot for it to be part of the template.
TEMPLATE_PAGES = 3
#: Share of an element's varying text that a part of it must hold to be taken for the whole, weight of a part that its
#: marks call an aside, and of one they call the main part; links make a menu of a part from that share on.
DESCEND, ASIDE_WEIGHT, MAIN_WEIGHT, MENU = 0.5, 0.1, 4.0, 0.8


def choose(wrapper: Node, least: int = TEMPLATE_PAGES) -> Node:
    """Mark in ``wrapper`` what is the article (``keep``) and what is not (``drop``).

    From the root, the part that holds most of the varying unlinked text is taken as long as it holds ``DESCEND`` of
    it; marks only weigh.  A varying main heading beside the way is kept as well.  Inside the article, texts that never
    vary are dropped, and menus where nothing is marked as the main part.  Where nothing varies at all every text counts as
    varying."""

    def live(s: Slot) -> bool:
        return s.constant is None or s.pages < least

    def mass(node: Node | Slot, all_live: bool) -> float:
        if isinstance(node, Slot):
            return float(node.chars - node.links) if all_live or live(node) else 0.0
        total = sum(mass(x.node, all_live) for x in node.items)
        return total * ASIDE_WEIGHT if 2 * node.asides > node.pages else total

    def links(node: Node | Slot) -> tuple[int, int]:
        if isinstance(node, Slot):
            return node.links, node.chars
        parts = [links(x.node) for x in node.items]
        return sum(a for a, _ in parts), sum(b for _, b in parts)

    every = mass(wrapper, False) == 0

    def trim(node: Node, named: bool) -> None:
        for x in node.items:
            if isinstance(x.node, Slot):
                x.drop = not (every or live(x.node))
            else:
                a, b = links(x.node)
                x.drop = not named and b > 0 and a >= MENU * b and x.node.tag not in TEXTUAL
                if not x.drop:
                    trim(x.node, named)

    def headings(node: Node) -> None:
        """Keep the varying main headings below a part that is not taken."""
        for x in node.items:
            if isinstance(x.node, Node) and 2 * x.node.asides <= x.node.pages:
                if x.node.tag == "h1" and x.most == 1:
                    if mass(x.node, every) > 0:
                        x.node.keep = True
                        trim(x.node, True)
                else:
                    headings(x.node)

    node, named = wrapper, False
    while not (node.flat or node.tag == "article" or node.general):
        parts = [x.node for x in node.items if isinstance(x.node, Node) and x.most == 1 and x.node.tag in HELD]
        weigh = lambda p: mass(p, every) * (MAIN_WEIGHT if 2 * p.mains > p.pages else 1.0)
        best = max(parts, key=weigh, default=None)
        if best is None:
            break
        rest = mass(node, every) - mass(best, every)
        if not weigh(best) or weigh(best) < DESCEND * (weigh(best) + rest) or (named and 2 * best.mains <= best.pages):
            break
        for x in node.items:
            if x.node is not best and isinstance(x.node, Node):
                headings(Node("", "", [x]))
        node, named = best, named or 2 * best.mains > best.pages
    node.keep = True
    trim(node, named)
    return wrapper


def extract(page: Element, wrapper: Node) -> list[Text]:
    """The texts of a page that its wrapper, marked by ``choose``, keeps; in page order."""
    out: list[Text] = []

    def walk(e: Element, node: Node, inside: bool) -> None:
        inside = inside or node.keep
        keeps, drops = node.told()
        if inside and (node.flat or not drops):
            for k in e.kids:
                out.extend(texts_of(k))
        if node.flat or (not drops if inside else not keeps):
            return
        xs, ys, pairs = pair(list(node.items), list(outline(e)), node.general)
        met = dict((v, u) for u, v in pairs)
        for v, y in enumerate(ys):
            x = xs[met[v]] if v in met else None
            for member in y.members:
                if x is None:
                    if inside:
                        out.extend(texts_of(member))
                elif isinstance(member, Text):
                    if inside and not x.drop:
                        out.append(member)
                elif not x.drop and not (inside and member.aside):
                    walk(member, x.node, inside)

    walk(page, wrapper, False)
    out.sort(key=lambda t: t.at)
    return out


def pack(node: Node) -> str:
    def plain(x: Item) -> list:
        n = x.node
        if isinstance(n, Slot):
            return [x.least, x.most, int(x.drop), n.constant, n.pages, n.chars, n.links]
        return [x.least, x.most, int(x.drop), n.tag, n.key, n.pages, n.asides, n.mains, int(n.general), int(n.flat), int(n.keep), [plain(y) for y in n.items]]

    return json.dumps(plain(Item(node)), separators=(",", ":"))


def unpack(text: str) -> Node:
    def item(x: list) -> Item:
        if len(x) == 7:
            return Item(Slot(*x[3:]), x[0], x[1], None, bool(x[2]))
        return Item(Node(x[3], x[4], [item(y) for y in x[11]], x[5], x[6], x[7], bool(x[8]), bool(x[9]), bool(x[10])), x[0], x[1], None, bool(x[2]))

    return item(json.loads(text)).node
