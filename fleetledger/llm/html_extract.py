"""Main text of pages by union-free wrappers: token streams of same-host pages are aligned into one expression with slots, options and repeats.

A wrapper is a stream of tokens like a page's: tags, texts, and groups of them, each of which may be optional or repeated.
Aligning two streams level by level keeps what both have; texts that differ become slots, equal ones stay part of the
template; what one lacks becomes optional, what comes again is folded into repeats. Alternatives don't exist. Wrappers of
wrappers are made the same way, so a host's pages are merged within tasks, then level by level. The wrapper then says
where a host's articles stand and which texts there are the template's.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag ends an open element of these names, up to the nearest element of those.
CLOSES = {"p": ({"p"}, {"button", "table", "td", "th"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "figcaption"}
#: Elements that never hold an article's own text, and words in class or role that say so of blocks. Headings, inline
#: elements, html, body and main are judged by no name. Words of _MAYBE are names of article sections as well: of such
#: blocks the host's wrapper is asked, too.
SKIP = frozenset("nav header footer aside form script style noscript iframe template textarea title head button select menu dialog svg object".split())
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|banner|container)|advert\w*|breadcrumbs?"
    r"|comments?|comment(?:list|form|box|area|section|thread)|replies|respond|cookies?|consent"
    r"|(?:page|site)?footer|(?:page|site)?header|masthead|menu|modal|(?:main|side|sub|site|top)?nav|navbar|navigation"
    r"|newsletter|pagination|popup|side[_-]?bar|sponsor\w*|subscribe"
    r"|toolbar|widget|complementary|contentinfo)(?:$|[\s_-])",
    re.IGNORECASE,
)
_MAYBE = re.compile(
    r"(?:^|[\s_-])(?:alerts?|announcements?|banner|disclaimer|discussion|notices?|promo\w*|related|search|share|sharing|social)(?:$|[\s_-])",
    re.IGNORECASE,
)
NAMED = BLOCKS - {"html", "body", "main", "hr", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Ids are often made from headings: they count as a whole, on plain containers, and not if they could be a heading's text.
HOLDERS = frozenset("div aside ul ol menu dl table center fieldset details".split())
_BOILER_ID = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|reader|user|cookie)[_-]?)?"
    r"(?:ads?|ad(?:box|slot|unit|banner|container)|breadcrumbs?|comments?|comment[_-]?(?:list|form|box|area|section|thread)|respond"
    r"|cookies?|cookie[_-]?(?:banner|notice|consent)|footer|header|masthead|menu|nav|navbar|navigation|newsletter|pagination"
    r"|popup|modal|side[_-]?bar|toolbar|(?:share|social|search|related)[_-](?:box|bar|buttons?|links?|icons?|form|posts?|articles?))"
    r"(?:[_-]?(?:area|wrap|wrapper|container|inner|left|right|primary|secondary|\d+))?",
    re.IGNORECASE,
)
_SECTION = re.compile(r"(?<!\S)section(?!\S)", re.IGNORECASE)
#: Names of an article's own header.
_OWN_HEADER = re.compile(r"(?<!\S)(?:entry|post|article|story|content|section)[_-]header(?!\S)", re.IGNORECASE)
_PLAIN_HEADER = re.compile(r"(?<!\S)(?:page[_-]?)?header(?!\S)", re.IGNORECASE)
#: Names of layouts, such as has-sidebar, say what stands beside an element and not what it is.
_BESIDE = re.compile(r"(?<!\S)(?:has|no|with|without)[_-]\S+", re.IGNORECASE)
#: A quotation mark begins a value only after an equals sign.
_ATTRIBUTES = r"(?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>?|([^<]+|<)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S*))")
_MARK = re.compile(r"(?<![\w:.-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_BARE_SLASH = re.compile(r"=\s*(?:[^\s\"']\S*)?/$")
_MAIN = re.compile(r"\b(?:main|article)\b")
#: Pages that share over so many times the characters in which they differ are copies.
COPIES = 4
#: A class, id or role that is on less than one of so many pages of its host, or on one page only, is no layout's.
RARE = 20
_DIGITS = re.compile(r"\d+")
#: Pages of one host that a task aligns at one time, so that what some of them share is known from the start, and tokens
#: that a task reads before it passes its wrappers on.
TOGETHER, WAITING = 16, 2_000_000
#: Wrappers of one host merged in one call, and characters of rules that may be broadcast.
FAN_IN, BROADCAST_CHARS = 64, 16_000_000


class Element:
    """marks: class, id and role for the key; names: class and role; inside: in an article, a section or the main element.

    links: how many it holds; texted: whether it holds text outside links. The key of what holds links only ends with @,
    and ! stands in the key of what may be no part of an article by its name.
    """

    __slots__ = ("name", "marks", "names", "ident", "inside", "items", "links", "texted")

    def __init__(self, name: str, marks: str = "", names: str = "", ident: str = "", inside: bool = False) -> None:
        self.name, self.marks, self.names, self.ident, self.inside, self.items = name, marks, names, ident, inside, []
        self.links, self.texted = 0, False

    @property
    def key(self) -> str:
        return f"{self.name}{' ' if self.marks else ''}{self.marks}{'!' if self.maybe() else ''}{'@' if self.links > 1 and not self.texted else ''}"

    def maybe(self) -> bool:
        """A name that both articles' sections and boilerplate have."""
        return bool(self.names) and (self.name in NAMED or "-" in self.name) and bool(_MAYBE.search(_BESIDE.sub("", self.names)))

    def boiler(self) -> bool:
        own = self.name == "header" and self.inside
        if self.name in SKIP and not own:
            return True
        if not (self.names or self.ident) or not (self.name in NAMED or "-" in self.name):
            return False
        names = _OWN_HEADER.sub("", _BESIDE.sub("", self.names))
        if _BOILER.search(_PLAIN_HEADER.sub("", names) if own else names):
            return True
        return self.name in HOLDERS and not _SECTION.search(names) and bool(_BOILER_ID.fullmatch(self.ident))


def masked(mark: str) -> str:
    return _DIGITS.sub("0", mark)


def layout(marks: str, kept: frozenset[str]) -> str:
    """The marks that are in kept, as they are or with their digits masked."""
    return " ".join(v if v in kept else masked(v) for v in marks.split() if v in kept or masked(v) in kept)


def parse(page: str, kept: frozenset[str] | None = None) -> Element:
    """The element tree of a page; texts are strings among the items. Missing end tags are supplied, stray ones ignored.

    Keys of elements have only the marks in kept; all marks without it.
    """
    root = Element("#page")
    stack, at, n = [root], 0, len(page)
    where: dict[str, list[int]] = {}  # depths of the open elements of each name, and of all blocks: no tag searches the stack
    blocks = [0]

    def close(depth: int) -> None:
        for _ in range(len(stack) - depth):
            e = stack.pop()
            where[e.name].pop()
            if e.name in BLOCKS:
                blocks.pop()
            stack[-1].links += e.links + (e.name == "a")
            stack[-1].texted |= e.texted and e.name != "a"

    def last(names: set[str]) -> int:
        return max((where[k][-1] for k in names if where.get(k)), default=0)

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None:
            stack[-1].items.append(m[4])
            stack[-1].texted = stack[-1].texted or not m[4].isspace()
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if where.get(name):
                close(where[name][-1])
            continue
        if name in CLOSES:
            own, fence = CLOSES[name]
        elif name in ENDS_P:
            own, fence = CLOSES["p"]
        else:
            own, fence = (), ()
        if own:
            fenced = last(fence) if name in ("tr", "td", "th") else max(last(fence), blocks[-1])
            if (mine := last(own)) and mine >= fenced:
                close(mine)
        found = sorted((k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3]) if k.lower() in ("class", "id", "role")) if "=" in m[3] else []
        marks, names = " ".join(v for _, v in found), " ".join(v for k, v in found if k != "id")
        marks = marks if kept is None else layout(marks, kept)
        inside = name == "header" and bool(where.get("article") or where.get("main") or where.get("section"))
        e = Element(name, marks, names, next((v.strip() for k, v in found if k == "id"), ""), inside)
        stack[-1].items.append(e)
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>]|$)", re.IGNORECASE).search(page, at)
            e.items.append(page[at : end.start() if end else n])
            at = n if not end else (page.find(">", end.end()) + 1 or n)
        elif name not in VOID and not (m[3].endswith("/") and not _BARE_SLASH.search(m[3])):
            where.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                blocks.append(len(stack))
            stack.append(e)
    close(1)
    return root


# A wrapper is a stream of tokens: a start tag ["<", key, optional, repeated, pages], the end ">" of it, a text ["#", hash or
# None for a slot, optional, repeated, pages, characters], a group ["(", optional, repeated, pages] and its end ")". pages: on
# how many pages the token was met. A page is a wrapper of one page. The first token is the page itself.
#
# While streams are aligned, one level at a time, what stands between a start tag and its end is an item
# [shape, optional, repeated, pages, hash, characters, inside]: shape is what must agree for two items to be one; hash is
# that of its constant content or None; inside lists the stretches of streams that it stands for, or a group's items.


def stream_of(root: Element) -> list:
    """The token stream of a page, without what never holds an article's text."""
    out: list = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            out.append(">")
        elif isinstance(x, str):
            if text := " ".join(x.split()):
                out.append(["#", hash_of(text), 0, 0, 1, len(text)])
        elif x is root or not (x.name in RAW or x.name in VOID or x.boiler()):
            out.append(["<", x.key, 0, 0, 1])
            todo.append(None)
            todo += reversed(x.items)
    return out


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def indexed(stream: list) -> tuple[list, list[int], list[int | None]]:
    """The stream, where the element or group that starts at each place ends, and the hash of its content if all of that is constant."""
    ends, hashes, todo = [0] * len(stream), [None] * len(stream), [[]]
    starts: list[int] = []
    for i, t in enumerate(stream):
        if isinstance(t, str):
            inner, start = todo.pop(), starts.pop()
            ends[start] = i
            known = None if None in inner or stream[start][0] == "(" else hash((stream[start][1], *inner))
            hashes[start] = known
            todo[-1].append(None if known is None or any(stream[start][2:4]) else known)
        elif t[0] == "#":
            hashes[i] = t[1]
            todo[-1].append(None if t[2] or t[3] else t[1])
        else:
            starts.append(i)
            todo.append([])
    return stream, ends, hashes


def level(stretch: tuple) -> list[list]:
    """The items of one level."""
    (stream, ends, hashes), at, end = stretch
    out = []
    while at < end:
        t = stream[at]
        if t[0] == "#":
            out.append(["#", t[2], t[3], t[4], t[1], t[5], []])
            at += 1
            continue
        if t[0] == "<":
            out.append([t[1], t[2], t[3], t[4], hashes[at], 0, [((stream, ends, hashes), at + 1, ends[at])]])
        else:
            out.append(group(level(((stream, ends, hashes), at + 1, ends[at])), *t[1:]))
        at = ends[at] + 1
    return out


def group(items: list[list], optional: int, repeated: int, pages: int) -> list:
    return ["(" + "|".join(x[0] for x in items), optional, repeated, pages, None, 0, items]


def joined(x: list, y: list, again: bool = False) -> list:
    """One item that stands for either, of equal shape; again: both are on one page."""
    inside = [joined(p, q, again) for p, q in zip(x[6], y[6], strict=True)] if x[0][:1] == "(" else x[6] + y[6]
    known = x[4] if x[4] == y[4] else None
    if again:
        return [x[0], x[1] & y[1], x[2] | y[2], max(x[3], y[3]), known, x[5] + y[5], inside]
    return [x[0], x[1] | y[1], x[2] | y[2], x[3] + y[3], known, x[5] + y[5], inside]


def repeat(x: list, y: list) -> list:
    out = joined(x, y, again=True)
    out[2] = 1
    return out


def anchored(x: list, shared: set | frozenset) -> bool:
    """Is the item a constant that several pages have? Such items are no part of repeats."""
    return x[4] is not None and (x[3] > 1 or x[4] in shared)


def folded(items: list[list], shared: set | frozenset) -> list[list]:
    """Neighbours of one shape, and rows of any length that come again, become repeats."""
    out: list[list] = []
    where = defaultdict(list)  # places in out of items, or of groups that end with one, by shape
    for x in items:
        if anchored(x, shared):
            out.append(x)
            continue
        if out and out[-1][0] == x[0] and not anchored(out[-1], shared):
            out[-1] = repeat(out[-1], x)
            continue
        out.append(x)
        last = len(out) - 1
        for j in reversed(where[x[0]]):
            if j >= last:
                continue
            before, row = out[j], out[j + 1 :]
            if before[0][:1] == "(" and [y[0] for y in before[6]] == [y[0] for y in row]:
                out[j:] = [repeat(before, group(row, 0, 1, max(y[3] for y in row)))]
                break
            n = last - j
            if n > 1 and j + 1 >= n and before[0] == x[0] and [y[0] for y in out[j + 1 - n : j + 1]] == [y[0] for y in row] and not any(anchored(y, shared) for y in out[j + 1 - n :]):
                rows = [group(out[j + 1 - n : j + 1], 0, 1, max(y[3] for y in row)), group(row, 0, 1, max(y[3] for y in row))]
                out[j + 1 - n :] = [repeat(*rows)]
                break
        where[x[0]].append(len(out) - 1)
    return out


def anchors(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Pairs of equal constants that each level has once, as many as are in the same order in both."""
    once = [{h: i for i, x in enumerate(level_) if (h := x[4]) is not None and counts[h] == 1} for level_ in (a, b) for counts in (Counter(x[4] for x in level_),)]
    found = [(i, once[1][h]) for h, i in once[0].items() if h in once[1] and a[i][0] == b[once[1][h]][0]]
    tails: list[int] = []  # of the ascending runs of each length, the one with the smallest end
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(found):
        at = bisect_left(ends, j)
        back.append(tails[at - 1] if at else -1)
        tails[at:at + 1] = [k]
        ends[at:at + 1] = [j]
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(found[k])
        k = back[k]
    return out[::-1]


def between(a: list[list], b: list[list], both: set | frozenset) -> list[tuple[int | None, int | None]]:
    """Items of two levels in order, paired where their shapes agree so that the pairs are worth most."""

    def worth(x: list, y: list) -> int:
        if x[0] != y[0]:
            return 0
        if x[4] is not None and x[4] == y[4]:
            return 8
        return 1 if anchored(x, both) or anchored(y, both) else 2

    if len(a) == len(b) and all(worth(x, y) > 1 for x, y in zip(a, b, strict=True)):
        return [(i, i) for i in range(len(a))]
    wide = len(b)
    moves, below_ = bytearray(len(a) * wide), [0] * (wide + 1)
    for i in range(len(a) - 1, -1, -1):
        row = [0] * (wide + 1)
        for j in range(wide - 1, -1, -1):
            w = worth(a[i], b[j])
            best = max(below_[j], row[j + 1], below_[j + 1] + w if w else 0)
            row[j] = best
            moves[i * wide + j] = 0 if w and best == below_[j + 1] + w else 1 if best == below_[j] else 2
        below_ = row
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    while i < len(a) or j < wide:
        move = 1 if j == wide else 2 if i == len(a) else moves[i * wide + j]
        out.append((None if move == 2 else i, None if move == 1 else j))
        i, j = i + (move != 2), j + (move != 1)
    return out


def align(a: list[list], b: list[list], shared: set | frozenset) -> list[list]:
    """Two levels of items as one, however wide: constants that both have once part them; between those, equal constants
    first, then equal shapes, in order; texts that differ become slots, what one lacks is optional."""
    both = {x[4] for x in a if x[4] is not None} & {x[4] for x in b if x[4] is not None} | shared
    a, b = folded(a, both), folded(b, both)
    out: list[list] = []
    i = j = 0
    parts = [] if [x[0] for x in a] == [x[0] for x in b] else anchors(a, b)
    for to_i, to_j in (*parts, (len(a), len(b))):
        for x, y in between(a[i:to_i], b[j:to_j], both):
            if x is not None and y is not None:
                out.append(joined(a[i + x], b[j + y]))
            else:
                z = a[i + x] if x is not None else b[j + y]
                out.append([z[0], 1, *z[2:]])
        if to_i < len(a):
            out.append(joined(a[to_i], b[to_j]))
        i, j = to_i + 1, to_j + 1
    return folded(out, both)


def merge(streams: list[list]) -> list:
    """The wrapper of wrappers, aligned one after the other from the outermost level inwards."""
    if len(streams) == 1:
        return streams[0]
    parts = [indexed(s) for s in streams]
    met = Counter(h for _, _, hashes in parts for h in {h for h in hashes if h is not None})
    shared = frozenset(h for h, n in met.items() if n > 1)
    out: list = []
    todo: list = [("in", [(p, 0, len(p[0])) for p in parts], sum(s[0][4] for s in streams))]
    while todo:
        kind, x, pages = todo.pop()
        if kind == "out":
            out.append(x)
            continue
        if kind == "in":
            items = level(x[0])
            for stretch in x[1:]:
                items = align(items, level(stretch), shared)
        else:
            items = x
        for shape, optional, repeated, n, known, chars, inside in reversed(items):
            n = min(n, pages)
            if shape == "#":
                todo.append(("out", ["#", known, optional, repeated, n, chars], n))
            elif shape[:1] == "(":
                todo += [("out", ")", n), ("items", inside, n), ("out", ["(", optional, repeated, n], n)]
            else:
                todo += [("out", ">", n), ("in", inside, n), ("out", ["<", shape, optional, repeated, n], n)]
    return out


def below(place: int, key: str) -> int:
    """The number of a path of keys that is one longer."""
    return xxhash.xxh64_intdigest(f"{place:x}/{key}".encode("utf-8", "surrogatepass"))


def rule(wrapper: list) -> dict:
    """What a wrapper says of its pages: paths, the keys from the page to the main elements; drop, texts of the template
    there; menus, paths of menus there; named, paths of blocks that are boilerplate by name and by content.

    A text is the template's if over half of the pages have it in one place, two at least. The main elements are all
    <article> if the wrapper has one, else <main>: the page says itself what its article is, and no text in it is dropped.
    Else the main element is found by going down while one child's slots hold most characters outside links. There, the
    template's texts and the menus go that stand before the first slot (and its heading) or after the last: between slots
    they are the article's headings and lists. A block whose name both articles and boilerplate have goes if there is no
    slot outside links in it. Where constants have over COPIES times the slots' characters the pages are copies of each
    other, and constants are text like any other.
    """
    pages = wrapper[0][4]
    n = len(wrapper)
    slots, constant, parent, ends = [0] * n, [0] * n, [-1] * n, [0] * n
    place, inner = [0] * n, [False] * n  # inner: in a link
    texts, starts, todo = [], [], []
    for i, t in enumerate(wrapper):
        up = todo[-1] if todo else -1
        if isinstance(t, str):
            at = todo.pop()
            ends[at] = i
            if (up := todo[-1] if todo else -1) >= 0:
                for sums in (slots, constant):
                    sums[up] += sums[at]
            continue
        parent[i] = up
        inner[i] = up >= 0 and inner[up]
        if t[0] == "#":
            fixed = t[1] is not None and t[4] > 1 and 2 * t[4] > pages
            if fixed:
                texts.append((i, below(place[up], f"#{t[1]}")))
            if fixed or not inner[i]:
                (constant if fixed else slots)[up] += t[5]
            continue
        todo.append(i)
        place[i] = place[up] if t[0] == "(" else below(place[up] if up >= 0 else 0, t[1])
        if t[0] == "<":
            starts.append(i)
            inner[i] = inner[i] or t[1].split(" ")[0] == "a"

    def path_to(i: int) -> list[str]:
        keys = []
        while i > 0:
            if wrapper[i][0] == "<":
                keys.append(wrapper[i][1])
            i = parent[i]
        return keys[::-1]

    # a place is one for all elements with these keys: any slot in one of them keeps all
    unsure = {place[i] for i in starts if "!" in wrapper[i][1][-2:]} if pages > 1 else set()
    told = {"named": sorted(unsure - {place[i] for i in starts if slots[i]})}
    if pages < 2:
        told["named"] = None
    named = []
    for i in starts:
        name, _, marks = wrapper[i][1].rstrip("!@").partition(" ")
        if (name in ("article", "main") or _MAIN.search(marks)) and slots[i] + (name == "article") > 0:
            named.append((name == "article", slots[i], i))
    if named:
        articles = [x for x in named if x[0]]
        if not articles:
            most = max(x[1] for x in named)
            articles = [(0, 0, max((i for _, k, i in named if k == most), key=path_to))]
        return {"paths": sorted({tuple(path_to(i)) for _, _, i in articles}), "drop": [], "menus": [], **told}
    children = defaultdict(list)
    for i in starts[1:]:
        up = parent[i]
        while wrapper[up][0] == "(":
            up = parent[up]
        children[up].append(i)
    path: list[str] = []
    here = [0]
    while True:
        by_key: Counter = Counter()
        for i in here:
            for c in children[i]:
                by_key[wrapper[c][1]] += slots[c]
        key, most = max(by_key.items(), key=lambda kv: kv[1], default=("", 0))
        if not most or key.rstrip("!@").split(" ")[0] in ("p", "table", "ul", "ol") or most * 10 < 7 * sum(slots[i] for i in here):
            break
        path.append(key)
        here = [c for i in here for c in children[i] if wrapper[c][1] == key]
    paths = [path] if path else []
    if sum(constant[i] for i in here) > COPIES * sum(slots[i] for i in here):
        return {"paths": paths, "drop": [], "menus": [], **told}
    fixed_at = {i for i, _ in texts}
    outer: list[tuple[int, int]] = []  # stretches before the first slot and after the last
    within = lambda i: any(h < i < ends[h] for h in here)
    own = [i for i in range(here[0], ends[here[-1]]) if wrapper[i][0] == "#" and i not in fixed_at and not inner[i] and within(i)]
    if own:
        first = own[0]
        for i in range(own[0] - 1, here[0], -1):  # a heading right before the first slot is its heading
            if wrapper[i][0] == "#":
                if not re.match(r"h[1-6]\b", wrapper[parent[i]][1] if wrapper[parent[i]][0] == "<" else ""):
                    break
                first = i
        outer = [(here[0], first), (own[-1], ends[here[-1]])]
    margin = lambda i: within(i) and any(low < i < high for low, high in outer)
    rows = [i for i in starts if wrapper[i][1][-1] == "@" and within(i)]
    menus = {place[i] for i in rows} - {place[i] for i in rows if not margin(i)}
    return {"paths": paths, "drop": sorted({k for i, k in texts if margin(i)} - {k for i, k in texts if not margin(i)}), "menus": sorted(menus), **told}


@dataclass(frozen=True)
class Rule:
    """paths, drop, menus and named of rule(), and the host's marks. named is None where one page is all there is: the names decide then."""

    paths: tuple[tuple[str, ...], ...] = ()
    drop: frozenset[int] = frozenset()
    menus: frozenset[int] = frozenset()
    named: frozenset[int] | None = frozenset()
    kept: frozenset[str] | None = None


def main_text(root: Element, found: Rule) -> str:
    """Blocks of all elements at the rule's paths, in the page's order, without the template's texts, menus and named
    blocks; else of the page's own articles, main elements or body."""
    start = below(0, root.key)
    places = _at_paths(root, found.paths, start)
    told = bool(found.drop or found.menus)
    if not places:
        places = _own(root, start) if found.paths or not told else [(root, start)]
        told = told and not found.paths
    placed = told or bool(found.named)  # else no place is asked for
    blocks: list[list[str]] = [[]]

    for p, at in places:
        blocks.append([])
        todo: list[tuple] = [(x, at) for x in reversed(p.items)]
        while todo:
            x, up = todo.pop()
            if x is None:
                blocks.append([])
            elif isinstance(x, str):
                if not told or below(up, f"#{hash_of(' '.join(x.split()))}") not in found.drop:
                    blocks[-1].append(entities.unescape(x))
            elif x.boiler() or x.name == "br":
                blocks[-1].append(" ")
            elif x.name not in RAW:
                here = below(up, x.key) if placed else 0
                if (told and here in found.menus) or (x.maybe() and (found.named is None or here in found.named)):
                    blocks[-1].append(" ")
                    continue
                if x.name in BLOCKS:
                    blocks.append([])
                    todo.append((None, 0))
                todo += [(y, here) for y in reversed(x.items)]
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def _at_paths(root: Element, paths: tuple[tuple[str, ...], ...], start: int) -> list[tuple[Element, int]]:
    """The outermost elements at any of the paths, in the page's order, with their place."""
    found, todo = [], [(root, start, paths)]
    while todo:
        e, at, left = todo.pop()
        if any(not p for p in left):
            found.append((e, at))
            continue
        for x in reversed(e.items):
            if isinstance(x, Element) and not x.boiler() and (more := tuple(p[1:] for p in left if p[0] == x.key)):
                todo.append((x, below(at, x.key), more))
    return found


def _own(root: Element, start: int) -> list[tuple[Element, int]]:
    for wanted in ("article", "main", "body"):
        found, todo = [], [(root, start)]
        while todo:
            e, at = todo.pop()
            if e.name == wanted:
                found.append((e, at))
            else:
                todo += [(x, below(at, x.key)) for x in reversed(e.items) if isinstance(x, Element) and not (wanted != "body" and x.boiler())]
        if found:
            return found
    return [(root, start)]


def common_marks(pages: DataFrame) -> DataFrame:
    """(host, kept): for every host with two pages or more, the classes, ids and roles of its layout as a JSON list.

    Counted with and without masked digits. A host has at most RARE times as many of them as a page has marks.
    """

    def rows(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["host", "mark", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in slices(batches):
            for h, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = {v for _, x, y, z in _MARK.findall(t.as_py() or "") for v in (x or y or z).split()}
                n.update((h, v) for v in found | {masked(v) for v in found})
                n[h, ""] += 1  # the page itself
                if len(n) > 50_000:
                    yield rows(n)
                    n = Counter()
        yield rows(n)

    counts = cut(pages.select("host", "html").mapInArrow(count, "host string, mark string, n long").groupBy("host", "mark").agg(F.sum("n").alias("n")).where("n > 1"), "html-marks")
    hosts = counts.where("mark = ''").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    both = hosts.join(counts.where("mark <> ''"), (F.col("host") == F.col("of")) & (F.col("n") * RARE >= F.col("pages")), "left")
    return both.groupBy(F.col("of").alias("host")).agg(F.to_json(F.sort_array(F.collect_list("mark"))).alias("kept"))


def noted(pages: DataFrame, notes: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[str | None]]]:
    """pages, and what reads the notes (host, text) of a batch's rows: broadcast if they measure at most BROADCAST_CHARS, else joined."""
    host, note = notes.columns
    if (notes.agg(F.sum(F.length(host) + F.length(note))).first()[0] or 0) <= BROADCAST_CHARS:
        shared = pages.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in notes.collect()})
        return pages, lambda b: [shared.value.get(h) for h in b.column("host").to_pylist()]
    own = notes.toDF("note_host", "note")
    return pages.join(own, F.col("host") == F.col("note_host"), "left").drop("note_host"), lambda b: b.column("note").to_pylist()


@lru_cache(256)
def kept_of(note: str | None) -> frozenset[str] | None:
    return None if note is None else frozenset(json.loads(note))


@lru_cache(256)
def rule_of(note: str | None) -> Rule:
    if note is None:
        return Rule()
    own, kept = json.loads(note)
    named = own["named"]
    return Rule(tuple(map(tuple, own["paths"])), frozenset(own["drop"]), frozenset(own["menus"]), None if named is None else frozenset(named), None if kept is None else frozenset(kept))


def wrappers(pages: DataFrame, kept: DataFrame) -> DataFrame:
    """(host, wrapper): the wrapper of all pages (host, html) of every host; kept: common_marks of them.

    Keys have no marks but the layout's, so a wrapper's size is bounded by the layout and not by the number of pages.
    Tasks merge the pages that they read and nothing but wrappers is shuffled; then at most FAN_IN wrappers of a host
    are merged in a call, level by level, however many tasks saw the host.
    """
    pages, note = noted(pages.select("host", "html"), kept)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), defaultdict(list)
        waiting = 0

        def rows() -> pa.RecordBatch:
            found = [json.dumps(merge(w)) for w in own.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([part] * len(own), pa.int64()), pa.array(found, pa.string())], ["host", "part", "wrapper"])

        for b in slices(batches):
            for h, t, k in zip(b.column(0).to_pylist(), b.column(1), note(b), strict=True):
                w = stream_of(parse(t.as_py() or "", kept_of(k)))
                own[h].append(w)
                waiting += len(w)
                if len(own[h]) > TOGETHER:
                    own[h] = [merge(own[h])]
            if waiting > WAITING:
                yield rows()
                own.clear()
                waiting = 0
        yield rows()

    def merged(batch: pa.Table) -> pa.Table:
        rows = sorted(zip(batch.column("part").to_pylist(), batch.column("wrapper").to_pylist(), strict=True))
        out = merge([json.loads(w) for _, w in rows])
        return pa.table({"host": batch.column("host").slice(0, 1), "part": pa.array([rows[0][0] // FAN_IN], pa.int64()), "wrapper": pa.array([json.dumps(out)], pa.string())})

    schema = "host string, part long, wrapper string"
    level = cut(pages.mapInArrow(within, schema), "html-wrappers")
    while (level.agg(F.max("part")).first()[0] or 0) > 0:
        salt = F.floor(F.col("part") / FAN_IN).alias("salt")
        level = cut(level.groupBy("host", salt).applyInArrow(merged, schema), "html-wrappers")
    return level.groupBy("host").applyInArrow(merged, schema).select("host", "wrapper")


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    A null or empty html, or one without text, gives text '' and 0. Pages with a null url share the host ''. A host
    with one page has a wrapper without differences, whose main element is still found by name or mass. Repeated rows
    come back each; extra columns are ignored. The hosts' common marks and main elements' paths are broadcast if they
    measure at most BROADCAST_CHARS, else joined to the pages by host.
    """
    spark = pages.sparkSession
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))

    def to_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(rule(json.loads(w.as_py()))) for w in b.column(1)], pa.string())], ["host", "path"])

    kept = cut(common_marks(p), "html-kept")
    paths = cut(wrappers(p, kept).mapInArrow(to_path, "host string, path string"), "html-paths")
    both = F.concat(F.lit("["), F.col("path"), F.lit(","), F.coalesce("kept", F.lit("null")), F.lit("]")).alias("rule")
    own = kept.withColumnRenamed("host", "kept_host")
    p, note = noted(p, cut(paths.join(own, F.col("host") == F.col("kept_host"), "left").select("host", both), "html-rules"))
    kind = f"page_id {dict(p.dtypes)['page_id']}, url string, text string, n_chars long"

    def done(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = []
            for t, k in zip(b.column(2), note(b), strict=True):
                found = rule_of(k)
                texts.append(main_text(parse(t.as_py() or "", found.kept), found))
            yield done(b, texts)

    return p.mapInArrow(work, kind)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract of pages; edge cases as there."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
