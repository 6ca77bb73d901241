"""Main text of web pages by equivalence classes of template tokens.

Pages of one host are looked at in blocks. A page is read as a row of tokens in page order: opening tags and text blocks,
each told apart by the path of elements it stands in. Tokens that occur equally often on each page of the block (equal
occurrence vectors) form an equivalence class. A class is valid when its tokens come in the same order in each of its
rounds on every page, and when valid classes nest: a class lies in one slot of another, between the same two tokens of
that one's rounds. A token that lies in several slots of a class is told apart by them, and the classes are formed anew,
until no token is. Together the valid classes are the block's template, and what is not in one is the text in its slots.

The main element is the one that a page marks (article, main, articleBody); without a mark the element whose slots hold
most of the text that differs from page to page and is not in links. Of it the text in slots is the main text: what the
template repeats goes, in marked articles too. There pages that share most of their text count once, as versions of an
article say nothing about what the site repeats.

Within the main element, elements that are not article text (menus, forms, notices, adverts, sidebars, reader comments,
scripts, styles) go by their tag, role, class or id too. Blocks follow in page order.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of one host that share a template, at most twice as many.
BLOCK_PAGES = 64
#: Share of a block's pages that a class must be on.
SUPPORT = 0.9

# fixed values: elements of HTML, and words by which sites name their page parts
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe template noembed noframes xmp".split())
DROPPED_TAGS = frozenset("head nav footer aside form menu dialog script style textarea title noscript iframe template noembed noframes xmp svg math canvas object button select input label fieldset audio video map datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status note".split())
DROPPED_WORDS = frozenset(
    "ad ads adbox adblock adsense adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promos promoted promotion banner "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pager pagination toolbar topbar "
    "sidebar sidebars aside rail footer masthead skip "
    "notice notices notification notifications alert alerts cookie cookies consent gdpr popup modal overlay paywall disclaimer newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations trending popular widget widgets "
    "comment comments commentlist disqus replies reply respond discussion reactions search hidden".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKED_IDS = frozenset("articlebody article-body".split())

#: An element path, or a text block in one.
Token = int | tuple[int, str]

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?][^>]*|/?[A-Za-z][^\s/>]*(?>[^>\"']+|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?:[!?]|/?[A-Za-z])[^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")


class Paths:
    """Element paths as numbers: 0 is the page, a child has a larger number than its parent."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, str], int] = {}
        self.parent, self.depth = [0], [0]

    def child(self, parent: int, label: str) -> int:
        if (found := self.number.get((parent, label))) is None:
            found = self.number[parent, label] = len(self.parent)
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
        return found


class Block:
    """A run of text without a block boundary: its element path, the text, how much of it is in links, the tags before it."""

    __slots__ = ("before", "dropped", "heading", "linked", "marked", "path", "pieces", "repeated", "text")

    def __init__(self, path: int, dropped: bool, marked: bool, heading: bool, before: int):
        self.path, self.dropped, self.marked, self.heading, self.before = path, dropped, marked, heading, before
        self.pieces, self.linked, self.text, self.repeated = [], 0, "", False


class Element(NamedTuple):
    """An open element, with what holds for everything inside."""

    name: str = ""
    path: int = 0
    dropped: bool = False
    marked: bool = False
    heading: bool = False
    header: bool = False


ROOT = Element()


def _attributes(tag: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(tag)} if " " in tag or "\n" in tag or "\t" in tag else {}


def _is_dropped(name: str, found: dict[str, str]) -> bool:
    if name in DROPPED_TAGS or "hidden" in found or found.get("aria-hidden") == "true":
        return True
    if found.get("role", "").lower() in DROPPED_ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    if name in ("html", "body", "article", "main"):
        return False
    words = re.findall(r"[a-z]+", f"{found.get('class', '')} {found.get('id', '')}".lower())
    return any(w in DROPPED_WORDS for w in words)


def read_page(page: str, paths: Paths) -> tuple[list[int], list[Block]]:
    """The tag tokens of a page (path of each block element opened) and its text blocks in order.

    Elements left open end with the element around them, a paragraph also where another block begins; end tags without
    a beginning are ignored, and so is what follows an unclosed comment or script.
    """
    tokens: list[int] = []
    blocks: list[Block] = []
    stack: list[Element] = [ROOT]
    opened: Counter[str] = Counter()
    now: Block | None = None
    links, at = 0, 0

    def add(raw: str) -> None:
        nonlocal now
        if now is None:
            if not raw.strip():
                return
            _, path, dropped, marked, heading, header = stack[-1]
            now = Block(path, dropped or (header and not (heading and marked)), marked, heading, len(tokens))
            blocks.append(now)
        now.pieces.append(raw)
        if links:
            now.linked += len(raw)

    def close(k: int) -> None:
        for s in stack[k:]:
            opened[s.name] -= 1
        del stack[k:]

    def end(names: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """Close the innermost open element of these names, unless one of ``within`` is opened inside it."""
        if any(opened[n] for n in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names:
                    close(k)
                    return
                if stack[k].name in within:
                    return

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at, tag = m.end(), m[0]
        named = _NAME.match(tag)
        if named is None:
            continue
        name = named[1].lower()
        if tag[1] == "/":
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCK_TAGS or opened[name] > 0:
                now = None
                end((name,))
            continue
        if name in RAW_TAGS:
            over = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = over.end() if over else len(page)
            continue
        if name == "br":
            if now is not None:
                now.pieces.append("\n")
            continue
        links += name == "a"
        found = _attributes(tag)
        dropped = _is_dropped(name, found)
        if name in BLOCK_TAGS:
            now = None
            while stack[-1].name == "p":
                close(len(stack) - 1)
            if name in CLOSES:
                end(*CLOSES[name])
        elif not dropped:
            continue
        if name in VOID_TAGS or tag.endswith("/>") and name not in BLOCK_TAGS:
            continue
        now = None
        outer = stack[-1]
        marked = outer.marked or name in ("article", "main") or found.get("role", "").lower() in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" or found.get("id", "").lower() in MARKED_IDS
        label = ".".join([name, *re.findall(r"[a-z]+", f"{found.get('class', '')} {found.get('id', '')}".lower())])
        stack.append(Element(name, paths.child(outer.path, label), outer.dropped or dropped, marked, outer.heading or name in HEADINGS, outer.header or name == "header"))
        opened[name] += 1
        tokens.append(stack[-1].path)
    for b in blocks:
        b.text = _SPACE.sub(" ", html.unescape("".join(b.pieces))).strip()
    return tokens, [b for b in blocks if b.text]


#: Elements whose beginning ends an open one of the same kind, and where that search stops.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
}


class Role(NamedTuple):
    """A token in one of the places that it has in a template, where it has several."""

    token: Token
    number: int


def _places(order: np.ndarray, page_of: np.ndarray, role: np.ndarray, roles: int) -> np.ndarray:
    """Number of the token of the class ``order`` that each token follows inside a round; -1 outside of all rounds."""
    index = np.full(roles, -1)
    index[order] = np.arange(len(order))
    own = index[role]
    last = np.maximum.accumulate(np.where(own >= 0, np.arange(len(role)), -1))
    found = np.where((last >= 0) & (page_of[last] == page_of), own[last], -1)
    return np.where(found == len(order) - 1, -1, found)


def _span(values: np.ndarray, role: np.ndarray, roles: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each token."""
    low, high = np.full(roles, 1 << 30), np.full(roles, -2)
    np.minimum.at(low, role, values)
    np.maximum.at(high, role, values)
    return low, high


def _in_order(tokens: np.ndarray, rounds: np.ndarray, page_of: np.ndarray, role: np.ndarray, roles: int) -> np.ndarray | None:
    """Tokens in the order of a round. None if rounds differ, save that of tokens found once a page those stay that agree."""
    if len(tokens) == 1:
        return tokens
    member = np.zeros(roles, bool)
    member[tokens] = True
    at = np.flatnonzero(member[role])
    own, pages = role[at], page_of[at]
    order = own[:len(tokens)]
    if np.array_equal(own, np.tile(order, int(rounds.sum()))):
        return order
    if rounds.max() > 1:
        return None
    agreed = order.tolist()
    for page in np.split(own, np.flatnonzero(np.diff(pages)) + 1):
        rank = {t: k for k, t in enumerate(agreed)}
        # the longest run of tokens that come in the same order on this page
        ends: list[int] = []
        tails: list[tuple] = []
        for t in page.tolist():
            if t in rank:
                k = bisect_left(ends, rank[t])
                chain = (t, tails[k - 1] if k else None)
                ends[k:k + 1], tails[k:k + 1] = [rank[t]], [chain]
        chain, agreed = tails[-1], []
        while chain:
            agreed.append(chain[0])
            chain = chain[1]
        agreed.reverse()
    return np.array(agreed) if len(agreed) > 1 else None


def deduced(pages: list[list[Token]], counted: list[bool]) -> tuple[list[list[Token]], list[list[bool]]]:
    """Valid classes of tokens with equal occurrence vectors, outermost first, and which tokens of each page are in one.

    Vectors and order are those of the counted pages; a class is on at least SUPPORT of them. Classes are taken from the
    outermost on. Tokens of one vector that lie in different slots of a class taken before are classes of their own; a
    token that lies in several slots is told apart by them, and all begins anew with these roles, until none is left. A
    class is dropped when its rounds differ in their order, or a class taken before does not stay in one of its slots.
    """
    often = Counter(t for page, c in zip(pages, counted, strict=True) if c for t in dict.fromkeys(page))
    names: list[Token] = [t for t, k in often.items() if k >= SUPPORT * sum(counted)]
    inside = [[False] * len(page) for page in pages]
    if not names:
        return [], inside
    number = {t: k for k, t in enumerate(names)}
    found = [(k, i, number[t]) for k, page in enumerate(pages) for i, t in enumerate(page) if t in number]
    all_pages, column, all_roles = (x.copy() for x in np.array(found, np.int64).reshape(-1, 3).T)
    counts = np.array(counted)[all_pages]
    width = np.cumsum(counted) - 1
    while True:
        roles, role, page_of = len(names), all_roles[counts], all_pages[counts]
        vectors = np.bincount(width[page_of] * roles + role, minlength=sum(counted) * roles).reshape(-1, roles)
        frequent = np.flatnonzero((vectors > 0).sum(0) >= SUPPORT * sum(counted))
        alike: dict[bytes, list[int]] = defaultdict(list)
        for t in frequent.tolist():
            alike[vectors[:, t].tobytes()].append(t)
        waiting = sorted(alike.values(), key=lambda c: (vectors[:, c[0]].sum(), -len(c), c))
        classes: list[np.ndarray] = []
        taken = np.zeros(roles, bool)
        slots: list[tuple[np.ndarray, np.ndarray]] = []
        several = None
        while waiting and several is None:
            parts: dict[tuple[int, ...], list[int]] = defaultdict(list)
            for t in waiting.pop(0):
                parts[tuple(int(low[t]) for low, _ in slots)].append(t)
            for part in parts.values():
                rounds = vectors[:, part[0]]
                order = _in_order(np.array(part), rounds, page_of, role, roles)
                if order is None:
                    continue
                if len(order) > 1:
                    on = rounds[width[page_of]] > 0
                    where = _places(order, page_of, role, roles)
                    low, high = _span(where[on], role[on], roles)
                    if any(low[c].min() != high[c].max() and high[c].max() >= 0 for c in classes):
                        continue
                    mixed = (low < high) & ~taken
                    mixed[order] = False
                    mixed[np.setdiff1d(np.arange(roles), frequent)] = False
                    if mixed.any():
                        several = order, mixed
                        break
                    slots.append((low, high))
                classes.append(order)
                taken[order] = True
        if several is None:
            break
        order, mixed = several
        which = np.flatnonzero(mixed[all_roles])
        where = _places(order, all_pages, all_roles, roles)[which]
        keys, new = np.unique(all_roles[which] * (len(order) + 1) + where + 1, return_inverse=True)
        for k, key in enumerate(keys.tolist()):
            token = names[key // (len(order) + 1)]
            names.append(Role(token.token if isinstance(token, Role) else token, roles + k))
        all_roles[which] = roles + new
    for k, i in zip(all_pages[taken[all_roles]].tolist(), column[taken[all_roles]].tolist(), strict=True):
        inside[k][i] = True
    return [[names[t] for t in c.tolist()] for c in classes], inside


def equivalence_classes(pages: list[list[Token]]) -> list[list[Token]]:
    """The classes of ``deduced``, each in the order of a round, with a Role for a token that has several."""
    return deduced(pages, [True] * len(pages))[0]


def nested(classes: list[list[Token]], pages: list[list[Token]]) -> dict[int, int]:
    """Class number -> number of the class in one of whose slots it always lies (the narrowest such)."""
    home: dict[int, int] = {}
    for inner, tokens in enumerate(classes):
        best = None
        for outer, around in enumerate(classes):
            if outer == inner:
                continue
            slots = set()
            mine, theirs = set(tokens), set(around)
            for page in pages:
                gap = -1
                for t in page:
                    if t in theirs:
                        gap = around.index(t)
                    elif t in mine:
                        slots.add(gap)
            if len(slots) == 1 and -1 not in slots and (best is None or len(classes[best]) > len(around)):
                best = outer
        if best is not None:
            home[inner] = best
    return home


def _versions(texts: list[str]) -> list[bool]:
    """Which texts share less than half of their runs of five words with each text kept before: the shorter one's runs."""
    kept: list[set[int]] = []
    first = []
    for text in texts:
        words = text.split()
        runs = {hash(tuple(words[k:k + 5])) for k in range(max(1, len(words) - 4))}
        first.append(all(2 * len(runs & other) < min(len(runs), len(other)) for other in kept))
        if first[-1]:
            kept.append(runs)
    return first


class Template:
    """The template of a block of pages: its classes, its repeated text blocks and its main element."""

    def __init__(self, read: list[tuple[list[int], list[Block]]], paths: Paths):
        # copies of a page say nothing about what the site repeats
        seen: set[bytes] = set()
        counted = []
        for _, blocks in read:
            digest = hashlib.sha1("\n".join(b.text for b in blocks if not b.dropped).encode()).digest()
            counted.append(digest not in seen)
            seen.add(digest)
        rows = [in_page_order(tokens, blocks) for tokens, blocks in read]
        self.classes: list[list[Token]] = []
        self._deduce(read, rows, counted)
        if any(b.repeated and b.marked and not b.dropped for _, blocks in read for b in blocks):
            # neither do versions of one article, of which parts are equal
            other = iter(_versions([" ".join(b.text for b in blocks if b.marked and not b.dropped) for (_, blocks), c in zip(read, counted, strict=True) if c]))
            apart = [c and next(other) for c in counted]
            if apart != counted:
                kept = [[b.repeated and not b.marked for b in blocks] for _, blocks in read]
                classes = self.classes
                self._deduce(read, rows, apart)
                self.classes = classes
                for (_, blocks), old in zip(read, kept, strict=True):
                    for b, o in zip(blocks, old, strict=True):
                        b.repeated = b.repeated if b.marked else o
        mass = [0] * len(paths.parent)
        for (_, blocks), c in zip(read, counted, strict=True):
            for b in blocks:
                if c and not b.repeated and not b.dropped:
                    mass[b.path] += max(0, len(b.text) - 2 * b.linked)
        for k in range(len(mass) - 1, 0, -1):
            mass[paths.parent[k]] += mass[k]
        # the narrowest element that holds nearly all text that is in slots
        main = max((k for k, n in enumerate(mass) if n >= 0.8 * mass[0]), key=lambda k: paths.depth[k])
        self.inside = [False] * len(mass)
        for k in range(len(mass)):
            self.inside[k] = k == main or k > 0 and self.inside[paths.parent[k]]

    def _deduce(self, read: list[tuple[list[int], list[Block]]], rows: list[list[Token]], counted: list[bool]) -> None:
        """Classes of the counted pages, and which text blocks of all pages are in one."""
        found: list[list[bool]]
        self.classes, found = deduced(rows, counted) if sum(counted) > 2 else ([], [[False] * len(r) for r in rows])
        for (_, blocks), inside in zip(read, found, strict=True):
            for k, b in enumerate(blocks):
                b.repeated = inside[b.before + k]

    def extract(self, blocks: list[Block]) -> list[str]:
        """Text in slots of the main element: the marked one, where there is a mark."""
        kept = [b for b in blocks if not (b.dropped or b.repeated)]
        if any(b.marked for b in blocks):
            return [b.text for b in kept if b.marked]
        return [b.text for b in kept if self.inside[b.path] or b.heading]


def in_page_order(tokens: list[int], blocks: list[Block]) -> list[Token]:
    """The tags and text blocks of a page as they come."""
    out: list[Token] = []
    at = 0
    for b in blocks:
        out += tokens[at:b.before]
        out.append((b.path, b.text))
        at = b.before
    return out + tokens[at:]


def extract_block(pages: list[str]) -> tuple[list[str], list[int]]:
    """Main text of each page of a block, and the number of template tokens found for it."""
    paths = Paths()
    read = [read_page(p, paths) for p in pages]
    template = Template(read, paths)
    size = sum(map(len, template.classes))
    return ["\n".join(template.extract(blocks)) for _, blocks in read], [size] * len(pages)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) and template_tokens for each page.

    Hosts are sorted into ranges of (host, page_id), so a busy host is spread over tasks; each task takes a host's pages
    in blocks of BLOCK_PAGES to twice as many. A null html is an empty page, with an empty text; a null url counts as a host
    of its own. Repeated rows are returned as often as they come; other columns are ignored.
    """
    schema = "page_id long, url string, text string, n_chars long, template_tokens long"
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "host", "page_id").sortWithinPartitions("host", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(some: list[tuple]) -> pa.RecordBatch:
            texts, sizes = extract_block([r[2] for r in some])
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.string()), pa.array(texts, pa.string()),
                pa.array(list(map(len, texts)), pa.int64()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_chars", "template_tokens"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][3] != row[3]:
                    yield out(held)
                    held = []
                elif len(held) == 2 * BLOCK_PAGES:
                    yield out(held[:BLOCK_PAGES])
                    held = held[BLOCK_PAGES:]
                held.append(row)
        if held:
            yield out(held)

    return dealt.mapInArrow(run, schema)
