"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read as a tree of containers (block elements, and small ones that carry a label) with runs of leaf blocks between
them. A wrapper is such a tree for a host: each node may be optional `?` or repeated `+`, each run is a list of text slots `#` or
fixed texts. It starts as one page and is aligned with one page after another, child list by child list along longest common
subsequences: first of children with the same expression, between those of children with the same kind of content,
then of children with the same tag and label. What only one side has becomes optional, what follows itself becomes repeated.

Extraction matches every page against its host's wrapper. Sums over all pages of the host say of each wrapper node how much
text and link text its slots hold and whether its text is the same wherever it stands; from them decide() takes the node that
holds the main text and those that are template. Tags that say what they hold (nav, footer, article ...) count before
those sums, class names only where the sums allow it: a label never rules out the container with most of the text. Inside an
article nothing goes but whole containers that are called adverts, comments and the like; headings, paragraphs, list items, inline elements and link lists stay, but for link lists
that more than two and a third of the host's pages share word for word.
Containers a page has beyond its wrapper are judged by the page alone, as is a page without its host's main node.

Nothing is sampled: a wrapper is inferred from all structures of a host's pages, and sums and extraction are over every page.

Cases. Null html is empty and gives empty text. Repeated rows give repeated rows. Equal containers: the deeper one, then the first in
the page. Tables of any extra columns: only page_id, url and html are read. Empty tables give no rows. Time is linear in the
page but for alignment, which is bit-parallel: children of the page times children of the wrapper / 64.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haystrata.llm.common import fits, grouped, staged

#: Page structures that are merged in one task; a host's are all merged, level by level.
GROUP = SAMPLE_PAGES = 8
#: Ways that a host's pages are dealt when wrappers are too large to broadcast.
SALTS = 32
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: it is skipped to the end tag. Of the first two a missing end tag takes the rest of the page, as in browsers.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "xmp")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul br head".split()
)
#: Blocks that are leaves unless they carry a label.
LEAF = frozenset("p li h1 h2 h3 h4 h5 h6 td th tr dd dt pre caption figcaption summary legend address hr br html".split())
#: Elements that never hold main text.
OUT = frozenset("head nav footer aside dialog menu title button select svg canvas object search datalist".split())
OUT_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
_OUT_NAME = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|comments?|commentlist|disqus|respond|repl(?:y|ies)|discussion|sidebar|side|menu|nav\w*|breadcrumbs?|footer|masthead|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|widget|toolbar|skip|copyright|legal|disclaimer|tags|meta)")
#: Of these, the ones that say so inside an article too, of whole containers; a section there only if its label is one of the second ones.
_OUT_INSIDE = re.compile(r"(?!legal|disclaimer|copyright|tags|meta|discussion|search|side$|skip|toolbar|repl)" + _OUT_NAME.pattern)
_OUT_SECTION = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|comments?|commentlist|disqus|respond|newsletter|related|recommend\w*")
_MAIN_NAME = re.compile(r"(?:article|content|main|post|entry|story|body|text)")
#: Name parts that say how a container is laid out, not what it holds.
_LAYOUT = re.compile(r"(?:has|no|with|without|is)[-_]\S*|[\w-]*-(?:has|no|with|without)[-_]\S*")
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_ATTRS = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLOSE_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")
#: Which open element a start tag ends, unless one of the others is nearer.
_ENDS = {"li": ("li", "ul", "ol", "menu"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr", "table", "tbody", "thead", "tfoot"), "td": ("td th", "tr", "table"), "th": ("td th", "tr", "table"), "option": ("option", "select", "datalist")}


def tokens(page: str | None) -> Iterator[tuple[str, str, str]]:
    """(kind, value, label) in page order: text with its decoded value, open and close with tag names; label has id, class and role.
    Comments, declarations and the contents of scripts and the like are left out. Time is linear: nothing is searched for twice.

    An attribute value whose quote never ends reaches to the tag's first >. A tag without any > is dropped with what follows, as in browsers.
    """
    page, at, size = page or "", 0, len(page or "")
    last, gone = page.rfind(">"), set()  # gone: raw elements with no end tag in the rest of the page
    while at < size:
        i = page.find("<", at)
        while 0 <= i < size - 1 and not (page[i + 1] in "/!?" or page[i + 1].isascii() and page[i + 1].isalpha()):
            i = page.find("<", i + 1)
        if i < 0 or i >= size - 1:
            yield "text", entities.unescape(page[at:]), ""
            return
        if i > at:
            text = page[at:i]
            yield "text", entities.unescape(text) if "&" in text else text, ""
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith("<![CDATA[", i):
            end = page.find("]]>", i)
            yield "text", page[i + 9 : end if end >= 0 else size], ""
            at = end + 3 if end >= 0 else size
            continue
        if i > last:
            return
        m = _NAME.match(page, i)
        if not m:  # a declaration, an instruction or a stray end tag
            at = page.find(">", i) + 1
            continue
        end = m.end()
        if page[end] != ">":
            end = _ATTRS.match(page, end).end()
            if page[end : end + 1] != ">":
                end = page.find(">", m.end())
        name, attrs, at = m[1].lower(), page[m.end() : end], end + 1
        if page[i + 1] == "/":
            yield "close", name, ""
            continue
        if name in _CLOSE_RAW and not attrs.endswith("/"):
            found = None if name in gone else _CLOSE_RAW[name].search(page, at)
            if found:
                at = found.end()
            elif name in ("script", "style"):
                return
            else:
                gone.add(name)
            continue
        label = ""
        if "=" in attrs:
            found = {a.lower(): x or y or z for a, x, y, z in _ATTR.findall(attrs)}
            label = " ".join(f"{k}={_SPACE.sub(' ', found[k]).strip()}" for k in ("id", "class", "role") if found.get(k, "").strip())
        yield "open", name, label


def says_out(tag: str, label: str, inside: bool = False) -> bool:
    """Whether the labels of a container say that it holds no main text. inside: of an article, where leaves (headings, paragraphs, items …) are text
    whatever they are called, and fewer names count."""
    if not label or tag in ("html", "body", "article", "main") or inside and tag in LEAF:
        return False
    names = _LAYOUT.sub(" ", re.sub(r"\brole=\S+|\b(?:id|class)=", " ", label.lower()))
    out = _OUT_NAME if not inside else _OUT_SECTION if tag == "section" else _OUT_INSIDE
    return any(out.fullmatch(x) for x in re.split(r"[^a-z]+", names) if x)


def says_main(label: str) -> bool:
    return any(_MAIN_NAME.fullmatch(x) for x in re.split(r"[^a-z]+", re.sub(r"\b(?:id|class|role)=", " ", label.lower())) if x)


def is_out(tag: str, label: str) -> bool:
    role = re.search(r"role=(\S+)", label) if "role=" in label else None
    return tag in OUT or bool(role and role[1].lower() in OUT_ROLE)


@dataclass
class Node:
    """A container of a page. items: its children in order, nodes and the indices of leaf blocks in Page.blocks."""

    tag: str
    label: str
    parent: Node | None
    index: int
    items: list = field(default_factory=list)

    def __post_init__(self):
        self.key = f"{self.tag}[{re.sub('[0-9]+', '0', self.label)}]" if self.label else self.tag


class Page:
    """The containers of a page, the document itself first, and its leaf blocks: [node, tag, text, characters in links]."""

    def __init__(self, page: str | None):
        root = Node("#", "", None, 0)
        self.nodes, self.blocks = [root], []
        # stack of open elements: (name, node, hidden, links); open_at has the places of each name in it
        stack: list[tuple[str, Node, bool, int]] = [("#", root, False, 0)]
        open_at: dict[str, list[int]] = defaultdict(list)
        block_at = [0]  # places of the block elements
        frames = [-1]  # of article, main and body
        open_block = None  # the leaf block that text goes on in
        leaf_tag = ""

        def cut(i: int) -> None:
            while len(stack) > i:
                name = stack.pop()[0]
                if open_at[name] and open_at[name][-1] >= len(stack):
                    open_at[name].pop()
                if block_at and block_at[-1] >= len(stack):
                    block_at.pop()
                if frames[-1] >= len(stack):
                    frames.pop()

        for kind, value, label in tokens(page):
            name, node, hidden, links = stack[-1]
            if kind == "text":
                if hidden or not value:
                    continue
                if open_block is None:
                    open_block = [node, leaf_tag, [], 0]
                    node.items.append(len(self.blocks))
                    self.blocks.append(open_block)
                open_block[2].append(value)
                if links:
                    open_block[3] += len(value.strip())
                continue
            block = value in BLOCK
            if block:
                open_block, leaf_tag = None, ""
            if kind == "open":
                if value in VOID:
                    continue
                if open_at["title"]:
                    cut(open_at["title"][-1])
                if value != "title" and open_at["head"]:
                    cut(open_at["head"][-1])
                if block and block_at and stack[block_at[-1]][0] == "p":
                    cut(block_at[-1])
                if block and open_at["select"]:  # a list of options holds no blocks, so its end tag is missing
                    cut(open_at["select"][-1])
                if value in _ENDS:
                    own, *others = _ENDS[value]
                    mine = max((open_at[x][-1] for x in own.split() if open_at[x]), default=-1)
                    if mine > max((open_at[x][-1] for x in others if open_at[x]), default=-1):
                        cut(mine)
                name, node, hidden, links = stack[-1]
                if block and (value not in LEAF or label) and value not in ("html", "head"):
                    child = Node(value, label, node, len(self.nodes))
                    if not hidden:
                        node.items.append(child)
                        self.nodes.append(child)
                    node = child
                elif not block and is_out(value, label) or value in ("head", "title"):
                    hidden = True
                if block and value in LEAF:
                    leaf_tag = value
                stack.append((value, node, hidden, links + (value == "a")))
                open_at[value].append(len(stack) - 1)
                if block:
                    block_at.append(len(stack) - 1)
                    if value in ("article", "main", "body"):
                        frames.append(len(stack) - 1)
            elif open_at[value]:
                at = open_at[value][-1]
                if at >= frames[-1] or value in ("html", "body", "main", "article"):  # a stray end tag does not close the page's frame
                    cut(at)
        for b in self.blocks:
            b[2] = " ".join("".join(b[2]).split())


# --- wrappers ---


@dataclass
class Part:
    """A node of a wrapper, or with leaves a run of leaf blocks: [tag, repeated, optional, fixed text or None, None], groups of them with the leaves last."""

    key: str
    tag: str
    label: str
    whole: str  # its expression without texts, a run of leaf blocks as the set of their tags
    kind: str  # what it holds: key with links, prose, forms
    items: list[Part] = field(default_factory=list)
    leaves: list | None = None
    optional: bool = False
    repeated: bool = False
    nodes: list[int] = field(default_factory=list)  # of a page: the containers it stands for


def fold(seq: list, same) -> list[tuple[list, int]]:
    """Groups of a list and their period: the shortest run of up to four units that follows itself, with all its repeats; period 0 for a unit that does not."""
    out, i = [], 0
    while i < len(seq):
        for p in range(1, 5):
            n = 1
            while i + (n + 1) * p <= len(seq) and all(same(seq[i + k], seq[i + n * p + k]) for k in range(p)):
                n += 1
            if n > 1:
                out.append((seq[i : i + n * p], p))
                i += n * p
                break
        else:
            out.append((seq[i : i + 1], 0))
            i += 1
    return out


def _same_text(a, b):
    return a if a == b else None


def _leaf_key(x: list) -> str:
    return x[0] if x[4] is None else "(" + " ".join(_leaf_key(y) for y in x[4]) + ")"


def _leaves(blocks: list[tuple[str, str]]) -> list:
    """A run of leaf blocks (tag, text) with blocks, then groups of up to four, that follow themselves folded; texts that differ between them become slots."""
    row = [[tag, False, False, text, None] for tag, text in blocks]
    for _ in range(2):
        out: list = []
        for group, p in fold(row, lambda a, b: _leaf_key(a) == _leaf_key(b)):
            held = group[: max(p, 1)]
            for k in range(len(held), len(group)):
                held[k % p] = _both_leaf(held[k % p], group[k])
            if p == 1:
                held[0][1] = True
            out += [["(", True, False, None, held]] if p > 1 else held
        row = out
    return row


def _both_leaf(x: list, y: list) -> list:
    inner = None if x[4] is None else [_both_leaf(a, b) for a, b in zip(x[4], y[4])]
    return [x[0], x[1] or y[1], x[2] or y[2], _same_text(x[3], y[3]), inner]


def _kind(node: Node, page: Page, chars: dict[int, tuple[int, int]]) -> str:
    text, links = chars[node.index]
    return f"{node.key}{'L' if text and links >= 0.6 * text else 'P' if text >= 200 else 't' if text else ''}"


def shape(page: Page) -> Part:
    """A page as a wrapper of its own."""
    chars: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for b in page.blocks:
        chars[b[0].index][0] += len(b[2])
        chars[b[0].index][1] += b[3]
    for node in reversed(page.nodes[1:]):
        for k in (0, 1):
            chars[node.parent.index][k] += chars[node.index][k]
    parts: dict[int, Part] = {}
    for node in reversed(page.nodes):  # children come after their parents
        items: list[Part] = []
        run: list[tuple[str, str]] = []
        for x in [*node.items, None]:
            if isinstance(x, int):
                if page.blocks[x][2]:
                    run.append((page.blocks[x][1], page.blocks[x][2]))
                continue
            if run:
                items.append(Part("#", "#", "", "#" + ",".join(sorted({tag for tag, _ in run})), "#", leaves=_leaves(run)))
                run = []
            if x is not None:
                items.append(parts.pop(x.index))
        items = _folded(items)
        inner = " ".join(("(%s)+" if p.repeated else "%s") % p.whole for p in items)
        whole = f"{node.key}<{blake2b(inner.encode(), digest_size=6).hexdigest() if len(inner) > 60 else inner}>"
        parts[node.index] = Part(node.key, node.tag, node.label, whole, _kind(node, page, chars), items, nodes=[node.index])
    return parts[0]


def _folded(items: list[Part]) -> list[Part]:
    """Children, or groups of up to four, that follow themselves become repeated ones: by their expression, labelled ones by tag and label."""
    out: list[Part] = []
    for group, p in fold(items, lambda a, b: a.whole == b.whole or bool(a.label) and a.key == b.key):
        held = group[: max(p, 1)]
        for k in range(len(held), len(group)):
            merge(held[k % p], group[k])
        for x in held:
            x.repeated |= p > 0
        out += held
    return out


def _skips(a: list, b: list) -> Iterator[str]:
    """Steps through both sequences along a longest common subsequence: 'both', else 'a' wherever that loses nothing, else 'b'.

    Bit-parallel: bit x of a row says that the x-th element of a from its end adds nothing. Rows are kept in steps of the
    square root of len(b) and those between made again, so memory is about two square roots of rows.
    """
    n, m = len(a), len(b)
    every, full = (1 << n) - 1, defaultdict(int)
    for x, key in enumerate(reversed(a)):
        full[key] |= 1 << x

    def row(v: int, key) -> int:
        u = v & full.get(key, 0)
        return ((v + u) | (v - u)) & every

    step = math.isqrt(m) + 1
    kept, v = [every], every  # rows of the last 0, step, 2 step ... elements of b
    for y in range(m):
        v = row(v, b[m - 1 - y])
        if (y + 1) % step == 0:
            kept.append(v)
    i = j = 0
    rows, low = [], m + 1
    while i < n and j < m:
        left = m - j  # elements of b that remain
        if not low <= left < low + len(rows):
            low = left // step * step
            rows = [kept[low // step]]
            for y in range(low, min(low + step - 1, m)):
                rows.append(row(rows[-1], b[m - 1 - y]))
        if a[i] == b[j]:
            yield "both"
            i, j = i + 1, j + 1
        elif rows[left - low] >> (n - 1 - i) & 1:
            yield "a"
            i += 1
        else:
            yield "b"
            j += 1
    yield from "a" * (n - i)
    yield from "b" * (m - j)


def pairs(a: list[Part], b: list[Part]) -> list[tuple[int | None, int | None]]:
    """The two child lists aligned: children with the same expression first, between them those with the same kind of content, then the same key."""

    def level(i0: int, i1: int, j0: int, j1: int, way: int) -> Iterator[tuple[int | None, int | None]]:
        name = ("whole", "kind", "key")[way]
        i, j, mi, mj = i0, j0, i0, j0
        if i0 < i1 and j0 < j1:
            for step in [*_skips([getattr(x, name) for x in a[i0:i1]], [getattr(x, name) for x in b[j0:j1]]), "end"]:
                if step in ("both", "end"):
                    if way < 2:
                        yield from level(mi, i, mj, j, way + 1)
                    else:
                        yield from ((x, None) for x in range(mi, i))
                        yield from ((None, y) for y in range(mj, j))
                    if step == "both":
                        yield i, j
                        mi, mj = i + 1, j + 1
                i, j = i + (step in ("both", "a")), j + (step in ("both", "b"))
            return
        yield from ((x, None) for x in range(i0, i1))
        yield from ((None, y) for y in range(j0, j1))

    return list(level(0, len(a), 0, len(b), 0))


def _merged_leaves(a: list, b: list) -> list:
    out, i, j = [], 0, 0
    for step in _skips([_leaf_key(x) for x in a], [_leaf_key(x) for x in b]):
        if step == "both":
            out.append(_both_leaf(a[i], b[j]))
        else:
            x = a[i] if step == "a" else b[j]
            out.append([x[0], x[1], True, x[3], x[4]])
        i, j = i + (step != "b"), j + (step != "a")
    return out


def merge(wrapper: Part, page: Part) -> None:
    """wrapper becomes the smallest expression of this form that also matches page. Iterative, so depth is no matter."""
    todo = [(wrapper, page)]
    while todo:
        w, p = todo.pop()
        w.repeated |= p.repeated
        w.optional |= p.optional
        w.nodes += p.nodes
        if w.leaves is not None:
            w.leaves = _merged_leaves(w.leaves, p.leaves)
            continue
        items = []
        again = {x.key: x for x in w.items if x.repeated and x.leaves is None}
        for i, j in pairs(w.items, p.items):
            if j is None:
                w.items[i].optional = True
                items.append(w.items[i])
            elif i is not None:
                todo.append((w.items[i], p.items[j]))
                items.append(w.items[i])
            elif p.items[j].leaves is None and p.items[j].key in again:
                todo.append((again[p.items[j].key], p.items[j]))
            else:
                p.items[j].optional = True
                items.append(p.items[j])
        w.items = items


def infer(pages: list[Part]) -> Part:
    first, *rest = pages
    for p in rest:
        merge(first, p)
    return first


def expression(wrapper: Part) -> str:
    """The wrapper in writing."""
    out: list[str] = []
    todo: list = [wrapper]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.leaves is not None:
            out += [_written(y) for y in x.leaves]
            continue
        mark = "+" * x.repeated + "?" * x.optional
        todo += [f"</{x.tag}>{')' + mark if mark else ''}", *reversed(x.items), f"{'(' if mark else ''}<{x.key}>"]
    return "".join(out)


def _written(leaf: list) -> str:
    tag, repeated, optional, text, inner = leaf
    body = "".join(map(_written, inner)) if inner is not None else f"<{tag or 'text'}>" + ("#" if text is None else json.dumps(text, ensure_ascii=False))
    return f"({body})" + "+" * repeated + "?" * optional if repeated or optional else body


def packed(wrapper: Part) -> str:
    """A wrapper's containers as JSON rows [parent, tag, label, key, whole, kind, repeated, children], parents first, for matching."""
    rows, todo = [], [(wrapper, -1)]
    while todo:
        x, up = todo.pop()
        at = len(rows)
        rows.append([up, x.tag, x.label, x.key, x.whole, x.kind, x.repeated])
        todo += [(c, at) for c in reversed(x.items) if c.leaves is None]
    return json.dumps(rows, ensure_ascii=False)


class Wrapper:
    """packed() in memory."""

    def __init__(self, text: str):
        self.rows = json.loads(text)
        self.children: list[list[tuple[int, Part]]] = [[] for _ in self.rows]
        for i, (up, tag, label, key, whole, kind, repeated) in enumerate(self.rows):
            if up >= 0:
                self.children[up].append((i, Part(key, tag, label, whole, kind, repeated=repeated)))

    def match(self, page: Part) -> Iterator[tuple[Part, int]]:
        """The containers of a page's shape() that have a wrapper node, with it."""
        todo = [(0, page)]
        while todo:
            at, part = todo.pop()
            yield part, at
            below, mine = self.children[at], [x for x in part.items if x.leaves is None]
            if not below or not mine:
                continue
            again = {p.key: i for i, p in below if p.repeated}
            for i, j in pairs([p for _, p in below], mine):
                if j is not None and (to := below[i][0] if i is not None else again.get(mine[j].key)) is not None:
                    todo.append((to, mine[j]))


def listed(part: Part) -> list[Part]:
    """The containers of a shape, parents first, in page order."""
    out, todo = [], [part]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [c for c in reversed(x.items) if c.leaves is None]
    return out


# --- what wrapper nodes hold ---


def decide(rows: list, text: list[float], links: list[float], pages: list[int], same: list[bool], host_pages: int) -> tuple[list[int], list[bool]]:
    """(main nodes, left out) of nodes [parent, tag, label ...], parents first: the text and link characters of their own blocks, the number of
    pages that have them, whether all their text is the same on all of these."""
    n = len(rows)
    full, link = list(text), list(links)
    for i in range(n - 1, 0, -1):
        full[rows[i][0]] += full[i]
        link[rows[i][0]] += link[i]
    mass = [f - 0.9 * x for f, x in zip(full, link)]
    total = mass[0] or 1e-9
    role = [m[1].lower() if (m := re.search(r"role=(\S+)", r[2])) else "" for r in rows]
    inside = [False] * n  # of an article or main element
    holds = [rows[i][1] in ("article", "main") or role[i] in ("article", "main") for i in range(n)]
    article = [False] * n  # of an article element
    for i in range(n):
        inside[i] = holds[i] or i > 0 and inside[rows[i][0]]
        article[i] = rows[i][1] == "article" or role[i] == "article" or i > 0 and article[rows[i][0]]
    above = list(holds)
    for i in range(n - 1, 0, -1):
        above[rows[i][0]] |= above[i]
    semantic = any(holds[i] and mass[i] > 0.02 * total for i in range(n))
    out = [False] * n
    for i in range(1, n):
        tag, label = rows[i][1], rows[i][2]
        large = mass[i] >= 0.5 * total and (above[i] or inside[i] or not semantic)
        no = is_out(tag, label)
        no |= not large and (tag == "form" or says_out(tag, label, article[i]) or tag == "header" and not inside[i])
        no |= not large and not above[i] and not article[i] and pages[i] > 2 and tag not in ("ul", "ol") and full[i] > 0 and link[i] >= 0.8 * full[i]
        no |= same[i] and tag != "body" and not above[i] and pages[i] > 2 and pages[i] >= max(0.9 * pages[rows[i][0]], 0.3 * host_pages)
        out[i] = out[rows[i][0]] or no
    left = [0.0 if out[i] else text[i] - 0.9 * links[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        left[rows[i][0]] += left[i]
    if left[0] <= 0:
        return [0], out
    for name in ("article", "main"):
        held = [i for i in range(n) if not out[i] and (rows[i][1] == name or role[i] == name) and left[i] > 0]
        best = max(held, key=lambda i: (left[i], -i), default=0)
        if held and left[best] >= 0.2 * left[0]:
            return [i for i in held if (rows[i][1], rows[i][2]) == (rows[best][1], rows[best][2])], out
    below: list[list[int]] = [[] for _ in rows]
    for i in range(1, n):
        if not out[i] and left[i] >= 0.6 * left[0]:
            below[rows[i][0]].append(i)
    at, named = 0, None
    while below[at]:  # down the path of nodes that hold most of what is left
        at = below[at][0]
        named = at if says_main(rows[at][2]) else named
    return [at if named is None else named], out


def _texts(page: Page) -> dict[int, list[int]]:
    """Own text and link characters of each container."""
    held: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for b in page.blocks:
        held[b[0].index][0] += len(b[2])
        held[b[0].index][1] += b[3]
    return held


def _digests(page: Page) -> dict[int, int]:
    """A hash of each container's whole text, from those of its parts."""
    out: dict[int, int] = {}
    for node in reversed(page.nodes):
        h = blake2b(digest_size=8)
        for x in node.items:
            h.update(page.blocks[x][2].encode("utf-8", "replace") + b"\n" if isinstance(x, int) else out[x.index].to_bytes(8, "little", signed=True))
        out[node.index] = int.from_bytes(h.digest(), "little", signed=True)
    return out


def link_lists(page: Page, skip: set[int]) -> tuple[set[int], set[int]]:
    """Lists and labelled containers of this page of which 90 % of the text is link text, outside its articles and inside them."""
    article = [False] * len(page.nodes)
    for x in page.nodes:  # parents first
        article[x.index] = x.tag == "article" or "role=article" in x.label or x.parent is not None and article[x.parent.index]
    full, link = [0] * len(page.nodes), [0] * len(page.nodes)
    for i, (t, n) in _texts(page).items():
        full[i], link[i] = t, n
    for node in reversed(page.nodes[1:]):
        full[node.parent.index] += full[node.index]
        link[node.parent.index] += link[node.index]
    found = {x.index for x in page.nodes if x.index not in skip and (x.tag in ("ul", "ol") or x.label) and full[x.index] and link[x.index] >= 0.9 * full[x.index]}
    return {i for i in found if not article[i]}, {i for i in found if article[i]}


def own_verdict(page: Page) -> tuple[set[int], set[int]]:
    """(main containers, left-out containers) by this page alone."""
    rows = [[x.parent.index if x.parent else -1, x.tag, x.label] for x in page.nodes]
    held = _texts(page)
    n = len(rows)
    mains, out = decide(rows, [float(held[i][0]) if i in held else 0.0 for i in range(n)], [float(held[i][1]) if i in held else 0.0 for i in range(n)], [1] * n, [False] * n, 1)
    return set(mains), {i for i in range(n) if out[i]}


def extract(html: str | None, wrapper: Wrapper | None = None, main: frozenset[int] = frozenset(), out: frozenset[int] = frozenset(), lists: frozenset[int] = frozenset()) -> str:
    """The main text: blocks in page order, white space inside a block as one space, one newline between blocks. Link lists of the
    page outside articles, and inside them those whose text (its hash in lists) the host's pages share, stay only if it has no other text. main, out: the wrapper nodes that decide() chose."""
    page = Page(html)
    mains, left_out = set(), set()
    if wrapper is not None:
        found = {i: w for part, w in wrapper.match(shape(page)) for i in part.nodes}
        mains = {i for i, w in found.items() if w in main}
        left_out = {i for i, w in found.items() if w in out}
        if len(found) < len(page.nodes):
            left_out |= {i for i in own_verdict(page)[1] if i not in found}
    lines = _kept(page, mains, left_out)
    if not lines:
        mains, left_out = own_verdict(page)
        lines = _kept(page, mains, left_out)
    menus, inner = link_lists(page, mains)
    if inner and lists:
        digests = _digests(page)
        menus |= {i for i in inner if digests[i] in lists}
    if menus:
        lines = _kept(page, mains, left_out | menus) or lines
    return "\n".join(lines)


def _kept(page: Page, mains: set[int], out: set[int]) -> list[str]:
    """The texts of the blocks inside a main container and outside all left-out ones."""
    inside = [False] * len(page.nodes)
    gone = list(inside)
    for x in page.nodes:  # parents first
        up = x.parent.index if x.parent else 0
        inside[x.index] = inside[up] or x.index in mains
        gone[x.index] = gone[up] or x.index in out
    return [b[2] for b in page.blocks if b[2] and inside[b[0].index] and not gone[b[0].index]]


# --- hosts ---


def host_of(url: str) -> F.Column:
    """The lower-case host of a url column; null and hostless urls are one host, ''."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _portable(part: Part) -> str:
    """A page's shape as JSON, without the texts of slots that no other page can share: texts are hashes."""

    def rows():
        todo = [(part, -1)]
        n = 0
        while todo:
            x, up = todo.pop()
            leaves = None if x.leaves is None else [_hashed(y) for y in x.leaves]
            yield [up, x.key, x.tag, x.label, x.whole, x.kind, x.optional, x.repeated, leaves]
            todo += [(c, n) for c in reversed(x.items)]
            n += 1

    return json.dumps(list(rows()), ensure_ascii=False)


def _hashed(leaf: list) -> list:
    tag, repeated, optional, text, inner = leaf
    text = text if text is None or len(text) <= 40 else blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()
    return [tag, repeated, optional, text, inner and [_hashed(y) for y in inner]]


def _from_portable(text: str) -> Part:
    parts: list[Part] = []
    for up, key, tag, label, whole, kind, optional, repeated, leaves in json.loads(text):
        p = Part(key, tag, label, whole, kind, [], leaves, optional, repeated, [])
        parts.append(p)
        if up >= 0:
            parts[up].items.append(p)
    return parts[0]


def structures(pages: DataFrame) -> DataFrame:
    """(host, h, shape, n, page_low, page_high, parts) for each structure h of each host's pages (url, html): one of its shapes, the number of its pages,
    the range of their hashes, and for each container (text, links, low, high): its own text and link characters on all of these pages and
    the range of hashes of its whole text.

    A structure's expression and kinds of content make it one; its rows are summed in a task before they leave it. Rows without a shape are the link lists inside articles: h is the hash
    of a list's text and n the number of pages that have it.
    """
    schema = pa.schema([("host", pa.string()), ("h", pa.int64()), ("part", pa.int32()), ("shape", pa.string()), ("n", pa.int64()), ("text", pa.float64()), ("links", pa.float64()), ("low", pa.int64()), ("high", pa.int64())])

    def one(batch):
        held: dict[tuple, list] = {}
        menus: dict[tuple[str, int], int] = defaultdict(int)
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(html)
            top = shape(page)
            parts, texts, digests = listed(top), _texts(page), _digests(page)
            for h in {digests[i] for i in link_lists(page, set())[1]}:
                menus[host, h] += 1
            key = (host, top.whole, tuple(p.kind for p in parts))
            seen = held.get(key)
            if seen is None:
                seen = held[key] = [top, 0, [[0.0, 0.0, 1 << 63, -(1 << 63)] for _ in parts], 0]
            seen[1] += 1
            for p, row in zip(parts, seen[2]):
                h = digests[p.nodes[0]] if len(p.nodes) == 1 else _number(repr([digests[i] for i in sorted(p.nodes)]))
                for i in p.nodes:
                    if i in texts:
                        row[0] += texts[i][0]
                        row[1] += texts[i][1]
                row[2], row[3] = min(row[2], h), max(row[3], h)
        rows = []
        for (host, whole, kinds), (top, n, parts, _) in held.items():
            h = _number(repr((whole, kinds)))
            rows.append((host, h, -1, _portable(top), n, 0.0, 0.0, parts[0][2], parts[0][3]))
            rows += [(host, h, k, None, n, *row) for k, row in enumerate(parts)]
        rows += [(host, h, -2, None, n, 0.0, 0.0, 0, 0) for (host, h), n in menus.items()]
        return dict(zip(schema.names, zip(*rows))) if rows else None

    rows = pages.select(host_of("url").alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.mapInArrow(lambda it: grouped(it, "html", schema, one), "host string, h long, part int, shape string, n long, text double, links double, low long, high long")
    rows = rows.groupBy("host", "h", "part").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"), F.sum("text").alias("text"), F.sum("links").alias("links"), F.min("low").alias("low"), F.max("high").alias("high"))
    whole = F.col("part") == -1
    parts = F.array_sort(F.collect_list(F.when(F.col("part") >= 0, F.struct("part", "text", "links", "low", "high"))))  # one for each container of a page
    return rows.groupBy("host", "h").agg(F.max(F.when(whole, F.col("shape"))).alias("shape"), F.max("n").alias("n"), F.min(F.when(whole, F.col("low"))).alias("page_low"), F.max(F.when(whole, F.col("high"))).alias("page_high"), parts.alias("parts"))


def _number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def wrappers(found: DataFrame, group: int = GROUP) -> DataFrame:
    """(host, wrapper, expression) of each host of structures(): all of them go into the wrapper, the commonest first. Runs of `group` structures
    become one expression each, then runs of those, until a host has one; so no task has more than `group` of them."""
    order = Window.partitionBy("host").orderBy(F.desc("n"), "h")
    places = found.select("host", "h", "n").withColumn("r", F.row_number().over(order) - 1).select("host", "h", "r")  # numbers only
    rows = found.select("host", "h", "shape").join(places, ["host", "h"]).select("host", "r", "shape")
    most = (places.agg(F.max("r")).first()[0] or 0) + 1

    def merged(pdf: pd.DataFrame) -> Part:
        return infer([_from_portable(s) for s in pdf.sort_values("r")["shape"]])

    def some(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "r": [key[1]], "shape": [_portable(merged(pdf))]})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        w = merged(pdf)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [packed(w)], "expression": [expression(w)]})

    while most > group:
        rows = staged(rows.groupBy("host", F.floor(F.col("r") / group).cast("int").alias("to")).applyInPandas(some, "host string, r int, shape string"))
        most = -(-most // group)
    return rows.groupBy("host").applyInPandas(last, "host string, wrapper string, expression string")


def _with_host(rows: DataFrame, learned: DataFrame, salt: str, *columns: str) -> DataFrame:
    """rows (host, …) with the columns learned of their host: broadcast if those fit, else joined over SALTS parts of each host by a hash of salt, so that no host is one task's."""
    learned = learned.select("host", *columns)
    if fits(learned, "host", *columns):
        return rows.join(F.broadcast(learned), "host", "left")
    salted = learned.withColumn("__hs_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__hs_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, ["host", "__hs_salt"], "left").drop("__hs_salt")


class _Cache(dict):
    """Wrappers by their text, for the rows of one task; emptied when there are many."""

    def __missing__(self, text: str) -> Wrapper:
        if len(self) > 256:
            self.clear()
        self[text] = Wrapper(text)
        return self[text]


def sums(found: DataFrame, learned: DataFrame) -> DataFrame:
    """(host, node, text, links, pages, same) of each wrapper node over all pages of its host, from structures() matched against wrappers()."""
    schema = pa.schema([("host", pa.string()), ("node", pa.int32()), ("text", pa.float64()), ("links", pa.float64()), ("pages", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("page_low", pa.int64()), ("page_high", pa.int64())])

    def run(batches):
        cache = _Cache()

        def one(batch):
            out = []
            for host, shape_, n, low, high, parts, wrapper in zip(*(batch.column(k).to_pylist() for k in ("host", "shape", "n", "page_low", "page_high", "parts", "wrapper"))):
                top = _from_portable(shape_)
                number = {id(p): k for k, p in enumerate(listed(top))}
                by: dict[int, list] = {}
                for part, w in cache[wrapper].match(top):
                    x = parts[number[id(part)]]
                    row = by.setdefault(w, [0.0, 0.0, n, x["low"], x["high"], low, high])
                    row[:5] = row[0] + x["text"], row[1] + x["links"], n, min(row[3], x["low"]), max(row[4], x["high"])
                out += [(host, w, *row) for w, row in by.items()]
            return dict(zip(schema.names, zip(*out))) if out else None

        yield from grouped(batches, "shape", schema, one)

    rows = _with_host(found, learned, "h", "wrapper").mapInArrow(run, "host string, node int, text double, links double, pages long, low long, high long, page_low long, page_high long")
    same = (F.min("low") == F.max("high")) & (F.min("page_low") != F.max("page_high"))
    return rows.groupBy("host", "node").agg(F.sum("text").alias("text"), F.sum("links").alias("links"), F.sum("pages").alias("pages"), same.alias("same"))


def verdicts(learned: DataFrame, held: DataFrame) -> DataFrame:
    """(host, wrapper, main, out) of wrappers() and sums()."""
    rows = held.groupBy("host").agg(F.collect_list(F.struct("node", "text", "links", "pages", "same")).alias("s")).join(learned, "host")  # a row for each wrapper node

    def one(batches):
        for pdf in batches:
            out = []
            for host, wrapper, s in zip(pdf["host"], pdf["wrapper"], pdf["s"]):
                rows = json.loads(wrapper)
                n = len(rows)
                text, links, pages, same = [0.0] * n, [0.0] * n, [0] * n, [False] * n
                for r in s:
                    text[r["node"]], links[r["node"]], pages[r["node"]], same[r["node"]] = r["text"], r["links"], r["pages"], r["same"]
                mains, gone = decide(rows, text, links, pages, same, pages[0])
                out.append((host, wrapper, mains, [i for i in range(n) if gone[i]]))
            yield pd.DataFrame(out, columns=["host", "wrapper", "main", "out"])

    return rows.mapInPandas(one, "host string, wrapper string, main array<int>, out array<int>")


def learn(pages: DataFrame) -> DataFrame:
    """(host, wrapper, main, out, lists) of each host of pages (url, html); lists: hashes of the link lists inside articles that more than two and a third of the host's pages share."""
    every = staged(structures(pages))
    found = every.where("shape is not null")
    inferred = staged(wrappers(found).select("host", "wrapper"))
    pages_of = found.groupBy("host").agg(F.sum("n").alias("pages"))
    shared = every.where("shape is null").join(pages_of, "host").where("n > 2 and 3 * n >= pages").groupBy("host").agg(F.collect_list("h").alias("lists"))  # a few times three a host
    chosen = verdicts(inferred, sums(found, inferred)).join(shared, "host", "left")
    return staged(chosen.withColumn("lists", F.coalesce("lists", F.array().cast("array<bigint>"))))


def extract_pages(pages: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages (page_id, url, html). learned: what learn() says, made here if there is none."""
    learned = learn(pages) if learned is None else learned
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of("url"))
    rows = _with_host(rows.withColumn("html", F.coalesce("html", F.lit(""))), learned, "html", "wrapper", "main", "out", "lists").select("page_id", "url", "html", "wrapper", "main", "out", "lists")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        cache = _Cache()

        def one(batch):
            text = [extract(h, cache[w] if w else None, frozenset(m or ()), frozenset(o or ()), frozenset(x or ())) for h, w, m, o, x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5, 6)))]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": text, "n_chars": [len(t) for t in text]}

        yield from grouped(batches, "html", schema, one)

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
