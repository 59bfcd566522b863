"""A lenient reading of HTML into blocks of text and a folded tree of containers.

``read`` gives a page's blocks (whole text, references decoded, white space turned into one space) in page order,
each with the container that holds it, and the tree of containers.  Elements that are boilerplate by what they say of
themselves (scripts, menus, headers, footers, sidebars, forms, adverts, notices, reader comments) hold no blocks and are no
part of the tree.  Paragraphs, headings, lists and the like without names are text of their container; containers with names
(class, id, role) are one node for all equally named ones of a parent; unnamed ones are folded with the one before if they have the
same structure, so that a tree is small however long the page is.  Nothing here recurses over the depth of the page.
"""

from __future__ import annotations

import html
import json
import re

#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style noscript template title svg math iframe object canvas video audio select button option "
                    "textarea".split())
#: Of these, the ones that without an end tag run to the end of the page.
RAW = frozenset("script style noscript template title textarea".split())
#: Elements that begin a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split())
#: Blocks that are text of their container if they have no name.
FLOW = frozenset(
    "address blockquote caption center dd details dir dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup legend li ol p pre summary "
    "table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that end when one of the others begins inside the same list, table or block.
ENDED_BY = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"},
            "td": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
            **{h: HEADINGS for h in HEADINGS}}
#: What lies outside these is not ended by what begins inside.
SCOPES = frozenset(("ul", "ol", "dl", "dir", "table"))
#: Boilerplate by element, by role, by a word of class or id.
BARE = frozenset("nav header footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
WORDS = COMMENT_WORDS | frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead header footer sidebar aside ad ads advert adverts "
    "advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal "
    "overlay newsletter subscribe signup login share sharing social related recommended pagination pager skip copyright".split())
#: Elements that lie deeper than this are text of the container at this depth.
MAX_DEPTH = 48

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?|[\"'])*+)(?:>|\Z)"
                  r"|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """A container of the folded tree: its label (tag and names), children, and what it was folded into.  Its shape tells
    apart what is folded: an unnamed one's also has the kinds of blocks in it."""

    __slots__ = ("flow", "into", "kids", "label", "shape")

    def __init__(self, label: str) -> None:
        self.label, self.kids, self.into, self.shape = label, [], None, label
        self.flow: set[str] = set()

    def seal(self) -> None:
        kinds = f"[{','.join(sorted(self.flow))}]" if self.flow and "." not in self.label else ""
        self.shape = f"{self.label}{kinds}({''.join(k.shape for k in self.kids)})"


def alike(a: str, b: str) -> int:
    """Weight of a match of two labels: 2 for equal ones, 1 for equal tags whose names meet or of which one has none, else 0."""
    if a == b:
        return 2
    x, y = a.split("."), b.split(".")
    return int(x[0] == y[0] and (len(x) == 1 or len(y) == 1 or bool(set(x[1:]) & set(y[1:]))))


def match(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching: the weight of the largest matching of two trees that keeps parents and the order of
    children."""
    found = memo.get((id(a), id(b)))
    if found is None:
        found = alike(a.label, b.label)
        if found and a.kids and b.kids:
            found += _table(a.kids, b.kids, memo)[-1][-1]
        memo[id(a), id(b)] = found
    return found


def _table(xs: list[Node], ys: list[Node], memo: dict) -> list[list[int]]:
    table = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = table[-1], [0]
        for j, y in enumerate(ys):
            row.append(max(above[j + 1], row[j], above[j] + match(x, y, memo)))
        table.append(row)
    return table


def pairs(xs: list[Node], ys: list[Node], memo: dict) -> list[tuple[int | None, int | None]]:
    """The children of two matched nodes side by side in order; None where one has no partner."""
    i = 0
    while i < len(xs) and i < len(ys) and xs[i].shape == ys[i].shape:
        i += 1
    head: list[tuple[int | None, int | None]] = [(k, k) for k in range(i)]
    table = _table(xs[i:], ys[i:], memo)
    a, b, back = len(xs) - i, len(ys) - i, []
    while a or b:
        if a and b and (w := match(xs[i + a - 1], ys[i + b - 1], memo)) and table[a][b] == table[a - 1][b - 1] + w:
            a, b = a - 1, b - 1
            back.append((i + a, i + b))
        elif b and table[a][b] == table[a][b - 1]:
            b -= 1
            back.append((None, i + b))
        else:
            a -= 1
            back.append((i + a, None))
    return head + back[::-1]


def merge(a: Node, b: Node) -> None:
    """Folds b into a: matched descendants become one, the others are put in where they stand."""
    memo: dict = {}
    todo = [(a, b)]
    done = []
    while todo:
        x, y = todo.pop()
        y.into = x
        x.flow |= y.flow
        done.append(x)
        if not y.kids:
            continue
        kids = []
        for i, j in pairs(x.kids, y.kids, memo):
            if i is None:
                kids.append(y.kids[j])
            else:
                kids.append(x.kids[i])
                if j is not None:
                    todo.append((x.kids[i], y.kids[j]))
        x.kids = kids
    for x in reversed(done):
        x.seal()


def fold(kids: list[Node]) -> list[Node]:
    """Equally named siblings become one node, unnamed ones of the same structure one with the sibling before."""
    out: list[Node] = []
    named: dict[str, Node] = {}
    for k in kids:
        if "." in k.label:
            if k.label in named:
                merge(named[k.label], k)
            else:
                named[k.label] = k
                out.append(k)
        elif out and out[-1].shape == k.shape:
            merge(out[-1], k)
        else:
            out.append(k)
    return out


def preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += reversed(x.kids)
    return out


def dump(root: Node) -> str:
    """A tree as text: in preorder, each node's label and number of children."""
    return json.dumps([[x.label, len(x.kids)] for x in preorder(root)], separators=(",", ":"))


def load(text: str) -> Node:
    rows = json.loads(text)
    root = Node(rows[0][0])
    open_ = [(root, rows[0][1])]
    every = [root]
    for label, n in rows[1:]:
        while not open_[-1][1]:
            open_.pop()
        node = Node(label)
        every.append(node)
        up, left = open_[-1]
        up.kids.append(node)
        open_[-1] = (up, left - 1)
        open_.append((node, n))
    for node in reversed(every):
        node.seal()
    return root


def align(page: Node, wrapper: Node) -> list[int]:
    """For every node of a page's tree in preorder the preorder number of its partner in the wrapper, else -1."""
    number = {id(x): i for i, x in enumerate(preorder(wrapper))}
    partner: dict[int, int] = {}
    memo: dict = {}
    todo = [(page, wrapper)]
    while todo:
        x, y = todo.pop()
        partner[id(x)] = number[id(y)]
        if x.kids and y.kids:
            todo += [(x.kids[i], y.kids[j]) for i, j in pairs(x.kids, y.kids, memo) if i is not None and j is not None]
    return [partner.get(id(x), -1) for x in preorder(page)]


class _Element:
    __slots__ = ("bare", "comment", "depth", "holds", "main", "names", "node", "tag", "up", "wordy")

    def __init__(self, tag: str, up: _Element | None) -> None:
        self.tag, self.up = tag, up
        self.depth = up.depth + 1 if up else 0
        self.names: list[str] = []
        self.bare = self.wordy = self.holds = self.comment = self.main = False
        self.node: Node | None = None


def _describe(element: _Element, attributes: str) -> None:
    """Names and what they say, from class, id, role, hidden and the like."""
    tag = element.tag
    element.bare = tag in BARE
    names: list[str] = []
    if "=" in attributes or "hidden" in attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                names += [t for t in html.unescape(value).split() if t]
            elif key == "role":
                element.bare |= value.lower() in ROLES
                element.main |= value.lower() == "main"
            elif key == "itemprop":
                element.main |= value == "articleBody"
            elif key == "style":
                element.bare |= re.sub(r"\s", "", value.lower()).find("display:none") >= 0
            elif key == "hidden" or value.lower() == "true":
                element.bare = True
    words = {w.lower() for t in names for w in _NAME.findall(t)}
    element.comment = bool(words & COMMENT_WORDS)
    element.main |= tag == "main" or tag == "article" and not element.comment
    element.wordy = bool(words & WORDS) and tag not in ("html", "body", "main")
    # long numbers in names are those of a page
    element.names = sorted({t.lower().replace(".", "-") for t in names if sum(ch.isdigit() for ch in t) < 3})


class Page:
    """Blocks as (text, code points in links, number of the container in the tree) and the tree itself."""

    __slots__ = ("blocks", "mains", "tree")

    def __init__(self, blocks: list[tuple[str, int, int]], tree: Node, mains: list[int]) -> None:
        self.blocks, self.tree, self.mains = blocks, tree, mains


def read(source: str) -> Page:
    """The blocks and the tree of one page."""
    root = _Element("html", None)
    elements = [root]
    stack = [root]
    raw: list[tuple[_Element, str, int]] = []
    text: list[str] = []
    linked = 0
    link_depth = 0  # height of the stack in which a link was opened
    endless: set[str] = set()  # skipped elements of which no end is left
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                raw.append((stack[-1], whole, min(linked, len(whole))))
            text.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            if "&" in piece:
                piece = html.unescape(piece)
            text.append(piece)
            if link_depth:
                linked += len(piece)

    while at < len(source):
        tag = _TAG.search(source, at)
        if not tag:
            say(source[at:])
            break
        say(source[at:tag.start()])
        at = tag.end()
        name, attributes = (tag.group(2) or "").lower(), tag.group(3) or ""
        if not name:
            continue
        if tag.group(1):
            if name == "a":
                link_depth = 0
            elif name == "br":
                say(" ")
            elif name in BLOCKS and name not in ("html", "body"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name:
                        flush()
                        del stack[k:]
                        if link_depth > len(stack):
                            link_depth = 0
                        break
            continue
        if name in SKIPPED:
            if name not in endless and not attributes.endswith("/"):
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
                if end:
                    at = end.start()
                elif name in RAW:
                    break
                else:
                    endless.add(name)
            continue
        if name == "a":
            link_depth = len(stack)
        elif name == "br" or name == "hr":
            say(" ")
        elif name in BLOCKS and name not in ("html", "body"):
            flush()
            k = len(stack) - 1
            while k and stack[k].tag in FLOW and stack[k].tag not in SCOPES:
                if name in ENDED_BY.get(stack[k].tag, ()):
                    del stack[k:]
                k -= 1
            element = _Element(name, stack[-1])
            _describe(element, attributes)
            elements.append(element)
            stack.append(element)
            if link_depth > len(stack):
                link_depth = 0
    flush()
    return _build(elements, raw)


def _build(elements: list[_Element], raw: list[tuple[_Element, str, int]]) -> Page:
    size = {id(e): 0 for e in elements}
    for e, text, _ in raw:
        size[id(e)] += len(text)
    for e in reversed(elements[1:]):
        size[id(e.up)] += size[id(e)]
    # names of boilerplate count for nothing around a main element, a first heading or the longest article
    anchors = [e for e in elements if e.tag == "h1" or e.main and e.tag != "article"]
    anchors += sorted((e for e in elements if e.main and e.tag == "article"), key=lambda e: size[id(e)])[-1:]
    for e in anchors:
        up = e.up
        while up and not up.holds:
            up.holds = True
            up = up.up
    gone: set[int] = set()
    inside: set[int] = set()  # in an article or the like
    heads: dict[int, bool] = {}  # in a header of an article: whether in a heading
    for e in elements:
        up = e.up
        if up is None:
            e.node = Node("html")
            continue
        if id(up) in inside or up.main:
            inside.add(id(e))
        if id(up) in heads or e.tag == "header" and id(e) in inside:
            heads[id(e)] = heads.get(id(up), False) or e.tag in HEADINGS
        bare = e.bare and not (e.tag in ("header",) and id(e) in inside) and not (e.tag == "form" and e.holds)
        if id(up) in gone or bare or e.wordy and not e.holds and not (e.main and not e.comment):
            gone.add(id(e))
            continue
        if e.depth > MAX_DEPTH or e.tag in FLOW and not e.names or id(e) in heads:
            e.node = up.node
            e.node.flow.add(e.tag)
        else:
            e.node = Node(".".join([e.tag, *e.names]))
            up.node.kids.append(e.node)
    nodes = []
    todo = [elements[0].node]
    while todo:
        x = todo.pop()
        nodes.append(x)
        todo += x.kids
    for x in reversed(nodes):
        x.kids = fold(x.kids)
        x.seal()
    tree = elements[0].node
    number = {id(x): i for i, x in enumerate(preorder(tree))}

    def place(node: Node) -> int:
        while node.into is not None:
            node = node.into
        return number[id(node)]

    mains = sorted({place(e.node) for e in elements if e.main and id(e) not in gone and e.node})
    blocks = [(text, links, place(e.node)) for e, text, links in raw if id(e) not in gone and heads.get(id(e), True)]
    return Page(blocks, tree, mains)
