"""Main text of web pages by wrapper induction.

Pages of one host are parsed to block trees and folded, page by page, into one template tree: simple
tree matching aligns children of equal labels in order, matched nodes are merged, others added. A
text that stands at one node on every distinct page that has the node is constant and becomes
template; a node whose texts vary is a slot, and slots are content. Folding is associative, so tasks
fold their own pages and the partial templates of a host are folded in two rounds; no task sees all
pages of a host. A page is then matched with its host's template: constant texts go first, then what
stands in elements or under class names that mean menus, adverts, forms or comments.

Trees are walked without recursion and matched bottom-up with every pair of nodes weighed once, so
deep pages and deep pairs of pages cost what their nodes cost.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import few, written

#: A constant text is template from so many distinct pages on,
MIN_PAGES = 3
#: if its node stands on so large a share of the host's distinct pages,
MIN_SHARE = 0.5
#: and if at least this share of an article's blocks says something of its own: pages whose articles are
#: near copies of each other are no template.
MIN_OWN = 0.5
#: The share of the page's text that a node must hold to be a layout wrapper whatever its name says.
DOMINANT = 0.9
#: Nodes of all templates that a task holds before it sends them on, and of one template before its
#: nodes on less than RARE of its pages go.
HELD_NODES, LARGEST, RARE = 200_000, 20_000, 0.05
#: Children compared by the full table up to this product of their numbers, label by label beyond it.
TABLE = 250_000
#: Templates are sent to all tasks up to so many bytes; beyond, pages meet them in a salted join.
BROADCAST_BYTES = 32_000_000
_SALTS = 64
#: Partial templates of a host that are folded in one group, on average.
FAN = 16

#: Elements of HTML by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "label", "object", "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "mfenced", "menclose", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "none", "mtable", "mtr", "mtd", "maction", "semantics"}
DROPPED = {"head", "nav", "footer", "aside", "form", "dialog", "menu", "fieldset"}
#: Dropped without an end to the block they stand in.
SUNK = {"button", "select", "option", "optgroup", "template", "noscript", "svg", "canvas", "audio", "video", "datalist", "map", "annotation", "annotation-xml"}
RAW = "script|style|textarea|title|iframe|xmp|noembed|noframes"
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul", "li", "dd", "dt"}
ITEMS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Words that begin or end a class name, id or role of what is not the article.
BOILERPLATE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo related recommended replies reply search share sharing sidebar signup social sponsored sponsor subscribe toolbar widget complementary contentinfo".split()
)
#: Of these, words that mean many things: within an article they count on elements that hold blocks only.
AMBIGUOUS = {"banner", "notice", "notices", "notification", "recommended", "related", "replies", "reply", "search", "share", "sharing", "social", "sponsor", "widget", "complementary"}
#: Words that stand beside them in the names of boilerplate, and elements that hold blocks.
BESIDE = set("actions area articles bar block bottom box btn button buttons container content form group icon icons inner item items left link links list more news outer panel posts post right section site slot stories tag tags title tools top unit wrap wrapper".split())
HOLDERS = {"div", "section", "ul", "ol", "aside", "nav", "dl", "details", "footer", "header"}
#: Elements that a form must hold to be the wrapper of a page and no form to fill in.
PROSE = {"p", "h1", "h2", "h3", "article", "main", "section", "blockquote", "table", "ul", "ol"}
#: Of the words above, what says the same of an article element itself, as a whole class name.
_NO_ARTICLE = {"ad", "advert", "advertisement", "comment", "promo", "related", "reply", "sponsored", "teaser", "widget"}
#: A class name that begins so tells how a page is laid out, not what stands in it.
_LAYOUT = {"has", "is", "js", "no", "non", "not", "with", "without"}
#: Whole class names of a page's header; an article may have a header of its own.
_HEADER = {"header", "site-header", "main-header", "global-header", "page-top", "topbar", "top-bar"}
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*|[^>]*)>", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"[0-9]+")


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), value.strip("\"'"))
    return found


def _named(tokens: list[str]) -> bool:
    """Whether a class name, id or role means boilerplate by its first or last word."""
    for token in tokens:
        words = [w for w in re.split(r"[-_]+", _HUMP.sub("-", token).lower()) if w]
        if words and words[0] not in _LAYOUT and (words[0] in BOILERPLATE or words[-1] in BOILERPLATE or words[:2] == ["skip", "link"]):
            return True
    return False


def _named_within(tokens: list[str], tag: str) -> bool:
    """Whether a block of an article is boilerplate by its name: every word of one class name must say so,
    ambiguous words on elements that hold blocks only."""
    for token in tokens:
        words = [w for w in re.split(r"[-_]+", _DIGITS.sub("", _HUMP.sub("-", token)).lower()) if w]
        telling = [w for w in words if w in BOILERPLATE]
        if telling and all(w in BOILERPLATE or w in BESIDE for w in words) and (tag in HOLDERS or any(w not in AMBIGUOUS for w in telling)):
            return True
    return False


class Node:
    """A block of the page: content holds buffers (_Text) and child nodes in page order.

    gone: dropped whatever it holds; doubtful: dropped by its name, or a form, unless it turns out to
    be a wrapper of the page's layout; main: an element that says article.
    """

    __slots__ = ("tag", "label", "gone", "doubtful", "main", "content", "size", "wraps")

    def __init__(self, tag: str, found: dict[str, str] | None = None, outside_article: bool = True, within: bool = False) -> None:
        self.tag, self.label, self.content, self.size, self.wraps = tag, tag, [], 0, False
        self.main, self.gone, self.doubtful = tag in ("article", "main"), tag in DROPPED and tag not in ("form", "fieldset"), tag in ("form", "fieldset")
        heads = tag == "header"
        if found:
            tokens = " ".join(found[k] for k in ("class", "id", "role") if k in found).split()
            if tokens:
                self.label = f"{tag}.{_DIGITS.sub('', ' '.join(tokens))}"
            self.main = self.main or found.get("role") == "main" or found.get("itemprop") == "articleBody"
            heads = heads or any(t.lower() in _HEADER for t in tokens)
            if self.main:
                self.main = not _NO_ARTICLE & {t.lower() for t in tokens}
                self.gone = self.gone or not self.main
            elif tag not in ("html", "body"):
                self.doubtful = self.doubtful or (_named_within(tokens, tag) if within else _named(tokens))
            self.gone = self.gone or "hidden" in found
        self.gone = self.gone or (heads and outside_article)


class _Text:
    """The text of a block between two of its child blocks; plain if any of it stands outside of
    inline elements whose names mean boilerplate."""

    __slots__ = ("parts", "plain", "text")

    def __init__(self) -> None:
        self.parts, self.plain, self.text = [], False, ""


def parse(page: str) -> Node:
    """The block tree of a page; unclosed, misnested and cut-off markup is taken as browsers do."""
    root = Node("#page")
    #: Open elements: (tag, node that takes their content, inline, named as boilerplate).
    stack: list[tuple[str, Node, bool, bool]] = [("#page", root, False, False)]
    at, articles, mains = 0, 0, 0

    def put(text: str) -> None:
        _, node, _, named = stack[-1]
        if not node.content or type(node.content[-1]) is not _Text:
            node.content.append(_Text())
        last = node.content[-1]
        last.parts.append(text)
        if not named and not last.plain and not text.isspace():
            last.plain = True

    def close(index: int) -> None:
        nonlocal articles, mains
        articles -= sum(1 for tag, *_ in stack[index:] if tag == "article")
        mains -= sum(1 for _, node, inline, _ in stack[index:] if node.main and not inline)
        del stack[index:]

    # No tag ends behind the last >, so every tag that begins before it is matched at its first try.
    end, cut_off = page.rfind(">") + 1, False
    for m in _TOKEN.finditer(page, 0, end):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            cut_off = at == end and (not m[0].endswith("-->") if m[0].startswith("<!--") else bool(m[1]) and not re.search(rf"</{m[1]}\s*>\Z", m[0], re.IGNORECASE))
            continue
        tag = m[3].lower()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and not stack[i][2]:
                    break
            continue
        if tag in VOID and tag != "hr":
            if tag in ("br", "wbr"):
                put(" " if tag == "br" else "")
            continue
        if tag in INLINE or tag in SUNK:
            _, node, _, named = stack[-1]
            found = _attributes(m[4]) if m[4] else {}
            if tag in SUNK or "hidden" in found:
                node = Node(tag)
            elif found and not named:
                named = _named(" ".join(found[k] for k in ("class", "id", "role") if k in found).split())
            if not m[4].endswith("/") or tag in INLINE:
                stack.append((tag, node, tag in INLINE, named))
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if not stack[i][2]:
                    break
        if tag in ITEMS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag or {stack[i][0], tag} == {"dd", "dt"} or {stack[i][0], tag} == {"td", "th"}:
                    close(i)
                    break
                if stack[i][0] in ITEMS[tag]:
                    break
        node = Node(tag, _attributes(m[4]) if m[4] else None, not articles, mains > 0)
        stack[-1][1].content.append(node)
        if tag != "hr":
            stack.append((tag, node, False, False))
            articles += tag == "article"
            mains += node.main
    if at < len(page) and not cut_off:
        put(re.split(r"<[a-zA-Z/!?]", page[at:], maxsplit=1)[0])
    for node in _walk(root):
        for part in node.content:
            if type(part) is _Text:
                part.text = " ".join(html_lib.unescape("".join(part.parts)).split()) if part.plain else ""
                part.parts = []
    return root


def _walk(root: Node) -> Iterator[Node]:
    """All nodes, parents first, in page order."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(c for c in reversed(node.content) if type(c) is Node)


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


# --- templates -------------------------------------------------------------------------------------


class Tree:
    """A template node: label, pages that have it, whether its texts vary, texts on all those pages.

    One page is a template too; members are then the page's nodes behind the tree node.
    """

    __slots__ = ("label", "pages", "varies", "texts", "children", "members")

    def __init__(self, label: str, pages: int, varies: bool, texts: set[int], children: list[Tree], members: list[Node] | None = None) -> None:
        self.label, self.pages, self.varies, self.texts, self.children, self.members = label, pages, varies, texts, children, members or []


class Matcher:
    """Simple tree matching: every pair of nodes is weighed once, deepest pairs first."""

    def __init__(self) -> None:
        self.weights: dict[tuple[int, int], int] = {}
        #: Trees that were weighed stay alive, so that their numbers stay theirs.
        self.held: list = []

    def _pairs(self, a: list[Tree], b: list[Tree]) -> list[tuple[Tree, Tree]]:
        if [x.label for x in a] == [y.label for y in b]:
            return list(zip(a, b, strict=True))
        by_label: dict[str, list[Tree]] = {}
        for y in b:
            by_label.setdefault(y.label, []).append(y)
        return [(x, y) for x in a for y in by_label.get(x.label, ())]

    def weight(self, a: Tree, b: Tree) -> int:
        """Nodes in the largest order-keeping match of two trees whose roots match."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (id(x), id(y)) in self.weights:
                todo.pop()
                continue
            missing = [] if len(x.children) * len(y.children) > TABLE else [p for p in self._pairs(x.children, y.children) if (id(p[0]), id(p[1])) not in self.weights]
            if missing:
                todo.extend(missing)
                continue
            matched = self.align(x.children, y.children)
            self.weights[id(x), id(y)] = 1 + sum(self.weights.get((id(p), id(q)), 1) for p, q in matched if p is not None and q is not None)
            self.held.append((x, y))
            todo.pop()
        return self.weights[id(a), id(b)]

    def align(self, a: list[Tree], b: list[Tree]) -> list[tuple[Tree | None, Tree | None]]:
        """Pairs of children in order, (x, None) and (None, y) where one side has none."""
        if [x.label for x in a] == [y.label for y in b]:
            return list(zip(a, b, strict=True))
        if len(a) * len(b) > TABLE:
            return _greedy(a, b)
        own = {(i, j): self.weight(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if x.label == y.label}
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(len(b) - 1, -1, -1):
                w = own.get((i, j), 0)
                row[j] = max(below[j], row[j + 1], w + below[j + 1] if w else 0)
        out, i, j = [], 0, 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and (i, j) in own and best[i][j] == own[i, j] + best[i + 1][j + 1]:
                out.append((a[i], b[j]))
                i, j = i + 1, j + 1
            elif j >= len(b) or (i < len(a) and best[i][j] == best[i + 1][j]):
                out.append((a[i], None))
                i += 1
            else:
                out.append((None, b[j]))
                j += 1
        return out


def _greedy(a: list[Tree], b: list[Tree]) -> list[tuple[Tree | None, Tree | None]]:
    """Each child of a with the next child of b that has its label."""
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j].label, []).append(j)
    out, at = [], 0
    for x in a:
        ahead = places.get(x.label, [])
        while ahead and ahead[-1] < at:
            ahead.pop()
        if ahead:
            out.extend((None, y) for y in b[at : ahead[-1]])
            at = ahead[-1] + 1
            out.append((x, b[at - 1]))
        else:
            out.append((x, None))
    return out + [(None, y) for y in b[at:]]


def _merged(a: Tree, b: Tree, same_page: bool) -> Tree:
    """Both trees as one, by their match: of one page all texts together, of several pages the common ones."""
    matcher = Matcher()

    def joined(x: Tree, y: Tree) -> Tree:
        texts = x.texts | y.texts if same_page else x.texts & y.texts
        return Tree(x.label, 1 if same_page else x.pages + y.pages, not same_page and (x.varies or y.varies or x.texts != y.texts), texts, [], x.members + y.members)

    root = joined(a, b)
    todo = [(root, a, b)]
    while todo:
        out, x, y = todo.pop()
        for p, q in matcher.align(x.children, y.children):
            if p is not None and q is not None:
                out.children.append(joined(p, q))
                todo.append((out.children[-1], p, q))
            else:
                out.children.append(p if q is None else q)
    return root


def fold(a: Tree, b: Tree) -> Tree:
    """The template of all pages behind two templates; texts do not depend on the order of folding."""
    out = _merged(a, b, False)
    return pruned(out) if _nodes(out) > LARGEST else out


def _nodes(tree: Tree) -> int:
    n, todo = 0, [tree]
    while todo:
        n += 1
        todo.extend(todo.pop().children)
    return n


def pruned(tree: Tree) -> Tree:
    """Without nodes on less than RARE of the pages: they can't be template."""
    todo = [tree]
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if c.pages >= RARE * tree.pages]
        todo.extend(node.children)
    return tree


def skeleton(root: Node) -> Tree:
    """The page as a template of one page; runs of children with one label are one child."""
    made: dict[int, Tree] = {}
    for node in reversed(list(_walk(root))):
        texts: set[int] = set()
        runs: list[list[Tree]] = []
        if not node.gone:
            for part in node.content:
                if type(part) is _Text:
                    if part.text:
                        texts.add(_digest(part.text))
                elif runs and runs[-1][0].label == part.label:
                    runs[-1].append(made.pop(id(part)))
                else:
                    runs.append([made.pop(id(part))])
        children = []
        for run in runs:
            # By halves: each tree of a long run is merged a few times only.
            while len(run) > 1:
                run = [_merged(run[i], run[i + 1], True) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)]
            children.append(run[0])
        made[id(node)] = Tree(node.label, 1, False, texts, children, [node])
    return made[id(root)]


def to_json(tree: Tree) -> str:
    """Preorder rows (depth, label, pages, varies, texts): no nesting, so no depth is too much."""
    rows, todo = [], [(0, tree)]
    while todo:
        depth, node = todo.pop()
        rows.append([depth, node.label, node.pages, int(node.varies), sorted(node.texts)])
        todo.extend((depth + 1, c) for c in reversed(node.children))
    return json.dumps(rows, separators=(",", ":"))


def from_json(text: str) -> Tree:
    path: list[Tree] = []
    for depth, label, pages, varies, texts in json.loads(text):
        node = Tree(label, pages, bool(varies), set(texts), [])
        del path[depth:]
        if path:
            path[-1].children.append(node)
        path.append(node)
    return path[0]


# --- extraction ------------------------------------------------------------------------------------


def _constant_texts(root: Node, template: Tree | None, min_pages: int) -> dict[int, set[int]]:
    """The template's constant texts by page node, from the match of the page with the template."""
    out: dict[int, set[int]] = {}
    if template is None:
        return out
    matcher, least = Matcher(), max(min_pages, MIN_SHARE * template.pages)
    todo = [(skeleton(root), template)]
    while todo:
        x, y = todo.pop()
        if y.pages >= least and y.texts:
            for node in x.members:
                out[id(node)] = y.texts
        todo.extend((p, q) for p, q in matcher.align(x.children, y.children) if p is not None and q is not None)
    return out


def _varies(template: Tree) -> bool:
    todo = [template]
    while todo:
        node = todo.pop()
        if node.varies:
            return True
        todo.extend(node.children)
    return False


def _measure(nodes: list[Node]) -> None:
    """size: characters of a node's text without what is gone; wraps: it holds parts of a page's layout."""
    for node in reversed(nodes):
        size, wraps = 0, False
        for part in node.content:
            if type(part) is _Text:
                size += len(part.text)
            else:
                size += part.size
                wraps = wraps or part.wraps or part.gone or part.doubtful or part.main or part.tag == "header"
        node.size, node.wraps = 0 if node.gone else size, wraps


def _holds_prose(form: Node) -> bool:
    todo = [form]
    while todo:
        for part in todo.pop().content:
            if type(part) is Node:
                if part.tag in PROSE and part.size:
                    return True
                todo.append(part)
    return False


def _settle(root: Node, nodes: list[Node]) -> None:
    """Decides what is doubtful: a form or a named node that wraps most of the page's text and parts
    of its layout, or the only articles there are, is no boilerplate."""
    _measure(nodes)
    doubtful = [n for n in nodes if n.doubtful]
    if not doubtful:
        return
    for node in doubtful:
        if node.size >= DOMINANT * max(root.size, 1) and (node.wraps or (node.tag in ("form", "fieldset") and _holds_prose(node))):
            node.doubtful = False
    # Articles by how many doubtful nodes are around them: the fewest count, and those nodes are wrappers.
    least, found, todo = None, [], [(root, ())]
    while todo:
        node, around = todo.pop()
        if node.gone:
            continue
        around = (*around, node) if node.doubtful else around
        if node.main and node.size:
            if least is None or len(around) < least:
                least, found = len(around), []
            if len(around) == least:
                found.append(around)
            continue
        todo.extend((c, around) for c in node.content if type(c) is Node)
    for around in found:
        for node in around:
            node.doubtful = False
    for node in doubtful:
        node.gone = node.gone or node.doubtful
    _measure(nodes)


def _mains(root: Node) -> list[Node]:
    """The outermost main elements in page order; what is nested in them stays in its place."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.gone:
            continue
        if node.main and node.size:
            out.append(node)
        else:
            todo.extend(c for c in reversed(node.content) if type(c) is Node)
    return out


def _blocks(top: Node, constant: dict[int, set[int]]) -> Iterator[str]:
    todo: list = [top]
    while todo:
        part = todo.pop()
        if type(part) is str:
            yield part
        elif not part.gone:
            fixed = constant.get(id(part), ())
            for p in reversed(part.content):
                if type(p) is Node:
                    todo.append(p)
                elif p.text and (not fixed or _digest(p.text) not in fixed):
                    todo.append(p.text)


def main_text(page: str, template: Tree | None = None, min_pages: int = MIN_PAGES) -> str:
    """The blocks of all articles joined by line feeds; template is that of the page's host.

    Without an element that says article, all slots outside of boilerplate are content.
    """
    root = parse(page)
    if template is not None and not _varies(template):
        template = None
    constant = _constant_texts(root, template, min_pages)
    _settle(root, list(_walk(root)))
    mains = _mains(root)
    if not mains:
        return "\n".join(_blocks(root, constant))
    whole = [block for top in mains for block in _blocks(top, {})]
    slots = [block for top in mains for block in _blocks(top, constant)] if constant else whole
    if len(slots) < MIN_OWN * len(whole):
        slots = whole
    return "\n".join(slots)


def _template_rows(templates: dict[str, Tree]) -> pa.RecordBatch:
    rows = [to_json(t) for t in templates.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(templates), pa.string()), pa.array([xxhash.xxh32_intdigest(r) % _SALTS for r in rows], pa.int32()), pa.array(rows, pa.string())], names=["host", "salt", "template"])


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates: dict[str, Tree] = {}
    held = 0
    for batch in batches:
        for host, page in zip(batch.column("__host").to_pylist(), batch.column("__html").to_pylist(), strict=True):
            one = skeleton(parse(page))
            held += _nodes(one) if host not in templates else 0
            templates[host] = fold(templates[host], one) if host in templates else one
            _forget(templates[host])
            if held > HELD_NODES:
                yield _template_rows(templates)
                templates, held = {}, 0
    if templates:
        yield _template_rows(templates)


def _forget(tree: Tree) -> None:
    """Lets the page's nodes go."""
    todo = [tree]
    while todo:
        node = todo.pop()
        node.members = []
        todo.extend(node.children)


def _fold_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    out = None
    for row in sorted(pdf["template"]):
        one = from_json(row)
        out = one if out is None else fold(out, one)
    return pd.DataFrame({"host": pdf["host"].iloc[:1], "template": [to_json(out)]})


def _rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("__host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("__html"))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of every host and page digest in this task."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        keep = []
        for key in zip(batch.column("__host").to_pylist(), batch.column("__digest").to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def induce(pages: DataFrame) -> DataFrame:
    """(host, template JSON): one template for each host, over all its distinct pages.

    Only pages that have copies meet by digest, and only one of each from a task; all others are
    folded where they are read.
    """
    schema = "__host string, __html string, __digest long"
    rows = _rows(pages).select("__host", "__html", F.xxhash64("__host", "__html").alias("__digest"))
    copied = written(rows.groupBy("__digest").count().where("count > 1").select(F.col("__digest").alias("__copied")), "copied")
    known = few(copied, 1_000_000)
    alone = rows.join(known, rows["__digest"] == known["__copied"], "left_anti")
    copies = rows.join(known, rows["__digest"] == known["__copied"], "left_semi").mapInArrow(_distinct, schema)
    once = alone.unionByName(copies.repartition("__host", "__digest").mapInArrow(_distinct, schema))
    partial = once.select("__host", "__html").mapInArrow(_induce, "host string, salt int, template string").select("host", "template")
    while True:
        # A host's partial templates meet FAN at a time, in as many rounds as their number takes.
        partial = written(partial, "partial")
        most = partial.groupBy("host").count().agg(F.max("count")).first()[0] or 1
        if most == 1:
            return partial
        salt = F.pmod(F.xxhash64("template"), F.lit(-(-most // FAN)))
        partial = partial.withColumn("salt", salt).groupBy("host", "salt").applyInPandas(_fold_rows, "host string, template string")


_known: dict[str, Tree] = {}


def _template_of(row: str | None) -> Tree | None:
    if row is None:
        return None
    if row not in _known:
        if len(_known) > 64:
            _known.clear()
        _known[row] = from_json(row)
    return _known[row]


def _extract(min_pages: int, shared=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = map(shared.value.get, batch.column("__host").to_pylist()) if shared is not None else batch.column("template").to_pylist()
            texts = [main_text(page, _template_of(row), min_pages) for page, row in zip(batch.column("__html").to_pylist(), rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null html is an empty page with an empty text; a null or odd url belongs to the host of empty
    name. Repeated rows give repeated rows, a null page_id is carried along, other columns are
    ignored, an empty table gives no rows. The size of all templates is summed first: up to
    broadcast_bytes they go to the pages, which are not shuffled; beyond, pages and templates meet by
    host and a salt, so a host's pages are dealt to many tasks.
    """
    templates = written(induce(pages).withColumnRenamed("host", "__host"), "templates")
    rows, schema = _rows(pages), "page_id long, url string, text string"
    size = templates.agg(F.sum(F.octet_length("template") + F.octet_length("__host"))).first()[0] or 0
    if size <= broadcast_bytes:
        sent = pages.sparkSession.sparkContext.broadcast({r["__host"]: r["template"] for r in templates.collect()})
        out = rows.mapInArrow(_extract(min_pages, sent), schema)
    else:
        salted = templates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int"))
        joined = rows.join(salted, ["__host", "__salt"], "left")
        out = joined.select("page_id", "url", "__html", "template").mapInArrow(_extract(min_pages), schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))
