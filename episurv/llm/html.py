"""Main text of web pages by wrapper induction.

Pages of a host are parsed to trees, siblings of one kind folded into one node, and the trees aligned by simple tree
matching into one wrapper per host. A wrapper node whose text is the same on all its pages is template, one whose text
varies is a slot. The content region is the article that holds slots, or, where pages have none, the smallest node that holds
most of the varying text outside of menus and the like. Each page is aligned to its host's wrapper. What its
part of the region says is the main text: all of an article, and where no tag names the article, the slots without the template.

Trees are walked without recursion, so pages may be nested to any depth. A wrapper forgets nodes that few of its pages have, so
it does not grow with their number.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Collection, Generator, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episurv.llm.common import stored

#: Elements of HTML by their role in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
CONTAINERS = set(
    "html body main article section nav aside header footer div form table tbody thead tfoot tr td th ul ol dl blockquote "
    "figure fieldset".split()
)
ENDS_PARAGRAPH = CONTAINERS | set("address details dir h1 h2 h3 h4 h5 h6 hr menu p pre".split())
ENDS_LIKE = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
RAW = {"script", "style", "noscript", "iframe", "textarea", "title", "xmp"}
NOISE_TAGS = set(
    "head title nav header footer aside form script style noscript template iframe object svg canvas button select textarea "
    "input dialog menu audio video".split()
)
HEADINGS = {"h1", "h2", "h3"}
#: Words in class, id or role that mark menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer contentinfo sidebar complementary notice notices cookie cookies consent gdpr popup "
    "modal newsletter subscribe search comment comments disqus respond form login".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)()[^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CLASS = re.compile(r"[a-z][a-z_-]*")

#: Pages after which a wrapper is thinned; nodes on less than this share of them are forgotten.
THIN_EVERY, THIN_SHARE = 32, 1 / 16
#: Pages that must agree on a text before it is template.
TEMPLATE_PAGES = 3


def _run(call: Generator):
    """The value of a function that yields the calls it depends on; depth is bounded by memory only."""
    stack, value = [call], None
    while stack:
        try:
            further = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(further)
            value = None
    return value


class Node:
    """An element; children are elements and strings of text. Noise by its tag, or by whole words of class, id or role."""

    __slots__ = ("tag", "key", "noise", "marked", "children")

    def __init__(self, tag: str, attributes: str = ""):
        classes, marked = [], False
        if attributes:
            for name, *value in _ATTRIBUTE.findall(attributes):
                words = "".join(value).lower().split()
                marked = marked or not NOISE_WORDS.isdisjoint(words)
                if name.lower() != "id":  # ids differ from page to page
                    classes += filter(_CLASS.fullmatch, words)
        self.tag = tag
        self.key = " ".join([tag, *sorted(set(classes))])
        self.marked = marked and tag not in ("body", "html")
        self.noise = tag in NOISE_TAGS or self.marked
        self.children: list = []


def _elements(root: Node) -> Iterator[tuple[Node, list[Node]]]:
    """Each element below the root with the elements around it, outermost first. The list is the walk's own."""
    path: list[Node] = []
    stack: list = [iter(root.children)]
    while stack:
        for child in stack[-1]:
            if isinstance(child, Node):
                yield child, path
                path.append(child)
                stack.append(iter(child.children))
                break
        else:
            stack.pop()
            if path:
                path.pop()


def lift_marks(root: Node) -> None:
    """Marks of an element count for nothing if they would cost the page its article: around or on articles (or else mains, or
    else any text) of which none stands clear of marks."""

    def clear(nodes: list[Node]) -> bool:
        return not any(n.noise for n in nodes)

    for kinds in (("article",), ("main",), None):
        hidden: list[Node] = []
        for node, path in _elements(root):
            if kinds is None:
                if not any(isinstance(c, str) and not c.isspace() for c in node.children):
                    continue
            elif node.tag not in kinds:
                continue
            around = [*path, node]
            if clear(around):
                return
            if not any(n.tag in NOISE_TAGS for n in around):
                hidden += [n for n in around if n.marked]
        if hidden:
            for node in hidden:
                node.noise = False
            return


def parse(page: str) -> Node:
    """The tree of a page; whatever is not closed ends with what contains it."""
    root = Node("#root")
    stack, at = [root], 0
    opened: Counter[str] = Counter()  # open elements by tag

    def close(depth: int) -> None:
        opened.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    while m := _TAG.search(page, at):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if tag not in CONTAINERS and stack[depth].tag in CONTAINERS:
                    break
            continue
        like = {"p"} if tag in ENDS_PARAGRAPH else set()
        like |= ENDS_LIKE.get(tag, set())
        if any(opened[t] > 0 for t in like):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in like:
                    close(depth)
                    if tag not in ("tr",):
                        break
                    continue
                if stack[depth].tag in CONTAINERS and stack[depth].tag not in ("tr", "td", "th"):
                    break
        node = Node(tag, m[3] or "")
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3] or "").endswith("/") or tag in CONTAINERS:
            stack.append(node)
            opened[tag] += 1
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(text.split())) >> 1


class Shape:
    """A node of an aligned tree: digest of its own text, or None if that varies; its text's length; pages that have it;
    on a page, the elements it stands for."""

    __slots__ = ("key", "noise", "digest", "mass", "pages", "children", "nodes")

    def __init__(self, key: str, noise: bool, digest: int | None, mass: int, pages: int, children: list, nodes: list):
        self.key, self.noise, self.digest, self.mass, self.pages = key, noise, digest, mass, pages
        self.children, self.nodes = children, nodes

    def below(self) -> Iterator[tuple[int, Shape]]:
        """This node and all below it in order, with their depths."""
        stack = [(0, self)]
        while stack:
            depth, shape = stack.pop()
            yield depth, shape
            stack += [(depth + 1, c) for c in reversed(shape.children)]

    def packed(self) -> list:
        return [[d, s.key, s.noise, s.digest, s.mass, s.pages] for d, s in self.below()]

    @classmethod
    def unpacked(cls, rows: list) -> Shape:
        path: list[Shape] = []
        for depth, *row in rows:
            shape = cls(*row, [], [])
            del path[depth:]
            if path:
                path[-1].children.append(shape)
            path.append(shape)
        return path[0]


def shape_of(root: Node) -> Shape:
    """The tree of one page, siblings of one kind that follow each other folded into one. Inline elements are text."""

    def opened(node: Node, text: list, children: list, inline: bool) -> tuple:
        return node, text, children, iter(() if node.noise else node.children), inline

    stack = [opened(root, [], [], False)]
    while True:
        node, text, children, rest, inline = stack[-1]
        for child in rest:
            if isinstance(child, str):
                text.append(child)
            elif child.tag in INLINE and not child.noise:
                stack.append(opened(child, text, children, True))
                break
            elif child.tag not in VOID:
                stack.append(opened(child, [], [], False))
                break
        else:
            stack.pop()
            if inline:
                continue
            own = "".join(text)
            shape = Shape(node.key, node.noise, _digest(own) if own.strip() else 0, len(own.strip()), 1, children, [node])
            if not stack:
                return shape
            before = stack[-1][2]
            if before and before[-1].key == shape.key:
                before[-1] = merged(before[-1], shape, same_page=True)
            else:
                before.append(shape)


def _same_children(a: Shape, b: Shape) -> bool:
    return [c.key for c in a.children] == [c.key for c in b.children]


def _match(a: Shape, b: Shape, memo: dict) -> Generator:
    """Simple tree matching: pairs of nodes that agree with their ancestors, in order."""
    known = (id(a), id(b))
    if known not in memo:
        if a.key != b.key:
            memo[known] = 0
        elif not a.children or not b.children:
            memo[known] = 1
        elif _same_children(a, b):
            total = 1
            for x, y in zip(a.children, b.children):
                total += yield _match(x, y, memo)
            memo[known] = total
        else:
            memo[known] = 1 + (yield _table(a, b, memo))[-1][-1]
    return memo[known]


def _table(a: Shape, b: Shape, memo: dict) -> Generator:
    rows = [[0] * (len(b.children) + 1)]
    for x in a.children:
        last, row = rows[-1], [0]
        for j, y in enumerate(b.children):
            match = (yield _match(x, y, memo)) if x.key == y.key else 0
            row.append(max(last[j + 1], row[j], last[j] + match))
        rows.append(row)
    return rows


def _aligned(a: Shape, b: Shape, memo: dict) -> Generator:
    """Children of both in order: matched pairs, and those that only one has."""
    if _same_children(a, b):
        return list(zip(a.children, b.children))
    table, i, j, out = (yield _table(a, b, memo)), len(a.children), len(b.children), []
    while i or j:
        match = (yield _match(a.children[i - 1], b.children[j - 1], memo)) if i and j else 0
        if match and table[i][j] == table[i - 1][j - 1] + match:
            i, j = i - 1, j - 1
            out.append((a.children[i], b.children[j]))
        elif i and table[i][j] == table[i - 1][j]:
            i -= 1
            out.append((a.children[i], None))
        else:
            j -= 1
            out.append((None, b.children[j]))
    return out[::-1]


def _merged(a: Shape, b: Shape, same_page: bool, memo: dict) -> Generator:
    children = []
    if a.children or b.children:
        for x, y in (yield _aligned(a, b, memo)):
            children.append((yield _merged(x, y, same_page, memo)) if x and y else x or y)
    if same_page:
        digest, pages = _digest(f"{a.digest} {b.digest}"), a.pages
    else:
        digest, pages = (a.digest if a.digest == b.digest else None), a.pages + b.pages
    return Shape(a.key, a.noise, digest, a.mass + b.mass, pages, children, a.nodes + b.nodes)


def merged(a: Shape, b: Shape, same_page: bool = False) -> Shape:
    """Both trees in one. Of one page, texts add up; of several, a text that differs varies."""
    return _run(_merged(a, b, same_page, {}))


def thinned(wrapper: Shape) -> Shape:
    """Without the nodes that less than THIN_SHARE of the pages have, once there are THIN_EVERY pages."""
    if wrapper.pages >= THIN_EVERY:
        for _, shape in wrapper.below():
            shape.children = [c for c in shape.children if c.pages >= wrapper.pages * THIN_SHARE]
    return wrapper


def _masses(root: Shape, slots: bool) -> dict[int, int]:
    """For each node the text below it outside of noise; with `slots`, only what varies or is missing on some pages."""
    out: dict[int, int] = {}
    for _, shape in reversed(list(root.below())):
        own = shape.mass if not slots or shape.digest is None or shape.pages < root.pages else 0
        out[id(shape)] = 0 if shape.noise else own + sum(out[id(c)] for c in shape.children)
    return out


def _landmarks(wrapper: Shape, kind: str) -> Iterator[tuple[list[int], Shape]]:
    """Outermost elements of a kind, outside of noise, and their paths."""
    stack: list[tuple[tuple | None, Shape]] = [(None, wrapper)]  # a path is its last step and the path before
    while stack:
        steps, shape = stack.pop()
        if shape.noise:
            continue
        words = shape.key.split()
        if words[0] == kind or kind == "main" and "main" in words[1:]:
            path = []
            while steps is not None:
                path.append(steps[0])
                steps = steps[1]
            yield path[::-1], shape
            continue
        stack += [((i, steps), shape.children[i]) for i in reversed(range(len(shape.children)))]


def region(wrapper: Shape) -> tuple[list[list[int]], bool]:
    """The paths (child numbers) to the content region: all articles, else all mains, else one node; and whether a tag names it."""
    everything = _masses(wrapper, False)
    for slots in (True, False):
        mass = _masses(wrapper, True) if slots else everything
        for kind in ("article", "main"):
            found = list(_landmarks(wrapper, kind))
            if any(mass[id(s)] for _, s in found):
                return [p for p, s in found if everything[id(s)]], True
        if whole := mass[id(wrapper)]:
            shape, path = wrapper, []
            # Not below the node whose own headings vary: they are the titles of what stands beside them.
            while shape.children and not any(c.key.split()[0] in HEADINGS and mass[id(c)] for c in shape.children):
                best = max(range(len(shape.children)), key=lambda i: mass[id(shape.children[i])])
                if shape.children[best].key.split()[0] == "p" or 2 * mass[id(shape.children[best])] <= whole:
                    break
                shape, path = shape.children[best], [*path, best]
            return [path], False
    return [[]], False


def _constant(root: Shape, pages: int) -> set[int]:
    """Nodes that are template with all that is below them."""
    out: set[int] = set()
    for _, shape in reversed(list(root.below())):
        if shape.digest is not None and shape.pages >= pages and all(id(c) in out for c in shape.children):
            out.add(id(shape))
    return out


def _region_nodes(page: Shape, wrapper: Shape, paths: list[list[int]], named: bool) -> tuple[list[Node], set[int]]:
    """The page's elements that are aligned with the wrapper's region, in page order; those of them, by id, that are template, where
    no tag names the region."""
    memo: dict = {}
    out: list[Node] = []
    template: set[int] = set()
    for path in paths:
        here, there = wrapper, page
        for i in path:
            there = next((x for w, x in _run(_aligned(here, there, memo)) if w is here.children[i]), None)
            if there is None:
                break
            here = here.children[i]
        if there is None:
            continue
        out += there.nodes
        constant = set() if named else _constant(here, TEMPLATE_PAGES)
        stack = [] if named or id(here) in constant else [(here, there)]
        while stack:
            for w, x in _run(_aligned(*stack.pop(), memo)):
                if w and x and id(w) in constant:
                    template.update(id(n) for n in x.nodes)
                elif w and x:
                    stack.append((w, x))
    return out, template


def text_of(nodes: list[Node], template: Collection[int] = ()) -> str:
    """Blocks of the elements in page order, noise and template left out, joined by one blank."""
    blocks: list[list[str]] = [[]]
    chosen = {id(n) for n in nodes}  # these are in, whatever they are
    stack: list = [iter(nodes)]
    ends = [True]  # whether a block ends with it
    while stack:
        for child in stack[-1]:
            if isinstance(child, str):
                blocks[-1].append(child)
                continue
            block = child.tag not in INLINE or len(stack) == 1  # a chosen one, or what starts a line of its own
            if block:
                blocks.append([])
            if id(child) in chosen or not child.noise and id(child) not in template:
                stack.append(iter(child.children))
                ends.append(block)
                break
        else:
            stack.pop()
            if ends.pop():
                blocks.append([])
    texts = ("".join(b) for b in blocks)
    return " ".join(t for b in texts if b and (t := " ".join((html.unescape(b) if "&" in b else b).split())))


def _body(root: Node) -> Node:
    """Head and body stand at one place, however a page nests or omits them."""
    while inner := next((n for n in root.children if isinstance(n, Node) and n.tag in ("html", "body")), None):
        root = inner
    return root


def _page_shape(page: str) -> Shape:
    body = _body(parse(page))
    lift_marks(body)
    shape = shape_of(body)
    shape.key = "body"
    return shape


def extract(page: str, wrapper: Shape | None, where: tuple[list[list[int]], bool]) -> str:
    """The main text of a page, by its host's wrapper; one that lacks the region is its own wrapper."""
    shape = _page_shape(page)
    nodes, template = _region_nodes(shape, wrapper, *where) if wrapper is not None else ([], set())
    text = text_of(nodes, template)
    if not text:
        nodes, template = _region_nodes(shape, shape, *region(shape))
        text = text_of(nodes, template)
    return text


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host among a task's pages."""
    wrappers: dict[str, Shape] = {}
    for batch in batches:
        hosts = batch.column("_host").to_pylist()
        for lo in range(0, batch.num_rows, 64):
            for host, page in zip(hosts[lo : lo + 64], batch.column("_html").slice(lo, 64).to_pylist()):
                if page:
                    shape = _light(_page_shape(page))
                    if host in wrappers:
                        shape = merged(wrappers[host], shape)
                        if shape.pages % THIN_EVERY == 0:
                            shape = thinned(shape)
                    wrappers[host] = shape
    if wrappers:
        names = list(wrappers)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names),
                pa.array([TaskContext.get().partitionId() % 64] * len(names), pa.int32()),
                pa.array([json.dumps(thinned(wrappers[n]).packed()) for n in names]),
            ],
            ["_host", "_part", "_wrapper"],
        )


def _light(shape: Shape) -> Shape:
    """Without the page's elements."""
    for _, part in shape.below():
        part.nodes = []
    return shape


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for text in sorted(group["_wrapper"]):
        shape = Shape.unpacked(json.loads(text))
        whole = shape if whole is None else thinned(merged(whole, shape))
    out = group.iloc[:1].copy()
    out["_wrapper"] = json.dumps(whole.packed())
    return out


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """(_host, _wrapper) from columns _host and _html: folded in each task, then in parts, then for each host."""
    schema = "_host string, _part int, _wrapper string"
    parts = pages.mapInArrow(_induce, schema).groupBy("_host", "_part").applyInPandas(_merge, schema)
    return parts.groupBy("_host").applyInPandas(_merge, schema).select("_host", "_wrapper")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each row: id, url, main text.

    Null and empty pages have empty text; pages without url or host are a host of their own. Depth does not matter. Repeated pages are pages like
    any other: where nothing varies, the region is found by text of any kind. An empty table gives an empty
    result; other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host.alias("_host"))
    wrappers = stored(induce_wrappers(rows.select("_host", "_html")), "wrappers")
    joined = rows.join(wrappers, "_host", "left")
    kinds = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Shape | None, tuple[list[list[int]], bool]]] = {}
        for batch in batches:
            texts = []
            names = batch.column("_wrapper")
            hosts = batch.column("_host").to_pylist()
            for i in range(batch.num_rows):
                page = batch.column("_html")[i].as_py()
                if not page:
                    texts.append("")
                    continue
                if hosts[i] not in known:
                    if len(known) == 256:
                        known.clear()
                    packed = names[i].as_py()
                    wrapper = Shape.unpacked(json.loads(packed)) if packed else None
                    known[hosts[i]] = (wrapper, region(wrapper) if wrapper else ([], False))
                texts.append(extract(page, *known[hosts[i]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string())], ["_id", "_url", "text"]
            )

    out = joined.select("_id", "_url", "_host", "_html", "_wrapper").mapInArrow(run, f"_id {kinds}, _url string, text string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text")
