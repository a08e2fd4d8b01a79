"""Main text of web pages by union-free regular-expression inference.

Pages of a host come from templates. Pages of one host whose containers nest alike
are aligned one after another: equal parts stay, differing texts become slots, parts
that only some pages have become optional, and neighbours that repeat, single
elements or groups of up to three, fold into a repeated group. The result, the wrapper of
the layout, is an expression of sequences, ``?`` and ``+`` without alternatives.

The wrapper says where the article is: from the root it follows the part that holds
most of the slot text of all pages, as far as that part is a container. Menus,
headers and footers, whose texts do not change, hold none. What tags, classes, ids or
roles mark as menu, header, footer, sidebar, notice, advert, form or comments
is left out besides, and lists of links. ``article`` and ``main`` elements around or in that
region widen it to themselves and give all their text. Texts that stay the same go where
nothing but the wrapper tells an article, and within articles only if a marked
region of the page holds the same text.

Every page takes part in the wrapper of its layout: map tasks fold their pages into
one wrapper for each host and layout, and these are merged in two steps, so pages are
never shuffled and a host with very many pages sends no more than a
small one. Layouts of fewer than ``SUPPORT`` different pages have no wrapper; their
pages fall back on article and main elements, or on the part with most text.

Defined results: NULL and empty html give an empty text; a NULL or odd url counts
as the host ``''``; repeated pages keep their rows; unclosed, crossed or cut-off
markup is read as far as it goes, however deep it nests; long pages are read whole.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Callable, Generator, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodline.llm.arrays import slices
from broodline.llm.graph import settled
from broodline.llm.html_tree import BLOCKS, Node, parse

#: Different pages on which a text must be the same to count as part of the template.
SUPPORT = 3
#: Wrappers go to every task up to so many bytes in all, and are joined by host and layout beyond.
BROADCAST_BYTES = 32 << 20
#: Wrappers that a map task holds before it sends them on.
HELD = 2000
#: Parts in which the wrappers of one layout are merged first.
SALTS = 32
#: Share of the text that makes a region the main one.
MAIN_SHARE = 0.7
#: Pairs of siblings that are compared by content; longer lists are aligned by their keys alone.
PAIRS = 40_000

LEFT_OUT_TAGS = frozenset(
    "head title nav header footer aside form button select option menu dialog label input fieldset "
    "legend object applet canvas audio video map datalist".split()
)
LEFT_OUT_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead topbar "
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup share sharing social related recommended recommendations teaser teasers comment "
    "comments commentlist respond disqus reply replies form search login widget widgets pagination pager "
    "skip skiplink legal copyright disclaimer toolbar hidden outbrain taboola complementary contentinfo "
    "paywall tracking".split()
)
#: Words that may stand beside one of those in a name without changing what it means.
NEUTRAL_NAMES = frozenset(
    "site page main top bottom left right center middle upper lower primary secondary global local inner outer "
    "box block wrapper wrap container area section region panel bar row column col list items item link links "
    "slot unit group holder frame body content contents posts articles stories news buttons button icons "
    "icon js id the and no print mobile desktop sticky fixed small large big new".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_NAMES = frozenset("main article".split())
#: Elements that a name leaves out below an article or main region.
CONTAINERS = frozenset("div section ul ol dl table figure details center header hgroup".split())
#: Elements of running text: always folded by their key, never a region.
TEXTUAL = frozenset("p li td th tr dt dd pre blockquote span b i em strong a h1 h2 h3 h4 h5 h6 #text".split())
#: Elements whose nesting tells layouts apart.
LAYOUT = frozenset("html body div section article main header footer nav aside form table center".split())
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def run(call: Generator):
    """The result of a recursive generator that yields calls of itself, without Python's stack."""
    calls, value = [call], None
    while calls:
        try:
            calls.append(calls[-1].send(value))
            value = None
        except StopIteration as done:
            calls.pop()
            value = done.value
    return value


# --- what is no article ------------------------------------------------------


def left_out(node: Node, inside_article: bool, whole_names: bool = False) -> bool:
    """Whether a node is no article text; ``whole_names`` holds below an article or main region."""
    if node.hidden or (node.tag in LEFT_OUT_TAGS and not (node.tag == "header" and inside_article)):
        return True
    if node.tag in ("html", "body", "main", "#text", "#root"):
        return False
    if (whole_names and node.tag != "article" and node.tag not in CONTAINERS) or not node.names:
        return False
    strict = node.tag == "p" or whole_names
    return any(is_left_out_name(name, strict) for name in node.names.split())


def is_left_out_name(name: str, strict: bool = True) -> bool:
    """Whether a class, id or role is made of nothing but words of the list, or, if not strict, neutral ones."""
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    listed = [p for p in parts if p in LEFT_OUT_NAMES]
    rest = [p for p in parts if p not in LEFT_OUT_NAMES]
    return bool(listed) and (not rest or (not strict and all(p in NEUTRAL_NAMES or len(p) == 1 for p in rest)))


def below(node: Node, enter: Callable[[Node], bool] = lambda n: True) -> Iterator[Node]:
    """A node's descendants in page order, only those of nodes that ``enter`` lets in."""
    todo = list(reversed(node.children))
    while todo:
        child = todo.pop()
        yield child
        if child.children and enter(child):
            todo += reversed(child.children)


def plain(text: str) -> str:
    return " ".join(text.split())


def is_link_list(node: Node) -> bool:
    """A list of at least two items whose text is nearly all links that lead off the page."""
    if node.tag not in ("ul", "ol", "dl"):
        return False
    total = linked = items = 0
    todo = [(node, False)]
    while todo:
        n, link = todo.pop()
        items += n.tag in ("li", "dd")
        if n.tag == "#text":
            total += len(n.text.strip())
            linked += len(n.text.strip()) * link
        todo += [(c, link or (c.tag == "a" and not c.local)) for c in n.children]
    return items >= 2 and total > 0 and linked >= 0.8 * total


# --- wrappers ----------------------------------------------------------------
# A wrapper node is a list: key; flags, "?" for optional, "+" for repeated and "!" for the region of the
# article; text, the constant text of a "#text" node or None for a slot; marks of up to SUPPORT different pages
# that have it; characters of its texts over all pages; children; and, in the expression of one page, its nodes.
KEY, FLAGS, TEXT, MARKS, CHARS, CHILDREN, NODES = range(7)
GROUP = "()"


def expression_of(tree: Node, mark: int) -> list:
    """A page as an expression with its repeats folded."""

    order, built = [tree], {}
    for node in order:  # parents first
        order += node.children
    for node in reversed(order):
        if node.tag == "#text":
            text = plain(node.text)
            built[id(node)] = ["#text", "", text, (mark,), len(text), [], [node]]
            continue
        children = [built[id(c)] for c in node.children if c.tag != "#text" or not c.text.isspace()]
        whole = [node.key, "", None, (mark,), 0, children, [node]]
        built[id(node)] = run(fold(whole)) if len(children) > 1 else whole
    return built[id(tree)]


def shape(node: list) -> frozenset:
    """What a node looks like: the paths of keys in the three levels below it, or the constant text it is."""
    if node[KEY] == "#text":
        return frozenset() if node[TEXT] is None else frozenset([node[TEXT]])
    found, level = set(), [((), node)]
    for _ in range(3):
        level = [((*path, c[KEY]), c) for path, n in level for c in n[CHILDREN]]
        found.update(path for path, _ in level)
    return frozenset(found)


def likeness(one: frozenset, other: frozenset) -> float:
    """How much two nodes of one key look alike, from 0 to 1."""
    return len(one & other) / len(one | other) if one or other else 1.0


def repeats(one: list, other: list) -> bool:
    """Whether two neighbours are the same part again."""
    if one[KEY] != other[KEY] or one[KEY] == "#text":
        return False
    return one[KEY].split(".")[0] in TEXTUAL or likeness(shape(one), shape(other)) >= 0.5


def fold(node: list) -> Generator:
    """Merge neighbours, and neighbouring groups of two or three, that repeat."""
    out: list[list] = []
    for child in node[CHILDREN]:
        if out and out[-1][KEY] == child[KEY] and repeats(out[-1], child):
            out[-1] = merge_flat(out[-1], child) or (yield merge(out[-1], child))
            out[-1][FLAGS] = flags(out[-1][FLAGS], "+")
        else:
            out.append(child)
    for size in (2, 3):
        at = 0
        while at + 2 * size <= len(out):
            if out[at][KEY] != out[at + size][KEY]:
                at += 1
                continue
            first, second = out[at : at + size], out[at + size : at + 2 * size]
            if any(c[KEY] in ("#text", GROUP) for c in first) or not all(map(repeats, first, second)):
                at += 1
                continue
            group = group_of(first)
            while at + 2 * size <= len(out) and all(map(repeats, group[CHILDREN], out[at + size : at + 2 * size])):
                group = yield merge(group, group_of(out[at + size : at + 2 * size]))
                del out[at + size : at + 2 * size]
            group[FLAGS] = "+"
            out[at : at + size] = [group]
            at += 1
    node[CHILDREN] = out
    return node


def group_of(parts: list[list]) -> list:
    marks = first_marks(m for p in parts for m in p[MARKS])
    return [GROUP, "", None, marks, 0, list(parts), []]


def flags(one: str, other: str) -> str:
    return one if one == other or not other else "".join(sorted({*one, *other}))


def first_marks(marks) -> tuple:
    """The least ``SUPPORT`` of the marks: they tell whether there are as many, whatever the order of merges."""
    return tuple(sorted(set(marks))[:SUPPORT])


def both_marks(one: list, other: list) -> tuple:
    return one[MARKS] if one[MARKS] == other[MARKS] else first_marks((*one[MARKS], *other[MARKS]))


def merge_flat(one: list, other: list) -> list | None:
    """:func:`merge` for elements with nothing but a text in them; None for others."""
    mine, theirs = one[CHILDREN], other[CHILDREN]
    if len(mine) > 1 or len(mine) != len(theirs):
        return None
    inner = []
    if mine:
        a, b = mine[0], theirs[0]
        if a[KEY] != "#text" or b[KEY] != "#text":
            return None
        inner = [merged(a, b, [])]
    return merged(one, other, inner)


def merged(one: list, other: list, children: list[list]) -> list:
    """What two nodes of one key have in common, over the given children; ``one`` is used up."""
    text = one[TEXT] if one[TEXT] == other[TEXT] else None
    nodes = one[NODES]
    nodes += other[NODES]
    return [
        one[KEY], flags(one[FLAGS], other[FLAGS]), text, both_marks(one, other), one[CHARS] + other[CHARS], children, nodes,
    ]


def aligned(one: list[list], other: list[list]) -> list[tuple[int, int]]:
    """Pairs of siblings of one key, in order: as many and as much alike as can be."""
    if [c[KEY] for c in one] == [c[KEY] for c in other]:
        return [(k, k) for k in range(len(one))]
    if len(one) * len(other) > PAIRS:
        keys = [c[KEY] for c in one], [c[KEY] for c in other]
        found = SequenceMatcher(None, *keys, autojunk=False).get_matching_blocks()
        return [(m.a + k, m.b + k) for m in found for k in range(m.size)]
    shapes = [[shape(c) for c in side] for side in (one, other)]

    def worth(i: int, j: int) -> float:
        sure = "?" not in one[i][FLAGS] and "?" not in other[j][FLAGS]
        return 1.0 + likeness(shapes[0][i], shapes[1][j]) + 0.25 * sure

    best = [[0.0] * (len(other) + 1) for _ in range(len(one) + 1)]
    for i in range(len(one) - 1, -1, -1):
        for j in range(len(other) - 1, -1, -1):
            value = max(best[i + 1][j], best[i][j + 1])
            if one[i][KEY] == other[j][KEY]:
                value = max(value, best[i + 1][j + 1] + worth(i, j))
            best[i][j] = value
    pairs, i, j = [], 0, 0
    while i < len(one) and j < len(other):
        if one[i][KEY] == other[j][KEY] and best[i][j] == best[i + 1][j + 1] + worth(i, j):
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return pairs


def merge(one: list, other: list) -> Generator:
    """The least expression that covers two of the same key."""
    mine, theirs = one[CHILDREN], other[CHILDREN]
    children: list[list] = []
    i = j = 0
    for a, b in [*aligned(mine, theirs), (len(mine), len(theirs))]:
        for part in (*mine[i:a], *theirs[j:b]):
            part[FLAGS] = flags(part[FLAGS], "?")
            children.append(part)
        if a < len(mine):
            children.append(merge_flat(mine[a], theirs[b]) or (yield merge(mine[a], theirs[b])))
        i, j = a + 1, b + 1
    node = merged(one, other, children)
    return (yield fold(node)) if len(children) > 1 else node


def mark_of(page: str) -> int:
    return int.from_bytes(hashlib.blake2b(page.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big")


def without_nodes(wrapper: list) -> list:
    todo = [wrapper]
    while todo:
        node = todo.pop()
        node[NODES] = []
        todo += node[CHILDREN]
    return wrapper


def folded(wrappers: list[list]) -> list:
    """One wrapper that covers all."""
    whole = wrappers[0]
    for other in wrappers[1:]:
        whole = run(merge(whole, other))
    return whole


def infer_wrapper(pages: list[str]) -> list:
    """The wrapper of pages of one layout, aligned one by one, with its region decided."""
    return decide(folded([without_nodes(expression_of(parse(page), mark_of(page))) for page in pages]))


def decide(wrapper: list) -> list:
    """Flag the container that holds most of the slot text, from the root on."""
    if len(wrapper[MARKS]) < SUPPORT:
        return wrapper
    weight: dict[int, int] = {}
    order = [wrapper]
    for node in order:  # parents first
        tag, _, names = node[KEY].partition(".")
        if node is wrapper or not (tag == "a" or left_out(Node(tag, names), False)):
            order += node[CHILDREN]
        else:
            weight[id(node)] = 0
    for node in reversed(order):
        if id(node) not in weight:
            own = node[CHARS] if node[KEY] == "#text" and node[TEXT] is None else 0
            weight[id(node)] = own + sum(weight[id(c)] for c in node[CHILDREN])
    region = wrapper
    while region[CHILDREN]:
        best = max(region[CHILDREN], key=lambda c: weight[id(c)])
        if (
            weight[id(best)] < MAIN_SHARE * max(weight[id(region)], 1)
            or "+" in best[FLAGS]
            or best[KEY].split(".")[0] in TEXTUAL
            or best[KEY] == GROUP
        ):
            break
        region = best
    region[FLAGS] = flags(region[FLAGS], "!")
    return wrapper


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression over tags, ``#TEXT`` slots and constant texts."""

    def build(node: list) -> Generator:
        if node[KEY] == "#text":
            body = "#TEXT" if node[TEXT] is None else repr(node[TEXT])
        else:
            parts = []
            for child in node[CHILDREN]:
                parts.append((yield build(child)))
            body = "".join(parts) if node[KEY] == GROUP else f"<{node[KEY]}>{''.join(parts)}</>"
        marks = node[FLAGS].replace("!", "")
        return f"({body}){'*' if marks == '+?' else marks}" if marks else body

    return run(build(wrapper))


def encoded(wrapper: list) -> str:
    """A wrapper as JSON: its nodes in order, each with the number of its children."""
    rows, todo = [], [wrapper]
    while todo:
        node = todo.pop()
        rows.append([*node[:CHILDREN], len(node[CHILDREN])])
        todo += reversed(node[CHILDREN])
    return json.dumps(rows)


def decoded(text: str) -> list:
    root, open_ = None, []
    for *fields, count in json.loads(text):
        node = [*fields, [], []]
        node[MARKS] = tuple(node[MARKS])
        if open_:
            open_[-1][0][CHILDREN].append(node)
            open_[-1][1] -= 1
        else:
            root = node
        while open_ and not open_[-1][1]:
            open_.pop()
        if count:
            open_.append([node, count])
    return root


def matched(page: list, wrapper: list) -> tuple[set[int], list[Node]]:
    """``id`` of a page's text nodes that the wrapper holds constant over enough pages, and its nodes of the region."""
    constant: set[int] = set()
    region: list[Node] = []
    todo = [(page, wrapper)]
    while todo:
        node, pattern = todo.pop()
        if "!" in pattern[FLAGS]:
            region += node[NODES]
        if node[KEY] == "#text" and node[TEXT] is not None and node[TEXT] == pattern[TEXT] and len(pattern[MARKS]) >= SUPPORT:
            constant |= {id(n) for n in node[NODES]}
        pairs = aligned(node[CHILDREN], pattern[CHILDREN])
        todo += [(node[CHILDREN][a], pattern[CHILDREN][b]) for a, b in pairs]
    return constant, region


def layout_of(tree: Node) -> str:
    """A digest of the nestings of containers that a page has."""
    paths, todo = set(), [(tree, ())]
    while todo:
        node, path = todo.pop()
        if node.tag in LAYOUT and len(path) < 12:
            path = (*path, node.tag)
            paths.add(path)
        todo += [(c, path) for c in node.children if c.children]
    return hashlib.blake2b(repr(sorted(paths)).encode(), digest_size=8).hexdigest()


# --- extraction --------------------------------------------------------------


def text_sizes(tree: Node, template: set[int], inside: bool) -> dict[int, int]:
    """Characters of slot text below each node, without left-out regions and links; by ``id``."""
    order, sizes = [tree], {}
    for node in order:
        if node is tree or not (node.tag == "a" or (node.tag != "#text" and left_out(node, inside, inside))):
            order += node.children
        else:
            sizes[id(node)] = 0
    for node in reversed(order):
        if id(node) not in sizes:
            own = len(node.text.strip()) if node.tag == "#text" and id(node) not in template else 0
            sizes[id(node)] = own + sum(sizes[id(c)] for c in node.children)
    return sizes


def marked_texts(tree: Node) -> set[str]:
    """The texts of all left-out regions of a page."""
    found, todo = set(), [(tree, False)]
    while todo:
        node, inside = todo.pop()
        for child in node.children:
            if child.tag == "#text":
                continue
            if left_out(child, inside, inside):
                found |= {plain(n.text) for n in below(child) if n.tag == "#text"}
            else:
                todo.append((child, inside or is_article(child) or is_main(child)))
    return found


def is_article(node: Node) -> bool:
    return node.tag == "article"


def is_main(node: Node) -> bool:
    return node.tag == "main" or "main" in node.names.lower().split()


def article_regions(tree: Node, template: set[int]) -> list[Node]:
    """All outermost article regions, or else main regions, if they hold text."""
    for wanted in (is_article, is_main):
        found = [
            n
            for n in below(tree, lambda n: not wanted(n) and not left_out(n, False))
            if n.tag != "#text" and wanted(n) and not left_out(n, False)
        ]
        if any(text_sizes(n, template, True)[id(n)] for n in found):
            return found
    return []


def main_region(tree: Node, template: set[int]) -> Node:
    """The region that holds most of the slot text of one page."""
    sizes, region = text_sizes(tree, template, False), tree
    while True:
        inner = [c for c in region.children if c.tag != "#text" and not left_out(c, False)]
        best = max(inner, key=lambda c: sizes[id(c)], default=None)
        if best is None or sizes[id(best)] < MAIN_SHARE * max(sizes[id(region)], 1) or best.tag in TEXTUAL:
            return region
        region = best


def blocks(region: Node, template: set[int], article: bool = False) -> list[str]:
    """The texts of the blocks of a region, in page order; blocks of nothing but template go."""
    out: list[list[str]] = [[]]
    filled = [False]  # whether the block has slot text
    todo: list[Node | None] = list(reversed(region.children))  # None ends a block
    while todo:
        child = todo.pop()
        if child is None:
            out.append([])
            filled.append(False)
        elif child.tag == "#text":
            out[-1].append(child.text)
            filled[-1] |= id(child) not in template
        elif child.tag == "br":
            out[-1].append(" ")
        elif not left_out(child, True, article) and not is_link_list(child):
            if child.tag in BLOCKS:
                out.append([])
                filled.append(False)
                todo.append(None)
            todo += reversed(child.children)
    kept = (b for b, has_slot in zip(out, filled, strict=True) if has_slot)
    texts = (plain(entities.unescape("".join(b))) for b in kept)
    return [t for t in texts if t]


def main_text(page: str | None, wrapper: list | None = None) -> str:
    return text_of(parse(page), wrapper) if page else ""


def text_of(tree: Node, wrapper: list | None) -> str:
    template, region = (set(), []) if wrapper is None else matched(expression_of(tree, 0), wrapper)
    repeated: set[int] = set()
    if template:
        texts = [n for n in below(tree) if id(n) in template]
        marked = marked_texts(tree)
        repeated = {id(n) for n in texts if plain(n.text) in marked}
    found = article_regions(tree, repeated)
    if found and (not region or meet(found, region)):
        return "\n".join(text for r in found for text in blocks(r, repeated, article=True))
    whole = region or [main_region(tree, template)]
    return "\n".join(t for r in whole for t in blocks(r, template)) or "\n".join(t for r in whole for t in blocks(r, repeated))


def meet(found: list[Node], region: list[Node]) -> bool:
    """Whether one of the nodes lies in one of the others, or holds it."""
    ours, theirs = {id(n) for n in found}, {id(n) for n in region}
    return (
        bool(ours & theirs)
        or any(id(n) in theirs for f in found for n in below(f))
        or any(id(n) in ours for r in region for n in below(r))
    )


def host_of(url: str):
    parsed = F.regexp_extract(F.lower(F.col(url)), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.coalesce(parsed, F.lit(""))


def layout_wrappers(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``host, layout, wrapper`` (JSON) of every layout with at least ``SUPPORT`` different pages.

    Each task folds its pages, then the tasks' wrappers of a layout are merged in
    ``SALTS`` parts and these once more.
    """
    rows = pages.select(host_of(url).alias("host"), F.col(html).cast("string").alias("html")).where(F.col("html") != "")
    schema = "host string, layout string, salt int, wrapper string"

    def sent(held: dict, salt: int) -> pa.RecordBatch:
        columns = zip(*((h, lay, salt, encoded(w)) for (h, lay), w in held.items()), strict=True)
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "layout", "salt", "wrapper"])

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        salt = TaskContext.get().partitionId() % SALTS
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = parse(page)
                key = (host, layout_of(tree))
                new = without_nodes(expression_of(tree, mark_of(page)))
                held[key] = run(merge(held[key], new)) if key in held else new
                if len(held) >= HELD:
                    yield sent(held, salt)
                    held = {}
        if held:
            yield sent(held, salt)

    def join(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def joined(group: pd.DataFrame) -> pd.DataFrame:
            whole = folded([decoded(w) for w in sorted(group["wrapper"])])
            if last:
                decide(whole)
            row = group.iloc[:1].copy()
            row["wrapper"] = [encoded(whole)]
            return row if not last or len(whole[MARKS]) >= SUPPORT else row.iloc[:0]

        return joined

    partial = rows.mapInArrow(infer, schema)
    salted = partial.groupBy("host", "layout", "salt").applyInPandas(join(False), schema)
    return salted.groupBy("host", "layout").applyInPandas(join(True), schema).drop("salt")


def extract_main_text(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``key, url, text, n_chars`` of every page."""
    spark = pages.sparkSession
    wrappers = settled(layout_wrappers(pages, url, html), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper").cast("long"))).first()[0] or 0
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).cast("string").alias("h"), host_of(url).alias("host"))
    schema = pages.select(key, url).schema.add("text", "string").add("n_chars", "long")
    held = None
    if size <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast({(r["host"], r["layout"]): r["wrapper"] for r in wrappers.collect()})
        rows = rows.withColumn("w", F.lit(None).cast("string"))
    else:

        @F.pandas_udf("string")
        def layout(page: pd.Series) -> pd.Series:
            return page.map(lambda p: layout_of(parse(p)) if p else "")

        side = wrappers.select(F.col("host").alias("__host"), F.col("layout").alias("__layout"), F.col("wrapper").alias("w"))
        rows = rows.withColumn("layout", layout("h"))
        rows = rows.join(side, (F.col("host") == F.col("__host")) & (F.col("layout") == F.col("__layout")), "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            for part in slices(batch):
                texts = []
                columns = (part.column(c).to_pylist() for c in ("h", "host", "w"))
                for page, host, wrapper in zip(*columns, strict=True):
                    tree = parse(page or "")
                    if held is not None:
                        wrapper = held.value.get((host, layout_of(tree)))
                    if wrapper is not None and wrapper not in known:
                        if len(known) > 500:
                            known.clear()
                        known[wrapper] = decoded(wrapper)
                    texts.append(text_of(tree, known.get(wrapper)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), part.column("u"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    [key, url, "text", "n_chars"],
                )

    return rows.select("k", "u", "h", "host", "w").mapInArrow(extract, schema)
