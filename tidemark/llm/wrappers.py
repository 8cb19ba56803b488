"""Main text of pages by wrappers: union-free regular expressions that same-host pages are aligned into."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Written, row_key

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|svg|template|object)(?=[\s/>])(?:[^>]*[\s\"'])?/>"
    r"|<(?P<held>script|style|textarea|title|noscript|iframe|svg|template|object)(?=[\s/>])[^>]*+>.*?(?:</(?P=held)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?(?P<torn>[a-z][^\s/>]*)[^>]*+>|<[!?/][^>]*+>",
    re.I | re.S,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: An opening tag that ends an open element of its own kind among these, up to the list or table it stands in.
ENDS_OWN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
MAIN = ("article", "main")
#: What a head may hold; anything else, text too, ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: A text is the template's if it is the same on this many different pages of a host at least.
TEMPLATE = 3
#: Parts of classes and ids that number a page or an element and name no kind of it.
NUMBER = re.compile(r"\d+|.*\d\d.*")
#: Elements, and words in the classes, ids and roles of elements, that hold no main text.
ASIDE = frozenset("nav footer aside form button select dialog menu fieldset".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent notice notices alert popup modal newsletter subscribe subscription menu nav navbar navigation sidebar footer header masthead complementary contentinfo search comment comments commentlist respond replies disqus related share sharing social breadcrumb breadcrumbs login signup pagination pager widget".split()
)

#: Of these names, those that also name what holds the text itself: a page of search results, a notice, a widget of a page builder.
DOUBTFUL = frozenset("notice notices alert search related header banner promo widget modal popup subscription share sharing social pagination pager".split())

#: Elements whose classes and ids speak of the page, not of what is beside its text.
WHOLE = frozenset(("html", "body", *MAIN))


class Node:
    """An element (or, with the label "", a text slot) of a page or a wrapper. In a wrapper, `repeated` and `optional` stand for + and ?,
    a slot's constant is a hash of its text as long as all pages agree on it, `mass` counts the characters of all its texts, and `pages` has
    the least TEMPLATE of the hashes of the different pages that hold the slot."""

    __slots__ = ("constant", "kids", "label", "mass", "optional", "pages", "repeated", "text")

    def __init__(self, label: str, text: str = ""):
        self.label, self.text, self.kids, self.repeated, self.optional, self.pages = label, text, [], False, False, ()
        self.mass = len(text.strip())
        self.constant = zlib.crc32(" ".join(text.split()).encode("utf-8", "surrogatepass")) if text else None

    def plain(self) -> list:
        """All nodes, each before its kids, so that no depth of nesting is too much for JSON."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            out.append([node.label, node.constant, int(node.repeated), int(node.optional), node.pages, node.mass, len(node.kids)])
            todo.extend(reversed(node.kids))
        return out

    @classmethod
    def of(cls, nodes: list) -> Node:
        top = cls("")
        todo, deepest = [(top, 1)], 1
        for label, constant, repeated, optional, pages, mass, kids in nodes:
            while todo[-1][1] == 0:
                todo.pop()
            above, left = todo[-1]
            todo[-1] = (above, left - 1)
            node = cls(label)
            node.constant, node.repeated, node.optional, node.pages, node.mass = constant, bool(repeated), bool(optional), tuple(pages), mass
            above.kids.append(node)
            todo.append((node, kids))
            deepest = max(deepest, len(todo))
        deep(deepest)
        return top.kids[0]


def deep(levels: int) -> None:
    """Lets `merge` and `fold` go down so many levels; calls from Python to Python lie on the heap."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * levels + 1000))


def parse(page: str | None) -> Node:
    """The tree of a page, with missing end tags supplied, at any depth. Script, style, the head and the like and comments leave
    nothing; of inline elements those without a class, id or role leave only their text. A head without an end tag ends at the first
    text or tag that it can't hold."""
    root = Node("page")
    stack, at, page, deepest, head = [root], 0, page or "", 1, False
    open_at: dict[str, list[int]] = defaultdict(list)  # where in the stack the elements of each name stand

    def close(i: int) -> None:
        while len(stack) > i:
            open_at[stack.pop().label.split(".")[0]].pop()

    def put(text: str) -> None:
        if text:
            kids = stack[-1].kids
            if kids and kids[-1].label == "":
                kids[-1] = Node("", kids[-1].text + text)
            else:
                kids.append(Node("", text))

    for m in TOKEN.finditer(page):
        between, at = entities.unescape(page[at : m.start()]), m.end()
        head = head and not between.strip()
        put(between)
        tag = (m["tag"] or m["torn"] or "").lower()
        closing = m["end"] == "/" or (m["torn"] and page[m.start() + 1] == "/")
        if raw := m["raw"] or m["held"]:
            head = head and raw.lower() in HEAD
            continue
        if not tag:
            continue
        if tag == "head":
            head = not closing
            continue
        if head and tag in HEAD:
            continue
        head = head and (closing or tag == "html")
        names = sorted({w for g in NAMES.findall(m["rest"] or "") for w in re.split(r"[^a-z0-9]+", "".join(g).lower()) if w and not NUMBER.fullmatch(w)}) if not closing else []
        if tag in INLINE and not (set(names) & ASIDE_NAMES) and not (closing and open_at[tag]):
            continue
        if closing:
            if open_at[tag]:
                close(open_at[tag][-1])
            else:
                put(" ")
            continue
        if tag not in INLINE and stack[-1].label.split(".")[0] == "p":
            close(len(stack) - 1)
        if tag in ENDS_OWN and open_at[tag] and all(not open_at[x] or open_at[x][-1] < open_at[tag][-1] for x in ENDS_OWN[tag]):
            close(open_at[tag][-1])
        if tag in VOID:
            put(" ")
            continue
        node = Node(".".join([tag, *names]))
        stack[-1].kids.append(node)
        open_at[tag].append(len(stack))
        stack.append(node)
        deepest = max(deepest, len(stack))
    deep(deepest)
    put(entities.unescape(page[at:]))
    return root


def fold(kids: list[Node]) -> list[Node]:
    """Kids with runs of one label merged into repeated groups, and blank slots left out."""
    out: list[Node] = []
    for k in kids:
        if k.label == "" and k.text and not k.text.strip():
            continue
        if out and out[-1].label == k.label:
            out[-1] = merge(out[-1], k)
            out[-1].repeated = True
        else:
            out.append(k)
    return out


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two short lists, as pairs of places."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(x: list[str], y: list[str], cells: int = 40_000) -> list[tuple[int, int]]:
    """Pairs of places at which two lists of labels are aligned, ascending in both. Equal starts and ends are taken off; what is left is
    aligned by its longest common subsequence if that takes at most `cells` steps, else cut at the labels that each side
    has once, or, without such, aligned to the next equal label each, so that time and memory stay near the lists' lengths."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and x[n - 1] == y[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= cells:
            out += [(i + a, j + b) for a, b in common(x[i:n], y[j:m])]
            continue
        times, there = Counter(x[i:n]), Counter(y[j:m])
        at = {label: k + j for k, label in enumerate(y[j:m]) if there[label] == 1 and times[label] == 1}
        anchors = rising([(k + i, at[label]) for k, label in enumerate(x[i:n]) if label in at])
        if not anchors:
            places = defaultdict(list)
            for k in range(j, m):
                places[y[k]].append(k)
            free = j
            for k in range(i, n):
                own = places.get(x[k], [])
                if (found := bisect_left(own, free)) < len(own):
                    out.append((k, own[found]))
                    free = own[found] + 1
            continue
        edges = [(i - 1, j - 1), *anchors, (n, m)]
        out += anchors
        todo += [(a + 1, c, b + 1, d) for (a, b), (c, d) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, ascending in the first, that ascends in the second too."""
    ends, tops, back = [], [], []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(ends, b)
        ends[at : at + 1], tops[at : at + 1] = [b], [k]
        back.append(tops[at - 1] if at else -1)
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def merge(a: Node, b: Node) -> Node:
    """The least wrapper for both: kids are aligned by label; what one side lacks becomes optional, and texts that differ a slot."""
    out = Node(a.label)
    out.repeated, out.optional = a.repeated or b.repeated, a.optional or b.optional
    out.constant = a.constant if a.constant == b.constant else None
    out.mass = a.mass + b.mass
    out.pages = a.pages if a.pages == b.pages else tuple(sorted({*a.pages, *b.pages})[:TEMPLATE])
    x, y = fold(a.kids), fold(b.kids)
    i = j = 0
    for p, q in [*aligned([k.label for k in x], [k.label for k in y]), (len(x), len(y))]:
        for only in [*x[i:p], *y[j:q]]:
            only.optional = True
            out.kids.append(only)
        if p < len(x):
            out.kids.append(merge(x[p], y[q]))
        i, j = p + 1, q + 1
    out.kids = fold(out.kids)
    return out


def _aside(label: str, inside: bool, content: frozenset[str] = frozenset()) -> bool:
    """Whether an element is beside the main text: by its tag, or by its names unless the wrapper shows it to be content."""
    tag, *names = label.split(".")
    return tag in ASIDE or (tag == "header" and not inside) or (tag not in WHOLE and bool(ASIDE_NAMES.intersection(names)) and label not in content)


def _masses(wrapper: Node, named: bool, content: frozenset[str]) -> tuple[int, list[tuple[str, int]], bool]:
    """The characters of the texts that vary between a host's pages (of all, if none vary), and of those in each element, outside what is
    aside by tag and, if `named`, by names; and whether any vary."""
    order, todo = [], [(wrapper, -1)]
    while todo:
        node, above = todo.pop()
        order.append((node, above))
        todo += [(k, len(order) - 1) for k in node.kids if not (_aside(k.label, True, content) if named else k.label.split(".")[0] in ASIDE)]
    free = [n.mass if n.label == "" and n.constant is None else 0 for n, _ in order]
    masses = free.copy() if sum(free) else [n.mass if n.label == "" else 0 for n, _ in order]
    for i in range(len(order) - 1, 0, -1):
        masses[order[i][1]] += masses[i]
    return masses[0], [(n.label, m) for (n, _), m in zip(order, masses, strict=True) if n.label], sum(free) > 0


def main_region(wrapper: Node) -> tuple[frozenset[str], frozenset[str]]:
    """What the alignment says of a host: the labels of its article and main elements that hold most of the text that varies between its
    pages (all of these, if nothing varies), and of elements that are not beside the text although their names, of the doubtful
    kind, say so. That is when names hide three quarters of the text that varies, and one such element holds most of that."""
    content: frozenset[str] = frozenset()
    all_, elements, _ = _masses(wrapper, False, content)
    shown, own, varied = _masses(wrapper, True, content)
    if 4 * shown < all_:
        content = frozenset(x for x, m in elements if 2 * m > all_ and _aside(x, True) and ASIDE_NAMES.intersection(x.split(".")[1:]) <= DOUBTFUL)
        shown, own, varied = _masses(wrapper, True, content)
    return frozenset(x for x, m in own if x.split(".")[0] in MAIN and (2 * m > shown or not varied)), content


def holds(page: Node, labels: frozenset[str], content: frozenset[str]) -> bool:
    """Whether one of the labels stands on the page outside what is aside."""
    todo = [page] if labels else []
    while todo:
        for k in todo.pop().kids:
            if k.label and not _aside(k.label, False, content):
                if k.label in labels:
                    return True
                todo.append(k)
    return False


def varies(wrapper: Node) -> bool:
    """Whether some text outside what is aside differs between pages, or within one."""
    todo = [wrapper]
    while todo:
        for k in todo.pop().kids:
            if k.label == "" and k.constant is None:
                return True
            if k.label and not _aside(k.label, False):
                todo.append(k)
    return False


def matched(kids: list[Node], pattern: Node | None) -> list[Node | None]:
    """The part of the wrapper that each kid stands at, by alignment of labels as in `merge`."""
    if pattern is None:
        return [None] * len(kids)
    labels, group = [], []
    for k in kids:
        blank = k.label == "" and not k.text.strip()
        if not blank and (not labels or labels[-1] != k.label):
            labels.append(k.label)
        group.append(None if blank else len(labels) - 1)
    at = dict(aligned(labels, [k.label for k in pattern.kids]))
    return [pattern.kids[at[g]] if g in at else None for g in group]


def main_text(page: Node, wrapper: Node, region: tuple[frozenset[str], frozenset[str]] | None = None) -> str:
    """Texts in the host's main region, blocks and white space as one space: the article or main elements that hold most of the text
    that varies between its pages. On a page without these the region is the whole page but what is aside, and a text that is the same
    on all pages that have it, TEMPLATE different ones at least, is the template's, provided that other texts of the host vary."""
    mains, content = main_region(wrapper) if region is None else region
    limited = holds(page, mains, content)
    out, todo = [], [(page, None if limited or not varies(wrapper) else wrapper, not limited)]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        (node, pattern, inside), own = item, []
        for k, slot in zip(node.kids, matched(node.kids, pattern), strict=True):
            if k.label == "":
                if inside and not (slot and slot.constant == k.constant and len(slot.pages) >= TEMPLATE):
                    own.append(k.text)
            elif not _aside(k.label, inside and limited, content):
                space = "" if k.label.split(".")[0] in INLINE else " "
                own += [space, (k, slot, inside or k.label in mains), space]
        todo.extend(reversed(own))
    return " ".join("".join(out).split())


def named(page: Node) -> Node:
    """The page, its text slots with a hash of its whole text but what is aside; pages that read the same are one page."""
    text = main_text(page, Node("page"))
    pages, todo = (int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest()),), [page]
    while todo:
        for k in todo.pop().kids:
            if k.label == "":
                k.pages = pages
            else:
                todo.append(k)
    return page


UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UPPER_LETTERS, LOWER_LETTERS)


def _host(url: str | None) -> str:
    m = re.search(r"://([^/?#]*)", url or "")
    return m[1].translate(LOWER) if m else ""


PARTIAL = pa.schema([("host", pa.string()), ("wrapper", pa.string())])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligns the pages of each host that a task sees, so that little is shuffled."""
    held: dict[str, Node] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([list(held), [json.dumps(w.plain()) for w in held.values()]], PARTIAL.types, strict=True)], schema=PARTIAL)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for url, page in zip(part["url"].to_pylist(), part["html"].to_pylist(), strict=True):
                tree, host = named(parse(page)), _host(url)
                held[host] = merge(held.get(host, tree), tree)
            if len(held) > 5000:
                yield out()
                held.clear()
    if held:
        yield out()


def _join(table: pa.Table) -> pa.Table:
    rows = sorted(table["wrapper"].to_pylist())
    wrapper = Node.of(json.loads(rows[0]))
    for w in rows[1:]:
        wrapper = merge(wrapper, Node.of(json.loads(w)))
    return pa.table([pa.array([table["host"][0].as_py()], pa.string()), pa.array([json.dumps(wrapper.plain())], pa.string())], schema=PARTIAL)


def wrappers(pages: DataFrame, keep: Written) -> DataFrame:
    """host, wrapper: one wrapper a host, from all its pages. Tasks align what they see; salted groups align the tasks' wrappers, and a host's
    few remaining ones are aligned last."""
    schema = from_arrow_schema(PARTIAL)
    partial = keep(pages.select("url", "html").mapInArrow(_partial, schema), "partial")
    salted = partial.withColumn("salt", F.pmod(row_key(F.col("host")), F.lit(32)))
    once = salted.groupBy("host", "salt").applyInArrow(_join, schema)
    return keep(once.groupBy("host").applyInArrow(_join, schema), "wrappers")


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages(page_id, url, html).

    Null or empty html gives an empty text; a null url or one without a host counts as the host "". Repeated rows each give a row; the
    wrappers are sent to all tasks if they measure under broadcast_bytes, and joined by a shuffle if not. An empty table gives an empty
    result; other columns are ignored."""
    keep = Written(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = wrappers(own, keep)
    size = found.agg(F.sum(F.length("wrapper") + F.length("host") + 16)).first()[0] or 0
    host = F.translate(F.coalesce(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("")), UPPER_LETTERS, LOWER_LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for r in part.to_pylist():
                    if r["wrapper"] not in known:
                        if len(known) > 2000:
                            known.clear()
                        wrapper = Node.of(json.loads(r["wrapper"] or '[["page",null,0,0,[],0,0]]'))
                        known[r["wrapper"]] = wrapper, main_region(wrapper)
                    text = main_text(parse(r["html"]), *known[r["wrapper"]])
                    rows.append((r["page_id"], r["url"], text, len(text)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TEXTS.types, strict=True)], schema=TEXTS)

    other = F.broadcast(found) if size <= broadcast_bytes else found
    joined = own.withColumn("host", host).join(other, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(run, from_arrow_schema(TEXTS))


