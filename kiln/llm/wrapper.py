"""Main-text extraction by wrapper induction over the pages of a host.

Pages are grouped by host. All different pages of a group take part in the
induction: a page joins the layout whose blocks its own resemble most (shared label
paths), or begins a new one. Its tree is aligned with the layout's tree by simple
tree matching: two nodes match if their labels agree, and the children of matched
nodes are paired, in order, so that most nodes match; children of a kind that the
layout's tree does not have there are added to it. Labels are tags with those classes
that ``CLASS_SHARE`` of the group's pages use, so page-specific classes do not matter.
A node of the layout is template where one text (inline elements included) makes up
``CONSTANT_SHARE`` of its texts and stands on ``PRESENT_SHARE`` of the layout's pages;
other texts vary: they are content slots.

A page is then aligned with its layout: blocks that say what a template node says go.
Content lies in the page's article (or main) element, or else in the smallest region
of the layout that holds nearly all varying text. Inside it, regions whose element,
role or name marks them as menu, header, footer, sidebar, notice, advert, form,
script, style or reader comments go too. A name (a class or id all of whose words
are such names) counts only for an element that does not hold most of the article and
main text, or on pages without those most of the varying text. A layout with fewer
than ``LEAST_EXAMPLES`` different pages has no template, and an article that would
nearly vanish as template is a copied article and stays.

Groups hold one host; a host with more than ``GROUP_PAGES`` pages (or than a
500 000th of all, if that is more) is split evenly by page hash into parts of at
least half as many, each with enough pages to tell constant from varying text; at
most 500 000 hosts are split, which bounds the broadcast that says so. A task holds
the compressed pages of one group and the trees of its layouts.

Defined cases: null html is empty and gives an empty text; pages with a null or
odd url share the empty host; repeated rows are extracted once each; markup that
is cut short or badly nested is closed as browsers do; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_PAGES = 2_000
LEAST_EXAMPLES = 4
CLASS_SHARE = 0.1
SIMILAR = 0.5
CONSTANT_SHARE = 0.6
PRESENT_SHARE = 0.3
LEAST_KEPT = 0.1  # of an article: with less it is a copy of other pages' articles
REGION_SHARE = 0.8
HELD_SHARE = 0.5  # an element with more of the main text is not noise by name
MAX_DEPTH = 200  # deeper elements become siblings, as in browsers

#: HTML's void elements, elements with raw text, and elements that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body br center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p
    pre section summary table tbody td tfoot th thead title tr ul""".split())
#: Which open elements a start tag ends, and the elements that keep it from reaching further out.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
          "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist"),
          "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
ENDS_P = BLOCK - frozenset("body br dd dt head html legend li optgroup option tbody td tfoot th thead title tr".split())
P_SCOPE = frozenset("td th table button object html".split())

#: Elements, roles and name parts of regions that are not main text.
NOISE_TAGS = frozenset("""nav header footer aside form script style noscript template button select textarea input
    iframe svg dialog menu object embed head title canvas audio video""".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
NOISE_NAMES = frozenset("""ad ads advert adverts advertisement advertising adslot banner sponsor sponsored promo
    cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side menu menubar nav navbar navigation
    breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus respond reply replies share sharing
    social related recommended newsletter subscribe subscription signup login widget pagination pager toolbar""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are part of a text, and so never all of it.
PARAGRAPHS = HEADINGS | frozenset("p li dt dd pre blockquote tr".split())

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<![^>]*>?|<\?[^>]*>?"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|([^<]+|<)", re.S)
_NAMED = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME_PART = re.compile(r"[a-z]+")
_CLASSES = re.compile(r"\sclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


class Node:
    __slots__ = ("tag", "label", "noise", "named", "children")

    def __init__(self, tag: str, label: str, noise: bool, named: bool = False):
        self.tag, self.label, self.noise, self.named = tag, label, noise, named
        self.children: list[Node | str] = []


def _noise_name(token: str) -> bool:
    parts = _NAME_PART.findall(token)
    return bool(parts) and NOISE_NAMES.issuperset(parts)


def _noisy(tag: str, attributes: str, classes: frozenset | None) -> tuple[str, bool, bool]:
    """The label (tag and classes), whether the element marks a region that is not main text, and whether only its name does."""
    noise, named, cls = tag in NOISE_TAGS, False, ""
    if attributes:
        for name, value in _NAMED.findall(attributes):
            value, name = value.strip("\"'").lower(), name.lower()
            if name == "class":
                cls = value if classes is None else " ".join(t for t in value.split() if t in classes or _noise_name(t))
            if name in ("class", "id"):
                named = named or any(map(_noise_name, value.split()))
            elif name == "role":
                noise = noise or value in NOISE_ROLES
            else:
                noise = noise or name == "hidden" or value == "true"
    # a main or body is what it is, whatever its name says
    some = tag not in ("body", "html", "main")
    return (f"{tag}.{cls}" if cls else tag), some and (noise or named), some and named and not noise


def parse(text: str, classes: frozenset | None = None) -> Node:
    """The element tree of a page; text is decoded and kept as strings among the children.

    Labels hold the ``classes`` given (default: all) and those that name noise.
    """
    root = Node("#root", "#root", False)
    stack = [root]
    at, end, size = 0, len(text), _TOKEN.match
    while at < end:
        m = size(text, at)
        at = m.end()
        chunk = m.group(4)
        if chunk is not None:
            stack[-1].children.append(html.unescape(chunk) if "&" in chunk else chunk)
            continue
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in ENDS_P:
            _close(stack, frozenset(("p",)), P_SCOPE)
        if tag in CLOSES:
            _close(stack, *CLOSES[tag])
        label, noise, named = _noisy(tag, m.group(3), classes)
        node = Node(tag, label, noise, named)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
            node.children.append(text[at:stop.start() if stop else end])
            at = (text.find(">", stop.start()) + 1 or end) if stop else end
        elif tag not in VOID and not m.group(3).endswith("/") and len(stack) < MAX_DEPTH:
            stack.append(node)
    _keep_holders(root)
    return root


def _size(node: Node) -> int:
    """Characters of a node's text, without what elements and roles (not names) mark as noise."""
    return sum(len(c.strip()) if c.__class__ is str else 0 if c.noise and not c.named else _size(c) for c in node.children)


def _keep_holders(scope: Node) -> None:
    """Names do not mark elements as noise that hold most text of the articles and mains in ``scope``."""
    held: list[tuple[Node, int]] = []

    def main_text(node: Node) -> int:
        total = 0
        for c in _elements(node):
            if c.noise and not c.named:
                continue
            own = _size(c) if c.tag in ("article", "main") else main_text(c)
            if c.named and own:
                held.append((c, own))
            if c.tag == "main":
                _keep_holders(c)
            total += own
        return total

    whole = main_text(scope)
    if scope.tag == "main":
        whole = _size(scope)
    for node, own in held:
        if own > HELD_SHARE * whole:
            node.noise = node.named = False


def _has_main_text(node: Node) -> bool:
    return any(c.tag in ("article", "main") or _has_main_text(c) for c in _elements(node) if not c.noise)


def _close(stack: list[Node], tags: frozenset, scope: frozenset) -> None:
    """End the outermost open element of ``tags`` that is inside the nearest of ``scope``."""
    cut = 0
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            cut = i
        elif stack[i].tag in scope:
            break
    if cut:
        del stack[cut:]


def _elements(node: Node) -> list[Node]:
    return [c for c in node.children if c.__class__ is Node]


def block_text(node: Node) -> str:
    """A block's own text: its strings and those of its inline elements, without the blocks inside."""
    parts: list[str] = []

    def add(n: Node) -> None:
        for c in n.children:
            if c.__class__ is str:
                parts.append(c)
            elif c.tag not in BLOCK and not c.noise:
                add(c)

    add(node)
    return " ".join("".join(parts).split())


def _blocks(node: Node) -> list[Node]:
    """The node itself and all blocks below it."""
    return [n for n in _walk(node) if n is node or n.tag in BLOCK]


def match_trees(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: how many nodes match, and which."""
    if a.label != b.label:
        return 0, []
    x, y = _elements(a), _elements(b)
    pairs = [(a, b)]
    if not x or not y:
        return 1, pairs
    size = 1
    if [c.label for c in x] == [c.label for c in y]:  # in step: no other pairing matches more children
        for c, d in zip(x, y):
            n, p = match_trees(c, d)
            size += n
            pairs += p
        return size, pairs
    found = {}
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, c in enumerate(x):
        row, above = best[i + 1], best[i]
        for j, d in enumerate(y):
            w = 0
            if c.label == d.label:
                found[i, j] = sub = match_trees(c, d)
                w = sub[0]
            row[j + 1] = max(above[j + 1], row[j], above[j] + w)
    i, j = len(x), len(y)
    while i and j:
        sub = found.get((i - 1, j - 1))
        if sub and best[i][j] == best[i - 1][j - 1] + sub[0]:
            pairs += sub[1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return size + best[len(x)][len(y)], pairs


def block_paths(root: Node) -> frozenset:
    """Hashes of the label paths of a tree's blocks."""
    out, todo = set(), [(root, 0)]
    while todo:
        node, path = todo.pop()
        for c in _elements(node):
            own = hash((path, c.label))
            if c.tag in BLOCK:
                out.add(own)
            todo.append((c, own))
    return frozenset(out)


class Wrapper:
    """What the pages of a layout share: an aligned tree with its template nodes."""

    def __init__(self, base: Node):
        self.base, self.paths, self.pages = base, block_paths(base), 0
        self.seen: dict[int, Counter] = {}  # texts of each node, by hash
        self.length: Counter = Counter()    # characters of a node's texts, by (node, text)
        self.template: dict[int, set[int]] = {}
        self.region: list[Node] = []
        self.holders: set[tuple[str, ...]] | None = None  # without a template every page has its own

    def add(self, page: Node) -> None:
        """Align a page and count its blocks' texts; children of a new kind join the tree."""
        self.pages += 1
        pairs = match_trees(self.base, page)[1]
        partner = {id(b): a for a, b in pairs}
        for a, b in pairs:
            kinds = {c.label for c in _elements(a)}
            before = None
            for c in _elements(b):
                if id(c) in partner:
                    before = partner[id(c)]
                elif c.label not in kinds:
                    a.children.insert(a.children.index(before) + 1 if before else 0, c)
                    kinds.add(c.label)
                    before = c
                    for n in _blocks(c):
                        self._count(n, n)
            if a.tag in BLOCK:
                self._count(a, b)

    def _count(self, node: Node, block: Node) -> None:
        text = block_text(block)
        if text:
            own = hash(text)
            self.seen.setdefault(id(node), Counter())[own] += 1
            self.length[id(node), own] += len(text)

    def close(self) -> Wrapper:
        """Tell constant nodes from slots."""
        varying: Counter = Counter()
        enough = self.pages >= LEAST_EXAMPLES
        for node, texts in self.seen.items():
            present = texts.total()
            constant = {t for t, n in texts.items() if enough and n >= max(
                LEAST_EXAMPLES, CONSTANT_SHARE * present, PRESENT_SHARE * self.pages)}
            if constant:
                self.template[node] = constant
            varying[node] = sum(self.length[node, t] for t in texts if t not in constant)
        if enough:
            self.holders = _holders(self.base, lambda n: varying[id(n)])
            _release(self.base, self.holders)
            self.region = self._region(varying)
        self.seen, self.length = {}, Counter()
        return self

    def _region(self, varying: Counter) -> list[Node]:
        """The nodes from the root down to the smallest region with nearly all varying text."""
        def weigh(node: Node) -> int:
            total = 0 if node.noise else varying[id(node)] + sum(weigh(c) for c in _elements(node))
            weight[id(node)] = total
            return total

        weight: dict[int, int] = {}
        whole, node, path = weigh(self.base), self.base, []
        while True:
            inner = [c for c in _elements(node) if weight.get(id(c), 0) >= REGION_SHARE * whole > 0]
            if not inner or inner[0].tag in PARAGRAPHS or inner[0].tag not in BLOCK:
                return path
            node = inner[0]
            path.append(node)

    def content(self, page: Node, partner: dict[int, Node]) -> list[Node]:
        """The page's content regions; ``partner`` has the page's node for each matched node of the layout."""
        for tag in ("article", "main"):
            found = _outermost(page, tag)
            if found:
                return found
        return [next((partner[id(n)] for n in reversed(self.region) if id(n) in partner), page)]

    def extract(self, page: Node) -> str:
        if not _has_main_text(page):
            own = lambda n: sum(len(c.strip()) for c in n.children if c.__class__ is str)
            _release(page, _holders(page, own) if self.holders is None else self.holders)
        pairs = match_trees(self.base, page)[1] if self.template else []
        template = {id(b) for a, b in pairs if id(a) in self.template and hash(block_text(b)) in self.template[id(a)]}
        regions = self.content(page, {id(a): b for a, b in pairs})
        text = _text(regions, template)
        if not text or regions[0].tag in ("article", "main"):
            whole = _text(regions, set())
            return text if len(text) >= LEAST_KEPT * len(whole) else whole
        return text


def choose(wrappers: list[Wrapper], page: Node) -> Wrapper | None:
    """The layout with the largest share of common block paths, if that is ``SIMILAR`` or more."""
    paths, best, most = block_paths(page), None, SIMILAR
    for w in wrappers:
        union = len(paths | w.paths)
        share = len(paths & w.paths) / union if union else 1.0
        if share >= most and (best is None or share > most):
            best, most = w, share
    return best


def induce(pages: Iterable[Node]) -> list[Wrapper]:
    """The layouts of a group's pages; pages with the same text count once."""
    wrappers: list[Wrapper] = []
    known: set[int] = set()
    for page in pages:
        text = hash(_text([page], set()))
        if text in known:
            continue
        known.add(text)
        w = choose(wrappers, page)
        if w is None:
            wrappers.append(w := Wrapper(page))
        w.add(page)
    return [w.close() for w in wrappers]


def stable_classes(sources: Iterable[str], n: int) -> frozenset:
    """Class names on ``CLASS_SHARE`` of n pages, and on two at least."""
    count: Counter = Counter()
    for s in sources:
        count.update({t for c in _CLASSES.findall(s) for t in c.strip("\"'").lower().split()})
    return frozenset(t for t, k in count.items() if k >= max(2, CLASS_SHARE * n))


def extract_group(sources: list[str]) -> Iterator[str]:
    """The main text of each page of a group."""
    different = list(dict.fromkeys(sources))
    classes = stable_classes(different, len(different))
    wrappers = induce(parse(s, classes) for s in different)
    for s in sources:
        page = parse(s, classes)
        w = choose(wrappers, page)
        yield (w if w is not None else Wrapper(page)).extract(page)


def _holders(root: Node, own: Callable[[Node], int]) -> set[tuple[str, ...]]:
    """Label paths of the elements named as noise that hold most of the text that ``own`` weighs."""
    named: list[tuple[tuple[str, ...], int]] = []

    def weigh(node: Node, path: tuple[str, ...]) -> int:
        total = own(node)
        for c in _elements(node):
            if not c.noise or c.named:
                total += weigh(c, (*path, c.label))
        if node.named:
            named.append((path, total))
        return total

    whole = weigh(root, ())
    return {path for path, total in named if total > HELD_SHARE * whole}


def _release(root: Node, holders: set[tuple[str, ...]]) -> None:
    """Names do not mark the elements at the paths ``holders`` as noise."""
    todo = [(root, ())] if holders else []
    while todo:
        node, path = todo.pop()
        if node.named and path in holders:
            node.noise = node.named = False
        todo += [(c, (*path, c.label)) for c in _elements(node)
                 if any(h[:len(path) + 1] == (*path, c.label) for h in holders)]


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += _elements(n)


def _outermost(node: Node, tag: str) -> list[Node]:
    """The outermost elements ``tag`` in page order that are not in (or named as) noise."""
    out: list[Node] = []
    for c in _elements(node):
        if not c.noise:
            out += [c] if c.tag == tag else _outermost(c, tag)
    return out


def _text(regions: list[Node], template: set[int]) -> str:
    parts: list[str] = []

    def add(node: Node, headings_only: bool, dropped: bool) -> None:
        for c in node.children:
            if c.__class__ is str:
                if not dropped and not headings_only:
                    parts.append(c)
                continue
            block = c.tag in BLOCK
            gone = id(c) in template if block else dropped  # inline elements go with their block
            if block:
                parts.append(" ")
            if c.noise:
                if c.tag == "header":  # the article's own header: its headings belong to the text
                    add(c, True, gone)
            else:
                add(c, headings_only and c.tag not in HEADINGS, gone)
            if block:
                parts.append(" ")

    for r in regions:
        parts.append(" ")
        add(r, False, id(r) in template)
    return " ".join("".join(parts).split())


def _extract_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (host, part, order): each group's pages are kept compressed until it is whole."""
    now, held = None, []

    def group() -> Iterator[pa.RecordBatch]:
        texts = extract_group([zlib.decompress(z).decode() for _, _, z in held])
        for a in range(0, len(held), 512):
            rows = [(i, u, t, len(t)) for (i, u, _), t in zip(held[a:a + 512], texts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "url", "text", "n_chars"])

    for b in batches:
        for host, part, page_id, url, source in zip(*(c.to_pylist() for c in b.columns)):
            if (host, part) != now and held:
                yield from group()
                held = []
            now = (host, part)
            held.append((page_id, url, zlib.compress((source or "").encode(), 1)))
    if held:
        yield from group()


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  group_pages: int = GROUP_PAGES) -> DataFrame:
    """One row per page: page_id, url, text (main text), n_chars (its code points)."""
    host = F.lower(F.coalesce(F.regexp_extract(f"`{url_col}`", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    pages = df.select(host.alias("host"), F.col(f"`{id_col}`").cast("long").alias("page_id"),
                      F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    counts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(group_pages, total // 500_000)
    large = counts.filter(F.col("n") > limit).select(F.col("host").alias("l_host"),
                                                     F.ceil(F.col("n") / limit).alias("parts"))
    order = F.xxhash64("page_id", "url")
    dealt = pages.join(F.broadcast(large), F.col("host") == F.col("l_host"), "left").select(  # at most 500 000 hosts
        "host", F.pmod(order, F.coalesce("parts", F.lit(1))).alias("part"), "page_id", "url", "html")
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * total // group_pages)
    return (dealt.repartition(n, "host", "part").sortWithinPartitions("host", "part", order)
            .mapInArrow(_extract_group, "page_id long, url string, text string, n_chars long"))
