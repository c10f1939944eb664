"""Main text of HTML pages by wrapper induction over pages of one host and layout."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S | re.I)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Fixed values of HTML: elements without content, elements inside a line, elements that end an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements and class, id or role words that are never part of an article.
ASIDE_TAGS = frozenset("head nav footer aside form button menu dialog".split())
ASIDE_WORDS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|aside|footer|header|masthead|cookie|cookies|consent|notice|notices|gdpr|newsletter|subscribe|popup|modal|share|social|comment|comments|disqus|reply|replies|related|recommended|toolbar|skip|pagination|login|search|complementary|contentinfo)(?:$|[\s_-])", re.I)
#: Pages that (articles) that a template is learnt from at least; share of them that a constant node has;
#: pairs of children beyond which the tree matching halves the lists, for memory alone.
LEAST_PAGES, CONSTANT, CELLS = 4, 0.7, 1 << 16
#: Start tags that tell a page's layout, and their class.
LAYOUT = r"(?i)<(?:div|section|article|main|table|ul|ol|dl|h1|h2|center|td)\b[^>]*>"
LAYOUT_CLASS = r"(?i)\bclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)"
#: A near copy of the reference's article has at most this share of other words in the leaves that differ.
NEAR = 0.2


class Node:
    __slots__ = ("tag", "words", "kids", "text", "size")

    def __init__(self, tag, words=""):
        self.tag, self.words, self.kids, self.text, self.size = tag, words, [], "", 1


def parse(html: str) -> Node:
    """A tree of elements; a text is a node with tag #. Scripts, styles, comments and the like are left out."""
    root = Node("html")
    stack = [root]
    for m in TOKEN.finditer(html):
        t = m[0]
        if t[0] != "<" or t == "<":
            if t.strip():
                n = Node("#")
                n.text = t
                stack[-1].kids.append(n)
            elif stack[-1].kids and stack[-1].kids[-1].tag in INLINE:
                n = Node("#")
                n.text = " "
                stack[-1].kids.append(n)
            continue
        if m[1] or t[1] in "!?":
            continue
        tag = NAME.match(t)[1].lower()
        if t[1] == "/":
            if tag in INLINE:  # an inline end never closes a block
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag not in INLINE:
                        break
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in OWN_KIND:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in OWN_KIND[tag]:
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE and stack[i].tag != "p":
                    break
        n = Node(tag, " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(t)) if "=" in t else "")
        stack[-1].kids.append(n)
        if tag not in VOID and not t.endswith("/>"):
            stack.append(n)
    return root


def blocks(root: Node) -> Node:
    """The tree of blocks: inline elements are dissolved, and each run of inline content of a block
    becomes one leaf with its text, white space folded and references decoded."""
    from html import unescape

    def build(node: Node) -> Node:
        out = Node(node.tag, node.words)
        run: list[str] = []

        def flush():
            text = " ".join(unescape("".join(run)).split())
            run.clear()
            if text:
                leaf = Node("#")
                leaf.text = text
                out.kids.append(leaf)

        stack = [iter(node.kids)]
        while stack:
            kid = next(stack[-1], None)
            if kid is None:
                stack.pop()
            elif kid.tag == "#":
                run.append(kid.text)
            elif kid.tag in ("br", "img"):
                run.append(" ")
            elif kid.tag in INLINE and not (kid.words and ASIDE_WORDS.search(kid.words)):
                stack.append(iter(kid.kids))
            else:
                flush()
                todo.append((kid, out, len(out.kids)))
                out.kids.append(kid)  # its place, until it is built
        flush()
        return out

    todo: list[tuple] = []
    top = build(root)
    while todo:
        node, parent, at = todo.pop()
        parent.kids[at] = build(node)
    order = [top]
    for n in order:
        order.extend(n.kids)
    for n in reversed(order):
        n.size = 1 + sum(k.size for k in n.kids)
    return top


def _interned(a: Node, b: Node):
    """Numbers of equal subtrees of a and b: (number by id of node, kind, numbers of children, weight in itself
    by number). A leaf's text counts only where both trees have it, so other leaves are all alike."""
    orders = []
    for root in (a, b):
        order = [root]
        for n in order:
            order.extend(n.kids)
        orders.append(order)
    shared = {n.text for n in orders[0] if n.tag == "#"} & {n.text for n in orders[1] if n.tag == "#"}
    known: dict[tuple, int] = {}
    number, kinds, kids, own = {}, [], [], []
    for order in orders:
        for n in reversed(order):
            text = n.text if n.tag == "#" and n.text in shared else None
            key = (n.tag, n.words, text, tuple(number[id(k)] for k in n.kids))
            at = known.get(key)
            if at is None:
                at = known[key] = len(own)
                kinds.append((n.tag, n.words))
                kids.append(key[3])
                own.append(1 + (text is not None) + sum(own[k] for k in key[3]))
            number[id(n)] = at
    return number, kinds, kids, own


def _trimmed(p, q):
    """Lengths of the equal beginning and end of two lists: equal subtrees there are tied in a best alignment."""
    i, most = 0, min(len(p), len(q))
    while i < most and p[i] == q[i]:
        i += 1
    j = 0
    while j < most - i and p[-1 - j] == q[-1 - j]:
        j += 1
    return i, j


def _best(p, q, weight):
    """Gains of the best alignments of p with each beginning of q, in memory linear in q."""
    import numpy as np

    rows: dict = {}
    line = np.zeros(len(q) + 1, np.int64)
    for x in p:
        if x not in rows:
            values = {y: weight(x, y) for y in set(q)}
            rows[x] = np.array([values[y] for y in q], np.int64)
        both = np.where(rows[x] > 0, line[:-1] + rows[x], 0)
        line[1:] = np.maximum(line[1:], both)
        np.maximum.accumulate(line, out=line)
    return line


def _gain(p, q, weight):
    """The gain of a best alignment."""
    if len(p) * len(q) > 256:
        return int(_best(p, q, weight)[-1])
    line = [0] * (len(q) + 1)
    for x in p:
        before = 0
        for t, y in enumerate(q):
            w = weight(x, y)
            before, line[t + 1] = line[t + 1], max(line[t + 1], line[t], before + w if w else 0)
    return line[-1]


def _align(p, q, weight):
    """Places (in p, in q) of a best alignment in order. Long lists are halved (Hirschberg)."""
    out, todo = [], [(0, len(p), 0, len(q))]
    while todo:
        s0, s1, t0, t1 = todo.pop()
        if s0 == s1 or t0 == t1:
            continue
        if (s1 - s0) * (t1 - t0) > CELLS and s1 - s0 > 1:
            import numpy as np

            half = (s0 + s1) // 2
            cut = t0 + int(np.argmax(_best(p[s0:half], q[t0:t1], weight) + _best(p[half:s1][::-1], q[t0:t1][::-1], weight)[::-1]))
            todo += [(s0, half, t0, cut), (half, s1, cut, t1)]
            continue
        n, m = s1 - s0, t1 - t0
        gain = [[0] * (m + 1) for _ in range(n + 1)]
        for s in range(n - 1, -1, -1):
            below, row, x = gain[s + 1], gain[s], p[s0 + s]
            for t in range(m - 1, -1, -1):
                w = weight(x, q[t0 + t])
                row[t] = max(w + below[t + 1] if w else 0, below[t], row[t + 1])
        s = t = 0
        while s < n and t < m:
            w = weight(p[s0 + s], q[t0 + t])
            if w and gain[s][t] == w + gain[s + 1][t + 1]:
                out.append((s0 + s, t0 + t))
                s, t = s + 1, t + 1
            elif gain[s][t] == gain[s + 1][t]:
                s += 1
            else:
                t += 1
    return out


def match(a: Node, b: Node) -> dict[int, Node]:
    """Simple tree matching: id of a node of a -> its partner in b. Children are aligned in order so
    that most nodes are matched in their subtrees, a leaf with the same text counting twice; at
    every size, with memory linear in long lists. Weights are kept by pairs of unequal subtrees."""
    number, kinds, kids, own = _interned(a, b)
    memo: dict[tuple[int, int], int] = {}

    def weight(x, y):
        return own[x] if x == y else memo[x, y] if kinds[x] == kinds[y] else 0

    def weigh(x, y):
        todo = [(x, y)]
        while todo:  # no recursion: pages may be deep
            x, y = todo[-1]
            if (x, y) in memo:
                todo.pop()
                continue
            i, j = _trimmed(kids[x], kids[y])
            p, q = kids[x][i : len(kids[x]) - j], kids[y][i : len(kids[y]) - j]
            missing = [(k, l) for k in set(p) for l in set(q) if k != l and kinds[k] == kinds[l] and (k, l) not in memo] if p and q else []
            if missing:
                todo += missing
                continue
            sure = sum(own[k] for k in kids[x][:i]) + sum(own[k] for k in kids[x][len(kids[x]) - j :])
            memo[x, y] = 1 + sure + (_gain(p, q, weight) if p and q else 0)
            todo.pop()

    pairs: dict[int, Node] = {}
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs[id(x)] = y
        k, l = x.kids, y.kids
        p, q = [number[id(n)] for n in k], [number[id(n)] for n in l]
        i, j = _trimmed(p, q)
        todo += zip(k[:i], l[:i])
        todo += zip(k[len(k) - j :], l[len(l) - j :])
        p, q = p[i : len(p) - j], q[i : len(q) - j]
        if p and q:
            for s in set(p):
                for t in set(q):
                    if s != t and kinds[s] == kinds[t] and (s, t) not in memo:
                        weigh(s, t)
            todo += [(k[i + s], l[i + t]) for s, t in _align(p, q, weight)]
    return pairs


def leaves(root: Node) -> list[tuple[Node, bool, bool]]:
    """(leaf, in an aside part, in an article) in page order."""
    out, stack = [], [(root, False, False)]
    while stack:
        n, aside, article = stack.pop()
        if n.tag == "#":
            out.append((n, aside, article))
            continue
        aside = aside or n.tag in ASIDE_TAGS or (n.tag == "header" and not article) or bool(n.words and n.tag not in ("article", "main") and ASIDE_WORDS.search(n.words))
        article = article or n.tag in ("article", "main")
        stack.extend((k, aside, article) for k in reversed(n.kids))
    return out


def main_text(root: Node, constant: set[int]) -> str:
    """The content: leaves that are neither template (ids in `constant`) nor in an aside part; of
    these the ones in an article or main element if there are any."""
    found = [(n.text, article) for n, aside, article in leaves(root) if not aside and id(n) not in constant]
    if any(article for _, article in found):
        found = [x for x in found if x[1]]
    return "\n".join(text for text, _ in found)


#: Blocks that hold a text, not blocks of it: a content part isn't cut down to one. Headings.
TEXTS = frozenset("# p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of its slots' words that a part must hold for the rest to be left out.
PART = 0.7


def content_part(root: Node, slots: dict[int, int]) -> Node:
    """The part of a reference page that its slots say is the content: from the whole page down, the one
    child that holds nearly all words of the slots (places of leaves -> words of all pages there)."""
    mass: dict[int, int] = {}
    order = [root]
    for n in order:
        order.extend(n.kids)
    at = {id(n): i for i, (n, aside, _) in enumerate(leaves(root)) if not aside}
    for n in reversed(order):
        mass[id(n)] = slots.get(at.get(id(n), -1), 0) if n.tag == "#" else sum(mass[id(k)] for k in n.kids)
    part = root
    while mass[id(part)]:
        best = max(part.kids, key=lambda k: mass[id(k)])
        if best.tag in TEXTS or all(k.tag == "#" for k in best.kids) or mass[id(best)] < PART * mass[id(part)]:
            break
        part = best
    return part


def part_text(page: Node, part: Node, constant: set[int]) -> str:
    """The text of a page's content part: its leaves that are neither template nor in an aside part, and
    the headings of that kind before it."""
    inside, stack = set(), [part]
    while stack:
        n = stack.pop()
        inside.add(id(n))
        stack += n.kids
    heads, out, begun = set(), [], False
    stack = [page]
    while stack:
        n = stack.pop()
        if n.tag in HEADINGS:
            heads.update(id(k) for k in n.kids)
        stack += n.kids
    for n, aside, _ in leaves(page):
        begun = begun or id(n) in inside
        if not aside and id(n) not in constant and (id(n) in inside or (not begun and id(n) in heads)):
            out.append(n.text)
    return "\n".join(out)


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.lower(F.regexp_extract(F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit("")), r"^([^/?#]*)", 1))


def layout_of(html: Column) -> Column:
    """A number for the layout of a page: its structural elements with their classes, each once, whatever
    their order, count and numerals; aside elements vary from page to page and are left out."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LAYOUT), F.lit(0))
    kind = lambda t: F.concat_ws(" ", F.lower(F.regexp_extract(t, r"^<(\w+)", 1)), F.regexp_replace(F.lower(F.regexp_extract(t, LAYOUT_CLASS, 1)), r"[\d\"']+", ""))
    kinds = F.array_distinct(F.transform(found, kind))
    return F.xxhash64(F.array_join(F.array_sort(F.filter(kinds, lambda k: ~k.rlike(ASIDE_WORDS.pattern))), "\n"))


def _tree(html, known: dict):
    """The block tree of a reference page, parsed once in a task while its pages are at hand."""
    if html not in known:
        if len(known) > 2000:
            known.clear()
        root = blocks(parse(html))
        known[html] = (root, [n for n, _, _ in leaves(root)])
    return known[html]


def _body(found, kept: set[str]) -> tuple[list[str], int]:
    """Words of a page's article that the reference's article doesn't repeat as whole leaves, and a
    number that copies and most near copies of them share: the smallest hash of three words in a row."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = [w for n in found if n.text not in kept for w in n.text.split()]
    raw = " ".join(words).encode("utf-8", "surrogatepass").split(b" ")
    h = np.fromiter(map(xxh3_64_intdigest, raw), np.uint64, len(raw))
    if len(h) > 2:
        h = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) ^ h[2:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return words, int(h.min() >> np.uint64(1))


def article_leaves(root: Node) -> list[Node]:
    """Leaves outside aside parts; of these the ones in an article or main element if there are any."""
    found = [(n, article) for n, aside, article in leaves(root) if not aside]
    inside = [n for n, article in found if article]
    return inside or [n for n, _ in found]


def _observe(batches):
    """A row a page whose article isn't the reference's or a near copy of it: (host, number of the article,
    a byte for each leaf of the reference page: 0 not aligned, 1 aligned, 2 with the same text; and the
    words that the page has there)."""
    import numpy as np
    import pyarrow as pa

    known: dict = {}
    for batch in batches:
        rows = []
        for host, html, reference in zip(*(batch.column(i).to_pylist() for i in range(3))):
            root, own = _tree(reference, known)
            page = blocks(parse(html or ""))
            article = article_leaves(root)
            kept, told = {n.text for n in article}, {w for n in article for w in n.text.split()}
            words, body = _body(article_leaves(page), kept)
            if sum(w not in told for w in words) <= NEAR * len(words):
                continue
            pairs = match(root, page)
            partners = [pairs.get(id(n)) for n in own]
            seen = bytes(0 if p is None else 1 + (p.text == n.text) for n, p in zip(own, partners))
            rows.append((host, body, seen, np.array([0 if p is None else len(p.text.split()) for p in partners], "<u4").tobytes()))
        cols = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "body", "seen", "words"])


def _add(batches):
    """(host, leaf number of the reference page) -> articles whose page aligns a leaf with it, and with the
    same text; words of all of them there."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        sums: dict[str, object] = {}
        for host, seen, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
            seen = np.frombuffer(seen, np.uint8)
            own = np.stack([seen > 0, seen > 1, np.frombuffer(words, "<u4")]).astype(np.int64)
            sums[host] = sums[host] + own if host in sums else own
        rows = [(h, i, int(n), int(same), int(w)) for h, own in sums.items() for i, (n, same, w) in enumerate(own.T) if n]
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "leaf", "n", "same", "words"])


class Wrapper:
    """A reference page with its leaves, the template's places among these and their texts, and the content part."""

    def __init__(self, root: Node, own: list[Node], told: list):
        self.root, self.own = root, own
        self.template = [x["leaf"] for x in told if x["steady"]]
        self.texts = {own[i].text for i in self.template}
        self.part = content_part(root, {x["leaf"]: x["words"] for x in told if not x["steady"]})

    def text(self, page: Node) -> str:
        """The text of a page. A page that says itself what its article is (article, main) is cut to it."""
        whole = self.part is self.root or any(article for _, _, article in leaves(page))
        if whole and not any(n.text in self.texts for n in article_leaves(page)):
            return main_text(page, set())  # no leaf of the content can be template: nothing to align
        pairs = match(self.root, page)
        constant = {id(pairs[id(self.own[i])]) for i in self.template if id(self.own[i]) in pairs and pairs[id(self.own[i])].text == self.own[i].text}
        found = pairs.get(id(self.part))
        return main_text(page, constant) if whole or found is None else part_text(page, found, constant)


def _extract(batches):
    import pyarrow as pa

    trees: dict = {}
    known: dict = {}
    for batch in batches:
        out = []
        for html, reference, told in zip(*(batch.column(c).to_pylist() for c in ("html", "reference", "told"))):
            page = blocks(parse(html or ""))
            if not told:
                out.append(main_text(page, set()))
                continue
            if reference not in known:
                if len(known) > 2000:
                    known.clear()
                known[reference] = Wrapper(*_tree(reference, trees), told)
            out.append(known[reference].text(page))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, broadcast_bytes: int = 32 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars.

    A host's pages are told apart by layout (structural elements and classes). Each layout with more
    than LEAST_PAGES pages has a reference page, the one of its smallest id hash; pages of scarcer
    layouts go with the host's commonest. Every page is aligned with its reference by simple tree
    matching over blocks; a reference leaf is template if at least CONSTANT of the articles whose
    pages align it, LEAST_PAGES or more, repeat its text; the others are slots. Articles count once
    however many pages have them, and copies and near copies of the reference's article don't count,
    so that an article that is mirrored isn't taken for template. The slots choose the content: the
    smallest part of the reference page that holds nearly all their words (PART at each step). Aligned
    again, a page loses its template leaves, what lies outside the content part but headings before
    it, and the parts that are never article (navigation, adverts, forms, comments and so on, by
    element and class); the rest is the text, a block a line. A page with an article or main element
    has told its part itself. Pages without enough others of their layout have these and the aside
    parts alone to go by.

    Wrappers are one row a host and layout: they are broadcast if their measured size is at most
    broadcast_bytes, else joined, where adaptive execution splits a layout with a large share of the
    pages. Otherwise only a short row a page is shuffled.

    Null html is empty text; a null url or one without :// has the empty host, whose pages share
    wrappers like any other's; very long pages are read whole; repeated rows and tied ids each get their
    row, by their own html; an empty table gives
    no rows; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn("layout", layout_of(F.col("html")))
    pick = F.struct(F.xxhash64("page_id"), F.col("page_id"))
    found = rows.filter(F.length("html") > 0).groupBy("host", "layout").agg(F.min(pick).alias("pick"), F.count(F.lit(1)).alias("n"))
    found = materialize(found.select(F.col("host").alias("h"), F.col("layout").alias("l"), F.col("pick.page_id").alias("i"), "n"))
    common = found.groupBy("h").agg(F.max(F.struct("n", "l")).alias("m")).select(F.col("h").alias("__h"), F.col("m.l").alias("m"))
    found = found.join(common, F.col("h") == F.col("__h")).withColumn("family", F.when(F.col("n") > LEAST_PAGES, F.col("l")).otherwise(F.col("m")))
    found = materialize(found.select("h", "l", "i", F.concat("h", F.lit("\n"), F.col("family").cast("string")).alias("family"), (F.col("l") == F.col("family")).alias("first")))
    chosen = found.filter("first")
    n_layouts = found.count()
    small = n_layouts <= broadcast_bytes // 200
    chosen = F.broadcast(chosen) if small else chosen
    wrappers = rows.join(chosen, (F.col("host") == F.col("h")) & (F.col("layout") == F.col("l")) & F.col("page_id").eqNullSafe(F.col("i")))
    wrappers = materialize(wrappers.groupBy("family").agg(F.min("html").alias("reference")))
    families = found.select("h", "l", "family")

    def widened(wrappers):
        """A row a host and layout, and whether they are small."""
        known = materialize(families.join(wrappers, "family"))
        n_bytes = known.agg(F.sum(F.length("reference"))).first()[0] or 0
        return F.broadcast(known) if n_bytes <= broadcast_bytes else known

    own = (F.col("host") == F.col("h")) & (F.col("layout") == F.col("l"))
    joined = rows.join(widened(wrappers), own)
    seen = joined.select(F.col("family").alias("host"), "html", "reference").mapInArrow(_observe, "host string, body long, seen binary, words binary")
    seen = seen.groupBy("host", "body").agg(F.min(F.struct("seen", "words")).alias("m")).select("host", "m.seen", "m.words")
    counts = seen.mapInArrow(_add, "host string, leaf int, n long, same long, words long")
    counts = counts.groupBy("host", "leaf").agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.sum("words").alias("words"))
    steady = (F.col("same") >= CONSTANT * F.col("n")).alias("steady")
    told = counts.filter(F.col("n") >= LEAST_PAGES).select("host", F.struct("leaf", steady, "words").alias("t"))
    told = told.groupBy("host").agg(F.sort_array(F.collect_list("t")).alias("told")).withColumnRenamed("host", "__h")  # a page's leaves at most
    wrappers = materialize(wrappers.join(told, F.col("family") == F.col("__h"), "left").select("family", "reference", "told"))
    joined = rows.join(widened(wrappers), own, "left")
    return joined.select("page_id", "url", "html", "reference", "told").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
