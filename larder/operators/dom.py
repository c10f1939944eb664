"""What a recipe page tells by its elements: one pass over each page with a compiled list of selectors, in Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Selectors in the order in which they are tried.
TITLE = ("h1", ".recipe-title", ".title", '[data-testid="recipe-title"]', "title")
INGREDIENTS = (".ingredient", ".ingredients li", ".ingredient-list li", '[data-testid="ingredient"]', ".recipe-ingredient", 'li[class*="ingredient"]')
INSTRUCTIONS = (
    ".instruction", ".directions li", ".recipe-instruction", ".step", '[data-testid="instruction"]', ".cooking-instruction", 'li[class*="instruction"]', 'li[class*="step"]', 'li[class*="direction"]',
)
CRUMBS = (".breadcrumb", ".breadcrumbs", "nav")
NUTRITION = (".nutrition", ".nutrition-info", "table.nutrition")
RATING, REVIEWS = (".rating", ".stars", ".score", "[data-rating]"), (".reviews", ".review-count", "[data-reviews]")
IMAGES = {"primary": 'div[class*="primary-image"] img[src]', "media": 'div[class*="media"] img[src]', "other": 'div[class*="other-images"] img[src]', "every": "img[src]"}
METAS = {"keywords": "name", "description": "name", "og:description": "property", "og:image": "property", "datePublished": "name"}
#: Elements without content; those that a new one of the listed kinds closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
#: Elements that a closing one doesn't reach beyond; those whose start ends a paragraph.
HOLDS = {"li": ("ul", "ol"), "tr": ("table",), "td": ("table",), "th": ("table",), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "p": ()}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

FOUND = (
    "struct<title:string,ingredients:array<string>,instructions:array<string>,crumbs:array<string>,crumb_links:array<string>,nutrition:map<string,string>,rating:string,reviews:string,"
    "primary:array<string>,media:array<string>,other:array<string>,every:array<string>,metas:map<string,string>>"
)


class Node:
    __slots__ = ("tag", "attrs", "classes", "parent", "children", "start", "end")

    def __init__(self, tag, attrs, parent, start):
        self.tag, self.attrs, self.parent, self.children, self.start, self.end = tag, attrs, parent, [], start, start
        self.classes = frozenset((attrs.get("class") or "").split())


class Tree(HTMLParser):
    """A page's elements in order, each with the stretch of the page's text that it holds. Elements that are never
    closed end with what holds them; ends without a beginning are ignored."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None, 0)
        self.nodes, self.open, self.pieces = [], [self.root], []
        self.feed(html)
        self.close()
        self._down(0)

    def _down(self, depth: int) -> None:
        while len(self.open) > depth:
            self.open.pop().end = len(self.pieces)

    def _implied(self, tag: str) -> None:
        for closed in (*CLOSES.get(tag, ()), *(("p",) if tag in BLOCKS else ())):
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag == closed:
                    self._down(at)
                    break
                if self.open[at].tag in HOLDS.get(closed, ()):
                    break

    def handle_starttag(self, tag, attrs):
        self._implied(tag)
        found = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        node = Node(tag, found, self.open[-1], len(self.pieces))
        self.open[-1].children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._down(at)
                return

    def handle_data(self, data):
        self.pieces.append(data)

    def text(self, node: Node) -> str:
        return "".join(self.pieces[node.start : node.end]).strip()

    def inside(self, node: Node, *tags: str) -> list[Node]:
        out, todo = [], node.children[::-1]
        while todo:
            n = todo.pop()
            if n.tag in tags:
                out.append(n)
            todo += n.children[::-1]
        return out


@lru_cache
def compiled(selector: str):
    """Tests of a selector's parts, the last one first: tag, classes, attributes that must be there, equal or contain a text."""
    parts = []
    for part in re.findall(r"(?:[^\s\[]|\[[^\]]*\])+", selector):
        tag = re.match(r"[a-z0-9]*", part)[0]
        attrs = re.findall(r'\[([\w-]+)(?:(\*?=)"([^"]*)")?\]', part)
        parts.append((tag, frozenset(re.findall(r"\.([\w-]+)", re.sub(r"\[[^\]]*\]", "", part))), tuple(attrs)))
    return tuple(parts[::-1])


def _is(node: Node, test) -> bool:
    tag, classes, attrs = test
    if tag and node.tag != tag or not classes <= node.classes:
        return False
    for name, how, value in attrs:
        own = node.attrs.get(name)
        if own is None or how == "=" and own != value or how == "*=" and value not in own:
            return False
    return True


def matches(node: Node, selector: str) -> bool:
    return _fits(node, compiled(selector))


def _fits(node: Node, parts) -> bool:
    last, *above = parts
    if not _is(node, last):
        return False
    for test in above:
        node = node.parent
        while node is not None and not _is(node, test):
            node = node.parent
        if node is None:
            return False
    return True


_ALL = tuple(dict.fromkeys((*TITLE, *INGREDIENTS, *INSTRUCTIONS, *CRUMBS, *NUTRITION, *RATING, *REVIEWS, *IMAGES.values())))


def _by_key() -> dict:
    """Selectors, compiled, by one thing that an element must have: a class ('.', name), an attribute ('@', name) or a tag ('', name)."""
    out: dict = {}
    for s in _ALL:
        parts = compiled(s)
        tag, classes, attrs = parts[0]
        key = (".", min(classes)) if classes else ("@", attrs[0][0]) if attrs else ("", tag)
        out.setdefault(key, []).append((s, parts))
    return out


#: What is asked of each element, so that few selectors are tried on one.
_BY_KEY = _by_key()


def _first_items(tree: Tree, found, selectors, lists: tuple[str, ...], least: int, longer: int) -> list[str]:
    """Texts of more than `longer` characters: of the first selector that has some, else of the first list with `least` items."""
    for s in selectors:
        texts = [t for n in found[s] if len(t := tree.text(n)) > longer]
        if texts:
            return texts
    for n in tree.nodes:
        if n.tag in lists and len(items := tree.inside(n, "li")) >= least:
            texts = [t for i in items if len(t := tree.text(i)) > longer]
            if texts:
                return texts
    return []


def _nutrient(key: str) -> str | None:
    """What a row of a nutrition table is about."""
    for word, name in (("calorie", "calories"), ("saturated", "saturated_fat"), ("fat", "fat"), ("cholesterol", "cholesterol"), ("sodium", "sodium"), ("carbohydrate", "carbohydrates"), ("fiber", "fiber"), ("sugar", "sugar"), ("protein", "protein")):
        if word in key:
            return name
    return None


def read_page(html: str | None) -> dict | None:
    """The elements' facts of one page; None without html."""
    if not html:
        return None
    tree = Tree(html)
    found = {s: [] for s in _ALL}
    metas: dict[str, str] = {}
    for n in tree.nodes:
        for key in (("", n.tag), *((".", c) for c in n.classes), *(("@", a) for a in n.attrs)):
            for s, parts in _BY_KEY.get(key, ()):
                if _fits(n, parts):
                    found[s].append(n)
        if n.tag == "meta" and "content" in n.attrs:
            for name, by in METAS.items():
                if n.attrs.get(by) == name:
                    metas.setdefault(name, n.attrs["content"])
    sets = {s: frozenset(map(id, v)) for s, v in found.items()}
    several = lambda selectors: [n for n in tree.nodes if any(id(n) in sets[s] for s in selectors)]
    title = next((t for s in TITLE if found[s] and len(t := tree.text(found[s][0])) > 3), "")
    nutrition: dict[str, str] = {}
    for table in several(NUTRITION):
        for row in tree.inside(table, "tr"):
            cells = tree.inside(row, "td", "th")
            if len(cells) >= 2 and (name := _nutrient(tree.text(cells[0]).lower())):
                nutrition[name] = tree.text(cells[1])
    number = lambda selectors, pattern: next((m[1] for n in several(selectors) if (m := re.search(pattern, tree.text(n)))), None)
    crumbs = several(CRUMBS)
    return {
        "title": title, "ingredients": _first_items(tree, found, INGREDIENTS, ("ul", "ol"), 3, 2), "instructions": _first_items(tree, found, INSTRUCTIONS, ("ol",), 2, 10),
        "crumbs": [tree.text(n) for n in crumbs], "crumb_links": [tree.text(a) for n in crumbs for a in tree.inside(n, "a")], "nutrition": nutrition,
        "rating": number(RATING, r"(\d+(?:\.\d+)?)"), "reviews": number(REVIEWS, r"(\d+)"), **{k: [n.attrs["src"] for n in found[s]] for k, s in IMAGES.items()}, "metas": metas,
    }


def page_elements(html: Column) -> Column:
    """read_page() of each page, as a struct; null without html. Spark takes it for non-deterministic, or a filter on one of
    its fields would read each page a second time."""

    @F.pandas_udf(FOUND)
    def found(pages):
        import pandas as pd

        rows = [read_page(h) for h in pages]
        empty = dict.fromkeys(("title", "ingredients", "instructions", "crumbs", "crumb_links", "nutrition", "rating", "reviews", *IMAGES, "metas"))
        return pd.DataFrame([r or empty for r in rows], columns=list(empty))

    return F.when(F.coalesce(html, F.lit("")) != "", found.asNondeterministic()(html))
