"""HTML extraction: boosted trees over features of DOM nodes, decoded along the tree."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.boosting import Trees, fit

SAMPLE_PAGES = 300
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("head title script style noscript template svg math iframe object canvas select textarea button form option datalist audio video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table", "tbody", "thead", "tfoot"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
# Words that names, classes, ids and roles of page parts are made of.
CHROME = frozenset("nav navbar navigation menu menubar header masthead banner footer foot bottom sidebar side aside rail complementary ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share sharing social related recommended recommendation trending popular breadcrumb breadcrumbs pagination pager toolbar widget widgets comment comments commentlist disqus reply replies respond discussion copyright legal disclaimer search searchform tags contentinfo skip toc links outbrain taboola overlay".split())
CONTENT = frozenset("article main content body post entry story text page blog news paragraph articlebody maincontent prose".split())
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_SPACE = re.compile(r"[ \t\n\r\f\v ]+")
N_FEATURES = 18


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "parts", "depth", "chars", "own", "links", "tags", "stops")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent: Node | None) -> None:
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children: list[Node] = []
        self.parts: list[str | Node | None] = []  # text, child block, or None for a break inside a block
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.own = self.links = self.tags = self.stops = 0


class Dom(HTMLParser):
    """Block elements of a page with their text; inline elements are folded into their block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", (), None)
        self.open: list[tuple[str, Node | None]] = [("#root", self.root)]
        self.links = 0

    def block(self) -> Node:
        return next(n for _, n in reversed(self.open) if n is not None)

    def _pop_to(self, names: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k][0]
            if tag in names:
                for t, _ in self.open[k:]:
                    self.links -= t == "a"
                del self.open[k:]
                return
            if tag in stops:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._pop_to({"p"}, CLOSES_P - {"p"} | {"td", "th", "li", "dd", "button"})
        if tag in SAME_CLOSES:
            names, stops = SAME_CLOSES[tag]
            self._pop_to(set(names.split()), stops)
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                if tag == "br":
                    self.block().parts.append(" ")
            else:
                self.block().tags += 1
                self.links += tag == "a"
                self.open.append((tag, None))
            return
        words = [tag]
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop", "aria-label") and value:
                words += _TOKEN.findall(_CAMEL.sub(r"\1 \2", value).lower())
        parent = self.block()
        node = Node(tag, tuple(words), parent)
        parent.children.append(node)
        parent.parts.append(node)
        if tag not in VOID:
            self.open.append((tag, node))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # "/" means nothing on elements that are not void

    def handle_endtag(self, tag: str) -> None:
        stops = {"article", "main", "body", "table"} if tag in INLINE or tag == "p" else {"#root"}
        self._pop_to({tag}, stops)

    def handle_data(self, data: str) -> None:
        node = self.block()
        node.parts.append(data)
        n = len(data.strip())
        node.own += n
        node.links += n if self.links else 0
        node.stops += data.count(".") + data.count(",") + data.count("!") + data.count("?")


def parse(html: str) -> list[Node]:
    """Nodes of a page, parents first, with the counts of their subtrees."""
    dom = Dom()
    dom.feed(html)
    dom.close()
    nodes, stack = [], [dom.root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(nodes):
        silent = node.tag in SILENT
        node.chars = 0 if silent else node.own + sum(c.chars for c in node.children)
        node.links = 0 if silent else node.links + sum(c.links for c in node.children)
        node.stops += sum(c.stops for c in node.children)
        node.tags += 1 + sum(c.tags for c in node.children)
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    total = max(1, nodes[0].chars)
    x = np.zeros((len(nodes), N_FEATURES), np.float32)
    above: dict[int, tuple[int, int]] = {}
    before = 0
    for k, n in enumerate(nodes):
        chrome, content = sum(t in CHROME for t in n.tokens), sum(t in CONTENT for t in n.tokens)
        up = above[id(n.parent)] if n.parent else (0, 0)
        above[id(n)] = (up[0] + chrome, up[1] + content)
        siblings = n.parent.children if n.parent else [n]
        around = max(1, n.parent.chars) if n.parent else total
        chars = max(1, n.chars)
        x[k] = (
            np.log1p(n.chars), n.chars / total, n.chars / around, n.links / chars, n.chars / n.tags, n.stops / chars,
            n.depth, len(n.children), len(siblings), chrome, content, *up, before / total,
            n.tag in ("p", "h1", "h2", "h3", "blockquote", "pre"), n.tag in ("li", "ul", "ol"), np.log1p(n.own),
            sum(c.chars for c in siblings) / len(siblings) / chars,
        )
        before += n.own if n.tag not in SILENT else 0
    return x


def decode(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """Kept nodes: the choice of largest total log-odds in which a dropped node drops its whole subtree."""
    index = {id(n): k for k, n in enumerate(nodes)}
    weight = np.array([np.log1p(n.chars) + 0.1 for n in nodes])
    gain = logits * weight
    keep, drop = gain.copy(), -gain
    for k in range(len(nodes) - 1, -1, -1):
        for c in nodes[k].children:
            j = index[id(c)]
            keep[k] += max(keep[j], drop[j])
            drop[k] += drop[j]
    kept = np.zeros(len(nodes), bool)
    for k, n in enumerate(nodes):
        passes = n.tag in ("#root", "html", "body")
        kept[k] = n.tag not in SILENT and (passes or keep[k] > drop[k]) and (n.parent is None or kept[index[id(n.parent)]])
    return kept


def blocks(nodes: list[Node], kept: np.ndarray) -> list[str]:
    """Texts of kept blocks in page order; text around a child block makes separate blocks."""
    allowed = {id(n) for n, k in zip(nodes, kept) if k}
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip(" ")
        run.clear()
        if text:
            out.append(text)

    stack: list[Iterator] = [iter(nodes[0].parts)]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            flush()
            stack.pop()
        elif isinstance(part, Node):
            flush()
            if id(part) in allowed:
                stack.append(iter(part.parts))
        else:
            run.append(part)
    return out


def _distant(nodes: list[Node]) -> np.ndarray | None:
    """Labels of a training page from its mark-up: a node that leads to article text is 1."""
    roots = [n for n in nodes if n.tag in ("article", "main") or "articlebody" in "".join(n.tokens)]
    if not roots:
        return None
    good = {id(n) for n in roots}
    index = {id(n): k for k, n in enumerate(nodes)}
    inside = np.zeros(len(nodes), bool)
    for k, n in enumerate(nodes):
        up = n.parent is not None and inside[index[id(n.parent)]]
        inside[k] = (up or id(n) in good) and n.tag not in SILENT and not any(t in CHROME for t in n.tokens)
    y = np.array([float(i and n.chars > 0) for i, n in zip(inside, nodes)])
    for k in range(len(nodes) - 1, 0, -1):
        if y[k]:
            y[index[id(nodes[k].parent)]] = 1
    return y


def vary(html: str, rng: random.Random) -> str:
    """A training page with further page parts around and in its article, under other names.

    Pages of one site share one mark-up; these variants teach the trees the statistics and attribute words
    of menus, notices, comments and side columns as well.
    """
    words = re.sub(r"<[^>]*>", " ", html[-6000:]).split() or ["text"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    names = sorted(CHROME)

    def part() -> str:
        name, n = rng.choice(names), rng.randint(1, 4)
        tag = rng.choice(["div", "section", "aside", "ul", "div"])
        inner = "".join(
            rng.choice([f"<p>{say(rng.randint(4, 40))}</p>", f'<li><a href="#">{say(2)}</a></li>', f"<div>{say(12)}</div>"]) for _ in range(n)
        )
        return f'<{tag} {rng.choice(["class", "id"])}="{name}{rng.choice(["", "-box", " block", "-list"])}">{inner}</{tag}>'

    if rng.random() < 0.5:
        html = html.replace("<article>", f"<article>{part()}", 1)
    if rng.random() < 0.7:
        html = html.replace("</article>", f"{part()}</article>{part()}", 1)
    if rng.random() < 0.5:
        html = html.replace("<article>", f"{part()}<div class='wrap'>{part()}<article class='{rng.choice(sorted(CONTENT))}'>", 1).replace("</article>", "</article></div>", 1)
    return html


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> Trees | None:
    """Fits the trees on at most ``sample_pages`` pages whose mark-up names its article, each also varied."""
    rows = pages.where(F.col(html_col).rlike("(?i)<(article|main)[ >]")).select(F.xxhash64(id_col).alias("k"), F.col(html_col).alias("h"))
    sample = rows.orderBy("k", "h").limit(sample_pages).collect()
    rng, xs, ys = random.Random(11), [], []
    for row in sample:
        for html in (row.h, vary(row.h, rng), vary(row.h, rng)):
            nodes = parse(html)
            y = _distant(nodes)
            if y is not None:
                xs.append(features(nodes))
                ys.append(y)
    if not xs:
        return None
    x, y = np.concatenate(xs), np.concatenate(ys)
    if y.min() == y.max():
        return None
    weight = np.log1p(np.expm1(x[:, 0])) + 0.2
    return fit(x, y, weight)


def _fallback(x: np.ndarray) -> np.ndarray:
    """Without a trained model: page parts by name and link density."""
    return np.where((x[:, 9] > 0) | (x[:, 3] > 0.5), -1.0, 1.0)


def extract(pages: DataFrame, model: Trees | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from the whole html.

    Null, empty or text-free pages give an empty text. Pages are worked on one by one, so repeated rows,
    null ids and extra columns need no care; an empty table gives no rows.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                pages_nodes = [parse(v.as_py()) for v in part.column(2)]
                x = np.concatenate([features(n) for n in pages_nodes])
                logits = _fallback(x) if model is None else model.margins(x)
                texts, k = [], 0
                for nodes in pages_nodes:
                    kept = decode(nodes, logits[k : k + len(nodes)])
                    texts.append("\n\n".join(blocks(nodes, kept)))
                    k += len(nodes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return base.mapInArrow(run, f"page_id {base.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def query(pages: DataFrame) -> DataFrame:
    return extract(pages, train(pages))
