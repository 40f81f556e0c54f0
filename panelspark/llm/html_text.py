"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A tolerant reader builds the tree of block elements; inline markup only counts links. Every node
gets features of its subtree (text, link and punctuation density), tag, attribute tokens, depth and
siblings. Boosted trees give the probability that a node holds main text; decoding picks the
likeliest labels in which a node that holds main text has only such ancestors, so a rejected
container never keeps a descendant. Text of accepted nodes is the result, block by block.

The trees learn from pages that mark their article: text in `article` or `main` is positive but for
boilerplate inside it. Copies of those pages without tell-tale tags, and copies with boilerplate put
into the article, teach the rest. At most MAX_PAGES pages are used, chosen by a hash of their id.

Defined results: null and empty html, and pages without main text, give an empty text; unclosed and
crossing tags are repaired, an unclosed script or comment runs to the end; repeated rows give
repeated results; without pages to learn from, marked articles are taken as they are; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import boosting
from panelspark.llm.common import bounded_sample, map_rows, strings

SPREAD = 64
MAX_PAGES = 400

BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object select textarea button title head canvas".split())
CLOSES = {  # a start tag ends an open element of these, up to a container
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body article aside blockquote div footer form header main nav section table td th ul ol dl li "
                  "dd fieldset figure details dialog".split())
BOILER_TAGS = frozenset("nav footer aside header form menu dialog fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts banner bar breadcrumb breadcrumbs button comment comments consent cookie "
    "cookies copyright disclaimer footer form gdpr header legal login masthead menu meta modal nav navbar navigation "
    "newsletter notice notices pagination pager popup promo promoted recommended related reply replies respond share "
    "sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets warning alert "
    "discussion responses feedback rail teaser outbrain taboola".split())
MAIN_WORDS = frozenset("article articlebody body content entry hentry main maincontent page post story text".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD_END = re.compile(r"[.!?…:;](?=\s|$)")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    blocks: list[int] = field(default_factory=list)  # numbers of its own text blocks
    children: list[int] = field(default_factory=list)
    text: int = 0
    links: int = 0
    ends: int = 0
    tags: int = 1
    parts: int = 0


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[str]
    owner: list[int]
    link_chars: list[int]


def _tag_end(source: str, at: int, dead: set[str]) -> int:
    """Place of the `>` that ends the tag at `at`, quotes respected unless they never close."""
    pos = at
    while True:
        gt = source.find(">", pos)
        if gt < 0:
            return -1
        quotes = [(q, ch) for ch in "\"'" if ch not in dead and (q := source.find(ch, pos, gt)) >= 0]
        if not quotes:
            return gt
        q, ch = min(quotes)
        close = source.find(ch, q + 1)
        if close < 0:
            dead.add(ch)
            continue
        if close < gt:
            pos = close + 1
        elif source[q - 1] == "=" or source[q - 1].isspace():
            pos = close + 1
        else:
            return gt


def parse(source: str) -> Page:
    """The tree of block elements of a page and its text blocks in page order."""
    nodes = [Node("html", -1, 0)]
    page = Page(nodes, [], [], [])
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements; number of the block node, -1 for inline ones
    at_node = [0]
    places: dict[str, list[int]] = {}  # where in the stack elements of a name are open, the root left out
    blocks: list[int] = []             # where block elements are
    buffer: list[str] = []
    linked, in_link = 0, 0
    low = source.lower()
    dead: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                me = at_node[-1]
                nodes[me].blocks.append(len(page.blocks))
                page.blocks.append(text)
                page.owner.append(me)
                page.link_chars.append(min(linked, len(text)))
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal in_link
        while len(stack) > depth:
            name, node = stack.pop()
            if stack:
                places[name].pop()
            if node >= 0:
                flush()
                at_node.pop()
                if stack:
                    blocks.pop()
            in_link -= name == "a"

    def push(name: str, node: int) -> None:
        places.setdefault(name, []).append(len(stack))
        if node >= 0:
            blocks.append(len(stack))
        stack.append((name, node))

    def last(names) -> int:
        """The innermost open element of some names; 0 if none is open."""
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    pos, n = 0, len(source)
    while pos < n:
        lt = source.find("<", pos)
        if lt < 0:
            lt = n
        if lt > pos:
            buffer.append(source[pos:lt])
            linked += (lt - pos) if in_link > 0 else 0
        if lt == n:
            break
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            pos = n if end < 0 else end + 3
            continue
        if source[lt + 1:lt + 2] in ("!", "?"):
            end = source.find(">", lt)
            pos = n if end < 0 else end + 1
            continue
        m = _NAME.match(source, lt)
        if not m:
            buffer.append("<")
            pos = lt + 1
            continue
        gt = _tag_end(source, m.end(), dead)
        if gt < 0:
            break
        name, closing = m[1].lower(), source[lt + 1] == "/"
        pos = gt + 1
        nodes[at_node[-1]].tags += 1
        if closing:
            # an inline end tag does not reach out of a block, that of a paragraph not out of a container
            wall = last(SCOPE) if name == "p" else 0 if name in BLOCK else blocks[-1] if blocks else 0
            if last((name,)) > wall:
                pop_to(last((name,)))
            continue
        if name in RAW and source[gt - 1] != "/":
            end = low.find(f"</{name}", gt + 1)
            while end >= 0 and low[end + 2 + len(name):end + 3 + len(name)].isalnum():  # a longer name
                end = low.find(f"</{name}", end + 1)
            end = low.find(">", end) if end >= 0 else -1
            if end >= 0 or name != "head":  # a head that never closes hides nothing
                pos = n if end < 0 else end + 1
            buffer.append(" ")
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name == "hr":
            flush()
            continue
        if name in VOID or name in ("html", "body"):
            continue
        if name in BLOCK:
            flush()
            ends = CLOSES.get(name, set()) | {"p"}
            if last(ends) > last(SCOPE - ends):
                pop_to(last(ends))
            tokens: tuple[str, ...] = ()
            attrs = source[m.end():gt]
            if attrs:
                tokens = tuple(t for a in _ATTR.finditer(attrs) for t in _TOKEN.findall(_CAMEL.sub(" ", a[2]).lower()))
            me = len(nodes)
            parent = at_node[-1]
            nodes.append(Node(name, parent, nodes[parent].depth + 1, tokens))
            nodes[parent].children.append(me)
            push(name, me)
            at_node.append(me)
        else:
            push(name, -1)
            in_link += name == "a"
    pop_to(0)
    for k, block in enumerate(page.blocks):
        node = nodes[page.owner[k]]
        node.text += len(block)
        node.links += page.link_chars[k]
        node.ends += len(_WORD_END.findall(block))
        node.parts += 1
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[nodes[k].parent]
        for name in ("text", "links", "ends", "tags", "parts"):
            setattr(up, name, getattr(up, name) + getattr(nodes[k], name))
    return page


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LISTS = frozenset("ul ol li dl dt dd".split())
TABLES = frozenset("table tbody thead tfoot tr td th caption".split())
N_FEATURES = 27


def features(page: Page) -> np.ndarray:
    """One row of features per node."""
    nodes, out = page.nodes, np.zeros((len(page.nodes), N_FEATURES))
    total = max(1, nodes[0].text)
    before, seen = 0, [0] * len(nodes)
    first = {}
    for b, owner in enumerate(page.owner):
        first.setdefault(owner, before)
        before += len(page.blocks[b])
    for k in range(len(nodes) - 1, -1, -1):
        starts = [seen[c] for c in nodes[k].children] + ([first[k]] if k in first else [])
        seen[k] = min(starts, default=before if k else 0)
    boiler, mains = [False] * len(nodes), [False] * len(nodes)
    for k, x in enumerate(nodes):
        up = nodes[x.parent] if x.parent >= 0 else None
        bad = sum(t in BOILER_WORDS for t in x.tokens)
        good = sum(t in MAIN_WORDS for t in x.tokens)
        own_boiler, own_main = x.tag in BOILER_TAGS or bad > 0, x.tag in MAIN_TAGS
        boiler[k] = own_boiler or (up is not None and boiler[x.parent])
        mains[k] = own_main or (up is not None and mains[x.parent])
        siblings = up.children if up is not None else [k]
        rank = siblings.index(k) if len(siblings) < 64 else min(63, k - siblings[0])
        around = up.text / len(siblings) if up is not None else x.text
        own = sum(len(page.blocks[b]) for b in x.blocks)
        out[k] = (
            x.tag == "p", x.tag in HEADINGS, x.tag in LISTS, x.tag in TABLES, x.tag in ("div", "section"),
            x.tag in BOILER_TAGS, own_main, bad, good, boiler[k], mains[k], x.depth, rank, math.log2(len(siblings)),
            math.log2(1 + x.text), x.text / total, x.links / max(1, x.text), math.log2(1 + x.text / x.tags),
            x.ends / max(1, x.parts), math.log2(1 + x.text / max(1, x.parts)), math.log2(1 + own),
            own / max(1, x.text), seen[k] / total, math.log2(1 + around), x.text / max(1.0, around),
            len(x.children), x.tags)
    return out


def decode(page: Page, probability: np.ndarray) -> list[bool]:
    """The likeliest labels in which a node with label 1 has a parent with label 1."""
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log1p(-p).tolist()
    nodes = page.nodes
    best1, best0 = yes[:], no[:]
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].parent
        best0[up] += best0[k]
        best1[up] += max(best0[k], best1[k])
    label = [False] * len(nodes)
    for k, x in enumerate(nodes):
        label[k] = best1[k] > best0[k] and (x.parent < 0 or label[x.parent])
    return label


def main_text(page: Page, label: list[bool]) -> str:
    return "\n".join(b for b, owner in zip(page.blocks, page.owner) if label[owner])


def marked(page: Page) -> list[bool]:
    """Whether a node holds text of a marked article, boilerplate inside it left out."""
    nodes = page.nodes
    inside, label = [False] * len(nodes), [False] * len(nodes)
    for k, x in enumerate(nodes):
        boiler = (x.tag in BOILER_TAGS and x.tag != "header") or any(t in BOILER_WORDS for t in x.tokens)
        inside[k] = (x.tag in MAIN_TAGS or (x.parent >= 0 and inside[x.parent])) and not boiler
    for k in range(len(nodes) - 1, -1, -1):
        label[k] = label[k] or (inside[k] and bool(nodes[k].blocks))
        if label[k] and nodes[k].parent >= 0:
            label[nodes[k].parent] = True
    return label


_NOISE = ("div class=comments", "section id=comments", "div class=sidebar", "aside", "div class='cookie notice'", "form",
          "div class='related posts'", "nav", "div class=share", "footer", "div class=newsletter", "ul class=menu")


def _varied(source: str, pick: int) -> list[str]:
    """The page with boilerplate put into its article, before, between or after its blocks."""
    close = source.lower().rfind("</article")
    if close < 0:
        return []
    start = source.lower().find("<article")
    paragraphs = [p for p in re.findall(r"<p>([^<]{20,400})", source[start:close])][:8] or ["More."]
    out = source
    for j in range(2):
        tag = _NOISE[(pick // 7 ** j + 5 * j) % len(_NOISE)]
        name = tag.split()[0]
        take = [paragraphs[(pick + i) % len(paragraphs)] for i in range(1 + (pick + j) % 3)]
        inner = "".join(f"<li><a href=x>{t[:24]}</a></li>" if name in ("ul", "nav") else f"<p>{t}</p>" for t in take)
        noise = f"<{tag}>{inner}</{name}>"
        at = out.lower().rfind("</article") if j == 0 else out.find(">", out.lower().find("<article")) + 1
        out = out[:at] + noise + out[at:]
    return [out]


def examples(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_PAGES) -> DataFrame:
    """(features, label, held) of the nodes of a bounded sample of pages that mark their article."""
    rows = bounded_sample(pages.where(F.col(html_col).rlike("(?i)<(article|main)[ >]")).select(id_col, html_col),
                          id_col, max_pages)

    def run(batch: pa.RecordBatch) -> pa.Table:
        x, y, held = [], [], []
        for key, source in zip(batch.column(id_col).to_pylist(), strings(batch, html_col)):
            pick = 7919 * (key or 0) % 100_003
            for k, version in enumerate([source, source, *_varied(source, pick), *_varied(source, pick + 17)]):
                page = parse(version)
                label = marked(page)
                if k % 2:  # without the tags that tell
                    for node in page.nodes:
                        if node.tag in MAIN_TAGS:
                            node.tag, node.tokens = "div", ()
                rows = features(page)
                x += rows.tolist()
                y += [float(v) for v in label]
                held += [pick % 4 == 0] * len(label)
        return pa.table([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64()), pa.array(held, pa.bool_())],
                        names=["features", "label", "held"])
    # the sample comes out of its limit as one partition
    return map_rows(rows.repartition(SPREAD, id_col), run, "features array<double>, label double, held boolean", rows=32, text_col=html_col)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
        max_pages: int = MAX_PAGES) -> boosting.Boosted | None:
    """The fitted trees; None when no page marks its article."""
    rows = examples(pages, id_col, html_col, max_pages)
    return boosting.fit(rows, trees=20, depth=5) if rows.limit(1).count() else None


def extract(pages: DataFrame, model: boosting.Boosted | None, html_col: str = "html",
            keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep` of every row with (text, n_chars)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    types = dict(pages.dtypes)

    def run(batch: pa.RecordBatch) -> pa.Table:
        parsed = [parse(s) for s in strings(batch, html_col)]
        if shared.value is None:
            labels = [marked(p) for p in parsed]
        else:
            size = np.cumsum([0, *(len(p.nodes) for p in parsed)])
            prob = shared.value.probability(np.concatenate([features(p) for p in parsed]))
            labels = [decode(p, prob[a:b]) for p, a, b in zip(parsed, size, size[1:])]
        texts = [main_text(p, label) for p, label in zip(parsed, labels)]
        return pa.table([*(batch.column(k) for k in keep), pa.array(texts, pa.string()),
                         pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "text string, n_chars long"])
    return map_rows(pages.select(*dict.fromkeys([*keep, html_col])), run, schema, rows=128, text_col=html_col)
