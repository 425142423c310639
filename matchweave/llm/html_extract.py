"""Main text of web pages by a tree-structured graphical model.

The nodes are a page's block elements, each content or not. A node's own evidence (its kind,
its class words, its text, what it stands in) gives a potential for each state, and each
parent-child edge gives one for each pair of states. Sum-product messages go from the leaves
up and from the root down and yield each node's marginal; blocks that are content with a
probability of a half or more are kept. The weights maximise the likelihood of labelled pages:
generated ones, whose blocks are labelled as they are written, and a bounded sample of the
table's own pages that mark their article, labelled by that mark.

Edge cases: null html is empty; a page without content gives an empty text; unclosed, nested
and cut-off markup is read as browsers do in outline (a new block ends a paragraph, an unclosed
comment, script or tag runs to the end, a quote counts only where a value begins with it); a character reference is decoded within one stretch of text,
so one that a tag cuts in two stays as it is written; nesting may be as deep as the page is long;
attributes of any name and value are only read for class, id, role and hiding; repeated rows each
give a row; other columns are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

SAMPLE_PAGES, GENERATED_PAGES = 150, 350
MAX_SAMPLE_CHARS = 50_000
#: The attribute that holds a block's label in generated pages; in the table's pages it means nothing.
LABEL = "matchweave-label"

# What ends a tag is told by its state: before a name, in a name, before a value, in quotes, in a value without
# quotes. Quantifiers never give back, so a tag is read once, however it goes wrong.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)"""
_MARKUP = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
_TAG = re.compile(rf"""<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+)>""")
_ATTRIBUTE = re.compile(rf"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE}))?+""")
_WORDS = re.compile("[a-z]+")

# How elements behave, and words that class names and ids are built from.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe svg object select xmp noembed noframes".split())
NEVER = frozenset("head button".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
GROUPS = {
    "p": "text", "blockquote": "text", "pre": "text", "dd": "text", "figcaption": "text",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "li": "item", "dt": "item", "td": "item", "th": "item",
    "ul": "list", "ol": "list", "dl": "list", "table": "list", "tbody": "list", "tr": "list", "menu": "list",
    "article": "main", "main": "main",
    "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "form",
}
KINDS = ("text", "heading", "item", "list", "main", "nav", "header", "footer", "aside", "form", "box")
BAD_WORDS = frozenset("ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations more breadcrumb breadcrumbs nav navbar navigation menu sidebar widget footer copyright legal login search toolbar pagination pager tags meta byline masthead skip alert header topbar site".split())
GOOD_WORDS = frozenset("article content post entry story body text main prose".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond discussion disqus thread reactions".split())


@dataclass
class Page:
    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    hints: list[tuple[bool, bool, bool, bool]] = field(default_factory=list)  # bad, good, comment, hidden
    label: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (node, text) in page order


def _hints(attributes: str, labelled: bool = True) -> tuple[tuple[bool, bool, bool, bool], int]:
    bad = good = comment = hidden = False
    label = -1
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            words = set(_WORDS.findall(value))
            bad |= bool(words & BAD_WORDS)
            good |= bool(words & GOOD_WORDS)
            comment |= bool(words & COMMENT_WORDS)
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")) or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif labelled and name == LABEL:
            label = int(value)
    return (bad, good, comment, hidden), label


def parse(source: str, labelled: bool = True) -> Page:
    """The blocks of a page; ``labelled``: not a page of the table, so ``LABEL`` tells their labels."""
    page = Page()
    page.parent.append(-1)
    page.tag.append("root")
    page.hints.append((False,) * 4)
    page.label.append(0)
    stack: list[tuple[str, int]] = [("root", 0)]  # (tag, block node that its text belongs to)
    places: dict[str, list[int]] = {}  # tag -> where it is on the stack
    run: list[str] = []
    run_linked = links = dead = 0

    def flush() -> None:
        nonlocal run, run_linked
        if run:
            text = " ".join("".join(run).split())
            if text and not dead:
                page.blocks.append((stack[-1][1], text))
                linked.append((len(page.blocks) - 1, run_linked))
            run, run_linked = [], 0

    def pop(to: int) -> None:
        nonlocal links, dead
        while len(stack) > to:
            name = stack.pop()[0]
            places[name].pop()
            links -= name == "a"
            dead -= name in NEVER

    def innermost(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    linked: list[tuple[int, int]] = []
    at, size = 0, len(source)
    while at < size:
        found = _MARKUP.search(source, at)
        text = source[at : found.start() if found else size]
        if text:
            run.append(html.unescape(text))
            run_linked += len(text) if links else 0
        if not found:
            break
        if source[found.start() + 1] in "!?":
            end = "-->" if found[0] == "<!--" else ">"
            at = source.find(end, found.end())
            at = at + len(end) if at >= 0 else size
            continue
        m = _TAG.match(source, found.start())
        if not m:  # the page ends in a tag
            break
        at = m.end()
        name = m[2].lower()
        # a slash that ends a value without quotes belongs to it
        closed = m[3].endswith("/") and m[3][-2:-1] in ("", " ", "\t", "\n", "\r", "\f", "/", '"', "'")
        if m[1]:
            if name not in INLINE:
                flush()
            if depth := innermost((name,)):
                pop(depth)
            continue
        if name in RAW:  # its content is no text, and the block around it goes on
            if not closed:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else size
            continue
        hints, label = _hints(m[3], labelled) if m[3] else ((False,) * 4, -1)
        inline = name in INLINE and not (hints[0] or hints[2] or hints[3])
        if name == "br":
            run.append(" ")
        if name in VOID:
            if not inline:
                flush()
            continue
        if not inline:
            flush()
            ended = ("p", "head") if name in ENDS_PARAGRAPH else ("head",) if name == "body" else ()
            if depth := min((places[n][0] for n in ended if places.get(n)), default=0):
                pop(depth)
            same = {"li": ("ul", "ol"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}.get(name)
            if same:
                rivals = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
                if (depth := innermost(rivals)) > innermost(same):
                    pop(depth)
            page.parent.append(stack[-1][1])
            page.tag.append(name)
            page.hints.append(hints)
            page.label.append(label)
        if closed:
            continue
        places.setdefault(name, []).append(len(stack))
        stack.append((name, stack[-1][1] if inline else len(page.parent) - 1))
        links += name == "a"
        dead += name in NEVER
    flush()
    n = len(page.parent)
    page.chars, page.linked, page.stops = [0] * n, [0] * n, [0] * n
    for (node, text), (_, inside) in zip(page.blocks, linked):
        page.chars[node] += len(text)
        page.linked[node] += min(inside, len(text))
        page.stops[node] += sum(map(text.count, ".!?"))
    return page


def _features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all nodes of the pages: evidence, parent, depth and kind of edge."""
    parent, kind, hints, own, linked, stops, size = [], [], [], [], [], [], 0
    for p in pages:
        parent += [x + size if x >= 0 else -1 for x in p.parent]
        kind += [KINDS.index(GROUPS.get(t, "box")) for t in p.tag]
        hints += p.hints
        own += p.chars
        linked += p.linked
        stops += p.stops
        size += len(p.parent)
    total, total_linked, depth, mine = own.copy(), linked.copy(), [0] * size, [0] * size
    for i, up in enumerate(parent):  # parents come before their children
        bad, good, comment, hidden = hints[i]
        k = kind[i]  # main, bad place, comments, header, hidden: of the node or above it
        mine[i] = (k == 4 or good) | (k in (5, 7, 8, 9) or bad) << 1 | comment << 2 | (k == 6) << 3 | hidden << 4
        if up >= 0:
            depth[i] = depth[up] + 1
            mine[i] |= mine[up]
    for i in range(size - 1, -1, -1):
        if (up := parent[i]) >= 0:
            total[up] += total[i]
            total_linked[up] += total_linked[i]
    parent, kind, depth = np.array(parent), np.array(kind), np.array(depth)
    inside = (np.array(mine)[:, None] >> np.arange(5) & 1).astype(float)
    hints, own, linked, stops, total, total_linked = (np.array(x, float) for x in (hints, own, linked, stops, total, total_linked))
    one_hot = np.eye(len(KINDS))[kind]
    extra = [
        np.ones(size), hints[:, 0], hints[:, 1], hints[:, 2], hints[:, 3], inside,
        inside[:, 0] * (1 - inside[:, 1]) * (1 - inside[:, 2]),
        np.log1p(own) / 5, np.log1p(total) / 8, np.minimum(1, linked / np.maximum(own, 1)), np.minimum(1, total_linked / np.maximum(total, 1)),
        np.minimum(1, 40 * stops / np.maximum(own, 1)), own == 0, (own > 0) & (own < 30), own > 120,
    ]
    x = np.column_stack([one_hot, *extra]).astype(float)
    edge = np.where(np.isin(kind, (0, 1, 2)), 0, np.where(np.isin(kind, (3, 10)), 1, 2))
    return x, parent, depth, edge


@dataclass
class Model:
    own: np.ndarray  # weight of each feature for the content state
    pair: np.ndarray  # (kinds of edge, parent state, child state)

    def marginals(self, x: np.ndarray, parent: np.ndarray, depth: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(state) of each node, and P(parent state, state) of each edge."""
        unary = np.zeros((len(x), 2))
        unary[:, 1] = x @ self.own
        gathered, up, down = unary.copy(), np.zeros_like(unary), np.zeros_like(unary)
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        for rows in levels[:0:-1]:
            joint = self.pair[edge[rows]] + gathered[rows][:, None, :]
            up[rows] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            np.add.at(gathered, parent[rows], up[rows])
        for rows in levels[1:]:
            above = parent[rows]
            joint = (gathered[above] + down[above] - up[rows])[:, :, None] + self.pair[edge[rows]]
            down[rows] = np.logaddexp(joint[:, 0], joint[:, 1])
        child = np.flatnonzero(parent >= 0)
        above = parent[child]
        joint = (gathered[above] + down[above] - up[child])[:, :, None] + self.pair[edge[child]] + gathered[child][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        both = np.zeros((len(x), 2, 2))
        both[child] = joint / joint.sum((1, 2), keepdims=True)
        belief = gathered + down
        belief = np.exp(belief - belief.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True), both

    def fit(self, pages: list[Page], rounds: int = 150, rate: float = 0.15, decay: float = 2e-3) -> None:
        x, parent, depth, edge = _features(pages)
        y = np.array([k for p in pages for k in p.label])
        child = np.flatnonzero(parent >= 0)
        seen_own = x[y == 1].sum(0)
        seen_pair = np.zeros_like(self.pair)
        np.add.at(seen_pair, (edge[child], y[parent[child]], y[child]), 1)
        m = [np.zeros_like(self.own), np.zeros_like(self.pair)]
        v = [np.zeros_like(self.own), np.zeros_like(self.pair)]
        for step in range(1, rounds + 1):
            single, both = self.marginals(x, parent, depth, edge)
            expected = np.zeros_like(self.pair)
            np.add.at(expected, edge[child], both[child])
            gradient = (seen_own - x.T @ single[:, 1]) / len(x) - decay * self.own, (seen_pair - expected) / len(x) - decay * self.pair
            for k, (w, g) in enumerate(zip((self.own, self.pair), gradient)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)


def label_by_article(page: Page) -> bool:
    """Labels a page by its article or main element; false if it has none."""
    inside, out = [False] * len(page.tag), [False] * len(page.tag)
    for i, (tag, up, (bad, _, comment, hidden)) in enumerate(zip(page.tag, page.parent, page.hints)):
        inside[i] = tag in ("article", "main") or (up >= 0 and inside[up])
        out[i] = tag in ("nav", "aside", "footer", "form") or tag in NEVER or bad or comment or hidden or (up >= 0 and out[up])
    page.label = [int(a and not b) for a, b in zip(inside, out)]
    return any(inside)


def generate(words: list[str], r: random.Random) -> str:
    """A page whose block elements carry their label."""

    def say(low: int, high: int, end: str = ".") -> str:
        return html.escape(" ".join(r.choices(words, k=r.randint(low, high))).capitalize()) + end

    def tag(name: str, label: int, body: str, names: str = "") -> str:
        return f'<{name}{f" class={chr(34)}{names}{chr(34)}" if names else ""} {LABEL}="{label}">{body}</{name}>'

    def links(n: int) -> str:
        return tag("ul", 0, "".join(tag("li", 0, f'<a href="/{i}">{say(1, 3, "")}</a>') for i in range(n)))

    def clutter() -> str:
        pick = r.randrange(9)
        if pick == 0:
            return tag("div", 0, say(3, 20), r.choice(["ad", "ads banner", "advert", "sponsored", "promo-box"]))
        if pick == 1:
            return tag("aside", 0, tag("h3", 0, say(1, 4, "")) + links(r.randint(2, 6)) + tag("p", 0, say(4, 30)), r.choice(["", "sidebar", "widget"]))
        if pick == 2:
            return tag("div", 0, tag("p", 0, say(8, 25)) + "<button>OK</button>", r.choice(["cookie-notice", "consent", "gdpr popup", "notice"]))
        if pick == 3:
            return tag("form", 0, tag("p", 0, say(3, 10)) + "<input name=q>" + tag("div", 0, say(1, 3, "")), r.choice(["", "newsletter", "search"]))
        if pick == 4:
            return tag("section", 0, tag("h2", 0, say(1, 2, "")) + "".join(tag("div", 0, tag("p", 0, say(3, 40)), "comment") for _ in range(r.randint(1, 5))), r.choice(["comments", "discussion", "replies"]))
        if pick == 5:
            return tag("div", 0, "".join(f"<a href=#>{say(1, 2, '')}</a> " for _ in range(r.randint(2, 6))), r.choice(["share", "social", "breadcrumb", "tags", "pagination"]))
        if pick == 6:
            return tag("div", 0, tag("h3", 0, say(1, 3, "")) + links(r.randint(2, 5)), r.choice(["related", "recommended", "more"]))
        if pick == 7:
            return tag("nav", 0, links(r.randint(3, 8)))
        return tag("div", 0, links(r.randint(3, 8)), r.choice(["menu", "sidebar", "navbar"]))

    def paragraph() -> str:
        pick = r.randrange(12)
        if pick == 0:
            return tag("h2", 1, say(1, 6, ""))
        if pick == 1:
            return tag("ul", 1, "".join(tag("li", 1, say(2, 20)) for _ in range(r.randint(2, 5))))
        if pick == 2:
            return tag("blockquote", 1, tag("p", 1, say(5, 40)))
        if pick == 3:
            return tag("p", 1, say(1, 4))
        if pick == 4:
            return tag("table", 1, tag("tr", 1, tag("td", 1, say(1, 5, "")) + tag("td", 1, say(1, 5, ""))))
        if pick == 5:
            return tag("p", 1, say(5, 20) + f" <a href=/x>{say(1, 4, '')}</a> " + say(5, 20))
        return tag("p", 1, say(10, 90))

    title = tag("h1", 1, say(2, 10, ""))
    if r.random() < 0.2:
        title = tag("header", 1, title)
    body = title + "".join(paragraph() for _ in range(r.randint(1, 10)))
    if r.random() < 0.3:
        body += clutter()
    name, names = r.choice([("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("div", "story"), ("div", ""), ("section", "post-text")])
    body = tag(name, 1, body, names)
    if r.random() < 0.3:
        body = tag("div", 1, body, r.choice(["", "wrapper", "page"]))
    before = [clutter() for _ in range(r.randint(0, 3))]
    if r.random() < 0.6:
        before.insert(0, tag("header", 0, tag("div", 0, say(1, 3, "")) + (tag("nav", 0, links(4)) if r.random() < 0.5 else tag("p", 0, say(2, 8)))))
    after = [clutter() for _ in range(r.randint(0, 3))]
    if r.random() < 0.8:
        after.append(tag("footer", 0, r.choice([tag("p", 0, "&copy; " + say(2, 12)), "&copy; " + say(2, 12), links(3)])))
    return f'<html {LABEL}="0"><head {LABEL}="0"><title>x</title></head><body {LABEL}="0">{"".join(before)}{body}{"".join(after)}</body></html>'


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, generated: int = GENERATED_PAGES, seed: int = 4) -> Model:
    """A model from generated pages and about ``sample`` pages of the table, chosen by hash."""
    rows = hash_sample(pages.select("page_id", "html"), "page_id", sample).where(F.length("html").between(1, MAX_SAMPLE_CHARS)).collect()
    own = [parse(h, labelled=False) for h in sorted(r["html"] for r in rows)]
    words = [w for p in own for _, t in p.blocks for w in t.split()][:20_000] or ["the", "of", "and", "to"]
    own = [p for p in own if label_by_article(p)]
    r = random.Random(seed)
    made = [parse(generate(words, r)) for _ in range(generated)]
    for p in made:
        p.label = [max(k, 0) for k in p.label]
    for p in own:  # the wrappers above an article are content where the generator says so: leave them out of doubt
        p.label[0] = 0
    model = Model(np.zeros(_features(made[:1])[0].shape[1]), np.zeros((3, 2, 2)))
    model.fit([*made, *own])
    return model


def texts_of(sources: list[str], model: Model) -> list[str]:
    pages = [parse(s, labelled=False) for s in sources]
    if not pages:
        return []
    content = model.marginals(*_features(pages))[0][:, 1] >= 0.5
    out, size = [], 0
    for p in pages:
        out.append("\n".join(text for node, text in p.blocks if content[size + node]))
        size += len(p.parent)
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    model = model or train(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts_of(list(part["html"]), model)})

    kind = pages.schema["page_id"].dataType
    # ids travel as strings: a batch with nulls would make them floats
    source = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    made = source.mapInPandas(run, f"page_id string, url {pages.schema['url'].dataType.simpleString()}, text string")
    return made.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("n_chars", F.length("text").cast("long"))
