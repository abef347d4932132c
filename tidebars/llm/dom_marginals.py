"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of block elements whose leaves are text blocks. Every node is content or not. Node potentials come from tags, class
and id words and text shape, potentials of parent-child pairs from how often a child agrees with its parent; both are counted on labelled
pages. Sum-product messages go up and down the tree, and blocks whose marginal is at least one half are the page's text.
"""

from __future__ import annotations

import html as entities
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.common import filled, map_arrow, slices

# Elements by their role in HTML.
RAW = frozenset("script style title textarea".split())
#: Elements that pages often leave open. One without an end tag of its own ends at the next block tag.
LOOSE = frozenset("noscript template iframe svg object canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html option li dd dt td th tr thead tbody tfoot caption legend summary".split()) | {"hr"}
SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SAME = {k: frozenset(v.split()) for k, v in SAME.items()}
LIMITS = frozenset("ul ol dl table div article section aside nav main body html form td th".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Tree:
    """parent[i] < i; features[i]: names; text[i]: a leaf's block, None for an element."""

    __slots__ = ("features", "label", "parent", "text")

    def __init__(self):
        self.parent, self.features, self.text, self.label = [-1], [("tag:html",)], [None], [0]


def _shape(text: str, linked: int) -> tuple[str, ...]:
    n = text.count(" ") + 1
    size = next(i for i, most in enumerate((2, 5, 10, 20, 40, 1 << 60)) if n <= most)
    share = next(i for i, most in enumerate((0.0, 0.3, 0.7, 9.0)) if linked / max(1, len(text)) <= most)
    return f"size:{size}", f"links:{share}", f"ends:{text[-1:] in '.!?:;\"'}"


def parse(page: str) -> Tree:
    """Blocks and their elements. White space inside a block is one space, character references are decoded, comments and raw elements dropped."""
    tree, stack, at, link, linked, parts = Tree(), [("html", 0)], 0, 0, 0, []
    left_open, known, sizes = -1, {}, {}
    opened: dict[str, list[int]] = {}  # of each element name, where it stands in the stack

    def following(start: str, at: int) -> int:
        """Where such a tag next starts, or past the end. Each part of the page is searched once for it."""
        if known.get(start, -1) < at:
            found = re.compile(rf"<{start}(?![A-Za-z0-9_-])", re.I).search(page, at)
            known[start] = found.start() if found else len(page)
        return known[start]

    def put(s: str) -> None:
        nonlocal linked
        if s:
            parts.append(s)
            if link:
                linked += len(s)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                node = stack[-1][1]
                tree.parent.append(node)
                size, links, ends = _shape(text, linked)
                tree.features.append((f"in:{stack[-1][0]}/{links}", size, ends))
                sizes[len(tree.parent) - 1] = (len(text), linked)
                tree.text.append(text)
                tree.label.append(tree.label[node])
        linked = 0

    def close(names: frozenset[str], stop: frozenset[str]) -> None:
        """Close the innermost of ``names`` that is open, unless one of ``stop`` is open inside it. Costs nothing for what is not open."""
        k = max([opened[x][-1] for x in names if opened.get(x)], default=0)
        if k and k >= max([opened[x][-1] for x in stop if opened.get(x)], default=0):
            flush()
            while len(stack) > k:
                leave()

    def leave() -> None:
        opened[stack.pop()[0]].pop()

    while m := _TAG.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                link = max(0, link - 1)
            elif name in BLOCKS or name in LOOSE:
                flush()
                if stack[-1][1] == left_open:
                    leave()
                close(frozenset((name,)), LIMITS if name in LOOSE else frozenset())
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "img", "input"):
                put(" ")
            continue
        if name == "a":
            link += 1
            continue
        if name not in BLOCKS and name not in LOOSE:
            continue
        flush()
        if stack[-1][1] == left_open:
            leave()
        if name in LOOSE and m[3].endswith("/"):
            continue
        link = 0
        if name in CLOSES_P:
            close(frozenset(("p",)), LIMITS)
        if name in SAME:
            close(SAME[name], LIMITS - SAME[name])
        words, label = [], tree.label[stack[-1][1]]
        if m[3]:
            for key, *value in _ATTR.findall(m[3]):
                words += [f"word:{w}" for w in _WORD.findall("".join(value).lower())] if key.lower() in ("class", "id", "role") else ["word:hidden"]
            if (mark := re.search(r"\bdata-content=\"([01])\"", m[3])):
                label = int(mark[1])
        tree.parent.append(stack[-1][1])
        tree.features.append((f"tag:{name}", *dict.fromkeys(words)))
        tree.text.append(None)
        tree.label.append(label)
        opened.setdefault(name, []).append(len(stack))
        stack.append((name, len(tree.parent) - 1))
        if name in LOOSE and following(f"/{name}", at) >= following(name, at):
            left_open = len(tree.parent) - 1
    put(page[at:])
    flush()
    # whether most of an element's text is links goes with its tag: lists of links and lists of sentences differ
    total = [(0, 0)] * len(tree.parent)
    for i in range(len(total) - 1, 0, -1):
        n, linked = sizes.get(i, total[i])
        if tree.text[i] is None:
            first, *words = tree.features[i]
            tree.features[i] = (f"{first}/{'links' if 2 * linked > n else 'text'}", *words)
        up = tree.parent[i]
        total[up] = (total[up][0] + n, total[up][1] + linked)
    return tree


def pair_kind(tree: Tree, i: int) -> str:
    """What a parent-child potential depends on: a block stands in its element; an element in another is told by both tags."""
    if tree.text[i] is not None:
        return "text"
    tag = lambda k: tree.features[k][0][4:].partition("/")[0]
    return f"{tag(tree.parent[i])}>{tag(i)}"


def marginals(tree: Tree, node: dict[str, float], edge: dict[str, tuple[float, float]], prior: float) -> list[float]:
    """Probability of content at each node, by sum-product messages. node: log odds of features; edge: P(child content | parent not, parent), under
    "element" for pairs of tags that have none of their own."""
    n = len(tree.parent)
    own, turn, up = [1.0] * n, [None] * n, [1.0] * n  # odds of a node alone; its edge; odds of what stands below it
    for i in range(n):
        odds = sum([node.get(f, 0.0) for f in tree.features[i]]) + (prior if i == 0 else 0.0)
        own[i] = math.exp(max(-30.0, min(30.0, odds)))
        turn[i] = edge.get(pair_kind(tree, i), edge["element"]) if i else None
    sent = [1.0] * n  # message to the parent, as odds
    for i in range(n - 1, 0, -1):
        odds, (a, b) = min(max(own[i] * up[i], 1e-100), 1e100), turn[i]
        sent[i] = (1 - b + b * odds) / (1 - a + a * odds)
        up[tree.parent[i]] = min(max(up[tree.parent[i]] * sent[i], 1e-100), 1e100)
    full = [0.0] * n
    full[0] = own[0] * up[0]
    for i in range(1, n):
        p, (a, b) = tree.parent[i], turn[i]
        rest = full[p] / sent[i]
        full[i] = min(max(own[i] * up[i] * (a + b * rest) / (1 - a + (1 - b) * rest), 1e-100), 1e100)
    return [x / (1 + x) for x in full]


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    """Pages whose elements say by data-content whether they are content; an element without it takes its parent's. Random mixes of common layouts."""
    rng = random.Random(seed)
    words = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()

    def said(a: int, b: int, end: str = ".") -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(a, b))).capitalize() + end

    def links(k: int) -> str:
        return "".join(f'<li><a href="/x">{said(1, 3, "")}</a></li>' for _ in range(k))

    def para(tag: str) -> str:
        inner = said(3, 90)
        if rng.random() < 0.2:
            inner += f' <a href="/y">{said(1, 4, "")}</a> {said(3, 20)}'
        if rng.random() < 0.03:
            inner += rng.choice(("<object>{}</object>", "<canvas>{}</canvas>")).format(said(3, 12))
        return f"<{tag}>{inner}</{tag}>"

    def story() -> str:
        tag = "div" if rng.random() < 0.15 else "p"
        out = [f"<h1>{said(2, 12, '')}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice((1, 2, 3, 5, 8, 14))):
            kind = rng.random()
            if kind < 0.72:
                out.append(para(tag))
            elif kind < 0.8:
                out.append(f"<h2>{said(1, 8, '')}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{said(2, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{said(5, 40)}</p></blockquote>")
            elif kind < 0.93:
                out.append(f"<pre>{said(3, 30, '')}</pre>")
            elif kind < 0.96:
                out.append(f"<figure><figcaption>{said(3, 15)}</figcaption></figure>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{said(1, 3, '')}</td><td>{said(1, 3, '')}</td></tr>" for _ in range(3)) + "</table>")
        return "".join(out)

    def part(tag: str, names: str, inner: str) -> str:
        name = rng.choice(names.split()) if names and rng.random() < 0.85 else ""
        attr = f' {rng.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f'<{tag}{attr} data-content="0">{inner}</{tag}>'

    def above() -> list[str]:
        return [
            part("header", "header site-header masthead banner top page-header", f"<h2>{said(1, 3, '')}</h2><p>{said(2, 8)}</p>"),
            part("nav", "nav menu main-nav navbar navigation breadcrumb breadcrumbs", f"<ul>{links(rng.randint(2, 8))}</ul>"),
            part("div", "ad ads advert advertisement sponsor sponsored promo banner-ad adbox", rng.choice((said(2, 14), f"<p>{said(2, 20)}</p>"))),
            part(rng.choice(("noscript", "template", "iframe", "svg", "select")), "", said(2, 14)),
            part("div", "cookie cookie-notice cookie-banner consent gdpr notice alert announcement", f"<p>{said(5, 25)}</p><button>{said(1, 2, '')}</button>"),
        ]

    def inside() -> list[str]:
        return [
            part("div", "ad ads advert sponsored promo", said(2, 14)),
            part("div", "share social share-buttons sharing tools", f"<ul>{links(3)}</ul>"),
            part("aside", "related pullquote sidebar more related-posts recommended", f"<h3>{said(1, 3, '')}</h3><ul>{links(3)}</ul>"),
            part("form", "newsletter subscribe signup search login", f"<p>{said(2, 12)}</p><label>{said(1, 2, '')}</label><input>"),
        ]

    def below() -> list[str]:
        notes = "".join(f'<{rng.choice(("div", "li"))} class="comment"><p>{said(2, 40)}</p></div>' for _ in range(rng.randint(1, 5)))
        return [
            part("aside", "sidebar side widget widgets related rail", rng.choice((f"<h3>{said(1, 3, '')}</h3><ul>{links(5)}</ul>", f"<p>{said(4, 30)}</p>"))),
            part(rng.choice(("section", "div", "ol")), "comments comment-list responses discussion replies disqus reader-comments", f"<h3>{said(1, 3, '')}</h3>{notes}"),
            part("form", "newsletter subscribe comment-form contact search reply", f"<p>{said(3, 15)}</p><label>{said(1, 2, '')}</label>"),
            part("footer", "footer site-footer colophon bottom copyright legal", f"{said(2, 6, '')} &middot; {said(2, 14)}"),
            part("div", "footer copyright legal disclaimer related popup modal newsletter overlay", f"<p>{said(3, 20)}</p>"),
        ]

    pages = []
    for _ in range(n):
        body = story()
        for extra in inside():
            if rng.random() < 0.12:
                at = [m.start() for m in re.finditer(r"<(?=p>|div>|h2>|ul>)", body)] or [0]
                k = rng.choice(at)
                body = body[:k] + extra + body[k:]
        tag = rng.choice(("article", "article", "article", "main", "div", "section"))
        kind = "content article post entry story main post-content entry-content article-body text".split()
        attr = f' class="{rng.choice(kind)}"' if tag in ("div", "section") or rng.random() < 0.4 else ""
        if rng.random() < 0.15:
            tag, attr = rng.choice(("div", "div", "section", "main")), ""
        main = f'<{tag}{attr} data-content="1">{body}</{tag}>'
        if rng.random() < 0.3:
            outer, attr = rng.choice(("main", "div")), rng.choice((' id="content"', ' class="wrapper"', ""))
            main = f'<{outer}{attr} data-content="1">{main}</{outer}>'
        pick = lambda parts: "".join(x for x in parts if rng.random() < 0.6)
        bare = rng.random() < 0.25
        if bare:
            main = body
        pages.append(f"<!DOCTYPE html><html><body data-content=\"{int(bare)}\">{pick(above())}{main}{pick(below())}</body></html>")
    return pages


#: Pairs of tags met less often than this on labelled pages share one potential.
LEAST_PAIRS = 20


class Model:
    """Counts of labelled pages as potentials."""

    def __init__(self, counts: dict[tuple[str, int], int], pairs: dict[tuple[str, int, int], int], smooth: float = 1.0):
        total = [max(1, sum(n for (f, y), n in counts.items() if y == k and (f.startswith("tag:") or f.startswith("in:")))) for k in (0, 1)]
        names = {f for f, _ in counts}
        self.node = {f: math.log((counts.get((f, 1), 0) + smooth) / (total[1] + 2 * smooth)) - math.log((counts.get((f, 0), 0) + smooth) / (total[0] + 2 * smooth)) for f in names}
        self.edge = {}
        whole = {("element", a, b): sum(n for (kind, p, y), n in pairs.items() if kind != "text" and (p, y) == (a, b)) for a in (0, 1) for b in (0, 1)}
        for kind in ["text", "element", *sorted({k for k, _, _ in pairs} - {"text"})]:
            counts = whole if kind == "element" else pairs
            if kind in ("text", "element") or sum(counts.get((kind, a, b), 0) for a in (0, 1) for b in (0, 1)) >= LEAST_PAIRS:
                yes, no = ([counts.get((kind, a, b), 0) for a in (0, 1)] for b in (1, 0))
                share = (0.5, 0.5) if kind in ("text", "element") else self.edge["element"]
                self.edge[kind] = tuple((y + 2 * smooth * s) / (y + n + 2 * smooth) for y, n, s in zip(yes, no, share, strict=True))
        self.prior = 0.0


def train(pages: DataFrame) -> Model:
    """Potentials from labelled pages (column html, elements marked by data-content). Counts are summed by Spark; the collected table has one
    row for each feature and label, and pages are labelled by hand or rule, so their vocabulary is bounded."""
    kind = "what string, feature string, parent int, label int"

    def run(batches):
        for batch in batches:
            rows = []
            for page in batch.column("html").to_pylist():
                tree = parse(page or "")
                for i in range(1, len(tree.parent)):
                    y = tree.label[i]
                    if y is None:
                        continue
                    rows += [("node", f, 0, y) for f in tree.features[i]]
                    up = tree.label[tree.parent[i]]
                    if up is not None:
                        rows.append(("pair", pair_kind(tree, i), up, y))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))], ["what", "feature", "parent", "label"])

    got = map_arrow(pages.select("html"), run, kind).groupBy("what", "feature", "parent", "label").count().collect()
    return Model({(r.feature, r.label): r["count"] for r in got if r.what == "node"}, {(r.feature, r.parent, r.label): r["count"] for r in got if r.what == "pair"})


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but ``html``, and text: the blocks whose marginal is one half or more, in page order with an empty line in between (two \\n).

    Null or empty html, and pages without content, give the empty text. A column named text is replaced. Rows are independent: repeated rows
    and missing ids make no difference. Whole pages are read. An empty table gives no rows. Nothing is shuffled.
    """
    rest = [c for c in pages.columns if c not in (html, "text")]
    rows = pages.select(F.struct(*rest).alias("rest") if rest else F.lit(None).cast("string").alias("rest"), filled(html).alias("html"))
    node, edge, prior = model.node, model.edge, model.prior

    def run(batches):
        for part in slices(batches, "html"):
            out = []
            for page in part.column("html").to_pylist():
                tree = parse(page)
                p = marginals(tree, node, edge, prior)
                out.append("\n\n".join([t for t, x in zip(tree.text, p, strict=True) if t is not None and x >= 0.5]))
            yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(out, pa.string())], ["rest", "text"])

    got = map_arrow(rows, run, f"rest {rows.schema['rest'].dataType.simpleString()}, text string")
    return got.select(*(F.col("rest").getField(c).alias(c) for c in rest), "text")


#: Labelled pages the query trains on.
TRAINING_PAGES = 600


def op6_dom_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(spark.createDataFrame([(p,) for p in labelled_pages(TRAINING_PAGES)], "html string"))
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), model).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op6_dom_marginals": (op6_dom_marginals, None)}
