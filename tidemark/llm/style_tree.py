"""HTML extraction with site style trees: the pages of a host are merged, and branches of low importance are removed.

A page is a tree of block elements. Style nodes are the paths of tags, ids and
classes from the root; a host's style tree counts, per style node, the pages
that have it, the sequences of child blocks below it (presentation styles) and
the texts in it. Importance is an entropy in units of log(pages): of the
presentation styles for inner nodes, of the pages that share a text for content
(1 if no page shares it, 0 if all pages say the same), joined bottom-up: a
branch is its own presentation and the mean of its texts and child branches,
weighted by how many children it has. All counts are ordinary aggregates by
(host, node), so a host with many pages is spread over tasks and never in one,
and branches are summed by doubling the distance to the node they count for: a
page of any depth takes the logarithm of it in rounds. Copies of a page count once.

A text goes if its node says the same on the pages of the host. Article and
main elements, and tags and names that stand for something else, are priors:
they hold unless the text that the tree leaves speaks clearly against them.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import table
from tidemark.llm.url_filter import host_of
from tidemark.session import release, stage

#: Texts of style nodes of less importance go; where a host has at least PAGES pages with the node.
LEAST, PAGES = 0.3, 5
#: Weight of the branches below a node against its own presentation, for each child; and of a text against the branch it is in.
GAMMA = 0.9
#: A branch named as noise stays if it has NAMED times the letters that no such branch has, what is outside article and main
#: if it has LANDMARK times theirs; FLOOR letters are added to the other side.
NAMED, LANDMARK, FLOOR = 4, 2, 50
#: Paths of more characters go on from their hash.
PATH = 400

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head title script style noscript template svg iframe object canvas select option button input textarea".split())
BESIDE = frozenset("form nav footer aside dialog menu".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

#: Words of ids, classes and roles that name what is not the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners promo promoted promotion sponsor sponsored sidebar aside nav navbar navigation menu menus breadcrumb "
    "breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist disqus respond reply replies share sharing social related recommended recommendations widget widgets pagination pager toolbar complementary contentinfo search".split()
)
_BREAK = re.compile(r"[^0-9a-zA-Z]+|(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    style: str
    hidden: bool  # never shown
    noise: bool  # its own tag or name says so
    inside: bool
    children: list = field(default_factory=list)  # Nodes and texts


def _path(style: str) -> str:
    """What the style nodes below one start with; ``_key`` is the same as a column."""
    return style if len(style) <= PATH else "#" + hashlib.md5(style.encode("utf-8", "replace")).hexdigest()


def _key(style: Column) -> Column:
    return F.when(F.length(style) > PATH, F.concat(F.lit("#"), F.md5(style))).otherwise(style)


class _Builder(HTMLParser):
    """Block tree of a page. Inline tags only carry text, except those that say they are noise."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", "", False, False, False)
        self.open: list[tuple[str, Node]] = [("", self.root)]  # tags and the block that each is in or is

    @property
    def at(self) -> Node:
        return self.open[-1][1]

    def _close(self, k: int) -> None:
        del self.open[k:]

    def _up_to(self, tags, scope) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                self._close(k)
                return
            if self.open[k][0] in scope:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._up_to(("p",), ("table", "td", "th", "div", "article", "section", "body", "li", "blockquote"))
        if tag in SAME:
            self._up_to(SAME[tag], SCOPE[tag])
        if tag == "br":
            self.at.children.append(" ")
        if tag in VOID:
            return
        named = dict(attrs)
        label = " ".join(str(named.get(k) or "") for k in ("id", "class", "role"))
        own = {x.lower() for x in _BREAK.split(label) if x}
        up = self.at
        hidden = tag in HIDDEN or "hidden" in named or re.search(r"display:\s*none", str(named.get("style") or "")) is not None
        header = tag == "header" and not up.inside  # an article's own header may hold its title
        main = tag in ("article", "main") or "articlebody" in label.lower()
        hidden = up.hidden or hidden
        noise = tag in BESIDE or header or (bool(own & NOISE) and not main and tag not in ("html", "body"))
        node = up
        if tag in BLOCK or noise or hidden and not up.hidden:
            name = tag + (f".{'.'.join(sorted(own))}" if own else "")
            node = Node(tag, f"{_path(up.style)}/{re.sub(r'[0-9]+', '0', name)}", hidden, noise, up.inside or main)
            up.children.append(node)
        self.open.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1][0] == tag and len(self.open) > 1:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self._close(k)
                return

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """Block tree of a page; whatever does not parse is text or ignored, never an error."""
    builder = _Builder()
    try:
        builder.feed(html or "")
        builder.close()
    except (AssertionError, ValueError):  # what the standard parser raises on broken declarations: the tree up to there holds
        pass
    return builder.root


def _texts(node: Node):
    """Runs of text of a node between its child blocks, white space as one space."""
    run: list[str] = []
    for x in [*node.children, None]:
        if isinstance(x, str):
            run.append(x)
        else:
            text = " ".join("".join(run).split())
            if text:
                yield text
            run = []


def styles(root: Node):
    """(style node, kind, feature, children) of the shown part of a page: kind 0 the children's tags and how many, kind 1 a text."""
    todo = [root]
    while todo:
        node = todo.pop()
        inner = [x for x in node.children if isinstance(x, Node)]
        yield node.style, 0, ",".join(x.style.rpartition("/")[2] for x in inner), len(inner)
        for text in _texts(node):
            yield node.style, 1, text, 0
        todo += [x for x in inner if not x.hidden]


def _blocks(root: Node, low: set[str]):
    """(text, inside, noise branches around it from the outermost) of the shown texts of important nodes, in page order."""
    todo: list = [(root, ())]
    while todo:
        node, around = todo.pop()
        if isinstance(node, str):
            yield node, *around
            continue
        if node.hidden:
            continue
        around = (*around, id(node)) if node.noise else around
        parts, run = [], []
        for x in [*node.children, None]:
            if isinstance(x, str):
                run.append(x)
                continue
            text = " ".join("".join(run).split())
            if text and node.style not in low:
                parts.append((text, (node.inside, around)))
            if x is not None:
                parts.append((x, around))
            run = []
        todo += reversed(parts)


def _chosen(blocks: list) -> list:
    """Blocks that the priors leave: without noise branches, and those in article and main elements where there are such."""
    plain = sum(len(text) for text, _, around in blocks if not around)
    # A text counts for the innermost noise branch: a column named after its sidebar is not held for the sidebar in it.
    held: dict[int, int] = {}
    for text, _, around in blocks:
        if around:
            held[around[-1]] = held.get(around[-1], 0) + len(text)
    wrong = {k for k, n in held.items() if n > NAMED * (plain + FLOOR)}
    # What a branch is in cannot be noise either.
    wrong |= {k for _, _, around in blocks if wrong.intersection(around) for k in around[: max(i for i, k in enumerate(around) if k in wrong)]}
    left = [(text, inside) for text, inside, around in blocks if wrong.issuperset(around)]
    within = sum(len(text) for text, inside in left if inside)
    if within and sum(len(text) for text, inside in left if not inside) <= LANDMARK * (within + FLOOR):
        left = [x for x in left if x[1]]
    return [text for text, _ in left]


def extract(root: Node, low: set[str]) -> str:
    """Texts of the blocks in page order without noise and without the texts of the style nodes in ``low``, one per line.

    Where an article or main element would lose all its text that way, as
    those of near copies on one site do, what the priors leave of the page stays.
    """
    left = list(_blocks(root, low))
    out = _chosen(left)
    if low and not any(inside for _, inside, _ in left):
        blocks = list(_blocks(root, set()))
        within = sum(len(text) for text, inside, _ in blocks if inside)
        if within and sum(map(len, out)) <= LANDMARK * (within + FLOOR):
            out = _chosen(blocks)
    return "\n".join(out)


def _style_rows(batches):
    for batch in batches:
        out: list[tuple] = []
        for host, html in zip(*(batch.column(c).to_pylist() for c in ("host", "html")), strict=True):
            out += [(host, *x) for x in set(styles(parse(html)))]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["host", "style", "kind", "feature", "children"])


def importance(pages: DataFrame) -> DataFrame:
    """(host, style, pages, presentation, content, importance) of the style nodes of ``pages`` (url, html)."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).distinct()
    seen = rows.mapInArrow(_style_rows, "host string, style string, kind int, feature string, children int")
    counted = stage(seen.groupBy("host", "style", "kind", "children", F.xxhash64("feature").alias("feature")).agg(F.count("*").alias("n")), "styles")
    # Every page has one kind-0 row per different child sequence of a node; most have one, so their sum counts the pages.
    total = F.sum(F.when(F.col("kind") == 0, F.col("n")))
    nodes = counted.groupBy("host", "style").agg(
        total.alias("pages"), F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("own"), (F.sum(F.col("n") * F.col("children")) / total).alias("children"),
        F.sum(F.when(F.col("kind") == 1, F.log("n") * F.col("n"))).alias("shared"), F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("texts"),
    )
    scale = F.log("pages")
    presentation = F.when(F.col("pages") > 1, 1 - F.col("own") / F.col("pages") / scale).otherwise(1.0)
    content = F.when(F.col("texts").isNull(), None).otherwise(F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), 1 - F.col("shared") / F.col("texts") / scale)).otherwise(1.0))
    nodes = nodes.select("host", "style", "pages", "children", presentation.alias("presentation"), content.alias("content"))
    return stage(_joined(nodes), "importance")


def _joined(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the importance of their branches.

    A branch is (1 - g) x presentation + g x the mean, by pages, of its own
    text and its child branches, where g is GAMMA to the number of children.
    Unrolled, it is a sum over the nodes below with the product of the weights
    on the way. A round adds to each node what the nodes at some distance have
    gathered so far and doubles that distance.
    """
    up = F.expr("left(style, greatest(length(style) - length(substring_index(style, '/', -1)) - 1, 0))")
    node = nodes.withColumn("id", F.xxhash64(_key(F.col("style")))).withColumn("up", F.when(F.col("style") != "", F.xxhash64(up)))
    below = node.where("up is not null").groupBy(F.col("host").alias("h"), F.col("up").alias("u")).agg(F.sum("pages").alias("below"))
    node = node.join(below, (F.col("host") == F.col("h")) & (F.col("id") == F.col("u")), "left").drop("h", "u")
    g, own = F.pow(F.lit(GAMMA), F.col("children")), F.when(F.col("content").isNotNull(), F.col("pages")).otherwise(0)
    parts = F.coalesce("below", F.lit(0)) + own
    mean = F.when(parts > 0, g * F.coalesce("content", F.lit(0.0)) * own / parts).otherwise(g * F.col("presentation"))
    node = node.withColumn("alone", (1 - g) * F.col("presentation") + mean).withColumn("part", F.when(parts > 0, g / parts))
    node = stage(node.select("host", "style", "id", "up", "pages", "presentation", "content", "alone", "part"), "style-nodes")
    above = node.select(F.col("host").alias("h"), F.col("id").alias("u"), "part")
    met = node.drop("part").join(above, (F.col("host") == F.col("h")) & (F.col("up") == F.col("u")), "left")
    sums = stage(met.select("host", "id", "up", (F.col("part") * F.col("pages")).alias("weight"), F.col("alone").alias("importance")), "style-sums")
    while not sums.where("up is not null").isEmpty():
        far = sums.where("up is not null").groupBy(F.col("host").alias("h"), F.col("up").alias("u")).agg(F.sum(F.col("weight") * F.col("importance")).alias("more"))
        jump = sums.select(F.col("host").alias("k"), F.col("id").alias("v"), F.col("up").alias("next"), F.col("weight").alias("times"))
        met = sums.join(far, (F.col("host") == F.col("h")) & (F.col("id") == F.col("u")), "left").join(jump, (F.col("host") == F.col("k")) & (F.col("up") == F.col("v")), "left")
        last, sums = sums, stage(met.select("host", "id", F.col("next").alias("up"), (F.col("weight") * F.col("times")).alias("weight"), (F.col("importance") + F.coalesce("more", F.lit(0.0))).alias("importance")), "style-sums")
        release(last)
    return node.join(sums.select("host", "id", "importance"), ["host", "id"]).select("host", "style", "pages", "presentation", "content", "importance")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages`` (page_id, url, html, any others).

    Null html is an empty page; a null url or one without :// belongs to the
    host of empty name. Equal rows give equal results.
    """
    text = GAMMA * F.col("content") + (1 - GAMMA) * F.col("importance")
    low = importance(pages).where((text < LEAST) & (F.col("pages") >= PAGES))
    low = stage(low.groupBy(F.col("host").alias("site")).agg(F.sort_array(F.collect_set("style")).alias("low")), "low")
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    known = page.join(low, host_of(F.col("url")) == F.col("site"), "left").select("page_id", "url", "html", "low")

    def run(batches):
        for batch in batches:
            text = [extract(parse(html), set(low or ())) for html, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return known.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op2_style_tree(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))
