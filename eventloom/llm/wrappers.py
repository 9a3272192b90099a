"""Main text of HTML pages by wrapper induction over same-host pages.

Pages are parsed into block sequences over a skeleton, the DOM tree with repeated siblings merged. The skeletons of a
host are aligned by simple tree matching into one template. Over all pages of the host, every template node has the
mass of its different texts: a slot that varies from page to page has much, however often one text is repeated, and one
whose wording stays has little. The content of the host is the subtree that holds most of the varying mass; blocks in
it that stay constant belong to the template. Tags, roles and class words are marks: they weigh in where nodes compete,
and tell adverts, forms and comments, which vary too, inside the content.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import checked_broadcast, mapped, stored

#: A block is constant if it stands in its node on this share of the distinct pages that have the node, of so many at
#: least; a node whose blocks are constant for this share is part of the template.
CONSTANT_SHARE = 0.9
CONSTANT_PAGES = 5
#: The content is in the child node that has this share of a node's varying mass; the second, on few pages.
DOMINANT, DOMINANT_FEW = 0.8, 0.95
#: What a mark leaves of a text's mass, and how much more an article's and a content-named node's counts.
MARKED, ARTICLE, NAMED = 0.1, 8.0, 2.0
#: Skeletons of one host that a task aligns in a row; more are aligned in rounds.
ALIGNED = 256
#: Templates and their like up to which they are broadcast.
SMALL_ROWS = 5_000
#: Elements nested deeper have the skeleton node of their ancestor at this depth.
DEPTH = 120

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"))
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends an open one of these kinds, unless one of the stoppers stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
}
MARKED_TAGS = frozenset("head nav footer aside form button select option label fieldset dialog menu svg canvas object audio video map math".split())
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist tooltip".split())
#: Words of class and id values that mark what isn't the article.
MARKED_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar footer sidebar side aside rail ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login signin register share sharing social related recommended recommendations trending popular "
    "comment comments commentlist disqus reply replies respond discussion pagination pager toolbar widget skip search form paywall teaser outbrain taboola".split()
)
HEADER_WORDS = frozenset(("header", "siteheader", "pageheader"))
CONTENT_WORDS = frozenset("article content post entry story main text body".split())
#: An <article> with one of these words isn't the page's own.
OTHER_ARTICLE = frozenset(("comment", "comments", "reply", "ad", "advert", "sponsored", "related", "teaser", "promo"))

SPECIAL = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
TAG_SIGN = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Node:
    """A skeleton node: merged siblings of one label."""

    label: str
    children: list[Node] = field(default_factory=list)
    at: int = 0

    def child(self, label: str) -> Node:
        """The next child of this label from the present place on, or a new one at the end."""
        for i in range(self.at, len(self.children)):
            if self.children[i].label == label:
                self.at = i
                return self.children[i]
        self.children.append(Node(label))
        self.at = len(self.children) - 1
        return self.children[-1]


def written(node: Node) -> str:
    return node.label + (f"({','.join(map(written, node.children))})" if node.children else "")


def read(text: str) -> Node:
    """The inverse of `written`."""
    root = Node("")
    stack, word = [root], []

    def done() -> None:
        if word:
            stack[-1].children.append(Node("".join(word)))
            word.clear()

    for c in text:
        if c == "(":
            done()
            stack.append(stack[-1].children[-1])
        elif c == ")":
            done()
            stack.pop()
        elif c == ",":
            done()
        else:
            word.append(c)
    done()
    return root.children[0] if root.children else Node("html")


def preorder(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        out.append(x := todo.pop())
        todo.extend(reversed(x.children))
    return out


# --- one page --------------------------------------------------------------------------------------------------
@dataclass
class Open:
    tag: str
    node: Node
    #: The marked elements on the way here: (node, whether only class words mark it).
    marks: tuple[tuple[Node, bool], ...]
    #: Inside an <article> or <main>.
    inside: bool
    link: bool


def words_of(value: str) -> set[str]:
    return {w.lower() for w in WORDS.findall(value)} | set(re.split(r"[^a-z0-9]+", value.lower()))


def clean_label(tag: str, given: dict[str, str]) -> str:
    """Tag and first class or id, in characters that the written skeleton doesn't use itself."""
    first = re.sub(r"[^a-zA-Z0-9_-]|\d{2,}", "", (given.get("class") or given.get("id") or "").split(" ")[0])
    name = re.sub(r"[^a-z0-9-]", "", tag)
    return f"{name}.{first}" if first else name


class Page:
    """Blocks (node, text, link characters, marks) of a page's text, and its skeleton. Linear in the source."""

    def __init__(self, source: str) -> None:
        self.root = Node("html")
        self.stack = [Open("html", self.root, (), False, False)]
        self.opened: Counter[str] = Counter()
        self.blocks: list[tuple[Node, str, int, tuple[tuple[Node, bool], ...]]] = []
        self.pieces: list[str] = []
        self.linked = 0
        #: Where a search for a tag's end has come by that found none.
        self.failed: set[int] = set()
        self.last = {c: source.rfind(c) for c in "\"'>"}
        at, end = 0, len(source)
        while at < end:
            m = SPECIAL.search(source, at)
            if not m:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            if self.last[">"] < at:
                # A tag that the end of the page cuts off.
                break
            stop = self.tag_end(source, at)
            attributes, at = source[at:stop], stop + 1
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
                continue
            self.open(tag, attributes)
            if tag in RAW:
                stop_tag = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
                # The text is markup's own, not the page's.
                at = stop_tag.start() if stop_tag else end
        self.flush()

    def tag_end(self, source: str, start: int) -> int:
        """The place of the `>` that ends a tag: the first outside quotes, or the first at all if quotes don't close."""
        at, seen = start, []
        while m := TAG_SIGN.search(source, at):
            if m[0] == ">":
                return m.start()
            if m.start() in self.failed or m.start() >= self.last[m[0]]:
                break
            seen.append(m.start())
            at = source.index(m[0], m.end()) + 1
        self.failed.update(seen)
        return source.index(">", start)

    def text(self, raw: str) -> None:
        self.pieces.append(raw)
        if self.stack[-1].link:
            self.linked += len(raw)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(entities.unescape("".join(self.pieces)).split())
            if text:
                top = next(x for x in reversed(self.stack) if x.tag in BLOCK)
                self.blocks.append((top.node, text, self.linked, top.marks))
            self.pieces, self.linked = [], 0

    def pop_to(self, depth: int) -> None:
        if any(x.tag in BLOCK for x in self.stack[depth:]):
            self.flush()
        self.opened.subtract(x.tag for x in self.stack[depth:])
        del self.stack[depth:]

    def open(self, tag: str, attributes: str) -> None:
        if tag == "html":
            return
        if tag in VOID:
            if tag in BLOCK:
                self.flush()
            elif tag in ("br", "img"):
                self.text(" ")
            return
        if tag in BLOCK:
            self.end_open({"p"}, {"table", "td", "th", "button", "object"})
            if tag in ENDS:
                self.end_open(*ENDS[tag])
            self.flush()
        given = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
        above = self.stack[-1]
        words = words_of(f"{given.get('class', '')} {given.get('id', '')}") if "class" in given or "id" in given else set()
        role = given.get("role", "").lower()
        hard = (
            tag in MARKED_TAGS or tag in RAW or role in MARKED_ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true"
            or ("style" in given and INVISIBLE.search(given["style"]) is not None)
            or (tag == "article" and bool(words & OTHER_ARTICLE)) or (not above.inside and tag == "header")
        )
        soft = (tag not in ("body", "article", "main") and bool(words & MARKED_WORDS)) or (not above.inside and bool(words & HEADER_WORDS))
        node = above.node if len(self.stack) >= DEPTH else above.node.child(clean_label(tag, given))
        if node is not above.node:
            node.at = 0
        marks = (*above.marks, (node, not hard)) if hard or soft else above.marks
        inside = above.inside or tag in ("article", "main") or role in ("article", "main")
        self.stack.append(Open(tag, node, marks, inside, above.link or tag == "a"))
        self.opened[tag] += 1

    def end_open(self, kinds: set[str], stoppers: set[str]) -> None:
        if not any(self.opened[k] for k in kinds):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in kinds:
                self.pop_to(i)
                # A cell ends and then its row.
                continue
            if self.stack[i].tag in stoppers or (self.stack[i].tag in BLOCK and kinds == {"p"}):
                return

    def close(self, tag: str) -> None:
        if not self.opened[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self.pop_to(i)
                return
            if tag not in BLOCK and self.stack[i].tag in BLOCK:
                return


# --- templates -------------------------------------------------------------------------------------------------
def matched(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the pairs of a largest top-down, order-keeping matching of equal labels."""
    if a.label != b.label:
        return []
    x, y = a.children, b.children
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    inner: dict[tuple[int, int], list] = {}
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            gain = 0
            if p.label == q.label:
                inner[i, j] = matched(p, q)
                gain = len(inner[i, j])
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + gain)
    pairs, i, j = [(a, b)], len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += inner[i - 1, j - 1]
            i, j = i - 1, j - 1
    return pairs


def absorbed(template: Node, page: Node) -> None:
    """Adds to the template what the page's tree has besides, behind the nearest matched sibling before it."""
    partner = {id(q): p for p, q in matched(template, page)}

    def go(t: Node, p: Node) -> None:
        at = 0
        for child in p.children:
            if id(child) in partner:
                mate = partner[id(child)]
                at = next(i for i, c in enumerate(t.children) if c is mate) + 1
                go(mate, child)
            else:
                t.children.insert(at, child)
                at += 1

    if template.label == page.label:
        go(template, page)


def template_of(skeletons: list[str]) -> str:
    """One template for all skeletons, in a fixed order: the widest first."""
    ordered = sorted(set(skeletons), key=lambda s: (-len(s), s))
    whole = read(ordered[0])
    for s in ordered[1:]:
        absorbed(whole, read(s))
    return written(whole)


def places(template: str, skeleton: str) -> list[int]:
    """For each skeleton node in preorder its template node's number in preorder, -1 if it has none."""
    whole, page = read(template), read(skeleton)
    number = {id(n): i for i, n in enumerate(preorder(whole))}
    mate = {id(q): number[id(p)] for p, q in matched(whole, page)}
    return [mate.get(id(n), -1) for n in preorder(page)]


@dataclass
class Slot:
    """What all pages of a host have in a template node under the same marks (2 * place + 1 for one by class words only)."""

    place: int
    marks: tuple[int, ...]
    #: Characters outside links of its different texts, how many these are, and on how many pages the node is.
    mass: float
    texts: int
    pages: int
    #: Characters of its blocks on all pages, and of those that are constant.
    volume: float = 0.0
    constant: float = 0.0


@dataclass
class Region:
    """Where a host's content is: template nodes from lo up to hi, without those of marks that count, and titles."""

    lo: int
    hi: int
    #: Marked nodes whose marks don't count, as they hold the content; h1 nodes outside that belong to it; all h1 nodes.
    void: list[int]
    titles: list[int]
    heads: list[int]
    #: The whole page is the region: blocks that are mostly links go.
    whole: bool
    #: Constant blocks go; they stay where they are most of the content, as on a host of copies.
    drops_constant: bool


def region_of(template: str, slots: list[Slot], semantic: bool = True) -> Region:
    """The content of a host by the varying mass of its template's nodes. semantic: marks and names weigh in."""
    nodes = preorder(read(template))
    number = {id(n): i for i, n in enumerate(nodes)}
    kind = [n.label.split(".")[0] for n in nodes]
    parent, end = [-1] * len(nodes), list(range(1, len(nodes) + 1))
    for i in range(len(nodes) - 1, -1, -1):
        for c in nodes[i].children:
            parent[number[id(c)]] = i
            end[i] = max(end[i], end[number[id(c)]])
    raw = [0.0] * len(nodes)
    for s in slots:
        if s.place >= 0:
            raw[s.place] += s.mass

    void: set[int] = set()
    if semantic:
        # Marks around the article with the fewest of them don't count; without any article, nor do class words around more text than all else.
        around: dict[int, tuple[int, ...]] = {}
        for s in slots:
            way = [s.place]
            while way[-1] > 0:
                way.append(parent[way[-1]])
            for i in way:
                if s.place >= 0 and kind[i] in ("article", "main") and s.mass:
                    own = tuple(m for m in s.marks if m >> 1 in way and m >> 1 <= i)
                    if i not in around or len(own) < len(around[i]):
                        around[i] = own
        if around:
            least = min(map(len, around.values()))
            # An article that is itself marked isn't the page's own.
            void = {m >> 1 for i, own in around.items() if len(own) == least for m in own if m >> 1 != i}
        else:
            total = sum(raw)
            under: Counter[int] = Counter()
            for s in slots:
                under.update({m >> 1: s.mass for m in s.marks if m & 1})
            void = {p for p, mass in under.items() if 2 * mass > total}

    def weight(s: Slot) -> float:
        return s.mass * MARKED ** sum(m >> 1 not in void for m in s.marks) if semantic else s.mass

    mass = [0.0] * len(nodes)
    for s in slots:
        if s.place >= 0:
            mass[s.place] += weight(s)
    for i in range(len(nodes) - 1, 0, -1):
        # Preorder: a node's children come behind it.
        if semantic and kind[i] in ("article", "main"):
            mass[i] *= ARTICLE
        elif semantic and "." in nodes[i].label and words_of(nodes[i].label.split(".")[1]) & CONTENT_WORDS:
            mass[i] *= NAMED
        mass[parent[i]] += mass[i]

    dominant = DOMINANT if max((s.pages for s in slots), default=0) >= CONSTANT_PAGES else DOMINANT_FEW
    at = 0
    while not (semantic and kind[at] == "article"):
        inner = [number[id(c)] for c in nodes[at].children]
        best = max(inner, key=lambda i: mass[i], default=None)
        # A node without block children is a paragraph or the like, not a container.
        if best is None or not mass[best] or mass[best] < dominant * mass[at]:
            break
        if kind[best] not in ("article", "main") and not any(kind[number[id(c)]] in BLOCK for c in nodes[best].children):
            break
        if semantic and kind[at] == "main" and kind[best] != "article":
            break
        at = best
    texts, pages = Counter(), Counter()
    for s in slots:
        if not (semantic and any(m >> 1 not in void for m in s.marks)):
            texts[s.place] += s.texts
            pages[s.place] = max(pages[s.place], s.pages)
    heads = [i for i, k in enumerate(kind) if k == "h1"]
    titles = [i for i in heads if not at <= i < end[at] and 2 * texts[i] >= pages[i] > 0]
    inside = [s for s in slots if at <= s.place < end[at] and kind[s.place] != "h1" and not any(at < m >> 1 < end[at] and m >> 1 not in void for m in s.marks)]
    constant = sum(s.constant for s in inside)
    return Region(at, end[at], sorted(void), titles, heads, kind[at] in ("html", "body"), 2 * constant <= sum(s.volume for s in inside))


# --- stages ----------------------------------------------------------------------------------------------------
BLOCKS = pa.list_(pa.struct([("node", pa.int32()), ("linked", pa.int32()), ("marks", pa.list_(pa.int32())), ("text", pa.string())]))
PARSED = "page_id long, url string, host string, skeleton string, blocks array<struct<node:int,linked:int,marks:array<int>,text:string>>"


def blocks_of(page: Page) -> list[dict]:
    number = {id(n): i for i, n in enumerate(preorder(page.root))}
    return [{"node": number[id(n)], "linked": linked, "marks": [2 * number[id(m)] + soft for m, soft in marks], "text": text} for n, text, linked, marks in page.blocks]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, skeleton, blocks in page order."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [Page(source or "") for source in part.column("html").to_pylist()]
            columns = [pa.array([written(p.root) for p in found], pa.string()), pa.array([blocks_of(p) for p in found], BLOCKS)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), *columns], ["page_id", "url", "host", "skeleton", "blocks"])

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))).alias("host")
    return mapped(pages.select(F.col("page_id").cast("long"), "url", host, "html"), made, PARSED)


def host_templates(shapes: DataFrame) -> DataFrame:
    """host, template from the distinct (host, skeleton), by rounds: at most about ALIGNED of a host meet in a task."""

    def aligned(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "skeleton": [template_of(part["skeleton"].tolist())]})

    level = shapes
    while True:
        sizes = level.groupBy("host").agg(F.ceil(F.count("*") / ALIGNED).alias("groups"))
        grouped = level.join(sizes, "host").withColumn("group", F.pmod(F.xxhash64("skeleton"), "groups")).groupBy("host", "group")
        level = stored(grouped.applyInPandas(aligned, "host string, skeleton string"), "wrapper-templates")
        if level.groupBy("host").count().where("count > 1").isEmpty():
            return level.withColumnRenamed("skeleton", "template")


def node_slots(sited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per host, node and marks the numbers of a Slot; and the host's constant blocks (host, place, hash).

    `sited`: host and its pages' held blocks (place, marks, hash, chars, free). Equal pages count once.
    """
    seen = sited.select("host", F.xxhash64(F.transform("held", lambda b: b["hash"])).alias("page"), "held").distinct()
    on_pages = seen.select("host", F.explode(F.array_distinct(F.transform("held", lambda b: b["place"]))).alias("place")).groupBy("host", "place").agg(F.count("*").alias("pages"))
    each = seen.select("host", F.explode(F.array_distinct("held")).alias("b")).select("host", "b.*")
    per_text = each.groupBy("host", "place", "marks", "hash").agg(F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("free").alias("free"))
    # One row per host and node, and few of them: no host's blocks meet in one task.
    told = per_text.join(checked_broadcast(stored(on_pages, "wrapper-nodes"), SMALL_ROWS), ["host", "place"])
    common = told.withColumn("same", F.col("n") >= F.greatest(F.lit(CONSTANT_PAGES), CONSTANT_SHARE * F.col("pages")))
    own = lambda c: F.when(F.col("same"), F.col(c))
    per_node = common.groupBy("host", "place", "marks").agg(
        F.sum("free").alias("mass"), F.count("*").alias("texts"), F.max("pages").alias("pages"), F.sum(F.col("chars") * F.col("n")).alias("volume"),
        F.coalesce(F.sum(own("chars") * F.col("n")), F.lit(0)).alias("constant"), F.collect_set(own("hash")).alias("hashes"), F.sum("n").alias("_all"), F.coalesce(F.sum(own("n")), F.lit(0)).alias("_same"),
    )
    # A node whose blocks vary is a slot: a passage that many articles share stays.
    fixed = (F.col("_same") > 0) & (F.col("_same") >= CONSTANT_SHARE * F.col("_all"))
    nodes = stored(per_node.withColumns({"constant": F.when(fixed, F.col("constant")).otherwise(0), "hashes": F.when(fixed, F.col("hashes")).otherwise(F.array().cast("array<long>"))}).drop("_all", "_same"), "wrapper-slots")
    return nodes.drop("hashes"), nodes.where(F.size("hashes") > 0).select("host", "place", F.explode("hashes").alias("hash"))


REGION = "host string, lo int, hi int, void array<int>, titles array<int>, heads array<int>, whole boolean, drops_constant boolean"


def host_regions(templates: DataFrame, slots: DataFrame, semantic: bool = True) -> DataFrame:
    """One row per host: its Region. A task gets a host's template and slots, which don't grow with its pages."""

    def chosen(key: tuple, template: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        some = [Slot(r.place, tuple(r.marks), r.mass, r.texts, r.pages, r.volume, r.constant) for r in held.itertuples(index=False)]
        return pd.DataFrame([{"host": key[0], **region_of(template["template"].iloc[0], some, semantic).__dict__}])

    return templates.groupBy("host").cogroup(slots.groupBy("host")).applyInPandas(chosen, REGION)


def content(b: Column) -> Column:
    """Whether a placed block is content, by its host's region."""
    place, lo, hi = b["place"], F.col("lo"), F.col("hi")
    inside = ((place >= lo) & (place < hi)) | F.array_contains("titles", place)
    off = F.exists(b["marks"], lambda m: (F.shiftright(m, 1) > lo) & (F.shiftright(m, 1) < hi) & ~F.array_contains("void", F.shiftright(m, 1)))
    constant = F.col("drops_constant") & F.coalesce(F.array_contains("constant", F.struct(place.alias("place"), b["hash"].alias("hash"))), F.lit(False)) & ~F.array_contains("heads", place)
    return inside & ~off & ~constant & ~(F.col("whole") & linky(b))


def linky(b: Column) -> Column:
    return 2 * b["linked"] > b["chars"]


def main_texts(pages: DataFrame, semantic: bool = True, templates: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html).

    A null or empty html has the empty text, a null url an empty host; repeated rows each get theirs; an empty table
    gives an empty result; further columns are left out, whatever their names; pages of any length are read whole, in
    linear time. Blocks are joined by line ends in page order; none is cut. A page that has nothing where its host's
    content is keeps its unmarked blocks that aren't mostly links. No page leaves its task but as narrow rows for the
    counts: hosts of any size are counted by partial aggregation.

    Without `semantic` tags, roles and class words don't count; without `templates` every page is a host of its own.
    """
    done = stored(parsed(pages), "wrapper-pages", "zstd")
    if not templates:
        done = done.withColumn("host", F.concat_ws("/", "host", F.col("page_id").cast("string")))
    shapes = stored(done.select("host", "skeleton").distinct(), "wrapper-shapes")
    whole = host_templates(shapes)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [places(t, s) for t, s in zip(part.column("template").to_pylist(), part.column("skeleton").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("host"), part.column("skeleton"), pa.array(found, pa.list_(pa.int32()))], ["_host", "_skeleton", "places"])

    where = stored(mapped(shapes.join(whole, "host").select("host", "skeleton", "template"), placed, "_host string, _skeleton string, places array<int>"), "wrapper-places")
    on = (F.col("host") == F.col("_host")) & (F.col("skeleton") == F.col("_skeleton"))
    marks = lambda b: F.transform(b["marks"], lambda m: F.get("places", F.shiftright(m, 1)) * 2 + m % 2)
    chars, linked = lambda b: F.length(b["text"]), lambda b: b["linked"]
    block = lambda b: F.struct(
        F.get("places", b["node"]).alias("place"), marks(b).alias("marks"), F.xxhash64(b["text"]).alias("hash"), chars(b).alias("chars"), F.greatest(F.lit(0), chars(b) - linked(b)).alias("free")
    )
    sited = done.join(checked_broadcast(where, SMALL_ROWS), on)
    slots, fixed = node_slots(sited.select("host", F.transform("blocks", block).alias("held")))
    by_host = fixed.groupBy("host").agg(F.collect_set(F.struct("place", "hash")).alias("constant"))
    regions = stored(host_regions(whole, slots, semantic).join(by_host, "host", "left").withColumnRenamed("host", "_region"), "wrapper-regions")

    judged = sited.join(checked_broadcast(regions, SMALL_ROWS), F.col("host") == F.col("_region"), "left")
    full = F.transform("blocks", lambda b: F.struct(F.get("places", b["node"]).alias("place"), marks(b).alias("marks"), F.xxhash64(b["text"]).alias("hash"), chars(b).alias("chars"), linked(b).alias("linked"), b["text"].alias("text")))
    there = F.exists("_blocks", lambda b: (b["place"] >= F.col("lo")) & (b["place"] < F.col("hi")))
    kept = F.when(there, F.filter("_blocks", content)).otherwise(F.filter("_blocks", lambda b: (F.size(b["marks"]) == 0) & ~linky(b)))
    text = F.coalesce(F.array_join(F.transform(kept, lambda b: b["text"]), "\n"), F.lit(""))
    return judged.withColumn("_blocks", full).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
