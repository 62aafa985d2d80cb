"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: pages share a style node if tag and classes agree all the
way up (elements deeper than ``DEEPEST`` belong to their ancestor there). A node's importance joins two entropies over
the host's pages: how varied its presentation is (which children it shows) and how varied the content below it is (a text on every page
tells nothing, one on a single page tells most). Branches of low importance go from each page, outside and inside
its main element. Inside one, where a false verdict costs real text, a node must be on half of the host's pages, say next to nothing, and be
no heading. Equal pages of a host count once. Tag, role and names of an element are a prior: branches that say they are menus, footers,
adverts, forms or reader comments go as well, as a host with few pages has no entropy; inside an article only whole names tell.

Counts are summed in tasks first, so a host with a third of all pages is no single task. The pages stay where they are: the low nodes
of all hosts go to every task if there are at most ``SENT_NODES``; beyond that pages and nodes meet by host and a salt.

Defined results: a null or empty page has an empty text; a null url belongs to a host of its own;
repeated rows are extracted each; broken markup is read as far as it goes, however deep; an empty table gives an
empty result; other columns are kept by ``extract_pages``.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetframe.llm.texts import slices
from onsetframe.session import checkpointed

LEAST_IMPORTANCE = 0.35
LEAST_PAGES = 4  # pages of a host that show a node before it is judged
INNER_IMPORTANCE, INNER_PAGES, INNER_SHARE = 0.1, 8, 0.5  # the same inside a main element, and the share of the host's pages
DEEPEST = 32
SENT_NODES = 1_000_000
SALTS = 64
DAMPING = 0.9
HOST, LOW, SALT = "__host", "__low", "__salt"  # names that no column of the pages has

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
# an opening tag ends an open element of the second group, looked for up to the third
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
NEVER = frozenset(
    "head nav aside form script style template noscript iframe svg button select input textarea object canvas audio video dialog "
    "menu title math".split()
)
OUTER = frozenset("header footer".split())  # of the page; an article's own header is part of it
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# words in class or id that say what a branch is
TELLING = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar widget widgets cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended comments comment commentlist respond disqus replies reply".split()
)
TELLING_OUTER = frozenset("header masthead footer banner topbar alert search".split())
# whole classes or ids that say so inside an article, where a word of a longer name may be about the text
TELLING_INSIDE = frozenset(
    "ad ads advert advertisement sponsored promo nav navigation menu breadcrumb breadcrumbs sidebar widget cookie-notice popup modal "
    "newsletter newsletter-signup share sharing share-buttons social social-share social-buttons related related-posts "
    "related-articles recommended comment comments comment-list commentlist comments-section respond replies".split()
)
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Node:
    tag: str
    names: frozenset = frozenset()  # words of class and id
    whole: frozenset = frozenset()  # classes and id as they are
    look: str = ""  # tag and classes: what makes two nodes of a host the same
    attributes: dict = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and text


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(raw)}


def make(tag: str, raw: str) -> Node:
    if not raw or raw.isspace():
        return Node(tag, look=tag)
    a = attributes(raw)
    classes = a.get("class", "").split()
    named = " ".join([*classes, a.get("id", "")]).lower()
    words = re.split(r"[^a-z0-9]+", named)
    return Node(tag, frozenset(w for w in words if w), frozenset(named.split()), ".".join([tag, *sorted(set(classes))]), a)


def parse(page: str) -> Node:
    """The page as a tree; end tags that may be left out are supplied."""
    root = Node("root", look="root")
    stack, at = Open(root), 0
    while True:
        m = MARKUP.search(page, at)
        if m is None:
            stack.top.children.append(html.unescape(page[at:]))
            return root
        if m.start() > at:
            stack.top.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            stack.close(tag)
            continue
        if tag in BLOCK:
            stack.end({"p"}, {"table", "button", "td", "th"})
        if tag in ENDS:
            stack.end(*ENDS[tag])
        node = make(tag, m[3])
        stack.top.children.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.push(node)


class Open:
    """The open elements. Their number by tag spares the search for one that isn't open."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.count: Counter = Counter()

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.count[node.tag] += 1

    def _cut(self, at: int) -> None:
        self.count.subtract(n.tag for n in self.nodes[at:])
        del self.nodes[at:]

    def end(self, ended: set, within: set) -> None:
        """End the innermost element of ``ended`` unless one of ``within`` is further in."""
        if any(self.count[t] > 0 for t in ended):
            for i in range(len(self.nodes) - 1, 0, -1):
                if self.nodes[i].tag in ended:
                    return self._cut(i)
                if self.nodes[i].tag in within:
                    return None
        return None

    def close(self, tag: str) -> None:
        if self.count[tag] > 0:
            for i in range(len(self.nodes) - 1, 0, -1):
                if self.nodes[i].tag == tag:
                    return self._cut(i)
                if tag not in BLOCK and self.nodes[i].tag in BLOCK:
                    return None  # the end tag of an inline element closes no block
        return None


def told(node: Node, inside: bool) -> bool:
    """Whether tag, role or names say that the branch is no main text."""
    if node.tag in NEVER or (not inside and node.tag in OUTER):
        return True
    a = node.attributes
    if not a:
        return False
    if node.tag in ("html", "body"):
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return True
    if inside:
        return bool(node.whole & TELLING_INSIDE)
    return bool(node.names & TELLING) or bool(node.names & TELLING_OUTER)


@dataclass
class Place:
    """A node of a page on its way down: its style node, depth, and whether a main element is above."""

    node: Node
    path: int = 0
    depth: int = 0
    inside: bool = False

    def below(self, child: Node) -> Place:
        """Inline elements, and what is deeper than ``DEEPEST``, belong to the style node above."""
        path = self.path
        if child.tag in BLOCK and self.depth < DEEPEST:
            path = step(path, child)
        return Place(child, path, self.depth + 1, self.inside or is_main(child))

    @property
    def style(self) -> int:
        """Number of the style node; odd inside a main element."""
        return self.path << 1 | self.inside


def is_main(node: Node) -> bool:
    return node.tag in MAIN or node.attributes.get("role", "").lower() == "main"


def step(path: int, node: Node) -> int:
    """The style node of a child."""
    return xxhash.xxh3_64_intdigest(node.look.encode("utf-8", "surrogatepass"), seed=path) >> 2


def mains(root: Node) -> list[Place]:
    """The topmost article or main elements that aren't part of something else, in page order."""
    out, todo = [], [Place(root)]
    while todo:
        place = todo.pop()
        if place.inside:
            out.append(place)
            continue
        elements = [c for c in place.node.children if isinstance(c, Node)]
        todo += [place.below(c) for c in reversed(elements) if not told(c, False)]
    return out


def squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def blocks(top: Place, low: Callable[[int], bool]) -> list[str]:
    """The text blocks of a branch without the branches that tell or have a low style node."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        out.append(squeezed(run))
        run.clear()

    stack = [(top, iter(top.node.children))]
    while stack:
        place, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if place.node.tag in BLOCK:
                flush()
        elif isinstance(child, str):
            run.append(child)
        elif child.tag == "br":
            run.append(" ")
        else:
            if child.tag in BLOCK:
                flush()  # also where a branch is left out
            if not told(child, place.inside):
                below = place.below(child)
                judged = below.path != place.path and child.tag not in ("html", "body") and not (below.inside and child.tag in HEADINGS)
                if not (judged and not is_main(child) and low(below.style)):
                    stack.append((below, iter(child.children)))
    flush()
    return [x for x in out if x]


def main_text(page: str, low: Callable[[int], bool] = lambda style: False) -> str:
    """The blocks of the main text, one on a line.

    A page of which nothing would be left is read without the low nodes.
    """
    root = parse(page)
    chosen = mains(root) or [Place(root)]
    for judge in (low, lambda style: False):
        found = [x for top in chosen for x in blocks(top, judge)]
        if found:
            return "\n".join(found)
    return ""


def style_features(page: str) -> Iterator[tuple[int, int, int]]:
    """``(style, kind, feature)`` of a page, each once.

    Kind 0 is the presentation (the children's looks), kind 1 a text below the node.
    """
    shown: dict[int, set] = {}
    texts: set[tuple[int, int]] = set()
    run: list[str] = []
    above: list[int] = []  # style nodes from the top, at most DEEPEST

    def flush() -> None:
        text = squeezed(run)
        run.clear()
        if text:
            feature = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
            texts.update((a, feature) for a in above)

    top = Place(parse(page))
    shown[top.style] = set()
    stack = [(top, iter(top.node.children), False)]
    while stack:
        place, rest, own = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if own:
                flush()
                above.pop()
        elif isinstance(child, str):
            run.append(child)
        elif child.tag not in RAW:
            below = place.below(child)
            new = below.path != place.path
            if new:
                flush()
                shown[place.style].add(child.look)
                shown.setdefault(below.style, set())
                above.append(below.style)
            stack.append((below, iter(child.children), new))
    flush()
    for style, looks in shown.items():
        yield style, 0, xxhash.xxh3_64_intdigest("|".join(sorted(looks)).encode("utf-8", "surrogatepass")) >> 1
    for style, feature in texts:
        yield style, 1, feature


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.col("url"), r"^[^:/?#]*:?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.withColumn(HOST, F.coalesce(host, F.lit("")))


def importance(pages: DataFrame) -> DataFrame:
    """``host, node, pages, importance`` of every style node; ``pages`` counts unlike pages."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            rows = [(host, page or "") for host, page in zip(part.column(HOST).to_pylist(), part.column("html").to_pylist())]
            found = [list(zip(*style_features(page))) for _, page in rows]
            marks = [xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass")) >> 1 for _, page in rows]
            lists = [pa.array([list(f[i]) for f in found], pa.list_(pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in rows], pa.string()), pa.array(marks, pa.int64()), *lists], ["host", "mark", "node", "kind", "feature"]
            )

    listed = with_host(pages).select(HOST, "html").mapInArrow(
        features, "host string, mark long, node array<long>, kind array<long>, feature array<long>"
    )
    unlike = listed.dropDuplicates(["host", "mark"])
    each = unlike.select("host", F.inline(F.arrays_zip("node", "kind", "feature")))
    summed = each.groupBy("host", "node", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    n_log_n = F.col("n") * F.log("n")
    shown, told_by = F.col("kind") == 0, F.col("kind") == 1
    nodes = summed.groupBy("host", "node").agg(
        F.sum(F.when(shown, F.col("n"))).alias("pages"),
        F.sum(F.when(shown, n_log_n)).alias("styles"),
        F.sum(F.when(told_by, F.col("n"))).alias("texts"),
        F.sum(F.when(told_by, n_log_n)).alias("shared"),
        F.count(F.when(shown, 1)).alias("looks"),
    )
    many = F.log("pages")
    # entropy of the presentation over the pages, and one minus the mean entropy of a text over them
    look = 1 - F.col("styles") / (F.col("pages") * many)
    content = F.when(F.col("texts") > 0, 1 - F.least(F.col("shared") / (F.col("texts") * many), F.lit(1.0))).otherwise(0.0)
    weight = F.pow(F.lit(DAMPING), F.col("looks") - 1)
    value = F.when(F.col("pages") > 1, (1 - weight) * look + weight * content).otherwise(1.0)
    return nodes.select("host", "node", "pages", value.alias("importance"))


def low_nodes(pages: DataFrame) -> DataFrame:
    """``host, node`` of the branches that go (kept)."""
    judged = checkpointed(importance(pages))
    # every page of a host shows its root
    roots = judged.where(F.col("node") == 0).select("host", F.col("pages").alias("whole"))
    inner = F.col("node") % 2 == 1
    outside = ~inner & (F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE)
    often = (F.col("pages") >= INNER_PAGES) & (F.col("pages") >= INNER_SHARE * F.col("whole"))
    return checkpointed(judged.join(roots, "host").where(outside | (inner & often & (F.col("importance") < INNER_IMPORTANCE))).select("host", "node"))


def _extractor(kept: list[str], nodes_of: Callable[[pa.RecordBatch], list]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [
                main_text(page or "", nodes.__contains__) for page, nodes in zip(part.column("html").to_pylist(), nodes_of(part))
            ]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*kept, "text", "n_chars"],
            )

    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """The pages' own columns but ``html``, with ``text`` and ``n_chars``."""
    low = low_nodes(pages)
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    named = with_host(pages.select(*kept, "html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema) + ", text string, n_chars long"
    if low.count() <= SENT_NODES:
        sent: dict[str, set] = {}
        for host, node in low.collect():
            sent.setdefault(host, set()).add(node)
        none: frozenset = frozenset()
        return named.mapInArrow(_extractor(kept, lambda part: [sent.get(h, none) for h in part.column(HOST).to_pylist()]), schema)
    # a host's pages are dealt over the salts, its nodes go to each of them
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    nodes = low.groupBy("host").agg(F.collect_list("node").alias(LOW)).select(F.col("host").alias(HOST), LOW, salts.alias(SALT))
    salted = named.withColumn(SALT, F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
    joined = salted.join(nodes, [HOST, SALT], "left").select(*kept, "html", LOW)
    return joined.mapInArrow(_extractor(kept, lambda part: [frozenset(x or ()) for x in part.column(LOW).to_pylist()]), schema)


def op9_site_style_tree(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
