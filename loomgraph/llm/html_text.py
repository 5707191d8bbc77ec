"""Main text of web pages by site style trees.

Pages of one host are merged into a tree of style nodes: a node is the path of element names and class or id
tokens from the root. Its content features are all segments of its blocks (text between sentence ends and the
like), its presentation features the sequences of its children's names. A
feature on c of a host's m pages has entropy ``log c / log(m + UNLIKE)``: 0 if one page has it, near 1 if
every page has it; ``UNLIKE`` stands for pages with nothing in common, so that few pages prove little. A node's
importance is one minus the mean entropy of its features over their occurrences; that of a node with text is
``OWN`` parts its content's and the rest its parent's presentation's. The pages of all hosts together are a tree
too, which shows what hosts share (their templates, and adverts that each host has only once). Blocks whose style
node is unimportant in either tree are removed from each page, inside articles as well; a branch all of whose
blocks go is gone.

A page counts in c and m as far as its features are its own, that is on no other page: what repeats shows a template
only where the rest differs. Copies and near copies, be they a third of the crawl, hardly count, and equal pages are one.

Hosts and crawls too small to show repetition need more. What HTML itself defines as outside the text (head,
script, style, nav, header outside an article, footer, aside and the like) goes in any case. Class names, roles and
forms are notes: a noted branch goes unless it holds the page's article or main element, or more than half of
its text (of the page's, if it has no such element).

No host's pages are ever gathered in one task. What comes back to the pages is one row per host with its unimportant
style nodes, whose number depends on the host's templates, not on its pages.

Defined results: a null or empty html has the text ""; a null url belongs to the host ""; character
references are decoded, white space within a block becomes one blank, blocks are joined by one line feed;
broken and cut markup is read as far as it goes, in time proportional to its length; repeated rows get equal results
and count as one page; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise, tidy

#: Style nodes of at most this importance are removed.
UNIMPORTANT = 0.6
#: Pages without anything in common that each tree has beside its own.
UNLIKE = 8
#: The part of a text node's importance that its own content makes up.
OWN = 0.9
#: Pages that a task remembers.
MAX_SEEN = 150_000
#: Stands for a path where all pages of a host are meant; no path is negative.
WHOLE = -1
#: Where a block's text is cut into segments; white space left before a mark is stripped.
SEGMENT = re.compile(r"[.!?;:|\u00b7\u2022\u2013\u2014]+\s+")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
#: Fixed values of HTML: elements without content, elements whose content is no markup, and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split()
)
OUTSIDE = frozenset("head script style noscript template iframe object embed applet svg math canvas audio video nav footer aside button select option textarea input dialog menu title frameset noframes datalist".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody"}, "tbody": {"thead", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|sidebars?|side-?bar|nav|navbar|navigation|menus?|breadcrumbs?|footer|masthead|site-?header|page-?header|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|comments?|commentlist|respond|reply|replies|disqus|pagination|pager|widgets?|toolbar|skip|hidden|copyright|legal|login|search)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())


class Node:
    """An element; ``outside`` by HTML's definition, ``noted`` by its class, role or element; ``size`` is the text under it."""

    __slots__ = ("tag", "path", "parent", "outside", "noted", "inside", "children", "size", "holds")

    def __init__(self, tag: str, path: int, parent: Node | None, outside: bool, noted: bool, inside: bool):
        self.tag, self.path, self.parent, self.outside, self.noted, self.inside, self.children, self.size, self.holds = tag, path, parent, outside, noted, inside, [], 0, False


@lru_cache(10_000)
def style(attributes: str) -> tuple[str, bool]:
    """Class and id tokens (digits dropped), and whether they mark noise."""
    if not attributes or attributes.isspace():
        return "", False
    names, noise = [], False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            names.append(re.sub(r"\d+", "", value).strip())
            noise = noise or NOISE.search(value) is not None
        elif key == "role":
            noise = noise or value.strip().lower() in ROLES
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            noise = True
    return " ".join(filter(None, names)), noise


def blocks(source: str | None) -> tuple[list[tuple[str, Node]], list[Node]]:
    """The page's blocks (text, style node), and all its element nodes, in page order."""
    source = source or ""
    root = Node("", 0, None, False, False, False)
    stack, nodes, out, text = [root], [root], [], []
    opened: dict[str, int] = defaultdict(int)  # elements on the stack by name
    owner = root

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if joined:
                out.append((joined, owner))

    def push(tag: str, attributes: str) -> None:
        nonlocal owner
        flush()
        above = stack[-1]
        names, noise = style(attributes)
        noted = (noise or tag == "form") and tag not in ("html", "body")
        article = tag in ("article", "main")
        outside = above.outside or tag in OUTSIDE or (tag == "header" and not above.inside)
        path = xxhash.xxh64_intdigest(f"{tag}.{names}", seed=above.path & 0xFFFFFFFFFFFFFFFF) >> 1
        node = Node(tag, path, above, outside, noted, above.inside or (article and not noted))
        node.holds = article and not noted and not outside
        above.children.append(tag)
        opened[tag] += 1
        stack.append(node)
        nodes.append(node)
        owner = node

    def pop_to(depth: int) -> None:
        nonlocal owner
        flush()
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]
        owner = stack[-1]

    at, end = 0, len(source)
    while at < end:
        m = TOKEN.search(source, at)
        if m is None:
            cut = source.find("<", at)
            rest = source[at:] if cut < 0 or not re.match(r"</?[a-zA-Z!?]", source[cut : cut + 3]) else source[at:cut]
            text.append(rest)
            break
        text.append(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE or not opened[tag]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
            continue
        if tag == "br" or tag == "hr":
            flush()
            continue
        if tag in INLINE or tag in VOID:
            continue
        if tag in RAW:
            closing = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at) if not m[3].rstrip().endswith("/") or tag not in ("svg", "math") else None
            if closing is None:
                at = end if tag in ("script", "style", "title", "textarea", "noscript", "xmp", "iframe", "noembed", "noframes") else at
            else:
                closed = source.find(">", closing.end())
                at = end if closed < 0 else closed + 1
            flush()
            continue
        if tag in CLOSES_P and opened["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    pop_to(depth)
                    break
                if stack[depth].tag in ("table", "td", "button", "article", "div"):
                    break
        if tag in SAME and any(opened[x] for x in SAME[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in SAME[tag]:
                    pop_to(depth)
                    if tag != "tr":
                        break
                elif stack[depth].tag in SCOPE[tag]:
                    break
        push(tag, m[3])
        if m[3].rstrip().endswith("/") and tag in ("svg", "math", "path"):
            pop_to(len(stack) - 1)
    flush()
    return out, nodes


def segments(text: str) -> list[str]:
    """The distinct segments of a block, in order."""
    return list(dict.fromkeys(x for p in SEGMENT.split(text) if (x := p.strip())))


def number(text: str | bytes) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def features(source: str | None) -> tuple[int, set[tuple[int, int, int, bool]]]:
    """The page's number, and its distinct (style node, parent, feature, is content)."""
    found, nodes = blocks(source)
    content = {(n.path, n.parent.path if n.parent else 0, number(x), True) for t, n in found for x in segments(t)}
    textful = {n.path for _, n in found}
    shape = {(n.path, 0, number(" ".join(n.children)), False) for n in nodes if n.children and n.path not in textful}
    return number("\n".join(f"{n.path} {t}" for t, n in found)), content | shape


def marked(found: list[tuple[str, Node]], nodes: list[Node]) -> set[Node]:
    """Elements that go whatever the trees say: those outside the text, and those noted, unless they hold what the page is about."""
    for t, n in found:
        if not n.outside:
            n.size += len(t)
    for n in reversed(nodes):  # children come after their parents
        if n.parent is not None:
            n.parent.size += n.size
            n.parent.holds |= n.holds
    articles = nodes[0].holds
    whole = sum(n.size for n in nodes if n.tag in ("article", "main") and n.inside and not n.parent.inside and not n.outside) if articles else nodes[0].size
    gone: set[Node] = set()
    for n in nodes[1:]:
        noted = n.noted and not n.holds and not ((n.inside or not articles) and 2 * n.size > whole)
        if n.parent in gone or n.outside or noted:
            gone.add(n)
    return gone


def extract(source: str | None, removed: frozenset[int], marks: bool = True) -> str:
    """The page's text without blocks of a removed style node and, with ``marks``, without marked branches."""
    found, nodes = blocks(source)
    gone = marked(found, nodes) if marks else set()
    return "\n".join(t for t, n in found if n.path not in removed and n not in gone)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


class Seen(set):
    """Pages met in a task; starts anew when full, so that some may be met again."""

    def first(self, page: tuple) -> bool:
        if page in self:
            return False
        if len(self) >= MAX_SEEN:
            self.clear()
        self.add(page)
        return True


def packed(found: set[tuple[int, int, int, bool]]) -> bytes:
    """Features in order, a column (path, parent, feature, content) after the other."""
    return np.array(sorted(found), np.int64).reshape(-1, 4).T.tobytes()


def unpacked(nodes: bytes) -> np.ndarray:
    return np.frombuffer(nodes, np.int64).reshape(4, -1)


def read_once(b: pa.RecordBatch, seen: Seen) -> Iterator[tuple[int, int, bytes]]:
    """(host, page, packed features) of the pages that the task has not met, so that copies are not sent on."""
    for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
        page, found = features(source)
        nodes = packed(found)
        if seen.first((host, page, number(nodes))):
            yield host, page, nodes


def novelty(pages: DataFrame) -> DataFrame:
    """(page, new): the share of a page's content that no other page has; pages without any are left out. From rows (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in batches:
            hosts, numbers, sizes, contents = [], [], [], []
            for host, page, nodes in read_once(b, seen):
                x = unpacked(nodes)
                contents.append(np.unique(x[2][x[3] == 1]))
                hosts.append(host)
                numbers.append(page)
                sizes.append(int(x[3].sum()))
            # A row for the page itself, whose host is told, then one for each of its contents.
            each, k = [len(c) for c in contents], len(hosts)
            column = np.concatenate([np.array(numbers, np.int64), *contents])
            of = np.r_[np.array(numbers, np.int64), np.repeat(np.array(numbers, np.int64), each)]
            host = pa.concat_arrays([pa.array(hosts, pa.int64()), pa.nulls(sum(each), pa.int64())])
            n = pa.concat_arrays([pa.array(sizes, pa.int32()), pa.nulls(sum(each), pa.int32())])
            yield pa.RecordBatch.from_arrays([host, pa.array(column), pa.array(of), n], names=["host", "feature", "page", "n"])

    told = pages.select("host", "html").mapInArrow(run, "host long, feature long, page long, n int")
    once = told.groupBy("host", "feature").agg(F.min("page").alias("page"), F.max("page").alias("last"), F.max("n").alias("n")).where("page = last")
    shares = once.groupBy("page").agg(F.count(F.when(F.col("host").isNull(), 1)).alias("k"), F.sum("n").alias("n")).where("k > 0")
    return shares.select("page", F.least(F.col("k") / F.col("n"), F.lit(1.0)).alias("new"))


def weighted(pages: DataFrame, new: DataFrame) -> DataFrame:
    """(host, path, parent, feature, content, c): the sum of ``new`` over the host's pages with a feature; that over all its pages has the path ``WHOLE``.

    Pages are read again rather than their features stored, and move in one row each; the join is a merge join at every size,
    since ``new`` grows with the pages."""

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in batches:
            found = list(zip(*read_once(b, seen))) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.int64(), pa.binary()))], names=["host", "page", "nodes"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([[WHOLE], [0], [0], [0]], np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                # Pages of equal blocks may differ in elements without text: they are one page with the features of all.
                all_ = [np.unique(np.hstack([whole, *map(unpacked, p)]), axis=1) if len(p) > 1 else np.hstack([whole, unpacked(p[0])]) for p in some.column("packs").to_pylist()]
                each, x = [a.shape[1] for a in all_], np.hstack(all_)
                host, c = (np.repeat(some.column(k).to_numpy(), each) for k in ("host", "new"))
                yield pa.RecordBatch.from_arrays([pa.array(host), *map(pa.array, x[:3]), pa.array(x[3] == 1), pa.array(c)], names=["host", "path", "parent", "feature", "content", "new"])

    rows = pages.select("host", "html").mapInArrow(packs, "host long, page long, nodes binary")
    met = rows.join(new.hint("merge"), "page").groupBy("page", "host", "new").agg(F.collect_set("nodes").alias("packs")).select("host", "new", "packs")
    each = met.mapInArrow(opened, "host long, path long, parent long, feature long, content boolean, new double")
    return each.groupBy("host", "path", "parent", "feature", "content").agg(F.sum("new").alias("c"))


def style_tree(per_feature: DataFrame, sizes: DataFrame | float) -> DataFrame:
    """Importance of style nodes with text (host, path, importance), a tree for each host, from (host, path, parent, feature, content, c)
    and the hosts' pages (of, m), or the number of pages if there is one tree."""
    c = F.greatest("c", F.lit(1.0))
    per_node = per_feature.groupBy("host", "path", "parent", "content").agg(F.sum("c").alias("n"), F.sum(F.log(c) * F.col("c")).alias("e"))
    sized = per_node.withColumn("m", F.lit(sizes)) if isinstance(sizes, float) else per_node.join(sizes, F.col("host") == F.col("of"))
    rated = sized.withColumn("own", 1 - F.col("e") / F.col("n") / F.log(F.col("m") + UNLIKE))
    shape = rated.where(~F.col("content")).select(F.col("host").alias("at"), F.col("path").alias("above"), F.col("own").alias("shape"))
    # A node whose parent has text too has no presentation to add.
    text = rated.where("content").join(shape, (F.col("host") == F.col("at")) & (F.col("parent") == F.col("above")), "left")
    return text.select("host", "path", (OWN * F.col("own") + (1 - OWN) * F.coalesce("shape", "own")).alias("importance"))


def unimportant(pages: DataFrame) -> DataFrame:
    """(host, path) of the style nodes that go, from rows (host, html)."""
    new = materialise(novelty(pages), "novelty")
    tidy(pages.sparkSession)
    told = materialise(weighted(pages, new), "by-host")
    tidy(pages.sparkSession)
    by_host, sizes = told.where(F.col("path") != WHOLE), told.where(F.col("path") == WHOLE).select(F.col("host").alias("of"), F.col("c").alias("m"))
    by_all = by_host.groupBy("path", "parent", "feature", "content").agg(F.sum("c").alias("c")).withColumn("host", F.lit(0).cast("long"))
    every = style_tree(by_all, float(new.agg(F.sum("new").alias("m")).first()["m"] or 0))
    low = F.col("importance") <= UNIMPORTANT
    shared = by_host.where("content").select("host", "path").distinct().join(every.where(low).select("path"), "path").select("host", "path")
    out = materialise(style_tree(by_host, sizes).where(low).select("host", "path").unionByName(shared).distinct(), "styles")
    for used in (new, told):
        drop(used)
    tidy(pages.sparkSession)
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", marks: bool = True) -> DataFrame:
    """Per row: page_id, url, text, n_chars. Without ``marks``, the trees alone decide."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(host_of(F.col(url_col))).alias("host"))
    # Written first, so that its true size decides whether it is sent to the pages or they are shuffled to it.
    gone = materialise(unimportant(rows).groupBy(F.col("host").alias("of")).agg(F.sort_array(F.collect_set("path")).alias("removed")), "removed")
    joined = rows.join(gone, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(s, frozenset(r or ()), marks) for s, r in zip(b.column("html").to_pylist(), b.column("removed").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = joined.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
