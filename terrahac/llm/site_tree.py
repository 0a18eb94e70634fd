"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree. A node of it is a place in the pages' layout:
a block element's name, its class, its parent, and its place in the sequence of its parent's
blocks (repeats count once). Two entropies, over the distinct pages of the host, give a
node's importance. Presentation: how much the sequence of blocks within it varies. Content,
for nodes with text of their own: 1 less the mean share log(c) / log(M), where c of the
host's M pages have the same text there, so text of every page counts 0 and text of one page
1. A branch of a page goes if its node and all below it are under the threshold.

What entropy can't see, markup tells. Menus, adverts and footers whose words differ from page
to page are known by element, role and class. A class name or id alone marks neither an article
nor an element with most of the page's text where no article is beside it, nor one that holds
all that the page has of articles and main elements, unless more text is outside what is
marked. Within an article, a class name or id marks boxes only, not paragraphs, headings or list
items, and only if nothing else is named in it (ad-slot, but not share-price). And an article that many pages of a host share
has low entropy, though it must stay: what lies within an article (or main) element counts once
for all copies of it, and branches there go only if at least STEADY pages are known and nearly
all have them.

Tables: (host, node, kind, value) rows are reduced to distinct pages and counted before hosts
meet, so a host may hold any share of the pages; of each host only its unimportant nodes with
text of their own are joined to its pages. The mean share of such a node's texts is over 1 -
THRESHOLD, so its commonest text is on at least M ** (1 - THRESHOLD) pages, and a host has at
most M ** THRESHOLD times a page's blocks of them. Up to SEND_BYTES they are sent to all
tasks, after their size is measured; beyond, a host's pages are dealt by a salt and the
host's nodes repeated for each.

Defined results: null, empty and textless pages give the empty text; a page without host is
of the host ''; repeated rows each get their result; other columns are not read. Text keeps
page order; an element that is never closed ends with the page or the next of its kind. Bytes
that are no UTF-8 are read as U+FFFD. An empty table gives no rows; texts and attributes of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahac.llm.common import column_bytes, ship, small_batches, table

#: A node of less importance is noise.
THRESHOLD = 0.2
#: Elements are nested so deep at most, as in browsers; what lies deeper belongs to the last of them.
DEEP = 256
#: Within articles: at least so many pages, and so little importance.
STEADY, SURE = 20, 0.02
#: Bytes of unimportant nodes up to which all tasks get them all; beyond, pages meet them in a join on host and salt.
SEND_BYTES, SALTS = 32_000_000, 64

# Elements of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(("br", "hr"))
RAW = frozenset("annotation annotation-xml canvas iframe noembed noframes noscript object script select style svg template textarea title video audio xmp".split())
SWALLOWS = frozenset("noembed noframes script style textarea title xmp".split())  # to the page's end where unclosed
NOISE_TAGS = frozenset("aside button dialog footer form menu nav".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ENDS_P = BLOCKS - {"html", "body", "option", "legend", "caption"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": set()}
# Words of class names and ids that mark what is not the article.
NOISE_WORDS = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion recommended related reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())

# Words that class names and ids add to those for a box around what is marked.
BOX_WORDS = frozenset("area bar block bottom box button buttons card container content group holder icons inline inner item items left link links list module outer panel right row section slot strip top unit wrap wrapper zone".split())
#: Elements that hold an article's own text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption b i em strong a q cite code".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class _Tags:
    """Where the tags of a page end. A quote opens a value, of any length, after an equals sign only; one that
    is never closed counts for nothing. What has been scanned is kept, so the work is linear in the page."""

    def __init__(self, html: str):
        self.html = html
        self.last = {q: html.rfind(q) for q in "\"'"}
        self.ends: dict[int, int] = {}
        self.since, self.stop = 0, -1

    def end(self, at: int) -> int:
        """The place after the tag's end, -1 if it has none; at: a place in the tag outside of quotes."""
        html, path = self.html, []
        while (out := self.ends.get(at)) is None:
            path.append(at)
            if not self.since <= at <= self.stop:
                found = _STOP.search(html, at)
                self.since, self.stop = at, found.start() if found else len(html)
            stop = self.stop
            if stop == len(html):
                out = -1
            elif (sign := html[stop]) == ">":
                out = stop + 1
            else:
                before = stop - 1
                while before > at and html[before].isspace():
                    before -= 1
                at = html.find(sign, stop + 1) + 1 if html[before] == "=" and stop < self.last[sign] else stop + 1
                continue
            break
        for x in path:
            self.ends[x] = out
        return out


class Node:
    __slots__ = ("tag", "style", "noise", "root", "parts", "depth", "block", "worded")

    def __init__(self, tag: str, attributes: str, inside: bool):
        self.tag, self.style, self.noise, self.root, self.depth, self.block = tag, "", False, tag in ("article", "main"), 0, tag in BLOCKS
        self.parts: list[Node | str] = []
        words: set[str] = set()
        if attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                value = a or b or c
                if name.lower() not in ("class", "id", "role"):
                    continue
                if name.lower() == "role":
                    self.noise |= value.lower() in NOISE_ROLES
                    self.root |= value.lower() in ("main", "article")
                else:
                    for part in value.split():
                        of = {w.lower() for w in _WORD.findall(part)}
                        if not inside or (tag not in PROSE and of <= NOISE_WORDS | BOX_WORDS):
                            words |= of
                    if name.lower() == "class":
                        self.style = value
        self.noise |= tag in NOISE_TAGS or (not inside and tag == "header")
        #: Marked by a class name or id only.
        self.worded = not self.noise and tag not in ("html", "body", "main", "article") and (not words.isdisjoint(NOISE_WORDS) or (not inside and "header" in words))
        self.noise |= self.worded


def _unmark(top: Node) -> None:
    """Takes the mark from elements that class names and ids alone mark, though they hold the page's text."""
    sizes: dict[int, tuple[int, int]] = {}

    def size(node: Node) -> tuple[int, int]:
        n, roots = 0, int(node.root)
        for p in node.parts:
            if p.__class__ is str:
                n += len("".join(p.split()))
            elif not p.noise or p.worded:
                more = size(p)
                n, roots = n + more[0], roots + more[1]
        sizes[id(node)] = n, roots
        return n, roots

    total, roots = size(top)
    marked: list[list[Node]] = []
    outside = 0

    def visit(node: Node, path: list[Node], above: int) -> None:
        nonlocal outside
        if node.noise and node.worded:
            n, within = sizes[id(node)]
            if 2 * n > total and above + within == roots:
                node.noise = False
            else:
                path = [*path, node]
        if node.root:
            marked.append(path)
        for p in node.parts:
            if p.__class__ is str:
                outside += 0 if path else len("".join(p.split()))
            elif not p.noise or p.worded:
                visit(p, path, above + node.root)

    visit(top, [], 0)
    if marked and all(marked):
        least = min(map(len, marked))
        for path in marked:
            if len(path) == least and sizes[id(path[0])][0] >= outside:
                for node in path:
                    node.noise = False


def parse(html: str) -> Node:
    """The blocks of a page. Inline elements are left out, their text is their block's."""
    top = Node("html", "", False)
    stack, at, inside = [top], 0, 0
    over: dict[str, int] = {}
    unclosed: set[str] = set()
    worded = False
    tags = _Tags(html)
    match = _TOKEN.search(html)
    while match:
        start, stop = match.span()
        close, tag = match.groups()
        attributes = ""
        if tag:
            end = tags.end(stop)
            if end < 0:  # no tag, but text
                match = _TOKEN.search(html, stop)
                continue
            attributes, stop = html[stop : end - 1], end
        if start > at:
            stack[-1].parts.append(html[at:start])
        at = stop
        if tag:
            tag = tag.lower()
            if tag in RAW:
                if not attributes.endswith("/") and tag not in unclosed:
                    end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(html, stop)
                    if end:
                        at = end.start()
                    elif tag in SWALLOWS:
                        at = len(html)
                    else:
                        unclosed.add(tag)
                if tag not in ("script", "style", "title"):
                    stack[-1].parts.append(" ")
            elif tag in VOID:
                if tag in BREAKS:
                    stack[-1].parts.append(" ")
            elif tag not in ("html", "head", "body"):
                if tag in ENDS_P:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == "p":
                            inside -= sum(n.root for n in stack[i:])
                            del stack[i:]
                            break
                        if stack[i].block and stack[i].tag not in ("p",):
                            break
                if tag in SAME:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in SAME[tag]:
                            inside -= sum(n.root for n in stack[i:])
                            del stack[i:]
                            break
                        if stack[i].tag in HOLDS[tag] or stack[i].root:
                            break
                block = tag in BLOCKS
                node = Node(tag, attributes, inside > 0) if block or attributes else None
                worded = worded or (node is not None and node.worded)
                if node is not None and (block or node.noise or node.root):
                    if len(stack) > DEEP:
                        over[tag] = over.get(tag, 0) + 1
                        stack[-1].parts.append(" ")
                    else:
                        stack[-1].parts.append(node)
                    if len(stack) <= DEEP and not attributes.endswith("/"):
                        stack.append(node)
                        inside += node.root
                else:
                    for n in stack:  # a plain element within a marked inline one of the same name
                        if n.tag == tag and not n.block:
                            n.depth += 1
        elif close:
            close = close.lower()
            if over.get(close):
                over[close] -= 1
                match = _TOKEN.search(html, at)
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == close:
                    if stack[i].depth:
                        stack[i].depth -= 1
                    else:
                        inside -= sum(n.root for n in stack[i:])
                        del stack[i:]
                    break
                if stack[i].root and close not in ("article", "main", "body", "html"):
                    break
        match = _TOKEN.search(html, at)
    if at < len(html):
        stack[-1].parts.append(html[at:])
    if worded:
        _unmark(top)
    return top


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def own_text(node: Node) -> str:
    return " ".join(unescape("".join([p for p in node.parts if p.__class__ is str])).split())


def _label(node: Node) -> str:
    return f"{node.tag}.{node.style}"


def statistics(top: Node) -> list[tuple[int, int, int, int]]:
    """(node, kind, value, source) of a page without its marked noise.

    kind 0: the sequence of blocks; 1: own text. source names the content that a row is part
    of, the whole page or an article, so that copies of either count once.
    """
    from xxhash import xxh64_intdigest

    parts: list[set[tuple[int, int, int]]] = [set()]
    todo = [(top, xxh64_intdigest("html"), 0)]
    while todo:
        node, name, part = todo.pop()
        if node.root and not part:
            parts.append(set())
            part = len(parts) - 1
        inner = [p for p in node.parts if p.__class__ is not str and not p.noise]
        runs: list[str] = []
        for child in inner:
            if not runs or runs[-1] != _label(child):
                runs.append(_label(child))
        if inner:
            parts[part].add((name, 0, xxh64_intdigest("|".join(runs))))
        if text := own_text(node):
            parts[part].add((name, 1, xxh64_intdigest(text)))
        run, last = -1, None
        for child in inner:
            if (label := _label(child)) != last:
                run, last = run + 1, label
            todo.append((child, xxh64_intdigest(f"{name} {run} {label}"), part))
    whole = xxh64_intdigest(repr([sorted(p) for p in parts]))
    out = []
    for i, part in enumerate(parts):
        source = xxh64_intdigest(repr(sorted(part))) if i else whole
        out += [(*row, source) for row in part]
    return out


def main_text(top: Node, low: dict[int, float]) -> str:
    """The page's text without noise. low: unimportant nodes, and their importance."""
    from xxhash import xxh64_intdigest

    roots: list[Node] = []
    names: dict[int, int] = {}

    def visit(node: Node, name: int, within: bool) -> None:
        names[id(node)] = name
        if node.root and not within:
            roots.append(node)
            within = True
        run, last = -1, None
        for child in node.parts:
            if child.__class__ is not str and not child.noise:
                if (label := _label(child)) != last:
                    run, last = run + 1, label
                visit(child, xxh64_intdigest(f"{name} {run} {label}") if low else 0, within)

    def gather(node: Node, most: float) -> tuple[list[str], bool]:
        """The text below node, and whether it is all noise."""
        parts: list[str] = []
        noise = low.get(names.get(id(node), 0), 1.0) < most if low else False
        own = False
        for child in node.parts:
            if child.__class__ is str:
                parts.append(child)
                own = own or not child.isspace()
            elif not child.noise:
                text, gone = gather(child, most)
                if not gone:
                    parts += [" ", *text, " "] if child.block else text
                    noise = noise and not unescape("".join(text)).strip()
        return parts, noise and (own or any(c.__class__ is not str for c in node.parts))

    visit(top, xxh64_intdigest("html"), False)
    texts = [gather(n, SURE)[0] for n in roots] if roots else [gather(top, THRESHOLD)[0]]
    return " ".join(unescape(" ".join(["".join(t) for t in texts])).split())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "html", 2_000_000):
        rows = []
        for url, html in zip(batch.column("url").to_pylist(), column_bytes(batch.column("html"))):
            if html:
                host = host_of(url)
                rows += [(host, _signed(n), k, _signed(v), _signed(p)) for n, k, v, p in statistics(parse(html.decode("utf-8", "replace")))]
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])], names=["host", "node", "kind", "value", "source"])


def unimportant(pages: DataFrame) -> DataFrame:
    """(host, nodes, importances): the nodes of each host below the threshold."""
    rows = pages.select("url", "html").mapInArrow(_statistics, "host string, node long, kind int, value long, source long")
    counts = rows.distinct().groupBy("host", "node", "kind", "value").agg(F.count("*").alias("c"))
    counts = table(counts, "style-tree")
    # Every page has its outermost node, and just one sequence of blocks there.
    outer = counts.groupBy("host", "node").agg(F.sum(F.when(F.col("kind") == 0, F.col("c")).otherwise(0)).alias("n"))
    size = outer.groupBy("host").agg(F.max("n").alias("m")).filter("m > 1")
    c, m = F.col("c").cast("double"), F.col("m").cast("double")
    by = counts.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 0, c)).alias("seen"),
        F.sum(F.when(F.col("kind") == 0, c * F.log(c))).alias("s"),
        F.sum(F.when(F.col("kind") == 1, c * F.log(c))).alias("t"),
        F.sum(F.when(F.col("kind") == 1, c)).alias("texts"),
    ).join(size, "host")
    presentation = F.when(F.col("seen") > 1, (F.log("seen") - F.col("s") / F.col("seen")) / F.log("seen")).when(F.col("seen") == 1, F.lit(1.0))
    content = 1 - F.col("t") / F.col("texts") / F.log(m)
    both = by.select("host", "node", "m", F.col("t").isNotNull().alias("worded"), F.greatest(presentation, content).alias("importance"))
    # Without enough pages a node is never so sure that an article would lose it.
    sure = F.when(F.col("m") < STEADY, F.greatest("importance", F.lit(SURE))).otherwise(F.col("importance"))
    # A node without text of its own loses nothing that its children don't lose by themselves.
    # Of the others each has one text on nearly m ** (1 - THRESHOLD) pages or more, so that few are left.
    low = both.filter((F.col("importance") < THRESHOLD) & F.col("worded")).select("host", "node", sure.alias("importance"))
    return low.groupBy("host").agg(F.collect_list("node").alias("nodes"), F.collect_list("importance").alias("importances"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "html", 2_000_000):
        texts, known = [], {}
        for host, nodes, importances, html in zip(*(batch.column(c).to_pylist() for c in ("host", "nodes", "importances")), column_bytes(batch.column("html"))):
            if not html:
                texts.append("")
                continue
            if host not in known:
                known[host] = {x & 0xFFFFFFFFFFFFFFFF: y for x, y in zip(nodes or (), importances or ())}
            texts.append(main_text(parse(html.decode("utf-8", "replace")), known[host]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, send_bytes: int = SEND_BYTES, salts: int = SALTS) -> DataFrame:
    """page_id, url, text and n_chars of each page (page_id, url, html)."""
    ship(pages.sparkSession)
    low = table(unimportant(pages), "unimportant")
    size = low.agg(F.coalesce(F.sum(16 * F.size("nodes") + F.octet_length("host") + 32), F.lit(0)).alias("n")).first().n
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    if size <= send_bytes:
        joined = hosted.join(F.broadcast(low), "host", "left")
    else:  # a host's pages are dealt over as many tasks as there are salts
        dealt = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)))
        joined = dealt.join(low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "host", "nodes", "importances")
    return joined.mapInArrow(_extract, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
