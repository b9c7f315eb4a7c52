"""Main text of web pages by site style trees.

All pages of a host are merged into one style tree: a node stands for the elements at one path of tags,
classes and ids. A node's importance joins the entropy of its contents and of its presentations (the
order of child tags) over the pages that have it, each counted once, as shares of the most that so many pages can show:
menus, adverts and footers say the same everywhere, articles do not. A tree over all hosts stands beside
it for hosts with few pages. Copies of a page count once. A branch goes from a page if its score is
low: its importance, drawn by a weight towards 0 or 1 by what its tag and classes tell beforehand. That
is no more than a prior: text in an element with a class such as `share` stays if the tree shows
it to differ as much as articles do, and text without any such class goes if the tree shows it to be the same
everywhere. Only what HTML itself declares to be no text (scripts, menus, forms, hidden parts) needs no
tree.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm import frames
from strophe.llm import words as W
from strophe.llm.store import Workspace
from strophe.llm.urls import host_of

#: Weight of contents against presentations, score below which a branch goes, pages from which a tree is trusted, importance of a node no tree is trusted on.
GAMMA, THRESHOLD, TRUSTED, UNKNOWN = 0.75, 0.5, 8, 0.7
#: What an element's tag and classes tell, and the weight of that against its importance. APART: plain, but beside the article of a page that has one, and without a sentence.
PLAIN, APART, WEAK, MARKED, OUT = 0, 1, 2, 3, 4
WEIGHT = (0.0, 0.3, 0.2, 0.4, 1.0)
#: Entries of a host's map that may travel with each of its pages, and pages of a host with a longer one that a task takes.
TRAVELS, PAGES = 512, 20_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("head script style noscript template svg math object embed iframe canvas audio video select option button textarea title".split())
#: Elements for what stands around the text; they go unless they hold an article, a form also if it holds most of the text.
AROUND = frozenset("form nav footer aside menu dialog".split())
#: Marks within a sentence: these stay with their block, unless a class tells otherwise.
PHRASES = INLINE - frozenset("a label span".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = frozenset("html body table ul ol dl div article section main".split())
#: Words of a class or id that mark an element as no content, if its share of the text is minor.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus footer masthead menu menus modal nav navbar navigation newsletter notice notices alert popup promo promotion related replies reply respond share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription teaser toolbar widget".split())
#: Of them, words for what readers write, which differs on every page.
READERS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
#: Parts of a name that say that the element is not what the rest of the name says.
NEGATING = frozenset("no not non has with without free open closed off category tag format work works".split())
CONTENT = frozenset("article main".split())
#: Within an article these are its prose and the parts of its lists and tables, and stay however often they are repeated.
PROSE = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd tr td th thead tbody tfoot caption figcaption".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"[0-9]+")
_ALL = (1 << 64) - 1
_LETTER = re.compile(r"[^\W\d_]")
_PRIME = (1 << 61) - 1


class Node:
    """An element: what is below it in children; what judge() finds in the rest."""

    __slots__ = ("children", "gone", "hash", "holds", "inside", "key", "names", "parent", "path", "power", "prior", "size", "tag")

    def __init__(self, tag: str, key: str, prior: int, parent: Node | None, names: frozenset[str] = frozenset()):
        self.tag, self.key, self.prior, self.parent, self.names = tag, key, prior, parent, names
        self.size, self.holds, self.inside, self.gone = 0, False, False, False
        self.path, self.hash, self.power = 0, 0, 1
        self.children: list[Node | str] = []


#: (key, prior, names) of a tag and its attributes; most recur on every page.
_DESCRIBED: dict[tuple[str, str], tuple[str, int, frozenset[str]]] = {}


def _told(names: frozenset[str]) -> int:
    """What class and id names tell: OUT for readers' comments, MARKED for a name that begins with a noise word, WEAK for one that only has one."""
    most = PLAIN
    for name in names:
        parts = [x.lower() for x in _CAMEL.findall(name)]
        if not parts or not NOISE.intersection(parts) or NEGATING.intersection(parts):
            continue
        most = max(most, (OUT if parts[0] in READERS else MARKED) if parts[0] in NOISE else WEAK)
    return most


def _describe(tag: str, attributes: str) -> tuple[str, int, frozenset[str]]:
    """Key of an element (its tag, classes and id without digits), what it tells beforehand, and its names."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, OUT if tag in AROUND else PLAIN, frozenset()
    found = _DESCRIBED.get((tag, attributes))
    if found:
        return found
    keys, names, hidden = [], set(), False
    for m in _NAMES.finditer(attributes):
        what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if what == "hidden" or what == "aria-hidden":
            hidden = hidden or what == "hidden"
            continue
        keys.append(f"{what}={_DIGITS.sub('#', value)}")
        if what == "role":
            hidden = hidden or value in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog")
        else:
            names.update(value.split())
    out = frozenset(names)
    prior = PLAIN if tag in ("html", "body", "main") else OUT if hidden or tag in AROUND else _told(out)
    if len(_DESCRIBED) >= 10_000:
        _DESCRIBED.clear()
    _DESCRIBED[tag, attributes] = found = f"{tag}[{' '.join(sorted(keys))}]" if keys else tag, prior, out
    return found


def parse(text: str) -> list[Node]:
    """The page's elements in their order, the first one the page itself; tolerant of missing, crossed and cut tags, of any depth."""
    root = Node("", "", PLAIN, None)
    nodes, stack = [root], [root]
    open_: Counter[str] = Counter()
    at, n = 0, len(text)
    find = _TOKEN.search

    def close(k: int) -> None:
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    def close_first(tags, stop) -> None:
        """Close up to the innermost of tags, unless one that stops is met first."""
        if any(open_[t] for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    close(k)
                    break
                if stop(stack[k].tag):
                    break

    while at < n:
        m = find(text, at)
        if m is None:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "br":
                stack[-1].children.append(Node("br", "br", PLAIN, stack[-1]))
            else:
                close_first((tag,), (lambda x: x not in INLINE) if tag in INLINE else lambda x: False)
            continue
        if tag in CLOSES_P:
            close_first(("p",), lambda x: x not in INLINE)
        elif tag in CLOSES:
            close_first(CLOSES[tag], SCOPE.__contains__)
        key, prior, names = _describe(tag, m[3] or m[6] or "")
        if tag in SILENT or tag == "header" and not open_["article"] and not open_["main"]:
            prior = OUT
        parent = stack[-1]
        node = Node(tag, key, prior, parent, names)
        parent.children.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>|</{tag}\Z", re.I).search(text, at)
            at = end.end() if end else n
        elif tag not in VOID:
            stack.append(node)
            open_[tag] += 1
    return nodes


def judge(nodes: list[Node], host: str) -> list[Node]:
    """Settle what every element tells beforehand, its path and contents; returns the page's article elements, the outermost.

    Forms, menus and the like that hold an article tell nothing. Nor do elements with a noise word that hold one;
    of the others those stay as they are that together have a minor share of the article's or, without one, the page's
    text: where they have half of it or more, the largest and those that share a name with it are opened,
    and what is marked within them is judged instead. What readers write counts for nothing there, however long it is,
    unless no other block of that text holds a sentence. A marked article is one unless the page has others
    that are not marked.
    """
    for x in nodes[1:]:
        x.gone = x.parent.gone or x.tag in SILENT
    for x in reversed(nodes):
        if not x.gone:
            x.size += sum(len(c) - c.count(" ") for c in x.children if isinstance(c, str))
            if x.parent:
                x.parent.size += x.size
    scopes = [x for x in nodes if x.tag in CONTENT and x.size and not x.gone]
    if any(x.prior == PLAIN for x in scopes):
        scopes = [x for x in scopes if x.prior == PLAIN]
    for x in scopes:
        x.prior, up = PLAIN, x.parent
        while up is not None and not up.holds:
            up.holds = True
            up = up.parent
    for x in nodes:
        if x.prior and (x.holds or x.tag == "form" and 2 * x.size >= nodes[0].size) and x.tag not in SILENT:
            x.prior = PLAIN
    real = {id(x) for x in scopes}
    if any(WEAK <= x.prior and x.names for x in nodes):
        for scope in scopes or nodes[:1]:
            _open_large(scope, real)
    found = []
    for x in nodes[1:]:
        x.gone = x.parent.gone or x.prior == OUT
        x.inside = x.parent.inside or id(x) in real
        if id(x) in real and not x.gone and not x.parent.inside:
            found.append(x)
        x.path = _path(x.parent.path, x.key)
    talks = _talking(nodes) if found else set()
    for x in nodes[1:]:
        if x.inside and x.prior == MARKED and x.tag in PROSE:
            x.prior = WEAK
        elif x.prior == PLAIN and found and not x.inside and not x.holds and x.tag not in PROSE and id(x) not in talks:
            x.prior = APART
    for x in reversed(nodes):
        if not x.gone:
            for c in x.children:
                if isinstance(c, str):
                    if c.isspace():
                        continue
                    h, power = _said(c, host, x.inside)
                elif c.gone:
                    continue
                else:
                    h, power = c.hash, c.power
                x.hash, x.power = (x.hash * power + h) % _PRIME, x.power * power % _PRIME
    return found


def _open_large(scope: Node, real: set[int]) -> None:
    """Tell nothing of the marked elements in scope that have too much of its text for what they tell."""
    readers: list[Node] = []

    def outermost(node: Node) -> list[Node]:
        out, todo = [], [node]
        while todo:
            for c in todo.pop().children:
                if isinstance(c, Node) and id(c) not in real:
                    if c.prior >= WEAK:
                        if c.names and c.tag not in AROUND and c.tag not in SILENT and c.tag != "header":
                            (readers if c.prior == OUT else out).append(c)
                    elif not c.gone:
                        todo.append(c)
        return out

    def open_(front: list[Node], total: int) -> None:
        while front and 2 * sum(x.size for x in front) >= total - sum(x.size for x in readers if x not in front):
            big = max(front, key=lambda x: x.size)
            if not big.size:
                break
            rest: list[Node] = []
            for x in front:
                if x is big or big.names & x.names:
                    x.prior = PLAIN
                    rest += outermost(x)
                else:
                    rest.append(x)
            front = rest

    total = scope.size - sum(x.size for x in _around(scope, real))
    open_(outermost(scope), total)
    if readers and not _sentence(scope):
        front, readers[:] = list(readers), []
        open_(front, total)


def _sentence(scope: Node) -> bool:
    """Whether an unmarked block of scope, no heading or link, has five words or more in a row."""
    todo = [scope]
    while todo:
        x = todo.pop()
        if any(isinstance(c, str) and len(c) > 8 and len(c.split()) >= 5 for c in x.children):
            return True
        todo += [c for c in x.children if isinstance(c, Node) and _speaks(c)]
    return False


def _speaks(x: Node) -> bool:
    return not x.gone and x.prior < WEAK and x.tag not in ("a", "h1", "h2", "h3", "h4", "h5", "h6")


def _talking(nodes: list[Node]) -> set[int]:
    """The elements, by id, for which _sentence() holds."""
    out: set[int] = set()
    for x in reversed(nodes):
        if id(x) in out or any(isinstance(c, str) and len(c) > 8 and len(c.split()) >= 5 for c in x.children):
            out.add(id(x))
            if x.parent is not None and _speaks(x):
                out.add(id(x.parent))
    return out


def _around(scope: Node, real: set[int]) -> list[Node]:
    """The outermost menus and the like in scope."""
    out, todo = [], [scope]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node) and not c.gone:
                if c.prior == OUT and (c.tag in AROUND or c.tag == "header"):
                    out.append(c)
                else:
                    todo.append(c)
    return out


#: Hashes of paths; most recur on every page.
_PATHS: dict[tuple[int, str], int] = {}


def _path(parent: int, key: str) -> int:
    found = _PATHS.get((parent, key))
    if found is None:
        if len(_PATHS) >= 100_000:
            _PATHS.clear()
        found = _PATHS[parent, key] = xxhash.xxh64_intdigest(f"{parent:x}/{key}")
    return found


def _said(text: str, host: str, exact: bool) -> tuple[int, int]:
    """Hash of a text without blanks and the host's name and, unless exact or it has no letters, without its digits; and the factor that a text before it takes.

    Hashes of texts join to that of the texts in a row, wherever markup cuts them.
    """
    if host and host in text:
        text = text.replace(host, "")
    if not exact and _LETTER.search(text):
        text = _DIGITS.sub("#", text)
    raw = "".join(text.split()).encode("utf-8", "surrogatepass")
    return int.from_bytes(raw) % _PRIME, pow(256, len(raw), _PRIME)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def observe(nodes: list[Node]) -> set[tuple[int, int, int]]:
    """(path, kind, value) of what the judged elements that have text and aren't out anyway show: contents 0, presentations 1, themselves 2, and 3 if a tag or class tells something."""
    seen = set()
    for x in nodes[1:]:
        if not x.gone and x.power != 1:
            tags: list[str] = []
            for c in x.children:
                if isinstance(c, Node) and (not tags or tags[-1] != c.key):
                    tags.append(c.key)
            seen |= {(x.path, 0, x.hash), (x.path, 1, xxhash.xxh64_intdigest(" ".join(tags))), (x.path, 2, 0)}
            if x.prior:
                seen.add((x.path, 3, 0))
    return seen


def extract(nodes: list[Node], articles: list[Node], importance: dict[int, float], said: frozenset[tuple[int, int]] = frozenset(), threshold: float = THRESHOLD) -> str:
    """The page's text without the branches that score below the threshold, given the importance of the paths that a tree is trusted on.

    Within its articles, unmarked branches other than prose go if their (path, content) is among those said on most pages.
    """
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line:
            words = _html.unescape("".join(line)).split()
            line.clear()
            if words:
                blocks.append(" ".join(words))

    told = {p for p, _ in said}

    def goes(c: Node) -> bool:
        if c.gone or c.prior == OUT:
            return True
        if c.holds and not c.inside or c.prior < WEAK and c.tag in PHRASES:
            return False
        if c.inside and c.prior < WEAK:
            return c.path in told and c.tag not in PROSE and (c.path, c.hash) in said
        return (1 - WEIGHT[c.prior]) * importance.get(c.path, UNKNOWN) < threshold

    stack: list[tuple[Node, Iterator]] = [(nodes[0], iter(nodes[0].children))]
    while stack:
        node, rest = stack[-1]
        for c in rest:
            if isinstance(c, str):
                if not articles or not node.holds or node.inside:
                    line.append(c)
            elif c.tag == "br" or c.tag == "hr":
                close()
            elif c.tag not in VOID:
                block = c.tag not in INLINE
                if block:
                    close()
                if not goes(c):
                    stack.append((c, iter(c.children)))
                    break
        else:
            stack.pop()
            if node.tag not in INLINE:
                close()
    close()
    return " ".join(blocks)


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a page that has text: host, hash of its articles' text or else its whole text, and what it shows at each path."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            hosts, texts, ends, shown = [], [], [0], []
            for host, page in zip(b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256).to_pylist(), strict=True):
                nodes = parse(page or "")
                articles = judge(nodes, host)
                shown += sorted((_signed(path), kind, _signed(x)) for path, kind, x in observe(nodes))
                if len(shown) > ends[-1]:
                    whole = [x.hash for x in articles if x.power != 1] or [nodes[0].hash]
                    hosts.append(host)
                    texts.append(_signed(whole[0] if len(whole) == 1 else xxhash.xxh64_intdigest(repr(whole))))
                    ends.append(len(shown))
                W.release(len(page or ""))
            if hosts:
                path, kind, value = zip(*shown, strict=True)
                rows = pa.StructArray.from_arrays([pa.array(path, pa.int64()), pa.array(kind, pa.int32()), pa.array(value, pa.int64())], names=["path", "kind", "value"])
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(texts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], names=["host", "said", "nodes"])


def _take(threshold: float):
    """page_id, url and text of rows (page_id, url, html, host, known, said); a row of rank 0 has the lists of the rows behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: tuple[dict, frozenset] = {}, frozenset()
        for b in batches:
            ranks, texts = b.column(6).to_pylist(), []
            for at in range(0, b.num_rows, 256):
                for rank, page, host, known, said in zip(ranks[at : at + 256], *(b.column(k).slice(at, 256).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                    own = {x["path"] & _ALL: x["importance"] for x in known or ()}, frozenset((x["path"] & _ALL, x["value"] & _ALL) for x in said or ())
                    if rank == 0:
                        ahead = own
                        continue
                    nodes = parse(page or "")
                    articles = judge(nodes, host)
                    texts.append(extract(nodes, articles, *(ahead if rank == 1 else own), threshold))
                    W.release(len(page or ""))
            held = pa.array([r != 0 for r in ranks])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(held), b.column(1).filter(held), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def _importance(sums: DataFrame, *node: str) -> DataFrame:
    """n (pages that have a node) and its importance: the mean of ln(n / pages that show it too) / ln n over what each page shows."""
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    logs = F.col("c") * F.ln("c")
    spread = sums.groupBy(*node).agg(of(2, F.col("c")).alias("n"), *(of(k, x).alias(f"{name}{k}") for k in (0, 1) for name, x in (("c", F.col("c")), ("clogc", logs))))
    entropy = lambda k: F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.ln("n") - F.col(f"clogc{k}") / F.col(f"c{k}")) / F.ln("n")).otherwise(1.0)
    return spread.select(*node, "n", (GAMMA * entropy(0) + (1 - GAMMA) * entropy(1)).alias("importance"))


def _sums(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages c of a host that show a value at a path: kind 0 contents, 1 presentations, 2 the path itself, 3 that a tag or class tells something. Copies of a page count once."""
    rows = frames.pick(pages, "url", "html").where("html is not null").select(host_of(F.col("url")).alias("host"), "html")
    seen = rows.mapInArrow(_observe, "host string, said long, nodes array<struct<path:long,kind:int,value:long>>")
    once = seen.groupBy("host", "said").agg(F.min("nodes").alias("nodes")).select("host", F.inline("nodes"))
    return Workspace(spark, "style").save(once.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c")))


def style_tree(sums: DataFrame) -> DataFrame:
    """Every node of every host's tree: host, path, n, importance, and n_all, hosts and importance_all of the node in the tree of all hosts.

    In that each host counts once, with all that its pages show: a host of many pages outweighs no other.
    """
    every = _importance(sums.groupBy("path", "kind", "value").agg(F.count("*").alias("c")), "path")
    total = sums.where("kind = 2").groupBy("path").agg(F.sum("c").alias("n_all"))
    own = _importance(sums, "host", "path")
    return own.join(every.select("path", F.col("n").alias("hosts"), F.col("importance").alias("importance_all")), "path").join(total, "path")


def main_text(spark: SparkSession, pages: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url and text, the page's main text.

    A branch goes if its score is below the threshold: the importance that at least `trusted` different pages of its host
    show, else that at least `trusted` of all hosts show, else UNKNOWN; times 1 - WEIGHT of what its tag and
    classes tell. Within an article or main element, an unmarked branch goes only if its importance is
    low, it says what at least `trusted` of these pages, and most that have it
    (of all hosts: most hosts), say there, and it is no prose, list item or table part.
    Null and empty pages have an empty text. Pages without host share a tree. Pages may be of any length and
    nested to any depth; a page is held whole by one task, and beside it one host's map, which has an entry for each path that tells something. Repeated rows each give a row; other columns are not read.
    """
    sums = _sums(spark, pages)
    tree = style_tree(sums)
    own = F.col("n") >= trusted
    known = tree.where(own | (F.col("n_all") >= trusted)).select("host", "path", "n", "hosts", own.alias("own"), F.when(own, F.col("importance")).otherwise(F.col("importance_all")).alias("importance"))
    # where a tag or class tells something a high importance counts as well
    asked = sums.where(F.col("kind") == 3).select("host", "path", F.lit(True).alias("asked"))
    known = Workspace(spark, "known").save(known.join(asked, ["host", "path"], "left").where((F.col("importance") < threshold) | F.col("asked")))
    poor = known.where(F.col("importance") < threshold)
    contents = sums.where(F.col("kind") == 0)
    said = contents.where(F.col("c") >= trusted).join(poor.where("own"), ["host", "path"]).where(2 * F.col("c") > F.col("n"))
    shared = contents.groupBy("path", "value").agg(F.count("*").alias("c"), F.sum("c").alias("pages")).where(F.col("pages") >= trusted)
    shared = shared.join(poor.where("not own"), "path").where(2 * F.col("c") > F.col("hosts"))
    said = said.select("host", "path", "value").unionByName(shared.select("host", "path", "value"))
    known = known.groupBy("host").agg(F.collect_list(F.struct("path", F.col("importance").cast("float").alias("importance"))).alias("known"))
    said = said.groupBy("host").agg(F.collect_set(F.struct("path", "value")).alias("said"))
    known = Workspace(spark, "pages").save(known.join(said, "host", "left"))
    pages = frames.pick(pages, "page_id", "url", "html")
    rows = pages.withColumn("host", host_of(F.col("url")))
    # a long map doesn't travel with each page: its host's pages are sorted behind it, a host of many pages in several tasks
    long = known.where(F.size("known") + F.coalesce(F.size("said"), F.lit(0)) > TRAVELS)
    held = rows.select("host").join(long.select("host"), "host", "left_semi").groupBy("host").agg(F.ceil(F.count("*") / PAGES).cast("int").alias("salts"))
    held = Workspace(spark, "hosts").save(held)
    none = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("known", "said")]
    behind = rows.join(held, "host").select("page_id", "url", "html", "host", *none, F.lit(1).alias("rank"), F.pmod(F.xxhash64("page_id", "url", "html"), "salts").cast("int").alias("salt"))
    maps = long.join(held, "host").select(*[F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in ("page_id", "url", "html")], "host", "known", "said", F.lit(0).alias("rank"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    sorted_ = maps.unionByName(behind).repartition("host", "salt").sortWithinPartitions("host", "salt", "rank").drop("salt")
    short = rows.join(held.select("host"), "host", "left_anti").join(known, "host", "left").select("page_id", "url", "html", "host", "known", "said", F.lit(2).alias("rank"))
    rows = short if held.isEmpty() else short.unionByName(sorted_)
    return rows.mapInArrow(_take(threshold), T.StructType([pages.schema["page_id"], *T.StructType.fromDDL("url string, text string")]))
