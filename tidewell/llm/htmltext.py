"""Operator 8: main text of web pages, with removal of site templates.

Pages are parsed leniently into trees. Subtrees of block elements are hashed
bottom up; Spark counts, for each host, on how many pages of distinct main text
a hash occurs: copies of a page, and repeated rows, count once. Subtrees that
recur on LEAST_PAGES of them are the host's template and are deleted, however
many other pages the host has. The structural rules then take the article (or,
without one, the body) without menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments. Class, id and role words
count as whole tokens only ("side-effects" marks nothing), and alone they delete
no layout: a form, or an element that a word of LAYOUT marks, which holds more
than half of the page's text, and that mostly as prose, is the page's frame and
stays. In articles, they delete no headings or table cells, and no inline
elements by words that prose has too (PROSE).

Inside article and main, copies of one article with small changes must not make
its prose a template. So a page speaks for a template there only if at least OWN
of its main text is its own: in no recurring subtree, and no variant of a block
that recurs (of each block KEYS minima of its shingles' hashes are counted like
subtrees; a variant has two recurring ones). At least LEAST_PAGES such pages,
and half of all that carry the subtree, are needed. Where hardly a page has that
much text of its own, the subtree stays. So does one that stands in articles of
HOSTS hosts or more: a passage that many sites share is no site's template.

A hash holds its host. What recurs is broadcast as sorted numbers up to
BROADCAST_ROWS of them; beyond that every page gets its own by a join on hashes,
so no host's set is ever in one row.

Nulls: null html gives empty text. A url without a scheme has the host that it
begins with; pages without a host are of no site and have no template. Empty and
broken html gives what text there is. Very long and very deep pages are taken
whole, in time that grows with their length. Repeated rows are extracted row by
row. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import stash, table, unstash
from tidewell.llm.shingle import mix, windows, word_hashes

#: A subtree is template if it is on pages of at least this many distinct main texts of a host; hashes that are broadcast.
LEAST_PAGES, BROADCAST_ROWS = 5, 1_000_000
#: What stands in articles of this many hosts is shared prose.
HOSTS = 3
#: Share of its own text with which a page speaks for a template inside articles; minima of a block's shingles, how many recur in a variant, words of those shingles, words from which a block has several.
OWN, KEYS, VARIANT, SHORT, WHOLE = 0.2, 8, 2, 3, 8
#: Characters of html whose trees are held at once; letters of prose that a page's frame has at least.
HELD, FRAME = 1 << 22, 100

#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that are never main text.
DROPPED = frozenset("aside button canvas datalist dialog footer form head iframe input map menu nav noembed noframes noscript object option script search select style svg template textarea title".split())
#: Tokens of class, id or role that mark what isn't main text: one of the words, with what commonly stands before and behind it.
_WORDS = "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related replies respond share sharing sidebar side social sponsor sponsored subscribe toolbar widget widgets"
_MARKED = frozenset(_WORDS.split())
_BEFORE = "site page main global top bottom left right primary secondary post article entry blog wp js the google header footer user reader mobile"
_BEHIND = "area bar box block body buttons container content wrap wrapper section list left right top bottom main inner outer link links item items form icons media unit slot banner menu overlay panel column col policy posts articles stories text title thread primary secondary footer header"
MARKS = re.compile(rf"(?:^|\s)(?:(?:{_BEFORE.replace(' ', '|')})[_-]+)*(?:{_WORDS.replace(' ', '|')})(?:[_-]+(?:{_WORDS.replace(' ', '|')}|{_BEHIND.replace(' ', '|')}|[0-9]+))*(?=\s|$)", re.I)
#: Words that also name the parts of a layout which hold the article ("right-sidebar"), unlike those of comments, notices and adverts.
LAYOUT = re.compile(r"(?:^|[\s_-])(?:banner|complementary|masthead|menu|modal|nav|navbar|navigation|popup|related|responds?|share|sharing|side|sidebar|social|toolbar|widgets?)(?=[\s_-]|$)", re.I)
OTHER = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|comments?|consent|cookies?|disqus|gdpr|newsletter|notices?|promo|promotion|replies|sponsor|sponsored|subscribe)(?=[\s_-]|$)", re.I)
#: Words that mark inline elements of prose as well ("notice", "banner"), unlike those of buttons and adverts.
PROSE = frozenset("banner modal notice notices promotion related side".split())
#: Elements that marks don't delete in an article, and those whose text is no prose.
PARTS = frozenset("caption dd dt figcaption h1 h2 h3 h4 h5 h6 tbody td tfoot th thead tr".split())
LISTS = frozenset("dd dt label legend li option".split())
#: A start tag of one of the first closes an open element of the second, unless one of the third is between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


#: An open paragraph is looked for up to one of these.
_AROUND_P = frozenset("article main div section td li blockquote body".split())


class Node:
    """An element: tag, marks, parts (texts and nodes), parent, the open paragraph that a block inside it would end, and
    whether it is a frame of the page, which is never dropped."""

    __slots__ = ("tag", "marks", "parts", "parent", "p", "frame")

    def __init__(self, tag: str, marks: str = "", parent: Node | None = None):
        self.tag, self.marks, self.parts, self.parent, self.frame = tag, marks, [], parent, False
        self.p = self if tag == "p" else None if tag in _AROUND_P or parent is None else parent.p


class _Path:
    """The open elements, and how many there are of each tag, so that nothing is looked for in vain."""

    def __init__(self):
        self.now, self.open = Node(""), {}

    def close(self, to: Node) -> None:
        """Closes elements until `to` is the innermost open one."""
        while self.now is not to:
            self.open[self.now.tag] -= 1
            self.now = self.now.parent

    def enter(self, node: Node) -> None:
        self.open[node.tag] = self.open.get(node.tag, 0) + 1
        self.now = node

    def any(self, tags) -> bool:
        return any(self.open.get(t) for t in tags)

    def up(self, wanted, stop) -> Node | None:
        """The innermost open element of the wanted tags, unless one of the others is further in."""
        if self.any(wanted):
            x = self.now
            while x is not None and x.tag not in stop:
                if x.tag in wanted:
                    return x
                x = x.parent
            if x is not None and x.tag in wanted:
                return x
        return None


_ARTICLE = ("article", "main")


def _of_prose(marks: str) -> bool:
    """Whether the marks of an inline element may as well be those of prose."""
    return frozenset(re.split("[^a-z]+", marks.lower())) & _MARKED <= PROSE


def _rescued(path: _Path) -> Node | None:
    """The outermost dropped element around, if no article is open: an article is never inside it."""
    if path.any(_ARTICLE):
        return None
    x, out = path.now, None
    while x is not None:
        if dropped(x, False):
            out = x
        x = x.parent
    return out


def parse(text: str) -> Node:
    """The tree of a page; unclosed and misnested elements are closed as browsers mostly do. Inline elements leave no nodes."""
    path = _Path()
    root = path.now
    at, n = 0, len(text)
    maybe: list[Node] = []
    while at < n:
        m = _TOKEN.match(text, at)
        if m is None:  # a quote that never ends: the rest of the tag is dropped at the next '>'
            end = text.find(">", at)
            at = n if end < 0 else end + 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][:2] not in ("<!", "<?"):
                path.now.parts.append(m[0])
            continue
        tag = tag.lower()
        if tag == "br":
            path.now.parts.append(" ")
            continue
        if m[1]:
            if tag in BLOCKS or tag in DROPPED:
                x = path.up((tag,), () if tag in ("article", "main", "body", "html") else _ARTICLE)
                if x is not None:
                    path.close(x.parent)
            continue
        attrs = m[3] or ""
        marks = " ".join(x[2] or x[3] or x[4] or "" for x in _ATTR.finditer(attrs)) if "=" in attrs else ""
        block = tag in BLOCKS
        if not block and tag not in DROPPED and tag not in RAW and (not MARKS.search(marks) or path.any(_ARTICLE) and _of_prose(marks)):
            continue
        if tag in _ARTICLE and "comment" not in marks and (x := _rescued(path)) is not None:
            path.close(x.parent)
        if block and path.now.p is not None:  # an open paragraph ends
            path.close(path.now.p.parent)
        if tag in CLOSES and (x := path.up(*CLOSES[tag])) is not None:
            path.close(x.parent)
        node = Node(tag, marks, path.now)
        path.now.parts.append(node)
        if tag == "form" or tag not in DROPPED and marks and LAYOUT.search(marks) and not OTHER.search(marks):
            maybe.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            node.parts.append(text[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        if block or tag in DROPPED:
            path.enter(node)
        else:  # a marked inline element: up to its own end tag
            depth, end = 1, at
            for x in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(text, at):
                depth += -1 if x[1] else 1
                if not depth:
                    end = x.end()
                    break
            at = end
    if maybe:
        _frames(root, maybe)
    return root


def _frames(root: Node, maybe: list[Node]) -> None:
    """Marks as frames those of the nodes that hold more than half of the page's text, and that mostly as prose."""
    size: dict[int, tuple[int, int]] = {}  # of a node: characters, and those of prose
    stack = [(root, False, False)]
    while stack:
        node, listed, seen = stack.pop()
        if seen:
            n = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
            below = [size[id(p)] for p in node.parts if isinstance(p, Node) and id(p) in size]
            size[id(node)] = n + sum(x for x, _ in below), n * (not listed) + sum(x for _, x in below)
            continue
        stack.append((node, listed, True))
        stack += [(p, listed or p.tag in LISTS, False) for p in node.parts if isinstance(p, Node) and (p.tag == "form" or p.tag not in DROPPED and p.tag != "header")]
    total = size[id(root)][0]
    for node in maybe:
        n, prose = size.get(id(node), (0, 0))
        node.frame = 2 * n > total and 2 * prose > n and prose >= FRAME


def dropped(node: Node, inside: bool) -> bool:
    """Whether a subtree is never main text; inside: of an article or main element."""
    if node.frame:
        return False
    if inside and node.tag in PARTS:
        return False
    if node.tag in DROPPED or node.tag == "header" and not inside:
        return True
    if node.tag in ("html", "body") or node.tag in ("article", "main") and "comment" not in node.marks:
        return False
    return bool(node.marks and MARKS.search(node.marks))


def flat(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _hash(text: str | bytes) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text)


def read(root: Node) -> tuple[list[tuple[str, bool, int]], list[tuple[int, bool, int, int]]]:
    """Blocks of the page in order (text, whether inside an article, number), and its block subtrees (hash, whether inside,
    number of the first block in it, of the first behind it). Dropped subtrees are left out. A hash is of tag, marks, and
    the texts and hashes inside; article, main, body and html have none."""
    blocks: list[tuple[str, bool]] = []
    trees: list[tuple[int, bool, int, int]] = []
    run: list[str] = []
    # node, next part, inside, number of blocks before, what the hash is of
    stack: list[list] = [[root, 0, False, 0, [b""]]]
    while stack:
        frame = stack[-1]
        node, i, inside, before, acc = frame
        parts, n = node.parts, len(node.parts)
        while i < n:
            part = parts[i]
            i += 1
            if isinstance(part, str):
                run.append(part)
                continue
            if part.tag in BLOCKS and run:
                if t := flat("".join(run)):
                    blocks.append((t, inside))
                    acc.append(t.encode("utf-8", "surrogatepass"))
                run.clear()
            if not dropped(part, inside):
                frame[1] = i
                stack.append([part, 0, inside or part.tag in _ARTICLE, len(blocks), [f"{part.tag}\0{part.marks}".encode("utf-8", "surrogatepass")]])
                break
        else:
            if run:
                if t := flat("".join(run)):
                    blocks.append((t, inside))
                    acc.append(t.encode("utf-8", "surrogatepass"))
                run.clear()
            stack.pop()
            if stack and len(blocks) > before:
                h = _hash(b"\1".join(acc) + b"\0inside" * inside)
                stack[-1][4].append(h.to_bytes(8, "little"))
                if node.tag not in (*_ARTICLE, "html", "body"):
                    trees.append((h, inside, before, len(blocks)))
    return blocks, trees


_SALTS = np.array([_hash(f"key {i}") for i in range(KEYS)], np.uint64)


def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of every block text KEYS minima of its differently hashed shingles, all in a row, and their number; a block of few
    words has one key."""
    col = pa.array(texts, pa.string())
    s, n = windows(col, SHORT)
    _, words = word_hashes(col)
    out = np.full((len(texts), KEYS), 0, np.uint64)
    own, begin = np.flatnonzero(n), np.cumsum(n) - n
    for k, salt in enumerate(_SALTS if len(own) else ()):
        out[own, k] = np.minimum.reduceat(mix(s ^ salt), begin[own])
    short = np.flatnonzero((words < WHOLE) & (n > 0))
    out[short, 0] = [_hash(texts[i]) for i in short.tolist()]
    number = np.where(n == 0, 0, np.where(words < WHOLE, 1, KEYS))
    return out[np.arange(KEYS)[None] < number[:, None]], number


class Page:
    """Blocks and subtrees of a page; `take`: its main blocks, those of the article, or all if no article has any."""

    __slots__ = ("blocks", "trees", "take", "main")

    def __init__(self, page: str | None):
        self.blocks, self.trees = read(parse(page or ""))
        self.take = [i for i, b in enumerate(self.blocks) if b[1]] or list(range(len(self.blocks)))
        self.main = _hash("\n\n".join(self.blocks[i][0] for i in self.take))

    def left(self, gone: list[tuple[int, int]]) -> list[int]:
        """Main blocks in none of the ranges."""
        cut = np.zeros(len(self.blocks) + 1, np.int64)
        for a, e in gone:
            cut[a] += 1
            cut[e] -= 1
        cut = np.cumsum(cut)
        return [i for i in self.take if not cut[i]]


def _at(h, host: str) -> np.ndarray:
    """Hashes of subtrees or keys, at a host."""
    return mix(np.asarray(h, np.uint64) ^ np.uint64(_hash(host)))


def _in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def extract(page: str | None, host: str = "", template: np.ndarray | None = None) -> str:
    """Main text of a page: its blocks, joined by two line feeds. template: sorted hashes at hosts, to delete."""
    p = Page(page)
    gone = []
    if template is not None and len(template) and p.trees:
        hit = _in(_at([t[0] for t in p.trees], host), template)
        gone = [t[2:] for t, x in zip(p.trees, hit.tolist(), strict=True) if x]
    return "\n\n".join(p.blocks[i][0] for i in (p.left(gone) if gone else p.take))


def _host(url):
    found = F.regexp_extract(url, r"://([^/?#]*)", 1)
    bare = F.regexp_extract(url, r"^(?://)?([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::\d+)?)(?:[/?#]|$)", 1)
    return F.coalesce(F.lower(F.when(found != "", found).otherwise(bare)), F.lit(""))


def _some(hosts: list, pages: list):
    """Parts of a batch of about HELD characters: (hosts, pages read, keys of the inside blocks of each page)."""
    at = 0
    while at < len(pages):
        to, size = at, 0
        while to < len(pages) and (to == at or size + len(pages[to] or "") <= HELD):
            size += len(pages[to] or "")
            to += 1
        got = [Page(x) for x in pages[at:to]]
        k, n = keys([t for p in got for t, inside in p.blocks if inside])
        width = [sum(b[1] for b in p.blocks) for p in got]
        yield hosts[at:to], got, k, np.split(n, np.cumsum(width)[:-1]) if got else []
        at = to


def _numbers(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _inside(p: Page) -> np.ndarray:
    """Hashes of a page's subtrees inside articles, whatever its host."""
    return np.array([t[0] for t in p.trees if t[1]], np.uint64)


def _own(host: str, p: Page, k: np.ndarray) -> np.ndarray:
    """All hashes of a page: of its subtrees, and its keys, at its host; of the subtrees inside articles also without."""
    return np.unique(np.concatenate([_at(np.concatenate([np.array([t[0] for t in p.trees], np.uint64), k]), host), _inside(p)]))


def _hashed(batches):
    """Rows (h, x, g) of all hashes of all pages: at the host, the page's main text, and for subtrees inside articles without host."""
    for b in batches:
        for hosts, got, k, ns in _some(b.column(0).to_pylist(), b.column(1).to_pylist()):
            hs, tags, raws, at = [], [], [], 0
            for host, p, n in zip(hosts, got, ns, strict=True):
                trees = np.array([t[0] for t in p.trees], np.uint64)
                h, first = np.unique(_at(np.concatenate([trees, k[at : at + n.sum()]]), host), return_index=True)
                raw = np.concatenate([np.where([t[1] for t in p.trees], trees, np.uint64(0)).astype(np.uint64), np.zeros(n.sum(), np.uint64)]) if len(trees) else np.zeros(n.sum(), np.uint64)
                hs.append(h)
                raws.append(raw[first])
                tags.append(np.full(len(h), p.main, np.uint64))
                at += n.sum()
            if hs:
                yield pa.RecordBatch.from_arrays([_numbers(np.concatenate(x)) for x in (hs, tags, raws)], names=["h", "x", "g"])


def _spoken(hosts: list, got: list[Page], k: np.ndarray, ns: list, known: np.ndarray):
    """Of each page: its subtrees that recur (hash, whether inside, whether the page speaks for them, main text, hash without
    host), and its host for each subtree inside articles that recurs on some host (hash without host, host)."""
    at = 0
    for host, p, n in zip(hosts, got, ns, strict=True):
        own = k[at : at + n.sum()]
        at += n.sum()
        if not p.trees:
            continue
        raw = _inside(p)
        for g in set(raw[_in(raw, known)].tolist()):
            yield None, None, None, None, g, _hash(host)
        trees = _at([t[0] for t in p.trees], host)
        hit = _in(trees, known)
        if not hit.any():
            continue
        per = np.bincount(np.repeat(np.arange(len(n)), n), weights=_in(_at(own, host), known), minlength=len(n))
        variant = dict(zip([i for i, b in enumerate(p.blocks) if b[1]], (per >= VARIANT).tolist(), strict=True))
        left = p.left([t[2:] for t, x in zip(p.trees, hit.tolist(), strict=True) if x])
        mine = sum(len(p.blocks[i][0]) for i in left if not variant.get(i))
        speaks = 0 < mine >= OWN * sum(len(p.blocks[i][0]) for i in p.take)
        for h, inside, g in {(int(h), p.trees[i][1], p.trees[i][0]) for i, h in enumerate(trees) if hit[i]}:
            yield h, inside, speaks, p.main, g, None


def _with(pages: DataFrame, found: DataFrame, run, schema: str) -> DataFrame:
    """pages.mapInArrow(run(known)) where known(batch) gives the sorted hashes of `found` (h) that a batch needs: all of them,
    broadcast, or those that its pages have, joined to them (column `own`)."""
    if found.count() <= BROADCAST_ROWS:
        every = np.sort(found.toPandas()["h"].to_numpy(np.int64).view(np.uint64))
        shared = pages.sparkSession.sparkContext.broadcast(every)
        return pages.mapInArrow(run(lambda b: shared.value), schema)
    page = F.xxhash64("host", "html").alias("x")

    def owned(batches):
        for b in batches:
            for j, (host, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                for hosts, got, k, ns in _some([host], [text]):
                    h = _own(host, got[0], k)
                    yield pa.RecordBatch.from_arrays([_numbers(h), pa.array([b.column(2)[j].as_py()] * len(h), pa.int64())], names=["h", "x"])

    hits = pages.select("host", "html", page).where("host <> ''").mapInArrow(owned, "h long, x long").distinct().join(found.select("h"), "h", "left_semi").groupBy("x").agg(F.collect_list("h").alias("own"))
    joined = pages.withColumn("x", page).join(hits, "x", "left").drop("x")
    place = joined.columns.index("own")

    def known(b):
        lists = b.column(place).combine_chunks() if isinstance(b.column(place), pa.ChunkedArray) else b.column(place)
        return np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

    return joined.mapInArrow(run(known), schema)


def _recurring(pages: DataFrame, least: int) -> DataFrame:
    """Rows (h): subtrees, and keys of blocks inside articles, on pages of many distinct main texts of a host; of subtrees
    inside articles also their hashes without host."""
    seen = pages.mapInArrow(_hashed, "h long, x long, g long").distinct()
    often = seen.groupBy("h").agg(F.count("*").alias("m"), F.max("g").alias("g"), F.min("g").alias("g0")).where(F.col("m") >= least)
    return often.select(F.explode(F.array("h", F.when(F.col("g") != 0, F.col("g")).otherwise(F.col("g0")))).alias("h")).where("h <> 0").distinct()


def templates(pages: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """Rows (h): subtrees to delete, hashed with their host. pages: (host, html)."""

    def run(known):
        def rows(batches):
            for b in batches:
                own = known(b)
                out = [x for part in _some(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in _spoken(*part, own)]
                h, inside, speaks, main, g, at = zip(*set(out), strict=True) if out else ((),) * 6
                long = lambda x: pa.array([None if v is None else v - (v >> 63 << 64) for v in x], pa.int64())
                yield pa.RecordBatch.from_arrays([long(h), pa.array(inside, pa.bool_()), pa.array(speaks, pa.bool_()), *map(long, (main, g, at))], names=["h", "inside", "speaks", "main", "g", "at"])

        return rows

    pages = pages.where("host <> ''").select("host", "html")
    recurring = stash(_recurring(pages, least), "recurring")
    seen = stash(_with(pages, recurring, run, "h long, inside boolean, speaks boolean, main long, g long, at long").distinct(), "spoken")
    shared = seen.where("at IS NOT NULL").groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") >= HOSTS).select("g")
    n = seen.where("h IS NOT NULL").groupBy("h", "inside").agg(F.count("*").alias("m"), F.count_if("speaks").alias("n"), F.first("g").alias("g"))
    own = n.where("inside").where((F.col("n") >= least) & (2 * F.col("n") >= F.col("m"))).join(shared, "g", "left_anti")
    out = stash(n.where("NOT inside").select("h").union(own.select("h")).distinct(), "templates")
    for t in (recurring, seen):
        unstash(t)
    return out


def texts(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Rows (key, url, text, n_chars)."""
    kind = pages.schema[key].dataType.simpleString()
    p = pages.select(_host(F.col(url)).alias("host"), F.col(page).alias("html"), F.col(key).alias("k"), F.col(url).alias("url"))

    def run(known):
        def rows(batches):
            for b in batches:
                own = known(b)
                out = [extract(x, host, own if host else None) for host, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["k", "url", "text", "n_chars"])

        return rows

    out = _with(p, templates(p), run, f"k {kind}, url string, text string, n_chars long")
    return out.select(F.col("k").alias(key), F.col("url").alias(url), "text", "n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "pages"))
