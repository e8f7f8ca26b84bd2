"""Operator 2: n-gram Jaccard join with count-vector R-trees.

Texts are sets of distinct 5-word shingles (64-bit hashes). Two texts link when
100 * |A & B| >= 75 * |A | B|. Returned is, for every row, the set's size and
the component of its links. Equal sets are one class from the start. Whatever
total order shingles have, two linked sets share a shingle among the first
n - ceil(0.75 n) + 1 of each (prefixes), so classes meet in blocks, one for each
shingle. The order goes by counts of all shingles of the corpus, in a table of
fixed size (a count sketch); it steers the cost only, never the result.

1. Blocks: a block is cut where sizes jump by more than a link allows. Classes
   of a small block are listed as pairs (at most FEW / 2 rows a class), which a
   bound on the overlap, from the number of shingles they share, thins out:
   pairs of unrelated texts end here. In larger blocks every class is paired
   with the block's least member, the hub.
2. Cells: the pairs of one hub are a cell. All pairs of one block are in the
   cell of its hub, or listed, so no link is lost. Cells of more than CELL
   shingles are dealt out in chunks, each with the hub.
3. Search, in every cell or chunk: shingles are hashed into groups, and an
   R-tree indexes the group counts as points. A subtree is searched only if the
   summed coordinate minima of the query and the subtree's upper corner reach
   the overlap that a link needs; so is a pair. Surviving pairs are verified on
   whole sets in the cell, but not where links found before join them already.
   Written are only the links that join two components: fewer than classes.
4. Components of the links, of classes; the least key in a component names it.
   Cells of several chunks that still hold several components are searched once
   more, chunk against chunk: the classes outside the cell's largest component
   against all others.

Nulls: a null or wordless text has an empty set, links with nothing and is its
own component. A row with a null key links like any other, so components may
hang together by it; it gets its size and a null component itself. Repeated
rows are copies. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import kept, stash, table, tidy, unstash
from tidewell.llm.components import components
from tidewell.llm.shingle import WORDS, digest, sets, windows

#: A link needs NUM / DEN; classes of a block that is listed in pairs; shingles of a cell's chunk, of the cells that are searched in one go.
NUM, DEN, FEW, CELL, TOGETHER = 75, 100, 8, 4_000_000, 2_000_000
#: Prefix entries of a bucket; bits of the count table; its parts; tables that are summed at once; ids that are broadcast.
ENTRIES, BITS, PARTS, MERGED, BROADCAST_IDS = 1_000_000, 22, 64, 64, 400_000
#: Entries of a sketch row's batch, shingles counted at once, pairs whose bound is computed at once, words of a cell's bit table.
FLUSH, COUNTED, BLOCK, BITSET = 300_000, 1_000_000, 8192, 1 << 21


def need(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set of size n with any set that it links to."""
    return -(-NUM * n // DEN)


def need2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of two linked sets of these sizes."""
    return -(-NUM * (a + b) // (NUM + DEN))


def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can link."""
    return DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)


def groups_for(n: int) -> int:
    """Groups of the count vectors for sets of up to n: unrelated texts differ by about 1.13 sqrt(n groups), and a link allows 2 n / 7."""
    return 1 << min(10, max(6, (int(n) // 8).bit_length()))


def vector(s: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((s % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.int32)


class CountTree:
    """An R-tree of count vectors, packed bottom up; nodes keep the upper corner, the least and largest set size, and the
    least and largest label: a subtree of the query's own label holds nothing that it must be compared with."""

    FAN = 16

    def __init__(self, vec: np.ndarray, n: np.ndarray, label: np.ndarray | None = None):
        self.vec, self.n = vec.astype(np.int32), n.astype(np.int64)
        self.label = np.arange(len(n)) if label is None else label
        order = np.lexsort((self.vec[:, np.argmax(self.vec.var(axis=0))], n)) if len(n) else np.empty(0, np.int64)
        # tiles of sizes, in each tile by the coordinate that varies most
        run = max(self.FAN, int(np.ceil(np.sqrt(len(n) / self.FAN))) * self.FAN)
        parts = []
        for at in range(0, len(order), run):
            o = order[at : at + run]
            parts.append(o[np.argsort(self.vec[o][:, np.argmax(self.vec[o].var(axis=0))], kind="stable")])
        self.order = np.concatenate(parts) if parts else order
        node = (self.vec[self.order], *(x[self.order] for x in (self.n, self.n, self.label, self.label)))
        self.leaves, self.levels = node, []
        while len(node[0]) > 1 or (len(node[0]) and not self.levels):
            cuts = np.arange(0, len(node[0]), self.FAN)
            hi, lo_n, hi_n, lo_l, hi_l = node
            node = (np.maximum.reduceat(hi, cuts), np.minimum.reduceat(lo_n, cuts), np.maximum.reduceat(hi_n, cuts), np.minimum.reduceat(lo_l, cuts), np.maximum.reduceat(hi_l, cuts))
            self.levels.append(node)

    def _kept(self, q: np.ndarray, node: np.ndarray, hi: np.ndarray, lo_n: np.ndarray, hi_n: np.ndarray, lo_l: np.ndarray, hi_l: np.ndarray) -> np.ndarray:
        """Which (query, node) pairs may hold a link: by labels, by sizes, and by summed coordinate minima."""
        na = self.n[q]
        size = np.maximum(lo_n[node], need(na))
        may = np.flatnonzero((size <= hi_n[node]) & (DEN * na >= NUM * lo_n[node]) & ((lo_l[node] != self.label[q]) | (hi_l[node] != self.label[q])))
        out = np.zeros(len(q), bool)
        for at in range(0, len(may), BLOCK):
            m = may[at : at + BLOCK]
            out[m] = np.minimum(self.vec[q[m]], hi[node[m]]).sum(axis=1) >= need2(na[m], size[m])
        return out

    def pairs(self, queries: np.ndarray | None = None):
        """(query, other) positions of all pairs of different labels that the bounds leave."""
        q = np.arange(len(self.n)) if queries is None else queries
        step = max(1, min(4096, (1 << 20) // max(1, len(self.n))))
        for at in range(0, len(q) if self.levels else 0, step):
            a = q[at : at + step]
            node = np.zeros(len(a), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                keep = self._kept(a, node, *self.levels[depth])
                a, node = a[keep], node[keep]
                below = len(self.levels[depth - 1][0]) if depth else len(self.n)
                child = (node[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                a = np.repeat(a, self.FAN)
                a, node = a[child < below], child[child < below]
            keep = self._kept(a, node, *self.leaves)
            yield a[keep], self.order[node[keep]]


class Members:
    """The classes of a cell: sets, sizes, and labels that links join."""

    def __init__(self, sets: list[np.ndarray], n: np.ndarray, label: np.ndarray):
        self.sets, self.n = sets, n
        self.label = np.unique(label, return_inverse=True)[1]
        every = np.concatenate(sets)
        width = [len(s) for s in sets]
        seen, at, times = np.unique(every, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)  # only those count for overlaps
        self.bits, words = None, -(-max(1, len(shared)) // 64)
        if len(sets) * words <= BITSET:
            column = np.full(len(seen), -1)
            column[shared] = np.arange(len(shared))
            col, row = column[at], np.repeat(np.arange(len(sets)), width)
            col, row = col[col >= 0], row[col >= 0]
            self.bits = np.zeros((len(sets), words), np.uint64)
            np.bitwise_or.at(self.bits, (row, col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))

    def _overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
        out, step = np.empty(len(a), np.int64), max(1, (1 << 21) // self.bits.shape[1])
        for at in range(0, len(a), step):
            x = slice(at, at + step)
            out[x] = np.bitwise_count(self.bits[a[x]] & self.bits[b[x]]).sum(axis=1, dtype=np.int64)
        return out

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Verifies pairs in whole sets; joins the labels of those that link; returns the links that joined two."""
        out = []
        for at in range(0, len(a), BLOCK):
            x, y = a[at : at + BLOCK], b[at : at + BLOCK]
            keep = self.label[x] != self.label[y]
            x, y = x[keep], y[keep]
            both = self._overlap(x, y)
            linked = np.flatnonzero(DEN * both >= NUM * (self.n[x] + self.n[y] - both))
            up = {}

            def top(v, up=up):
                while up.get(v, v) != v:
                    up[v] = v = up.get(up[v], up[v])
                return v

            for i in linked.tolist():
                r, s = top(int(self.label[x[i]])), top(int(self.label[y[i]]))
                if r != s:
                    up[max(r, s)] = min(r, s)
                    out.append((int(x[i]), int(y[i])))
            if up:
                to = np.arange(int(self.label.max()) + 1)
                for v in up:
                    to[v] = top(v)
                self.label = to[self.label]
        return out


def search(sets: list[np.ndarray], n: np.ndarray, label: np.ndarray, first: int | None = None) -> list[tuple[int, int]]:
    """Links of a cell that join different labels: the hub against all, then every member, through the tree."""
    if len(n) < 2:
        return []
    groups = groups_for(n.max())
    vec = np.stack([vector(s, groups) for s in sets])
    members = Members(sets, n, label)
    out = []
    for q in ([first] if first is not None and len(n) > 2 else []), None:
        if q == []:
            continue
        if (members.label == members.label[0]).all():
            break
        for a, b in CountTree(vec, n, members.label).pairs(None if q is None else np.array(q)):
            if q is None:
                a, b = a[a < b], b[a < b]
            out += members.join(a, b)
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64))


# 0: the order of shingles


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BITS)).astype(np.int64)


def _packed(task: int, count: np.ndarray, docs: int, size: int) -> pa.RecordBatch:
    parts = [zlib.compress(x.tobytes(), 1) for x in np.split(np.minimum(count, 0xFFFFFFFF).astype(np.uint32), PARTS)]
    zero = [0] * (PARTS - 1)
    return pa.RecordBatch.from_arrays([pa.array([task] * PARTS, pa.int32()), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary()), pa.array([docs, *zero], pa.int64()), pa.array([size, *zero], pa.int64())], names=["task", "part", "c", "docs", "bytes"])


def _summed(t: pa.Table) -> pa.Table:
    """The sum of several tasks' parts of the count table."""
    total = np.zeros((1 << BITS) // PARTS, np.uint64)
    for x in t["c"]:
        total += np.frombuffer(zlib.decompress(x.as_buffer()), np.uint32)
    c = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
    return pa.table({"task": pa.array([t["task"][0].as_py() // MERGED], pa.int32()), "part": pa.array([t["part"][0].as_py()], pa.int32()), "c": pa.array([c], pa.binary())})


def _ranks(docs: DataFrame, k: int) -> tuple[np.ndarray, int, int]:
    """Ranks of the cells of the count table (a shingle's cell is its first BITS bits; frequent ones rank high), the number
    of rows and of bytes. The table counts every shingle of every text; its size doesn't depend on the corpus."""

    def run(batches):
        tidy()
        count, wait, n, size = np.zeros(1 << BITS, np.int64), [], 0, 0
        for b in batches:
            s, _ = windows(b.column(0), k)
            wait.append(_cells(s))
            n, size = n + b.num_rows, size + b.column(0).nbytes
            if sum(map(len, wait)) > COUNTED:
                count += np.bincount(np.concatenate(wait), minlength=len(count))
                wait = []
        if n:
            if wait:
                count += np.bincount(np.concatenate(wait), minlength=len(count))
            yield _packed(TaskContext.get().partitionId(), count, n, size)

    parts = stash(docs.select("t").mapInArrow(run, "task int, part int, c binary, docs long, bytes long"), "counts")
    n, size, last = parts.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("task"), F.lit(0))).first()
    while True:
        merged = parts.withColumn("to", F.expr(f"task div {MERGED}")).groupBy("to", "part").applyInArrow(_summed, "task int, part int, c binary")
        last //= MERGED
        if not last:
            break
        old, parts = parts, stash(merged, "counts")
        unstash(old)
    count = np.zeros(1 << BITS, np.uint32)
    width = len(count) // PARTS
    for r in merged.collect():  # PARTS rows of fixed size
        count[r.part * width : (r.part + 1) * width] = np.frombuffer(zlib.decompress(r.c), np.uint32)
    unstash(parts)
    return np.minimum(255, np.round(8 * np.log2(count + 1.0))).astype(np.uint8), n, size


# 1: blocks


def _sketch(docs: DataFrame, kind: str, ranks: np.ndarray, buckets: int, k: int) -> DataFrame:
    """Rows of documents (k, n, dig) and of prefix entries (bucket, keys, digs, ns), the latter once for each class and task."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = ["k", "n", "dig", "bucket", "keys", "digs", "ns"]

    def entries(kind, keys, owner):
        width = [len(x) for x in keys]
        key = np.concatenate(keys)
        dig = np.repeat(np.array([o[0] for o in owner], np.int64), width)
        size = np.repeat(np.array([o[1] for o in owner], np.uint32), width)
        where = ((key & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(where, kind="stable")
        key, dig, size, where = key[order], dig[order], size[order], where[order]
        cuts = np.flatnonzero(np.diff(where, prepend=-1))
        ends = np.append(cuts[1:], len(where))
        blobs = [pa.array([x[a:e].tobytes() for a, e in zip(cuts, ends, strict=True)], pa.binary()) for x in (key, dig, size)]
        return pa.RecordBatch.from_arrays([pa.nulls(len(cuts), kind), *(pa.nulls(len(cuts), pa.int64()) for _ in range(2)), pa.array(where[cuts]), *blobs], names=names)

    def run(batches):
        tidy()
        rank, known = shared.value, set()  # digests of the classes that this task has sent
        keys, owner, wait, ids = [], [], 0, None
        for b in batches:
            ids = b.column(0)
            own = sets(b.column(1), k)
            ns, digs = [len(s) for s in own], [digest(s) for s in own]
            for s, d in zip(own, digs, strict=True):
                if len(s) and d not in known:
                    known.add(d)
                    p = s[np.argsort(rank[_cells(s)], kind="stable")[: len(s) - need(len(s)) + 1]]
                    keys.append(p)
                    owner.append((d, len(s)))
                    wait += len(p)
            m = len(ns)
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(digs, pa.int64()), pa.nulls(m, pa.int32()), *(pa.nulls(m, pa.binary()) for _ in range(3))], names=names)
            if wait > FLUSH:
                yield entries(ids.type, keys, owner)
                keys, owner, wait = [], [], 0
        if keys:
            yield entries(ids.type, keys, owner)

    return docs.mapInArrow(run, f"k {kind}, n long, dig long, bucket int, keys binary, digs binary, ns binary")


def _joined(col: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in col), kind)


def _counted(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, hub: bool) -> list[pa.Array]:
    """Distinct pairs with their sizes and counts."""
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
    return [*map(_long, (a[first], b[first], na[first], nb[first], np.diff(np.append(first, len(a))))), pa.array([hub] * len(first), pa.bool_())]


PAIRS = "a long, b long, na long, nb long, c long, hub boolean"


def _blocks(t: pa.Table) -> pa.Table:
    """Of a bucket: pairs of the small blocks (a > b, with the number of blocks that they share), and of each member of a
    larger block with its least (hub)."""
    key, dig, n = _joined(t["keys"], np.uint64), _joined(t["digs"], np.int64), _joined(t["ns"], np.uint32).astype(np.int64)
    order = np.argsort(key)
    twice = key[order][1:] == key[order][:-1]
    order = order[np.concatenate([twice, [False]]) | np.concatenate([[False], twice])] if len(order) else order
    key, dig, n = key[order], dig[order], n[order]
    order = np.lexsort((dig, n, key))
    key, dig, n = key[order], dig[order], n[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (dig[1:] != dig[:-1])  # one class from several tasks
    key, dig, n = key[fresh], dig[fresh], n[fresh]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (DEN * n[:-1] < NUM * n[1:])
    cuts = np.flatnonzero(new)
    width = np.diff(np.append(cuts, len(key)))
    names = ["a", "b", "na", "nb", "c", "hub"]
    few = []
    for m in range(2, FEW + 1):
        base = cuts[width == m][:, None]
        i, j = np.triu_indices(m, 1)
        i, j = (base + i).ravel(), (base + j).ravel()
        keep = fits(n[i], n[j])
        few.append((i[keep], j[keep]))
    i, j = (np.concatenate([x[z] for x in few]) for z in (0, 1))
    i, j = np.where(dig[i] > dig[j], i, j), np.where(dig[i] > dig[j], j, i)
    parts = [pa.table(_counted(dig[i], dig[j], n[i], n[j], False), names=names)]
    large = np.flatnonzero(width > FEW)
    if len(large):
        w = width[large]
        at = np.repeat(cuts[large] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        block = np.repeat(np.arange(len(large)), w)
        low = np.lexsort((dig[at], block))
        head = at[low[np.cumsum(w) - w]][block]
        own = at != head
        parts.append(pa.table(_counted(dig[at[own]], dig[head[own]], n[at[own]], n[head[own]], True), names=names))
    tidy()
    return pa.concat_tables(parts)


# 2 and 3: cells


def _numpy(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t[c].to_numpy() for c in names]


LINKS = "a long, b long"


def _searched(t: pa.Table) -> pa.Table:
    """Of several cells: links that join different labels. `side` is null, or tells what is compared with what: 0 with 1,
    and 0 with 0 if the cell has no 1."""
    kept("cells", bool)
    cell, dig, n, label, side = _numpy(t, "cell", "dig", "n", "label", "side")
    order = np.lexsort((dig, cell))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (cell[order][1:] != cell[order][:-1]) | (dig[order][1:] != dig[order][:-1])
    order = order[fresh]
    cuts = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1]])) if len(order) else []
    s, out = t["s"].combine_chunks(), []
    for rows in np.split(order, cuts[1:]):
        own = [np.frombuffer(s[int(r)].as_buffer(), np.uint64) for r in rows]
        hub = np.flatnonzero(dig[rows] == t["hub"][int(rows[0])].as_py()) if len(rows) > 2 else []
        one = side[rows] == 1
        if one.any() and not one.all():
            links = _across(own, n[rows], label[rows], one)
        else:
            links = search(own, n[rows], label[rows], int(hub[0]) if len(hub) else None)
        out += [(int(dig[rows[x]]), int(dig[rows[y]])) for x, y in links]
    tidy()  # what a large cell took goes back before the next one
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _across(own: list[np.ndarray], n: np.ndarray, label: np.ndarray, one: np.ndarray) -> list[tuple[int, int]]:
    """Links between the two sides of a cell."""
    vec = np.stack([vector(s, groups_for(n.max())) for s in own])
    members, out = Members(own, n, label), []
    for a, b in CountTree(vec, n, members.label).pairs(np.flatnonzero(~one)):
        out += members.join(a[one[b]], b[one[b]])
    return out


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(dig, s) of the classes (dig, k) in ids: from the document with the key k; where that is null, from the rows without a key."""

    def made(wanted=None):
        def run(batches):
            tidy()
            sent = set()
            for b in batches:
                own = sets(b.column(0), k)
                digs = [digest(s) for s in own]
                if wanted is not None:  # copies in one task are sent once
                    fresh = [i for i, d in enumerate(digs) if (not wanted.value or d in wanted.value) and not (d in sent or sent.add(d))]
                    own, digs = [own[i] for i in fresh], [digs[i] for i in fresh]
                yield pa.RecordBatch.from_arrays([pa.array(digs, pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], names=["dig", "s"])

        return run

    keyed, nameless = ids.where("k IS NOT NULL").select("k"), ids.where("k IS NULL").select("dig")
    few = keyed.count() <= BROADCAST_IDS
    out = docs.join(F.broadcast(keyed) if few else keyed, "k", "left_semi").select("t").mapInArrow(made(), "dig long, s binary")
    if n := nameless.count():
        wanted = docs.sparkSession.sparkContext.broadcast({r.dig for r in nameless.collect()} if n <= BROADCAST_IDS else set())
        more = docs.where("k IS NULL").select("t").mapInArrow(made(wanted), "dig long, s binary")
        out = out.union((more if n <= BROADCAST_IDS else more.join(nameless, "dig", "left_semi")).dropDuplicates(["dig"]))
    return stash(out, "sets")  # a dig twice only if a key repeats


def _dealt(cells: DataFrame, sets: DataFrame, spark: SparkSession) -> DataFrame:
    """Searches the cells (cell, hub, dig, n, label, side), several of them in one go."""
    size = cells.agg(F.sum("n")).first()[0] or 0
    together = max(-(-size // TOGETHER), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    go = F.pmod(F.xxhash64("cell"), F.lit(together)).alias("go")
    return cells.join(sets, "dig").select(go, "cell", "hub", "dig", "n", "label", "side", "s").groupBy("go").applyInArrow(_searched, LINKS)


def _text(*parts: Column | str) -> Column:
    return F.concat_ws(":", *parts)


def _chunked(members: DataFrame) -> DataFrame:
    """Cells in chunks of about CELL shingles, each with the hub."""
    sizes = members.groupBy("hub").agg(F.sum("n").alias("total")).where(f"total > {CELL}")
    m = members.join(sizes, "hub", "left").withColumn("chunks", F.expr(f"coalesce(int(ceil(total / {CELL})), 1)"))
    every = F.when(F.col("dig") == F.col("hub"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("dig"), F.col("chunks")).cast("int")))
    return m.withColumn("chunk", F.explode(every)).select(F.when(F.col("chunks") > 1, _text("hub", "chunk")).otherwise(F.col("hub").cast("string")).alias("cell"), "hub", "dig", "n", F.col("dig").alias("label"), F.lit(0).alias("side"))


def _hot(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(hub, dig, n, label) of the cells of several chunks."""
    sizes = members.groupBy("hub").agg(F.sum("n").alias("total")).where(f"total > {CELL}")
    return members.join(sizes.select("hub"), "hub").join(labels.toDF("dig", "l"), "dig", "left").select("hub", "dig", "n", F.coalesce("l", "dig").alias("label"))


def _crossed(m: DataFrame) -> DataFrame:
    """Of hot cells that still hold several components: chunk against chunk. The largest component's classes (side 1) meet
    every chunk of the others; the others meet each other."""
    parts = m.groupBy("hub", "label").agg(F.sum("n").alias("n"))
    top = parts.groupBy("hub").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("total")).where("total > top.n")
    top = top.select("hub", F.col("top.label").alias("main"), F.expr(f"int(ceil(top.n / {CELL / 2}))").alias("mains"), F.expr(f"int(ceil((total - top.n) / {CELL / 2}))").alias("others"))
    m = m.join(top, "hub").withColumn("side", (F.col("label") == F.col("main")).cast("int"))
    m = m.withColumn("chunk", F.pmod(F.xxhash64("dig"), F.when(F.col("side") == 1, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    with_mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: F.struct(_text("hub", F.lit("m"), F.col("chunk").cast("string"), j.cast("string")).alias("cell"), F.lit(0).alias("side")))
    with_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(_text("hub", F.lit("o"), F.least("chunk", j).cast("string"), F.greatest("chunk", j).cast("string")).alias("cell"), (j < F.col("chunk")).cast("int").alias("side")))
    as_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(_text("hub", F.lit("m"), j.cast("string"), F.col("chunk").cast("string")).alias("cell"), F.lit(1).alias("side")))
    m = m.withColumn("to", F.explode(F.when(F.col("side") == 1, as_main).otherwise(F.concat(with_mains, with_others))))
    return m.select("to.cell", "hub", "dig", "n", "label", "to.side")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """Rows (key, n_shingles, component_id): component_id is the least key that links lead to."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    ranks, _, size = _ranks(docs, k)
    buckets = max(1, -(-size // (24 * ENTRIES)))
    sketch = stash(_sketch(docs, kind, ranks, buckets, k), "sketch")
    rows = stash(sketch.where("bucket IS NULL").select("k", "n", "dig"), "rows")
    pairs = stash(sketch.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(_blocks, PAIRS), "blocks")
    unstash(sketch)

    # a pair that shares c prefix shingles overlaps in at most c and what one of them has behind its prefix
    bound = f"c + ceil({NUM} * greatest(na, nb) / {DEN}) - 1 >= ceil({NUM} * (na + nb) / {NUM + DEN})"
    found = pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("hub").alias("h"), F.first("na").alias("na"), F.first("nb").alias("nb")).where(f"h OR {bound}")
    found = stash(found.select("a", "b", "na", "nb"), "found")
    unstash(pairs)
    members = found.select(F.col("b").alias("hub"), F.col("a").alias("dig"), F.col("na").alias("n")).union(found.select("b", "b", "nb").distinct())

    firsts = rows.where("n > 0").groupBy("dig").agg(F.min("k").alias("k"))  # null if no row of the class has a key
    ids = stash(firsts.join(members.select("dig").distinct(), "dig"), "ids")
    own = _sets(docs, ids, k)
    links = stash(_dealt(_chunked(members), own, spark), "links")
    label, tables = components(links), [links, ids]
    if not members.groupBy("hub").agg(F.sum("n").alias("total")).where(f"total > {CELL}").isEmpty():
        hot = stash(_hot(members, label), "hot")
        more = stash(_dealt(_crossed(hot), own, spark), "links")
        tables += [hot, more, label]
        label = components(links.union(more))
    linked = firsts.join(label.toDF("dig", "l"), "dig")
    named = linked.join(linked.groupBy("l").agg(F.min("k").alias("c")), "l").select("dig", "c")
    tops = stash(firsts.join(named, "dig", "left").select("dig", F.coalesce("c", "k").alias("c")), "tops")
    for t in (own, found, label, *tables):
        unstash(t)
    return rows.join(tops, "dig", "left").select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("k")).when(F.col("k").isNotNull(), F.col("c")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
