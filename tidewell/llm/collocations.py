"""Operator 11: phrase collocations, from word-id suffix arrays of shards.

1. Shards: the texts of a partition are cut into pieces at punctuation, and the
   pieces of a language into words; about SHARD words are a shard, a row with
   word ids (0 ends a piece) and its words with their counts. A long text is
   spread over shards at the ends of pieces.
2. Words: counts are summed by (language, word). A word of fewer than LEAST
   occurrences can be in no candidate, so it ends a piece from here on; a
   frequent one gets the number of its first place in the shards as its id,
   the same in all shards.
3. Pairs: a suffix array of each shard's word ids, by numpy prefix doubling; the
   intervals of its LCP array of two or more are the distinct pairs with their
   counts, which are summed by key: a shard's pairs go to buckets of their hashes,
   a row for each, and a bucket sorts the pairs of all shards.
4. Longer phrases: only where each pair in it is frequent. The suffix array of
   what is left gives the phrases of 3 to 5 words; summed by key again.
5. Scores: cuts are joined to the counts of both parts; phrases inside a longer
   one of the same count go; the best of a language are taken from buckets first.

Counts are exact: a phrase of LEAST occurrences consists of parts of at least as
many. Nothing is broadcast but the languages' totals up to TOTALS of them; ids
reach the shards by a co-grouped shuffle. Every piece is whole in one shard, so
the memory of a task grows with the longest piece only.

Nulls: a null text counts as empty; a null language is `und`. Empty texts have
no words. Repeated rows count again. Empty tables give no rows. Extra columns
are ignored. Ids of documents aren't used.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import kept, stash, table, tidy, unstash
from tidewell.llm.shingle import mix

#: Words of a candidate; its least count; phrases of a language that are returned; share of a longer phrase's count, in percent, that drops a part of it.
LONGEST, LEAST, TOP, INSIDE = 5, 100, 2000, 100
#: Words of a shard; bytes that are split at once; bits of a word's place in its shard, of a shard's number in its partition.
SHARD, BLOCK, PLACE_BITS, PART_BITS = 1 << 21, 1 << 22, 28, 15
#: Languages whose totals are broadcast; candidates of a bucket.
TOTALS, BUCKET = 100_000, 200_000
#: Words of the corpus for each bucket in which counts of shards are summed.
ENTRIES = 1_000_000
#: A-Z to lower case, what ends a piece to a line feed, tabs to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


# 1: shards


class _Shard:
    """Word ids of a language's pieces so far: 1 and up, 0 at the end of a piece."""

    def __init__(self):
        self.words, self.parts, self.size = {}, [], 0

    def add(self, data: bytes) -> None:
        """Folded text that ends with the end of a piece."""
        coded = pa.array(data.replace(b"\n", b" \n ").split(b" "), pa.binary()).dictionary_encode()
        to = np.array([-1 if not w else 0 if w == b"\n" else self.words.setdefault(w, len(self.words) + 1) for w in coded.dictionary.to_pylist()], np.int32)
        ids = to[coded.indices.to_numpy()]
        self.parts.append(squeezed(ids[ids >= 0]))
        self.size += len(self.parts[-1])

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        ids = squeezed(np.concatenate(self.parts))
        count = np.bincount(ids, minlength=len(self.words) + 1)[1:]
        cols = [pa.array([number]), pa.array([lang], pa.string()), pa.array([int(count.sum())]), pa.array([ids.tobytes()], pa.binary()), pa.array([list(self.words)], pa.list_(pa.binary())), pa.array([count], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=["shard", "lang", "n", "ids", "words", "counts"])


def squeezed(ids: np.ndarray) -> np.ndarray:
    """Without zeros at the begin and behind zeros."""
    keep = ids != 0
    keep[1:] |= ids[:-1] != 0
    return ids[keep]


def blocks(texts: list[bytes], size: int = BLOCK):
    """Folded texts, each ended, in blocks that end with a piece."""
    data, wait = [], 0
    for t in texts:
        data.append(t)
        wait += len(t)
        if wait < size:
            continue
        whole, at = (b"\n".join(data) + b"\n").translate(_FOLD), 0
        while at < len(whole):
            end = whole.find(b"\n", at + size)
            end = len(whole) if end < 0 else end + 1
            yield whole[at:end]
            at = end
        data, wait = [], 0
    if data:
        yield (b"\n".join(data) + b"\n").translate(_FOLD)


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SHARD) -> DataFrame:
    """Rows (shard, lang, n, ids, words, counts)."""

    def run(batches):
        tidy()
        held: dict[str, _Shard] = {}
        made = 0

        def closed(name):
            nonlocal made
            shard = held.pop(name)
            if shard.words:
                made += 1
                yield shard.row(TaskContext.get().partitionId() << PART_BITS | (made - 1), name)

        for b in batches:
            names = b.column(1).dictionary_encode()
            for i, name in enumerate(names.dictionary.to_pylist()):
                own = b.column(0).filter(pc.equal(names.indices, i)).cast(pa.binary()).to_pylist()
                for data in blocks(own):
                    held.setdefault(name, _Shard()).add(data)
                    if held[name].size >= size:
                        yield from closed(name)
        for name in list(held):
            yield from closed(name)

    d = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("l"))
    return d.mapInArrow(run, "shard long, lang string, n long, ids binary, words array<binary>, counts array<long>")


# 2: words


def words(cut: DataFrame, least: int) -> DataFrame:
    """Rows (shard, place, id, word) of the frequent words of every shard; word (lang, w, f) stands once for each id."""
    each = cut.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select("shard", "lang", "place", F.col("x.words").alias("w"), F.col("x.counts").alias("c"))
    each = each.withColumn("own", F.shiftleft("shard", PLACE_BITS).bitwiseOR(F.col("place").cast("long")))
    same = Window.partitionBy("lang", "w")
    each = each.withColumns({"f": F.sum("c").over(same), "id": F.min("own").over(same)}).where(F.col("f") >= least)
    return each.select("shard", "place", "id", F.when(F.col("own") == F.col("id"), F.struct("lang", "w", "f")).alias("word"))


# 3 and 4: suffix arrays


def room(bond: np.ndarray) -> np.ndarray:
    """Words from each position to the end of its run; bond: whether a word is followed by one of the same run."""
    ends = np.flatnonzero(~bond)
    return ends[np.searchsorted(ends, np.arange(len(bond)))] - np.arange(len(bond)) + 1


def phrases(ids: np.ndarray, left: np.ndarray, least: int, longest: int):
    """Yields (length, starts, counts) of the distinct phrases of least to longest words.

    ids: word ids, `left`: words from each position to the end of its run. The suffix array of all positions comes from
    ranks by the first 1, 2, 4, ... words; the LCP of neighbours from the same ranks; a phrase of some length is an
    interval of suffixes whose LCP is no less."""
    n = len(ids)
    if not n:
        return
    ranks, h, rank = {}, 1, ids.astype(np.int64)
    while True:
        ranks[h] = rank
        at = np.minimum(np.arange(n) + h, n - 1)
        key = rank * (int(rank.max()) + 2) + np.where(left > h, rank[at] + 1, 0)
        if 2 * h >= longest:
            break
        rank, h = np.unique(key, return_inverse=True)[1], 2 * h
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n - 1, np.int64)
    sizes = sorted(ranks, reverse=True)
    for h in sizes if sizes[0] * 2 > longest else [sizes[0], *sizes]:
        x, y = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        lcp += h * ((left[a] - lcp >= h) & (left[b] - lcp >= h) & (ranks[h][x] == ranks[h][y]))
    for size in range(least, longest + 1):
        begin = np.flatnonzero(np.concatenate([[True], lcp < size]))
        count = np.diff(np.append(begin, n))
        own = left[order[begin]] >= size
        yield size, order[begin[own]], count[own]


def _numbers(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.int64))


#: Rows of counted phrases: those of a shard, of `size` words each, whose hashes fall into a bucket (`w` ids, `c` counts).
COUNTED = "bucket int, size int, shard long, lang string, w binary, c binary, ids binary, own binary"
_COUNTED = pa.schema([("bucket", pa.int32()), ("size", pa.int32()), ("shard", pa.int64()), ("lang", pa.string()), *((c, pa.binary()) for c in ("w", "c", "ids", "own"))])


def _entries(w: np.ndarray, count: np.ndarray, buckets: int, shard: int, lang: str) -> pa.Table:
    """Counted phrases (a matrix of ids) in their buckets."""
    if not len(w):
        return _COUNTED.empty_table()
    h = np.zeros(len(w), np.uint64)
    for x in w.T:
        h = mix(h ^ x.astype(np.uint64))
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, w, count = bucket[order], np.ascontiguousarray(w[order], np.int64), count[order].astype(np.int64)
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    end, m = np.append(begin[1:], len(bucket)), len(begin)
    parts = [pa.array([x[i:j].tobytes() for i, j in zip(begin, end, strict=True)], pa.binary()) for x in (w, count)]
    return pa.table([pa.array(bucket[begin], pa.int32()), pa.array([w.shape[1]] * m, pa.int32()), pa.array([shard] * m, pa.int64()), pa.array([lang] * m, pa.string()), *parts, *(pa.nulls(m, pa.binary()),) * 2], schema=_COUNTED)


def _pairs(shard: pa.Table, known: pa.Table, buckets: int) -> pa.Table:
    """Of a shard: its pairs of frequent words with their counts, and one row with the ids of its runs (numbers in `own`)."""
    kept("suffix arrays", bool)
    place, number = (known[c].to_numpy() for c in ("place", "id"))
    if not shard.num_rows or not len(place):
        return _COUNTED.empty_table()
    name, lang = shard["shard"][0].as_py(), shard["lang"][0].as_py()
    ids = np.frombuffer(shard["ids"][0].as_buffer(), np.int32)
    own = np.sort(number)
    to = np.zeros(int(max(ids.max(), place.max() + 1)) + 1, np.int32)
    to[place + 1] = np.searchsorted(own, number) + 1
    ids = to[ids]
    bond = ids[:-1] * ids[1:] != 0 if len(ids) > 1 else np.zeros(0, bool)
    near = np.concatenate([bond, [False]])
    near[1:] |= bond
    ids = squeezed(np.where(near, ids, 0))  # words alone are in no pair
    if not len(ids):
        return _COUNTED.empty_table()
    left = room(np.append((ids[:-1] != 0) & (ids[1:] != 0), False))
    ((_, start, count),) = phrases(ids, np.where(ids == 0, 0, left), 2, 2)
    runs = pa.table([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([name]), pa.array([lang], pa.string()), *(pa.nulls(1, pa.binary()),) * 2, pa.array([ids.tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary())], schema=_COUNTED)
    return pa.concat_tables([_entries(own[ids[start[:, None] + np.arange(2)] - 1], count, buckets, name, lang), runs])


def _longer(shard: pa.Table, known: pa.Table, longest: int, buckets: int) -> pa.Table:
    """Of a shard: its phrases of three and more words in which every pair is frequent, with their counts."""
    kept("suffix arrays", bool)
    if not shard.num_rows or not known.num_rows:
        return _COUNTED.empty_table()
    ids = np.frombuffer(shard["ids"][0].as_buffer(), np.int32).astype(np.int64)
    own = np.frombuffer(shard["own"][0].as_buffer(), np.int64)
    a, b = (np.searchsorted(own, x) + 1 for x in np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in known["w"]]).reshape(-1, 2).T)
    frequent = np.sort(a * (len(own) + 1) + b)
    pair = ids[:-1] * (len(own) + 1) + ids[1:]
    bond = np.append(frequent[np.minimum(np.searchsorted(frequent, pair), len(frequent) - 1)] == pair, False)
    run = np.cumsum(np.append(0, ~bond[:-1]))
    keep = np.bincount(run)[run] >= 3
    ids, left = ids[keep], room(bond)[keep]
    out = [_entries(own[ids[start[:, None] + np.arange(size)] - 1], count, buckets, shard["shard"][0].as_py(), shard["lang"][0].as_py()) for size, start, count in phrases(ids, left, 3, longest)]
    return pa.concat_tables(out) if out else _COUNTED.empty_table()


#: Rows of frequent phrases (lang, w, f), and of those of a shard (shard, own).
SUMMED = "lang string, w array<long>, f long, shard long, own binary"
_SUMMED = pa.schema([("lang", pa.string()), ("w", pa.list_(pa.int64())), ("f", pa.int64()), ("shard", pa.int64()), ("own", pa.binary())])


def _merged(t: pa.Table, least: int) -> pa.Table:
    """Of a bucket: its phrases of at least so many occurrences in all shards; pairs also for each shard that has them."""
    kept("suffix arrays", bool)
    out = []
    sizes, shard, lang = t["size"].to_numpy(), t["shard"].to_numpy(), t["lang"].to_pylist()
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        w, c = (np.frombuffer(b"".join(t[x][int(i)].as_buffer() for i in rows), np.int64) for x in ("w", "c"))
        w = w.reshape(-1, size)
        row = np.repeat(rows, [len(t["c"][int(i)].as_buffer()) // 8 for i in rows])
        order = np.lexsort(w.T[::-1])
        w, c, row = w[order], c[order], row[order]
        begin = np.flatnonzero(np.append(True, (w[1:] != w[:-1]).any(axis=1)))
        f = np.add.reduceat(c, begin)
        often = f >= least
        at, m = begin[often], int(often.sum())
        out.append(pa.table([pa.array([lang[i] for i in row[at]], pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(0, m * size + 1, size), pa.int32()), _numbers(w[at].ravel())), _numbers(f[often]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], schema=_SUMMED))
        if size == 2:
            there = np.flatnonzero(np.repeat(often, np.diff(np.append(begin, len(c)))))
            there = there[np.argsort(shard[row[there]], kind="stable")]
            name = shard[row[there]]
            begin = np.flatnonzero(np.diff(name, prepend=-1))
            own = pa.array([w[x].tobytes() for x in np.split(there, begin[1:])] if len(there) else [], pa.binary())
            m = len(begin)
            out.append(pa.table([pa.nulls(m, pa.string()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.int64()), _numbers(name[begin]), own], schema=_SUMMED))
    return pa.concat_tables(out) if out else _SUMMED.empty_table()


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, size: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, names, totals), stashed: phrases (lang, w, f), w the ids of one to `longest` words, of `least` occurrences
    and more; names (id, word) of the frequent words; totals (lang, n)."""
    cut = stash(shards(docs, text, lang, size), "shards")
    known = stash(words(cut, least), "words")
    totals = stash(cut.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    each = known.select("shard", "place", "id")
    total = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // ENTRIES))

    def merge(t: pa.Table) -> pa.Table:
        return _merged(t, least)

    got = stash(cut.select("shard", "lang", "ids").groupBy("shard").cogroup(each.groupBy("shard")).applyInArrow(partial(_pairs, buckets=buckets), COUNTED), "pairs")
    unstash(cut)
    two = stash(got.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(merge, SUMMED), "frequent")
    one = known.where("word IS NOT NULL").select("word.lang", F.array("id").alias("w"), "word.f")
    found = one.union(two.where("f IS NOT NULL").select("lang", "w", "f"))
    if longest > 2:
        runs = got.where("ids IS NOT NULL").select("shard", "lang", "ids", "own")
        there = two.where("own IS NOT NULL").select("shard", F.col("own").alias("w"))
        more = runs.groupBy("shard").cogroup(there.groupBy("shard")).applyInArrow(partial(_longer, longest=longest, buckets=buckets), COUNTED)
        found = found.union(more.groupBy("bucket").applyInArrow(merge, SUMMED).select("lang", "w", "f"))
    out = stash(found, "phrases")
    names = stash(known.where("word IS NOT NULL").select("id", F.col("word.w").cast("string").alias("word")), "names")
    for t in (known, got, two):
        unstash(t)
    return out, names, totals


# 5: scores


def scored(found: DataFrame, totals: DataFrame, inside: int = INSIDE) -> DataFrame:
    """Rows (lang, w, a, l, r, n, score) of the phrases of two and more words that no longer one holds as often."""
    long = found.where(F.size("w") > 1)
    cuts = long.select("lang", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("w", F.lit(1), F.col("k")).alias("x"), F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")).alias("y"))
    part = found.select("w", "f")
    cuts = cuts.join(part.toDF("x", "l"), "x").join(part.toDF("y", "r"), "y")
    few = totals.count() <= TOTALS
    cuts = cuts.join(F.broadcast(totals) if few else totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731  exact up to 38 digits
    cuts = cuts.withColumns({"top": wide("a") * wide("n") * F.lit(1000).cast("decimal(38,0)"), "bottom": wide("l") * wide("r")})
    best = cuts.withColumn("score", F.expr("top div bottom")).groupBy("w").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("m"))
    # what lies in a longer phrase also lies in one that is longer by a word, and that one is as frequent at least
    held = found.where(F.size("w") > 2).select(F.explode(F.array(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"))).alias("w"), "f").groupBy("w").agg(F.max("f").alias("longer"))
    best = best.join(held, "w", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    return best.select("lang", "w", "a", "m.l", "m.r", "n", "m.score")


def _first(rows: DataFrame, top: int, order: list[Column], rank, bucket: int = BUCKET) -> DataFrame:
    """Rows of each language's first, taken in buckets before they meet."""
    buckets = max(1, -(-rows.count() // bucket))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("w"), F.lit(buckets)))
    for by in ("lang", "_b"), ("lang",):
        rows = rows.withColumn("rank", rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return rows.drop("_b")


def ranked(best: DataFrame, names: DataFrame, top: int = TOP) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first by score, count and phrase."""
    by = [F.desc("score"), F.desc("a")]
    near = stash(_first(best, top, by, F.rank).drop("rank"), "near")
    each = near.select("w", F.posexplode("w").alias("i", "id")).join(names, "id")
    text = each.groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = stash(near.join(text, "w"), "named")
    unstash(near)
    first = _first(out, top, [*by, F.asc("phrase")], F.row_number)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, least: int = LEAST, **how) -> DataFrame:
    found, names, totals = counts(docs, text, lang, least=least, **how)
    best = stash(scored(found, totals), "scored")
    out = stash(ranked(best, names, top), "collocations")
    for t in (found, names, totals, best):
        unstash(t)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, ws[s : s + k - 1] AS w FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM p, range(1, 6) AS r(k) WHERE len(ws) >= k)) GROUP BY lang, w HAVING count(*) >= 100),
c AS (SELECT lang, w, f AS a, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
s AS (SELECT c.lang, c.w, c.a, c.k, l.f AS l, r.f AS r, t.n, (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.w = c.w[1 : c.k] JOIN f r ON r.lang = c.lang AND r.w = c.w[c.k + 1 :] JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
i AS (SELECT lang, sub, max(f) AS longer FROM (SELECT lang, f, w[x : x + m - 1] AS sub FROM (SELECT lang, w, f, m, unnest(range(1, len(w) - m + 2)) AS x FROM f, range(2, 5) AS q(m) WHERE len(w) > m)) GROUP BY lang, sub)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank, array_to_string(w, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b LEFT JOIN i ON i.lang = b.lang AND i.sub = b.w WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY rank <= 2000
"""
