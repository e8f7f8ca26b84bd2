"""Operator 7: benchmark decontamination by one Aho-Corasick automaton.

Every benchmark item gives its windows of 13 consecutive words (an item of
fewer words is one window). All windows go into one automaton over normalised
text (words joined by single spaces). Each document is scanned once; every
occurrence is mapped to words and, for the spans, to the characters of the
original text.

Size of what executors get: windows are counted before they are collected. Up
to MAX_WINDOWS they form one automaton; beyond that the items are split by
hash into several automata of at most about that size. A task then takes its
documents in blocks of about BLOCK bytes, scans a block with one automaton after
the other (each is built once a block, and one is held at a time), and merges the
hit words.

Nulls: a null text (document or item) has no words: n_hit 0, not contaminated. An
item with a null id gives hit words like any other, but is not among the items.
Empty tables give no rows or no hits. Repeated rows are judged row by row; item
ids that repeat count once. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import kept, table

#: Words of a window; windows of one automaton (about 200 bytes each on an executor); a document is contaminated at this share of hit words.
WINDOW, MAX_WINDOWS, SHARE = 13, 1_000_000, 20
#: Bytes of text that are scanned with one of several automata before the next is built.
BLOCK = 1 << 25
#: A-Z to lower case; bytes outside 0-9, a-z and 0x80-0xFF to a space. Byte for byte, so offsets stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def windows_of(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class Scanner:
    """The automaton of some items: (item_id as string, text)."""

    def __init__(self, items, size: int = WINDOW):
        import ahocorasick

        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows_of(fold(text).split(), size):
                owners.setdefault(w, set()).update(() if item is None else (str(item),))
        self.automaton = ahocorasick.Automaton()
        for w, ids in owners.items():
            self.automaton.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(ids)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]):
        """Hit flags of the words (None without hits), and the items that occur."""
        if self.empty or not words:
            return None, set()
        hay = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(hay.decode("latin-1")))
        if not found:
            return None, set()
        at = np.flatnonzero(np.frombuffer(hay, np.uint8) == 32)
        last = np.searchsorted(at, np.array([e for e, _ in found])) - 1
        n = np.array([v[0] for _, v in found])
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, last - n + 1, 1)
        np.add.at(edge, last + 1, -1)
        return np.cumsum(edge[:-1]) > 0, {i for _, v in found for i in v[1]}


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Character spans [start, end) of the runs of hit words in the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", fold(text))]
    runs = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    chars = lambda b: len(raw[:b].decode("utf-8", "surrogatepass"))
    return [{"start": chars(at[a][0]), "end": chars(at[b - 1][1])} for a, b in zip(runs[::2], runs[1::2], strict=True)]


def _scanner(mark: str, shared, size: int) -> Scanner:
    """The automaton of a broadcast list of items, built once in each Python worker; mark names the broadcast."""
    return kept(f"automaton {mark} {size}", lambda: Scanner(shared.value, size))


def _forget(shared) -> None:
    """Drops this worker's copy of a broadcast list; it is read again from the executor's disk when it is needed."""
    if getattr(shared, "_path", None):
        shared.__dict__.pop("_value", None)


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Rows (key, n_words, n_hit, items, spans): one for each document row."""
    spark = docs.sparkSession
    bench = items.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    most = bench.agg(F.sum(F.length("t"))).first()[0] or 0  # a window starts at a word, so there are fewer windows than half the characters
    parts = max(1, -(-most // (2 * max_windows)))
    shared = [(uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).toLocalIterator()])) for k in range(parts)]
    kind = docs.schema[key].dataType.simpleString()

    def blocks(batches):
        """Batches with their folded words; with several automata, as many as make up BLOCK bytes."""
        wait, size = [], 0
        for b in batches:
            wait.append((b, [fold(t).split() for t in texts_of(b)]))
            size += b.nbytes
            if len(shared) == 1 or size >= BLOCK:
                yield wait
                wait, size = [], 0
        if wait:
            yield wait

    def texts_of(b):
        return (b.column(1) if b.num_columns > 1 else b.column(0).field(text)).to_pylist()

    def scan(batches):
        for block in blocks(batches):
            hits, ids = [[None] * len(ws) for _, ws in block], [[set() for _ in ws] for _, ws in block]
            for mark, s in shared:
                scanner = _scanner(mark, s, size)
                for (_, ws), h, x in zip(block, hits, ids, strict=True):
                    for j, w in enumerate(ws):
                        got, i = scanner.scan(w)
                        h[j] = got if h[j] is None else h[j] if got is None else h[j] | got
                        x[j] |= i
                if len(shared) > 1:
                    del scanner
                    _forget(s)
            for (b, ws), h, x in zip(block, hits, ids, strict=True):
                found, spans = [sorted(i) for i in x], [[] if g is None else spans_of(t, g) for t, g in zip(texts_of(b), h, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(w) for w in ws], pa.int64()), pa.array([0 if g is None else int(g.sum()) for g in h], pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["k", "n_words", "n_hit", "items", "spans"],
                )

    own = [F.col(key).alias("k")] + ([F.col(text).alias("t")] if text in docs.columns else [])  # else a field of the key
    out = docs.select(*own).mapInArrow(scan, f"k {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")
    return out.withColumnRenamed("k", key)


def judged(found: DataFrame, share: int = SHARE) -> DataFrame:
    """With n_items and contaminated: at least one hit word, and at least one in `share` words."""
    return found.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows that aren't contaminated, with all their columns, in one pass over the texts."""
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    got = judged(find(row, items, key="_row", text=text)).where(~F.col("contaminated"))
    return got.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judged(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def brute(text: str | None, items, size: int = WINDOW):
    """The contract word by word, for tests: (n_words, n_hit, n_items, sha256, contaminated)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, ids = split(text), set(), set()
    for item, t in items:
        w = split(t)
        n = min(size, len(w))
        for a in range(len(w) - n + 1) if w else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[a : a + n]:
                    hit.update(range(j, j + n))
                    ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[s : s + least(13, len(ws)) - 1], ' ') AS win
       FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS s FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(ws[s : s + n - 1], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes WHERE len(ws) >= n)),
m AS (SELECT doc_id, s, dw.n, item FROM dw JOIN iw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
g AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""
