"""Operator 3: token counts, with overlap resynchronisation for huge documents.

A document of up to CHUNK characters is one chunk, encoded part by part (see
`encoding`). Every longer one is encoded by the library in chunks of that size
that overlap, with offsets. Two neighbouring
chunks are spliced at a boundary that both have inside their overlap and that
is proven stable: the text there is a space followed by a character other than
white space, where the pretokens always break whatever stands around. Where an
overlap holds no such boundary, it is widened twofold, up to the whole rest.

Nulls: a null text counts as empty: 0 bytes, 0 tokens. Texts are counted whole;
repeated rows are counted row by row; empty tables give no rows. Extra columns
are ignored. Special tokens' strings inside texts follow the library's default.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import encoding
from tidewell.llm.common import table

#: Characters of a chunk; of the first overlap tried. Limit of the report.
CHUNK, OVERLAP, LIMIT = 8192, 64, 512


def stable(text: str, at: int) -> bool:
    """Whether the pretokens break at this offset whatever stands around."""
    return at + 1 < len(text) and text[at] == " " and text[at + 1] > " " and not text[at + 1].isspace()


def chunked(text: str, tok, chunk: int = CHUNK, overlap: int = OVERLAP):
    """Yields (offset, end, ids) of spliced spans; together they cover the text and its ids."""

    def coded(a: int, b: int):
        e = tok.encode(text[a:b], add_special_tokens=False)
        return e.ids, [a + x for x, _ in e.offsets]

    start, n = 0, len(text)
    ids, begins = coded(0, min(n, chunk + overlap))
    stop = min(n, chunk + overlap)
    while stop < n:
        wide = overlap
        while True:
            low = max(start + 1, stop - wide)
            nids, nbegins = coded(low, min(n, low + chunk + overlap))
            own = set(nbegins)
            cut = next((p for p in reversed(begins) if p > low and p < stop - 1 and p in own and stable(text, p)), None)
            if cut is not None or low == start + 1:
                break
            wide *= 2
        if cut is None:  # no stable boundary in this chunk at all: the chunk grows
            stop = min(n, stop + (stop - start))
            ids, begins = coded(start, stop)
            continue
        yield start, cut, ids[: bisect_left(begins, cut)]
        at = bisect_left(nbegins, cut)
        start, ids, begins, stop = cut, nids[at:], nbegins[at:], min(n, low + chunk + overlap)
    yield start, n, ids


def count(text: str, tok, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    return sum(len(ids) for _, _, ids in chunked(text, tok, chunk, overlap))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit), one for each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        file = path or encoding.default_path()
        pieces = encoding.pieces(file)
        tok = pieces.tok
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            small = iter(pieces.encode([t if len(t) <= CHUNK else "" for t in texts]))
            n = [len(ids) // 4 if len(t) <= CHUNK else count(t, tok) for t, ids in zip(texts, small, strict=True)]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=["k", "n_bytes", "n_tokens"])

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
