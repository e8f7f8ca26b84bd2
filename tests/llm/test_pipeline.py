"""The pipeline's stages against plain forms of their rules."""

from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import decontaminate, langid
from tidewell.llm.common import stash


def test_pipeline(spark):
    from test_operators import check_packing, plain_components, plain_judge

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stash(stage(spark, seen[-1], SMALL), name))
    for s in seen[:-1]:
        assert s.columns == docs.columns and s.schema == docs.schema
    start, lang, rules, near, clean = ({r.doc_id: r.text for r in s.collect()} for s in seen[:-1])
    assert set(start) >= set(lang) >= set(rules) >= set(near) >= set(clean)
    assert all(langid.has_letter(start[i]) for i in lang) and len(lang) >= 0.99 * sum(map(langid.has_letter, start.values()))
    for i in lang:
        kept, text = plain_judge(lang[i])
        assert (i in rules) == kept and (not kept or rules[i] == text)
    assert set(near) == {top for _, top in plain_components(rules).values()}
    for i in near:
        assert (i in clean) == (not decontaminate.brute(near[i], bench)[4])
    check_packing(seen[-1].collect(), clean)


def test_repeated_ids_leave_one_row(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "other words stand here now then")], "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SMALL).collect()) == [1, 3]


def test_rows_with_null_or_repeated_ids(spark):
    copy, unique = "a b c d e f", "other words stand here now then"
    rows = [(0, copy), (1, copy), (1, unique), (None, "this text has no id at all"), (None, "nor has this one which differs"), (None, copy), (2, ""), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, SMALL).collect()), key=str)
    assert got == sorted([(0, copy), (1, unique), (None, rows[3][1]), (None, rows[4][1]), (2, ""), (2, "")], key=str)


def test_stages_take_clashing_columns_and_empty_tables(spark):
    """Columns with the names of the operators' own come through untouched, in every stage, and so does nothing at all."""
    start = spark.read.parquet(f"{SMALL}/documents.parquet")
    own = ["score", "lang_pred", "row_key", "key", "row", "k", "t", "dig", "n_hit", "component_id", "_row", "kept", "n_words"]
    docs = start.withColumns({c: F.concat(F.lit(f"{c} of "), "doc_id") for c in own})
    again = docs.where("doc_id < 20").unionByName(docs.where("doc_id < 3"))
    for rows in again, docs.limit(0):
        seen = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            seen = stash(stage(spark, seen, SMALL), name)
            assert seen.columns == docs.columns
            assert all(r[c] == f"{c} of {r.doc_id}" for r in seen.collect() for c in own)
        assert (seen.count() > 5) == (rows is again)
        assert (corpus_pipeline.pack(spark, seen, SMALL).count() > 0) == (rows is again)


def test_stages_take_very_long_texts(spark):
    """A text of half a megabyte is judged whole."""
    from test_operators import plain_judge

    words = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en' AND length(text) > 800").orderBy("doc_id").limit(12).collect()]
    long = "\n".join(f"{w} {i}." for i in range(60) for w in words)
    assert len(long) > 500_000
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = rows.union(spark.createDataFrame([(10_000, long, "en", "s", len(long))], rows.schema))
    kept = corpus_pipeline.rules(spark, corpus_pipeline.language(spark, docs, SMALL), SMALL).where("doc_id = 10000").collect()
    stays, text = plain_judge(long)
    assert [r.text for r in kept] == ([text] if stays else [])
