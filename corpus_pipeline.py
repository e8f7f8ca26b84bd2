"""A training corpus from `documents` in five stages, each an operator of tidewell.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns the rows that go on, with the columns of `documents`; the last returns
packed pieces. run() writes each stage's result as Parquet in the shared folder
and reads it back as the next one's documents.

1. language identification: documents without a language, or with a pooled
   probability below LEAST_SCORE, go; `lang` becomes the predicted language;
2. quality rules: documents that fail go, failing lines of the others are cut;
3. n-gram Jaccard join: the document with the least id of each group stays;
4. benchmark decontamination: contaminated documents go;
5. best-fit packing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, jaccard, langid, packing, quality
from tidewell.llm.common import stash, table, unstash

#: Least pooled probability of the predicted language.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = langid.annotate(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return got.select(*[(F.col("lang_pred") if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def _row_key(docs: DataFrame) -> Column:
    """Unlike for any two rows, and in the order of ids; null ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.monotonically_increasing_id().alias("no"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group. Where ids are null or repeat, rows are told apart by a number of their own."""
    cols = docs.columns
    one = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.count_distinct("doc_id").alias("different")).first()
    row = F.struct(*[F.col(c) for c in cols]).alias("row")  # so that no column of the rows clashes with the key
    if one.n == one.different:
        rows = docs.select(row, F.col("doc_id").alias("key"))
    else:  # the number orders rows by id, null ids last; written down, so that it stays the same
        rows = stash(docs.select(row, _row_key(docs).alias("key")), "numbered")
    kept = jaccard.join(rows.select("key", F.col("row.text").alias("text")), "key").where(F.col("key") == F.col("component_id")).select("key")
    kept = stash(kept, "kept")
    few = kept.count() <= jaccard.BROADCAST_IDS
    return rows.join(F.broadcast(kept) if few else kept, "key", "left_semi").select(*[F.col("row")[c].alias(c) for c in cols])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("language_id", language),
    ("quality_rules", rules),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stash(stage(spark, docs, sf_dir), f"stage-{name}")
        unstash(before)
    return docs


#: SQL can't express the language network; the pipeline is tested against brute force.
ORACLE_SQL = None
