"""Operator 13: fill-in-middle transformation, in Spark SQL functions only.

A text is cut into units, runs of A-Z and a-z or single other characters. Hash
groups of the row's key give two cuts and the form: prefix, suffix, middle
(psm), suffix, prefix, middle (spm), or the text as it is (plain). Sentinels
stand before the parts; a text that holds a sentinel's string stays plain, so
the first of each in an output is the one that was put there, and `restored`
finds the parts again from output and form alone.

Every row is handled by itself: no shuffle, no Python. Each step has columns of
its own, so that the units are matched once a row.

Nulls: a null text counts as empty (plain, output empty); a null key hashes as
an empty string. Texts are taken whole; repeated rows are alike; empty tables
give no rows. Extra columns are ignored (`arranged` returns its own columns
alone).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table

#: Units; sentinels of prefix, suffix and middle; seed; percent of texts that stay plain from here on, and of spm among the others.
UNITS, SENTINELS, SEED, PLAIN, SPM = "[A-Za-z]+|[^A-Za-z]", ("<P>", "<S>", "<M>"), "1", 90, 20


def hash_group(key: Column, i: int, seed: str = SEED) -> Column:
    """The i-th 8-digit group (from 0) of the hex sha256 of seed, colon and key, as an unsigned number."""
    whole = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(whole, 8 * i + 1, 8), 16, 10).cast("long")


def arranged(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """Rows (key, n, form, prefix, middle, suffix, output); the parts are null in plain rows."""
    p, s, m = SENTINELS
    d = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.select("*", F.regexp_extract_all("t", F.lit(UNITS), F.lit(0)).alias("u"), *[hash_group(F.col("k"), i, seed).alias(f"h{i}") for i in range(4)])
    d = d.select("*", F.size("u").cast("long").alias("n"))
    keeps = (F.col("t") == "") | F.col("t").contains(p) | F.col("t").contains(s) | F.col("t").contains(m) | (F.col("h2") % 100 >= plain)
    d = d.select("*", (F.col("h0") % (F.col("n") + 1)).alias("x"), (F.col("h1") % (F.col("n") + 1)).alias("y"), F.when(keeps, "plain").when(F.col("h3") % 100 < spm, "spm").otherwise("psm").alias("form"))
    a, e, n = (c.cast("int") for c in (F.least("x", "y"), F.greatest("x", "y"), F.col("n")))
    part = lambda first, size: F.when(F.col("form") != "plain", F.array_join(F.slice("u", first + 1, size), ""))
    d = d.select("k", "n", "t", "form", part(F.lit(0), a).alias("prefix"), part(a, e - a).alias("middle"), part(e, n - e).alias("suffix"))
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    spm_ = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("t"))
    return d.select(F.col("k").alias(key), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def _behind(whole: Column, mark: str) -> Column:
    """What stands behind the first mark."""
    return F.substr(whole, F.instr(whole, mark) + len(mark))


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form."""
    p, s, m = SENTINELS
    body = F.substr(output, F.lit(len(p) + 1))  # behind the first sentinel; all are as long

    def parts(mark: str) -> tuple[Column, Column, Column]:
        rest = _behind(body, mark)
        return F.substring_index(body, mark, 1), F.substring_index(rest, m, 1), _behind(rest, m)

    (prefix, suffix, middle), (spm_suffix, spm_prefix, spm_middle) = parts(s), parts(p)
    whole = F.when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(spm_prefix, spm_middle, spm_suffix))
    return F.when(form == "plain", output).otherwise(whole)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = arranged(table(spark, sf_dir, "documents"))
    d = d.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), "output", restored(F.col("output"), F.col("form")).alias("back"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("back", 256).alias("restored_sha256"))


SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS e,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:e], '') AS mid, array_to_string(u[e + 1:n], '') AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
