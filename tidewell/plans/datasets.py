"""Queries of dataset assembly and reports on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import reports, splits
from tidewell.plans.detection import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add



_PCT = "(CAST('0x' || substr(sha1({k}), 1, 8) AS BIGINT) % 134217728) * (100.0 / 134217727)"
_SPLIT = "CASE WHEN {k} = '' THEN 'train' WHEN " + _PCT + " < 10 THEN 'test' WHEN " + _PCT + " < 20 THEN 'val' ELSE 'train' END"


@query(f"SELECT c_custkey, {_SPLIT.format(k='c_name')} AS split FROM customer")
def hash_split(spark, d):
    return table(spark, d, "customer").select("c_custkey", splits.hash_split(F.col("c_name")).alias("split"))


_EXPLICIT = {"src1": "test", "src2": "val", "src3": "train"}


@query(f"""
SELECT doc_id, speaker, coalesce(m, CASE WHEN lang = 'en' THEN h END, 'train') AS split FROM (
  SELECT doc_id, lang, source AS speaker, CASE source WHEN 'src1' THEN 'test' WHEN 'src2' THEN 'val' WHEN 'src3' THEN 'train' END AS m, {_SPLIT.format(k='source')} AS h FROM documents)
WHERE m IS NOT NULL OR lang IS DISTINCT FROM 'en' OR h <> 'test'""")
def speaker_disjoint_split(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.col("source").alias("speaker"), F.coalesce("lang", F.lit("")).alias("source"))
    return splits.speaker_disjoint(m, _EXPLICIT, "en").select("doc_id", "speaker", "split")


@query("""
SELECT doc_id, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY sha1('11:' || doc_id), doc_id) AS r, round_even(count(*) OVER () * 0.1, 0) AS t, round_even(count(*) OVER () * 0.1, 0) AS v FROM documents)""")
def random_split(spark, d):
    return splits.random_split(table(spark, d, "documents").select("doc_id"), "doc_id", 11).select("doc_id", "split")


def _manifest(spark, d):
    """Labelled documents as a manifest: toxic ones stand for keywords, languages for the strata of unknowns."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    kind = F.when(F.col("toxic") == 1, "keyword").when(F.col("lang") == "fr", "silence").otherwise("unknown")
    return docs.select(F.col("doc_id").alias("path"), splits.hash_split(F.concat(F.lit("d"), F.col("doc_id"))).alias("split"), kind.alias("kind"), F.col("lang").alias("source"))


_M = f"""m AS (SELECT doc_id AS path, {_SPLIT.format(k="('d' || doc_id)")} AS split, CASE WHEN toxic = 1 THEN 'keyword' WHEN lang = 'fr' THEN 'silence' ELSE 'unknown' END AS kind, lang AS source
  FROM documents LEFT JOIN labels USING (doc_id))"""


@query(f"""
WITH {_M}, n AS (SELECT split, count(*) FILTER (kind = 'keyword') AS kw, count(*) FILTER (kind = 'unknown' AND source = 'es') AS nh, count(*) FILTER (kind = 'unknown' AND source = 'de') AS nt FROM m GROUP BY split),
q AS (SELECT *, round_even(kw * 10.0, 0) AS quota FROM n),
t AS (SELECT *, CASE WHEN nh > 0 THEN greatest(round_even(quota * 0.25, 0), nh) ELSE 0 END AS th, CASE WHEN nt > 0 THEN greatest(round_even(quota * 0.15, 0), nt) ELSE 0 END AS tt FROM q),
o AS (SELECT m.*, row_number() OVER (PARTITION BY split, source ORDER BY path) - 1 AS o, row_number() OVER (PARTITION BY split, source ORDER BY sha1('5:' || path), path) AS r FROM m WHERE kind = 'unknown')
SELECT path, split, kind, source, 0 AS rep FROM m WHERE kind <> 'unknown'
UNION ALL SELECT path, split, kind, source, CAST(rep AS INT) FROM (SELECT o.*, nh AS n, th AS target, unnest(range(0, CAST(ceil(th / greatest(nh, 1)) AS BIGINT))) AS rep FROM o JOIN t USING (split) WHERE source = 'es') WHERE rep * n + o < target
UNION ALL SELECT path, split, kind, source, CAST(rep AS INT) FROM (SELECT o.*, nt AS n, tt AS target, unnest(range(0, CAST(ceil(tt / greatest(nt, 1)) AS BIGINT))) AS rep FROM o JOIN t USING (split) WHERE source = 'de') WHERE rep * n + o < target
UNION ALL SELECT path, split, kind, source, 0 FROM o JOIN t USING (split) WHERE source = 'en' AND r <= greatest(quota - th - tt, 0)""")
def unknown_quota_mix(spark, d):
    return splits.quota_mix(_manifest(spark, d), 5, "es", "de", "en")


@query(f"WITH {_M} SELECT 'silence-' || split || '-' || rep AS path, split, 'silence' AS kind FROM (SELECT split, unnest(range(0, CAST(round_even(count(*) FILTER (kind = 'keyword') * 0.1, 0) AS BIGINT))) AS rep FROM m GROUP BY split)")
def silence_injection(spark, d):
    return splits.silence_rows(_manifest(spark, d))


@query(f"WITH {_M} SELECT split, count(*) FILTER (path IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS n_leaked, count(*) AS n FROM m WHERE split <> 'test' GROUP BY split")
def leak_guard(spark, d):
    """Held-out keys in the training parts: counts by split (a guard asserts that they are 0)."""
    m = _manifest(spark, d).where("split <> 'test'")
    held = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("path"))
    leaked = splits.leaks(m, held, "path").groupBy("split").agg(F.count("*").alias("n_leaked"))
    return m.groupBy("split").agg(F.count("*").alias("n")).join(leaked, "split", "left").select("split", F.coalesce("n_leaked", F.lit(0)).alias("n_leaked"), "n")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source HAVING count(*) > 1)")
def pool_minus_held_out(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    held = docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id").groupBy("source").count().where("count > 1")
    return docs.join(held, "source", "left_anti").select("doc_id", "source")


@query("SELECT doc_id, coalesce(text_new, source) AS path FROM (SELECT doc_id, source, CASE WHEN quality = 1 THEN 'trimmed/' || source END AS text_new, toxic FROM documents LEFT JOIN labels USING (doc_id)) WHERE text_new IS NOT NULL OR toxic = 1")
def trimmed_substitution(spark, d):
    """The trimmed path where there is one; raw paths stay for held-out rows only."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    new = F.when(F.col("quality") == 1, F.concat(F.lit("trimmed/"), F.col("source")))
    return docs.where(new.isNotNull() | (F.col("toxic") == 1)).select("doc_id", F.coalesce(new, F.col("source")).alias("path"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (lang))")
def manifest_counts(spark, d):
    return table(spark, d, "documents").groupingSets([["source"], ["lang"]], "source", "lang").agg(F.count("*").alias("n")).select("source", "lang", "n")


@query(f"WITH {_M} SELECT split, count(*) FILTER (kind = 'keyword') AS keyword, count(*) FILTER (kind = 'silence') AS silence, count(*) FILTER (kind = 'unknown') AS unknown FROM m GROUP BY split")
def split_label_counts(spark, d):
    return _manifest(spark, d).groupBy("split").pivot("kind", ["keyword", "silence", "unknown"]).count().fillna(0)


@query("SELECT l_returnflag, l_linestatus, count(*) AS slots, count(DISTINCT l_orderkey) AS paths FROM lineitem GROUP BY ALL")
def distinct_vs_slots(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("slots"), F.countDistinct("l_orderkey").alias("paths"))


@query("""
WITH o AS (SELECT lang AS word, CASE WHEN n_chars < 200 THEN 'EMPTY' WHEN quality IS NULL THEN 'NONE' WHEN quality = 1 THEN 'OK' ELSE 'WRONG' END AS outcome FROM documents LEFT JOIN labels USING (doc_id))
SELECT word, count(*) AS n, count(*) FILTER (outcome = 'OK') AS ok, count(*) FILTER (outcome = 'WRONG') AS wrong, count(*) FILTER (outcome = 'NONE') AS none, count(*) FILTER (outcome = 'EMPTY') AS empty,
       count(*) FILTER (outcome = 'OK') / greatest(count(*), 1) AS hit_rate, count(*) FILTER (outcome = 'OK') / greatest(count(*) FILTER (outcome <> 'EMPTY'), 1) AS hit_rate_nonempty
FROM o GROUP BY GROUPING SETS ((), (word))""")
def outcome_tally(spark, d):
    o = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    outcome = F.when(F.col("n_chars") < 200, "EMPTY").when(F.col("quality").isNull(), "NONE").when(F.col("quality") == 1, "OK").otherwise("WRONG")
    return reports.tally(o.select(F.col("lang").alias("word"), outcome.alias("outcome")), "word")


@query("""
SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
       count(*) AS n, count(*) FILTER (value < 10) AS n_quiet FROM events GROUP BY event_type""")
def percentile_report(spark, d):
    return reports.percentiles(table(spark, d, "events"), "value", ["event_type"], [5, 25, 50, 75, 95, 99], F.col("value") < 10)


@query("SELECT event_type, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY event_type")
def summary_stats(spark, d):
    return reports.summary(table(spark, d, "events"), "value", ["event_type"])


@query("""
SELECT round(min(value) FILTER (event_type = 'purchase') - max(value) FILTER (event_type = 'error'), 6) AS gap,
       round(quantile_cont(value, 0.1) FILTER (event_type = 'purchase') - quantile_cont(value, 0.9) FILTER (event_type = 'error'), 6) AS gap_p10_p90 FROM events""")
def separation_gap(spark, d):
    return reports.separation(table(spark, d, "events"), "value", F.col("event_type") == "purchase", F.col("event_type") == "error")


@query("SELECT round(count(*) FILTER (l.quality = 1 AND n_chars > 500) / greatest(count(*) FILTER (l.quality = 1), 1), 9) AS tpr, round(count(*) FILTER (l.quality = 0 AND n_chars <= 500) / greatest(count(*) FILTER (l.quality = 0), 1), 9) AS tnr FROM labels l JOIN documents USING (doc_id)")
def tpr_tnr(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return reports.rates(x, F.col("quality") == 1, F.col("n_chars") > 500)


@query("SELECT round(tp / (tp + fp + 1e-7), 9) AS precision, round(tp / (tp + fn + 1e-7), 9) AS recall FROM (SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 0 AND quality = 1) AS fp, count(*) FILTER (toxic = 1 AND quality = 0) AS fn FROM labels)")
def precision_recall(spark, d):
    return reports.precision_recall(table(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 1)


@query("SELECT toxic, count(*) FILTER (quality = 0) AS pred_0, count(*) FILTER (quality = 1) AS pred_1 FROM labels GROUP BY toxic")
def confusion_matrix(spark, d):
    return reports.confusion(table(spark, d, "labels"), "toxic", "quality", [0, 1])


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (quality = 1) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)")
def ab_hits(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").rollup("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("hits")).select("lang", "source", "n", "hits")


@query("SELECT round(max(abs(a - b)), 6) AS max_abs, round(avg(abs(a - b)), 6) AS mean_abs, arg_max(i, (abs(a - b), -i)) AS at FROM (SELECT l_orderkey * 10 + l_linenumber AS i, l_extendedprice AS a, l_quantity * 1000 AS b FROM lineitem)".replace("arg_max(i, (abs(a - b), -i))", "min(i) FILTER (abs(a - b) = (SELECT max(abs(l_extendedprice - l_quantity * 1000)) FROM lineitem))"))
def max_abs_diff(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1000).alias("e"))
    return x.agg(F.round(F.max("e"), 6).alias("max_abs"), F.round(F.avg("e"), 6).alias("mean_abs"), (-F.max(F.struct("e", -F.col("i")))["col2"]).alias("at"))


@query("SELECT user_id, event_id, CASE WHEN c_name IS NULL THEN '?' ELSE c_name END AS mic FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0")
def latest_manifest_row(spark, d):
    """The last row of each key wins, then a lookup with a default."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r = 1")
    mics = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    return last.join(mics, last.user_id == mics.c_custkey, "left").select("user_id", "event_id", F.coalesce("c_name", F.lit("?")).alias("mic"))


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN value > 300 THEN 'CLIPPED' END, CASE WHEN value < 1 THEN 'QUIET' END, CASE WHEN value > 200 THEN 'LONG' END, CASE WHEN value < 5 THEN 'SHORT' END], lambda x: x IS NOT NULL), ',') AS flags FROM events")
def take_flags(spark, d):
    v = F.col("value")
    flags = F.array(F.when(v > 300, "CLIPPED"), F.when(v < 1, "QUIET"), F.when(v > 200, "LONG"), F.when(v < 5, "SHORT"))
    return table(spark, d, "events").select("event_id", F.array_join(F.filter(flags, lambda x: x.isNotNull()), ",").alias("flags"))


@query("""
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A')
SELECT 'union_all' AS op, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS n UNION ALL SELECT 'union', (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b))
UNION ALL SELECT 'intersect', (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) UNION ALL SELECT 'except', (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b))""")
def set_operations(spark, d):
    li = table(spark, d, "lineitem")
    a, b = (li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")).distinct() for f in ("R", "A"))
    ops = {"union_all": a.unionByName(b), "union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b)}
    out = None
    for name, x in ops.items():
        n = x.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = n if out is None else out.union(n)
    return out


@query("SELECT s_name, CASE WHEN own <> '' THEN lower(own) WHEN strpos(name, '_') > 0 THEN split_part(name, '_', 1) ELSE '' END AS speaker, CASE WHEN w <> '' THEN w ELSE 'unknown' END AS word FROM (SELECT s_name, name, regexp_extract(name, '(?i)^(?:positive|hardneg|ambient|talking)_[a-z0-9]+_([a-z0-9]+)_\\d+$', 1) AS own, regexp_extract(name, '^[^_]+_(.+)_\\d+$', 1) AS w FROM (SELECT s_name, CASE WHEN s_nationkey % 3 = 0 THEN 'Positive_nova_S' || s_nationkey || '_' || s_suppkey WHEN s_nationkey % 3 = 1 THEN 'k' || s_nationkey || '_nohash_0' ELSE s_name END AS name FROM supplier))")
def speaker_keys(spark, d):
    k, n = F.col("s_nationkey"), F.col("s_name")
    name = F.when(k % 3 == 0, F.concat(F.lit("Positive_nova_S"), k, F.lit("_"), F.col("s_suppkey"))).when(k % 3 == 1, F.concat(F.lit("k"), k, F.lit("_nohash_0"))).otherwise(n)
    return table(spark, d, "supplier").select("s_name", T.speaker_key(name).alias("speaker"), T.hard_neg_word(name).alias("word"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 3 = 0 THEN 1.0 WHEN l_linenumber % 3 = 1 THEN 2.0 ELSE 3.0 END, 6) AS weight, CASE WHEN l_linenumber % 3 = 0 THEN '1,0,0' WHEN l_linenumber % 3 = 1 THEN '0,1,0' ELSE '0,0,1' END AS one_hot, round(0.001 * pow(0.5, floor(l_linenumber / 2)), 9) AS rate FROM lineitem")
def labels_encoded(spark, d):
    from tidewell.functions import signal as S

    label = (F.col("l_linenumber") % 3).cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.class_weight(label).alias("weight"), F.array_join(S.one_hot(label, 3).cast("array<string>"), ",").alias("one_hot"), F.round(S.step_decay(F.col("l_linenumber"), 0.001, 0.5, 2), 9).alias("rate"))
