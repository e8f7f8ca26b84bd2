"""Queries around a scorer: float and int8 scores of windows, takes, calibration, checks of pinned streams, state machines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import signal as S
from tidewell.operators import islands, scorer, splits
from tidewell.plans.detection import _S, stream, table
from tidewell.sources.files import shared_folder
from tidewell.streaming import live, machines

QUERIES: dict = {}
SQL: dict = {}
PARTS = 5


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


#: A stand-in model of three classes over five features: integer weights, biases, and its scales.
WEIGHTS, BIAS = ((3, -1, 2, 0, 1), (-2, 1, 0, 1, -1), (1, 1, 1, 2, 3)), (1.0, 0.5, -2.0)
INTO, OUT = (0.0078125, -128), (0.0625, 2)


def float_model(x: np.ndarray) -> np.ndarray:
    return x @ np.array(WEIGHTS, float).T + np.array(BIAS)


def int8_model(q: np.ndarray) -> np.ndarray:
    """Integer sums of the codes less the zero point, brought to the output's scale."""
    acc = (q.astype(np.int64) - INTO[1]) @ np.array(WEIGHTS, np.int64).T
    return np.clip(np.rint((acc * INTO[0] + np.array(BIAS)) / OUT[0]) + OUT[1], -128, 127)


def _windows(spark, d) -> DataFrame:
    """(stream_id, hop, features): the last five scores, of full windows."""
    w = Window.partitionBy("stream_id").orderBy("hop").rowsBetween(-4, 0)
    s = stream(spark, d).select("stream_id", "hop", F.transform(F.collect_list("prob").over(w), lambda v: v / 500).alias("features"))
    return s.where(F.size("features") == 5)


def _scores(spark, d) -> DataFrame:
    x = scorer.scored_int8(scorer.scored(_windows(spark, d), float_model), int8_model, INTO, OUT)
    return x.select("stream_id", "hop", "q", F.element_at("probs", 3).alias("p"), F.element_at("probs_int8", 3).alias("p8"))


_DOT = [" + ".join(f"({w}) * {{x}}[{i + 1}]" for i, w in enumerate(row)) for row in WEIGHTS]
_SCORES = f"""
{_S}, fw AS (SELECT stream_id, hop, list_transform(f, lambda v: v / 500) AS f FROM (SELECT stream_id, hop, list(prob) OVER (PARTITION BY stream_id ORDER BY hop ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS f FROM s) WHERE len(f) = 5),
fq AS (SELECT *, list_transform(f, lambda v: least(127, greatest(-128, round_even(v / {INTO[0]}, 0) + {INTO[1]})) - ({INTO[1]})) AS c FROM fw),
lg AS (SELECT stream_id, hop, [{', '.join(f"{x.format(x='f')} + ({b})" for x, b in zip(_DOT, BIAS, strict=True))}] AS l,
  [{', '.join(f"least(127, greatest(-128, round_even((({x.format(x='c')}) * {INTO[0]} + ({b})) / {OUT[0]}, 0) + {OUT[1]}))" for x, b in zip(_DOT, BIAS, strict=True))}] AS q FROM fq),
sc AS (SELECT stream_id, hop, q, exp(l[3]) / (exp(l[1]) + exp(l[2]) + exp(l[3])) AS p,
  exp((q[3] - {OUT[1]}) * {OUT[0]}) / (exp((q[1] - {OUT[1]}) * {OUT[0]}) + exp((q[2] - {OUT[1]}) * {OUT[0]}) + exp((q[3] - {OUT[1]}) * {OUT[0]})) AS p8 FROM lg)"""


@query(f"WITH {_SCORES} SELECT stream_id, hop, CAST(q[1] AS INT) AS q0, CAST(q[2] AS INT) AS q1, CAST(q[3] AS INT) AS q2, round(p, 6) AS p, round(p8, 6) AS p8 FROM sc")
def pluggable_scores(spark, d):
    """Float and int8 scores of every window, with the raw int8 outputs."""
    q = [F.element_at("q", i + 1).cast("int").alias(f"q{i}") for i in range(3)]
    return _scores(spark, d).select("stream_id", "hop", *q, F.round("p", 6).alias("p"), F.round("p8", 6).alias("p8"))


@query(f"WITH {_SCORES} SELECT stream_id, count(*) AS n_hops, round(max(p), 6) AS best, round(max(p8), 6) AS best8 FROM sc GROUP BY stream_id")
def take_max(spark, d):
    """A take's best probability over its hops."""
    return _scores(spark, d).groupBy("stream_id").agg(F.count("*").alias("n_hops"), F.round(F.max("p"), 6).alias("best"), F.round(F.max("p8"), 6).alias("best8"))


@query(f"WITH {_SCORES} SELECT count(*) AS n, round(avg(abs(p - p8)), 6) AS mean_diff, round(max(abs(p - p8)), 6) AS max_diff, count(*) FILTER ((p > 0.5) = (p8 > 0.5)) AS n_agree, count(*) FILTER (p > 0.5) AS n_float, count(*) FILTER (p8 > 0.5) AS n_int8 FROM sc")
def float_vs_int8(spark, d):
    p, p8 = F.col("p"), F.col("p8")
    off = F.abs(p - p8)
    return _scores(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(off), 6).alias("mean_diff"), F.round(F.max(off), 6).alias("max_diff"), F.count_if((p > 0.5) == (p8 > 0.5)).alias("n_agree"), F.count_if(p > 0.5).alias("n_float"), F.count_if(p8 > 0.5).alias("n_int8"))


_TAKES = f"{_SCORES}, tk AS (SELECT stream_id, stream_id % 2 = 0 AS positive, round(max(p), 9) AS best FROM sc GROUP BY stream_id)"


@query(f"WITH {_TAKES} SELECT positive, stream_id, best, row_number() OVER (PARTITION BY positive ORDER BY CASE WHEN positive THEN best ELSE -best END, stream_id) AS rank FROM tk WHERE positive <> (best > 0.5)")
def errors_sorted(spark, d):
    """Wrong takes: missed ones by rising, false ones by falling probability."""
    t = _scores(spark, d).groupBy("stream_id").agg(F.round(F.max("p"), 9).alias("best")).withColumn("positive", F.col("stream_id") % 2 == 0)
    w = Window.partitionBy("positive").orderBy(F.when(F.col("positive"), F.col("best")).otherwise(-F.col("best")), "stream_id")
    return t.where(F.col("positive") != (F.col("best") > 0.5)).select("positive", "stream_id", "best", F.row_number().over(w).cast("long").alias("rank"))


@query(f"""
WITH {_SCORES}, pin AS (SELECT stream_id, min(hop) + 6 AS pinned, stream_id % 2 = 0 AS expect FROM sc GROUP BY stream_id)
SELECT *, n_over >= 3 AS fires, (n_over >= 3) = expect AS ok FROM (SELECT sc.stream_id, pinned, expect, count(*) AS n_windows, count(*) FILTER (p > 0.75) AS n_over, round(max(p), 6) AS best
FROM sc JOIN pin ON sc.stream_id = pin.stream_id AND hop > pinned - 5 AND hop <= pinned GROUP BY ALL) WHERE n_windows = 5""")
def go_nogo(spark, d):
    """Five windows that end at a pinned hop: whether three exceed the threshold, and whether that was expected."""
    s = _scores(spark, d)
    w = Window.partitionBy("stream_id")
    s = s.withColumn("pinned", F.min("hop").over(w) + 6).where((F.col("hop") > F.col("pinned") - 5) & (F.col("hop") <= F.col("pinned")))
    over = F.count_if(F.col("p") > 0.75)
    g = s.groupBy("stream_id", "pinned", (F.col("stream_id") % 2 == 0).alias("expect")).agg(F.count("*").alias("n_windows"), over.alias("n_over"), F.round(F.max("p"), 6).alias("best")).where("n_windows = 5")
    return g.withColumn("fires", F.col("n_over") >= 3).withColumn("ok", F.col("fires") == F.col("expect"))


@query(f"SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN {INTO[0]} ELSE s_suppkey / 1000.0 END AS scale, CASE WHEN s_suppkey % 4 = 0 THEN {INTO[1]} ELSE CAST(s_suppkey % 4 AS INT) END AS zero FROM supplier")
def scale_fallback(spark, d):
    """Scales of a model's own metadata, where they are there and not zero, else of the parameter file."""
    k = F.col("s_suppkey")
    meta_scale, meta_zero = F.when(k % 3 == 1, k / 1000.0).when(k % 3 == 2, k / 1000.0).otherwise(F.when(k % 2 == 0, F.lit(0.0))), F.when(k % 4 != 0, (k % 4).cast("int")).otherwise(F.lit(0))
    return table(spark, d, "supplier").select("s_suppkey", scorer.scale_or(meta_scale, F.lit(INTO[0])).alias("scale"), scorer.scale_or(meta_zero, F.lit(INTO[1])).alias("zero"))


@query("""
WITH own AS (SELECT doc_id, source FROM documents WHERE lang IN ('en', 'de') AND (CAST('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 134217728) * (100.0 / 134217727) >= 20)
SELECT doc_id, source FROM (SELECT *, row_number() OVER (ORDER BY sha1('21:' || doc_id), doc_id) AS r FROM own) WHERE r <= 100""")
def calibration_sample(spark, d):
    """A seeded sample of 100 rows of the training part of own sources alone."""
    own = table(spark, d, "documents").where(F.col("lang").isin("en", "de") & (splits.hash_percent(F.col("doc_id").cast("string")) >= 20)).select("doc_id", "source")
    return own.orderBy(splits.draw(F.col("doc_id"), 21), "doc_id").limit(100)


@query(f"""
WITH {_S}, v AS (SELECT stream_id, hop, lag(hop) OVER (PARTITION BY stream_id ORDER BY hop) AS prev FROM s WHERE prob > 30),
i AS (SELECT stream_id, hop, sum(CASE WHEN hop - prev <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY hop) AS isle FROM v),
n AS (SELECT stream_id, max(hop) AS top FROM s GROUP BY stream_id),
c AS (SELECT stream_id, min(hop) AS a, max(hop) + 1 AS e FROM i GROUP BY stream_id, isle HAVING max(hop) + 1 - min(hop) >= 2)
SELECT c.stream_id, CAST(row_number() OVER (PARTITION BY c.stream_id ORDER BY a) - 1 AS INT) AS clip, CAST(greatest(0, a * 1600 - 1760) AS BIGINT) AS start_sample, CAST(least((top + 1) * 1600, e * 1600 + 1760) AS BIGINT) AS end_sample FROM c JOIN n USING (stream_id)""")
def auto_split_clips(spark, d):
    """Spans of sound as clips, padded by 110 ms on both sides within the recording."""
    s = stream(spark, d)
    spans = islands.spans(s.where("prob > 30"), 2).where("end_hop - start_hop >= 2")
    top = s.groupBy("stream_id").agg(F.max("hop").alias("top"))
    w = Window.partitionBy("stream_id").orderBy("start_hop")
    return spans.join(top, "stream_id").select("stream_id", (F.row_number().over(w) - 1).cast("int").alias("clip"), F.greatest(F.lit(0), F.col("start_hop") * 1600 - 1760).cast("long").alias("start_sample"), F.least((F.col("top") + 1) * 1600, F.col("end_hop") * 1600 + 1760).cast("long").alias("end_sample"))


@query(f"WITH {_S} SELECT stream_id, hop, CASE WHEN EXISTS (SELECT 1 FROM s x WHERE x.stream_id = s.stream_id AND x.event_type = 'error' AND s.hop >= x.hop AND s.hop < x.hop + 3) THEN 0.0 ELSE prob END AS level FROM s")
def background_patches(spark, d):
    """A background with patches of silence, which may overlap: hops of patches by an equal join, not a range."""
    s = stream(spark, d)
    patch = s.where("event_type = 'error'").select("stream_id", F.explode(F.sequence("hop", F.col("hop") + 2)).alias("hop")).distinct().withColumn("silent", F.lit(True))
    return s.join(patch, ["stream_id", "hop"], "left").select("stream_id", "hop", F.when(F.col("silent"), F.lit(0.0)).otherwise(F.col("prob")).alias("level"))


@query(f"WITH {_S} SELECT stream_id, hop, prob FROM s WHERE 20 * log10(prob / 500 + 1e-12) >= -25")
def loudness_filter(spark, d):
    return stream(spark, d).where(20 * F.log10(F.col("prob") / 500 + 1e-12) >= -25).select("stream_id", "hop", "prob")


@query(f"""
WITH {_S}, a AS (SELECT stream_id, hop, prob FROM s), b AS (SELECT stream_id, hop, round_even(prob * 4, 0) / 4 AS prob FROM s WHERE hop % 7 <> 3)
SELECT a.stream_id, count(*) AS n, count(b.hop) AS n_both, round(max(abs(a.prob - b.prob)), 6) AS worst FROM a LEFT JOIN b USING (stream_id, hop) GROUP BY a.stream_id""")
def parity_join(spark, d):
    """Two matrices by place: how many places both have, and the largest difference."""
    a = stream(spark, d).select("stream_id", "hop", "prob")
    b = a.where("hop % 7 <> 3").select("stream_id", "hop", (F.rint(F.col("prob") * 4) / 4).alias("other"))
    return a.join(b, ["stream_id", "hop"], "left").groupBy("stream_id").agg(F.count("*").alias("n"), F.count("other").alias("n_both"), F.round(F.max(F.abs(F.col("prob") - F.col("other"))), 6).alias("worst"))


@query()
def utterance_fsm_live(spark, d):
    """The two-state machine as a stream of several micro-batches; wakes and ends put together afterwards."""
    rows = stream(spark, d).select("stream_id", "hop", "prob", (F.col("prob") / 500).alias("level"))
    marks = live.replay_hops(rows, PARTS, lambda r: machines.utterance_marks(r, theta=40.0, k=2, window=3, refractory=5, silence=0.05, quiet=3, most=20))
    n = F.row_number().over(Window.partitionBy("stream_id", "what").orderBy("hop")).cast("long") - 1
    marks = marks.withColumn("utterance", n)
    wakes = marks.where("what = 'wake'").select("stream_id", "utterance", F.col("hop").alias("wake_hop"), "prob")
    ends = marks.where("what = 'end'").select("stream_id", "utterance", F.col("hop").alias("end_hop"))
    return wakes.join(ends, ["stream_id", "utterance"], "left").select("stream_id", "utterance", "wake_hop", "end_hop", "prob")


@query()
def utterance_capture_live(spark, d):
    rows = stream(spark, d).select("stream_id", "hop", S.decibels(F.col("prob")).alias("db"))
    return live.replay_hops(rows, PARTS, machines.captured)


#: The two-state machine by recursion, one hop at a time.
SQL["utterance_fsm"] = f"""
WITH RECURSIVE {_S},
m AS (SELECT DISTINCT stream_id, CAST(-1 AS INT) AS hop, CAST(0 AS DOUBLE) AS prob, false AS streaming, 0 AS idle, CAST(NULL AS INT) AS last, 0 AS run, 0 AS length, CAST([] AS DOUBLE[]) AS recent, '' AS what FROM s
  UNION ALL
  SELECT stream_id, hop, prob, (streaming AND NOT ends) OR wakes, CASE WHEN streaming THEN idle ELSE idle + 1 END, CASE WHEN wakes THEN idle ELSE last END,
         CASE WHEN wakes THEN 0 ELSE nrun END, CASE WHEN wakes THEN 0 ELSE nlen END, nrecent, CASE WHEN ends THEN 'end' WHEN wakes THEN 'wake' ELSE '' END
  FROM (SELECT *, streaming AND (nrun >= 3 OR nlen >= 20) AS ends, NOT streaming AND len(nrecent) = 3 AND len(list_filter(nrecent, lambda x: x > 40)) >= 2 AND (last IS NULL OR idle - last >= 5) AS wakes
        FROM (SELECT m.stream_id, s.hop, s.prob, streaming, idle, last, CASE WHEN NOT streaming THEN run WHEN s.prob / 500 < 0.05 THEN run + 1 ELSE 0 END AS nrun, CASE WHEN streaming THEN length + 1 ELSE length END AS nlen,
                     CASE WHEN streaming THEN recent ELSE list_append(recent, s.prob)[-3:] END AS nrecent
              FROM m JOIN s ON s.stream_id = m.stream_id AND s.hop = m.hop + 1))),
w AS (SELECT stream_id, hop, prob, row_number() OVER (PARTITION BY stream_id ORDER BY hop) - 1 AS utterance FROM m WHERE what = 'wake'),
e AS (SELECT stream_id, hop, row_number() OVER (PARTITION BY stream_id ORDER BY hop) - 1 AS utterance FROM m WHERE what = 'end')
SELECT w.stream_id, w.utterance, CAST(w.hop AS BIGINT) AS wake_hop, CAST(e.hop AS BIGINT) AS end_hop, w.prob FROM w LEFT JOIN e USING (stream_id, utterance)"""

#: Capture with hysteresis by recursion.
SQL["utterance_capture"] = f"""
WITH RECURSIVE {_S}, l AS (SELECT stream_id, hop, 20 * log10(prob) AS db FROM s),
m AS (SELECT DISTINCT stream_id, CAST(-1 AS INT) AS hop, CAST(NULL AS INT) AS first, 0 AS voiced, 0 AS silent, 0 AS free, CAST(NULL AS INT) AS of, CAST(NULL AS INT) AS ol, false AS hit FROM s
  UNION ALL
  SELECT stream_id, hop, CASE WHEN done THEN NULL WHEN first IS NULL THEN CASE WHEN db > 40 THEN greatest(free, hop - 3) END ELSE first END,
         CASE WHEN first IS NULL THEN CASE WHEN db > 40 THEN hop ELSE voiced END ELSE nv END, CASE WHEN first IS NULL THEN CASE WHEN db > 40 THEN 0 ELSE silent END ELSE ns END,
         CASE WHEN done THEN hop + 1 ELSE free END, CASE WHEN done THEN first END, CASE WHEN done THEN least(hop, nv + 2) END, done AND over AND ns < 3
  FROM (SELECT *, first IS NOT NULL AND (ns >= 3 OR over) AS done
        FROM (SELECT m.stream_id, l.hop, db, first, voiced, silent, free, CASE WHEN db >= 37 THEN l.hop ELSE voiced END AS nv, CASE WHEN db >= 37 THEN 0 ELSE silent + 1 END AS ns, l.hop - first + 1 >= 40 AS over
              FROM m JOIN l ON l.stream_id = m.stream_id AND l.hop = m.hop + 1)))
SELECT stream_id, CAST(of AS BIGINT) AS first_hop, CAST(ol AS BIGINT) AS last_hop, hit AS hit_max FROM m WHERE of IS NOT NULL"""

SQL["utterance_fsm_live"], SQL["utterance_capture_live"] = SQL["utterance_fsm"], SQL["utterance_capture"]
