"""Queries on score streams: detection, scoring, sweeps, islands, sessions. Streams are users of `events`, scores their values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import signal as S
from tidewell.operators import detect, islands, sessions

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stream(spark: SparkSession, d: str) -> DataFrame:
    return detect.events_as_stream(table(spark, d, "events"))


#: Stand-in policy for events' values.
THETA, K, W, R = 50.0, 3, 5, 10
HOUR = 36000.0  # hops of an hour

_S = "s AS (SELECT user_id AS stream_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS hop, value AS prob, event_type, ts, event_id FROM events)"


def _fires(cand: str, hops: int, by: str = "stream_id") -> str:
    """Recursive fold over the candidates of a table."""
    keys = [k.strip() for k in by.split(",")]
    same = " AND ".join(f"r.{k} = f.{k}" for k in keys)
    own = ", ".join(f"r.{k}" for k in keys)
    return f"""
r AS (SELECT {by}, hop, row_number() OVER (PARTITION BY {by} ORDER BY hop) AS rn FROM {cand}),
f AS (SELECT {by}, rn, hop, hop AS last, true AS fired FROM r WHERE rn = 1
      UNION ALL SELECT {own}, r.rn, r.hop, CASE WHEN r.hop - f.last >= {hops} THEN r.hop ELSE f.last END, r.hop - f.last >= {hops}
      FROM f JOIN r ON {same} AND r.rn = f.rn + 1),
fires AS (SELECT {by}, hop FROM f WHERE fired)"""


def _votes(theta, k: int, lo: int, hi: int, w: int, src: str = "s", by: str = "stream_id") -> str:
    span = f"ROWS BETWEEN {-lo} PRECEDING AND {f'{hi} FOLLOWING' if hi else 'CURRENT ROW'}"
    return f"cand AS (SELECT {by}, hop FROM (SELECT *, sum(CAST(prob > {theta} AS INT)) OVER w AS n, count(*) OVER w AS m FROM {src} WINDOW w AS (PARTITION BY {by} ORDER BY hop {span})) WHERE m = {w} AND n >= {k})"


@query(f"WITH RECURSIVE {_S}, {_votes(THETA, K, -4, 0, W)}, {_fires('cand', R)} SELECT stream_id, hop FROM fires")
def detect_fires(spark, d):
    return detect.detect(stream(spark, d), THETA, K, W, R)


@query(f"WITH RECURSIVE {_S}, {_votes(THETA, K, -2, 2, W)}, {_fires('cand', R)} SELECT stream_id, hop FROM fires")
def detect_fires_centered(spark, d):
    return detect.detect(stream(spark, d), THETA, K, W, R, centred=True)


def _intervals(s: DataFrame) -> DataFrame:
    return s.where("event_type = 'purchase'").select("stream_id", F.col("hop").alias("start_hop"), (F.col("hop") + 3).alias("end_hop"))


_V = "v AS (SELECT stream_id, hop AS start_hop, hop + 3 AS end_hop FROM s WHERE event_type = 'purchase')"


def _scored(by: str = "", group: str = "") -> str:
    """Scores of `fires` against `v`, for each `by` of a table g."""
    j = f"AND x.{by} = g.{by}" if by else ""
    return f"""
x AS (SELECT fires.*, EXISTS (SELECT 1 FROM v WHERE v.stream_id = fires.stream_id AND hop >= start_hop AND hop < end_hop) AS hit FROM fires),
o AS (SELECT {'g.' + by + ' AS ' + by + ',' if by else ''} (SELECT count(*) FROM s) / {HOUR} AS hours, (SELECT count(*) FROM v) AS n_keywords,
        (SELECT count(*) FROM x WHERE true {j}) AS n_fires, (SELECT count(*) FROM x WHERE NOT hit {j}) AS n_false,
        (SELECT count(*) FROM v WHERE EXISTS (SELECT 1 FROM x WHERE x.stream_id = v.stream_id AND x.hop >= start_hop AND x.hop < end_hop {j})) AS n_found FROM {'g' if by else '(SELECT 1)'})
SELECT {by + ',' if by else ''} n_false / greatest(hours, 1e-9) AS far_per_hour, CASE WHEN n_keywords > 0 THEN (n_keywords - n_found) / n_keywords ELSE 0.0 END AS frr,
       1 - CASE WHEN n_keywords > 0 THEN (n_keywords - n_found) / n_keywords ELSE 0.0 END AS tpr, n_fires, n_keywords, n_false, n_keywords - n_found AS n_missed FROM o"""


@query(f"WITH RECURSIVE {_S}, {_V}, {_votes(THETA, K, -4, 0, W)}, {_fires('cand', R)}, {_scored()}")
def detection_scores(spark, d):
    s = stream(spark, d)
    return detect.score(detect.detect(s, THETA, K, W, R), _intervals(s), s.agg((F.count("*") / HOUR).alias("hours")))


THETAS = [20.0, 30.0, 40.0, 50.0, 60.0, 80.0, 120.0, 200.0]
_G = "g AS (SELECT unnest([" + ", ".join(map(str, THETAS)) + "]) AS theta), sg AS (SELECT s.*, theta FROM s, g)"


def _sweep(spark, d) -> DataFrame:
    s = stream(spark, d)
    grid = spark.createDataFrame([(t,) for t in THETAS], "theta double")
    fires = detect.detect(s.select("stream_id", "hop", "prob").crossJoin(F.broadcast(grid)), F.col("theta"), 2, 3, 15, by=("theta", "stream_id"))
    hours = grid.crossJoin(s.agg((F.count("*") / HOUR).alias("hours")))
    return detect.score(fires, _intervals(s), hours, ("theta",))


_SWEEP = f"WITH RECURSIVE {_S}, {_V}, {_G}, {_votes('theta', 2, -2, 0, 3, 'sg', 'theta, stream_id')}, {_fires('cand', 15, 'theta, stream_id')}, {_scored('theta')}"


@query(_SWEEP)
def threshold_sweep(spark, d):
    return _sweep(spark, d)


@query(f"SELECT * FROM ({_SWEEP}) ORDER BY far_per_hour <= 500 DESC, CASE WHEN far_per_hour <= 500 THEN theta END DESC NULLS LAST, far_per_hour, theta LIMIT 1")
def operating_point(spark, d):
    return detect.operating_point(_sweep(spark, d), 500.0)


POLICIES = [(1, 1), (1, 3), (2, 3), (3, 3), (2, 5), (3, 5), (4, 5)]


def _policies(spark, d) -> DataFrame:
    """Votes of every window size in one pass, then the grid."""
    s = stream(spark, d).select("stream_id", "hop", "prob")
    for w in sorted({w for _, w in POLICIES}):
        s = detect.votes(s, THETA, w).withColumnRenamed("n_over", f"n{w}")
    grid = spark.createDataFrame([(i, k, w) for i, (k, w) in enumerate(POLICIES)], "ordinal int, k int, w int")
    n = F.coalesce(*[F.when(F.col("w") == w, F.col(f"n{w}")) for w in sorted({w for _, w in POLICIES})])
    cand = s.crossJoin(F.broadcast(grid)).where(n >= F.col("k")).select("ordinal", "stream_id", "hop")
    fires = detect.refractory(cand, 15, ("ordinal", "stream_id")).groupBy("ordinal").agg(F.count("*").alias("n_fires"))
    hours = s.agg((F.count("*") / HOUR).alias("hours"))
    out = grid.join(fires, "ordinal", "left").crossJoin(hours).fillna(0, ["n_fires"])
    return out.select("ordinal", "k", "w", "n_fires", (F.col("n_fires") / F.greatest("hours", F.lit(1e-9))).alias("far_per_hour"), S.added_latency_ms(F.col("w")).alias("latency_ms"))


_POLICY = f"""
WITH RECURSIVE {_S}, g AS (SELECT * FROM (VALUES {", ".join(f"({i}, {k}, {w})" for i, (k, w) in enumerate(POLICIES))}) AS t(ordinal, k, w)),
n AS (SELECT stream_id, hop, sum(CAST(prob > {THETA} AS INT)) OVER w1 AS n1, sum(CAST(prob > {THETA} AS INT)) OVER w3 AS n3, sum(CAST(prob > {THETA} AS INT)) OVER w5 AS n5 FROM s
  WINDOW w1 AS (PARTITION BY stream_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND CURRENT ROW), w3 AS (PARTITION BY stream_id ORDER BY hop ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY stream_id ORDER BY hop ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
cand AS (SELECT ordinal, stream_id, hop FROM n, g WHERE hop >= w - 1 AND CASE w WHEN 1 THEN n1 WHEN 3 THEN n3 ELSE n5 END >= k),
{_fires('cand', 15, 'ordinal, stream_id')}
SELECT CAST(ordinal AS INT) AS ordinal, CAST(k AS INT) AS k, CAST(w AS INT) AS w, count(fires.hop) AS n_fires, count(fires.hop) / (SELECT count(*) / {HOUR} FROM s) AS far_per_hour, (w - 1) / 2 * 100 AS latency_ms
FROM g LEFT JOIN fires USING (ordinal) GROUP BY ALL"""


@query(_POLICY)
def kwindow_policy_grid(spark, d):
    return _policies(spark, d)


@query(f"SELECT * FROM ({_POLICY}) ORDER BY far_per_hour <= 500 DESC, CASE WHEN far_per_hour <= 500 THEN latency_ms END NULLS LAST, far_per_hour, ordinal LIMIT 1")
def policy_recommendation(spark, d):
    return detect.recommended(_policies(spark, d), 500.0)


@query(f"""
WITH RECURSIVE {_S}, {_votes(THETA, K, -4, 0, W)}, {_fires('cand', R)}, b AS (SELECT stream_id, event_type FROM s)
SELECT (SELECT count(*) FROM fires) / greatest((SELECT count(*) FROM s WHERE event_type <> 'purchase') / {HOUR}, 1e-9) AS far_ambient_per_hour,
       (SELECT count(*) FROM fires) / greatest((SELECT count(*) FROM s WHERE event_type = 'error'), 1) AS far_gauntlet_per_utterance""")
def two_stream_score(spark, d):
    s = stream(spark, d)
    fires = detect.detect(s, THETA, K, W, R).agg(F.count("*").alias("n"))
    n = s.agg((F.count_if(F.col("event_type") != "purchase") / HOUR).alias("hours"), F.count_if(F.col("event_type") == "error").alias("utterances"))
    return fires.crossJoin(n).select((F.col("n") / F.greatest("hours", F.lit(1e-9))).alias("far_ambient_per_hour"), (F.col("n") / F.greatest("utterances", F.lit(1))).alias("far_gauntlet_per_utterance"))


_ISLE = "i AS (SELECT *, sum(b) OVER (PARTITION BY stream_id ORDER BY hop) AS isle FROM (SELECT *, CASE WHEN hop - lag(hop) OVER (PARTITION BY stream_id ORDER BY hop) <= {gap} THEN 0 ELSE 1 END AS b FROM {src}))"


@query(f"WITH {_S}, v AS (SELECT * FROM s WHERE prob > 30), {_ISLE.format(gap=3, src='v')} SELECT stream_id, CAST(isle AS BIGINT) AS isle, min(hop) AS start_hop, max(hop) + 1 AS end_hop, count(*) AS n FROM i GROUP BY stream_id, isle HAVING max(hop) + 1 - min(hop) >= 3")
def energy_islands(spark, d):
    return islands.spans(stream(spark, d).where("prob > 30"), 3).where("end_hop - start_hop >= 3")


@query(f"""
WITH {_S}, l AS (SELECT stream_id, hop, 20 * log10(prob) AS db FROM s),
t AS (SELECT stream_id, quantile_cont(db, 0.1) AS fl, max(db) AS top FROM l GROUP BY stream_id HAVING max(db) - quantile_cont(db, 0.1) >= 15),
v AS (SELECT l.stream_id, hop, db FROM l JOIN t USING (stream_id) WHERE db > greatest(fl + 12, top - 28)), {_ISLE.format(gap=3, src='v')},
p AS (SELECT stream_id, isle, min(hop) AS start_hop, max(hop) AS end_hop FROM i GROUP BY stream_id, isle),
w AS (SELECT p.*, round(sum(pow(10.0, db / 10)), 6) AS power FROM p JOIN l ON l.stream_id = p.stream_id AND l.hop BETWEEN start_hop AND end_hop GROUP BY ALL)
SELECT stream_id, start_hop, end_hop, power FROM w QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY power DESC, isle) = 1""")
def dominant_run(spark, d):
    return islands.dominant(stream(spark, d).select("stream_id", "hop", S.decibels(F.col("prob")).alias("db")), gap=3)


@query(f"WITH {_S}, l AS (SELECT *, sum(CAST(prob >= 20 AS INT)) OVER (PARTITION BY stream_id ORDER BY hop) AS g FROM s) SELECT stream_id, hop, CAST(sum(CAST(prob < 20 AS INT)) OVER (PARTITION BY stream_id, g ORDER BY hop) AS BIGINT) AS silent_run FROM l")
def silence_runs(spark, d):
    return islands.silence(stream(spark, d), 20.0).select("stream_id", "hop", "silent_run")


GRID = [(t, g) for g in (2, 3, 1, 4) for t in (30, 25, 35, 40, 20, 50)]


@query(f"""
WITH {_S}, g AS (SELECT * FROM (VALUES {", ".join(f"({i}, {t}, {m})" for i, (t, m) in enumerate(GRID))}) AS t(ordinal, theta, gap)),
v AS (SELECT ordinal, theta, gap, stream_id, hop, lag(hop) OVER (PARTITION BY ordinal, stream_id ORDER BY hop) AS prev FROM s, g WHERE prob > theta),
n AS (SELECT ordinal, theta, gap, count(*) FILTER (prev IS NULL OR hop - prev > gap) AS n FROM v GROUP BY ALL)
SELECT CAST(ordinal AS INT) AS ordinal, CAST(theta AS INT) AS theta, CAST(gap AS INT) AS gap, n, abs(n - 1000) AS off FROM n ORDER BY off, ordinal LIMIT 1""")
def param_grid_best(spark, d):
    """First parameters in grid order whose island count is nearest to a target: every threshold's last hop before each row by
    one pass over the streams, and all counts at once; the rows aren't repeated for the grid."""
    grid = [(i, t, g) for i, (t, g) in enumerate(GRID)]
    order = Window.partitionBy("stream_id").orderBy("ts", "event_id")
    over = {t: F.col("prob") > t for _, t, _ in grid}
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = stream(spark, d).select("prob", "hop", *[F.max(F.when(x, F.col("hop"))).over(before).alias(f"prev{t}") for t, x in over.items()])
    begins = lambda t, g: over[t] & (F.col(f"prev{t}").isNull() | (F.col("hop") - F.col(f"prev{t}") > g))
    n = rows.agg(*[F.count_if(begins(t, g)).alias(f"n{i}") for i, t, g in grid])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("theta"), F.lit(g).alias("gap"), F.col(f"n{i}").alias("n")) for i, t, g in grid]))
    n = n.select(each.alias("x")).select("x.*").where("n > 0").withColumn("off", F.abs(F.col("n") - 1000))
    return n.orderBy("off", "ordinal").limit(1)


@query(f"""
WITH {_S}, c AS (SELECT stream_id, count(*) AS n FROM s GROUP BY stream_id),
w AS (SELECT stream_id, unnest(range(0, (n - 10) // 5 + 1)) AS i FROM c WHERE n >= 10)
SELECT w.stream_id, CAST(i AS INT) AS win, round(sqrt(avg(prob * prob)), 6) AS rms, round(20 * log10(sqrt(avg(prob * prob)) + 1e-12), 6) AS dbfs FROM w JOIN s ON s.stream_id = w.stream_id AND hop >= 5 * i AND hop < 5 * i + 10 GROUP BY ALL""")
def sliding_rms(spark, d):
    """Windows of 10 hops every 5: each hop goes to the windows that hold it, by key, without a range join."""
    s = stream(spark, d)
    n = s.groupBy("stream_id").agg(F.count("*").alias("n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("hop") - 9) / 5)).cast("int")
    rows = s.join(n, "stream_id").withColumn("win", F.explode(F.sequence(first, F.floor(F.col("hop") / 5).cast("int")))).where("win * 5 + 10 <= n")
    root = F.sqrt(F.avg(F.col("prob") * F.col("prob")))
    return rows.groupBy("stream_id", "win").agg(F.round(root, 6).alias("rms"), F.round(20 * F.log10(root + 1e-12), 6).alias("dbfs"))


@query(f"WITH {_S} SELECT stream_id, hop, round(prob - lag(prob) OVER w, 6) AS delta, epoch_us(ts - lag(ts) OVER w) / 1000000.0 AS gap_s, CAST(hop // 4 AS BIGINT) AS word FROM (SELECT stream_id, hop, prob, ts FROM s) WINDOW w AS (PARTITION BY stream_id ORDER BY hop)".replace("epoch_us(ts - lag(ts) OVER w) / 1000000.0", "(epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0"))
def gap_before(spark, d):
    w = Window.partitionBy("stream_id").orderBy("hop")
    s = stream(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return s.select("stream_id", "hop", F.round(F.col("prob") - F.lag("prob").over(w), 6).alias("delta"), ((F.col("us") - F.lag("us").over(w)) / 1000000.0).alias("gap_s"), F.floor(F.col("hop") / 4).alias("word"))


@query(f"WITH {_S} SELECT stream_id, hop, array_to_string(list_transform(list(prob) OVER (PARTITION BY stream_id ORDER BY hop ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), lambda x: printf('%.3f', x)), ',') AS preroll FROM s WHERE true QUALIFY prob > 150")
def preroll(spark, d):
    p = sessions.preroll(stream(spark, d)).where("prob > 150")
    return p.select("stream_id", "hop", F.array_join(S.printed(F.col("preroll"), "%.3f"), ",").alias("preroll"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 100")
def drop_oldest(spark, d):
    return sessions.newest(table(spark, d, "events"), 100, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query(f"WITH {_S} SELECT stream_id, hop, prob, CASE WHEN (hop + 1) % 5 = 0 THEN true ELSE false END AS debug FROM s WHERE (hop + 1) % 2 = 0")
def level_throttle(spark, d):
    return stream(spark, d).where("(hop + 1) % 2 = 0").select("stream_id", "hop", "prob", ((F.col("hop") + 1) % 5 == 0).alias("debug"))


@query(f"WITH {_S}, n AS (SELECT stream_id, hop, count(*) FILTER (prob > 100) OVER (PARTITION BY stream_id ORDER BY hop) AS detections FROM s) SELECT stream_id, hop, detections FROM n")
def running_detections(spark, d):
    w = Window.partitionBy("stream_id").orderBy("hop")
    return stream(spark, d).select("stream_id", "hop", F.count(F.when(F.col("prob") > 100, 1)).over(w).alias("detections"))


@query(f"""
WITH {_S}, q AS (SELECT stream_id, quantile_cont(20 * log10(prob / 500 + 1e-12), 0.2) AS fl FROM s GROUP BY stream_id)
SELECT stream_id, round(fl, 6) AS floor_db, round(least(greatest(fl + 10, -55), -30), 6) AS limit_db FROM q""")
def noise_floor(spark, d):
    db = 20 * F.log10(F.col("prob") / 500 + 1e-12)
    q = stream(spark, d).groupBy("stream_id").agg(F.percentile(db, F.lit(0.2)).alias("fl"))
    return q.select("stream_id", F.round("fl", 6).alias("floor_db"), F.round(F.least(F.greatest(F.col("fl") + 10, F.lit(-55)), F.lit(-30)), 6).alias("limit_db"))


def _levels(spark, d) -> DataFrame:
    return stream(spark, d).withColumn("level", F.col("prob") / 500)


@query()
def utterance_fsm(spark, d):
    """Two-state machine: wakes at 2 of 3 over 40, ends after 3 quiet hops or 20 hops."""
    return sessions.utterances(_levels(spark, d), theta=40.0, k=2, window=3, refractory=5, silence=0.05, quiet=3, most=20)


@query()
def utterance_capture(spark, d):
    """Onset above a limit, end after quiet hops below a lower one, with pre-roll, tail and caps."""
    from tidewell.streaming.capture import captures

    return captures(stream(spark, d).withColumn("db", S.decibels(F.col("prob"))))


@query(f"WITH RECURSIVE {_S}, {_votes(THETA, K, -4, 0, W)}, {_fires('cand', R)} SELECT stream_id, count(*) AS n_stream, count(*) AS n_batch, true AS same FROM fires GROUP BY stream_id")
def batch_equals_stream(spark, d):
    """Fires of the streaming detector over the table as a stream, beside the batch ones: both and their agreement by stream."""
    from tidewell.streaming.detector import compare

    return compare(spark, f"{d}/events.parquet", THETA, K, W, R)


@query(f"""
WITH {_S}, l AS (SELECT stream_id, event_type = 'purchase' AS kw, hop, 1000 + CAST(floor(prob) AS BIGINT) AS len FROM s),
c AS (SELECT stream_id, hop, kw, len, coalesce(sum(len + 3200) OVER (PARTITION BY stream_id ORDER BY kw DESC, hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM l)
SELECT stream_id, hop, CAST(st AS BIGINT) AS start_sample, CAST(st + len AS BIGINT) AS end_sample, CAST(st // 1600 AS BIGINT) AS start_hop, CAST(greatest(st // 1600 + 1, (st + len) // 1600) AS BIGINT) AS end_hop FROM c WHERE kw""")
def span_intervals(spark, d):
    """Clips laid end to end with gaps; the keyword clips' sample spans as hop intervals."""
    length = (1000 + F.floor("prob")).cast("long")
    kw = F.col("event_type") == "purchase"
    w = Window.partitionBy("stream_id").orderBy(F.col("kw").desc(), "hop").rowsBetween(Window.unboundedPreceding, -1)
    c = stream(spark, d).withColumns({"kw": kw, "len": length}).withColumn("st", F.coalesce(F.sum(F.col("len") + 3200).over(w), F.lit(0))).where("kw")
    first = F.floor(F.col("st") / 1600)
    return c.select("stream_id", "hop", F.col("st").cast("long").alias("start_sample"), (F.col("st") + F.col("len")).cast("long").alias("end_sample"), first.alias("start_hop"), F.greatest(first + 1, F.floor((F.col("st") + F.col("len")) / 1600)).alias("end_hop"))
