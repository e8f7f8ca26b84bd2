"""Queries on live channels: frames from a source of their own, utterances, shown states, bounded buffers, captures that time out.

The events table is sent as frames, one channel for each user, in five commits; after each commit the stream starts
anew from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import signal as S
from tidewell.plans.detection import _S, stream, table
from tidewell.sources import frames
from tidewell.streaming import live, machines
from tidewell.streaming.capture import captures

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


def _messages(spark, d) -> DataFrame:
    """Events as frames: views are binary, every tenth frame is broken JSON, the others are JSON."""
    e = table(spark, d, "events")
    v = F.floor("value")
    binary, broken = F.col("event_type") == "view", F.col("event_id") % 10 == 0
    text = F.when(broken, '{"event": ').otherwise(F.to_json(F.struct(F.col("event_type").alias("event"), F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("k"))))
    return e.select(F.col("user_id").alias("channel"), F.col("ts").cast("timestamp").alias("at"), F.when(broken | ~binary, text).alias("text"), F.when(~broken & binary, frames.pcm_bytes([v, -v, v - 40_000])).alias("data"))


@query("""
WITH f AS (SELECT user_id AS channel, CASE WHEN event_id % 10 = 0 THEN 'bad' WHEN event_type = 'view' THEN 'pcm' ELSE 'event' END AS kind, event_type, CAST(floor(value) AS INT) AS v, CAST(json_extract(props, '$.k') AS INT) AS k, event_id FROM events),
w AS (SELECT *, CASE WHEN v - 40000 < -32768 THEN v - 40000 + 65536 ELSE v - 40000 END AS third FROM f)
SELECT channel, count(*) AS n, count(*) FILTER (kind = 'event') AS n_events, count(*) FILTER (kind = 'bad') AS n_bad, count(*) FILTER (kind = 'event' AND event_type = 'error') AS n_errors, CAST(sum(k) FILTER (kind = 'event') AS BIGINT) AS sum_k,
  CAST(sum(event_id) FILTER (kind = 'event') AS BIGINT) AS sum_id, CAST(3 * count(*) FILTER (kind = 'pcm') AS BIGINT) AS n_samples, CAST(max(greatest(v, abs(third))) FILTER (kind = 'pcm') AS INT) AS peak FROM w GROUP BY channel""")
def live_frames(spark, d):
    """Frames written by commits and read by a stream that is started anew after each: none is lost or read twice."""

    def build(f: DataFrame) -> DataFrame:
        return frames.samples_of(frames.judged(f, "event STRING, id LONG, k INT")).select("channel", "value", "bad", "pcm")

    got = live.replay(_messages(spark, d), PARTS, build)
    v, loud = F.col("value"), F.array_max(F.transform("pcm", lambda x: F.abs(x)))
    return got.groupBy("channel").agg(F.count("*").alias("n"), F.count("value").alias("n_events"), F.count_if("bad").alias("n_bad"), F.count_if(v["event"] == "error").alias("n_errors"), F.sum(v["k"]).alias("sum_k"), F.sum(v["id"]).alias("sum_id"), F.coalesce(F.sum(F.size("pcm")).cast("long"), F.lit(0)).alias("n_samples"), F.max(loud).alias("peak"))


def _marked(spark, d, what, body) -> DataFrame:
    """Events as JSON frames with a mark and a body."""
    e = table(spark, d, "events")
    text = F.to_json(F.struct(F.col("event_id").alias("id"), what.alias("event"), body.cast("string").alias("body")))
    return e.select(F.col("user_id").alias("channel"), F.col("ts").cast("timestamp").alias("at"), text.alias("text"), F.lit(None).cast("binary").alias("data"))


def _read(f: DataFrame) -> DataFrame:
    """Rows for the processors."""
    good, _ = frames.events_of(f, "id LONG, event STRING, body STRING")
    return good.select("channel", "at", F.col("value.id").alias("place"), "value.event", "value.body")


#: Hours (microseconds) after which an utterance that hasn't ended is an orphan, and after which shown content falls back.
HOLD, SHOWN = 48 * 3_600_000_000, 10 * 3_600_000_000
_BODY = "CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k') WHEN CAST(json_extract(props, '$.k') AS INT) % 5 = 0 THEN '' ELSE 'heard ' || (CAST(json_extract(props, '$.k') AS INT) % 3) END"
#: The watermark at the end, in milliseconds.
_MARK = "(SELECT max(epoch_us(ts)) // 1000 FROM events)"


@query(f"""
WITH e AS (SELECT user_id AS channel, epoch_us(ts) AS t, event_id AS id, CASE event_type WHEN 'signup' THEN 'wake' WHEN 'purchase' THEN 'end' WHEN 'error' THEN 'drop' WHEN 'view' THEN 'segment' ELSE 'partial' END AS what, {_BODY} AS body FROM events),
o AS (SELECT *, count(*) FILTER (what IN ('wake', 'drop')) OVER w AS g, count(*) FILTER (what = 'wake') OVER w AS session, max(t) OVER (PARTITION BY channel) AS last FROM e WINDOW w AS (PARTITION BY channel ORDER BY t, id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT channel, g, session, t AS first_at, last FROM o WHERE what = 'wake'),
x AS (SELECT b.*, (SELECT min(t) FROM o n WHERE n.channel = b.channel AND n.g = b.g + 1) AS next, (SELECT min({{'t': t, 'id': id}}) FROM o WHERE o.channel = b.channel AND o.g = b.g AND what = 'end' AND t <= first_at + {HOLD}) AS fin FROM b),
y AS (SELECT x.*, CASE WHEN fin IS NOT NULL THEN 'transcript' WHEN (next IS NULL OR next > first_at + {HOLD}) AND (last > first_at + {HOLD} OR (first_at + {HOLD} + 1 + 999) // 1000 <= {_MARK}) THEN 'orphan' END AS what FROM x),
p AS (SELECT y.channel, y.session, first_at, o.t AS end_at, o.body, lag(o.body) OVER (PARTITION BY o.channel, o.g ORDER BY o.t, o.id) AS prev, (SELECT count(*) FROM o s WHERE s.channel = o.channel AND s.g = o.g AND s.what = 'segment' AND (s.t < o.t OR (s.t = o.t AND s.id < o.id))) AS n
  FROM y JOIN o ON o.channel = y.channel AND o.g = y.g WHERE o.what = 'partial' AND o.body <> '' AND o.t <= first_at + {HOLD} AND (fin IS NULL OR o.t < fin.t OR (o.t = fin.t AND o.id < fin.id)))
SELECT channel, session, 'partial' AS what, first_at, end_at, n, body AS transcript FROM p WHERE body IS DISTINCT FROM prev
UNION ALL SELECT y.channel, y.session, y.what, first_at, CASE WHEN y.what = 'orphan' THEN first_at + {HOLD} ELSE fin.t END AS end_at, count(o.id) AS n, coalesce(string_agg(o.body, ' ' ORDER BY o.t, o.id), '') AS transcript
FROM y LEFT JOIN o ON o.channel = y.channel AND o.g = y.g AND o.what = 'segment' AND CASE WHEN y.what = 'orphan' THEN o.t <= first_at + {HOLD} ELSE o.t < fin.t OR (o.t = fin.t AND o.id < fin.id) END
WHERE y.what IS NOT NULL GROUP BY y.channel, y.session, y.what, first_at, fin""")
def live_utterances(spark, d):
    """Utterances of the frame stream by wake and end: partial texts that changed, transcripts, and the orphans that a timer drops."""
    e, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    what = F.when(e == "signup", "wake").when(e == "purchase", "end").when(e == "error", "drop").when(e == "view", "segment").otherwise("partial")
    body = F.when(e == "view", k.cast("string")).when(k % 5 == 0, "").otherwise(F.concat(F.lit("heard "), (k % 3).cast("string")))
    build = lambda f: live.run(_read(f), live.Utterances(HOLD), "session long, what string, first_at long, end_at long, n long, transcript string")
    return live.replay(_marked(spark, d, what, body), PARTS, build)


@query(f"""
WITH e AS (SELECT user_id AS channel, epoch_us(ts) AS t, event_id AS id, CASE event_type WHEN 'signup' THEN 'wake' WHEN 'purchase' THEN 'content' WHEN 'error' THEN 'idle' END AS now, max(epoch_us(ts)) OVER (PARTITION BY user_id) AS last FROM events),
n AS (SELECT *, lead(t) OVER (PARTITION BY channel ORDER BY t, id) AS next FROM e WHERE now IS NOT NULL)
SELECT channel, t AS since, now AS state FROM n
UNION ALL SELECT channel, t + {SHOWN}, 'idle' FROM n WHERE now = 'content' AND (next IS NULL OR next >= t + {SHOWN}) AND (last >= t + {SHOWN} OR (t + {SHOWN} + 999) // 1000 <= {_MARK})""")
def live_states(spark, d):
    """The shown state at every change; content falls back to idle by a timer when its hold is over."""
    e = F.col("event_type")
    now = F.when(e == "signup", "wake").when(e == "purchase", "content").when(e == "error", "idle")
    return live.replay(_marked(spark, d, now, F.lit("")), PARTS, lambda f: live.run(_read(f), live.Shown({"content": SHOWN}), "since long, state string"))


MOST = 25


@query(f"SELECT user_id AS channel, event_id, value, CAST(greatest(count(*) OVER (PARTITION BY user_id) - {MOST}, 0) AS BIGINT) AS dropped FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= {MOST}")
def live_buffer(spark, d):
    """The newest rows that a channel's bounded buffer holds in the end, and how many it has dropped."""
    got = live.replay(_marked(spark, d, F.lit("row"), F.col("value")), PARTS, lambda f: live.run(_read(f), live.Buffer(MOST), "seen long, dropped long, place long, body string"))
    last = got.groupBy("channel").agg(F.max("seen").alias("seen"))
    return got.join(last, ["channel", "seen"]).select("channel", F.col("place").alias("event_id"), F.col("body").cast("double").alias("value"), "dropped")


#: Capture: onset, drop, quiet hops, pre-roll, tail, most hops, hops without an onset until it gives up.
ONSET, DROP, QUIET, PRE, TAIL, LONG, WAIT = 38.0, 3.0, 3, 3, 2, 20, 6

_CAPTURES = f"""
WITH RECURSIVE {_S}, l AS (SELECT stream_id, hop, 20 * log10(prob) AS db FROM s),
m AS (
  SELECT stream_id, -1 AS hop, CAST(NULL AS INT) AS first, 0 AS waited, 0 AS voiced, 0 AS silent, 0 AS free, CAST(NULL AS VARCHAR) AS what, 0 AS o_first, 0 AS o_last, false AS hit FROM (SELECT DISTINCT stream_id FROM l)
  UNION ALL
  SELECT stream_id, hop, CASE WHEN on_set THEN greatest(free, hop - {PRE}) WHEN ended THEN NULL ELSE first END, CASE WHEN on_set OR late OR first IS NOT NULL THEN 0 ELSE waited + 1 END, CASE WHEN on_set OR loud THEN hop ELSE voiced END,
    CASE WHEN on_set OR loud THEN 0 ELSE silent + 1 END, CASE WHEN ended OR late THEN hop + 1 ELSE free END, CASE WHEN ended THEN 'utterance' WHEN late THEN 'timeout' END,
    CASE WHEN ended THEN first WHEN late THEN hop - {WAIT - 1} END, CASE WHEN ended THEN least(hop, CASE WHEN loud THEN hop ELSE voiced END + {TAIL}) WHEN late THEN hop END, ended AND NOT still
  FROM (SELECT *, first IS NOT NULL AND (still OR hop - first + 1 >= {LONG}) AS ended FROM (
    SELECT l.stream_id, l.hop, m.first, m.waited, m.voiced, m.silent, m.free, m.first IS NULL AND db > {ONSET} AS on_set, m.first IS NULL AND db <= {ONSET} AND m.waited + 1 >= {WAIT} AS late, m.first IS NOT NULL AND db >= {ONSET - DROP} AS loud,
      m.first IS NOT NULL AND db < {ONSET - DROP} AND m.silent + 1 >= {QUIET} AS still FROM m JOIN l ON l.stream_id = m.stream_id AND l.hop = m.hop + 1)))
SELECT stream_id, what, CAST(o_first AS BIGINT) AS first_hop, CAST(o_last AS BIGINT) AS last_hop, what = 'utterance' AND hit AS hit_max FROM m WHERE what IS NOT NULL"""


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"what": F.when(F.col("hit_max").isNull(), "timeout").otherwise("utterance"), "hit_max": F.coalesce("hit_max", F.lit(False))})


def _db(spark, d) -> DataFrame:
    return stream(spark, d).select("stream_id", "hop", S.decibels(F.col("prob")).alias("db"))


_HOW = dict(onset=ONSET, drop=DROP, quiet=QUIET, pre=PRE, tail=TAIL, most=LONG, wait=WAIT)


@query(_CAPTURES)
def capture_attempts(spark, d):
    """Captured utterances, and the attempts that heard no onset in time."""
    return _named(captures(_db(spark, d), **_HOW))


@query(_CAPTURES)
def capture_attempts_live(spark, d):
    """The same as a stream of four micro-batches."""
    return _named(live.replay_hops(_db(spark, d), 4, lambda rows: machines.captured(rows, **_HOW)))
