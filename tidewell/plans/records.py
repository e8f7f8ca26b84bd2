"""Queries on records: manifests, listings, entity records, shown text, sessions and their counters."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import sessions
from tidewell.plans.detection import _S, stream, table
from tidewell.sources import files
from tidewell.streaming import counters

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query("SELECT event_id, event_type, props FROM events WHERE event_type = 'view' AND contains(props, '1') AND value >= 10")
def manifest_filter(spark, d):
    return table(spark, d, "events").where((F.col("event_type") == "view") & F.contains("props", F.lit("1")) & (F.col("value") >= 10)).select("event_id", "event_type", "props")


#: What a segment's name is expected to begin with.
EXPECTED = {"AUTOMOBILE": "AUTO", "BUILDING": "BUILD", "FURNITURE": "FERN", "HOUSEHOLD": "HOUSE", "MACHINERY": "MACH"}


@query(f"SELECT c_custkey, c_mktsegment AS word, prefix, coalesce(starts_with(c_mktsegment, prefix), false) AS hit FROM customer LEFT JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in EXPECTED.items())}) AS t(word, prefix) ON word = c_mktsegment")
def prefix_lookup(spark, d):
    """Each word's expected prefix from a small table."""
    truth = spark.createDataFrame(list(EXPECTED.items()), "word string, prefix string")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("word"))
    return c.join(F.broadcast(truth), "word", "left").select("c_custkey", "word", "prefix", F.coalesce(F.col("word").startswith(F.col("prefix")), F.lit(False)).alias("hit"))


@query("SELECT regexp_extract(p_name, '^([a-z]+)', 1) AS word, count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY word")
def by_word(spark, d):
    """Least, largest and mean by a word taken from the name."""
    p = F.col("p_retailprice")
    return table(spark, d, "part").groupBy(F.regexp_extract("p_name", "^([a-z]+)", 1).alias("word")).agg(F.count("*").alias("n"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.round(F.avg(p), 6).alias("mean"))


@query("""
WITH old AS (SELECT user_id, event_type, max(event_id % 50) AS top FROM events WHERE event_id % 3 = 0 GROUP BY user_id, event_type)
SELECT e.event_id, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY ts, event_id) AS BIGINT) AS take
FROM events e LEFT JOIN old o ON o.user_id = e.user_id AND o.event_type = e.event_type WHERE event_id % 3 <> 0""")
def take_numbering(spark, d):
    """New takes go on from the largest number of their session and label."""
    e = table(spark, d, "events")
    by = ["user_id", "event_type"]
    old = e.where("event_id % 3 = 0").select(*by, (F.col("event_id") % 50).alias("take"))
    return sessions.resumed(e.where("event_id % 3 <> 0"), old, by, ["ts", "event_id"], "take").select("event_id", "take")


@query("SELECT p_brand, array_to_string(list_slice(list(DISTINCT p_name ORDER BY p_name), 1, 3), ' | ') AS facts, count(DISTINCT p_name) AS n FROM part GROUP BY p_brand")
def top_facts(spark, d):
    """The first three of a list."""
    names = F.array_sort(F.collect_set("p_name"))
    return table(spark, d, "part").groupBy("p_brand").agg(names.alias("a")).select("p_brand", F.array_join(F.slice("a", 1, 3), " | ").alias("facts"), F.size("a").cast("long").alias("n"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') AS clock FROM events")
def clock_text(spark, d):
    t = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.unix_millis(t).alias("ms"), T.clock(t).alias("clock"))


@query("SELECT s_suppkey, s_name AS name, n_name AS nation, round(s_acctbal / 10000, 3) AS confidence, CASE WHEN s_suppkey % 2 = 0 THEN 'alias' ELSE 'fuzzy' END AS matched_by FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def entity_merge(spark, d):
    """A match as its entity's record with confidence and layer added."""
    e = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_acctbal", F.struct(F.col("s_name").alias("name"), F.col("n_name").alias("nation")).alias("entity"))
    by = F.when(F.col("s_suppkey") % 2 == 0, "alias").otherwise("fuzzy")
    merged = T.merged(F.col("entity"), ["name", "nation"], confidence=F.round(F.col("s_acctbal") / 10000, 3), matched_by=by)
    return e.select("s_suppkey", merged.alias("m")).select("s_suppkey", "m.*")


_STATUS = "CASE k WHEN 0 THEN 'Operational' WHEN 1 THEN 'Mission complete (landing ' || n || ')' WHEN 2 THEN 'In development  (planned) ' WHEN 3 THEN 'Contact lost (TODO: verify x) (after launch)' ELSE '' END"


@query(f"""
WITH x AS (SELECT s_suppkey, {_STATUS} AS status FROM (SELECT s_suppkey, s_suppkey % 5 AS k, s_name AS n FROM supplier)),
c AS (SELECT s_suppkey, trim(regexp_replace(status, '(?i)\\s*\\((todo|fixme|tbd|verify)\\b[^)]*\\)', '', 'g')) AS status FROM x),
h AS (SELECT s_suppkey, status, CASE WHEN regexp_matches(status, '^[^(]+?\\s*\\(.+\\)\\s*$') THEN rtrim(regexp_extract(status, '^([^(]+?)\\s*\\(.+\\)\\s*$', 1)) ELSE status END AS head, regexp_extract(status, '^[^(]+?\\s*\\((.+)\\)\\s*$', 1) AS detail FROM c)
SELECT s_suppkey, head, detail, CASE WHEN starts_with(lower(head), 'operational') THEN 'good' WHEN starts_with(lower(head), 'in development') OR contains(lower(head), 'lost') THEN 'warn' ELSE '' END AS tone,
  CASE WHEN length(status) <= 32 THEN 8.1 WHEN length(status) <= 64 THEN 7.0 WHEN length(status) <= 110 THEN 5.9 ELSE 5.0 END AS tier FROM h""")
def status_text(spark, d):
    """Statuses without annotations: head, detail, tone, and the size tier of the text."""
    k, n = F.col("s_suppkey") % 5, F.col("s_name")
    status = F.when(k == 0, "Operational").when(k == 1, F.concat(F.lit("Mission complete (landing "), n, F.lit(")"))).when(k == 2, "In development  (planned) ").when(k == 3, "Contact lost (TODO: verify x) (after launch)").otherwise("")
    s = table(spark, d, "supplier").select("s_suppkey", T.without_annotations(status).alias("status"))
    head, detail = T.split_status(F.col("status"))
    return s.select("s_suppkey", head.alias("head"), detail.alias("detail"), T.status_tone(head).alias("tone"), T.size_tier(F.col("status")).alias("tier"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN 'soon' ELSE CAST(day(o_orderdate) AS VARCHAR) || ' ' || strftime(o_orderdate, '%b %Y') END AS shown FROM orders")
def shown_dates(spark, d):
    """Dates in the form yyyy-mm-dd as day, month name and year; anything else as it is."""
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", T.shown_date(F.when(k == 0, None).when(k == 1, "soon").otherwise(day)).alias("shown"))


_COUNTS = f"""
WITH {_S} SELECT stream_id, count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS detections, count(*) FILTER (event_type = 'error') AS reconnects,
 (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS uptime_s FROM s GROUP BY stream_id"""


@query(_COUNTS)
def session_counters(spark, d):
    return counters.counted(stream(spark, d))


@query(_COUNTS)
def session_counters_live(spark, d):
    """The same by a stream over four files, one micro-batch each."""
    e = stream(spark, d)
    path = f"{files.shared_folder(spark)}/tidewell-stream/{uuid.uuid4().hex}"
    e.repartition(4, "hop").write.parquet(f"{path}/in")
    live = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return counters.latest(counters.counted(live), path)


@query("""
WITH m AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS session FROM conversations)
SELECT conv_id, CAST(session AS BIGINT) AS session, min(turn) AS first_turn, min(turn) FILTER (role = 'assistant') AS end_turn, count(*) AS n FROM m WHERE session > 0 GROUP BY conv_id, session HAVING count(*) FILTER (role = 'assistant') > 0""")
def finished_sessions(spark, d):
    """A begin mark discards an unfinished session before it; rows ahead of the first mark are ignored."""
    return sessions.finished(table(spark, d, "conversations"), F.col("role") == "user", F.col("role") == "assistant", "conv_id", "turn").select("conv_id", "session", F.col("first").alias("first_turn"), F.col("end").alias("end_turn"), "n")


@query("""
WITH n AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'wake' WHEN 'purchase' THEN 'content' WHEN 'error' THEN 'idle' END AS now FROM events),
l AS (SELECT *, last_value(now IGNORE NULLS) OVER w AS state, last_value(CASE WHEN now IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS since FROM n WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, CASE WHEN state IS NULL OR (state = 'content' AND epoch_us(ts) - epoch_us(since) >= 36000000000) THEN 'idle' ELSE state END AS state FROM l""")
def ui_state_hold(spark, d):
    """The shown state; content falls back to idle after its hold (ten hours here, the events lie far apart)."""
    e = F.col("event_type")
    now = F.when(e == "signup", "wake").when(e == "purchase", "content").when(e == "error", "idle")
    return sessions.shown_state(table(spark, d, "events"), now, "user_id", ["ts", "event_id"], "ts", {"content": 36000.0}).select("user_id", "event_id", "state")


@query("SELECT event_id, event_id % 10 <> 0 AND event_id % 15 <> 1 AS valid, CASE WHEN event_id % 10 <> 0 AND event_id % 15 <> 1 THEN CAST(json_extract(props, '$.k') AS INT) END AS k FROM events")
def event_faults(spark, d):
    """Malformed events are split off, not lost: broken texts, and texts of another kind."""
    raw = F.when(F.col("event_id") % 10 == 0, F.lit('{"k": ')).when(F.col("event_id") % 15 == 1, F.lit("no event")).otherwise(F.col("props"))
    good, bad = files.decoded(table(spark, d, "events").select("event_id", raw.alias("raw")), "raw", "k INT")
    return good.select("event_id", F.lit(True).alias("valid"), "value.k").unionByName(bad.select("event_id", F.lit(False).alias("valid"), F.lit(None).cast("int").alias("k")))


@query("SELECT w AS token, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS owners FROM (SELECT unnest(string_split(p_name, ' ')) AS w, p_brand FROM part) GROUP BY w")
def token_owners(spark, d):
    """All owners of a token, united from lists."""
    p = table(spark, d, "part").groupBy("p_name").agg(F.collect_set("p_brand").alias("owners"))
    t = p.select(F.explode(F.split("p_name", " ")).alias("token"), "owners").groupBy("token").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("owners")))).alias("o"))
    return t.select("token", F.array_join("o", ",").alias("owners"))


@query("SELECT p_brand || '/' || p_partkey || '.wav' AS path FROM part WHERE p_partkey % 7 = 3 AND p_brand <> '' AND NOT starts_with(p_brand, '.')")
def held_files(spark, d):
    """Files of the held-out session."""
    listing = table(spark, d, "part").select(F.concat("p_brand", F.lit("/"), "p_partkey", F.lit(".wav")).alias("path"), (F.col("p_partkey") % 7).alias("session"))
    return files.held(listing, "session", 3).select("path")


REQUIRED = ["ALGERIA", "BRAZIL", "ATLANTIS", "FRANCE", "LEMURIA"]


@query(f"SELECT name AS missing FROM (VALUES {', '.join(f"('{x}')" for x in REQUIRED)}) AS t(name) WHERE name NOT IN (SELECT n_name FROM nation)")
def missing_required(spark, d):
    need = spark.createDataFrame([(x,) for x in REQUIRED], "name string")
    return files.missing(need, table(spark, d, "nation").select(F.col("n_name").alias("name")), "name").select(F.col("name").alias("missing"))


@query("SELECT p_partkey AS id, 'img/' || p_partkey || '.jpg' AS image, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49) AS needs_image FROM part")
def image_report(spark, d):
    """Records whose file isn't in the listing."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("img/"), "p_partkey", F.lit(".jpg")).alias("image"))
    there = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("img/"), "l_partkey", F.lit(".jpg")).alias("image")).distinct()
    return files.report(p, there, "image").select("id", "image", F.col("missing").alias("needs_image"))


@query(f"WITH {_S}, f AS (SELECT stream_id, arg_min(hop, event_id) AS hop0, list(prob ORDER BY hop) AS x FROM s GROUP BY stream_id) SELECT stream_id, CAST(hop0 AS INT) AS first_hop, len(list_slice(x, 1, 40)) AS n_real, 40 AS n, round(list_sum(list_slice(x, 1, 40)), 6) AS total FROM f")
def first_clip(spark, d):
    """A group's first clip by name; cut or padded at its end, not centred."""
    s = stream(spark, d)
    g = s.groupBy("stream_id").agg(F.min_by("hop", "event_id").alias("first_hop"), F.transform(F.array_sort(F.collect_list(F.struct("hop", "prob"))), lambda v: v["prob"]).alias("x"))
    y = files.fit_at_end(F.col("x"), 40)
    return g.select("stream_id", "first_hop", F.least(F.size("x"), F.lit(40)).cast("long").alias("n_real"), F.size(y).alias("n"), F.round(F.aggregate(y, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("SELECT lang, doc_id, epoch, CAST(row_number() OVER (PARTITION BY epoch, lang ORDER BY sha1(CAST(100 + epoch AS VARCHAR) || ':' || doc_id), doc_id) AS INT) AS place FROM documents, (SELECT unnest([0, 1]) AS epoch)")
def epoch_order(spark, d):
    """Orders of two epochs: the epoch is a column that feeds the seed."""
    e = table(spark, d, "documents").select("lang", "doc_id").withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
    key = F.sha1(F.concat_ws(":", (F.col("epoch") + 100).cast("string"), F.col("doc_id").cast("string")))
    return e.select("lang", "doc_id", "epoch", F.row_number().over(Window.partitionBy("epoch", "lang").orderBy(key, "doc_id")).alias("place"))


@query(f"WITH {_S}, l AS (SELECT stream_id, list(prob ORDER BY hop) AS x FROM s GROUP BY stream_id) SELECT stream_id, CAST(i AS INT) AS win, round(list_sum(list_slice(x, 5 * i + 1, 5 * i + 10)), 6) AS total FROM (SELECT stream_id, x, unnest(range(0, (len(x) - 10) // 5 + 1)) AS i FROM l WHERE len(x) >= 10)")
def generated_windows(spark, d):
    """Windows from a generator: a table function that yields rows lazily."""
    from tidewell.functions.generators import windows_of

    x = stream(spark, d).groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hop", "prob"))), lambda v: v["prob"]).alias("x"))
    g = x.lateralJoin(windows_of(F.col("x").outer(), F.lit(10), F.lit(5)))
    return g.select("stream_id", "win", F.round(F.aggregate("features", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))
