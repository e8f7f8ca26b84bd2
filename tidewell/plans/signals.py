"""Queries on recordings that the tables give: clips cut from spans, filters, backgrounds, conditions, nearest rows; hits and entity texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import mfcc as M
from tidewell.functions import signal as S
from tidewell.functions import text as T
from tidewell.operators import islands, long, nearest, ranks
from tidewell.plans.detection import _S, stream, table
from tidewell.sources import generate

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query("""
SELECT a.vec_id AS query_id, b.vec_id AS other, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) = 1""")
def nearest_rows(spark, d):
    """The nearest row of the whole table to every row whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    return nearest.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding").withColumn("score", F.round("score", 6))


#: Samples of a hop, padding in samples, clips that a stream should have, hops of the shortest clip; thresholds and gaps in the order they are tried.
HOP, PAD, CLIPS, SHORTEST = 8, 11, 5, 2
TRIED = [(t, g) for g in (2, 3, 1) for t in (30.0, 45.0, 20.0, 70.0)]

_CLIPS = f"""
WITH {_S}, g AS (SELECT * FROM (VALUES {", ".join(f"({i}, {t}, {m})" for i, (t, m) in enumerate(TRIED))}) AS t(ordinal, theta, gap)),
v AS (SELECT ordinal, theta, gap, stream_id, hop, CASE WHEN hop - lag(hop) OVER (PARTITION BY ordinal, stream_id ORDER BY hop) <= gap THEN 0 ELSE 1 END AS begins FROM s, g WHERE prob > theta),
i AS (SELECT *, sum(begins) OVER (PARTITION BY ordinal, stream_id ORDER BY hop) AS isle FROM v),
p AS (SELECT ordinal, theta, gap, stream_id, isle, min(hop) AS a, max(hop) + 1 AS e FROM i GROUP BY ALL HAVING max(hop) + 1 - min(hop) >= {SHORTEST}),
n AS (SELECT t.stream_id, g.ordinal, count(p.isle) AS n FROM (SELECT DISTINCT stream_id FROM s) t CROSS JOIN g LEFT JOIN p ON p.stream_id = t.stream_id AND p.ordinal = g.ordinal GROUP BY ALL),
b AS (SELECT stream_id, ordinal FROM n QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY abs(n - {CLIPS}), ordinal) = 1),
l AS (SELECT stream_id, (max(hop) + 1) * {HOP} AS size FROM s GROUP BY stream_id),
c AS (SELECT p.stream_id, p.ordinal, p.theta, p.gap, row_number() OVER (PARTITION BY p.stream_id ORDER BY a) - 1 AS clip, greatest(0, a * {HOP} - {PAD}) AS lo, least(size, e * {HOP} + {PAD}) AS behind FROM p JOIN b USING (stream_id, ordinal) JOIN l ON l.stream_id = p.stream_id),
x AS (SELECT stream_id, hop * {HOP} + j AS pos, floor(prob) * {HOP} + j AS v FROM s, (SELECT unnest(range(0, {HOP})) AS j))
SELECT c.stream_id, CAST(ordinal AS INT) AS ordinal, CAST(clip AS INT) AS clip, CAST(lo AS BIGINT) AS start_sample, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum((pos - lo) * v) AS BIGINT) AS weighted
FROM c JOIN x ON x.stream_id = c.stream_id AND pos >= lo AND pos < behind GROUP BY c.stream_id, ordinal, clip, lo"""


@query(_CLIPS)
def split_clips(spark, d):
    """Recordings split into padded clips of samples, with the parameters that give a stream the number of clips it should have."""
    s = stream(spark, d)
    recording = s.select("stream_id", "hop", "prob", F.transform(F.sequence(F.lit(0), F.lit(HOP - 1)), lambda j: (F.floor("prob") * HOP + j).cast("long")).alias("samples"))
    grid = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(TRIED)], "ordinal int, theta double, gap int")
    spans = islands.best_split(s.select("stream_id", "hop", "prob"), grid, CLIPS, SHORTEST)
    c = islands.clips(spans, recording, HOP, PAD)
    x = F.col("samples")
    add = lambda y: F.aggregate(y, F.lit(0).cast("long"), lambda a, v: a + v)
    return c.select("stream_id", "ordinal", "clip", "start_sample", F.size(x).cast("long").alias("n"), add(x).alias("total"), add(F.transform(x, lambda v, i: v * i)).alias("weighted"))


_B, _A = M.shelf(8.0)


@query(f"""
WITH RECURSIVE {_S}, x AS (SELECT stream_id, hop, prob / 500 AS x FROM s),
f AS (SELECT DISTINCT stream_id, CAST(-1 AS INT) AS hop, CAST(0 AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS x2, CAST(0 AS DOUBLE) AS y1, CAST(0 AS DOUBLE) AS y2 FROM x
      UNION ALL SELECT f.stream_id, x.hop, x.x, f.x1, {_B[0]!r} * x.x + {_B[1]!r} * f.x1 + {_B[2]!r} * f.x2 - ({_A[0]!r}) * f.y1 - ({_A[1]!r}) * f.y2, f.y1 FROM f JOIN x ON x.stream_id = f.stream_id AND x.hop = f.hop + 1),
y AS (SELECT stream_id, hop, least(greatest(y1, -1), 1) AS y FROM f WHERE hop >= 0)
SELECT stream_id, count(*) AS n, round(sqrt(avg(y * y)), 6) AS rms, round(max(abs(y)), 6) AS peak, round(arg_max(y, hop), 6) AS last FROM y GROUP BY stream_id""")
def shelved_streams(spark, d):
    """Recordings with their bass raised by 8 dB."""
    g = stream(spark, d).groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hop", "prob"))), lambda v: v["prob"] / 500).alias("x"))
    g = g.select("stream_id", M.low_shelf(8.0)("x").alias("y"))
    return g.select("stream_id", F.size("y").cast("long").alias("n"), F.round(S.rms(F.col("y")), 6).alias("rms"), F.round(S.peak(F.col("y")), 6).alias("peak"), F.round(F.element_at("y", -1), 6).alias("last"))


def _pick(key: str, n: str) -> str:
    return f"CAST('0x' || substr(sha1('5:' || {key}), 1, 8) AS BIGINT) % {n}"


@query(f"""
WITH {_S}, p AS (SELECT stream_id, row_number() OVER (ORDER BY stream_id) - 1 AS ord, count(*) AS n, sum(prob) AS total FROM s WHERE stream_id % 3 = 0 GROUP BY stream_id), k AS (SELECT count(*) AS k FROM p)
SELECT c.vec_id AS clip, p.stream_id AS background, p.n AS n, round(total, 4) AS total FROM embeddings c, k JOIN p ON p.ord = {_pick('c.vec_id', 'k')}""")
def picked_backgrounds(spark, d):
    """Each clip with a recording of the pool, picked by a hash of the clip."""
    s = stream(spark, d).where("stream_id % 3 = 0").groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hop", "prob"))), lambda v: v["prob"]).alias("samples"))
    picked = generate.background(table(spark, d, "embeddings").select(F.col("vec_id").alias("clip")), s, "clip", "stream_id", 5)
    b = F.col("background")
    return picked.select("clip", F.col("picked").alias("background"), F.size(b).cast("long").alias("n"), F.round(F.aggregate(b, F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


TAKE, STEP, QUIET = 10, 5, 7


@query(f"""
WITH {_S}, c AS (SELECT stream_id, max(hop) + 1 AS n FROM s GROUP BY stream_id), w AS (SELECT stream_id, n, unnest(range(0, greatest(0, (n + 2 * {QUIET} - {TAKE}) // {STEP} + 1))) AS i FROM c)
SELECT w.stream_id, CAST(i AS INT) AS win, round(coalesce(sum(prob), 0), 4) AS total FROM w LEFT JOIN s ON s.stream_id = w.stream_id AND hop >= i * {STEP} - {QUIET} AND hop < i * {STEP} - {QUIET} + {TAKE} GROUP BY w.stream_id, i""")
def padded_takes(spark, d):
    """Takes as streams with silence on both sides, in windows."""
    g = stream(spark, d).groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hop", "prob"))), lambda v: v["prob"]).alias("x"))
    wins = S.windows(S.take_stream(F.col("x"), QUIET), TAKE, STEP)
    w = g.select("stream_id", F.posexplode(wins).alias("win", "y"))
    return w.select("stream_id", "win", F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


CONDITIONS = [("clean", 0.0), ("gain", -20.0), ("gain", 6.0), ("gain", 12.0), ("level", -11.0), ("level", -30.0)]


@query(f"""
WITH {_S}, x AS (SELECT stream_id, hop, prob / 500 - 0.1 AS x FROM s), c AS (SELECT * FROM (VALUES {", ".join(f"('{c}', CAST({v} AS DOUBLE))" for c, v in CONDITIONS)}) AS t(condition, value)),
r AS (SELECT stream_id, sqrt(avg(x * x)) AS r FROM x GROUP BY stream_id),
y AS (SELECT stream_id, condition, value, CASE condition WHEN 'gain' THEN least(greatest(x * pow(10.0, value / 20), -1), 1) WHEN 'level' THEN least(greatest(x * pow(10.0, value / 20) / r, -1), 1) ELSE x END AS y FROM x JOIN r USING (stream_id), c)
SELECT stream_id, condition, value, count(*) AS n, round(20 * log10(sqrt(avg(y * y)) + 1e-12), 4) AS dbfs, round(max(abs(y)), 6) AS peak FROM y GROUP BY stream_id, condition, value""")
def stream_conditions(spark, d):
    """Recordings under gains and set levels, crossed with a small table of conditions."""
    g = stream(spark, d).groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hop", "prob"))), lambda v: v["prob"] / 500 - 0.1).alias("x"))
    rows = g.crossJoin(F.broadcast(spark.createDataFrame(CONDITIONS, "condition string, value double")))
    x, v, c = F.col("x"), F.col("value"), F.col("condition")
    y = F.when(c == "gain", S.clip(S.gain(x, v))).when(c == "level", S.to_level(x, v)).otherwise(x)
    rows = rows.select("stream_id", "condition", "value", y.alias("y"))
    return rows.select("stream_id", "condition", "value", F.size("y").cast("long").alias("n"), F.round(S.dbfs(F.col("y")), 4).alias("dbfs"), F.round(S.peak(F.col("y")), 6).alias("peak"))


SPELLED = ["misty", "antique"]


@query(f"""
WITH x AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS word, CASE p_partkey % 4 WHEN 0 THEN lower(p_name) WHEN 1 THEN 'x' || lower(p_name) WHEN 2 THEN array_to_string(string_split(lower(p_name), ''), ' ') ELSE '' END AS said FROM part)
SELECT p_partkey, word, CASE WHEN word IN ({", ".join(f"'{w}'" for w in SPELLED)}) THEN contains(replace(said, ' ', ''), word) ELSE list_contains(string_split(said, ' '), word) END AS hit FROM x""")
def hit_rule(spark, d):
    """Whether a transcript has a word: as a token, or for words that are spelled out anywhere once spaces are gone."""
    p, k, low = table(spark, d, "part"), F.col("p_partkey") % 4, F.lower("p_name")
    said = F.when(k == 0, low).when(k == 1, F.concat(F.lit("x"), low)).when(k == 2, F.array_join(F.regexp_extract_all(low, F.lit("(?s)(.)"), F.lit(1)), " ")).otherwise("")
    x = p.select("p_partkey", F.element_at(F.split("p_name", " "), 1).alias("word"), said.alias("said"))
    return x.select("p_partkey", "word", T.hit(F.col("word"), F.col("said"), SPELLED).alias("hit"))


@query("""
SELECT s_suppkey, array_to_string(list_filter([s_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN '' ELSE n_name END, 'no. ' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN r_name END], lambda x: x IS NOT NULL AND x <> ''), '. ') AS line
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def entity_lines(spark, d):
    """Name, line and aliases of an entity as one text; what is null or empty is left out."""
    e = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    line = F.when(k % 3 == 1, "").when(k % 3 == 2, F.col("n_name"))
    return e.select("s_suppkey", T.entity_text(F.col("s_name"), line, F.array(F.concat(F.lit("no. "), k.cast("string")), F.when(k % 2 == 0, F.col("r_name")))).alias("line"))


#: Pieces of the one long stream, in hops; its policy.
PIECE, OVER, VOTES, WINDOW, BLOCKED = 512, 50.0, 3, 5, 10


@query(f"""
WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS hop, value AS prob FROM events),
c AS (SELECT hop FROM (SELECT hop, sum(CAST(prob > {OVER} AS INT)) OVER w AS n, count(*) OVER w AS m FROM s WINDOW w AS (ORDER BY hop ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)) WHERE m = {WINDOW} AND n >= {VOTES}),
f AS (SELECT min(hop) AS hop FROM c UNION ALL SELECT (SELECT min(c.hop) FROM c WHERE c.hop >= f.hop + {BLOCKED}) FROM f WHERE f.hop IS NOT NULL)
SELECT 0 AS stream_id, hop FROM f WHERE hop IS NOT NULL""")
def long_stream_fires(spark, d):
    """All events as one stream, numbered, voted and suppressed in pieces that go to many tasks."""
    s = ranks.placed(table(spark, d, "events").select("ts", "event_id", F.col("value").alias("prob")), ["ts", "event_id"], "hop")
    return long.detect(s.select(F.lit(0).alias("stream_id"), "hop", "prob"), OVER, VOTES, WINDOW, BLOCKED, piece=PIECE)


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, count(l_extendedprice) AS n FROM lineitem GROUP BY l_returnflag""")
def price_percentiles(spark, d):
    """Exact percentiles of a few large groups, selected by places: no group is held."""
    p = ranks.percentiles(table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price")), "price", ["l_returnflag"], [10, 50, 90])
    return p.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")], "n")
