"""Queries on text, events of the protocol, entity resolution, vectors and signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import mfcc as M
from tidewell.functions import signal as S
from tidewell.functions import text as T
from tidewell.functions.similarity import metaphone_udf, ratio_udf, token_set_ratio_udf
from tidewell.operators import sessions
from tidewell.operators.match import Matcher
from tidewell.plans.detection import table
from tidewell.sources import files, generate, wav

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


_LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')"
_NUM = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.NUMBERS.items()) + " ELSE x END"


@query(f"""
SELECT doc_id, CAST(len(c) AS INT) AS n_content, array_to_string(list_slice(c, 1, 5), ' ') AS head, CAST(len(list_distinct(list_filter(t, lambda x: regexp_matches(x, '^[0-9]{{1,2}}$')))) AS INT) AS n_numbers
FROM (SELECT doc_id, t, list_filter(t, lambda x: NOT list_contains({_LIST(T.STOPWORDS)}, x)) AS c FROM (SELECT doc_id, list_transform({_TOK}, lambda x: {_NUM}) AS t FROM documents))""")
def content_tokens(spark, d):
    t = files.spread(table(spark, d, "documents")).select("doc_id", T.number_tokens(F.col("text")).alias("t"))
    c = t.select("doc_id", T.content_of(F.col("t")).alias("c"), T.numbers_of(F.col("t")).alias("m"))
    return c.select("doc_id", F.size("c").alias("n_content"), F.array_join(F.slice("c", 1, 5), " ").alias("head"), F.size("m").alias("n_numbers"))


_SPOKEN = "CASE " + " ".join(f"WHEN w IN ('{i}', '0{i}') THEN '{w}'" if i < 10 else f"WHEN w = '{i}' THEN '{w}'" for i, w in enumerate(T.SPOKEN)) + " ELSE w END"


@query(f"""
SELECT DISTINCT {_SPOKEN} AS word FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z]+|[0-9]+')) AS w FROM part
UNION ALL SELECT unnest(regexp_extract_all(lower(p_brand), '[a-z]+|[0-9]+')) FROM part UNION ALL SELECT unnest(regexp_extract_all(lower(p_type), '[a-z]+|[0-9]+')) FROM part)""")
def token_vocab(spark, d):
    p = table(spark, d, "part")
    parts = [p.select(F.explode(T.spelled(F.col(c))).alias("word")) for c in ("p_name", "p_brand", "p_type")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query(f"""
WITH w AS (SELECT 0 AS k, doc_id AS id, pos, w FROM (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {_TOK} AS t FROM documents))
  UNION ALL SELECT 1, item_id, pos, w FROM (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM (SELECT item_id, {_TOK} AS t FROM benchmark))),
g AS (SELECT k, id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS phrase FROM w WINDOW o AS (PARTITION BY k, id ORDER BY pos)),
u AS (SELECT DISTINCT * FROM g WHERE phrase IS NOT NULL)
SELECT a.id AS doc_id, b.id AS item_id, count(*) AS n FROM u a JOIN u b ON a.k = 0 AND b.k = 1 AND a.phrase = b.phrase GROUP BY ALL""")
def phrase_match(spark, d):
    """Four-word phrases of items in documents, by an equal join on the phrases' 128-bit hashes; the items' side is broadcast
    while Spark finds it small enough."""
    grams = lambda df, k: df.select(k, F.inline(T.gram_hashes(T.tokens(F.col("text")), 4)))
    hits = grams(files.spread(table(spark, d, "documents")), "doc_id").join(grams(table(spark, d, "benchmark"), "item_id").distinct(), ["h", "g"])
    return hits.distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT p_partkey, string_split(substr(p_name, 1, 1) || ' ' || substr(p_name, 2, 1) || ' ' || p_name || ' ' || lower(substr(p_type, 1, 1)) || ' x ' || p_type, ' ') AS w FROM part),
s AS (SELECT p_partkey, w, list_transform(w, lambda x: regexp_matches(x, '^[a-z]$')) AS one FROM t)
SELECT p_partkey, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = 1 OR (one[i] AND one[i - 1]) THEN w[i] ELSE ' ' || w[i] END), '') AS collapsed FROM s""")
def acronym_collapse(spark, d):
    """Single letters in a row become one word."""
    n, t = F.col("p_name"), F.col("p_type")
    text = F.concat_ws(" ", F.substring(n, 1, 1), F.substring(n, 2, 1), n, F.lower(F.substring(t, 1, 1)), F.lit("x"), t)
    return table(spark, d, "part").select("p_partkey", T.collapse_acronyms(text).alias("collapsed"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)\b(todo|fixme|tbd|verify|placeholder)\b') AS annotated FROM documents")
def annotation_lint(spark, d):
    return table(spark, d, "documents").select("doc_id", T.annotated(F.col("text")).alias("annotated"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, replace(replace(p_name || ' <' || p_brand || '>', '<', '&lt;'), '>', '&gt;') AS html FROM part")
def slugs(spark, d):
    name, brand = F.col("p_name"), F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", T.slug(F.concat_ws(" / ", name, brand)).alias("slug"), T.escape_html(F.concat(name, F.lit(" <"), brand, F.lit(">"))).alias("html"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, '{\"event\":\"' || event_type || '\",\"k\":' || CAST(json_extract(props, '$.k') AS INT) || '}' AS payload FROM events")
def json_events(spark, d):
    """Events decoded permissively and encoded again."""
    k = F.from_json("props", "k INT", {"mode": "PERMISSIVE"})["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("event"), k.alias("k"))).alias("payload"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
def changed_partials(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("prev", F.lag("event_type").over(w)).where(~F.col("event_type").eqNullSafe(F.col("prev"))).select("user_id", "event_id", "event_type")


@query("SELECT event_type, count(*) AS n, CASE WHEN event_type IN ('view', 'click') THEN 'forward' WHEN event_type = 'purchase' THEN 'pass' ELSE 'ignored' END AS route FROM events GROUP BY event_type")
def event_router(spark, d):
    e = F.col("event_type")
    route = F.when(e.isin("view", "click"), "forward").when(e == "purchase", "pass").otherwise("ignored")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("route", route)


@query("SELECT user_id, arg_max(event_type IN ('signup', 'purchase'), event_id) AS connected FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY user_id")
def connection_state(spark, d):
    """Last writer wins."""
    e = table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase", "error"))
    return e.groupBy("user_id").agg(F.max_by(F.col("event_type").isin("signup", "purchase"), "event_id").alias("connected"))


@query("SELECT user_id, event_id, coalesce(last_value(CASE event_type WHEN 'signup' THEN 'wake' WHEN 'purchase' THEN 'content' WHEN 'error' THEN 'idle' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'idle') AS state FROM events")
def ui_state(spark, d):
    e = F.col("event_type")
    now = F.when(e == "signup", "wake").when(e == "purchase", "content").when(e == "error", "idle")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.coalesce(F.last(now, ignorenulls=True).over(w), F.lit("idle")).alias("state"))


@query("""
WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS session FROM conversations)
SELECT conv_id, CAST(session AS BIGINT) AS session, min(turn) AS t1, min(turn) FILTER (role = 'assistant') AS t3, max(turn) AS t4, CAST(count(*) AS BIGINT) AS n, min(turn) FILTER (role = 'assistant') - min(turn) AS latency,
       string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant' AND text <> '') AS transcript FROM m WHERE session > 0 GROUP BY conv_id, session""")
def utterance_sessions(spark, d):
    """A user turn begins a session; the assistant's segments are its transcript."""
    s = sessions.by_marks(table(spark, d, "conversations"), F.col("role") == "user", "conv_id", ["turn"])
    own = F.col("role") == "assistant"
    parts = F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("turn", "text")))), lambda x: x["text"])
    g = s.groupBy("conv_id", "session").agg(F.min("turn").alias("t1"), F.min(F.when(own, F.col("turn"))).alias("t3"), F.max("turn").alias("t4"), F.count("*").alias("n"), parts.alias("p"))
    return g.select("conv_id", "session", "t1", "t3", "t4", "n", (F.col("t3") - F.col("t1")).alias("latency"), F.nullif(T.assembled(F.col("p"), F.lit("")), F.lit("")).alias("transcript"))


@query("""
WITH t AS (SELECT user_id, min(event_id) FILTER (event_type = 'signup') AS t1, min(event_id) FILTER (event_type = 'view') AS t2, min(event_id) FILTER (event_type = 'click' AND value > 450) AS t3, max(event_id) AS t4 FROM events GROUP BY user_id)
SELECT user_id, segment, ms FROM (SELECT user_id, unnest(['wake_to_audio', 'audio_to_text', 'text_to_final', 'total']) AS segment, unnest([t2 - t1, coalesce(t3, t4) - t2, t4 - coalesce(t3, t4), t4 - t1]) AS ms FROM t) WHERE ms IS NOT NULL""")
def latency_waterfall(spark, d):
    """Segments between stamps; a missing middle stamp gives its time to the segment before."""
    e, i = F.col("event_type"), F.col("event_id")
    t = table(spark, d, "events").groupBy("user_id").agg(F.min(F.when(e == "signup", i)).alias("t1"), F.min(F.when(e == "view", i)).alias("t2"), F.min(F.when((e == "click") & (F.col("value") > 450), i)).alias("t3"), F.max(i).alias("t4"))
    mid = F.coalesce("t3", "t4")
    seg = F.array(*[F.struct(F.lit(n).alias("segment"), x.alias("ms")) for n, x in (("wake_to_audio", F.col("t2") - F.col("t1")), ("audio_to_text", mid - F.col("t2")), ("text_to_final", F.col("t4") - mid), ("total", F.col("t4") - F.col("t1")))])
    return t.select("user_id", F.inline(seg)).where("ms IS NOT NULL")


@query("SELECT vec_id, label, other, round(sim, 5) AS sim FROM (SELECT a.vec_id, a.label, b.vec_id AS other, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) b ON a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, other) = 1")
def nearest_neighbor(spark, d):
    """The nearest of the labels' first vectors: the small side has one row a label."""
    e = table(spark, d, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    heads = e.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("vec_id").alias("other"), F.col("embedding").alias("o"))
    s = F.round(S.cosine(F.col("embedding"), F.col("o")), 9)
    pairs = e.crossJoin(heads).where("vec_id <> other").select("vec_id", "label", "other", s.alias("s"))
    best = pairs.groupBy("vec_id", "label").agg(F.max(F.struct("s", (-F.col("other")).alias("o"))).alias("b"))
    return best.select("vec_id", "label", (-F.col("b.o")).alias("other"), F.round("b.s", 5).alias("sim"))


@query("""
WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 10) AS v FROM embeddings), m AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS x FROM e)
SELECT vec_id, round(list_max(list_transform(x, lambda y: y / list_sum(x))), 7) AS top, CAST(list_position(x, list_max(x)) AS INT) AS at FROM m""")
def softmax_top(spark, d):
    p = S.softmax(F.transform("embedding", lambda x: x.cast("double") * 10))
    s = table(spark, d, "embeddings").select("vec_id", p.alias("p"))
    return s.select("vec_id", F.round(F.array_max("p"), 7).alias("top"), F.array_position("p", F.array_max("p")).cast("int").alias("at"))


@query("""
WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_transform(CAST(embedding AS DOUBLE[]), lambda x: greatest(least(round_even(x / 0.004 + 3, 0), 127), -128)) AS q FROM embeddings)
SELECT vec_id, CAST(list_sum(q) AS BIGINT) AS total, round(list_max(list_transform(list_zip(v, q), lambda x: abs(x[1] - (x[2] - 3) * 0.004))), 6) AS worst FROM q""")
def quantize_roundtrip(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    q = table(spark, d, "embeddings").select("vec_id", v.alias("v"), S.quantise(v, 0.004, 3).alias("q"))
    worst = F.array_max(F.zip_with("v", S.dequantise(F.col("q"), 0.004, 3), lambda a, b: F.abs(a - b)))
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.round(worst, 6).alias("worst"))


@query("SELECT part.p_partkey, round(2595 * log10(1 + p_retailprice / 700), 6) AS mel, round(700 * (pow(10.0, p_size / 2595) - 1), 6) AS hz, round(greatest(0, least(100, p_size / 100 * 420)), 6) AS meter, (p_size % 7 - 1) / 2 * 100 AS latency_ms FROM part")
def scales(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(S.hz_to_mel(F.col("p_retailprice")), 6).alias("mel"), F.round(S.mel_to_hz(size), 6).alias("hz"), F.round(S.meter(size / 100), 6).alias("meter"), S.added_latency_ms(size % 7).alias("latency_ms"))


def _tones(spark, d):
    """One second of a tone for each part size, as 16-bit samples."""
    sizes = table(spark, d, "part").select("p_size").distinct()
    x = F.transform(F.sequence(F.lit(0), F.lit(15999)), lambda i: F.rint(8000 * F.sin(2 * 3.141592653589793 * 20 * F.col("p_size") * i / 16000)).cast("short"))
    return sizes.select("p_size", x.alias("pcm"))


@query()
def mfcc_frames(spark, d):
    """49 x 10 cepstra of generated tones: shape, mean and first coefficients."""
    m = _tones(spark, d).select("p_size", M.mfcc("pcm").alias("m"))
    return m.select("p_size", F.size("m").alias("frames"), F.size(F.col("m")[0]).alias("coefs"), F.round(F.col("m")[10][0], 3).alias("c0"), F.round(F.col("m")[10][1], 3).alias("c1"))


@query("""
WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, list_sum(list_transform(v, lambda a: a * a)) / len(v) AS ms FROM x)
SELECT vec_id, round(sqrt(ms), 7) AS rms, round(20 * log10(sqrt(ms) + 1e-12), 6) AS dbfs, round(20 * log10(sqrt(ms + 1e-12)), 6) AS dbfs_inside, round(20 * log10(greatest(sqrt(ms), 1e-10)), 6) AS dbfs_least, round(20 * log10(list_max(list_transform(v, lambda a: abs(a))) + 1e-12), 6) AS peak FROM n""")
def levels(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    x = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    c = F.col("v")
    return x.select("vec_id", F.round(S.rms(c), 7).alias("rms"), F.round(S.dbfs(c), 6).alias("dbfs"), F.round(S.dbfs_inside(c), 6).alias("dbfs_inside"), F.round(S.dbfs_at_least(c), 6).alias("dbfs_least"), F.round(S.peak_dbfs(c), 6).alias("peak"))


@query("""
WITH x AS (SELECT vec_id, list_slice(CAST(embedding AS DOUBLE[]), 1, 20 + vec_id % 45) AS v FROM embeddings),
f AS (SELECT vec_id, CASE WHEN len(v) >= 40 THEN list_slice(v, (len(v) - 40) // 2 + 1, (len(v) - 40) // 2 + 40) ELSE list_concat(list_transform(range(0, (40 - len(v)) // 2), lambda i: 0.0), v, list_transform(range(0, 40 - len(v) - (40 - len(v)) // 2), lambda i: 0.0)) END AS c FROM x)
SELECT vec_id, CAST(len(c) AS INT) AS n, CAST(list_sum(list_transform(c, lambda a: greatest(least(round_even(a * 32768, 0), 32767), -32768))) AS BIGINT) AS pcm_sum, CAST((len(c) - 16) // 8 + 1 AS INT) AS n_frames FROM f""")
def clip_fit(spark, d):
    v = F.slice(F.transform("embedding", lambda x: x.cast("double")), F.lit(1), (20 + F.col("vec_id") % 45).cast("int"))
    c = table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", S.fit_to_clip(F.col("v"), 40).alias("c"))
    return c.select("vec_id", F.size("c").alias("n"), F.aggregate(S.to_pcm16(F.col("c")), F.lit(0).cast("long"), lambda a, x: a + x).alias("pcm_sum"), F.size(S.windows(F.col("c"), 16, 8)).alias("n_frames"))


@query("""
WITH x AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS v, CAST(b.embedding AS DOUBLE[]) AS g FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
r AS (SELECT vec_id, v, g, sqrt(list_sum(list_transform(v, lambda a: a * a)) / len(v)) / pow(10.0, 5 / 20) / sqrt(list_sum(list_transform(g, lambda a: a * a)) / len(g)) AS k FROM x)
SELECT vec_id, round(list_sum(list_transform(list_zip(v, g), lambda p: (p[1] + k * p[2]) * (p[1] + k * p[2]))), 6) AS power, round(list_sum(list_transform(list_zip(v, g), lambda p: greatest(least((p[1] + k * p[2]) * pow(10.0, 6 / 20), 0.2), -0.2))), 6) AS clipped FROM r""")
def snr_mix(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("g")), "vec_id")
    m = pairs.select("vec_id", S.mix(F.col("v"), F.col("g"), F.lit(5.0)).alias("m"))
    return m.select("vec_id", F.round(S.total(F.transform("m", lambda x: x * x)), 6).alias("power"), F.round(S.total(S.clip(S.gain(F.col("m"), F.lit(6.0)), 0.2)), 6).alias("clipped"))


@query("SELECT c_custkey, greatest(coalesce(cli, meta, 0.75), 0) AS theta, CASE WHEN cli IS NOT NULL THEN 'cli' WHEN meta IS NOT NULL THEN 'file' ELSE 'default' END AS origin FROM (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey / 100 END AS cli, CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal / 10000 END AS meta FROM customer)")
def parameter_precedence(spark, d):
    """Command line, then file, then default, with where each value came from."""
    k = F.col("c_nationkey")
    cli, meta = F.when(k % 3 == 0, k / 100), F.when(k % 2 == 0, F.col("c_acctbal") / 10000)
    origin = F.when(cli.isNotNull(), "cli").when(meta.isNotNull(), "file").otherwise("default")
    return table(spark, d, "customer").select("c_custkey", F.greatest(F.coalesce(cli, meta, F.lit(0.75)), F.lit(0)).alias("theta"), origin.alias("origin"))


@query("SELECT vec_id, CAST(i AS INT) AS chunk, CAST(len(c) AS INT) AS n_samples, CAST(20 - len(c) AS INT) AS n_padded, round(list_sum(c), 5) AS total FROM (SELECT vec_id, i, list_slice(CAST(embedding AS DOUBLE[]), 20 * i + 1, 20 * i + 20) AS c FROM (SELECT vec_id, embedding, unnest(range(0, 4)) AS i FROM embeddings))")
def chunk_replay(spark, d):
    """Signals as chunks of 20 samples, the last one zero-padded."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    c = wav.chunks(table(spark, d, "embeddings").select("vec_id", v.alias("samples")), "vec_id", 20)
    return c.select("vec_id", "chunk", "n_samples", (20 - F.col("n_samples")).alias("n_padded"), F.round(S.total(F.col("samples")), 5).alias("total"))


@query("SELECT vec_id, sha256(array_to_string(list_transform(CAST(embedding AS DOUBLE[]), lambda x: printf('%.8e', x)), ',')) AS digest FROM embeddings")
def matrix_dump(spark, d):
    """Values as text of fixed format, and its digest."""
    text = F.array_join(S.printed(F.col("embedding"), "%.8e"), ",")
    return table(spark, d, "embeddings").select("vec_id", F.sha2(text, 256).alias("digest"))


@query("SELECT DISTINCT p_size, CAST(32044 AS INT) AS bytes, true AS same FROM part")
def wav_roundtrip(spark, d):
    """Tones as WAV bytes and back: sample counts and whether all samples agree."""
    t = _tones(spark, d).withColumn("wav", wav.encode_wav("pcm"))
    return t.select("p_size", F.octet_length("wav").alias("bytes"), (wav.decode_wav("wav") == S.pcm16_to_float(F.col("pcm"))).alias("same"))


@query()
def augmented(spark, d):
    """The augmentation chain on generated tones, keyed by hash: shift, speed, mix, gain, clip; and the low shelf."""
    t = _tones(spark, d).select("p_size", S.pcm16_to_float(F.col("pcm")).alias("x"))
    offset = (F.pmod(F.xxhash64("p_size", F.lit(3)), F.lit(3201)) - 1600).cast("int")
    y = S.time_shift(F.col("x"), offset, 1600)
    t = t.withColumn("y", y).withColumn("z", S.fit_to_clip(M.speed(1.1).asNondeterministic()("y")))
    noise = F.transform(F.sequence(F.lit(0), F.lit(15999)), lambda i: F.pmod(F.xxhash64(i, F.col("p_size")), F.lit(2001)) / 1000.0 - 1)
    t = t.withColumn("m", S.clip(S.gain(S.mix(F.col("z"), noise, F.lit(10.0), 0.1), F.lit(-3.0)))).withColumn("s", M.low_shelf(6.0).asNondeterministic()("m"))
    return t.select("p_size", F.size("m").alias("n"), F.round(S.rms(F.col("m")), 5).alias("rms"), F.round(S.rms(F.col("s")), 5).alias("rms_shelf"))


def _kb(spark, d):
    """A stand-in knowledge base: part names, with brands as aliases and types as descriptors."""
    p = table(spark, d, "part")
    kb = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"), F.slice(F.array_sort(F.collect_set("p_brand")), 1, 2).alias("aliases"), F.array_sort(F.collect_set(F.concat_ws(" ", F.lower("p_type"), F.element_at(F.split("p_name", " "), -1)))).alias("descriptors"))
    return kb.select(F.col("name").alias("id"), "name", "aliases", "descriptors", F.lit(None).cast("date").alias("launch_date"), F.col("ord").cast("int"))


def _asks(spark, d):
    """Transcripts about parts: whole, garbled, descriptive, with unknown marks."""
    p = table(spark, d, "part")
    n, k = F.col("p_name"), F.col("p_partkey") % 5
    garbled = F.regexp_replace(n, "[aeiou]([^aeiou ])", "e$1")
    text = F.when(k == 0, F.concat(F.lit("tell me about the "), n)).when(k == 1, F.concat(F.lit("where is "), garbled)).when(k == 2, F.concat(F.lit("the "), F.lower("p_type"), F.lit(" "), F.element_at(F.split(n, " "), -1))).when(k == 3, F.lit("[unk] what about it")).otherwise(F.concat(garbled, F.lit(" "), F.col("p_size")))
    return p.select(F.col("p_partkey").alias("query_id"), text.alias("text"))


@query()
def layered_match(spark, d):
    return Matcher(_kb(spark, d)).match(_asks(spark, d)).select("query_id", "text", "id", F.round("confidence", 6).alias("confidence"), "layer")


def _sql_lcs(a: str, b: str) -> str:
    """Longest common subsequence of two short strings, with the table's rows as bits."""
    mask = f"coalesce(list_sum(list_transform(range(0, length({a})), lambda i: CASE WHEN substr({a}, CAST(i AS INT) + 1, 1) = c THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE 0 END)), 0)"
    step = f"((r + (r & CAST({mask} AS HUGEINT))) | (r - (r & CAST({mask} AS HUGEINT)))) & ((CAST(1 AS HUGEINT) << CAST(length({a}) AS INT)) - 1)"
    return f"(length({a}) - bit_count(list_reduce(string_split({b}, ''), lambda r, c: {step}, (CAST(1 AS HUGEINT) << CAST(length({a}) AS INT)) - 1)))"


def _sql_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * {_sql_lcs(a, b)} / (length({a}) + length({b})) END)"


_SPLIT = "list_distinct(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


@query(f"""
WITH p AS (SELECT DISTINCT p_name, p_type, lower(p_type) AS lt, p_name || ' ' || p_brand AS wide FROM part),
t AS (SELECT p_name, p_type, p_name AS a, lt AS b, wide, {_SPLIT.format(x='wide')} AS x, {_SPLIT.format(x="lt || ' ' || p_name")} AS y FROM p),
u AS (SELECT *, array_to_string(list_sort(list_filter(x, lambda w: list_contains(y, w))), ' ') AS cm, array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS l, array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS r FROM t),
v AS (SELECT *, CASE WHEN cm = '' THEN l WHEN l = '' THEN cm ELSE cm || ' ' || l END AS one, CASE WHEN cm = '' THEN r WHEN r = '' THEN cm ELSE cm || ' ' || r END AS other FROM u)
SELECT p_name, p_type, wide, round({_sql_ratio('a', 'b')}, 4) AS ratio,
  round(CASE WHEN cm <> '' AND (l = '' OR r = '') THEN 100.0 WHEN cm = '' THEN {_sql_ratio('one', 'other')} ELSE greatest({_sql_ratio('one', 'other')}, {_sql_ratio('cm', 'one')}, {_sql_ratio('cm', 'other')}) END, 4) AS token_set FROM v""")
def fuzzy_match(spark, d):
    """Similarities of names and types."""
    p = table(spark, d, "part").select("p_name", "p_type", F.concat_ws(" ", "p_name", "p_brand").alias("wide")).distinct()
    low = F.lower("p_type")
    return p.select("p_name", "p_type", "wide", F.round(ratio_udf("p_name", low), 4).alias("ratio"), F.round(token_set_ratio_udf("wide", F.concat_ws(" ", low, "p_name")), 4).alias("token_set"))


@query()
def sound_codes(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct().select("word", metaphone_udf("word").alias("code"))


@query()
def match_ablation(spark, d):
    """Two configurations on the same queries: how many changed, missed, matched by layer."""
    kb, asks = _kb(spark, d), _asks(spark, d)
    a = Matcher(kb).match(asks).select("query_id", F.col("id").alias("a"), "layer")
    b = Matcher(kb, use_descriptors=False, generic_guard=False, digit_aware=False).match(asks).select("query_id", F.col("id").alias("b"))
    return a.join(b, "query_id").groupBy("layer").agg(F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed"), F.count_if(F.col("b").isNull()).alias("n_missed"))


@query("""
WITH i AS (SELECT unnest(range(0, 16000)) AS i), x AS (
  SELECT 'silence' AS kind, 0.0 AS v FROM i UNION ALL SELECT 'tone', round_even(8000 * sin(2 * pi() / 16000 * 440 * i), 0) FROM i
  UNION ALL SELECT 'chirp', round_even(8000 * sin(2 * pi() / 16000 * (100 * i + 3900.0 / 32000 * i * i)), 0) FROM i
  UNION ALL SELECT 'square', CASE WHEN (i * 500 // 16000) % 2 = 0 THEN 6000.0 ELSE -6000.0 END FROM i UNION ALL SELECT 'impulse', CASE WHEN i = 8000 THEN 30000.0 ELSE 0.0 END FROM i)
SELECT kind, count(*) AS n, round(sqrt(avg(v * v)), 3) AS rms, max(abs(v)) AS peak FROM x GROUP BY kind""")
def test_signals(spark, d):
    s = generate.signals(spark).where(F.col("kind").isin("silence", "tone", "chirp", "square", "impulse"))
    x = F.col("samples")
    return s.select("kind", F.size(x).cast("long").alias("n"), F.round(S.rms(x), 3).alias("rms"), S.peak(x).alias("peak"))


#: Conditions of the realism check: gains, shifts by a quarter of a second either way, noise, a set level, and all at once.
REALISM = [("clean", 0.0), *(("gain", g) for g in (-30.0, -20.0, -12.0, 0.0, 6.0, 12.0)), ("shift", -4000.0), ("shift", 4000.0), *(("snr", v) for v in (10.0, 5.0, 0.0)), ("level", -11.0), ("combined", -9.0)]


@query(f"""
WITH i AS (SELECT unnest(range(0, 16000)) AS i), x AS (
  SELECT 'tone' AS kind, i, round_even(8000 * sin(2 * pi() / 16000 * 440 * i), 0) / 32768 AS v FROM i
  UNION ALL SELECT 'chirp', i, round_even(8000 * sin(2 * pi() / 16000 * (100 * i + 3900.0 / 32000 * i * i)), 0) / 32768 FROM i
  UNION ALL SELECT 'square', i, CASE WHEN (i * 500 // 16000) % 2 = 0 THEN 6000.0 ELSE -6000.0 END / 32768 FROM i),
b AS (SELECT i, ((CAST(i AS BIGINT) * 48271 + 11) % 65521 * 40692 % 2147483647 * 30323 % 2147483647) // 32768 % 2000 / 1000.0 - 1 AS b FROM i),
rb AS (SELECT sqrt(avg(b * b)) AS rb FROM b),
c AS (SELECT * FROM (VALUES {", ".join(f"('{c}', CAST({v} AS DOUBLE))" for c, v in REALISM)}) AS t(condition, value)),
s AS (SELECT kind, condition, value, x.i, CASE WHEN condition = 'shift' THEN x.i - CAST(value AS INT) WHEN condition = 'combined' THEN x.i - 1000 ELSE x.i END AS pos, v FROM x, c),
k AS (SELECT kind, condition, value, pos, CASE WHEN pos >= 0 AND pos < 16000 THEN v ELSE 0 END AS v FROM s),
r AS (SELECT kind, condition, value, sqrt(sum(v * v) / 16000) AS r FROM k GROUP BY ALL),
y AS (SELECT k.kind, k.condition, k.value, CASE k.condition WHEN 'gain' THEN greatest(least(v * pow(10.0, k.value / 20), 1.0), -1.0) WHEN 'snr' THEN v + r / pow(10.0, k.value / 20) / rb * coalesce(b, 0)
        WHEN 'level' THEN greatest(least(v * pow(10.0, k.value / 20) / r, 1.0), -1.0) WHEN 'combined' THEN greatest(least((v + r / pow(10.0, 5.0 / 20) / rb * coalesce(b, 0)) * pow(10.0, k.value / 20), 1.0), -1.0) ELSE v END AS y
      FROM (SELECT * FROM k WHERE pos >= 0 AND pos < 16000 UNION ALL SELECT kind, condition, value, unnest(range(15000, 16000)), 0 FROM r WHERE condition = 'combined') k JOIN r ON r.kind = k.kind AND r.condition = k.condition AND r.value = k.value LEFT JOIN b ON b.i = pos, rb)
SELECT kind, condition, value, CAST(16000 AS INT) AS n, round(20 * log10(sqrt(sum(y * y) / 16000) + 1e-12), 3) AS dbfs, round(max(abs(y)), 4) AS peak FROM y GROUP BY kind, condition, value""")
def realism_conditions(spark, d):
    """Test signals under gains, shifts, noise levels, a set level and all at once, crossed with a small table of conditions."""
    conditions = spark.createDataFrame(REALISM, "condition string, value double")
    clips = generate.signals(spark).where(F.col("kind").isin("tone", "chirp", "square")).select("kind", F.transform("samples", lambda v: v / 32768).alias("x"))
    rows = clips.crossJoin(F.broadcast(conditions)).withColumn("noise", generate.steady_noise())
    x, v, c = F.col("x"), F.col("value"), F.col("condition")
    shift = F.when(c == "shift", v.cast("int")).when(c == "combined", 1000)
    rows = rows.withColumn("x", F.when(shift.isNotNull(), S.time_shift(x, F.coalesce(shift, F.lit(0)), 4000)).otherwise(x))
    noisy = F.when(c == "combined", S.clip(S.gain(S.mix(x, F.col("noise"), F.lit(5.0)), v)))
    y = F.when(c == "gain", S.clip(S.gain(x, v))).when(c == "snr", S.mix(x, F.col("noise"), v)).when(c == "level", S.to_level(x, v)).otherwise(F.coalesce(noisy, x))
    out = rows.select("kind", "condition", "value", y.alias("y"))
    return out.select("kind", "condition", "value", F.size("y").alias("n"), F.round(S.dbfs(F.col("y")), 3).alias("dbfs"), F.round(S.peak(F.col("y")), 4).alias("peak"))


@query()
def bass_tilt(spark, d):
    """Test signals with the bass raised by 10 dB, and at the level of a close microphone."""
    clips = generate.signals(spark).select("kind", F.transform("samples", lambda v: v / 32768).alias("x"))
    t = clips.select("kind", "x", M.low_shelf(10.0)("x").alias("y"))
    return t.select("kind", F.round(S.dbfs(F.col("x")), 3).alias("dbfs"), F.round(S.dbfs(F.col("y")), 3).alias("tilted"), F.round(S.dbfs(S.to_level(F.col("y"), F.lit(-11.0))), 3).alias("live"))


@query("""
WITH k AS (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
c AS (SELECT a.vec_id AS query_id, 'label' || k.label AS id, CAST(k.label AS INT) AS ord, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])) AS c FROM embeddings a, k)
SELECT query_id, id, round(c, 6) AS confidence FROM c WHERE c >= 0.4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, ord) = 1""")
def semantic_match(spark, d):
    """Nearest entity by cosine above a threshold: labels' first vectors stand for entities, all vectors for queries."""
    e = table(spark, d, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    kb = e.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.concat(F.lit("label"), F.col("label")).alias("id"), F.concat(F.lit("label"), F.col("label")).alias("name"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("descriptors"), F.lit(None).cast("date").alias("launch_date"), F.col("label").cast("int").alias("ord"), F.col("embedding").alias("vec"))
    m = Matcher(kb, vectors=e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")))
    asks = m.prepared(e.select(F.col("vec_id").alias("query_id"), F.lit("some spoken query").alias("text")))
    return m.by_vector(asks).select("query_id", "id", F.round("confidence", 6).alias("confidence"))
