"""Layered entity resolution: descriptor, fuzzy, vector and phonetic layers with guards.

Queries are many, the knowledge base is mostly small: its rows are broadcast up
to SMALL_KB entities. Like words and names are found by keys that are equal on
both sides (see `alike`); no query is compared with every name. Distinct
transcripts are matched once.

kb: id, name, aliases array<string>, descriptors array<string>, launch_date date (nullable), ord int.
queries: query_id, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions.signal import cosine
from tidewell.functions.similarity import metaphone_udf, ratio_udf
from tidewell.operators.alike import alike, scored, sets_near

#: Thresholds and confidences of the layers.
FUZZY, VECTOR, PROPER, CARRIER, PHONETIC, DESCRIPTOR = 65.0, 0.40, 75.0, 70.0, 60.0, 0.6
#: Entities up to which the knowledge base is broadcast.
SMALL_KB = 50_000


def small(df: DataFrame, is_small: bool) -> DataFrame:
    return F.broadcast(df) if is_small else df


class Matcher:
    """The layers over one knowledge base. extra: further generic words, such as the organisation's own name. A layer whose means
    are missing (vectors, sound codes) is left out; the others work on."""

    def __init__(self, kb: DataFrame, extra=(), use_descriptors: bool = True, generic_guard: bool = True, digit_aware: bool = True, vectors: DataFrame | None = None, use_phonetic: bool = True):
        self.kb, self.extra, self.use_descriptors, self.generic_guard, self.digit_aware, self.vectors, self.use_phonetic = kb, list(extra), use_descriptors, generic_guard, digit_aware, vectors, use_phonetic
        self.is_small = kb.count() <= SMALL_KB
        names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
        self.base = kb.withColumn("names", names).withColumn("nums", T.mission_numbers(F.array_join("names", " ")) if digit_aware else F.array().cast("array<string>"))

    def _numbers(self, text: Column) -> Column:
        return T.mission_numbers(text) if self.digit_aware else F.array().cast("array<string>")

    def prepared(self, queries: DataFrame) -> DataFrame:
        """Cleaned queries with content: variants, numbers, tokens."""
        q = queries.select("query_id", T.strip_unknown(F.col("text")).alias("t")).where("t IS NOT NULL")
        q = q.withColumn("flat", T.collapse_acronyms(F.col("t"))).withColumn("qnums", self._numbers(F.col("flat")))
        return q.where(T.content_text(F.col("flat"), self.digit_aware) != "")

    def named(self, q: DataFrame) -> DataFrame:
        """query_id of queries that name an entity."""
        own = q.select("query_id", F.explode(F.array_distinct(T.proper_tokens(F.col("flat"), self.extra))).alias("a"))
        kb = self.base.select(F.explode("names").alias("n")).select(F.explode(T.proper_tokens(F.col("n"), self.extra)).alias("b")).distinct()
        words = own.select("a").distinct()
        exact = words.join(small(kb, self.is_small), F.col("a") == F.col("b"), "left_semi")
        close = alike(words, kb, PROPER, 5, 5).select("a")
        return own.join(exact.union(close).distinct(), "a").select("query_id").distinct()

    def by_descriptor(self, q: DataFrame) -> DataFrame:
        """(query_id, id, ord, confidence): the longest phrase held; the latest launch, else no date, else knowledge-base order."""
        phrases = self.base.select("id", "ord", "launch_date", "nums", F.posexplode(F.coalesce("descriptors", F.array().cast("array<string>"))).alias("dpos", "d"))
        phrases = phrases.withColumn("p", T.tokens(F.col("d"))).withColumn("n", F.size("p")).where("n >= 2").withColumn("phrase", F.array_join("p", " "))
        first = phrases.groupBy("phrase").agg(F.min(F.struct("ord", "dpos")).alias("seen"))
        phrases = phrases.join(first, "phrase")
        lengths = [r[0] for r in phrases.select("n").distinct().orderBy("n").collect()]  # phrase lengths in words: a handful
        toks = q.select("query_id", "qnums", T.tokens(F.col("flat")).alias("toks"))
        grams = F.flatten(F.array(*[T.ngrams(F.col("toks"), n) for n in lengths])) if lengths else F.array().cast("array<string>")
        hits = toks.select("query_id", "qnums", F.explode(F.array_distinct(grams)).alias("phrase")).join(small(phrases.select("phrase", "n", "id", "ord", "launch_date", "nums", "seen"), self.is_small), "phrase")
        longest = Window.partitionBy("query_id").orderBy(F.desc("n"), "seen")
        hits = hits.withColumn("_k", F.dense_rank().over(longest)).where("_k = 1").where(T.numbers_agree(F.col("qnums"), F.col("nums")))
        best = Window.partitionBy("query_id").orderBy(F.col("launch_date").desc_nulls_last(), "ord")
        return hits.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("query_id", "id", "ord", F.lit(DESCRIPTOR).alias("confidence"))

    def _carried(self, texts: DataFrame, names: DataFrame) -> DataFrame:
        """The pairs (a, b) of texts a and names b with a discriminative pair of tokens."""
        own = texts.select(F.col("a").alias("p"), F.explode(F.array_distinct(T.carrier_tokens(F.col("a"), self.extra))).alias("a"))
        theirs = names.select(F.col("b").alias("q"), F.explode(F.array_distinct(T.carrier_tokens(F.col("b"), self.extra))).alias("b"))
        close = alike(own, theirs, CARRIER, 4)
        return own.join(close, "a").join(theirs, "b").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()

    def by_fuzzy(self, q: DataFrame) -> DataFrame:
        """(query_id, variant, id, ord, confidence): the best token-set ratio over every name, guarded."""
        kb = self.base.select("id", "ord", "nums", F.posexplode("names").alias("pos", "s"))
        kb = kb.withColumn("cand", F.array_join(T.number_tokens(F.col("s")), " ") if self.digit_aware else F.col("s")).select("id", "ord", "nums", "pos", "cand")
        v = q.select("query_id", "qnums", F.posexplode(F.array_distinct(F.array("t", "flat"))).alias("variant", "v")).select("query_id", "qnums", "variant", T.content_text(F.col("v"), self.digit_aware).alias("q")).where("q <> ''")
        texts, names = v.select(F.col("q").alias("a")).distinct(), kb.select(F.col("cand").alias("b")).distinct()
        found = scored(self._carried(texts, names), FUZZY) if self.generic_guard else sets_near(texts, names, FUZZY)
        hits = v.join(found.toDF("q", "cand", "s"), "q").join(small(kb, self.is_small), "cand").where(T.numbers_agree(F.col("qnums"), F.col("nums")))
        w = Window.partitionBy("query_id", "variant").orderBy(F.desc("s"), "ord", "pos")
        return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("query_id", "variant", "id", "ord", (F.col("s") / 100).alias("confidence"))

    def by_vector(self, q: DataFrame) -> DataFrame:
        """(query_id, variant, id, ord, confidence): the nearest entity by cosine. vectors: query_id, vec; the knowledge base has `vec`."""
        kb = self.base.select("id", "ord", "nums", F.col("vec").alias("kv"))
        pairs = q.join(self.vectors, "query_id").crossJoin(small(kb, self.is_small)).withColumn("c", F.when(T.numbers_agree(F.col("qnums"), F.col("nums")), cosine(F.col("vec"), F.col("kv"))).otherwise(-1.0))
        best = pairs.groupBy("query_id").agg(F.max(F.struct("c", (-F.col("ord")).alias("o"), "id")).alias("b"))
        return best.where(F.col("b.c") >= VECTOR).select("query_id", F.lit(0).alias("variant"), F.col("b.id").alias("id"), (-F.col("b.o")).alias("ord"), F.col("b.c").alias("confidence"))

    def by_phonetic(self, q: DataFrame) -> DataFrame:
        """(query_id, id, ord, confidence): most words that sound and look alike."""
        kb = self.base.select("id", "ord", "nums", F.explode("names").alias("n")).select("id", "ord", "nums", F.explode(F.regexp_extract_all(F.lower("n"), F.lit("([a-z]+)"), F.lit(1))).alias("b"))
        kb = kb.where((F.length("b") >= 4) & ~T.words_in(F.col("b"), [*T.ANCHORLESS, *self.extra, "series"])).withColumn("code", metaphone_udf("b"))
        own = q.select("query_id", "qnums", F.posexplode(F.regexp_extract_all(F.lower(T.content_text(F.col("flat"), False)), F.lit("([a-z]+)"), F.lit(1))).alias("at", "a")).where(F.length("a") >= 4)
        codes = own.select("a").distinct().withColumn("code", metaphone_udf("a"))
        alike = codes.join(small(kb, self.is_small), "code").withColumn("r", ratio_udf("a", "b")).where(F.col("r") >= PHONETIC)
        hits = own.join(alike, "a").where(T.numbers_agree(F.col("qnums"), F.col("nums")))
        n = hits.groupBy("query_id", "id", "ord").agg(F.count("*").alias("n"), F.min(F.struct("at", "ord")).alias("first"))
        w = Window.partitionBy("query_id").orderBy(F.desc("n"), "first")
        confidence = F.least(F.lit(0.5) + 0.15 * (F.col("n") - 1), F.lit(0.8))
        return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("query_id", "id", "ord", confidence.alias("confidence"))

    def match(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, confidence, layer), one row for each query; nulls where nothing matches."""
        distinct = queries.select(F.coalesce("text", F.lit("")).alias("query_id"), "text").dropDuplicates(["query_id"])
        q = self.prepared(distinct)
        out = None
        rest = q
        if self.use_descriptors:
            free = q.join(self.named(q), "query_id", "left_anti")
            found = self.by_descriptor(free)
            out = found.select("query_id", "id", "confidence", F.lit("descriptor").alias("layer"))
            rest = q.join(found, "query_id", "left_anti")
        fuzzy = self.by_fuzzy(rest).select("query_id", "id", "confidence", F.lit("fuzzy").alias("layer"), (F.col("variant") * 2).alias("o"))
        if self.vectors is not None:
            fuzzy = fuzzy.union(self.by_vector(rest).select("query_id", "id", "confidence", F.lit("semantic"), (F.col("variant") * 2 + 1)))
        w = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "o")
        chosen = fuzzy.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("query_id", "id", "confidence", "layer")
        found = chosen if out is None else out.union(chosen)
        if self.use_phonetic:
            found = found.union(self.by_phonetic(rest.join(chosen, "query_id", "left_anti")).select("query_id", "id", "confidence", F.lit("phonetic").alias("layer")))
        keyed = queries.withColumn("_t", F.coalesce("text", F.lit("")))
        return keyed.join(found.withColumnRenamed("query_id", "_t"), "_t", "left").drop("_t")
