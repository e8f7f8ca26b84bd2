"""Operator 1: line-first quality rules, in DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing
lines are removed, and a document that loses too much text is rejected, as is
one that fails the base rules (too few words, or too many repeated words).

- Punctuation: more than a tenth of its characters are symbols or shouts, or it
  has UNPUNCTUATED words or more and no mark between or behind them.
- Navigation: a menu in one line, a path of names (a > b > c), or LIST_LEAST
  lines in a row of few words that no mark ends.
- Boilerplate: a short line with one of the phrases, in four languages.

Nulls: a null text has no words, fails the base rules and has null cleaned
text. Empty texts likewise. Very long texts are taken whole. Repeated rows are
judged row by row. Extra columns pass through untouched in `clean`.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE_CLASS, let, table

#: Phrases of boilerplate lines, in any case.
BOILERPLATE = [
    "licensed under", "all rights reserved", "cookie policy", "cookie settings", "cookie notice", "cookies policy", "privacy policy", "terms of use", "terms of service", "accept cookies", "accept all cookies",
    "subscribe to our", "sign up for", "click here", "javascript disabled", "javascript required", "javascript is disabled", "javascript is required", "powered by", "copyright (c)", "copyright 19", "copyright 20", "©",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "newsletter abonnieren", "hier klicken",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "aviso legal", "aceptar cookies", "aceptar las cookies", "haga clic aquí",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "accepter les cookies", "cliquez ici",
]
#: A boilerplate phrase fails a line of at most this many words; longer lines are prose that mentions it.
BOILERPLATE_WORDS = 40
#: Characters of the symbol count, those that the punctuation rule adds, and from how many it counts.
SYMBOLS = "#*$%&|<>"
SHOUTS = "!?"
SYMBOLS_LEAST = 3
#: Separators of menus, and how many a menu has at least.
MENU = "|»›·"
MENU_LEAST = 3
#: A path of names: at least two such marks between words.
PATH = r"[^ ] (>|/|»|›|→) [^ ].* (>|/|»|›|→) [^ ]"
PATH_WORDS = 12
#: Lines of a list of links: so many in a row, each of few words and without a mark at its end.
LIST_LEAST, LIST_WORDS = 5, 4
ENDED = r"[.!?:;,…\"”»)。！？]$"
#: Words of a line that has no mark at all.
UNPUNCTUATED = 30
MARK = r"[.!?:;,…。、，！？]"
#: Least words of a document; most percent of repeated words; most percent of text that removed lines may hold.
MIN_WORDS, MAX_REPEAT_PCT, MAX_LOST_PCT = 50, 50, 40


def words_of(text: Column) -> Column:
    """Words: runs of characters other than 0x20 and 0x09-0x0D."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def _count_of(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    The number of distinct hashes of the windows shows whether any occurs twice
    (equal windows have equal hashes); only then are the windows sorted.
    """

    def windows(w: Column, key) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: key(i, F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def any_twice(w: Column) -> Column:
        return let(windows(w, lambda i, *x: F.xxhash64(*x)), lambda h: F.size(F.array_distinct(h)) < F.size(h))

    def starts(s: Column) -> Column:
        same = lambda x, i, d: F.coalesce(F.get(s, i + d)["k"] == x["k"], F.lit(False))
        hit = F.transform(s, lambda x, i: F.when(same(x, i, -1) | same(x, i, 1), x["p"]))
        return F.sort_array(F.filter(hit, lambda p: p.isNotNull()))

    def covered(w: Column) -> Column:
        return F.aggregate(
            let(F.sort_array(windows(w, lambda i, *x: F.struct(F.concat_ws(" ", *x).alias("k"), i.alias("p")))), starts),
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + F.least(F.lit(3), p + 3 - a["end"])).cast("long").alias("n")),
            lambda a: a["n"],
        )

    zero = F.lit(0).cast("long")
    return F.when(F.size(words) < 3, zero).when(any_twice(words), covered(words)).otherwise(zero)


def line_fails(line: Column, flat: Column) -> Column:
    """Whether a line alone fails the punctuation, navigation or boilerplate rule; a line without words passes. flat: with runs of white space as one space, trimmed."""
    solid = F.length(F.replace(flat, F.lit(" "), F.lit("")))
    n_words = F.length(flat) - solid + 1
    symbols = _count_of(line, SYMBOLS.replace("|", "") + SHOUTS)
    punctuation = ((symbols >= SYMBOLS_LEAST) & (10 * symbols > solid)) | ((n_words >= UNPUNCTUATED) & ~flat.rlike(MARK))
    seps = _count_of(line, MENU)
    navigation = (seps >= MENU_LEAST) & (8 * seps >= n_words) | (n_words <= PATH_WORDS) & flat.rlike(PATH)
    boilerplate = (n_words <= BOILERPLATE_WORDS) & let(F.lower(line), lambda x: reduce(or_, [F.contains(x, F.lit(p)) for p in BOILERPLATE]))
    return (flat != "") & (punctuation | navigation | boilerplate)


def listed(flats: Column) -> Column:
    """Of an array of lines, whether each is in a run of LIST_LEAST short lines that no mark ends."""

    def short(x: Column) -> Column:
        return (x != "") & (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) < LIST_WORDS) & ~x.rlike(ENDED)

    def near(hits: Column, i: Column, steps, how) -> Column:
        return reduce(how, [F.coalesce(F.get(hits, i + d), F.lit(False)) for d in steps])

    def runs(s: Column) -> Column:
        begins = F.transform(s, lambda x, i: x & near(s, i, range(1, LIST_LEAST), and_))
        return let(begins, lambda b: F.transform(b, lambda x, i: x | near(b, i, range(-LIST_LEAST + 1, 0), or_)))

    return let(F.transform(flats, short), runs)


def signals(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the base counts `_w` and `n_symbols`, and `_l`: removed and total characters of the lines, cleaned text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n")
    pairs = F.transform(lines, lambda x: F.struct(x.alias("line"), F.trim(F.regexp_replace(x, SPACE_CLASS + "+", " ")).alias("flat")))

    def flags(ps: Column, inside: Column) -> Column:
        """inside: whether each line is in a list of links."""

        def flag(p: Column, i: Column) -> Column:
            bad = line_fails(p["line"], p["flat"])
            return F.struct(p["line"].alias("line"), (bad | F.coalesce(F.get(inside, i), F.lit(False))).alias("bad"), p["flat"].alias("flat"))

        return F.transform(ps, flag)

    flagged = let(pairs, lambda ps: let(listed(F.transform(ps, lambda p: p["flat"])), lambda x: flags(ps, x)))

    def of_lines(fl: Column) -> Column:
        with_word = F.transform(F.filter(fl, lambda x: x["flat"] != ""), lambda x: x["line"])
        total = F.aggregate(fl, F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"]))
        lost = F.aggregate(fl, F.lit(0).cast("long"), lambda a, x: a + F.when(x["bad"], F.length(x["line"])).otherwise(0))
        kept = F.array_join(F.transform(F.filter(fl, lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
        return F.struct(
            let(with_word, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_dup_lines"),
            total.alias("total_chars"),
            lost.alias("lost_chars"),
            F.size(F.filter(fl, lambda x: x["bad"])).cast("long").alias("n_bad_lines"),
            kept.alias("clean_text"),
        )

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    return df.select("*", let(words_of(t), of_words).alias("_w"), _count_of(t, SYMBOLS).cast("long").alias("n_symbols"), let(flagged, of_lines).alias("_l"))


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, lost_pct, base_failed, kept, clean_text."""
    s = signals(df, text)
    w, ln = F.col("_w"), F.col("_l")
    base_failed = (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > MAX_REPEAT_PCT * w["n_words"])
    lost = 100 * ln["lost_chars"] > MAX_LOST_PCT * ln["total_chars"]
    return s.select(
        *df.columns,
        w["n_words"].alias("n_words"),
        w["word_chars"].alias("word_chars"),
        F.col("n_symbols"),
        ln["n_dup_lines"].alias("n_dup_lines"),
        w["n_repeat_words"].alias("n_repeat_words"),
        ln["n_bad_lines"].alias("n_bad_lines"),
        ln["lost_chars"].alias("lost_chars"),
        base_failed.alias("base_failed"),
        (~base_failed & ~lost).alias("kept"),
        F.when(F.col(text).isNotNull(), ln["clean_text"]).alias("clean_text"),
    )


def clean(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The kept rows, all their columns, with failing lines taken out of the text."""
    cols = df.columns
    got = judge(df.select(F.struct("*").alias("r"), F.col(text).alias("t")), "t").where("kept")
    return got.select(*[(F.col("clean_text") if c == text else F.col("r")[c]).alias(c) for c in cols])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).drop("text", "clean_text")


_SQL_PHRASE = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM d),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS i FROM d),
lf AS (
  SELECT doc_id, line, i, length(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS solid,
         trim(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS flat,
         len(list_filter(regexp_split_to_array(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS nw,
         length(line) - length(translate(line, '#*$%&<>!?', '')) AS sy,
         length(line) - length(translate(line, '{MENU}', '')) AS sep
  FROM ln),
ls AS (SELECT *, solid > 0 AND nw <= {LIST_WORDS} AND NOT regexp_matches(flat, '{ENDED}') AS short FROM lf),
lg AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, short ORDER BY i) AS grp FROM ls),
lr AS (SELECT *, short AND count(*) OVER (PARTITION BY doc_id, short, grp) >= {LIST_LEAST} AS listed FROM lg),
lj AS (SELECT *, listed OR (solid > 0 AND ((sy >= {SYMBOLS_LEAST} AND 10 * sy > solid) OR (nw >= {UNPUNCTUATED} AND NOT regexp_matches(flat, '{MARK}'))
         OR (sep >= {MENU_LEAST} AND 8 * sep >= nw) OR (nw <= {PATH_WORDS} AND regexp_matches(flat, '{PATH}'))
         OR (nw <= {BOILERPLATE_WORDS} AND ({_SQL_PHRASE})))) AS bad FROM lr),
la AS (SELECT doc_id, count(*) FILTER (solid > 0) - count(DISTINCT line) FILTER (solid > 0) AS n_dup_lines,
         sum(length(line)) AS total, coalesce(sum(length(line)) FILTER (bad), 0) AS lost, count(*) FILTER (bad) AS n_bad FROM lj GROUP BY doc_id),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n_rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY doc_id),
a AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_bad, 0) AS BIGINT) AS n_bad_lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars, coalesce(total, 0) AS total
  FROM w LEFT JOIN la USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, lost_chars,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words) AND NOT (100 * lost_chars > {MAX_LOST_PCT} * total) AS kept
FROM a
"""
