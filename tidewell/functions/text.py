"""Column functions on transcripts and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.signal import let

# Function and query-framing words that carry no entity information.
STOPWORDS = """
a an the and or but of to in on at for with from by as into up down out over
is are was were be been am do does did doesn't doesnt don't dont didn't didnt
can could would will shall should may might have has had
i me my you your we us he she it its they them their this that these those
there here what which who whom when where why how
tell show give about above please let know want like some any mean means
just so than then now not no yes though
""".split()
# Number words and the digits they stand for.
NUMBERS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
# Words that anchor no phonetic match and no proper name; words that may not carry a fuzzy match alone.
ANCHORLESS = """
mission moon lunar first probe india indian satellite launch vehicle polar
mars orbiter regional navigation constellation system series mapping human
spaceflight program programme astronaut workhorse rocket landing station
space centre center telemetry tracking command network imaging radar national
synthetic aperture sun solar venus lander rover
one two three four five mark
""".split()
CARRIERLESS = """
mission missions satellite satellites vehicle vehicles launch launches launcher
rocket rockets space system systems programme program orbiter lander
india indian
""".split()
# Spoken digits.
SPOKEN = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]


def words_in(x: Column, words) -> Column:
    return x.isin(*words) if words else F.lit(False)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9']+)"), F.lit(1))


def number_tokens(text: Column) -> Column:
    """Tokens with number words as digits."""
    table = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])
    return F.transform(tokens(text), lambda w: F.coalesce(F.try_element_at(table, w), w))


def content_of(tokens_: Column) -> Column:
    """The tokens without stop words."""
    return F.filter(tokens_, lambda w: ~words_in(w, STOPWORDS))


def numbers_of(tokens_: Column) -> Column:
    """The distinct numbers of one or two digits among the tokens."""
    return F.array_distinct(F.filter(tokens_, lambda w: (F.length(w) <= 2) & w.rlike("^[0-9]{1,2}$")))


def content_tokens(text: Column, digits: bool = True) -> Column:
    """Tokens without stop words; repeated tokens stay."""
    own = number_tokens(text) if digits else F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z']+)"), F.lit(1))
    return content_of(own)


def content_text(text: Column, digits: bool = True) -> Column:
    return F.array_join(content_tokens(text, digits), " ")


def mission_numbers(text: Column) -> Column:
    """Distinct numbers of one or two digits."""
    return numbers_of(number_tokens(text))


def numbers_agree(query: Column, entity: Column) -> Column:
    """A query's number vetoes entities known by other numbers only."""
    return (F.size(query) == 0) | (F.size(entity) == 0) | F.arrays_overlap(query, entity)


def collapse_acronyms(text: Column) -> Column:
    """Runs of single lower-case letters become one word."""
    return F.regexp_replace(text, r"(?<=\b[a-z])\s+(?=[a-z]\b)", "")


def _bare(text: Column, without: list) -> Column:
    own = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z']+)"), F.lit(1))
    own = F.transform(own, lambda w: F.regexp_replace(w, "'s?$", ""))
    return F.filter(own, lambda w: (F.length(w) >= 3) & ~words_in(w, without))


def carrier_tokens(text: Column, extra=()) -> Column:
    """Tokens that may carry a fuzzy match. extra: further words that may not."""
    return _bare(text, [*STOPWORDS, *CARRIERLESS, *extra])


def proper_tokens(text: Column, extra=()) -> Column:
    """Tokens that may be part of a proper name."""
    return _bare(text, [*STOPWORDS, *CARRIERLESS, *ANCHORLESS, *extra])


def phrase_in(tokens_: Column, phrase: Column) -> Column:
    """Whether a token array holds a phrase (token array) in sequence."""

    def held(p: Column) -> Column:
        t, w = p["t"], p["w"]
        last = F.size(t) - F.size(w)
        return F.when((F.size(w) > 0) & (last >= 0), F.exists(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda j: F.slice(t, j + 1, F.size(w)) == w)).otherwise(F.lit(False))

    return let(F.struct(tokens_.alias("t"), phrase.alias("w")), held)


def ngrams(tokens_: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return let(tokens_, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda j: F.array_join(F.slice(t, j + 1, F.lit(n)), " "))).otherwise(none))


def gram_hashes(tokens_: Column, n: int) -> Column:
    """128-bit hashes (pairs of 64 bits) of the n-token phrases; one that repeats is there each time."""

    def hashed(t: Column) -> Column:
        words = lambda j: [F.get(t, j + i) for i in range(n)]
        pair = lambda j: F.struct(F.xxhash64(*words(j)).alias("h"), F.xxhash64(F.lit(n), *words(j)).alias("g"))
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), pair))

    return let(tokens_, hashed)


def strip_unknown(text: Column) -> Column:
    """Without the recogniser's unknown marks; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[unk\]", " ")), F.lit(""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def speaker_key(name: Column) -> Column:
    """Session of a recording's name, else what stands before the first underscore, else empty."""
    own = F.lower(F.regexp_extract(name, r"(?i)^(?:positive|hardneg|ambient|talking)_[a-z0-9]+_([a-z0-9]+)_\d+$", 1))
    return F.when(own != "", own).when(F.instr(name, "_") > 0, F.substring_index(name, "_", 1)).otherwise("")


def hard_neg_word(name: Column) -> Column:
    own = F.regexp_extract(name, r"^[^_]+_(.+)_\d+$", 1)
    return F.when(own != "", own).otherwise("unknown")


def spelled(text: Column) -> Column:
    """Vocabulary of a name: runs of letters, and digits 0..12 as words."""
    own = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+|[0-9]+)"), F.lit(1))
    spoken = F.array(*map(F.lit, SPOKEN))
    return F.transform(own, lambda w: F.when(w.rlike("^[0-9]+$") & (F.length(w) < 3), F.coalesce(F.get(spoken, w.try_cast("int")), w)).otherwise(w))


def hit(word: Column, text: Column, spelled_words=()) -> Column:
    """Whether a transcript holds a word: as a token, or for the given words anywhere once spaces are gone."""
    loose = F.contains(F.replace(text, F.lit(" "), F.lit("")), word)
    whole = F.array_contains(F.split(text, " "), word)
    return F.when(words_in(word, spelled_words), loose).otherwise(whole) if spelled_words else whole


def assembled(segments: Column, tail: Column) -> Column:
    """Final transcript: segments and the tail joined by spaces, empty ones left out."""
    return F.concat_ws(" ", F.filter(segments, lambda s: s.isNotNull() & (s != "")), F.nullif(tail, F.lit("")))


def entity_text(name: Column, line: Column, aliases: Column) -> Column:
    return F.array_join(F.filter(F.concat(F.array(name, line), aliases), lambda s: s.isNotNull() & (s != "")), ". ")


def shown_date(text: Column) -> Column:
    """A text yyyy-mm-dd as a shown date; any other as it is, null as empty."""
    known = text.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])-[0-9]{2}$")
    day = F.regexp_replace(F.substring(text, 9, 2), "^0", "")
    month = F.element_at(F.array(*map(F.lit, "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())), F.when(known, F.substring(text, 6, 2).cast("int")).otherwise(1))
    return F.when(known, F.concat_ws(" ", day, month, F.substring(text, 1, 4))).otherwise(F.coalesce(text, F.lit("")))


def clock(at: Column) -> Column:
    """Hours, minutes, seconds and milliseconds of a time."""
    return F.date_format(at, "HH:mm:ss.SSS")


def without_annotations(text: Column) -> Column:
    """Without internal notes in parentheses."""
    return F.trim(F.regexp_replace(text, r"(?i)\s*\((todo|fixme|tbd|verify)\b[^)]*\)", ""))


_STATUS = r"^([^(]+?)\s*\((.+)\)\s*$"


def split_status(status: Column) -> tuple[Column, Column]:
    """Head, and what stands in parentheses at the end."""
    return F.when(status.rlike(_STATUS), F.regexp_extract(status, _STATUS, 1)).otherwise(status), F.regexp_extract(status, _STATUS, 2)


def status_tone(head: Column) -> Column:
    low = F.lower(head)
    return F.when(low.startswith("operational"), "good").when(low.startswith("in development") | F.contains(low, F.lit("lost")), "warn").otherwise("")


def size_tier(text: Column) -> Column:
    """Letter size for a text's length."""
    n = F.length(text)
    return F.when(n <= 32, 8.1).when(n <= 64, 7.0).when(n <= 110, 5.9).otherwise(5.0)


def merged(entity: Column, fields: list[str], **more: Column) -> Column:
    """An entity's record with further fields."""
    return F.struct(*[entity[f].alias(f) for f in fields], *[v.alias(k) for k, v in more.items()])


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Annotations that don't belong in shown text.
ANNOTATION = r"(?i)\b(todo|fixme|tbd|verify|placeholder)\b"


def annotated(text: Column) -> Column:
    return F.coalesce(text.rlike(ANNOTATION), F.lit(False))
