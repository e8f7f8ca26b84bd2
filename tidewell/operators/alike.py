"""Pairs of like words of two tables by equal keys, in place of comparing each with each.

Two words link at an indel ratio of at least r, or if one holds the other. What
may reach the ratio is found by filters that lose nothing:

- A ratio of r needs a common subsequence of r (n + m) / 200 characters, and so
  as many common elements (a character with the number of its occurrence). A
  word of n characters needs t(n) = ceil(n r / (200 - r)) of them with any word.
  In one order of all elements, two sets with t common ones share at least two
  among the first n - t + 2 of each; pairs of these are the keys. Words of one or
  two characters have their single elements as keys besides.
- A word that holds another holds its first characters: runs of so many
  characters are keys on one side, first runs on the other.

Candidates are then compared. The order has second occurrences and rare letters
first, so keys are selective; it steers the cost only.

Nulls are like nothing. Empty words are like nothing. Repeated words count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.signal import let
from tidewell.functions.similarity import ratio_udf, token_set_ratio_udf

#: Characters from frequent to rare, as in prose; any others count as rarer.
ORDER = "etaoinshrdlcumwfgypbvkjxqz "


def keys(word: Column, least: int) -> Column:
    """Keys of a word: two words whose ratio is at least `least` have one in common."""
    chars = F.regexp_extract_all(word, F.lit("(?s)(.)"), F.lit(1))

    def element(cs: Column) -> Column:
        times = lambda c, i: F.size(F.filter(F.slice(cs, F.lit(1), i + 1), lambda x: x == c))
        return F.transform(cs, lambda c, i: F.struct((-times(c, i)).alias("often"), F.when(F.contains(F.lit(ORDER), c), -F.position(c, F.lit(ORDER))).otherwise(-100).alias("rare"), c.alias("c")))

    def pairs(cs: Column) -> Column:
        n = F.size(cs)
        need = F.floor((n * least + 199 - least) / (200 - least)).cast("int")
        first = F.slice(F.array_sort(element(cs)), F.lit(1), n - need + 2)
        text = F.transform(first, lambda x: F.concat(x["c"], x["often"].cast("string")))
        both = let(text, lambda es: F.flatten(F.transform(es, lambda x, i: F.transform(F.slice(es, i + 2, F.size(es)), lambda y: F.concat(x, F.lit("|"), y)))))
        return F.when(n <= 2, F.concat(both, text)).otherwise(both)

    return F.array_distinct(let(chars, pairs))


def runs(word: Column, size: int) -> Column:
    """All runs of `size` characters of a word."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (size - 1), F.lit(1))), lambda i: F.substr(word, i, F.lit(size))))


def near(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """Distinct (a, b) of words a and b that may reach a ratio; left (a), right (b)."""
    x = left.where("a <> ''").select("a", F.explode(keys(F.col("a"), least)).alias("key"))
    y = right.where("b <> ''").select("b", F.explode(keys(F.col("b"), least)).alias("key"))
    n, m = F.length("a"), F.length("b")
    return x.join(y, "key").where((200 - least) * F.least(n, m) >= least * F.greatest(n, m)).select("a", "b").distinct()


def holding(left: DataFrame, right: DataFrame, size: int) -> DataFrame:
    """Distinct (a, b) of words of at least `size` characters of which one holds the other."""
    x, y = left.where(F.length("a") >= size), right.where(F.length("b") >= size)
    a_in_b = x.withColumn("key", F.substring("a", 1, size)).join(y.select("b", F.explode(runs(F.col("b"), size)).alias("key")), "key").where(F.contains("b", "a"))
    b_in_a = x.select("a", F.explode(runs(F.col("a"), size)).alias("key")).join(y.withColumn("key", F.substring("b", 1, size)), "key").where(F.contains("a", "b"))
    return a_in_b.select("a", "b").union(b_in_a.select("a", "b")).distinct()


def alike(left: DataFrame, right: DataFrame, least: float, size: int, shortest: int = 0) -> DataFrame:
    """Distinct (a, b) of words with a ratio of at least `least` (of words of at least `shortest` characters), or of which one
    holds the other and both have at least `size`."""
    left, right = left.select("a").distinct(), right.select("b").distinct()
    long = [df.where(F.length(c) >= shortest) for df, c in ((left, "a"), (right, "b"))]
    close = near(*long, int(least)).where(ratio_udf("a", "b") >= least)
    return close.union(holding(left, right, size)).distinct()


def sets_near(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, s) of texts with a token-set ratio s of at least `least`. Texts without a common token have the ratio of their
    sorted tokens, so they are found by keys of those; the others by the token."""
    flat = lambda c: F.array_join(F.array_sort(F.array_distinct(_tokens(c))), " ")
    left, right = left.select("a").distinct(), right.select("b").distinct()
    shared = left.select("a", F.explode(F.array_distinct(_tokens("a"))).alias("w")).join(right.select("b", F.explode(F.array_distinct(_tokens("b"))).alias("w")), "w").select("a", "b")
    x, y = left.select(F.col("a").alias("p"), flat("a").alias("a")), right.select(F.col("b").alias("q"), flat("b").alias("b"))
    other = near(x, y, int(least)).join(x, "a").join(y, "b").select("p", "q")
    return scored(shared.union(other).distinct(), least)


def scored(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, s) of the pairs whose token-set ratio s is at least `least`."""
    return pairs.withColumn("s", token_set_ratio_udf("a", "b")).where(F.col("s") >= least)


def _tokens(c: str) -> Column:
    return F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
