"""Operator 4: multi-party perspective rotation of dialogues.

For every participant of a conversation (every role but `system`) the dialogue
is rendered with that speaker as assistant and the others as named users; the
mask covers what the assistant says. Rows are segments: one for each turn and
perspective, with character offsets in the rendered dialogue, so a conversation
of any length is spread over tasks. Offsets are summed in chunks of turns and
offset by the chunks' sums. `render` puts the segments of a perspective together.

Nulls: a null role is the participant `unknown`, a null text is empty, a null
turn comes last, a null conversation is a conversation of its own. Turns with
equal numbers are ordered by role and text; repeated rows are turns of their
own. Empty tables give no rows. Extra columns are ignored.

No text or name can forge a marker: in texts, a `<` before a `|` gets a backslash
behind it, as does one that has backslashes there already; in names, the
characters % | < > and line breaks are written as % and two hexadecimal digits.
`plain_text` and `plain_name` undo it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import table

#: Turns of a chunk.
CHUNK = 1024
#: Chunk of null turns.
_LAST = 1 << 60


#: Characters of names that are written as numbers; % comes first.
CODED = {"%": "%25", "|": "%7C", "<": "%3C", ">": "%3E", "\n": "%0A", "\r": "%0D"}


def safe_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def plain_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def safe_name(name: Column) -> Column:
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(CODED[c])), CODED, name)


def plain_name(name: Column) -> Column:
    return reduce(lambda x, c: F.replace(x, F.lit(CODED[c]), F.lit(c)), reversed(CODED), name)


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, speaker, pos, turn, role_as, name, segment, seg_start, mask_start, mask_end)."""
    t = turns.select(
        F.col(conv).alias("c"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        safe_text(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    ).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(_LAST)))
    speakers = t.where("role <> 'system'").select(F.col("c").alias("sc"), F.col("role").alias("speaker")).distinct()
    p = t.join(speakers, F.col("c").eqNullSafe(F.col("sc"))).drop("sc")
    own = F.col("role") == F.col("speaker")
    role_as = F.when(F.col("role") == "system", "system").when(own, "assistant").otherwise("user")
    name = F.when(role_as == "user", F.col("role"))
    head = F.concat(F.lit("<|"), role_as, F.coalesce(F.concat(F.lit(":"), safe_name(name)), F.lit("")), F.lit("|>\n"))
    p = p.withColumns({"role_as": role_as, "name": name, "head": F.length(head), "segment": F.concat(head, F.col("text"), F.lit("<|end|>\n"))})
    inside = Window.partitionBy("c", "speaker", "chunk").orderBy(F.asc_nulls_last("turn"), "role", "text")
    n = F.length("segment")
    p = p.withColumns({"_pos": F.row_number().over(inside) - 1, "_at": F.sum(n).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - n})
    before = Window.partitionBy("c", "speaker").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = p.groupBy("c", "speaker", "chunk").agg(F.count("*").alias("m"), F.sum(n).alias("w"))
    base = base.select(F.col("c").alias("bc"), F.col("speaker").alias("bs"), F.col("chunk").alias("bk"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("bm"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("bw"))
    p = p.join(base, F.col("c").eqNullSafe(F.col("bc")) & (F.col("speaker") == F.col("bs")) & (F.col("chunk") == F.col("bk")))
    start = (F.col("_at") + F.col("bw")).cast("long")
    target = F.col("role_as") == "assistant"
    return p.select(
        F.col("c").alias(conv),
        "speaker",
        (F.col("_pos") + F.col("bm")).cast("long").alias("pos"),
        "turn",
        "role_as",
        "name",
        "segment",
        start.alias("seg_start"),
        F.when(target, start + F.col("head")).alias("mask_start"),
        F.when(target, start + n - 1).alias("mask_end"),
    )


def render(segments: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Rows (conv, speaker, text, masks): a whole dialogue a row, for conversations that fit one."""
    g = segments.groupBy(conv, "speaker").agg(F.sort_array(F.collect_list(F.struct("pos", "segment", "mask_start", "mask_end"))).alias("s"))
    masks = F.transform(F.filter("s", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return g.select(conv, "speaker", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"), masks.alias("masks"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


_SQL_NAME = reduce(lambda x, c: f"replace({x}, {repr(c) if c > ' ' else f'chr({ord(c)})'}, '{CODED[c]}')", CODED, "role")
SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id AS sc, role AS speaker FROM t WHERE role <> 'system'),
p AS (SELECT conv_id, turn, role, text, speaker, CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user' END AS role_as
      FROM t JOIN s ON conv_id IS NOT DISTINCT FROM sc),
g AS (SELECT *, CASE WHEN role_as = 'user' THEN role END AS name,
        '<|' || role_as || CASE WHEN role_as = 'user' THEN ':' || {_SQL_NAME} ELSE '' END || '|>' || chr(10) AS head FROM p),
x AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM g),
o AS (SELECT *, row_number() OVER w - 1 AS pos, coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
      FROM x WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, role, text))
SELECT conv_id, speaker, CAST(pos AS BIGINT) AS pos, turn, role_as, name, segment, CAST(st AS BIGINT) AS seg_start,
       CASE WHEN role_as = 'assistant' THEN CAST(st + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN role_as = 'assistant' THEN CAST(st + length(segment) - 1 AS BIGINT) END AS mask_end
FROM o
"""
