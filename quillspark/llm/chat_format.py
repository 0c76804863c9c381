"""Chat formatting by prefix-target expansion.

Every assistant turn becomes its own example: all preceding turns are its context
and only that reply is trainable.  Turns after the last reply, and conversations
without a reply, become one example without a target, so that no turn is lost.

Template: ``<s>[INST]role[/INST]text</s>`` per turn.  In roles and texts every control
string (``CONTROL``) gets a backslash after its first character, and one
more if it had some, so the escape is undone exactly by taking one away.

Turns are ordered by turn, role and text (nulls first).  All of a conversation is one
row, as its last example is anyway; an expansion is as long as the sum of its
prefixes, which is the method's own output.

Defined cases: null text or role is empty; null conversation ids form one
conversation with id null; repeated turns are kept; an empty table gives no rows; only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings, as one pattern behind its first character.
CONTROL = r"/?s>|/?INST\]|/?SYS>>|<SYS>>|</SYS>>|\|[a-z_]+\|>"
_OPEN = rf"([<\[])(\\*)({CONTROL})"
_CLOSE = rf"([<\[])\\(\\*)({CONTROL})"
_TURN = r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _CLOSE, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<s>[INST]"), escape(role), F.lit("[/INST]"), escape(text), F.lit("</s>"))


def expand(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start and loss_end (code points; equal if nothing is trainable)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = conversations.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rows = rows.withColumn("parts", F.transform("turns", lambda t: F.struct((t["role"] == target_role).alias("target"), render(t["role"], t["text"]).alias("part"), F.length(escape(t["text"])).alias("n"))))
    last = F.size("parts")
    ends = F.filter(F.transform("parts", lambda p, i: F.when(p["target"] | (i == last - 1), i)), lambda i: i.isNotNull())
    rows = rows.select("conv_id", "parts", F.posexplode(ends).alias("example", "at"))
    rows = rows.withColumn("formatted", F.array_join(F.transform(F.slice("parts", 1, F.col("at") + 1), lambda p: p["part"]), ""))
    own = F.get("parts", F.col("at"))
    end = F.length("formatted") - F.when(own["target"], F.length(F.lit("</s>"))).otherwise(0)
    return rows.select("conv_id", "example", "formatted", (end - F.when(own["target"], own["n"]).otherwise(0)).alias("loss_start"), end.alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from an example."""
    roles, texts = F.regexp_extract_all(formatted, F.lit(_TURN), 1), F.regexp_extract_all(formatted, F.lit(_TURN), 2)
    return F.arrays_zip(F.transform(roles, unescape).alias("role"), F.transform(texts, unescape).alias("text"))


def report(conversations: DataFrame, **columns: str) -> DataFrame:
    """Per conversation, read back from its examples: turns, loss text and characters."""
    loss = F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    examples = expand(conversations, **columns).select("conv_id", "example", "formatted", unescape(loss).alias("loss"))
    whole = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda s: s["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns = whole.withColumn("turns", read_turns(F.col("longest")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


_SQL_CONTROL = CONTROL.replace("'", "''")
#: The digest of :func:`report` for DuckDB over conversations and the added one.
REPORT_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (
  SELECT *, length('<s>[INST][/INST]</s>') + length(regexp_replace(role, '([<\[])(\\*)({_SQL_CONTROL})', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)({_SQL_CONTROL})', '\1\\\2\3', 'g')) AS n FROM c),
r AS (
  SELECT *, sum(n) OVER w AS upto, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS of
  FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (WHERE role = 'assistant' OR k = of))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
