"""Preference formatting: the shared turns of two conversations become the prompt, once.

For a chosen and a rejected conversation the longest common prefix of turns (equal role and equal
text) is rendered as the prompt; what follows in each is rendered as its completion, with the
character spans a loss should see: the assistants' texts with their end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
SPEAKER = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns of the two arrays are equal."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), 1, n), lambda z: z["x"].eqNullSafe(z["y"]))
    at = F.array_position(same, False)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(n)


def render_turn(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def loss_spans(turns: Column, speaker: str = SPEAKER) -> Column:
    """[start, end) characters of the rendered turns that the speaker wrote, as ``start-end``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        head = acc["at"] + F.length(turn["role"]) + len(OPEN) + len(MIDDLE)
        end = head + F.length(turn["text"]) + len(CLOSE)
        span = F.concat_ws("-", head.cast("string"), (end - 1).cast("string"))
        own = F.when(turn["role"] == speaker, F.array(span)).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def preference_format(pairs: DataFrame, speaker: str = SPEAKER) -> DataFrame:
    """Adds ``n_common, prompt, chosen_text, rejected_text, chosen_spans, rejected_spans`` to pairs.

    ``pairs`` has ``chosen`` and ``rejected``, arrays of struct(role, text); they are replaced.
    Nothing is shuffled: a pair is formatted where it lies.

    * a null array counts as no turns, a null role or text as an empty one;
    * equal conversations: all is prompt and both completions are empty; nothing shared: an empty
      prompt. No pairs: no rows. Other columns pass through, unless they bear an output's name:
      then the output takes their place.
    """
    clean = {
        side: F.transform(
            F.coalesce(F.col(side), F.array().cast(TURNS)),
            lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")),
        )
        for side in ("chosen", "rejected")
    }
    out = pairs.withColumns(clean).withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    rest = {s: F.slice(F.col(s), F.col("n_common") + 1, F.greatest(F.size(s) - F.col("n_common"), F.lit(0))) for s in ("chosen", "rejected")}
    return out.withColumns(
        {
            "prompt": render(F.slice(F.col("chosen"), F.lit(1), F.col("n_common"))),
            "chosen_text": render(rest["chosen"]),
            "rejected_text": render(rest["rejected"]),
            "chosen_spans": loss_spans(rest["chosen"], speaker),
            "rejected_spans": loss_spans(rest["rejected"], speaker),
        }
    ).drop("chosen", "rejected")


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns by (turn, role, text), nulls last in turn.

    Turns without a conv_id belong to nothing: each is a conversation of its own, so however many
    there are, none is large. Equal turns stay. A conversation is one row, however long. Dealt by
    conv_id, so a popular first turn or text puts nothing in one task. No turns: no rows; other
    columns are ignored.
    """
    row = F.struct(
        F.col("turn").isNull().alias("late"), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return (
        conversations.groupBy("conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("_alone")).agg(F.array_sort(F.collect_list(row)).alias("turns"))
        .withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
        .drop("_alone")
    )


def last_reply_pairs(turns: DataFrame, speaker: str = SPEAKER) -> DataFrame:
    """One pair for each conversation: chosen as it is, rejected with its last reply replaced.

    The replacement is the same conversation's previous reply (an answer out of its context), or
    an empty reply if there is none. Without any reply both sides are equal.
    """
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == speaker, i)), lambda i: i.isNotNull())
    last, previous = F.try_element_at("places", F.lit(-1)), F.try_element_at("places", F.lit(-2))
    stand_in = F.coalesce(F.get("turns", previous)["text"], F.lit(""))
    rejected = F.transform(
        "turns", lambda t, i: F.when(i == last, F.struct(t["role"].alias("role"), stand_in.alias("text"))).otherwise(t)
    )
    return turns.withColumn("places", places).select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    pairs = last_reply_pairs(conversation_turns(table(spark, sf_dir, "conversations")))
    return preference_format(pairs).withColumn("n_common", F.col("n_common").cast("long"))


ORACLE = """
WITH t AS (
  SELECT c, conv_id, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS LAST, role, text) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    CASE WHEN conv_id IS NULL THEN 'n' || row_number() OVER () ELSE 'c' || conv_id END AS c FROM conversations) AS c),
reply AS (SELECT c, i, text, row_number() OVER (PARTITION BY c ORDER BY i DESC) AS back FROM t WHERE role = 'assistant'),
marked AS (
  SELECT t.*, a.i AS at, CASE WHEN t.i = a.i THEN coalesce(b.text, '') ELSE t.text END AS other
  FROM t LEFT JOIN (SELECT * FROM reply WHERE back = 1) a USING (c) LEFT JOIN (SELECT * FROM reply WHERE back = 2) b USING (c)),
parted AS (
  SELECT *, coalesce(min(CASE WHEN text <> other THEN i END) OVER (PARTITION BY c) - 1, count(*) OVER (PARTITION BY c)) AS n_common FROM marked),
drawn AS (
  SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS a, '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) AS b
  FROM parted),
placed AS (
  SELECT *, sum(CASE WHEN i > n_common THEN length(a) ELSE 0 END) OVER (PARTITION BY c ORDER BY i) AS a_end,
    sum(CASE WHEN i > n_common THEN length(b) ELSE 0 END) OVER (PARTITION BY c ORDER BY i) AS b_end
  FROM drawn)
SELECT conv_id, n_common,
  coalesce(string_agg(CASE WHEN i <= n_common THEN a END, '' ORDER BY i), '') AS prompt,
  coalesce(string_agg(CASE WHEN i > n_common THEN a END, '' ORDER BY i), '') AS chosen_text,
  coalesce(string_agg(CASE WHEN i > n_common THEN b END, '' ORDER BY i), '') AS rejected_text,
  coalesce(string_agg(CASE WHEN i > n_common AND role = 'assistant' THEN (a_end - length(text) - 8)::BIGINT || '-' || (a_end - 1)::BIGINT END, ',' ORDER BY i), '') AS chosen_spans,
  coalesce(string_agg(CASE WHEN i > n_common AND role = 'assistant' THEN (b_end - length(other) - 8)::BIGINT || '-' || (b_end - 1)::BIGINT END, ',' ORDER BY i), '') AS rejected_spans
FROM placed GROUP BY c, conv_id, n_common
"""
