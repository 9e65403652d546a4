"""Multi-party chat: each participant's view of a dialogue, with that speaker as assistant and the others as named users.

A view is one row for all but dialogues of more than SEGMENT turn numbers; those are rendered in segments of so many,
so that no row grows without bound; segments of a view follow each other by number, and each later one begins with the
dialogue's first system turn again.  Every speaker but `system` is a participant.  System turns stay system turns in
every view.  The mask of a view is 1 for its speaker's messages, which are trained on, and 0 for all others.

Null conversation: the row is in no dialogue and is dropped.  Null turn: the segment -1, rendered by itself.  Null
speaker: the name `unknown`.  Null text: empty.  Rows of one turn follow each other by speaker, then text; exact
repeats of a row are one.  Other columns are ignored.  All steps are built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import read

#: Turn numbers in a row at most.
SEGMENT = 4096
SYSTEM = "system"


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Per conversation, participant and segment: `messages` (turn, role, name, content, train), `rendered`, `mask`, `train_chars`."""
    clean = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"),
        F.coalesce(F.floor(F.col(turn) / segment), F.lit(-1)).cast("long").alias("segment"),
        F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("said"),
    )
    segments = clean.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_set("said")).alias("said"))
    participants = clean.select("conv_id", F.col("said.speaker").alias("perspective")).where(F.col("perspective") != SYSTEM).distinct()
    first = clean.where((F.col("said.speaker") == SYSTEM) & (F.col("segment") >= 0)).groupBy("conv_id").agg(F.min(F.struct("segment", "said")).alias("system"))
    segments = segments.join(first, "conv_id", "left")
    again = (F.col("segment") > 0) & (F.col("system.segment") < F.col("segment"))
    segments = segments.withColumn("said", F.when(again, F.concat(F.array("system.said"), "said")).otherwise(F.col("said"))).drop("system")
    views = segments.join(participants, "conv_id")

    def message(m):
        own = m["speaker"] == F.col("perspective")
        role = F.when(own, "assistant").when(m["speaker"] == SYSTEM, SYSTEM).otherwise("user")
        return F.struct(m["turn"].alias("turn"), role.alias("role"), F.when(role == "user", m["speaker"]).alias("name"), m["text"].alias("content"), own.cast("int").alias("train"))

    def line(m):
        name = F.coalesce(F.concat(F.lit(" name="), m["name"]), F.lit(""))
        return F.concat(F.lit("<|"), m["role"], name, F.lit("|>\n"), m["content"], F.lit("<|end|>\n"))

    views = views.withColumn("messages", F.transform("said", message)).drop("said")
    return views.select(
        "conv_id",
        "perspective",
        "segment",
        "messages",
        F.concat_ws("", F.transform("messages", line)).alias("rendered"),
        F.concat_ws("", F.transform("messages", lambda m: m["train"].cast("string"))).alias("mask"),
        F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.when(m["train"] == 1, F.length(m["content"]).cast("long")).otherwise(F.lit(0).cast("long"))).alias("train_chars"),
    )


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = perspectives(read(spark, sf_dir, "conversations"))
    return views.select("conv_id", "perspective", "segment", F.size("messages").cast("long").alias("n_messages"), "rendered", "mask", "train_chars")


ORACLE_SQL = f"""
WITH u AS (SELECT DISTINCT conv_id, CAST(coalesce(floor(turn / {SEGMENT}), -1) AS BIGINT) AS segment, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
y AS (SELECT * FROM u WHERE speaker = '{SYSTEM}' AND segment >= 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) = 1),
t AS (SELECT * FROM u UNION ALL SELECT y.conv_id, g.segment, y.turn, y.speaker, y.text FROM y JOIN (SELECT DISTINCT conv_id, segment FROM u WHERE segment > 0) g
  ON g.conv_id = y.conv_id AND g.segment > y.segment),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
m AS (SELECT t.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS role FROM t JOIN p USING (conv_id))
SELECT conv_id, perspective, segment, count(*) AS n_messages,
  string_agg('<|' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn, speaker, text) AS rendered,
  string_agg(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY turn, speaker, text) AS mask,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS train_chars
FROM m GROUP BY conv_id, perspective, segment
"""
