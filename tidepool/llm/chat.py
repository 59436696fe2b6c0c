"""Multi-party perspective rotation: every dialogue once per participant, who speaks as the assistant.

Other speakers are named users; ``system`` turns stay system turns and are nobody's perspective. Masks are the
stretches (code points, end exclusive) the model learns: the assistant's text and its end mark.

A dialogue is rendered in parts of ``PART`` turns by turn number, so one of any length never meets in one row.

Defined cases: NULL speaker is ``unknown``; NULL text is empty; NULL turns form part -1; turns of equal number go by
speaker, then text; repeated rows are repeated turns; NULL conv_id is a dialogue of its own; marks inside a text are
broken by a space; a dialogue with system turns only has no participant and no row; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.columns import running_sums

PART = 256
# Marks of the chat format.
START, END = "<|im_start|>", "<|im_end|>"


def perspectives(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", part: int = PART) -> DataFrame:
    """conv_id, speaker, part, n_turns, n_masked, rendered, masks (array of start, end)."""
    clean = F.replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(START), F.lit("<| im_start|>")), F.lit(END), F.lit("<| im_end|>"))
    said = turns.select(
        F.col(conv_id).alias("conv_id"), F.coalesce(F.floor(F.col(turn) / part), F.lit(-1)).cast("long").alias("part"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"), clean.alias("text")).alias("said"),
    )
    people = said.select(F.col("conv_id").alias("_conv"), F.col("said.speaker").alias("speaker")).filter("speaker <> 'system'").distinct()
    parts = said.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("said")).alias("said"))
    seen = parts.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
    role = lambda s: (
        F.when(s["speaker"] == "system", "system").when(s["speaker"] == F.col("speaker"), "assistant").otherwise(F.concat(F.lit("user name="), s["speaker"]))
    )
    head = lambda s: F.concat(F.lit(START), role(s), F.lit("\n"))
    seen = seen.withColumn("_heads", F.transform("said", head))
    seen = seen.withColumn("_long", F.zip_with("_heads", "said", lambda h, s: (F.length(h) + F.length(s["text"]) + len(END) + 1).cast("long")))
    seen = seen.withColumn("_at", running_sums(F.col("_long")))
    mine = F.filter(F.arrays_zip("_heads", "_at", "said"), lambda x: x["said"]["speaker"] == F.col("speaker"))
    start = lambda x: x["_at"] + F.length(x["_heads"])
    masks = F.transform(mine, lambda x: F.struct(start(x).alias("start"), (start(x) + F.length(x["said"]["text"]) + len(END)).alias("end")))
    body = F.zip_with("_heads", "said", lambda h, s: F.concat(h, s["text"], F.lit(END + "\n")))
    return seen.select(
        "conv_id", "speaker", "part", F.size("said").cast("long").alias("n_turns"), F.array_join(body, "").alias("rendered"), masks.alias("masks")
    ).withColumn("n_masked", F.size("masks").cast("long"))
