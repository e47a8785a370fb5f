"""Multi-party perspective rotation of conversations.

For every participant the whole dialogue is rendered with that speaker as the
assistant and the others as users by name; system messages stay what they are.
The mask holds the places of the assistant's words, in code points of the
rendered text, which a trainer takes the loss over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ASSISTANT, SYSTEM, END = "<|assistant|>\n", "<|system|>\n", "<|end|>\n"


def rotate(turns: DataFrame, system: str = "system", conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation and participant: conv_id, participant, n_messages, text, mask_from, mask_to.

    Participants are the different speakers but ``system``; a null speaker is
    nobody's perspective and is rendered as the user ``unknown``.  Messages
    follow by turn, then speaker, then text, nulls first; a null text is empty;
    a null conversation is one like others; repeated messages are repeated.  A
    message is ``<|role|>`` or ``<|user name=...|>``, a line feed, the text,
    ``<|end|>`` and a line feed.  A conversation without participants gives no
    row, as does an empty table.  mask_from and mask_to: for each message of
    the assistant where its text begins and ends, in code points.

    A dialogue is whole, however many turns it has, so its rendering is one row
    and must fit a task.  All else is streamed: where messages begin comes from
    running sums over the sorted conversation, which spill, and a message's
    place differs between participants only by the heads of their own messages
    before it, which are counted.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(speaker).cast("string").alias("speaker"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    user = F.concat(F.lit("<|user name="), F.coalesce("speaker", F.lit("unknown")), F.lit("|>\n"))
    head = F.when(F.col("speaker") == system, F.lit(SYSTEM)).otherwise(user)
    order = [F.col(c).asc_nulls_first() for c in ("turn", "speaker", "text")]
    upto = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("head", head).withColumn("n", F.count(F.lit(1)).over(upto("conv_id")))
    size = F.char_length("head") + F.char_length("text") + len(END)
    rows = rows.withColumn("start", F.sum(size).over(upto("conv_id")) - size).withColumn("k", F.count(F.lit(1)).over(upto("conv_id", "speaker")))
    rows = cut(rows.select("conv_id", "speaker", "n", "k", "start", "head", "text"), "chat-turns")

    begin = F.col("start") + F.col("k") * len(ASSISTANT) - (F.col("k") - 1) * F.char_length("head")
    own = rows.where(F.col("speaker").isNotNull() & (F.col("speaker") != system)).groupBy("conv_id", F.col("speaker").alias("participant"))
    own = own.agg(F.sort_array(F.collect_list(F.struct(begin.alias("at"), (begin + F.char_length("text")).alias("to")))).alias("_mask"))
    whole = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.sort_array(F.collect_list(F.struct("n", "speaker", "head", "text"))).alias("_m"))
    both = own.join(whole, F.col("conv_id").eqNullSafe(F.col("_conv")))
    line = lambda x: F.concat(F.when(x["speaker"].eqNullSafe(F.col("participant")), F.lit(ASSISTANT)).otherwise(x["head"]), x["text"], F.lit(END))
    return both.select("conv_id", "participant", F.size("_m").cast("bigint").alias("n_messages"), F.array_join(F.transform("_m", line), "").alias("text"), F.col("_mask.at").alias("mask_from"), F.col("_mask.to").alias("mask_to"))
