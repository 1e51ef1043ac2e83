"""Chat formatting from the view of every participant.

Each speaker of a conversation gets a rendering in which that speaker is the assistant and all others are named
users; system turns stay system turns. A mask lists the half-open ranges of code points that are learned: what
the assistant says and its end mark. A conversation is rendered in blocks of consecutive turns (BLOCK turn
numbers each), and a block that holds more rows than that, because turn numbers repeat or are null, in pieces of BLOCK rows. So no
conversation, however long, needs one row. The pieces in the order of (block, piece) are the dialogue; ``placed`` gives each
the place where it starts there, by which its ranges move.

What is said can't forge a turn: in names and texts a backslash parts the "<|" of a mark, and white space
in a name becomes a space.

Defined cases: a null role speaks as "unknown"; a null text is empty; a null turn stands before all others in block
-1; turns that repeat are kept, in the order of role and text; null conversation ids are one conversation; a
conversation of system turns alone has no participant and no rendering; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
START, END, SYSTEM = "<|im_start|>", "<|im_end|>", "system"


def escaped(text: Column) -> Column:
    """Text in which no mark begins."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _part(turn: Column, view: Column) -> Column:
    """One turn as seen by ``view``: its text and whether it is learned."""
    own = turn["speaker"] == view
    head = F.when(own, F.lit("assistant")).when(turn["speaker"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), turn["speaker"]))
    lead = F.concat(F.lit(START), head, F.lit("\n"))
    return F.struct(F.concat(lead, turn["text"], F.lit(END + "\n")).alias("text"), own.alias("own"), F.length(lead).alias("lead"))


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """conv, perspective, block, piece, n_turns, rendered and mask (array of start, end) of every speaker and piece."""
    speaker = F.regexp_replace(escaped(F.coalesce(F.col(role), F.lit("unknown"))), r"[\x09-\x0D]", " ")
    base = turns.select(
        F.col(conv).alias("_conv"), F.coalesce(F.floor(F.col(turn) / block), F.lit(-1)).cast("long").alias("block"),
        F.struct(F.col(turn).alias("turn"), speaker.alias("speaker"), escaped(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("t"),
    )
    # Numbering streams through a sorted block; turns that share a number are all that makes one longer than BLOCK rows.
    number = F.row_number().over(Window.partitionBy("_conv", "block").orderBy("t"))
    pieces = base.withColumn("piece", F.floor((number - 1) / block).cast("long"))
    blocks = pieces.groupBy("_conv", "block", "piece").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    speakers = base.select("_conv", F.col("t.speaker").alias("perspective")).distinct().filter(F.col("perspective") != SYSTEM).withColumnRenamed("_conv", "_of")
    both = blocks.join(speakers, F.col("_conv").eqNullSafe(F.col("_of")))
    parts = both.select("_conv", "perspective", "block", "piece", F.transform("turns", lambda t: _part(t, F.col("perspective"))).alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["text"])
        span = F.array(F.struct((acc["at"] + p["lead"]).alias("start"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    mask = F.aggregate("parts", start, step, lambda acc: acc["out"])
    rendered = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return parts.select(F.col("_conv").alias(conv), "perspective", "block", "piece", F.size("parts").cast("long").alias("n_turns"), rendered.alias("rendered"), mask.alias("mask"))


def placed(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``pieces`` (of ``perspectives``) with offset: the code points of the dialogue before the piece.

    Only the pieces' lengths are put in order; texts are joined by the piece's key.
    """
    keys = [conv, "perspective", "block", "piece"]
    before = Window.partitionBy(conv, "perspective").orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(*keys, F.length("rendered").cast("long").alias("_n")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("offset"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return pieces.join(starts, same[0] & same[1] & same[2] & same[3]).drop(*[f"_{k}" for k in keys])
