"""Chat formatting with perspective rotation: each participant of a dialogue in turn becomes the assistant.

For every participant the dialogue is rendered with that participant's turns as the assistant's and all others as named users;
turns of the role `system` stay the system's in every view. The mask lists the characters to learn from: text and end mark of the
assistant's turns. All of it is DataFrame functions.

A view of a dialogue is one row for each part of `PART` turn numbers. A part that holds more than `MOST` turns (repeated turn
numbers) is cut by turn number, and a turn number of more than `MOST` turns by a hash of turns and of their copies' chunks, so no row
gathers an unbounded group. Parts
in the order (part, slice, share) make up the dialogue; mask positions count from the start of their row.

Defined results: rows equal in conversation, turn, role and text are turns of their own, one after the other. A null text is empty, a null role is the participant
`unknown`, a null turn number comes after all others, a null conversation is one conversation. Among equal turn numbers role,
then text decide. Marks inside a text are broken by a space, so that no text can end its turn. A conversation of system turns
alone has no view. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART, MOST = 256, 1024
START, END, MARK, BROKEN = "<|im_start|>", "<|im_end|>\n", "<|im_", "<| im_"
SYSTEM, UNKNOWN = "system", "unknown"
PLACE = ("part", "slice", "share")


def clean_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conversation, turn, role, text, copies, chunk) without nulls in role and text and without marks in the text.

    Equal turns are one row with their number, or several of at most `MOST` turns each (chunks).
    """
    rows = turns.select(
        F.col(conversation).alias("conversation"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(UNKNOWN)).alias("role"),
        F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(BROKEN)).alias("text"))
    counted = rows.groupBy("conversation", "turn", "role", "text").agg(F.count("*").alias("all"))
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(all - 1) div {MOST}"))))
    return chunks.withColumn("copies", F.least(F.lit(MOST), F.col("all") - F.col("chunk") * MOST).cast("int")).drop("all")


def placed(turns: DataFrame) -> DataFrame:
    """Turns with part, slice and share. Only parts and turn numbers with too many turns get a slice or a share other than 0."""
    last = F.lit((1 << 63) - 1)
    rows = turns.withColumn("part", F.coalesce(F.floor(F.col("turn") / PART), last))
    parts = rows.groupBy("conversation", "part").agg(F.sum("copies").alias("n")).where(F.col("n") > MOST).select(
        F.col("conversation").alias("c"), F.col("part").alias("p"), F.lit(True).alias("large"))
    rows = rows.join(parts, F.col("conversation").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").drop("c", "p")
    slice_ = F.when(F.col("large"), F.coalesce(F.col("turn") - F.col("part") * PART + 1, F.lit(1))).otherwise(0)
    rows = rows.withColumn("slice", slice_.cast("long")).drop("large")
    slices = rows.where("slice > 0").groupBy("conversation", "part", "slice").agg(F.sum("copies").alias("n")).where(F.col("n") > MOST).select(
        F.col("conversation").alias("c"), F.col("part").alias("p"), F.col("slice").alias("s"), F.ceil(F.col("n") / MOST * 2).alias("shares"))
    rows = rows.join(slices, F.col("conversation").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("slice") == F.col("s")), "left")
    share = F.when(F.col("shares").isNotNull(), F.pmod(F.xxhash64("role", "text", "chunk"), F.col("shares"))).otherwise(0)
    return rows.withColumn("share", share.cast("long")).drop("c", "p", "s", "shares")


def head(turn: Column, speaker: Column) -> Column:
    name = F.when(turn["role"] == SYSTEM, F.lit(SYSTEM)).when(turn["role"] == speaker, F.lit("assistant")).otherwise(
        F.concat(F.lit("user name="), turn["role"]))
    return F.concat(F.lit(START), name, F.lit("\n"))


def body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END))


def spans(turns: Column, speaker: Column) -> Column:
    """Begin and end of each of the speaker's turns in the rendered row."""
    span = "struct<begin:int,end:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("found"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(head(turn, speaker))
        end = begin + F.length(body(turn))
        own = F.array(F.struct(begin.alias("begin"), end.alias("end")).cast(span))
        return F.struct(end.alias("at"), F.when(turn["role"] == speaker, F.concat(state["found"], own)).otherwise(state["found"]).alias("found"))

    return F.aggregate(turns, start, step, lambda state: state["found"])


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conversation, speaker, part, slice, share, n_turns, text, mask) of every participant's view."""
    clean = clean_turns(turns, conversation, turn, role, text)
    speakers = clean.where(F.col("role") != SYSTEM).select(F.col("conversation").alias("c"), F.col("role").alias("speaker")).distinct()
    parts = placed(clean).groupBy("conversation", *PLACE).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "copies"))).alias("turns"))
    parts = parts.withColumn("turns", F.flatten(F.transform("turns", lambda x: F.array_repeat(x, x["copies"]))))
    views = parts.join(speakers, F.col("conversation").eqNullSafe(F.col("c")))
    speaker = F.col("speaker")
    rendered = F.array_join(F.transform("turns", lambda x: F.concat(head(x, speaker), body(x))), "")
    return views.select(F.col("conversation").alias(conversation), "speaker", *PLACE, F.size("turns").cast("long").alias("n_turns"),
                        rendered.alias("text"), spans(F.col("turns"), speaker).alias("mask"))
