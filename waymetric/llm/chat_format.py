"""Operator 4: perspective rotation of multi-party dialogues.

Every participant of a conversation gets a rendering of its own, in which that
speaker is the assistant and the others are named users.  Turns are rendered row
by row; offsets come from running totals over range-partitioned rows, so that no
task needs a whole conversation, and dialogues are assembled in parts of bounded
length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Roles that are context for everyone and never a perspective.
CONTEXT_ROLES = ("system",)
#: Characters that a name must not bring into a header, and what stands for them there.
NAME_ESCAPES = {"%": "%25", "<": "%3C", ">": "%3E", "|": "%7C", "\n": "%0A", "\r": "%0D"}
#: Code points after which a dialogue continues in a further part.
PART_CHARS = 1 << 20


def running_start(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds start (the values before a row, within its keys' group and order) and position (0, 1, ...).

    Rows are dealt by ranges of keys and order, so that a group of any size spreads
    over many tasks; each task sums its own rows, and the tasks' totals (one row per
    group and task) shift them.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(n, *keys, *order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "range").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    shift = totals.select(
        F.struct(*keys).alias("g"), F.col("range").alias("r"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0")
    )
    own = Window.partitionBy("range", *keys).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({"s1": F.coalesce(F.sum(value).over(upto), F.lit(0)), "c1": F.row_number().over(own) - 1}).withColumn("g", F.struct(*keys))
    return (
        local.join(shift, (local["range"] == shift["r"]) & local["g"].eqNullSafe(shift["g"]))
        .withColumns({"start": F.col("s0") + F.col("s1"), "position": F.col("c0") + F.col("c1")})
        .select(*df.columns, "start", "position")
    )


def _escaped(text: Column) -> Column:
    """Markers inside a turn's text lose their meaning: <| becomes <||."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def _name(speaker: Column) -> Column:
    """A speaker's name in a header; different names stay different."""
    for c, e in NAME_ESCAPES.items():
        speaker = F.replace(speaker, F.lit(c), F.lit(e))
    return speaker


def rotate_perspectives(
    df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context_roles: tuple[str, ...] = CONTEXT_ROLES
) -> DataFrame:
    """One row per perspective and turn: id_col, perspective, position, turn, speaker,
    rendered, start, mask_start, mask_end.

    Perspectives are the distinct speakers outside context_roles; a conversation
    without one gives no rows.  The perspective's own turns are rendered as
    assistant and are what is learnt: the mask spans their text and end marker, in
    code points of the whole dialogue; elsewhere it is null.  Other speakers are
    users with a name, in which %, <, >, | and line ends are escaped (NAME_ESCAPES),
    and the marker <| in a text becomes <||, so that neither can open a turn.
    Context roles stay as they are.  Turns go by number, then speaker, then text,
    nulls first; equal rows stay as they are.  A null role is a speaker of its own, a
    user without a name, whose perspective is null.  A null text is empty, null ids
    are one conversation.  An empty table gives no rows; extra columns are ignored.
    """
    turns = df.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("speaker"), _escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("body")
    )
    context = F.coalesce(F.col("speaker").isin(*context_roles), F.lit(False))
    people = turns.where(~context).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    user = F.concat(F.lit("<|user"), F.coalesce(F.concat(F.lit(" name="), _name(F.col("speaker"))), F.lit("")), F.lit("|>\n"))
    head = F.when(own, F.lit("<|assistant|>\n")).when(context, F.concat(F.lit("<|"), "speaker", F.lit("|>\n"))).otherwise(user)
    segments = (
        turns.join(people, turns["conv"].eqNullSafe(people["c"]))
        .select("conv", "perspective", "turn", "speaker", head.alias("head"), F.concat("body", F.lit("<|end|>\n")).alias("tail"))
        .select("conv", "perspective", "turn", "speaker", F.concat("head", "tail").alias("rendered"), F.length("head").cast("long").alias("n_head"))
        .withColumn("n_chars", F.length("rendered").cast("long"))
    )
    placed = running_start(segments, ["conv", "perspective"], ["turn", "speaker", "rendered"], "n_chars")
    return placed.select(
        F.col("conv").alias(id_col), "perspective", "position", "turn", "speaker", "rendered", "start",
        F.when(own, F.col("start") + F.col("n_head")).alias("mask_start"), F.when(own, F.col("start") + F.col("n_chars") - 1).alias("mask_end"),
    )


def assemble(segments: DataFrame, *, id_col: str = "conv_id", part_chars: int = PART_CHARS) -> DataFrame:
    """One row per dialogue and part: id_col, perspective, part, n_turns, text, masks.

    A part has the turns that start within its part_chars code points, so that a row
    stays bounded by that and one turn.  masks lists the spans `start-end`, in code
    points of the whole dialogue.
    """
    each = F.struct("position", "rendered", F.when(F.col("mask_start").isNotNull(), F.concat_ws("-", "mask_start", "mask_end")).alias("mask"))
    rows = segments.groupBy(id_col, "perspective", F.floor(F.col("start") / part_chars).alias("part")).agg(F.sort_array(F.collect_list(each)).alias("t"))
    return rows.select(
        id_col, "perspective", "part", F.size("t").cast("long").alias("n_turns"), F.array_join("t.rendered", "").alias("text"), F.array_join("t.mask", ",").alias("masks")
    )


