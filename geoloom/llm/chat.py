"""Dialogues of several parties, told once from each participant's side, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

#: Messages that are rendered and joined at a time; results don't depend on it.
SEGMENT = 64
#: Turns in whose ranges messages are numbered before the ranges are put one after another.
RANGE = 1024
#: Messages of such a range from which it is dealt further.
MANY = 4096
#: Roles that frame a dialogue without taking part in it.
FRAMES = ("system",)
#: The marks around a message.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, at, role, text): the messages with their place in the dialogue, by turn (nulls first), role and text.

    Equal messages are counted first, before any shuffle of theirs. What is left is numbered within parts of a dialogue, and the parts' sizes are
    summed up, so no task sorts a long dialogue whole. Parts are ranges of turns; where a range holds more than MANY messages (turns that
    are null or the same), its parts are the messages of one turn and role whose texts begin alike.
    """
    order = ("turn", "role", "text")
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.groupBy("conv_id", *order).agg(F.count("*").alias("times")).withColumn("range", F.floor(F.col("turn") / RANGE))
    wide = rows.groupBy(F.col("conv_id").alias("c"), F.col("range").alias("r")).agg(F.count("*").alias("k")).where(F.col("k") > MANY).select("c", "r", F.lit(True).alias("hot"))
    rows = rows.join(wide, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("range").eqNullSafe(F.col("r")), "left").drop("c", "r")
    # As a struct these sort as the messages do: by range, and within a hot one by turn, role and the beginning of the text.
    hot = lambda c: F.when(F.col("hot"), c)
    rows = rows.withColumn("part", F.struct("range", hot(F.col("turn")).alias("t"), hot(F.col("role")).alias("s"), hot(F.substring("text", 1, 8)).alias("x"))).drop("hot", "range")
    sizes = rows.groupBy("conv_id", "part").agg(F.sum("times").alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    earlier = Window.partitionBy("conv_id", "part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("own", F.coalesce(F.sum("times").over(earlier), F.lit(0))).join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("part").eqNullSafe(F.col("p")))
    first = F.col("start") + F.col("own")
    return at.select("conv_id", F.explode(F.sequence(first, first + F.col("times") - 1)).alias("at"), "role", "text")


def _piece(m: Column, participant: Column, frames: tuple[str, ...]) -> Column:
    """A message as the participant sees it: role, name, content, rendered text and the length of what is trained."""
    mine = F.coalesce(m["role"] == participant, F.lit(False))
    role = F.when(mine, "assistant").when(m["role"].isin(*frames), m["role"]).otherwise("user")
    # Marks inside a message or a name are broken up, and names stay in their line, so that nothing can open a message of its own.
    whole = lambda x: F.replace(x, F.lit("<|im_"), F.lit("<| im_"))
    name = F.when(role == "user", F.regexp_replace(whole(F.coalesce(m["role"], F.lit("unknown"))), r"[\x00-\x20]+", " "))
    content = whole(F.coalesce(m["text"], F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(F.lit("")), F.lit("\n"))
    tail = F.concat(content, F.lit(CLOSE))
    return F.struct(
        role.alias("role"), name.alias("name"), content.alias("content"), mine.alias("trained"), F.concat(head, tail, F.lit("\n")).alias("text"), F.length(head).alias("head"), F.length(tail).alias("tail")
    )


def rotate(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT, frames: tuple[str, ...] = FRAMES) -> DataFrame:
    """Every dialogue once for each participant, who is its assistant; all others are users under their own names.

    One row for each conversation and participant: conv_id, participant, messages (role, name, content, trained), text (all of them rendered) and mask: (start, end) in the text, in characters, of what
    the participant says, with the mark that ends it, which alone is trained on.

    Participants are the distinct roles but frames (and null): roles in frames keep their place and are never trained on.
    A message without a role is a user's named unknown; one without text is empty. A conversation of frames alone has no
    participant and so no row. A null conversation id is one conversation. Messages at the same turn come by role and text; repeated rows are messages
    of their own. Other columns are not read.

    A dialogue's messages are rendered in pieces of at most segment messages, wherever these are, and places in a piece are moved by the lengths of the pieces before it, one number each. Only
    the rendered dialogue itself, which is the row asked for, is put together whole.
    """
    rows = numbered(turns, conv_id, turn, role, text)
    who = rows.where(F.col("role").isNotNull() & ~F.col("role").isin(*frames)).select(F.col("conv_id").alias("c"), F.col("role").alias("participant")).distinct()
    message = F.struct("at", "role", "text")
    parts = rows.groupBy("conv_id", F.floor(F.col("at") / segment).alias("segment")).agg(F.sort_array(F.collect_list(message)).alias("said"))
    seen = parts.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "participant", "segment", F.transform("said", lambda m: _piece(m, F.col("participant"), frames)).alias("m"))

    def masks(m: Column) -> Column:
        size = lambda x: F.length(x["text"])
        before = F.transform(m, lambda x, i: F.aggregate(F.slice(m, F.lit(1), i), F.lit(0), lambda n, y: n + size(y)))
        both = F.zip_with(m, before, lambda x, b: F.struct(x["trained"].alias("t"), (b + x["head"]).alias("start"), (b + x["head"] + x["tail"]).alias("end")))
        return F.transform(F.filter(both, lambda x: x["t"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    pieces = seen.select(
        "conv_id",
        "participant",
        "segment",
        F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["name"].alias("name"), x["content"].alias("content"), x["trained"].alias("trained"))).alias("messages"),
        F.array_join(F.transform("m", lambda x: x["text"]), "").alias("text"),
        let(F.col("m"), masks).alias("mask"),
    )
    earlier = Window.partitionBy("conv_id", "participant").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    moved = pieces.withColumn("offset", F.coalesce(F.sum(F.length("text").cast("long")).over(earlier), F.lit(0).cast("long")))
    placed = F.transform("mask", lambda s: F.struct((s["start"] + F.col("offset")).alias("start"), (s["end"] + F.col("offset")).alias("end")))
    whole = moved.groupBy("conv_id", "participant").agg(F.sort_array(F.collect_list(F.struct("segment", "messages", "text", placed.alias("mask")))).alias("p"))
    return whole.select("conv_id", "participant", F.flatten("p.messages").alias("messages"), F.array_join("p.text", "").alias("text"), F.flatten("p.mask").alias("mask"))


def digest(rotated: DataFrame) -> DataFrame:
    """The rows with their messages counted and the mask as text."""
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rotated.select("conv_id", "participant", F.size("messages").cast("long").alias("n_messages"), F.size("mask").cast("long").alias("n_trained"), "text", mask.alias("mask"))
