"""Repair of dialogues whose turns are missing, blank, repeated, cut off or out of order, at the least cost of edits.

A turn is kept, given another role, or deleted; empty turns are inserted where the roles need them: a system turn at most, and then users and
assistants in turn. The turns that stay are found by a dynamic program over retained subsequences: what is retained last
is one of four states; a gap costs the deletions in it, which a prefix sum gives, so each state's best is a running minimum; the roles on
both sides of a gap say what is inserted. Edits that cost the same are settled by their audit, the letters of all edits in order.

Long dialogues are cut into segments. A segment is the best edits from each state to each state; these tables, a few numbers each, are put together for a
dialogue, and each segment is then solved again between the two states that the whole passes through there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chat import numbered
from .common import checkpointed, map_rows, written

#: Turns of a segment; results don't depend on it.
SEGMENT = 1024
#: What edits cost. A truncated turn that stays costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What is retained last: nothing, a system turn, a user's, an assistant's; and what is inserted before the next one, or at the end.
START, SYSTEM, USER, ASSISTANT = range(4)
_INSERTS = {
    (START, SYSTEM): "", (START, USER): "", (START, ASSISTANT): "u", (SYSTEM, USER): "", (SYSTEM, ASSISTANT): "u",
    (USER, USER): "a", (USER, ASSISTANT): "", (ASSISTANT, USER): "", (ASSISTANT, ASSISTANT): "u",
}
_CLOSING = {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: A turn's standing: all right, truncated, or to be deleted.
RIGHT, CUT, GONE = "r", "c", "g"
_WAY = T.StructType().add("segment", "long").add("entry", "integer").add("exit", "integer")
_CHAIN = T.StructType().add("ways", T.ArrayType(_WAY)).add("cost", "long")
_STEP = T.StructType().add("edits", "string").add("became", "string")
FAULTS = ("blank", "duplicate", "truncated")
_SPACE = " \t\n\x0b\x0c\r"


def solve(initials: str, standings: str, entry: int) -> dict[int, tuple[int, str]]:
    """For each state after the turns the least cost of getting there from entry, and of its audits the ASCII-least; without insertions at the end."""
    best: dict[int, tuple[int, str]] = {entry: (0, "")}  # costs less the deletions so far: gaps then cost nothing
    deleted = 0
    for initial, standing in zip(initials, standings, strict=True):
        kept: dict[int, tuple[int, str]] = {}
        if standing != GONE:
            own = TRUNCATED * (standing == CUT)
            for state in (SYSTEM, USER, ASSISTANT):
                letter = "K" if _STATE.get(initial) == state else "R" if state != SYSTEM else ""
                if letter:
                    from_ = [(c + INSERT * len(x) + own + REROLE * (letter == "R") - DELETE, a + "I" * len(x) + letter) for q, (c, a) in best.items() if (x := _INSERTS.get((q, state))) is not None]
                    if from_:
                        kept[state] = min(from_)
        deleted += DELETE
        best = {q: (c, a + "D") for q, (c, a) in best.items()}
        for q, found in kept.items():
            best[q] = min(best.get(q, found), found)
    return {q: (c + deleted, a) for q, (c, a) in best.items()}


_short = lru_cache(1 << 15)(solve)


def _solved(initials: str, standings: str, entry: int) -> dict[int, tuple[int, str]]:
    return (_short if len(initials) <= 32 else solve)(initials, standings, entry)


def segment_table(initials: str, standings: str) -> list[int]:
    """32 numbers: by entry and exit the least cost (-1: there is none) and the place of its audit among those of the entry."""
    costs, places = [-1] * 16, [0] * 16
    for p in range(4):
        found = _solved(initials, standings, p)
        for place, q in enumerate(sorted(found, key=lambda q: found[q][1])):
            costs[4 * p + q], places[4 * p + q] = found[q][0], place
    return costs + places


def chained(tables: Iterable[Iterable[int]]) -> tuple[list[tuple[int, int]], int]:
    """The entry and exit of each of a dialogue's segments in the cheapest edits with the ASCII-least audit, and what these cost.

    Audits from one entry over the same turns differ before either ends, so the first segment in which they differ decides.
    """
    tables = [list(t) for t in tables]
    to_go = [{q: INSERT * len(x) for q, x in _CLOSING.items()}]
    for t in reversed(tables):
        after = to_go[-1]
        to_go.append({p: min(costs) for p in range(4) if (costs := [t[4 * p + q] + after[q] for q in after if t[4 * p + q] >= 0])})
    to_go.reverse()
    out, p = [], START
    for t, here, after in zip(tables, to_go, to_go[1:], strict=False):
        q = min((q for q in after if t[4 * p + q] >= 0 and t[4 * p + q] + after[q] == here[p]), key=lambda q: t[16 + 4 * p + q])
        out.append((p, q))
        p = q
    return out, to_go[0][START]


def steps_of(initials: str, standings: str, entry: int, exit_: int) -> list[tuple[str, str]]:
    """For each turn its edits, an insertion before it included, and the initial that it has afterwards (empty if it goes)."""
    audit = _solved(initials, standings, entry)[exit_][1]
    out, state, inserted = [], entry, ""
    turns = iter(initials)
    for letter in audit:
        if letter == "I":
            inserted += letter
            continue
        initial = next(turns)
        became = ""
        if letter == "K":
            became = initial
        elif letter == "R":
            became = "a" if (state == USER) != bool(inserted) else "u"
        if became:
            state = _STATE[became]
        out.append((inserted + letter, became))
        inserted = ""
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _tables(initials: pd.Series, standings: pd.Series) -> pd.Series:
    return pd.Series([segment_table(i, s) for i, s in zip(initials, standings, strict=True)])


@F.pandas_udf(_CHAIN)
def _chains(segments: pd.Series, tables: pd.Series) -> pd.DataFrame:
    found = [(s, *chained(t)) for s, t in zip(segments, tables, strict=True)]
    return pd.DataFrame({"ways": [[{"segment": i, "entry": p, "exit": q} for i, (p, q) in zip(s, ways, strict=True)] for s, ways, _ in found], "cost": [cost for _, _, cost in found]})


@F.pandas_udf(T.ArrayType(_STEP))
def _steps(initials: pd.Series, standings: pd.Series, entry: pd.Series, exit_: pd.Series) -> pd.Series:
    return pd.Series([[{"edits": e, "became": b} for e, b in steps_of(*x)] for x in zip(initials, standings, entry, exit_, strict=True)])


def faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, at, role, text) with fault: the first of blank, duplicate (role and text stand earlier in the dialogue) and truncated; and initial: s, u, a or a dot."""
    said = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    rows = turns.withColumn("said", said).withColumn("inner", F.btrim("text", F.lit(_SPACE)))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min("at").alias("first"))
    first_letter = F.substring("role", 1, 1)
    fault = F.when(F.col("inner") == "", "blank").when(F.col("first") < F.col("at"), "duplicate").when(~F.substring(F.col("inner"), -1, 1).isin(".", "!", "?"), "truncated")
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")))
    return joined.select("conv_id", "at", "role", "text", fault.alias("fault"), F.when(first_letter.isin("s", "u", "a"), first_letter).otherwise(".").alias("initial"))


def segments(found: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, initials, standings, blank, duplicate, truncated) of faults(): a letter a turn, at most size of them in a row, and how many have a fault."""
    standing = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(RIGHT)
    letters = F.sort_array(F.collect_list(F.struct("at", "initial", standing.alias("standing"))))
    rows = found.groupBy("conv_id", F.floor(F.col("at") / size).alias("segment")).agg(letters.alias("l"), *[F.count_if(F.col("fault") == x).alias(x) for x in FAULTS])
    return rows.select("conv_id", "segment", F.array_join(F.col("l.initial"), "").alias("initials"), F.array_join(F.col("l.standing"), "").alias("standings"), *FAULTS)


def edited(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From segments(): (conv_id, segment, steps), and (conv_id, cost, last): the cost of a dialogue's edits and its last state.

    Only the tables of a dialogue's segments, 32 numbers for SEGMENT turns, meet in one row.
    """
    tables = parts.select("conv_id", "segment", _tables("initials", "standings").alias("table"))
    by_conv = tables.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "table"))).alias("l"))
    chains = checkpointed(by_conv.select("conv_id", _chains("l.segment", "l.table").alias("chain")))
    ways = chains.select(F.col("conv_id").alias("c"), F.explode("chain.ways").alias("w")).select("c", F.col("w.segment").alias("s"), "w.entry", "w.exit")
    both = parts.join(ways, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    steps = both.select("conv_id", "segment", _steps("initials", "standings", "entry", "exit").alias("steps"))
    return steps, chains.select("conv_id", "chain.cost", F.element_at("chain.ways", -1)["exit"].alias("last"))


def repaired(found: DataFrame, steps: DataFrame, ends: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(conv_id, at, k, role, text, edit): the turns of repaired dialogues in order of at and k; inserted ones are empty."""
    each = steps.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), F.posexplode("steps").alias("k", "step")).select("c", (F.col("s") * size + F.col("k")).alias("i"), "step.edits", "step.became").where("became <> ''")
    rows = found.join(each, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("i")))
    other = F.when(F.col("became") == "u", "assistant").otherwise("user")
    letter = F.substring("edits", -1, 1)
    own = F.struct(F.lit(1).alias("k"), F.when(letter == "K", F.col("role")).when(F.col("became") == "u", "user").otherwise("assistant").alias("role"), F.col("text").alias("text"), letter.alias("edit"))
    new = F.struct(F.lit(0).alias("k"), other.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
    stay = rows.select("conv_id", "at", F.explode(F.when(F.col("edits").startswith("I"), F.array(new, own)).otherwise(F.array(own))).alias("x")).select("conv_id", "at", "x.*")
    closing = F.when(F.col("last") == SYSTEM, F.array(F.lit("user"), F.lit("assistant"))).when(F.col("last") == USER, F.array(F.lit("assistant")))
    end = ends.select("conv_id", F.lit((1 << 63) - 1).alias("at"), F.posexplode(closing).alias("k", "role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
    return stay.unionByName(end)


def repair(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = SEGMENT) -> DataFrame:
    """The turns of every dialogue after its repair: conv_id, at, k, role, text and edit (K, R or I), in order of at and k.

    Turns come by turn (nulls first), role and text. A null role or text is one space, and so at fault. A null id is one dialogue; other columns aren't read. A dialogue
    of which nothing can stay for less has no rows.
    """
    plain = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))])
    found = written(faults(numbered(plain, "conv_id", "turn", "role", "text")))
    return repaired(found, *edited(written(segments(found, size))), size)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive): conversations damaged by a checksum of conv_id and turn, modulo 20; nulls are one space.

    0 drops a turn (it isn't alive), 1 empties it, 2 takes its ends of sentences away, 3 repeats it, 4 makes it a user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("alive"), times.alias("_")).drop("_")


def _hashes(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, SHA-256 of its role:text lines) of sorted rows, whose texts go through one at a time."""
    at, sha = None, None
    for conv, role, text in rows:
        if sha is None or conv != at:
            if sha is not None:
                yield at, sha.hexdigest()
            at, sha = conv, hashlib.sha256()
        else:
            sha.update(b"\n")
        sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
    if sha is not None:
        yield at, sha.hexdigest()


def digest(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row for each conv_id of turns (conv_id, turn, role, text, alive): conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit and repaired_sha256.

    Turns that aren't alive are known by their ids alone. A dialogue's repaired lines go through one task, as a hash needs them in their order, but are never held there together.
    A null conv_id is one dialogue; one without turns has zeros, no audit and the hash of nothing; without dialogues there is no row.
    """
    turns = turns.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long"))
    found = written(faults(numbered(turns.where("alive"), "conv_id", "turn", "role", "text")))
    parts = written(segments(found, size))
    steps, ends = edited(parts)
    steps = checkpointed(steps)

    alive = F.when(F.col("alive"), F.col("turn"))
    by_turn = turns.groupBy("conv_id", "turn").agg(F.max("alive").alias("alive")).groupBy("conv_id").agg(F.max(alive).alias("last"), F.min(alive).alias("first"), F.count(alive).alias("n"))
    wide = F.col("last").cast("decimal(38,0)") - F.col("first").cast("decimal(38,0)") + 1 - F.col("n")
    gaps = by_turn.select("conv_id", F.coalesce(F.least(wide, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long"), F.lit(0)).alias("gaps"))
    # The pairs of a segment and of its first turn with the one before it.
    joined = F.concat(F.coalesce(F.lag(F.substring("initials", -1, 1)).over(Window.partitionBy("conv_id").orderBy("segment")), F.lit("")), F.col("initials"))
    pairs = parts.select("conv_id", *FAULTS, (F.length(joined) - 1 - F.regexp_count(joined, F.lit("(?=su|ua|au)"))).alias("illegal"))
    counts = pairs.groupBy("conv_id").agg(*[F.sum(c).cast("long").alias(c) for c in (*FAULTS, "illegal")])
    audits = steps.select("conv_id", "segment", F.array_join(F.col("steps.edits"), "").alias("a")).groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("segment", "a")))["a"], "").alias("audit"))
    closing = F.when(F.col("last") == SYSTEM, "II").when(F.col("last") == USER, "I").otherwise("")
    lines = repaired(found, steps, ends, size).repartition("conv_id").sortWithinPartitions("conv_id", "at", "k").select("conv_id", "role", "text")
    hashes = map_rows(lines, _hashes, "conv_id long, sha string")

    # One row a dialogue from each table, put together by one shuffle.
    have = {"gaps": gaps, "counts": counts, "cost": ends.select("conv_id", "cost", closing.alias("closing")), "audit": audits, "sha": hashes}
    whole = None
    for df in have.values():
        whole = df if whole is None else whole.unionByName(df, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c)
    empty = lambda c: F.coalesce(F.max(c), F.lit(""))
    return whole.groupBy("conv_id").agg(
        zero("gaps"), *[zero(c) for c in (*FAULTS, "illegal", "cost")], F.concat(empty("audit"), empty("closing")).alias("audit"), F.coalesce(F.max("sha"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    )
