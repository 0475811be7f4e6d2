"""Repair of damaged conversations by one integer-minimum DAG recurrence per conversation.

A node of the DAG is a number of turns still to come and the state of the role pattern
``(s?(ua)+)?``; an edge keeps, re-roles or deletes a turn or inserts one. The worth of a node is
one big integer: its high digits are the least cost from there to the end, its low digits, a
fixed number of them, spell the audit letters in order and end in zeros. Putting an edge before a
rest moves the letters down by one digit and adds cost and letter, so the ordinary minimum of
integers finds the least cost and among those the ASCII-least audit; a shorter audit comes before
the longer ones it starts.

Two inserts never stand together in a cheapest repair: leaving both out keeps the pattern, unless
a system turn alone is left, and deleting that is cheaper. So one insert between two turns is tried.

Turns are shuffled once with their texts, by ranges of conversation and turn, so that a
conversation's rows may lie in many tasks. Its recurrence sees a few bytes a row; its repaired
text is hashed as a stream. Time grows with the square of a conversation's rows, over the machine
word: 10,000 rows take about a second.

Defined cases: NULL role or text is one space, as are NULL ids and turns in the damage rule; rows
without an id form a conversation of their own; rows of one turn are ordered by role, then text;
repeated rows stay and are duplicates; white space of any length is blank; a conversation
without rows after the damage has zeros, no audit and the hash of the empty text; an empty table
gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etlvault.llm.common import cut, read
from etlvault.llm.ordered_digest import ordered_digest
from etlvault.operators.ordered import with_running_number

DROP, EMPTY, STRIP, REPEAT, TO_USER, SLOTS = 0, 1, 2, 3, 4, 20
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
# Digits of the audit letters in ASCII order; 0 is the padding behind an audit's end.
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
DIGIT_BITS = 3
ROLES = {"u": "user", "a": "assistant"}
# Role pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_key, conv_id, turn, role, text): the rows left, emptied, stripped, repeated or given another role."""
    space = F.lit(" ")
    spot = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(F.encode(spot, "UTF-8")) % SLOTS
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    changed = F.when(kind == EMPTY, F.lit("")).when(kind == STRIP, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.where(kind != DROP).select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_key"), "turn",
        F.when(kind == TO_USER, F.lit("user")).otherwise(role).alias("role"), changed.alias("text"),
        F.when(kind == REPEAT, F.lit(2)).otherwise(F.lit(1)).alias("times"))
    return rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "again")


def edits(initials: str, faults: Sequence[int]) -> tuple[int, str]:
    """Least cost and, of the cheapest, the ASCII-least audit of one conversation."""
    n = len(initials)
    width = DIGIT_BITS * (2 * n + 2)
    letters = (1 << width) - 1
    put = {x: d << (width - DIGIT_BITS) for x, d in LETTERS.items()}
    never = 1 << (width + 64)

    def before(cost: int, letter: str, rest: int) -> int:
        if rest >= never:
            return never
        return (((rest >> width) + cost) << width) | put[letter] | ((rest & letters) >> DIGIT_BITS)

    def with_insert(worth: list[int]) -> list[int]:
        return [min([worth[state], *(before(INSERT_COST, "I", worth[NEXT[state, x]]) for x in ROLES if (state, x) in NEXT)]) for state in range(4)]

    worth = with_insert([0 if state in ENDS else never for state in range(4)])
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        taken = []
        for state in range(4):
            choices = [before(DELETE_COST, "D", worth[state])]
            if fault not in (BLANK, DUPLICATE):
                if (state, initial) in NEXT:
                    choices.append(before(KEEP_COST + more, "K", worth[NEXT[state, initial]]))
                choices += [before(REROLE_COST + more, "R", worth[NEXT[state, x]]) for x in ROLES if (state, x) in NEXT]
            taken.append(min(choices))
        worth = with_insert(taken)
    best, names, audit = worth[START], {d: x for x, d in LETTERS.items()}, []
    for at in range(width - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = (best >> at) & 7 if width < 4096 else 0
        if not digit:
            break
        audit.append(names[digit])
    if width >= 4096:  # long audits are read from their octal digits at once
        audit = [names[int(x)] for x in oct(best & letters)[2:].zfill(width // DIGIT_BITS).rstrip("0")]
    return best >> width, "".join(audit)


def apply(audit: str, initials: str) -> tuple[list[str | None], list[str], list[str]]:
    """Of every turn its new role (empty: its own, None: deleted) and the roles inserted before it; then those at the end."""
    roles, inserted, open_inserts, state, at = [], [], [], START, 0
    for letter in audit:
        if letter == "D":
            roles.append(None)
        elif letter == "K":
            roles.append("")
            state = NEXT[state, initials[at]]
        else:
            x = next(x for x in ROLES if (state, x) in NEXT)
            state = NEXT[state, x]
            if letter == "I":
                open_inserts.append(ROLES[x])
                continue
            roles.append(ROLES[x])
        inserted.append("\n".join(f"{x}:" for x in open_inserts))
        open_inserts, at = [], at + 1
    return roles, inserted, open_inserts


_PLAN = pa.schema([("conv_key", pa.string()), *((c, pa.int64()) for c in STATS), ("audit", pa.string()), ("numbers", pa.list_(pa.int64())),
                   ("roles", pa.list_(pa.string())), ("before", pa.list_(pa.string())), ("after", pa.string())])


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, rows in zip(batch.column("conv_key").to_pylist(), batch.column("rows"), strict=True):
            rows = rows.values
            turn, initial, shape, same = (rows.field(c).to_pylist() for c in ("turn", "initial", "shape", "same"))
            seen, faults = set(), []
            for x, digest in zip(shape, same, strict=True):
                faults.append(x if x == BLANK else DUPLICATE if digest in seen else x)
                seen.add(digest)
            initials = "".join(x or " " for x in initial)
            turns = {t for t in turn if t is not None}
            cost, audit = edits(initials, faults)
            roles, before, after = apply(audit, initials)
            out.append((key, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
                        sum(pair not in LEGAL for pair in zip(initials, initials[1:], strict=False)), cost, audit,
                        rows.field("number").to_pylist(), roles, before, "\n".join(f"{x}:" for x in after)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PLAN.types, strict=True)], schema=_PLAN)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair the conversations of (conv_key, turn, role, text), no role, text or key being NULL.

    Returns (conv_key, gaps, blank, duplicate, truncated, illegal, cost, audit) and the repaired
    turns (conv_key, place, piece), a piece being the ``role:text`` lines that stand for one turn.
    """
    numbered = cut(with_running_number(rows.select("conv_key", "turn", "role", "text"), ["conv_key", "turn", "role", "text"], "number"))
    text = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    shape = F.when(text == "", BLANK).when(~F.substring(text, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN)
    same = F.substring(F.unhex(F.sha2(F.encode(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), "UTF-8"), 256)), 1, 16)
    codes = numbered.select("conv_key", F.struct(F.col("number"), F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("initial"),
                                                 shape.alias("shape"), same.alias("same")).alias("row"))
    gathered = codes.groupBy("conv_key").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    longs = ", ".join(f"{c} long" for c in STATS)
    plans = cut(gathered.mapInArrow(_plan, f"conv_key string, {longs}, audit string, numbers array<long>, roles array<string>, before array<string>, after string"))
    edit = plans.select(F.explode(F.arrays_zip("numbers", "roles", "before")).alias("e")).select(
        F.col("e.numbers").alias("number"), F.col("e.roles").alias("new_role"), F.col("e.before").alias("before"))
    own = F.when(F.col("new_role").isNotNull(), F.concat(F.when(F.col("new_role") == "", F.col("role")).otherwise(F.col("new_role")), F.lit(":"), F.col("text")))
    lead = F.when(F.col("before") != "", F.col("before"))
    lines = numbered.join(edit, "number").select("conv_key", (F.col("number") * 2).alias("place"), F.concat_ws("\n", lead, own).alias("piece"),
                                                 (lead.isNotNull() | own.isNotNull()).alias("any")).where("any").drop("any")
    ends = plans.where("after != ''").select("conv_key", (F.array_max("numbers") * 2 + 1).alias("place"), F.col("after").alias("piece"))
    return plans.select("conv_key", *STATS, "audit"), lines.unionByName(ends)


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the undamaged table: what is wrong after the damage, and its cheapest repair."""
    plans, lines = repair(damage(conversations))
    digests = ordered_digest(lines.select(F.col("conv_key").alias("key"), "place", F.encode("piece", "UTF-8").alias("piece")), b"\n")
    every = conversations.select(F.col("conv_id"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_key")).distinct()
    none = hashlib.sha256(b"").hexdigest()
    return (every.join(plans, "conv_key", "left").join(digests.select(F.col("key").alias("conv_key"), F.col("sha256").alias("digest")), "conv_key", "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in STATS], F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("digest", F.lit(none)).alias("repaired_sha256")))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(read(spark, sf_dir, "conversations"))


QUERIES = {"op12_turn_repair": op12_turn_repair}
ORACLE: dict[str, str] = {}
