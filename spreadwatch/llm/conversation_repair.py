"""Conversation structure repair by signature deduplication.

Method: each row of a conversation gets one character for its role and its first fault, so that a
conversation becomes a compact string, its signature. Distinct signatures are solved once each: a
recursion over (place, what the repaired roles so far ask for next), memoised place by place from
the end, so that no length is too deep for it. The cheapest edits come back as an audit string,
are joined to the conversations by signature, and are replayed over the rows in order.

Scale: faults, counts and signatures are windows and sums in Spark. The replay streams: an audit
goes before its conversation's rows in one sorted partition and a running hash takes each repaired
turn, so a task holds one row and one audit (a character a turn), not a conversation. A signature
that many conversations share is solved once; the join back to them is one Spark can split.

Fault characters: ``.`` must go (blank or duplicate); ``s u a x`` a whole row by the initial of
its role (x is any other, also an empty role); the same in capitals where the row is truncated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from spreadwatch.llm.common import WHITE, discard, scratch

#: The pattern (s?(ua)+)? as an automaton: START, AFTER_S, AFTER_U, AFTER_A. Each asks for a role next.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
WANTED = ("user", "user", "assistant", "user")
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
EMPTY = hashlib.sha256(b"").hexdigest()
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) of damaged rows; a null role, text or key part is one space, a null turn stays null.

    A dropped row stays as one with a null role, so that its conversation is not forgotten.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").when(F.col("kind") != 0, F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def faulty_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, code and what the counts need) of rows (conv_id, turn, role, text, copy) in order.

    Order: turn (null first), then role, text and copy. Rows with a null role are absent ones.
    """
    order = [F.col("role").isNull(), F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    w = Window.partitionBy("conv_id").orderBy(*order)
    same = Window.partitionBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).orderBy(*order)
    end = F.right(F.rtrim(F.translate("text", WHITE, " " * len(WHITE))), F.lit(1))
    initial = F.substring("role", 1, 1)
    met = rows.withColumns({
        "pos": F.row_number().over(w).cast("long"), "seen": F.row_number().over(same) > 1, "end": end, "initial": initial,
        "first_of_turn": F.col("role").isNotNull() & F.col("turn").isNotNull() & ~F.lag("turn").over(w).eqNullSafe(F.col("turn")), "before": F.lag(initial).over(w),
    })
    fault = F.when(F.col("end") == "", "blank").when(F.col("seen"), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    met = met.withColumn("fault", F.when(F.col("role").isNotNull(), fault))
    code = F.when(F.col("fault").isin("blank", "duplicate"), ".").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    illegal = (F.col("pos") > 1) & ~F.concat("before", "initial").isin("su", "ua", "au")
    return met.select("conv_id", "pos", "turn", "role", "text", "fault", "first_of_turn", F.when(F.col("role").isNotNull(), code).alias("code"), F.when(F.col("role").isNotNull(), illegal).alias("illegal"))


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature and counts) of ``faulty_rows``, one row per conversation; a gap count beyond a long is null."""
    n = lambda c: F.count(F.when(c, 1))
    alive, wide = F.col("role").isNotNull(), lambda c: c.cast("decimal(20,0)")
    turn = F.when(alive, F.col("turn"))
    gaps = (wide(F.max(turn)) - wide(F.min(turn)) + 1 - wide(n(F.col("first_of_turn")))).try_cast("long")
    codes = F.sort_array(F.collect_list(F.when(alive, F.struct("pos", "code"))))
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(codes, lambda x: x["code"]), "").alias("signature"), F.when(F.count(turn) > 0, gaps).otherwise(F.lit(0)).alias("gaps"),
        *[n(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], n(F.col("illegal")).alias("illegal"),
    )


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits: K keep, R rerole, D delete, I insert; of equally cheap ones the ASCII-least.

    From a place and state each edit leads to one state, so equally cheap audits differ in their
    next character and the least of these is the least audit. No more than two turns in a row are
    worth inserting: a third would ask for what the first did.
    """
    ends = {START: 0, AFTER_A: 0, AFTER_U: INSERT, AFTER_S: 2 * INSERT}
    after = [ends[s] for s in range(4)]
    table = [tuple("I" if cost else "" for cost in after)]  # the edit to make, by place from the end and by state
    for code in reversed(signature):
        extra = TRUNCATED if code.isupper() else 0
        own: list[list[tuple[int, str]]] = []
        for s in range(4):
            options = [(after[s] + DELETE, "D")]
            if code != ".":
                if s == START and code in "sS":
                    options.append((after[AFTER_S] + extra, "K"))
                if code.lower() == WANTED[s][0]:
                    options.append((after[NEXT[s]] + extra, "K"))
                options.append((after[NEXT[s]] + REROLE + extra, "R"))
            own.append(options)
        # an insert leaves the place as it is; two rounds settle it
        best = [min(o) for o in own]
        for _ in range(2):
            best = [min(*own[s], (best[NEXT[s]][0] + INSERT, "I")) for s in range(4)]
        after = [cost for cost, _ in best]
        table.append(tuple(edit for _, edit in best))
    cost, audit, place, state = after[START], [], len(signature), START
    while True:
        edit = table[place][state]
        if not edit:
            return cost, "".join(audit)
        audit.append(edit)
        if edit != "I":
            code = signature[len(signature) - place]
            place -= 1
            if edit == "D":
                continue
            if edit == "K" and state == START and code in "sS":
                state = AFTER_S
                continue
        state = NEXT[state]


def solutions(found: DataFrame) -> DataFrame:
    """(signature, cost, audit), each distinct signature solved once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved = [solve(s) for s in batch.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())], ["signature", "cost", "audit"])

    return found.select("signature").distinct().mapInArrow(run, "signature string, cost long, audit string")


def replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """One row per conversation (see ``RESULT``): audits (conv_id, counts, cost, audit) replayed over rows (conv_id, pos, role, text)."""
    header = audits.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *COUNTS, "audit")
    turns = rows.where("role is not null").select("conv_id", "pos", "role", "text", *[F.lit(None).cast("long").alias(c) for c in COUNTS], F.lit(None).cast("string").alias("audit"))
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    class Replay:
        def __init__(self, conv_id: int | None, values: tuple, audit: str):
            self.conv_id, self.values, self.audit = conv_id, values, audit
            self.at, self.state, self.written, self.sha = 0, START, False, hashlib.sha256()

        def write(self, role: str, text: str) -> None:
            self.sha.update(("\n" if self.written else "").encode() + f"{role}:".encode() + text.encode())
            self.written = True

        def inserts(self) -> None:
            while self.audit[self.at : self.at + 1] == "I":
                self.write(WANTED[self.state], "")
                self.state, self.at = NEXT[self.state], self.at + 1

        def turn(self, role: str, text: str) -> None:
            self.inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "D":
                return
            self.write(role if edit == "K" else WANTED[self.state], text)
            self.state = AFTER_S if edit == "K" and self.state == START and role[:1] == "s" else NEXT[self.state]

        def row(self) -> tuple:
            self.inserts()
            return self.conv_id, *self.values, self.audit, self.sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for conv_id, pos, role, text, *values, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text", *COUNTS, "audit")), strict=True):
                if pos == 0:
                    if now is not None:
                        done.append(now.row())
                    now = Replay(conv_id, tuple(values), audit)
                else:
                    now.turn(role, text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * len(kinds), kinds, strict=True)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.row(), kinds, strict=True)], names)

    return header.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, RESULT)


def repair(rows: DataFrame) -> DataFrame:
    """The structure of conversations (conv_id, turn, role, text, copy), its faults and its cheapest repair: see ``RESULT``.

    The repaired roles' initials follow (s?(ua)+)?: perhaps a system turn, then user and assistant
    by turns, or nothing at all. A role's initial is its first character; an empty role has none
    and can't be kept. A null conv_id is a conversation of its own. A row with a null role is
    absent: a conversation of nothing else gets zeros, an empty audit and the empty string's hash.
    Of rows with the same role and text the first in order (turn, null first; role; text; copy) is
    no duplicate. An empty table gives an empty one.
    """
    found = scratch(faulty_rows(rows), "faulty")
    each = scratch(signatures(found), "signatures")
    audits = each.join(solutions(each), "signature")
    out = scratch(replayed(found, audits.drop("signature")), "repaired")
    discard(found, each)
    return out


def op12_conversation_repair(spark, sf_dir):
    """Every conversation of the table, damaged by rule and repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast(LongType()).alias("conv_id"), "turn", "role", "text")
    return repair(damage(rows))
