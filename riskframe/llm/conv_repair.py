"""Repair of damaged conversations by a streamed minimum-cost edit path.

A conversation is well formed when its role initials are ``(s?(ua)+)?``: four
states (start, after system, after user, after assistant). Each row is kept
(0), given another role (2) or deleted (3; a must for blank rows and repeats),
an empty row may be inserted anywhere (2), and a truncated row that stays costs
1. The cheapest edits win, the ASCII-least sequence of edit initials on ties.

Rows are dealt by conversation once. Inside the tasks sorts follow, none of
which shuffles: by content (rows seen earlier), by turn (places), by place
downwards (the costs to the end are carried from row to row, across Arrow
batches), by place upwards (the edits are walked). The downward pass holds four numbers and gives each row
one byte, the best edit in each of the four states; it never keeps a row. Since
these bytes travel with their rows into the next sort, which spills to disk like
any Spark sort, a giant conversation needs no memory but for its one audit
string. Each edit has its own initial, so walking by the least optimal initial
gives the ASCII-least path.

The digest of a repaired conversation is one running SHA-256, so one
conversation passes through one task, row by row; different ones spread.

Nulls and odd input: a null conversation is a conversation of its own; a null
turn comes first and counts for no gap; a null role or text is one space (so the
row is blank, or its role fits nowhere). Rows of the same turn come in order of
their role and text before damage; repeated rows stand beside each other and the
later one is a duplicate. A role's initial is its first character, none if it is
empty. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from riskframe.llm.common import small_batches

SPACE_CLASS = "\\x20\\x09-\\x0D"
LONG_MAX = (1 << 63) - 1

# States after the rows so far: 0 nothing, 1 system, 2 user, 3 assistant.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
TURN_TO = [2, 2, 3, 2]  # the state a new or changed role leads to from each state
ROLE = {2: "user", 3: "assistant"}
END_COST = [0, 4, 2, 0]  # to finish by insertions alone
INSERT, CHANGE, DELETE, CUT = 2, 2, 3, 1
EDITS = "DIKR"  # in ASCII order; a row's byte holds two bits a state
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def damaged(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with faults put in by the checksum of ``conversation:turn``.

    ``conv, turn, role, text, was_role, was_text, copy, gone``: a dropped row stays as
    a marker (``gone``), so that a conversation that loses all its rows is still known.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(own(conv_col), F.lit(":"), own(turn_col)).cast("binary")) % 20
    rows = conv.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), own(role_col).alias("was_role"), own(text_col).alias("was_text"), kind.alias("kind")
    )
    return rows.select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("was_role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("was_text", "[.!?]", "")).otherwise(F.col("was_text")).alias("text"),
        "was_role",
        "was_text",
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (F.col("kind") == 0).alias("gone"),
    )


def undamaged(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows as they are, in the columns of ``damaged``."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conv.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), own(role_col).alias("role"), own(text_col).alias("text"),
        own(role_col).alias("was_role"), own(text_col).alias("was_text"), F.lit(0).alias("copy"), F.lit(False).alias("gone"),
    )


def first_fault(text: Column, seen: Column) -> Column:
    """0 none, else the first of blank, duplicate, truncated. The last letter is looked up, not the whole text."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", BLANK).when(seen, DUPLICATE).when(~F.right(inner, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)


def row_choice(after: list[int], initial: str, fault: int) -> tuple[list[int], int]:
    """Costs to the end before a row, from those after it, and the row's byte of best edits."""
    must_go = fault in (BLANK, DUPLICATE)
    cut = CUT if fault == TRUNCATED else 0
    ways = []
    for q in range(4):
        w = {"D": DELETE + after[q]}
        if not must_go:
            w["R"] = CHANGE + cut + after[TURN_TO[q]]
            if (q, initial) in NEXT:
                w["K"] = cut + after[NEXT[q, initial]]
        ways.append(w)
    cost = [min(w.values()) for w in ways]
    for _ in range(2):  # an insertion leads to user or assistant; more than two in a row never pay
        cost = [min(cost[q], INSERT + cost[TURN_TO[q]]) for q in range(4)]
    byte = 0
    for q in range(4):
        ways[q]["I"] = INSERT + cost[TURN_TO[q]]
        least = min(e for e, c in ways[q].items() if c == cost[q])
        byte |= EDITS.index(least) << (2 * q)
    return cost, byte


def _downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation from the last to the first: each row's byte, the costs carried on."""
    known: dict = {}  # the few combinations of costs, initial and fault; costs count from the least
    none = object()
    conv, costs, base = none, END_COST, 0
    for batch in batches:
        bytes_, totals = [], []
        names = batch.schema.names
        for c, gone, initial, fault in zip(*(batch.column(names.index(n)).to_pylist() for n in ("conv", "gone", "initial", "fault")), strict=True):
            if c != conv or conv is none:
                conv, costs, base = c, END_COST, 0
            byte = 0
            if not gone:
                key = (*costs, initial if initial in ("s", "u", "a") else "", fault)
                if key not in known:
                    new, byte = row_choice(list(key[:4]), key[4], fault)
                    low = min(new)
                    known[key] = ([x - low for x in new], low, byte)
                costs, low, byte = known[key]
                base += low
            bytes_.append(byte)
            totals.append(base + costs[0])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(bytes_, pa.int32()), pa.array(totals, pa.int64())], names=[*names, "edits", "to_end"]
        )


class _Walk:
    """One conversation, walked upwards: counts, edits taken, the digest of what they leave."""

    def __init__(self):
        self.state, self.cost, self.rows = 0, 0, 0
        self.faults = [0, 0, 0, 0]
        self.least = self.most = self.last_turn = None
        self.turns = self.illegal = 0
        self.initial = None
        self.audit: list[str] = []
        self.digest, self.any = hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def _insert(self) -> None:
        self.state = TURN_TO[self.state]
        self.audit.append("I")
        self._put(ROLE[self.state], "")

    def row(self, turn, role: str, text: str, initial: str, fault: int, edits: int, to_end: int) -> None:
        if not self.rows:
            self.cost = to_end
        self.rows += 1
        self.faults[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.least = turn if self.least is None else self.least
            self.most = self.last_turn = turn
            self.turns += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        while (edit := EDITS[(edits >> (2 * self.state)) & 3]) == "I":
            self._insert()
        self.audit.append(edit)
        if edit == "K":
            self.state = NEXT[self.state, initial]
            self._put(role, text)
        elif edit == "R":
            self.state = TURN_TO[self.state]
            self._put(ROLE[self.state], text)
        if len(self.audit) > 4096:
            self.audit = ["".join(self.audit)]

    def finish(self) -> tuple:
        while END_COST[self.state]:
            self._insert()
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, LONG_MAX)
        return gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _upward(conv_type: pa.DataType, conv_name: str):
    names = [conv_name, *OUT.replace(",", "").split()[::2]]
    types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, now, out = none, None, []

        def flush():
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            at = batch.schema.names.index
            columns = [batch.column(at(n)).to_pylist() for n in ("conv", "gone", "turn", "role", "text", "initial", "fault", "edits", "to_end")]
            for c, gone, *row in zip(*columns, strict=True):
                if conv is none or c != conv:
                    if conv is not none:
                        out.append((conv, *now.finish()))
                    conv, now = c, _Walk()
                if not gone:
                    now.row(*row)
            if out:
                yield flush()
                out.clear()
        if conv is not none:
            out.append((conv, *now.finish()))
            yield flush()

    return walk


def repair_conversations(rows: DataFrame, conv_name: str = "conv_id") -> DataFrame:
    """One row per conversation of ``damaged`` or ``undamaged``: faults, cost, edits, digest of the repaired text."""
    spark = rows.sparkSession
    small_batches(spark)
    dealt = rows.repartition("conv")
    order = ["turn", "was_role", "was_text", "copy"]  # nulls first, as Spark sorts upwards
    # Dropped rows are no rows: they never make another one a duplicate.
    seen = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy(*order))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(*order, "seen"))
    marked = dealt.withColumn("seen", seen).select(
        "conv", "gone", "turn", "role", "text", F.left("role", F.lit(1)).alias("initial"), first_fault(F.col("text"), F.col("seen") > 1).alias("fault"), place.alias("place")
    )
    down = marked.sortWithinPartitions("conv", F.col("place").desc())
    up = down.mapInArrow(_downward, _with(down, "edits int, to_end long")).sortWithinPartitions("conv", "place")
    conv_type = rows.schema["conv"].dataType
    return up.mapInArrow(_upward(to_arrow_type(conv_type), conv_name), f"`{conv_name}` {conv_type.simpleString()}, {OUT}")


def _with(df: DataFrame, more: str) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])
