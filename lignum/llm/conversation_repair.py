"""Repair of the structure of conversations by a streamed shortest edit.

Every row of a conversation, in order of its turn, is kept (free), given another
role (3) or deleted (4), and turns without text may be inserted anywhere (3), so
that the initials of the roles become ``(s?(ua)+)?``: an optional system turn, then
user and assistant by turns, or nothing.  Blank and repeated rows must be deleted; a
truncated row that stays costs 3 more.  Of the cheapest edits the one whose
initials (Delete, Insert, Keep, Rerole) are least in ASCII is taken.

Method: what has been emitted so far is one of four states (nothing, system, user,
assistant), and each edit has exactly one successor, so four costs per row are all
that dynamic programming needs.

1. ``backpointers``: rows without their texts are repartitioned by conversation and
   sorted by turn, last turn first.  A streamed pass carries the four costs from row
   to row and from Arrow batch to Arrow batch and notes the best edit of every state
   in one byte a row.  The bytes are spilled as rows of at most ``BLOCK`` bytes to a
   table in the shared folder, so a conversation of any length takes little memory.
   Faults, gaps and illegal neighbours are counted in the same pass.
2. ``edits``: texts and blocks are repartitioned by conversation and sorted, first turn
   first.  A streamed pass follows the bytes from the empty state and emits every edit.
3. ``digests`` streams over the edits where they are, without a shuffle.

Whether a row's role and text came before is decided by Spark, not by a set in a
task: the first turn of each (conversation, hash of role and text) is a map-side
combined aggregate, and is sorted into the stream just before the row it marks.

One conversation may hold a third of all rows.  Its rows meet in one task, since the
digest of a conversation is one hash over its whole text in order; that task streams
and holds a batch of rows, a block, and the audit (a byte a row, part of the result).

Cases: turns sort with null first, rows of one turn by the md5 of role and text.  A
null role or text counts as one space.  A role counts by its first character; one that
is neither s, u nor a can't be kept (an empty role has none).  A null conversation is a
conversation.  Rows alike in every column are repeated rows.  A conversation without rows
comes with zeros, an empty audit and the hash of the empty string if it is named by
``present``.  Gaps beyond the range of long are cut to it.  An empty table gives an empty
result.  Columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lignum.llm.common import WHITESPACE, stored
from lignum.ship import ensure_shipped

BLOCK = 1 << 16  # backpointers of a spilled row, one byte each

# Costs of edits.
RETURNED, DELETED, INSERTED, CUT = 3, 4, 3, 3
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)

# States: 0 nothing emitted, 1 system, 2 user, 3 assistant.  The initial a state can take next by
# an inserted or changed turn, and the state after it.
NEXT_ROLE = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
# a kept row: (state, initial) -> state
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 6, 3, 0)   # cheapest way to a legal end: inserted turns
CLEAN, GONE, SHORT = range(3)
LEGAL = {"su", "ua", "au"}
LONG = (-(1 << 63), (1 << 63) - 1)


def best_edits(after: tuple[int, ...], initial: str, kind: int) -> tuple[tuple[int, ...], int]:
    """Costs of the four states before a row, given those after it, and the row's byte:
    two bits a state, the least letter among the cheapest edits."""
    more = CUT if kind == SHORT else 0
    options: list[dict[int, int]] = []
    for s in range(4):
        cost = {DELETE: DELETED + after[s]}
        if kind != GONE:
            if (s, initial) in KEPT:
                cost[KEEP] = more + after[KEPT[s, initial]]
            cost[REROLE] = RETURNED + more + after[AFTER[s]]
        options.append(cost)
    least = [min(c.values()) for c in options]
    # two inserted turns lead from any state to any that insertion can reach
    for _ in range(2):
        least = [min(least[s], INSERTED + least[AFTER[s]]) for s in range(4)]
    byte = 0
    for s in range(4):
        options[s][INSERT] = INSERTED + least[AFTER[s]]
        byte |= min(e for e, c in options[s].items() if c == least[s]) << 2 * s
    return tuple(least), byte


class Steps:
    """``best_edits`` on costs relative to their least; only few such vectors occur, so each is worked out once."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[tuple[int, ...], int, int]] = {}

    def step(self, costs: tuple[int, ...], initial: str, kind: int) -> tuple[tuple[int, ...], int, int]:
        key = (costs, initial, kind)
        got = self.known.get(key)
        if got is None:
            before, byte = best_edits(costs, initial, kind)
            low = min(before)
            got = self.known[key] = (tuple(c - low for c in before), low, byte)
        return got


def fault_columns(role: Column, text: Column) -> dict[str, Column]:
    """``initial`` (s, u, a or empty), ``kind`` of a row before repeats are known, and ``h`` of role and text."""
    first = F.substring(role, 1, 1)
    end = F.right(F.rtrim(text, F.lit(WHITESPACE)), F.lit(1))
    return {"initial": F.when(first.isin("s", "u", "a"), first).otherwise(""),
            "kind": F.when(end == "", GONE).when(end.isin(".", "!", "?"), CLEAN).otherwise(SHORT),
            "h": F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))}


def _source(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                       F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"))


class Reader:
    """State of the backward pass over one conversation."""

    def __init__(self, conv: object) -> None:
        self.conv, self.costs, self.base = conv, tuple(c - min(ENDS) for c in ENDS), min(ENDS)
        self.codes, self.block, self.key = bytearray(), 0, (None, None)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.seen = None
        self.follower: str | None = None
        self.mark: tuple | None = None
        self.open: tuple | None = None   # row whose being a repeat depends on the next one

    def row(self, key: tuple, initial: str, kind: int) -> None:
        if self.open is not None:
            self.settle(repeated=self.open[0] == key or self.mark != self.open[0])
        self.open = (key, initial, kind)

    def settle(self, repeated: bool) -> None:
        assert self.open is not None
        key, initial, kind = self.open
        self.open = None
        if kind == GONE:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
            kind = GONE
        elif kind == SHORT:
            self.truncated += 1
        if self.follower is not None:
            self.illegal += initial + self.follower not in LEGAL
        self.follower = initial
        turn = key[0]
        if turn is not None:
            if turn != self.seen:
                self.turns += 1
                self.seen = turn
            self.low = turn if self.low is None else min(self.low, turn)
            self.high = turn if self.high is None else max(self.high, turn)
        self.costs, more, byte = STEPS.step(self.costs, initial, kind)
        self.base += more
        self.codes.append(byte)
        self.key = key

    def close(self) -> None:
        if self.open is not None:
            self.settle(repeated=self.mark != self.open[0])

    def spilled(self) -> dict:
        """The codes so far, first turn first, under the key of the first row they are of."""
        out = {"conv": self.conv, "turn": self.key[0], "h": self.key[1], "block": self.block,
               "codes": bytes(self.codes[::-1])}
        self.codes, self.block = bytearray(), self.block + 1
        return out

    def summary(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": max(LONG[0], min(LONG[1], gaps)), "blank": self.blank, "duplicate": self.duplicate,
                "truncated": self.truncated, "illegal": self.illegal, "cost": self.base + self.costs[0]}


STEPS = Steps()
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
ROW, MARK, PRESENT = 1, 0, 2


def read_backwards(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The streamed pass over ``conv, turn, h, what, initial, kind``, last turn first."""
    now: Reader | None = None
    out: list[dict] = []
    schema: pa.Schema | None = None

    def done(reader: Reader) -> None:
        reader.close()
        out.append(reader.spilled() | reader.summary())

    for batch in batches:
        schema = pa.schema([*batch.schema][:3] + [("block", pa.int64()), ("codes", pa.binary())]
                           + [(c, pa.int64()) for c in COUNTS])
        for conv, turn, h, what, initial, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    done(now)
                now = Reader(conv)
            if what == MARK:
                if now.open is not None:   # a row of a later turn waits for its mark no longer
                    now.settle(repeated=now.mark != now.open[0])
                now.mark = (turn, h)
            elif what == ROW:
                now.row((turn, h), initial, kind)
                if len(now.codes) >= block:
                    out.append(now.spilled())
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if now is not None:
        done(now)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def backpointers(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 present: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Spilled blocks ``conv, turn, h, block, codes``; the last one of a conversation also has its counts."""
    ensure_shipped(rows.sparkSession)
    src = _source(rows, conv, turn, role, text)
    light = src.withColumns(fault_columns(F.col("role"), F.col("text"))).select("conv", "turn", "h", F.lit(ROW).alias("what"), "initial", "kind")
    firsts = light.where(F.col("kind") != GONE).groupBy("conv", "h").agg(
        F.max(F.col("turn").isNull()).alias("null"), F.min("turn").alias("turn"))
    marks = firsts.select("conv", F.when(~F.col("null"), F.col("turn")).alias("turn"), "h", F.lit(MARK).alias("what"),
                          F.lit("").alias("initial"), F.lit(CLEAN).alias("kind"))
    every = light.unionByName(marks)
    if present is not None:
        every = every.unionByName(present.select(
            F.col(f"`{conv}`").alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("h"),
            F.lit(PRESENT).alias("what"), F.lit("").alias("initial"), F.lit(CLEAN).alias("kind")))
    ordered = every.repartition("conv").sortWithinPartitions("conv", F.desc("turn"), F.desc("h"), "what")
    kind = src.schema["conv"].dataType.simpleString()
    ddl = (f"conv {kind}, turn long, h binary, block long, codes binary, " + ", ".join(f"{c} long" for c in COUNTS))
    return stored(ordered.mapInArrow(lambda b: read_backwards(b, block), ddl), "backpointers")


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The streamed pass over ``conv, turn, h, what, block, role, text, codes``, first turn first."""
    conv: object = None
    started, state, step = False, 0, 0
    codes: list[bytes] = []
    at = 0
    out: list[tuple] = []
    held = 0
    kind: pa.DataType = pa.null()

    def emit(edit: int, role: str, text: str) -> None:
        nonlocal step, held
        out.append((conv, step, LETTERS[edit], role, text))
        step += 1
        held += len(text)

    def inserted() -> None:
        nonlocal state
        emit(INSERT, NEXT_ROLE[state], "")
        state = AFTER[state]

    def end() -> None:
        while started and state in (1, 2):
            inserted()

    def batch_of() -> pa.RecordBatch:
        nonlocal held
        held = 0
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                         ["conv", "step", "edit", "role", "text"])
        out.clear()
        return got

    for batch in batches:
        kind = batch.schema.field(0).type
        for c, _t, _h, what, _b, role, text, code in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not started or c != conv:
                end()
                conv, started, state, step, codes, at = c, True, 0, 0, [], 0
            if what == MARK:
                codes.append(code)
                continue
            while at == len(codes[0]):
                codes.pop(0)
                at = 0
            byte = codes[0][at]
            at += 1
            while (edit := byte >> 2 * state & 3) == INSERT:
                inserted()
            if edit == DELETE:
                emit(DELETE, role, text)
            elif edit == KEEP:
                emit(KEEP, role, text)
                state = KEPT[state, role[:1]]
            else:
                emit(REROLE, NEXT_ROLE[state], text)
                state = AFTER[state]
            if len(out) >= 4096 or held >= 1 << 22:
                yield batch_of()
    end()
    if out:
        yield batch_of()


def edits(rows: DataFrame, blocks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """Every edit: ``conv, step, edit, role, text``; without those marked D it is the repaired table.

    A conversation's edits lie in one partition, one after the other.
    """
    src = _source(rows, conv, turn, role, text)
    none = F.lit(None)
    texts = src.select("conv", "turn", fault_columns(F.col("role"), F.col("text"))["h"].alias("h"), F.lit(ROW).alias("what"),
                       F.lit(0).cast("long").alias("block"), "role", "text", none.cast("binary").alias("codes"))
    guide = blocks.where(F.length("codes") > 0).select(
        "conv", "turn", "h", F.lit(MARK).alias("what"), (-F.col("block")).alias("block"),
        none.cast("string").alias("role"), none.cast("string").alias("text"), "codes")
    ordered = texts.unionByName(guide).repartition("conv").sortWithinPartitions("conv", "turn", "h", "what", "block")
    ddl = f"conv {src.schema['conv'].dataType.simpleString()}, step long, edit string, role string, text string"
    return ordered.mapInArrow(follow, ddl)


def digests(steps: DataFrame) -> DataFrame:
    """``conv, audit, repaired_sha256`` of edits as ``edits`` returns them, where they are."""
    ddl = f"conv {steps.schema['conv'].dataType.simpleString()}, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kind: pa.DataType = pa.null()
        now, started, letters, digest, first = None, False, bytearray(), hashlib.sha256(), True

        def close() -> None:
            if started:
                out.append((now, letters.decode(), digest.hexdigest()))

        def rows() -> pa.RecordBatch:
            columns = zip(zip(*out, strict=True), (kind, pa.string(), pa.string()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["conv", "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, edit, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "edit", "role", "text")),
                                           strict=True):
                if not started or c != now:
                    close()
                    now, started, letters, digest, first = c, True, bytearray(), hashlib.sha256(), True
                letters += edit.encode()
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            if len(out) >= 1000:
                yield rows()
                out.clear()
        close()
        if out:
            yield rows()

    return steps.mapInArrow(run, ddl)


def audits(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           present: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: counts of faults, cost, audit and the hash of the repaired conversation."""
    blocks = backpointers(rows, conv, turn, role, text, present, block)
    made = digests(edits(rows, blocks, conv, turn, role, text))
    counts = blocks.where(F.col("cost").isNotNull()).select(F.col("conv").alias("c"), *COUNTS)
    return (counts.join(made, F.col("c").eqNullSafe(F.col("conv")), "left").select(
        F.col("c").alias(conv), *COUNTS, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with seeded damage; a dropped row stays as one whose ``lost`` is true."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    luck = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = (F.when(F.col("luck") == 1, "").when(F.col("luck") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    return (rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), luck.alias("luck"))
            .select("conv_id", "turn", F.when(F.col("luck") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), (F.col("luck") == 0).alias("lost"),
                    F.explode(F.when(F.col("luck") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))
