"""Conversation structure repair by cost layers in machine words.

Roles must read (s?(ua)+)?; the grammar's states are 0 at the start, 1 after s, 2 after u, 3 after a. As in Wu and Manber's search with
errors, each cost has a bitset of states, and an edit carries the states of one layer to a dearer one. Here a turn's bitset of
layer c holds the states from which the rest of the conversation can be repaired at that cost. Costs of the
states of a turn differ by at most 12 (two inserts bring any state to state 3, which never costs over 2 more than another), so 16 layers of
4 bits above a running base are all that counts: one 64-bit word a turn, in which an edit of cost k is a shift by 4 k bits.
The lowest layer with the state at the first turn is the cost; going down the turns, the first edit in ASCII order whose word
holds the state in the right layer gives the least audit.

Conversations are taken in segments of SEGMENT turns. A longer one has each segment's costs between entry and exit states computed side by
side; these few numbers are folded per conversation, and give each segment the word it ends with and the state it is entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from .ranking import ranked
from .store import leaving, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Turns of a segment.
SEGMENT = 4096
LAYERS = 0xFFFF_FFFF_FFFF_FFFF
ONES = 0x1111_1111_1111_1111  # one state in all layers
ROLES = ("user", "assistant")
#: State after a role's initial, by state; missing where the grammar doesn't allow it.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an edit can give in each state, and the state after it.
GIVEN = tuple(next((ROLES.index(r), n[r[0]]) for r in ROLES if r[0] in n) for n in NEXT)
#: Least cost by state after the last turn: inserts up to an accepting state.
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 40


def initial_states(word: int, initial: str) -> int:
    """The states from which a row of that initial leads into the word's states, layer by layer."""
    out = 0
    for s, n in enumerate(NEXT):
        if initial in n:
            out |= ((word >> n[initial]) & ONES) << s
    return out


def given_states(word: int) -> int:
    """The same for a role that an edit gives: any state has one."""
    to_user, to_assistant = (word >> 2) & ONES, (word >> 3) & ONES
    return to_user * 0b1011 | to_assistant << 2


def with_inserts(word: int) -> int:
    for _ in range(2):
        word |= given_states(word) << 4 * INSERT & LAYERS
    return word


def before(word: int, initial: str, fault: int) -> int:
    """The word of the turns from this row on, from the word of those after it."""
    out = word << 4 * DELETE
    if fault not in (BLANK, DUPLICATE):
        more = 4 * TRUNCATED * (fault == CUT)
        out |= initial_states(word, initial) << more | given_states(word) << more + 4 * REROLE
    return with_inserts(out & LAYERS)


def lowered(word: int, base: int) -> tuple[int, int]:
    while word and not word & 15:
        word, base = word >> 4, base + 1
    return word, base


def packed(costs) -> tuple[int, int]:
    """(word, base) of the costs of the four states; those over 15 above the least never count."""
    base = min(costs)
    return sum(1 << 4 * (c - base) + s for s, c in enumerate(costs) if c - base < 16), base


def cost_of(word: int, base: int, state: int) -> int:
    at = (word >> state) & ONES
    return base + ((at & -at).bit_length() - 1) // 4 if at else NEVER


def layers(rows: list[tuple[str, int]], end) -> list[tuple[int, int]]:
    """(word, base) at each turn and after the last, for rows (initial, fault) and the costs of the states after them."""
    word, base = packed(end)
    out = [(with_inserts(word), base)]
    for initial, fault in reversed(rows):
        out.append(lowered(before(out[-1][0], initial, fault), out[-1][1]))
    return out[::-1]


def trace(rows: list[tuple[str, int]], at: list[tuple[int, int]], state: int) -> tuple[list[tuple[str, int | None]], int]:
    """(edits, state after the rows): for each row its letters and the role it is given (None: its own), cheapest and least.

    Letters of inserts stand before the letter of the row they come before.
    """
    out = []
    for k, (initial, fault) in enumerate(rows):
        letters = ""
        left = cost_of(*at[k], state)
        whole = fault not in (BLANK, DUPLICATE)
        more = TRUNCATED * (fault == CUT)
        while True:
            given, after = GIVEN[state]
            if cost_of(*at[k + 1], state) == left - DELETE:
                out.append((letters + "D", None))
                break
            if cost_of(*at[k], after) == left - INSERT:
                letters, left, state = letters + "I", left - INSERT, after
                continue
            own = NEXT[state].get(initial)
            if whole and own is not None and cost_of(*at[k + 1], own) == left - more - KEEP:
                out.append((letters + "K", None))
                state = own
            else:
                out.append((letters + "R", given))
                state = after
            break
    return out, state


def _segment(table: pa.Table) -> tuple[np.ndarray, list[tuple[str, int]]]:
    table = table.sort_by("i")
    return table.column("i").to_numpy(), list(zip(table.column("initial").to_pylist(), table.column("fault").to_pylist(), strict=True))


MATRIX = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("costs", pa.list_(pa.int64()))])


def _costs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The least cost from each entry state to each exit state of a segment, 16 numbers."""
    _, rows = _segment(table)
    by_exit = [layers(rows, [0 if s == e else NEVER for s in range(4)])[0] for e in range(4)]
    flat = [cost_of(*by_exit[e], s) for s in range(4) for e in range(4)]
    return pa.table([[key[0].as_py()], [key[1].as_py()], [flat]], schema=MATRIX)


ENDS = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("ends", pa.list_(pa.int64()))])


def _ends(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """What the states after each segment cost, from the segments' matrices, the last segment first."""
    table = table.sort_by("seg")
    end, out = np.array(END), []
    for m in reversed(table.column("costs").to_pylist()):
        out.append(end.tolist())
        end = (np.array(m).reshape(4, 4) + end).min(axis=1)
    return pa.table([table.column("conv"), table.column("seg"), pa.array(out[::-1], ENDS.field("ends").type)], schema=ENDS)


EXITS = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("exits", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _exits(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The exit state of a segment for each entry state."""
    ends = table.column("ends")[0].as_py()
    _, rows = _segment(table)
    at = layers(rows, ends)
    return pa.table([[key[0].as_py()], [key[1].as_py()], [[trace(rows, at, s)[1] for s in range(4)]], [ends]], schema=EXITS)


BOUNDS = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("ends", pa.list_(pa.int64())), ("entry", pa.int64())])


def _entries(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The state in which each segment is entered."""
    table = table.sort_by("seg")
    entry = [0]
    for exits in table.column("exits").to_pylist():
        entry.append(exits[entry[-1]])
    return pa.table([table.column("conv"), table.column("seg"), table.column("ends"), pa.array(entry[:-1])], schema=BOUNDS)


EDITS = pa.schema([("conv", pa.string()), ("i", pa.int64()), ("letters", pa.string()), ("given", pa.int32()), ("state", pa.int32()), ("tail", pa.int32())])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's letters and given role, the state before it, and the inserts after a conversation's last row; rows come segment by segment."""
    names = ("conv", "seg", "i", "n", "initial", "fault", "ends", "entry")
    flat = (r for rb in batches for r in zip(*(A.column(rb, c).to_pylist() for c in names), strict=True))
    done: list[tuple] = []
    for (conv, _), group in groupby(flat, key=lambda r: r[:2]):
        group = list(group)  # at most a segment
        *_, ends, entry = group[0]
        rows = [r[4:6] for r in group]
        made, state = trace(rows, layers(rows, ends or END), entry or 0)
        s = entry or 0
        for (_, _, i, n, initial, *_), (letters, given) in zip(group, made, strict=True):
            done.append((conv, i, letters, given, s, END[state] // INSERT if i == n - 1 else 0))
            for _ in range(len(letters) - 1):
                s = GIVEN[s][1]
            s = s if letters[-1] == "D" else GIVEN[s][1] if given is not None else NEXT[s][initial]
        if len(done) >= SEGMENT:
            yield A.batch(EDITS, *map(list, zip(*done, strict=True)))
            done = []
    if done:
        yield A.batch(EDITS, *map(list, zip(*done, strict=True)))


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'array<bigint>' if pa.types.is_list(f.type) else {'string': 'string', 'int64': 'bigint', 'int32': 'int'}[str(f.type)]}" for f in schema)


def edits(codes: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, i, letters, given, state, tail) for rows (conv, i, n, initial, fault)."""
    codes = codes.withColumn("seg", F.expr(f"i div {segment}"))
    long = codes.where(F.col("n") > segment)
    costs = materialize(long.groupBy("conv", "seg").applyInArrow(_costs, _ddl(MATRIX)), "segments")
    if costs.isEmpty():
        codes = codes.withColumns({"ends": F.lit(None).cast("array<bigint>"), "entry": F.lit(None).cast("bigint")})
    else:  # a conversation's 16 numbers for each segment meet in one task, its turns don't
        ends = costs.groupBy("conv").applyInArrow(_ends, _ddl(ENDS))
        exits = long.join(ends, ["conv", "seg"]).groupBy("conv", "seg").applyInArrow(_exits, _ddl(EXITS))
        bounds = materialize(exits.groupBy("conv").applyInArrow(_entries, _ddl(BOUNDS)), "bounds")
        codes = codes.join(bounds, ["conv", "seg"], "left")
    return codes.repartition("conv", "seg").sortWithinPartitions("conv", "seg", "i").mapInArrow(_edits, _ddl(EDITS))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after damage by their key's checksum; nulls but those of conv_id and turn are one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(kind == 4, "user").otherwise(filled("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("x")).drop("x")


def _alone() -> Column:
    """A row's fault but for repetition."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1)
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), 0).otherwise(CUT)


REPORT = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Report:
    """Counts, audit and running hash of one conversation whose rows come in order."""

    def __init__(self, conv: str):
        self.conv, self.faults, self.illegal, self.cost = conv, [0] * 4, 0, 0
        self.turns, self.least, self.most, self.last, self.initial = 0, None, None, None, None
        self.audit, self.sha, self.empty = [], hashlib.sha256(), True

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def inserted(self, n: int, state: int) -> int:
        for _ in range(n):
            given, state = GIVEN[state]
            self.line(ROLES[given], "")
        self.cost += n * INSERT
        return state

    def add(self, turn, role, text, fault, letters, given, state, tail) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.last, self.most = self.turns + 1, turn, turn
            self.least = turn if self.least is None else self.least
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.faults[fault] += 1
        state = self.inserted(len(letters) - 1, state)
        if letters[-1] == "D":
            self.cost += DELETE
        else:
            self.cost += TRUNCATED * (fault == CUT) + REROLE * (given is not None)
            self.line(role if given is None else ROLES[given], text)
            state = GIVEN[state][1] if given is not None else NEXT[state][initial]
        self.inserted(tail, state)
        self.audit.append(letters + "I" * tail)

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []
    for rb in batches:
        names = ("conv", "turn", "role", "text", "fault", "letters", "given", "state", "tail")
        for conv, *row in zip(*(A.column(rb, c).to_pylist() for c in names), strict=True):
            if now is None or now.conv != conv:
                if now:
                    done.append(now.row())
                now = _Report(conv)
            now.add(*row)
        if done:
            yield A.batch(REPORT, *map(list, zip(*done, strict=True)))
            done = []
    if now:
        yield A.batch(REPORT, *map(list, zip(now.row(), strict=True)))


def repaired(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The rows (conv, conv_id, i, turn, role, text, fault) of turns in order, with the edits that repair each conversation.

    Rows go by turn, nulls first, then by role and text. A null role or text is one space, which is blank, and a role that is never right.
    Repeated rows are duplicates of the first. Other columns are not read. An empty table gives an empty table.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")
    order = ["turn", "role", "text"]
    rows = ranked(turns.select("conv_id", conv, *order), "conv", order, "turns", cut=["turn", "role", F.substring("text", 1, 64)])
    rows = materialize(rows.withColumn("said", F.sha2(F.col("text"), 256)), "ranked")
    first = rows.groupBy("conv", "role", "said").agg(F.min("i").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    codes = rows.withColumn("alone", _alone()).select("conv", "i", "n", "role", "said", "alone").join(first, ["conv", "role", "said"], "left")
    again = F.coalesce(F.col("i") > F.col("first"), F.lit(False))
    fault = F.when(F.col("alone") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("alone"))
    codes = materialize(codes.select("conv", "i", "n", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")), "codes")
    made = codes.select("conv", "i", "fault").join(edits(codes, segment), ["conv", "i"])
    return rows.drop("said", "n").join(made, ["conv", "i"])


def repair_report(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation that turns, as given, has.

    A conversation's counts, audit and hash come from one pass over its rows in order, which holds no text but the row's own; as
    SHA-256 takes its input in order, a conversation's hash is one task's work. Edges as for repaired().
    """
    with leaving(turns.sparkSession) as kept:
        ids = turns.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
        rows = repaired(damaged(turns), segment).repartition("conv").sortWithinPartitions("conv", "i")
        names = ("conv", "turn", "role", "text", "fault", "letters", "given", "state", "tail")
        reports = materialize(rows.select(*names).mapInArrow(_reports, _ddl(REPORT)), "reports")
        kept.append(reports)
    out = ids.join(reports, "conv", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in REPORT.names[1:7]}
    return out.select("conv_id", *REPORT.names[1:]).withColumns(zero | {
        "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))})
