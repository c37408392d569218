"""Repair of a conversation's turn structure by the cheapest edits, found by divide and conquer in linear space."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: States of the grammar (s?(ua)+)?: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: States in which a conversation may end.
ENDS = (START, ASSISTANT)
#: Where a user or an assistant row leads, by state.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What edits cost, and a kept or reroled row that ends in mid-sentence.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A row's code: its role's initial (one of these or none of them) plus four times its fault.
INITIALS = "sua"
SOUND, CUT, GONE = range(3)
NEVER = 1 << 60


def code_of(initial: str, fault: int) -> int:
    return INITIALS.find(initial) % 4 + 4 * fault if initial else 3 + 4 * fault


def _edits(code: int) -> list[list[tuple[int, str]]]:
    """[from][to]: (cost, audit) of the cheapest edits that pass one row, inserted rows before it included."""
    table = [[(NEVER, "")] * 4 for _ in STATES]
    initial, fault = code % 4, code // 4
    for start in STATES:
        state, inserted = start, 0
        while inserted < 3:  # three insertions lead back to a state already seen
            cost, audit = INSERT * inserted, "I" * inserted
            found = [(state, cost + DELETE, audit + "D")]
            extra = TRUNCATED if fault == CUT else 0
            if fault != GONE:
                found.append((TURN[state], cost + RENAME + extra, audit + "R"))
                kept = {0: SYSTEM if state == START else None, 1: USER if state != USER else None,
                        2: ASSISTANT if state == USER else None}.get(initial)
                if kept is not None:
                    found.append((kept, cost + extra, audit + "K"))
            for to, total, word in found:
                table[start][to] = min(table[start][to], (total, word))
            state, inserted = TURN[state], inserted + 1
    return table


EDITS = [_edits(code) for code in range(12)]
#: Rows to insert behind the last one until a conversation may end, by state.
CLOSING = [0, 2, 1, 0]


def forward(codes: bytes, low: int, high: int, state: int) -> tuple[list[int], list[int]]:
    """By state: the cost of getting there from ``state`` over rows ``low`` to ``high``, and the rank of the least
    audit of that cost among the states' audits.

    Audits over the same rows end with the last row's own edit, so none is a prefix of another: two of them are told
    apart by the states they come from, by rank, and else by the last step.
    """
    cost, rank = [NEVER] * 4, [0] * 4
    cost[state] = 0
    for i in range(low, high):
        step = EDITS[codes[i]]
        best: list[tuple[int, int, str]] = []
        for to in STATES:
            best.append(min((cost[s] + step[s][to][0], rank[s], step[s][to][1]) for s in STATES))
        order = sorted(STATES, key=lambda t: (best[t][1], best[t][2]) if best[t][0] < NEVER else (4, ""))
        cost = [min(best[t][0], NEVER) for t in STATES]
        rank = [order.index(t) for t in STATES]
    return cost, rank


def backward(codes: bytes, low: int, high: int, goal: list[int]) -> list[int]:
    """By state: the cost of rows ``low`` to ``high`` from it, if ``goal`` is what the states cost behind them."""
    cost = goal
    for i in range(high - 1, low - 1, -1):
        step = EDITS[codes[i]]
        cost = [min(NEVER, min(step[s][t][0] + cost[t] for t in STATES)) for s in STATES]
    return cost


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of rows with these codes; the ASCII-least audit of that cost.

    The rows are halved. Forward costs over the first half and backward costs over the second meet at a state between
    them; of the states with the least sum, the one with the least audit before it is crossed. Both halves are then
    solved alike, between states that are known. Beyond the audit itself this takes two vectors of four states a level.
    """
    goal = [INSERT * CLOSING[s] for s in STATES]
    cost, rank = forward(codes, 0, len(codes), START)
    total, _, last = min((cost[s] + goal[s], rank[s], s) for s in STATES)
    audit: list[str] = []
    open_parts = [(0, len(codes), START, last)]
    while open_parts:
        low, high, source, target = open_parts.pop()
        if high - low == 1:
            audit.append(EDITS[codes[low]][source][target][1])
        elif high > low:
            middle = (low + high) // 2
            cost, rank = forward(codes, low, middle, source)
            rest = backward(codes, middle, high, [0 if s == target else NEVER for s in STATES])
            _, _, crossing = min((cost[s] + rest[s], rank[s], s) for s in STATES)
            open_parts += [(middle, high, crossing, target), (low, middle, source, crossing)]
    return total, "".join(audit) + "I" * CLOSING[last]


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(_conv, _turn, _role, _text) of the rows of ``turns`` after damage.

    The checksum of ``conv:turn`` modulo 20 decides: 0 drops a row, 1 empties its text, 2 takes all of ``[.!?]`` out of
    it, 3 repeats the row, 4 makes its role user; other rows stay. A null counts as one space in the checksum, as role
    and as text.
    """
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    said = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    copies = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.where(fate != 0).select(
        conv.alias("_conv"), turn.alias("_turn"), F.when(fate == 4, "user").otherwise(space(role)).alias("_role"),
        said.alias("_text"), F.explode(copies).alias("_copy")).drop("_copy")


#: What the first pass finds of a conversation.
FACTS = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long",
         "audit": "string"}
WORD = r"[^\x20\x09-\x0D]"


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with _fault, dealt out by conversation and in order in each task: by turn, role and text, nulls first."""
    dealt = rows.repartition("_conv")
    # The same partitions serve the window: it only sorts.
    same = Window.partitionBy("_conv", "_role", "_text").orderBy(F.col("_turn").asc_nulls_first())
    again = F.row_number().over(same) > 1
    last = F.regexp_extract("_text", f"({WORD})[\\x20\\x09-\\x0D]*\\z", 1)
    marked = dealt.withColumn("_again", again).withColumn(
        "_fault", F.when(last == "", "blank").when(F.col("_again"), "duplicate")
        .when(last.rlike("[.!?]"), "").otherwise("truncated"))
    return marked.sortWithinPartitions(
        F.col("_conv").asc_nulls_first(), F.col("_turn").asc_nulls_first(), "_role", "_text", "_again")


def repair_conversations(
    rows: DataFrame, conv_col: str = "_conv", turn_col: str = "_turn", role_col: str = "_role", text_col: str = "_text",
) -> DataFrame:
    """One row a conversation: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, n_repaired,
    repaired_sha256), for the cheapest edits that bring its roles' initials into the form ``(s?(ua)+)?``.

    A row's first fault counts: blank (no character but white space), duplicate (role and text seen earlier),
    truncated (its last such character is none of ``.!?``). Keeping a row costs nothing, renaming its role to user or
    assistant 2, deleting it 3 (a must for blank ones and duplicates), inserting an empty user or assistant row 2; a
    truncated row that stays adds 1. ``audit`` lists the edits' initials in order and is the ASCII-least of that cost.
    ``illegal`` counts neighbours other than system-user, user-assistant, assistant-user, and ``gaps`` turn numbers
    that are missing. ``repaired_sha256`` is the digest of the repaired rows as ``role:text``, joined by line feeds.

    Rows stream through two sorted passes, dealt out by conversation. The first sees a role's initial, a fault and a
    turn of each row, and holds one byte a row of the conversation it is at; the second hashes texts one by one under
    the audit found. So no text is ever gathered, however long a conversation is, and a null conversation id, which is
    a conversation like any other, may hold any number of rows. Only a conversation's audit and the bytes it comes
    from must fit a task, as the result has it in one field.

    Null roles and texts count as one space here too (so a null text is blank). Rows with the same turn follow each
    other by role and text; rows equal in both are duplicates. A role with another initial can only be renamed or
    deleted. An empty table gives an empty result; extra columns are not read, whatever their names.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    rows = rows.select(
        F.col(f"`{conv_col}`").alias("_conv"), F.col(f"`{turn_col}`").cast("long").alias("_turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("_text"))
    facts = f"_conv {kind}, " + ", ".join(f"{c} {t}" for c, t in FACTS.items())
    results = facts + ", n_repaired long, repaired_sha256 string"
    found, made = (to_arrow_schema(StructType.fromDDL(ddl)) for ddl in (facts, results))
    audits = _ordered(rows).select(
        "_conv", "_turn", F.substring("_role", 1, 1).alias("_initial"), "_fault").mapInArrow(
        lambda batches: _audit(batches, found), facts)
    # A conversation's audit goes ahead of its rows.
    lead = audits.select(
        "_conv", F.struct(*FACTS).alias("_facts"), F.lit(None).cast("long").alias("_turn"), F.lit("").alias("_role"),
        F.lit("").alias("_text"))
    both = lead.unionByName(rows.withColumn("_facts", F.lit(None).cast(lead.schema["_facts"].dataType)))
    led = both.repartition("_conv").sortWithinPartitions(
        F.col("_conv").asc_nulls_first(), F.col("_facts").isNull(), F.col("_turn").asc_nulls_first(), "_role", "_text")
    return led.select("_conv", "_facts", "_role", "_text").mapInArrow(
        lambda batches: _rebuild(batches, made), results).withColumnRenamed("_conv", conv_col)


def conversations_of(batches: Iterator[pa.RecordBatch]):
    """(number of the conversation, conversation id, row) of sorted batches, row by row."""
    number, held = 0, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if held is None or row[0] != held[0]:
                number, held = number + 1, (row[0],)
            yield number, row


def _audit(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    at, conv, out = 0, None, _Rows(schema)

    def close() -> tuple:
        cost, audit = cheapest_edits(bytes(codes))
        gaps = last - first + 1 - distinct if distinct else 0
        return conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit

    for number, (key, turn, initial, fault) in conversations_of(batches):
        if number != at:
            if at:
                yield from out.add(close())
            at, conv, codes, illegal, before = number, key, bytearray(), 0, None
            faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
            first = last = None
            distinct = 0
        faults[fault] += 1
        codes.append(code_of(initial, {"": SOUND, "truncated": CUT}.get(fault, GONE)))
        illegal += before is not None and before + initial not in ("su", "ua", "au")
        before = initial
        if turn is not None and turn != last:
            first, last, distinct = turn if first is None else first, turn, distinct + 1
    if at:
        yield from out.add(close())
    yield from out.rest()


def _rebuild(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    at, out = 0, _Rows(schema)

    def write(role: str, text: str) -> None:
        nonlocal rows
        digest.update((("\n" if rows else "") + f"{role}:{text}").encode())
        rows += 1

    def insert() -> None:
        """Inserted rows up to the next edit of a stored row."""
        nonlocal state, place
        while place < len(audit) and audit[place] == "I":
            state, place = TURN[state], place + 1
            write(ROLE[state], "")

    for number, (key, given, role, text) in conversations_of(batches):
        if number != at:
            if at:
                insert()
                yield from out.add((conv, *facts.values(), rows, digest.hexdigest()))
            at, conv, facts, place, state, rows, digest = number, key, given, 0, START, 0, hashlib.sha256()
            audit = facts["audit"]
            continue
        insert()
        edit, place = audit[place], place + 1
        if edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            write(role, text)
        elif edit == "R":
            state = TURN[state]
            write(ROLE[state], text)
    if at:
        insert()
        yield from out.add((conv, *facts.values(), rows, digest.hexdigest()))
    yield from out.rest()


class _Rows:
    """Collects rows into batches of a schema."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows = schema, []

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= 1024:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns, self.rows = zip(*self.rows), []
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
