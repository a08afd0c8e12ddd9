"""Repair of conversation structure: the cheapest edits that give ``system? (user assistant)+``, by run-length dynamic programming.

A conversation is a string of symbols (role initial and fault). Equal consecutive symbols are one
run; a run of length L advances the cost vector through the binary powers of its symbol's min-plus
transition, which are kept. The choices are then unrolled from the front, a stretch of a run at a time.
Rows reach a task as a stream sorted by conversation: first all symbols, then all texts. So a
task holds the symbols and the audit of one conversation, but never its texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The bytes that count as white space.
SPACE = " \t\n\x0b\x0c\r"
#: Costs of deleting, inserting and giving another role, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after a system row, after a user row, after an assistant row; the first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
#: The one role that an inserted or re-roled row can take from each state, and where it leads.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("user", "user", "assistant", "user")
FAR = 1 << 60
#: Runs between kept cost vectors, and rows of a run that are unrolled at once.
KEPT_RUNS, STRETCH = 256, 1024


def symbol_of(blank_or_repeated: bool, initial: str, truncated: bool) -> int:
    """0: has to be deleted; else 1 + 2 * (place of the initial in ``sua`` or 3) + truncated."""
    return 0 if blank_or_repeated else 1 + 2 * ("sua".find(initial) if initial in ("s", "u", "a") else 3) + truncated


def kept_state(symbol: int, state: int) -> int | None:
    """Where keeping a row as it is leads, if it may be kept there."""
    kind = (symbol - 1) // 2
    if kind == 0:
        return SYSTEM if state == START else None
    if kind == 1:
        return USER if state != USER else None
    return ASSISTANT if kind == 2 and state == USER else None


def compose(a, b):
    """Min-plus product."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def advance(matrix, ahead):
    """Costs before a step from the costs ``ahead`` of it."""
    a, b, c, d = ahead
    return tuple([min(w + a, x + b, y + c, z + d) for w, x, y, z in matrix])


# Any number of inserted rows; more than two in a row lead nowhere new.
INSERTED = tuple(tuple(0 if i == j else min([n * INSERT for n, k in ((1, NEXT[i]), (2, NEXT[NEXT[i]])) if k == j], default=FAR) for j in range(4)) for i in range(4))
AT_END = tuple(min(INSERTED[i][j] for j in FINAL) for i in range(4))


class Transitions:
    """Min-plus transitions of each symbol and their powers of two, each computed once."""

    def __init__(self):
        self.powers: dict[int, list] = {}

    def step(self, symbol: int):
        rows = []
        for state in range(4):
            row = [FAR] * 4
            row[state] = DELETE
            if symbol:
                cost = TRUNCATED * ((symbol - 1) % 2)
                kept = kept_state(symbol, state)
                if kept is not None:
                    row[kept] = min(row[kept], cost)
                row[NEXT[state]] = min(row[NEXT[state]], cost + REROLE)
            rows.append(tuple(row))
        return compose(INSERTED, tuple(rows))

    def back(self, symbol: int, times: int, ahead):
        """The costs ``times`` rows of a symbol earlier."""
        held = self.powers.get(symbol)
        if held is None:
            held = self.powers[symbol] = [self.step(symbol)]
        number = 0
        while times:
            if number == len(held):
                held.append(compose(held[-1], held[-1]))
            if times & 1:
                ahead = advance(held[number], ahead)
            times >>= 1
            number += 1
        return ahead


class Conversation:
    """Symbols of one conversation as runs, its counts, and the cheapest edits."""

    def __init__(self, transitions: Transitions):
        self.transitions = transitions
        self.symbols, self.lengths = bytearray(), array("q")
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = None
        self.turns = 0
        self.before = None

    def add(self, turn, role: str, mark: bytes, blank: bool, seen: bool, truncated: bool) -> None:
        """The next row in order; ``mark`` tells texts apart, ``seen`` says that the same row came at an earlier turn."""
        initial = role[:1]
        repeated = not blank and (seen or self.before == (turn, role, mark))
        if self.before is None or self.before[0] != turn:
            if turn is not None:
                self.turns += 1
                self.low = turn if self.low is None else self.low
                self.high = turn
        if self.before is not None:
            self.illegal += self.before[1][:1] + initial not in ("su", "ua", "au")
        self.before = (turn, role, mark)
        self.blank += blank
        self.duplicate += repeated
        self.truncated += truncated and not blank and not repeated
        symbol = symbol_of(blank or repeated, initial, truncated)
        if self.symbols and self.symbols[-1] == symbol:
            self.lengths[-1] += 1
        else:
            self.symbols.append(symbol)
            self.lengths.append(1)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def edits(self) -> tuple[int, bytearray]:
        """Least cost, and of the edits of that cost the initials that come first in ASCII order."""
        runs, back = len(self.symbols), self.transitions.back
        ahead, kept = AT_END, {}
        for run in range(runs - 1, -1, -1):
            if (run + 1) % KEPT_RUNS == 0 or run == runs - 1:
                kept[run] = ahead  # costs after this run
            ahead = back(self.symbols[run], self.lengths[run], ahead)
        cost, state, audit = ahead[START], START, bytearray()
        for first in range(0, runs, KEPT_RUNS):
            last = min(first + KEPT_RUNS, runs) - 1
            after = {last: kept[last]}
            for run in range(last, first, -1):
                after[run - 1] = back(self.symbols[run], self.lengths[run], after[run])
            for run in range(first, last + 1):
                symbol, left = self.symbols[run], self.lengths[run]
                while left:
                    size = min(left, STRETCH)
                    left -= size
                    costs = [back(symbol, left, after[run])]
                    for _ in range(size):
                        costs.append(back(symbol, 1, costs[-1]))
                    for at in range(size, 0, -1):
                        state = self._choose(symbol, state, costs[at], costs[at - 1], audit)
        while state not in FINAL:
            audit += b"I"
            state = NEXT[state]
        return cost, audit

    @staticmethod
    def _choose(symbol: int, state: int, now, ahead, audit: bytearray) -> int:
        """The edits up to and with that of one row: of the cheapest the least initial first, D before I before K before R."""
        while True:
            if DELETE + ahead[state] == now[state]:
                audit += b"D"
                return state
            if INSERT + now[NEXT[state]] == now[state]:
                audit += b"I"
                state = NEXT[state]
                continue
            kept = kept_state(symbol, state) if symbol else None
            if kept is not None and TRUNCATED * ((symbol - 1) % 2) + ahead[kept] == now[state]:
                audit += b"K"
                return kept
            audit += b"R"
            return NEXT[state]


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damage(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20.

    Nulls of conv_id and turn are one space in that key, nulls of role and text become one
    space. 0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes its role user.
    """
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).cast("int")
    marked = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _ordinal(turn: Column) -> Column:
    """Turns in order, nulls first, without a null."""
    return F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"))


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Repaired rows and a summary of every conversation of (conv_id, turn, role, text).

    Returns conv_id, position (from 0; null in the summary row, which follows the rows of its conversation), edit
    (K kept, R given another role, I inserted), role, text and summary: struct of gaps, blank, duplicate,
    truncated, illegal, cost and audit. A stream: rows of a conversation are together and in order.

    Rows go by turn, nulls first, then by role, then by the SHA-256 of the text. Null roles and texts are one space. A null
    conv_id is a conversation like any other. Each row counts for its first fault: blank, duplicate (same role
    and text in an earlier row), truncated (last character that is not white space not one of ``.!?``). A role counts by its first
    character; one that is not s, u or a, or an empty role, cannot be kept. ``conversations`` (conv_id) names those to
    return, also such as have no rows: zeros and an empty audit; by default those of ``turns``. Other columns are not looked at;
    empty tables give no rows. A conversation is one task's stream; its symbols and audit (about ten bytes a row at
    most) are held, its texts are not.
    """
    filled = lambda name: F.coalesce(F.col(name), F.lit(" "))
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = (turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"))
            .withColumns({"mark": F.unhex(F.sha2("text", 256)), "blank": body == "", "truncated": ~F.right(body, F.lit(1)).isin(".", "!", "?")}))
    # First turns of rows that come at several turns: counted before any shuffle, so a row repeated very often is one.
    place = _ordinal(F.col("turn"))
    several = (rows.where("not blank").groupBy("conv_id", "role", "mark").agg(F.min(place).alias("first"), F.max(place).alias("last"))
               .where("first <> last").select(F.col("conv_id").alias("of"), F.col("role").alias("as"), F.col("mark").alias("saying"), "first"))
    narrow = rows.drop("text")
    met = narrow["conv_id"].eqNullSafe(several["of"]) & (narrow["role"] == several["as"]) & (narrow["mark"] == several["saying"])
    narrow = narrow.join(several, met, "left").withColumn("seen", F.coalesce(~F.col("blank") & (_ordinal(F.col("turn")) > F.col("first")), F.lit(False)))
    names = ["conv_id", "step", "turn", "role", "mark", "blank", "seen", "truncated"]
    told = (conversations if conversations is not None else turns).select("conv_id").distinct().withColumn("step", F.lit(0))
    stream = (told.unionByName(narrow.withColumn("step", F.lit(1)).select(*names), allowMissingColumns=True)
              .unionByName(rows.withColumn("step", F.lit(2)).select("conv_id", "step", "turn", "role", "mark", "text"), allowMissingColumns=True))
    stream = stream.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "step", F.col("turn").asc_nulls_first(), "role", "mark").select(*names, "text")
    schema = (StructType().add(turns.schema["conv_id"]).add("position", "long").add("edit", "string").add("role", "string").add("text", "string")
              .add("summary", StructType.fromDDL(SUMMARY)))
    return stream.mapInArrow(_repaired(schema), schema)


def _repaired(schema: StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)
    fields = [f.name for f in schema["summary"].dataType.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transitions = Transitions()
        current, talk, edits, summary = (), None, None, None
        out: list[tuple] = []
        at = position = 0
        state = START

        def settle():
            """The edits, once all symbols are known."""
            nonlocal edits, summary, at, position, state
            cost, edits = talk.edits()
            summary = dict(zip(fields, (talk.gaps(), talk.blank, talk.duplicate, talk.truncated, talk.illegal, cost, edits.decode())))
            at = position = 0
            state = START

        def emit(edit, role, text):
            nonlocal position
            out.append((current[0], position, edit, role, text, None))
            position += 1

        def inserted():
            nonlocal at, state
            while at < len(edits) and edits[at] == 73:  # I
                emit("I", ROLES[state], "")
                state = NEXT[state]
                at += 1

        def close():
            if current:
                if edits is None:
                    settle()
                inserted()
                out.append((current[0], None, None, None, None, summary))

        def flush():
            nonlocal out
            columns = list(zip(*out)) or [()] * len(shape)
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

        for batch in batches:
            for conv_id, step, turn, role, mark, blank, seen, truncated, text in zip(*[c.to_pylist() for c in batch.columns]):
                if current != (conv_id,):
                    close()
                    current, talk, edits = (conv_id,), Conversation(transitions), None
                if step == 1:
                    talk.add(turn, role, mark, blank, seen, truncated)
                elif step == 2:
                    if edits is None:
                        settle()
                    inserted()
                    edit = edits[at]
                    at += 1
                    if edit == 75:  # K
                        emit("K", role, text)
                        state = SYSTEM if role[:1] == "s" else NEXT[state]
                    elif edit == 82:  # R
                        emit("R", ROLES[state], text)
                        state = NEXT[state]
                if len(out) >= 1024:
                    yield flush()
            yield flush()
        close()
        yield flush()

    return run


def digests(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of what ``repair`` streams: its summary and the SHA-256 of its rows as ``role:text`` lines."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType().add(repaired.schema["conv_id"])
    for field in repaired.schema["summary"].dataType.fields:
        schema = schema.add(field)
    schema = schema.add("repaired_sha256", "string")
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, rows = hashlib.sha256(), 0
        for batch in batches:
            done = []
            for conv_id, position, role, text, summary in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "position", "role", "text", "summary")]):
                if position is not None:
                    hasher.update(f"{chr(10) if rows else ''}{role}:{text}".encode())
                    rows += 1
                else:
                    done.append({"conv_id": conv_id, **summary, "repaired_sha256": hasher.hexdigest()})
                    hasher, rows = hashlib.sha256(), 0
            yield pa.RecordBatch.from_pylist(done, schema=shape)

    return repaired.select("conv_id", "position", "role", "text", "summary").mapInArrow(run, schema)


def _states_sql() -> str:
    """SQL of the best (cost, audit, lines) from each state before a row, from those after it (v0 to v3) and the row's columns."""
    def with_edit(initial: str, cost: str, line: str, state: int) -> str:
        lines = f"list_prepend({line}, v{state}.o)" if line else f"v{state}.o"
        return f"struct_pack(c := v{state}.c + {cost}, a := '{initial}' || v{state}.a, o := {lines})"

    out = []
    for state in range(4):
        options = [f"[{with_edit('D', str(DELETE), '', state)}]"]
        for kind, initial in enumerate("sua"):
            kept = kept_state(1 + 2 * kind, state)
            if kept is not None:
                options.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN [{with_edit('K', 't', 'line', kept)}] ELSE [] END")
        rerole = with_edit("R", f"{REROLE} + t", f"'{ROLES[state]}:' || text", NEXT[state])
        options.append(f"CASE WHEN NOT gone THEN [{rerole}] ELSE [] END")
        out.append(f"list_sort(list_concat({', '.join(options)}))[1] AS w{state}")
    return ", ".join(out)


def _inserts_sql() -> str:
    """SQL of the best from each state when rows may be inserted first, from w0 to w3."""
    def inserted(state: int, after: str) -> str:
        return f"struct_pack(c := {after}.c + {INSERT}, a := 'I' || {after}.a, o := list_prepend('{ROLES[state]}:', {after}.o))"

    best = lambda *options: f"list_sort([{', '.join(options)}])[1]"
    v2, v3 = best("w2", inserted(USER, "w3")), best("w3", inserted(ASSISTANT, "w2"))
    return f"{best('w0', inserted(START, 'n2'))} AS v0, {best('w1', inserted(SYSTEM, 'n2'))} AS v1, n2 AS v2, n3 AS v3", f"{v2} AS n2, {v3} AS n3"


def sql() -> str:
    """The summaries and digests of damaged conversations in SQL, row after row from the last one."""
    outer, inner = _inserts_sql()
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    end = "struct_pack(c := {}, a := '{}', o := {}::VARCHAR[])"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
fates AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda x: CAST(unicode(x) AS BIGINT))),
         lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS fate FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM fates WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos, rtrim(text, {space}) AS body FROM damaged),
judged AS (
  SELECT *, body = '' AS blank, right(body, 1) NOT IN ('.', '!', '?') AS cut,
         pos > min(pos) OVER (PARTITION BY conv_id, role, text) AS again,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prior FROM placed),
counted AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated,
         count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS rows FROM judged GROUP BY conv_id),
best AS (
  SELECT conv_id, rows AS pos, {end.format(0, '', '[]')} AS v0, {end.format(2 * INSERT, 'II', "['user:', 'assistant:']")} AS v1,
         {end.format(INSERT, 'I', "['assistant:']")} AS v2, {end.format(0, '', '[]')} AS v3 FROM counted
  UNION ALL
  SELECT conv_id, pos, {outer} FROM (SELECT *, {inner} FROM (
    SELECT conv_id, pos, {_states_sql()} FROM (
      SELECT b.conv_id, b.pos - 1 AS pos, v0, v1, v2, v3, blank OR again AS gone, CAST(cut AS INTEGER) AS t, initial, text, role || ':' || text AS line
      FROM best b JOIN judged j ON b.conv_id IS NOT DISTINCT FROM j.conv_id AND b.pos = j.pos))))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(v0.c, 0) AS BIGINT) AS cost, coalesce(v0.a, '') AS audit,
       sha256(coalesce(array_to_string(v0.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.pos = 0
"""
