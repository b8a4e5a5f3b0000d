"""Cheapest repair of conversations to a grammar of roles, by a recursive query over batches of turns.

A repaired conversation is empty or reads: perhaps a system turn, then user and assistant in turn,
ending with the assistant. The automaton has four states (nothing yet, after system, after user,
after assistant); each row is kept, given another role, or deleted, with turns inserted before it
where that helps. For each state only the cheapest edits count, and of equally cheap ones the
least by ASCII.

Rows are dealt out by a hash of the conversation and sorted within it. Each task hands batches of
rows to DuckDB, where one recursive query goes one turn further in every conversation of the batch
at each step and keeps cost and audit of the best edits for each state. A conversation that goes
on in the next batch leaves its four states and one running digest each behind, so a task holds a
batch of rows at a time, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows, and characters of text, that a task hands to one query.
_BATCH_ROWS, _BATCH_CHARS = 8192, 1 << 23
_INITIAL = {0: None, 1: "s", 2: "u", 3: "a"}
#: What an inserted or rerolled turn becomes after each state, and the state behind it.
_NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Insertions that end a conversation in a state that may be the last one.
_CLOSING = {0: 0, 1: 2, 2: 1, 3: 0}


def _moves(keep: int, rerole: int, delete: int, insert: int) -> pa.Table:
    """Every way to take one row: from a state, up to two insertions, then keep (of one initial), rerole or delete."""
    rows = []
    for start in _NEXT:
        state = start
        for n in range(3):
            letters, cost = "I" * n, insert * n
            rows += [(start, end, letters + "K", cost + keep, initial) for (s, initial), end in _KEPT.items() if s == state]
            rows.append((start, _NEXT[state][1], letters + "R", cost + rerole, None))
            rows.append((start, state, letters + "D", cost + delete, None))
            state = _NEXT[state][1]
    columns = list(zip(*rows))
    return pa.table({"s1": pa.array(columns[0], pa.int32()), "s2": pa.array(columns[1], pa.int32()), "letters": columns[2], "price": pa.array(columns[3], pa.int64()), "initial": pa.array(columns[4], pa.string())})


#: held: (c, s, ord, cost) the states in which conversation c stands, ord ranking equally cheap ones; turns:
#: (c, t, initial, gone, truncated), t from 1 in each batch. The audit is that of the batch; two audits of one
#: conversation end with the same row, so neither is the beginning of the other and ord settles ties before them.
_STEP = """
with recursive best as (
  select c, 0 t, s, s s0, cost, ord, '' audit from held
  union all
  select c, t, s, way.s0, way.cost, way.ord, way.audit from (
    select b.c, b.t + 1 t, m.s2 s,
      min({'cost': b.cost + m.price + case when r.truncated and m.letters not like '%D' then $truncated else 0 end,
        'ord': b.ord, 'audit': b.audit || m.letters, 's0': b.s0}) way
    from best b join turns r on r.c = b.c and r.t = b.t + 1
    join moves m on m.s1 = b.s and (m.letters like '%D' or (not r.gone and (m.initial is null or m.initial = r.initial)))
    group by b.c, b.t + 1, m.s2))
select c, s, s0, cost, ord, audit from best b join (select c, max(t) t from turns group by c) l using (c, t) order by c, cost, ord, audit"""


class _Open:
    """A conversation of which more rows may come."""

    def __init__(self) -> None:
        # state: (cost, place among equals, pieces of the audit, digest, something was written)
        self.states: dict[int, tuple] = {0: (0, 0, (), hashlib.sha256(), False)}
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.last_initial: str | None = None
        self.low = self.high = self.last_turn = None
        self.turns = 0


def _repaired(digest, begun: bool, state: int, audit: str, roles: list[str], texts: list[str]):
    """The digest with the rows that an audit leaves added."""
    digest, k = digest.copy(), 0
    for edit in audit:
        role, text = _NEXT[state][0], ""
        if edit != "I":
            if edit == "K":
                role = roles[k]
            text, k = texts[k], k + 1
            if edit == "D":
                continue
        state = _KEPT[state, role[:1]] if edit == "K" else _NEXT[state][1]
        digest.update((b"\n" if begun else b"") + f"{role}:{text}".encode())
        begun = True
    return digest, begun


_RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_ROW = ["conv_id", "dropped", "turn", "role", "text", "blank", "duplicate", "truncated"]


def _repair(costs: dict[str, int]):
    moves = _moves(costs["keep"], costs["rerole"], costs["delete"], costs["insert"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        con.register("moves", moves)
        running: tuple[int | None, _Open] | None = None

        def solve(rows: list[tuple]) -> list[tuple[int | None, _Open]]:
            """Take sorted rows into their conversations; those come back in order, the last one perhaps unfinished."""
            nonlocal running
            convs: list[tuple[int | None, _Open]] = [running] if running else []
            where, turns, lines = [], [], []
            for conv, dropped, turn, role, text, blank, duplicate, truncated in rows:
                if not convs or convs[-1][0] != conv:
                    convs.append((conv, _Open()))
                if dropped:
                    continue
                c, o = len(convs) - 1, convs[-1][1]
                if not where or where[-1] != c:
                    lines.append((c, [], []))
                where.append(c)
                lines[-1][1].append(role)
                lines[-1][2].append(text)
                initial = role[:1]
                fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
                if fault:
                    o.counts[fault] += 1
                if o.last_initial is not None and o.last_initial + initial not in ("su", "ua", "au"):
                    o.counts["illegal"] += 1
                o.last_initial = initial
                if turn is not None:
                    o.low, o.high = turn if o.low is None else o.low, turn
                    o.turns += o.last_turn != turn
                    o.last_turn = turn
                turns.append((c, len(lines[-1][1]), initial, fault in ("blank", "duplicate"), fault == "truncated"))
            if turns:
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
                con.register("turns", pa.table({n: pa.array(x, k) for n, x, k in zip(("c", "t", "initial", "gone", "truncated"), zip(*turns), kinds)}))
                held = [(c, s, way[1], way[0]) for c, _, _ in lines for s, way in convs[c][1].states.items()]
                con.register("held", pa.table({n: pa.array(x, k) for n, x, k in zip(("c", "s", "ord", "cost"), zip(*held), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))}))
                found: dict[int, list[tuple]] = {}
                for c, s, s0, cost, _, audit in con.execute(_STEP, {"truncated": costs["truncated"]}).fetchall():
                    found.setdefault(c, []).append((s, s0, cost, audit))
                for c, roles, texts in lines:
                    o, ways = convs[c][1], found[c]
                    if c < len(convs) - 1:  # no row can follow: the cheapest ending is all that matters
                        ways = [min(enumerate(ways), key=lambda x: (x[1][2] + costs["insert"] * _CLOSING[x[1][0]], _place(o, ways, x[0])))[1]]
                    new, places = {}, sorted(range(len(ways)), key=lambda k: _place(o, ways, k))
                    for k, (s, s0, cost, audit) in enumerate(ways):
                        _, _, pieces, digest, begun = o.states[s0]
                        new[s] = (cost, places.index(k), (pieces, audit), *_repaired(digest, begun, s0, audit, roles, texts))
                    o.states = new
            running = convs[-1] if convs else None
            return convs

        def _place(o: _Open, ways: list[tuple], k: int) -> tuple:
            """Where an audit stands among those of its conversation, by ASCII."""
            return o.states[ways[k][1]][1], ways[k][3]

        def written(done: list[tuple[int | None, _Open]]) -> pa.RecordBatch:
            out = []
            for conv, o in done:
                state, (cost, _, pieces, digest, begun) = min(o.states.items(), key=lambda x: (x[1][0] + costs["insert"] * _CLOSING[x[0]], x[1][1]))
                n = _CLOSING[state]
                digest, _ = _repaired(digest, begun, state, "I" * n, [], [])
                parts = ["I" * n]
                while pieces:
                    pieces, audit = pieces
                    parts.append(audit)
                gaps = o.high - o.low + 1 - o.turns if o.turns else 0
                out.append((conv, gaps, *o.counts.values(), cost + costs["insert"] * n, "".join(reversed(parts)), digest.hexdigest()))
            columns = zip(*out) if out else [()] * len(_RESULT)
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, _RESULT)], schema=_RESULT)

        rows, chars = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(_ROW)))):
                rows.append(row)
                chars += len(row[4])
                if len(rows) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                    convs = solve(rows)
                    yield written(convs[:-1])
                    rows, chars = [], 0
        convs = solve(rows)
        yield written(convs)
        con.close()

    return task


def faults(rows: DataFrame) -> DataFrame:
    """Add blank (nothing but space), duplicate (role and text stood in an earlier row) and truncated (no . ! or ? at the end).

    rows: conv_id, dropped, turn, role, text. Rows of a conversation stand by turn, nulls first, then by role and text.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    copies = W.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn")
    return rows.withColumns({"blank": last == "", "duplicate": F.row_number().over(copies) > 1, "truncated": (last != "") & ~last.isin(".", "!", "?")})


def repair_conversations(conversations: DataFrame, *, keep: int = 0, rerole: int = 3, delete: int = 4, insert: int = 3, truncated: int = 3) -> DataFrame:
    """The cheapest repair of each conversation.

    conversations: conv_id long, turn long, role string, text string, and perhaps dropped boolean
    (such rows only say that the conversation is there); other columns are ignored. Null role or
    text counts as one space. Rows stand by turn (nulls first), then role and text; of equal rows all but one are
    duplicates. A row's first fault counts: blank, duplicate, truncated; the first two have to be
    deleted, the third costs `truncated` unless it is. Returns conv_id, gaps (numbers missing
    between the turns), the numbers of faults, illegal (neighbours whose initials are not su, ua or
    au), cost, audit (K keep, R rerole, D delete, I insert, in order; of the cheapest ones the least by
    ASCII) and repaired_sha256 (of the repaired role:text rows, joined by newlines).

    A conversation without rows: zeros, an empty audit and the digest of nothing. A null conv_id is
    a conversation of its own. Texts and conversations may be of any length: the digest has to be taken in order, so one
    task reads all rows of a conversation, but never holds more than a batch of them.
    An empty table gives no rows.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    dropped = F.coalesce("dropped", F.lit(False)) if "dropped" in conversations.columns else F.lit(False)
    rows = conversations.select("conv_id", dropped.alias("dropped"), "turn", space("role"), space("text"))
    rows = faults(rows.repartition("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text", "duplicate")
    costs = {"keep": keep, "rerole": rerole, "delete": delete, "insert": insert, "truncated": truncated}
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return rows.select(*_ROW).mapInArrow(_repair(costs), schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of conv_id:turn (null: one space) modulo 20, for tests of the repair.

    0 drops the row (dropped is set), 1 empties its text, 2 removes . ! and ? from it, 3 repeats it, 4 makes its role user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("damage"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1))))
    new = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", (F.col("damage") == 0).alias("dropped"), "turn", role.alias("role"), new.alias("text"))
