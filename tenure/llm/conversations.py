"""Conversation structure repair: the cheapest edits that give every conversation the roles `(s?(ua)+)?`, by Hirschberg's division.

A row keeps its role at no cost, takes the role user or assistant for 2, or goes for 3; an empty user or assistant row
comes in for 2; a truncated row that stays costs 1 more. Blank rows (no character but space and 0x09-0x0D) and rows whose
role and text were seen earlier in the conversation must go. Of the cheapest edits those count whose initials (K, R, D, I) are ASCII-least.
What has been read so far is summed up by four states: nothing, system, user, assistant. Rows are halved; the costs of reaching each state
from the left and of ending from it on the right meet in the middle, the cheapest state there is fixed, and both halves are solved
likewise, so only two vectors of four are held. The left vector also ranks its states by their least
initials: each ends with a row's own edit, so none begins another, and the rank alone decides between equal costs.

Rows are ordered by conversation and turn over all tasks and cut into segments of bounded size. A segment is first summed up as
costs and ranks between its states; the same division over a conversation's segments fixes the states where
they touch, and then each segment is solved alone. So a conversation of any length is spread over tasks; one task
only sees 32 numbers for each of its segments. Its digest reads its repaired rows in order, batch by batch.

Turns order a conversation (null first, then role, then text). Null roles and texts count as one space; a null
conv_id is a conversation of its own, null turns count for no gap. A role's initial is its first character; roles without one, or with
another one than s, u and a, cannot be kept. Rows that repeat are collapsed before they are ordered, and count one by one. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.scratch import Scratch

SPACES = " \t\n\x0b\x0c\r"
#: Rows and bytes of text after which a segment ends.
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 1 << 20
STATES = 4
FAR = 1 << 40
GREATEST = 2**63 - 1
NOTHING, SYSTEM, USER, ASSISTANT = range(STATES)
#: The role that an edit gives next is settled by the state.
AFTER = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAME = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {"su", "ua", "au"}
#: Initials and cost of the rows that complete a conversation from each state.
CLOSE = {NOTHING: ("", 0), SYSTEM: ("II", 4), USER: ("I", 2), ASSISTANT: ("", 0)}
#: The code of a row that must go; others are 1 + 2 * state of the role (0 for other roles) + truncated.
GO = 0


def _row_edits(code: int) -> tuple[list, list]:
    """For every state before and after a row: the cheapest initials (ASCII-least of equals), and their costs."""
    initials: list[list] = [[None] * STATES for _ in range(STATES)]
    costs = [[FAR] * STATES for _ in range(STATES)]

    def offer(start: int, end: int, cost: int, text: str) -> None:
        if (cost, text) < (costs[start][end], initials[start][end] or ""):
            costs[start][end], initials[start][end] = cost, text

    for start, inserted in product(range(STATES), range(STATES)):
        state = start
        for _ in range(inserted):
            state = AFTER[state]
        cost, text = 2 * inserted, "I" * inserted
        offer(start, state, cost + 3, text + "D")
        if code != GO:
            role, truncated = divmod(code - 1, 2)
            offer(start, AFTER[state], cost + 2 + truncated, text + "R")
            if role == AFTER[state] or (role == SYSTEM and state == NOTHING):
                offer(start, role, cost + truncated, text + "K")
    return initials, costs


class Step:
    """What a run of rows costs between any two states, and how the least initials from one state rank by where they end."""

    def __init__(self, cost: list, rank: list):
        self.cost, self.rank = cost, rank

    def flat(self) -> list[int]:
        return [x for part in (self.cost, self.rank) for row in part for x in row]

    @classmethod
    def of(cls, flat: list[int]) -> Step:
        rows = [list(flat[i : i + STATES]) for i in range(0, len(flat), STATES)]
        return cls(rows[:STATES], rows[STATES:])


EDITS = [_row_edits(code) for code in range(2 * STATES + 1)]
ROWS = [Step(costs, [[sorted(x or "" for x in row).index(x or "") for x in row] for row in initials]) for initials, costs in EDITS]
#: No rows: every state stays.
STAY = Step([[0 if s == t else FAR for t in range(STATES)] for s in range(STATES)], [[0] * STATES for _ in range(STATES)])


def forward(steps: list[Step], lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Costs from `start` to every state over steps[lo:hi], and the ranks of their least initials."""
    cost = [FAR] * STATES
    cost[start] = 0
    rank = [0] * STATES
    for i in range(lo, hi):
        step = steps[i]
        best = [min((cost[s] + step.cost[s][t], rank[s], step.rank[s][t]) for s in range(STATES)) for t in range(STATES)]
        places = sorted({b[1:] for b in best if b[0] < FAR})
        cost = [min(b[0], FAR) for b in best]
        rank = [places.index(b[1:]) if b[0] < FAR else STATES for b in best]
    return cost, rank


def backward(steps: list[Step], lo: int, hi: int, goal: list[int]) -> list[int]:
    """Costs from every state over steps[lo:hi] to the end, where `goal` is still to pay."""
    for i in range(hi - 1, lo - 1, -1):
        cost = steps[i].cost
        goal = [min(cost[s][t] + goal[t] for t in range(STATES)) for s in range(STATES)]
    return goal


def crossings(steps: list[Step], start: int, goal: list[int]) -> list[int]:
    """The state after every step, on the cheapest way with the least initials."""
    out = [0] * len(steps)
    todo = [(0, len(steps), start, goal)]
    while todo:
        lo, hi, start, goal = todo.pop()
        if lo == hi:
            continue
        if hi - lo == 1:
            step = steps[lo]
            out[lo] = min(range(STATES), key=lambda t: (step.cost[start][t] + goal[t], step.rank[start][t]))
            continue
        mid = (lo + hi) // 2
        cost, rank = forward(steps, lo, mid, start)
        rest = backward(steps, mid, hi, goal)
        cross = min(range(STATES), key=lambda t: (cost[t] + rest[t], rank[t]))
        todo.append((lo, mid, start, [0 if t == cross else FAR for t in range(STATES)]))
        todo.append((mid, hi, cross, goal))
    return out


OPEN_END = [CLOSE[s][1] for s in range(STATES)]


def solve(codes: bytes, start: int, end: int | None) -> tuple[str, int]:
    """Initials and cost of the edits of rows from one state to another (None: the end of the conversation)."""
    steps = [ROWS[c] for c in codes]
    goal = OPEN_END if end is None else [0 if t == end else FAR for t in range(STATES)]
    audit, cost, state = [], 0, start
    for code, after in zip(codes, crossings(steps, start, goal)):
        initials, costs = EDITS[code]
        audit.append(initials[state][after])
        cost += costs[state][after]
        state = after
    if end is None:
        audit.append(CLOSE[state][0])
        cost += CLOSE[state][1]
    return "".join(audit), cost


def repaired(audit: str, start: int, roles: list[str], texts: list[str], codes: bytes) -> list[dict]:
    """The rows that the edits leave; roles and texts are those of the rows that may stay."""
    out, state, row, kept = [], start, 0, 0
    for edit in audit:
        if edit == "I":
            state = AFTER[state]
            out.append({"role": NAME[state], "text": ""})
            continue
        if edit == "K":
            state = (codes[row] - 1) // 2
            out.append({"role": roles[kept], "text": texts[kept]})
        elif edit == "R":
            state = AFTER[state]
            out.append({"role": NAME[state], "text": texts[kept]})
        kept += codes[row] != GO
        row += 1
    return out


# -- tables ------------------------------------------------------------------------------------------------------------


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by the remainder of crc32(`conv_id:turn`) by 20.

    0: no copies; 1: empty text; 2: no `.`, `!` and `?`; 3: two copies; 4: role user. A null is a space.
    """
    fault = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(_spaced("text"), ".!?", "")).otherwise(_spaced("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(_spaced("role")).alias("role"),
        text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


ROW = "_conv string, conv_id long, turn long, role string, text string, copies long, earlier boolean"
STATS = "blank long, duplicate long, truncated long, illegal long"
SEGMENT = (
    f"_conv string, conv_id long, segment long, alone boolean, {STATS}, turns long, first_turn long, last_turn long, first_role string, last_role string, "
    "step array<long>, codes binary, roles array<string>, texts array<string>"
)
TURNS = "array<struct<role:string,text:string>>"
SOLVED = f"_conv string, conv_id long, segment long, alone boolean, gaps long, {STATS}, cost long, audit string, turns {TURNS}"


def _rows(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct rows with their number of copies and whether their role and text came at an earlier turn."""
    copies = F.col("copies") if "copies" in conversations.columns else F.lit(1)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _spaced("role").alias("role"),
        _spaced("text").alias("text"),
        copies.cast("long").alias("copies"),
    ).withColumn("_conv", _spaced("conv_id"))
    rows = scratch.table(rows.groupBy("_conv", "conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")))
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.filter("copies > 0").groupBy("_conv", same.alias("_same")).agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    first = scratch.table(first.filter("_n > 1").drop("_n"))
    marked = rows.withColumn("_same", same).join(first, ["_conv", "_same"], "left")
    return marked.select("_conv", "conv_id", "turn", "role", "text", "copies", F.coalesce(F.col("_first") < place, F.lit(False)).alias("earlier"))


class _Segment:
    def __init__(self):
        self.codes, self.roles, self.texts, self.size = bytearray(), [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def add(self, turn: int | None, role: str, text: str, copies: int, earlier: bool) -> None:
        stripped = text.rstrip(SPACES)
        initial = role[:1]
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        if self.last_role is None:
            self.first_role = initial
        else:
            self.illegal += self.last_role + initial not in LEGAL
        self.last_role = initial
        self.illegal += copies - 1  # a role after itself
        if not stripped:
            self.blank += copies
            self.codes += bytes([GO]) * copies
            return
        if earlier:
            self.duplicate += copies
            self.codes += bytes([GO]) * copies
            return
        truncated = stripped[-1] not in ".!?"
        self.truncated += truncated
        self.duplicate += copies - 1
        self.codes += bytes([1 + 2 * INITIAL.get(initial, 0) + truncated]) + bytes([GO]) * (copies - 1)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.codes) >= SEGMENT_ROWS or self.size >= SEGMENT_BYTES

    def step(self) -> list[int]:
        steps = [ROWS[c] for c in self.codes]
        if not steps:
            return STAY.flat()
        ends = [forward(steps, 0, len(steps), s) for s in range(STATES)]
        return Step([list(c) for c, _ in ends], [list(r) for _, r in ends]).flat()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the conversations of a sorted partition; a conversation that may go on in another partition is not alone."""
    number = TaskContext.get().partitionId() << 33
    conv, conv_id, now, whole = None, None, _Segment(), False
    schema = pa.schema(
        [("_conv", pa.string()), ("conv_id", pa.int64()), ("segment", pa.int64()), ("alone", pa.bool_())]
        + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")]
        + [("first_role", pa.string()), ("last_role", pa.string()), ("step", pa.list_(pa.int64())), ("codes", pa.binary())]
        + [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
    )
    out: list[dict] = []
    weight = 0

    def close(alone: bool) -> None:
        nonlocal number, weight
        held = {c: getattr(now, c) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_role", "last_role")}
        held |= {"step": None if alone else now.step(), "codes": bytes(now.codes), "roles": now.roles, "texts": now.texts}
        out.append({"_conv": conv, "conv_id": conv_id, "segment": number, "alone": alone, **held})
        number += 1
        weight += now.size + len(now.codes) + 100

    for batch in batches:
        for r in batch.to_pylist():
            if r["_conv"] != conv:
                if conv is not None:
                    close(whole)
                whole = conv is not None
                conv, conv_id, now = r["_conv"], r["conv_id"], _Segment()
            copies = r["copies"]
            earlier = r["earlier"]
            while copies > 0:
                if now.full():
                    close(False)
                    whole, now = False, _Segment()
                some = min(copies, SEGMENT_ROWS)
                now.add(r["turn"], r["role"], r["text"], some, earlier)
                copies, earlier = copies - some, True
            if weight > 4 * SEGMENT_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, weight = [], 0
    if conv is not None:
        close(False)
    yield pa.RecordBatch.from_pylist(out, schema)


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else min(last - first + 1 - turns, GREATEST)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the state before them and after them (null: the end of the conversation) to their edits and rows."""
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        columns = {c: batch.column(c) for c in ("_conv", "conv_id", "segment", "alone", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
        audits, costs, turns = [], [], []
        for r in batch.select(["start", "end", "cost", "codes", "roles", "texts"]).to_pylist():
            audit, cost = solve(r["codes"], r["start"], r["end"])
            audits.append(audit)
            costs.append(cost if r["cost"] is None else r["cost"])
            turns.append(repaired(audit, r["start"], r["roles"], r["texts"], r["codes"]))
        columns |= {"cost": pa.array(costs, pa.int64()), "audit": pa.array(audits, pa.string()), "turns": pa.array(turns, kind)}
        yield pa.RecordBatch.from_pydict(columns)


BOUNDS = f"segment long, start int, end int, gaps long, {STATS}, cost long"


def _bounds(parts: pa.Table) -> pa.Table:
    """The states between the segments of one conversation, and its counts beside the first of them."""
    rows = sorted(parts.to_pylist(), key=lambda r: r["segment"])
    states = crossings([Step.of(r["step"]) for r in rows], NOTHING, OPEN_END)
    cost, before = 0, NOTHING
    for r, after in zip(rows, states):
        cost += r["step"][before * STATES + after]
        before = after
    cost += OPEN_END[before]
    sums = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
    turns, last_turn, last_role, known = 0, None, None, []
    for r in rows:
        turns += r["turns"] - (r["first_turn"] is not None and r["first_turn"] == last_turn)
        last_turn = last_turn if r["last_turn"] is None else r["last_turn"]
        known += [t for t in (r["first_turn"], r["last_turn"]) if t is not None]
        if r["first_role"] is not None:
            sums["illegal"] += last_role is not None and last_role + r["first_role"] not in LEGAL
            last_role = r["last_role"]
    sums |= {"gaps": _gaps(min(known, default=None), max(known, default=None), turns), "cost": cost}
    n = len(rows)
    table = {
        "segment": pa.array([r["segment"] for r in rows], pa.int64()),
        "start": pa.array([NOTHING, *states[:-1]], pa.int32()),
        "end": pa.array([*states[:-1], None], pa.int32()),
    }
    for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        table[c] = pa.array([sums[c]] + [None] * (n - 1) if c != "cost" else [cost] + [0] * (n - 1), pa.int64())
    return pa.table(table)


def repair(conversations: DataFrame) -> DataFrame:
    """Segments of repaired conversations: SOLVED, with `turns` the rows that the edits leave and `audit` the edits' initials.

    Counts are those of the conversation, beside its first segment; cost is 0 or null elsewhere. `alone` says that there is one segment only.
    conversations has conv_id, turn, role, text, and may have copies: how often a row is there, 0 for a row that only names its conversation.
    """
    alone, parts = _solutions(conversations, Scratch(conversations.sparkSession))
    return alone.unionByName(parts)


def _solutions(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """SOLVED of the conversations that are one segment, and of the others' segments (written)."""
    order = ["_conv", "turn", "role", "text"]
    rows = _rows(conversations, scratch).repartitionByRange(*order).sortWithinPartitions(*order)
    segments = scratch.table(rows.mapInArrow(_segments, SEGMENT))
    wide = lambda name: F.col(name).cast("decimal(20,0)")
    gaps = F.least(wide("last_turn") - wide("first_turn") + 1 - wide("turns"), F.lit(GREATEST)).cast("long")
    gaps = F.when(F.col("first_turn").isNull(), 0).otherwise(gaps).alias("gaps")
    columns = ["_conv", "conv_id", "segment", "alone", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "start", "end", "codes", "roles", "texts"]
    alone = segments.filter("alone").select(
        *columns[:4], gaps, *columns[5:9], F.lit(None).cast("long").alias("cost"), F.lit(NOTHING).alias("start"), F.lit(None).cast("int").alias("end"), *columns[12:]
    )
    light = ["_conv", "segment", "step", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_role", "last_role"]
    parts = segments.filter("not alone")
    bounds = scratch.table(parts.select(*light).groupBy("_conv").applyInArrow(_bounds, BOUNDS))
    parts = parts.select("_conv", "conv_id", "segment", "alone", "codes", "roles", "texts").join(bounds, "segment").select(*columns)
    return alone.mapInArrow(_solved, SOLVED), scratch.table(parts.mapInArrow(_solved, SOLVED))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's rows, from segments sorted by conversation."""
    conv, digest, empty = None, hashlib.sha256(), True

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"_conv": pa.array([conv], pa.string()), "repaired_sha256": pa.array([digest.hexdigest()], pa.string())})

    for batch in batches:
        for name, body, some in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            if name != conv:
                if conv is not None:
                    yield done()
                conv, digest, empty = name, hashlib.sha256(), True
            if some:
                digest.update(b"" if empty else b"\n")
                digest.update(body.as_buffer())
                empty = False
    if conv is not None:
        yield done()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def structure(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (rows as `role:text`, a line each) of every conversation."""
    alone, parts = _solutions(conversations, Scratch(conversations.sparkSession))
    body = F.concat_ws("\n", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    alone = alone.select("conv_id", *COUNTS, "audit", F.sha2(body, 256).alias("repaired_sha256"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda x: x["audit"]), "")
    whole = parts.groupBy("_conv").agg(F.first("conv_id").alias("conv_id"), *(F.max(c).alias(c) for c in COUNTS), audit.alias("audit"))
    text = parts.select("_conv", "segment", body.alias("body"), (F.size("turns") > 0).alias("some")).repartition("_conv")
    text = text.sortWithinPartitions("_conv", "segment").select("_conv", "body", "some")
    digests = text.mapInArrow(_digests, "_conv string, repaired_sha256 string")
    return alone.unionByName(whole.join(digests, "_conv").drop("_conv"))


def oracle() -> str:
    """DuckDB SQL for the rows of structure(damaged(...)): a recursion over the rows with the least (cost, initials) of each state."""
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::BIGINT)), lambda c, b:
        list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
    least = lambda *options: f"list_sort([{', '.join(options)}])[1]"
    add = lambda state, cost, initial: f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}'}}"
    allowed = lambda test, option: f"CASE WHEN {test} THEN {option} ELSE {{'c': {FAR}, 'a': ''}} END"
    change = lambda state: allowed("NOT go", add(state, "2 + tr", "R"))
    keep = lambda state, initial: allowed(f"NOT go AND role[1] = '{initial}'", add(state, "tr", "K"))
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE
        keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') AS conv, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        faults AS (SELECT conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS f FROM keyed),
        damaged AS (SELECT conv, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
            CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM (SELECT *, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM faults)),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS seen FROM
            (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {spaces}) AS rest FROM damaged)),
        coded AS (SELECT *, rest = '' AS blank, rest <> '' AND seen > 1 AS dup, rest = '' OR seen > 1 AS go,
            (NOT (rest = '' OR seen > 1) AND rest[-1] NOT IN ('.', '!', '?'))::INT AS tr,
            coalesce((lag(role[1]) OVER (PARTITION BY conv ORDER BY i) || role[1]) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM ordered),
        dp AS (SELECT DISTINCT conv, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS n, {{'c': {FAR}::BIGINT, 'a': ''}} AS s,
                {{'c': {FAR}::BIGINT, 'a': ''}} AS u, {{'c': {FAR}::BIGINT, 'a': ''}} AS a FROM keyed
            UNION ALL
            SELECT conv, i, {add("n", 3, "D")}, {least(add("s", 3, "D"), keep("n", "s"))},
                {least(add("u", 3, "D"), *(o for x in ("n", "s", "a") for o in (keep(x, "u"), change(x))))},
                {least(add("a", 3, "D"), keep("u", "a"), change("u"))}
            FROM (SELECT dp.conv, coded.i, go, tr, role, n, s, {least("u", add("n", 2, "I"), add("s", 2, "I"), add("a", 2, "I"))} AS u,
                {least("a", add("u", 2, "I"), add("n", 4, "II"), add("s", 4, "II"))} AS a FROM dp JOIN coded ON dp.conv = coded.conv AND coded.i = dp.i + 1)),
        ends AS (SELECT conv, {least("n", add("s", 4, "II"), add("u", 2, "I"), "a")} AS e FROM dp
            QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1),
        edits AS (SELECT conv, j, substr(e.a, j, 1) AS op FROM ends, unnest(range(1, len(e.a) + 1)) AS t(j)),
        placed AS (SELECT *, sum((op <> 'I')::INT) OVER w AS i, sum((op <> 'D')::INT) OVER w AS p FROM edits WINDOW w AS (PARTITION BY conv ORDER BY j)),
        rows AS (SELECT placed.conv, p, op, role, text, max((p = 1 AND op = 'K' AND role[1] = 's')::INT) OVER (PARTITION BY placed.conv) AS sys
            FROM placed JOIN coded ON placed.conv = coded.conv AND placed.i = coded.i WHERE op IN ('K', 'R')
            UNION ALL SELECT conv, p, op, NULL, '', NULL FROM placed WHERE op = 'I'),
        repaired AS (SELECT conv, string_agg(CASE op WHEN 'K' THEN role ELSE CASE (p - sys) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || text, chr(10) ORDER BY p) AS body
            FROM (SELECT conv, p, op, role, text, coalesce(max(sys) OVER (PARTITION BY conv), 0) AS sys FROM rows) GROUP BY conv),
        counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INT)::BIGINT AS blank,
            sum(dup::INT)::BIGINT AS duplicate, sum(tr)::BIGINT AS truncated, sum(illegal::INT)::BIGINT AS illegal FROM coded GROUP BY conv)
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
            coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, e.c AS cost, e.a AS audit, sha256(coalesce(body, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv, conv_id FROM keyed) JOIN ends USING (conv) LEFT JOIN counts USING (conv) LEFT JOIN repaired USING (conv)"""
