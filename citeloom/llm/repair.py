"""Conversations repaired by the cheapest edits that give a legal order of roles.

Rows of a conversation are kept (0), given the other speaker's role (2), deleted
(3; blank rows and repeats have to be) or joined by new empty ones (2); a
truncated row that stays adds 1. The roles left must read ``(s?(ua)+)?`` by
their initials. Of the cheapest edits the ones with the least audit, their
initials K, R, D and I in order, are taken.

The search is a depth-first branch and bound: an explicit stack of prefixes; a
lower bound for every suffix (what its faults cost, and two for each of its
disjoint pairs of neighbours that can't both stay as they are); the best whole
(cost, audit) so far; and a table of the best prefix met at every node, which is
(rows done, role state), against which worse prefixes are dropped. When the
stack is empty, the incumbent is proved best.

A conversation may be longer than a task can hold. Facts about rows (a few
bytes each) are sorted over all tasks, so that a long conversation spans
several. Each stretch of ``SEGMENT`` rows is searched from every entry state to
every exit state, and stretches are joined by their tables. Texts are read
once more, in order, when the edits are known, and stream past them. The digest
of a conversation is one SHA-256, so a conversation's repaired texts pass
through one task, a batch at a time.

Defined cases: a null role or text is one space, as is a null id or turn where
rows are damaged; rows go by turn, nulls first, then role, then SHA-256 of the
text, and equal rows stay next to each other; rows with a null id are one
conversation; roles that start with none of s, u and a can't stay; an empty
table gives no rows; other columns are not read.
"""

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.ordered import in_order
from citeloom.llm.registry import query, table
from citeloom.llm.written import written

INITIALS = "sua"
OTHER = 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state that the only speaker who may follow leads to, and that speaker.
NEXT = (USER, USER, ASSISTANT, USER)
SPEAKER = {USER: "user", ASSISTANT: "assistant"}
#: state -> initial -> state, for rows that stay.
STAYS = ({0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER})
LEGAL = ((0, 1), (1, 2), (2, 1))
DONE = (START, ASSISTANT)
#: Without an exact suffix bound a depth-first search may return to a node many times; in 16 rows that stays cheap.
SEGMENT = 16
NO_FAULT, TRUNCATED, BLANK, REPEAT = range(4)
WHITE = r"\x20\x09-\x0D"

Found = tuple[int, str]
Table = dict[tuple[int, int], Found]


def suffix_bounds(items: tuple[int, ...]) -> list[int]:
    """Least cost of the items from each place on, whatever came before."""
    bounds = [0] * (len(items) + 1)
    after: tuple[int, int] | None = None  # initial and place of the next item that might stay
    for i in reversed(range(len(items))):
        item = items[i]
        if item < 0:
            bounds[i] = bounds[i + 1] - 3 * item
            continue
        initial, own = item % 4, item // 4 + (2 if item % 4 == OTHER else 0)
        bounds[i] = bounds[i + 1] + own
        if after is not None and initial != OTHER and after[0] != OTHER and (initial, after[0]) not in LEGAL:
            # One of the two is edited or something comes between; neither counts in another pair.
            j = after[1]
            between = bounds[i + 1] - bounds[j]
            bounds[i] = max(bounds[i], own + between + items[j] // 4 + 2 + bounds[j + 1])
        after = (initial, i)
    return bounds


def search(items: tuple[int, ...], entry: int, goals: tuple[int, ...]) -> Found | None:
    """The least (cost, audit) from ``entry`` to one of ``goals``.

    An item is a row that may stay (initial, plus 4 if truncated) or, negative,
    a number of rows that have to go.
    """
    end, bounds = len(items), suffix_bounds(items)
    best: Found | None = None
    reached: dict[tuple[int, int], Found] = {(0, entry): (0, "")}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if reached[i, state] != (cost, audit):
            continue
        if best is not None and (cost + bounds[i], audit) > (best[0], best[1][: len(audit)]):
            continue
        if i == end and state in goals:
            if best is None or (cost, audit) < best:
                best = (cost, audit)
            continue
        moves = [(i, NEXT[state], cost + 2, audit + "I")]
        if i < end and (item := items[i]) < 0:
            moves.append((i + 1, state, cost - 3 * item, audit + "D" * -item))
        elif i < end:
            cut = item // 4
            moves.append((i + 1, state, cost + 3, audit + "D"))
            moves.append((i + 1, NEXT[state], cost + 2 + cut, audit + "R"))
            if (stays := STAYS[state].get(item % 4)) is not None:
                moves.append((i + 1, stays, cost + cut, audit + "K"))
        # The most promising prefix comes to lie on top.
        moves.sort(key=lambda m: (m[2] + bounds[m[0]], m[3]), reverse=True)
        for move in moves:
            node, found = move[:2], move[2:]
            if node not in reached or found < reached[node]:
                reached[node] = found
                stack.append(move)
    return best


@lru_cache(50_000)
def whole(items: tuple[int, ...]) -> Found:
    """The least (cost, audit) of a whole conversation."""
    return search(items, START, DONE)


@lru_cache(10_000)
def crossings(items: tuple[int, ...]) -> Table:
    """The least (cost, audit) from every state to every state."""
    found = {(a, b): search(items, a, (b,)) for a in STATES for b in STATES}
    return {ends: best for ends, best in found.items() if best is not None}


def joined(left: Table, right: Table) -> Table:
    out: Table = {}
    for (a, b), (cost, audit) in left.items():
        for c in STATES:
            if (b, c) in right:
                more = (cost + right[b, c][0], audit + right[b, c][1])
                out[a, c] = min(out.get((a, c), more), more)
    return out


class Stretch:
    """What is known of consecutive rows of one conversation within a task."""

    def __init__(self) -> None:
        self.pending: list[int] = []
        self.before: Table | None = None
        self.counts = [0, 0, 0, 0]  # blank, repeats, truncated, illegal
        self.first = self.last = None
        self.turns, self.low, self.high = 0, None, None

    def add(self, turn: int | None, initial: int, fault: int, copies: int) -> None:
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        if self.first is None:
            self.first = initial
        else:
            self.counts[3] += (self.last, initial) not in LEGAL
        self.counts[3] += copies - 1
        self.last = initial
        if fault == BLANK:
            self.counts[0] += copies
        else:
            self.counts[1] += copies - (fault != REPEAT)
            self.counts[2] += fault == TRUNCATED
        if fault in (NO_FAULT, TRUNCATED):
            self.pending.append(initial + 4 * (fault == TRUNCATED))
            copies -= 1
        if copies:
            self.pending.append(-copies)
        if len(self.pending) >= SEGMENT:
            self.fold()

    def fold(self) -> None:
        table = crossings(tuple(self.pending))
        self.before = table if self.before is None else joined(self.before, table)
        self.pending = []

    def row(self, border: bool) -> dict:
        """A row of PIECES; a stretch that others may border on gives all its crossings."""
        if border or self.before is not None:
            self.fold()
            table = self.before
        else:
            table = {(START, DONE[0]): whole(tuple(self.pending))}
        return {
            "border": border,
            **dict(zip(("blank", "duplicate", "truncated", "illegal"), self.counts)),
            "first": self.first,
            "last": self.last,
            "turns": self.turns,
            "low": self.low,
            "high": self.high,
            "table": [{"a": a, "b": b, "cost": c, "audit": t} for (a, b), (c, t) in table.items()],
        }


PIECES = (
    "conv_id long, part int, border boolean, blank long, duplicate long, truncated long, illegal long, first int, last int, "
    "turns long, low long, high long, table array<struct<a:int,b:int,cost:long,audit:string>>"
)
PIECES_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("border", pa.bool_())]
    + [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")]
    + [("first", pa.int32()), ("last", pa.int32())]
    + [(n, pa.int64()) for n in ("turns", "low", "high")]
    + [("table", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]
)
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted facts to one row per conversation and task."""
    here: Stretch | None = None
    conv = part = None
    first, out = True, []
    for batch in batches:
        columns = (batch[n].to_pylist() for n in ("conv_id", "turn", "initial", "fault", "copies", "part"))
        for conv_id, turn, initial, fault, copies, part in zip(*columns):
            if here is not None and conv_id != conv:
                out.append({"conv_id": conv, "part": part, **here.row(first)})
                here, first = None, False
            if here is None:
                here, conv = Stretch(), conv_id
            here.add(turn, initial, fault, copies)
        if len(out) >= 5_000:
            yield pa.RecordBatch.from_pylist(out, PIECES_ARROW)
            out = []
    if here is not None:
        out.append({"conv_id": conv, "part": part, **here.row(True)})
    if out:
        yield pa.RecordBatch.from_pylist(out, PIECES_ARROW)


def settled(rows: list[dict]) -> dict:
    """The report of a conversation from its pieces, in order."""
    total = {n: sum(r[n] for r in rows) for n in ("blank", "duplicate", "truncated", "illegal", "turns")}
    table: Table | None = None
    last = high = None
    lows = [r["low"] for r in rows if r["low"] is not None]
    for r in rows:
        if r["first"] is not None:
            total["illegal"] += last is not None and (last, r["first"]) not in LEGAL
            last = r["last"]
        if r["low"] is not None:
            total["turns"] -= r["low"] == high
            high = r["high"]
        own = {(x["a"], x["b"]): (x["cost"], x["audit"]) for x in r["table"]}
        table = own if table is None else joined(table, own)
    cost, audit = min(table[START, goal] for goal in DONE if (START, goal) in table)
    gaps = high - min(lows) + 1 - total.pop("turns") if lows else total.pop("turns") * 0
    return {"conv_id": rows[0]["conv_id"], "gaps": gaps, **total, "cost": cost, "audit": audit}


def _reports(rows: pa.Table) -> pa.Table:
    # At most two pieces a task are borders, so a conversation has no more of them than there are tasks.
    report = settled(sorted(rows.to_pylist(), key=lambda r: r["part"]))
    kinds = [(n, pa.string() if n == "audit" else pa.int64()) for n in report]
    return pa.Table.from_pylist([report], pa.schema(kinds))


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, fault, copies): equal rows counted, each with its first fault.

    ``rows`` are (conv_id, turn, role, text, copies), without nulls in role and
    text; rows of no copies only name their conversation.
    """
    text = F.col("text")
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(OTHER))
    # instr finds the empty string at place 1, so a role without letters is told apart.
    initial = F.when(F.length("role") == 0, OTHER).otherwise(initial)
    fault = (
        F.when(~text.rlike(f"[^{WHITE}]"), BLANK)
        .when(~text.rlike(rf"[.!?][{WHITE}]*+\z"), TRUNCATED)
        .otherwise(NO_FAULT)
    )
    facts = rows.select(
        "conv_id",
        "turn",
        "role",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        initial.cast("int").alias("initial"),
        fault.alias("fault"),
        F.col("copies").cast("long").alias("copies"),
    )
    facts = facts.groupBy("conv_id", "turn", "role", "digest", "initial", "fault").agg(F.sum("copies").alias("copies"))
    facts = written(facts, "repair-facts")
    # The row of the first turn stays the original; a text met at many turns is one count per task, then one row.
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = (
        facts.filter((F.col("copies") > 0) & (F.col("fault") != BLANK))
        .groupBy("conv_id", "role", "digest")
        .agg(F.min(turn).alias("first_turn"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first_turn")
    )
    met = facts.join(
        firsts,
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")),
        "left",
    )
    later = F.col("first_turn").isNotNull() & (turn != F.col("first_turn"))
    again = F.when(later & (F.col("fault") != BLANK), REPEAT).otherwise(F.col("fault"))
    return met.select("conv_id", "turn", "role", "digest", "initial", again.alias("fault"), "copies")


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, cost and audit. ``rows`` as for :func:`with_faults`."""
    facts = in_order(with_faults(rows), "conv_id", "turn", "role", "digest")
    found = written(facts.select("conv_id", "turn", "initial", "fault", "copies", "part").mapInArrow(pieces, PIECES), "repair-pieces")
    inner = found.filter("NOT border")
    spread = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    best = F.array_min(
        F.transform(F.filter("table", lambda x: (x["a"] == START) & x["b"].isin(*DONE)), lambda x: F.struct(x["cost"], x["audit"]))
    )
    inner = inner.select(
        "conv_id", spread.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit")
    )
    return inner.unionByName(found.filter("border").groupBy("conv_id").applyInArrow(_reports, REPORT))


TURNS = f"{REPORT}, place int, role string, text string"
TURNS_ARROW = pa.schema(
    [("conv_id", pa.int64())]
    + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("place", pa.int32()), ("role", pa.string()), ("text", pa.string())]
)
KEPT = [f.name for f in TURNS_ARROW][:8]


class Editor:
    """Applies an audit to rows as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.place = audit, 0, START, 0

    def spoken(self, role: str | None, text: str) -> tuple[int, str, str]:
        if role is None:
            self.state = NEXT[self.state]
            role = SPEAKER[self.state]
        else:
            self.state = STAYS[self.state][INITIALS.index(role[0])]
        self.place += 1
        return self.place, role, text

    def inserted(self) -> Iterator[tuple[int, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.spoken(None, "")

    def edited(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self.spoken(role if edit == "K" else None, text)


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports, each followed by its conversation's rows, to reports (place 0) followed by repaired turns."""
    editor, report = Editor(""), (None,) * len(KEPT)
    for batch in batches:
        out: list[tuple] = []
        columns = [batch[n].to_pylist() for n in ("is_row", *KEPT, "role", "text", "copies")]
        for is_row, *values, role, text, copies in zip(*columns):
            if not is_row:
                out += [(*report, *turn) for turn in editor.inserted()]
                editor, report = Editor(values[-1]), (values[0], *[None] * (len(KEPT) - 1))
                out.append((*values, 0, None, None))
                continue
            for _ in range(copies):
                out += [(*report, *turn) for turn in editor.edited(role, text)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), TURNS_ARROW)], schema=TURNS_ARROW)
    rest = [(*report, *turn) for turn in editor.inserted()]
    if rest:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest), TURNS_ARROW)], schema=TURNS_ARROW)


def _repaired(rows: DataFrame) -> DataFrame:
    """TURNS: a report (place 0) and then the repaired turns of every conversation, in order within each task."""
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    nothing = [F.lit(None).cast("long").alias(n) for n in KEPT[1:-1]] + [F.lit(None).cast("string").alias("audit")]
    texts = rows.filter("copies > 0").select(
        F.lit(True).alias("is_row"), "conv_id", *nothing, "turn", "role",
        F.unhex(F.sha2("text", 256)).alias("digest"), F.when(~blank, F.col("text")).alias("text"), F.col("copies").cast("int").alias("copies"),
    )
    reports = repair_report(rows).select(
        F.lit(False).alias("is_row"), *KEPT, F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("copies"),
    )
    both = reports.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "digest")
    return both.select("is_row", *KEPT, "role", "text", "copies").mapInArrow(edited, TURNS)


def as_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of a conversations table."""
    return conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.lit(1).alias("copies"),
    )


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of every repaired conversation."""
    return _repaired(as_rows(conversations)).filter("place > 0").select("conv_id", "place", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as :func:`as_rows` gives them, damaged by a checksum of their id and turn."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    return as_rows(conversations).select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


DIGESTS = f"{REPORT}, repaired_sha256 string"
DIGESTS_ARROW = pa.schema([*list(TURNS_ARROW)[:8], pa.field("repaired_sha256", pa.string())])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reports with the digest of the turns that follow each."""
    report, digest, out = None, sha256(), []
    for batch in batches:
        columns = [batch[n].to_pylist() for n in (*KEPT, "place", "role", "text")]
        for *values, place, role, text in zip(*columns):
            if place == 0:
                if report is not None:
                    out.append((*report, digest.hexdigest()))
                report, digest = values, sha256()
            else:
                digest.update(f"{chr(10) * (place > 1)}{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), DIGESTS_ARROW)], schema=DIGESTS_ARROW)
            out = []
    if report is not None:
        last = [(*report, digest.hexdigest())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last), DIGESTS_ARROW)], schema=DIGESTS_ARROW)


SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), fated AS (
  SELECT *, xor(list_reduce(
      list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT),
      lambda crc, b: list_reduce(range(0, 8), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)),
      4294967295), 4294967295) % 20 AS fate
  FROM named
), kept AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(0, CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated
), placed AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS x,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), steps AS (
  SELECT *, blank OR again AS gone, count(*) OVER (PARTITION BY conv_id) AS n,
         lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x NOT IN ('su', 'ua', 'au') AS odd
  FROM placed
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, '000000000' AS key, []::VARCHAR[] AS lines FROM kept
  UNION ALL
  SELECT conv_id, i, state, min(key), arg_min(lines, key) FROM (
    SELECT conv_id, i, state2 AS state, lpad((key[1:9]::INT + more)::VARCHAR, 9, '0') || key[10:] || CASE WHEN ins THEN 'I' ELSE '' END || edit AS key,
           list_concat(lines, CASE WHEN ins THEN [CASE state1 WHEN 2 THEN 'user:' ELSE 'assistant:' END] ELSE []::VARCHAR[] END,
             CASE edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text]
                  ELSE [CASE state2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END) AS lines
    FROM (
      SELECT *, CASE edit WHEN 'D' THEN state1 WHEN 'R' THEN CASE state1 WHEN 2 THEN 3 ELSE 2 END
                     ELSE CASE WHEN x = 's' AND state1 = 0 THEN 1 WHEN x = 'u' AND state1 <> 2 THEN 2 WHEN x = 'a' AND state1 = 2 THEN 3 END END AS state2,
             CASE WHEN ins THEN 2 ELSE 0 END + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 + cut::INT ELSE cut::INT END AS more
      FROM (
        SELECT b.conv_id, s.i, b.key, b.lines, s.role, s.text, s.x, s.cut, ins, edit,
               CASE WHEN NOT ins THEN b.state WHEN b.state = 2 THEN 3 ELSE 2 END AS state1
        FROM best b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i + 1
        CROSS JOIN (VALUES (true), (false)) AS y(ins) CROSS JOIN (VALUES ('K'), ('R'), ('D')) AS z(edit)
        WHERE NOT s.gone OR edit = 'D'
      )
    ) WHERE state2 IS NOT NULL
  ) GROUP BY conv_id, i, state
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (odd) AS illegal
  FROM steps GROUP BY conv_id
), ended AS (
  SELECT b.conv_id, min(key) AS key, arg_min(lines, key) AS lines FROM (
    SELECT b.conv_id, CASE WHEN state = 2 THEN lpad((key[1:9]::INT + 2)::VARCHAR, 9, '0') || key[10:] || 'I' ELSE key END AS key,
           CASE WHEN state = 2 THEN list_append(lines, 'assistant:') ELSE lines END AS lines
    FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i WHERE state <> 1
  ) b GROUP BY b.conv_id
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(key[1:9]::BIGINT, 0) AS cost,
       coalesce(key[10:], '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM every v LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM v.conv_id
"""


@query("op11_conversation_repair", SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(damaged(table(spark, sf_dir, "conversations"))).mapInArrow(digests, DIGESTS)
