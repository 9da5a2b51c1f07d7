"""Repair of conversations at least cost, by layers of reachable grammar states.

A conversation is an optional system turn and then pairs of a user's and an assistant's turn. A grammar state says what
came last: nothing, system, user, assistant. For each turn and each cost, a set of four bits holds the states from which
the turns from there on can be repaired at just that cost. Layers of growing cost are worked out from the last turn to the
first; the first layer that has the start state before the first turn gives the least cost. Its bits are traced from there:
each step takes the edit, first in the order of letters, whose rest is in the layer of the cost that is left.

A layer needs the three below it only, and costs that exceed the least one of a turn by more than ``SPREAD`` start no
cheapest repair: two insertions lead from any state to any that can still come, and deleting one turn makes up for the
place of a system turn. So long conversations are worked out in segments, right to left, which hand on the costs of the
four states, and the layers of one segment at a time are kept.

Rows of a conversation meet in one task, sorted by Spark and read as a stream, as a digest of the whole conversation has
one order of reading. A task holds two bytes for each row of a conversation, as its audit has a letter for each row, and
the texts of short conversations; a conversation with more than ``hold`` characters of text is streamed again with its
audit. Repeated rows are told by digests, which a task holds for a conversation of up to ``long`` rows; longer ones find
them by an aggregation.

Style: an Arrow map over sorted partitions, DataFrame aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, named, table

#: States as bits: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
ENDS = START | ASSISTANT
#: What follows a state where a turn is made to fit, or inserted.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Of two states' costs behind the same turn, the dearer one is of no use if it costs more than this beyond the other.
SPREAD = 8
#: Kinds of rows: the role's initial, and what is wrong.
INITIALS = " sua"
FINE, TRUNC, MUST_GO = 0, 1, 2


def _before(step: dict[int, int]) -> list[int]:
    """For each set of states, those from which a step leads into it."""
    return [sum(a for a, b in step.items() if b & states) for states in range(16)]


#: Sets of states before a kept turn of each initial, and before one that is made to fit.
BEFORE_KEPT = [[0] * 16, _before({START: SYSTEM}), _before({START: USER, SYSTEM: USER, ASSISTANT: USER}), _before({USER: ASSISTANT})]
BEFORE_FIT = _before(NEXT)


def _layers(codes: bytes, ends: dict[int, int], last: bool, first: bool) -> list[list[int]]:
    """For each cost from 0 on, the set of states before each turn, and behind the last one, that can be completed at
    just that cost. ``ends`` has what each state costs behind the last turn; ``last``: turns may be inserted there;
    ``first``: the start state is asked for, and its first layer is the last one."""
    n, layers = len(codes), []
    none, enough = [0] * (n + 1), None
    while enough is None or len(layers) <= enough:
        c = len(layers)
        one, two, three = (layers[c - k] if c >= k else none for k in (1, 2, 3))
        row = [0] * (n + 1)
        row[n] = sum(s for s, cost in ends.items() if cost == c) | (BEFORE_FIT[two[n]] if last else 0)
        for i in range(n - 1, -1, -1):
            code = codes[i]
            wrong = code >> 2
            bits = three[i + 1] | BEFORE_FIT[two[i]]
            if wrong == FINE:
                bits |= BEFORE_KEPT[code & 3][row[i + 1]] | BEFORE_FIT[two[i + 1]]
            elif wrong == TRUNC:
                bits |= BEFORE_KEPT[code & 3][one[i + 1]] | BEFORE_FIT[three[i + 1]]
            row[i] = bits
        layers.append(row)
        if first and row[0] & START:
            break
        if enough is None and row[0] and not first:
            enough = c + SPREAD
    return layers


def _trace(codes: bytes, layers: list[list[int]], state: int, cost: int, ends: dict[int, int], last: bool) -> tuple[str, int]:
    """The least edits of cheapest cost from a state on, and the state that they lead to."""
    out, i, n = [], 0, len(codes)

    def has(c: int, at: int, s: int) -> bool:
        return c >= 0 and bool(layers[c][at] & s)

    while True:
        if i == n and ends.get(state) == cost:
            return "".join(out), state
        fit = NEXT[state]
        if i < n and has(cost - DELETE, i + 1, state):
            edit, cost, i = "D", cost - DELETE, i + 1
        elif (i < n or last) and has(cost - INSERT, i, fit):
            edit, cost, state = "I", cost - INSERT, fit
        else:
            code = codes[i]
            more = TRUNCATED if code >> 2 == TRUNC else 0
            kept = next((s for s in (SYSTEM, USER, ASSISTANT) if BEFORE_KEPT[code & 3][s] & state), None)
            if kept and has(cost - more, i + 1, kept):
                edit, cost, state = "K", cost - more, kept
            else:
                edit, cost, state = "R", cost - more - REROLE, fit
            i += 1
        out.append(edit)


def cheapest(codes: bytes, segment: int = 64) -> tuple[int, str]:
    """Least cost and audit of a conversation. A row's code: the place of its initial in INITIALS, plus 4 times what is wrong."""
    cuts = list(range(0, len(codes), segment)) or [0]
    ends, known, layers = {START: 0, ASSISTANT: 0}, [], []
    for a in reversed(cuts):
        part, last, first = codes[a : a + segment], a == cuts[-1], a == 0
        layers = _layers(part, ends, last, first)
        starts = {s: next(c for c, row in enumerate(layers) if row[0] & s) for s in ([START] if first else [START, SYSTEM, USER, ASSISTANT])}
        known.append((part, ends, starts, last))
        least = min(starts.values())
        ends = {s: c - least for s, c in starts.items()}
    state, total, audit = START, 0, []
    for part, ends, starts, last in reversed(known):
        if audit:  # worked out again, so that only one segment's layers are held
            layers = _layers(part, ends, last, False)
        edits, after = _trace(part, layers, state, starts[state], ends, last)
        total += starts[state] - ends[after]
        audit.append(edits)
        state = after
    return total, "".join(audit)


class _Digest:
    """The digest of a repaired conversation, row by row along its audit."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.sha, self.first = audit, 0, START, hashlib.sha256(), True

    def _write(self, role: str, text: str) -> None:
        line = f"{role}:{text}" if self.first else f"\n{role}:{text}"
        self.first = False
        self.sha.update(line.encode("utf-8", "surrogatepass"))

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._write(self._fit(), "")
            self.at += 1

    def _fit(self) -> str:
        self.state = NEXT[self.state]
        return "user" if self.state == USER else "assistant"

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            self._write(role, text)
        elif edit == "R":
            self._write(self._fit(), text)

    def done(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: What a row is: fine, or its first fault.
BLANK, REPEATED, CUT_SHORT = 1, 2, 3
_CODES = {0: FINE, BLANK: MUST_GO, REPEATED: MUST_GO, CUT_SHORT: TRUNC}
_NONE = object()


class _Conversation:
    """One conversation, row by row in order; its texts are let go when they have more than ``hold`` characters."""

    def __init__(self, conv: object, hold: int) -> None:
        self.conv, self.left, self.codes, self.texts = conv, hold, bytearray(), []
        self.faults, self.illegal, self.initial, self.last = [0, 0, 0, 0], 0, "", None
        self.turns, self.low, self.high, self.seen = 0, None, None, set()

    def add(self, turn: int | None, role: str, text: str, fault: int, earlier: bool | None) -> None:
        if earlier is None:
            key = hashlib.blake2b(f"{role}\0{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            earlier = key in self.seen
            self.seen.add(key)
        else:  # of rows at one turn that are all alike, the first isn't repeated
            earlier |= (turn, role, text) == self.last
            self.last = (turn, role, text)
        if earlier and fault != BLANK:
            fault = REPEATED
        initial = role[:1]
        if self.codes and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.faults[fault] += 1
        self.codes.append(max(0, INITIALS.find(initial or " ")) | _CODES[fault] << 2)
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.texts is not None:
            self.left -= len(role) + len(text)
            self.texts.append((role, text))
            if self.left < 0:
                self.texts = None

    def result(self) -> tuple:
        cost, audit = cheapest(bytes(self.codes))
        sha = None
        if self.texts is not None:
            digest = _Digest(audit)
            for role, text in self.texts:
                digest.row(role, text)
            sha = digest.done()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults[1:], self.illegal, cost, audit, sha


def _read(batches: Iterator[pa.RecordBatch], hold: int) -> Iterator[tuple]:
    now = None
    for b in batches:
        for conv, kept, *row in zip(*(b.column(c).to_pylist() for c in ("conv", "kept", "turn", "role", "text", "fault", "earlier")), strict=True):
            if now is None or conv != now.conv:
                if now:
                    yield now.result()
                now = _Conversation(conv, hold)
            if kept:
                now.add(*row)
    if now:
        yield now.result()


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The digests of conversations whose first row brings their audit."""
    conv, digest = _NONE, None
    for b in batches:
        for c, heads, role, text in zip(*(b.column(x).to_pylist() for x in ("conv", "heads", "role", "text")), strict=True):
            if heads:
                if digest:
                    yield conv, digest.done()
                conv, digest = c, _Digest(text)
            else:
                digest.row(role, text)
    if digest:
        yield conv, digest.done()


def _mapped(rows: DataFrame, read, schema: str, kind: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(kind)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

        for row in read(batches):
            out.append(row)
            if len(out) == 1000:
                yield batch()
        yield batch()

    return rows.mapInArrow(run, schema)


def marked(rows: DataFrame, long: int) -> DataFrame:
    """Adds to ``rows`` (conv, turn, role, text, kept) the ``fault`` that a row has by itself, and ``earlier``: whether a row
    with its role and text comes at an earlier turn.

    That is worked out here for conversations of more than ``long`` rows only; the stream remembers the rows of others.
    """
    blank, whole = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = rows.withColumn("fault", F.when(blank, BLANK).when(~whole, CUT_SHORT).otherwise(0))
    many = checkpointed(rows.where("kept").groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long).select(F.col("conv").alias("m")))
    if many.isEmpty():
        return rows.withColumn("earlier", F.lit(None).cast("boolean"))
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    rows = rows.withColumn("place", place).withColumn("sha", F.sha2("text", 256))
    own = rows.where("kept").join(many, F.col("conv").eqNullSafe(F.col("m")), "left_semi")
    first = own.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s")).agg(F.min("place").alias("first"))
    found = rows.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s")), "left")
    return found.select("conv", "kept", "turn", "role", "text", "fault", (F.col("place") > F.col("first")).alias("earlier"))


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", kept: Column | None = None, hold: int = 8_000_000, long: int = 100_000) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for each conversation.

    Rows go by turn, those without one first, and of one turn by role and text. A null role or text is one blank; rows
    with a null conversation are one conversation. Where ``kept`` is false a row isn't there, but names its conversation:
    one without rows has zeros, an empty audit and the digest of the empty text. An empty table gives an empty result;
    other columns are not read, whatever their names. Conversations and texts are taken whole.
    """
    blank = lambda c: F.coalesce(named(c), F.lit(" "))
    base = rows.select(named(conv_col).alias("conv"), named(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), (F.lit(True) if kept is None else kept).alias("kept"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    held = marked(base, long).repartition("conv").sortWithinPartitions(*order)
    conv = base.schema["conv"].dataType
    kind = pa.schema([pa.field("conv", _arrow(base, "conv")), *(pa.field(c, pa.int64()) for c in COUNTS), pa.field("audit", pa.string()), pa.field("sha", pa.string())])
    name = conv.simpleString()
    found = checkpointed(_mapped(held, lambda b: _read(b, hold), f"conv {name}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, sha string", kind))
    long = found.where("sha IS NULL")
    if not long.isEmpty():
        heads = long.select("conv", F.lit(True).alias("heads"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
        wanted = long.select(F.col("conv").alias("c"))
        body = base.where("kept").join(wanted, base.conv.eqNullSafe(wanted.c), "left_semi").select("conv", F.lit(False).alias("heads"), "turn", "role", "text")
        both = heads.unionByName(body).repartition("conv").sortWithinPartitions(order[0], F.desc("heads"), *order[1:])
        shas = _mapped(both, _again, f"c {name}, late string", pa.schema([pa.field("c", _arrow(base, "conv")), pa.field("late", pa.string())]))
        found = found.join(shas, found.conv.eqNullSafe(shas.c), "left").withColumn("sha", F.coalesce("sha", "late"))
    return found.select(F.col("conv").alias(conv_col), *COUNTS, "audit", F.col("sha").alias("repaired_sha256"))


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults drawn by the rows' ids, and ``kept``, false where a row is dropped: of twenty draws
    one drops a row, one empties it, one takes its full stops, one repeats it, one makes it a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(draw == 4, "user").otherwise(blank("role"))
    once = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (draw != 0).alias("kept"), F.when(draw == 3, 2).otherwise(1).alias("copies"))
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")), kept=F.col("kept"))


def _sql() -> str:
    """Turn by turn, the least (cost, audit) that leads to each of the four states, with the text that it makes."""
    path = lambda p, cost, letter, line: f"{{'c': {p}.c + {cost}, 'a': {p}.a || '{letter}', 't': {p}.t || {line}}}"
    sep = lambda p: f"CASE WHEN {p}.t = '' THEN '' ELSE chr(10) END"
    put = lambda p, role, text: f"({sep(p)} || {role} || ':' || {text})"
    never = "{'c': 1000000, 'a': '', 't': ''}"
    least = lambda *options: f"list_min([{', '.join(options)}])"
    added = lambda p, role: path(p, INSERT, "I", put(p, f"'{role}'", "''"))
    row = lambda p, role: f"CASE WHEN wrong > 1 THEN {never} WHEN ini = '{role[0]}' THEN {least(path(p, 'wrong', 'K', put(p, 'role', 'text')), path(p, f'wrong + {REROLE}', 'R', put(p, repr(role), 'text')))} ELSE {path(p, f'wrong + {REROLE}', 'R', put(p, repr(role), 'text'))} END"
    gone = lambda p: path(p, DELETE, "D", "''")
    crc = "(SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t)"
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), d AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(k)), lambda i: ('0x' || substr(hex(encode(k)), 2 * i + 1, 2))::BIGINT)), lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8))) % 20 AS draw FROM k, {crc}
), e AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE draw <> 0
), f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM e
), g AS (
  SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pre,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 3 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 1 ELSE 0 END AS wrong FROM f
), n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (wrong = 3) AS blank, count(*) FILTER (wrong = 2) AS duplicate, count(*) FILTER (wrong = 1) AS truncated,
    count(*) FILTER (pre IS NOT NULL AND pre || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id
), w AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS z, {never} AS s, {never} AS u, {never} AS a FROM n
  UNION ALL
  SELECT conv_id, i, {gone('z')}, {least(gone('s'), f"CASE WHEN wrong <= 1 AND ini = 's' THEN {path('z', 'wrong', 'K', put('z', 'role', 'text'))} ELSE {never} END")},
    {least(gone('u'), row('z', 'user'), row('s', 'user'), row('a', 'user'))}, {least(gone('a'), row('u', 'assistant'))}
  FROM (
    SELECT conv_id, i, role, text, ini, wrong, z, s, u, {least('a', added('u', 'assistant'))} AS a FROM (
      SELECT w.conv_id, g.i, g.role, g.text, g.ini, g.wrong, z, s, {least('u', added('z', 'user'), added('s', 'user'), added('a', 'user'))} AS u, a FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1))
), x AS (
  SELECT conv_id, {least('z', 'a', added('u', 'assistant'), added("y", 'assistant'))} AS b FROM (SELECT *, {least(added('z', 'user'), added('s', 'user'))} AS y FROM w) JOIN n USING (conv_id) WHERE i = n
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
"""


#: A row at a time by recursion, with all four states' best repairs: for small tables.
SQL = _sql()
