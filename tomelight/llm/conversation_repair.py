"""Conversations: faults, and the cheapest edits that give a legal order of roles."""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: What an edit costs, and an undeleted truncated row on top.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of a walk: nothing written yet, or the role written last. OTHER roles can only be changed or deleted.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
OTHER = EMPTY
#: A row as one byte: its initial, whether it must go, whether it is truncated.
MUST, SHORT = 4, 8
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: From each state, the role that may be written by an edit of the role or by an insertion.
_TURN = (USER, USER, ASSISTANT, USER)
#: The states that lead to each state by such a turn.
_BEFORE = ((), (), (EMPTY, SYSTEM, ASSISTANT), (USER,))
_NAMES = ("", "system", "user", "assistant")
_FAR = 1 << 62

STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_WHITE = r"\x20\x09-\x0D"


def distances(rows: bytes) -> array:
    """From each node 4 * (rows consumed) + state, the least cost to a legal end: Dial's bucket queue, run back from the ends.

    Costs are small whole numbers, so a ring of one bucket for each cost up to the largest arc holds all open nodes.
    """
    n = len(rows)
    dist = array("q", [_FAR]) * (4 * (n + 1))
    ring = [[] for _ in range(max(INSERT, DELETE, REROLE + TRUNCATED) + 1)]
    for end in (4 * n + EMPTY, 4 * n + ASSISTANT):
        dist[end] = 0
        ring[0].append(end)
    now, open_ = 0, 2
    while open_:
        bucket = ring[now % len(ring)]
        while bucket:
            node = bucket.pop()
            open_ -= 1
            if dist[node] != now:
                continue
            k, state = divmod(node, 4)
            arcs = [(4 * k + b, INSERT) for b in _BEFORE[state]]
            if k:
                row = rows[k - 1]
                arcs.append((node - 4, DELETE))
                if not row & MUST:
                    more = TRUNCATED if row & SHORT else 0
                    arcs += [(4 * (k - 1) + b, REROLE + more) for b in _BEFORE[state]]
                    if row & 3 == state:
                        arcs += [(4 * (k - 1) + b, KEEP + more) for b in (_BEFORE[state] if state != SYSTEM else (EMPTY,))]
            for to, cost in arcs:
                if now + cost < dist[to]:
                    dist[to] = now + cost
                    ring[(now + cost) % len(ring)].append(to)
                    open_ += 1
        now += 1
    return dist


def cheapest(rows: bytes) -> tuple[int, str]:
    """The least cost, and of the audits of that cost the least: at each node the first letter whose arc is tight."""
    dist = distances(rows)
    k, state, out, n = 0, EMPTY, [], len(rows)
    while dist[4 * k + state] or k < n:
        here, turn = dist[4 * k + state], _TURN[state]
        row = rows[k] if k < n else MUST
        more = TRUNCATED if row & SHORT else 0
        if k < n and here == DELETE + dist[4 * (k + 1) + state]:
            k, letter = k + 1, "D"
        elif here == INSERT + dist[4 * k + turn]:
            state, letter = turn, "I"
        elif row & MUST == 0 and row & 3 and (row & 3 == turn or row & 3 == SYSTEM and state == EMPTY) and here == KEEP + more + dist[4 * (k + 1) + (row & 3)]:
            k, state, letter = k + 1, row & 3, "K"
        else:
            k, state, letter = k + 1, turn, "R"
        out.append(letter)
    return dist[EMPTY], "".join(out)


_short = lru_cache(1 << 16)(cheapest)


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copy) after faults put in by a hash of conversation and turn: of 20 cases, row lost (0), text emptied (1), sentence ends lost (2), row repeated (3), role user (4).

    A null role or text is one space, and so are nulls in what is hashed.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    text = space(text_col)
    df = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.when(case == 4, "user").otherwise(space(role_col)).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), case.alias("case"),
    )
    return df.where("case <> 0").withColumn("copy", F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("case")


def _hashed(rows: DataFrame) -> DataFrame:
    """One more column, told: a hash of role and text."""
    return rows.withColumn("told", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))


def _order(*more: str) -> list[Column]:
    """Rows of a conversation by turn, nulls first; rows of one turn by role and a hash of the text, copies side by side."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("told"), *map(F.col, more)]


def plan_repairs(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Per conversation of ids (one column conv) its faults, the least cost and the audit.

    Repeated rows are found by conversation and text, so a large conversation is spread over many tasks for that. Then
    one task takes the rows of a conversation in order, as one byte each; the audit, which has to be one string with a
    letter for each row, is no smaller.
    """
    seen = F.row_number().over(Window.partitionBy("conv", "told").orderBy(*_order("copy"))) > 1
    blank = ~F.col("text").rlike(f"[^{_WHITE}]")
    short = ~F.col("text").rlike(rf"[.!?][{_WHITE}]*\z")
    flat = _hashed(rows).select("conv", "turn", "role", "told", "copy", blank.alias("blank"), short.alias("short"))
    flat = flat.withColumn("again", seen).withColumn("fault", F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("short"), 3).otherwise(0))
    first = F.substring("role", 1, 1)
    code = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    flat = flat.withColumn("code", code).drop("blank", "short")
    marks = ids.select("conv", *(F.lit(None).cast(t).alias(c) for c, t in flat.dtypes[1:]))
    dealt = flat.union(marks).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("fault").isNotNull(), *_order("again", "copy"))
    dealt = dealt.select("conv", "turn", "code", "fault")
    schema = StructType([rows.schema["conv"], *(StructField(c, LongType()) for c in STATS), StructField("audit", StringType())])
    return dealt.mapInArrow(_plan, schema)


class _Conversation:
    def __init__(self, conv):
        self.conv, self.rows, self.faults, self.illegal = conv, bytearray(), [0, 0, 0, 0], 0
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, code, fault):
        if turn is not None and turn != self.high:  # turns come in ascending order
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.rows:
            last = self.rows[-1] & 3
            self.illegal += (last, code) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
        self.faults[fault] += 1
        self.rows.append(code | (MUST if fault in (1, 2) else SHORT if fault == 3 else 0))

    def row(self):
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        rows = bytes(self.rows)
        cost, audit = (_short if len(rows) <= 32 else cheapest)(rows)
        return self.conv, gaps, *self.faults[1:], self.illegal, cost, audit


def _plan(batches):
    now = None
    for batch in batches:
        done = []
        for conv, turn, code, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now.conv:
                done += [now.row()] if now else []
                now = _Conversation(conv)
            if fault is not None:
                now.add(turn, code, fault)
        yield _batch(done, batch.schema.field(0))
    if now:
        yield _batch([now.row()], batch.schema.field(0))


def _batch(rows: list[tuple], key: pa.Field) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * (len(STATS) + 2)
    kinds = [key.type, *[pa.int64()] * len(STATS), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv", *STATS, "audit"])


class _Edits:
    """Follows an audit through the rows of its conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, EMPTY

    def inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, _TURN[self.state]
            yield _NAMES[self.state], ""

    def row(self, role, text):
        yield from self.inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.state = _INITIALS[role[0]]
            yield role, text
        elif letter == "R":
            self.state = _TURN[self.state]
            yield _NAMES[self.state], text


def _with_plans(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order."""
    rows = _hashed(rows).select("conv", "turn", "role", "told", "copy", "text", *(F.lit(None).cast("long").alias(c) for c in STATS), F.lit(None).cast("string").alias("audit"))
    plans = plans.select("conv", *(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[1:6]), *STATS, "audit")
    dealt = plans.union(rows).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("audit").isNull(), *_order("copy"))
    return dealt.select("conv", "role", "text", *STATS, "audit")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv, place, role, text): the repaired conversations; texts pass one after another, whatever a conversation's length."""

    def run(batches):
        edits, conv, place, key = None, None, 0, None
        for batch in batches:
            key, out = batch.schema.field(0).type, []
            for c, role, text, audit in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text", "audit")), strict=True):
                if audit is not None:
                    out += [(conv, *x) for x in edits.inserted()] if edits else []
                    edits, conv = _Edits(audit), c
                else:
                    out += [(conv, *x) for x in edits.row(role, text)]
            yield out, key
        if edits:
            yield [(conv, *x) for x in edits.inserted()], key

    def numbered(batches):
        last, place = object(), 0
        for out, key in run(batches):
            places = []
            for c, _, _ in out:
                last, place = c, place + 1 if c == last else 0
                places.append(place)
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], key), pa.array(places, pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["conv", "place", "role", "text"])

    schema = StructType([rows.schema["conv"], StructField("place", LongType()), StructField("role", StringType()), StructField("text", StringType())])
    return _with_plans(rows, plans).mapInArrow(numbered, schema)


def repair_digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans with repaired_sha256: of the repaired rows as role:text, joined by line feeds. The hash is fed row by row."""

    def run(batches):
        edits = sha = plan = None

        def feed(found):
            nonlocal begun
            for role, text in found:
                sha.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True

        def end():
            feed(edits.inserted())
            return (*plan, sha.hexdigest())

        begun = False
        for batch in batches:
            done = []
            names = batch.schema.names
            columns = {c: batch.column(c).to_pylist() for c in names}
            for k, audit in enumerate(columns["audit"]):
                if audit is None:
                    feed(edits.row(columns["role"][k], columns["text"][k]))
                    continue
                done += [end()] if edits else []
                edits, sha, begun = _Edits(audit), hashlib.sha256(), False
                plan = (columns["conv"][k], *(columns[c][k] for c in STATS), audit)
            yield pack(done, batch.schema.field(0).type)
        if edits:
            yield pack([end()], batch.schema.field(0).type)

    def pack(done, key):
        columns = list(zip(*done, strict=True)) or [()] * (len(STATS) + 3)
        kinds = [key, *[pa.int64()] * len(STATS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv", *STATS, "audit", "repaired_sha256"])

    return _with_plans(rows, plans).mapInArrow(run, StructType([*plans.schema.fields, StructField("repaired_sha256", StringType())]))


def conversation_repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Per conversation of ids (one column conv): gaps, faults, cost, audit and the digest of what the edits give.

    rows: conv, turn, role, text and copy, as damage() returns them. Rows without a conversation are one. Faults: blank,
    repeated (role and text were there before), truncated; the first counts. Rows of one turn stand by role and a hash of
    their text. Roles whose initial is none of s, u and a cannot be kept. A conversation without rows has zeros and an
    empty audit; without conversations there are no rows.
    """
    return repair_digests(rows, plan_repairs(rows, ids.distinct()))
