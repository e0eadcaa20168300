"""Repair of conversations at least cost by survivor-coalescence Viterbi (operator 11).

A repaired conversation has the roles ``(system? (user assistant)+)?``. A trellis with a state for
each role that may stand last goes through a conversation's turns; a state's survivor is its cheapest
sequence of edits, the least in ASCII order among equally cheap ones. Survivors
are leaves of one tree of backpointers, whose nodes count who refers to them. Where all
survivors share an ancestor, the edits up to it are final: they leave the tree and are given out.
So a task holds the open suffixes only, however long a conversation is, and ties are
decided by comparing these suffixes as a whole.

Turns reach a task in order and are streamed; a conversation's digest is a chain over its
turns, so one task follows one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from postwright.llm.common import NOT_BLANK, table

#: Costs of the edits: a new role, a deleted turn, an inserted turn, a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a role that was set or inserted, by the state before.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: The state after a turn that keeps its role, by its initial and the state before.
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Turns after which open edits are looked through for a common ancestor, at least.
LOOK = 16
#: Rows and characters of a batch that a task gives out.
ROWS, CHARS = 2000, 4_000_000

BLANKS = " \t\n\x0b\x0c\r"
EDITS = "conv_id {id}, step bigint, edit string, cost int, role string, text string, turn bigint, old_role string, fault string"


class Node:
    """An edit; ``refs`` counts its children and the survivors that end with it."""

    __slots__ = ("depth", "edit", "parent", "refs", "role", "turn")

    def __init__(self, parent, edit: str, role: str | None, turn):
        self.parent, self.edit, self.role, self.turn, self.refs = parent, edit, role, turn, 0
        self.depth = 0
        if parent is not None:
            self.depth = parent.depth + 1
            parent.refs += 1


def release(node: Node | None) -> None:
    """Drop one reference; edits that nobody refers to any more leave the tree."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        up, node.parent = node.parent, None
        node = up


def earlier(a: Node, b: Node) -> bool:
    """Whether the edits up to ``a`` come before those up to ``b`` in ASCII order; only what follows their last common edit is compared."""
    one, two = [], []
    while a is not b:
        if a.depth >= b.depth:
            one.append(a.edit)
            a = a.parent
        else:
            two.append(b.edit)
            b = b.parent
    return one[::-1] < two[::-1]


class Trellis:
    """The survivors of a conversation so far."""

    def __init__(self) -> None:
        self.root = Node(None, "", None, None)
        self.root.refs = 1
        self.front: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.wait, self.since = LOOK, 0
        self.insert(self.front)

    @staticmethod
    def offer(front: dict, state: int, cost: int, parent: Node, edit: str, role: str | None, turn) -> bool:
        """Let an edit compete for a state; its node stays if it wins."""
        held = front.get(state)
        if held is not None and held[0] < cost:
            return False
        node = Node(parent, edit, role, turn)
        if held is not None and held[0] == cost and not earlier(node, held[1]):
            node.refs = 1
            release(node)
            return False
        node.refs = 1
        front[state] = (cost, node)
        if held is not None:
            release(held[1])
        return True

    def insert(self, front: dict) -> None:
        """Insertions between turns: more than a round through the states never pays."""
        changed = True
        while changed:
            changed = False
            for state in sorted(front):
                cost, node = front[state]
                changed |= self.offer(front, NEXT[state], cost + INSERT, node, "I", NAMES[NEXT[state]], None)

    def step(self, turn: tuple) -> None:
        """``turn`` is ``(turn, role, text, fault)``."""
        _, role, _, fault = turn
        new: dict[int, tuple[int, Node]] = {}
        stays = TRUNCATED if fault == "truncated" else 0
        for state, (cost, node) in self.front.items():
            self.offer(new, state, cost + DELETE, node, "D", None, turn)
            if fault not in ("blank", "duplicate"):
                to = KEEPS.get(role[:1], {}).get(state)
                if to is not None:
                    self.offer(new, to, cost + stays, node, "K", role, turn)
                self.offer(new, NEXT[state], cost + REROLE + stays, node, "R", NAMES[NEXT[state]], turn)
        self.insert(new)
        # what may follow START or SYSTEM may follow ASSISTANT too, but for a system turn, which could be deleted there
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            if state in new and new[state][0] > new[ASSISTANT][0] + more:
                release(new.pop(state)[1])
        for _, node in self.front.values():
            release(node)
        self.front = new

    def settled(self, last: bool = False) -> Iterator[Node]:
        """The edits that all survivors share and that weren't given out yet; at the end those of the best survivor."""
        self.since += 1
        if last:
            best, *others = [self.front[s] for s in (START, ASSISTANT) if s in self.front]
            for other in others:
                if other[0] < best[0] or other[0] == best[0] and earlier(other[1], best[1]):
                    best = other
            yield from self._down(best[1])
        elif self.since >= self.wait:
            path = self._down(next(iter(self.front.values()))[1])
            open_ = len(path)
            for node in path:
                if self.root.refs > 1:
                    break
                yield node
                node.parent, self.root = None, node
                open_ -= 1
            self.wait, self.since = max(LOOK, open_), 0  # looking costs no more than the turns between

    def _down(self, node: Node) -> list[Node]:
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1]


def edits(turns: Iterator[tuple]) -> Iterator[tuple]:
    """``(edit, cost, role, text, turn, old_role, fault)`` of a conversation's turns, in order and as soon as they are final."""
    trellis = Trellis()
    for turn in turns:
        trellis.step(turn)
        yield from map(_given, trellis.settled())
    yield from map(_given, trellis.settled(last=True))


def _given(node: Node) -> tuple:
    turn, old, text, fault = node.turn or (None, None, "", None)
    if node.edit == "D":
        return "D", DELETE, None, None, turn, old, fault
    cost = {"K": 0, "R": REROLE, "I": INSERT}[node.edit] + (TRUNCATED if fault == "truncated" else 0)
    return node.edit, cost, node.role, text, turn, old, fault


def faults(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """``(conv_id, turn, role, text, fault, gone)``, each conversation in one task and in order: by turn, nulls first, then role and text.

    A fault is ``blank`` (no character but blanks), else ``duplicate`` (role and text of
    an earlier turn), else ``truncated`` (the last such character isn't one of ``.!?``).
    Null roles and texts are one space. Rows that ``gone`` marks only name their conversation.
    """
    missing = F.coalesce(F.col(f"`{gone}`"), F.lit(False)) if gone else F.lit(False)
    one = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.when(~missing, one(role)).alias("role"), F.when(~missing, one(text)).alias("text"), missing.alias("gone")
    )
    # the rows of a conversation are dealt once; the window and the order after it need no other exchange
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    fault = F.when(~F.col("text").rlike(NOT_BLANK), "blank").when(F.col("nth") > 1, "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    return (
        rows.repartition("conv_id").withColumn("nth", nth).select("conv_id", "turn", "role", "text", F.when(~F.col("gone"), fault).alias("fault"), "gone")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    )


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """The cheapest edits of every conversation, a row each: ``(conv_id, step, edit, cost, role, text, turn, old_role, fault)``.

    Edits are K(eep), R(erole), D(elete) and I(nsert), in order; ``role`` and ``text`` are those of the
    repaired turn, null if it was deleted. Turns without a role or text have one space; null turns
    come first, equal ones in order of role and text; null ``conv_id`` is one conversation. A
    conversation without edits has one row without an edit. Rows come conversation by conversation, in order of
    ``step``, within each partition. Extra columns don't matter; an empty table gives no row.
    """
    rows = faults(turns, conv, turn, role, text, gone)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for conv_id, group in conversations(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True)):
            n = 0
            for n, edit in enumerate(edits(row[:4] for row in group if not row[4]), 1):
                out.append((conv_id, n - 1, *edit))
                chars += len(edit[3] or "")
                if len(out) >= ROWS or chars >= CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, chars = [], 0
            if not n:
                out.append((conv_id, *[None] * 8))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = [c.split()[0] for c in EDITS.split(", ")]
    types = [to_arrow_type(rows.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return rows.select("conv_id", "turn", "role", "text", "fault", "gone").mapInArrow(run, EDITS.format(id=kind))


def conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Split rows by their first value, without holding a conversation: ``(id, iterator of the rest)``."""
    rows = iter(rows)
    ahead = next(rows, None)
    while ahead is not None:
        conv_id = ahead[0]

        def group():
            nonlocal ahead
            while ahead is not None and ahead[0] == conv_id:
                now, ahead = ahead, next(rows, None)
                yield now[1:]

        own = group()
        yield conv_id, own
        for _ in own:
            pass


def digests(edited: DataFrame) -> DataFrame:
    """A row for each conversation of ``repaired``: counts of its faults, cost, audit and the digest of the repaired turns.

    It reads the partitions of ``repaired`` in their order and moves no row.
    """
    kind = edited.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, group in conversations(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True)):
            out.append((conv_id, *digest(group)))
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    types = [to_arrow_type(edited.schema["conv_id"].dataType), *[pa.int64()] * 6, pa.string(), pa.string()]
    return edited.mapInArrow(run, f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def digest(group: Iterator[tuple]) -> tuple:
    """``(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)`` of a conversation's edits."""
    first = last = before = None
    distinct = illegal = cost = 0
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    audit, sha, begun = [], hashlib.sha256(), False
    for _, edit, price, role, text, turn, old, fault in group:
        if edit is None:
            continue
        audit.append(edit)
        cost += price
        if edit != "D":
            sha.update((("\n" if begun else "") + f"{role}:{text}").encode())
            begun = True
        if edit == "I":
            continue
        if fault:
            count[fault] += 1
        initial = old[:1]
        illegal += before is not None and before + initial not in ("su", "ua", "au")
        before = initial
        if turn is not None and turn != last:
            first, last, distinct = turn if first is None else first, turn, distinct + 1
    gaps = 0 if first is None else min(last - first + 1 - distinct, (1 << 63) - 1)
    return gaps, *count.values(), illegal, cost, "".join(audit), sha.hexdigest()


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``turns`` after faults planted by crc32 of ``conv_id:turn`` modulo 20, as ``(conv_id, turn, role, text, gone)``.

    0 drops a row (``gone`` marks it), 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it the user's. Nulls are one space.
    """
    one = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    case = F.crc32(F.concat(one(conv), F.lit(":"), one(turn)).cast("binary")) % 20
    said: Column = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("said", "[.!?]", "")).otherwise(F.col("said"))
    rows = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), one(role).alias("who"), one(text).alias("said"), case.alias("case"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("who")).alias("role"), said.alias("text"), (F.col("case") == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("case") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repaired(damaged(table(spark, sf_dir, "conversations")), gone="gone"))


def _sql() -> str:
    """The same by recursion over the turns: a state holds its cost, in nine digits, and its whole audit in one text, so that texts compare as pairs."""
    plus = lambda p, cost, edit: f"printf('%09d', CAST(left({p}, 9) AS BIGINT) + {cost}) || substr({p}, 10) || '{edit}'"
    put = lambda p: plus(p, INSERT, "I")
    keep = lambda p, initial: f"CASE WHEN free AND initial = '{initial}' THEN {plus(p, 'more', 'K')} END"
    rerole = lambda p: f"CASE WHEN free THEN {plus(p, f'{REROLE} + more', 'R')} END"
    step = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: {step})), 4294967295) % 20 AS code FROM named
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE code WHEN 0 THEN CAST([] AS INTEGER[]) WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded
), placed AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM damaged
), turns AS MATERIALIZED (
  SELECT *, fault IS NULL OR fault = 'truncated' AS free, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS more, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before
  FROM (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed)
), best(conv_id, n, q0, q1, q2, q3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), '00000000{INSERT}I', '00000000{2 * INSERT}II' FROM conversations
  UNION ALL
  SELECT conv_id, n, p0, p1, p2_, least(p3, {put("p2_")}) FROM (SELECT *, least(p2, {put("p0")}, {put("p1")}, {put("p3")}) AS p2_ FROM (
    SELECT b.conv_id, t.n, {plus("q0", DELETE, "D")} AS p0, least({plus("q1", DELETE, "D")}, {keep("q0", "s")}) AS p1,
      least({plus("q2", DELETE, "D")}, {rerole("q0")}, {rerole("q1")}, {rerole("q3")}, {keep("q0", "u")}, {keep("q1", "u")}, {keep("q3", "u")}) AS p2,
      least({plus("q3", DELETE, "D")}, {rerole("q2")}, {keep("q2", "a")}) AS p3
    FROM best b JOIN turns t ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND t.n = b.n + 1))
), done AS (
  SELECT conv_id, CAST(left(p, 9) AS BIGINT) AS cost, substr(p, 10) AS audit FROM (SELECT conv_id, arg_max(least(q0, q3), n) AS p FROM best GROUP BY conv_id)
), letters AS (
  SELECT conv_id, i, substr(audit, CAST(i AS INTEGER), 1) AS e, length(replace(left(audit, CAST(i AS INTEGER)), 'I', '')) AS n FROM done, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS i)
), kept AS (
  SELECT l.conv_id, l.i, l.e, t.role, t.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.i) - 1 AS nth, first_value(l.e = 'K' AND left(t.role, 1) = 's') OVER (PARTITION BY l.conv_id ORDER BY l.i) AS system
  FROM letters l LEFT JOIN turns t ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.n = t.n AND l.e <> 'I' WHERE l.e <> 'D'
), whole AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (nth - CAST(system AS INTEGER)) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS said FROM kept GROUP BY conv_id
), counted AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM done d LEFT JOIN whole w ON d.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN counted c ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP11_SQL = _sql()
