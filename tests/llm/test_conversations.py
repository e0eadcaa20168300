import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from postwright.llm import conversations as cv
from postwright.llm.queries import QUERIES

LEGAL = re.compile(r"(s?(ua)+)?")
FULL = {"s": "system", "u": "user", "a": "assistant"}


def damage(rows):
    """``{conv_id: damaged rows}`` by the contract, in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        own.extend([(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1))
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def faults(turns):
    seen, out = set(), []
    for turn, role, text in turns:
        body = text.rstrip(cv.BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(turns):
    """``(cost, audit)`` by keeping every state's least pair of cost and whole audit."""

    def put(front, s, pair):
        if s not in front or pair < front[s]:
            front[s] = pair

    def inserted(front):
        for _ in range(4):
            for s, (c, a) in list(front.items()):
                put(front, "a" if s == "u" else "u", (c + 3, a + "I"))
        return front

    front = inserted({"": (0, "")})
    for _, role, _, fault in turns:
        new = {}
        for s, (c, a) in front.items():
            put(new, s, (c + 4, a + "D"))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                put(new, "a" if s == "u" else "u", (c + 3 + more, a + "R"))
                if (s, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    put(new, role[:1], (c + more, a + "K"))
        front = inserted(new)
    return min(front[s] for s in ("", "a") if s in front)


def replay(turns, audit):
    """The repaired ``(role, text)`` of an audit."""
    out, rest = [], iter(turns)
    for e in audit:
        was = out[-1][0][0] if out else ""
        now = "assistant" if was == "u" else "user"
        if e == "I":
            out.append((now, ""))
            continue
        _, role, text, _ = next(rest)
        if e != "D":
            out.append((role if e == "K" else now, text))
    assert next(rest, None) is None and LEGAL.fullmatch("".join(r[0] for r, _ in out))
    return out


def expected(turns):
    f = faults(turns)
    known = [t for t, *_ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit = cheapest(f)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in replay(f, audit)).encode()).hexdigest()
    return (gaps, *[sum(x[3] == k for x in f) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)


def by_enumeration(turns):
    """The least of all sequences of edits with up to two insertions at a place."""
    best = None
    for letters in itertools.product("DKR", repeat=len(turns)):
        for gaps in itertools.product(range(3), repeat=len(turns) + 1):
            audit = "I" * gaps[0] + "".join(x + "I" * g for x, g in zip(letters, gaps[1:], strict=True))
            state, cost, k, good = "", 0, 0, True
            for e in audit:
                now = "a" if state == "u" else "u"
                if e == "I":
                    state, cost = now, cost + 3
                    continue
                _, role, _, fault = turns[k]
                k += 1
                if e == "D":
                    cost += 4
                    continue
                if fault in ("blank", "duplicate") or e == "K" and (state, role[:1]) not in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    good = False
                    break
                cost += (3 if e == "R" else 0) + (3 if fault == "truncated" else 0)
                state = role[:1] if e == "K" else now
            if good and state in ("", "a") and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def mine(turns):
    got = list(cv.edits(iter(turns)))
    return sum(e[1] for e in got), "".join(e[0] for e in got), [(e[2], e[3]) for e in got if e[0] != "D"]


def some(rng, n):
    return [(k, rng.choice(["user", "assistant", "system", "tool", ""]), f"t{k}", rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for k in range(n)]


def test_small_conversations_by_enumeration():
    rng = random.Random(3)
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3):
        for _ in range(6):
            turns = some(rng, n)
            assert cheapest(turns) == by_enumeration(turns) == mine(turns)[:2], turns


@pytest.mark.parametrize("n", [5, 12, 60, 300])
def test_edits_equal_whole_strings(n):
    rng = random.Random(n)
    for _ in range(60):
        turns = some(rng, n)
        cost, audit, kept = mine(turns)
        assert (cost, audit) == cheapest(turns) and kept == replay(turns, audit)


def test_memory_stays_bounded():
    """Edits are given out while turns still come, and the tree holds the open ones only."""
    rng = random.Random(1)
    trellis, most, given = cv.Trellis(), 0, 0
    for turn in some(rng, 20_000):
        trellis.step(turn)
        given += len(list(trellis.settled()))
        held, todo = set(), [node for _, node in trellis.front.values()]
        for node in todo:
            while node is not None and id(node) not in held:
                held.add(id(node))
                node = node.parent
        most = max(most, len(held))
    assert given > 19_000 and most < 400


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = sorted((k, *expected(v)) for k, v in damage(rows).items())
    got = sorted(tuple(r) for r in QUERIES["op11_conversation_repair"](spark, sf_dir).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect())
    assert got == want


def test_awkward_conversations(spark):
    long = "word " * 40_000 + "."
    rows = [(None, 1, "user", "hi."), (None, None, None, None), (None, None, "user", "."), (1, None, "user", "a."), (1, -5, None, "x."), (1, 9, "assistant", None), (1, 9, "assistant", "b"), (1, 9, "assistant", "b"), (2, 1, "System", long), (2, 2, "", "é!"), (3, 7, "user", "?\x0b\n ")]
    rows += [(4, k, "user", f"u{k}.") for k in range(500)] + [(5, k // 2, ["user", "assistant"][k % 2], "same.") for k in range(40)] + [(k, 3, "user", "one.") for k in range(100, 160)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("gone", "nth", "fault", "case", "said", "who", "copy", "step", "edit"):
        d = d.withColumn(c, F.lit("clash"))
    got = {r[0]: tuple(r)[1:] for r in cv.digests(cv.repaired(cv.damaged(d), gone="gone")).collect()}
    want = {k: expected(v) for k, v in damage(rows).items()}
    assert got == want and any(v[-2] == "" for v in got.values())
    assert cv.digests(cv.repaired(cv.damaged(d.limit(0)), gone="gone")).count() == 0


def test_repaired_turns(spark):
    rows = [("x", 1, "user", "q?"), ("x", 2, "user", "a."), ("x", 3, "assistant", "  "), ("x", 4, "user", "bye.")]
    got = [(r["step"], r["edit"], r["role"], r["text"], r["fault"]) for r in cv.repaired(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()]
    assert got == [(0, "K", "user", "q?", None), (1, "I", "assistant", "", None), (2, "K", "user", "a.", None), (3, "D", None, None, "blank"), (4, "R", "assistant", "bye.", None)]


def test_rows_are_dealt_once(spark, sf_dir):
    plan = QUERIES["op11_conversation_repair"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
