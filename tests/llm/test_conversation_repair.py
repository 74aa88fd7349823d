import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from inkweave.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, present boolean, key string, fault int, edit string"
GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """First fault of each row (role, text): 0 none, 1 blank, 2 duplicate, 3 truncated."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Edits by costs to go, from the last row back; then the least letters that stay on a cheapest way."""
    found, n = faults(rows), len(rows)
    togo = [[0] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        togo[i] = [0, 4, 2, 0] if i == n else [min(c + (0 if e == "I" else togo[i + 1][t]) for e, c, t in ways(q, rows[i][0], found[i]) if e != "I") for q in range(4)]
        for _ in range(3):
            togo[i] = [min(x, 2 + togo[i][repair.NEXT[q]]) for q, x in enumerate(togo[i])]
    out, i, q, spent = "", 0, 0, 0
    while i < n or q not in (0, 3):
        options = ways(q, rows[i][0], found[i]) if i < n else [("I", 2, repair.NEXT[q])]
        e, c, q2 = min((e, c, t) for e, c, t in options if c + togo[i if e == "I" else i + 1][t] == togo[i][q])
        out, spent, q, i = out + e, spent + c, q2, i + (e != "I")
    assert spent == togo[0][0]
    return out, spent


def ways(state, role, fault):
    cut, out = fault == 3, [("D", 3, state), ("I", 2, repair.NEXT[state])]
    if fault in (0, 3):
        out.append(("R", 2 + cut, repair.NEXT[state]))
        if (state, role[:1]) in repair.KEPT:
            out.append(("K", 0 + cut, repair.KEPT[state, role[:1]]))
    return out


def applied(rows, audit):
    out, i, last = [], 0, ""
    for e in audit:
        if e != "I":
            role, text = rows[i]
            i += 1
        else:
            text = ""
        if e == "D":
            continue
        if e in "IR":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        out.append((role, text))
    assert i == len(rows) and GOOD.fullmatch("".join(r[:1] for r, _ in out))
    return out


def walked(rows):
    out, most = [], 0
    walk = repair.Survivors(lambda e, row: out.append((e, row)))
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        walk.add(role[:1], fault, (role, text))
        most = max(most, max(node.depth for _, node in walk.live.values()) - walk.root.depth)
    return "".join(e for e, _ in out), walk.end(), "".join(e for e, _ in out), most, [row for e, row in out if e != "I"]


@pytest.mark.parametrize("seed", range(6))
def test_edits_equal_the_backward_search(seed):
    r = random.Random(seed)
    for _ in range(400):
        roles = r.choice([["user", "assistant"], ["user"], ["assistant"], ["system", "user", "assistant", "tool", ""], ["user", "assistant", "system"]])
        rows = [(r.choice(roles), r.choice(["a.", "b!", "c", "d?", " ", "e.", "f.", f"{r.random()}.", f"{r.random()}."])) for _ in range(r.randint(0, 30))]
        _, cost, audit, _, given = walked(rows)
        assert (audit, cost) == cheapest(rows), rows
        assert given == rows
        applied(rows, audit)


def test_memory_follows_the_open_part():
    r = random.Random(9)
    rows = [(("user", "assistant")[(k + (k > 900)) % 2] if r.random() > 0.05 else "user", f"{k}.") for k in range(3000)]
    early, cost, audit, most, _ = walked(rows)
    assert (audit, cost) == cheapest(rows) and most < 200 and len(early) > 2800


def test_long_ties_are_compared_whole():
    rows = [("user", f"{k}.") for k in range(4001)]
    _, cost, audit, _, _ = walked(rows)
    assert (audit, cost) == cheapest(rows)
    assert walked([])[1:3] == (0, "")


def expected(rows):
    """rows: (turn, role, text) -> summary without the key."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    bare = [(r, x) for _, r, x in rows]
    found, turns = faults(bare), [t for t, _, _ in rows if t is not None]
    audit, cost = cheapest(bare)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(bare, bare[1:], strict=False))
    text = "\n".join(f"{r}:{x}" for r, x in applied(bare, audit))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, found.count(1), found.count(2), found.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_odd_conversations(spark):
    r = random.Random(4)
    rows = [(r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, 0, 1, 2, 3, 9]), r.choice([None, "", "user", "assistant", "system", "Üser"]), r.choice([None, "", " ", "x.", "y!\n ", "zé", "a b." * 9000, "q?"]))
            for _ in range(160)]
    table = [(*row, True, "k", 1, "e") for row in rows] + [(77, 1, "user", "x.", False, "k", 1, "e"), (1, 50, "user", "lost", False, "k", 1, "e")]
    turns = spark.createDataFrame(table, SCHEMA).repartition(4)
    got = {x[0]: tuple(x)[1:] for x in repair.summary(turns, F.col("present")).collect()}
    want = {c: expected([row[1:] for row in rows if row[0] == c]) for c in {row[0] for row in rows}}
    assert got == {**want, 77: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    edits = {}
    for x in repair.repaired(turns.where("present")).orderBy("conv_id", "edit_no").collect():
        edits.setdefault(x["conv_id"], []).append(x)
    for c, found in edits.items():
        assert "".join(x["edit"] for x in found) == want[c][6]
        text = "\n".join(f"{x['role']}:{x['text']}" for x in found if x["edit"] != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == want[c][7]
    assert repair.summary(turns.limit(0)).collect() == [] and repair.repaired(turns.limit(0)).collect() == []


def test_a_conversation_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = [(k, ("user", "assistant")[k % 2], f"{k}.") for k in range(100)]
    turns = spark.createDataFrame([(5, *row, True, "", 0, "") for row in rows], SCHEMA)
    got = repair.summary(turns).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [tuple(x)[1:] for x in got] == [expected(rows)]
    assert "Exchange" in (plan := repair.summary(turns)._jdf.queryExecution().executedPlan().toString()) and plan.count("Exchange") == 1
