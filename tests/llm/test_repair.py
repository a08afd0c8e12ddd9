"""Conversation repair against an exhaustive search and against SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

import __spark_entry__ as driver
from nightgrid.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def search(rows):
    """(cost, audit, repaired rows) by uniform-cost search over edits; rows of (role, text, has to go, truncated)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, out = heapq.heappop(heap)
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, list(out)
        if (at, initials) in done or len(initials) > len(rows) + 3:
            continue
        done.add((at, initials))
        legal = lambda s: re.fullmatch(r"s?(ua)*u?", s)
        for role in ("user", "assistant"):
            if legal(initials + role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", at, initials + role[0], (*out, (role, ""))))
        if at < len(rows):
            role, text, gone, cut = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, initials, out))
            if not gone:
                if role[:1] and legal(initials + role[:1]):
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, initials + role[:1], (*out, (role, text))))
                for other in ("user", "assistant"):
                    if legal(initials + other[0]):
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", at + 1, initials + other[0], (*out, (other, text))))


def judge(rows):
    """Rows of (turn, role, text) in order to (counts, rows for ``search``)."""
    seen, counts, judged = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        last = BLANK.findall(text)
        blank, again, cut = not last, (role, text) in seen, bool(last) and last[-1] not in ".!?"
        seen.add((role, text))
        fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
        if fault:
            counts[fault] += 1
        judged.append((role, text, blank or again, cut))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    turns = [t for t, *_ in rows if t is not None]
    return counts | {"illegal": sum(p not in ("su", "ua", "au") for p in pairs), "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0}, judged


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fate = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub(r"[.!?]", "", text) if fate == 2 else text
            out += [(conv_id, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def expected(rows, ids):
    want = {}
    for conv_id in ids:
        mine = sorted(((t, r, x) for c, t, r, x in rows if c == conv_id),
                      key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        counts, judged = judge(mine)
        cost, audit, out = search(judged)
        want[conv_id] = counts | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}
    return want


def as_dict(found):
    rows = [r.asDict() for r in found.collect()]
    out = {r.pop("conv_id"): r for r in rows}
    assert len(out) == len(rows)
    return out


def test_edits_equal_a_search():
    rng, transitions = random.Random(8), repair.Transitions()
    for _ in range(1500):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", " ", "c?", "a."])) for _ in range(rng.randrange(9))]
        _, judged = judge([(i, *r) for i, r in enumerate(rows)])
        talk, seen = repair.Conversation(transitions), set()
        for turn, (role, text) in enumerate(rows):
            talk.add(turn, role, text.encode(), not text.strip(), (role, text) in seen, text.strip()[-1:] not in (".", "?"))
            seen.add((role, text))
        cost, audit = talk.edits()
        assert (cost, audit.decode()) == search(judged)[:2]


@pytest.mark.parametrize("kept,stretch", [(256, 1024), (3, 2)])
def test_long_runs_unroll(monkeypatch, kept, stretch):
    """Runs longer than a stretch, and more runs than are kept, give what one row at a time gives."""
    monkeypatch.setattr(repair, "KEPT_RUNS", kept)
    monkeypatch.setattr(repair, "STRETCH", stretch)
    rng = random.Random(3)
    symbols = [s for _ in range(12) for s in [rng.randrange(9)] * rng.choice([1, 2, 700, 1500])]
    talk = repair.Conversation(repair.Transitions())
    for s in symbols:
        if talk.symbols and talk.symbols[-1] == s:
            talk.lengths[-1] += 1
        else:
            talk.symbols.append(s)
            talk.lengths.append(1)
    costs = [repair.AT_END]
    for s in reversed(symbols):
        costs.append(repair.advance(repair.Transitions().step(s), costs[-1]))
    costs.reverse()
    state, audit = repair.START, bytearray()
    for at, s in enumerate(symbols):
        state = talk._choose(s, state, costs[at], costs[at + 1], audit)
    audit += b"I" * ({repair.USER: 1, repair.SYSTEM: 2}.get(state, 0))
    assert talk.edits() == (costs[0][repair.START], audit)


def test_query_equals_search_and_sql(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = as_dict(driver.queries()["op12_structure_repair"](spark, data_dir))
    assert found == expected(damaged(rows), {r[0] for r in rows})
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{data_dir}/conversations.parquet'")
    names = [n for n, *_ in con.sql(repair.sql()).description]
    assert {(r := dict(zip(names, row))).pop("conv_id"): r for row in con.sql(repair.sql()).fetchall()} == found


def test_awkward_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "system", "Be."), (1, None, None, None), (1, 5, "assistant", "x" * 200_000), (1, 9, "", "No."),
            (None, None, "user", None), (None, 2, "assistant", "é?\x0b"), (None, 2, "assistant", "é?\x0b"), (3, None, None, None), (4, 1, "tool", " "),
            (5, 3, "user", "a."), (5, 4, "assistant", "b."), (5, 5, "user", "a."), (5, 6, "assistant", "b."), (6, 2, "user", "q?"), (6, 2, "assistant", "b!"), (6, 2, "zed", "b!")]
    df = spark.createDataFrame([(*r, 0, "x", True) for r in rows], "conv_id long, turn long, role string, text string, step int, mark string, seen boolean").repartition(4)
    plain = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    ids = {r[0] for r in rows}
    assert as_dict(repair.digests(repair.repair(df))) == expected(plain, ids)
    assert as_dict(repair.digests(repair.repair(repair.damage(df), df))) == expected(damaged(rows), ids)
    kept = [(r.position, r.edit, r.role, r.text) for r in repair.repair(df).where("conv_id = 5 and position is not null").collect()]
    assert kept == [(0, "K", "user", "a."), (1, "K", "assistant", "b.")]
    assert repair.digests(repair.repair(df.limit(0))).collect() == []


def test_every_row_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(7, turn, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.digests(repair.repair(repair.damage(df), df)).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
