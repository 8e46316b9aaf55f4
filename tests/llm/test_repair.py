"""Conversation repair against all edits, and its stretches against whole conversations."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest

from strophe.llm import repair

COST = {"K": 0, "R": 2, "D": 3, "I": 2}


def all_edits(rows):
    """(cost, audit) of the best of all edits of a few rows, by trying all of them with up to two inserts at any place."""
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(must and e != "D" for e, (_, must, _) in zip(edits, rows)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            state, ok, cost, audit = repair.NOTHING, True, 0, ""
            for n, (e, row) in zip(inserts, [*zip(edits, rows), (None, None)]):
                for _ in range(n):
                    state = repair.NEXT[state][0]
                audit += "I" * n
                cost += 2 * n
                if e is None:
                    continue
                audit, cost = audit + e, cost + COST[e] + (e != "D" and row[2])
                if e == "R":
                    state = repair.NEXT[state][0]
                elif e == "K":
                    ok = ok and row[0] in repair.FOLLOWS[state]
                    state = repair.FOLLOWS[state].get(row[0])
                if not ok:
                    break
            if ok and state in repair.ENDS and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def forward(rows):
    """(cost, audit) row by row, for conversations too long to try all."""
    def inserted(front):
        for _ in range(2):
            for s, (c, a) in list(front.items()):
                to = repair.NEXT[s][0]
                front[to] = min(front.get(to, (10**9, "")), (c + 2, a + "I"))
        return front

    front = inserted({repair.NOTHING: (0, "")})
    for initial, must, cut in rows:
        new = {}
        for s, (c, a) in front.items():
            steps = [(s, c + 3, a + "D")]
            if not must:
                steps.append((repair.NEXT[s][0], c + 2 + cut, a + "R"))
                if initial in repair.FOLLOWS[s]:
                    steps.append((repair.FOLLOWS[s][initial], c + cut, a + "K"))
            for to, cost, audit in steps:
                new[to] = min(new.get(to, (10**9, "")), (cost, audit))
        front = inserted(new)
    return min(front[s] for s in repair.ENDS if s in front)


def some_rows(rng, n):
    out = []
    for _ in range(n):
        must = rng.random() < 0.2
        out.append((str(rng.choice(["s", "u", "a", "x", ""])), must, not must and rng.random() < 0.3))
    return out


def best(ways):
    return min(ways[repair.NOTHING, s] for s in repair.ENDS if (repair.NOTHING, s) in ways)


def test_search_is_the_best_of_all_edits():
    rng = np.random.default_rng(1)
    for _ in range(150):
        rows = some_rows(rng, int(rng.integers(0, 5)))
        assert best(repair.search(rows, repair.NOTHING, repair.ENDS)) == all_edits(rows) == forward(rows)


@pytest.mark.parametrize("piece", [1, 3, 16])
def test_pieces_give_what_the_whole_gives(piece):
    rng = np.random.default_rng(piece)
    for n in (1, 5, 40, 130):
        rows = some_rows(rng, n)
        pieces = [{k: v for s in range(4) for k, v in repair.search(rows[i : i + piece], s, None).items()} for i in range(0, n, piece)]
        assert best(repair.through(pieces)) == forward(rows)


def by_hand(rows):
    """The report of each conversation by plain Python over whole conversations."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        n, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if n == 0:
            continue
        text = "" if n == 1 else "".join(c for c in text if c not in ".!?") if n == 2 else text
        out[conv] += [(turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    done = []
    for conv, given in out.items():
        given.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, flags, counts = set(), [], [0, 0, 0]
        for _, role, text in given:
            body = text.strip(" \t\n\v\f\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            flags.append((role[:1], fault in (0, 1), fault == 2))
        turns = [t for t, _, _ in given if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(given, given[1:]))
        cost, audit = forward(flags)
        said, state, left = [], repair.NOTHING, iter(given)
        for e in audit:
            if e == "I":
                state, role = repair.NEXT[state]
                said.append(f"{role}:")
                continue
            _, role, text = next(left)
            if e == "K":
                state = repair.FOLLOWS[state][role[0]]
            elif e == "R":
                state, role = repair.NEXT[state]
            if e != "D":
                said.append(f"{role}:{text}")
        done.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(done, key=str)


@pytest.mark.parametrize("partitions, piece", [(4, 256), (23, 5)])
def test_report_is_that_of_whole_conversations(spark, monkeypatch, partitions, piece):
    """One conversation has most of the rows, so its stretches lie in many tasks."""
    monkeypatch.setattr(repair, "PIECE", piece)
    rng = np.random.default_rng(7)
    texts = ["Yes.", "No", "", " \n", "Why?", "Because of that", "Well. ", None]
    rows = []
    for conv in [0] * 300 + list(range(1, 40)) * 4 + [None] * 30:
        role = [None, "", "system", "user", "assistant", "tool", "sys", "U"][int(rng.choice(8, p=[0.05, 0.03, 0.07, 0.4, 0.35, 0.04, 0.03, 0.03]))]
        rows.append((conv, None if rng.random() < 0.05 else int(rng.integers(0, 400)), role, texts[int(rng.integers(0, 8))] if rng.random() < 0.5 else f"Text {rng.integers(0, 1000)}."))
    rows += rows[::20] * 2
    rows += [(50, 0, "user", "Hello. " * 20000), (50, 1, "assistant", "End")]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, digest int")
        got = [tuple(r) for r in repair.report(frame).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted(got, key=str) == by_hand(rows)


def test_dropped_conversations_and_empty_tables(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = repair.report(spark.createDataFrame([(5, turn, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert repair.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_repaired_rows_take_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Are you there?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Hello."), (3, 0, "system", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, repair.repaired(frame, repair.audits(frame)).collect()))
    assert got == [(1, 1, "user", "Hi."), (1, 2, "assistant", ""), (1, 3, "user", "Are you there?"), (1, 4, "assistant", "Yes."), (2, 1, "user", ""), (2, 2, "assistant", "Hello.")]
