"""Sections and affinities as relations: nested and odd inputs."""

import math

import numpy as np
from pyspark.sql import functions as F

from strophe.operators import inlining as I
from strophe.operators import spectral as P


def plain_inlined(rules):
    """One dictionary {parent: [child, ...]}: repetitions that are parts of others are written out until there is none."""
    rules = {k: list(v) for k, v in rules.items()}
    while True:
        flat = [k for k, v in rules.items() if len(set(v)) == 1 and v[0] != k and any(k in w for o, w in rules.items() if o != k)]
        ready = [k for k in flat if any(k in w for o, w in rules.items() if o not in flat or True)]
        if not ready:
            return rules
        k = min(ready, key=lambda x: (sum(x in v for v in rules.values()), x))
        rules = {o: [y for x in v for y in (rules[k] if x == k else [x])] for o, v in rules.items() if o != k}


def rows(key, rules):
    return [(key, p, n, c) for p, v in rules.items() for n, c in enumerate(v)]


def test_repetitions_within_repetitions_are_written_out(spark):
    cases = {
        1: {"S": ["A", "b", "B"], "A": ["a", "a"], "B": ["A", "A"], "C": ["a", "b"]},
        2: {"S": ["A", "A"], "A": ["B", "B"], "B": ["x", "x", "x"]},
        3: {"S": ["a", "b"], "T": ["S", "A"], "A": ["c"]},
        4: {"A": ["A", "A"], "S": ["A", "x"]},  # holds itself
        5: {"A": ["a", "a"]},  # part of none
    }
    df = spark.createDataFrame([(*r, 1) for k, v in cases.items() for r in rows(k, v)], "key int, parent string, ord int, child string, k int")
    got = {}
    for r in I.inlined(df, "key").collect():
        got.setdefault(r.key, {}).setdefault(r.parent, {})[r.ord] = r.child
    got = {k: {p: [d[n] for n in range(len(d))] for p, d in v.items()} for k, v in got.items()}
    assert got == {k: plain_inlined(v) for k, v in cases.items()}
    assert I.inlined(df.where("key > 9"), "key").count() == 0


def test_contained_sections(spark):
    rng = np.random.default_rng(1)
    sections = [(int(k), f"s{n}", rng.integers(0, 3, int(rng.integers(1, 9))).tolist()) for n, k in enumerate(rng.integers(0, 3, 60))]
    sections += [(0, "same", sections[0][2]), (None, "x", [1]), (1, "empty", []), (1, "null", None)]
    df = spark.createDataFrame([(*s, 2) for s in sections], "key int, section string, syms array<int>, n int")
    inside = lambda a, b: len(a) < len(b) and any(b[k : k + len(a)] == a for k in range(len(b)))
    want = {(k, s) for k, s, v in sections if k is not None and v and any(j == k and w and inside(v, w) for j, _, w in sections)}
    assert {tuple(r) for r in I.contained(df, "key").collect()} == want
    assert {r.section for r in I.uncontained(df, "key").collect()} == {s for k, s, _ in sections if (k, s) not in want}


def test_affinity_of_short_and_constant_series(spark):
    series = [(1, p, [1.0, float(p)]) for p in range(3)] + [(2, p, [1.0, 0.0]) for p in range(30)] + [(3, 0, [1.0, 1.0])]
    df = spark.createDataFrame(series, "key int, pos int, vec array<double>")
    rec = P.recurrence(df, "key", 2)
    assert {r.key for r in rec.collect()} <= {1, 2} and all(r.v == 1.0 for r in rec.where("key = 2").collect())
    step = P.path(df, "key").collect()
    assert {(r.i, r.j) for r in step if r.key == 2} == {(a, b) for a in range(30) for b in (a - 1, a + 1) if 0 <= b < 30} and not [r for r in step if r.key == 3]
    whole = P.affinity(df, df, "key", 2, 1)
    assert whole.where(F.isnan("v")).count() == 0
    back = {(r.key, r.i, r.j): r.v for r in whole.collect()}
    assert all(math.isclose(v, back[k, j, i], abs_tol=1e-12) for (k, i, j), v in back.items())
    assert P.affinity(df.where("key > 5"), df.where("key > 5"), "key").count() == 0
