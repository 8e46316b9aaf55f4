"""Vector codes against plain rounds over all parts."""

import hashlib

import numpy as np
import pytest

from strophe.llm import codes


def plain(rows, width):
    """(vec_id, code, error, label_error, digest) of rows (vec_id, vector, label), every part compared with every entry in every round."""
    x = {n: [int(np.floor(4096 * c)) for c in v] + [0] * (8 * width - len(v)) for n, (_, v, _) in enumerate(rows)}
    first = sorted(x, key=lambda n: (rows[n][0] is None, rows[n][0] or 0, x[n]))[:16]
    books = [[x[n][p * width : (p + 1) * width] for n in first] for p in range(8)]
    d = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    for r in range(7):
        best = {(n, p): min(range(len(first)), key=lambda e: (d(x[n][p * width : (p + 1) * width], books[p][e]), e)) for n in x for p in range(8)}
        if r < 6:
            for p in range(8):
                for e in range(len(first)):
                    of = [x[n][p * width : (p + 1) * width] for n in x if best[n, p] == e]
                    if of:
                        books[p][e] = [sum(c) // len(of) for c in zip(*of)]
    error = {n: sum(d(x[n][p * width : (p + 1) * width], books[p][best[n, p]]) for p in range(8)) for n in x}
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(rows[n][0], "".join(f"{best[n, p]:02x}" for p in range(8)), error[n], sum(error[m] for m in x if rows[m][2] == rows[n][2]), digest) for n in x]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, error string")


@pytest.mark.parametrize("block", [5, 4096])
def test_codes_are_those_of_plain_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(codes, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(int(i), v, [None, 1, 2][i % 3]) for i, v in enumerate(rng.normal(size=(90, 16)).astype(np.float32).tolist())]
    rows += rows[:3] + [(None, rows[5][1], 1), (400, rows[6][1], None)]
    assert order(map(tuple, codes.compress(frame(spark, rows)).collect())) == order(plain(rows, 2))


def test_odd_vectors(spark):
    rows = [(3, [0.5] * 9, 1), (1, [0.25] * 8, None), (2, [], None), (7, [1.0] * 16, 1)]
    left_out = [(0, None, 1), (4, [None] * 8, 1), (5, [float("nan")] * 8, 1), (6, [float("inf")] * 8, 2)]
    assert order(map(tuple, codes.compress(frame(spark, rows + left_out)).collect())) == order(plain(rows, 2))
    assert codes.compress(frame(spark, left_out)).collect() == []
    assert codes.compress(frame(spark, [])).collect() == []
    huge = codes.compress(frame(spark, [(i, [3e38, -3e38] * 4, 1) for i in range(20)])).collect()
    assert {(r.error, r.code) for r in huge} == {(0, "00" * 8)}


def test_only_parts_whose_slack_is_used_up_are_looked_at_again():
    rng = np.random.default_rng(4)
    centers = 4000 * rng.normal(size=(16, 32))
    x = np.floor(centers[rng.integers(0, 16, 3000)] + 100 * rng.normal(size=(3000, 32))).astype(np.int64)
    books = np.floor(centers).astype(np.int64).reshape(16, 8, 4).transpose(1, 0, 2)
    block = codes.Heaps(x, 16)
    block.fill(books)
    first, drift = block.scanned, np.zeros((8, 16))
    moved = books + 30
    way = np.sqrt(((moved - books) ** 2).sum(2))
    block.renew(moved, drift + 2 * way)
    assert block.scanned - first < first // 20
    assert (block.best() == np.stack([codes._nearest(block.x[:, p], moved[p])[0] for p in range(8)], 1)).all()
    assert all(h[i] <= h[j] for h in block.heaps for i in range(len(h)) for j in (2 * i + 1, 2 * i + 2) if j < len(h))
