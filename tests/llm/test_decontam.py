import random

import numpy as np
import pytest

from strophe.llm import decontam as D


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_lcs():
    r = random.Random(1)
    for _ in range(200):
        a, b = [[bytes([97 + r.randrange(4)]) for _ in range(r.randrange(1, 90))] for _ in range(2)]
        assert D.lcs(D._positions(a), len(a), b) == plain_lcs(a, b)


def corpus(seed, n, words=900):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 8))) for _ in range(words)]
    weights = [1 / (k + 3) for k in range(words)]
    text = lambda k: " ".join(r.choices(vocab, weights, k=k))
    return r, vocab, text


@pytest.fixture(scope="module")
def planted(spark):
    """Documents with items whole, with every sixth word changed, or with words put in; items of 3 to 150 words; and documents without."""
    r, vocab, text = corpus(5, 0)
    items = [(k, text(n) + ".") for k, n in enumerate([3, 6, 9, 12, 17, 18, 25, 33, 34, 40, 56, 65, 66, 80, 150])]
    docs, want = [], set()
    for k, (item, body) in enumerate(items):
        for how in ("whole", "changed", "longer"):
            ws = body.split()
            if how == "changed" and len(ws) >= 9:
                ws = [r.choice(vocab) if i % 6 == 5 and i < len(ws) - 9 else w for i, w in enumerate(ws)]
            if how == "longer" and len(ws) >= 9:
                ws = [x for i, w in enumerate(ws) for x in ([w, r.choice(vocab)] if i % 8 == 7 else [w])]
            doc = len(docs)
            docs.append((doc, f"{text(r.randrange(0, 200))} {' '.join(ws).upper() if k % 2 else ' '.join(ws)} {text(r.randrange(0, 3000 if k == 3 else 200))}"))
            want.add((doc, item))
    docs += [(len(docs) + k, text(r.randrange(1, 400))) for k in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string")
    return docs, items, want, d, b


def brute_force(docs, items):
    """The check over all stretches of about an item's length, without a candidate search."""
    out = set()
    for doc, text in docs:
        ws = D.tokens(text)
        for item, body in items:
            its, ans = D.tokens(body), D.answer(body)
            n = len(its)
            reach = n + n // 4 + D.BLOCK
            for at in range(0, max(1, len(ws) - reach + D.BLOCK), D.BLOCK):
                part = ws[at : at + reach]
                if len(set(its) & set(part)) >= 0.5 * len(set(its)):
                    common = plain_lcs(its, part)
                    if common >= 0.8 * n or common >= 0.6 * n and plain_lcs(ans, part) >= 0.75 * len(ans):
                        out.add((doc, item))
                        break
    return out


def test_planted_items_are_found_and_clean_documents_are_not(planted):
    docs, items, want, d, b = planted
    got = {(r.doc_id, r.item_id) for r in D.leaks(d, b).collect()}
    long_items = {k for k, body in items if len(body.split()) >= 9}
    assert {x for x in want if x[1] in long_items} <= got
    assert {x for x in got if x[0] >= 45 and x[1]} == set()  # item 0 is three frequent words
    assert {(x[0], x[1]) for x in want if x[1] in (0, 1)} <= got
    truth = {x for x in brute_force(docs[:45] + docs[45:90], items) if x[1] in long_items}
    mine = {x for x in got if x[1] in long_items and x[0] < 90}
    assert len(truth & mine) / len(truth) >= 0.95


def test_clean_drops_leaking_rows_only(planted):
    docs, items, want, d, b = planted
    kept = {r.doc_id for r in D.clean(d, b).collect()}
    leaking = {r.doc_id for r in D.leaks(d, b).collect()}
    assert kept == {k for k, _ in docs} - leaking


def test_results_do_not_hang_on_partitions(planted):
    _, _, _, d, b = planted
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    a, c = rows(D.leaks(d, b)), rows(D.leaks(d.repartition(2), b))
    assert [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in c]


def test_blocks_of_items(planted, monkeypatch):
    _, _, _, d, b = planted
    whole = {(r.doc_id, r.item_id) for r in D.leaks(d, b).collect()}
    monkeypatch.setattr(D, "AT_ONCE", 4)
    parts = {(r.doc_id, r.item_id) for r in D.leaks(d, b).collect()}
    assert whole == parts
    kept = {r.doc_id for r in D.clean(d, b).collect()}
    assert kept == {r.doc_id for r in d.select("doc_id").collect()} - {x[0] for x in parts}


def test_many_pieces_at_once(planted, monkeypatch):
    docs, items, _, d, b = planted
    whole = sorted(tuple(r)[:2] for r in D.leaks(d, b).collect())
    monkeypatch.setattr(D, "PIECES", 3)
    assert sorted(tuple(r)[:2] for r in D.leaks(d, b).collect()) == whole


def test_very_long_items(spark):
    """Items of thousands of different words, which a table of pieces by words could not hold."""
    words = lambda a, n: " ".join(f"w{(a * 7919 + k) % 60000}" for k in range(n))
    items = [(k, words(k * 97, 6000)) for k in range(12)]
    docs = [(k, words(k * 97, 6000) if k < 3 else words(31 * k + 5, 300) + " x" * 50) for k in range(20)]
    docs.append((99, "start " + words(5 * 97, 6000) + " end"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(d, b).collect()}
    assert {(0, 0), (1, 1), (2, 2), (99, 5)} <= got
    space = D.fitted(d, b)
    assert D.Items(items, space).bits.nbytes < 4_000_000


def test_any_stretch_that_is_a_leak_counts(spark):
    """One stretch has more of the item but no answer, another less but all of the answer."""
    body = [f"a{k}" for k in range(40)]
    text = " ".join(body[:20]) + " " + " ".join(body[20:30]) + ". " + " ".join(body[30:])
    filler = " ".join(f"z{k}" for k in range(120))
    first = " ".join(body[:30])  # 0.75 without the answer
    second = " ".join([*body[:18], *body[32:]])  # 0.65 with it
    d = spark.createDataFrame([(1, f"{first} {filler}"), (2, f"{second} {filler}"), (3, f"{first} {filler} {second} {filler}"), (4, filler)], "doc_id long, text string")
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert {r.doc_id for r in D.leaks(d, b).collect()} == {2, 3}


def test_latent_space_is_near_that_of_the_exact_decomposition(spark):
    """The cosine of items and passages in the space of the sketch, against that of the singular vectors of the whole TF-IDF matrix."""
    import numpy as np

    r, vocab, text = corpus(9, 0, 300)
    items = [(k, text(60)) for k in range(30)]
    docs = [(k, text(400)) for k in range(150)] + [(150 + k, items[k][1]) for k in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    space = D.fitted(d, b)
    rows = []
    for _, t in docs:
        ts = [space.words[w] for w in D.tokens(t) if w in space.words]
        rows += [np.bincount(ts[a : a + 40], minlength=len(space.idf)) for a in range(0, len(ts), 40)]
    m = np.array(rows) * space.idf
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    exact = space.idf[:, None] * vt[: D.RANK].T / np.maximum(s[: D.RANK], np.median(s[: D.RANK]))
    mine = space.latent[:-1]
    cos = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    counts = np.array(rows)[:200]
    a, c = cos(counts @ exact), cos(counts @ mine)
    upper = np.triu_indices(len(counts), 1)
    assert np.corrcoef(a[upper], c[upper])[0, 1] > 0.6


def test_odd_tables(spark):
    body = "the quick brown fox jumps over the lazy dog near the old river bank today"
    d = spark.createDataFrame([(1, f"zzz {body} yyy", 1), (1, f"zzz {body} yyy", 1), (None, body, 2), (3, None, 3), (4, "", 4), (5, "nothing here", 5)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(1, body, "x"), (None, None, "y"), (2, "", "z"), (None, body, "w")], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id) for r in D.leaks(d, b).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (1, None), (1, None), (None, 1), (None, None)], key=str)
    assert {r.doc_id for r in D.clean(d, b).collect()} == {3, 4, 5}
    assert D.leaks(d.limit(0), b).collect() == [] == D.leaks(d, b.limit(0)).collect()
    assert D.clean(d, b.limit(0)).count() == 6 and D.clean(d.limit(0), b).count() == 0


def test_cells_are_found_as_in_a_dictionary():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3000):
        d = {int(k): int(v) for k, v in zip(rng.integers(0, 1 << 40, n), rng.integers(1, 1 << 62, n))}
        keys = np.concatenate([np.array(list(d), np.int64), rng.integers(0, 1 << 40, 500), np.arange(50)]).astype(np.int64)
        assert D.Cells(d).bits_of(keys).tolist() == [d.get(int(k), 0) for k in keys]
