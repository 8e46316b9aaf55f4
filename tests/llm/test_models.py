import os

import duckdb
import numpy as np
import pytest

from strophe.llm import ann, licenses, mixing, queries, sql, toxicity
from strophe.llm.common import stored


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir("/root/testdata/sf0.01"):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{f}')")
    return c


def as_text(names, values):
    return sorted(tuple(str(dict(zip(names, v))[n]) for n in sorted(names)) for v in values)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, "/root/testdata/sf0.01")
    r = duck.execute(queries.oracle_sql()[name])
    assert as_text(df.columns, [tuple(x) for x in df.collect()]) == as_text([d[0] for d in r.description], r.fetchall())


def exact(vectors, queries_, k):
    ids = np.array([v[0] for v in vectors])
    x = np.array([v[1] for v in vectors], float)
    out = {}
    for q, v in queries_:
        d = x @ np.array(v, float)
        order = [i for i in np.lexsort((ids, -d)) if ids[i] != q][:k]
        out[q] = [int(ids[i]) for i in order]
    return out


def test_recall_of_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "ENOUGH", 100)  # so that the search ends before it has seen all
    monkeypatch.setattr(ann, "SHARD", 700)
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = {}
    for r in ann.search(v, v.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(x) == 20 for x in got.values()) and set(got) == set(want)
    assert sum(len(set(want[q]) & set(got[q])) for q in want) / (20 * len(want)) >= 0.9


def test_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, None]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, [2.0, 0.0]), (9, [float("inf"), 0.0]), (None, [1.0, 1.0]), (10, [9.0]), (11, []), (40, [1.0, 1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.search(d, d.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 2.0), (0, 2, 6, 2.0), (0, 3, 20, 1.0), (20, 1, 5, 2.0), (20, 2, 6, 2.0), (20, 3, 0, 1.0)]  # 40 is alone with its length
    for a, b in ((d.limit(0), d.limit(0)), (d, d.limit(0)), (d.where("vec_id = 0"), d.where("vec_id = 0"))):
        assert ann.search(a, b, 20).collect() == []


def test_very_large_components_and_repeated_rows(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 0.0]), (2, [-1e200, 5.0]), (3, [1e-200, 1e-200]), (3, [1e-200, 1e-200]), (3, [1e-200, 1e-200]), (20, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(d, d.where("vec_id = 20"), 5).orderBy("rank").collect():
        got[r.rank] = r.vec_id
    assert got == {1: 0, 2: 1, 3: 3, 4: 3, 5: 3}  # 1e200 + 2 is 1e200
    assert [r.vec_id for r in ann.search(d, d.where("vec_id = 0"), 2).orderBy("rank").collect()] != []


def test_recall_of_a_full_shard_at_the_parameters_as_they_are():
    """On vectors without any structure, the hardest case, in a shard as large as they get."""
    x = np.random.default_rng(2).normal(size=(ann.SHARD, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.Index(np.arange(len(x)), x)
    hit = verified = 0
    for q in range(0, len(x), 400):
        d = x @ x[q]
        d[q] = -np.inf
        rows, products = index.search(x[q], q, 20)
        hit += len(set(np.argsort(-d)[:20].tolist()) & set(rows.tolist()))
        assert len(rows) == 20 and (np.diff(products) <= 0).all()
    assert hit / (20 * len(range(0, len(x), 400))) >= 0.93


def test_windows_count_each_vector_once_a_projection():
    x = np.random.default_rng(3).normal(size=(300, 8))
    index = ann.Index(np.arange(300), x)
    at = ann.scaled(x[0]) @ index.lines[:-1] + index.offset
    counts, ends = np.zeros(300, np.int32), None
    for radius in (0.2, 0.5, 1.0, 2.0):
        ends = index._widen(at, radius, ends, counts)
        p = (index.values - index.offset.repeat(300)).reshape(ann.PROJECTIONS, 300)
        inside = np.abs(p - (at - index.offset)[:, None]) <= ann.HALF * radius
        want = np.bincount(index.order.reshape(inside.shape)[inside], minlength=300)
        assert np.abs(counts - want).sum() <= 2  # values at the very end of a window may round either way
    index._widen(at, 1e9, ends, counts)
    assert (counts == ann.PROJECTIONS).all()


def test_licenses(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT")
    changed = "Copyright (c) 2021 Jane Doe\nCopyright © 2022\n\n" + mit.upper().replace("LICENSE", "Licence").replace(", ", " ,\n   ") + "\nAll rights reserved.\n"
    rows = [(1, mit), (2, changed), (3, mit + " more"), (4, None), (5, ""), (None, mit.split("\n\n", 1)[1]), (7, "Released under the MIT License."), (6, "x" * 300_000), (1, mit)]
    df = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.license, r.n_canonical > 0) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(1, "MIT", True), (1, "MIT", True), (2, "MIT", True), (3, None, True), (4, None, False), (5, None, False), (None, "MIT", True), (7, None, True), (6, None, True)], key=str)
    assert licenses.scan(df.limit(0)).collect() == []
    other = spark.createDataFrame([("x" * 300_000, "own")], "text string, license string")
    from pyspark.sql import functions as F

    known = other.select(F.sha2(licenses.canonical(F.col("text")), 256).alias("digest"), "license")
    assert [r.license for r in licenses.scan(df, known).where("doc_id = 6").collect()] == ["own"]


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no published texts on this machine")
def test_published_texts_are_known(spark, duck):
    """The stated digests are those of the texts as they are published; documents that hold one whole match, and SQL finds the same."""
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    rows = []
    for k, f in enumerate(sorted(names)):
        with open(f"/usr/share/common-licenses/{f}", encoding="utf-8", errors="replace") as file:
            text = file.read()
        rows += [(3 * k, text), (3 * k + 1, "Copyright 2020 Somebody\n" + text.replace("  ", " ").upper()), (3 * k + 2, text[: len(text) // 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    for k, f in enumerate(sorted(names)):
        assert (got[3 * k], got[3 * k + 1], got[3 * k + 2]) == (names[f], names[f], None)
    duck.execute("CREATE OR REPLACE TABLE texts (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO texts VALUES (?, ?)", rows)
    r = duck.execute(sql.licenses("texts"))
    x = licenses.scan(df)
    assert as_text(x.columns, [tuple(v) for v in x.collect()]) == as_text([d[0] for d in r.description], r.fetchall())


def test_licenses_by_sql_on_odd_texts(spark, duck):
    rows = [(k, t) for k, t in enumerate(["Copyright 2020\nCOPYRIGHT (C) 2021 x\nkeep copyright here", "licence licence Licence", "a — b ünïcode ©", "(c) 1999\n\n(c) 2000", "non infringement noncommercial", "  ...  ", None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    duck.execute("CREATE OR REPLACE TABLE odd (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO odd VALUES (?, ?)", rows)
    r = duck.execute(sql.licenses("odd"))
    x = licenses.scan(df)
    assert as_text(x.columns, [tuple(v) for v in x.collect()]) == as_text([d[0] for d in r.description], r.fetchall())


def test_mixing_of_odd_sources(spark, duck):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (None, "w " * 50, "y"), (None, "w " * 50, "y"), (3, "", "z"), (4, "one", None), (5, "\x1cq\x85 r", "\U0001f600"), (6, "q " * 400, "é"), (7, "t " * 9, "Z")]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "doc_id long, text string, source string, size int")
    x = mixing.mix(df)
    got = x.collect()
    sizes, targets, taken = {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source], targets[r.source] = r.source_size, r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(taken[s] == int(targets[s] + 1e-9) for s in taken)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(targets[s] <= 2 * sizes[s] for s in sizes)
    duck.execute("CREATE OR REPLACE TABLE odd_mix (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO odd_mix VALUES (?, ?, ?)", rows)
    r = duck.execute(sql.mixing("odd_mix"))
    x = x.drop("source")
    assert as_text(x.columns, [tuple(v) for v in x.collect()]) == as_text([d[0] for d in r.description], r.fetchall())
    assert mixing.mix(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_water_filling_is_the_fixpoint(spark, seed):
    r = np.random.default_rng(seed)
    sizes = [int(x) for x in r.integers(0, 1000, 9) * r.integers(0, 2, 9) + r.integers(0, 50, 9)]
    w = [(5.0, 2.0, 1.0)[k % 3] for k in range(9)]
    budget, caps = 1.5 * sum(sizes), [2.0 * s for s in sizes]
    target, full = [0.0] * 9, set()
    for _ in range(20):
        left = budget - sum(caps[k] for k in full)
        free = [k for k in range(9) if k not in full]
        for k in free:
            target[k] = left * w[k] / sum(w[j] for j in free)
        over = {k for k in free if target[k] > caps[k]}
        for k in over:
            target[k] = caps[k]
        if not over:
            break
        full |= over
    df = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(df).collect()}
    assert [got[f"s{k}"] for k in range(9)] == pytest.approx(target)


@pytest.fixture(scope="module")
def labelled(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return d, lab


def test_held_out_toxicity(spark, labelled):
    d, lab = labelled
    train, rest = lab.where("doc_id % 4 != 0"), lab.where("doc_id % 4 = 0")
    chain = toxicity.fit_on(d, train)
    s = toxicity.score(d, chain).join(rest.select("doc_id", "toxic").withColumnRenamed("toxic", "gold"), "doc_id").collect()
    tp = sum(r.toxic and r.gold for r in s)
    assert tp / sum(r.toxic for r in s) >= 0.97 and tp / sum(r.gold for r in s) >= 0.8
    assert chain.earlier[1, 0] != 0  # the later link listens to the earlier one


def test_chain_of_few_labels_and_odd_texts(spark):
    d = spark.createDataFrame([(1, "a b", 1), (2, None, 1), (None, "", 1), (2, "c " * 100_000, 1)], "doc_id long, text string, toxic int")
    lab = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_on(d, lab)
    got = toxicity.score(d, chain).collect()
    assert len(got) == 4 and {r.toxic for r in got} == {0}
    assert toxicity.fit_on(d, lab.limit(0)).threshold == 0.5
    assert toxicity.score(d.limit(0), chain).collect() == []
    assert toxicity.accepted(d, lab).count() == 4 and toxicity.accepted(d, lab).columns == d.columns


def plain_chain(texts, labels, folds=5, most=toxicity.FEATURES):
    """The chain written out with dense arrays and without Spark: features by counting, every link on the features and the earlier links' out-of-fold probabilities."""
    found = [sorted({h for w in toxicity.words(t) for h in toxicity.features(w)}) for _, t in texts]
    fold, n = np.array(toxicity.fold_numbers([i for i, _ in texts])) % folds, len(texts)
    seen, links = np.zeros((n, 0), np.float32), []
    for k, category in enumerate(toxicity.CATEGORIES):
        y = np.array([labels[i][category] for i, _ in texts], np.float32)
        counts = {}
        for fs, v in zip(found, y.tolist()):
            for f in fs:
                a, b = counts.get(f, (0, 0))
                counts[f] = a + 1, b + v
        ones = float(y.sum())
        score = {f: round(abs(np.log((b + 0.5) / (ones + 1)) - np.log((a - b + 0.5) / (n - ones + 1))) * a**0.5, 9) for f, (a, b) in counts.items() if a >= 4}
        names = sorted(sorted(score, key=lambda f: (-score[f], f))[:most])
        place = {f: j for j, f in enumerate(names)}
        x = np.zeros((n, len(names) + k), np.float32)
        for r, fs in enumerate(found):
            for f in fs:
                if f in place:
                    x[r, place[f]] = 1
        x[:, len(names) :] = seen
        out = np.zeros(n, np.float32)
        for f in range(folds):
            w, b = toxicity._logistic(x[fold != f], y[fold != f])
            out[fold == f] = toxicity._sigmoid(x[fold == f] @ w + b)
        seen = np.concatenate((seen, out[:, None]), 1)
        links.append((place, *toxicity._logistic(x, y)))
    return links, seen


def test_chain_is_the_plain_one(spark, labelled):
    d, lab = labelled
    d, lab = d.where("doc_id < 3000"), lab.where("doc_id < 3000")
    chain = toxicity.fit_on(d, lab.unionByName(lab))  # a label that is there twice counts once
    labels = {r.doc_id: {"not quality": 1 - r.quality, "toxic": r.toxic} for r in lab.dropna().collect()}
    texts = sorted((r.doc_id, r.text) for r in d.collect() if r.doc_id in labels)
    links, seen = plain_chain(texts, labels)
    for k, (place, w, b) in enumerate(links):
        assert {f for f, v in chain.weights.items() if f in place} == set(place)
        assert np.allclose([chain.weights[f][k] for f in place], w[: len(place)], atol=1e-5) and chain.bias[k] == pytest.approx(b, abs=1e-5)
        assert np.allclose(chain.earlier[k, :k], w[len(place) :], atol=1e-5)
    assert chain.threshold == pytest.approx(toxicity._threshold(seen[:, -1], np.array([labels[i]["toxic"] for i, _ in texts], np.float32)), abs=1e-5)


def test_repeated_documents_of_a_label_count_once(spark):
    text = "many words " + " ".join(f"w{k}" for k in range(3000))
    d = spark.createDataFrame([(1, text, 0)] * 500 + [(k, f"good text number {k}", 0) for k in range(2, 30)], "doc_id long, text string, l0 int")
    lab = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(1, 30)], "doc_id long, quality int, toxic int")
    once = toxicity.fit_on(d.dropDuplicates(), lab)
    many = toxicity.fit_on(d, lab)
    assert np.allclose(once.bias, many.bias) and once.weights.keys() == many.weights.keys()
    assert toxicity.accepted(d.limit(0), lab).collect() == []


def test_pipeline_stages_hand_on_documents(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    seen = []
    for n, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, "/root/testdata/sf0.01")
        if n + 1 < len(P.STAGES):
            assert docs.columns == list(P.COLUMNS)
            docs = stored(docs, "stage")
            seen.append({r.doc_id: r.text for r in docs.collect()})
    assert len(before) > len(seen[0]) > len(seen[1]) > len(seen[2]) == len(seen[3])
    assert seen[0].keys() > seen[1].keys() > seen[2].keys()
    changed = {k for k in seen[3] if seen[3][k] != seen[2][k]}
    from strophe.llm import pii

    assert {k for k in seen[2] if pii.base_spans(seen[2][k] or "")} <= changed
    last = docs.collect()
    assert {r.doc_id for r in last} == set(seen[3]) and sum(r.taken for r in last) > 0


def test_folds_do_not_hang_on_what_ids_have_in_common():
    from collections import Counter

    for step in (1, 5, 100):
        assert set(Counter(n % 5 for n in toxicity.fold_numbers([step * i for i in range(50)])).values()) == {10}
