import numpy as np
import pytest

from strophe.llm import pii


@pytest.fixture(scope="module")
def net():
    return pii.trained()


def test_gradients_are_those_of_the_loss():
    net = pii.Net(3, 1)
    r = np.random.default_rng(2)
    ids, gold = r.integers(0, 98, (6, 4)), r.integers(0, 5, (6, 4))
    _, g = net.gradients(ids, gold)
    for name in net.w:
        net.w[name] = net.w[name].astype(np.float64)
        flat = net.w[name].reshape(-1)
        for k in np.argsort(-np.abs(g[name].reshape(-1)))[:3]:
            was = flat[k]
            flat[k] = was + 1e-3
            a, _ = net.gradients(ids, gold)
            flat[k] = was - 1e-3
            b, _ = net.gradients(ids, gold)
            flat[k] = was
            assert (a - b) / 2e-3 == pytest.approx(g[name].reshape(-1)[k], rel=0.05, abs=2e-3)


def plain_best(net, e):
    t = net.w["t"]
    score, back = e[0].copy(), []
    for k in range(1, len(e)):
        s = score[:, None] + t
        back.append(s.argmax(0))
        score = s.max(0) + e[k]
    path = [int(score.argmax())]
    for step in back[::-1]:
        path.append(int(step[path[-1]]))
    return path[::-1]


def path_score(net, e, path):
    return sum(float(e[k, x]) for k, x in enumerate(path)) + sum(float(net.w["t"][a, b]) for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("lead", [0.0, 2.0, 5.0])
def test_decode_is_the_best_path_of_each_whole_text(net, lead):
    r = np.random.default_rng(3)
    es = []
    for n in (1, 2, 3, 7, 40, 400, 1000):
        for _ in range(12):
            e = r.normal(size=(n, 5)).astype(np.float32)
            e[:, 0] += lead
            for _ in range(int(n > 20) * 3):  # places where something else leads for a while
                a = int(r.integers(0, n - 10))
                e[a : a + int(r.integers(3, 30)), int(r.integers(1, 5))] += 3 + lead
            es.append(e)
    es.append(np.zeros((0, 5), np.float32))
    for e, got in zip(es, net.decode(es)):
        assert len(got) == len(e)
        if len(e):
            assert path_score(net, e, got.tolist()) == pytest.approx(path_score(net, e, plain_best(net, e)), abs=1e-3)


def test_emissions_are_those_of_the_network_that_is_trained(net):
    ids = np.random.default_rng(3).integers(0, 98, (50, 7)).astype(np.uint8)
    h = np.concatenate([net._direction(ids, d) for d in "fb"], 2)
    assert np.allclose(net.emissions(ids), h @ net.w["e"] + net.w["c"], atol=1e-4)
    wide = pii.Net()
    wide.w = {k: v * 200 for k, v in net.w.items()}  # gates at their ends
    h = np.concatenate([wide._direction(ids, d) for d in "fb"], 2)
    assert np.allclose(wide.emissions(ids), h @ wide.w["e"] + wide.w["c"], atol=0.5, rtol=1e-3)


def test_emissions_of_a_long_text_are_averaged_where_windows_overlap(net):
    text = "call (543) 555-3824 or write to jane at mail dot com. " * 20
    stride = pii.WINDOW - pii.SHARED
    mine = pii.text_emissions(net, [text, "", "short"])
    assert [len(x) for x in mine] == [len(text), 0, 5]
    ids = pii.classes(text)
    total, weight = np.zeros((len(text), 5)), np.zeros(len(text))
    n = -(-(len(text) - pii.SHARED) // stride)
    for k in range(n):
        part = ids[k * stride : k * stride + pii.WINDOW]
        window = np.full(pii.WINDOW, 96, np.uint8)
        window[: len(part)] = part
        e = net.emissions(window[:, None])[: len(part), 0]
        w = np.ones(pii.WINDOW)
        if k:
            w[: pii.SHARED] = (np.arange(pii.SHARED) + 0.5) / pii.SHARED
        if k < n - 1:
            w[stride:] = 1 - (np.arange(pii.SHARED) + 0.5) / pii.SHARED
        total[k * stride : k * stride + len(part)] += e * w[: len(part), None]
        weight[k * stride : k * stride + len(part)] += w[: len(part)]
    assert np.allclose(weight, 1) and np.allclose(mine[0], total, atol=1e-4)


def test_held_out_accuracy(net):
    texts, gold = pii.labelled_windows(300, pii.WINDOW, 99)
    got = np.array(pii.tag_texts(net, texts)).T
    assert (got == gold).mean() > 0.98
    hit = ((got == gold) & (gold > 0)).sum()
    assert hit / (gold > 0).sum() > 0.94 and hit / (got > 0).sum() > 0.94


def test_model_finds_what_patterns_find(net, spark):
    hit = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").limit(400).collect():
        spans = pii.base_spans(r.text)
        if spans:
            tags = pii.tag_texts(net, [r.text])[0]
            total += len(spans)
            hit += sum((tags[s:e] == pii.TAGS.index(k)).mean() > 0.7 for s, e, k in spans)
    assert total > 10 and hit / total > 0.85


def test_windows_of_a_long_text_agree_at_their_seams(net):
    text = ("lorem ipsum " * 11 + "call (543) 555-3824 or jane [at] mail [dot] com now. ") * 9
    tags = pii.tag_texts(net, [text, "", "x"])
    assert [len(t) for t in tags] == [len(text), 0, 1]
    spans = pii.added_spans(text, tags[0], pii.base_spans(text))
    assert sum(k == "phone" for _, _, k in spans) >= 7 and sum(k == "email" for _, _, k in spans) >= 7
    for s, e, k in spans:
        assert text[s:e] in ("(543) 555-3824", "jane [at] mail [dot] com"), (text[s:e], k)


def test_redact(spark):
    df = spark.createDataFrame([(1, "write to a@b.co or 10.0.0.1!", "en", "s", 29), (2, None, None, None, None), (3, "clean text", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(df).collect()}
    assert got == {1: ("write to <EMAIL> or <IP>!", 25), 2: (None, None), 3: ("clean text", 10)}
    assert pii.redact(df).columns == df.columns


def test_redact_of_odd_tables(spark):
    row = (1, "mail a@b.co", "x", 5, "k")
    df = spark.createDataFrame([row, row, (None, "", None, 0, None), (2, "a@b.co " * 60_000, "x", 0, None)], "doc_id long, text string, kind string, n_chars long, spans string")
    got = sorted(((r.doc_id, r.text[:14], r.kind, r.n_chars, r.spans) for r in pii.redact(df).collect()), key=str)
    assert got == sorted([(1, "mail <EMAIL>", "x", 12, "k"), (1, "mail <EMAIL>", "x", 12, "k"), (None, "", None, 0, None), (2, "<EMAIL> <EMAIL", "x", 8 * 60_000, None)], key=str)
    assert pii.redact(df.limit(0)).collect() == []
    assert "n_chars" not in pii.redact(df.drop("n_chars")).columns


def test_the_model_adds_spellings_that_the_patterns_miss(net):
    """On made-up texts that it has not seen: what it adds there, and that it adds next to nothing to prose."""
    texts, gold = pii.labelled_windows(150, 600, 1234)
    missed = found = wrong = 0
    for text, tags, want in zip(texts, pii.tag_texts(net, texts), gold.T):
        base = pii.base_spans(text)
        taken = np.zeros(len(text), bool)
        for s, e, _ in base:
            taken[s:e] = True
        edges = [0, *(np.flatnonzero(np.diff(want)) + 1).tolist(), len(want)]
        left = [(a, b) for a, b in zip(edges, edges[1:]) if want[a] and not taken[a:b].any() and b < 600]
        added = pii.added_spans(text, tags, base)
        missed += len(left)
        found += sum(any(s < b and a < e for s, e, _ in added) for a, b in left)
        wrong += sum(not want[s:e].any() for s, e, _ in added)
    assert missed > 100 and found >= 0.7 * missed and wrong <= 0.03 * found
