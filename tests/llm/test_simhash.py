import numpy as np
import pytest
import xxhash

from strophe.llm import simhash as S


def plain_fingerprint(text, width=4):
    words, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    words += [word] if word else []
    if not words:
        return 0
    grams = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", "  \n", "one", "One TWO three", "É é É x y z \x1c a b", "a b c d e f g h a b c d", "w " * 3000])
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_in_slabs(monkeypatch):
    text = " ".join(f"w{k * k % 97}" for k in range(2000))
    whole = S.fingerprint(text.encode())
    monkeypatch.setattr(S, "SLAB", 100)
    assert S.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def labels_by_comparing_all(fp, group, budget=4):
    sets = S._Sets(len(fp))
    a, b = np.nonzero((np.bitwise_count(fp[:, None] ^ fp[None, :]) <= budget) & (group[:, None] == group[None, :]))
    sets.join(a, b)
    return sets.label


def balls(rng, n, size):
    out = set()
    for _ in range(n):
        x = int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(1, size))):
            y = x
            for k in rng.integers(0, 64, int(rng.integers(0, 4))):
                y ^= 1 << int(k)
            out.add(y)
            if rng.random() < 0.2:
                x = y
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("seed", range(4))
def test_trie_links_joins_what_comparing_all_joins(seed):
    rng = np.random.default_rng(seed)
    fp = balls(rng, 60, 60)
    group = np.sort(rng.integers(0, 1 + seed, len(fp)))
    a, b = S.trie_links(fp, group, 4)
    sets = S._Sets(len(fp))
    sets.join(a, b)
    assert np.array_equal(sets.label, labels_by_comparing_all(fp, group))


@pytest.mark.parametrize("hot", [2000, 20])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)  # 20: groups are dealt out again
    fp = balls(np.random.default_rng(7), 40, 40)
    want = labels_by_comparing_all(fp, np.zeros(len(fp), int))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = {r.fp: r.root for r in S.groups(df).collect()}
    roots = {}
    for x, label in zip(fp.view(np.int64).tolist(), want.tolist()):
        assert roots.setdefault(label, got[x]) == got[x]
    assert len(set(roots.values())) == len(roots)


def test_nulls_empties_repeats_and_clashing_names(spark):
    rows = [(1, "a b c d e f g", 1, "x"), (1, "a b c d e f g", 1, "x"), (2, None, 1, None), (None, "A b c d e f g", 1, "x"), (None, "", 1, "y"), (None, "hello world", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    same = f"{plain_fingerprint('a b c d e f g'):016x}"
    assert got == sorted([(1, same, 1), (1, same, 1), (None, same, 1), (2, "0" * 16, 2), (None, "0" * 16, 2), (None, f"{plain_fingerprint('hello world'):016x}", None)], key=str)
    df = df.withColumn("_h", df.fp).withColumn("_id", df.fp).withColumn("node", df.text)
    assert S.keep_first(df).columns == df.columns
    kept = sorted(((r.doc_id, r.text, r.fp) for r in S.keep_first(df).collect()), key=str)
    assert kept == sorted([(1, "a b c d e f g", 1), (2, None, 1), (None, "hello world", None)], key=str)
    assert S.near_duplicates(df.limit(0)).collect() == [] == S.keep_first(df.limit(0)).collect()


def jaccard(a, b, width=5):
    grams = lambda t: {tuple(w[k : k + width]) for w in [t.lower().split()] for k in range(max(1, len(w) - width + 1))}
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def test_wide_fingerprint_in_slabs(monkeypatch):
    text = " ".join(f"w{k * k % 97}" for k in range(2000)).encode()
    whole = S.wide_fingerprint(text)
    monkeypatch.setattr(S, "SLAB", 100)
    assert np.array_equal(S.wide_fingerprint(text), whole)
    assert int(whole[0]) == S.fingerprint(text, 5)
    assert not S.wide_fingerprint(None).any() and S.wide_fingerprint(b"one").any()


@pytest.mark.parametrize("seed", range(3))
def test_ball_links_join_what_comparing_all_joins(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, (30, 4), dtype=np.uint64)
    fp = np.repeat(centres, rng.integers(1, 50, 30), axis=0)
    for k in range(14):  # in some all of them in the first word
        fp[np.arange(len(fp)), rng.integers(0, 4, len(fp)) * (np.arange(len(fp)) % 3 > 0)] ^= np.uint64(1) << rng.integers(0, 64, len(fp), dtype=np.uint64)
    group = np.sort(rng.integers(0, 2, len(fp)))
    a, b = S.ball_links(fp, group, 20)
    mine, want = S._Sets(len(fp)), S._Sets(len(fp))
    mine.join(a, b)
    dist = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
    want.join(*np.nonzero((dist <= 20) & (group[:, None] == group[None])))
    assert np.array_equal(mine.label, want.label)


@pytest.mark.parametrize("leaf", [2, 16, 128])
def test_tries_of_wide_fingerprints_join_what_comparing_all_joins(leaf, monkeypatch):
    """The pipeline's candidates come from op4's walk of pairs of nodes with a budget; before, wide fingerprints had no trie."""
    rng = np.random.default_rng(leaf)
    fp = np.repeat(rng.integers(0, 2**63, (40, 4), dtype=np.uint64), rng.integers(1, 60, 40), axis=0)
    for k in range(16):  # in some all of them in the first word
        fp[np.arange(len(fp)), rng.integers(0, 4, len(fp)) * (np.arange(len(fp)) % 3 > 0)] ^= np.uint64(1) << rng.integers(0, 64, len(fp), dtype=np.uint64)
    fp[:3] = [[0] * 4, [2**64 - 1] * 4, [1] + [0] * 3]  # all bits apart is not near
    group = np.sort(rng.integers(0, 3, len(fp)))
    dist = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2, dtype=int)
    want = S._Sets(len(fp))
    want.join(*np.nonzero((dist <= 20) & (group[:, None] == group[None])))
    mine = S._Sets(len(fp))
    mine.join(*S.trie_links(fp, group, 20, leaf))
    assert np.array_equal(mine.label, want.label) and len(set(want.label)) > 40
    walked, walk = [], S.trie_links
    monkeypatch.setattr(S, "trie_links", lambda *a: (walked.append(a[2]), walk(*a))[1])
    S.ball_links(fp, group, 20)
    assert walked == [20]


@pytest.mark.parametrize("hot", [1 << 15, 30])
def test_near_copies_go_and_clean_documents_stay(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "WIDE_HOT", hot)  # 30: groups are cut into parts
    r = np.random.default_rng(4)
    vocab = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "is", "on", "ul")]
    text = lambda n: [vocab[k] for k in r.integers(0, len(vocab), n)]
    docs, copies = [], {}
    for k in range(60):
        base = text(int(r.integers(40, 400)))
        docs.append((len(docs), " ".join(base)))
        first = docs[-1][0]
        for _ in range(int(r.integers(0, 4)) if k else 90):
            new = list(base)
            for at in r.integers(0, len(new), max(1, len(new) // 100)):
                new[at] = vocab[int(r.integers(0, len(vocab)))]
            docs.append((len(docs), " ".join(new).upper() if r.random() < 0.3 else " ".join(new)))
            if jaccard(docs[-1][1], docs[first][1]) >= 0.85:
                copies[docs[-1][0]] = first
    kept = {x.doc_id for x in S.keep_first(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    firsts = set(range(len(docs))) - set(copies)
    assert len(kept & set(copies)) <= 0.03 * len(copies)
    clean = {d for d in firsts if d not in copies.values() and all(jaccard(docs[d][1], t) < 0.5 for e, t in docs if e != d)}
    assert clean and clean <= kept
    assert set(copies.values()) <= kept


def test_pairs_that_share_one_crowded_block_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(11)
    fp = rng.integers(0, 2**63, (300, 4), dtype=np.uint64)
    low = np.uint64((1 << S.BLOCK_BITS) - 1)
    fp[:, 0] &= ~low  # all in one block's group
    copies = fp[:100].copy()
    for w in range(4):  # a bit of every block but that one
        for k in range(S.BLOCKS):
            if w or k:
                copies[:, w] ^= np.uint64(1) << np.uint64(S.BLOCK_BITS * k)
    both = np.concatenate([fp, copies]).view(np.int64)
    df = spark.createDataFrame([(n, *map(int, f)) for n, f in enumerate(both)], "node long, f0 long, f1 long, f2 long, f3 long").cache()
    for name in ("HOT", "WIDE_HOT"):
        monkeypatch.setattr(S, name, 40)
    assert {(min(r), max(r)) for r in S.wide_links(df, 45).collect()} == {(k, 300 + k) for k in range(100)}


def test_large_groups_are_joined_as_comparing_all_joins():
    rng = np.random.default_rng(5)
    fp = np.repeat(rng.integers(0, 2**63, (400, 4), dtype=np.uint64), rng.integers(1, 4, 400), axis=0)
    for _ in range(8):
        fp[np.arange(len(fp)), rng.integers(0, 4, len(fp))] ^= np.uint64(1) << rng.integers(0, 64, len(fp), dtype=np.uint64)
    mine, want = S._Sets(len(fp)), S._Sets(len(fp))
    mine.join(*S.ball_links(fp, np.zeros(len(fp), int), 20))
    want.join(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= 20))
    assert np.array_equal(mine.label, want.label)


def near_pairs(seed, n, least, most):
    """Pairs of texts whose similarity lies in a range, with that similarity."""
    r, out = np.random.default_rng(seed), []
    while len(out) < n:
        base = [f"w{k}" for k in r.integers(0, 5000, int(r.integers(80, 300)))]
        new = list(base)
        for at in r.integers(0, len(base), max(1, int(len(base) * r.uniform(0.01, 0.09)))):
            new[at] = f"w{int(r.integers(0, 5000))}"
        a, b = " ".join(base), " ".join(new)
        if least <= (j := jaccard(a, b)) < most:
            out.append((a, b, j))
    return out


def groups_by_comparing_all(texts, similarity=0.8):
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if label[a] != label[b] and jaccard(texts[a], texts[b]) >= similarity:
                x, y = label[a], label[b]
                label = [min(x, y) if k in (x, y) else k for k in label]
    return label


def test_links_do_not_hang_on_how_full_a_block_is(spark, monkeypatch):
    """Pairs of a similarity of 0.8 to 0.85: candidates are the same with full blocks and with empty ones, and nearly all pairs are among them."""
    pairs = near_pairs(5, 300, 0.8, 0.85)
    rows = [(2 * k + s, *S.set_fingerprint(S.shingle_set(pair[s].encode())).view(np.int64).tolist()) for k, pair in enumerate(pairs) for s in (0, 1)]
    df = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long").cache()
    budget, found = S.bits_apart(0.8), []
    for hot in (1 << 15, 30):
        monkeypatch.setattr(S, "WIDE_HOT", hot)
        found.append({(min(r), max(r)) for r in S.wide_links(df, budget).collect()})
    assert found[0] == found[1]
    assert len(found[0] & {(2 * k, 2 * k + 1) for k in range(300)}) >= 0.97 * 300


def test_only_copies_of_the_stated_similarity_go(spark):
    below, above = near_pairs(1, 150, 0.65, 0.8), near_pairs(2, 150, 0.8, 0.85)
    rows = [(2 * k + s, pair[s]) for k, pair in enumerate(below + above) for s in (0, 1)]
    kept = {r.doc_id for r in S.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(300)) <= kept  # none below 0.8 goes
    assert set(range(300, 600, 2)) <= kept
    assert len(kept & set(range(301, 600, 2))) <= 3


@pytest.mark.parametrize("part", [1000, 12])
def test_groups_are_those_of_exact_similarity(spark, monkeypatch, part):
    monkeypatch.setattr(S, "VERIFIED", part)  # 12: components are compared in parts
    monkeypatch.setattr(S, "ANCHORS", 2)
    r, texts = np.random.default_rng(3), []
    for size in (60, 25, 5):
        base = [f"w{k}" for k in r.integers(0, 5000, 150)]
        for _ in range(size):
            new = list(base)
            for at in r.integers(0, len(base), int(r.integers(1, 5))):
                new[at] = f"w{int(r.integers(0, 5000))}"
            texts.append(" ".join(new))
            base = new if r.random() < 0.3 else base
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id for x in S.keep_first(df).collect()} == set(groups_by_comparing_all(texts))
