"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, slices, stored

#: The links of the chain, in order; the last one decides. Each is a 0/1 column of the labels or, with "not ", its opposite.
CATEGORIES = ("not quality", "toxic")
#: Labelled rows that the models are fitted on at most: those with the smallest seeded hash of doc_id.
SAMPLE = 5000
FEATURES = 1000
FOLDS = 5
PRECISION, LOWEST = 0.98, 0.05
#: Words of the text become lower case; signs and digits of ASCII end a word.
_ENDS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    """The distinct words of a text: lower case, cut at ASCII signs, digits and spaces. Null: none."""
    return set((text or "").lower().encode("utf-8", "replace").translate(_ENDS).split())


def features(word: bytes) -> list[int]:
    """What a word stands for, as 32-bit hashes: itself, and its beginnings of four to seven letters, which tell families of compounds."""
    w = word.decode("utf-8", "replace")
    parts = [b"=" + word, *(w[:n].encode() for n in range(4, min(7, len(w)) + 1))]
    return [xxhash.xxh32_intdigest(p) for p in parts]


class Features:
    """The features of texts, all or those in `only`, with those of words met before at hand."""

    def __init__(self, only: dict | None = None, most: int = 300_000):
        self.some: dict[bytes, list[int]] = {}
        self.none: set[bytes] = set()
        self.only, self.most = only, most

    def __call__(self, text: str | None) -> set[int]:
        found: set[int] = set()
        for w in words(text) - self.none:
            fs = self.some.get(w)
            if fs is None:
                if len(self.some) + len(self.none) >= self.most:
                    self.some.clear()
                    self.none.clear()
                fs = [x for x in features(w) if self.only is None or x in self.only]
                if fs:
                    self.some[w] = fs
                else:
                    self.none.add(w)
            found.update(fs)
        return found


@dataclass
class Chain:
    """The fitted models: a weight row for each feature, by link; the weight of each earlier link's probability; the biases, and the least probability of the last link that counts."""

    categories: tuple[str, ...]
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    earlier: np.ndarray | None = None
    bias: np.ndarray | None = None
    threshold: float = 0.5

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """x (rows, links): the sums of the features' weights. Link after link, with what the earlier ones gave."""
        p = np.zeros_like(x)
        for k in range(x.shape[1]):
            p[:, k] = _sigmoid(x[:, k] + self.bias[k] + p[:, :k] @ self.earlier[k, :k])
        return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Nesterov steps; the bias is free."""
    n, d = x.shape
    x1 = np.concatenate((x, np.ones((n, 1), np.float32)), 1)
    penalty = np.append(np.full(d, ridge, np.float32), np.float32(1e-3))
    v = np.random.default_rng(1).normal(size=d + 1).astype(np.float32)
    for _ in range(12):  # the largest eigenvalue bounds the curvature
        v = x1.T @ (x1 @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * float(np.linalg.norm(x1.T @ (x1 @ v))) + float(penalty.max()))
    w = z = np.zeros(d + 1, np.float32)
    p = np.float32(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w[-1] = np.log(p / (1 - p))
    z = w
    for k in range(rounds):
        g = x1.T @ (_sigmoid(x1 @ z) - y) + penalty * z
        new = z - np.float32(step) * g
        z = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The lowest threshold, between LOWEST and 0.5, at which PRECISION of what lies above it, out of fold, is right; 0.5 if there is none."""
    order = np.argsort(-p, kind="stable")
    hit, said = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)  # no cut between equal probabilities
    fine = np.flatnonzero(last & (hit >= PRECISION * said) & (p[order] >= LOWEST))
    return min(0.5, float(p[order[fine[-1]]])) if len(fine) else 0.5


def fold_numbers(ids: list[int]) -> list[int]:
    """The place of each id in the order of a seeded hash: taken modulo the number of folds, folds are of one size whatever the ids have in common."""
    order = sorted(range(len(ids)), key=lambda i: (xxhash.xxh64_intdigest(str(ids[i]), 23), ids[i]))
    out = [0] * len(ids)
    for n, i in enumerate(order):
        out[i] = n
    return out


def fit(rows: list[tuple[int, dict, np.ndarray]], chosen: list[np.ndarray], categories: tuple[str, ...] = CATEGORIES, folds: int = FOLDS) -> Chain:
    """Fits the chain on (fold number, labels, hashes of the features) of labelled texts; chosen: for each link the hashes of its features, in order. Every link is fitted on the features and on the earlier links' probabilities out of fold: those that models of the other folds give. So a link learns how far to trust the earlier ones on texts that they have not seen. The last link's probabilities out of fold also set the threshold (_threshold).

    No rows, or a link with one class, give a link that says the class's share throughout.
    """
    expanded = [r[2] for r in rows]
    fold = np.array([r[0] % folds for r in rows], int)
    n = len(categories)
    chain = Chain(categories, {}, np.zeros((n, n)), np.zeros(n))
    seen = np.zeros((len(rows), 0), np.float32)
    for k, category in enumerate(categories):
        y = np.array([r[1][category] for r in rows], np.float32)
        if not len(y) or y.min() == y.max():
            chain.bias[k] = 20.0 if len(y) and y.min() else -20.0
            seen = np.concatenate((seen, np.full((len(y), 1), y[:1].mean() if len(y) else 0, np.float32)), 1)
            continue
        names = chosen[k]
        x = np.zeros((len(rows), len(names) + k), np.float32)
        for r, fs in enumerate(expanded):
            x[r, np.flatnonzero(np.isin(names, fs))] = 1
        x[:, len(names) :] = seen
        out = np.zeros(len(y), np.float32)
        for f in range(folds):
            rest, own = fold != f, fold == f
            if own.any() and rest.any():
                w, b = _logistic(x[rest], y[rest])
                out[own] = _sigmoid(x[own] @ w + b)
        seen = np.concatenate((seen, out[:, None]), 1)
        w, chain.bias[k] = _logistic(x, y)
        chain.earlier[k, :k] = w[len(names) :]
        for f, weight in zip(names.tolist(), w):
            chain.weights.setdefault(f, np.zeros(n, np.float32))[k] = weight
        if k == n - 1:
            chain.threshold = _threshold(out, y)
    return chain


def chosen(found: DataFrame, links: int, most: int = FEATURES) -> list[np.ndarray]:
    """For each link (l0, l1, ... of found, 0 or 1) the features that tell its classes best: in four texts at least, by the log likelihood ratio times the root of their number, both ways; ties to the smaller hash. In order of the hash. Counts are made by Spark; the driver gets at most `most` numbers a link."""
    names = [f"l{k}" for k in range(links)]
    total = found.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    if not total["n"]:
        return [np.empty(0, np.uint32)] * links
    n = found.select(F.explode("found").alias("feature"), *names).groupBy("feature").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).where("n >= 4")
    n = stored(n, "features")
    out = []
    for c in names:
        ones = float(total[c])
        score = F.abs(F.log((F.col(c) + 0.5) / (ones + 1)) - F.log((F.col("n") - F.col(c) + 0.5) / (total["n"] - ones + 1))) * F.sqrt("n")
        best = n.select("feature", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "feature").limit(most)
        out.append(np.sort(np.array([r.feature for r in best.select("feature").collect()], np.uint32)))
    return out


def fit_on(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """Fits the chain on at most `sample` labelled documents: those with the smallest seeded hashes of doc_id. Of several labels of a document the least count (by the categories), of several texts the one with the least hash; nulls are left out.

    The sample's texts become hashes of features where they are; features are counted and chosen by Spark (chosen), and the driver gets of each document the chosen ones alone: at most `sample` rows of FEATURES numbers a link.
    """
    names = [f"l{k}" for k in range(len(categories))]
    columns = [(F.lit(1) - F.col(c[4:]) if c.startswith("not ") else F.col(c)).cast("int").alias(n) for n, c in zip(names, categories)]
    given = labels.select("doc_id", *columns).dropna().groupBy("doc_id").agg(F.min(F.struct(*names)).alias("l")).select("doc_id", "l.*")
    known = stored(given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labels")  # `sample` rows at most
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(known), "doc_id")
    least = texts.groupBy("doc_id").agg(F.min("h").alias("h"))
    of = Features()

    def f(b: pa.RecordBatch) -> dict:
        found = [np.sort(np.fromiter(of(t), np.int64)) for t in b.column("text").to_pylist()]
        return {"found": pa.array(found, pa.list_(pa.int64()))} | {c: b.column(c) for c in ("doc_id", "h", *names)}

    rows = per_batch(texts, "doc_id long, h long, found array<long>, " + ", ".join(f"{c} int" for c in names), f)
    rows = rows.join(F.broadcast(least), ["doc_id", "h"]).groupBy("doc_id").agg(F.first("found").alias("found"), *[F.first(c).alias(c) for c in names])
    rows = stored(rows, "sample")
    features = chosen(rows, len(categories))
    some = np.unique(np.concatenate([np.empty(0, np.uint32), *features])).astype(np.int64)

    def kept(b: pa.RecordBatch) -> dict:
        hits = [np.intersect1d(x, some, assume_unique=True).astype(np.uint32).tobytes() for x in (np.asarray(x or [], np.int64) for x in b.column("found").to_pylist())]
        return {"found": hits} | {c: b.column(c) for c in ("doc_id", *names)}

    got = per_batch(rows, "doc_id long, found binary, " + ", ".join(f"{c} int" for c in names), kept).collect()
    got = sorted((r.doc_id, [r[c] for c in names], bytes(r.found)) for r in got)
    return fit([(f, dict(zip(categories, ls)), np.frombuffer(x, np.uint32)) for f, (_, ls, x) in zip(fold_numbers([r[0] for r in got]), got)], features, categories)


def judged(texts: list[str | None], chain: Chain, of: Features) -> tuple[np.ndarray, np.ndarray]:
    """The probabilities of texts (texts by links), and whether the last one reaches the threshold; of: the features that have weights."""
    sums = np.zeros((len(texts), len(chain.categories)), np.float64)
    for k, text in enumerate(texts):
        for x in sorted(of(text)):
            sums[k] += chain.weights[x]
    p = chain.probabilities(sums)
    return p, p[:, -1] >= chain.threshold


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """For each row: doc_id, probabilities (an array in the order of the chain's categories) and toxic, 1 if the last one reaches the chain's threshold.

    The whole text counts. Null and empty texts have no features, so they get the chain's word for nothing: the biases. Repeated rows stay, an empty table gives none, other columns do not matter. The weights (some thousand features, bounded by FEATURES a link) go to the tasks with the function.
    """
    of = Features(chain.weights)

    def f(b: pa.RecordBatch) -> dict:
        p, toxic = judged(b.column("text").to_pylist(), chain, of)
        return {"doc_id": b.column("doc_id"), "probabilities": p.tolist(), "toxic": toxic.astype(np.int32)}

    return per_batch(docs.select("doc_id", "text"), "doc_id long, probabilities array<double>, toxic int", f)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the chain rejects; all columns stay, whatever their names. Null and empty texts are judged by the biases alone; repeated rows share their fate; an empty table gives none."""
    chain = fit_on(docs, labels)
    of = Features(chain.weights)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                yield part.filter(pa.array(~judged(part.column("text").to_pylist(), chain, of)[1]))

    return docs.mapInArrow(keep, docs.schema)
