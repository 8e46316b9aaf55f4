"""Profile models of songs, fitted by expected counts: batches of sequences are tasks, counts and models are rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import dropped, stored

#: States are named by what they are and by their position from 0 (before the first) to the model's length: an insert, a match (at position 0 the begin) and a delete. They lead to the insert of their position, and to the match (after the last the end) or the delete of the next.
INSERT, MATCH, DELETE = range(3)
#: Sequences of a batch, at most, and cells that are worked on at once.
BATCH, CELLS = 256, 1 << 21
_NEVER = -690.0  # the logarithm of what no way has


def initial(length: int, n_symbols: int, match: float = 0.9, delete_insert: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions (source, position, target), and emissions of inserts and matches (position, symbol), before training: symbols are even."""
    t = np.zeros((3, length + 1, 3))
    t[INSERT] = 1 / 3
    t[MATCH] = (1 - match) / 2
    t[MATCH, :, MATCH] = match
    t[DELETE] = (1 - delete_insert) / 2
    t[DELETE, :, INSERT] = delete_insert
    t[MATCH, 0] = 1 / 3
    t[DELETE, 0] = 0
    t[:, length, MATCH] = 2 / 3  # the end
    t[:, length, DELETE] = 0
    if length == 0:
        t[DELETE] = 0
    sums = t.sum(2, keepdims=True)
    t = np.divide(t, sums, out=np.zeros_like(t), where=sums > 0)
    flat = np.full((length + 1, n_symbols), 1 / n_symbols)
    first = flat.copy()
    first[0] = 0  # the begin emits nothing
    return t, flat, first


def logs(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(p), _NEVER)


class Chains:
    """Sequences of one song side by side, as a model sees them. Rows of scores are (sequences, states of a kind, positions); a sequence that has ended keeps its last row."""

    def __init__(self, transitions: np.ndarray, inserts: np.ndarray, matches: np.ndarray, seqs: list[list[int]], join=np.logaddexp):
        self.t, self.e_i, self.e_m, self.join = logs(transitions), logs(inserts), logs(matches), join
        self.lengths = np.array([len(s) for s in seqs])
        self.syms = np.zeros((len(seqs), int(self.lengths.max(initial=0)) + 1), np.int64)
        for row, s in zip(self.syms, seqs):
            row[: len(s)] = s
        self.n = self.t.shape[1] - 1
        # deletes follow one another within a row; sums of what that costs turn the chain into running sums (or maxima)
        self.chain = np.concatenate(([0.0], np.cumsum(self.t[DELETE, 1 : self.n, DELETE]))) if self.n else np.zeros(0)

    def _deletes(self, ins: np.ndarray, mat: np.ndarray) -> np.ndarray:
        """Scores of deletes from inserts and matches of the same row."""
        out = np.full_like(ins, -np.inf)
        if self.n:
            into = self.join(ins[:, :-1] + self.t[INSERT, :-1, DELETE], mat[:, :-1] + self.t[MATCH, :-1, DELETE])
            out[:, 1:] = self.join.accumulate(into - self.chain, axis=1) + self.chain
        return out

    def first(self) -> np.ndarray:
        out = np.full((len(self.lengths), 3, self.n + 1), -np.inf)
        out[:, MATCH, 0] = 0.0
        out[:, DELETE] = self._deletes(out[:, INSERT], out[:, MATCH])
        return out

    def forward(self, row: np.ndarray, i: int) -> np.ndarray:
        """The row of the i-th symbol (from 1) from the one before."""
        x = self.syms[:, i - 1]
        via = lambda to: self.join(self.join(row[:, INSERT] + self.t[INSERT, :, to], row[:, MATCH] + self.t[MATCH, :, to]), row[:, DELETE] + self.t[DELETE, :, to])
        out = np.full_like(row, -np.inf)
        out[:, INSERT] = via(INSERT) + self.e_i[:, x].T
        out[:, MATCH, 1:] = via(MATCH)[:, :-1] + self.e_m[1:, x].T
        out[:, DELETE] = self._deletes(out[:, INSERT], out[:, MATCH])
        return np.where((i <= self.lengths)[:, None, None], out, row)

    def end(self, row: np.ndarray) -> np.ndarray:
        """Scores of whole sequences from their last rows."""
        last = row[:, :, -1] + self.t[:, -1, MATCH]
        return self.join(self.join(last[:, INSERT], last[:, MATCH]), last[:, DELETE])

    def last(self) -> np.ndarray:
        """The row of what is left after the last symbol."""
        out = np.full((len(self.lengths), 3, self.n + 1), -np.inf)
        out[:, :, -1] = self.t[:, -1, MATCH]
        return self._back_deletes(out)

    def _back_deletes(self, out: np.ndarray) -> np.ndarray:
        """Adds ways over deletes of the same row, of which those without are given."""
        if self.n:
            d = out[:, DELETE, 1:]
            d = self.join.accumulate((d + self.chain)[:, ::-1], axis=1)[:, ::-1] - self.chain
            out[:, DELETE, 1:] = d
            for s in (INSERT, MATCH):
                out[:, s, :-1] = self.join(out[:, s, :-1], self.t[s, :-1, DELETE] + d)
        return out

    def ahead(self, row: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """What the i-th symbol and all after it score from the insert of a position, and from the match of the next."""
        x = self.syms[:, i - 1]
        ins = self.e_i[:, x].T + row[:, INSERT]
        mat = np.full_like(ins, -np.inf)
        mat[:, :-1] = self.e_m[1:, x].T + row[:, MATCH, 1:]
        return ins, mat

    def backward(self, row: np.ndarray, i: int) -> np.ndarray:
        """The row before the i-th symbol from the one after it."""
        ins, mat = self.ahead(row, i)
        out = np.stack([self.join(self.t[s, :, INSERT] + ins, self.t[s, :, MATCH] + mat) for s in range(3)], 1)
        return np.where((i <= self.lengths)[:, None, None], self._back_deletes(out), row)

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        """Forward rows from the last to the first; only every so many are kept, the others are worked out again, so memory grows with the root of the length."""
        m = int(self.lengths.max(initial=0))
        step = max(1, int(np.sqrt(m)))
        kept, row = {0: self.first()}, self.first()
        for i in range(1, m + 1):
            row = self.forward(row, i)
            if i % step == 0:
                kept[i] = row
        for lo in range(m - m % step, -1, -step):
            part = [kept[lo]]
            for i in range(lo + 1, min(lo + step, m + 1)):
                part.append(self.forward(part[-1], i))
            for i in range(len(part) - 1, -1, -1):
                yield lo + i, part[i]


def expected(transitions: np.ndarray, inserts: np.ndarray, matches: np.ndarray, seqs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of transitions and emissions over sequences, in the shape of the model, and the sum of their log-likelihoods."""
    c = Chains(transitions, inserts, matches, seqs)
    n_t, n_i, n_m = np.zeros_like(transitions), np.zeros_like(inserts), np.zeros_like(matches)
    total = back = None
    for i, row in c.rows():
        if total is None:
            total, back = c.end(row), c.last()
            # ends: from the last row of each sequence
            n_t[:, -1, MATCH] += np.exp(row[:, :, -1] + c.t[:, -1, MATCH] - total[:, None]).sum(0)
        live = (i < c.lengths)[:, None]  # sequences that have a symbol after this row
        if live.any():
            ins, mat = c.ahead(back, i + 1)
            for s in range(3):
                for to, more in ((INSERT, ins), (MATCH, mat)):
                    n_t[s, :, to] += np.where(live, np.exp(row[:, s] + c.t[s, :, to] + more - total[:, None]), 0).sum(0)
            back = c.backward(back, i + 1)
        if c.n:
            done = (i <= c.lengths)[:, None]
            for s in range(3):
                n_t[s, :-1, DELETE] += np.where(done, np.exp(row[:, s, :-1] + c.t[s, :-1, DELETE] + back[:, DELETE, 1:] - total[:, None]), 0).sum(0)
        if i:
            now = i <= c.lengths
            x = c.syms[:, i - 1]
            for s, out in ((INSERT, n_i), (MATCH, n_m)):
                np.add.at(out.T, x[now], np.exp(row[now, s] + back[now, s] - total[now, None]))
    if total is None:
        return n_t, n_i, n_m, 0.0
    return n_t, n_i, n_m, float(total.sum())


def likeliest(transitions: np.ndarray, inserts: np.ndarray, matches: np.ndarray, seq: list[int]) -> tuple[list[int], float]:
    """The match position (from 0) of each symbol on the likeliest way, -1 for inserts, and its log-probability. Of equal ways inserts go before matches, and these before deletes, from the end on."""
    c = Chains(transitions, inserts, matches, [seq], np.maximum)
    out, state, k, score = [-1] * len(seq), None, c.n, 0.0
    for i, row in c.rows():
        r = row[0]
        if state is None:
            last = r[:, -1] + c.t[:, -1, MATCH]
            state, score = int(last.argmax()), float(last.max())
        else:  # state emits the symbol after this row
            to = state
            if to == MATCH:
                k -= 1
            state = int((r[:, k] + c.t[:, k, to]).argmax())
        while state == DELETE:
            k -= 1
            state = int((r[:, k] + c.t[:, k, DELETE])[[INSERT, MATCH, DELETE]].argmax())
        if i and state == MATCH:
            out[i - 1] = k - 1
    return out, score


#: Kinds of a model's rows: a transition is (source, position, target); an emission is (insert or match, position, symbol).
TRANSITION, EMISSION = 0, 1
COUNTS = "song {0}, kind int, state int, at int, what int, n double"


def begin(seqs: DataFrame, match: float = 0.9, delete_insert: float = 0.1) -> DataFrame:
    """Untrained models of songs, for packed sequences (song, seq_id, syms): rows (song, kind, state, at, what, p). A model is as long as the sequence whose length is nearest to the song's median, the smaller of two, and knows the symbols up to the song's largest. Only lengths are looked at to choose it, so no task holds a song."""
    n = seqs.select("song", F.size("syms").alias("n"), F.array_max("syms").alias("most"))
    median = n.groupBy("song").agg(F.floor(F.percentile("n", 0.5)).alias("median"), (F.coalesce(F.max("most"), F.lit(0)) + 1).alias("n_symbols"))
    near = n.groupBy("song", "n").agg(F.count("*").alias("times")).join(median, "song").groupBy("song", "n_symbols").agg(F.min_by("n", F.struct(F.abs(F.col("n") - F.col("median")), "n")).alias("length"))
    song = seqs.schema["song"].dataType.simpleString()

    def run(frames):
        for f in frames:
            for s, symbols, length in f.itertuples(index=False):
                yield _as_rows(s, initial(int(length), int(symbols), match, delete_insert))

    return near.select("song", "n_symbols", "length").mapInPandas(run, COUNTS.format(song)).withColumnRenamed("n", "p")


def _as_rows(song, model: tuple[np.ndarray, ...], counts: bool = False) -> pd.DataFrame:
    t, e_i, e_m = model
    s, k, to = np.nonzero(t)
    parts = [(TRANSITION, s, k, to, t[s, k, to])]
    for state, e in ((INSERT, e_i), (MATCH, e_m)):
        k, x = np.nonzero(e)
        parts.append((EMISSION, np.full(len(k), state), k, x, e[k, x]))
    cols = [np.concatenate([np.full(len(p[1]), p[0]) for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in range(1, 5))]
    out = pd.DataFrame(dict(zip(("kind", "state", "at", "what", "n"), cols)))
    out.insert(0, "song", [song] * len(out))
    return out


def _as_arrays(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, state, at, what, p = (f[c].to_numpy() for c in ("kind", "state", "at", "what", "p"))
    e = kind == EMISSION
    length, symbols = int(at.max()), int(what[e].max(initial=0)) + 1
    t, e_i, e_m = np.zeros((3, length + 1, 3)), np.zeros((length + 1, symbols)), np.zeros((length + 1, symbols))
    t[state[~e], at[~e], what[~e]] = p[~e]
    for s, out in ((INSERT, e_i), (MATCH, e_m)):
        of = e & (state == s)
        out[at[of], what[of]] = p[of]
    return t, e_i, e_m


def _batched(seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences with their batch, and the number of batches of each song."""
    number = seqs.groupBy("song").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("batches"))
    dealt = seqs.join(number, "song").withColumn("batch", F.pmod(F.xxhash64("seq_id"), F.col("batches")).cast("int")).drop("batches")
    return stored(dealt, "batches"), stored(number, "songs")


def _by_batch(batched: tuple[DataFrame, DataFrame], models: DataFrame, f, schema: str) -> DataFrame:
    """f(song, model, ids, sequences) for each batch of a song's sequences: a batch and one model are a task's input."""
    seqs, number = batched
    sent = models.join(number, "song").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).drop("batches")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        a = a.sort_values("seq_id")
        return f(a["song"].iloc[0], _as_arrays(b), a["seq_id"].tolist(), [[int(x) for x in s] for s in a["syms"]])

    return seqs.groupBy("song", "batch").cogroup(sent.groupBy("song", "batch")).applyInPandas(run, schema)


def _counted(batched: tuple[DataFrame, DataFrame], models: DataFrame) -> DataFrame:
    """Expected counts of all sequences: (song, kind, state, at, what, n), and the log-likelihood as kind -1. Batches sum their own before rows are shuffled."""

    def f(song, model, ids, seqs):
        size = max(1, CELLS // (model[0].shape[1] * 6 * (1 + int(np.sqrt(max(map(len, seqs)))))))
        by_length = sorted(seqs, key=len)
        parts = [expected(*model, by_length[i : i + size]) for i in range(0, len(by_length), size)]
        out = _as_rows(song, tuple(sum(p[k] for p in parts) for k in range(3)))
        return pd.concat([out, pd.DataFrame({"song": [song], "kind": [-1], "state": [0], "at": [0], "what": [0], "n": [sum(p[3] for p in parts)]})])

    schema = COUNTS.format(models.schema["song"].dataType.simpleString())
    return _by_batch(batched, models, f, schema).groupBy("song", "kind", "state", "at", "what").agg(F.sum("n").alias("n"))


def trained(seqs: DataFrame, rounds: int = 1, match: float = 0.999, delete_insert: float = 0.01, dist_inertia: float = 0.8, edge_inertia: float = 0.8, pseudocount: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Profile models of songs fitted to packed sequences (song, seq_id, syms) by rounds of expected counts: the models, as rows (song, kind, state, at, what, p), and (song, round, likelihood), the summed log-likelihood of a song's sequences before each round.

    A round is forward-backward over batches of sequences and one sum by key; then each probability is the share of its count plus the pseudocount among those of its state, mixed with the old one by the inertia (of emissions, of transitions). Without pseudocount no round lowers the likelihood. A state that nothing reaches keeps its probabilities.

    Null songs and sequences are left out, empty sequences count (they delete all). Repeated sequences count as often as they are there.
    """
    batched = _batched(seqs.where("song IS NOT NULL AND syms IS NOT NULL"))
    models = stored(begin(batched[0], match, delete_insert), "model")
    history = None
    for r in range(rounds):
        counts = stored(_counted(batched, models), "counts")
        said = counts.where("kind = -1").select("song", F.lit(r).alias("round"), F.col("n").alias("likelihood"))
        history = said if history is None else history.unionByName(said)
        key = ["song", "kind", "state", "at"]
        n = F.coalesce("n", F.lit(0.0)) + pseudocount
        both = models.join(counts.where("kind >= 0"), [*key, "what"], "left").withColumn("n", n).withColumn("total", F.sum("n").over(Window.partitionBy(*key)))
        inertia = F.when(F.col("kind") == EMISSION, dist_inertia).otherwise(edge_inertia)
        new = F.when(F.col("total") > 0, inertia * F.col("p") + (1 - inertia) * F.col("n") / F.col("total")).otherwise(F.col("p"))
        old, models = models, stored(both.select(*key, "what", new.alias("p")), "model")
        dropped(old)
    return models, history


def aligned(seqs: DataFrame, models: DataFrame) -> DataFrame:
    """A multiple alignment of songs: for each symbol of packed sequences (song, seq_id, syms) the model position that it matches on the likeliest way, -1 for inserts: (song, seq_id, pos, state, score), score being the way's log-probability."""
    song, seq = (seqs.schema[c].dataType.simpleString() for c in ("song", "seq_id"))
    schema = f"song {song}, seq_id {seq}, pos int, state int, score double"

    def f(s, model, ids, of):
        rows = [(s, i, k, state, score) for i, x in zip(ids, of) for path, score in [likeliest(*model, x)] for k, state in enumerate(path)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return _by_batch(_batched(seqs.where("song IS NOT NULL AND syms IS NOT NULL")), models, f, schema)
