"""Whole corpora of songs: cleaned to a fixpoint, aligned, and their shared structure."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import dropped, stored
from . import chains as H
from . import consensus as C
from . import kernels as K
from . import matrices as M
from . import parts as N
from . import statistics as S


def outliers(seq: DataFrame, least: float = 2.5, several: int = 2, most: float = 4.0) -> DataFrame:
    """Sequences to leave out of their songs: those that two of three distances (of symbols and pairs, of 4-grams, and of length) put beyond `least` deviations, or one beyond `most`: (seq_id)."""
    hists = [S.freq_trans_hist(seq), S.tuple_hist(seq, 4, relative=True)]
    scores = [S.outlier_scores(S.chi2_distances(h)).select("seq_id", F.coalesce("z", F.lit(0.0)).alias("z")) for h in hists]
    n = seq.groupBy("seq_id").agg(F.count("*").alias("n"))
    scores.append(S.z_scores(n, "n").select("seq_id", F.coalesce("z", F.lit(0.0)).alias("z")))
    return seq.select("seq_id").distinct().join(S.outlier_filter(scores, least, several, most), "seq_id", "left_anti")


def preprocessed(seq: DataFrame, grid: DataFrame, low: float, high: float, rounds: int = 6) -> DataFrame:
    """Sequences (seq_id, pos, sym) at one tempo and without outliers: outliers go; each sequence is brought to its best tempo (double_time_choice); outliers of what that gives go, and it starts again from the sequences as they are, until the result has been seen before, at most `rounds` times. Each round is a stored table; the driver gets a count and a sum."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("seq_id", "pos", "sym").cast("decimal(20,0)"))).first())

    def without(df: DataFrame, bad: DataFrame) -> DataFrame:
        return df.join(bad, "seq_id", "left_anti")

    def at_tempo(df: DataFrame) -> DataFrame:
        choice = stored(S.double_time_choice(df, grid, low, high), "choice", plain=True)
        out = stored(S.adjusted_each(df, choice), "tempo", plain=True)
        dropped(choice)
        return out

    own = stored(without(seq.select("seq_id", "pos", "sym"), outliers(seq)), "sequences", plain=True)
    now = at_tempo(own)
    seen = {state(now)}
    for _ in range(rounds):
        bad = stored(outliers(now), "outliers")
        fewer = stored(without(own, bad), "sequences", plain=True)
        new = at_tempo(fewer)
        for old in (own, now, bad):
            dropped(old)
        own, now = fewer, new
        if (s := state(now)) in seen:
            break
        seen.add(s)
    return now


def song_segments(seq: DataFrame, partners: int = 20, min_len: int = 16, gaps: int = 4, ratio: float = 0.2, least: int = 1) -> DataFrame:
    """The segments of all self- and mutual alignments of songs' sequences: (song, a, b, i0, j0, len)."""
    mutual = M.mutual_align(seq, S.pairings(seq, partners), min_len, gaps, ratio).select("a", "b", "i0", "j0", "len")
    own = M.self_align(seq, min_len, least, gaps, ratio).select(F.col("seq_id").alias("a"), F.col("seq_id").alias("b"), "i0", "j0", "len")
    return mutual.unionByName(own).select(S.song("a").alias("song"), "*")


def songs(seq: DataFrame, partners: int = 20, min_len: int = 16, gaps: int = 4, ratio: float = 0.2, least: int = 1) -> DataFrame:
    """A row for each song: its sequences (seq_ids, and their symbols) and the segments of all self- and mutual alignments, as (a, b, i0, j0, len) with the sequences' places in seq_ids: (song, seq_ids, seqs, segs). Sequences and segments of a song are one task's input, as they are in the field."""
    n = int(seq.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # songs are small, but much work: a number that is named keeps Spark from putting them into few tasks by their size
    segs = song_segments(seq, partners, min_len, gaps, ratio, least).repartition(n, "song").groupBy("song").agg(F.array_sort(F.collect_list(F.struct("a", "b", "i0", "j0", "len"))).alias("segs"))
    seqs = K.packed(seq).withColumn("song", S.song()).repartition(n, "song").groupBy("song").agg(F.array_sort(F.collect_list(F.struct("seq_id", "syms"))).alias("seqs"))
    return seqs.join(segs, "song", "left")


def per_song(packed: DataFrame, f: Callable[[list[int], list[list[int]], list[C.Segment]], list[tuple]], columns: str) -> DataFrame:
    """Applies f(ids, sequences, segments) to every song of songs(); it gives rows for the columns after song."""
    names = ["song", *[c.split()[0] for c in columns.split(", ")]]

    def rows(frame):
        for song, seqs, segs in frame[["song", "seqs", "segs"]].itertuples(index=False):
            ids = [int(s["seq_id"]) for s in seqs]
            place = {x: k for k, x in enumerate(ids)}
            own = [(place[int(s["a"])], place[int(s["b"])], int(s["i0"]), int(s["j0"]), int(s["len"])) for s in (segs if segs is not None else [])]
            yield from ((song, *r) for r in f(ids, [[int(x) for x in s["syms"]] for s in seqs], own))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(rows(frame)), columns=names, dtype=object)

    # a batch for each song: thousands of songs with all their segments at once are more than a worker has room for
    return packed.where("song is not null").groupBy("song").applyInPandas(run, f"song long, {columns}")


def structure(seq: DataFrame, segs: DataFrame, min_dist: int = 8, least: int = 3) -> DataFrame:
    """The structure that songs' sequences (song, seq_id, pos, sym) share by their segments (song, a, b, i0, j0, len): components of aligned points, the holes of their chains filled, small ones left out, gaps realigned; then (song, entropy, comps, points, positions). Each step is a stored table, worked on by parts, passages and gaps of songs, so no task holds one."""
    seq = stored(seq.select("song", "seq_id", "pos", "sym"), "sequences")
    n = seq.groupBy("seq_id").agg(F.count("*").alias("n"))
    comps = stored(H.filled(N.linked_parts(segs, "song", min_dist), n, 0.5, least), "filled")
    e = H.entropies(seq, stored(H.realigned(seq, comps, 4, 1), "realigned"))
    all_ = seq.groupBy("song").agg(F.count("*").cast("int").alias("positions")).join(e, "song", "left")
    return all_.select("song", F.round(F.coalesce("entropy", F.lit(0.0)), 6).alias("entropy"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("comps", "points")), "positions")


def run(seq: DataFrame, partners: int, min_len: int, gaps: int, ratio: float) -> DataFrame:
    """The corpus from sequences to shared structure: (song, entropy, comps, points, positions)."""
    return structure(seq.withColumn("song", S.song()), song_segments(seq, partners, min_len, gaps, ratio))


def partner_sweep(seq: DataFrame, partners: list[int], min_len: int, gaps: int, ratio: float) -> DataFrame:
    """run() for several numbers of partners: (partners, song, entropy, comps, points, positions). The number is a column of one plan: sequences are read and aligned with themselves once, and pairs once for the largest number, as each smaller one has the nearer of them; from there on a song and a number are a song of their own."""
    own = M.self_align(seq, min_len, 1, gaps, ratio).select(F.col("seq_id").alias("a"), F.col("seq_id").alias("b"), "i0", "j0", "len", F.lit(0).alias("step"))
    pairs = stored(S.ring_pairs(seq, max(partners)), "pairs")
    mutual = M.mutual_align(seq, pairs.select("a", "b"), min_len, gaps, ratio).select("a", "b", "i0", "j0", "len").join(pairs, ["a", "b"])
    segs = stored(mutual.select("a", "b", "i0", "j0", "len", "step").unionByName(own), "segments")
    n = len(partners)
    number = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit((p + 1) // 2).alias("most")) for k, p in enumerate(partners)]))
    own_id = lambda c: (F.col(c) * n + F.col("v.k")).alias(c)
    all_segs = segs.withColumn("v", number).where("step <= v.most").select((S.song("a") * n + F.col("v.k")).alias("song"), own_id("a"), own_id("b"), "i0", "j0", "len")
    all_seqs = seq.withColumn("v", number).select((S.song() * n + F.col("v.k")).alias("song"), own_id("seq_id"), "pos", "sym")
    x = structure(all_seqs, all_segs)
    which = F.element_at(F.array(*map(F.lit, partners)), (F.pmod("song", F.lit(n)) + 1).cast("int"))
    return x.select(which.alias("partners"), F.floor(F.col("song") / n).alias("song"), "entropy", "comps", "points", "positions")
