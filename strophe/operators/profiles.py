"""Profile models: hidden Markov models with a match, a delete and an insert state for each position of a pattern."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np


@dataclass
class Profile:
    """Names of the states, transitions between them, starts and ends, and the emissions of states that emit (None: silent). match: the position of the pattern that a state stands for, -1 for others."""

    names: list[str]
    transitions: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    emissions: list[np.ndarray | None]
    match: list[int]

    def to_json(self) -> str:
        return json.dumps({"names": self.names, "transitions": self.transitions.tolist(), "starts": self.starts.tolist(), "ends": self.ends.tolist(), "emissions": [None if e is None else e.tolist() for e in self.emissions], "match": self.match})

    @staticmethod
    def from_json(text: str) -> Profile:
        x = json.loads(text)
        return Profile(x["names"], np.array(x["transitions"]), np.array(x["starts"]), np.array(x["ends"]), [None if e is None else np.array(e) for e in x["emissions"]], x["match"])


def flanked(pattern: list[int], n_symbols: int, match: float = 0.9, delete: float = 0.1, flank: float = 0.99, emphasis: float = 10.0) -> Profile:
    """A model of a pattern somewhere in a sequence: a flank that emits anything, a silent state from which any match state may begin, the match, delete and insert states, a silent state that any match state may lead to, and a flank that emits anything. Match states lean to the pattern's symbols by `emphasis`."""
    n = len(pattern)
    names, kind, at = ["F0", "S0"], ["flank", "silent"], [-1, -1]
    for k in range(n):
        names.append(f"M{k}")
        kind.append("match")
        at.append(k)
        if k < n - 1:  # between positions; a pattern does not end with an insert or a delete
            names.append(f"I{k}")
            kind.append("insert")
            at.append(k)
        if 0 < k < n - 1:
            names.append(f"D{k}")
            kind.append("delete")
            at.append(k)
    names += ["S1", "F1"]
    kind += ["silent", "flank"]
    at += [-1, -1]
    place = {x: k for k, x in enumerate(names)}
    t = np.zeros((len(names), len(names)))
    t[place["F0"], place["F0"]], t[place["F0"], place["S0"]] = flank, 1 - flank
    for k in range(n):
        t[place["S0"], place[f"M{k}"]] = 1 / n

    def go(src: str, dst: str, p: float) -> None:
        if dst in place:
            t[place[src], place[dst]] += p

    for k in range(n):
        out = 1 / (n + 1)  # leaving the pattern early
        go(f"M{k}", "S1", out if k < n - 1 else 1.0)
        if k < n - 1:
            go(f"M{k}", f"M{k + 1}", (1 - out) * match)
            go(f"M{k}", f"I{k}", (1 - out) * (1 - match) / (2 if f"D{k + 1}" in place else 1))
            go(f"M{k}", f"D{k + 1}", (1 - out) * (1 - match) / 2)
            go(f"I{k}", f"I{k}", 1 / 3 if f"D{k + 1}" in place else 1 / 2)
            go(f"I{k}", f"M{k + 1}", 1 / 3 if f"D{k + 1}" in place else 1 / 2)
            go(f"I{k}", f"D{k + 1}", 1 / 3)
        if f"D{k}" in place:
            more = f"D{k + 1}" in place
            go(f"D{k}", f"M{k + 1}", (1 + (0 if more else delete)) * (1 - delete) / 1 if not more else (1 - delete) / 2)
            go(f"D{k}", f"I{k}", (1 - delete) / 2 if more else delete * delete)
            go(f"D{k}", f"D{k + 1}", delete)
    t[place["S1"], place["F1"]] = flank
    t[place["F1"], place["F1"]] = flank
    inner = t.sum(1)
    for k, x in enumerate(kind):
        if x in ("delete", "insert", "match") and inner[k] > 0:
            t[k] /= inner[k]
    flat = np.full(n_symbols, 1 / n_symbols)
    emissions: list[np.ndarray | None] = []
    for x, k in zip(kind, at):
        if x == "match":
            e = np.ones(n_symbols)
            e[pattern[k]] += emphasis
            emissions.append(e / e.sum())
        else:
            emissions.append(None if x in ("silent", "delete") else flat)
    starts, ends = np.zeros(len(names)), np.zeros(len(names))
    starts[place["F0"]], starts[place["S0"]] = flank, 1 - flank
    ends[place["S1"]] = ends[place["F1"]] = 1 - flank
    return Profile(names, t, starts, ends, emissions, [k if x == "match" else -1 for x, k in zip(kind, at)])


def decoded(model: Profile, seq: list[int]) -> list[int]:
    """The match position of each symbol on the likeliest way through the model, -1 for a symbol of a flank or an insert. Silent states lead only to states after them, so one pass over the states in order settles a column."""
    n, m = len(model.names), len(seq)
    with np.errstate(divide="ignore"):
        t, ends = np.log(model.transitions), np.log(model.ends)
        starts = np.log(model.starts)
        emit = [None if e is None else np.log(e) for e in model.emissions]
    silent = [k for k in range(n) if emit[k] is None]
    score = np.full((m + 1, n), -np.inf)
    back = np.full((m + 1, n), -1)
    for k in range(n):  # before the first symbol: silent states only
        if emit[k] is None:
            score[0, k] = starts[k]
    for k in silent:
        for j in silent:
            if j < k and score[0, j] + t[j, k] > score[0, k]:
                score[0, k], back[0, k] = score[0, j] + t[j, k], j
    for i in range(1, m + 1):
        for k in range(n):
            if emit[k] is not None:
                way = score[i - 1] + t[:, k]
                j = int(way.argmax())
                best = way[j]
                if i == 1 and starts[k] > best:
                    best, j = starts[k], -1
                score[i, k], back[i, k] = best + emit[k][seq[i - 1]], j
        for k in silent:
            way = score[i] + t[:, k]
            way[k:] = np.where([emit[j] is None for j in range(k, n)], -np.inf, way[k:])
            j = int(way.argmax())
            score[i, k], back[i, k] = way[j], j
    k, i = int((score[m] + ends).argmax()), m
    out = [-1] * m
    while i > 0 and k >= 0:
        j = int(back[i, k])
        if emit[k] is not None:
            out[i - 1] = model.match[k]
            i -= 1
        k = j
    return out
