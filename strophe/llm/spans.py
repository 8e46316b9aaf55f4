"""Spans of a text: (start, end, kind) in code points, end exclusive."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def ordered(spans: Iterable[tuple[int, int, str]], kinds: Sequence[str]) -> list[tuple[int, int, str]]:
    """By start, then kind as listed, then end."""
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))


def clear_of(spans: Iterable[tuple[int, int, str]], taken: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those spans that overlap none that is taken, nor one another: the first of two stays."""
    out: list[tuple[int, int, str]] = []
    busy = sorted((s[0], s[1]) for s in taken)
    at = 0
    for s in sorted(spans):
        while at < len(busy) and busy[at][1] <= s[0]:
            at += 1
        if (at == len(busy) or busy[at][0] >= s[1]) and (not out or out[-1][1] <= s[0]):
            out.append(s)
    return out


def summed_up(scanned, kinds: Sequence[str]):
    """From doc_id and spans (kind, start, end, base): the columns n_<kind> for `kinds`, base_sha256 and spans as text. With DataFrame functions, for the spans are in order already."""
    from pyspark.sql import functions as F

    base = F.filter("spans", lambda s: s["base"])
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(found, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in kinds]
    return scanned.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
