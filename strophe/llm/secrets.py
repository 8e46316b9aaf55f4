"""Secret scans: three patterns, and credential values weighed by what it takes to guess them."""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch
from .spans import clear_of, ordered

KINDS = ("assign", "access", "hex", "password")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A credential's name, then a sign or "is", then a value that need not look like a key.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|passwort|contrase(?:\xf1|n)a|mot\x20de\x20passe|pwd|pass|secret|token|api[_-]?key|credentials?|access[_-]?key)["']?[\x20\t]*(?::=|=>|[:=]|is(?=[\x20\t]))[\x20\t]*(?:"([^"\s]+)"|'([^'\s]+)'|([^\s"'<>,;]+))""",
    re.I,
)
#: One of these is in every match of ASSIGN or CONTEXT, in lower case.
NEEDLES = ("pass", "pwd", "secret", "token", "key", "credential", "contrase")
#: A value that takes at least 10 ** this many guesses counts as a secret, less as a placeholder or a plain word.
SECRET_COST = 7.0
SHORTEST = 6

#: Ranked vocabularies of public tokenizers (lines of a token in Base64 and its rank), from which words come; one that is not there adds none.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Frequent passwords, most frequent first; they come before the words of a vocabulary.
FREQUENT = """password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou sunshine princess football
shadow baseball trustno1 superman batman hello freedom whatever secret test guest root user default changeme example
pass passwd token none null true false value string dummy sample placeholder temp demo""".split()
#: Rows of a keyboard; keys are neighbours beside one another and in the row below.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: What stands for which letter.
LEET = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d|(?:19|20)\d\d")

#: Longest word, and longest part of a repetition or a walk that is a span; the whole of one is a span too, whatever its length.
LONGEST, PART = 24, 64
_AT = {c: (x, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_NEXT: dict[str, set[str]] = {}
for _y, _row in enumerate(ROWS):
    for _x, _c in enumerate(_row):
        near = _row[max(0, _x - 1) : _x + 2] + (ROWS[_y + 1][max(0, _x - 1) : _x + 1] if _y + 1 < len(ROWS) else "")
        for _o in set(near) - {_c}:
            _NEXT.setdefault(_c, set()).add(_o)
            _NEXT.setdefault(_o, set()).add(_c)


def _step(a: str, b: str) -> tuple[int, int]:
    return _AT[b][0] - _AT[a][0], _AT[b][1] - _AT[a][1]


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 500)


@lru_cache(4)
def ranked_words(paths: tuple[str, ...] = VOCABULARIES) -> dict[str, int]:
    """How many guesses a word takes: its place among FREQUENT, or behind these its place among the words of a vocabulary, the best of several. Words are tokens of letters, three at least, that begin a word. The dictionary is bounded by the vocabularies."""
    out = {w: n + 1 for n, w in enumerate(FREQUENT)}
    for path in paths:
        n = len(FREQUENT)
        if os.path.exists(path):
            with open(path, "rb") as f:
                tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
            for _, token in tokens:
                word = token[1:].decode("utf-8", "ignore").lower()
                if token[:1] == b" " and 3 <= len(word) <= LONGEST and word.isalpha():
                    n += 1
                    out[word] = min(out.get(word, n), n)
    return out


def _lower(value: str) -> str:
    """value in lower case, letter for letter."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def word_cost(value: str, words: dict[str, int]) -> float | None:
    """log10 of the guesses for a word with capitals and letter-like signs; None if it is none."""
    low = _lower(value)
    for form, extra in ((low, 0.0), (low.translate(LEET), 0.5)):
        if rank := words.get(form):
            capitals = 0.0 if value.islower() or not value.isalpha() else 0.3 if value.istitle() or value.isupper() else 1.0
            return math.log10(rank + 1) + capitals + extra
    return None


def _runs(together: list[bool]) -> Iterator[tuple[int, int]]:
    """Stretches (start, end) of true values."""
    start = None
    for k, t in enumerate([*together, False]):
        if t and start is None:
            start = k
        elif not t and start is not None:
            yield start, k
            start = None


def _parts(start: int, end: int, least: int, step: int = 1) -> Iterator[tuple[int, int]]:
    """The parts of a stretch: of `least` to PART characters, in steps, and the whole."""
    for i in range(start, end):
        for j in range(i + least, min(end, i + PART) + 1, step):
            yield i, j
    if end - start > PART:
        yield start, end


def span_costs(value: str, words: dict[str, int]) -> dict[tuple[int, int], float]:
    """The cheapest way to guess each part of a value that is a word, a date, a repetition or a keyboard walk: (start, end) to log10 of the guesses."""
    out: dict[tuple[int, int], float] = {}
    n, low = len(value), _lower(value)

    def offer(i: int, j: int, cost: float) -> None:
        if cost < out.get((i, j), math.inf):
            out[i, j] = cost

    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            if (cost := word_cost(value[i:j], words)) is not None:
                offer(i, j, cost)
        for j in range(i + 4, min(n, i + 10) + 1):
            if DATE.fullmatch(value, i, j):
                offer(i, j, math.log10(120 if j - i == 4 else 365 * 120))
    for unit in range(1, 9):
        for a, b in _runs([low[k] == low[k + unit] for k in range(n - unit)]):
            for i, j in _parts(a, b + unit, max(3, 2 * unit), 1):
                once = sum(map(_brute, value[i : i + unit]))
                word = word_cost(value[i : i + unit], words) if unit > 2 else None
                offer(i, j, min(once, once if word is None else word) + math.log10((j - i) / unit + 1))
    for a, b in _runs([low[k + 1] in _NEXT.get(low[k], ()) for k in range(n - 1)]):
        for i, j in _parts(a, b + 1, 3):
            turns = sum(_step(low[k - 1], low[k]) != _step(low[k - 2], low[k - 1]) for k in range(i + 2, j))
            offer(i, j, math.log10(40 * (j - i)) + 0.4 * turns)
    return out


def guess_cost(value: str, words: dict[str, int] | None = None) -> float:
    """log10 of the guesses for a value: the least, over all ways to cut it into words, dates, repetitions, walks and parts tried by brute force, of the parts' sum and log10(2) for each cut.

    Two costs lead up to each character: the least of a cut whose last part is tried by brute force and goes on, and the least of one whose last part is a span. Spans are of bounded length but for whole repetitions and walks, so the time is in proportion to the value's length. An empty value costs 0."""
    words = ranked_words() if words is None else words
    n, cut = len(value), math.log10(2)
    into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for (i, j), c in span_costs(value, words).items():
        into[j].append((i, c))
    force, span = [0.0] + [math.inf] * n, [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        force[j] = min(force[j - 1], span[j - 1] + (cut if j > 1 else 0.0)) + _brute(value[j - 1])
        for i, c in into[j]:
            span[j] = min(span[j], min(force[i], span[i]) + c + (cut if i else 0.0))
    return min(force[n], span[n])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """What the three patterns find, leftmost and not overlapping within a kind; matches that are too short are dropped without another try."""
    low = text.lower()
    out = []
    if any(x in low for x in NEEDLES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return ordered(out, KINDS)


def credential_values(text: str, words: dict[str, int] | None = None) -> Iterator[tuple[int, int, float]]:
    """(start, end, guess cost) of every value in a credential's context."""
    low = text.lower()
    if any(x in low for x in NEEDLES):
        for m in CONTEXT.finditer(text):
            k = m.lastindex
            value = m.group(k).rstrip(".)]}") if k == 3 else m.group(k)
            if value:
                yield m.start(k), m.start(k) + len(value), guess_cost(value, words)


def find(text: str, least: float = SECRET_COST, words: dict[str, int] | None = None) -> tuple[list, list]:
    """The base spans, and the spans the method adds: values of six characters or more whose cost is at least `least` and that overlap no base span."""
    base = base_spans(text)
    more = [(s, e, "password") for s, e, cost in credential_values(text, words) if e - s >= SHORTEST and cost >= least]
    return base, clear_of(more, base)


def scan(docs: DataFrame, least: float = SECRET_COST, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """For each row: doc_id and spans, an array of (kind, start, end, base) by start.

    Null and empty texts have none. Every text is searched whole; patterns take time in proportion to its length. The ranked words (some 40,000, bounded by the vocabularies, which the driver reads) go to the tasks with the function. Repeated rows stay, an empty table gives none, other columns do not matter.
    """
    words = ranked_words(vocabularies)

    def f(b: pa.RecordBatch) -> dict:
        out = []
        for text in b.column("text").to_pylist():
            base, more = find(text or "", least, words)
            own = set(base)
            out.append([{"kind": k, "start": s, "end": e, "base": (s, e, k) in own} for s, e, k in ordered(base + more, KINDS)])
        return {"doc_id": b.column("doc_id"), "spans": out}

    return per_batch(docs.select("doc_id", "text"), "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>", f)
