"""Personal data: four patterns, and a character BiLSTM with CRF transitions for what they miss."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch
from .spans import clear_of, ordered

KINDS = ("email", "ip", "card", "phone")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """What the four patterns find, leftmost and not overlapping within a kind; matches that fail their check are dropped without another try. An e-mail address is found from its @: its local part is the run of such characters before it, back to the last match; a dotted number is tried from the start of a run of digits only, as a later start in the same run fails or succeeds alike. So time is in proportion to the length."""
    out = []
    at = end = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and _LOCAL_END.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            out.append((start, end, "email"))
            at = end
        else:
            at += 1
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return ordered(out, KINDS)


# The model -------------------------------------------------------------------------------------

TAGS = ("", *KINDS)
HIDDEN = 8
#: Positions of a window, and how many of them it shares with the next one.
WINDOW, SHARED = 160, 32
#: Windows that go through the network together.
TOGETHER = 1024
#: Bytes of texts whose emissions are held at once, unless one text alone has more.
HELD = 1 << 22
#: Classes of characters: the printable ASCII ones, and one each for other letters, white space and the rest.
_N = 98
_TABLE = np.full(128, 97, np.uint8)
_TABLE[32:127] = np.arange(95)
_TABLE[[9, 10, 11, 12, 13]] = 96


def classes(text: str) -> np.ndarray:
    """The class of every code point; letters beyond ASCII are one class, and so is all beyond U+024F."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[np.minimum(points, 127)]
    out[points > 127] = 95
    return out


class Net:
    """A bidirectional LSTM over character classes with a linear-chain CRF on top. w holds: for each direction the input table x (classes by gates), the recurrent u and the bias b; the emissions' e and c; the transitions t."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 5):
        r = np.random.default_rng(seed)
        g = lambda *s, k: (r.normal(size=s) * k).astype(np.float32)
        self.hidden = hidden
        self.w = {}
        for d in "fb":
            self.w |= {f"x{d}": g(_N, 4 * hidden, k=0.5), f"u{d}": g(hidden, 4 * hidden, k=0.3), f"b{d}": np.repeat(np.float32([0, 1, 0, 0]), hidden)}
        n = len(TAGS)
        self.w |= {"e": g(2 * hidden, n, k=0.3), "c": np.zeros(n, np.float32), "t": np.where(np.eye(n) > 0, 1, -1).astype(np.float32)}

    # Gates stand as input, forget, output, candidate. A sigmoid is 0.5 + 0.5 tanh(x / 2).
    def _direction(self, ids: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """ids (steps, batch): the outputs (steps, batch, hidden) in the order of steps."""
        n, w = self.hidden, self.w
        half = np.repeat(np.float32([0.5, 0.5, 0.5, 1]), n)
        x, u = (w["x" + d] + w["b" + d]) * half, w["u" + d] * half
        steps, batch = ids.shape
        h, c, s = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32), np.empty((batch, n), np.float32)
        a, b = np.empty((batch, 4 * n), np.float32), np.empty((batch, 4 * n), np.float32)
        out = np.empty((steps, batch, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            if keep is not None:
                a, was, before = np.empty_like(a), c.copy(), h
            np.take(x, ids[t], axis=0, out=a, mode="clip")
            np.matmul(h, u, out=b)
            a += b
            np.tanh(a, out=a)
            gates = a[:, : 3 * n]
            gates *= 0.5
            gates += 0.5
            c *= a[:, n : 2 * n]
            np.multiply(a[:, :n], a[:, 3 * n :], out=s)
            c += s
            np.tanh(c, out=s)
            h = out[t]
            np.multiply(a[:, 2 * n : 3 * n], s, out=h)
            if keep is not None:
                keep.append((t, a, was, s.copy(), before))
        return out

    def _outputs(self, ids: np.ndarray, d: str) -> np.ndarray:
        """The same as (steps, hidden, batch), without what training keeps. Batches stand last, so that gates are whole rows; every gate is 1 / (1 + exp(-x)), a tanh twice that of 2 x less 1."""
        n, w = self.hidden, self.w
        scale = np.repeat(np.float32([-1, -1, -1, -2]), n)
        x = np.ascontiguousarray(((w["x" + d] + w["b" + d]) * scale).T)
        u = np.ascontiguousarray((w["u" + d] * scale).T)
        steps, batch = ids.shape
        a, b = np.empty((4 * n, batch), np.float32), np.empty((4 * n, batch), np.float32)
        h, c, s = np.zeros((n, batch), np.float32), np.zeros((n, batch), np.float32), np.empty((n, batch), np.float32)
        i, f, o, g = (a[k * n : k * n + n] for k in range(4))
        out = np.empty((steps, n, batch), np.float32)
        with np.errstate(over="ignore"):  # exp may be infinite, then the gate is 0
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.take(x, ids[t], axis=1, out=a, mode="clip")
                np.matmul(u, h, out=b)
                a += b
                np.exp(a, out=a)
                a += 1
                np.reciprocal(a, out=a)
                g *= 2
                g -= 1
                c *= f
                i *= g
                c += i
                np.multiply(c, np.float32(-2), out=s)
                np.exp(s, out=s)
                s += 1
                np.divide(2, s, out=s)
                s -= 1
                h = out[t]
                np.multiply(o, s, out=h)
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """ids (steps, batch): (steps, batch, tags)."""
        n, w = self.hidden, self.w
        e = np.ascontiguousarray(w["e"].T)
        out = np.matmul(e[:, :n], self._outputs(ids, "f"))
        out += np.matmul(e[:, n:], self._outputs(ids, "b"))
        out += w["c"][:, None]
        return out.transpose(0, 2, 1)

    def best_paths(self, e: np.ndarray, length: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """The best tags (steps, stretches) for emissions (steps, stretches, tags) of stretches of the given lengths, padded at their ends. inner (two columns): whether "nothing" stands before and after a stretch, as within a text."""
        t, n = self.w["t"], len(TAGS)
        steps = e.shape[0]
        e = np.ascontiguousarray(e.transpose(2, 0, 1))  # by tag
        score = e[:, 0] + np.where(inner[:, 0], t[0][:, None], 0)
        back = np.zeros((steps, n, len(length)), np.uint8)
        last = score + np.where(inner[:, 1], t[:, :1], 0)
        best = np.where(length == 1, last.argmax(0), 0)
        for k in range(1, steps):
            new = np.empty_like(score)
            for j in range(n):
                x = score + t[:, j : j + 1]
                back[k, j] = x.argmax(0)
                new[j] = x.max(0) + e[j, k]
            score = new
            if (ends := length == k + 1).any():
                best[ends] = (score + np.where(inner[:, 1], t[:, :1], 0)).argmax(0)[ends]
        tags, rows = np.zeros((steps, len(length)), np.uint8), np.arange(len(length))
        for k in range(steps - 1, -1, -1):
            here = k < length
            tags[k, here] = best[here]
            best = np.where(here, back[k, best, rows], best)
        return tags

    def decode(self, e: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of whole texts by their emissions (positions, tags): one best path for each, from its first character to its last.

        Where no stretch of other tags can beat "nothing", "nothing" is on a best path without a search: a stretch gains at most, at each step, the largest transition among other tags over that of nothing, less the lead of nothing's emission; and once, what entering and leaving it gains, or one of both for a stretch at an edge of the text, or neither if it is all of it. Positions that no stretch through them lifts above zero, neither the one with the largest such sum nor one from or to an edge, are nothing; the rest is searched stretch by stretch, between the nothings beside it, and that is exact.
        """
        t = self.w["t"].astype(np.float64)
        inside, stay, enter, leave = t[1:, 1:].max(), t[0, 0], t[0, 1:].max(), t[1:, 0].max()
        tags, found = [np.zeros(len(x), np.uint8) for x in e], []
        for k, x in enumerate(e):
            if len(x):
                gain = reduce(np.maximum, x.T[1:]).astype(np.float64) - x[:, 0] + (inside - stay)
                upto = np.concatenate(([0.0], np.cumsum(gain)))
                left = upto[1:] - np.minimum.accumulate(upto)[:-1]  # the largest sum that ends at a position
                after = np.maximum.accumulate(upto[:0:-1])[::-1]  # and the largest up to it or later
                some = left + (after - upto[:-1]) - gain + (enter + leave - stay - inside) > -1e-6
                some |= after + (leave - inside) > -1e-6
                some |= left + (upto[-1] - upto[1:]) + (enter - inside) > -1e-6
                if upto[-1] + (stay - inside) > -1e-6:
                    some[:] = True
                if some.any():
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], some, [0]))))
                    found += [(k, a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        found.sort(key=lambda s: s[2] - s[1])
        while found:
            longest = found[-1][2] - found[-1][1]
            part = [s for s in found[-TOGETHER:] if 2 * (s[2] - s[1]) >= longest]  # of like length, so that padding costs little
            part = part[-max(1, (1 << 22) // longest) :]
            del found[len(found) - len(part) :]
            padded = np.zeros((longest, len(part), len(TAGS)), np.float32)
            for n, (k, a, b) in enumerate(part):
                padded[: b - a, n] = e[k][a:b]
            best = self.best_paths(padded, np.array([b - a for _, a, b in part]), np.array([(a > 0, b < len(e[k])) for k, a, b in part]))
            for n, (k, a, b) in enumerate(part):
                tags[k][a:b] = best[: b - a, n]
        return tags

    # Training
    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """The mean negative log-likelihood a window, and its gradients."""
        w, n = self.w, self.hidden
        steps, batch = ids.shape
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._direction(ids, d, kept[d]) for d in "fb"], 2)
        e = (h @ w["e"] + w["c"]).astype(np.float64)
        t = w["t"].astype(np.float64)
        top = lambda a, k: (m := a.max(k, keepdims=True)).squeeze(k) + np.log(np.exp(a - m).sum(k))
        al, be = [e[0]], [np.zeros_like(e[0])]
        for k in range(1, steps):
            al.append(top(al[-1][:, :, None] + t, 1) + e[k])
        for k in range(steps - 2, -1, -1):
            be.append(top(t + (be[-1] + e[k + 1])[:, None, :], 2))
        al, be = np.array(al), np.array(be[::-1])
        z = top(al[-1], 1)
        rows = np.arange(batch)
        p = np.exp(al + be - z[None, :, None])
        loss = z - e[np.arange(steps)[:, None], rows, gold].sum(0) - t[gold[:-1], gold[1:]].sum(0)
        pair = np.exp(al[:-1, :, :, None] + t + (e[1:] + be[1:])[:, :, None, :] - z[None, :, None, None])
        gt = pair.sum((0, 1))
        np.add.at(gt, (gold[:-1].ravel(), gold[1:].ravel()), -1)
        p[np.arange(steps)[:, None], rows, gold] -= 1
        p = (p / batch).astype(np.float32)
        out = {"t": gt / batch, "e": np.einsum("tbh,tbk->hk", h, p), "c": p.sum((0, 1))}
        dh_all = p @ w["e"].T
        for side, d in enumerate("fb"):
            gx, gu, gb = np.zeros_like(w["x" + d]), np.zeros_like(w["u" + d]), np.zeros(4 * n, np.float32)
            dh = dc = np.zeros((batch, n), np.float32)
            for s, a, was, tc, before in reversed(kept[d]):
                dh = dh + dh_all[s, :, side * n : side * n + n]
                i, f, o, g = (a[:, k * n : k * n + n] for k in range(4))
                dc = dc + dh * o * (1 - tc * tc)
                da = np.concatenate((dc * g * i * (1 - i), dc * was * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), 1)
                np.add.at(gx, ids[s], da)
                gu += before.T @ da
                gb += da.sum(0)
                dh, dc = da @ w["u" + d].T, dc * f
            out |= {"x" + d: gx, "u" + d: gu, "b" + d: gb}
        return float(loss.mean()), out

    def fit(self, ids: np.ndarray, gold: np.ndarray, rounds: int, batch: int = 128, rate: float = 0.02, seed: int = 6) -> None:
        """Adam over windows (steps, examples)."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        for n in range(1, rounds + 1):
            some = r.integers(0, ids.shape[1], batch)
            _, g = self.gradients(ids[:, some], gold[:, some])
            size = float(np.sqrt(sum((x * x).sum() for x in g.values())))
            lr = rate * min(1, 2 * (1 - n / (rounds + 1)))
            for k in self.w:
                x = (g[k] * min(1, 5 / (size + 1e-9))).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * x
                s[k] = 0.99 * s[k] + 0.01 * x * x
                self.w[k] = self.w[k] - np.float32(lr) * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.99**n)) + 1e-7)


def labelled_windows(n: int, steps: int, seed: int) -> tuple[list[str], np.ndarray]:
    """n made-up windows of text and their tags: running text of random words in a few alphabets, with personal data in usual and unusual spellings, and with numbers and signs that are none (prices, dates, versions, hex digests, long numbers)."""
    r = np.random.default_rng(seed)
    pick = lambda s: s[r.integers(len(s))]
    num = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    word = lambda: "".join(pick(letters) for _ in range(1 + r.integers(9)))

    def card() -> str:
        d = str(r.integers(3, 7)) + num(r.integers(12, 15))
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        return d if r.random() < 0.5 else pick(" -.").join(d[k : k + 4] for k in range(0, len(d), 4))

    def email() -> str:
        name, host = pick(["{a}.{n}", "{a}", "{a}_{b}", "{a}{n}"]).format(a=word(), b=word(), n=num(2)), pick(["example", "mail" + num(1), word()])
        if r.random() < 0.5:
            return f"{name}@{host}.{pick(['com', 'org', 'example.com', 'co.uk', 'de'])}"
        return f"{name}{pick([' [at] ', ' (at) ', '(at)', ' at ', '[at]'])}{host}{pick([' [dot] ', ' (dot) ', ' dot ', '[dot]', '.'])}{pick(['com', 'org', 'net', 'de'])}"

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick(["+1 ({a}) {b}-{c}", "({a}) {b}-{c}", "+{d} {a} {b} {c}", "{a}-{b}-{c}", "+1-{a}-{b}-{c}", "00{d} {a} {b}{c}", "1 ({a}) {b}-{c}", "{a}.{b}.{c}"]).format(a=a, b=b, c=c, d=r.integers(20, 99))

    def ip() -> str:
        parts = [str(x) for x in r.integers(0, 256, 4)]
        return ".".join(parts) if r.random() < 0.7 else pick(["[.]", " . "]).join(parts)

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    others = [
        lambda: f"{num(2)}.{num(2)}", lambda: f"{r.integers(1900, 2030)}-{num(2)}-{num(2)}", lambda: "v" + ".".join(num(1) for _ in range(3)), lambda: f"${num(3)},{num(3)}", lambda: num(r.integers(1, 9)),
        lambda: "".join(pick("0123456789abcdef") for _ in range(40)), lambda: f'token = "{"".join(pick("0123456789abcdef") for _ in range(40))}"', lambda: f"{word()}: {num(4)} | {num(5)} |", lambda: f"@{word()}", lambda: f"{word()}/{num(4)}.{word()}",
        lambda: f"({num(4)}) {word()}", lambda: f"{num(r.integers(1, 3))} at {word()} dot", lambda: f"({num(3)})", lambda: f"{num(3)}-{num(2)}", lambda: num(r.integers(20, 40)), lambda: pick(["at", "dot", "example", "com", "mail", "an at", "at the", "dot the"]), lambda: "| " + word(), lambda: word().upper() + "!!", lambda: f"ISBN {num(3)}-{num(1)}-{num(3)}",
    ]
    texts, tags = [], np.zeros((steps, n), np.uint8)
    for k in range(n):
        letters = pick(["etaoinshrdlcumwfgypbvkxjqz", "etaoinshrdéèçêàùlucmxxvqj", "enisratdhulcgmobwfkzäöüßxjq", "eaosrnidlctumpbgvñíóáxjqzy"])
        noise = pick(["", "", "", "", "%%%", "###", "!!", "***"])
        text, upper = " " * int(r.integers(0, 3)), r.random() < 0.1
        while len(text) < steps:
            x = r.random()
            if x < 0.1:
                kind = pick(KINDS)
                s = makers[kind]()
                tags[len(text) : len(text) + len(s), k] = TAGS.index(kind)
            else:
                s = pick(others)() if x < 0.2 else word()
                s = s.capitalize() if r.random() < 0.1 else s
            text += (s.upper() if upper else s) + noise + pick([" ", " ", " ", " ", ". ", ", ", "\n"])
        texts.append(text[:steps])
    return texts, tags


@lru_cache(2)
def trained(hidden: int = HIDDEN, rounds: int = 450, examples: int = 4000, steps: int = 64, seed: int = 5) -> Net:
    """The model, trained on `examples` labelled windows (the bound of its sample). It depends on nothing but the parameters, so it is the same in every run and for every table."""
    net = Net(hidden, seed)
    texts, gold = labelled_windows(examples, steps, seed)
    net.fit(np.stack([classes(x) for x in texts], 1), gold.astype(np.int64), rounds)
    return net


def text_emissions(net: Net, texts: list[str]) -> list[np.ndarray]:
    """The emissions (positions, tags) of every text. Each text is cut into windows that overlap; where two do, theirs are averaged, the more by the window in which a position is farther from the edge."""
    stride = WINDOW - SHARED
    cut = [classes(t) for t in texts]
    counts = [max(1, -(-(len(c) - SHARED) // stride)) if len(c) else 0 for c in cut]
    ids = np.full((sum(counts), WINDOW), 96, np.uint8)
    follows = np.zeros(len(ids), bool)  # whether a window goes on with the text of the one before
    row = 0
    for c, n in zip(cut, counts):
        follows[row + 1 : row + n] = True
        for k in range(n):
            part = c[k * stride : k * stride + WINDOW]
            ids[row, : len(part)] = part
            row += 1
    e = np.empty((len(ids), WINDOW, len(TAGS)), np.float32)
    for at in range(0, len(ids), TOGETHER):
        e[at : at + TOGETHER] = net.emissions(np.ascontiguousarray(ids[at : at + TOGETHER].T)).transpose(1, 0, 2)
    later = np.flatnonzero(follows)
    share = ((np.arange(SHARED, dtype=np.float32) + 0.5) / SHARED)[:, None]
    e[later, :SHARED] = share * e[later, :SHARED] + (1 - share) * e[later - 1, stride:]
    out, row = [], 0
    for c, n in zip(cut, counts):
        whole = e[row : row + n, :stride].reshape(-1, len(TAGS))
        out.append((np.concatenate((whole, e[row + n - 1, stride:])) if n else whole)[: len(c)])
        row += n
    return out


def tag_texts(net: Net, texts: list[str]) -> list[np.ndarray]:
    """The tag of every character of every text: the best path over the whole text."""
    return net.decode(text_emissions(net, texts))


def plausible(kind: str, s: str) -> bool:
    """The check that a span the model adds must pass."""
    d = _digits(s)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]{1,64}\s{0,2}(?:@|[\[({]\s?at\s?[\])}]|\sat\s)\s{0,2}[A-Za-z0-9-]+(?:\s{0,2}(?:\.|[\[({]\s?dot\s?[\])}]|\sdot\s)\s{0,2}[A-Za-z0-9-]+)*\s{0,2}(?:\.|[\[({]\s?dot\s?[\])}]|\sdot\s)\s{0,2}[A-Za-z]{2,10}", s, re.I)) and bool(re.search(r"@|[\[({]|\bdot\b", s, re.I))
    if kind == "ip":
        parts = re.split(r"\s?\[?\.\]?\s?", s)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and d[0] in "3456" and luhn(d) and bool(re.fullmatch(r"[0-9]+(?:[\x20.-][0-9]+)*", s))
    return 10 <= len(d) <= 15 and bool(re.fullmatch(r"(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{3,4}", s)) and bool(re.search(r"[\x20().-]", s))


def added_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs of one tag, trimmed, that pass the check and overlap no base span."""
    if not tags.any():
        return []
    edges = np.flatnonzero(np.diff(tags)) + 1
    out = []
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(tags)]):
        if tags[a]:
            s, kind = text[a:b], TAGS[tags[a]]
            a += len(s) - len(s.lstrip(" .,;:\n\t"))
            s = s.strip(" .,;:\n\t!%#*&$")
            if s and plausible(kind, s):
                out.append((a, a + len(s), kind))
    return clear_of(out, base)


def scan(docs: DataFrame) -> DataFrame:
    """For each row: doc_id and spans, an array of (kind, start, end, base) by start.

    Null and empty texts have none. Every text goes through the network in overlapping windows and is decoded as a whole; patterns take time in proportion to its length. The weights (some 30 kB, whatever the tables hold) go to the tasks with the function. Repeated rows stay, an empty table gives none, other columns do not matter.
    """
    net = trained()

    def f(b: pa.RecordBatch) -> dict:
        texts = [x or "" for x in b.column("text").to_pylist()]
        out = []
        for text, tags in zip(texts, tag_texts(net, texts)):
            base = base_spans(text)
            own = set(base)
            spans = ordered(base + added_spans(text, tags, base), KINDS)
            out.append([{"kind": k, "start": s, "end": e, "base": (s, e, k) in own} for s, e, k in spans])
        return {"doc_id": b.column("doc_id"), "spans": out}

    return per_batch(docs.select("doc_id", "text"), "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>", f, HELD)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of personal data in text replaced by its kind in angle brackets, and n_chars, if there, by the new length. Overlapping spans are replaced as one, named after the first. Texts without any stay as they are, nulls too; all columns, whatever their names, and rows stay, repeated ones too; an empty table gives none."""
    net = trained()
    have = "n_chars" in docs.columns
    fields = [f for f in docs.schema if f.name not in ("text", "n_chars")]

    def f(b: pa.RecordBatch) -> dict:
        texts = b.column("text").to_pylist()
        out = []
        for text, tags in zip(texts, tag_texts(net, [x or "" for x in texts])):
            if text:
                base = base_spans(text)
                text = _replaced(text, ordered(base + added_spans(text, tags, base), KINDS))
            out.append(text)
        cols = {x.name: b.column(x.name) for x in fields} | {"text": out}
        if have:
            lengths = b.column("n_chars").to_pylist()
            old = b.column("text").to_pylist()
            cols["n_chars"] = [n if a == t else len(t) for n, a, t in zip(lengths, old, out)]
        return cols

    return per_batch(docs, docs.schema, f, HELD)


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at, last = [], 0, -1
    for start, end, kind in spans:
        if start >= at or last < 0:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = last = max(at, end)
    return "".join(parts) + text[at:]
