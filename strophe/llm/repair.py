"""Repair of conversations: the cheapest edits, by A* over rows and what may follow, that make speakers take turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import redealt, stored

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows that one search goes over; longer conversations are searched piece by piece, from every state to every state.
PIECE = 256
_END = r"[^\x20\x09-\x0D]"

#: What a conversation is in after some turns (nothing said, system, user, assistant), what each may be followed by, and where it may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (NOTHING, ASSISTANT)
#: The speaker that an edit can bring in next.
NEXT = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))

Row = tuple[str, bool, bool]  # the role's initial, must go, truncated
Ways = dict[tuple[int, int], tuple[int, str]]  # (state before, state after) to cost and audit


def search(rows: list[Row], begin: int, end: tuple[int, ...] | None) -> Ways:
    """The cheapest edits of rows that lead from a state to one of the end states, ties to the smaller audit; with no end states, to each that can be reached.

    A* over (rows done, state). What is left costs at least the deletions that must be and one for each other truncated row, which is charged if it stays and deleted for more; these are sums over the rows' ends. Entries are keyed by cost and that bound together, then by the audit. No edit lowers the key, and of two audits that lead to one node at equal cost neither begins the other, so a node's first entry is its best.
    """
    left = [0]
    for _, must, cut in reversed(rows):
        left.append(left[-1] + (DELETE if must else TRUNCATED * cut))
    heap, done, out = [(left[-1], "", 0, begin)], set(), {}
    while heap:
        key, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and (end is None or state in end):
            out[begin, state] = (key, audit)
            if end is not None:
                break
        after = NEXT[state][0]
        heappush(heap, (key + INSERT, audit + "I", i, after))
        if i == len(rows):
            continue
        initial, must, cut = rows[i]
        charge = TRUNCATED * cut
        heappush(heap, (key if must else key + DELETE - charge, audit + "D", i + 1, state))
        if not must:
            heappush(heap, (key + REROLE, audit + "R", i + 1, after))
            if initial in FOLLOWS[state]:
                heappush(heap, (key, audit + "K", i + 1, FOLLOWS[state][initial]))
    return out


def joined(a: Ways, b: Ways) -> Ways:
    """The cheapest ways through two pieces."""
    out: Ways = {}
    for (begin, mid), (cost, audit) in a.items():
        for (then, end), (more, rest) in b.items():
            if mid == then:
                way = (cost + more, audit + rest)
                if (begin, end) not in out or way < out[begin, end]:
                    out[begin, end] = way
    return out


def through(pieces: list[Ways]) -> Ways:
    """The cheapest ways through pieces in order, joined two by two."""
    while len(pieces) > 1:
        pieces = [reduce(joined, pieces[i : i + 2]) for i in range(0, len(pieces), 2)]
    return pieces[0]


class Part:
    """What a task knows of one conversation, or of its stretch of one."""

    def __init__(self, conv):
        self.conv, self.rows, self.ways = conv, [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None  # initials
        self.low = self.high = None  # turns

    def add(self, turn: int | None, initial: str, blank: bool, seen: bool, cut: bool, times: int) -> None:
        """Some equal rows; rows come in order."""
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn
        self.illegal += times - 1 + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        self.first, self.last = (initial if self.first is None else self.first), initial
        kept = not blank and not seen
        self.blank += times * blank
        self.duplicate += (times - kept) * (not blank)
        self.truncated += kept and cut
        row = (initial, not kept, kept and cut)
        for _ in range(times):
            if len(self.rows) == PIECE:
                self.close()
            self.rows.append(row)
            row = (initial, True, False)

    def close(self) -> None:
        self.ways.append(reduce(lambda a, b: a | b, (search(self.rows, s, None) for s in range(4))))
        self.rows = []

    def whole(self) -> list[tuple[int, int, int, str]]:
        """The way through a conversation that lies here as a whole."""
        if not self.ways:
            ways = search(self.rows, NOTHING, ENDS)
        else:
            self.close()
            ways = through(self.ways)
        return [(NOTHING, ASSISTANT, *min(ways[NOTHING, e] for e in ENDS if (NOTHING, e) in ways))]

    def stretch(self) -> list[tuple[int, int, int, str]]:
        """All ways through a conversation that may go on in another task."""
        self.close()
        return [(*k, *v) for k, v in through(self.ways).items()]


_WAY = StructType([StructField(c, t()) for c, t in (("begin", IntegerType), ("end", IntegerType), ("cost", LongType), ("audit", StringType))])
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")
_NAMES = ("conv_id", *_COUNTS, "first", "last", "place", "ways")


def _schema(conv) -> StructType:
    fields = [StructField("conv_id", conv), *(StructField(c, LongType()) for c in _COUNTS), StructField("first", StringType()), StructField("last", StringType()), StructField("place", IntegerType()), StructField("ways", ArrayType(_WAY))]
    return StructType(fields)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def order() -> list[Column]:
    """A conversation's order: turns, nulls first; within a turn roles, then digests of texts."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by crc32(`conv_id:turn`) modulo 20: 0 drops the row, 1 empties its text, 2 takes out `.`, `!` and `?`, 3 repeats it, 4 makes it the user's. Nulls of role and text become one space, and count as one space in the hash."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    d = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), n.alias("n")).where("n <> 0")
    d = d.withColumn("text", F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    d = d.withColumn("role", F.when(F.col("n") == 4, "user").otherwise(F.col("role")))
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("n") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a conversation as one, with their number and faults: conv_id, turn, role, digest, times, blank, cut, seen (whether an earlier turn has the same role and text). Only digests and flags are shuffled, no texts."""
    narrow = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.unhex(F.sha2(F.coalesce("text", F.lit(" ")), 256)).alias("digest"),
        (~F.coalesce("text", F.lit(" ")).rlike(_END)).alias("blank"),
        (~F.coalesce("text", F.lit(" ")).rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
    )
    runs = narrow.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("times"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    runs = stored(runs, "runs")
    again = runs.groupBy("conv_id", "role", "digest").agg(F.count("*").alias("n"), F.min(F.when(F.col("turn").isNull(), F.lit(-(2**63))).otherwise(F.col("turn"))).alias("first"), F.max(F.col("turn").isNull()).alias("null"))
    again = redealt(again.where("n > 1"), "conv_id").select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest", "first", "null")))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    seen = F.when(F.col("_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("_first"))
    return runs.join(again, same, "left").select(*runs.columns, F.coalesce(seen, F.lit(False)).alias("seen"))


def audits(rows: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation in rows (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation), truncated (ends in none of `.!?`). Edits are Keep, Rerole to user or assistant, Delete, and Insert of an empty user's or assistant's turn; blank rows and duplicates must be deleted, truncated rows that stay are charged. The roles' initials must then be nothing, or an optional s and turns of u and a. The audit is the initials of the edits, of equal costs the ASCII-least. illegal counts neighbours whose initials aren't su, ua or au; gaps is what is missing between the least and the largest turn.

    Rows are sorted over all tasks by conversation and turn, so a long conversation lies in several tasks; a task searches its stretch from every state to every state, and the few stretches of a conversation are joined. So no task holds a conversation, only a letter for each of its rows.

    Nulls of role and text count as one space, and a role that is empty or begins with none of s, u, a must be changed or go. Null turns come first and count in no gap; null conv_ids are one conversation. Rows of one turn are in order of role, then of the text's digest. Repeated rows are duplicates. Empty tables give none. Other columns do not matter.
    """
    conv = rows.schema["conv_id"].dataType
    schema = _schema(conv)
    arrow = _arrow(schema)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array(c, t.type) for c, t in zip(zip(*out), arrow)] if out else [pa.array([], t.type) for t in arrow]
        return pa.RecordBatch.from_arrays(cols, schema=arrow)

    def row(p: Part, place: int | None, ways: list) -> tuple:
        return (p.conv, p.blank, p.duplicate, p.truncated, p.illegal, p.turns, p.low, p.high, p.first, p.last, place, [dict(zip(_WAY.names, w)) for w in ways])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, part, first, out = TaskContext.get().partitionId(), None, True, []
        for b in batches:
            for conv_id, *run in zip(*(c.to_pylist() for c in b.columns)):
                if part is not None and part.conv != conv_id:
                    out.append(row(part, place, part.stretch()) if first else row(part, None, part.whole()))
                    part, first = None, False
                if part is None:
                    part = Part(conv_id)
                part.add(*run)
            if len(out) >= 1000:
                yield batch(out)
                out = []
        if part is not None:
            out.append(row(part, place, part.stretch()))
        yield batch(out)

    def join(t: pa.Table) -> pa.Table:
        parts = sorted(t.to_pylist(), key=lambda r: r["place"])
        total = parts[0]
        ways = through([{(w["begin"], w["end"]): (w["cost"], w["audit"]) for w in p["ways"]} for p in parts])
        for a, b in zip(parts, parts[1:]):
            total["illegal"] += b["illegal"] + (a["last"] + b["first"] not in ("su", "ua", "au"))
            for c in ("blank", "duplicate", "truncated", "turns"):
                total[c] += b[c]
            if b["low"] is not None:
                total["turns"] -= total["high"] == b["low"]
                total["low"], total["high"] = (b["low"] if total["low"] is None else total["low"]), b["high"]
        cost, audit = min(ways[NOTHING, e] for e in ENDS if (NOTHING, e) in ways)
        total |= {"place": None, "ways": [{"begin": NOTHING, "end": ASSISTANT, "cost": cost, "audit": audit}]}
        return pa.Table.from_pylist([total], schema=arrow)

    runs = faults(rows).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "seen", "cut", "times", "role", "digest")
    runs = runs.repartitionByRange(F.asc_nulls_first("conv_id"), *order()).sortWithinPartitions(F.asc_nulls_first("conv_id"), *order()).drop("role", "digest")
    solved = stored(runs.mapInArrow(solve, schema), "audits")
    edges = solved.where("place IS NOT NULL").groupBy("conv_id").applyInArrow(join, schema)
    done = solved.where("place IS NULL").unionByName(edges)
    way = F.col("ways")[0]
    return done.select("conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", way["cost"].alias("cost"), way["audit"].alias("audit"))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Conversations after their edits (conv_id, audit, as audits gives them for the rows): conv_id, place (from 1), role, text. Rows are dealt to tasks by conversation and stream through in order; a task holds one audit and a batch. The rows of a task come in order of conversation and place."""
    conv = rows.schema["conv_id"].dataType
    schema = StructType([StructField("conv_id", conv), StructField("place", LongType()), StructField("role", StringType()), StructField("text", StringType())])
    arrow = _arrow(schema)
    texts = rows.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    heads = edits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"))
    dealt = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", *order()).select("conv_id", "kind", "role", "text")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, audit, at, state, place = None, "", 0, NOTHING, 0
        for b in batches:
            out = []

            def say(role: str, text: str, to: int) -> None:
                nonlocal state, place
                state, place = to, place + 1
                out.append((conv_id, place, role, text))

            def inserts() -> None:
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    say(NEXT[state][1], "", NEXT[state][0])
                    at += 1

            for c, kind, role, text in zip(*(x.to_pylist() for x in b.columns)):
                if kind == 0:
                    inserts()  # those that end the conversation before
                    conv_id, audit, at, state, place = c, text, 0, NOTHING, 0
                    continue
                inserts()
                done, at = audit[at], at + 1
                if done == "K":
                    say(role, text, FOLLOWS[state][role[0]])
                elif done == "R":
                    say(NEXT[state][1], text, NEXT[state][0])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), arrow)], schema=arrow)
        out = []
        while at < len(audit):  # the last conversation's end
            state, place, at = NEXT[state][0], place + 1, at + 1
            out.append((conv_id, place, "user" if state == USER else "assistant", ""))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), arrow)], schema=arrow)

    return dealt.mapInArrow(edit, schema)


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's `role:text` joined by newlines, in lower-case hex, for turns as repaired gives them: conv_id, repaired_sha256. They are read as they lie, so nothing is shuffled."""
    schema = StructType([StructField("conv_id", turns.schema["conv_id"].dataType), StructField("repaired_sha256", StringType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, digest = None, None
        for b in batches:
            out = []
            for c, place, role, text in zip(*(x.to_pylist() for x in b.columns)):
                if place == 1:
                    if digest is not None:
                        out.append((conv_id, digest.hexdigest()))
                    conv_id, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), arrow)], schema=arrow)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], arrow[0].type), pa.array([digest.hexdigest()])], schema=arrow)

    return turns.mapInArrow(run, schema)


def report(conversations: DataFrame) -> DataFrame:
    """Every conversation (conv_id, turn, role, text), damaged and repaired: what audits gives, and repaired_sha256. Where no row is left after the damage, counts are zero, the audit is empty and the digest is that of nothing."""
    rows = damaged(conversations)
    edits = stored(audits(rows), "edits")
    texts = digests(repaired(rows, edits))
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    out = ids.join(edits, F.col("_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    out = out.join(texts, F.col("_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
