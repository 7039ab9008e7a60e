"""Repair of conversation structure by iterative-deepening A*.

A conversation's rows are edited (Keep, Rerole, Delete, Insert) until the role
initials read ``(s?(ua)+)?``. The search runs depth first over (row, last role),
trying edits in the order of their initials D, I, K, R, within a cost bound that
grows to the least total seen beyond it. A table keeps, for every state, the
largest budget that failed there, over all bounds. The first accepting path
within the first bound that has one is the cheapest, and of the cheapest the
first in ASCII order. The estimate of the rest is what truncated, blank and
repeated rows and rows of other roles cost at least, plus neighbours of equal
role, which cannot both stay as they are.

At scale: rows are brought into order by a range partitioning, so a conversation
of any length is spread, and cut into segments of at most ``SEGMENT`` rows. A
segment is searched by itself, from every last role it may begin with to every
one it may end with; inserts stand before the row they precede, so of two ways
through a segment none begins with the other and ties are decided segment by
segment. Two streams over the segments join them: from the end backward, what
the rest costs, then forward, the way taken. Only the hash of the repaired text
has to read a conversation from one end to the other; it does so row by row in
a sorted stream. Equal rows are counted once, before anything is shuffled by
text.

Defined cases: a null conv_id is a conversation; null turns come first; in a
null role or text, and in the key of the damage, null reads as one space; rows
equal in turn are ordered by role, then text (both as damaged); an empty table
gives an empty result; other columns are ignored. Texts are kept whole.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import partitions_for
from .common import staged

SEGMENT = 256               # distinct rows searched together, at most
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3           # costs; CUT: a truncated row that stays

# Last role so far: none, system, user, assistant. The one that may follow by Rerole or Insert:
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
GOOD = (START, ASSISTANT)
NEVER = 1 << 60


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) after the damage that crc32 of conv_id:turn decides; repeats are two rows."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text")))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
                       text.alias("text"), (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("times"))


def ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text, times) with ``pos``, increasing along every conversation, and segment."""
    held = staged(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times")), "repair-rows")
    parts = max(partitions_for(held, 64 << 20), int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    placed = held.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return (staged(placed.withColumn("pos", F.monotonically_increasing_id()), "repair-ordered")
            .withColumn("segment", F.floor(F.col("pos") / SEGMENT)))


def faults(rows: DataFrame) -> DataFrame:
    """The ordered rows without their texts: conv_id, turn, pos, segment, initial, times and the fault of the
    first of the equal rows; the others are blank if it is, else duplicates."""
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise(""))
    digest = F.sha2(F.concat("role", F.lit("\0"), "text").cast("binary"), 256)
    small = staged(rows.select("conv_id", "turn", "pos", "segment", F.substring("role", 1, 1).alias("initial"), "times",
                               fault.alias("fault"), digest.alias("digest")), "repair-faults")
    first = (small.where("fault <> 'blank'").groupBy("conv_id", "digest")
             .agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
             .select(F.col("conv_id").alias("_c"), F.col("digest").alias("_d"), "_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d"))
    return (small.join(first, same, "left")
            .withColumn("fault", F.when(F.col("pos") > F.col("_first"), "duplicate").otherwise(F.col("fault")))
            .drop("_c", "_d", "_first", "digest"))


def figures(rows: DataFrame) -> DataFrame:
    """Per conversation with rows: first and last segment, gaps, and how many rows have each fault first."""
    def sum_of(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    n, fault = F.col("times"), F.col("fault")
    gaps = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    return rows.groupBy("conv_id").agg(
        F.min("segment").alias("first_segment"), F.max("segment").alias("last_segment"),
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        sum_of(F.when(fault == "blank", n)).alias("blank"),
        sum_of(F.when(fault == "duplicate", n).when(fault != "blank", n - 1)).alias("duplicate"),
        sum_of(F.when(fault == "truncated", 1)).alias("truncated"))


def items_of(initials, fault, times) -> list[tuple]:
    """What the search sees: (initial, truncated, 1) or, for rows that must go, (None, False, how many)."""
    out = []
    for initial, f, n in zip(initials, fault, times, strict=True):
        if f in ("blank", "duplicate"):
            out.append((None, False, n))
            continue
        out.append((initial, f == "truncated", 1))
        if n > 1:
            out.append((None, False, n - 1))
    return out


class Search:
    """IDA* over one segment. ``ends``: the segment ends the conversation."""

    def __init__(self, items: list[tuple], ends: bool):
        self.items, self.ends, n = items, ends, len(items)
        self.role = [{"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(i[0]) for i in items]
        least, pairs, follower = [0] * (n + 1), [0] * (n + 3), None
        for i in range(n - 1, -1, -1):
            initial, cut, times = items[i]
            least[i], pairs[i] = least[i + 1], pairs[i + 1]
            if initial is None:
                least[i] += DELETE * times
                continue
            role = self.role[i]
            least[i] += min(DELETE, REROLE + cut * CUT) if role is None else cut * CUT
            if role in (USER, ASSISTANT):
                if follower is not None and self.role[follower] == role:
                    spare = DELETE - CUT if cut or items[follower][1] else min(REROLE, INSERT)
                    pairs[i] = max(pairs[i], spare + pairs[follower + 1])
                follower = i
            else:
                follower = None
        self.rest = [a + b for a, b in zip(least, pairs, strict=False)]

    def run(self, start: int, goals: tuple, failed: dict) -> tuple[int, str] | None:
        """(cost, initials of the edits) of the answer from ``start``, or None if there is none.
        ``failed`` holds for all starts of the same goals."""
        bound = self.rest[0]
        while bound < NEVER:
            found, bound = self.deepen(start, goals, bound, failed)
            if found is not None:
                return found
        return None

    def moves(self, i: int, last: int):
        """(initial, cost, next row, next last role, letters) in ASCII order; inserts never end a segment but the last."""
        following = FOLLOWS[last]
        if i == len(self.items):
            return [("I", INSERT, i, following)] if self.ends else []
        initial, cut, times = self.items[i]
        if initial is None:
            return [("D", DELETE * times, i + 1, last), ("I", INSERT, i, following)]
        out, role = [("D", DELETE, i + 1, last), ("I", INSERT, i, following)], self.role[i]
        if role == following or (role == SYSTEM and last == START):
            out.append(("K", KEEP + cut * CUT, i + 1, role))
        out.append(("R", REROLE + cut * CUT, i + 1, following))
        return out

    def deepen(self, start: int, goals: tuple, bound: int, failed: dict):
        """One depth-first search within ``bound``: the answer, or the next bound."""
        beyond, path, n = NEVER, [], len(self.items)
        stack = [(0, start, 0, None)]                     # row, last role, cost, moves left
        while stack:
            i, last, cost, moves = stack.pop()
            if moves is None:
                # Most that is known of the rest: the estimate, or one more than the budget that failed.
                total = cost + max(self.rest[i], failed.get((i, last), -1) + 1)
                if total > bound:
                    beyond = min(beyond, total)
                    if path:
                        path.pop()
                    continue
                if i == n and last in goals:
                    return (cost, "".join(path)), bound
                moves = iter(self.moves(i, last))
            step = next(moves, None)
            if step is None:
                failed[i, last] = max(failed.get((i, last), -1), bound - cost)
                if path:
                    path.pop()
                continue
            stack.append((i, last, cost, moves))
            letter, price, j, after = step
            path.append(letter * (self.items[i][2] if letter == "D" else 1))
            stack.append((j, after, cost + price, None))
        return None, beyond


def reach(search: Search, start: int, end: int) -> bool:
    """Whether a segment that does not end the conversation leads from one last role to another."""
    if end == START:
        return start == START
    if end == SYSTEM:
        return start == SYSTEM or (start == START and SYSTEM in search.role)
    return True


WAYS = "conv_id {id}, segment long, start int, end int, cost long, audit string"
DONE = ("conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string")


def rows_of(batches, *names):
    """The rows of a stream of batches as tuples of plain values."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def search_segments(schema: pa.Schema):
    """Task function over rows sorted by conversation, segment and pos: all ways through every segment.
    ``end`` of the last segment of a conversation is assistant, whatever accepting state it ends in."""
    def run(batches):
        out = []
        stream = rows_of(batches, "conv_id", "segment", "begins", "ends", "initial", "fault", "times")
        for (conv, segment, begins, ends), group in groupby(stream, key=lambda r: r[:4]):
            group = list(group)
            search = Search(items_of(*([r[c] for r in group] for c in (4, 5, 6))), ends)
            for end, goals in [(ASSISTANT, GOOD)] if ends else [(e, (e,)) for e in range(4)]:
                failed: dict = {}
                for start in [START] if begins else range(4):
                    if ends or reach(search, start, end):
                        found = search.run(start, goals, failed)
                        if found is not None:
                            out.append((conv, segment, start, end, *found))
            if len(out) > 1000:
                yield table_of(out, schema)
                out = []
        yield table_of(out, schema)
    return run


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def backward(schema: pa.Schema):
    """Task function over ways sorted by conversation, last segment first: of every start the way that is
    cheapest to the end of the conversation, ties ASCII-least."""
    def run(batches):
        stream = rows_of(batches, "conv_id", "segment", "start", "end", "cost", "audit")
        out, conv, rest = [], object(), None
        for (c, segment), group in groupby(stream, key=lambda r: r[:2]):
            if c != conv:
                conv, rest = c, {e: 0 for e in range(4)}
            best: dict = {}
            for _, _, start, end, cost, audit in group:
                if end in rest:
                    best[start] = min(best.get(start, (NEVER, "", 0)), (cost + rest[end], audit, end))
            out += [(c, segment, start, end, cost, audit) for start, (cost, audit, end) in best.items()]
            rest = {start: way[0] for start, way in best.items()}
            if len(out) > 1000:
                yield table_of(out, schema)
                out = []
        yield table_of(out, schema)
    return run


class Repaired:
    """The edits of a conversation applied row by row; only the hash and the last role are kept."""

    def __init__(self):
        self.state, self.sha, self.lines, self.letters = START, hashlib.sha256(), 0, iter("")
        self.initial, self.illegal = None, 0

    def put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def insert(self) -> str | None:
        """Write the inserts that come next and return the edit after them, if any."""
        for letter in self.letters:
            if letter != "I":
                return letter
            self.state = FOLLOWS[self.state]
            self.put(ROLE[self.state], "")

    def row(self, role: str, text: str, times: int) -> None:
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.illegal, self.initial = self.illegal + times - 1, initial
        for _ in range(times):
            letter = self.insert()
            if letter == "K":
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial]
                self.put(role, text)
            elif letter == "R":
                self.state = FOLLOWS[self.state]
                self.put(ROLE[self.state], text)


def forward(schema: pa.Schema):
    """Task function over rows sorted by conversation, segment, kind and pos: the conversation's figures, then
    per segment its ways and its rows. Yields one row per conversation."""
    def run(batches):
        out = []
        stream = rows_of(batches, "conv_id", "segment", "kind", "start", "cost", "audit", "role", "text", "times", "counts")
        for conv, group in groupby(stream, key=lambda r: r[0]):
            done, audits, cost, chosen, counts = Repaired(), [], 0, None, [0] * 4
            for _, segment, kind, start, price, audit, role, text, times, figure in group:
                if kind == 0:
                    counts = figure
                elif kind == 1 and segment != chosen and start == done.state:
                    cost, chosen = price if not audits else cost, segment     # the first holds the whole cost
                    audits.append(audit)
                    done.letters = iter(audit)
                elif kind == 2:
                    done.row(role, text, times)
            done.insert()
            out.append((conv, *counts, done.illegal, cost, "".join(audits), done.sha.hexdigest()))
            if len(out) > 1000:
                yield table_of(out, schema)
                out = []
        yield table_of(out, schema)
    return run


def repaired(conversations: DataFrame) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, of ``conversations``
    (conv_id, turn, role, text) after the damage."""
    rows = damaged(conversations)
    return repair(rows.where(~F.col("dropped")).drop("dropped"), conversations.select("conv_id").distinct())


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """As ``repaired``, of rows (conv_id, turn, role, text, times) as they are, for all of ``conversations``."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["conv_id"]
    ways, done = WAYS.format(id=kind), DONE.format(id=kind)
    ways_schema, done_schema = (spark.createDataFrame([], x).toArrow().schema for x in (ways, done))
    rows = ordered(rows)
    small = staged(faults(rows), "repair-small")
    counts = staged(figures(small), "repair-figures")
    bounds = counts.select(F.col("conv_id").alias("_c"), "first_segment", "last_segment")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = (small.join(bounds, F.col("conv_id").eqNullSafe(F.col("_c")))
             .select("conv_id", "segment", "pos", (F.col("segment") == F.col("first_segment")).alias("begins"),
                     (F.col("segment") == F.col("last_segment")).alias("ends"), "initial", "fault", "times")
             .repartition(parts, "conv_id", "segment").sortWithinPartitions("conv_id", "segment", "pos")
             .mapInArrow(search_segments(ways_schema), ways))
    best = (found.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.desc("segment"), "start", "end")
            .mapInArrow(backward(ways_schema), ways))

    blank = {"segment": "long", "start": "int", "cost": "long", "audit": "string", "role": "string", "text": "string",
             "times": "long", "pos": "long", "counts": "array<bigint>"}

    def stream(df: DataFrame, number: int, **have: Column) -> DataFrame:
        return df.select("conv_id", F.lit(number).alias("kind"),
                         *[have.get(c, F.lit(None)).cast(t).alias(c) for c, t in blank.items()])

    marks = (conversations.join(counts.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left")
             .withColumn("counts", F.array(*[F.coalesce(F.col(c), F.lit(0)).cast("long")
                                             for c in ("gaps", "blank", "duplicate", "truncated")])))
    whole = (stream(marks, 0, segment=F.lit(-1), counts=F.col("counts"))
             .unionByName(stream(best, 1, **{c: F.col(c) for c in ("segment", "start", "cost", "audit")}))
             .unionByName(stream(rows, 2, **{c: F.col(c) for c in ("segment", "role", "text", "times", "pos")})))
    return (whole.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "segment", "kind", "pos", "start")
            .mapInArrow(forward(done_schema), done))


# DuckDB SQL for the rows of the query: the cheapest edits by dynamic programming from the last row back.
SQL = r"""
WITH k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
-- CRC-32 of the key, byte by byte and bit by bit
z AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
           list_concat([4294967295], list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                    lambda x, e: xor(x >> 1, (x & 1) * 3988292384)))) % 20 AS kind FROM k),
m AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM z WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM m),
f AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
-- From the last row back: the cheapest rest (cost c, audit a, lines l) after each last role: 1 none, 2 system, 3 user, 4 assistant
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         list({'r': role, 't': text, 'i': initial, 'stays': fault NOT IN ('blank', 'duplicate'),
               'x': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END,
               'best': []::STRUCT(c BIGINT, a VARCHAR, l VARCHAR[])[]} ORDER BY pos DESC) AS rows
  FROM f GROUP BY conv_id),
e AS (
  SELECT *, list_reduce(rows, lambda p, w: {'r': '', 't': '', 'i': '', 'stays': true, 'x': 0, 'best': list_transform(
    -- Delete, Keep (a first system row, or the role that follows), Rerole
    [list_transform([{'q': 1, 'f': 3}, {'q': 2, 'f': 3}, {'q': 3, 'f': 4}, {'q': 4, 'f': 3}], lambda z: list_min(list_concat(
       [{'c': p.best[z.q].c + 4, 'a': 'D' || p.best[z.q].a, 'l': p.best[z.q].l}],
       CASE WHEN w.stays AND w.i = CASE z.f WHEN 3 THEN 'u' ELSE 'a' END
            THEN [{'c': p.best[z.f].c + w.x, 'a': 'K' || p.best[z.f].a, 'l': list_concat([w.r || ':' || w.t], p.best[z.f].l)}] ELSE [] END,
       CASE WHEN w.stays AND w.i = 's' AND z.q = 1
            THEN [{'c': p.best[2].c + w.x, 'a': 'K' || p.best[2].a, 'l': list_concat([w.r || ':' || w.t], p.best[2].l)}] ELSE [] END,
       CASE WHEN w.stays THEN [{'c': p.best[z.f].c + w.x + 3, 'a': 'R' || p.best[z.f].a,
              'l': list_concat([CASE z.f WHEN 3 THEN 'user:' ELSE 'assistant:' END || w.t], p.best[z.f].l)}] ELSE [] END)))],
    -- up to two Inserts before the row
    lambda b: list_transform([{'q': 1, 'f': 3}, {'q': 2, 'f': 3}, {'q': 3, 'f': 4}, {'q': 4, 'f': 3}], lambda z: list_min(
      [b[z.q],
       {'c': b[z.f].c + 3, 'a': 'I' || b[z.f].a,
        'l': list_concat([CASE z.f WHEN 3 THEN 'user:' ELSE 'assistant:' END], b[z.f].l)},
       {'c': b[7 - z.f].c + 6, 'a': 'II' || b[7 - z.f].a,
        'l': list_concat(CASE z.f WHEN 3 THEN ['user:', 'assistant:'] ELSE ['assistant:', 'user:'] END, b[7 - z.f].l)}])))[1]},
    {'r': '', 't': '', 'i': '', 'stays': true, 'x': 0, 'best': [{'c': 0, 'a': '', 'l': []}, {'c': 6, 'a': 'II', 'l': ['user:', 'assistant:']},
      {'c': 3, 'a': 'I', 'l': ['assistant:']}, {'c': 0, 'a': '', 'l': []}]}).best[1] AS best FROM g)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(array_to_string(best.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN e ON i.conv_id IS NOT DISTINCT FROM e.conv_id
"""
