"""Repair of conversations: turns aligned to the alternating grammar at least cost.

A repaired conversation is empty, or has an optional system turn and then one or more pairs of a user's and an assistant's turn, told by the
roles' first letters: ``(s?(ua)+)?``. Keeping a turn costs 0, giving it the role user or assistant 3, deleting it 4, inserting an empty turn of
user or assistant 3; a truncated turn that isn't deleted costs 3 more, and blank and repeated turns must go.

Method: Wagner-Fischer alignment of a conversation's turns to each feasible length of the grammar's string. Strings of all lengths end
alike, so they share a matrix of (turns left, letters left), filled from the end; a conversation's own lengths are cells of its first
row. A greedy repair gives the incumbent cost, and only the band of cells (Ukkonen) is filled through which a path of no greater cost can
lead: with ``slack`` above what must be deleted, at most slack / 4 letters fewer than usable turns or slack / 3 more. From every length that
reaches the least cost the cheapest path is traced back, smallest edit first (Delete, Insert, Keep, Rerole: the order of their
initials), and the audits compared; the ASCII-least one wins. Long conversations are aligned in blocks of ``BLOCK`` turns from the last to the
first, each for every state that it may begin and end in, so time and memory are linear in a conversation's length and the result is the same.

Spark numbers the turns, marks faults and joins edits and turns by (conversation, row); Python sees one letter for each turn. A conversation's rows
pass through one task as a sorted stream, with spill, and never sit in memory together.

Null roles and texts are one space; a null conv_id is a conversation of its own; null turns come first; turns of one number are ordered by
role and text. A conversation without rows has no edits, an empty table gives an empty one, other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, read_table
from .digests import EMPTY, joined_sha256

WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
BLOCK = 512
FAR = 1 << 40
#: What may follow: nothing stands yet, only the system's turn stands, the user's turn is next, the assistant's is.
START, SYSTEM, USER, ASSISTANT = range(4)


# ---- alignment of one conversation; a letter for each turn: x must go, else its role's initial (o: any other), capital if truncated


class Block:
    """The alignment of up to ``BLOCK`` turns, given what the rest of the conversation costs from each state."""

    def __init__(self, letters: str, after: list[int], last: bool):
        self.letters, self.after, self.last, self.n = letters, after, last, len(letters)
        self.cut = [CUT if c.isupper() else 0 for c in letters]
        self.role = letters.lower()
        usable = [c != "x" for c in letters]
        self.left = [sum(usable[i:]) for i in range(self.n + 1)] if self.n < 32 else [*np.cumsum(usable[::-1])[::-1].tolist(), 0]
        # a greedy repair bounds the cost from each state, by the pair that states without the user's turn may lack at the end
        incumbent = max(self.greedy(USER), self.greedy(ASSISTANT)) + 2 * INSERT
        slack = incumbent - DELETE * (self.n - self.left[0]) - min(after[USER], after[ASSISTANT])
        self.down = slack // DELETE + 1
        self.width = self.down + slack // INSERT + 2
        self.filled = {end: self.fill(end) for end in ((USER,) if last else (USER, ASSISTANT))}

    def greedy(self, state: int) -> int:
        """The cost of a repair that takes turns as they come."""
        cost = 0
        for c, cut in zip(self.role, self.cut, strict=True):
            if c == "x":
                cost += DELETE
            elif c in "ua":
                want = "u" if state == USER else "a"
                cost += cut + (0 if c == want else INSERT)
                state = ASSISTANT if c == "u" else USER
            elif REROLE + cut < DELETE:
                cost += REROLE + cut
                state = USER + ASSISTANT - state
            else:
                cost += DELETE
        if self.last:
            return cost + (INSERT if state == ASSISTANT else 0)
        return cost + self.after[state]

    @staticmethod
    def sign(left: int, end: int) -> str:
        """The letter of the grammar with ``left`` letters to go, its own included, before the state ``end``."""
        return "a" if left % 2 == (end == USER) else "u"

    def fill(self, end: int) -> np.ndarray:
        """Least costs of ``turns i..`` against ``m`` letters that lead to ``end``; a row's column is m - usable turns left + down."""
        out = np.full((self.n + 1, self.width), FAR, np.int64)
        column = np.arange(self.width)
        step = INSERT * column
        m = column - self.down
        now = out[self.n]
        now[m == 0] = self.after[end]
        if self.last:
            np.minimum(now, np.where(m > 0, INSERT * m + self.after[end], FAR), out=now)
        for i in range(self.n - 1, -1, -1):
            m = column + (self.left[i] - self.down)
            if self.letters[i] == "x":
                new = now + DELETE
            else:
                new = np.full(self.width, FAR, np.int64)
                new[:-1] = now[1:] + DELETE
                u, a = (self.cut[i] + (0 if self.role[i] == c else REROLE) for c in "ua")
                odd, even = (a, u) if end == USER else (u, a)
                new = np.minimum(new, np.where(m >= 1, now + np.where(m % 2 == 1, odd, even), FAR))
            new[m < 0] = FAR
            new = np.minimum.accumulate(new - step) + step
            out[i] = now = np.minimum(new, FAR)
        return out

    def cost(self, end: int, i: int, m: int) -> int:
        k = m - self.left[i] + self.down
        return int(self.filled[end][i, k]) if 0 <= k < self.width and m >= 0 else FAR

    def lengths(self, i: int, first: str) -> Iterator[tuple[int, int, int]]:
        """(cost, end, letters) for every length of at least one letter that begins with ``first`` at turn ``i``."""
        for end, filled in self.filled.items():
            for k in np.flatnonzero(filled[i] < FAR).tolist():
                m = k + self.left[i] - self.down
                if m >= 1 and self.sign(m, end) == first:
                    yield int(filled[i, k]), end, m

    def ways(self, state: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(cost, end, first turn aligned, letters, system turn or -1) of every length from ``state``."""
        gone = DELETE * self.n
        yield gone + self.after[state], state, self.n, 0, -1
        for cost, end, m in self.lengths(0, "a" if state == ASSISTANT else "u"):
            yield cost, end, 0, m, -1
        if state == START:
            for i in (i for i, c in enumerate(self.role) if c == "s"):
                before = DELETE * i + self.cut[i]
                yield before + DELETE * (self.n - i - 1) + self.after[SYSTEM], SYSTEM, self.n, 0, i
                for cost, end, m in self.lengths(i + 1, "u"):
                    yield before + cost, end, i + 1, m, i

    def best(self, state: int) -> int:
        return min(w[0] for w in self.ways(state))

    def trace(self, end: int, i: int, m: int) -> tuple[str, str]:
        """The ASCII-least cheapest edits from a cell, and the letters given by them."""
        edits, given = [], []
        while i < self.n or m:
            now, sign = self.cost(end, i, m), self.sign(m, end)
            place = self.cost(end, i + 1, m - 1) + self.cut[i] if i < self.n and m and self.letters[i] != "x" else FAR
            if i < self.n and self.cost(end, i + 1, m) + DELETE == now:
                edit, i = "D", i + 1
            elif m and self.cost(end, i, m - 1) + INSERT == now:
                edit, m = "I", m - 1
            elif place == now and self.role[i] == sign:
                edit, i, m = "K", i + 1, m - 1
            else:
                edit, i, m = "R", i + 1, m - 1
            edits.append(edit)
            given.append(sign if edit in "IR" else "-")
        return "".join(edits), "".join(given)

    def audit(self, state: int) -> tuple[str, str, int]:
        """The ASCII-least audit of all lengths of the least cost, the letters given by its edits, and the state it ends in."""
        least, found = self.best(state), []
        for cost, end, i, m, system in self.ways(state):
            if cost == least:
                # a block's turns before and after what is aligned are deleted, but for the system's turn
                edits, given = self.trace(end, i, m) if m else ("D" * (self.n - i), "-" * (self.n - i))
                if system >= 0:
                    tail = self.n - system - 1 - len(edits) if not m else 0
                    edits, given = "D" * system + "K" + edits + "D" * tail, "-" * (system + 1) + given + "-" * tail
                elif not m:
                    edits, given = "D" * self.n, "-" * self.n
                found.append((edits, given, end))
        return min(found)


def align(letters: str, block: int = BLOCK) -> tuple[int, list[tuple[str, str]]]:
    """Least cost of a conversation, and its audit in blocks: edits and the letters that they give."""
    cuts = [letters[a : a + block] for a in range(0, len(letters), block)] or [""]
    after, blocks = [0, FAR, 0, FAR], []
    for k, part in enumerate(reversed(cuts)):
        b = Block(part, after, k == 0)
        blocks.append(b)
        after = [b.best(state) for state in range(4)]
    out, state = [], START
    for b in reversed(blocks):
        edits, given, state = b.audit(state)
        out.append((edits, given))
    return after[START], out


# ---- tables


def _conv(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(""))


def damage(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 dropped, 1 emptied, 2 without its ends of sentences, 3 repeated, 4 given to the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    told = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", f"[{ENDS}]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return told.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def number(turns: DataFrame) -> DataFrame:
    """(conv, conv_id, row, turn, role, text, fault, illegal, new_turn, letter) of each turn, rows counted from 1 in a conversation.

    ``fault`` is blank, duplicate, truncated or null; ``illegal`` tells that its role can't follow the one before.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    rows = Window.partitionBy("conv").orderBy(*order)
    same = Window.partitionBy("conv", "role", "text").orderBy("row")
    named = turns.select(_conv(F.col("conv_id")).alias("conv"), "conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    initial, end = F.substring("role", 1, 1), F.rtrim("text", F.lit(WHITE))
    numbered = named.select("*", F.row_number().over(rows).alias("row"), F.lag(initial).over(rows).alias("before"), F.lag("turn").over(rows).alias("turn_before"))
    told = numbered.withColumn("nth", F.row_number().over(same))
    fault = F.when(end == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.substring(end, -1, 1).isin(*ENDS), "truncated")
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return told.withColumn("fault", fault).select(
        "conv", "conv_id", "row", "turn", "role", "text", "fault", (F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"), letter.alias("letter"),
    )


def _spelled(rows: DataFrame, span: int = 4096) -> DataFrame:
    """(conv, letters): a conversation's letters in order, put together in spans first."""
    in_order = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]), "")
    spans = rows.groupBy("conv", F.floor(F.col("row") / span).alias("span")).agg(in_order("row", "letter").alias("letters"))
    return spans.groupBy("conv").agg(in_order("span", "letters").alias("letters"))


def alignments(numbered: DataFrame) -> DataFrame:
    """(conv, block, cost, edits, given, rows): each conversation's audit in blocks; ``rows`` has an edit's row, null for an inserted turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = lru_cache(1 << 14)(align)
        for batch in batches:
            out: list[tuple] = []
            for conv, letters in zip(batch.column("conv").to_pylist(), batch.column("letters").to_pylist(), strict=True):
                cost, parts = short(letters) if len(letters) <= 64 else align(letters)
                row = 0
                for k, (edits, given) in enumerate(parts):
                    at = [None if e == "I" else (row := row + 1) for e in edits]
                    out.append((conv, k, cost, edits, given, at))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds, names = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())], ["conv", "block", "cost", "edits", "given", "rows"]
    return _spelled(numbered).mapInArrow(run, "conv string, block int, cost long, edits string, given string, rows array<int>")


def repaired(numbered: DataFrame, aligned: DataFrame) -> DataFrame:
    """(conv, block, place, edit, row, role, text): the turns after repair, in order of block and place."""
    each = F.posexplode(F.arrays_zip(F.split("edits", "").alias("edit"), F.split("given", "").alias("sign"), F.col("rows").alias("row")))
    edits = aligned.where("edits <> ''").select("conv", "block", each.alias("place", "e")).select("conv", "block", "place", "e.edit", "e.sign", "e.row").where("edit <> 'D'")
    given = F.when(F.col("sign") == "u", "user").when(F.col("sign") == "a", "assistant")
    stays = edits.where("edit <> 'I'").join(numbered.select("conv", "row", "role", "text"), ["conv", "row"])
    new = edits.where("edit = 'I'").select("conv", "row", "block", "place", "edit", "sign", F.lit("").alias("role"), F.lit("").alias("text"))
    return stays.unionByName(new).select("conv", "block", "place", "edit", "row", F.coalesce(given, "role").alias("role"), "text")


def audits(turns: DataFrame, numbered: DataFrame, aligned: DataFrame) -> DataFrame:
    """A row for each conversation of ``turns``: what was wrong in ``numbered``, what it costs, and the audit."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum(F.col("new_turn").cast("long")), F.lit(0))
    found = numbered.groupBy("conv").agg(gaps.alias("gaps"), *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), count(F.col("illegal")).alias("illegal"))
    edits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda s: s["edits"]), "")
    costs = aligned.groupBy("conv").agg(F.max("cost").alias("cost"), edits.alias("audit"))
    ids = turns.groupBy(_conv(F.col("conv_id")).alias("conv")).agg(F.max("conv_id").alias("conv_id"))
    return ids.join(found, "conv", "left").join(costs, "conv", "left").na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill("", ["audit"])


def op12_turn_repair(spark, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults, and the digest of what repair makes of them."""
    turns = read_table(spark, sf_dir, "conversations")
    numbered = materialize(number(damage(turns)), "turns")
    aligned = materialize(alignments(numbered), "alignments")
    lines = repaired(numbered, aligned).select("conv", "block", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = joined_sha256(lines, ["conv"], ["block", "place"], "line", "\n", "repaired_sha256")
    told = audits(turns, numbered, aligned).join(digests, "conv", "left").na.fill(EMPTY, ["repaired_sha256"])
    out = materialize(told.select("conv_id", *(F.col(c).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), "audit", "repaired_sha256"), "audits")
    discard(numbered)
    discard(aligned)
    return out


#: The same rows in SQL: a walk over the turns that keeps the cheapest, then ASCII-least, audit of each state of the grammar.
ORACLE = r"""
WITH RECURSIVE damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM (SELECT *, xor(list_reduce([4294967295]::BIGINT[] || list_transform(range(8 * length(s)), lambda i: ((ascii(s[(i // 8 + 1)::INT]) >> (i % 8)::INT) & 1)::BIGINT),
      lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384)), 4294967295) % 20 AS kind
    FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations)) WHERE kind <> 0),
counted AS (
  SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w || role[1] AS pair,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
turns AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM counted),
steps(st, lead, sign, nxt) AS (VALUES ('S', '', 's', 'T'), ('S', '', 'u', 'A'), ('T', '', 'u', 'A'), ('U', '', 'u', 'A'), ('A', '', 'a', 'U'), ('S', 'I', 'a', 'U'), ('T', 'I', 'a', 'U'), ('U', 'I', 'a', 'U'), ('A', 'I', 'u', 'A')),
options AS (
  SELECT t.conv_id, i, st, nxt, 3 * length(lead) + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END + CASE WHEN role[1] = sign THEN 0 ELSE 3 END AS price, lead || CASE WHEN role[1] = sign THEN 'K' ELSE 'R' END AS edit
  FROM turns t, steps WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate') AND (role[1] = sign OR sign <> 's')
  UNION ALL SELECT conv_id, i, st, st, 4, 'D' FROM turns, (VALUES ('S'), ('T'), ('U'), ('A')) s(st)),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 'S' AS st, {'cost': 0::BIGINT, 'audit': ''} AS b FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT w.conv_id, w.i + 1, o.nxt, min({'cost': w.b.cost + o.price, 'audit': w.b.audit || o.edit}) FROM walk w JOIN options o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i + 1 AND o.st = w.st GROUP BY 1, 2, 3),
ended AS (
  SELECT w.conv_id, min({'cost': w.b.cost + CASE st WHEN 'A' THEN 3 WHEN 'T' THEN 6 ELSE 0 END, 'audit': w.b.audit || CASE st WHEN 'A' THEN 'I' WHEN 'T' THEN 'II' ELSE '' END}) AS b
  FROM walk w JOIN (SELECT conv_id, max(i) AS n FROM turns GROUP BY 1) l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.i GROUP BY 1),
edits AS (
  SELECT conv_id, k, b.audit[k::INT] AS e, length(replace(b.audit[:k::INT], 'I', '')) AS i FROM (SELECT conv_id, b, unnest(range(1, length(b.audit) + 1)) AS k FROM ended)),
placed AS (
  SELECT e.conv_id, e.k, e.e, t.role, t.text, coalesce(e.e = 'K' AND t.role[1] = 's', false) AS opens, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.k) AS p
  FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i AND e.e <> 'I' WHERE e.e <> 'D'),
lines AS (
  SELECT conv_id, k, CASE WHEN e = 'K' THEN role WHEN (p - opened::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS line
  FROM (SELECT *, bool_or(opens) OVER (PARTITION BY conv_id) AS opened FROM placed)),
texts AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS digest FROM lines GROUP BY 1),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
