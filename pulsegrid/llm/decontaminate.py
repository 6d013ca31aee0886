"""Benchmark decontamination by pigeonhole edit matching.

An item of length m may occur in a document with up to ``m // chars_per_edit`` edits. It is cut into one piece more than that
budget, so every such occurrence holds at least one piece unchanged; an Aho-Corasick automaton finds the pieces in one pass
over each whole text, and Myers' bit-parallel distance decides around each hit. Letters are compared in lower case and white
space as single spaces. The items are a stated query set: they are broadcast in blocks of about ``block`` characters, one pass
over the documents for each block; the driver holds one block at a time, and the passes' results are written tables.

Defined results: null and empty texts match nothing, items without a character are left out, equal items count once for each
item_id, repeated documents give repeated rows, and of several places the one of least distance, then the first, is told.
Null ids are told like others, a very long text is searched whole, empty tables give no match, and extra columns are ignored by ``matches`` and kept by ``without_matches``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table, settled, spread

SCHEMA = "doc_id long, item_id long, distance int, budget int, start long, length int"


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to a part of ``text`` and the first end of such a part; None if over ``most``."""
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = masks[c] if c in masks else 0
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best[0]:
            best = (score, j + 1)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return best if best[0] <= most else None


class Matcher:
    """Items that occur in a text within their budgets."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        import ahocorasick

        self.items = [(i, t, len(t) // chars_per_edit) for i, t in ((i, plain(t)) for i, t in items) if t]
        places = defaultdict(list)
        for n, (_, t, budget) in enumerate(self.items):
            cuts = [k * len(t) // (budget + 1) for k in range(budget + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                places[t[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, budget, start, length), places in the text as compared."""
        text, spans = plain(text), defaultdict(list)
        if not text or not self.items:
            return []
        for end, (size, where) in self.automaton.iter(text):
            for n, a in where:
                _, t, budget = self.items[n]
                first = end - size + 1 - a
                known = spans[n]
                lo, hi = max(first - budget, 0), min(first + len(t) + budget, len(text))
                if known and lo <= known[-1][1]:
                    known[-1] = (min(known[-1][0], lo), max(known[-1][1], hi))
                else:
                    known.append((lo, hi))
        out = []
        for n, regions in sorted(spans.items()):
            item, t, budget = self.items[n]
            best = None
            for lo, hi in sorted(regions):
                part = text[lo:hi]
                at = part.find(t)
                if at >= 0:
                    found = (0, lo + at, len(t))
                elif hit := myers(t, part, budget):
                    distance, end = hit
                    back = myers(t[::-1], part[max(0, end - len(t) - budget) : end][::-1], budget)
                    found = (distance, lo + end - back[1], back[1])
                else:
                    continue
                if best is None or found[:2] < best[:2]:
                    best = found
            if best:
                out.append((item, best[0], budget, best[1], best[2]))
        return out


def item_blocks(items: DataFrame, block: int) -> Iterator[tuple[Broadcast, bool]]:
    """The items in broadcast lists of about ``block`` characters, one after the other, and whether there are several; a list goes when the next is asked for."""
    spark = items.sparkSession
    items = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    for number in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        shared = spark.sparkContext.broadcast(rows)
        yield shared, blocks > 1
        if blocks > 1:
            shared.unpersist()


def matches(docs: DataFrame, items: DataFrame, chars_per_edit: int = 16, block: int = 4_000_000) -> DataFrame:
    """Per document and item that it holds: the least distance and its place."""

    def over(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value, chars_per_edit)
            for pdf in batches:
                rows = [(doc, i, d, budget, at, n) for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True) for i, d, budget, at, n in matcher.find(text)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "budget", "start", "length"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        return docs.select("doc_id", "text").mapInPandas(settled(run), SCHEMA)

    found = [materialize(over(shared), "matches") if several else over(shared) for shared, several in item_blocks(items, block)]
    return reduce(DataFrame.unionAll, found)


def without_matches(docs: DataFrame, items: DataFrame, chars_per_edit: int = 16, block: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""

    def over(docs: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            matcher = Matcher(shared.value, chars_per_edit)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not matcher.find(t) for t in texts], pa.bool_()))

        return docs.mapInArrow(settled(run), docs.schema)

    left = docs
    for shared, several in item_blocks(items, block):
        left = materialize(over(left, shared), "clean") if several else over(left, shared)
    return left


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return matches(docs, read_table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents go that hold a benchmark item within its budget.

    Null and empty texts hold none and stay; null ids, repeated rows and extra columns stay as they are; an empty table stays empty.
    """
    return without_matches(spread(docs, "doc_id"), read_table(spark, sf_dir, "benchmark"))
