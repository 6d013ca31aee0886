"""A token store of directly addressable codes.

Ids are split into chunks of ``width`` bits, low chunk first. Level k holds the k-th chunk of every id that has one, and a
bitmap that says of each whether the id goes on; a directory of ranks (ones before every 512 bits) leads from a place in one
level to its place in the next, so any token is read without decoding its block.

A block is one byte string: magic ``DAC1``, then little-endian u32 width, levels, documents and u64 tokens; u64 offsets of the
documents (one more than there are) and their i64 ids; then for each level u64 length, the chunks (bytes), the bitmap (bits,
lowest first, filled up to whole 64-bit words) and the u32 ranks. Blocks are written as rows of a Parquet table in ascending
document order, so Spark's committer handles retries and lost executors.

Null and empty texts are the end id alone; a text longer than a block is one block. Null ids come first; equal ids stay separate
documents in order of a hash of their text, equal rows too. Extra columns are ignored. An
empty table gives an empty store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, read_table, settled
from .tokens import encoder

MAGIC, STEP = b"DAC1", 512


def encode_block(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, width: int = 8) -> bytes:
    """One block of the tokens ``ids``; those of each document are over at ``ends``. A null document id is stored as the least i64."""
    offsets = np.concatenate([[0], ends]).astype("<u8")
    rest, levels = ids.astype(np.uint32, copy=False), []
    while len(rest) or not levels:
        more = rest >> np.uint32(width)
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % 8))
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(goes_on, np.arange(0, len(rest), STEP)))[:-1]]).astype("<u4") if len(rest) else np.empty(0, "<u4")
        low = (rest & np.uint32((1 << width) - 1)).astype("<u1" if width <= 8 else "<u2")
        levels.append(struct.pack("<Q", len(rest)) + low.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = more[goes_on]
    named = np.array([-(1 << 63) if d is None else d for d in doc_ids], "<i8")
    return MAGIC + struct.pack("<IIIQ", width, len(levels), len(ends), len(ids)) + offsets.tobytes() + named.tobytes() + b"".join(levels)


class Block:
    """A block read in place: ``block[i]`` is any token, ``tokens(a, b)`` a run of them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        self.width, n_levels, docs, self.n = struct.unpack_from("<IIIQ", data, 4)
        at = 24
        self.offsets = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.doc_ids = [None if d == -(1 << 63) else int(d) for d in np.frombuffer(data, "<i8", docs, at)]
        at += 8 * docs
        self.levels = []
        kind, size = ("<u1", 1) if self.width <= 8 else ("<u2", 2)
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            low = np.frombuffer(data, kind, n, at)
            at += n * size
            words = -(-n // 64)
            bits = np.frombuffer(data, np.uint8, words * 8, at)
            at += words * 8
            ranks = np.frombuffer(data, "<u4", -(-n // STEP), at)
            at += 4 * len(ranks)
            self.levels.append((low, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for low, bits, ranks in self.levels:
            value |= int(low[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bits, ranks, i)
            shift += self.width
        return value

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before place ``i``: the directory's count, whole bytes, and the bits of the last byte."""
        a = i // STEP * STEP >> 3
        whole = int(np.bitwise_count(bits[a : i >> 3]).sum())
        return int(ranks[i // STEP]) + whole + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Tokens ``a`` to ``b``: a slice of each level, found by rank."""
        out, at, shift = np.zeros(max(b - a, 0), np.uint32), np.arange(max(b - a, 0)), 0
        for low, bits, ranks in self.levels:
            if not len(at):
                break
            out[at] |= low[a:b].astype(np.uint32) << np.uint32(shift)
            goes_on = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].astype(bool)
            a = self._rank(bits, ranks, a)
            b = a + int(goes_on.sum())
            at = at[goes_on]
            shift += self.width
        return out


def write_store(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end: int = 0, block_tokens: int = 1 << 21) -> DataFrame:
    """Write the store and return its table: part, block (both in document order), before (tokens of the part's earlier blocks), tokens, data.

    Documents are dealt out by ranges of doc_id, those of one id by a hash of their text, and sorted within them; a block closes
    once it has ``block_tokens`` tokens. Codes are written as they are, without compression, so that a block is read in place.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    parts = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        closed, part, number = encoder(vocabulary).closed, TaskContext.get().partitionId(), 0
        names, held, ends, size, before = [], [], [], 0, 0

        def close() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "block": [number], "before": [before], "tokens": [size], "data": [encode_block(names, np.concatenate(ends), np.concatenate(held))]})

        for pdf in batches:
            docs_of = iter(pdf["doc_id"])
            for texts in chunks(pdf["text"], 1 << 22):
                ids, cuts = closed(texts, end)
                names += [None if pd.isna(d) else int(d) for d in islice(docs_of, len(texts))]
                held.append(ids)
                ends.append(cuts + size)
                size += len(ids)
                if size >= block_tokens:
                    yield close()
                    names, held, ends, size, before, number = [], [], [], 0, before + size, number + 1
        if names:
            yield close()

    return materialize(parts.mapInPandas(settled(run), "part int, block int, before long, tokens long, data binary"), "tokens", compression="uncompressed")


def numbered(store: DataFrame) -> DataFrame:
    """``store`` with ``first``, the number of a block's first token in the whole store."""
    base, at = {}, 0
    # one row for each task that wrote
    for row in sorted(store.groupBy("part").agg(F.sum("tokens").alias("n")).collect(), key=lambda r: r["part"]):
        base[row["part"]] = at
        at += row["n"]
    parts = store.sparkSession.createDataFrame(sorted(base.items()), "part int, base long")
    return store.join(F.broadcast(parts), "part").withColumn("first", F.col("base") + F.col("before"))


def tokens_at(store: DataFrame, wanted: DataFrame, span: int = 1 << 21) -> DataFrame:
    """(at, token) for the token numbers ``at`` of ``wanted``: its block is found by an equi-join on spans of token numbers, the token by ranks."""
    spans = F.explode(F.sequence(F.floor(F.col("first") / span), F.floor((F.col("first") + F.col("tokens") - 1) / span)))
    blocks = numbered(store).select("first", "tokens", "data", spans.alias("span"))
    asked = wanted.select("at", F.floor(F.col("at") / span).alias("span")).join(blocks.drop("data"), "span").where("at >= first and at < first + tokens")
    by_block = asked.groupBy("first").agg(F.collect_set("at").alias("ats")).join(numbered(store).select("first", "data"), "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, ats, data in zip(pdf["first"], pdf["ats"], pdf["data"], strict=True):
                block = Block(data)
                yield pd.DataFrame({"at": ats, "token": [block[int(a) - first] for a in ats]})

    return by_block.mapInPandas(settled(run), "at long, token long")


def read_store(store: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. Each document's run of tokens is found by ranks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, data in zip(pdf["first"], pdf["data"], strict=True):
                block = Block(data)
                cuts = block.offsets.tolist()
                crc = [zlib.crc32(block.tokens(a, b).astype("<u4", copy=False)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(block.doc_ids, "Int64"), "start": block.offsets[:-1] + first, "n_tokens": np.diff(block.offsets), "ids_crc32": crc})

    return numbered(store).select("first", "data").mapInPandas(settled(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_store(spark, sf_dir: str) -> DataFrame:
    return read_store(write_store(read_table(spark, sf_dir, "documents")))
