"""Best-fit packing of token sequences by a swap-based local search.

Documents are encoded and cut into pieces of at most ``capacity`` tokens (only longer documents are cut). Pieces are dealt
into groups of about ``group_size`` by a hash, so that no task holds more than a bounded share of the corpus. A group's pieces
fill bins one after the other in the order they come (or by best fit, where the search doesn't come below that); then underfull bins are improved: pieces move, one-for-one and two-for-one exchanges
are made between bins, always to the bin where they fit best, whenever that increases the sum of squared fills. This drains the
emptiest bins until they vanish. A search ends when its group has ceil(tokens / capacity) bins, which is the fewest possible,
or when no bin has an exchange left that gains. Bins still underfull then meet those of other groups in new groups and are
searched again, round after round, until one group holds all of them or a round frees none. A group never needs more bins than best fit.

Null and empty texts are sequences of the end id alone. Repeated rows and ids are packed as separate pieces; of exchanges that
gain alike the first is taken. A text of any length is cut into pieces that are packed apart. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, materialize, read_table, settled, spread
from .tokens import encoder


def pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end: int = 1, capacity: int = 4096) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        closed = encoder(vocabulary).closed
        for pdf in batches:
            docs_of, rows = iter(pdf["doc_id"]), []
            for texts in chunks(pdf["text"], 1 << 22):
                ids, ends = closed(texts, end)
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                for doc, a, b in zip(islice(docs_of, len(texts)), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    for k, at in enumerate(range(a, b, capacity)):
                        n = min(capacity, b - at)
                        rows.append((doc, k, at - a, n, zlib.crc32(data[4 * at : 4 * (at + n)])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(settled(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def in_order(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece when bins are filled one after the other."""
    out, b, fill = np.zeros(len(lengths), np.int64), 0, 0
    for i, n in enumerate(lengths.tolist()):
        if fill + n > capacity:
            b, fill = b + 1, 0
        out[i] = b
        fill += n
    return out


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece by best fit, longest piece first."""
    rooms: list[tuple[int, int]] = []  # (room, bin) of underfull bins
    out, bins = np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b, bins = capacity, bins, bins + 1
        out[i] = b
        if room > n:
            insort(rooms, (room - n, b))
    return out


class Bins:
    """Bins of one group, and the search; ``of`` is the bin of each piece."""

    def __init__(self, lengths: np.ndarray, of: np.ndarray, capacity: int):
        self.capacity, self.lengths, self.of = capacity, lengths.astype(np.int64), of.astype(np.int64)
        n = int(self.of.max()) + 1 if len(of) else 0
        self.fill = np.bincount(self.of, self.lengths, n).astype(np.int64)
        self.items: list[list[int]] = [[] for _ in range(n)]
        for i, b in enumerate(self.of.tolist()):
            self.items[b].append(i)

    def _open(self) -> None:
        """Lay out the pieces of underfull bins for the search."""
        self.at = np.flatnonzero(self.fill[self.of] < self.capacity)
        self.size, self.bin = self.lengths[self.at], self.of[self.at]
        self.place = np.full(len(self.of), -1, np.int64)
        self.place[self.at] = np.arange(len(self.at))

    def _shift(self, a: int, b: int, give: list[int], take: list[int]) -> None:
        """Give pieces of bin ``a`` to ``b`` and take others back."""
        for source, target, moved in ((a, b, give), (b, a, take)):
            for i in moved:
                self.items[source].remove(i)
                self.items[target].append(i)
                self.of[i] = self.bin[self.place[i]] = target
                self.fill[source] -= self.lengths[i]
                self.fill[target] += self.lengths[i]

    def _step(self, a: int) -> bool:
        """The exchange that carries tokens from bin ``a`` to another with the greatest gain: moves first, then one for one, then two for one."""
        fill = self.fill[self.bin]
        fill_a, own = int(self.fill[a]), {}
        fill[self.bin == a] = self.capacity  # not with itself
        for i in self.items[a]:
            own.setdefault(int(self.lengths[i]), []).append(i)  # pieces of one length are alike
        sizes = sorted(own, reverse=True)
        room = self.capacity - fill
        for n in sizes:  # a move, to the bin that it fills most
            fits = np.where((room >= n) & (fill + n > fill_a), room, self.capacity + 1)
            if len(fits) and fits[j := int(fits.argmin())] <= self.capacity:
                self._shift(a, int(self.bin[j]), own[n][:1], [])
                return True
        singles = [(n, own[n][:1]) for n in sizes]
        pairs = [(n + m, [own[n][0], own[m][0]]) for k, n in enumerate(sizes) for m in sizes[k + 1 :]] + [(2 * n, own[n][:2]) for n in sizes if len(own[n]) > 1]
        for offers in (singles, pairs):
            best = (0, None, None)
            for n, give in offers:
                carried = n - self.size
                gain = np.where((carried > 0) & (carried <= room), carried * (fill - fill_a + carried), 0)
                if len(gain) and gain[j := int(gain.argmax())] > best[0]:
                    best = (int(gain[j]), give, j)
            if best[0]:
                self._shift(a, int(self.bin[best[2]]), best[1], [int(self.at[best[2]])])
                return True
        return False

    def search(self) -> None:
        """Drain bins, the emptiest first, until no exchange gains or the lower bound is reached. Every exchange increases the sum of squared fills, so the search ends."""
        least = -(-int(self.lengths.sum()) // self.capacity)
        gained = True
        while gained and (self.fill > 0).sum() > least:
            gained = False
            self._open()
            under = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            for a in under[np.argsort(self.fill[under], kind="stable")].tolist():
                while 0 < self.fill[a] < self.capacity and self._step(a):
                    gained = True
                if gained and not self.fill[a] and (self.fill > 0).sum() <= least:
                    return
                if (self.fill[self.bin] == self.capacity).sum() > len(self.bin) // 2:
                    self._open()


def fewest(lengths: np.ndarray, of: np.ndarray, capacity: int) -> Bins:
    """The bins that the search reaches from ``of``; or from best fit, where that alone needs no more than it reached."""
    bins = Bins(lengths, of, capacity)
    bins.search()
    used = int((bins.fill > 0).sum())
    if used > -(-int(lengths.sum()) // capacity):
        plain = best_fit(lengths, capacity)
        if int(plain.max()) + 1 <= used:
            other = Bins(lengths, plain, capacity)
            other.search()
            if (other.fill > 0).sum() < used:
                return other
    return bins


def pack(parts: DataFrame, capacity: int = 4096, group_size: int = 16384) -> DataFrame:
    """``parts``, a written table, with ``sequence_id`` and ``offset``; needs doc_id, piece, start, length of which no length exceeds ``capacity``."""
    kept = parts.drop("sequence_id", "offset")
    names = kept.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", group_ long, bin_ long, underfull_ boolean, offset long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if "bin_" in pdf:  # bins of an earlier round stay together
            old = pd.factorize(pd.MultiIndex.from_frame(pdf[["old_", "bin_"]]))[0]
        else:
            pdf = pdf.sort_values([c for c in ("doc_id", "piece") if c in pdf], kind="stable")
            pdf = pdf.iloc[np.random.default_rng(len(pdf)).permutation(len(pdf))]
            old = in_order(pdf["length"].to_numpy(), capacity)
        bins = fewest(pdf["length"].to_numpy(), old, capacity)
        offset = np.zeros(len(pdf), np.int64)
        for items in bins.items:
            offset[items] = np.cumsum([0, *bins.lengths[items][:-1]])
        return pdf[names].assign(group_=pdf["group_"].iloc[0], bin_=bins.of, underfull_=bins.fill[bins.of] < capacity, offset=offset)

    most = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def grouped(df: DataFrame, rows: int, *key) -> tuple[DataFrame, int]:
        """Rows with their group, dealt out so that small groups aren't gathered into few tasks."""
        n = max(1, -(-rows // group_size))
        return df.withColumn("group_", F.pmod(F.xxhash64(*key), F.lit(n))).repartition(min(n, most), "group_"), n

    # the row's place spreads repeated rows too; a written table has the same places in a second try
    dealt, groups = grouped(kept, parts.count(), "doc_id", "piece", F.monotonically_increasing_id())
    found, number, done = materialize(dealt.groupBy("group_").applyInPandas(run, schema), "packed"), 0, []
    while True:
        done.append(found.where("not underfull_").withColumn("round_", F.lit(number)))
        left = found.where("underfull_")
        told = left.agg(F.count("*").alias("rows"), F.count_distinct("group_", "bin_").alias("bins")).first()
        if groups == 1 or number and told["bins"] >= before:
            done.append(left.withColumn("round_", F.lit(number)))
            break
        before, number = told["bins"], number + 1
        again, groups = grouped(left.drop("offset").withColumnRenamed("group_", "old_"), told["rows"], "old_", "bin_", F.lit(number))
        found = materialize(again.groupBy("group_").applyInPandas(run, schema), "packed")
    out = done[0]
    for df in done[1:]:
        out = out.unionAll(df)
    # 24 bits for a bin of a group, 23 for a group, 16 for a round
    name = (F.col("round_").cast("long") * (1 << 47)) + F.shiftleft(F.col("group_"), 24) + F.col("bin_")
    return out.select(*names, name.alias("sequence_id"), "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_whole(docs)


def pack_whole(docs: DataFrame) -> DataFrame:
    cut = materialize(pieces(spread(docs, "doc_id")), "pieces")
    out = pack(cut)
    discard(cut)
    return out


def pack_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents left."""
    return pack_whole(docs.select("doc_id", "text"))
