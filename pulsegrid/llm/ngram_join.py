"""N-gram Jaccard join by count vectors in R-trees.

A document is the set of its 5-word shingles (64-bit hashes). Documents of equal sets are one *class*, told by a hash of the
set, so copies are never paired. Similar classes are found exactly:

1. *Cells.* Classes meet in a cell when they share one of the few shingles that a prefix must hold: of a set of n shingles
   ordered by a fixed order, two sets of Jaccard similarity t share one among the first n - ceil(t n) + 1. The order puts
   shingles that a bounded count sketch of the corpus finds frequent last, so shared passages don't become large cells; any
   order gives the same result.
2. *Points.* Tokens (shingles) are hashed into ``GROUPS`` groups; the group counts are a class's point. The sum of coordinate
   minima bounds the overlap of two classes. In a cell the points are bulk-loaded into an R-tree, searched with that bound,
   boxes first.
3. *Verification.* Surviving pairs are compared by their whole sets.

First every class is compared with the middle class of each of its cells, the one that shares most cells with others, and the links found are merged into components;
then only pairs of different components remain to be searched in the cells, which loses no link between components.

Defined results: null, empty and wordless texts have an empty set and link with nothing; texts with fewer than five words
are one shingle; repeated rows are copies of each other; a document without an id takes part like any other, but never names a
component; a very long text is a set like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, free_name, materialize, read_table, release, settled
from .components import components
from .wordhash import Words, shingles

WIDTH, GROUPS, SKETCH_BITS, CHUNK = 5, 256, 20, 512
FULL = 255  # a coordinate of so many stands for as many or more
NUMERATOR, DENOMINATOR = 4, 5  # the similarity from which two documents link, 0.8


def set_hash(s: np.ndarray) -> int:
    """The class of a sorted set: 64 bits of a cryptographic hash, as a signed integer."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sets_of(texts: list[str]) -> list[np.ndarray]:
    return shingles(Words([t.encode("utf-8", "replace").lower() for t in texts]), WIDTH)


def point(s: np.ndarray) -> np.ndarray:
    """Group counts of a set."""
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS), FULL).astype(np.uint8)


def most_overlap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Summed coordinate minima; two full coordinates bound nothing."""
    out = np.minimum(p, q).sum(-1, dtype=np.int64)
    return np.where(((p == FULL) & (q == FULL)).any(-1), 1 << 40, out)


def least_overlap(sizes: np.ndarray | int) -> np.ndarray | int:
    """Shingles that two sets must share at least when their sizes add up to this: ceil(t / (1 + t) * sum)."""
    return -(-NUMERATOR * sizes // (NUMERATOR + DENOMINATOR))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    n = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * n >= NUMERATOR * (len(a) + len(b) - n)


class RTree:
    """Points packed into boxes of ``fan`` by size, then boxes of boxes; a search follows boxes whose bound can be met."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 32):
        self.order = np.lexsort((*points.T, sizes))
        self.points, self.sizes, self.fan = points[self.order], sizes[self.order], fan
        self.levels = []
        high, low = self.points, self.sizes
        while len(high) > fan:
            cuts = np.arange(0, len(high), fan)
            high, low = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts)
            self.levels.append((high, low))

    def search(self, p: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points whose summed minima with ``p`` reach the overlap that similarity needs."""
        at = None
        for high, low in [*reversed(self.levels), (self.points, self.sizes)]:
            if at is None:
                at = np.arange(len(high))
            else:
                at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                at = at[at < len(high)]
            at = at[most_overlap(high[at], p) >= least_overlap(low[at] + size)]
            if not len(at):
                break
        return self.order[at]


def pairs_in(points: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of numbers, one of ``left`` and one of ``right``, that a search of the tree of ``right`` lets through."""
    tree = RTree(points[right], sizes[right])
    found = [right[tree.search(points[i], sizes[i])] for i in left]
    return np.repeat(left, [len(f) for f in found]), np.concatenate(found)


def summaries(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Per document doc_id, content, class, n_shingles, point; and the sketch: counts of shingles by the upper bits of their hash.

    The sketch's parts are summed up for every 256 tasks first, then over all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        sketch, bucket = np.zeros(1 << SKETCH_BITS, np.int64), TaskContext.get().partitionId() // 256
        for pdf in batches:
            rows, ids = [], iter(zip(pdf["doc_id"], pdf["content"], strict=True))
            for texts in chunks(pdf["text"]):
                found = sets_of(texts)
                for s in found:
                    rows.append((*next(ids), set_hash(s), len(s), point(s).tobytes()))
                sketch += np.bincount((np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            yield pd.DataFrame(rows, columns=["doc_id", "content", "class", "n_shingles", "point"]).assign(slot=-1, bucket=0, counts=None).astype({"doc_id": "Int64"})
        step = 1 << (SKETCH_BITS - 4)
        for k in range(16):
            yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "content": [0], "class": [0], "n_shingles": [0], "point": [None], "slot": [k], "bucket": [bucket], "counts": [np.minimum(sketch[k * step : (k + 1) * step], 0xFFFFFFFF).astype("<u4").tobytes()]})

    both = materialize(docs.select("doc_id", "text", F.xxhash64("text").alias("content")).mapInPandas(settled(run), "doc_id long, content long, class long, n_shingles long, point binary, slot int, bucket int, counts binary"), "classes")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<u4").astype(np.int64) for c in pdf["counts"])
        return pd.DataFrame({"slot": [pdf["slot"].iloc[0]], "counts": [np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()]})

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        # powers of two are enough to order by
        whole = np.frombuffer(add(pdf)["counts"].iloc[0], "<u4").astype(np.int64)
        return pd.DataFrame({"slot": [pdf["slot"].iloc[0]], "counts": [np.ceil(np.log2(whole + 1)).astype(np.uint8).tobytes()]})

    some = both.where("slot >= 0").select("slot", "bucket", "counts").groupBy("slot", "bucket").applyInPandas(add, "slot int, counts binary")
    parts = some.groupBy("slot").applyInPandas(rank, "slot int, counts binary").collect()
    sketch = np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in sorted(parts, key=lambda r: r["slot"])]) if parts else np.zeros(1 << SKETCH_BITS, np.uint8)
    return both.where("slot < 0").select("doc_id", "content", "class", "n_shingles", "point"), sketch


def prefix(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The shingles of which two similar sets share one, rarest first by the sketch."""
    n = len(s) - -(-NUMERATOR * len(s) // DENOMINATOR) + 1
    rank = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return s[np.lexsort((s, rank))[:n]]


def cells(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(cell, class), distinct: the prefix shingles of each class."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # classes told already by this task; only saves work
        for pdf in batches:
            for texts in chunks(pdf["text"]):
                keys, names = [], []
                for s in sets_of(texts):
                    name = set_hash(s)
                    if len(s) and name not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(name)
                        p = prefix(s, shared.value)
                        keys.append(p)
                        names.append(np.full(len(p), name, np.int64))
                if keys:
                    yield pd.DataFrame({"cell": np.concatenate(keys).view(np.int64), "class": np.concatenate(names)})

    return docs.select("text").mapInPandas(settled(run), "cell long, class long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar.

    ``classes`` has class, doc_id and content of one document of each. Only texts of documents in a pair are moved.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes.select("class", "doc_id", "content"), "class")
    # a text is found by its id, which may be null or repeated, and its hash
    needed = needed.select("class", "content", F.coalesce("doc_id", F.lit(0)).alias("id_"), F.col("doc_id").isNull().alias("none_"))
    named = docs.select("text", F.xxhash64("text").alias("content"), F.coalesce("doc_id", F.lit(0)).alias("id_"), F.col("doc_id").isNull().alias("none_"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: set[int] = set()  # repeated rows of one id and text come to one task
        for pdf in batches:
            names = iter(pdf["class"])
            for texts in chunks(pdf["text"]):
                rows = []
                for s in sets_of(texts):
                    name = next(names)
                    # a hash of a text may belong to another class
                    if name not in told and set_hash(s) == name:
                        told.add(name)
                        rows.append((name, s.view(np.int64)))
                yield pd.DataFrame(rows, columns=["class", "shingles"])

    sets = named.join(needed, ["content", "id_", "none_"]).select("class", "text").mapInPandas(settled(run), "class long, shingles array<long>")
    sets = materialize(sets, "sets")
    one, two = (sets.select(F.col("class").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b")
    n = F.size(F.array_intersect("sa", "sb"))
    links = materialize(both.where(DENOMINATOR * n >= NUMERATOR * (F.size("sa") + F.size("sb") - n)).select("a", "b").distinct(), "links")
    discard(sets)
    return links


def bounded_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of one cell, of different components, that the count vectors let through.

    ``members`` has cell, class, component, n_shingles, point. A cell of more than CHUNK members is searched chunk against chunk,
    so a group has two chunks at most. Groups are dealt out by their key and met one after the other in the batches of a task.
    """
    sized = members.join(members.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "cell")
    own = sized.withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    key = ["cell", "x", "y"]
    dealt = own.select("*", other).withColumn("x", F.least("chunk", "other")).withColumn("y", F.greatest("chunk", "other")).select(*key, "chunk", "class", "component", "n_shingles", "point")

    def group(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        names, of, n, chunk = (pdf[c].to_numpy() for c in ("class", "component", "n_shingles", "chunk"))
        points = np.frombuffer(b"".join(pdf["point"]), np.uint8).reshape(-1, GROUPS)
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        left = np.flatnonzero(chunk == x)
        i, j = pairs_in(points, n, left, left if x == y else np.flatnonzero(chunk == y))
        keep = (of[i] != of[j]) & ((x != y) | (i < j))
        a, b = names[i[keep]], names[j[keep]]
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            change = np.flatnonzero((pdf[key].to_numpy()[1:] != pdf[key].to_numpy()[:-1]).any(1)) + 1
            cuts = [0, *change]
            found = [group(pdf.iloc[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            rest = pdf.iloc[cuts[-1] :]
            if found:
                yield pd.DataFrame({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])}).drop_duplicates()
        if rest is not None and len(rest):
            a, b = group(rest)
            yield pd.DataFrame({"a": a, "b": b})

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInPandas(settled(run), "a long, b long").distinct()


def one_cell_of_each(crowded: DataFrame) -> DataFrame:
    """(cell, class) of cells of three members or more; of cells with the same members one, as a shared passage makes many of them."""
    larger = crowded.where("members > 2").select("cell", "class")
    told = larger.groupBy("cell").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"))
    return larger.join(told.groupBy("n", "x", "y").agg(F.min("cell").alias("cell")).select("cell"), "cell", "left_semi")


def join(docs: DataFrame) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, which is null where no document of a component has an id."""
    told, sketch = summaries(docs)
    # one row for each class of the corpus; a hot class is summed up before it moves
    classes = materialize(told.where("n_shingles > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("point").alias("point")).select("class", "one.doc_id", "one.content", "n_shingles", "point"), "classes")
    in_cells = cells(docs, sketch)
    shared = in_cells.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1")
    met = materialize(in_cells.join(shared, "cell").select("cell", "class", "members"), "cells")
    release(docs.sparkSession)
    # the class that meets most others stands in the middle of a cell: an original rather than one of its changed copies
    weight = met.groupBy("class").agg(F.sum("members").alias("weight"))
    middle = met.join(weight, "class").groupBy("cell").agg(F.max_by("class", F.struct("weight", "class")).alias("first"))
    crowded = materialize(met.join(middle, "cell"), "cells")
    discard(met)
    release(docs.sparkSession)

    def sizes(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and points leave similarity possible."""
        small = classes.select("class", "n_shingles", "point")
        one, two = (small.toDF(x, f"n{x}", f"p{x}") for x in "ab")
        return pairs.join(one, "a").join(two, "b").where(DENOMINATOR * F.least("na", "nb") >= NUMERATOR * F.greatest("na", "nb"))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pa_, pb = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(-1, GROUPS) for c in ("pa", "pb"))
                yield pdf.loc[most_overlap(pa_, pb) >= least_overlap((pdf["na"] + pdf["nb"]).to_numpy()), ["a", "b"]]

    star = crowded.where("class <> first").select(F.least("first", "class").alias("a"), F.greatest("first", "class").alias("b")).distinct()
    star = materialize(sizes(star).select("a", "b", "na", "nb", "pa", "pb").mapInPandas(settled(bound), "a long, b long"), "pairs")
    links = verified(star, docs, classes)
    joined = components(links)
    # in cells of three or more, those whose members still belong to different components
    release(docs.sparkSession)
    member = one_cell_of_each(crowded).join(joined.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    open_cells = member.groupBy("cell").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("cell")
    member = member.join(open_cells, "cell").join(classes.select("class", "n_shingles", "point"), "class")
    rest = materialize(bounded_pairs(member).join(star, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        more = verified(rest, docs, classes)
        joined = components(links.unionAll(more))
        discard(more)
    discard(rest)
    discard(star)
    discard(crowded)
    discard(links)
    of_class = joined.select(F.col("id").alias("class"), F.col("component"))
    # the smallest document of a component names it
    named = classes.select("class", "doc_id").join(of_class, "class")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    found = materialize(named.join(least, "component").select("class", "least"), "named")
    own = classes.select("class", F.col("doc_id").alias("own"))
    of_all = own.join(found, "class", "left").select("class", F.coalesce("least", "own").alias("component_id"))
    out = told.where("n_shingles > 0").select("doc_id", "n_shingles", "class").join(of_all, "class").select("doc_id", "n_shingles", "component_id")
    return out.unionAll(told.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near duplicates the first row by id stays.

    Rows are told apart by a number of their own, so a row whose id is null or repeated is a document like any other: different
    texts of one id all stay, rows without an id come last in their component, and of equal ids the first row stays. Texts without words stay.
    """
    # written, so that a row has the same number in every scan
    row = free_name(docs, "row_")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = join(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))
    first = found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(place).alias("first"))
    return rows.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)
