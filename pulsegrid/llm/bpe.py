"""Byte pair encoding by segment trees over the ranks of adjacent pairs, and decoding.

A word's symbols stand in places; the leaf of a place holds (rank, place) of the pair that begins there, a node the smaller of
its two children. So the root is the leftmost pair of lowest rank. A merge writes the new symbol at the pair's first place,
drops the second one, and updates three leaves with the nodes above them: logarithmic in the word's length. It ends when the
root holds no pair. Words of one tree size go together, a merge of each at a time, in numpy; few words of a size, such as one of
a million letters, go one by one.

Special tokens are cut out first, then the vocabulary's own rules of normalising and of cutting into words apply. No rule reaches
over a space, so what stands between spaces is encoded once and remembered in the worker, about ``KEEP`` of them.

Null and empty texts, and those of white space alone, have no ids and decode to an empty text. A repeated row has its own result,
an empty table gives an empty one, very long texts are read whole, and other columns stay, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import free_name, read_table, settled, spread
from .tokens import lay_out

VOCABULARY = "word_bpe_49k.json"
NONE = np.iinfo(np.int64).max  # the key of no pair
PLACE = (1 << 32) - 1  # a key is the rank, then the place in 32 bits
FEW = 12  # words of one tree size that go one by one
ENDS = tuple(".,;:!?")
KEEP = 200_000  # units, and words, that a worker remembers

_loaded: dict[str, Merges] = {}


class Memory:
    """What was found for keys; of more than ``keep`` those asked for since the last turnover stay."""

    def __init__(self, keep: int):
        self.keep, self.young, self.old = keep, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that nothing is known of; the others are at hand now."""
        young, old = self.young, self.old
        lacking = [k for k in keys if k not in young]
        if old:
            again = [k for k in lacking if k in old]
            young.update(zip(again, map(old.__getitem__, again), strict=True))
            lacking = [k for k in lacking if k not in old] if again else lacking
        return lacking

    def turn(self) -> None:
        if len(self.young) > self.keep // 2:
            self.young, self.old = {}, self.young


class Merges:
    """A vocabulary's symbols and merges, and the trees that apply them."""

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            rules = json.load(f)
        library = Tokenizer.from_file(public_tokenizers.path(name))
        self.normal, self.words = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        vocabulary, suffix = rules["model"]["vocab"], rules["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.tokens = [""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for token, i in (vocabulary | self.special).items():
            self.tokens[i] = token
        # the vocabulary's letters for bytes: printable ones stand for themselves, the others follow from 256 on
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}
        self.byte = {ord(c): b for b, c in letters.items()}
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)])
        self.last = np.array([vocabulary[letters[b] + suffix] for b in range(256)])
        pairs = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in rules["model"]["merges"]]
        self.of = {(a, b): (rank, new) for rank, (a, b, new) in enumerate(pairs)}
        codes = np.array([a << 32 | b for a, b, _ in pairs], np.int64)
        self.ranks = np.argsort(codes)
        self.codes, self.made = codes[self.ranks], np.array([new for _, _, new in pairs])
        # the vocabulary's rule for words, on letters that normalising only makes small
        self.plain = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x09-\x0D \x85\xA0\p{L}\p{N}]+").findall
        self.known, self.merged = Memory(KEEP), Memory(KEEP)

    def keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The keys of pairs at their places; -1 stands for no symbol."""
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((right >= 0) & (left >= 0) & (self.codes[at] == code), self.ranks[at] << 32 | place, NONE)

    def merge_one(self, symbols: list[int]) -> list[int]:
        """One word's merges."""
        n, of = len(symbols), self.of
        size = 1 << max(n - 2, 0).bit_length()
        symbols, after, before = [*symbols, -1], [*range(1, n + 1), n], [*range(-1, n)]
        tree = [NONE] * (2 * size)
        for p in range(n - 1):
            found = of.get((symbols[p], symbols[p + 1]))
            if found:
                tree[size + p] = found[0] << 32 | p
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(p: int, key: int) -> None:
            i = size + p
            tree[i] = key
            while i > 1:
                other = tree[i ^ 1]
                i >>= 1
                least = key if key < other else other
                if tree[i] == least:
                    break
                tree[i] = key = least

        while tree[1] != NONE:
            p = tree[1] & PLACE
            q = after[p]
            symbols[p] = of[symbols[p], symbols[q]][1]
            symbols[q] = -1
            after[p] = r = after[q]
            before[r] = p
            if q < n - 1:
                put(q, NONE)
            found = of.get((symbols[p], symbols[r])) if r < n else None
            put(p, found[0] << 32 | p if found else NONE)
            o = before[p]
            if o >= 0:
                found = of.get((symbols[o], symbols[p]))
                put(o, found[0] << 32 | o if found else NONE)
        return [s for s in symbols if s >= 0]

    def merge_many(self, begun: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The merges of words of at most ``size`` pairs, a merge of each word at a time: ids of all, and how many each word has.

        ``begun`` has the words' first symbols one after the other. A word has a place more on either side, where nothing stands.
        """
        k, wide = len(lengths), size + 3
        symbols = np.full((k, wide), -1)
        symbols[:, 1:-1][np.arange(size + 1) < lengths[:, None]] = begun
        tree = np.full((k, 2 * size), NONE)
        tree[:, size:] = self.keys(symbols[:, 1 : size + 1], symbols[:, 2 : size + 2], np.arange(1, size + 1))
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] != NONE)
        after = np.tile(np.minimum(np.arange(1, wide + 1), wide - 1), k)
        before = np.tile(np.maximum(np.arange(-1, wide - 1), 0), k)
        symbols, tree = symbols.ravel(), tree.ravel()
        while len(row):
            base, top = row * wide, row * (2 * size)
            root = tree[top + 1]
            p = root & PLACE
            q = after[base + p]
            r, o = after[base + q], before[base + p]
            new = self.made[root >> 32]
            symbols[base + p], symbols[base + q] = new, -1
            after[base + p], before[base + r] = r, p
            own, left = self.keys(new, symbols[base + r], p), self.keys(symbols[base + o], new, o)
            # no pair begins at a word's last place or before its first: then the leaf of the new symbol is written twice
            inside, first = q <= size, o == 0
            at = size - 1 + np.concatenate([np.where(inside, q, p), p, np.where(first, p, o)])
            top = np.concatenate([top, top, top])
            tree[top + at] = np.concatenate([np.where(inside, NONE, own), own, np.where(first, own, left)])
            for _ in range(size.bit_length() - 1):
                at >>= 1
                below = top + 2 * at
                tree[top + at] = np.minimum(tree[below], tree[below + 1])
            row = row[tree[row * (2 * size) + 1] != NONE]
        left = symbols >= 0
        return symbols[left], left.reshape(k, wide).sum(1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, which has a letter at least, as little-endian 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        letters = np.frombuffer(b"".join(words), np.uint8)
        begun = self.inner[letters]
        begun[ends - 1] = self.last[letters[ends - 1]]
        # no pair is size 1 as well: the tree of one leaf is empty then
        sizes = 1 << np.ceil(np.log2(np.maximum(lengths - 1, 1))).astype(np.int64)
        out: list[bytes] = [b""] * len(words)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            step = max(1, (1 << 20) // size)
            for a in range(0, len(at), step):
                part = at[a : a + step]
                if len(part) > FEW:
                    runs, _ = lay_out(begun, ends - lengths, lengths, part)
                    ids, n = self.merge_many(runs, lengths[part], size)
                    data, cuts = ids.astype("<i4").tobytes(), np.cumsum(4 * n).tolist()
                    for i, x, y in zip(part.tolist(), [0, *cuts], cuts, strict=False):
                        out[i] = data[x:y]
                else:
                    for i in part.tolist():
                        out[i] = np.array(self.merge_one(begun[ends[i] - lengths[i] : ends[i]].tolist()), "<i4").tobytes()
        return out

    def pieces(self, unit: str) -> list:
        """A unit's words as bytes; special tokens as their ids' bytes in a tuple."""
        if unit.isascii() or max(unit) < "\u0180":
            low = unit.lower()
            if low.isalpha():
                return [low.encode()]
            if low[-1:] in ENDS and low[:-1].isalpha():
                return [low[:-1].encode(), low[-1:].encode()]
            if "<|" not in low:
                return [w.encode() for w in self.plain(low)]
        out: list = []
        for piece in self.specials(unit):
            if piece in self.special:
                out.append((self.special[piece].to_bytes(4, "little"),))
            elif piece:
                out += [bytes(map(self.byte.__getitem__, map(ord, w))) for w, _ in self.words(self.normal(piece))]
        return out

    def learn(self, units: list[str]) -> None:
        """Remember the ids of units that weren't met before."""
        laid = list(map(self.pieces, units))
        new = self.merged.missing({w for ws in laid for w in ws if type(w) is bytes})
        self.merged.young.update(zip(new, self.merge(new) if new else (), strict=True))
        word, unit_ids = self.merged.young, self.known.young
        for unit, ws in zip(units, laid, strict=True):
            unit_ids[unit] = word[ws[0]] if len(ws) == 1 and type(ws[0]) is bytes else b"".join([word[w] if type(w) is bytes else w[0] for w in ws])
        self.merged.turn()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        units = [t.split(" ") for t in texts]
        self.known.turn()
        missing = self.known.missing({u for us in units for u in us})
        if missing:
            self.learn(missing)
        ids = self.known.young.__getitem__
        return [b"".join(map(ids, us)) for us in units]


def merges(name: str) -> Merges:
    """The worker's merges of that vocabulary file, loaded once."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Merges(name)
    return _loaded[name]


def _in_parts(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes or items in ``column``."""
    values = batch.column(column)
    lengths = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    sizes = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + limit)))
        yield batch.slice(a, b - a)
        a = b


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY, keep_text: bool = True) -> DataFrame:
    """``df`` with the ids of ``text`` as an array of integers; without ``text`` itself if it isn't kept."""
    ids = free_name(df, ids)
    stay = [c for c in df.columns if keep_text or c != text]
    schema = T.StructType([*(df.schema[c] for c in stay), T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = merges(vocabulary).encode
        for whole in batches:
            for batch in _in_parts(whole, text, 1 << 22):
                found = of([t or "" for t in batch.column(text).to_pylist()])
                ends = np.cumsum([0, *(len(f) >> 2 for f in found)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in stay), lists], [*stay, ids])

    return df.mapInArrow(settled(run), schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the text of ``ids`` in their place: the tokens joined by a space, as this vocabulary names no decoder; special ones stay."""
    text = free_name(df, text)
    stay = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = merges(vocabulary).tokens.__getitem__
        for whole in batches:
            for batch in _in_parts(whole, ids, 1 << 20):
                lists = batch.column(ids)
                flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
                ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
                texts = pa.array([" ".join(map(token, flat[a:b])) for a, b in zip([0, *ends], ends, strict=False)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in stay), texts], [*stay, text])

    return df.mapInArrow(settled(run), schema)


def op11_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, told by their digests."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    both = decode(encode(docs, keep_text=False))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"),
    )
