"""Token ids of whole texts by a public tokenizer, with repeated words encoded once.

Both tokenizers cut a text into pieces before they merge, and a single space with other characters on both sides is always a
cut. So the ids of a text are the ids of its units between such spaces, and a unit met before needs no second encoding. Texts
where white space meets white space in another way are encoded whole. The ids equal those of the whole text.

Units are found and numbered by Arrow, a batch of texts at a time, and their ids laid out with numpy. An encoder remembers about
``keep`` units, as runs of one array, and beyond that only those met in several batches, so that it stays small in a worker
that lives on after its task.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

_loaded: dict[str, Encoder] = {}
FIRST = "\x00"  # stands before the first unit of a text


def lay_out(data: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of ``data`` (each from ``start``, of ``size``) one after the other, and where each ends."""
    n = size[at]
    ends = np.cumsum(n)
    places = np.arange(ends[-1] if len(ends) else 0)
    places += np.repeat(start[at] - (ends - n), n)
    return data[places], ends


_doubled = re.compile(r"\s\s").search
_white = bytes(32 if chr(b).isspace() and b < 128 else b for b in range(256))
_wide = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80")  # how white space beyond ASCII begins


def white_doubled(text: str) -> bool:
    """Whether white space follows white space, or a text has the sign for a first unit."""
    b = text.encode("utf-8", "replace")
    if not text.isascii() and any(w in b for w in _wide):
        return bool(_doubled(text)) or FIRST in text
    return b"  " in b.translate(_white) or b"\x00" in b


def controls(text: str) -> bool:
    """Whether a text has separators that only Python takes for white space."""
    return any(c in text for c in "\x1c\x1d\x1e\x1f")


class Runs:
    """Runs of ids by key; a run is added once."""

    def __init__(self):
        self.place: dict = {}
        self.data, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def add(self, keys: list, data: np.ndarray, ends: np.ndarray) -> None:
        self.place.update(zip(keys, range(len(self.ends) - 1, len(self.ends) - 1 + len(keys)), strict=True))
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])
        self.data = np.concatenate([self.data, data])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return lay_out(self.data, self.ends[:-1], np.diff(self.ends), at)


class Encoder:
    """Ids of texts; ``keep`` bounds the units that a worker remembers."""

    def __init__(self, name: str, keep: int = 200_000):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.keep, self.units, self.used = keep, Runs(), np.empty(0, np.int32)
        self.spaced = name.startswith("byte_")  # a space belongs to the word after it
        self.apart = white_doubled if self.spaced else controls

        # Bare words need no search for cuts: they are mapped to the vocabulary's byte letters and merged.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in kept]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.merged = self.tokenizer.model.tokenize
        # letters, then signs that neither letter nor digit nor white space follows: two pieces at most
        self.shape = re.compile(r"([^\W\d_]+)([^\w\s'’̀-ͯ]*|[^\w\s'’̀-ͯ]*_+)$").match

    def _bare(self, words: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are letters only, after ``lead``, and where each word's end."""
        merged, letters, ids, ends = self.merged, self.letters, [], []
        for w in words:
            ids += [t.id for t in merged(lead + (w if w.isascii() else w.encode().decode("latin-1").translate(letters)))]
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.array(ends, np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the tokenizer itself."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([len(f) for f in found], dtype=np.int64)
        return np.fromiter((i for f in found for i in f), np.uint32, int(ends[-1]) if found else 0), ends

    def _split(self, word: str) -> tuple[str, str] | None:
        """Letters and the signs after them, of a word that is nothing else."""
        if word.isalpha():
            stem, tail = word, ""
        elif word[:-1].isalpha() and word[-1] in ".,;:!?":
            stem, tail = word[:-1], word[-1]
        elif m := self.shape(word):
            stem, tail = m.groups()
            if not stem.isalpha():
                return None
        else:
            return None
        return (stem, tail) if self.spaced or stem.isascii() or max(stem) < "\u0180" else None

    def learn(self, units: list[str]) -> None:
        """Ids of units not met before. A spaced unit has its space before it unless it is the first or begins with a line break."""
        split, rest, texts = self._split, [], []
        groups = {lead: ([], {}, [], {"": 0}, []) for lead in ("", FIRST, "\n")}
        for u in units:
            named = u if self.spaced else u.lower()
            lead = u[0] if self.spaced and u and u[0] in "\x00\n" else ""
            both = split(named[1:] if lead else named)
            if both:
                names, stems, stem_of, tails, tail_of = groups[lead]
                names.append(u)
                stem_of.append(stems.setdefault(both[0], len(stems)))
                tail_of.append(tails.setdefault(both[1], len(tails)))
            else:
                rest.append(u)
                texts.append(u if lead == "\n" or not self.spaced else u[1:] if lead else " " + u)
        self.units.add(rest, *self._plain(texts))
        for lead, (names, stems, stem_of, tails, tail_of) in groups.items():
            if names:
                runs = Runs()
                runs.add(range(len(tails)), *self._plain(list(tails)))
                runs.add(range(1), *self._plain([lead.strip(FIRST)]))
                runs.add(range(len(stems)), *self._bare(list(stems), "" if lead or not self.spaced else self.letters[32]))
                at = np.empty((len(names), 3), np.int64)
                at[:, 0], at[:, 1], at[:, 2] = len(tails), stem_of, tail_of
                at[:, 1] += len(tails) + 1
                data, ends = runs.take(at.ravel())
                self.units.add(names, data, ends[2::3])

    def _shrink(self) -> None:
        """Of more units than ``keep``, those used in several batches stay."""
        units, used = self.units, self.used
        if len(units.place) > self.keep:
            least = 2
            while (used >= least).sum() > self.keep // 2:
                least += 1
            stay = np.flatnonzero(used >= least)
            names = np.array(list(units.place), object)[stay].tolist()
            self.units = Runs()
            self.units.add(names, *units.take(stay))
            self.used = np.ones(len(stay), np.int32)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end."""
        collects = gc.isenabled()
        gc.disable()  # many short-lived strings and no cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, t in enumerate(texts) if self.apart(t)]
        apart = set(whole)
        plain = [t for i, t in enumerate(texts) if i not in apart] if whole else texts
        cut = [FIRST + t.replace("\n", " \n") for t in plain] if self.spaced else [" ".join(t.split()) for t in plain]
        lists = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
        found = lists.flatten().dictionary_encode()
        if isinstance(found, pa.ChunkedArray):
            found = found.combine_chunks()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._shrink()
        place = self.units.place
        number = np.fromiter(map(place.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            missing = [distinct[i] for i in new.tolist()]
            self.learn(missing)
            number[new] = np.fromiter(map(place.__getitem__, missing), np.int64, len(missing))
        self.used = np.pad(self.used, (0, len(place) - len(self.used)))
        self.used[number] += 1
        ids, ends = self.units.take(number[found.indices.to_numpy(zero_copy_only=False)] if len(found) else np.empty(0, np.int64))
        last = np.diff(lists.offsets.to_numpy()).cumsum() if len(lists) else np.empty(0, np.int64)
        cuts = np.concatenate([[0], ends])[last]
        if not whole:
            return ids, cuts
        # texts encoded whole go to their places
        runs = Runs()
        runs.add(range(len(plain)), ids, cuts)
        runs.add(range(len(plain), len(texts)), *self._plain([texts[i] for i in whole]))
        order, rest = np.empty(len(texts), np.int64), iter(range(len(plain)))
        order[whole] = np.arange(len(plain), len(texts))
        for i in range(len(texts)):
            if i not in apart:
                order[i] = next(rest)
        return runs.take(order)

    def closed(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the id ``end`` after it, and where each text's end."""
        ids, ends = self.encode_flat(texts)
        return np.insert(ids, ends, np.uint32(end)), ends + np.arange(1, len(ends) + 1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_flat(texts)
        data = memoryview(ids.astype("<u4", copy=False).tobytes())
        return [bytes(data[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def encoder(name: str) -> Encoder:
    """The worker's encoder of that vocabulary file, loaded once; another vocabulary takes its place."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Encoder(name)
    return _loaded[name]
