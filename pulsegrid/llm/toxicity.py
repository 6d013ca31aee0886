"""Toxicity by noisy-channel deobfuscation.

Suspicious spans (letters mixed with look-alike digits and signs, three or more such signs alone, letters repeated three times or
more, letters and look-alikes written one by one) become character lattices; a Viterbi search under a character trigram language
model of the whole corpus picks the restored text; the search is exact. A span without letters stays when a number is likelier. A span without such signs has a lattice of one path, so it is left as it is. The restored text is then
scored: word and word-prefix features are weighted by how they separate labelled documents, the strongest weights of a text
are pooled, and a small logistic regression turns the pools into a probability.

The language model's counts cover all documents. The weights are fitted on at most ``max_labelled`` labelled documents (the
smallest hashes of the id). Null and empty texts are scored as texts without words; without labels of both classes every
score is the share of toxic labels (0 without any). Rows are kept one for one, repeated and null ids and ties included; very long
texts are read whole; an empty table gives an empty result; extra columns are kept. Words cut in two (``id iot``) and two signs written
apart aren't read together, as common words are written so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, discard, fold, free_name, materialize, read_table, release, settled, smallest, spread
from .wordhash import Words

# What a sign may stand for in disguised words.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = " .-_*"
# Signs that end words as punctuation more often than as letters.
CLOSING = "!|+(¡"
# Costs of the channel in nats: a look-alike, a look-alike read as a gap, a dropped letter of a pair, of a longer run, a dropped separator.
SUBSTITUTE, GAP, PAIR, REPEAT, SEPARATE = 0.7, 9.0, 4.0, 0.9, 0.2
# A span without letters may be a number: the costs of a digit (one of ten) and of another sign, which a reading as a word must beat.
FIGURE, SIGN = 2.3, 4.6

# The model's symbols: 0 for anything but a letter, a to z, the letters of Latin-1, and one for all other letters.
SYMBOLS = 61
_symbol = np.zeros(1 << 16, np.int64)
for _c in range(1 << 16):
    _ch = chr(_c)
    _symbol[_c] = _c - 96 if "a" <= _ch <= "z" else 27 + _c - 0xDF if 0xDF <= _c <= 0xFF and _c != 0xF7 else 60 if not 0xD800 <= _c < 0xE000 and _ch.isalpha() else 0


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return _symbol[np.minimum(codes, 0xFFFF)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over all texts; at most SYMBOLS cubed numbers reach the driver."""
    size = SYMBOLS**3

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for pdf in batches:
            for texts in chunks(pdf["text"]):
                s = symbols("  " + "  ".join(texts) + "  ")
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "n": total[at]})

    found = docs.select("text").mapInPandas(settled(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[found["slot"]] = found["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Interpolated trigram log probabilities (Witten-Bell), float32 of SYMBOLS cubed."""
    one = counts.sum((0, 1)) + 1
    p = np.broadcast_to(one / one.sum(), counts.shape)
    for c in (np.broadcast_to(counts.sum(0), counts.shape), counts):
        kinds, total = (c > 0).sum(2, keepdims=True), c.sum(2, keepdims=True)
        p = (c + (kinds + 1) * p) / (total + kinds + 1)
    return np.log(p).astype(np.float32)


class Restorer:
    """Restores suspicious spans of lower-case texts; keeps decoded spans for reuse."""

    def __init__(self, model: np.ndarray, keep: int = 25_000):
        self.model, self.keep, self.known = model.tolist(), keep, {}
        alike = re.escape("".join(LOOK_ALIKES))
        sign = rf"(?:[^\W\d_]|[{alike}])"
        self.mixed = re.compile(rf"(?<![^\W\d_])[^\W\d_]+[{alike}]{sign}*|[{alike}]+(?:[^\W\d_]{sign}*|(?<=[{alike}]{{3}}))")
        self.tripled, self.letters = re.compile(r"([^\W\d_])\1\1+"), re.compile(r"[^\W\d_]*")
        self.spaced = re.compile(rf"(?<![^\W_]){sign}(?:[ .\-_*]{{1,2}}{sign}){{2,}}(?![^\W_])")

    def text(self, text: str) -> str:
        for pattern in (self.spaced, self.mixed):
            text = pattern.sub(lambda m: self.span(m[0]), text)
        return self.repeated(text)

    def repeated(self, text: str) -> str:
        """``text`` with its words restored that have a letter three times in a row: from each such run out to the word's ends, so every sign is seen a few times."""
        out, done, one = [], 0, self.letters.match
        at = self.tripled.search(text)
        while at:
            first = at.start()
            while first > done and one(text, first - 1, first)[0]:
                first -= 1
            end = one(text, at.end()).end()
            out += [text[done:first], self.span(text[first:end])]
            done = end
            at = self.tripled.search(text, end)
        return "".join([*out, text[done:]]) if out else text

    def span(self, span: str) -> str:
        out = self.known.get(span)
        if out is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            out = self.known[span] = self.decode(span)
        return out

    def options(self, span: str) -> list[list[tuple[str, bool, float]]]:
        """For each character of ``span`` what it may stand for: the sign read ("" if it is dropped), whether the model scores it, and the channel's cost."""
        runs = [len(m[0]) for m in re.finditer(r"(.)\1*", span, re.S) for _ in m[0]]
        pure, end = not any(c.isalpha() for c in span), len(span.rstrip(CLOSING))
        word = end < len(span) and span[:end].isalpha()  # a word before punctuation keeps its pairs
        out, last = [], ""
        for at, (c, run) in enumerate(zip(span, runs, strict=True)):
            if c.isalpha():
                own = [(c, True, 0.0)]
                if c == last and (run > 2 or not word):
                    own.append(("", False, REPEAT if run > 2 else PAIR))
            else:
                alike = LOOK_ALIKES.get(c, "")
                own = [(x, True, SUBSTITUTE) for x in alike]
                if c in SEPARATORS:
                    own.append(("", False, SEPARATE))
                if at >= end:
                    own.append((c, False, 0.0))
                elif not (pure and (alike or c in SEPARATORS)):
                    own.append((c, True, GAP if alike else 1.0))
            out.append(own)
            last = c
        return out

    def decode(self, span: str) -> str:
        """The likeliest reading: Viterbi over the last two symbols of the lattice, all states kept."""
        model = self.model
        states = {(0, 0): (0.0, None)}  # score, and the signs read as a chain from the last one
        for own in self.options(span):
            into: dict = {}
            for read, scored, cost in own:
                x = int(_symbol[min(ord(read), 0xFFFF)]) if scored else 0
                for (a, b), (score, said) in states.items():
                    key, total = ((b, x), score + model[a][b][x] - cost) if scored else ((a, b), score - cost)
                    if key not in into or into[key][0] < total:
                        into[key] = (total, (said, read) if read else said)
            states = into
        score, said = max(((score + model[a][b][0], said) for (a, b), (score, said) in states.items()), key=lambda x: x[0])
        end = len(span.rstrip(CLOSING))
        if not any(c.isalpha() for c in span) and score < -sum(FIGURE if c.isdigit() else SIGN for c in span[:end] if c in LOOK_ALIKES):
            return span
        signs = []
        while said:
            said, sign = said
            signs.append(sign)
        return "".join(reversed(signs))


_letter = np.zeros(256, bool)
_letter[list(range(97, 123)) + list(range(128, 256))] = True
_alike = np.zeros(256, bool)
_alike[[ord(c) for c in LOOK_ALIKES if ord(c) < 128]] = True


def suspicious(lower: bytes, starts: np.ndarray) -> np.ndarray:
    """Numbers of the texts (joined, beginning at ``starts``) that may hold a span to restore, but for signs written one by one."""
    a = np.frombuffer(lower, np.uint8)
    letter = _letter[a]
    hit = np.zeros(len(a), bool)
    # a look-alike before or after a letter, one beyond ASCII, or three look-alikes
    alike = _alike[a]
    hit[1:] = (alike[:-1] | (a[:-1] == 0xC2)) & letter[1:] | letter[:-1] & alike[1:]
    hit[2:] |= (a[:-2] == 0xE2) & (a[1:-1] == 0x82) & (a[2:] == 0xAC) | alike[2:] & alike[1:-1] & alike[:-2]
    same = (a[1:] == a[:-1]) & letter[1:]
    hit[2:] |= same[1:] & same[:-1]
    # the same two-byte letter three times
    hit[5:] |= (a[5:] == a[3:-2]) & (a[5:] == a[1:-4]) & (a[4:-1] == a[2:-3]) & (a[4:-1] == a[:-5]) & (a[5:] >= 128)
    return np.unique(np.searchsorted(starts, np.flatnonzero(hit), "right") - 1)


def restored(texts: list[str], restorer: Restorer) -> list[bytes]:
    """Lower-case texts with their disguises undone, as UTF-8."""
    lower = [t.lower() for t in texts]
    out = [t.encode("utf-8", "replace") for t in lower]
    starts = np.cumsum([0] + [len(t) + 1 for t in out])
    found = set(suspicious(b"\n".join(out) + b"\n", starts).tolist())
    for i in range(len(out)):
        if i in found or restorer.spaced.search(lower[i]):
            out[i] = restorer.text(lower[i]).encode("utf-8", "replace")
    return out


PREFIXES = (3, 4, 5, 6, 8)
# Punctuation counts as white space, so that a word is the same before a full stop.
_punctuation = bytes(32 if 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 else b for b in range(256))


def feature_slots(texts: list[bytes], bits: int) -> list[np.ndarray]:
    """For each text the distinct slots of its words and their prefixes."""
    words = Words([t.translate(_punctuation) for t in texts])
    shift = np.uint64(64 - bits)
    slot, of = [(words.hashes() >> shift).astype(np.int64)], [np.arange(len(words.start))]
    for k in PREFIXES:
        at, h = words.prefixes(k)
        slot.append(((h * np.uint64(2 * k + 1)) >> shift).astype(np.int64))
        of.append(at)
    slot, of = np.concatenate(slot), np.concatenate(of)
    doc = np.searchsorted(words.first, of, "right") - 1
    both = np.unique((doc << bits) | slot)
    cut = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.int64) << bits)
    both &= (1 << bits) - 1
    return [both[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


POOLS = (1, 3, 8)


def pools(weights: np.ndarray) -> list[float]:
    """Means of the largest weights of a text."""
    w = -np.sort(-np.maximum(weights, 0)) if len(weights) < 64 else -np.sort(np.partition(-np.maximum(weights, 0), 16)[:16])
    return [float(w[:k].sum() / k) for k in POOLS]


class Weights:
    """Log odds of a feature in toxic against other documents, from the numbers of documents that have it."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int):
        self.toxic, self.clean, self.n = toxic, clean, (n_toxic, n_clean)
        self.all = self.of(toxic, clean)

    def of(self, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
        prior = self.n[0] / max(sum(self.n), 1)
        return np.log((toxic + 4 * prior) / (clean + 4 * (1 - prior))).astype(np.float32) - np.float32(np.log(prior / (1 - prior)))

    def without(self, slots: np.ndarray, label: int) -> np.ndarray:
        """The weights as if a document that has ``slots`` hadn't been counted."""
        return self.of(self.toxic[slots] - label, self.clean[slots] - (1 - label))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the bias."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x1.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + penalty, x1.T @ (y - p) - penalty @ w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 16_384, bits: int = 20) -> dict:
    """The model: language model of all ``docs``, weights and pool coefficients from ``labels`` (doc_id, toxic 0 or 1)."""
    spark = docs.sparkSession
    model = log_model(trigram_counts(docs))
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = smallest(known, max_labelled, "doc_id", "toxic")
    # bounded: max_labelled ids
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition("doc_id").select("text", "toxic"), "toxic")
    shared = spark.sparkContext.broadcast(model)
    size = 1 << bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, n, docs_of = Restorer(shared.value), np.zeros((2, size), np.int32), [0, 0]
        for pdf in batches:
            label = iter(pdf["toxic"])
            for texts in chunks(pdf["text"]):
                for slots in feature_slots(restored(texts, restorer), bits):
                    y = next(label)
                    n[y, slots] += 1
                    docs_of[y] += 1
        at = np.flatnonzero(n.any(0))
        yield pd.DataFrame({"slot": [-1, *at], "clean": [docs_of[0], *n[0, at]], "toxic": [docs_of[1], *n[1, at]]})

    # a feature of fewer than three documents says nothing, so it stays behind
    found = sample.mapInPandas(settled(count), "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where((F.col("slot") < 0) | (F.col("clean") + F.col("toxic") >= 3)).toPandas()
    toxic, clean = np.zeros(size, np.int32), np.zeros(size, np.int32)
    total, rest = found[found["slot"] < 0], found[found["slot"] >= 0]
    n_toxic, n_clean = int(total["toxic"].sum()), int(total["clean"].sum())
    toxic[rest["slot"]], clean[rest["slot"]] = rest["toxic"], rest["clean"]
    if not n_toxic or not n_clean:
        return {"model": model, "share": n_toxic / max(n_toxic + n_clean, 1), "weights": None}
    tables = spark.sparkContext.broadcast((toxic, clean, n_toxic, n_clean))

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, weights = Restorer(shared.value), Weights(*tables.value)
        for pdf in batches:
            rows, label = [], iter(pdf["toxic"])
            for texts in chunks(pdf["text"]):
                for slots in feature_slots(restored(texts, restorer), bits):
                    y = next(label)
                    seen = slots[weights.toxic[slots] + weights.clean[slots] >= 3]
                    rows.append([y, *pools(weights.without(seen, y))])
            yield pd.DataFrame(rows, columns=["toxic", *(f"p{k}" for k in POOLS)])

    pooled = sample.mapInPandas(settled(pool), "toxic int, " + ", ".join(f"p{k} double" for k in POOLS)).toPandas()
    discard(sample)
    release(spark)
    pooled = pooled.sort_values(list(pooled.columns), kind="stable")
    coefficients = logistic(pooled[[f"p{k}" for k in POOLS]].to_numpy(), pooled["toxic"].to_numpy(float))
    w = Weights(toxic, clean, n_toxic, n_clean).all
    w[toxic + clean < 3] = 0
    return {"model": model, "share": n_toxic / (n_toxic + n_clean), "weights": w.astype(np.float32), "coefficients": coefficients, "bits": bits}


def score(docs: DataFrame, model: dict, name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) as ``name``, which replaces a column called so."""
    kept = docs.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        restorer = Restorer(m["model"])
        for batch in batches:
            texts, out = batch.column(batch.schema.get_field_index("text")).to_pylist(), []
            for part in chunks(texts):
                if m["weights"] is None:
                    out += [m["share"]] * len(part)
                    continue
                x = np.array([pools(m["weights"][slots]) for slots in feature_slots(restored(part, restorer), m["bits"])])
                c = m["coefficients"]
                out += (1 / (1 + np.exp(-np.clip(x @ c[:-1] + c[-1], -40, 40)))).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return kept.mapInArrow(settled(run), schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != 0)
    out = score(spread(docs, "doc_id"), fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents go whose score is 0.5 or more.

    Null and empty texts are scored as texts without words; null ids, repeated rows and extra columns stay as they are; an empty table stays empty.
    """
    labels = read_table(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != 0)
    name = free_name(docs, "toxicity")
    return score(spread(docs, "doc_id"), fit(docs, labels), name).where(F.col(name) < 0.5).select(*docs.columns)
