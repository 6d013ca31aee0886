"""Language identification by hierarchical discrimination.

A linear one-versus-rest stage over hashed byte n-grams predicts the language *family*; inside the family, one-versus-one
linear support vector machines separate the closely related languages by pairwise votes. Each machine is fitted by dual
coordinate descent in a Spark task of its own, on at most ``per_language`` documents of each language (the smallest
hashes of the id) and at most ``max_fit`` documents in all, which bounds the fit. Every language that occurs is learned.
Prediction reads every whole text, a very long one in blocks.

Defined results: null text, empty text and text without a letter give ``und`` with score 0; without any learned language, as
for an empty table, everything is ``und``; with one learned language that language is predicted with score 1; ties go to the name that sorts
first. A null or repeated id is a document like any other, but rows without an id aren't learned from. Rows are kept one for one; extra input columns are kept by
``predict`` and by the stage, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, fold, free_name, materialize, read_table, settled, spread

# The family of a language code. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "lb", "nl", "no", "nb", "nn", "sv", "af"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "uralic": ["et", "fi", "hu"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
    "austronesian": ["id", "jv", "ms", "tl"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

LETTER = re.compile(r"[^\W\d_]")
# ASCII other than letters counts as a space; bytes of longer characters stay.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def family(code: str) -> str:
    return FAMILY_OF.get(code.lower().split("-")[0].split("_")[0], f"own:{code}")


BLOCK = 1 << 20  # bytes of a text that are counted at a time


def vector(text: str, bits: int) -> np.ndarray:
    """Square roots of the hashed counts of byte 1- to 4-grams, scaled to length one."""
    b = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    shift, counts = np.uint32(32 - bits), 0
    for begin in range(0, len(b), BLOCK):
        a = np.frombuffer(b[begin : begin + BLOCK + 3], np.uint8).astype(np.uint32)
        n = min(BLOCK, len(b) - begin)  # grams that begin in this block
        grams, codes = a, [a[:n] * np.uint32(2654435769) >> shift]
        for k, m in enumerate(_MULTIPLIERS):
            grams = (grams[:-1] << np.uint32(8)) | a[k + 1 :]
            codes.append(grams[:n] * m >> shift)
        counts = counts + np.bincount(np.concatenate(codes), minlength=1 << bits)
    x = np.sqrt(counts).astype(np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def fit_svm(at: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, size: int, cost: float = 4.0, epochs: int = 15) -> tuple[np.ndarray, float, float]:
    """Squared-hinge linear SVM by dual coordinate descent with classes weighted evenly: weights, bias, and the slope that turns margins into probabilities.

    Row i has the values ``x[i]`` at the places ``at[i]`` of ``size``.
    """
    n = len(y)
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(n)
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    ridge = share / cost
    q, rng = np.array([v @ v + 1 for v in x]) + ridge, np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(n):
            g = y[i] * (w[at[i]] @ x[i] + bias) - 1 + ridge[i] * alpha[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at[i]] += step * x[i]
                bias += step
                alpha[i] = new
    margin = y * np.array([w[a] @ v + bias for a, v in zip(at, x, strict=True)])
    return w, bias, float(3.0 / max(np.median(margin), 0.1))


def fit_models(docs: DataFrame, per_language: int = 600, max_fit: int = 16_384, bits: int = 12) -> list[dict]:
    """Fitted machines of the documents in ``docs`` (text, lang, doc_id), which are the rows to learn from.

    At most ``per_language`` rows of each language are used, fewer where a machine that reads all languages would have more than ``max_fit``.
    """
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    common = sorted(counts)
    if not common:
        return []
    # rows under a hash that twice as many as needed are expected to pass; only these are ranked
    most = [(c, int(min(-(1 << 63) + (1 << 64) * (2 * per_language + 100) / n, (1 << 63) - 1))) for c, n in counts.items()]
    few = named.select("doc_id", "lang").join(F.broadcast(docs.sparkSession.createDataFrame(most, "lang string, most long")), "lang").where(F.xxhash64("doc_id") <= F.col("most"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = few.select("doc_id", "lang").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    # bounded: per_language ids of a language
    sample = named.join(F.broadcast(chosen), ["doc_id", "lang"])
    families = sorted({family(c) for c in common})
    tasks: dict[str, list[str]] = {c: [] for c in common}
    if len(families) > 1:
        for f in families:
            for c in common:
                tasks[c].append(f"F\x1f{f}\x1f")
    for a, b in combinations(common, 2):
        if family(a) == family(b):
            for c in (a, b):
                tasks[c].append(f"L\x1f{a}\x1f{b}")
    if not any(tasks.values()):
        return [{"task": "", "w": None, "b": 0.0, "slope": 1.0, "languages": common}]
    jobs = F.create_map(*[x for c in common for x in (F.lit(c), F.array(*map(F.lit, tasks[c])) if tasks[c] else F.array().cast("array<string>"))])
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("at", T.BinaryType()), T.StructField("x", T.BinaryType())])

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [vector(t, bits) for t in pdf["text"]]
            at = [np.flatnonzero(v).astype(np.int32) for v in found]
            yield pd.DataFrame({"lang": pdf["lang"], "rank": pdf["rank"], "at": [a.tobytes() for a in at], "x": [v[a].tobytes() for v, a in zip(found, at, strict=True)]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        task = pdf["task"].iloc[0]
        what, first, _ = task.split("\x1f")
        pdf = pdf.sort_values(["lang", "x"], kind="stable")
        at, x = [np.frombuffer(a, np.int32) for a in pdf["at"]], [np.frombuffer(v, np.float32).astype(float) for v in pdf["x"]]
        y = np.where([(family(c) if what == "F" else c) == first for c in pdf["lang"]], 1.0, -1.0)
        w, b, slope = fit_svm(at, x, y, 1 << bits)
        return pd.DataFrame({"task": [task], "w": [w.astype(np.float32).tobytes()], "b": [b], "slope": [slope]})

    points = materialize(sample.repartition("doc_id").select("lang", "rank", "text").mapInPandas(settled(vectors), kind), "langid")
    tasked = points.select(F.explode(jobs[F.col("lang")]).alias("task"), "*").where(F.col("task").startswith("L") | (F.col("rank") <= max(1, max_fit // len(common))))
    fitted = tasked.groupBy("task").applyInPandas(fit, "task string, w binary, b double, slope double")
    out = [r.asDict() | {"languages": common} for r in sorted(fitted.collect(), key=lambda r: r["task"])]
    discard(points)
    return out


class Predictor:
    """Family first, then pairwise votes; for arrays of texts."""

    def __init__(self, models: list[dict], bits: int):
        self.bits = bits
        self.languages = models[0]["languages"] if models else []
        self.families = sorted({family(c) for c in self.languages})
        used = [m for m in models if m["w"]]
        self.w = np.stack([np.frombuffer(m["w"], np.float32) for m in used]) if used else None
        self.b, self.slope = np.array([m["b"] for m in used]), np.array([m["slope"] for m in used])
        self.place = {m["task"]: i for i, m in enumerate(used)}
        self.members = {f: [c for c in self.languages if family(c) == f] for f in self.families}

    def one(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0
        if self.w is None:
            return self.languages[0], 1.0
        p = 1 / (1 + np.exp(-np.clip(self.slope * (self.w @ vector(text, self.bits) + self.b), -50, 50)))
        best, share = self.families[0], 1.0
        if len(self.families) > 1:
            chance = np.array([p[self.place[f"F\x1f{f}\x1f"]] for f in self.families])
            best, share = self.families[int(chance.argmax())], float(chance.max() / max(chance.sum(), 1e-12))
        among = self.members[best]
        if len(among) == 1:
            return among[0], share
        votes, belief = dict.fromkeys(among, 0), dict.fromkeys(among, 0.0)
        for a, b in combinations(among, 2):
            x = float(p[self.place[f"L\x1f{a}\x1f{b}"]])
            votes[a if x >= 0.5 else b] += 1
            belief[a] += x
            belief[b] += 1 - x
        winner = max(among, key=lambda c: (votes[c], belief[c]))
        return winner, share * belief[winner] / (len(among) - 1)


def predict(docs: DataFrame, models: list[dict], bits: int = 12, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """All columns of ``docs`` and two of these ``names``, which replace columns called so."""
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        import pyarrow as pa

        predictor = Predictor(shared.value, bits)
        for batch in batches:
            found = [predictor.one(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names, *names])

    return kept.mapInArrow(settled(run), schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    models = fit_models(docs.where(fold(F.col("doc_id")) != 0))
    out = predict(spread(docs.select("doc_id", "text"), "doc_id"), models)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(spark, docs: DataFrame, sf_dir: str, least: float = 0.2) -> DataFrame:
    """Pipeline stage: documents go whose language can't be told (``und``) or has a score under ``least``.

    Null and empty texts go as ``und``; null ids, repeated rows and extra columns stay as they are; an empty table stays empty.
    """
    models = fit_models(docs.where(fold(F.col("doc_id")) != 0))
    names = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    scored = predict(spread(docs, "doc_id"), models, names=names)
    return scored.where((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).select(*docs.columns)
