"""Learned operators against plain walks of what they learned, and every operator on very long texts."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import language_id, quality
from pulsegrid.llm.common import fold
from pulsegrid.llm.queries import QUERIES

SYLLABLES = {"en": "the and ing ion th er on at".split(), "de": "der und sch keit ung ein ver ich".split(), "fr": "les eau oi ment que aux eur ou".split(), "es": "los cion ado mente que ar os ll".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


def test_trees_in_arrays_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    x[::7, 2] = x[0, 2]
    y = (x[:, 0] + rng.normal(size=600) > x[:, 1]).astype(float)
    forest = quality.fit_forest(x, y, np.array([1, -1, 0, 0]), trees=25)
    for row, score in zip(x[:80], forest.score(x[:80]), strict=True):
        odds = forest.base
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            odds += forest.value[node]
        assert abs(score - 1 / (1 + np.exp(-odds))) < 1e-9


def plain_vector(text, bits):
    """Hashed counts of 1- to 4-grams of bytes, gram by gram."""
    b = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(language_id._FOLD).split()) + b" "
    counts = np.zeros(1 << bits)
    for n, multiplier in enumerate([2654435769, *map(int, language_id._MULTIPLIERS)], 1):
        for i in range(len(b)):
            # at the end of a text a gram of several bytes has no room
            if i + n <= len(b):
                counts[(int.from_bytes(b[i : i + n], "big") * multiplier & 0xFFFFFFFF) >> (32 - bits)] += 1
    x = np.sqrt(counts)
    return x / max(np.linalg.norm(x), 1e-9)


def test_language_equals_plain_votes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, prose(rng, lang := list(SYLLABLES)[i % 4], 30), lang) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.fit_models(docs.where(fold(F.col("doc_id")) != 0))
    by_task = {m["task"]: (np.frombuffer(m["w"], np.float32), m["b"], m["slope"]) for m in models if m["w"]}
    languages = models[0]["languages"]

    def chance(task, x):
        w, b, slope = by_task[task]
        return 1 / (1 + np.exp(-np.clip(slope * (float(w @ x) + b), -50, 50)))

    out = language_id.predict(docs, models).collect()
    for r in out[:60]:
        x = plain_vector(r["text"], 12)
        families = sorted({language_id.family(c) for c in languages})
        belief = {f: chance(f"F\x1f{f}\x1f", x) for f in families} if len(families) > 1 else {families[0]: 1.0}
        best = max(families, key=lambda f: belief[f])
        among = [c for c in languages if language_id.family(c) == best]
        votes = {c: [0, 0.0] for c in among}
        for a, b in itertools.combinations(among, 2):
            p = chance(f"L\x1f{a}\x1f{b}", x)
            votes[a if p >= 0.5 else b][0] += 1
            votes[a][1] += p
            votes[b][1] += 1 - p
        winner = max(among, key=lambda c: votes[c])
        score = belief[best] / sum(belief.values()) * (votes[winner][1] / (len(among) - 1) if len(among) > 1 else 1.0)
        assert r["lang_pred"] == winner and abs(r["lang_score"] - score) < 1e-4


@pytest.mark.parametrize("name", ["op1_toxicity", "op4_ngram_join", "op5_token_store", "op6_language_id", "op7_quality", "op8_lm_scoring", "op9_packing", "op10_decontamination", "op11_bpe"])
def test_very_long_texts_are_read_whole(spark, tmp_path_factory, name):
    rng, where = np.random.default_rng(2), tmp_path_factory.mktemp("long")
    rows = [(i, prose(rng, list(SYLLABLES)[i % 4], 60) + (" idiot moron" if i % 5 == 0 else ""), list(SYLLABLES)[i % 4], "s", 1) for i in range(60)]
    item = prose(rng, "en", 20)
    long = prose(rng, "en", 60_000)
    rows += [(100, long, "en", "s", 1), (101, long, "en", "s", 1), (102, "x" * 300_000, "en", "s", 1), (103, long + " " + item, "en", "s", 1), (104, "lo ng " * 50_000, None, "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(where / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(where / "labels.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(where / "benchmark.parquet"))
    out = QUERIES[name](spark, str(where)).toPandas()
    if name == "op10_decontamination":
        assert set(out["doc_id"]) == {103}
        return
    assert set(out["doc_id"]) == {r[0] for r in rows}
    if name == "op4_ngram_join":
        found = dict(zip(out["doc_id"], out["component_id"], strict=True))
        assert found[101] == found[103] == found[100] == 100 and found[102] == 102
    if name in ("op1_toxicity", "op6_language_id"):
        assert out["score"].between(0, 1).all()
    if name == "op7_quality":
        assert dict(zip(out["doc_id"], out["n_words"], strict=True))[100] == 60_000
    if name == "op8_lm_scoring":
        assert dict(zip(out["doc_id"], out["n_tokens"], strict=True))[104] == 100_001 and (out["score"] < 0).all()
    if name == "op9_packing":
        assert out[out["doc_id"] == 100]["piece"].max() > 10
