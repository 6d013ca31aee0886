"""Byte pair encoding by segment trees against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import bpe

ODD = [
    "", None, " ", "\n\t ", "a", "<|endoftext|>x <|startoftext|><|endoftext|>", "<|EndOfText|>", "É é é ́ x ̈y", "\x00 a\x00b", "İstanbul ΣΑΣ ς", "don't we'll I'M 's",
    "a　b\x85c\x1cd \xa0 a\xa0b ²³¼½ ªº µ", "x" * 3000, "ab" * 5000, "日本語テキスト", "👩‍👩‍👧 🇫🇷", "﻿a​b", "ﬁ ﬀ Å", "1234567", "!!!???...", "a b " * 10, "The cat. The cat, the CAT!",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def drawn(seed, n):
    rng = random.Random(seed)
    spans = [(0, 127), (128, 384), (0x300, 0x370), (0x3040, 0x30FF), (0x2000, 0x2070), (0x1F300, 0x1F600)]
    letters = [chr(rng.randrange(*rng.choice(spans))) for _ in range(300)] + [" "] * 60 + list("\n\t\r\x0b\x0c")
    return ["".join(rng.choices(letters, k=rng.randrange(1, 80))) for _ in range(n)]


def test_ids_equal_those_of_the_library(library):
    own, texts = bpe.Merges(bpe.VOCABULARY), [t or "" for t in ODD] + drawn(1, 3000)
    for found, text in zip(own.encode(texts), texts, strict=True):
        assert np.frombuffer(found, "<i4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_words_merge_alike_one_by_one_and_together():
    own, rng = bpe.Merges(bpe.VOCABULARY), random.Random(2)
    words = ["".join(rng.choices("abcdefgthin", k=rng.randrange(1, 40))).encode() for _ in range(600)]
    assert own.merge(words) == [own.merge([w])[0] for w in words]


def test_merges_are_those_of_a_plain_search():
    own = bpe.Merges(bpe.VOCABULARY)
    for word in (b"internationalisation", b"aaaaaaaaaaaaaaa", b"thinthinthin", b"q"):
        s = [*own.inner[list(word[:-1])].tolist(), int(own.last[word[-1]])]
        while True:
            pairs = [(own.of[a, b][0], i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if (a, b) in own.of]
            if not pairs:
                break
            i = min(pairs)[1]
            s[i : i + 2] = [own.of[s[i], s[i + 1]][1]]
        assert np.frombuffer(own.merge([word])[0], "<i4").tolist() == s


def test_forgotten_units_are_learnt_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 50)
    own = bpe.Merges(bpe.VOCABULARY)
    for text in drawn(3, 300):
        assert np.frombuffer(own.encode([text])[0], "<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_long_word_takes_linear_memory_and_little_time(library):
    text = "".join(random.Random(4).choices("abcdefgh", k=100_000))
    assert np.frombuffer(bpe.Merges(bpe.VOCABULARY).encode([text])[0], "<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_keeps_rows_and_columns(spark, library):
    rows = [(i, t, "mine", i * 2) for i, t in enumerate(ODD)] + [(None, "null id", None, 1), (3, "again", "x", 5), (3, "again", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids int").repartition(3)
    both = bpe.decode(bpe.encode(df), ids="ids_")
    assert both.columns == ["doc_id", "text", "decoded", "ids", "ids_", "decoded_"]
    out = both.collect()
    assert sorted(map(str, ((r[0], r[1], r[2], r[3]) for r in out))) == sorted(map(str, rows))
    for r in out:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids_"] == ids and r["decoded_"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(df.limit(0)), ids="ids_").count() == 0


def test_query_over_all_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = bpe.op11_bpe(spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in out:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert tuple(r) == (r["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
