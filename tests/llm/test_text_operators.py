"""The text operators on small tables: defined results for odd rows, and brute-force versions."""

import itertools
import re
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import components, decontaminate, html_text, language_id, licenses, lm_scoring, ngram_join, packing, quality, token_store, tokens, toxicity
from pulsegrid.llm.common import fold, materialize
from pulsegrid.llm.wordhash import Words, windows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, class string"
WORD = re.compile("[^\x20\x09-\x0d]+")
SYLLABLES = {"en": "the and ing ion th er on at".split(), "de": "der und sch keit ung ein ver ich".split(), "fr": "les eau oi ment que aux eur ou".split(), "es": "los cion ado mente que ar os ll".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


ODD = ["", None, " \n\t ", "7 + 7 = 14", "é", "a", "x " * 3000, "word" * 4000, "<|endoftext|> \x00 ​﻿", "I I I I I", "line\nline\nline\nline"]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(0)
    rows = [(i, prose(rng, lang := list(SYLLABLES)[i % 4], int(rng.integers(20, 90))), lang) for i in range(160)]
    rows += [(160 + k, t, [None, "en"][k % 2]) for k, t in enumerate(ODD)]
    rows += [(300, rows[3][1], "es"), (300, rows[3][1], "es"), (None, rows[4][1], None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, lang, "s", 1, 0.5, "c") for i, t, lang in texts], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# ---- hashes


def test_words_are_those_of_the_pattern():
    data = ["a  bb\tccc\n", "", "\x1c x y \x85", "ß é"]
    w = Words([d.encode() for d in data])
    for i, d in enumerate(data):
        a, b = w.first[i], w.first[i + 1]
        assert [bytes(w.bytes[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] == WORD.findall(d)
    h = Words([b"ab ab b ba"]).hashes()
    assert h[0] == h[1] and len(set(h.tolist())) == 3 and len(windows(h, 5)) == 0


# ---- language ID


def test_language_id(spark, docs, empty, texts):
    models = language_id.fit_models(docs.where(fold(F.col("doc_id")) != 0))
    out = language_id.predict(docs, models).select("doc_id", "text", "lang_pred", "lang_score").collect()
    assert len(out) == len(texts)
    truth = {i: lang for i, _, lang in texts[:160]}
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in out if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean(right) > 0.9
    for r in out:
        if not r["text"] or not re.search(r"[^\W\d_]", r["text"]):
            assert (r["lang_pred"], r["lang_score"]) == ("und", 0.0)
        assert 0 <= r["lang_score"] <= 1
    assert language_id.predict(docs, language_id.fit_models(empty)).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(empty, models).count() == 0
    one = language_id.fit_models(docs.where("lang = 'en'"))
    assert {r["lang_pred"] for r in language_id.predict(docs, one).collect()} == {"en", "und"}


# ---- toxicity


@pytest.fixture(scope="module")
def toxic(spark):
    rng, rows = np.random.default_rng(1), []
    for i in range(300):
        words = prose(rng, "en", 40).split()
        bad = i % 4 == 0
        for w in ("idiot", "moron", "clown") if bad else ():
            words.insert(int(rng.integers(len(words))), w)
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df, toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("doc_id < 240"))


def test_toxicity_separates_and_undoes_disguise(spark, toxic, docs, texts, empty):
    df, model = toxic
    out = toxicity.score(df, model).where("doc_id >= 240").collect()
    assert np.mean([(r["toxicity"] >= 0.5) == bool(r["toxic"]) for r in out]) > 0.95
    restorer = toxicity.Restorer(model["model"])
    for said, meant in (("1d1ot", "idiot"), ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("cl0wn", "clown"), ("idiooooot", "idiot")):
        assert restorer.text(said) == meant
    assert toxicity.restored(["The thing, in 1999 & more"], restorer) == [b"the thing, in 1999 & more"]
    assert toxicity.restored(["an 1d1ot", "and a m0r0n."], restorer) == [b"an idiot", b"and a moron."]
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(texts) and all(0 <= r["toxicity"] <= 1 for r in scored)
    assert toxicity.score(empty, model).count() == 0
    blank = toxicity.fit(empty.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["toxicity"] for r in toxicity.score(docs, blank).collect()} == {0.0}


def test_disguises_at_the_end_alone_and_spaced(spark):
    said = "you are an idiot. morons and stupid clowns. the ass, a moron; all sit at a lot of tables with ease. " * 20
    restorer = toxicity.Restorer(toxicity.log_model(toxicity.trigram_counts(spark.createDataFrame([(said,)], "text string"))))
    pairs = [("idio7", "idiot"), ("moron5", "morons"), ("a55", "ass"), ("@55", "ass"), ("@$$", "ass"), ("m 0 r 0 n", "moron"), ("i.d.1.0.t", "idiot"), ("s-t-u-p-1-d", "stupid"), ("a s s", "ass"), ("@ $ $", "ass"), ("5_7_u_p_1_d", "stupid"), ("an idio7!", "an idiot!"), ("moron€", "morone")]
    assert [restorer.text(a) for a, _ in pairs] == [b for _, b in pairs]
    assert toxicity.restored([f"you {a}, the" for a, _ in pairs], restorer) == [f"you {b}, the".encode() for _, b in pairs]
    plain = ["in 1999, for $100 or 250€", "1.2.3 and 1 3 5!!!", "an idiot!", "clowns!!", "shopp!", "so! (a) + b"]
    assert toxicity.restored(plain, restorer) == [t.encode() for t in plain]


def readings(restorer, span):
    """(score, text) of every path through the lattice of ``span``."""
    for path in itertools.product(*restorer.options(span)):
        a = b = 0
        score = 0.0
        for read, scored, cost in path:
            score -= cost
            if scored:
                x = int(toxicity._symbol[min(ord(read), 0xFFFF)])
                score += restorer.model[a][b][x]
                a, b = b, x
        yield score + restorer.model[a][b][0], "".join(read for read, _, _ in path)


@pytest.mark.parametrize("text", ["x1 " + "ab" * 50_000, "ab" * 50_000, "a1" * 50_000, "a " * 50_000, "a" * 100_000, " abcaaab" * 12_000, "1" * 100_000])
def test_long_runs_take_linear_time(text):
    model = toxicity.log_model(np.random.default_rng(0).integers(0, 50, (toxicity.SYMBOLS,) * 3).astype(float))
    began = time.perf_counter()
    assert len(toxicity.restored([text], toxicity.Restorer(model))) == 1
    assert time.perf_counter() - began < 10


def test_words_with_a_letter_three_times_are_restored_whole():
    own = toxicity.Restorer(np.zeros((toxicity.SYMBOLS,) * 3))
    own.span = lambda s: f"<{s}>"
    rng, pattern = np.random.default_rng(3), re.compile(r"[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*")
    for _ in range(3000):
        text = "".join(rng.choice(list("aab1_ é²"), rng.integers(0, 25)))
        assert own.repeated(text) == pattern.sub(lambda m: f"<{m[0]}>", text)


def test_decoding_is_the_best_of_all_readings(spark, docs):
    restorer = toxicity.Restorer(toxicity.log_model(toxicity.trigram_counts(docs)))
    rng, signs = np.random.default_rng(12), [*"thein0134$!| .aab"]
    for _ in range(100):
        span = "h" + "".join(rng.choice(signs, rng.integers(2, 8)))
        every = list(readings(restorer, span))
        got = max(score for score, said in every if said == restorer.decode(span))
        assert abs(got - max(every)[0]) < 1e-4, span


# ---- n-gram join


def plain_sets(texts):
    out = {}
    for i, t in texts:
        w = WORD.findall(lower(t))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def plain_components(sets):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_ngram_join_equals_all_pairs(spark, empty):
    rng, rows = np.random.default_rng(2), []
    passage = prose(rng, "en", 60).split()
    for g in range(25):
        base = prose(rng, "en", int(rng.integers(3, 150))).split()
        if g % 3 == 0:
            base[1:1] = passage
        for c in range(int(rng.integers(1, 9))):
            words = list(base)
            for _ in range(int(rng.integers(0, 1 + len(words) // 25 + 1)) if c else 0):
                words[int(rng.integers(len(words)))] = "changed" + str(rng.integers(100))
            rows.append(" ".join(words).upper() if c % 4 == 3 else "  ".join(words))
    rows += [t for t in ODD] + ["two words", "Two  Words", "two words more"]
    table = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, "x") for i, t in table], "doc_id long, text string, class string").repartition(5)
    sets = plain_sets(table)
    want = plain_components(sets)
    got = ngram_join.join(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert ngram_join.join(empty).count() == 0


def test_tree_search_loses_nothing():
    rng = np.random.default_rng(3)
    points = rng.poisson(1.5, (300, ngram_join.GROUPS)).astype(np.uint8)
    points[100:150] = np.maximum(points[100], 1)
    points[7, 3] = points[9, 3] = 255
    sizes = points.sum(1, dtype=np.int64)
    tree = ngram_join.RTree(points, sizes)
    for i in (0, 7, 100, 149, 299):
        want = np.flatnonzero(ngram_join.most_overlap(points, points[i]) >= ngram_join.least_overlap(sizes + sizes[i]))
        assert sorted(tree.search(points[i], sizes[i])) == want.tolist()
    every = np.arange(300)
    a, b = ngram_join.pairs_in(points, sizes, every, every)
    c, d = ngram_join.pairs_in(points[:40], sizes[:40], every[:40], every[:40])
    assert {(x, y) for x, y in zip(a, b, strict=True) if x < 40 and y < 40} == set(zip(c, d, strict=True))


def test_large_cells_are_searched_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.poisson(0.16, ngram_join.GROUPS)
    rows = [(i, int(rng.integers(1 << 40)), int(i % 7), 40, bytes((base + (rng.uniform(size=base.size) < 0.03)).astype(np.uint8))) for i in range(90)]
    df = spark.createDataFrame([(1, c, k, n, bytearray(p)) for _, c, k, n, p in rows], "cell long, class long, component long, n_shingles long, point binary")
    whole = {tuple(r) for r in ngram_join.bounded_pairs(df).collect()}
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    assert {tuple(r) for r in ngram_join.bounded_pairs(df).collect()} == whole and whole


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)} | {300: 300, 301: 300}


def test_one_document_of_each_component(spark):
    df = spark.createDataFrame([(5, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "y"), (9, "", "z"), (8, None, "z")], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(spark, df, "").collect()) == [2, 8, 9]


def test_rows_without_an_id_or_of_a_repeated_id_are_documents(spark):
    near, other = "a b c d e f", "p q r s t u v w"
    df = spark.createDataFrame([(None, "one two three four five six"), (None, near), (None, None), (7, near), (7, other), (3, near), (None, "x y z x y z z"), (None, "x y z x y z z")], "doc_id long, text string")
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in ngram_join.one_of_each(spark, df, "").collect())
    assert kept == [(-1, ""), (-1, "one two three four five six"), (-1, "x y z x y z z"), (3, near), (7, other)]


def test_join_links_rows_without_an_id(spark):
    base = [f"w{k}" for k in range(60)]
    near = [" ".join(base[:30] + [x] + base[31:]) for x in ("a", "b", "c")]
    rows = [(None, near[0]), (None, near[0]), (9, near[1]), (None, near[2]), (None, "alone and by itself here"), (4, "q"), (4, "r")]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 9), (-1, 9), (-1, 9), (4, 4), (4, 4), (9, 9)]


def test_join_finds_every_link_of_the_given_documents(spark):
    """Recall against all pairs, counted in DuckDB over shared shingles of the small tables."""
    import duckdb

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sets = plain_sets(table)
    names = {x: k for k, x in enumerate({x for s in sets.values() for x in s})}
    held = pd.DataFrame([(i, names[x]) for i, s in sets.items() for x in s], columns=["doc", "x"])
    pairs = duckdb.sql("""WITH n AS (SELECT doc, count(*) AS n FROM held GROUP BY doc),
        shared AS (SELECT a.doc AS a, b.doc AS b, count(*) AS k FROM held a JOIN held b ON a.x = b.x AND a.doc < b.doc GROUP BY ALL)
        SELECT a, b FROM shared JOIN n ON n.doc = a JOIN n m ON m.doc = b WHERE 100 * k >= 80 * (n.n + m.n - k)""").fetchall()
    up = {i: i for i in sets}
    for _ in range(len(sets)):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
    assert got == up and pairs


# ---- tokens, store, packing


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_ids_of_whole_texts(name, texts):
    e = tokens.Encoder(name, keep=200)
    more = ["  a", "a  b", "a \n b", "\n\nx\n", "it's 'll don't", "hi… there—x_ y", "½ a² 3rd", "é́a b", "ΑΣ ΑΣ", "a\x1cb c", "x!!_ y", "tab\tno w"]
    data = [t or "" for _, t, _ in texts] + more
    for a in range(0, len(data), 30):
        want = e.tokenizer.encode_batch(data[a : a + 30], add_special_tokens=False)
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(data[a : a + 30])] == [w.ids for w in want]


def test_block_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    ids = [rng.integers(0, high, n).astype(np.uint32) for high, n in ((50_000, 900), (200, 700), (1, 0), (1 << 31, 600), (70_000, 1))]
    for width in (4, 8, 12):
        block = token_store.Block(token_store.encode_block([3, None, 5, -7, 9], np.cumsum([len(x) for x in ids]), flat := np.concatenate(ids), width))
        assert block.doc_ids == [3, None, 5, -7, 9] and len(block) == len(flat)
        assert [block[i] for i in range(0, len(flat), 13)] == flat[::13].tolist()
        for a, b in ((0, len(flat)), (511, 1030), (100, 100), (1599, 1601)):
            assert (block.tokens(a, b) == flat[a:b]).all()
    assert len(token_store.Block(token_store.encode_block([], np.empty(0, np.int64), np.empty(0, np.uint32)))) == 0


def test_store_tells_places_and_checksums(spark, docs, texts, empty):
    e = tokens.Encoder("byte_bpe_50k.json")
    store = token_store.write_store(docs, block_tokens=700)
    got = token_store.read_store(store).toPandas().sort_values("start")
    hashed = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    ordered = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    ids = [np.append(np.frombuffer(x, "<u4"), np.uint32(0)) for x in e.encode([t or "" for _, t, _ in ordered])]
    assert [None if pd.isna(d) else d for d in got["doc_id"]] == [i for i, _, _ in ordered]
    assert got["n_tokens"].tolist() == [len(x) for x in ids] and got["start"].tolist() == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
    flat = np.concatenate(ids)
    wanted = [0, 1, len(flat) - 1, *np.random.default_rng(1).integers(0, len(flat), 60).tolist()]
    table = spark.createDataFrame([(i,) for i in set(wanted)] + [(len(flat),), (-1,)], "at long")
    for span in (1 << 21, 100):
        assert {r["at"]: r["token"] for r in token_store.tokens_at(store, table, span).collect()} == {i: int(flat[i]) for i in wanted}
    assert token_store.read_store(token_store.write_store(empty)).count() == 0


def test_packing_is_whole_gapless_and_tight(spark, docs, texts, empty):
    e = tokens.Encoder("word_bpe_49k.json")
    parts = packing.pieces(docs, capacity=256).cache()
    got = packing.pack(parts, capacity=256).toPandas()
    assert len(got) == parts.count()
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 256
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 256) + 1
    for i, t, _ in texts[:170]:
        x = np.append(np.frombuffer(e.encode([t or ""])[0], "<u4"), np.uint32(1)).astype("<u4")
        g = got[got["doc_id"] == i].sort_values("piece")
        assert g["ids_crc32"].tolist() == [zlib.crc32(x[a : a + 256].tobytes()) for a in range(0, len(x), 256)]
        assert g["start"].tolist() == list(range(0, len(x), 256))
    assert packing.pack(packing.pieces(empty)).count() == 0
    several = packing.pack(parts, capacity=256, group_size=40).toPandas()
    assert several.groupby("sequence_id")["length"].sum().max() <= 256 and several["length"].sum() == got["length"].sum()


def fewest(lengths, capacity):
    """The fewest bins, by trying every way."""
    best, fills = len(lengths), []

    def place(k):
        nonlocal best
        if len(fills) >= best:
            return
        if k == len(lengths):
            best = len(fills)
            return
        for b in range(len(fills)):
            if fills[b] + lengths[k] <= capacity and fills[b] not in fills[:b]:
                fills[b] += lengths[k]
                place(k + 1)
                fills[b] -= lengths[k]
        fills.append(lengths[k])
        place(k + 1)
        fills.pop()

    lengths = sorted(lengths, reverse=True)
    place(0)
    return best


def test_search_reaches_the_fewest_bins_and_never_gives_in_to_best_fit():
    rng, over = np.random.default_rng(6), 0
    for k in range(40):
        lengths = rng.integers(1, 60, 11)
        bins = packing.Bins(lengths, packing.in_order(lengths, 100), 100)
        squares = (bins.fill**2).sum()
        bins.search()
        used = [b for b in bins.items if b]
        assert sorted(i for b in used for i in b) == list(range(11)) and (bins.fill**2).sum() >= squares
        assert [int(lengths[x].sum()) for x in bins.items] == bins.fill.tolist() and bins.fill.max() <= 100
        assert all(bins.of[i] == b for b, x in enumerate(bins.items) for i in x)
        over += len(used) - fewest(lengths.tolist(), 100)
    assert over <= 2
    for lengths in (rng.integers(1, 60, 300), rng.integers(300, 3000, 400), np.full(90, 40), rng.geometric(0.02, 500) + 1):
        capacity = 100 if lengths.max() <= 100 else 4096
        bins = packing.fewest(lengths, packing.in_order(lengths, capacity), capacity)
        assert (bins.fill > 0).sum() <= packing.best_fit(lengths, capacity).max() + 1
    # best fit leaves 5+4, 4+3+2 and 2; two bins are enough
    hard = np.array([5, 4, 4, 3, 2, 2])
    bins = packing.Bins(hard, packing.in_order(hard, 10), 10)
    bins.search()
    assert packing.best_fit(hard, 10).max() == 2 and bins.fill.tolist().count(10) == 2


@pytest.mark.parametrize("kind", ["uniform", "third to half", "geometric", "half to two thirds"])
def test_packing_needs_no_more_bins_than_best_fit(spark, kind):
    rng, c = np.random.default_rng(1), 4096
    draw = {"uniform": lambda n: rng.integers(1, c + 1, n), "third to half": lambda n: rng.integers(c // 3, c // 2, n), "geometric": lambda n: np.minimum(rng.geometric(1 / 900, n), c), "half to two thirds": lambda n: rng.integers(c // 2, 2 * c // 3, n)}[kind]
    lengths = draw(8192)
    bins = packing.fewest(lengths, packing.in_order(lengths, c), c)
    assert sorted(i for b in bins.items for i in b) == list(range(8192)) and bins.fill.max() <= c
    assert (bins.fill > 0).sum() <= packing.best_fit(lengths, c).max() + 1
    if kind in ("uniform", "geometric"):
        lengths = draw(16_000)
        parts = spark.createDataFrame([(i, 0, 0, int(n)) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long")
        got = packing.pack(materialize(parts, "test"), c).toPandas()
        assert got.groupby("sequence_id")["length"].sum().max() <= c and got["sequence_id"].nunique() <= packing.best_fit(lengths, c).max() + 1


def test_later_rounds_fill_what_groups_leave(spark):
    rng = np.random.default_rng(8)
    rows = [(i, 0, 0, int(n)) for i, n in enumerate(rng.integers(1, 50, 600))]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long")
    got = packing.pack(materialize(parts, "test"), capacity=100, group_size=30).toPandas()
    assert sorted(got["doc_id"]) == list(range(600)) and got.groupby("sequence_id")["length"].sum().max() <= 100
    assert got["sequence_id"].nunique() <= 1.05 * sum(r[3] for r in rows) / 100


# ---- quality


def plain_statistics(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    times, covered = Counter(runs), set()
    for k, r in enumerate(runs):
        if times[r] > 1:
            covered.update(range(k, k + 5))
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)]


def test_statistics_equal_a_plain_count(texts):
    more = ["a b c d e a b c d e f", "x x x x x x x", "# # a\n# # a\n \n\n b", "é ü ñ " * 5]
    data = [t or "" for _, t, _ in texts] + more
    counts, x = quality.statistics(data)
    assert counts.tolist() == [plain_statistics(t) for t in data] and np.isfinite(x).all()


def test_trees_obey_their_constraints_and_learn():
    rng = np.random.default_rng(7)
    x = rng.uniform(size=(1500, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.uniform(size=1500) < 0.05)).astype(float)
    forest = quality.fit_forest(x, y, np.array([-1, 1, 0]))
    assert ((forest.score(x) >= 0.5) == (x[:, 0] < 0.5)).mean() > 0.95
    grid = np.linspace(0, 1, 50)
    for j, sign in ((0, -1), (1, 1)):
        at = np.tile(rng.uniform(size=3), (50, 1))
        at[:, j] = grid
        assert (sign * np.diff(forest.score(at)) >= -1e-12).all()


def test_quality_keeps_good_and_drops_bad(spark, docs, texts, empty):
    rng = np.random.default_rng(8)
    rows = [(i, prose(rng, "en", 50) if i % 3 else " ".join(w + "###" for w in prose(rng, "en", 50).split()), int(i % 3 > 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    out = {r["doc_id"]: r["kept"] for r in quality.judge(df, model).collect()}
    assert out == {i: bool(q) for i, _, q in rows}
    odd = quality.judge(docs, model).collect()
    assert len(odd) == len(texts) and all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in odd)
    assert not any(r["kept"] for r in odd if r["base_failed"])
    assert quality.judge(empty, quality.fit(empty.select("doc_id", "text"), df.select("doc_id", "quality").limit(0))).count() == 0


# ---- language model


def test_base_scores_are_exact_and_scores_are_probabilities(spark, docs, texts, empty):
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 1
    got = lm_scoring.score(docs.select("doc_id", "text", train.alias("train")), max_common=40).collect()
    tok = lambda t: [*WORD.findall(lower(t)), ""]
    counts = Counter(w for i, t, _ in texts if (i or 0) % 5 != 1 for w in tok(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(w := tok(t)), sum(counts[x] > 0 for x in w), round(sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for _, t, _ in texts)
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and r["train_tokens"] == n for r in got)
    whole = lm_scoring.score(docs.select("doc_id", "text", train.alias("train")), max_common=100_000).collect()
    assert sum(r["score"] for r in whole) == pytest.approx(sum(r["score"] for r in got), rel=0.05)
    assert sum(r["score"] for r in whole) > sum(r["base_score"] for r in whole)
    assert lm_scoring.score(empty.select("doc_id", "text", F.lit(True).alias("train"))).count() == 0


def test_code_is_a_prefix_code_and_spelling_adds_up_to_one():
    code = lm_scoring.Code(np.arange(256) ** 2.0)
    assert abs(sum(2.0**-n for n in code.length) - 1) < 1e-9
    rng = np.random.default_rng(9)
    table = [rng.uniform(0, 5, (2, 1 << b)).astype(np.float32) for b in lm_scoring.SLOT_BITS]
    weights, came = rng.normal(0.2, 0.1, (lm_scoring.GATES, lm_scoring.ORDERS + 1)), rng.uniform(0.1, 0.9, (lm_scoring.GATES, lm_scoring.STEPS))
    # the chances of every next byte after a word's beginning, the close included
    bit, word, slots = lm_scoring.bits_of([b"th" + bytes([c]) for c in range(256)], code)
    table = [t * (rng.random(t.shape) < 0.4) for t in table]
    for a, b in zip(lm_scoring.inputs(bit, slots, table), lm_scoring.looked_up(slots, lm_scoring.ready(table)), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-5)
    p = lm_scoring.mixed(*lm_scoring.looked_up(slots, lm_scoring.ready(table)), weights, came)
    chance = np.where(bit == 1, p, 1 - p)
    total = 0.0
    for c in range(256):
        own = chance[word == c]
        skip = code.length[116] + code.length[104]
        total += np.prod(own[skip : skip + code.length[c]])
    assert abs(total - 1) < 1e-9


# ---- decontamination


def plain_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_edit_matching_equals_dynamic_programming(spark, docs, empty):
    rng = np.random.default_rng(10)
    items = [(k, prose(rng, "en", 12)) for k in range(6)] + [(6, ""), (7, None), (8, "ab")]
    rows = []
    for i in range(60):
        words = prose(rng, "en", 30)
        item = list(items[i % 6][1])
        for _ in range(i % 9):
            k = int(rng.integers(len(item)))
            item[k : k + int(rng.integers(0, 2))] = rng.choice(["", "q", "zz"])
        rows.append((i, f"{words}\n  {''.join(item).upper()} {words}" if i % 3 else words))
    df = spark.createDataFrame(rows + [(90, None), (91, "")], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.matches(df, table).collect()}
    want = {}
    for i, t in rows:
        for k, item in items:
            p = decontaminate.plain(item)
            if p and (d := plain_distance(p, decontaminate.plain(t))) <= len(p) // 16:
                want[i, k] = d
    assert got == want
    for r in decontaminate.matches(df, table).collect():
        part = decontaminate.plain(rows[r["doc_id"]][1])[r["start"] : r["start"] + r["length"]]
        assert plain_distance(part, decontaminate.plain(items[r["item_id"]][1])) <= r["distance"] <= r["budget"]
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, table, block=150).collect()} == set(want)
    assert decontaminate.without_matches(df, table, block=150).count() == decontaminate.without_matches(df, table).count()
    clean = {r["doc_id"] for r in decontaminate.without_matches(df, table).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in want} | {90, 91}
    assert decontaminate.matches(empty, table).count() == 0 and decontaminate.without_matches(docs, table.limit(0)).count() == docs.count()


# ---- html

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav><a href=/>Home</a></nav><div id="menu"><a>x</a></div>
<div class="cookie-notice">We use cookies on this site for many and long reasons.</div><%s class="%s"><h1>Title &amp; more</h1><p>First   para<b>graph</b> one,
with more words in it.<p>Second <a href=x>link</a> &lt;x&gt; &#233; and also a good many words.<ul><li>one<li>two</ul><table><tr><td>a<td>b</table></%s>
<section class="comments"><div class="comment"><p>I liked this so much that I write a long and dense comment about it here.</div></section>
<aside>Side text</aside><form><p>Sign up <input></form><script>var t = "</p>";</script><footer>&copy; 2020"""
TEXT = "Title & more\nFirst paragraph one, with more words in it.\nSecond link <x> é and also a good many words.\none\ntwo\na\nb"


@pytest.mark.parametrize(("tag", "name"), [("article", "post"), ("main", "x"), ("div", "content")])
def test_main_text(tag, name):
    assert html_text.main_text(PAGE % (tag, name, tag)) == TEXT


def plain_content(html):
    """Density sums and thresholds by walking the tree anew for every node."""
    page = html_text.Page(html)
    page.measure()
    n = len(page.name)
    kids = [[j for j in range(1, n) if page.up[j] == i] for i in range(n)]

    def tree(i):
        return [i] + [x for j in kids[i] for x in tree(j)]

    def over(i):
        return [] if i < 0 else [i, *over(page.up[i])]

    def density(i):
        own = [j for j in tree(i) if not page.left_out[j]]
        if i not in own:
            return 0.0
        texts = [(j, len("".join(t.split()))) for j, t in page.told if j in own]
        links = [j for j in own if any(page.name[k] == "a" for k in over(j))]
        c, lc = sum(k for _, k in texts), sum(k for j, k in texts if j in links)
        body = page.name.index("body")
        if i == body:
            whole = lc / max(c, 1)
        else:
            every = [(j, len("".join(t.split()))) for j, t in page.told if j in tree(body) and not page.left_out[j]]
            whole = sum(k for j, k in every if any(page.name[x] == "a" for x in over(j))) / max(sum(k for _, k in every), 1)
        return page._density(c, lc, len(own) - 1, sum(page.name[j] == "a" for j in own if j != i), whole)

    d = [density(i) for i in range(n)]
    total = [sum(d[j] for j in kids[i]) for i in range(n)]
    body = page.name.index("body")
    inner = [i for i in tree(body) if not page.left_out[i]]
    first = max(total[i] for i in inner)
    top = next(i for i in inner if total[i] == first)
    path = [i for i in over(top) if i in inner]
    article = [x in ("article", "main") for x in page.name]
    weight = [4 if a else 1 for a in article]
    wide = [i for i in path if i == top or i != body and (weight[i] * d[i] >= d[top] / 2 or article[i] and d[i] >= 25)][-1]
    threshold = min(d[i] for i in path)
    found = set(tree(wide))
    for i in inner:
        if i not in path and d[i] > 0 and d[i] * weight[i] >= threshold and not found & set(over(i)):
            most = max(total[j] for j in tree(i) if not page.left_out[j])
            found |= set(tree(i if article[i] else next(j for j in tree(i) if total[j] == most and not page.left_out[j])))
    return [i in found for i in range(n)]


def test_densities_equal_a_plain_walk():
    rng = np.random.default_rng(9)

    def some(depth):
        kind = rng.choice(["p", "div", "a", "span", "article", "section", "text", "text"])
        if kind == "text" or depth > 4:
            return "word " * int(rng.integers(1, 40))
        return f"<{kind}>" + "".join(some(depth + 1) for _ in range(int(rng.integers(1, 4)))) + f"</{kind}>"

    for _ in range(60):
        html = f"<body>{''.join(some(0) for _ in range(4))}</body>"
        assert html_text.Page(html).content() == plain_content(html), html


def test_running_text_is_kept_whatever_its_class():
    run = "A long running text of the page, with many words that say a thing or two. " * 6
    for name in ("search-results-study", "article-header", "search", "header-text", "notice", "x"):
        assert html_text.main_text(f'<body><div class="{name}"><p>{run}</p></div><div class="header">Our site</div></body>') == run.strip()
    two = f"<body><article><h1>Title</h1><p>{run}</p></article><article><p>{run}</p></article><div class=comments><p>{run}</p></div></body>"
    assert html_text.main_text(two) == "\n".join(["Title", run.strip(), run.strip()])
    lead = f"<body><p>{run}</p><article><p>{run}</p><p>{run}</p></article><div class=search>find a thing</div></body>"
    assert html_text.main_text(lead).count("long running text") == 18 and "find" not in html_text.main_text(lead)


def test_wrappers_of_whole_pages_are_kept():
    long = "".join(f"<p>Paragraph number {i} tells a long story about many things, and it goes on for a while.</p>" for i in range(6))
    want = "\n".join(f"Paragraph number {i} tells a long story about many things, and it goes on for a while." for i in range(6))
    assert html_text.main_text(f"<body><form id=f>{long}</form></body>") == want
    assert html_text.main_text(f"<body><form><article>{long}</article><input><nav>menu</nav></form></body>") == want
    for named in ('class="informed-consent-study"', 'class="comment-on-policy"', 'id="reply-to-critics"', 'class="copyright-law-essay"'):
        assert html_text.main_text(f"<body><p>Home</p><div {named}>{long}</div><footer>foot</footer></body>").endswith(want)
    # beside an article they go, however much they hold
    assert html_text.main_text(f"<body><article>{long}</article><form>sign up</form><div class=comments>{long * 9}</div></body>") == want
    assert html_text.main_text(f"<body><article><p>where <math><mi>x</mi></math> holds.</p>{long}</article></body>") == "where x holds.\n" + want


@pytest.mark.parametrize("part", ["<script ", '<a x="', "<div>", "<a><div><b></a>", '<a ">" ', "<body>", "<p>", "<li></p>", "<!--", "<script>", "<", "</", "<table><tr><td>", '<div class="', "<div class=header>", "&amp;", "<svg>", "<x></y>"])
def test_broken_pages_take_time_that_grows_with_their_length(part):
    html = part * (1_000_000 // len(part) if len(part) > 5 else 100_000)
    began = time.perf_counter()
    html_text.main_text(html)
    assert time.perf_counter() - began < 12


@pytest.mark.parametrize(("html", "text"), [("", ""), (None, ""), ("just text &amp; more", "just text & more"), ("<p>a<br>b</p><script>x", "a\nb"), ("<div><div></b></p>", ""), ("<p>a < b &nosuch; c<", "a < b &nosuch; c<"), ("<nav>only menus</nav>", ""), ("a</>b <3 <", "ab <3 <"), ("<p>x<script>y", "x"), ('<p title="x>one</p><p>two', "one\ntwo"), ("x<!-- c -- > y", "x")])
def test_odd_pages(html, text):
    assert html_text.main_text(html) == text


def test_extract_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "old"), (1, "u", None, "old")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["url"], r["text"]) for r in html_text.extract(df).collect()) == [(1, "u", ""), (1, "u", "x")]
    assert html_text.extract(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "<article>" + "<p>some words of it</p>" * 100_000 + "</article>")], "page_id long, html string")
    assert html_text.extract(long).first()["text"].count("\n") == 99_999


# ---- licences


def test_licences_own_inherited_and_none(spark):
    apache, mit = licenses.TEXTS["Apache-2.0"][0], licenses.TEXTS["MIT"][0]
    files = [
        (1, "a/LICENSE", "Some words before. " + apache, "x"), (2, "a/b/c/x.txt", "nothing here", "x"), (3, "a/b/LICENSE.txt", mit, "x"), (4, "a/y.txt", None, "x"),
        (5, "z/q.txt", "", "x"), (6, "a/b/own.txt", "text\n" + licenses.TEXTS["GPL-3.0"][0] + "\nmore text of many other words that say a good deal", "x"), (7, "top.txt", mit, "x"), (7, "top.txt", mit, "x"), (8, "other.txt", "plain", "x"),
    ]
    df = spark.createDataFrame([(i, p, t, e) for i, p, t, e in files], "id long, path string, text string, content string")
    got = sorted((r["id"], r["license"], r["how"]) for r in licenses.scan(df).collect())
    assert got == [
        (1, "Apache-2.0", "own"), (2, "MIT", "inherited"), (3, "MIT", "own"), (4, "Apache-2.0", "inherited"), (5, "MIT", "inherited"), (6, "GPL-3.0", "own"),
        (7, "MIT", "own"), (7, "MIT", "own"), (8, "MIT", "inherited"),
    ]
    assert licenses.scan(df.limit(0)).count() == 0


def test_licence_bodies_headers_and_identifiers(spark):
    wrap = lambda t: "\n".join(textwrap.wrap(t, 60))
    rng = np.random.default_rng(3)
    files = [(k, f"p{k}/a.txt", wrap(prose(rng, "en", 120))) for k in range(20)]
    files += [
        (30, "q/LICENSE", "Copyright (c) 2020 Some Body\n\n" + wrap(licenses.TEXTS["MIT"][1])), (31, "q/src/deep/x.c", "int main"), (32, "r/COPYING", wrap(licenses.TEXTS["ISC"][1])),
        (33, "s/a.py", "# SPDX-License-Identifier: Apache-2.0\nimport x"), (34, "s/b.py", "code\n\n" + wrap(licenses.TEXTS["GPL-3.0"][1]) + "\n\n" + prose(rng, "en", 200)),
        (35, "t/LICENSE", wrap(licenses.TEXTS["BSD-3-Clause"][1])), (36, "t/u/LICENSE", wrap(licenses.TEXTS["BSD-2-Clause"][1])), (37, "t/u/v/w", None), (None, None, "x"),
    ]
    got = {r["id"]: (r["license"], r["how"]) for r in licenses.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert {i: x for i, x in got.items() if i is not None and i >= 30} == {
        30: ("MIT", "own"), 31: ("MIT", "inherited"), 32: ("ISC", "own"), 33: ("Apache-2.0", "own"), 34: ("GPL-3.0", "own"),
        35: ("BSD-3-Clause", "own"), 36: ("BSD-2-Clause", "own"), 37: ("BSD-2-Clause", "inherited"),
    }
    assert len(got) == len(files) and all(got[k] == (None, "none") for k in [*range(20), None])


# ---- the pipeline


def test_pipeline_stages_chain(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    rows = [(i, prose(rng, list(SYLLABLES)[i % 4], 40), list(SYLLABLES)[i % 4]) for i in range(120)]
    for i in range(0, 120, 6):
        rows[i] = (i, rows[i][1] + " idiot moron clown", rows[i][2])
    item = prose(rng, "en", 15)
    rows += [(200, rows[1][1], "de"), (201, "123 456", None), (202, prose(rng, "en", 20) + " " + item, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("idiot" in t)) for i, t, _ in rows[:120]], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out["doc_id"]) == {i for i in range(120) if i % 6}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "ngram_join", "decontamination", "packing"]


def test_pipeline_keeps_clashing_columns_null_ids_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    names = "doc_id long, text string, lang string, row_ long, toxicity string, lang_pred string, component_id long, class string"
    rows = [(i if i % 10 else None, prose(rng, list(SYLLABLES)[i % 4], 40) + (" idiot moron clown" if i % 6 == 5 else ""), list(SYLLABLES)[i % 4], 777 + i, "mine", "mine", -i, "c") for i in range(100)]
    rows += [(1000 + k, t, None, 0, None, None, None, None) for k, t in enumerate(ODD)]
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 == 5)) for i in range(100)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "no such words anywhere"), (1, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, known = spark.read.parquet(str(tmp_path / "documents.parquet")), {tuple(r) for r in rows}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == [c.split()[0] for c in names.split(", ")]
        assert {tuple(r) for r in docs.collect()} <= known and docs.count() >= 70
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} >= {1, 2, 3, None}
    for name in ("documents", "labels", "benchmark"):
        empty = spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0)
        empty.write.parquet(str(tmp_path / f"none/{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_mixing_is_fitted_on_all_words(spark):
    rng = np.random.default_rng(3)
    words = sorted({bytes(rng.integers(97, 103, rng.integers(2, 7)).astype(np.uint8)) for _ in range(500)})
    code = lm_scoring.Code(np.bincount(np.frombuffer(b" ".join(words), np.uint8), minlength=256))
    bit, _, slots = lm_scoring.bits_of(words, code)
    table = [np.stack([np.bincount(s[bit == b], minlength=1 << n) for b in (0, 1)]).astype(np.float32) for s, n in zip(slots, lm_scoring.SLOT_BITS, strict=True)]
    types = spark.createDataFrame([(w, 1, i % 40) for i, w in enumerate(words)], "word binary, c long, shard int")
    weights, came_true = lm_scoring.fit_mixing(types, code, spark.sparkContext.broadcast(table), 40)
    shards = {}
    for r in types.select("word", F.pmod(F.hash("word"), F.lit(-(-len(words) // 40))).alias("shard")).collect():
        shards.setdefault(r["shard"], []).append(bytes(r["word"]))
    # the plain version: inputs with a word's own bits taken off, all shards in one process
    total, n, one = 0, 0, 0
    for some in shards.values():
        some = [sorted(some)[i] for i in np.random.default_rng(11).permutation(len(some))]
        bit, _, slots = lm_scoring.bits_of(some, code)
        x, gate = lm_scoring.inputs(bit, slots, table, 1)
        w = lm_scoring.learn_weights(bit, x, gate)
        at = gate * lm_scoring.STEPS + lm_scoring.strength((w[gate] * x).sum(1))
        total, n, one = total + w * len(bit), n + np.bincount(at, minlength=came_true.size), one + np.bincount(at, bit, minlength=came_true.size)
    assert np.allclose(weights, total / n.sum(), atol=1e-4)
    middle = lm_scoring.squash((np.arange(lm_scoring.STEPS) + 0.5 - lm_scoring.STEPS / 2) / 1.5)
    plain = (one.reshape(came_true.shape) + 8 * middle) / (n.reshape(came_true.shape) + 8)
    assert np.allclose(came_true, plain, atol=0.02)


def test_topics_are_fitted_on_all_texts(spark):
    texts = [" ".join(("alpha beta gamma", "один два три", "ka ki ku ke ko")[i % 3].split()[j % 3] + "xyz"[i % 2] for j in range(i, i + 9)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, i % 5 > 0) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    vectors = lm_scoring.with_vectors(docs).cache()
    centres = lm_scoring.fit_topics(vectors, 3, max_seeds=40)
    x, of = lm_scoring.topics_of(sorted(bytes(r["x"]) for r in vectors.where("train").collect()), centres)
    for k in set(of.tolist()):
        mean = x[of == k].sum(0)
        assert np.allclose(centres[k], mean / np.linalg.norm(mean), atol=1e-3)
    vectors.unpersist()


def test_runs_of_words_are_counted_in_all_training_texts(spark, texts):
    from collections import defaultdict

    rows = [(i, t, k % 3 > 0) for k, (i, t, _) in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows[:9]], "doc_id long, text string, train boolean")
    vectors = lm_scoring.with_vectors(docs).cache()
    vectors.count()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # blocks in parts
    try:
        unused = lm_scoring.unused_bits(40_000_000)  # as many buckets as that many tokens have
        got = lm_scoring.with_grams(vectors, lm_scoring.count_grams(vectors, unused), unused).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    runs = lambda t: list(zip(["^", "^", *t[:-2]][: len(t)], ["^", *t[:-1]], t, strict=True))
    told, counts = {}, [Counter(), Counter(), Counter()]
    for _, t, train in [*rows, *rows[:9]]:
        told[t] = runs([*lm_scoring.word_list(t or ""), b""])
        for run in told[t] if train else []:
            for n in range(3):
                counts[n][run[2 - n :]] += 1
    assert len(got) == len(rows) + 9
    for r in got:
        n = lm_scoring.wide(r["grams"], 3 * r["size"]).reshape(3, -1)
        assert n.tolist() == [[counts[k][run[2 - k :]] for run in told[r["text"]]] for k in range(3)]
    # so what follows a run has chances that add up to one
    n, met, part = lm_scoring.in_order([r["grams"] for r in got], np.array([r["size"] for r in got]))
    after = defaultdict(dict)
    for run, a, b in zip([x for r in got for x in told[r["text"]]], part.T.tolist(), met.T.tolist(), strict=True):
        for k in range(2):
            if b[k]:
                after[run[1 - k : 2]][run[2]] = a[k]
    assert len(after) > 20 and np.allclose([sum(x.values()) for x in after.values()], 1)
    vectors.unpersist()


def test_word_order_counts(spark):
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(60)]
    verse = [words[k] for k in rng.permutation(60)]
    rows = [(k, " ".join(verse if k % 2 else rng.permutation(words)), True) for k in range(40)] + [(100, " ".join(verse), False), (101, " ".join(verse[::-1]), False)]
    out = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).collect()}
    # the same words: without their order both had one score
    assert out[100] > out[101] + 20
