"""The trie of conversations against plain Python and SQL."""

import hashlib
import random
import zlib

import pandas as pd
import pytest

from pulsegrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    for c in convs:
        convs[c] = [(r[3], r[4]) for r in sorted(convs[c])]
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for path, of in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        ending = ",".join(str(c) for c in sorted(of) if rebuilt[c] == path)
        out.append((
            min(of), len(path), min(members[path[:-1]]) if path else None, len(of), sum(len(q) == len(path) + 1 for q in below), sum(map(leaf, below)),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ending.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def run(monkeypatch, spark, rows, extra=False):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows] if extra else rows, SCHEMA + (", id string, block int" if extra else ""))
    monkeypatch.setattr(prefix_trie, "read_table", lambda *_: df.repartition(3))
    return sorted(map(tuple, prefix_trie.op13_prefix_trie(spark, "").collect()), key=str)


def drawn(seed):
    rng = random.Random(seed)
    texts = ["a", "bb", "", None, "ü" * 5, "long " * 3000]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in [*range(0, 30), *range(200, 230), *range(305, 312)] for t in range(rng.choice([1, 2, 3, 8, 9, 17]))]
    # copies, a conversation over many blocks, null and repeated turn numbers, rows without an id
    rows += [(c, t, "user", f"same {t}") for c in (400, *range(410, 440)) for t in range(8)]
    rows += [(c, t, "user", f"{t % 7} of {c // 3}") for c in (501, 502, 503, 600, 601) for t in range(60)]
    rows += [(700, None, "user", "null"), (700, None, "user", "null"), (700, 3, "system", "x"), (700, 3, "system", "x"), (None, 1, "user", "no id"), (799, 0, "user", "y")]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_against_plain_python(spark, monkeypatch, seed):
    rows = drawn(seed)
    assert run(monkeypatch, spark, rows, extra=bool(seed)) == by_hand(rows)


def test_turnless_conversations_and_empty_table(spark, monkeypatch):
    # no base, and all own turns replaced: nothing is left
    c = next(c for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 6 >= 1)
    assert run(monkeypatch, spark, [(c, 0, "user", "gone")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert run(monkeypatch, spark, []) == []


def test_against_sql(spark):
    import duckdb

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS FROM '{sf}/conversations.parquet'")
    want, got = c.execute(prefix_trie.ORACLE).df(), prefix_trie.op13_prefix_trie(spark, sf).toPandas()
    order = ["depth", "conv_id"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want[got.columns].sort_values(order, ignore_index=True), check_dtype=False)
