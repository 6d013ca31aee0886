"""Repair of conversations against a plain search over all edits."""

import hashlib
import random
import sys
import zlib
from functools import lru_cache

import pandas as pd
import pytest

from pulsegrid.llm import turn_repair
from pulsegrid.llm.turn_repair import align

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def plain(letters):
    """(cost, audit) by a search from the end over (turn, state), insertions wherever they help."""
    follows = {("S", "s"): "T", ("S", "u"): "A", ("T", "u"): "A", ("U", "u"): "A", ("A", "a"): "U"}

    @lru_cache(None)
    def best(i, state, inserted=0):
        found = [(0, "")] if i == len(letters) and state in "SU" else []
        if inserted < 3:
            found += [(c + 3, "I" + a) for (s, _), to in follows.items() if s == state and to != "T" for c, a in [best(i, to, inserted + 1)]]
        if i < len(letters):
            c, a = best(i + 1, state)
            found.append((c + 4, "D" + a))
            if letters[i] != "x":
                for (s, sign), to in follows.items():
                    if s == state:
                        c, a = best(i + 1, to)
                        cut = 3 if letters[i].isupper() else 0
                        if letters[i].lower() == sign:
                            found.append((c + cut, "K" + a))
                        elif sign != "s":
                            found.append((c + cut + 3, "R" + a))
        return min(found, default=(10**9, ""))

    sys.setrecursionlimit(20_000)
    return best(0, "S")


@pytest.mark.parametrize("block", [1, 2, 3, 5, 512])
def test_alignment_is_that_of_a_plain_search(block):
    rng = random.Random(block)
    for n in range(400):
        letters = "".join(rng.choices("uaxsoUASO" if n % 2 else "uauauauaxs", k=rng.randrange(0, 14)))
        cost, parts = align(letters, block)
        assert (cost, "".join(e for e, _ in parts)) == plain(letters), letters


def test_long_conversations_in_blocks():
    rng = random.Random(9)
    letters = "".join(c if rng.random() < 0.8 else rng.choice("uaxsoUASO") for c in "ua" * 300)
    one = align(letters, 10_000)
    cut = align(letters, 64)
    assert one[0] == cut[0] and one[1][0][0] == "".join(e for e, _ in cut[1])
    letters = "".join(rng.choices("uaxsoUASO", k=20_000))
    cost, parts = align(letters)
    edits, given = ("".join(p[k] for p in parts) for k in (0, 1))
    assert sum(e != "I" for e in edits) == len(letters) and len(edits) == len(given) and cost > 0


def by_hand(turns):
    """The query's columns by plain Python."""
    groups = {}
    for c, turn, role, text in turns:
        groups.setdefault(c, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        if kind == 4:
            role = "user"
        groups[c] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for c, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, letters, faults = set(), "", []
        for _, role, text in rows:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            faults.append(fault)
        cost, audit = plain(letters)
        lines, i, state, start = [], 0, "u", True
        for e in audit:
            if e == "D":
                i += 1
                continue
            if e == "K" and rows[i][1][:1] == "s":
                lines.append(f"{rows[i][1]}:{rows[i][2]}")
                i += 1
                continue
            role = {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:" if e == "I" else f"{rows[i][1] if e == 'K' else role}:{rows[i][2]}")
            i += e != "I"
            state = "a" if state == "u" else "u"
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def odd():
    rng, texts = random.Random(5), ["Yes.", "No", "", None, " \n", "What? ", "a\x85", "long " * 4000 + "end!", "Ü.\x0b", "x\n.y"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "Über"]), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, t, "user", "null id.") for t in (None, 1, 2)] + [(100, None, "user", "a."), (100, None, "assistant", "b."), (100, 5, "user", "c.")]
    rows += [(101, 1, "user", "same."), (101, 1, "user", "same."), (101, 1, "assistant", "other."), (102, -(10**12), "user", "x."), (102, 7, "assistant", "y.")]
    rows += [(103, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(700)]
    return rows


def run(monkeypatch, spark, df):
    monkeypatch.setattr(turn_repair, "read_table", lambda *_: df)
    return turn_repair.op12_turn_repair(spark, "")


def test_query_over_odd_rows(spark, monkeypatch):
    rows = odd()
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA + ", conv string, row int").repartition(3)
    out = run(monkeypatch, spark, df)
    assert sorted(map(tuple, out.collect()), key=str) == by_hand(rows)
    assert dict(out.dtypes)["cost"] == dict(out.dtypes)["gaps"] == "bigint"


def test_conversation_without_rows_and_empty_table(spark, monkeypatch):
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out = run(monkeypatch, spark, spark.createDataFrame([(c, 0, "user", "gone.")], SCHEMA)).collect()
    assert [tuple(r) for r in out] == [(c, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert run(monkeypatch, spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_turns_follow_the_grammar(spark):
    turns = spark.createDataFrame(odd(), SCHEMA)
    numbered = turn_repair.number(turns)
    got = turn_repair.repaired(numbered, turn_repair.alignments(numbered)).toPandas().sort_values(["conv", "block", "place"])
    for _, g in got.groupby("conv"):
        roles = g["role"].str[0].str.cat()
        rest = roles.removeprefix("s")
        assert rest and rest == "ua" * (len(rest) // 2)


def test_against_sql(spark):
    import duckdb

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS FROM '{sf}/conversations.parquet'")
    want = c.execute(turn_repair.ORACLE).df()
    got = turn_repair.op12_turn_repair(spark, sf).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("conv_id", ignore_index=True), want[got.columns].sort_values("conv_id", ignore_index=True), check_dtype=False)
