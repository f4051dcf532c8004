from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from stagelight.llm import prefix_trie as T

from .conftest import as_rows

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, depth int, path binary, kind int"


def brute(rows):
    """The nodes from dictionaries of whole prefixes. Turns of one number must be equal."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(turns.get(base, [])[:h] + t[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, p in sorted(built.items()):
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                kids[p[:d - 1]].add(p[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in m if built[c] == p).encode()).hexdigest())
                   for p, m in members.items()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 3, b"x", 1) for r in rows], SCHEMA).repartition(3)


def conversations(rng, n, copies):
    """Few different turns, so that beginnings, whole conversations and their copies meet."""
    rows = []
    for c in rng.sample(range(-150, 900), n):
        long = rng.random() < 0.05
        rows += [(c, k, rng.choice("ua"), rng.choice(["", "a", "bé", "😀 x"])) for k in range(rng.randint(1, 40 if long else 5))]
    for c in range(1000, 1000 + copies):
        rows += [(c, k, "u", "same") for k in range(7)]
    return rows


@pytest.mark.parametrize("cells", [T.CELLS, 60, 5])
def test_random_conversations(spark, cells):
    rows = conversations(random.Random(cells), 150, 60)
    assert as_rows(T.trie(frame(spark, rows), cells).select(T.COLUMNS)) == brute(rows)


def test_many_copies_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "ENDS", 7)
    rows = conversations(random.Random(9), 20, 300)
    assert as_rows(T.trie(frame(spark, rows), 50).select(T.COLUMNS)) == brute(rows)


def test_nulls_repeats_and_turnless(spark):
    rows = [(7, None, None, "x"), (7, 0, "u", None), (7, 0, "u", None), (7, 2, "", ""), (None, 0, "u", "lost"),
            (5, 0, "u", "short"), (205, 0, "u", "y"), (200, 1, "a", "base"), (200, None, "a", "first"),
            (8, 0, "u", "w" * 100_000), (9, 0, "u", "w" * 100_000)]
    found = as_rows(T.trie(frame(spark, rows)).select(T.COLUMNS))
    assert found == brute(rows)
    assert all(zlib.crc32(str(c).encode()) % 6 for c in (5,))  # conversation 5 has no base and loses its turn


def test_equal_turn_numbers_have_a_defined_order(spark):
    rows = [(0, 1, "u", t) for t in "abc"] * 2
    one, two = (as_rows(T.trie(frame(spark, x)).select(T.COLUMNS)) for x in (rows, rows[::-1]))
    assert one == two and len(one) == 7


def test_empty(spark):
    assert T.trie(frame(spark, [])).count() == 0


def test_correction_of_neighbours():
    a, b, c = (bytes([k]) * T.DIGEST for k in (1, 2, 3))
    rows = list(T.correction(a + b, a + b + c, T.np.array([5, 7, 9])))
    assert [(r["depth"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in rows] == [
        (0, -1, -1, 12), (1, -1, -1, 12), (2, 0, -1, 7)]
