from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from stagelight.llm import vector_codes as V

from .conftest import as_rows

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, position int, v string, entry int, c int, error int"
COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def brute(rows, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e], lab) for i, e, lab in rows
            if e and len(e) % 4 == 0 and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    w = len(kept[0][1]) // 4
    cut = [[v[p * w:p * w + w] for p in range(4)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:256]] for p in range(4)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            own = {}
            for c in cut:
                own.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(4)] for c in cut]
    errors = [sum(e for e, _ in f) for f in found]
    by = {}
    for (_, _, lab), e in zip(kept, errors):
        by[lab] = by.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by[lab], sha)
                   for (i, _, lab), f, e in zip(kept, found, errors)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, "y", 8, 7, 6) for r in rows], SCHEMA).repartition(4)


def made(rng, n, width=8, spread=0.4):
    return [(k, [rng.uniform(-spread, spread) for _ in range(width)], rng.choice([None, 1, 2])) for k in range(n)]


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = made(rng, 400)
    rows += [(1000, None, 1), (1001, [0.1] * 7 + [None], 1), (1002, [0.1] * 7 + [float("nan")], 1),
             (1003, [float("inf")] + [0.0] * 7, 1), (1004, [], 1), (1005, [0.5] * 4, 1), (1006, [0.5] * 7, 1),
             (None, [0.25] * 8, None), (3, [0.75] * 8, 2), (3, [0.75] * 8, 2), (1007, [-200000.0] * 8, 1)]
    assert as_rows(V.compress(frame(spark, rows)).select(COLUMNS)) == brute(rows)


def test_a_third_of_the_vectors_alike(spark):
    rng = random.Random(3)
    rows = made(rng, 600) + [(1000 + k, [0.3] * 8, 1) for k in range(300)]
    assert as_rows(V.compress(frame(spark, rows)).select(COLUMNS)) == brute(rows)


@pytest.mark.parametrize("n", [1, 5])
def test_few_vectors(spark, n):
    rows = made(random.Random(n), n, 4)
    assert as_rows(V.compress(frame(spark, rows)).select(COLUMNS)) == brute(rows)


def test_a_first_vector_of_another_length_does_not_shorten_the_codebooks(spark):
    rows = made(random.Random(8), 300) + [(7, [0.1] * 4, 1), (9, [0.1] * 12, 1)]
    assert as_rows(V.compress(frame(spark, rows)).select(COLUMNS)) == brute(rows)


def test_empty(spark):
    assert V.compress(frame(spark, [])).count() == 0
    assert V.compress(frame(spark, [(1, None, 1)])).columns == COLUMNS


def test_hot_owners_are_salted_and_only_movers_move(spark):
    members = [(k, k % 4, 5 if k % 3 else 200, [k % 7, 1], 5 if k % 3 else k % 200, 0) for k in range(6000)]
    moved = spark.createDataFrame(members, V.FOUND)
    dealt = V.migrated(moved, 6000)
    sizes = {}
    for r in dealt.collect():
        sizes[r["position"], r["new"], r["salt"]] = sizes.get((r["position"], r["new"], r["salt"]), 0) + 1
    assert max(sizes.values()) <= 2 * 6000 * V.SHARE / 8


def test_large_components_are_exact_or_an_error(spark):
    book = np.array([[V.LARGEST, 0], [-V.LARGEST, 3]], np.int64)
    entry, error = V.nearest(np.array([[V.LARGEST - 1, 0], [0, 3]], np.int32), book)
    assert entry.tolist() == [0, 1] and error.tolist() == [1, V.LARGEST ** 2]
    with pytest.raises(Exception, match="component"):
        V.compress(frame(spark, [(1, [1e30] * 4, 1)])).count()
