"""Decontamination, PII and the language model against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stagelight.llm import decontaminate as C
from stagelight.llm import language_model as L
from stagelight.llm import pii

from .brute import PII, Trigrams, base_spans, contamination, lm_words
from .conftest import SF, as_rows, odd_rows, texts


# ------------------------------------------------------------ decontamination
def brute(docs, items):
    return sorted(((i, *contamination(t, items)) for i, t in docs), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(4)
    text = odd_rows()[3][1]
    rows = [(1, text), (1, "w x"), (2, " ".join(text.split()[7:30])), (3, None), (4, "!!"), (5, "x"), (None, "A b"),
            (6, odd_rows()[7][1][400:1500]), (7, "the the the"), (10, "1"), (11, " ".join(rng.choices("ab", k=40)))]
    return spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "item_id bigint, text string, doc_id int, shard string")


@pytest.mark.parametrize("block_bytes", [4 << 20, 600])
def test_contamination_of_odd_rows(odd, empty, items, monkeypatch, block_bytes):
    monkeypatch.setattr(C, "BLOCK_BYTES", block_bytes)
    own = [(r["item_id"], r["text"] or "") for r in items.collect()]
    got = as_rows(C.decontaminate(odd, items))
    assert got == brute(texts(odd), own)
    assert any(r[5] for r in got) and not all(r[5] for r in got)
    assert C.decontaminate(empty, items).count() == 0
    assert {r["n_hit"] for r in C.decontaminate(odd, items.where("item_id < 0")).collect()} == {0}


def test_clean_rows(odd, items):
    kept = C.clean_rows(odd, items)
    bad = {r["doc_id"] for r in C.decontaminate(odd, items).where("contaminated").collect()} - {None}
    assert kept.columns == odd.columns
    assert sorted(map(repr, texts(kept))) == sorted(repr(x) for x in texts(odd) if x[0] not in bad)


def test_contamination_of_documents(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    own = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert as_rows(C.decontaminate(documents, bench)) == brute(texts(documents), own)


def test_proximity(spark):
    docs = spark.createDataFrame([(0, "a b c d e"), (1, "a b x c d e"), (2, "e d c b a"), (3, "a x x x x b c d e")],
                                 "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, "a b c d e")], "item_id bigint, text string")
    near = {s: {r["doc_id"] for r in C.search(docs, bench, slop=s).collect() if r["items"]} for s in (0, 1, 4)}
    assert near[0] == {0} and near[1] == {0, 1} and near[4] >= {0, 1, 2, 3}


def test_intersect():
    lists = [np.array([5, 9, 30]), np.array([6, 10, 12, 31]), np.array([4, 8, 29])]
    assert C.intersect(lists, [1, 2, 0]).tolist() == [4, 8, 29]
    assert C.intersect(lists[:2], [0, 5]).tolist() == [5]
    assert C.intersect(lists[:2], [0, 6]).tolist() == []
    assert C.intersect(lists[:2], [0, 6], 1).tolist() == [4, 5, 6]


# ------------------------------------------------------------------------ PII
PERSONAL = ["mail a.b+c@x-y.co.uk, or x@y", "a@b.c@d.e f@g.h_i@j.k", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 1.2.3",
            "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111  1111 1111 1111", "4" * 16 + " " + "0" * 17,
            "+49 (30) 1234-567. +1-2 ++12345678 +1 234 567 890 123 456 78", "é😀 tel +33 1 23 45 67 89 😀 x@é.com ü@a.bc",
            "call 030 1234-5678 or (030) 123 4567", "write bob [at] example [dot] com", "4111111111111111+4915112345678@a.b"]


def check_spans(row, text):
    base = base_spans(text)
    assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), text[:200]
    assert [row[f"n_{k}"] for k, _ in PII] == [sum(s.startswith(k + ":") for s in base) for k, _ in PII]
    found = row["spans"].split(",") if row["spans"] else []
    assert set(base) <= set(found)
    order = [*[k for k, _ in PII], *pii.MORE_KINDS]
    keys = [(order.index(s.split(":")[0]), int(s.split(":")[1]), int(s.split(":")[2])) for s in found]
    assert keys == sorted(keys) and all(0 <= a < b <= len(text) for _, a, b in keys)


def test_spans_of_made_texts(spark):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id bigint, text string")
    rows = pii.find(df).collect()
    for r in rows:
        check_spans(r, PERSONAL[r["doc_id"]])
    assert {r["doc_id"] for r in rows if r["spans"]} >= {0, 1, 2, 3, 5, 6, 9}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("0123456789.-+ ()@ab_%é")), max_size=60), min_size=30, max_size=60))
def test_spans_of_random_texts(spark, many):
    df = spark.createDataFrame(list(enumerate(many)), "doc_id bigint, text string")
    for r in pii.find(df).collect():
        check_spans(r, many[r["doc_id"]])


def test_spans_of_documents_and_odd_rows(documents, odd, empty):
    known = dict(texts(documents))
    rows = pii.find(documents).collect()
    assert len(rows) == len(known)
    for r in rows:
        check_spans(r, known[r["doc_id"]])
    got = pii.find(odd).collect()
    assert len(got) == odd.count() and sum(r["spans"] == "" for r in got) > 10
    assert pii.find(empty).count() == 0


def test_long_texts_neither_recurse_nor_stall(spark):
    long = ["1 " * 40_000, "a." * 40_000 + "@" + "b." * 40_000 + "c", "1." * 40_000, "+" + "1" * 80_000, "x" * 200_000 + "@"]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert got[1]["n_email"] == 1 and got[2]["n_ip"] == 10_000 and got[4]["n_email"] == 0


def remainder(iban):
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def test_account_numbers_by_their_remainder(spark):
    known = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", "DE89 3704 0044 0532 0130 01"]
    df = spark.createDataFrame([(k,) for k in known], "match string")
    from pyspark.sql import functions as F
    got = df.select("match", pii.iban_remainder(F.col("match")).alias("r"), pii.form(F.lit("iban"), F.col("match"), F.lit(0)).alias("ok")).collect()
    assert [r["r"] for r in got] == [remainder(k) for k in known]
    assert [r["ok"] for r in got] == [True, True, True, False]


def private_texts(rng):
    """(text, what it plants or None): numbers, keys and what only looks like them."""
    word = lambda: "".join(rng.choices("abdeghilmnorstu", k=rng.randint(3, 9)))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    made = {"card": lambda: "4" + digits(15), "secret": lambda: f'token = "{rng.getrandbits(160):040x}"',
            "ssn": lambda: f"ssn {rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
            "iban": lambda: next(x for x in (f"DE{k:02d}37040044{digits(10)}" for k in range(2, 99) for _ in range(97)) if remainder(x) == 1),
            "phone": lambda: f"call ({digits(3)}) {digits(3)}-{digits(4)}", None: lambda: rng.choice(
                ["order " + digits(14), "sha256: " + f"{rng.getrandbits(256):064x}", "in 1999 and 2004", digits(30), "a = " + word() * 3, "XX12 " + word()])}
    for kind in [*made] * 60:
        yield " ".join([*(word() for _ in range(12)), made[kind](), *(word() for _ in range(9))]), kind


def test_planted_data_is_found_and_clean_text_left_alone(spark):
    known = list(private_texts(random.Random(11)))
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(known)], "doc_id bigint, text string")
    caught = {r["doc_id"]: {s.split(":")[0] for s in r["spans"].split(",")} - {""} for r in pii.find(df).collect()}
    for kind in {k for _, k in known}:
        own = [caught[k] for k, (_, planted) in enumerate(known) if planted == kind]
        if kind is None:
            assert [k for k, (_, planted) in enumerate(known) if planted is None and caught[k]] == []
        else:
            assert sum(kind in found for found in own) >= 0.9 * len(own), kind


def test_em_finds_the_good_labelers(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        right = rng.random() < 0.4
        says = lambda good: int(right if rng.random() < good else not right)
        rows.append(([1 if right and rng.random() < 0.7 else -1, says(0.95), says(0.6), 1 if right and rng.random() < 0.3 else -1,
                      0 if not right and rng.random() < 0.5 else -1, says(0.8)],))
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "votes array<int>").groupBy("votes").agg(F.count("*").alias("n"))
    state = df.agg(pii.reliabilities(F.collect_list(F.struct("votes", "n"))).alias("s")).first()["s"]
    assert abs(state["prior"] - 0.4) < 0.05
    assert state["hit"][1] > 0.9 > state["hit"][5] > state["hit"][2] and state["miss"][1] < 0.1


def test_no_python_runs_on_the_main_path(documents):
    plan = pii.find(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ------------------------------------------------------------- language model
def check_scores(df, **how):
    docs = texts(df)
    model = Trigrams(docs, L.DISCOUNT, how.get("least", L.LEAST))
    rows = L.score(df, **how).collect()
    assert len(rows) == len(docs)
    want = sorted(((i, len(lm_words(t)) + 1, *map(lambda x: round(x, 6), model.scores(t))) for i, t in docs), key=repr)
    got = sorted(((r["doc_id"], r["n_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows), key=repr)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9, abs=2e-6)
    assert {r["train_tokens"] for r in rows} == {model.n}
    by_id = dict(docs)
    for r in rows:
        if list(by_id).count(r["doc_id"]) == 1 and r["doc_id"] in by_id and sum(i == r["doc_id"] for i, _ in docs) == 1:
            assert r["n_known"] == sum(model.c[w] > 0 for w in [*lm_words(by_id[r["doc_id"]]), None])
    return rows


@pytest.mark.parametrize("how", [{}, {"least": 1}, {"lane": 5}])
def test_scores_of_documents(documents, how):
    rows = check_scores(documents, **how)
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_odd_rows(odd, empty):
    check_scores(odd)
    check_scores(odd, lane=7)
    assert L.score(empty).count() == 0


def test_scores_match_sql(spark):
    """All rows of sf0.01; sums of doubles agree but for their order."""
    import duckdb
    from stagelight.llm.registry import QUERIES
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.execute(L.SCORES_SQL)
    columns = [c[0] for c in want.description]
    want = sorted(want.fetchall())
    got = QUERIES["op4_backoff_automaton"](spark, "/root/testdata/sf0.01")
    assert sorted(got.columns) == sorted(columns)
    got = sorted(tuple(r) for r in got.select(columns).collect())
    assert len(got) == len(want) == 1000
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_buckets_follow_the_tokens(documents, monkeypatch):
    monkeypatch.setattr(L, "BUCKET_TOKENS", 700)
    check_scores(documents)


def test_arcs_of_each_context_sum_to_one():
    corpus = ["a b c a b", "a b a b c", "c c a b", "b a"]
    words = sorted({w for t in corpus for w in t.split()})
    brute = Trigrams([(0, t) for t in corpus * 3], L.DISCOUNT)
    for g, h in itertools.product([None, *words], words):
        total = sum(brute.p3(g, h, w) for w in [*words, None]) + brute.p3(g, h, "unknown")
        assert total == pytest.approx(1, abs=1e-12)


def automaton(corpus):
    """A slice's automaton, counted here, and its word numbers."""
    seen = [[*t.split(), None] for t in corpus]
    hashes = {w: L.word_hash(w.encode()) if w else 0 for t in seen for w in t}
    distinct, tokens = np.unique(np.array([hashes[w] for t in seen for w in t], np.uint64), return_inverse=True)
    lengths = np.array([len(t) for t in seen], "<i8")
    own = L.levels({"tokens": tokens.astype("<u4").tobytes(), "words": distinct.tobytes(), "lengths": lengths.tobytes()}, 3)
    counts = [np.bincount(level.at[level.at >= 0], minlength=len(level.keys)) for level in own]
    kept = [counts[0], *(np.where(c >= 2, c, 0) for c in counts[1:])]
    answers = []
    for k, c in enumerate(kept):
        sums = continued = np.zeros(len(c), np.int64)
        if k < 2:
            on = kept[k + 1] > 0
            sums = np.bincount(own[k + 1].contexts[on], kept[k + 1][on], len(c)).astype(np.int64)
            continued = np.bincount(own[k + 1].contexts[on], minlength=len(c))
        answers.append((c, None, sums, continued))
    numbers = {w: int(np.searchsorted(distinct, h)) for w, h in hashes.items()}
    return L.machine(own, answers, int(counts[0].sum()), int((counts[0] > 0).sum())), numbers


def test_one_walk_arc_by_arc_equals_the_lanes(spark):
    """Each text walked alone, a dictionary for the arcs, following failure arcs one by one."""
    corpus = ["a b c a b", "a b a b c", "c c a b", "b a", "a b c a b c a b c c c b b a"]
    model, numbers = automaton(corpus)
    assert len(model.arcs) and len(model.fail) > 1 + model.words  # states of two words
    arcs = {divmod(int(a), model.words): (c, int(t)) for a, c, t in zip(model.arcs, model.cost, model.to)}
    brute = Trigrams([(0, t) for t in corpus], L.DISCOUNT)
    for text in [*corpus, "c b a a b c", "b b b c a b", ""]:
        state, total, taken = model.begin, 0.0, 0
        for w in [*text.split(), None]:
            word = numbers[w]
            while state and (state, word) not in arcs:
                total += model.weight[state]
                state, taken = int(model.fail[state]), taken + 1
            cost, state = arcs[state, word] if state else (model.base[word], int(model.home[word]))
            total += cost
        assert total == pytest.approx(brute.scores(text)[1], abs=1e-9)
        tokens = np.array([numbers[w] for w in [*text.split(), None]])
        for lane in (1, 2, 5, 100):
            assert model.traverse(tokens, np.array([len(tokens)]), 3, lane).sum() == pytest.approx(total, abs=1e-9)
        assert taken or text in corpus


def test_rare_ngrams_count_however_large_the_corpus_is(spark):
    docs = [(0, "x " * 2_500_000), (3, "p q r"), (5, "p q r"), (6, "s p q r t")]
    model = Trigrams(docs, L.DISCOUNT, L.LEAST)
    assert ("p", "q", "r") in model.k3 and model.n > 2_400_000
    rows = L.score(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    for r in rows:
        if r["doc_id"]:
            assert (r["base_score"], r["score"]) == pytest.approx(model.scores(dict(docs)[r["doc_id"]]), abs=1e-9)
    assert len(rows) == 4
