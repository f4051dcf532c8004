from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stagelight.llm import fertility as M
from stagelight.llm.common import ship

from .brute import token_ids
from .conftest import texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pieces(word):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    if not hasattr(pieces, "p"):
        pieces.p = SentencePieceProcessor(model_file=str(public_tokenizers.path(M.PIECE_VOCABULARY)))
    return pieces.p.encode(word), pieces.p.IsByte


def brute(text):
    """n_words ... n_repeat_words, then the three measures in steps."""
    words = WORD.findall(text)
    lines, windows = text.split("\n"), Counter(zip(words, words[1:], words[2:]))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
    dup = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
    ids = Counter(i for w in words for i in token_ids(" " + w))
    n = sum(ids.values())
    found = [i for w in words for i in pieces(w)[0]]
    even = -sum(c / n * math.log2(c / n) for c in ids.values()) / math.log2(n) if n > 1 else 1.0
    chars = sum(map(len, words))
    return (len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), round(1000 * chars / max(1, n)),
            round(1000 * sum(map(pieces("a")[1], found)) / max(1, len(found))), 1000 * even)


def check(rows, docs):
    """``rows`` against brute force, bands from numpy's quartiles."""
    want = sorted(((i, lang, *brute(t)) for i, t, lang in docs), key=lambda r: repr(r[:6]))
    got = sorted(rows, key=lambda r: repr((r["doc_id"], r["lang"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"])))
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert (r["doc_id"], r["lang"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                r["chars_per_token"], r["byte_share"]) == w[:9]
        assert abs(r["evenness"] - w[9]) <= 0.51
        assert r["base_failed"] == (w[2] < 50 or 100 * w[6] > 50 * w[2])
    for band in {r["band"] for r in got}:
        own = [r for r in got if r["band"] == band]
        left = [r for r in own if not r["base_failed"]]
        for r in own:
            inside = True
            for m, extra in M.TOLERANCE.items():
                if left:
                    low, high = np.percentile([x[m] for x in left], [25, 75])
                    reach = M.FENCE * (high - low) + extra
                    inside &= low - reach <= r[m] <= high + reach
            assert r["kept"] == (not r["base_failed"] and inside)


def test_documents_match_brute_force(spark, documents):
    ship(spark)
    rows = M.judge(documents).collect()
    check(rows, [(r["doc_id"], r["text"] or "", r["lang"]) for r in documents.collect()])


def test_odd_rows(spark, odd):
    ship(spark)
    rows = M.judge(odd).collect()
    check(rows, [(i, t, None) for i, t in texts(odd)])
    assert {r["script"] for r in rows if r["n_words"] == 0} == {"NONE"}
    assert all(r["band"].startswith("script ") for r in rows)


def test_junk_leaves_the_band_and_prose_stays(spark, documents):
    ship(spark)
    prose = documents.where((F.length("text") > 600) & (F.col("lang") == "en")).select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(-1, "".join(chr(0x4E00 + k * 37 % 9000) + " " for k in range(300)), "en"),
                                  (-2, " ".join(chr(97 + k * k * k // 7 % 26) for k in range(200)), "en")],
                                 "doc_id bigint, text string, lang string")
    rows = {r["doc_id"]: r for r in M.judge(prose.unionByName(junk)).collect()}
    assert not rows[-1]["kept"] and not rows[-2]["kept"] and not rows[-1]["base_failed"]
    own = [r for i, r in rows.items() if i >= 0 and not r["base_failed"]]
    assert sum(r["kept"] for r in own) >= 0.95 * len(own)


def test_windows_of_many_different_words():
    codes = np.array([5 << 21, 1, 2, 9, 5 << 21, 1, 2, 7], np.int64)
    assert M.repeated_words(codes) == M.repeated_words(np.array([5, 1, 2, 9, 5, 1, 2, 7])) == 6


def test_a_long_text_is_cut_between_words(monkeypatch):
    m = M.meter(M.BYTE_VOCABULARY, M.PIECE_VOCABULARY)
    text = b"alpha beta\tgamma " * 50
    whole = m.codes(text)
    monkeypatch.setattr(M, "CHUNK", 7)
    assert (m.codes(text) == whole).all() and len(whole) == 150


def test_empty(spark, empty):
    ship(spark)
    assert M.judge(empty).count() == 0
