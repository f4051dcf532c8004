"""Plain-Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def a_to_z(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def token_ids(text: str) -> list[int]:
    import public_tokenizers
    from tokenizers import Tokenizer
    if not hasattr(token_ids, "tokenizer"):
        token_ids.tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        token_ids.tokenizer.encode_special_tokens = True
    return token_ids.tokenizer.encode(text, add_special_tokens=False).ids


def crc_of_ids(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _valid(kind: str, found: str) -> bool:
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def base_spans(text: str) -> list[str]:
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PII for m in re.finditer(p, text) if _valid(k, m.group())]


def shingle_set(text: str) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", a_to_z(text))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def near_components(docs: list[tuple]) -> dict:
    """(doc_id, set) -> smallest linked id; all pairs are compared."""
    nodes = sorted({(i, shingle_set(t)) for i, t in docs if i is not None}, key=lambda x: (x[0], len(x[1])))
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(nodes):
        for y in range(x):
            b = nodes[y][1]
            common = len(a & b)
            if common and 100 * common >= 75 * (len(a) + len(b) - common):
                parent[max(find(x), find(y))] = min(find(x), find(y))
    return {n: nodes[find(k)][0] for k, n in enumerate(nodes)}


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", a_to_z(text))


def contamination(text: str, items: list[tuple]) -> tuple:
    words = plain_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        own = plain_words(item)
        n = min(13, len(own))
        windows = {tuple(own[k:k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k:k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(item_id)
    names = ",".join(sorted(str(i) for i in found if i is not None))
    return (len(words), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(words))


def lm_words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", a_to_z(text))


class Trigrams:
    """The interpolated model, from counts in dictionaries."""

    def __init__(self, docs: list[tuple], discount: float, least: int = 2):
        self.c, self.n2, self.n3, self.d = Counter(), Counter(), Counter(), discount
        for i, text in docs:
            if zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2:
                continue
            seen = [None, *lm_words(text), None]
            self.c.update(seen[1:])
            self.n2.update(zip(seen, seen[1:]))
            self.n3.update(zip(seen, seen[1:], seen[2:]))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.k2 = {k: v for k, v in self.n2.items() if v >= least}
        self.k3 = {k: v for k, v in self.n3.items() if v >= least}
        self.s2, self.s3 = defaultdict(float), defaultdict(float)
        for k, v in self.k2.items():
            self.s2[k[0]] += v - discount
        for k, v in self.k3.items():
            self.s3[k[:2]] += v - discount

    def p1(self, w):
        return (self.c[w] + 1) / (self.n + self.v + 1)

    def p2(self, h, w):
        back = (1 - self.s2[h] / self.c[h] if h in self.s2 else 1.0) * self.p1(w)
        return (self.k2[h, w] - self.d) / self.c[h] + back if (h, w) in self.k2 else back

    def p3(self, g, h, w):
        if (g, h) not in self.k2:
            return self.p2(h, w)
        back = (1 - self.s3.get((g, h), 0) / self.n2[g, h]) * self.p2(h, w)
        return (self.k3[g, h, w] - self.d) / self.n2[g, h] + back if (g, h, w) in self.k3 else back

    def scores(self, text: str) -> tuple[float, float]:
        seen = [None, *lm_words(text), None]
        full = sum(math.log10(self.p3(*seen[k - 2:k + 1]) if k > 1 else self.p2(None, seen[1])) for k in range(1, len(seen)))
        return sum(math.log10(self.p1(w)) for w in seen[1:]), full
