"""Token ids by the tokenizers library, with a bounded cache per Python worker.

The vocabulary's pre-tokenizer always cuts before a lone space that stands
between two other characters, and around a lone line feed, so texts are cut
there and each unit is encoded once. Texts with other white space, or white
space in a row, are encoded whole. Both give the ids of the whole text.
"""

from __future__ import annotations

import array
import gc
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import GIVE_UP

#: Units a worker remembers, about 40 bytes each.
CACHE_UNITS = 1_500_000
_ENCODERS: dict[str, "Encoder"] = {}
GIVE_UP.append(_ENCODERS.clear)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def encoder(vocabulary: str) -> "Encoder":
    """This worker's encoder for a vocabulary: a file's path, or the name of one
    of the public files, which is then looked up where the task runs."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary if "/" in vocabulary else vocabulary_path(vocabulary))
    return _ENCODERS[vocabulary]


def odd_space(text: str) -> bool:
    """Whether a text has white space (or a control character) besides lone
    spaces and lone line feeds."""
    return ("  " in text or "\n\n" in text or " \n" in text or "\n " in text
            or not text.replace("\n", " ").isprintable())


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: visible
    Latin-1 characters stand for themselves, the others follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class UnitStore:
    """The ids of known units in one Arrow array, found by the sorted 64-bit hashes
    of the units; no Python object is kept for any of them."""

    def __init__(self, limit: int):
        self.limit = limit
        self.hashes, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids = pa.array([], pa.large_binary())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash in ``ids``, -1 for unknown ones."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        return np.where(self.hashes[at] == hashes, self.rows[at], -1)

    def add(self, hashes: np.ndarray, ids: list[bytes], keep: np.ndarray) -> None:
        """Adds unknown units. Beyond the limit only the rows ``keep`` stay beside them."""
        if len(self.rows) + len(ids) > self.limit:
            own = np.isin(self.rows, keep)
            self.hashes, rows = self.hashes[own], self.rows[own]
            self.ids, self.rows = self.ids.take(pa.array(rows)), np.arange(len(rows))
        self.rows = np.r_[self.rows, len(self.ids) + np.arange(len(ids))]
        self.hashes = np.r_[self.hashes, hashes]
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.rows = self.hashes[order], self.rows[order]
        self.ids = pa.concat_arrays([self.ids, pa.array(ids, pa.large_binary())])


class Encoder:
    def __init__(self, path: str, units: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.letters = byte_letters()
        self.marks = dict(zip(".,", self._ids([".", ","])))
        self.store = UnitStore(units or CACHE_UNITS)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, word: str) -> bytes:
        """Ids of a word of letters, with or without a space before: the
        pre-tokenizer keeps it whole, so the model is asked directly."""
        if word.isascii():
            word = "\u0120" + word[1:] if word[0] == " " else word
        else:
            word = word.encode().decode("latin-1").translate(self.letters)
        return array.array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def unit_ids(self, units: list[str]) -> list[bytes]:
        """Ids of units: words with or without a space before, or anything else
        that the pre-tokenizer never joins with what stands around it."""
        out, rest = [b""] * len(units), []
        stems: dict[str, bytes] = {}
        for k, u in enumerate(units):
            if u.lstrip(" ").isalpha() and u[:2] != "  ":
                out[k] = self._word_ids(u)
                continue
            stem = u[:-1]
            if u[-1:] in self.marks and stem.lstrip(" ").isalpha() and stem[:2] != "  ":  # a word, then a mark
                if stem not in stems:
                    stems[stem] = self._word_ids(stem)
                out[k] = stems[stem] + self.marks[u[-1]]
            else:
                rest.append(k)
        for k, ids in zip(rest, self._ids([units[k] for k in rest])):
            out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as native (little-endian) unsigned 32-bit integers."""
        collecting = gc.isenabled()
        gc.disable()  # millions of small objects, no cycles: the collector would only walk them
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _known(self, units: pa.Array) -> np.ndarray:
        """The store's row of each unit; unknown ones are encoded and added."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, units.to_pylist()), np.uint64, len(units))
        rows = self.store.find(hashes)
        new = np.flatnonzero(rows < 0)
        if len(new):
            self.store.add(hashes[new], self.unit_ids(units.take(pa.array(new)).to_pylist()), rows[rows >= 0])
            rows = self.store.find(hashes)
        return rows

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        odd, even = [], []
        for i, t in enumerate(texts):
            (odd if odd_space(t) else even).append(i)
        for i, ids in zip(odd, self._ids([texts[i] for i in odd])):
            out[i] = ids
        if not even:
            return out
        # units as an Arrow dictionary: each distinct unit is looked up once, and
        # the ids of all are gathered by one take
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(
            pa.array([texts[i] for i in even], pa.large_string()), " ", "\x00 "), "\n", "\x00\n\x00"), "\x00")
        units = cut.flatten().dictionary_encode()
        rows = self._known(units.dictionary)
        ids = self.store.ids.take(pa.array(rows[units.indices.to_numpy()]))
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        places = ends[cut.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for i, a, b in zip(even, places, places[1:]):
            out[i] = bytes(data[a:b])
        return out
