"""Whole texts to token ids with a public tokenizer, at the cost of one call per distinct piece of text.

A text is cut where a tokenizer's own splitting rule cuts it in any case: before a single space or line feed between two
visible characters, after such a line feed, and between a Latin letter and a stop. Ids of the pieces end to end are therefore
the ids of the text. Pieces met before are looked up by a 64-bit hash; the memory of known pieces is bounded and starts anew
when full. A new piece that is a plain Latin word goes straight to the tokenizer's merges, if that gives what the whole
tokenizer gives on words tried at the start.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from docvault.llm import words as W

KNOWN_IDS = 4_000_000       # ids held for known pieces, per worker
KNOWN_PIECES = 1_200_000    # pieces held
_LEAST_SLOTS = 16           # two to this power: slots of the look-up table at first
CHUNK_BYTES = 4 << 20


_LETTERS = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_STOPS = np.isin(np.arange(256), list(b".,;:!?"))
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_TRIED = [" the", "The", " Straße", "été", " ÀÉ", "ñandú", " internationalisation", "X", " a", "Zoë", " qzxv"]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of all texts; every byte belongs to one piece and none reaches into the next text."""
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        # A character whose first byte is C2 or E1-E3 may be white space beyond ASCII; nothing is cut beside it.
        white = raw <= 0x20
        lead = (raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3))
        after = np.zeros(n, bool)
        after[:-1] = ~white[1:] & ~lead[1:]
        before = np.zeros(n, bool)
        before[1:] = ~white[:-1]
        before[2:] &= ~(lead[:-2] & (raw[1:-1] >= 0x80))
        before[3:] &= ~(lead[:-3] & (raw[1:-2] >= 0x80) & (raw[2:-1] >= 0x80))
        lone = ((raw == 0x20) | (raw == 0x0A)) & after & before
        lone[offsets[:-1][offsets[:-1] < n]] = False
        lone[offsets[1:][offsets[1:] > 0] - 1] = False
        letter = _LETTERS[raw]
        # Letters from C3 80 to C3 BF, without the two signs among them.
        letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        cut[:-1] = lone
        cut[1:-1] |= letter[:-1] & _STOPS[raw[1:]]
        cut[1:] |= lone & (raw == 0x0A)
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


def expand(at: np.ndarray, lengths: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Runs ``pool[at:at + length]`` end to end."""
    ends = np.cumsum(lengths)
    return pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - ends + lengths, lengths)]


class Known:
    """A table from 64-bit hashes to numbers in two flat arrays, at most half full; all look-ups of a text's pieces go together."""

    def __init__(self):
        self._empty(_LEAST_SLOTS)

    def _empty(self, bits: int) -> None:
        self.bits, self.count = bits, 0
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _grow(self, room: int) -> None:
        """Make place for so many keys; those that are there move."""
        if 2 * room > len(self.keys):
            full = np.flatnonzero(self.keys)
            keys, numbers = self.keys[full], self.numbers[full]
            self._empty((2 * room - 1).bit_length())
            self.add(keys, numbers)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, or -1."""
        out, open_, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys)
        while len(open_):
            met = self.keys[slot[open_]]
            hit = met == keys[open_]
            out[open_[hit]] = self.numbers[slot[open_[hit]]]
            open_ = open_[~hit & (met != 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        self._grow(self.count + len(keys))
        self.count += len(keys)
        open_, slot = np.arange(len(keys)), self._slot(keys)
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.numbers[slot[first]] = keys[first], numbers[first]
            open_ = open_[self.keys[slot[open_]] != keys[open_]]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """A tokenizer with the pieces it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.letters, self.direct = _byte_letters(), None
        whole = [x.ids for x in self.tokenizer.encode_batch_fast(_TRIED, add_special_tokens=False)]
        for prepare in (lambda t: t, lambda t: t.strip(), lambda t: t.strip().lower()):
            if [self._merge(prepare(t)) for t in _TRIED] == whole:
                self.direct = prepare
                break
        self._clear()

    def _merge(self, text: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        found: list = [self._merge(self.direct(t)) if self.direct and _WORD.fullmatch(t) else None for t in texts]
        other = [k for k, ids in enumerate(found) if ids is None]
        for k, made in zip(other, self.tokenizer.encode_batch_fast([texts[k] for k in other], add_special_tokens=False), strict=True):
            found[k] = made.ids
        return found

    def _clear(self):
        self.known, self.count = Known(), 0
        self.at, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.pool, self.used = np.zeros(1 << 18, np.int32), 0

    def _learn(self, keys: np.ndarray, texts: list[str]) -> np.ndarray:
        """Numbers of new pieces."""
        found = self._ids(texts)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        numbers = np.arange(self.count, self.count + len(keys))
        ends = self.used + np.cumsum(lengths)
        while len(self.at) < self.count + len(keys):
            self.at, self.length = np.resize(self.at, 2 * len(self.at)), np.resize(self.length, 2 * len(self.at))
        if int(ends[-1]) > len(self.pool):
            self.pool = np.resize(self.pool, int(ends[-1]) + len(self.pool) // 2)
        self.pool[self.used:int(ends[-1])] = np.fromiter((i for ids in found for i in ids), np.int32, int(lengths.sum()))
        self.at[numbers], self.length[numbers] = ends - lengths, lengths
        self.known.add(keys, numbers)
        self.count, self.used = self.count + len(keys), int(ends[-1])
        return numbers

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, starts of the pieces in bytes, ids before each piece (pieces + 1)."""
        starts = piece_starts(raw, offsets)
        ends = np.append(starts[1:], len(raw))
        hashes = pa.array(np.maximum(W.span_hashes(raw, starts, ends), np.uint64(1))).dictionary_encode()
        keys, which = hashes.dictionary.to_numpy(), hashes.indices.to_numpy()
        if self.used > KNOWN_IDS or self.count > KNOWN_PIECES:
            self._clear()
        slots = self.known.find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            first = np.empty(len(keys), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            slots[new] = self._learn(keys[new], [raw[starts[i]:ends[i]].tobytes().decode("utf-8") for i in first[new]])
        of = slots[which] if len(which) else np.zeros(0, np.int64)
        lengths = self.length[of].astype(np.int64)
        before = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        return expand(self.at[of].astype(np.int64), lengths, self.pool), starts, before

    def documents(self, column, most: int = CHUNK_BYTES):
        """For runs of documents: first document, ids, ids before each document (len + 1), raw bytes, piece starts, ids before pieces.

        A run has about ``most`` bytes, and the arrays of a run several times as many.
        """
        raw, offsets = W.utf8(column)
        for low, high in W.chunks(offsets, most):
            part, own = raw[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
            ids, starts, before = self.encode(part, own)
            yield low, ids, before[np.searchsorted(starts, own)], part, starts, before


def encoder(path: str) -> Encoder:
    return W.worker_cache(f"encoder {path}", lambda: Encoder(path))
