"""Byte-pair encoding by backtracking, and decoding by offsets.

An Aho-Corasick automaton of the vocabulary finds the longest token that begins at each byte of a piece. The encoder takes
the longest one, goes on from its end and steps back to the next shorter token where two neighbours would have been merged
otherwise. Whether two tokens may stand side by side doesn't depend on the rest of the text: it is settled by undoing their
merges, latest first, and kept in a table of pairs. A prefix of a piece has one encoding only, so a place that leads nowhere is
marked once and the work is linear in the length of the piece, however long it is.

Pieces come from the tokenizer's own splitting rule; ids of pieces met before are looked up (``pieces.Encoder``). Special
tokens inside a text count as such, as they do in the tokenizers library. Decoding lays all token bytes end to end and gathers
them by offset; bytes that aren't UTF-8 become U+FFFD, ids without a token give nothing.

A null or empty text has no ids. Texts are never cut, whatever their length. Rows that share an id or are repeated give a row
each, a null id stays null, an empty table gives an empty result. Only the two named columns are read, so no other can clash.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvault.llm import words as W
from docvault.llm.pieces import Encoder, expand

KNOWN_PAIRS = 1 << 19       # pairs in the table of compatible neighbours before it starts anew
NEVER = 1 << 40
_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """Character that stands for each byte in the vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Vocabulary:
    """Tokens with the two parts each was merged from, and the pairs that may stand side by side."""

    def __init__(self, names: dict[str, int], merges: list[tuple[str, str]]):
        size = max(names.values()) + 1
        self.length, self.rank, self.left, self.right = [0] * size, [-1] * size, [-1] * size, [-1] * size
        for name, i in names.items():
            self.length[i] = len(name)
        self.merged, self.known = {}, {}
        for rank, (a, b) in enumerate(merges):
            one, two, whole = names[a], names[b], names[a + b]
            if self.rank[whole] >= 0 or rank <= max(self.rank[one], self.rank[two]):
                raise ValueError(f"token {whole} isn't made by one merge of earlier tokens")
            self.rank[whole], self.left[whole], self.right[whole] = rank, one, two
            self.merged[(one, two)] = rank
        # A token that its own bytes don't give can't occur; it is left out of the automaton.
        occurs = [False] * size
        for i in sorted(names.values(), key=self.rank.__getitem__):
            a, b = self.left[i], self.right[i]
            occurs[i] = self.length[i] == 1 if a < 0 else occurs[a] and occurs[b] and self.undone(a, b, self.rank[i])
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * size
        for name, i in names.items():
            if occurs[i]:
                self.automaton.add_word(name, i)
                self.shorter[i] = next((j for n in range(len(name) - 1, 0, -1) if (j := names.get(name[:n], -1)) >= 0 and occurs[j]), -1)
        self.automaton.make_automaton()

    def undone(self, a: int, b: int, limit: int = NEVER) -> bool:
        """Whether no merge earlier than ``limit`` joins anything across the border of two tokens."""
        rank, left, right, merged = self.rank, self.left, self.right, self.merged
        while True:
            if merged.get((a, b), NEVER) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], right[a]
            elif rank[b] < 0:
                return True
            else:  # of equal merges the left one comes first
                limit, b = rank[b] + 1, left[b]

    def compatible(self, a: int, b: int) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= KNOWN_PAIRS:
                self.known.clear()
            found = self.known[(a, b)] = self.undone(a, b)
        return found

    def encode(self, piece: str) -> list[int]:
        """Ids of a piece that is written in byte letters."""
        n, length, shorter, compatible = len(piece), self.length, self.shorter, self.compatible
        longest = [-1] * n
        for last, i in self.automaton.iter(piece):  # of equal starts the longer one comes later
            longest[last + 1 - length[i]] = i
        out, at, leads = [], 0, bytearray(b"\1") * (n + 1)
        i = longest[0] if n else -1
        while at < n:
            end = at + length[i]
            if leads[end] and (not out or compatible(out[-1], i)):
                out.append(i)
                at = end
                i = longest[at] if at < n else -1
                continue
            i = shorter[i]
            while i < 0:
                if not out:
                    raise ValueError(f"bytes without a token: {piece[at:at + 20]!r}")
                leads[at] = 0
                i = out.pop()
                at -= length[i]
                i = shorter[i]
        return out


class Coder(Encoder):
    """A tokenizer file of the byte-level kind: encodes by ``Vocabulary``, decodes by offsets."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level tokenizer")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special tokens with conditions aren't known here")
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in added}
        names = {name: i for name, i in model["vocab"].items() if name not in self.special}
        self.vocabulary = Vocabulary(names, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        own = {c: b for b, c in self.letters.items()}
        tokens = {i: bytes(own[c] for c in name) for name, i in names.items()} | {i: t.encode() for t, i in self.special.items()}
        sizes = np.array([len(tokens.get(i, b"")) for i in range(max(tokens) + 1)], np.int64)
        self.size, self.offset = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(sizes))), np.uint8)
        self._clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [self._piece(t) for t in texts]

    def _piece(self, text: str) -> list[int]:
        if _LETTERS.fullmatch(text):
            return self.vocabulary.encode(text.encode().decode("latin-1").translate(self.letters))
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for piece, _ in self.split(part):
                    out += self.vocabulary.encode(piece)
        return out

    def decode(self, ids: np.ndarray, before: np.ndarray) -> pa.Array:
        """Texts of runs of ids; ``before`` is the number of ids before each text (len + 1)."""
        ids = np.where((ids >= 0) & (ids < len(self.size)), ids, len(self.size)).astype(np.int64)
        size, offset = np.append(self.size, 0), np.append(self.offset, 0)
        lengths = size[ids]
        at = np.concatenate([[0], np.cumsum(lengths)])[before]
        raw = expand(offset[ids], lengths, self.bytes)
        inner = at[(at > 0) & (at < len(raw))]
        try:
            if (raw[inner] & 0xC0 == 0x80).any():  # a text begins inside a character
                raise ValueError
            raw.tobytes().decode("utf-8")
        except ValueError:
            return pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
        return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])


def coder(path: str) -> Coder:
    return W.worker_cache(f"byte pairs {path}", lambda: Coder(path))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` (array of int, never null) of every row; with ``decoded`` also the text that the ids give back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer)
        for batch in W.slices(batches):
            for low, ids, before, *_ in own.documents(batch.column(1)):
                found = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(ids.astype(np.int32)))
                columns = [batch.column(0).slice(low, len(before) - 1), found]
                yield pa.RecordBatch.from_arrays(columns + ([own.decode(ids, before)] if decoded else []), ["doc_id", "ids", "decoded"][:len(columns) + decoded])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of every row of ids; null ids give an empty text, a null id in an array gives nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer)
        for batch in W.slices(batches, 256):
            lists = batch.column(1)
            sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            ids = pa.compute.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), own.decode(ids, np.concatenate([[0], np.cumsum(sizes)]))], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")
