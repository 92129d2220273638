"""Language identification by a convolutional network over bytes, trained in numpy.

Filters of several widths slide over the bytes of a fixed-length window; the maximum of each filter over the window feeds a
softmax. A text is cut into windows that cover all of it; the language is the one with the largest sum of log
probabilities, the score the mean probability that its windows give it.

A null text, or one without a letter, is ``und`` with score 0. The training sample is bounded (``per_language`` documents of
each language, ``windows`` places in each); a language without training rows can't be predicted. Without any training rows
every text is ``und``. A null id is in no part of the split: not learned from, not held out. Repeated rows are judged alike.
Columns beside the named ones aren't read; a kept column may not have the name of a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvault.llm import words as W
from docvault.llm.sending import received, send
from docvault.session import lookup_join

WINDOW = 256                # bytes
WIDTHS = (2, 3, 4)
FILTERS = 16                # of each width
DEPTH = 8                   # of a byte's embedding
UNKNOWN = "und"
BATCH = 96


class ByteNetwork:
    """Embedding, filters of all widths side by side in one matrix (narrow ones padded by zeros), softmax."""

    def __init__(self, classes: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.p = {"embed": draw.normal(0, 0.5, (256, DEPTH)), "filters": draw.normal(0, (DEPTH * 3) ** -0.5, (max(WIDTHS) * DEPTH, FILTERS * len(WIDTHS))),
                  "shift": np.zeros(FILTERS * len(WIDTHS)), "out": draw.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)), "bias": np.zeros(classes)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.mask = np.ones_like(self.p["filters"])
        for k, width in enumerate(WIDTHS):
            self.mask[width * DEPTH:, k * FILTERS:(k + 1) * FILTERS] = 0
        self.p["filters"] *= self.mask
        self.p["embed"][0] = 0

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        x = self.p["embed"][windows]
        n, length = windows.shape
        places = length - max(WIDTHS) + 1
        view = np.lib.stride_tricks.as_strided(x, (n, places, max(WIDTHS) * DEPTH), x.strides)
        return np.ascontiguousarray(view).reshape(n * places, -1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of each class for each window (rows of ``WINDOW`` bytes, zeros at the end)."""
        out = np.empty((len(windows), len(self.p["bias"])), np.float32)
        for low in range(0, len(windows), BATCH):
            part = windows[low:low + BATCH]
            slid = (self._columns(part) @ self.p["filters"]).reshape(len(part), -1, len(self.p["shift"]))
            top = np.maximum(slid.max(axis=1) + self.p["shift"], 0)
            out[low:low + BATCH] = _log_softmax(top @ self.p["out"] + self.p["bias"])
        return out

    def gradients(self, part: np.ndarray, classes: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of windows; only the place of a filter's maximum passes a gradient back."""
        n = len(part)
        columns = self._columns(part)
        places = len(columns) // n
        slid = (columns @ self.p["filters"]).reshape(n, places, -1)
        best = slid.argmax(axis=1)
        raw = np.take_along_axis(slid, best[:, None], 1)[:, 0] + self.p["shift"]
        top = np.maximum(raw, 0)
        slope = np.exp(_log_softmax(top @ self.p["out"] + self.p["bias"]))
        slope[np.arange(n), classes] -= 1
        slope /= n
        grad = {"out": top.T @ slope, "bias": slope.sum(0)}
        back = (slope @ self.p["out"].T) * (raw > 0)
        grad["shift"] = back.sum(0)
        rows = np.arange(n)[:, None] * places + best
        met = columns[rows]                                    # n, filters, width * depth
        grad["filters"] = np.einsum("nf,nfd->df", back, met) * self.mask
        down = back[:, :, None] * self.p["filters"].T[None]     # to the embeddings under each maximum
        grad["embed"] = np.zeros_like(self.p["embed"])
        under = part[np.arange(n)[:, None, None], best[:, :, None] + np.arange(max(WIDTHS))]
        np.add.at(grad["embed"], under.ravel(), down.reshape(-1, DEPTH))
        grad["embed"][0] = 0
        return grad

    def fit(self, windows: np.ndarray, classes: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> None:
        """Adam on cross entropy."""
        draw, step = np.random.default_rng(seed), 0
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = draw.permutation(len(windows))
            for low in range(0, len(order), batch):
                pick = order[low:low + batch]
                step += 1
                for k, g in self.gradients(windows[pick], classes[pick]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.p[k] -= (rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def cut_windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover all texts and each text's number of windows (none for an empty text).

    The last window of a longer text ends with the text and so overlaps the one before; a shorter text is padded.
    """
    sizes = np.diff(offsets)
    number = -(-sizes // WINDOW)
    of = np.repeat(np.arange(len(sizes)), number)
    place = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    start = np.maximum(np.minimum(place * WINDOW, sizes[of] - WINDOW), 0)
    within = start[:, None] + np.arange(WINDOW)
    padded = np.append(raw, np.uint8(0))
    at = np.where(within < sizes[of][:, None], within + offsets[of][:, None], len(raw))
    return padded[at], number


def training_part(id_col: str, parts: int, held: int) -> Column:
    """False for held-out rows, true for the others, null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) != held


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, windows: int) -> DataFrame:
    """At most about ``per_language`` documents of each language, chosen by a hash, and ``windows`` places of each.

    The choice needs one count per language; rows that pass the hash by chance beyond twice the bound are cut off.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    counted = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    picked = lookup_join(rows, counted, ["_lang"], salt=F.xxhash64("_id")).filter(
        F.pmod(F.xxhash64("_id", F.length("_text")), F.lit(1 << 30)) < F.lit(float(per_language) * (1 << 30)) / F.col("_n"))
    places = F.array(*[F.substring(F.col("_text"), (F.pmod(F.xxhash64(F.lit(k), F.col("_id")), F.greatest(F.length("_text") - WINDOW, F.lit(1))) + 1).cast("int"),
                                   F.lit(WINDOW)) for k in range(windows)])
    return picked.select(F.col("_lang").alias("lang"), F.explode(F.array_distinct(places)).alias("text"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, windows: int = 3,
          most_languages: int = 256) -> tuple[ByteNetwork | None, list[str]]:
    """Fit a network on a bounded sample; the languages are in the order of the network's classes."""
    usable = docs.filter(F.col(lang_col).isNotNull() & (F.length(F.trim(text_col)) > 0))
    rows = training_windows(usable, id_col, text_col, lang_col, per_language, windows).limit(2 * per_language * windows * most_languages).toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    if not languages:
        return None, []
    # The sample comes from tasks in any order; sorted, it trains the same network each time.
    rows = rows.sort_by([("lang", "ascending"), ("text", "ascending")])
    draw, cut = np.random.default_rng(1), []
    for text in rows["text"].to_pylist():
        raw = np.frombuffer(text.encode()[:WINDOW], np.uint8)
        window = np.zeros(WINDOW, np.uint8)
        size = len(raw) if draw.random() < 0.6 else int(draw.integers(min(8, len(raw)), len(raw) + 1))
        window[:size] = raw[:size]
        cut.append(window)
    network = ByteNetwork(len(languages))
    network.fit(np.array(cut), np.array([languages.index(x) for x in rows["lang"].to_pylist()]))
    return network, languages


def identify(docs: DataFrame, network: ByteNetwork | None, languages: list[str], id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Id, the columns of ``keep``, ``lang_pred`` and ``score`` of every row. A kept column must not have a result's name."""
    if {"lang_pred", "score"} & {id_col, *keep} or len({id_col, *keep}) < len(keep) + 1:
        raise ValueError(f"kept columns {[id_col, *keep]} clash with each other or with lang_pred, score")
    spark = docs.sparkSession
    kept = docs.select(F.col(id_col), *keep).schema
    model = send(spark.sparkContext, (network, languages))
    names = kept.fieldNames()
    source = docs.select(F.col(text_col).cast("string").alias("_t"), *[F.col(c).alias(f"_k{k}") for k, c in enumerate(names)])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, order = received(model)
        ascii_letter = np.zeros(256, bool)
        ascii_letter[[*range(65, 91), *range(97, 123)]] = True
        for batch in W.slices(batches):
            raw_all, offsets_all = W.utf8(batch.column(0))
            for low, high in W.chunks(offsets_all):
                raw, offsets = raw_all[offsets_all[low]:offsets_all[high]], offsets_all[low:high + 1] - offsets_all[low]
                n = high - low
                sums = np.concatenate([[0], np.cumsum(ascii_letter[raw])])
                letters = sums[offsets[1:]] > sums[offsets[:-1]]
                for k in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
                    letters[k] = any(c.isalpha() for c in raw[offsets[k]:offsets[k + 1]].tobytes().decode())
                language, score = np.full(n, -1), np.zeros(n)
                if net is not None and letters.any():
                    windows, number = cut_windows(raw, offsets)
                    logs = net.log_probabilities(windows).astype(np.float64)
                    some = np.flatnonzero(number)
                    first = (np.cumsum(number) - number)[some]
                    language[some] = np.add.reduceat(logs, first, axis=0).argmax(1)
                    mean = np.add.reduceat(np.exp(logs), first, axis=0) / number[some][:, None]
                    score[some] = np.clip(mean[np.arange(len(some)), language[some]], 0, 1)
                language[~letters], score[~letters] = -1, 0
                said = pa.array([*order, UNKNOWN], pa.string()).take(pa.array(np.where(language < 0, len(order), language)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).slice(low, n) for k in range(len(names))), said, pa.array(np.where(language < 0, 0.0, score))],
                                                 [*names, "lang_pred", "score"])

    return source.mapInArrow(run, fields)
