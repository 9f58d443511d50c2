"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

A document is a vector of statistics of its whole text. A Gaussian kernel over standardised vectors is approximated by
random cosine features; ridge regression on the labels is solved from normal equations that each partition sums and
the driver adds up; scores of rows that a fold's own fit has not seen are made monotone probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, hash_sample, map_text, mix, run_hashes, text_slices

FEATURES = (
    "log_bytes", "log_words", "word_mean", "word_deviation", "upper", "digit", "space", "line", "high", "stop", "comma", "bar", "symbol", "other",
    "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "line_mean", "symbol_words", "capital_words", "stop_words", "byte_entropy", "short_words", "long_words",
)
#: Labelled rows that the fit sees at most, about: a bounded sample by a hash of the id (all, where there are fewer).
TRAIN_ROWS = 20_000
COMPONENTS = 256
#: Width of the Gaussian kernel on standardised statistics.
WIDTH = 6.0
RIDGE = 1e-2
FOLDS = 4


def _byte_classes() -> np.ndarray:
    names = {c: i for i, c in enumerate(("upper", "digit", "space", "line", "high", "stop", "comma", "bar", "symbol", "other", "lower"))}
    out = np.full(256, names["other"], np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            k = "high"
        elif c.isupper():
            k = "upper"
        elif c.islower():
            k = "lower"
        elif c.isdigit():
            k = "digit"
        elif c == " ":
            k = "space"
        elif c == "\n":
            k = "line"
        elif c in ".!?":
            k = "stop"
        elif c in ",;:":
            k = "comma"
        elif c == "|":
            k = "bar"
        elif c in "#$%&*<>{}[]\\^~=+@_/":
            k = "symbol"
        else:
            k = "other"
        out[b] = names[k]
    return out


_CLASS = _byte_classes()
_KINDS = 11


def _distinct_share(doc: np.ndarray, hashes: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: distinct hashes and the most frequent one's count, both as shares of its hashes (1 and 0 without any)."""
    with np.errstate(over="ignore"):
        own = mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    own = own[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    runs = np.diff(np.append(first, len(own)))
    owner = doc[order][first]
    total = np.bincount(doc, minlength=docs)
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, owner, runs)
    some = np.maximum(total, 1)
    return np.where(total > 0, np.bincount(owner, minlength=docs) / some, 1.0), top / some


def _slice_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offsets).astype(float)
    doc_of = np.repeat(np.arange(n), np.diff(offsets))
    some = np.maximum(size, 1)
    table = np.bincount(doc_of * 256 + data, minlength=n * 256).reshape(n, 256)
    kinds = np.zeros((n, _KINDS))
    for k in range(_KINDS):
        kinds[:, k] = table[:, _CLASS == k].sum(1)
    put = {name: i for i, name in enumerate(FEATURES)}
    out[:, put["log_bytes"]] = np.log1p(size)
    for k, name in enumerate(("upper", "digit", "space", "line", "high", "stop", "comma", "bar", "symbol", "other")):
        out[:, put[name]] = kinds[:, k] / some
    share = table / some[:, None]
    out[:, put["byte_entropy"]] = -(share * np.log(np.where(share > 0, share, 1))).sum(1)
    # words: runs of bytes that are no ASCII white space
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    solid = ~white
    begin = solid.copy()
    begin[1:] &= white[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begin[heads] = solid[heads]
    starts = np.flatnonzero(begin)
    stop = white.copy()
    stop[heads] = True  # a text's first byte ends the word before
    stops = np.append(np.flatnonzero(stop), len(data))
    ends = stops[np.searchsorted(stops, starts, side="right")]
    doc = doc_of[starts] if len(starts) else np.zeros(0, np.int64)
    words = np.bincount(doc, minlength=n)
    each = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, weights=length, minlength=n) / each
    out[:, put["log_words"]] = np.log1p(words)
    out[:, put["word_mean"]] = mean
    out[:, put["word_deviation"]] = np.sqrt(np.maximum(np.bincount(doc, weights=length**2, minlength=n) / each - mean**2, 0))
    tail = _CLASS[data[ends - 1]] if len(ends) else ends
    head = _CLASS[data[starts]] if len(starts) else starts
    for name, found in (("symbol_words", (tail == 8) | (tail == 7)), ("capital_words", head == 0), ("stop_words", tail == 5), ("short_words", length <= 3), ("long_words", length >= 15)):
        out[:, put[name]] = np.bincount(doc, weights=found, minlength=n) / each
    hashes = run_hashes(data, starts, ends)
    out[:, put["distinct_words"]], out[:, put["top_word"]] = _distinct_share(doc, hashes, n)
    same = doc[1:] == doc[:-1]
    with np.errstate(over="ignore"):
        pairs = (hashes[1:] * np.uint64(3) + hashes[:-1])[same]
    out[:, put["distinct_pairs"]], _ = _distinct_share(doc[1:][same], pairs, n)
    # lines: between line feeds and texts' ends
    cut = data == 0x0A
    edge = np.zeros(len(data), bool)
    edge[heads] = True
    edge[1:] |= cut[:-1]
    from_ = np.flatnonzero(edge)
    to = np.append(from_[1:], len(data))
    line_doc = doc_of[from_] if len(from_) else np.zeros(0, np.int64)
    lines = np.bincount(line_doc, minlength=n)
    out[:, put["line_mean"]] = np.log1p(size / np.maximum(lines, 1))
    out[:, put["distinct_lines"]], _ = _distinct_share(line_doc, run_hashes(data, from_, to), n)
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; null texts are empty."""
    parts = [_slice_statistics(data, offsets) for _, _, data, offsets in text_slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def basis(self, x: np.ndarray) -> np.ndarray:
        """A constant, the standardised statistics themselves, and the cosine features."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.waves + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([np.ones((len(z), 1)), z / np.sqrt(z.shape[1]), waves], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.basis(x) @ self.weights, self.knots, self.values)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the monotone fit: pooled adjacent violators, each pool at its mean score, shrunk by one half count."""
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, y in zip(score[order].tolist(), label[order].tolist(), strict=True):
        pools.append([s, y, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            s2, y2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + y2, pools[-1][2] + n2]
    knots = np.array([s / n for s, _, n in pools])
    values = np.array([(y + 0.5 * label.mean()) / (n + 0.5) for _, y, n in pools])
    return knots, np.maximum.accumulate(np.clip(values, 0, 1))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", hold: int = 5) -> QualityModel:
    """Fits on labelled rows whose crc32(id as text) mod ``hold`` isn't 0; of those, on about ``train_rows`` at most.

    Labels are one a document: the mean of repeated ones, cut at one half; null labels are none. Only the sample's
    ids are broadcast, a bounded number. Without any labelled row every score is one half.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("_y"))
    known = known.filter(fold("_id", hold) != 0)
    known = scratch.keep(hash_sample(known, "_id", known.count(), train_rows), "labels")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")
    made = map_text(rows, "_text", ["_id", "_y"], "_x array<double>", lambda t: [pa.array(list(statistics(t)), pa.list_(pa.float64()))])
    made = scratch.keep(made, "statistics").coalesce(8)
    width = len(FEATURES)
    stacked = made.select("_id", "_y", "_x")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, width))
        for b in batches:
            x = np.stack(b["_x"].to_numpy()) if len(b) else np.zeros((0, width))
            total += np.stack([np.full(width, len(x)), x.sum(0), (x**2).sum(0)])
        yield pd.DataFrame({"m": [total.ravel().tolist()]})

    parts = [np.array(r["m"]).reshape(3, width) for r in stacked.mapInPandas(moments, "m array<double>").collect()]  # a row for each of 8 partitions
    n, first, second = sum(parts, np.zeros((3, width)))
    some = np.maximum(n, 1)
    mean = first / some
    scale = np.sqrt(np.maximum(second / some - mean**2, 1e-12))
    rng = np.random.default_rng(20)
    model = QualityModel(mean, np.where(scale > 1e-5, scale, 1.0), rng.normal(size=(width, COMPONENTS)) / WIDTH, rng.uniform(0, 2 * np.pi, COMPONENTS), np.zeros(1 + width + COMPONENTS), np.array([0.0]), np.array([0.5]))
    if not n[0]:
        return model
    size = 1 + width + COMPONENTS

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS, size, size + 1))
        for b in batches:
            if not len(b):
                continue
            z, y = model.basis(np.stack(b["_x"].to_numpy())), b["_y"].to_numpy(float)
            part = mix(b["_id"].to_numpy(np.int64).view(np.uint64)) % np.uint64(FOLDS)
            for f in range(FOLDS):
                own = z[part == f]
                total[f] += np.concatenate([own.T @ own, (own.T @ y[part == f])[:, None]], axis=1)
        yield pd.DataFrame({"m": [total.tobytes()]})

    sums = sum((np.frombuffer(bytes(r["m"])).reshape(FOLDS, size, size + 1) for r in stacked.mapInPandas(equations, "m binary").collect()), np.zeros((FOLDS, size, size + 1)))

    def solve(of: np.ndarray, rows_: float) -> np.ndarray:
        penalty = np.eye(size) * RIDGE * max(rows_, 1) / size
        penalty[0, 0] = 1e-9
        return np.linalg.solve(of[:, :-1] + penalty, of[:, -1])

    every = sums.sum(0)
    apart = [solve(every - sums[f], n[0] * (1 - 1 / FOLDS)) for f in range(FOLDS)]

    def unseen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z = model.basis(np.stack(b["_x"].to_numpy()))
                part = (mix(b["_id"].to_numpy(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(int)
                yield pd.DataFrame({"s": np.einsum("ij,ij->i", z, np.stack(apart)[part]), "y": b["_y"]})

    seen = stacked.mapInPandas(unseen, "s double, y double").toPandas()  # train_rows rows at most, about
    model.weights = solve(every, n[0])
    model.knots, model.values = isotonic(seen["s"].to_numpy(), seen["y"].to_numpy())
    return model


def score_documents(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Columns ``keep`` of every row (all, if None) with ``score`` and ``predicted`` (1 from the threshold on).

    The whole text counts; null and empty texts have the statistics of an empty text and are scored like any other.
    Repeated rows are scored alike; an empty table gives an empty result; a column of docs called score or predicted
    gives way to the new one.
    """

    def make(texts: pa.Array) -> list[pa.Array]:
        s = np.clip(model.score(statistics(texts)), 0, 1)
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return map_text(docs, text_col, list(docs.columns) if keep is None else keep, "score double, predicted int", make)
