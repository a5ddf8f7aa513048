"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in features of its text.  The model is fitted on preference pairs (a document
labelled 1 beats one labelled 0) by logistic loss on feature differences; a quantile of the training scores, at
the share of zeros, becomes the threshold between the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import fold, hashed_sample, prepare, releasing
from lattica.llm.text import Words, chunks, lower_ascii, mix

#: Labelled rows that the model is fitted on, at most; they are the first by a hash of their id.
FIT_ROWS = 20000
PAIRS = 60000
_U = np.uint64

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:?", "mark": b"!",
    "quote": b"\"'()[]{}<>", "symbol": b"#$%&*+-/=@\\^_`|~", "wide": range(128, 256), "space": b" \t", "line": b"\n\r\x0b\x0c",
}
_TABLE = np.zeros(256, np.int64)
for _k, _v in enumerate(_CLASSES.values()):
    _TABLE[list(_v)] = _k + 1
NAMES = ["log_bytes", "log_words", "word_length", *_CLASSES, "no_letter", "all_upper", "ends_symbol", "ends_mark",
         "short", "long", "repeated_words", "repeated_triples", "commonest_word"]


def _share(flag: np.ndarray, first: np.ndarray, per: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flag)]
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(per, 1)


def _repeats(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the share of items that occurred before in it, and the share of its commonest item."""
    number = np.bincount(text, minlength=n)
    order = np.argsort(mix(h + mix(text.astype(_U) + _U(77))), kind="stable")
    key, owner = mix(h + mix(text.astype(_U) + _U(77)))[order], text[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    begin = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[begin], np.diff(np.r_[begin, len(key)]))
    distinct = np.bincount(owner[begin], minlength=n)
    number = np.maximum(number, 1)
    return np.where(distinct > 0, 1 - distinct / number, 0), most / number


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text of a chunk: shares of byte and word kinds, lengths and repetition (all finite)."""
    n, size = len(offsets) - 1, np.diff(offsets)
    w = Words(data, offsets)
    per, length, text = w.per_text, w.end - w.start, w.text_of()
    kind = np.bincount(np.repeat(np.arange(n), size) * 16 + _TABLE[data], minlength=16 * n).reshape(n, 16)[:, 1 : 1 + len(_CLASSES)]
    seen = _TABLE[data]
    letter = np.r_[0, np.cumsum((seen == 1) | (seen == 2) | (seen == 8))]
    upper, low = np.r_[0, np.cumsum(seen == 1)], np.r_[0, np.cumsum(seen == 2)]
    letters = letter[w.end] - letter[w.start]
    last = seen[w.end - 1] if len(w) else seen[:0]
    h = w.hashes(3)
    again, common = _repeats(Words(lower_ascii(data), offsets).hashes(3), text, n)
    triple = mix(h[:-2] + mix(h[1:-1] + mix(h[2:]))) if len(h) > 2 else h[:0]
    inside = text[2:] == text[:-2]
    thrice, _ = _repeats(triple[inside], text[2:][inside], n)
    return np.column_stack([
        np.log1p(size), np.log1p(per), np.where(per > 0, (length.sum() and np.bincount(text, length, n)) / np.maximum(per, 1), 0),
        kind / np.maximum(size, 1)[:, None],
        _share(letters == 0, w.first, per), _share((upper[w.end] - upper[w.start] > 0) & (low[w.end] == low[w.start]), w.first, per),
        _share(last == 7, w.first, per), _share(last == 5, w.first, per), _share(length <= 2, w.first, per),
        _share(length >= 20, w.first, per), again, thrice, common,
    ]).astype(np.float64)


def with_features(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, x array<double>), one row per input row."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                x = features(data, offsets)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), lists], names=["id", "x"])

    return rows.mapInArrow(releasing(make), f"id {rows.schema['id'].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(weights . z - threshold))), z the standardised and clipped features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, steps: int = 30) -> Model:
    """Newton's method on the mean logistic loss of feature differences of random (1, 0) pairs.

    With one class only the score is constant: that class's share of the labels, or 0.5 without labels.
    """
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    scale = np.where(scale > 1e-9, scale, 1)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        level = 0.0 if not len(y) else 36.0 if len(good) else -36.0
        return Model(mean, scale, np.zeros(len(mean)), -level)
    z, rng = np.clip((x - mean) / scale, -8, 8), np.random.default_rng(11)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # chance that the pair is ordered wrongly
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w)), d.T @ p / pairs - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, w, _threshold(z @ w, y))


def _threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The score quantile at the share of zeros, halfway between its neighbours; equal scores stay together, on the nearer side."""
    order, at = np.sort(scores), int((y == 0).sum())
    if order[at - 1] == order[at]:
        ends = [k for k in (np.searchsorted(order, order[at], "left"), np.searchsorted(order, order[at], "right")) if 0 < k < len(order)]
        at = min(ends, key=lambda k: abs(k - at), default=at)
    return float((order[at - 1] + order[at]) / 2)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents, the first by a hash of their id; null labels are left out.

    Of labels of one id that differ the higher one counts, of its texts the one whose features are the smaller.
    """
    prepare(docs.sparkSession)
    known = (
        labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
        .groupBy("id").agg(F.max("y").alias("y"))
    )
    chosen = hashed_sample(known, rows, "id")
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").drop("y")
    found = with_features(texts, "id", "text").groupBy("id").agg(F.min("x").alias("x")).join(chosen, "id").orderBy("id").toPandas()
    x = np.stack(found["x"].to_numpy()) if len(found) else np.zeros((0, len(NAMES)))
    return fit_pairs(x, found["y"].to_numpy())


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score), one row per input row; null and empty texts get the score of a text without words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(model.score(features(data, offsets)))], names=["id", "score"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(releasing(make), f"id {rows.schema['id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """(id, held_out, score, predicted) per row of ``docs``, learnt from labels outside the held-out fold.

    The fold is crc32(id as text) mod ``folds``; a null id has held_out = null and is never learnt from.  Labels,
    language and source are no features.  Empty tables give an empty result; extra columns are ignored.
    """
    model = fit(docs, labels.where(fold(id, folds) != held), id, text)
    return score(docs, model, id, text).select(
        "id", (fold("id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is 0.5 or more."""

    at = docs.columns.index(text)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.score(features(data, offsets)) >= 0.5 for _, _, data, offsets in chunks(batch.column(at))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    prepare(docs.sparkSession)
    return docs.mapInArrow(releasing(make), docs.schema)
