"""Quality classifier: two zstandard dictionaries, and which of them packs a text tighter."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIT_ROWS, crc_mod, free_names, in_order, labelled_sample, logistic, scored, sigmoid

#: Bytes that are compressed on their own, so that the dictionaries bear on every part of a long text.
SEGMENT = 1024
DICTIONARY = 64 * 1024
LEVEL = 3
#: Labelled rows that the dictionaries are built from at most, half of the fitting rows if those are fewer.
DICTIONARY_ROWS = 2000
THRESHOLD = 0.3


@dataclass
class QualityModel:
    """good, bad: contents of the dictionaries; weights: of the calibration, its constant last."""

    good: bytes
    bad: bytes
    weights: np.ndarray

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights}

    def features(self, text: str) -> list[float]:
        """Normalised differences of compressed size, over the whole text and at their least and most in a segment, and how tightly the text packs at all."""
        if not hasattr(self, "_packers"):
            self._packers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.bad, self.good)]
        data = text.encode("utf-8", "replace")
        bad, good = self._packers
        sizes = np.array([(len(bad.compress(s)), len(good.compress(s))) for s in segments(data)], dtype=float)
        total = sizes.sum(axis=0)
        each = (sizes[:, 0] - sizes[:, 1]) / (sizes[:, 0] + sizes[:, 1])
        tight = np.log(total.min() / (len(data) + 16))
        return [(total[0] - total[1]) / (total[0] + total[1]), each.min(), each.max(), tight, tight * tight]

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([self.features(t) for t in texts])
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def segments(data: bytes) -> list[bytes]:
    return [data[i : i + SEGMENT] for i in range(0, len(data), SEGMENT)] or [b""]


def dictionary(parts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; of so few segments that none can be trained, their last bytes as they are."""
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[-size:] or b"\0" * 16


def fit(rows: Iterable[tuple[str, int]], n: int, prior: float | None = None, most: int = DICTIONARY_ROWS) -> QualityModel:
    """The first rows, at most half of them and `most`, build the dictionaries from all their segments; the others calibrate.

    rows: n times (text, 1 if good), in an order that says nothing of the label, read once. prior: share of good texts
    that the scores are calibrated for; that of the rows if None.
    """
    rest: Iterator[tuple[str, int]] = iter(rows)
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    good = 0
    for text, y in islice(rest, min(n // 2, most)):
        parts[y] += segments(text.encode("utf-8", "replace"))
        good += y
    model = QualityModel(dictionary(parts[1]), dictionary(parts[0]), np.zeros(6))
    del parts
    told = [(model.features(text), y) for text, y in rest]
    y = np.array([t[1] for t in told], dtype=float)
    if not told or y.min() == y.max():  # nothing to tell apart
        share = (good + y.sum() + 1) / (n + 2)
        model.weights[-1] = np.log(share / (1 - share))
        return model
    x = np.array([t[0] for t in told])
    mid, width = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = logistic((x - mid) / width, y)
    model.weights = np.r_[w[:-1] / width, w[-1] - (w[:-1] * mid / width).sum()]
    if prior:
        model.weights[-1] += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, learn=None, rows: int = FIT_ROWS, column: str = "score") -> DataFrame:
    """The documents with `score` (or another column), the calibrated chance that a text is good.

    Learns from the whole texts of at most `rows` labelled documents that `learn` (a condition on doc_id) allows; scores
    whole texts. A null text scores as the empty one; repeated rows are all scored, alike;
    without labels every score is a half; an empty table stays empty. Other columns pass unchanged, but for a `score`,
    which is replaced.
    """
    learn = F.lit(True) if learn is None else learn
    share = labels.where(F.col("quality").isin(0, 1) & learn).agg(F.avg("quality")).first()[0]
    sample = labelled_sample(docs, labels, "quality", learn, rows)
    model = fit(in_order(sample), sample.count(), min(max(share, 0.01), 0.99) if share is not None else None)
    return scored(docs, model.score, column)


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = crc_mod("doc_id", 5) == 0
    out = quality_scores(docs.select("doc_id", "text"), labels, ~held)
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns, whatever their names."""
    (score,) = free_names(docs, "score")
    return quality_scores(docs, labels, crc_mod("doc_id", 5) != 0, column=score).where(F.col(score) >= THRESHOLD).drop(score)
