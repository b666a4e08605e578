"""Document quality by Bradley-Terry pairwise ranking.

Preference pairs (a good document over a bad one) are drawn among labelled
training rows; the weights minimise the logistic loss of feature differences.
The threshold is the quantile of the training scores at the share of bad
labels, and scores are the logistic of the distance to it.

Defined results: null and empty texts have the feature vector of an empty text
and are scored like any other.  Without labels of both kinds all scores are
0.5.  Labels that are null or belong to no document are unused; a document
labelled more than once counts as good if any label says so.  Repeated rows
score alike; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import pieces, text_bytes

FEATURES = (
    "log_bytes", "lower", "upper", "digits", "spaces", "stops", "bars", "marks", "other_ascii", "non_ascii",
    "log_words", "word_bytes", "distinct_words", "adjacent_repeats", "title_words", "marked_words", "lines_per_word", "long_words",
)


def _class_matrix() -> np.ndarray:
    groups = {
        "lower": range(97, 123), "upper": range(65, 91), "digits": range(48, 58), "spaces": (32, 9, 10, 11, 12, 13),
        "stops": b".,;:'\"-()?", "bars": b"|<>{}[]\\/=_~^`", "marks": b"#*$%&!@+", "non_ascii": range(128, 256),
    }
    names = ("lower", "upper", "digits", "spaces", "stops", "bars", "marks", "other_ascii", "non_ascii")
    matrix = np.zeros((256, len(names)))
    for name, members in groups.items():
        matrix[list(members), names.index(name)] = 1
    matrix[matrix.sum(1) == 0, names.index("other_ascii")] = 1
    return matrix


_CLASSES = _class_matrix()


def features(text: bytes) -> np.ndarray:
    """The feature vector of a whole text, in the order of ``FEATURES``."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    words = text.split()
    k = len(words)
    out = np.empty(len(FEATURES))
    out[0] = np.log1p(n)
    out[1:10] = counts / max(n, 1)
    out[10] = np.log1p(k)
    if not k:
        out[11:] = 0
        return out
    lengths = np.fromiter(map(len, words), np.int64, k)
    first = np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)
    last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    out[11] = min(lengths.mean(), 40) / 10
    out[12] = len(set(words)) / k
    out[13] = sum(map(eq, words, words[1:])) / k
    out[14] = ((first >= 65) & (first <= 90)).mean()
    out[15] = _CLASSES[last][:, 6].mean()
    out[16] = min(text.count(b"\n") / k, 2)
    out[17] = (lengths > 20).mean()
    return out


@dataclass(frozen=True)
class RankModel:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    sharpness: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ np.asarray(self.weights) - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw * self.sharpness, -700, 700)))


def fit_pairs(x: np.ndarray, good: np.ndarray, max_pairs: int = 100_000, ridge: float = 1e-3, rounds: int = 30, seed: int = 7) -> RankModel:
    """Newton steps on the mean logistic loss of ``x[good] - x[bad]``; pairs are drawn evenly."""
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return RankModel((0.0,) * width, (1.0,) * width, (0.0,) * width, 0.0, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    draw = np.random.default_rng(seed)
    n = min(max_pairs, 20 * len(x))
    diff = z[up[draw.integers(0, len(up), n)]] - z[down[draw.integers(0, len(down), n)]]
    w = np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -500, 500)))
        gradient = diff.T @ (p - 1) / n + ridge * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    at = len(down)
    threshold = (s[at - 1] + s[at]) / 2
    return RankModel(tuple(mean), tuple(scale), tuple(w), float(threshold), float(1 / max(1e-6, s.std() / 4)))


def labelled_sample(labels: DataFrame, train: Column, max_labelled: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """At most about ``max_labelled`` training labels, those with the smallest id hash."""
    rows = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    total = rows.count()
    if total > max_labelled:
        rows = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int((1 << 30) * max_labelled / total))
    return rows.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col)).alias("label"))


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000, **options) -> RankModel:
    """Fit on a bounded sample: ``max_labelled`` labelled rows reach the driver, as features."""
    sample = labelled_sample(labels, train, max_labelled, id_col, label_col)
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "label_id")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                rows = [features(t).tolist() for t in text_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])

    texts = texts.select("label_id", "text", F.col("label").cast("int"))
    rows = texts.mapInArrow(run, "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r["label"], r["x"]))  # the order of tasks has no effect
    if not rows:
        return fit_pairs(np.empty((0, len(FEATURES))), np.empty(0, bool), **options)
    return fit_pairs(np.array([r["x"] for r in rows]), np.array([r["label"] > 0 for r in rows]), **options)


def score(docs: DataFrame, model: RankModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``score`` between 0 and 1."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                x = np.array([features(t) for t in text_bytes(part.column(1))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x))], names=[id_col, "score"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double")
