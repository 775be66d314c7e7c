"""Quality classifier: regularised quadratic discriminant analysis.

A document becomes a vector of transformed statistics of its text.  For each
class the labelled rows give a mean and a covariance, which is shrunk towards the
pooled covariance and a multiple of the unit matrix.  The score is the
logistic function of the difference of the log densities, whose Mahalanobis
distances come from Cholesky factors computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship
from .base import arrow_map, held_out, save
from .textvec import SPACED, Texts, Words, distinct_in_rows

ship(__name__)

#: Labelled rows that a fit uses at most, those first in the order of a hash.
TRAIN_ROWS = 40_000
#: Shares of the pooled covariance and of the unit matrix in a class's covariance.
POOLED, UNIT = 0.1, 0.02
#: Score from which a document is predicted good, and the folds of the contract.
GOOD, FOLDS, FOLD = 0.7, 4, 2

CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:", "bang": b"!?",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "bar": b"|", "line": b"\n", "high": range(128, 256),
}
FEATURES = (
    "words", "word_length", "word_spread", "upper", "lower", "digit", "stop", "bang", "symbol", "bar", "high",
    "bare", "same_as_last", "distinct", "distinct_pairs", "line_words",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    texts = len(offsets) - 1
    words = Words(data, offsets, SPACED)
    sums = {}
    for name, members in CLASSES.items():
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        total = np.concatenate([[0], np.cumsum(table[data])])
        sums[name] = (total[offsets[1:]] - total[offsets[:-1]]).astype(float)
        if name in ("upper", "lower", "digit", "high"):
            sums["alnum_at"] = sums.get("alnum_at", 0) + table
    lengths = (words.ends - words.starts).astype(float)
    alnum = np.concatenate([[0], np.cumsum((sums.pop("alnum_at") > 0)[data])])
    bare = (alnum[words.ends] == alnum[words.starts]).astype(float)
    same = np.zeros(len(lengths))
    if len(lengths):
        same[1:] = words.hashes[1:] == words.hashes[:-1]
        inner = words.bounds[:-1][words.bounds[:-1] < len(same)]
        same[inner] = 0

    def per_text(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[words.bounds[1:]] - total[words.bounds[:-1]]

    n = np.diff(words.bounds).astype(float)
    some = np.maximum(n, 1)
    size = np.maximum(per_text(lengths), 1)
    mean = per_text(lengths) / some
    spread = np.sqrt(np.maximum(per_text(lengths**2) / some - mean**2, 0))
    kinds = np.diff(distinct_in_rows(words.hashes, words.bounds)[1])
    pairs, pair_bounds = words.grams(2)
    pair_kinds = np.diff(distinct_in_rows(pairs, pair_bounds)[1])
    out = np.stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread),
        *(np.sqrt(sums[k] / size) for k in ("upper", "lower", "digit", "stop", "bang", "symbol", "bar", "high")),
        np.sqrt(per_text(bare) / some), np.sqrt(per_text(same) / some), np.log1p(kinds) / np.log1p(some),
        np.log1p(pair_kinds) / np.log1p(np.maximum(np.diff(pair_bounds), 1)), np.log1p(n / (sums["line"] + 1)),
    ], axis=1)
    out[n == 0] = 0
    return out.reshape(texts, len(FEATURES))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of FEATURES), one row per row of `docs`; other columns than doc_id and text are not read."""

    def run(batches):
        for batch in batches:
            texts = Texts(batch.column(1))
            rows = [statistics(data, offsets) for _, _, data, offsets in texts.chunks()]
            x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], names=["doc_id", "x"])

    docs = docs.select("doc_id", "text")
    return arrow_map(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants and the log ratio of the class sizes."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    prior: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pooled: float = POOLED, unit: float = UNIT) -> Discriminant:
        """A class without rows takes the mean and covariance of all; no rows at all give score 0.5 everywhere."""
        d = x.shape[1]
        both = [x[y == c] if (y == c).any() else x for c in (0, 1)]
        if not len(x):
            return cls([np.zeros(d)] * 2, [np.eye(d)] * 2, [0.0] * 2, 0.0)
        means = [part.mean(axis=0) for part in both]
        spreads = [(part - m).T @ (part - m) / max(len(part) - 1, 1) for part, m in zip(both, means)]
        shared = sum(s * len(p) for s, p in zip(spreads, both)) / sum(map(len, both))
        factors, log_dets = [], []
        for s in spreads:
            shrunk = (1 - pooled - unit) * s + pooled * shared + unit * np.diag(np.diag(shared)) + 1e-6 * np.eye(d)
            lower = np.linalg.cholesky(shrunk)
            factors.append(np.linalg.inv(lower))
            log_dets.append(2 * float(np.log(np.diag(lower)).sum()))
        n1 = int((y == 1).sum())
        return cls(means, factors, log_dets, float(np.log((n1 + 1) / (len(y) - n1 + 1))))

    def score(self, x: np.ndarray) -> np.ndarray:
        far = [(((x - m) @ f.T) ** 2).sum(axis=1) + d for m, f, d in zip(self.means, self.factors, self.log_dets)]
        return 1 / (1 + np.exp(-np.clip((far[0] - far[1]) / 2 + self.prior, -500, 500)))


def fit_quality(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, folds: int = FOLDS, fold: int = FOLD) -> Discriminant:
    """Fits on labelled rows outside `fold`; labels other than 0 and 1 and rows without doc_id are left out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y"))
    rows = stats.join(known, F.col("doc_id") == F.col("_id")).select("x", "y", F.xxhash64("doc_id").alias("h"), "doc_id")
    got = rows.orderBy("h", "doc_id", "y").limit(train_rows).select("x", "y").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return Discriminant.fit(x, np.array(got.column("y").to_pylist(), dtype=int))


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    The score reads the text alone.  Null and empty texts are scored as vectors of zeros.
    Repeated rows are scored each.  An empty table gives an empty one; without labels every score is 0.5.
    """
    stats = save(document_statistics(docs), "quality")
    model = fit_quality(stats, labels, train_rows)

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= GOOD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = arrow_map(stats, run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted")
