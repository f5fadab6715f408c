"""Quality: a regularised quadratic discriminant over document statistics.

A document is a vector of transformed statistics of its whole text (shares of
character classes and of repeated words and lines, vocabulary growth, and the
worst run of ``RUN`` words in four respects). Labelled documents give every
class a mean and a covariance matrix, summed over all of them in Spark; the
covariance is shrunk towards the pooled one and its diagonal. A document's score
is the difference of the two Gaussian log densities, by Mahalanobis distances
with Cholesky factors made once, through a logistic curve.

The amount of shrinkage and the curve are fitted on at most ``MAX_FITTED``
labelled rows (smallest hash of doc_id); means and covariances use all.

Defined cases: null and empty texts have all statistics zero and are scored
like any other; null labels are ignored; repeated label rows of a document
count as their largest; without labels of both classes every document scores
the share of good ones (0 without labels); repeated rows score alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import cut
from territoria.llm.toxicity import fit_curve, label_of, logistic, remainder
from territoria.llm.words import NOT_BLANK, split_words, text_blocks, word_hashes

RUN = 32
MAX_FITTED = 20_000
SHRINKAGE = [(pooled, diagonal) for pooled in (0.05, 0.2, 0.5) for diagonal in (0.02, 0.1, 0.3)]
THRESHOLD = 0.3

_CODE = np.arange(256)
UPPER = (_CODE >= 0x41) & (_CODE <= 0x5A)
LETTER = UPPER | ((_CODE >= 0x61) & (_CODE <= 0x7A)) | (_CODE >= 0x80)
DIGIT = (_CODE >= 0x30) & (_CODE <= 0x39)
SYMBOL = np.isin(_CODE, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"])
STOP = np.isin(_CODE, [ord(c) for c in ".?"])
NOT_NEWLINE = _CODE != 0x0A
STATISTICS = ["words", "word_length", "upper", "symbol", "digit", "shout", "stop", "foreign", "repeat", "vocabulary",
              "newline", "repeated_line", "worst_symbol", "worst_upper", "worst_repeat", "worst_bare"]


def per_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between the edges of each row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[edges[1:]] - total[edges[:-1]]


def worst(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Largest share of flagged words in any RUN consecutive words of a row (or all of a short row)."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])
    size = np.diff(edges)
    out = np.zeros(len(size))
    long = np.flatnonzero(size >= RUN)
    if len(long):
        share = (total[RUN:] - total[:-RUN]) / RUN
        spans = np.stack([edges[long], edges[long + 1] - RUN + 1], axis=1).ravel()
        out[long] = np.maximum.reduceat(np.append(share, 0), spans)[::2]
    short = size < RUN
    out[short] = (total[edges[1:]] - total[edges[:-1]])[short] / np.maximum(size[short], RUN)
    return out


def repeats(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """How many of each row's hashes occurred earlier in the row."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    again = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    return np.bincount(r[1:][again], minlength=n).astype(np.float64)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The transformed statistics of a block's texts, one row each."""
    n = len(offsets) - 1
    starts, ends, rows = split_words(data, offsets, NOT_BLANK)
    hashes = word_hashes(data, starts, ends)
    edges = np.searchsorted(rows, np.arange(n + 1))
    words = np.diff(edges).astype(np.float64)
    some = np.maximum(words, 1)
    size = np.maximum(per_row(NOT_BLANK[data], offsets), 1)

    def share(table: np.ndarray) -> np.ndarray:
        return np.sqrt(per_row(table[data], offsets) / size)

    def count(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return total[ends] - total[starts]

    upper, letters, symbols = count(UPPER), count(LETTER), count(SYMBOL)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    lines, line_ends, line_rows = split_words(data, offsets, NOT_NEWLINE)
    line_count = np.maximum(np.bincount(line_rows, minlength=n), 1)
    distinct = words - repeats(hashes, rows, n)
    return np.stack([
        np.log1p(words), np.log(size / some), share(UPPER), share(SYMBOL), share(DIGIT), share(_CODE == 0x21),
        np.sqrt(per_row(STOP[data], offsets) / some), share(_CODE >= 0x80), np.sqrt(per_row(again, edges) / some),
        np.log1p(distinct) / np.maximum(np.log1p(words), 0.1), np.sqrt(per_row(_CODE[data] == 0x0A, offsets) / some),
        np.sqrt(repeats(word_hashes(data, lines, line_ends), line_rows, n) / line_count),
        np.sqrt(worst(symbols > 0, edges)), np.sqrt(worst((upper == letters) & (letters > 1), edges)),
        np.sqrt(worst(again, edges)), np.sqrt(worst(letters == 0, edges))], axis=1)


class Describe:
    """Task function: doc_id and the statistics of its text."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_blocks(batch.column("text")):
                rows = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(rows)), pa.array(rows.tolist(), pa.list_(pa.float64()))],
                    names=["doc_id", "x"])


def matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy().reshape(len(values), len(STATISTICS))


class Moments:
    """Task function: per class the sums of 1, x and x x' of the batch."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, label = matrix(batch.column("x")), batch.column("label").to_numpy()
            labels = [c for c in (0, 1) if (label == c).any()]
            sums = []
            for c in labels:
                own = np.c_[np.ones((label == c).sum()), x[label == c]]
                sums.append((own.T @ own).ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(sums, pa.list_(pa.float64()))],
                                             names=["label", "sums"])


@dataclass
class Discriminant:
    """Class means with Cholesky factors of the inverse covariances' roots."""

    means: list[np.ndarray]
    roots: list[np.ndarray]
    logdets: list[float]
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (((x - m) @ r) ** 2).sum(axis=1) - 0.5 * d
                   for m, r, d in zip(self.means, self.roots, self.logdets)]
        return np.clip(density[1] - density[0], -200, 200) if density else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.slope * np.arcsinh(self.difference(x)) + self.shift)


def discriminant(sums: dict[int, np.ndarray], pooled: float, diagonal: float) -> Discriminant:
    """Covariances (1 - pooled) own + pooled common, then shrunk to their diagonals."""
    n = {c: s[0, 0] for c, s in sums.items()}
    means = [sums[c][0, 1:] / n[c] for c in (0, 1)]
    own = [sums[c][1:, 1:] / n[c] - np.outer(m, m) for c, m in zip((0, 1), means)]
    common = (own[0] + own[1]) / 2
    floor = 1e-4 + 0.01 * np.diag(common)
    roots, logdets = [], []
    for s in own:
        s = (1 - pooled) * s + pooled * common
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + np.diag(floor)
        factor = np.linalg.cholesky(s)
        roots.append(np.linalg.inv(factor).T)
        logdets.append(2 * float(np.log(np.diag(factor)).sum()))
    return Discriminant(means, roots, logdets)


def fit(described: DataFrame, labels: DataFrame, usable) -> Discriminant:
    """The discriminant; without labels of both classes one of constant score."""
    known = cut(described.join(label_of(labels, "quality", usable), "doc_id"))
    d = len(STATISTICS) + 1
    parts = known.select("x", "label").mapInArrow(Moments(), "label int, sums array<double>")
    summed = parts.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("s")).collect()
    sums: dict[int, np.ndarray] = {}
    for label, pos, s in summed:
        sums.setdefault(label, np.zeros(d * d))[pos] = s
    sums = {c: s.reshape(d, d) for c, s in sums.items()}
    if len(sums) < 2:
        share = 1 - 1e-9 if 1 in sums else 1e-9
        return Discriminant([], [], [], 1.0, float(np.log(share / (1 - share))))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FITTED).select("x", "label").toArrow()
    x, label = matrix(rows.column("x")), rows.column("label").to_numpy()
    if not 0 < label.sum() < len(label):
        label = np.r_[label, 0, 1]
        x = np.r_[x, [sums[c][0, 1:] / sums[c][0, 0] for c in (0, 1)]]
    best, least = None, np.inf
    for pooled, diagonal in SHRINKAGE:
        model = discriminant(sums, pooled, diagonal)
        difference = model.difference(x)
        slope, shift = fit_curve(np.arcsinh(difference)[:, None], label)
        p = np.clip(logistic(np.arcsinh(difference) * slope[0] + shift), 1e-9, 1 - 1e-9)
        loss = -np.mean(np.where(label == 1, np.log(p), np.log(1 - p)))
        if loss < least:
            best, least = model, loss
            best.slope, best.shift = float(slope[0]), shift
    return best


class Score:
    """Task function: score of each described document."""

    def __init__(self, model: Discriminant):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(self.model.score(matrix(batch.column("x"))))], names=["doc_id", "score"])


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Labels of rows
    with crc32(doc_id as text) mod 5 = 0 are not learnt from."""
    described = cut(docs.select("doc_id", "text").mapInArrow(Describe(), "doc_id bigint, x array<double>"))
    model = fit(described, labels, remainder(5) != 0)
    out = described.mapInArrow(Score(model), "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
