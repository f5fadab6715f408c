"""Toxicity: a support vector machine over a subsequence string kernel.

Kernel. A string's features are its subsequences of ``ORDER`` characters within
``SPAN`` characters, each occurrence weighted ``DECAY`` to the power of the
characters it spans; the landmarks' kernel is the cosine of two feature vectors,
and other strings are compared with a landmark over what they share with it
(``Landmarks.similarity``). A word with gaps or inserted characters still shares
most subsequences with the plain word, and its other letters do not count
against it. A sentence is compared with a landmark string by its most similar unit
(blank-separated word; the same without inner punctuation; a run of single
characters; windows of long words).

Model. Landmarks are the words that tell labelled toxic texts from clean ones
best, no two too similar. The Nystroem map turns a sentence's similarities
``s`` into ``K^-1/2 s`` with the landmarks' kernel matrix K; a linear
squared-hinge machine is trained on labelled sentences (in the space of ``s``,
with the penalty that the map gives, so that rows stay sparse). A toxic document's
sentences are not all toxic, so it is represented by its highest one, chosen
anew in every round. A document scores by the margins of its ``TOP`` highest
sentences, through a logistic curve fitted to the training documents.

Bounds: at most ``MAX_POSITIVE`` and ``MAX_NEGATIVE`` labelled documents (those
with the smallest hash of doc_id) are fitted to, with all sentences of their
whole texts. Scoring is one pass without shuffle.

Defined cases: null and empty texts score like a sentence without any similar
unit; null labels and labels of absent documents are ignored; repeated label
rows of a document count as their largest; without labelled documents of both
classes every document scores the share of toxic ones (0 without labels);
repeated rows score alike; an empty table gives an empty result; other columns
are kept or ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from territoria.llm.words import mix

ORDER, SPAN, DECAY = 3, 5, 0.7
LANDMARKS, TOO_SIMILAR = 64, 0.95
#: similarities below this count as none: about what words share by chance
FAINT = 0.4
#: least cosine over the shared part that counts, and what it counts for
GAPPED, OTHERS = 0.63, 0.8
MAX_POSITIVE, MAX_NEGATIVE = 3000, 6000
LONG, WINDOW, STRIDE = 16, 12, 4
MEMO = 200_000
THRESHOLD = 0.7
#: sentences whose margins make up a document's score
TOP = 3

#: marks a string's ends, so that they count in its subsequences
EDGE = "\x02"

_PUNCTUATION = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPELLED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_WEIGHTS = np.array([DECAY ** (b + 1) for _, b in _OFFSETS])
#: strings worked on at once
MOST = 2048


def core_of(unit: str) -> str:
    """A blank-separated unit without the punctuation around it."""
    core = unit.strip(_PUNCTUATION)
    return core if core.isalnum() else _EDGE.sub("", core)


def variants(core: str) -> list[str]:
    """The strings by which a unit without outer punctuation is compared."""
    out = [core]
    if not core.isalnum():
        joined = _INNER.sub("", core)
        out += [joined] if joined != core else []
    return [f"{EDGE}{w}{EDGE}" for s in out if len(s) >= ORDER
            for w in ([s] if len(s) <= LONG else
                      [s[i: i + WINDOW] for i in range(0, len(s) - WINDOW + STRIDE, STRIDE)])]


def features(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (string, subsequence) pairs with unit-length weights, by string.

    A subsequence is a 48-bit hash of its characters. String number, hash and
    span are packed into one integer, so that one sort brings equal ones together.
    """
    assert len(strings) <= MOST
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    width = int(sizes.max(initial=0))
    codes = np.zeros((len(strings), width + SPAN), dtype=np.uint64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(strings)), sizes)
    codes[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    packed = []
    for n, (a, b) in enumerate(_OFFSETS):
        r, i = np.nonzero(codes[:, b: width + b])
        sub = mix((codes[r, i] << np.uint64(42)) | (codes[r, i + a] << np.uint64(21)) | codes[r, i + b])
        packed.append((r.astype(np.uint64) << np.uint64(52)) | ((sub >> np.uint64(16)) << np.uint64(4)) | np.uint64(n))
    packed = np.sort(np.concatenate(packed))
    weights = _WEIGHTS[(packed & np.uint64(15)).astype(np.int64)]
    packed >>= np.uint64(4)
    fresh = np.ones(len(packed), bool)
    fresh[1:] = packed[1:] != packed[:-1]
    weights = np.add.reduceat(weights, np.flatnonzero(fresh)) if len(packed) else weights
    packed = packed[fresh]
    rows = (packed >> np.uint64(48)).astype(np.int64)
    norm = np.sqrt(np.bincount(rows, weights ** 2, minlength=len(strings)))
    return rows, packed & np.uint64((1 << 48) - 1), weights / norm[rows]


class Landmarks:
    """Landmark strings and the similarity of other strings to them."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        rows, subs, self.weights = features(strings)
        order = np.argsort(subs, kind="stable")
        self.rows, self.weights = rows[order], self.weights[order]
        self.subs, self.first, self.many = np.unique(subs[order], return_index=True, return_counts=True)
        self.most = np.maximum.reduceat(self.weights ** 2, self.first) if len(self.subs) else np.zeros(0)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self.subs & np.uint64((1 << 20) - 1)] = True

    def kernel(self) -> np.ndarray:
        """Cosines of the landmarks themselves."""
        rows, subs, weights = features(self.strings)
        at = np.searchsorted(self.subs, subs)
        out = np.zeros((len(self.strings), len(self.subs)))
        out[rows, at] = weights
        return out @ out.T

    def similarity(self, strings: list[str], least: float = 0.0) -> np.ndarray:
        """Similarities of at most ``MOST`` strings (rows) to the landmarks.

        The kernel's cosine; or, where a string holds most of a landmark among
        other letters, the cosine over the part that the landmark shares (from
        ``GAPPED`` on, times ``OTHERS``): letters put in between add subsequences
        that the landmark does not have, which lower the plain cosine alone.
        Neither value exceeds the square root of the landmark's shared share, so
        strings that share too little of every landmark for ``least`` stay zero.
        """
        shape = (len(strings), len(self.strings))
        if not strings or not len(self.subs):
            return np.zeros(shape)
        rows, subs, weights = features(strings)
        hit = np.flatnonzero(self.seen[subs & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.subs, subs[hit]), len(self.subs) - 1)
        same = self.subs[at] == subs[hit]
        hit, at = hit[same], at[same]
        if least:
            enough = np.bincount(rows[hit], self.most[at], minlength=len(strings))[rows[hit]] >= least ** 2
            hit, at = hit[enough], at[enough]
        if not len(hit):  # counts of nothing would be whole numbers, whatever their weights
            return np.zeros(shape)
        many = self.many[at]
        each = np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        cell = np.repeat(rows[hit], many) * shape[1] + self.rows[each]
        own = np.repeat(weights[hit], many)
        cosine = np.bincount(cell, own * self.weights[each], minlength=shape[0] * shape[1])
        # the part shared is looked at only where enough of the landmark is shared
        held = np.bincount(cell, self.weights[each] ** 2, minlength=shape[0] * shape[1]) >= GAPPED ** 2
        shared = np.bincount(cell, np.where(held[cell], own ** 2, 0), minlength=shape[0] * shape[1])
        matched = np.divide(cosine, np.sqrt(shared), out=np.zeros_like(cosine), where=shared > 0)
        return np.maximum(cosine, np.where(matched >= GAPPED, OTHERS * matched, 0)).reshape(shape)


class Units:
    """Similarities of units, remembered by their cores; most units have none."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.known: dict[str, np.ndarray | None] = {}

    def learn(self, cores: set[str]) -> None:
        if len(self.known) > MEMO:
            self.known.clear()
        fresh = [u for u in cores if u not in self.known]
        self.known.update(dict.fromkeys(fresh))
        shown = [(u, v) for u in fresh for v in variants(u)]
        for lo in range(0, len(shown), MOST):
            part = shown[lo: lo + MOST]
            near = self.landmarks.similarity([v for _, v in part], FAINT)
            for j in np.flatnonzero(near.max(axis=1, initial=0) >= FAINT).tolist():
                u = part[j][0]
                old = self.known[u]
                new = np.where(near[j] >= FAINT, near[j], 0).astype(np.float32)
                self.known[u] = new if old is None else np.maximum(old, new)

    def loud_sentences(self, texts: list[str]) -> Iterator[list[set[str]]]:
        """For each text, the cores with any similarity of every sentence that has some."""
        texts = [t.lower() for t in texts]
        units = [set(t.split()) for t in texts]
        spelled = [[_INNER.sub("", m[0]) for m in _SPELLED.finditer(t)] for t in texts]
        cores = {u: core_of(u) for u in set().union(*units)}
        self.learn(set(cores.values()).union(*spelled))
        known = self.known
        loud = {u: c for u, c in cores.items() if known[c] is not None}
        listed = set(loud)
        for text, own, runs in zip(texts, units, spelled):
            out = [{u} for u in runs if known[u] is not None]
            here = own & listed
            if here:
                for sentence in _SENTENCE.split(text):
                    near = here.intersection(sentence.split())
                    if near:
                        out.append({loud[u] for u in near})
            yield out


@dataclass
class Model:
    """``weights`` act on raw similarities (the Nystroem map is folded in)."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: np.ndarray
    shift: float

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Those of the ``TOP`` highest sentences, highest first."""
        out = np.sort((rows @ self.weights))[::-1][:TOP]
        return np.r_[np.maximum(out, 0.0), np.zeros(TOP - len(out))] + self.bias

    def score(self, margins: np.ndarray) -> float:
        return float(logistic(margins @ self.slope + self.shift))


def nystroem_form(kernel: np.ndarray) -> np.ndarray:
    """Squared length of the weights of mapped sentences, as a form of the weights of raw similarities.

    The map is s -> R s with R the inverse root of the landmarks' (slightly
    raised) kernel matrix; weights w of mapped sentences act on s as v = R w, so
    |w|^2 is v' R^-2 v and R^-2 is the matrix itself.
    """
    values, vectors = np.linalg.eigh(kernel + 1e-3 * np.eye(len(kernel)))
    return vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T


class Sentences:
    """Rows of similarities with the landmarks, most of them zero; equal rows are held once.

    ``doc`` is the document of each sentence and ``row`` its row.
    """

    def __init__(self, width: int, rows: list[tuple[tuple[int, ...], tuple[float, ...]]], doc: np.ndarray, row: np.ndarray):
        self.width, self.doc, self.row, self.size = width, doc, row, len(rows)
        self.begin = np.cumsum([0, *(len(c) for c, _ in rows)])
        self.col = np.fromiter((c for cols, _ in rows for c in cols), np.int64, int(self.begin[-1]))
        self.val = np.fromiter((v for _, vals in rows for v in vals), np.float64, int(self.begin[-1]))
        self.of = np.repeat(np.arange(self.size), np.diff(self.begin))

    def times(self, w: np.ndarray) -> np.ndarray:
        """One product per distinct row."""
        return np.bincount(self.of, self.val * w[self.col], minlength=self.size)

    def highest(self) -> np.ndarray:
        out = np.zeros(self.size)
        np.maximum.at(out, self.of, self.val)
        return out

    def dense(self, rows: np.ndarray) -> np.ndarray:
        """The given rows with a last column of ones."""
        out = np.zeros((len(rows), self.width + 1))
        out[:, -1] = 1
        many = np.diff(self.begin)[rows]
        at = np.repeat(self.begin[rows] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        out[np.repeat(np.arange(len(rows)), many), self.col[at]] = self.val[at]
        return out


def fit_svm(x: Sentences, positive: np.ndarray, negative: np.ndarray, ridge: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Primal squared-hinge machine by Newton steps, in blocks of rows. Last: bias.

    ``positive`` and ``negative`` count how often each distinct row stands for
    either class; ``ridge`` is the quadratic form of the penalty.
    """
    size = x.width + 1
    penalty = np.zeros((size, size))
    penalty[:-1, :-1], penalty[-1, -1] = ridge, 1e-6
    w = np.zeros(size)
    for step in range(rounds):
        gram, right = penalty.copy(), np.zeros(size)
        margin = x.times(w[:-1]) + w[-1]
        up, down = np.where(margin < 1, positive, 0), np.where(margin > -1, negative, 0)
        active = np.flatnonzero(up + down)
        for lo in range(0, len(active), 2048):
            rows = active[lo: lo + 2048]
            own = x.dense(rows)
            gram += (own * (up + down)[rows, None]).T @ own
            right += own.T @ (up - down)[rows]
        new = np.linalg.solve(gram, right)
        if np.allclose(new, w, atol=1e-8):
            break
        w = 0.5 * w + 0.5 * new if step > 10 else new
    return w


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic curve through the margins with softened targets (Platt), by Newton steps."""
    n1, n0 = labels.sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[margins, np.ones(len(margins))]
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = logistic(x @ w)
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * v[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (p - target) + 1e-2 * w)
        w = w - np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def highest(values: np.ndarray, doc: np.ndarray, n_docs: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` highest values of each document, zeros where it has fewer,
    and the row of each document's highest (-1 without rows)."""
    order = np.lexsort((-values, doc))
    rank = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
    out, first = np.zeros((n_docs, most)), np.full(n_docs, -1)
    top = rank < most
    out[doc[order][top], rank[top]] = values[order][top]
    first[doc[order][rank == 0]] = order[rank == 0]
    return out, first


def train(landmarks: list[str], x: Sentences, labels: np.ndarray, odds: float | None = None) -> Model:
    """Fit to the sentences of bounded labelled documents; every document has one at least.

    ``labels`` has one entry per document; ``odds`` are those of toxic to clean
    among all labels, where the sample's differ.
    """
    ridge = nystroem_form(Landmarks(landmarks).kernel())
    negative = np.bincount(x.row[labels[x.doc] == 0], minlength=x.size).astype(float)
    score = x.highest()
    for _ in range(4):
        chosen = highest(score[x.row], x.doc, len(labels), 1)[1][labels == 1]
        w = fit_svm(x, np.bincount(x.row[chosen], minlength=x.size).astype(float), negative, ridge)
        score = x.times(w[:-1])
    model = Model(landmarks, w[:-1], float(w[-1]), np.zeros(TOP), 0.0)
    margins = np.maximum(highest(score[x.row], x.doc, len(labels), TOP)[0], 0) + model.bias
    model.slope, model.shift = fit_curve(margins, labels)
    if odds is not None:
        model.shift += float(np.log(odds * (labels == 0).sum() / labels.sum()))
    return model


class WordCounts:
    """Task function: in how many toxic and clean texts a word occurs."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                seen[label].update({v for u in set(map(core_of, (text or "").lower().split())) for v in variants(u)})
            words = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()),
                 pa.array([seen[0][w] for w in words], pa.int64())], names=["word", "toxic", "clean"])


class LabelledSentences:
    """Task function: a labelled text's sentences that are like a landmark, as the
    landmarks each is like and how much (``many`` of them a sentence)."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(Landmarks(self.landmarks))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            many, at, near = [], [], []
            for lo in range(0, len(texts), 200):
                for loud in units.loud_sentences(texts[lo: lo + 200]):
                    rows = [np.max([units.known[c] for c in cores], axis=0) for cores in loud]
                    many.append([int((r != 0).sum()) for r in rows])
                    at.append([i for r in rows for i in np.flatnonzero(r).tolist()])
                    near.append([v for r in rows for v in r[r != 0].tolist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(many, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int16())),
                 pa.array(near, pa.list_(pa.float32()))], names=["label", "many", "at", "near"])


def gathered(found: pa.Table, width: int) -> tuple[Sentences, np.ndarray]:
    """The rows of ``LabelledSentences`` with equal sentences held once; a document without any has an empty one."""
    rows: dict[tuple, int] = {}
    doc, row = [], []
    labels = found.column("label").to_numpy()
    for i, batch in enumerate(found.select(["many", "at", "near"]).to_batches(max_chunksize=1)):
        many, at, near = (batch.column(c)[0].as_py() for c in ("many", "at", "near"))
        begin = 0
        for n in many or [0]:
            key = tuple(at[begin: begin + n]), tuple(near[begin: begin + n])
            begin += n
            doc.append(i)
            row.append(rows.setdefault(key, len(rows)))
    return Sentences(width, list(rows), np.array(doc, dtype=np.int64), np.array(row, dtype=np.int64)), labels


def label_of(labels: DataFrame, column: str, usable) -> DataFrame:
    """(doc_id, label) of the labels that may be learnt from."""
    return (labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & usable)
            .groupBy("doc_id").agg(F.max(column).cast("int").alias("label")))


def labelled(docs: DataFrame, labels: DataFrame, column: str, usable, most: dict[int, int]) -> DataFrame:
    """(text, label) of a bounded sample of labelled documents. The sample's ids
    are bounded by the sum of ``most`` and broadcast."""
    own = label_of(labels, column, usable)
    parts = [own.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in most.items()]
    sample = parts[0].unionByName(parts[1])
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label")


def remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def choose_landmarks(sample: DataFrame) -> list[str]:
    counts = sample.mapInArrow(WordCounts(), "word string, toxic bigint, clean bigint").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return []
    lift = F.log((F.col("toxic") / n[1]) / ((F.col("clean") + 0.5) / n[0]))
    best = (counts.where("toxic >= 2").withColumn("lift", lift).where("lift >= 1")
            .withColumn("gain", F.col("toxic") * F.col("lift"))
            .orderBy(F.desc("gain"), "word").limit(4 * LANDMARKS).collect())
    words = [r["word"] for r in best]
    assert len(words) <= MOST
    near = Landmarks(words).kernel()
    chosen: list[int] = []
    for i in range(len(words)):
        if len(chosen) < LANDMARKS and near[i, chosen].max(initial=0) < TOO_SIMILAR:
            chosen.append(i)
    return [words[i] for i in chosen]


def fit(docs: DataFrame, labels: DataFrame, usable) -> Model:
    """The model; without usable labels one that scores the share of toxic ones."""
    sample = labelled(docs, labels, "toxic", usable, {1: MAX_POSITIVE, 0: MAX_NEGATIVE})
    landmarks = choose_landmarks(sample)
    if not landmarks:
        mean = sample.agg(F.avg("label")).first()[0]
        share = min(max(mean or 0.0, 1e-9), 1 - 1e-9)
        return Model([], np.zeros(0), 0.0, np.zeros(TOP), float(np.log(share / (1 - share))))
    found = sample.mapInArrow(
        LabelledSentences(landmarks), "label int, many array<int>, at array<smallint>, near array<float>").toArrow()
    x, labelled_as = gathered(found, len(landmarks))
    sizes = {r[0]: r[1] for r in label_of(labels, "toxic", usable).groupBy("label").count().collect()}
    return train(landmarks, x, labelled_as, sizes[1] / sizes[0])


class TopSentences(Units):
    """The margins of a text's highest sentences without a look at all of them.

    The largest similarity of a sentence's units is at most their sum, so the
    sum of the units' positive weighted similarities bounds a sentence's
    margin; sentences are tried in the order of their bounds.
    """

    def __init__(self, model: Model):
        super().__init__(Landmarks(model.landmarks))
        self.model = model
        self.positive = np.maximum(model.weights, 0)
        self.bounds: dict[str, float] = {}

    def bound(self, core: str) -> float:
        value = self.bounds.get(core)
        if value is None:
            value = self.bounds[core] = float(self.known[core] @ self.positive)
        return value

    def margins(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.bounds) > MEMO:
            self.bounds.clear()
        none, out = self.model.margins(np.zeros((0, len(self.positive)))), []
        for loud in self.loud_sentences(texts):
            tried = sorted(((sum(map(self.bound, near)), i) for i, near in enumerate(loud)), reverse=True)
            top = [0.0] * TOP
            for most, i in tried:
                if most <= top[-1]:
                    break
                value = float(np.max([self.known[c] for c in loud[i]], axis=0) @ self.model.weights)
                if value > top[-1]:
                    top = sorted([*top, value], reverse=True)[:TOP]
            out.append(np.array(top) + self.model.bias if tried else none)
        return out


class Score:
    """Task function: the batch with a ``score`` column, or only its rows below ``below``."""

    def __init__(self, model: Model, below: float | None = None):
        self.model, self.below = model, below

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = TopSentences(self.model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = np.zeros(len(texts))
            for lo in range(0, len(texts), 200):
                found = units.margins([t or "" for t in texts[lo: lo + 200]])
                scores[lo: lo + 200] = [self.model.score(m) for m in found]
            if self.below is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])
            else:
                yield batch.filter(pa.array(scores < self.below))


def usable_labels():
    """Rows that may be learnt from: crc32(doc_id as text) mod 3 is not 1."""
    return remainder(3) != 1


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, usable_labels())
    out = docs.select("doc_id", "text").mapInArrow(Score(model), "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with all their columns, without a shuffle."""
    model = fit(docs, labels, usable_labels())
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return docs.mapInArrow(Score(model, THRESHOLD), schema)
