"""Spelling variants: words one letter apart, found by k-d trees over letter counts.

A word's letters, counted, are a vector. Exactly one inserted or deleted letter
moves it by one in one direction; exactly one replaced letter moves it down by
one in one direction and up by one in another, an L1 distance of two. So the
partners of a word lie, for each of three length pairs, in a small box around
its vector. Words of one length are split by a k-d tree into cells of about
``CELL`` words (fitted on a bounded sample, which affects the balance only).
Every word is indexed in its own cell and asked in each cell whose box it can
reach. The task of a cell builds a finer tree over the cell's words, prunes its
boxes in the same way and verifies the order of letters of what is left. It
returns a count and the best partner per asking word, never the pairs.

Words with equal letter counts cannot be told apart by a tree: where they fill
more than a cell they are dealt over several cells, all of which are asked, and
where they fill more than ``CROWD`` places of a leaf they are met through equal
first or second halves, one of which an edit leaves as it is.

Following forms ends, as a form is at least ``RATIO`` times as frequent; the
number of steps is known from the largest count, and they are taken by
doubling.

Defined cases: null and empty texts have no words; a null doc_id is written as
an empty string in the hash; repeated rows count as often as they occur; of
equally frequent forms the smallest in code-point order is taken; an empty
table gives an empty result; all columns but doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import cut

MIN_LENGTH, MIN_COUNT, RATIO, SLIP = 7, 2, 10, 31
#: words of a cell and of a leaf of its tree, words of the sample, equal vectors of a leaf met through halves
CELL, LEAF, SAMPLE, CROWD = 16_384, 48, 200_000, 512
#: distinct words a task collects before it hands on their counts, asking words and pairs worked on at once
HELD, BLOCK, PAIRS = 300_000, 16_384, 1 << 20

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LETTERS = 26 + 64
_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[0x61:0x7B] = np.arange(26)
_LETTER[0xC0:] = 26 + np.arange(64)

FREE, BARRED = -1, -2


class CountWords:
    """Task function: (word, n) of the documents' letter runs, slips applied."""

    def __init__(self, min_length: int, slip: int):
        self.min_length, self.slip = min_length, slip

    def words(self, doc_id, text: str, runs) -> Iterator[tuple[str, int]]:
        for run, n in Counter(runs.findall(text)).items():
            word = run.lower() if run.isascii() else run.translate(_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % self.slip == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
                if len(word) < self.min_length:
                    continue
            yield word, n

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a run shorter than that cannot give a word of the least length
        runs = re.compile(f"[A-Za-zÀ-ÿ]{{{self.min_length},}}")
        counts = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                                             names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in self.words(doc_id, text.as_py() or "", runs):
                    counts[word] += n
                if len(counts) >= HELD:
                    yield handed()
        yield handed()


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """word, n: the distinct results of all letter runs and how often they occur."""
    return (docs.select(F.col("doc_id").cast("bigint"), "text")
            .mapInArrow(CountWords(min_length, slip), "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words in a row (one byte each) and the words' lengths."""
    parts = [w.encode("latin-1") for w in words]
    return np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts per word."""
    letters, lengths = spelled(words)
    cell = np.repeat(np.arange(len(words)) * _LETTERS, lengths) + _LETTER[letters]
    return np.bincount(cell, minlength=len(words) * _LETTERS).reshape(len(words), _LETTERS).astype(np.int32)


def squares(vectors: np.ndarray) -> np.ndarray:
    return (vectors.astype(np.int64) ** 2).sum(axis=1)


class Tree:
    """k-d tree over letter counts; a leaf holds the rows that came to it."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        self.axis, self.at, self.low, self.high, self.leaves = [], [], [], [], []
        todo = [(np.arange(len(vectors)), None, None)]
        while todo:
            rows, side, parent = todo.pop()
            split = self._split(vectors[rows]) if len(rows) > leaf else None
            if split is None:
                node = ~len(self.leaves)
                self.leaves.append(rows)
            else:
                axis, at, below = split
                node = len(self.axis)
                for field, value in zip((self.axis, self.at, self.low, self.high), (axis, at, None, None)):
                    field.append(value)
                todo += [(rows[below], self.low, node), (rows[~below], self.high, node)]
            if parent is None:
                self.root = node
            else:
                side[parent] = node

    @staticmethod
    def _split(own: np.ndarray):
        """Axis and value that part the rows most evenly; None for equal rows."""
        best, most = None, 0
        for at in range(int(own.max())):
            below = (own <= at).sum(axis=0)
            even = np.minimum(below, len(own) - below)
            axis = int(even.argmax())
            if even[axis] > most:
                best, most = (axis, at), int(even[axis])
            if 4 * most > len(own) or not even.any():
                break
        if best is None:
            spread = own.min(axis=0) < own.max(axis=0)
            if not spread.any():
                return None
            axis = int(spread.argmax())
            best = (axis, int(own[:, axis].min()))
        return *best, own[:, best[0]] <= best[1]

    def reach(self, vectors: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, asking rows) for every box within reach.

        ``up`` and ``down`` say for each row along which letter its single step
        up or down has been taken: a letter, FREE (not yet) or BARRED (none).
        """
        todo = [(self.root, np.arange(len(vectors)), up, down)]
        while todo:
            node, rows, up, down = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows
                continue
            axis, at = self.axis[node], self.at[node]
            value = vectors[rows, axis] + (up == axis) - (down == axis)
            below = value <= at
            # a step over the border, taken along this letter and not undone
            rise = (value == at) & (up == FREE) & (down != axis)
            fall = (value == at + 1) & (down == FREE) & (up != axis)
            for child, inside, step, over_up, over_down in ((self.low[node], below, fall, None, axis),
                                                            (self.high[node], ~below, rise, axis, None)):
                there = inside | step
                new_up, new_down = up[there], down[there]
                moved = step[there]
                if over_up is not None:
                    new_up = np.where(moved, over_up, new_up)
                else:
                    new_down = np.where(moved, over_down, new_down)
                todo.append((child, rows[there], new_up, new_down))


def steps(n: int, longer: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps allowed towards words that are ``longer`` by one, none or minus one letter."""
    return (np.full(n, FREE if longer >= 0 else BARRED), np.full(n, FREE if longer <= 0 else BARRED))


class Cells:
    """The trees of all lengths of the sample, and the cells of their leaves."""

    def __init__(self, sample: list[str], leaf: int):
        self.trees, self.cells, self.count = {}, {}, 0
        by_length: dict[int, list[str]] = {}
        for word in sample:
            by_length.setdefault(len(word), []).append(word)
        for length, words in sorted(by_length.items()):
            tree = Tree(letter_counts(words), leaf)
            own = []
            for rows in tree.leaves:
                parts = -(-len(rows) // leaf)
                own.append(range(self.count, self.count + parts))
                self.count += parts
            tree.leaves = [None] * len(own)
            self.trees[length], self.cells[length] = tree, own

    def of(self, length: int, vectors: np.ndarray, longer: int) -> Iterator[tuple[range, np.ndarray]]:
        """(cells, rows): where rows of one length find words of ``length``."""
        if length not in self.trees:
            yield range(-length, -length + 1), np.arange(len(vectors))
            return
        for leaf, rows in self.trees[length].reach(vectors, *steps(len(vectors), longer)):
            yield self.cells[length][leaf], rows


class Route:
    """Task function: (cell, home, word, n) for the word's own cell and all it must ask."""

    def __init__(self, cells, min_length: int):
        self.cells, self.min_length = cells, min_length

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = self.cells.value
        for batch in batches:
            words = np.array(batch.column("word").to_pylist(), dtype=object)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                for first in range(0, len(own), BLOCK):
                    index = own[first: first + BLOCK]
                    yield from self.rows(batch, cells, words[index].tolist(), index, length)

    def rows(self, batch, cells, words, index, length) -> Iterator[pa.RecordBatch]:
        vectors = letter_counts(words)
        barred = np.full(len(words), BARRED)
        home = np.full(len(words), -length)
        if length in cells.trees:
            salt = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
            for leaf, rows in cells.trees[length].reach(vectors, barred, barred):
                own = cells.cells[length][leaf]
                home[rows] = own.start + salt[rows] % len(own)
        for longer in (-1, 0, 1):
            if length + longer < self.min_length:
                continue
            out = [(np.full(len(rows), cell), rows) for some, rows in cells.of(length + longer, vectors, longer) for cell in some]
            if not out:
                continue
            cell, rows = (np.concatenate(x) for x in zip(*out))
            take = pa.array(index[rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int64()), pa.array(home[rows] == cell), batch.column("word").take(take),
                 batch.column("n").take(take)], names=["cell", "home", "word", "n"])


def one_edit(asking: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether row i of ``asking`` becomes row i of ``words`` by exactly one edit (lengths differ by one at most)."""
    if asking.shape[1] > words.shape[1]:
        asking, words = words, asking
    if asking.shape[1] == words.shape[1]:
        return (asking != words).sum(axis=1) == 1
    head = np.logical_and.accumulate(asking == words[:, :-1], axis=1)
    return (head | (asking == words[:, 1:])).all(axis=1)


def equal_parts(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (of a, of b) with equal rows, in blocks of about ``PAIRS``."""
    kind = np.dtype((np.void, a.shape[1]))
    b = np.ascontiguousarray(b).view(kind).ravel()
    order = np.argsort(b, kind="stable")
    keys, begin, count = np.unique(b[order], return_index=True, return_counts=True)
    a = np.ascontiguousarray(a).view(kind).ravel()
    at = np.minimum(np.searchsorted(keys, a), len(keys) - 1)
    found = np.flatnonzero(keys[at] == a)
    many = count[at[found]]
    upto = np.cumsum(many)
    first = 0
    while first < len(found):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, side="right")))
        size = many[first:last]
        left = np.repeat(found[first:last], size)
        inner = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
        yield left, order[np.repeat(begin[at[found[first:last]]], size) + inner]
        first = last


class Search:
    """The words of one cell, all of one length, asked by words within one edit."""

    def __init__(self, words: list[str]):
        self.vectors = letter_counts(words)
        self.letters = spelled(words)[0].reshape(len(words), -1)
        self.norm = squares(self.vectors)
        self.low, self.high = self.vectors.min(axis=0), self.vectors.max(axis=0)
        self.used = np.flatnonzero(self.high)
        self.tree = Tree(self.vectors, LEAF)
        # products must come out as whole numbers
        self.exact = np.float32 if 2 * (self.letters.shape[1] + 1) ** 2 < 1 << 24 else np.float64
        self.small = self.vectors[:, self.used].astype(self.exact)

    def near(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (asking word, cell word) exactly one edit apart; the asking words are of one length."""
        vectors = letter_counts(words)
        letters = spelled(words)[0].reshape(len(words), -1)
        longer = self.letters.shape[1] - letters.shape[1]
        up, down = steps(len(words), longer)
        # steps that already the box of the whole cell asks for
        short, over = np.maximum(self.low - vectors, 0), np.maximum(vectors - self.high, 0)
        n_short, n_over = short.sum(axis=1), over.sum(axis=1)
        can = (n_short <= (up == FREE)) & (n_over <= (down == FREE))
        up, down = np.where(n_short > 0, short.argmax(axis=1), up), np.where(n_over > 0, over.argmax(axis=1), down)
        rows = np.flatnonzero(can)
        norm = squares(vectors)
        small = vectors[:, self.used].astype(self.exact)
        # one step is a squared distance of 1, one up and one down of 2
        square = 2 if longer == 0 else 1
        for leaf, asked in self.tree.reach(vectors[rows], up[rows], down[rows]):
            asked, own = rows[asked], self.tree.leaves[leaf]
            if len(own) > max(LEAF, CROWD):  # only equal vectors fill more than a leaf
                yield from self._crowd(asked, own, letters, norm, small, square)
                continue
            width = max(1, PAIRS // len(own))
            for first in range(0, len(asked), width):
                some = asked[first: first + width]
                distance = norm[some][:, None] + self.norm[own] - 2 * (small[some] @ self.small[own].T)
                i, j = np.nonzero(distance == square)
                i, j = some[i], own[j]
                good = one_edit(letters[i], self.letters[j])
                yield i[good], j[good]

    def _crowd(self, asked, own, letters, norm, small, square):
        """A leaf of very many words with equal counts: equal halves first, then the letters."""
        asked = asked[norm[asked] + self.norm[own[0]] - 2 * (small[asked] @ self.small[own[0]]) == square]
        if not len(asked):
            return
        least = min(letters.shape[1], self.letters.shape[1])
        half = least // 2
        heads, tails = slice(0, half), slice(half - least, None)
        for part in (heads, tails):
            for i, j in equal_parts(letters[asked][:, part], self.letters[own][:, part]):
                i, j = asked[i], own[j]
                good = one_edit(letters[i], self.letters[j])
                if part is tails:
                    good &= (letters[i][:, heads] != self.letters[j][:, heads]).any(axis=1)
                yield i[good], j[good]


def answers(group: pa.Table) -> pa.Table:
    """For every word that asks a cell: how many of its words are near, and the best of them."""
    words = np.array(group.column("word").to_pylist(), dtype=object)
    n = group.column("n").to_numpy()
    home = group.column("home").to_numpy()
    found, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    own = np.flatnonzero(home)
    if len(own):
        # most frequent first, equally frequent in code-point order: the best is the first met
        own = np.array(sorted(own.tolist(), key=lambda i: (-n[i], words[i])))
        search = Search(words[own].tolist())
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.full(len(words), len(own), np.int64)
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            for at in range(0, len(rows), BLOCK):
                some = rows[at: at + BLOCK]
                for i, j in search.near(words[some].tolist()):
                    np.add.at(found, some[i], 1)
                    np.minimum.at(first, some[i], j)
        best = np.where(first < len(own), own[np.minimum(first, len(own) - 1)], -1)
    told = home | (found > 0)
    best = best[told]
    return pa.table({
        "word": pa.array(words[told], pa.string()), "n": pa.array(np.where(home, n, 0)[told]), "found": pa.array(found[told]),
        "best_n": pa.array(np.where(best >= 0, n[best], 0), mask=best < 0),
        "best": pa.array(np.where(best >= 0, words[best], None) if len(words) else [], pa.string())})


def near_words(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, n, n_near and its most frequent near word (best, best_n) for every row of ``words`` (word, n)."""
    spark = words.sparkSession
    total = words.count()
    share = min(1.0, SAMPLE / max(total, 1))
    picked = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    sample = picked.select("word").toArrow().column("word").to_pylist()
    cells = Cells(sample, max(16, int(CELL * share)))
    routed = words.mapInArrow(Route(spark.sparkContext.broadcast(cells), min_length),
                              "cell bigint, home boolean, word string, n bigint")
    told = (routed.repartition(max(1, cells.count), "cell").groupBy("cell")
            .applyInArrow(answers, "word string, n bigint, found bigint, best_n bigint, best string"))
    order = F.struct((-F.col("best_n")).alias("few"), F.col("best").alias("word"))
    return (told.groupBy("word")
            .agg(F.max("n").alias("n"), F.sum("found").alias("n_near"), F.min(F.when(F.col("best").isNotNull(), order)).alias("b"))
            .select("word", "n", "n_near", F.col("b.word").alias("best"), (-F.col("b.few")).alias("best_n")))


def roots(forms: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, root: the end of the chain of forms that starts at ``word`` (word, form, form_n)."""
    largest = forms.agg(F.max("form_n")).first()[0] or 1
    hops = 1 + int(math.log(largest, ratio))
    at = forms.select("word", F.col("form").alias("root"))
    reached = 1
    while reached < hops:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = cut(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        reached *= 2
    return at


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
             slip: int = SLIP) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = cut(word_counts(docs, min_length, min_count, slip))
    frequent = F.col("best_n") >= ratio * F.col("n")
    near = cut(near_words(words, min_length).select(
        "word", F.when(frequent, F.col("best")).alias("form"), "n", "n_near", F.when(frequent, F.col("best_n")).alias("form_n")))
    ends = roots(near.where("form is not null"), ratio)
    return near.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
