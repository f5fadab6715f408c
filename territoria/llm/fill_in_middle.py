"""Fill-in-the-middle transformation with a compressed set of token boundaries.

A text is cut into units ``[A-Za-z]+|[^A-Za-z]``. The code-point offsets at
which units begin, and the text's end, form a sorted set kept in chunks of
2**16 values: each chunk is an array, a bitmap or a list of runs, whichever is
smallest, and the chunks carry cumulative cardinalities. The offset after k
units is the set's k-th member: a search over the cardinalities finds the
chunk, a select inside the chunk the member. Both cuts of a document are two
such selects.

Defined cases: null and empty texts have no units and stay plain and empty; a
null doc_id is written as an empty string in the hash; repeated rows are
transformed alike, each on its own; an empty table gives an empty result; all
columns but doc_id and text are ignored. A text that holds a marker stays
plain, so the parts of an output can always be told apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.llm.words import text_blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: of 100 documents so many are transformed, and of 100 transformed ones so many begin with the suffix
FIM_RATE, SPM_RATE = 90, 20

CHUNK_BITS = 16
CHUNK = 1 << CHUNK_BITS


class ArrayChunk:
    """The members themselves, two bytes each."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapChunk:
    """One bit a value, with the number of members before each 64-bit word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(CHUNK, dtype=bool)
        bits[values] = True
        self.bytes = np.packbits(bits, bitorder="little")
        self.upto = np.cumsum(np.bitwise_count(self.bytes.view(np.uint64)), dtype=np.int64)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.upto, k, side="right"))
        before = int(self.upto[word - 1]) if word else 0
        own = np.unpackbits(self.bytes[8 * word: 8 * word + 8], bitorder="little")
        return 64 * word + int(np.flatnonzero(own)[k - before])


class RunChunk:
    """First value of every run, with the number of members before it."""

    def __init__(self, starts: np.ndarray, before: np.ndarray):
        self.starts, self.before = starts.astype(np.uint16), before

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def chunk_of(values: np.ndarray):
    """The smallest of the three forms for the sorted values of one chunk."""
    begins = np.flatnonzero(np.diff(values, prepend=-2) != 1)
    if 4 * len(begins) < min(2 * len(values), CHUNK // 8):
        return RunChunk(values[begins], begins)
    return ArrayChunk(values) if 2 * len(values) <= CHUNK // 8 else BitmapChunk(values)


class BoundarySet:
    """Sorted offsets with ``select(k)``, the k-th smallest (from 0)."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> CHUNK_BITS
        begins = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[begins]
        self.upto = np.append(begins[1:], len(offsets))
        self.chunks = [chunk_of(offsets[a:b] & (CHUNK - 1)) for a, b in zip(begins.tolist(), self.upto.tolist())]

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, side="right"))
        before = int(self.upto[at - 1]) if at else 0
        return (int(self.keys[at]) << CHUNK_BITS) + self.chunks[at].select(k - before)


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code-point offsets (within the block) at which units begin, the number of
    units of each row, and the code points before each row's end."""
    points = (data & 0xC0) != 0x80
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    inner = np.zeros(len(data), dtype=bool)
    inner[1:] = letter[1:] & letter[:-1]
    inner[offsets[:-1][offsets[:-1] < offsets[1:]]] = False
    upto = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(points, out=upto[1:])
    begins = np.flatnonzero(points & ~inner)
    return upto[begins], np.diff(np.searchsorted(begins, offsets)), upto[offsets]


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[8 * i: 8 * i + 8], 16) for i in range(4))


class Rearrange:
    """Task function: one output text per document."""

    def __init__(self, seed: int, fim_rate: int, spm_rate: int):
        self.seed, self.fim_rate, self.spm_rate = seed, fim_rate, spm_rate

    def document(self, doc_id, text: str, starts: np.ndarray, length: int) -> tuple:
        n = len(starts)
        h1, h2, h3, h4 = draws(doc_id, self.seed)
        if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= self.fim_rate:
            return doc_id, n, "plain", None, None, text
        bounds = BoundarySet(np.append(starts, length))
        one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = bounds.select(one), bounds.select(two)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < self.spm_rate:
            return doc_id, n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return doc_id, n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, data, offsets in text_blocks(batch.column("text")):
                starts, counts, ends = unit_starts(data, offsets)
                own = np.append(0, np.cumsum(counts))
                rows = []
                for i in range(len(counts)):
                    rows.append(self.document(
                        ids[first + i], data[offsets[i]: offsets[i + 1]].tobytes().decode(),
                        starts[own[i]: own[i + 1]] - ends[i], int(ends[i + 1] - ends[i])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def transform(docs: DataFrame, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        Rearrange(seed, fim_rate, spm_rate),
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(form: Column, output: Column) -> Column:
    """The original text from a transformed one."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix, suffix = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))
