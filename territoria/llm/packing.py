"""Best-fit packing of tokenised documents by exact-complement hashing.

Tasks tokenise whole texts and return only piece lengths and checksums. What
fills a sequence depends on lengths alone, so the plan is made from the number
of pieces of every length (at most ``size`` counts, whatever the corpus). Over
these counts, single lengths, pair sums and triple sums are indexed; an open
sequence of gap g takes a combination that fills g exactly under the remaining
counts, else the largest single piece that fits (best fit), and so on until
nothing fits. A combination is used as often as its counts allow, so the plan
has a bounded number of patterns. Pieces of one length are interchangeable:
each gets an ordinal within its length from per-partition counts, and the
broadcast plan turns (length, ordinal) into its sequence and offset.

Defined cases: null and empty texts are one piece with the end id alone; a
document with more than ``size`` ids is cut into full pieces and a rest;
repeated rows are packed as often as they occur; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from territoria.llm.common import cut
from territoria.llm.words import text_blocks

SIZE = 4096
END_ID = 1
#: distinct parts whose ids a worker remembers before it starts anew, and the longest of them
MEMO, LONGEST = 400_000, 64

_CHUNKS = re.compile(r"[^\x20\x09-\x0D]+").findall
_PLAIN = re.compile("[\x09-\x0d\x20-\x7eÀ-ÖØ-öø-įı-ſ]*").fullmatch
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ſ]+|[0-9]|[^\x09-\x0d\x20a-z0-9À-ſ]+").findall
#: how a tokenizer describes the rule that _PARTS follows
_RULE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Parts(dict):
    """Lower-case part -> its token ids as native unsigned 32-bit integers, each found once."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join(map(self.byte_char.__getitem__, part.encode()))
        ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(part) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[part] = ids
        return ids


class ChunkIds(dict):
    """Chunk between blanks -> its token ids; for texts of letters beyond the plain ones.

    The tokenizer never joins across white space, so a text's ids are its
    chunks' ids in order. Texts and chunks of ASCII and plain Latin letters are
    parted by the tokenizer's own rule and each lower-case part runs through its
    model once; every other chunk goes through the whole tokenizer. A tokenizer
    that describes another rule than this one encodes texts whole.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        described = json.loads(self.whole.to_str())
        self.known = {k: described[k] for k in _RULE} == _RULE and described["model"]["end_of_word_suffix"] == "</w>"
        self.parts = Parts(self.whole.model)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.plain(chunk) if _PLAIN(chunk) and "<|" not in chunk else self.encoded(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= MEMO // 4:
                self.clear()
            self[chunk] = ids
        return ids

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PARTS(text.lower())))

    def encoded(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def text(self, text: str) -> np.ndarray:
        """All ids of a text."""
        if not self.known:
            ids = self.encoded(text)
        elif _PLAIN(text) and "<|" not in text:
            ids = self.plain(text)
        else:
            ids = b"".join(map(self.__getitem__, _CHUNKS(text)))
        return np.frombuffer(ids, np.uint32)


_encoders: dict[str, ChunkIds] = {}


def encoder(path: str) -> ChunkIds:
    if path not in _encoders:
        _encoders[path] = ChunkIds(path)
    return _encoders[path]


class Pieces:
    """Task function: one row per piece. ``nth`` numbers the pieces of a length
    within the partition, so later steps need no sort of all pieces."""

    def __init__(self, path: str, size: int, with_ids: bool):
        self.path, self.size, self.with_ids = path, size, with_ids

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(self.path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, data, offsets in text_blocks(batch.column("text")):
                out = []
                for row in range(len(offsets) - 1):
                    ids = encode.text(data[offsets[row]: offsets[row + 1]].tobytes().decode())
                    own = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), self.size)):
                        part_ids = own[start: start + self.size]
                        length = len(part_ids)
                        out.append((doc_ids[first + row], piece, start, length, zlib.crc32(part_ids.tobytes()), part,
                                    seen[length], *([part_ids.tolist()] if self.with_ids else [])))
                        seen[length] += 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(),
                         pa.list_(pa.int64())]
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=names[: len(columns)])


class Complements:
    """Index of single, pair and triple sums over the counts left per length."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        there = (self.left > 0).astype(np.float64)
        self.pairs = np.rint(np.convolve(there, there))[: len(counts)] > 0  # may only lose entries later

    def pair(self, total: int, left: np.ndarray) -> tuple[int, int] | None:
        """Lengths (a, b), a <= b as far apart as can be, with a + b = total."""
        low = np.arange(1, total // 2 + 1)
        fits = (left[low] > 0) & (left[total - low] > 0)
        if total % 2 == 0 and len(low):
            fits[-1] = left[total // 2] > 1
        found = np.flatnonzero(fits)
        return (int(low[found[0]]), int(total - low[found[0]])) if len(found) else None

    def exact(self, gap: int, left: np.ndarray) -> tuple[int, ...] | None:
        if left[gap] > 0:
            return (gap,)
        if self.pairs[gap]:
            if two := self.pair(gap, left):
                return two
            if self.pair(gap, self.left) is None:
                self.pairs[gap] = False
        for big in np.flatnonzero((left[1:gap] > 0) & self.pairs[gap - 1: 0: -1])[::-1] + 1:
            left[big] -= 1
            two = self.pair(gap - int(big), left)
            left[big] += 1
            if two:
                return (*two, int(big))
            if self.pair(gap - int(big), self.left) is None:
                self.pairs[gap - int(big)] = False
        return None


def plan(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """Patterns ``(times, {length: pieces})`` that use up all counts.

    ``counts[n]`` is the number of pieces of length n; the sequence size is the
    largest index.
    """
    size = len(counts) - 1
    index, out = Complements(counts), []
    for longest in range(size, 0, -1):
        while index.left[longest] > 0:
            left, gap, pattern = index.left.copy(), size - longest, Counter([longest])
            left[longest] -= 1
            while gap:
                found = index.exact(gap, left)
                if found is None:
                    fits = np.flatnonzero(left[1: gap + 1])
                    if not len(fits):
                        break
                    found = (int(fits[-1]) + 1,)
                for n in found:
                    left[n] -= 1
                    gap -= n
                pattern.update(found)
            times = min(int(index.left[n]) // m for n, m in pattern.items())
            for n, m in pattern.items():
                index.left[n] -= times * m
            out.append((times, dict(pattern)))
    return out


class Places:
    """Task function: sequence and offset of each (length, ordinal)."""

    def __init__(self, ranges):
        self.ranges = ranges

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = self.ranges.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            nth = batch.column("ordinal").to_numpy()
            at = np.searchsorted(table["key"], (length << 48) | nth, side="right") - 1
            rel, many = nth - table["nth"][at], table["many"][at]
            kept = [c for c in batch.schema.names if c != "ordinal"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(table["sequence"][at] + rel // many),
                 pa.array(table["offset"][at] + rel % many * length)], names=[*kept, "sequence_id", "offset"])


def _ranges(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    rows, used, base = [], Counter(), 0
    for times, pattern in patterns:
        offset = 0
        for n, many in sorted(pattern.items(), reverse=True):
            rows.append(((n << 48) | used[n], used[n], many, base, offset))
            used[n] += times * many
            offset += n * many
        base += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(len(rows), 5)
    return {c: np.ascontiguousarray(table[:, i]) for i, c in enumerate(["key", "nth", "many", "sequence", "offset"])}


def pack(docs: DataFrame, size: int = SIZE, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    path = tokenizer_path or default_tokenizer()
    schema = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
              + ", ids array<bigint>" * with_ids)
    pieces = cut(docs.select("doc_id", "text").mapInArrow(Pieces(path, size, with_ids), schema))
    here = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").agg(F.count(F.lit(1))).collect():
        counts[length] = n
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = here.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(base, ["part", "length"]).withColumn("ordinal", F.col("base") + F.col("nth"))
    names = [c for c in pieces.columns if c not in ("part", "nth")]
    ranges = spark.sparkContext.broadcast(_ranges(plan(counts)))
    kinds = {f.name: f.dataType.simpleString() for f in numbered.schema}
    return numbered.select(*names, "ordinal").mapInArrow(
        Places(ranges), ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences of ``pack(..., with_ids=True)``: at most ``size`` ids a group."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
