"""Substring deduplication with suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of one document. Every window names an
anchor: of its runs of ``K`` words the one with the smallest hash, a choice that
depends on the window's words alone. Windows of equal words thus name equal
anchors, and only anchors that occur in two documents matter. The passage of a
document whose windows name one such anchor is a segment; all segments of an
anchor are a reference shard.

Of equal segments only the one in the smallest document is worked on: in larger
documents all its windows are repeats. A shard's segments go in ascending order
of document; each is streamed through the word-level suffix automaton of the
smaller documents' segments, whose matching statistics give every maximal
repeated span, and is then added to the automaton. Automata of shards are built
where the shard is and documents' segments are sent to them, because every
document is a reference here and a broadcast of all automata would grow with
the corpus. A shard of more than ``SHARD`` different segments (the edge of a
passage that very many documents share) is settled by the minimum document of
every window instead, an aggregate that is spread over tasks.

Defined cases: null and empty texts have no words; a text below ``WINDOW`` words
keeps all; a null doc_id counts as larger than all others; rows that repeat a
doc_id are one document and remove nothing from each other; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.bitmap import bitmap, listed
from territoria.llm.chosen_path import bounds, groups_of
from territoria.llm.common import cut, text_key, text_of
from territoria.llm.words import NOT_BLANK, ngram_hashes, same_row, split_words, text_blocks, word_hashes

WINDOW, K = 50, 20
SHARD = 1024
LAST = (1 << 63) - 1


def anchors(words: np.ndarray, rows: np.ndarray):
    """(first window, last window, anchor hash) of every run of windows with one anchor."""
    grams, inside = ngram_hashes(words, K), same_row(rows, WINDOW)
    count = len(inside)
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, place = grams[:count].copy(), np.arange(count)
    at = np.arange(count)
    for j in range(1, WINDOW - K + 1):
        lower = grams[j: j + count] < best
        np.copyto(best, grams[j: j + count], where=lower)
        np.copyto(place, at + j, where=lower)
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(fresh)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | (place[1:] != place[:-1])
    return first, np.flatnonzero(stop), best[first]


class Anchors:
    """Task function: (doc, anchor) rows, distinct within a block."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for at, data, offsets in text_blocks(batch.column("text")):
                starts, ends, rows = split_words(data, offsets, NOT_BLANK)
                first, _, names = anchors(word_hashes(data, starts, ends), rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(docs[at + rows[first]])], names=["anchor", "doc"])


class Segments:
    """Task function: the segments of anchors that may occur in two documents."""

    def __init__(self, repeated):
        self.repeated = repeated

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = batch.column("doc").to_numpy(), batch.column("text_key").to_numpy()
            for at, data, offsets in text_blocks(batch.column("text")):
                starts, ends, rows = split_words(data, offsets, NOT_BLANK)
                first, last, names = anchors(word_hashes(data, starts, ends), rows)
                seen = listed(self.repeated.value, names)
                first, last, names = first[seen], last[seen], names[seen]
                row = rows[first]
                begin = first - np.searchsorted(rows, row)
                body = [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[last + WINDOW - 1].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(docs[at + row]), pa.array(keys[at + row]),
                     pa.array(begin), pa.array(last - first + 1), pa.array(body, pa.binary())],
                    names=["anchor", "doc", "text_key", "start", "windows", "body"])


class Automaton:
    """Suffix automaton over words, grown text by text."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            known = nexts[last].get(w)
            if known is not None:  # an earlier text went on like this
                last = known if length[known] == length[last] + 1 else self._split(last, known, w)
                continue
            state, p = len(nexts), last
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p != -1 and w not in nexts[p]:
                nexts[p][w] = state
                p = link[p]
            if p == -1:
                link[state] = 0
            else:
                q = nexts[p][w]
                link[state] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = state

    def _split(self, p: int, q: int, w: bytes) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nexts[p].get(w) == q:
            nexts[p][w] = copy
            p = link[p]
        return copy

    def statistics(self, words: list[bytes]) -> list[int]:
        """For every word, the longest run ending there that the automaton holds."""
        nexts, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for w in words:
            while state and w not in nexts[state]:
                state = link[state]
                size = length[state]
            step = nexts[state].get(w)
            if step is None:
                size = 0
            else:
                state, size = step, size + 1
            out.append(size)
        return out


def repeated_windows(statistics: list[int]) -> list[tuple[int, int]]:
    """Ranges (first, last) of windows that end in a match of full length."""
    ends = np.flatnonzero(np.array(statistics) >= WINDOW) - WINDOW + 1
    if not len(ends):
        return []
    cuts = np.flatnonzero(np.diff(ends) > 1)
    return list(zip(ends[np.r_[0, cuts + 1]].tolist(), ends[np.r_[cuts, len(ends) - 1]].tolist()))


RANGES = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
RANGES_SQL = "array<struct<lo:bigint,hi:bigint>>"


class Shards:
    """Task function over shards sorted by document: repeated ranges of each segment."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "anchor"):
            table = table.combine_chunks()
            anchor, low = table.column("anchor").to_numpy(), table.column("low").to_numpy()
            keys, body = table.column("body_key").to_numpy(), table.column("body")
            found = []
            for lo, hi in bounds(anchor):
                automaton = Automaton()
                for a, b in bounds(low[lo:hi]):
                    texts = [body[i].as_py().split() for i in range(lo + a, lo + b)]
                    if a:
                        found += [(int(anchor[lo]), int(keys[lo + a + n]), ranges) for n, t in enumerate(texts)
                                  if (ranges := repeated_windows(automaton.statistics(t)))]
                    if lo + b < hi:
                        for t in texts:
                            automaton.add(t)
            if found:
                a, k, r = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(k, pa.int64()),
                     pa.array([[{"lo": x, "hi": y} for x, y in one] for one in r], RANGES)],
                    names=["anchor", "body_key", "ranges"])


class Windows:
    """Task function: the window hashes of a segment, in order."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, data, offsets in text_blocks(batch.column("body").cast(pa.string())):
                starts, ends, rows = split_words(data, offsets, NOT_BLANK)
                hashes, inside = ngram_hashes(word_hashes(data, starts, ends), WINDOW), same_row(rows, WINDOW)
                for row in range(len(offsets) - 1):
                    lo, hi = np.searchsorted(rows, [row, row + 1])
                    own = slice(lo, max(lo, hi - WINDOW + 1))
                    out.append(hashes[own][inside[own]].view(np.int64).tolist())
            kept = ["anchor", "body_key", "low"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.list_(pa.int64()))],
                                             names=[*kept, "windows"])


def repeated_in_large_shards(bodies: DataFrame) -> DataFrame:
    """(anchor, body_key, ranges) by the smallest document of every window."""
    w = bodies.select("anchor", "body_key", "low", "body").mapInArrow(
        Windows(), "anchor bigint, body_key bigint, low bigint, windows array<bigint>").select(
        "anchor", "body_key", "low", F.posexplode("windows").alias("at", "window"))
    least = w.groupBy("window").agg(F.min("low").alias("least"))
    one = w.join(least, "window").where("least < low").groupBy("anchor", "body_key").agg(F.collect_list("at").alias("at"))
    return one.select("anchor", "body_key", F.transform("at", lambda i: F.struct(
        i.cast("bigint").alias("lo"), i.cast("bigint").alias("hi"))).alias("ranges"))


class Kept:
    """Task function: words, removed words and the digest of the kept words."""

    def __init__(self, with_text: bool = False):
        self.with_text = with_text

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            out = []
            for text, own in zip(batch.column("text").to_pylist(), spans):
                words = (text or "").encode().split()
                n = len(words)
                if own:
                    gone = np.zeros(n + 1, dtype=np.int64)
                    for span in own:
                        gone[span["lo"]] += 1
                        gone[span["hi"]] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                text = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(text).hexdigest(),
                            *([text.decode()] if self.with_text else [])))
            columns = list(zip(*out)) or [()] * (3 + self.with_text)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 1 + len(columns)])


class Filter:
    """Task function: rows whose text_key may (or may not) be in the bitmap."""

    def __init__(self, table, wanted: bool):
        self.table, self.wanted = table, wanted

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("text_key").to_numpy().view(np.uint64)
            yield batch.filter(pa.array(listed(self.table.value, keys) == self.wanted))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, text_key, spans): word ranges lo..hi-1 to remove; doc is doc_id, null as largest."""
    seen = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), text_key().alias("text_key"), "text")
    names = seen.select("doc", "text").mapInArrow(Anchors(), "anchor bigint, doc bigint")
    both = names.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b")
    segments = cut(seen.mapInArrow(
        Segments(bitmap(both, "anchor")),
        "anchor bigint, doc bigint, text_key bigint, start bigint, windows bigint, body binary")
        .withColumn("body_key", F.xxhash64("body", F.length("body"))))
    bodies = cut(segments.groupBy("anchor", "body_key").agg(F.min("doc").alias("low"), F.first("body").alias("body")))
    sizes = bodies.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shards = bodies.join(sizes, "anchor")
    small = (shards.where(F.col("n") <= SHARD).select("anchor", "body_key", "low", "body")
             .repartition("anchor").sortWithinPartitions("anchor", "low")
             .mapInArrow(Shards(), f"anchor bigint, body_key bigint, ranges {RANGES_SQL}"))
    found = small.unionByName(repeated_in_large_shards(shards.where(F.col("n") > SHARD)))
    # written, so that both sides of the next join are shuffled and a common segment can be split
    least = cut(bodies.select("anchor", "body_key", "low").join(found, ["anchor", "body_key"], "left"))
    own = segments.select("anchor", "body_key", "doc", "text_key", "start", "windows").join(least, ["anchor", "body_key"])
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), (F.col("windows") - 1).alias("hi")))
    ranges = F.when(F.col("doc") > F.col("low"), whole).otherwise(F.col("ranges"))
    return (own.select("doc", "text_key", "start", F.explode(ranges).alias("r"))
            .groupBy("doc", "text_key").agg(F.collect_list(F.struct(
                (F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi") + WINDOW).alias("hi")))
                .alias("spans")))


def deduplicate(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text)."""
    spans = cut(repeated_spans(docs))
    table = bitmap(spans, "text_key")
    keyed = docs.select("doc_id", text_key().alias("text_key"), text_of().alias("text"))
    kinds = "doc_id bigint, text_key bigint, text string"
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    clean = keyed.mapInArrow(Filter(table, False), kinds).mapInArrow(Kept(with_text), schema)
    touched = (keyed.mapInArrow(Filter(table, True), kinds)
               .withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
               .join(spans, ["doc", "text_key"], "left").select("doc_id", "text", "spans")
               .mapInArrow(Kept(with_text), schema))
    return clean.unionByName(touched)
