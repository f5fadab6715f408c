"""Benchmark decontamination by winnowing.

Words are hashed, every run of ``k`` words is a k-gram, and of each
``window - k + 1`` consecutive k-grams the one with the smallest hash is kept.
The choice depends on the window's words alone, so two texts that share
``window`` consecutive words keep a common fingerprint. Documents and benchmark
items are fingerprinted alike, joined on the fingerprint, compared word by word
and extended to both sides; a match of at least ``window`` words is a hit.
Items shorter than ``window`` words are one k-gram of their own length, looked
up at every document position (winnowing with one k-gram per window).

Before the join a document's fingerprints pass a bitmap of all benchmark
fingerprints, which only spares shuffle: a set bit is still joined and compared.

Defined cases: null and empty texts have no words and no hits; an item without
words is never found; repeated item rows count once by item_id, a null item_id
is listed as empty text; repeated documents each get a row; an empty benchmark
leaves every document clean; an empty document table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.llm.bitmap import bitmap, listed
from territoria.llm.common import cut, text_key
from territoria.llm.words import (ALNUM, lowered, mix, ngram_hashes, same_row, split_words, text_blocks,
                                  word_hashes)

WINDOW, K = 10, 5

HIT = pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("short", pa.bool_()), ("pos", pa.int64()), ("left", pa.list_(pa.string())),
                 ("mid", pa.string()), ("right", pa.list_(pa.string()))])
HIT_SQL = ("array<struct<fp:bigint,size:int,short:boolean,pos:bigint,left:array<string>,mid:string,right:array<string>>>")


def winnowed(words: np.ndarray, rows: np.ndarray, window: int = WINDOW, k: int = K):
    """Positions and hashes of the k-grams kept from every full window."""
    grams = ngram_hashes(words, k)
    inside = same_row(rows, window)
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = len(inside)
    best, where = grams[:count].copy(), np.zeros(count, np.int64)
    for j in range(1, window - k + 1):
        lower = grams[j: j + count] < best
        best[lower] = grams[j: j + count][lower]
        where[lower] = j
    kept = np.unique((np.arange(count) + where)[inside])
    return kept, grams[kept]


def whole_grams(words: np.ndarray, rows: np.ndarray, size: int):
    """Positions and hashes of all runs of ``size`` words within a row."""
    at = np.flatnonzero(same_row(rows, size))
    return at, mix(ngram_hashes(words, size)[at] ^ np.uint64(size))


class Fingerprints:
    """Task function: one row per text with its words counted and fingerprints
    listed, those outside the filter left out. ``short`` are the item sizes
    below the window; for items themselves it is None (each has its own size)."""

    def __init__(self, short: list[int] | None, bitmap):
        self.short, self.bitmap = short, bitmap

    def _listed(self, at: np.ndarray, fps: np.ndarray):
        if self.bitmap is None or not len(fps):
            return at, fps
        seen = listed(self.bitmap.value, fps)
        return at[seen], fps[seen]

    def _hits(self, data, starts, ends, rows, count: int) -> list[list[dict] | None]:
        found: list[list[dict] | None] = [None] * count
        words = word_hashes(data, starts, ends)
        per_row = np.bincount(rows, minlength=count)
        first = np.concatenate([[0], np.cumsum(per_row)])

        def text(i: int) -> str:
            return data[starts[i]: ends[i]].tobytes().decode("utf-8", "replace")

        def add(at, fps, size: int, reach: int) -> None:
            for i, fp in zip(at.tolist(), fps.view(np.int64).tolist()):
                row = int(rows[i])
                lo, hi = int(first[row]), int(first[row + 1])
                hit = {"fp": fp, "size": size, "short": not reach, "pos": i - lo, "mid": " ".join(map(text, range(i, i + size))),
                       "left": [text(j) for j in range(i - 1, max(lo, i - reach) - 1, -1)],
                       "right": [text(j) for j in range(i + size, min(hi, i + size + reach))]}
                if found[row] is None:
                    found[row] = []
                found[row].append(hit)

        add(*self._listed(*winnowed(words, rows)), K, WINDOW - K)
        for size in range(1, WINDOW) if self.short is None else self.short:
            at, fps = whole_grams(words, rows, size)
            if self.short is None:
                own = per_row[rows[at]] == size
                at, fps = at[own], fps[own]
            add(*self._listed(at, fps), size, 0)
        return found

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits = [], []
            for _, data, offsets in text_blocks(batch.column("text")):
                data = lowered(data)
                starts, ends, rows = split_words(data, offsets, ALNUM)
                n = len(offsets) - 1
                counts.append(np.bincount(rows, minlength=n))
                hits += self._hits(data, starts, ends, rows, n)
            kept = [c for c in batch.schema.names if c != "text"]
            total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(total, pa.int64()), pa.array(hits, pa.list_(HIT))],
                names=[*kept, "n_words", "hits"])


def _run(mine: str, theirs: str, reach: int) -> Column:
    """How many leading words of two context lists are equal."""
    total, alike = F.lit(0), F.lit(1)
    for i in range(reach):
        same = F.expr(f"coalesce(get({mine}, {i}) = get({theirs}, {i}), false)")
        alike = alike * same.cast("int")
        total = total + alike
    return total


def item_fingerprints(benchmark: DataFrame) -> DataFrame:
    found = benchmark.select("item_id", "text").mapInArrow(
        Fingerprints(None, None), f"item_id bigint, n_words bigint, hits {HIT_SQL}")
    one = found.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.explode("hits").alias("h"))
    return cut(one.select("item", "h.fp", "h.size", "h.short", F.col("h.left").alias("item_left"), "h.mid",
                          F.col("h.right").alias("item_right")).distinct())


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated."""
    items = item_fingerprints(benchmark)
    short = sorted(r[0] for r in items.where("short").select("size").distinct().collect())
    seen = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_key().alias("text_key"), "text")
    base = cut(seen.mapInArrow(Fingerprints(short, bitmap(items, "fp")),
                               f"doc_id bigint, row bigint, text_key bigint, n_words bigint, hits {HIT_SQL}"))
    hit = base.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    both = hit.join(items, ["fp", "size", "short", "mid"]).select(
        "row", "item", "size", "short", "pos", _run("left", "item_left", WINDOW - K).alias("l"),
        _run("right", "item_right", WINDOW - K).alias("r"))
    spans = cut(both.where(F.col("short") | (F.col("l") + F.col("r") + K >= WINDOW)).select(
        "row", "item", (F.col("pos") - F.col("l")).alias("start"),
        (F.col("pos") + F.col("size") + F.col("r")).alias("end")))
    hit_words = (spans.select("row", "start", "end").distinct()
                 .select("row", F.explode(F.sequence("start", F.col("end") - 1)).alias("at")).distinct()
                 .groupBy("row").agg(F.count(F.lit(1)).alias("n_hit")))
    hit_items = (spans.select("row", "item").distinct().groupBy("row")
                 .agg(F.array_sort(F.collect_list("item")).alias("items")))
    listed = F.coalesce(F.col("items"), F.expr("array()").cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("bigint"))
    return (base.drop("hits").join(hit_words.join(hit_items, "row"), "row", "left").select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with all their columns and repeated rows."""
    names = docs.columns
    dirty = (contamination(docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__dirty")).distinct())
    keyed = docs.withColumn("__key", text_key())
    return keyed.join(dirty, keyed["doc_id"].eqNullSafe(dirty["__id"]) & (keyed["__key"] == dirty["__dirty"]),
                      "left_anti").select(*names)
