"""N-gram Jaccard join by chosen paths.

Every text is the set of its five-word shingles (lower-cased words; a shorter
text is one shingle). Equal sets become one class before the join. A set is
embedded by ``COORDS`` min-hashes, each a token sampled from the set such that
two sets agree on it with their Jaccard similarity as probability. A run has
``DEPTH`` coordinates of its own, so runs are independent, and splits the
classes recursively on the sampled tokens: a node of at most ``LEAF`` sets is compared by brute force, a larger one is
split on the run's next coordinate, down to ``DEPTH``. Runs are repeated until
a pair at the threshold meets in a leaf with probability ``RECALL``, even if
every node on its way is split down to the last level.

A leaf that stays large (a passage or a text with very many near copies) is cut
into pairs of blocks of at most ``BLOCK`` sets, so every comparison has a bounded
number of sets. A pair that meets in several runs is compared in the first.
Candidates by sketch (far below the threshold) are then compared by their whole
shingle sets. No row is made per pair: a block returns each set's number of
links and the edges of a spanning forest.

Defined cases: null and empty texts have no shingles and no links, each is a
class of its own; repeated rows and equal shingle sets are one class with all
their rows listed; a null doc_id joins like any other but does not name a
class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.bitmap import bitmap, listed
from territoria.llm.common import cut, keep_rows, text_key
from territoria.llm.components import components
from territoria.llm.words import ALNUM, lowered, mix, ngram_hashes, split_words, text_blocks, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
FIRST, DEPTH = 2, 4
LEAF, BLOCK = 16, 256
RECALL = 0.99999


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** depth))


RUNS = runs_for()
COORDS = RUNS * DEPTH
#: sketch similarity below which a pair is not compared: six deviations under the threshold
SKETCH = THRESHOLD - 6 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / COORDS)

_draw = np.random.default_rng(20)
_FACTOR = _draw.integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 1 << 63, COORDS, dtype=np.uint64)
#: the coordinates of every run, no two of all runs alike
PATHS = _draw.permutation(COORDS).reshape(RUNS, DEPTH)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a block."""
    data = lowered(data)
    starts, ends, rows = split_words(data, offsets, ALNUM)
    words = word_hashes(data, starts, ends)
    grams = ngram_hashes(words, SHINGLE)
    first = np.searchsorted(rows, np.arange(len(offsets)))
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= SHINGLE:
            own = grams[lo: hi - SHINGLE + 1]
        elif hi > lo:
            own = ngram_hashes(words[lo:hi], hi - lo)
        else:
            own = grams[:0]
        out.append(np.unique(own))
    return out


def identity(members: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    mixed = mix(members ^ np.uint64(0x5851F42D4C957F2D))
    a, b = mixed.sum(dtype=np.uint64), mix(mixed).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


class Sketches:
    """Task function: size, identity and min-hashes of each text's set."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, marks = [], [], []
            for _, data, offsets in text_blocks(batch.column("text")):
                sets = shingle_sets(data, offsets)
                sizes += map(len, sets)
                names += map(identity, sets)
                marks += self.marks(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), batch.column("text_key"), pa.array(sizes, pa.int64()),
                 pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()),
                 pa.array(marks, pa.binary()), pa.array([m and m[::4] for m in marks], pa.binary())],
                names=["doc_id", "row", "text_key", "size", "h1", "h2", "marks", "short"])

    @staticmethod
    def marks(sets: list[np.ndarray]) -> list[bytes | None]:
        full = [s for s in sets if len(s)]
        if not full:
            return [None] * len(sets)
        members = np.concatenate(full)
        begin = np.cumsum([0] + [len(s) for s in full[:-1]])
        low = np.empty((len(full), COORDS), dtype="<u4")
        for j in range(COORDS):
            low[:, j] = np.minimum.reduceat((members * _FACTOR[j] + _ADD[j]) >> np.uint64(32), begin)
        rows = iter(low)
        return [next(rows).tobytes() if len(s) else None for s in sets]


class Nodes:
    """Task function: the node of each class in every run at one depth."""

    def __init__(self, depth: int):
        self.depth = depth

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            marks = np.frombuffer(b"".join(batch.column("marks").to_pylist()), "<u4").reshape(n, COORDS).astype(np.uint64)
            if "run" in batch.schema.names:
                run = batch.column("run").to_numpy().astype(np.int64)
                rep = batch.column("rep").to_numpy()
            else:
                run = np.tile(np.arange(RUNS), n)
                rep = np.repeat(batch.column("rep").to_numpy(), RUNS)
                marks = np.repeat(marks, RUNS, axis=0)
            node = run.astype(np.uint64)
            at = np.arange(len(run))
            for level in range(self.depth):
                node = mix(node * np.uint64(0x9E3779B97F4A7C15) + marks[at, PATHS[run, level]] + np.uint64(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep), pa.array(run.astype(np.int32)), pa.array(node.view(np.int64))],
                names=["rep", "run", "node"])


def leaves(classes: DataFrame) -> DataFrame:
    """(rep, run, node, n): every class's leaf of two or more classes in each run."""
    marks = classes.select("rep", "marks")
    rows, out = marks, None
    for depth in range(FIRST, DEPTH + 1):
        nodes = rows.mapInArrow(Nodes(depth), "rep bigint, run int, node bigint")
        nodes = cut(nodes) if depth == FIRST else nodes
        # written, so that both sides of the join are shuffled and a large node can be split
        counts = cut(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        shared = cut(nodes.join(counts, "node"))
        leaf = shared if depth == DEPTH else shared.where(F.col("n") <= LEAF)
        out = leaf if out is None else out.unionByName(leaf)
        rows = shared.where(F.col("n") > LEAF).select("rep", "run").join(marks, "rep")
    return out


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``; groups are small."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        rest = part if rest is None else pa.concat_tables([rest, part])
        keys = rest.column(key).to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if len(change):
            yield rest.slice(0, int(change[-1]) + 1)
            rest = rest.slice(int(change[-1]) + 1)
    if rest is not None:
        yield rest


def bounds(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]).tolist()
    return zip(edge[:-1], edge[1:])


class Candidates:
    """Task function over blocks: each class's partners by sketch, of pairs that
    meet here first."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "block"):
            table = table.combine_chunks()
            block, rep = table.column("block").to_numpy(), table.column("rep").to_numpy()
            run, size = table.column("run").to_numpy(), table.column("size").to_numpy()
            n = len(rep)
            side, two = table.column("side").to_numpy(), table.column("two").to_numpy()
            short = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(n, COORDS)
            leaf = np.array(table.column("leaf").to_pylist(), dtype=np.int64).reshape(n, RUNS)
            rows, partners = [], []
            for lo, hi in bounds(block):
                here = slice(lo, hi)
                m = hi - lo
                if m < 2:
                    continue
                near = np.zeros((m, m), dtype=bool)
                s = size[here]
                for i in range(m - 1):
                    alike = (short[lo + i] == short[lo + i + 1: hi]).sum(axis=1) >= SKETCH * COORDS
                    fits = np.minimum(s[i], s[i + 1:]) >= THRESHOLD * np.maximum(s[i], s[i + 1:])
                    ok = np.flatnonzero(alike & fits) + i + 1
                    if len(ok) and two[lo]:
                        ok = ok[side[lo + ok] != side[lo + i]]
                    if len(ok):
                        met = leaf[lo + ok, : run[lo]] == leaf[lo + i, : run[lo]]
                        near[i, ok[~(met & (leaf[lo + i, : run[lo]] != 0)).any(axis=1)]] = True
                for i in np.flatnonzero(near.any(axis=1) | near.any(axis=0)).tolist():
                    rows.append(lo + i)
                    partners.append(rep[lo + np.flatnonzero(near[i])].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[rows], pa.int64()), pa.array(rep[rows], pa.int64()),
                 pa.array(partners, pa.list_(pa.int64()))], names=["block", "rep", "partners"])


def overlaps(sets: list[np.ndarray], pairs: list[tuple[int, int]]) -> np.ndarray:
    """Sizes of the intersections of the listed pairs of sorted sets."""
    if len(pairs) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs])
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, len(tokens), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        there = np.zeros((len(sets), 4096), dtype=np.float32)
        there[row[a:b], column[a:b] - lo] = 1
        both += there @ there.T
    i, j = np.array(pairs).T
    return both[i, j].astype(np.int64)


class Links:
    """Task function over blocks: exact comparison of the candidates. Returns for
    each class its linked classes and documents here and its root in the block."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "block"):
            table = table.combine_chunks()
            block, rep = table.column("block").to_numpy(), table.column("rep").to_numpy()
            weight, members = table.column("weight").to_numpy(), table.column("members")
            partners = table.column("partners")
            out = []
            for lo, hi in bounds(block):
                at = {int(r): i for i, r in enumerate(rep[lo:hi])}
                pairs = [(i, at[p]) for i in range(hi - lo) for p in partners[lo + i].as_py()]
                if not pairs:
                    continue
                sets = [np.frombuffer(members[i].as_py(), "<u8") for i in range(lo, hi)]
                shared = overlaps(sets, pairs)
                links, docs, root = np.zeros(hi - lo, int), np.zeros(hi - lo, int), list(range(hi - lo))

                def find(i: int) -> int:
                    while root[i] != i:
                        root[i] = i = root[root[i]]
                    return i

                for (i, j), both in zip(pairs, shared.tolist()):
                    if both >= THRESHOLD * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                        links[[i, j]] += 1
                        docs[i] += weight[lo + j]
                        docs[j] += weight[lo + i]
                        a, b = find(i), find(j)
                        if a != b:
                            a, b = (a, b) if rep[lo + a] < rep[lo + b] else (b, a)
                            root[b] = a
                out += [(int(rep[lo + i]), int(links[i]), int(docs[i]), int(rep[lo + find(i)]))
                        for i in np.flatnonzero(links).tolist()]
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 names=["rep", "links", "docs", "root"])


class Sets:
    """Task function: whole shingle sets of the texts that may be wanted."""

    def __init__(self, wanted):
        self.wanted = wanted

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = self.wanted.value
        for batch in batches:
            for _, data, offsets in text_blocks(batch.column("text")):
                found = {}
                for s in shingle_sets(data, offsets):
                    name = identity(s)
                    if len(s) and listed(table, np.array(name[:1], np.int64).view(np.uint64))[0]:
                        found[name] = s.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64()),
                     pa.array(list(found.values()), pa.binary())], names=["h1", "h2", "members"])


def by_block(df: DataFrame) -> DataFrame:
    return df.repartition("block").sortWithinPartitions("block")


def blocks_of(classes: DataFrame) -> DataFrame:
    """Leaf members dealt into pairs of blocks, each with its leaves in all runs."""
    found = cut(leaves(classes))
    own = found.groupBy("rep").agg(*[
        F.coalesce(F.max(F.when(F.col("run") == r, F.xxhash64("node"))), F.lit(0)).alias(f"r{r}") for r in range(RUNS)])
    own = own.select("rep", F.array(*[f"r{r}" for r in range(RUNS)]).alias("leaf"))
    members = found.join(own.join(classes.select("rep", "size", "short"), "rep"), "rep")
    placed = (members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
              .withColumn("side", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
              .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))))
    # a block of one side holds that side alone, a block of two sides compares across them only
    low, high = F.least("side", "other"), F.greatest("side", "other")
    return placed.select("rep", "run", "size", "side", "short", "leaf", (low != high).alias("two"),
                         F.xxhash64("node", low, high).alias("block"))


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, links, docs, root) of every class that has a link, by block."""
    blocks = blocks_of(classes)
    near = cut(by_block(blocks).mapInArrow(Candidates(), "block bigint, rep bigint, partners array<bigint>"))
    wanted = near.select("rep").distinct().join(classes.select("rep", "h1", "h2", "weight"), "rep")
    sets = docs.select("text").mapInArrow(Sets(bitmap(wanted, "h1")), "h1 bigint, h2 bigint, members binary")
    own = sets.join(wanted, ["h1", "h2"]).select("rep", "weight", "members").dropDuplicates(["rep"])
    return cut(by_block(near.join(own, "rep")).mapInArrow(Links(), "rep bigint, links bigint, docs bigint, root bigint"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, row, n_shingles, class_id, n_links,
    n_linked_texts, n_copies.

    class_id is the smallest doc_id of the connected component; n_links counts
    the other documents at the threshold or above, n_linked_texts the different
    shingle sets among them, n_copies the other documents with the same set.
    """
    sketch = cut(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_key().alias("text_key"), "text")
                 .mapInArrow(Sketches(), "doc_id bigint, row bigint, text_key bigint, size bigint, h1 bigint, "
                                         "h2 bigint, marks binary, short binary"))
    classes = cut(sketch.where("size > 0").groupBy("h1", "h2").agg(
        F.min("row").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("size").alias("size"),
        F.first("marks").alias("marks"), F.first("short").alias("short")))
    found = links(docs, classes)
    total = found.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (classes.select("rep", "h1", "h2", "weight").join(total, "rep", "left")
             .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
             .select("h1", "h2", "weight", "links", "docs", F.coalesce("root", "rep").alias("root")))
    rows = sketch.drop("marks", "short").join(named, ["h1", "h2"], "left")
    smallest = cut(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id")))
    none = F.lit(0).cast("bigint")
    return rows.join(smallest, "root", "left").select(
        "doc_id", "text_key", "row", F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "root",
        (F.coalesce("docs", none) + F.coalesce(F.col("weight") - 1, none)).alias("n_links"),
        F.coalesce("links", none).alias("n_linked_texts"), F.coalesce(F.col("weight") - 1, none).alias("n_copies"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of every class, the one with the smallest doc_id, with all its
    columns; documents without words stay."""
    rows = near_duplicates(docs)
    first = rows.where("n_shingles > 0").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_key")).alias("k"))
    kept = first.select("k.doc_id", "k.text_key").unionByName(
        rows.where("n_shingles = 0").select("doc_id", "text_key").distinct())
    return keep_rows(docs, kept)
