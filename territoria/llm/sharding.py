"""Sharding by balanced label propagation.

Documents are linked through hubs (here: equal texts; the operator takes any
(id, hub) incidence). Linked documents start in the order of their hubs, cut
where a shard's share of them ends, so that at most one hub a border is torn at
first. In every round a hub's votes are its documents per shard - a partial count, so
a hub with very many documents costs a row per shard - and a document asks for
the shard with most votes of its hubs if that has more votes than its own, ties
going to the shard all its neighbours prefer in this round too. The counts asked
per pair of shards decide how many move: first along cycles of shards, which
exchange equal numbers, then into free room. Only documents of torn hubs are
looked at, as no other has a reason to move. A shard that can give neither is
left out until nothing else moves. Rounds end when nothing moves with any of
``TIES`` choices among ties in a row, or (documents of several hubs) when moves no longer
bring linked documents together. Unlinked documents cut no edge: they fill the
free places, so that shards differ by one row at most.

Ordinals come from counts per input partition and key, never from a sort of
all rows.

Defined cases: null and empty texts are equal texts of zero bytes; rows that
repeat doc_id and text are documents like any other; fewer documents than
shards leave shards empty; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from territoria.llm.common import cut, text_of

SHARDS = 24
#: choices among ties tried before rounds end, rows numbered together
TIES, PART = 6, 100_000


def ordinals(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 0. ``df`` has the columns part and row:
    row orders the rows of a part; a part holds a task's share of the input."""
    nth = Window.partitionBy("part", *keys).orderBy("row")
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = (df.groupBy("part", *keys).agg(F.count(F.lit(1)).alias("n"))
            .select("part", *keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    return (df.withColumn("nth", F.row_number().over(nth) - 1).join(base, ["part", *keys])
            .withColumn(name, F.col("base") + F.col("nth")).drop("base", "nth"))


def cycle(left: list[dict[int, int]], start: int) -> list[int]:
    """A shortest cycle through ``start`` over the capacities left; empty if there is none."""
    came, queue = {}, [start]
    for a in queue:
        for b, n in left[a].items():
            if n > 0 and b not in came:
                came[b] = a
                if b == start:
                    path = [start]
                    while len(path) == 1 or path[-1] != start:
                        path.append(came[path[-1]])
                    return path[::-1]
                queue.append(b)
    return []


def exchange(want: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the documents that ask for each (own, to) move: no shard's
    arrivals exceed its departures by more than its room."""
    free = len(room)
    left: list[dict[int, int]] = [{} for _ in range(free + 1)]
    for (a, b), n in want.items():
        left[a][b] = n

    def push(path: list[int]) -> None:
        steps = list(zip(path[:-1], path[1:]))
        n = min(left[a][b] for a, b in steps)
        for a, b in steps:
            left[a][b] -= n

    for a, b in want:
        if min(left[a][b], left[b].get(a, 0)) > 0:
            push([a, b, a])
    for s in range(free):
        while path := cycle(left, s):
            push(path)
    for s, n in enumerate(room):
        left[s][free] = n
    for s in range(free):
        # places given up in s; s itself takes none of them
        own, left[s][free], left[free] = left[s][free], 0, {s: sum(want.values())}
        while path := cycle(left, free):
            push(path)
        left[s][free] = own
    return {(a, b): n - left[a][b] for (a, b), n in want.items()}


def propagate(labels: DataFrame, links: DataFrame, capacity: list[int]) -> DataFrame:
    """New (id, shard) for (id, shard) labels and (id, hub) links, under the capacity of each shard."""
    shards = len(capacity)
    links = cut(links.select("id", "hub").distinct())
    labels = cut(labels)
    kept, most, stale, idle, step = labels, -1, 0, 0, 0
    left, shut, asked, tied = set(range(shards)), set(), None, False
    load = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    room = [capacity[s] - load.get(s, 0) for s in range(shards)]
    while True:
        if asked is None:
            here = links.join(labels, "id")
            # a row per hub, a column per shard: the join makes no row per document and shard
            votes = cut(here.groupBy("hub").agg(*[F.count(F.when(F.col("shard") == s, 1)).alias(f"v{s}") for s in range(shards)]))
            together = votes.agg(F.sum(F.expr("+".join(f"cast(v{s} as double) * v{s}" for s in range(shards))))).head()[0] or 0
            if together > most:
                kept, most, stale = labels, together, 0
            elif stale > TIES:
                return kept
            torn = votes.where(" + ".join(f"int(v{s} > 0)" for s in range(shards)) + " > 1").select("hub")
            touched = links.join(torn, "hub").select("id").distinct()
            asked = cut(here.join(touched, "id").withColumnRenamed("shard", "own").join(votes, "hub").groupBy("id", "own")
                        .agg(F.min("hub").alias("hub"), *[F.sum(f"v{s}").alias(f"v{s}") for s in range(shards)]))
        shown = [s for s in range(shards) if (room[s] > 0 or s in left) and s not in shut]
        choice = F.greatest(*[F.when(F.lit(s in shown) | (F.col("own") == s), F.struct(
            F.col(f"v{s}").alias("n"), F.xxhash64("hub", F.lit(s), F.lit(step)).alias("tie"), F.lit(s).alias("to")))
            for s in range(shards)], F.lit(None).cast("struct<n:bigint,tie:bigint,to:int>"))
        picked = cut(asked.select("id", "own", choice.alias("best"), F.array(*[f"v{s}" for s in range(shards)]).alias("v")))
        wish = picked.where("best.to != own").select(
            "id", "own", "best.to", (F.size(F.filter("v", lambda n: n == F.col("best.n"))) > 1).alias("tied"))
        counts = wish.groupBy("own", "to").agg(F.count(F.lit(1)).alias("n"), F.max("tied").alias("tied")).collect()
        want = {(r["own"], r["to"]): r["n"] for r in counts}
        tied = tied or any(r["tied"] for r in counts)
        moves = exchange(want, room)
        wanted, reached = {b for _, b in want}, {b for (_, b), n in moves.items() if n}
        step += 1
        if reached:
            parts = sum(want.values()) // PART + 1
            listed = ",".join(f"{moves.get((a, b), 0)}L" for a in range(shards) for b in range(shards))
            turn = ordinals(wish.select("own", "to", F.col("id").alias("row"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")),
                            ["own", "to"], "k")
            moved = turn.where(F.expr(f"k < element_at(array({listed}), cast(own * {shards} + to + 1 as int))"))
            labels = cut(labels.join(moved.select(F.col("row").alias("id"), "to"), "id", "left")
                         .select("id", F.coalesce("to", "shard").alias("shard")))
            for (a, b), n in moves.items():
                room[a], room[b] = room[a] + n, room[b] - n
            left, shut, stale, idle, asked = {a for a, _ in want}, shut | (wanted - reached), stale + 1, 0, None
        elif want:
            shut = shut | wanted
        elif (shut or len(left) < shards) and idle < (TIES if tied else 1):
            left, shut, idle, tied = set(range(shards)), set(), idle + 1, False
        else:
            return kept


def borders(quota: list[int], linked: int) -> list[int]:
    """Where the shards' shares of ``linked`` documents end, in proportion to the quotas."""
    total, ends, end = max(sum(quota), 1), [], 0
    for q in quota:
        end += q
        ends.append(end * linked // total)
    return ends


def start(linked: DataFrame, groups: DataFrame, quota: list[int]) -> DataFrame:
    """(id, shard): the rows (row, part, hub) in the order of their hubs (hub, n), cut at the borders.

    Hubs are numbered in range partitions; only the hubs that a border cuts have
    their rows numbered.
    """
    ranged = cut(groups.repartitionByRange("hub").withColumn("slice", F.spark_partition_id()))
    sizes = {r["slice"]: r["n"] for r in ranged.groupBy("slice").agg(F.sum("n").alias("n")).collect()}
    offset, listed = 0, []
    for k in sorted(sizes):
        listed += [F.lit(k), F.lit(offset).cast("long")]
        offset += sizes[k]
    if not listed:
        return linked.select(F.col("row").alias("id"), F.lit(0).alias("shard")).limit(0)
    ends = borders(quota, offset)
    before = F.sum("n").over(Window.partitionBy("slice").orderBy("hub").rowsBetween(Window.unboundedPreceding, -1))
    place = F.element_at(F.create_map(*listed), F.col("slice")) + F.coalesce(before, F.lit(0))

    def shard_at(at):
        return sum((F.when(at >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0)).cast("int")

    placed = ranged.withColumn("place", place).select(
        "hub", "place", shard_at(F.col("place")).alias("low"), shard_at(F.col("place") + F.col("n") - 1).alias("high"))
    rows = cut(linked.join(placed, "hub"))
    torn = ordinals(rows.where("low < high").select("row", "part", "hub", "place"), ["hub"], "k")
    return (rows.where("low = high").select(F.col("row").alias("id"), F.col("low").alias("shard"))
            .unionByName(torn.select(F.col("row").alias("id"), shard_at(F.col("place") + F.col("k")).alias("shard"))))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = text_of()
    rows = cut(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"),
                           (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
                           F.crc32(text.cast("binary")).alias("text_crc32"),
                           F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")).alias("hub")))
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    # written, so that both sides of the join are shuffled and a large group can be split
    groups = cut(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    linked = cut(rows.select("row", "part", "hub").join(groups.select("hub"), "hub"))
    labels = propagate(start(linked, groups, quota), linked.select(F.col("row").alias("id"), "hub"), quota)
    labelled = rows.drop("hub").join(labels.withColumnRenamed("id", "row"), "row", "left")
    placed = ordinals(labelled.where("shard is not null"), ["shard"], "slot")
    limit = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard").cast("int") + 1)
    stays = cut(placed.withColumn("stays", F.col("slot") < limit))
    kept = {r["shard"]: r["n"] for r in
            stays.where("stays").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    pool = (labelled.where("shard is null").drop("shard")
            .unionByName(stays.where("not stays").drop("shard", "slot", "stays")))
    # free places in order: the first `ends[0]` of the pool go to shard 0, and so on
    ends, end = [], 0
    for s in range(shards):
        end += quota[s] - kept.get(s, 0)
        ends.append(end)
    to = sum((F.when(F.col("k") >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    first = F.array(*[F.lit(e - (quota[s] - kept.get(s, 0)) - kept.get(s, 0)).cast("bigint") for s, e in enumerate(ends)])
    filled = (ordinals(pool, [], "k").withColumn("shard", to.cast("int"))
              .withColumn("slot", F.col("k") - F.element_at(first, F.col("shard") + 1)))
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    out = stays.where("stays").select(*columns).unionByName(filled.select(*columns))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                      F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
