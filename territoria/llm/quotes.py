"""Chat formatting by quotation linking (DataFrame functions only).

A line's quote level is the number of ``>`` marks it starts with; consecutive
lines of one level are a passage. Passages and the messages' own texts are
normalised (lower case, runs of blanks and punctuation as one space) and cut
into units: the whole, paragraphs, lines, sentences across line ends, and
winnowed spans of ``SPAN`` words (one of every ``STEP`` in a row, the smallest
hash), which any common run of ``SPAN + STEP - 1`` words holds, wherever lines
break. Units are joined by their hash and compared. A unit is taken to come from
the latest earlier message that has it; a passage comes from the message with
its longest unit (then most characters, then the latest). A message replies to
the message that its first-level passages quote most of, else to the latest
earlier turn that exists; if there is none, it starts a thread. Thread and depth
come from pointer doubling and positions from range partitions, so a very long
conversation is never one group. A reply always has a later turn than what it
replies to, so the turn orders a thread; ``position`` numbers its places.

Only conversations with a quotation are split into lines and joined.

Defined cases: null and empty texts have no lines and an empty text; a null
conv_id or turn is a message of its own without reply and position; rows that
repeat conv_id and turn are one place in the conversation, each keeping its own
row, and equal rows are linked as one; an attribution line right above a
quotation goes with it; a passage found nowhere is removed and not linked; an
empty table gives an empty result; other columns are kept, but one that has the
name of a result column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from territoria.llm.common import cut, text_of
from territoria.operators.ordinal import ordinal_within_key, previous_in_key

MARK = r"^(?:[ \t]{0,3}>)+"
ATTRIBUTION = r"(?:wrote|writes|said|schrieb|a écrit|escribió)[^\n]{0,40}:[ \t]*"
#: words of a span, spans in a row of which one is a unit
SPAN, STEP = 5, 4
RESULT = ["reply_to", "linked", "thread", "depth", "n_passages", "n_linked", "position"]


def level_of(line: Column) -> Column:
    """Number of quote marks a line starts with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), r"[ \t]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"[\s\p{Punct}]+", " ")))


def lines_of(text: Column) -> Column:
    """Structs (level, body) of all lines in order."""
    return F.transform(F.split(text, r"\r?\n"), lambda x: F.struct(
        level_of(x).alias("level"), F.regexp_replace(x, MARK + r" ?", "").alias("body")))


def own_text(text: Column) -> Column:
    """The text without quoted lines and the attribution lines above them."""
    lines = F.regexp_replace(text, r"\r\n", "\n")
    lines = F.regexp_replace(lines, rf"(?im)^(?![ \t]{{0,3}}>)[^\n]*{ATTRIBUTION}\n(?=[ \t]{{0,3}}>)", "")
    return F.trim(F.regexp_replace(lines, r"(?m)^[ \t]{0,3}>[^\n]*(?:\n|\z)", ""), F.lit(" \t\r\n"))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, row, passage, level, body): the quoted passages of every message."""
    lines = (messages.where(text_of().rlike(r"(?m)" + MARK))
             .select("conv_id", "turn", "row", F.posexplode(lines_of(text_of())).alias("pos", "line"))
             .select("conv_id", "turn", "row", "pos", "line.level", "line.body"))
    own = Window.partitionBy("row").orderBy("pos")
    like = Window.partitionBy("row", "level").orderBy("pos")
    runs = lines.withColumn("run", F.row_number().over(own) - F.row_number().over(like))
    return (runs.where("level > 0").groupBy("conv_id", "turn", "row", "level", "run")
            .agg(F.min("pos").alias("passage"), F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("lines"))
            .select("conv_id", "turn", "row", "passage", "level",
                    F.array_join(F.col("lines.body"), "\n").alias("body")))


def with_units(df: DataFrame, body: str) -> DataFrame:
    """A row per distinct normalised unit of the text column ``body`` (column unit)."""
    text = F.col(body)
    parts = F.flatten(F.array(F.array(text), F.split(text, r"(?:\r?\n){2,}"), F.split(text, r"\r?\n"),
                              F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?]) ")))
    cut_up = df.select("*", F.array_distinct(F.transform(parts, normalised)).alias("__parts"),
                       F.split(normalised(text), " ").alias("__words"))
    spans = F.when(F.size("__words") >= SPAN, F.transform(
        F.sequence(F.lit(1), F.size("__words") - SPAN + 1),
        lambda i: F.struct(F.xxhash64(F.array_join(F.slice("__words", i, SPAN), " ")).alias("hash"), i.alias("at"))))
    spanned = cut_up.select("*", spans.alias("__spans"))
    chosen = F.when(F.col("__spans").isNotNull(), F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("__spans") - STEP + 1, F.lit(1))),
        lambda i: F.array_min(F.slice("__spans", i, STEP))["at"])))
    picked = spanned.select("*", chosen.alias("__chosen"))
    grams = F.transform(F.coalesce("__chosen", F.array().cast("array<int>")),
                        lambda at: F.array_join(F.slice("__words", at, SPAN), " "))
    return (picked.select(*df.columns, F.explode(F.array_distinct(F.concat("__parts", grams))).alias("unit"))
            .where("unit != ''"))


def latest_holders(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``asked`` (conv_id, unit, turn, ...) with ``original``: the latest earlier turn in ``held`` (conv_id, unit, original).

    Both are sorted together by range, so a unit with very many rows spans
    slices; a slice takes what it lacks from the slices before.
    """
    more = [c for c in asked.columns if c not in ("conv_id", "unit", "turn")]
    kinds = dict(asked.dtypes)
    both = asked.withColumn("original", F.lit(None).cast(kinds["turn"])).withColumn("asks", F.lit(True)).unionByName(
        held.select("conv_id", "unit", F.col("original").alias("turn"), "original", F.lit(False).alias("asks"),
                    *[F.lit(None).cast(kinds[c]).alias(c) for c in more]))
    key = F.xxhash64("conv_id", "unit")
    order = ["key", "conv_id", "unit", "turn", F.col("asks").desc()]
    local = cut(both.withColumn("key", key).repartitionByRange("key", "conv_id", "unit", "turn")
                .sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    local = local.withColumn("slice", F.shiftright("place", 33))
    here = Window.partitionBy("slice", "key", "conv_id", "unit").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ends = local.groupBy("slice", "key", "conv_id", "unit").agg(F.max("original").alias("last"))
    before = Window.partitionBy("key", "conv_id", "unit").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("slice", "key", "conv_id", "unit", F.max("last").over(before).alias("carried"))
    own = local.withColumn("latest", F.last("original", ignorenulls=True).over(here)).where("asks").drop("original")
    return (own.join(carried, ["slice", "key", "conv_id", "unit"])
            .select(*asked.columns, F.coalesce("latest", "carried").alias("original")))


def quotation_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, row, passage, level, original, quoted): each passage's
    original message (null if none) and the characters found there."""
    quoted = cut(passages(messages))
    wanted = quoted.select("conv_id").distinct()
    texts = messages.join(wanted, "conv_id", "left_semi").select(
        "conv_id", F.col("turn").alias("original"), own_text(text_of()).alias("body"))
    held = with_units(texts.where("original is not null"), "body").select("conv_id", "unit", "original").distinct()
    asked = with_units(quoted, "body").select("conv_id", "unit", "turn", "row", "passage")
    found = (latest_holders(asked.where("turn is not null"), held).where("original is not null")
             .groupBy("row", "passage", "original")
             .agg(F.max(F.length("unit")).alias("most"), F.sum(F.length("unit")).alias("quoted")))
    best = found.groupBy("row", "passage").agg(F.max(F.struct("most", "quoted", "original")).alias("best"))
    return (quoted.drop("body").join(best, ["row", "passage"], "left")
            .select("conv_id", "turn", "row", "passage", "level", F.col("best.original").alias("original"),
                    F.col("best.quoted").alias("quoted")))


def threads(places: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of distinct places (conv_id, turn, up), by pointer doubling."""
    state = places.select("conv_id", "turn", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
                          F.coalesce("up", "turn").alias("thread"))
    done, rest = [state.where("up is null")], cut(state.where("up is not null"))
    # only places that have not reached their thread's start are joined again
    while rest.head(1):
        known = rest
        for part in done:
            known = known.unionByName(part)
        above = known.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"),
                             F.col("depth").alias("more"), F.col("thread").alias("top"))
        moved = cut(rest.join(above, ["conv_id", "up"], "left").select(
            "conv_id", "turn", F.col("next").alias("up"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("top", "thread").alias("thread")))
        done.append(moved.where("up is null"))
        rest = moved.where("up is not null")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("up")


def format_conversations(messages: DataFrame) -> DataFrame:
    """The messages with their text free of quotations, and reply_to, linked,
    thread, depth, n_passages, n_linked and position in the thread's reply
    order (rows of one place share it); other columns are kept."""
    other = [c for c in messages.columns if c not in ("conv_id", "turn", "text", *RESULT)]
    row = F.struct(F.xxhash64("conv_id", "turn", text_of()).alias("a"), F.xxhash64(F.lit(7), text_of(), "turn", "conv_id").alias("b"))
    rows = messages.select("conv_id", "turn", "text", F.struct(*other).alias("__other") if other else F.lit(None).alias("__other"),
                           row.alias("__row"))
    distinct = rows.select("conv_id", "turn", "text", F.col("__row").alias("row")).dropDuplicates(["row"])
    found = cut(quotation_links(distinct))
    per_message = found.groupBy(F.col("row").alias("__row")).agg(F.count(F.lit(1)).alias("n_passages"), F.count("original").alias("n_linked"))
    quoted = (found.where("level = 1 and original is not null").groupBy("conv_id", "turn", "original")
              .agg(F.sum("quoted").alias("quoted")).groupBy("conv_id", "turn")
              .agg(F.max(F.struct("quoted", "original")).alias("best"))
              .select("conv_id", "turn", F.col("best.original").alias("cited")))
    places = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    followed = previous_in_key(places, "conv_id", "turn", "turn", "previous")
    replies = cut(followed.join(quoted, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("cited", "previous").alias("up"), F.col("cited").isNotNull().alias("linked")))
    known = replies.withColumnRenamed("up", "reply_to").join(threads(replies), ["conv_id", "turn"])
    known = ordinal_within_key(known, ["conv_id", "thread"], [F.col("turn")], out="position")
    zero = F.lit(0).cast("bigint")
    return (rows.join(known, ["conv_id", "turn"], "left").join(per_message, "__row", "left")
            .select("conv_id", "turn", *[F.col("__other").getField(c).alias(c) for c in other], own_text(text_of()).alias("text"),
                    "reply_to", F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("thread", "turn").alias("thread"),
                    F.coalesce("depth", zero).alias("depth"), F.coalesce("n_passages", zero).alias("n_passages"),
                    F.coalesce("n_linked", zero).alias("n_linked"), "position"))


def in_reply_order(formatted: DataFrame) -> DataFrame:
    """Sorted by range, so a long conversation may span tasks."""
    return formatted.repartitionByRange("conv_id", "thread", "position").sortWithinPartitions("conv_id", "thread", "position")
