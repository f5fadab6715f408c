"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so (the first sentence or line end
after ``low`` characters, else after ``high``), so equal texts have equal cuts.
Each chunk gets a 128-bit identifier. Identifiers are verified: all chunks are
reduced to distinct (identifier, content) rows, with a partial reduction in
every task, and an identifier that names two contents makes every recipe carry
the contents themselves. Equal texts are rows with equal ordered identifier
lists; only these lists are grouped and joined, so a document's text is moved
once, as distinct chunks, whatever its number of copies.

Defined cases: null and empty texts are equal (empty recipe); of equal texts
the row with the largest doc_id stays, a null doc_id counts as smallest; among
rows that repeat text and doc_id exactly one stays; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import cut, keep_rows, text_key, text_of

LOW, HIGH = 512, 4096


def chunk_pattern(low: int = LOW, high: int = HIGH) -> str:
    return rf"(?s).{{{low},{high}}}?(?:[.!?]\s|\n|\z)|.{{1,{high}}}"


def chunks_of(text: Column, low: int = LOW, high: int = HIGH) -> Column:
    """Content-defined chunks; joined together they are the text."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(low, high)), F.lit(0))


def chunk_id(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(11), chunk).alias("b"))


def clashing_ids(docs: DataFrame, ident: Callable[[Column], Column] = chunk_id) -> DataFrame:
    """Identifiers that name more than one chunk content."""
    chunk = F.col("chunk")
    contents = (docs.select(F.explode(chunks_of(text_of())).alias("chunk"))
                .select(ident(chunk).alias("id"), chunk).distinct())
    return contents.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def recipes(docs: DataFrame, ident: Callable[[Column], Column] = chunk_id) -> DataFrame:
    """doc_id, row, text_key, text_sha256 and the verified ordered identifier list."""
    clash = bool(clashing_ids(docs, ident).head(1))

    def element(chunk: Column) -> Column:
        return F.struct(ident(chunk).alias("id"), (chunk if clash else F.lit("")).alias("content"))

    text = text_of()
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_key().alias("text_key"),
                       F.sha2(text, 256).alias("text_sha256"),
                       F.transform(chunks_of(text), element).alias("recipe"))


def exact_duplicates(docs: DataFrame, ident: Callable[[Column], Column] = chunk_id) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, text_key."""
    rec = cut(recipes(docs, ident))
    # written, so that both sides of the join are shuffled and a large group can be split
    groups = cut(rec.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("keep"),
                                           F.count(F.lit(1)).alias("group_size")))
    return rec.join(groups, "recipe").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256", "text_key")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    return keep_rows(docs, exact_duplicates(docs).where("kept").select("doc_id", "text_key"))
