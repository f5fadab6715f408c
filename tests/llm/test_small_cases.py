"""Defined cases of every operator: nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns with clashing names."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from territoria.llm import (chosen_path, html_mincut, packing, quality, quotes, recipes, sharding, substrings, toxicity,
                            winnow)

DOC = "doc_id long, text string, lang string, source string, n_chars long, row long, size long, part int, label int"
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [(1, "a b c d e f g h i j k l", "en"), (2, "a b c d e f g h i j k l", "en"), (2, "a b c d e f g h i j k l", "en"),
        (3, None, None), (4, "", "de"), (None, "only one here", None), (5, LONG, "en"), (6, LONG + " z", "en"),
        (7, "   \n\t ", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, None, 1, 7, 7, 7, 7) for i, t, g in ROWS], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_exact_dedup(docs, none):
    rows = {(r.doc_id, r.text_sha256): r for r in recipes.exact_duplicates(docs).collect()}
    a = hashlib.sha256(ROWS[0][1].encode()).hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[1, a].keep_id == 2 and rows[1, a].group_size == 3 and not rows[1, a].kept
    assert rows[3, empty].keep_id == 4 and rows[4, empty].kept
    assert recipes.exact_duplicates(docs).where("doc_id = 2 and kept").count() == 1  # one of the repeated rows
    out = recipes.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 2, 4, 5, 6, 7]
    assert recipes.exact_duplicates(none).count() == 0 and recipes.drop_exact_duplicates(none).count() == 0


def test_exact_dedup_with_clashing_identifiers(docs):
    def weak(chunk):
        return F.struct(F.length(chunk).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    assert recipes.clashing_ids(docs, weak).count() > 0
    pick = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    strong = sorted(map(str, recipes.exact_duplicates(docs).select(pick).collect()))
    assert sorted(map(str, recipes.exact_duplicates(docs, weak).select(pick).collect())) == strong


def test_chunks_are_the_text(spark):
    text = "One sentence. " * 300 + "x" * 20_000 + "\nA line 🙂.\n"
    df = spark.createDataFrame([(text,), ("",), (" ",)], "text string")
    for r in df.select("text", recipes.chunks_of(F.col("text")).alias("c")).collect():
        assert "".join(r.c) == r.text and all(len(c) <= recipes.HIGH + 2 for c in r.c)


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "B c D e f g h i j K", 0), (1, "b c d e f g h i j k", 0), (2, "one, here", 0),
                                   (3, None, 0), (None, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15", 0)],
                                  "item_id long, text string, doc_id long")
    rows = {r.doc_id: r for r in winnow.contamination(docs, bench).where("doc_id != 2 or doc_id is null").collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1].n_items) == (12, 10, 1)
    assert rows[1].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert (rows[None].n_hit, rows[None].n_items) == (2, 1)
    assert rows[5].n_hit == 11 and rows[5].n_items == 1 and rows[5].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[3].n_words == 0 and not rows[3].contaminated
    kept = winnow.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 7]
    assert winnow.contamination(none, bench).count() == 0
    assert winnow.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_near_duplicates(docs, none):
    rows = [r for r in chosen_path.near_duplicates(docs).collect()]
    by = {r.doc_id: r for r in rows}
    assert by[1].class_id == 1 and by[2].class_id == 1 and by[1].n_links == 2 and by[1].n_copies == 2
    assert by[5].class_id == by[6].class_id == 5 and by[5].n_linked_texts == 1
    assert by[3].class_id == 3 and by[4].class_id == 4 and by[7].n_links == 0
    out = chosen_path.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3, 4, 5, 7]
    assert chosen_path.near_duplicates(none).count() == 0 and chosen_path.drop_near_duplicates(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, with_ids=True).collect()
    lone = [r for r in rows if r.doc_id == 3]
    assert [(r.length, r.ids_crc32) for r in lone] == [(1, zlib.crc32((1).to_bytes(4, "little")))]
    assert len([r for r in rows if r.doc_id == 5]) == -(-(sum(r.length for r in rows if r.doc_id == 5)) // 4096)
    check_places(rows)
    assert packing.pack(none).count() == 0
    packed = packing.pack(docs, with_ids=True)
    joined = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in joined) == sum(r.length for r in rows) and all(len(r.ids) <= 4096 for r in joined)


def check_places(rows, size=4096):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size


def test_sharding(docs, none):
    rows = sharding.shard(docs, 3).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(3)]
    assert len(rows) == 9 and max(sizes) - min(sizes) <= 1
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1
    assert [r["size"] for r in rows if r.doc_id == 3] == [8]
    assert sharding.shard(none).count() == 0


def test_sharding_of_a_group_larger_than_a_shard(spark):
    df = spark.createDataFrame([(i, "same" if i < 400 else f"text {i}") for i in range(1000)], "doc_id long, text string")
    rows = sharding.shard(df, 10).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(10)]
    assert sizes == [100] * 10
    assert len({r.shard for r in rows if r.doc_id < 400}) <= 6


def test_sharding_of_a_table_of_pairs(spark):
    df = spark.range(4800).selectExpr("id as doc_id", "concat('text ', (id * 7919 % 4800) div 2) as text")
    rows = sharding.shard(df, 24).collect()
    assert [sum(r.shard == s for r in rows) for s in range(24)] == [200] * 24
    shards = {}
    for r in rows:
        shards.setdefault(r.doc_id * 7919 % 4800 // 2, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 24


@pytest.mark.parametrize("size, most", [(5, 24), (3, 24), (50, 24)])
def test_sharding_keeps_groups_together(spark, size, most):
    df = spark.range(2400).selectExpr("id as doc_id", f"concat('text ', (id * 7919 % 2400) div {size}) as text")
    rows = sharding.shard(df, 24).collect()
    assert [sum(r.shard == s for r in rows) for s in range(24)] == [100] * 24
    shards = {}
    for r in rows:
        shards.setdefault(r.doc_id * 7919 % 2400 // size, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= min(most, 0.05 * 2400 / size + 1)


def test_start_cuts_at_the_borders():
    assert sharding.borders([3, 3, 2], 8) == [3, 6, 8] and sharding.borders([10, 10, 10], 7) == [2, 4, 7]
    for linked in range(0, 101):
        quota = [13] * 4 + [12] * 4
        ends = [0, *sharding.borders(quota, linked)]
        assert ends[-1] == linked and all(b - a <= q for a, b, q in zip(ends, ends[1:], quota))


def test_exchange_keeps_room():
    want = {(0, 1): 5, (1, 0): 3, (1, 2): 4, (2, 0): 1, (0, 2): 2}
    moves = sharding.exchange(want, [0, 0, 1])
    assert all(0 <= moves[k] <= want[k] for k in want)
    net = [sum(n * ((b == s) - (a == s)) for (a, b), n in moves.items()) for s in range(3)]
    assert net[0] <= 0 and net[1] <= 0 and net[2] <= 1 and sum(moves.values()) >= 9


def test_propagation_follows_links(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "id long, shard int")
    links = spark.createDataFrame([(i, i // 4) for i in range(40)], "id long, hub long")
    rows = sharding.propagate(labels, links, [24, 24]).collect()
    hubs = {}
    for r in rows:
        hubs.setdefault(r.id // 4, set()).add(r.shard)
    assert sum(len(s) > 1 for s in hubs.values()) <= 2
    assert all(sum(r.shard == s for r in rows) <= 27 for s in (0, 1))


def test_toxicity(spark, docs, none):
    nothing = labels_of(spark, [])
    assert all(r.score < 1e-6 for r in toxicity.scores(docs, nothing).collect())
    assert toxicity.scores(docs, nothing).where("predicted = 1").count() == 0
    assert toxicity.scores(none, nothing).count() == 0
    some = labels_of(spark, [(1, 1, 1), (1, 1, 0), (3, None, None), (5, 1, 0), (99, 0, 1), (None, 1, 1)])
    rows = toxicity.scores(docs, some).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    assert toxicity.drop_toxic(docs, nothing).columns == docs.columns


def insulting(spark):
    """200 documents, an insult in every fourth, then 300 whose words share nothing with it: more than a batch of texts."""
    rows = [(i, f"some plain words here {'grumphole' if i % 4 == 0 else 'garden'} and more.") for i in range(200)]
    rows += [(i, f"q{i} zq{i}z") for i in range(200, 500)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_toxicity_of_strings_that_share_nothing_with_a_landmark():
    marks = toxicity.Landmarks([f"{toxicity.EDGE}grumphole{toxicity.EDGE}"])
    for least in (0.0, toxicity.FAINT):
        assert marks.similarity([f"{toxicity.EDGE}zzz{toxicity.EDGE}"], least).tolist() == [[0.0]]


def test_toxic_documents_dropped_beside_texts_that_share_nothing(spark):
    kept = {r.doc_id for r in toxicity.drop_toxic(
        insulting(spark), labels_of(spark, [(i, 1, int(i % 4 == 0)) for i in range(200)])).collect()}
    assert kept == {i for i in range(500) if i >= 200 or i % 4}


def test_toxicity_fitted_beside_texts_that_share_nothing(spark):
    labels = labels_of(spark, [(i, 1, int(i < 200 and i % 4 == 0)) for i in range(500)])
    rows = toxicity.scores(insulting(spark), labels).collect()
    assert len(rows) == 500 and {r.doc_id for r in rows if r.predicted} == {i for i in range(0, 200, 4)}


def test_quality(spark, docs, none):
    assert quality.scores(none, labels_of(spark, [])).count() == 0
    assert quality.scores(docs, labels_of(spark, [])).where("predicted = 1").count() == 0
    one = labels_of(spark, [(1, 1, 0), (6, 0, 0), (6, 0, 0), (3, None, 1)])
    rows = quality.scores(docs, one).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)


def test_substrings(spark, none):
    shared = " ".join(f"s{i}" for i in range(60))
    df = spark.createDataFrame(
        [(3, "head " + shared + " tail", 1), (8, "other start " + shared, 1), (8, "other start " + shared, 1),
         (9, shared.replace("s30", "x"), 1), (1, None, 1), (2, "", 1), (None, shared, 1), (4, "few words", 1)],
        "doc_id long, text string, windows int")
    rows = {r.doc_id: r for r in substrings.deduplicate(df, with_text=True).collect()}
    assert rows[3].n_removed == 0 and rows[8].n_removed == 60 and rows[8].kept_text == "other start"
    assert rows[9].n_removed == 0 and rows[None].n_removed == 60 and rows[1].n_words == 0
    assert rows[4].kept_sha256 == hashlib.sha256(b"few words").hexdigest()
    assert substrings.deduplicate(none).count() == 0


def test_html(spark):
    page = ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav>"
            "<article><h1>A &amp; B</h1><p>First  paragraph,\n with words.<p>Second&nbsp;one.<div class='ad'>Buy this now.</div>"
            "</article><div id=comments><p>I am a reader, and this is what I think of it.</p></div><footer>&copy; x</footer>")
    df = spark.createDataFrame([(1, "u", page, 5), (1, "u", page, 5), (2, None, None, 5), (3, "u", "", 5),
                                (4, "u", "<p>open <a href='x>broken", 5), (None, "u", "Plain words only, no tags.", 5)],
                               "page_id long, url string, html string, n_chars int")
    rows = html_mincut.extract(df).collect()
    assert [r.text for r in rows if r.page_id == 1] == ["A & B\n\nFirst paragraph, with words.\n\nSecond one."] * 2
    assert [(r.text, r.n_chars) for r in rows if r.page_id in (2, 3)] == [("", 0)] * 2
    assert [r.text for r in rows if r.page_id is None] == ["Plain words only, no tags."]
    assert html_mincut.extract(df.limit(0)).count() == 0


def test_html_wrappers_named_after_a_sidebar():
    text = " ".join(["word"] * 39) + " end."
    wrap = '<div class="content-sidebar-wrap">%s<div class="sidebar"><p>' + text + "</p></div></div>"
    for inner in (f'<main class="content"><article><p>{text}</p></article></main>', f"<article><p>{text}</p></article>",
                  f'<div itemprop="articleBody"><p>{text}</p></div>'):
        assert html_mincut.main_text(wrap % inner) == text
    article = f"<article><p>{text}</p>%s</article>"
    assert html_mincut.main_text(article % f'<div class="comments"><article><p>{text} Other.</p></article></div>') == text
    assert html_mincut.main_text(article % f'<div class="social"><p>{text} Other.</p></div>') == text


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "How do I open the file?\n\nIt is large."), (1, 1, "assistant", "> How do I open the FILE?\nUse open()."),
        (1, 2, "user", "Thanks."), (1, 3, "assistant", "Ann wrote:\n> It is large.\n\nThen read it in parts."),
        (1, 4, "user", ">> How do I open the file?\n> Use open().\nThat failed."), (1, 4, "user", "Repeated place."),
        (1, 5, "user", "> never said\nWhat?"), (2, 7, "user", None), (2, 8, "assistant", ""), (None, 1, "user", "alone"),
        (3, None, "user", "> quoted\nno turn"), (3, 1, "user", "> Use open().\nOther conversation.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth_", F.lit(1))
    out = {(r.conv_id, r.turn, r.text): r for r in quotes.format_conversations(df).collect()}
    assert len(out) == len(rows)
    first = out[1, 1, "Use open()."]
    assert (first.reply_to, first.linked, first.depth, first.n_linked) == (0, True, 1, 1)
    third = out[1, 3, "Then read it in parts."]
    assert (third.reply_to, third.linked, third.thread) == (0, True, 0)
    fourth = out[1, 4, "That failed."]
    assert (fourth.reply_to, fourth.n_passages, fourth.n_linked, fourth.depth) == (1, 2, 2, 2)
    assert out[1, 4, "Repeated place."].n_passages == 0
    fifth = out[1, 5, "What?"]
    assert (fifth.reply_to, fifth.linked, fifth.n_passages, fifth.n_linked) == (4, False, 1, 0)
    assert out[2, 7, ""].reply_to is None and out[2, 8, ""].reply_to == 7
    assert out[None, 1, "alone"].reply_to is None and not out[3, 1, "Other conversation."].linked
    assert quotes.format_conversations(df.limit(0)).count() == 0
    plan = quotes.format_conversations(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_threads(spark):
    df = spark.createDataFrame([(1, i, "user", f"message {i}") for i in range(300)] + [(2, 0, "user", "x")],
                               "conv_id long, turn long, role string, text string")
    rows = {(r.conv_id, r.turn): r for r in quotes.format_conversations(df).collect()}
    assert all(rows[1, i].depth == i and rows[1, i].thread == 0 for i in range(300)) and rows[2, 0].depth == 0
