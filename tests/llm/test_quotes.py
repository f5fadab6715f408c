"""Quotation linking: partial and re-wrapped quotations, gaps, repeated rows, clashing names, long texts, brute force."""

import random
import re
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from territoria.llm import quotes


def formatted(spark, rows, more=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string" + more)
    return quotes.format_conversations(df)


def by_turn(df):
    return {(r.conv_id, r.turn): r for r in df.collect()}


def test_one_sentence_of_a_line_is_linked(spark):
    rows = [(1, 0, "u", "First point here. The second one is longer! Third?"), (1, 1, "a", "Something else."), (1, 2, "u", "Noise."),
            (1, 3, "a", "> The second one is longer!\nI agree.")]
    got = by_turn(formatted(spark, rows))
    assert (got[1, 3].reply_to, got[1, 3].linked, got[1, 3].n_linked, got[1, 3].text) == (0, True, 1, "I agree.")
    assert [got[1, t].reply_to for t in range(3)] == [None, 0, 1]


def test_a_rewrapped_part_of_a_paragraph_is_linked(spark):
    words = "one small piece of a very long paragraph that goes on without any full stop for quite a while and then some more"
    quoted = "\n".join("> " + x for x in textwrap.wrap(" ".join(words.split()[4:17]), 21))
    rows = [(1, 0, "u", "\n".join(textwrap.wrap(words, 33))), (1, 1, "a", "unrelated words only"), (1, 2, "u", quoted + "\nWhy?")]
    got = by_turn(formatted(spark, rows))
    assert (got[1, 2].reply_to, got[1, 2].linked, got[1, 2].text) == (0, True, "Why?")


def test_gaps_in_turns_stay_one_thread(spark):
    got = by_turn(formatted(spark, [(1, 0, "u", "a"), (1, 2, "a", "b"), (1, 5, "u", "c"), (2, 3, "u", "d")]))
    assert [got[1, t].reply_to for t in (0, 2, 5)] == [None, 0, 2] and {got[1, t].thread for t in (0, 2, 5)} == {0}
    assert [got[1, t].position for t in (0, 2, 5)] == [1, 2, 3] and [got[1, t].depth for t in (0, 2, 5)] == [0, 1, 2]
    assert (got[2, 3].thread, got[2, 3].position) == (3, 1)


def test_repeated_rows_keep_their_link(spark):
    original = "First line of it\nsecond line of it"
    quoted = "> First line of it second\n> line of it\nyes"
    rows = [(1, 0, "u", original), (1, 1, "a", "between"), (1, 2, "u", quoted), (1, 2, "u", quoted)]
    out = [r for r in formatted(spark, rows).collect() if r.turn == 2]
    assert len(out) == 2 and all((r.reply_to, r.n_passages, r.n_linked) == (0, 1, 1) for r in out)
    assert [r.position for r in out] == [3, 3]  # one place
    assert len({r.thread for r in out}) == 1


def test_clashing_columns(spark):
    more = ", depth string, reply_to string, thread string, linked string, row string, position string, unit string, key string"
    rows = [(1, 0, "u", "A thing said here.") + ("x",) * 8, (1, 1, "a", "no") + ("y",) * 8, (1, 2, "u", "> A thing said here.\nok") + ("z",) * 8]
    out = formatted(spark, rows, more)
    got = by_turn(out)
    assert got[1, 2].reply_to == 0 and got[1, 2].depth == 1 and got[1, 2].position == 3
    assert (got[1, 2]["row"], got[1, 2].unit, got[1, 2].key) == ("z", "z", "z")
    assert len(out.columns) == len(set(out.columns)) == 4 + 3 + len(quotes.RESULT)


def test_undefined_places_and_ties(spark):
    rows = [(None, 1, "u", "> x\ny"), (1, None, "u", None), (1, 0, "u", "Same words in both."), (1, 1, "a", "Same words in both."),
            (1, 2, "u", "> Same words in both.\nwhich?"), (1, 3, "a", ""), (1, 4, "u", "> said nowhere at all\nhm")]
    out = formatted(spark, rows)
    got = by_turn(out)
    assert got[1, 2].reply_to == 1  # of equal ones the latest
    assert (got[1, 4].reply_to, got[1, 4].linked, got[1, 4].n_passages, got[1, 4].n_linked) == (3, False, 1, 0)
    assert got[None, 1].position is None and got[None, 1].text == "y" and got[1, None].text == "" and got[1, None].reply_to is None
    assert formatted(spark, rows).limit(0).count() == 0


def test_long_texts_take_linear_time(spark):
    took = []
    for n in (10_000, 40_000):
        text = "\n".join(["On Monday Ann wrote:", "> " + "q" * 20] * (n // 4) + ["plain words here"] * (n // 2))
        df = spark.createDataFrame([(1, 0, "u", text)], "conv_id long, turn long, role string, text string")
        t = time.time()
        assert df.select(F.length(quotes.own_text(F.col("text"))).alias("n")).first()[0] == n // 2 * 17 - 1
        took.append(time.time() - t)
    assert took[1] < 8 * took[0] + 2
    line = "w " * 300_000
    assert formatted(spark, [(1, 0, "u", line), (1, 1, "a", "> w w w\n" + line)]).count() == 2


def test_random_threads_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 7))) for _ in range(4000)]
    rows, want = [], {}
    for conv in range(30):
        said, turns = {}, sorted(r.sample(range(40), 12))
        for k, turn in enumerate(turns):
            body = " ".join(r.choice(vocabulary) for _ in range(r.randint(12, 40))) + "."
            target = r.choice(turns[:k]) if k and r.random() < 0.6 else None
            text = body
            if target is not None:
                words = said[target].split()
                n = r.randint(8, min(len(words), 20))
                at = r.randint(0, len(words) - n)
                text = "\n".join("> " + x for x in textwrap.wrap(" ".join(words[at: at + n]), r.choice([15, 30, 200]))) + "\n" + body
            said[turn] = body
            rows.append((conv, turn, "u", text))
            want[conv, turn] = (target if target is not None else (turns[k - 1] if k else None), target is not None)
    got = by_turn(formatted(spark, rows))
    assert {k: (v.reply_to, v.linked) for k, v in got.items()} == want
    # threads, depths and positions follow from the replies
    for (conv, turn), v in got.items():
        depth, at = 0, turn
        while want[conv, at][0] is not None:
            at, depth = want[conv, at][0], depth + 1
        assert (v.thread, v.depth) == (at, depth)
        assert v.position == 1 + sum(1 for (c, t), w in got.items() if c == conv and w.thread == v.thread and t < turn)


def test_one_hot_unit_makes_no_pairs(spark):
    """A sentence in very many messages of one conversation, quoted as often."""
    n = 3000
    df = spark.range(n).selectExpr("1L as conv_id", "id as turn", "'u' as role", "if(id % 2 = 0, 'The very same words.', '> The very same words.\n') as text")
    out = quotes.format_conversations(df)
    assert out.where("turn % 2 = 1 and reply_to = turn - 1 and linked").count() == n // 2
    assert out.agg(F.max("position")).first()[0] == n


def test_reply_order(spark):
    rows = [(c, t, "u", f"message {t}") for c in (2, 1) for t in (4, 0, 9)]
    out = quotes.in_reply_order(formatted(spark, rows)).collect()
    assert [(r.conv_id, r.turn, r.position) for r in out] == [(c, t, i + 1) for c in (1, 2) for i, t in enumerate((0, 4, 9))]


def test_own_text_keeps_other_lines():
    assert re.fullmatch(quotes.ATTRIBUTION, "wrote on Monday:")
