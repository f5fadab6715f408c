"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.llm import (chosen_path, fill_in_middle, html_mincut, packing, pieces, quality, quotes, recipes, sharding,
                            spelling, substrings, toxicity, winnow)
from territoria.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "row", "root")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(table(spark, sf_dir, "pages"))


def op5_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.format_conversations(table(spark, sf_dir, "conversations"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    text = fill_in_middle.restored(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(text, 256).alias("restored_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), digests=True)


QUERIES: dict[str, Query] = {
    "op1_html_extraction": op1_html_extraction,
    "op9_exact_dedup": op9_exact_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_label_propagation_shards": op5_label_propagation_shards,
    "op6_toxicity": op6_toxicity,
    "op7_quotation_linking": op7_quotation_linking,
    "op8_substring_dedup": op8_substring_dedup,
    "op10_quality": op10_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLE: dict[str, str] = {
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
        FROM t JOIN g USING (body)""",
    "op2_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
                      array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
        hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit
                 FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM m) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op11_fill_in_middle": r"""
        WITH h AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                       sha256('1:' || doc_id) AS d FROM documents),
        k AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
                     ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM h),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
                          THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
        p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
                     array_to_string(u[b + 1:n], '') AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
    "op12_spelling_variants": r"""
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END,
                                    i) ORDER BY i) AS bits
            FROM (SELECT unnest(range(256)) AS i)),
        runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
                 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
                 WHERE length(run) >= 7 GROUP BY ALL),
        hashed AS (SELECT run, n, xor(4294967295, list_reduce(
                       list_transform(range(0, octet_length(encode(doc_id || ':' || run))::BIGINT),
                                      lambda i: ('0x' || hex(encode(doc_id || ':' || run))[2 * i + 1 : 2 * i + 2])::BIGINT),
                       lambda c, x: xor(c // 256, bits[xor(c % 256, x) + 1]), 4294967295::BIGINT)) AS h
                   FROM runs, crc),
        done AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT)
                             ELSE run END AS word, n FROM hashed),
        w AS (SELECT word, sum(n)::BIGINT AS n FROM done WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
                 FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
        near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i
                     WHERE a.word <> b.word
                 UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN w b ON a.rest = b.word
                 UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN w b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, max(m) AS m, min(other) FILTER (m = top) AS other
                 FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form,
                     CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
        chain AS (SELECT word, word AS here, 0 AS step FROM f
                  UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.here WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
        FROM f JOIN (SELECT word, arg_max(here, step) AS root FROM chain GROUP BY word) r USING (word)""",
}
