"""The registered queries against brute force on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from territoria.llm import chosen_path, html_mincut, packing, substrings, toxicity
from territoria.llm.common import table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def run(spark, name):
    return entry.queries()[name](spark, SF)


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "packing"]


def test_op1_keeps_the_article_alone(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    rows = run(spark, "op1_html_extraction").collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id] or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", article[1]) if article else []
        clean = [" ".join(html_mincut.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        assert r.text.split() == "\n\n".join(b for b in clean if b).split() and r.n_chars == len(r.text)


def test_op3_links_and_classes(spark, texts):
    sets = {}
    for i, text in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        sets[i] = {tuple(w[j: j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links, root = Counter(), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1:]:
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    for r in run(spark, "op3_jaccard_join").collect():
        assert (r.n_links, r.class_id) == (links[r.doc_id], find(r.doc_id))


def test_chosen_path_reaches_its_recall():
    assert 1 - (1 - 0.8 ** chosen_path.DEPTH) ** chosen_path.RUNS >= chosen_path.RECALL
    assert all(len(set(path)) == chosen_path.DEPTH for path in chosen_path.PATHS)


def test_drawn_paths_reach_their_recall():
    rng, missed = np.random.default_rng(1), 0
    for _ in range(10):
        agree = rng.random((100_000, chosen_path.COORDS), dtype=np.float32) < 0.8
        missed += int((~agree[:, chosen_path.PATHS].all(axis=2).any(axis=1)).sum())
    assert missed < 40  # of a million; 9.2 expected


def test_blocks_of_many_near_copies(spark, monkeypatch):
    """More near copies than a leaf and a block hold: no link is lost or counted twice."""
    monkeypatch.setattr(chosen_path, "LEAF", 4)
    monkeypatch.setattr(chosen_path, "BLOCK", 8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1:])) for i in range(5, 45)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = chosen_path.near_duplicates(df).collect()
    sets = {i: {tuple(t.split()[j: j + 5]) for j in range(116)} for i, t in rows}
    for r in out:
        want = sum(1 for j in sets if j != r.doc_id and len(sets[j] & sets[r.doc_id]) >= 0.8 * len(sets[j] | sets[r.doc_id]))
        assert r.n_links == want > 20 and r.class_id == 5


def test_op4_round_trip(spark, texts):
    tokenizer = packing.encoder(packing.default_tokenizer()).whole
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    rows = run(spark, "op4_best_fit_packing").collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start: r.start + r.length], dtype="<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, parts in by_doc.items():
        assert [p for p, _, _ in sorted(parts)] == list(range(-(-len(ids[i]) // 4096)))
        assert sum(n for _, _, n in parts) == len(ids[i])
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by_sequence) <= -(-sum(map(len, ids.values())) // 4096) + 2


def test_op4_ids_of_odd_texts():
    encode = packing.ChunkIds(packing.default_tokenizer())
    for text in ["don't <|endoftext|> x", "İstanbul ΑΣ Å é ﬁ ½ ² foo…!! 漢字かな nb it's 12ab3", "ŉ ſ ß ẞ ÿ Ÿ ×÷ a×b ‘q’ _x_",
                 "\x1c\x1d a\x85b 한글 🙂🙂hello🙂", "étude café"]:
        want = encode.whole.encode(text, add_special_tokens=False).ids
        assert encode.text(text).tolist() == want
        encode.known = False  # a tokenizer of another rule
        assert encode.text(text).tolist() == want
        encode.known = True


def test_op5_counts_and_groups(spark, texts):
    rows = run(spark, "op5_label_propagation_shards").collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    groups = defaultdict(set)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        groups[raw].add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 1


def test_op8_windows(spark, texts):
    first, windows = {}, {}
    for i, text in texts.items():
        w = text.encode().split()
        windows[i] = w, [tuple(w[j: j + 50]) for j in range(len(w) - 49)]
        for k in windows[i][1]:
            first[k] = min(first.get(k, i), i)
    for r in run(spark, "op8_substring_dedup").collect():
        w, own = windows[r.doc_id]
        gone = {j + n for j, k in enumerate(own) if first[k] < r.doc_id for n in range(50)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_op8_large_shards_agree(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    small = sorted(map(tuple, substrings.deduplicate(docs).collect()))
    monkeypatch.setattr(substrings, "SHARD", 1)
    assert sorted(map(tuple, substrings.deduplicate(docs).collect())) == small


def test_automaton_matching_statistics():
    rnd = random.Random(3)
    for _ in range(300):
        texts = [[rnd.choice("abc").encode() for _ in range(rnd.randint(0, 14))] for _ in range(3)]
        automaton = substrings.Automaton()
        for t in texts:
            automaton.add(t)
        known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        query = [rnd.choice("abc").encode() for _ in range(12)]
        want = [max([k for k in range(1, i + 2) if tuple(query[i + 1 - k: i + 1]) in known] or [0]) for i in range(12)]
        assert automaton.statistics(query) == want


def test_op6_tolerates_inserted_characters(spark):
    rnd = random.Random(2)
    plain = ["".join(rnd.choice(["ba", "lo", "ri", "te", "nu", "so"]) for _ in range(rnd.randint(1, 3))) for _ in range(300)]
    insults = ["grumphole", "snackwit", "dredgeface"]

    def text(*more):
        words = [rnd.choice(plain) for _ in range(60)] + list(more)
        rnd.shuffle(words)
        return " ".join(words) + "."

    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, text(*rnd.sample(insults, rnd.randint(1, 2))) if toxic else text()))
        if zlib.crc32(str(i).encode()) % 3 != 1:
            labels.append((i, 1, int(toxic)))
    odd = {1001: "g.r.u.m.p.h.o.l.e", 1002: "snaackwit", 1003: "dred-geface", 1004: "s n a c k w i t", 1005: "GRUMPHOLE!"}
    rows += [(i, text(x)) for i, x in odd.items()] + [(2000 + i, text()) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.scores(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(out[i].predicted == int(i % 4 == 0) for i in range(400))
    assert {odd[i]: round(out[i].score, 2) for i in odd if not out[i].predicted} == {}
    assert not any(out[2000 + i].predicted for i in range(50))


def test_op10_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = entry.queries()["op10_quality"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)


def test_pipeline_stages(spark, texts):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 50, name
        docs = docs.where(docs.doc_id.isin(sorted(ids)))
    whole = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in whole} == ids and all(r.length <= 4096 for r in whole)
