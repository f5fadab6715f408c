"""Fill-in-the-middle, spelling variants and piece encoding: brute force, defined cases, parts."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from territoria.llm import fill_in_middle as fim
from territoria.llm import pieces, spelling
from territoria.llm.common import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, n long, word string, ids string, form string, cell long, best string"
LONG = " ".join(f"word{i}x 語 é" for i in range(60_000))
ROWS = [(1, "One two, three."), (2, "A marker <S> stays plain"), (2, "A marker <S> stays plain"), (3, None), (4, ""),
        (None, "no id at all"), (5, LONG), (6, "\t\n  "), (7, "語語語é🙂 x"), (8, "1234567890" * 20_000), (9, "z" * 100_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "w", "i", "f", 1, "b") for i, t in ROWS], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rearranged(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    d = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(d[8 * i: 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_brute_force(spark, docs, none):
    for df in (docs, table(spark, SF, "documents")):
        out = fim.transform(df)
        got = Counter(map(tuple, out.collect()))
        want = Counter((r.doc_id, *rearranged(r.doc_id, r.text or "")) for r in df.select("doc_id", "text").collect())
        assert got == want
        back = Counter((r.doc_id, r.t) for r in out.select("doc_id", fim.restored(F.col("form"), F.col("output")).alias("t")).collect())
        assert back == Counter((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fim.transform(none).count() == 0


@pytest.mark.parametrize("kind", ["sparse", "dense", "runs", "mixed", "edges"])
def test_boundary_set_selects_every_member(kind):
    r = np.random.default_rng(5)
    top = 200_000
    values = {"sparse": np.unique(r.integers(0, top, 900)), "dense": np.unique(r.integers(0, top, 150_000)),
              "runs": np.setdiff1d(np.arange(top), np.arange(70_000, 70_020)),
              "mixed": np.concatenate([np.arange(500), np.unique(r.integers(65_536, 131_072, 40_000)), [190_000]]),
              "edges": np.array([0, 65_535, 65_536, 131_071, 131_072])}[kind]
    bounds = fim.BoundarySet(values)
    kinds = {type(c) for c in bounds.chunks}
    assert kinds >= {"sparse": {fim.ArrayChunk}, "dense": {fim.BitmapChunk}, "runs": {fim.RunChunk},
                     "mixed": {fim.ArrayChunk, fim.BitmapChunk, fim.RunChunk}, "edges": {fim.ArrayChunk}}[kind]
    step = max(1, len(values) // 3000)
    for k in [*range(0, len(values), step), len(values) - 1]:
        assert bounds.select(k) == values[k]


def test_pieces_equal_the_library(spark, docs, none):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.default_model())
    odd = ["", " ", "  ", "a ", " a", "a  b ", "▁a", "a▁ b▁", "\n", " \n ", "<s> x </s> <unk> <0x41>", "a\0b", "ﬁ é", "� ",
           "日本語 🤣🤣 ", "\r\n\tx", "a\xa0b　c", "▁", "▁▁ ▁"]
    r = random.Random(3)
    odd += ["".join(r.choice("ab ▁é語🙂\n<0x4") for _ in range(r.randint(1, 60))) for _ in range(500)]
    odd_df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for df in (odd_df, docs, table(spark, SF, "documents")):
        rows = df.select("doc_id", "text").collect()
        want = Counter()
        for i, text in rows:
            ids = library.encode(text or "", add_bos=True, add_eos=True)
            want[i, len(ids), sha(array("I", ids).tobytes()), sha(library.decode(ids))] += 1
        assert Counter(map(tuple, pieces.encode(df, digests=True).collect())) == want
    full = pieces.encode(odd_df)
    assert {r.doc_id: r.decoded for r in full.collect()} == {r.doc_id: r.text for r in pieces.decode(full).collect()}
    assert pieces.encode(none).count() == 0 and pieces.encode(none, digests=True).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text is None


def test_marked_words_forget_and_know_their_model(monkeypatch):
    words = pieces.MarkedWords(pieces.default_model())
    assert words.independent
    monkeypatch.setattr(pieces, "MEMO", 3)
    text = "one two three four one five six " * 3
    assert words.encode(text).tolist() == words.library.encode(text, add_bos=True, add_eos=True) and len(words) <= 3
    words.independent = False  # a model whose words are not independent
    assert words.encode(text).tolist() == words.library.encode(text, add_bos=True, add_eos=True)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(counts):
    words = sorted(counts)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and apart_by_one(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def crafted():
    """Chains of forms, ties, accents, anagrams and words of one letter pair."""
    r = random.Random(11)
    rows, base = [], ["abcdefgh", "Éclairé", "münchen×", "zzzzzzzz", "aabbaabbaabb", "straßenbahn"]
    for w in base:
        rows += [(len(rows), f"{w} ") for _ in range(3)] + [(len(rows), f"{w} " * 300)]
        for _ in range(40):
            k = r.randrange(len(w))
            v = r.choice([w[:k] + w[k + 1:], w[:k] + r.choice("abyzé") + w[k:], w[:k] + r.choice("abyzé") + w[k + 1:]])
            rows.append((len(rows), f"{v}, {v}. " * r.choice([1, 2, 14])))
            k = r.randrange(len(v))
            rows.append((len(rows), f"{v[:k]}y{v[k:]} " * 2))
    rows += [(len(rows), " ".join("".join(r.choice("ab") for _ in range(r.randint(7, 9))) for _ in range(4000)))]
    return rows + [(None, "Nothing Nothing nothinG"), (1, None), (2, ""), (3, "q" * 50_000 + " " + "q" * 50_000 + " " + "q" * 49_999 + " 1 " + "q" * 49_999)]


def test_spelling_equals_brute_force(spark, none):
    rows = crafted()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n long").repartition(5)
    want = brute(counted(rows))
    assert any(w[1] and w[2] != w[1] for w in want)  # a chain of forms
    assert set(map(tuple, spelling.variants(df).collect())) == want
    assert spelling.variants(none).count() == 0


def test_spelling_with_small_cells_and_crowds(spark, monkeypatch):
    """The same with many cells, salted cells and leaves of equal vectors met through halves."""
    rows = crafted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = counted(rows)
    monkeypatch.setattr(spelling, "CELL", 16)
    assert set(map(tuple, spelling.variants(df).collect())) == brute(counts)
    monkeypatch.setattr(spelling, "LEAF", 2)
    monkeypatch.setattr(spelling, "CROWD", 3)  # tasks of their own do not see this: the search is called here
    by_length = {k: sorted(w for w in counts if len(w) == k) for k in (7, 8, 9)}
    for size, own in by_length.items():
        search = spelling.Search(own)
        for asking in (by_length[k] for k in by_length if abs(k - size) < 2):
            got = sorted((asking[i], own[j]) for a, b in search.near(asking) for i, j in zip(a.tolist(), b.tolist()))
            assert got == sorted((a, b) for a in asking for b in own if apart_by_one(a, b))


def test_sampled_cells_lose_nothing(spark, monkeypatch):
    """Cells fitted on a small sample: lengths outside it keep a cell of their own."""
    rows = crafted()
    monkeypatch.setattr(spelling, "SAMPLE", 30)
    monkeypatch.setattr(spelling, "CELL", 40)
    assert set(map(tuple, spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(counted(rows))


def test_registered_spelling_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = entry.queries()["op12_spelling_variants"](spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert set(map(tuple, got.collect())) == brute(counted(rows))


def test_gapped_words_stay_similar():
    """Two inserted letters, and a letter in every gap; words that share little stay apart."""
    from territoria.llm.toxicity import EDGE, FAINT, Landmarks

    plain = ["snackwit", "idiot", "stupid", "grumphole", "dredgeface"]
    marks = Landmarks([f"{EDGE}{w}{EDGE}" for w in plain])
    for i, own in enumerate([["snackwit", "snaqckwzit", "sxnxaxcxkxwxixt"], ["idxxiot", "ixdxixoxt"], ["stuxxpid", "stuppid"],
                             ["grxumxphxolxe", "grumpphole"], ["dredzzgeface", "dqrwegdsgzefmakcre"]]):
        near = marks.similarity([f"{EDGE}{w}{EDGE}" for w in own], FAINT)
        assert (near[:, i] >= FAINT).all() and (near.argmax(axis=1) == i).all()
    far = marks.similarity([f"{EDGE}{w}{EDGE}" for w in ["window", "garden", "telephone", "surface", "idea", "stunning"]], FAINT)
    assert (far < FAINT).all()


def test_kernel_equals_enumeration():
    from territoria.llm.toxicity import DECAY, ORDER, SPAN, Landmarks

    r = random.Random(4)
    words = ["".join(r.choice("abc") for _ in range(r.randint(3, 9))) for _ in range(30)]

    def vector(w):
        out = Counter()
        for i in range(len(w)):
            for b in range(ORDER - 1, SPAN):
                for a in range(1, b):
                    if i + b < len(w):
                        out[w[i], w[i + a], w[i + b]] += DECAY ** (b + 1)
        return out

    vectors = [vector(w) for w in words]
    norm = [sum(v * v for v in x.values()) ** 0.5 for x in vectors]
    want = [[sum(v * y[k] for k, v in x.items()) / (m * n) for y, n in zip(vectors, norm)] for x, m in zip(vectors, norm)]
    assert np.allclose(Landmarks(words).kernel(), want)
    # plain cosine or the cosine over the shared part, whichever rule gives more
    from territoria.llm.toxicity import GAPPED, OTHERS
    for w, x, m, got in zip(words, vectors, norm, Landmarks(words).similarity(words)):
        for y, n, value in zip(vectors, norm, got):
            dot, shared = sum(v * y[k] for k, v in x.items()), sum(v * v for k, v in x.items() if k in y) ** 0.5
            matched = dot / (n * shared) if shared else 0
            assert np.isclose(value, max(dot / (m * n), OTHERS * matched if matched >= GAPPED else 0))


def test_machine_equals_the_mapped_machine():
    """Training on raw similarities with the map's penalty is training on mapped rows."""
    from territoria.llm import toxicity as tx

    r = np.random.default_rng(1)
    root = r.normal(size=(5, 5))
    kernel = root @ root.T / 5
    x = np.abs(r.normal(size=(60, 5))) * (r.random((60, 5)) < 0.5)
    rows = [(tuple(np.flatnonzero(v).tolist()), tuple(v[v != 0].tolist())) for v in x]
    y = np.where(x[:, 0] + 0.3 * r.normal(size=60) > 0.5, 1.0, -1.0)
    ridge = tx.nystroem_form(kernel)
    w = tx.fit_svm(tx.Sentences(5, rows, np.arange(60), np.arange(60)), (y > 0).astype(float), (y < 0).astype(float), ridge)
    values, vectors = np.linalg.eigh(kernel + 1e-3 * np.eye(5))
    mapped = x @ (vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T)

    def loss(v, bias, z, penalty):
        return penalty + (np.maximum(0, 1 - y * (z @ v + bias)) ** 2).sum()

    best = loss(w[:-1], w[-1], x, w[:-1] @ ridge @ w[:-1])
    u = np.linalg.lstsq(mapped, x @ w[:-1], rcond=None)[0]
    for _ in range(200):  # no nearby point of the mapped problem is better
        d = r.normal(size=6) * 1e-2
        assert best <= loss(u + d[:5], w[-1] + d[5], mapped, (u + d[:5]) @ (u + d[:5])) + 1e-6
