"""Packing, whitening and spelling variants against brute force, exact round trips and odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankweave.llm import packing, queries, variants, whiten

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = packing.Encoder(open(PATH, "rb").read())
DOCS = "doc_id long, text string, length string, sequence_id string, _rank string, ids string"


# --- 11: packing


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abZ09'’ \t\n\r\x0b\x85\xa0 é", "İ", "ſ", "'s", "'LL", "Σας", "é", "日本", "½", "<|endoftext|>", "<|", "word ", "ŉ", "ß", "\u0000", "😀", "n't "]), max_size=30).map("".join))
def test_ids_equal_the_library(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x17F), max_size=40))
def test_ids_of_plain_texts_equal_the_library(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(text)


def test_a_long_text_is_tokenised_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "PART", 20)
    for text in ["the  quick brown fox's  jumps over " * 9, "日本 é ́ word " * 9, "x" * 500]:
        assert len(ENCODER.parts(text)) > 1 or " " not in text
        assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(text)


def check_plan(histogram, capacity):
    """The number of sequences of a plan whose every item has its own place."""
    made = packing.plan(histogram, capacity)
    lengths = np.repeat(sorted(histogram), [histogram[s] for s in sorted(histogram)])
    ranks = np.concatenate([np.arange(histogram[s]) for s in sorted(histogram)]) if histogram else np.zeros(0, int)
    sequence, offset = made.place(lengths, ranks) if len(lengths) else (ranks, ranks)
    ends = {}
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True)):
        assert o == ends.get(s, 0)  # gapless from 0
        ends[s] = o + n
    assert len(ends) == made.sequences and max(ends.values(), default=0) <= capacity
    return made.sequences


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for s in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - s)
    return len(rooms)


def fewest(lengths, capacity):
    """The least number of sequences, by trying all."""

    def fits(left, rooms):
        if not left:
            return True
        for k in {r: i for i, r in enumerate(rooms) if r >= left[0]}.values():
            if fits(left[1:], [*rooms[:k], rooms[k] - left[0], *rooms[k + 1 :]]):
                return True
        return False

    n = -(-sum(lengths) // capacity)
    while not fits(sorted(lengths, reverse=True), [capacity] * n):
        n += 1
    return n


@pytest.mark.parametrize("seed", range(8))
def test_plans_are_valid_and_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    draw = [lambda: rng.randint(1, 100), lambda: rng.randint(20, 60), lambda: rng.choice([34, 33, 51, 26, 24]), lambda: min(100, int(rng.lognormvariate(2, 1)) + 1)][seed % 4]
    lengths = [draw() for _ in range(rng.choice([1, 40, 600]))]
    made = check_plan(Counter(lengths), 100)
    assert -(-sum(lengths) // 100) <= made <= best_fit_decreasing(lengths, 100)


def test_small_plans_are_optimal_or_one_above():
    rng, above = random.Random(3), 0
    for _ in range(40):
        lengths = [rng.randint(8, 70) for _ in range(9)]
        more = check_plan(Counter(lengths), 100) - fewest(lengths, 100)
        assert more in (0, 1)
        above += more
    assert above <= 4


def test_configurations_beat_best_fit():
    """Lengths of which only mixed sequences are full: best fit pairs the longest and wastes room."""
    lengths = [44] * 60 + [28] * 120 + [36] * 90 + [64] * 90
    assert check_plan(Counter(lengths), 100) == -(-sum(lengths) // 100) < best_fit_decreasing([x - x % 2 for x in lengths], 100) + 1
    assert check_plan({}, 100) == 0
    assert check_plan({100: 3, 1: 2}, 100) == 4


def test_packed_documents(spark):
    rng = random.Random(5)
    words = "the of and thing ation eron lyst hathe inor under".split()
    texts = [None, "", "   ", "<|endoftext|>", "dup text", "dup text", "x" * 9000, "Ünï 日本 é"] + [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60, 63, 64, 200]))) for _ in range(150)]
    rows = [(None if i == 4 else i, t, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    packed = packing.pack(docs, PATH, capacity=64)
    got = sorted(packed.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["piece"]))
    want = []
    for i, t in sorted(enumerate(texts), key=lambda x: (x[0] == 4, x[0])):
        ids = [*ids_of(t or ""), 1]
        want += [(None if i == 4 else i, k // 64, k, ids[k : k + 64]) for k in range(0, len(ids), 64)]
    assert [(r["doc_id"], r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got] == want
    assert all(r["length"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in got)
    made = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["ids"]))
    for s, parts in by.items():
        parts.sort()
        assert bytes(made[s]["ids"]) == b"".join(x for _, x in parts) and len(made[s]["ids"]) <= 256
        assert made[s]["starts"] == [o for o, _ in parts] == np.cumsum([0] + [len(x) // 4 for _, x in parts])[:-1].tolist()
    assert len(made) == len(by) <= best_fit_decreasing([r["length"] for r in got], 64)
    assert packing.pack(docs.limit(0), PATH).count() == 0
    assert "ids" not in packing.pack(docs.limit(3), PATH, keep_ids=False).columns


def test_packing_query_fills_its_sequences(spark, sf_dir):
    rows = queries.QUERIES["op11_best_fit_packing"](spark, sf_dir).collect()
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 4096) + 1


# --- 12: whitening


def reference(x, components):
    """(deviations, whitened up to signs, shares) of integer rows by eigenvectors of the covariance."""
    n, sums = len(x), [int(v) for v in x.sum(0)]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    centred = x - np.array([s // n for s in sums]) - np.array([s % n for s in sums]) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return deviation, centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], "vec_id long, embedding array<float>, n string, x string").repartition(7)


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(1)
    data = (rng.normal(size=(400, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2]) + 3).astype(np.float32)
    data[10] = data[11]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (905, [1.0, 2.0])]
    frame = vectors_frame(spark, [(None if i == 7 else i, v.tolist()) for i, v in enumerate(data)] + odd)
    rows, model = whiten.whiten(frame, components=4)
    got = {r["vec_id"]: r for r in rows.collect()}
    assert set(got) == {None if i == 7 else i for i in range(400)}
    deviation, want, shares = reference(np.floor(data.astype(float) * 64).astype(np.int64) + 1_000_000, 4)
    made = np.array([got[None if i == 7 else i]["whitened"] for i in range(400)])
    signs = np.sign((made * want).sum(0))
    assert np.abs(made * signs - want).max() < 1e-9
    assert [got[None if i == 7 else i]["deviation"] for i in range(400)] == deviation
    one = got[0]
    assert one["n"] == 400 and one["identity_error"] < 1e-10 and np.allclose(one["explained"], shares, rtol=1e-12)
    assert len(model.node.rows) == 6  # no dimension is lost in the merges


def test_merging_loses_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (1000, 5)) + 10**9
    whole = whiten.node_of(x)
    for cuts in ([1, 2, 3], [500], [3, 10, 990], list(range(100, 1000, 100))):
        node = None
        for part in np.split(x, cuts):
            one = whiten.node_of(part)
            node = one if node is None else whiten.merged(node, one)
        assert node.n == 1000 and (node.sums == whole.sums).all()
        assert np.abs(node.covariance() - np.cov(x.T - 10**9, bias=True)).max() < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whiten.whiten(vectors_frame(spark, []))[0].count() == 0
    assert whiten.whiten(vectors_frame(spark, [(1, None), (2, [])]))[0].count() == 0
    same = whiten.whiten(vectors_frame(spark, [(i, [1.0, 2.0]) for i in range(5)]))[0].collect()  # no variance: nothing to whiten
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in same] == [(5, 0, [], 0.0)] * 5
    line = whiten.whiten(vectors_frame(spark, [(i, [float(i), 2.0 * i]) for i in range(9)]))[0].first()
    assert len(line["whitened"]) == 1 and abs(line["explained"][0] - 1) < 1e-12
    huge = whiten.whiten(vectors_frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.5])]))[0].collect()
    assert {r["vec_id"]: r["deviation"] is None for r in huge} == {1: True, 2: True, 3: False}


def test_whitening_of_the_test_table(spark, sf_dir):
    rows = queries.QUERIES["op12_whitening"](spark, sf_dir).collect()
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, want, shares = reference(np.floor(np.array([r["embedding"] for r in data], float) * 64).astype(np.int64) + 1_000_000, 32)
    at = {r["vec_id"]: i for i, r in enumerate(data)}
    made = np.zeros_like(want)
    for r in rows:
        made[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[at[r["vec_id"]]] and abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-9
    signs = np.sign((made * want).sum(0))
    assert len(rows) == want.size and np.abs(made * signs - want).max() < 1e-7


# --- 13: spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words, ratio):
    """word: (n, n_near, form, form_n, root), by comparing all pairs."""
    out = {}
    for w, n in words.items():
        close = [(v, m) for v, m in words.items() if near(w, v)]
        best = min(close, key=lambda x: (-x[1], x[0]), default=(None, 0))
        out[w] = [n, len(close), *(best if best[1] >= ratio * n else (None, None)), w]
    for w in out:
        at = w
        while out[at][2]:
            at = out[at][2]
        out[w][4] = at
    return {w: tuple(v) for w, v in out.items()}


@pytest.mark.parametrize("slice_words", [1 << 24, 40])
def test_variants_equal_all_pairs(spark, slice_words):
    rng, words = random.Random(7), {}
    for _ in range(60):
        w = "".join(rng.choice("aab" if rng.random() < 0.5 else "abcé😀Ÿ") for _ in range(rng.randint(1, 7)))
        for _ in range(6):
            words[w] = words.get(w, 0) + rng.choice([1, 2, 30, 400, 5000])
            i, c = rng.randrange(len(w) + 1), rng.choice("abcé😀")
            w = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]) or "a"
    rows = spark.createDataFrame([(w, n, "clash") for w, n in words.items()] + [(None, 4, "clash"), ("", 5, "clash")], "word string, n long, form string").repartition(4)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants.group(rows, 10, slice_words).collect()}
    assert got == grouped(words, 10)
    assert any(v[4] not in (w, v[2]) for w, v in got.items())  # chains of forms


def test_variants_of_odd_texts(spark):
    texts = [None, "", "123 !", "Wonderful wonderful WONDERFUL, wonderful! wonderfulx x" + " wonderful" * 17, "wonderfu1 wonderfull wonderfull éàÿ×÷ short short " + "y" * 30_000, "y" * 30_000]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, word string, id string")
    runs = Counter(r["word"] for r in variants.runs(docs).collect())
    assert runs["wonderful"] == 21 and runs["wonderfull"] == 2 and runs["éàÿ×÷"] == 1 and runs["x"] == 1 and runs["wonderfu"] == 1
    words = variants.vocabulary(variants.runs(docs, least=7), 7, 2)
    got = {r["word"]: (r["n"], r["form"], r["root"]) for r in variants.group(words).collect()}
    assert got == {"wonderful": (21, None, "wonderful"), "wonderfull": (2, "wonderful", "wonderful"), "y" * 30_000: (2, None, "y" * 30_000)}
    assert variants.group(words.limit(0)).count() == 0


# --- earlier operators: columns of the input that are named like an output


def test_outputs_replace_columns_of_their_names(spark):
    from rankweave.llm import bpe, langid, licenses

    texts = [None, "", "The MIT License (MIT). Released under the MIT License.", "the word and another word of the text " * 30]
    docs = spark.createDataFrame([(i, t, "en", *["clash"] * 6) for i, t in enumerate(texts)], "doc_id long, text string, lang string, ids string, n_tokens string, decoded string, licenses string, lang_pred string, lang_score string").repartition(2)
    coded = {r["doc_id"]: r for r in bpe.encode_decode(docs, queries.TOKENIZER).collect()}
    assert all(coded[i]["decoded"] == (t or "") and coded[i]["n_tokens"] == len(coded[i]["ids"]) // 4 for i, t in enumerate(texts))
    scanned = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()}
    assert scanned[0] == scanned[1] == scanned[3] == []
    found = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert [found[i][0] for i in range(4)] == ["und", "und", "en", "en"] and all(isinstance(s, float) for _, s in found.values())
