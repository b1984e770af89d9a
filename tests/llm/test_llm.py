"""The ten operators on small inputs against brute force, exact round trips and odd rows."""

import hashlib
import html as entities
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from compare import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankweave.llm import bpe, chat, common, decontaminate, html, langid, licenses, lm, near, queries, toxicity, vectors

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ODD = [None, "", "   ", "!!! ...", "word", "word", "x" * 30_000, "a b c d", "Ünï  códe \t\n words 日本 語 <|endoftext|>"]
DOCS = "doc_id long, text string, lang string, kept string, items string"


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "clash", "clash") for i, t in enumerate(texts)], DOCS).repartition(3)


def invented(rng, n, words="the of and thing ation eron lyst hathe inor under".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "er", "ing", "s"]) for _ in range(n))


def test_a_split_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "SPLIT_ROWS", 5)
    rows = [(k, i) for i in range(40) for k in ([1] if i % 2 else [i % 7, None])]
    left, right = spark.createDataFrame(rows, "k int, i int"), spark.createDataFrame([(k, k * 10) for k in range(1, 9)], "k int, v int")
    for how in ("inner", "left"):
        assert sorted(map(tuple, common.split_join(left, right, ["k"], how).select("k", "i", "v").collect()), key=repr) == sorted(map(tuple, left.join(right, "k", how).select("k", "i", "v").collect()), key=repr)


# --- 1: decontamination


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(i, invented(rng, rng.choice([3, 9, 10, 14, 30]))) for i in range(30)] + [(30, None), (31, ""), (32, "short item"), (None, "no id at all")]
    texts = [invented(rng, 40) + " " + rng.choice(items[:30])[1].upper() + "! " + invented(rng, 5) for _ in range(60)] + ODD + ["a short,item here"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for nodes in (2_000_000, 700):  # one automaton, and several one after another
        got = {r["doc_id"]: r for r in decontaminate.find_leaks(frame(spark, texts), bench, most_nodes=nodes).collect()}
        for d, t in enumerate(texts):
            w, hit, found = words_of(t), set(), set()
            for i, x in items:
                v = words_of(x)
                for k in range(max(1, len(v) - 9) if v and i is not None else 0):
                    win = v[k : k + 10]
                    for a in range(len(w) - len(win) + 1):
                        if w[a : a + len(win)] == win:
                            hit |= set(range(a, a + len(win)))
                            found.add(str(i))
            assert (got[d]["n_words"], got[d]["hit_words"], got[d]["items"]) == (len(w), sorted(hit), sorted(found))
            raw = (t or "").encode()
            assert [x for a, b in got[d]["spans"] for x in words_of(raw[a:b].decode())] == [w[i] for i in sorted(hit)]
    assert decontaminate.find_leaks(frame(spark, texts), bench.where("false")).where(F.size("items") > 0).count() == 0
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0


# --- 2: near-duplicates


def groups(texts, percent=85):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(2)
    base = [invented(rng, n, [f"w{i}" for i in range(400)]) for n in (60, 150, 150, 400)]
    texts = [edited(rng, b, rng.randrange(7)) for b in base for _ in range(40)] + [base[1]] * 20 + ODD + [t + " " + base[0] for t in base[1:]]
    rng.shuffle(texts)
    got = {r["doc_id"]: r for r in near.group(frame(spark, texts)).collect()}
    for i, (n, component) in enumerate(groups(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, component, component == i)


def test_near_duplicates_at_80_equal_brute_force(spark):
    rng = random.Random(12)
    base = [invented(rng, n, [f"w{i}" for i in range(400)]) for n in (120, 150, 200, 400)]
    texts = [edited(rng, b, rng.randrange(9)) for b in base for _ in range(40)] + ODD
    rng.shuffle(texts)
    assert groups(texts, 80) != groups(texts)
    got = {r["doc_id"]: r for r in near.group(frame(spark, texts), percent=80).collect()}
    for i, (n, component) in enumerate(groups(texts, 80)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, component, component == i)
    assert (near.chunks_for(85), near.chunks_for(80)) == (7, 11)


def test_pipeline_drops_near_copies_from_80_percent_on(spark, sf_dir):
    import corpus_pipeline as cp

    text = " ".join(f"w{i}" for i in range(100))
    copy = text.replace("w50 ", "x50 ").replace("w20 ", "x20 ")  # 86 of 106 shingles: 0.81
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, copy, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars int")
    assert [r["doc_id"] for r in cp.drop_near_copies(spark, docs, sf_dir).collect()] == [1]


def test_near_duplicates_odd_tables(spark):
    assert near.group(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None), (3, None)]
    got = sorted(map(tuple, near.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 2, 7, True), (7, 2, 7, True), (7, 2, 7, True), (None, 0, None, True), (3, 0, 3, True)], key=repr)


def test_components_of_a_long_path(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000)] + [(500, 500 + i) for i in range(1, 100)]
    rng.shuffle(edges)
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(201)) and all(got[500 + i] == 500 for i in range(100))


# --- 3: toxicity


def test_restoring_obfuscated_words():
    letters = toxicity.Letters({"idiot": 50, "stupid": 50, "hello": 50, "street": 30, "good": 30})
    for token, word in (("1d10t", "idiot"), ("s t u p i d", "stupid"), ("stuuuupid", "stupid"), ("$tup!d", "stupid"), ("h.e.l.l.o", "hello")):
        assert toxicity.restored(token, letters) == word


def test_restoring_keeps_words_apart_and_takes_every_token():
    words = {w: 50 for w in "such a moron idiot you are an asshole die hello street good idiots".split()}
    scorer = toxicity.Scorer({"moron": 0.9, "idiot": 0.9, "asshole": 0.9, "die": 0.9}, words, 0.01)
    assert toxicity.restored("a m o r o n", scorer.letters) == "a moron"
    for text, word in (("such a m o r o n", "moron"), ("y o u a r e a n i d i o t", "idiot"), ("455h0l3", "asshole"), ("1d1" + "0" * 40 + "t", "idiot"), ("d i e", "die"), ("iddiott", "idiot")):
        assert word in scorer.words(text), (text, scorer.words(text))
    assert scorer.score("hello good street 2024 and 1234567") == scorer.score(None)


def test_spacing_and_repetition_are_read_off_the_lattice():
    words = {w: 50 for w in "you are such a an idiot stupid moron hello street good see all off the book".split()}
    scorer = toxicity.Scorer({"idiot": 0.9, "stupid": 0.9, "moron": 0.9}, words, 0.01)
    for text in ("you are a i d i o t", "iidioott", "ssttuuppiidd", "i/d/i/o/t", "i,d,i,o,t", "i   d   i   o   t", "idi ot", "such a m-o-r-o-n", "m0r0n", "you stu pid"):
        assert scorer.score(text) >= 0.3, (text, scorer.words(text))
    for text in ("hello good street", "see all off the book", "a e i o u", "1 2 3 4 5 6", "you are good"):
        assert scorer.score(text) < 0.3, (text, scorer.words(text))


def test_viterbi_equals_all_readings():
    model = toxicity.Letters({w: 40 for w in "idiot stupid moron hello good street see a an".split()})

    def cost(reading):
        total, s = sum(c for _, c in reading), "^^"
        for letters, _ in reading:
            for c in letters:
                total, s = (total + model.cost(s, "$"), "^^") if c == " " else (total + model.cost(s, c), s[1] + c)
        return total + model.cost(s, "$")

    rng = random.Random(13)
    tokens = ["1d10t", "i d i o t", "sstupid", "m.0.r.0.n", "a m o r o n"] + ["".join(rng.choice("idot10 .sme") for _ in range(7)) for _ in range(60)]
    for token in tokens:
        every = list(itertools.product(*toxicity.lattice(token)))
        least = min(map(cost, every))
        assert any(abs(cost(x) - least) < 1e-9 and "".join(t for t, _ in x) == toxicity.restored(token, model) for x in every), token


def test_toxicity_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = queries.op3_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r["predicted"] for r in rows if r["toxic"]], [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_toxicity_with_clashing_columns_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "hello there", 7.0), (None, None, None)], "doc_id long, text string, tox_score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(toxicity.labelled_sample(docs, labels))).collect()
    assert all(abs(r["tox_score"] - 0.05) < 1e-9 for r in got) and got[0]["doc_id"] == 1


def test_toxicity_learns_and_scores(spark):
    rng = random.Random(3)
    bad = ["zorgle", "blaxter"]
    rows = [(invented(rng, 20) + (" " + rng.choice(bad) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)] + [(None, 1), ("x y", None)]
    fitted = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    texts = [*ODD, "such a z0rgl3 thing", "really z o r g l e here", "blaaaaxter", invented(rng, 30)]
    got = {r["doc_id"]: r["tox_score"] for r in toxicity.score(frame(spark, texts), fitted).collect()}
    n = len(ODD)
    assert all(got[i] < toxicity.THRESHOLD for i in range(n)) and all(got[n + k] >= toxicity.THRESHOLD for k in range(3)) and got[n + 3] < toxicity.THRESHOLD
    blank = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    assert {0 <= r["tox_score"] <= 1 for r in toxicity.score(frame(spark, texts), blank).collect()} == {True}


# --- 4: BPE


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(queries.TOKENIZER)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(4)
    texts = [*ODD, "we'll DON'T 'S", "é²½ 12³", "ɏɐǅ a\x85b \xa0c", "ab" * 2000, "\x00\x1f", "<|endoftext|><|endoftext|>"]
    texts += ["".join(rng.choice("ab '\n\xa0 é1²_-ɏɐ𝔸\x1f<|") for _ in range(50)) for _ in range(400)]
    for r in bpe.encode_decode(frame(spark, texts), queries.TOKENIZER).collect():
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], np.uint32).tolist() == want and r["n_tokens"] == len(want)
        assert r["decoded"] == library.decode(want, skip_special_tokens=False) and r["kept"] == "clash"
    assert bpe.encode_decode(frame(spark, []), queries.TOKENIZER).count() == 0


# --- 5: licenses


#: The conditions and disclaimers of two well-known licenses.
FULL_TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]


@pytest.mark.parametrize("literals", [256, 3])
def test_license_scan_equals_brute_force(spark, monkeypatch, literals):
    monkeypatch.setattr(licenses, "MOST_LITERALS", literals)  # as literals of the plan, and joined
    monkeypatch.setattr(licenses, "TEMPLATES", [*licenses.TEMPLATES, *FULL_TEXTS])
    rng = random.Random(5)
    texts = list(ODD)
    for name, t in licenses.TEMPLATES:
        w = t.split()
        texts += [invented(rng, 30) + " " + t.upper() + " " + invented(rng, 9), " ".join(w[: len(w) // 2])]
        if len(w) > 14:
            texts.append(invented(rng, 4) + " " + " ".join(w[:-1] + ["changed"]))
    got = {r["doc_id"]: {x["name"]: round(x["share"], 9) for x in r["licenses"]} for r in licenses.scan(frame(spark, texts), licenses.TEMPLATES).collect()}

    def shingles(t):
        w = [x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    for d, t in enumerate(texts):
        want, doc = {}, shingles(t)
        for name, x in licenses.TEMPLATES:
            s = shingles(x)
            for k in range(max(1, len(s) - licenses.WINDOW + 1)):
                win = s[k : k + licenses.WINDOW]
                for a in range(len(doc)):
                    share = len(set(win) & set(doc[a : a + len(win)])) / len(set(win))
                    if share >= licenses.LEAST_SHARE:
                        want[name] = max(want.get(name, 0), round(share, 9))
        assert got[d] == want, (d, t)
    assert licenses.scan(frame(spark, texts), []).where(F.size("licenses") > 0).count() == 0
    assert licenses.scan(frame(spark, [])).count() == 0


# --- 6: HTML


PAGE = """<!DOCTYPE html><html><head><title>T &amp; u</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="with-sidebar"><header><a>Site {0}</a></header>
<nav><ul><li><a href="/x">Menu {0}</a></li></ul></nav><!-- ad --><div class="ad">Buy {0}</div><div class="cookie-notice">We use cookies</div>
<div class="layout with-sidebar"><article><header><h1>Head {0}</h1></header><p><b>First&nbsp;line {0} &lt;x&gt;<br><p>Second
 line<form><input name="q">Send</form></p><ul><li>one<li>two</ul><aside>Related</aside></article></div><section id="comments"><article class="comment">I agree</article></section><footer>&copy; {0}</footer></body></html>"""


def test_html_keeps_the_article(spark):
    pages = [(i, f"https://h.example/en/{i}", PAGE.format(i)) for i in range(5)] + [(9, "https://h.example/en/1", PAGE.format(1)), (10, None, None), (11, "", ""), (12, "x", "plain &amp; text"), (13, "y://z", "<p>open <b>text"), (14, "q", "a < b <a title=\"x>y</p>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    for i in range(5):
        assert got[i] == f"Head {i} First line {i} <x> Second line one two"
    assert got[9] == got[1] and got[10] == got[11] == "" and got[12] == "plain & text" and got[13] == "open text"
    assert html.extract(df.where("false")).count() == 0


def test_html_differencing_finds_unmarked_furniture(spark):
    page = "<body><div><p>Welcome to our site</p><p>Your basket is empty</p></div><div><p>{}</p><p>{}</p></div><div><p>All rights reserved</p></div></body>"
    rng = random.Random(6)
    own = [(invented(rng, 12) + f" {i}", invented(rng, 20) + f" {i}") for i in range(6)]
    rows = [(i, f"http://host.example/a/{i}", page.format(*t)) for i, t in enumerate(own)] + [(6, "http://host.example/a/5", page.format(*own[5]))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == " ".join(t) for i, t in enumerate(own[:5]))


def test_differencing_decides_where_nothing_is_marked(spark):
    """The test table's articles between unmarked lines of their hosts, article elements taken away."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    hosts, rows, want = Counter(), [], {}
    for r in pages:
        host = re.sub(r"^[a-z]+://", "", r["url"]).split("/")[0]
        hosts[host] += 1
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        rows.append((r["page_id"], r["url"], f"<body><div><p>Welcome to {host}</p><p>Sign in to go on</p></div><div>{inner}</div><div><p>{host} is ours</p></div></body>"))
        want[r["page_id"]] = host, html.main_text(f"<article>{inner}</article>", None)
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    alone = {p: html.main_text(page, None) for p, _, page in rows}
    several = [p for p, (host, _) in want.items() if hosts[host] > 1]
    changed = [p for p in several if got[p] != alone[p]]
    right = [p for p in several if got[p] == want[p][1]]
    assert len(several) > 200 and len(changed) > 0.95 * len(several) and len(right) > 0.8 * len(several), (len(several), len(changed), len(right))


def test_longest_common_subsequence():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html.shared_runs(a, b)
        rest = iter(b)
        assert len(got) == best[-1][-1] and got == sorted(got) and all(a[i] in rest for i in got)


# --- 7: language


def phrases(text, sample):
    n, i = 0, 0
    while i < len(text):
        k = i + 1
        while k <= len(text) and text[i:k] in sample:
            k += 1
        i = max(k - 1, i + 1)
        n += 1
    return n


def test_language_parses_into_longest_phrases():
    samples = {"a": ["hello hello world"], "b": ["holla mundo holla"]}
    parser = langid.Parser(samples)
    for text in ("hello", "holla world", "mundo hello holla"):
        counts, _ = parser.phrases([text])
        assert counts[0].tolist() == [phrases(f"{text} ", f"{samples[k][0]} ") for k in ("a", "b")]


def test_language_with_more_letters_than_a_table_has(spark):
    rng = random.Random(11)
    one, two = ([chr(0x4E00 + i) for i in range(k, 2000, 2)] for k in (0, 1))
    text = lambda letters, n: "".join(rng.choice(letters) + (" " if rng.random() < 0.1 else "") for _ in range(n))
    samples = {"one": [text(one, 3000)], "two": [text(two, 3000)], "latin": [invented(rng, 300)]}
    parser = langid.Parser(samples)
    for _ in range(20):
        given = [text(one, 80), text(two, 80), text(one, 80) + text(two, 10), invented(rng, 10)]
        counts, _ = parser.phrases(given)
        squeeze = lambda t: re.sub(r"[^\w]+", " ", t).strip() + " "
        assert counts.tolist() == [[phrases(squeeze(t), squeeze(samples[k][0])) for k in parser.languages] for t in given]
        assert parser.predict(given)[0] == ["one", "two", "one", "latin"]
    assert parser.predict(["", "12", one[0] + two[0]])[0][:2] == ["und", "und"]
    tie = langid.Parser({"b": ["xy"], "a": ["xy"]}).predict(["xyxy"])
    assert tie == (["a"], [0.5])


def test_language_held_out_and_odd(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.learn(docs.where(~common.held_out("doc_id", 4))))
    rows = found.where(common.held_out("doc_id", 4)).select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    odd = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identify(frame(spark, ODD), langid.learn(frame(spark, ["some words here", None], "en"))).collect()}
    assert [odd[i] for i in range(4)] == [("und", 0.0)] * 4 and odd[4][0] == "en"
    assert {r["lang_pred"] for r in langid.identify(frame(spark, ODD), langid.learn(frame(spark, []))).collect()} == {"und"}


# --- 8: vectors


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    rows = []
    for i in range(400):
        v = centres[rng.integers(30)] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15, 1.0])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(3))))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [1.0] * 16, None), (404, [1.0, None] * 8, 1), (405, [], 1), (406, [1.0] * 8, 1), (407, [2.0] * 8, 1), (408, [1.0] * 16, None)]
    got = {r["vec_id"]: r for r in vectors.group(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a, x in rows:
        for j, b, y in rows[:i]:
            if x is None or x != y or not a or not b or len(a) != len(b) or None in a + b:
                continue
            p, q = np.array(a, float), np.array(b, float)
            if np.isfinite(p).all() and np.isfinite(q).all() and p.any() and q.any() and p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.98:
                links[i] += 1
                links[j] += 1
                s, t = find(i), find(j)
                root[max(s, t)] = min(s, t)
    for i, _, _ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], find(i), find(i) == i)
    assert vectors.group(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("dim", [16, 64])
def test_planted_pairs_are_found_over_many_lists(spark, monkeypatch, dim):
    monkeypatch.setattr(vectors, "LIST_SIZE", 16)
    monkeypatch.setattr(vectors, "FIRST_CENTRES", 24)
    monkeypatch.setattr(vectors, "NEXT_CENTRES", 4)  # two and more levels
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(18)
    base = rng.normal(size=(1200, dim)) + rng.normal(size=(20, dim))[rng.integers(20, size=1200)] * 2
    near = base[:600] + rng.normal(size=(600, dim)) * np.linalg.norm(base[:600], axis=1)[:, None] / math.sqrt(dim) * rng.uniform(0.02, 0.25, size=(600, 1))
    x = np.concatenate([base, near]).astype(np.float32).astype(float)
    label = np.concatenate([np.arange(1200) % 2, np.arange(600) % 2])
    index = vectors.Index(dim, x / np.linalg.norm(x, axis=1, keepdims=True), len(x))
    assert len(index.levels) >= 2
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(hit, False)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    got = {r["vec_id"]: r["n_links"] for r in vectors.group(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    want = hit.sum(1)
    assert all(got[i] <= want[i] for i in range(len(x))) and sum(got.values()) >= 0.98 * want.sum() > 300


# --- 9: language model


def test_lm_base_is_exact_and_equal_texts_score_alike(spark, monkeypatch):
    monkeypatch.setattr(lm, "COMMON_WORDS", 5)  # most words go through the join
    rng = random.Random(9)
    texts = [invented(rng, rng.randrange(1, 60)) for _ in range(60)] + ODD
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in lm.score(docs, docs.where("doc_id % 3 > 0"), queries.RANKS, public_tokenizers.PATTERN, carry=["doc_id"]).collect()}
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None] for d, t in enumerate(texts)}
    c = Counter(w for d, ws in tokens.items() if d % 3 for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in tokens.items():
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert abs(base - got[d]["base_score"]) < 1e-9 * abs(base) + 1e-9
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert np.isfinite(got[d]["score"]) and got[d]["score"] < 0
    assert got[0 + 60]["score"] == got[61]["score"] and got[64]["score"] == got[65]["score"]
    assert lm.score(frame(spark, []), docs, queries.RANKS, public_tokenizers.PATTERN).count() == 0
    assert lm.score(docs.limit(3), docs.where("false"), queries.RANKS, public_tokenizers.PATTERN).where("train_tokens = 0").count() == 3


def small_model():
    counts = np.zeros(50257)
    counts[:3000] = np.arange(3000, 0, -1)
    return lm.Model(lm.start(counts))


def test_lm_trains_on_every_text(spark):
    vocabulary = lm.read_vocabulary(queries.RANKS)
    ranks = spark.sparkContext.broadcast(vocabulary)
    size = len(vocabulary.splitlines()) + 1
    first = lm.start(np.ones(size))
    for text in ("alpha beta", "gamma delta", "one more text", None):  # a text alone changes the model
        after, share = lm.train(spark.createDataFrame([(text,)], "text string"), "text", first, ranks, public_tokenizers.PATTERN)
        assert 0 < share < 1 and any((after[k] != first[k]).any() for k in first if k != "rank")


def test_lm_averages_trainers_by_what_they_saw(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 2)
    rows = [(p, t, t + 1, np.array([t, p], np.float32).tobytes()) for p in range(2) for t in range(5)]
    got = {r["piece"]: np.frombuffer(r["numbers"], np.float32).tolist() for r in lm.averaged(spark.createDataFrame(rows, "piece long, trainer long, seen long, numbers binary"), 5).collect()}
    mean = sum(t * (t + 1) for t in range(5)) / 15
    assert all(np.allclose(got[p], [mean, p], atol=1e-5) for p in range(2))


def test_lm_beats_its_base_on_held_out_texts(spark):
    scored = queries.op9_lm_score(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in scored) > sum(r["base_score"] for r in scored) * 0.98
    assert sum(r["score"] > r["base_score"] for r in scored) > 0.9 * len(scored)


def test_lm_windows_score_each_token_once_and_causally():
    model, rng = small_model(), np.random.default_rng(1)
    ids, starts = rng.integers(0, 2000, 100).astype(np.int32), np.array([0, 45, 46, 100])
    inputs, targets, text, firsts = lm.blocks(ids, starts, 2999)
    assert sorted(targets[targets >= 0].tolist()) == sorted(ids.tolist())
    whole = model.log_probs(inputs, targets, firsts)
    hidden = model.attend(inputs, firsts, lm._before(inputs))[0]
    assert abs(model.states(inputs, firsts) - hidden).max() < 1e-5
    changed = ids.copy()
    changed[30] = 1999
    i2, t2, _, f2 = lm.blocks(changed, starts, 2999)
    other = model.log_probs(i2, t2, f2)
    flat, flat2 = whole[text == 0].ravel(), other[text == 0].ravel()
    assert np.allclose(flat[:30], flat2[:30], atol=1e-5) and not np.allclose(flat[31:45], flat2[31:45])
    assert np.allclose(whole[text > 0], other[text > 0], atol=1e-5)


def test_lm_probabilities_sum_to_one_and_training_helps():
    model = small_model()
    h = lm.with_one(np.tanh(np.random.default_rng(2).normal(size=(1, lm.DIM))).astype(np.float32))
    every = np.arange(lm.DIGITS**4)
    assert abs(np.exp(model.digits(np.repeat(h, len(every), 0), every)).sum() - 1) < 1e-3
    rng = np.random.default_rng(3)
    ids = np.tile(rng.integers(0, 500, 20), 200).astype(np.int32)
    inputs, targets, _, firsts = lm.blocks(ids, np.array([0, len(ids)]), 2999)
    before = model.log_probs(inputs, targets, firsts).sum()
    sums = {k: np.zeros_like(v) for k, v in model.p.items() if k != "rank"}
    for _ in range(30):
        model.step(inputs, targets, firsts, lm._before(inputs), sums, 0.2)
    model.tables = None
    assert model.log_probs(inputs, targets, firsts).sum() > 0.6 * before


def test_lm_words_are_encoded_together_and_told_apart_by_their_ids():
    subwords = lm.Subwords(lm.read_vocabulary(queries.RANKS), public_tokenizers.PATTERN)
    words = ["alpha", "it's", "'s", "x1y2", "日本", "a\u3000b", "--", "\u00a0", "z" * 300, "alpha", "!a", "é", "don't've"]
    for some in (words, words[:4], ["日本"], []):
        ids, sizes = subwords.encode(some)
        each = [subwords.encoding.encode_ordinary(" " + w) for w in some]
        assert ids.tolist() == [i for e in each for i in e] and sizes.tolist() == [len(e) for e in each]
    ids, starts, _ = lm.subword_ids([" ".join(words), None, "alpha  beta"], subwords)
    begins, hashes = lm.units(ids, subwords.opens, subwords.end)
    assert len(begins) == len(words) + 2 + 3 and (hashes == 0).sum() == 3 and set(starts[1:] - 1) <= set(begins.tolist())
    assert hashes[0] == hashes[9] == hashes[len(words) + 2] and len(set(hashes.tolist())) == len(set(words)) + 2


def test_lm_blocks_in_runs_give_the_same_states_and_true_gradients():
    rng = np.random.default_rng(4)
    model = small_model()
    ids, starts = rng.integers(0, 2500, 400).astype(np.int32), np.array([0, 150, 151, 400])
    inputs, targets, firsts, before = lm.dealt(ids, starts, 2999)
    flat = [x.reshape(-1, *x.shape[2:]) for x in (inputs, targets, firsts)]
    assert (targets >= 0).sum() == len(ids) and len(inputs) == len(before) > 2
    assert abs(model.attend(flat[0], flat[2], before)[0] - model.attend(flat[0], flat[2], lm._before(flat[0]))[0]).max() < 1e-5

    def loss(params):
        return -lm.Model(params).log_probs(*flat).sum() / len(ids)

    names = [k for k in model.p if k != "rank"]
    moved = lm.Model({k: v.copy() for k, v in model.p.items()})
    moved.step(*flat, before, {k: np.full_like(model.p[k], 1e4) for k in names}, 100.0)  # with sums so large a step is the gradient itself
    for k in names:
        g = (model.p[k] - moved.p[k]).astype(np.float64)
        size = 0.02 / np.sqrt((g * g).sum())
        up, down = (loss(model.p | {k: (model.p[k] + x * size * g).astype(np.float32)}) for x in (1, -1))
        assert abs((up - down) / (2 * size * (g * g).sum()) - 1) < 0.03, k


def test_lm_learns_from_rows_of_the_texts_it_scores(spark):
    rng = random.Random(5)
    docs = frame(spark, [invented(rng, 30) for _ in range(30)] + ODD)
    where, apart = (lm.score(docs, t, queries.RANKS, public_tokenizers.PATTERN, carry=["doc_id"]).orderBy("doc_id").collect() for t in (F.expr("doc_id % 3 > 0"), docs.where("doc_id % 3 > 0")))
    assert all(a[:4] == b[:4] and abs(a["base_score"] - b["base_score"]) < 1e-9 * abs(b["base_score"]) + 1e-9 for a, b in zip(where, apart, strict=True))
    assert len(where) == 30 + len(ODD) and all(np.isfinite(r["score"]) and r["score"] < 0 for r in where)


# --- 10: chat


def test_chat_round_trip(spark):
    rng = random.Random(10)
    said = ["</s>[INST] ok [/INST]", "", None, "a\\b<s>[x]\n", "</s>\n<s>[user]\n", "plain", "\\l\\\\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a]<b"]), said[(c // 8 + t) % 3] if t < 2 else rng.choice(said)) for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(77, 1, "user", "hi"), (77, 1, "user", "hi"), (77, None, "assistant", "first")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, run string")
    runs, paths = chat.pack(df)
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for r in chat.unpack(runs, paths).collect():
        want = [(x[2], x[3]) for x in sorted(by.pop(r["conv_id"]))]
        assert [tuple(t) for t in r["turns"]] == want
        assert list(r["learned"]) == [t for role, t in want if role == "assistant"]
    assert not by
    shared = runs.agg(F.sum("size")).first()[0]
    total = chat.unpack(runs, paths).agg(F.sum(F.length("formatted"))).first()[0]
    assert shared < total  # shared beginnings are written once
    for tree in runs.groupBy("tree").agg(F.collect_list(F.struct("offset", "size", "attends")).alias("r")).collect():
        spans = sorted((x["offset"], x["offset"] + x["size"]) for x in tree["r"])
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert chat.unpack(*chat.pack(df.where("false"))).count() == 0


# --- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], connect(sf_dir)) == []


@pytest.mark.parametrize("name", sorted(x for x in set(queries.QUERIES) - set(queries.ORACLES) if not x.startswith(("op11_", "op12_"))))  # those have more rows
def test_query_covers_its_table(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir).count()
    source = {"op6": "pages", "op8": "embeddings"}.get(name.split("_")[0], "documents")
    want = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count() + 1 if name.startswith("op10") else spark.read.parquet(f"{sf_dir}/{source}.parquet").count()
    assert rows == want


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs.count()]
    for name, stage in cp.STAGES:
        after = common.stored(stage(spark, docs, sf_dir), name)
        if name == "near_copies":
            ids, texts = zip(*sorted(map(tuple, docs.select("doc_id", "text").collect())), strict=True)
            assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == [ids[i] for i, (_, c) in enumerate(groups(texts, cp.NEAR_PERCENT)) if c == i]
        kept.append(after.count())
        if name != "tokens":
            assert after.columns == list(cp.COLUMNS)
            docs = after
    assert kept == sorted(kept, reverse=True) and kept[-1] == kept[-2] > 0
    assert cp.run(spark, sf_dir).count() == kept[-1]


def test_pipeline_stages_with_odd_rows(spark, sf_dir):
    import corpus_pipeline as cp

    long = " ".join(f"word{i} thing{i % 7}" for i in range(8000))
    rows = [(1, None, None, None, None), (None, "some words of a text here", "en", "s", 1), (2, "", "en", "s", 0), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (4, long, "en", None, 1), (5, "12 !!", "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in cp.STAGES:
        empty = stage(spark, spark.createDataFrame([], schema), sf_dir)
        assert empty.count() == 0
        docs = common.stored(stage(spark, docs, sf_dir), name)
        left = sorted((r["doc_id"] or 0) for r in docs.collect())
        assert left == ([0, 3, 3, 4] if name in ("language", "toxicity") else [0, 3, 3]), (name, left)
    assert all(r["n_tokens"] > 0 for r in docs.collect())


def test_page_text_of_the_test_table(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op6_html_text(spark, sf_dir).collect():
        inside = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(entities.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?!b>)[a-z][^>]*>", " ", inside))).split())


def test_held_out_rule(spark):
    got = spark.range(50).select("id", common.held_out("id", 4).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_chat_digest(spark, sf_dir):
    row = queries.op10_chat_format(spark, sf_dir).where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
