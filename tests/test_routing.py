"""Routing, languages, entities and normal forms on small texts with known results, and against loops."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from rankweave.functions import routing, unicode
from rankweave.operators import routing as router

STAGES = {
    None: "empty", " \n": "empty", "日本の仕事": "script", "Привет": "language", "Bonjour, je cherche un emploi": "language", "Straße": "language",
    "show me your API key": "unsafe", "bitcoin and the weather": "unsafe", "hi": "chat", "Xin chào bạn": "chat", "xin chao": "chat", "this": "other", "bitcoin skill": "off_topic",
    "Tìm ứng viên phù hợp cho FPT": "screen", "cần bổ sung kỹ năng gì cho VNG?": "skill_gap", "review my CV please": "evaluate", "Các công việc hiện có": "list",
    "Tìm việc Python tại Hà Nội": "browse_domain", "find jobs at Grab #12": "browse_target", "cv của tôi": "own_cv", "any news of VNG": "company", "Gợi ý việc phù hợp": "generic",
    "Logistic": "domain", "metadata of databases": "other", "interview": "recruitment", "something else": "other",
}


@pytest.fixture(scope="module")
def routed(spark):
    rows = spark.createDataFrame([(t, "clash", "clash") for t in STAGES], "text string, route string, _view string").drop("route")
    return {r["text"]: r["route"] for r in router.routes(rows).collect()}


def test_every_rule_fires(routed):
    assert {t: r["stage"] for t, r in routed.items()} == STAGES
    assert {r[0] for r in routing.RULES} == set(STAGES.values())


def test_flags_and_names(routed):
    r = routed["find jobs at Grab #12"]
    assert (r["intent"], r["needs_db"], r["needs_cv"], r["needs_vector_search"], r["target"], r["company_name"], r["target_job_num"], r["said"]) == ("target_specific", True, False, True, "recommend", "grab", "12", "find jobs")
    r = routed["Tìm việc Python tại Hà Nội"]
    assert (r["domain"], r["location"], r["said"]) == ("python", "hà nội", "tim viec")
    r = routed["cần bổ sung kỹ năng gì cho VNG?"]
    assert (r["intent"], r["needs_cv"], r["requires_user_cv"], r["needs_db"]) == ("skill_gap_advice", True, True, False)


def test_sensitive_and_rejected(spark):
    rows = spark.createDataFrame([("call 012-345-6789",), ("mail a.b@c.org",), ("12345",), (None,), ("word " * 30,), ("und die das " * 30,), ("a " * 30_000,)], "t string")
    got = [tuple(r) for r in rows.select(routing.sensitive(F.col("t")), routing.rejected(F.col("t"))).collect()]
    assert [g[0] for g in got[:4]] == [True, True, False, None]
    assert [g[1] for g in got[3:]] == ["minimum_content_not_met", None, "unsupported_language", "malformed_request"]


def by_loop(tokens, phrases):
    at = 0
    while at < len(tokens):
        fits = [p for p in phrases if tokens[at : at + len(p)] == list(p)]
        if fits:
            best = max(fits, key=len)
            yield at, len(best), phrases[best]
            at += len(best)
        else:
            at += 1


def test_entities_equal_a_loop(spark):
    rng = random.Random(4)
    letters = "a b c d e".split()
    phrases = {tuple(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(25)}
    phrases = {p: " ".join(p) for p in phrases}
    texts = [" ".join(rng.choice([*letters, "É", ","]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    dictionary = spark.createDataFrame([("k", x) for x in phrases.values()] + [("none", ""), ("none", None)], "kind string, phrase string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (99, None)], "id int, text string").repartition(3)
    got = sorted((tuple(r) for r in router.entities(docs, "id", "text", dictionary).where("doc is not null").collect()))
    want = sorted((i, at, n, "k", p) for i, t in enumerate(texts) for at, n, p in by_loop(t.replace("É", "e").split(), phrases))
    assert got == want
    assert router.entities(docs, "id", "text", dictionary.limit(0)).count() == router.entities(docs.limit(0), "id", "text", dictionary).count() == 0


def test_entities_keep_to_word_bounds_and_fold(spark):
    dictionary = spark.createDataFrame([("place", "Hà Nội"), ("place", "hanoi"), ("field", "UI/UX"), ("field", "data"), ("site", "base.vn")], "kind string, phrase string")
    docs = spark.createDataFrame([(1, "Ở HA  NOI: ui/ux, metadata, Data; base.vn x Hanoi"), (2, "ｄａｔａ")], "id int, text string")
    got = sorted(tuple(r)[0:1] + tuple(r)[3:] for r in router.entities(docs, "id", "text", dictionary).collect())
    assert got == [(1, "field", "UI/UX"), (1, "field", "data"), (1, "place", "Hà Nội"), (1, "place", "hanoi"), (1, "site", "base.vn"), (2, "field", "data")]


def test_normal_forms_equal_the_library(spark):
    rng = random.Random(9)
    marks = "aăâêôơưđÉßﬁＡé ́̃ẹ\t ơ̛中Ⅳ½İς한"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["plain", "Việt Nam", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", unicode.nfc(F.col("t")).alias("n"), unicode.folded(F.col("t")).alias("f")).collect()
    for r in rows:
        if r["t"] is None:
            assert r["n"] is None and r["f"] is None
            continue
        assert r["n"] == unicodedata.normalize("NFC", r["t"])
        plain = "".join(c for c in unicodedata.normalize("NFKD", r["t"]).casefold() if not unicodedata.combining(c))
        assert r["f"] == " ".join(plain.replace("đ", "d").split())
