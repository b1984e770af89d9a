"""What keeps a task's share small, or a rule's cost, as tables grow."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from rankweave.functions import dates, guardrails, redaction, resumes, routing, unicode, wording
from rankweave.functions import text as texts
from rankweave.operators import claims, profiles, projects, relational, retrieval, skills
from rankweave.operators import resumes as structuring
from rankweave.plans import registry
from rankweave.sources import tables
from rankweave.streaming import state as live


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_gated_records_counts_pairs_in_small_shares(spark, tmp_path):
    rows = [(1, 7), (1, 8), (2, 7), (2, 7), (3, 9), (4, None), (5, 7), (5, 8), (5, 6), (None, 7)]
    spark.createDataFrame(rows, "g int, i int").write.parquet(str(tmp_path / "rows"))
    source = spark.read.parquet(str(tmp_path / "rows"))
    got = claims.gated_records(source, "g", "i", spark.createDataFrame([(6,), (7,), (8,), (8,)], "i int"), 2)
    want = {(1, "pass", None, 2), (2, "block", "DATA_SCOPE_MISMATCH", 0), (3, "block", "DATA_SCOPE_MISMATCH", 0), (4, "block", "DATA_SCOPE_MISMATCH", 0), (5, "degrade", "DATA_BUDGET_EXCEEDED", 2), (None, "pass", None, 1)}
    assert set(map(tuple, got.collect())) == want
    assert "REPARTITION_BY_NUM" in plan(got)


def test_rows_are_dealt_by_the_size_of_their_files(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("id", "id % 7 AS k").write.parquet(str(tmp_path / "a b"))
    rows = spark.read.parquet(str(tmp_path / "a b"))
    assert tables.dealt(rows, "k").rdd.getNumPartitions() == 4
    monkeypatch.setattr(tables, "SHARE", 200)
    assert tables.dealt(rows.where("id > 5"), "k").rdd.getNumPartitions() > 8


def test_output_problems_sort_small_shares(spark):
    rows = spark.createDataFrame([(1, 5, 1, 0.5, 1), (1, 5, 2, 0.4, 0), (1, 6, 3, float("nan"), 0), (2, 5, 1, 1.0, 2)], "q int, d int, p int, s double, g int")
    got = profiles.ranked_problems(rows, spark.createDataFrame([(5,)], "d int"), "q", "d", "p", "s", "g")
    assert set(map(tuple, got.collect())) == {(1, 5, 2, "repeated"), (1, 5, 2, "order"), (1, 6, 3, "unknown"), (1, 6, 3, "score")}
    assert "REPARTITION_BY_NUM" in plan(got)


def test_fan_out_deals_a_keys_pairs_over_tasks(spark):
    rows, members = spark.range(300).selectExpr("id", "id % 2 AS key"), spark.range(40).selectExpr("id AS member", "id % 4 AS key")
    got = relational.fanned_out(rows, members, "key", "id")
    assert sorted((r["id"], r["member"]) for r in got.collect()) == sorted((i, m) for i in range(300) for m in range(40) if i % 2 == m % 4)
    assert got.where("key = 0").select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_notices_remember_items_not_notices(spark, tmp_path):
    spark.range(40).selectExpr("id % 20 AS item", "id % 2 AS company", "timestamp '2024-01-01' AS at").write.parquet(str(tmp_path / "in"))
    said = spark.readStream.schema("item long, company long, at timestamp").parquet(str(tmp_path / "in"))
    members = spark.range(60).selectExpr("id % 2 AS company", "id AS user").union(spark.createDataFrame([(0, 1), (0, 0), (0, None), (1, None)], "company long, user long"))
    run = live.notices(said, members, "company", "item", "e", "at").writeStream.format("memory").queryName("told").trigger(availableNow=True).start()
    run.awaitTermination()
    want = {(u, f"e:{i}:{u}") for i in range(20) for u in range(60) if i % 2 == u % 2} | {(1, f"e:{i}:1") for i in range(0, 20, 2)} | {(None, f"e:{i}") for i in range(20)}
    assert sorted(map(tuple, spark.table("told").select("user", "key").collect()), key=repr) == sorted(want, key=repr)
    rows = max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in run.recentProgress)
    assert rows < len(want) / 2


ODD = ["", " ", "a", "\u3000a b\u2028", "\xa0x\xa0\n", "a \n\tb\xa0\n\n\n\n\n c \t", "# a\r\nb\x0bc\x85d", "<b>x</b>\x00y\ufeff\xad", "© TopCV.vn 1", "a\u2003\n \n#b", "x1 y_ z ÄÖ9 đé", "a\u1680", "<!-- Start of picture text -->q<!-- End of picture text -->r", "\n \n\na\n\n\n\n"]


def test_texts_are_prepared_as_by_the_patterns(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "t string")
    t = F.col("t")
    ends = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, resumes.LEFT_BEHIND, ""), resumes.LINE_END, "\n"), r"[ \t\x{A0}]+(?=\n|$)", ""), r"\n{4,}", "\n\n\n")
    old_words = F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike(r"^\p{L}+$"))
    got = df.select(unicode.trimmed(t).alias("a"), ends(t).alias("b"), resumes.clean(t).alias("c"), F.btrim(c, F.lit(" \t\n")).alias("d"), unicode.words(t).alias("e"), old_words.alias("f")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] and r["e"] == r["f"] for r in got)


def test_lines_without_digits_meet_no_pattern_of_dates(spark):
    said = dates.without_ranges(F.col("t"))
    got = spark.createDataFrame([("(lead  dev) -",), ("dev | Mar 2019 - Present",), ("10/2018 02/2020  x",), (None,)], "t string").select(said.alias("x"))
    assert [r["x"] for r in got.collect()] == ["lead dev", "dev", "x", None]
    assert "CASE WHEN" in plan(got)


def test_a_language_is_found_once_a_text(spark, sf_dir):
    from rankweave.plans.registry import QUERIES

    shown = QUERIES["supported_language"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count(routing.SCRIPTS) == 1


def test_metrics_are_looked_for_once_a_block(spark):
    texts = ["cut latency by 40 ms, 35% less cost", "memory and CPU", "no such", "", None]
    t = F.col("t")
    every = F.array_distinct(F.transform(F.concat(*(F.regexp_extract_all(t, F.lit(f"(?iuU){p}"), F.lit(0)) for p in redaction.IMPACT)), F.trim))
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(redaction.metrics(t).alias("m"), every.alias("e")).collect()
    assert all(r["m"] == r["e"] for r in got) and len(got[0]["m"]) >= 3 and got[4]["m"] is None
    docs = spark.createDataFrame([(1, "Projects\nShop - saved 120 ms for 2k users over a long while")], "id int, t string")
    terms = spark.createDataFrame([("x", "x", "c", "r")], "variant string, slug string, category string, role string")
    shown = projects.projects(docs, "id", terms, "t", 2026)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count(redaction.IMPACT[-1]) == 1


def test_entities_turn_few_rows_at_a_time_into_lists(spark, monkeypatch):
    from rankweave.operators import routing as router

    assert router.ROWS <= 1000
    monkeypatch.setattr(router, "ROWS", 2)
    docs = spark.createDataFrame([(i, f"a{i} big data") for i in range(7)], "id int, t string").coalesce(1)
    got = router.entities(docs, "id", "t", spark.createDataFrame([("k", "big data"), ("k", "a3")], "kind string, phrase string"))
    assert sorted((r["doc"], r["at"], r["phrase"]) for r in got.collect()) == sorted([(i, 1, "big data") for i in range(7)] + [(3, 0, "a3")])


def test_bm25_splits_each_text_once(spark):
    rows = spark.createDataFrame([(1, "Spark, spark\u00e9c++ and Hue"), (2, ""), (3, None), (4, "\u0130stanbul C#\u2014.net \u212a8s"), (5, "a"), (6, "\u00e9")], "id int, text string").repartition(2)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    asked = spark.createDataFrame([(1, "spark c++"), (2, "k8s i")], "q int, text string")
    got = retrieval.bm25_top(rows.mapInArrow(seen, rows.schema), asked, "id", "q", 3)
    assert {(r["query"], r["doc"]) for r in got.collect()} == {(1, 1), (2, 4)}
    assert read.value == 6


def test_words_by_bytes_are_tokens(spark):
    said = ["Spark, spark\u00e9c++ and Hue", "", "x", " x", "x ", None, "\u0130stanbul C#\u2014.net \u212a8s", "\u00e9", "a_b.c d", "abc"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, t string")
    want = [r["w"] or [] for r in rows.select(texts.tokens(F.col("t")).alias("w")).collect()]
    low = rows.select(F.lower(F.coalesce("t", F.lit(""))).alias("t")).toArrow().column("t").combine_chunks()
    for part in (low, low.slice(1, 5), low.slice(3), low.slice(1, 1)):
        first = next(k for k in range(len(low)) if low.slice(k, len(part)).equals(part))
        n, words = retrieval._words(part)
        assert (n.tolist(), words.to_pylist()) == ([len(w) for w in want[first : first + len(part)]], sum(want[first : first + len(part)], []))


def test_best_documents_of_many_steps(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "a " * (i % 5) + "b " * (i % 3) + "c") for i in range(60)], "id int, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "b")], "q int, text string")
    whole = sorted(map(tuple, retrieval.bm25_top(rows, asked, "id", "q", 60).collect()))
    want = [r for q in (1, 2, 3) for r in sorted((r for r in whole if r[0] == q), key=lambda r: (-r[2], r[1]))[:4]]
    score, kept = retrieval.np.array([[1.0, 0.0], [2.0, 0.0], [2.0, 3.0]]), []
    for part in (score[:2], score[2:], score):
        kept.append(retrieval._leading(part, 2, retrieval.np.zeros(2))[0].tolist())
    assert kept == [[[True, False], [True, False]], [[True, True]], [[False, False], [True, False], [True, True]]]
    assert sorted(map(tuple, retrieval.bm25_top(rows, asked, "id", "q", 4).collect())) == sorted(want)


def test_skills_are_named_without_a_shuffle_of_texts(spark):
    rows = spark.createDataFrame([(1, "we use k8s on big  data, big"), (2, "big"), (3, None), (4, "go")], "id int, view string")
    terms = spark.createDataFrame([("k8s", "kubernetes"), ("big data,", "data"), ("go", "go"), ("go", "golang")], "variant string, slug string")
    got = skills.named(rows, "view", terms)
    assert {r["id"]: r["slugs"] for r in got.collect()} == {1: ["data", "kubernetes"], 2: [], 3: [], 4: ["go", "golang"]}
    assert sorted(map(tuple, skills.found(rows, "view", terms, ["id"]).collect())) == [(1, "data"), (1, "kubernetes"), (4, "go"), (4, "golang")]
    assert "SortMergeJoin" not in plan(got) and "hashpartitioning(id" not in plan(got)


def test_matched_squeezes_uneven_space_only(spark):
    said = ["a  b", "a \nb", "a\n b", "a\tb", " a b ", "a.\n\nb, c", "\u00c0 la\u0301  c", "\x0b a\x0c\r\n b", "a...", ""]
    old = F.regexp_replace(F.translate(F.lower("t"), texts.ACCENTED, texts.FOLDED), r"[\x{300}-\x{36F}]", "")
    old = F.trim(F.regexp_replace(F.regexp_replace(old, texts.WORD_END, " "), r"\s+", " "))
    assert [r for r in spark.createDataFrame([(x,) for x in said], "t string").select("t", texts.matched(F.col("t")).alias("m"), old.alias("o")).collect() if r["m"] != r["o"]] == []


def test_match_evidence_looks_for_skills_in_ranked_documents_only(spark, sf_dir):
    assert "LeftSemi" in plan(registry.QUERIES["match_evidence"](spark, sf_dir))


def test_blanks_and_ends_of_words_name_no_asset(spark):
    plain = "that werden then vary scot der"
    got = spark.range(1).select(*(f(F.lit(plain), guardrails.squeezed(F.lit(plain))) for f in (guardrails._assets, guardrails._inherent))).first()
    assert tuple(got) == (False, False)


def test_signals_of_odd_words_equal_sql(spark):
    words = ["your", "that", "show", "send me", " erd ", "cột", ".env", "x.énv", "db", "sch3ma", "s-t-r", "structure", "RM  -rf", "pr0mpt", "d a t 4 base", "env variables", "then v", "api_k3y", "werden", "passwörd"]
    said = [f"{a} {b} {c}" for a in words for b in words for c in ("internal", ".", "give")]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", F.array_join(guardrails.injection_signals(F.col("t")), ",").alias("s"))
    con = duckdb.connect()
    con.execute("CREATE TABLE said (i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO said VALUES (?, ?)", list(enumerate(said)))
    sql = f"SELECT i, array_to_string({guardrails.sql_signals('lower(t)', 'view')}, ',') FROM (SELECT i, t, {guardrails.sql_folded('t')} AS view FROM said)"
    want = dict(con.sql(sql).fetchall())
    assert {r["i"]: r["s"] for r in rows.collect()} == want
    assert sum(bool(s) for s in want.values()) > 20


def test_outer_space_goes_whatever_it_is(spark):
    said = ["a", " a", "a　", "\r\na\n", "", " ", "  a b  ", None, "​ a"]
    got = [r["n"] for r in spark.createDataFrame([(x,) for x in said], "t string").select(guardrails.normalized(F.col("t")).alias("n")).collect()]
    assert got == ["a", "a", "a", "a", "", "", "a b", None, "a"]


def test_language_of_a_text_is_that_of_its_matched_form(spark, monkeypatch):
    said = ["la", "a la.", "va, x", "lava", "le là", "ñ cua", "ñ, yeu?", "la_", "kinhx", "KHONG", "ñ ĺa", "", "x\nnghiem\n", "(cau)", "caü", "đ", "e", None, "løa", "Kinh la"]
    rows = spark.createDataFrame([(x,) for x in said], "t string")
    matched = texts.matched(F.col("t"))
    want = F.when(F.lower("t").rlike(wording.VI_MARKS) | matched.rlike(wording.VI_TOKENS), "vi").otherwise("en")
    monkeypatch.setattr(texts, "matched", lambda t: F.raise_error(F.lit("the matched form is not needed")))
    got = rows.select("t", wording.detected_language(F.col("t")).alias("a"), want.alias("b")).collect()
    assert [r for r in got if r["a"] != r["b"]] == [] and {r["a"] for r in got} == {"vi", "en"}


def test_body_lines_or_sentences(spark):
    said = ["a\n b\n\nc\nd ", "a. b.  c。 d", "one", "", "a\n\n. b\n"]
    got = [r["l"] for r in spark.createDataFrame([(x,) for x in said], "t string").select(wording.body_lines(F.col("t")).alias("l")).collect()]
    assert got == [["a", "b", "c", "d"], ["a.", "b.", "c。", "d"], ["one"], [], ["a\n\n.", "b\n"]]


def test_profiles_are_made_within_rows_unless_ids_repeat(spark):
    terms = spark.createDataFrame([("go", "golang", "backend", "x"), ("java", "java", "backend", "x")], "variant string, slug string, category string, role string")
    rows = [(1, "Summary\nI write Go"), (2, "java"), (None, "none")]
    made = lambda rows: structuring.structured(spark.createDataFrame(rows, "id int, t string"), "id", terms, "t", None, F.lit("2026-06-15").cast("date"))
    alone, again = made(rows), made([*rows, (1, "java"), (None, "Go")])
    shown = alone._jdf.queryExecution().optimizedPlan().toString()
    assert "<=>" not in shown and "LeftOuter" not in shown  # no join by id, so no shuffle of texts
    assert sorted((r["doc"] or 0, r["skills"]) for r in alone.collect()) == [(0, []), (1, ["golang"]), (2, ["java"])]
    assert sorted((r["doc"] or 0, r["skills"]) for r in again.collect()) == [(0, ["golang"])] * 2 + [(1, ["golang", "java"])] * 2 + [(2, ["java"])]


SAID = [
    "Front-END, back  end and full stack", "iOS, İOS and ıos", "(ML) ai AIM data Engineer", "ſecurity, Site Reliability", "UI/UX uiux", "asp.NET .Net php", "Jean Le\nmail: a@b.co x@y.vn", "see GitHub.com/a or b.Co/x, WWW.a or http:// no",
    "0912 345\n678 or 84-912345678", "1/2/2020 12-3-99 1/22/333", "[a\nb](c) [d] (e)", "- \n 3. \n-\x85\n\n\n\nx \u2028", "## Contact\nname : x\n## A B\nLE van\na\tB", "\r\n a\rb \r\n", "", None,
]


def test_marks_of_hints_and_persons_lose_no_find(spark):
    t = F.col("t")
    plain = [(F.regexp_count(F.lit(""), F.lit("x")) + F.regexp_count(t, F.lit(f"(?iuU){h[0]}"))) * 4 for h in structuring.HINTS]
    lines = F.array_join(redaction._kept_lines(F.coalesce(t, F.lit(""))), "\n")
    for p in (redaction.LINK, redaction.EMAIL, redaction.URL, redaction.PHONE, redaction.BIRTH):
        lines = F.regexp_replace(lines, p, "")
    lines = F.array_join(F.transform(F.split(lines, "\n"), lambda x: F.when(F.trim(F.regexp_replace(x, redaction.BULLET, "")) == "", "").otherwise(F.rtrim(x))), "\n")
    bare = F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    got = spark.createDataFrame([(x,) for x in SAID], "t string").select(
        F.transform(structuring._hinted(F.lit(""), t), lambda v: v["weight"]).alias("a"), F.array(*plain).alias("b"), redaction.without_person(t).alias("c"), bare.alias("d"),
        redaction.without_links(t).alias("e"), F.regexp_replace(F.regexp_replace(t, redaction.URL, " "), redaction.EMAIL, " ").alias("f"),
    ).collect()
    assert all((r["a"] == r["b"] or r["e"] is None) and r["c"] == r["d"] and r["e"] == r["f"] for r in got) and sum(max(r["a"]) > 0 for r in got[:6]) == 6


def test_a_stream_of_notices_writes_items_not_notices(spark, sf_dir, monkeypatch):
    from rankweave.streaming import events

    written, drained = [], events.drained
    monkeypatch.setattr(events, "drained", lambda stream, name: written.append(drained(stream, name)) or written[-1])
    found = registry.QUERIES["stream_notices"](spark, sf_dir).count()
    pending = tables.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").count()
    assert [w.count() for w in written] == [pending] and found > 0 and "key" not in written[0].columns


def test_notices_of_a_table_are_those_of_a_stream_and_told_once(spark):
    first = spark.createDataFrame([(1, 7), (2, 7), (None, 8), (1, None)], "company int, item int").withColumn("at", F.lit("2026-01-01").cast("timestamp"))
    members = spark.createDataFrame([(1, 5), (2, 5), (1, 6), (1, 6), (1, None)], "company int, user int")
    got = sorted((r["user"] or 0, r["key"]) for r in live.told(first, members, "company", "item", "e", "at").collect())
    assert got == [(0, "e"), (0, "e:7"), (5, "e:5"), (5, "e:7:5"), (6, "e:6"), (6, "e:7:6")]
