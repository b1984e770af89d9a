"""Rules over single records on null, empty and odd values."""

import pytest
from pyspark.sql import functions as F

from rankweave.functions import payloads, records
from rankweave.operators import claims

KEYS = ["Ứng viên A", "Ứng viên B", "Ứng viên C"]


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


@pytest.mark.parametrize(("said", "meant"), [("ứng viên b", 1), ("UNG VIEN B", 1), ("c", 2), ("Candidate A", 0), ("cand_2", 1), ("no. 3", 2), ("12", 0), ("nobody", None), ("", None), (None, None)])
def test_labels(spark, said, meant):
    got = one(spark, x=records.label_of(F.lit(said).cast("string"), F.array(*map(F.lit, KEYS)), ("ứng viên", "candidate"), "cand"))["x"]
    assert got == (None if meant is None else KEYS[meant])


def test_gates_files_and_times(spark):
    text = lambda t: F.lit(t).cast("string")
    row = one(
        spark, a=records.parsed_gate(text(None), F.lit(False)), b=records.parsed_gate(text(" \n "), F.lit(None).cast("boolean")), c=records.parsed_gate(text("x"), F.lit(True)), d=records.parsed_gate(text("x"), F.lit(False)),
        e=records.escaped_file(text(None), 9), f=records.escaped_file(text("<file a></file>b</file"), 16), g=records.read_at(F.lit(False), F.lit(True), F.lit(None).cast("int"), F.lit(5), F.lit(9)),
        h=records.read_at(F.lit(True), F.lit(True), F.lit(3), F.lit(5), F.lit(9)), i=records.read_at(F.lit(True), F.lit(False), F.lit(3), F.lit(5), F.lit(9)),
        j=records.responded_at(F.lit("pending"), F.lit("declined"), F.lit(None).cast("int"), F.lit(9)), k=records.responded_at(F.lit("pending"), F.lit("withdrawn"), F.lit(None).cast("int"), F.lit(9)),
    )
    assert [row[k] for k in "abcd"] == ["degrade", "degrade", "degrade", "pass"]
    assert row["e"] == "" and row["f"] == "&lt;file a>&lt;/file&gt;b"
    assert [row[k] for k in "ghijk"] == [9, 5, None, 9, None]


def test_benchmarks(spark):
    strings = lambda x: F.array(*map(F.lit, x))
    entry = lambda c, a, core, adv: F.struct(F.lit(c).alias("category"), strings(a).alias("aliases"), F.lit(c.title()).alias("name"), strings(core).alias("core"), strings(adv).alias("advanced"))
    catalog = F.array(entry("backend", ["backend", "server"], "abcdefg", "xayzw"), entry("web", ["frontend developer"], "pq", "p"))
    got = lambda role, level: one(spark, b=records.benchmark(F.lit(role).cast("string"), F.lit(level).cast("string"), catalog))["b"]
    assert got("Frontend", "JUNIOR ")[0:5] == ("web", "Web", "junior", "1-2 năm kinh nghiệm (Junior)", 2) and got("Frontend", "junior")["skills"] == ["p", "q"]
    assert got(None, None)["category"] == "backend" and got("?", "x")["skills"] == list("abcdefgxyz")
    assert got("Server side", "intern")["skills"] == list("abcde") and got("web", "lead")["years"] == 7


def test_maps_of_models_keep_strings_alone(spark):
    texts = ['{"a": 1, "b": " x ", "c": {"d": 1}, "e": "", "f": null, "g": ["h"]}', "{'a': 'x'}", '```json\n{"a": "y"}\n```', "none", None, "[1]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(payloads.string_map(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in got] == [{"b": "x"}, {}, {"a": "y"}, {}, {}, {}]


def test_ingest_records(spark):
    terms = spark.createDataFrame([("go", "go", "c", "r"), ("java", "java", "c", "r")], "variant string, slug string, category string, role string")
    docs = spark.createDataFrame([(1, "Go and Java, a@b.org", "java"), (2, None, None), (3, "x", "go")], "id int, text string, summary string")
    vectors = spark.createDataFrame([(1, [3.0, 4.0])], "id int, embedding array<float>")
    got = {r["id"]: tuple(r)[1:] for r in claims.ingest_record(docs, "id", "text", "summary", terms, vectors).collect()}
    assert got[1] == (20, 4, 1, 1, 2, 1, 0, 0.5, 4, False, 2, 5.0)
    assert got[2] == (0, 0, 0, 0, 0, 0, 0, None, 0, True, 0, None)
    assert got[3] == (1, 1, 0, 1, 0, 0, 1, None, 2, False, 0, None)
    assert claims.ingest_record(docs.limit(0), "id", "text", "summary", terms, vectors).count() == 0


def test_near_words_name_skills(spark):
    from rankweave.operators import skills

    terms = spark.createDataFrame([("kubernetes", "k8s", "c", "r"), ("go", "go", "c", "r")], "variant string, slug string, category string, role string")
    docs = spark.createDataFrame([(1, "kubernets and go"), (2, "kuber"), (3, None)], "id int, text string")
    assert sorted(map(tuple, skills.extract(docs, terms, "id", near=True).collect())) == [(1, "go"), (1, "k8s")]
    assert sorted(map(tuple, skills.extract(docs, terms, "id").collect())) == [(1, "go")]


def test_seeded_postings(spark):
    from rankweave.operators import relational

    rows = [(1, "Data Engineer (Senior)", "x" * 200, "it"), (2, "data engineer", "x" * 300, "it"), (3, "Backend Dev", "x" * 150, "it"), (4, "Backend Data", "x" * 140, "it"), (5, "Data", "x" * 100, "it"), (6, "Data", "x" * 900, "food"), (7, None, "x" * 900, "it")]
    df = spark.createDataFrame(rows, "id int, title string, body string, kind string").withColumn("more", F.lit(None).cast("string"))
    groups = [(1, ["data"], []), (2, ["backend"], ["front"])]
    got = relational.seeded_postings(df, "id", "title", ["body", "more"], "kind", ["it"], groups, [(2, 1), (1, 5)])
    assert sorted((r["id"], r["taken_by"], r["place"]) for r in got.collect()) == [(2, 1, 1), (3, 2, 1), (4, 1, 2)]
