"""Seeded permutations, samples, swaps and decoys: exact, and the same under any partitioning."""

import re

import pytest
from pyspark.sql import functions as F

from rankweave.operators import seeded

TERMS = [("java", "java"), ("spring boot", "spring_boot"), ("go", "go"), ("kafka", "kafka")]
POOL = ["rust", "go", "scala", "perl", "ada"]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 64, 100, 1000, 5003])
def test_permutations(spark, n):
    rows = spark.range(n).select("id", *(seeded.permuted(F.col("id"), F.lit(n), F.lit(s)).alias(f"s{s}") for s in range(3)))
    got = rows.collect()
    for s in range(3):
        assert sorted(r[f"s{s}"] for r in got) == list(range(n))
    if n >= 64:
        assert len({tuple(r[f"s{s}"] for r in got) for s in range(3)}) == 3 and [r["s0"] for r in got] != list(range(n))


def test_what_is_no_place_has_none(spark):
    assert [r[0] for r in spark.createDataFrame([(-1,), (3,), (None,)], "i long").select(seeded.permuted(F.col("i"), F.lit(3), F.lit(1))).collect()] == [None] * 3


def test_samples_have_their_size_and_order(spark):
    items = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda x: x * 10)
    rows = spark.range(40).select(seeded.sampled(items, F.col("id") % 10, F.col("id"), F.lit(4)).alias("s"), (F.col("id") % 10).alias("k")).collect()
    assert all(len(r["s"]) == r["k"] and r["s"] == sorted(set(r["s"])) for r in rows)
    assert len({tuple(r["s"]) for r in rows if r["k"] == 4}) > 1


def test_swaps(spark):
    said = "Java and Spring Boot, spring_boot; GO and kafka"
    named = F.array(*map(F.lit, ["go", "java", "kafka", "spring_boot"]))
    rows = spark.range(60).select(seeded.swapped(F.lit(said), named, POOL, F.col("id")).alias("t")).collect()
    assert len({r["t"] for r in rows}) > 5
    for r in rows:
        words = re.findall(r"[a-z_]+(?: boot)?", r["t"].lower())
        new = [w for w in words if w in POOL and w != "go"]
        assert len(set(new)) >= len(new) - 1  # one skill may be said twice, in both spellings
        assert ("spring boot" in words) == ("spring_boot" in words)
    none = spark.range(3).select(seeded.swapped(F.lit("x"), F.array().cast("array<string>"), POOL, F.col("id"))).collect()
    assert [r[0] for r in none] == ["x"] * 3


def test_decoys_depend_on_the_seed_alone(spark):
    terms = spark.createDataFrame(TERMS, "variant string, slug string")
    texts = {i: "\n".join(f"line {i}.{k} of java" for k in range(4 + i % 4)) for i in range(30)}
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in texts.items()] + [(None, "x", "", ""), (99, None, "", "")], "doc int, text string, at string, sources string")
    runs = [sorted(map(tuple, seeded.decoys(docs.repartition(p), "doc", terms, 25, POOL, seed=s).collect())) for p, s in ((1, 5), (6, 5), (3, 6))]
    assert runs[0] == runs[1] != runs[2]
    assert [r[0] for r in runs[0]] == [f"decoy_{i:03d}" for i in range(25)]
    for _, text, (a, b) in runs[0]:
        assert a != b
        own = [texts.get(x, "").splitlines() for x in (a, b)]
        took = [sum(f"line {x}." in line for line in text.splitlines()) for x in (a, b)]
        assert took == [-(-len(own[0]) // 2), len(own[1]) // 2] or "placeholder" in text
    assert [tuple(r) for r in seeded.decoys(docs.limit(0), "doc", terms, 1, POOL).collect()] == [("decoy_000", "decoy_000 placeholder", [])]
    alone = seeded.decoys(docs.where("doc = 6"), "doc", terms, 1, POOL).first()
    assert alone["sources"] == [6, 6]
