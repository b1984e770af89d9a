"""Interview plans against a loop over dictionaries, and odd rows."""

import random

from pyspark.sql import functions as F

from rankweave.functions import interviews


def covered(questions, requirements):
    hits = {r for r in requirements for q in questions if r.strip().lower() in (m := (q["mapped"] or "").strip().lower()) or m in r.strip().lower()}
    return [r for r in requirements if r not in hits], len(hits) / len(requirements) if requirements else 1.0


def diverse(questions):
    seen, unique = set(), []
    for q in questions:
        t = (q["text"] or "").strip().lower()
        if t and t not in seen:
            seen.add(t)
            unique.append(q)
    if questions and len({q["category"] for q in unique if q["category"]}) < 3:
        return None
    kinds = {}
    for q in unique:
        kinds.setdefault(q["category"] if q["category"] is not None else "technical", []).append(q)
    return [q for of in kinds.values() for q in of[:5]]


def by_loop(questions, requirements):
    for _ in range(3):
        missing, ratio = covered(questions, requirements)
        if ratio >= 0.8:
            break
        every = questions + [{"text": f"Could you walk through how you work with {r} and handle common edge cases?", "category": "technical", "difficulty": "medium", "mapped": r} for r in missing]
        fits = diverse(every)
        questions = every if fits is None else fits
    missing, ratio = covered(questions, requirements)
    return [q["text"] for q in questions], missing, ratio >= 0.8


def test_plans_equal_a_loop(spark):
    rng, rows = random.Random(3), []
    for i in range(80):
        qs = [{"text": rng.choice(["How?", "how? ", "Why", "What", "", None, f"q{rng.randint(0, 9)}"]), "category": rng.choice(["technical", "behavioral", "design", "other", None, "technical"]), "difficulty": "easy", "mapped": rng.choice(["go", "Kafka streams", "sql", "x"])} for _ in range(rng.randint(0, 12))]
        rows.append((i, qs, [rng.choice(["Go", "kafka", "SQL ", "rust", "scala", "c", "d", "e"]) for _ in range(rng.randint(0, 8))]))
    df = spark.createDataFrame([(i, [(q["text"], q["category"], q["difficulty"], q["mapped"]) for q in qs], rs) for i, qs, rs in rows], f"i int, q {interviews.QUESTIONS}, r array<string>")
    got = {r["i"]: r["p"] for r in df.select("i", interviews.planned(F.col("q"), F.col("r")).alias("p")).collect()}
    for i, qs, rs in rows:
        texts, missing, passed = by_loop(qs, rs)
        assert [q["text"] for q in got[i]["questions"]] == texts and got[i]["missing"] == missing and got[i]["passed"] == passed, i


def test_odd_plans(spark):
    row = spark.range(1).select(
        interviews.planned(F.lit(None).cast(interviews.QUESTIONS), F.lit(None).cast("array<string>")).alias("none"), interviews.planned(F.lit(None).cast(interviews.QUESTIONS), F.array(F.lit("a"), F.lit("b"))).alias("asked"),
        interviews.distribution(F.lit("Tech LEAD")).alias("lead"), interviews.distribution(F.lit(None).cast("string")).alias("mid"),
    ).first()
    assert (row["none"]["questions"], row["none"]["ratio"], row["none"]["passed"]) == ([], 1.0, True)
    assert [q["mapped"] for q in row["asked"]["questions"]] == ["a", "b"] and row["asked"]["ratio"] == 1.0
    assert row["lead"] == interviews.SENIOR and row["mid"] == interviews.OTHERS
