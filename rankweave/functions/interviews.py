"""Plans of interviews: questions by level, coverage of requirements, diversity, and refining until enough is covered.

Questions are array<struct<text, category, difficulty, mapped>>, requirements array<string>; a session is a row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.guardrails import let

# Questions of each kind by level, the share of requirements to be covered, and how often a plan is refined.
SENIOR = {"technical": 3, "system_design": 3, "project_deep_dive": 2, "behavioral": 2}
OTHERS = {"technical": 4, "problem_solving": 2, "behavioral": 2, "project_deep_dive": 1}
ENOUGH, REFINED = 0.8, 3
#: Kinds that a plan must have, and questions of a kind at most.
KINDS, OF_KIND = 3, 5
QUESTIONS = "array<struct<text:string,category:string,difficulty:string,mapped:string>>"


def distribution(seniority: Column) -> Column:
    """How many questions of each kind (a map): more design for senior, lead and principal levels. A null level is a middle one."""
    kinds = lambda of: F.create_map(*(F.lit(x) for pair in of.items() for x in pair))
    return F.when(F.lower(F.coalesce(seniority, F.lit("mid"))).rlike("senior|lead|principal"), kinds(SENIOR)).otherwise(kinds(OTHERS))


def coverage(questions: Column, requirements: Column, enough: float = ENOUGH) -> Column:
    """struct<missing, ratio, passed>: a requirement is covered by a question that is mapped to it, to a part of it or to something that it is part of.
    Case and outer space do not count; without requirements all is covered. A question that is mapped to nothing covers everything."""
    tidy = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    mapped = F.transform(F.coalesce(questions, F.array().cast(QUESTIONS)), lambda q: tidy(q["mapped"]))
    asked = F.coalesce(requirements, F.array().cast("array<string>"))

    def found(m: Column) -> Column:
        hit = lambda r: F.exists(m, lambda x: F.contains(x, tidy(r)) | F.contains(tidy(r), x))
        missing = F.filter(asked, lambda r: ~hit(r))
        ratio = F.size(F.array_distinct(F.filter(asked, hit))) / F.greatest(F.size(asked), F.lit(1))
        none = F.size(asked) == 0
        return F.struct(missing.alias("missing"), F.when(none, 1.0).otherwise(F.bround(ratio, 2)).alias("ratio"), (none | (ratio >= enough)).alias("passed"))

    return let(mapped, found)


def diverse(questions: Column) -> Column:
    """The questions with each text once (case and outer space aside, blank ones left out) and at most five of a kind, kind by kind in the order of their first
    questions; null if they are of fewer than three kinds. A question without a kind is technical, but does not count as one."""
    text = lambda q: F.lower(F.trim(F.coalesce(q["text"], F.lit(""))))
    kind = lambda q: F.coalesce(q["category"], F.lit("technical"))
    once = let(F.transform(questions, text), lambda t: F.filter(questions, lambda q, i: (text(q) != "") & (F.array_position(t, text(q)) == i + 1)))

    def balanced(qs: Column) -> Column:
        said = F.size(F.array_distinct(F.filter(F.transform(qs, lambda q: q["category"]), lambda c: F.coalesce(c, F.lit("")) != "")))
        of = F.transform(F.array_distinct(F.transform(qs, kind)), lambda k: F.slice(F.filter(qs, lambda q: kind(q) == k), 1, OF_KIND))
        return F.when(F.size(questions) == 0, questions).when(said >= KINDS, F.flatten(of))

    return let(once, balanced)


def planned(questions: Column, requirements: Column, enough: float = ENOUGH, rounds: int = REFINED) -> Column:
    """struct<questions, missing, ratio, passed>: the questions, refined until enough is covered or so often: each round asks for what is missing, then
    makes the plan diverse if it has enough kinds. Null questions count as none."""
    said = lambda r: F.concat(F.lit("Could you walk through how you work with "), r, F.lit(" and handle common edge cases?"))
    ask = lambda r: F.struct(said(r).alias("text"), F.lit("technical").alias("category"), F.lit("medium").alias("difficulty"), r.alias("mapped"))

    def refine(qs: Column, missing: Column) -> Column:
        return let(F.concat(qs, F.transform(missing, ask)).cast(QUESTIONS), lambda every: F.coalesce(diverse(every), every))

    step = lambda qs, _: let(coverage(qs, requirements, enough), lambda v: F.when(v["passed"], qs).otherwise(refine(qs, v["missing"])))
    start = F.coalesce(questions, F.array().cast(QUESTIONS)).cast(QUESTIONS)
    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return let(done, lambda qs: let(coverage(qs, requirements, enough), lambda v: F.struct(qs.alias("questions"), v["missing"].alias("missing"), v["ratio"].alias("ratio"), v["passed"].alias("passed"))))
