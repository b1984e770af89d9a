"""Profile and job texts as rows: sections, dates, projects, constraints, validation of ranked output, comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import text
from rankweave.operators import skills
from rankweave.sources.tables import dealt

# What a sentence says about the skills that it names, and what makes them alternatives.
MUST = ["bat buoc", "required", "must have", "must-have"]
PREFERRED = ["diem cong", "nice to have", "nice-to-have", "preferred", "plus"]
MENTIONED = ["dang chuyen", "team", "not required", "khong bat buoc", "khong yeu cau"]
ALTERNATIVE = [" hoac ", " or ", " either "]


def any_of(text: Column, hints: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(h) for h in hints))


def sections(docs: DataFrame, doc_id: str, text_col: str, heading: str = r"^#+ (.+)$") -> DataFrame:
    """(doc, line, section, text): each line that isn't a heading under the last heading above it ('' before the first)."""
    lines = docs.select(F.col(doc_id).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("line", "text"))
    named = lines.withColumn("head", F.when(F.col("text").rlike(heading), F.regexp_extract("text", heading, 1)))
    above = F.last("head", ignorenulls=True).over(Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return named.withColumn("section", F.coalesce(above, F.lit(""))).where("head is null").select("doc", "line", "section", "text")


def parse_date(text: Column) -> Column:
    """A date from d/m/y (m/d/y where only that is one), m/y, Mon yyyy or yyyy; null for anything else."""
    t = F.trim(text)
    parts = lambda p: [F.try_to_timestamp(F.regexp_extract(t, p, 0), F.lit(f)).cast("date") for f in ("d/M/yyyy", "M/d/yyyy")]
    full = F.when(t.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.coalesce(*parts(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$")))
    month = F.when(t.rlike(r"^[0-9]{1,2}/[0-9]{4}$"), F.try_to_timestamp(F.concat(F.lit("1/"), t), F.lit("d/M/yyyy")).cast("date"))
    named = F.when(t.rlike(r"^[A-Za-z]{3} [0-9]{4}$"), F.try_to_timestamp(F.concat(F.lit("1 "), F.initcap(t)), F.lit("d MMM yyyy")).cast("date"))
    year = F.when(t.rlike(r"^[0-9]{4}$"), F.make_date(t.cast("int"), F.lit(1), F.lit(1)))
    return F.coalesce(full, month, named, year)


def duration_months(text: Column) -> Column:
    """Months in `2 years 3 months`; null where neither is said."""
    years, months = F.regexp_extract(F.lower(text), r"([0-9]+) *(?:year|yr)", 1), F.regexp_extract(F.lower(text), r"([0-9]+) *(?:month|mo)", 1)
    number = lambda s: F.when(s != "", s.cast("int")).otherwise(0)
    return F.when((years != "") | (months != ""), number(years) * 12 + number(months))


def seniority(years: Column) -> Column:
    return F.when(years.isNull(), "unknown").when(years < 1, "intern").when(years < 3, "junior").when(years < 5, "mid").otherwise("senior")


def proposed_constraints(docs: DataFrame, doc_id: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(doc, slug, kind, group): the skills of a text by the hint of the sentence that names them: must, else preferred, else mentioned.

    Sentences without a hint propose nothing. A must sentence with alternatives makes one group of its skills, others one group each;
    a skill counts once a kind, for its first sentence, and is no preference once it is a must before, no mention once it is either.
    """
    sentence = docs.select(F.col(doc_id).alias("doc"), F.posexplode(F.split(text_col, r"[.!?\n]+")).alias("at", "said"))
    folded = F.concat(F.lit(" "), text.matched(F.col("said")), F.lit(" "))
    order = F.when(any_of(F.col("view"), MUST), 0).when(any_of(F.col("view"), PREFERRED), 1).when(any_of(F.col("view"), MENTIONED), 2)
    hinted = sentence.select("doc", "at", folded.alias("view")).withColumn("order", order).where("order is not null")
    named = skills.found(hinted, "view", terms, ["doc", "at", "order", "view"])
    w = Window.partitionBy("doc", "slug").orderBy("at", "order")
    seen = F.min("order").over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = named.withColumn("before", seen).where(F.col("before").isNull() | (F.col("order") < F.col("before")))
    kind = F.element_at(F.array(F.lit("must"), F.lit("preferred"), F.lit("mentioned")), F.col("order") + 1)
    group = F.when((F.col("order") == 0) & any_of(F.col("view"), ALTERNATIVE), F.concat(F.lit("s"), F.col("at").cast("string"))).otherwise(F.col("slug"))
    return first.select("doc", "slug", kind.alias("kind"), group.alias("group"))


def argmax_votes(votes: DataFrame, key: str, label: str, weight: str, order: str) -> DataFrame:
    """The label with the most weight for each key; ties go to the label that comes first by order."""
    total = votes.groupBy(key, label).agg(F.sum(weight).alias("w"), F.min(order).alias("o"))
    best = total.groupBy(key).agg(F.min(F.struct((-F.col("w")).alias("m"), "o", F.col(label).alias("label"))).alias("b"))
    return best.select(key, F.col("b.label").alias(label), (-F.col("b.m")).alias("weight"))


def ranked_problems(ranked: DataFrame, allowed: DataFrame, query: str, doc: str, place: str, score: str, status_rank: str) -> DataFrame:
    """What is wrong with a ranked output: unknown documents, repeated ones, scores that are no numbers, and groups out of order."""
    w = Window.partitionBy(query).orderBy(place)
    rows = dealt(ranked.join(allowed.select(F.col(doc)).distinct().withColumn("_known", F.lit(True)), doc, "left"), query)
    rows = rows.withColumns({"_back": F.lag(status_rank).over(w) > F.col(status_rank), "_again": F.row_number().over(Window.partitionBy(query, doc).orderBy(place)) > 1})
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    problems = F.array_compact(F.array(F.when(F.col("_known").isNull(), "unknown"), F.when(F.col("_again"), "repeated"), F.when(~finite, "score"), F.when(F.col("_back"), "order")))
    return rows.select(query, doc, place, F.explode(problems).alias("problem"))


def requirement_coverage(questions: DataFrame, requirements: DataFrame, least: float = 0.8) -> DataFrame:
    """(covered, all, ratio, enough): requirements that share a word with some question; both tables are token rows (id, word)."""
    met = requirements.join(questions.select("word").distinct(), "word", "left_semi").select("id").distinct().agg(F.count("*").alias("covered"))
    every = requirements.select("id").distinct().agg(F.count("*").alias("all"))
    return met.crossJoin(every).withColumn("ratio", F.when(F.col("all") == 0, 1.0).otherwise(F.col("covered") / F.col("all"))).withColumn("enough", F.col("ratio") >= least)


def depth_score(hits: Column, metrics: Column, skills: Column, length: Column, template: Column) -> Column:
    """A project's depth from 0 to 100."""
    s = 30 - F.when(template, 15).otherwise(0) + F.least(hits * 8, F.lit(35)) + F.least(metrics * 10, F.lit(25)) + F.when(skills >= 6, 15).when(skills >= 3, 10).otherwise(0) - F.when(length < 60, 20).otherwise(0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), s.cast("double"))), 1)


def experience_score(shown: Column, asked: Column, claimed: Column, progressed: Column) -> Column:
    ratio = F.when(asked > 0, F.least(F.lit(100.0), F.least(shown / asked, F.lit(1.5)) * 70)).when(shown > 0, F.least(shown * 10.0, F.lit(100.0))).otherwise(30.0)
    gap = F.when(claimed >= 3, (claimed - shown) / claimed).otherwise(0.0)
    kept = F.when(gap > 0.6, F.least(ratio * 0.3, F.lit(25.0))).otherwise(ratio)
    return F.least(F.lit(100.0), kept + F.when(progressed, 10.0).otherwise(0.0))


#: What shows years of experience and a degree in a profile's text, and the most profiles of one comparison.
YEARS, DEGREE, COMPARED = r"(?iu)\b([2-9]|1[0-5])\s*(năm|years?)\b", r"(?iu)(đại học|cử nhân|thạc sĩ|kỹ sư|bachelor|master|university)", 5


def contained(skill: Column, wanted: Column) -> Column:
    """True for a skill that holds, or is held by, one of the wanted ones, case aside."""
    return F.exists(wanted, lambda w: F.contains(F.lower(skill), F.lower(w)) | F.contains(F.lower(w), F.lower(skill)))


def comparison(rows: DataFrame, group: str, key: str, skills_col: str, asked: str, text_col: str) -> DataFrame:
    """Each compared profile with its matched skills, four scores of 0 to 10, their total and its rank within the group.

    rows: one a profile, group: its comparison, key: the order in which profiles were asked for. The rules of a comparison without a
    model: skills by share of the wanted ones, experience by years said and order, education by a degree.
    """
    real = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != ""))
    own, wanted = real(F.col(skills_col)), real(F.col(asked))
    hint = F.row_number().over(Window.partitionBy(group).orderBy(key))
    out = rows.withColumns({"_hint": hint, "_own": own, "_wanted": wanted}).withColumn("matched", F.filter("_own", lambda s: contained(s, F.col("_wanted"))))
    bound = lambda c, low: F.least(F.lit(9.5), F.greatest(F.lit(low), F.round(c, 1)))
    t = F.coalesce(text_col, F.lit(""))
    skill = F.when(F.size("_wanted") == 0, 7.5).otherwise(bound(4.0 + F.size("matched") / F.greatest(F.size("_wanted"), F.lit(1)) * 5.5, 3.5))
    out = out.withColumns({
        "skills": skill, "experience": bound(6.0 + F.when(t.rlike(YEARS), 1.5).otherwise(0.5) + F.col("_hint") * 0.2, 4.0),
        "education": bound(7.0 + F.when(t.rlike(DEGREE), 1.5).otherwise(0.5), 5.0),
    })
    out = out.withColumn("overall", F.round(0.35 * F.col("skills") + 0.35 * F.col("experience") + 0.30 * F.col("education"), 1))
    out = out.withColumn("total", F.round(F.col("skills") + F.col("experience") + F.col("education") + F.col("overall"), 1))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("total"), F.desc("overall"), "_hint"))
    return out.withColumn("place", place).select(group, key, "matched", "skills", "experience", "education", "overall", "total", "place")


def repositories(text: Column) -> Column:
    """Distinct owner/name of code repositories linked in a text; reserved first segments are no owners."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"github\.com/([a-z0-9-]+/[a-z0-9_.-]+)"), F.lit(1))
    owner = lambda r: F.substring_index(r, "/", 1)
    return F.array_distinct(F.filter(F.transform(found, lambda r: F.regexp_replace(r, r"(\.git)?[.]*$", "")), lambda r: ~owner(r).isin("features", "about", "topics", "orgs", "settings")))


def dropped_subsets(items: Column, least: int, most: int) -> Column:
    """Index lists of all ways to leave between `least` and `most` of up to 12 items out."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size(items)).cast("int") - 1)
    some = F.filter(masks, lambda m: F.bit_count(m).between(least, most))
    places = F.sequence(F.lit(0), F.size(items) - 1)
    return F.when(F.size(items).between(1, 12), F.transform(some, lambda m: F.filter(places, lambda i: F.getbit(m, i) == 1))).otherwise(F.array().cast("array<array<int>>"))


def roadmap(missing: Column, prerequisites: Column) -> Column:
    """Three phases: prerequisites of what is missing, the first three missing skills, the others."""
    known = F.filter(F.transform(missing, lambda s: F.element_at(prerequisites, s)), lambda p: p.isNotNull())
    return F.struct(F.array_distinct(F.flatten(known)).alias("foundation"), F.slice(missing, 1, 3).alias("core"), F.slice(missing, 4, 100).alias("later"))


def default_flags(rows: DataFrame, user: str, key: str, wanted: str, *order: Column) -> DataFrame:
    """Exactly one default row a user: the one asked for, else by order."""
    n = F.row_number().over(Window.partitionBy(user).orderBy(F.col(wanted).desc(), *order, F.col(key)))
    return rows.withColumn("is_default", n == 1)


def guarded(old: DataFrame, new: DataFrame, key: str, column: str, role: str) -> DataFrame:
    """Updates that change a guarded column without the admin's role."""
    both = new.join(old.select(key, F.col(column).alias("_was")), key)
    return both.where(~F.col(column).eqNullSafe(F.col("_was")) & ~F.col(role).eqNullSafe(F.lit("admin"))).drop("_was")


def anonymized(rows: DataFrame, group: list[str], identity: list[str], *order: Column, prefix: str = "CAND_") -> tuple[DataFrame, DataFrame]:
    """(rows without their identity, names): each list's rows under running aliases, and the table that restores them.

    A list is a group: its rows are numbered in the given order, as a reader sees them.
    """
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    named = rows.withColumn("alias", F.concat(F.lit(prefix), F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), F.lit("0"))))
    return named.drop(*identity), named.select(*group, "alias", *identity)


def restored(said: DataFrame, names: DataFrame, group: list[str]) -> DataFrame:
    """said with the identity behind each alias; an alias that nobody has keeps its row, without one."""
    return said.join(names, [*group, "alias"], "left")


def readable(said: Column) -> Column:
    """A text with aliases read out: candidate #7 for CAND_007, position #7 for JOB_007."""
    return F.regexp_replace(F.regexp_replace(said, r"\bCAND_0*([1-9][0-9]*)\b", "candidate #$1"), r"\bJOB_0*([1-9][0-9]*)\b", "position #$1")


def listed(words: str, texts: list[Column], kinds: dict[str, list], *tests: Column) -> Column:
    """Whether a row is shown: one of its texts holds the words (case aside), its kinds are among those asked for, and all tests hold."""
    ok = reduce(lambda a, b: a | b, (F.contains(F.lower(t), F.lit(words.lower())) for t in texts)) if words else F.lit(True)
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), [*(F.col(k).isin(v) for k, v in kinds.items() if v), *tests], ok)
