"""Claims against evidence: skill levels, skill records, evidence rows, repositories, quality of a profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions import guardrails
from rankweave.operators import skills
from rankweave.sources.tables import dealt

# Verbs of use.
ACTIONS = "xây dựng|thiết kế|tối ưu|triển khai|phát triển|tích hợp|xử lý|build|design|optimize|implement|develop|integrate|refactor".split("|")
# Bands of a repository's stars with the scores of completeness, optimisation and cleanliness, and the languages in wide use.
STARS = [(1000, 8.0, 7.5, 7.5), (100, 7.0, 6.5, 6.5), (10, 5.5, 5.5, 5.5)]
WIDE = ["python", "typescript", "javascript", "go", "rust", "java"]
LEVELS = [("junior", 1), ("middle", 2), ("senior", 3), ("lead", 4), ("principal", 5), ("manager", 4)]

PROJECT = "array<struct<description:string,technologies:array<string>,metrics:array<string>,depth:double>>"


def claim_level(skill: Column, projects: Column) -> Column:
    """How well projects show a claimed skill: 0 in none, 0.25 named, 0.7 in a sentence with a verb of use, 1 beside metrics or depth.

    projects: an array of PROJECT's structs.
    """
    s = F.lower(F.trim(skill))
    said = lambda p: F.contains(F.lower(F.coalesce(p["description"], F.lit(""))), s)
    met = F.filter(projects, lambda p: said(p) | F.exists(F.coalesce(p["technologies"], F.array().cast("array<string>")), lambda t: F.lower(t) == s))
    strong = F.exists(met, lambda p: said(p) & ((F.size(p["metrics"]) > 0) | (p["depth"] >= 60.0)))
    verb = lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(v)) for v in ACTIONS))
    used = F.exists(met, lambda p: F.exists(F.split(F.lower(F.coalesce(p["description"], F.lit(""))), r"[.\n;]+"), lambda x: F.contains(x, s) & verb(x)))
    return F.when(F.size(met) == 0, 0.0).when(strong, 1.0).when(used, 0.7).otherwise(0.25)


def claim_levels(skills: Column, projects: Column) -> Column:
    """(skill, level) of each claimed skill."""
    return F.transform(skills, lambda s: F.struct(F.trim(s).alias("skill"), claim_level(s, projects).alias("level")))


def skill_records(extracted: Column, body: Column) -> dict[str, Column]:
    """Skills, each once, as records verified or inferred: verified ones are still named in the body (`` name `` in its matched form)."""
    names = F.array_distinct(F.filter(extracted, lambda s: s.isNotNull() & (s != "")))
    there = lambda s: F.contains(F.concat(F.lit(" "), body, F.lit(" ")), F.concat(F.lit(" "), s, F.lit(" ")))
    records = F.transform(names, lambda s: F.struct(s.alias("skill"), F.when(there(s), "verified").otherwise("inferred").alias("source")))
    of = lambda kind: F.transform(F.filter(records, lambda r: r["source"] == kind), lambda r: r["skill"])
    return {"records": records, "verified": of("verified"), "inferred": of("inferred")}


def inferred_rate(verified: Column, inferred: Column) -> Column:
    """The share of inferred skills among all."""
    union = F.size(F.array_union(verified, inferred))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_except(inferred, verified)) / union)


def gap(owned: Column, wanted: Column) -> dict[str, Column]:
    """Wanted skills that are missing and that are matched, case aside."""
    low = F.transform(owned, lambda s: F.lower(s))
    return {"missing": F.filter(wanted, lambda s: ~F.array_contains(low, F.lower(s))), "matched": F.filter(wanted, lambda s: F.array_contains(low, F.lower(s)))}


def major_of(rows: DataFrame, key: str, skills: str, majors: DataFrame) -> DataFrame:
    """(key, major, overlap): the major whose markers a row's skills meet most, the first in the table's order on a tie; none without one.

    majors: a small dimension table (place, major, marker).
    """
    met = rows.select(key, F.explode(F.array_distinct(skills)).alias("marker")).join(F.broadcast(majors), "marker")
    counted = met.groupBy(key, "major").agg(F.countDistinct("marker").alias("overlap"), F.min("place").alias("place"))
    best = counted.groupBy(key).agg(F.min(F.struct((-F.col("overlap")).alias("n"), "place", "major")).alias("b"))
    return best.select(key, F.col("b.major").alias("major"), (-F.col("b.n")).alias("overlap"))


def match_evidence(ranked: DataFrame, terms: DataFrame, most_related: int = 8) -> DataFrame:
    """Evidence rows of a run: ranked rows (query, doc, place, skills, ..) with the skills' siblings that the row doesn't have.

    terms: a small dimension table (slug, category); a skill's siblings are the first ones of its category by name.
    """
    a = terms.select("slug", "category").distinct()
    pairs = a.join(a.withColumnRenamed("slug", "other"), "category").where("slug <> other")
    near = pairs.groupBy("slug").agg(F.slice(F.array_sort(F.collect_set("other")), 1, most_related).alias("near"))
    found = ranked.select("query", "doc", F.col("skills").alias("_own"), F.explode("skills").alias("slug")).join(F.broadcast(near), "slug")
    flat = found.groupBy("query", "doc").agg(F.flatten(F.collect_list("near")).alias("_near"), F.first("_own").alias("_own"))
    related = flat.select("query", "doc", F.array_sort(F.array_except(F.array_distinct("_near"), "_own")).alias("related"))
    return ranked.join(related, ["query", "doc"], "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))


def recommend_evidence(ranked: DataFrame) -> DataFrame:
    """Evidence rows of a recommendation: the first ten skills of each ranked row, and no related ones; rows without a doc are left out."""
    return ranked.where("doc is not null").withColumns({"skills": F.slice("skills", 1, 10), "related": F.array().cast("array<string>")})


def progressed(titles: Column, shown: Column) -> Column:
    """True where titles, in order, end on a higher level than they begin and two years are shown."""
    level = lambda t: F.flatten(F.array(*(F.when(F.contains(F.lower(t), F.lit(k)), F.array(F.lit(n))).otherwise(F.array().cast("array<int>")) for k, n in LEVELS)))
    levels = F.flatten(F.transform(titles, level))
    return (F.size(titles) > 1) & (shown >= 2.0) & (F.size(levels) >= 2) & (F.try_element_at(levels, F.lit(-1)) > F.try_element_at(levels, F.lit(1)))


def repository_score(stars: Column, readme: Column, language: Column) -> dict[str, Column]:
    """Scores of a repository from its surface, and their weighted sum."""
    band = lambda k, rest: reduce(lambda c, b: c.when(stars > b[0], b[k]), STARS, F.when(F.lit(False), 0.0)).otherwise(rest)
    complete = F.when(stars > 1000, 8.0).when(stars > 100, 7.0).when(readme, 7.5).when(stars > 10, 5.5).otherwise(3.0)
    complexity = F.when(F.lower(language).isin(WIDE), 6.5).when(F.coalesce(language, F.lit("")) != "", 5.5).otherwise(4.0)
    best, clean = band(2, 4.0), band(3, 4.0)
    overall = F.round(0.25 * complete + 0.15 * complexity + 0.20 * best + 0.25 * clean + 0.15 * 5.0, 1)
    return {"completeness": complete, "complexity": complexity, "optimization": best, "cleanliness": clean, "overall": overall}


def tier1(files: DataFrame, repo: str, path: str, readmes: DataFrame) -> DataFrame:
    """A repository's surface: counts and shares of tests and documents, continuous integration, containers, submodules, kinds of files,
    the readme's length and a score of 0 to 10. readmes: (repo, length)."""
    p = F.lower(F.col(path))
    test, doc = F.contains(p, F.lit("test")) | F.contains(p, F.lit("spec")), reduce(lambda a, b: a | b, (F.contains(p, F.lit(x)) for x in ("readme", "doc", ".md", ".rst")))
    any_of = lambda words, of: F.coalesce(F.bool_or(reduce(lambda a, b: a | b, (F.contains(of, F.lit(x)) for x in words))), F.lit(False))
    kinds = F.when(F.contains(p, F.lit(".")), F.substring_index(p, ".", -1))
    by = files.groupBy(F.col(repo).alias("repo")).agg(
        F.count("*").alias("files"), F.count_if(test).alias("tests"), F.count_if(doc).alias("docs"), any_of([".github/workflows", ".gitlab-ci", "circleci"], F.col(path)).alias("has_ci"),
        any_of(["dockerfile", "docker-compose"], p).alias("has_docker"), F.countDistinct(kinds).alias("kinds"), F.coalesce(F.bool_or(F.col(path) == ".gitmodules"), F.lit(False)).alias("has_submodules"),
    )
    out = by.join(readmes, "repo", "left").withColumn("readme", F.coalesce("length", F.lit(0))).drop("length")
    share = F.col("tests") / F.greatest("files", F.lit(1))
    score = 2.0 + F.when(F.col("files") >= 5, 2.0).otherwise(0.0) + F.when(share >= 0.1, 2.0).otherwise(0.0) + F.when(F.col("readme") > 200, 1.5).otherwise(0.0) + F.when(F.col("has_ci"), 1.5).otherwise(0.0) + F.when(F.col("has_docker"), 1.0).otherwise(0.0)
    return out.withColumns({"test_ratio": F.round(share, 3), "doc_ratio": F.round(F.col("docs") / F.greatest("files", F.lit(1)), 3), "score": F.round(F.least(score, F.lit(10.0)), 2)})


def slugged(c: Column) -> Column:
    """A name in lower case without punctuation, its words joined by dashes."""
    bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[-\s_]+", "-"), "^-+|-+$", "")


def matched_repositories(repos: DataFrame, projects: DataFrame, owner: str) -> DataFrame:
    """(owner, repo, project, rule): each repository with the first project (by place) of the same owner that it matches.

    repos: (owner, repo, description), projects: (owner, place, title, description). Rules: 1 one slug holds the other; 2 two words of
    three letters in common, or the title's only one; 3 three words of four letters in common between the descriptions. Pairs are those of
    one owner, whose projects are few.
    """
    words = lambda c, least: F.array_distinct(F.filter(F.split(c, r"[\s_-]+"), lambda w: F.length(w) >= least))
    long = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b[a-z]{4,}\b"), F.lit(0)))
    a = repos.select(owner, "repo", F.col("description").alias("_rd"), slugged(F.col("repo")).alias("_rs"))
    b = projects.select(owner, "place", "title", F.col("description").alias("_pd"), slugged(F.col("title")).alias("_ps"))
    both = a.join(b, owner)
    one = (F.col("_rs") != "") & (F.col("_ps") != "") & (F.contains("_rs", F.col("_ps")) | F.contains("_ps", F.col("_rs")))
    titled = words(F.col("_ps"), 3)
    common = F.size(F.array_intersect(titled, words(F.col("_rs"), 3)))
    two = (common >= 2) | ((F.size(titled) == 1) & (common == 1))
    three = (F.length("_rd") > 10) & (F.size(F.array_intersect(long(F.col("_rd")), long(F.col("_pd")))) >= 3)
    hit = both.withColumn("rule", F.when(one, 1).when(two, 2).when(three, 3)).where("rule is not null")
    first = hit.groupBy(owner, "repo").agg(F.min(F.struct("place", F.col("title").alias("project"), "rule")).alias("b"))
    return first.select(owner, "repo", "b.project", "b.rule")


def quality(skills: Column, titles: Column, source: Column) -> Column:
    """standard for a profile with a skill, or with titles and a text of a hundred characters, else insufficient."""
    return F.when((F.size(skills) > 0) | ((F.size(titles) > 0) & (F.length(F.trim(source)) >= 100)), "standard").otherwise("insufficient")


def overall(scores: dict[str, tuple[Column, float]], penalty: Column) -> Column:
    """The weighted sum of scores, cut by a penalty, at least 0, to one decimal."""
    total = reduce(lambda a, b: a + b, (s * w for s, w in scores.values()))
    return F.round(F.greatest(F.when(penalty > 0, total * (1.0 - penalty)).otherwise(total), F.lit(0.0)), 1)


def confidence(parts: list[Column], missing: list[Column]) -> Column:
    """The mean of confidences, with 0.3 for each side that is missing."""
    every = F.array_compact(F.array(*parts, *(F.when(m, F.lit(0.3)) for m in missing)))
    return F.round(F.aggregate(every, F.lit(0.0), lambda a, x: a + x) / F.size(every), 2)


def judged(skills: Column, wrong: Column, missed: Column) -> dict[str, Column]:
    """Precision and recall of a skill list from what a judge calls wrong and missed; null where there is nothing to divide by."""
    n, correct = F.size(skills), F.greatest(F.size(skills) - F.size(wrong), F.lit(0))
    return {"precision": F.when(n > 0, F.round(correct / n, 3)), "recall": F.when(correct + F.size(missed) > 0, F.round(correct / (correct + F.size(missed)), 3))}


def gated_records(rows: DataFrame, group: str, item: str, allowed: DataFrame, most: int) -> DataFrame:
    """(group, action, code, n): whether a group's records all have an allowed id, none twice, and are no more than most.

    A group's equal ids are counted first, dealt by both, so that no task holds more than its small share of them.
    """
    known = allowed.select(F.col(item)).distinct().withColumn("_known", F.lit(True))
    pairs = dealt(rows.select(group, item).join(known, item, "left"), group, item).groupBy(group, item).agg(F.count("*").alias("_n"), F.max("_known").alias("_known"))
    by = pairs.groupBy(group).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_known").isNull(), F.col("_n")).otherwise(0)).alias("_bad"), F.count(item).alias("_ids"))
    bad = (F.col("_bad") > 0) | (F.col("_ids") < F.col("n"))
    action = F.when(bad, "block").when(F.col("n") > most, "degrade").otherwise("pass")
    code = F.when(bad, "DATA_SCOPE_MISMATCH").when(F.col("n") > most, "DATA_BUDGET_EXCEEDED")
    return by.select(group, action.alias("action"), code.alias("code"), F.when(bad, 0).otherwise(F.least("n", F.lit(most))).alias("n"))


def enough_evidence(items: Column, least: int = 1) -> Column:
    """pass for an array with so many parts that aren't blank, else degrade."""
    return F.when(F.size(F.filter(items, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")) >= least, "pass").otherwise("degrade")


def gold_metrics(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """(query, rank, p.., ndcg.., cp..): the rank of each query's one gold document, and what it gives at each k; rows (query, doc, place)."""
    found = ranked.join(gold, ["query", "doc"]).select("query", F.col("place").alias("rank"))
    out = found
    for k in ks:
        inside = F.col("rank") <= k
        out = out.withColumns({f"p{k}": F.when(inside, 1.0).otherwise(0.0), f"ndcg{k}": F.when(inside, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0), f"cp{k}": F.when(inside, 1.0 / F.col("rank")).otherwise(0.0)})
    return out


def worst(rows: DataFrame, rank: str, key: str, text: str, n: int = 20) -> DataFrame:
    """The n rows (a report) of the highest rank, ties by key, with 200 characters of their text shown."""
    return rows.orderBy(F.desc(rank), key).limit(n).withColumn(text, F.substring(F.coalesce(text, F.lit("")), 1, 200))


def dense_input_problems(vector: Column, model: Column, wanted_model: str, dim: int) -> Column:
    """True for a row whose vector can't be compared: another model's, of another length, or none."""
    return vector.isNull() | F.coalesce(model != wanted_model, F.lit(True)) | (F.size(vector) != dim)



def ingest_record(docs: DataFrame, key: str, text_col: str, summary_col: str, terms: DataFrame, vectors: DataFrame) -> DataFrame:
    """A row for each document with what its ingest has to report: chars and words of its text, marks left where personal data was, skills that the summary
    names (production_count), that the text names (full_count), lost and gained between them, recall (null without a skill in the text), the summary's
    chars and whether it is blank, its vector's dim and norm.

    terms: the taxonomy, a small table; vectors: (key, embedding), one row a key. Null texts count as empty; a key is one document; an empty table gives no rows.
    """
    rows = docs.select(key, F.coalesce(text_col, F.lit("")).alias("_text"), F.coalesce(summary_col, F.lit("")).alias("_summary"))
    slugs = lambda c, name: skills.extract(rows, terms, key, c).groupBy(F.col("doc").alias(key)).agg(F.collect_set("slug").alias(name))
    none = F.array().cast("array<string>")
    rows = rows.join(slugs("_text", "_full"), key, "left").join(slugs("_summary", "_own"), key, "left").join(vectors, key, "left")
    rows = rows.withColumns({"_full": F.coalesce("_full", none), "_own": F.coalesce("_own", none)})
    body = guardrails.let(guardrails.normalized(F.col("_text")), guardrails.sanitized)["value"]
    count = lambda c: F.size(c).cast("long")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.select(
        key, F.length("_text").cast("long").alias("chars"), F.regexp_count("_text", F.lit(r"\S+")).cast("long").alias("words"), F.regexp_count(body, F.lit(r"\[REDACTED_[A-Z]+\]")).cast("long").alias("redacted"),
        count("_own").alias("production_count"), count("_full").alias("full_count"), count(F.array_except("_full", "_own")).alias("lost"), count(F.array_except("_own", "_full")).alias("gained"),
        F.when(F.size("_full") > 0, F.round(F.size("_own") / F.size("_full"), 3)).alias("recall"), F.length("_summary").cast("long").alias("summary_chars"), (F.trim("_summary") == "").alias("summary_empty"),
        F.coalesce(F.size("embedding"), F.lit(0)).cast("long").alias("dim"), F.round(norm, 4).alias("norm"),
    )
