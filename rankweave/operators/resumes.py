"""Profile texts as structured rows, Markdown with its metadata, and profile lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions import dates, resumes
from rankweave.functions.guardrails import has_any, let
from rankweave.functions.redaction import without_links, without_person
from rankweave.functions.text import matched
from rankweave.operators import skills
from rankweave.sources.tables import spread

# What in a title or text speaks for a field: pattern, field, part of it, and texts of which all finds of the pattern hold one.
HINTS = [
    (r"front[\s-]*end", "web", "frontend", ["front"]),
    (r"back[\s-]*end", "web", "backend", ["back"]),
    (r"full[\s-]*stack", "web", "backend", ["full"]),
    (r"mobile|android|\bios\b|flutter|react native", "mobile", "mobile", ["mobile", "android", "ios", "flutter", "react native"]),
    (r"devops|site reliability|\bsre\b", "cloud_devops", "devops", ["devops", "site reliability", "sre"]),
    (r"data engineer|data analyst|data science|machine learning|\bml\b|\bai\b", "data", "data_engineering", ["data ", "machine learning", "ml", "ai"]),
    (r"\bqa\b|tester|quality assurance", "qa_testing", "testing", ["qa", "tester", "quality assurance"]),
    (r"security|cybersec", "cybersecurity", "cybersecurity", ["security", "cybersec"]),
    (r"ui/?ux|product designer", "ui_ux", "ui_ux", ["ui/ux", "uiux", "product designer"]),
    (r"\bgame\b|game developer", "game", "game", ["game"]),
    (r"embedded|\biot\b|firmware", "embedded_iot", "embedded_iot", ["embedded", "iot", "firmware"]),
    (r"\bphp\b|laravel|django|spring|nestjs|asp\.net|\.net|golang", "web", "backend", ["php", "laravel", "django", "spring", "nestjs", ".net", "golang"]),
]
#: Letters that patterns take for i, s and k whatever their case, though lower case keeps them or makes more of them.
FOLDING = ["\u0130", "\u0131", "\u017f", "\u212a"]
# The field of a skill's category, and the categories that are parts of fields of their own.
FIELDS = {
    "web": "frontend backend api cms_ecommerce desktop", "mobile": "mobile", "cloud_devops": "cloud aws azure gcp devops containers_orchestration observability", "data": "data_engineering data_analysis",
    "ai_ml": "ai_ml generative_ai mlops", "qa_testing": "testing", "cybersecurity": "cybersecurity", "infrastructure_network": "networking system_infrastructure", "enterprise_software": "enterprise crm_erp",
    "embedded_iot": "embedded_iot", "game": "game", "ui_ux": "ui_ux",
}
PARTS = "frontend backend mobile devops data_engineering data_analysis ai_ml testing cybersecurity ui_ux game embedded_iot".split()
#: Fixed value: characters of a text in which hints are counted.
HINTED = 4000
# Kinds of profile lines by the heading above them, and titles of kinds.
KINDS = {
    "summary": ["profile", "summary", "about me", "giới thiệu", "tóm tắt", "mục tiêu", "mục tiêu nghề nghiệp"],
    "experience": ["work experience", "experience", "kinh nghiệm", "kinh nghiệm làm việc", "kinh nghiệm chuyên môn"],
    "education": ["education", "học vấn", "trình độ học vấn"],
    "skill": ["technical skills", "skills", "kỹ năng", "kĩ năng", "kỹ năng chuyên môn"],
    "project": ["projects", "project", "dự án", "dự án nổi bật"],
    "certification": ["certifications", "certification", "chứng chỉ", "chứng chỉ & giải thưởng"],
    "language": ["languages", "language", "ngoại ngữ"],
    "other": ["additional", "additional information", "thông tin thêm", "thông tin bổ sung"],
}
TITLES = {
    "work_experience": "Kinh nghiệm làm việc", "experience": "Kinh nghiệm làm việc", "education": "Học vấn", "skill": "Kỹ năng chuyên môn", "skills": "Kỹ năng chuyên môn", "project": "Dự án tiêu biểu",
    "projects": "Dự án tiêu biểu", "certificate": "Chứng chỉ", "award": "Giải thưởng", "activity": "Hoạt động & Tổ chức", "summary": "Giới thiệu bản thân",
}
BLOCKED = ("experience", "education", "project")
DATED = ("Experience", "Projects", "Education")


def parsed(docs: DataFrame, text_col: str, as_of: Column) -> DataFrame:
    """docs with the columns _lines, _parts (array<struct<section, raw, lines, entries>>: each section's lines as they stand, joined, and as
    entries where lines are dated) and _headline. All is done within a row."""
    joined = lambda p: let(resumes.joined(p["lines"]), lambda c: F.struct(
        p["section"].alias("section"), p["lines"].alias("raw"), c.alias("lines"), F.when(p["section"].isin(*DATED), resumes.entries(c, p["section"] == "Education", as_of)).alias("entries"),
    ))
    out = docs.withColumn("_lines", resumes.prepared(F.col(text_col))).withColumn("_cut", resumes.sections(F.col("_lines")))
    out = out.withColumn("_parts", F.transform("_cut", joined)).drop("_cut")
    return out.withColumn("_headline", resumes.headline(F.get("_parts", F.lit(0))["raw"]))


def sectioned(docs: DataFrame, doc_id: str, text_col: str = "text", as_of: Column | None = None) -> DataFrame:
    """(doc, at, section, lines, entries): each section of each text in its order, `preamble` first, with its joined lines and, in sections of work and
    education with dated lines, its entries (title, org, dates, bullets).

    A null or empty text is an empty preamble; rows that repeat stay; an empty table gives no rows. A row of its own never needs another, so
    nothing is shuffled.
    """
    rows = parsed(spread(docs.select(F.col(doc_id).alias("doc"), F.col(text_col).alias("text"))), "text", F.current_date() if as_of is None else as_of)
    return rows.select("doc", F.posexplode_outer("_parts").alias("at", "p")).select("doc", "at", "p.section", "p.lines", "p.entries")


def _votes(found: Column) -> Column:
    """array<struct<name, total>> of votes (array<struct<name, weight>>), in the order of first votes."""
    names = F.array_distinct(F.transform(found, lambda v: v["name"]))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.aggregate(F.filter(found, lambda v: v["name"] == n), F.lit(0), lambda s, v: s + v["weight"]).alias("total")))


def _first_of_most(totals: Column) -> Column:
    most = F.array_max(F.transform(totals, lambda x: x["total"]))
    return F.coalesce(F.get(F.filter(totals, lambda x: x["total"] == most), F.lit(0))["name"], F.lit(""))


def fields(head: Column, text: Column, categories: Column) -> tuple[Column, Column]:
    """(field, part) of a profile: votes of hints in its headline (eightfold) and text, and of its skills' categories (array<array<string>>, an
    array a skill); ties go to the first vote."""
    made = _chosen(head, text, categories)
    return made["field"], made["part"]


def _hinted(head: Column, text: Column) -> Column:
    """array<struct<field, part, weight>>: a vote of each hint. Lower-cased texts are searched, so that no pattern has to try cases, and only for hints
    of which a text holds a part."""

    in_low = lambda t, pattern, marks: F.when(has_any(t, marks), F.regexp_count(t, F.lit(f"(?U){pattern}"))).otherwise(0)
    in_any = lambda t, pattern, _: F.regexp_count(t, F.lit(f"(?iuU){pattern}"))

    def votes(t: Column, count) -> Column:
        weight = lambda pattern, marks: ((count(t["head"], pattern, marks) * 8 + count(t["blob"], pattern, marks)) * 4).cast("int")
        return F.array(*(F.struct(F.lit(field).alias("field"), F.lit(part).alias("part"), weight(pattern, marks).alias("weight")) for pattern, field, part, marks in HINTS))

    def of(t: Column) -> Column:
        low = F.struct(F.lower(t["head"]).alias("head"), F.lower(t["blob"]).alias("blob"))
        return F.when(has_any(t["blob"], FOLDING), votes(t, in_any)).otherwise(let(low, lambda t: votes(t, in_low)))

    return let(F.struct(head.alias("head"), F.concat(head, F.lit("\n"), F.substring(text, 1, HINTED)).alias("blob")), of)


def _chosen(head: Column, text: Column, categories: Column) -> Column:
    """(field, part) as a struct: see ``fields``."""
    field_of = F.create_map(*(F.lit(x) for field, names in FIELDS.items() for name in names.split() for x in (name, field)))
    one = lambda c: F.struct(F.try_element_at(field_of, c).alias("field"), c.alias("part"), F.when(c.isin(PARTS), 3).otherwise(1).cast("int").alias("weight"))
    every = F.filter(F.concat(_hinted(head, text), F.transform(F.flatten(categories), one)), lambda v: v["weight"] > 0)

    def choose(votes: Column) -> Column:
        named = lambda k: _votes(F.transform(F.filter(votes, lambda v: v[k].isNotNull()), lambda v: F.struct(v[k].alias("name"), v["weight"].alias("weight"))))

        def part_of(totals: Column) -> Column:
            strong = F.filter(totals, lambda x: x["name"].isin(PARTS))
            others = F.coalesce(F.array_max(F.transform(F.filter(strong, lambda x: x["name"] != "game"), lambda x: x["total"])), F.lit(0))
            kept = F.filter(strong, lambda x: (x["name"] != "game") | (x["total"] >= others * 1.5))
            return _first_of_most(F.when(F.size(kept) > 0, kept).otherwise(totals))

        return F.struct(let(named("field"), _first_of_most).alias("field"), let(named("part"), part_of).alias("part"))

    return let(every, choose)


def _skilled(rows: DataFrame, doc: str, view: str, terms: DataFrame) -> DataFrame:
    """rows with _named, array<struct<slug, categories>>: the skills that a matched text names, by slug. Rows that share an id share its skills.

    Ids are looked at first: where none repeats, a row needs no other, and no text is shuffled.
    """
    known = terms.where("slug is not null").groupBy("slug").agg(F.array_distinct(F.flatten(F.sort_array(F.collect_set(F.array("category", "role"))))).alias("categories"))
    one = known.agg(F.map_from_entries(F.collect_list(F.struct("slug", "categories"))).alias("_categories"))
    own = skills.named(rows, view, terms)
    if not rows.groupBy(doc).count().where("count > 1").isEmpty():
        shared = own.groupBy(F.col(doc).alias("_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("slugs")))).alias("slugs"))
        own = own.drop("slugs").join(shared, F.col(doc).eqNullSafe(F.col("_id"))).drop("_id")
    named = F.transform("slugs", lambda s: F.struct(s.alias("slug"), F.col("_categories")[s].alias("categories")))
    return own.crossJoin(F.broadcast(one)).withColumn("_named", named).drop("slugs", "_categories")


def structured(docs: DataFrame, doc_id: str, terms: DataFrame, text_col: str = "text", source_col: str | None = None, as_of: Column | None = None) -> DataFrame:
    """(doc, markdown, cv_id, group_id, major_field, sub_field, seniority, years_experience, skills) of each profile text.

    The Markdown has front matter and one block a label, without the person; a short one is followed by what its sections left out.
    terms: the taxonomy (variant, slug, category, role), a small table. source_col: a file's name, of which `G<n>-..` gives the ids. as_of ends
    ranges that are open (today, by default). A text without any line gives an empty Markdown and no metadata. Rows that share an id share
    its skills; an empty table gives no rows.
    """
    as_of = F.current_date() if as_of is None else as_of
    source = F.col(source_col) if source_col else F.lit(None).cast("string")
    rows = parsed(spread(docs.select(F.col(doc_id).alias("doc"), F.col(text_col).alias("_text"), source.alias("_source"))), "_text", as_of)
    rows = rows.withColumn("_raw", F.array_join("_lines", "\n"))
    rows = _skilled(rows.withColumn("_view", matched(without_links(F.col("_raw")))), "doc", "_view", terms).drop("_view")

    work = F.flatten(F.transform(F.filter("_parts", lambda p: p["section"] == "Experience"), lambda p: F.filter(p["raw"], resumes.no_prose)))
    rows = rows.withColumn("years_experience", dates.years_of(dates.merged_months(dates.intervals(work, as_of))))
    rows = rows.withColumn("seniority", resumes.seniority(F.col("_headline"), F.col("_parts"), F.col("years_experience")))
    rows = rows.withColumn("_field", _chosen(F.col("_headline"), F.col("_raw"), F.transform("_named", lambda s: s["categories"])))
    stem = F.regexp_replace(F.substring_index("_source", "/", -1), r"(?<=.)\.[^.]*$", "")
    numbered = r"(?i)(G(\d+)[-_][A-Za-z0-9]+[-_]\d+)"
    rows = rows.withColumns({
        "major_field": F.col("_field.field"), "sub_field": F.col("_field.part"), "skills": F.transform("_named", lambda s: s["slug"]),
        "cv_id": F.coalesce(F.when(stem.rlike(numbered), F.upper(F.translate(F.regexp_extract(stem, numbered, 1), "_", "-"))).otherwise(stem), F.lit("")),
        "group_id": F.regexp_extract(stem, numbered, 2).try_cast("int"),
    })
    rows = rows.withColumn("_body", without_person(resumes.body(F.col("_parts"), F.col("_headline"))))
    # what is left of a text is never longer than the text
    rows = rows.withColumn("_left", F.when((F.length("_body") < 400) & (F.length("_raw") > 800), without_person(F.col("_raw"))))
    extra = F.aggregate(F.split("_body", "\n"), F.col("_left"), lambda s, x: F.when(F.trim(x) != "", F.replace(s, F.trim(x), F.lit(""))).otherwise(s))
    rest = F.btrim(F.regexp_replace(extra, r"\n{3,}", "\n\n"), F.lit(" \n"))
    short = (F.length("_body") < 400) & (F.length("_left") > 800)
    full = F.when(short & (rest != ""), F.when(F.col("_body") != "", F.concat("_body", F.lit("\n\n## Additional\n\n"), rest)).otherwise(rest)).otherwise(F.col("_body"))
    front = F.array_join(F.array_compact(F.array(
        F.lit("---"), F.when(F.col("cv_id") != "", F.concat(F.lit("cv_id: "), resumes.scalar(F.col("cv_id")))), F.concat(F.lit("group_id: "), F.col("group_id").cast("string")),
        *(F.when(F.col(k) != "", F.concat(F.lit(f"{k}: "), F.col(k))) for k in ("major_field", "sub_field", "seniority")), F.concat(F.lit("years_experience: "), F.col("years_experience").cast("string")),
        F.when(F.size("skills") > 0, F.concat(F.lit("skills:"), F.array_join(F.transform("skills", lambda s: F.concat(F.lit("\n  - "), s)), ""))), F.lit("---"),
    )), "\n")
    some = F.col("_raw") != ""
    markdown = F.when(some, F.when(full != "", F.concat(front, F.lit("\n\n"), full)).otherwise(front)).otherwise("")
    return rows.select("doc", markdown.alias("markdown"), *(F.when(some, F.col(c)).alias(c) for c in ("cv_id", "group_id", "major_field", "sub_field", "seniority", "years_experience", "skills")))


def canonical(text: Column) -> Column:
    """A text as Markdown under `# CV`: headings as `## Section` with what followed them below, other headings at level three or deeper, bullets as `- `."""
    def line(x: Column) -> Column:
        marked = r"^(#{1,6})\s+(.+?)\s*$"

        def write(h: Column) -> Column:
            section = F.concat(F.lit("\n## "), h["section"], F.lit("\n"), F.when(h["rest"] != "", F.concat(F.lit("\n"), h["rest"])).otherwise(""))
            deep = F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(3), F.length(F.regexp_extract(x, marked, 1)))), F.lit(" "), F.trim(F.regexp_extract(x, marked, 2)))
            other = F.when(x.rlike(marked), deep).when(resumes.is_bullet(x), F.when(resumes.unmarked(x) != "", F.concat(F.lit("- "), resumes.unmarked(x)))).otherwise(x)
            return F.when(h.isNotNull(), section).otherwise(other)

        return let(resumes.heading(x), write)

    lines = F.transform(F.split(resumes.clean(F.coalesce(text, F.lit(""))), "\n"), lambda x: line(F.trim(x)))
    made = F.btrim(F.regexp_replace(F.array_join(F.array_compact(lines), "\n"), r"\n{3,}", "\n\n"), F.lit(" \n"))
    return F.when((made == "") | made.rlike(r"(?i)^\s*#\s+CV\b"), made).otherwise(F.concat(F.lit("# CV\n\n"), made))


def profile_lines(markdown: Column, named: Column) -> Column:
    """array<struct<name, value>> of a profile's Markdown: a line for each block of work, education and projects, one for each other section; the
    skills named (array<string>) are a line where no section has them. Text without a heading is paragraphs of experience."""
    kinds = F.create_map(*(F.lit(x) for kind, keys in KINDS.items() for k in keys for x in (k, kind)))
    bare = F.btrim(F.coalesce(markdown, F.lit("")), F.lit(" \n\t"))
    text = F.btrim(F.when(bare.rlike(r"(?s)^---.*?---"), F.regexp_replace(bare, r"(?s)^---.*?---", "")).otherwise(bare), F.lit(" \n\t"))
    item = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    tidy = lambda c: F.btrim(c, F.lit(" \n\t"))
    # A heading's mark is made one character that texts don't hold, so that a split keeps each heading with its block.
    cut = lambda t, mark: F.split(F.regexp_replace(t, rf"(?m)^{mark}[ \t]+(?=\S)", "\x01"), "\x01")

    def block(kind: Column, content: Column) -> Column:
        subs = cut(content, "###")
        titled = F.transform(F.slice(subs, 2, 1 << 30), lambda b: item(kind, tidy(F.concat(F.trim(F.substring_index(b, "\n", 1)), F.lit("\n"), tidy(F.when(F.contains(b, F.lit("\n")), F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b))).otherwise(""))))))
        return F.when(kind.isin(*BLOCKED) & (F.size(subs) > 1), titled).otherwise(F.array(item(kind, content)))

    def one(s: Column) -> Column:
        content = tidy(F.when(F.contains(s, F.lit("\n")), F.substring(s, F.length(F.substring_index(s, "\n", 1)) + 2, F.length(s))).otherwise(""))
        kind = F.coalesce(F.try_element_at(kinds, F.lower(F.trim(F.substring_index(s, "\n", 1)))), F.lit("other"))
        return F.when(content == "", F.array().cast("array<struct<name:string,value:string>>")).otherwise(let(content, lambda c: block(kind, c)))

    plain = F.transform(F.filter(F.transform(F.split(text, "\n\n"), tidy), lambda p: (p != "") & ~p.startswith("#")), lambda p: item(F.lit("experience"), p))
    headed = lambda c: F.when(F.size(c) <= 1, plain).otherwise(F.flatten(F.transform(F.slice(c, 2, 1 << 30), one)))
    lacking = lambda c: F.when((F.coalesce(F.size(named), F.lit(0)) > 0) & ~F.exists(c, lambda x: x["name"] == "skill"), F.concat(c, F.array(item(F.lit("skill"), F.array_join(named, ", "))))).otherwise(c)
    return let(let(cut(text, "##"), headed), lacking)


def profile_markdown(lines: Column) -> Column:
    """The inverse: Markdown of array<struct<name, value>>, a block for each title in the order of its first line; empty values are left out."""
    titles = F.create_map(*(F.lit(x) for pair in TITLES.items() for x in pair))
    name = lambda x: F.lower(F.coalesce(F.nullif(x["name"], F.lit("")), F.lit("other")))
    titled = F.transform(lines, lambda x: F.struct(F.coalesce(F.try_element_at(titles, name(x)), F.initcap(F.translate(name(x), "_", " "))).alias("title"), F.btrim(F.coalesce(x["value"], F.lit("")), F.lit(" \n\t")).alias("value")))
    real = F.filter(titled, lambda x: x["value"] != "")
    write = lambda rows: F.array_join(F.transform(F.array_distinct(F.transform(rows, lambda x: x["title"])), lambda t: F.concat(F.lit("## "), t, F.lit("\n"), F.array_join(F.transform(F.filter(rows, lambda x: x["title"] == t), lambda x: x["value"]), "\n\n"))), "\n\n")
    return let(real, write)
