"""Resume structuring, projects and dates on small texts with known results, and odd rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from rankweave.functions import dates, redaction
from rankweave.operators import projects, resumes

AS_OF = datetime.date(2026, 6, 15)
INTERN = """
Trần Văn Bình
Fresher Web Developer
THÔNG TIN CÁ NHÂN
0764181652
binh2022@gmail.com
https://github.com/binh/x
MỤC TIÊU NGHỀ NGHIỆP
Làm việc trong một môi trường chuyên nghiệp để học thêm về backend.
📚HỌC VẤN
Trường Đại học Công Thương - Khoa CNTT
(09/2021 - Hiện nay) GPA: 2.83
DỰ ÁN
Quản lý thuê nhà
(05/2024 - 06/2024)
2. Mô tả:
Trang web cho thuê nhà.
• Built checkout with Spring Boot
Kanban
(10/2023 - 11/2023)
- Built boards
👨‍💻KỸ NĂNG CHUYÊN MÔN
• Java, Spring Boot và MySQL
© topcv.vn
"""
ASSOCIATE = """
Software developer with one year of hands-on experience in Node.js and ReactJS.
WORK EXPERIENCE
NORTH STAR TECHNOLOGY COMPANY
Position: Associate
March 2023 - March 2025
- Frontend: Developed screens,
and tests in ReactJS.
EDUCATION
University of Transport
September 2020 - January 2025
Information Technology Engineer
SKILLS
Node.js, ReactJS, MySQL
INTERESTS
Chess
"""
SENIOR = """
Backend Engineer
WORK EXPERIENCE
Senior Backend Engineer | Wallet | Nov 2019 - Present
- Built payout services in Go and Kafka.
Software Engineer | Bank | Jul 2017 - Oct 2019
- Java Spring Boot microservices.
EDUCATION
B.Sc Computer Science | HCMUT | 2013 - 2017
TECHNICAL SKILLS
Go, Java, Kafka
"""
TERMS = [("java", "java", "backend"), ("spring boot", "spring_boot", "backend"), ("mysql", "mysql", "backend"), ("node.js", "nodejs", "backend"), ("reactjs", "react", "frontend"), ("go", "golang", "backend"), ("kafka", "kafka", "data_engineering")]


@pytest.fixture(scope="module")
def made(spark):
    terms = spark.createDataFrame([(*t, "") for t in TERMS], "variant string, slug string, category string, role string")
    rows = [(1, INTERN, None), (2, ASSOCIATE, "cv.pdf"), (3, SENIOR, "in/G1_BE_01.pdf"), (4, None, None), (5, "  \n ### \n --- ", "x"), (6, "one line only", None), (None, SENIOR, None)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id long, text string, src string, markdown string, _parts string")
    return {r["doc"]: r for r in resumes.structured(docs, "id", terms, source_col="src", as_of=F.lit(AS_OF)).collect()}


def test_a_profile_is_written_without_its_person(made):
    text = made[1]["markdown"]
    for gone in ("binh2022", "0764181652", "github", "Trần Văn Bình", "topcv", "THÔNG TIN"):
        assert gone not in text
    assert text.split("---\n", 2)[2].lstrip() == "\n".join([
        "## Profile", "", "Làm việc trong một môi trường chuyên nghiệp để học thêm về backend.", "",
        "## Projects", "", "### Trang web cho thuê nhà. | Quản lý thuê nhà | May 2024 - Jun 2024", "- Built checkout with Spring Boot", "", "### Oct 2023 - Nov 2023", "- Built boards", "",
        "## Education", "", "### Trường Đại học Công Thương - Khoa CNTT | Sep 2021 - Present", "", "## Technical Skills", "", "- Java, Spring Boot và MySQL",
    ])


def test_entries_and_broken_lines(made):
    assert "### Associate | NORTH STAR TECHNOLOGY COMPANY | Mar 2023 - Mar 2025\n- Frontend: Developed screens, and tests in ReactJS." in made[2]["markdown"]
    assert "### Information Technology Engineer | University of Transport | Sep 2020 - Jan 2025" in made[2]["markdown"]
    assert "Chess" not in made[2]["markdown"] and "## Profile\n\nSoftware developer with one year" in made[2]["markdown"]


def test_metadata(made):
    facts = ("cv_id", "group_id", "major_field", "sub_field", "seniority", "years_experience", "skills")
    assert [made[1][k] for k in facts] == ["", None, "web", "backend", "intern", 0, ["java", "mysql", "spring_boot"]]
    assert [made[2][k] for k in facts] == ["cv", None, "web", "frontend", "mid", 2, ["mysql", "nodejs", "react"]]
    assert [made[3][k] for k in facts] == ["G1-BE-01", 1, "web", "backend", "senior", 9, ["golang", "java", "kafka", "spring_boot"]]
    assert made[3]["markdown"].startswith("---\ncv_id: G1-BE-01\ngroup_id: 1\nmajor_field: web\nsub_field: backend\nseniority: senior\nyears_experience: 9\nskills:\n  - golang\n")
    assert made[None]["skills"] == made[3]["skills"]


def test_empty_profiles(made):
    for k in (4, 5):
        assert made[k]["markdown"] == "" and made[k]["seniority"] is None
    assert made[6]["markdown"] == "---\nseniority: intern\nyears_experience: 0\n---" and made[6]["skills"] == []


def test_sections_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "c"), (1, "Experience\nExperience\n\n\nEducation", "c"), (2, "a\n" * 3000, "c")], "id long, text string, at string")
    got = sorted((r["doc"], r["at"], r["section"], len(r["lines"])) for r in resumes.sectioned(docs, "id").collect())
    assert got == [(1, 0, "preamble", 0), (1, 0, "preamble", 0), (1, 1, "Experience", 0), (1, 2, "Experience", 0), (1, 3, "Education", 0), (2, 0, "preamble", 3000)]
    assert resumes.sectioned(docs.limit(0), "id").count() == 0


def test_lines_of_markdown_and_back(spark):
    text = "---\na: 1\n---\n\n## Profile\nShort.\n\n## Work Experience\n### A | B\n- x\n\n### C\n## Nowhere\nrest\n## Skills\n"
    row = spark.createDataFrame([(text,), ("one\n\n# two\n\nthree",), (None,)], "t string").select(
        resumes.profile_lines(F.col("t"), F.array(F.lit("go"), F.lit("c"))).alias("lines")
    ).withColumn("back", resumes.profile_markdown(F.col("lines"))).collect()
    assert [tuple(x) for x in row[0]["lines"]] == [("summary", "Short."), ("experience", "A | B\n- x"), ("experience", "C"), ("other", "rest"), ("skill", "go, c")]
    assert row[0]["back"] == "## Giới thiệu bản thân\nShort.\n\n## Kinh nghiệm làm việc\nA | B\n- x\n\nC\n\n## Other\nrest\n\n## Kỹ năng chuyên môn\ngo, c"
    assert [tuple(x) for x in row[1]["lines"]] == [("experience", "one"), ("experience", "three"), ("skill", "go, c")]
    assert [tuple(x) for x in row[2]["lines"]] == [("skill", "go, c")]


DATES = {
    "12/03/2020": "2020-03-01", "3/15/2020": "2020-03-01", "1/2/19": "2019-02-01", "13/13/2020": None, "05/2021": "2021-05-01", "15/2021": None, "Sept. 2021": "2021-09-01", "March 4, 2021": "2021-03-01",
    "may 2021.": "2021-05-01", "2020": "2020-01-01", "hiện tại": "2026-06-15", "Present": "2026-06-15", "soon": None, "": None,
}


def test_dates(spark):
    rows = spark.createDataFrame([(k,) for k in DATES], "t string").select("t", dates.first_of_month(F.col("t"), F.lit(AS_OF)).cast("string").alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == DATES


def test_ranges_and_months(spark):
    lines = ["Jan 2020 - Mar 2021 and 05/2020 to 06/2022", "2021 – 2020", "Mar 2019 Apr 2019", "no dates", "01/2023 03/2023", "Jun 2026 - now"]
    row = spark.createDataFrame([(lines,)], "l array<string>").select(
        dates.intervals(F.col("l"), F.lit(AS_OF)).alias("i"), dates.merged_months(dates.intervals(F.col("l"), F.lit(AS_OF))).alias("m"), F.transform("l", lambda x: dates.range_label(x, F.lit(AS_OF))).alias("labels"),
        F.transform("l", dates.without_ranges).alias("rest"),
    ).first()
    assert len(row["i"]) == 5 and row["m"] == 29 + 1 + 2 + 0
    assert row["labels"] == ["Jan 2020 - Mar 2021", "Jan 2021 - Jan 2020", "Mar 2019 - Apr 2019", "", "Jan 2023 - Mar 2023", "Jun 2026 - Present"]
    assert row["rest"] == ["and", "", "", "no dates", "", ""]
    said = spark.createDataFrame([("5+ years experience",), ("Kinh nghiệm: 3 năm",), ("2 yr. exp",), ("none",), (None,)], "t string")
    assert [r[0] for r in said.select(dates.claimed_years(F.col("t"))).collect()] == [5, 3, 2, None, None]
    halves = spark.createDataFrame([(6,), (18,), (30,), (7,)], "m int").select(dates.years_of(F.col("m"))).collect()
    assert [r[0] for r in halves] == [0, 2, 2, 1]


def test_metrics_are_distinct_snippets(spark):
    text = "Sharding and caching of a message queue, 40% faster, 20 ms, 20 ms and 30 ms, latency, Latency"
    row = spark.createDataFrame([(text,)], "t string").select(redaction.metrics(F.col("t")).alias("m"), redaction.project_depth(F.col("t"), F.lit(3)).alias("d")).first()
    assert row["m"] == ["20 ms", "30 ms", "latency", "Latency"]  # a percent sign before a space ends on no word boundary
    assert row["d"] == 30 + 32 + 25 + 10  # `sharding` holds `ha`


def test_projects(spark):
    terms = spark.createDataFrame([(*t, "") for t in TERMS], "variant string, slug string, category string, role string")
    text = "Tên: x\nDự án\n\n1. Project Alpha: a to-do list\nJava and MySQL\nline three\nline four\n- Project Beta: 2021 - 2022\nKafka, 35%x less cost\nEducation\nmore\nWork Experience\nshort"
    marked = "Some words before it all\nCompany: One of them\nfirst line\nAt company - Two\n7 months of Go work"
    docs = spark.createDataFrame([(1, text, "c"), (2, marked, "c"), (3, None, "c"), (4, "Dự án\nshort", "c"), (None, marked, "c")], "id long, text string, skills string")
    got = {(r["doc"], r["at"]): r for r in projects.projects(docs, "id", terms, as_of_year=2026).collect()}
    assert sorted(got, key=repr) == [(1, 0), (1, 1), (2, 0), (2, 1), (None, 0), (None, 1)]
    first, second, third = got[1, 0], got[1, 1], got[2, 1]
    assert (first["name"], first["months"], first["skills"], first["metrics"]) == ("Project Alpha: a to-do list", 3, ["java", "mysql"], [])
    assert first["depth"] == 30 - 15 + 8 and first["text"].endswith("line four")
    assert (second["name"], second["months"], second["skills"], second["metrics"]) == ("Project Beta: 2021 - 2022", 23, ["kafka"], ["35%", "cost"])
    assert (third["name"], third["months"], third["skills"]) == ("At company - Two", 7, ["golang"])
    assert projects.projects(docs.limit(0), "id", terms).count() == 0
