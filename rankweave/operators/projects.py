"""Projects out of profile texts: blocks of their sections, with skills, months, measured impact and depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions import redaction
from rankweave.functions.guardrails import let
from rankweave.functions.unicode import trimmed
from rankweave.operators import skills
from rankweave.sources.tables import spread

# Headings that open and that close a part about projects or work, lines that begin a project, marks of projects outside of such
# parts, and what a project's name is freed of.
OPENS = [
    r"(?iuU)^(?:#+\s*)?(?:projects?|dự\s*án|personal\s*projects|kinh\s*nghiệm\s*dự\s*án|selected\s*projects)\b",
    r"(?iuU)^(?:#+\s*)?(?:work\s*experience|kinh\s*nghiệm\s*làm\s*việc|kinh\s*nghiệm\s*chuyên\s*môn)\b",
]
CLOSES = r"(?iuU)^(?:#+\s*)?(?:education|học\s*vấn|skills|kỹ\s*năng|certifications?|chứng\s*chỉ|languages?|ngôn\s*ngữ|awards?|giải\s*thưởng|interests?|sở\s*thích)\b"
BEGINS = r"(?U)^(?:###|\*\*|•|\-|\d+\.)\s*(?:Tên\s*dự\s*án|Dự\s*án|Project|\b[A-Z][\w\s-]{2,40}\b:?)"
YEARS = r"(?iuU)\b(?:20\d\d|19\d\d)\s*[-–—]\s*(?:20\d\d|present|hiện\s*tại|nay)\b"
MARK = r"(?iuU)(?:dự\s*án|project|công\s*ty|company)\s*[:：\-–]"
NUMBERED = r"(?U)^(?:###|\*\*|•|\-|\d+\.|\s*|Tên\s*dự\s*án\s*[:：]|Project\s*[:：])"
#: A text, and a block, of fewer characters tells nothing; a block of no more lines is not split; a name is no longer.
LEAST_TEXT, LEAST_BLOCK, LINES, NAME = 30, 20, 3, 60


def _cut(lines: Column, starts: Column, end: Column) -> Column:
    """The lines from each start to the next, the last to the end, as array<array<string>>."""
    return F.transform(starts, lambda s, k: F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), end) - s))


def _split(lines: Column) -> Column:
    """A part's lines (none empty at its start) as blocks: a line that begins a project opens a new one if the block before has more than LINES lines."""
    may = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(BEGINS) | x.rlike(YEARS), i)), lambda i: i.isNotNull())
    starts = F.aggregate(may, F.array(F.lit(0)), lambda s, i: F.when(i - F.try_element_at(s, F.lit(-1)) > LINES, F.array_append(s, i)).otherwise(s))
    return let(starts, lambda s: _cut(lines, s, F.size(lines)))


def blocks(text: Column) -> Column:
    """array<array<string>>: the lines of each block of a text, from the parts under headings of projects and work, or, where there is no such
    part, from each line with a project's or company's mark on. Empty for null and texts of fewer than 30 characters."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"), trimmed)
    none = F.array().cast("array<array<string>>")
    opens = lambda x: (x.rlike(OPENS[0]) | x.rlike(OPENS[1]))

    def under_headings(c: Column) -> Column:
        heads = F.filter(F.transform(c, lambda x, i: F.when(opens(x), F.struct(i.alias("at"), F.lit(True).alias("opens"))).when(x.rlike(CLOSES), F.struct(i.alias("at"), F.lit(False).alias("opens")))), lambda h: h.isNotNull())
        leading = lambda p: F.coalesce(F.get(F.filter(F.transform(p, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull()), F.lit(0)), F.size(p))
        bare = lambda p: let(leading(p), lambda k: F.slice(p, k + 1, F.size(p) - k))
        parts = lambda h: F.transform(F.filter(F.transform(h, lambda x, k: F.when(x["opens"], F.slice(c, x["at"] + 2, F.coalesce(F.get(h, k + 1)["at"], F.size(c)) - x["at"] - 1))), lambda p: p.isNotNull()), bare)
        return F.flatten(F.transform(F.filter(let(heads, parts), lambda p: F.size(p) > 0), _split))

    def marked(c: Column) -> Column:
        full = F.filter(c, lambda x: x != "")
        return let(full, lambda f: _cut(f, F.filter(F.transform(f, lambda x, i: F.when(x.rlike(MARK), i)), lambda i: i.isNotNull()), F.size(f)))

    found = let(lines, lambda c: let(under_headings(c), lambda b: F.when(F.size(b) > 0, b).otherwise(marked(c))))
    return F.when(F.length(trimmed(text)) >= LEAST_TEXT, found).otherwise(none)


def named(block: Column) -> Column:
    """(name, text) of a block of lines: the first line without its mark, its first 50 characters where that is empty or too long."""
    first = F.get(block, F.lit(0))
    bare = F.btrim(F.regexp_replace(first, NUMBERED, ""), F.lit(" *#:-"))
    name = let(bare, lambda n: F.when((n == "") | (F.length(n) > NAME), F.substring(first, 1, 50)).otherwise(n))
    return F.struct(name.alias("name"), F.btrim(F.array_join(block, "\n"), F.lit(" \n")).alias("text"))


def projects(docs: DataFrame, doc_id: str, terms: DataFrame, text_col: str = "text", as_of_year: int | None = None) -> DataFrame:
    """(doc, at, name, text, skills, months, metrics, depth): each project of each text in its order, of 20 characters or more.

    terms: the taxonomy (variant, slug, ..), a small table. as_of_year ends ranges that are open (this year, by default). A null text, and one without
    a project, has no rows; rows of docs that share an id are told apart only by their blocks; an empty table gives no rows.
    """
    rows = spread(docs.select(F.col(doc_id).alias("doc"), F.col(text_col).alias("_text")))
    cut = rows.select("doc", F.filter(F.transform(blocks(F.col("_text")), named), lambda b: F.length(b["text"]) >= LEAST_BLOCK).alias("_b"))
    each = cut.select("doc", F.posexplode_outer("_b").alias("at", "b")).where("b is not null").select("doc", "at", "b.name", "b.text")
    of = skills.found(each.select("doc", "at", skills.text.matched(F.col("text")).alias("view")), "view", terms, ["doc", "at"])
    of = of.groupBy(F.col("doc").alias("_doc"), F.col("at").alias("_at")).agg(F.sort_array(F.collect_set("slug")).alias("skills"))
    each = each.join(of, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("at") == F.col("_at")), "left")
    each = each.select("doc", "at", "name", "text", F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))
    year = F.year(F.current_date()) if as_of_year is None else F.lit(as_of_year)
    each = each.select("*", redaction.project_months(F.col("text"), year).alias("months"), redaction.metrics(F.col("text")).alias("metrics"))
    return each.withColumn("depth", redaction.project_depth(F.col("text"), F.size("skills"), F.col("metrics")))
