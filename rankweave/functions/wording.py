"""Small rules over the wording of profiles and jobs, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions import text
from rankweave.functions.guardrails import let

# Marks and words of Vietnamese, signs of a list, code fences, and summaries and titles that are no content.
VI_TOKENS = r"\b(va|cua|la|khong|kinh|nghiem|yeu|cau)\b"
#: The same words, tried only at their first letters.
_VI_TOKENS = VI_TOKENS.replace(r"\b(", r"\b(?=[vclkny])(", 1)
VI_MARKS = "[àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ]"
BULLETS = r"^([-*•] |•)"
FENCE = r"(?is)^```(json|markdown|md)?\s*(.*?)\s*```$"
NO_SUMMARY = ["1-3 sentences", "1-3 sentence", "summary"]
# How a job's kind of contract is written.
CONTRACTS = {"Toàn thời gian": "full_time", "Bán thời gian": "part_time", "Thực tập": "internship", "Hợp đồng": "contract"}
# What a year and an address look like in a text that is reranked, and how long it may be.
YEAR, RERANK_CHARS = r"\b(19|20)\d{2}\b", 2000
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def filled(*parts: Column) -> Column:
    """The first part that isn't blank, trimmed; null if all are."""
    return F.coalesce(*(F.nullif(F.trim(p), F.lit("")) for p in parts))


def job_query_text(requirements: Column, title: Column, description: Column) -> Column:
    """A job's requirements, else its title and description."""
    return F.coalesce(filled(requirements), F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(description, F.lit(""))))


def profile_query_text(titles: Column, summary: Column, whole: Column) -> Column:
    """A profile's titles, else its summary, else its whole text."""
    return F.coalesce(F.nullif(F.array_join(F.filter(titles, lambda t: t.isNotNull() & (t != "")), " "), F.lit("")), filled(summary), whole)


def profile_lines(parts: dict[str, Column]) -> Column:
    """`label: value` lines of the parts that aren't blank."""
    return F.concat_ws("\n", *(F.when(filled(c).isNotNull(), F.concat(F.lit(f"{k}: "), filled(c))) for k, c in parts.items()))


def detected_language(t: Column) -> Column:
    """vi for a text with Vietnamese marks or frequent words, else en.

    The words' ends are the same in the text as in its matched form (``text.matched``), which differs in signs and space only.
    """
    return let(F.lower(t), lambda low: F.when((F.octet_length(low) > F.length(low)) & low.rlike(VI_MARKS) | text.unaccented(low).rlike(_VI_TOKENS), "vi").otherwise("en"))


def body_lines(t: Column) -> Column:
    """The lines of a text that aren't blank; its sentences if there are fewer than four."""
    real = lambda parts: F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    sentences = real(F.split(F.regexp_replace(t, r"([.。])\s+", "$1\u0001"), "\u0001"))
    return let(real(F.split(t, "\n")), lambda lines: F.when(F.size(lines) >= 4, lines).otherwise(sentences))


def requirements(t: Column) -> Column:
    """The items of a list written in lines, without their bullets."""
    return F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), BULLETS, ""))), lambda x: x != "")


def unfenced(t: Column) -> Column:
    """A text without the code fence around it."""
    whole = F.regexp_extract(F.trim(t), FENCE, 2)
    return F.when(F.trim(t).rlike(FENCE), whole).otherwise(F.trim(t))


def clean_summary(t: Column) -> Column:
    one = F.replace(F.trim(F.coalesce(t, F.lit(""))), F.lit("\n"), F.lit(" "))
    return F.when(F.lower(one).isin(NO_SUMMARY), "").otherwise(one)


def clean_titles(titles: Column, noise: list[str]) -> Column:
    """Titles trimmed, without blank and noise ones, each (case aside) at its first place."""
    trimmed = F.filter(F.transform(titles, lambda t: F.trim(t)), lambda t: (t != "") & ~F.lower(t).isin(noise))
    lower = F.transform(trimmed, lambda t: F.lower(t))
    return F.filter(trimmed, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1)


def grounded_titles(titles: Column, source: Column) -> Column:
    """Titles of which every word is in the source, case aside."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(titles, lambda t: (F.size(words(t)) > 0) & F.forall(words(t), lambda w: F.contains(F.lower(source), w)))


def dedup_key(title: Column) -> Column:
    """A title by which repeated postings are found: lower case, no brackets' content, letters and digits only."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(title), r"\(.*?\)", ""), "[^a-zà-ỹ0-9 ]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def location(raw: Column, names: dict[str, str]) -> Column:
    """Places by their usual names, each once, in order; Remote for none."""
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    parts = F.transform(F.split(raw, ","), lambda p: F.trim(p))
    return F.when(filled(raw).isNull(), "Remote").otherwise(F.array_join(F.array_distinct(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, F.lower(p)), F.initcap(p)))), ", "))


def contract(raw: Column) -> Column:
    """The kind of the first contract named; full time for any other."""
    known = F.create_map(*(F.lit(x) for pair in CONTRACTS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.trim(F.substring_index(raw, ",", 1))), F.lit("full_time"))


def labels(title: Column, rules: list[tuple[int, list[str], list[str]]]) -> Column:
    """Numbers of the rules (number, words of which one must be in a title, words of which none may be)."""
    t = F.concat(F.lit(" "), F.lower(title), F.lit(" "))
    some = lambda words: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words), F.lit(False))
    return F.array_compact(F.array(*(F.when(some(yes) & ~some(no), F.lit(n)) for n, yes, no in rules)))


def leaked_names(t: Column, name: Column) -> Column:
    """Tokens of a name, of three letters and more, that a text holds as words."""
    tokens = F.filter(F.regexp_extract_all(F.translate(name, text.ACCENTED, text.FOLDED), F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) > 2)
    return F.filter(tokens, lambda w: F.regexp_like(F.lower(t), F.concat(F.lit(r"\b"), F.lower(w), F.lit(r"\b"))))


def rerank_text(title: Column, company: Column, body: Column, quotes: Column) -> Column:
    """What a rerank model reads: a header, the body and quotes, without addresses and years, cut to RERANK_CHARS (the model's limit)."""
    header = F.concat_ws(" - ", filled(title), filled(company))
    blob = F.concat_ws("\n", F.nullif(header, F.lit("")), filled(body), F.nullif(F.array_join(F.filter(F.transform(quotes, lambda x: F.trim(x)), lambda x: x != ""), "\n"), F.lit("")))
    clean = F.regexp_replace(F.regexp_replace(blob, ADDRESS, " "), YEAR, " ")
    return F.when(F.trim(clean) == "", " ").otherwise(F.substring(clean, 1, RERANK_CHARS))


#: Sentences of a reason, to a recruiter and to a candidate: with matched skills, with other skills than wanted, with skills, with none.
REASONS = {
    "recruiter": [
        "Đạt điểm phù hợp{pct} nhờ đáp ứng các kỹ năng cốt lõi: {skills}{rank}.", "Ứng viên có các kỹ năng ({skills}) nhưng chưa đáp ứng yêu cầu cốt lõi của vị trí{pct}{rank}.",
        "Đạt điểm phù hợp{pct} nhờ các kỹ năng liên quan: {skills}{rank}.", "Hồ sơ chưa có kỹ năng chuyên môn phù hợp với yêu cầu của vị trí{pct}{rank}.",
    ],
    "candidate": [
        "Công việc này phù hợp với CV của bạn{pct} nhờ đáp ứng các kỹ năng: {skills}{rank}.", "CV có các kỹ năng ({skills}) nhưng chưa đáp ứng yêu cầu cốt lõi của công việc{pct}{rank}.",
        "Công việc này phù hợp với CV của bạn{pct} nhờ các kỹ năng liên quan: {skills}{rank}.", "CV chưa có kỹ năng chuyên môn phù hợp với vị trí này{pct}{rank}.",
    ],
}


def reason(owned: Column, wanted: Column, score: Column, rank: Column, total: Column, reader: str = "recruiter") -> Column:
    """One sentence on a ranked row from its skills, score and place."""
    own = F.array_distinct(F.filter(F.transform(owned, lambda s: F.trim(s)), lambda s: s != ""))
    asked = F.filter(F.transform(wanted, lambda s: F.trim(s)), lambda s: s != "")
    hits = F.filter(own, lambda s: F.array_contains(asked, s))
    pct = F.when(score.isNull(), "").otherwise(F.concat(F.lit(" ("), F.bround(score * 100).cast("int").cast("string"), F.lit("%)")))
    place = F.when(total <= 1, "").otherwise(F.concat(F.lit(", xếp thứ "), rank.cast("string"), F.lit("/"), total.cast("string"), F.lit(" trong shortlist")))
    said = lambda k, skills: reduce(lambda c, p: F.replace(c, F.lit(p[0]), p[1]), [("{pct}", pct), ("{rank}", place), ("{skills}", skills)], F.lit(REASONS[reader][k]))
    first = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    return (
        F.when(F.size(hits) > 0, said(0, first(hits, 5))).when((F.size(own) > 0) & (F.size(asked) > 0), said(1, first(own, 3)))
        .when(F.size(own) > 0, said(2, first(own, 3))).otherwise(said(3, F.lit("")))
    )


#: Fixed value: what is recommended where nothing is to be mended.
NOTHING_MORE = "Strong match! Focus on preparing for role-specific interviews."


def _some(condition: Column, said: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), said)


def _listed(items: Column, most: int) -> Column:
    return F.array_join(F.slice(items, 1, most), ", ")


def strengths(matched: Column, impact: Column, active: Column, shown_years: Column, expected_years: Column, level: Column) -> Column:
    """What speaks for a profile against a benchmark: matched skills, skills with impact, skills in use, enough years. Null arrays count as empty."""
    said = F.array(
        _some(F.size(matched) > 0, F.concat(F.lit("Kỹ năng cốt lõi đáp ứng chuẩn ngành: "), _listed(matched, 8))),
        _some(F.size(impact) > 0, F.concat(F.lit("Kỹ năng thực chiến có bằng chứng dự án mạnh: "), _listed(impact, 5))),
        _some(F.size(active) > 0, F.concat(F.lit("Kỹ năng được sử dụng trực tiếp trong công việc/dự án: "), _listed(active, 5))),
        _some((shown_years >= expected_years) & (expected_years > 0), F.concat(F.lit("Kinh nghiệm thực tế ("), shown_years.cast("double").cast("string"), F.lit(" năm) đáp ứng tốt yêu cầu cấp bậc "), F.upper(level))),
    )
    return F.array_compact(said)


def weaknesses(missing: Column, ghosts: Column, shown_years: Column, expected_years: Column) -> Column:
    """What speaks against it: missing skills, skills without a project, too few years."""
    said = F.array(
        _some(F.size(missing) > 0, F.concat(F.lit("Kỹ năng trọng tâm của ngành cần bổ sung: "), _listed(missing, 8))),
        _some(F.size(ghosts) > 0, F.concat(F.lit("Kỹ năng thiếu dự án chứng minh (Ghost Skills): "), _listed(ghosts, 5))),
        _some(shown_years < expected_years, F.concat(F.lit("Kinh nghiệm thực chiến ("), shown_years.cast("double").cast("string"), F.lit(" năm) còn thấp hơn chuẩn kỳ vọng ("), expected_years.cast("string"), F.lit(" năm)"))),
    )
    return F.array_compact(said)


def recommendations(missing: Column, prerequisites: Column, experience: Column, market: Column) -> Column:
    """What to do next: the first three missing skills, what comes before each (a map of skill to skills), experience below 60, market level below 70;
    an encouragement where nothing is to be said. Null scores say nothing."""
    top = F.slice(F.coalesce(missing, F.array().cast("array<string>")), 1, 3)
    before = F.transform(top, lambda s: F.when(F.size(F.try_element_at(prerequisites, s)) > 0, F.concat(F.lit("Before learning "), s, F.lit(", consider: "), _listed(F.try_element_at(prerequisites, s), 2))))
    said = F.array_compact(F.concat(
        F.array(_some(F.size(top) > 0, F.concat(F.lit("Focus on these critical skills: "), F.array_join(top, ", ")))), before,
        F.array(
            _some(experience < 60, F.lit("Consider taking on more responsibilities or projects to demonstrate growth")),
            _some(market < 70, F.lit("Your seniority level may not fully match this position. Consider roles at a slightly different level.")),
        ),
    ))
    return F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(NOTHING_MORE)))


def warnings(red_flags: Column, confidence: Column, missing: Column, experience: Column, match_rate: Column) -> Column:
    """What an evaluation's reader should know: red flags, little data, over five missing skills, a gap of experience, a low rate of matches."""
    flags = F.transform(F.coalesce(red_flags, F.array().cast("array<string>")), lambda x: F.concat(F.lit("[Cảnh báo rủi ro] "), x))
    said = F.array(
        _some(confidence < 0.6, F.lit("Dữ liệu đầu vào hạn chế, độ chính xác của đánh giá có thể bị ảnh hưởng.")),
        _some(F.size(missing) > 5, F.concat(F.lit("Có "), F.size(missing).cast("string"), F.lit(" kỹ năng quan trọng bị thiếu."))),
        _some(experience < 50, F.lit("Chênh lệch kinh nghiệm đáng kể với yêu cầu.")), _some(match_rate < 30, F.lit("Tỷ lệ match kỹ năng thấp, cần đánh giá kỹ hơn về khả năng học hỏi.")),
    )
    return F.concat(flags, F.array_compact(said))
