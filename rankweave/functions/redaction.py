"""Profiles without their person: labelled lines, contact sections and names go line by line, then addresses, links, numbers and dates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.guardrails import let

# Sections of contact data, particles of names, words that no name has, and texts that are no name.
CONTACT = ["contact", "personal information"]
PARTICLES = ["van", "von", "de", "del", "da", "thi", "la", "le", "binh"]
JOB_WORDS = (
    "engineer developer intern student manager bachelor master cv resume experience skills education summary objective profile background information projects certifications languages hobbies interests "
    "học vấn kinh nghiệm kỹ năng dự án chứng chỉ mục tiêu giới thiệu"
).split()
NO_NAMES = ["cv", "resume", "curriculum vitae"]
#: Lines of a contact section that are skipped at most, so that a heading that isn't recognised doesn't cost the rest of a profile.
CONTACT_LINES = 15
# Labelled lines, links, addresses, phone numbers and dates of birth, and bullets.
LABELLED = (
    r"(?iu)^\s*(?:[-*+•] )?(?:email|e-mail|phone|tel|mobile|điện thoại|dien thoai|địa chỉ|dia chi|address|linkedin|github|facebook|twitter|ngày sinh|ngay sinh|date of birth|dob|giới tính|gioi tinh|gender|"
    r"cccd|cmnd|passport|họ và tên|ho va ten|full name|name)\s*[:：].*$"
)
LINK = r"\[[^\]]+\]\([^)]+\)"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
URL = r"(?i)https?://\S+|www\.\S+|github\.com/\S+|linkedin\.com/\S+|facebook\.com/\S+|\b[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.(?:com|net|io|dev|me|co|vn)/\S+"
PHONE = r"(?<!\d)(?:\+?84[\s.-]?|0)(?:3|5|7|8|9)\d(?:[\s.-]?\d){7,8}(?!\d)"
BIRTH = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
BULLET = r"^\s*(?:[-*+•●▪◦‣–—]|(?:\d+)[.)])\s*"
#: What all finds of a pattern have, cheap to look for; a text without it is not looked at by the pattern.
MAY_URL = r"(?i)://|www\.|\.(?:com|net|io|dev|me|co|vn)/"
MAY_PHONE = r"(?:0|84[\s.-]?)[35789]\d[\s.-]?\d"
MAY_BIRTH = r"\d[/-]\d{1,2}[/-]\d{2}"
MAY_NAME = r"^(?:#{1,6}+\s++)?+\s*+\S++(?:\s++\S++){1,4}+\s*+\z"
#: A line of at most a bullet.
EMPTY = r"^(?:\s*(?:[-*+•●▪◦‣–—]|\d+[.)])\s*+)?+ *+\z"


def _has_email(t: Column) -> Column:
    return F.contains(t, F.lit("@")) & t.rlike(EMAIL)


def has_contact(t: Column) -> Column:
    """Whether a text holds an address, a phone number or a link."""
    return _has_email(t) | (t.rlike(MAY_PHONE) & t.rlike(PHONE)) | (t.rlike(MAY_URL) & t.rlike(URL))


def _cut(t: Column, may: Callable[[Column], Column], pattern: str, by: str = "") -> Column:
    return let(t, lambda x: F.when(may(x), F.regexp_replace(x, pattern, by)).otherwise(x))


def without_links(t: Column) -> Column:
    """A text with a blank for each link and address."""
    return _cut(_cut(t, lambda x: x.rlike(MAY_URL), URL, " "), lambda x: F.contains(x, F.lit("@")), EMAIL, " ")


def name_token(word: Column) -> Column:
    """A word that may be part of a person's name."""
    token = F.regexp_replace(word, "^[.,;:]+|[.,;:]+$", "")
    letters = token.rlike(r"^\p{L}+$")
    shape = F.lower(token).isin(PARTICLES) | (F.length(token) == 1) | ((F.upper(token) == token) & (F.length(token) <= 15)) | token.rlike(r"^\p{Lu}\p{Ll}*$")
    return letters & shape


def looks_like_name(line: Column) -> Column:
    """A line, heading marks aside, of two to five name tokens without a word of jobs or sections."""
    ok = lambda w: name_token(w) & ~F.lower(w).isin(JOB_WORDS)
    named = lambda plain: ~F.lower(plain).isin(NO_NAMES) & F.forall(F.filter(F.split(plain, r"\s+"), lambda w: w != ""), ok)
    return line.rlike(MAY_NAME) & let(F.trim(F.regexp_replace(line, r"^#{1,6}\s+", "")), named)


_STATE = "struct<out:array<string>,contact:boolean,section:boolean,pending:boolean,skipped:int>"


def _kept_lines(t: Column) -> Column:
    """The lines that stay: a fold over the lines, whose state is whether a contact section is open, a section was seen, a name came last."""

    def step(s: Column, line: Column) -> Column:
        heading = line.startswith("##") & line.rlike(r"^##\s+\S.*$")
        labelled = (F.contains(line, F.lit(":")) | F.contains(line, F.lit("："))) & line.rlike(LABELLED)
        opens = heading & F.lower(F.trim(F.regexp_replace(line, r"^##\s+", ""))).isin(CONTACT)
        inside = ~heading & s["contact"]
        over = inside & (s["skipped"] + 1 > CONTACT_LINES)
        skipped = F.when(heading, 0).when(inside, s["skipped"] + 1).otherwise(s["skipped"])
        section, contact = s["section"] | heading, F.when(heading, opens).when(over, False).otherwise(s["contact"])
        state = lambda out, pending: F.struct(out.alias("out"), contact.alias("contact"), section.alias("section"), pending.alias("pending"), skipped.cast("int").alias("skipped")).cast(_STATE)
        name = (~section | line.startswith("#")) & looks_like_name(line)
        bare = F.trim(line)
        wrapped = s["pending"] & ~bare.startswith("#") & (bare != "") & ~bare.rlike(r"\s") & name_token(bare)
        return (
            F.when(opens, state(s["out"], F.lit(False))).when(inside & ~over, state(s["out"], s["pending"])).when(labelled, state(s["out"], F.lit(False)))
            .when(name, state(s["out"], F.lit(True))).when(wrapped, state(s["out"], F.lit(False))).otherwise(state(F.array_append(s["out"], line), F.lit(False)))
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("contact"), F.lit(False).alias("section"), F.lit(False).alias("pending"), F.lit(0).alias("skipped")).cast(_STATE)
    return F.aggregate(F.split(_cut(t, lambda x: F.contains(x, F.lit("\r")), "\r\n?", "\n"), "\n"), start, step)["out"]


def without_person(t: Column) -> Column:
    """A profile's text without labelled lines, contact sections, names, links, addresses, numbers and dates; null counts as empty."""
    lines = F.array_join(_kept_lines(F.coalesce(t, F.lit(""))), "\n")
    has = lambda mark: lambda x: F.contains(x, F.lit(mark))
    meets = lambda may: lambda x: x.rlike(may)
    kinds = [(has("]("), LINK), (has("@"), EMAIL), (meets(MAY_URL), URL), (meets(MAY_PHONE), PHONE), (meets(MAY_BIRTH), BIRTH)]
    bare = reduce(lambda c, k: _cut(c, *k), kinds, lines)
    blanked = F.transform(F.split(bare, "\n"), lambda x: F.when(x.rlike(EMPTY), "").otherwise(F.rtrim(x)))
    tight = _cut(F.array_join(blanked, "\n"), has("\n\n\n"), r"\n{3,}", "\n\n")
    # a pattern's $ stands before a line end of these, too
    odd = lambda x: reduce(lambda a, b: a | b, (x.endswith(c) for c in ("\x85", "\u2028", "\u2029")))
    return let(tight, lambda x: F.when(odd(x), F.regexp_replace(x, r"^\s+|\s+$", "")).otherwise(F.btrim(x, F.lit(" \t\n\x0b\f\r"))))


# First parts of a code host's addresses that are no owners.
RESERVED = (
    "about features pricing security enterprise customer-stories solutions open-source readme login signup settings explore trending topics collections events sponsors contact organizations "
    "site blog marketplace pulls issues notifications search"
).split()


def repository(url: Column) -> Column:
    """(owner, repo) of a repository's address in any of its forms (git@, https, bare, deep paths, .git); null for anything else."""
    found = F.regexp_extract(F.trim(url), r"^(?:(?:git@|ssh://git@)github\.com[:/]|(?:(?:https?|git|git\+https)://)?(?:www\.)?github\.com/)([A-Za-z0-9_-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?(?:[/?#].*)?$", 1)
    repo = F.regexp_extract(F.trim(url), r"^(?:(?:git@|ssh://git@)github\.com[:/]|(?:(?:https?|git|git\+https)://)?(?:www\.)?github\.com/)([A-Za-z0-9_-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?(?:[/?#].*)?$", 2)
    return F.when((found != "") & ~repo.isin("", ".", ".."), F.struct(found.alias("owner"), repo.alias("repo")))


def harvested(t: Column) -> dict[str, Column]:
    """Repositories (owner/repo) and profiles (owner) that a text links to, each once (case aside), reserved names left out."""
    first = lambda c: F.filter(c, lambda x, i: F.array_position(F.transform(c, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    direct = F.regexp_extract_all(t, F.lit(r"(?i)github\.com/([A-Za-z0-9_-]+/[A-Za-z0-9_.-]+)"), F.lit(1))
    bare = F.transform(direct, lambda r: F.regexp_replace(F.regexp_replace(r, r"[.]+$", ""), r"\.git$", ""))
    real = F.filter(bare, lambda r: ~F.lower(F.substring_index(r, "/", 1)).isin(RESERVED) & ~F.lower(F.substring_index(r, "/", -1)).isin(["", *RESERVED]))
    people = F.regexp_extract_all(t, F.lit(r"(?i)github\.com/([A-Za-z0-9_-]+)/?(?:\s|$|[),;\]>'\"])"), F.lit(1))
    return {"repositories": let(real, first), "profiles": let(F.filter(people, lambda p: ~F.lower(p).isin(RESERVED)), first)}


# Words of technical complexity, patterns of measured impact, and exercise projects.
COMPLEXITY = (
    "microservices|distributed system|hệ thống phân tán|concurrency|sharding|partitioning|replication|caching|redis cluster|load balancing|high availability|ha|fault tolerance|failover|message queue|"
    "event-driven|kafka|rabbitmq|ci/cd|unit test|integration test|benchmark|profiling|indexing|database tuning|bottleneck|thread safe|asyncio|goroutine|rate limiting|circuit breaker|idempotency|grpc|graphql"
).split("|")
IMPACT = [
    r"\b\d+[\s]*(?:%|percent|phần trăm)\b", r"\b\d+[\s]*(?:ms|s|giây|milliseconds?)\b", r"\b\d+[\s]*(?:rps|qps|tps|req/s|requests?/s)\b", r"\b\d+[\s]*(?:k|m|million|triệu|nghìn|ngàn)[\s]*(?:users?|người dùng|dau|mau|ccu)\b",
    r"\b(?:tối ưu|giảm|tăng|cải thiện|tiết kiệm|optimize|reduced?|increased?|improved?|saved)\b[\w\s]{1,30}\b\d+", r"\b(?:latency|throughput|load time|chi phí|cost|memory|cpu|bandwidth)\b",
]
EXERCISES = [
    r"web\s*(?:bán hàng|thương mại điện tử|e-commerce|shop)\s*(?:đơn giản|cơ bản)?.*(?:đăng nhập|giỏ hàng|thanh toán)", r"to-?do\s*(?:list|app|ứng dụng)", r"(?:clone|bản sao)\s*(?:facebook|trello|shopee|tik\s*tok|netflix)",
    r"quản lý\s*(?:sinh viên|thư viện|nhân sự|nhà sách|bán sách|khách sạn)\s*(?:cơ bản|đơn giản)?", r"weather\s*app|ứng dụng thời tiết", r"crud\s*(?:api|app|cơ bản)",
]


def metrics(description: Column) -> Column:
    """The distinct snippets of a description that measure impact, in the order of the patterns."""
    digits = description.rlike(r"\p{Nd}")  # without one only the last pattern finds anything
    some = lambda p: F.regexp_extract_all(description, F.lit(f"(?iuU){p}"), F.lit(0))
    each = (some(p) if p == IMPACT[-1] else F.when(digits | description.isNull(), some(p)).otherwise(F.array().cast("array<string>")) for p in IMPACT)
    return F.array_distinct(F.transform(F.concat(*each), lambda x: F.trim(x)))


def project_depth(description: Column, skills: Column, found: Column | None = None) -> Column:
    """A project's depth from 0 to 100, read from its description and the number of its skills. found: its metrics, if they are there already."""
    said = F.coalesce(description, F.lit(""))
    t = F.lower(said)
    hits = reduce(lambda a, b: a + b, (F.contains(t, F.lit(w)).cast("int") for w in COMPLEXITY))
    template = reduce(lambda a, b: a | b, (t.rlike(f"(?U){p}") for p in EXERCISES))
    total = (
        30.0 - F.when(template, 15.0).otherwise(0.0) + F.least(hits * 8.0, F.lit(35.0)) + F.least(F.size(metrics(said) if found is None else found) * 10.0, F.lit(25.0)) + F.when(skills >= 6, 15.0).when(skills >= 3, 10.0).otherwise(0.0)
        - F.when(F.length(F.trim(t)) < 60, 20.0).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(total, 1)))


def project_months(t: Column, as_of_year: int | Column) -> Column:
    """Months of a project: a range of dates, else months said, else years said after a word of duration, else three;
    null for a number that is no integer."""
    span = r"(?iu)(\d{1,2})?[/-]?(\d{4})\s*[-–—]\s*(?:(\d{1,2})?[/-]?(\d{4})|present|hiện\s*tại|nay)"
    part = lambda k, rest: let(F.regexp_extract(t, span, k), lambda x: F.coalesce(F.nullif(x, F.lit("")).try_cast("int"), F.lit(rest)))
    months = (part(4, as_of_year) - part(2, 0)) * 12 + part(3, 12) - part(1, 1)
    said = F.regexp_extract(t, r"(?iu)(\d+)\s*(?:tháng|months?|mos?)\b", 1)
    years = F.regexp_extract(t, r"(?iu)(?:thời\s*gian|thời\s*lượng|duration|kéo\s*dài)[:\s]+(\d+)\s*(?:năm|years?|yrs?)\b", 1)
    return F.when(t.rlike(span), F.greatest(months, F.lit(1))).when(said != "", said.try_cast("int")).when(years != "", years.try_cast("int") * 12).otherwise(3)
