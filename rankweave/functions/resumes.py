"""Profile texts into sections, entries and lines, and back into Markdown: column expressions, one pass over a text's lines each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions import dates
from rankweave.functions.guardrails import let
from rankweave.functions.redaction import BULLET, has_contact, looks_like_name
from rankweave.functions.unicode import trimmed

# Headings by the section that they open.
HEADINGS = {
    "Skills": ["skill", "skills", "technical skill", "technical skills", "professional skills", "specialized skills", "kỹ năng", "kĩ năng", "kỹ năng chuyên môn", "skills and knowledge", "skill and knowledge"],
    "Experience": ["experience", "work experience", "professional experience", "employment history", "kinh nghiệm", "kinh nghiệm làm việc", "kinh nghiệp làm việc", "kinh nghiệm khác"],
    "Education": ["education", "academic background", "học vấn"],
    "Projects": ["project", "projects", "personal project", "personal projects", "dự án", "dự án cá nhân", "dự án nhóm", "kinh nghiệm dự án"],
    "Certifications": ["certification", "certifications", "certifications & awards", "awards", "chứng chỉ", "chứng chỉ & giải thưởng", "giải thưởng"],
    "Languages": ["language", "languages", "ngoại ngữ"],
    "Summary": ["summary", "professional summary", "profile", "objective", "career objective", "mục tiêu nghề nghiệp", "profile summary", "target", "giới thiệu", "tự giới thiệu", "about me"],
    "Contact": ["contact", "personal information", "thông tin cá nhân", "personal details", "thông tin liên hệ"],
    "Additional Information": ["additional information", "thông tin thêm", "activities", "activity", "hoạt động", "highlights", "additional", "other"],
    "Interests": ["interests", "hobbies", "sở thích"],
}
# The label under which a section is written, in the order of labels; contact data and interests are not written.
LABELS = {
    "Summary": "Profile", "Experience": "Work Experience", "Projects": "Projects", "Education": "Education", "Skills": "Technical Skills",
    "Certifications": "Certifications", "Languages": "Additional", "Additional Information": "Additional",
}
# Words of roles, of schools and of places, and what a goal by date begins with.
ROLES = "intern associate fresher junior senior lead developer engineer programmer analyst tester designer architect manager specialist consultant administrator".split() + ["thực tập", "lập trình"]
SCHOOL = r"(?iu)university|college|đại học|cao đẳng|học viện|polytechnic|aptech|fpt|hcmut|hust"
PLACE = r"(?iu)vietnam|ha noi|hanoi|ho chi minh|hcm|đà nẵng|da nang"
GOAL = r"(?iuU)^(?:ngắn hạn|dài hạn|short-term|long-term|sau \d|after \d)\b"
# pictures' texts, tags, a watermark and characters that a reader of files leaves behind.
PICTURE = r"(?is)<!--\s*Start of picture text\s*-->.*?<!--\s*End of picture text\s*-->"
TAG, WATERMARK, LEFT_BEHIND = r"(?i)</?u>|</?b>|</?strong>|<br\s*/?>", r"(?i)(?:©\s*)?topcv\.vn", r"[\x00\x{FEFF}\x{AD}]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
NUMBERED = r"^\d+[.)]\s+"
#: Lines of a header that stand above the first dated one of a section, at most.
ABOVE = 3

_LINES = "array<string>"


def heading(line: Column) -> Column:
    """(section, rest) of a line that is a heading: a known heading's words, or these followed by others; null for any other line.

    Marks, bullets, signs and digits before it do not count, nor do case and a colon behind it. Of several headings that a line begins with the longest counts.
    """
    known = F.create_map(*(F.lit(x) for section, keys in HEADINGS.items() for k in keys for x in (k, section)))
    most = max(len(k.split()) for keys in HEADINGS.values() for k in keys)
    openers = "|".join(sorted({k.split()[0] for keys in HEADINGS.values() for k in keys}))
    may = line.rlike(rf"(?iuU)^[^\p{{L}}\p{{Nl}}\p{{No}}]*(?:{openers})(?=[\s/|:]|$)")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(line), r"^#{1,6}\s*", ""), BULLET, ""), r"^[^\p{L}\p{Nl}\p{No}]+", "")
    key = F.lower(dates.squeezed(F.regexp_replace(F.translate(bare, "/|", "  "), r"[:]+\s*$", "")))

    def find(key: Column) -> Column:
        hit = F.coalesce(*(F.when(F.try_element_at(known, F.substring_index(key, " ", n)).isNotNull(), F.substring_index(key, " ", n)) for n in range(most, 0, -1)))
        return let(hit, lambda h: F.when(h.isNotNull(), F.struct(F.try_element_at(known, h).alias("section"), F.ltrim(F.substring(key, F.length(h) + 1, F.length(key))).alias("rest"))))

    return F.when(may, let(key, find))


def _replaced(text: Column, marks: list[str], pattern: str, by: str) -> Column:
    """text with what a pattern finds replaced; a text without any of the marks, one of which all finds hold, is not looked at by the pattern."""
    return let(text, lambda t: F.when(reduce(lambda a, b: a | b, (F.contains(t, F.lit(m)) for m in marks)), F.regexp_replace(t, pattern, by)).otherwise(t))


def clean(text: Column) -> Column:
    """A text without characters that a reader of files leaves behind, line ends made \\n, no space at line ends, no gap of over two empty lines."""
    lines = _replaced(_replaced(text, ["\x00", "\ufeff", "\xad"], LEFT_BEHIND, ""), list("\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"), LINE_END, "\n")
    # space at the text's end is btrim's, but for what it leaves there: a no-break space
    bare = let(lines, lambda t: F.when(F.contains(t, F.lit(" \n")) | F.contains(t, F.lit("\t\n")) | F.contains(t, F.lit("\xa0")), F.regexp_replace(t, r"[ \t\x{A0}]+(?=\n|$)", "")).otherwise(t))
    return F.btrim(_replaced(bare, ["\n\n\n\n"], r"\n{4,}", "\n\n\n"), F.lit(" \t\n"))


def _single_gaps(lines: Column) -> Column:
    """Lines with runs of empty ones made one, and none at either end."""
    some = F.filter(lines, lambda x, i: (x != "") | ((i > 0) & (F.get(lines, i - 1) != "")))
    return let(some, lambda c: F.when((F.size(c) > 0) & (F.try_element_at(c, F.lit(-1)) == ""), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c))


def prepared(text: Column) -> Column:
    """The lines of a profile: trimmed, without heading marks, tags and watermarks; lines without a letter or digit count as empty."""
    bare = reduce(lambda c, p: _replaced(c, *p), [(["<"], PICTURE, "\n"), (["<"], TAG, "\n"), ([".v", ".V"], WATERMARK, "")], F.coalesce(text, F.lit("")))
    shown = lambda x: F.when(x.startswith("#"), F.regexp_replace(x, r"^#{1,6}\s*", "")).otherwise(x)
    one = lambda x: F.when(x.rlike(r"^[^\p{L}\p{N}]*$"), "").otherwise(F.trim(shown(x)))
    return let(F.transform(F.split(clean(bare), "\n"), lambda x: let(trimmed(x), one)), _single_gaps)


def sections(lines: Column) -> Column:
    """array<struct<section, lines>>: what stands before the first heading as `preamble`, then each heading's lines."""

    def cut(names: Column) -> Column:
        heads = F.filter(F.transform(names, lambda n, i: F.when(n.isNotNull(), i)), lambda i: i.isNotNull())

        def at(heads: Column) -> Column:
            end = lambda j: F.coalesce(F.get(heads, j), F.size(lines))
            part = lambda name, a, b: F.struct(name.alias("section"), F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))).alias("lines"))
            first = F.array(part(F.lit("preamble"), F.lit(0), end(F.lit(0))))
            return F.concat(first, F.transform(heads, lambda h, j: part(F.get(names, h), h + 1, end(j + 1))))

        return let(heads, at)

    return let(F.transform(lines, lambda x: heading(x)["section"]), cut)


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET)


def unmarked(line: Column) -> Column:
    """A line without its bullet."""
    return F.trim(F.regexp_replace(line, BULLET, ""))


def _may_head(line: Column) -> Column:
    """Whether a line may belong to an entry's header: short, not beginning in lower case, no grade."""
    return let(unmarked(line), lambda t: (t != "") & (F.length(t) <= 90) & ~t.rlike(r"^\p{Ll}") & ~t.rlike(r"(?iuU)^gpa\b"))


def joined(lines: Column) -> Column:
    """A section's lines with broken ones joined again: a line that is no bullet, header or date goes on with a bullet, with a line that ends in a
    comma or connecting word, or, in lower case, with a long one. Runs of empty lines are one, none stands at the end.

    A fold over the lines, as whether a line goes on depends on what was joined before it.
    """
    state = "struct<out:array<string>,last:string>"
    make = lambda out, last: F.struct(out.alias("out"), last.alias("last")).cast(state)

    def step(s: Column, x: Column) -> Column:
        last = s["last"]
        open_end = last.rlike(r"(-|,|;|and|và|the|of|to|for|with)$")
        lower = x.rlike(r"^\p{Ll}")
        no_header = lower | (F.length(x) > 90) | x.rlike(r"(?iuU)^gpa\b")  # of a line that is no bullet
        goes_on = F.coalesce(last != "", F.lit(False)) & no_header & ~is_bullet(x) & (is_bullet(last) | (lower & (F.length(last) > 40)) | open_end) & ~dates.has_range(x)
        before = F.when(last.isNull(), s["out"]).otherwise(F.array_append(s["out"], last))
        again = (x == "") & F.coalesce(last == "", F.lit(True))
        return F.when(again, s).when((x != "") & goes_on, make(s["out"], F.concat_ws(" ", last, x))).otherwise(make(before, x))

    start = make(F.array().cast(_LINES), F.lit(None).cast("string"))
    return F.aggregate(lines, start, step, lambda s: F.when(F.coalesce(s["last"], F.lit("")) == "", s["out"]).otherwise(F.array_append(s["out"], s["last"])))


def no_prose(line: Column) -> Column:
    """Whether a line may open an entry, were it dated: it is no long prose."""
    return ~((F.length(line) > 120) & (F.length(dates.without_ranges(line)) > 80))


def _names_role(line: Column) -> Column:
    return let(F.lower(line), lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in ROLES)))


def title_and_place(header: Column, education: Column) -> Column:
    """(title, org) of an entry's header lines: parts between bars; in education the school and the first other line; else the first line as the
    title if it has a role's word, the second one if not."""
    tidy = F.transform(F.filter(header, lambda x: (F.trim(x) != "") & (F.length(x) < 120)), lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(" -|")))
    pair = lambda title, org: F.struct(F.coalesce(title, F.lit("")).alias("title"), F.coalesce(org, F.lit("")).alias("org"))

    def split(c: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.array_join(c, " | "), r"\s*\|\s*"), lambda p: F.trim(p)), lambda p: p != "")
        school = F.coalesce(F.get(F.filter(c, lambda x: x.rlike(SCHOOL)), F.lit(0)), F.get(c, F.lit(0)))
        one, two = F.get(c, F.lit(0)), F.get(c, F.lit(1))
        other = F.when(_names_role(one), pair(one, two)).otherwise(pair(F.coalesce(two, one), one))
        taught = let(school, lambda s: pair(F.get(F.filter(c, lambda x: (x != s) & ~x.rlike(PLACE)), F.lit(0)), s))
        barred = F.when(F.exists(c, lambda x: F.contains(x, F.lit(" | "))), parts)
        choose = lambda p: F.when(F.size(p) >= 2, pair(F.get(p, F.lit(0)), F.get(p, F.lit(1)))).when(education, taught).otherwise(other)
        return F.when(F.size(c) == 0, pair(F.lit(""), F.lit(""))).otherwise(let(barred, choose))

    return let(tidy, split)


def entries(lines: Column, education: Column, as_of: Column) -> Column:
    """array<struct<title, org, dates, bullets>> of a section's joined lines: each dated line opens an entry, up to three header lines above the first
    dated one belong to it; null if no line is dated."""

    def entry(chunk: Column) -> Column:
        full = F.filter(chunk, lambda x: x != "")
        named = r"(?iu)^(?:position|role|title|vai trò(?: cá nhân)?)\s*:\s*"

        def read(c: Column) -> Column:
            def rest_of(dated: Column) -> Column:
                top = F.get(c, dated)

                def with_rest(rest: Column) -> Column:
                    headline = lambda x, i: F.when(i == dated, F.when((rest != "") & ~rest.rlike(r"(?iuU)^gpa\b"), rest)).when(is_bullet(x), None).when(F.lower(x).rlike("^(position:|role:|vai trò|title:)"), F.regexp_replace(x, named, "")).otherwise(x)
                    said = lambda x, i: F.when((i != dated) & is_bullet(x), F.trim(F.regexp_replace(F.regexp_replace(x, NUMBERED, ""), BULLET, "")))
                    header, bullets = F.array_compact(F.transform(c, headline)), F.array_compact(F.transform(c, said))
                    kept = F.filter(bullets, lambda b: (b != "") & ~b.rlike(r"(?U)^[\w\s/&+-]{1,40}:$"))
                    return let(title_and_place(header, education), lambda t: F.struct(t["title"].alias("title"), t["org"].alias("org"), let(top, lambda x: dates.range_label(x, as_of)).alias("dates"), kept.alias("bullets")))

                return let(F.coalesce(let(top, dates.without_ranges), F.lit("")), with_rest)

            return let(F.array_position(F.transform(c, lambda x: dates.has_range(x)), True) - 1, rest_of)

        return let(full, read)

    def cut(starts: Column) -> Column:
        first = F.get(starts, F.lit(0))
        above = lambda k: let(F.get(lines, first - k), lambda x: F.coalesce((first >= k) & (x != "") & ~dates.has_range(x) & ~is_bullet(x) & _may_head(x), F.lit(False)))
        run = lambda k: reduce(lambda a, b: a & b, (above(j) for j in range(1, k + 1)))
        taken = reduce(lambda c, k: c.when(run(k), k), range(ABOVE - 1, 0, -1), F.when(run(ABOVE), ABOVE)).otherwise(0)
        begin = lambda s, j: F.when(j == 0, s - taken).otherwise(s)
        return F.when(F.size(starts) > 0, F.transform(starts, lambda s, j: entry(F.slice(lines, begin(s, j) + 1, F.coalesce(F.get(starts, j + 1), F.size(lines)) - begin(s, j)))))

    return let(F.filter(F.transform(lines, lambda x, i: F.when(dates.has_range(x) & no_prose(x), i)), lambda i: i.isNotNull()), cut)


def as_content(lines: Column) -> Column:
    """Lines as they are written under a label: bullets as `- `, empty ones left out."""
    item = lambda x: F.when(is_bullet(x), let(unmarked(x), lambda t: F.when(t != "", F.concat(F.lit("- "), t)))).otherwise(F.when(x != "", x))
    return F.filter(F.transform(lines, item), lambda x: x.isNotNull())


def written(found: Column) -> Column:
    """Lines of entries: `### title | org | dates`, its bullets, an empty line between entries."""

    def lines(e: Column, i: Column) -> Column:
        bits = F.array_distinct(F.filter(F.array(e["title"], e["org"]), lambda x: x != ""))
        top = F.concat(F.lit("### "), F.array_join(F.concat(bits, F.array(e["dates"])), " | "))
        return F.concat(F.when(i > 0, F.array(F.lit(""))).otherwise(F.array().cast(_LINES)), F.array(top), F.transform(e["bullets"], lambda b: F.concat(F.lit("- "), b)))

    return F.flatten(F.transform(found, lines))


def headline(preamble: Column) -> Column:
    """The first line before any heading, of at most eight words, with a role's word in it; empty without one."""
    some = F.filter(preamble, lambda x: _names_role(x) & let(F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")), lambda n: n.between(1, 8)))
    return F.coalesce(F.btrim(F.regexp_replace(F.get(some, F.lit(0)), r"^#+\s*", ""), F.lit(" -|")), F.lit(""))


def profile(lines: Column, head: Column) -> Column:
    """A summary's lines as one, without goals by date; the headline where nothing is left."""
    plain = F.transform(F.filter(lines, lambda x: ~unmarked_start(x).rlike(GOAL)), lambda x: F.when(is_bullet(x), F.nullif(unmarked(x), F.lit(""))).otherwise(x))
    return let(F.trim(F.array_join(F.array_compact(plain), " ")), lambda text: F.when(text != "", text).otherwise(F.nullif(head, F.lit(""))))


def unmarked_start(line: Column) -> Column:
    return F.regexp_replace(line, BULLET, "")


def opening(lines: Column, head: Column) -> Column:
    """Long lines before any heading that are no name, contact data or the headline, as one; null without any."""
    some = F.filter(lines, lambda x: (F.length(x) >= 40) & ~looks_like_name(x) & ~has_contact(x) & ~((head != "") & (x == head)))
    return let(some, lambda c: F.when(F.size(c) > 0, F.array_join(c, " ")))


def body(parts: Column, head: Column) -> Column:
    """Markdown of array<struct<section, lines, entries>>: one block a label, in the order of labels.

    The profile is the opening, else the first summary, else the headline, else the first title of the work experience.
    """
    dated = ("Experience", "Projects", "Education")
    content = lambda p: F.when(p["section"].isin(*dated), F.coalesce(written(p["entries"]), as_content(p["lines"]))).otherwise(as_content(p["lines"]))
    under = lambda label: F.flatten(F.transform(F.filter(parts, lambda p: p["section"].isin(*(s for s, to in LABELS.items() if to == label)) & (F.size(p["lines"]) > 0)), content))
    title = lambda work: F.trim(F.substring_index(F.substring(F.get(F.filter(work, lambda x: x.startswith("### ")), F.lit(0)), 5, 1 << 30), "|", 1))
    summaries = F.array_compact(F.transform(F.filter(parts, lambda p: (p["section"] == "Summary") & (F.size(p["lines"]) > 0)), lambda p: profile(p["lines"], head)))
    first = lambda work: F.coalesce(opening(F.get(parts, F.lit(0))["lines"], head), F.get(summaries, F.lit(0)), F.nullif(head, F.lit("")), F.nullif(title(work), F.lit("")))
    block = lambda label, lines: let(lines, lambda c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {label}\n\n"), F.array_join(c, "\n"))))

    def write(work: Column) -> Column:
        blocks = [block("Profile", F.array_compact(F.array(first(work)))), *(block(label, work if label == "Work Experience" else under(label)) for label in dict.fromkeys(LABELS.values()) if label != "Profile")]
        return F.array_join(F.array_compact(F.array(*blocks)), "\n\n")

    return let(under("Work Experience"), write)


def seniority(head: Column, parts: Column, years: Column) -> Column:
    """The level said in the headline or the first four lines of sections of work, else by years."""
    said = F.filter(parts, lambda p: p["section"].isin("Experience", "Projects", "preamble"))
    blob = F.lower(F.array_join(F.concat(F.array(head), F.flatten(F.transform(said, lambda p: F.slice(p["raw"], 1, 4)))), " "))
    any_of = lambda x, *words: reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in words))
    level = lambda x: (
        F.when(any_of(x, "intern", "thực tập", "thuc tap", "fresher"), "intern")
        .when(any_of(x, "principal", "staff engineer", "lead", "senior") & x.rlike(r"(?U)\b(principal|staff engineer|tech lead|team lead|lead\b|senior)\b"), "senior").when(any_of(x, "junior", "jr") & x.rlike(r"(?U)\b(junior|jr\.?)\b"), "junior")
        .when(years >= 5, "senior").when(years >= 2, "mid").when(years >= 1, "junior").otherwise("intern")
    )
    return let(blob, level)


def scalar(value: Column) -> Column:
    """A value as YAML writes it, in quotes where it must be."""
    odd = (value == "") | value.rlike(r"[ :#{}\[\],&*?|>!%@`'\"]") | value.startswith("-")
    return F.when(odd, F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(value)
