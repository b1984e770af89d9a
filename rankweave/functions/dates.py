"""Dates and ranges of dates said in free text, and the time that ranges cover together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.guardrails import let

# How dates, ranges of dates and an open end are written.
MONTH_NAME = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
NUMBERED = r"(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}[/-]\d{4}|\d{4})"
NAMED = rf"(?:{MONTH_NAME}\.?\s+\d{{1,2}},?\s+\d{{4}}|{MONTH_NAME}\.?\s+\d{{4}})"
PRESENT = "(?:present|now|current|nay|today|hiện tại|hien tai|hiện nay|hien nay)"
RANGE = rf"(?iuU)((?:{NAMED}|{NUMBERED}))\s*(?:[-–—]|to)\s*(expected\s+)?((?:{NAMED}|{NUMBERED})|{PRESENT})"
NAMED_RANGE = rf"(?iuU)({MONTH_NAME}\.?\s+\d{{4}})\s+({MONTH_NAME}\.?\s+\d{{4}})"
NUMBERED_RANGE = r"(?U)(\d{1,2}[/-]\d{4})\s+(\d{1,2}[/-]\d{4})"
#: What a line with any range of dates has, cheap to look for: two digits before a dash or `to`, or a year before what may begin a date.
MAY_RANGE = r"(?U)\p{Nd}{2}(?:\s*(?:[-–—]|[tT][oO])|(?<=\p{Nd}{4})\s+[\p{L}\p{Nd}])"
#: The three patterns with the groups that hold their ends, in the order in which they are tried.
RANGES = [(RANGE, 1, 3), (NAMED_RANGE, 1, 2), (NUMBERED_RANGE, 1, 2)]
# Years of experience as texts claim them.
CLAIMED = [
    r"(?U)(\d+)\+?\s*(?:years?|năm)\s*(?:experience|kinh\s*nghiệm)",
    r"(?U)kinh\s*nghiệm[:\s]*(\d+)\s*(?:years?|năm)",
    r"(?U)(\d+)\+?\s*(?:yr|y)\.?\s*(?:exp|experience)",
]

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def _first_of(year: Column, month: Column) -> Column:
    return F.when(month.between(1, 12) & year.between(1, 9999), F.make_date(year, month, F.lit(1)))


def first_of_month(token: Column, as_of: Column) -> Column:
    """The first of the month that a token names: d/m/y (a month beyond 12 and the day change places, a year of two digits is of this century), m/y,
    a month's name with or without a day, a year alone (January); as_of for an open end; null for anything else."""
    number = lambda t, p, k: F.regexp_extract(t, p, k).try_cast("int")

    def read(t: Column) -> Column:
        full, short, name, year = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$", r"^(\d{1,2})[/-](\d{4})$", rf"(?i)^({MONTH_NAME})\.?\s+(?:\d{{1,2}},?\s+)?(\d{{4}})$", r"^(\d{4})$"
        a, b, y = (number(t, full, k) for k in (1, 2, 3))
        month = F.when((b > 12) & (a <= 12), a).otherwise(b)
        named = ((F.instr(F.lit(_MONTHS), F.lower(F.substring(t, 1, 3))) + 2) / 3).cast("int")
        return (
            F.when(t.rlike(f"(?iu)^{PRESENT}$"), as_of)
            .when(t.rlike(full), _first_of(F.when(y < 100, y + 2000).otherwise(y), month))
            .when(t.rlike(short), _first_of(number(t, short, 2), number(t, short, 1)))
            .when(t.rlike(name), _first_of(number(t, name, 2), named))
            .when(t.rlike(year), _first_of(number(t, year, 1), F.lit(1)))
        )

    return let(F.regexp_replace(squeezed(token), r"[.]+$", ""), read)


def pretty(token: Column, as_of: Column) -> Column:
    """A date as `Mar 2021`, an open end as Present, anything else as it stands."""
    return let(squeezed(token), lambda t: F.when(t.rlike(f"(?iu)^{PRESENT}$"), "Present").otherwise(F.coalesce(F.date_format(first_of_month(t, as_of), "MMM yyyy"), t)))


def has_range(line: Column) -> Column:
    """Whether a line holds a range of dates; most lines have no digits before a dash or date and need no look at the patterns."""
    return line.rlike(MAY_RANGE) & (line.rlike(RANGE) | line.rlike(NAMED_RANGE) | line.rlike(NUMBERED_RANGE))


def range_label(line: Column, as_of: Column) -> Column:
    """The first range of dates in a line as `Mar 2021 - Present`; empty without one."""
    out = F.lit("")
    for pattern, a, b in reversed(RANGES):
        ends = (F.regexp_extract(line, pattern, k) for k in (a, b))
        out = F.when(line.rlike(pattern), F.concat_ws(" - ", *(pretty(x, as_of) for x in ends))).otherwise(out)
    return out


def without_ranges(line: Column) -> Column:
    """A line without its ranges of dates, spaces squeezed, and without dashes, bars and brackets at its ends; lines that can't have a range are only
    squeezed."""
    cut = reduce(lambda c, r: F.regexp_replace(c, r[0], ""), RANGES, line)
    return F.btrim(F.regexp_replace(F.when(line.rlike(MAY_RANGE), cut).otherwise(line), r"(?U)\s+", " "), F.lit(" -–—|()"))


def intervals(lines: Column, as_of: Column) -> Column:
    """All ranges of dates in an array of lines whose end is not before their start, as array<struct<start, end>>."""

    def pairs(line: Column, pattern: str, a: int, b: int) -> Column:
        ends = F.regexp_extract_all(line, F.lit(pattern), F.lit(b))
        return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(a)), lambda s, i: F.struct(first_of_month(s, as_of).alias("start"), first_of_month(F.get(ends, i), as_of).alias("end")))

    def of(line: Column) -> Column:
        return F.concat(*(pairs(line, *r) for r in RANGES))

    return F.filter(F.flatten(F.transform(F.filter(lines, has_range), of)), lambda x: x["end"] >= x["start"])


def merged_months(found: Column) -> Column:
    """The months that intervals (array<struct<start, end>>) cover together: one sweep over them by their start, inside the row."""
    months = lambda a, b: (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    state = "struct<months:int,start:date,end:date>"
    make = lambda m, a, b: F.struct(m.cast("int").alias("months"), a.alias("start"), b.alias("end")).cast(state)

    def sweep(s: Column, x: Column) -> Column:
        apart = s["end"].isNull() | (x["start"] > s["end"])
        return F.when(apart, make(s["months"] + F.coalesce(months(s["start"], s["end"]), F.lit(0)), x["start"], x["end"])).otherwise(make(s["months"], s["start"], F.greatest(s["end"], x["end"])))

    none = make(F.lit(0), F.lit(None).cast("date"), F.lit(None).cast("date"))
    return F.aggregate(F.array_sort(found), none, sweep, lambda s: s["months"] + F.coalesce(months(s["start"], s["end"]), F.lit(0)))


def years_of(months: Column) -> Column:
    """Months in whole years, halves to the even one."""
    return F.bround(months / 12, 0).cast("int")


def claimed_years(text: Column) -> Column:
    """The years of experience that a text claims in words; null without a claim."""
    number = lambda t, p: let(F.regexp_extract(t, p, 1), lambda n: F.nullif(n, F.lit("")).try_cast("int"))
    return let(F.lower(text), lambda t: F.coalesce(*(number(t, p) for p in CLAIMED)))
