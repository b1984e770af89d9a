"""Rules over single records: gates of parsed texts, maintained columns, labels of compared items, escaped files, benchmarks of roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.guardrails import let
from rankweave.functions.text import ACCENTED, FOLDED

# Years and words of each level of a role.
LEVELS = {
    "intern": (0, "Thực tập sinh (Intern)"), "fresher": (1, "Mới tốt nghiệp / Dưới 1 năm kinh nghiệm (Fresher)"), "junior": (2, "1-2 năm kinh nghiệm (Junior)"), "middle": (3, "2-4 năm kinh nghiệm (Middle)"),
    "senior": (5, "5+ năm kinh nghiệm (Senior)"), "lead": (7, "7+ năm kinh nghiệm / Trưởng nhóm (Technical Lead / Principal)"),
}
#: Advanced skills that a level from middle on asks for, and core skills of a beginner.
ADVANCED, BEGINNER = 4, 5
ANSWERS = ["confirmed", "declined", "reschedule_requested"]


def parsed_gate(text: Column, low_content: Column) -> Column:
    """degrade for a parsed text that is blank or was marked as low in content, else pass; a null text is blank."""
    blank = F.coalesce(F.regexp_replace(text, r"(?U)\s+", ""), F.lit("")) == ""
    return F.when(blank | F.coalesce(low_content, F.lit(False)), "degrade").otherwise("pass")


def responded_at(old_status: Column, new_status: Column, at: Column, now: Column) -> Column:
    """When an invitation was answered: now, where its status leaves pending for an answer and no time is given; else as it is."""
    return F.when(~new_status.eqNullSafe(old_status) & (old_status == "pending") & new_status.isin(ANSWERS) & at.isNull(), now).otherwise(at)


def read_at(old_read: Column, new_read: Column, old_at: Column, new_at: Column, now: Column) -> Column:
    """When a notice was read: now, where it becomes read or its time was missing; none, where it is unread; else as it is."""
    return F.when(new_read & (old_at.isNull() | ~old_read), now).when(~new_read, None).otherwise(new_at)


def escaped_file(content: Column, most: int) -> Column:
    """A file's first characters in which no tag of files can open or close; null counts as empty."""
    cut = F.substring(F.coalesce(content, F.lit("")), 1, most)
    return F.replace(F.replace(cut, F.lit("</file>"), F.lit("&lt;/file&gt;")), F.lit("<file"), F.lit("&lt;file"))


def plain(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, FOLDED)


def label_of(raw: Column, keys: Column, kinds: tuple[str, str], prefix: str) -> Column:
    """The key that a model means: by its name, accents and case aside; by its last word alone or behind one of the kinds; by its number anywhere
    in what was said. The first key that fits counts; null for none."""
    said = F.trim(raw)
    same = lambda k: (F.lower(k) == F.lower(said)) | (plain(k) == plain(said))

    def lettered(k: Column) -> Column:
        letter = F.lower(F.element_at(F.split(k, " "), -1))
        return (letter == F.lower(said)) | (F.concat(F.lit(f"{kinds[0]} "), letter) == F.lower(said)) | F.exists(F.array(*(F.lit(x) for x in kinds)), lambda x: F.concat(plain(x), F.lit(" "), letter) == plain(said))

    first = lambda found: F.get(found, F.lit(0))
    number = lambda i: (i + 1).cast("string")
    return F.coalesce(first(F.filter(keys, same)), first(F.filter(keys, lettered)), first(F.filter(keys, lambda k, i: F.contains(said, number(i)) | F.contains(F.lower(said), F.concat(F.lit(f"{prefix}_"), number(i))))))


def benchmark(role: Column, level: Column, catalog: Column) -> Column:
    """struct<category, name, level, label, years, skills> of a role's benchmark.

    catalog: array<struct<category, aliases, name, core, advanced>> in its order; the first entry counts of which an alias holds the role or is held by it, else the first
    entry. An unknown level counts as middle. Beginners are asked for the first core skills, juniors for all, others for the first advanced ones too.
    """
    said = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    named = F.when(said == "", F.lit("software engineer")).otherwise(said)
    asked = F.lower(F.trim(F.coalesce(level, F.lit("middle"))))
    step = F.when(asked.isin(*LEVELS), asked).otherwise("middle")
    fits = F.filter(catalog, lambda e: F.exists(e["aliases"], lambda a: F.contains(named, a) | F.contains(a, named)))
    years = F.create_map(*(F.lit(x) for k, (n, _) in LEVELS.items() for x in (k, n)))
    labels = F.create_map(*(F.lit(x) for k, (_, label) in LEVELS.items() for x in (k, label)))

    def of(e: Column) -> Column:
        more = F.array_distinct(F.concat(e["core"], F.slice(e["advanced"], 1, ADVANCED)))
        wanted = F.when(step.isin("intern", "fresher"), F.slice(e["core"], 1, BEGINNER)).when(step == "junior", e["core"]).otherwise(more)
        return F.struct(e["category"].alias("category"), e["name"].alias("name"), step.alias("level"), F.element_at(labels, step).alias("label"), F.element_at(years, step).alias("years"), wanted.alias("skills"))

    return let(F.coalesce(F.get(fits, F.lit(0)), F.get(catalog, F.lit(0))), of)
