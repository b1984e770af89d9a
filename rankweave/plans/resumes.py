"""Resume structuring over the documents' own lines, with headings, dates and bullets put between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import dates, redaction, resumes
from rankweave.functions.text import sql_matched
from rankweave.operators import projects, skills
from rankweave.operators import resumes as structuring
from rankweave.plans.registry import query
from rankweave.plans.retrieval import _TAXONOMY
from rankweave.sources.tables import spread, table

AS_OF = "2026-06-15"
_HEADINGS = [
    "💼 KINH NGHIỆM / DỰ ÁN", "Work Experience:", "## Education", "DỰ ÁN", "• Skills and Knowledge", "Summary", "3. Chứng chỉ & giải thưởng", "Thông tin liên hệ", "HỌC VẤN", "Personal   Projects", "Experience and more",
    "Ngoại ngữ", "HOBBIES", "Kinh nghiệm làm việc tại đây", "Mục tiêu nghề nghiệp", "Other", "Experienced", "The skills",
]
_DATES = [
    "Mar 2019 - Present", "03/2018 - 12/2020", "2015 – 2017", "June 2020 to Expected May 2021", "1/2/2016 - 15/6/2018", "Sep 2014 Dec 2015", "05/2010 07/2012", "13/13/2019 - 2020", "Sept. 2021 — hiện tại", "10/25/19 - 11/26/20",
]
_FACTS = [
    "reduced latency by 40 ms for 2k users", "40% faster, 3 months of kafka, caching and sharding", "saved cost: 120 ms and 900 rps, duration: 2 years", "a to-do list of grpc and graphql", "Cost, cost and 35%x less memory",
]


def _profile(docs):
    """The documents as profiles: of each nine lines one has a heading above it, one dates behind it, one facts, two are bullets, two begin with a label."""
    names, spans, facts = (F.array(*map(F.lit, x)) for x in (_HEADINGS, _DATES, _FACTS))

    def line(x, i):
        k, n = F.pmod(F.col("doc_id") * 7 + i, F.lit(9)), F.col("doc_id") + i
        return (
            F.when(k == 0, F.concat(F.get(names, F.pmod(n, F.lit(len(_HEADINGS))).cast("int")), F.lit("\n"), x)).when(k == 3, F.concat(F.replace(x, F.lit(". "), F.lit(" | ")), F.lit(" | "), F.get(spans, F.pmod(n, F.lit(len(_DATES))).cast("int"))))
            .when(k.isin(4, 5), F.concat(F.lit("- "), x)).when(k == 2, F.concat(F.lit("Position: "), x)).when(k == 6, F.concat(x, F.lit(" "), F.get(facts, F.pmod(n, F.lit(len(_FACTS))).cast("int"))))
            .when(k == 7, F.concat(F.lit("Company - "), x)).otherwise(x)
        )

    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


_QUOTED = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_TEXTS = f"""texts AS (SELECT doc_id AS doc, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE (doc_id * 7 + i - 1) % 9
  WHEN 0 THEN {_QUOTED(_HEADINGS)}[(doc_id + i - 1) % {len(_HEADINGS)} + 1] || chr(10) || x
  WHEN 3 THEN replace(x, '. ', ' | ') || ' | ' || {_QUOTED(_DATES)}[(doc_id + i - 1) % {len(_DATES)} + 1] WHEN 4 THEN '- ' || x WHEN 5 THEN '- ' || x WHEN 2 THEN 'Position: ' || x
  WHEN 6 THEN x || ' ' || {_QUOTED(_FACTS)}[(doc_id + i - 1) % {len(_FACTS)} + 1] WHEN 7 THEN 'Company - ' || x ELSE x END), chr(10)) AS text FROM documents)"""
_HEADS = "heads(k, name) AS (VALUES " + ", ".join(f"('{k}', '{name}')" for name, keys in resumes.HEADINGS.items() for k in keys) + ")"
_RE2 = lambda p: p.replace("(?iuU)", "(?i)").replace("(?U)", "").replace("(?iu)", "(?i)").replace("'", "''")
_BULLET = _RE2(resumes.BULLET)
_HAS = lambda x: "(" + " OR ".join(f"regexp_matches({x}, '{_RE2(p)}')" for p, _, _ in dates.RANGES) + ")"


def _without(x: str) -> str:
    for p, _, _ in dates.RANGES:
        x = f"regexp_replace({x}, '{_RE2(p)}', '', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' -–—|()')"


#: Lines of all texts, without runs of empty ones, with the heading that each is and the number of headings up to it.
_LINES = rf"""{_TEXTS}, {_HEADS},
cut AS (SELECT doc, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT doc, list_transform(string_split(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x{{FEFF}}\x{{AD}}]', '', 'g'), '(?i)</?u>|</?b>|</?strong>|<br\s*/?>', chr(10), 'g'), '[ \t\x{{A0}}]+(\n|$)', '\1', 'g'), chr(10) || ' ' || chr(9)), chr(10)), lambda y: CASE WHEN regexp_full_match(y, '[^\p{{L}}\p{{N}}]*') THEN '' ELSE trim(regexp_replace(trim(y, ' ' || chr(9)), '^#{{1,6}}\s*', '')) END) AS a FROM texts)),
gaps AS (SELECT * FROM cut WINDOW w AS (PARTITION BY doc ORDER BY i) QUALIFY x <> '' OR (lag(x) OVER w <> '' AND bool_or(x <> '') OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))),
keyed AS (SELECT *, trim(lower(regexp_replace(trim(regexp_replace(translate(regexp_replace(regexp_replace(x, '{_BULLET}', ''), '^[^\p{{L}}\p{{Nl}}\p{{No}}]+', ''), '/|', '  '), ':+\s*$', '')), '\s+', ' ', 'g'))) AS key FROM gaps),
named AS (SELECT doc, i, arg_max(name, length(k)) AS name FROM keyed JOIN heads ON key = k OR starts_with(key, k || ' ') GROUP BY ALL),
l AS (SELECT keyed.doc, keyed.i, x, name, count(name) OVER (PARTITION BY keyed.doc ORDER BY keyed.i) AS place FROM keyed LEFT JOIN named ON named.doc = keyed.doc AND named.i = keyed.i)"""
#: The sections' lines with broken ones joined: j numbers them, x is their text.
_JOINED = rf"""{_LINES},
held AS (SELECT doc, place, row_number() OVER (PARTITION BY doc, place ORDER BY i) AS i, x FROM l WHERE name IS NULL),
facts AS MATERIALIZED (SELECT *, regexp_matches(x, '{_BULLET}') AS bullet, regexp_matches(x, '^\p{{Ll}}') AS low, regexp_matches(x, '^\p{{Ll}}') OR length(x) > 90 OR regexp_matches(x, '(?i)^gpa\b') AS no_head, {_HAS("x")} AS dated, regexp_matches(x, '(-|,|;|and|và|the|of|to|for|with)$') AS open_end FROM held),
walk(doc, place, i, grp, size, bullet, open_end) AS (SELECT doc, place, i, 1, length(x), bullet, open_end FROM facts WHERE i = 1
  UNION ALL SELECT doc, place, i, CASE WHEN on_ THEN grp ELSE grp + 1 END, CASE WHEN on_ THEN size + 1 + length(x) ELSE length(x) END, CASE WHEN on_ THEN b0 ELSE bullet END, open_end
  FROM (SELECT f.*, walk.grp, walk.size, walk.bullet AS b0, walk.size > 0 AND f.x <> '' AND f.no_head AND NOT f.bullet AND NOT f.dated AND (walk.bullet OR (f.low AND walk.size > 40) OR walk.open_end) AS on_ FROM walk JOIN facts f ON f.doc = walk.doc AND f.place = walk.place AND f.i = walk.i + 1)),
whole AS (SELECT doc, place, grp, string_agg(x, ' ' ORDER BY i) AS x FROM walk JOIN facts USING (doc, place, i) GROUP BY ALL),
part AS (SELECT doc, place, coalesce(any_value(name), 'preamble') AS section FROM (SELECT doc, place, name FROM l UNION ALL SELECT doc, 0, NULL FROM texts) GROUP BY ALL),
j AS MATERIALIZED (SELECT doc, place, section, row_number() OVER w AS j, x FROM part JOIN whole USING (doc, place) WINDOW w AS (PARTITION BY doc, place ORDER BY grp) QUALIFY x <> '' OR (lag(x) OVER w <> '' AND bool_or(x <> '') OVER (PARTITION BY doc, place ORDER BY grp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) OR (row_number() OVER w = 1 AND bool_or(x <> '') OVER (PARTITION BY doc, place)))"""


@query(f"WITH RECURSIVE {_JOINED} SELECT doc, place::INT AS place, section, count(x)::INT AS lines, md5(coalesce(string_agg(x, chr(10) ORDER BY j), '')) AS digest FROM part LEFT JOIN j USING (doc, place, section) GROUP BY ALL")
def resume_sections(spark, sf_dir):
    """The sections of each profile under their canonical names, broken lines joined."""
    found = structuring.sectioned(_profile(table(spark, sf_dir, "documents")), "doc_id", "text", F.lit(AS_OF).cast("date"))
    return found.select("doc", F.col("at").alias("place"), "section", F.size("lines").alias("lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


def _date(token: str) -> tuple[str, str]:
    """SQL of a date token without outer space and stops, and of the first of its month."""
    t = f"regexp_replace(trim(regexp_replace({token}, '\\s+', ' ', 'g')), '[.]+$', '')"
    part = lambda p, k: f"regexp_extract({t}, '{p}', {k})::INT"
    full, short, name = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$", r"^(\d{1,2})[/-](\d{4})$", r"(?i)^([a-z]{3})[a-z]*\.?\s+(?:\d{1,2},?\s+)?(\d{4})$"
    a, b, y = (part(full, k) for k in (1, 2, 3))
    year, month = f"CASE WHEN {y} < 100 THEN {y} + 2000 ELSE {y} END", f"CASE WHEN {b} > 12 AND {a} <= 12 THEN {a} ELSE {b} END"
    return t, f"""CASE WHEN regexp_full_match({t}, '(?i){dates.PRESENT}') THEN DATE '{AS_OF}'
  WHEN regexp_matches({t}, '{full}') THEN CASE WHEN {month} BETWEEN 1 AND 12 THEN make_date({year}, {month}, 1) END
  WHEN regexp_matches({t}, '{short}') THEN CASE WHEN {part(short, 1)} BETWEEN 1 AND 12 THEN make_date({part(short, 2)}, {part(short, 1)}, 1) END
  WHEN regexp_matches({t}, '{name}') THEN make_date({part(name, 2)}, ((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(left({t}, 3))) + 2) // 3)::INT, 1) ELSE make_date({t}::INT, 1, 1) END"""


def _label(token: str) -> str:
    """SQL of a date as it is written in an entry's heading."""
    t, day = _date(token)
    return f"CASE WHEN regexp_full_match({t}, '(?i){dates.PRESENT}') THEN 'Present' ELSE coalesce(strftime({day}, '%b %Y'), {t}) END"


def _span(x: str) -> str:
    first, named, numbered = (
        f"{_label(f"regexp_extract({x}, '{_RE2(p)}', {a})")} || ' - ' || {_label(f"regexp_extract({x}, '{_RE2(p)}', {b})")}" for p, a, b in dates.RANGES
    )
    return f"CASE WHEN regexp_matches({x}, '{_RE2(dates.RANGE)}') THEN {first} WHEN regexp_matches({x}, '{_RE2(dates.NAMED_RANGE)}') THEN {named} ELSE {numbered} END"


_ROLE = " OR ".join(f"contains(lower(h[1]), '{w}')" for w in resumes.ROLES)


@query(rf"""WITH RECURSIVE {_JOINED},
d AS (SELECT *, {_HAS("x")} AS has, {_HAS("x")} AND NOT (length(x) > 120 AND length({_without("x")}) > 80) AS dated, regexp_matches(x, '{_BULLET}') AS bullet FROM j WHERE section IN ('Experience', 'Projects', 'Education')),
n AS (SELECT *, count(*) FILTER (dated) OVER w AS e, x <> '' AND NOT has AND NOT bullet AND length(x) <= 90 AND NOT regexp_matches(x, '^\p{{Ll}}') AND NOT regexp_matches(x, '(?i)^gpa\b') AS head FROM d WINDOW w AS (PARTITION BY doc, place ORDER BY j)),
above AS (SELECT doc, place, min(j) FILTER (e > 0) AS s FROM n GROUP BY ALL HAVING max(e) > 0),
t AS (SELECT n.*, CASE WHEN e > 0 THEN e WHEN n.j >= s - 3 AND bool_and(head) OVER (PARTITION BY n.doc, n.place, e ORDER BY n.j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) THEN 1 END AS entry FROM n JOIN above USING (doc, place)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc, place, entry, has ORDER BY j) = 1 AND has AS top, {_without("x")} AS rest FROM t WHERE entry IS NOT NULL AND x <> ''),
h AS (SELECT doc, place, section, entry, j, CASE WHEN top THEN CASE WHEN rest <> '' AND NOT regexp_matches(rest, '(?i)^gpa\b') THEN rest END WHEN bullet THEN NULL WHEN regexp_matches(lower(x), '^(position:|role:|vai trò|title:)') THEN regexp_replace(x, '(?i)^(?:position|role|title|vai trò(?: cá nhân)?)\s*:\s*', '') ELSE x END AS head,
  CASE WHEN NOT top AND bullet THEN trim(regexp_replace(regexp_replace(x, '^\d+[.)]\s+', ''), '{_BULLET}', '')) END AS said, CASE WHEN top THEN {_span("x")} END AS dates FROM f),
g AS (SELECT doc, place, section, entry, any_value(dates) AS dates, coalesce(list(trim(regexp_replace(head, '\s+', ' ', 'g'), ' -|') ORDER BY j) FILTER (trim(head) <> '' AND length(head) < 120), []) AS h,
  coalesce(string_agg(said, chr(10) ORDER BY j) FILTER (said <> '' AND NOT regexp_full_match(said, '[\p{{L}}\p{{N}}\p{{M}}_\s/&+-]{{1,40}}:')), '') AS bullets FROM h GROUP BY ALL),
p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(array_to_string(h, ' | '), '\s*\|\s*'), lambda y: trim(y)), lambda y: y <> '') AS bits, coalesce(list_filter(h, lambda y: regexp_matches(y, '{_RE2(resumes.SCHOOL)}'))[1], h[1]) AS school, len(list_filter(h, lambda y: contains(y, ' | '))) > 0 AS barred FROM g)
SELECT doc, place::INT AS place, entry::INT AS entry, dates, bullets,
  coalesce(CASE WHEN barred AND len(bits) >= 2 THEN bits[1] WHEN section = 'Education' THEN list_filter(h, lambda y: y <> school AND NOT regexp_matches(y, '{_RE2(resumes.PLACE)}'))[1] WHEN {_ROLE} THEN h[1] ELSE coalesce(h[2], h[1]) END, '') AS title,
  coalesce(CASE WHEN barred AND len(bits) >= 2 THEN bits[2] WHEN section = 'Education' THEN school WHEN {_ROLE} THEN h[2] ELSE h[1] END, '') AS org FROM p""")
def resume_entries(spark, sf_dir):
    """The dated entries of work, projects and education, with title, place and bullets."""
    found = structuring.sectioned(_profile(table(spark, sf_dir, "documents")), "doc_id", "text", F.lit(AS_OF).cast("date"))
    each = found.select("doc", F.col("at").alias("place"), F.posexplode_outer("entries").alias("entry", "e"))
    return each.where("entry is not null").select("doc", "place", (F.col("entry") + 1).alias("entry"), "e.title", "e.org", "e.dates", F.array_join("e.bullets", "\n").alias("bullets"))


_ENDS = " UNION ALL ".join(f"SELECT doc, {_date('s')[1]} AS a, {_date('e')[1]} AS b FROM (SELECT doc, unnest(regexp_extract_all(x, '{_RE2(p)}', {g})) AS s, unnest(regexp_extract_all(x, '{_RE2(p)}', {h})) AS e FROM work)" for p, g, h in dates.RANGES)


@query(f"""WITH {_LINES}, spot AS (SELECT doc, place, any_value(name) AS section FROM l GROUP BY ALL),
work AS (SELECT doc, x FROM l JOIN spot USING (doc, place) WHERE section = 'Experience' AND l.name IS NULL AND NOT (length(x) > 120 AND length({_without("x")}) > 80)),
ends AS (SELECT doc, a, b FROM ({_ENDS}) WHERE b >= a),
marked AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM ends),
runs AS (SELECT doc, min(a) AS a, max(b) AS b FROM (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM marked) GROUP BY doc, k),
months AS (SELECT doc, sum((year(b) - year(a)) * 12 + month(b) - month(a))::INT AS months FROM runs GROUP BY doc),
said AS (SELECT doc, coalesce({", ".join(f"nullif(regexp_extract(lower(text), '{_RE2(p)}', 1), '')::INT" for p in dates.CLAIMED)}) AS claimed FROM texts)
SELECT doc, coalesce(months, 0) AS months, round_even(coalesce(months, 0) / 12.0, 0)::INT AS years, claimed FROM said LEFT JOIN months USING (doc)""")
def experience_years(spark, sf_dir):
    """Months and years that the dates of a profile's work cover together, and the years that it claims."""
    day = F.lit(AS_OF).cast("date")
    lines = resumes.sections(resumes.prepared(F.col("text")))
    rows = spread(_profile(table(spark, sf_dir, "documents"))).withColumn("parts", lines)
    work = F.flatten(F.transform(F.filter("parts", lambda p: p["section"] == "Experience"), lambda p: F.filter(p["lines"], resumes.no_prose)))
    found = rows.select("doc_id", "text", dates.merged_months(dates.intervals(work, day)).alias("months"))
    return found.select(F.col("doc_id").alias("doc"), "months", dates.years_of(F.col("months")).alias("years"), dates.claimed_years(F.col("text")).alias("claimed"))


_UNI = lambda p: _RE2(p).replace(r"[\w\s", r"[\p{L}\p{N}\p{M}_\s")
_SPAN = r"(?i)(\d{1,2})?[/-]?(\d{4})\s*[-–—]\s*(?:(\d{1,2})?[/-]?(\d{4})|present|hiện\s*tại|nay)"
_PART = lambda k, rest: f"coalesce(nullif(regexp_extract(text, '{_SPAN}', {k}), '')::INT, {rest})"
_FOUND = "list_transform(flatten([" + ", ".join(f"regexp_extract_all(text, '(?i){_UNI(p)}')" for p in redaction.IMPACT) + "]), lambda y: trim(y, ' '))"


@query(rf"""WITH RECURSIVE {_TEXTS},
a AS (SELECT doc, generate_subscripts(c, 1) AS i, unnest(c) AS x FROM (SELECT doc, list_transform(string_split(text, chr(10)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')) AS c FROM texts WHERE length(trim(text)) >= 30)),
k AS (SELECT *, regexp_matches(x, '{_RE2(projects.OPENS[0])}') OR regexp_matches(x, '{_RE2(projects.OPENS[1])}') AS opens, regexp_matches(x, '{_RE2(projects.CLOSES)}') AS closes FROM a),
p AS (SELECT *, count(*) FILTER (opens OR closes) OVER w AS part, last_value(CASE WHEN opens THEN true WHEN closes THEN false END IGNORE NULLS) OVER w AS inside FROM k WINDOW w AS (PARTITION BY doc ORDER BY i ROWS UNBOUNDED PRECEDING)),
n AS MATERIALIZED (SELECT doc, part, row_number() OVER (PARTITION BY doc, part ORDER BY i) AS i, x, regexp_matches(x, '{_UNI(projects.BEGINS)}') OR regexp_matches(x, '{_RE2(projects.YEARS)}') AS may FROM
  (SELECT *, bool_or(x <> '') OVER (PARTITION BY doc, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS begun FROM p WHERE inside AND NOT (opens OR closes)) WHERE begun),
walk(doc, part, i, s) AS (SELECT doc, part, i, i FROM n WHERE i = 1 UNION ALL SELECT n.doc, n.part, n.i, CASE WHEN may AND n.i - s > {projects.LINES} THEN n.i ELSE s END FROM walk JOIN n ON n.doc = walk.doc AND n.part = walk.part AND n.i = walk.i + 1),
parts AS (SELECT doc, part, s, string_agg(x, chr(10) ORDER BY i) AS t, arg_min(x, i) AS first FROM walk JOIN n USING (doc, part, i) GROUP BY ALL),
m AS (SELECT doc, i, x, count(*) FILTER (regexp_matches(x, '{_RE2(projects.MARK)}')) OVER (PARTITION BY doc ORDER BY i) AS s FROM a WHERE x <> '' AND doc NOT IN (SELECT doc FROM parts)),
b AS (SELECT doc, part, s, trim(t, ' ' || chr(10)) AS text, first FROM parts UNION ALL SELECT doc, 0, s, string_agg(x, chr(10) ORDER BY i), arg_min(x, i) FROM m WHERE s > 0 GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY part, s) - 1 AS place, trim(regexp_replace(first, '{_RE2(projects.NUMBERED)}', ''), ' *#:-') AS bare FROM b WHERE length(text) >= {projects.LEAST_BLOCK}),
w AS (SELECT *, {_FOUND} AS found, lower(text) AS low, ' ' || {sql_matched("text")} || ' ' AS view FROM u),
v AS (SELECT *, list_filter(found, lambda y, i: list_position(found, y) = i) AS metrics FROM w),
owned AS (SELECT doc, place, count(DISTINCT slug) AS skills FROM v JOIN {_TAXONOMY} ON contains(view, ' ' || variant || ' ') GROUP BY ALL)
SELECT doc, place::INT AS place, CASE WHEN bare = '' OR length(bare) > {projects.NAME} THEN left(first, 50) ELSE bare END AS name, md5(text) AS digest, array_to_string(metrics, '|') AS metrics, coalesce(skills, 0)::INT AS skills,
  CASE WHEN regexp_matches(text, '{_SPAN}') THEN greatest(({_PART(4, 2026)} - {_PART(2, 0)}) * 12 + {_PART(3, 12)} - {_PART(1, 1)}, 1) ELSE coalesce(nullif(regexp_extract(text, '(?i)(\d+)\s*(?:tháng|months?|mos?)\b', 1), '')::INT,
    nullif(regexp_extract(text, '(?i)(?:thời\s*gian|thời\s*lượng|duration|kéo\s*dài)[:\s]+(\d+)\s*(?:năm|years?|yrs?)\b', 1), '')::INT * 12, 3) END AS months,
  greatest(0, least(100, 30 - CASE WHEN {" OR ".join(f"regexp_matches(low, '{_UNI(p)}')" for p in redaction.EXERCISES)} THEN 15 ELSE 0 END + least(8 * ({" + ".join(f"contains(low, '{x}')::INT" for x in redaction.COMPLEXITY)}), 35) + least(10 * len(metrics), 25)
    + CASE WHEN coalesce(skills, 0) >= 6 THEN 15 WHEN coalesce(skills, 0) >= 3 THEN 10 ELSE 0 END - CASE WHEN length(text) < 60 THEN 20 ELSE 0 END))::DOUBLE AS depth FROM v LEFT JOIN owned USING (doc, place)""")
def project_blocks(spark, sf_dir):
    """The projects of each profile, with their skills, months, measured impact and depth."""
    found = projects.projects(_profile(table(spark, sf_dir, "documents")), "doc_id", skills.taxonomy(spark), "text", 2026)
    return found.select("doc", F.col("at").alias("place"), "name", F.md5("text").alias("digest"), F.array_join("metrics", "|").alias("metrics"), F.size("skills").alias("skills"), "months", "depth")


#: Each text as canonical Markdown.
_CANONICAL = rf"""{_TEXTS}, {_HEADS},
c AS (SELECT doc, generate_subscripts(a, 1) AS i, trim(unnest(a)) AS x FROM (SELECT doc, string_split(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x{{FEFF}}\x{{AD}}]', '', 'g'), '[ \t\x{{A0}}]+(\n|$)', '\1', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), chr(10) || ' ' || chr(9)), chr(10)) AS a FROM texts)),
ck AS (SELECT *, trim(lower(regexp_replace(trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(x, '^#{{1,6}}\s*', ''), '{_BULLET}', ''), '^[^\p{{L}}\p{{Nl}}\p{{No}}]+', ''), '/|', '  '), ':+\s*$', '')), '\s+', ' ', 'g'))) AS key FROM c),
cn AS (SELECT doc, i, arg_max(name, length(k)) AS name, trim(substr(any_value(key), max(length(k)) + 1)) AS rest FROM ck JOIN heads ON key = k OR starts_with(key, k || ' ') GROUP BY ALL),
cl AS (SELECT ck.doc, ck.i, CASE WHEN name IS NOT NULL THEN chr(10) || '## ' || name || chr(10) || CASE WHEN rest <> '' THEN chr(10) || rest ELSE '' END
  WHEN regexp_matches(x, '^#{{1,6}}\s+.') THEN repeat('#', greatest(3, length(regexp_extract(x, '^#+')))) || ' ' || trim(regexp_replace(x, '^#+', '')) WHEN regexp_matches(x, '{_BULLET}') THEN '- ' || nullif(trim(regexp_replace(x, '{_BULLET}', '')), '') ELSE x END AS made
  FROM ck LEFT JOIN cn ON cn.doc = ck.doc AND cn.i = ck.i),
cv AS MATERIALIZED (SELECT doc, CASE WHEN made = '' THEN '' ELSE '# CV' || chr(10) || chr(10) || made END AS markdown FROM (SELECT doc, trim(regexp_replace(string_agg(made, chr(10) ORDER BY i), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS made FROM cl GROUP BY doc))"""


@query(f"WITH {_CANONICAL} SELECT doc, md5(markdown) AS digest, len(regexp_extract_all(markdown, '(?m)^## '))::INT AS headings FROM cv")
def canonical_markdown(spark, sf_dir):
    """Each profile as Markdown under canonical headings."""
    made = spread(_profile(table(spark, sf_dir, "documents"))).select(F.col("doc_id").alias("doc"), structuring.canonical(F.col("text")).alias("markdown"))
    return made.select("doc", F.md5("markdown").alias("digest"), F.regexp_count("markdown", F.lit("(?m)^## ")).alias("headings"))


_KIND = "CASE " + " ".join(f"WHEN title IN ({', '.join(repr(k) for k in keys)}) THEN '{kind}'" for kind, keys in structuring.KINDS.items()) + " ELSE 'other' END"


@query(rf"""WITH {_CANONICAL}, pl AS (SELECT doc, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT doc, string_split(markdown, chr(10)) AS a FROM cv)),
ps AS (SELECT *, count(*) FILTER (regexp_matches(x, '^##[ \t]+\S')) OVER (PARTITION BY doc ORDER BY i) AS sec FROM pl),
pt AS (SELECT *, trim(lower(first_value(regexp_replace(x, '^##[ \t]+', '')) OVER (PARTITION BY doc, sec ORDER BY i))) AS title, row_number() OVER (PARTITION BY doc, sec ORDER BY i) AS n FROM ps WHERE sec > 0),
pb AS (SELECT *, {_KIND} AS name, count(*) FILTER (regexp_matches(x, '^###[ \t]+\S')) OVER (PARTITION BY doc, sec ORDER BY i) AS sub, count(*) FILTER (regexp_matches(x, '^###[ \t]+\S')) OVER (PARTITION BY doc, sec) AS subs FROM pt WHERE n > 1),
pv AS (SELECT doc, sec, CASE WHEN name IN ('experience', 'education', 'project') THEN sub ELSE 0 END AS sub, name, any_value(subs) AS subs, trim(string_agg(CASE WHEN name IN ('experience', 'education', 'project') THEN regexp_replace(x, '^###[ \t]+(\S)', '\1') ELSE x END, chr(10) ORDER BY i), ' ' || chr(10)) AS value FROM pb GROUP BY ALL),
px AS (SELECT doc, sec, sub, name, value FROM pv WHERE NOT (subs > 0 AND sub = 0 AND name IN ('experience', 'education', 'project')) AND value <> ''),
py AS (SELECT doc, 0 AS sec, generate_subscripts(a, 1) AS sub, 'experience' AS name, trim(unnest(a), ' ' || chr(10)) AS value FROM (SELECT doc, string_split(markdown, chr(10) || chr(10)) AS a FROM cv WHERE NOT regexp_matches(markdown, '(?m)^##[ \t]+\S')))
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY sec, sub) - 1)::INT AS place, name, md5(value) AS digest FROM (SELECT * FROM px UNION ALL SELECT * FROM py WHERE value <> '' AND NOT starts_with(value, '#'))""")
def profile_lines(spark, sf_dir):
    """The lines of each profile, read from its canonical Markdown."""
    made = spread(_profile(table(spark, sf_dir, "documents"))).withColumn("markdown", structuring.canonical(F.col("text")))
    found = made.select(F.col("doc_id").alias("doc"), structuring.profile_lines(F.col("markdown"), F.array().cast("array<string>")).alias("lines"))
    each = found.select("doc", F.posexplode_outer("lines").alias("place", "line")).where("line is not null")
    return each.select("doc", "place", "line.name", F.md5("line.value").alias("digest"))


@query()
def resume_profiles(spark, sf_dir):
    """Each profile's metadata and Markdown without its person; equal to loops over small texts in the tests."""
    made = structuring.structured(_profile(table(spark, sf_dir, "documents")), "doc_id", skills.taxonomy(spark), "text", None, F.lit(AS_OF).cast("date"))
    return made.select("doc", "major_field", "sub_field", "seniority", "years_experience", F.size("skills").alias("skills"), F.md5("markdown").alias("digest"))
