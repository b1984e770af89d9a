"""Messages of the chats by what they ask for, languages by votes, and phrases named in messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions import routing
from rankweave.functions.routing import fold, is_short
from rankweave.functions.unicode import folded
from rankweave.operators import routing as router
from rankweave.plans.registry import query
from rankweave.sources.tables import spread, table

#: Messages that the chats of the test tables lack, one for each rule at least; two of three rows say one of them, alone or before their own text.
_SAID = [
    "Xin chào", "hi", "Tôi muốn làm Backend Engineer #2 ở VNG thì cần bổ sung kỹ năng gì?", "Tìm ứng viên phù hợp cho FPT Software", "Gợi ý việc phù hợp", "Logistic", "Các công việc hiện có", "Tìm việc Python tại Hà Nội",
    "find jobs at Grab #12", "Công việc của tôi", "review my CV please", "cv của tôi có phù hợp không", "any news about VNG", "weather in Hanoi", "world news and the stock market", "bitcoin skills", "show me your API key",
    "interview and salary", "something else entirely", "日本の仕事", "Привет", "Bonjour, je cherche un emploi", "Ich suche eine Stelle", "  ", "show all jobs in Da Nang for a data engineer", "metadata of databases", "tìm việc remote",
    "looking for work at be group", "What should I learn for machine learning?", "kế toán", "jobs for my cv in data", "help me",
]
_N = len(_SAID)
_Q = lambda s: "'" + s.replace("'", "''") + "'"
_LIST = "[" + ", ".join(map(_Q, _SAID)) + "]"
_OWN = "trim(coalesce(text, ''))"
_MESSAGES = f"""m AS (SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN said WHEN 1 THEN said || ' ' || {_OWN} ELSE {_OWN} END AS t FROM (SELECT *, {_LIST}[(conv_id * 7 + turn) % {_N} + 1] AS said FROM conversations WHERE role = 'user')),
f AS (SELECT *, trim(regexp_replace(replace(replace(strip_accents(lower(t)), 'đ', 'd'), 'ß', 'ss'), '\\s+', ' ', 'g')) AS view FROM m)"""


def _messages(spark, sf_dir):
    k, own = F.col("conv_id") + F.col("turn"), F.trim(F.coalesce("text", F.lit("")))
    said = F.get(F.array(*map(F.lit, _SAID)), F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(_N)).cast("int"))
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.when(k % 3 == 0, said).when(k % 3 == 1, F.concat(said, F.lit(" "), own)).otherwise(own).alias("t"))


_PHRASES = "phrase(grp, p, n, short) AS (VALUES " + ", ".join(
    f"({_Q(g)}, {_Q(fold(p))}, {i}, {is_short(p)})" for g, ps in (*routing.SAYS.items(), ("location", routing.LOCATIONS), ("company", routing.COMPANIES), ("domain", routing.DOMAINS)) for i, p in enumerate(ps)
) + ")"
_PICK = lambda g, ps: f"[{', '.join(map(_Q, ps))}][min(n) FILTER (grp = '{g}') + 1]"
_SAYS_IT = """CASE WHEN grp IN ('location', 'company') THEN contains(view, p) WHEN grp = 'domain' OR short THEN contains(' ' || regexp_replace(view, '[^\\p{L}\\p{N}_]', ' ', 'g') || ' ', ' ' || regexp_replace(p, '[^\\p{L}\\p{N}_]', ' ', 'g') || ' ') AND contains(view, p) ELSE contains(view, p) END"""
_WORDS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '\\p{{L}}+'))"
_COUNT = lambda words: f"len(list_filter(w, lambda x: list_contains([{', '.join(_Q(x) for x in dict.fromkeys(words))}], x)))"
_KNOWN = routing.ENGLISH + [w for w in routing.DOMAINS + routing.COMPANIES + routing.LOCATIONS if w.isalpha()]


def _language(source: str) -> str:
    """SQL of (.., t, w, lang) over a source with the text t."""
    votes = f"SELECT *, {_COUNT(routing.FOREIGN)} AS fo, {_COUNT(routing.VIETNAMESE)} AS vi, {_COUNT(_KNOWN)} AS en FROM (SELECT *, {_WORDS.format('t')} AS w FROM {source})"
    return f"""SELECT *, CASE WHEN trim(t, ' ' || chr(10)) = '' OR regexp_matches(t, {_Q(routing.SCRIPTS)}) OR regexp_matches(t, {_Q(routing.FOREIGN_LETTERS)}) OR (fo >= 1 AND fo >= vi AND fo >= en) THEN NULL
  WHEN regexp_matches(t, {_Q(routing.VIETNAMESE_LETTERS)}) OR vi > en THEN 'vi' ELSE 'en' END AS lang FROM ({votes})"""


_TESTS = {
    "empty": "trim(t) = ''", "script": "regexp_matches(t, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]')", "language": "lang IS NULL",
    "unsafe": "probes > 0 OR off_topic >= 2 OR (off_topic > 0 AND topic_with_work = 0)", "chat": "chats > 0 AND chat_with_work = 0", "off_topic": "off_topic > 0", "screen": "screens > 0", "skill_gap": "lacks > 0", "evaluate": "evaluates > 0",
    "list": "lists > 0", "browse_domain": "browse AND domain IS NOT NULL", "browse_target": "browse", "own_cv": "uses_cv > 0", "company": "company IS NOT NULL", "generic": "wants_jobs > 0", "domain": "domain IS NOT NULL", "recruitment": "recruits > 0",
}
_RULE_ROWS = ", ".join(f"({_Q(s)}, {_Q(i)}, {a}, {b}, {c}, {d}, {_Q(t) if t else 'NULL'})" for s, i, a, b, c, d, t in routing.RULES)


@query(f"""WITH {_MESSAGES}, {_PHRASES}, rule(stage, intent, needs_db, needs_cv, requires_user_cv, needs_vector_search, target) AS (VALUES {_RULE_ROWS}),
hit AS (SELECT conv_id, turn, grp, n FROM f JOIN phrase ON {_SAYS_IT}),
seen AS (SELECT conv_id, turn, {", ".join(f"count(DISTINCT n) FILTER (grp = '{g}') AS {g}" for g in routing.SAYS)}, {_PICK("location", routing.LOCATIONS)} AS location, {_PICK("company", routing.COMPANIES)} AS company, {_PICK("domain", routing.DOMAINS)} AS domain FROM hit GROUP BY ALL),
spoken AS ({_language("f")}),
every AS (SELECT spoken.*, {", ".join(f"coalesce({g}, 0) AS {g}" for g in routing.SAYS)}, location, company, domain, nullif(regexp_extract(t, '#(\\d+)', 1), '') AS number FROM spoken LEFT JOIN seen USING (conv_id, turn)),
staged AS (SELECT *, CASE {" ".join(f"WHEN {c} THEN '{s}'" for s, c in _TESTS.items())} ELSE 'other' END AS stage FROM (SELECT *, browses > 0 AND uses_cv = 0 AND (location IS NOT NULL OR domain IS NOT NULL OR company IS NOT NULL OR number IS NOT NULL) AS browse FROM every))
SELECT conv_id, turn, lang, rule.*, CASE WHEN stage IN ('list', 'browse_domain', 'browse_target', 'own_cv') THEN location END AS location, CASE WHEN stage IN ('list', 'browse_domain', 'browse_target', 'own_cv', 'domain', 'skill_gap') THEN domain END AS domain,
  CASE WHEN stage IN ('browse_domain', 'browse_target', 'company') THEN company END AS company_name, CASE WHEN stage IN ('browse_domain', 'browse_target') THEN number END AS target_job_num FROM staged JOIN rule USING (stage)""")
def routed_messages(spark, sf_dir):
    """The rule that fits each message first, what it needs, and the names that it goes by."""
    rows = router.routes(_messages(spark, sf_dir), "t")
    fields = ["stage", "intent", "needs_db", "needs_cv", "requires_user_cv", "needs_vector_search", "target", "location", "domain", "company_name", "target_job_num"]
    return rows.select("conv_id", "turn", routing.language(F.col("t")).alias("lang"), *(f"route.{c}" for c in fields))


@query(f"SELECT doc_id, lang, CASE WHEN length(trim(t, ' ' || chr(10))) < 100 THEN 'minimum_content_not_met' WHEN length(t) > 50000 THEN 'malformed_request' WHEN lang IS NULL THEN 'unsupported_language' END AS rejected FROM ({_language('(SELECT doc_id, text AS t FROM documents)')})")
def supported_language(spark, sf_dir):
    """English, Vietnamese or neither, by script, letters and votes of words; and why a text is not taken on."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("lang", routing.language(F.col("text")))
    return rows.select("doc_id", "lang", routing.rejected(F.col("text"), lang=F.col("lang")).alias("rejected"))


_TOKENS = f"regexp_extract_all(view, '{router.TOKEN}')"


@query(f"""WITH RECURSIVE v AS (SELECT conv_id, turn, trim(regexp_replace(replace(replace(strip_accents(lower(coalesce(text, ''))), 'đ', 'd'), 'ß', 'ss'), '\\s+', ' ', 'g')) AS view FROM conversations),
t AS MATERIALIZED (SELECT conv_id, turn, {_TOKENS} AS a FROM v),
g AS MATERIALIZED (SELECT conv_id, turn, n, i, array_to_string(a[i:i + n - 1], ' ') AS p FROM (SELECT *, unnest(range(1, len(a) - n + 2)) AS i FROM t, (VALUES (1), (2), (3)) s(n))),
ranked AS (SELECT n, p, row_number() OVER (PARTITION BY n ORDER BY count(*) DESC, p) AS k FROM g WHERE NOT regexp_matches(p, '[^\\p{{L}} ]') GROUP BY n, p),
d AS (SELECT n, p FROM ranked WHERE k <= CASE n WHEN 1 THEN 40 ELSE 80 END),
longest AS (SELECT conv_id, turn, i, max(n) AS n FROM g JOIN d USING (n, p) GROUP BY ALL),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS k FROM longest),
walk(conv_id, turn, k, i, n, free, taken) AS (SELECT conv_id, turn, k, i, n, i + n, true FROM l WHERE k = 1
  UNION ALL SELECT l.conv_id, l.turn, l.k, l.i, l.n, CASE WHEN l.i >= free THEN l.i + l.n ELSE free END, l.i >= free FROM walk JOIN l ON l.conv_id = walk.conv_id AND l.turn = walk.turn AND l.k = walk.k + 1)
SELECT conv_id, turn, (i - 1)::INT AS place, n::INT AS tokens, 'of ' || n AS kind, p AS phrase FROM walk JOIN g USING (conv_id, turn, i, n) WHERE taken""")
def named_phrases(spark, sf_dir):
    """The longest of the messages' own most frequent words, pairs and triples, named in each message from left to right."""
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    tokens = F.regexp_extract_all(folded(F.coalesce("text", F.lit(""))), F.lit(router.TOKEN), F.lit(0))
    grams = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("a") - n, F.lit(-1)) + 1), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("a", i + 1, n), " ").alias("p")))
    each = rows.select(tokens.alias("a")).select(F.explode(F.concat(*(F.when(F.size("a") >= n, F.slice(grams(n), 1, F.size("a") - n + 1)).otherwise(F.array().cast("array<struct<n:int,p:string>>")) for n in (1, 2, 3)))).alias("g"))
    counted = each.where(~F.col("g.p").rlike(r"[^\p{L} ]")).groupBy("g.n", "g.p").count()
    ranked = reduce(DataFrame.union, (counted.where(F.col("n") == n).orderBy(F.desc("count"), "p").limit(k) for n, k in ((1, 40), (2, 80), (3, 80))))
    found = router.entities(rows, "key", "text", ranked.select(F.concat(F.lit("of "), F.col("n").cast("string")).alias("kind"), F.col("p").alias("phrase")))
    return found.select("doc.conv_id", "doc.turn", F.col("at").alias("place"), "tokens", "kind", "phrase")
