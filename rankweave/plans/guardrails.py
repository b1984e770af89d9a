"""Text rules over documents, conversations and page addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import guardrails, redaction, text
from rankweave.plans.registry import query
from rankweave.sources.tables import spread, table

_q = guardrails.q
_NORMAL = guardrails.sql_normalized("coalesce(text, '')")


_LONG_SQL = "CASE WHEN conv_id % 50 = 0 THEN repeat(coalesce(text, '') || ' and ', 400) ELSE coalesce(text, '') END"


def _clean_sql(source: str, key: str) -> str:
    return f"SELECT {key}, t, {guardrails.sql_sanitized('t')} AS clean FROM (SELECT {key}, {_NORMAL} AS t FROM {source})"


def _signals_sql(source: str, key: str) -> str:
    return f"SELECT *, {guardrails.sql_signals('low', 'view')} AS signals FROM (SELECT {key}, t, lower(t) AS low, {guardrails.sql_folded('t')} AS view FROM (SELECT {key}, {_NORMAL} AS t FROM {source}))"


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, {_q(p)}))::BIGINT AS {k}" for k, p in {"emails": text.EMAIL, "phones": text.PHONE, "urls": text.URL, "births": text.BIRTH}.items()) + " FROM documents")
def pii_counts(spark, sf_dir):
    counts = text.pii_counts(F.col("text"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(c.alias(k) for k, c in counts.items()))


@query(f"SELECT doc_id, sha256(clean) AS redacted_sha256, clean <> t AS changed FROM ({_clean_sql('documents', 'doc_id')})")
def pii_redact(spark, sf_dir):
    clean = guardrails.let(guardrails.normalized(F.coalesce("text", F.lit(""))), guardrails.sanitized)
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", clean.alias("c")).select("doc_id", F.sha2("c.value", 256).alias("redacted_sha256"), "c.changed")


@query(f"SELECT * FROM (SELECT doc_id, array_to_string({guardrails.sql_secrets('t')}, ',') AS secrets FROM (SELECT doc_id, {_NORMAL} AS t FROM documents)) WHERE secrets <> ''")
def secret_scan(spark, sf_dir):
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.array_join(guardrails.secrets(guardrails.normalized(F.col("text"))), ",").alias("secrets"))
    return found.where("secrets <> ''")


@query(f"SELECT conv_id, turn, array_to_string(signals, ',') AS signals FROM ({_signals_sql('conversations', 'conv_id, turn')})")
def injection_signals(spark, sf_dir):
    found = guardrails.injection_signals(guardrails.normalized(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("signals"))


_GATED = f"""cut AS (SELECT doc_id, CASE WHEN length(n) > 20000 THEN rtrim(substr(n, 1, 20000), ' ') ELSE n END AS t, length(n) > 20000 AS over FROM (SELECT doc_id, {_NORMAL} AS n FROM documents)),
seen AS (SELECT doc_id, t, over, {guardrails.sql_sanitized("t")} AS clean, len({guardrails.sql_secrets("t")}) > 0 AS secret, len({guardrails.sql_signals("lower(t)", "view")}) > 0 AS flagged FROM (SELECT *, {guardrails.sql_folded("t")} AS view FROM cut)),
line AS (SELECT doc_id, count(*) FILTER (trim(l) <> '' AND len({guardrails.sql_signals("lower(l)", "view")}) = 0) AS kept FROM (SELECT doc_id, l, {guardrails.sql_folded("l")} AS view FROM (SELECT doc_id, trim(unnest(string_split(clean, chr(10))), {_q(guardrails.SPACES)}) AS l FROM seen WHERE flagged)) GROUP BY doc_id)"""


@query(f"""WITH {_GATED} SELECT CASE WHEN t = '' THEN 'degrade' WHEN secret THEN 'block' WHEN clean = '' OR (flagged AND coalesce(kept, 0) = 0) THEN 'degrade' WHEN flagged THEN 'sanitize' WHEN over THEN 'degrade' WHEN clean <> t THEN 'sanitize' ELSE 'pass' END AS action, count(*) AS n
FROM seen LEFT JOIN line USING (doc_id) GROUP BY 1""")
def gate_decision(spark, sf_dir):
    """How many documents a context gate passes, sanitizes, degrades or blocks."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(guardrails.gate(F.col("text"))["action"].alias("action")).groupBy("action").agg(F.count("*").alias("n"))


@query(f"""WITH n AS (SELECT conv_id, turn, {guardrails.sql_normalized(_LONG_SQL)} AS n FROM conversations), c AS (SELECT conv_id, turn, length(n) > 20000 AS over, CASE WHEN length(n) > 20000 THEN rtrim(substr(n, 1, 20000), ' ') ELSE n END AS t FROM n),
v AS (SELECT *, {guardrails.sql_folded("t")} AS view FROM c)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'degrade' WHEN len({guardrails.sql_secrets("t")}) > 0 THEN 'block' WHEN len({guardrails.sql_signals("lower(t)", "view")}) > 0 THEN 'block' WHEN clean = '' OR over THEN 'degrade' WHEN clean <> t THEN 'sanitize' ELSE 'pass' END AS action
FROM (SELECT *, {guardrails.sql_sanitized("t")} AS clean FROM v)""")
def chat_gate(spark, sf_dir):
    """The gate of what people say in a chat: any signal blocks it, and a text beyond the budget is cut. One turn in fifty is repeated until it is beyond."""
    said = F.when(F.col("conv_id") % 50 == 0, F.repeat(F.concat(F.coalesce("text", F.lit("")), F.lit(" and ")), F.lit(400))).otherwise(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", guardrails.gate(said, "chat")["action"].alias("action"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(k) for k, c in text.url_parts(F.col("url")).items()))


@query("SELECT doc_id, length(trim(text, ' ')) < 600 AS low_content, sha256(text) AS content_hash, trim(regexp_replace(lower(substr(text, 1, 60)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def document_facts(spark, sf_dir):
    """Low-content flag, content hash and slug."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(F.trim(t)) < text.LOW_CONTENT).alias("low_content"), F.sha2(t, 256).alias("content_hash"), text.slug(F.substring(t, 1, 60)).alias("slug"))


@query(f"SELECT item_id, trim(regexp_replace(translate(lower(text), '{text.ACCENTED}', '{text.FOLDED}'), '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS folded FROM benchmark")
def folded_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.fold(F.col("text")).alias("folded"))


@query("""SELECT conv_id, turn, CASE WHEN folded = '' THEN 'UNKNOWN' WHEN contains(folded, 'compare') OR contains(folded, 'vergleich') THEN 'COMPARE' WHEN regexp_matches(folded, '(^| )(job|work|the)( |$)') THEN 'FIND_JOBS' WHEN contains(folded, '?') THEN 'QUESTION' ELSE 'OTHER' END AS intent FROM (SELECT *, trim(lower(coalesce(text, '')), ' ') AS folded FROM conversations WHERE role = 'user')""")
def intents(spark, sf_dir):
    """First-match intent rules over what users say."""
    said = F.trim(F.lower(F.coalesce("text", F.lit(""))))
    rule = (
        F.when(said == "", "UNKNOWN").when(said.contains("compare") | said.contains("vergleich"), "COMPARE")
        .when(said.rlike("(^| )(job|work|the)( |$)"), "FIND_JOBS").when(said.contains("?"), "QUESTION").otherwise("OTHER")
    )
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", rule.alias("intent"))


@query("""SELECT doc_id, contains(text, '�') OR regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') OR len(list_filter(l, lambda x: length(trim(x, ' ')) <= 2)) * 10 > len(l) AS corrupted
FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents)""")
def corruption(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.looks_corrupted(F.col("text")).alias("corrupted"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '## Summary' || chr(10) || 'Born  and of ' || lower(c_mktsegment) WHEN c_custkey % 3 = 1 THEN '## Skills' || chr(10) || '- spark ' || c_custkey ELSE 'works at' END AS clean,
  'own' || c_custkey || '/r.x' AS repos, CASE WHEN c_custkey % 2 = 0 THEN 'me' || c_custkey ELSE '' END AS profiles, 'own' || c_custkey || '/r.x' AS parsed FROM customer""")
def person_redaction(spark, sf_dir):
    """Profiles without their person, and the code repositories and profiles that they link to."""
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    said = (
        F.when(k % 3 == 0, F.concat(F.lit("An Van NGUYEN\nBinh\nEmail: a@b.org\n## Summary\nBorn 01/02/1990 and of "), F.lower("c_mktsegment")))
        .when(k % 3 == 1, F.concat(F.lit("# Tran An\n## Contact\nHue\n0912345678\n## Skills\n- spark "), n, F.lit("\n- \n- www.x.org/y"))).otherwise("works at a.b@c.org")
    )
    links = F.concat(F.lit("see https://GitHub.com/own"), n, F.lit("/r.x.git and github.com/Own"), n, F.lit("/R.x, github.com/topics/x "), F.when(k % 2 == 0, F.concat(F.lit("github.com/me"), n)).otherwise("github.com/about"))
    found = redaction.harvested(links)
    read = redaction.repository(F.concat(F.lit("git@github.com:own"), n, F.lit("/r.x.git")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", redaction.without_person(said).alias("clean"), F.array_join(found["repositories"], ",").alias("repos"), F.array_join(found["profiles"], ",").alias("profiles"),
        F.concat_ws("/", read["owner"], read["repo"]).alias("parsed"),
    )


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 72 WHEN 2 THEN 55 ELSE 23 END::DOUBLE AS depth, CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 17 WHEN 2 THEN 24 ELSE 7 END AS months FROM part""")
def project_facts(spark, sf_dir):
    """Depth and months read from a project's description."""
    k = F.col("p_size") % 4
    said = (
        F.when(k == 0, "todo app").when(k == 1, "Sharding and caching of a message queue, 40% faster, 01/2020 - 06/2021 in all of it")
        .when(k == 2, "Reduced the load time of pages by 20 ms for all of the users, duration: 2 years").otherwise("A crud api that took 7 months and is described at some length here")
    )
    skills = F.when(k == 1, 3).when(k == 2, 1).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", redaction.project_depth(said, skills).alias("depth"), redaction.project_months(said, 2026).alias("months"))
