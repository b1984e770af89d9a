"""Profile reports: sections, dates, constraints, votes, validation and comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankweave.functions import text
from rankweave.operators import profiles, seeded, skills
from rankweave.plans.registry import query
from rankweave.plans.retrieval import _TAXONOMY
from rankweave.sources.tables import dealt, table


@query("""WITH l AS (SELECT doc_id, generate_subscripts(lines, 1) - 1 AS line, unnest(lines) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
h AS (SELECT *, CASE WHEN regexp_matches(text, '^[A-Z][a-z]+ [a-z]+\\.$') THEN text END AS head FROM l),
s AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING), '') AS section FROM h)
SELECT doc_id AS doc, section, count(*) AS lines FROM s WHERE head IS NULL GROUP BY ALL""")
def section_lines(spark, sf_dir):
    """Lines under each heading, a heading being a line of two words here."""
    found = profiles.sections(table(spark, sf_dir, "documents"), "doc_id", "text", r"^([A-Z][a-z]+ [a-z]+\.)$")
    return found.groupBy("doc", "section").agg(F.count("*").alias("lines"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%-d/%-m/%Y') WHEN 1 THEN strftime(o_orderdate, '%-m/%Y') WHEN 2 THEN strftime(o_orderdate, '%b %Y') WHEN 3 THEN strftime(o_orderdate, '%Y') ELSE 'present' END AS said, o_orderdate AS d FROM orders)
SELECT o_orderkey, said, CASE o_orderkey % 5 WHEN 0 THEN d::DATE WHEN 1 THEN date_trunc('month', d)::DATE WHEN 2 THEN date_trunc('month', d)::DATE WHEN 3 THEN date_trunc('year', d)::DATE END::VARCHAR AS parsed FROM t""")
def parsed_dates(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    said = F.when(k == 0, F.date_format(d, "d/M/yyyy")).when(k == 1, F.date_format(d, "M/yyyy")).when(k == 2, F.date_format(d, "MMM yyyy")).when(k == 3, F.date_format(d, "yyyy")).otherwise("present")
    return table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said")).select("o_orderkey", "said", profiles.parse_date(F.col("said")).cast("string").alias("parsed"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size * 12 WHEN 1 THEN p_size ELSE p_size * 12 + 5 END::INT AS months, CASE WHEN p_size % 3 = 1 AND p_size < 12 THEN 'intern' WHEN (CASE p_size % 3 WHEN 0 THEN p_size * 12 WHEN 1 THEN p_size ELSE p_size * 12 + 5 END) / 12.0 < 3 THEN 'junior' WHEN (CASE p_size % 3 WHEN 0 THEN p_size * 12 WHEN 1 THEN p_size ELSE p_size * 12 + 5 END) / 12.0 < 5 THEN 'mid' ELSE 'senior' END AS seniority FROM part")
def durations(spark, sf_dir):
    n = F.col("p_size").cast("string")
    said = F.when(F.col("p_size") % 3 == 0, F.concat(n, F.lit(" years"))).when(F.col("p_size") % 3 == 1, F.concat(n, F.lit(" months"))).otherwise(F.concat(n, F.lit(" yrs 5 mo")))
    rows = table(spark, sf_dir, "part").select("p_partkey", profiles.duration_months(said).alias("months"))
    return rows.select("p_partkey", "months", profiles.seniority(F.col("months") / 12.0).alias("seniority"))


_HINT = lambda hints: " OR ".join(f"contains(view, '{h}')" for h in hints)


@query(f"""WITH s AS (SELECT item_id AS doc, generate_subscripts(p, 1) - 1 AS sentence, unnest(p) AS said FROM (SELECT item_id, regexp_split_to_array(text || ' one required. inoran attion or thatin must have', '[.!?\\n]+') AS p FROM benchmark)),
v AS (SELECT doc, sentence, ' ' || {text.sql_matched("said")} || ' ' AS view FROM s),
k AS (SELECT *, CASE WHEN {_HINT(profiles.MUST)} THEN 0 WHEN {_HINT(profiles.PREFERRED)} THEN 1 WHEN {_HINT(profiles.MENTIONED)} THEN 2 END AS kind, {_HINT(profiles.ALTERNATIVE)} AS either FROM v),
w AS (SELECT DISTINCT doc, sentence, kind, either, slug FROM k JOIN {_TAXONOMY} ON contains(view, ' ' || variant || ' ') WHERE kind IS NOT NULL),
b AS (SELECT *, min(kind) OVER (PARTITION BY doc, slug ORDER BY sentence, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
SELECT doc, slug, ['must', 'preferred', 'mentioned'][kind + 1] AS kind, CASE WHEN kind = 0 AND either THEN 's' || sentence ELSE slug END AS "group" FROM b WHERE before IS NULL OR kind < before""")
def proposed_constraints(spark, sf_dir):
    """Constraints that a text proposes; the last sentences are added here, so that every kind of group occurs."""
    rows = table(spark, sf_dir, "benchmark").withColumn("text", F.concat("text", F.lit(" one required. inoran attion or thatin must have")))
    return profiles.proposed_constraints(rows, "item_id", "text", skills.taxonomy(spark))


@query("WITH v AS (SELECT o_custkey, o_orderpriority AS label, sum(CASE o_orderstatus WHEN 'O' THEN 3 ELSE 1 END) AS w, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT o_custkey, label, w::BIGINT AS weight FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, first) = 1")
def vote_argmax(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("label"), F.when(F.col("o_orderstatus") == "O", 3).otherwise(1).alias("w"))
    return profiles.argmax_votes(rows, "o_custkey", "label", "w", "o_orderkey")


@query("""WITH r AS (SELECT l_orderkey AS query, l_partkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place, l_quantity AS score, (l_linenumber + l_partkey) % 3 AS g FROM lineitem),
x AS (SELECT *, lag(g) OVER (PARTITION BY query ORDER BY place) > g AS back, row_number() OVER (PARTITION BY query, doc ORDER BY place) > 1 AS again, doc % 10 = 0 AS unknown FROM r)
SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN unknown THEN 'unknown' END, CASE WHEN again THEN 'repeated' END, CASE WHEN back THEN 'order' END], lambda p: p IS NOT NULL)) AS problem FROM x) GROUP BY problem""")
def output_problems(spark, sf_dir):
    """Validation of a ranked output against the parts it may name."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("doc"), place.alias("place"), F.col("l_quantity").alias("score"), ((F.col("l_linenumber") + F.col("l_partkey")) % 3).alias("g"))
    allowed = rows.where("doc % 10 <> 0").select("doc")
    return profiles.ranked_problems(rows, allowed, "query", "doc", "place", "score", "g").groupBy("problem").agg(F.count("*").alias("n"))


@query(f"""WITH q AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '{text.TOKEN_SEPARATOR}')) AS word FROM conversations WHERE role = 'user'), r AS (SELECT DISTINCT item_id AS id, unnest(regexp_split_to_array(lower(text), '{text.TOKEN_SEPARATOR}')) AS word FROM benchmark)
SELECT count(DISTINCT id) FILTER (word IN (SELECT word FROM q) AND length(word) > 9) AS covered, count(DISTINCT id) AS "all", (count(DISTINCT id) FILTER (word IN (SELECT word FROM q) AND length(word) > 9))::DOUBLE / count(DISTINCT id) AS ratio, (count(DISTINCT id) FILTER (word IN (SELECT word FROM q) AND length(word) > 9))::DOUBLE / count(DISTINCT id) >= 0.8 AS enough FROM r WHERE word <> ''""")
def requirement_coverage(spark, sf_dir):
    """Benchmark items that share a word of ten letters or more with some user turn."""
    words = lambda df, key: df.select(F.col(key).alias("id"), F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word"))
    asked = words(table(spark, sf_dir, "conversations").where("role = 'user'"), "conv_id").where(F.length("word") > 9)
    return profiles.requirement_coverage(asked, words(table(spark, sf_dir, "benchmark"), "item_id"))


@query("SELECT p_partkey, round(greatest(0, least(100, 30 - CASE WHEN p_partkey % 7 = 0 THEN 15 ELSE 0 END + least((p_size % 6) * 8, 35) + least((p_partkey % 4) * 10, 25) + CASE WHEN p_size % 9 >= 6 THEN 15 WHEN p_size % 9 >= 3 THEN 10 ELSE 0 END - CASE WHEN p_size < 10 THEN 20 ELSE 0 END)), 1)::DOUBLE AS depth, round(least(100.0, CASE WHEN p_size >= 3 AND (p_size - p_partkey % 10)::DOUBLE / p_size > 0.6 THEN least(x * 0.3, 25) ELSE x END + CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 0 END), 6)::DOUBLE AS experience FROM (SELECT *, CASE WHEN p_size % 5 > 0 THEN least(100.0, least((p_partkey % 10)::DOUBLE / (p_size % 5), 1.5) * 70) WHEN p_partkey % 10 > 0 THEN least((p_partkey % 10) * 10.0, 100) ELSE 30 END AS x FROM part)")
def project_scores(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    depth = profiles.depth_score(n % 6, k % 4, n % 9, F.when(n < 10, 10).otherwise(100), k % 7 == 0)
    experience = profiles.experience_score((k % 10).cast("double"), n % 5, n, k % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", depth.alias("depth"), F.round(experience, 6).alias("experience"))


@query(f"""WITH o AS (SELECT doc_id, list(DISTINCT slug) AS s FROM (SELECT doc_id, ' ' || {text.sql_matched("text")} || ' ' AS view FROM documents) JOIN {_TAXONOMY} ON contains(view, ' ' || variant || ' ') GROUP BY doc_id),
c AS (SELECT doc_id // 5 AS grp, doc_id, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) AS hint, list_sort(list_filter(coalesce(s, []), lambda x: list_contains(['attion', 'inthe', 'ment', 'thing'], x) OR x = 'mente')) AS m, coalesce(text, '') AS t FROM documents LEFT JOIN o USING (doc_id)),
x AS (SELECT *, least(9.5, greatest(3.5, round(4.0 + len(m) / 4.0::DOUBLE * 5.5, 1)))::DOUBLE AS skills, least(9.5, greatest(4.0, round(6.0 + CASE WHEN regexp_matches(lower(t), '\\b([2-9]|1[0-5])\\s*(năm|years?)\\b') THEN 1.5 ELSE 0.5 END + hint * 0.2::DOUBLE, 1)))::DOUBLE AS experience,
  round(7.0 + CASE WHEN regexp_matches(lower(t), '(đại học|cử nhân|thạc sĩ|kỹ sư|bachelor|master|university)') THEN 1.5 ELSE 0.5 END, 1)::DOUBLE AS education FROM c),
y AS (SELECT *, round(0.35::DOUBLE * skills + 0.35::DOUBLE * experience + 0.30::DOUBLE * education, 1) AS overall FROM x)
SELECT grp, doc_id, array_to_string(m, ',') AS matched, skills, overall, round(skills + experience + education + overall, 1) AS total, row_number() OVER (PARTITION BY grp ORDER BY round(skills + experience + education + overall, 1) DESC, overall DESC, hint) AS place FROM y""")
def comparison(spark, sf_dir):
    """Documents compared five at a time against four skills."""
    docs = table(spark, sf_dir, "documents")
    owned = skills.extract(docs, skills.taxonomy(spark), "doc_id").groupBy(F.col("doc").alias("doc_id")).agg(F.array_sort(F.collect_set("slug")).alias("s"))
    rows = docs.join(owned, "doc_id", "left").withColumns({"grp": F.floor(F.col("doc_id") / 5), "asked": F.array(*(F.lit(x) for x in ("Attion", "inthe", "ment", "thing")))})
    found = profiles.comparison(rows, "grp", "doc_id", "s", "asked", "text")
    return found.select("grp", "doc_id", F.array_join("matched", ",").alias("matched"), "skills", "overall", "total", "place")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([a-z]+)', 1) || '/repo' || (page_id % 7) AS repo FROM pages")
def repository_links(spark, sf_dir):
    said = F.concat(F.lit("see GitHub.com/"), F.regexp_extract("url", "^[a-z]+://([a-z]+)", 1), F.lit("/repo"), (F.col("page_id") % 7).cast("string"), F.lit(".git and github.com/topics/x"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(profiles.repositories(said), ",").alias("repo"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P') DESC, o_orderdate DESC, o_orderkey) = 1 AS is_default FROM orders")
def default_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("wanted", F.col("o_orderstatus") == "P")
    return profiles.default_flags(rows, "o_custkey", "o_orderkey", "wanted", F.desc("o_orderdate")).select("o_custkey", "o_orderkey", "is_default")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment IS DISTINCT FROM 'BUILDING' AND c_nationkey % 5 <> 0")
def guard_violations(spark, sf_dir):
    """Updates that set a guarded column without the role for it."""
    old = table(spark, sf_dir, "customer")
    new = old.where("c_custkey % 3 = 0").withColumns({"_new": F.lit("BUILDING"), "role": F.when(F.col("c_nationkey") % 5 == 0, "admin").otherwise("user")})
    found = profiles.guarded(old, new.drop("c_mktsegment").withColumnRenamed("_new", "c_mktsegment"), "c_custkey", "c_mktsegment", "role").select("c_custkey")
    return found.join(old, "c_custkey").select("c_custkey", "c_mktsegment")


@query("WITH m AS (SELECT item_id, n, unnest(range(1, (1 << n)::BIGINT)) AS mask FROM (SELECT item_id, (1 + item_id % 6)::INT AS n FROM benchmark)) SELECT item_id, count(*) AS subsets FROM m WHERE bit_count(mask) BETWEEN 1 AND 2 GROUP BY item_id")
def dropped_subsets(spark, sf_dir):
    items = F.sequence(F.lit(1), (F.col("item_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(profiles.dropped_subsets(items, 1, 2)).cast("long").alias("subsets"))


_POOL = ["rust", "scala", "perl", "ada", "lua", "zig", "nim"]


@query()
def seeded_decoys(spark, sf_dir):
    """A decoy for each ten documents, spliced of two and with skills swapped; the tests hold it to its seed under any partitioning."""
    docs = table(spark, sf_dir, "documents")
    made = seeded.decoys(docs, "doc_id", skills.taxonomy(spark), docs.count() // 10, _POOL, seed=7)
    return made.select("id", F.get("sources", F.lit(0)).alias("first"), F.get("sources", F.lit(1)).alias("second"), F.md5("text").alias("digest"))
