"""Rules over single records of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import guardrails, interviews, records, text, wording
from rankweave.operators import claims, skills
from rankweave.plans.registry import query
from rankweave.plans.retrieval import _TAXONOMY
from rankweave.sources.tables import spread, table

_KEYS = ["Ứng viên A", "Ứng viên B", "Ứng viên C"]


@query("SELECT doc_id, CASE WHEN trim(t, ' ' || chr(10)) = '' OR length(trim(t, ' ')) < 600 THEN 'degrade' ELSE 'pass' END AS action FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' || chr(10) ELSE text END AS t FROM documents)")
def parsed_gates(spark, sf_dir):
    """What the gate of parsed texts says of each document; one of nine is blank."""
    t = F.when(F.col("doc_id") % 9 == 0, " \n").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", records.parsed_gate(t, F.length(F.trim(t)) < text.LOW_CONTENT).alias("action"))


@query("SELECT doc_id, md5(replace(replace(left(t, 10000), '</file>', '&lt;/file&gt;'), '<file', '&lt;file')) AS digest FROM (SELECT doc_id, '<file name=\"x\">' || replace(text, '. ', '.</file> ') || '<FILE>' AS t FROM documents)")
def file_escapes(spark, sf_dir):
    """Documents as a model reads files: cut to its limit, with no tag of files in them."""
    t = F.concat(F.lit('<file name="x">'), F.replace("text", F.lit(". "), F.lit(".</file> ")), F.lit("<FILE>"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(records.escaped_file(t, 10_000)).alias("digest"))


_WAS = "['pending', 'confirmed', 'pending', 'declined'][o_orderkey % 4 + 1]"
_IS = "['confirmed', 'pending', 'declined', 'reschedule_requested', 'withdrawn'][o_orderkey % 5 + 1]"


@query(f"""SELECT o_orderkey, strftime(CASE WHEN was <> new AND was = 'pending' AND new IN ('confirmed', 'declined', 'reschedule_requested') AND given IS NULL THEN now ELSE given END, '%Y-%m-%d') AS responded, strftime(CASE WHEN r1 AND (at0 IS NULL OR NOT r0) THEN now WHEN NOT r1 THEN NULL ELSE at1 END, '%Y-%m-%d') AS read
FROM (SELECT o_orderkey, {_WAS} AS was, {_IS} AS new, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate - INTERVAL 1 DAY END AS given, o_orderdate AS now, o_orderkey % 2 = 0 AS r0, o_orderkey % 3 > 0 AS r1, CASE WHEN o_orderkey % 11 > 2 THEN o_orderdate - INTERVAL 9 DAY END AS at0, o_orderdate - INTERVAL 5 DAY AS at1 FROM orders)""")
def maintained_columns(spark, sf_dir):
    """The times of answers and of reading that an update of each order would leave."""
    k, now = F.col("o_orderkey"), F.col("o_orderdate")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (k % n).cast("int"))
    before = lambda days: now - F.expr(f"INTERVAL {days} DAYS")
    was, new = pick(["pending", "confirmed", "pending", "declined"], 4), pick(["confirmed", "pending", "declined", "reschedule_requested", "withdrawn"], 5)
    said = records.responded_at(was, new, F.when(k % 7 == 0, before(1)), now)
    read = records.read_at(k % 2 == 0, k % 3 > 0, F.when(k % 11 > 2, before(9)), before(5), now)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(said, "yyyy-MM-dd").alias("responded"), F.date_format(read, "yyyy-MM-dd").alias("read"))


_SAID = ["ung vien a", "B", "candidate c", "ỨNG VIÊN B", "cand_3", "the 2nd", "nobody", " Ứng viên A ", "30"]
_MEANT = ["'Ứng viên A'", "'Ứng viên B'", "'Ứng viên C'", "'Ứng viên B'", "'Ứng viên C'", "'Ứng viên B'", "NULL", "'Ứng viên A'", "'Ứng viên C'"]


@query(f"SELECT c_custkey, [{', '.join(_MEANT)}][c_custkey % {len(_MEANT)} + 1] AS label FROM customer")
def meant_labels(spark, sf_dir):
    """Which of three compared candidates is meant, by name, letter or number."""
    said = F.get(F.array(*map(F.lit, _SAID)), (F.col("c_custkey") % len(_SAID)).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", records.label_of(said, F.array(*map(F.lit, _KEYS)), ("ứng viên", "candidate"), "cand").alias("label"))


_CATALOG = [("platform", ["machinery", "devops"], "Platform", "ab", "cdefg"), ("data", ["building", "data", "furni"], "Data", "hijklmn", "hop"), ("retail", ["household goods", "auto"], "Retail", "qr", "q")]
_ASKED = ["intern", "Junior ", "senior", "none", None, "lead", "fresher"]


@query("""WITH c(pos, category, aliases, name, core, advanced) AS (VALUES """ + ", ".join(f"({i}, '{c}', {a}, '{n}', string_split('{','.join(core)}', ','), string_split('{','.join(adv)}', ','))" for i, (c, a, n, core, adv) in enumerate(_CATALOG)) + f"""),
r AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE lower(c_mktsegment) END AS role, coalesce(lower(trim([{', '.join("NULL" if x is None else f"'{x}'" for x in _ASKED)}][c_custkey % {len(_ASKED)} + 1])), 'middle') AS asked FROM customer),
m AS (SELECT c_custkey, min(pos) AS pos FROM (SELECT c_custkey, CASE role WHEN '' THEN 'software engineer' ELSE role END AS said FROM r) JOIN c ON len(list_filter(aliases, lambda a: contains(said, a) OR contains(a, said))) > 0 GROUP BY c_custkey),
s AS (SELECT c_custkey, category, name, CASE WHEN asked IN ('intern', 'fresher', 'junior', 'middle', 'senior', 'lead') THEN asked ELSE 'middle' END AS level, core, advanced FROM r LEFT JOIN m USING (c_custkey) JOIN c ON c.pos = coalesce(m.pos, 0))
SELECT c_custkey, category, level, CASE level WHEN 'intern' THEN 0 WHEN 'fresher' THEN 1 WHEN 'junior' THEN 2 WHEN 'middle' THEN 3 WHEN 'senior' THEN 5 ELSE 7 END AS years,
  array_to_string(CASE WHEN level IN ('intern', 'fresher') THEN core[1:5] WHEN level = 'junior' THEN core ELSE list_concat(core, list_filter(advanced[1:4], lambda x: NOT list_contains(core, x))) END, '') AS skills FROM s""")
def role_benchmarks(spark, sf_dir):
    """The benchmark of a role (a customer's segment here) and level by aliases."""
    strings = lambda xs: F.array(*map(F.lit, xs))
    catalog = F.array(*(F.struct(F.lit(c).alias("category"), strings(a).alias("aliases"), F.lit(n).alias("name"), strings(core).alias("core"), strings(adv).alias("advanced")) for c, a, n, core, adv in _CATALOG))
    k = F.col("c_custkey")
    found = records.benchmark(F.when(k % 13 == 0, "").otherwise(F.col("c_mktsegment")), F.get(F.array(*map(F.lit, _ASKED)), (k % len(_ASKED)).cast("int")), catalog)
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("b")).select("c_custkey", "b.category", "b.level", "b.years", F.array_join("b.skills", "").alias("skills"))


_NORMAL = guardrails.sql_normalized("text")
_HITS = lambda t: f"(SELECT DISTINCT doc_id, slug FROM (SELECT doc_id, ' ' || {text.sql_matched(t)} || ' ' AS view FROM p) JOIN {_TAXONOMY} ON contains(view, ' ' || variant || ' '))"


@query(f"""WITH p AS MATERIALIZED (SELECT doc_id, text, {guardrails.sql_sanitized(_NORMAL)} AS body, regexp_extract(text, '^[^.\\n]*') AS summary FROM documents),
f AS {_HITS("text")}, o AS {_HITS("summary")}, w AS (SELECT doc_id, count(*) AS full_count, count(*) FILTER (doc_id IN (SELECT doc_id FROM o WHERE o.slug = f.slug)) AS kept FROM f GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id)
SELECT p.doc_id, length(text) AS chars, len(regexp_extract_all(text, '\\S+')) AS words, len(regexp_extract_all(body, '\\[REDACTED_[A-Z]+\\]')) AS redacted, coalesce(n, 0) AS production_count, coalesce(full_count, 0) AS full_count, coalesce(full_count - kept, 0) AS lost, coalesce(n, 0) - coalesce(kept, 0) AS gained,
  CASE WHEN full_count > 0 THEN round(coalesce(n, 0) / full_count::DOUBLE, 3) END AS recall, length(summary) AS summary_chars, trim(summary) = '' AS summary_empty, coalesce(len(embedding), 0) AS dim, CASE WHEN embedding IS NOT NULL THEN round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) END AS norm
FROM p LEFT JOIN w USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN embeddings ON vec_id = p.doc_id""")
def ingest_records(spark, sf_dir):
    """What the ingest of each document has to report: its text, what was redacted, skills kept by its summary (its first sentence here), its vector."""
    docs, terms = table(spark, sf_dir, "documents").select("doc_id", "text"), skills.taxonomy(spark)
    docs = spread(docs.withColumn("summary", F.regexp_extract("text", r"^[^.\n]*", 0)))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return claims.ingest_record(docs, "doc_id", "text", "summary", terms, vectors)


_WANTED = ["thing", "ertion", "inthe", "mente", "onher", "thble", "thtion"]
_LACKING = "[" + ", ".join(f"'{w}'" for w in _WANTED) + "]"
_CUT = lambda xs, n: f"array_to_string({xs}[1:{n}], ', ')"


@query(f"""WITH p AS MATERIALIZED (SELECT doc_id, text FROM documents), f AS {_HITS("text")}, o AS (SELECT doc_id, list(slug ORDER BY slug) AS owned FROM f GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(owned, []) AS owned, (doc_id % 7)::DOUBLE AS years, (doc_id % 97)::DOUBLE AS score, (doc_id % 11) / 10.0 AS confidence FROM p LEFT JOIN o USING (doc_id)),
s AS (SELECT *, list_filter({_LACKING}, lambda x: list_contains(owned, x)) AS matched, list_filter({_LACKING}, lambda x: NOT list_contains(owned, x)) AS missing, list_filter(owned, lambda x: NOT list_contains({_LACKING}, x)) AS other FROM r)
SELECT doc_id, array_to_string(list_filter([CASE WHEN len(matched) > 0 THEN 'Kỹ năng cốt lõi đáp ứng chuẩn ngành: ' || {_CUT("matched", 8)} END, CASE WHEN len(other) > 0 THEN 'Kỹ năng thực chiến có bằng chứng dự án mạnh: ' || {_CUT("other", 5)} END,
    CASE WHEN len(owned) > 0 THEN 'Kỹ năng được sử dụng trực tiếp trong công việc/dự án: ' || {_CUT("owned", 5)} END, CASE WHEN years >= 3 THEN 'Kinh nghiệm thực tế (' || years || ' năm) đáp ứng tốt yêu cầu cấp bậc MIDDLE' END], lambda x: x IS NOT NULL), chr(10)) AS strengths,
  array_to_string(list_filter([CASE WHEN len(missing) > 0 THEN 'Kỹ năng trọng tâm của ngành cần bổ sung: ' || {_CUT("missing", 8)} END, CASE WHEN len(other) > 0 THEN 'Kỹ năng thiếu dự án chứng minh (Ghost Skills): ' || {_CUT("other", 5)} END,
    CASE WHEN years < 3 THEN 'Kinh nghiệm thực chiến (' || years || ' năm) còn thấp hơn chuẩn kỳ vọng (3 năm)' END], lambda x: x IS NOT NULL), chr(10)) AS weaknesses,
  array_to_string(list_filter(list_concat(list_concat([CASE WHEN len(missing) > 0 THEN 'Focus on these critical skills: ' || {_CUT("missing", 3)} END], list_transform(missing[1:3], lambda x: CASE x WHEN 'thing' THEN 'Before learning thing, consider: a, b' WHEN 'mente' THEN 'Before learning mente, consider: c' END)),
    [CASE WHEN score < 60 THEN 'Consider taking on more responsibilities or projects to demonstrate growth' END, CASE WHEN score < 70 THEN 'Your seniority level may not fully match this position. Consider roles at a slightly different level.' END, CASE WHEN len(missing) = 0 AND score >= 70 THEN '{wording.NOTHING_MORE}' END]), lambda x: x IS NOT NULL), chr(10)) AS recommended,
  array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN '[Cảnh báo rủi ro] five' END, CASE WHEN confidence < 0.6 THEN 'Dữ liệu đầu vào hạn chế, độ chính xác của đánh giá có thể bị ảnh hưởng.' END, CASE WHEN len(missing) > 5 THEN 'Có ' || len(missing) || ' kỹ năng quan trọng bị thiếu.' END,
    CASE WHEN score < 50 THEN 'Chênh lệch kinh nghiệm đáng kể với yêu cầu.' END, CASE WHEN len(matched) * 100 / 7.0 < 30 THEN 'Tỷ lệ match kỹ năng thấp, cần đánh giá kỹ hơn về khả năng học hỏi.' END], lambda x: x IS NOT NULL), chr(10)) AS warned FROM s""")
def assessment_texts(spark, sf_dir):
    """Strengths, weaknesses, recommendations and warnings of each document as a profile, by the skills that it names; years and scores by its id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    owned = skills.extract(docs, skills.taxonomy(spark), "doc_id").groupBy(F.col("doc").alias("doc_id")).agg(F.array_sort(F.collect_set("slug")).alias("owned"))
    none, wanted, k = F.array().cast("array<string>"), F.array(*map(F.lit, _WANTED)), F.col("doc_id")
    rows = docs.select("doc_id").join(owned, "doc_id", "left").withColumn("owned", F.coalesce("owned", none))
    rows = rows.withColumns({"matched": F.array_intersect(wanted, "owned"), "missing": F.array_except(wanted, "owned"), "other": F.array_except("owned", wanted)})
    years, score = (k % 7).cast("double"), (k % 97).cast("double")
    before = F.create_map(F.lit("thing"), F.array(*map(F.lit, "abc")), F.lit("mente"), F.array(F.lit("c")), F.lit("onher"), none)
    c = F.col
    said = {
        "strengths": wording.strengths(c("matched"), c("other"), c("owned"), years, F.lit(3), F.lit("middle")), "weaknesses": wording.weaknesses(c("missing"), c("other"), years, F.lit(3)),
        "recommended": wording.recommendations(c("missing"), before, score, score),
        "warned": wording.warnings(F.when(k % 5 == 0, F.array(F.lit("five"))), (k % 11) / 10.0, c("missing"), score, F.size("matched") * 100 / 7.0),
    }
    return rows.select("doc_id", *(F.array_join(v, "\n").alias(n) for n, v in said.items()))


_REQUIRED = ["1-URGENT", "high", " 3-Medium", "LOW", "kafka", "Not Specified", "spark"]
_ASKED_FOR = "list_transform([" + ", ".join(f"'{r}'" for r in _REQUIRED) + "], lambda r, i: CASE WHEN (o_custkey + i - 1) % 3 > 0 THEN r END)"


def _sessions(spark, sf_dir):
    """Each customer's orders as the questions of a session, in their order, and what the session must cover."""
    k = F.col("o_orderkey")
    kind = F.get(F.array(*map(F.lit, ["technical", "behavioral", "system_design", "problem_solving"])), (k % 4).cast("int"))
    text = F.concat("o_orderpriority", F.lit(" question "), (k % 40).cast("string"))
    asked = F.struct("o_orderkey", F.struct(text.alias("text"), kind.alias("category"), F.lit("medium").alias("difficulty"), F.col("o_orderpriority").alias("mapped")).alias("q"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(asked)).alias("every"))
    wanted = F.array_compact(F.array(*(F.when((F.col("o_custkey") + i) % 3 > 0, F.lit(r)) for i, r in enumerate(_REQUIRED))))
    return rows.select("o_custkey", F.transform("every", lambda e: e["q"]).alias("questions"), wanted.alias("wanted"))


@query(f"""WITH s AS (SELECT o_custkey, list(DISTINCT lower(o_orderpriority)) AS m, list_filter({_ASKED_FOR}, lambda r: r IS NOT NULL) AS wanted FROM orders GROUP BY o_custkey),
c AS (SELECT *, list_filter(wanted, lambda r: len(list_filter(m, lambda x: contains(x, lower(trim(r))) OR contains(lower(trim(r)), x))) = 0) AS missing FROM s)
SELECT o_custkey, array_to_string(missing, '|') AS missing, round_even((len(wanted) - len(missing))::DOUBLE / len(wanted), 2) AS ratio, (len(wanted) - len(missing))::DOUBLE / len(wanted) >= 0.8 AS passed FROM c""")
def question_coverage(spark, sf_dir):
    """What each session's questions leave uncovered, a question covering what holds its subject or is held by it."""
    found = _sessions(spark, sf_dir).select("o_custkey", interviews.coverage(F.col("questions"), F.col("wanted")).alias("c"))
    return found.select("o_custkey", F.array_join("c.missing", "|").alias("missing"), "c.ratio", "c.passed")


@query()
def interview_plans(spark, sf_dir):
    """Each session's plan after refining; equal to a loop in the tests."""
    found = _sessions(spark, sf_dir).select("o_custkey", interviews.planned(F.col("questions"), F.col("wanted")).alias("p"))
    return found.select("o_custkey", F.size("p.questions").alias("questions"), F.array_join("p.missing", "|").alias("missing"), "p.ratio", "p.passed")
