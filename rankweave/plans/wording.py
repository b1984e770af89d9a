"""Wording and payload rules over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import guardrails, payloads, text, wording
from rankweave.plans.registry import query
from rankweave.sources.tables import spread, table

_RULES = [(1, ["thing", "attion"], ["ertion"]), (2, ["the "], []), (3, ["ing "], ["thing"])]
_PLACES = {"building": "Hanoi", "machinery": "Hue"}


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN trim(c_name) ELSE concat_ws(' ', nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, ''), c_name) END AS query_text,
  CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ' ' || c_name WHEN c_custkey % 4 = 1 THEN c_name ELSE 'whole' END AS profile_text,
  concat_ws(chr(10), 'name: ' || c_name, CASE WHEN c_custkey % 2 = 0 THEN 'segment: ' || c_mktsegment END) AS lines FROM customer""")
def query_texts(spark, sf_dir):
    """The ladders of fallbacks for query texts, and the lines of a profile."""
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    ask = wording.job_query_text(F.when(k % 3 == 0, F.concat(F.lit(" "), name)).otherwise("  "), F.when(k % 2 == 0, segment).otherwise(""), name)
    titles = F.when(k % 4 == 0, F.array(segment, F.lit(None).cast("string"), name)).otherwise(F.array().cast("array<string>"))
    own = wording.profile_query_text(titles, F.when(k % 4 == 1, name).otherwise(" "), F.lit("whole"))
    lines = wording.profile_lines({"name": name, "segment": F.when(k % 2 == 0, segment).otherwise(" ")})
    return table(spark, sf_dir, "customer").select("c_custkey", ask.alias("query_text"), own.alias("profile_text"), lines.alias("lines"))


_REAL = "list_filter(list_transform({}, lambda x: trim(x, ' ')), lambda x: x <> '')"


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(lower(t), '{wording.VI_MARKS}') OR regexp_matches({text.sql_matched("t")}, '{wording.VI_TOKENS}') THEN 'vi' ELSE 'en' END AS lang,
  len(CASE WHEN len(l) >= 4 THEN l ELSE {_REAL.format("string_split(regexp_replace(t, '([.。])\\s+', '\\1' || chr(1), 'g'), chr(1))")} END)::INT AS lines,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(substr(t, 1, 80)), '\\(.*?\\)', '', 'g'), '[^a-zà-ỹ0-9 ]', '', 'g'), '\\s+', ' ', 'g'), ' ') AS key,
  array_to_string(list_filter([CASE WHEN (contains(p, 'thing') OR contains(p, 'attion')) AND NOT contains(p, 'ertion') THEN '1' END, CASE WHEN contains(p, 'the ') THEN '2' END, CASE WHEN contains(p, 'ing ') AND NOT contains(p, 'thing') THEN '3' END], lambda x: x IS NOT NULL), ',') AS labels
FROM (SELECT doc_id, text AS t, {_REAL.format("string_split(text, chr(10))")} AS l, ' ' || lower(substr(text, 1, 80)) || ' ' AS p FROM documents)""")
def wording_facts(spark, sf_dir):
    """Language by marks, lines or sentences, a key for repeats and keyword labels."""
    t = F.col("text")
    head = F.substring(t, 1, 80)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    marks = F.array_join(F.transform(wording.labels(head, _RULES), lambda x: x.cast("string")), ",")
    return docs.select("doc_id", wording.detected_language(t).alias("lang"), F.size(wording.body_lines(t)).alias("lines"), wording.dedup_key(head).alias("key"), marks.alias("labels"))


@query(f"""WITH s AS (SELECT item_id, text, list_filter(list_transform(string_split('- ' || substr(text, 1, 20) || chr(10) || '•b' || chr(10) || chr(10) || '* c ', chr(10)), lambda x: trim(regexp_replace(trim(x, ' '), '{wording.BULLETS}', ''), ' ')), lambda x: x <> '') AS items FROM benchmark),
w AS (SELECT item_id, list_filter([substr(text, 1, 8), 'zzz' || substr(text, 1, 3), ''], lambda t: len(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+')) > 0 AND len(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT contains(lower(text), w))) = 0) AS grounded FROM benchmark)
SELECT item_id, array_to_string(items, '|') AS items, array_to_string(grounded, '|') AS grounded, CASE WHEN item_id % 2 = 0 THEN 'Data Engineer|Lead' ELSE 'Data Engineer' END AS titles,
  CASE WHEN item_id % 3 = 0 THEN '' ELSE trim(replace(substr(text, 1, 30), chr(10), ' '), ' ') END AS summary, '{{"a": ' || item_id || '}}' AS unfenced FROM s JOIN w USING (item_id)""")
def model_output_rules(spark, sf_dir):
    """Lists, titles, summaries and fences as a model writes them."""
    t, k = F.col("text"), F.col("item_id")
    listed = F.concat(F.lit("- "), F.substring(t, 1, 20), F.lit("\n•b\n\n* c "))
    titles = F.when(k % 2 == 0, F.array(*(F.lit(x) for x in ("Data Engineer ", "data engineer", "N/A", "Lead", "")))).otherwise(F.array(F.lit("Data Engineer"), F.lit("none")))
    grounded = wording.grounded_titles(F.array(F.substring(t, 1, 8), F.concat(F.lit("zzz"), F.substring(t, 1, 3)), F.lit("")), t)
    summary = wording.clean_summary(F.when(k % 3 == 0, "1-3 Sentences").otherwise(F.substring(t, 1, 30)))
    fenced = F.concat(F.lit("```json\n{\"a\": "), k.cast("string"), F.lit("}\n``` "))
    join = lambda c: F.array_join(c, "|")
    return table(spark, sf_dir, "benchmark").select(
        "item_id", join(wording.requirements(listed)).alias("items"), join(grounded).alias("grounded"), join(wording.clean_titles(titles, ["n/a", "none"])).alias("titles"),
        summary.alias("summary"), wording.unfenced(fenced).alias("unfenced"),
    )


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Remote' ELSE CASE lower(c_mktsegment) WHEN 'building' THEN 'Hanoi' WHEN 'machinery' THEN 'Hue' ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END || CASE WHEN lower(c_mktsegment) = 'building' THEN '' ELSE ', Hanoi' END END AS place,
  CASE c_custkey % 3 WHEN 0 THEN 'part_time' WHEN 1 THEN 'internship' ELSE 'full_time' END AS contract FROM customer""")
def seeded_fields(spark, sf_dir):
    """Places and kinds of contract of job postings by their usual names."""
    k = F.col("c_custkey")
    raw = F.when(k % 5 != 0, F.concat(F.col("c_mktsegment"), F.lit(", building,BUILDING")))
    kind = F.when(k % 3 == 0, "Bán thời gian, Khác").when(k % 3 == 1, "Thực tập").otherwise("anything")
    return table(spark, sf_dir, "customer").select("c_custkey", wording.location(raw, _PLACES).alias("place"), wording.contract(kind).alias("contract"))


@query("""SELECT p_partkey, left(trim(regexp_replace(regexp_replace(p_name || ' - ' || p_brand || chr(10) || p_type || ' a@b.org 1999' || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'quote ' || p_size ELSE '' END, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', ' ', 'g'), '\\b(19|20)\\d{2}\\b', ' ', 'g'), ''), 2000) AS document,
  CASE WHEN p_size % 4 = 0 THEN 'Đạt điểm phù hợp (' || round_even(p_size / 100.0::DOUBLE * 100, 0)::INT || '%) nhờ đáp ứng các kỹ năng cốt lõi: spark, java, xếp thứ ' || p_size || '/50 trong shortlist.'
    WHEN p_size % 4 = 1 THEN 'Ứng viên có các kỹ năng (go) nhưng chưa đáp ứng yêu cầu cốt lõi của vị trí (' || round_even(p_size / 100.0::DOUBLE * 100, 0)::INT || '%), xếp thứ ' || p_size || '/50 trong shortlist.'
    ELSE 'Hồ sơ chưa có kỹ năng chuyên môn phù hợp với yêu cầu của vị trí (' || round_even(p_size / 100.0::DOUBLE * 100, 0)::INT || '%), xếp thứ ' || p_size || '/50 trong shortlist.' END AS reason FROM part""")
def rerank_inputs(spark, sf_dir):
    """What a rerank model would read of a part, and the sentence that explains a row without a model."""
    n = F.col("p_size")
    quotes = F.when(n % 2 == 0, F.array(F.concat(F.lit(" quote "), n.cast("string")), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    read = wording.rerank_text(F.col("p_name"), F.col("p_brand"), F.concat(F.col("p_type"), F.lit(" a@b.org 1999")), quotes)
    none = F.array().cast("array<string>")
    owned = F.when(n % 4 == 0, F.array(F.lit("spark"), F.lit("java "), F.lit("go"))).when(n % 4 == 1, F.array(F.lit("go"))).otherwise(none)
    said = wording.reason(owned, F.array(F.lit("java"), F.lit("spark")), n / 100.0, n, F.lit(50))
    return table(spark, sf_dir, "part").select("p_partkey", read.alias("document"), said.alias("reason"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Customer' ELSE '' END AS leaked FROM customer")
def name_leaks(spark, sf_dir):
    """Tokens of a name that a text still holds; accents and case aside."""
    said = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("by "), F.lower("c_name"))).otherwise("customers and other words")
    found = wording.leaked_names(said, F.regexp_replace("c_name", "^Customer", "Customér An"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(found, lambda w: F.initcap(w)), ",").alias("leaked"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 3 END AS dims, k AS must, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END AS preferred, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'r' || event_id END AS reason, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS cells, k + 1 AS plus FROM (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events)")
def json_payloads(spark, sf_dir):
    """Vectors, constraints, model output and list cells read from text, and an object built."""
    i = F.col("event_id")
    vec = payloads.vector(F.when(i % 4 == 0, "[1, \"x\"]").otherwise("[1.5, 2, -3e1]"))
    body = F.concat(F.lit('{"must": [{"any_of": ["'), F.get_json_object("props", "$.k"), F.lit('"]}]'), F.when(i % 2 == 0, ', "preferred": ["x"]').otherwise(""), F.lit("}"))
    read = payloads.constraints(body)
    said = payloads.string_map(F.when(i % 3 == 0, "no json at all").otherwise(F.concat(F.lit('```json\n{"'), i.cast("string"), F.lit('": " r'), i.cast("string"), F.lit(' ", "b": ""}\n```'))))
    cells = payloads.literal_list(F.when(i % 3 == 0, "['a', \"b\", '']").when(i % 3 == 1, "plain, text").otherwise(" "))
    built = F.to_json(F.struct((F.get_json_object("props", "$.k").cast("bigint") + 1).alias("plus")))
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(vec.isNotNull(), F.size(vec)).alias("dims"), read["must"][0]["any_of"][0].cast("bigint").alias("must"), F.array_join(read["preferred"], ",").alias("preferred"),
        F.coalesce(F.try_element_at(said, i.cast("string")), F.lit("")).alias("reason"), F.size(cells).alias("cells"), F.get_json_object(built, "$.plus").cast("bigint").alias("plus"),
    )


_TAILS = ["", "", "", " Traceback (most recent call last): x", " my system prompt says", " api_key=abcdef0123", " internal tables: a, b", " own-credential-0123", " mail a.b@c.org", ' File "x.py", line 3']
_TAILED = "trim(coalesce(text, '') || [" + ", ".join(guardrails.q(t) for t in _TAILS) + f"][(conv_id * 3 + turn) % {len(_TAILS)} + 1], {guardrails.q(guardrails.SPACES)})"


@query(f"""SELECT conv_id, turn, CASE WHEN contains(v, 'own-credential-0123') THEN 'OUTPUT_SECRET_DETECTED' WHEN regexp_matches(v, {guardrails.q(guardrails.STACK_TRACE)}) THEN 'OUTPUT_INTERNAL_ERROR_LEAK'
  WHEN regexp_matches(v, {guardrails.q(guardrails.DISCLOSURE)}) OR regexp_matches(v, {guardrails.q(guardrails.ARCHITECTURE)}) THEN 'OUTPUT_PROMPT_LEAKAGE' WHEN len({guardrails.sql_secrets("v")}) > 0 THEN 'OUTPUT_PII_DETECTED'
  WHEN v = '' OR length(v) > 400 THEN 'OUTPUT_INVALID_SCHEMA' WHEN s <> n AND s = '' THEN 'OUTPUT_PII_DETECTED' WHEN NOT contains(lower(CASE WHEN s <> n THEN s ELSE v END), 'the') THEN 'OUTPUT_UNGROUNDED' WHEN s <> n THEN 'OUTPUT_PII_DETECTED' END AS code
FROM (SELECT *, {guardrails.sql_sanitized("n")} AS s FROM (SELECT *, {guardrails.sql_normalized("v")} AS n FROM (SELECT conv_id, turn, {_TAILED} AS v FROM conversations WHERE role = 'assistant')))""")
def output_checks(spark, sf_dir):
    """What is wrong with the answers of a chat as generated texts that must rest on the word `the`; endings that break each rule are put behind some."""
    tail = F.get(F.array(*map(F.lit, _TAILS)), F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(len(_TAILS))).cast("int"))
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    checked = guardrails.checked_output(F.concat(F.coalesce("text", F.lit("")), tail), F.array(F.lit("the")), 400, "", ["own-credential-0123", "short"])
    return said.select("conv_id", "turn", checked["code"].alias("code"))
