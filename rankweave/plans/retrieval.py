"""Retrieval, fusion and skill queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions import numbers, text
from rankweave.operators import retrieval, skills
from rankweave.plans.registry import query
from rankweave.sources.tables import kept, spread, table

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TAXONOMY = "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in skills.TAXONOMY) + ") AS taxonomy(variant, slug, category, role)"



def _bm25_sql(docs: str, doc_id: str, queries: str, query_id: str) -> str:
    """CTEs up to lexical (query, doc, score): BM25 of every query text on every document that shares a term."""
    words = lambda of: f"list_filter(regexp_split_to_array(lower(coalesce({of}, '')), '{text.TOKEN_SEPARATOR}'), lambda t: t <> '')"
    return f"""
doc_tokens AS (SELECT {doc_id} AS doc, {words("text")} AS tokens FROM {docs}),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM doc_tokens),
tf AS (SELECT doc, length, term, count(*) AS tf FROM (SELECT doc, len(tokens) AS length, unnest(tokens) AS term FROM doc_tokens) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT query, term, count(*) AS times FROM (SELECT {query_id} AS query, unnest({words("text")}) AS term FROM {queries}) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
lexical AS (SELECT query, doc, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM tf JOIN qt USING (term) JOIN df USING (term) CROSS JOIN stats GROUP BY ALL)"""


_BM25 = _bm25_sql("documents", "doc_id", "benchmark", "item_id")

_DENSE = """
dense AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS distance
  FROM embeddings q JOIN embeddings d ON d.vec_id <> q.vec_id AND len(d.embedding) = len(q.embedding) WHERE q.vec_id % 100 = 0)"""


def _lexical(spark, sf_dir: str, k: int) -> DataFrame:
    return retrieval.bm25_top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", k)


def _dense(spark, sf_dir: str, k: int, **how) -> DataFrame:
    """The queries are the vectors whose id is divisible by 100, against all."""
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.dense_top(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "vec_id", k, **how)


@query(f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM lexical) SELECT query AS item_id, doc AS doc_id, score, place, rank() OVER (PARTITION BY query ORDER BY score DESC) AS rank FROM r WHERE place <= 10")
def bm25_topk(spark, sf_dir):
    """For every benchmark item its ten best documents by BM25."""
    return retrieval.top(_lexical(spark, sf_dir, 10), 10).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "place", "rank")


@query(f"WITH {_BM25} SELECT query AS item_id, count(*) AS docs, max(score) AS best, round(avg(score), 4) AS mean FROM lexical GROUP BY query")
def bm25_summary(spark, sf_dir):
    """How many documents each item matches, and how well."""
    found = retrieval.bm25_summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return found.select(F.col("query").alias("item_id"), "docs", "best", F.round(F.col("total") / F.col("docs"), 4).alias("mean"))


@query(f"WITH {_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, doc) AS place FROM dense) SELECT query, doc, distance, place, round(CASE WHEN 1 - distance <= 0.65 THEN 0.0 ELSE least(1.0, (1 - distance - 0.65) / 0.35) END, 6) AS semantic FROM r WHERE place <= 10")
def dense_topk(spark, sf_dir):
    """The ten nearest vectors of each query vector, with their semantic scores."""
    best = retrieval.top(_dense(spark, sf_dir, 10), 10, score="distance", descending=False)
    return best.select("query", "doc", "distance", "place", F.round(numbers.semantic_score(F.col("distance")), 6).alias("semantic"))


#: Fixed value: a cached answer is close enough over this similarity. The test vectors have none so close, so the query takes a lower one.
CACHE_SIMILARITY, TESTED_SIMILARITY = 0.95, 0.5


@query(f"WITH {_DENSE} SELECT query, doc, round(1 - distance, 6) AS similarity FROM dense WHERE distance < {1 - TESTED_SIMILARITY} QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, doc) <= 3")
def semantic_cache(spark, sf_dir):
    """Cached answers close enough to a query: at most three."""
    return _dense(spark, sf_dir, 3, below=1 - TESTED_SIMILARITY).select("query", "doc", F.round(1 - F.col("distance"), 6).alias("similarity"))


_LISTS = f"""{_BM25}, {_DENSE.replace("q.vec_id % 100 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)")},
bl AS (SELECT query, doc, rank() OVER (PARTITION BY query ORDER BY score DESC) AS rank FROM (SELECT * FROM lexical QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 50)),
dl AS (SELECT query, doc, distance, rank() OVER (PARTITION BY query ORDER BY distance) AS rank FROM (SELECT * FROM dense QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, doc) <= 50))"""


def _lists(spark, sf_dir):
    """Both top-50 lists of each item: BM25 over documents, and distances between the vectors of equal ids."""
    vectors, items = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark")
    asked = vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = retrieval.dense_top(vectors, asked, "vec_id", "vec_id", 50)
    return retrieval.top(_lexical(spark, sf_dir, 50), 50), retrieval.top(near, 50, score="distance", descending=False)


@query(f"WITH {_LISTS}, f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS raw FROM (SELECT query, doc, rank FROM bl UNION ALL SELECT query, doc, rank FROM dl) GROUP BY ALL) SELECT query, doc, round(raw, 9) AS raw, round(greatest(0.0, least(1.0, raw / (2.0::DOUBLE / 61))), 6) AS norm, row_number() OVER (PARTITION BY query ORDER BY raw DESC, doc) AS place FROM f")
def rrf_fusion(spark, sf_dir):
    """Reciprocal rank fusion of the lexical and the dense list of every item."""
    return retrieval.fuse(list(_lists(spark, sf_dir))).select("query", "doc", F.round("raw", 9).alias("raw"), F.round("norm", 6).alias("norm"), "place")


@query(f"WITH {_LISTS} SELECT dl.query, dl.doc, round(0.6 / (60 + dl.rank) + 0.4 / (60 + coalesce(bl.rank, 50)), 9) AS score FROM dl LEFT JOIN bl ON bl.query = dl.query AND bl.doc = dl.doc")
def hybrid_search(spark, sf_dir):
    """Dense hits weighed with their lexical rank; a hit without one counts as the last of the list."""
    lexical, near = _lists(spark, sf_dir)
    both = near.select("query", "doc", "rank").join(lexical.select("query", "doc", F.col("rank").alias("r2")), ["query", "doc"], "left")
    return both.select("query", "doc", F.round(0.6 / (60 + F.col("rank")) + 0.4 / (60 + F.coalesce("r2", F.lit(50))), 9).alias("score"))


_SKILLS = f"""skills AS (SELECT DISTINCT doc_id, slug FROM (SELECT doc_id, ' ' || {text.sql_matched("text")} || ' ' AS view FROM documents) JOIN {_TAXONOMY} ON contains(view, ' ' || variant || ' ')),
wanted AS (SELECT item_id, list(DISTINCT slug) AS wanted FROM (SELECT item_id, ' ' || {text.sql_matched("text")} || ' ' AS view FROM benchmark) JOIN {_TAXONOMY} ON contains(view, ' ' || variant || ' ') GROUP BY item_id),
owned AS (SELECT doc_id, list(DISTINCT slug) AS owned FROM skills GROUP BY doc_id)"""


@query(f"WITH {_SKILLS} SELECT doc_id AS doc, slug FROM skills")
def skill_extract_exact(spark, sf_dir):
    return skills.extract(table(spark, sf_dir, "documents"), skills.taxonomy(spark), "doc_id")


@query()
def skill_fuzzy(spark, sf_dir):
    """Words that nearly name a skill."""
    return skills.fuzzy(table(spark, sf_dir, "documents"), skills.taxonomy(spark), "doc_id")


@query(f"WITH a AS (SELECT DISTINCT slug, category FROM {_TAXONOMY}), r AS (SELECT a.slug, b.slug AS other, row_number() OVER (PARTITION BY a.slug ORDER BY b.slug) AS n FROM a JOIN a b ON a.category = b.category AND a.slug <> b.slug) SELECT slug, string_agg(other, ',' ORDER BY other) AS related FROM r WHERE n <= 8 GROUP BY slug")
def related_skills(spark, sf_dir):
    return skills.related(skills.taxonomy(spark)).select("slug", F.array_join("related", ",").alias("related"))


def _skill_sets(spark, sf_dir, pool: DataFrame | None = None):
    """(skills wanted by each item, skills owned by each document); with a pool, of the documents in it alone."""
    terms, docs = skills.taxonomy(spark), table(spark, sf_dir, "documents")
    docs = docs if pool is None else docs.join(pool.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    owned = skills.extract(docs, terms, "doc_id").groupBy("doc").agg(F.collect_set("slug").alias("owned"))
    wanted = skills.extract(table(spark, sf_dir, "benchmark"), terms, "item_id").groupBy(F.col("doc").alias("query")).agg(F.collect_set("slug").alias("wanted"))
    return wanted, owned


@query(f"WITH {_SKILLS}, top AS (SELECT item_id, wanted.wanted, doc_id, owned.owned, len(list_intersect(wanted.wanted, owned.owned)) AS hits FROM wanted JOIN owned ON list_has_any(wanted.wanted, owned.owned)) SELECT item_id AS query, doc_id AS doc, round(hits::DOUBLE / len(wanted), 6) AS coverage, round(hits::DOUBLE / len(list_distinct(list_concat(wanted, owned))), 6) AS jaccard, round(0.05 * hits, 6) AS soft FROM top")
def coverage_jaccard(spark, sf_dir):
    """Coverage, Jaccard and soft bonus of each item and each document that has one of its skills, by an equi-join on skills."""
    wanted, owned = _skill_sets(spark, sf_dir)
    hits = wanted.select("query", F.size("wanted").alias("n"), F.explode("wanted").alias("slug")).join(owned.select("doc", F.size("owned").alias("m"), F.explode("owned").alias("slug")), "slug")
    both = hits.groupBy("query", "doc", "n", "m").agg(F.count("*").alias("k"))
    return both.select("query", "doc", F.round(F.col("k") / F.col("n"), 6).alias("coverage"), F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6).alias("jaccard"), F.round(0.05 * F.col("k"), 6).alias("soft"))


def _candidates(spark, sf_dir):
    """Rows for the composite: the union of both lists with skills and constraints; items of odd ids have confirmed constraints."""
    lexical, near = _lists(spark, sf_dir)
    pool = kept(lexical.select("query", "doc", F.col("score").alias("bm25")).join(near.select("query", "doc", "distance"), ["query", "doc"], "full"), "pool")
    wanted, owned = _skill_sets(spark, sf_dir, pool)
    none = F.array().cast("array<string>")
    rows = pool.join(wanted, "query", "left").join(owned, "doc", "left")
    rows = rows.withColumns({"wanted": F.coalesce("wanted", none), "owned": F.coalesce("owned", none), "bm25": F.coalesce("bm25", F.lit(0.0))})
    return rows.withColumns({
        "verified": F.filter("owned", lambda s: s != "thble"), "must": F.array(F.slice(F.array_sort("wanted"), 1, 2)), "excluded": F.array(F.lit("ertion")),
        "confirmed": F.col("query") % 2 == 1, "evidence": F.size("owned") > 0,
    })


@query(f"""WITH {_LISTS}, {_SKILLS},
pool AS (SELECT coalesce(bl.query, dl.query) AS query, coalesce(bl.doc, dl.doc) AS doc, bl.rank AS r2, dl.rank AS r1, dl.distance FROM bl FULL JOIN dl ON bl.query = dl.query AND bl.doc = dl.doc),
rows AS (SELECT query, doc, distance, round(CASE WHEN r1 IS NULL THEN 0.0 ELSE 1.0::DOUBLE / (60 + r1) END + CASE WHEN r2 IS NULL THEN 0.0 ELSE 1.0::DOUBLE / (60 + r2) END, 12) AS raw,
  coalesce(wanted.wanted, []::VARCHAR[]) AS w, coalesce(owned.owned, []::VARCHAR[]) AS o, list_filter(coalesce(owned.owned, []::VARCHAR[]), lambda s: s <> 'thble') AS v, len(coalesce(owned.owned, []::VARCHAR[])) > 0 AS evidence, query % 2 = 1 AS confirmed
  FROM pool LEFT JOIN wanted ON item_id = query LEFT JOIN owned ON doc_id = doc),
s AS (SELECT *, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_intersect(w, CASE WHEN len(v) > 0 THEN v ELSE o END))::DOUBLE / len(w) END AS coverage, round(0.05 * len(list_intersect(w, v)), 6) AS soft,
  CASE WHEN NOT confirmed THEN 'ungated' WHEN NOT evidence THEN 'unknown' WHEN list_contains(v, 'ertion') THEN 'fail' WHEN len(w) = 0 OR list_has_any(list_slice(list_sort(w), 1, 2), v) THEN 'pass' ELSE 'fail' END AS status,
  greatest(0.0, least(1.0, raw / (2.0::DOUBLE / 61))) AS norm FROM rows)
SELECT query, doc, round(coverage, 6) AS coverage, soft, status, round(CASE WHEN len(w) = 0 THEN norm WHEN len(o) = 0 THEN least(norm * 0.1, 0.08) WHEN coverage = 0 THEN least(norm * 0.2, 0.15) ELSE norm END, 6) AS score,
  row_number() OVER (PARTITION BY query ORDER BY CASE WHEN NOT confirmed THEN 0 WHEN status IN ('pass', 'ungated') THEN 0 WHEN status = 'unknown' THEN 1 ELSE 2 END, raw DESC, CASE WHEN confirmed THEN 0.0 ELSE soft END DESC, doc) AS place FROM s""")
def score_candidates(spark, sf_dir):
    """The composite ranking of every item's pool: fusion, coverage, penalties and constraint groups."""
    scored = retrieval.score_candidates(_candidates(spark, sf_dir))
    return scored.select("query", "doc", F.round("coverage", 6).alias("coverage"), "soft", "status", F.round("score", 6).alias("score"), "place")


@query("""SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN least(s * 0.1, 0.08) WHEN c_nationkey % 5 = 0 THEN least(s * 0.2, 0.15) ELSE s END, 4)::DOUBLE AS calibrated
FROM (SELECT *, CASE WHEN r <= 0.65 THEN 0.0 ELSE least(1.0, (r - 0.65) / 0.35) END AS s FROM (SELECT *, (c_custkey % 97) / 97.0::DOUBLE AS r FROM customer))""")
def rerank_calibrate(spark, sf_dir):
    """Model scores after rescaling and skill penalties."""
    rows = table(spark, sf_dir, "customer").withColumn("r", (F.col("c_custkey") % 97) / 97.0)
    some, none = F.array(F.lit("a")), F.array().cast("array<string>")
    owned = F.when(F.col("c_acctbal") < 0, none).otherwise(some)
    cover = F.when(F.col("c_nationkey") % 5 == 0, 0.0).otherwise(1.0)
    return rows.select("c_custkey", retrieval.calibrated(F.col("r"), some, owned, cover, rescale=True).alias("calibrated"))


@query(f"WITH {_LISTS}, p AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY rank, doc) AS place FROM bl), s AS (SELECT *, CASE doc % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'ungated' WHEN 2 THEN 'unknown' ELSE 'fail' END AS status, doc % 4 AS g, CASE WHEN doc % 7 = 0 THEN NULL ELSE (doc % 13) / 13.0::DOUBLE END AS m FROM p), w AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY g, place) <= 20 AND m IS NOT NULL AS inside FROM s) SELECT query, doc, status, row_number() OVER (PARTITION BY query ORDER BY inside DESC, g, CASE WHEN inside THEN -m END, place, doc) AS new_place FROM w")
def rerank_window(spark, sf_dir):
    """The first 20 rows of each item by constraint group, reordered inside the groups by a model's score."""
    rows = retrieval.top(_lexical(spark, sf_dir, 50), 50).select("query", "doc", "place")
    status = F.element_at(F.array(*(F.lit(s) for s in numbers.STATUS_ORDER)), (F.col("doc") % 4 + 1).cast("int"))
    rows = rows.withColumns({"status": status, "model_score": F.when(F.col("doc") % 7 != 0, (F.col("doc") % 13) / 13.0)})
    return retrieval.rerank(rows, 20).select("query", "doc", "status", "new_place")


_REVERSE = _bm25_sql("benchmark", "item_id", "(SELECT * FROM documents WHERE doc_id % 100 = 0)", "doc_id")


@query(f"""WITH {_REVERSE}, {_SKILLS},
dense AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS distance
  FROM embeddings q JOIN embeddings d ON d.vec_id <> q.vec_id AND len(d.embedding) = len(q.embedding) WHERE q.vec_id % 100 = 0 AND d.vec_id IN (SELECT item_id FROM benchmark) AND q.vec_id IN (SELECT doc_id FROM documents)),
bl AS (SELECT * FROM lexical QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 50), dl AS (SELECT * FROM dense QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, doc) <= 50),
pool AS (SELECT coalesce(bl.query, dl.query) AS query, coalesce(bl.doc, dl.doc) AS doc, coalesce(score, 0.0) AS bm25, distance FROM bl FULL JOIN dl ON bl.query = dl.query AND bl.doc = dl.doc),
ranks AS (SELECT *, rank() OVER (PARTITION BY query ORDER BY distance NULLS LAST) AS r1, rank() OVER (PARTITION BY query ORDER BY CASE WHEN bm25 > 0 THEN bm25 END DESC NULLS LAST) AS r2 FROM pool),
rows AS (SELECT query, doc, bm25, round(CASE WHEN distance IS NULL THEN 0.0 ELSE 1.0::DOUBLE / (60 + r1) END + CASE WHEN bm25 > 0 THEN 1.0::DOUBLE / (60 + r2) ELSE 0.0 END, 12) AS raw,
  coalesce(wanted.wanted, []::VARCHAR[]) AS w, coalesce(owned.owned, []::VARCHAR[]) AS o, list_filter(coalesce(owned.owned, []::VARCHAR[]), lambda s: s <> 'thble') AS v, len(coalesce(owned.owned, []::VARCHAR[])) > 0 AS evidence, doc % 2 = 1 AS confirmed
  FROM ranks LEFT JOIN wanted ON item_id = doc LEFT JOIN owned ON doc_id = query),
s AS (SELECT *, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_intersect(w, o))::DOUBLE / len(w) END AS coverage, greatest(0.0, least(1.0, raw / (2.0::DOUBLE / 61))) AS norm,
  CASE WHEN NOT confirmed THEN 'ungated' WHEN NOT evidence THEN 'unknown' WHEN list_contains(v, 'ertion') THEN 'fail' WHEN len(w) = 0 OR list_has_any(list_slice(list_sort(w), 1, 2), v) THEN 'pass' ELSE 'fail' END AS status FROM rows)
SELECT query, doc, round(coverage, 6) AS coverage, status, round(CASE WHEN bm25 >= 1 THEN norm WHEN len(o) = 0 AND len(v) = 0 AND NOT evidence THEN least(norm * 0.1, 0.08) WHEN len(w) > 0 AND len(o) = 0 THEN least(norm * 0.1, 0.08) WHEN len(w) > 0 AND coverage = 0 THEN least(norm * 0.2, 0.15) ELSE norm END, 6) AS score,
  row_number() OVER (PARTITION BY query ORDER BY CASE status WHEN 'unknown' THEN 1 WHEN 'fail' THEN 2 ELSE 0 END, raw DESC, doc) AS place FROM s""")
def score_jobs(spark, sf_dir):
    """The reverse direction: every document whose id is divisible by 100 against all items, by both lists, skills and the items' constraints."""
    docs, items, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    asking = docs.where("doc_id % 100 = 0")
    lexical = retrieval.bm25_top(items, asking, "item_id", "doc_id", 50).withColumnRenamed("score", "bm25")
    asked = vectors.join(asking.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = retrieval.dense_top(vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), asked, "vec_id", "vec_id", 50)
    wanted, owned = _skill_sets(spark, sf_dir)
    none = F.array().cast("array<string>")
    rows = lexical.join(near, ["query", "doc"], "full").join(wanted.withColumnsRenamed({"query": "doc", "wanted": "skills"}), "doc", "left")
    rows = rows.join(owned.withColumnsRenamed({"doc": "query", "owned": "cv_skills"}), "query", "left").withColumns({c: F.coalesce(c, none) for c in ("skills", "cv_skills")})
    rows = rows.withColumns({
        "bm25": F.coalesce("bm25", F.lit(0.0)), "cv_verified": F.filter("cv_skills", lambda s: s != "thble"), "cv_evidence": F.size("cv_skills") > 0,
        "must": F.array(F.slice(F.array_sort("skills"), 1, 2)), "excluded": F.array(F.lit("ertion")), "confirmed": F.col("doc") % 2 == 1,
    })
    return retrieval.score_jobs(rows).select("query", "doc", F.round("coverage", 6).alias("coverage"), "status", F.round("score", 6).alias("score"), "place")


@query("""WITH w AS (SELECT p_partkey, unnest(list_filter(['#12', 'steel', 'part', '1', 'brand#12', 'it'], lambda w: length(w) > 1)) AS word FROM part),
t AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+') AS title, regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}]+') AS skills, regexp_extract_all(lower(p_brand), '[\\p{L}\\p{N}]+') AS company FROM part),
p AS (SELECT p_partkey, sum(2.0 * list_contains(title, trim(word, '#'))::INT + 1.5 * list_contains(skills, trim(word, '#'))::INT + 1.2 * list_contains(company, trim(word, '#'))::INT)::DOUBLE AS words FROM w JOIN t USING (p_partkey) GROUP BY ALL)
SELECT p_partkey, round(CASE WHEN contains(lower(p_name), '#12') OR contains('#' || p_partkey, '#12') THEN 5.0 ELSE 0.0 END + p_size % 3 * 2.0 + words, 6)::DOUBLE AS boost,
  round(CASE WHEN CASE WHEN contains(lower(p_name), '#12') OR contains('#' || p_partkey, '#12') THEN 5.0 ELSE 0.0 END + p_size % 3 * 2.0 + words > 0 THEN CASE WHEN p_size % 2 = 1 THEN 1.0 ELSE 0.5 END + CASE WHEN contains(lower(p_name), '#12') OR contains('#' || p_partkey, '#12') THEN 5.0 ELSE 0.0 END + p_size % 3 * 2.0 + words ELSE p_size % 2 END, 6)::DOUBLE AS bm25
FROM part JOIN p USING (p_partkey)""")
def keyword_boosts(spark, sf_dir):
    """Points for a request over a part's name, type, brand and number, and the BM25 score that they lift."""
    parts = {"title": F.col("p_name"), "skills": F.col("p_type"), "company": F.col("p_brand"), "body": F.lit(""), "location": F.lit(""), "id": F.concat(F.lit("#"), F.col("p_partkey").cast("string"))}
    boost = retrieval.keyword_boost(F.lit("#12 steel PART 1 brand#12 it?"), parts, (F.col("p_size") % 3).cast("double"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", boost.alias("boost"))
    return rows.select("p_partkey", F.round("boost", 6).alias("boost"), F.round(retrieval.boosted((F.col("p_size") % 2).cast("double"), F.col("boost")), 6).alias("bm25"))


@query("SELECT query, doc, label_match, place FROM (SELECT q.vec_id AS query, d.vec_id AS doc, (q.label = d.label)::INT AS label_match, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6), d.vec_id) AS place FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0) WHERE place <= least(80, 50)")
def vector_search_within(spark, sf_dir):
    """The nearest vectors of a query's own label, at most 50 whatever is asked for."""
    best = retrieval.top(_dense(spark, sf_dir, min(80, 50), label="label"), 50, score="distance", descending=False)
    return best.select("query", "doc", F.lit(1).alias("label_match"), "place")


_WORDED = """named AS (SELECT doc_id, list(slug ORDER BY slug) AS slugs FROM skills GROUP BY doc_id),
asked AS (SELECT item_id, list(DISTINCT slug ORDER BY slug) AS slugs FROM {hits} GROUP BY item_id),
docs_with AS (SELECT d.doc_id, trim(d.text || chr(10) || array_to_string(list_concat(slugs, list_transform(slugs, lambda s: replace(s, '_', ' '))), ' ')) AS text FROM (SELECT doc_id, text, coalesce(slugs, []) AS slugs FROM documents LEFT JOIN named USING (doc_id)) d),
items_with AS (SELECT item_id, trim(array_to_string(list_filter(list_concat([text], slugs, list_transform(slugs, lambda s: replace(s, '_', ' '))), lambda x: x <> ''), ' ')) AS text FROM (SELECT item_id, text, coalesce(slugs, []) AS slugs FROM benchmark LEFT JOIN asked USING (item_id)))"""
_ITEM_SKILLS = f"(SELECT DISTINCT item_id, slug FROM (SELECT item_id, ' ' || {text.sql_matched('text')} || ' ' AS view FROM benchmark) JOIN {_TAXONOMY} ON contains(view, ' ' || variant || ' '))"


def _named(spark, rows: DataFrame) -> DataFrame:
    """rows with the sorted names of the skills that each text names."""
    return skills.named(spread(rows).withColumn("view", text.matched(F.col("text"))), "view", skills.taxonomy(spark)).drop("view")


@query(f"WITH {_SKILLS}, {_WORDED.format(hits=_ITEM_SKILLS)}, {_bm25_sql('docs_with', 'doc_id', 'items_with', 'item_id').strip()}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM lexical) SELECT query AS item_id, doc AS doc_id, score, place FROM r WHERE place <= 10")
def bm25_with_skills(spark, sf_dir):
    """For every item its ten best documents by BM25, over texts with the names of the skills that they name."""
    docs = _named(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", skills.bm25_document(F.col("text"), F.col("slugs")).alias("text"))
    items = _named(spark, table(spark, sf_dir, "benchmark")).select("item_id", skills.bm25_query(F.col("text"), F.col("slugs")).alias("text"))
    return retrieval.top(retrieval.bm25_top(docs, items, "doc_id", "item_id", 10), 10).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "place")


@query(f"""WITH {_SKILLS}, a AS (SELECT DISTINCT slug, category FROM {_TAXONOMY}), r AS (SELECT a.slug, b.slug AS other, row_number() OVER (PARTITION BY a.slug ORDER BY b.slug) AS n FROM a JOIN a b ON a.category = b.category AND a.slug <> b.slug),
near AS (SELECT DISTINCT doc_id, other FROM skills JOIN r USING (slug) WHERE n <= {skills.RELATED})
SELECT doc_id AS doc, string_agg(other, ',' ORDER BY other) AS related FROM near WHERE (doc_id, other) NOT IN (SELECT doc_id, slug FROM skills) GROUP BY doc_id""")
def related_of_documents(spark, sf_dir):
    """The skills related to those that a document names, without these."""
    terms = skills.taxonomy(spark)
    owned = skills.extract(table(spark, sf_dir, "documents"), terms, "doc_id")
    near = owned.join(F.broadcast(skills.related(terms)), "slug").select("doc", F.explode("related").alias("slug")).distinct()
    return near.join(owned, ["doc", "slug"], "left_anti").groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("related"))


@query(f"""WITH h AS {_ITEM_SKILLS}, c AS (SELECT item_id, slug, min(category) AS c, min(role) AS r FROM h JOIN {_TAXONOMY} USING (slug) GROUP BY item_id, slug),
w AS (SELECT item_id, flatten(list([slug, c, r] ORDER BY slug)) AS every FROM c GROUP BY item_id), d AS (SELECT item_id, list_filter(every, lambda x, i: list_position(every, x) = i) AS once FROM w)
SELECT item_id, md5(CASE WHEN once IS NULL THEN text ELSE text || chr(10) || array_to_string(list_transform(once, lambda x: replace(x, '_', ' ')), ' ') END) AS digest, coalesce(len(once), 0) AS words FROM benchmark LEFT JOIN d USING (item_id)""")
def expanded_items(spark, sf_dir):
    """Items widened by the categories of the skills that they name."""
    terms = skills.taxonomy(spark)
    items = table(spark, sf_dir, "benchmark")
    of = skills.extract(items, terms, "item_id").join(F.broadcast(skills.categories(terms)), "slug")
    of = of.groupBy(F.col("doc").alias("item_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("slug", "categories"))), lambda x: x["categories"]).alias("found"))
    rows = items.join(of, "item_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<array<string>>")))
    return rows.select("item_id", F.md5(skills.expanded(F.col("text"), F.col("found"))).alias("digest"), F.size(F.array_distinct(F.flatten("found"))).cast("long").alias("words"))
