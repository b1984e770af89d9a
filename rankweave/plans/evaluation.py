"""Ranking quality over the dense neighbours, percentiles and grouped reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import numbers
from rankweave.operators import evaluation, retrieval
from rankweave.plans.registry import query
from rankweave.plans.retrieval import _DENSE, _dense
from rankweave.sources.tables import table

_GRADED = f"""WITH {_DENSE},
ranked AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY distance, doc) AS place FROM dense QUALIFY place <= 20),
grades AS (SELECT q.vec_id AS query, d.vec_id AS doc, CASE WHEN q.label = d.label THEN CASE WHEN d.vec_id % 3 = 0 THEN 2 ELSE 1 END ELSE 0 END AS grade FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0 AND q.label = d.label),
rows AS (SELECT ranked.*, coalesce(grade, 0) AS grade FROM ranked LEFT JOIN grades USING (query, doc)),
got AS (SELECT query, count(*) FILTER (place <= 5) AS n5, count(*) FILTER (place <= 5 AND grade >= 1) AS h5, sum(CASE WHEN place <= 5 THEN (2.0 ** grade - 1) / log2(place + 1) ELSE 0 END) AS d5,
  count(*) FILTER (place <= 10) AS n10, count(*) FILTER (place <= 10 AND grade >= 1) AS h10, sum(CASE WHEN place <= 10 THEN (2.0 ** grade - 1) / log2(place + 1) ELSE 0 END) AS d10, min(place) FILTER (grade >= 2) AS first FROM rows GROUP BY query),
best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS b FROM grades),
ideal AS (SELECT query, count(*) FILTER (grade >= 1) AS n, sum(CASE WHEN b <= 5 THEN (2.0 ** grade - 1) / log2(b + 1) ELSE 0 END) AS i5, sum(CASE WHEN b <= 10 THEN (2.0 ** grade - 1) / log2(b + 1) ELSE 0 END) AS i10 FROM best GROUP BY query),
metrics AS (SELECT query, h5::DOUBLE / n5 AS p5, h5::DOUBLE / n AS r5, d5 / i5 AS ndcg5, h10::DOUBLE / n10 AS p10, h10::DOUBLE / n AS r10, d10 / i10 AS ndcg10, coalesce(1.0::DOUBLE / first, 0) AS mrr FROM got JOIN ideal USING (query))"""
_NAMES = ["p5", "r5", "ndcg5", "p10", "r10", "ndcg10", "mrr"]


def _metrics(spark, sf_dir):
    """Relevance: vectors of the query's label, of grade 2 where the id is divisible by 3."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 100 = 0")
    near = retrieval.dense_top(v, asked, "vec_id", "vec_id", 20)
    grades = v.join(asked.select(F.col("vec_id").alias("query"), "label"), "label").where("vec_id <> query")
    grades = grades.select("query", F.col("vec_id").alias("doc"), F.when(F.col("vec_id") % 3 == 0, 2).otherwise(1).alias("grade"))
    return evaluation.ranking_metrics(retrieval.top(near, 20, score="distance", descending=False).select("query", "doc", "place"), grades, [5, 10])


@query(_GRADED + " SELECT query, " + ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in _NAMES) + " FROM metrics")
def ranking_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query", *(F.round(c, 6).alias(c) for c in _NAMES))


@query(_GRADED + " SELECT " + ", ".join(f"round(avg({c}), 6)::DOUBLE AS {c}" for c in _NAMES) + " FROM metrics")
def macro_average(spark, sf_dir):
    return evaluation.macro(_metrics(spark, sf_dir)).select(*(F.round(c, 6).alias(c) for c in _NAMES))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY event_type")
def percentile_nearest_rank(spark, sf_dir):
    return evaluation.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", [50, 90])


@query("""SELECT coalesce(role, 'overall') AS type, grouping(role)::INT AS total, count(*) AS n, round(avg((turn <= 1)::INT), 6)::DOUBLE AS recall, round(avg(CASE WHEN turn <= 3 THEN 1.0 / (turn + 1) ELSE 0 END), 6)::DOUBLE AS context_precision FROM conversations GROUP BY GROUPING SETS ((), (role))""")
def recall_grouping_sets(spark, sf_dir):
    """Means over all rows and by type in one pass."""
    rows = table(spark, sf_dir, "conversations")
    grouped = rows.groupingSets([[], [F.col("role")]], F.col("role")).agg(
        F.grouping("role").cast("int").alias("total"), F.count("*").alias("n"), F.round(F.avg((F.col("turn") <= 1).cast("int")), 6).alias("recall"),
        F.round(F.avg(F.when(F.col("turn") <= 3, 1.0 / (F.col("turn") + 1)).otherwise(0.0)), 6).alias("context_precision"),
    )
    return grouped.select(F.coalesce("role", F.lit("overall")).alias("type"), "total", "n", "recall", "context_precision")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd, min(value) AS lo, max(value) AS hi, round(sum(value), 4) AS total, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY event_type")
def sample_statistics(spark, sf_dir):
    """Latency-style statistics of each group and its share of the total."""
    s = evaluation.sample_statistics(table(spark, sf_dir, "events"), "event_type", "value")
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("sd", 6).alias("sd"), "lo", "hi", F.round("total", 4).alias("total"), F.round("share", 6).alias("share"))


@query("SELECT a.vec_id AS cv, count(*) AS own, sum((b.vec_id % 3 = 0)::INT)::BIGINT AS grade2 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE b.vec_id % 100 = 0 GROUP BY 1")
def qrels_transpose(spark, sf_dir):
    """Relevance judgements keyed by document instead of query."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label")
    return v.join(asked, "label").where("vec_id <> query").groupBy(F.col("vec_id").alias("cv")).agg(F.count("*").alias("own"), F.sum((F.col("query") % 3 == 0).cast("int")).alias("grade2"))


@query("SELECT source, count(*) AS docs, count(*) FILTER (quality = 1) AS good, round(avg(quality), 6)::DOUBLE AS precision, count(*) FILTER (quality IS NULL) AS unjudged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def judged_precision(spark, sf_dir):
    """The share of judged rows that are good, by source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("quality") == 1).alias("good"), F.round(F.avg("quality"), 6).alias("precision"), F.count_if(F.col("quality").isNull()).alias("unjudged"))


@query("""SELECT c_custkey, round(0.35 * ev + 0.30 * ex + 0.20 * 70 + 0.15 * 75, 2)::DOUBLE AS overall, CASE WHEN ev >= 90 THEN 95.0 WHEN ev >= 80 THEN 85.0 WHEN ev >= 70 THEN 70.0 WHEN ev >= 60 THEN 50.0 WHEN ev >= 50 THEN 30.0 ELSE 15.0 END::DOUBLE AS percentile FROM (SELECT c_custkey, (c_custkey % 101)::DOUBLE AS ev, ((c_custkey * 7) % 101)::DOUBLE AS ex FROM customer)""")
def overall_score(spark, sf_dir):
    """Weighted evaluation score and percentile band."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 101).cast("double").alias("ev"), (F.col("c_custkey") * 7 % 101).cast("double").alias("ex"))
    overall = F.col("ev") * 0.35 + F.col("ex") * 0.30 + 0.20 * 70 + 0.15 * 75
    return rows.select("c_custkey", F.round(overall, 2).alias("overall"), numbers.steps(F.col("ev"), numbers.PERCENTILES, 15.0).alias("percentile"))


@query("""WITH s AS (SELECT c_custkey, 10 AS skills, c_custkey % 9 AS ghosts, c_custkey % 8 AS claimed, (c_custkey % 50) / 10.0::DOUBLE AS shown, c_custkey % 4 AS projects, 2026 - c_custkey % 12 AS graduated, CASE WHEN c_custkey % 17 = 0 THEN 2 ELSE 0 END AS ana, (c_custkey % 101)::DOUBLE AS depth, c_custkey % 3 AS boasts FROM customer),
f AS (SELECT *, claimed > greatest(2026 - graduated, 0) + 2 AS conflict, (projects = 0 OR (claimed >= 5 AND shown < 1) OR (claimed >= 3 AND shown * 2.5 < claimed))::INT + CASE WHEN shown < 3 THEN boasts ELSE 0 END AS time_flags FROM s),
p AS (SELECT *, ghosts / 10.0::DOUBLE AS g, CASE WHEN claimed >= 3 THEN greatest((claimed - shown)::DOUBLE / claimed, 0) ELSE 0 END AS d, claimed >= 5 AND depth < 40 AS hollow FROM f),
t AS (SELECT *, greatest(0.05, least(1.0, round(1.0::DOUBLE - CASE WHEN conflict THEN 0.25 ELSE 0 END - CASE WHEN g > 0.5 THEN g * 0.35 WHEN g > 0.3 THEN g * 0.15 ELSE 0 END - CASE WHEN d > 0.6 THEN 0.35 WHEN d > 0.3 THEN 0.15 ELSE 0 END - least(ana, 3) * 0.25 - CASE WHEN hollow THEN 0.25 ELSE 0 END, 2))) AS score, time_flags + ana + conflict::INT + (g > 0.5)::INT + hollow::INT AS flags FROM p)
SELECT c_custkey, score AS trust_score, CASE WHEN score < 0.45 OR flags >= 2 OR ana > 0 THEN 'HIGH_INFLATION_RISK' WHEN score < 0.75 OR flags >= 1 THEN 'QUESTIONABLE' ELSE 'VERIFIED' END AS trust_status FROM t""")
def trust_score(spark, sf_dir):
    """Credibility of claims from ghost skills, the years' timeline, anachronisms and depth."""
    k = F.col("c_custkey")
    shown = (k % 50) / 10.0
    flags = numbers.timeline_flags(k % 8, shown, k % 4, 2026 - k % 12, F.lit(2026), k % 3)
    made = numbers.trust(F.lit(10), k % 9, k % 8, shown, F.when(k % 17 == 0, 2).otherwise(0), (k % 101).cast("double"), flags["conflict"], flags["evidence"].cast("int") + flags["boasts"])
    return table(spark, sf_dir, "customer").select("c_custkey", made["trust_score"].alias("trust_score"), made["trust_status"].alias("trust_status"))


@query("""WITH tech AS (SELECT * FROM (VALUES ('docker', 2013), ('kubernetes', 2014), ('fastapi', 2018), ('flutter', 2017), ('spark', 2014)) AS t(skill, released)),
claims AS (SELECT p_partkey, p_size AS claimed, ['docker', 'kubernetes', 'fastapi', 'flutter', 'spark'][1 + p_partkey % 5] AS skill FROM part)
SELECT p_partkey, skill, claimed, 2026 - released + 1 AS possible FROM claims JOIN tech USING (skill) WHERE claimed > 2026 - released + 1""")
def anachronisms(spark, sf_dir):
    """Claims of more years than a technology has existed, as of 2026."""
    tech = spark.createDataFrame([("docker", 2013), ("kubernetes", 2014), ("fastapi", 2018), ("flutter", 2017), ("spark", 2014)], "skill string, released int")
    skill = F.element_at(F.array(*(F.lit(x) for x in ("docker", "kubernetes", "fastapi", "flutter", "spark"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    claims = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("claimed"), skill.alias("skill"))
    return claims.join(F.broadcast(tech), "skill").select("p_partkey", "skill", "claimed", (2026 - F.col("released") + 1).alias("possible")).where("claimed > possible")


@query("""SELECT l_suppkey AS repo, count(*) AS files, count(*) FILTER (l_returnflag = 'R') AS tests, count(*) FILTER (l_returnflag = 'A') AS docs, round(count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*), 6) AS test_ratio, count(DISTINCT l_shipdate) AS kinds, bool_or(l_quantity >= 50) AS large FROM lineitem GROUP BY 1""")
def repo_tier1(spark, sf_dir):
    """File counts and ratios of a repository, with lines in the place of files."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("repo")).agg(
        F.count("*").alias("files"), F.count_if(flag == "R").alias("tests"), F.count_if(flag == "A").alias("docs"), F.round(F.count_if(flag == "R") / F.count("*"), 6).alias("test_ratio"),
        F.countDistinct("l_shipdate").alias("kinds"), F.bool_or(F.col("l_quantity") >= 50).alias("large"),
    )


@query(f"""WITH {_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, doc) AS place FROM dense QUALIFY place <= 20),
own AS (SELECT q.vec_id AS query, d.vec_id AS doc FROM embeddings q JOIN embeddings d ON d.label = q.label AND d.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
c AS (SELECT query, list(round(1 - distance, 6)) AS s FROM r JOIN own USING (query, doc) GROUP BY query)
SELECT query, own.doc, place::INT AS place, coalesce(place <= 3, false) AS hit, round(CASE WHEN s IS NULL THEN 70 ELSE list_avg(s) * 100 END, 3)::DOUBLE AS culture FROM own LEFT JOIN r USING (query, doc) LEFT JOIN c USING (query)""")
def own_calibration(spark, sf_dir):
    """Where the vectors of a query's own label stand among its twenty nearest, and what the similarities of those that do say of its fit."""
    ranked = retrieval.top(_dense(spark, sf_dir, 20), 20, score="distance", descending=False)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asks = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label")
    own = asks.join(vectors.withColumnRenamed("vec_id", "doc"), "label").where("doc <> query").select("query", "doc")
    near = ranked.join(own, ["query", "doc"]).groupBy("query").agg(F.collect_list(F.round(1 - F.col("distance"), 6)).alias("s"))
    none = F.array().cast("array<double>")
    rows = evaluation.own_ranks(ranked, own, 3).join(near, "query", "left")
    return rows.select("query", "doc", F.col("place").cast("int").alias("place"), "hit", F.round(evaluation.culture_fit(F.coalesce("s", none)), 3).alias("culture"))
