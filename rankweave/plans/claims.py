"""Claims, evidence, repositories and single-gold quality over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import numbers
from rankweave.operators import claims, profiles, retrieval, skills
from rankweave.plans.registry import query
from rankweave.plans.retrieval import _BM25, _DENSE, _TAXONOMY, _dense, _lexical, _skill_sets
from rankweave.sources.tables import kept, table

_NONE = "array<string>"


@query("""WITH p AS (SELECT p_partkey, p_size % 4 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN 0.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.7 ELSE 1.0 END::DOUBLE AS spark_level, CASE WHEN k = 3 THEN 1.0 WHEN k = 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS go_level,
  CASE k WHEN 1 THEN 'keyword' WHEN 2 THEN 'active' WHEN 3 THEN 'impact' ELSE 'ghost' END AS kind FROM p""")
def claim_levels(spark, sf_dir):
    """How well projects show the claimed skills spark and go: parts stand for profiles, their size for the kind of project."""
    k = F.col("p_size") % 4
    said = F.when(k == 0, "Wrote docs.").when(k == 1, "Team of Spark users.").when(k == 2, "We did much; optimize Spark jobs. Other").otherwise("Spark and Go, 40% faster")
    tools = F.when(k == 0, F.array(F.lit("Go"))).otherwise(F.array().cast(_NONE))
    metrics = F.when(k == 3, F.array(F.lit("40%"))).otherwise(F.array().cast(_NONE))
    projects = F.array(F.struct(said.alias("description"), tools.alias("technologies"), metrics.alias("metrics"), F.lit(10.0).alias("depth")))
    found = table(spark, sf_dir, "part").select("p_partkey", claims.claim_levels(F.array(F.lit(" Spark"), F.lit("go")), projects.cast(claims.PROJECT)).alias("l"))
    level = F.col("l")[0]["level"]
    kind = F.when(level == 0, "ghost").when(level == 0.25, "keyword").when(level == 0.7, "active").otherwise("impact")
    return found.select("p_partkey", level.alias("spark_level"), F.col("l")[1]["level"].alias("go_level"), kind.alias("kind"))


@query(f"""WITH o AS (SELECT doc_id, list_sort(list(DISTINCT slug)) AS s FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS view FROM documents) JOIN {_TAXONOMY} ON contains(view, ' ' || variant || ' ') GROUP BY doc_id),
r AS (SELECT doc_id, s, list_filter(s, lambda x: contains(' ' || lower(substr(text, 1, 300)) || ' ', ' ' || x || ' ')) AS v FROM o JOIN documents USING (doc_id))
SELECT doc_id, array_to_string(v, ',') AS verified, len(s)::INT AS records, round((len(s) - len(v))::DOUBLE / len(s), 6) AS inferred_rate, array_to_string(list_filter(['Attion', 'MENTE', 'zzz'], lambda x: NOT list_contains(s, lower(x))), ',') AS missing FROM r""")
def skill_records(spark, sf_dir):
    """Skills of a whole text that its first 300 characters (the summary's place) still name, the rate of the others, and a gap."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("view"))
    owned = skills.found(docs, "view", skills.taxonomy(spark), ["doc_id"]).groupBy("doc_id").agg(F.array_sort(F.collect_set("slug")).alias("s"))
    made = claims.skill_records(F.col("s"), F.substring("view", 1, 300))
    rows = owned.join(docs, "doc_id").select("doc_id", "s", *(c.alias(k) for k, c in made.items()))
    lost = claims.gap(F.col("s"), F.array(F.lit("Attion"), F.lit("MENTE"), F.lit("zzz")))["missing"]
    rate = F.round(claims.inferred_rate(F.col("verified"), F.col("inferred")), 6)
    return rows.select("doc_id", F.array_join("verified", ",").alias("verified"), F.size("records").alias("records"), rate.alias("inferred_rate"), F.array_join(lost, ",").alias("missing"))


_MAJORS = [(0, "infra", "attion"), (0, "infra", "inthe"), (1, "coding", "thatin"), (1, "coding", "onher"), (1, "coding", "ononst"), (2, "web", "mente"), (2, "web", "thing")]
_MAJOR_SQL = "(VALUES " + ", ".join(f"({p}, '{m}', '{k}')" for p, m, k in _MAJORS) + ") AS majors(place, major, marker)"


@query(f"""WITH o AS (SELECT DISTINCT doc_id, slug FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS view FROM documents) JOIN {_TAXONOMY} ON contains(view, ' ' || variant || ' ')),
c AS (SELECT doc_id, major, place, count(*) AS overlap FROM o JOIN {_MAJOR_SQL} ON slug = marker GROUP BY ALL) SELECT doc_id, major, overlap FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, place) = 1""")
def major_fields(spark, sf_dir):
    """The group of skills that a document meets most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("view"))
    owned = skills.found(docs, "view", skills.taxonomy(spark), ["doc_id"]).groupBy("doc_id").agg(F.collect_set("slug").alias("s"))
    return claims.major_of(owned, "doc_id", "s", spark.createDataFrame(_MAJORS, "place int, major string, marker string"))


@query(f"""WITH t AS (SELECT DISTINCT slug, category, role FROM {_TAXONOMY}), v AS (SELECT slug, count(DISTINCT variant) AS variants FROM {_TAXONOMY} GROUP BY slug)
SELECT slug, slug || ',' || category || ',' || role AS categories, variants, 'we use ' || slug || chr(10) || slug || ' ' || category || ' ' || role AS expanded FROM t JOIN v USING (slug)""")
def skill_categories(spark, sf_dir):
    """Categories and variants of each skill, and a query widened by them."""
    terms = skills.taxonomy(spark)
    by = skills.categories(terms)
    return by.select("slug", F.array_join("categories", ",").alias("categories"), F.size("variants").cast("long").alias("variants"), skills.expanded(F.concat(F.lit("we use "), "slug"), F.array("categories")).alias("expanded"))


@query(f"""SELECT item_id, array_to_string(list_transform(string_split(' ' || lower(text) || ' ', ' '), lambda w: CASE w WHEN 'atening' THEN 'attion' WHEN 'ndthe' THEN 'inthe' ELSE w END), ' ') AS protected, 'java' || chr(10) || 'c_plus c plus' AS document, 'title c_plus c plus' AS asked FROM benchmark""")
def alias_tokens(spark, sf_dir):
    """Aliases replaced by their skill's name, longest first, and the texts that BM25 is given with a row's skills."""
    done = skills.protected(F.concat(F.lit(" "), F.lower("text"), F.lit(" ")), skills.TAXONOMY)
    ids = F.array(F.lit("c_plus"))
    return table(spark, sf_dir, "benchmark").select("item_id", done.alias("protected"), skills.bm25_document(F.lit("java"), ids).alias("document"), skills.bm25_query(F.lit("title"), ids).alias("asked"))


@query(f"""WITH {_BM25}, t AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM lexical QUALIFY place <= 10),
o AS (SELECT doc_id, list_sort(list(DISTINCT slug)) AS s FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS view FROM documents) JOIN {_TAXONOMY} ON contains(view, ' ' || variant || ' ') GROUP BY doc_id),
near AS (SELECT a.slug, b.slug AS other FROM (SELECT DISTINCT slug, category FROM {_TAXONOMY}) a JOIN (SELECT DISTINCT slug, category FROM {_TAXONOMY}) b ON a.category = b.category AND a.slug <> b.slug),
x AS (SELECT query, doc, place, coalesce(s, []) AS s FROM t LEFT JOIN o ON doc_id = doc)
SELECT query, doc, place, array_to_string(s, ',') AS skills, coalesce((SELECT string_agg(DISTINCT other, ',' ORDER BY other) FROM near WHERE list_contains(s, slug) AND NOT list_contains(s, other)), '') AS related FROM x""")
def match_evidence(spark, sf_dir):
    """The evidence rows of every item's run: the ten best documents with their skills and related ones."""
    ranked = kept(retrieval.top(_lexical(spark, sf_dir, 10), 10).select("query", "doc", "place"), "ranked")
    docs = table(spark, sf_dir, "documents").join(ranked.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", F.lower("text").alias("view"))
    owned = skills.found(docs, "view", skills.taxonomy(spark), ["doc_id"]).groupBy(F.col("doc_id").alias("doc")).agg(F.array_sort(F.collect_set("slug")).alias("skills"))
    rows = ranked.join(owned, "doc", "left").withColumn("skills", F.coalesce("skills", F.array().cast(_NONE)))
    found = claims.match_evidence(rows, skills.taxonomy(spark))
    return found.select("query", "doc", "place", F.array_join("skills", ",").alias("skills"), F.array_join("related", ",").alias("related"))


@query("SELECT o_custkey AS query, o_orderkey AS doc, array_to_string(list_transform(range(1, least(o_orderkey % 14, 10) + 1), lambda i: 's' || i), ',') AS skills, 0 AS related FROM orders WHERE o_orderstatus <> 'P'")
def recommend_evidence(spark, sf_dir):
    """Evidence rows of recommendations: at most ten skills, no related ones, none without a job."""
    n = (F.col("o_orderkey") % 14).cast("int")
    own = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("s"), i.cast("string")))).otherwise(F.array().cast(_NONE))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("doc"), own.alias("skills"))
    return claims.recommend_evidence(rows).select("query", "doc", F.array_join("skills", ",").alias("skills"), F.size("related").alias("related"))


@query("""SELECT p_partkey, round(0.25 * c + 0.15 * x + 0.20 * o + 0.25 * o + 0.75, 1)::DOUBLE AS overall, c::DOUBLE AS completeness FROM (SELECT p_partkey,
  CASE WHEN s > 1000 THEN 8.0 WHEN s > 100 THEN 7.0 WHEN p_size % 2 = 0 THEN 7.5 WHEN s > 10 THEN 5.5 ELSE 3.0 END::DOUBLE AS c, CASE WHEN p_size % 3 = 0 THEN 6.5 WHEN p_size % 3 = 1 THEN 5.5 ELSE 4.0 END::DOUBLE AS x,
  CASE WHEN s > 1000 THEN 7.5 WHEN s > 100 THEN 6.5 WHEN s > 10 THEN 5.5 ELSE 4.0 END::DOUBLE AS o FROM (SELECT *, p_size * p_size AS s FROM part))""")
def repository_scores(spark, sf_dir):
    """Repositories scored from their surface; sizes stand for stars."""
    n = F.col("p_size")
    made = claims.repository_score(n * n, n % 2 == 0, F.when(n % 3 == 0, "Python").when(n % 3 == 1, "cobol").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", made["overall"].alias("overall"), made["completeness"].alias("completeness"))


_PATHS = """(SELECT l_suppkey AS repo, CASE l_partkey % 6 WHEN 0 THEN 'tests/' WHEN 1 THEN 'docs/' WHEN 2 THEN '.github/workflows/' ELSE 'src/' END || CASE WHEN l_linenumber = 7 THEN 'Dockerfile' ELSE 'f' || l_partkey || CASE WHEN l_quantity > 25 THEN '.PY' ELSE '.rs' END END AS path FROM lineitem)"""


@query(f"""SELECT repo, count(*) AS files, count(*) FILTER (contains(lower(path), 'test') OR contains(lower(path), 'spec')) AS tests, count(*) FILTER (contains(lower(path), 'readme') OR contains(lower(path), 'doc') OR contains(lower(path), '.md') OR contains(lower(path), '.rst')) AS docs,
  bool_or(contains(path, '.github/workflows')) AS has_ci, bool_or(contains(lower(path), 'dockerfile')) AS has_docker, count(DISTINCT CASE WHEN contains(path, '.') THEN lower(list_last(string_split(path, '.'))) END) AS kinds,
  round(least(10.0, 2.0 + CASE WHEN count(*) >= 5 THEN 2 ELSE 0 END + CASE WHEN count(*) FILTER (contains(lower(path), 'test') OR contains(lower(path), 'spec'))::DOUBLE / count(*) >= 0.1 THEN 2 ELSE 0 END + CASE WHEN repo % 2 = 0 THEN 1.5 ELSE 0 END
    + CASE WHEN bool_or(contains(path, '.github/workflows')) THEN 1.5 ELSE 0 END + CASE WHEN bool_or(contains(lower(path), 'dockerfile')) THEN 1 ELSE 0 END), 2)::DOUBLE AS score FROM {_PATHS} GROUP BY repo""")
def repository_surface(spark, sf_dir):
    """Files, tests, documents and the first score of repositories; suppliers' lines stand for files."""
    k = F.col("l_partkey") % 6
    folder = F.when(k == 0, "tests/").when(k == 1, "docs/").when(k == 2, ".github/workflows/").otherwise("src/")
    name = F.when(F.col("l_linenumber") == 7, "Dockerfile").otherwise(F.concat(F.lit("f"), F.col("l_partkey").cast("string"), F.when(F.col("l_quantity") > 25, ".PY").otherwise(".rs")))
    files = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat(folder, name).alias("path"))
    readmes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("repo"), F.when(F.col("s_suppkey") % 2 == 0, 500).otherwise(100).alias("length"))
    return claims.tier1(files, "l_suppkey", "path", readmes).select("repo", "files", "tests", "docs", "has_ci", "has_docker", "kinds", "score")


@query("""SELECT c_custkey, 'shop-' || c_custkey AS repo, CASE c_custkey % 4 WHEN 0 THEN 'Shop ' || c_custkey || '!' WHEN 1 THEN 'My Shop for ' || c_custkey ELSE 'Other' END AS project, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rule FROM customer WHERE c_custkey % 4 < 3 AND (c_custkey % 4 <> 1 OR c_custkey >= 100)""")
def repository_projects(spark, sf_dir):
    """Repositories and the projects of a profile that they belong to, by the first rule that matches."""
    k, n = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    people = table(spark, sf_dir, "customer")
    repos = people.select("c_custkey", F.concat(F.lit("shop-"), n).alias("repo"), F.when(k == 2, "online payments gateway service").otherwise("short").alias("description"))
    title = F.when(k == 0, F.concat(F.lit("Shop "), n, F.lit("!"))).when(k == 1, F.concat(F.lit("My Shop for "), n)).otherwise("Other")
    projects = people.select("c_custkey", F.lit(1).alias("place"), title.alias("title"), F.when(k == 2, "A gateway with payments as a service").otherwise("nothing").alias("description"))
    return claims.matched_repositories(repos, projects, "c_custkey")


@query(f"""WITH {_DENSE}, t AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY distance, doc) AS place FROM dense QUALIFY place <= 30),
g AS (SELECT query, place AS rank FROM t WHERE doc % 7 = query % 7 QUALIFY row_number() OVER (PARTITION BY query ORDER BY doc) = 1)
SELECT query, rank, (rank <= 5)::INT::DOUBLE AS p5, CASE WHEN rank <= 5 THEN round(1 / log2(rank + 1), 6) ELSE 0.0 END::DOUBLE AS ndcg5, CASE WHEN rank <= 5 THEN round(1.0::DOUBLE / rank, 6) ELSE 0.0 END::DOUBLE AS cp5 FROM g""")
def gold_rank(spark, sf_dir):
    """The rank of each query's one gold vector and what it gives: the first of its residue by id stands for gold."""
    ranked = retrieval.top(_dense(spark, sf_dir, 30), 30, score="distance", descending=False).select("query", "doc", "place")
    gold = ranked.where(F.col("doc") % 7 == F.col("query") % 7).groupBy("query").agg(F.min("doc").alias("doc"))
    return claims.gold_metrics(ranked, gold, [5]).select("query", "rank", "p5", F.round("ndcg5", 6).alias("ndcg5"), F.round("cp5", 6).alias("cp5"))


@query("SELECT o_orderkey, (o_orderkey % 50)::INT AS r, left(o_orderpriority || repeat('x', 300), 200) AS text FROM orders ORDER BY r DESC, o_orderkey LIMIT 20")
def worst_queries(spark, sf_dir):
    """The twenty worst-ranked queries of a report, orders in their place."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 50).cast("int").alias("r"), F.concat("o_orderpriority", F.repeat(F.lit("x"), F.lit(300))).alias("text"))
    return claims.worst(rows, "r", "o_orderkey", "text")


@query("""SELECT count(*) FILTER (c_custkey % 5 < 3) AS top3, count(*) AS n, round(10.0::DOUBLE / count(*), 6) AS random_recall, count(DISTINCT c_mktsegment) AS places, round(coalesce(avg(c_acctbal / 10000) * 100, 70), 4) AS culture FROM customer""")
def calibration(spark, sf_dir):
    """Own items among the first three, the recall at ten of a random order, distinct places and the mean similarity of references."""
    rows = table(spark, sf_dir, "customer")
    n = F.count("*")
    return rows.agg(F.count_if(F.col("c_custkey") % 5 < 3).alias("top3"), n.alias("n"), F.round(10.0 / n, 6).alias("random_recall"), F.countDistinct("c_mktsegment").alias("places"), F.round(F.coalesce(F.avg(F.col("c_acctbal") / 10000) * 100, F.lit(70.0)), 4).alias("culture"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE round(greatest(p_size % 5 - p_size % 3, 0)::DOUBLE / (p_size % 5), 3) END AS precision, CASE WHEN greatest(p_size % 5 - p_size % 3, 0) + p_size % 2 = 0 THEN NULL ELSE round(greatest(p_size % 5 - p_size % 3, 0)::DOUBLE / (greatest(p_size % 5 - p_size % 3, 0) + p_size % 2), 3) END AS recall,
  CASE WHEN p_size % 5 > 0 OR (p_size % 2 = 1 AND p_size >= 20) THEN 'standard' ELSE 'insufficient' END AS quality, p_size % 4 = 2 AS progressed, CASE WHEN p_size % 2 = 0 THEN 'degrade' ELSE 'pass' END AS evidence, round((0.9 + 0.5 + CASE WHEN p_size % 2 = 0 THEN 0.3 ELSE 0 END)::DOUBLE / CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END, 2) AS confidence,
  round(greatest((p_size * 0.613::DOUBLE + 40 * 0.387::DOUBLE) * CASE WHEN p_size % 3 > 0 THEN 1 - p_size % 3 / 4.3::DOUBLE ELSE 1 END, 0), 1) AS overall FROM part""")
def profile_quality(spark, sf_dir):
    """Judged skills, validity, progression, evidence, confidence and the overall score of a profile, parts in their place."""
    n = F.col("p_size")
    many = lambda k: F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda i: i.cast("string"))).otherwise(F.array().cast(_NONE))
    found = claims.judged(many(n % 5), many(n % 3), many(n % 2))
    titles = F.when(n % 4 == 0, F.array(F.lit("Lead Engineer"), F.lit("Junior"))).when(n % 4 == 2, F.array(F.lit("Junior dev"), F.lit("clerk"), F.lit("Senior dev"))).otherwise(F.array(F.lit("Senior")))
    valid = claims.quality(many(n % 5), many(n % 2), F.repeat(F.lit("12345"), n))
    total = claims.overall({"a": (n.cast("double"), 0.613), "b": (F.lit(40.0), 0.387)}, (n % 3) / 4.3)
    return table(spark, sf_dir, "part").select(
        "p_partkey", found["precision"].alias("precision"), found["recall"].alias("recall"), valid.alias("quality"), claims.progressed(titles, F.lit(2.0)).alias("progressed"),
        claims.enough_evidence(F.array(F.lit(" "), F.when(n % 2 == 1, "x"))).alias("evidence"), claims.confidence([F.lit(0.9), F.lit(0.5)], [n % 2 == 0]).alias("confidence"), total.alias("overall"),
    )


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_partkey % 20 = 0) AS bad, count(DISTINCT l_partkey) AS ids FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN bad > 0 OR ids < n THEN 'block' WHEN n > 4 THEN 'degrade' ELSE 'pass' END AS action, CASE WHEN bad > 0 OR ids < n THEN 'DATA_SCOPE_MISMATCH' WHEN n > 4 THEN 'DATA_BUDGET_EXCEEDED' END AS code, CASE WHEN bad > 0 OR ids < n THEN 0 ELSE least(n, 4) END::BIGINT AS n FROM g""")
def gated_records(spark, sf_dir):
    """Lists whose ids must be allowed, different and few: orders' lines."""
    allowed = table(spark, sf_dir, "part").where("p_partkey % 20 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    return claims.gated_records(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", allowed, 4)


@query("""SELECT count(*) FILTER (len(embedding) <> 64 OR vec_id % 10 = 0) AS mismatched, count(*) FILTER (label % 2 = 0 AND NOT (len(embedding) <> 64 OR vec_id % 10 = 0)) AS verified, round(max(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS norm FROM embeddings""")
def vector_inputs(spark, sf_dir):
    """How many rows have another model's or length's vector, how many comparable ones are verified, and the longest norm."""
    rows = table(spark, sf_dir, "embeddings").withColumn("model", F.when(F.col("vec_id") % 10 == 0, "old").otherwise("new"))
    bad = claims.dense_input_problems(F.col("embedding"), F.col("model"), "new", 64)
    return rows.agg(F.count_if(bad).alias("mismatched"), F.count_if(~bad & (F.col("label") % 2 == 0)).alias("verified"), F.round(F.max(numbers.norm(F.col("embedding"))), 4).alias("norm"))


@query("""SELECT o_orderkey, CASE WHEN k = 0 THEN 'docker' WHEN k = 1 THEN 'docker,java' ELSE '' END AS foundation, CASE WHEN k = 0 THEN 'kubernetes,go,sql' WHEN k = 1 THEN 'kubernetes,spark' ELSE '' END AS core, CASE WHEN k = 0 THEN 'ml' ELSE '' END AS later FROM (SELECT o_orderkey, o_orderkey % 3 AS k FROM orders)""")
def roadmap(spark, sf_dir):
    """What to learn first, next and later, by what a skill needs."""
    k = F.col("o_orderkey") % 3
    names = lambda *xs: F.array(*(F.lit(x) for x in xs))
    missing = F.when(k == 0, names("kubernetes", "go", "sql", "ml")).when(k == 1, names("kubernetes", "spark")).otherwise(F.array().cast(_NONE))
    needs = F.create_map(F.lit("kubernetes"), names("docker"), F.lit("spark"), names("java", "docker"))
    made = profiles.roadmap(missing, needs)
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("r")).select("o_orderkey", *(F.array_join(F.col(f"r.{c}"), ",").alias(c) for c in ("foundation", "core", "later")))


@query("""SELECT c_custkey, c_mktsegment = 'BUILDING' AND c_nationkey % 4 = 1 AND contains(lower(c_name), '1') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS shown, CASE WHEN c_acctbal > 5000 THEN 'public' WHEN c_acctbal > 0 THEN 'verified' ELSE 'other' END AS bucket FROM customer""")
def listed_rows(spark, sf_dir):
    """The filters of a list on its reader's side: words, kind, place and saved ones; and the bucket of each row."""
    saved = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("saved", F.lit(True))
    rows = table(spark, sf_dir, "customer").join(saved, "c_custkey", "left")
    found = profiles.listed("1", [F.col("c_name")], {"c_mktsegment": ["BUILDING"]}, F.col("c_nationkey") % 4 == 1, F.col("saved"))
    bucket = F.when(F.col("c_acctbal") > 5000, "public").when(F.col("c_acctbal") > 0, "verified").otherwise("other")
    return rows.select("c_custkey", found.alias("shown"), bucket.alias("bucket"))
