"""Relational reports: rollups, latest rows, picks, intervals, probes, fan-out and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import wording
from rankweave.operators import profiles, relational
from rankweave.plans.registry import query
from rankweave.sources import tables
from rankweave.sources.tables import table


@query("""SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS jobs,
  (SELECT CASE WHEN count(*) FILTER (c_mktsegment = 'BUILDING') > 0 THEN count(*) FILTER (c_mktsegment = 'BUILDING') ELSE count(*) FILTER (c_mktsegment IS DISTINCT FROM 'MACHINERY') END FROM customer) AS candidates,
  (SELECT CASE WHEN count(*) FILTER (s_acctbal > 0) > 0 THEN count(*) FILTER (s_acctbal > 0) ELSE count(*) END FROM supplier) AS companies,
  (SELECT CASE WHEN count(*) = 0 THEN 0 ELSE round(100.0 * count(*) FILTER (o_orderstatus IN ('F', 'P')) / count(*)) END FROM orders)::BIGINT AS success_rate""")
def landing_stats(spark, sf_dir):
    """Filtered counts with fallbacks and a success rate, each table read once."""
    orders = table(spark, sf_dir, "orders").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("jobs"), F.count("*").alias("n"), F.count_if(F.col("o_orderstatus").isin("F", "P")).alias("good"),
    )
    people = table(spark, sf_dir, "customer").agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("a"), F.count_if(~F.col("c_mktsegment").eqNullSafe("MACHINERY")).alias("b"))
    firms = table(spark, sf_dir, "supplier").agg(F.count_if(F.col("s_acctbal") > 0).alias("c"), F.count("*").alias("d"))
    one = orders.crossJoin(people).crossJoin(firms)
    rate = F.when(F.col("n") == 0, 0).otherwise(F.round(100.0 * F.col("good") / F.col("n")))
    return one.select("jobs", F.when(F.col("a") > 0, F.col("a")).otherwise(F.col("b")).alias("candidates"), F.when(F.col("c") > 0, F.col("c")).otherwise(F.col("d")).alias("companies"), rate.cast("long").alias("success_rate"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'O') DESC, o_orderdate DESC, o_orderkey) = 1")
def latest_per_key(spark, sf_dir):
    """A customer's open order if there is one, else the latest."""
    rows = relational.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], (F.col("o_orderstatus") == "O").desc(), F.desc("o_orderdate"), F.col("o_orderkey"))
    return rows.select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT conv_id, count(*) AS messages, arg_min(text, turn) FILTER (role = 'user') AS title, arg_max(role, turn) AS last_role, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def session_rollup(spark, sf_dir):
    """A row a session: its first user message, its last speaker, its length."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("title"), F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"),
    )


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def page_offset(spark, sf_dir):
    """The third page of 20 events, newest first."""
    return relational.page(table(spark, sf_dir, "events"), 40, 20, F.desc("ts"), F.col("event_id")).select("event_id", "user_id", "event_type")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM events GROUP BY event_type")
def counts_by_status(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("event_type", "n", "high", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


@query("""WITH iv AS (SELECT o_custkey, o_orderdate AS s, o_orderdate + to_days((o_orderkey % 90)::INT) AS e FROM orders),
m AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w THEN 1 ELSE 0 END AS fresh FROM iv WINDOW w AS (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
i AS (SELECT o_custkey, island, min(s) AS s, max(e) AS e FROM g GROUP BY ALL)
SELECT o_custkey, count(*) AS islands, sum((year(e) - year(s)) * 12 + month(e) - month(s))::BIGINT AS months FROM i GROUP BY o_custkey""")
def interval_merge(spark, sf_dir):
    """Months that each customer's overlapping intervals cover."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 90).cast("int"))).alias("e"))
    merged = relational.merged_intervals(rows, "o_custkey", "s", "e")
    return merged.groupBy("o_custkey").agg(F.count("*").alias("islands"), F.sum(relational.months_between(F.col("s"), F.col("e"))).alias("months"))


@query("""WITH s AS (SELECT user_id, event_id, ts AS a, ts + to_minutes((event_id % 60)::BIGINT) AS b FROM events), n AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY a, b) AS nxt FROM s)
SELECT CASE WHEN epoch_us(b) - epoch_us(a) < 900000000 THEN 'short' WHEN nxt IS NULL THEN 'ok' WHEN nxt < b THEN 'overlap' WHEN epoch_us(nxt) - epoch_us(b) < 14400000000 THEN 'gap' ELSE 'ok' END AS problem, count(*) AS n FROM n GROUP BY 1""")
def slot_gap_check(spark, sf_dir):
    """How many proposed slots are short, overlap the next or leave less than four hours."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("a"), (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 60).cast("int"))).alias("b"))
    return relational.slot_problems(rows, "user_id", "a", "b", 4, 15).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 3")
def quota_pick(spark, sf_dir):
    return relational.top_per_group(table(spark, sf_dir, "part"), ["p_brand"], 3, F.desc("p_retailprice"), F.col("p_partkey")).select("p_brand", "p_partkey", "place")


@query("""WITH d AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_retailprice, p_partkey) = 1)
SELECT p_type, p_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS place FROM d) WHERE place <= 5""")
def diversity_cap(spark, sf_dir):
    """Distinct names, at most five a type."""
    return relational.distinct_capped(table(spark, sf_dir, "part"), "p_name", "p_type", 5, F.col("p_retailprice"), F.col("p_partkey")).select("p_type", "p_partkey", "place")


@query("SELECT n_regionkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY (c_mktsegment = 'BUILDING') DESC, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'FURNITURE' THEN 1 ELSE 2 END, c_acctbal DESC, c_custkey) <= 2")
def ladder_pick(spark, sf_dir):
    """Two customers a region by a ladder of preferences."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    ladder = F.when(F.col("c_mktsegment") == "AUTOMOBILE", 0).when(F.col("c_mktsegment") == "FURNITURE", 1).otherwise(2)
    return relational.top_per_group(rows, ["n_regionkey"], 2, (F.col("c_mktsegment") == "BUILDING").desc(), ladder, F.desc("c_acctbal"), F.col("c_custkey")).select("n_regionkey", "c_custkey")


@query("""WITH c AS (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n_name, n, (1 + (row_number() OVER (ORDER BY n DESC, n_name) <= 40 - count(*) OVER ())::INT)::BIGINT AS seats FROM c""")
def seat_apportionment(spark, sf_dir):
    named = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return relational.apportioned(named.groupBy("n_name").agg(F.count("*").alias("n")), "n_name", "n", 40)


@query("SELECT c_nationkey, ((1000 // count(*) OVER ()) + (row_number() OVER (ORDER BY c_nationkey) <= 1000 % count(*) OVER ())::INT)::BIGINT AS quota FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey IS NOT NULL)")
def quota_split(spark, sf_dir):
    """A thousand queries dealt evenly over the nations."""
    return relational.shared_out(table(spark, sf_dir, "customer"), "c_nationkey", 1000)


@query()
def diverse_sample(spark, sf_dir):
    """Four parts of each brand, of different types first; the seeded order is a hash that SQL doesn't have."""
    return relational.diverse_sample(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_partkey", 4, 42).select("p_brand", "p_partkey", "p_type", "place")


@query("SELECT c_custkey, coalesce(list_position([30, 7, 19, 3], c_custkey) - 1, 999)::INT AS place FROM customer WHERE c_custkey < 40")
def requested_order(spark, sf_dir):
    """Rows by the order in which their keys were asked for."""
    wanted = spark.createDataFrame([([30, 7, 19, 3],)], "keys array<bigint>")
    return relational.requested_order(table(spark, sf_dir, "customer").where("c_custkey < 40"), "c_custkey", wanted).select("c_custkey", "place")


@query("""SELECT c_custkey, c_name, n_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def semi_anti_probe(spark, sf_dir):
    """Customers without a finished order, with their nation's name and whether an order is pending."""
    people, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    free = people.join(orders.where("o_orderstatus = 'F'"), "c_custkey", "left_anti")
    pending = orders.where("o_orderstatus = 'P'").select("c_custkey").distinct().withColumn("pending", F.lit(True))
    named = free.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(pending, "c_custkey", "left")
    return named.select("c_custkey", "c_name", "n_name", F.coalesce("pending", F.lit(False)).alias("pending"))


@query("SELECT c_custkey AS id, 'applicant' AS origin FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'public' FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def union_dedup(spark, sf_dir):
    """Applicants, and public profiles that aren't applicants."""
    people, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    applied = people.join(orders, "c_custkey", "left_semi").select(F.col("c_custkey").alias("id"), F.lit("applicant").alias("origin"))
    public = people.where("c_acctbal > 0").join(orders, "c_custkey", "left_anti").select(F.col("c_custkey").alias("id"), F.lit("public").alias("origin"))
    return applied.unionByName(public)


@query("SELECT o_orderkey, s_suppkey, 'order_' || lower(o_orderstatus) || ':' || o_orderkey || ':' || s_suppkey AS idempotency_key FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_nationkey = c_nationkey WHERE o_orderstatus = 'P'")
def notification_fanout(spark, sf_dir):
    """A notice for each supplier of the customer's nation on every pending order."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    head = F.concat(F.lit("order_"), F.lower("o_orderstatus"), F.lit(":"), F.col("o_orderkey").cast("string"), F.lit(":"))  # written once an order, not once a pair
    placed = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", head.alias("head"), F.col("c_nationkey").alias("nation"))
    firms = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.col("s_suppkey").cast("string").alias("tail"))
    met = relational.fanned_out(placed, firms, "nation", "o_orderkey")
    return met.select("o_orderkey", "s_suppkey", F.concat("head", "tail").alias("idempotency_key"))


@query("SELECT l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::INT AS place, l_partkey AS part FROM lineitem")
def evidence_rows(spark, sf_dir):
    """The child rows of runs whose evidence is an array."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"))
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.array_sort(F.collect_list(line)).alias("evidence"))
    return tables.run_with_evidence(runs, "run", "evidence")[1].select("run", "place", "part")


#: The weights of a run's score by property.
WEIGHTS = {"k": 0.20, "depth": 0.25, "quality": 0.15, "clean": 0.20, "fit": 0.20}


@query("SELECT event_id, round(0.20 * k + 0.25 * k * 2 + 0.20 * 7, 6)::DOUBLE AS weighted_score FROM (SELECT event_id, coalesce((props->>'$.k')::DOUBLE, 0) AS k FROM events)")
def weighted_score(spark, sf_dir):
    """A generated column: the weighted sum of JSON properties, 0 for one that is missing or no number; three of five are given here."""
    k = F.get_json_object("props", "$.k")
    body = F.to_json(F.struct(k.cast("double").alias("k"), (k.cast("double") * 2).alias("depth"), F.lit("none").alias("quality"), F.lit("7").alias("fit")))
    number = lambda name: F.coalesce(F.get_json_object("body", f"$.{name}").try_cast("double"), F.lit(0.0))
    total = sum((number(name) * w for name, w in WEIGHTS.items()), F.lit(0.0))
    return table(spark, sf_dir, "events").withColumn("body", body).select("event_id", F.round(total, 6).alias("weighted_score"))


@query("SELECT p_partkey, other, place FROM (SELECT a.p_partkey, b.p_partkey AS other, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS place FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND (a.p_brand = b.p_brand OR a.p_type = b.p_type OR a.p_size = b.p_size)) WHERE place <= 3")
def similar_items(spark, sf_dir):
    """For each part the first three that share its brand, type or size."""
    return relational.similar(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type", "p_size"], 3).select("p_partkey", "other", "place")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, 'CAND_' || lpad(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::VARCHAR, 3, '0') AS alias FROM orders)
SELECT o_custkey, o_orderkey, alias, 'candidate #' || ltrim(substr(alias, 6), '0') || ' fits' AS reason FROM a""")
def anonymized(spark, sf_dir):
    """Every list's rows by running alias instead of key, and the keys restored to what was said about the aliases."""
    hidden, names = profiles.anonymized(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], F.desc("o_totalprice"), F.col("o_orderkey"))
    said = hidden.select("o_custkey", "alias", F.concat("alias", F.lit(" fits")).alias("reason"))
    return profiles.restored(said, names, ["o_custkey"]).select("o_custkey", "o_orderkey", "alias", profiles.readable(F.col("reason")).alias("reason"))


@query("""WITH j AS (SELECT c_custkey, n_name, r_name, sum(o_totalprice) AS total, count(o_orderkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY ALL) SELECT c_custkey, n_name, r_name, round(coalesce(total, 0), 2) AS total, n FROM j""")
def run_report(spark, sf_dir):
    """Inner and left joins: each customer with nation, region and the sum of open orders, orders summed before the join."""
    open_orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).join(open_orders, "c_custkey", "left")
    return joined.select("c_custkey", "n_name", "r_name", F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS deadline FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL 7 DAY FROM orders WHERE o_orderstatus = 'O'")
def deadlines(spark, sf_dir):
    """A response deadline by status: its own interval where given, else three days."""
    own = F.when(F.col("o_orderstatus") == "O", F.expr("INTERVAL 7 DAYS"))
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("P", "O"))
    return rows.select("o_orderkey", (F.col("o_orderdate") + F.coalesce(own, F.expr("INTERVAL 3 DAYS"))).alias("deadline"))


@query("""WITH new AS (SELECT o_orderkey AS id, 'new' AS version FROM orders WHERE o_orderkey % 3 = 0), old AS (SELECT o_orderkey AS id, 'old' AS version FROM orders WHERE o_orderstatus = 'F') SELECT id, version FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, version FROM new""")
def upsert(spark, sf_dir):
    """A merge: old rows replaced by new ones of the same key."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    return tables.upserted(orders.where("o_orderstatus = 'F'").select("id", F.lit("old").alias("version")), orders.where("id % 3 = 0").select("id", F.lit("new").alias("version")), ["id"])


_FILES = """files AS (SELECT l_orderkey AS repo, CASE l_partkey % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'data/' ELSE '' END || l_partkey || '-' || l_linenumber || CASE l_partkey % 3 WHEN 0 THEN '.py' ELSE '.bin' END AS path, repeat('x', l_quantity::INT) AS content FROM lineitem)"""


@query(f"""WITH RECURSIVE {_FILES},
ranked AS (SELECT *, regexp_matches(path, '\\.py$|^src/') AS entry, row_number() OVER (PARTITION BY repo ORDER BY regexp_matches(path, '\\.py$|^src/') DESC, length(path), path) AS n FROM files),
walk AS (SELECT repo, 0::BIGINT AS n, 0::BIGINT AS used, NULL::VARCHAR AS path, 0::BIGINT AS size, FALSE AS taken FROM (SELECT DISTINCT repo FROM files)
  UNION ALL SELECT r.repo, r.n, w.used + s.size, r.path, s.size, s.taken FROM walk w JOIN ranked r ON r.repo = w.repo AND r.n = w.n + 1,
  LATERAL (SELECT CASE WHEN w.used + length(r.content) <= 60 THEN length(r.content) WHEN r.entry AND w.used < 60 THEN 60 - w.used ELSE 0 END AS size, w.used + length(r.content) <= 60 OR (r.entry AND w.used < 60) AS taken) s)
SELECT repo, path, size FROM walk WHERE taken""")
def key_files(spark, sf_dir):
    """Files of each repository (orders' lines in their place) that a budget of 60 bytes takes."""
    k = F.col("l_partkey")
    folder = F.when(k % 4 == 0, "src/").when(k % 4 == 1, "data/").otherwise("")
    path = F.concat(folder, k.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.when(k % 3 == 0, ".py").otherwise(".bin"))
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", path.alias("path"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("content"))
    return relational.key_files(files, "l_orderkey", "path", "content", 60).select("repo", "path", "size")


_GROUPS = [(1, ["small "], ["bolt"]), (2, ["ring", "gear"], []), (3, ["red ", "blue "], ["ring"]), (4, ["widget", "gizmo", "bolt"], []), (5, ["hot ", "small ", "ring"], ["gear"])]
_QUOTAS = [(3, 20), (1, 35), (2, 60), (5, 40), (4, 500)]
_IN_GROUP = {g: f"({' OR '.join(f"contains(p_name, '{w}')" for w in inc)})" + "".join(f" AND NOT contains(p_name, '{w}')" for w in exc) for g, inc, exc in _GROUPS}
_TAKEN = lambda i: " UNION ALL ".join(f"SELECT key FROM t{j}" for j in range(i)) or "SELECT NULL WHERE false"
_TURNS = ", ".join(
    f"t{i} AS (SELECT *, {g} AS taken_by, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM (SELECT * FROM k WHERE {_IN_GROUP[g]} AND key NOT IN ({_TAKEN(i)}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY p_retailprice DESC, p_partkey) = 1) QUALIFY place <= {q})"
    for i, (g, q) in enumerate(_QUOTAS)
)


@query(f"WITH k AS (SELECT *, p_name || ' ' || p_brand AS key FROM part), {_TURNS} " + " UNION ALL ".join(f"SELECT p_partkey, taken_by, place::INT AS place FROM t{i}" for i in range(len(_QUOTAS))))
def quota_across(spark, sf_dir):
    """The dearest parts of each group by words of their name, each name and brand for the first group in turn only."""
    rows = table(spark, sf_dir, "part").withColumn("key", F.concat_ws(" ", "p_name", "p_brand"))
    rows = rows.withColumn("groups", wording.labels(F.col("p_name"), _GROUPS))
    return relational.quota_across(rows, "groups", "key", _QUOTAS, -F.col("p_retailprice"), F.col("p_partkey")).select("p_partkey", "taken_by", "place")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def numbered_rows(spark, sf_dir):
    """All orders numbered by price, over many tasks."""
    rows = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    return relational.numbered(rows, "o_totalprice", "o_orderkey").select("o_orderkey", F.col("at").alias("place"))


_TOPICS = [(1, ["the ", "and "], ["of"]), (2, ["of ", "with "], []), (3, [" le ", " la ", "les "], [" des "]), (4, ["in", "on"], ["ion"]), (5, ["e"], [])]
_SEATS = [(2, 12), (4, 30), (1, 9), (3, 25), (5, 40)]
_TOPIC = {g: "(" + " OR ".join(f"contains(low, '{w}')" for w in inc) + ")" + "".join(f" AND NOT contains(low, '{w}')" for w in exc) for g, inc, exc in _TOPICS}
_SEATED = ", ".join(
    f"t{i} AS (SELECT *, {g} AS taken_by, row_number() OVER (ORDER BY n DESC, doc_id) AS place FROM (SELECT * FROM k WHERE {_TOPIC[g]} AND key NOT IN ({_TAKEN(i)}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, doc_id) = 1) QUALIFY place <= {q})"
    for i, (g, q) in enumerate(_SEATS)
)


@query(f"""WITH k AS (SELECT doc_id, length(text) + length(title) AS n, ' ' || lower(title) || ' ' AS low, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\\(.*?\\)', '', 'g'), '[^a-zà-ỹ0-9 ]', '', 'g'), '\\s+', ' ', 'g'), ' ') AS key
  FROM (SELECT *, regexp_extract(text, '^[^.\\n]*') AS title FROM documents) WHERE lang IN ('en', 'fr') AND length(text) + length(title) > 120), {_SEATED} """ + " UNION ALL ".join(f"SELECT doc_id, taken_by, place::INT AS place FROM t{i}" for i in range(len(_SEATS))))
def seeded_postings(spark, sf_dir):
    """Documents as postings (their first sentence is the title): the longest of each group by words of the title, each title for the first group in turn."""
    rows = table(spark, sf_dir, "documents").withColumn("title", F.regexp_extract("text", r"^[^.\n]*", 0))
    found = relational.seeded_postings(rows, "doc_id", "title", ["text", "title"], "lang", ["en", "fr"], _TOPICS, _SEATS)
    return found.select("doc_id", "taken_by", "place")
