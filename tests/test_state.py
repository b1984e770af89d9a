"""Quotas across groups, numbering, compare-and-set and streams with state against loops and their batch forms."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rankweave.operators import relational, stateful
from rankweave.sources.tables import scratch
from rankweave.streaming import events as streams
from rankweave.streaming import state as live


def in_turn(rows, quotas):
    """Each group in turn: (row, group, place)."""
    seen, out = set(), []
    for g, quota in quotas:
        place = 0
        for i, groups, key, price in sorted(rows, key=lambda r: (-r[3], r[0])):
            if place < quota and g in (groups or []) and key is not None and key not in seen:
                seen.add(key)
                place += 1
                out.append((i, g, place))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_quotas_equal_taking_turns(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.sample([1, 2, 3, 4, 9], rng.randint(0, 4)) or None, rng.choice([None, *"abcdefghijklmnop"]), rng.randint(1, 5)) for i in range(70)]
    quotas = [(3, 4), (1, 3), (4, 20), (2, 5)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "i int, groups array<int>, key string, price int, place string, _key string").repartition(3)
    got = relational.quota_across(df, "groups", "key", quotas, -F.col("price"), F.col("i"))
    assert sorted((r["i"], r["taken_by"], r["place"]) for r in got.collect()) == in_turn(rows, quotas)
    if not seed:
        assert relational.quota_across(df.limit(0), "groups", "key", quotas, F.col("i")).count() == 0


def test_numbers_do_not_depend_on_partitions(spark):
    values = [(random.Random(1).randint(0, 10**6) + i, "x") for i in range(500)]
    want = {v: n for n, v in enumerate(sorted(v for v, _ in values))}
    for parts in (1, 7):
        got = relational.numbered(spark.createDataFrame(values, "v long, x string").repartition(parts), "v").collect()
        assert {r["v"]: r["at"] for r in got} == want
    assert relational.numbered(spark.createDataFrame([], "v long"), "v").count() == 0


CHANGE = "id int, expected string, wanted string, rank int, cause string, who int"


def test_compare_and_set(spark):
    rows = spark.createDataFrame([(1, "pending", "a"), (2, "done", "b"), (3, None, "c"), (None, "pending", "d")], "id int, status string, _hit string").drop("_hit")
    changes = spark.createDataFrame([(1, "pending", "rejected", 1, "timeout", 7), (1, "pending", "withdrawn", 0, "withdrawal", 7), (2, "pending", "rejected", 0, "timeout", 8), (3, None, "open", 0, "other", 9), (4, "pending", "x", 0, "timeout", 1)], CHANGE)
    after, applied = stateful.compare_and_set(rows, changes, "id", "status")
    assert sorted(map(tuple, after.collect()), key=repr) == [(1, "withdrawn"), (2, "done"), (3, "open"), (None, "pending")]
    assert sorted((r["id"], r["wanted"]) for r in applied.collect()) == [(1, "withdrawn"), (3, "open")]
    effects = stateful.penalised(applied, "id", "who").collect()
    assert [tuple(e) for e in effects] == [("withdrawal:1", 7, "withdrawal", -10, 1)]


def test_updates_from_a_join(spark):
    rows = spark.createDataFrame([(1, None), (2, "kept"), (3, None), (None, None)], "id int, deadline string")
    source = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "new", 1), (4, "z", 1)], "id int, deadline string, rank int")
    got = stateful.updated_from(rows, source, "id", "deadline", F.col("deadline").isNull(), "rank").collect()
    assert sorted(map(tuple, got), key=repr) == [(1, "a"), (2, "kept"), (3, None), (None, None)]


def test_a_stream_that_comes_again_changes_nothing(spark, tmp_path):
    items = spark.createDataFrame([(i, "pending") for i in range(20)], "id int, status string")
    none = spark.createDataFrame([], "idempotency_key string, who int, cause string, delta int, id int")
    tables = live.Tables(spark, scratch(spark, "tables"))
    tables.write(items, none)
    for part in range(4):
        made = [(i, "pending", "rejected", 0, "timeout" if i % 2 else "no_show", i % 3) for i in range(part * 4, part * 4 + 5)]
        spark.createDataFrame(made, CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    for per_trigger in (1, 4):
        source = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", per_trigger).parquet(str(tmp_path / "in"))
        live.changing(source, tables, "id", "status", lambda applied: stateful.penalised(applied, "id", "who")).start().awaitTermination()
        after, effects = tables.read()
        seen.append((sorted(map(tuple, after.collect())), sorted(map(tuple, effects.collect()))))
    assert seen[0] == seen[1]
    assert [s for _, s in seen[0][0]] == ["rejected"] * 17 + ["pending"] * 3
    assert [(e[2], e[3]) for e in seen[0][1]] == [("no_show", -15)] * 9 + [("timeout", -5)] * 8
    spark.range(1).write.parquet(f"{tables.path}/99/items")  # a step that was cut off
    assert sorted(map(tuple, tables.read()[0].collect())) == seen[0][0]


@pytest.fixture(scope="module")
def in_order(spark, tmp_path_factory):
    """Events in six files, in order of time from file to file but not within."""
    rng, path = random.Random(2), str(tmp_path_factory.mktemp("events"))
    start = datetime.datetime(2026, 1, 1)
    rows = [(i, rng.choice([1, 2, 3, None]), start + datetime.timedelta(seconds=40 * i + rng.randint(0, 30)), rng.choice([-30, 25, 7, None])) for i in range(240)]
    for part in range(6):
        own = rows[part * 40 : part * 40 + 40]
        rng.shuffle(own)
        spark.createDataFrame(own, "event_id int, user_id int, ts timestamp, delta int").coalesce(1).write.mode("append").parquet(path)
    return path


def read(spark, path, per_trigger):
    # files of one trigger each come by their time of writing
    return spark.readStream.schema("event_id int, user_id int, ts timestamp, delta int").option("maxFilesPerTrigger", per_trigger).parquet(path)


@pytest.mark.parametrize("per_trigger", [1, 100])
def test_live_reputation_equals_the_fold(spark, in_order, per_trigger):
    rows = streams.drained(live.reputation(read(spark, in_order, per_trigger), "user_id", ["ts", "event_id"], "delta"), "reputation")
    last = rows.groupBy("user_id").agg(F.max(F.struct("events", "score")).alias("l")).select("user_id", "l.score", "l.events")
    batch = stateful.clamped_fold(spark.read.parquet(in_order), "user_id", ["ts", "event_id"], "delta")
    assert sorted(map(tuple, last.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


@pytest.mark.parametrize("per_trigger", [1, 100])
def test_the_live_limiter_equals_the_batch(spark, in_order, per_trigger):
    rows = streams.drained(live.limited(read(spark, in_order, per_trigger), "user_id", "ts", "event_id", 3, 600, "5 minutes"), "limiter")
    batch = stateful.admitted(spark.read.parquet(in_order), "user_id", "ts", "event_id", 3, 600)
    pick = lambda df: sorted((r["event_id"], r["allowed"]) for r in df.collect())
    assert pick(rows) == pick(batch) and {a for _, a in pick(batch)} == {True, False}


@pytest.mark.parametrize("per_trigger", [1, 100])
def test_notices_are_sent_once(spark, in_order, per_trigger):
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 10)], "user_id int, user int")
    said = read(spark, in_order, per_trigger).withColumn("item", F.col("event_id") % 20)
    got = streams.drained(live.notices(said, members, "user_id", "item", "e", "ts", "1 day"), "notices").collect()
    events = spark.read.parquet(in_order).where("user_id in (1, 2)").collect()
    want = {(u, f"e:{r['event_id'] % 20}:{u}") for r in events for u in ((10, 11) if r["user_id"] == 1 else (10,))}
    assert sorted((r["user"], r["key"]) for r in got) == sorted(want)
