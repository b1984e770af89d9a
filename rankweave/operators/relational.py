"""Picks, rollups, intervals and probes over keyed rows."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.functions import wording
from rankweave.sources.tables import kept


def latest_per_key(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; a pre-aggregated alternative is max_by where one column is enough."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def top_per_group(rows: DataFrame, group: list[str], k: int | Column, *order: Column) -> DataFrame:
    """The first k rows of each group, numbered in place from 1."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("place", n).where(F.col("place") <= k)


def distinct_capped(rows: DataFrame, text: str, group: str, k: int, *order: Column) -> DataFrame:
    """The first row of each text (case and outer space aside), then at most k a group."""
    first = rows.withColumn("_t", F.lower(F.trim(F.col(text))))
    return top_per_group(latest_per_key(first, ["_t"], *order), [group], k, *order).drop("_t")


def page(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def merged_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end) of the unions of touching or overlapping intervals."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def months_between(start: Column, end: Column) -> Column:
    """Calendar months from one date to another, days aside."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def slot_problems(rows: DataFrame, key: str, start: str, end: str, gap_hours: float, least_minutes: float) -> DataFrame:
    """Each slot with what is wrong with it: too short, overlapping or too near the next."""
    after = F.lead(start).over(Window.partitionBy(key).orderBy(start, end))
    seconds = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6
    problem = (
        F.when(seconds(F.col(start), F.col(end)) < least_minutes * 60, "short").when(after.isNull(), "ok")
        .when(after < F.col(end), "overlap").when(seconds(F.col(end), after) < gap_hours * 3600, "gap").otherwise("ok")
    )
    return rows.withColumn("problem", problem)


def apportioned(counts: DataFrame, group: str, n: str, seats: int) -> DataFrame:
    """Seats by group: one each, and one more for the largest groups while seats are left; counts is one row a group."""
    place = F.row_number().over(Window.orderBy(F.desc(n), group))
    every = counts.agg(F.count("*").alias("_groups"))
    return counts.withColumn("_place", place).crossJoin(F.broadcast(every)).select(group, n, (1 + (F.col("_place") <= seats - F.col("_groups")).cast("long")).alias("seats"))


def shared_out(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key, quota): a total split evenly over the distinct keys, what is left over to the first ones."""
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    place = F.row_number().over(Window.orderBy(key)) - 1
    n = keys.agg(F.count("*").alias("_n"))
    return keys.withColumn("_at", place).crossJoin(F.broadcast(n)).select(key, (F.floor(total / F.col("_n")) + (F.col("_at") < total % F.col("_n")).cast("long")).alias("quota"))


def quota_across(rows: DataFrame, groups: str, key: str, quotas: list[tuple[int, int]], *order: Column) -> DataFrame:
    """rows with the group that takes them, and their place in it: each group in turn takes the first rows by order, up to its quota, of keys that no
    earlier group has taken, one row a key.

    groups: an array column of the groups that a row may go to; quotas: (group, quota) in their turn, a list written in the code. No turn waits for
    another: every group holds the first keys of its own order, a key that several hold goes to the earliest, the others move on to their next, until nobody loses
    one. As all keys prefer the earliest group, that is what taking turns gives. No group can need more keys than all quotas together, so only
    so many of each are kept, and rounds work on these. Rows without a key or group are never taken; an empty table gives no rows; columns named taken_by or place are replaced.
    """
    total = sum(q for _, q in quotas)
    turn = F.create_map(*(F.lit(x) for i, (g, _) in enumerate(quotas) for x in (g, i)))
    quota = F.create_map(*(F.lit(x) for i, (_, q) in enumerate(quotas) for x in (i, q)))
    each = rows.withColumn("_turn", F.explode(F.array_distinct(F.array_compact(F.transform(groups, lambda g: F.try_element_at(turn, g)))))).where(F.col(key).isNotNull())
    ordered = [F.struct(*order).alias("_order")]
    best = each.select("_turn", F.col(key).alias("_key"), *ordered, F.struct(*rows.columns).alias("_row"))
    best = best.groupBy("_turn", "_key").agg(F.min(F.struct("_order", "_row")).alias("b")).select("_turn", "_key", "b.*")
    place = F.row_number().over(Window.partitionBy("_turn").orderBy("_order", "_key"))
    now = kept(best.withColumn("_at", place).where(F.col("_at") <= total).withColumn("_lost", F.lit(False)), "quota")
    while True:
        left = F.sum((~F.col("_lost")).cast("int")).over(Window.partitionBy("_turn").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
        held = now.withColumn("_holds", ~F.col("_lost") & (left <= F.element_at(quota, F.col("_turn"))))
        first = F.min(F.when(F.col("_holds"), F.col("_turn"))).over(Window.partitionBy("_key"))
        after = kept(held.withColumn("_loses", F.col("_holds") & (F.col("_turn") > first)).withColumn("_lost", F.col("_lost") | F.col("_loses")), "quota")
        if after.where("_loses").isEmpty():
            break
        now = after.drop("_holds", "_loses")
    group = F.element_at(F.create_map(*(F.lit(x) for i, (g, _) in enumerate(quotas) for x in (i, g))), F.col("_turn"))
    taken = after.where("_holds").withColumn("place", F.row_number().over(Window.partitionBy("_turn").orderBy("_at")))
    return taken.select(*(f"_row.{c}" for c in rows.columns if c not in ("taken_by", "place")), group.alias("taken_by"), "place")


def seeded_postings(rows: DataFrame, key: str, title: str, texts: list[str], category: str, wanted: list[str], groups: list[tuple[int, list[str], list[str]]], quotas: list[tuple[int, int]], least: int = 120) -> DataFrame:
    """rows of the wanted categories, with texts of more than ``least`` characters together, as groups take them in turn, longest texts first
    (ties by key): a title counts once, brackets, signs and case aside. taken_by is the group and place the place in it.

    groups: (number, words of which a title has one, words of which it has none), quotas: (number, rows) in their turn. Null texts have no characters.
    """
    size = reduce(lambda a, b: a + b, (F.coalesce(F.length(c), F.lit(0)) for c in texts))
    real = rows.where(F.col(category).isin(wanted) & (size > least)).withColumns({"_groups": wording.labels(F.col(title), groups), "_title": wording.dedup_key(F.col(title))})
    return quota_across(real, "_groups", "_title", quotas, -size, F.col(key)).drop("_groups", "_title")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with at, their number from 0 by order, over any number of tasks: sorted by range, numbered within tasks, shifted by the counts of the tasks
    before. Rows that are equal by order get any of their numbers; an empty table gives none."""
    schema = T.StructType([*rows.schema, T.StructField("_task", T.IntegerType()), T.StructField("_n", T.LongType())])

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([task] * b.num_rows, pa.int32()), pa.array(range(n, n + b.num_rows), pa.int64())], names=schema.names)
            n += b.num_rows

    held = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "numbered")
    before = F.sum("count").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))  # one row a task
    shift = held.groupBy("_task").count().select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    return held.join(F.broadcast(shift), "_task").select(*rows.columns, (F.col("_before") + F.col("_n")).alias("at"))


def diverse_sample(rows: DataFrame, group: str, profile: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group, first one of each profile (profiles in order), then any: by a seeded hash of the key."""
    order = [F.xxhash64(key, F.lit(seed)), F.col(key)]
    of_profile = F.row_number().over(Window.partitionBy(group, profile).orderBy(*order))
    first = F.when(F.col("_p") == 1, 0).otherwise(1)
    out = rows.withColumn("_p", of_profile)
    n = F.row_number().over(Window.partitionBy(group).orderBy(first, F.when(F.col("_p") == 1, F.col(profile)), *order))
    return out.withColumn("place", n).where(F.col("place") <= k).drop("_p")


def requested_order(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows with place, that of their key in an array ``keys`` of the one row of wanted; keys that are not asked for come last, as 999."""
    places = wanted.select(F.posexplode("keys").alias("_at", "_key")).groupBy("_key").agg(F.min("_at").alias("_at"))
    return rows.join(places, F.col(key) == F.col("_key"), "left").withColumn("place", F.coalesce("_at", F.lit(999))).drop("_at", "_key")


def similar(rows: DataFrame, key: str, by: list[str], k: int) -> DataFrame:
    """(key, other, place): up to k other rows that equal a row in any of the columns, smallest keys first.

    Not an OR-join: for each column only the k + 1 smallest keys of each value can be among a row's first k, so each row meets at
    most (k + 1) * len(by) others.
    """
    found = None
    for c in by:
        few = top_per_group(rows.select(F.col(key).alias("other"), c), [c], k + 1, F.col("other")).select("other", c)
        pairs = rows.select(key, c).join(few, c).where(F.col(key) != F.col("other")).select(key, "other")
        found = pairs if found is None else found.union(pairs)
    return top_per_group(found.distinct(), [key], k, F.col("other"))


def fanned_out(rows: DataFrame, members: DataFrame, key: str, by: str) -> DataFrame:
    """Each row with each member of its key, for few keys with many rows and many members.

    The rows of a key are dealt by another column over parts, each of which meets the key's members; so the pairs of one key are made by many tasks, of
    which none holds more than it streams through. Members are copied once a part: twice the session's cores, however large the tables.
    """
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
    left = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).repartition(4 * parts, key, "_part")
    right = members.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(4 * parts, key, "_part")
    return left.join(right, [key, "_part"]).drop("_part")


def changes(rows: DataFrame, key: str, state: str, *order: Column) -> DataFrame:
    """Rows whose state differs from the one before of the same key, with that one as `before`."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("before", before).where(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col(state)))


#: Paths that mark the files to read first.
ENTRY_PATTERNS = [
    r"\.py$", r"\.ts$", r"\.tsx$", r"\.js$", r"\.jsx$", "^src/", "^lib/", "^app/", "^backend/", "^frontend/", "^tests?/", "^specs?/", r"^main\.py$", r"^index\.(ts|js|tsx|jsx)$",
    "^Makefile$", r"^package\.json$", r"^requirements\.txt$", r"^pyproject\.toml$", r"^setup\.py$", r"^setup\.cfg$", "^Dockerfile$", "^docker-compose", r"\.md$", r"\.txt$",
]


def key_files(rows: DataFrame, repo: str, path: str, content: str, budget: int = 80_000, most: int = 10_000) -> DataFrame:
    """(repo, path, content, size, entry): files of each repository while they fit into a budget of bytes, entry points and short paths first.

    A file is cut to ``most`` characters. One that doesn't fit is passed over, but an entry point is cut to what is left; nothing follows
    once nothing is left. A repository's files are folded in one row: they are few, and cut before they are gathered.
    """
    entry = F.col(path).rlike("|".join(ENTRY_PATTERNS))
    f = F.struct((~entry).alias("later"), F.length(path).alias("len"), F.col(path).alias("path"), F.substring(F.coalesce(content, F.lit("")), 1, most).alias("content"))
    items = rows.groupBy(F.col(repo).alias("repo")).agg(F.array_sort(F.collect_list(f)).alias("items"))
    taken = "array<struct<path:string,content:string,size:bigint,entry:boolean>>"
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(taken).alias("taken"))

    def step(s: Column, x: Column) -> Column:
        left = budget - s["used"]
        cut = F.when(F.octet_length(x["content"]) <= left, x["content"]).when(~x["later"], F.substring(x["content"], F.lit(1), left.cast("int")))
        size = F.octet_length(cut).cast("long")
        got = F.struct((s["used"] + size).alias("used"), F.array_append(s["taken"], F.struct(x["path"].alias("path"), cut.alias("content"), size.alias("size"), (~x["later"]).alias("entry"))).alias("taken"))
        fits = F.octet_length(x["content"]) <= left
        return F.when(fits | ((left > 0) & ~x["later"]), got).otherwise(s)

    return items.select("repo", F.explode(F.aggregate("items", zero, step)["taken"]).alias("f")).select("repo", "f.*")
