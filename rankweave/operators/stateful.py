"""Per-key folds over ordered events, as batch jobs: clamped reputation, admitted rates, deadlines, status, outbox."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What may follow each status.
TRANSITIONS = {
    "pending": ["screening", "interview", "rejected", "withdrawn"], "screening": ["interview", "rejected", "withdrawn"], "interview": ["offer", "rejected", "withdrawn"],
    "offer": ["accepted", "rejected", "withdrawn"], "accepted": [], "rejected": [], "withdrawn": [],
}


#: What each cause takes off a reputation.
PENALTIES = {"timeout": -5, "withdrawal": -10, "no_show": -15}


def compare_and_set(rows: DataFrame, changes: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows after the changes, the changes that were applied).

    changes: (key, expected, wanted, rank, ..). A row whose column is what a change expects gets what it wants; of several such changes of a row the one of
    the least rank counts (ties: by all columns). Changes that expect something else, or of keys that are not there, do nothing. rows has one row a key.
    """
    fits = changes.join(rows.select(key, F.col(column).alias("_now")), key).where(F.col("_now").eqNullSafe(F.col("expected"))).drop("_now")
    others = [c for c in changes.columns if c not in (key, "rank")]
    applied = fits.groupBy(key).agg(F.min(F.struct("rank", *others)).alias("c")).select(key, "c.*")
    new = applied.select(key, F.col("wanted").alias("_wanted"), F.lit(True).alias("_hit"))
    after = rows.join(new, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_wanted")).otherwise(F.col(column)))
    return after.select(*rows.columns), applied.select(*changes.columns)


def updated_from(rows: DataFrame, source: DataFrame, key: str, column: str, when: Column, *order: str) -> DataFrame:
    """rows with the column taken from source's first row of the key by order, where ``when`` (over rows' columns) holds and source has the key; other rows stay."""
    first = source.groupBy(key).agg(F.min(F.struct(*order, F.col(column).alias("_new"))).alias("s")).select(key, F.col("s._new").alias("_new"), F.lit(True).alias("_there"))
    return rows.join(first, key, "left").withColumn(column, F.when(when & F.col("_there"), F.col("_new")).otherwise(F.col(column))).select(*rows.columns)


def added_once(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and the first row (by all columns) of each key of new that old lacks."""
    fresh = new.join(old.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min(F.struct(*[c for c in old.columns if c != key])).alias("r")).select(key, "r.*")
    return old.unionByName(first.select(*old.columns))


def penalised(applied: DataFrame, key: str, subject: str) -> DataFrame:
    """(idempotency_key, subject, cause, delta, key) of applied changes whose cause has a penalty."""
    delta = F.create_map(*(F.lit(x) for pair in PENALTIES.items() for x in pair))
    made = applied.withColumn("delta", F.try_element_at(delta, F.col("cause"))).where(F.col("delta").isNotNull())
    return made.select(F.concat_ws(":", "cause", F.col(key).cast("string")).alias("idempotency_key"), subject, "cause", "delta", key)


def clamped_fold(events: DataFrame, key: str, order: list[str], delta: str, start: int = 100, low: int = 0, high: int = 100) -> DataFrame:
    """(key, score, events): deltas added in order, the score clamped after each.

    A clamped addition is x -> min(h, max(l, x + d)), and two of them in a row are one more such function. A task folds the runs of
    its sorted partition into one function a key and run, so a key of any size crosses tasks as a few rows; those few are composed in order.
    """
    cols = [key, *order, delta]
    at = len(cols) - 1
    fields = T.StructType([events.schema[key], T.StructField("part", T.IntegerType()), T.StructField("d", T.LongType()), T.StructField("l", T.LongType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        current, made = None, []
        for b in batches:
            for k, d in zip(b.column(0).to_pylist(), b.column(at).to_pylist(), strict=True):
                d = d or 0
                if current is None or current[0] != k:
                    if current is not None:
                        made.append(tuple(current))
                    current = [k, part, 0, low, high, 0]
                current[2] += d
                current[3], current[4] = max(low, min(high, current[3] + d)), max(low, min(high, current[4] + d))
                current[5] += 1
        if current is not None:
            made.append(tuple(current))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), to_arrow_schema(fields), strict=True)], names=fields.names)

    pieces = events.select(*cols).repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(run, fields)
    ordered = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "d", "l", "h", "n"))).alias("e"))
    step = lambda s, x: F.greatest(x["l"], F.least(x["h"], s + x["d"]))
    return ordered.select(key, F.aggregate("e", F.lit(start).cast("long"), step).alias("score"), F.aggregate("e", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("events"))


def once(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The first event of each idempotency key."""
    first = events.groupBy(key).agg(F.min(F.struct(*order, *[c for c in events.columns if c not in (*order, key)])).alias("e"))
    return first.select(key, "e.*")


def admitted(events: DataFrame, key: str, at: str, tie: str, most: int, seconds: float) -> DataFrame:
    """Each event with whether a limiter lets it in: fewer than `most` let-in events of its key in the seconds before.

    Sorted by key and time, a partition is one pass with a queue of the current key's last admitted times.
    """
    out = T.StructType([*events.schema, T.StructField("allowed", T.BooleanType())])
    places = {c: i for i, c in enumerate(events.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, queue = object(), []
        for b in batches:
            keys, times, allowed = b.column(places[key]).to_pylist(), b.column(places[at]).cast(pa.int64()).to_pylist(), []
            for k, t in zip(keys, times, strict=True):
                if k != current:
                    current, queue = k, []
                if t is None:
                    allowed.append(False)
                    continue
                queue = [x for x in queue if x > t - seconds * 1e6]
                allowed.append(len(queue) < most)
                if allowed[-1]:
                    queue.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(allowed, pa.bool_())], names=out.names)

    return events.repartition(key).sortWithinPartitions(key, at, tie).mapInArrow(run, out)


def expired(rows: DataFrame, deadline: str, as_of: Column, limit: int, key: str) -> DataFrame:
    """Pending rows past their deadline, oldest first, at most a batch."""
    return rows.where((F.col("status") == "pending") & (F.col(deadline) < as_of)).orderBy(deadline, key).limit(limit)


def current_status(stages: DataFrame, key: str, stage: str, *order: str) -> DataFrame:
    """The stage of each key's last event."""
    return stages.groupBy(key).agg(F.max_by(stage, F.struct(*order)).alias("status"), F.count("*").alias("changes"))


def violations(stages: DataFrame, key: str, stage: str, *order: str) -> DataFrame:
    """Stage changes that the table of transitions doesn't allow."""
    spark = stages.sparkSession
    pairs = spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "before string, stage string").withColumnRenamed("stage", stage)
    before = F.lag(stage).over(Window.partitionBy(key).orderBy(*order))
    moved = stages.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(stage)))
    return moved.join(F.broadcast(pairs), ["before", stage], "left_anti")


def due(outbox: DataFrame, as_of: Column, most_attempts: int) -> DataFrame:
    return outbox.where(F.col("status").isin("pending", "failed") & (F.col("attempts") < most_attempts) & (F.col("next_retry_at") <= as_of))


def to_ingest(sources: DataFrame, stored: DataFrame, key: str, versions: list[str]) -> DataFrame:
    """Sources whose hash or versions are not the stored ones."""
    return sources.join(stored.select(key, *versions), [key, *versions], "left_anti")
