"""Helpers the operators share: table reading, Arrow mapping, the shared scratch folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of an Arrow batch, about, that a task works on at once.
SLICE_BYTES = 4 << 20
_HELD: dict = {}


def held(key, make: Callable):
    """The object that make() gives, kept in the Python worker until another key is asked for: one operator's model at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset in a local session (tests) a temporary folder becomes the session's checkpoint folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='rankweave-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read again: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files that a ``stored`` frame reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, inputs: Sequence[str], outputs: Sequence[T.StructField], make: Callable, carry: Sequence[str] | None = None) -> DataFrame:
    """Appends columns that Python computes from Arrow batches, with no shuffle.

    ``make()`` is called once a task and returns a function from (lists of) input columns to output columns.
    ``carry``: the columns of df that stay (all, by default); one whose name an output has is replaced by the output.
    """
    new = [f.name for f in outputs]
    carry = [c for c in (df.columns if carry is None else carry) if c not in new]
    source = df.select(*dict.fromkeys([*carry, *inputs]))
    schema = T.StructType([*(source.schema[c] for c in carry), *outputs])
    names = schema.names

    def run(batches):
        work = make()
        for whole in batches:
            rows = max(1, whole.num_rows * SLICE_BYTES // max(whole.nbytes, 1))
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                made = work(*(batch.column(c) for c in inputs))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *made], names=names)
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


#: Rows of one key from which a join splits the key; with more rows in all, a 10,000th of them, so that at most 10,000 keys are split.
SPLIT_ROWS = 512


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are unique, with left's hot keys dealt over many tasks.

    A key of more than SPLIT_ROWS rows (or a 10,000th of all rows, if that is more) gets a salt from a hash of the row; right's row of it
    is repeated for each salt. The table of hot keys is broadcast: it has at most 10,000 rows whatever the data.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_all"))
    most = F.greatest(F.lit(SPLIT_ROWS), F.ceil(F.col("_all") / 10_000))
    hot = counts.where(F.col("_rows") > SPLIT_ROWS).crossJoin(F.broadcast(total)).where(F.col("_rows") > most).select(*keys, F.ceil(F.col("_rows") / most).cast("int").alias("_salts"))
    hot = F.broadcast(stored(hot, "hot-keys"))
    salts = F.coalesce("_salts", F.lit(1))
    a = left.join(hot, keys, "left").withColumn("_salt", F.when(salts > 1, F.pmod(F.xxhash64(*left.columns), salts)).otherwise(0).cast("int")).drop("_salts")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def held_out(id_col: str, modulus: int, remainder: int = 2):
    """True on rows that a fit must not see: crc32 of the id's decimal text leaves the remainder; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number reachable from each of n nodes over the edges a-b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, a, least)
        np.minimum.at(now, b, least)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable from every node that an edge (a, b) names.

    Alternating large-star and small-star rounds on the edge table, each written to the shared folder; rounds grow with the
    logarithm of the longest path. No component is gathered in one task: a round groups by node, and a star's centre is
    reached through a pre-aggregated minimum and a join, whose skewed keys adaptive execution splits.
    """
    spark = edges.sparkSession
    shared_dir(spark)

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        if not large:
            both = both.where("v < u")
        least = both.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("lo"))
        joined = both.join(least, "u")
        out = joined.where("v > u" if large else "v <> lo").select(F.col("v").alias("x"), F.col("lo").alias("y"))
        if not large:
            out = out.union(least.select(F.col("u").alias("x"), F.col("lo").alias("y")))
        return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        after = stored(star(star(now, True), False), "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(now) if mark is not None or not after.isEmpty() else None
        now = after
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
