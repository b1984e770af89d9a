"""Readers of tables and documents, and the writers' merge and evidence forms."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES_LIMIT, POOL = 50, 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over at least as many partitions as the session has cores, for work that costs far more than a shuffle of its input;
    a table with as many splits stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows._jdf.rdd().getNumPartitions() >= cores else rows.repartition(cores)


#: Bytes of files that come to one partition of rows that are dealt out.
SHARE = 4 << 20


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt by columns over a partition for each 4 MB of the files that they come from, so that a task's share, and what it sorts or aggregates
    of it, does not grow with the tables (adaptive execution would join partitions by their compressed size)."""
    spark = rows.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in rows.inputFiles()]
    size = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-size // SHARE)), *by)


def scratch(spark: SparkSession, what: str) -> str:
    """A folder in the shared checkpoint folder; where none is set in a local session, in a temporary one that becomes it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='rankweave-')}")
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read again, so that a loop's lineage ends there."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header (a byte order mark is skipped) and quoted line breaks."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json_folder(spark: SparkSession, path: str, schema: str, order: str, limit: int) -> DataFrame:
    """The first rows, by a column, of a folder of JSON files; files that are no JSON are skipped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).orderBy(order).limit(limit)


def read_front_matter(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta, body) of Markdown files that open with a block of `key: value` lines between fences of ---."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("value"))
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    key = lambda x: F.trim(F.substring_index(x, ":", 1))
    value = lambda x: F.trim(F.regexp_replace(F.substring(x, F.length(F.substring_index(x, ":", 1)) + 2, F.length(x)), r"^\s*[\"']|[\"']\s*$", ""))
    meta = F.map_from_entries(F.transform(pairs, lambda x: F.struct(key(x), value(x))))
    return files.select("path", meta.alias("meta"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n?", "").alias("body"))


def sniffed(content, name):
    """The kind of a file by its first bytes, else by its name's ending."""
    head = F.hex(F.substring(content, 1, 4))
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(head == "25504446", "pdf").when((head == "504B0304") & (ending == "docx"), "docx").when(head == "504B0304", "zip").when(ending.isin("md", "txt"), "text").otherwise("unknown")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, modified, text) of files; the text of those that are text."""
    raw = spark.read.format("binaryFile").load(path)
    kind = sniffed(F.col("content"), F.col("path"))
    return raw.select("path", kind.alias("kind"), F.col("modificationTime").alias("modified"), F.when(kind == "text", F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old replaced by those of new with equal keys, and new's others added; new must have one row a key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def inserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows and those new ones whose key is not there yet, the first of each key by all columns."""
    fresh = new.join(old.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("r")).select(key, "r.*")
    return old.unionByName(first.select(*old.columns))


def run_with_evidence(runs: DataFrame, run_id: str, evidence: str) -> tuple[DataFrame, DataFrame]:
    """A header row a run, and a child row for each element of its evidence array with its place from 1."""
    children = runs.select(run_id, F.posexplode(evidence).alias("at", "e")).select(run_id, (F.col("at") + 1).alias("place"), "e.*")
    return runs.withColumn("n_evidence", F.size(evidence)).drop(evidence), children
