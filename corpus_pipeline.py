"""The corpus pipeline: language, toxicity, near-duplicates, benchmark leaks, then token ids; each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import bpe, decontaminate, langid, near, toxicity
from rankweave.llm.common import dropped, stored, table
from rankweave.llm.queries import TOKENIZER

#: Near copies are linked from this similarity (percent of shared five-word shingles) on; the 85 of op2_near_dedup is that query's contract only.
NEAR_PERCENT = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null, empty and letterless texts go."""
    found = langid.identify(docs, langid.learn(docs))
    return found.where("lang_pred <> 'und'").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a lexicon learned from the labels of the documents given."""
    fitted = toxicity.fit(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, fitted).where(F.col("tox_score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id. Rows that share a doc_id go or stay together, and
    rows without one stay."""
    kept = near.group(docs, percent=NEAR_PERCENT).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's window."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("items") == 0).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian unsigned 32-bit) of the documents that are left, a row each; a null text has none."""
    return bpe.encode_decode(docs, TOKENIZER, carry=["doc_id", "lang", "source"]).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages), ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("leaks", drop_leaks), ("tokens", tokenize),
]

#: Learned models decide two stages; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again. Null, empty and letterless texts go in the
    first stage; rows that repeat stay or go together, but for near copies of different ids; an empty table gives no rows."""
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES[:-1]:
        docs, read = stored(stage(spark, docs, sf_dir), f"pipeline-{name}"), before
        if read is not None:
            dropped(read)  # what the stage before this one wrote has been read for the last time
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
