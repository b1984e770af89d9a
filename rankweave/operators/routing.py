"""Chat messages by what they ask for, and the entities that texts name."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.functions import routing
from rankweave.functions.unicode import folded

#: Rows whose tokens are Python objects at a time.
ROWS = 200
#: A dictionary of more phrases, or more characters of them, is not broadcast.
MOST_PHRASES, MOST_CHARS = 1_000_000, 64 << 20
#: A token of the folded view: a run of letters and digits, or any other sign by itself.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def routes(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """messages with the column route (``functions.routing.routed``). A null text counts as empty; rows that repeat stay; an empty table gives none."""
    seen = messages.withColumn("_view", folded(F.coalesce(F.col(text_col), F.lit(""))))
    return seen.withColumn("route", routing.routed(F.col(text_col), F.col("_view"))).drop("_view")


def entities(docs: DataFrame, doc_id: str, text_col: str, dictionary: DataFrame) -> DataFrame:
    """(doc, at, tokens, kind, phrase): the phrases of (kind, phrase) that a text names as whole words, accents and case aside.

    A trie of the phrases' tokens is broadcast (its size is checked: beyond MOST_PHRASES or MOST_CHARS it is refused). From each token on the
    longest phrase counts, and the search goes on behind it; at and tokens are its place and length among the text's tokens. Phrases that are
    the same once folded are all named. Null texts name nothing, as do empty phrases; rows that repeat stay; empty tables give no rows.
    """
    spark = docs.sparkSession
    view = lambda c: F.regexp_extract_all(folded(c), F.lit(TOKEN), F.lit(0))
    size = dictionary.agg(F.count("*"), F.coalesce(F.sum(F.length("phrase")), F.lit(0))).first()
    if size[0] > MOST_PHRASES or size[1] > MOST_CHARS:
        raise ValueError(f"a dictionary of {size[0]} phrases with {size[1]} characters is not broadcast; split it")
    trie: dict = {}
    for row in dictionary.select("kind", "phrase", view(F.col("phrase")).alias("tokens")).where(F.size("tokens") > 0).distinct().toLocalIterator():
        node = trie
        for token in row["tokens"]:
            node = node.setdefault(token, {})
        node.setdefault("", []).append((row["kind"], row["phrase"]))  # no token is empty
    shared = spark.sparkContext.broadcast(trie)
    rows = docs.select(F.col(doc_id).alias("doc"), view(F.col(text_col)).alias("tokens"))
    schema = T.StructType([rows.schema["doc"], T.StructField("at", T.IntegerType()), T.StructField("tokens", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("phrase", T.StringType())])

    def named(tokens: list[str]) -> Iterator[tuple]:
        at = 0
        while at < len(tokens):
            node, end, found = shared.value, at, None
            while end < len(tokens) and (node := node.get(tokens[end])) is not None:
                end += 1
                if "" in node:
                    found = (end, node[""])
            if found:
                for kind, phrase in found[1]:
                    yield at, found[0] - at, kind, phrase
            at = found[0] if found else at + 1

    def search(batches):
        for batch in batches:
            # a few rows' tokens at a time: as Python lists they take many times the batch's memory
            for part in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                owner, out = [], []
                for i, tokens in enumerate(part.column(1).to_pylist()):
                    for hit in named(tokens or []):
                        owner.append(i)
                        out.append(hit)
                columns = [part.column(0).take(pa.array(owner, pa.int64()))] + [pa.array([h[k] for h in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(search, schema)
