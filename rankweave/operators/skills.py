"""Skill taxonomy joins: exact and fuzzy extraction, coverage, related skills."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.functions import text
from rankweave.functions.guardrails import let
from rankweave.sources.tables import spread

FUZZY_RATIO, FUZZY_LENGTH, RELATED = 88, 4, 8

#: Our own taxonomy over frequent words of the test corpus: variant, slug, category, role.
TAXONOMY = [
    ("thatin", "thatin", "languages", "backend"), ("ononst", "ononst", "languages", "backend"), ("inoran", "inoran", "languages", "data"),
    ("hehely", "hehely", "databases", "data"), ("orantion", "orantion", "databases", "data"), ("thble", "thble", "databases", "backend"),
    ("thtion", "thtion", "frontend", "web"), ("mente", "mente", "frontend", "web"), ("thing", "thing", "frontend", "web"),
    ("attion", "attion", "devops", "platform"), ("ertion", "ertion", "devops", "platform"), ("atening", "attion", "devops", "platform"),
    ("inthe", "inthe", "devops", "platform"), ("ndthe", "inthe", "devops", "platform"), ("onher", "onher", "languages", "data"),
]


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, "variant string, slug string, category string, role string")


def named(rows: DataFrame, view: str, terms: DataFrame) -> DataFrame:
    """rows with slugs: the sorted skills that a matched text (``text.matched``) names by a variant of any number of words; none for null.

    terms is a small dimension table: its variants are gathered into one row, so that nothing but that row goes to the texts.
    """
    by = terms.where("variant is not null").groupBy("variant").agg(F.collect_set("slug").alias("slugs"))
    one = by.agg(F.coalesce(F.max(F.size(F.split("variant", " "))), F.lit(1)).alias("_most"), F.map_from_entries(F.collect_list(F.struct("variant", "slugs"))).alias("_of"))
    words = F.filter(F.split(view, " "), lambda w: w != "")
    several = lambda ws: F.flatten(F.transform(F.sequence(F.lit(1), F.col("_most")), lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - n, F.lit(-1)) + 1), lambda i: F.array_join(F.slice(ws, i + 1, n), " "))))
    grams = F.when(F.col("_most") == 1, F.split(view, " ")).otherwise(let(words, several))
    slugs = F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_intersect(grams, F.map_keys("_of")), lambda v: F.col("_of")[v]))))
    return rows.crossJoin(F.broadcast(one)).withColumn("slugs", F.coalesce(slugs, F.array().cast("array<string>"))).drop("_most", "_of")


def found(rows: DataFrame, view: str, terms: DataFrame, keep: list[str]) -> DataFrame:
    """(keep.., slug): the skills that a matched text names, each once a row of equal keep."""
    return named(rows, view, terms).select(*keep, F.explode("slugs").alias("slug")).distinct()


def extract(docs: DataFrame, terms: DataFrame, doc_id: str, text_col: str = "text", near: bool = False) -> DataFrame:
    """(doc, slug): each skill a document names by one of its variants, or, if near, by a word that nearly is one (``fuzzy``); terms is a small dimension table."""
    views = spread(docs.select(F.col(doc_id).alias("doc"), F.col(text_col))).select("doc", text.matched(F.col(text_col)).alias("view"))
    exact = found(views, "view", terms, ["doc"])
    return exact.union(fuzzy(docs, terms, doc_id, text_col).select("doc", "slug")).distinct() if near else exact


def related(terms: DataFrame) -> DataFrame:
    """(slug, related): up to RELATED other skills of the same category, by name."""
    a = terms.select("slug", "category").distinct()
    b = a.withColumnsRenamed({"slug": "other"})
    siblings = a.join(b, "category").where("slug <> other").groupBy("slug").agg(F.array_sort(F.collect_set("other")).alias("all"))
    return siblings.select("slug", F.slice("all", 1, RELATED).alias("related"))


def categories(terms: DataFrame) -> DataFrame:
    """(slug, categories, variants): each skill's name, category and role, each once, and all its variants."""
    by = terms.groupBy("slug").agg(F.first("category").alias("c"), F.first("role").alias("r"), F.array_sort(F.collect_set("variant")).alias("variants"))
    return by.select("slug", F.array_distinct(F.filter(F.array("slug", "c", "r"), lambda x: x.isNotNull() & (x != ""))).alias("categories"), "variants")


def _natural(slug: Column) -> Column:
    return F.replace(slug, F.lit("_"), F.lit(" "))


def expanded(query: Column, found: Column) -> Column:
    """A query with the words of the categories (an array for each skill found) on a line below."""
    extra = F.array_distinct(F.transform(F.flatten(found), _natural))
    return F.when(F.size(extra) > 0, F.concat(query, F.lit("\n"), F.array_join(extra, " "))).otherwise(query)


def bm25_document(body: Column, slugs: Column) -> Column:
    """A text with its skills' names as they are and in words."""
    return F.trim(F.concat(body, F.lit("\n"), F.array_join(F.concat(slugs, F.transform(slugs, _natural)), " ")))


def bm25_query(title: Column, slugs: Column) -> Column:
    return F.trim(F.array_join(F.filter(F.concat(F.array(title), slugs, F.transform(slugs, _natural)), lambda x: x.isNotNull() & (x != "")), " "))


def protected(matched: Column, terms: list[tuple]) -> Column:
    """A matched text (lower case, words between single spaces) with each alias replaced by its skill's name, longer aliases first.

    terms: rows that begin with (variant, slug), few enough to be written in the plan.
    """
    aliases = sorted({(v, s) for v, s, *_ in terms if v != s and len(v) >= 2}, key=lambda p: (-len(p[0]), p[0]))
    return reduce(lambda c, p: F.regexp_replace(c, rf"(?<![a-z0-9_]){re.escape(p[0])}(?![a-z0-9_])", p[1]), aliases, matched)


def indel_ratio(a: str, b: str) -> float:
    """Normalised insert-delete similarity in percent: 200 * longest common subsequence / both lengths.

    The subsequence's length is counted bit-parallel: a zero in ``rows`` for each letter of a that it uses, one addition for each letter of b.
    """
    if not a and not b:
        return 100.0
    places, full = {}, (1 << len(a)) - 1
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    rows = full
    for y in b:
        hits = rows & places.get(y, 0)
        rows = (rows + hits | rows - hits) & full
    return 200.0 * (len(a) - rows.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)])


def fuzzy(docs: DataFrame, terms: DataFrame, doc_id: str, text_col: str = "text") -> DataFrame:
    """(doc, word, slug, ratio): words that are nearly a variant, the best variant of each word.

    A ratio of 88 bounds the length difference and, for words of 4 and more, leaves a common character pair; so only distinct
    words of like length that share a pair with a variant are compared.
    """
    words = docs.select(F.explode(text.tokens(F.col(text_col))).alias("word")).where(F.length("word") >= FUZZY_LENGTH).distinct()
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))
    variants = terms.where(F.length("variant") >= FUZZY_LENGTH).select("variant", "slug", F.explode(pairs(F.col("variant"))).alias("pair"))
    near = words.select("word", F.explode(pairs(F.col("word"))).alias("pair")).join(F.broadcast(variants), "pair").where(F.col("word") != F.col("variant"))
    near = near.where(F.abs(F.length("word") - F.length("variant")) <= 0.28 * F.least(F.length("word"), F.length("variant"))).select("word", "variant", "slug").distinct()
    scored = near.withColumn("ratio", indel("word", "variant")).where(F.col("ratio") >= FUZZY_RATIO)
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("ratio"), "variant"))).where("n = 1").drop("n", "variant")
    named = docs.select(F.col(doc_id).alias("doc"), F.explode(F.array_distinct(text.tokens(F.col(text_col)))).alias("word"))
    return named.join(best, "word").select("doc", "word", "slug", F.round("ratio", 6).alias("ratio"))
