"""Ranking quality, percentiles and sample statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, grades: DataFrame, ks: list[int], relevant: int = 1, first: int = 2) -> DataFrame:
    """P, R and NDCG at each k and the reciprocal rank, a row a query.

    ranked: (query, doc, place); grades: (query, doc, grade). Precision divides by the list's actual length up to k, recall by
    all relevant documents, NDCG by the gain of all grades sorted; the reciprocal rank is that of the first of grade `first`.
    """
    grade = F.coalesce("grade", F.lit(0))
    gain = lambda g, p: (F.pow(F.lit(2.0), g) - 1) / F.log2(p + 1.0)
    rows = ranked.join(grades, ["query", "doc"], "left").withColumn("grade", grade)
    aggs, ideal_aggs = [], [F.count_if(F.col("grade") >= relevant).alias("all")]
    for k in ks:
        inside = F.col("place") <= k
        aggs += [F.count_if(inside).alias(f"n{k}"), F.count_if(inside & (F.col("grade") >= relevant)).alias(f"hits{k}"), F.sum(F.when(inside, gain(F.col("grade"), F.col("place"))).otherwise(0.0)).alias(f"dcg{k}")]
        ideal_aggs.append(F.sum(F.when(F.col("best") <= k, gain(F.col("grade"), F.col("best"))).otherwise(0.0)).alias(f"ideal{k}"))
    aggs.append(F.min(F.when(F.col("grade") >= first, F.col("place"))).alias("first"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "doc"))
    ideal = grades.withColumn("best", best).groupBy("query").agg(*ideal_aggs)
    both = rows.groupBy("query").agg(*aggs).join(ideal, "query", "left")
    ratio = lambda a, b: F.when(F.coalesce(b, F.lit(0)) > 0, a / b).otherwise(0.0)
    out = ["query"]
    for k in ks:
        out += [ratio(F.col(f"hits{k}"), F.col(f"n{k}")).alias(f"p{k}"), ratio(F.col(f"hits{k}"), F.col("all")).alias(f"r{k}"), ratio(F.col(f"dcg{k}"), F.col(f"ideal{k}")).alias(f"ndcg{k}")]
    return both.select(*out, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def macro(metrics: DataFrame, by: str = "query") -> DataFrame:
    """Unweighted means over queries."""
    return metrics.agg(*(F.avg(c).alias(c) for c in metrics.columns if c != by))


def nearest_rank(rows: DataFrame, group: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles: the least value that at least that share of the rows doesn't exceed."""
    return rows.groupBy(*group).agg(*(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").alias(f"p{p}") for p in percents))


def sample_statistics(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median, deviation, extremes and share of the total of each group."""
    v = F.col(value)
    by = rows.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.sum(v).alias("total"))
    whole = by.agg(F.sum("total").alias("all"))
    return by.crossJoin(F.broadcast(whole)).withColumn("share", F.col("total") / F.col("all")).drop("all")


def own_ranks(ranked: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """(query, doc, place, hit): where each query's own document stands in its list, null where it does not, and whether it is among the first k.

    ranked: (query, doc, place), own: (query, doc), both one row a pair."""
    there = own.select("query", "doc").join(ranked.select("query", "doc", "place"), ["query", "doc"], "left")
    return there.withColumn("hit", F.coalesce(F.col("place") <= k, F.lit(False)))


def culture_fit(similarities: Column) -> Column:
    """100 times the mean of the similarities of references (null ones count as 0); 70 without any."""
    each = F.transform(similarities, lambda s: F.coalesce(s, F.lit(0.0)).cast("double"))
    return F.when(F.size(similarities) > 0, F.aggregate(each, F.lit(0.0), lambda a, b: a + b) / F.size(similarities) * 100).otherwise(70.0)
