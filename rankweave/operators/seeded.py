"""Seeded choices that depend on keys and a seed alone, so that any partitioning gives the same rows: permutations, samples, swapped skills, decoys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions import text, wording
from rankweave.functions.guardrails import let
from rankweave.operators import relational, skills

ROUNDS, WALK = 4, 64


def permuted(i: Column, n: Column, *seed: Column) -> Column:
    """The place of i (0 to n - 1) in a permutation of 0 to n - 1 that the seed names; null for other i.

    A Feistel network over pairs of numbers below a and b, a * b being n or less than a more, is a permutation of a * b; a value from n on is
    permuted again until it is below n. At most a values are beyond, so WALK steps always do up to n = WALK squared, and beyond with a chance of failure of b to the power of -WALK.
    """
    def keyed(a: Column, b: Column) -> Column:
        def step(x: Column) -> Column:
            left, right = F.floor(x / b), x % b
            for r in range(ROUNDS):
                if r % 2:
                    right = (right + F.pmod(F.xxhash64(left, F.lit(r), *seed), b)) % b
                else:
                    left = (left + F.pmod(F.xxhash64(right, F.lit(r), *seed), a)) % a
            return (left * b + right).cast("bigint")

        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(i.cast("bigint")), lambda x, _: F.when(x < n, x).otherwise(step(x)))

    a = F.ceil(F.sqrt(n)).cast("bigint")
    sides = F.struct(a.alias("a"), F.ceil(n / a).cast("bigint").alias("b"))
    return F.when((i >= 0) & (i < n), let(sides, lambda s: keyed(s["a"], s["b"])))


def sampled(items: Column, k: Column, *seed: Column) -> Column:
    """k of the items of an array in their order, without replacement."""
    return F.filter(items, lambda _, i: permuted(i, F.size(items), *seed) < k)


def swapped(said: Column, named: Column, pool: list[str], *seed: Column) -> Column:
    """A text in which about half of the skills it names (array of slugs) give way to others of the pool, each used once and none that the text names."""
    free = F.filter(F.array(*map(F.lit, pool)), lambda p: ~F.array_contains(named, p))

    def swap(free: Column) -> Column:
        chosen = F.filter(named, lambda s: F.pmod(F.xxhash64(s, F.lit("half"), *seed), F.lit(2)) == 0)
        pairs = F.transform(F.slice(chosen, 1, F.size(free)), lambda s, k: F.struct(s.alias("old"), F.get(free, permuted(k, F.size(free), *seed).cast("int")).alias("new")))
        quoted = lambda s: F.concat(F.lit(r"(?iu)\Q"), s, F.lit(r"\E"))
        spaced = lambda s: F.replace(s, F.lit("_"), F.lit(" "))
        return F.aggregate(pairs, said, lambda t, p: F.regexp_replace(F.regexp_replace(t, quoted(p["old"]), p["new"]), quoted(spaced(p["old"])), p["new"]))

    return F.when(F.size(named) > 0, let(free, swap)).otherwise(said)


def decoys(docs: DataFrame, doc_id: str, terms: DataFrame, n: int, pool: list[str], text_col: str = "text", seed: int = 0) -> DataFrame:
    """(id, text, sources): n made-up documents, each of half the lines of one document and half those of another, with some skills swapped.

    sources are the ids of the two, different ones if there are two. Which ones, which lines and which skills depend on the seed and on the documents' order
    by id alone. A document without a line gives none; a decoy of no text is a placeholder. docs: one row an id; null ids are left out; an empty table gives
    placeholders without sources.
    """
    spark = docs.sparkSession
    own = relational.numbered(docs.select(F.col(doc_id).alias("doc"), F.col(text_col).alias("_text")).where("doc is not null"), "doc")
    total = own.agg(F.count("*").alias("_total"))
    i, total_ = F.col("i"), F.col("_total")
    first = F.when(total_ > 0, F.pmod(F.xxhash64(i, F.lit(seed), F.lit("a")), total_))
    second = F.when(total_ > 1, F.pmod(F.col("a") + 1 + F.pmod(F.xxhash64(i, F.lit(seed), F.lit("b")), total_ - 1), total_)).otherwise(F.col("a"))
    wanted = spark.range(n).select(F.col("id").alias("i")).crossJoin(F.broadcast(total)).withColumn("a", first).withColumn("b", second)
    lines = lambda side: own.select(F.col("at").alias(side), F.col("doc").alias(f"{side}_doc"), wording.body_lines(F.coalesce("_text", F.lit(""))).alias(f"{side}_lines"))
    both = wanted.join(lines("a"), "a", "left").join(lines("b"), "b", "left")
    half = lambda side, round_: sampled(F.coalesce(f"{side}_lines", F.array().cast("array<string>")), round_(F.coalesce(F.size(f"{side}_lines"), F.lit(0)) / 2), i, F.lit(seed), F.lit(side))
    spliced = both.select("i", F.array_join(F.concat(half("a", F.ceil), half("b", F.floor)), "\n").alias("said"), F.when(F.col("a_doc").isNotNull(), F.array("a_doc", "b_doc")).alias("sources"))
    named = skills.found(spliced.select("i", text.matched(F.col("said")).alias("view")), "view", terms, ["i"]).groupBy("i").agg(F.sort_array(F.collect_set("slug")).alias("named"))
    made = spliced.join(named, "i", "left")
    said = swapped(F.col("said"), F.coalesce("named", F.array().cast("array<string>")), pool, i, F.lit(seed))
    name = F.concat(F.lit("decoy_"), F.lpad(i.cast("string"), F.greatest(F.lit(3), F.length(i.cast("string"))), F.lit("0")))
    kind = F.array().cast(f"array<{docs.schema[doc_id].dataType.simpleString()}>")
    return made.select(name.alias("id"), F.when(F.trim(said) == "", F.concat(name, F.lit(" placeholder"))).otherwise(said).alias("text"), F.coalesce("sources", kind).alias("sources"))
