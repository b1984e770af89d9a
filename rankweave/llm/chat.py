"""Chat formatting over a prefix tree.

Conversations that share their first turns share those turns' tokens: the tree of all conversations is written depth-first as
runs, each the turns that one conversation adds below its branching point. A run has its place in the tree's packed sequence,
the position of its first token in a conversation, and the intervals of the packed sequence that it attends to besides itself
(its ancestors). Tokens are code points of the formatted text here; any tokenizer that splits at turn marks keeps the intervals' shape.

No tree is gathered in one task: depth-first order is the lexicographic order of the conversations' paths, which a range-partitioned
sort gives, and places are running sums within partitions plus the partitions' totals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import dropped, split_join, stored

#: The template's marks, and what stands for its control characters inside a text or a role. A turn is
#: OPEN role MIDDLE text CLOSE; every mark has a character that an escaped text cannot have.
OPEN, MIDDLE, CLOSE = "<s>[", "]\n", "</s>\n"
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("[", "\\o"), ("]", "\\c"), ("\n", "\\n")]
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ESCAPES, text)


def unescaped(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), reversed(ESCAPES), text)


def turns(rows: DataFrame) -> DataFrame:
    """Numbered turns with their segment of formatted text and the key of the path that ends in them.

    A key is 128 bits: the running exclusive-or of the hashes of (number, role, text), so equal keys are equal beginnings.
    """
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE))
    body = escaped(F.col("text"))
    made = clean.withColumn("pos", F.row_number().over(w)).select("conv_id", "pos", "role", head.alias("head"), body.alias("body"), F.xxhash64("pos", "role", "text").alias("h1"), F.xxhash64("text", F.lit(7), "role", "pos").alias("h2"))
    made = made.withColumn("segment", F.concat("head", "body", F.lit(CLOSE)))
    size = F.length("segment")
    return made.select(
        "conv_id", "pos", "segment", size.alias("size"), (F.sum(size).over(so_far) - size).alias("start"),
        F.bit_xor("h1").over(so_far).alias("k1"), F.bit_xor("h2").over(so_far).alias("k2"),
        F.when(F.col("role") == LOSS_ROLE, F.struct(F.length("head").alias("skip"), F.length("body").alias("n"))).alias("loss"),
    )


def pack(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, paths) of the conversations in rows (conv_id, turn, role, text).

    runs: run (its number, in depth-first order), tree, offset (its place in the tree's packed sequence), size, text,
    position_start (positions count on from there), attends (ancestors' intervals [start, end) of the packed sequence) and
    loss (intervals [start, end) of the run's own text under the loss mask: what assistants said, still escaped).
    ends: where each of the run's turns ends in its text. paths: conv_id and path, the (run, size of the part of it, turns in that part)
    triples that make the conversation up.

    Rows are ordered by turn (null first), then role, then text; null roles and texts count as empty; null conv_ids are one
    conversation; repeated rows are repeated turns. Other columns are left out. An empty table gives no runs and no paths.
    """
    of = stored(turns(rows), "turns")
    convs = of.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k1", "k2"))), lambda x: F.struct(x["k1"], x["k2"])).alias("keys"))
    ranked = stored(convs.orderBy("keys", "conv_id").select("conv_id", F.monotonically_increasing_id().alias("rank"), F.col("keys")[0].alias("tree")), "ranked")
    on = stored(of.join(ranked.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id"), "on")
    dropped(of)
    dropped(ranked)
    owner = on.select("k1", "k2", "rank").groupBy("k1", "k2").agg(F.min("rank").alias("run"))
    placed = stored(split_join(on, owner, ["k1", "k2"]), "placed")
    dropped(on)

    own = placed.where("run = rank").withColumn("first", F.min("start").over(Window.partitionBy("run")))
    loss = F.when(F.col("loss").isNotNull(), F.struct((F.col("start") - F.col("first") + F.col("loss.skip")).alias("start"), (F.col("start") - F.col("first") + F.col("loss.skip") + F.col("loss.n")).alias("end")))
    runs = own.groupBy("run").agg(
        F.sum("size").alias("size"), F.min("start").alias("position_start"), F.first("tree").alias("tree"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "segment"))), lambda x: x["segment"]), "").alias("text"),
        F.array_sort(F.collect_list(loss)).alias("loss"), F.array_sort(F.collect_list((F.col("start") - F.col("first") + F.col("size")).alias("end"))).alias("ends"),
    )
    runs = stored(runs, "runs")
    part = F.shiftright("run", 33)
    totals = runs.groupBy(part.alias("part")).agg(F.sum("size").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))  # a row a partition
    inner = runs.select("run", "tree", "size", part.alias("part")).withColumn("inner", F.sum("size").over(Window.partitionBy("part").orderBy("run")) - F.col("size"))
    at = inner.join(F.broadcast(before), "part").select("run", "tree", (F.col("inner") + F.col("before")).alias("at"))
    place = at.join(at.groupBy("tree").agg(F.min("at").alias("tree_at")), "tree").select("run", (F.col("at") - F.col("tree_at")).alias("offset"))
    place = stored(place, "place")

    parts = stored(placed.groupBy("conv_id", "rank", "run").agg(F.sum("size").alias("n"), F.min("start").alias("start"), F.count("*").alias("turns")), "parts")
    dropped(placed)
    seen = split_join(parts.where("run <> rank").select("rank", "run", "n"), place, ["run"]).groupBy(F.col("rank").alias("run")).agg(F.array_sort(F.collect_list(F.struct(F.col("offset").alias("start"), (F.col("offset") + F.col("n")).alias("end")))).alias("attends"))
    packed = runs.join(place, "run").join(seen, "run", "left").withColumn("attends", F.coalesce("attends", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    paths = parts.groupBy("rank").agg(F.first("conv_id").alias("conv_id"), F.transform(F.array_sort(F.collect_list(F.struct("start", "run", "n", "turns"))), lambda x: F.struct(x["run"], x["n"], x["turns"])).alias("path"))
    return packed, paths.select("conv_id", "path")


def unpack(runs: DataFrame, paths: DataFrame) -> DataFrame:
    """Reads conversations back: conv_id, formatted text, turns (role, text) and learned (unescaped texts under the loss mask).

    Runs are cut into turns first, and a path's steps ask for the turns that they take: what is joined is each conversation's own text,
    whatever the length of the run that it branches from, and the turns that many share are dealt over tasks.
    """
    ends = runs.select("run", "text", "loss", F.posexplode("ends").alias("t", "end"), F.col("ends").alias("_ends"))
    begin = F.when(F.col("t") > 0, F.element_at("_ends", F.col("t"))).otherwise(0)
    masked = F.filter("loss", lambda m: (m["start"] >= begin) & (m["end"] <= F.col("end")))
    cut = lambda m: F.substring("text", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))
    said = ends.select("run", "t", F.substring("text", (begin + 1).cast("int"), (F.col("end") - begin).cast("int")).alias("part"), F.transform(masked, cut).alias("masked"))
    steps = paths.select("conv_id", F.posexplode("path").alias("k", "step")).select("conv_id", "k", "step.run", F.explode(F.sequence(F.lit(0), F.col("step.turns").cast("int") - 1)).alias("t"))
    got = split_join(steps, said, ["run", "t"])
    whole = got.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "t", "part", "masked"))).alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    whole = whole.select("conv_id", formatted.alias("formatted"), F.flatten(F.transform("parts", lambda p: p["masked"])).alias("masked"))
    marks = F.filter(F.split("formatted", CLOSE), lambda s: s != "")
    read = F.transform(marks, lambda s: F.struct(unescaped(F.substring_index(F.substring(s, F.lit(len(OPEN) + 1), F.length(s)), MIDDLE, 1)).alias("role"), unescaped(F.substring_index(s, MIDDLE, -1)).alias("text")))
    return whole.select("conv_id", "formatted", read.alias("turns"), F.transform("masked", unescaped).alias("learned"))
