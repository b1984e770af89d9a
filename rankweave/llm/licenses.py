"""License scans by MinHash bands over overlapping text windows, with DataFrame functions only.

Templates and texts are words of a-z and 0-9; their shingles are five words. A template of up to WINDOW shingles is one window,
a longer one is all windows of WINDOW shingles. A text's windows of a template window's size start at every shingle.
A band is one MinHash value: windows of similarity s share one of BANDS bands with probability 1 - (1 - s) ** BANDS, which is
0.99994 at 0.8. A band's value stands for the one shingle that gave it, so only text windows around a shingle that is a
template window's least can collide, and only those are made. What collides is verified by the exact share of the
template window's shingles that the text has there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import split_join, stored

WORDS, WINDOW, BANDS, LEAST_SHARE = 5, 20, 6, 0.8
#: Template windows that may be literals of the plan; of a larger set the bands are joined by hash.
MOST_LITERALS = 256

#: Well-known license notices by SPDX-style name.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def _shingled(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds the 64-bit hashes of all runs of five words; none for a text of fewer, or null."""
    words = df.withColumn("_words", F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))
    hashes = F.transform(F.sequence(F.lit(0), F.size("_words") - WORDS), lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WORDS))))
    return words.withColumn(into, F.when(F.size("_words") >= WORDS, hashes).otherwise(F.array().cast("array<bigint>"))).drop("_words")


def order(shingle: Column, band: int) -> Column:
    """The band's permutation of shingles."""
    return F.xxhash64(shingle, F.lit(band))


def least(window: Column, band: int) -> Column:
    """The shingle of a window that comes first in the band's permutation."""
    return F.array_min(F.transform(window, lambda x: F.struct(order(x, band).alias("o"), x.alias("x"))))["x"]


def template_windows(spark, templates: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(name, w, mins): a template window's shingles and the least shingle of each band; templates is a list or table of (name, text)."""
    given = templates if isinstance(templates, DataFrame) else spark.createDataFrame(templates, "name string, text string")
    df = _shingled(given.select("name", "text"), "text", "sh").where(F.size("sh") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("sh") - WINDOW + 1))
    cut = df.select("name", F.explode(F.transform(starts, lambda i: F.slice("sh", i, WINDOW))).alias("w"))
    return cut.select("name", "w", F.array(*(least(F.col("w"), k) for k in range(BANDS))).alias("mins")).distinct()


def _longs(values) -> Column:
    return F.lit([int(v) for v in values]) if len(values) else F.array().cast("array<bigint>")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame = TEMPLATES, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds licenses to every row: an array of (name, at, share), a template's name, the number of the first word (from 0) of the
    window that holds most of it, and the share of the template window's shingles found there, at least LEAST_SHARE.

    One entry a name and row: that of the greatest share, then the first. Null, empty and short texts have none, nor has any row if
    there is no template. Rows stay as they are, repeated ones too; a column named licenses is replaced. Up to MOST_LITERALS template
    windows are part of the plan, and nothing is shuffled; more are a table that the texts' shingles are joined with.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c != "licenses"]
    empty = F.array().cast("array<struct<name:string,at:int,share:double>>")
    made = template_windows(docs.sparkSession, templates)
    windows = made.limit(MOST_LITERALS + 1).collect()
    if not windows:
        return docs.select(*carry, empty.alias("licenses"))
    if len(windows) > MOST_LITERALS:
        return _joined(docs, made, text_col, carry, empty)
    known = F.array(*(F.struct(F.lit(w["name"]).alias("name"), _longs(w["w"]).alias("w"), _longs(w["mins"]).alias("mins")) for w in windows))
    leasts = _longs(sorted({m for w in windows for m in w["mins"]}))

    df = _shingled(docs.select(*carry, F.col(text_col).alias("_text")), "_text", "_sh").drop("_text")
    df = df.withColumn("_near", F.arrays_overlap("_sh", leasts))

    def collisions(x: Column, i: Column) -> Column:
        """Candidates (window, start) of the template windows that have shingle x, number i of the text, as a band's least."""
        def around(t: Column) -> Column:
            s = F.size(t["w"])
            starts = F.sequence(F.greatest(F.lit(0), i - s + 1), i)
            same = lambda a: F.exists(
                F.sequence(F.lit(0), F.lit(BANDS - 1)),
                lambda k: (F.get(t["mins"], k) == x) & F.forall(F.slice("_sh", a + 1, s), lambda y: (y == x) | (F.xxhash64(y, k) > F.xxhash64(x, k))),
            )
            return F.transform(F.filter(starts, same), lambda a: F.struct(t["name"].alias("name"), t["w"].alias("w"), a.alias("at")))
        return F.flatten(F.transform(F.filter(known, lambda t: F.array_contains(t["mins"], x)), around))

    numbered = F.filter(F.transform("_sh", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: F.array_contains(leasts, p["x"]))
    found = F.flatten(F.transform(numbered, lambda p: collisions(p["x"], p["i"])))
    share = lambda c: F.size(F.array_intersect(c["w"], F.slice("_sh", c["at"] + 1, F.size(c["w"])))) / F.size(F.array_distinct(c["w"]))
    verified = F.filter(F.transform(found, lambda c: F.struct(c["name"].alias("name"), c["at"].alias("at"), share(c).alias("share"))), lambda c: c["share"] >= LEAST_SHARE)
    df = df.withColumn("_all", F.when(F.col("_near"), verified).otherwise(empty))
    names = F.array_sort(F.array_distinct(F.transform("_all", lambda c: c["name"])))
    best = F.transform(names, lambda n: F.array_max(F.transform(F.filter("_all", lambda c: c["name"] == n), lambda c: F.struct(c["share"].alias("share"), (-c["at"]).alias("before")))))
    out = F.transform(F.arrays_zip(names.alias("n"), best.alias("b")), lambda z: F.struct(z["n"].alias("name"), (-z["b"]["before"]).alias("at"), z["b"]["share"].alias("share")))
    # The generator keeps a later filter on licenses from being pushed below, where it would repeat all of the above.
    return df.select(*carry, F.explode(F.array(out)).alias("licenses"))


def _joined(docs: DataFrame, windows: DataFrame, text_col: str, carry: list[str], empty: Column) -> DataFrame:
    """scan with any number of template windows: shingles that are some window's least are joined with the windows by their hash, and
    what collides is verified on the text's own shingles. Texts are keyed by 128 bits of hash, equal ones once."""
    windows = stored(windows.withColumn("id", F.xxhash64("name", "w")), "license-windows")
    keyed = docs.withColumns({"_k1": F.xxhash64(text_col), "_k2": F.xxhash64(text_col, F.lit(5))})
    texts = _shingled(keyed.select("_k1", "_k2", F.col(text_col).alias("_text")).dropDuplicates(["_k1", "_k2"]), "_text", "_sh").drop("_text").where(F.size("_sh") > 0)
    leasts = windows.select(F.explode(F.array_distinct("mins")).alias("x"), "id").groupBy("x").agg(F.collect_set("id").alias("ids"))
    places = texts.select("_k1", "_k2", F.posexplode("_sh").alias("i", "x"))
    hits = split_join(places, leasts, ["x"]).select("_k1", "_k2", "i", "x", F.explode("ids").alias("id"))
    named = split_join(hits, windows, ["id"]).select("_k1", "_k2", "i", "x", "name", "w", "mins")
    met = named.join(texts, ["_k1", "_k2"])
    size = F.size("w")
    same = lambda a: F.exists(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda k: (F.get("mins", k) == F.col("x")) & F.forall(F.slice("_sh", a + 1, size), lambda y: (y == F.col("x")) | (F.xxhash64(y, k) > F.xxhash64("x", k))),
    )
    starts = F.filter(F.sequence(F.greatest(F.lit(0), F.col("i") - size + 1), F.col("i")), same)
    found = met.select("_k1", "_k2", "name", "w", "_sh", F.explode(starts).alias("at"))
    share = F.size(F.array_intersect("w", F.slice("_sh", F.col("at") + 1, size))) / F.size(F.array_distinct("w"))
    verified = found.select("_k1", "_k2", "name", "at", share.alias("share")).where(F.col("share") >= LEAST_SHARE)
    best = verified.groupBy("_k1", "_k2", "name").agg(F.max(F.struct("share", (-F.col("at")).alias("before"))).alias("b"))
    each = F.array_sort(F.collect_list(F.struct("name", (-F.col("b.before")).alias("at"), F.col("b.share").alias("share"))))
    of_text = best.groupBy("_k1", "_k2").agg(each.alias("_found"))
    return keyed.join(of_text, ["_k1", "_k2"], "left").select(*carry, F.coalesce("_found", empty).alias("licenses"))
