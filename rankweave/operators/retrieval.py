"""Lexical and dense retrieval and their fusion, for all queries over all documents at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rankweave.functions import numbers, text
from rankweave.sources.tables import kept, spread

K1, B = 1.5, 0.75
#: (query, term) weights and query vectors that are broadcast at once; further queries are taken in further blocks.
BLOCK_TERMS, BLOCK_VECTORS = 200_000, 10_000
#: Cells of a (documents x queries) score matrix, and rows of best hits, that a task holds.
CELLS, HELD = 1 << 20, 1 << 18
PLACES = 6


def _codes(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of ids."""
    values = np.asarray(ids)
    return values if values.dtype != object else np.unique(values.astype(str), return_inverse=True)[1]


class Best:
    """The k rows of the least value of each query, ties by id, over all that a task has seen."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, query: np.ndarray, value: np.ndarray, doc: pa.Array) -> None:
        order = np.lexsort((_codes(doc), value, query))
        q = query[order]
        first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        place = np.arange(len(q)) - np.repeat(starts, np.diff([*starts, len(q)]))
        keep = order[place < self.k]
        self.parts.append((query[keep], value[keep], doc.take(pa.array(keep))))
        self.size += len(keep)
        if self.size > HELD and len(self.parts) > 1:
            parts, self.parts, self.size = self.parts, [], 0
            self.add(*_joined(parts))

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        if not self.parts:
            return None
        parts, self.parts, self.size = self.parts, [], 0
        self.add(*_joined(parts))
        return self.parts[0]


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), pa.concat_arrays([p[2] for p in parts])


#: Bytes of text that a task splits into words at once, and (document, query) products that it adds up at once.
TEXT_STEP, ENTRIES = 8 << 20, 1 << 21
_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_+#.", np.uint8))


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of words of each text, all words) of lower-cased texts without nulls: ``text.tokens``, found by the texts' bytes."""
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = _WORD[whole]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    border = at[(at > 0) & (at < len(whole))]
    opens[border] = inside[border]
    closes[border - 1] = inside[border - 1]
    first = np.flatnonzero(opens)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(closes) + 1 - first)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(whole[inside]))])
    return np.diff(np.searchsorted(first, at)), words


_COUNTED = [("length", T.IntegerType()), ("terms", T.ArrayType(T.IntegerType())), ("times", T.ArrayType(T.IntegerType()))]


def _counted(batch: pa.RecordBatch, vocabulary: pa.Array) -> Iterator[pa.RecordBatch]:
    """(doc, length, terms, times): how many words each text of (doc, text) has, and how often which words of the vocabulary, by their numbers."""
    texts = batch.column(1)
    sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    done = 0
    while done < batch.num_rows:
        stop = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + TEXT_STEP, "right")))
        lengths, words = _words(texts.slice(done, stop - done))
        found = pc.index_in(words, vocabulary)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        key = np.repeat(np.arange(len(lengths)), lengths)[known] * len(vocabulary) + found.drop_null().to_numpy()
        key, times = np.unique(key, return_counts=True)
        ends = np.searchsorted(key, np.arange(len(lengths) + 1) * len(vocabulary)).astype(np.int32)
        listed = lambda x, ends=ends: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, stop - done), pa.array(lengths.astype(np.int32)), listed(key % max(len(vocabulary), 1)), listed(times)], names=["doc", *(n for n, _ in _COUNTED)])
        done = stop


class _Weights:
    """The queries' term weights: a row of queries for each term of a vocabulary."""

    def __init__(self, rows: list, vocabulary: list[str], idf: np.ndarray):
        self.queries = sorted({r["query"] for r in rows})
        number, of = {q: i for i, q in enumerate(self.queries)}, {t: i for i, t in enumerate(vocabulary)}
        at = np.array([of[r["term"]] for r in rows], np.int64)
        order = np.argsort(at, kind="stable")
        self.starts = np.searchsorted(at[order], np.arange(len(vocabulary) + 1))
        self.query = np.array([number[r["query"]] for r in rows], np.int64)[order]
        self.weight = (np.array([r["times"] for r in rows], float) * idf[at])[order]

    def scores(self, rows: pa.RecordBatch, mean: float) -> np.ndarray:
        """(documents x queries) BM25 scores of rows of ``_counted``."""
        lengths, terms, tf = np.asarray(rows.column(1)), rows.column(2).flatten().to_numpy(), rows.column(3).flatten().to_numpy()
        ends = rows.column(2).offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        doc = np.repeat(np.arange(len(lengths)), np.diff(ends))
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
        size = self.starts[terms + 1] - self.starts[terms]
        made = np.zeros((len(lengths), len(self.queries)))
        upto, done = np.concatenate([[0], np.cumsum(size)])[ends], 0
        while done < len(lengths):
            stop = max(done + 1, int(np.searchsorted(upto, upto[done] + ENTRIES, "right")) - 1)
            own = slice(ends[done], ends[stop])
            n = size[own]
            entry = np.arange(upto[stop] - upto[done]) + np.repeat(self.starts[terms[own]] - (np.cumsum(n) - n), n)
            cell = np.repeat((doc[own] - done) * len(self.queries), n) + self.query[entry]
            made[done:stop] = np.bincount(cell, weights=np.repeat(part[own], n) * self.weight[entry], minlength=(stop - done) * len(self.queries)).reshape(stop - done, -1)
            done = stop
        return made


def _bm25_blocks(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text_col: str) -> Iterator[tuple[DataFrame, _Weights, float]]:
    """Blocks of at most about BLOCK_TERMS query weights, each with the documents' counts of its terms and their mean length.

    The texts are split into words once a block, in the tasks; what is kept of a document is how often it has which of the block's terms.
    """
    terms = queries.select(F.col(query_id).alias("query"), F.explode(text.query_tokens(F.col(text_col))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    texts = spread(docs.select(F.col(doc_id).alias("doc"), F.col(text_col))).select("doc", F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    schema = T.StructType([T.StructField("doc", docs.schema[doc_id].dataType), *(T.StructField(*c) for c in _COUNTED)])
    blocks = -(-terms.count() // BLOCK_TERMS)
    for k in range(blocks):
        rows = (terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k)).collect()
        if not rows:
            continue
        vocabulary = sorted({r["term"] for r in rows})
        shared = docs.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()))

        def count(batches, shared=shared):
            for batch in batches:
                yield from _counted(batch, shared.value)

        counted = kept(texts.mapInArrow(count, schema), "terms")

        def add(batches, width=len(vocabulary)):
            df, n, total = np.zeros(width, np.int64), 0, 0
            for batch in batches:
                df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=width)
                n, total = n + batch.num_rows, total + int(np.asarray(batch.column(0)).sum(dtype=np.int64))
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([df[some], [n, total]]))], names=["term", "n"])

        made = {r["term"]: r["n"] for r in counted.select("length", "terms").mapInArrow(add, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, mean = made.get(-1, 0), made.get(-2, 0) / max(made.get(-1, 0), 1) or 1.0
        if any(t >= 0 for t in made):
            idf = np.array([math.log((n - made.get(t, 0) + 0.5) / (made.get(t, 0) + 0.5) + 1) for t in range(len(vocabulary))])
            yield counted, _Weights(rows, vocabulary, idf), mean


def _leading(score: np.ndarray, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which cells may be among the k best of their column, the columns' new bars): a bar is the k-th best of some rows seen, ties stay."""
    if len(score) >= k:
        bar = np.maximum(bar, np.partition(score, len(score) - k, axis=0)[len(score) - k])
    return (score > 0) & (score >= bar), bar


def bm25_top(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, k: int, text_col: str = "text") -> DataFrame:
    """(query, doc, score): the k best documents of each query, among those that share a term, equal scores by doc.

    A task scores its documents against all queries as one sparse product and keeps k a query, so that what is shuffled follows the
    number of tasks, not that of (query, document) pairs. Scores are rounded to PLACES.
    """
    schema = T.StructType([T.StructField("query", queries.schema[query_id].dataType), T.StructField("doc", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])
    out = None
    for counted, made, mean in _bm25_blocks(docs, queries, doc_id, query_id, text_col):
        shared = docs.sparkSession.sparkContext.broadcast(made)

        def run(batches, shared=shared, mean=mean):
            own, best, names = shared.value, Best(k), None
            step, bar = max(1, CELLS // max(len(own.queries), 1)), np.zeros(len(own.queries))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    score = np.round(own.scores(part, mean), PLACES)
                    keep, bar = _leading(score, k, bar)
                    doc, query = np.nonzero(keep)
                    best.add(query, -score[doc, query], part.column(0).take(pa.array(doc)))
                    names = part.column(0).type
            rows = best.rows() if names is not None else None
            if rows:
                query, value, doc = rows
                yield pa.RecordBatch.from_arrays([pa.array([own.queries[i] for i in query], to_arrow_type(schema["query"].dataType)), doc, pa.array(-value)], names=["query", "doc", "score"])

        found = top(counted.mapInArrow(run, schema), k).select("query", "doc", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def bm25_summary(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text_col: str = "text") -> DataFrame:
    """(query, docs, best, total): how many documents share a term with each query, the best score and the sum, added up in the tasks."""
    schema = T.StructType([T.StructField("query", queries.schema[query_id].dataType), T.StructField("docs", T.LongType()), T.StructField("best", T.DoubleType()), T.StructField("total", T.DoubleType())])
    out = None
    for counted, made, mean in _bm25_blocks(docs, queries, doc_id, query_id, text_col):
        shared = docs.sparkSession.sparkContext.broadcast(made)

        def run(batches, shared=shared, mean=mean):
            own = shared.value
            step = max(1, CELLS // max(len(own.queries), 1))
            n, best, total = np.zeros(len(own.queries), np.int64), np.zeros(len(own.queries)), np.zeros(len(own.queries))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    score = np.round(own.scores(batch.slice(at, step), mean), PLACES)
                    n += (score > 0).sum(0)
                    best = np.maximum(best, score.max(0, initial=0))
                    total += score.sum(0)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([own.queries[i] for i in some], to_arrow_type(schema["query"].dataType)), pa.array(n[some]), pa.array(best[some]), pa.array(total[some])], names=schema.names)

        found = counted.mapInArrow(run, schema).groupBy("query").agg(F.sum("docs").alias("docs"), F.max("best").alias("best"), F.sum("total").alias("total"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def top(scored: DataFrame, k: int, by: str = "query", score: str = "score", tie: str = "doc", descending: bool = True) -> DataFrame:
    """The k best rows of each query with their ordinal and competition ranks; equal scores go by the tie column."""
    w = Window.partitionBy(by).orderBy(F.desc(score) if descending else F.asc(score))
    ordinal = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score) if descending else F.asc(score), tie))
    return scored.withColumn("place", ordinal).where(F.col("place") <= k).withColumn("rank", F.rank().over(w))


def dense_top(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, k: int, vector: str = "embedding", below: float | None = None, label: str | None = None) -> DataFrame:
    """(query, doc, distance): the k nearest usable vectors of each query of a stated set, itself excepted, equal distances by doc.

    Queries go out in blocks of at most BLOCK_VECTORS; a task takes the distances of its vectors to a block as one matrix product and
    keeps k a query. ``below``: only distances under it; ``label``: only vectors whose label equals the query's and is not null.
    Distances are rounded to PLACES; vectors of different lengths are not compared.
    """
    side = lambda df, key: df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(label) if label else F.lit(0)).alias("l")).where(numbers.usable(F.col("v")) & F.col("l").isNotNull())
    q, d = side(queries, query_id), side(docs, doc_id)
    blocks = -(-q.count() // BLOCK_VECTORS)
    schema = T.StructType([T.StructField("query", queries.schema[query_id].dataType), T.StructField("doc", docs.schema[doc_id].dataType), T.StructField("distance", T.DoubleType())])
    out = None
    for b in range(blocks):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).collect()
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(len(r["v"]), []).append(r)
        made = {n: ([r["id"] for r in g], _units(np.array([r["v"] for r in g], float)), np.array([r["l"] for r in g])) for n, g in by.items()}
        shared = docs.sparkSession.sparkContext.broadcast(made)

        def run(batches, shared=shared):
            ids, best, number = [i for n in sorted(shared.value) for i in shared.value[n][0]], Best(k), {}
            for n in sorted(shared.value):
                number[n] = sum(len(shared.value[m][0]) for m in shared.value if m < n)
            for batch in batches:
                vectors, labels = batch.column(1), np.asarray(batch.column(2))
                sizes = np.diff(vectors.offsets.to_numpy())
                for n, (own, units, asked) in shared.value.items():
                    rows = np.flatnonzero(sizes == n)
                    step = max(1, CELLS // len(own))
                    for at in range(0, len(rows), step):
                        part = rows[at : at + step]
                        here = batch.column(0).take(pa.array(part))
                        x = _units(vectors.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n))
                        far = np.round(1 - x @ units.T, PLACES)
                        keep = (labels[part][:, None] == asked[None]) & (np.asarray(here)[:, None] != np.asarray(own)[None])
                        if below is not None:
                            keep &= far < below
                        doc, query = np.nonzero(keep)
                        best.add(query + number[n], far[doc, query], here.take(pa.array(doc)))
            rows = best.rows()
            if rows:
                query, value, doc = rows
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in query], to_arrow_type(schema["query"].dataType)), doc, pa.array(value)], names=["query", "doc", "distance"])

        found = top(d.mapInArrow(run, schema), k, score="distance", descending=False).select("query", "doc", "distance")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fuse(rankings: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """(query, doc, raw, norm, place): reciprocal rank fusion of lists of (query, doc, rank); equal ranks weigh alike."""
    weights = weights or [1.0] * len(rankings)
    parts = [r.select("query", "doc", (F.lit(w) / (numbers.RRF_K + F.col("rank"))).alias("part")) for r, w in zip(rankings, weights, strict=True)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    fused = whole.groupBy("query", "doc").agg(F.round(F.sum("part"), 12).alias("raw"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("raw"), "doc"))
    return fused.select("query", "doc", "raw", numbers.rrf_normalized(F.col("raw"), len(rankings)).alias("norm"), place.alias("place"))


def _finite(distance: Column) -> Column:
    return F.coalesce(distance.isNotNull() & ~F.isnan(distance) & (F.abs(distance) < float("inf")), F.lit(False))


def _fused(rows: DataFrame) -> DataFrame:
    """rows with raw, the fused reciprocal ranks of their distances and BM25 scores by query; 0 where a row is in neither list."""
    w, k, finite = Window.partitionBy("query"), numbers.RRF_K, _finite(F.col("distance"))
    r1 = F.rank().over(w.orderBy(F.when(finite, F.col("distance")).asc_nulls_last()))
    r2 = F.rank().over(w.orderBy(F.when(F.col("bm25") > 0, F.col("bm25")).desc_nulls_last()))
    raw = F.when(finite, 1.0 / (k + F.col("_r1"))).otherwise(0.0) + F.when(F.col("bm25") > 0, 1.0 / (k + F.col("_r2"))).otherwise(0.0)
    semantic = F.when(finite, numbers.semantic_score(F.col("distance"))).otherwise(0.0)
    return rows.withColumns({"_r1": r1, "_r2": r2}).withColumns({"raw": F.round(raw, 12), "semantic": semantic}).drop("_r1", "_r2")


_NONE = "array<string>"


def score_candidates(rows: DataFrame) -> DataFrame:
    """The composite ranking of rows (query, doc, distance, bm25, wanted, owned, verified, must, excluded, confirmed, evidence).

    Dense and lexical lists are ranked and fused, rows in neither list go (so do distances that are not finite), skill gaps are
    penalised, and rows are grouped by their constraints' status where the query's are confirmed, else ordered by raw score, soft
    bonus and id. Coverage is that of the verified skills, or of the owned ones where no skill is verified.
    """
    none = F.array().cast(_NONE)
    verified, owned = F.coalesce("verified", none), F.coalesce("owned", none)
    owned = F.when(F.size(owned) > 0, owned).otherwise(verified)
    shown = F.when(F.size(verified) > 0, verified).otherwise(owned)
    out = _fused(rows).where("raw > 0").withColumns({
        "coverage": numbers.coverage(F.col("wanted"), shown), "soft": F.round(F.size(F.array_intersect(verified, "wanted")) * numbers.SOFT_STEP, 6),
        "status": numbers.constraint_status(F.col("confirmed"), F.col("evidence"), F.col("excluded"), F.col("must"), verified),
    })
    out = out.withColumn("score", numbers.skill_penalty(numbers.rrf_normalized(F.col("raw")), F.col("wanted"), owned, F.col("coverage")))
    group = F.when(F.col("confirmed"), numbers.partition_rank(F.col("status"))).otherwise(0)
    soft = F.when(F.col("confirmed"), 0.0).otherwise(F.col("soft"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(group, F.desc("raw"), soft.desc(), "doc"))
    return out.select("query", "doc", "raw", "coverage", "semantic", "soft", "status", "score", place.alias("place"))


def score_jobs(rows: DataFrame) -> DataFrame:
    """The reverse ranking of jobs for a profile: rows (query, doc, distance, bm25, skills, cv_skills, cv_verified, cv_evidence, must, excluded, confirmed).

    Coverage divides by the job's own skills; constraints and their confirmation are the job's, the evidence the profile's. A keyword
    score of 1 or more is not penalised. A query none of whose rows is in a list keeps them all, in the order of doc, with falling scores.
    """
    none = F.array().cast(_NONE)
    skills, own, verified = (F.coalesce(c, none) for c in ("skills", "cv_skills", "cv_verified"))
    w = Window.partitionBy("query")
    out = _fused(rows).withColumns({"_any": F.max("raw").over(w) > 0, "_n": F.row_number().over(w.orderBy("doc"))}).where("raw > 0 or not _any")
    cover = numbers.coverage(skills, own)
    norm = numbers.rrf_normalized(F.col("raw"))
    low, mid = F.least(norm * 0.1, F.lit(0.08)), F.least(norm * 0.2, F.lit(0.15))
    penalised = (
        F.when(F.col("bm25") >= 1.0, norm).when((F.size(own) == 0) & (F.size(verified) == 0) & ~F.col("cv_evidence"), low)
        .when((F.size(skills) > 0) & (F.size(own) == 0), low).when((F.size(skills) > 0) & (cover == 0), mid).otherwise(norm)
    )
    status = numbers.constraint_status(F.col("confirmed"), F.col("cv_evidence"), F.col("excluded"), F.col("must"), verified)
    out = out.withColumns({
        "coverage": cover, "soft": F.round(F.size(F.array_intersect(verified, skills)) * numbers.SOFT_STEP, 6), "status": status,
        "score": F.when(F.col("_any"), penalised).otherwise(F.greatest(0.5 - F.col("_n") * 0.02, F.lit(0.1))),
        "raw": F.when(F.col("_any"), F.col("raw")).otherwise(F.round(1.0 / (numbers.RRF_K + F.col("_n")), 12)),
    })
    place = F.row_number().over(w.orderBy(numbers.partition_rank(F.col("status")), F.desc("raw"), "doc"))
    return out.select("query", "doc", "raw", "coverage", "semantic", "soft", "status", "score", place.alias("place"))


def calibrated(score, wanted, owned, coverage, rescale: bool = False):
    """A model's score after rescaling and skill penalties, rounded half even to four digits."""
    s = numbers.semantic_score(1 - score) if rescale else score
    return F.bround(numbers.skill_penalty(s, wanted, owned, coverage), 4)


def rerank(rows: DataFrame, window: int = 50) -> DataFrame:
    """Rows (query, doc, place, status, model_score) reordered within their status group by the model's score; rows past the window,
    and those without a score, keep their order behind."""
    w = Window.partitionBy("query")
    rank = numbers.status_rank(F.col("status"))
    chosen = F.row_number().over(w.orderBy(rank, "place")) <= window
    out = rows.withColumn("in_window", chosen & F.col("model_score").isNotNull())
    place = F.row_number().over(w.orderBy(F.desc("in_window"), rank, F.when(F.col("in_window"), -F.col("model_score")), "place", "doc"))
    return out.withColumn("new_place", place)


#: Words of a request that say nothing about a job, and the points of the parts that hold another word.
REQUEST_STOPWORDS = "tìm việc làm các những hiện có cho tại ở công và hoặc là thì".split()
BOOSTS = {"title": 2.0, "skills": 1.5, "company": 1.2, "body": 1.0, "location": 0.5}


def request_words(request: Column) -> Column:
    """The words of a request that count: lower case, without outer punctuation, of two letters or more."""
    bare = F.transform(F.split(F.lower(request), r"\s+"), lambda w: F.btrim(w, F.lit("#,?.!:;()[]\"'")))
    return F.filter(bare, lambda w: (F.length(w) > 1) & ~w.isin(REQUEST_STOPWORDS))


def keyword_boost(request: Column, parts: dict[str, Column], direct: Column, near: Callable[[Column, Column], Column] | None = None) -> Column:
    """Points for a request: 5 for its `#number` in the title or id, twice its direct BM25 score, and each word's points for every part that has it.

    parts: title, skills, company, body, location and id. Words match whole words, or, of four letters and more, ``near`` ones if that
    test (word, words) is given.
    """
    tokens = {k: F.regexp_extract_all(F.lower(F.coalesce(parts[k], F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)) for k in BOOSTS}
    has = lambda w, ts: F.array_contains(ts, w) | (((F.length(w) >= 4) & near(w, ts)) if near else F.lit(False))
    points = lambda w: sum((F.when(has(w, tokens[k]), p).otherwise(0.0) for k, p in BOOSTS.items()), F.lit(0.0))
    words = F.aggregate(request_words(request), F.lit(0.0), lambda total, w: total + points(w))
    number = F.regexp_extract(F.lower(request), r"#([0-9]+)", 1)
    tag = F.concat(F.lit("#"), number)
    exact = F.when((number != "") & (F.contains(F.lower(parts["title"]), tag) | F.contains(parts["id"], tag)), 5.0).otherwise(0.0)
    return exact + F.coalesce(direct, F.lit(0.0)) * 2.0 + words


def boosted(bm25: Column, boost: Column) -> Column:
    """A BM25 score with a boost, from 0.5 where the score is none."""
    return F.when(boost > 0, F.when(bm25 > 0, bm25).otherwise(0.5) + boost).otherwise(bm25)
