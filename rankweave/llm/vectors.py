"""Embedding near-duplicates by product quantisation.

A coarse quantiser splits the unit vectors into inverted lists; each vector keeps the codes of its residual's subspaces and the
exact length of what the codes leave out. A query probes every list whose border is near enough, takes distances from
look-up tables (query residual against codewords), drops only what the left-out length proves to be too far, and computes the
exact cosine of the rest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import components, forest, map_batches, stored

THRESHOLD = 0.98
#: Bounds of the fit: sampled vectors, centres of the first and of a further level of the coarse quantiser, vectors a list is meant to hold,
#: subspaces and codewords of each. There are as many levels as the count asks for, so lists grow with it.
SAMPLE, FIRST_CENTRES, NEXT_CENTRES, LIST_SIZE, SUBSPACES, CODEWORDS = 16_384, 1024, 64, 1024, 8, 256
#: Vectors and queries that one task holds against each other; larger lists are split into so many blocks.
BLOCK = 2048
#: Probing allows for a neighbour's offset across a list's border of so many standard deviations, were its direction uniform.
BORDER_DEVIATIONS = 4.0


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of x; empty clusters are put on random points again."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (centres @ x.T * -2 + (centres**2).sum(1)[:, None]).argmin(0)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(centres))])
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of x to the centres."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)


class Index:
    """A coarse quantiser and codebooks for vectors of one dimension; without a sample one list, and codes that leave all out.

    The coarse quantiser has levels: each further one has centres for what the former ones leave of a vector, so that a list is a path of
    centres. A list's number is that path, its centre the path's sum.
    """

    def __init__(self, dim: int, sample: np.ndarray, total: int):
        self.dim, self.levels, rest, wanted = dim, [], sample, max(1, total // LIST_SIZE) if len(sample) else 1
        while wanted > 1:
            centres = kmeans(rest, int(min(wanted, NEXT_CENTRES if self.levels else FIRST_CENTRES)))
            self.levels.append((centres, np.sqrt(np.maximum(squared(centres, centres), 1e-12))))
            rest = rest - centres[squared(rest, centres).argmin(1)]
            wanted = -(-wanted // max(len(centres), 2))
        self.cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], CODEWORDS) for a, b in zip(self.cuts, self.cuts[1:], strict=False)] if len(sample) else None

    def centre(self, number: int) -> np.ndarray:
        """The centre of a list."""
        out = np.zeros(self.dim)
        for centres, _ in reversed(self.levels):
            number, at = divmod(number, len(centres))
            out += centres[at]
        return out

    def place(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's own list; and (rows, lists), the lists that it probes. A neighbour within reach lies beyond a border at most
        min(1, BORDER_DEVIATIONS / sqrt(dim)) of the reach away, at every level."""
        own, rest = np.zeros(len(x), np.int64), x
        rows, lists, left = np.arange(len(x)), np.zeros(len(x), np.int64), x
        allowed = 2 * reach * min(1.0, BORDER_DEVIATIONS / math.sqrt(self.dim))
        for centres, between in self.levels:
            near = squared(rest, centres).argmin(1)
            own, rest = own * len(centres) + near, rest - centres[near]
            d = squared(left, centres)
            best = d.argmin(1)
            path, c = np.nonzero(d - d[np.arange(len(left)), best][:, None] <= allowed * between[best] + 1e-9)
            rows, lists, left = rows[path], lists[path] * len(centres) + c, left[path] - centres[c]
        return own, rows, lists

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the lengths of what they leave out."""
        if self.books is None:
            return np.zeros((len(rest), 0), np.uint8), np.sqrt((rest**2).sum(1))
        codes = np.zeros((len(rest), len(self.books)), np.uint8)
        left = np.zeros(len(rest))
        for k, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            d = (rest[:, a:b] ** 2).sum(1)[:, None] - 2 * rest[:, a:b] @ book.T + (book**2).sum(1)
            codes[:, k] = d.argmin(1)
            left += ((rest[:, a:b] - book[codes[:, k]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def coded_distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries x vectors) distances of query residuals to the coded vectors, from look-up tables."""
        if self.books is None:
            return np.sqrt((rest**2).sum(1))[:, None] * np.ones(len(codes))
        total = np.zeros((len(rest), len(codes)))
        for k, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            lookup = (rest[:, a:b] ** 2).sum(1)[:, None] - 2 * rest[:, a:b] @ book.T + (book**2).sum(1)
            total += lookup[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0))


def fit(vectors: DataFrame, col: str = "embedding") -> dict[int, Index]:
    """An index for each dimension that a sample of SAMPLE vectors (least hashes) shows."""
    n = vectors.count()
    rows = [r[0] for r in vectors.select(col).orderBy(F.xxhash64(col)).limit(SAMPLE).collect()]
    out = {}
    for dim in sorted({len(r) for r in rows}):
        x = np.array([r for r in rows if len(r) == dim], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[dim] = Index(dim, x, n * len(x) // max(len(rows), 1))
    return out


def link_block(index: Index, centre: np.ndarray, x: dict, y: dict, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link counts of the queries y among the vectors x of one list, and edges that join what the block links."""
    reach = math.sqrt(max(2 - 2 * threshold, 0))
    ux, uy = x["v"] / x["norm"][:, None], y["v"] / y["norm"][:, None]
    codes, left = index.encode(ux - centre)
    count, found = np.zeros(len(uy), np.int64), []
    for at in range(0, len(uy), 256):
        part = slice(at, at + 256)
        maybe = index.coded_distances(uy[part] - centre, codes) <= reach + left + 1e-6
        some = np.flatnonzero(maybe.any(0))
        if not len(some):
            continue
        cos = (y["v"][part] @ x["v"][some].T) / (y["norm"][part][:, None] * x["norm"][some])
        hit = (cos >= threshold) & maybe[:, some] & (y["cls"][part][:, None] != x["cls"][some])
        count[part] = hit @ x["copies"][some]
        i, j = np.nonzero(hit)
        found.append(np.stack([y["cls"][part][i], x["cls"][some[j]]]))
    if not found:
        return count, np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.concatenate(found, axis=1)
    nodes, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(pairs.shape)
    root = forest(at[0], at[1], len(nodes))
    moved = root != np.arange(len(nodes))
    return count, nodes[moved], nodes[root[moved]]


def _matrix(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def group(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id") -> DataFrame:
    """One row per row of rows (vec_id, embedding, label): its id, n_links, component_id and kept.

    Vectors link within one label that is not null, at a cosine of at least the threshold; null vectors, and those that are empty,
    zero or hold null or non-finite components link with nothing, nor do vectors of different lengths. Equal vectors of a label
    are one class while searching and count as links of each other. A null id never names a component; rows that repeat an id
    stay. An empty table gives no rows.
    """
    data = rows.select(id_col, "embedding", "label")
    good = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    data = data.withColumn("cls", F.when(F.coalesce(good, F.lit(False)), F.xxhash64("label", F.transform("embedding", lambda v: v + 0))))
    classes = stored(data.where("cls is not null").groupBy("cls", "label", "embedding").agg(F.min(id_col).alias("rep"), F.count("*").alias("copies")), "vectors")
    indexes = fit(classes)
    shared = rows.sparkSession.sparkContext.broadcast(indexes)
    reach = math.sqrt(max(2 - 2 * threshold, 0))

    def make():
        known = shared.value

        def work(embeddings):
            vectors = _matrix(embeddings)
            own, probes = np.zeros(len(vectors), np.int64), [[0]] * len(vectors)
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes):
                if dim in known:
                    at = np.flatnonzero(sizes == dim)
                    x = np.stack([vectors[i] for i in at]).astype(float)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    own[at], rows, lists = known[dim].place(x, reach)
                    cuts = np.searchsorted(rows, np.arange(len(at) + 1))
                    for k, i in enumerate(at):
                        probes[i] = lists[cuts[k] : cuts[k + 1]]
            return [pa.array(own, pa.int64()), pa.array(probes, pa.list_(pa.int64()))]

        return work

    placed = stored(map_batches(classes, ["embedding"], [T.StructField("own", T.LongType()), T.StructField("probes", T.ArrayType(T.LongType()))], make).withColumn("dim", F.size("embedding")), "placed")
    cols = ["cls", "copies", "embedding", "label", "dim"]
    members = placed.select(*cols, F.col("own").alias("list"))
    queries = placed.select(*cols, F.explode("probes").alias("list"))
    at = ["label", "dim", "list"]
    sizes = members.groupBy(*at).agg(F.count("*").alias("x")).join(queries.groupBy(*at).agg(F.count("*").alias("y")), at)
    sizes = sizes.select(*at, F.ceil(F.col("x") / BLOCK).alias("xs"), F.ceil(F.col("y") / BLOCK).alias("ys"))
    salt = lambda n: F.pmod(F.xxhash64("cls", F.lit(3)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = members.join(sizes, at).select(*cols, "list", F.lit(False).alias("asks"), salt("xs").alias("xb"), every("ys").alias("yb"))
    queries = queries.join(sizes, at).select(*cols, "list", F.lit(True).alias("asks"), salt("ys").alias("yb"), every("xs").alias("xb"))

    def search(t: pa.Table) -> pa.Table:
        dim, place = t.column("dim")[0].as_py(), t.column("list")[0].as_py()
        index = shared.value.get(dim) or Index(dim, np.zeros((0, dim)), 0)
        v = np.asarray(t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)
        side = {"cls": t.column("cls").to_numpy(), "copies": t.column("copies").to_numpy(), "v": v, "norm": np.linalg.norm(v, axis=1)}
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        x, y = ({k: a[m] for k, a in side.items()} for m in (~asks, asks))
        n, a, b = link_block(index, index.centre(place), x, y, threshold) if len(x["cls"]) else (np.zeros(len(y["cls"]), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        some = n > 0
        return pa.table({"a": pa.array(np.concatenate([y["cls"][some], a]), pa.int64()), "b": pa.array(np.concatenate([y["cls"][some], b]), pa.int64()), "n": pa.array(np.concatenate([n[some], np.zeros(len(a), np.int64)]), pa.int64())})

    found = stored(members.unionByName(queries).groupBy(*at, "xb", "yb").applyInArrow(search, "a bigint, b bigint, n bigint"), "found")
    links = found.where("a = b").groupBy("a").agg(F.sum("n").alias("links"))
    joined = components(found.where("a <> b").select("a", "b"))
    of = classes.join(links, classes["cls"] == links["a"], "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    of = of.select("cls", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    answer = of.join(of.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("cls", "n_links", "component_id")
    out = data.select(id_col, "cls").join(answer, "cls", "left")
    component = F.when(F.col("cls").isNotNull(), F.col("component_id")).otherwise(F.col(id_col))
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"))
