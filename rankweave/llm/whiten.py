"""Embedding whitening by hierarchical merging of singular value decompositions.

A node stands for some rows: their number, exact sums, and the singular values and right vectors of the rows less their mean, at full rank.
Two nodes merge without the rows: the singular values times vectors of both, and one row more for the distance of the means, decompose
into those of the rows together. A task merges the batches of its partition, and tasks' nodes merge in groups of MERGED, level by level,
until one is left; nothing is truncated, so it is the decomposition of all rows.

Vectors are fixed-point (integers), so that sums and deviations are exact; means of neighbours far from zero cost no digits, as every
decomposition is of centred rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import dropped, stored

#: Nodes that one task merges.
MERGED = 8
#: Rows that are decomposed at once.
BATCH = 4096
#: An eigenvalue below this share of the largest is rounding, not variance.
NOTHING = 1e-13

#: Larger entries, once scaled, count as this.
LARGEST = 2.0**52


@dataclass
class Node:
    """n rows with the given sums; ``rows`` are the singular values times right vectors of the rows less their mean."""

    n: int
    sums: np.ndarray
    rows: np.ndarray

    def covariance(self) -> np.ndarray:
        return self.rows.T @ self.rows / self.n


def decomposed(x: np.ndarray) -> np.ndarray:
    """Singular values times right vectors of x, as many as it has columns."""
    _, values, vectors = np.linalg.svd(x, full_matrices=False)
    out = np.zeros((x.shape[1], x.shape[1]))
    out[: len(values)] = values[:, None] * vectors
    return out


def node_of(x: np.ndarray) -> Node:
    """The node of rows; the mean of integers is taken off in two exact steps."""
    sums, n = x.sum(0), len(x)
    whole, rest = np.divmod(sums, n)
    return Node(n, sums, decomposed((x - whole) - rest / n))


def merged(a: Node, b: Node) -> Node:
    """The node of both nodes' rows."""
    n = a.n + b.n
    (whole_a, rest_a), (whole_b, rest_b) = np.divmod(a.sums, a.n), np.divmod(b.sums, b.n)
    apart = (whole_a - whole_b) + (rest_a / a.n - rest_b / b.n)
    return Node(n, a.sums + b.sums, decomposed(np.vstack([a.rows, b.rows, apart * np.sqrt(a.n / n * b.n)])))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit(vectors: DataFrame, col: str, dim: int, whitened: Broadcast | None = None) -> Node | None:
    """The node of all vectors (array of integers, dim of them, none null), or of what a whitener makes of them; None without rows.

    Only the last node comes to the driver: a square of the dimension, whatever the number of rows.
    """
    width, exact = (dim, True) if whitened is None else (len(whitened.value.values), False)
    kind = T.LongType() if exact else T.DoubleType()
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(kind)), T.StructField("rows", T.ArrayType(T.DoubleType()))])

    def record(k: int, node: Node) -> pa.RecordBatch:
        sums = pa.array([node.sums.tolist()], pa.list_(pa.int64() if exact else pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([node.n], pa.int64()), sums, pa.array([node.rows.ravel().tolist()], pa.list_(pa.float64()))], names=schema.names)

    def node_from(n: int, sums: list, rows: list) -> Node:
        return Node(n, np.array(sums, np.int64 if exact else float), np.array(rows).reshape(width, width))

    def of_task(batches):
        node = None
        for batch in batches:
            x = matrix(batch.column(0), dim)
            for at in range(0, len(x), BATCH):
                part = x[at : at + BATCH]
                one = node_of(part if whitened is None else whitened.value(part))
                node = one if node is None else merged(node, one)
        if node is not None:
            yield record(TaskContext.get().partitionId(), node)

    def merge(key, t):
        node = None
        for _, *values in sorted(zip(*(t.column(c).to_pylist() for c in schema.names), strict=True), key=lambda x: x[0]):
            one = node_from(*values)
            node = one if node is None else merged(node, one)
        return pa.Table.from_batches([record(key[0].as_py(), node)])

    now = stored(vectors.select(col).mapInArrow(of_task, schema), "nodes")
    while (now.agg(F.max("k")).first()[0] or 0) > 0:
        after = stored(now.groupBy(F.floor(F.col("k") / MERGED).cast("long").alias("up")).applyInArrow(merge, schema), "nodes")
        dropped(now)
        now = after
    last = now.first()
    dropped(now)
    return node_from(last["n"], last["sums"], last["rows"]) if last else None


@dataclass
class Whitener:
    """The unit eigenvectors (rows) of a covariance by falling eigenvalue, without those of no variance."""

    node: Node
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        whole, rest = np.divmod(self.node.sums, self.node.n)
        return ((x - whole) - rest / self.node.n) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of the squares of n * x - sums, exactly."""
        n, sums = self.node.n, self.node.sums
        off = x.astype(object) * n - sums.astype(object) if n * max(int(np.abs(x).max(initial=0)), 1) > 2**61 else x * n - sums
        if x.shape[1] * float(np.abs(off).max(initial=0)) ** 2 >= 2**62:
            off = off.astype(object)
        return (off * off).sum(1).tolist()


def whitener(node: Node, components: int) -> Whitener:
    _, singular, vectors = np.linalg.svd(node.rows)
    values = singular**2 / node.n
    use = int((values[:components] > NOTHING * max(values[0], 0)).sum()) if values[0] > 0 else 0
    return Whitener(node, values[:use], vectors[:use], values[:use] / max(values.sum(), 1e-300))


def quantized(vectors: DataFrame, col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vectors with the column x: floor(scale * entry) + shift of each entry, for the rows whose vector is not null and holds no null or
    non-finite entry; others are left out. A scaled entry beyond LARGEST counts as that."""
    usable = F.col(col).isNotNull() & F.coalesce(F.forall(col, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False))
    return vectors.where(usable).withColumn("x", F.transform(col, lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long") + shift))


def whiten(vectors: DataFrame, id_col: str = "vec_id", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> tuple[DataFrame, Whitener | None]:
    """(a row for each usable row of vectors (id, embedding), the model).

    The rows hold the id, n (rows of the fit), deviation (sum over dimensions of (n * x - sums) squared, exact; null if it is no 64-bit
    integer), whitened (array: the row's coordinates along the components by falling eigenvalue, each with variance one),
    explained (array: the components' shares of the trace) and identity_error, the largest entry of the whitened rows' covariance less the
    identity, taken in a second pass over them. x is ``quantized``. Rows whose vector is null or has a null or non-finite entry are left out, and so are
    those of another length than most vectors have (ties: the longer; one covariance needs one length), and empty ones. Components
    of no variance can't be whitened and are left out, so equal rows, or a single one, give empty arrays. Rows that repeat count as often;
    a null id stays. An empty table gives no rows and no model.
    """
    spark = vectors.sparkSession
    x = quantized(vectors.select(id_col, "embedding"), "embedding", scale, shift).select(id_col, "x").where(F.size("x") > 0)
    most = x.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = most["dim"] if most else 1
    x = x.where(F.size("x") == dim)
    node = fit(x, "x", dim)
    schema = T.StructType([x.schema[id_col], T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("whitened", "explained")] + [T.StructField("identity_error", T.DoubleType())])
    if node is None:
        return spark.createDataFrame([], schema), None
    model = whitener(node, components)
    shared = spark.sparkContext.broadcast(model)  # one vector by as many: its size is the dimension's
    use = len(model.values)
    error = float(np.abs(fit(x, "x", dim, shared).covariance() - np.eye(use)).max()) if use else 0.0

    def work(batches):
        model = shared.value
        for batch in batches:
            v = matrix(batch.column("x"), dim)
            for at in range(0, len(v), BATCH):
                part, own = v[at : at + BATCH], batch.slice(at, BATCH)
                w, k = model(part), len(part)
                fits = [d if d < 2**63 else None for d in model.deviations(part)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * use), pa.array(np.ascontiguousarray(w).ravel()))
                shares = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * use), pa.array(np.tile(model.explained, k)))
                columns = [own.column(id_col), pa.array(np.full(k, model.node.n)), pa.array(fits, pa.int64()), lists, shares, pa.array(np.full(k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return x.mapInArrow(work, schema), model
