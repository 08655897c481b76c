"""Whitening of embeddings by singular values merged up a tree.

A vector becomes a row of integers, x = floor(scale * c).  The fit list is
each distinct x once; its principal components come from singular value
decompositions that are merged:

1. Each task takes its fit rows in blocks of bounded size, centres a block by
   its own mean and decomposes it.  What it keeps of any rows is (n, sums,
   mean, singular values, right vectors): all singular values there are.
2. Two such nodes merge by stacking their scaled vectors on one correction
   row, sqrt(n1 n2 / (n1 + n2)) times the difference of the means, and
   decomposing the stack.  Its Gram matrix is the scatter of both lists about
   their common mean, so nothing is lost, whatever the order of merging.
3. The nodes of the tasks merge by FAN in rounds of Spark jobs until one is
   left.  A node has at most d + 1 rows of d numbers, so the driver gets that
   much and no more.

The covariance matrix itself is never formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweft.llm.shared import cut

SCALE = 256
#: Components returned.
COMPONENTS = 4
#: Numbers in a block that is decomposed at once (a block has d rows at least), and nodes of one merge.
BLOCK, FAN = 1 << 21, 8
NODE = "node long, n long, sums array<decimal(38,0)>, mean array<double>, s array<double>, vt binary"
ARROW = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("s", pa.list_(pa.float64())), ("vt", pa.binary())])


@dataclass
class Node:
    """A list of rows: their number, exact sums, mean, singular values and right vectors about the mean."""

    n: int
    sums: list[int]
    mean: np.ndarray
    s: np.ndarray
    vt: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Node:
        """Of at least one row of integers."""
        sums = [int(v) for v in x.sum(axis=0, dtype=object)] if np.abs(x).max(initial=0) > 2**62 // len(x) else x.sum(axis=0).tolist()
        mean = np.array([v / len(x) for v in sums])
        _, s, vt = np.linalg.svd(x - mean, full_matrices=False)
        return cls(len(x), sums, mean, s, vt)

    def merge(self, other: Node) -> Node:
        n = self.n + other.n
        step = np.sqrt(self.n * other.n / n) * (self.mean - other.mean)
        _, s, vt = np.linalg.svd(np.vstack([self.s[:, None] * self.vt, other.s[:, None] * other.vt, step]), full_matrices=False)
        sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        return Node(n, sums, np.array([v / n for v in sums]), s, vt)

    def row(self, name: int) -> tuple:
        return name, self.n, self.sums, self.mean.tolist(), self.s.tolist(), np.ascontiguousarray(self.vt).tobytes()

    @classmethod
    def read(cls, row) -> Node:
        s = np.array(row["s"], float)
        return cls(int(row["n"]), [int(v) for v in row["sums"]], np.array(row["mean"], float), s, np.frombuffer(row["vt"]).reshape(len(s), -1))


def _frame(nodes: list[tuple]) -> pd.DataFrame:
    from decimal import Decimal

    rows = [(name, n, [Decimal(v) for v in sums], *rest) for name, n, sums, *rest in nodes]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")])


def _integers(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), d)


def _leaves(d: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        node, held, rows = None, [], 0

        def closed(node: Node | None) -> Node:
            made = Node.of(np.vstack(held))
            return made if node is None else node.merge(made)

        for batch in batches:
            x = _integers(batch.column(0), d)
            for at in range(0, len(x), block):
                held.append(x[at : at + block])
                rows += len(held[-1])
                if rows >= block:
                    node, held, rows = closed(node), [], 0
        if rows:
            node = closed(node)
        if node is not None:
            yield from pa.Table.from_pandas(_frame([node.row(TaskContext.get().partitionId())]), schema=ARROW, preserve_index=False).to_batches()

    return run


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    nodes = [Node.read(r) for r in rows.sort_values("node").to_dict("records")]
    out = nodes[0]
    for other in nodes[1:]:
        out = out.merge(other)
    return _frame([out.row(int(key[0]))])


def fit(x: DataFrame, d: int, *, block: int = BLOCK, fan: int = FAN) -> Node | None:
    """The node of all rows of ``x``, one column of integer arrays of length ``d``; none of no rows."""
    nodes = cut(x.mapInArrow(_leaves(d, max(block // d, d)), NODE), "nodes")
    n = nodes.count()
    while n > 1:
        # names of a round are partition numbers, or numbers of groups of them: near even
        nodes = cut(nodes.groupBy(F.floor(F.col("node") / fan).alias("up")).applyInPandas(_merged, NODE), "nodes")
        n = nodes.count()
    rows = nodes.collect()
    return Node.read(rows[0]) if rows else None


@dataclass
class Whitener:
    """What projecting takes: n, exact sums, mean, the components (rows) with their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @classmethod
    def of(cls, node: Node, components: int) -> Whitener:
        """Components whose eigenvalue is zero, as far as doubles tell, cannot be scaled to one and are left out."""
        least = max(node.n, len(node.mean)) * np.finfo(float).eps * node.s.max(initial=0)
        keep = int((node.s > least).sum())
        values = node.s**2 / node.n
        k = min(components, keep)
        return cls(node.n, node.sums, node.mean, node.vt[:k], values[:k], float(values.sum()))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)^2, exactly; raises where it leaves 64 bits."""
        far = self.n * float(np.abs(x).max(initial=0)) + float(max(map(abs, self.sums), default=0))
        if x.shape[1] * far * far < 2.0**62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1)
        each = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        if max(each, default=0) >= 2**63:
            raise OverflowError("the deviation of a vector leaves 64 bits")
        return np.array(each, np.int64)


def _moments(w: Whitener, d: int):
    """Sums and sums of products of whitened rows: (i, j, total), j = -1 for the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        ones, both = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = w.whiten(_integers(batch.column(0), d))
            ones += y.sum(axis=0)
            both += y.T @ y
        i, j = np.indices((k, k))
        i, j = np.concatenate([i.ravel(), np.arange(k)]), np.concatenate([j.ravel(), np.full(k, -1)])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([both.ravel(), ones]))], names=["i", "j", "total"])

    return run


def identity_error(x: DataFrame, w: Whitener, d: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured on the rows."""
    k = len(w.values)
    if not k:
        return 0.0
    sums = x.mapInArrow(_moments(w, d), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    both, ones = np.zeros((k, k)), np.zeros(k)
    for r in sums:
        if r["j"] < 0:
            ones[r["i"]] = r["total"]
        else:
            both[r["i"], r["j"]] = r["total"]
    mean = ones / w.n
    return float(np.abs(both / w.n - np.outer(mean, mean) - np.eye(k)).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _repeated(column: pa.Array, k: int) -> pa.Array:
    """Each value k times in turn, nulls too."""
    return column.take(pa.array(np.repeat(np.arange(len(column)), k)))


def _projected(w: Whitener, d: int, error: float):
    k = len(w.values)
    explained = w.values / w.trace if w.trace else w.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = len(batch)
            x = _integers(batch.column(1), d)
            yield pa.RecordBatch.from_arrays(
                [
                    _repeated(batch.column(0), k),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, w.n)),
                    pa.array(np.repeat(w.deviation(x), k)),
                    pa.array(w.whiten(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=[c.split()[0] for c in OUT.split(", ")],
            )

    return run


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry as a double, in 64-bit integers; larger entries raise."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def whole(vector: Column) -> Column:
    """Whether the vector and all its entries are there and finite."""
    odd = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(True))


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Columns of OUT: each vector on the first components of the distinct integer vectors, scaled to variance one.

    Rows whose vector is null or holds null or non-finite entries are dropped.
    Rows without an id, repeated ids and repeated vectors keep their rows; the
    fit counts each distinct integer vector once, and ties of eigenvalues
    leave their components in the order the decomposition gives.  Vectors
    shorter than the longest count as filled up with zeros.  Components of
    eigenvalue zero do not exist, so fewer than ``components`` may be
    returned, and none where all integer vectors are equal; an empty table
    gives an empty result; other columns are not read.  Entries or deviations
    beyond 64 bits raise.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(whole(F.col("v")))
    d = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if not d:
        return spark.createDataFrame([], OUT)
    x = F.concat(integers(F.col("v"), scale), F.array_repeat(F.lit(0).cast("long"), d - F.size("v")))
    rows = rows.select("vec_id", x.alias("x"))
    # partial aggregation first: a vector that many rows share leaves each task once
    each = cut(rows.groupBy("x").count().select("x"), "fit")
    node = fit(each, d)
    w = Whitener.of(node, components)
    return rows.mapInArrow(_projected(w, d, identity_error(each, w, d)), OUT)
