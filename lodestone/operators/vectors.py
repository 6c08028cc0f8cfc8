"""Nearest neighbours over a column of number arrays.

A single query is a scan with a bounded top-k in every task. Many queries and the vectors are both dealt into blocks of rows, and every block of queries meets
every block of vectors in one matrix product that keeps k rows a query: no pair of rows is ever made, and neither side is sent to the driver. A task takes
TASK_BLOCKS blocks of either side at most, so that with more rows there are more tasks, not longer ones. The product only says which rows may be among the
nearest; their distances are computed one by one, so equal vectors have equal distances wherever they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import METRICS

#: Queries, and vectors, of a block.
BLOCK_QUERIES, BLOCK_VECTORS = 512, 4096
#: Blocks of either side that meet in one task, and pairs whose distances are computed at once.
TASK_BLOCKS, STEP_PAIRS = 16, 1 << 15


def _query(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector])


def distance(column: str, query: list[float], metric: str = "l2") -> Column:
    return METRICS[metric](F.col(column), _query(query))


def knn(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", column: str = "embedding", metric: str = "l2", where: Column | None = None, radius: float | None = None) -> DataFrame:
    """The k nearest rows of the right dimension, ties by id; `where` filters first, `radius` (None: none) bounds the distance. Vectors with a null have none."""
    rows = vectors.where(F.size(column) == len(query))
    rows = rows if where is None else rows.where(where)
    found = rows.withColumn("distance", distance(column, query, metric)).where("distance is not null")
    if radius is not None:
        found = found.where(F.col("distance") <= radius)
    return found.orderBy("distance", id_col).limit(k)


def within(vectors: DataFrame, query: list[float], radius: float, column: str = "embedding", metric: str = "l2") -> DataFrame:
    return vectors.where(F.size(column) == len(query)).withColumn("distance", distance(column, query, metric)).where(F.col("distance") <= radius)


def _blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """rows(id, v) as blocks: {prefix}_ids, {prefix}_dim and {prefix}_data (64-bit floats one after the other). Null vectors, and those with a null, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, own = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([dim], pa.int32()), pa.array([np.concatenate(own).tobytes()], pa.binary())], names)

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if v is None or i is None or None in v:
                    continue
                ids, own = held.setdefault(len(v), ([], []))
                ids.append(i)
                own.append(np.array(v, np.float64))
                if len(ids) == size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    names = [f"{prefix}_ids", f"{prefix}_dim", f"{prefix}_data"]
    return rows.mapInArrow(run, f"{names[0]} array<long>, {names[1]} int, {names[2]} binary")


def _pair_distances(queries: np.ndarray, block: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """The distances of queries[i] and block[j], a pair at a time."""
    out = np.empty(len(i))
    for at in range(0, len(i), STEP_PAIRS):
        own = slice(at, at + STEP_PAIRS)
        q, v = queries[i[own]], block[j[own]]
        if metric == "l2":
            out[own] = np.sqrt(((q - v) ** 2).sum(1))
            continue
        dot = (q * v).sum(1)
        if metric == "cosine":
            norms = np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1))
            out[own] = np.where(norms > 0, 1 - dot / np.where(norms > 0, norms, 1), np.inf)
        else:
            out[own] = -dot
    return out


def _may_be_near(queries: np.ndarray, block: np.ndarray, k: int, bound: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of all rows of the block that can be among a query's k nearest; bound: the distance that a query's k-th has so far (inf: none).

    Values by matrix product, squared for l2, are off by rounding; the slack is well above that. What can't be told (overflow) stays.
    """
    eps = np.finfo(np.float64).eps
    q2, v2 = np.einsum("ij,ij->i", queries, queries), np.einsum("ij,ij->i", block, block)
    odd = ~np.isfinite(v2)
    most = v2[~odd].max(initial=0)
    near = queries @ block.T
    if metric == "l2":
        near *= -2
        near += v2
        near += q2[:, None]
        slack, bound = q2 + most, np.square(bound)
    elif metric == "cosine":
        norms = np.outer(np.sqrt(q2), np.sqrt(v2))
        near = np.where(norms > 0, 1 - near / np.where(norms > 0, norms, 1), np.inf)
        slack = np.ones(len(queries))
    else:
        near *= -1
        slack = np.sqrt(q2 * most)
    if k < len(block):
        open_yet = np.flatnonzero(~np.isfinite(bound))
        if len(open_yet):
            bound = bound.copy()
            bound[open_yet] = np.partition(near[open_yet], k - 1, axis=1)[:, k - 1]
    limit = bound + 16 * eps * ((queries.shape[1] + 8) * slack + np.abs(bound))
    return np.nonzero(~(near > limit[:, None]) | odd)


class _Nearest:
    """The k nearest rows so far of each query of a block: flat arrays, sorted by query, distance and id."""

    def __init__(self, qids: np.ndarray, k: int) -> None:
        self.qids, self.k = qids, k
        self.query, self.id, self.distance = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def meet(self, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, metric: str) -> None:
        bound = np.full(len(self.qids), np.inf)
        last = np.flatnonzero(self._rank() == self.k - 1)
        bound[self.query[last]] = self.distance[last]
        with np.errstate(invalid="ignore", over="ignore"):  # what is not finite is no neighbour
            i, j = _may_be_near(queries, block, self.k, bound, metric)
            found = _pair_distances(queries, block, i, j, metric)
        live = np.isfinite(found)
        query, own, distance = np.concatenate([self.query, i[live]]), np.concatenate([self.id, ids[j[live]]]), np.concatenate([self.distance, found[live]])
        order = np.lexsort((own, distance, query))
        self.query, self.id, self.distance = query[order], own[order], distance[order]
        best = self._rank() < self.k
        self.query, self.id, self.distance = self.query[best], self.id[best], self.distance[best]

    def _rank(self) -> np.ndarray:
        return np.arange(len(self.query)) - np.searchsorted(self.query, self.query)


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", column: str = "embedding", metric: str = "l2") -> DataFrame:
    """queries(qid, query): per query its k nearest rows of its dimension (qid, id, distance, rank), ties by id. Rows of both are counted at once."""
    if metric not in METRICS:
        raise ValueError(f"{metric!r} is none of {sorted(METRICS)}")
    asked = _blocks(queries.select(F.col("qid").cast("long").alias("id"), F.col("query").cast("array<double>").alias("v")), BLOCK_QUERIES, "q")
    rows = _blocks(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")), BLOCK_VECTORS, "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], _Nearest] = {}  # of the blocks of queries of this task
        for batch in batches:
            for r in range(batch.num_rows):
                qids, own, ids, data, dim = (batch.column(c)[r] for c in ("q_ids", "q_data", "v_ids", "v_data", "v_dim"))
                qids, ids, dim = qids.values.to_numpy(), ids.values.to_numpy(), dim.as_py()
                best = held.setdefault((dim, qids.tobytes()), _Nearest(qids.copy(), k))
                best.meet(np.frombuffer(own.as_buffer()).reshape(len(qids), dim), ids, np.frombuffer(data.as_buffer()).reshape(len(ids), dim), metric)
        for best in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(best.qids[best.query]), pa.array(best.id), pa.array(best.distance)], ["qid", "id", "distance"])

    # Rows here are blocks: each block of queries has to meet each block of vectors. An equal join on the dimension would send them all to one task.
    cores = max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    of_queries = max(1, -(-queries.count() // (BLOCK_QUERIES * TASK_BLOCKS)))
    of_vectors = max(1, -(-vectors.count() // (BLOCK_VECTORS * TASK_BLOCKS)), -(-cores // of_queries))
    met = rows.repartition(of_vectors).hint("shuffle_replicate_nl").join(asked.repartition(of_queries), F.col("q_dim") == F.col("v_dim"))
    found = met.mapInArrow(run, "qid long, id long, distance double")
    best = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def merge_topk(parts: DataFrame, k: int) -> DataFrame:
    """Merges parts(doc_id, distance) of several shards: each document's least distance, then the k nearest."""
    return parts.groupBy("doc_id").agg(F.min("distance").alias("distance")).orderBy("distance", "doc_id").limit(k)


def delete(vectors: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Without the rows of these ids."""
    return vectors.join(ids.select(id_col), id_col, "left_anti")


def upsert(vectors: DataFrame, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return vectors.join(rows.select(id_col), id_col, "left_anti").unionByName(rows)
