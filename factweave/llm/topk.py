"""Exact top-k inner product by MaxScore over blocked postings.

Components become integers floor(scale * x); a component is a query term, and a
block of candidates keeps its values by component (that component's postings)
with the least and largest value, hence a score bound for each query term. For
one query and block, terms are taken in order of their bounds; those whose bounds
together can't reach the query's current k-th score are non-essential. Essential
postings are traversed for the whole block; the others are probed, a group of
terms at a time, only for candidates that are still competitive (their score so
far and the bounds left reach the k-th score, equality included, as a smaller id
wins ties). Shards are merged by Spark.

Candidates are dealt evenly to shards of at most some ``ROWS_PER_SHARD`` rows and
queries to groups of ``QUERIES_PER_GROUP``, both packed in blocks; a shard and a
group are cogrouped once, so a task holds one shard, one group and one block's
running best, and a fixed set of queries moves data in proportion to the
candidates. Neither side is collected or broadcast.

Defined results: vectors that are null or hold a null or non-finite component,
or have no id, take no part; shorter vectors count as padded with zeros; rows with
one id are candidates each, but none for that id's query, whose repeated rows
count as one query; scores outside 64 bits are clamped; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

K = 20
SCALE = 64
QUERY_BLOCK = 512
QUERIES_PER_GROUP = 4096
ROW_BLOCK = 2048
ROWS_PER_SHARD = 8192
_STEP = 16

BLOCK_SCHEMA = "block long, n int, dim int, ids binary, matrix binary"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & fine)


def _packer(rows: int, scale: float):
    """Packs rows of (id, v) into blocks; integer vectors as float64."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, part = 0, TaskContext.get().partitionId()
        for big in batches:
            for at in range(0, big.num_rows, rows):
                b = big.slice(at, rows)
                ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = np.floor(scale * b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                dim = int(sizes.max(initial=0))
                m = np.zeros((ids.size, dim))
                m[np.arange(dim) < sizes[:, None]] = flat
                m += 0.0  # no negative zeros
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part * (1 << 32) + n], pa.int64()), pa.array([ids.size], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([_narrow(m).tobytes()], pa.binary())],
                    names=["block", "n", "dim", "ids", "matrix"],
                )
                n += 1

    return pack


def _narrow(m: np.ndarray) -> np.ndarray:
    """As float32 if that keeps every value, else float64; columns first."""
    m = np.ascontiguousarray(m.T)
    return m.astype(np.float32) if not m.size or np.abs(m).max() < 1 << 24 else m


def _block(n: int, dim: int, ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = np.float32 if len(matrix) == 4 * n * dim else np.float64
    return np.frombuffer(ids, np.int64), np.frombuffer(matrix, kind).reshape(dim, n)


class Best:
    """The running top k of a block of queries."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.vectors = matrix
        self.scores = [np.zeros(0, np.float64)] * ids.size
        self.names = [np.zeros(0, np.int64)] * ids.size

    def add(self, names: np.ndarray, rows: np.ndarray) -> None:
        """Take in one block of candidates."""
        dim = max(self.vectors.shape[0], rows.shape[0])
        q = np.zeros((dim, self.ids.size))
        q[: self.vectors.shape[0]] = self.vectors
        if rows.shape[0] < dim:
            rows = np.vstack([rows, np.zeros((dim - rows.shape[0], rows.shape[1]), rows.dtype)])
        if not names.size:
            return
        low, high = rows.min(axis=1).astype(np.float64), rows.max(axis=1).astype(np.float64)
        reach = dim * np.abs(q).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))
        if reach >= 1 << 53:
            return self._add_wide(names, rows, q)
        kind = np.float32 if reach < 1 << 24 else np.float64
        rows = rows.astype(kind, copy=False)
        bounds = np.maximum(q * low[:, None], q * high[:, None])
        order = np.argsort(-bounds, axis=0, kind="stable")
        for j in range(self.ids.size):
            by, vec = order[:, j], q[:, j].astype(kind)
            left = np.append(np.cumsum(bounds[by, j][::-1])[::-1], 0.0)  # left[t]: what terms from t on can add
            floor = self.scores[j][-1] if self.scores[j].size == self.k else -np.inf
            if left[0] < floor:
                continue
            essential = int(np.searchsorted(-left, -floor, "right")) if np.isfinite(floor) else dim
            essential = min(dim, max(_STEP, essential))
            score = vec[by[:essential]] @ rows[by[:essential]]
            alive, at = None, essential
            while at < dim:  # probe the other terms while competitive
                keep = np.flatnonzero(score + left[at] >= floor)
                alive, score = (keep if alive is None else alive[keep]), score[keep]
                terms = by[at : at + _STEP]
                score = score + vec[terms] @ rows[np.ix_(terms, alive)]
                at += _STEP
            self._merge(j, names if alive is None else names[alive], score, floor)

    def _merge(self, j: int, names: np.ndarray, score: np.ndarray, floor: float) -> None:
        keep = score >= floor
        if names.size and (names == self.ids[j]).any():
            keep &= names != self.ids[j]
        names, score = names[keep], score[keep].astype(np.float64)
        if score.size > self.k:  # all that reach the block's own k-th score
            cut = np.partition(score, score.size - self.k)[score.size - self.k]
            names, score = names[score >= cut], score[score >= cut]
        names, score = np.concatenate([self.names[j], names]), np.concatenate([self.scores[j], score])
        top = np.lexsort((names, -score))[: self.k]
        self.names[j], self.scores[j] = names[top], score[top]

    def _add_wide(self, names: np.ndarray, rows: np.ndarray, q: np.ndarray) -> None:
        """Values too large for exact floating point: whole numbers, no pruning."""
        exact = [[int(x) for x in r] for r in rows.T.astype(np.float64)]
        for j in range(self.ids.size):
            vec = [int(x) for x in q[:, j]]
            score = [sum(a * b for a, b in zip(vec, r)) for r in exact]
            clamp = [min(max(s, -(2**63)), 2**63 - 1) for s in score]
            pairs = [(int(-s), n) for s, n in zip(self.scores[j], self.names[j])] if self.scores[j].size else []
            pairs += [(-s, n) for s, n in zip(clamp, names.tolist()) if n != self.ids[j]]
            pairs = sorted(pairs)[: self.k]
            self.names[j] = np.array([n for _, n in pairs], np.int64)
            self.scores[j] = np.array([-s for s, _ in pairs], object)

    def rows(self) -> pa.RecordBatch:
        sizes = [s.size for s in self.scores]
        score = [int(x) for s in self.scores for x in s]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, sizes), pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *self.names]), pa.int64()), pa.array(score, pa.int64())],
            schema=FOUND,
        )


def _searcher(k: int):
    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        """The best rows of one shard for one group of queries."""
        found = []
        for q in asked.to_batches():
            for i in range(q.num_rows):
                best = Best(*_unpacked(q, i), k)
                for b in rows.to_batches():
                    for j in range(b.num_rows):
                        best.add(*_unpacked(b, j))
                found.append(best.rows())
        return pa.Table.from_batches(found, FOUND)

    return search


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    return _block(*(batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("n", "dim", "ids", "matrix")))


def _dealt(rows: DataFrame, parts: int, block: int, scale: float, name: str, own: str) -> DataFrame:
    """The rows in blocks, dealt evenly to ``parts`` parts numbered by column ``own``, written."""
    packed = rows.repartition(parts).mapInArrow(_packer(block, scale), BLOCK_SCHEMA)
    return written(packed.select(F.shiftright("block", 32).cast("int").alias(own), "n", "dim", "ids", "matrix"), name)


def exact_topk(
    queries: DataFrame, rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best rows but its own, ties to the smaller id."""
    asked = usable(queries, id_col, vector_col).dropDuplicates(["id"])
    shards = max(1, -(-rows.count() // ROWS_PER_SHARD))
    groups = max(1, -(-queries.count() // QUERIES_PER_GROUP))
    blocks = _dealt(usable(rows, id_col, vector_col), shards, ROW_BLOCK, scale, "topk-rows", "shard")
    q_blocks = _dealt(asked, groups, QUERY_BLOCK, scale, "topk-queries", "group")
    # a shard meets each group once: its blocks move once for each group, a group's once for each shard
    blocks = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    q_blocks = q_blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ["shard", "group"]
    found = blocks.groupBy(*keys).cogroup(q_blocks.groupBy(*keys)).applyInArrow(_searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
