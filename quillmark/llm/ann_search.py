"""Nearest neighbours by cosine: a block matrix join with int8 product tiles.

Vectors are scaled to length one and quantised to int8, each with a scale and the exact norm of what quantisation
lost. Every slice of queries meets every shard of candidates in a task, block by block; a tile of integer products gives each pair's cosine within an error
bound, and only pairs whose upper bound reaches the block's k-th lower bound are recomputed in double precision from
the original vectors. Each task keeps the k best of every query it saw; the lists are then merged.

The bounds are proven, so the result is exact (recall 1). Queries are a stated subset and come in slices, so memory is a
slice of queries, a candidate block and k rows a query. Both sides are shuffled once, and nothing is sent through the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, shuffle_parts, stored, tidy

RESULT = "query_id long, vec_id long, score double"
PAIR = ["dim", "block", "ids", "vectors", "q_block", "q_ids", "q_vectors"]
#: Parts that candidates are dealt into, but for more cores. Each gives k rows a query, so they don't follow the table.
SHARDS = 64
#: Queries, and bytes of them, that a task holds at once; there are more tasks where there are more.
SLICE_ROWS, SLICE_BYTES = 2**14, 2**24


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows that take part: a non-null id and a vector that is not null, empty or zero and has only finite components."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Pack the rows of each partition into blocks of ``size`` vectors of one dimension."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: dict[int, tuple[list, list]] = {}

        def emit(dim):
            ids, vectors = held.pop(dim)
            block = [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.concatenate(vectors).astype("<f8").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(block, names=["dim", "n", "ids", "vectors"])

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                vector = vector.values.to_numpy(zero_copy_only=False)
                ids, vectors = held.setdefault(len(vector), ([], []))
                ids.append(vec_id)
                vectors.append(vector)
                if len(ids) >= size:
                    yield emit(len(vector))
        for dim in list(held):
            yield emit(dim)

    return rows.mapInArrow(pack, "dim int, n int, ids binary, vectors binary")


def _quantise(vectors):
    """Unit int8 rows as float32 (exact in products), their scales, and norms of the quantisation error."""
    import numpy as np

    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((unit - code * scale[:, None]) ** 2).sum(axis=1)) + 1e-12
    return code.astype(np.float32), scale, lost


def cosine(a, b):
    """Cosine of paired rows in double precision, summed over the components from first to last.

    Rows whose squares leave the range of doubles are scaled by their largest component first.
    """
    import numpy as np

    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
        for d in range(a.shape[1]):
            dot += a[:, d] * b[:, d]
            aa += a[:, d] * a[:, d]
            bb += b[:, d] * b[:, d]
        safe = (np.minimum(aa, bb) > 1e-280) & (np.maximum(aa, bb) < 1e280)
        out = dot / (np.sqrt(aa) * np.sqrt(bb))
    if not safe.all():
        out[~safe] = cosine(*(x[~safe] / np.abs(x[~safe]).max(axis=1, keepdims=True) for x in (a, b)))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 1024, candidate_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``vectors`` for each row of ``queries``.

    A row is never its own neighbour (same id). Ties go to the smaller id, fewer than ``k`` candidates give fewer rows,
    vectors of another length than the query's are no candidates, and unusable vectors (see :func:`usable`) take no
    part; an empty table gives an empty result, other columns are not read. Rows that repeat an id are candidates each; a query id that repeats is asked once, with its smallest vector.
    """
    spark = vectors.sparkSession
    once = stored(usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    n, components = once.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    slices = max(1, -(-n // SLICE_ROWS), -(-8 * components // SLICE_BYTES))
    asked = _blocks(once.repartition(slices), query_block).select("dim", F.monotonically_increasing_id().alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    asked = stored(asked, "asked")
    discard(once)
    shards = min(shuffle_parts(spark), max(SHARDS, 2 * spark.sparkContext.defaultParallelism))
    blocks = _blocks(usable(vectors, id_col, vector_col), candidate_block).withColumn("block", F.monotonically_increasing_id()).repartition(shards)
    # each slice of queries meets each shard in a task that fetches both: neither is broadcast, or copied before it is shuffled
    pairs = blocks.join(asked.repartition(slices).hint("shuffle_replicate_nl"), "dim")

    @tidy
    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        best: dict[int, list[tuple]] = {}  # a heap of (score, -id) for each query of the slice, the worst on top
        asked: dict[int, tuple] = {}  # blocks of the slice
        last, block = None, None

        for batch in batches:
            for dim, number, ids, vectors, q_block, q_ids, q_vectors in zip(*(batch.column(c) for c in PAIR), strict=True):
                if (q_block := q_block.as_py()) not in asked:
                    q_rows = np.frombuffer(q_vectors.as_py(), "<f8").reshape(-1, dim.as_py())
                    asked[q_block] = (np.frombuffer(q_ids.as_py(), "<i8"), q_rows, *_quantise(q_rows))
                q_ids, q_rows, q_code, q_scale, q_lost = asked[q_block]
                if (number := number.as_py()) != last:  # a block of candidates meets all of the slice before the next one comes
                    rows = np.frombuffer(vectors.as_py(), "<f8").reshape(-1, dim.as_py())
                    last, block = number, (np.frombuffer(ids.as_py(), "<i8"), rows, *_quantise(rows))
                ids, rows, code, scale, lost = block
                for at in range(0, len(q_ids), 128):
                    cut = slice(at, at + 128)
                    near = (q_code[cut] @ code.T).astype(np.float64) * q_scale[cut, None] * scale
                    near[q_ids[cut, None] == ids] = -9
                    # |q.c - q'.c'| <= |q - q'| + |q'| |c - c'|, with |q'| <= 1 + |q - q'|
                    off = q_lost[cut, None] + (1 + q_lost[cut, None]) * lost + 1e-9
                    low = near - off
                    floor = np.partition(low, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(low), -9.0)
                    for n, x in enumerate(q_ids[cut]):
                        if (held := best.get(int(x))) is not None and len(held) == k:
                            floor[n] = max(floor[n], held[0][0] - 1e-9)
                    who, what = np.nonzero((near + off >= floor[:, None]) & (near > -5))
                    exact = cosine(q_rows[cut][who], rows[what])
                    for q, s, i in zip(q_ids[cut][who].tolist(), exact.tolist(), ids[what].tolist(), strict=True):
                        held = best.setdefault(q, [])
                        if len(held) < k:
                            heapq.heappush(held, (s, -i))
                        elif (s, -i) > held[0]:
                            heapq.heapreplace(held, (s, -i))
        rows = [(q, -i, s) for q, held in best.items() for s, i in held]
        q, i, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    found = pairs.select(*PAIR).mapInArrow(tile, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
