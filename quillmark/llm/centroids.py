"""Centroid clustering by weighted deduplication: Lloyd's rounds run on distinct quantised vectors.

Vectors are quantised to whole numbers and equal ones are grouped, each with its multiplicity. A round assigns every
distinct vector and adds up, in the tasks, whole sums weighted by multiplicity; a task hands on one row a cluster. At the
end the assignments of distinct vectors are joined back to the rows. All sums are whole numbers, so the result does not
depend on how rows are dealt to tasks.

The driver holds the centroids (clusters x components), nothing that grows with the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Quantised components may be so large at most; squared distances of 64 of them then fit 64 bits.
LARGEST = 2**27


def quantised(vectors: DataFrame, dim: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and q, floor(scale * x) of each component, of the vectors with exactly ``dim`` components, none null or
    non-finite. A component beyond :data:`LARGEST` after that is an error."""
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) == dim) & whole)
    floored = F.transform(v, lambda x: F.when(F.abs(x * scale) <= LARGEST, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}")).cast("int")))
    return kept.select("vec_id", floored.alias("q"))


def _seeds(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """Vectors of the rows with the smallest SHA-256 of ``seed:vec_id``; rows without an id come last, ties by vector."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.q for r in rows.select(draw.alias("draw"), "q").orderBy(F.asc_nulls_last("draw"), "q").limit(clusters).collect()]


def _nearest(rows, centroids):
    """Number of the nearest centroid (ties: the smaller number) and squared distance of each row, exactly."""
    import numpy as np

    best, least = np.zeros(len(rows), np.int64), np.full(len(rows), np.iinfo(np.int64).max)
    for n, centre in enumerate(centroids):
        off = rows - centre
        far = np.einsum("ij,ij->i", off, off)
        nearer = far < least
        best[nearer], least[nearer] = n, far[nearer]
    return best, least


def _matrix(column, dim: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _sums(distinct: DataFrame, centroids, dim: int) -> list:
    """cluster, component, weighted sum and weight of one round: added up by task, then by Spark."""
    clusters = len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total, weight = np.zeros((clusters, dim), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            rows, n = _matrix(batch.column(0), dim), batch.column(1).to_numpy()
            best, _ = _nearest(rows, centroids)
            for c in np.unique(best):
                total[c] += n[best == c] @ rows[best == c]
                weight[c] += n[best == c].sum()
        at = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(weight[at]), pa.array(list(total[at]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    by_task = distinct.select("q", "n").mapInArrow(add, "cluster int, n long, sums array<long>")
    added = by_task.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("total"), F.sum("n").alias("n"))
    return added.collect()  # at most clusters x dim


def _assigned(distinct: DataFrame, centroids, dim: int) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            best, far = _nearest(_matrix(batch.column(2), dim), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(far)], names=["name", "n", "cluster", "distance"])

    return distinct.select("name", "n", "q").mapInArrow(assign, "name binary, n long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, hot_parts: int = 1000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector (see :func:`quantised`): vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256, group_size (rows with the same quantised vector).

    Centroids start as the kept vectors whose ``seed:vec_id`` has the smallest SHA-256. Each round assigns every vector to
    the nearest centroid by squared Euclidean distance (ties: the smaller number) and replaces each centroid that has
    vectors by the floor of their mean; empty ones stay. Rounds end early once no centroid moves, which changes nothing.

    Repeated rows count each; rows without an id are clustered and seed only where rows with one are too few. With fewer
    kept vectors than ``clusters`` there are as many centroids as vectors. Tables without kept vectors give no rows; other
    columns are not read. Sums beyond 64 bits are an error.

    Vectors that make up a ``hot_parts``-th of the rows or more, of which there can be no more than ``hot_parts``, are
    joined back by broadcast; every other key of the join has fewer rows than that.
    """
    rows = quantised(vectors, dim, scale, id_col, vector_col)
    named = stored(rows.withColumn("name", F.unhex(F.sha2(F.concat_ws(",", F.transform("q", lambda x: x.cast("string"))), 256))), "quantised")
    centroids = _centres(_seeds(named, clusters, seed), dim)
    distinct = stored(named.groupBy("name").agg(F.count("*").alias("n"), F.first("q").alias("q")), "distinct")
    total, largest = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("q", F.abs))), F.lit(0))).first()
    if int(total) * max(int(largest), 1) >= 2**63 or int(total) * 4 * dim * max(int(largest), 1) ** 2 >= 2**66:
        raise OverflowError("sums of so many rows with so large components need more than 64 bits")
    for _ in range(rounds):
        moved = centroids.copy()
        for cluster, at, x, n in _sums(distinct, centroids, dim):
            moved[cluster, at] = x // n
        if (moved == centroids).all():
            break
        centroids = moved
    found = stored(_assigned(distinct, centroids, dim), "assigned")
    by_cluster = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("n") * F.col("distance"))).collect()}
    inertia = sum(by_cluster.values())
    facts = [(c, x, inertia, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, x in by_cluster.items()]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # one row a cluster
    is_hot = F.col("n") * hot_parts >= int(total)
    hot, rest = found.where(is_hot), found.where(~is_hot)
    ids = named.select("vec_id", "name")
    back = ids.join(F.broadcast(hot), "name").unionByName(ids.join(F.broadcast(hot.select("name")), "name", "left_anti").join(rest, "name"))
    return back.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", F.col("n").alias("group_size"))


def _centres(seeds: list[list[int]], dim: int):
    import numpy as np

    return np.array(seeds, np.int64).reshape(-1, dim)
