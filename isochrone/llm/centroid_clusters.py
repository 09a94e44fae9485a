"""Centroid clustering of integer vectors, distances from scalar lookup tables.

Components are turned into integers ``floor(scale * x)``. In each round a task takes its vectors block by
block. For every dimension it tabulates the squared difference between each integer that occurs there and
each centroid's component, once; the distances of the block are then gathers from these tables and sums. All
arithmetic is on whole numbers, so results do not depend on order, partitioning or machines.

A round sends one row per cluster and task to the aggregation: a hot cluster or a group of equal vectors
costs no more. Only the centroids (``clusters`` times ``DIMENSIONS`` numbers) pass through the driver. The
vectors are written once; a lost executor repeats its own tasks of the round.

Defined results: vectors that are NULL, of another length or with NULL, NaN or infinite components (or, as
doubles, beyond the range of a float) are left out; a NULL ``vec_id`` hashes like the empty string; repeated
ids and rows are vectors of their own, equal hashes are ordered by the vectors' integers; with fewer vectors
than clusters each is a centroid; equally near centroids give the smaller number; an empty table gives an
empty result; a distance or sum beyond 64 bits is NULL, the assignment is exact all the same; columns beside
``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import require, stored

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: Vectors whose distances are computed at once.
BLOCK = 4096
LARGEST_FLOAT = 3.4028234663852886e38


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, embedding of the vectors that take part."""
    require(vectors, "vec_id", "embedding")
    kind = vectors.schema["embedding"].dataType
    inner = kind.elementType.simpleString() if isinstance(kind, T.ArrayType) else ""
    vector = F.col("embedding") if inner in ("float", "double") else F.col("embedding").cast("array<double>")
    ok = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST_FLOAT))
    return vectors.select("vec_id", vector.alias("embedding")).where((F.size("embedding") == dimensions) & F.coalesce(ok, F.lit(False)))


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``: 64-bit numbers where they suffice for squared distances, else Python's."""
    low = np.floor(values.astype("float64") * scale)
    if np.abs(low).max(initial=0) < 2**27:
        return low.astype("int64")
    return np.array([[int(x) for x in row] for row in low.tolist()], object)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of a block of vectors to all centroids, by gathers from one table a dimension."""
    total = np.zeros((len(vectors), len(centroids)), np.result_type(vectors.dtype, centroids.dtype))
    for d in range(vectors.shape[1]):
        values, where = np.unique(vectors[:, d], return_inverse=True)
        table = (values[:, None] - centroids[:, d]) ** 2
        total += table[where]
    return total


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, dimensions: int):
    """(record batch slice, its vectors as integers) for at most ``BLOCK`` rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            values = part.column(part.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False)
            yield part, _integers(values.reshape(-1, dimensions), scale)


def _table(centroids: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < 2**27 for c in centroids for x in c)
    return np.array(centroids, "int64" if small else object)


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED, scale: int = SCALE) -> list[list[int]]:
    """The vectors whose ids hash lowest, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    integers = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.select("embedding", digest.alias("digest"), integers.alias("integers")).orderBy("digest", "integers").limit(clusters).collect()
    return [[int(x) for x in np.floor(np.array(r["embedding"], "float64") * scale).tolist()] for r in rows]


def next_centroids(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> list[list[int]]:
    """One round: vectors go to the nearest centroid, non-empty centroids to the floor of their mean."""
    dimensions, k = len(centroids[0]), len(centroids)
    base = 2**64

    def run(batches):
        points, n, sums = _table(centroids), [0] * k, [[0] * dimensions for _ in range(k)]
        for _, block in _blocks(batches, scale, dimensions):
            nearest = distances(block, points).argmin(axis=1)
            for c in np.unique(nearest).tolist():
                own = block[nearest == c]
                n[c] += len(own)
                sums[c] = [a + int(b) for a, b in zip(sums[c], own.sum(axis=0).tolist(), strict=True)]
        rows = [(c, n[c], [Decimal(x // base) for x in sums[c]], [Decimal(x % base) for x in sums[c]]) for c in range(k) if n[c]]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        number = pa.list_(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], number), pa.array(columns[3], number)], ["cluster", "n", "high", "low"])

    parts = vectors.select("embedding").mapInArrow(run, "cluster int, n long, high array<decimal(38,0)>, low array<decimal(38,0)>")
    sums = [F.sum(F.get(name, F.lit(d))).alias(f"{name}{d}") for name in ("high", "low") for d in range(dimensions)]
    out = list(centroids)
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["cluster"]] = [(int(r[f"high{d}"]) * base + int(r[f"low{d}"])) // r["n"] for d in range(dimensions)]
    return out


def assign(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    dimensions = len(centroids[0])

    def run(batches):
        points = _table(centroids)
        for part, block in _blocks(batches, scale, dimensions):
            all_distances = distances(block, points)
            nearest = all_distances.argmin(axis=1)
            chosen = all_distances[np.arange(len(block)), nearest].tolist()
            near = pa.array([int(x) if x < 2**63 else None for x in chosen], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nearest.astype("int32")), near], ["vec_id", "cluster", "distance"])

    fields = [vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    return vectors.select("vec_id", "embedding").mapInArrow(run, T.StructType(fields))


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    own = stored(kept(vectors, dimensions), "cluster-vectors")
    centroids = first_centroids(own, clusters, seed, scale)
    if not centroids:
        fields = [own.schema["vec_id"]]
        fields += [T.StructField(n, t) for n, t in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType()))]
        return spark.createDataFrame([], T.StructType(fields))
    for _ in range(rounds):
        centroids = next_centroids(own, centroids, scale)
    assigned = stored(assign(own, centroids, scale), "cluster-assigned")
    whole = F.col("distance").cast("decimal(38,0)")
    sums = assigned.groupBy("cluster").agg(F.sum(whole).alias("s"), F.count("*").alias("n"), F.count("distance").alias("known")).collect()
    fits = lambda x: int(x) if x < 2**63 else None
    known = all(r["n"] == r["known"] for r in sums)
    total = fits(sum(r["s"] for r in sums)) if known else None
    rows = [(r["cluster"], fits(r["s"]) if r["n"] == r["known"] else None, total, digest(centroids[r["cluster"]])) for r in sums]
    # one row per cluster: at most ``clusters`` of them
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
