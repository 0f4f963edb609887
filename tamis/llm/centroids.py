"""Centroid clustering with dictionaries of subvectors.

Vectors are cut into blocks of dimensions, and every block is encoded without loss as a dictionary of the distinct subvectors that
occur and a code for each vector. A round computes the exact distance of every dictionary entry to every centroid's block once;
the distance of a vector is the sum of its codes' partial distances. Sums of components come from counts by code as well. All
arithmetic is on whole numbers, so results do not depend on partitions.

Dictionaries belong to chunks of CHUNK vectors, which one row of the written table holds: a round reads that table, moves K rows a
task, and never shuffles vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.session import written
from tamis.sources.loader import size_in_bytes

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Vectors in a chunk at most, which has dictionaries of its own.
CHUNK = 1 << 14
#: Bytes of an Arrow batch: a few chunks.
BATCH_BYTES = 32 << 20
#: Components are whole numbers up to this; larger ones count as this. Squared distances then fit in 64 bits.
LARGEST = 1 << 27
#: Widths of a block that are tried, widest first. A width is taken if the dictionaries hold at most this share of the subvectors.
WIDTHS, SHARE = (16, 8, 4, 2), 0.5
MOST = (1 << 63) - 1


def whole_components(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, x as a double."""
    top = float(LARGEST)
    return F.transform(
        vector, lambda x: F.floor(F.greatest(F.lit(-top), F.least(F.lit(top), x.cast("double") * scale))).cast("int")
    )


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has so many components, none missing, NaN or infinite."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, sound), F.lit(False))


def _dictionaries(vectors: np.ndarray) -> tuple[int, list[np.ndarray], np.ndarray]:
    """Width of the blocks, distinct subvectors of each block, and codes (vector, block)."""
    count, dimensions = vectors.shape
    for width in [w for w in WIDTHS if dimensions % w == 0] + [1]:
        tables, codes = [], np.empty((count, dimensions // width), np.uint16)
        for block in range(dimensions // width):
            part = np.ascontiguousarray(vectors[:, block * width : (block + 1) * width])
            keys = part.view(np.dtype((np.void, part.dtype.itemsize * width))).ravel() if width > 1 else part.ravel()
            _, first, codes[:, block] = np.unique(keys, return_index=True, return_inverse=True)
            tables.append(part[first])
            if width > 1 and block == 0 and len(first) > SHARE * count:
                break
        else:
            if width == 1 or sum(map(len, tables)) <= SHARE * count * len(tables):
                return width, tables, codes
    raise AssertionError("a width of one is always taken")


def _encoded(dimensions: int, chunk: int):
    """For mapInArrow: (id, vector) to rows of a chunk: ids, width, sizes of the dictionaries, their entries, codes."""

    def encode(ids: list, parts: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
        width, tables, codes = _dictionaries(np.concatenate(parts))
        named = pa.chunked_array(ids).combine_chunks()
        return pa.record_batch([
            pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), named),
            pa.array([width], pa.int32()), pa.array([[len(t) for t in tables]], pa.list_(pa.int32())),
            pa.array([np.concatenate(tables).astype("<i4").tobytes()], pa.binary()), pa.array([codes.astype("<u2").tobytes()], pa.binary()),
        ], names)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ids", "width", "sizes", "entries", "codes"]
        ids, parts, held = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, chunk - held)
                at, held = at + piece.num_rows, held + piece.num_rows
                ids.append(piece.column(0))
                parts.append(piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
                if held == chunk:
                    yield encode(ids, parts, names)
                    ids, parts, held = [], [], 0
        if held:
            yield encode(ids, parts, names)

    return encoded


def _chunk(row: dict) -> tuple[int, list[np.ndarray], np.ndarray]:
    """Width, dictionaries and codes of a chunk, as they were encoded."""
    width, sizes = row["width"], row["sizes"]
    entries = np.frombuffer(row["entries"], "<i4").astype(np.int64).reshape(-1, width)
    tables = np.split(entries, np.cumsum(sizes)[:-1])
    return width, tables, np.frombuffer(row["codes"], "<u2").reshape(-1, len(sizes))


def _nearest(width: int, tables: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (the smaller number if two are as near) and its squared distance."""
    distances = np.zeros((len(codes), len(centroids)), np.int64)
    for block, table in enumerate(tables):
        part = centroids[:, block * width : (block + 1) * width]
        partial = ((table[:, None, :] - part[None, :, :]) ** 2).sum(axis=2)  # once for each distinct subvector
        distances += partial[codes[:, block]]
    clusters = distances.argmin(axis=1)
    return clusters, distances[np.arange(len(codes)), clusters]


def _sums(centroids: np.ndarray):
    """For mapInArrow: chunks to the count and the sums of components of each cluster, one row a cluster and task."""
    kinds = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dimensions = centroids.shape
        counts, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                width, tables, codes = _chunk(row)
                clusters, _ = _nearest(width, tables, codes, centroids)
                counts += np.bincount(clusters, minlength=k)
                for block, table in enumerate(tables):
                    held = np.bincount(clusters * len(table) + codes[:, block], minlength=k * len(table)).reshape(k, len(table))
                    total[:, block * width : (block + 1) * width] += held @ table
        yield pa.record_batch([pa.array(range(k), pa.int32()), pa.array(counts), pa.array(total.tolist(), pa.list_(pa.int64()))], schema=kinds)

    return sums


def _assigned(centroids: np.ndarray):
    """For mapInArrow: chunks to (id, cluster, distance)."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for at, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                clusters, distances = _nearest(*_chunk(row), centroids)
                yield pa.record_batch([ids[at].values, pa.array(clusters, pa.int32()), pa.array(distances)], ["vec_id", "cluster", "distance"])

    return assigned


def _start(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hash of their id; of equal ids, the smaller vector first."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.select(F.sha2(name, 256).alias("hash"), "vector").sort("hash", "vector").head(clusters)
    return np.array([row["vector"] for row in first], np.int64)


def _moved(centroids: np.ndarray, chunks: DataFrame) -> np.ndarray:
    """Centroids after a round: the floor of their vectors' mean; an empty one stays. The driver gets a row for each cluster."""
    k, dimensions = centroids.shape
    found = chunks.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    # Sums of tasks may pass 64 bits together, not alone: a task has less than 2 ** 36 vectors.
    exact = T.DecimalType(38, 0)
    rows = found.groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[d].cast(exact)).alias(f"s{d}") for d in range(dimensions)]
    ).where("n > 0").collect()
    moved = centroids.copy()
    for row in rows:
        moved[row["cluster"]] = [int(row[f"s{d}"]) // row["n"] for d in range(dimensions)]
    return moved


def cluster(
    table: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, chunk: int = CHUNK,
) -> tuple[DataFrame, np.ndarray]:
    """The cluster of each vector (vec_id, cluster, distance), and the final centroids as an array of whole numbers.

    Components become floor(scale * x). Centroids start as the vectors with the smallest SHA-256 of ``seed:id``; each of
    ``rounds`` rounds assigns every vector to the nearest one (of two as near, the smaller number) and moves centroids to the floor
    of their vectors' mean.

    Vectors of another length or with a component that is missing, NaN or infinite are left out. A missing id is a valid id, with an
    empty name; repeated rows and ids are vectors of their own. Components beyond 2 ** 27 (x beyond 131,072) count as 2 ** 27. With
    fewer vectors than clusters there are as many clusters as vectors; an empty table gives no rows and no centroids. Other columns
    are ignored. Memory in a task follows ``chunk``, at most 2 ** 16.
    """
    if not 0 < chunk <= 1 << 16:
        raise ValueError("a chunk holds 1 to 65,536 vectors: codes have 16 bits")
    spark, setting = table.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(setting, str(min(BATCH_BYTES, size_in_bytes(spark.conf.get(setting)))))
    vectors = table.where(usable(F.col(vector_column), dimensions)).select(
        F.col(id_column).alias("vec_id"), whole_components(F.col(vector_column), scale).alias("vector")
    )
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    chunks = written(
        vectors.mapInArrow(_encoded(dimensions, chunk), f"ids array<{id_type}>, width int, sizes array<int>, entries binary, codes binary"),
        "vector-chunks",
    )
    centroids = _start(vectors, clusters, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), centroids
    for _ in range(rounds):
        centroids = _moved(centroids, chunks.select("width", "sizes", "entries", "codes"))
    return chunks.mapInArrow(_assigned(centroids), f"vec_id {id_type}, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Assignments and for each: distances summed over its cluster and over all, and the SHA-256 of its centroid's components.

    Sums beyond 64 bits are given as the largest 64-bit number.
    """
    assigned = written(assigned, "assigned")
    # One row for each cluster.
    sums = {row["cluster"]: int(row["summed"]) for row in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast(T.DecimalType(38, 0))).alias("summed")).collect()}
    of_cluster = lambda values: F.element_at(F.array(*[F.lit(value) for value in values]), F.col("cluster") + 1)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids] or [""]
    inertias = [min(MOST, sums.get(c, 0)) for c in range(max(1, len(centroids)))]
    return assigned.select(
        "*", of_cluster(inertias).cast("long").alias("cluster_inertia"), F.lit(min(MOST, sum(sums.values()))).cast("long").alias("inertia"),
        of_cluster(digests).alias("centroid_sha256"),
    )
