import hashlib
import math

import numpy as np
import pytest

from tamis.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long, vector string, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 9, 8, "v", 7) for i, v in rows], SCHEMA)


def brute(rows, clusters, rounds, dimensions):
    """(vec_id, cluster, distance) and centroids in plain Python, vector by vector."""
    kept = []
    for name, vector in rows:
        if vector is not None and len(vector) == dimensions and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((name, [max(-(1 << 27), min(1 << 27, math.floor(float(np.float32(x)) * 1024))) for x in vector]))
    hashed = sorted((hashlib.sha256(f"3:{'' if n is None else n}".encode()).hexdigest(), v) for n, v in kept)
    centres = [v for _, v in hashed[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(column) // len(groups[k]) for column in zip(*groups[k])] if k in groups else c for k, c in enumerate(centres)]
    found = [(n, nearest(v)[1], nearest(v)[0]) for n, v in kept]
    return sorted(found, key=str), centres


@pytest.mark.parametrize("kind", ["spread", "few values", "copies"])
@pytest.mark.parametrize("chunk", [7, 1 << 15])
def test_clusters_equal_brute_force(spark, kind, chunk):
    rng = np.random.default_rng(5)
    vectors = {
        "spread": rng.normal(size=(120, 8)), "few values": rng.integers(-2, 3, size=(150, 8)) / 4,
        "copies": np.repeat(rng.normal(size=(5, 8)), 30, axis=0),
    }[kind].astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    found, centres = centroids.cluster(table(spark, rows).repartition(5), clusters=4, rounds=6, dimensions=8, chunk=chunk)
    expected, expected_centres = brute(rows, 4, 6, 8)
    assert sorted([tuple(r) for r in found.collect()], key=str) == expected
    assert centres.tolist() == expected_centres


def test_dictionaries_are_lossless_and_as_wide_as_repeats_allow():
    rng = np.random.default_rng(1)
    for vectors, width in ((np.repeat(rng.integers(-500, 500, (3, 32)), 40, axis=0), 16), (rng.integers(0, 3, (400, 32)), 4), (rng.integers(-10**8, 10**8, (50, 32)), 1)):
        found, tables, codes = centroids._dictionaries(vectors.astype(np.int32))
        assert found == width and len(tables) == 32 // width
        assert all(len(np.unique(t, axis=0)) == len(t) for t in tables)
        assert np.array_equal(np.concatenate([t[codes[:, b]] for b, t in enumerate(tables)], axis=1), vectors)


def test_odd_vectors(spark):
    good = [float(x) for x in range(4)]
    rows = [
        (1, good), (2, None), (3, []), (4, [0.0, None, 1.0, 2.0]), (5, [0.0, float("nan"), 1.0, 2.0]), (6, [0.0, float("inf"), 1.0, 2.0]),
        (7, good[:3]), (None, good), (1, good), (8, [3e38, -3e38, 0.0, -0.0]), (9, [-0.0001, 0.0001, 1.0, 2.0]),
    ]
    found, centres = centroids.cluster(table(spark, rows), clusters=3, rounds=2, dimensions=4)
    expected, expected_centres = brute(rows, 3, 2, 4)
    assert sorted([tuple(r) for r in found.collect()], key=str) == expected
    assert centres.tolist() == expected_centres
    whole = centroids.with_inertia(found, centres).collect()
    assert len(whole) == 5 and {r.inertia for r in whole} == {sum(r.distance for r in whole)}
    for r in whole:
        assert r.cluster_inertia == sum(x.distance for x in whole if x.cluster == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, expected_centres[r.cluster])).encode()).hexdigest()


def test_fewer_vectors_than_clusters_and_none(spark):
    found, centres = centroids.cluster(table(spark, [(1, [0.0, 1.0]), (2, [5.0, 1.0])]), dimensions=2)
    assert len(centres) == 2 and {r.distance for r in found.collect()} == {0}
    for rows in ([], [(1, None), (2, [1.0])]):
        found, centres = centroids.cluster(table(spark, rows), dimensions=2)
        assert len(centres) == 0 and centroids.with_inertia(found, centres).collect() == []
        assert centroids.with_inertia(found, centres).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError):
        centroids.cluster(table(spark, []), chunk=1 << 17)


def test_names_may_be_text(spark):
    named = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [4.0, 4.0]), ("c", [4.0, 4.1])], "name string, v array<double>")
    found, _ = centroids.cluster(named, id_column="name", vector_column="v", clusters=2, dimensions=2)
    clusters = {r.vec_id: r.cluster for r in found.collect()}
    assert clusters["b"] == clusters["c"] != clusters["a"]
