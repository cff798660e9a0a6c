"""Clustering against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from groundwork.llm.clustering import _encoded, cluster_vectors, digest

DDL = "vec_id long, embedding array<float>, id string, cluster string, n int, v string, order string"


def by_hand(rows, k, rounds, dims, scale):
    kept = []
    for name, vector in rows:
        if vector is not None and len(vector) == dims and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((name, [math.floor(float(np.float32(x)) * scale) for x in vector], [float(np.float32(x)) for x in vector]))

    def key(row):
        return (row[0] is None, hashlib.sha256(f"3:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[2])

    centres = [row[1] for row in sorted(kept, key=key)[:k]]

    def nearest(vector):
        return min((sum((a - b) ** 2 for a, b in zip(vector, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        at = [nearest(row[1])[1] for row in kept]
        for c in set(at):
            mine = [row[1] for row, place in zip(kept, at, strict=True) if place == c]
            centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    final = [(row[0], *nearest(row[1])) for row in kept]
    inertia = {c: sum(d for _, d, p in final if p == c) for _, _, c in final}
    return sorted(((n, c, d, inertia[c], sum(inertia.values()), centres[c]) for n, d, c in final), key=repr)


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(n, v, "x", "y", 1, "z", "o") for n, v in rows], DDL).repartition(parts)
    found, centres = cluster_vectors(df, **options)
    return sorted(((r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in found.collect()), key=repr), centres


def vectors(seed, n, dims, spread=1.0):
    pick = random.Random(seed)
    return [(i, [pick.gauss(0, spread) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("chunk,widest", [(16_384, 8), (7, 3), (1, 1)])
def test_clusters_match_brute_force(spark, chunk, widest):
    rows = vectors(1, 120, 6) + [(500 + i, [0.25, -0.5, 0.0, 1.0, 2.0, -3.0]) for i in range(60)] + [(1, [0.1] * 6), (1, [0.1] * 6), (None, [0.3] * 6)]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [None] + [1.0] * 5), (905, [float("nan")] * 6), (906, [float("inf")] * 6)]
    got, centres = run(spark, rows, k=5, rounds=4, dims=6, scale=16, chunk=chunk, widest=widest)
    assert got == by_hand(rows, 5, 4, 6, 16)
    assert {tuple(c) for c in centres} >= {tuple(r[5]) for r in got}


def test_ties_empty_clusters_and_few_vectors(spark):
    same = [(i, [0.5, -0.5]) for i in range(30)]
    got, centres = run(spark, same, k=4, rounds=2, dims=2, scale=8)
    assert got == by_hand(same, 4, 2, 2, 8) and {r[1] for r in got} == {0} and len(centres) == 4
    assert run(spark, same[:2], k=4, rounds=2, dims=2)[0] == by_hand(same[:2], 4, 2, 2, 1024)
    assert run(spark, [], dims=2) == ([], [])
    assert run(spark, [(1, None)], dims=2) == ([], [])


def test_dictionaries_lose_nothing():
    data = np.random.default_rng(5).integers(-3, 3, (400, 11))
    data[:, 8:] = np.arange(400)[:, None]
    back, blocks = np.empty_like(data), [b for at in (0, 8) for b in _encoded(data, at, min(8, 11 - at))]
    for at, width, entries, codes in blocks:
        back[:, at : at + width] = entries[codes]
        assert len(np.unique(entries, axis=0)) == len(entries)
    assert (back == data).all() and sum(b[1] for b in blocks) == 11


def test_large_components_raise_and_digests_are_stable(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        run(spark, [(1, [1e9, 0.0])], dims=2)
    with pytest.raises(ValueError):
        run(spark, [], dims=65)
    assert digest([1, -2]) == hashlib.sha256(b"1,-2").hexdigest()
