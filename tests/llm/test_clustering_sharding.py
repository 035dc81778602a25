"""Sort-means (11) and the hash tree (13): brute force, what is skipped, what moves, edge cases."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeloom.llm import hash_tree as ht
from typeloom.llm import sort_means as sm


def brute(rows, k, rounds, scale=1024.0, seed=3):
    """Plain k-means with exact integers: every distance is computed."""
    x = [[int(np.floor(a * scale)) for a in v] for _, v in rows]
    first = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), x[i]))[:k]
    c = [x[i] for i in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for v in x]

    for _ in range(rounds):
        of = assign()
        for j in range(len(c)):
            own = [v for v, (_, n) in zip(x, of, strict=True) if n == j]
            if own:
                c[j] = [sum(t) // len(own) for t in zip(*own, strict=True)]
    of = assign()
    total = sum(d for d, _ in of)
    by = {j: sum(d for d, n in of if n == j) for j in range(len(c))}
    return sorted((repr(i), n, d, by[n], total, hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(rows, of, strict=True))


def got(df):
    return sorted((repr(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_sort_means_with_ties(spark):
    """A coarse grid has many equal distances, and centroids at exactly twice the distance."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(a) for a in rng.integers(-2, 3, 3)]) for i in range(120)] + [(7, [0.0, 0.0, 0.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k, rounds in ((5, 10), (1, 3), (200, 2), (6, 0)):
        assert got(sm.sort_means(df, dims=3, k=k, rounds=rounds, scale=1)) == brute(rows, k, rounds, 1.0), (k, rounds)


def test_scan_stops_strictly_beyond_twice():
    c = np.array([[0], [4], [9], [-4], [2]])
    order = sm.Order(c)
    x = np.array([[0], [2], [-2], [1]])
    best, least, computed = order.assign(x, np.array([1, 1, 3, 0]))
    # -2 lies between 0 and -4, 1 between 0 and 2: the smaller number wins, and the tie is at exactly twice the distance.
    assert best.tolist() == [0, 4, 0, 0] and least.tolist() == [0, 0, 4, 1]
    assert computed < x.size * len(c)


def test_scan_skips_on_given_vectors(spark):
    """With centroids that have settled, most distances are never computed where clusters are apart."""
    rng = np.random.default_rng(1)
    middles = rng.integers(-3000, 3000, (16, 8))
    x = np.repeat(middles, 50, axis=0) + rng.integers(-100, 100, (800, 8))
    best, _, computed = sm.Order(middles).assign(x, np.repeat(np.arange(16), 50))
    assert best.tolist() == np.repeat(np.arange(16), 50).tolist() and computed < 2 * len(x)


def test_sort_means_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0]), (None, [3.0, -1.0]), (8, []), (9, [0.5, 0.25]), (9, [-0.5, 0.25])]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, cluster int, v string")
    kept = [r for r in rows if r[1] and len(r[1]) == 2 and all(a is not None and np.isfinite(a) for a in r[1])]
    assert got(sm.sort_means(df, dims=2, k=3)) == brute(kept, 3, 10)
    assert sm.sort_means(df.limit(0), dims=2).collect() == [] and sm.sort_means(df.filter("vec_id = 2"), dims=2).collect() == []
    with pytest.raises(OverflowError):
        sm.sort_means(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), dims=1)


ROWS = [(i, "x" * (i % 7)) for i in range(3000)]


def where(spark, tree):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return {r[0]: r[1] for r in df.select("doc_id", tree.place(F.col("doc_id").cast("string"))).collect()}


def test_new_shard_takes_rows_only_into_itself(spark):
    tree = ht.Tree.even(8)
    for _ in range(3):
        before, after = where(spark, tree), where(spark, tree.grown())
        moved = {i for i in before if before[i] != after[i]}
        new = len(tree.shards)
        assert {after[i] for i in moved} == {new} and moved
        assert abs(len(moved) / len(before) - 1 / (new + 1)) < 0.03
        tree = tree.grown()


def test_movement_stays_in_subtrees_whose_weight_changes(spark):
    tree = ht.Tree.even(8)
    of = {s.number: (s.region, s.rack) for s in tree.shards}
    before, heavier = where(spark, tree), where(spark, tree.weighted(5, 3.0))
    moved = [(before[i], heavier[i]) for i in before if before[i] != heavier[i]]
    assert moved
    for a, b in moved:  # into the region; inside it into the rack; inside that into the shard
        assert of[b][0] == of[5][0]
        assert of[a][0] != of[b][0] or of[b] == of[5]
        assert of[a] != of[b] or b == 5
    without = where(spark, tree.weighted(5, 0))
    assert all(without[i] != 5 for i in without)
    for i in before:
        if before[i] != without[i]:
            assert of[before[i]][0] == of[5][0]


def test_weights_are_met(spark):
    tree = ht.Tree((ht.Shard(0, "a", "x", 1), ht.Shard(1, "a", "y", 2), ht.Shard(2, "b", "x", 5)))
    shards = list(where(spark, tree).values())
    for s in tree.shards:
        assert abs(shards.count(s.number) / len(shards) - s.weight / 8) < 0.03


def test_report(spark, tmp_path):
    texts = [None, "", "é" * 3, "word " * 5000, "copy", "copy"]
    rows = [(i, t, "a", "b", 1) for i, t in enumerate(texts)] + [(4, "copy", "a", "b", 1), (None, "n", "a", "b", 1), (None, None, "a", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, part string, shard int")
    out = ht.shard_report(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
        if r["doc_id"] is not None:
            t = (texts[r["doc_id"]] or "").encode()
            assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
    for shard in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    assert len({r["shard"] for r in out if r["doc_id"] == 4}) == 1
    assert ht.shard_report(df.limit(0)).collect() == []
    ht.write_shards(df, str(tmp_path / "out"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    by_id = {r["doc_id"]: r["shard"] for r in out}
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["key"], r["part"], r["shard"]) for r in back.collect()))) == sorted(map(repr, rows))
    assert all(int(r["shard_"]) == by_id[r["doc_id"]] for r in back.collect())
