"""Nearest neighbours (10): recall and exact scores against brute force, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeloom.llm import stable_projection as sp

SCHEMA = "vec_id long, embedding array<float>, ids string, v string"


def brute(ids, x, q, k):
    s = x @ x[ids.index(q)]
    own = [i for i in range(len(ids)) if ids[i] != q]
    own.sort(key=lambda i: (-s[i], ids[i]))
    return [(ids[i], s[i]) for i in own[:k]]


def test_far_projected_neighbours_are_not_verified():
    """On vectors without clusters the stopping test leaves most of them alone, and finds the nearest."""
    import pyarrow.parquet as pq

    x = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), dtype=float)
    longest, k = np.sqrt((x * x).sum(axis=1)).max(), 20
    space, c = sp.Space(x.shape[1], longest, 24, 42), sp.chi_square_quantile(0.9, 24)
    queries = x[::20]
    found = sp.search(x, np.arange(len(x)), queries, np.full(len(queries), np.inf), space, k, c, 128)
    share = np.mean([n for _, _, n in found]) / len(x)
    wanted = [set(np.lexsort((np.arange(len(x)), -(x @ q)))[:k]) for q in queries]
    recall = np.mean([len(set(at.tolist()) & w) / k for (at, _, _), w in zip(found, wanted, strict=True)])
    every = sp.search(x, np.arange(len(x)), queries[:3], np.full(3, np.inf), space, k, np.inf, 128)
    assert share < 0.62 and recall >= 0.9 and all(n == len(x) for _, _, n in every), (share, recall)


@pytest.mark.parametrize("options", [{}, {"cell_rows": 300, "chunk_rows": 200, "leaf_rows": 32}])
def test_recall_and_scores(spark, options):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=float)
    got = {}
    for r in sp.nearest(e, F.col("vec_id") % 20 == 0, **options).collect():
        got.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        own = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        s = x @ x[ids.index(q)]
        assert all(r["score"] == pytest.approx(s[ids.index(r["vec_id"])], rel=1e-12) for r in own)
        hits += len({r["vec_id"] for r in own} & {i for i, _ in brute(ids, x, q, 20)})
        total += 20
    assert hits / total >= 0.9


def test_lengths_differ(spark):
    """The inner product prefers long vectors, and the search follows it."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 6)) * rng.uniform(0.2, 5, (400, 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in sp.nearest(df, F.col("vec_id") % 20 == 0, k=5, cell_rows=50, leaf_rows=8).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    ids, x = list(range(400)), x.astype(float)
    assert np.mean([len(got[q] & {i for i, _ in brute(ids, x, q, 5)}) / 5 for q in range(0, 400, 20)]) >= 0.9


def test_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [float("inf"), 1.0]), (20, [2.0, 1.0]), (9, [1.0]), (None, [5.0, 5.0]), (3, [0.0, 1.0]), (40, None), (60, [])]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    got = sp.nearest(df, F.col("vec_id") % 20 == 0, k=3)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert by == {0: [(1, 20, 2.0), (2, 1, 1.0), (3, 2, 1.0)], 20: [(1, 0, 2.0), (2, 1, 2.0), (3, 2, 2.0)]}
    every = sp.nearest(df, F.col("vec_id") % 20 == 0, k=50).filter("query_id = 0").count()
    assert every == 4
    assert sp.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert sp.nearest(df.filter("vec_id in (4, 5)"), F.col("vec_id") % 20 == 0).count() == 0
    assert sp.nearest(df.filter("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, [float(i), 1.0, 0.0]) for i in range(30)]
    got = sp.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 100, k=20).orderBy("rank").collect()
    wanted = sorted([(-(sum(a * b for a, b in zip(v, (1.0, 2.0, 3.0)))), i) for i, v in rows if i != 100])[:20]
    assert [(-r["score"], r["vec_id"]) for r in got] == wanted


def test_chi_square():
    assert sp.chi_square_quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
    assert sp.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_tree_cells_hold_their_points():
    pts = np.random.default_rng(0).standard_normal((500, 3))
    tree = sp.KdTree(pts, 16)
    cell = tree.cell_of(pts)
    for c, members in enumerate(tree.members):
        assert set(np.flatnonzero(cell == c)) == set(members)
    assert all(tree.distances(p)[c] == 0 for p, c in zip(pts[:50], cell[:50]))
    assert len(sp.KdTree(np.zeros((10, 2)), 4).members) == 1
