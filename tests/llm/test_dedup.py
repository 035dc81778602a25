"""SimHash (1) and exact dedup (9) against brute force, and their edge cases."""

import hashlib

import numpy as np
import pytest
import xxhash

from tests.conftest import TABLES
from typeloom.llm import digest_index, simhash

SCHEMA = "doc_id long, text string, fp long, id long, root string"


def plain_fingerprint(text, words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    w = [x for x in lower.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) <= words else [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=3):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def test_fingerprints():
    for text in ("", None, "a", "A b", "one two three four five", "Ünï x \x0b y\rz", "a a a a a a", "x" * 5000):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("partitions", [None, 2, 3, 4])
def test_components_against_brute_force(spark, partitions):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(300)
    rows = docs.select("doc_id", "text").collect()
    near = [(10_000 + r["doc_id"], r["text"].replace(" ", "  ", 3) + (" x" if i % 2 else "")) for i, r in enumerate(rows[:60])]
    data = [(r["doc_id"], r["text"]) for r in rows] + near
    got = {r["doc_id"]: r for r in simhash.simhash_near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), partitions=partitions).collect()}
    fps = [plain_fingerprint(t) for _, t in data]
    assert [got[d]["fingerprint"] for d, _ in data] == [f"{f:016x}" for f in fps]
    wanted = brute_components([d for d, _ in data], fps)
    assert {d: r["component_id"] for d, r in got.items()} == wanted


def test_pigeonhole_with_skewed_values(spark):
    """Many fingerprints share three of four parts; every link must be found."""
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 12, 150), rng.integers(-(1 << 62), 1 << 62, 100)])).astype(np.int64)
    nodes = spark.createDataFrame([(int(f), int(f), int(f)) for f in fps], "fp long, id long, comp long")
    for radius in (3, 5):
        u = fps.view(np.uint64)
        near = np.argwhere(np.bitwise_count(u[:, None] ^ u[None]) <= radius)
        wanted = {(int(min(fps[i], fps[j])), int(max(fps[i], fps[j]))) for i, j in near if i != j}
        got = [(r["a"], r["b"]) for r in simhash.links(nodes, radius).collect()]
        assert set(got) == wanted and len(got) == len(wanted)


def test_thresholds_sum_and_cost_least():
    costs = [np.array([[0, 0], [5, 1], [9, 2], [20, 3], [30, 4]], dtype=float) for _ in range(4)]
    t = simhash.allocate(costs, 0)
    assert (t.sum(axis=1) == 0).all() and (t >= -1).all()
    for k in (0, 1):
        every = [[x - 1 for x in v] for v in np.ndindex(5, 5, 5, 5) if sum(v) == 4]
        least = min(sum(c[x + 1][k] for c, x in zip(costs, v, strict=True)) for v in every)
        assert sum(c[x + 1][k] for c, x in zip(costs, t[k], strict=True)) == least


def test_near_duplicate_edges(spark):
    rows = [(1, None, 9, 9, "r"), (2, "", 9, 9, "r"), (3, "b", 9, 9, None), (3, "b", 9, 9, None), (None, "b", 1, 1, None), (None, "zz top", 1, 1, None)]
    got = [tuple(r) for r in simhash.simhash_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == 6
    assert {c for d, f, c in got if f == "0" * 16} == {1}
    assert {c for d, f, c in got if d == 3} == {3} and (None, f"{plain_fingerprint('b'):016x}", 3) in got
    assert [c for d, f, c in got if f == f"{plain_fingerprint('zz top'):016x}"] == [None]
    assert simhash.simhash_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_near_group_stays(spark):
    base = [f"w{i}" for i in range(200)]
    other = [f"v{i}" for i in range(200)]
    edit = base.copy()
    edit[50] = "changed"
    far = base[:100] + other[:100]
    rows = [(5, " ".join(base)), (7, " ".join(edit)), (8, " ".join(base).upper()), (9, " ".join(other)), (10, " ".join(far)), (None, "n"), (11, None), (12, "")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {5, 9, 10, 11, None}
    assert kept.columns == ["doc_id", "text"]
    assert simhash.drop_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_parity_bitmaps_rule_out_no_similar_pair():
    rng = np.random.default_rng(2)
    for n in (3, 40, 900, 5000):
        for _ in range(20):
            both, one, other = rng.integers(0, 1 << 63, n, dtype=np.uint64), *(rng.integers(0, 1 << 63, int(rng.integers(0, n)), dtype=np.uint64) for _ in range(2))
            a, b = np.unique(np.concatenate([both, one])), np.unique(np.concatenate([both, other]))
            apart = sum((x ^ y).bit_count() for x, y in zip(*(np.array(simhash.parities(x)).view(np.uint64).tolist() for x in (a, b)), strict=True))
            assert apart <= len(np.setxor1d(a, b))
    assert simhash.parities(np.zeros(0, np.uint64)) == [0] * simhash.PARITY and simhash.majority(np.zeros(0, np.uint64)) == 0
    assert simhash.majority(np.array([5], np.uint64)) == 5


@pytest.mark.parametrize("one_task", [0, 100_000])
def test_components_of_chains_and_stars(spark, one_task):
    from typeloom.llm.shared import components

    edges = [(i, i + 1) for i in range(100)] + [(500, x) for x in range(600, 700)] + [(3, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7), one_task=one_task).collect()}
    assert all(got[i] == 0 for i in range(1, 101)) and all(got[i] == 500 for i in range(600, 700))


# --- exact dedup --------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [{}, {"hot_rows": 1, "hot_share": 100}])
def test_exact_against_brute_force(spark, hot):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    best, size = {}, {}
    for r in rows:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
        size[r["text"]] = size.get(r["text"], 0) + 1
    got = {r["doc_id"]: r for r in digest_index.exact_dedup(docs, **hot).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, t = got[r["doc_id"]], r["text"]
        assert (g["keep_id"], g["group_size"], g["kept"], g["text_sha256"]) == (best[t], size[t], r["doc_id"] == best[t], hashlib.sha256(t.encode()).hexdigest())


def test_exact_edges(spark):
    rows = [(1, None, 0, 0, "r"), (4, "", 0, 0, "r"), (None, "", 0, 0, "r"), (5, "a", 0, 0, "r"), (5, "a", 0, 0, "r"), (None, "only", 0, 0, "r"), (6, "A", 0, 0, "r")]
    got = digest_index.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    by = sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])) for r in got)
    wanted = [(1, 4, 3, False), (4, 4, 3, True), (None, 4, 3, False), (5, 5, 2, True), (5, 5, 2, True), (None, None, 1, True), (6, 6, 1, True)]
    assert by == sorted(map(str, wanted))
    assert digest_index.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert digest_index.drop_exact_duplicates(spark.createDataFrame(rows[:5], SCHEMA)).columns == ["doc_id", "text", "fp", "id", "root"]


def test_the_index_persists(spark, tmp_path):
    place = f"file://{tmp_path}/index"
    first = digest_index.DigestIndex(spark, place)
    digest_index.exact_dedup(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string"), first).collect()
    first.drop()
    again = digest_index.DigestIndex(spark, place)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in digest_index.exact_dedup(spark.createDataFrame([(9, "a"), (8, "c")], "doc_id long, text string"), again).collect()}
    assert got == {9: (2, False), 8: (8, True)}
    assert {r["keep_id"] for r in again.rows().collect()} == {2, 3, 8}


def test_all_similar_pairs_are_found(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        changed = [*words[:30], f"other{i}", *words[31:]]  # 51 of 61 shingles shared
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
    got = {(r["root"], r["id"]) for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["root"] != r["id"]}
    assert got == {(2 * i, 2 * i + 1) for i in range(150)}


def test_large_near_group_and_equal_sets(spark):
    base = [f"w{x}" for x in range(100)]
    rows = [(i, " ".join([*base[: 5 + i % 90], f"x{i}", *base[6 + i % 90 :]])) for i in range(120)]
    rows += [(500 + i, "A  few words" + " " * i) for i in range(3)] + [(600, None), (601, " ")]
    got = {r["id"]: r["root"] for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["root"] != r["id"]}
    assert got == {i: 0 for i in range(1, 120)} | {501: 500, 502: 500, 601: 600}


def test_links_are_verified_on_whole_texts(spark):
    rows, wanted = [], set()
    for i in range(40):
        words = [f"t{i}w{x}" for x in range(4000)]
        # A run of changed words leaves 3996 - c - 4 shared shingles: similarity 0.81 for even i, 0.79 for odd i.
        c = 415 if i % 2 == 0 else 465
        other = words[:1000] + [f"t{i}y{x}" for x in range(c)] + words[1000 + c :]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        if simhash.jaccard(simhash.shingle_set(rows[-2][1]), simhash.shingle_set(rows[-1][1])) >= 0.8:
            wanted.add((2 * i, 2 * i + 1))
    assert wanted == {(2 * i, 2 * i + 1) for i in range(0, 40, 2)}
    got = {(r["root"], r["id"]) for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["root"] != r["id"]}
    assert got == wanted
