"""Mixing (4) and packing (5): invariants, brute force, edge cases."""

import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import TABLES
from typeloom.llm import mixing, packing

SCHEMA = "doc_id long, text string, source string, size long, k string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_targets(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    t = mixing.targets(sizes, weights)
    assert sum(t) == pytest.approx(sum(sizes))
    assert all(x <= 3 * s + 1e-6 for x, s in zip(t, sizes))
    open_ = [(x / w) for x, w, s in zip(t, weights, sizes) if x < 3 * s - 1e-6]
    assert not open_ or max(open_) == pytest.approx(min(open_))
    capped = [3 * s / w for x, w, s in zip(t, weights, sizes) if x >= 3 * s - 1e-6 and s]
    assert not open_ or not capped or max(capped) <= min(open_) + 1e-6


def check(rows, report):
    """Contract of the mix: sizes, targets, words taken."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(names, mixing.targets([sizes[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    of = {d: s for d, _, s in rows}
    taken = defaultdict(int)
    assert len(report) == len(rows)
    for r in report:
        s = of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(wanted[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert taken[s] == pytest.approx(wanted[s], abs=1)


def test_mix_of_the_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    report = mixing.mix_report(docs).collect()
    check([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], report)
    assert sorted(map(tuple, report)) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()))


@pytest.mark.parametrize("slots", [1, 7, 1 << 18])
def test_mix_of_skewed_sources(spark, slots):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 40)), s) for i, s in enumerate(rng.choice(["a", "b", None, "é", "Z", ""], 200, p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05]))]
    rows = [(i, t, None if s == "None" else s) for i, t, s in rows] + [(999, None, "empty"), (1000, "one", "tiny")]
    df = spark.createDataFrame([(i, t, s, 0, "x") for i, t, s in rows], SCHEMA)
    pieces, placed, _ = mixing.mix(df, slots=slots)
    check(rows, mixing.mix_report(df, slots=slots).collect())
    for r in pieces.collect():
        assert 0 <= r["start"] and r["start"] + r["length"] <= r["size"]


def test_schedule_is_even(spark):
    plan = [{"s": i, "want": w} for i, w in enumerate((100, 300, 600))]
    got = mixing.schedule(spark, plan, 1).orderBy("k").collect()
    assert len(got) == 1000
    counts = [0, 0, 0]
    for r in got:
        assert r["rank"] == counts[r["s"]]
        counts[r["s"]] += 1
        for c, share in zip(counts, (0.1, 0.3, 0.6)):
            assert abs(c - share * (r["k"] + 1)) < 4
    many = [{"s": i, "want": 10} for i in range(100)]
    assert mixing.schedule(spark, many, 1).groupBy("s").count().count() == 100


def test_mix_edges(spark):
    assert mixing.mix_report(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix_report(spark.createDataFrame([(1, "", "a", 0, "x"), (1, None, None, 0, "x")], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
    twice = mixing.mix_report(spark.createDataFrame([(1, "a b", "s", 0, "x")] * 2 + [(None, "c", "s", 0, "x")], SCHEMA)).collect()
    assert sorted(r["taken"] for r in twice) == [1, 2, 2]


def test_mixed_documents(spark):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2], 0, "x") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
    report = mixing.mix_report(df).collect()
    target = {("ab"[r["doc_id"] % 2]): r["target"] for r in report}
    assert all(abs(words[s] - t) <= 7 for s, t in target.items())


def test_the_mix_follows_the_schedule(spark):
    """Slots of the report are those of golden-ratio points ranked by hand, and mixed documents stand in their order."""
    rows = [(i, "w " * (i % 5 + 1), "abc"[i % 3], 0, "x") for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    pieces, placed, numbers = mixing.mix(df, slots=40)
    plan = sorted(numbers.collect(), key=lambda r: r["s"])
    total = sum(p["want"] for p in plan)
    block = max(1, total // 40)
    edges = np.cumsum([p["want"] for p in plan]) / total
    ranks, wanted = defaultdict(int), {}
    for k in range(-(-total // block)):
        s = min(int(np.searchsorted(edges, (k + 0.5) * mixing.INVERSE_PHI % 1.0, side="right")), len(plan) - 1)
        wanted[k] = (s, ranks[s])
        ranks[s] += 1
    got = {r["k"]: (r["s"], r["rank"]) for r in pieces.collect() if r["k"] in wanted}
    assert got and all(wanted[k] == v for k, v in got.items())
    # No source is left for long: of any run of slots each has its share.
    order = [wanted[k][0] for k in sorted(got)]
    assert all(abs(order[:n].count(p["s"]) - n * p["want"] / total) < 3 for n in range(1, len(order)) for p in plan)
    first = {}
    for r in pieces.collect():
        first[r["doc_id"], r["pass"]] = min(first.get((r["doc_id"], r["pass"]), 1 << 60), r["k"])
    report = {r["doc_id"]: r for r in mixing.mix_report(df, slots=40).collect()}
    assert all(report[d]["first_slot"] == min(k for (x, _), k in first.items() if x == d) for d, _ in first)
    mixed = [r["doc_id"] for r in mixing.mixed_documents(df, slots=40).collect()]
    seen, places = defaultdict(int), []
    for d in mixed:
        places.append(first[d, seen[d]])
        seen[d] += 1
    assert places == sorted(places) and len(mixed) > 100


def test_repeated_rows_and_clashing_names(spark):
    schema = "doc_id long, text string, source string, MIX_slot long, mix_id string, gone string, kept_id string"
    rows = [(1, "a b c", "s", 7, "m", "g", "k")] * 3 + [(1, "d e f", "s", 8, "m", "g", "k"), (2, "x y z", "t", 9, "m", "g", "k"), (None, "n o p", "t", 9, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    taken = defaultdict(int)
    for r in out.collect():
        taken[r["doc_id"], r["text"], r["MIX_slot"]] += 1
    report = defaultdict(int)
    for r in mixing.mix_report(df).collect():
        report[r["doc_id"]] += r["taken"]
    assert sum(taken.values()) * 3 == pytest.approx(sum(report.values()), abs=6)
    assert taken[1, "a b c", 7] <= 9 and taken[2, "x y z", 9] >= 1


# --- packing ----------------------------------------------------------------------------


@given(st.lists(st.integers(1, 100), max_size=120))
@settings(max_examples=200, deadline=None)
def test_packing_invariants(sizes):
    sizes = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    bins, offsets, caps = packing.pack(sizes, (25, 50, 100))
    for b in range(len(caps)):
        own = sorted((offsets[i], sizes[i]) for i in np.flatnonzero(bins == b))
        assert [o for o, _ in own] == [0, *np.cumsum([s for _, s in own])[:-1]]
        full = sum(s for _, s in own)
        assert full <= caps[b] and not any(full <= c < caps[b] for c in (25, 50, 100))


@given(st.lists(st.integers(1, 100), max_size=60))
@settings(max_examples=100, deadline=None)
def test_packing_against_brute_force(sizes):
    """Every open bin is looked at for every piece."""
    sizes, capacities = sorted(sizes, reverse=True), (25, 50, 100)
    bins, left = [], sum(sizes)  # room, contents
    for n in sizes:
        left -= n
        fits = [b for b in bins if b[0] >= n]
        if fits:
            best = min(fits, key=lambda b: b[0])
        else:
            cost = {c: (64 + c + c * c / 16384) / (n + min(c - n, left)) for c in capacities if c >= n}
            best = [min(cost, key=lambda c: (cost[c], c)), 0]
            bins.append(best)
        best[0] -= n
        best[1] += n
    wanted = sorted((min(c for c in capacities if c >= held), held) for _, held in bins)
    of, _, caps = packing.pack(np.array(sizes, dtype=np.int64), capacities)
    held = np.bincount(of, sizes, minlength=len(caps)) if sizes else []
    assert sorted(zip(caps.tolist(), map(int, held), strict=True)) == wanted


def test_best_fit_takes_the_tightest_bin():
    bins, _, _ = packing.pack(np.array([60, 50, 45, 40, 5]), (100,))
    assert bins.tolist() == [0, 1, 1, 0, 1]


def test_bins_are_well_filled():
    sizes = np.sort(np.random.default_rng(0).integers(1, 4000, 3000))[::-1]
    bins, _, caps = packing.pack(sizes, (512, 1024, 2048, 4096, 8192))
    assert sizes.sum() / caps.sum() > 0.97


def test_documents_are_packed_whole(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    sizes = {r["doc_id"]: len(WORD.findall(r["text"])) for r in docs.collect()}
    got = packing.best_fit_packing(docs, capacities=(64, 256, 1024), shard_rows=70).collect()
    covered = defaultdict(list)
    held = defaultdict(list)
    for r in got:
        covered[r["doc_id"]].append((r["start"], r["length"]))
        if r["bin"]:
            held[r["bin"], r["capacity"]].append((r["bin_offset"], r["length"]))
    for d, n in sizes.items():
        at = 0
        for start, length in sorted(covered[d]):
            assert start == at
            at += length
        assert at == n
    for (_, cap), own in held.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= cap and (cap == 64 or at > {256: 64, 1024: 256}[cap])
    assert len(held) == len({b for b, _ in held})


def test_packing_edges(spark):
    rows = [(1, None, "s", 0, "k"), (2, " ", "s", 0, "k"), (3, "a b", "s", 0, "k"), (3, "a b", "s", 0, "k"), (None, "c", "s", 0, "k")]
    got = packing.best_fit_packing(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and sum(r["bin"] is None for r in got) == 2 and sum(r["length"] for r in got) == 5
    assert packing.best_fit_packing(spark.createDataFrame([], SCHEMA)).count() == 0
