"""SimHash near-duplicates by the general pigeonhole principle (operator 1).

A document's 64-bit fingerprint is the majority vote of the XXH64 hashes of its word
shingles. Two fingerprints are linked if at most ``radius`` bits differ, and linked
documents form components.

Finding the links: the bits are grouped into ``m`` partitions, correlated bits together,
which leaves the partitions independent and so selective. If two fingerprints differ in
at most ``radius`` bits, then for any thresholds T_1..T_m (each at least -1, where -1
means "not probed") that sum to ``radius - m + 1`` there is a partition i in which they
differ in at most T_i bits. Every fingerprint gets thresholds of its own by dynamic
programming over the candidates that each choice is expected to cost, so a partition value
that a third of all fingerprints share is not probed by those that have it.

Defined cases: a null or empty text has fingerprint zero and is linked like any other;
repeated rows and copies share a fingerprint; rows with a null id join a component but
never name it (a component without ids has a null id); an empty table gives an empty
result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER_BYTES, components, cut, remove_folder, shared_dir, unused

BITS = 64
_BYTE_AT = np.arange(8) * 256
_BIT_OF_BYTE = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    tokens = (text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    by_byte = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    ones = (by_byte @ _BIT_OF_BYTE).ravel()
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, fp long)`` of every row; whole texts, in batches."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, fp long")


# --- statistics of all fingerprints -----------------------------------------------------


def _bit_pairs(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often bits i and j are both set: 64 x 64 sums."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS), dtype=np.int64)
        for batch in batches:
            x = _unpacked(np.asarray(batch.column(0), dtype=np.int64)).astype(np.float64)
            n, both = n + len(x), both + (x.T @ x).astype(np.int64)
        at = np.arange(BITS * BITS, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(both.ravel(), n))], names=["at", "n"])

    rows = fps.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    total = 0
    for r in rows:
        if r["at"] < 0:
            total = r["n"]
        else:
            both[r["at"]] = r["n"]
    return total, both.reshape(BITS, BITS)


def _unpacked(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in ``m`` groups of near-equal size, each grown around its most correlated bits."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for size in [len(x) for x in np.array_split(np.arange(BITS), m)]:
        seed = max(free, key=lambda b: (corr[b, free].sum(), -b))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def choose_partitions(n: int, radius: int, probe_cost: float = 20.0) -> int:
    """The number of partitions with the least estimated cost for ``n`` fingerprints.

    A probe or index row costs ``probe_cost`` candidate checks. Few distinct values are
    cheap to match on short partitions; at 10^10 the 32-bit halves win.
    """

    def cost(m):
        slack, width = radius - m + 1, BITS / m
        probes = m + slack * width if slack <= m else m * width ** (slack / m)
        return probe_cost * (m + probes) + n * probes / 2.0**width

    return min(range(2, radius + 2), key=lambda m: (cost(m), m))


def values_of(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of ``group`` of every fingerprint as one integer."""
    fps, out = fps.view(np.uint64), np.zeros(len(fps), dtype=np.int64)
    for k, b in enumerate(group):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


#: Cells of the table that estimates how many fingerprints have a partition value: exact up
#: to 16 bits, hashed (an upper estimate) beyond. Its size is fixed, whatever the input.
CELLS = 1 << 16


def _cell(values: np.ndarray, width: int) -> np.ndarray:
    return values if width <= 16 else ((values * np.int64(0x9E3779B97F4A7C1 | 1)) >> np.int64(20)) & np.int64(CELLS - 1)


def _histograms(fps: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """Fingerprints by partition and cell, m x 65536 counts summed over the cluster."""

    def run(batches):
        held = np.zeros((len(groups), CELLS), dtype=np.int64)
        for batch in batches:
            f = np.asarray(batch.column(0), dtype=np.int64)
            for i, g in enumerate(groups):
                held[i] += np.bincount(_cell(values_of(f, g), len(g)), minlength=CELLS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held.ravel()[at])], names=["at", "n"])

    summed = fps.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(groups) * CELLS, dtype=np.int64)
    out[np.asarray(summed["at"])] = np.asarray(summed["n"])
    return out.reshape(len(groups), CELLS)


def ball_sizes(hist: np.ndarray, width: int, radius: int, n: int) -> np.ndarray:
    """Expected candidates by threshold -1..radius (rows) and cell, from the counts of all fingerprints."""
    out = np.zeros((radius + 2, CELLS))
    out[1] = hist
    if width <= 16:  # exact: spheres on the cube by the recurrence N(S_t) = (t+1) S_(t+1) + (w-t+1) S_(t-1)
        cells = np.arange(CELLS) & ((1 << width) - 1)
        spheres = [hist.astype(float)]
        for t in range(radius):
            around = sum(spheres[t][cells ^ (1 << b)] for b in range(width))
            before = (width - t + 1) * spheres[t - 1] if t else 0
            spheres.append((around - before) / (t + 1))
            out[t + 2] = out[t + 1] + spheres[-1]
    else:
        ball = 1
        for t in range(1, radius + 1):
            ball = ball * (width - t + 1) / t
            out[t + 1] = out[t] + n * ball / 2.0**width
    return out


def allocate(costs: list[np.ndarray], slack: int) -> np.ndarray:
    """Thresholds of least total cost that sum to ``slack``, by dynamic programming.

    ``costs[i]`` is (thresholds -1..radius) x fingerprints. Returns fingerprints x m.
    """
    m, (levels, n) = len(costs), costs[0].shape
    low, high = -m, slack + m
    best = np.full((high - low + 1, n), np.inf)
    best[-low] = 0
    took = []
    for c in costs:
        new, choice = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int8)
        for t in range(-1, levels - 1):
            for s in range(low, high + 1):
                if low <= s - t <= high:
                    cost = best[s - t - low] + c[t + 1]
                    better = cost < new[s - low]
                    new[s - low][better] = cost[better]
                    choice[s - low][better] = t
        best = new
        took.append(choice)
    out, at = np.zeros((n, m), dtype=np.int8), np.full(n, slack)
    for i in range(m - 1, -1, -1):
        out[:, i] = took[i][at - low, np.arange(n)]
        at = at - out[:, i]
    return out


def _masks(width: int, t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)], dtype=np.int64)


def links(nodes: DataFrame, radius: int = 3, partitions: int | None = None) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of ids of ``nodes(fp, id, comp)`` whose fingerprints differ in at most ``radius`` bits.

    Pairs within one ``comp`` are left out: they are connected already.
    """
    spark, fps = nodes.sparkSession, nodes.select("fp")
    n, both = _bit_pairs(fps)
    m = partitions or choose_partitions(n, radius)
    groups = group_bits(n, both, m)
    slack = radius - m + 1
    hist = _histograms(fps, groups)
    probes = np.array([[0] + [sum(comb(len(g), k) for k in range(t + 1)) for t in range(radius + 1)] for g in groups], dtype=np.float32)
    tables = spark.sparkContext.broadcast([ball_sizes(hist[i], len(g), radius, n).astype(np.float32) for i, g in enumerate(groups)])

    def index(batches):
        for batch in batches:
            f = np.asarray(batch.column(0), dtype=np.int64)
            for i, g in enumerate(groups):
                yield _keyed(batch, None, i, values_of(f, g))

    def probe(batches):
        for batch in batches:
            f = np.asarray(batch.column(0), dtype=np.int64)
            v = [values_of(f, g) for g in groups]
            costs = [tables.value[i][:, _cell(v[i], len(g))] + 20 * probes[i][:, None] for i, g in enumerate(groups)]
            t = allocate(costs, slack)
            packed = pa.array((t.astype(np.int64) + 1) @ (1 << 4 * np.arange(m, dtype=np.int64)))
            batch = pa.RecordBatch.from_arrays([*batch.columns, packed], names=[*batch.schema.names, "t"])
            for i, g in enumerate(groups):
                for level in range(radius + 1):
                    rows = np.flatnonzero(t[:, i] == level)
                    if len(rows):
                        flips = _masks(len(g), level)
                        step = max(1, 100_000 // len(flips))
                        for k in range(0, len(rows), step):
                            part = rows[k : k + step]
                            yield _keyed(batch, np.repeat(part, len(flips)), i, (v[i][part, None] ^ flips).ravel())

    a = nodes.select("fp", "id", "comp").mapInArrow(probe, "i int, v long, f long, id long, comp long, t long")
    b = nodes.select("fp", "id", "comp").mapInArrow(index, "i int, v long, f long, id long, comp long")
    a, b = (x.select("i", "v", F.col("f").alias(f"f{n}"), F.col("id").alias(n), F.col("comp").alias(f"c{n}"), *[F.col("t").alias("ta")] * (n == "a")) for x, n in ((a, "a"), (b, "b")))
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= radius
    # A pair that several partitions find comes from the first of them alone.
    for j, g in enumerate(groups):
        mask = int(np.array(sum(1 << b for b in g), dtype=np.uint64).view(np.int64))
        inside = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")).bitwiseAND(F.lit(mask)))
        near = near & ((F.col("i") <= j) | (inside > F.shiftright("ta", 4 * j).bitwiseAND(F.lit(15)) - 1))
    return a.join(b, ["i", "v"]).filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near).select("a", "b")


def _keyed(batch, rows, i, v):
    kept = batch.columns if rows is None else [c.take(pa.array(rows)) for c in batch.columns]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, dtype=np.int32)), pa.array(v), *kept], names=["i", "v", *batch.schema.names])


def simhash_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, partitions: int | None = None) -> DataFrame:
    """One row per document: ``(id_col, fingerprint, component_id)``."""
    fps = cut(fingerprints(docs, id_col, text_col, words))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("first")))
    comp = components(links(nodes.select("fp", F.col("fp").alias("id"), F.col("fp").alias("comp")), radius, partitions))
    rooted = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = _named(rooted)
    out = fps.join(rooted, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(rooted: DataFrame) -> DataFrame:
    """Each fingerprint with the smallest document id of its component (root)."""
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(names, "root").select("fp", "component_id")


# --- near duplicates by the texts themselves ---------------------------------------------

_MULTIPLIERS = (np.random.default_rng(7).integers(0, 1 << 62, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: Cells that count in how many texts shingles are, and the least count of a task that is sent on. Both only set the
#: order in which prefixes are taken, which has no influence on the result.
FREQUENCY_CELLS, FREQUENT = 1 << 22, 3


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """64-bit hashes of all distinct shingles of a text, ascending."""
    tokens = (text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) < words:
        return np.array([digest(b" ".join(tokens))], dtype=np.uint64)
    each = np.array([digest(w, 42) for w in tokens], dtype=np.uint64)
    n = len(tokens) - words + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        h += each[k : k + n] * _MULTIPLIERS[k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two whole sets of shingles."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: Words of 64 bits of a text's parity bitmap.
PARITY = 8


def parities(shingles: np.ndarray) -> list[int]:
    """Whether the number of shingles that fall on each of 512 places is odd, as eight words of 64 bits.

    A shingle that only one of two texts has changes one bit. So if more bits differ than shingles may, the texts are
    not similar; however long they are, no similar pair is ruled out.
    """
    odd = np.bincount((shingles & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def majority(shingles: np.ndarray) -> int:
    """SimHash of a set of shingle hashes, as a signed long."""
    if not len(shingles):
        return 0
    by_byte = np.bincount((shingles.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    return int(np.packbits(2 * (by_byte @ _BIT_OF_BYTE).ravel() > len(shingles), bitorder="little").view("<i8")[0])


def prefix_length(n: int, min_similarity: float) -> int:
    """Of ``n`` shingles in one order for all texts, how many must be looked at: similar texts share one of them."""
    return n - ceil(min_similarity * n - 1e-9) + 1 if n else 0


def _frequencies(rows: DataFrame, words: int) -> np.ndarray:
    """Texts by cell of a shingle's hash, summed over the cluster."""

    def run(batches):
        held = np.zeros(FREQUENCY_CELLS, dtype=np.int32)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                np.add.at(held, (shingle_set(text, words) & np.uint64(FREQUENCY_CELLS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(held >= FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at].astype(np.int64))], names=["at", "n"])

    summed = rows.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(FREQUENCY_CELLS, dtype=np.uint32)
    out[np.asarray(summed["at"])] = np.asarray(summed["n"])
    return out


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, min_similarity: float = 0.8, radius: int = 3, orders: int = 4, broadcast_ids: int = 200_000) -> DataFrame:
    """``(id, root)`` of documents that are similar to others: root is the smallest id of the group.

    A link is a pair whose sets of shingles of ``words`` words have a Jaccard similarity of ``min_similarity`` or more.
    Every link is verified on all shingles of both texts, and none is lost:

    1. Equal sets are taken together.
    2. Each document is verified with those next to it in a few orders of the documents that have a prefix shingle,
       which connects large groups with a number of pairs that is linear in the documents.
    3. Fingerprints within ``radius`` bits, found by the general pigeonhole, of documents that are not connected yet.
    4. The rest, exactly: if all texts' shingles are in one order (frequent ones last), two similar texts share one of the first
       :func:`prefix_length` of each. A join on those gives candidates, of documents in groups that are still apart, with sizes,
       places of the shingle and parity bitmaps that a similar pair can have.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).filter("id is not null")
    often = rows.sparkSession.sparkContext.broadcast(_frequencies(rows, words))

    def prefixes(batches):
        for batch in batches:
            n, digests, kept, fps, odd = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_set(text, words)
                order = np.lexsort((h, often.value[(h & np.uint64(FREQUENCY_CELLS - 1)).astype(np.int64)]))
                n.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                kept.append(h[order[: prefix_length(len(h), min_similarity)]].tobytes())
                fps.append(majority(h))
                odd.append(parities(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.array(kept, pa.binary()), pa.array(fps, pa.int64()), pa.array(odd, pa.list_(pa.int64()))], names=["id", "n", "digest", "prefix", "fp", "odd"])

    def exploded(batches):
        for batch in batches:
            for id_, n, prefix in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h = np.frombuffer(prefix, dtype=np.int64)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), id_)), pa.array(np.full(len(h), n, dtype=np.int32)), pa.array(np.arange(len(h), dtype=np.int32))], names=["h", "id", "n", "at"])

    def shingled(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "shingles"])

    def similar(batches):
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            kept = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= min_similarity]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(kept, pa.int64())) for c in batch.columns[:2]], names=["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        # Only the texts of documents in pairs are shuffled, if their ids are few enough to be sent to all tasks.
        ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        need = cut(rows.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, "id", "left_semi").select("id", "t").mapInArrow(shingled, "id long, shingles binary"))
        both = pairs.join(need.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(need.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        return cut(both.select("a", "b", "sa", "sb").mapInArrow(similar, "a long, b long"))

    def fit(a: str, b: str):
        """Whether two texts can be similar, by their sizes and parity bitmaps: no more differ than shingles that one text alone may have."""
        sizes = F.least(f"n{a}", f"n{b}") >= F.greatest(f"n{a}", f"n{b}") * min_similarity - 1e-6
        differ = sum((F.bit_count(F.col(f"p{i}{a}").bitwiseXOR(F.col(f"p{i}{b}"))) for i in range(PARITY)), F.lit(0))
        return sizes & (differ <= (F.col(f"n{a}") + F.col(f"n{b}")) * ((1 - min_similarity) / (1 + min_similarity)) + 1e-6)

    def enough_left(a: str, b: str):
        """Whether the overlap that similar texts need fits behind their first common shingle, if it is this one."""
        return 1 + F.least(F.col(f"n{a}") - F.col(f"at{a}") - 1, F.col(f"n{b}") - F.col(f"at{b}") - 1) >= (F.col(f"n{a}") + F.col(f"n{b}")) * (min_similarity / (1 + min_similarity)) - 1e-6

    def plausible(pairs: DataFrame) -> DataFrame:
        """Of ``pairs(a, b)`` those that sizes and bitmaps allow."""
        for i in "ab":
            pairs = pairs.join(left.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), *[F.col("odd")[k].alias(f"p{k}{i}") for k in range(PARITY)]), i)
        return pairs.filter(fit("a", "b")).select("a", "b")

    made = cut(rows.mapInArrow(prefixes, "id long, n int, digest binary, prefix binary, fp long, odd array<long>"))
    first = made.groupBy("digest").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    equal = cut(made.select("id", "digest").join(first, "digest").filter("id <> a").select("a", F.col("id").alias("b")))
    gone = equal.select(F.col("b").alias("id")).distinct()
    left = made.select("id", "n", "prefix", "fp", "odd").join(F.broadcast(gone) if gone.count() <= broadcast_ids else gone, "id", "left_anti")
    by_shingle = left.select("id", "n", "prefix").mapInArrow(exploded, "h long, id long, n int, at int").withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("h")))
    # Shingles that several texts have, with the texts' bitmaps. The join leaves them in order of the texts, so that a file holds a bitmap once.
    bits = [f"p{i}" for i in range(PARITY)]
    place = f"{shared_dir(rows.sparkSession).rstrip('/')}/shingles-{uuid.uuid4().hex}"
    by_shingle.filter("texts > 1").drop("texts").join(left.select("id", *[F.col("odd")[i].alias(p) for i, p in enumerate(bits)]).hint("merge"), "id").write.parquet(place)
    shared = rows.sparkSession.read.parquet(place)

    own = F.struct("id", "n", "at", *bits)
    near = shared.select("h", own.alias("x"))
    for k in range(orders):
        near = near.withColumn(f"y{k}", F.lead("x").over(Window.partitionBy("h").orderBy(*([F.xxhash64("x.id", F.lit(k))] if k else []), "x.id")))
    pairs = near.select("x", F.explode(F.array(*[f"y{k}" for k in range(orders)])).alias("y")).filter("y is not null and x.id <> y.id")
    pairs = pairs.select(*[F.col(f"{i}.{c}").alias(c + n) for i, n in (("x", "a"), ("y", "b")) for c in ("id", "n", "at", *bits)])
    pairs = pairs.filter(fit("a", "b") & enough_left("a", "b")).select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"))
    groups = components(verified(cut(pairs.distinct())).union(equal))

    def joined_to(groups: DataFrame, nodes: DataFrame) -> DataFrame:
        groups = F.broadcast(groups) if groups.count() <= broadcast_ids else groups
        return nodes.join(groups, F.col("id") == F.col("node"), "left").drop("node").withColumn("comp", F.coalesce("root", "id")).drop("root")

    def with_links(groups: DataFrame, found: DataFrame) -> DataFrame:
        return components(found.union(groups.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    # One document for each fingerprint and component: all its others are connected to it.
    nodes = joined_to(groups, left.filter("n > 0").select("id", "fp")).groupBy("fp", "comp").agg(F.min("id").alias("id"))
    groups = with_links(groups, verified(cut(plausible(links(cut(nodes), radius).distinct()))))

    of = joined_to(groups, shared)
    apart = of.groupBy("h").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most").select("h")
    of = of.join(apart, "h", "left_semi")
    x, y = (of.select("h", *[F.col(c).alias(f"{c}{i}") for c in of.columns if c != "h"]) for i in "ab")
    found = x.join(y, "h").filter((F.col("ida") < F.col("idb")) & (F.col("compa") != F.col("compb")) & fit("a", "b") & enough_left("a", "b"))
    groups = with_links(groups, verified(cut(found.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct())))
    remove_folder(rows.sparkSession, place)
    return groups.select(F.col("node").alias("id"), "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, min_similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the document with the smallest id; rows without an id stay."""
    name = unused("gone", docs)
    gone = near_duplicate_groups(docs, id_col, text_col, words, min_similarity).filter("id <> root").select(F.col("id").alias(name))
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
