"""Mixing sources to target weights with a low-discrepancy schedule (operator 4).

Slot k of the schedule stands at the golden-ratio point frac((k + 1/2) / phi), which is
mapped through the sources' cumulative target shares: each source gets its share of any
run of slots, to within a few slots. The slots of a source are ranked in order, and rank r takes
block r (beginning again after the last) of that source's documents, shuffled by a hash
of their id and cut into blocks of equal tokens. The last slot of a source is cut where the
source's target is met, and a source that the points gave too few slots goes on in slots after the schedule, so taken words
equal the targets but for rounding. The mix is read in the order of the slots.

A source's targets: the sources in code-point order (null last) weigh 1, 2, 3, repeating,
and share all words; no target exceeds ``max_repeats`` times its source's words, and the
excess goes to the others by weight.

Only one row a source (its size and weight) is held on the driver. Positions in the shuffled
order come from sums over hash buckets, then inside each bucket, so a source with a third of all rows
is never sorted in one task.

Defined cases: null or empty texts have size 0 and are taken 0 times; a null source is a
source of its own; repeated rows are taken separately (ties of the shuffle are broken by id and size, and equal rows are
interchangeable); an empty table or one without words gives targets of 0; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, unused, word_count

WEIGHTS = (1, 2, 3)
INVERSE_PHI = (math.sqrt(5) - 1) / 2


def targets(sizes: list[int], weights: list[float], max_repeats: float = 3.0) -> list[float]:
    """Words wanted of each source: by weight, at most ``max_repeats`` times its size, excess reshared."""
    left, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] > max_repeats * sizes[i]]
        for i in over or open_:
            out[i] = max_repeats * sizes[i] if over else level * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def source_plan(sized: DataFrame, weights: dict | None = None, max_repeats: float = 3.0) -> list[dict]:
    """Per source: number, name, size, target, whole words to take. One row a source comes to the driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # Python compares strings by code point
    share = [float((weights or {}).get(r["source"], 0) if weights else WEIGHTS[i % len(WEIGHTS)]) for i, r in enumerate(rows)]
    wanted = targets([r["size"] for r in rows], share, max_repeats) if any(share) else [0.0] * len(rows)
    return [{"s": i, "source": r["source"], "source_size": r["size"], "target": t, "want": round(t)} for i, (r, t) in enumerate(zip(rows, wanted, strict=True))]


def schedule(spark, plan: list[dict], block: int) -> DataFrame:
    """The mix as slots ``(k, s, rank)``: source and rank in it of slot k."""
    total = sum(p["want"] for p in plan)
    slots = -(-total // block) if total else 0
    edges, at = [], 0
    for p in plan:
        at += p["want"]
        edges.append(at / total if total else 0.0)
    edges = edges[:-1] + [1.0]
    point = ((F.col("k") + 0.5) * F.lit(INVERSE_PHI)) % 1.0
    # The number of edges at or below the point: a binary search over an array of one value a source.
    s = F.expr("aggregate(edges, 0, (n, e) -> n + if(e <= point, 1, 0))") if len(edges) <= 64 else None
    base = spark.range(slots).withColumnRenamed("id", "k").withColumn("point", point)
    if s is not None:
        out = base.withColumn("edges", F.array(*map(F.lit, edges))).withColumn("s", s)
    else:
        cells = 1 << 16  # sources by cell of the unit interval; a slot meets the few sources of its cell
        rows = [(c, i, lo, hi) for i, (lo, hi) in enumerate(zip([0.0, *edges], edges, strict=False)) if hi > lo for c in range(int(lo * cells), int(math.nextafter(hi, 0) * cells) + 1)]
        ranges = spark.createDataFrame(rows, "cell int, s int, lo double, hi double")
        out = base.withColumn("cell", F.floor(F.col("point") * cells).cast("int")).join(ranges, "cell").filter("lo <= point and point < hi")
    out = out.select("k", F.col("s").cast("int").alias("s"), F.shiftright("k", 14).alias("part"))
    inside = F.row_number().over(Window.partitionBy("s", "part").orderBy("k"))
    before = out.groupBy("s", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("part")) - F.col("n")).drop("n")
    return out.withColumn("inside", inside).join(before, ["s", "part"]).select("k", "s", (F.col("before") + F.col("inside") - 1).alias("rank"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, max_repeats: float = 3.0, slots: int = 1 << 18, seed: int = 42):
    """The mix of ``docs``: ``(pieces, documents, plan)``.

    ``pieces(k, pass, s, row, doc_id, size, content, start, length)``: slot k takes ``length`` words of a document from word
    ``start`` on; read by k, start they are the mixed corpus. ``documents``: the input's
    ``(doc_id, s, size, content, row)``. ``slots``: the blocks are total / slots words long, a parameter
    of fineness that does not depend on the input's size. ``weights``: by source; 1, 2, 3 repeating by default.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("content"))
    sized = cut(sized.withColumn("h", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(seed))))))
    plan = source_plan(sized, weights, max_repeats)
    total = sum(p["want"] for p in plan)
    block = max(1, total // slots)
    numbers = spark.createDataFrame([(p["s"], p["source"], p["source_size"], p["target"], p["want"]) for p in plan], "s int, src string, source_size long, target double, want long")

    # Positions in each source's shuffled order: over hash buckets, then inside them.
    rows = sized.join(numbers.select("s", "src"), F.col("source").eqNullSafe(F.col("src"))).drop("source", "src")
    rows = rows.withColumn("part", F.left("h", F.lit(3)))
    before = rows.groupBy("s", "part").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("c"))
    over = Window.partitionBy("s").orderBy("part")
    before = before.select("s", "part", (F.sum("n").over(over) - F.col("n")).alias("before"), (F.sum("c").over(over) - F.col("c")).alias("rows_before"))
    inside = Window.partitionBy("s", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.count(F.lit(1)).over(inside)).join(before, ["s", "part"])
    placed = placed.select("doc_id", "s", "size", "content", (F.col("before") + F.col("upto") - F.col("size")).alias("at"), (F.col("rows_before") + F.col("nth") - 1).alias("row"))
    placed = cut(placed)

    # Blocks of `block` words; a document lies in those it overlaps.
    pieces = placed.filter("size > 0").withColumn("b", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
    lo, hi = F.greatest(F.col("at"), F.col("b") * block), F.least(F.col("at") + F.col("size"), (F.col("b") + 1) * block)
    pieces = pieces.select("s", "b", "row", "doc_id", "size", "content", (lo - F.col("at")).alias("start"), lo.alias("lo"), hi.alias("hi"))

    # Slots in source order: rank r is block r mod blocks in pass r div blocks, and takes the words that lie before `want`.
    ranked = schedule(spark, plan, block).join(numbers, "s").withColumn("blocks", F.expr(f"(source_size + {block} - 1) div {block}")).filter("source_size > 0")
    given = ranked.groupBy("s").agg(F.max("rank").alias("last"))
    ranked = ranked.select("k", "s", "rank", "source_size", "want", "blocks")
    # A source whose slots end before its target goes on in closing slots, after the schedule.
    short = numbers.filter("want > 0").join(given, "s", "left").withColumn("blocks", F.expr(f"(source_size + {block} - 1) div {block}"))
    next_ = F.coalesce(F.col("last") + 1, F.lit(0))
    need = F.expr(f"(want div source_size) * blocks + ((want % source_size) + {block} - 1) div {block}")
    closing = short.filter(next_ < need).select("s", next_.alias("next"), F.explode(F.sequence(next_, need - 1)).alias("rank"), "source_size", "want", "blocks")
    after = F.lit(-(-total // block)) + (F.col("rank") - F.col("next")) * max(1, len(plan)) + F.col("s")
    closing = closing.select(after.cast("long").alias("k"), "s", "rank", "source_size", "want", "blocks")
    taken = ranked.union(closing).withColumn("b", F.expr("rank % blocks")).withColumn("from", F.expr("(rank div blocks) * source_size"))
    taken = taken.withColumn("stop", F.col("want") - F.col("from")).filter(F.col("stop") > F.col("b") * block).select("k", "s", "b", "rank", "stop", F.expr("rank div blocks").alias("pass"))
    mixed = pieces.join(taken, ["s", "b"]).withColumn("length", F.least("hi", "stop") - F.col("lo")).filter("length > 0")
    return mixed.select("k", "rank", "pass", "s", "row", "doc_id", "size", "content", "start", "length"), placed, numbers


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``(doc_id, size, source_size, target, taken, first_slot, n_slots)``.

    ``taken`` counts repeats; ``first_slot`` is the first slot of the schedule that takes words of the document (null if none does),
    ``n_slots`` how many do.
    """
    pieces, placed, numbers = mix(docs, **options)
    taken = pieces.groupBy("s", "row").agg(F.sum("length").alias("taken"), F.min("k").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    out = placed.join(taken, ["s", "row"], "left").join(numbers.select("s", "source_size", "target"), "s")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), "first_slot", F.coalesce("n_slots", none).alias("n_slots"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as whole documents with all the columns of ``docs``, in the order of the schedule: a row for each time one is taken.

    A document stands at the slot that takes its first words in that pass over its source. One that a source's
    target cuts is taken if at least half of its words are. Documents without words are never taken, as they bring no source
    nearer its target.
    """
    pieces, _, _ = mix(docs, id_col, text_col, source_col, **options)
    takes = pieces.groupBy("s", "row", "doc_id", "size", "content", "pass").agg(F.min("k").alias("k"), F.sum("length").alias("taken")).filter("2 * taken >= size")
    id_, content, slot, part, row, rows = (unused(n, docs) for n in ("mix_id", "mix_content", "mix_slot", "mix_pass", "mix_row", "mix_rows"))
    takes = cut(takes.select(F.col("doc_id").alias(id_), F.col("content").alias(content), F.col("k").alias(slot), F.col("pass").alias(part), F.col("row").alias(row)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(content))
    out = docs.join(takes, same)
    # Rows that repeat id and text each meet the takes of all of them, and are rid of what is too much.
    repeated = takes.select(id_, content, row).distinct().groupBy(id_, content).agg(F.count(F.lit(1)).alias(rows)).filter(F.col(rows) > 1)
    if not repeated.isEmpty():
        many = out.join(repeated.select(F.col(id_).alias(id_ + "2"), F.col(content).alias(content + "2")), F.col(id_).eqNullSafe(F.col(id_ + "2")) & (F.col(content) == F.col(content + "2")), "left")
        none = F.lit(-1).cast("long")
        once = F.when(F.col(content + "2").isNotNull(), F.struct(F.col(row).alias("a"), F.col(part).cast("long").alias("b"), F.col(slot).alias("c")))
        keyed = many.withColumn(rows, F.coalesce(once, F.struct(none.alias("a"), F.monotonically_increasing_id().alias("b"), none.alias("c"))))
        out = keyed.dropDuplicates([rows])
    return out.orderBy(slot, id_, row).select(*[docs[c] for c in docs.columns])
