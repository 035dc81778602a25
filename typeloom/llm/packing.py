"""Variable-capacity best-fit packing (operator 5).

Token sequences of several permitted lengths are filled jointly. Pieces (documents, cut at
the largest capacity only where they are longer) are taken in decreasing length; each goes
into the open bin that it leaves the least room in. If none has room, a bin of the
size that costs least is opened: the cost of a bin of capacity c is
``overhead + c + c * c / attention_scale`` (a sequence's fixed cost, its tokens, and attention), divided by
the tokens it can expect to hold, that is the piece and as many of the tokens still to come as fit.
At the end every bin is downsized to the smallest permitted length that holds its contents.

Documents are dealt by a hash of their id and content length into shards of about ``shard_rows`` rows, a
number that follows the input, so that a shard's memory is bounded and shards pack in parallel.
Costs a fraction of the last bin of each shard.

Defined cases: null, empty and wordless texts make no piece and appear once with length 0 and no bin;
repeated rows are packed separately; equal lengths go in order of id, piece; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, word_count

CAPACITIES = (512, 1024, 2048, 4096, 8192)


class _OpenBins:
    """Open bins by room; the tightest that fits is found by bisection over the rooms in use."""

    def __init__(self):
        self.rooms: list[int] = []
        self.bins: dict[int, list[int]] = {}

    def put(self, bin_: int, room: int) -> None:
        if room <= 0:
            return
        if room not in self.bins:
            insort(self.rooms, room)
            self.bins[room] = []
        self.bins[room].append(bin_)

    def take(self, size: int) -> tuple[int, int] | None:
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        bin_ = self.bins[room].pop()
        if not self.bins[room]:
            del self.bins[room]
            self.rooms.pop(at)
        return bin_, room


def pack(sizes: np.ndarray, capacities=CAPACITIES, overhead: float = 64.0, attention_scale: float = 16384.0):
    """Pack pieces of ``sizes`` (decreasing, at most the largest capacity): ``(bin, offset, capacity of each bin)``."""
    capacities = sorted(capacities)
    price = {c: overhead + c + c * c / attention_scale for c in capacities}
    n = len(sizes)
    left = int(sizes.sum())
    bin_of, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    filled: list[int] = []
    open_ = _OpenBins()
    for i, size in enumerate(sizes.tolist()):
        left -= size
        found = open_.take(size)
        if found is None:
            fits = [c for c in capacities if c >= size]
            cap = min(fits, key=lambda c: (price[c] / (size + min(c - size, left)), c))
            filled.append(0)
            found = (len(filled) - 1, cap)
        b, room = found
        bin_of[i], offset[i] = b, filled[b]
        filled[b] += size
        open_.put(b, room - size)
    final = np.array(capacities)[np.searchsorted(capacities, filled)] if filled else np.zeros(0, dtype=np.int64)
    return bin_of, offset, final


def pieces_of(docs: DataFrame, id_col: str, text_col: str, longest: int) -> DataFrame:
    """``(doc_id, piece, start, length)``: whole documents, cut only where longer than the longest bin."""
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_count(F.col(text_col).cast("string")).alias("size"))
    sized = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(size + {longest} - 1) div {longest} - 1"), F.lit(0).cast("long")))))
    start = F.col("piece") * longest
    return sized.select("doc_id", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.lit(longest).cast("long"), F.col("size") - start).alias("length"))


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities=CAPACITIES, overhead: float = 64.0, attention_scale: float = 16384.0, shard_rows: int = 20_000) -> DataFrame:
    """One row per piece: ``(doc_id, piece, start, length, bin, bin_offset, capacity)``.

    ``start`` and ``length`` count words of the document; ``bin`` names the packed sequence, in
    which the piece begins at ``bin_offset``.
    """
    pieces = cut(pieces_of(docs, id_col, text_col, max(capacities)))
    shards = max(1, -(-pieces.count() // shard_rows))

    def run(key, rows):
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets, final = pack(np.asarray(rows["length"], dtype=np.int64), capacities, overhead, attention_scale)
        names = pa.array([f"{key[0].as_py()}-{b}" for b in bins.tolist()], pa.string())
        cap = pa.array(final[bins] if len(bins) else bins, pa.int64())
        return rows.select(["doc_id", "piece", "start", "length"]).append_column("bin", names).append_column("bin_offset", pa.array(offsets)).append_column("capacity", cap)

    # A hash deals the rows evenly.
    shard = F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(shards)).cast("int")
    schema = "doc_id long, piece int, start long, length long, bin string, bin_offset long, capacity long"
    packed = pieces.filter("length > 0").withColumn("shard", shard).groupBy("shard").applyInArrow(run, schema)
    none = pieces.filter("length <= 0").select("doc_id", "piece", "start", "length", F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("bin_offset"), F.lit(None).cast("long").alias("capacity"))
    return packed.unionByName(none)
