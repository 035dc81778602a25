"""Alignment of the tokens of two tokenizers (operator 12).

Python tokenises, and aligns the tokens of all chunks of a pack at once on Arrow's and numpy's arrays: the byte offsets where tokens of both sides end
are the cuts, tokens between two cuts a group, and links the pairs of ids of a group. Spark puts texts together from
their chunks, counts pairs over all documents, and sums the counts of each text's links.

The work on a text grows as n log n, however long it is.

All works by chunks: a single space between two characters that are no white space begins a new token in both
tokenizers whatever stands around it, so what lies between such spaces is tokenised alone, and no group goes on past it. A pack of texts
(``PACK`` characters, or one longer text) is a row with its distinct chunks, whose groups and links are built once, and with the chunks
of each text in order. A chunk's tokens are kept for later packs until there are ``HELD`` of them. This needs that no piece of the second
tokenizer goes on past a space, which is checked when it is loaded.

Counts of id pairs (documents that hold one linked) are summed map-side. Frequent pairs, at most ``broadcast_pairs`` of them by a
threshold from a histogram of 64 counts, go to all tasks; each of the others has few documents, so that a join by
pair is even. There is no other difference between the two ways, and every link gets its count.

Defined cases: null and empty texts, and those whose tokens do not give back the text's bytes (white space that is normalised,
U+2581), have no tokens, with zeros and an empty ``groups_sha256``; rows that repeat an id are documents of their own; ids may
be null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, give_back, in_limited_batches, shared_dir

#: How the byte-level tokenizer splits text before its merges; it is part of the vocabulary file's format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids of the two tokenizers are written as one number.
SHIFT = 20
#: Tokens of chunks that are kept, and characters of the texts that are put together.
HELD, PACK = 1 << 20, 1 << 20
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: A pack: of each text its chunks by number; of each chunk its tokens, how many groups they make, these as text, and the id pairs of all links.
TOKENS = "texts array<struct<row:long,doc_id:long,n_a:long,n_b:long,chunks:array<int>>>, a array<array<int>>, b array<array<int>>, n_groups array<long>, written array<string>, links array<array<long>>"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, made in the process that uses them from the files' paths."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        import tiktoken

        alphabet = byte_alphabet()
        with open(byte_level, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"] if t["special"]}
        # The order of ids is the order of merges.
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.byte_level = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = self.pieces.id_to_piece(list(range(self.pieces.get_piece_size())))
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("a piece goes on past a space, so texts cannot be tokenised in chunks")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        a_sizes = np.zeros(max(ranks.values()) + 1, np.int32)
        a_sizes[list(ranks.values())] = [len(t) for t in ranks]
        #: Bytes of the tokens of both sides by id.
        self.sizes = (a_sizes, np.array([len(x) for x in self.b_bytes], np.int32))
        if max(len(x) for x in self.sizes) > 1 << SHIFT:
            raise ValueError(f"more than {1 << SHIFT} ids")
        self.clear()

    def clear(self) -> None:
        #: Chunks by number; then both sides' ids of one chunk after the other, where each begins, and whether its tokens give back its bytes (else it has none).
        #: Flat arrays, as lists of each chunk's own take several times the memory, and Python's garbage collector goes through them again and again.
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.fits = (array("i"), array("i")), (array("q", [0]), array("q", [0])), bytearray()

    def learn(self, chunks: list[str]) -> None:
        for c, y in zip(chunks, self.pieces.encode(chunks, num_threads=1), strict=True):
            fits = b"".join([self.b_bytes[i] for i in y]) == b" " + c.encode()  # the byte-level tokens always do
            self.known[c] = len(self.fits)
            self.fits.append(fits)
            for ids, starts, own in zip(self.ids, self.starts, (self.byte_level.encode_ordinary(" " + c), y) if fits else ((), ()), strict=True):
                ids.extend(own)
                starts.append(len(ids))

    def pack(self, texts: list[str]):
        """``((offsets, chunks by number) of the texts, numbers of tokens of each text for both sides, (offsets, ids, ends) of the chunks' tokens for both sides)``."""
        if sum(map(len, self.ids)) > HELD:
            self.clear()
        split = [BETWEEN.split(t) if t else [] for t in texts]
        # In the order they come in, so that the same texts always give the same rows.
        distinct = {c: i for i, c in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        self.learn([c for c in distinct if c not in self.known])
        known = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        sides = [self._tokens_of(known, k) for k in (0, 1)]
        sizes = np.array([len(x) for x in split], np.int64)
        numbers = np.fromiter(map(distinct.__getitem__, chain.from_iterable(split)), np.int32, int(sizes.sum()))
        lost = _sums(np.frombuffer(bytes(self.fits), np.uint8)[known][numbers] == 0, sizes) > 0
        numbers, sizes = numbers[~np.repeat(lost, sizes)], np.where(lost, 0, sizes)
        counts = [_sums(np.diff(offsets)[numbers], sizes) for offsets, _, _ in sides]
        return (_offsets(sizes), numbers), counts, sides

    def _tokens_of(self, known: np.ndarray, k: int):
        """``(offsets, ids, ends)`` of the chunks ``known``, one after the other; ends count the bytes of all."""
        starts = np.array(self.starts[k])
        sizes = starts[known + 1] - starts[known]
        offsets = _offsets(sizes)
        ids = np.array(self.ids[k])[np.arange(offsets[-1]) + np.repeat(starts[known] - offsets[:-1], sizes)]
        return offsets, ids, np.cumsum(self.sizes[k][ids], dtype=np.int64)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` of these sizes."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[_offsets(sizes)])


def _aligned(a, b):
    """Of each chunk ``(n_groups, written, links)``, from ``(offsets, ids, ends)`` of both sides.

    Both sides have the same bytes in each chunk, so all chunks of a pack are cut at once: a chunk's end is a cut, and no group goes on past it.
    """
    sides = []
    for (offsets, ids, ends), (_, _, other) in ((a, b), (b, a)):
        cut = np.isin(ends, other, assume_unique=True)
        group = np.cumsum(cut) - cut
        sides.append((offsets, ids, cut, group, np.bincount(group)))
    (offsets, a_ids, a_cut, a_group, n_a), (_, b_ids, b_cut, b_group, n_b) = sides
    n_groups = _sums(a_cut, np.diff(offsets))
    # Each token of the first side with all of the second in its group.
    many = n_b[a_group]
    first = np.repeat(np.cumsum(n_b)[a_group] - many, many)
    within = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
    links = np.repeat(a_ids.astype(np.int64) << SHIFT, many) | b_ids[first + within]
    # Both sides' tokens in the order they are written, each with what follows it; a chunk's text is a part of them all joined.
    order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    follows = np.concatenate([np.where(a_cut, "|", ","), np.where(b_cut, ";", ",")]).astype(object)
    last = _offsets(np.diff(sides[1][0]))[1:] - 1
    follows[len(a_ids) + last[n_groups > 0]] = ""
    joined = pc.binary_join_element_wise(pa.array(np.concatenate([a_ids, b_ids])[order]).cast(pa.string()), pa.array(follows[order], pa.string()), "")
    at = np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int32)
    starts = at[offsets + sides[1][0]]
    written = pa.StringArray.from_buffers(len(n_groups), pa.py_buffer(starts.astype(np.int32)), joined.buffers()[2] if len(joined) else pa.py_buffer(b""))
    return pa.array(n_groups), written, pa.ListArray.from_arrays(_offsets(_sums(n_a * n_b, n_groups)), links)


def _packs(batches):
    """Rows in runs of texts of together ``PACK`` characters, one text at least."""
    held, size = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = len(row[2] or "")
            if held and size + n > PACK:
                yield held
                held, size = [], 0
            held.append(row)
            size += n
    if held:
        yield held


def _tokens(byte_level: str, pieces: str):
    def run(batches):
        both = Tokenizers(byte_level, pieces)
        for rows in _packs(batches):
            (at, numbers), counts, sides = both.pack([t or "" for _, _, t in rows])
            texts = pa.StructArray.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *map(pa.array, counts),
                    pa.ListArray.from_arrays(at, numbers),
                ],
                ["row", "doc_id", "n_a", "n_b", "chunks"],
            )
            columns = [texts, *(pa.ListArray.from_arrays(offsets, ids) for offsets, ids, _ in sides), *_aligned(*sides)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=["texts", "a", "b", "n_groups", "written", "links"])

    return lambda batches: give_back(run(batches))


def _texts() -> Column:
    """What each text of a pack has of its chunks."""

    def text(d):
        def of(values):
            return F.transform(d["chunks"], lambda c: F.col(values)[c])

        return F.struct(
            d["row"].alias("row"), d["doc_id"].alias("doc_id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), F.aggregate(d["chunks"], F.lit(0).cast("long"), lambda n, c: n + F.col("n_groups")[c]).alias("n_groups"),
            F.when(F.size(d["chunks"]) > 0, F.sha2(F.array_join(of("written"), ";"), 256)).otherwise("").alias("groups_sha256"), F.sort_array(F.flatten(of("links"))).alias("links"),
        )

    return F.transform("texts", text)


@in_limited_batches
def aligned_tokens(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links)``, written to the shared folder.

    ``byte_level`` and ``pieces`` are the vocabulary files, at the same place on every machine. ``row`` tells rows apart; ``links`` holds a
    number for every link, ``a << 20 | b``, sorted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packs = rows.mapInArrow(_tokens(byte_level, pieces), TOKENS)
    texts = packs.select(F.explode(_texts()).alias("d"))
    out = texts.select("d.row", "d.doc_id", "d.n_a", "d.n_b", "d.n_groups", F.size("d.links").cast("long").alias("n_links"), "d.groups_sha256", "d.links")
    place = f"{shared_dir(spark).rstrip('/')}/token-links/{uuid.uuid4().hex}"
    out.write.option("compression", "zstd").parquet(place)
    return spark.read.parquet(place)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n, best)``: documents that hold an id pair linked, and whether no pair of its first id has more."""
    counts = cut(aligned.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    most = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("most"))
    best = F.col("n") == F.col("most")
    return cut(counts.join(most, F.shiftright("pair", SHIFT) == F.col("a")).select("pair", "n", best.cast("long").alias("best")))


def token_alignment(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = 1 << 19) -> DataFrame:
    """Per row of ``docs``: ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``.

    ``n_best``: links whose pair is in as many documents as any pair of its first id; ``count_sum``: over links, the documents that hold the pair.
    """
    aligned = aligned_tokens(docs, byte_level, pieces, id_col, text_col)
    counts = pair_counts(aligned)
    # Pairs by the power of two of their count; the largest classes that together are at most `broadcast_pairs`.
    classes = {r["c"]: r["k"] for r in counts.groupBy((F.length(F.bin("n")) - 1).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least, total = 64, 0
    while least > 0 and total + classes.get(least - 1, 0) <= broadcast_pairs:
        least -= 1
        total += classes.get(least, 0)
    frequent = counts.filter(F.col("n") >= 2**least) if least < 63 else counts.limit(0)
    each = aligned.select("row", F.explode("links").alias("pair")).join(F.broadcast(frequent), "pair", "left")
    sums = each.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    if least > 0:
        few = each.filter("n is null").groupBy("row", "pair").agg(F.count(F.lit(1)).alias("m"))
        more = few.join(counts.filter(F.col("n") < 2**least), "pair").select("row", (F.col("m") * F.col("best")).alias("n_best"), (F.col("m") * F.col("n")).alias("count_sum"))
        sums = sums.union(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = aligned.drop("links").join(sums, "row", "left")
    return out.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
