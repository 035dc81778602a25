"""Language-model scoring by online logistic context mixing (operator 8).

A text is a sequence of tokens: its words, lower-cased in ASCII, and an end. A token is coded as one byte, a hash of
the word (0 for the end), and as a choice among the words with that byte. Each bit of the byte is predicted by several
models, which are tables of bit counts by hashed context (no context; the word before; the two words before; the word
before that one; each with the bits of the byte so far), and by two that follow what stood in the same text after
the same two words, or the same word, when they stood there last. A logistic mixer combines the stretched
probabilities. Its weight sets are gated by the bit's position and by which of the two followers still agrees with
the byte so far. After every token the set that was used learns from its error. An adaptive probability map by position
and mixed logit then refines the result, and learns after every token too. The word in its byte's bucket has the
probability ``(c + 0.5) / (C + 0.5 (V + 1))`` of the corpus counts. So the model is a distribution over all training
tokens and, for each byte, one unknown.

Texts are independent: each begins with the same weights and map, and so does every ``SEGMENT`` of a longer text. So
many are scored side by side, one token of each at a time, which is the same as one after the other.

Counts are gathered over all training rows, and so are the weights and the map that texts begin with (with each bit's own count
left out). What is broadcast has a fixed size: the tables' slots (``ORDERS``), and the ``HEAD`` most frequent words; other
words meet their counts in a join.

Defined cases: null and empty texts have only the end; a null id is not held out; repeated rows
count and are scored each; an empty table gives an empty result; without training rows all counts
are 0; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_of_id, cut, give_back, in_limited_batches

#: Slots of the hashed tables (powers of two): the word before, two words before, the word before that one.
ORDERS = (1 << 21, 1 << 22, 1 << 20)
ORDER0 = 17 * 16
BEGINS = [ORDER0, ORDER0 + ORDERS[0], ORDER0 + ORDERS[0] + ORDERS[1]]
SLOTS = ORDER0 + sum(ORDERS)
TABLES = 4
INPUTS = 8  # the tables, two followers, a constant; the last place is free, so that a weight set is 32 bytes
GATES = 3
RATE, MAP_RATE = 0.02, 0.02
HEAD = 1 << 18
MAP_CELLS = 33
LANES = 512
#: Tokens after which a longer text's weights, map and memory begin anew, so that it is not left to one lane alone.
SEGMENT = 4096
#: Places of a text's memory of what followed a context.
RECENT = 1 << 11
SLICE = 1 << 15
#: Bytes of text that are held as tokens at a time (or one longer text).
PART_BYTES = 12 << 20
CHUNK = 1 << 14
#: Stretched probabilities are kept in steps of 1/16.
STEPS = 16
_BYTE = np.arange(256)
_BITS = ((_BYTE[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int8)
_SIGNS = (2 * _BITS - 1).astype(np.float32)
#: Place of each bit in a line of 16 slots: bits so far of the half byte, after a leading one.
_NODES = np.concatenate([(1 << np.arange(4)) | ((_BYTE >> 4)[:, None] >> np.arange(4, 0, -1)), (1 << np.arange(4)) | ((_BYTE & 15)[:, None] >> np.arange(4, 0, -1))], axis=1).astype(np.int32)
_SO_FAR = (1 << np.arange(8)) | (_BYTE[:, None] >> np.arange(8, 0, -1))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _followed() -> np.ndarray:
    """+1 or -1 for each bit of a byte while the byte so far agrees with the one expected, else 0: 8 of these by expected * 256 + byte. Nothing is expected at 256."""
    agree = (_SO_FAR[:, None, :] == _SO_FAR[None, :, :]) * _SIGNS[:, None, :]
    return np.concatenate([agree.astype(np.int8).reshape(65536, 8), np.zeros((256, 8), np.int8)])


class Tokens:
    """All tokens of some texts, one text after the other: byte codes, and hashes of the contexts before them."""

    def __init__(self, texts: pa.Array):
        low = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        split = pc.ascii_split_whitespace(low)
        words = split.flatten().dictionary_encode()
        codes = np.asarray(words.indices)
        self.words = words.dictionary.cast(pa.large_binary())
        spelled = self.words.to_pylist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in spelled), np.uint64, len(spelled))
        empty = spelled.index(b"") if b"" in spelled else -1
        at = np.asarray(split.offsets, dtype=np.int64)
        del low, split
        real = codes != empty
        sizes = np.add.reduceat(np.append(real, False).astype(np.int64), at[:-1]) * (at[1:] > at[:-1]) if len(at) > 1 else np.zeros(0, np.int64)
        self.sizes = sizes + 1
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        n = int(self.ends[-1]) if len(self.ends) else 0
        #: Number of each token's word in ``words``, -1 for the end.
        self.number = np.full(n, -1, dtype=np.int32)
        is_word = np.ones(n, dtype=bool)
        is_word[self.ends - 1] = False
        self.number[is_word] = codes[real]
        code_of = np.append(1 + (hashes % np.uint64(255)).astype(np.int64), 0).astype(np.uint8)
        self.code = code_of[self.number]
        one = np.zeros(n + 2, dtype=np.uint64)
        one[2:] = np.append(hashes | np.uint64(1), np.uint64(0))[self.number]
        # At a text's start there is no word before; the end of the last text counts as none.
        self.one, two = one[1:-1], one[:-2].copy()
        two[self.starts] = 0
        self.pair = self.one * _A ^ (two * _B >> np.uint64(7))
        self.skip = two * _C
        self.one = self.one * _B

    def contexts(self, at) -> list[np.ndarray]:
        return [self.one[at], self.pair[at], self.skip[at]]


def parts(batch: pa.RecordBatch, text: int):
    """The rows of ``batch``, the longest texts first, in parts of at most ``PART_BYTES`` or one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    part = (np.cumsum(size[order]) - size[order]) // PART_BYTES
    cuts = np.flatnonzero(np.diff(part)) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield batch.take(pa.array(rows))


def _lines(code: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
    """First slot of the two lines of 16 (half bytes) that a token meets in each table: tables x 2 x tokens."""
    high = code >> 4
    out = np.empty((TABLES, 2, len(code)), dtype=np.int32)
    out[0, 0] = 0
    out[0, 1] = (high.astype(np.int32) + 1) * 16
    mixed = (high.astype(np.uint64) + np.uint64(1)) * _A
    for k, context in enumerate(contexts):
        shift = np.uint64(64 - int(math.log2(ORDERS[k] // 16)))
        out[k + 1, 0] = (context * _C) >> shift
        out[k + 1, 1] = ((context + mixed) * _C) >> shift
        out[k + 1] *= 16
        out[k + 1] += BEGINS[k]
    return out


def half_bytes(code: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
    """Places of tokens' half bytes in the tables of counts: line and value."""
    lines = _lines(code, contexts)
    lines[:, 0] += code >> 4
    lines[:, 1] += code & 15
    return lines


def bit_counts(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each slot, from counts of half bytes."""
    lines = held.reshape(-1, 16)
    n0, n1 = np.zeros((2, *lines.shape), dtype=np.float32)
    for depth in range(4):
        by_bit = lines.reshape(len(lines), 1 << depth, 2, 8 >> depth).sum(axis=3)
        n0[:, 1 << depth : 2 << depth], n1[:, 1 << depth : 2 << depth] = by_bit[:, :, 0], by_bit[:, :, 1]
    return n0.ravel(), n1.ravel()


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))).astype(np.float32)


def packed(logits: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(logits * STEPS), -127, 127).astype(np.int8)


def start_weights() -> np.ndarray:
    return np.tile(np.array([0.1, 0.3, 0.3, 0.1, 1.0, 0.3, 0.0, 0.0], dtype=np.float32), (8, GATES, 1))


def start_map() -> np.ndarray:
    return np.tile(((np.arange(MAP_CELLS) - 16) / 2).astype(np.float32), (8, 1))


def segments_of(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first token and size of each segment."""
    many = -(-t.sizes // SEGMENT)
    doc = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    return doc, t.starts[doc] + nth * SEGMENT, np.minimum(SEGMENT, t.sizes[doc] - nth * SEGMENT)


def lanes_of(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Segments dealt to at most ``lanes`` lanes, the longest first, each to the lane with the fewest tokens."""
    order = np.argsort(-sizes, kind="stable")
    heap = [(0, i) for i in range(min(lanes, len(sizes)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in order.tolist():
        n, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (n + int(sizes[d]), i))
    return out


class Mixer:
    """Mixes side by side the texts of a batch, with a table of packed stretched probabilities.

    If ``anew`` is false, it learns: ``table`` is of :func:`without_own`, weights go on from text to text, and
    what bits followed each logit is counted in ``seen``.
    """

    def __init__(self, table: np.ndarray, weights: np.ndarray, map_: np.ndarray, anew: bool = True, rate: float = RATE, map_rate: float = MAP_RATE, lanes: int = LANES):
        self.width = len(table) // SLOTS  # 2 if a slot has an entry for either bit
        self.lines = table.view(f"V{16 * self.width}")
        self.weights, self.map = weights.astype(np.float32), map_.astype(np.float32).ravel()
        self.anew, self.rate, self.map_rate, self.lanes = anew, np.float32(rate), np.float32(map_rate), lanes
        self.followed = _followed()
        self.seen = np.zeros(2 * 8 * MAP_CELLS, dtype=np.int64)

    def run(self, t: Tokens) -> np.ndarray:
        """Natural logarithm of the probability of each text's bytes (zero while learning); ``last`` keeps the lanes' final weights, ``spent`` their tokens."""
        text, start, size = segments_of(t)
        dealt = lanes_of(size, self.lanes)
        total = np.array([int(size[d].sum()) for d in dealt], dtype=np.int64)
        by_size = np.argsort(-total, kind="stable")
        dealt, total = [dealt[i] for i in by_size], total[by_size]
        n = len(dealt)
        # Place in the batch of each lane's tokens, lane after lane.
        order = np.concatenate([np.array(d, dtype=np.int64) for d in dealt]) if n else np.zeros(0, np.int64)
        before = np.cumsum(size[order]) - size[order]
        place = np.repeat(start[order] - before, size[order]) + np.arange(int(size.sum()))
        begin = np.cumsum(total) - total
        starts = np.zeros(len(place), dtype=bool)
        starts[before] = True

        w = np.broadcast_to(self.weights, (n, 8, GATES, INPUTS)).reshape(-1, INPUTS).copy()
        sets = w.view(f"V{4 * INPUTS}").ravel()  # a weight set as one item
        m = np.broadcast_to(self.map, (n, 8 * MAP_CELLS)).copy()
        flat_map = m.ravel()
        # What last followed two words, and one word, in each lane's text: check byte and code.
        recent = np.zeros((2, n, RECENT), dtype=np.uint16)
        memory = recent.ravel()
        ones = np.ones(INPUTS, dtype=np.float32)
        set_of, map_of = np.arange(n * 8) * GATES, (np.arange(n * 8) * MAP_CELLS).astype(np.int64)
        loss = np.zeros(len(place), dtype=np.float32)
        longest, at = int(total[0]) if n else 0, 0
        while at < longest:
            live = int(np.searchsorted(-total, -at, side="left"))
            stop = min(longest, at + max(1, min(64, 4096 // live)), int(total[live - 1]))
            steps = stop - at
            where = begin[:live, None] + np.arange(at, stop)  # lanes x steps
            flat = place[where.T].ravel()
            code, contexts = t.code[flat], t.contexts(flat)
            bits = _BITS[code].reshape(steps, live * 8)
            x = np.zeros((steps * live, 8, INPUTS), dtype=np.float32)
            entry = _NODES[code].reshape(-1, 2, 4) * self.width
            if self.width == 2:
                entry += _BITS[code].reshape(-1, 2, 4)
            entry += (np.arange(2 * len(code), dtype=np.int32) * (16 * self.width)).reshape(-1, 2, 1)
            entry = entry.reshape(-1, 8)
            for k, lines in enumerate(_lines(code, contexts)):
                held = self.lines.take(lines.T.ravel() // 16).view(np.int8)
                np.multiply(held.take(entry), np.float32(1 / STEPS), out=x[:, :, k])
            x[:, :, TABLES + 2] = 0.3
            x = x.reshape(steps, live, 8, INPUTS)
            code = code.reshape(steps, live)
            pair = np.stack([contexts[1], contexts[0]]).reshape(2, steps, live).swapaxes(0, 1)
            key = ((pair * _C) >> np.uint64(64 - int(math.log2(RECENT)))).astype(np.int64) + (np.arange(2) * n * RECENT)[:, None] + np.arange(live) * RECENT
            check = ((pair >> np.uint64(20)).astype(np.uint16) | np.uint16(1)) << np.uint16(8)
            fact, wide = check | code[:, None, :], code.astype(np.int64)[:, None, :] + np.zeros((1, 2, 1), np.int64)
            first = starts[where].T
            begun = first.any(axis=1)
            final = np.empty((steps, live * 8), dtype=np.float32)
            change = np.empty((live * 8, INPUTS), dtype=np.float32)
            for i in range(steps):
                if begun[i]:
                    fresh = np.flatnonzero(first[i])
                    if self.anew:
                        w.reshape(n, 8 * GATES, INPUTS)[fresh] = self.weights.reshape(-1, INPUTS)
                        m[fresh] = self.map
                    recent[:, fresh] = 0
                xi, at_i = x[i], key[i]
                got = memory.take(at_i)
                memory[at_i] = fact[i]
                got ^= check[i]  # below 256 if the check is equal: the code that is expected
                expected = self.followed.take(np.minimum(got, 256).astype(np.int64) * 256 + wide[i], axis=0)
                xi[:, :, TABLES : TABLES + 2] = expected.transpose(1, 2, 0)
                np.abs(expected, out=expected)
                expected[0] *= 2
                gate = np.maximum(expected[0], expected[1]).ravel()
                rows = set_of[: live * 8] + gate
                used, xf = w.take(rows, axis=0), xi.reshape(-1, INPUTS)
                logit = np.multiply(used, xf, out=change) @ ones
                np.clip(logit, -8, 8, out=logit)
                step = (bits[i] - 1 / (1 + np.exp(-logit))) * self.rate
                np.multiply(xf, step[:, None], out=change)
                change += used
                np.put(sets, rows, change.view(sets.dtype).ravel())
                final[i] = logit
                if self.anew:
                    cell = map_of[: live * 8] + (logit * 2 + np.float32(16.5)).astype(np.int64)
                    a = flat_map.take(cell)
                    flat_map[cell] = a + self.map_rate * (bits[i] - 1 / (1 + np.exp(-a)))
                    final[i] += a
            if self.anew:
                final *= np.float32(0.5)
            else:
                cell = np.tile(np.arange(8), live) * MAP_CELLS + (final * 2 + np.float32(16.5)).astype(np.int64)
                self.seen += np.bincount((cell + bits.astype(np.int64) * (8 * MAP_CELLS)).ravel(), minlength=len(self.seen))
                at = stop
                continue
            final *= 1 - 2 * bits
            loss[where.T] = np.log1p(np.exp(final)).reshape(steps, live, 8).sum(axis=2)
            at = stop
        self.last, self.spent = w.reshape(n, 8, GATES, INPUTS), total
        return np.bincount(text[order], -np.add.reduceat(loss.astype(np.float64), before), minlength=len(t.sizes)) if n else np.zeros(len(t.sizes))


# --- jobs ------------------------------------------------------------------------------


def _counted(batches):
    """Word counts (chunk -1) of each batch, and half-byte counts of one partition of training texts in compressed chunks."""
    seen = np.zeros(SLOTS, dtype=np.uint32)  # a task reads fewer than 2^32 words
    for batch in (p for b in batches for p in parts(b, 0)):
        t = Tokens(batch.column(0))
        words = np.bincount(t.number + 1, minlength=len(t.words) + 1)
        names = pa.chunked_array([pa.array([b""], pa.large_binary()), t.words]).combine_chunks()
        for i in range(0, len(names), 100_000):
            part = words[i : i + 100_000]
            yield _count_rows(np.full(len(part), -1), names.slice(i, len(part)).cast(pa.binary()), pa.array(part), pa.nulls(len(part), pa.binary())).filter(pa.array(part > 0))
        for i in range(0, len(t.code), SLICE):
            part = slice(i, i + SLICE)
            np.add.at(seen, half_bytes(t.code[part], t.contexts(part)).ravel(), np.uint32(1))
        del t  # before the next tokens are made
    yield from _chunks(seen)


def _count_rows(chunk, word, n, data):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(chunk, dtype=np.int32)), word, n, data], names=["chunk", "word", "n", "data"])


def _chunks(seen: np.ndarray):
    pack = zstandard.ZstdCompressor(level=1)
    for i in range(0, len(seen), CHUNK):
        part = seen[i : i + CHUNK]
        if part.any():
            yield _count_rows([i // CHUNK], pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([pack.compress(part.tobytes())], pa.binary()))


def _summed(batches):
    """Chunks of counts added up, one after the other."""
    held: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(unpack.decompress(data), dtype=np.uint32)
            held[chunk] = held[chunk] + part if chunk in held else part.astype(np.uint64)
    pack = zstandard.ZstdCompressor(level=1)
    for chunk, part in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([pack.compress(part.tobytes())], pa.binary())], names=["chunk", "data"])


def counts_of(chunks) -> np.ndarray:
    """All counts from summed chunks."""
    out, unpack = np.zeros(SLOTS), zstandard.ZstdDecompressor()
    for chunk, data in chunks:
        part = np.frombuffer(unpack.decompress(data), dtype=np.uint64)
        out[chunk * CHUNK : chunk * CHUNK + len(part)] = part
    return out


def without_own(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Packed stretched probabilities as they are without one 0 (even places) and without one 1 (odd ones)."""
    out = np.empty(2 * len(n0), dtype=np.int8)
    out[::2] = packed(stretch(np.maximum(n0 - 1, 0), n1))
    out[1::2] = packed(stretch(n0, np.maximum(n1 - 1, 0)))
    return out


def _tuned(batches, without, rate):
    """Sums of final weights and map counts over one partition of training texts, own counts left out."""
    mixer = Mixer(without, start_weights(), start_map(), anew=False, rate=rate)
    w_sum, n = np.zeros(8 * GATES * INPUTS), 0
    for batch in (p for b in batches for p in parts(b, 0)):
        mixer.run(Tokens(batch.column(0)))
        spent = mixer.spent.astype(np.float64)
        w_sum += (mixer.last.reshape(len(spent), -1) * spent[:, None]).sum(axis=0)
        n += int(spent.sum())
        if n:
            mixer.weights = (w_sum / n).astype(np.float32).reshape(8, GATES, INPUTS)
    values = np.concatenate([w_sum, mixer.seen, [n]])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "v"])


def tuned_start(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights and the map that texts begin with."""
    size = 8 * GATES * INPUTS
    weights = (sums[:size] / sums[-1]).reshape(8, GATES, INPUTS) if sums[-1] else start_weights()
    seen, prior = sums[size:-1].reshape(2, 8, MAP_CELLS), start_map()
    p = 1 / (1 + np.exp(-prior))
    return weights.astype(np.float32), stretch(seen[0] + 20 * (1 - p), seen[1] + 20 * p)


def _scores(batches, table, weights, map_, head, logs_of, shares, rate):
    """Per row a summary (kind 0), and its words outside the head with their number (kind 1)."""
    key = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    names = ["kind", "key", "doc_id", "held_out", "n_tokens", "n_known", "logs", "bits", "word", "n", "n_bytes"]
    mixer = Mixer(table, weights, map_, rate=rate)
    for batch in (p for b in batches for p in parts(b, 2)):
        t = Tokens(batch.column(2))
        m = len(t.sizes)
        ln = mixer.run(t)
        t.one = t.pair = t.skip = None  # the contexts are done with
        in_head = np.append(np.asarray(pc.fill_null(pc.index_in(t.words, value_set=head), -1)), pc.fill_null(pc.index_in(pa.scalar(b"", pa.large_binary()), value_set=head), -1).as_py()).astype(np.int64)
        place = in_head[t.number]
        inside = place >= 0
        logs = np.add.reduceat(np.where(inside, np.append(logs_of, 0.0)[place], 0.0), t.starts) if m else np.zeros(0)
        known = np.add.reduceat(inside.astype(np.int64), t.starts) if m else np.zeros(0, np.int64)
        share = np.add.reduceat(shares[t.code], t.starts) if m else np.zeros(0)
        n_bytes = pc.fill_null(pc.binary_length(batch.column(2)), 0).cast(pa.int64())
        keys = key + np.arange(m)
        key += m
        none = [pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int8)), pa.array(keys), batch.column(0), batch.column(1), pa.array(t.sizes), pa.array(known), pa.array(logs), pa.array(ln / math.log(10) - share), *none, n_bytes], names=names)
        rest = np.flatnonzero(~inside)
        each = np.repeat(np.arange(m), t.sizes)[rest] * (len(t.words) + 1) + t.number[rest] + 1
        each, times = np.unique(each, return_counts=True)
        of, word = np.divmod(each, len(t.words) + 1)
        spelled = pa.chunked_array([pa.array([b""], pa.large_binary()), t.words]).combine_chunks()
        for i in range(0, len(each), 50_000):
            part = slice(i, i + 50_000)
            size = len(of[part])
            none = [pa.nulls(size, kind) for kind in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(size, np.int8)), pa.array(keys[of[part]]), *none, spelled.take(pa.array(word[part])).cast(pa.binary()), pa.array(times[part]), pa.nulls(size, pa.int64())], names=names)
        del t, place, inside, rest, each, of, spelled  # before the next tokens are made


@in_limited_batches
def context_mixing_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, rate: float = RATE) -> DataFrame:
    """Train outside the held-out fold and score every row.

    Returns ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(crc_of_id("doc_id") % folds == held, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", held_out.alias("held_out"), "text")
    training = rows.filter("not held_out").select("text")

    counted = cut(training.mapInArrow(lambda it: give_back(_counted(it)), "chunk int, word binary, n long, data binary"))
    words = cut(counted.filter("chunk < 0").groupBy("word").agg(F.sum("n").alias("c")))
    summed = counted.filter("chunk >= 0").select("chunk", "data").repartition(F.col("chunk")).mapInArrow(_summed, "chunk int, data binary").toArrow()
    n0, n1 = bit_counts(counts_of(zip(summed["chunk"].to_pylist(), summed["data"].to_pylist(), strict=True)))
    del summed

    # The byte of a word: 2**64 is 1 modulo 255, so a negative (signed) hash needs 1 added.
    hashed = F.xxhash64("word")
    signed = F.pmod(hashed, F.lit(255).cast("long")) + F.when(hashed < 0, 1).otherwise(0)
    byte = F.when(F.length("word") == 0, 0).otherwise(1 + F.pmod(signed, F.lit(255).cast("long")))
    buckets = np.zeros((256, 2))
    for r in words.groupBy(byte.cast("int").alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        buckets[r["b"]] = r["c"], r["v"]
    total, vocabulary = buckets.sum(axis=0)
    head, head_counts = _head(words)
    logs_of = np.log10(head_counts + 0.5)
    shares = np.log10(buckets[:, 0] + 0.5 * (buckets[:, 1] + 1))  # by byte, what its words' counts are divided by

    without = spark.sparkContext.broadcast(without_own(n0, n1))
    tuned = training.mapInArrow(lambda it: give_back(_tuned(it, without.value, rate)), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    sums = np.zeros(8 * GATES * INPUTS + 16 * MAP_CELLS + 1)
    sums[np.asarray(tuned["at"])] = np.asarray(tuned["v"])
    weights, map_ = tuned_start(sums)
    without.unpersist()

    model = spark.sparkContext.broadcast((packed(stretch(n0, n1)), weights, map_, head, logs_of, shares))
    del n0, n1
    schema = "kind byte, key long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, bits double, word binary, n long, n_bytes long"
    scored = cut(rows.mapInArrow(lambda it: give_back(_scores(it, *model.value, rate)), schema))
    tail = scored.filter("kind = 1").select("key", "word", "n").join(words, "word", "left")
    tail = tail.groupBy("key").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("also"))
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    base = logs - F.col("n_tokens") * math.log10(total + 0.5 * (vocabulary + 1))
    score = logs + F.col("bits")
    out = scored.filter("kind = 0").drop("word", "n").join(tail, "key", "left")
    per_byte = F.when(F.col("n_bytes") > 0, -score * math.log2(10) / F.col("n_bytes"))
    known = F.col("n_known") + F.coalesce("also", F.lit(0).cast("long"))
    return out.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", known.alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), per_byte.alias("bits_per_byte"))


def _head(words: DataFrame):
    """The most frequent words and counts: all those above the threshold that leaves at most ``HEAD`` of them."""
    level = F.floor(F.log2("c") * 8).cast("int")
    by_level = sorted(((r["l"], r["n"]) for r in words.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, n = None, 0
    for lv, k in by_level:
        if n + k > HEAD:
            break
        least, n = lv, n + k
    found = words.filter(level >= (least if least is not None else 1 << 30)).toArrow()
    return found["word"].combine_chunks().cast(pa.large_binary()), np.asarray(found["c"], dtype=np.float64)
