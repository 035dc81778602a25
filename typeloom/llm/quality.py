"""Quality scores by attention-based multiple-instance learning (operator 6).

A document is a bag of passages of ``WORDS`` words. Each passage is encoded (hashed byte pairs, classes of
characters, lengths, repetition) and goes through one hidden layer; gated attention,
softmax of w (tanh(V h) * sigmoid(U h)), weighs the passages; the score is the logistic regression
of the weighted sum. Only documents have labels; the attention learns which passages tell.

The network is fitted on the driver on a bounded sample of labelled documents, in the order of a hash of the id: at most
``train_docs``, and as many as have ``train_passages`` passages together (60 MB). Each is learned from whole, as every text is
scored whole.

Defined cases: a null or empty text is one passage without words; labels that are null or neither 0 nor 1 are not
learned; without labels of both classes every score is the share of label 1 (0.5 without any); repeated rows
get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_of_id, word_count

WORDS = 64
PAIRS = 128
_CLASS = np.zeros(256, dtype=np.int64)  # 0 other
for _chars, _n in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\n\r\x0b\x0c", 4), (".", 5), (",;:", 6), ("!?", 7), ("\"'()[]{}", 8), ("#$%&*+/<=>@\\^_`|~-", 9)):
    for _c in _chars.encode():
        _CLASS[_c] = _n
_CLASS[128:] = 10
CLASSES = 11
FEATURES = PAIRS + CLASSES + 6
_SPACE = _CLASS == 4
_STRIDES = np.array([pow(31, k, 1 << 31) for k in range(64)], dtype=np.int64)


def encode(text: str | None) -> np.ndarray:
    """Passages x features of a whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(raw) else np.zeros(0, dtype=np.int64)
    n = len(starts)
    passages = max(1, -(-n // WORDS))
    out = np.zeros((passages, FEATURES), dtype=np.float32)
    if not n:
        return out
    # Bytes before the first word belong to the first passage.
    begins = starts[::WORDS].copy()
    begins[0] = 0
    ends = np.append(begins[1:], len(raw))
    of = np.repeat(np.arange(passages), ends - begins)
    size = (ends - begins).astype(np.float32)
    wide = raw.astype(np.int64)
    if len(raw) > 1:
        pair = (wide[:-1] * 31 + wide[1:] * 17) % PAIRS
        out[:, :PAIRS] = np.sqrt(np.bincount(of[:-1] * PAIRS + pair, minlength=passages * PAIRS).reshape(passages, PAIRS) / size[:, None])
    out[:, PAIRS : PAIRS + CLASSES] = np.bincount(of * CLASSES + _CLASS[raw], minlength=passages * CLASSES).reshape(passages, CLASSES) / size[:, None]
    # Words by hash of their bytes; a word's white space is not part of it.
    length = np.add.reduceat((~space).astype(np.int64), starts)
    place = np.arange(len(raw)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(raw)]])))
    word = np.add.reduceat(np.where(space, 0, (wide + 1) * _STRIDES[place & 63] & 0x7FFFFFFF), starts)
    holds = np.arange(n) // WORDS
    count = np.bincount(holds, minlength=passages).astype(np.float32)
    order = np.lexsort((word, holds))
    new = np.ones(n, dtype=bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (holds[order][1:] != holds[order][:-1])
    again = np.zeros(n, dtype=bool)
    again[1:] = word[1:] == word[:-1]
    base = PAIRS + CLASSES
    out[:, base] = np.bincount(holds[order], new, minlength=passages) / count
    out[:, base + 1] = np.bincount(holds, again, minlength=passages) / count
    mean = np.bincount(holds, length, minlength=passages) / count
    out[:, base + 2] = np.log1p(mean)
    out[:, base + 3] = np.log1p(np.sqrt(np.maximum(np.bincount(holds, length.astype(float) ** 2, minlength=passages) / count - mean**2, 0)))
    out[:, base + 4] = np.log1p(count) / 4
    _, inverse, times = np.unique(word, return_inverse=True, return_counts=True)
    out[:, base + 5] = np.bincount(holds, np.log(times[inverse]), minlength=passages) / count  # repetition in the document
    return out


class Network:
    """Hidden layer, gated attention and logistic output, with their gradients."""

    def __init__(self, hidden: int = 32, attention: int = 16, seed: int = 42):
        rng = np.random.default_rng(seed)
        n = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {"W": n(FEATURES, hidden), "b": np.zeros(hidden), "V": n(hidden, attention), "U": n(hidden, attention), "w": n(attention), "c": n(hidden), "d": np.zeros(1)}
        self.constant: float | None = None

    @classmethod
    def of(cls, fitted: dict) -> Network:
        made = cls.__new__(cls)
        made.__dict__.update(fitted)
        return made

    def forward(self, x: np.ndarray, begins: np.ndarray):
        """``x``: passages of several documents, in order; ``begins``: where each document's begin."""
        p = self.p
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        doc = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, begins)[doc])
        a = e / np.add.reduceat(e, begins)[doc]
        z = np.add.reduceat(a[:, None] * h, begins, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return y, (h, t, g, a, z, doc)

    def gradients(self, x, begins, target):
        p = self.p
        y, (h, t, g, a, z, doc) = self.forward(x, begins)
        dy = (y - target) / len(target)
        dz = dy[:, None] * p["c"]
        dh = a[:, None] * dz[doc]
        da = (dz[doc] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, begins)[doc])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh += dt @ p["V"].T + dg @ p["U"].T
        dh *= h > 0
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dy, "d": np.array([dy.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.003, decay: float = 1e-4, seed: int = 42):
        if len(bags) == 0 or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(bags) else 0.5
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0).astype(np.float64), every.std(axis=0).astype(np.float64) + 1e-3
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            speed = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                x = np.concatenate([self.scaled(bags[j]) for j in part])
                begins = np.concatenate([[0], np.cumsum([len(bags[j]) for j in part])[:-1]])
                step += 1
                for k, g in self.gradients(x, begins, labels[part]).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.zeros(len(texts))
        for i in range(0, len(texts), 64):
            bags = [encode(t) for t in texts[i : i + 64]]
            begins = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
            out[i : i + 64] = self.forward(self.scaled(np.concatenate(bags)), begins)[0]
        return out


def within(sizes: list[int], most: int) -> list[bool]:
    """Which documents are taken, in order, so that their sizes add up to ``most`` at most."""
    out, left = [], most
    for n in sizes:
        out.append(n <= left)
        left -= n * out[-1]
    return out


def train(rows: DataFrame, chosen: DataFrame, train_passages: int = 100_000) -> Network:
    """Fit on documents ``rows(doc_id, text)`` with the labels ``chosen(doc_id, quality)``, at most some thousands."""
    spark = rows.sparkSession
    sized = rows.join(F.broadcast(chosen), "doc_id").withColumn("words", word_count(F.col("text"))).select("doc_id", "quality", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.greatest(F.lit(1).cast("long"), F.expr(f"(words + {WORDS - 1}) div {WORDS}")).alias("n"))
    # One row a chosen label and text; rows that repeat both count once.
    found = sorted(sized.distinct().collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["quality"], r["key"]))
    kept = [(r["doc_id"], r["quality"], r["key"]) for r, take in zip(found, within([r["n"] or 1 for r in found], train_passages), strict=True) if take]
    if not kept:
        return Network().fit([], np.zeros(0))
    picked = F.broadcast(spark.createDataFrame(kept, "doc_id long, quality int, key string"))
    texts = rows.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256)).join(picked, ["doc_id", "key"]).select("doc_id", "text", "quality", "key")

    def run(batches):
        for b in batches:
            bags = [encode(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(bags, pa.binary())], names=["id", "y", "key", "x"])

    by = {(i, k, y): x for i, y, k, x in zip(*(c.to_pylist() for c in texts.mapInArrow(run, "id long, y int, key string, x binary").toArrow().columns), strict=True)}
    bags = [np.frombuffer(by[k], dtype=np.float32).reshape(-1, FEATURES) for k in sorted(by)]
    return Network().fit(bags, np.array([y for _, _, y in sorted(by)], dtype=np.float64))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2, threshold: float = 0.7, train_docs: int = 6000, **options
) -> DataFrame:
    """Train outside the held-out fold and score every row: ``(doc_id, held_out, score, predicted)``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("quality")).filter("quality in (0, 1)")
    known = known.filter(crc_of_id("doc_id") % folds != held)
    # The sample is chosen among the labels alone, so that only its texts are joined.
    chosen = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_docs)
    network = train(rows, chosen, **options)
    shared = docs.sparkSession.sparkContext.broadcast(vars(network))  # plain arrays: broadcasts are not pickled by value

    def run(batches):
        network = Network.of(shared.value)
        for b in batches:
            score = network.scores(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(crc_of_id("doc_id") % folds == held, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
