"""Language (3), quality (6) and language-model (8) operators: held-out accuracy, brute force, edge cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from typeloom.llm import context_mixing, langid, quality
from typeloom.llm.shared import LOWER_BYTES

TABLES = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score double, held_out string"
EDGES = [(1, None, "en", 0.0, "x"), (2, "", "en", 0.0, "x"), (3, "123 !!", None, 0.0, "x"), (None, "the of and", "en", 0.0, "x"), (5, "x" * 300_000, "de", 0.0, "x"), (5, "x" * 300_000, "de", 0.0, "x"), (7, "der die das und", "de", 0.0, "x")]


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet").cache()


# --- language ---------------------------------------------------------------------------


def test_language_accuracy(docs):
    rows = langid.language_of(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for held in (True, False):
        own = [r for r in rows if r["held_out"] == held]
        assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in own)
        assert np.mean([r["lang"] == r["lang_pred"] for r in own if len(r["text"]) > 60]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["rejected"] for r in rows]) < 0.03


def test_language_edges(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    got = {}
    for r in langid.language_of(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [(got[i][0]["lang_pred"], got[i][0]["score"], got[i][0]["rejected"]) for i in (1, 2, 3)] == [("und", 0.0, True)] * 3
    assert len(got[5]) == 2 and got[5][0] == got[5][1] and got[None][0]["held_out"] is False
    assert langid.language_of(spark.createDataFrame([], SCHEMA)).count() == 0
    untrained = langid.language_of(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in untrained} == {"und"}
    kept = langid.identify(df, {"en": b"the of and " * 20, "de": b"der die das und " * 20})
    assert kept.count() == len(EDGES) and kept.select("row.held_out").columns == ["held_out"]


def test_language_against_brute_force(docs):
    """Every text under every dictionary, block by block, in plain Python."""
    some = docs.limit(200)
    models = langid.train(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    assert all(len(m) <= 96_000 for m in models.values()) and set(models) == {"de", "en", "es", "fr"}

    def size(text, model):
        held = "".join(c if c.isalpha() else " " for c in text).lower().split()
        data, total, at = " ".join(held).encode(), 0, 0
        compressor = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(model, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
        while at < len(data):
            stop = len(data) if len(data) - at <= 512 else (data.rfind(b" ", at, at + 512) if data.rfind(b" ", at, at + 512) > at else at + 512)
            total += len(compressor.compress(data[at:stop]))
            at = stop
        return total

    got = {r["row"]["doc_id"]: r for r in langid.identify(some, models).collect()}
    for r in some.collect():
        sizes = sorted((size(r["text"], m), k) for k, m in models.items())
        own = got[r["doc_id"]]
        assert own["lang_pred"] == sizes[0][1]
        assert own["margin"] == pytest.approx((sizes[1][0] - sizes[0][0]) / sizes[0][0]) and own["rejected"] == (own["margin"] < 0.002)


def test_number_signs_are_no_letters(spark):
    df = spark.createDataFrame([(1, "² ½ ③ Ⅷ"), (2, "x² ½y")], "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, {"en": b"x y z " * 9}).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] == "en"
    assert langid.letters("x²½y é_1") == "x y é".encode()


def test_training_takes_whole_texts(spark):
    words = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}" for i in range(1000)]
    rows = [(i, " ".join(words[i * 10 : i * 10 + 10]), "x") for i in range(100)] + [(500, "zz " * 400_000, "long"), (501, "end", "long")]
    models = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(models["x"].split()) == {w.encode() for w in words}
    assert len(models["long"]) <= 96_000


def test_blocks_hold_the_whole_text():
    data = langid.letters("Aä b,c 12 " * 400 + "z" * 3000)
    assert b"".join(langid.blocks(data, 100)) == data
    assert langid.letters("A1b!C") == b"a b c"


# --- quality ----------------------------------------------------------------------------


def test_quality_accuracy(spark, docs):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    for held, least in ((True, 0.9), (False, 0.97)):
        own = [r for r in rows if r["held_out"] == held]
        assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) for r in own)
        assert np.mean([r["predicted"] == r["quality"] for r in own]) > least
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)


def test_quality_edges(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (7, 1), (7, 1), (None, 1), (5, 2)], "doc_id long, quality int")
    got = quality.quality_scores(df, labels).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.quality_scores(df, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_gradients():
    """The network's gradients are those of its loss."""
    rng = np.random.default_rng(0)
    net, x, begins, y = quality.Network(hidden=6, attention=4), rng.standard_normal((9, quality.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.forward(x, begins)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in net.gradients(x, begins, y).items():
        flat = net.p[name].reshape(-1)
        for i in rng.choice(flat.size, min(5, flat.size), replace=False):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_scores_against_brute_force():
    """Attention and score of each document by itself, in loops."""
    rng = np.random.default_rng(4)
    net = quality.Network(seed=1)
    net.mean, net.scale = rng.random(quality.FEATURES), 0.5 + rng.random(quality.FEATURES)
    texts = ["one two three.", None, "", "A long Text, " * 300, "x" * 3000, "many words " * 70]
    p = net.p

    def score(text):
        hidden, logits = [], []
        for x in quality.encode(text).astype(float):
            x = np.clip((x - net.mean) / net.scale, -6, 6)
            h = [max(0.0, sum(x[i] * p["W"][i, j] for i in range(len(x))) + p["b"][j]) for j in range(len(p["b"]))]
            v, u = (sum(h[i] * p[m][i] for i in range(len(h))) for m in "VU")
            hidden.append(h)
            logits.append(sum(math.tanh(a) / (1 + math.exp(-b)) * c for a, b, c in zip(v, u, p["w"], strict=True)))
        weights = [math.exp(e - max(logits)) for e in logits]
        z = [sum(w * h[j] for w, h in zip(weights, hidden, strict=True)) / sum(weights) for j in range(len(p["c"]))]
        return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["d"][0])))

    assert net.scores(texts) == pytest.approx([score(t) for t in texts], rel=1e-5)


def test_the_sample_is_bounded_by_passages():
    assert quality.within([5, 3, 4, 1, 1], 9) == [True, True, False, True, False]
    assert quality.within([], 3) == []


def test_passages_cover_the_text():
    assert quality.encode("").shape == quality.encode(None).shape == (1, quality.FEATURES)
    assert len(quality.encode("w " * (quality.WORDS * 3 + 1))) == 4
    base = quality.PAIRS + quality.CLASSES
    assert quality.encode("a b c d")[0, base] == 1 and quality.encode("a a a a")[0, base] == 0.25
    assert quality.encode("a a a b")[0, base + 1] == 0.5


# --- language model ---------------------------------------------------------------------


def tokens_of(text):
    return (text or "").encode().translate(LOWER_BYTES).split() + [b""]


def test_base_scores_against_brute_force(docs):
    got = {r["doc_id"]: r for r in context_mixing.context_mixing_scores(docs).collect()}
    words = {r["doc_id"]: tokens_of(r["text"]) for r in docs.select("doc_id", "text").collect()}
    counts = Counter()
    for d, w in words.items():
        if crc(d, 5) != 1:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for d, w in words.items():
        r = got[d]
        assert r["held_out"] == (crc(d, 5) == 1) and r["train_tokens"] == n and r["n_tokens"] == len(w)
        assert r["n_known"] == sum(counts[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r["score"] < 0
    # The model is better than single words, on short texts too.
    for least, most in ((0, 300), (300, 10**9)):
        held = [r for r in got.values() if r["held_out"] and least <= r["n_tokens"] < most]
        assert sum(r["score"] - r["base_score"] for r in held) > 0.05 * sum(r["n_tokens"] for r in held)


def test_counts_beyond_the_head(docs, monkeypatch):
    some = docs.limit(40)
    whole = sorted(map(tuple, context_mixing.context_mixing_scores(some).collect()))
    monkeypatch.setattr(context_mixing, "HEAD", 50)
    fewer = sorted(map(tuple, context_mixing.context_mixing_scores(some).collect()))
    for a, b in zip(whole, fewer, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_batches_for_python_are_bounded_in_bytes(docs, monkeypatch):
    """Every Python job of the scores has the limit in bytes, and the session's own setting is back after it."""
    from typeloom.llm.shared import BATCH_BYTES, BATCH_LIMIT

    conf, frame, seen = docs.sparkSession.conf, type(docs), []
    conf.set(BATCH_LIMIT, "1g")
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: seen.append(conf.get(BATCH_LIMIT)) or plain(self, *a, **b))
    try:
        context_mixing.context_mixing_scores(docs.limit(40)).collect()
        assert len(seen) == 4 and {int(x) for x in seen} == {BATCH_BYTES}
        assert BATCH_BYTES <= context_mixing.PART_BYTES  # so a batch is one part
        assert conf.get(BATCH_LIMIT) == "1g"
    finally:
        conf.unset(BATCH_LIMIT)


TEXTS = ["the cat and the dog and the cat and the bird", None, " \t", "A  b\tc a b c A B C a b d \x1c é", "one", "the dog " * 40, "x y z x y z x y q"]
M64 = (1 << 64) - 1


def lines_of(words, i):
    """First slot of both lines in each table, from the words before token i."""
    cm = context_mixing
    h = [(xxhash.xxh64_intdigest(w, 42) | 1) if w else 0 for w in words]
    code = 1 + xxhash.xxh64_intdigest(words[i], 42) % 255 if words[i] else 0
    one, two = (h[i - 1] if i else 0), (h[i - 2] if i > 1 else 0)
    a, b, c = int(cm._A), int(cm._B), int(cm._C)
    contexts = [one * b & M64, (one * a & M64) ^ ((two * b & M64) >> 7), two * c & M64]
    out = [(0, (code // 16 + 1) * 16)]
    for k, x in enumerate(contexts):
        rows = cm.ORDERS[k] // 16
        place = lambda y: cm.BEGINS[k] + 16 * (((y & M64) * c & M64) * rows >> 64)  # noqa: B023, E731
        out.append((place(x), place(x + (code // 16 + 1) * a)))
    return code, contexts, out


def sequential(words, n0, n1, weights, map_):
    """Natural logarithm of the probability of a text's bytes, one bit after the other."""
    cm = context_mixing
    total, size = 0.0, cm.RECENT
    for i in range(len(words)):
        if i % cm.SEGMENT == 0:
            w, m = weights.astype(float).copy(), map_.astype(float).reshape(8, -1).copy()
            memory = [{}, {}]
        code, (one, pair, _), lines = lines_of(words, i)
        expected = []
        for k, x in enumerate((pair, one)):
            key, check = ((x * int(cm._C)) & M64) * size >> 64, (((x >> 20) & 0xFFFF) | 1) & 0xFF
            known = memory[k].get(key, (0, 0))
            expected.append(known[1] if known[0] == check else None)
            memory[k][key] = (check, code)
        for bit in range(8):
            value = code >> (7 - bit) & 1
            half, depth = divmod(bit, 4)
            nibble = code >> 4 if half == 0 else code & 15
            node = 1 << depth | nibble >> (4 - depth)
            x = [float(np.clip(np.rint(np.float32(np.log((n1[s[half] + node] + np.float32(0.4)) / (n0[s[half] + node] + np.float32(0.4)))) * 16), -127, 127)) / 16 for s in lines]
            told = [0 if e is None or (e >> (8 - bit)) != (code >> (8 - bit)) else 2 * (e >> (7 - bit) & 1) - 1 for e in expected]
            x = np.array(x + told + [0.3, 0.0])
            gate = 2 if told[0] else 1 if told[1] else 0
            logit = float(np.clip(w[bit, gate] @ x, -8, 8))
            w[bit, gate] += cm.RATE * (value - 1 / (1 + math.exp(-logit))) * x
            cell = int(logit * 2 + 16.5)
            refined = m[bit, cell]
            m[bit, cell] += cm.MAP_RATE * (value - 1 / (1 + math.exp(-refined)))
            total -= math.log1p(math.exp((logit + refined) / 2 * (1 - 2 * value)))
    return total


@pytest.mark.parametrize("segment", [4096, 16])
def test_scores_against_one_bit_after_the_other(monkeypatch, segment):
    """Counts, weights, gates, followers and the map, side by side, are those of plain sequential scoring."""
    cm = context_mixing
    monkeypatch.setattr(cm, "SEGMENT", segment)
    words = [tokens_of(t) for t in TEXTS]
    held = Counter()
    for w in words:
        for i in range(len(w)):
            code, _, lines = lines_of(w, i)
            held.update(x for high, low in lines for x in (high + code // 16, low + code % 16))
    counted = np.zeros(cm.SLOTS)
    for rows in cm._counted([pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["text"])]):
        for r in rows.to_pylist():
            if r["chunk"] >= 0:
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["data"]), np.uint32)
                counted[r["chunk"] * cm.CHUNK :][: len(part)] += part
    assert {int(i): counted[i] for i in np.flatnonzero(counted)} == held
    n0, n1 = cm.bit_counts(counted)
    weights = cm.start_weights() + np.random.default_rng(3).normal(0, 0.1, cm.start_weights().shape).astype(np.float32)
    mixer = cm.Mixer(cm.packed(cm.stretch(n0, n1)), weights, cm.start_map(), lanes=3)
    got = mixer.run(cm.Tokens(pa.array(TEXTS)))
    assert got == pytest.approx([sequential(w, n0, n1, weights, cm.start_map()) for w in words], rel=1e-4)
    alone = [cm.Mixer(mixer.lines.view(np.int8), weights, cm.start_map()).run(cm.Tokens(pa.array([t], pa.string())))[0] for t in TEXTS]
    assert got == pytest.approx(alone, rel=1e-5)


def test_learning_moves_weights_and_map_within_short_texts(monkeypatch):
    cm = context_mixing
    t = cm.Tokens(pa.array(["a b c d e f g h i j"] * 2 + ["a b a b a b a b a b"]))
    table, m = np.zeros(cm.SLOTS, np.int8), cm.start_map()
    moving = cm.Mixer(table, cm.start_weights(), m).run(t)
    frozen = cm.Mixer(table, cm.start_weights(), m, rate=0).run(t)
    plain = cm.Mixer(table, cm.start_weights(), m, rate=0, map_rate=0).run(t)
    assert moving[0] == pytest.approx(moving[1]) and (moving != frozen).all() and (frozen != plain).all()
    assert plain[2] > plain[0] + 5  # what followed before is expected again


def test_own_counts_are_left_out():
    cm = context_mixing
    n0, n1 = np.array([3.0, 0.0, 1.0], np.float32), np.array([1.0, 1.0, 0.0], np.float32)
    own = cm.without_own(n0, n1)
    assert (own[::2] == cm.packed(cm.stretch(np.array([2.0, 0, 0]), n1))).all() and (own[1::2] == cm.packed(cm.stretch(n0, np.array([0.0, 0, 0])))).all()


def test_the_model_is_a_distribution():
    """Over the next byte of a text the probabilities sum to one."""
    cm = context_mixing
    rng = np.random.default_rng(0)
    table = rng.integers(-60, 60, cm.SLOTS).astype(np.int8)
    byte = {}
    for i in range(40_000):
        byte.setdefault(1 + xxhash.xxh64_intdigest(f"w{i}".encode(), 42) % 255, f"w{i}")
    assert len(byte) == 255
    before = "a b a b a"
    texts = pa.array([before] + [f"{before} {w}" for w in byte.values()])

    class Cut(cm.Tokens):  # the last token alone differs: an end or a word
        def __init__(self, texts):
            super().__init__(texts)
            keep = np.ones(len(self.code), bool)
            keep[self.ends[1:] - 1] = False
            self.sizes = self.sizes - np.append(0, np.ones(len(self.sizes) - 1, int))
            for name in ("code", "one", "pair", "skip", "number"):
                setattr(self, name, getattr(self, name)[keep])
            self.ends = np.cumsum(self.sizes)
            self.starts = self.ends - self.sizes

    logs = cm.Mixer(table, cm.start_weights(), cm.start_map()).run(Cut(texts))
    known = cm.Tokens(pa.array([before]))
    known.sizes, known.ends = known.sizes - 1, known.ends - 1
    shared = cm.Mixer(table, cm.start_weights(), cm.start_map()).run(known)[0]
    assert np.exp(logs - shared).sum() == pytest.approx(1, abs=1e-3)


def test_model_edges(spark):
    got = context_mixing.context_mixing_scores(spark.createDataFrame(EDGES, SCHEMA)).collect()
    assert len(got) == len(EDGES) and all(np.isfinite(r["score"]) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == 1 and by[1]["bits_per_byte"] is None and by[None]["held_out"] is False
    assert context_mixing.context_mixing_scores(spark.createDataFrame([], SCHEMA)).count() == 0
