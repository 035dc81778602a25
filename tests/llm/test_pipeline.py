"""The pipeline's stages on what their predecessors keep, and the registered queries."""

import __spark_entry__
import corpus_pipeline
from tests.conftest import TABLES
from typeloom.llm import mixing, queries, shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_texts_go_to_python_once_in_small_batches(spark, monkeypatch):
    docs = spark.range(0, 8000, 1, 1).selectExpr("id as doc_id", "repeat('the cat and ', 400) as text", "'en' as lang", "'s' as source", "4800 as n_chars")
    spark.conf.unset(shared.BATCH_LIMIT)
    frame, sent = type(docs), []
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: sent.append(self) or plain(self, *a, **b))
    try:
        corpus_pipeline.language_id(spark, docs, TABLES)
        (packed,) = sent
        sizes = [r["b"] for r in plain(packed, nbytes, "b long").collect()]
    finally:
        spark.conf.unset(shared.BATCH_LIMIT)
    assert len(sizes) > 2 and max(sizes) < shared.BATCH_BYTES + 100_000
    assert sum(sizes) < 1.1 * 8000 * 4800


def nbytes(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["b"])


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    (_, language), (_, exact), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES

    kept = language(spark, docs, TABLES).cache()
    assert kept.columns == COLUMNS
    gone = docs.join(kept, "doc_id", "left_anti")
    assert gone.count() <= 4 and all(len(r["text"]) < 100 for r in gone.collect())

    once = exact(spark, kept, TABLES).cache()
    rows = kept.collect()
    assert once.columns == COLUMNS
    assert {r["doc_id"] for r in once.collect()} == set({r["text"]: r["doc_id"] for r in sorted(rows, key=lambda r: r["doc_id"])}.values())

    far = near(spark, once, TABLES).cache()
    assert far.columns == COLUMNS
    sets = {r["doc_id"]: shingles(r["text"]) for r in once.collect()}
    left = {r["doc_id"] for r in far.collect()}
    for d in set(sets) - left:
        assert any(similar(sets[d], sets[o]) >= 0.8 for o in sets if o != d)  # only near copies go
    pairs = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b]) >= 0.8]
    assert all(not {a, b} <= left for a, b in pairs)  # and no link is lost

    mixed = mix(spark, far, TABLES).cache()
    assert mixed.columns == COLUMNS
    words = {}
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    target = {r["source"]: r["target"] for r in mixing.mix_report(far).join(far.select("doc_id", "source"), "doc_id").collect()}
    longest = max(len(r["text"].split()) for r in far.collect())
    assert all(abs(words.get(s, 0) - t) <= longest / 2 + 1 for s, t in target.items())

    packed = pack(spark, mixed, TABLES)
    assert sum(r["length"] for r in packed.collect()) == sum(words.values())


def shingles(text, n=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def similar(a, b):
    return len(a & b) / len(a | b)


def test_run(spark):
    assert corpus_pipeline.run(spark, TABLES).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_null_columns(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "the of and that", "en", None, 1), (2, "the of and that", None, "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, TABLES).cache()
        assert docs.count() <= 3
    empty = spark.read.parquet(f"{TABLES}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, TABLES)
        assert empty.count() == 0


def test_registration():
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
