"""Language identification by compression (operator 3).

A language's model is a raw-content zstandard dictionary of training text. A text is encoded with
every dictionary, in blocks of whole words so that the text's own repetitions do not drown what the
dictionary contributes, and goes to the language with the smallest total. A text whose two
smallest totals differ by less than ``min_margin`` of the smallest is rejected.

The dictionaries are fitted on a bounded sample: at most ``sample_docs`` documents a language, those
with the smallest hash of id and text among the training rows, whole texts until ``dict_bytes`` are reached. (Of a text
of more than ``PIECES * PIECE`` characters, that many pieces evenly spread over the whole of it.) Every text is encoded whole.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and is rejected; so is every
text if there is no training row; ties go to the language first in code-point order; repeated rows get
equal answers; an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_of_id, give_back

_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: What ``\w`` matches beside letters, decimal digits and the underscore: number signs such as those for one half.
_NUMBERS = frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl"))


def letters(text: str | None) -> bytes:
    """Lower-cased letters (Unicode categories L), runs of anything else as one space."""
    text = text or ""
    if not text.isascii() and not _NUMBERS.isdisjoint(text):
        text = "".join(" " if c in _NUMBERS else c for c in text)
    return _NOT_LETTERS.sub(" ", text).lower().strip().encode("utf-8", "replace")


#: Pieces of a very long training text, and their characters.
PIECES, PIECE = 32, 1024


def blocks(data: bytes, size: int) -> list[bytes]:
    """``data`` in blocks of about ``size`` bytes, cut at spaces where there is one."""
    out, at = [], 0
    while len(data) - at > size:
        end = data.rfind(b" ", at, at + size)
        end = end if end > at else at + size
        out.append(data[at:end])
        at = end
    out.append(data[at:])
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 128, dict_bytes: int = 96_000) -> dict[str, bytes]:
    """Dictionaries by language from the rows of ``docs``, which must all be training rows."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col)).alias("h")).filter("lang is not null and text rlike '\\\\p{L}'")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    # A hash threshold leaves about 4 x sample_docs rows a language, before the exact number is taken.
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4 * sample_docs / n)))])
    near = rows.filter(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < share[F.col("lang")])
    spread = f"array_join(transform(sequence(0, {PIECES - 1}), i -> substr(text, cast(i * ((char_length(text) - {PIECE}) / {PIECES - 1}) as int) + 1, {PIECE})), ' ')"
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("nth") <= sample_docs)
    near = near.select("lang", "nth", F.expr(f"if(char_length(text) <= {PIECES * PIECE}, text, {spread})").alias("text"))
    parts: dict[str, list[bytes]] = {k: [] for k in sorted(counts)}
    size = dict.fromkeys(counts, 0)
    for r in sorted(near.collect(), key=lambda r: (r["lang"], r["nth"])):
        data = letters(r["text"])
        if size[r["lang"]] + len(data) <= dict_bytes or not size[r["lang"]]:
            parts[r["lang"]].append(data)
            size[r["lang"]] += len(data) + 1
    return {k: b" ".join(v) or b" " * 8 for k, v in parts.items()}


class Encoders:
    """One compressor a language; sizes of a text under each."""

    def __init__(self, models: dict[str, bytes], level: int = 9, block: int = 512):
        self.langs = sorted(models)
        self.block = block
        self.compressors = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(models[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False))

    def sizes(self, text: str | None) -> list[int]:
        data = letters(text)
        parts = blocks(data, self.block)
        return [sum(len(c.compress(x)) for x in parts) for c in self.compressors] if data else []

    def predict(self, text: str | None, sharpness: float = 60.0) -> tuple[str, float, float]:
        """Language, score in 0..1 (the best's share after a softmax of relative sizes), margin."""
        sizes = self.sizes(text)
        if not sizes:
            return "und", 0.0, 0.0
        least = min(sizes)
        second = min((s for i, s in enumerate(sizes) if i != sizes.index(least)), default=2 * least)
        score = 1 / sum(math.exp(-sharpness * min(10.0, (s - least) / least)) for s in sizes)
        return self.langs[sizes.index(least)], score, (second - least) / least


def identify(docs: DataFrame, models: dict[str, bytes], text_col: str = "text", min_margin: float = 0.002) -> DataFrame:
    """``docs`` with ``lang_pred string, score double, margin double, rejected boolean`` for each row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)
    names = docs.columns
    # A text goes to Python once, within its row, unless it must be cast.
    within = names.index(text_col) if text_col in names and docs.schema[text_col].dataType == T.StringType() else None
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), *([F.col(text_col).cast("string").alias("t")] if within is None else []))

    def run(batches):
        encoders = Encoders(shared.value)
        for batch in batches:
            texts = batch.column(1) if within is None else batch.column(0).field(within)
            found = [encoders.predict(t) for t in texts.to_pylist()]
            cols = [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())]
            cols.append(pa.array([x[0] == "und" or x[2] < min_margin for x in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, names=["row", "lang_pred", "score", "margin", "rejected"])

    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return packed.mapInArrow(lambda it: give_back(run(it)), schema)


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held: int = 0, **options) -> DataFrame:
    """Train outside the held-out fold (crc32 of the id mod ``folds`` is ``held``) and answer for every row.

    Returns ``(doc_id, held_out, lang_pred, score, margin, rejected)``. A null id is never held out nor trained on.
    """
    fold = crc_of_id(id_col) % folds
    models = train(docs.filter(fold != held), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    only_ids = rows.withColumn("held_out", F.coalesce(crc_of_id("doc_id") % folds == held, F.lit(False)))
    return identify_ids(only_ids, models, **options)


def identify_ids(rows: DataFrame, models: dict[str, bytes], min_margin: float = 0.002) -> DataFrame:
    """As :func:`identify` for ``rows(doc_id, text, held_out)``, without sending texts back from Python."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        encoders = Encoders(shared.value)
        for batch in batches:
            found = [encoders.predict(t) for t in batch.column(2).to_pylist()]
            cols = [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())]
            cols.append(pa.array([x[0] == "und" or x[2] < min_margin for x in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean")
