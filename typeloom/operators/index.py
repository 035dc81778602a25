"""What an index derives from definitions: fingerprints, postings, suffixes, view keys, statistics."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.types import IGNORED, Type, View, fingerprint, normalize, structure
from ..functions.variance import INV
from ..plans.expansion import views_between
from ..sources.definitions import params_of
from ..sources.files import dealt, kept

TERMS = "array<struct<term:string,optional:boolean>>"


def split_kinds(definitions: DataFrame) -> dict[str, DataFrame]:
    """One table a kind of definition."""
    d = definitions
    module = F.coalesce("module_id", text.module_id(F.col("organization"), F.col("module"), F.col("revision")))
    d = d.withColumn("module_id", module)
    common = ["name", "params", "comment", "attributes", "module_id"]
    modules = d.filter("kind in ('value', 'type', 'view')").select("module_id").distinct()
    part = F.split("module_id", ":")
    return {
        "values": d.filter("kind = 'value'").select(*common, "tpe", "flags", "artifact", "inner_path", "start", "stop", "doc_link"),
        "type_defs": d.filter("kind = 'type'").select(*common),
        "views": d.filter("kind = 'view'").select("name", F.col("tpe").alias("source"), "target", "module_id"),
        "modules": modules.select("module_id", F.get(part, 0).alias("organization"), F.get(part, 1).alias("name"), F.get(part, 2).alias("revision")),
        "errors": d.filter("kind = 'error'").select("name", "error", "module_id"),
    }


def _trees(column: pa.ListArray) -> list[list[tuple] | None]:
    """Preorder rows of the types of a batch, column by column."""
    nodes = column.flatten()
    rows = list(zip(*(nodes.field(i).to_pylist() for i in range(4)), strict=True))
    ends = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).cumsum().tolist()
    return [rows[a:b] if b > a else None for a, b in zip([0, *ends], ends, strict=False)]


def _params(column: pa.ListArray) -> list:
    return column.to_pylist() if len(column.flatten()) else [None] * len(column)


def with_fingerprints(values: DataFrame, polarized: bool = True) -> DataFrame:
    """Values with the terms of their types, their signature, and the key that results are grouped by.

    All columns go through Arrow once, those that are not needed as they are; nothing is joined back.
    """
    at = {c: values.columns.index(c) for c in ("name", "tpe", "params")}
    kinds = pa.list_(pa.struct([("term", pa.string()), ("optional", pa.bool_())]))

    def run(batches):
        for b in batches:
            names, types, params = b.column(at["name"]).to_pylist(), _trees(b.column(at["tpe"])), _params(b.column(at["params"]))
            terms, signatures, groups = [], [], []
            for name, tpe, rows in zip(names, types, params, strict=True):
                t, ps = Type.decode(tpe), params_of(rows)
                terms.append([{"term": a, "optional": o} for a, o in fingerprint(t, ps, polarized)])
                shown = f"[{', '.join(p.variance + p.name for p in ps)}]" if ps else ""
                signatures.append(f"{name}{shown}: {t.signature()}")
                groups.append(str(structure(t)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(terms, kinds), pa.array(signatures, pa.string()), pa.array(groups, pa.string())], names=[*b.schema.names, "terms", "signature", "shape"])

    more = T.StructType([*values.schema.fields, *T.StructType.fromDDL(f"terms {TERMS}, signature string, shape string").fields])
    made = values.mapInArrow(run, more)
    return made.withColumn("group_key", F.concat_ws(" ", text.short_name(F.col("name")), F.col("shape"))).drop("shape")


def postings(values: DataFrame) -> DataFrame:
    """``(term, value_id, module_id, artifact, optional, occurrence)``; a value's terms are in order, so occurrences are counted inside its array."""
    numbered = F.expr("transform(terms, (t, i) -> named_struct('term', t.term, 'optional', t.optional, 'occurrence', cast(i + 2 - array_position(transform(terms, x -> x.term), t.term) as int)))")
    keep = [c for c in ("module_id", "artifact") if c in values.columns]
    each = values.select("value_id", *keep, F.explode(numbered).alias("t"))
    return each.select("t.term", "value_id", *keep, "t.optional", "t.occurrence")


def name_suffixes(type_defs: DataFrame) -> DataFrame:
    return type_defs.select(F.explode(text.suffixes(F.col("name"))).alias("suffix"), "name", F.size("params").alias("arity"), "params", "module_id")


def name_postings(values: DataFrame) -> DataFrame:
    """``(token, value_id, module_id, artifact)``: each token of each value's name once, made without a shuffle."""
    return values.select(F.explode(F.array_distinct(text.tokens(F.col("name")))).alias("token"), "value_id", "module_id", "artifact")


def with_all_tokens(postings: DataFrame, words: list[str]) -> DataFrame:
    """Ids of the values that have every one of the (distinct) ``words``; only their postings are read."""
    hits = postings.filter(F.col("token").isin(words)).groupBy("value_id").agg(F.count(F.lit(1)).alias("n"))
    return hits.filter(F.col("n") == len(words)).select("value_id")


def with_view_keys(views: DataFrame) -> DataFrame:
    """Views with the key of their source: its root and the variances of its arguments; a bare parameter is ``_``.

    Only the root and its direct arguments matter, which stand at known places of the preorder array.
    """
    # `pending` counts the open places below the current argument; at 0 the next node is an argument.
    step = "named_struct('pending', if(a.pending = 0, n.arity, a.pending - 1 + n.arity), 'at', if(a.pending = 0, array_append(a.at, n.variance), a.at))"
    fold = f"aggregate(slice(source, 2, size(source)), named_struct('pending', 0, 'at', cast(array() as array<string>)), (a, n) -> {step}, a -> a.at)"
    root = F.col("source")[0]
    args = F.expr(fold)
    name = F.concat(root["variance"], F.when(root["is_param"], F.lit("_")).otherwise(root["name"]))
    implicit = (root["name"] == "<implicit>") & (F.size(args) == 1)
    key = F.when(implicit, F.concat(F.get(args, 0), F.lit("_"))).when(F.size(args) == 0, name).otherwise(F.concat(name, F.lit("["), F.array_join(F.transform(args, lambda v: F.concat(v, F.lit("_"))), ", "), F.lit("]")))
    return views.withColumn("from_key", key)


def wanted_views(views: DataFrame) -> DataFrame:
    """No views from the root of all references: nearly every type has one, and they say nothing."""
    return views.filter(F.col("source")[0]["name"] != "java.lang.Object")


def _subtypes(values: DataFrame) -> DataFrame:
    """``(value_id, type_id, shown)``: the distinct subtrees of each value's normalized type. The ignored nodes that hold them together are none.

    Types are interned: ``type_id`` is a digest of the node and of its arguments' digests, and the type itself is
    in ``shown`` only where a task meets it first.
    """

    def run(batches):
        known: dict[Type, bytes] = {}

        def digest(t: Type) -> bytes:
            found = known.get(t)
            if found is None:
                node = json.dumps([t.variance, t.name, len(t.args), t.param]).encode()
                found = hashlib.blake2b(b"".join([node, *map(digest, t.args)]), digest_size=16).digest()
                if len(known) >= 100_000:
                    known.clear()
                    written.clear()
                known[t] = found
            return found

        written: set[bytes] = set()
        for b in batches:
            ids, types, shown = [], [], []
            for vid, tpe, params in zip(b.column(0).to_pylist(), _trees(b.column(1)), _params(b.column(2)), strict=True):
                for t in {t for t in normalize(Type.decode(tpe), params_of(params)).nodes() if not t.is_kind(IGNORED)}:
                    key = digest(t)
                    ids.append(vid)
                    types.append(key)
                    shown.append(None if key in written else json.dumps(t.encode()))
                    written.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(types, pa.binary()), pa.array(shown, pa.string())], names=["value_id", "type_id", "shown"])

    return values.select("value_id", "tpe", "params").mapInArrow(run, "value_id long, type_id binary, shown string")


_NAMED = "type_id binary, variance string, name string"
#: Views from a bare parameter are sent to all tasks if they are at most so many; their keys are three values, which a join would not split.
FEW_GENERIC = 10_000


def _seen_as_on_driver(types: DataFrame, views: list[View], steps: int) -> DataFrame:
    """``(type_id, variance, name)`` of the alternatives of each type through a list of views."""

    def run(frames):
        alternatives = views_between(views, steps)
        for frame in frames:
            rows = [(i, y.variance, y.name) for i, x in zip(frame["type_id"], frame["shown"], strict=True) for y, _ in alternatives(Type.decode(json.loads(x)))]
            yield pd.DataFrame(rows, columns=["type_id", "variance", "name"])

    return dealt(types.select("type_id", "shown")).mapInPandas(run, _NAMED)


def _seen_as_by_join(types: DataFrame, views: DataFrame, steps: int) -> DataFrame:
    """The same through a table of views: a round of hops is a join on the view key, with unification as what remains to check.

    As on the driver, a view key that a shorter way from the same type has passed is not passed again.
    """

    def keyed(frames):
        for frame in frames:
            found = [Type.decode(json.loads(x)) for x in frame["at"]]
            yield frame[["type_id", "at"]].assign(key=[t.key() for t in found], any_key=[f"{t.variance}_" for t in found])

    def hop(frames):
        for frame in frames:
            rows = []
            for i, at, source, target in zip(frame["type_id"], frame["at"], frame["source"], frame["target"], strict=True):
                y = View(Type.decode(source), Type.decode(target))(Type.decode(json.loads(at)))
                if y is not None:
                    rows.append((i, json.dumps(y.encode()), y.variance, y.name))
            yield pd.DataFrame(rows, columns=["type_id", "at", "variance", "name"])

    out_schema, key_schema = "type_id binary, at string, variance string, name string", "type_id binary, at string, key string, any_key string"
    front = types.select("type_id", F.col("shown").alias("at"))
    start = front.mapInPandas(keyed, key_schema)
    generic, direct = views.filter(F.col("source")[0]["is_param"]), views.filter(~F.col("source")[0]["is_param"])
    generic = F.broadcast(generic) if generic.limit(FEW_GENERIC + 1).count() <= FEW_GENERIC else generic
    found = start.join(generic, F.col("any_key") == F.col("from_key")).select("type_id", "at", "source", "target").mapInPandas(hop, out_schema)
    passed = None
    for _ in range(steps + 1):
        at = front.mapInPandas(keyed, key_schema)
        at = kept(at if passed is None else at.join(passed, ["type_id", "key"], "left_anti"))
        own = at.select("type_id", "key").distinct()
        passed = own if passed is None else passed.union(own)
        hops = kept(at.join(direct, F.col("key") == F.col("from_key")).select("type_id", "at", "source", "target").mapInPandas(hop, out_schema).distinct())
        found = found.union(hops)
        front = hops.select("type_id", "at")
    return found.select("type_id", "variance", "name").distinct()


def type_frequencies(values: DataFrame, views: list[View] | DataFrame, steps: int = 3, sample_size: int = 0) -> DataFrame:
    """``(variance, name, frequency)``: the share of values a type occurs in, itself or by its alternatives.

    A value's types are all subtrees of its normalized type, with the alternatives of each; polar
    ones count as invariant too. Each counts once a value. Alternatives are found once for each distinct
    type, through a list of views or, if there are too many for the driver, a table with their keys.
    """
    if sample_size:
        values = values.orderBy(F.xxhash64("name", "module_id"), "value_id").limit(sample_size)
    total = values.count()
    each = kept(_subtypes(values))  # asked for its types, and joined with what they are seen as
    types = kept(each.filter("shown is not null").groupBy("type_id").agg(F.min("shown").alias("shown")))
    seen = _seen_as_by_join(types, views, steps) if isinstance(views, DataFrame) else _seen_as_on_driver(types, views, steps)
    root = F.from_json("shown", "array<array<string>>")[0]
    named = seen.union(types.select("type_id", root[0], root[1]))
    named = named.union(named.select("type_id", F.lit(INV), "name")).distinct()
    once = each.select("value_id", "type_id").join(named, "type_id").select("value_id", "variance", "name").distinct()
    return once.groupBy("variance", "name").agg((F.count(F.lit(1)) / F.lit(max(total, 1))).cast("float").alias("frequency"))


def pivoted(type_defs: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Type definitions with their three frequencies, 0 where a type does not occur."""
    by = frequencies.groupBy("name").agg(*[F.coalesce(F.max(F.when(F.col("variance") == v, F.col("frequency"))), F.lit(0.0)).alias(c) for c, v in (("f_co", "+"), ("f_contra", "-"), ("f_inv", ""))])
    return type_defs.join(by, "name", "left").fillna(0.0, ["f_co", "f_contra", "f_inv"])
