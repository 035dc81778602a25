"""Sharding by a hierarchical weighted hash tree (operator 13).

A tree of regions, racks and shards; a node weighs what its shards weigh together. A row goes down from the
root: at each level every child makes a draw, ln(u) / weight with u in (0, 1) from a hash of the row's key and the child's
name, and the largest draw wins. A child's draw depends on its own name and weight alone. So when the weight of a shard changes,
only draws of that shard, its rack and its region do: a row moves only from a subtree that became lighter or into one
that became heavier, and rows whose draws at a level did not change hands stay below it.

``key`` is the law of placement: the row's id and the tree alone decide, whatever the other rows are. A new shard opens a region of its
own (:meth:`Tree.grown`), so no older draw changes and the new shard takes rows only into itself. The tree has a few rows a
shard and lies on the driver as literals; its depth bounds the draws, of which a row makes one for each child on its way.

Slots number the rows of a shard without gaps: rows are counted by shard and by hash part of the key, and numbered inside a
part, so that no task gets a whole shard.

Defined cases: a null id is drawn for as the empty text, a null text has no bytes (size 1, checksum 0); rows that repeat
an id are in one shard, in slots of their own, ordered by size and checksum (equal rows are interchangeable); equal texts
of different ids may lie apart, as only the key decides; an empty table gives no rows; other columns are ignored by
:func:`shard_report` and kept by :func:`write_shards`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, unused

#: Hexadecimal digits of a hash that a draw is made of (52 bits), and those that name a row's part.
DIGITS, PART = 13, 3


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    shards: tuple[Shard, ...]

    @classmethod
    def even(cls, n: int, racks: int = 2, per_rack: int = 2) -> Tree:
        """``n`` shards of equal weight, ``per_rack`` in a rack and ``racks`` racks in a region."""
        at = lambda s: (str(s // (racks * per_rack)), str(s // per_rack % racks))
        return cls(tuple(Shard(s, *at(s)) for s in range(n)))

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own."""
        number = max((s.number for s in self.shards), default=-1) + 1
        return Tree((*self.shards, Shard(number, f"new{number}", "0", weight)))

    def weighted(self, number: int, weight: float) -> Tree:
        """The tree with another weight of one shard; a weight of 0 takes it out."""
        return Tree(tuple(Shard(s.number, s.region, s.rack, weight if s.number == number else s.weight) for s in self.shards if s.number != number or weight))

    def place(self, key: Column) -> Column:
        """The shard of a row, as an expression."""
        return _descend(key, [((s.region, s.rack, str(s.number)), s) for s in self.shards], 0)


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.conv(F.left(F.md5(F.concat(key, F.lit(f":{name}"))), F.lit(DIGITS)), 16, 10).cast("long")
    return F.log((bits.cast("double") + 0.5) / float(16**DIGITS)) / F.lit(float(weight))


def _descend(key: Column, shards: list[tuple[tuple[str, ...], Shard]], level: int) -> Column:
    """Draws of the children at ``level`` among ``shards``, and below the winner the same again."""
    if level == 3:
        return F.lit(shards[0][1].number)
    children: dict[str, list] = {}
    for path, s in shards:
        children.setdefault("/".join(path[: level + 1]), []).append((path, s))
    below = [_descend(key, inside, level + 1) for inside in children.values()]
    if len(children) == 1:
        return below[0]
    draws = F.array(*[_draw(key, name, sum(s.weight for _, s in inside)) for name, inside in children.items()])
    # Bound to a variable, so that the draws are made once; ties go to the child that comes first.
    won = F.transform(F.array(draws), lambda d: F.array_position(d, F.array_max(d)))[0]
    out = F.when(won == 1, below[0])
    for i, b in enumerate(below[1:], 2):
        out = out.when(won == i, b)
    return out


def _placed(docs: DataFrame, tree: Tree, grown: Tree | None, id_col: str, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` and ``(id, size, crc, key, shard, grown_shard)`` of every row."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(*keep, F.col(id_col).cast("long").alias("id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    shards = [tree.place(key).cast("int").alias("shard"), (grown.place(key) if grown else F.lit(None)).cast("int").alias("grown_shard")]
    return rows.select(*[c for c in rows.columns], F.md5(key).alias("key"), *shards)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with their slot in the shard: those of the parts before, and the place in the own part."""
    rows = rows.withColumn("part", F.left("key", F.lit(PART)))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "id", "size", "crc"))
    return rows.withColumn("nth", nth).join(F.broadcast(before), ["shard", "part"]).withColumn("slot", F.col("before") + F.col("nth") - 1).drop("nth", "before", "part")


def shard_report(docs: DataFrame, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``(id_col, size, text_crc32, law, shard, slot, grown_shard, region, rack)``.

    ``tree``: 8 equal shards by default. ``grown_shard``: the shard with one more in the tree.
    """
    tree = tree or Tree.even(8)
    rows = cut(_placed(docs, tree, tree.grown(), id_col, text_col, []))
    where = F.create_map(*[x for s in tree.shards for x in (F.lit(s.number), F.struct(F.lit(s.region).alias("region"), F.lit(s.rack).alias("rack")))])
    out = _numbered(rows).withColumn("where", where[F.col("shard")])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard", "where.region", "where.rack")


def write_shards(docs: DataFrame, path: str, tree: Tree | None = None, files_per_shard: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of ``docs`` as Parquet into ``path/region=/rack=/shard=``, all their columns.

    Rows are dealt by shard and, inside it, by hash into ``files_per_shard`` files, so a shard is as many tasks.
    """
    tree = tree or Tree.even(8)
    names = {n: unused(n, docs) for n in ("region", "rack", "shard", "row")}
    placed = _placed(docs, tree, None, id_col, text_col, [F.struct(*[docs[c] for c in docs.columns]).alias(names["row"])])
    where = {s.number: s for s in tree.shards}
    of = lambda f: F.create_map(*[x for n, s in where.items() for x in (F.lit(n), F.lit(f(s)))])[F.col("shard")]
    dealt = placed.repartition(len(where) * files_per_shard, "shard", F.pmod(F.xxhash64("key"), F.lit(files_per_shard)))
    out = dealt.select(F.col(f"{names['row']}.*"), of(lambda s: s.region).alias(names["region"]), of(lambda s: s.rack).alias(names["rack"]), F.col("shard").alias(names["shard"]))
    out.write.partitionBy(names["region"], names["rack"], names["shard"]).parquet(path)
