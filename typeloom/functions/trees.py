"""The algebra of types on preorder arrays, as column expressions.

A tree is an array of nodes ``(variance, name, arity, is_param)`` in preorder, so a subtree is a slice: it ends
where the places that its arities open are filled. Trees of types are small, so a fold that appends to
an array costs little.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NODE = "struct<variance:string,name:string,arity:int,is_param:boolean>"
_TREES = f"array<array<{_NODE}>>"


def let(value: Column, body) -> Column:
    """``body`` of a variable that holds ``value``, which is made once."""
    return F.transform(F.array(value), body)[0]


def forest(nodes: Column) -> Column:
    """The trees that stand one after the other in ``nodes``."""
    # `open`: places of the current tree that are still to be filled; at 0 the next node begins a tree.
    start = F.struct(F.lit(0).alias("open"), F.array().cast(_TREES).alias("trees"))

    def step(a, n):
        begins = a["open"] == 0
        last = F.size(a["trees"]) - 1
        grown = F.concat(F.slice(a["trees"], 1, F.greatest(last, F.lit(0))), F.array(F.array_append(a["trees"][F.greatest(last, F.lit(0))], n)))
        trees = F.when(begins, F.array_append(a["trees"], F.array(n))).otherwise(grown)
        return F.struct(F.when(begins, n["arity"]).otherwise(a["open"] - 1 + n["arity"]).alias("open"), trees.cast(_TREES).alias("trees"))

    return F.aggregate(nodes, start, step, lambda a: a["trees"])


def arguments(tree: Column) -> Column:
    """The arguments of the root, as trees."""
    return forest(F.slice(tree, 2, F.greatest(F.size(tree) - 1, F.lit(0))))


def _node(variance: Column, of: Column, arity: Column | None = None) -> Column:
    return F.struct(variance.alias("variance"), of["name"].alias("name"), (of["arity"] if arity is None else arity).alias("arity"), of["is_param"].alias("is_param"))


def at_root(variance: Column | str, tree: Column) -> Column:
    """The tree with another variance of its root."""
    v = F.lit(variance) if isinstance(variance, str) else variance
    return F.concat(F.array(_node(v, tree[0])), F.slice(tree, 2, F.greatest(F.size(tree) - 1, F.lit(0))))


def substitute(tree: Column, names: Column, values: Column) -> Column:
    """Parameters among ``names`` replaced by the trees in ``values`` at the same places, in the variance of the place.

    A parameter that has arguments itself stays as it is.
    """

    def one(n):
        at = F.array_position(names, n["name"])
        return F.when(n["is_param"] & (n["arity"] == 0) & (at > 0), at_root(n["variance"], F.get(values, (at - 1).cast("int")))).otherwise(F.array(_node(n["variance"], n)))

    return F.flatten(F.transform(tree, one))


def rendered(tree: Column) -> Column:
    """The tree as text: ``+p.A[+p.B, -p.C]``."""
    # `left`: for each open level how many arguments are still to come.
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<int>").alias("left"))

    def step(a, n):
        label = F.concat(n["variance"], n["name"])
        # Levels that are full are closed; the innermost of the others has one argument less to come.
        opened = F.when(n["arity"] > 0, F.array_append(a["left"], n["arity"])).otherwise(_closed(a["left"]))
        shut = F.when(n["arity"] > 0, F.lit("[")).otherwise(F.concat(F.repeat(F.lit("]"), F.size(a["left"]) - F.size(_closed(a["left"]))), F.when(F.size(_closed(a["left"])) > 0, ", ").otherwise("")))
        return F.struct(F.concat(a["text"], label, shut).alias("text"), opened.cast("array<int>").alias("left"))

    return F.aggregate(tree, start, step, lambda a: a["text"])


def _closed(left: Column) -> Column:
    """Open levels after a node without arguments: those it completes are gone, the next has one less."""
    # The innermost run of levels that wait for one argument only.
    keep = F.size(left) - F.coalesce(F.array_position(F.transform(F.reverse(left), lambda x: x > 1), True), F.lit(0))
    full = F.forall(left, lambda x: x == 1)
    at = F.when(full, F.lit(-1)).otherwise(keep).cast("int")
    return F.when(at < 0, F.array().cast("array<int>")).otherwise(F.array_append(F.slice(left, 1, F.greatest(at, F.lit(0))), F.get(left, F.greatest(at, F.lit(0))) - 1))
