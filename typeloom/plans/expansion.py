"""From a type to a weighted tree of alternatives.

A tree's leaves are terms; ``Sum`` nodes want all their parts, ``Max`` nodes one of their alternatives.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from ..functions.types import IGNORED, Type, View, ignored
from ..functions.variance import CO
from .errors import TooManyClauses


@dataclass(frozen=True)
class Leaf:
    """A term with its share of the query, its distance from what was asked, and what it adds to a score."""

    term: str
    fraction: float = 1.0
    distance: int = 0
    boost: float = 0.0
    frequency: float = 0.0

    def __str__(self) -> str:
        return f"{self.term}^{self.boost:g}"


@dataclass(frozen=True)
class Sum:
    parts: tuple

    def __str__(self) -> str:
        return f"sum({', '.join(map(str, self.parts))})"


@dataclass(frozen=True)
class Max:
    parts: tuple

    def __str__(self) -> str:
        return f"max({', '.join(map(str, self.parts))})"


Tree = Leaf | Sum | Max
#: Alternatives of a type: (type, share of information retained, distance).
Alternatives = Callable[[Type], Iterable[tuple[Type, float]]]


def leaves(tree: Tree | None) -> Iterator[Leaf]:
    if isinstance(tree, Leaf):
        yield tree
    elif tree is not None:
        for p in tree.parts:
            yield from leaves(p)


def expand(t: Type, views: Alternatives, limit: int = 50_000, fractions: bool = True) -> Tree:
    """All the ways in which fingerprints can match ``t``, the share of each halved by what it shares a place with.

    A type that encloses an argument again is not expanded in it. More than ``limit``
    nodes raise :class:`TooManyClauses`.
    """
    clauses = 0

    def count() -> None:
        nonlocal clauses
        clauses += 1
        if clauses > limit:
            raise TooManyClauses(limit)

    def parts(x: Type, outer: frozenset, share: float, distance: int) -> Tree:
        count()
        if x.is_kind(IGNORED):
            return Sum(tuple(either(a, outer, share / len(x.args)) for a in x.args))
        args = [a for a in x.args if not a.param]
        each = share / (1 + len(args))
        below = [leaf(a, each, 0) if a in outer else either(a, outer, each) for a in args]
        return Sum((leaf(x, each, distance), *below))

    def either(x: Type, outer: frozenset, share: float) -> Tree:
        count()
        others = list(dict.fromkeys(views(x)))
        outer = outer | {x} | {y for y, _ in others}
        return Max((parts(x, outer, share, 0), *(parts(y, outer, share * kept, 1) for y, kept in others)))

    def leaf(x: Type, share: float, distance: int) -> Leaf:
        return Leaf(x.variance + x.name, share if fractions else 1.0, distance)

    return parts(t if t.is_kind(IGNORED) else ignored([t]), frozenset(), 1.0, 0)


def minimize(tree: Tree) -> Tree:
    """The same alternatives with single nodes unwrapped and parts that several share taken out."""
    if isinstance(tree, Leaf):
        return tree
    if isinstance(tree, Sum):
        if len(tree.parts) == 1 and isinstance(tree.parts[0], Leaf):
            return tree.parts[0]
        return Sum(tuple(map(minimize, tree.parts)))
    if len(tree.parts) == 1 and isinstance(tree.parts[0], Leaf):
        return tree.parts[0]
    alternatives = list(map(minimize, tree.parts))
    while (shared := _most_shared(alternatives)) is not None:
        holding = [a for a in alternatives if isinstance(a, Sum) and shared in a.parts]
        rests = tuple(_less_one(a.parts, shared) for a in holding)
        joint = Sum((minimize(Max(rests)), shared))
        alternatives = [joint, *(a for a in alternatives if not any(a is h for h in holding))]
    return Max(tuple(alternatives))


def _most_shared(alternatives: list[Tree]):
    """The part that most sums hold, if more than one does; the first seen of several."""
    counts: dict[Tree, int] = {}
    for a in alternatives:
        if isinstance(a, Sum):
            for p in dict.fromkeys(a.parts):
                counts[p] = counts.get(p, 0) + 1
    best = max(counts, key=lambda p: counts[p], default=None)
    return best if best is not None and counts[best] > 1 else None


def _less_one(parts: tuple, part) -> Tree:
    i = parts.index(part)
    rest = parts[:i] + parts[i + 1 :]
    return rest[0] if len(rest) == 1 else Sum(rest)


def fixpoint(tree: Tree) -> Tree:
    """Minimise until nothing changes, with single sums and maxima unwrapped as well."""
    while True:
        new = _unwrap(minimize(tree))
        if new == tree:
            return new
        tree = new


def _unwrap(tree: Tree) -> Tree:
    if isinstance(tree, Leaf):
        return tree
    parts = tuple(map(_unwrap, tree.parts))
    if len(parts) == 1 and not isinstance(parts[0], type(tree)) and not isinstance(parts[0], Leaf):
        inner = parts[0].parts
        return inner[0] if len(inner) == 1 else parts[0]
    return parts[0] if len(parts) == 1 and isinstance(parts[0], Leaf) else type(tree)(parts)


def canonical(tree: Tree):
    """The tree without the order of its parts, for comparisons."""
    if isinstance(tree, Leaf):
        return ("leaf", tree.term)
    return (type(tree).__name__.lower(), tuple(sorted(map(canonical, tree.parts), key=repr)))


# --- weights -----------------------------------------------------------------------------


def itf(frequency: float, base: float) -> float:
    """Inverse type frequency: 1 for a term in no value, near 0 for one in all."""
    if base == 0:
        return 1.0
    return max(math.log(base / (frequency * base + (1 - frequency))) / math.log(base), 0.001)


def weigh(tree: Tree, frequency: Callable[[str], float], base: float = 2.7, distance_weight: float = 0.2) -> Tree:
    if isinstance(tree, Leaf):
        f = frequency(tree.term)
        return Leaf(tree.term, tree.fraction, tree.distance, tree.fraction * (1 - distance_weight * tree.distance) * itf(f, base), f)
    return type(tree)(tuple(weigh(p, frequency, base, distance_weight) for p in tree.parts))


def candidate_terms(tree: Tree, cutoff: float) -> list[str]:
    """Terms, best leaf first, as long as the frequencies of those kept sum to less than ``cutoff``.

    A term that would not fit is passed over; later ones may still fit.
    """
    kept, total, seen = [], 0.0, set()
    for leaf in sorted(leaves(tree), key=lambda x: -x.boost):
        if (leaf.term, leaf.frequency) in seen:
            continue
        seen.add((leaf.term, leaf.frequency))
        if total + leaf.frequency < cutoff:
            total += leaf.frequency
            kept.append(leaf.term)
    return kept


def views_between(views: Iterable[View], steps: int = 0) -> Alternatives:
    """Alternatives through ``views``: one hop and ``steps`` more, the best retained share of each type.

    Hops are followed breadth first; a view key that a shorter way has passed is not
    passed again. Views from a bare parameter apply to the start alone.
    """
    by_key: dict[str, list[View]] = {}
    for v in views:
        by_key.setdefault(v.source.key(), []).append(v)

    def alternatives(t: Type) -> list[tuple[Type, float]]:
        found: dict[Type, float] = {}
        seen: set[str] = set()
        front = {t: 1.0}
        for _ in range(steps + 1):
            after: dict[Type, float] = {}
            keys = set()
            for x, kept in front.items():
                if x.key() in seen:
                    continue
                keys.add(x.key())
                for v in by_key.get(x.key(), ()):
                    y = None if v.source.param else v(x)
                    if y is not None:
                        after[y] = max(after.get(y, 0.0), kept * v.retained)
            seen |= keys
            for y, kept in after.items():
                found[y] = max(found.get(y, 0.0), kept)
            front = after
        for v in by_key.get(f"{t.variance}_", ()):
            y = v(t)
            if y is not None:
                found[y] = max(found.get(y, 0.0), 1.0)
        found.pop(t, None)
        return list(found.items())

    return alternatives


def identity_root(variance: str = CO) -> Type:
    """The parameter that generic views start from."""
    return Type(variance, "_", (), True)
