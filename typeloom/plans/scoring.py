"""Scores of fingerprints against a weighted tree, in single precision.

The terms of a fingerprint are consumed in order of what they could add at most. Each takes the best leaf it finds; a sum goes on
without the leaf, a maximum with the chosen alternative alone.
"""

from __future__ import annotations

from collections import deque

import numpy as np

from .expansion import Leaf, Max, Sum, Tree, leaves

ZERO, ONE, LOOSE = np.float32(0), np.float32(1), np.float32(0.1)


def _prepare(tree):
    """Plain tuples: ('leaf', term, boost), ('sum' | 'max', parts); None is nothing."""
    if isinstance(tree, Leaf):
        return ("leaf", tree.term, np.float32(tree.boost))
    parts = tuple(p for p in map(_prepare, tree.parts) if p is not None)
    return _shrink("sum" if isinstance(tree, Sum) else "max", parts)


def _shrink(kind, parts):
    return None if not parts else parts[0] if len(parts) == 1 else (kind, parts)


def _take(node, term):
    """The best (gain, rest) of ``term`` in ``node``; None if it has no leaf for it."""
    if node[0] == "leaf":
        return (node[2], None) if node[1] == term else None
    best, at = None, -1
    for i, part in enumerate(node[1]):
        got = _take(part, term)
        if got is not None and (best is None or got[0] > best[0]):
            best, at = got, i
    if best is None or node[0] == "max":
        return best
    rest = node[1][:at] + (() if best[1] is None else (best[1],)) + node[1][at + 1 :]
    return best[0], _shrink("sum", rest)


def _left(node) -> np.float32:
    """Leaves that no term took: of a maximum the mean over its alternatives."""
    if node is None:
        return ZERO
    if node[0] == "leaf":
        return ONE
    total = sum((_left(p) for p in node[1]), ZERO)
    return total if node[0] == "sum" else np.float32(total / np.float32(len(node[1])))


class Scorer:
    """Scores fingerprints, given as sorted (term, optional) pairs."""

    def __init__(self, tree: Tree | None):
        self.tree = _prepare(tree) if tree is not None else None
        self.boosts: dict[str, list[np.float32]] = {}
        for leaf in sorted(leaves(tree), key=lambda x: -x.boost):
            self.boosts.setdefault(leaf.term, []).append(np.float32(leaf.boost))

    def order(self, fingerprint) -> list[tuple[str, bool]]:
        """By potential, best first; equal ones in reverse."""
        open_ = {t: deque(b) for t, b in self.boosts.items()}
        potential = []
        for i, (term, optional) in enumerate(fingerprint):
            own = open_.get(term)
            potential.append((-(own.popleft() if own else ZERO), -i, term, optional))
        potential.sort(key=lambda x: (x[0], x[1]))
        return [(term, optional) for _, _, term, optional in potential]

    def score(self, fingerprint) -> tuple[float, float, list[tuple[str, float]]]:
        """Score, penalty, and what each matched term added."""
        node, score, missed, gains = self.tree, ZERO, ZERO, []
        for term, optional in self.order(fingerprint):
            got = None if node is None else _take(node, term)
            if got is None:
                missed = np.float32(missed + (LOOSE if optional else ONE))
            else:
                score, node = np.float32(score + got[0]), got[1]
                gains.append((term, float(got[0])))
        return float(score), float(np.float32(missed + _left(node))), gains


def final_score(score, penalty, doc_score, penalty_weight: float = 0.1, doc_boost: float = 0.1):
    """What results are ranked by; works on numbers and arrays."""
    f = np.float32
    return (np.asarray(score, f) / (f(1) + f(penalty_weight) * np.asarray(penalty, f)) + f(doc_boost) * np.log(np.asarray(doc_score, f) + f(1))).astype(f)


__all__ = ["Leaf", "Max", "Scorer", "Sum", "final_score"]
