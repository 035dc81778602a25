"""From names as written to types."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cache

from ..functions.types import FUNCTION, METHOD, UNKNOWN, Param, Type
from ..functions.variance import CO, CONTRA, INV, times
from .errors import NameAmbiguous, NameNotFound, WrongArity
from .language import Raw

#: Preferred among types with a suffix, in order; each unless none is left.
PREFERENCES = (r"scala\..*", r"(scala\.([^\.#]+))|java\.lang\.String")


@dataclass(frozen=True)
class TypeName:
    """A type definition as far as queries need it."""

    name: str
    params: tuple[Param, ...] = ()


@dataclass(frozen=True)
class Resolved:
    """A definition with its arguments; None stands for any type."""

    definition: TypeName | None
    args: tuple[Resolved, ...] = ()


def favour(candidates: list[TypeName], patterns=PREFERENCES) -> list[TypeName]:
    for p in patterns:
        better = [c for c in candidates if re.fullmatch(p, c.name)]
        candidates = better or candidates
    return candidates


def names(raw: Raw) -> set[str]:
    return {raw.name}.union(*(names(a) for a in raw.args))


def resolve(raw: Raw, by_suffix: Callable[[str], list[TypeName]]) -> Resolved:
    """A single letter that names no type stands for any."""
    args = tuple(resolve(a, by_suffix) for a in raw.args)
    found = favour(list(dict.fromkeys(by_suffix(raw.name))))
    if not found:
        if len(raw.name) == 1 and (raw.name == "_" or raw.name.isalpha()) and not raw.args:
            return Resolved(None)
        raise NameNotFound(raw.name)
    if len(found) > 1:
        raise NameAmbiguous(raw.name, sorted(c.name for c in found))
    params = found[0].params
    if len(args) == len(params):
        return Resolved(found[0], args)
    if not args:
        return Resolved(found[0], (Resolved(None),) * len(params))
    raise WrongArity(raw.name, len(args), len(params))


def to_type(r: Resolved, v: str = CO) -> Type:
    """Signs by the parameters' variances; any is the lower bound where given, the upper where taken, else unknown."""
    if r.definition is None:
        return Type(CO, UNKNOWN)
    return _typed(r, v)


def _typed(r: Resolved, v: str) -> Type:
    args = []
    for param, arg in zip(r.definition.params, r.args, strict=True):
        at = times(v, param.variance) if param.variance else INV
        if arg.definition is None:
            bound = {CO: param.lower, CONTRA: param.upper, INV: Type(INV, UNKNOWN)}[at]
            args.append(replace(bound, variance=at))
        else:
            args.append(_typed(arg, at))
    return Type(v, r.definition.name, tuple(args))


@cache
def standard_names() -> tuple[TypeName, ...]:
    """Functions, tuples and methods of every arity that queries may use; made once, as they are asked for with every name."""
    out = []
    for n in range(23):
        takes = tuple(Param(f"T{i}", CONTRA) for i in range(n))
        gives = tuple(Param(f"T{i}", CO) for i in range(n))
        out += [TypeName(FUNCTION.format(n), (*takes, Param("R", CO))), TypeName(METHOD.format(n), (*takes, Param("R", CO)))]
        if n > 1:
            out.append(TypeName(f"scala.Tuple{n}", gives))
    return tuple(out)


@cache
def standard_by_name() -> dict[str, TypeName]:
    return {t.name: t for t in standard_names()}
