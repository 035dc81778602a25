"""Definitions from Scala-like source texts: a reader of declarations that does not look into bodies.

It reads packages, classes, traits and objects with their type parameters, constructors and parents, and the values, variables and
methods declared in them with a written type. Nothing is type-checked: a name is the declared type of
that name in the same text, else a standard one, else as written. What is private or protected, local or anonymous
is of no interest, and a member without a written type is an error row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import BY_NAME, FUNCTION, IMPLICIT, REPEATED, TUPLE, Param, Type, member, method
from ..functions.variance import CO, CONTRA, INV, flip
from ..plans.errors import QueryError
from ..plans.language import Raw, read_type
from .definitions import DEFINITION, complete, conversion_views, inheritance_views, parse_comment, type_row, value_row, view_row
from .files import dealt

#: Where standard names live (fixed values).
STANDARD = {
    **dict.fromkeys(("Any", "AnyRef", "AnyVal", "Nothing", "Null", "Unit", "Boolean", "Byte", "Short", "Char", "Int", "Long", "Float", "Double", "Array", "Option", "Some"), "scala."),
    **dict.fromkeys(("String", "Object", "Integer", "Throwable", "Exception"), "java.lang."), **dict.fromkeys(("List", "Map", "Set", "Vector"), "scala.collection.immutable."), **dict.fromkeys(("Seq", "Iterable", "Traversable"), "scala.collection."),
}
MODIFIERS = frozenset("private protected implicit override abstract final sealed lazy case".split())
_WORD = re.compile(r'\s+|(/\*.*?(?:\*/|\Z))|//[^\n]*|("""(?:.|\n)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\')|(=>|<:|>:|<%)|([A-Za-z_$][\w$]*|[+\-*/:!?|&<>=^%#@~\\]+|\d[\w.]*|[\[\](){},;.`])|.', re.S)


@dataclass
class Token:
    text: str
    start: int
    stop: int
    doc: str = ""  # the documentation comment before it
    line: bool = False  # whether it begins a line


def tokens(text: str) -> list[Token]:
    out, doc, line = [], "", True
    for m in _WORD.finditer(text):
        if m[1]:
            doc = m[1] if m[1].startswith("/**") else doc
        if m[0].isspace() or m[1] or m[0].startswith("//"):
            line = line or "\n" in m[0]
            continue
        out.append(Token(m[0], m.start(), m.end(), doc, line))
        doc, line = "", False
    return out


@dataclass
class Owner:
    """A package, class, trait or object."""

    name: str = ""
    kind: str = "package"
    params: tuple[Param, ...] = ()
    public: bool = True
    abstract: bool = False
    link: str = ""
    scope: int = 0  # tells apart places of a text where names may mean something else
    written: tuple[tuple[str, str, str, str], ...] = ()  # its parameters with bounds, as Declared has them
    scopes: tuple[tuple[str, str, str], ...] = ()  # what is around: (package, type, import or all; path; alias), outermost first

    @property
    def type(self) -> Type:
        return Type(CO, self.name, tuple(Type(p.variance, p.name, (), True) for p in self.params))

    def inside(self, name: str) -> str:
        return f"{self.name}.{name}" if self.name else name


@dataclass
class Declared:
    """What a declaration says before types are resolved."""

    kind: str
    owner: Owner
    name: str
    params: tuple[tuple[str, str, str, str], ...]  # name, variance, upper bound, lower bound
    clauses: list[tuple[bool, list[tuple[str, str]]]]  # implicit, (name, type)
    result: str
    flags: set[str]
    doc: str
    start: int
    me: Owner | None = None
    parents: list[str] = field(default_factory=list)


class Reader:
    """Declarations of one text."""

    def __init__(self, text: str):
        self.text, self.words, self.at = text, tokens(text), 0
        self.found: list[Declared] = []
        self.scope_count = 0
        self.body(Owner(), False)

    def within(self, owner: Owner, *scopes: tuple[str, str, str]) -> Owner:
        """``owner`` with more around it."""
        self.scope_count += 1
        return replace(owner, scope=self.scope_count, scopes=(*owner.scopes, *scopes))

    def peek(self, n: int = 0) -> str:
        return self.words[self.at + n].text if self.at + n < len(self.words) else ""

    def take(self) -> str:
        self.at += 1
        return self.words[self.at - 1].text if self.at <= len(self.words) else ""

    def skip_group(self) -> None:
        """Past a bracketed group."""
        depth = 0
        while self.peek():
            word = self.take()
            depth += (word in ("(", "[", "{")) - (word in (")", "]", "}"))
            if depth <= 0:
                return

    def type_text(self, stops: tuple[str, ...]) -> str:
        """The words of a type up to one of ``stops`` outside brackets, or to a new line that cannot go on with it."""
        out: list[str] = []
        while (word := self.peek()) and word not in stops and word not in (")", "]", "}", ";"):
            if out and self.words[self.at].line and out[-1] not in ("=>", "with", ",") and word not in ("=>", "with", "["):
                break
            begin = self.at
            if word in ("(", "[", "{"):
                self.skip_group()
            else:
                self.at += 1
            out += [w.text for w in self.words[begin : self.at]]
        return " ".join(out)

    def qualified(self) -> str:
        name = self.take()
        while self.peek() == ".":
            self.at += 1
            name += "." + self.take()
        return name

    def body(self, owner: Owner, braces: bool) -> None:
        while word := self.peek():
            if word == "}":
                if braces:
                    self.at += 1
                    return
                self.at += 1
            elif word == "package" and self.peek(1) != "object":
                self.at += 1
                inner = replace(owner, name=owner.inside(self.qualified()), kind="package")
                inner.link = inner.name + "."
                inner = self.within(inner, ("package", inner.name, ""))
                if self.peek() == "{":
                    self.at += 1
                    self.body(inner, True)
                else:
                    owner = inner
            elif word == "import":
                owner = self.within(owner, *self.imports())
            elif word in MODIFIERS or word in ("class", "trait", "object", "def", "val", "var"):
                self.declaration(owner)
            elif word in ("(", "[", "{"):
                self.skip_group()
            else:
                self.at += 1

    def imports(self) -> list[tuple[str, str, str]]:
        """The paths of an import clause: by name, renamed in braces, or all of a path."""
        self.at += 1
        out, path = [], []
        while (word := self.peek()) and (not self.words[self.at].line or not path) and word != ";":
            if word == "{":
                begin = self.at + 1
                self.skip_group()
                inside = [w.text for w in self.words[begin : self.at - 1]]
                for part in " ".join(inside).split(","):
                    name, _, alias = (x.strip() for x in part.partition("=>"))
                    if name == "_":
                        out.append(("all", ".".join(path), ""))
                    elif name and alias != "_":
                        out.append(("import", ".".join([*path, name]), alias or name))
                path = ["{"]
                continue
            self.at += 1
            if word == ",":
                out += self._imported(path)
                path = []
            elif word != ".":
                path.append(word)
        return out + self._imported(path)

    @staticmethod
    def _imported(path: list[str]) -> list[tuple[str, str, str]]:
        if not path or path == ["{"]:
            return []
        path = path[1:] if path[0] == "_root_" else path
        return [("all", ".".join(path[:-1]), "")] if path[-1] == "_" else [("import", ".".join(path), path[-1])]

    def declaration(self, owner: Owner) -> None:
        doc, start, flags = self.words[self.at].doc, self.words[self.at].start, set()
        while self.peek() in MODIFIERS:
            flags.add(self.take())
            if self.peek() == "[" and flags & {"private", "protected"}:
                self.skip_group()
        kind = self.peek()
        if kind not in ("class", "trait", "object", "def", "val", "var"):
            return
        self.at += 1
        name = self.take()
        if name == "`":
            name = self.take()
            self.take()
        params = self.type_params() if self.peek() == "[" else ()
        if kind in ("class", "trait", "object"):
            self.template(owner, kind, name, params, flags, doc, start)
            return
        clauses = self.clauses()
        result = ""
        if self.peek() == ":":
            self.at += 1
            result = self.type_text(("=", "{"))
        self.found.append(Declared(kind, owner, name, params, clauses, result, flags, doc, start))
        if self.peek() in ("=", "{"):
            self.at += self.peek() == "="
            self.skip_body()

    def skip_body(self) -> None:
        """Past the expression on the right of a declaration."""
        first = True
        while (word := self.peek()) and word not in ("}", ")", "]", ";"):
            if not first and self.words[self.at].line and self.words[self.at - 1].text not in ("=", "=>", "else", "yield", "+", "."):
                if word in MODIFIERS or word in ("class", "trait", "object", "def", "val", "var", "type", "import", "package", "@"):
                    return
            self.skip_group() if word in ("(", "[", "{") else self.take()
            first = False

    def type_params(self) -> tuple[tuple[str, str, str, str], ...]:
        self.at += 1
        out = []
        while self.peek() and self.peek() != "]":
            sign = self.take() if self.peek() in ("+", "-") else ""
            name = self.take()
            if self.peek() == "[":
                self.skip_group()
            bounds = {}
            while self.peek() in ("<:", ">:", ":", "<%"):
                bound = self.take()
                bounds[bound] = self.type_text((",", "<:", ">:", ":", "<%"))
            out.append((name, sign, bounds.get("<:", ""), bounds.get(">:", "")))
            if self.peek() == ",":
                self.at += 1
        self.at += 1
        return tuple(out)

    def clauses(self) -> list[tuple[bool, list[tuple[str, str]]]]:
        out = []
        while self.peek() == "(":
            self.at += 1
            implicit = self.peek() == "implicit"
            self.at += implicit
            params: list[tuple[str, str]] = []
            while self.peek() and self.peek() != ")":
                while self.peek() in MODIFIERS or self.peek() in ("val", "var"):
                    self.at += 1
                name = self.take()
                if self.peek() == ":":
                    self.at += 1
                    params.append((name, self.type_text((",", "="))))
                if self.peek() == "=":
                    self.at += 1
                    while self.peek() and self.peek() not in (",", ")"):
                        self.skip_group() if self.peek() in ("(", "[", "{") else self.take()
                if self.peek() == ",":
                    self.at += 1
            self.at += 1
            out.append((implicit, params))
        return out

    def template(self, owner: Owner, kind: str, name: str, params, flags, doc, start) -> None:
        if kind == "class":
            while self.peek() in MODIFIERS:
                flags.add(f"constructor {self.take()}")
                if self.peek() == "[":
                    self.skip_group()
        clauses = self.clauses() if kind == "class" else []
        parents = []
        if self.peek() == "extends":
            self.at += 1
            while True:
                parents.append(self.type_text(("with", "{") if self.peek() == "(" else ("with", "{", "(")))
                while self.peek() == "(":
                    self.skip_group()
                if self.peek() != "with":
                    break
                self.at += 1
        public = owner.public and not flags & {"private", "protected"}
        link = f"{owner.link}{name}" + ("$" if kind == "object" else ".")
        me = Owner(owner.inside(name), kind, tuple(Param(n, v) for n, v, *_ in params), public, "abstract" in flags or kind == "trait", link, written=params, scopes=owner.scopes)
        me = self.within(me, ("type", me.name, ""))
        self.found.append(Declared(kind, owner, name, params, clauses, "", flags, doc, start, me, parents))
        if self.peek() == "{":
            self.at += 1
            self.body(me, True)


def plain_type(text: str) -> str:
    """A type as written, without marks of by-name and repeated parameters and without what is mixed in or refined."""
    return re.split(r"\s(?:with|forSome)\s|\{", text.strip().removeprefix("=> ").removesuffix(" *"))[0]


class Resolver:
    """Types of declarations, by the names declared beside them."""

    scope = 0

    def __init__(self, found: list[Declared]):
        self.types: dict[str, list[Owner]] = {}
        for d in found:
            if d.me is not None and d.kind != "object":
                self.types.setdefault(d.name, []).append(d.me)

    def qualified(self, name: str) -> tuple[str, tuple[Param, ...]]:
        own = self.types.get(name) or [o for os in self.types.values() for o in os if o.name == name]
        if own:
            return own[0].name, own[0].params
        return STANDARD.get(name, "") + name, ()

    def type(self, text: str, bound: set[str], v: str = CO) -> Type:
        text = text.strip()
        if text.startswith("=> "):
            return Type(v, BY_NAME, (self.type(text[3:], bound, v),))
        if text.endswith(" *"):
            return Type(v, REPEATED, (self.type(text[:-2], bound, v),))
        return self.of(read_type(plain_type(text)), bound, v)

    def of(self, raw: Raw, bound: set[str], v: str) -> Type:
        if raw.name in bound:
            return Type(v, raw.name, tuple(self.of(a, bound, v) for a in raw.args), True)
        arity = len(raw.args)
        if raw.name == FUNCTION.format(arity - 1):
            return Type(v, raw.name, (*(self.of(a, bound, flip(v)) for a in raw.args[:-1]), self.of(raw.args[-1], bound, v)))
        if raw.name == TUPLE.format(arity):
            return Type(v, raw.name, tuple(self.of(a, bound, v) for a in raw.args))
        name, params = self.qualified(raw.name)
        signs = [p.variance for p in params] if len(params) == arity else [INV if raw.name == "Array" else CO] * arity
        at = {CO: v, CONTRA: flip(v), INV: INV}
        return Type(v, name, tuple(self.of(a, bound, at[s]) for a, s in zip(raw.args, signs, strict=True)))


def _params(params, resolver: Resolver, bound: set[str]) -> list[Param]:
    bounds = lambda u, low: ({"upper": resolver.type(u, bound, CONTRA)} if u else {}) | ({"lower": resolver.type(low, bound, CO)} if low else {})
    return [Param(n, v, **bounds(u, low)) for n, v, u, low in params]


def _method(clauses, out: Type, resolver: Resolver, bound: set[str]) -> Type:
    for implicit, params in reversed(clauses):
        given = [resolver.type(t, bound, CONTRA) for _, t in params]
        out = method([Type(CONTRA, IMPLICIT, (t,)) for t in given] if implicit else given, out)
    return out


def of_interest(d: Declared) -> bool:
    """Public, and declared in what is public; a constructor also in a class that is not abstract."""
    return d.owner.public and not d.flags & {"private", "protected"}


def read_declarations(text: str, linked: Resolver | None = None, **where) -> list[dict]:
    """Definition rows of one source text.

    With ``linked``, a resolver of names across texts, parents are rows of kind ``parent`` in place of views from direct parents.
    """
    found = Reader(text).found
    resolver, rows = linked or Resolver(found), []
    for d in filter(of_interest, found):
        owner = d.owner if d.me is None else d.me
        resolver.scope = owner.scope
        bound = {p.name for p in owner.params} | {p[0] for p in d.params}
        place = {**where, "start": d.start, "stop": d.start + len(d.name)}
        body, attributes = parse_comment(d.doc) if d.doc else ("", [])
        said = {"comment": body, "attributes": [{"key": k, "value": v} for k, v in attributes]}
        try:
            if d.me is not None:
                rows += _template(d, resolver, bound, said, place, linked is not None)
                continue
            if not d.result:
                raise ValueError(f"{d.owner.inside(d.name)} has no written type")
            params = _params((*owner.written, *d.params), resolver, bound)
            static = owner.kind in ("object", "package")
            flags = {"overrides"} & {"overrides" if f == "override" else f for f in d.flags} | ({"implicit"} & d.flags) | ({"static"} if static else set())
            tpe = _method(d.clauses, resolver.type(d.result, bound), resolver, bound)
            tpe = tpe if static else member(owner.type, tpe)
            name = owner.inside(d.name)
            shown = "".join(f"({','.join(n + ':' + t.replace(' ', '') for n, t in params_)})" for _, params_ in d.clauses)
            link = f"{owner.link.rstrip('.')}@{d.name}{shown}:{d.result.replace(' ', '')}"
            rows.append(value_row(name, tpe, params, flags, doc_link=link, **said, **place))
            rows += [view_row(v, **where) for v in conversion_views(name, tpe, flags, params)]
        except (ValueError, QueryError) as problem:
            rows.append({"kind": "error", "name": d.owner.inside(d.name), "error": str(problem), **where})
    return rows


def _parents(d: Declared, resolver: Resolver, bound: set[str], where: dict) -> list[dict]:
    """The parents as rows, with their places; those that are not found as errors."""
    me, rows = d.me, []
    own = Type(CO, f"{me.name}.type") if me.kind == "object" else me.type
    for i, p in enumerate(d.parents):
        try:
            target = resolver.type(p, bound)
            rows.append({"kind": "parent", "name": me.name, "tpe": own.encode(), "target": target.encode(), "start": i, "params": [], "attributes": [], "flags": ["static"] if me.kind == "object" else [], **where})
        except (ValueError, QueryError) as problem:
            rows.append({"kind": "error", "name": me.name, "error": str(problem), **where})
    return rows


def _template(d: Declared, resolver: Resolver, bound: set[str], said: dict, place: dict, linked: bool) -> list[dict]:
    me = d.me
    where = {k: v for k, v in place.items() if k not in ("start", "stop")}
    parents = [] if linked else [resolver.type(p, bound) for p in d.parents]
    above = _parents(d, resolver, bound, where) if linked else []
    if me.kind == "object":
        own = Type(CO, f"{me.name}.type")
        return [value_row(me.name, own, (), {"static"}, doc_link=me.link, **said, **place), *above, *(() if linked else (view_row(v, **where) for v in inheritance_views(own, parents)))]
    params = _params(d.params, resolver, bound)
    rows = [type_row(me.name, params, **{**said, **where, "doc_link": me.link.rstrip(".")})] if not said["attributes"] else [{**type_row(me.name, params, said["comment"], **where, doc_link=me.link.rstrip(".")), "attributes": said["attributes"]}]
    rows += above if linked else [view_row(v, **where) for v in inheritance_views(me.type, parents)]
    if me.kind == "class" and not me.abstract and not any(f.startswith("constructor p") for f in d.flags):
        rows.append(value_row(f"{me.name}.<init>", _method(d.clauses or [(False, [])], me.type, resolver, bound), params, {"static"}, **said, **place))
    return rows


def read_sources(sources: DataFrame, text: str = "text", artifact: str = "artifact", inner: str = "inner_path", module: str | None = None) -> DataFrame:
    """Definitions of a table of source texts, such as the entries of archives, in parallel; distinct."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = []
            for body, path, entry, m in zip(frame["body"], frame["path"], frame["entry"], frame["module"], strict=True):
                rows += [complete(r) for r in read_declarations(body, artifact=path, inner_path=entry, module_id=m)]
            yield pd.DataFrame(rows, columns=[f.name for f in DEFINITION.fields])

    given = sources.select(F.col(text).alias("body"), F.col(artifact).alias("path"), F.col(inner).alias("entry"), (F.col(module) if module else F.lit("")).alias("module"))
    return dealt(given.filter("body is not null").distinct()).mapInPandas(run, DEFINITION)
