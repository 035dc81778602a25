"""What can be wrong with a query, and how users are told."""

from __future__ import annotations


class QueryError(Exception):
    """Any query that cannot be answered."""

    def message(self) -> str:
        return str(self)


class SyntaxProblem(QueryError):
    def message(self) -> str:
        return f"Syntax error: {self}"


class NameNotFound(QueryError):
    def message(self) -> str:
        return f"Type {self} not found."


class NameAmbiguous(QueryError):
    def __init__(self, name: str, candidates: list[str]):
        super().__init__(name)
        self.candidates = candidates

    def message(self) -> str:
        return f"Type {self} is ambiguous: it could be any of {', '.join(self.candidates)}."


class WrongArity(QueryError):
    def __init__(self, name: str, given: int, expected: int):
        super().__init__(name)
        self.given, self.expected = given, expected

    def message(self) -> str:
        return f"Type {self} takes {self.expected} arguments, but {self.given} are given."


class TooManyClauses(QueryError):
    def message(self) -> str:
        return f"The query expands to more than {self} clauses; please use more specific types."


class TooUnspecific(QueryError):
    def message(self) -> str:
        return "The query is too unspecific."
