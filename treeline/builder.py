"""Queries built in Python instead of written as JSON.

    read("user").select("id", "name").many("tokens", read().select("value")).where(field("name").like("A%")).page(20)
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from treeline.plans.wire import Aggregate, Logic, Page, Query, Sort, Test, to_braces, to_json


@dataclass(frozen=True)
class Condition:
    """A filter; ``&``, ``|`` and ``~`` combine filters."""

    expr: Test | Logic

    def __and__(self, other: Condition) -> Condition:
        return Condition(Logic("and", (self.expr, other.expr)))

    def __or__(self, other: Condition) -> Condition:
        return Condition(Logic("or", (self.expr, other.expr)))

    def __invert__(self) -> Condition:
        return Condition(Logic("not", (self.expr,)))


@dataclass(frozen=True)
class Named:
    """A field, or in $having and $orderBy an aggregate."""

    name: str
    aggregate: bool = False

    def _test(self, op: str, value: Any = None) -> Condition:
        return Condition(Test(self.name, op, tuple(value) if op in ("in", "nin") else value, self.aggregate))

    def eq(self, value: Any) -> Condition:
        return self._test("eq", value)

    def ne(self, value: Any) -> Condition:
        return self._test("ne", value)

    def gt(self, value: Any) -> Condition:
        return self._test("gt", value)

    def gte(self, value: Any) -> Condition:
        return self._test("gte", value)

    def lt(self, value: Any) -> Condition:
        return self._test("lt", value)

    def lte(self, value: Any) -> Condition:
        return self._test("lte", value)

    def among(self, *values: Any) -> Condition:
        return self._test("in", values)

    def not_among(self, *values: Any) -> Condition:
        return self._test("nin", values)

    def like(self, pattern: str) -> Condition:
        return self._test("like", pattern)

    def ilike(self, pattern: str) -> Condition:
        return self._test("ilike", pattern)

    def is_null(self) -> Condition:
        return self._test("isNull")

    def is_not_null(self) -> Condition:
        return self._test("isNotNull")

    def asc(self, nulls_first: bool = False) -> Sort:
        return Sort(self.name, False, nulls_first, self.aggregate)

    def desc(self, nulls_first: bool = False) -> Sort:
        return Sort(self.name, True, nulls_first, self.aggregate)


def field(name: str) -> Named:
    return Named(name)


def aggregate(name: str) -> Named:
    return Named(name, True)


class Read:
    """A query under construction; every call changes and returns it."""

    def __init__(self, name: str):
        self.query = Query(name)

    def select(self, *fields: str) -> Read:
        self.query.select |= dict.fromkeys(fields, True)
        return self

    def related(self, name: str, child: Read) -> Read:
        child.query.name = name
        self.query.select[name] = child.query
        return self

    one = many = related

    def where(self, condition: Condition) -> Read:
        had = self.query.where
        self.query.where = condition.expr if had is None else Logic("and", (had, condition.expr))
        return self

    def order(self, *sorts: Sort) -> Read:
        self.query.order += sorts
        return self

    def page(self, first: int | None = None, after: str | None = None) -> Read:
        self.query.page = Page(first, after)
        return self

    def distinct(self, *fields: str) -> Read:
        self.query.distinct += fields
        return self

    def group(self, *fields: str) -> Read:
        self.query.group += fields
        return self

    def aggregate(self, alias: str, fn: str, of: str | None = None, distinct: bool = False) -> Read:
        self.query.aggregates[alias] = Aggregate(fn, of, distinct)
        return self

    def having(self, condition: Condition) -> Read:
        self.query.having = condition.expr
        return self

    def json(self) -> dict:
        return to_json(self.query)

    def braces(self) -> str:
        return to_braces(self.query)


def read(name: str = "") -> Read:
    return Read(name)
