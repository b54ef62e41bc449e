"""The engine: a schema over a catalog, answering queries."""

from __future__ import annotations

import contextlib
import io
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from treeline.access import AccessPolicy, Context
from treeline.errors import ResolverError, ValidationError
from treeline.operators.compiler import Compiled, compile_plan
from treeline.operators.flat import flat, nest
from treeline.operators.ordering import sorted_by
from treeline.operators.predicates import identity, predicate
from treeline.plans import cursor
from treeline.plans.analyze import Node, Options, analyze, both, summary
from treeline.plans.wire import Logic, Query, Test, parse
from treeline.plugins import Answer, Plugin
from treeline.schema import Schema
from treeline.sources.catalog import Catalog

POINT = object()
Resolver = Callable[[Node, Catalog], DataFrame]


@dataclass
class Result:
    """``data``: a record or None for a point, else {"items", "pageInfo"}; ``meta``: plan, explain text, milliseconds."""

    data: Any
    meta: dict


class Engine:
    def __init__(self, spark: SparkSession, schema: Schema, catalog: Catalog | dict, options: Options | None = None, access: AccessPolicy | None = None):
        self.spark, self.schema = spark, schema.checked()
        self.catalog = catalog if isinstance(catalog, Catalog) else Catalog(catalog)
        self.options, self.access = options or Options(), access
        self.plugins: list[Plugin] = []
        self.resolvers: dict[str, tuple[Resolver, bool, bool]] = {}

    def use(self, plugin: Plugin) -> Engine:
        self.plugins.append(plugin)
        return self

    def resolve(self, entity: str, fn: Resolver, nested: bool = False, joined: bool = False) -> Engine:
        """Rows of an entity (``*``: of all without their own) from a function: flat ones, or with ``nested`` records as
        the result has them.  ``joined`` says of flat rows that they are left joins of what the plan names, as
        ``operators.flat`` makes them: then the function is asked for each chain of relations alone, not for the product
        of several."""
        if entity != "*" and entity not in self.schema.entities:
            raise ResolverError(f"unknown entity '{entity}'")
        if entity in self.resolvers:
            raise ResolverError(f"'{entity}' has a resolver already")
        self.resolvers[entity] = (fn, nested, joined)
        return self

    def describe(self, only: set[str] | None = None) -> dict:
        """The schema as clients may know it, with the Spark types of the fields whose tables are at hand."""
        out = self.schema.describe(only)
        for about in out["entities"]:
            entity = self.schema.entities[about["name"]]
            if self.schema.table(about["name"]) in self.catalog:
                types = dict(self.catalog.table(self.schema.table(about["name"])).dtypes)
                for f in about["fields"]:
                    if f["kind"] == "scalar" and entity.column(f["name"]) in types:
                        f["sparkType"] = types[entity.column(f["name"])]
        return out

    # -- plans

    def plan(self, query: Any, form: str = "json", context: Context | None = None, id: Any = POINT, unpaged: bool = False) -> Node | None:
        """The checked plan of a query, as far as access rules allow it; None where they deny it."""
        context = context or Context()
        if not isinstance(query, Query):
            query = parse(query, form)
        is_point = id is not POINT
        node = analyze(query, self.schema, self.options, paged=not is_point and not unpaged)
        if self.access:
            node = self.access.applied(node, self.schema, context, None if not is_point else id, is_point)
        return node

    def _hooked(self, query: Any, form: str, context: Context, id: Any, unpaged: bool) -> Node | None:
        if not isinstance(query, Query):
            for plugin in self.plugins:
                query = plugin.on_request(query, context)
        node = self.plan(query, form, context, id, unpaged)
        for plugin in self.plugins if node else ():
            node = plugin.on_plan(node, context)
        return node

    def _compiled(self, node: Node, id: Any, context: Context, eager: bool = False) -> Compiled:
        is_point = id is not POINT
        found = self.resolvers.get(node.entity) or self.resolvers.get("*")
        if found:
            out = self._resolved(node, *found, id)
        else:
            out = compile_plan(node, self.schema, self.catalog, None if not is_point else id, is_point, eager)
        for plugin in reversed(self.plugins):
            out.rows = plugin.on_result(out.rows, node, context)
        return out

    def _resolved(self, node: Node, fn: Resolver, nested: bool, joined: bool, id: Any) -> Compiled:
        """A resolver's rows; controls of the root that it may have ignored are applied to records as far as they show."""
        if node.grouped:
            return Compiled(fn(node, self.catalog), [], [*node.group, *node.aggregates])
        names = [*node.fields, *[r.name for r in node.refs]]
        if nested:
            rows = fn(node, self.catalog)
        else:
            rows = nest((lambda chain: fn(chain, self.catalog)) if joined else fn(node, self.catalog), node)
        if missing := [n for n in names if n not in rows.columns]:
            raise ResolverError(f"the resolver of '{node.entity}' left out '{missing[0]}'")

        def column(name: str):
            # the root's ids, which a query need not have selected, are under this mark
            own = f"<{node.entity}_{name}" if f"<{node.entity}_{name}" in rows.columns else name
            if own not in rows.columns:
                raise ResolverError(f"the resolver of '{node.entity}' left out '{name}'")
            return F.col(f"`{own}`"), rows.schema[own].dataType

        if id is not POINT:
            return Compiled(rows.filter(identity([column(f) for f in node.config.ids], id)), [], names)
        order = node.order if all(s.field in rows.columns or f"<{node.entity}_{s.field}" in rows.columns for s in node.order) else []
        if node.guard is not None:
            rows = rows.filter(predicate(node.guard, column))
        if order and node.first is not None:
            rows = rows.orderBy(*sorted_by(order, column)).limit(node.first + 1)
        keys = [f"<{i}" for i in range(len(order))]
        return Compiled(rows.select(*[column(s.field)[0].alias(k) for s, k in zip(order, keys, strict=True)], *names), keys, names)

    # -- answers

    def dataframe(self, query: Any, form: str = "json", context: Context | None = None, id: Any = POINT, unpaged: bool = False) -> DataFrame:
        """The result as a DataFrame: a page (as the query says, or the default), a point, or with ``unpaged`` all records.
        Nothing is read yet; a page's keys go to what is attached by a semi-join."""
        context = context or Context()
        try:
            node = self._hooked(query, form, context, id, unpaged)
        except Answer as answer:
            return answer.value
        if node is None:
            return self._nothing(query, form, id)
        return self._compiled(node, id, context).shown(node.first if id is POINT else None)

    def _nothing(self, query: Any, form: str, id: Any) -> DataFrame:
        """An empty result of the shape that the query would have had."""
        node = analyze(query if isinstance(query, Query) else parse(query, form), self.schema, self.options, paged=id is POINT)
        return compile_plan(node, self.schema, _Emptied(self.catalog), None if id is POINT else id, id is not POINT).shown().limit(0)

    def execute(self, query: Any, form: str = "json", context: Context | None = None, id: Any = POINT) -> Any:
        """The result as Python values: a record or None for a point; else its items and the page's place."""
        return self.execute_detailed(query, form, context, id).data

    def execute_detailed(self, query: Any, form: str = "json", context: Context | None = None, id: Any = POINT) -> Result:
        context, begun = context or Context(), time.perf_counter()
        try:
            try:
                node = self._hooked(query, form, context, id, False)
                compiled = self._compiled(node, id, context, eager=True) if node else None
                data = _shaped(node, compiled, id)
            except Answer as answer:
                node, compiled, data = None, None, answer.value
            for plugin in reversed(self.plugins):
                data = plugin.on_response(data, context)
        except Exception as error:
            for plugin in self.plugins:
                plugin.on_error(error, context)
            raise
        meta = {"durationMs": (time.perf_counter() - begun) * 1000, "version": 2}
        if node is not None:
            meta |= {"plan": summary(node), "explain": explained(compiled.rows)}
        return Result(data, meta)

    def flat(self, query: Any, form: str = "json", context: Context | None = None) -> DataFrame:
        """The query's rows before nesting: one column for each field, the product of its to-many relations."""
        context = context or Context()
        try:
            node = self._hooked(query, form, context, POINT, True)
        except Answer as answer:
            return answer.value
        if node is None:
            return self._nothing(query, form, POINT)
        rows = flat(node, self.schema, self.catalog)
        for plugin in reversed(self.plugins):
            rows = plugin.on_result(rows, node, context)
        return rows

    def records(self, query: Any, ids: list, form: str = "json", context: Context | None = None) -> dict[str, Any]:
        """The records of many ids (of an entity with one id field) in one read, by the id as text; those that are not
        there, or that point rules deny, are left out."""
        context = context or Context()
        node = self._hooked(query, form, context, POINT, True)
        if node is None:
            return {}
        if len(node.config.ids) != 1:
            raise ValidationError(f"'{node.entity}' has no single id")
        (name,) = node.config.ids
        allowed = [i for i in ids if not self.access or self.access.point_ok(node.entity, i, context)]
        if not allowed:
            return {}
        node.guard = both(node.guard, Logic("or", tuple(Test(name, "eq", i) for i in allowed)) if len(allowed) > 1 else Test(name, "eq", allowed[0]))
        compiled = self._compiled(node, POINT, context)
        key = compiled.keys[[s.field for s in node.order].index(name)]
        out = {}
        for row in compiled.rows.collect():
            value = {n: _plain(row[n]) for n in compiled.names}
            for plugin in reversed(self.plugins):
                value = plugin.on_response(value, context)
            out[str(row[key])] = value
        return out


class _Emptied(Catalog):
    def __init__(self, other: Catalog):
        super().__init__()
        self.other = other

    def table(self, name: str) -> DataFrame:
        return self.other.table(name).limit(0)


def explained(df: DataFrame) -> str:
    """The physical plan as text."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def _plain(value: Any) -> Any:
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in zip(value.__fields__, value, strict=True)}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def _shaped(node: Node | None, compiled: Compiled | None, id: Any) -> Any:
    empty = {"items": [], "pageInfo": {"hasNextPage": False, "startCursor": None, "endCursor": None}}
    if node is None:
        return None if id is not POINT else empty
    if id is not POINT:
        rows = compiled.shown(1).collect()
        return _plain(rows[0]) if rows else None
    rows = compiled.rows.limit(node.first + 1).collect()
    shown = rows[: node.first]
    if not shown:
        return empty
    place = lambda row: cursor.encode(node, [row[k] for k in compiled.keys]) if compiled.keys else None
    items = [{n: _plain(row[n]) for n in compiled.names} for row in shown]
    return {"items": items, "pageInfo": {"hasNextPage": len(rows) > node.first, "startCursor": place(shown[0]), "endCursor": place(shown[-1])}}
