"""Who may read what: rules over entities, rows and fields, applied to plans before they run."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

from treeline.errors import ValidationError
from treeline.plans import wire
from treeline.plans.analyze import Node, both, tests
from treeline.schema import Schema


@dataclass(frozen=True)
class Context:
    """Who asks.  ``more`` holds whatever else rules want to know."""

    user: str | None = None
    role: str | None = None
    tenant: str | None = None
    more: Mapping[str, Any] = field(default_factory=dict)

    def principal(self) -> str:
        return ":".join(str(x or "") for x in (self.user, self.role, self.tenant))

    def key(self) -> list:
        """All that rules may look at, as JSON can hold it; unlike contexts give unlike keys."""
        return [self.user, self.role, self.tenant, sorted([str(k), repr(v)] for k, v in self.more.items())]


Rule = Callable[[Context], bool]


def roles(*allowed: str) -> Rule:
    return lambda context: context.role in allowed


def signed_in(context: Context) -> bool:
    return context.user is not None


@dataclass
class AccessPolicy:
    """Rules by name; what no rule names is allowed.

    ``entities``: entity -> rule; a denied root gives an empty result, a denied relation vanishes.
    ``fields``: "entity.field" -> rule; a denied field vanishes, wherever the entity is reached, and cannot be filtered,
    sorted, grouped or aggregated by.  A computed field vanishes with any of its sources, in this entity or a related one,
    and reads only related rows that pass that entity's row filter.
    ``allowed``: (context, entity) -> the only fields allowed, or None for all.
    ``points``: entity -> rule over (context, id) for point reads.
    ``rows``: entity -> context -> a filter in wire form (or None) that the entity's rows must pass, wherever reached.
    """

    entities: Mapping[str, Rule] = field(default_factory=dict)
    fields: Mapping[str, Rule] = field(default_factory=dict)
    allowed: Callable[[Context, str], set[str] | None] | None = None
    points: Mapping[str, Callable[[Context, Any], bool]] = field(default_factory=dict)
    rows: Mapping[str, Callable[[Context], dict | None]] = field(default_factory=dict)

    def entity_ok(self, entity: str, context: Context) -> bool:
        rule = self.entities.get(entity)
        return rule is None or bool(rule(context))

    def field_ok(self, entity: str, name: str, context: Context) -> bool:
        rule = self.fields.get(f"{entity}.{name}")
        if rule is not None and not rule(context):
            return False
        only = self.allowed(context, entity) if self.allowed else None
        return only is None or name in only

    def point_ok(self, entity: str, point: Any, context: Context) -> bool:
        rule = self.points.get(entity)
        return rule is None or bool(rule(context, point))

    def row_filter(self, entity: str, context: Context) -> Any:
        rule = self.rows.get(entity)
        raw = rule(context) if rule else None
        return None if raw is None else wire._filter(raw, "row rule", aggregates=False)

    def applied(self, plan: Node, schema: Schema, context: Context, point: Any = None, is_point: bool = False) -> Node | None:
        """The plan as far as the rules allow it; None where they deny its root."""
        if not self.entity_ok(plan.entity, context):
            return None
        if is_point and not self.point_ok(plan.entity, point, context):
            return None
        return self._node(plan, schema, context)

    def _computed_ok(self, node: Node, name: str, schema: Schema, context: Context) -> bool:
        """Whether all sources of a computed field may be read; notes the row filters of the relations it reads."""
        for source in node.config.computed[name].sources:
            ref, _, f = source.rpartition(".")
            if not ref:
                if not self.field_ok(node.entity, source, context):
                    return False
                continue
            _, join = schema.join(node.name if node.path else node.entity, node.entity, ref)
            if not self.entity_ok(join.entity, context) or not self.field_ok(join.entity, f, context):
                return False
            if (guard := self.row_filter(join.entity, context)) is not None:
                node.hidden_guards[ref] = guard
        return True

    def _node(self, node: Node, schema: Schema, context: Context) -> Node:
        used = [t.field for t in tests(node.where)] + [*node.distinct, *node.group]
        used += [a.field for a in node.aggregates.values() if a.field]
        used += [s.field for s in node.order if s.field not in node.config.ids and not s.aggregate and s.field not in node.aggregates]
        for name in used:
            if not self.field_ok(node.entity, name, context):
                raise ValidationError(f"'{name}' of '{node.entity}' cannot be used here")
        node.fields = [f for f in node.fields if self.field_ok(node.entity, f, context)]
        node.fields = [f for f in node.fields if f not in node.config.computed or self._computed_ok(node, f, schema, context)]
        node.refs = [self._node(r, schema, context) for r in node.refs if self.entity_ok(r.entity, context)]
        node.guard = both(node.guard, self.row_filter(node.entity, context))
        return node


class Store(Protocol):
    """Where answers are kept: texts under texts, for some time."""

    def get(self, key: str) -> Any: ...

    def put(self, key: str, value: Any) -> None: ...

    def drop(self, test: Callable[[str], bool]) -> int: ...


class TimedStore:
    """Values that expire, in this process; the clock can be replaced."""

    def __init__(self, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, key: str) -> Any:
        until, value = self.held.get(key, (0, None))
        if self.clock() >= until:
            self.held.pop(key, None)
            return None
        return value

    def put(self, key: str, value: Any) -> None:
        self.held[key] = (self.clock() + self.seconds, value)

    def drop(self, test: Callable[[str], bool]) -> int:
        gone = [k for k in self.held if test(k)]
        for k in gone:
            del self.held[k]
        return len(gone)


class FolderStore:
    """Values that expire, as files of a folder that several processes share; each is written whole."""

    def __init__(self, folder: str, seconds: float = 60.0, clock: Callable[[], float] = time.time):
        self.folder, self.seconds, self.clock = folder, seconds, clock
        os.makedirs(folder, exist_ok=True)

    def _path(self, key: str) -> str:
        return os.path.join(self.folder, f"{hashlib.sha256(key.encode()).hexdigest()}.json")

    def _read(self, path: str) -> tuple[str, float, Any] | None:
        try:
            with open(path, encoding="utf-8") as f:
                return tuple(json.load(f))
        except (OSError, ValueError):
            return None

    def get(self, key: str) -> Any:
        got = self._read(self._path(key))
        return got[2] if got and got[0] == key and self.clock() < got[1] else None

    def put(self, key: str, value: Any) -> None:
        path = self._path(key)
        with open(own := f"{path}.{os.getpid()}", "w", encoding="utf-8") as f:
            json.dump([key, self.clock() + self.seconds, value], f)
        os.replace(own, path)

    def drop(self, test: Callable[[str], bool]) -> int:
        count = 0
        for name in os.listdir(self.folder):
            path = os.path.join(self.folder, name)
            if name.endswith(".json") and (got := self._read(path)) and test(got[0]):
                os.unlink(path)
                count += 1
        return count


class CachedAccessPolicy(AccessPolicy):
    """A policy whose rules' answers are kept for a while, by all that a context holds."""

    def __init__(self, policy: AccessPolicy, store: Store | None = None):
        super().__init__(policy.entities, policy.fields, policy.allowed, policy.points, policy.rows)
        self.policy, self.store = policy, store or TimedStore()

    def _kept(self, context: Context, what: list[str], answer: Callable[[], bool]) -> bool:
        key = json.dumps([context.key(), what])
        if (value := self.store.get(key)) is None:
            value = bool(answer())
            self.store.put(key, value)
        return value

    def entity_ok(self, entity: str, context: Context) -> bool:
        return self._kept(context, ["entity", entity], lambda: self.policy.entity_ok(entity, context))

    def field_ok(self, entity: str, name: str, context: Context) -> bool:
        return self._kept(context, ["field", entity, name], lambda: self.policy.field_ok(entity, name, context))

    def point_ok(self, entity: str, point: Any, context: Context) -> bool:
        return self._kept(context, ["point", entity, repr(point)], lambda: self.policy.point_ok(entity, point, context))

    def invalidate(self, user: str | None = None, role: str | None = None, tenant: str | None = None, entity: str | None = None) -> int:
        """Forgets the answers of all principals with these parts (of all, without any); returns how many."""

        def gone(key: str) -> bool:
            parts, what = json.loads(key)
            return entity in (None, what[1]) and all(w in (None, p) for p, w in zip(parts, (user, role, tenant), strict=False))

        return self.store.drop(gone)
