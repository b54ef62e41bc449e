"""Entities, their fields, and the directed joins between them."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from treeline.errors import SchemaError

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
#: Irregular plurals, and singulars that end in s.
IRREGULAR = {
    "person": "people", "child": "children", "man": "men", "woman": "women",
    "tooth": "teeth", "foot": "feet", "mouse": "mice", "goose": "geese",
}
SINGULAR_S = {"address", "alias", "bus", "canvas", "class", "gas", "lens", "status", "virus"}


@dataclass(frozen=True)
class Computed:
    """A virtual scalar: ``compute`` gets a dict from each of ``sources`` to a Column and returns a Column.

    A source is a physical field of the same entity, or ``relation.field`` one hop away over a to-one join.
    """

    sources: tuple[str, ...]
    compute: Callable[[dict], Any]
    type: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "sources", tuple(self.sources))


@dataclass(frozen=True)
class Through:
    """A junction table: ``source`` refers to the parent's id, ``target`` to the child's."""

    table: str
    source: str
    target: str


@dataclass(frozen=True)
class Join:
    """``on`` holds equalities joined by AND; columns are physical, qualified by table, entity, ``parent`` or ``child``."""

    entity: str
    on: str = ""
    many: bool = False
    table: str | None = None
    through: Through | None = None


@dataclass(frozen=True)
class Entity:
    """``fields`` may be selected; ``columns`` renames logical to physical; ``id`` is a field, some fields, or None."""

    fields: tuple[str, ...]
    id: str | tuple[str, ...] | None = "id"
    table: str | None = None
    columns: Mapping[str, str] = field(default_factory=dict)
    computed: Mapping[str, Computed] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(self.fields))
        if isinstance(self.id, list):
            object.__setattr__(self, "id", tuple(self.id))

    @property
    def ids(self) -> tuple[str, ...]:
        return () if self.id is None else (self.id,) if isinstance(self.id, str) else self.id

    def column(self, name: str) -> str:
        return self.columns.get(name, name)


def default_table(entity: str) -> str:
    return entity if entity.endswith("s") else f"{entity}s"


@dataclass(frozen=True)
class Schema:
    entities: Mapping[str, Entity]
    joins: Mapping[str, Join] = field(default_factory=dict)

    def table(self, entity: str) -> str:
        return self.entities[entity].table or default_table(entity)

    def resolve(self, name: str) -> str | None:
        """The entity that a name means: its key, its table, or its key with an s more."""
        if name in self.entities:
            return name
        for key in self.entities:
            if self.table(key) == name:
                return key
        return name[:-1] if name.endswith("s") and name[:-1] in self.entities else None

    def join(self, parent_name: str, parent_entity: str, ref: str) -> tuple[str, Join] | None:
        """The join of ``ref`` below a node: keyed by the node's own name, or else by its entity."""
        for key in (f"{parent_name}.{ref}", f"{parent_entity}.{ref}"):
            if key in self.joins:
                return key, self.joins[key]
        return None

    def joins_of(self, entity: str) -> dict[str, Join]:
        return {k.partition(".")[2]: j for k, j in self.joins.items() if k.partition(".")[0] == entity}

    def checked(self) -> Schema:
        """This schema, or SchemaError: joins lead to known entities, computed fields have known physical sources."""
        for key, join in self.joins.items():
            if "." not in key:
                raise SchemaError(f"join '{key}' is not named parent.relation")
            if join.entity not in self.entities:
                raise SchemaError(f"join '{key}' leads to the unknown entity '{join.entity}'")
            if not join.on and not join.through:
                raise SchemaError(f"join '{key}' has neither a condition nor a junction")
        for name, entity in self.entities.items():
            for what in (*entity.fields, *entity.computed):
                if not _NAME.match(what):
                    raise SchemaError(f"'{what}' of '{name}' is no name")
            for what, computed in entity.computed.items():
                self._check_computed(name, entity, what, computed)
        return self

    def _check_computed(self, name: str, entity: Entity, what: str, computed: Computed) -> None:
        where = f"computed field '{name}.{what}'"
        if what in entity.fields:
            raise SchemaError(f"{where} has the name of a physical field")
        if not computed.sources:
            raise SchemaError(f"{where} has no sources")
        if not callable(computed.compute):
            raise SchemaError(f"{where} cannot be computed")
        if computed.type not in (None, "string", "number", "boolean"):
            raise SchemaError(f"{where} has the unknown type '{computed.type}'")
        for source in computed.sources:
            hops = source.split(".")
            if len(hops) > 2:
                raise SchemaError(f"{where}: '{source}' is more than one relation away")
            owner = entity
            if len(hops) == 2:
                join = self.join(name, name, hops[0])
                if join is None:
                    raise SchemaError(f"{where}: unknown relation '{hops[0]}'")
                if join[1].many:
                    raise SchemaError(f"{where}: '{hops[0]}' has many records")
                owner = self.entities[join[1].entity]
            if hops[-1] in owner.computed:
                raise SchemaError(f"{where}: '{source}' is itself computed")
            if hops[-1] not in owner.fields and hops[-1] not in owner.ids:
                raise SchemaError(f"{where}: unknown field '{source}'")

    def warnings(self) -> list[str]:
        """Entities whose table name was guessed and is likely another."""
        out = []
        for key, entity in self.entities.items():
            if entity.table:
                continue
            better = IRREGULAR.get(key)
            if not better and re.search(r"[^aeiou]y$", key, re.I):
                better = key[:-1] + "ies"
            if not better and (re.search(r"(sh|ch|x|z)$", key, re.I) or key in SINGULAR_S):
                better = key + "es"
            if better and better != default_table(key):
                out.append(f"entity '{key}' is read from table '{default_table(key)}'; if it is '{better}', name it")
        return out

    def extend(self, entities: Mapping[str, Entity | Mapping] | None = None, joins: Mapping[str, Join | None] | None = None) -> Schema:
        """A new schema: parts of entities are replaced as wholes; a join of None is removed; this one stays as it is."""
        merged = dict(self.entities)
        for key, patch in (entities or {}).items():
            if isinstance(patch, Entity):
                merged[key] = patch
            elif key in merged:
                merged[key] = replace(merged[key], **patch)
            elif "fields" in patch:
                merged[key] = Entity(**patch)
            else:
                raise SchemaError(f"the new entity '{key}' has no fields")
        edges = dict(self.joins)
        for key, join in (joins or {}).items():
            if join is None:
                edges.pop(key, None)
            else:
                edges[key] = join
        return Schema(merged, edges)

    def describe(self, only: set[str] | None = None) -> dict:
        """What a client may ask for."""
        from treeline.plans.wire import AGGREGATES, CONTROLS, DEFAULT_FIRST, MAX_FIRST, OPERATORS

        entities = []
        for name in sorted(self.entities):
            if only is not None and name not in only:
                continue
            entity = self.entities[name]
            fields = [{"name": f, "kind": "scalar"} for f in entity.fields]
            fields += [{"name": f, "kind": "computed"} | ({"type": c.type} if c.type else {}) for f, c in entity.computed.items()]
            joins = [{"name": r, "entity": j.entity, "type": "many" if j.many else "one"} for r, j in sorted(self.joins_of(name).items())]
            entities.append({"name": name, "fields": fields, "joins": joins, "listCapable": True})
        return {
            "query": {
                "formats": ["json", "ql"], "controls": list(CONTROLS), "filterOperators": list(OPERATORS), "aggregateFunctions": list(AGGREGATES),
                "pagination": {"style": "keyset", "defaultFirst": DEFAULT_FIRST, "maxFirst": MAX_FIRST},
            },
            "entities": entities,
        }
