"""Writes as new tables: what a table is after records were created, updated and deleted.

A write is {"$write": {"op", "entity", "id", "data"}}.  Tables are immutable here, so a batch of writes is a DataFrame
expression over the old table; saving it is up to the caller.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.errors import ParseError, ValidationError
from treeline.operators.predicates import identity, literal
from treeline.schema import Schema

OPS = ("create", "update", "delete")
MOST = 200


def parsed(raw: Mapping, schema: Schema) -> tuple[str, str, Any, dict]:
    """Op, entity, id and physical data of a write; only physical fields can be written, ids only when they are made."""
    about = raw.get("$write") if isinstance(raw, Mapping) else None
    if not isinstance(about, Mapping) or about.get("op") not in OPS:
        raise ParseError("a write has no known op")
    entity = schema.resolve(str(about.get("entity")))
    if entity is None:
        raise ValidationError(f"unknown entity '{about.get('entity')}'")
    config, data = schema.entities[entity], about.get("data") or {}
    if about["op"] != "create" and about.get("id") is None:
        raise ValidationError(f"'{about['op']}' needs an id")
    if about["op"] != "delete" and not data:
        raise ValidationError(f"'{about['op']}' needs data")
    for name in data:
        if name in config.computed or (name not in config.fields and name not in config.ids):
            raise ValidationError(f"'{name}' of '{entity}' cannot be written")
        if about["op"] == "update" and name in config.ids:
            raise ValidationError(f"the id '{name}' of '{entity}' cannot be changed")
    return about["op"], entity, about.get("id"), {config.column(k): v for k, v in data.items()}


def written(table: DataFrame, schema: Schema, entity: str, writes: list[Mapping]) -> DataFrame:
    """The table after the writes, in order."""
    if len(writes) > MOST:
        raise ValidationError(f"more than {MOST} writes at once")
    config = schema.entities[entity]
    kinds = {f.name: f.dataType for f in table.schema.fields}
    for raw in writes:
        op, of, id, data = parsed(raw, schema)
        if of != entity:
            raise ValidationError(f"a write is of '{of}', not of '{entity}'")
        if missing := [c for c in data if c not in kinds]:
            raise ValidationError(f"the table of '{entity}' has no column '{missing[0]}'")
        if op == "create":
            values = [(literal(data[c], k) if c in data else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
            table = table.unionByName(table.sparkSession.range(1).select(*values))
            continue
        hit = identity([(F.col(f"`{config.column(f)}`"), kinds[config.column(f)]) for f in config.ids], id)
        hit = F.coalesce(hit, F.lit(False))
        if op == "delete":
            table = table.filter(~hit)
        else:
            table = table.select(*[F.when(hit, literal(data[c], k).cast(k)).otherwise(F.col(f"`{c}`")).alias(c) if c in data else F.col(f"`{c}`") for c, k in kinds.items()])
    return table
