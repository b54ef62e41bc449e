"""Schemas from other definitions: Prisma models, Drizzle tables, GraphQL types, table descriptions, DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from treeline.errors import SchemaError
from treeline.schema import Entity, Join, Schema, Through, default_table

SDL_SCALARS = {"ID", "String", "Int", "Float", "Boolean"}


def entity_key(name: str) -> str:
    """``BlogPost`` -> ``blogPost``."""
    return name[:1].lower() + name[1:]


@dataclass
class _Field:
    name: str
    type: str
    many: bool
    attributes: dict[str, str] = field(default_factory=dict)

    def names(self, part: str) -> list[str]:
        """The names in ``part: [a, b]`` of the relation attribute."""
        m = re.search(rf"{part}\s*:\s*\[([^\]]*)\]", self.attributes.get("relation", ""))
        return [x.strip() for x in m[1].split(",") if x.strip()] if m else []


def _attributes(text: str, mark: str) -> dict[str, str]:
    return {m[1]: m[2] or "" for m in re.finditer(rf"(?<!@){mark}([A-Za-z_.]+)(?:\(((?:[^()]|\([^()]*\))*)\))?", text)}


def _quoted(text: str) -> str | None:
    m = re.search(r'"([^"]*)"', text)
    return m[1] if m else None


def from_prisma(source: str, key: Callable[[str], str] = entity_key) -> Schema:
    """A schema from Prisma models: renames, ids (also of several fields), relations on either side, implicit junctions."""
    source = re.sub(r"//[^\n]*", "", source)
    models: dict[str, tuple[list[_Field], dict[str, str]]] = {}
    for name, body in re.findall(r"\bmodel\s+(\w+)\s*\{(.*?)\n?\}", source, re.DOTALL):
        fields, about = [], {}
        for line in map(str.strip, body.split("\n")):
            if line.startswith("@@"):
                about |= _attributes(line, "@@")
            elif m := re.match(r"(\w+)\s+(\w+)(\[\])?\??(.*)", line):
                fields.append(_Field(m[1], m[2], bool(m[3]), _attributes(m[4], "@")))
        models[name] = (fields, about)
    if not models:
        raise SchemaError("the source defines no model")
    entities: dict[str, Entity] = {}
    for name, (fields, about) in models.items():
        scalars = [f for f in fields if f.type not in models]
        columns = {f.name: c for f in scalars if (c := _quoted(f.attributes.get("map", ""))) and c != f.name}
        ids = [f.name for f in scalars if "id" in f.attributes]
        if not ids and "id" in about:
            ids = [x.strip() for x in re.sub(r"[\[\]]|fields\s*:", "", about["id"].split("]")[0]).split(",") if x.strip()]
        one = ids[0] if len(ids) == 1 else tuple(ids) if ids else "id"
        entities[key(name)] = Entity(tuple(f.name for f in scalars), one, _quoted(about.get("map", "")), columns)
    table = {n: entities[key(n)].table or default_table(key(n)) for n in models}
    joins: dict[str, Join] = {}
    for name, (fields, _) in models.items():
        mine = entities[key(name)]
        for f in (f for f in fields if f.type in models):
            theirs = entities[key(f.type)]
            through, pairs = None, []
            if own := f.names("fields"):
                pairs = [(mine.column(a), theirs.column(b)) for a, b in zip(own, f.names("references"), strict=True)]
            else:
                label = _quoted(f.attributes.get("relation", ""))
                facing = [g for g in models[f.type][0] if g.type == name and g is not f and _quoted(g.attributes.get("relation", "")) == label]
                if back := next((g for g in facing if g.names("fields")), None):
                    pairs = [(mine.column(b), theirs.column(a)) for a, b in zip(back.names("fields"), back.names("references"), strict=True)]
                elif f.many and any(g.many for g in facing):
                    low, high = sorted((name, f.type))
                    through = Through(f"_{low}To{high}", *("AB" if name == low else "BA"))
                else:
                    raise SchemaError(f"the relation '{name}.{f.name}' has no other side")
            on = " AND ".join(f"parent.{a} = child.{b}" for a, b in pairs)
            joins[f"{key(name)}.{f.name}"] = Join(key(f.type), on, f.many, table[f.type], through)
    return Schema(entities, joins)


@dataclass
class Report:
    """What a conversion did, and what it left to do."""

    converted: list[str] = field(default_factory=list)
    manual: list[str] = field(default_factory=list)


def from_sdl(source: str, key: Callable[[str], str] = entity_key) -> tuple[Schema, Report]:
    """A schema from GraphQL types.  Types hold no keys, so joins are guessed from names, and reported."""
    source = re.sub(r'"""(.*?)"""|#[^\n]*', "", source, flags=re.DOTALL)
    types = {}
    for name, body in re.findall(r"\btype\s+(\w+)[^{]*\{(.*?)\}", source, re.DOTALL):
        if name not in ("Query", "Mutation", "Subscription"):
            types[name] = re.findall(r"(\w+)\s*(?:\([^)]*\))?\s*:\s*(\[?)\s*(\w+)", body)
    report, entities, joins = Report(), {}, {}
    for name, fields in types.items():
        scalars = tuple(f for f, _, kind in fields if kind in SDL_SCALARS or kind not in types)
        entities[key(name)] = Entity(scalars, "id" if "id" in scalars or not scalars else scalars[0])
        report.converted.append(f"type {name} -> entity {key(name)}")
    for name, fields in types.items():
        for f, many, kind in fields:
            if kind in SDL_SCALARS:
                continue
            if kind not in types:
                report.manual.append(f"{name}.{f}: '{kind}' was taken for a scalar")
                continue
            mine, theirs = entities[key(name)], entities[key(kind)]
            if many:
                on = f"child.{key(name)}Id = parent.{mine.ids[0]}"
            else:
                on = f"parent.{f}Id = child.{theirs.ids[0]}"
            joins[f"{key(name)}.{f}"] = Join(key(kind), on, bool(many))
            report.manual.append(f"{name}.{f}: check the guessed condition '{on}'")
    return Schema(entities, joins), report


def from_tables(tables: Mapping[str, Mapping], key: Callable[[str], str] | None = None) -> Schema:
    """A schema from table descriptions: {table: {"columns": {field: column}, "id": field, "relations": {name:
    {"table", "fields", "references", "many"}}}}, as object-relational mappers declare them."""
    key = key or (lambda t: entity_key(t[:-1] if t.endswith("s") else t))
    entities, joins = {}, {}
    for table, about in tables.items():
        columns = about["columns"] if isinstance(about["columns"], Mapping) else {c: c for c in about["columns"]}
        renamed = {f: c for f, c in columns.items() if f != c}
        entities[key(table)] = Entity(tuple(columns), about.get("id", "id"), table, renamed)
    for table, about in tables.items():
        mine = entities[key(table)]
        for name, r in about.get("relations", {}).items():
            theirs = entities[key(r["table"])]
            on = " AND ".join(f"parent.{mine.column(a)} = child.{theirs.column(b)}" for a, b in zip(r["fields"], r["references"], strict=True))
            joins[f"{key(table)}.{name}"] = Join(key(r["table"]), on, bool(r.get("many")))
    return Schema(entities, joins).checked()


def _enclosed(text: str, at: int) -> str:
    """What stands between the bracket at ``at`` and the one that closes it."""
    depth, quote = 0, ""
    for n in range(at, len(text)):
        c = text[n]
        if quote:
            quote = "" if c == quote and text[n - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return text[at + 1 : n]
    raise SchemaError("a bracket is never closed")


def _entries(text: str) -> dict[str, str]:
    """The ``name: value`` entries of an object's body."""
    out, depth, quote, begun = [], 0, "", 0
    for n, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[n - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        else:
            depth += (c in "([{") - (c in ")]}")
            if c == "," and not depth:
                out.append(text[begun:n])
                begun = n + 1
    out.append(text[begun:])
    return {m[1]: m[2] for part in out if (m := re.match(r"\s*[\"']?(\w+)[\"']?\s*:\s*(.*)", part, re.DOTALL))}


def from_drizzle(source: str, key: Callable[[str], str] | None = None) -> Schema:
    """A schema from a Drizzle module: tables with their renamed columns and primary keys, and ``relations`` of either
    side.  ``key``: the entity of an exported table, by default its name without a final s."""
    key = key or (lambda t: t[:-1] if t.endswith("s") else t)
    source = re.sub(r"//[^\n]*|/\*.*?\*/", "", source, flags=re.DOTALL)
    names, tables = {}, {}
    for m in re.finditer(r"(\w+)\s*=\s*\w*[tT]able\(\s*[\"'`](\w+)[\"'`]\s*,\s*", source):
        body = _entries(_enclosed(source, m.end()))
        columns = {f: (re.match(r"\w+\(\s*[\"'`]([^\"'`]+)", x) or [None, f])[1] for f, x in body.items()}
        ids = [f for f, x in body.items() if ".primaryKey(" in x]
        rest = _enclosed(source, source.index("(", m.start()))
        if several := re.search(r"primaryKey\(\s*\{\s*columns\s*:\s*\[([^\]]*)\]", rest):
            ids = re.findall(r"\.(\w+)", several[1])
        names[m[1]] = m[2]
        tables[m[2]] = {"columns": columns, "id": ids[0] if len(ids) == 1 else tuple(ids) or "id", "relations": {}}
    if not tables:
        raise SchemaError("the source defines no table")
    told: dict[str, dict[str, dict]] = {}
    for m in re.finditer(r"\brelations\(\s*(\w+)\s*,[^=]*=>\s*\(\s*", source):
        for name, x in _entries(_enclosed(source, m.end())).items():
            kind = re.match(r"(one|many)\(\s*(\w+)", x)
            if kind and kind[2] in names:
                part = lambda what, x=x: re.findall(r"\.(\w+)", (re.search(rf"{what}\s*:\s*\[([^\]]*)\]", x) or ["", ""])[1])
                label = re.search(r"relationName\s*:\s*[\"'`](\w+)", x)
                told.setdefault(m[1], {})[name] = {"table": kind[2], "many": kind[1] == "many", "fields": part("fields"), "references": part("references"), "label": label and label[1]}
    for table, relations in told.items():
        for name, r in relations.items():
            fields, references = r["fields"], r["references"]
            if not fields:
                facing = [f for f in told.get(r["table"], {}).values() if f["table"] == table and f["fields"] and f["label"] == r["label"]]
                if not facing:
                    raise SchemaError(f"the relation '{table}.{name}' has no other side")
                fields, references = facing[0]["references"], facing[0]["fields"]
            tables[names[table]]["relations"][name] = {"table": names[r["table"]], "fields": fields, "references": references, "many": r["many"]}
    exported = {v: k for k, v in names.items()}
    return from_tables(tables, lambda t: key(exported[t]))


def from_dataframes(frames: Mapping[str, DataFrame], ids: Mapping[str, str | tuple[str, ...] | None] | None = None, joins: Mapping[str, Join] | None = None) -> Schema:
    """A schema with every column of every frame; the entity is named as the frame, its id is its first column or as told."""
    out = {}
    for name, df in frames.items():
        out[name] = Entity(tuple(df.columns), (ids or {}).get(name, df.columns[0]), name)
    return Schema(out, dict(joins or {})).checked()
