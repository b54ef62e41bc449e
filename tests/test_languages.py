"""Both query languages, and the checks of analysis."""

import json

import pytest

from treeline.errors import ParseError, SchemaError, ValidationError
from treeline.plans import wire
from treeline.plans.analyze import Options, analyze, scope, summary
from treeline.plans.wire import Logic, Sort, parse, parse_braces, parse_json, to_braces, to_json
from treeline.schema import Computed, Entity, Join, Schema, default_table

SCHEMA = Schema(
    {
        "user": Entity(("id", "name", "first", "last"), computed={"full": Computed(("first", "last"), lambda h: h["first"])}),
        "post": Entity(("id", "title")),
        "comment": Entity(("id", "body")),
    },
    {
        "user.posts": Join("post", "posts.author_id = users.id", True),
        "post.author": Join("user", "users.id = posts.author_id"),
        "post.comments": Join("comment", "comments.post_id = posts.id", True),
        "comments.author": Join("user", "users.id = comments.author_id"),
    },
)


def q(**controls):
    return {"user": {"$select": {"id": True}} | {f"${k}": v for k, v in controls.items()}}


def test_json_controls():
    got = parse_json(json.dumps(q(
        where={"and": [{"field": "id", "op": "gt", "value": 1}, {"not": {"field": "name", "op": "isNull"}}]},
        orderBy=[{"field": "name", "direction": "desc", "nulls": "first"}], page={"first": 3, "after": "x"}, distinct=["name"],
    )))
    assert got.where == Logic("and", (wire.Test("id", "gt", 1), Logic("not", (wire.Test("name", "isNull"),))))
    assert got.order == [Sort("name", True, True)] and got.page == wire.Page(3, "x") and got.distinct == ["name"]
    assert parse_json(to_json(got)) == got


def test_root_dollar_keys_are_ignored():
    assert parse_json(q() | {"$version": 2}).name == "user"


@pytest.mark.parametrize(
    "raw",
    [
        "{", "[]", {}, {"a": {"$select": {"id": True}}, "b": {"$select": {"id": True}}}, {"user": {"id": True}}, {"user": {"$select": {}}},
        {"user": {"$select": {"id": False}}}, {"user": {"$select": {"id": 1}}}, {"user": {"$select": {"$x": True}}}, q(limit=3), q(where=[]),
        q(where={"and": []}), q(where={"and": [{}]}), q(where={"field": "id", "op": "is", "value": 1}), q(where={"field": "id", "op": "eq"}),
        q(where={"field": "id", "op": "in", "value": 3}), q(where={"field": "id", "op": "eq", "value": {}}), q(where={"op": "eq", "value": 1}),
        q(orderBy=[]), q(orderBy=[{"field": "id", "direction": "up"}]), q(orderBy=[{"field": "id", "direction": "asc", "nulls": "mid"}]),
        q(page={"first": 0}), q(page={"first": True}), q(page={"first": 1.5}), q(page={"after": ""}), q(page={"offset": 3}), q(distinct=[]), q(groupBy=[1]),
        q(aggregate={}), q(aggregate={"n": {"fn": "median"}}), q(aggregate={"n": {"fn": "sum"}}), q(aggregate={"n": {"fn": "count", "distinct": True}}),
    ],
)
def test_json_rejects(raw):
    with pytest.raises(ParseError):
        parse_json(raw)


def test_braces():
    got = parse_braces("{ post { title comments { body author { name } } } }")
    assert got == parse_json({"post": {"$select": {"title": True, "comments": {"$select": {"body": True, "author": {"$select": {"name": True}}}}}}})
    assert parse_braces(to_braces(got)) == got
    with pytest.raises(ParseError):
        to_braces(parse_json(q(page={"first": 1})))


@pytest.mark.parametrize("raw", ["", "user { id }", "{ }", "{ user }", "{ user { } }", "{ user { id }", "{ user { id } } x", "{ user { id } post { id } }", "{ user { 1d } }", "{ { id } }", "{ user { id } }}"])
def test_braces_reject(raw):
    with pytest.raises(ParseError):
        parse_braces(raw)


def test_unknown_format():
    with pytest.raises(ParseError):
        parse("{}", "xml")


def plan(raw, **how):
    return analyze(parse_json(raw), SCHEMA, **how)


def test_tiebreakers_and_pages():
    assert plan(q()).order == [Sort("id")] and plan(q()).first == 50
    assert plan(q(orderBy=[{"field": "name", "direction": "desc"}])).order == [Sort("name", True), Sort("id")]
    assert plan(q(orderBy=[{"field": "id", "direction": "desc"}])).order == [Sort("id", True)]
    got = plan({"user": {"$select": {"name": True}, "$groupBy": ["name", "last"], "$aggregate": {"n": {"fn": "count"}}, "$orderBy": [{"aggregate": "n", "direction": "desc"}]}})
    assert got.order == [Sort("n", True, aggregate=True), Sort("name"), Sort("last")] and got.grouped
    nested = {"user": {"$select": {"id": True, "posts": {"$select": {"id": True}}}}}
    assert plan(nested).refs[0].first is None and plan(nested, options=Options(nested_first=5)).refs[0].first == 5


def test_names_of_entities_and_joins():
    assert SCHEMA.resolve("users") == "user" and SCHEMA.resolve("user") == "user" and SCHEMA.resolve("nobody") is None
    assert default_table("news") == "news" and default_table("post") == "posts"
    node = plan({"posts": {"$select": {"comments": {"$select": {"author": {"$select": {"name": True}}}}}}})
    assert node.entity == "post" and node.at("comments.author").entity == "user" and node.at("comments.x") is None and node.at("") is node
    assert summary(node)["joins"][1]["path"] == "comments.author"


def deep(n):
    x = {"field": "id", "op": "eq", "value": 1}
    for _ in range(n):
        x = {"not": x}
    return x


@pytest.mark.parametrize(
    "raw",
    [
        {"nobody": {"$select": {"id": True}}}, {"user": {"$select": {"password": True}}}, {"user": {"$select": {"friends": {"$select": {"id": True}}}}},
        q(where={"field": "full", "op": "eq", "value": "x"}), q(where={"field": "zip", "op": "eq", "value": "x"}), q(where=deep(8)),
        q(where={"and": [{"field": "id", "op": "eq", "value": 1}] * 64}), q(where={"field": "id", "op": "in", "value": list(range(201))}), q(page={"first": 201}),
        q(orderBy=[{"field": "full", "direction": "asc"}]), q(orderBy=[{"field": "zip", "direction": "asc"}]), q(distinct=["full"]), q(distinct=["id", "id"]), q(groupBy=["zip"]),
        q(aggregate={"n": {"fn": "sum", "field": "zip"}}), q(aggregate={"n;": {"fn": "count"}}), q(groupBy=["name"], aggregate={"name": {"fn": "count"}}),
        q(having={"field": "id", "op": "eq", "value": 1}), q(groupBy=["name"], having={"aggregate": "n", "op": "eq", "value": 1}),
        q(aggregate={f"n{i}": {"fn": "count"} for i in range(17)}), q(groupBy=["name"], orderBy=[{"field": "id", "direction": "asc"}]), q(groupBy=["name"], distinct=["name"]),
        {"post": {"$select": {"author": {"$select": {"id": True}, "$page": {"first": 1}}}}},
        {"user": {"$select": {"posts": {"$select": {"id": True}, "$groupBy": ["title"]}}}}, {"user": {"$select": {"posts": {"$select": {"id": True}, "$distinct": ["title"]}}}},
        {"user": {"$select": {"posts": {"$select": {"id": True}}}, "$groupBy": ["name"]}}, {"user": {"$select": {"posts": {"$select": {"id": True}, "$page": {"after": "x"}}}}},
    ],
)
def test_analysis_rejects(raw):
    with pytest.raises(ValidationError):
        plan(raw)


def test_limits_are_reached():
    plan(q(where=deep(7)))
    plan(q(where={"and": [{"field": "id", "op": "eq", "value": 1}] * 63}))
    plan(q(where={"field": "id", "op": "in", "value": list(range(200))}, page={"first": 200}))


def test_scope_ignores_how_a_query_was_written():
    a = plan(q(where={"field": "id", "op": "gt", "value": 1}))
    b = plan({"users": {"$where": {"value": 1, "op": "gt", "field": "id"}, "$select": {"name": True}}})
    assert scope(a) == scope(b) != scope(plan(q(where={"field": "id", "op": "gt", "value": 2})))


def entity(**computed):
    return Schema({"user": Entity(("id", "a"), computed=computed), "shop": Entity(("id",))}, {"user.shop": Join("shop", "shops.id = users.shop_id"), "user.shops": Join("shop", "shops.user_id = users.id", True)})


@pytest.mark.parametrize(
    "computed",
    [Computed((), len), Computed(("zip",), len), Computed(("a",), None), Computed(("shop.zip",), len), Computed(("nobody.id",), len), Computed(("shop.owner.id",), len), Computed(("shops.id",), len), Computed(("a",), len, "date")],
)
def test_computed_definitions(computed):
    entity(x=Computed(("a", "shop.id"), len)).checked()
    with pytest.raises(SchemaError):
        entity(x=computed).checked()
    with pytest.raises(SchemaError):
        entity(a=Computed(("id",), len)).checked()
    with pytest.raises(SchemaError):
        entity(x=Computed(("a",), len), y=Computed(("x",), len)).checked()


def test_schema_extension_and_warnings():
    more = SCHEMA.extend({"user": {"fields": ("id",)}, "tag": {"fields": ("id",)}}, {"user.posts": None, "tag.users": Join("user", "x.y = z.w", True)})
    assert more.entities["user"].fields == ("id",) and "user.posts" not in more.joins and "user.posts" in SCHEMA.joins and "tag.users" in more.joins
    with pytest.raises(SchemaError):
        SCHEMA.extend({"nobody": {"table": "x"}})
    got = Schema({k: Entity(("id",)) for k in ("person", "category", "box", "status", "day", "user")} | {"child": Entity(("id",), table="kids")}).warnings()
    assert [w.split("'")[1] for w in got] == ["person", "category", "box", "status"]
    with pytest.raises(SchemaError):
        Schema({"a": Entity(("id",))}, {"a.b": Join("c", "x.y = z.w")}).checked()
