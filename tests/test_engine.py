"""Reads end to end, on small fixtures with exact results."""

import datetime
import itertools
import math
import random

import pytest

from treeline.access import AccessPolicy, CachedAccessPolicy, Context, FolderStore, TimedStore, roles, signed_in
from treeline.engine import Engine
from treeline.errors import ResolverError, SchemaError, ValidationError
from treeline.functions.columns import concat, first_known, joined, row_by_row
from treeline.plans.analyze import Options
from treeline.plans.wire import _filter as wire_filter
from treeline.plugins import Plugin
from treeline.schema import Computed, Entity, Join, Schema, Through
from treeline.sources.catalog import Catalog, Federation

USERS = Schema(
    {
        "user": Entity(("id", "name"), computed={"shout": Computed(("name",), concat("{name}!"), "string")}),
        "token": Entity(("keyText", "validUntil"), columns={"keyText": "key_text", "validUntil": "valid_until"}),
        "note": Entity(("body",)),
    },
    {"user.tokens": Join("token", "tokens.user_id = users.id", True), "user.notes": Join("note", "notes.user_id = users.id", True)},
)


@pytest.fixture(scope="module")
def users(spark):
    return Engine(spark, USERS, {
        "users": spark.createDataFrame([(1, "Mira"), (2, "Tovah")], "id int, name string"),
        "tokens": spark.createDataFrame([(4, 1, "k-77", "2031-02-03"), (5, 1, "k-78", "2031-08-09"), (9, 2, "k-90", "2030-11-30")], "id int, user_id int, key_text string, valid_until string"),
        "notes": spark.createDataFrame([(1, 1, "first"), (2, 1, "second"), (3, 1, "third")], "id int, user_id int, body string"),
    })


def test_point_read_with_renames(users):
    got = users.execute("{ user { id name tokens { keyText validUntil } } }", "ql", id=1)
    assert got == {"id": 1, "name": "Mira", "tokens": [{"keyText": "k-77", "validUntil": "2031-02-03"}, {"keyText": "k-78", "validUntil": "2031-08-09"}]}


def test_siblings_do_not_multiply(users):
    got = users.execute("{ user { id tokens { keyText } notes { body } } }", "ql", id="1")
    assert len(got["tokens"]) == 2 and [n["body"] for n in got["notes"]] == ["first", "second", "third"]
    assert users.execute("{ user { id tokens { keyText } notes { body } } }", "ql", id=2) == {"id": 2, "tokens": [{"keyText": "k-90"}], "notes": []}
    assert users.execute("{ user { id } }", "ql", id=9) is None and users.execute("{ user { id } }", "ql", id="x") is None


def q(select="id name", **controls):
    return {"user": {"$select": dict.fromkeys(select.split(), True)} | {f"${k}": v for k, v in controls.items()}}


def test_collection_controls(users):
    assert [x["name"] for x in users.execute(q(page={"first": 1}))["items"]] == ["Mira"]
    assert users.execute(q(page={"first": 1}))["pageInfo"]["hasNextPage"]
    for where, names in (({"field": "name", "op": "eq", "value": "Tovah"}, ["Tovah"]), ({"field": "name", "op": "in", "value": ["Mira", "Tovah"]}, ["Mira", "Tovah"]), ({"field": "name", "op": "ilike", "value": "m%"}, ["Mira"])):
        assert [x["name"] for x in users.execute(q(where=where))["items"]] == names
    assert [x["name"] for x in users.execute(q(orderBy=[{"field": "name", "direction": "desc"}]))["items"]] == ["Tovah", "Mira"]
    got = users.execute(q("name", groupBy=["name"], aggregate={"total": {"fn": "count", "field": "*"}}))
    assert got["items"] == [{"name": "Mira", "total": 1}, {"name": "Tovah", "total": 1}]
    assert not got["pageInfo"]["hasNextPage"] and got["pageInfo"]["startCursor"]


def test_cursor_without_the_sort_field_selected(users):
    one = users.execute(q("name", page={"first": 1}))
    two = users.execute(q("name", page={"first": 1, "after": one["pageInfo"]["endCursor"]}))
    assert [x["name"] for x in two["items"]] == ["Tovah"] and not two["pageInfo"]["hasNextPage"]
    assert users.execute(q("name", page={"after": two["pageInfo"]["endCursor"]}))["items"] == []
    for other in (q("name", orderBy=[{"field": "name", "direction": "asc"}]), q(where={"field": "id", "op": "gt", "value": 0}), {"token": {"$select": {"keyText": True}}}):
        (root,) = other
        with pytest.raises(ValidationError):
            users.execute({root: other[root] | {"$page": {"after": one["pageInfo"]["endCursor"]}}})
    with pytest.raises(ValidationError):
        users.execute(q(page={"after": "junk"}))


def test_detailed_and_description(users):
    got = users.execute_detailed(q("shout"))
    assert got.data["items"][0] == {"shout": "Mira!"} and got.meta["plan"]["entity"] == "user" and "Physical Plan" in got.meta["explain"]
    about = users.describe({"user"})
    assert about["entities"][0]["fields"] == [{"name": "id", "kind": "scalar", "sparkType": "int"}, {"name": "name", "kind": "scalar", "sparkType": "string"}, {"name": "shout", "kind": "computed", "type": "string"}]


BLOG = Schema(
    {
        "post": Entity(("id", "title"), computed={"by": Computed(("author.name", "title"), concat("{title} by {author.name}"))}),
        "comment": Entity(("id", "body")), "user": Entity(("id", "name")), "tag": Entity(("id", "name")),
    },
    {
        "post.comments": Join("comment", "comments.post_id = posts.id", True), "comments.author": Join("user", "users.id = comments.author_id"),
        "post.author": Join("user", "users.id = posts.author_id"), "author.posts": Join("post", "posts.author_id = users.id", True),
        "post.tags": Join("tag", many=True, through=Through("_PostToTag", "A", "B")), "tag.posts": Join("post", many=True, through=Through("_PostToTag", "B", "A")),
        "comments.fans": Join("user", "users.fan_of = posts.author_id AND users.name <> 'Bob'", True),
    },
)


@pytest.fixture(scope="module")
def blog(spark):
    return Engine(spark, BLOG, {
        "posts": spark.createDataFrame([(1, "Hello", 1), (2, "World", 1), (3, "Orphan", 9), (4, "Null", None)], "id int, title string, author_id int"),
        "comments": spark.createDataFrame([(10, "first", 1, 1), (11, "second", 1, 2), (12, "lost", None, 1), (13, "odd", 77, 1), (14, "third", 2, None)], "id int, body string, post_id int, author_id int"),
        "users": spark.createDataFrame([(1, "Mira", None), (2, "Tovah", 1), (3, "Bob", 1), (4, "Cy", 9)], "id int, name string, fan_of int"),
        "tags": spark.createDataFrame([(1, "ts"), (2, "sql"), (3, "orm")], "id int, name string"),
        "_PostToTag": spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (2, 3), (None, 1)], "A int, B int"),
    })


def test_three_levels(blog):
    got = blog.execute("{ post { id title comments { body author { name } } } }", "ql", id=1)
    assert got == {"id": 1, "title": "Hello", "comments": [{"body": "first", "author": {"name": "Mira"}}, {"body": "second", "author": {"name": "Tovah"}}]}
    rows = blog.execute("{ post { title comments { body author { name } } } }", "ql")["items"]
    assert rows[1]["comments"] == [{"body": "third", "author": None}] and rows[2]["comments"] == []


def test_many_to_many_is_deduplicated(blog):
    assert [t["name"] for t in blog.execute("{ post { tags { name } } }", "ql", id=1)["tags"]] == ["ts", "sql"]
    assert [t["name"] for t in blog.execute("{ post { tags { name } } }", "ql", id=2)["tags"]] == ["sql", "orm"]
    assert [p["title"] for p in blog.execute("{ tag { posts { title } } }", "ql", id=2)["posts"]] == ["Hello", "World"]


def test_many_below_one_keeps_all(blog):
    got = blog.execute("{ post { title author { name posts { title } } } }", "ql")["items"]
    assert got[0]["author"]["posts"] == [{"title": "Hello"}, {"title": "World"}] and got[2]["author"] is None and got[3]["author"] is None


def test_join_by_a_further_ancestor_and_a_test_of_the_child(blog):
    got = blog.execute("{ post { title comments { body fans { name } } } }", "ql")["items"]
    assert got[0]["comments"] == [{"body": "first", "fans": [{"name": "Tovah"}]}, {"body": "second", "fans": [{"name": "Tovah"}]}]
    whole = {r["title"]: r["comments"] for r in blog.dataframe("{ post { title comments { body fans { name } } } }", "ql", unpaged=True).collect()}
    assert [[f["name"] for f in c["fans"]] for c in whole["World"]] == [["Tovah"]]


def test_computed_over_a_hidden_relation(blog):
    rows = blog.execute({"post": {"$select": {"by": True}}})["items"]
    assert rows == [{"by": "Hello by Mira"}, {"by": "World by Mira"}, {"by": None}, {"by": None}]
    both = blog.execute({"post": {"$select": {"by": True, "author": {"$select": {"id": True}}}}}, id=1)
    assert both == {"by": "Hello by Mira", "author": {"id": 1}}


def test_nested_controls(blog):
    got = blog.execute({"post": {"$select": {"id": True, "comments": {"$select": {"body": True}, "$where": {"field": "body", "op": "like", "value": "%s%"}, "$orderBy": [{"field": "id", "direction": "desc"}], "$page": {"first": 1}}}}})
    assert [x["comments"] for x in got["items"]] == [[{"body": "second"}], [], [], []]


def test_page_counts_roots(spark):
    schema = Schema({"p": Entity(("id",), table="p"), "a": Entity(("id",), table="a"), "b": Entity(("id",), table="b")}, {"p.as": Join("a", "a.p = p.id", True), "p.bs": Join("b", "b.p = p.id", True)})
    engine = Engine(spark, schema, {
        "p": spark.createDataFrame([(i,) for i in range(5)], "id int"),
        "a": spark.createDataFrame([(10 * i + j, i) for i in range(5) for j in range(3)], "id int, p int"),
        "b": spark.createDataFrame([(10 * i + j, i) for i in range(5) for j in range(4)], "id int, p int"),
    })
    got = engine.execute({"p": {"$select": {"id": True, "as": {"$select": {"id": True}}, "bs": {"$select": {"id": True}}}, "$page": {"first": 2}}})
    assert [(x["id"], len(x["as"]), len(x["bs"])) for x in got["items"]] == [(0, 3, 4), (1, 3, 4)] and got["pageInfo"]["hasNextPage"]


NULLS = [(i, a, b, k) for i, ((a, b), k) in enumerate(zip(list(itertools.product([None, 1, 2], [None, "x", "y"])) * 2, itertools.cycle([0, 0, 1]), strict=False))]


@pytest.mark.parametrize("directions", list(itertools.product(("asc", "desc"), ("first", "last"), ("asc", "desc"), ("first", "last"))))
def test_pages_add_up(spark, directions):
    engine = Engine(spark, Schema({"t": Entity(("id", "a", "b"), table="t")}), {"t": spark.createDataFrame(NULLS, "id int, a int, b string, k int").coalesce(1)})
    d1, n1, d2, n2 = directions
    query = {"t": {"$select": {"id": True}, "$orderBy": [{"field": "a", "direction": d1, "nulls": n1}, {"field": "b", "direction": d2, "nulls": n2}]}}
    whole = [x["id"] for x in engine.execute(query)["items"]]

    def key(row):
        def part(v, d, n):
            if v is None:
                return (0 if n == "first" else 2, 0)
            v = ord(v) if isinstance(v, str) else v
            return (1, -v if d == "desc" else v)

        return (part(row[1], d1, n1), part(row[2], d2, n2), row[0])

    assert whole == [r[0] for r in sorted(NULLS, key=key)]
    got, after = [], None
    while True:
        page = engine.execute({"t": query["t"] | {"$page": {"first": 7} | ({"after": after} if after else {})}})
        got += [x["id"] for x in page["items"]]
        after = page["pageInfo"]["endCursor"]
        if not page["pageInfo"]["hasNextPage"]:
            break
    assert got == whole


def test_typed_cursors(spark):
    rows = [(i, float(i) if i else math.nan, datetime.datetime(2024, 1, 1, 0, 0, 0, i), f"{i}.50", datetime.date(2024, 1, 1 + i), i % 2 == 0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, d double, ts timestamp, m string, day date, flag boolean").selectExpr("id", "d", "ts", "cast(m as decimal(18,2)) as m", "day", "flag")
    engine = Engine(spark, Schema({"t": Entity(("id", "d", "ts", "m", "day", "flag"), table="t")}), {"t": df})
    for name, direction in itertools.product(("d", "ts", "m", "day", "flag"), ("asc", "desc")):
        query = {"t": {"$select": {"id": True}, "$orderBy": [{"field": name, "direction": direction}]}}
        whole = [x["id"] for x in engine.execute(query)["items"]]
        one = engine.execute({"t": query["t"] | {"$page": {"first": 2}}})
        rest = engine.execute({"t": query["t"] | {"$page": {"after": one["pageInfo"]["endCursor"]}}})
        assert [x["id"] for x in one["items"] + rest["items"]] == whole, name
    assert [x["id"] for x in engine.execute({"t": {"$select": {"id": True}, "$where": {"field": "m", "op": "gte", "value": 3.5}}})["items"]] == [3, 4]
    for field, value in (("id", "x"), ("day", "soon"), ("flag", "maybe"), ("ts", "x"), ("d", "x"), ("m", "x")):
        with pytest.raises(ValidationError):
            engine.execute({"t": {"$select": {"id": True}, "$where": {"field": field, "op": "eq", "value": value}}})


def test_patterns(spark):
    names = ["50%", "50x", "a_b", "axb", "a\\b", "Straße", "STRASSE", None]
    engine = Engine(spark, Schema({"t": Entity(("id", "s"), table="t")}), {"t": spark.createDataFrame(list(enumerate(names)), "id int, s string")})
    for op, value, want in (
        ("like", "50\\%", [0]), ("like", "50%", [0, 1]), ("like", "a\\_b", [2]), ("like", "a_b", [2, 3, 4]), ("like", "a\\\\b", [4]), ("like", "\\a_b", [2, 3, 4]), ("ilike", "STRAßE", [5]), ("ilike", "strasse", [6]),
        ("nin", ["50%", None], []), ("nin", ["50%"], [1, 2, 3, 4, 5, 6]), ("nin", [], [0, 1, 2, 3, 4, 5, 6, 7]), ("ne", "50%", [1, 2, 3, 4, 5, 6]), ("eq", None, []), ("isNull", None, [7]),
    ):
        where = {"field": "s", "op": op} | ({} if op == "isNull" else {"value": value})
        assert [x["id"] for x in engine.execute({"t": {"$select": {"id": True}, "$where": where}})["items"]] == want, (op, value)


def test_groups(spark):
    rows = [(i, k, v) for i, (k, v) in enumerate([("a", 1), ("a", 1), ("a", None), ("b", 5), (None, 7), (None, 7)])]
    engine = Engine(spark, Schema({"t": Entity(("id", "k", "v"), table="t")}), {"t": spark.createDataFrame(rows, "id int, k string, v int")})
    spec = {"n": {"fn": "count"}, "nv": {"fn": "count", "field": "v"}, "s": {"fn": "sum", "field": "v"}, "ds": {"fn": "sum", "field": "v", "distinct": True}, "lo": {"fn": "min", "field": "v", "distinct": True}, "m": {"fn": "avg", "field": "v"}}
    got = engine.execute({"t": {"$select": {"k": True, "id": True}, "$groupBy": ["k"], "$aggregate": spec, "$orderBy": [{"aggregate": "s", "direction": "desc"}]}})["items"]
    assert got == [{"k": None, "n": 2, "nv": 2, "s": 14, "ds": 7, "lo": 7, "m": 7.0}, {"k": "b", "n": 1, "nv": 1, "s": 5, "ds": 5, "lo": 5, "m": 5.0}, {"k": "a", "n": 3, "nv": 2, "s": 2, "ds": 1, "lo": 1, "m": 1.0}]
    whole = engine.execute({"t": {"$select": {"id": True}, "$aggregate": {"n": {"fn": "count"}}, "$having": {"aggregate": "n", "op": "gt", "value": 5}}})
    assert whole["items"] == [{"n": 6}] and not whole["pageInfo"]["hasNextPage"]
    some = engine.execute({"t": {"$select": {"id": True}, "$distinct": ["k"], "$orderBy": [{"field": "v", "direction": "desc"}]}})["items"]
    assert [x["id"] for x in some] == [4, 3, 0]


def test_self_join_and_keyless(spark):
    people = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 3)], "id int, boss int")
    log = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "who int, what string")
    schema = Schema({"p": Entity(("id",), table="people"), "log": Entity(("what",), None, "log")}, {"p.staff": Join("p", "child.boss = parent.id", True), "p.boss": Join("p", "parent.boss = child.id"), "p.logs": Join("log", "log.who = people.id", True)})
    engine = Engine(spark, schema, {"people": people, "log": log})
    got = engine.execute("{ p { id staff { id staff { id } } boss { id } logs { what } } }", "ql")["items"]
    assert got[0] == {"id": 1, "staff": [{"id": 2, "staff": []}, {"id": 3, "staff": [{"id": 4}]}], "boss": None, "logs": [{"what": "x"}, {"what": "x"}]}
    assert engine.execute("{ log { what } }", "ql")["items"] == [{"what": "x"}, {"what": "x"}, {"what": "y"}]
    wrong = Engine(spark, schema.extend(joins={"p.staff": Join("p", "people.boss = people.id", True)}), {"people": people, "log": log})
    with pytest.raises(SchemaError):
        wrong.execute("{ p { staff { id } } }", "ql")


def test_one_with_several_matches_takes_the_least_id(spark):
    schema = Schema({"a": Entity(("id",), table="a"), "b": Entity(("id", "v"), table="b")}, {"a.b": Join("b", "b.a_id = a.id")})
    engine = Engine(spark, schema, {"a": spark.createDataFrame([(1,), (2,)], "id int"), "b": spark.createDataFrame([(7, 1, "z"), (5, 1, "y")], "id int, a_id int, v string")})
    assert engine.execute("{ a { id b { id v } } }", "ql")["items"] == [{"id": 1, "b": {"id": 5, "v": "y"}}, {"id": 2, "b": None}]


def test_flat_rows_nest_again(blog):
    from treeline.operators.flat import flat

    query = "{ post { id title comments { body author { name } } tags { name } } }"
    want = blog.execute(query, "ql")
    other = Engine(blog.spark, BLOG, blog.catalog).resolve("*", lambda plan, catalog: flat(plan, BLOG, catalog))
    assert other.execute(query, "ql") == want
    assert other.execute(query, "ql", id=1) == want["items"][0]
    with pytest.raises(ResolverError):
        other.resolve("*", lambda plan, catalog: None)
    with pytest.raises(ResolverError):
        other.resolve("nobody", lambda plan, catalog: None)
    nested = Engine(blog.spark, BLOG, {}).resolve("post", lambda plan, catalog: blog.dataframe(query, "ql", unpaged=True), nested=True)
    assert nested.execute("{ post { id title tags { name } } }", "ql")["items"][0]["tags"] == [{"name": "ts"}, {"name": "sql"}]


def test_a_product_of_relations_is_dealt_out(spark):
    from pyspark.sql import functions as F

    from treeline.operators.flat import BLOCK

    schema = Schema({n: Entity(("id",), table=n) for n in "pab"}, {"p.a": Join("a", "a.p = p.id", True), "p.b": Join("b", "b.p = p.id", True)})
    a = [(i, 1) for i in range(2 * BLOCK + 1)] + [(9001, 2), (9002, None)]
    b = [(i, 1) for i in range(BLOCK + 1)] + [(8000 + i, 3) for i in range(BLOCK)] + [(9003, None)]
    tables = {"p": spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")} | {n: spark.createDataFrame(rows, "id int, p int") for n, rows in (("a", a), ("b", b))}
    rows = Engine(spark, schema, tables).flat({"p": {"$select": {"id": True, "a": {"$select": {"id": True}}, "b": {"$select": {"id": True}}}}})
    want = [(p, i, j) for p in (1, 2, 3, 4) for i in [i for i, k in a if k == p] or [None] for j in [j for j, k in b if k == p] or [None]]
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, want))
    assert rows.filter("p_id = 1").select(F.spark_partition_id()).distinct().count() > 1


def test_joined_rows_nest_without_their_product(blog):
    from treeline.operators.flat import flat

    asked = []
    other = Engine(blog.spark, BLOG, blog.catalog).resolve("*", lambda plan, catalog: asked.append(plan) or flat(plan, BLOG, catalog), joined=True)
    for query in ("{ post { id title comments { body author { name } } tags { name } } }", "{ post { title tags { name } author { name } comments { body } } }"):
        want = blog.execute(query, "ql")
        assert other.execute(query, "ql") == want
        assert other.execute(query, "ql", id=1) == blog.execute(query, "ql", id=1)
    assert asked and all(len(node.refs) < 2 for plan in asked for node in plan.walk())


def test_nested_rows_keep_what_a_distinct_would_change(spark):
    schema = Schema({"p": Entity(("id", "v", "m"), table="p"), "c": Entity(("id", "s"), table="c")}, {"p.c": Join("c", "c.p = p.id", True)})
    rows = spark.sql("SELECT * FROM VALUES (1, -0.0D, map('k', 1), 5, 'x'), (1, -0.0D, map('k', 1), 5, 'x'), (1, -0.0D, map('k', 1), 6, 'y'), (2, 0.5D, NULL, NULL, NULL) AS t(p_id, p_v, p_m, c_id, c_s)")
    engine = Engine(spark, schema, {}).resolve("p", lambda plan, catalog: rows)
    children = [[{"s": "x"}, {"s": "y"}], []]
    assert engine.execute("{ p { id m c { s } } }", "ql")["items"] == [{"id": 1, "m": {"k": 1}, "c": children[0]}, {"id": 2, "m": None, "c": children[1]}]
    got = engine.execute("{ p { id v c { s } } }", "ql")["items"]
    assert got == [{"id": 1, "v": 0.0, "c": children[0]}, {"id": 2, "v": 0.5, "c": children[1]}] and math.copysign(1, got[0]["v"]) == -1
    assert engine.execute("{ p { id c { s } } }", "ql")["items"] == [{"id": 1, "c": children[0]}, {"id": 2, "c": children[1]}]


def test_column_functions(spark):
    schema = Schema({"t": Entity(("id", "a", "b"), table="t", computed={
        "all": Computed(("a", "b"), joined("-", "a", "b")), "any": Computed(("a", "b"), first_known("a", "b")), "py": Computed(("a",), row_by_row(lambda a: None if a is None else a[::-1], "string", "a")),
    })})
    engine = Engine(spark, schema, {"t": spark.createDataFrame([(1, "ab", "y"), (2, None, "y")], "id int, a string, b string")})
    assert engine.execute({"t": {"$select": {"all": True, "any": True, "py": True}}})["items"] == [{"all": "ab-y", "any": "ab", "py": "ba"}, {"all": "y", "any": "y", "py": None}]


POLICY = AccessPolicy(
    entities={"tag": signed_in, "user": lambda c: c.role != "banned"},
    fields={"user.name": roles("admin"), "post.by": roles("admin")},
    rows={"comment": lambda c: None if c.role == "admin" else {"field": "body", "op": "ne", "value": "first"}},
    points={"post": lambda c, id: id != 2},
)


def test_access(blog):
    engine = Engine(blog.spark, BLOG, blog.catalog, access=POLICY)
    admin, guest = Context("u", "admin"), Context(None, "guest")
    query = "{ post { title by comments { body author { id name } } tags { name } } }"
    assert engine.execute(query, "ql", admin, id=1)["comments"][0]["author"] == {"id": 1, "name": "Mira"}
    assert engine.execute(query, "ql", guest, id=1) == {"title": "Hello", "comments": [{"body": "second", "author": {"id": 2}}]}
    assert engine.execute(query, "ql", guest, id=2) is None
    assert "author" not in engine.execute(query, "ql", Context("x", "banned"), id=1)["comments"][0]
    assert engine.execute("{ tag { name } }", "ql", guest) == {"items": [], "pageInfo": {"hasNextPage": False, "startCursor": None, "endCursor": None}}
    assert engine.dataframe("{ tag { name } }", "ql", guest).columns == ["name"] and engine.dataframe("{ tag { name } }", "ql", guest).count() == 0
    for control in ({"$where": {"field": "name", "op": "eq", "value": "Mira"}}, {"$orderBy": [{"field": "name", "direction": "asc"}]}, {"$distinct": ["name"]}):
        with pytest.raises(ValidationError):
            engine.execute({"user": {"$select": {"id": True}} | control}, context=guest)
    only = Engine(blog.spark, BLOG, blog.catalog, access=AccessPolicy(allowed=lambda c, e: {"id"} if e == "user" else None))
    assert only.execute("{ user { id name } }", "ql")["items"][0] == {"id": 1}


def test_cached_access():
    asked = []
    now = [0.0]
    policy = CachedAccessPolicy(AccessPolicy(entities={"a": lambda c: asked.append(c.role) or c.role == "admin"}), TimedStore(60, lambda: now[0]))
    admin, guest = Context("u1", "admin"), Context("u2", "guest")
    assert [policy.entity_ok("a", c) for c in (admin, guest, admin, guest)] == [True, False, True, False] and asked == ["admin", "guest"]
    assert policy.invalidate(user="u1") == 1 and policy.entity_ok("a", admin) and asked == ["admin", "guest", "admin"]
    assert policy.invalidate(role="guest") == 1 and policy.invalidate(role="guest") == 0
    now[0] = 61
    policy.entity_ok("a", admin)
    assert len(asked) == 4 and policy.invalidate(entity="b") == 0


def test_cached_access_looks_at_all_of_a_context(tmp_path):
    for store in (TimedStore(60), FolderStore(str(tmp_path / "answers"))):
        policy = CachedAccessPolicy(AccessPolicy(entities={"a": lambda c: bool(c.more.get("vip")) or c.user == "a:b"}), store)
        assert policy.entity_ok("a", Context("u", more={"vip": True})) and not policy.entity_ok("a", Context("u"))
        assert policy.entity_ok("a", Context("a:b", "c")) and not policy.entity_ok("a", Context("a", "b:c"))
        assert not policy.entity_ok("a", Context("u", more={"vip": 0})) and policy.invalidate(user="u") == 3 and policy.invalidate() == 2


def test_folder_store(tmp_path):
    now = [0.0]
    store, other = (FolderStore(str(tmp_path / "s"), 60, lambda: now[0]) for _ in range(2))
    store.put("k", False)
    assert other.get("k") is False and other.get("x") is None
    now[0] = 61
    assert other.get("k") is None and other.drop(lambda k: k == "k") == 1 and store.drop(lambda k: True) == 0


SECRET = Schema(
    {
        "cust": Entity(("id", "name"), computed={"place": Computed(("nation.name",), concat("{nation.name}"), "string"), "title": Computed(("name",), concat("{name}!"), "string")}),
        "nation": Entity(("id", "name", "zone")), "sale": Entity(("id",)),
    },
    {"cust.nation": Join("nation", "nations.id = custs.nation_id"), "sale.cust": Join("cust", "custs.id = sales.cust_id"), "nation.custs": Join("cust", "custs.nation_id = nations.id", True)},
)


@pytest.mark.parametrize(("policy", "place", "title"), [
    (AccessPolicy(), ["openland", "hiddenland"], True), (AccessPolicy(entities={"nation": roles("admin")}), None, True),
    (AccessPolicy(fields={"nation.name": roles("admin")}), None, True), (AccessPolicy(fields={"cust.name": roles("admin")}), ["openland", "hiddenland"], False),
    (AccessPolicy(rows={"nation": lambda c: {"field": "zone", "op": "eq", "value": 1}}), ["openland", None], True),
    (AccessPolicy(allowed=lambda c, e: {"id"} if e == "nation" else None), None, True),
])
def test_computed_fields_keep_to_the_rules(spark, policy, place, title):
    engine = Engine(spark, SECRET, {
        "custs": spark.createDataFrame([(1, "ann", 1), (2, "bob", 2)], "id int, name string, nation_id int"),
        "nations": spark.createDataFrame([(1, "openland", 1), (2, "hiddenland", 2)], "id int, name string, zone int"),
        "sales": spark.createDataFrame([(10, 1), (11, 2)], "id int, cust_id int"),
    }, access=policy)
    hidden = lambda x: None if x in (None, "") else x
    root = engine.execute("{ cust { id place title } }", "ql")["items"]
    nested = [r["cust"] for r in engine.execute("{ sale { cust { id place title } } }", "ql")["items"]]
    both = engine.execute("{ cust { id place title nation { id } } }", "ql")["items"]
    points = [engine.execute("{ cust { id place title } }", "ql", id=i) for i in (1, 2)]
    flat = engine.flat("{ cust { id title } }", "ql")
    for rows in (root, nested, both, points):
        assert [hidden(r.get("place")) for r in rows] == (place or [None, None]) and all(("place" in r) == (place is not None) for r in rows)
        assert [r.get("title") for r in rows] == (["ann!", "bob!"] if title else [None, None])
    assert ("cust_name" in flat.columns) == title


def test_plugins_see_flat_rows(spark, users):
    class Only(Plugin):
        def on_plan(self, plan, context):
            plan.where = wire_filter({"field": "id", "op": "eq", "value": 1}, "test", aggregates=False)
            return plan

    own = Engine(spark, USERS, users.catalog).use(Only())
    assert own.dataframe(q(), unpaged=True).count() == 1 and own.flat(q()).count() == 1


def test_many_records_by_one_read(spark, users):
    own = Engine(spark, USERS, users.catalog, access=AccessPolicy(points={"user": lambda c, id: str(id) != "2"}))
    assert own.records(q("name"), [1, 2, "7"]) == {"1": {"name": "Mira"}}
    assert users.records(q("name"), ["1", 2]) == {"1": {"name": "Mira"}, "2": {"name": "Tovah"}} and users.records(q(), []) == {}


def test_lazy_pages(blog):
    query = {"post": {"$select": {"id": True, "tags": {"$select": {"name": True}}, "comments": {"$select": {"body": True}}}, "$page": {"first": 2}}}
    rows = [r.asDict(True) for r in blog.dataframe(query).collect()]
    assert rows == blog.execute(query)["items"]


def test_federation(spark):
    left = Catalog({"users": spark.createDataFrame([(1, "Mira")], "id int, name string")})
    right = Catalog({"tokens": spark.createDataFrame([(1, 1, "t", "x")], "id int, user_id int, key_text string, valid_until string"), "users": spark.createDataFrame([(1, "other")], "id int, name string")})
    with pytest.raises(ResolverError):
        Federation({"l": left, "r": right}).table("users")
    engine = Engine(spark, USERS, Federation({"l": left, "r": right}, {"users": "l"}))
    assert engine.execute("{ user { name tokens { keyText } } }", "ql", id=1) == {"name": "Mira", "tokens": [{"keyText": "t"}]}
    with pytest.raises(ResolverError):
        engine.execute("{ user { notes { body } } }", "ql")


def test_default_page_options(spark, users):
    small = Engine(spark, USERS, users.catalog, Options(default_first=1, max_first=1, nested_first=1))
    assert len(small.execute(q())["items"]) == 1
    assert len(small.execute("{ user { id tokens { keyText } } }", "ql")["items"][0]["tokens"]) == 1
    with pytest.raises(ValidationError):
        small.execute(q(page={"first": 2}))


def test_random_nesting_against_plain_python(spark):
    rnd = random.Random(4)
    a = [(i, rnd.choice([None, 0, 1, 2, 3])) for i in range(12)]
    b = [(i, rnd.choice([None, *range(12), 99]), rnd.randint(0, 5)) for i in range(60)]
    schema = Schema({"a": Entity(("id", "k"), table="a"), "b": Entity(("id", "v"), table="b")}, {"a.bs": Join("b", "b.a = a.id", True), "bs.a": Join("a", "a.id = b.a")})
    engine = Engine(spark, schema, {"a": spark.createDataFrame(a, "id int, k int"), "b": spark.createDataFrame(b, "id int, a int, v int")})
    got = engine.dataframe({"a": {"$select": {"id": True, "bs": {"$select": {"id": True, "a": {"$select": {"k": True}}}, "$where": {"field": "v", "op": "gt", "value": 1}, "$orderBy": [{"field": "v", "direction": "desc"}], "$page": {"first": 3}}}}}, unpaged=True)
    for r in got.collect():
        want = sorted(((-v, i) for i, p, v in b if p == r["id"] and v > 1))[:3]
        assert [(x["id"], x["a"]["k"]) for x in r["bs"]] == [(i, dict(a)[r["id"]]) for _, i in want]
