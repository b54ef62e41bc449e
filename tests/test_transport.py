"""Built queries, requests, uploads, writes."""

import json

import pytest

from treeline.access import Context
from treeline.builder import aggregate, field, read
from treeline.engine import Engine
from treeline.errors import IntegrityError, ParseError, ResolverError, ValidationError
from treeline.integrity import PersistedQueries, Tokens, encode_header, signature
from treeline.operators.writes import written
from treeline.plans.wire import parse_json
from treeline.schema import Computed, Entity, Join, Schema
from treeline.sources.uploads import HadoopStorage, LocalStorage, Uploads
from treeline.transport import Handlers, Request

SCHEMA = Schema({"user": Entity(("id", "name", "born"), table="users", columns={"born": "birth_year"}, computed={"x": Computed(("id",), lambda h: h["id"])}), "post": Entity(("id",), table="posts")}, {"user.posts": Join("post", "posts.user_id = users.id", True)})


@pytest.fixture()
def engine(spark):
    return Engine(spark, SCHEMA, {"users": spark.createDataFrame([(1, "Ada", 1815), (2, "Grace", 1906), (3, None, 1900)], "id int, name string, birth_year int"), "posts": spark.createDataFrame([(1, 1), (2, 1)], "id int, user_id int")})


def test_builder(engine):
    made = read("user").select("id", "name").many("posts", read().select("id").where(field("id").gt(1)).order(field("id").desc()).page(1))
    made.where(field("name").like("%a%") | field("name").is_null()).where(~field("id").among(3)).order(field("born").desc(nulls_first=True)).page(5)
    assert parse_json(json.dumps(made.json())) == made.query
    assert engine.execute(made.json())["items"] == [{"id": 2, "name": "Grace", "posts": []}, {"id": 1, "name": "Ada", "posts": [{"id": 2}]}]
    groups = read("user").select("name").group("name").aggregate("n", "count").having(aggregate("n").gte(1) & field("name").is_not_null()).order(aggregate("n").asc(), field("name").desc())
    assert [x["name"] for x in engine.execute(groups.query)["items"]] == ["Grace", "Ada"]
    assert read("user").select("id").one("posts", read().select("id")).braces() == "{ user { id posts { id } } }"
    assert len(engine.execute(read("user").select("id").distinct("name").where(field("id").not_among(9) & field("id").ne(9) & field("id").lte(3) & field("id").gte(1) & field("id").lt(4) & (field("name").ilike("%") | field("id").eq(3))).query)["items"]) == 3


def ask(raw, form="ql", **more):
    return Request({"X-Query": encode_header(raw), "X-Query-Format": form}, **more)


def test_requests(engine):
    h = Handlers(engine, PersistedQueries())
    assert h.get(ask("{ user { name } }", entity="user", id="1")).body == {"name": "Ada"}
    assert h.get(ask("{ user { name } }", entity="users")).body["pageInfo"]["hasNextPage"] is False
    assert h.get(ask("{ user { name } }", entity="user", id="77")).body is None
    assert h.get(Request({}, "user")).status == 400 and h.get(ask("{ user { zip } }")).body["error"]["code"] == "ValidationError"
    assert h.get(ask("{ user { id } }", entity="post")).status == 400 and h.get(ask("{}", "xml")).status == 400 and h.get(Request({"x-query": "%"})).status == 400
    assert h.get(ask(json.dumps({"user": {"$select": {"id": True}, "$page": {"first": 1}}}), "json", entity="user", id="1")).status == 400
    assert h.post(Request(body=json.dumps({"query": "{ user { id } }", "format": "ql", "id": 2}))).body == {"id": 2}
    assert h.post(Request(body={"query": {"user": {"$select": {"id": True}, "$page": {"first": 1}}}})).body["items"] == [{"id": 1}]
    assert h.post(Request(body={})).status == 400
    known = h.register(Request(body={"query": "{ user { id } }", "format": "ql"})).body["id"]
    assert h.get(Request({"x-query": known}, "user", "2")).body == {"id": 2} and h.get(Request({"x-query": "q_00"}, "user")).status == 400
    assert h.register(Request(body={"query": "{", "format": "ql"})).status == 400 and Handlers(engine).register(Request(body={})).status == 400
    assert json.loads(h.get(ask("{ user { id } }", entity="user", id="1")).text()) == {"id": 1}


def test_signed_requests(engine):
    tokens = Tokens(b"key")
    h, token = Handlers(engine, tokens=tokens), tokens.issue(Context("u"))
    good = ask("{ user { id } }", entity="user", id="1")
    sign = {"Authorization": f"Bearer {token}", "X-Query-Signature": signature(tokens.signing_key(token), good.headers["X-Query"])}
    assert h.get(good).status == 401
    assert h.get(Request(dict(good.headers) | sign, "user", "1")).body == {"id": 1}
    assert h.get(Request(dict(ask("{ user { name } }").headers) | sign, "user", "1")).status == 401
    assert h.post(Request(body={"query": "{ user { id } }", "format": "ql"})).status == 401


@pytest.mark.parametrize("kind", ["local", "hadoop"])
def test_uploads(spark, tmp_path, kind):
    store = LocalStorage(str(tmp_path)) if kind == "local" else HadoopStorage(spark, f"file://{tmp_path}")
    uploads = Uploads(store, ("text/plain", "image/*"), 10)
    got = uploads.accept(b"hello", "text/plain", "a.tar.gz", folder="in")
    assert store.get(got.key) == b"hello" and got.key.startswith("in/") and got.key.endswith(".gz") and got.size == 5
    uploads.accept(b"x", "image/png", hash=uploads.accept(b"x", "image/png").hash)
    for bad in ("../x", "/etc/x", "a/../../x", ""):
        with pytest.raises(ValidationError):
            store.put(bad, b"")
    with pytest.raises(ValidationError):
        uploads.accept(b"x" * 11, "text/plain")
    with pytest.raises(ValidationError):
        uploads.accept(b"x", "text/html")
    with pytest.raises(IntegrityError):
        uploads.accept(b"x", "text/plain", hash="0")
    store.delete(got.key)
    with pytest.raises(ResolverError):
        store.get(got.key)


def test_writes(engine):
    w = lambda op, at=None, **data: {"$write": {"op": op, "entity": "user", "id": at, "data": data}}
    users = engine.catalog.table("users")
    got = written(users, SCHEMA, "user", [w("create", name="Eva"), w("update", 1, name="Ada L.", born="1816"), w("delete", "2"), w("delete", "none")])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "Ada L.", 1816), (3, None, 1900), (None, "Eva", None)]
    for bad in (w("update", 1, id=5), w("update", None, name="x"), w("create"), w("update", 1, x=1), w("update", 1, zip=1), {"$write": {"op": "create", "entity": "post", "data": {"id": 1}}}, {"$write": {"op": "create", "entity": "z"}}):
        with pytest.raises(ValidationError):
            written(users, SCHEMA, "user", [bad])
    for bad in ({}, {"$write": {"op": "merge", "entity": "user"}}):
        with pytest.raises(ParseError):
            written(users, SCHEMA, "user", [bad])
    with pytest.raises(ValidationError):
        written(users, SCHEMA, "user", [w("delete", 1)] * 201)
