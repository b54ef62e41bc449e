"""The WSGI application and its client, in process and over a local socket."""

import threading
from wsgiref.simple_server import WSGIRequestHandler, make_server

import pytest

from treeline.access import Context
from treeline.builder import read
from treeline.engine import Engine
from treeline.integrity import PersistedQueries, Tokens
from treeline.schema import Entity, Join, Schema
from treeline.service import Application, Client, ClientError, http
from treeline.sources.uploads import LocalStorage, Uploads
from treeline.transport import Handlers

SCHEMA = Schema({"user": Entity(("id", "name")), "post": Entity(("id",))}, {"user.posts": Join("post", "posts.user_id = users.id", True)})


@pytest.fixture(scope="module")
def engine(spark):
    users = spark.createDataFrame([(i, f"n{i}") for i in range(1, 8)], "id int, name string")
    return Engine(spark, SCHEMA, {"users": users, "posts": spark.createDataFrame([(1, 1), (2, 1)], "id int, user_id int")})


class Quiet(WSGIRequestHandler):
    def log_message(self, *args):
        pass


@pytest.fixture()
def served():
    running = []

    def serve(application):
        server = make_server("127.0.0.1", 0, application, handler_class=Quiet)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        running.append(server)
        return http(f"http://127.0.0.1:{server.server_port}{application.base}")

    yield serve
    for server in running:
        server.shutdown()
        server.server_close()


def test_reads(engine, served):
    client = Client(served(Application(Handlers(engine), base="/api")))
    assert client.read("user", "{ user { name posts { id } } }", 1) == {"name": "n1", "posts": [{"id": 1}, {"id": 2}]}
    assert client.read("user", read("user").select("id"), "none") is None
    assert [x["id"] for x in client.pages("user", read("user").select("id").page(3))] == [1, 2, 3, 4, 5, 6, 7]
    assert client.post({"user": {"$select": {"id": True}, "$page": {"first": 2}}})["items"] == [{"id": 1}, {"id": 2}]
    assert client.post("{ user { name } }", 3) == {"name": "n3"}
    for call in (lambda: client.read("user", "{ user { zip } }"), lambda: client.post("{"), lambda: client.register("{ user { id } }"), lambda: client.upload(b"x", "text/plain")):
        with pytest.raises(ClientError):
            call()


def test_registered_queries(engine, served):
    known = PersistedQueries()
    client = Client(served(Application(Handlers(engine, known))), register=True)
    assert client.read("user", "{ user { name } }", 2) == {"name": "n2"} and len(known.known) == 1
    known.known.clear()  # a server that began anew
    assert client.read("user", "{ user { name } }", 2) == {"name": "n2"} and len(known.known) == 1
    with pytest.raises(ClientError) as wrong:
        client.read("user", "{ user { zip } }")
    assert wrong.value.status == 400 and wrong.value.code == "ValidationError"


def test_signed_reads_and_uploads(engine, served, tmp_path):
    now = [0.0]
    tokens, asked = Tokens(b"key", 60, lambda: now[0]), []

    def credentials():
        asked.append(1)
        token = tokens.issue(Context("u"))
        return token, tokens.signing_key(token)

    uploads = Uploads(LocalStorage(str(tmp_path)), ("text/plain",))
    send = served(Application(Handlers(engine, tokens=tokens), uploads))
    client = Client(send, credentials)
    assert client.read("user", read("user").select("name"), 1) == {"name": "n1"} and len(asked) == 1
    now[0] = 61  # the token has expired
    assert client.read("user", read("user").select("name"), 1) == {"name": "n1"} and len(asked) == 2
    got = client.upload(b"hello", "text/plain", "a b.txt", "in")
    assert uploads.storage.get(got["key"]) == b"hello" and got["size"] == 5 and got["key"].startswith("in/")
    for other, status in ((Client(send), 401), (Client(send, lambda: ("junk.x", b"k")), 401)):
        with pytest.raises(ClientError) as refused:
            other.read("user", "{ user { id } }")
        assert refused.value.status == status
    with pytest.raises(ClientError):
        client.upload(b"x", "image/png")
    assert send("DELETE", "/user", {}, None)[0] == 405 and send("GET", "/a/b/c", {}, None)[0] == 404
    assert send("PUT", "/files", {"content-type": "text/plain", "x-content-hash": "0"}, b"x")[0] == 401
