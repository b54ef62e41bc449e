"""Plugins, signatures, persisted queries, schema inference, live reads."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from treeline.access import Context
from treeline.engine import Engine
from treeline.errors import IntegrityError, ParseError, RateLimitError, SchemaError, TransportError, ValidationError, error_body
from treeline.integrity import PersistedQueries, Tokens, content_hash, decode_header, encode_header, signature
from treeline.plugins import Answer, ComplexityLimit, DepthLimit, Logger, Plugin, RateLimit, seconds
from treeline.schema import Entity, Join, Schema, Through
from treeline.sources.catalog import Catalog, write
from treeline.sources.infer import from_dataframes, from_drizzle, from_prisma, from_sdl, from_tables
from treeline.streaming.live import Event, changed, channel, decoded, encode, live, parse_channel, request_rates
from treeline.streaming.pubsub import FolderPubSub, MemoryPubSub, follow

SCHEMA = Schema({"user": Entity(("id", "name"), table="users"), "post": Entity(("id",), table="posts")}, {"user.posts": Join("post", "posts.user_id = users.id", True), "posts.user": Join("user", "users.id = posts.user_id")})
DEEP = "{ user { id posts { id user { name } } } }"


@pytest.fixture()
def engine(spark):
    return Engine(spark, SCHEMA, {"users": spark.createDataFrame([(1, "Mira"), (2, "Tovah")], "id int, name string"), "posts": spark.createDataFrame([(1, 1), (2, 1)], "id int, user_id int")})


def test_limits(engine):
    engine.use(DepthLimit(2))
    engine.execute("{ user { id posts { id } } }", "ql", id=1)
    with pytest.raises(ValidationError):
        engine.execute(DEEP, "ql", id=1)
    plan = engine.plan(DEEP, "ql")
    assert ComplexityLimit(0).cost(plan) == 3 + 20
    with pytest.raises(ValidationError):
        ComplexityLimit(22).on_plan(plan, Context())
    ComplexityLimit(23).on_plan(plan, Context())


def test_rate_limit():
    now = [0.0]
    limit = RateLimit(2, "10s", clock=lambda: now[0])
    a, b = Context("a"), Context("b")
    for c in (a, a, b):
        limit.on_request("", c)
    with pytest.raises(RateLimitError):
        limit.on_request("", a)
    now[0] = 10
    limit.on_request("", a)
    assert [seconds(x) for x in ("500ms", "10s", "1m", "2h")] == [0.5, 10, 60, 7200]
    with pytest.raises(ValueError):
        seconds("1d")


def test_hooks_run_in_order_and_back(engine):
    calls = []

    class Told(Plugin):
        def __init__(self, name):
            self.name = name

        def on_request(self, raw, context):
            calls.append(f"request {self.name}")
            return raw

        def on_plan(self, plan, context):
            calls.append(f"plan {self.name}")
            return plan

        def on_result(self, rows, plan, context):
            calls.append(f"result {self.name}")
            return rows

        def on_response(self, value, context):
            calls.append(f"response {self.name}")
            return value

        def on_error(self, error, context):
            calls.append(f"error {self.name}")

    engine.use(Told("a")).use(Told("b"))
    engine.execute("{ user { id } }", "ql", id=1)
    assert calls == [f"{x} {n}" for x, order in (("request", "ab"), ("plan", "ab"), ("result", "ba"), ("response", "ba")) for n in order]
    calls.clear()
    with pytest.raises(ParseError):
        engine.execute("{", "ql")
    assert calls == ["request a", "request b", "error a", "error b"]


def test_a_plan_hook_can_answer(engine, caplog):
    class Kept(Plugin):
        def on_plan(self, plan, context):
            raise Answer({"kept": True})

    with caplog.at_level(logging.INFO, logger="treeline"):
        assert engine.use(Logger()).use(Kept()).execute("{ user { id } }", "ql", id=1) == {"kept": True}
    assert [r.message for r in caplog.records] == ["request of ::", "response to ::"]


def test_tokens_and_signatures():
    now = [0.0]
    tokens = Tokens(b"key", 60, lambda: now[0])
    token = tokens.issue(Context("u", "admin", "t"))
    assert tokens.read(token) == Context("u", "admin", "t")
    raw = '{"user":{}}'
    assert tokens.check_query(token, raw, signature(tokens.signing_key(token), raw)).role == "admin"
    with pytest.raises(IntegrityError):
        tokens.check_query(token, raw + " ", signature(tokens.signing_key(token), raw))
    with pytest.raises(IntegrityError):
        tokens.read(Tokens(b"other").issue(Context("u", "admin")))
    tokens.revoke(token)
    with pytest.raises(IntegrityError):
        tokens.read(token)
    later = tokens.issue(Context("u"))
    now[0] = 61
    with pytest.raises(IntegrityError):
        tokens.read(later)
    assert content_hash("a") == content_hash(b"a")


def test_persisted_queries():
    store = PersistedQueries()
    one = store.register("{ user { id } }", "ql")
    assert one == store.register("{ user { id } }", "ql") != store.register("{ user { id } }", "json")
    assert len(one) == 10 and store.is_id(one) and not store.is_id("q_") and store.lookup(one) == ("{ user { id } }", "ql")
    clash = PersistedQueries()
    clash.known[one] = ("other", "json")
    assert len(clash.register("{ user { id } }", "ql")) == 12
    with pytest.raises(TransportError):
        store.lookup("q_none")
    assert decode_header(encode_header("é")) == "é"
    with pytest.raises(TransportError):
        decode_header("?")
    assert error_body(ValidationError("x"))["error"] == {"code": "ValidationError", "message": "x", "status": 400}
    assert error_body(KeyError("secret"))["error"]["message"] == "internal error"


PRISMA = """
model User {
  uuid   String @id
  name   String? @map("full_name") // shown
  posts  Post[]
  tags   Tag[]
  @@map("app_users")
}
model Post {
  a      Int
  b      Int
  owner  String @map("owner_id")
  author User @relation(fields: [owner], references: [uuid])
  lines  Line[]
  @@id([a, b])
}
model Line {
  id   Int @id @default(autoincrement())
  pa   Int
  pb   Int
  post Post @relation(fields: [pa, pb], references: [a, b])
}
model Tag {
  id    Int @id
  users User[]
}
"""


def test_prisma():
    got = from_prisma(PRISMA).checked()
    assert got.entities["user"] == Entity(("uuid", "name"), "uuid", "app_users", {"name": "full_name"})
    assert got.entities["post"].ids == ("a", "b") and got.table("post") == "posts"
    assert got.joins["user.posts"] == Join("post", "parent.uuid = child.owner_id", True, "posts")
    assert got.joins["post.author"] == Join("user", "parent.owner_id = child.uuid", False, "app_users")
    assert got.joins["post.lines"].on == "parent.a = child.pa AND parent.b = child.pb"
    assert got.joins["user.tags"].through == Through("_TagToUser", "B", "A") and got.joins["tag.users"].through == Through("_TagToUser", "A", "B")
    with pytest.raises(SchemaError):
        from_prisma("enum X { A }")


def test_sdl_and_tables(spark):
    schema, report = from_sdl('type Query { posts: [Post] }\n"""x"""\ntype Post { id: ID! title: String author: User! tags: [String!]! at: Date }\ntype User { id: ID! posts(first: Int): [Post!]! }')
    assert set(schema.entities) == {"post", "user"} and schema.entities["post"].fields == ("id", "title", "tags", "at")
    assert schema.joins["post.author"].on == "parent.authorId = child.id" and schema.joins["user.posts"].many and len(report.manual) == 3
    got = from_tables({"users": {"columns": {"id": "user_id", "name": "name"}, "relations": {"posts": {"table": "posts", "fields": ["id"], "references": ["owner"], "many": True}}}, "posts": {"columns": ["key", "owner"], "id": "key"}})
    assert got.entities["user"].columns == {"id": "user_id"} and got.joins["user.posts"].on == "parent.user_id = child.owner"
    frames = from_dataframes({"t": spark.createDataFrame([(1, "a")], "k int, v string")})
    assert frames.entities["t"] == Entity(("k", "v"), "k", "t")


def test_sources_and_sink(spark, tmp_path, engine):
    write(engine.dataframe("{ user { id posts { id } } }", "ql", unpaged=True), str(tmp_path / "out.json"), "json")
    back = Engine(spark, Schema({"u": Entity(("id", "posts"), table="out")}), Catalog.files(spark, str(tmp_path), ["out"], "json"))
    assert back.execute("{ u { id posts } }", "ql")["items"][0] == {"id": 1, "posts": [{"id": 1}, {"id": 2}]}
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.txt").write_bytes(b"hello")
    files = Engine(spark, Schema({"file": Entity(("path", "length"), "path", "uploads")}), Catalog.blobs(spark, str(tmp_path / "up")))
    assert [x["length"] for x in files.execute("{ file { length } }", "ql")["items"]] == [5]
    spark.createDataFrame([(1, "x")], "id int, name string").createOrReplaceTempView("seen_users")
    assert Engine(spark, Schema({"user": Entity(("id", "name"), table="seen_users")}), Catalog.tables(spark, ["seen_users"])).execute("{ user { name } }", "ql", id=1) == {"name": "x"}


def test_pushed_filters_and_columns(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as k", "'x' as unused").write.parquet(str(tmp_path / "t.parquet"))
    engine = Engine(spark, Schema({"t": Entity(("id", "k"), table="t")}), Catalog.files(spark, str(tmp_path), ["t"]))
    text = engine.execute_detailed({"t": {"$select": {"id": True}, "$where": {"field": "k", "op": "eq", "value": 3}, "$page": {"first": 5}}}).meta["explain"]
    assert "EqualTo(k,3)" in text and "unused" not in text and "TakeOrderedAndProject" in text


def test_page_keys_reach_the_children(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "p.parquet"))
    spark.range(1000).selectExpr("id", "id % 100 as p").write.parquet(str(tmp_path / "c.parquet"))
    engine = Engine(spark, Schema({"p": Entity(("id",), table="p"), "c": Entity(("id",), table="c")}, {"p.cs": Join("c", "c.p = p.id", True)}), Catalog.files(spark, str(tmp_path), ["p", "c"]))
    got = engine.execute_detailed({"p": {"$select": {"id": True, "cs": {"$select": {"id": True}}}, "$page": {"first": 2}}})
    assert [len(x["cs"]) for x in got.data["items"]] == [10, 10] and "In(p, [0,1,2])" in got.meta["explain"]


def test_channels():
    assert channel("user", 3) == "treeline:user:3" and parse_channel("treeline:user:3") == ("user", "3") and parse_channel("treeline:user") == ("user", None)
    assert parse_channel("other:user") is None and parse_channel("treeline:a:b:c") is None and parse_channel("treeline") is None
    assert Event("update", 1, {"a": 1}).sse() == 'event: update\nid: 1\ndata: {"a": 1}\n\n'


def test_decoding_is_tolerant(spark):
    lines = [encode("user", 1, at="2024-01-01T00:00:00"), encode("user"), encode("user", 1), "junk", "{}", json.dumps({"channel": "other:user:1"}), json.dumps({"channel": "treeline::1"})]
    got = decoded(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r["entity"], r["id"]) for r in got.collect() if r["id"]) == [("user", "1"), ("user", "1")] and got.count() == 3
    assert [(r["entity"], r["id"]) for r in changed(got).collect()] == [("user", "1")]


def test_live_snapshots(spark, engine, tmp_path):
    events = []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([encode("user", 1), encode("user", 1), encode("user", 7), encode("post", 2), "junk"]))
    lines = spark.readStream.format("text").load(str(tmp_path / "in"))
    run = live(engine, lines, "user", "{ user { name } }", [1, 2], events.append, form="ql", checkpoint=str(tmp_path / "ck"), once=True)
    run.awaitTermination(60)
    assert [(e.kind, e.id, e.data) for e in events] == [("update", 1, {"name": "Mira"}), ("update", 2, {"name": "Tovah"}), ("update", 1, {"name": "Mira"})]
    events.clear()
    live(engine, lines, "user", "{ user { zip } }", [1], events.append, form="ql", checkpoint=str(tmp_path / "ck2"), once=True).awaitTermination(60)
    assert [e.kind for e in events] == ["error", "error"] and events[0].data["error"]["status"] == 400


def test_request_rates(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:01:00", "a"), ("2024-01-01 00:00:30", "b")]
    df = spark.createDataFrame(rows, "ts string, who string").selectExpr("cast(ts as timestamp) as ts", "who")
    got = {(str(r["window_start"])[11:16], r["key"]): r["requests"] for r in request_rates(df, F.col("who")).collect()}
    assert got == {("00:00", "a"): 2, ("00:01", "a"): 1, ("00:00", "b"): 1}
    df.write.parquet(str(tmp_path / "in"))
    stream = request_rates(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), F.col("who"))
    stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("rates").count() == 3


def test_memory_channels(engine):
    bus, got, events = MemoryPubSub(), [], []
    bus.subscribe(channel("user"), lambda _: 1 / 0)
    end = bus.subscribe(channel("user"), got.append)
    assert bus.publish(channel("user"), "x") == 2 and got == ["x"]
    end()
    end()
    assert bus.publish(channel("user")) == 1 and bus.publish("nobody") == 0
    stop = follow(engine, bus, "user", 1, "{ user { name } }", events.append, "ql")
    bus.notify("user", 1)
    bus.notify("user", 2)
    stop()
    bus.notify("user", 1)
    assert [(e.kind, e.data) for e in events] == [("update", {"name": "Mira"})] * 2


def test_folder_channels(spark, engine, tmp_path):
    bus, events = FolderPubSub(str(tmp_path / "in")), []
    bus.notify("user", 1, 2)
    bus.notify("user")
    live(engine, bus.lines(spark), "user", "{ user { name } }", [2], events.append, form="ql", checkpoint=str(tmp_path / "ck"), once=True).awaitTermination(60)
    assert [e.data for e in events] == [{"name": "Tovah"}] * 2


def test_upload_hooks(tmp_path):
    from treeline.plugins import File
    from treeline.sources.uploads import LocalStorage, Uploads

    class Upper(Plugin):
        def on_upload(self, file, context):
            if context.user is None:
                raise ValidationError("sign in first")
            return File(file.data.upper(), file.type, file.name, file.hash)

    uploads = Uploads(LocalStorage(str(tmp_path)), plugins=[Upper()])
    got = uploads.accept(b"abc", "text/plain", "a.txt", content_hash(b"abc"), context=Context("u"))
    assert uploads.storage.get(got.key) == b"ABC" and got.hash == content_hash(b"ABC")
    with pytest.raises(ValidationError):
        uploads.accept(b"abc", "text/plain")
    with pytest.raises(IntegrityError):
        uploads.accept(b"abc", "text/plain", hash=content_hash(b"x"), context=Context("u"))


def test_raw_payloads(spark):
    lines = ["not json", encode("user", 3, {"x": 1}), '{"payload": "p"}']
    rows = spark.createDataFrame([(x, "treeline:user:9") for x in lines], "value string, topic string")
    got = sorted((r["entity"], r["id"], r["payload"]) for r in decoded(rows, sent_on=F.col("topic")).collect())
    assert got == [("user", "3", '{"x": 1}'), ("user", "9", "not json"), ("user", "9", "p")]
    assert decoded(rows).count() == 1


def test_heartbeat(engine):
    import time

    said, events = [], []
    stop = follow(engine, MemoryPubSub(), "user", 1, "{ user { name } }", events.append, "ql", beat=said.append, every=0.02)
    time.sleep(0.3)
    stop()
    count = len(said)
    time.sleep(0.1)
    assert len(events) == 1 and count >= 3 and set(said) == {": heartbeat\n\n"} and len(said) <= count


def test_entry_without_a_library_of_the_training_parts(tmp_path):
    """A library that only the training parts need may be missing; the engine's queries are there all the same."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q) > 50, 'page_first' in q, any(n.startswith('op5') for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1], timeout=120)
    assert out.stdout.split() == ["True", "True", "False", "True"], out.stderr


DRIZZLE = """
import { pgTable, serial, text, integer, primaryKey } from "some-orm"; // { not a table
export const writers = pgTable("writer_rows", {
  id: serial("id").primaryKey(), penName: text("pen_name").notNull().default("a, b"), boss: integer("boss_id"),
});
export const books = pgTable("books", { isbn: text("isbn").primaryKey(), title: text("title"), writerId: integer("writer_id").references(() => writers.id) });
export const copies = pgTable("copies", { book: text("book_isbn"), shelf: integer(), }, (t) => ({ pk: primaryKey({ columns: [t.book, t.shelf] }) }));
export const writersRelations = relations(writers, ({ one, many }) => ({ books: many(books), boss: one(writers, { fields: [writers.boss], references: [writers.id] }) }));
export const booksRelations = relations(books, ({ one, many }) => ({
  writer: one(writers, { fields: [books.writerId], references: [writers.id] }), copies: many(copies),
}));
export const copiesRelations = relations(copies, ({ one }) => ({ of: one(books, { fields: [copies.book], references: [books.isbn] }) }));
"""


def test_from_drizzle(spark):
    schema = from_drizzle(DRIZZLE)
    assert schema.entities["writer"] == Entity(("id", "penName", "boss"), "id", "writer_rows", {"penName": "pen_name", "boss": "boss_id"})
    assert schema.entities["book"].id == "isbn" and schema.entities["copie"].id == ("book", "shelf")
    assert schema.joins["writer.books"] == Join("book", "parent.id = child.writer_id", True)
    assert schema.joins["book.writer"].on == "parent.writer_id = child.id" and schema.joins["book.copies"].on == "parent.isbn = child.book_isbn"
    assert schema.joins["writer.boss"] == Join("writer", "parent.boss_id = child.id")
    own = Engine(spark, schema, {
        "writer_rows": spark.createDataFrame([(1, "Ines", None), (2, "Olu", 1)], "id int, pen_name string, boss_id int"),
        "books": spark.createDataFrame([("x1", "Tides", 2), ("x2", "Moss", 2)], "isbn string, title string, writer_id int"),
        "copies": spark.createDataFrame([("x1", 4)], "book_isbn string, shelf int"),
    })
    got = own.execute("{ writer { penName boss { penName } books { title copies { shelf } } } }", "ql", id=2)
    assert got == {"penName": "Olu", "boss": {"penName": "Ines"}, "books": [{"title": "Tides", "copies": [{"shelf": 4}]}, {"title": "Moss", "copies": []}]}
    with pytest.raises(SchemaError):
        from_drizzle("const a = 1")
