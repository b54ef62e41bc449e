"""Notifications of changed records, and snapshots that follow them, by Structured Streaming.

A notification is a JSON line {"channel", "payload", "publishedAt"}; its channel names an entity and, mostly, a record.
Each micro-batch names every record once, however often it changed, as a snapshot is a full read anyway.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeline.access import Context
from treeline.engine import Engine
from treeline.errors import error_body

PREFIX = "treeline"
SCHEMA = "channel string, payload string, publishedAt timestamp"


def channel(entity: str, id: Any = None, prefix: str = PREFIX) -> str:
    return f"{prefix}:{entity}" if id is None else f"{prefix}:{entity}:{id}"


def parse_channel(text: str, prefix: str = PREFIX) -> tuple[str, str | None] | None:
    """Entity and id of a channel; None for what is none of ours."""
    parts = text.split(":")
    if parts[0] != prefix or len(parts) not in (2, 3) or not all(parts[1:]):
        return None
    return parts[1], parts[2] if len(parts) == 3 else None


def encode(entity: str, id: Any = None, payload: Any = None, at: str | None = None) -> str:
    return json.dumps({"channel": channel(entity, id), "payload": json.dumps(payload if payload is not None else {"type": "updated"}), "publishedAt": at})


def decoded(lines: DataFrame, column: str = "value", prefix: str = PREFIX, sent_on: Column | None = None) -> DataFrame:
    """entity, id, payload, published_at of lines.  ``sent_on``: the channel that a transport itself names; it holds for
    lines that name none, and a line there that is no JSON is its own payload.  What is on no channel of ours is left out."""
    raw = F.col(column).cast("string")
    got = F.from_json(raw, SCHEMA, {"mode": "PERMISSIVE"})
    own = F.lit(None).cast("string") if sent_on is None else sent_on
    told = F.coalesce(got["channel"], own).alias("channel")
    payload = F.when(F.coalesce(got["channel"], got["payload"], got["publishedAt"].cast("string")).isNull(), raw).otherwise(got["payload"]).alias("payload")
    parts = F.split(F.col("_n.channel"), ":")
    rows = lines.select(F.struct(told, payload, got["publishedAt"].alias("publishedAt")).alias("_n")).filter(F.col("_n.channel").isNotNull())
    rows = rows.filter((F.element_at(parts, 1) == prefix) & F.size(parts).isin(2, 3))
    second = F.when(F.size(parts) == 3, F.try_element_at(parts, F.lit(3)))
    return rows.select(
        F.element_at(parts, 2).alias("entity"), second.alias("id"), F.col("_n.payload").alias("payload"),
        F.coalesce(F.col("_n.publishedAt"), F.current_timestamp()).alias("published_at"),
    ).filter(F.col("entity") != "")


def changed(rows: DataFrame) -> DataFrame:
    """Each record of a batch of notifications once, with the time of its last one."""
    return rows.filter("id is not null").groupBy("entity", "id").agg(F.max("published_at").alias("published_at"))


@dataclass
class Event:
    """A snapshot ("update") or what went wrong ("error")."""

    kind: str
    id: Any
    data: Any

    def sse(self) -> str:
        """As a server-sent event."""
        return f"event: {self.kind}\nid: {self.id}\ndata: {json.dumps(self.data, default=str)}\n\n"


def snapshot(engine: Engine, query: Any, id: Any, form: str = "json", context: Context | None = None) -> Event:
    try:
        return Event("update", id, engine.execute(query, form, context, id=id))
    except Exception as error:  # a failed snapshot is an event like others; the stream goes on
        return Event("error", id, error_body(error))


def snapshots(engine: Engine, query: Any, ids: list[Any], form: str = "json", context: Context | None = None) -> list[Event]:
    """Snapshots of several records by one read; where that fails, one by one."""
    if not ids:
        return []
    try:
        found = engine.records(query, ids, form, context)
        if all(str(i) in found for i in ids):
            return [Event("update", i, found[str(i)]) for i in ids]
    except Exception:  # noqa: S110 - each by itself says what is wrong with it
        pass
    return [snapshot(engine, query, i, form, context) for i in ids]


def live(
    engine: Engine, notifications: DataFrame, entity: str, query: Any, ids: list[Any], emit: Callable[[Event], None], *,
    form: str = "json", context: Context | None = None, checkpoint: str | None = None, once: bool = False,
) -> StreamingQuery:
    """Snapshots of the watched records ``ids``: one each at once, then one each time a batch says they changed.

    ``notifications``: a streaming DataFrame of lines (column ``value``).  ``once``: reads what is there, then ends.
    """
    for event in snapshots(engine, query, ids, form, context):
        emit(event)
    wanted = {str(i): i for i in ids}

    def batch(rows: DataFrame, _: int) -> None:
        # no more than the watched records come back
        hit = changed(rows).filter((F.col("entity") == entity) & F.col("id").isin(*wanted)).select("id").collect()
        for event in snapshots(engine, query, [wanted[r["id"]] for r in sorted(hit)], form, context):
            emit(event)

    writer = decoded(notifications).writeStream.foreachBatch(batch).outputMode("append")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def request_rates(requests: DataFrame, key: Column, time: str = "ts", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Requests of each key in each window: the streaming form of a rate limit."""
    rows = requests.withWatermark(time, late).select(F.col(time).alias("_t"), key.alias("key")) if requests.isStreaming else requests.select(F.col(time).alias("_t"), key.alias("key"))
    return rows.groupBy(F.window("_t", window).alias("w"), "key").count().select(F.col("w.start").alias("window_start"), "key", F.col("count").alias("requests"))
