"""Where notifications come from: in-process channels, a folder of lines, Kafka."""

from __future__ import annotations

import datetime
import json
import logging
import os
import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from treeline.access import Context
from treeline.engine import Engine
from treeline.streaming.live import Event, channel, encode, snapshot

Handler = Callable[[str], None]


class MemoryPubSub:
    """Channels within this process.  A handler that fails doesn't keep others from their message."""

    def __init__(self, log: logging.Logger | None = None):
        self.log, self.lock = log or logging.getLogger("treeline"), threading.Lock()
        self.handlers: dict[str, dict[str, Handler]] = {}

    def subscribe(self, name: str, handler: Handler) -> Callable[[], None]:
        """Returns what ends the subscription (more than once does no harm)."""
        key = uuid.uuid4().hex
        with self.lock:
            self.handlers.setdefault(name, {})[key] = handler

        def end() -> None:
            with self.lock:
                own = self.handlers.get(name, {})
                own.pop(key, None)
                if not own:
                    self.handlers.pop(name, None)

        return end

    def publish(self, name: str, payload: str = "") -> int:
        """Hands the payload to each handler of the channel; returns to how many."""
        with self.lock:
            handlers = list(self.handlers.get(name, {}).values())
        for handler in handlers:
            try:
                handler(payload)
            except Exception as error:
                self.log.warning("a handler of %s failed: %s", name, error)
        return len(handlers)

    def notify(self, entity: str, id: Any) -> None:
        """Says that a record changed, on its own channel and its entity's."""
        payload = json.dumps({"type": "updated", "id": str(id)})
        self.publish(channel(entity, id), payload)
        self.publish(channel(entity), payload)


class FolderPubSub:
    """Notifications as files of lines in a folder that a stream reads; files appear whole."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def notify(self, entity: str, *ids: Any) -> None:
        at = datetime.datetime.now(datetime.UTC).isoformat()
        name = uuid.uuid4().hex
        hidden = os.path.join(self.folder, f".{name}")
        with open(hidden, "w", encoding="utf-8") as f:
            f.write("".join(encode(entity, i, at=at) + "\n" for i in ids or (None,)))
        os.replace(hidden, os.path.join(self.folder, f"{name}.json"))

    def lines(self, spark: SparkSession, files_each: int = 1000) -> DataFrame:
        return spark.readStream.format("text").option("maxFilesPerTrigger", files_each).load(self.folder)


def kafka_lines(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Notifications of a topic (needs Spark's Kafka package on the class path)."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return source.options(**options).load().selectExpr("cast(value as string) as value")


HEARTBEAT = ": heartbeat\n\n"


class Heartbeat:
    """Writes HEARTBEAT at even times, so that an idle connection stays open, until it is stopped."""

    def __init__(self, write: Callable[[str], None], every: float = 30.0):
        self.write, self.every, self.over = write, every, threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        while not self.over.wait(self.every):
            self.write(HEARTBEAT)

    def stop(self) -> None:
        self.over.set()
        if threading.current_thread() is not self.thread:
            self.thread.join()


def follow(
    engine: Engine, pubsub: MemoryPubSub, entity: str, id: Any, query: Any, emit: Callable[[Event], None], form: str = "json",
    context: Context | None = None, beat: Callable[[str], None] | None = None, every: float = 30.0,
) -> Callable[[], None]:
    """A snapshot of one record at once, and again at each of its notifications, with heartbeats to ``beat`` in between;
    returns what ends it."""
    emit(snapshot(engine, query, id, form, context))
    end = pubsub.subscribe(channel(entity, id), lambda _: emit(snapshot(engine, query, id, form, context)))
    beats = Heartbeat(beat, every) if beat else None

    def stop() -> None:
        end()
        if beats:
            beats.stop()

    return stop
