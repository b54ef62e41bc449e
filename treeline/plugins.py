"""Hooks around a read, and the plugins that come along."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from treeline.access import Context
from treeline.errors import RateLimitError, ValidationError
from treeline.plans.analyze import Node


@dataclass(frozen=True)
class File:
    """A file that is being uploaded; ``hash``: of its content, as sent."""

    data: bytes
    type: str
    name: str = ""
    hash: str | None = None


class Answer(Exception):
    """Raised by a plan hook to end a read with this result."""

    def __init__(self, value: Any):
        super().__init__("answered")
        self.value = value


class Plugin:
    """All hooks; each may be left as it is.  Requests and plans pass plugins in order, results in reverse."""

    def on_request(self, raw: Any, context: Context) -> Any:
        return raw

    def on_plan(self, plan: Node, context: Context) -> Node:
        return plan

    def on_result(self, rows: DataFrame, plan: Node, context: Context) -> DataFrame:
        return rows

    def on_response(self, value: Any, context: Context) -> Any:
        return value

    def on_upload(self, file: File, context: Context) -> File:
        """Before a file is stored; may change it, or raise to refuse it."""
        return file

    def on_error(self, error: Exception, context: Context) -> None:
        return None


class DepthLimit(Plugin):
    def __init__(self, most: int):
        self.most = most

    def on_plan(self, plan: Node, context: Context) -> Node:
        deepest = max(1 + (n.path.count(".") + 1 if n.path else 0) for n in plan.walk())
        if deepest > self.most:
            raise ValidationError(f"the query is {deepest} deep, more than {self.most}")
        return plan


class ComplexityLimit(Plugin):
    """Costs of fields and joins add up."""

    def __init__(self, most: int, field_cost: int = 1, join_cost: int = 10):
        self.most, self.field_cost, self.join_cost = most, field_cost, join_cost

    def cost(self, plan: Node) -> int:
        return sum(len(n.fields) * self.field_cost + len(n.refs) * self.join_cost for n in plan.walk())

    def on_plan(self, plan: Node, context: Context) -> Node:
        if (cost := self.cost(plan)) > self.most:
            raise ValidationError(f"the query costs {cost}, more than {self.most}")
        return plan


_UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(window: str) -> float:
    """``500ms``, ``10s``, ``1m``, ``2h`` in seconds."""
    m = re.fullmatch(r"(\d+)\s*(ms|s|m|h)", window)
    if not m or not int(m[1]):
        raise ValueError(f"'{window}' is no length of time")
    return int(m[1]) * _UNITS[m[2]]


class RateLimit(Plugin):
    """So many requests in each window, by key."""

    def __init__(self, most: int, window: str = "1m", key: Callable[[Context], str] = Context.principal, clock: Callable[[], float] = time.monotonic):
        self.most, self.window, self.key, self.clock, self.seen = most, seconds(window), key, clock, {}

    def on_request(self, raw: Any, context: Context) -> Any:
        now, key = self.clock(), self.key(context)
        begun, count = self.seen.get(key, (now, 0))
        if now - begun >= self.window:
            begun, count = now, 0
        if count >= self.most:
            raise RateLimitError(f"more than {self.most} requests; the next is welcome in {begun + self.window - now:.0f} s")
        self.seen[key] = (begun, count + 1)
        if len(self.seen) > 10_000:
            self.seen = {k: v for k, v in self.seen.items() if now - v[0] < self.window}
        return raw


class Logger(Plugin):
    def __init__(self, log: logging.Logger | None = None):
        self.log = log or logging.getLogger("treeline")

    def on_request(self, raw: Any, context: Context) -> Any:
        self.log.info("request of %s", context.principal())
        return raw

    def on_response(self, value: Any, context: Context) -> Any:
        self.log.info("response to %s", context.principal())
        return value

    def on_error(self, error: Exception, context: Context) -> None:
        self.log.warning("error for %s: %s", context.principal(), error)
