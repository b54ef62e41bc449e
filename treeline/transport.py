"""Requests and responses without a web framework: what a route handler passes in, and what it sends back.

GET /entity and GET /entity/id carry the query in a header (base64); POST / carries {"query", "format"}; a query may also
be the id of a persisted one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from treeline.access import Context
from treeline.engine import POINT, Engine
from treeline.errors import IntegrityError, TransportError, ValidationError, error_body
from treeline.integrity import PersistedQueries, Tokens, decode_header
from treeline.plans.wire import parse

QUERY, FORMAT, TOKEN, SIGNATURE = "x-query", "x-query-format", "authorization", "x-query-signature"


@dataclass(frozen=True)
class Request:
    headers: Mapping[str, str] = field(default_factory=dict)
    entity: str | None = None
    id: str | None = None
    body: Any = None


@dataclass(frozen=True)
class Response:
    status: int
    body: Any

    def text(self) -> str:
        return json.dumps(self.body, default=str)


class Handlers:
    """Answers requests by an engine; with ``tokens``, header queries must be signed."""

    def __init__(self, engine: Engine, persisted: PersistedQueries | None = None, tokens: Tokens | None = None, context: Callable[[Request], Context] | None = None):
        self.engine, self.persisted, self.tokens = engine, persisted, tokens
        self.context = context or (lambda request: Context())

    def _answer(self, work: Callable[[], Any]) -> Response:
        try:
            return Response(200, work())
        except Exception as error:
            body = error_body(error)
            return Response(body["error"]["status"], body)

    def _query(self, raw: str, form: str) -> tuple[str, str]:
        if self.persisted and self.persisted.is_id(raw):
            return self.persisted.lookup(raw)
        return raw, form

    def get(self, request: Request) -> Response:
        def work() -> Any:
            headers = {k.lower(): v for k, v in request.headers.items()}
            if QUERY not in headers:
                raise TransportError(f"the header {QUERY} is missing")
            form = headers.get(FORMAT, "json")
            if form not in ("json", "ql"):
                raise TransportError(f"unknown format '{form}'")
            sent = headers[QUERY]
            raw, form = self._query(sent if self.persisted and self.persisted.is_id(sent) else decode_header(sent), form)
            context = self.context(request)
            if self.tokens:
                token = headers.get(TOKEN, "").removeprefix("Bearer ")
                if not token or SIGNATURE not in headers:
                    raise IntegrityError("the request isn't signed")
                context = self.tokens.check_query(token, sent, headers[SIGNATURE])
            query = parse(raw, form)
            if request.entity and self.engine.schema.resolve(query.name) != self.engine.schema.resolve(request.entity):
                raise ValidationError(f"the query is about '{query.name}', the request about '{request.entity}'")
            if request.id is not None and (query.where or query.order or query.page or query.distinct or query.group or query.aggregates or query.having):
                raise ValidationError("a read of one record takes no controls")
            return self.engine.execute(raw, form, context, id=POINT if request.id is None else request.id)

        return self._answer(work)

    def post(self, request: Request) -> Response:
        def work() -> Any:
            body = json.loads(request.body) if isinstance(request.body, str | bytes) else request.body
            if not isinstance(body, Mapping) or "query" not in body:
                raise TransportError("the body has no query")
            if self.tokens:
                raise IntegrityError("queries in bodies are not signed; send them in the header")
            raw, form = body["query"], body.get("format", "json")
            if isinstance(raw, str):
                raw, form = self._query(raw, form)
            return self.engine.execute(raw, form, self.context(request), id=body.get("id", POINT))

        return self._answer(work)

    def register(self, request: Request) -> Response:
        def work() -> Any:
            if self.persisted is None:
                raise TransportError("queries are not persisted here")
            body = request.body if isinstance(request.body, Mapping) else json.loads(request.body)
            raw, form = body["query"], body.get("format", "json")
            raw = raw if isinstance(raw, str) else json.dumps(raw, sort_keys=True)
            parse(raw, form)
            return {"id": self.persisted.register(raw, form)}

        return self._answer(work)
