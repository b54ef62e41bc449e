"""The handlers as a WSGI application, and a client for it.

Routes below the base path: GET /entity and /entity/id (query in a header), POST / (query in the body), POST /queries
(registers a query), PUT /files (stores a file).  Any WSGI server or framework mounts the application.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict
from typing import Any

from treeline.access import Context
from treeline.builder import Read
from treeline.engine import POINT
from treeline.errors import TransportError, TreelineError, ValidationError, error_body
from treeline.integrity import content_hash, encode_header, signature
from treeline.sources.uploads import Uploads
from treeline.transport import FORMAT, QUERY, SIGNATURE, TOKEN, Handlers, Request, Response

REASONS = {200: "OK", 400: "Bad Request", 401: "Unauthorized", 404: "Not Found", 405: "Method Not Allowed", 413: "Content Too Large", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway"}
HASH = "x-content-hash"
#: Bytes of the largest body that is read.
MOST_BODY = 32 << 20


class Application:
    """A WSGI application over handlers and, maybe, uploads."""

    def __init__(self, handlers: Handlers, uploads: Uploads | None = None, base: str = "", most: int = MOST_BODY):
        self.handlers, self.uploads, self.base, self.most = handlers, uploads, base.rstrip("/"), most

    def __call__(self, environ: Mapping, start: Callable) -> Iterable[bytes]:
        try:
            got = self.answer(environ)
        except Exception as error:
            body = error_body(error)
            got = Response(body["error"]["status"], body)
        data = got.text().encode()
        start(f"{got.status} {REASONS.get(got.status, 'Error')}", [("Content-Type", "application/json"), ("Content-Length", str(len(data)))])
        return [data]

    def answer(self, environ: Mapping) -> Response:
        path, method = environ.get("PATH_INFO", ""), environ["REQUEST_METHOD"]
        if self.base and path != self.base and not path.startswith(self.base + "/"):
            return _refused(404, "no such path")
        parts = [p for p in path[len(self.base) :].split("/") if p]
        headers = {k[5:].replace("_", "-").lower(): v for k, v in environ.items() if k.startswith("HTTP_")}
        if method == "GET" and len(parts) in (1, 2):
            return self.handlers.get(Request(headers, *parts))
        if method == "POST" and not parts:
            return self.handlers.post(Request(headers, body=self._json(environ)))
        if method == "POST" and parts == ["queries"]:
            return self.handlers.register(Request(headers, body=self._json(environ)))
        if method == "PUT" and parts == ["files"] and self.uploads:
            return self._stored(environ, headers)
        return _refused(405 if len(parts) < 3 else 404, "no such route")

    def _body(self, environ: Mapping) -> bytes:
        size = int(environ.get("CONTENT_LENGTH") or 0)
        if size > self.most:
            raise ValidationError(f"the body has {size} bytes, more than {self.most}")
        return environ["wsgi.input"].read(size)

    def _json(self, environ: Mapping) -> Any:
        try:
            return json.loads(self._body(environ) or b"null")
        except ValueError:
            raise TransportError("the body is no JSON") from None

    def _stored(self, environ: Mapping, headers: Mapping) -> Response:
        request = Request(headers)
        if self.handlers.tokens:
            context = self.handlers.tokens.read(headers.get(TOKEN, "").removeprefix("Bearer "))
        else:
            context: Context = self.handlers.context(request)
        told = dict(urllib.parse.parse_qsl(environ.get("QUERY_STRING", "")))
        kind = environ.get("CONTENT_TYPE") or "application/octet-stream"
        got = self.uploads.accept(self._body(environ), kind, told.get("name", ""), headers.get(HASH), told.get("folder", ""), context)
        return Response(200, asdict(got))


def _refused(status: int, message: str) -> Response:
    return Response(status, {"error": {"code": "TransportError", "message": message, "status": status}})


class ClientError(TreelineError):
    """What the server answered instead of a result."""

    def __init__(self, status: int, code: str, message: str):
        super().__init__(message)
        self.status, self.code = status, code


#: Sends method, path, headers and body; returns status and body.
Send = Callable[[str, str, Mapping[str, str], bytes | None], tuple[int, bytes]]


def http(url: str, timeout: float = 60.0) -> Send:
    """Sends by HTTP to a base address."""

    def send(method: str, path: str, headers: Mapping[str, str], body: bytes | None) -> tuple[int, bytes]:
        request = urllib.request.Request(url.rstrip("/") + path, body, dict(headers), method=method)  # noqa: S310
        try:
            with urllib.request.urlopen(request, timeout=timeout) as got:  # noqa: S310
                return got.status, got.read()
        except urllib.error.HTTPError as error:
            return error.code, error.read()

    return send


class Client:
    """Reads and uploads over ``send``.

    ``credentials``: gives a token and the key that signs queries with it; asked again, once, where the server refuses
    them.  ``register``: queries are registered when first sent, and go by their ids from then on.
    """

    def __init__(self, send: Send, credentials: Callable[[], tuple[str, bytes]] | None = None, register: bool = False):
        self.send, self.credentials, self.register_all = send, credentials, register
        self.held: tuple[str, bytes] | None = None
        self.known: dict[tuple[str, str], str] = {}

    def _call(self, method: str, path: str, headers: dict[str, str], body: bytes | None = None, signed: str | None = None) -> Any:
        for attempt in (0, 1):
            more = {}
            if self.credentials:
                self.held = self.held or self.credentials()
                more = {TOKEN: f"Bearer {self.held[0]}"} | ({SIGNATURE: signature(self.held[1], signed)} if signed is not None else {})
            status, raw = self.send(method, path, headers | more, body)
            if status == 401 and self.credentials and not attempt:
                self.held = None
                continue
            break
        told = json.loads(raw) if raw else None
        if status != 200:
            error = told.get("error", {}) if isinstance(told, Mapping) else {}
            raise ClientError(status, error.get("code", "TransportError"), error.get("message", "the server refused"))
        return told

    @staticmethod
    def _told(query: Read | Mapping | str) -> tuple[str, str]:
        """The text and the form of a query."""
        if isinstance(query, str):
            return query, "json" if query.lstrip()[:2].replace(" ", "").startswith('{"') else "ql"
        return json.dumps(query.json() if isinstance(query, Read) else query, sort_keys=True), "json"

    def register(self, query: Read | Mapping | str) -> str:
        """The id under which the server knows the query from now on."""
        raw, form = self._told(query)
        body = json.dumps({"query": raw, "format": form}).encode()
        self.known[raw, form] = got = self._call("POST", "/queries", {"content-type": "application/json"}, body)["id"]
        return got

    def read(self, entity: str, query: Read | Mapping | str, id: Any = None) -> Any:
        """A record, or a page of records."""
        path = "/" + "/".join(urllib.parse.quote(str(p), safe="") for p in ([entity] if id is None else [entity, id]))
        raw, form = self._told(query)
        if self.register_all:
            name = self.known.get((raw, form)) or self.register(query)
            try:
                return self._call("GET", path, {QUERY: name}, signed=name)
            except ClientError as error:
                if error.code != "TransportError":
                    raise
                name = self.register(query)  # the server may have forgotten it
                return self._call("GET", path, {QUERY: name}, signed=name)
        sent = encode_header(raw)
        return self._call("GET", path, {QUERY: sent, FORMAT: form}, signed=sent)

    def pages(self, entity: str, query: Read) -> Iterable[Any]:
        """The items of all pages, read one page after the other."""
        first = query.query.page.first if query.query.page else None
        while True:
            got = self.read(entity, query)
            yield from got["items"]
            if not got["pageInfo"]["hasNextPage"]:
                return
            query.page(first, got["pageInfo"]["endCursor"])

    def post(self, query: Read | Mapping | str, id: Any = POINT) -> Any:
        """The same with the query in the body, for long ones."""
        raw, form = self._told(query)
        body = {"query": raw, "format": form} | ({} if id is POINT else {"id": id})
        return self._call("POST", "/", {"content-type": "application/json"}, json.dumps(body).encode())

    def upload(self, data: bytes, type: str, name: str = "", folder: str = "") -> dict:
        """Stores a file, whose content hash goes along; returns its key, size, type and hash."""
        path = "/files?" + urllib.parse.urlencode({"name": name, "folder": folder})
        return self._call("PUT", path, {"content-type": type, HASH: content_hash(data)}, data)
