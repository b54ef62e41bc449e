"""Signed requests, tokens, and queries known by id."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import secrets
import time
from collections.abc import Callable

from treeline.access import Context
from treeline.errors import IntegrityError, TransportError


def content_hash(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def signature(key: bytes, payload: str) -> str:
    return hmac.new(key, payload.encode(), hashlib.sha256).hexdigest()


class Tokens:
    """Tokens whose whole content is signed; they expire, and can be revoked."""

    def __init__(self, key: bytes, lifetime: float = 900.0, clock: Callable[[], float] = time.time):
        self.key, self.lifetime, self.clock, self.revoked = key, lifetime, clock, {}

    def issue(self, context: Context) -> str:
        told = {"user": context.user, "role": context.role, "tenant": context.tenant, "session": secrets.token_hex(8), "until": self.clock() + self.lifetime}
        body = base64.urlsafe_b64encode(json.dumps(told, sort_keys=True).encode()).decode()
        return f"{body}.{signature(self.key, body)}"

    def _told(self, token: str) -> dict:
        body, _, signed = token.partition(".")
        if not hmac.compare_digest(signed, signature(self.key, body)):
            raise IntegrityError("the token isn't signed by us")
        return json.loads(base64.urlsafe_b64decode(body))

    def read(self, token: str) -> Context:
        told = self._told(token)
        if told["until"] <= self.clock():
            raise IntegrityError("the token has expired")
        if told["session"] in self.revoked:
            raise IntegrityError("the token was revoked")
        return Context(told["user"], told["role"], told["tenant"])

    def revoke(self, token: str) -> None:
        told = self._told(token)
        now = self.clock()
        self.revoked = {k: u for k, u in self.revoked.items() if u > now} | {told["session"]: told["until"]}

    def signing_key(self, token: str) -> bytes:
        """The key with which the holder of a token signs queries."""
        return hmac.new(self.key, f"query:{token}".encode(), hashlib.sha256).digest()

    def check_query(self, token: str, raw: str, signed: str) -> Context:
        context = self.read(token)
        if not hmac.compare_digest(signed, signature(self.signing_key(token), raw)):
            raise IntegrityError("the query was changed or isn't signed")
        return context


class PersistedQueries:
    """Queries by short ids made from their content; an id grows where two contents would share it."""

    PREFIX, DIGITS = "q_", 8

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, str]] = {}

    def register(self, raw: str, form: str = "json") -> str:
        digest = content_hash(f"{form}\0{raw}")
        for size in range(self.DIGITS, len(digest) + 1, 2):
            name = self.PREFIX + digest[:size]
            if self.known.setdefault(name, (raw, form)) == (raw, form):
                return name
        raise TransportError("no id is left for this query")

    def lookup(self, name: str) -> tuple[str, str]:
        if name not in self.known:
            raise TransportError(f"unknown query '{name}'")
        return self.known[name]

    def is_id(self, text: str) -> bool:
        return text.startswith(self.PREFIX) and len(text) > len(self.PREFIX)


def decode_header(raw: str) -> str:
    """A query from its base64 form in a header."""
    try:
        return base64.b64decode(raw, validate=True).decode()
    except ValueError:
        raise TransportError("the query header is no base64 text") from None


def encode_header(raw: str) -> str:
    return base64.b64encode(raw.encode()).decode()
