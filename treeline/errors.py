"""What can go wrong, by whose fault."""

from __future__ import annotations


class TreelineError(Exception):
    """Any error of the engine; ``status`` is the HTTP status a transport would send."""

    status = 500


class ParseError(TreelineError):
    status = 400


class ValidationError(TreelineError):
    status = 400


class SchemaError(TreelineError):
    """The server's schema is at fault, not the query."""


class ResolverError(TreelineError):
    status = 502


class TransportError(TreelineError):
    status = 400


class IntegrityError(TreelineError):
    status = 401


class RateLimitError(TreelineError):
    status = 429


def error_body(error: Exception) -> dict:
    """What a client is told: the kind and message of an engine error, nothing of any other."""
    if isinstance(error, TreelineError):
        return {"error": {"code": type(error).__name__, "message": str(error), "status": error.status}}
    return {"error": {"code": "InternalError", "message": "internal error", "status": 500}}
