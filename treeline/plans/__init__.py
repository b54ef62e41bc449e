"""Queries: their wire forms, their analysis against a schema, cursors."""
