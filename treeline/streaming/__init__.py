"""Reads that follow changes."""
