"""Nested-read analytics on Spark: declarative selections compiled to lazy DataFrame plans."""
