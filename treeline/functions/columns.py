"""Ready-made functions for computed fields: dicts of Columns to a Column, all inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Compute = Callable[[dict[str, Column]], Column]


def concat(template: str) -> Compute:
    """``{source}`` in the template is replaced by the source's text; null where any source is null."""
    parts = re.split(r"\{([\w.]+)\}", template)

    def compute(have: dict[str, Column]) -> Column:
        return F.concat(*[have[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])

    return compute


def joined(separator: str, *sources: str) -> Compute:
    """The sources that aren't null, with a separator between."""
    return lambda have: F.concat_ws(separator, *[have[s].cast("string") for s in sources])


def when_positive(source: str) -> Compute:
    return lambda have: have[source] > 0


def first_known(*sources: str) -> Compute:
    return lambda have: F.coalesce(*[have[s] for s in sources])


def row_by_row(fn: Callable, kind: str, *sources: str) -> Compute:
    """A Python function over batches of values, for what Columns cannot say; it leaves the JVM (Arrow, pandas)."""
    def compute(have: dict[str, Column]) -> Column:
        @F.pandas_udf(kind)
        def run(*values: pd.Series) -> pd.Series:
            return pd.Series([fn(*v) for v in zip(*values, strict=True)])

        return run(*[have[s] for s in sources])

    return compute
