"""Registry of queries over the test tables and of their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bookkeeping, columns, frames, images, kernels, scalars, series, streams, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (frames, series, scalars, columns, bookkeeping, kernels, texts, streams, images):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
