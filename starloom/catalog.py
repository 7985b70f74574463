"""Named queries of the engine with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import candidates, cubes, evidence, gridding, matching, observing, photometry, spectral, textual, tracks, two_epoch

_MODULES = (matching, gridding, spectral, cubes, evidence, candidates, observing, tracks, textual, photometry, two_epoch)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
