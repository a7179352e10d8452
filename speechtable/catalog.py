"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import conversation, files, long_sessions, signals, stream_sessions, streams

FLAGSHIP = "a9_export_vtt"
_REGISTRIES = (conversation.registry, signals.registry, long_sessions.registry, streams.registry, stream_sessions.registry, files.registry)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for r in _REGISTRIES for k, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in _REGISTRIES for k, s in r.sql.items()}
