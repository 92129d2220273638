"""Small expression helpers."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def by_name(build: Callable[..., Column]) -> Callable[..., Column]:
    """Let a long expression be asked for by column name, and built once per session and name."""
    built: dict[tuple, Column] = {}

    @wraps(build)
    def get(c: Column | str, *args, **kwargs) -> Column:
        if isinstance(c, Column):
            return build(c, *args, **kwargs)
        session = SparkSession.getActiveSession()
        key = (session.sparkContext.applicationId if session else None, c, args, tuple(sorted(kwargs.items())))
        if key not in built:
            built[key] = build(F.col(c), *args, **kwargs)
        return built[key]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def empty_array(of: str) -> Column:
    return F.expr(f"CAST(array() AS ARRAY<{of}>)")
