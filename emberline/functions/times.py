"""Instants as numbers, for timestamps with or without a zone (those count in the session's zone; set UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(c) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def seconds(c) -> Column:
    return F.unix_seconds((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
