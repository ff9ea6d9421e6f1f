"""Explicit row order. Spark frames have none, so every ordered operator names its keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql.window import WindowSpec

from tickloom.functions.columns import col


def ordered(partition: Sequence[str | Column], order: Sequence[str | Column]) -> WindowSpec:
    spec = Window.partitionBy(*(col(p) if isinstance(p, str) else p for p in partition))
    return spec.orderBy(*(col(o) if isinstance(o, str) else o for o in order))
