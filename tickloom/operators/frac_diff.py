"""Fixed-width fractional differentiation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickloom.config import column_names
from tickloom.functions.columns import col, parse_into_expr
from tickloom.functions.ordering import ordered
from tickloom.operators.blocks import over_blocks

MAX_WEIGHTS = 1_000_000


def frac_diff_weights(d: float, threshold: float) -> list[float]:
    """Weights of the binomial series of (1 - L)^d down to ``threshold`` in size, oldest lag first."""
    if not threshold > 0:
        raise ValueError("threshold must be above 0")
    newest_first = [1.0]
    for k in range(1, MAX_WEIGHTS):
        w = newest_first[-1] * (k - 1 - d) / k
        if abs(w) < threshold:
            return newest_first[::-1]
        newest_first.append(w)
    raise ValueError(f"more than {MAX_WEIGHTS} weights; raise the threshold")


def frac_diff(expr: str | Column, d: float, threshold: float = 1e-3, *, order_by: str | Column | Sequence[str | Column] | None = None, partition_by: Sequence[str | Column] = ()) -> Column:
    """Dot product of the weights with the last n values in the given order; null for the first n - 1 rows of a partition.

    A null value raises (``collect_list`` would skip it and shift the window). A partition shorter than n is all null, NaN passes
    through. ``order_by`` defaults to the configured timestamp; give enough keys to make ties definite.
    """
    keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by or [column_names.timestamp])
    return _differenced(parse_into_expr(expr), d, threshold, ordered(list(partition_by), keys))


def _differenced(expr: Column, d: float, threshold: float, window: WindowSpec) -> Column:
    weights = frac_diff_weights(d, threshold)
    n = len(weights)
    value = expr.cast("double")
    checked = F.when(value.isNull(), F.raise_error(F.lit("frac_diff: null value")).cast("double")).otherwise(value)
    values = F.collect_list(checked).over(window.rowsBetween(-(n - 1), 0))
    products = F.zip_with(values, F.array(*(F.lit(w) for w in weights)), lambda x, w: x * w)
    return F.when(F.size(values) == n, F.aggregate(products, F.lit(0.0), lambda a, x: a + x))


def add_frac_diff(df: DataFrame, column: str, d: float, threshold: float = 1e-3, *, out: str = "frac_diff", time: str | None = None, tie_breakers: Sequence[str] = (), partition_by: Sequence[str] = (), block: int = 100_000) -> DataFrame:
    """The frame with :func:`frac_diff` of a column, computed over blocks: a partition that holds most rows is spread out."""
    time = time or column_names.timestamp
    keys = [time, *tie_breakers]
    n = len(frac_diff_weights(d, threshold))
    whole = lambda w: _differenced(col(column), d, threshold, w)
    return over_blocks(df, whole, out, partition_by=partition_by, order_by=keys, time=time, before=n - 1, block=block)
