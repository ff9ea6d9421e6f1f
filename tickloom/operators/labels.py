"""Labels from the return over a fixed number of observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickloom.config import column_names
from tickloom.functions.columns import col, fresh, parse_into_expr
from tickloom.functions.ordering import ordered
from tickloom.operators.blocks import over_blocks


def fixed_time_return(prices: str | Column, window: int, offset: int = 1, symbol: str | Column | None = None, *, order_by: str | Column | Sequence[str | Column] | None = None) -> Column:
    """Return from the price ``offset`` rows ahead to that ``offset + window`` rows ahead; null where either is missing or the
    first is 0. Rows follow each other by ``order_by``, the configured timestamp by default, within ``symbol`` if given."""
    keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by or [column_names.timestamp])
    return _ahead(parse_into_expr(prices), window, offset, ordered([] if symbol is None else [symbol], keys))


def _ahead(price: Column, window: int, offset: int, frame: WindowSpec) -> Column:
    return F.try_divide(F.lead(price, offset + window).over(frame), F.lead(price, offset).over(frame)) - F.lit(1.0)


def classify_by_threshold(values: Column, threshold: float | str | Column | None) -> Column:
    """1 above the threshold's size, -1 below its negative, 0 between (edges included); without threshold the sign.
    Null in value or threshold gives null; a NaN return is 1 with a threshold and null without."""
    if threshold is None:
        return F.when(~F.isnan(values), F.signum(values)).cast("int")
    size = F.abs(parse_into_expr(threshold))
    return F.when(values > size, 1).when(values < -size, -1).when(values.between(-size, size), 0).cast("int")


def fixed_time_return_classification(prices: str | Column, window: int, threshold: float | str | Column | None = None, offset: int = 1, symbol: str | Column | None = None, *, order_by: str | Column | Sequence[str | Column] | None = None) -> Column:
    """Label in {1, 0, -1} of :func:`fixed_time_return`."""
    return classify_by_threshold(fixed_time_return(prices, window, offset, symbol, order_by=order_by), threshold)


def add_fixed_time_return(df: DataFrame, prices: str, window: int, offset: int = 1, *, symbol: str | None = None, out: str = "fixed_time_return", time: str | None = None, tie_breakers: Sequence[str] = (), block: int = 100_000) -> DataFrame:
    """The frame with :func:`fixed_time_return`, computed over blocks: a symbol that holds most rows is spread out. Labels:
    :func:`add_fixed_time_return_classification`."""
    time = time or column_names.timestamp
    reach = [offset, offset + window, 0]
    return over_blocks(df, lambda w: _ahead(col(prices), window, offset, w), out, partition_by=[] if symbol is None else [symbol], order_by=[time, *tie_breakers], time=time, before=max(0, -min(reach)), after=max(reach), block=block)


def add_fixed_time_return_classification(df: DataFrame, prices: str, window: int, threshold: float | str | Column | None = None, offset: int = 1, *, symbol: str | None = None, out: str = "label", time: str | None = None, tie_breakers: Sequence[str] = (), block: int = 100_000) -> DataFrame:
    """The frame with :func:`fixed_time_return_classification`, computed over blocks: a symbol that holds most rows, or all rows where
    there is no symbol, are spread out. A column threshold is a column of the frame."""
    ret = fresh("__return", df.columns)
    done = add_fixed_time_return(df, prices, window, offset, symbol=symbol, out=ret, time=time, tie_breakers=tie_breakers, block=block)
    return done.withColumn(out, classify_by_threshold(F.col(ret), threshold)).drop(ret)
