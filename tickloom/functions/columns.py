"""Column coercion and plan-time checks."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col(quoted(name))


def parse_into_expr(expr: Any, *, str_as_lit: bool = False, list_as_lit: bool = True, dtype: str | T.DataType | None = None) -> Column:
    """A Column from a Column (returned as is), a name, a list or any other literal; ``dtype`` is applied to literals only.

    With ``list_as_lit=False`` a list stands for one value per element, exploded to rows.
    """
    if isinstance(expr, Column):
        return expr
    if isinstance(expr, str) and not str_as_lit:
        return F.col(expr)
    if isinstance(expr, (list, tuple)):
        array = F.array(*(F.lit(x) for x in expr))
        if dtype is not None:
            array = array.cast(T.ArrayType(T._parse_datatype_string(dtype) if isinstance(dtype, str) else dtype))
        return array if list_as_lit else F.explode(array)
    literal = F.lit(expr)
    return literal if dtype is None else literal.cast(dtype)


def require(df: DataFrame, *names: str) -> None:
    """ValueError for columns that the frame lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {missing}; the frame has {df.columns}")


def require_type(df: DataFrame, name: str, kinds: tuple[type, ...], what: str) -> None:
    if not isinstance(df.schema[name].dataType, kinds):
        raise ValueError(f"column {name!r} must be {what}, not {df.schema[name].dataType.simpleString()}")


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores appended until no column has it (Spark compares names without case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def tidy_symbol(name: str | Column) -> Column:
    """Upper case without blanks around; a blank-only symbol is null."""
    c = F.upper(F.trim(col(name) if isinstance(name, str) else name))
    return F.when(c != "", c)
