"""Per-key results that stay even when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.functions.columns import col, require
from tickloom.operators.quantiles import order_statistics
from tickloom.sources.ship import ship

#: Name -> (columns, partial aggregates by suffix, merge of the partials). ``v`` are the argument columns.
_KINDS = {
    "count": (lambda v: {"n": F.count(F.lit(1)) if not v else F.count(v[0])}, lambda p: F.sum(p["n"])),
    "sum": (lambda v: {"s": F.sum(v[0])}, lambda p: F.sum(p["s"])),
    "min": (lambda v: {"m": F.min(v[0])}, lambda p: F.min(p["m"])),
    "max": (lambda v: {"m": F.max(v[0])}, lambda p: F.max(p["m"])),
    "avg": (lambda v: {"s": F.sum(v[0]), "n": F.count(v[0])}, lambda p: F.try_divide(F.sum(p["s"]), F.sum(p["n"]))),
    "first": (lambda v: {"m": F.min(F.when(v[0].isNotNull(), F.struct(*v[1:], v[0].alias("v"))))}, lambda p: F.min(p["m"])["v"]),
    "last": (lambda v: {"m": F.max(F.when(v[0].isNotNull(), F.struct(*v[1:], v[0].alias("v"))))}, lambda p: F.max(p["m"])["v"]),
}
#: Computed over the distinct values of each key, which spread by themselves.
_BY_VALUE = ("distinct", "quantile")
# Operators that keep the order of the rows that they read.
_NARROW = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "Generate", "Range", "SubqueryAlias", "Union", "MapInArrow", "MapInPandas", "DataSourceV2ScanRelation"}


def _share(share: float) -> float:
    if not 1e-4 <= share <= 1:
        raise ValueError("the share that makes a key heavy must lie between 0.0001 and 1: heavy keys are broadcast")
    return share


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """Keys with at least ``share`` of all rows, and their ``n_rows``: at most ``1 / share`` keys, whatever the data, so they may be
    broadcast. One scan of the key columns; counts are combined on the map side and also give the total."""
    counts = df.groupBy(*(col(k) for k in keys)).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where(F.col("n_rows") >= F.lit(_share(share)) * _total(df, keys))


def _total(df: DataFrame, keys: Sequence[str]) -> Column:
    """The number of rows as the sum of the counts per key: wherever a plan also needs these, one exchange serves both."""
    counts = df.groupBy(*(col(k) for k in keys)).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.agg(F.sum("n_rows").alias("__all")).select("__all").scalar()


def _narrow(plan) -> bool:
    children = plan.children()
    return plan.nodeName().split(" ")[0] in _NARROW and all(_narrow(children.apply(i)) for i in range(children.size()))


def salt_number(df: DataFrame) -> Column:
    """A pseudorandom number per row that a task run again gives to the same rows: from the row's place where the frame's rows come
    in the order in which they are stored, so that equal rows get different numbers; behind an exchange, which does not keep the
    order, from the row's values and its partition."""
    if _narrow(df._jdf.queryExecution().optimizedPlan()):
        return F.xxhash64(F.monotonically_increasing_id())
    return F.xxhash64(*(col(c) for c in df.columns), F.spark_partition_id())


def salted(df: DataFrame, keys: Sequence[str], salts: int | Column, heavy_share: float) -> DataFrame:
    """``df`` with ``__salt``: 0, or for rows of heavy keys a pseudorandom number below ``salts``, which may use ``n_rows`` of the
    key. Keys are compared null-safely and must not end in ``__h``."""
    numbered = df.withColumn("__number", salt_number(df))
    hot = heavy_keys(df.select(*(col(k) for k in keys)), keys, heavy_share)
    hot = hot.select(*(col(k).alias(f"{k}__h") for k in keys), F.lit(salts).cast("long").alias("__salts") if isinstance(salts, int) else salts.cast("long").alias("__salts"))
    on = F.lit(True)
    for k in keys:
        on = on & col(k).eqNullSafe(col(f"{k}__h"))
    spread = numbered.join(F.broadcast(hot), on, "left")
    return spread.withColumn("__salt", F.coalesce(F.pmod("__number", F.greatest("__salts", F.lit(1))), F.lit(0))).drop("__number", "__salts", *(f"{k}__h" for k in keys))


def salted_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, tuple], *, salts: int = 32, heavy_share: float = 0.01) -> DataFrame:
    """Aggregates per key in two stages: rows of heavy keys are spread over ``salts`` pseudorandom salts, partial results are
    computed per (key, salt), and the partials are merged by key.

    ``aggregates``: name -> ("count",), ("count", x), ("sum", x), ("min", x), ("max", x), ("avg", x), ("first", x, by...),
    ("last", x, by...), ("distinct", x) or ("quantile", x, q); x is a column name or Column. First and last pass over null x; ties
    of ``by`` go to the smallest / largest x. Distinct counts the different values, nulls aside. A quantile is the smallest value
    that at least the share ``q`` of the values, null and NaN aside, do not exceed, exact, as a double. These two do not need a
    salt: each key's values are told apart first, by an exchange on (key, value) behind a map-side aggregate, and counted after.

    Keys are compared null-safely: null keys are a group. Empty input gives an empty frame; other columns of any name are ignored.
    """
    require(df, *keys)
    names = [f"__k{i}" for i in range(len(keys))]
    inputs, specs, by_value = [], {}, {}
    for out, (kind, *args) in aggregates.items():
        if kind in _BY_VALUE:
            by_value[out] = (kind, *args)
            continue
        if kind not in _KINDS:
            raise ValueError(f"unknown aggregate {kind!r}; there are {sorted([*_KINDS, *_BY_VALUE])}")
        cols = []
        for a in args:
            cols.append(f"__a{len(inputs)}")
            inputs.append((col(a) if isinstance(a, str) else a).alias(cols[-1]))
        specs[out] = (kind, cols)
    named = [col(k).alias(n) for k, n in zip(keys, names)]
    rows = df.select(*named, *inputs)
    partial, merge = [], []
    for out, (kind, cols) in specs.items():
        make, merged = _KINDS[kind]
        parts = make([F.col(c) for c in cols])
        partial += [c.alias(f"__p_{out}_{suffix}") for suffix, c in parts.items()]
        merge.append(merged({suffix: col(f"__p_{out}_{suffix}") for suffix in parts}).alias(out))
    if not partial:
        partial, merge = [F.count(F.lit(1)).alias("__p")], [F.sum("__p").alias("__n")]
    staged = salted(rows, names, salts, heavy_share).groupBy(*names, "__salt").agg(*partial)
    result = staged.groupBy(*names).agg(*merge).drop("__n")
    for i, (out, (kind, x, *rest)) in enumerate(by_value.items()):
        value = col(x) if isinstance(x, str) else x
        own = df.select(*named, value.alias("value")).where("value is not null")
        if kind == "distinct":
            one = own.distinct().groupBy(*names).agg(F.count(F.lit(1)).alias(out))
        else:
            one = _quantile(own, names, *rest).withColumnRenamed("statistic", out)
        on = F.lit(True)
        for n in names:
            on = on & F.col(n).eqNullSafe(F.col(f"{n}_{i}"))
        result = result.join(one.select(*(F.col(n).alias(f"{n}_{i}") for n in names), col(out)), on, "left").drop(*(f"{n}_{i}" for n in names))
        if kind == "distinct":
            result = result.withColumn(out, F.coalesce(col(out), F.lit(0)))
    return result.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), *(col(out) for out in aggregates))


def _quantile(rows: DataFrame, names: Sequence[str], q: float) -> DataFrame:
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    v = F.col("value").cast("double")
    scale = F.signum(v) * F.log1p(F.abs(v)) * 64
    # Null keys pair with null keys in the selection's joins by a marker for null beside each key.
    solid = [F.col(n).isNull().alias(f"{n}_null") for n in names]
    filled = rows.where(~F.isnan(v)).groupBy(*names, v.alias("value"), F.floor(scale).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    text = [F.coalesce(F.col(n).cast("string"), F.lit("")).alias(f"{n}_text") for n in names]
    keyed = filled.select("*", *solid, *text)
    ids = [f"{n}_{x}" for n in names for x in ("null", "text")]
    rank = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(q) - 1e-9))
    found = order_statistics(keyed.select(*ids, "bin", "value", "n"), ids, rank, rank)
    back = found.select("statistic", *(F.when(~F.col(f"{n}_null"), F.col(f"{n}_text")).cast(rows.schema[n].dataType).alias(n) for n in names))
    return back.select(*names, "statistic")


def key_shares(df: DataFrame, key: str, *, least: float = 0.0, **options: object) -> DataFrame:
    """Rows per key and their share of all rows (null keys count in the total but are not reported), at least ``least``. The total
    is that of the counts that tell the heavy keys, so the rows are not read for it again."""
    counts = salted_aggregate(df, [key], {"n_rows": ("count",)}, **options)
    total = _total(df.select(col(key).alias("__k0")), ["__k0"])
    shares = counts.where(col(key).isNotNull()).withColumn("share", F.try_divide(F.col("n_rows").cast("double"), total))
    return shares.where(F.col("share") >= F.lit(least))


def salted_top(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, *, salts: int = 32, heavy_share: float = 0.01) -> DataFrame:
    """The first ``k`` rows of each key by ``order``, with their ``rank`` from 1: first per (key, salt), then per key, so no task
    ranks more than its salt's share of a heavy key. Null keys are a group. ``order`` should be total: ties are broken by chance."""
    require(df, *keys)
    by = [col(o) if isinstance(o, str) else o for o in order]
    spread = salted(df, keys, salts, heavy_share)
    first = spread.withColumn("rank", F.row_number().over(Window.partitionBy(*(col(x) for x in keys), "__salt").orderBy(*by))).where(F.col("rank") <= k)
    return first.drop("__salt").withColumn("rank", F.row_number().over(Window.partitionBy(*(col(x) for x in keys)).orderBy(*by))).where(F.col("rank") <= k)


def salted_apply(df: DataFrame, keys: Sequence[str], partial: Callable[[pd.DataFrame], pd.DataFrame], partial_schema: str, merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, rows_per_group: int = 500_000, heavy_share: float = 0.001) -> DataFrame:
    """A pandas function per key in two stages: ``partial`` gets about ``rows_per_group`` rows of a key at a time, those of a heavy
    key spread by pseudorandom salts as many as its rows need, ``merge`` gets the results of all partials of the key. Both schemas
    must name the keys; what ``partial`` returns of a group should be few rows. Null keys are a group."""
    require(df, *keys)
    ship(df.sparkSession)
    spread = salted(df, keys, F.ceil(F.col("n_rows") / rows_per_group), heavy_share)
    parts = spread.groupBy(*(col(k) for k in keys), "__salt").applyInArrow(_over_arrow(partial, partial_schema), partial_schema)
    return parts.groupBy(*(col(k) for k in keys)).applyInArrow(_over_arrow(merge, schema), schema)


def _over_arrow(run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Callable[[pa.Table], pa.Table]:
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def over(t: pa.Table) -> pa.Table:
        frame = run(t.drop_columns([c for c in t.column_names if c == "__salt"]).to_pandas())
        return pa.Table.from_pandas(frame[out.names], schema=out, preserve_index=False).combine_chunks()

    return over
