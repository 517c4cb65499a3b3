"""Running values over keys of any size: rows are dealt by ranges of (keys, order), scanned within a slice, and one row a slice carries what comes before.

A window by keys alone gives each key to one task. Here a key that holds most rows is many slices, and only
the carried table, at most a few rows a slice, has windows by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphcall.operators.storage import cut


def sliced(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_slice``, ascending by keys and order; written once, so that a slice stays what it is when a task is run again.

    Rows that agree on keys and order lie in one slice.
    """
    return cut(rows.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))


def running(
    rows: DataFrame, keys: list[str], order: list[str], *, sums: dict[str, Column] | None = None, max_before: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, leads: dict[str, Column] | None = None,
) -> DataFrame:
    """Rows of :func:`sliced` with new columns: sums up to a row, the maximum before it, the value of the row before it and of the one behind it.

    ``order`` must tell the rows of a key apart. Null keys are keys like others.
    """
    sums, max_before, lags, leads = sums or {}, max_before or {}, lags or {}, leads or {}
    at = Window.partitionBy("_slice", *keys).orderBy(*order)
    before, upto = at.rowsBetween(Window.unboundedPreceding, -1), at.rowsBetween(Window.unboundedPreceding, 0)
    named = {**sums, **max_before, **lags, **leads}
    rows = rows.withColumns({f"_v_{n}": c for n, c in named.items()})
    place = F.struct(*order)
    parts = [F.sum(f"_v_{n}").alias(n) for n in sums] + [F.max(f"_v_{n}").alias(n) for n in max_before]
    parts += [F.max_by(F.struct(f"_v_{n}"), place).alias(n) for n in lags] + [F.min_by(F.struct(f"_v_{n}"), place).alias(n) for n in leads]
    over = Window.partitionBy(*keys).orderBy("_slice")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = {n: F.sum(n).over(earlier) for n in sums} | {n: F.max(n).over(earlier) for n in max_before}
    carried |= {n: F.lag(n).over(over)[f"_v_{n}"] for n in lags} | {n: F.lead(n).over(over)[f"_v_{n}"] for n in leads}
    carry = rows.groupBy("_slice", *keys).agg(*parts)
    carry = carry.select(F.col("_slice").alias("_s"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[c.alias(f"_c_{n}") for n, c in carried.items()])
    local = {n: F.sum(f"_v_{n}").over(upto) for n in sums} | {n: F.max(f"_v_{n}").over(before) for n in max_before}
    local |= {n: F.lag(f"_v_{n}").over(at) for n in lags} | {n: F.lead(f"_v_{n}").over(at) for n in leads}
    own = rows.withColumns({f"_l_{n}": c for n, c in local.items()} | {"_first": F.row_number().over(at) == 1, "_last": F.lead(F.lit(1)).over(at).isNull()})
    met = own.join(carry, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_slice") == F.col("_s")))
    out = {n: F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) for n in sums} | {n: F.greatest(f"_l_{n}", f"_c_{n}") for n in max_before}
    out |= {n: F.when(F.col("_first"), F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}")) for n in lags} | {n: F.when(F.col("_last"), F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}")) for n in leads}
    made = [f"_{x}_{n}" for x in "vlc" for n in named] + [f"_k_{k}" for k in keys] + ["_s", "_first", "_last"]
    return met.withColumns(out).drop(*made)
