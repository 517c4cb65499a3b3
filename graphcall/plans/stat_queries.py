"""Queries of statistics, alignment and windows over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcall.operators import robust
from graphcall.plans.registry import Views, query
from graphcall.streaming import support


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("SELECT event_type, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance, count(value) AS n FROM events GROUP BY 1")
def naive_gaussian(v: Views) -> DataFrame:
    return _rounded(robust.naive_fit(v.table("events"), ["event_type"], "value"), "mean", "variance")


@query("SELECT event_type, round(median(value), 6) AS median, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance, min(value) AS least FROM events GROUP BY 1")
def basic_stats(v: Views) -> DataFrame:
    return _rounded(robust.basic(v.table("events"), ["event_type"], "value"), "median", "mean", "variance")


@query("SELECT l_returnflag, l_orderkey, l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r FROM lineitem) WHERE r = 1")
def argmin_all(v: Views) -> DataFrame:
    return robust.argmin_all(v.table("lineitem"), ["l_returnflag"], "l_quantity", "l_orderkey")


@query("""WITH r AS (SELECT event_type, value AS x, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i FROM events),
h AS (SELECT *, n // 2 + 1 AS h FROM r),
w AS (SELECT a.event_type, a.i, avg(b.x) AS m, var_pop(b.x) AS v FROM h a JOIN h b ON b.event_type = a.event_type AND b.i > a.i - a.h AND b.i <= a.i WHERE a.i >= a.h GROUP BY 1, 2),
f AS (SELECT event_type, arg_min(m, v) AS raw_mean, min(v) AS raw_variance FROM w GROUP BY 1),
n AS (SELECT e.event_type, e.value AS x FROM events e JOIN f USING (event_type) WHERE (e.value - raw_mean) * (e.value - raw_mean) <= 5.02388618731489 * 6.9646 * greatest(raw_variance, 1e-300))
SELECT f.event_type, round(any_value(raw_mean), 4) AS raw_mean, round(any_value(raw_variance), 4) AS raw_variance, round(avg(n.x), 4) AS mean, round(var_pop(n.x), 4) AS variance, count(*) AS support FROM f JOIN n ON n.event_type = f.event_type GROUP BY f.event_type""")
def mcd_gaussian(v: Views) -> DataFrame:
    rows = v.table("events").select("event_id", "event_type", "value")
    fit = robust.mcd_fit(rows, ["event_type"], "value")
    return fit.select("event_type", *[F.round(c, 4).alias(c) for c in ("raw_mean", "raw_variance", "mean", "variance")], "support")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(v: Views) -> DataFrame:
    return support.windowed_counts(v.table("events")).withColumn("total", F.round("total", 4))
