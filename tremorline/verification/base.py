"""Shared inputs: the sensor view of ``events`` in Spark and the same steps as SQL."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.operators.indexing import IndexedSeries, index_series
from tremorline.operators.rolling import Frames, expanding
from tremorline.operators.scaling import robust_scale
from tremorline.session import stage

MIN_TIMESHIFT, STEP = 19, 15
# Long series for operators that need them: all events of one type, in time order.
LONG_MIN_TIMESHIFT, LONG_STEP = 299, 400


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as (id, time, x, y): one series per user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("int").alias("id"),
        F.col("ts").alias("time"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
    )


def long_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with one long series per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("id"),
        F.col("ts").alias("time"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
    )


_prepared: dict[tuple[str, str, str], IndexedSeries] = {}


def prepared(spark: SparkSession, sf_dir: str, view: Callable = sensor) -> IndexedSeries:
    """The indexed, scaled sensor table, staged once per session and input: the table the
    preprocessing step leaves for everything after it."""
    key = (spark.sparkContext.applicationId, sf_dir, view.__name__)
    if key not in _prepared:
        scaled = robust_scale(index_series(view(spark, sf_dir)))
        _prepared[key] = scaled.with_rows(stage(scaled.rows, "scaled"))
    return _prepared[key]


def windows(spark: SparkSession, sf_dir: str) -> Frames:
    return expanding(prepared(spark, sf_dir), MIN_TIMESHIFT, STEP)


def long_windows(spark: SparkSession, sf_dir: str) -> Frames:
    return expanding(prepared(spark, sf_dir, long_sensor), LONG_MIN_TIMESHIFT, LONG_STEP)


# Six decimals. Values that lie on a rounding tie, such as multiples of 1/128, differ between
# engines by the noise of a sum; a hundred-thousandth of the last place decides such ties
# upwards in both. Each result is the true value to within half a unit of that place.
_TIES_UP = 1e-5


def rounded(value: Column) -> Column:
    return F.when(F.abs(value) < 5e-7, 0.0).otherwise(F.rint(value * 1e6 + _TIES_UP) / 1e6)


def r6(expression: str) -> str:
    tie = f"CAST({_TIES_UP} AS DOUBLE)"
    return f"CASE WHEN abs({expression}) < 5e-7 THEN 0.0 ELSE round_even(({expression}) * 1e6 + {tie}, 0) / 1e6 END"


SENSOR = """sensor AS (
    SELECT CAST(user_id AS INTEGER) AS id, ts AS time, value AS x,
           CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y
    FROM events)"""
LONG_SENSOR = SENSOR.replace("CAST(user_id AS INTEGER) AS id", "event_type AS id")

SCALED = """quartiles AS (
    SELECT id, quantile_cont(x, [0.25, 0.5, 0.75]) AS qx, quantile_cont(y, [0.25, 0.5, 0.75]) AS qy
    FROM sensor GROUP BY id),
scaled AS (
    SELECT s.id, s.time,
           (x - qx[2]) / (CASE WHEN qx[3] - qx[1] < 1e-14 THEN 1 ELSE qx[3] - qx[1] END) AS x,
           (y - qy[2]) / (CASE WHEN qy[3] - qy[1] < 1e-14 THEN 1 ELSE qy[3] - qy[1] END) AS y,
           row_number() OVER (PARTITION BY s.id ORDER BY s.time) - 1 AS pos,
           count(*) OVER (PARTITION BY s.id) AS n_rows
    FROM sensor s JOIN quartiles q ON s.id = q.id)"""


def windows_sql(min_timeshift: int = MIN_TIMESHIFT, step: int = STEP) -> str:
    return f"""windows AS (
    SELECT id, pos + 1 AS e, time AS time_end FROM scaled
    WHERE pos + 1 > {min_timeshift} AND ((SELECT max(n_rows) FROM scaled) - (pos + 1)) % {step} = 0)"""


ROLLED = """long AS (
    SELECT id, time, pos, 'x' AS kind, x AS v FROM scaled
    UNION ALL SELECT id, time, pos, 'y' AS kind, y AS v FROM scaled),
r AS (
    SELECT w.id, w.e, l.kind, l.pos, l.time, l.v
    FROM windows w JOIN long l ON l.id = w.id AND l.pos < w.e)"""

STATS = """st AS (
    SELECT id, e, kind, count(*) AS n, avg(v) AS mu, stddev_pop(v) AS sd, var_pop(v) AS var, min(v) AS lo,
           max(v) AS hi, median(v) AS med, sum(v * v) AS energy, sum(abs(v)) AS mass
    FROM r GROUP BY id, e, kind),
r2 AS (SELECT r.*, n, mu, sd, var, lo, hi, med, energy, mass FROM r JOIN st USING (id, e, kind))"""


def prelude(view: str = SENSOR, min_timeshift: int = MIN_TIMESHIFT, step: int = STEP) -> str:
    """WITH clause up to the rows of every window (r) and those with window statistics (r2)."""
    return f"WITH {view},\n{SCALED},\n{windows_sql(min_timeshift, step)},\n{ROLLED},\n{STATS}"
