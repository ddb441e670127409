"""Queries on scanning, filling, scaling, rolling, sampling and change points."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.functions.scalars import assemble_time, micros, rul_class, rul_class5
from tremorline.operators.change_points import label_segments, merge_series, segment_merged, segment_series
from tremorline.operators.filling import fill_gaps
from tremorline.operators.indexing import index_series
from tremorline.operators.rolling import add_rul, expanding, rolled_table, trailing, window_labels
from tremorline.operators.sampling import every_nth, every_nth_rolled
from tremorline.operators.scaling import minmax_scale, normalize_time, robust_scale
from tremorline.session import stage_root
from tremorline.sources.acceleration import scan_acceleration, with_time
from tremorline.sources.splits import scan_splits
from tremorline.sources.tables import read_stage, write_stage
from tremorline.verification.base import (
    LONG_SENSOR,
    MIN_TIMESHIFT,
    SCALED,
    SENSOR,
    STEP,
    Query,
    long_sensor,
    prelude,
    prepared,
    r6,
    rounded,
    sensor,
    table,
    windows,
    windows_sql,
)

c = F.col


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw sensor rows to labelled windows with their minimal features."""
    from tremorline.features.registry import extract_features, matrix_columns, minimal, to_matrix

    frames = expanding(robust_scale(index_series(sensor(spark, sf_dir))), MIN_TIMESHIFT, STEP)
    labels = window_labels(frames)
    spec = {"x": minimal(), "y": minimal()}
    names = matrix_columns(spec)
    matrix = to_matrix(extract_features(frames, spec), ["id", "end"], names)
    return labels.join(matrix, ["id", "end"]).select(
        c("id").alias("bearing_id"),
        "time_end",
        c("end").alias("n_rows"),
        rounded(c("RUL_rolled")).alias("RUL_rolled"),
        "RUL_rolled_class",
        *[rounded(c(n)).alias(n) for n in names],
    )


LIFE = """span AS (
    SELECT w.id, min(s.time) AS t_min, max(w.time_end) AS t_max
    FROM windows w JOIN scaled s ON s.id = w.id GROUP BY w.id),
labels AS (
    SELECT w.id, w.e, w.time_end,
           (epoch_us(t_max) - epoch_us(time_end)) / nullif(epoch_us(t_max) - epoch_us(t_min), 0)::DOUBLE AS rul
    FROM windows w JOIN span USING (id)),
classed AS (
    SELECT *, CASE WHEN rul < 0.25 THEN 3 WHEN rul < 0.5 THEN 2 WHEN rul IS NOT NULL THEN 1 END AS rul_class
    FROM labels)"""


def _flagship_sql() -> str:
    minimal = {
        "sum_values": "sum(v)", "median": "median(v)", "mean": "avg(v)", "length": "count(*)",
        "standard_deviation": "stddev_pop(v)", "variance": "var_pop(v)", "root_mean_square": "sqrt(avg(v * v))",
        "maximum": "max(v)", "absolute_maximum": "max(abs(v))", "minimum": "min(v)",
    }
    parts, columns = [], []
    for kind in ("x", "y"):
        inner = ", ".join(f"CAST({sql} AS DOUBLE) AS {kind}__{name}" for name, sql in minimal.items())
        parts.append(f"{kind}f AS (SELECT id, e, {inner} FROM r WHERE kind = '{kind}' GROUP BY id, e)")
        columns += [f"{r6(f'{kind}__{name}')} AS {kind}__{name}" for name in minimal]
    return (
        prelude()
        + f",\n{LIFE},\n{parts[0]},\n{parts[1]}\nSELECT id AS bearing_id, time_end, e AS n_rows, {r6('rul')} AS RUL_rolled, "
        + f"rul_class AS RUL_rolled_class, {', '.join(columns)} FROM classed JOIN xf USING (id, e) JOIN yf USING (id, e)"
    )


def _sensor_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor(spark, sf_dir)


def _index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index_series(sensor(spark, sf_dir)).rows
    return rows.select("id", "time", "pos", "n_rows", rounded(c("center_x")).alias("center_x"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    """Writes ``events`` as snapshot files acc_*.csv: 4 groups of users per week, ';' in even
    groups and ',' in odd ones. Returns the folder and its experiments in order."""
    ts = c("ts")
    sep = F.when(c("user_id") % 2 == 0, ";").otherwise(",")
    seconds = F.extract(F.lit("SECOND"), ts)
    whole = F.floor(seconds)
    fields = [F.hour(ts), F.minute(ts), whole, (seconds - whole) * 1000, c("value"), F.get_json_object("props", "$.k")]
    line = fields[0].cast("string")
    for field in fields[1:]:
        line = F.concat(line, sep, field.cast("string"))
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("g"), (c("user_id") % 4).cast("string"), F.lit("w"), F.weekofyear("ts").cast("string")).alias("folder"),
        "ts",
        "event_id",
        line.alias("line"),
    )
    root = f"{stage_root(spark)}/snapshots-{uuid.uuid4().hex}"
    ordered = events.repartition("folder").sortWithinPartitions("folder", "ts", "event_id")
    ordered.select("folder", "line").write.partitionBy("folder").text(root)
    # one name per week and group: a list of experiments, as the reader of a data set gives it
    folders = [f"folder={r['folder']}" for r in events.select("folder").distinct().orderBy("folder").collect()]
    # Spark names its files part-*; the recorder's begin with acc
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in folders:
        for k, status in enumerate(files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}/part-*"))):
            files.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}/acc_{k:05d}.csv"))
    return root, folders


def _csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots written from ``events`` and scanned back."""
    root, folders = _snapshots(spark, sf_dir)
    return with_time(scan_acceleration(spark, root, folders))


def _scan_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same snapshots as splits: groups 0 and 1 are the source, 2 and 3 the target."""
    root, folders = _snapshots(spark, sf_dir)
    of = {"s_train": ("g0", "g1"), "t_train": ("g2",), "t_test": ("g3",)}
    splits = {
        split: ("source" if split == "s_train" else "target", tuple(f for f in folders if f.removeprefix("folder=")[:2] in groups))
        for split, groups in of.items()
    }
    return scan_splits(spark, root, splits)


CSV_SQL = """WITH lines AS (
    SELECT 'g' || (user_id % 4) || 'w' || weekofyear(ts) AS folder, ts, value,
           CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, event_id
    FROM events),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY folder ORDER BY ts, event_id) - 1 AS line,
           dense_rank() OVER (ORDER BY folder) AS id
    FROM lines)
SELECT CAST(id AS INTEGER) AS id, TIMESTAMP '2023-01-01' + (ts - date_trunc('day', ts)) AS time, value AS x, k AS y
FROM numbered WHERE line % 2 = 0"""


SPLITS_SQL = """WITH lines AS (
    SELECT 'g' || (user_id % 4) || 'w' || weekofyear(ts) AS folder, ts, value,
           CASE user_id % 4 WHEN 2 THEN 't_train' WHEN 3 THEN 't_test' ELSE 's_train' END AS split,
           CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, event_id
    FROM events),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY folder ORDER BY ts, event_id) - 1 AS line,
           dense_rank() OVER (PARTITION BY split ORDER BY folder) AS id
    FROM lines)
SELECT split, CAST(id AS INTEGER) AS id, TIMESTAMP '2023-01-01' + (ts - date_trunc('day', ts)) AS time, value AS x, k AS y
FROM numbered WHERE line % 2 = 0"""


def _time_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds beyond 999 carry into the seconds."""
    ts = c("ts")
    parts = [F.hour(ts), F.minute(ts), F.second(ts), c("event_id") % 70_000]
    return table(spark, sf_dir, "events").select("event_id", assemble_time(*parts).alias("time"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    hole = F.when(c("event_id") % 7 != 0, c("value"))
    return table(spark, sf_dir, "events").select(
        c("user_id").cast("int").alias("id"), c("ts").alias("time"), hole.alias("x"), "event_id"
    )


def _ffill(scope: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fill_gaps(_gaps(spark, sf_dir), values=("x",), scope=scope)

    return run


def _ffill_sql(partition: str) -> str:
    return f"""WITH gaps AS (
    SELECT CAST(user_id AS INTEGER) AS id, ts AS time, CASE WHEN event_id % 7 <> 0 THEN value END AS x, event_id FROM events)
SELECT id, time, last_value(x IGNORE NULLS) OVER ({partition} ORDER BY time
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x, event_id FROM gaps"""


def _scaled(scale):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scale(index_series(sensor(spark, sf_dir))).rows
        return rows.select("id", "time", rounded(c("x")).alias("x"), rounded(c("y")).alias("y"))

    return run


def _time_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = normalize_time(sensor(spark, sf_dir), ("id",))
    return scaled.select("id", "time", rounded(c("norm_axis")).alias("norm_axis"))


def _roll_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = windows(spark, sf_dir)
    rolled = rolled_table(frames, window_labels(frames))
    return rolled.select(
        c("id").alias("bearing_id"),
        "time_end",
        "time",
        rounded(c("x")).alias("x"),
        rounded(c("y")).alias("y"),
        rounded(c("RUL_rolled")).alias("RUL_rolled"),
        "RUL_rolled_class",
    )


def _window_labels(**options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = window_labels(windows(spark, sf_dir), **options)
        return labels.select(
            "id", "time_end", c("end").alias("n_rows"), rounded(c("RUL_rolled")).alias("RUL_rolled"), "RUL_rolled_class"
        )

    return run


def _labels_sql(life: str = LIFE) -> str:
    return (
        f"WITH {SENSOR},\n{SCALED},\n{windows_sql()},\n{life}\n"
        f"SELECT id, time_end, e AS n_rows, {r6('rul')} AS RUL_rolled, rul_class AS RUL_rolled_class FROM classed"
    )


def _rul_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_rul(sensor(spark, sf_dir))
    return rows.select("id", "time", rounded(c("RUL")).alias("RUL"), "RUL_class")


RUL_SQL = f"""WITH {SENSOR},
spans AS (SELECT id, epoch_us(min(time)) AS a, epoch_us(max(time)) AS b FROM sensor GROUP BY id),
ruls AS (SELECT id, time, (b - epoch_us(time)) / nullif(b - a, 0)::DOUBLE AS rul FROM sensor JOIN spans USING (id))
SELECT id, time, {r6('rul')} AS RUL,
       CASE WHEN rul < 0.25 THEN 3 WHEN rul < 0.5 THEN 2 WHEN rul IS NOT NULL THEN 1 END AS RUL_class FROM ruls"""


def _rul_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = c("value") / 500
    return table(spark, sf_dir, "events").select(
        "event_id", rul_class(share).alias("rul_class"), rul_class5(share).alias("rul_class5")
    )


def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trailing(prepared(spark, sf_dir), MIN_TIMESHIFT, STEP)
    return rows.select(c("id").alias("bearing_id"), "time_start", "time", "pos")


def _life_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = sensor(spark, sf_dir).groupBy("id").agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    seconds = (micros(c("last_time")) - micros(c("first_time"))) / 1e6
    return spans.withColumn("seconds", rounded(seconds))


def _step_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return every_nth(sensor(spark, sf_dir), ("id", "time"), 10)


def _step_sample_rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = every_nth_rolled(windows(spark, sf_dir), 10)
    return sampled.select(c("id").alias("bearing_id"), "time_end", "time", "pos")


def _stage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a stage table by split and read one split back."""
    path = f"{stage_root(spark)}/table-{uuid.uuid4().hex}"
    split = F.when(c("id") % 3 == 0, "t_train").otherwise("s_train")
    write_stage(sensor(spark, sf_dir).withColumn("split", split), path)
    return read_stage(spark, path, "t_train").select("id", "time", "x", "y")


L2 = {"width": 40, "jump": 5, "min_size": 2, "breakpoints": 6}
NORMAL = {"width": 60, "jump": 5, "breakpoints": 3}


def _changepoint_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment_series(prepared(spark, sf_dir, long_sensor), **L2)
    return found.select("id", "breakpoint", rounded(c("position")).alias("position"))


def _merged(spark: SparkSession, sf_dir: str):
    ordinal = F.when(c("id") == "click", 1).when(c("id") == "error", 2).otherwise(3)
    return merge_series(long_sensor(spark, sf_dir).withColumn("series", ordinal).drop("id"), order="reversed")


def _changepoint_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment_merged(_merged(spark, sf_dir), **NORMAL)
    return found.select("breakpoint", rounded(c("position")).alias("position"))


def _segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _merged(spark, sf_dir)
    labelled = label_segments(merged, segment_merged(merged, **NORMAL))
    return labelled.select("time", "pos", "cats")


def _peaks_sql(width: int, jump: int, min_size: int, breakpoints: int, cost: str, key: str = "id") -> str:
    """Naive form of the same rule: costs from the rows of each range, maxima by frames over
    candidates repeated before and behind the series."""
    half = width // 2
    order = max(max(width, 2 * min_size) // (2 * jump), 1)
    costs = {
        "l2": "count(*) {f} * (var_pop(x) {f} + var_pop(y) {f})",
        "normal": "count(*) {f} * ln((var_samp(x) {f} + 1e-6) * (var_samp(y) {f} + 1e-6) - power(covar_samp(x, y) {f}, 2))",
    }
    whole = costs[cost].format(f="")
    first = costs[cost].format(f="FILTER (pos < k)")
    second = costs[cost].format(f="FILTER (pos >= k)")
    return f"""cand AS (SELECT {key}, pos AS k, n_rows FROM ordered WHERE pos % {jump} = 0 AND pos >= {half} AND pos < n_rows - {half}),
gain AS (
    SELECT c.{key}, c.k, any_value(c.n_rows) AS n_rows, ({whole}) - ({first}) - ({second}) AS gain
    FROM cand c JOIN ordered o ON o.{key} = c.{key} AND o.pos BETWEEN c.k - {half} AND c.k + {half} - 1
    GROUP BY c.{key}, c.k),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY k) - 1 AS j, count(*) OVER (PARTITION BY {key}) AS m FROM gain),
looped AS (SELECT p.*, j + s * m AS i, s FROM placed p, (VALUES (-1), (0), (1)) t(s)),
peaks AS (
    SELECT *, max(gain) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN {order} PRECEDING AND 1 PRECEDING) AS a,
           max(gain) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {order} FOLLOWING) AS b FROM looped),
ranked AS (
    SELECT {key}, k, n_rows, row_number() OVER (PARTITION BY {key} ORDER BY gain DESC, k DESC) AS rk
    FROM peaks WHERE s = 0 AND m > {order} AND gain > a AND gain > b),
bkps AS (
    SELECT {key}, k AS breakpoint, n_rows FROM ranked WHERE rk <= {breakpoints}
    UNION ALL SELECT {key}, n_rows, n_rows FROM ordered WHERE pos = 0)"""


L2_SQL = (
    f"WITH {LONG_SENSOR},\n{SCALED},\nordered AS (SELECT * FROM scaled),\n"
    + _peaks_sql(L2["width"], L2["jump"], L2["min_size"], L2["breakpoints"], "l2")
    + f"\nSELECT id, breakpoint, {r6('breakpoint / n_rows')} AS position FROM bkps"
)
_MERGED_SQL = (
    f"WITH {LONG_SENSOR},\nordered AS (SELECT 1 AS g, time, x, y, row_number() OVER (ORDER BY "
    "CASE WHEN id = 'click' THEN -1 WHEN id = 'error' THEN -2 ELSE -3 END, time) - 1 AS pos, "
    "count(*) OVER () AS n_rows FROM sensor),\n"
    + _peaks_sql(NORMAL["width"], NORMAL["jump"], 2, NORMAL["breakpoints"], "normal", "g")
)


def build() -> dict[str, Query]:
    series_end = LIFE.replace("max(w.time_end) AS t_max", "max(s.time) AS t_max")
    from_one = LIFE.replace("SELECT w.id, min(s.time)", "SELECT min(s.time)").replace(
        "GROUP BY w.id)", "WHERE w.id = 1)"
    ).replace("JOIN span USING (id)", ", span")
    rolled = (
        prelude()
        + f",\n{LIFE}\nSELECT c.id AS bearing_id, c.time_end, s.time, {r6('s.x')} AS x, {r6('s.y')} AS y, "
        + f"{r6('rul')} AS RUL_rolled, rul_class AS RUL_rolled_class "
        + "FROM classed c JOIN scaled s ON s.id = c.id AND s.pos < c.e"
    )
    sampled = (
        f"WITH {SENSOR},\n{SCALED},\n{windows_sql()},\nordered AS ("
        "SELECT w.id, w.time_end, s.time, s.pos, row_number() OVER (ORDER BY w.id, w.e, s.pos) - 1 AS g "
        "FROM windows w JOIN scaled s ON s.id = w.id AND s.pos < w.e)\n"
        "SELECT id AS bearing_id, time_end, time, pos FROM ordered WHERE g % 10 = 0"
    )
    trail = f"""WITH {SENSOR},
{SCALED}
SELECT a.id AS bearing_id, a.time AS time_start, b.time, b.pos FROM scaled a JOIN scaled b ON a.id = b.id AND b.pos >= a.pos
WHERE a.pos % {STEP} = 0 AND a.n_rows - a.pos > {MIN_TIMESHIFT}"""
    minmax = f"""WITH {SENSOR}, b AS (
    SELECT *, min(x) OVER (PARTITION BY id) AS x0, max(x) OVER (PARTITION BY id) AS x1,
           min(y) OVER (PARTITION BY id) AS y0, max(y) OVER (PARTITION BY id) AS y1 FROM sensor)
SELECT id, time, {r6('(x - x0) / (x1 - x0)')} AS x, {r6('(y - y0) / (y1 - y0)')} AS y FROM b"""
    normal_time = f"""WITH {SENSOR}, b AS (
    SELECT *, epoch_us(time) AS t, min(epoch_us(time)) OVER (PARTITION BY id) AS t0,
           max(epoch_us(time)) OVER (PARTITION BY id) AS t1 FROM sensor)
SELECT id, time, {r6('(t - t0) / nullif(t1 - t0, 0)::DOUBLE')} AS norm_axis FROM b"""
    return {
        "window_labels_and_features": Query(flagship, _flagship_sql()),
        "sensor_view": Query(_sensor_view, f"WITH {SENSOR} SELECT * FROM sensor"),
        "index_series": Query(
            _index_series,
            f"WITH {SENSOR} SELECT id, time, row_number() OVER (PARTITION BY id ORDER BY time) - 1 AS pos, "
            f"count(*) OVER (PARTITION BY id) AS n_rows, {r6('avg(x) OVER (PARTITION BY id)')} AS center_x FROM sensor",
        ),
        "csv_scan": Query(_csv_scan, CSV_SQL),
        "scan_splits": Query(_scan_splits, SPLITS_SQL),
        "time_assembly": Query(
            _time_assembly,
            "SELECT event_id, TIMESTAMP '2023-01-01' + to_hours(hour(ts)) + to_minutes(minute(ts)) "
            "+ to_seconds(CAST(second(ts) AS DOUBLE)) + to_milliseconds(event_id % 70000) AS time FROM events",
        ),
        "stage_table": Query(_stage_table, f"WITH {SENSOR} SELECT * FROM sensor WHERE id % 3 = 0"),
        "ffill_per_id": Query(_ffill("series"), _ffill_sql("PARTITION BY id")),
        "ffill_global": Query(_ffill("global"), _ffill_sql("")),
        "robust_scale": Query(
            _scaled(robust_scale), f"WITH {SENSOR},\n{SCALED} SELECT id, time, {r6('x')} AS x, {r6('y')} AS y FROM scaled"
        ),
        "minmax_scale": Query(_scaled(minmax_scale), minmax),
        "time_normalize": Query(_time_normalize, normal_time),
        "life_span": Query(
            _life_table,
            f"WITH {SENSOR} SELECT id, min(time) AS first_time, max(time) AS last_time, "
            f"{r6('(epoch_us(max(time)) - epoch_us(min(time))) / 1e6')} AS seconds FROM sensor GROUP BY id",
        ),
        "roll_windows": Query(_roll_windows, rolled),
        "roll_windows_backward": Query(_trailing, trail),
        "window_labels": Query(_window_labels(), _labels_sql()),
        "window_labels_series_end": Query(_window_labels(end="series"), _labels_sql(series_end)),
        "window_labels_reference_bearing": Query(_window_labels(span_of=1), _labels_sql(from_one)),
        "rul_columns": Query(_rul_columns, RUL_SQL),
        "rul_class": Query(
            _rul_class,
            "SELECT event_id, CASE WHEN value / 500 < 0.25 THEN 3 WHEN value / 500 < 0.5 THEN 2 ELSE 1 END AS rul_class, "
            "CAST(trunc(value / 500 * 5) AS INTEGER) AS rul_class5 FROM events",
        ),
        "step_sample": Query(
            _step_sample,
            f"WITH {SENSOR}, o AS (SELECT *, row_number() OVER (ORDER BY id, time) - 1 AS g FROM sensor) "
            "SELECT id, time, x, y FROM o WHERE g % 10 = 0",
        ),
        "step_sample_rolled": Query(_step_sample_rolled, sampled),
        "changepoint_l2": Query(_changepoint_l2, L2_SQL),
        "changepoint_normal": Query(
            _changepoint_normal, _MERGED_SQL + f"\nSELECT breakpoint, {r6('breakpoint / n_rows')} AS position FROM bkps"
        ),
        "segment_labels": Query(
            _segment_labels,
            _MERGED_SQL
            + "\nSELECT time, pos, CAST(least(1 + (SELECT count(*) FROM bkps WHERE breakpoint <= pos), 4) AS INTEGER) AS cats FROM ordered",
        ),
    }
