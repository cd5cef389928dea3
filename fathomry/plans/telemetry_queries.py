"""Queries over telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry as T
from . import fixtures as X
from .registry import query


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("a09_moments", "SELECT run, name, count(value) AS num, round(avg(value), 6) AS mean, round(sqrt(greatest(avg(value * value) - avg(value) ** 2, 0)), 4) AS std FROM telemetry GROUP BY ALL", "telemetry")
def a09(spark, sf):
    return _round(_round(T.moments(X.telemetry(spark, sf), ["run", "name"]), "mean"), "std", digits=4)


@query("a09b_sign_moments", "SELECT name, count(*) AS num, round(avg(sign(value - 10)), 6) AS mean FROM telemetry GROUP BY name", "telemetry")
def a09b(spark, sf):
    t = X.telemetry(spark, sf).withColumn("value", F.signum(F.col("value") - 10))
    return _round(T.moments(t, ["name"]), "mean").drop("std")


@query("a12_meter", "SELECT run, name, round(sum(value * n) / sum(n), 6) AS mean, min(value) AS least, max(value) AS most, arg_max(value, step) AS last FROM telemetry GROUP BY ALL", "telemetry")
def a12(spark, sf):
    return _round(T.meter(X.telemetry(spark, sf), ["run", "name"]), "mean")


@query("w02_tick_rates", "SELECT run, tick, round(epoch_us(end_ts) / 1e6 - epoch_us(start_ts) / 1e6, 5) AS sec_per_tick, round((epoch_us(end_ts) / 1e6 - epoch_us(start_ts) / 1e6) / (nimg - coalesce(lag(nimg) OVER w, 0)) * 1000, 2) AS sec_per_kimg, round(epoch_us(start_ts) / 1e6 - lag(epoch_us(end_ts) / 1e6) OVER w, 5) AS maintenance FROM ticks WINDOW w AS (PARTITION BY run ORDER BY tick)", "telemetry ticks")
def w02(spark, sf):
    return _round(_round(T.rates(X.ticks(spark, sf)), "sec_per_tick", "maintenance", digits=5), "sec_per_kimg", digits=2)


@query("w03_running_best", ", b AS (SELECT run, name, step, value, min(value) OVER (PARTITION BY run, name ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM telemetry) SELECT run, name, step, coalesce(value < before, true) AS is_new, least(value, before) AS best FROM b", "telemetry")
def w03(spark, sf):
    return T.running_best(X.telemetry(spark, sf), ["run", "name"]).select("run", "name", "step", "is_new", "best")


@query("w04_smoothing", "SELECT run, name, step, quantile_disc(value, 0.5) OVER w AS median, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS most, value AS last FROM telemetry WINDOW w AS (PARTITION BY run, name ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "telemetry")
def w04(spark, sf):
    return _round(T.smoothed(X.telemetry(spark, sf), ["run", "name"]), "mean").select("run", "name", "step", "median", "mean", "most", "last")


@query("w05_cumulative_mean", "SELECT run, name, step, round(avg(value) OVER (PARTITION BY run, name ORDER BY step), 6) AS mean_so_far FROM telemetry", "telemetry")
def w05(spark, sf):
    return _round(T.cumulative_mean(X.telemetry(spark, sf), ["run", "name"]), "mean_so_far").select("run", "name", "step", "mean_so_far")


_FOLD = ", s AS (SELECT run, name, value, row_number() OVER (PARTITION BY run, name ORDER BY step) AS i FROM telemetry)"


@query("w06_ema", ", l AS (SELECT run, name, list(value ORDER BY step) AS v FROM telemetry GROUP BY ALL) SELECT run, name, len(v) AS n, round(list_reduce(list_transform(v, lambda x, i: {'x': x, 'i': (i - 1)::DOUBLE}), lambda a, b: {'x': b.x + (a.x - b.x) * least(0.9, (b.i + 1) / (b.i + 10)), 'i': b.i}).x, 6) AS ema FROM l", "telemetry")
def w06(spark, sf):
    return _round(T.ema(X.telemetry(spark, sf), ["run", "name"], 0.9), "ema").withColumn("n", F.col("n").cast("long"))


@query("w07_controller", ", l AS (SELECT run, name, list_prepend(0.0::DOUBLE, list(sign(value - 12)::DOUBLE ORDER BY step)) AS v FROM telemetry GROUP BY ALL) SELECT run, name, round(list_reduce(v, lambda p, s: greatest(0, least(1, p + s * 0.05))), 6) AS p FROM l", "telemetry")
def w07(spark, sf):
    return _round(T.controller(X.telemetry(spark, sf), ["run", "name"], target=12, gain=0.05), "p")


@query("w08_interval_delta", """, t AS (SELECT run, name, value, step // 8 AS tick FROM telemetry), g AS (SELECT run, name, tick, count(value) AS num, avg(value) AS mean FROM t GROUP BY ALL), s AS (SELECT run, min(tick) AS a, max(tick) AS b FROM t GROUP BY run),
grid AS (SELECT n.run, n.name, unnest(generate_series(a, b)) AS tick FROM (SELECT DISTINCT run, name FROM t) n JOIN s ON n.run = s.run)
SELECT grid.run, grid.name, grid.tick, coalesce(num, 0) AS num, round(last_value(mean IGNORE NULLS) OVER (PARTITION BY grid.run, grid.name ORDER BY grid.tick), 6) AS mean FROM grid LEFT JOIN g ON grid.run = g.run AND grid.name = g.name AND grid.tick = g.tick""", "telemetry")
def w08(spark, sf):
    return _round(T.interval_moments(X.telemetry(spark, sf), "run", "name", F.floor(F.col("step") / 8)), "mean")


@query("w12_time_left", "SELECT run, tick, round(avg((epoch_us(end_ts) - epoch_us(start_ts)) / 1e6) OVER (PARTITION BY run ORDER BY tick) * (count(*) OVER (PARTITION BY run) - tick), 3) AS left FROM ticks", "telemetry ticks")
def w12(spark, sf):
    return _round(T.time_left(X.ticks(spark, sf)), "left", digits=3)


@query("p15_name_filter", "SELECT run, step, name FROM telemetry WHERE regexp_full_match(name, 'Loss/(click|view)')", "telemetry")
def p15(spark, sf):
    return T.named(X.telemetry(spark, sf), "Loss/(click|view)").select("run", "step", "name")


@query("p16_per_class", ", m AS (SELECT run % 7 AS class, avg(value) AS v FROM telemetry GROUP BY 1) SELECT 'pr50k3' AS metric, class::INT AS class, round(v, 6) AS value FROM m", "telemetry")
def p16(spark, sf):
    by = X.telemetry(spark, sf).groupBy((F.col("run") % 7).alias("k")).agg(F.avg("value").alias("v"))
    record = by.select(F.create_map(F.concat(F.lit("pr50k3_class_"), F.col("k").cast("string")), "v", F.lit("fid"), F.lit(0.0)).alias("results"))
    return _round(T.per_class(record), "value").select("metric", "class", "value")


@query("p19_alerts", "SELECT run, step FROM telemetry WHERE n % 10 = 0 OR n % 10 = 1", "telemetry")
def p19(spark, sf):
    bad = F.when(F.col("n") % 10 == 0, float("nan")).when(F.col("n") % 10 == 1, float("-inf")).otherwise(F.col("value"))
    return T.alerts(X.telemetry(spark, sf).withColumn("value", bad)).select("run", "step")


@query("k05_scalar_events", "SELECT run, 'Metrics/' || name AS tag, (sum(n) OVER (PARTITION BY run ORDER BY step))::BIGINT // 1000 AS step, value, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY run))) / 1e6, 6) AS walltime FROM telemetry", "telemetry")
def k05(spark, sf):
    t = X.telemetry(spark, sf).withColumn("nimg", F.expr("sum(n) over (partition by run order by step)"))
    return _round(T.scalar_events(t), "walltime")


@query("s07_tick_lines", "SELECT run, name, count(value) AS num, round(avg(value), 6) AS mean FROM telemetry GROUP BY ALL", "telemetry")
def s07(spark, sf):
    from ..sources.readers import parse_tick_stats

    m = T.moments(X.telemetry(spark, sf), ["run", "name"])
    lines = m.groupBy("run").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", F.struct("num", "mean", "std"))))).alias("value"))
    return _round(parse_tick_stats(lines), "mean").select("run", "name", F.col("num").cast("long").alias("num"), "mean")
