"""Queries of forecasts: scores, folds, integrity checks, ensembles and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baselines, ensemble, folds, integrity, metrics, panel as pn
from .feature_queries import _MONTHLY, _SPREAD, rounded
from .registry import BUSINESS, FORECASTS, PANEL, SEGMENTS, business_panel, forecasts, order_panel, query, segment_panel, table

_POINT = "count(*) AS n, round(avg(abs(y_true - y_pred)), 3) AS mae, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 3) AS rmse, round(CASE WHEN var_pop(y_true) > 0 THEN 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) END, 5) AS r2"
_BY = "series_id, horizon, model"


@query("persistence_leaderboard", f"""SELECT {_BY}, round(mae, 3) AS mae, round(CASE WHEN b > 0 THEN 100 * (b - mae) / b END, 4) AS skill, CAST(row_number() OVER (PARTITION BY series_id, horizon ORDER BY mae, model) AS INTEGER) AS rank FROM e
  UNION ALL SELECT series_id, horizon, 'persistence', round(min(b), 3), 0.0, 0 FROM e GROUP BY 1, 2""", *FORECASTS, f"e AS (SELECT {_BY}, avg(abs(y_true - y_pred)) AS mae, avg(abs(y_true - origin_value)) AS b FROM preds GROUP BY 1, 2, 3)")  # fmt: skip
def persistence_leaderboard(spark, sf_dir):
    return rounded(rounded(metrics.leaderboard(forecasts(spark, sf_dir)), 3, "mae"), 4, "skill")


@query("segment_leaderboard", f"""SELECT {_BY}, round(mae, 3) AS mae, round(CASE WHEN b > 0 THEN 100 * (b - mae) / b END, 4) AS skill, CAST(row_number() OVER (PARTITION BY series_id, horizon ORDER BY mae, model) AS INTEGER) AS rank FROM e
  UNION ALL SELECT series_id, horizon, 'persistence', round(min(b), 3), 0.0, 0 FROM e GROUP BY 1, 2""", SEGMENTS, *FORECASTS[1:], f"e AS (SELECT {_BY}, avg(abs(y_true - round(y_pred))) AS mae, avg(abs(y_true - origin_value)) AS b FROM preds GROUP BY 1, 2, 3)")  # fmt: skip
def segment_leaderboard(spark, sf_dir):
    """The leaderboard of a series for each nation and market segment; forecasts in whole units, so that equal errors tie."""
    preds = baselines.window_forecasts(pn.business_index(segment_panel(spark, sf_dir)), 5).where("target_date >= DATE '1999-01-01'").withColumn("y_pred", F.round("y_pred"))
    return rounded(rounded(metrics.leaderboard(preds), 3, "mae"), 4, "skill")


@query("predictions_long", f"SELECT {_BY}, origin_date, target_date, origin_value, y_true, round(y_pred, 4) AS y_pred, round(y_lo, 2) AS y_lo, round(y_hi, 2) AS y_hi FROM preds", *FORECASTS)
def predictions_long(spark, sf_dir):
    return rounded(rounded(forecasts(spark, sf_dir), 4, "y_pred"), 2, "y_lo", "y_hi")


@query("point_metrics", f"SELECT {_BY}, {_POINT} FROM preds GROUP BY 1, 2, 3", *FORECASTS)
def point_metrics(spark, sf_dir):
    out = forecasts(spark, sf_dir).groupBy(*metrics.KEYS).agg(*metrics.point())
    return rounded(rounded(out, 3, "mae", "rmse"), 5, "r2")


@query("percentage_errors", f"SELECT {_BY}, round(100 * avg(2 * abs(y_true - y_pred) / (abs(y_true) + abs(y_pred) + 1e-9)), 4) AS smape, round(log10(100 * avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-9))), 6) AS log10_mape, count(*) FILTER (abs(y_true) < 1e-9) AS n_guarded FROM preds GROUP BY 1, 2, 3", *FORECASTS)
def percentage_errors(spark, sf_dir):
    """Days without an order make a MAPE of many digits; its logarithm says the same in few."""
    out = forecasts(spark, sf_dir).groupBy(*metrics.KEYS).agg(*metrics.percentage(), F.count_if(F.abs("y_true") < metrics.EPS).alias("n_guarded"))
    return rounded(rounded(out.withColumn("log10_mape", F.log10("mape")).drop("mape"), 4, "smape"), 6, "log10_mape")


@query("interval_coverage", f"SELECT {_BY}, round(avg(CASE WHEN y_lo IS NOT NULL AND y_hi IS NOT NULL THEN CASE WHEN y_true BETWEEN y_lo AND y_hi THEN 1.0 ELSE 0.0 END END), 6) AS coverage, round(avg(y_hi - y_lo), 2) AS width FROM preds GROUP BY 1, 2, 3", *FORECASTS)
def interval_coverage(spark, sf_dir):
    out = forecasts(spark, sf_dir).groupBy(*metrics.KEYS).agg(*metrics.intervals())
    return rounded(rounded(out, 6, "coverage"), 2, "width")


@query("persistence_baseline", f"SELECT {_BY}, round(avg(abs(y_true - origin_value)), 3) AS persistence_mae, round(sqrt(avg((y_true - origin_value) * (y_true - origin_value))), 3) AS persistence_rmse FROM preds GROUP BY 1, 2, 3", *FORECASTS)
def persistence_baseline(spark, sf_dir):
    return rounded(forecasts(spark, sf_dir).groupBy(*metrics.KEYS).agg(*metrics.persistence()), 3, "persistence_mae", "persistence_rmse")


_TOL = f"tol AS (SELECT {_BY}, avg(CASE WHEN abs(p - t) <= 0.1 * abs(t) THEN 1.0 ELSE 0.0 END) AS monthly_tol10 FROM (SELECT {_BY}, date_trunc('month', target_date) AS m, sum(y_true) AS t, sum(y_pred) AS p FROM preds GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"


@query("monthly_tolerance", f"SELECT {_BY}, round(monthly_tol10, 6) AS monthly_tol10 FROM tol", *FORECASTS, _TOL)
def monthly_tolerance(spark, sf_dir):
    return rounded(metrics.monthly_tolerance(forecasts(spark, sf_dir)), 6, "monthly_tol10")


_SCORES = f"""scores AS (SELECT p.{_BY.replace(', ', ', p.')}, count(*) AS n, avg(abs(y_true - y_pred)) AS mae, CASE WHEN var_pop(y_true) > 0 THEN 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) END AS r2,
  avg(CASE WHEN y_lo IS NOT NULL THEN CASE WHEN y_true BETWEEN y_lo AND y_hi THEN 1.0 ELSE 0.0 END END) AS coverage, 100 * (avg(abs(y_true - origin_value)) - avg(abs(y_true - y_pred))) / avg(abs(y_true - origin_value)) AS skill, any_value(t.monthly_tol10) AS monthly_tol10
  FROM preds p JOIN tol t ON t.series_id = p.series_id AND t.horizon = p.horizon AND t.model = p.model GROUP BY 1, 2, 3)"""


@query("metric_block", f"SELECT {_BY}, n, round(mae, 3) AS mae, round(r2, 5) AS r2, round(coverage, 6) AS coverage, round(skill, 4) AS skill, round(monthly_tol10, 6) AS monthly_tol10 FROM scores", *FORECASTS, _TOL, _SCORES)
def metric_block(spark, sf_dir):
    out = metrics.block(forecasts(spark, sf_dir))
    return rounded(rounded(rounded(rounded(out, 3, "mae"), 5, "r2"), 6, "coverage", "monthly_tol10"), 4, "skill").select(*metrics.KEYS, "n", "mae", "r2", "coverage", "skill", "monthly_tol10")


@query("seasonal_naive", "SELECT series_id, horizon, round(avg(abs(y - b)), 4) AS seasonal_naive_mae, count(b) AS n, horizon = 20 AS same_as_persistence FROM (SELECT *, lag(y, 20) OVER (PARTITION BY series_id, horizon ORDER BY target_date) AS b FROM (SELECT DISTINCT series_id, horizon, target_date, y_true AS y FROM preds)) GROUP BY 1, 2", *FORECASTS)
def seasonal_naive(spark, sf_dir):
    return rounded(metrics.seasonal_naive(forecasts(spark, sf_dir), 20), 4, "seasonal_naive_mae")


@query("mase", f"SELECT p.{_BY.replace(', ', ', p.')}, round(avg(abs(y_true - y_pred)) / any_value(s.scale), 6) AS mase FROM preds p JOIN (SELECT series_id, avg(abs(y - b)) AS scale FROM (SELECT *, lag(y, 5) OVER (PARTITION BY series_id ORDER BY pos) AS b FROM biz WHERE ds <= DATE '1999-12-31') GROUP BY 1) s ON s.series_id = p.series_id GROUP BY 1, 2, 3", *FORECASTS)
def mase(spark, sf_dir):
    return rounded(metrics.mase(forecasts(spark, sf_dir), business_panel(spark, sf_dir), "1999-12-31", 5), 6, "mase").select(*metrics.KEYS, "mase")


@query("pinball_loss", f"SELECT {_BY}, round(avg(greatest(0.05 * (y_true - y_lo), -0.95 * (y_true - y_lo))), 3) AS q05, round(avg(greatest(0.5 * (y_true - y_pred), -0.5 * (y_true - y_pred))), 3) AS q50, round(avg(greatest(0.95 * (y_true - y_hi), -0.05 * (y_true - y_hi))), 3) AS q95 FROM preds WHERE y_lo IS NOT NULL GROUP BY 1, 2, 3", *FORECASTS)
def pinball_loss(spark, sf_dir):
    out = forecasts(spark, sf_dir).where("y_lo IS NOT NULL").groupBy(*metrics.KEYS).agg(*[metrics.pinball("y_true", c, q).alias(n) for c, q, n in (("y_lo", 0.05, "q05"), ("y_pred", 0.5, "q50"), ("y_hi", 0.95, "q95"))])
    return rounded(out, 3, "q05", "q50", "q95")


@query("tercile_coverage", f"""SELECT {_BY}, tercile, count(*) AS n, round(avg(CASE WHEN y_lo IS NOT NULL THEN CASE WHEN y_true BETWEEN y_lo AND y_hi THEN 1.0 ELSE 0.0 END END), 6) AS coverage, round(avg(y_hi - y_lo), 2) AS width
  FROM (SELECT *, CAST(ntile(3) OVER (PARTITION BY {_BY} ORDER BY abs(y_true), target_date) AS INTEGER) AS tercile FROM preds) GROUP BY 1, 2, 3, 4""", *FORECASTS)  # fmt: skip
def tercile_coverage(spark, sf_dir):
    return rounded(rounded(metrics.tercile_coverage(forecasts(spark, sf_dir)), 6, "coverage"), 2, "width")


@query("errors_by_month", f"SELECT {_BY}, CAST(date_trunc('month', target_date) AS DATE) AS month, count(*) AS n, round(avg(abs(y_true - y_pred)) + 1e-6, 3) AS mae, round(avg(y_true - y_pred) + 1e-6, 3) AS bias FROM preds GROUP BY 1, 2, 3, 4", *FORECASTS)
def errors_by_month(spark, sf_dir):
    # Means of these numbers fall on ties of the third digit; a millionth moves both sides off them.
    out = metrics.errors_by_month(forecasts(spark, sf_dir)).withColumns({c: F.col(c) + 1e-6 for c in ("mae", "bias")})
    return rounded(out, 3, "mae", "bias")


@query("residual_histogram", """SELECT model, CASE WHEN e < -1000000 THEN 0 WHEN e >= 1000000 THEN 21 ELSE CAST(floor((e + 1000000) / 100000) AS BIGINT) + 1 END AS bin, count(*) AS n FROM (SELECT model, y_true - y_pred AS e FROM preds) GROUP BY 1, 2""", *FORECASTS)
def residual_histogram(spark, sf_dir):
    return metrics.residual_histogram(forecasts(spark, sf_dir), -1e6, 1e6, 20)


@query("rolling_error", f"""SELECT {_BY}, target_date, CASE WHEN count(*) OVER w >= 5 THEN round(avg(abs(y_true - y_pred)) OVER w + 1e-6, 3) END AS rolling_mae FROM preds WINDOW w AS (PARTITION BY {_BY} ORDER BY target_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", *FORECASTS)
def rolling_error(spark, sf_dir):
    out = metrics.rolling_error(forecasts(spark, sf_dir)).withColumn("rolling_mae", F.col("rolling_mae") + 1e-6)
    return rounded(out, 3, "rolling_mae").select(*metrics.KEYS, "target_date", "rolling_mae")


_OPS = "ops AS (SELECT s.series_id, s.ds, m.baseline * CASE WHEN t > 0 THEN w / t ELSE 1.0 / n END AS baseline FROM sp2 s LEFT JOIN mb m ON m.series_id = s.series_id AND m.year = s.year AND m.month = s.month)"


@query("skill_vs_ops", f"""SELECT p.{_BY.replace(', ', ', p.')}, count(*) AS n, round(avg(abs(y_true - y_pred)), 3) AS mae, round(avg(abs(y_true - baseline)), 2) AS ops_mae, round(100 * (avg(abs(y_true - baseline)) - avg(abs(y_true - y_pred))) / avg(abs(y_true - baseline)), 3) AS skill_vs_ops
  FROM preds p JOIN ops o ON o.series_id = p.series_id AND o.ds = p.target_date WHERE baseline IS NOT NULL GROUP BY 1, 2, 3""", *FORECASTS, _MONTHLY, _SPREAD, _OPS)  # fmt: skip
def skill_vs_ops(spark, sf_dir):
    panel = business_panel(spark, sf_dir)
    base = baselines.spread_month(panel, baselines.monthly_baseline(panel)).select("series_id", F.col("ds").alias("target_date"), "baseline")
    return rounded(rounded(metrics.against_baseline(forecasts(spark, sf_dir), base), 3, "mae", "skill_vs_ops"), 2, "ops_mae")


@query("conformal_radius", f"SELECT {_BY}, round(quantile_cont(abs(y_true - y_pred), 0.9), 3) AS radius FROM preds WHERE target_date >= DATE '2001-01-01' GROUP BY 1, 2, 3", *FORECASTS)
def conformal_radius(spark, sf_dir):
    return rounded(metrics.conformal_radius(forecasts(spark, sf_dir), "2001-01-01"), 3, "radius")


_KINDS = """flows AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ds, sum(round(o_totalprice)) AS y FROM orders GROUP BY 1, 2),
moved AS (SELECT ds, sum(y) AS y FROM (SELECT ds, y FROM flows UNION ALL SELECT CAST(l_shipdate AS DATE), -round(l_extendedprice) FROM lineitem) GROUP BY 1),
bal AS (SELECT 'balance' AS series_id, ds, sum(y) OVER (ORDER BY ds) AS y FROM moved),
both2 AS (SELECT * FROM flows UNION ALL SELECT * FROM bal),
spine2 AS (SELECT series_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM both2 GROUP BY 1),
biz2 AS (SELECT s.series_id, s.ds, CAST(row_number() OVER (PARTITION BY s.series_id ORDER BY s.ds) - 1 AS INTEGER) AS pos,
    CASE WHEN s.series_id = 'balance' THEN last_value(b.y IGNORE NULLS) OVER (PARTITION BY s.series_id ORDER BY s.ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE coalesce(b.y, 0.0) END AS y
  FROM spine2 s LEFT JOIN both2 b ON b.series_id = s.series_id AND b.ds = s.ds WHERE isodow(s.ds) < 6),
p2 AS (SELECT series_id, y AS origin_value, lead(ds, 5) OVER w AS target_date, lead(y, 5) OVER w AS y_true, round(avg(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS ma FROM biz2 WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
k AS (SELECT series_id, CASE WHEN series_id = 'balance' THEN 'level' ELSE 'flow' END AS kind, model, target_date, y_true, y_pred FROM (SELECT *, 'naive_last' AS model, origin_value AS y_pred FROM p2 UNION ALL SELECT *, 'moving_average_20', ma FROM p2) WHERE y_true IS NOT NULL AND target_date >= DATE '1999-01-01'),
kmonths AS (SELECT series_id, kind, model, date_trunc('month', target_date) AS m, CASE WHEN kind = 'level' THEN arg_max(y_true, target_date) ELSE sum(y_true) END AS t, CASE WHEN kind = 'level' THEN arg_max(y_pred, target_date) ELSE sum(y_pred) END AS p FROM k GROUP BY 1, 2, 3, 4)"""


@query("metrics_by_kind", """SELECT a.*, round(b.tol, 6) AS monthly_tol10 FROM (SELECT series_id, kind, model, count(*) AS n, round(avg(abs(y_true - y_pred)), 3) AS mae, CASE WHEN kind = 'flow' THEN round(100 * avg(2 * abs(y_true - y_pred) / (abs(y_true) + abs(y_pred) + 1e-9)), 4) END AS smape, CASE WHEN kind = 'flow' THEN round(log10(100 * avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-9))), 6) END AS log10_mape FROM k GROUP BY 1, 2, 3) a
  JOIN (SELECT series_id, model, avg(CASE WHEN abs(p - t) / greatest(abs(t), 1e-9) <= 0.1 THEN 1.0 ELSE 0.0 END) AS tol FROM kmonths GROUP BY 1, 2) b ON b.series_id = a.series_id AND b.model = a.model""", _KINDS)  # fmt: skip
def metrics_by_kind(spark, sf_dir):
    """Scores of five flows and of their balance, a level: months by their last value, no percentages. Forecasts in whole units."""
    flows, shipped = order_panel(spark, sf_dir), table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("ds"), (-F.round("l_extendedprice")).alias("y"))
    moved = flows.select("ds", "y").unionByName(shipped).groupBy("ds").agg(F.sum("y").alias("y")).withColumn("series_id", F.lit("balance"))
    levels = pn.business_index(pn.running_balance(moved).select("series_id", "ds", "y"), "level").withColumn("kind", F.lit("level"))
    both = pn.business_index(flows).withColumn("kind", F.lit("flow")).unionByName(levels)
    preds = baselines.window_forecasts(both, 5).where("model <> 'weekday_mean' AND target_date >= DATE '1999-01-01'").withColumn("y_pred", F.round("y_pred"))
    preds = preds.join(F.broadcast(both.select("series_id", "kind").distinct()), "series_id")  # a row for each series
    out = metrics.block(preds).join(preds.select("series_id", "kind").distinct(), "series_id").withColumn("log10_mape", F.log10("mape"))
    return rounded(rounded(rounded(out, 3, "mae"), 4, "smape"), 6, "log10_mape", "monthly_tol10").select("series_id", "kind", "model", "n", "mae", "smape", "log10_mape", "monthly_tol10")


@query("model_heatmap", """SELECT model, round(avg(mae) FILTER (series_id = '1-URGENT'), 3) AS urgent, round(avg(mae) FILTER (series_id = '5-LOW'), 3) AS low, round(quantile_cont(mae, 0.05), 3) AS p05, round(quantile_cont(mae, 0.95), 3) AS p95
  FROM (SELECT series_id, model, avg(abs(y_true - y_pred)) AS mae FROM preds GROUP BY 1, 2) GROUP BY 1""", *FORECASTS)  # fmt: skip
def model_heatmap(spark, sf_dir):
    e = ensemble.model_errors(forecasts(spark, sf_dir))
    wide = e.groupBy("model").pivot("series_id", ["1-URGENT", "5-LOW"]).agg(F.avg("mae")).toDF("model", "urgent", "low")
    spread = e.groupBy("model").agg(F.percentile("mae", F.lit(0.05)).alias("p05"), F.percentile("mae", F.lit(0.95)).alias("p95"))
    return rounded(wide.join(spread, "model"), 3, "urgent", "low", "p05", "p95")


_HEAT = "heat AS (SELECT series_id, h, model, avg(abs(y_true - y_pred)) AS mae FROM (" + " UNION ALL ".join(f"SELECT series_id, {h} AS h, m.model, t AS y_true, CASE m.model WHEN 'naive_last' THEN y ELSE ma END AS y_pred FROM (SELECT series_id, y, lead(y, {h}) OVER w AS t, lead(ds, {h}) OVER w AS td, avg(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma FROM biz WINDOW w AS (PARTITION BY series_id ORDER BY pos)), (VALUES ('naive_last'), ('moving_average_20')) m(model) WHERE t IS NOT NULL AND td >= DATE '1999-01-01'" for h in (1, 5, 20)) + ") GROUP BY 1, 2, 3)"


@query("horizon_heatmap", "SELECT model, " + ", ".join(f"round(avg(mae) FILTER (h = {h}), 3) AS h{h}" for h in (1, 5, 20)) + ", round(quantile_cont(mae, 0.05), 3) AS p05, round(quantile_cont(mae, 0.95), 3) AS p95 FROM heat GROUP BY 1", *BUSINESS, _HEAT)
def horizon_heatmap(spark, sf_dir):
    """Mean error by model and horizon, and the range of a model's cells."""
    panel, horizons = business_panel(spark, sf_dir), [1, 5, 20]
    preds = reduce(DataFrame.unionByName, [baselines.window_forecasts(panel, h) for h in horizons]).where("model <> 'weekday_mean' AND target_date >= DATE '1999-01-01'")
    errors = ensemble.model_errors(preds)
    wide = metrics.heatmap(errors, "mae", horizons).toDF("model", *[f"h{h}" for h in horizons])
    spread = errors.groupBy("model").agg(F.percentile("mae", F.lit(0.05)).alias("p05"), F.percentile("mae", F.lit(0.95)).alias("p95"))
    return rounded(wide.join(spread, "model"), 3, *[f"h{h}" for h in horizons], "p05", "p95")


@query("history_context", """SELECT b.series_id, b.ds, b.y FROM biz b JOIN (SELECT series_id, min(target_date) AS f FROM preds GROUP BY 1) m ON m.series_id = b.series_id WHERE b.ds < m.f AND b.ds >= m.f - 60""", *FORECASTS)
def history_context(spark, sf_dir):
    return baselines.history_before(business_panel(spark, sf_dir), forecasts(spark, sf_dir), 60)


@query("filter_predictions", f"SELECT {_BY}, target_date, y_true FROM preds WHERE series_id = '1-URGENT' AND horizon = 5 AND model IN ('naive_last', 'weekday_mean') AND target_date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'", *FORECASTS)
def filter_predictions(spark, sf_dir):
    rows = forecasts(spark, sf_dir).where((F.col("series_id") == "1-URGENT") & (F.col("horizon") == 5) & F.col("model").isin("naive_last", "weekday_mean") & F.col("target_date").between("2000-01-01", "2000-06-30"))
    return rows.select(*metrics.KEYS, "target_date", "y_true")


@query("drop_baselines", f"SELECT {_BY}, count(*) AS n FROM preds WHERE NOT regexp_matches(lower(model), 'naive|persist|baseline|ops') GROUP BY 1, 2, 3", *FORECASTS)
def drop_baselines(spark, sf_dir):
    return pn.drop_baselines(forecasts(spark, sf_dir)).groupBy(*metrics.KEYS).agg(F.count("*").alias("n"))


# Folds


_FOLDS = """ysp AS (SELECT series_id, CAST(year(ds) AS INTEGER) AS yr, min(ds) AS a, max(ds) AS b FROM biz GROUP BY 1, 2),
folds AS (SELECT series_id, yr AS fold_id, te AS train_end, greatest(a, DATE '1999-01-01') AS eval_start, least(b, DATE '2001-06-30') AS eval_end FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY yr) AS n, max(b) OVER (PARTITION BY series_id ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS te FROM ysp) WHERE n > 4 AND greatest(a, DATE '1999-01-01') <= least(b, DATE '2001-06-30'))"""


def _folds(spark, sf_dir):
    return folds.yearly_folds(business_panel(spark, sf_dir), 4, None, "1999-01-01", "2001-06-30")


@query("yearly_folds", "SELECT * FROM folds", *BUSINESS, _FOLDS)
def yearly_folds(spark, sf_dir):
    return _folds(spark, sf_dir)


@query("fold_scores", f"SELECT p.series_id, model, fold_id, count(*) AS n, round(avg(abs(y_true - y_pred)), 3) AS mae FROM preds p JOIN folds f ON f.series_id = p.series_id AND p.target_date BETWEEN f.eval_start AND f.eval_end GROUP BY 1, 2, 3", *FORECASTS, _FOLDS)
def fold_scores(spark, sf_dir):
    rows = folds.fold_rows(forecasts(spark, sf_dir), _folds(spark, sf_dir), "target_date")
    return rounded(rows.groupBy("series_id", "model", "fold_id").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae")), 3, "mae")


@query("tiled_blocks", """SELECT b.series_id, CAST(floor((pos - p0) / 5.0) AS INTEGER) AS block, min(ds) AS first_day, max(ds) AS last_day, count(*) AS n FROM biz b JOIN (SELECT series_id, min(pos) AS p0 FROM biz WHERE ds >= DATE '2000-01-01' GROUP BY 1) s ON s.series_id = b.series_id WHERE pos >= p0 GROUP BY 1, 2""", *BUSINESS)
def tiled_blocks(spark, sf_dir):
    return folds.tiled_blocks(business_panel(spark, sf_dir), 5, "2000-01-01")


@query("embargoed_folds", """SELECT series_id, CAST(k AS INTEGER) AS fold_id, CAST(size - (6 - k) * 126 - 6 AS INTEGER) AS train_end_pos, CAST(size - (6 - k) * 126 AS INTEGER) AS eval_start_pos, CAST(size - (6 - k) * 126 + 125 AS INTEGER) AS eval_end_pos
  FROM (SELECT series_id, max(pos) + 1 AS size FROM biz GROUP BY 1), (SELECT unnest(generate_series(1, 5)) AS k) WHERE size - (6 - k) * 126 - 5 >= 1008""", *BUSINESS)  # fmt: skip
def embargoed_folds(spark, sf_dir):
    return folds.embargoed_folds(business_panel(spark, sf_dir), 5)


@query("last_window", """SELECT series_id, CAST(size - w - 1 AS INTEGER) AS train_end_pos, CAST(size - w AS INTEGER) AS eval_start_pos, CAST(size - 1 AS INTEGER) AS eval_end_pos FROM (SELECT series_id, size, greatest(5, least(12, floor(size / 4.0))) AS w FROM (SELECT series_id, max(pos) + 1 AS size FROM biz GROUP BY 1))""", *BUSINESS)
def last_window(spark, sf_dir):
    return folds.last_window(business_panel(spark, sf_dir), 5)


@query("tail_splits", """SELECT series_id, part, count(*) AS n, min(pos) AS first_pos FROM (SELECT *, CASE WHEN r >= 0.9 THEN 'calibration' WHEN r >= 0.8 THEN 'validation' ELSE 'fit' END AS part FROM (SELECT *, percent_rank() OVER (PARTITION BY series_id ORDER BY pos) AS r FROM biz)) GROUP BY 1, 2""", *BUSINESS)
def tail_splits(spark, sf_dir):
    return folds.tail_splits(business_panel(spark, sf_dir)).groupBy("series_id", "part").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query("blocks_from_end", """SELECT series_id, CAST(k AS INTEGER) AS fold_id, CAST(size - (n + 1 - k) * 5 - 1 AS INTEGER) AS train_end_pos, CAST(size - (n + 1 - k) * 5 AS INTEGER) AS eval_start_pos, CAST(size - (n + 1 - k) * 5 + 4 AS INTEGER) AS eval_end_pos
  FROM (SELECT series_id, size, n, unnest(generate_series(1, n)) AS k FROM (SELECT series_id, size, CAST(greatest(floor((size - 1009) / 5.0), 0) AS INTEGER) AS n FROM (SELECT series_id, max(pos) + 1 AS size FROM biz GROUP BY 1)) WHERE n > 0)""", *BUSINESS)  # fmt: skip
def blocks_from_end(spark, sf_dir):
    return folds.blocks_from_end(business_panel(spark, sf_dir), 5)


@query("cadence_recipes", """SELECT series_id, cadence, horizon, lookback, CAST(greatest(0, size - lookback + 1 - horizon) AS BIGINT) AS n FROM (SELECT series_id, 'daily' AS cadence, 64 AS lookback, unnest([1, 5, 20]) AS horizon, max(pos) + 1 AS size FROM biz GROUP BY 1
  UNION ALL SELECT series_id, 'monthly', 36, unnest([1, 3, 6]), count(DISTINCT date_trunc('month', ds)) FROM biz GROUP BY 1)""", *BUSINESS)  # fmt: skip
def cadence_recipes(spark, sf_dir):
    daily = business_panel(spark, sf_dir)
    months = daily.groupBy("series_id", F.last_day("ds").alias("ds")).agg(F.sum("y").alias("y"))
    months = months.withColumn("pos", F.row_number().over(pn.by_series("ds")) - 1)
    return folds.recipe_targets(daily, "daily").unionByName(folds.recipe_targets(months, "monthly"))


# Integrity


@query("alignment_check", "SELECT p.series_id, p.horizon, 'ok' AS fault, count(*) AS n FROM preds p JOIN biz o ON o.series_id = p.series_id AND o.ds = p.origin_date JOIN biz t ON t.series_id = p.series_id AND t.ds = p.target_date WHERE t.pos - o.pos = p.horizon GROUP BY 1, 2", *FORECASTS)
def alignment_check(spark, sf_dir):
    return integrity.alignment(forecasts(spark, sf_dir), business_panel(spark, sf_dir)).select("series_id", "horizon", "fault", "n")


_SHIFT = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY target_date) AS i FROM preds),
shifts AS (SELECT a.series_id, a.horizon, a.model, CAST(k AS INTEGER) AS shift, avg(abs(b.y_true - a.y_pred)) AS mae, corr(a.y_pred, b.y_true) AS corr FROM numbered a, (SELECT unnest(generate_series(-10, 10)) AS k), numbered b
  WHERE b.series_id = a.series_id AND b.model = a.model AND b.i = a.i + k GROUP BY 1, 2, 3, 4)"""
_DIAGNOSED = f"""best AS (SELECT {_BY}, arg_min(shift, row(mae, shift <> 0, shift)) AS s, min(mae) AS bm, max(mae) FILTER (shift = 0) AS m0, max(mae) FILTER (shift = -5) AS mh FROM shifts GROUP BY 1, 2, 3),
diagnosed AS (SELECT {_BY}, s AS best_shift, CASE WHEN abs(s) <= 1 THEN 'ok' WHEN s = -5 THEN 'persistence_like' WHEN s = -6 THEN 'missing_lag_0' WHEN s < -5 THEN 'backward' WHEN s > 0 THEN 'forward' ELSE 'ok' END AS shift_class,
  CASE WHEN m0 > 0 THEN 100 * (m0 - bm) / m0 ELSE 0 END AS improvement_pct, coalesce(abs(m0 - mh) / greatest(m0, mh, 1) < 0.1, false) AS naive_equivalent FROM best)"""
_COPIES = f"""backs AS (SELECT {_BY}, -shift AS back, round(corr, 6) AS r FROM shifts WHERE abs(shift) <= 3 AND corr IS NOT NULL AND NOT isnan(corr) AND NOT regexp_matches(lower(model), 'baseline|naive|persistence')),
chosen AS (SELECT {_BY}, arg_max(back, row(r, -back)) AS best_shift, max(r) AS corr_best, max(r) FILTER (back = 0) AS corr_0 FROM backs GROUP BY 1, 2, 3),
lagged AS (SELECT {_BY}, count(*) AS n, avg(abs(y_true - y_pred)) AS mae, avg(abs(y_true - b)) AS mae_lag_1 FROM (SELECT *, lag(y_true) OVER (PARTITION BY {_BY} ORDER BY target_date) AS b FROM preds) GROUP BY 1, 2, 3),
copies AS (SELECT c.*, l.mae, l.mae_lag_1, coalesce(c.best_shift <> 0 AND c.corr_best - c.corr_0 > 0.05 AND l.mae >= 0.99 * l.mae_lag_1, false) AS is_copy FROM chosen c JOIN lagged l ON l.series_id = c.series_id AND l.horizon = c.horizon AND l.model = c.model WHERE l.n >= 8)"""


@query("shift_errors", f"SELECT {_BY}, shift, round(mae, 3) AS mae FROM shifts", *FORECASTS, _SHIFT)
def shift_errors(spark, sf_dir):
    return rounded(integrity.shift_errors(forecasts(spark, sf_dir), integrity.reach(5)), 3, "mae").withColumn("shift", F.col("shift").cast("int"))


@query("shift_diagnostic", f"SELECT {_BY}, best_shift, shift_class, round(improvement_pct, 4) AS improvement_pct, naive_equivalent FROM diagnosed", *FORECASTS, _SHIFT, _DIAGNOSED)
def shift_diagnostic(spark, sf_dir):
    out = integrity.shift_diagnostic(forecasts(spark, sf_dir), integrity.reach(5))
    return rounded(out, 4, "improvement_pct").select(*metrics.KEYS, "best_shift", "shift_class", "improvement_pct", "naive_equivalent")


@query("lagged_copy", f"SELECT {_BY}, best_shift, corr_best, corr_0, round(mae, 3) AS mae, round(mae_lag_1, 3) AS mae_lag_1, is_copy FROM copies", *FORECASTS, _SHIFT, _COPIES)
def lagged_copy(spark, sf_dir):
    return rounded(integrity.lagged_copy(forecasts(spark, sf_dir)), 3, "mae", "mae_lag_1")


@query("feature_leakage", """SELECT series_id, feature, count(*) AS n, round(corr(value, target), 5) AS corr, contains(feature, 'shift(-') OR contains(feature, 'lag_-') AS suspicious_name, contains(feature, 'shift(-') OR contains(feature, 'lag_-') OR coalesce(abs(corr(value, target)) > 0.99 AND count(*) > 10, false) AS leaks FROM (
  UNPIVOT (SELECT series_id, pos, lead(y, 5) OVER w AS target, y AS same_day, lag(y, 1) OVER w AS lag_1, lead(y, 2) OVER w AS "lag_-2", lead(y, 5) OVER w AS peek FROM biz WINDOW w AS (PARTITION BY series_id ORDER BY pos)) ON same_day, lag_1, "lag_-2", peek INTO NAME feature VALUE value) WHERE target IS NOT NULL GROUP BY 1, 2""", *BUSINESS)  # fmt: skip
def feature_leakage(spark, sf_dir):
    from ..operators.features import unpivot_features

    rows = pn.horizon_target(business_panel(spark, sf_dir), 5)
    w = pn.by_series()
    rows = rows.withColumns({"same_day": F.col("y"), "lag_1": F.lag("y", 1).over(w), "lag_-2": F.lead("y", 2).over(w), "peek": F.lead("y", 5).over(w)})
    return rounded(integrity.feature_leakage(unpivot_features(rows, ["same_day", "lag_1", "lag_-2", "peek"]), rows.where("target IS NOT NULL")), 5, "corr")


@query("temporal_leaks", f"SELECT {_BY}, count(*) FILTER (origin_date >= target_date) AS n_leaks FROM preds GROUP BY 1, 2, 3", *FORECASTS)
def temporal_leaks(spark, sf_dir):
    return integrity.temporal_leaks(forecasts(spark, sf_dir))


_FS = """fs AS (SELECT p.series_id, model, fold_id, avg(abs(y_true - y_pred)) AS mae FROM preds p JOIN folds f ON f.series_id = p.series_id AND p.target_date BETWEEN f.eval_start AND f.eval_end GROUP BY 1, 2, 3 HAVING count(*) >= 2),
tr AS (SELECT p.series_id, model, fold_id, avg(abs(y_true - y_pred)) AS train_mae FROM preds p JOIN folds f ON f.series_id = p.series_id AND p.target_date <= f.train_end GROUP BY 1, 2, 3),
fr AS (SELECT fs.*, fs.mae / nullif(train_mae, 0) AS ratio, row_number() OVER (PARTITION BY fs.series_id, fs.model ORDER BY fs.fold_id) - 1.0 AS k FROM fs LEFT JOIN tr ON tr.series_id = fs.series_id AND tr.model = fs.model AND tr.fold_id = fs.fold_id),
st AS (SELECT series_id, model, count(*) AS n_folds, avg(mae) AS mean_mae, stddev_samp(mae) / avg(mae) AS cv, CASE WHEN count(*) >= 3 THEN regr_slope(mae, k) * (count(*) - 1) / avg(mae) END AS slope, max(ratio) AS worst_ratio, min(ratio) AS least_ratio FROM fr GROUP BY 1, 2)"""


@query("fold_stability", """SELECT series_id, model, n_folds, round(mean_mae, 3) AS mean_mae, round(cv, 6) AS cv, round(slope, 6) AS slope, round(worst_ratio, 6) AS worst_ratio,
  CASE WHEN cv > 0.5 OR slope > 0.5 OR worst_ratio > 2 THEN 'high' WHEN cv > 0.3 OR slope > 0.25 OR least_ratio < 0.5 THEN 'medium' ELSE 'low' END AS risk FROM st""", *FORECASTS, _FOLDS, _FS)  # fmt: skip
def fold_stability(spark, sf_dir):
    preds, years = forecasts(spark, sf_dir), _folds(spark, sf_dir)
    rows = folds.fold_rows(preds, years, "target_date")
    before = preds.join(years.select(F.col("series_id").alias("s"), "fold_id", "train_end"), (F.col("series_id") == F.col("s")) & (F.col("target_date") <= F.col("train_end")))
    training = before.groupBy("series_id", "model", "fold_id").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("train_mae"))
    return rounded(rounded(integrity.fold_stability(rows, training), 3, "mean_mae"), 6, "cv", "slope", "worst_ratio")


_RATIO = "tv AS (SELECT model, avg(abs(y_true - y_pred)) FILTER (year(target_date) = 1999) AS tm, avg(abs(y_true - y_pred)) FILTER (year(target_date) = 2000) AS vm FROM preds GROUP BY 1)"


@query("best_model", f"""SELECT series_id, horizon, arg_min(model, row(o, mae)) AS best, min(o) = 1 AS fell_back FROM (SELECT e.*, CASE WHEN CASE WHEN tm = 0 THEN 'inf'::DOUBLE ELSE vm / tm END > 1.02 THEN 1 ELSE 0 END AS o
  FROM (SELECT {_BY}, avg(abs(y_true - y_pred)) AS mae FROM preds GROUP BY 1, 2, 3) e JOIN tv ON tv.model = e.model) GROUP BY 1, 2""", *FORECASTS, _RATIO)  # fmt: skip
def best_model(spark, sf_dir):
    rows = forecasts(spark, sf_dir)
    e = F.abs(F.col("y_true") - F.col("y_pred"))
    scores = rows.groupBy("model").agg(F.avg(F.when(F.year("target_date") == 1999, e)).alias("train_mae"), F.avg(F.when(F.year("target_date") == 2000, e)).alias("val_mae")).withColumn("fold_id", F.lit(1))
    return integrity.best_model(ensemble.model_errors(rows), integrity.overfit_ratios(scores), 1.02)


_RAW = """raw AS (SELECT series_id, CASE WHEN y % 97 = 0 THEN 'n/a' ELSE CAST(ds AS VARCHAR) END AS day, CASE WHEN y % 89 = 0 THEN 'unknown' WHEN y % 83 = 0 THEN NULL ELSE CAST(y AS VARCHAR) END AS amount FROM panel),
parsed AS (SELECT series_id, TRY_CAST(day AS DATE) AS ds, amount, TRY_CAST(amount AS DOUBLE) AS v FROM raw),
judged AS (SELECT *, ds - lag(ds) OVER (PARTITION BY series_id ORDER BY ds NULLS FIRST) AS gap FROM parsed),
zs AS (SELECT series_id, count(*) FILTER (n >= 20 AND sd > 0 AND abs((v - m) / sd) > 4) AS n_outliers FROM (SELECT series_id, v, count(*) OVER w AS n, avg(v) OVER w AS m, stddev_samp(v) OVER w AS sd FROM parsed WHERE v IS NOT NULL AND ds IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) GROUP BY 1),
flight AS (SELECT series_id, count(*) AS n_rows, count(*) FILTER (ds IS NULL) AS n_undated, min(ds) AS first_day, max(ds) AS last_day, count(v) AS n_values, count(*) FILTER (v IS NULL AND amount IS NOT NULL) AS n_text, count(*) FILTER (v IS NULL) AS n_missing,
  stddev_samp(v) AS sd, count(*) FILTER (gap = 0) AS n_repeated, count(*) FILTER (gap > 5) AS n_gaps, CAST(max(gap) AS INTEGER) AS longest_gap FROM judged GROUP BY 1)"""


@query("preflight", """SELECT f.series_id, n_rows, n_undated, first_day, last_day, n_values, n_text, n_missing, round(sd, 2) AS std, n_repeated, n_gaps, longest_gap, coalesce(n_outliers, 0) AS n_outliers, concat_ws(',', CASE WHEN n_text > 0.5 * n_rows THEN 'not_numeric' END, CASE WHEN n_values < 45 THEN 'too_short' END, CASE WHEN sd = 0 THEN 'constant' END) AS blockers,
  concat_ws(',', CASE WHEN n_undated > 0 THEN 'undated_rows' END, CASE WHEN 100 * n_missing > 5 * n_rows THEN 'missing_values' END, CASE WHEN n_repeated > 0 THEN 'repeated_dates' END, CASE WHEN n_gaps > 0 THEN 'gaps' END, CASE WHEN n_values > 60 AND n_outliers > 0 THEN 'outliers' END) AS warnings FROM flight f LEFT JOIN zs ON zs.series_id = f.series_id""", PANEL, _RAW)  # fmt: skip
def preflight(spark, sf_dir):
    """Order values as text, some without a date, some that aren't numbers, some missing."""
    y = F.col("y")
    raw = order_panel(spark, sf_dir).select("series_id", F.when(y % 97 == 0, "n/a").otherwise(F.col("ds").cast("string")).alias("day"), F.when(y % 89 == 0, "unknown").when(y % 83 != 0, F.format_string("%.1f", "y")).alias("amount"))
    out = integrity.preflight(raw, "day", "amount", 5)
    return rounded(out, 2, "std").select("series_id", "n_rows", "n_undated", "first_day", "last_day", "n_values", "n_text", "n_missing", "std", "n_repeated", "n_gaps", "longest_gap", "n_outliers", "blockers", "warnings")


@query("freshness", "SELECT series_id, max(ds) AS last_day, CAST(DATE '2001-08-10' - max(ds) AS INTEGER) AS age_days, DATE '2001-08-10' - max(ds) > 7 AS is_stale FROM panel GROUP BY 1", PANEL)
def freshness(spark, sf_dir):
    return integrity.freshness(order_panel(spark, sf_dir), "2001-08-10")


# Ensembles and gates


_ENS = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY mae, model) AS place FROM (SELECT {_BY}, avg(abs(y_true - y_pred)) AS mae FROM preds GROUP BY 1, 2, 3)),
ens AS (SELECT p.series_id, p.horizon, target_date, y_true, median(y_pred) AS p_median, avg(y_pred) FILTER (place <= 2) AS p_top, sum(y_pred / greatest(mae, 1e-9)) / sum(1 / greatest(mae, 1e-9)) AS p_weighted, avg(y_lo) AS y_lo FROM preds p JOIN ranked r ON r.series_id = p.series_id AND r.horizon = p.horizon AND r.model = p.model GROUP BY 1, 2, 3, 4)"""


@query("ensembles", """SELECT series_id, horizon, target_date, model, round(y_pred, 3) AS y_pred, round(y_lo, 2) AS y_lo FROM (SELECT *, 'ensemble_median' AS model, p_median AS y_pred FROM ens UNION ALL SELECT *, 'ensemble_top', p_top FROM ens UNION ALL SELECT *, 'ensemble_weighted', p_weighted FROM ens)""", *FORECASTS, _ENS)
def ensembles(spark, sf_dir):
    out = ensemble.ensembles(forecasts(spark, sf_dir), 2)
    return rounded(rounded(out, 3, "y_pred"), 2, "y_lo").select("series_id", "horizon", "target_date", "model", "y_pred", "y_lo")


@query("podium", f"""SELECT {_BY}, round(mae, 3) AS mae, CAST(place AS INTEGER) AS place, round(CASE WHEN nx > 0 THEN 100 * (nx - mae) / nx END, 4) AS better_pct FROM (SELECT *, lead(mae) OVER (PARTITION BY series_id, horizon ORDER BY mae, model) AS nx FROM ranked) WHERE place <= 3""", *FORECASTS, _ENS)
def podium(spark, sf_dir):
    return rounded(rounded(ensemble.podium(forecasts(spark, sf_dir)), 3, "mae"), 4, "better_pct").withColumn("place", F.col("place").cast("int"))


_CARD = f"""cards AS (SELECT p.{_BY.replace(', ', ', p.')}, count(*) AS n, avg(abs(y_true - y_pred)) AS mae, avg(2 * abs(y_true - y_pred) / (abs(y_true) + abs(y_pred) + 1e-9)) AS smape, CASE WHEN var_pop(y_true) > 0 THEN 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) END AS r2,
  avg(CASE WHEN y_lo IS NOT NULL THEN CASE WHEN y_true BETWEEN y_lo AND y_hi THEN 1.0 ELSE 0.0 END END) AS coverage, 100 * (avg(abs(y_true - origin_value)) - avg(abs(y_true - y_pred))) / avg(abs(y_true - origin_value)) AS skill, any_value(t.monthly_tol10) AS tol
  FROM preds p JOIN tol t ON t.series_id = p.series_id AND t.horizon = p.horizon AND t.model = p.model GROUP BY 1, 2, 3),
graded AS (SELECT c.*, d.best_shift, CASE WHEN r2 IS NULL THEN 'N/A' WHEN smape < 0.05 AND r2 > 0.95 THEN 'A' WHEN smape < 0.1 AND r2 > 0.85 THEN 'B' WHEN smape < 0.2 AND r2 > 0.7 THEN 'C' WHEN smape < 0.35 AND r2 > 0.5 THEN 'D' ELSE 'F' END AS letter,
  row_number() OVER (PARTITION BY c.series_id, c.horizon ORDER BY regexp_matches(lower(c.model), 'baseline|persistence'), mae, c.model) AS place FROM cards c JOIN diagnosed d ON d.series_id = c.series_id AND d.horizon = c.horizon AND d.model = c.model)"""


@query("scorecard", """SELECT series_id, horizon, model AS best, n, round(mae, 3) AS mae, round(smape, 6) AS smape, round(r2, 5) AS r2, round(tol, 6) AS monthly_tol10, round(coverage, 6) AS coverage, round(skill, 4) AS skill, CASE WHEN skill < 5 THEN 'F' ELSE letter END AS grade, coalesce(skill < 5, false) AS gate_failed,
  concat_ws(',', CASE WHEN skill < 0 THEN 'worse_than_persistence' END, CASE WHEN skill >= 0 AND skill < 5 THEN 'below_gate' END, CASE WHEN skill < 5 AND best_shift <> 0 THEN 'shifted' END, CASE WHEN r2 < 0 THEN 'negative_r2' END, CASE WHEN coverage < 0.8 THEN 'narrow_intervals' END, CASE WHEN tol < 0.5 THEN 'poor_months' END) AS flags,
  concat_ws(',', CASE WHEN letter IN ('D', 'F') THEN 'low_accuracy' END, CASE WHEN letter = 'C' THEN 'room_to_improve' END, CASE WHEN coverage > 0.98 THEN 'wide_intervals' END, CASE WHEN tol >= 0.8 THEN 'good_months' END) AS tips, CASE WHEN letter IN ('A', 'B') THEN 'ensemble_of_best' ELSE 'compare_models' END AS next_steps
  FROM graded WHERE place = 1""", *FORECASTS, _TOL, _SHIFT, _DIAGNOSED, _CARD)  # fmt: skip
def scorecard(spark, sf_dir):
    rows = forecasts(spark, sf_dir)
    out = ensemble.recommend(rows, integrity.shift_diagnostic(rows, integrity.reach(5)), folds=3).drop("rmse", "mape", "width")
    return rounded(rounded(rounded(rounded(out, 3, "mae"), 5, "r2"), 6, "smape", "coverage", "monthly_tol10"), 4, "skill")


@query("interval_gate", """SELECT series_id, horizon, count(*) FILTER (ok) AS n_passed, arg_min(model, row(NOT ok, mae)) AS best FROM (SELECT *, coalesce(skill >= 5 AND coverage BETWEEN 0.7 AND 0.9, false) AS ok FROM scores) GROUP BY 1, 2""", *FORECASTS, _TOL, _SCORES)
def interval_gate(spark, sf_dir):
    return ensemble.interval_gate(metrics.block(forecasts(spark, sf_dir)))


@query("quality_gate", f"SELECT {_BY}, round(skill, 4) AS skill, CASE WHEN coalesce(skill, -1) >= 5 THEN 'OK' ELSE 'FAILED_QUALITY' END AS status FROM scores", *FORECASTS, _TOL, _SCORES)
def quality_gate(spark, sf_dir):
    return rounded(ensemble.quality_gate(metrics.block(forecasts(spark, sf_dir))), 4, "skill")


_FAMILIES = f"""checked AS (SELECT s.*, CASE s.model WHEN 'naive_last' THEN 'naive' ELSE 'average' END AS family, l.leaks, d.shift_class <> 'ok' OR d.naive_equivalent OR coalesce(c.is_copy, false) AS shifted FROM scores s
  JOIN (SELECT {_BY}, count(*) FILTER (origin_date >= target_date) > 0 AS leaks FROM preds GROUP BY 1, 2, 3) l ON l.series_id = s.series_id AND l.model = s.model JOIN diagnosed d ON d.series_id = s.series_id AND d.model = s.model LEFT JOIN copies c ON c.series_id = s.series_id AND c.model = s.model),
firsts AS (SELECT *, row_number() OVER (PARTITION BY series_id, horizon, family ORDER BY mae, model) AS place FROM checked),
fam AS (SELECT series_id, horizon, family, count(*) AS n, max(CASE WHEN place = 1 THEN model END) AS best, max(CASE WHEN place = 1 THEN skill END) AS best_skill, max(CASE WHEN place = 1 THEN coverage END) AS coverage, bool_or(leaks) AS leaks, bool_or(shifted) AS shifted FROM firsts GROUP BY 1, 2, 3),
verdicts AS (SELECT * EXCLUDE (leaks, shifted), CASE WHEN reasons = '' THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT *, concat_ws(',', CASE WHEN coalesce(best_skill < 5, true) THEN 'failed_quality' END, CASE WHEN leaks THEN 'leakage' END, CASE WHEN shifted THEN 'persistence_like' END) AS reasons FROM fam)),
named AS (SELECT family, best, row_number() OVER (PARTITION BY family ORDER BY count(*) DESC, best) AS place FROM verdicts GROUP BY 1, 2)"""


def _verdict_inputs(spark, sf_dir):
    rows, families = forecasts(spark, sf_dir), {"naive_last": "naive", "weekday_mean": "average", "moving_average_20": "average"}
    return metrics.block(rows), families, ensemble.model_checks(rows, integrity.reach(5))


@query("family_verdicts", "SELECT series_id, horizon, family, n, best, round(best_skill, 4) AS best_skill, round(coverage, 6) AS coverage, reasons, verdict FROM verdicts", *FORECASTS, _TOL, _SCORES, _SHIFT, _DIAGNOSED, _COPIES, _FAMILIES)
def family_verdicts(spark, sf_dir):
    return rounded(rounded(ensemble.family_verdicts(*_verdict_inputs(spark, sf_dir)), 4, "best_skill"), 6, "coverage")


@query("family_summary", """SELECT v.family, count(*) AS n, count(*) FILTER (verdict = 'pass') AS n_passed, any_value(n.best) AS best, round(median(best_skill), 4) AS best_skill, round(avg(coverage), 6) AS coverage,
  concat_ws(',', """ + ", ".join(f"CASE WHEN count(*) FILTER (list_contains(string_split(reasons, ','), '{r}')) > 0 THEN '{r}:' || CAST(count(*) FILTER (list_contains(string_split(reasons, ','), '{r}')) AS VARCHAR) END" for r in ensemble.REASONS) + """) AS reasons,
  CASE WHEN count(*) FILTER (verdict = 'fail') = count(*) THEN 'fail' WHEN count(*) FILTER (verdict = 'pass') = count(*) THEN 'pass' ELSE 'partial' END AS verdict FROM verdicts v JOIN named n ON n.family = v.family AND n.place = 1 GROUP BY 1""", *FORECASTS, _TOL, _SCORES, _SHIFT, _DIAGNOSED, _COPIES, _FAMILIES)  # fmt: skip
def family_summary(spark, sf_dir):
    return rounded(rounded(ensemble.family_summary(*_verdict_inputs(spark, sf_dir)), 4, "best_skill"), 6, "coverage")


@query("best_by_run", f"SELECT series_id, horizon, arg_min(model, row(mae, model)) AS best, round(min(mae), 3) AS mae FROM ranked GROUP BY 1, 2", *FORECASTS, _ENS)
def best_by_run(spark, sf_dir):
    return rounded(ensemble.best_by_run(forecasts(spark, sf_dir)), 3, "mae")


_WEEKLY = f"""wp AS (SELECT {_BY}, CAST(target_date + CAST((5 - isodow(target_date) + 7) % 7 AS INTEGER) AS DATE) AS week, sum(y_true) AS y_true, sum(y_pred) AS y_pred, sum(origin_value) AS origin_value FROM preds GROUP BY 1, 2, 3, 4)"""


@query("weekly_rollup", f"SELECT {_BY}, count(*) AS n, round(avg(abs(y_true - y_pred)), 3) AS mae, CAST(row_number() OVER (PARTITION BY series_id, horizon ORDER BY avg(abs(y_true - y_pred)), model) AS INTEGER) AS rank FROM wp GROUP BY 1, 2, 3", *FORECASTS, _WEEKLY)
def weekly_rollup(spark, sf_dir):
    from pyspark.sql import Window

    weeks = forecasts(spark, sf_dir).groupBy(*metrics.KEYS, pn.bucket_end("weekly", "target_date").alias("week")).agg(F.sum("y_true").alias("y_true"), F.sum("y_pred").alias("y_pred"))
    out = weeks.groupBy(*metrics.KEYS).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))
    place = F.row_number().over(Window.partitionBy("series_id", "horizon").orderBy("mae", "model"))
    return rounded(out.withColumn("rank", place.cast("int")), 3, "mae")


@query("forecast_union", f"SELECT model, count(*) AS n, count(DISTINCT target_date) AS n_days FROM (SELECT model, target_date FROM preds UNION ALL SELECT 'shipped', CAST(l_shipdate AS DATE) FROM lineitem) GROUP BY 1", *FORECASTS)
def forecast_union(spark, sf_dir):
    shipped = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit("shipped").alias("model"), F.to_date("l_shipdate").alias("target_date"))
    rows = forecasts(spark, sf_dir).select("model", "target_date").unionByName(shipped)
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("target_date").alias("n_days"))


@query("weekday_mean_h3", """SELECT series_id, origin_date, round(y_pred, 4) AS y_pred FROM (SELECT b.series_id, b.ds AS origin_date, (SELECT avg(x.y) FROM biz x WHERE x.series_id = b.series_id AND x.pos <= b.pos AND isodow(x.ds) = isodow(b.t)) AS y_pred
  FROM (SELECT *, lead(ds, 3) OVER (PARTITION BY series_id ORDER BY pos) AS t FROM biz) b WHERE b.t >= DATE '2001-01-01')""", *BUSINESS)  # fmt: skip
def weekday_mean_h3(spark, sf_dir):
    return rounded(forecasts(spark, sf_dir, 3, "2001-01-01").where("model = 'weekday_mean'").select("series_id", "origin_date", "y_pred"), 4, "y_pred")
