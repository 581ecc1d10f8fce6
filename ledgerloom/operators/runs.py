"""One run from a panel to a report, ablations by feature group, guards and small checks around runs."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import runlog
from . import baselines, ensemble, integrity, metrics, models

#: Feature groups by prefix of the columns that ``models.supervised`` makes.
GROUPS = {"lags": ("lag_", "now"), "rolling": ("mean_", "std_"), "calendar": ("dow", "dom", "month")}


def read_holdout(panel: DataFrame, first: str, last: str, reason: str | None, log: str) -> DataFrame:
    """Rows of the locked window: refused without a reason, else each read is logged."""
    if not (reason or "").strip():
        raise PermissionError(f"the window {first} to {last} is locked; state a reason to read it")
    panel.sparkSession.range(1).select(F.current_timestamp().alias("at"), F.lit(first).alias("first"), F.lit(last).alias("last"), F.lit(reason).alias("reason")).write.mode("append").json(log)
    return panel.where(F.col("ds").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def check_documents(preds: DataFrame, panel: DataFrame, most: int, signal: DataFrame | None = None) -> DataFrame:
    """All checks of a run, a nested document for each series (``runlog.REPORT``).

    :param signal: ``series_id, has_signal`` of the control, if it was run.

    A document lists a series' models and horizons, which are few, sorted.
    """
    keys = metrics.KEYS
    shift = integrity.shift_diagnostic(preds, most).select(*keys, F.struct(F.col("best_shift").cast("int").alias("best"), F.col("shift_class").alias("class"), "naive_equivalent").alias("shift"))
    copy = integrity.lagged_copy(preds).select(*keys, F.struct(F.col("best_shift").cast("int").alias("best"), "is_copy").alias("copy"))
    checks = integrity.temporal_leaks(preds).join(shift, keys, "left").join(copy, keys, "left")
    models_of = checks.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("model", F.col("horizon").cast("int").alias("horizon"), "shift", "copy", "n_leaks"))).alias("models"))
    faulty = F.col("fault") != "ok"
    at = integrity.alignment(preds, panel).groupBy("series_id").agg(F.struct(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(faulty, F.col("n"))), F.lit(0).cast("long")).alias("faulty"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("examples")))).alias("examples")).alias("aligned"))
    out = models_of.join(at, "series_id", "left")
    out = out.withColumn("has_signal", F.lit(None).cast("boolean")) if signal is None else out.join(signal.select("series_id", "has_signal"), "series_id", "left")
    return out.select("series_id", "aligned", "has_signal", "models")


def first_columns(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Keys and the first ``n`` other columns."""
    return rows.select(*keys, *[c for c in rows.columns if c not in keys][:n])


def drop_raw_year(rows: DataFrame) -> DataFrame:
    """Features without a calendar year, which would let a tree learn the trend by heart."""
    return rows.drop("year", "Year", "YEAR")


def schema_difference(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns that only one side has, and those whose types differ."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return {"missing": sorted(set(x) - set(y)), "extra": sorted(set(y) - set(x)), "changed": sorted(c for c in x.keys() & y.keys() if x[c] != y[c])}


def log_times(lines: DataFrame, key: str, text: str) -> DataFrame:
    """First and last time stamp in each log's lines, and the seconds between them; lines without one don't count."""
    at = F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)", 1), F.lit("")))
    out = lines.select(F.col(key).alias("log"), at.alias("at")).groupBy("log").agg(F.min("at").alias("started"), F.max("at").alias("finished"))
    return out.withColumn("seconds", F.unix_timestamp("finished") - F.unix_timestamp("started"))


def ablation(panel: DataFrame, train_end, start, end, horizon: int, model: str = "ridge", groups: dict = GROUPS) -> DataFrame:
    """MAE with all feature groups and without each one, and the change that leaving it out makes."""
    rows, names = models.supervised(panel, horizon)
    rows = rows.where("label IS NOT NULL")
    scored = rows.where(F.col("target_date").between(F.lit(start), F.lit(end)))
    # Labels known by the first scored origin only.
    first = scored.agg(F.min("origin_date")).first()[0]
    train = rows.where(F.col("target_date") <= F.lit(min(train_end, first) if first else train_end)).persist()
    cases = {without: [n for n in names if without is None or not n.startswith(groups[without])] for without in (None, *groups)}
    made = models.together([lambda kept=kept: models.pipeline(kept, models.estimators()[model]).fit(train) for kept in cases.values()])
    train.unpersist()
    out = None
    for (without, kept), fitted in zip(cases.items(), made):
        own = fitted.transform(scored).agg(F.lit(without or "nothing").alias("without"), F.lit(len(kept)).alias("n_features"), F.avg(F.abs(F.col("y_true") - F.col("raw"))).alias("mae"))
        out = own if out is None else out.unionByName(own)
    whole = F.max(F.when(F.col("without") == "nothing", F.col("mae"))).over(Window.partitionBy())
    return out.withColumn("change_pct", 100 * (F.col("mae") - whole) / whole)


FAMILIES = {"naive_last": "naive", "weekday_mean": "average", "moving_average_20": "average", "ets": "statistical", "theta": "statistical", "arx": "statistical", "seasonal_ar": "statistical"}
FAMILIES |= {"ridge": "fitted", "random_forest": "fitted", "boosted_l2": "fitted", "quantile_forest": "quantile"}


def daily_run(panel: DataFrame, horizon: int, since: str, out: str, params: dict[str, str] | None = None, folds: list[tuple] | None = None) -> DataFrame:
    """All families in one application: forecasts, ensembles, scores, board and log are written below ``out``; the family summary is returned.

    ``folds`` (as ``models.fold_forecasts`` has them) cover the targets from
    ``since`` on; without them the fitted and quantile families, which must be
    trained, are left out. All models forecast the same targets. Statistical
    models have bounds from the residuals of the year before. What several
    tables read is written once and read back, partitioned by family.
    """
    spark = panel.sparkSession
    scored = F.col("target_date") >= F.lit(since).cast("date")
    windows = baselines.window_forecasts(panel, horizon).where(scored)
    first = windows.agg(F.min("origin_date")).first()[0]
    before = spark.range(1).select(F.add_months(F.lit(since).cast("date"), -12)).first()[0].isoformat()
    grouped = models.grouped_forecasts(panel, horizon, [n for n, f in FAMILIES.items() if f == "statistical"], before)
    members = windows.unionByName(models.residual_bands(grouped, first).where(scored).select(*windows.columns))
    if folds:
        none = {"y_lo": F.lit(None).cast("double"), "y_hi": F.lit(None).cast("double")}
        fitted = models.fold_forecasts(panel, folds, horizon, [n for n, f in FAMILIES.items() if f == "fitted"]).withColumns(none)
        members = members.unionByName(fitted.where(scored).select(*windows.columns))
        for _, *dates in folds:
            own = models.quantile_forest(panel, *dates, horizon).withColumns({"model": F.lit("quantile_forest"), "horizon": F.lit(horizon)})
            own = own.withColumnsRenamed({"p50": "y_pred", "p10": "y_lo", "p90": "y_hi"})
            members = members.unionByName(own.where(scored).select(*windows.columns))
    members.write.parquet(f"{out}/members")
    members = spark.read.parquet(f"{out}/members")
    rows = members.unionByName(ensemble.ensembles(members).select(*windows.columns))
    family = F.coalesce(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])[F.col("model")], F.lit("ensemble"))
    runlog.write_table(rows.withColumn("family", family), f"{out}/predictions", "family")
    preds = spark.read.parquet(f"{out}/predictions").drop("family")
    scores = metrics.block(preds)
    runlog.write_table(scores, f"{out}/metrics", "model")
    scores = spark.read.parquet(f"{out}/metrics").select(scores.columns)
    board = metrics.leaderboard(preds)
    runlog.append_log(runlog.log_rows(board, params or {}), f"{out}/log")
    checks = ensemble.model_checks(preds, integrity.reach(horizon))
    signal = None
    if folds:  # whether features tell anything, by series
        signal = models.signal_control(panel, folds[0][1], horizon, by=["series_id"]).groupBy("series_id").agg(F.bool_or("has_signal").alias("has_signal"))
        checks = checks.join(signal, "series_id", "left")
    runlog.write_report(check_documents(preds, panel, integrity.reach(horizon), signal), f"{out}/checks")
    return ensemble.family_summary(scores, FAMILIES | {f"ensemble_{n}": "ensemble" for n in ("median", "top", "weighted")}, checks)


def report(summary: DataFrame, title: str = "Run") -> str:
    """The family summary as a Markdown table, a row for each family with the summary's own columns, and how many families have each verdict."""
    rows = [r.asDict() for r in summary.orderBy("family").collect()]  # a row for each family
    show = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + "---|" * len(summary.columns)]
    lines += ["| " + " | ".join(show(r[c]) for c in summary.columns) + " |" for r in rows]
    counts = Counter(r["verdict"] for r in rows)
    return "\n".join([*lines, "", ", ".join(f"{v}: {counts[v]}" for v in ("pass", "partial", "fail", "unverified"))])
