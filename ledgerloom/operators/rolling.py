"""Statistical forecasters that are refitted at every origin, by a state that is carried from value to value.

A series is cut into blocks, so that a long one spreads over tasks. What a block
does to a state is summed up without knowing the state: sums are added; a
smoother's recursion is affine in its state and its squared errors quadratic, so
running it from a few states tells what it does to any. A scan over the
summaries, a row for each block, gives every block the state that it starts
with, and all blocks forecast at the same time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEASON = 5
#: Values before a block that forecasters read; a block with fewer before it is part of the first one.
LOOKBACK = 80
#: Positions of a block.
BLOCK = 16_384

#: By name: (values, horizon) -> forecasts of the next steps. A plug-in needs no more than this.
Forecaster = Callable[[np.ndarray, int], np.ndarray]
REGISTRY: dict[str, Forecaster] = {}
ROLLING: dict[str, "Rolling"] = {}


def register(name: str):
    """Register a forecaster without a rolling form; it is refitted from scratch at each origin, a series in one task."""

    def add(f: Forecaster) -> Forecaster:
        REGISTRY[name] = f
        return f

    return add


def rolling(name: str):
    """Register a forecaster in its rolling form; its plain one follows."""

    def add(kind: type[Rolling]) -> type[Rolling]:
        f = ROLLING[name] = kind()
        REGISTRY[name] = lambda y, h: np.array([f(y, k, np.array([len(y)]))[0] for k in range(1, h + 1)])
        return kind

    return add


def _mean_of_last(y: np.ndarray, n: int, season: int) -> float:
    return y[max(0, n - season) : n].mean()


class Rolling:
    """A forecaster by blocks. ``y``: the block's values, ``before``: the last ``LOOKBACK`` ones before it, ``n0``: how many there are before it (0: the first block, which has at least ``LOOKBACK`` unless it is the only one).

    ``calendar`` has a row of regressors for each value, ``ahead`` those of the steps after each origin; both may be None.
    """

    def summary(self, y: np.ndarray, before: np.ndarray, n0: int, calendar: np.ndarray | None = None) -> np.ndarray:
        """What the block does to a state, as one row of numbers."""
        return np.zeros(0)

    def advance(self, state: np.ndarray | None, summary: np.ndarray) -> np.ndarray:
        """The state after the block; ``state`` is None before the first one."""
        return summary

    def forecast(self, y, before, n0, state, h, ends, calendar=None, ahead=None) -> np.ndarray:
        """Forecast ``h`` steps on from each origin; ``ends`` counts the block's values up to it."""
        raise NotImplementedError

    def __call__(self, y: np.ndarray, h: int, ends: np.ndarray, calendar=None, ahead=None) -> np.ndarray:
        """A whole series as one block."""
        return self.forecast(y, np.zeros(0), 0, None, h, ends, calendar, ahead)


@rolling("naive_last")
class NaiveLast(Rolling):
    def forecast(self, y, before, n0, state, h, ends, calendar=None, ahead=None):
        return y[ends - 1]


class Smoother(Rolling):
    """Variants side by side whose states are affine in earlier ones; each variant's squared one-step errors are summed.

    States have the shape (ways, variants, ``dims``): ways in are run together.
    """

    variants: int
    dims: int

    def begin(self, y: np.ndarray) -> tuple[np.ndarray, int]:
        """State of each variant from the series' first values, and how many of them it took."""
        raise NotImplementedError

    def step(self, x: np.ndarray, v: float, t: int) -> np.ndarray:
        """Takes the value numbered ``t`` into the states, in place; returns its errors (ways, variants)."""
        raise NotImplementedError

    def _run(self, y: np.ndarray, t: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gram = np.zeros((len(x), len(x), self.variants))
        for i, v in enumerate(y):
            e = self.step(x, v, t + i)
            e[1:] -= e[0]
            gram += e[:, None] * e[None, :]
        return x, gram

    def summary(self, y, before, n0, calendar=None):
        if n0 == 0:
            x, t = self.begin(y)
            x, gram = self._run(y[t:], t, x[None].copy())
            return np.concatenate([x[0].ravel(), gram[0, 0]])
        # From a state near those to come, and from that moved along each axis.
        x = np.zeros((1 + self.dims, self.variants, self.dims))
        x[:, :, 0] = middle = before.mean()
        x[np.arange(1, 1 + self.dims), :, np.arange(self.dims)] += 1
        x, gram = self._run(y, n0, x)
        x[1:] -= x[0]
        return np.concatenate([[middle], x.ravel(), gram.ravel()])

    def advance(self, state, summary):
        if state is None:
            return summary
        ways, cells = 1 + self.dims, self.variants * self.dims
        x, gram = summary[1 : 1 + ways * cells].reshape(ways, self.variants, self.dims), summary[1 + ways * cells :].reshape(ways, ways, self.variants)
        off = state[:cells].reshape(self.variants, self.dims).copy()
        off[:, 0] -= summary[0]
        one = np.concatenate([np.ones((self.variants, 1)), off], axis=1)
        return np.concatenate([np.einsum("kw,wkd->kd", one, x).ravel(), state[cells:] + np.einsum("kv,vwk,kw->k", one, gram, one)])

    def _visit(self, y: np.ndarray, n0: int, state: np.ndarray | None, wanted: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of values, states and squared errors so far, at each of the wanted ones."""
        cells = self.variants * self.dims
        if state is None:
            x, t = self.begin(y)
            x, sse = x[None].copy(), np.zeros(self.variants)
            if t in wanted:
                yield t, x[0], sse
        else:
            x, sse, t = state[:cells].reshape(1, self.variants, self.dims).copy(), state[cells:].copy(), 0
        last = max(wanted, default=0)
        for i in range(t, last):
            e = self.step(x, y[i], n0 + i)[0]
            sse += e * e
            if i + 1 in wanted:
                yield i + 1, x[0], sse


@rolling("ets")
class ExponentialSmoothing(Smoother):
    """Level alone, with a damped trend, or with trend and additive season, each over a grid of weights; at an origin that with the least AIC of its one-step errors so far is taken."""

    def __init__(self, season: int = SEASON):
        grid = [(a, 0.0, 0.0, 0, 2) for a in (0.1, 0.3, 0.6, 0.9)]
        grid += [(a, b, 0.0, 0, 5) for a in (0.1, 0.3, 0.6) for b in (0.05, 0.2)]
        grid += [(a, b, g, 1, 6 + season) for a in (0.1, 0.3, 0.6) for b in (0.0, 0.1) for g in (0.05, 0.1, 0.3)]
        self.a, self.b, self.g, self.seasonal, self.params = (np.array(x) for x in zip(*grid))
        self.damping = np.where(self.params > 2, 0.9, 0.0)
        self.season, self.variants, self.dims = season, len(grid), 2 + season

    def begin(self, y):
        first = y[: self.season].mean()
        x = np.zeros((self.variants, self.dims))
        x[:, 0] = first
        x[:, 2 : 2 + len(y[: self.season])] = (y[: self.season] - first) * self.seasonal[:, None]
        return x, min(len(y), self.season)

    def step(self, x, v, t):
        k = 2 + t % self.season
        level = x[:, :, 0] + self.damping * x[:, :, 1]
        e = v - (level + x[:, :, k])
        x[:, :, 0] = level + self.a * e
        x[:, :, 1] = self.damping * x[:, :, 1] + self.a * self.b * e
        x[:, :, k] += self.g * (1 - self.a) * e
        return e

    def forecast(self, y, before, n0, state, h, ends, calendar=None, ahead=None):
        damped = np.array([sum(d**j for j in range(1, h + 1)) for d in self.damping])
        early = [int(n) for n in ends if n0 + n < 3 * self.season]  # the first block's
        found = {n: _mean_of_last(y, n, self.season) for n in early}
        for n, x, sse in self._visit(y, n0, state, {int(n) for n in ends} - set(early)):
            m = n0 + n - self.season
            best = int((m * np.log(np.maximum(sse, 1e-12) / m) + 2 * self.params).argmin())
            found[n] = x[best, 0] + x[best, 1] * damped[best] + x[best, 2 + (n0 + n - 1 + h) % self.season]
        return np.array([found[int(n)] for n in ends])


@rolling("theta")
class Theta(Smoother):
    """Exponential smoothing of the deseasonalised values, with the weight of least squared errors so far, plus half of their linear trend and the season.

    The season of a value is what the mean of its phase was above the mean of
    all, as known before it. States: level, sums by phase, first value, sums of
    the deseasonalised values less the first, plain and by their number.
    """

    def __init__(self, season: int = SEASON):
        self.weights = np.array([0.1, 0.2, 0.3, 0.5, 0.7])
        self.season, self.variants, self.dims = season, len(self.weights), 1 + season + 3

    def _off(self, x: np.ndarray, k: int, t: int) -> np.ndarray:
        """Of phase ``k`` after ``t`` values."""
        count = (t - k + self.season - 1) // self.season
        return x[..., 1 + k] / count - x[..., 1 : 1 + self.season].sum(axis=-1) / t if count >= 2 else np.zeros(x.shape[:-1])

    def begin(self, y):
        x = np.zeros((self.variants, self.dims))
        x[:, 0] = x[:, 1] = x[:, 1 + self.season] = y[0]
        return x, 1

    def step(self, x, v, t):
        k = t % self.season
        z = v - self._off(x, k, t)
        e = z - x[:, :, 0]
        x[:, :, 0] += self.weights * e
        x[:, :, 1 + k] += v
        own = z - x[:, :, 1 + self.season]
        x[:, :, 2 + self.season] += own
        x[:, :, 3 + self.season] += t * own
        return e

    def forecast(self, y, before, n0, state, h, ends, calendar=None, ahead=None):
        found = {}
        for n, x, sse in self._visit(y, n0, state, {int(n) for n in ends}):
            total = n0 + n
            sy, sty = x[0, 2 + self.season :]
            st, stt = total * (total - 1) / 2, (total - 1) * total * (2 * total - 1) / 6
            spread = total * stt - st * st
            slope = (total * sty - st * sy) / spread if spread > 0 else 0.0
            found[n] = x[int(sse.argmin()), 0] + self._off(x[0], (total - 1 + h) % self.season, total) + 0.5 * slope * h
        return np.array([found[int(n)] for n in ends])


@rolling("arx")
class AutoRegression(Rolling):
    """Conditional least squares on lags and the calendar of each step (its phase of the season without one); of the numbers of lags that with the least AIC so far is taken. State: a scale, and sums of products."""

    def __init__(self, orders: tuple[int, ...] = (1, 5), season: int = SEASON):
        self.orders, self.order, self.season = orders, max(orders), season

    def _design(self, y, before, n0, calendar) -> tuple[np.ndarray, np.ndarray]:
        """Regressors and value of each value that has enough before it."""
        if calendar is None:
            calendar = np.eye(self.season)[(n0 + np.arange(len(y))) % self.season]
        whole, skip = np.concatenate([before[-self.order :] if n0 else before[:0], y]), 0 if n0 else self.order
        lags = [whole[self.order - k : len(whole) - k] for k in range(1, self.order + 1)] if len(whole) > self.order else [np.zeros(0)] * self.order
        return np.column_stack([*lags, calendar[skip : skip + len(lags[0])]]), whole[self.order :]

    def summary(self, y, before, n0, calendar=None):
        x, v = self._design(y, before, n0, calendar)
        scale = 0.0 if n0 else max(1e-9, float(np.abs(y[:40]).mean()))  # known to all origins that are fitted
        return np.concatenate([[scale], (x.T @ x).ravel(), x.T @ v, [v @ v]])

    def advance(self, state, summary):
        return summary if state is None else state + summary

    def forecast(self, y, before, n0, state, h, ends, calendar=None, ahead=None):
        x, v = self._design(y, before, n0, calendar)
        width = x.shape[1]
        if ahead is None:
            ahead = np.eye(self.season)[(n0 + ends[:, None] + np.arange(h)) % self.season]
        scale = max(1e-9, float(np.abs(y[:40]).mean())) if state is None else state[0]
        by = np.concatenate([np.full(self.order, 1 / scale), np.ones(width - self.order)])
        x, v = x * by, v / scale
        xx, xy, yy = np.zeros((width, width)), np.zeros(width), 0.0
        if state is not None:
            xx = state[1 : 1 + width * width].reshape(width, width) * by[:, None] * by[None, :]
            xy, yy = state[1 + width * width : -1] * by / scale, state[-1] / scale**2
        recent = np.concatenate([before[-self.order :], y]) / scale
        skip = len(recent) - len(y)
        out, order, at, first = {}, np.argsort(ends, kind="stable"), 0, 0 if n0 else self.order
        for place in order:
            n, total = int(ends[place]), n0 + int(ends[place])
            if total < 40:
                out[place] = y[:n].mean()
                continue
            upto = max(at, n - first)
            xx, xy, yy, at = xx + x[at:upto].T @ x[at:upto], xy + x[at:upto].T @ v[at:upto], yy + v[at:upto] @ v[at:upto], upto
            best = None
            for p in self.orders:
                use = np.r_[0:p, self.order : width]
                part = xx[np.ix_(use, use)] + 1e-6 * np.eye(len(use))
                coef = np.linalg.solve(part, xy[use])
                sse = max(1e-12, float(yy - 2 * coef @ xy[use] + coef @ part @ coef))
                aic = (total - self.order) * np.log(sse / (total - self.order)) + 2 * len(use)
                if best is None or aic < best[0]:
                    best = aic, p, coef
            _, p, coef = best
            past = list(recent[skip + n - self.order : skip + n])
            for k in range(h):
                past.append(float(np.concatenate([past[-1 : -p - 1 : -1], ahead[place][k]]) @ coef))
            out[place] = past[-1] * scale
        return np.array([out[i] for i in range(len(ends))])


@rolling("seasonal_ar")
class SeasonalAutoRegression(Rolling):
    """Trend (mean of the last four seasons), season (mean of the last eight values of a phase less their trend), and an autoregression of what is left; trend and season stay as they are at the origin. State: sums of products."""

    def __init__(self, season: int = SEASON, order: int = 3):
        self.season, self.order = season, order

    def _parts(self, y, before) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Trend after each number of values, values less trend, what is left, and its lags, over ``before`` and ``y``."""
        whole, season = np.concatenate([before, y]), self.season
        total = np.concatenate([[0.0], np.cumsum(whole - whole[0])])
        lo = np.maximum(0, np.arange(len(whole) + 1) - 4 * season)
        width = np.arange(len(whole) + 1) - lo
        trend = whole[0] + np.where(width > 0, (total - total[lo]) / np.maximum(1, width), 0.0)
        d = whole - trend[:-1]
        rest = d - np.array([d[t - season :: -season][:8].mean() if t >= season else 0.0 for t in range(len(whole))])
        return trend, d, rest, np.column_stack([np.concatenate([np.full(k, np.nan), rest[: len(rest) - k]]) if len(rest) >= k else np.full(len(rest), np.nan) for k in range(1, self.order + 1)])

    def summary(self, y, before, n0, calendar=None):
        _, _, rest, lags = self._parts(y, before)
        from_ = len(before) if n0 else self.order
        x, v = lags[from_:], rest[from_:]
        return np.concatenate([(x.T @ x).ravel(), x.T @ v])

    def advance(self, state, summary):
        return summary if state is None else state + summary

    def forecast(self, y, before, n0, state, h, ends, calendar=None, ahead=None):
        trend, d, rest, lags = self._parts(y, before)
        q, shift = self.order, len(before)
        xx, xy = (np.zeros((q, q)), np.zeros(q)) if state is None else (state[: q * q].reshape(q, q), state[q * q :])
        at, out = shift if n0 else q, {}
        for place in np.argsort(ends, kind="stable"):
            n, total, here = int(ends[place]), n0 + int(ends[place]), shift + int(ends[place])
            if total < 10 * self.season:
                out[place] = _mean_of_last(y, n, self.season)
                continue
            upto = max(at, here)
            xx, xy, at = xx + lags[at:upto].T @ lags[at:upto], xy + lags[at:upto].T @ rest[at:upto], upto
            coef = np.linalg.solve(xx + 1e-6 * np.eye(q) * max(1.0, float(np.trace(xx)) / (q * (total - q))), xy)
            past = list(rest[here - q : here])
            for _ in range(h):
                past.append(float(np.dot(coef, past[-1 : -q - 1 : -1])))
            last = here + h - 1 - self.season * (-(-h // self.season))  # of the same phase, before the origin ends
            out[place] = trend[here] + d[last :: -self.season][:8].mean() + past[-1]
        return np.array([out[i] for i in range(len(ends))])


def calendar_rows(days: np.ndarray) -> np.ndarray:
    """Regressors of each day: its weekday, and whether it is the last business day of a month or quarter."""
    d = days.astype("datetime64[D]")
    weekday = (d.astype(int) + 3) % 7
    following = d + np.where(weekday == 4, 3, 1)
    month = d.astype("datetime64[M]")
    ends = following.astype("datetime64[M]") != month
    return np.column_stack([np.eye(7)[weekday], ends, ends & (month.astype(int) % 3 == 2)]).astype(float)


FORECAST = "series_id string, model string, horizon int, origin_date date, target_date date, origin_value double, y_true double, y_pred double"


def _frame(pdf: pd.DataFrame, horizon: int, forecasts: Callable[..., Iterator[tuple[str, np.ndarray]]]) -> pd.DataFrame:
    """Forecasts at the rows of ``pdf`` (by position; ``own`` tells those of the block from those that follow it) whose target lies in the range."""
    pdf = pdf.sort_values(["pos", "own"], ascending=[True, False]).drop_duplicates("pos")
    y, days, own = pdf["y"].to_numpy(dtype=float), pdf["ds"].to_numpy(), pdf["own"].to_numpy()
    there, parts = own & ~np.isnan(y), []
    at = np.array([i for i in range(len(y) - horizon) if there[i] and days[i + horizon] >= pdf["first"].iloc[0]], dtype=int)
    if len(at):
        calendar = calendar_rows(days)
        for name, got in forecasts(y[there], np.cumsum(there)[at], calendar[there], calendar[at[:, None] + np.arange(1, horizon + 1)]):
            parts.append(pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "model": name, "horizon": horizon, "origin_date": days[at], "target_date": days[at + horizon], "origin_value": y[at], "y_true": [None if np.isnan(v) else v for v in y[at + horizon]], "y_pred": got}))
    return pd.concat(parts) if parts else pd.DataFrame(columns=[x.split()[0] for x in FORECAST.split(", ")], dtype=object)


def by_blocks(rows: DataFrame, horizon: int, names: list[str], block: int = BLOCK) -> DataFrame:
    """Forecasters with a rolling form over ``series_id, pos, ds, y, first``, in parallel over blocks of positions.

    A block also gets the rows of the ``horizon`` positions after it, for
    targets and calendars. Only series with several blocks are summed up and
    scanned; a scan has a row for each block of a series.
    """
    forms = {n: ROLLING[n] for n in names}
    block = max(block, horizon)
    rows = rows.withColumn("chunk", F.floor(F.col("pos") / block).cast("int"))
    span = rows.groupBy(F.col("series_id").alias("l_series")).agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).where("lo < hi").select("l_series")
    known = rows.where("y IS NOT NULL").join(span, F.col("series_id") == F.col("l_series"), "left_semi")
    tail = F.slice(F.array_sort(F.collect_list(F.struct("pos", "y"))), -F.least(F.count("*"), F.lit(LOOKBACK)).cast("int"), LOOKBACK)  # of a block's rows
    tails = known.groupBy("series_id", "chunk").agg(F.count("*").alias("n"), F.transform(tail, lambda x: x["y"]).alias("tail"))

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        """Which block a chunk belongs to, what comes before it, and whether it is the last."""
        pdf = pdf.sort_values("chunk")
        seen, before, out = 0, np.zeros(0), []
        for chunk, n, values in zip(pdf["chunk"], pdf["n"], pdf["tail"]):
            new = not out or seen >= LOOKBACK
            out.append((pdf["series_id"].iloc[0], chunk, chunk if new else out[-1][2], seen if new else None, before if new else None))
            seen, before = seen + n, np.concatenate([before, values])[-LOOKBACK:]
        made = pd.DataFrame(out, columns=["series_id", "chunk", "block", "n0", "before"])
        return made.assign(final=made["block"] == made["block"].max())

    # A few rows for each block: written down once by the shuffle that the scans share.
    placed = tails.groupBy("series_id").applyInPandas(blocks, "series_id string, chunk int, block int, n0 long, before array<double>, final boolean")
    chunks = placed.select(F.col("series_id").alias("b_series"), F.col("chunk").alias("b_chunk"), "block")
    heads = placed.where("n0 IS NOT NULL").select(F.col("series_id").alias("h_series"), F.col("block").alias("h_block"), "n0", "before", "final")
    spread = rows.withColumn("to", F.explode(F.array_distinct(F.array("chunk", F.floor((F.col("pos") - horizon) / block).cast("int"))))).withColumn("own", F.col("to") == F.col("chunk"))
    spread = spread.join(chunks, (F.col("series_id") == F.col("b_series")) & (F.col("to") == F.col("b_chunk")), "left")
    spread = spread.select("series_id", F.coalesce("block", "to").alias("block"), "pos", "ds", "y", "first", "own")

    def sum_up(pdf: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(head) and not head["final"].iloc[0]:
            pdf = pdf[pdf["own"] & pdf["y"].notna()].sort_values("pos")
            y, calendar = pdf["y"].to_numpy(dtype=float), calendar_rows(pdf["ds"].to_numpy())
            n0, before = int(head["n0"].iloc[0]), np.asarray(head["before"].iloc[0], float)
            out = [(pdf["series_id"].iloc[0], int(pdf["block"].iloc[0]), name, f.summary(y, before, n0, calendar)) for name, f in forms.items()]
        return pd.DataFrame(out, columns=["series_id", "block", "model", "summary"])

    keys = "series_id string, block int, model string"
    unfinished = heads.where("NOT final")
    summaries = spread.where("own AND y IS NOT NULL").groupBy("series_id", "block").cogroup(unfinished.groupBy("h_series", "h_block")).applyInPandas(sum_up, f"{keys}, summary array<double>")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state that each block after the first starts with; it is kept under the number of the block before."""
        pdf, state, out = pdf.sort_values("block"), None, []
        for block, summary in zip(pdf["block"], pdf["summary"]):
            state = forms[pdf["model"].iloc[0]].advance(state, np.asarray(summary, float))
            out.append((pdf["series_id"].iloc[0], block, pdf["model"].iloc[0], state))
        return pd.DataFrame(out, columns=["series_id", "block", "model", "state"])

    after = summaries.groupBy("series_id", "model").applyInPandas(scan, f"{keys}, state array<double>").select(F.col("series_id").alias("s_series"), F.col("block").alias("s_block"), "model", "state")
    earlier = F.lag("h_block").over(Window.partitionBy("h_series").orderBy("h_block"))
    starts = heads.withColumn("earlier", earlier).join(after, (F.col("h_series") == F.col("s_series")) & (F.col("earlier") == F.col("s_block")), "left").select("h_series", "h_block", "n0", "before", "model", "state")

    def run(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return _frame(pdf, horizon, lambda *_: iter(()))
        n0, before = (int(start["n0"].iloc[0]), np.asarray(start["before"].iloc[0], float)) if len(start) else (0, np.zeros(0))
        states = {m: np.asarray(s, float) for m, s in zip(start["model"], start["state"]) if m is not None}
        return _frame(pdf, horizon, lambda y, ends, calendar, ahead: ((name, f.forecast(y, before, n0, states.get(name), horizon, ends, calendar, ahead)) for name, f in forms.items()))

    return spread.groupBy("series_id", "block").cogroup(starts.groupBy("h_series", "h_block")).applyInPandas(run, FORECAST)


def by_series(rows: DataFrame, horizon: int, names: list[str]) -> DataFrame:
    """Forecasters without a rolling form, refitted at each origin on the whole history: a series is one task."""
    plain = {n: REGISTRY[n] for n in names}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame(pdf, horizon, lambda y, ends, calendar, ahead: ((name, np.array([f(y[:n], horizon)[-1] for n in ends])) for name, f in plain.items()))

    return rows.select("series_id", "pos", "ds", "y", "first", F.lit(True).alias("own")).groupBy("series_id").applyInPandas(run, FORECAST)
