"""A portfolio's value carried over the chunks of a stream."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "strategy string, date date, r double, value double, drawdown double"


def rollout_stream(returns: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """value and drawdown of a stream (strategy, date, r): what a strategy's earlier chunks came to is its state (value, peak,
    last day), so a stopped query goes on from its checkpoint. A chunk is taken in order of date; rows that aren't later than
    the last day of the chunks before (a chunk sent again) and rows without date or return go. Append mode."""

    def step(key: tuple, frames, state: GroupState):
        value, peak, last = state.get if state.exists else (capital, capital, None)
        rows = pd.concat(list(frames)).dropna(subset=["date", "r"]).sort_values("date", kind="stable")
        if last is not None:
            rows = rows[pd.to_datetime(rows["date"]) > pd.Timestamp(last)]
        if len(rows):
            values = value * np.cumprod(1 + rows["r"].to_numpy())
            peaks = np.maximum(peak, np.maximum.accumulate(values))
            yield pd.DataFrame({"strategy": key[0], "date": rows["date"].to_numpy(), "r": rows["r"].to_numpy(), "value": values, "drawdown": 1 - values / peaks})
            state.update((float(values[-1]), float(peaks[-1]), str(rows["date"].iloc[-1])))

    return returns.select("strategy", "date", "r").groupBy("strategy").applyInPandasWithState(step, OUT, "value double, peak double, last string", "append", GroupStateTimeout.NoTimeout)


HELD = "strategy string, date date, names int, gross double, cost double, r double, value double, drawdown double"


def portfolio_stream(days: DataFrame, rate: float, capital: float = 100_000.0) -> DataFrame:
    """A portfolio's days from a stream (strategy, date, ticker, r simple, target): names held, return before cost, cost, return,
    value and drawdown.

    The state of a strategy is its weights, value, peak and last day, so a stopped query goes on from its checkpoint with the
    weights that it had. A day that names a target is set to its targets (others go to 0) at `rate` times the sum of absolute
    changes; on other days weights drift. A name without a row on a day, or without a return, has a return of 0. A day's rows
    come in one chunk, chunks in order: rows that aren't later than the last day of the chunks before, and rows without date
    or ticker, go; of repeated rows of a day and name the last counts. Append mode.
    """

    def step(key: tuple, frames, state: GroupState):
        value, peak, last, held = state.get if state.exists else (capital, capital, None, "{}")
        weights: dict[str, float] = json.loads(held)
        rows = pd.concat(list(frames)).dropna(subset=["date", "ticker"]).drop_duplicates(["date", "ticker"], keep="last")
        rows = rows.assign(date=pd.to_datetime(rows["date"])).sort_values("date", kind="stable")
        out = []
        for day, names in rows[rows["date"] > pd.Timestamp(last)].groupby("date") if last else rows.groupby("date"):
            returns = dict(zip(names["ticker"], names["r"].fillna(0.0)))
            cost = 0.0
            if names["target"].notna().any():
                wanted = {t: float(w) for t, w in zip(names["ticker"], names["target"]) if w == w and w != 0}
                cost = rate * sum(abs(wanted.get(t, 0.0) - weights.get(t, 0.0)) for t in wanted.keys() | weights.keys())
                weights = wanted
            gross = sum(w * returns.get(t, 0.0) for t, w in weights.items())
            value *= 1 + gross - cost
            peak = max(peak, value)
            out.append((key[0], day.date(), len(weights), gross, cost, gross - cost, value, 1 - value / peak))
            weights = {t: w * (1 + returns.get(t, 0.0)) / (1 + gross) for t, w in weights.items()} if gross > -1 else {}
        if out:
            state.update((float(value), float(peak), str(out[-1][1]), json.dumps(weights)))
            yield pd.DataFrame(out, columns=["strategy", "date", "names", "gross", "cost", "r", "value", "drawdown"])

    rows = days.select("strategy", "date", "ticker", "r", "target")
    return rows.groupBy("strategy").applyInPandasWithState(step, HELD, "value double, peak double, last string, held string", "append", GroupStateTimeout.NoTimeout)
