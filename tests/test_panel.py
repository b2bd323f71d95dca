"""Hand-computed vectors, look-ahead, upserts, and every query against its SQL on the smallest tables."""

import math
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelspark import catalog, catalog_panel, catalog_research, catalog_stores  # noqa: F401
from panelspark.functions.columns import correlation
from panelspark.operators import asof, audit, features, performance, portfolio, quality, reports, training
from panelspark.plans.panel import build_panel
from panelspark.sources import files, outputs, views
from panelspark.streaming.store import Store
from panelspark.streaming.upsert import merged, stream_upsert
from tests.oracle import compare

DAY = date(2020, 1, 1)
SF = "/root/testdata/sf0.001"


def prices(spark, **series):
    rows = [(t, DAY + timedelta(i), float(p), p * 1.05, p * 0.95, float(p), 10.0) for t, ps in series.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "ticker string, trade_date date, adj_close double, high double, low double, close double, volume double")


def column(df, name, ticker="A"):
    return [r[name] for r in df.where(f"ticker = '{ticker}'").orderBy("trade_date").collect()]


def test_log_return_by_ticker_and_positive_only(spark):
    out = features.price_features(prices(spark, A=[100, 0, -50, 101], B=[50, 52]))
    assert column(out, "log_return") == [None] * 4
    assert column(out, "log_return", "B") == [None, pytest.approx(math.log(52 / 50))]


def test_windows_need_all_rows(spark):
    out = features.price_features(prices(spark, A=[100 + 0.5 * i for i in range(100)]))
    assert [x is None for x in column(out, "ma_20")].index(False) == 19
    assert [x is None for x in column(out, "ma_60")].index(False) == 59
    assert [x is None for x in column(out, "volatility_20d")].index(False) == 20
    assert column(out, "rsi_14") == [None] * 100  # no loss at all


def test_panel_history_is_narrow_and_keeps_repeated_rows(spark):
    tables = [f(spark, SF) for f in (views.prices, views.filings, views.companies, views.macro, views.dividends)]
    tables[0] = tables[0].union(tables[0].where("day(trade_date) = 1"))
    whole, plain = build_panel(*tables), build_panel(*tables, history=False)
    assert set(whole.columns) - set(plain.columns) == {"volatility_20d_percentile", "volatility_60d_percentile", "price_percentile_5y", "pl_percentile_5y", "drawdown_percentile"}
    key = ["ticker", "trade_date"]
    assert whole.groupBy(key).count().exceptAll(plain.groupBy(key).count()).isEmpty()
    assert whole.count() == plain.count() > plain.select(key).distinct().count()
    sent = re.search(r"run\(([^)]*)\)", whole._jdf.queryExecution().optimizedPlan().toString())[1].split(", ")
    assert [x.split("#")[0] for x in sent] == ["ticker", "trade_date", "_row", *features.HISTORY]


def test_panel_of_empty_prices(spark):
    tables = [f(spark, SF) for f in (views.prices, views.filings, views.companies, views.macro, views.dividends)]
    assert build_panel(tables[0].limit(0), *tables[1:]).isEmpty()


def test_as_of_joins_keep_the_partitioning_of_their_keys(spark):
    events = spark.createDataFrame([("A", DAY, 1.0)], "ticker string, d date, x double")
    left = prices(spark, A=[1, 2, 3])
    for out in (asof.asof_join(left, events, ["ticker"], "trade_date", "d"), asof.trailing_events(left, events, "ticker", "trade_date", "d", "x", 9)):
        assert out.columns[: len(left.columns)] == left.columns
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert plan(features.price_features(out)) == plan(out) == 1


def test_weight_changes_take_the_outermost_days(spark):
    w = spark.createDataFrame([("A", DAY, 0.5), ("A", DAY + timedelta(1), 0.2), ("B", DAY, 0.5), ("C", DAY + timedelta(1), 0.8)], "ticker string, trade_date date, w double")
    days = spark.createDataFrame([(DAY, DAY), (DAY, DAY + timedelta(1))], "a date, b date")
    found = {r.ticker: r.change for r in training.weight_changes(w, days).collect()}
    assert found == {"A": "resized", "B": "exited", "C": "entered"}
    assert training.weight_changes(w, days.limit(0)).isEmpty()


def test_drawdown_and_rsi(spark):
    out = features.price_features(prices(spark, A=[100, 120, 110, 90], B=[100 + i % 2 for i in range(18)]))
    assert column(out, "drawdown") == pytest.approx([0, 0, -10 / 120, -30 / 120])
    assert 40 < column(out, "rsi_14", "B")[15] < 60


def test_returns_beyond_the_limit(spark):
    assert column(features.training_returns(prices(spark, A=[100, 300, 301])), "returns")[1:] == [None, pytest.approx(math.log(301 / 300))]


def test_asof_takes_equal_days_keeps_nulls_and_rows(spark):
    left = prices(spark, A=[1, 2, 3], B=[1])
    right = spark.createDataFrame([("A", DAY + timedelta(1), 5.0, 7.0), ("A", DAY + timedelta(2), None, 8.0)], "ticker string, d date, x double, y double")
    out = asof.asof_join(left, right, ["ticker"], "trade_date", "d")
    assert out.count() == 4
    assert column(out, "x") == [None, 5.0, None] and column(out, "y") == [None, 7.0, 8.0]
    assert column(asof.asof_join(left, right, ["ticker"], "trade_date", "d", 1), "y") == [None, None, 7.0]


def test_asof_of_repeated_days_and_of_keys_without_rows(spark):
    right = spark.createDataFrame([("A", DAY, 2.0, 1.0), ("A", DAY, 1.0, 9.0)], "ticker string, d date, x double, y double")
    out = asof.asof_join(prices(spark, A=[1], B=[1]), right, ["ticker"], "trade_date", "d", met=True)
    assert [(r.ticker, r.x, r.y) for r in out.collect()] == [("A", 2.0, 1.0)]


def test_dividends_of_tickers_without_any(spark):
    events = spark.createDataFrame([("A", DAY + timedelta(1), 1.0), ("A", DAY + timedelta(1), 3.0)], "ticker string, ex_date date, value_per_share double")
    out = features.dividend_features(prices(spark, A=[2, 4], B=[1]), events)
    assert column(out, "div_value_recent") == [None, 3.0] and column(out, "div_value_recent", "B") == [0.0]
    assert column(out, "div_yield_12m") == [0.0, 1.0] and column(out, "div_count_12m", "B") == [0]


def test_shares_of_the_past_equal_plain_ones(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    values = [float(x) for x in rng.integers(1, 9, 60)]
    p = prices(spark, A=values).withColumn("adj_close", F.when(F.col("adj_close") != 5, F.col("adj_close")))
    out = features.shares(p, {"all": "adj_close"}, {"last": ("adj_close", 7)})
    x = [v if v != 5 else None for v in values]
    known = [v for v in x if v is not None]
    rank = lambda v: (sum(y < v for y in known) + (sum(y == v for y in known) + 1) / 2) / len(known)
    assert column(out, "all") == [pytest.approx(rank(v)) if v is not None else None for v in x]
    recent = [[y for y in x[max(0, i - 6) : i + 1] if y is not None] for i in range(60)]
    assert column(out, "last") == [pytest.approx(sum(y <= v for y in r) / len(r)) if v is not None else None for v, r in zip(x, recent)]


def test_normal_distribution(spark):
    from statistics import NormalDist

    from panelspark.functions.columns import normal_cdf

    z = [-9.0, -3.3, -1.0, 0.0, 0.5, 2.0, 6.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([NormalDist().cdf(x) for x in z], abs=2e-12)


def test_gates_on_bad_and_empty_tables(spark):
    p = prices(spark, A=[1, 2]).union(prices(spark, A=[1]))
    found = {r["check"]: (r["n_bad"], r["passed"]) for r in reports.common_gate(p, "trade_date", ["close", "nothing"], F.lit(DAY - timedelta(2))).collect()}
    assert found == {"empty": (0, True), "missing_columns": (1, False), "future_dates": (1, False), "repeated_dates": (1, True)}
    none = p.where("false")
    assert {r["check"] for r in reports.common_gate(none, "trade_date", [], F.current_date()).where("NOT passed").collect()} == {"empty"}
    assert reports.value_gate(none, "close").where("NOT passed").first()["check"] == "all_null" and reports.audit_lines(none, "ticker", "trade_date", F.current_date()).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", "b", 2.0), ("s", "a", 1.0)], "strategy string, metric string, value double")
    assert outputs.metric_document(rows).first()["document"] == '{"s":{"a":1.0,"b":2.0}}'
    outputs.write_allocation(spark.createDataFrame([(DAY, "A", 0.5, 0, False)], "as_of date, ticker string, w double, days_old int, stale boolean"), f"{tmp_path}/a")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/a").first()["ticker"] == "A"
    meta = spark.createDataFrame([("k", "1")], "key string, value string")
    outputs.write_metadata(meta, f"{tmp_path}/m")
    assert outputs.metadata_differences(spark.read.json(f"{tmp_path}/m"), meta).count() == 0
    assert files.without_empty_columns(spark.createDataFrame([(1, None)], "a int, b string")).columns == ["a"]


def test_no_look_ahead(spark):
    a, b = [100, 101, 103, 99, 98, 104], [100, 101, 103, 99, 5, 900]
    for name in ("log_return", "drawdown", "hl_ratio"):
        assert column(features.price_features(prices(spark, A=a)), name)[:4] == column(features.price_features(prices(spark, A=b)), name)[:4]


def test_trailing_window_is_open_at_its_far_end(spark):
    events = spark.createDataFrame([("A", DAY - timedelta(252), 1.0), ("A", DAY - timedelta(251), 2.0)], "ticker string, d date, x double")
    out = asof.trailing_events(prices(spark, A=[1], B=[1]), events, "ticker", "trade_date", "d", "x", 252)
    assert column(out, "n_events") == [1] and column(out, "sum_events") == [2.0] and column(out, "n_events", "B") == [0]


def test_quality_findings(spark):
    p = prices(spark, A=[10, 10, 10, 10, 10, 10, 20])
    found = {r["check"]: r["n"] for r in quality.findings(p.union(p.where("adj_close = 20"))).groupBy("check").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert found["stale_price"] == 5 and found["duplicate_row"] == 2 and found["return_spike"] == 1


def test_rank_ic(spark):
    rows = [(DAY + timedelta(d), float(i), float(i if d else -i)) for d in range(2) for i in range(20)]
    out = performance.daily_rank_ic(spark.createDataFrame(rows, "trade_date date, f double, t double"), "f", "t").orderBy("trade_date").collect()
    assert [r.ic for r in out] == pytest.approx([-1, 1])
    assert performance.daily_rank_ic(spark.createDataFrame(rows[:5], "trade_date date, f double, t double"), "f", "t").first().ic is None


def test_rebalancing_equals_a_loop(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    r = rng.normal(0, 0.02, (9, 3))
    days = [DAY + timedelta(i) for i in range(9)]
    returns = spark.createDataFrame([(days[d], f"T{i}", float(r[d, i])) for d in range(9) for i in range(3)], "date date, ticker string, r double")
    target = [0.5, 0.3, 0.2]
    weights = spark.createDataFrame([("s", days[d], f"T{i}", target[i]) for d in range(9) for i in range(3)], "strategy string, date date, ticker string, w double")
    got = [(x.gross, x.cost) for x in performance.rebalanced(returns, weights, 4, 0.001).orderBy("date").collect()]
    want, w = [], np.zeros(3)
    for d in range(9):
        cost = 0.0
        if d % 4 == 0:
            cost, w = 0.001 * np.abs(np.array(target) - w).sum(), np.array(target)
        gross = float(w @ r[d])
        w = w * (1 + r[d]) / (1 + gross)
        want.append((gross, cost))
    assert np.allclose(got, want)


def test_upsert_twice_and_late_correction(spark, tmp_path):
    schema = "k int, v string"
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], schema), spark.createDataFrame([(2, "c")], schema)
    both = merged(merged(one, two, ["k"]), two, ["k"])
    assert sorted(map(tuple, both.collect())) == [(1, "a"), (2, "c")]
    one.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    for _ in range(2):
        stream_upsert(spark, f"{tmp_path}/in/*", one.schema, f"{tmp_path}/out", ["k"], f"{tmp_path}/ck")
    two.coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream_upsert(spark, f"{tmp_path}/in/*", one.schema, f"{tmp_path}/out", ["k"], f"{tmp_path}/ck")
    assert sorted(map(tuple, Store(spark, f"{tmp_path}/out").read().collect())) == [(1, "a"), (2, "c")]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF) == ""


def _redistributed(w, cap):
    """Caps a day's weights by repeated equal shares, as a loop."""
    w = dict(w)
    stocks = [t for t in w if t != "CASH"]
    for _ in range(len(stocks) + 1):
        over = {t: w[t] - cap for t in stocks if w[t] > cap}
        if not over:
            break
        w.update(dict.fromkeys(over, cap))
        room = [t for t in stocks if w[t] < cap - 1e-9]
        for t in room:
            w[t] += sum(over.values()) / len(room)
    total = sum(min(x, cap) if t != "CASH" else x for t, x in w.items())
    return {t: (min(x, cap) if t != "CASH" else x) / total for t, x in w.items()}


@pytest.mark.parametrize("w", [
    {"A": 0.5, "B": 0.2, "C": 0.12, "D": 0.1, "CASH": 0.08}, {"A": 0.2, "B": 0.2, "C": 0.2, "D": 0.2, "E": 0.2}, {"A": 0.9, "B": 0.1},
    {"A": 0.24, "B": 0.24, "C": 0.24, "D": 0.24, "E": 0.04, "F": 0.0}, {"CASH": 1.0},
])
def test_cap_equals_repeated_redistribution(spark, w):
    df = spark.createDataFrame([(DAY, t, x) for t, x in w.items()], "trade_date date, ticker string, w double")
    got = {r["ticker"]: r["w"] for r in portfolio.capped(df, 0.25).collect()}
    assert got == pytest.approx(_redistributed(w, 0.25), abs=1e-9)


def test_turnover_counts_names_that_enter_and_leave(spark):
    rows = [(DAY, "A", 1.0), (DAY + timedelta(3), "B", 0.5), (DAY + timedelta(3), "A", 0.5), (DAY + timedelta(4), "B", 1.0)]
    out = portfolio.turnover(spark.createDataFrame(rows, "trade_date date, ticker string, w double")).orderBy("trade_date").collect()
    assert [r["turnover"] for r in out] == [1.0, 1.0, 1.0]


def test_softmax_gives_rows_without_a_score_nothing(spark):
    df = spark.createDataFrame([(DAY, "A", 1.0), (DAY, "B", 1.0), (DAY, "C", None)], "trade_date date, ticker string, z double")
    assert {r["ticker"]: r["w"] for r in portfolio.softmax_weights(df, "z").collect()} == {"A": 0.5, "B": 0.5, "C": 0.0}


def test_correlation_is_null_where_a_side_is_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert df.agg(correlation("a", "b").alias("x")).first()["x"] is None


def test_attribution_adds_up_on_one_day(spark):
    df = spark.createDataFrame([("s", math.log(1.1), 0.5, math.log(1.02), math.log(1.04))], "strategy string, agent_log double, cash_w double, selic_log double, ew_log double")
    r = portfolio.attribution(df).first()
    assert (r["carry"], r["market"], r["selection"], r["total"]) == pytest.approx((0.01, 0.02, 0.07, 0.1))


def test_probabilistic_sharpe_of_symmetric_returns(spark):
    rows = [("even", i, x) for i, x in enumerate([0.01, -0.01, 0.01, -0.01])] + [("one", 0, 0.1)]
    got = {r["strategy"]: r["psr"] for r in performance.probabilistic_sharpe(spark.createDataFrame(rows, "strategy string, date int, r double")).collect()}
    assert got == {"even": 0.5, "one": 0.5}


def test_reports_of_an_empty_table(spark):
    none = prices(spark, A=[100]).where("false")
    assert audit.health(none).first()["n_rows"] == 0
    assert audit.frozen_share(none, "close", ["ticker"]).first()["n_groups"] == 0
    assert audit.month_counts(none).count() == audit.fences(none, "close").count() == audit.difference(none, none, ["ticker"], "close").count() == 0


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_signal_report_sorts_once_for_each_rank(spark):
    """four sorts of long rows, and prices joined with themselves, before."""
    data = [(f"T{i}", f"2024-01-{d:02}", float((i * 7 + d) % 5), float((i * d) % 4) if i % 3 else None, float(i % 4 + d)) for i in range(12) for d in range(1, 9)]
    p = spark.createDataFrame(data, "ticker string, trade_date string, x double, y double, adj_close double").withColumn("trade_date", F.to_date("trade_date"))
    p = p.where("NOT (ticker = 'T1' AND trade_date = '2024-01-03')")
    f = training.market_forward(p, 2)
    assert "SortMergeJoin" not in _plan(f)
    plan = _plan(training.signal_report(f, ["x", "y"], "forward", 3))
    assert len(re.findall(r"Sort \[trade_date", plan)) <= 3  # days' numbers, the target, the features
    days = sorted({d for _, d, *_ in data})
    close = {(t, d): a for t, d, _, _, a in data if (t, d) != ("T1", "2024-01-03")}
    for r in f.collect():
        d = str(r["trade_date"])
        later = close.get((r["ticker"], days[days.index(d) + 2])) if days.index(d) + 2 < len(days) else None
        assert (r["forward"] is None) == (later is None)
        assert later is None or abs(r["forward"] - math.log(later / close[r["ticker"], d])) < 1e-12


def test_line_items_are_dealt_by_ticker_before_they_are_aggregated(spark, monkeypatch):
    """a task that scans held a row for each ticker and day of its line items."""
    plan = _plan(catalog.QUERIES["q01_common_gate"](spark, SF)).split("\n")
    scan = max(i for i, line in enumerate(plan) if "FileScan" in line)
    dealt = max(i for i, line in enumerate(plan) if "Exchange" in line)
    assert not any("HashAggregate" in line for line in plan[dealt:scan])
    monkeypatch.setattr(views, "PART_ROWS", 100)
    assert "REPARTITION_BY_NUM" in _plan(views.prices(spark, SF))


def test_panel_computes_only_what_is_read(spark):
    """rows went through joins as structs, so every feature was computed, and prices were dealt
    three times by ticker."""
    plan = _plan(catalog.QUERIES["p00_panel_dividends"](spark, SF))
    assert "stddev_samp" not in plan and "log_return" not in plan
    assert not re.search(r"hashpartitioning\(trade_date[^)]*\), REPARTITION_BY_COL", plan)
    panel = _plan(catalog.QUERIES["p00_build_panel"](spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning\(ticker", panel)) <= 6  # three tables, the company, two for the days
    assert "_left" not in panel


def test_panel_gate_reads_the_panel_once(spark):
    """the sectors were counted in a second computation of the panel."""
    plan = _plan(catalog.QUERIES["q07_panel_gate"](spark, SF))
    assert len(re.findall("FileScan parquet .*l_suppkey", plan)) == 2  # prices, filings
    data = [("A", "2020-01-01", "x"), ("A", "2020-01-01", "x"), ("B", "2023-01-01", "y"), ("C", "2021-01-01", "x"), ("D", "2021-01-01", None)]
    p = spark.createDataFrame(data, "ticker string, trade_date string, sector string").selectExpr("ticker", "date(trade_date) AS trade_date", "sector", "date'2021-06-01' AS reference_date", "CASE WHEN ticker = 'B' THEN NULL ELSE 1D END AS roe", "CAST(NULL AS double) AS log_return")
    got = {r["check"]: (r["value"], r["passed"]) for r in quality.panel_gate(p, ["roe"]).collect()}
    assert got["sectors"] == (2.0, False) and got["largest_sector"] == (2 / 3, False) and got["duplicate_keys"] == (1.0, False) and got["look_ahead"] == (4.0, False)
    assert got["null_after_filing"] == (0.2, False) and got["mean_return"] == (None, False) and got["long_tickers"] == (0.0, False) and got["span_years"] == (1096 / 365.25, True)
    none = {r["check"]: r["value"] for r in quality.panel_gate(p.where("false"), ["roe"]).collect()}
    assert none == {"look_ahead": 0.0, "sectors": 0.0, **dict.fromkeys(["span_years", "long_tickers", "duplicate_keys", "null_after_filing", "mean_return", "largest_sector"])}
