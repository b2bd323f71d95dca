"""Operators of training tables, significance, statements, sources and streams, against loops over small tables."""

import datetime as dt
import hashlib
import json
import math
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from statistics import NormalDist
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import performance, quality, ranking, significance, statements, training
from panelspark.sources import files, http, outputs
from panelspark.streaming.rollout import rollout_stream

DAY = dt.date(2020, 1, 1)


def _day(i):
    return DAY + dt.timedelta(days=i)


def _series(spark, values, strategy="a"):
    return spark.createDataFrame([(strategy, _day(i), None if x is None else float(x)) for i, x in enumerate(values)], "strategy string, date date, r double")


def _panel(spark, rows):
    return spark.createDataFrame([(t, _day(i), x) for t, i, x in rows], "ticker string, trade_date date, adj_close double")


def test_bootstrap_equals_a_loop(spark):
    r = np.random.default_rng(1).normal(0.01, 1, 25)
    got = significance.bootstrap_mean(_series(spark, r), 4, 50).collect()[0]
    means = []
    for b in range(50):
        sample = []
        for k in range(math.ceil(25 / 4)):
            start = int(hashlib.md5(f"0|a|{b}|{k}".encode()).hexdigest()[:8], 16) % (25 - 4 + 1)
            sample += list(r[start : start + 4])
        means.append(np.mean(sample[:25]))
    assert np.allclose([got.mean, got.low, got.high], [r.mean(), *np.quantile(means, [0.025, 0.975])])


def test_bootstrap_of_short_and_constant_series(spark):
    both = _series(spark, [1, 2]).union(_series(spark, [3] * 5, "b")).union(_series(spark, [None, None], "c"))
    got = {x.strategy: x for x in significance.bootstrap_mean(both, 21, 20).collect()}
    assert got["a"].low is None and got["a"].n == 2 and "c" not in got
    assert (got["b"].low, got["b"].high) == pytest.approx((3, 3))


def test_two_sample_equals_the_definition(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 40, 300), rng.integers(5, 60, 200)
    rows = [("f", float(x), False) for x in a] + [("f", float(x), True) for x in b] + [("few", 1.0, True), ("f", None, True), ("f", 1.0, None)]
    got = significance.two_sample_ks(spark.createDataFrame(rows, "feature string, x double, second boolean"), parts=7).collect()
    want = max(abs(np.mean(a <= x) - np.mean(b <= x)) for x in range(-1, 61))
    assert [(g.feature, g.n_first, g.n_second) for g in got] == [("f", 300, 200)] and got[0].ks == pytest.approx(want)


def test_deflated_sharpe_by_hand(spark):
    r = [0.01, -0.02, 0.03, 0.01, 0.0, 0.02]
    trials = spark.createDataFrame([(0.1,), (0.3,), (0.2,)], "s double")
    got = significance.deflated_sharpe(_series(spark, r), trials).collect()[0]
    q, x = NormalDist(), np.array(r)
    chance = np.std([0.1, 0.3, 0.2]) * ((1 - 0.5772156649) * q.inv_cdf(1 - 1 / 3) + 0.5772156649 * q.inv_cdf(1 - 1 / (3 * math.e)))
    s, z = x.mean() / x.std(), (x - x.mean()) / x.std()
    want = q.cdf((s - chance) * math.sqrt(5) / math.sqrt(1 - (z**3).mean() * s + ((z**4).mean() - 1) / 4 * s * s))
    assert (got.benchmark, got.dsr) == pytest.approx((chance, want))
    assert significance.deflated_sharpe(_series(spark, r), trials.limit(1)).collect()[0].benchmark == 0


def test_cash_rows_and_gate(spark):
    p = _panel(spark, [("A", i, 1.0) for i in range(30)])
    rates = spark.createDataFrame([(DAY, 0.04)], "reference_date date, selic double")
    got = training.with_cash(p, rates)
    cash = [r.adj_close for r in got.where("ticker = 'CASH'").orderBy("trade_date").collect()]
    assert cash == pytest.approx([100 * 1.0004 ** (i + 1) for i in range(30)])
    gate = training.cash_gate(got).collect()[0]
    assert gate.passed and gate.annualized == pytest.approx(1.0004**252 * (1 - 0) - 1, rel=1e-6)
    assert training.cash_gate(p).collect()[0].passed is False


def test_allocation_is_of_the_day_before_and_stale(spark):
    w = spark.createDataFrame([("A", _day(0), 0.4), ("B", _day(0), 0.6), ("A", _day(20), 1.0), ("C", _day(0), 0.0)], "ticker string, trade_date date, w double")
    got = training.allocation(w, "2020-01-10")
    assert sorted((r.ticker, r.w, r.days_old, r.stale) for r in got.collect()) == [("A", 0.4, 9, True), ("B", 0.6, 9, True)]
    doc = json.loads(outputs.allocation_document(got).collect()[0].document)
    assert [p["ticker"] for p in doc["positions"]] == ["B", "A"] and doc["stale"] is True
    zero = spark.createDataFrame([("A", _day(0), 0.0), ("B", _day(0), 0.0)], w.schema)
    assert [r.w for r in training.allocation(zero, "2020-01-01").collect()] == [0.5, 0.5]
    assert training.allocation(w, "2019-01-01").count() == 0


def test_weight_changes_name_what_happened(spark):
    w = spark.createDataFrame([("A", _day(0), 0.5), ("B", _day(0), 0.5), ("B", _day(9), 0.6), ("C", _day(9), 0.4)], "ticker string, trade_date date, w double")
    days = spark.createDataFrame([(_day(0), _day(9))], "a date, b date")
    assert sorted((r.ticker, r.change) for r in training.weight_changes(w, days).collect()) == [("A", "exited"), ("B", "resized"), ("C", "entered")]


def test_splits_touch_earlier_days_only(spark):
    p = _panel(spark, [("A", i, 10.0) for i in range(4)] + [("B", 0, 7.0)])
    s = spark.createDataFrame([("A", _day(1), 0.5), ("A", _day(3), 0.1), ("A", _day(2), 0.0)], "ticker string, split_date date, ratio double")
    got = statements.split_adjusted(p, s, ["adj_close"]).orderBy("ticker", "trade_date").collect()
    assert [r.adj_close for r in got] == pytest.approx([0.5, 1.0, 1.0, 10.0, 7.0])


def test_index_is_interpolated_between_knots(spark):
    days = spark.createDataFrame([(_day(i),) for i in (0, 1, 2, 4, 6)], "date date")
    knots = spark.createDataFrame([(_day(1), 10.0), (_day(5), 30.0)], "date date, value double")
    assert [r.level for r in statements.interpolated(days, knots, "level").orderBy("date").collect()] == [None, 10.0, 15.0, 25.0, 30.0]


def test_total_return_buys_with_dividends(spark):
    s = spark.createDataFrame([("A", _day(0), 10.0), ("A", _day(1), 20.0), ("A", _day(2), 10.0)], "ticker string, date date, real double")
    d = spark.createDataFrame([("A", _day(1), 4.0), ("A", _day(1), 6.0)], "ticker string, date date, amount double")
    assert [r.total for r in statements.total_return(s, d).orderBy("date").collect()] == [10.0, 30.0, 15.0]


def test_statement_ratios_of_a_known_filing(spark):
    row = {"close_price": 10.0, "shares": 100.0, "net_income": 0.05, "equity": 0.25, "net_revenue": 0.5, "total_assets": 1.0, "total_debt": 0.15, "cash": 0.05, "ebitda": 0.2, "ebit": 0.1, "current_assets": 0.4, "current_liabilities": 0.2, "cost_of_revenue": 0.3}
    got = statements.statement_ratios(spark.createDataFrame([row])).collect()[0]
    assert (got.s_market_cap, got.s_pl, got.s_roe, got.s_roa, got.s_net_margin, got.s_debt_equity, got.s_current_ratio) == pytest.approx((1000, 20, 20, 5, 10, 0.6, 2))
    assert statements.statement_ratios(spark.createDataFrame([{**row, "equity": 0.0}])).collect()[0].s_roe is None


def test_panel_gate_of_an_empty_panel_fails(spark):
    empty = spark.createDataFrame([], "ticker string, trade_date date, reference_date date, sector string, log_return double, roe double")
    got = {r.check: r.passed for r in quality.panel_gate(empty, ["roe"]).collect()}
    assert len(got) == 8 and not any(got[k] for k in ("span_years", "long_tickers", "sectors", "largest_sector"))


def test_panel_findings(spark):
    p = spark.createDataFrame([("A", _day(0), _day(2), 1.0, 5.0), ("A", _day(1), None, None, 5.0)], "ticker string, trade_date date, reference_date date, x double, y double")
    got = {(r.check, r.value) for r in quality.panel_findings(p, ["x"], ["x", "y"]).collect()}
    assert got == {("nan_critical", 1.0), ("lookahead", -2.0), ("zero_variance", 5.0)}


def test_scan_takes_the_schema_and_prunes(spark, tmp_path):
    for t in "AB":
        spark.createDataFrame([(t, _day(i), float("nan") if i == 1 else 1.0) for i in range(3)], "ticker string, trade_date date, close double").write.parquet(f"{tmp_path}/p/{t}.parquet")
    df = files.scan(spark, f"{tmp_path}/p", "prices", ["ticker", "trade_date", "close", "num_trades"], ["A"], "2020-01-01", "2020-01-02")
    assert [(r.ticker, r.close, r.num_trades) for r in df.orderBy("trade_date").collect()] == [("A", 1.0, None), ("A", None, None)]
    plan = df._jdf.queryExecution().toString()
    assert "In(ticker" in plan or "EqualTo(ticker,A)" in plan
    assert "adj_close" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_logs_and_documents(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1/log.jsonl").write_text('{"timesteps": 5, "val_sharpe": 0.5}\nbroken\n')
    got = files.training_logs(spark, str(tmp_path / "run1"), "timesteps long, val_sharpe double").collect()
    assert [(r.timesteps, r.run, r.file) for r in got] == [(5, "run1", "log.jsonl")]
    (tmp_path / "m.json").write_text('{"agent": {"sharpe": 0.4,\n "n": 3}}')
    assert sorted(map(tuple, files.metric_documents(spark, str(tmp_path / "m.json")).collect())) == [("agent", "n", 3.0), ("agent", "sharpe", 0.4)]


def test_rates_with_decimal_commas(spark):
    raw = spark.createDataFrame([("02/01/2020", "0,0534"), ("31/02/2020", "1"), ("03/01/2020", "x"), (None, "1")], "data string, valor string")
    assert [tuple(r) for r in files.parsed_rates(raw, "selic").collect()] == [(dt.date(2020, 1, 2), 0.0534)]


def test_listed_tickers(spark):
    df = spark.createDataFrame([("PETR4",), ("BOVA11",), ("ABCD34",), ("abcd3",), (None,)], "ticker string")
    assert sorted(r.ticker for r in files.listed(df).collect()) == ["BOVA11", "PETR4"]


def test_metadata_differences(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "key string, value string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("w", "4")], "key string, value string")
    assert sorted(map(tuple, outputs.metadata_differences(a, b).collect())) == [("w", None, "4"), ("y", "2", "3")]


class _Api(BaseHTTPRequestHandler):
    rows, asked, lock = [{"id": i, "name": f"n{i}"} for i in range(23)], set(), threading.Lock()

    def do_GET(self):
        at = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
        with self.lock:
            first = at["offset"] not in self.asked
            self.asked.add(at["offset"])
        if first and at["offset"] % 10 == 0:
            self.send_response(429 if at["offset"] else 200)
            self.send_header("Content-Length", "0")
            self.end_headers()
            return
        body = json.dumps(self.rows[at["offset"] : at["offset"] + at["limit"]]).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_paged_source_asks_again_and_reads_all(spark):
    server = HTTPServer(("127.0.0.1", 0), _Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(http.PagedJson)
        df = spark.read.format("paged_json").schema("id int, name string, missing string").option("url", f"http://127.0.0.1:{server.server_port}/x").option("limit", "5").option("parallel", "3").option("base", "0.01").load()
        got = sorted(map(tuple, df.collect()))
        assert got == [(i, f"n{i}", None) for i in range(23)]
    finally:
        server.shutdown()


def test_rollout_stream_goes_on_from_its_state(spark, tmp_path):
    r = [0.1, -0.2, 0.05, 0.3]
    whole = _series(spark, r).union(_series(spark, [0.5], "b"))
    whole.where(F.col("date") < _day(2)).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    for part in ("a", "b"):
        if part == "b":
            whole.where((F.col("date") >= _day(1)) & (F.col("strategy") == "a")).coalesce(1).write.parquet(f"{tmp_path}/in/b")  # a day again, and later ones
        rows = rollout_stream(spark.readStream.schema(whole.schema).parquet(f"{tmp_path}/in/*"), 100.0)
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("strategy", "date").collect()
    values = np.cumprod(1 + np.array(r)) * 100
    assert [x.value for x in got] == pytest.approx([*values, 150.0])
    assert got[1].drawdown == pytest.approx(0.2)


def test_ranker_finds_what_was_planted(spark):
    rng = np.random.default_rng(3)
    rows = [(f"T{t:02d}", _day(d), float(rng.normal()), float(rng.normal()), 0.0) for t in range(20) for d in range(60)]
    rows = [(t, d, s, n, 0.5 * s + 0.1 * float(rng.normal())) for t, d, s, n, _ in rows] + [("X", _day(5), None, 1.0, None)]
    p = spark.createDataFrame(rows, "ticker string, trade_date date, signal double, noise double, y double")
    got = ranking.ranked(p, ["signal", "noise"], "y", trees=5).select(F.corr("predicted", "y"), F.min("trade_date")).collect()[0]
    assert got[0] > 0.8 and got[1] > _day(25)
    best = ranking.importances(p, ["noise", "signal"], "y", trees=5).orderBy("consensus").collect()
    assert [r.feature for r in best] == ["signal", "noise"] and best[0].consensus == 1
    assert ranking.importances(p.limit(0), ["noise"], "y").count() == 0


def test_whole_random_null(spark):
    from panelspark.catalog import QUERIES
    from panelspark.catalog_research import ORACLE_SQL
    from tests.oracle import compare

    name = "p12_random_null_200"
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200
    assert compare(spark, name, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001") == ""


def test_random_portfolios_hash_by_batch_as_a_loop_does(spark):
    texts = ["S1", "", "é" * 20, "x" * 36, "x" * 37, "x" * 38, "x" * 39, "x" * 40, "x" * 41, "x" * 42, "x" * 80]
    heads = training.text_heads(b"0|17|", training.text_block(["1995-03-01"] * len(texts), texts))
    assert heads.tolist() == [float(int(hashlib.md5(f"0|17|1995-03-01|{t}".encode()).hexdigest()[:8], 16)) for t in texts]
    rows = [(t, dt.date(2020, 1, 1 + i), None if (i + k) % 5 == 0 else 0.01 * (i - k)) for i in range(9) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, dt.date(2020, 1, 1), 9.0)], "ticker string, trade_date date, returns double")
    got = {(r.strategy, r.date): r.r for r in training.random_portfolios(df.repartition(3), 3, 7).collect()}
    want = {}
    for run in range(3):
        for day in {r[1] for r in rows}:
            own = [(int(hashlib.md5(f"7|{run}|{day}|{t}".encode()).hexdigest()[:8], 16) + 1.0, math.expm1(r)) for t, d, r in rows if d == day and r is not None]
            want[f"random{run}", day] = sum(u * r for u, r in own) / sum(u for u, _ in own)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-15) for k in want)


def test_scalers_and_cuts_meet_rows_by_broadcast(spark):
    days = [(f"T{k}", dt.date(2020, 1, 1 + i), float(i * k), float(i - k)) for i in range(20) for k in range(5)]
    p = spark.createDataFrame(days, "ticker string, trade_date date, a double, b double")
    scalers = spark.createDataFrame([(0, "a", 1.0, 2.0), (0, "b", 0.0, 1.0)], "window_id int, feature string, mean double, std double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scaled = training.scaled(p, ["a", "b"], scalers, 0)
        grid = training.scaled_grid(p, ["a", "b"], scalers, 0)
        ks = significance.two_sample_ks(p.select((F.dayofmonth("trade_date") > 9).alias("second"), "a", "b").unpivot(["second"], ["a", "b"], "feature", "x"))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (scaled, grid, ks)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # a join by the feature would put all of a feature's values in one task
    assert all("SortMergeJoin [feature" not in s and "ShuffledHashJoin [feature" not in s for s in plans)
    assert scaled.count() == 200 and grid.count() == 200 and {r.feature for r in ks.collect()} == {"a", "b"}


def test_fits_compute_their_rows_once(spark):
    rng = np.random.default_rng(0)
    rows = [(f"T{i % 5}", _day(i // 5), float(a), float(b), float(a + 0.1 * b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    p = spark.createDataFrame(rows, "ticker string, trade_date date, a double, b double, t double")
    p = p.mapInArrow(counted, p.schema)
    assert ranking.importances(p, ["a", "b"], "t", trees=2, depth=2).count() == 2 and seen.value == 200
    assert ranking.ranked(p, ["a", "b"], "t", trees=2, depth=2).count() == 100 and seen.value == 400


def test_ranker_fits_cells_as_all_rows(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(1)
    n = 4000
    a, b, x = rng.integers(0, 8, n) / 7, rng.integers(-3, 3, n) * 1.5, rng.choice([0.0, 2.0, 9.0], n, p=[0.9, 0.05, 0.05])
    y = np.sin(5 * a) * b + (x > 1) * 0.7 + rng.normal(size=n) * 0.3
    cut = lambda v, i, k: None if i % k == 0 else float(v)
    rows = [(_day(i % 100), cut(a[i], i, 11), math.nan if i % 13 == 0 else float(b[i]), float(x[i]), cut(y[i], i, 17), i) for i in range(n)]
    p = spark.createDataFrame(rows, "trade_date date, a double, b double, x double, y double, i int")
    names, fit, seen = ["a", "b", "x"], GBTRegressor.fit, []
    monkeypatch.setattr(ranking.GBTRegressor, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    got = {r.i: r.predicted for r in ranking.ranked(p, names, "y").collect()}
    monkeypatch.undo()
    # MLlib's own fit: of so few rows and values it takes every split there is
    plain = Pipeline(stages=[Imputer(inputCols=names, outputCols=["_0", "_1", "_2"], strategy="median"), VectorAssembler(inputCols=["_0", "_1", "_2"], outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol="y", predictionCol="predicted", maxIter=20, maxDepth=3)])
    early = p.where(F.col("trade_date") <= _day(49))
    want = {r.i: r.predicted for r in plain.fit(early.where("y IS NOT NULL")).transform(p.where(F.col("trade_date") > _day(49))).collect()}
    assert got.keys() == want.keys() and len(want) == 2000
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-12) for i in want)
    assert seen[0] <= 8 * 6 * 3  # cells, not the 1,882 rows
    assert ranking.ranked(p.limit(0), names, "y").count() == 0
    none = ranking.ranked(p.withColumn("a", F.lit(None).cast("double")), names, "y", trees=2)
    assert none.where("predicted IS NOT NULL").count() == 2000


def test_cuts_of_the_ranker():
    assert ranking._cuts([1.0] * 200 + [2.0, 3.0]) == [1.0, 2.0, 3.0]
    assert ranking._cuts([-math.inf, math.inf]) == [0.0] == ranking._cuts([])
    assert ranking._cuts([float(i) for i in range(256)]) == [8.0 * i for i in range(1, 32)]


def test_ranker_is_given_what_it_reads(spark, monkeypatch):
    from panelspark import catalog, catalog_research  # noqa: F401  it registers the query

    seen = []
    monkeypatch.setattr(ranking, "ranked", lambda p, *_: seen.extend(p.columns) or p.withColumn("predicted", F.col("forward")))
    catalog.QUERIES["p16_ranker_ic"](spark, "/root/testdata/sf0.001")
    assert sorted(seen) == sorted(["trade_date", "volatility_20d", "hl_ratio", "drawdown", "rsi_14", "return_1m", "forward"])


def test_daily_ranks_sort_a_day_once_each(spark):
    rows = [(_day(d), float(v), float(-v % 3)) for d in range(2) for v in range(12)]
    ic = performance.daily_rank_ic(spark.createDataFrame(rows, "trade_date date, f double, t double"), "f", "t")
    assert ic._jdf.queryExecution().executedPlan().toString().count("Sort [trade_date") == 2 and ic.count() == 2
