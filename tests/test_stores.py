"""Versioned stores, data sources over HTTP and in blocks, routing, grids, range joins and quantiles, against loops."""

import glob
import datetime as dt
import json
import math
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from statistics import NormalDist
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark import catalog, catalog_stores
from panelspark.functions.columns import normal_quantile
from panelspark.functions.quantiles import exact_quantiles
from panelspark.operators import grid, ranges, significance
from panelspark.sources import arrays, dated, files, http, outputs, router
from panelspark.streaming import store as stores
from panelspark.streaming.rollout import portfolio_stream
from panelspark.streaming.upsert import stream_upsert

PUSH = "spark.sql.python.filterPushdown.enabled"


@pytest.fixture
def pushed(spark):
    spark.conf.set(PUSH, "true")
    yield
    spark.conf.unset(PUSH)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _log(spark, *rs):
    return spark.createDataFrame(rs, "k int, v string, fetch long")


def test_earlier_fetch_that_arrives_later_loses(spark, tmp_path):
    held = stores.Store(spark, f"{tmp_path}/t", ["k"], 4)
    held.upsert(_log(spark, (1, "new", 5), (2, "b", 5)), "fetch")
    held.upsert(_log(spark, (1, "old", 3), (3, "c", 3), (None, "no key", 1)), "fetch")
    held.upsert(_log(spark, (3, "null fetch", None), (4, None, None)), "fetch")
    want = [(1, "new", 5), (2, "b", 5), (3, "c", 3), (4, None, None), (None, "no key", 1)]
    assert rows(held.read()) == sorted(want, key=repr) and held.versions() == [1, 2, 3]
    assert rows(held.read(1)) == [(1, "new", 5), (2, "b", 5)]
    held.upsert(_log(spark).limit(0), "fetch")
    assert held.versions() == [1, 2, 3]


def test_order_of_arrival_makes_no_difference(spark, tmp_path):
    batches = [_log(spark, *((k, f"v{b}{k % 3}", b * (k % 5)) for k in range(20) if (k + b) % 3)) for b in range(3)]
    made = []
    for name, order in (("a", (0, 1, 2)), ("b", (2, 0, 1)), ("c", (1, 1, 2, 0))):
        held = stores.Store(spark, f"{tmp_path}/{name}", ["k"], 3)
        for b in order:
            held.upsert(batches[b], "fetch")
        made.append(rows(held.read()))
    assert made[0] == made[1] == made[2] and len(made[0]) == 20


def test_columns_come_and_lack(spark, tmp_path):
    held = stores.Store(spark, f"{tmp_path}/t", ["k"], 2)
    held.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 1)
    held.upsert(spark.createDataFrame([(2, 7.0)], "k int, w double"), 2)
    assert rows(held.read().select("k", "v", "w")) == [(1, "a", None), (2, None, 7.0)]


def test_killed_before_the_manifest_keeps_all_rows(spark, tmp_path, monkeypatch):
    held = stores.Store(spark, f"{tmp_path}/t", ["k"], 4)
    held.upsert(_log(spark, *((k, "one", 1) for k in range(10))), "fetch")
    monkeypatch.setattr(stores.Store, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        held.upsert(_log(spark, *((k, "two", 2) for k in range(5, 15))), "fetch")
    monkeypatch.undo()
    assert rows(stores.Store(spark, f"{tmp_path}/t").read()) == [(k, "one", 1) for k in range(10)]
    again = stores.Store(spark, f"{tmp_path}/t")
    again.upsert(_log(spark, *((k, "two", 2) for k in range(5, 15))), "fetch")
    whole = rows(again.read())
    assert whole == sorted([(k, "one", 1) for k in range(5)] + [(k, "two", 2) for k in range(5, 15)], key=repr)
    assert again.vacuum(keep=1, older_seconds=0) > 0 and rows(again.read()) == whole


def test_killed_after_the_manifest_runs_the_batch_again(spark, tmp_path, monkeypatch):
    log = _log(spark, (1, "a", 1), (2, "b", 1))
    log.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    publish = stores.Store._publish

    def killed(self, manifest):
        publish(self, manifest)
        raise RuntimeError("killed")

    monkeypatch.setattr(stores.Store, "_publish", killed)
    with pytest.raises(Exception, match="killed"):
        stream_upsert(spark, f"{tmp_path}/in/*", log.schema, f"{tmp_path}/t", ["k"], f"{tmp_path}/ck", 4, "fetch")
    monkeypatch.undo()
    _log(spark, (1, "late", 0), (3, "c", 2)).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    got = stream_upsert(spark, f"{tmp_path}/in/*", log.schema, f"{tmp_path}/t", ["k"], f"{tmp_path}/ck", 4, "fetch")
    assert rows(got) == [(1, "a", 1), (2, "b", 1), (3, "c", 2)]


def test_another_writer_is_not_overwritten(spark, tmp_path, monkeypatch):
    held, publish = stores.Store(spark, f"{tmp_path}/t", ["k"], 1), stores.Store._publish
    held.upsert(_log(spark, (1, "a", 1)), "fetch")
    raced = []

    def slow(self, manifest):
        if not raced:
            raced.append(True)
            stores.Store(spark, f"{tmp_path}/t").upsert(_log(spark, (2, "other", 1)), "fetch")
        publish(self, manifest)

    monkeypatch.setattr(stores.Store, "_publish", slow)
    held.upsert(_log(spark, (3, "mine", 1)), "fetch")
    assert rows(held.read()) == [(1, "a", 1), (2, "other", 1), (3, "mine", 1)]


class _Dated(BaseHTTPRequestHandler):
    data = {"A": 400, "B": 30}
    latest, asked = dt.date(2020, 12, 31), []

    def do_GET(self):
        at = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(at.query).items()}
        if at.path == "/latest":
            body, code = {"date": str(_Dated.latest)}, 200
        elif at.path == "/tickers":
            body, code = list(_Dated.data), 200
        else:
            _Dated.asked.append((q["ticker"], q["start"], q["end"]))
            days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(_Dated.data.get(q["ticker"], 0))]
            body = {"prices": [{"day": str(d), "px": str(i + 0.5), "note": None, "n": "x"} for i, d in enumerate(days) if q["start"] <= str(d) <= q["end"]]}
            code = 200 if q["ticker"] in _Dated.data else 404
        body = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def api():
    server = HTTPServer(("127.0.0.1", 0), _Dated)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    _Dated.data, _Dated.latest, _Dated.asked = {"A": 400, "B": 30}, dt.date(2020, 12, 31), []
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


SCHEMA = "ticker string, trade_date date, close double, note string, n long"


def _options(reader, api, **more):
    options = {"url": f"{api}/h", "start": "2020-01-01", "tickers_url": f"{api}/tickers", "latest_url": f"{api}/latest", "rows": "prices", "base": "0.01", "rename": json.dumps({"day": "trade_date", "px": "close"})} | more
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.schema(SCHEMA).format("dated_json")


def test_stopped_stream_goes_on_without_loss_or_repeats(spark, tmp_path, api):
    spark.dataSource.register(dated.DatedJson)

    def run():
        _Dated.asked.clear()
        df = _options(spark.readStream, api).load()
        df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(once=True).start().awaitTermination()
        return spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").groupBy("ticker").agg(F.count("*").alias("n"), F.countDistinct("trade_date").alias("d"), F.max("trade_date").alias("m")).orderBy("ticker").collect()

    assert [(r.ticker, r.n, r.d) for r in run()] == [("A", 366, 366), ("B", 30, 30)]
    assert {a[0] for a in _Dated.asked} == {"A", "B"} and all("2020-01-01" <= a[1] <= a[2] <= "2020-12-31" for a in _Dated.asked)
    _Dated.latest, _Dated.data = dt.date(2021, 3, 1), {"A": 400, "B": 31, "C": 3}
    got = run()
    assert [(r.ticker, r.n, r.d) for r in got] == [("A", 400, 400), ("B", 30, 30), ("C", 3, 3)]  # B's day lies before the mark
    assert {a for a in _Dated.asked if a[0] != "C"} == {("A", "2021-01-01", "2021-03-01"), ("B", "2021-01-01", "2021-03-01")}
    assert min(a[1] for a in _Dated.asked if a[0] == "C") == "2020-01-01"
    first = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").where("ticker = 'A'").orderBy("trade_date").first()
    assert (first.close, first.note, first.n) == (0.5, None, None)  # fields by name and type; what can't be read is null


def test_filters_reach_the_requests(spark, api, pushed):
    spark.dataSource.register(dated.DatedJson)
    df = _options(spark.read, api).load().where("ticker IN ('B', 'Z') AND trade_date >= date'2020-01-10' AND trade_date < date'2020-02-01'")
    assert df.count() == 21 and {a[0] for a in _Dated.asked} == {"B"}
    assert all(a[1:] == ("2020-01-10", "2020-01-31") for a in _Dated.asked)
    _Dated.asked.clear()
    one = _options(spark.read, api, tickers="A,Q").load()
    assert one.where("trade_date = date'2020-05-05'").count() == 1
    assert set(_Dated.asked) == {("A", "2020-05-05", "2020-05-05"), ("Q", "2020-05-05", "2020-05-05")}


def test_windows_cover_without_overlap():
    for start in (dt.date(2019, 2, 28), dt.date(2020, 2, 29), dt.date(2020, 1, 31)):
        parts = list(dated.windows("A", start, dt.date(2024, 3, 1), 1))
        assert parts[0].start == start and parts[-1].end == dt.date(2024, 3, 1)
        assert all(b.start - a.end == dt.timedelta(1) for a, b in zip(parts, parts[1:])) and all((p.end - p.start).days <= 366 for p in parts)
    assert list(dated.windows("A", dt.date(2020, 1, 2), dt.date(2020, 1, 1), 1)) == []


def test_router_asks_each_source_for_its_own_tickers(spark, api, pushed):
    spark.dataSource.register(dated.DatedJson)
    routes = spark.createDataFrame([("prices", None, "api", 1), ("prices", "B", "file", 0), ("prices", "F", "file", 1), ("other", "A", "file", 0)], "name string, ticker string, source string, precedence int")
    held = spark.createDataFrame([(t, dt.date(2020, 1, 1), 9.0, None, None) for t in ("A", "B", "F")], SCHEMA)
    sources = {"api": _options(spark.read, api).load(), "file": held}
    got = router.routed_by_name(sources, routes, "prices", ["A", "B", "F"])
    assert {(r.ticker, r.source) for r in got.select("ticker", "source").distinct().collect()} == {("A", "api"), ("B", "file"), ("F", "file")}
    assert {a[0] for a in _Dated.asked} == {"A"}
    all_of = router.routed({"file": held, "more": held.where("ticker = 'A'")}, routes.union(spark.createDataFrame([("prices", None, "more", 5), ("prices", None, "file", 7)], routes.schema)), "prices")
    assert rows(all_of.select("ticker", "source")) == [("A", "more"), ("B", "file"), ("F", "file")]


class _Short(BaseHTTPRequestHandler):
    def do_GET(self):
        offset = int(parse_qs(urlparse(self.path).query)["offset"][0])
        body = json.dumps([{"id": i} for i in range(offset, min(offset + 5, 10))]).encode()
        self.send_response(200 if offset < 10 else 404)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_pages_past_the_end_may_be_missing(spark):
    server = HTTPServer(("127.0.0.1", 0), _Short)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(http.PagedJson)
        df = spark.read.format("paged_json").schema("id int").option("url", f"http://127.0.0.1:{server.server_port}/x").option("limit", "5").option("parallel", "4").option("base", "0.01").load()
        assert rows(df) == [(i,) for i in range(10)]
    finally:
        server.shutdown()


def _cells(spark):
    day = dt.date(2020, 1, 1)
    data = [(day + dt.timedelta(i), f"T{j:02d}", float(i * 10 + j) if (i + j) % 7 else None, None) for i in range(23) for j in range(9) if (i * j) % 3 != 1]
    return spark.createDataFrame([*data, (None, "T01", 1.0, 1.0), (day, None, 1.0, 1.0)], "date date, ticker string, a double, b double")


def test_array_store_gives_the_panel_back(spark, tmp_path, pushed):
    long = _cells(spark)
    path = f"{tmp_path}/arrays"
    arrays.write_arrays(long, path, ["a", "b"], days=5, names=4)
    got = arrays.read_arrays(spark, path)
    whole = long.where("date IS NOT NULL AND ticker IS NOT NULL")
    assert rows(got) == rows(whole) and got.columns == ["date", "ticker", "a", "b"]
    assert got.rdd.getNumPartitions() == 5 * 3
    late = got.where("date >= date'2020-01-21' AND ticker = 'T08'")
    assert late.rdd.getNumPartitions() == 1 and rows(late) == rows(whole.where("date >= date'2020-01-21' AND ticker = 'T08'"))
    shape = np.load(f"{path}/{arrays._manifest(path)['blocks'][0]['file']}")
    assert shape["values"].shape == (2, 5, 4) and shape["mask"].shape == (5, 4)
    arrays.write_arrays(long.where("ticker = 'T00'"), path, ["a", "b"], days=5, names=4)
    assert rows(arrays.read_arrays(spark, path)) == rows(whole.where("ticker = 'T00'"))


def test_failed_array_write_leaves_the_store(spark, tmp_path):
    path = f"{tmp_path}/arrays"
    arrays.write_arrays(_cells(spark), path, ["a"], days=5, names=4)
    before = rows(arrays.read_arrays(spark, path))
    broken = arrays.blocks(_cells(spark), ["a"], days=5, names=4).withColumn("i", F.expr("transform(i, x -> x + if(name_block = 2, 99, 0))"))
    with pytest.raises(Exception):
        broken.write.format("array_blocks").option("features", "a").option("days", 5).option("names", 4).mode("overwrite").save(path)
    assert rows(arrays.read_arrays(spark, path)) == before


def test_grid_equals_a_cross_join(spark):
    day = dt.date(2020, 1, 1)
    held = [("A", 0, 1.0), ("A", 1, None), ("A", 4, 3.0), ("B", 2, 4.0), ("C", 0, 5.0), ("C", 4, 6.0), ("C", 4, 7.0)]
    df = spark.createDataFrame([(t, day + dt.timedelta(i), x) for t, i, x in held] + [(None, day, 1.0), ("D", None, 1.0)], "ticker string, trade_date date, x double")
    got = grid.grid(df, ["x"], fill=0.0)
    want = []
    for t in "ABC":
        for i in (0, 1, 2, 4):
            mine = [x for a, b, x in held if (a, b) == (t, i)]
            want += [(day + dt.timedelta(i), t, True, x) for x in mine] or [(day + dt.timedelta(i), t, False, 0.0)]
    assert rows(got) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert grid.grid(df.limit(0), ["x"]).count() == 0


def test_cross_check_counts_planted_differences(spark):
    base = [(i, f"k{i % 7}", float(i), None if i % 11 == 0 else 1.0) for i in range(300)]
    other = [(i, k, x + (0.01 if i in (5, 6) else 5e-5), None if i == 7 else y) for i, k, x, y in base if i not in (8, 9)] + [(1000, "k0", 1.0, 1.0)]
    a, b = (spark.createDataFrame(r, "i int, k string, x double, y double") for r in (base, other))
    got = {r["item"]: r for r in grid.cross_check(a, b, ["i", "k"], ["x", "y"], share=1.0).collect()}
    assert tuple(got["x"])[1:] == (298, 2, 2, 1) and tuple(got["y"])[1:] == (298, 1, 2, 1)
    part = grid.cross_check(a, b, ["i", "k"], ["x"], share=0.3).first()
    assert 40 < part.checked < 140 and rows(grid.sampled(a, ["i", "k"], 0.3).select("i")) == rows(grid.sampled(a.repartition(3), ["i", "k"], 0.3).select("i"))


@pytest.mark.parametrize("size", [2000, 3])
def test_overlaps_equal_a_loop(spark, size):
    rng = np.random.default_rng(0)
    left = [(i, i % 3, float(a), float(a + n)) for i, (a, n) in enumerate(zip(rng.normal(size=150) * 10, rng.pareto(0.7, 150)))]
    left += [(1000, 0, None, 1.0), (1001, 0, 3.0, 2.0), (1002, 1, -math.inf, math.inf), (1003, 2, 5.0, 5.0), (1003, 2, 5.0, 5.0)]
    right = [(i, i % 3, float(a), float(a + n)) for i, (a, n) in enumerate(zip(rng.normal(size=120) * 10, rng.pareto(0.5, 120) * 0.1))] + [(2000, 2, 5.0, 5.0), (2001, 2, 5.0, 6.0), (2002, None, 0.0, 1.0)]
    a = spark.createDataFrame(left, "i int, g int, a double, b double")
    b = spark.createDataFrame(right, "j int, g int, x double, y double")
    met = lambda a, b, x, y: None not in (a, x) and a <= b and x <= y and a <= y and x <= b
    got = ranges.overlaps(a, b.withColumnRenamed("g", "h"), ("a", "b"), ("x", "y"), range_rows=size)
    assert rows(got.select("i", "j")) == sorted(((p[0], q[0]) for p in left for q in right if met(*p[2:], *q[2:])), key=repr)
    keyed = ranges.overlaps(a, b, ("a", "b"), ("x", "y"), ["g"], size)
    assert rows(keyed.select("i", "j")) == sorted(((p[0], q[0]) for p in left for q in right if p[1] == q[1] and met(*p[2:], *q[2:])), key=repr)
    assert ranges.overlaps(a.limit(0), b.drop("g"), ("a", "b"), ("x", "y")).count() == 0
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("top", [0, 11])
def test_overlap_totals_equal_those_of_a_loop(spark, monkeypatch, top):
    monkeypatch.setattr(ranges, "TOP_LEVELS", top)
    rng = np.random.default_rng(1)
    left = [(i, float(a), float(a + n)) for i, (a, n) in enumerate(zip(np.round(rng.normal(size=150) * 10), rng.pareto(0.7, 150)))]
    left += [(1000, None, 1.0), (1001, 3.0, 2.0), (1002, -math.inf, math.inf), (1003, 5.0, 5.0), (1003, 5.0, 5.0), (1004, math.nan, math.nan), (1005, 1e300, 1e301), (1006, 0.0, 0.0)]
    right = [(i, float(a), float(a + n)) for i, (a, n) in enumerate(zip(np.round(rng.normal(size=120) * 10), rng.pareto(0.5, 120) * 0.1))] + [(2000, 5.0, 5.0), (2000, 5.0, 5.0), (2001, -0.0, 6.0), (2002, 4.0, None), (2003, math.nan, math.nan)]
    a, b = spark.createDataFrame(left, "i int, a double, b double"), spark.createDataFrame(right, "j int, x double, y double")
    got = ranges.overlap_totals(a, b, ("a", "b"), ("x", "y"), {"n": ("sum", F.lit(1)), "first": ("min", F.col("j")), "last": ("max", F.col("j")), "total": ("sum", F.col("j"))})
    want = []
    for i, p, q in left:
        js = [j for j, x, y in right if None not in (p, x, y) and p <= q and x <= y and p <= y and x <= q]
        want += [(i, len(js), min(js), max(js), sum(js))] if js else []
    assert rows(got.select("i", "n", "first", "last", "total")) == sorted(want, key=repr)
    assert ranges.overlap_totals(a.limit(0), b, ("a", "b"), ("x", "y"), {"n": ("sum", F.lit(1))}).count() == 0


def test_range_bounds_are_one_literal_of_the_plan(spark):
    bounds = [float(i) + 0.1 for i in range(5000)]
    df = spark.range(1).select(ranges._place(F.col("id") + 7.1, bounds).alias("at"))
    assert df.first().at == 8
    tree = lambda e: 1 + sum(tree(e.children().apply(i)) for i in range(e.children().size()))
    assert tree(df._jdf.queryExecution().analyzed().expressions().apply(0)) < 200


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_quantiles_equal_sorting(spark, size):
    rng = np.random.default_rng(0)
    data = [("a", float(x)) for x in rng.integers(0, 50, 500)] + [("b", float(x)) for x in rng.normal(size=777)] + [("c", None)] * 3 + [(None, 1.0), (None, 4.0), ("d", 2.0)]
    got = exact_quantiles(spark.createDataFrame(data, "g string, x double"), "g", "x", [0.0, 0.25, 0.5, 0.9, 1.0], size).collect()
    assert {r.g for r in got} == {"a", "b", "c", "d", None}
    for r in got:
        held = [x for g, x in data if g == r.g and x is not None]
        assert (r.n, r.n_distinct) == (len(held), len(set(held)))
        assert np.allclose(r.quantiles, np.quantile(held, [0, 0.25, 0.5, 0.9, 1])) if held else r.quantiles is None
    assert exact_quantiles(spark.createDataFrame([], "g string, x double"), "g", "x", [0.5], size).count() == 0


def test_normal_quantile(spark):
    shares = [1e-12, 1e-8, 1e-4, 0.01, 0.02425, 0.3, 0.5, 0.7, 0.99, 1 - 1e-6]
    for r in spark.createDataFrame([(p,) for p in shares], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=2e-9 if r.p < 1e-6 else 1e-10, abs=1e-15)
    assert spark.range(1).select(normal_quantile(F.lit(0.0)), normal_quantile(F.lit(1.0)), normal_quantile(F.lit(None).cast("double"))).first() == (None, None, None)


def test_expected_maximum(spark):
    best = lambda x: significance.expected_max(spark.createDataFrame([(v,) for v in x], "s double")).first().benchmark
    z, n = NormalDist().inv_cdf, 4
    want = np.std([1.0, 2.0, 3.0, 5.0]) * ((1 - 0.5772156649) * z(1 - 1 / n) + 0.5772156649 * z(1 - 1 / (n * math.e)))
    assert best([1.0, 2.0, 3.0, 5.0, None]) == pytest.approx(want, rel=1e-12) and best([1.0]) == best([2.0, 2.0]) == best([]) == 0.0


def test_tickers_of_files_with_unreadable_bodies(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("PETR4.parquet", "deep/VALE3.parquet", "notes.txt", "_SUCCESS"):
        (tmp_path / name).write_bytes(b"not parquet at all")
    (tmp_path / "PETR4.parquet").chmod(0)
    got = files.tickers_of_files(spark, str(tmp_path))
    assert {(r.ticker, r.bytes) for r in got.collect()} == {("PETR4", 18), ("VALE3", 18)}


def test_files_by_ticker_stand_in_one_folder(spark, tmp_path, monkeypatch):
    """each ticker had a folder, which takes processes for its permissions and a task to list it."""
    names = ["A/B", "A+B", "A B", "_X", ".Y", "50%", "S1", None]
    df = spark.createDataFrame([(t, i, float(i)) for t in names for i in range(3)], "ticker string, i int, x double")
    assert outputs.write_by_ticker(df, f"file://{tmp_path}/t") == len(names) == len([p for p in (tmp_path / "t").iterdir() if p.is_file()])
    got = files.tickers_of_files(spark, f"{tmp_path}/t", r"ticker=([^/]+)\.parquet$").collect()
    assert {r.ticker for r in got} == {outputs.NO_TICKER if t is None else t for t in names} and all(r.bytes > 0 for r in got)
    assert rows(spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/t")) == rows(df)
    with pytest.raises(FileExistsError):
        outputs.write_by_ticker(df, f"file://{tmp_path}/t")
    monkeypatch.setattr(catalog_stores, "scratch_dir", lambda s, name: f"file://{tmp_path}/{name}")
    assert catalog.QUERIES["s08_listed_tickers"](spark, "/root/testdata/sf0.001").count() == 10
    assert [p.name for p in (tmp_path / "named").iterdir() if p.is_dir()] == []


def test_portfolio_stream_goes_on_with_its_weights(spark, tmp_path):
    rng, day = np.random.default_rng(1), dt.date(2020, 1, 1)
    names = ["A", "B", "C"]
    data = [(s, day + dt.timedelta(i), t, None if (i, t) == (4, "B") else float(rng.normal(0, 0.02)), float(w) if i % 5 == 0 else None) for s in ("x", "y") for i in range(14) for t, w in zip(names, rng.dirichlet((1, 1, 1))) if not (s == "y" and i % 4 == 3 and t == "C")]
    data += [("x", None, "A", 1.0, 1.0), ("x", day, None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "strategy string, date date, ticker string, r double, target double")
    want = []
    for s in ("x", "y"):
        w, value, peak = {}, 100.0, 100.0
        for i in range(14):
            mine = {t: (r or 0.0, x) for a, d, t, r, x in data if a == s and d == day + dt.timedelta(i) and t}
            cost = 0.0
            if any(x is not None for _, x in mine.values()):
                goal = {t: x for t, (_, x) in mine.items() if x}
                cost = 0.001 * sum(abs(goal.get(t, 0) - w.get(t, 0)) for t in names)
                w = goal
            gross = sum(v * mine.get(t, (0.0, 0))[0] for t, v in w.items())
            value *= 1 + gross - cost
            peak = max(peak, value)
            want.append((s, day + dt.timedelta(i), cost, value, 1 - value / peak))
            w = {t: v * (1 + mine.get(t, (0.0, 0))[0]) / (1 + gross) for t, v in w.items()}
    for name, chunk in (("a", df.where("date < '2020-01-08' OR date IS NULL")), ("b", df.where("date >= '2020-01-06'"))):  # two days come again
        chunk.coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        rows_ = portfolio_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*"), 0.001, 100.0)
        rows_.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("strategy", "date").collect()
    assert [(r.strategy, r.date) for r in got] == [x[:2] for x in want]
    assert np.allclose([(r.cost, r.value, r.drawdown) for r in got], [x[2:] for x in want])


def test_array_writer_unfolds_one_block_at_a_time(tmp_path):
    class Batch:  # of the calls that a record batch has, those for the rows
        def __init__(self, rows):
            self.rows, self.num_rows = rows, len(rows)

        def slice(self, at, n):
            return Batch(self.rows[at : at + n])

        def to_pylist(self):
            assert self.num_rows == 1
            return self.rows

    block = lambda k: {"i": [0, 1], "j": [0, 0], "date": [dt.date(2020, 1, 1), dt.date(2020, 1, 2)], "ticker": [f"T{k}"] * 2, "x": [1.0, None]}
    writer = arrays.BlockWriter({"path": f"file://{tmp_path}", "features": "x", "days": "2", "names": "1"}, True)
    assert [(e["least"], e["cells"]) for e in writer.write(iter([Batch([block(k) for k in range(3)])])).entries] == [("T0", 2), ("T1", 2), ("T2", 2)]


def test_quantiles_compute_their_rows_once(spark):
    """each pass over the counts computed them again."""
    seen = spark.sparkContext.accumulator(0)

    def mark(x):
        seen.add(1)
        return x

    long = spark.range(50).select(F.lit("a").alias("g"), F.udf(mark, "double")(F.col("id").cast("double")).alias("x"))
    assert exact_quantiles(long, "g", "x", [0.0, 0.5, 1.0], 7).first()["quantiles"] == [0.0, 24.5, 49.0]
    assert seen.value == 50


def test_store_writes_as_many_files_as_its_rows_ask_for(spark, tmp_path, monkeypatch):
    """F16: a partition was one task's, however many rows it had."""
    monkeypatch.setattr(stores, "FILE_ROWS", 50)
    held = stores.Store(spark, f"{tmp_path}/t", ["k"], 2)
    for fetch in (2, 1):
        held.upsert(spark.range(1000).select(F.col("id").alias("k"), F.lit(fetch).alias("v"), F.lit(fetch).alias("f")), "f")
    for folder in held.manifest()["folders"].values():
        assert len(glob.glob(f"{tmp_path}/t/{folder}/*.parquet")) > 4
    assert held.read().groupBy("v").count().collect() == [(2, 1000)]
