"""Draws by weight, bootstraps without rows for draws, and runs that are kept."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ranking as rk
from corpusmill.operators import sampling as sm
from corpusmill.operators import splits as sp
from corpusmill.operators.runs import Runs


def test_running_sums_and_buckets(spark):
    rng = random.Random(1)
    items = [(f"i{k:04d}", rng.choice([0, 0, 1, 5, 900])) for k in range(700)]
    frame = spark.createDataFrame(items, "item string, w long").repartition(5)
    got = {r.item: r.before for r in rk.running_sums(frame, [F.col("item")], "w").collect()}
    total, want = 0, {}
    for k, w in sorted(items):
        want[k], total = total, total + w
    assert got == want
    bounds = rk.running_sums(frame, [F.col("item")], "w", "lo").select("item", (F.col("lo") / total).alias("lo"), ((F.col("lo") + F.col("w")) / total).alias("hi"))
    draws = spark.range(3000).select("id", (F.col("id") / 3000).alias("u"))
    for most in (1 << 20, 4):
        found = {r.id: r.item for r in rk.looked_up(draws, F.col("u"), bounds, most).collect()}
        assert len(found) == 3000
        for i, item in found.items():
            assert want[item] / total <= i / 3000 < (want[item] + dict(items)[item]) / total


def test_choice_among_a_million(spark):
    items = spark.range(1_000_000).select(F.col("id").alias("item"), F.when(F.col("id") == 17, 1_000_000.0).otherwise(F.col("id") % 2).alias("w"))
    chosen = sp.weighted_choice(items, 4000, "x")
    joins = chosen._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in joins and "Cartesian" not in joins
    got = [r.item for r in chosen.collect()]
    assert len(got) == 4000 and all(i == 17 or i % 2 for i in got)
    heavy = sum(i == 17 for i in got)
    assert abs(heavy - 4000 * 2 / 3) < 5 * math.sqrt(4000 * 2 / 9)
    even = sp.weighted_choice(spark.range(4).select(F.col("id").alias("item"), F.lit(0.0).alias("w")), 2000, "y")
    assert all(abs(r["count"] - 500) < 100 for r in even.groupBy("item").count().collect()) and even.count() == 2000


def test_resamples_of_a_histogram(spark):
    pmf = spark.createDataFrame([(k, n) for k, n in enumerate([5, 0, 40, 1, 300, 154])], "label long, n long")
    b, total = 300, 500
    rows = sm.resample_histogram(pmf, "s", b).collect()
    sums, by = {}, {}
    for r in rows:
        sums[r.b] = sums.get(r.b, 0) + r.n
        by.setdefault(r.label, []).append(r.n)
    assert sums == {i: total for i in range(b)} and 1 not in by
    for label, n in ((0, 5), (2, 40), (3, 1), (4, 300), (5, 154)):
        values = by[label] + [0] * (b - len(by[label]))
        mean, var = sum(values) / b, n * (1 - n / total)
        assert abs(mean - n) < 5 * math.sqrt(var / b)
        spread = sum((v - mean) ** 2 for v in values) / b
        assert 0.6 * var < spread < 1.5 * var
    again = sm.resample_histogram(pmf.repartition(4), "s", b).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    large = {r.label: r.n for r in sm.resample_histogram(pmf, "t", 1, 10**9).collect()}
    assert sum(large.values()) == 10**9 and abs(large[4] - 6 * 10**8) < 10**5
    assert sm.resample_histogram(pmf.limit(0), "s", 3).count() == 0
    ci = sm.bootstrap_histogram(pmf, 0.05, 200, "s").first()
    exact = sum(k * n for k, n in enumerate([5, 0, 40, 1, 300, 154])) / total
    assert ci.low < exact < ci.high and ci.high - ci.low < 0.2


def test_drawn_one_by_one(spark):
    values = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 3, 50)], "v double")
    ci = sm.bootstrap_ci(values, "v", "max", b=200).first()
    assert ci.low in (1, 2, 3, 50) and ci.high == 50
    pmf = spark.createDataFrame([("a", 3), ("b", 0), ("c", 7)], "label string, n long")
    got = {r.label: r.n for r in sm.resample_pmf(pmf, "p", 5000).collect()}
    assert sum(got.values()) == 5000 and abs(got["c"] - 3500) < 200 and "b" not in got


def test_runs_are_kept(spark, tmp_path):
    calls = []

    def work(n):
        def run():
            calls.append(n)
            return spark.range(n)

        return run

    runs = Runs(spark, f"file://{tmp_path}/r")
    assert not runs.has({"a": "1"})
    assert runs.result({"a": "1", "b": "2", "uuid": "x"}, work(5)).count() == 5
    assert runs.result({"b": "2", "a": "1", "uuid": "y", "learn_time": "3"}, work(5)).count() == 5 and calls == [5]
    other = Runs(spark, f"file://{tmp_path}/r")
    assert other.result({"a": "1", "b": "2"}, work(5)).count() == 5 and calls == [5] and other.reused and not other.ran

    def broken():
        calls.append("broken")
        return spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))

    with pytest.raises(Exception, match="no"):
        other.result({"a": "2"}, broken)
    assert not other.has({"a": "2"}) and other.result({"a": "2"}, work(7)).count() == 7
    assert {r.meta["a"] for r in other.committed().collect()} == {"1", "2"} and all("run_time" in r.meta for r in other.committed().collect())
