import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from outagelens.operators import ranking
from outagelens.operators.lookups import cohort_of_top
from outagelens.operators.quantiles import grouped_quantiles, value_table
from outagelens.operators.scans import ranged
from outagelens.operators.shape import canonical_order, compared, mean_of_columns, reindexed, with_percentage
from outagelens.plans.kpis import outlier_groups
from outagelens.plans.sites import pareto_marks


@pytest.fixture(scope="module")
def numbers():
    """Three groups, one with most rows, with ties, negatives and missing values."""
    random = np.random.default_rng(7)
    frame = pd.DataFrame({
        "id": range(3000),
        "g": random.choice(["hot", "b", "c"], 3000, p=[0.7, 0.2, 0.1]),
        "x": np.where(random.random(3000) < 0.3, 5.0, random.normal(0, 100, 3000).round(3)),
        "n": random.integers(1, 40, 3000),
    })
    frame.loc[random.random(3000) < 0.05, "x"] = np.nan
    return frame


@pytest.fixture(scope="module")
def table(spark, numbers):
    rows = spark.createDataFrame(numbers)
    return rows.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def test_quantiles(table, numbers):
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = grouped_quantiles(table, ["g"], "x", shares).toPandas().set_index("g")
    for name, share in shares.items():
        want = numbers.groupby("g")["x"].quantile(share)
        assert np.allclose(got[name].sort_index(), want.sort_index(), rtol=0, atol=1e-9)
    total = grouped_quantiles(table, [], "x", {"m": 0.5}).collect()[0]["m"]
    assert total == pytest.approx(numbers["x"].median())


def test_percentile_ranks(table, numbers):
    got = ranking.value_ranks(table, ["g"], ["id"], {"x": "rx", "n": "rn"}).toPandas().set_index("id").sort_index()
    for value, rank in (("x", "rx"), ("n", "rn")):
        want = numbers.groupby("g")[value].rank(pct=True, na_option="bottom") * 100
        assert np.allclose(got[rank], want)


def test_small_ranks(spark):
    values = pd.Series([3.0, 1.0, 3.0, 2.0, 2.0, 2.0])
    rows = spark.createDataFrame(pd.DataFrame({"i": range(6), "v": values}))
    got = rows.withColumns({
        "mean": ranking.average_rank(F.desc("v"), F.col("v")),
        "least": ranking.min_rank(F.asc("v")),
        "scaled": ranking.min_max(F.col("v"), invert=True),
    }).toPandas().sort_values("i")
    assert list(got["mean"]) == list(values.rank(ascending=False))
    assert list(got["least"]) == list(values.rank(method="min"))
    assert np.allclose(got["scaled"], 100 - (values - 1) / (2 + 1e-9) * 100)


def gini(x):
    x = np.sort(np.asarray(x, dtype=float))
    if len(x) < 2 or x.sum() == 0:
        return 0.0
    return 2 * np.sum(np.arange(1, len(x) + 1) * x) / (len(x) * x.sum()) - (len(x) + 1) / len(x)


def test_gini(spark, table, numbers):
    got = {r["g"]: r["Gini"] for r in ranking.gini(table, ["g"], "n").collect()}
    for group, rows in numbers.groupby("g"):
        assert got[group] == pytest.approx(gini(rows["n"]))
    edge = spark.createDataFrame([("one", 5), ("zero", 0), ("zero", 0)], "g string, n int")
    assert {r["Gini"] for r in ranking.gini(edge, ["g"], "n").collect()} == {0.0}


def test_lorenz_ends_at_one(table, numbers):
    points = ranking.lorenz(table.withColumn("name", F.col("id").cast("string")), ["g"], "name", "n").toPandas()
    for group, rows in points.groupby("g"):
        curve = rows.sort_values("Pop_Share")
        want = np.cumsum(np.sort(numbers[numbers["g"] == group]["n"])) / numbers[numbers["g"] == group]["n"].sum()
        assert np.allclose(curve["Cum_Share"], want)
        assert curve["Pop_Share"].iloc[-1] == curve["Cum_Share"].iloc[-1] == 1.0


def test_pareto(table, numbers):
    ranked = ranking.pareto(table.withColumn("name", F.col("id").cast("string")), [], "name", "n")
    got = ranked.toPandas().sort_values("Rank")
    want = numbers["n"].sort_values(ascending=False)
    assert list(got["Rank"]) == list(range(1, 3001))
    assert np.allclose(got["Cumulative_Pct"], want.cumsum() / want.sum() * 100)
    marks = {r["threshold"]: r["sites"] for r in pareto_marks(ranked).collect()}
    share = (want.cumsum() / want.sum() * 100).to_numpy()
    assert marks == {m: int(np.argmax(share >= m)) + 1 for m in (20, 50, 80)}


def test_load_bands_and_medians(spark):
    rows = spark.createDataFrame([("z", n) for n in (10, 20, 30, 40, 100)] + [("y", 5), ("y", 5)], "g string, n int")
    bands = {(r["g"], r["n"]): r["Load_Group"] for r in ranking.load_bands(rows, ["g"], "n").collect()}
    assert bands[("z", 10)] == bands[("z", 20)] == "Low load" and bands[("z", 30)] == "Mid load"
    assert bands[("z", 40)] == bands[("z", 100)] == "High load" and bands[("y", 5)] == "High load"
    assert [r["n"] for r in ranking.above_group_median(rows, ["g"], "n").collect()] == [100]


def test_outliers_use_the_quartile_distance(spark):
    rows = spark.createDataFrame([(f"g{i}", float(v)) for i, v in enumerate((10, 11, 12, 13, 100, -90))], "g string, v double")
    found = {r["g"]: r["Outlier_Type"] for r in outlier_groups(rows, "v", "g").collect()}
    assert found == {"g4": "High", "g5": "Low"}


def test_canonical_order_and_reindex(spark):
    rows = spark.createDataFrame([("b", 2), ("zz", 9), ("a", 1)], "k string, n int")
    ordered = canonical_order(rows, "k", ["a", "b", "c"]).collect()
    assert [(r["k"], r["n"]) for r in ordered] == [("a", 1), ("b", 2), (None, 9)]
    full = reindexed(rows, "k", ["a", "b", "c"]).orderBy("ord").collect()
    assert [(r["k"], r["n"]) for r in full] == [("a", 1), ("b", 2), ("c", None)]


def test_comparison_shares_and_percentages(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, None)], "c int, k string")
    both = {r["k"]: (r["x"], r["y"]) for r in compared(rows, F.col("c"), {1: "x", 2: "y"}, "k").collect()}
    assert both["a"] == (pytest.approx(200 / 3), 0.0) and both["b"] == (pytest.approx(100 / 3), 100.0)
    counts = spark.createDataFrame([(1,), (7,)], "n int")
    assert sorted(r["Percentage"] for r in with_percentage(counts, "n").collect()) == [12.5, 87.5]
    assert {r["Percentage"] for r in with_percentage(counts, "n", total=0).collect()} == {0.0}
    means = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in means.select(mean_of_columns([F.col("a"), F.col("b")])).collect()] == [1.0, None]


def test_value_counts(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert [(r["k"], r["Pct"]) for r in ranking.value_counts(rows, "k").collect()] == [("a", 100.0)]
    assert ranking.value_counts(rows, "k", keep_missing=True).count() == 2


def test_top_n_is_the_same_everywhere(spark):
    names = spark.createDataFrame([(f"site {i:03d}", 1 + (i % 3 == 0)) for i in range(120)], "name string, n int")
    rows = names.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n"))))
    for n in (7, 40, 55):
        top = {r["name"] for r in cohort_of_top(rows, "name", n).collect()}
        ranked = ranking.pareto(names.select("name", "n"), [], "name", "n").where(F.col("Rank") <= n).collect()
        assert {r["name"] for r in ranked} == top


@pytest.fixture
def many_ranges(spark):
    """As on a cluster: 32 ranges, also of few rows."""
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def largest_range(rows, keys):
    return max(r["n"] for r in ranged(rows, keys).groupBy("_range").agg(F.count("*").alias("n")).collect())


def test_ties_with_a_common_beginning_are_split(spark, many_ranges):
    names = spark.range(100_000).selectExpr("concat('Region3_Site_', lpad(id, 9, '0')) AS name", "1L AS n")
    assert largest_range(names, [F.desc("n"), F.col("name")]) <= 10_000
    found = ranking.pareto(names, [], "name", "n").where("Rank % 9999 = 1").orderBy("Rank").collect()
    assert [(r["name"], r["Running_Count"]) for r in found] == [(f"Region3_Site_{r['Rank'] - 1:09d}", r["Rank"]) for r in found]
    assert len(found) == 11
    curve = ranking.lorenz(names.withColumn("g", F.lit("all")), ["g"], "name", "n").where("name like '%49999'").collect()
    assert [(r["Pop_Share"], r["Cum_Share"]) for r in curve if r["name"] == "Region3_Site_000049999"] == [(0.5, 0.5)]


def test_no_value_fills_a_range(spark, many_ranges):
    """Neither infinities, nor a large offset, nor a small scale, nor a long tail puts many values into one range."""
    rows = spark.range(20_000).selectExpr(
        "inline(array(struct('offset' AS g, 1.7e9D + id * 500 AS x), struct('small' AS g, id * 5e-8D AS x), "
        "struct('tail' AS g, exp(id / 800D) AS x), struct('infinite' AS g, if(id = 0, double('inf'), double(id)) AS x)))")
    assert largest_range(value_table(rows, ["g"], "x"), [F.col("g"), F.col("_value")]) <= 8_000
    found = {r["g"]: r for r in grouped_quantiles(rows, ["g"], "x", {"half": 0.5, "most": 0.9, "top": 1.0}).collect()}
    wanted = {g: f.x.quantile([0.5, 0.9]).tolist() for g, f in rows.where("g != 'infinite'").toPandas().groupby("g")}
    for group, values in wanted.items():
        assert [found[group]["half"], found[group]["most"]] == pytest.approx(values, rel=1e-12)
    own = np.sort([np.inf, *range(1, 20_000)])
    assert found["infinite"]["half"] == np.quantile(own, 0.5) and found["infinite"]["top"] == np.inf
    ranks = ranking.value_ranks(rows.where("g = 'infinite'").withColumn("id", F.monotonically_increasing_id()), ["g"], ["id"], {"x": "r"})
    assert ranks.where("x = double('inf')").first()["r"] == 100.0


def test_nan_is_one_value_above_infinity(spark):
    rows = spark.createDataFrame([("a", v) for v in (1.0, float("nan"), float("inf"), float("nan"), 2.0)], "g string, x double")
    found = grouped_quantiles(rows, ["g"], "x", {"low": 0.0, "half": 0.5, "top": 1.0, "between": 0.125}).first()
    assert (found["low"], found["half"], found["between"]) == (1.0, float("inf"), 1.5) and np.isnan(found["top"])
    ranks = {repr(r["x"]): r["r"] for r in ranking.value_ranks(
        rows.withColumn("id", F.monotonically_increasing_id()), ["g"], ["id"], {"x": "r"}).collect()}
    assert ranks == {"1.0": 20.0, "2.0": 40.0, "inf": 60.0, "nan": 90.0}
