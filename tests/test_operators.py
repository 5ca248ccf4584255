"""Filters, shaping, aggregates, correlation, quantiles and clusters."""

import math
import random
import re
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemline.constants import CLUSTER_FEATURES, TERCILES
from hemline.operators.aggregates import (
    brand_metrics, claim_counts, claim_low_quality_share, claims, cpw_by_category, cpw_by_category_complete,
    product_durability_norm, product_sentiment_mean,
)
from hemline.operators.clusters import (
    _blocks, _drawn, cluster_names, cluster_products, cluster_profile, kmeans, standardize,
)
from hemline.operators.correlation import p_value, pearson, point_biserial, regression_line, with_p_value
from hemline.operators.filters import drop_missing, finite_only, is_finite, min_tokens
from hemline.operators.moments import moments
from hemline.operators.quantiles import quality_quartiles_by_claim, quantile_table, tercile_cuts
from hemline.operators.shaping import (
    attach_labels, distinct_urls, first_n_distinct, first_present, pick, union_products,
)

NAN, INF = float("nan"), float("inf")


def test_min_tokens(values):
    assert values(lambda c: min_tokens(c, 2), ["a b", "a", "", None]) == [True, False, False, None]


def test_missing_and_finite(spark):
    rows = spark.createDataFrame([(1.0,), (None,), (NAN,), (INF,), (-INF,)], "x double")
    assert drop_missing(rows, "x").count() == 3
    assert [r.x for r in finite_only(rows, "x").collect()] == [1.0]
    assert rows.where(is_finite("x")).count() == 1


def test_first_present(spark):
    rows = spark.createDataFrame([("a", "b")], "Name string, product_name string")
    assert first_present(rows, ("name", "title")) is None
    got = rows.select(pick(rows, ("name", "Name", "product_name")).alias("x"), pick(rows, ("q",), "double").alias("y"))
    assert tuple(got.first()) == ("a", None) and got.schema["y"].dataType.typeName() == "double"


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("q",)], "y string")
    assert {tuple(r) for r in union_products([a, b]).collect()} == {(1, None), (None, "q")}


def test_duplicates(spark):
    rows = spark.createDataFrame([("b", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("c", 4, "w")],
                                 "url string, position int, tag string")
    assert sorted(tuple(r) for r in distinct_urls(rows, order="position").collect()) == [
        ("a", 1, "y"), ("b", 2, "z"), ("c", 4, "w")]
    assert distinct_urls(rows.select("url")).count() == 3
    assert [r.url for r in first_n_distinct(rows, 2).collect()] == ["a", "b"]


def test_attach_labels_keeps_unlabelled_rows(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    labels = spark.createDataFrame([(1, 7)], "id int, cluster int")
    assert sorted(tuple(r) for r in attach_labels(rows, labels, "id").collect()) == [(1, 7), (2, None)]



def test_cost_per_wear_by_category(spark):
    rows = spark.createDataFrame(
        [("fast_fashion", 10.0), ("fast_fashion", 20.0), ("fast_fashion", None), (None, 5.0)],
        "brand_category string, proxy_cpw double")
    assert [tuple(r) for r in cpw_by_category(rows).collect()] == [("fast_fashion", 15.0)]
    assert sorted(tuple(r) for r in cpw_by_category_complete(rows).collect()) == [
        ("fast_fashion", 15.0, 2), ("sustainable", None, 0)]


def test_claims(spark):
    rows = spark.createDataFrame(
        [("eco shirt", 3.0), ("green", 8.0), ("plain", 4.0), (None, 5.0), ("organic", None)],
        "description string, objective_quality_score double")
    claim_rows = claims(rows)
    assert {r[0]: r[1] for r in claim_low_quality_share(claim_rows).collect()} == {True: 0.5, False: 0.5}
    assert tuple(claim_counts(claim_rows).first()) == (2, 2)
    expected = np.corrcoef([1, 1, 0, 0], [3.0, 8.0, 4.0, 5.0])[0, 1]
    assert point_biserial(claim_rows, "has_claim", "objective_quality_score").first().r == pytest.approx(expected)
    assert point_biserial(claim_rows.limit(0), "has_claim", "objective_quality_score").first().r is None


def test_brand_metrics_without_a_measure(spark):
    a = spark.createDataFrame([("x", "1.5"), ("x", "2.5"), (None, "9")], "brand string, price string")
    b = spark.createDataFrame([("src", NAN), ("src", 0.5)], "_source string, vader_compound double")
    got = {r.brand: (r.avg_price, r.avg_sentiment) for r in brand_metrics([a, b]).collect()}
    assert got == {"x": (2.0, None), None: (9.0, 0.5)}
    assert [tuple(r) for r in brand_metrics([b]).collect()] == [("src", None, 0.5)]


def test_per_product_means(spark):
    rows = spark.createDataFrame([("p", 0.5, "durable, well made"), ("p", -0.1, "it broke"), ("q", 0.0, None)],
                                 "product string, compound double, text string")
    assert {r[0]: r[1] for r in product_sentiment_mean(rows, "product", "compound").collect()} == {
        "p": pytest.approx(0.2), "q": 0.0}
    assert {r[0]: r[1] for r in product_durability_norm(rows, "product", "text").collect()} == {"p": 0.5, "q": 0.0}


def test_correlation(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, None), (4.0, 7.0), (NAN, 1.0)], "x double, y double")
    row = with_p_value(pearson(rows, "x", "y")).first()
    assert (round(row.r, 6), row.n, round(row.p, 6)) == (0.981981, 3, 0.121038)
    line = regression_line(rows, "x", "y").first()
    assert (round(line.slope, 6), round(line.intercept, 6)) == (1.607143, 0.75)
    constant = spark.createDataFrame([(1.0, float(i)) for i in range(9)], "x double, y double")
    row = with_p_value(pearson(constant, "x", "y")).first()
    assert (row.r, row.n, row.p) == (None, 9, None)
    assert regression_line(constant, "x", "y").first().slope is None


def test_p_value(spark):
    assert (round(p_value(0.5, 28, "fisher"), 6), round(p_value(0.1, 100, "fisher"), 6)) == (0.006023, 0.323060)
    assert p_value(None, 9) is None and p_value(0.5, 3, "fisher") is None and p_value(1.0, 50, "fisher") is None
    assert [round(p_value(*x), 9) for x in ((0.5, 28), (0.1, 100), (-0.9, 5), (0.2, 3), (0.001, 10**6))] == [
        0.006740896, 0.322217363, 0.037386073, 0.871811566, 0.317310992]
    assert (p_value(1.0, 50), p_value(0.3, 2), p_value(0.3, 1), p_value(float("nan"), 9)) == (0.0, 1.0, None, None)
    rows = spark.createDataFrame([(0.5, 28), (0.1, 100), (0.9999999, 50)], "r double, n long")
    assert [None if r.p is None else round(r.p, 6) for r in with_p_value(rows, method="fisher").collect()] == [0.006023, 0.323060, None]


@pytest.mark.parametrize("size", [1, 2, 50, 20000])
@pytest.mark.parametrize("kind", ["spread", "ties", "mixed", "edge", "signs"])
def test_quantiles_are_exact_at_every_size(spark, kind, size):
    """Against brute force; a third of the values may be one value."""
    random.seed(7)
    data = {
        "spread": [random.gauss(0, 1) for _ in range(size)],
        "ties": [float(i % 3) for i in range(size)],
        "edge": [7.0 if i < size // 2 else 7.0 + random.random() for i in range(size)],
        "mixed": [5.0 if i % 3 == 0 else random.random() * 10 for i in range(size)],
        "signs": [random.choice((-1, 1, 0)) * 2.0 ** random.randint(-1070, 1000) for _ in range(size)],
    }[kind] + [None, NAN]
    rows = spark.createDataFrame([(v, None if v is None else -2 * v) for v in data], "a double, b double")
    columns = {"a": F.col("a"), "b": F.col("b"), "none": F.lit(None).cast("double")}
    probabilities, names = [0.0, 0.33, 0.5, 0.66, 1.0], [f"q{i}" for i in range(5)]
    table = quantile_table(rows, columns, probabilities, names)
    got = {row["feature"]: [row[name] for name in names] for row in table.collect()}
    clean = np.array([v for v in data if v is not None and not math.isnan(v)])
    assert got["a"] == pytest.approx(np.quantile(clean, probabilities))
    assert got["b"] == pytest.approx(np.quantile(-2 * clean, probabilities))
    assert got["none"] == [None] * 5


def test_quantiles_run_no_job_before_an_action(spark):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    small, large = (tercile_cuts(spark.range(n).selectExpr("double(id) AS x"), ["x"], TERCILES) for n in (10, 10**9))
    assert len(tracker.getJobIdsForGroup(None)) == before
    shape = [re.sub(r"[#=(,].*", "", line) for df in (small, large)
             for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert shape[:len(shape) // 2] == shape[len(shape) // 2:]


def test_tercile_cuts(spark):
    rows = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "x double")
    row = tercile_cuts(rows, ["x"], TERCILES).first()
    assert (row.feature, round(row.lo, 6), round(row.hi, 6)) == ("x", 1.99, 2.98)


def test_quartiles_by_claim_with_one_side_missing(spark):
    rows = spark.createDataFrame([(True, float(i)) for i in range(5)], "has_claim boolean, objective_quality_score double")
    assert [tuple(r) for r in quality_quartiles_by_claim(rows, [0.25, 0.5, 0.75]).collect()] == [(True, 1.0, 2.0, 3.0)]


def _products(spark):
    random.seed(3)
    centres = [(10, -0.5, -1, 3), (200, 0.8, 3, 9), (50, 0.0, 0, 6), (120, 0.3, 5, 4)]
    rows = [(i, *(c + random.gauss(0, 0.01 * abs(c) + 0.01) for c in centres[i % 4])) for i in range(200)]
    rows += [(900, None, 0.1, 1.0, 5.0), (901, NAN, 0.1, 1.0, 5.0), (902, INF, 0.1, 1.0, 5.0)]
    return spark.createDataFrame(rows, "id int, price double, sentiment_score double, durability_score double, "
                                       "objective_quality_score double")


def test_standardize(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    got = [(r.z_a, r.z_b) for r in standardize(rows, ["a", "b"]).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0), (None, None)]


def test_kmeans_properties(spark):
    rows = _products(spark)
    labelled = kmeans(rows, CLUSTER_FEATURES, k=4).collect()
    assert len(labelled) == 203
    labels = {r.id: r.cluster for r in labelled}
    assert all(labels[i] is None for i in (900, 901, 902))
    assert len({labels[i] for i in range(200)}) == 4
    assert all(labels[i] == labels[i % 4] for i in range(200))


def test_named_segments(spark):
    got = cluster_products(_products(spark).where("id < 200"), k=4).collect()
    names = {r.id % 4: r.cluster_name for r in got}
    assert len(set(names.values())) == 4 and all(n.startswith("C") and "(price:" in n for n in names.values())
    assert "price:low" in names[0] and "price:high" in names[1] and "quality:high" in names[1]


def test_no_finite_row(spark):
    empty = _products(spark).where("id = 900")
    assert [r.cluster for r in kmeans(empty).collect()] == [None]
    assert [(r.cluster, r.cluster_name) for r in cluster_products(empty).collect()] == [(None, None)]


def test_profile_and_names(spark):
    rows = _products(spark).where("id < 200").withColumn("cluster", F.col("id") % 2)
    profile = cluster_profile(rows)
    assert profile.count() == 2
    cuts = spark.createDataFrame([(name, 0.0, 0.0) for name in CLUSTER_FEATURES], "feature string, lo double, hi double")
    names = cluster_names(profile, cuts)
    assert {r.cluster for r in names.collect()} == {0, 1}


def test_clusters_do_not_depend_on_how_rows_are_dealt_out(spark):
    rows = _products(spark).union(_products(spark).where("id % 3 = 0"))        # with repeats
    labels = [sorted((r.id, r.cluster) for r in kmeans(df).select("id", "cluster").where("id < 900").collect())
              for df in (rows.coalesce(1), rows.repartition(5), rows.repartition(3, "price"))]
    assert labels[0] == labels[1] == labels[2]


def test_the_labels_of_a_summary_are_compiled(spark):
    spark.conf.set("spark.sql.codegen.fallback", "false")       # code beyond 64 KB raises
    try:
        got = cluster_products(_products(spark), k=4).groupBy("cluster", "cluster_name").count().collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert sum(r["count"] for r in got) == 203


def test_rows_are_labelled_by_code_that_the_jvm_compiles(spark):
    """A method beyond 8,000 bytes is interpreted, at some twenty times the time of a row."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")       # else the code is not there before an action
    try:
        labelled = standardize(kmeans(_products(spark)), CLUSTER_FEATURES)
        means = labelled.where("cluster IS NOT NULL").groupBy("cluster").agg(*[F.avg(f"z_{name}") for name in CLUSTER_FEATURES])
        code = spark._jvm.PythonSQLUtils.explainString(means._jdf.queryExecution(), "codegen")
        plan = spark._jvm.PythonSQLUtils.explainString(means._jdf.queryExecution(), "simple")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) <= 8000
    assert not re.search(r"Filter.*array_min", plan)        # the distances are not written out again in a filter


def test_a_start_is_drawn_as_the_sql_draws_it(spark):
    rng = random.Random(7)
    places = [tuple(rng.randint(-5_000_000, 5_000_000) for _ in range(2)) for _ in range(500)]
    weights = [rng.randint(1, 9) for _ in places]
    points = spark.createDataFrame([(*p, w) for p, w in zip(places, weights)], "a long, b long, weight long").repartition(3)
    blocks, centres = _blocks(points, ["a", "b"]), []
    for i in range(3):
        def wait(point, weight):
            u = (int(md5(f"9,{i},{point[0]},{point[1]}".encode()).hexdigest()[:12], 16) + 0.5) / 2.0 ** 48
            share = weight * min([sum((x - c) ** 2 for x, c in zip(point, centre)) for centre in centres], default=1.0)
            return -math.log(u) / share if share else INF
        expected = min(zip(places, weights), key=lambda own: wait(*own))[0]
        centres.append(_drawn(blocks, ["a", "b"], list(centres), 9))
        assert centres[-1] == expected


def test_moments_of_weighted_rows_are_those_of_repeated_rows(spark):
    rows = spark.createDataFrame([(0.1, 3), (1e9, 1), (-7.25, 5), (None, 2)], "a double, weight long")
    repeated = rows.select("a", F.explode(F.sequence(F.lit(1).cast("long"), "weight")))
    found = [spark.range(1).select(m.alias("m")).first()["m"]["a"]
             for m in (moments(rows, ["a"], "weight"), moments(repeated, ["a"]))]
    assert found[0] == found[1]
