"""Hand-derived cases of the scalar functions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hemline.functions.brands import brand_category, fill_brand, infer_brand
from hemline.functions.materials import (
    canonical_material, composition_from_attrs, material_quality_score, parse_materials,
)
from hemline.functions.prices import cluster_name, level, low_quality, price_first_number, price_strip, proxy_cpw
from hemline.functions.text import clean_text, compose_text, durability_score, has_claim, mentions_brand, token_count


def test_two_price_rules(values):
    inputs = ["$2.50", "$1,299.00", "1.2.3", "n/a", "", None, "5.", ".5", "."]
    assert values(price_first_number, inputs) == [2.5, 1.0, 1.2, None, None, None, 5.0, 5.0, None]
    assert values(price_strip, inputs) == [2.5, 1299.0, None, None, None, None, 5.0, 0.5, None]


MATERIALS = [
    ("100% Organic Cotton", 8.5), ("60% Cotton / 40% Recycled Polyester", 6.6), ("100% Virgin Polyester", 3.0),
    ("100% Recycled Cotton", 6.0), ("100% Merino Wool", 8.0), ("Cotton, Linen", 7.25), ("Cotton, 50% Linen", 8.5),
    ("150% Wool, 50% Cotton", 7.0), ("cotton 100%", 6.0), ("50% (x), 50% Cotton", 5.5), ("95.5% Cotton", 6.0),
    ("Shell: 100% Nylon; Lining: 100% Polyester", 3.25), ("100", None), (" ", None), (None, None),
    ("95% Polyester, 5% Elastane", 3.0), ("70% Polyamide, 30% Spandex", 4.4), ("80% Polyamide, 20% Elastane", 4.6),
    ("100% Unobtainium", 5.0), ("50% Cotton", 6.0), ("0% Cotton, 0% Hemp", 7.5),
]


def test_material_quality(values):
    got = values(material_quality_score, [text for text, _ in MATERIALS])
    for value, (text, expected) in zip(got, MATERIALS):
        assert value == (None if expected is None else pytest.approx(expected)), text


def test_parsed_parts(values):
    got = values(parse_materials, ["50% (x), 50% Cotton", "Cotton;;Linen", None])
    assert [[tuple(part) for part in parts] for parts in got] == [
        [("", 0.5), ("cotton", 0.5)], [("cotton", 0.5), ("linen", 0.5)], []]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789% abcwoltn,/;+().-é ", max_size=40), min_size=20, max_size=20))
def test_fractions_sum_to_one_and_scores_stay_in_range(values, texts):
    for parts in values(parse_materials, texts):
        assert not parts or sum(p["frac"] for p in parts) == pytest.approx(1.0)
    assert all(s is None or 2.0 <= s <= 9.0 for s in values(material_quality_score, texts))


def test_canonical_material(values):
    assert values(canonical_material, [" elastane ", "Pima cotton".lower(), "organic cotton mix", "wool"]) == [
        "spandex", "cotton", "organic cotton", "wool"]


def test_composition_from_attrs(values):
    inputs = [
        "[{'Color': 'Red'}, {'Composition': '95% Polyester, 5% Elastane'}, {'Composition': 'x'}]",
        "[{'Color': 'Multicolor'}, {'Material': 'PMMA'}]", "{'Composition': 'x'}", "[broken", "", None,
    ]
    assert values(composition_from_attrs, inputs) == ["95% Polyester, 5% Elastane", None, None, None, None, None]


def test_durability(values):
    inputs = ["Durable and well made", "whole store", "ripped and ripped", "sturdy but pilled", None, ""]
    assert values(durability_score, inputs) == [2, -2, -1, 0, 0, 0]


def test_claim(values):
    assert values(has_claim, ["Recycled fabric", "Lace decor", "plain tee", None]) == [True, True, False, False]


def test_cost_per_wear_and_flags(spark):
    rows = spark.createDataFrame([(100.0, 2, 4.0), (100.0, 0, 4.1), (100.0, -1, None), (None, 1, 1.0)],
                                 "price double, durability int, quality double")
    got = rows.select(proxy_cpw("price", "durability"), low_quality("quality")).collect()
    assert [tuple(r) for r in got] == [(50.0, True), (None, False), (None, None), (None, True)]


def test_brand_category(values):
    inputs = ["Zara", "H&M", "H & M", "Everlane", "ZARA ", "ROMWE", "", None]
    assert values(brand_category, inputs) == ["fast_fashion"] * 3 + ["sustainable"] + [None] * 4


def test_brand_from_file(values, spark):
    inputs = ["data/store_zara.csv", "hm_products.csv", "handm.csv", "H & M list.csv", "Patagonia_v1.csv"]
    assert values(infer_brand, inputs) == ["zara", "h&m", None, "h&m", "patagonia"]
    row = spark.range(1).select(fill_brand(F.lit("Own"), F.lit("store_zara.csv")),
                                fill_brand(F.lit(None).cast("string"), F.lit("store_zara.csv"))).first()
    assert tuple(row) == ("Own", "zara")


def test_clean_text(values):
    inputs = ["See [my fit](http://x.co) by /u/bob @ann <b>NICE!!</b> www.a.com", "menu/list here", None, ""]
    assert values(clean_text, inputs) == ["see by nice", "men here", None, ""]
    assert values(token_count, ["see by nice", "", None]) == [3, 1, None]


def test_compose_text(spark):
    rows = spark.createDataFrame([("a", "b"), (None, "b"), (None, None)], "x string, y string")
    assert [r[0] for r in rows.select(compose_text("x", "y")).collect()] == ["a b", " b", " "]


def test_mentions_brand(values):
    inputs = ["I like H&M a lot", "bizarre zaras", "ZARA!", None]
    assert values(lambda c: mentions_brand(c, ["H&M", "Zara"]), inputs) == [True, False, True, None]


def test_level(values):
    low, high = F.lit(1.99), F.lit(2.98)
    inputs = [1.0, 1.99, 2.0, 2.98, 3.0, None, float("nan")]
    assert values(lambda c: level(c, low, high), inputs, "double") == [
        "low", "mid", "mid", "mid", "high", "n/a", "n/a"]
    assert values(lambda c: level(c, F.lit(None).cast("double"), high), [1.0], "double") == ["mid"]


def test_cluster_name(spark):
    row = spark.range(1).select(cluster_name(F.lit(1), *[F.lit(x) for x in ("low", "mid", "high", "n/a")])).first()
    assert row[0] == "C1 (price:low, quality:mid, durability:high, sentiment:n/a)"
