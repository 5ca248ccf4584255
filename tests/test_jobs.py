"""Readers, writers and whole jobs through the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from hemline.__main__ import main
from hemline.plans.products import enrich_products, normalize_products
from hemline.schemas import FORUM_SUBMISSIONS, NORMALIZED_PRODUCT, PAGE
from hemline.session import scratch_path, written
from hemline.sources.readers import (
    load_texts, read_csv_inferred, read_json_typed, read_lexicon, read_optional, read_parquet,
)
from hemline.sources.writers import metrics_text, run_tagged_path, write_parquet_once


@pytest.fixture(autouse=True)
def keep_session(spark):
    """The jobs take the running session."""
    return spark


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return str(path)


ZARA = """url,name,sku,price,description,brand
u1,OVERSHIRT,s1,89.9,"Relaxed fit overshirt, 100% organic cotton. Durable.
Second line",Zara
u2,JACKET,s2,,N/A,
"""
HM = """product_url,product_name,product_id,Price,product_description
v1,Tee,7,"$1,299.00",It broke
v2,Top,8,n/a,
"""


def test_research_job(spark, tmp_path):
    zara = put(tmp_path / "store_zara.csv", ZARA.replace("description", "materials", 1).replace(
        "materials,brand", "description,brand"))
    hm = put(tmp_path / "hm_products.csv", HM)
    output = str(tmp_path / "out")
    assert main(["research", "--inputs", zara, hm, str(tmp_path / "absent.csv"), "--output_base", output,
                 "--run_tag", "t", "--k", "2", "--multiline"]) == 0
    tables = f"{output}/run=t/tables"
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(
        f"{tables}/products_enriched").collect()
    assert len(rows) == 4
    first = next(r for r in rows if r.product_id == "s1")
    assert (first.source_file, first.brand, first.brand_category) == ("store_zara.csv", "Zara", "fast_fashion")
    assert "Second line" in first.description and float(first.price) == 89.9
    assert (first.durability_score, float(first.proxy_cpw)) == ("1", 89.9)
    second = next(r for r in rows if r.product_id == "s2")
    assert (second.brand, second.price, second.description) == ("zara", None, None)
    third = next(r for r in rows if r.product_id == "7")
    assert (float(third.price), third.brand, third.durability_score) == (1299.0, "h&m", "-1")
    lines = [r.value for r in spark.read.text(f"{tables}/correlation").collect()]
    assert lines[0].startswith("pearson(objective_quality_score, sentiment_score): r=")
    assert read_csv_inferred(spark, f"{tables}/proxy_cpw_by_category").collect()[0].avg_proxy_cpw == 89.9
    assert main(["research", "--inputs", str(tmp_path / "absent.csv"), "--output_base", output]) == 1


def test_normalized_schema(spark, tmp_path):
    empty = normalize_products(spark, [str(tmp_path / "none.csv")])
    assert empty.schema == NORMALIZED_PRODUCT and empty.isEmpty()
    some = normalize_products(spark, [put(tmp_path / "everlane_products.csv", "id,title,price\n1,a,$5\n")])
    assert [f.name for f in some.schema] == [f.name for f in NORMALIZED_PRODUCT]
    assert [f.dataType for f in some.schema] == [f.dataType for f in NORMALIZED_PRODUCT]
    row = enrich_products(some).first()
    assert (row.brand, row.brand_category, row.text_for_sentiment, row.sentiment_score) == (
        "everlane", "sustainable", " ", 0.0)


def test_cleaners(spark, tmp_path):
    listing = ("url;name;sku;price;size;brand;description;images\n"
               "u;Café;SKU: 1;$7.25;S;;[{'Color': 'Black'}, {'Composition': '95% Polyester, 5% Elastane'}];[]\n"
               "w;B;SKU: 2;none;M;ROMWE;[{'Color': 'Red'}];[]\n")
    source = put(tmp_path / "listing.csv", listing, "iso-8859-1")
    for _ in range(2):      # the second run replaces the first
        assert main(["clean", "shein", "--input", source, "--output", str(tmp_path / "shein")]) == 0
    rows = {r.url: r for r in read_parquet(spark, str(tmp_path / "shein")).collect()}
    assert (rows["u"].name, rows["u"].price, rows["u"].materials) == ("Café", 7.25, "95% Polyester, 5% Elastane")
    assert (rows["w"].price, rows["w"].brand, rows["w"].materials) == (None, "ROMWE", None)

    main(["clean", "hm", "--input", put(tmp_path / "hm.csv", HM), "--output", str(tmp_path / "hm")])
    rows = [tuple(r) for r in read_parquet(spark, str(tmp_path / "hm")).orderBy("url").collect()]
    assert rows == [("v1", "Tee", "7", 1.0, "It broke", "H&M"), ("v2", "Top", "8", None, None, "H&M")]

    main(["clean", "patagonia", "--input", put(tmp_path / "p.csv", "Name,Price,URL\nCoat,no price,x\n"),
          "--output", str(tmp_path / "pat")])
    assert [tuple(r) for r in read_parquet(spark, str(tmp_path / "pat")).collect()] == [
        ("x", "Coat", None, None, None, "Patagonia")]

    main(["clean", "zara", "--input", put(tmp_path / "z.csv", "url,name,sku,price,description,brand\nu,n,007,9.5,d,Zara\nv,n,8,ask,d,Zara\n"),
          "--output", str(tmp_path / "z")])
    assert [tuple(r) for r in read_parquet(spark, str(tmp_path / "z")).collect()] == [
        ("u", "n", "007", 9.5, "d", "Zara"), ("v", "n", "8", None, "d", "Zara")]


def _submissions(folder):
    for year, month, sub, text in [
        (2023, 1, "MensFashion", "I love this great durable coat, well made"), (2023, 1, "other", "not wanted here at all"),
        (2023, 5, "mensfashion", "wrong month for this one"), (2021, 1, "mensfashion", "wrong year for this one"),
        (2024, 2, "womensfashion", "The worst thing, it fell apart http://x.y"), (2024, 2, "womensfashion", "too short"),
    ]:
        path = folder / f"year={year}" / f"month={month}"
        path.mkdir(parents=True, exist_ok=True)
        with open(path / "part.json", "a", encoding="utf-8") as out:
            out.write(json.dumps({"id": text[:6], "subreddit": sub, "title": None, "selftext": text, "extra": 1}) + "\n")


def test_forum_jobs(spark, tmp_path):
    _submissions(tmp_path / "submissions")
    output = str(tmp_path / "subset")
    assert main(["extract-forum", "--submissions", str(tmp_path / "submissions"), "--output", output,
                 "--run_tag", "a", "--coalesce", "2"]) == 0
    written_files = os.listdir(f"{output}/run=a/submissions")
    assert any(name.endswith(".json.gz") for name in written_files)
    with pytest.raises(Exception, match="exists"):
        main(["extract-forum", "--submissions", str(tmp_path / "submissions"), "--output", output, "--run_tag", "a"])

    named = str(tmp_path / "named")
    assert main(["extract-forum", "--submissions", str(tmp_path / "submissions"), "--output", named, "--no_suffix",
                 "--brands", "Coat", "dress"]) == 0
    assert [r.selftext for r in spark.read.json(f"{named}/submissions").collect()] == [
        "I love this great durable coat, well made"]

    scored = str(tmp_path / "scored")
    assert main(["forum-sentiment", "--input", f"{output}/run=a/submissions", "--format", "json",
                 "--output_base", scored, "--no_suffix"]) == 0
    detail = read_parquet(spark, f"{scored}/detailed_parquet").collect()
    assert len(detail) == 2 and all("http" not in r.text_clean for r in detail)
    summary = read_csv_inferred(spark, f"{scored}/aggregates_csv").collect()
    assert [(r.year, r.month, r.subreddit, r.n_posts) for r in summary] == [
        (2023, 1, "MensFashion", 1), (2024, 2, "womensfashion", 1)]
    assert summary[0].avg_compound > 0 > summary[1].avg_compound


def test_partition_columns_prune(spark, tmp_path):
    _submissions(tmp_path / "submissions")
    posts = read_json_typed(spark, str(tmp_path / "submissions"), FORUM_SUBMISSIONS).where("year = 2021 and month in (1)")
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and posts.count() == 1


def test_batch_sentiment(spark, tmp_path):
    one = put(tmp_path / "a.csv", 'title,body\nGreat,"I love it, ""really"""\n,nan\n')
    two = put(tmp_path / "b.csv", "selftext,other\nThe worst,1\n")
    three = put(tmp_path / "c.csv", "x,y\n1,2\n")
    assert main(["batch-sentiment", "--inputs", one, two, three, "--output", str(tmp_path / "out")]) == 0
    rows = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).collect()
    got = {r._text: (r._source, float(r.vader_compound)) for r in rows}
    assert len(rows) == 3 and got["The worst"] == ("b.csv", pytest.approx(-0.6249))
    assert got['I love it, "really" Great'][1] > 0.8
    assert load_texts(spark, [three], ["body"]).isEmpty()


def test_brand_report(spark, tmp_path, capsys):
    scores = put(tmp_path / "scores.csv", "_source,vader_compound\nr,0.5\nr,\n")
    spark.createDataFrame([("Zara", 10.0)], "brand string, price double").write.parquet(str(tmp_path / "z"))
    put(tmp_path / "broken.parquet", "this is not parquet")
    assert main(["brand-report", "--inputs", scores, str(tmp_path / "z"), str(tmp_path / "broken.parquet"), "/absent",
                 "--output", str(tmp_path / "r")]) == 0
    got = {r.brand: (r.avg_price, r.avg_sentiment) for r in read_csv_inferred(spark, str(tmp_path / "r")).collect()}
    assert got == {None: (None, 0.5), "Zara": (10.0, None)}
    assert main(["brand-report", "--inputs", "/absent"]) == 0 and "brand" in capsys.readouterr().out
    main(["brand-report", "--inputs", str(tmp_path / "z"), "--output", str(tmp_path / "j"), "--format", "json"])
    assert spark.read.json(str(tmp_path / "j")).collect()[0].avg_price == 10.0


def test_page_jobs(spark, tmp_path):
    def add(name, *ids):
        spark.createDataFrame([(i, f"u{i}", f"<h1>N{i}</h1><a href='/products/{i % 2}'>x</a>") for i in ids], PAGE) \
            .coalesce(1).write.parquet(str(tmp_path / "pages" / name))

    add("one", 1, 2)
    pages, output, state = (str(tmp_path / n) for n in ("pages/*", "records", "state"))
    feed = ["extract-pages", "--site", "everlane", "--input", pages, "--output", output, "--checkpoint", state]
    main(feed)
    main(feed)                              # nothing new: nothing repeated
    add("two", 3)
    main(feed)
    assert sorted(r.name for r in spark.read.parquet(output).collect()) == ["N1", "N2", "N3"]
    main(["extract-pages", "--site", "everlane", "--input", pages, "--output", str(tmp_path / "l"), "--links"])
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "l")).collect()) == [
        "https://www.everlane.com/products/0", "https://www.everlane.com/products/1"]
    main(["extract-pages", "--site", "hm", "--input", pages, "--output", str(tmp_path / "h")])
    assert spark.read.parquet(str(tmp_path / "h")).isEmpty()


def test_lexicon_file(spark, tmp_path):
    path = put(tmp_path / "lexicon.txt", "good\t1.9\t0.9\t[2, 1]\n:(\t-1.9\t1\t[]\n:\\\t-1.0\t1\n\"x\t0.5\nbad line\n")
    assert {r.term: r.valence for r in read_lexicon(spark, path).collect()} == {"good": 1.9, ":(": -1.9, ":\\": -1.0, '"x': 0.5}


def test_optional_and_once(spark, tmp_path):
    empty = read_optional(spark, ["/absent"], read_parquet, PAGE)
    assert empty.schema == PAGE and empty.isEmpty()
    rows = spark.range(10)
    write_parquet_once(rows, str(tmp_path / "once"), files=3)
    assert len([n for n in os.listdir(tmp_path / "once") if n.endswith(".parquet")]) == 3
    with pytest.raises(Exception, match="exists"):
        write_parquet_once(rows, str(tmp_path / "once"))


def test_run_paths():
    assert run_tagged_path("b", "t") == "b/run=t" and run_tagged_path("b", "t", True) == "b"
    assert len(run_tagged_path("b")) == len("b/run=20240101_000000")


def test_metrics_text(spark):
    def lines(r, p, n, c):
        row = spark.createDataFrame([(r, p, n, c)], "r double, p double, n long, claims_r double")
        return [x.value for x in metrics_text(row).collect()]

    assert lines(0.15634, 0.00602312, 28, -0.2) == [
        "pearson(objective_quality_score, sentiment_score): r=0.1563, p=0.006023, n=28",
        "point_biserial(has_claim, objective_quality_score) = -0.2000"]
    assert "p=1.5e-09," in lines(0.1, 1.5e-9, 5, 0.0)[0] and "p=0.5," in lines(0.1, 0.5, 5, 0.0)[0]
    assert "p=0," in lines(0.1, 0.0, 5, 0.0)[0] and "p=1," in lines(0.1, 1.0, 5, 0.0)[0]
    assert "r=nan, p=nan" in lines(None, None, 0, None)[0] and lines(None, None, 0, None)[1].endswith("= nan")


def test_scratch_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(base + "/hemline-scratch/x-")
    rows = written(spark.range(5).withColumn("k", F.col("id") % 2), "w")
    assert rows.count() == 5 and rows.inputFiles()[0].replace("file://", "").startswith(base)


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Bare, "x")
