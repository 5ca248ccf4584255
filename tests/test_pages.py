"""Page extraction on small documents."""

import pytest
from pyspark.sql import functions as F

from hemline.functions.pages import (
    SITES, attribute_contains, decode_references, has_attribute, has_class, page_images, page_material_items,
    page_materials, page_price, page_title, site_links,
)
from hemline.operators.pages import distinct_links, extract_product_pages, first_links

PAGE = """<html><body><a href="/products/a?x=1&amp;y=2">A</a><A class='k' href='https://o.com/products/b'>B</A>
<a href="/about">x</a><a name=z>q</a><a href="/products/a?x=1&amp;y=2">again</a>
<!-- <h1>no</h1> --><script>var t="<h1>bad</h1>"</script><h1 class="t"> Red <b>Dress</b> &amp; more &#36;&#x20AC; </h1>
<img src="http://i/1.jpg"><img src="/local.png"><img src="http://i/1.jpg"/><img alt=x src="https://i/2.jpg">
<div class="box ProductPrice big"><span>$98</span> .50</div>
<div data-testid="accordion-details"><div>Fabric: <p>60% Cotton</p></div> tail</div> after
<dl><dt>Size</dt><dd><li>S</li></dd><dt>The Composition</dt><dd><ul><li>Cotton 60%</li><li> Poly <i>40%</i></li></ul></dd></dl>
<h1 class="product-name x">Coat <i>one</i></h1><span class="price"> $5 </span>
<div id="product-materials"><ul><li>x</li><li>y</li></ul></div>
<p class="note">Composition</p><ul><li>Wool</li></ul>
<li class="product-item"><a href="/hm/1">1</a></li><li class="other"><a href="/hm/2">2</a></li>
<a class="tile product-tile__link" href="/product/7">7</a>
<b class="price-value">$ 7.99</b></body></html>"""


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(
        [(1, "u", PAGE), (2, "v", None), (3, "w", "<p>plain")], "page_id long, url string, html string")


def test_record_with_nulls_kept(pages):
    rows = {r.url: r for r in extract_product_pages(pages, SITES["reformation"]).collect()}
    assert rows["u"].name == "RedDress& more $€"
    assert (rows["u"].price_raw, rows["u"].price) == ("$98.50", 98.5)
    assert rows["u"].materials == "Fabric: 60% Cotton tail"
    assert rows["u"].images == "http://i/1.jpg,https://i/2.jpg"
    assert tuple(rows["v"]) == ("v", None, None, None, None, None, "Reformation")
    assert tuple(rows["w"]) == ("w", None, None, None, None, "", "Reformation")


def test_incomplete_pages_go(pages):
    rows = extract_product_pages(pages, SITES["patagonia"]).collect()
    assert [(r.url, r.name, r.price_raw, r.price, r.materials) for r in rows] == [
        ("u", "Coat one", "$5", 5.0, ["x", "y"])]
    rows = extract_product_pages(pages, SITES["hm"]).collect()
    assert [(r.name, r.price, r.materials) for r in rows] == [("Red Dress & more $€", 7.99, ["Cotton 60%", "Poly 40%"])]


def test_links(pages):
    def links(site):
        return pages.where("page_id = 1").select(site_links("html", SITES[site])).first()[0]

    first = "https://www.everlane.com/products/a?x=1&y=2"
    assert links("everlane") == [first, "https://o.com/products/b", first]
    assert links("hm") == ["https://www2.hm.com/hm/1"]
    assert links("patagonia") == ["https://www.patagonia.com/product/7"]
    assert sorted(r.url for r in distinct_links(pages, SITES["everlane"]).collect()) == ["https://o.com/products/b", first]
    assert [r.url for r in first_links(pages, SITES["everlane"], 1).collect()] == [first]


def test_single_fields(values):
    assert values(page_title, ["<h1>A</h1><h1>B</h1>", "<h2>x</h2>", None]) == ["A", None, None]
    assert values(lambda c: page_price(c, "^<b>", "^<i>"), ["<i>1</i><b>2</b>"]) == ["1"]
    assert values(lambda c: page_materials(c, "^<b>", "^<i>"), ["<i>1</i><b>2</b>", "<i>x<u> y</u></i>"]) == ["2", "x y"]
    long = "".join(f'<img src="http://x/{i:04d}.jpg">' for i in range(400))
    assert values(page_images, [long]) == [",".join(f"http://x/{i:04d}.jpg" for i in range(400))]
    assert [len(v) for v in values(lambda c: page_images(c, 2000), [long])] == [2000]


def test_attributes_without_quotes(values):
    html = """<h1 class=name>x</h1><i class='a price b'>1</i><img src=http://i/1.jpg alt=a><img src='http://i/it"s.jpg'>
    <u data-test=BigPrice>2</u><s id=k>3</s><b class="xprice">4</b>"""
    assert values(lambda c: page_price(c, has_class("price")), [html]) == ["1"]
    assert values(lambda c: page_price(c, has_class("name")), [html]) == ["x"]
    assert values(lambda c: page_price(c, attribute_contains("data-test", "Price")), [html]) == ["2"]
    assert values(lambda c: page_price(c, has_attribute("id", "k")), [html]) == ["3"]
    assert values(page_images, [html]) == ['http://i/1.jpg,http://i/it"s.jpg']


def test_references(values):
    inputs = ["a &amp;lt; b", "&#8364;5 &#x41; &#zz; &nosuch;", "&eacute;", "plain", None, "&#38;lt; &amp;amp;",
              "M&uuml;tze &frac12; &copy 2 &NotEqualTilde; &AMP", "a & b && &", "&#65 &#x41z &#X1F600;!", "&;&#;&#x;",
              "&#0;&#xD800;&#9999999;&#x110000;&#" + "9" * 60 + ";&#00000000000000065;"]
    assert values(decode_references, inputs) == [
        "a &lt; b", "€5 A &#zz; &nosuch;", "é", "plain", None, "&lt; &amp;", "Mütze ½ © 2 ≂̸ &", "a & b && &", "A Az 😀!",
        "&;&#;&#x;", "\ufffd" * 5 + "A"]


def test_every_reference_of_the_standard(values):
    from html.entities import html5

    names = sorted(name for name in html5 if name.endswith(";"))
    assert values(decode_references, ["".join(f"&{name}" for name in names)]) == ["".join(html5[name] for name in names)]


def test_a_bad_page_costs_no_other(spark):
    bad = "<h1>a&#9999999;&#xDFFF;</h1><a title='<p class=price>"
    pages = spark.createDataFrame([("u", bad), ("v", "<h1>b</h1>")], "url string, html string")
    assert {r.url: r.name for r in extract_product_pages(pages, SITES["reformation"]).collect()} == {
        "u": "a\ufffd\ufffd", "v": "b"}


def test_tags_end_outside_quotes(spark, values):
    html = """<a title="a>b" href="/products/x">1</a><a title='c>"' href='/products/y'>2</a><h1 class="x>y name">T</h1>
    <a title="open href=/products/z>3</a><b>4</b>"""
    assert values(lambda c: site_links(c, SITES["everlane"]), [html], "string")[0][:2] == [
        "https://www.everlane.com/products/x", "https://www.everlane.com/products/y"]
    assert values(lambda c: page_price(c, has_class("name")), [html]) == ["T"]
    long = '<a href="/products/q" ' + 'data-x="1>2" ' * 20000 + ">x</a><h1>end</h1>"
    assert values(page_title, [long]) == ["end"]


def test_price_is_a_direct_child(spark):
    def page(paragraph, rest="<p>Composition</p><ul><li>Wool</li></ul>"):
        return f'<h1 class="product-detail-info__header-name">N</h1><p class="product-detail-info__price">{paragraph}</p>{rest}'

    rows = [("two", page("<span>$10</span><span>$20</span>")), ("deep", page("<b><span>$1</span></b><span>$2</span>")),
            ("none", page("$10")), ("nested", page("<b><span>$1</span></b>")),
            ("far", page("<span>$3</span>", "<div><p>Composition</p></div><ul><li>no</li></ul>")),
            ("later", page("<span>$4</span>", "<p>Composition</p>x<br><i>y</i><ul><li>Silk</li></ul>")),
            ("plain", page("<span>$5</span>", "<p>Size</p>"))]
    got = {r.url: (r.price_raw, r.materials) for r in extract_product_pages(
        spark.createDataFrame(rows, "url string, html string"), SITES["zara"]).collect()}
    assert got == {"two": ("$10", ["Wool"]), "deep": ("$2", ["Wool"]), "later": ("$4", ["Silk"]), "plain": ("$5", [])}


def test_whole_page_is_read(values):
    """The field comes at the very end of a long page."""
    html = "<div>" + "<p>filler text</p>" * 5000 + "</div><h1>Last</h1>"
    assert values(page_title, [html]) == ["Last"]


def test_lists(values):
    def items(column):
        return page_material_items(column, "dt", "Composition", "dd")

    nested = "<dt>Composition</dt><dd><ul><li>a <b>b</b></li><li>c<ul><li>d</li></ul>e</li><li>f</li></ul></dd><li>no</li>"
    two = "<dt>Composition</dt><dd><li>old</li></dd><dt>The Composition</dt><p></p><dd><li>new</li></dd>"
    long = "<dt>Composition</dt><dd>" + "".join(f"<li>{i}</li>" for i in range(20000)) + "</dd>"
    got = values(items, [nested, two, "<dt>Size</dt><dd><li>S</li></dd>", None, long])
    assert got[:4] == [["a b", "cde", "d", "f"], ["new"], [], []]
    assert got[4] == [str(i) for i in range(20000)]


@pytest.mark.parametrize("parts", [0, 3])
def test_appended_pages_of_a_file_and_of_a_folder_of_parts(spark, tmp_path, parts):
    from checks.pages import appended_product_pages

    rows = spark.range(30).select(
        F.col("id").cast("long").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"),
        F.format_string("<h1>p%d</h1><nav><ul></ul></nav><footer>$%d</footer>", "id", "id").alias("html"))
    if parts:
        rows.repartition(parts).write.parquet(str(tmp_path / "pages.parquet"))
    else:
        rows.toPandas().to_parquet(tmp_path / "pages.parquet")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.url for r in appended_product_pages(spark, str(tmp_path)).collect()) == sorted(f"u{i}" for i in range(30))
