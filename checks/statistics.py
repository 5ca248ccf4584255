"""Aggregates, joins, correlation, quantiles and clusters."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.expected import PARTS, category, claim, durability, price_strip
from checks.inputs import LISTING_SQL, REVIEW_SQL, listing, reviews, table
from checks.registry import query
from hemline.constants import (
    CLUSTER_FEATURES, CLUSTER_ITERATIONS, CLUSTER_SEED, CLUSTER_TOLERANCE, CLUSTERS, QUARTILES, TERCILES,
)
from hemline.functions.brands import brand_category
from hemline.functions.materials import material_quality_score
from hemline.functions.prices import price_strip as strip_price
from hemline.functions.prices import proxy_cpw
from hemline.functions.text import durability_score
from hemline.operators.aggregates import (
    brand_metrics, claim_counts, claim_low_quality_share, claims, cpw_by_category, cpw_by_category_complete,
    mean_profile, product_durability_norm, product_sentiment_mean,
)
from hemline.operators.clusters import GRID, cluster_products, kmeans, name_clusters, standardize
from hemline.operators.correlation import line_through, pair_count, pearson, pearson_r, point_biserial, with_p_value
from hemline.operators.quantiles import quality_quartiles_by_claim, tercile_cuts
from hemline.operators.shaping import attach_labels, attach_names, complete_categories, distinct_urls


def _costed(spark, sf_dir):
    rows = listing(spark, sf_dir, "brand", "price_text", "review_text")
    return rows.select(
        brand_category("brand").alias("brand_category"),
        proxy_cpw(strip_price("price_text"), durability_score("review_text")).alias("proxy_cpw"))


_COSTED = f"""listing AS ({LISTING_SQL}), costed AS (
  SELECT {category("brand")} AS brand_category, CASE WHEN {durability("review_text")} > 0
         THEN {price_strip("price_text")} / {durability("review_text")} END AS cpw FROM listing)"""


@query(f"""WITH {_COSTED} SELECT brand_category, round(avg(cpw), 6) AS avg_proxy_cpw FROM costed
WHERE brand_category IS NOT NULL AND cpw IS NOT NULL GROUP BY brand_category""")
def cost_per_wear_by_category(spark, sf_dir):
    return cpw_by_category(_costed(spark, sf_dir)).withColumn("avg_proxy_cpw", F.round("avg_proxy_cpw", 6))


@query(f"""WITH {_COSTED} SELECT c.brand_category, round(avg(cpw), 6) AS avg_proxy_cpw, count(cpw) AS n
FROM (VALUES ('fast_fashion'), ('sustainable')) AS c(brand_category) LEFT JOIN costed USING (brand_category) GROUP BY 1""")
def cost_per_wear_complete(spark, sf_dir):
    return cpw_by_category_complete(_costed(spark, sf_dir)).withColumn("avg_proxy_cpw", F.round("avg_proxy_cpw", 6))


@query("""SELECT s.l_shipmode AS status, count(l_quantity) AS n, round(avg(l_quantity), 6) AS avg_quantity
FROM (VALUES ('O'), ('F'), ('missing')) AS s(l_shipmode) LEFT JOIN lineitem ON l_linestatus = s.l_shipmode GROUP BY 1""")
def completed_categories(spark, sf_dir):
    """Every listed status, also one that no row has."""
    summary = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"))
    return complete_categories(summary, "status", ["O", "F", "missing"])


def _claims(spark, sf_dir):
    rows = listing(spark, sf_dir, "description", "materials").select(
        "description", material_quality_score("materials").alias("objective_quality_score"))
    return claims(rows)


_CLAIMS = PARTS + f""", claims AS (
  SELECT {claim("l.description")} AS has_claim, q.quality FROM listing l JOIN quality q USING (doc_id))"""


@query(f"""WITH {_CLAIMS} SELECT has_claim, round(avg(CASE WHEN quality <= 4.0 THEN 1.0 ELSE 0.0 END), 6) AS share_low_quality
FROM claims GROUP BY has_claim""")
def low_quality_share_by_claim(spark, sf_dir):
    return claim_low_quality_share(_claims(spark, sf_dir)).withColumn(
        "share_low_quality", F.round("share_low_quality", 6))


@query(f"""WITH {_CLAIMS} SELECT count(*) FILTER (WHERE NOT has_claim) AS n_no, count(*) FILTER (WHERE has_claim) AS n_claim FROM claims""")
def claim_row_counts(spark, sf_dir):
    return claim_counts(_claims(spark, sf_dir))


@query(f"""WITH {_CLAIMS} SELECT round(corr(quality, CASE WHEN has_claim THEN 1.0 ELSE 0.0 END), 6) AS r FROM claims""")
def claim_quality_correlation(spark, sf_dir):
    return point_biserial(_claims(spark, sf_dir), "has_claim", "objective_quality_score").select(
        F.round("r", 6).alias("r"))


@query(f"""WITH {_CLAIMS} SELECT has_claim, round(quantile_cont(quality, 0.25), 6) AS q1,
round(quantile_cont(quality, 0.5), 6) AS median, round(quantile_cont(quality, 0.75), 6) AS q3 FROM claims GROUP BY has_claim""")
def quality_quartiles(spark, sf_dir):
    return quality_quartiles_by_claim(_claims(spark, sf_dir), QUARTILES).select(
        "has_claim", *[F.round(name, 6).alias(name) for name in ("q1", "median", "q3")])


_AREA = "sum({density} * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * any_value({upper}) / 4000.0 / 3"


def exact_p(summary: str) -> str:
    """Common tables ``s`` (r, n of ``summary``) and ``exact`` (p): the density of the t distribution, integrated."""
    density = ("exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * "
               "(1 + (t * i / 4000.0) * (t * i / 4000.0) / v) ** (-(v + 1) / 2)")
    return f"""s AS ({summary}),
t_of AS (SELECT n - 2.0::DOUBLE AS v, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM s),
t_grid AS (SELECT v, t, unnest(range(0, 4001)) AS i FROM t_of),
exact AS (SELECT 1 - 2 * ({_AREA.format(density=density, upper="t")}) AS p FROM t_grid)"""


_FISHER = """abs(0.5 * ln((1 + r) / (1 - r))) * sqrt(n - 3)"""


@query(f"""WITH {exact_p("SELECT corr(quality, toxic) AS r, count(*) AS n FROM labels")},
z AS (SELECT r, n, {_FISHER} AS z FROM s),
grid AS (SELECT z, unnest(range(0, 2001)) AS i FROM z),
simpson AS (
  SELECT sum(exp(-((z * i / 2000.0) * (z * i / 2000.0)) / 2) * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
         * any_value(z) / 2000.0 / 3 AS area FROM grid)
SELECT round(r, 6) AS r, n, round(p, 6) AS p, round(1 - 2 * area / sqrt(2 * pi()), 6) AS p_fisher FROM s, exact, simpson""")
def label_correlation(spark, sf_dir):
    """r, n and both kinds of p; the expected ones integrate the densities."""
    summary = pearson(table(spark, sf_dir, "labels"), "quality", "toxic")
    exact = with_p_value(summary).withColumnRenamed("p", "exact")
    return with_p_value(exact, method="fisher").select(
        F.round("r", 6).alias("r"), "n", F.round("exact", 6).alias("p"), F.round("p", 6).alias("p_fisher"))


@query("""SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n,
round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept
FROM lineitem WHERE l_discount <> 0""")
def price_quantity_line(spark, sf_dir):
    """Correlation and line over complete pairs only."""
    price = F.when(F.col("l_discount") != 0, F.col("l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", price.alias("price"))
    slope, intercept = line_through("l_quantity", "price")
    return rows.agg(
        F.round(pearson_r("l_quantity", "price"), 6).alias("r"), pair_count("l_quantity", "price").alias("n"),
        F.round(slope, 4).alias("slope"), F.round(intercept, 4).alias("intercept"))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.33), 6) AS lo, round(quantile_cont({c}, 0.66), 6) AS hi FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def feature_terciles(spark, sf_dir):
    columns = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    cuts = tercile_cuts(table(spark, sf_dir, "lineitem").select(*columns), columns, TERCILES)
    return cuts.select("feature", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("""SELECT l_linenumber AS cluster, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice
FROM lineitem GROUP BY 1""")
def cluster_means(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "cluster")
    return mean_profile(rows, "cluster", ["l_quantity", "l_extendedprice"]).select(
        "cluster", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query(f"""WITH a AS ({LISTING_SQL}) SELECT brand, round(avg(price), 6) AS avg_price, round(avg(c), 6) AS avg_sentiment FROM (
  SELECT brand, {price_strip("price_text")} AS price, CAST(NULL AS DOUBLE) AS c FROM a
  UNION ALL SELECT NULL, NULL, value FROM events) GROUP BY brand""")
def brand_price_and_sentiment(spark, sf_dir):
    """Products with a brand and scores without one, in one report."""
    products = listing(spark, sf_dir, "brand", "price_text").select("brand", strip_price("price_text").alias("price"))
    scores = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("_source"), F.col("value").alias("vader_compound"))
    return brand_metrics([products, scores]).select(
        "brand", F.round("avg_price", 6).alias("avg_price"), F.round("avg_sentiment", 6).alias("avg_sentiment"))


@query("""SELECT event_type AS brand, CAST(NULL AS DOUBLE) AS avg_price, round(avg(value), 6) AS avg_sentiment FROM events GROUP BY 1""")
def source_as_brand(spark, sf_dir):
    """No input has a brand column: the source tag stands in."""
    scores = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("_source"), F.col("value").alias("vader_compound"))
    return brand_metrics([scores]).select(
        "brand", "avg_price", F.round("avg_sentiment", 6).alias("avg_sentiment"))


@query(f"""WITH reviews AS ({REVIEW_SQL}) SELECT conv_id, round(CAST(sum({durability("text")}) AS DOUBLE) / count(*), 6) AS durability,
count(*) AS n_reviews FROM reviews GROUP BY conv_id""")
def durability_by_product(spark, sf_dir):
    return product_durability_norm(reviews(spark, sf_dir), "conv_id", "text").withColumn(
        "durability", F.round("durability", 6))


@query("""SELECT user_id, round(avg(value), 6) AS sentiment_score, count(*) AS n_reviews FROM events GROUP BY user_id""")
def mean_score_by_product(spark, sf_dir):
    return product_sentiment_mean(table(spark, sf_dir, "events"), "user_id", "value").withColumn(
        "sentiment_score", F.round("sentiment_score", 6))


@query("""SELECT d.doc_id, l.quality, CASE l.toxic WHEN 0 THEN 'clean' WHEN 1 THEN 'toxic' END AS name
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def attached_labels(spark, sf_dir):
    """Labels joined to all rows by key, then a name by label."""
    documents = table(spark, sf_dir, "documents").select("doc_id")
    labelled = attach_labels(documents, table(spark, sf_dir, "labels"), "doc_id")
    names = spark.range(2).select(
        F.col("id").cast("int").alias("toxic"),
        F.when(F.col("id") == 0, "clean").otherwise("toxic").alias("name"))
    return attach_names(labelled, names, "toxic").select("doc_id", "quality", "name")


@query("""SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1""")
def first_row_per_key(spark, sf_dir):
    """Duplicates removed, the first by order kept."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return distinct_urls(rows, "o_custkey", order="o_orderkey")


@query("""SELECT l_orderkey, l_linenumber,
round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS z_l_quantity,
round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) AS z_l_extendedprice
FROM lineitem""")
def standardized_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return standardize(rows, ["l_quantity", "l_extendedprice"]).select(
        "l_orderkey", "l_linenumber",
        *[F.round(f"z_{name}", 6).alias(f"z_{name}") for name in ("l_quantity", "l_extendedprice")])


def _features(spark, sf_dir):
    """Four product features from order lines; some rows lack one."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_tax") != 0, F.col("l_extendedprice")).alias("price"),
        F.col("l_discount").alias("sentiment_score"),
        F.col("l_quantity").alias("durability_score"),
        F.col("l_tax").alias("objective_quality_score"))


_FEATURES = """features AS MATERIALIZED (SELECT row_number() OVER () AS place, l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN l_extendedprice END AS price,
l_discount AS sentiment_score, l_quantity AS durability_score, l_tax AS objective_quality_score,
CASE WHEN l_tax <> 0 THEN l_linenumber % 4 END AS cluster FROM lineitem)"""


def _level(alias: str, column: str) -> str:
    return (f"CASE WHEN m.{column} IS NULL THEN 'n/a' WHEN m.{column} < lo_{alias} THEN 'low' "
            f"WHEN m.{column} > hi_{alias} THEN 'high' ELSE 'mid' END")


_NAMED = {"p": "price", "q": "objective_quality_score", "d": "durability_score", "s": "sentiment_score"}


@query(f"""WITH {_FEATURES}, cuts AS (SELECT {", ".join(
    f"quantile_cont({c}, 0.33) AS lo_{a}, quantile_cont({c}, 0.66) AS hi_{a}" for a, c in _NAMED.items())} FROM features),
means AS (SELECT cluster, {", ".join(f"avg({c}) AS {c}" for c in _NAMED.values())} FROM features WHERE cluster IS NOT NULL GROUP BY cluster),
names AS (SELECT cluster, concat('C', CAST(cluster AS STRING), ' (price:', {_level("p", _NAMED["p"])}, ', quality:', {_level("q", _NAMED["q"])},
  ', durability:', {_level("d", _NAMED["d"])}, ', sentiment:', {_level("s", _NAMED["s"])}, ')') AS cluster_name FROM means m, cuts)
SELECT l_orderkey, l_linenumber, f.cluster, cluster_name FROM features f LEFT JOIN names USING (cluster)""")
def named_clusters(spark, sf_dir):
    """Names of given clusters from their means against the terciles of all rows."""
    rows = _features(spark, sf_dir).withColumn(
        "cluster", F.when(F.col("price").isNotNull(), F.col("l_linenumber") % 4))
    return name_clusters(rows).select("l_orderkey", "l_linenumber", "cluster", "cluster_name")


def kmeans_sql(rows: str, columns, key: str, k: int = CLUSTERS, seed: int = CLUSTER_SEED) -> str:
    """Common tables up to ``clusters`` (``key``, cluster): k-means of the table ``rows`` from its drawn start on."""
    columns = list(columns)
    z = [f"z{i}" for i in range(len(columns))]
    finite = " AND ".join(f"isfinite({c})" for c in columns)
    scaled = ", ".join(f"CAST(floor(({c} - m{i}) / coalesce(nullif(s{i}, 0), 1) * {GRID} + 0.5) AS BIGINT) AS z{i}"
                       for i, c in enumerate(columns))
    moments = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(columns))

    def distance(centre: str) -> str:
        return " + ".join(f"(p.{name} - {centre}.{name}) * (p.{name} - {centre}.{name})" for name in z)

    starts = []
    for i in range(k):
        share = "weight"
        if i:
            apart = [f"(SELECT {distance(f's{j}')} FROM start{j} AS s{j})" for j in range(i)]
            share = f"weight * least({', '.join(apart)})" if i > 1 else f"weight * {apart[0]}"
        u = (f"((CAST('0x' || substr(md5(concat_ws(',', {seed}, {i}, {', '.join(z)})), 1, 12) AS BIGINT)::DOUBLE + 0.5)"
             f" / {float(1 << 48)})")
        starts.append(f"""start{i} AS (SELECT {", ".join(f"{name}::DOUBLE AS {name}" for name in z)} FROM points p
  ORDER BY -ln({u}) / nullif(({share})::DOUBLE, 0) NULLS LAST LIMIT 1)""")
    state = ", ".join(f"[{', '.join(f'(SELECT {name} FROM start{i})' for name in z)}]" for i in range(k))

    def apart(i: int) -> str:
        return " + ".join(f"({name} - c[{i + 1}][{j + 1}]) * ({name} - c[{i + 1}][{j + 1}])" for j, name in enumerate(z))

    nearest = f"list_position([{', '.join(map(apart, range(k)))}], least({', '.join(map(apart, range(k)))}))"
    means = ", ".join(f"sum(weight * {name}::HUGEINT)::DOUBLE / sum(weight)::DOUBLE" for name in z)
    return f"""known AS (SELECT * FROM {rows} WHERE {finite}),
moments AS (SELECT {moments} FROM known),
placed AS (SELECT {key}, {scaled} FROM known, moments),
points AS MATERIALIZED (SELECT {", ".join(z)}, count(*) AS weight FROM placed GROUP BY {", ".join(z)}),
{", ".join(starts)},
lloyd AS (
  SELECT 0 AS step, [{state}] AS c, 1e300 AS shift
  UNION ALL
  SELECT step + 1, new, list_sum(list_transform(range(1, {k + 1}), lambda i: list_sum(list_transform(range(1, {len(z) + 1}),
    lambda j: (new[i][j] - c[i][j]) * (new[i][j] - c[i][j])))))
  FROM (
    SELECT step, any_value(c) AS c, list(mean ORDER BY nth) AS new
    FROM (SELECT step, any_value(c) AS c, {nearest} AS nth, [{means}] AS mean FROM points, lloyd
          WHERE shift > {CLUSTER_TOLERANCE} * {float(GRID * GRID)} AND step < {CLUSTER_ITERATIONS} GROUP BY step, nth)
    GROUP BY step)),
centres AS (SELECT list_sort(arg_max(c, step)) AS c FROM lloyd),
clusters AS (SELECT {key}, CAST({nearest} - 1 AS INT) AS cluster FROM placed, centres)"""


_KMEANS = f"RECURSIVE {_FEATURES}, " + kmeans_sql("features", CLUSTER_FEATURES, "place")


@query(f"""WITH {_KMEANS} SELECT l_orderkey, l_linenumber, c.cluster FROM features f LEFT JOIN clusters c USING (place)""")
def kmeans_clusters(spark, sf_dir):
    """Labels of k-means; the SQL draws the same start and moves it until it stays."""
    return kmeans(_features(spark, sf_dir)).select("l_orderkey", "l_linenumber", "cluster")


def named_sql(rows: str) -> str:
    """Common tables up to ``names`` (cluster, cluster_name) of the labelled table ``rows``."""
    return f"""cuts AS (SELECT {", ".join(
        f"quantile_cont({c}, 0.33) AS lo_{a}, quantile_cont({c}, 0.66) AS hi_{a}" for a, c in _NAMED.items())} FROM {rows}),
means AS (SELECT cluster, {", ".join(f"avg({c}) AS {c}" for c in _NAMED.values())} FROM {rows} WHERE cluster IS NOT NULL GROUP BY cluster),
names AS (SELECT cluster, concat('C', CAST(cluster AS STRING), ' (price:', {_level("p", _NAMED["p"])}, ', quality:', {_level("q", _NAMED["q"])},
  ', durability:', {_level("d", _NAMED["d"])}, ', sentiment:', {_level("s", _NAMED["s"])}, ')') AS cluster_name FROM means m, cuts)"""


@query(f"""WITH {_KMEANS}, labelled AS (
  SELECT f.* EXCLUDE (cluster), c.cluster FROM features f LEFT JOIN clusters c USING (place)), {named_sql("labelled")}
SELECT l_orderkey, l_linenumber, l.cluster, cluster_name FROM labelled l LEFT JOIN names USING (cluster)""")
def product_segments(spark, sf_dir):
    """k-means with named segments."""
    return cluster_products(_features(spark, sf_dir)).select("l_orderkey", "l_linenumber", "cluster", "cluster_name")


@query("""SELECT count_if(l_tax <> 0) AS labelled, count_if(l_tax = 0) AS unlabelled, 4 AS clusters, 0 AS nearer_elsewhere,
0 AS otherwise_dealt FROM lineitem""")
def kmeans_properties(spark, sf_dir):
    """What holds for the clusters of any start: rows with a gap have none, no row lies nearer to the mean of
    another cluster, and the same rows in 1, 3 or 17 parts get the same labels."""
    rows = _features(spark, sf_dir)
    parts, key = (1, 3, 17), ("l_linenumber", "l_orderkey")
    with ThreadPoolExecutor(len(parts) + 1) as pool:        # the fit of one part is a single task for long
        *dealt, clustered = pool.map(kmeans, [*(rows.repartition(n, *key) for n in parts), rows])
    columns = [*rows.columns, "cluster"]
    moved = reduce(DataFrame.unionByName, [arm.select(*columns, F.lit(n).alias("n")).repartition(*key) for arm, n in [
        *((arm, -1) for arm in dealt), (clustered, len(parts))]])       # equal rows meet as they are, none would be summed before
    otherwise = moved.groupBy(*columns).agg(F.sum("n").alias("n")).agg(
        F.coalesce(F.sum(F.abs("n")), F.lit(0)).cast("int")).scalar()
    labelled = standardize(clustered, CLUSTER_FEATURES)
    z = [f"z_{name}" for name in CLUSTER_FEATURES]
    means = labelled.groupBy("cluster").agg(F.struct(*[F.avg(name).alias(name) for name in z]).alias("mean"))
    centres = means.agg(F.struct(*[F.max(F.when(F.col("cluster") == i, F.col("mean"))).alias(f"c{i}") for i in range(CLUSTERS)]))
    placed = labelled.select("cluster", *[F.coalesce(name, F.lit(0.0)).alias(name) for name in z], centres.scalar().alias("centres"))
    apart = [reduce(add, [F.pow(F.col(name) - F.col(f"centres.c{i}.{name}"), F.lit(2.0)) for name in z]).alias(f"far{i}")
             for i in range(CLUSTERS)]
    own = F.coalesce(*[F.when(F.col("cluster") == i, F.col(f"far{i}")) for i in range(CLUSTERS)])
    nearer = own > F.least(*[f"far{i}" for i in range(CLUSTERS)]) + 0.05        # the centres still moved a little at the end
    found = placed.select("cluster", *apart).select("cluster", nearer.alias("nearer")).agg(F.struct(
        F.count("cluster").alias("labelled"), F.count_if(F.col("cluster").isNull()).alias("unlabelled"),
        F.countDistinct("cluster").cast("int").alias("clusters"), F.count_if("nearer").cast("int").alias("nearer_elsewhere")))
    # two subqueries of one row run side by side
    return spark.range(1).select(found.scalar().alias("found"), otherwise.alias("otherwise_dealt")).select("found.*", "otherwise_dealt")
