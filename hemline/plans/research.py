"""The product study: cost per wear, claims, correlation, segments."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.constants import CLUSTER_SEED, CLUSTERS, QUARTILES
from hemline.functions.text import has_claim
from hemline.operators.aggregates import (
    claim_counts,
    claim_low_quality_share,
    claims,
    cpw_by_category,
    cpw_by_category_complete,
)
from hemline.operators.clusters import cluster_products
from hemline.operators.correlation import pearson_r, regression_line, with_p_value
from hemline.operators.lexicon import Lexicon
from hemline.operators.quantiles import quality_quartiles_by_claim
from hemline.plans.products import enrich_products, normalize_products
from hemline.session import written
from hemline.sources.writers import write_csv, write_metrics
from hemline.valence import DEFAULT_LEXICON

QUALITY, SENTIMENT = "objective_quality_score", "sentiment_score"


def study_metrics(enriched: DataFrame) -> DataFrame:
    """One row: r, n and p of quality against sentiment, and r of claim against quality.

    One scan, one aggregate.
    """
    claim = F.col("has_claim") if "has_claim" in enriched.columns else has_claim("description")
    flag = F.when(F.col(QUALITY).isNotNull(), claim.cast("int"))
    both = F.col(QUALITY).isNotNull() & F.col(SENTIMENT).isNotNull()
    summary = enriched.agg(
        pearson_r(QUALITY, SENTIMENT).alias("r"),
        F.count_if(both).alias("n"),
        pearson_r(flag, QUALITY).alias("claims_r"),
    )
    return with_p_value(summary)


@dataclass(frozen=True)
class Study:
    """One study over enriched products; each table is made when asked for."""

    enriched: DataFrame
    k: int = CLUSTERS
    seed: int = CLUSTER_SEED

    @property
    def claim_rows(self) -> DataFrame:
        return claims(self.enriched)

    def products(self) -> DataFrame:
        """Enriched products with their segments; fits k-means."""
        return cluster_products(self.enriched, self.k, self.seed).drop("has_claim")

    def cpw(self) -> DataFrame:
        return cpw_by_category(self.enriched)

    def cpw_complete(self) -> DataFrame:
        return cpw_by_category_complete(self.enriched)

    def claim_shares(self) -> DataFrame:
        return claim_low_quality_share(self.claim_rows)

    def claim_counts(self) -> DataFrame:
        return claim_counts(self.claim_rows)

    def claim_quartiles(self) -> DataFrame:
        return quality_quartiles_by_claim(self.claim_rows, QUARTILES)

    def metrics(self) -> DataFrame:
        return study_metrics(self.enriched)

    def line(self) -> DataFrame:
        return regression_line(self.enriched, QUALITY, SENTIMENT)


def study(products: DataFrame, k: int = CLUSTERS, seed: int = CLUSTER_SEED,
          lexicon: Lexicon = DEFAULT_LEXICON, path: str | None = None) -> Study:
    """A study of normalized products.

    The enriched rows are written once, to ``path`` or the shared folder, claim
    flag included: what follows reads a few narrow columns of them, no text.
    """
    flagged = enrich_products(products, lexicon).withColumn("has_claim", has_claim("description"))
    return Study(written(flagged, "enriched", path), k, seed)


def research_analysis(spark: SparkSession, paths: Iterable[str], output: str, k: int = CLUSTERS,
                      lexicon: Lexicon = DEFAULT_LEXICON, multiline: bool = False) -> bool:
    """Run the study over product CSVs and write its tables; False without any product."""
    products = normalize_products(spark, paths, multiline)
    if products.isEmpty():
        return False
    result = study(products, k, lexicon=lexicon, path=f"{output}/enriched_parquet")
    tables = f"{output}/tables"
    write_csv(result.products(), f"{tables}/products_enriched")
    write_csv(result.cpw(), f"{tables}/proxy_cpw_by_category", single=True)
    write_csv(result.claim_shares(), f"{tables}/claims_vs_quality", single=True)
    write_metrics(result.metrics(), f"{tables}/correlation")
    write_csv(result.cpw_complete(), f"{tables}/plots/proxy_cpw_by_category", single=True)
    write_csv(result.claim_counts(), f"{tables}/plots/claim_counts", single=True)
    write_csv(result.claim_quartiles(), f"{tables}/plots/claim_quartiles", single=True)
    write_csv(result.line(), f"{tables}/plots/regression_line", single=True)
    return True
