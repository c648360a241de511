"""Lookup tables built from the fixed values. All have a fixed size, so they may be broadcast."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadloom.functions import catalog

COUNTRY_FACTS = ("country string, continent string, tld string, dial string, aliases array<string>, "
                 "local_buyer array<string>, name_ko string")


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalog.country_rows(), COUNTRY_FACTS)


def with_country_facts(df: DataFrame, country: str = "country", facts: DataFrame | None = None) -> DataFrame:
    """Add top-level domain, dial code, aliases and buyer words; unknown countries get a default row."""
    fields = [F.col("country").alias("_country"), "continent", "tld", "dial", "aliases", "local_buyer"]
    # The catalogue has 55 rows; how a table given by the user is joined follows from its size in bytes.
    lookup = F.broadcast(countries(df.sparkSession).select(*fields)) if facts is None else facts.select(*fields)
    default_words = F.array(F.lit("importer"), F.lit("distributor"))
    return (df.join(lookup, F.col(country) == F.col("_country"), "left").drop("_country")
            .withColumns({
                "continent": F.coalesce("continent", F.lit("custom")),
                "tld": F.coalesce("tld", F.lit("")),
                "dial": F.coalesce("dial", F.lit("")),
                "aliases": F.coalesce("aliases", F.array(F.lower(F.col(country)))),
                "local_buyer": F.coalesce("local_buyer", default_words),
            }))


def country_name_ko(country: Column) -> Column:
    """Korean country name for reports; an unknown name stays as it is."""
    names = F.create_map(*[F.lit(x) for pair in catalog.KOREAN_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, country), country)


def countries_in(spark: SparkSession, continent: str | None = None, batch: str | None = None) -> DataFrame:
    """Countries of a continent, or of one run-sized batch in the order of the batch."""
    table = countries(spark)
    if continent is not None:
        return table.where(F.col("continent") == continent)
    names = catalog.WORLD_BATCHES[batch]
    order = spark.createDataFrame(list(enumerate(names)), "position int, country string")
    return table.join(F.broadcast(order), "country").orderBy("position").drop("position")


def taxonomy(spark: SparkSession) -> DataFrame:
    """One row per group, subcategory and product."""
    return spark.createDataFrame(catalog.taxonomy_rows(),
                                 "major string, industry string, subcategory string, product_ko string, product string")


def product_aliases(spark: SparkSession, products: Sequence[str], country: str = "") -> DataFrame:
    rows = [(p, position, alias) for p in products
            for position, alias in enumerate(catalog.product_aliases(p, country))]
    return spark.createDataFrame(rows, "product string, position int, alias string")
